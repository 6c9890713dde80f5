"""Queries of fits, search, fronts, statistics, figures' tables, lineage and the stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import metrics, model, pareto, prep, search, stats
from ..plans.frames import documents_frame, line_frame, mixed_frame
from ..plans.ood import DomainEvaluation
from ..plans.run import TrainedRun, distinct_masks, train
from ..plans.suite import Suite, SuiteSettings
from ..sources.staging import lasting
from ..sources.store import fingerprint
from ..sources.tables import table
from .metrics import AUC_SQL
from .registry import query

PACKAGE = [("qty", 25.0, 14.0, 0.8), ("price", 50000.0, 28000.0, 1.6), ("disc", 0.05, 0.03, -0.4), ("(intercept)", 0.0, 1.0, 0.1)]


@query("WITH {frame:line} SELECT l_returnflag, round(avg(p), 6) AS mean_p, round(max(p), 6) AS max_p, round(min(p), 6) AS min_p FROM (SELECT l_returnflag, 1 / (1 + exp(-(0.8 * (qty - 25) / 14 + 1.6 * (price - 50000) / 28000 - 0.4 * (disc - 0.05) / 0.03 + 0.1))) AS p FROM line) GROUP BY 1")
def model_score_columns(spark: SparkSession, d: str) -> DataFrame:
    df = line_frame(spark, d).df.withColumn("p", model.score_column(PACKAGE))
    return df.groupBy("l_returnflag").agg(r6(F.avg("p")).alias("mean_p"), r6(F.max("p")).alias("max_p"), r6(F.min("p")).alias("min_p"))


@query()
def model_fit(spark: SparkSession, d: str) -> DataFrame:
    """A fit of the document features on training rows, with each coefficient's agreement in sign."""
    frame = documents_frame(spark, d)
    train = frame.part(True).df
    rows = model.fit_frame(train, frame.features, frame.label)
    made = spark.createDataFrame(rows, "feature string, mean double, scale double, coef double")
    corr = metrics.marginal_correlations(train, frame.features, frame.label)
    return made.join(corr, "feature", "left").select("feature", r6("coef").alias("coef"), r6("corr").alias("corr"), (F.col("coef") * F.col("corr") > 1e-12).alias("consistent"))


@query()
def model_oof(spark: SparkSession, d: str) -> DataFrame:
    """AUC, threshold and confusion of out-of-fold scores: the numbers that a deployed model is chosen by."""
    frame = documents_frame(spark, d)
    folds = prep.stratified_folds(frame.df, frame.label, frame.row_id)
    scored = model.out_of_fold(folds, frame.features, frame.label).withColumn("all", F.lit("all"))
    threshold = metrics.balanced_threshold(scored, ["all"], frame.row_id, frame.label).select("all", "threshold")
    both = scored.join(F.broadcast(threshold), "all")
    out = metrics.confusion(both, ["all"], F.col("threshold"), frame.label)
    return out.join(metrics.rank_metrics(scored, ["all"], frame.label), "all").join(threshold, "all").select(*[r6(c).alias(c) for c in ("threshold", "accuracy", "f1_score", "sensitivity", "specificity", "balanced_accuracy", "roc_auc", "pr_auc")])


def _searched(spark: SparkSession, d: str):
    frame = documents_frame(spark, d)
    folds = prep.stratified_folds(frame.df.where("train"), frame.label, frame.row_id)
    return frame, model.fitness(folds, frame.features, frame.label, frame.row_id)


@query()
def search_nsga2(spark: SparkSession, d: str) -> DataFrame:
    frame, fitness = _searched(spark, d)
    found = search.nsga2(fitness, len(frame.features), [42, 43], size=8, generations=3)
    rows = [(e.seed, i, m, a, s, m.count("1")) for e in found for i, (m, (a, s)) in enumerate(zip(e.population, e.points))]
    df = spark.createDataFrame(rows, "seed int, ordinal int, mask string, auc double, sign double, n_features int")
    return pareto.pareto_front(distinct_masks(df), ["seed"]).select("seed", "mask", r6("auc").alias("auc"), r6("sign").alias("sign"), "n_features")


@query()
def search_ga(spark: SparkSession, d: str) -> DataFrame:
    frame, fitness = _searched(spark, d)
    found = search.genetic(fitness, len(frame.features), [42, 43], size=8, generations=3)
    return spark.createDataFrame([(e.seed, e.population[0], round(e.points[0][0], 6)) for e in found], "seed int, mask string, auc double")


@query()
def search_stepwise(spark: SparkSession, d: str) -> DataFrame:
    frame, fitness = _searched(spark, d)
    path = search.forward(fitness, len(frame.features))
    return spark.createDataFrame([(i, m, round(a, 6)) for i, (m, a) in enumerate(path)], "step int, mask string, auc double")


#: Points of two objectives on the parts table: an invented history that SQL can repeat.
POINTS_SQL = "pts AS (SELECT p_size AS gen, p_partkey AS ordinal, p_brand AS seed, floor(p_retailprice) % 50 / 50 AS auc, floor(p_retailprice * 7) % 40 / 40 AS sign FROM part)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("p_retailprice")
    return table(spark, d, "part").select(F.col("p_size").alias("gen"), F.col("p_partkey").alias("ordinal"), F.col("p_brand").alias("seed"), ((F.floor(price) % 50) / 50).alias("auc"), ((F.floor(price * 7) % 40) / 40).alias("sign"))


@query("WITH " + POINTS_SQL + " SELECT gen, round(max(auc), 6) AS max_auc, round(avg(auc), 6) AS mean_auc, round(stddev_pop(auc), 6) AS std_auc, round(max(sign), 6) AS max_sign, round(avg(sign), 6) AS mean_sign, round(stddev_pop(sign), 6) AS std_sign, count(*) AS nevals FROM pts GROUP BY 1")
def search_generation_stats(spark: SparkSession, d: str) -> DataFrame:
    f = {"max": F.max, "mean": F.avg, "std": F.stddev_pop}
    return _points(spark, d).groupBy("gen").agg(*[r6(g(c)).alias(f"{n}_{c}") for c in ("auc", "sign") for n, g in f.items()], F.count(F.lit(1)).alias("nevals"))


@query("WITH " + POINTS_SQL + " SELECT seed, ordinal, auc, sign FROM pts a WHERE NOT EXISTS (SELECT 1 FROM pts b WHERE b.seed = a.seed AND b.auc >= a.auc AND b.sign >= a.sign AND (b.auc > a.auc OR b.sign > a.sign))")
def pareto_front(spark: SparkSession, d: str) -> DataFrame:
    return pareto.pareto_front(_points(spark, d), ["seed"]).select("seed", "ordinal", "auc", "sign")


KNEE_SQL = POINTS_SQL + """, f AS (SELECT * FROM pts a WHERE NOT EXISTS (SELECT 1 FROM pts b WHERE b.seed = a.seed AND b.auc >= a.auc AND b.sign >= a.sign AND (b.auc > a.auc OR b.sign > a.sign))),
s AS (SELECT *, coalesce((auc - min(auc) OVER w) / nullif(max(auc) OVER w - min(auc) OVER w, 0), 0) AS x, coalesce((sign - min(sign) OVER w) / nullif(max(sign) OVER w - min(sign) OVER w, 0), 0) AS y FROM f WINDOW w AS (PARTITION BY seed)),
e AS (SELECT seed, arg_max(struct_pack(x := x, y := y, o := ordinal), struct_pack(a := x, b := -ordinal)) AS p, arg_max(struct_pack(x := x, y := y, o := ordinal), struct_pack(a := y, b := -ordinal)) AS q FROM s GROUP BY 1),
d AS (SELECT s.*, CASE WHEN p.o = q.o THEN (ordinal = p.o)::INTEGER::DOUBLE ELSE round(abs((x - p.x) * (q.y - p.y) - (y - p.y) * (q.x - p.x)) / nullif(sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2), 0), 12) END AS dist FROM s JOIN e USING (seed))"""


@query("WITH " + KNEE_SQL + " SELECT seed, ordinal, auc, sign FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY dist DESC, ordinal) AS k FROM d) WHERE k = 1")
def pareto_knee(spark: SparkSession, d: str) -> DataFrame:
    return pareto.knee(pareto.pareto_front(_points(spark, d), ["seed"]), ["seed"]).select("seed", "ordinal", "auc", "sign")


@query("WITH " + POINTS_SQL + " SELECT seed, arg_max(ordinal, struct_pack(a := auc, b := -ordinal)) AS best_auc, arg_max(ordinal, struct_pack(a := sign, b := -ordinal)) AS best_sign FROM pts GROUP BY 1")
def pareto_best(spark: SparkSession, d: str) -> DataFrame:
    pts = _points(spark, d)
    a = pareto.best_of(pts, ["seed"], "auc").select("seed", F.col("ordinal").alias("best_auc"))
    return a.join(pareto.best_of(pts, ["seed"], "sign").select("seed", F.col("ordinal").alias("best_sign")), "seed")


#: Scores of methods by seed and family on the orders table; a method without a seed was scored once.
SCORES_SQL = """sc AS (SELECT o_orderpriority AS family, CASE o_custkey % 4 WHEN 0 THEN 'two' WHEN 1 THEN 'one' WHEN 2 THEN 'step' ELSE 'all' END AS method,
CASE WHEN o_custkey % 4 < 2 THEN (o_custkey // 4 % 10)::INTEGER END AS seed, (o_orderkey % 5)::INTEGER AS repetition, floor(o_totalprice) % 1000 / 1000 AS score FROM orders),
runs AS (SELECT family, method, seed, avg(score) AS score FROM sc GROUP BY ALL)"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("o_custkey") % 4
    method = F.when(kind == 0, "two").when(kind == 1, "one").when(kind == 2, "step").otherwise("all")
    seed = F.when(kind < 2, (F.floor(F.col("o_custkey") / 4) % 10).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("family"), method.alias("method"), seed.alias("seed"), (F.col("o_orderkey") % 5).cast("int").alias("repetition"), ((F.floor("o_totalprice") % 1000) / 1000).alias("score"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).groupBy("family", "method", "seed").agg(F.avg("score").alias("score"))


DIFF_SQL = SCORES_SQL + ", df AS (SELECT t.family, b.method AS baseline, t.seed, t.score - b.score AS difference FROM runs t JOIN runs b ON b.family = t.family AND b.method <> 'two' AND (b.seed = t.seed OR b.seed IS NULL) WHERE t.method = 'two')"


@query("WITH " + DIFF_SQL + """, z AS (SELECT family, baseline, round(difference, 12) AS d FROM df WHERE round(difference, 12) <> 0),
r AS (SELECT family, baseline, d, rank() OVER (PARTITION BY family, baseline ORDER BY abs(d)) + (count(*) OVER (PARTITION BY family, baseline, abs(d)) - 1) / 2 AS rk FROM z)
SELECT family, baseline, count(*) AS n, round(coalesce(sum(rk) FILTER (WHERE d > 0), 0), 3) AS w_plus, round(coalesce(sum(rk) FILTER (WHERE d < 0), 0), 3) AS w_minus FROM r GROUP BY 1, 2""")
def stats_wilcoxon_ranks(spark: SparkSession, d: str) -> DataFrame:
    diff = stats.paired_differences(_runs(spark, d), ["family"], "seed", "method", "score", "two")
    out = stats.signed_ranks(diff, ["family", "baseline"], "difference")
    return out.select("family", "baseline", "n", F.round(F.col("w_plus").cast("double"), 3).alias("w_plus"), F.round(F.col("w_minus").cast("double"), 3).alias("w_minus"))


@query()
def stats_wilcoxon_p(spark: SparkSession, d: str) -> DataFrame:
    diff = stats.paired_differences(_runs(spark, d), ["family"], "seed", "method", "score", "two")
    return stats.with_p(stats.signed_ranks(diff, ["family", "baseline"], "difference"), ["family", "baseline"])


@query("WITH " + DIFF_SQL + " SELECT family, baseline, count(*) AS n_runs, round(avg(difference), 6) + 0.0 AS mean_difference, round(quantile_cont(difference, 0.5), 6) + 0.0 AS median_difference, count(*) FILTER (WHERE round(difference, 12) > 0) AS n_better FROM df GROUP BY 1, 2")
def stats_paired_table(spark: SparkSession, d: str) -> DataFrame:
    diff = stats.paired_differences(_runs(spark, d), ["family"], "seed", "method", "score", "two")
    out = stats.paired_table(diff, ["family", "baseline"])
    return out.select("family", "baseline", "n_runs", r6("mean_difference").alias("mean_difference"), r6("median_difference").alias("median_difference"), "n_better")


RANK_SQL = "{frame:doc}, r AS (SELECT lang, " + ", ".join(f"rank() OVER (PARTITION BY lang ORDER BY {c}) + (count(*) OVER (PARTITION BY lang, {c}) - 1) / 2 AS {a}" for c, a in (("avg_w", "x"), ("n_nl", "y"), ("n_chars", "z"))) + " FROM doc), c AS (SELECT lang, count(*) AS n, " + ", ".join(f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0) AS {a}{b}" for a, b in ("xy", "xz", "yz")) + " FROM r GROUP BY 1)"


@query("WITH " + RANK_SQL + " SELECT lang, n, round(xy, 6) + 0.0 AS spearman FROM c")
def stats_spearman(spark: SparkSession, d: str) -> DataFrame:
    return stats.spearman(documents_frame(spark, d).df, ["lang"], "avg_w", "n_nl").withColumn("spearman", r6("spearman"))


@query("WITH " + RANK_SQL + " SELECT lang, round(xy, 6) + 0.0 AS spearman, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) + 0.0 AS partial_spearman FROM c")
def stats_partial_spearman(spark: SparkSession, d: str) -> DataFrame:
    out = stats.partial_spearman(documents_frame(spark, d).df, ["lang"], "avg_w", "n_nl", "n_chars")
    return out.select("lang", r6("spearman").alias("spearman"), r6("partial_spearman").alias("partial_spearman"))


@query("WITH " + SCORES_SQL + " SELECT family, method, count(*) AS n_runs, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd FROM runs GROUP BY 1, 2")
def stats_family_summary(spark: SparkSession, d: str) -> DataFrame:
    out = stats.family_summary(_scores(spark, d), ["family", "method", "seed"], ["family", "method"], "score")
    return out.select("family", "method", "n_runs", r6("mean").alias("mean"), r6("sd").alias("sd"))


@query("WITH " + SCORES_SQL + " SELECT family, method, seed, round(avg(score), 6) AS mean, round(min(score), 6) AS worst, round(stddev_samp(score), 6) AS sd, count(*) AS n_scenarios FROM sc GROUP BY ALL")
def stats_family_scores(spark: SparkSession, d: str) -> DataFrame:
    out = stats.family_scores(_scores(spark, d), ["family", "method", "seed"], "score")
    return out.select("family", "method", "seed", r6("mean").alias("mean"), r6("worst").alias("worst"), r6("sd").alias("sd"), "n_scenarios")


@query("WITH " + SCORES_SQL + ", u AS (SELECT family, repetition, avg(score) FILTER (WHERE method = 'two') AS t, avg(score) FILTER (WHERE method = 'all') AS b FROM sc GROUP BY 1, 2) SELECT family, round(avg((t > b)::INTEGER), 6) AS share FROM u WHERE t IS NOT NULL AND b IS NOT NULL GROUP BY 1")
def stats_share_better(spark: SparkSession, d: str) -> DataFrame:
    return stats.share_better(_scores(spark, d), ["family", "repetition"], "method", "score", "two", "all").withColumn("share", r6("share"))


@query("WITH " + SCORES_SQL + ", m AS (SELECT family, seed, avg(score) FILTER (WHERE method = 'two') AS x, avg(score) FILTER (WHERE method = 'one') AS y FROM sc WHERE seed IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT method) = 2), r AS (SELECT family, rank() OVER (PARTITION BY family ORDER BY x) AS rx, rank() OVER (PARTITION BY family ORDER BY y) AS ry FROM m) SELECT family, count(*) AS n, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 6) + 0.0 AS spearman FROM r GROUP BY 1 HAVING count(*) >= 4")
def stats_sign_vs_degradation(spark: SparkSession, d: str) -> DataFrame:
    of = lambda m: F.avg(F.when(F.col("method") == m, F.col("score")))
    pts = _scores(spark, d).where("seed IS NOT NULL").groupBy("family", "seed").agg(of("two").alias("x"), of("one").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return stats.spearman(pts, ["family"], "x", "y").where("n >= 4").withColumn("spearman", r6("spearman"))


GRID_SQL = """g AS (SELECT l_returnflag AS model, (l_linenumber - 1) * 0.25 AS noise, floor(l_quantity / 10) * 0.5 AS shift, avg(1 - l_discount) AS v FROM lineitem GROUP BY ALL),
c AS (SELECT *, v / max(CASE WHEN noise = 0 AND shift = 0 THEN v END) OVER (PARTITION BY model) AS r FROM g),
l AS (SELECT *, lag(noise) OVER (PARTITION BY model, shift ORDER BY noise) AS n0, lag(r) OVER (PARTITION BY model, shift ORDER BY noise) AS r0 FROM c),
s AS (SELECT model, shift, sum((noise - n0) * (r + r0) / 2) / (max(noise) - min(noise)) AS v FROM l GROUP BY 1, 2),
t AS (SELECT *, lag(shift) OVER (PARTITION BY model ORDER BY shift) AS s0, lag(v) OVER (PARTITION BY model ORDER BY shift) AS v0 FROM s)"""


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model"), ((F.col("l_linenumber") - 1) * 0.25).alias("noise"), (F.floor(F.col("l_quantity") / 10) * 0.5).alias("shift")).agg(F.avg(1 - F.col("l_discount")).alias("v"))


@query("WITH " + GRID_SQL + " SELECT model, round(sum((shift - s0) * (v + v0) / 2) / (max(shift) - min(shift)), 6) AS aurs FROM t GROUP BY 1", also="grid_aurs_whole")
def grid_aurs(spark: SparkSession, d: str) -> DataFrame:
    return stats.grid_area(_grid(spark, d), ["model"], "noise", "shift", "v").withColumn("aurs", r6("aurs"))


@query("WITH " + GRID_SQL + " SELECT model, noise, round(v, 6) AS v FROM g WHERE abs(shift - 1.0) < 1e-9", also="grid_slices_whole")
def grid_slices(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).where(F.abs(F.col("shift") - 1.0) < 1e-9).select("model", "noise", r6("v").alias("v"))


@query("SELECT model, round(min(v), 4) AS min, round(quantile_cont(v, 0.5), 4) AS median, round(avg(v), 4) AS mean, round(max(v), 4) AS max, round(stddev_samp(v), 4) AS std FROM (SELECT p_brand AS model, p_size::DOUBLE AS v FROM part) GROUP BY 1")
def feature_count_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.summary_statistics(table(spark, d, "part").select(F.col("p_brand").alias("model"), F.col("p_size").cast("double").alias("v")), ["model"], "v")


@query("SELECT count(*) AS n, 0::BIGINT AS n_missing, round(max(abs(o_totalprice - round(o_totalprice))), 6) AS deviation FROM orders")
def model_record_diff(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    b = a.withColumn("o_totalprice", F.round("o_totalprice"))
    return stats.largest_deviation(a, b, ["o_orderkey"], "o_totalprice").withColumn("deviation", r6("deviation"))


#: The draws of stats.draws(): 64-bit arithmetic in numbers of 128 bits.
_WRAP, _MIXED = "18446744073709551616::UHUGEINT", "((xor({x}, {x} >> {by})::UHUGEINT * {c}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
DRAWS_SQL = f"""n(sample) AS (SELECT range FROM range(2000)),
k0 AS (SELECT doc_id, label, -avg_w AS p, cast(concat('0x', substr(md5(concat_ws('|', 1, 'bootstrap', doc_id)), 1, 16)) AS UBIGINT) AS key FROM doc),
k1 AS (SELECT sample, label, p, ((key::UHUGEINT + ((sample + 1)::UHUGEINT * {stats.STEP}::UHUGEINT) % {_WRAP}) % {_WRAP})::UBIGINT AS x FROM k0, n),
k2 AS (SELECT sample, label, p, {_MIXED.format(x="x", by=30, c=stats.MIX_1)} AS x FROM k1),
k3 AS (SELECT sample, label, p, {_MIXED.format(x="x", by=27, c=stats.MIX_2)} AS x FROM k2),
k4 AS (SELECT sample, label, p, (xor(x, x >> 31) >> 11)::DOUBLE / 9007199254740992.0 AS u FROM k3)"""
BOOTSTRAP_SQL = "{frame:doc}, " + DRAWS_SQL + ", preds AS (SELECT sample, label AS y, p, (" + " + ".join(f"(u >= {c!r})::INTEGER" for c in stats.POISSON) + ")::DOUBLE AS w FROM k4), "


@query("WITH " + BOOTSTRAP_SQL + AUC_SQL.replace("{k}", "sample").replace("FROM preds", "FROM preds WHERE w > 0") + " SELECT round(quantile_cont(roc_auc, 0.025), 6) AS low, round(quantile_cont(roc_auc, 0.975), 6) AS high, count(roc_auc) AS n_samples FROM a")
def bootstrap_auc(spark: SparkSession, d: str) -> DataFrame:
    """Percentile interval of a score's AUC over 50 resamples of the document rows."""
    df = documents_frame(spark, d).df.select("doc_id", F.col("label").alias("y"), (-F.col("avg_w")).alias("p"))
    scores = stats.bootstrap_scores(df, [], "doc_id", 2000).withColumn("all", F.lit("all"))
    return stats.percentile_interval(scores, ["all"], "roc_auc").select(r6("low").alias("low"), r6("high").alias("high"), "n_samples")


@query()
def lineage_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    marks = fingerprint(table(spark, d, "orders"))
    return spark.createDataFrame([(marks["rows"], marks["columns"], marks["hash"])], "rows string, columns string, hash string")


@query("SELECT seed FROM range(0, 20) r(seed) WHERE seed NOT IN (SELECT DISTINCT o_orderkey % 13 FROM orders)")
def lineage_missing_seeds(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "orders").select((F.col("o_orderkey") % 13).alias("seed")).distinct()
    return spark.range(20).select(F.col("id").alias("seed")).join(have, "seed", "left_anti")


#: Runs and suites of this application, by its name and the tables: several queries ask for the same one.
_MADE: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, d: str, name: str, make: Callable[[], object]):
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _MADE:
        with lasting():
            _MADE[key] = make()
    return _MADE[key]


def _run(spark: SparkSession, d: str) -> TrainedRun:
    return _once(spark, d, "run", lambda: train(mixed_frame(spark, d), [42, 43]))


def _suite(spark: SparkSession, d: str) -> Suite:
    """The suite at its defaults, but that a family of pairs counts with any number of them: documents have few features."""
    return _once(spark, d, "suite", lambda: Suite.of_run(_run(spark, d), SuiteSettings(least_pairs=1)))


@query()
def suite_models(spark: SparkSession, d: str) -> DataFrame:
    with lasting():
        out = _suite(spark, d).models()
    return out.select("model", "method", "seed", "n_features", "n_consistent", "n_inconsistent", *[r6(c).alias(c) for c in ("sign_consistency", "clean_roc_auc", "clean_pr_auc")])


@query()
def suite_scenarios(spark: SparkSession, d: str) -> DataFrame:
    """The scenario table: how far every population and pair of features is moved, and what supports it."""
    with lasting():
        out = _suite(spark, d).scenarios
    numbers = [c for c, kind in out.dtypes if kind == "double" and c != "level"]
    return out.select("scenario_id", "family", "unit", "direction", "level", "pair_a", "pair_b", "pair_kind", *[r6(c).alias(c) for c in numbers], "attainable", "supported", "usable", "in_cohort")


@query()
def suite_reweighting_scores(spark: SparkSession, d: str) -> DataFrame:
    with lasting():
        out = _suite(spark, d).reweighting_scores
    return out.select("scenario_id", "model", *[r6(c).alias(c) for c in ("roc_auc", "pr_auc", "delta_roc_auc", "delta_pr_auc")])


@query()
def suite_sign_vs_degradation(spark: SparkSession, d: str) -> DataFrame:
    """How sign consistency goes with what a run loses, by family, and given its number of features."""
    with lasting():
        out = _suite(spark, d).sign_vs_degradation(least=2)
    return out.select("family", "severity", "n_models", r6("spearman").alias("spearman"), r6("partial_spearman").alias("partial_spearman"))


@query()
def suite_legacy_grid(spark: SparkSession, d: str) -> DataFrame:
    """The earlier grid of the run's models, by seed."""
    with lasting():
        out = _suite(spark, d).legacy_tables()["grid"]
    return out.select("seed", "noise", "shift", *[r6(c).alias(c) for c in out.columns if c.startswith("auc_")])


@query()
def suite_legacy_areas(spark: SparkSession, d: str) -> DataFrame:
    """The area under what each method retains over the earlier grid."""
    with lasting():
        return _suite(spark, d).legacy_tables()["areas"].withColumn("aurs", r6("aurs"))


@query()
def suite_summary(spark: SparkSession, d: str) -> DataFrame:
    with lasting():
        out = _suite(spark, d).summary()
    return out.select("family", "severity", "method", "n_runs", *[r6(c).alias(c) for c in ("roc_auc", "delta_roc_auc", "worst_delta_roc_auc", "corruption_sd")], "n_scenarios")


@query()
def suite_tests(spark: SparkSession, d: str) -> DataFrame:
    """The paired tests of all families and statistics, and the analysis of signs beside them."""
    with lasting():
        out = _suite(spark, d).tests()
    return out.select("family", "severity", "statistic", "baseline", "n_runs", *[r6(c).alias(c) for c in ("mean_difference", "median_difference", "p_value", "scenario_share_better")], "n_better")


def _domains(spark: SparkSession, d: str) -> DomainEvaluation:
    """English documents are the domain, others are out of it."""

    def make() -> DomainEvaluation:
        run = train(documents_frame(spark, d), [42, 43])
        rest = run.frame.df.where("NOT train")
        return DomainEvaluation(run, rest.where("lang = 'en'"), rest.where("lang <> 'en'"))

    return _once(spark, d, "domains", make)


@query()
def ood_per_seed(spark: SparkSession, d: str) -> DataFrame:
    with lasting():
        out = _domains(spark, d).per_seed()
    numbers = [c for c in out.columns if c.endswith(("_auc", "_drop")) or c == "sign_consistency"]
    return out.select("model", "method", "seed", "n_features", "n_inconsistent", *[r6(c).alias(c) for c in numbers])


@query()
def ood_tests(spark: SparkSession, d: str) -> DataFrame:
    """Paired tests with the bootstrap's intervals of 2,000 resamples beside them."""
    with lasting():
        out = _domains(spark, d).tests_with_intervals(2000)
    return out.select("statistic", "baseline", "n_runs", *[r6(c).alias(c) for c in ("mean_difference", "median_difference", "p_value", "low", "high")], "n_better", "n_samples")


@query()
def ood_front(spark: SparkSession, d: str) -> DataFrame:
    """Every mask of every front on either side, after its stored objective was computed again."""
    with lasting():
        domains = _domains(spark, d)
        domains.verified_front()
        out = domains.front()
    return out.select("seed", "mask", "n_features", *[r6(c).alias(c) for c in ("cv_objective", "cv_sign_consistency", "sign_consistency", "id_roc_auc", "ood_roc_auc", "roc_auc_drop")])


@query()
def ood_front_correlations(spark: SparkSession, d: str) -> DataFrame:
    with lasting():
        out = _domains(spark, d).front_correlations()
    return out.select("seed", *[r6(c).alias(c) for c in out.columns if c != "seed"])


@query()
def model_deployment(spark: SparkSession, d: str) -> DataFrame:
    """Which instance of each method would be deployed, and its threshold."""
    rows = [(m, *found) for m, found in _run(spark, d).deployed().items()]
    return spark.createDataFrame(rows, "method string, model string, threshold double").withColumn("threshold", r6("threshold"))


@query()
def model_deployment_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Every instance of a run on test rows, at the threshold that its training rows give it."""
    with lasting():
        out = _run(spark, d).deployment_metrics()
    return out.select("model", "method", "seed", "n_features", *[r6(c).alias(c) for c, kind in out.dtypes if kind == "double"], "chosen")


MONITOR_SQL = """e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, least(greatest(floor(value / 100 * 10), 0), 9)::INTEGER AS bin, (event_type = 'purchase')::INTEGER AS y, 1 + coalesce(value, 0) / 100 AS w FROM events),
s AS (SELECT start, bin, count(*) AS n, sum(y) AS positives, sum(w) AS w, sum(w * w) AS ww FROM e GROUP BY 1, 2),
b AS (SELECT *, coalesce(sum(n - positives) OVER (PARTITION BY start ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)"""


@query("WITH " + MONITOR_SQL + " SELECT epoch(start)::BIGINT AS start, sum(n)::BIGINT AS n, sum(positives)::BIGINT AS positives, round(sum(w) ** 2 / sum(ww) / sum(n), 6) AS ess_fraction, round(sum(positives * (below + (n - positives) / 2)) / nullif(sum(positives) * sum(n - positives), 0), 6) AS auc FROM b GROUP BY 1")
def stream_drift_monitor(spark: SparkSession, d: str) -> DataFrame:
    """The monitor's plan on the event table; tests run the same plan on a stream."""
    from ..streaming.monitor import window_report, window_sums

    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = window_report(window_sums(events))
    return out.select(F.col("start").cast("long").alias("start"), "n", "positives", r6("ess_fraction").alias("ess_fraction"), r6("auc").alias("auc"))


