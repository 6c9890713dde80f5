"""Queries of re-weighting and corruption."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import corrupt, metrics, reweight, scenarios
from ..operators.prep import medians
from ..plans.frames import customer_frame, line_frame
from ..sources.tables import table
from .metrics import AUC_SQL
from .registry import query
from .schema import CUST_SQL, FACTS_SQL, LINE_FLAGS_SQL, flagged_lines, imputed_customers

SEED = 20260926


@query("""WITH o AS (SELECT o_orderkey, o_totalprice AS v, {u:concat_ws('|', 42, 'split', o_orderkey)} < 0.7 AS train FROM orders),
c AS (SELECT o_orderkey, (SELECT count(*) FROM o WHERE train) AS n, sum(train::INTEGER) OVER (ORDER BY v RANGE UNBOUNDED PRECEDING) AS upto, sum(train::INTEGER) OVER (PARTITION BY v) AS here FROM o),
p AS (SELECT o_orderkey, least(greatest((upto - here / 2) / n, 1 / (2 * n)), 1 - 1 / (2 * n)) AS cdf FROM c)
SELECT o_orderkey, round(cdf, 6) AS cdf, round({probit:cdf}, 5) + 0.0 AS score FROM p""")
def normal_scores(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.columns import hash_uniform, probit

    df = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"), (hash_uniform(42, "split", F.col("o_orderkey")) < 0.7).alias("train"))
    out = reweight.ecdf(df, "v", F.col("train"))
    return out.select("o_orderkey", r6("cdf").alias("cdf"), (F.round(probit(F.col("cdf")), 5) + 0.0).alias("score"))


@query("""WITH o AS (SELECT o_orderstatus, (o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders) AS t FROM orders),
w AS (SELECT o_orderstatus, exp(0.5 * t - (SELECT max(0.5 * t) FROM o)) AS r FROM o), v AS (SELECT o_orderstatus, r / (SELECT avg(r) FROM w) AS w FROM w)
SELECT o_orderstatus, round(avg(w), 6) AS mean_w, round(max(w), 6) AS max_w, round(sum(w) ** 2 / sum(w * w) / count(*), 6) AS ess_fraction FROM v GROUP BY 1""")
def tilt_weights(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").select("o_orderstatus", "o_totalprice")
    fit = df.agg(F.avg("o_totalprice"), F.stddev_pop("o_totalprice")).first()
    df = reweight.tilt(df.withColumn("t", (F.col("o_totalprice") - F.lit(fit[0])) / F.lit(fit[1])), "t", 0.5)
    share = F.pow(F.sum("w"), F.lit(2.0)) / F.sum(F.col("w") * F.col("w")) / F.count(F.lit(1))
    return df.groupBy("o_orderstatus").agg(r6(F.avg("w")).alias("mean_w"), r6(F.max("w")).alias("max_w"), r6(share).alias("ess_fraction"))


@query()
def reweight_calibrated_strengths(spark: SparkSession, d: str) -> DataFrame:
    """Strengths that bring the effective sample to nine, eight, seven and six tenths, towards high and low prices."""
    df = line_frame(spark, d).df
    fit = df.agg(F.avg("price"), F.stddev_pop("price")).first()
    targets = [0.9, 0.8, 0.7, 0.6]
    rows = []
    for name, t in (("price", (F.col("price") - F.lit(fit[0])) / F.lit(fit[1])), ("minus price", (F.lit(fit[0]) - F.col("price")) / F.lit(fit[1]))):
        values, counts = reweight.knots(df.select(t.alias("t")), "t")
        found = reweight.calibrate_ess(reweight.ess_share(values, counts), targets)
        rows += [(name, x, round(s, 6), ok) for x, (s, ok) in zip(targets, found)]
    return spark.createDataFrame(rows, "axis string, target double, strength double, attainable boolean")


@query()
def reweight_axes(spark: SparkSession, d: str) -> DataFrame:
    """Mean, spread and effective size of weights along the principal axes of the embeddings."""
    rows = table(spark, d, "embeddings")
    names = [f"e{i}" for i in range(rows.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    df = rows.select("vec_id", *[F.get("embedding", i).cast("double").alias(n) for i, n in enumerate(names)])
    values, vectors, reach, fit = reweight.principal_axes(df, names, F.lit(True))
    axes = reweight.axis_columns(names, values, vectors, reach, fit)
    long = metrics.long_form(df.withColumns(axes), list(axes), ["vec_id"])
    return long.groupBy(F.col("feature").alias("axis")).agg(r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("sd"), F.count(F.lit(1)).alias("n"))


@query()
def reweight_dependence(spark: SparkSession, d: str) -> DataFrame:
    """Weights that weaken the correlation of two document features in four steps, their effective share and error."""
    from ..plans.frames import documents_frame

    df = documents_frame(spark, d).df.where("train")
    scored = reweight.normal_scores(df, "n_chars", F.col("train"), "a")
    scored = reweight.normal_scores(scored, "n_nl", F.col("train"), "b")
    rows = []
    for found, target in zip(*reweight.pair_targets(scored, "a", "b", (True, True), (0.25, 0.5, 0.75, 1.0))):
        ok = found is not None
        rows.append((round(target, 6) + 0.0, round(found.theta, 6) if ok else None, round(found.ess_share, 6) if ok else None, ok))
    return spark.createDataFrame(rows, "target double, theta double, ess_fraction double, reached boolean")


SCENARIOS = [(0, "up", 0.3), (1, "up", 0.6), (2, "down", -0.3), (3, "down", -0.6)]
SCENARIO_SQL = """{frame:line}, t AS (SELECT rid, l_returnflag AS model, label AS y, score AS p, (price - avg(price) OVER ()) / stddev_pop(price) OVER () AS z FROM line),
s(scenario_id, direction, strength) AS (VALUES (0, 'up', 0.3), (1, 'up', 0.6), (2, 'down', -0.3), (3, 'down', -0.6)),
r AS (SELECT scenario_id, direction, model, y, p, exp(strength * z - max(strength * z) OVER (PARTITION BY scenario_id)) AS r FROM t, s),
x AS (SELECT scenario_id, direction, model, y, p, r / avg(r) OVER (PARTITION BY scenario_id) AS w FROM r)"""


def _scenario_rows(spark: SparkSession, d: str) -> tuple[DataFrame, list[scenarios.Tilt]]:
    """Lines with their price in deviations, and the tilts along it."""
    df = line_frame(spark, d).df
    fit = df.agg(F.avg("price"), F.stddev_pop("price")).first()
    rows = df.select("rid", F.col("l_returnflag").alias("model"), F.col("label").alias("y"), F.col("score").alias("p"), F.array((F.col("price") - F.lit(fit[0])) / F.lit(fit[1])).alias("t"), F.lit(False).alias("train"))
    return rows, [scenarios.Tilt(i, 0, 0, one=s) for i, _, s in SCENARIOS]


@query("WITH " + SCENARIO_SQL + """, e AS (SELECT scenario_id, direction, sum(w) ** 2 / sum(w * w) / count(*) AS ess, sum(w) FILTER (WHERE y = 0) ** 2 / sum(w * w) FILTER (WHERE y = 0) AS e0, sum(w) FILTER (WHERE y = 1) ** 2 / sum(w * w) FILTER (WHERE y = 1) AS e1 FROM x GROUP BY 1, 2)
SELECT scenario_id, direction, round(ess, 6) AS ess_fraction, round(e0, 3) AS ess_negatives, round(e1, 3) AS ess_positives, ess >= 0.3 AND least(e0, e1) >= 20 AS supported FROM e""")
def scenario_support(spark: SparkSession, d: str) -> DataFrame:
    rows, tilts = _scenario_rows(spark, d)
    found = scenarios.support(scenarios.moments(rows, tilts), ["scenario_id"])
    names = spark.createDataFrame([(i, n) for i, n, _ in SCENARIOS], "scenario_id int, direction string")
    ok = reweight.supported(F.col("ess_fraction"), F.col("ess_fraction"), F.least("ess_negatives", "ess_positives"))
    return found.join(F.broadcast(names), "scenario_id").select("scenario_id", "direction", r6("ess_fraction").alias("ess_fraction"), F.round("ess_negatives", 3).alias("ess_negatives"), F.round("ess_positives", 3).alias("ess_positives"), ok.alias("supported"))


@query("WITH " + SCENARIO_SQL + ", preds AS (SELECT scenario_id || '-' || model AS k, y, p, w FROM x UNION ALL SELECT 'clean-' || model, y, p, 1.0 FROM t), " + AUC_SQL.replace("{k}", "k") + """ SELECT split_part(a.k, '-', 1)::INTEGER AS scenario_id, split_part(a.k, '-', 2) AS model, round(a.roc_auc, 6) AS roc_auc, round(a.pr_auc, 6) AS pr_auc, round(a.roc_auc - b.roc_auc, 6) + 0.0 AS delta_roc_auc, round(a.pr_auc - b.pr_auc, 6) + 0.0 AS delta_pr_auc
FROM a JOIN a b ON b.k = 'clean-' || split_part(a.k, '-', 2) WHERE NOT a.k LIKE 'clean%'""")
def scenario_scores(spark: SparkSession, d: str) -> DataFrame:
    rows, tilts = _scenario_rows(spark, d)
    out = scenarios.scenario_scores(rows.select("rid", "model", "y", "p", "t"), rows, tilts, "rid")
    return out.select("scenario_id", "model", *[r6(c).alias(c) for c in ("roc_auc", "pr_auc", "delta_roc_auc", "delta_pr_auc")])


@query("""WITH s AS (SELECT 'spend' AS family, c_mktsegment AS unit, (o_orderkey % 4)::INTEGER AS level, avg(o_totalprice) > 150000 AND count(*) > 5 AS usable FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 2, 3)
SELECT family, unit, level, usable, sum(usable::INTEGER) OVER (PARTITION BY family, unit) = (SELECT count(DISTINCT level) FROM s) AS in_cohort FROM s""")
def cohort_units(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    s = joined.groupBy(F.lit("spend").alias("family"), F.col("c_mktsegment").alias("unit"), (F.col("o_orderkey") % 4).cast("int").alias("level")).agg(((F.avg("o_totalprice") > 150000) & (F.count(F.lit(1)) > 5)).alias("usable"))
    return reweight.cohort(s, ["unit"]).select("family", "unit", "level", "usable", "in_cohort")


def _u(family: str, unit: str, row: str = "rid", rep: str = "0") -> str:
    return "{u:concat_ws('|', " + f"{SEED}, '{family}', {rep}, '{unit}', {row})" + "}"


@query("WITH {frame:line}, d AS (SELECT *, " + _u("noise", "qty") + " AS uq, " + _u("noise", "tax") + """ AS ut FROM line), s AS (SELECT stddev_samp(qty) AS sq, stddev_samp(tax) AS st FROM line WHERE train)
SELECT l_returnflag, l_linestatus, round(avg(qty + 0.5 * sq * {probit:greatest(uq, 1e-12)}), 6) AS qty, round(max(tax + 0.5 * st * {probit:greatest(ut, 1e-12)}), 6) AS tax FROM d, s GROUP BY 1, 2""")
def corrupt_gaussian(spark: SparkSession, d: str) -> DataFrame:
    df = line_frame(spark, d).df
    sd = df.where("train").agg(F.stddev_samp("qty").alias("qty"), F.stddev_samp("tax").alias("tax")).first().asDict()
    out = corrupt.gaussian(df, "rid", sd, 0.5, 0, SEED)
    return out.groupBy("l_returnflag", "l_linestatus").agg(r6(F.avg("qty")).alias("qty"), r6(F.max("tax")).alias("tax"))


REDRAW_SQL = "{frame:line}, " + LINE_FLAGS_SQL + ", s AS (SELECT avg(rf_A) AS a, avg(rf_N) AS n, avg(cheap) AS c FROM (SELECT *, (price < 30000)::INTEGER AS cheap FROM fl) WHERE train), d AS (SELECT *, (price < 30000)::INTEGER AS cheap, " + _u("redraw", "rf") + " AS sel, " + _u("redraw value", "rf") + " AS val, " + _u("redraw", "cheap") + " AS csel, " + _u("redraw value", "cheap") + " AS cval FROM fl)"


def _redraw_parts(spark: SparkSession, d: str):
    df = flagged_lines(spark, d).withColumn("cheap", (F.col("price") < 30000).cast("int"))
    shares = df.where("train").agg(*[F.avg(c).alias(c) for c in ("rf_A", "rf_N", "rf_R", "cheap")]).first()
    groups = {"rf": [(c, shares[c]) for c in ("rf_A", "rf_N", "rf_R")]}
    return df, {"cheap": shares["cheap"]}, groups


@query("WITH " + REDRAW_SQL + """, r AS (SELECT CASE WHEN sel < 0.4 THEN (val < a)::INTEGER ELSE rf_A END AS rf_A, CASE WHEN sel < 0.4 THEN (val >= a AND val < a + n)::INTEGER ELSE rf_N END AS rf_N,
CASE WHEN sel < 0.4 THEN (val >= a + n)::INTEGER ELSE rf_R END AS rf_R, CASE WHEN csel < 0.4 THEN (cval < c)::INTEGER ELSE cheap END AS cheap FROM d, s) SELECT rf_A, rf_N, rf_R, cheap, count(*) AS n FROM r GROUP BY ALL""")
def corrupt_redraw(spark: SparkSession, d: str) -> DataFrame:
    df, shares, groups = _redraw_parts(spark, d)
    out = corrupt.redraw(df, "rid", shares, groups, 0.4, 0, SEED)
    return out.groupBy("rf_A", "rf_N", "rf_R", "cheap").agg(F.count(F.lit(1)).alias("n"))


@query("WITH {frame:line}, " + LINE_FLAGS_SQL + ", d AS (SELECT rf_A AS was_a, ls_F AS was_f, CASE WHEN " + _u("under_recording", "rf_A") + " < 0.3 THEN 0 ELSE rf_A END AS rf_A, CASE WHEN " + _u("under_recording", "ls_F") + " < 0.3 THEN 0 ELSE ls_F END AS ls_F FROM fl) SELECT was_a, was_f, rf_A, ls_F, count(*) AS n FROM d GROUP BY ALL")
def corrupt_under_recording(spark: SparkSession, d: str) -> DataFrame:
    df = flagged_lines(spark, d).withColumns({"was_a": F.col("rf_A"), "was_f": F.col("ls_F")})
    out = corrupt.under_record(df, "rid", ["rf_A", "ls_F"], 0.3, 0, SEED)
    return out.groupBy("was_a", "was_f", "rf_A", "ls_F").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + CUST_SQL + ", d AS (SELECT c_custkey, miss, ev_value, ev_n, miss = 0 AND " + _u("masking", "ev_value:missing", "c_custkey") + """ < 0.5 AS hit FROM imp)
SELECT c_custkey, CASE WHEN hit THEN 1 ELSE miss END AS miss, round(CASE WHEN hit THEN v ELSE ev_value END, 6) AS ev_value, CASE WHEN hit THEN n ELSE ev_n END AS ev_n FROM d, m""")
def corrupt_value_masking(spark: SparkSession, d: str) -> DataFrame:
    fills = medians(customer_frame(spark, d).df.where("train"), ["ev_value", "ev_n"])
    out = corrupt.mask_values(imputed_customers(spark, d), "c_custkey", {"ev_value:missing": (1, fills)}, 0.5, 0, SEED)
    return out.select("c_custkey", F.col("ev_value:missing").alias("miss"), r6("ev_value").alias("ev_value"), "ev_n")


@query("WITH " + CUST_SQL + ", q AS (SELECT quantile_cont(bal, 0.5) AS qb, quantile_cont(ev_value, 0.5) AS qe FROM imp WHERE train) SELECT c_custkey, miss, round(CASE WHEN " + _u("median_masking", "bal", "c_custkey") + " < 0.3 THEN qb ELSE bal END, 6) AS bal, round(CASE WHEN miss = 0 AND " + _u("median_masking", "ev_value", "c_custkey") + " < 0.3 THEN qe ELSE ev_value END, 6) AS ev_value FROM imp, q")
def corrupt_median_masking(spark: SparkSession, d: str) -> DataFrame:
    df = imputed_customers(spark, d)
    middle = medians(df.where("train"), ["bal", "ev_value"])
    flag = df.withColumn("available", 1 - F.col("ev_value:missing"))
    out = corrupt.mask_medians(flag, "c_custkey", middle, 0.3, 0, SEED, {"ev_value": "available"})
    return out.select("c_custkey", F.col("ev_value:missing").alias("miss"), r6("bal").alias("bal"), r6("ev_value").alias("ev_value"))


@query('SELECT * FROM (VALUES (\'not 0 or 1\', 0::BIGINT), (\'two of a group\', 0::BIGINT), (\'off without fill\', 0::BIGINT)) t("check", n)')
def corrupt_structure_check(spark: SparkSession, d: str) -> DataFrame:
    fills = medians(customer_frame(spark, d).df.where("train"), ["ev_value", "ev_n"])
    seg = F.col("c_mktsegment")
    df = imputed_customers(spark, d).withColumns({"seg_A": (seg == "BUILDING").cast("int"), "seg_B": (seg == "MACHINERY").cast("int")})
    units = {"ev_value:missing": (1, fills)}
    dirty = corrupt.mask_values(df, "c_custkey", units, 0.6, 1, SEED)
    dirty = corrupt.redraw(dirty, "c_custkey", {}, {"seg": [("seg_A", 0.2), ("seg_B", 0.3)]}, 0.6, 1, SEED)
    return corrupt.violations(df, dirty, "c_custkey", ["seg_A", "seg_B", "ev_value:missing"], {"seg": ["seg_A", "seg_B"]}, units)


@query("WITH {frame:line}, " + LINE_FLAGS_SQL + """ SELECT feature, sum((v = 1)::INTEGER)::BIGINT AS eligible, sum((v = 1 AND u < 0.3)::INTEGER)::BIGINT AS selected, sum((v = 1 AND u < 0.3)::INTEGER)::BIGINT AS changed FROM (
SELECT 'rf_A' AS feature, rf_A AS v, """ + _u("under_recording", "rf_A") + " AS u FROM fl UNION ALL SELECT 'ls_F', ls_F, " + _u("under_recording", "ls_F") + " FROM fl) GROUP BY 1")
def corrupt_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    df = flagged_lines(spark, d)
    flags = ["rf_A", "ls_F"]
    dirty = corrupt.under_record(df, "rid", flags, 0.3, 0, SEED)
    hits = {c: corrupt.selected(SEED, "under_recording", 0, c, "rid", 0.3) for c in flags}
    return corrupt.changes(df, dirty, "rid", flags, hits, {c: F.col(f"_old_{c}") == 1 for c in flags})


@query("WITH {frame:line}, l(level_index, level) AS (VALUES (0, 0.2), (1, 0.6)), r(repetition) AS (VALUES (0), (1)), sd AS (SELECT stddev_samp(score) AS s FROM line WHERE train), d AS (SELECT level_index, level, repetition, label, score, " + _u("noise", "score", "rid", "repetition") + """ AS u FROM line, l, r),
preds AS (SELECT level_index || '-' || repetition AS k, label AS y, floor((score + level * s * {probit:greatest(u, 1e-12)}) * 50) AS p, 1.0 AS w FROM d, sd), """ + AUC_SQL.replace("{k}", "k") + " SELECT split_part(k, '-', 1)::INTEGER AS level_index, split_part(k, '-', 2)::INTEGER AS repetition, round(roc_auc, 4) AS roc_auc, round(pr_auc, 4) AS pr_auc FROM a")
def corrupt_score_bank(spark: SparkSession, d: str) -> DataFrame:
    df = line_frame(spark, d).df.select("rid", "label", "score", "train")
    sd = df.where("train").agg(F.stddev_samp("score")).first()[0]
    copies = corrupt.bank(df, [0.2, 0.6], 2)
    dirty = corrupt.gaussian(copies, "rid", {"score": sd}, F.col("level"), F.col("repetition"), SEED).withColumn("score", F.floor(F.col("score") * 50))
    out = metrics.rank_metrics(dirty, ["level_index", "repetition"], "label", "score")
    return out.select("level_index", "repetition", F.round("roc_auc", 4).alias("roc_auc"), F.round("pr_auc", 4).alias("pr_auc"))


@query("SELECT 'rf' AS prefix, 0::BIGINT AS n UNION ALL SELECT 'seg', 0 UNION ALL SELECT 'broken', (SELECT count(*) FROM customer)")
def corrupt_exhaustive_check(spark: SparkSession, d: str) -> DataFrame:
    """Groups of which each clean row has a member keep one under re-draws; taking all of them away is counted."""
    lines = flagged_lines(spark, d)
    groups = {"rf": ["rf_A", "rf_N", "rf_R"]}
    shares = lines.agg(*[F.avg(c).alias(c) for c in groups["rf"]]).first()
    dirty = corrupt.redraw(lines, "rid", {}, {"rf": [(c, shares[c]) for c in groups["rf"]]}, 0.5, 0, SEED)
    corrupt.check_structure(lines, dirty, "rid", groups["rf"], groups, {})
    seg = F.col("c_mktsegment")
    customers = customer_frame(spark, d).df.select("c_custkey", (seg == "BUILDING").cast("int").alias("seg_A"), F.lit(1).alias("all_A"), F.lit(0).alias("all_B"))
    gone = customers.withColumn("all_A", F.lit(0))
    more = corrupt.exhaustive_breaks(customers, gone, "c_custkey", {"seg": ["seg_A"], "broken": ["all_A", "all_B"]})
    return corrupt.exhaustive_breaks(lines, dirty, "rid", groups).unionByName(more)


@query("WITH " + CUST_SQL + ", s AS (SELECT stddev_samp(ev_value) AS sd FROM imp WHERE train) SELECT c_custkey, level, round(CASE level WHEN 0 THEN ev_value ELSE ev_value + level * sd * {probit:greatest(" + _u("noise", "ev_value", "c_custkey") + ", 1e-12)} END, 6) AS ev_value FROM imp, s, (VALUES (0.0::DOUBLE), (0.4::DOUBLE)) l(level)")
def corrupt_legacy_noise(spark: SparkSession, d: str) -> DataFrame:
    """Noise on a value whether it is available or not; at level 0 the rows as they are."""
    df = imputed_customers(spark, d)
    sd = {"ev_value": df.where("train").agg(F.stddev_samp("ev_value")).first()[0]}
    made = [corrupt.legacy_noise(df, "c_custkey", sd, x, 0, SEED).select("c_custkey", F.lit(x).alias("level"), r6("ev_value").alias("ev_value")) for x in (0.0, 0.4)]
    return made[0].unionByName(made[1])


@query("WITH {frame:line}, " + LINE_FLAGS_SQL + ", s AS (SELECT avg(rf_A) AS a, avg(rf_N) AS n FROM fl WHERE NOT train), d AS (SELECT CASE WHEN " + _u("redraw", "rf_A") + " < 0.3 THEN (" + _u("redraw value", "rf_A") + " < a)::INTEGER ELSE rf_A END AS rf_A, CASE WHEN " + _u("redraw", "rf_N") + " < 0.3 THEN (" + _u("redraw value", "rf_N") + " < n)::INTEGER ELSE rf_N END AS rf_N FROM fl, s WHERE NOT train) SELECT rf_A, rf_N, count(*) AS n FROM d GROUP BY 1, 2")
def corrupt_legacy_redraw(spark: SparkSession, d: str) -> DataFrame:
    """Every cell by itself, by the share of the corrupted rows: members of a group may come together."""
    out = corrupt.legacy_redraw(flagged_lines(spark, d).where("NOT train"), "rid", ["rf_A", "rf_N"], 0.3, None, 0, SEED)
    return out.groupBy("rf_A", "rf_N").agg(F.count(F.lit(1)).alias("n"))


GRID_NOISE, GRID_SHIFT = [0.0, 0.5, 1.0], [-1.0, 0.0, 1.0]
LEGACY_SQL = "{frame:line}, n(noise) AS (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)), h(shift) AS (VALUES (-1.0::DOUBLE), (0.0::DOUBLE), (1.0::DOUBLE)), f AS (SELECT avg(price) AS m, stddev_pop(price) AS s FROM line WHERE train), sd AS (SELECT stddev_samp(score) AS s FROM line WHERE train), z AS (SELECT rid, label, score, least(greatest((price - f.m) / f.s, -2), 2) AS z, " + _u("noise", "score") + " AS u FROM line, f WHERE NOT train), w0 AS (SELECT rid, shift, exp(shift * z) AS w, label FROM z, h), w AS (SELECT rid, shift, w * count(*) OVER (PARTITION BY shift, label) / sum(w) OVER (PARTITION BY shift, label) AS w FROM w0), preds AS (SELECT noise || '|' || shift AS k, label AS y, floor((score + noise * sd.s * {probit:greatest(u, 1e-12)}) * 50) AS p, w FROM z JOIN w USING (rid), n, sd), "


@query("WITH " + LEGACY_SQL + AUC_SQL.replace("{k}", "k") + " SELECT split_part(k, '|', 1)::DOUBLE AS noise, split_part(k, '|', 2)::DOUBLE AS shift, round(roc_auc, 4) AS roc_auc FROM a")
def grid_legacy(spark: SparkSession, d: str) -> DataFrame:
    """The grid of noise on the score and shifts along the price: rows are corrupted once for a level and scored under every
    weighting."""
    df = line_frame(spark, d).df
    train = df.where("train")
    fit, sd = train.agg(F.avg("price"), F.stddev_pop("price")).first(), train.agg(F.stddev_samp("score")).first()[0]
    z = F.least(F.greatest((F.col("price") - F.lit(fit[0])) / F.lit(fit[1]), F.lit(-2.0)), F.lit(2.0))
    test = df.where("NOT train").select("rid", "label", "score", z.alias("z"))
    weights = test.select("rid", "label", "z", F.explode(F.array(*[F.lit(x) for x in GRID_SHIFT])).alias("shift")).withColumn("w", F.exp(F.col("shift") * F.col("z")))
    weights = metrics.class_normalised(weights, ["shift"], "label", "w").select("rid", "shift", "w")
    noisy = test.select("rid", "label", "score", F.explode(F.array(*[F.lit(x) for x in GRID_NOISE])).alias("noise"))
    noisy = corrupt.gaussian(noisy, "rid", {"score": sd}, F.col("noise"), 0, SEED).withColumn("score", F.floor(F.col("score") * 50))
    out = metrics.rank_metrics(noisy.join(weights, "rid"), ["noise", "shift"], "label", "score", "w")
    return out.select("noise", "shift", F.round("roc_auc", 4).alias("roc_auc"))


#: Every corruption of the documents' test rows, cell by cell, at every level: what one pass over differences must add up to.
_LEVELS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
BANK_SQL = FACTS_SQL + f""", lv(level) AS (SELECT unnest({_LEVELS})::DOUBLE), rp(repetition) AS (SELECT range::INTEGER FROM range(10)),
tl AS MATERIALIZED (SELECT doc_id, name, v FROM (SELECT * FROM mxa WHERE NOT train) UNPIVOT (v FOR name IN (n_chars, n_sp, n_nl, avg_w, lang_de, lang_en, lang_es, lang_fr, long_lines, "dig:missing", dig))),
med AS (SELECT name, quantile_cont(v, 0.5) AS middle FROM l GROUP BY 1),
gone AS (SELECT doc_id, value AS name FROM pairs JOIN tl ON tl.name = flag AND v = off),
cell AS MATERIALIZED (
  SELECT f.family, repetition, doc_id, tl.name AS unit, NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = tl.doc_id AND g.name = tl.name) AS eligible, CASE f.family WHEN 'noise' THEN 0.0 ELSE {{u:concat_ws('|', {SEED}, 'median_masking', repetition, tl.name, doc_id)}} END AS u, f.family = 'noise' OR v <> middle AS changes
  FROM tl JOIN k USING (name) JOIN med USING (name), rp, (VALUES ('noise'), ('median_masking')) f(family) WHERE kind = 'continuous'
  UNION ALL SELECT 'under_recording', repetition, doc_id, name, v = 1, {{u:concat_ws('|', {SEED}, 'under_recording', repetition, name, doc_id)}}, true FROM tl JOIN free USING (name), rp WHERE share < 0.5
  UNION ALL SELECT 'masking', repetition, doc_id, name, v <> off, {{u:concat_ws('|', {SEED}, 'masking', repetition, name, doc_id)}}, true FROM tl JOIN (SELECT DISTINCT flag AS name, off FROM pairs) USING (name), rp),
unit AS (SELECT name AS unit, name, share, 0.0 AS below, false AS rest FROM free UNION ALL SELECT prefix, name, share, sum(share) OVER (PARTITION BY prefix ORDER BY name) - share, name = max(name) OVER (PARTITION BY prefix) AND sum(share) OVER (PARTITION BY prefix) >= 1 - 1e-12 FROM pre JOIN grp USING (prefix) JOIN k USING (name)),
re AS MATERIALIZED (SELECT repetition, doc_id, unit, name, v, u, (w >= below AND (rest OR w < below + share))::DOUBLE AS new FROM (
  SELECT *, {{u:concat_ws('|', {SEED}, 'redraw', repetition, unit, doc_id)}} AS u, {{u:concat_ws('|', {SEED}, 'redraw value', repetition, unit, doc_id)}} AS w FROM tl JOIN unit USING (name), rp)),
every AS (SELECT * FROM cell UNION ALL SELECT 'redraw', repetition, doc_id, unit, true, min(u), bool_or(new <> v) FROM re GROUP BY repetition, doc_id, unit),
sums AS (SELECT family, level, repetition, count(*) FILTER (WHERE eligible) AS eligible, count(*) FILTER (WHERE eligible AND u < level) AS selected, count(*) FILTER (WHERE eligible AND u < level AND changes) AS changed FROM every, lv GROUP BY 1, 2, 3),
struck AS (SELECT family, repetition, doc_id, unit AS name, u, CASE family WHEN 'masking' THEN (SELECT min(off) FROM pairs WHERE flag = unit) ELSE 0 END::DOUBLE AS new FROM cell WHERE family IN ('under_recording', 'masking') AND eligible
  UNION ALL SELECT 'redraw', repetition, doc_id, name, u, new FROM re),
bin AS (SELECT f.family, level, rp.repetition, tl.doc_id, tl.name, tl.v AS was, CASE WHEN s.u < level THEN s.new ELSE tl.v END AS v FROM tl JOIN k USING (name), rp, lv, (VALUES ('redraw'), ('under_recording'), ('masking')) f(family) LEFT JOIN struck s ON s.family = f.family AND s.repetition = rp.repetition AND s.doc_id = tl.doc_id AND s.name = tl.name WHERE kind = 'binary'),
made AS (SELECT p.family, p.level, p.repetition, count(*) AS n, count(DISTINCT p.doc_id) AS n_rows FROM (SELECT * FROM b2 WHERE seen = 0 AND expected >= 5) c JOIN bin p ON p.name = c.a AND p.v = c.x JOIN bin q ON q.name = c.b AND q.v = c.y AND q.doc_id = p.doc_id AND q.family = p.family AND q.level = p.level AND q.repetition = p.repetition WHERE NOT (p.was = c.x AND q.was = c.y) GROUP BY 1, 2, 3)"""


@query("WITH " + BANK_SQL + " SELECT family, level, repetition, eligible, selected, changed, coalesce(n, 0) AS unseen_combinations, coalesce(n_rows, 0) AS rows_with_unseen_combination FROM sums LEFT JOIN made USING (family, level, repetition)")
def corruption_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Cells that each corruption of the documents' test rows could strike, strikes and changes, and combinations that it
    makes, at ten levels and ten repetitions."""
    from ..operators.level_counts import level_counts
    from ..operators.schema import infer
    from ..plans.frames import mixed_frame

    frame = mixed_frame(spark, d)
    train = frame.part(True).df
    profile = infer(train, frame.features)
    return level_counts(frame.part(False).df, frame.row_id, profile, medians(train, profile.of("continuous")), _LEVELS, 10, SEED)


GRID_PACKAGES = {"a": [("qty", 25.0, 14.0, 0.8), ("price", 50000.0, 28000.0, 1.6), ("(intercept)", 0.0, 1.0, 0.1)], "b": [("price", 50000.0, 28000.0, 0.7), ("disc", 0.05, 0.03, -0.9), ("(intercept)", 0.0, 1.0, -0.2)]}
GRID_MODELS_SQL = """{frame:line}, f AS (SELECT avg(tax) AS m, stddev_pop(tax) AS s, stddev_samp(qty) AS sq, stddev_samp(price) AS sp, stddev_samp(disc) AS sd FROM line WHERE train),
z AS (SELECT rid, label AS y, qty, price, disc, least(greatest((tax - m) / s, -2), 2) AS z, sq * {probit:greatest(""" + _u("noise", "qty") + """, 1e-12)} AS nq, sp * {probit:greatest(""" + _u("noise", "price") + """, 1e-12)} AS np, sd * {probit:greatest(""" + _u("noise", "disc") + """, 1e-12)} AS nd FROM line, f WHERE NOT train),
n(noise) AS (SELECT range / 10 FROM range(11)), h(shift) AS (SELECT (range - 5) / 5 FROM range(11)),
d AS (SELECT rid, y, z, noise, qty + noise * nq AS qty, price + noise * np AS price, disc + noise * nd AS disc FROM z, n),
m AS (SELECT rid, y, z, noise, 'a' AS model, 1 / (1 + exp(-(0.8 * (qty - 25) / 14 + 1.6 * (price - 50000) / 28000 + 0.1))) AS p FROM d UNION ALL SELECT rid, y, z, noise, 'b', 1 / (1 + exp(-(0.7 * (price - 50000) / 28000 - 0.9 * (disc - 0.05) / 0.03 - 0.2))) FROM d),
c AS (SELECT shift, y AS cls, avg(exp(shift * z)) AS mean FROM z, h GROUP BY 1, 2),
preds AS (SELECT model || '|' || noise || '|' || h.shift AS k, y, p, exp(h.shift * z) / mean AS w FROM m, h JOIN c ON c.shift = h.shift WHERE c.cls = m.y), """


@query("WITH " + GRID_MODELS_SQL + AUC_SQL.replace("{k}", "k").replace("c AS (", "cc AS (").replace("FROM c GROUP", "FROM cc GROUP") + " SELECT split_part(k, '|', 1) AS model, split_part(k, '|', 2)::DOUBLE AS noise, split_part(k, '|', 3)::DOUBLE AS shift, round(roc_auc, 4) AS roc_auc, round(pr_auc, 4) AS pr_auc FROM a")
def grid_models(spark: SparkSession, d: str) -> DataFrame:
    """Two models of lines at eleven levels of noise and eleven shifts along the tax."""
    from ..plans.legacy import stress_grid

    df = line_frame(spark, d).df
    fit = df.where("train").agg(F.avg("tax"), F.stddev_pop("tax"), *[F.stddev_samp(c).alias(c) for c in ("qty", "price", "disc")]).first()
    axis = (F.col("tax") - F.lit(fit[0])) / F.lit(fit[1])
    out = stress_grid(df.where("NOT train"), "rid", "label", GRID_PACKAGES, {c: fit[c] for c in ("qty", "price", "disc")}, axis, seed=SEED)
    return out.select("model", "noise", "shift", F.round("roc_auc", 4).alias("roc_auc"), F.round("pr_auc", 4).alias("pr_auc"))
