"""The tables that figures draw: projections of scores by family, severity, method and seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import metrics, pareto, stats
from ..plans.frames import documents_frame
from .metrics import COEF, COEF_SQL, CORR_SQL, LONG_DOC
from .models import KNEE_SQL, SCORES_SQL, _points, _scores
from .registry import query

#: Scores with a severity: a fifth of an order's repetition.
LEVELS_SQL = SCORES_SQL + ", lv AS (SELECT *, (repetition + 1) / 5 AS severity FROM sc)"


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).withColumn("severity", (F.col("repetition") + 1) / 5)


@query("WITH " + KNEE_SQL + ", k AS (SELECT seed, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY dist DESC, ordinal) AS r FROM d) WHERE r = 1) SELECT p.seed, p.ordinal, round(p.auc, 6) AS auc, round(p.sign, 6) AS sign, f.ordinal IS NOT NULL AS front, k.ordinal IS NOT NULL AS knee FROM pts p LEFT JOIN f ON f.seed = p.seed AND f.ordinal = p.ordinal LEFT JOIN k ON k.seed = p.seed AND k.ordinal = p.ordinal")
def figure_pareto_front(spark: SparkSession, d: str) -> DataFrame:
    """Every solution, whether it is on its seed's front, and the one that is chosen."""
    pts = _points(spark, d).select("seed", "ordinal", "auc", "sign")
    front = pareto.pareto_front(pts, ["seed"])
    knee = pareto.knee(front, ["seed"]).select("seed", "ordinal", F.lit(True).alias("knee"))
    out = pts.join(front.select("seed", "ordinal", F.lit(True).alias("front")), ["seed", "ordinal"], "left").join(knee, ["seed", "ordinal"], "left")
    return out.select("seed", "ordinal", r6("auc").alias("auc"), r6("sign").alias("sign"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("front", "knee")])


CURVE_SQL = "SELECT severity, method, round(avg(v), 9) AS mean, round(coalesce(stddev_samp(v), 0), 9) AS sd, count(*) AS n FROM (SELECT severity, method, seed, {f}(score) AS v FROM lv WHERE {w} GROUP BY 1, 2, 3) GROUP BY 1, 2"


def _curve(df: DataFrame, of) -> DataFrame:
    runs = df.groupBy("severity", "method", "seed").agg(of("score").alias("v"))
    return runs.groupBy("severity", "method").agg(F.round(F.avg("v"), 9).alias("mean"), F.round(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), 9).alias("sd"), F.count(F.lit(1)).alias("n"))


@query("WITH " + LEVELS_SQL + " " + CURVE_SQL.format(f="min", w="family = '1-URGENT'"))
def figure_population_curves(spark: SparkSession, d: str) -> DataFrame:
    """The worst scenario of each run by severity: a mean and a band for each method."""
    return _curve(_levels(spark, d).where("family = '1-URGENT'"), F.min)


@query("WITH " + LEVELS_SQL + " " + CURVE_SQL.format(f="avg", w="family = '2-HIGH'"))
def figure_dependence_summary(spark: SparkSession, d: str) -> DataFrame:
    return _curve(_levels(spark, d).where("family = '2-HIGH'"), F.avg)


@query("WITH " + LEVELS_SQL + " SELECT family, severity, method, round(avg(v), 9) AS mean, count(*) AS n FROM (SELECT family, severity, method, seed, avg(score) AS v FROM lv GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3")
def figure_corruption_curves(spark: SparkSession, d: str) -> DataFrame:
    out = stats.family_summary(_levels(spark, d), ["family", "severity", "method", "seed"], ["family", "severity", "method"], "score")
    return out.select("family", "severity", "method", F.round("mean", 9).alias("mean"), F.col("n_runs").alias("n"))


@query("WITH " + LEVELS_SQL + ", m AS (SELECT family, method, avg(score) AS v FROM lv WHERE abs(severity - 0.6) < 1e-9 GROUP BY 1, 2) SELECT family, round(max(v) FILTER (WHERE method = 'two'), 6) AS two, round(max(v) FILTER (WHERE method = 'one'), 6) AS one, round(max(v) FILTER (WHERE method = 'step'), 6) AS step, round(max(v) FILTER (WHERE method = 'all'), 6) AS \"all\" FROM m GROUP BY 1")
def figure_overview(spark: SparkSession, d: str) -> DataFrame:
    """Every family at its headline severity, a column for each method."""
    out = stats.pivoted(_levels(spark, d).where("abs(severity - 0.6) < 1e-9"), ["family"], "method", ["two", "one", "step", "all"], "score")
    return out.select("family", *[r6(c).alias(c) for c in ("two", "one", "step", "all")])


@query("WITH " + SCORES_SQL + " SELECT family, seed, round(avg(score) FILTER (WHERE method = 'two'), 6) AS consistency, round(avg(score) FILTER (WHERE method = 'one'), 6) AS change FROM sc WHERE seed IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT method) = 2")
def figure_sign_vs_degradation(spark: SparkSession, d: str) -> DataFrame:
    """The points behind the analysis of signs: one for a run and family."""
    out = stats.pivoted(_scores(spark, d).where("seed IS NOT NULL"), ["family", "seed"], "method", ["two", "one"], "score").where("two IS NOT NULL AND one IS NOT NULL")
    return out.select("family", "seed", r6("two").alias("consistency"), r6("one").alias("change"))


@query("WITH " + LEVELS_SQL + " SELECT severity, round(avg(score) FILTER (WHERE family = '3-MEDIUM'), 6) AS continuous, round(avg(score) FILTER (WHERE family = '5-LOW'), 6) AS flags FROM lv WHERE family IN ('3-MEDIUM', '5-LOW') GROUP BY 1")
def figure_noise_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The same levels of noise on continuous inputs and of re-draws of flags."""
    out = stats.pivoted(_levels(spark, d), ["severity"], "family", ["3-MEDIUM", "5-LOW"], "score")
    return out.select("severity", r6("`3-MEDIUM`").alias("continuous"), r6("`5-LOW`").alias("flags"))


@query("SELECT model, noise, shift, round(v / clean, 6) AS retained FROM (SELECT *, max(CASE WHEN noise = 0 AND shift = 0 THEN v END) OVER (PARTITION BY model) AS clean FROM (SELECT l_returnflag AS model, (l_linenumber - 1) * 0.25 AS noise, floor(l_quantity / 10) * 0.5 AS shift, avg(1 - l_discount) AS v FROM lineitem GROUP BY ALL))")
def figure_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """What each cell of the grid retains of the clean cell's score."""
    from .models import _grid

    clean = F.max(F.when((F.col("noise") == 0) & (F.col("shift") == 0), F.col("v"))).over(Window.partitionBy("model"))
    return _grid(spark, d).select("model", "noise", "shift", r6(F.col("v") / clean).alias("retained"))


@query("WITH {frame:doc}, s AS (SELECT round(avg_w, 1) AS threshold, label, count(*) AS n FROM doc GROUP BY 1, 2), c AS (SELECT threshold, sum(n) FILTER (WHERE label = 1) AS p, sum(n) FILTER (WHERE label = 0) AS q FROM s GROUP BY 1) SELECT threshold, round(sum(coalesce(p, 0)) OVER (ORDER BY threshold DESC) / sum(p) OVER (), 6) AS sensitivity, round(coalesce(sum(coalesce(q, 0)) OVER (ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(q) OVER (), 6) AS specificity FROM c")
def figure_threshold_curve(spark: SparkSession, d: str) -> DataFrame:
    """Sensitivity and specificity at each threshold, rounded to a tenth."""
    df = documents_frame(spark, d).df.select(F.round("avg_w", 1).alias("p"), F.col("label").alias("y"))
    out = metrics.prefix_sums(metrics.score_groups(df, []), [], "p", {"_pos_below": "pos", "_neg_below": "neg"}, {"_pos": "pos", "_neg": "neg"})
    return out.select(F.col("p").alias("threshold"), r6(1 - F.col("_pos_below") / F.col("_pos")).alias("sensitivity"), r6(F.col("_neg_below") / F.col("_neg")).alias("specificity"))


@query("SELECT p_brand AS method, min(p_size) AS least, quantile_cont(p_size, 0.25) AS low, quantile_cont(p_size, 0.5) AS middle, quantile_cont(p_size, 0.75) AS high, max(p_size) AS most FROM part GROUP BY 1")
def figure_feature_counts(spark: SparkSession, d: str) -> DataFrame:
    """The boxes of a box plot: a brand stands for a method, a part's size for a number of features."""
    from ..sources.tables import table

    q = lambda x: F.percentile("p_size", F.lit(x))
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("method")).agg(F.min("p_size").alias("least"), q(0.25).alias("low"), q(0.5).alias("middle"), q(0.75).alias("high"), F.max("p_size").alias("most"))


@query("WITH {frame:doc}, " + LONG_DOC + ", " + CORR_SQL + ", " + COEF_SQL + " SELECT model, feature, coef::DOUBLE AS coef, round(corr, 6) + 0.0 AS corr, coef * corr > 1e-12 AS consistent FROM coef JOIN corr USING (feature)")
def figure_sign_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Each coefficient beside its feature's correlation with the label."""
    frame = documents_frame(spark, d)
    corr = metrics.marginal_correlations(frame.df, frame.features, frame.label)
    coef = spark.createDataFrame(COEF, "model string, feature string, coef double")
    return coef.join(corr, "feature").select("model", "feature", "coef", r6("corr").alias("corr"), (F.col("coef") * F.col("corr") > 1e-12).alias("consistent"))


@query("WITH " + SCORES_SQL + ", m AS (SELECT method, seed, avg(score) FILTER (WHERE family IN ('1-URGENT', '2-HIGH')) AS inside, avg(score) FILTER (WHERE family NOT IN ('1-URGENT', '2-HIGH')) AS outside FROM sc GROUP BY 1, 2) SELECT method, seed, round(inside, 6) AS inside, round(outside, 6) AS outside, round(inside - outside, 6) + 0.0 AS drop FROM m")
def figure_domains(spark: SparkSession, d: str) -> DataFrame:
    """Each run in the domain, out of it, and what it loses."""
    home = F.col("family").isin("1-URGENT", "2-HIGH")
    out = _scores(spark, d).groupBy("method", "seed").agg(F.avg(F.when(home, F.col("score"))).alias("inside"), F.avg(F.when(~home, F.col("score"))).alias("outside"))
    return out.select("method", "seed", r6("inside").alias("inside"), r6("outside").alias("outside"), r6(F.col("inside") - F.col("outside")).alias("drop"))


@query("WITH " + LEVELS_SQL + " SELECT family, severity, row_number() OVER (ORDER BY family, CASE WHEN family = '1-URGENT' THEN -severity ELSE severity END)::INTEGER AS place FROM (SELECT DISTINCT family, severity FROM lv)")
def report_severity_order(spark: SparkSession, d: str) -> DataFrame:
    """Families and severities in the order of reports: the first family's mildest level is its highest."""
    rows = _levels(spark, d).select("family", "severity").distinct()
    ranked = stats.severity_rank(rows, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), "1-URGENT")
    w = Window.orderBy("family_rank", "severity_rank")  # a row for a family and level
    return ranked.select("family", "severity", F.row_number().over(w).alias("place"))


@query("WITH u AS (SELECT 'dependence_' || c_mktsegment AS family, c_nationkey AS unit, count(*) AS n, count(*) > 11 AS in_cohort FROM customer GROUP BY 1, 2), s AS (SELECT family FROM u WHERE in_cohort GROUP BY 1 HAVING count(*) >= 12) SELECT family, unit, n FROM u JOIN s USING (family)")
def report_small_cohorts(spark: SparkSession, d: str) -> DataFrame:
    """Units of the families whose cohort has twelve or more: a segment stands for a family, and a nation with more than
    eleven of its customers for a unit of its cohort."""
    from ..sources.tables import table

    units = table(spark, d, "customer").groupBy(F.concat(F.lit("dependence_"), "c_mktsegment").alias("family"), F.col("c_nationkey").alias("unit")).agg(F.count(F.lit(1)).alias("n"))
    units = units.withColumn("in_cohort", F.col("n") > 11)
    small = stats.small_cohorts(units, 12).where("excluded").select("family")
    return units.join(F.broadcast(small), "family", "left_anti").select("family", "unit", "n")


@query("WITH " + SCORES_SQL + ", t AS (SELECT family, method, round(avg(score), 6) AS mean FROM sc WHERE method <> 'two' GROUP BY 1, 2), i AS (SELECT family, method, quantile_cont(score, 0.025) AS low, quantile_cont(score, 0.975) AS high, count(*) AS n_samples FROM sc WHERE method = 'one' GROUP BY 1, 2) SELECT t.family, t.method, mean, round(low, 6) AS low, round(high, 6) AS high, n_samples FROM t LEFT JOIN i USING (family, method)")
def stats_with_intervals(spark: SparkSession, d: str) -> DataFrame:
    sc = _scores(spark, d)
    tests = sc.where("method <> 'two'").groupBy("family", "method").agg(r6(F.avg("score")).alias("mean"))
    intervals = stats.percentile_interval(sc.where("method = 'one'"), ["family", "method"], "score")
    out = stats.with_intervals(tests, intervals, ["family", "method"])
    return out.select("family", "method", "mean", r6("low").alias("low"), r6("high").alias("high"), "n_samples")


@query("WITH pts AS (SELECT p_brand AS seed, p_partkey AS ordinal, substr(p_name, 1, 6) AS mask, p_size AS auc FROM part) SELECT seed, mask, min(ordinal) AS ordinal, arg_min(auc, ordinal) AS auc FROM pts GROUP BY 1, 2")
def search_distinct_masks(spark: SparkSession, d: str) -> DataFrame:
    """Each mask of a seed once, as its lowest ordinal has it."""
    from ..plans.run import distinct_masks
    from ..sources.tables import table

    pts = table(spark, d, "part").select(F.col("p_brand").alias("seed"), F.col("p_partkey").alias("ordinal"), F.substring("p_name", 1, 6).alias("mask"), F.col("p_size").alias("auc"))
    return distinct_masks(pts).select("seed", "mask", "ordinal", "auc")


@query("WITH " + KNEE_SQL + ", b AS (SELECT seed, arg_max(ordinal, struct_pack(a := auc, b := -ordinal)) AS a, arg_max(ordinal, struct_pack(a := sign, b := -ordinal)) AS s FROM f GROUP BY 1) SELECT seed, 'knee' AS rule, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY dist DESC, ordinal) AS k FROM d) WHERE k = 1 UNION ALL SELECT seed, 'max_auc', a FROM b UNION ALL SELECT seed, 'max_sign', s FROM b")
def pareto_selection(spark: SparkSession, d: str) -> DataFrame:
    """The solution of each front by each rule."""
    front = pareto.pareto_front(_points(spark, d), ["seed"])
    made = [pareto.select_solution(front, ["seed"], rule).select("seed", F.lit(rule).alias("rule"), "ordinal") for rule in ("knee", "max_auc", "max_sign")]
    return made[0].unionByName(made[1]).unionByName(made[2])
