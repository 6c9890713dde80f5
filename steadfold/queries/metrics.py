"""Queries of the metric operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import metrics
from ..operators.prep import hashed_split
from ..plans.frames import DOC_NUMBERS, documents_frame, line_frame
from .registry import query

AUC_SQL = """g AS (SELECT {k}, p, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS pos, sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS neg FROM preds GROUP BY {k}, p),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {k} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
  sum(pos) OVER (PARTITION BY {k} ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(neg) OVER (PARTITION BY {k} ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS fp FROM g),
a AS (SELECT {k}, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS roc_auc, sum(pos * tp / nullif(tp + fp, 0)) / nullif(sum(pos), 0) AS pr_auc FROM c GROUP BY {k})"""
LONG_DOC = "preds AS (SELECT label AS y, name AS feature, v AS p, 1.0 AS w FROM (SELECT label, n_chars, n_sp, n_nl, n_dig, avg_w FROM doc) UNPIVOT (v FOR name IN (n_chars, n_sp, n_nl, n_dig, avg_w)))"
CORR_SQL = "corr AS (SELECT feature, coalesce(covar_pop(p, y) / nullif(stddev_pop(p) * stddev_pop(y), 0), 0) AS corr FROM preds GROUP BY feature)"


@query("WITH {frame:doc}, " + LONG_DOC + ", " + CORR_SQL + " SELECT feature, round(corr, 6) + 0.0 AS corr FROM corr")
def metric_marginal_corr(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: the correlation of every feature with the label, in one pass over documents and labels."""
    frame = documents_frame(spark, d)
    return metrics.marginal_correlations(frame.df, frame.features, frame.label).select("feature", r6("corr").alias("corr"))


@query("WITH {frame:line}, preds AS (SELECT 1 AS k, label AS y, score AS p, w FROM line), " + AUC_SQL.replace("{k}", "k") + " SELECT round(roc_auc, 6) AS roc_auc FROM a")
def metric_roc_auc_weighted(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rank_metrics(line_frame(spark, d).df, [], "label", "score", "w").select(r6("roc_auc").alias("roc_auc"))


@query("WITH {frame:line}, preds AS (SELECT l_returnflag AS k, label AS y, score AS p, w FROM line), " + AUC_SQL.replace("{k}", "k") + " SELECT k AS l_returnflag, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc FROM a")
def metric_pr_auc_weighted(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.rank_metrics(line_frame(spark, d).df, ["l_returnflag"], "label", "score", "w")
    return out.select("l_returnflag", r6("pr_auc").alias("pr_auc"), r6("roc_auc").alias("roc_auc"))


@query("WITH {frame:doc}, " + LONG_DOC + ", " + AUC_SQL.replace("{k}", "feature") + " SELECT feature, round(roc_auc, 6) AS auc, round(greatest(roc_auc, 1 - roc_auc), 6) AS separation, round((SELECT avg((p <> 0)::INTEGER) FROM preds x WHERE x.feature = a.feature), 6) AS prevalence, (greatest(roc_auc, 1 - roc_auc) >= 0.8)::INTEGER AS flagged FROM a")
def metric_auc_by_feature(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.feature_screen(documents_frame(spark, d).df, DOC_NUMBERS, "label")
    return out.select("feature", *[r6(c).alias(c) for c in ("auc", "separation", "prevalence")], "flagged")


@query("WITH {frame:line} SELECT l_returnflag, round(sum(w) ** 2 / sum(w * w), 4) AS ess, round(sum(w) ** 2 / sum(w * w) / count(*), 6) AS ess_fraction FROM line GROUP BY 1")
def metric_ess(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ess(line_frame(spark, d).df, ["l_returnflag"], "w").select("l_returnflag", F.round("ess", 4).alias("ess"), r6("ess_fraction").alias("ess_fraction"))


@query("WITH {frame:line} SELECT l_linestatus, round(coalesce(sum(w) FILTER (WHERE label = 0) ** 2 / sum(w * w) FILTER (WHERE label = 0), 0), 4) AS ess_negatives, round(coalesce(sum(w) FILTER (WHERE label = 1) ** 2 / sum(w * w) FILTER (WHERE label = 1), 0), 4) AS ess_positives FROM line GROUP BY 1")
def metric_ess_by_class(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ess_by_class(line_frame(spark, d).df, ["l_linestatus"], "label", "w").select("l_linestatus", F.round("ess_negatives", 4).alias("ess_negatives"), F.round("ess_positives", 4).alias("ess_positives"))


@query("WITH {frame:line} SELECT l_returnflag, label, count(*) AS n, round(sum(v), 4) AS total, round(max(v), 6) AS most FROM (SELECT l_returnflag, label, w * count(*) OVER (PARTITION BY label) / sum(w) OVER (PARTITION BY label) AS v FROM line) GROUP BY 1, 2")
def metric_class_normalised_weights(spark: SparkSession, d: str) -> DataFrame:
    df = metrics.class_normalised(line_frame(spark, d).df, [], "label", "w")
    return df.groupBy("l_returnflag", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 4).alias("total"), r6(F.max("w")).alias("most"))


@query("WITH {frame:line}, z AS (SELECT avg(label) AS pi FROM line), preds AS (SELECT 1 AS k, label AS y, score AS p, CASE WHEN label = 1 THEN 0.2 / pi ELSE 0.8 / (1 - pi) END AS w FROM line, z), " + AUC_SQL.replace("{k}", "k") + " SELECT round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS calibrated_pr_auc FROM a")
def metric_calibrated_pr_auc(spark: SparkSession, d: str) -> DataFrame:
    df = metrics.calibration_weights(line_frame(spark, d).df.drop("w"), "label", 0.2)
    return metrics.rank_metrics(df, [], "label", "score", "w").select(r6("roc_auc").alias("roc_auc"), r6("pr_auc").alias("calibrated_pr_auc"))


@query("""WITH {frame:line}, s AS (SELECT l_returnflag, sum(w) AS n, sum(w * price) / sum(w) AS mx, sum(w * score) / sum(w) AS my FROM line GROUP BY 1)
SELECT l.l_returnflag, round(sum(w * (price - mx) * (score - my)) / sqrt(sum(w * (price - mx) ** 2) * sum(w * (score - my) ** 2)), 6) AS r FROM line l JOIN s USING (l_returnflag) GROUP BY 1""")
def metric_weighted_corr(spark: SparkSession, d: str) -> DataFrame:
    return metrics.weighted_pearson(line_frame(spark, d).df, ["l_returnflag"], "price", "score", "w").select("l_returnflag", r6("r").alias("r"))


@query("WITH {frame:line}, m AS (SELECT l_returnflag, sum(w * price) / sum(w) AS mw, avg(price) AS m, stddev_pop(price) AS s, sum(w * label) / sum(w) AS pw FROM line GROUP BY 1) SELECT l_returnflag, round((mw - m) / s, 6) + 0.0 AS mean_shift, round(sqrt(sum(w * (price - mw) ** 2) / sum(w)) / any_value(s), 6) AS sd_ratio, round(any_value(pw), 6) AS weighted_prevalence FROM line JOIN m USING (l_returnflag) GROUP BY l_returnflag, mw, m, s")
def metric_mean_shift_sd_ratio(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.weighted_shift(line_frame(spark, d).df, ["l_returnflag"], "price", "label", "w")
    return out.select("l_returnflag", *[r6(c).alias(c) for c in ("mean_shift", "sd_ratio", "weighted_prevalence")])


COEF = [("a", "n_chars", 0.5), ("a", "n_sp", -0.25), ("a", "avg_w", -1.0), ("b", "n_nl", 0.75), ("b", "n_dig", 0.0), ("b", "n_chars", -0.1)]
COEF_SQL = "coef(model, feature, coef) AS (VALUES " + ", ".join(f"('{m}', '{f}', {c})" for m, f, c in COEF) + ")"


@query("WITH {frame:doc}, " + LONG_DOC + ", " + CORR_SQL + ", " + COEF_SQL + """ SELECT model, count(*) AS n_features, (count(*) - sum(bad))::BIGINT AS n_consistent, sum(bad)::BIGINT AS n_inconsistent, round(1 - sum(bad) / count(*), 6) AS sign_consistency
FROM (SELECT model, (coef * corr < 0 OR abs(coef * corr) <= 1e-12)::INTEGER AS bad FROM coef JOIN corr USING (feature)) GROUP BY 1""")
def metric_sign_consistency(spark: SparkSession, d: str) -> DataFrame:
    frame = documents_frame(spark, d)
    corr = metrics.marginal_correlations(frame.df, frame.features, frame.label)
    coef = spark.createDataFrame(COEF, "model string, feature string, coef double")
    out = metrics.sign_consistency(coef, corr, ["model"])
    return out.select("model", "n_features", "n_consistent", "n_inconsistent", r6("sign_consistency").alias("sign_consistency"))


@query("""WITH {frame:doc}, o AS (SELECT lang, label, avg_w, row_number() OVER (PARTITION BY lang ORDER BY -avg_w, doc_id) - 1 AS i,
  coalesce(sum(label) OVER (PARTITION BY lang ORDER BY -avg_w, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(label) OVER (PARTITION BY lang) AS pos, count(*) OVER (PARTITION BY lang) AS n FROM doc),
s AS (SELECT lang, -avg_w AS p, i, coalesce((pos - below) / nullif(pos, 0), 0) AS sens, coalesce((i - below) / nullif(n - pos, 0), 0) AS spec FROM o)
SELECT lang, round(p, 6) AS threshold, round(sens, 6) AS sensitivity, round(spec, 6) AS specificity FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(abs(sens - spec), 12), i) AS k FROM s) WHERE k = 1""")
def metric_balanced_threshold(spark: SparkSession, d: str) -> DataFrame:
    df = documents_frame(spark, d).df.withColumn("p", -F.col("avg_w"))
    out = metrics.balanced_threshold(df, ["lang"], "doc_id", "label")
    return out.select("lang", *[r6(c).alias(c) for c in ("threshold", "sensitivity", "specificity")])


@query("""WITH {frame:line}, c AS (SELECT l_returnflag, sum((score >= 0.4 AND label = 1)::INTEGER) tp, sum((score >= 0.4 AND label = 0)::INTEGER) fp, sum((score < 0.4 AND label = 1)::INTEGER) fn, sum((score < 0.4 AND label = 0)::INTEGER) tn FROM line GROUP BY 1)
SELECT l_returnflag, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1_score, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy FROM c""")
def metric_confusion(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.confusion(line_frame(spark, d).df, ["l_returnflag"], F.lit(0.4), "label", "score")
    return out.select("l_returnflag", *[r6(c).alias(c) for c in out.columns[1:]])


@query("WITH {frame:line} SELECT train, count(*) AS n, sum(label)::BIGINT AS positives FROM line GROUP BY 1")
def prep_hashed_split(spark: SparkSession, d: str) -> DataFrame:
    df = hashed_split(line_frame(spark, d).df.drop("train"), "rid")
    return df.groupBy("train").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))


@query("WITH {frame:line}, preds AS (SELECT l_returnflag AS k, label AS y, score AS p, 1.0 AS w FROM line UNION ALL SELECT l_returnflag || '*', label, score, CASE WHEN label = 1 THEN 0.2 / avg(label) OVER (PARTITION BY l_returnflag) ELSE 0.8 / (1 - avg(label) OVER (PARTITION BY l_returnflag)) END FROM line), " + AUC_SQL.replace("{k}", "k") + " SELECT a.k AS l_returnflag, round(a.roc_auc, 6) AS roc_auc, round(a.pr_auc, 6) AS pr_auc, round(b.pr_auc, 6) AS calibrated_pr_auc FROM a JOIN a b ON b.k = a.k || '*'")
def metric_score_triple(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.score_triple(line_frame(spark, d).df, ["l_returnflag"], 0.2, "label", "score")
    return out.select("l_returnflag", *[r6(c).alias(c) for c in ("roc_auc", "pr_auc", "calibrated_pr_auc")])


@query("WITH {frame:line}, preds AS (SELECT 'roc' AS k, label AS y, score AS p, w FROM line UNION ALL SELECT 'pr', label, score, 1.0 FROM line), " + AUC_SQL.replace("{k}", "k") + " SELECT k AS metric, round(CASE k WHEN 'roc' THEN roc_auc ELSE pr_auc END, 6) AS score FROM a")
def metric_by_name(spark: SparkSession, d: str) -> DataFrame:
    df = line_frame(spark, d).df.withColumn("metric", F.lit("roc"))
    weighted = metrics.score(df, ["metric"], "roc", "label", "score", "w")
    plain = metrics.score(df.withColumn("metric", F.lit("pr")), ["metric"], "pr", "label", "score")
    return weighted.unionByName(plain).select("metric", r6("score").alias("score"))


@query("WITH {frame:line}, t AS (SELECT avg(price) AS m, stddev_pop(price) AS s FROM line WHERE train), m AS (SELECT l_returnflag, sum(w * price) / sum(w) AS mw, stddev_pop(price) AS sd, sum(w * label) / sum(w) AS pw FROM line WHERE NOT train GROUP BY 1) SELECT l_returnflag, round((mw - m) / s, 6) + 0.0 AS mean_shift, round(sqrt(sum(w * (price - mw) ** 2) / sum(w)) / any_value(sd), 6) AS sd_ratio, round(any_value(pw), 6) AS weighted_prevalence FROM line JOIN m USING (l_returnflag), t WHERE NOT train GROUP BY l_returnflag, mw, m, s")
def metric_shift_in_train_deviations(spark: SparkSession, d: str) -> DataFrame:
    df = line_frame(spark, d).df
    mean, sd = df.where("train").agg(F.avg("price"), F.stddev_pop("price")).first()
    out = metrics.weighted_shift_of(df.where("NOT train"), ["l_returnflag"], "price", "label", "w", mean, sd)
    return out.select("l_returnflag", *[r6(c).alias(c) for c in ("mean_shift", "sd_ratio", "weighted_prevalence")])


@query("SELECT l_returnflag, true AS same FROM lineitem GROUP BY 1")
def metric_self_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether the area by running sums is the area by average ranks, to 1e-10, for every key. Rows of one score have one
    rank, so scores are ranked with their counts: no task sorts rows."""
    from ..operators.stats import average_rank

    df = line_frame(spark, d).df.select("l_returnflag", F.col("label").alias("y"), F.col("score").alias("p"))
    scores = df.groupBy("l_returnflag", "p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))
    ranks = average_rank(scores, ["l_returnflag"], "p", "r", "n")
    pos, n = F.sum("y"), F.sum("n")
    by_rank = ranks.groupBy("l_returnflag").agg(((F.sum(F.col("r") * F.col("y")) - pos * (pos + 1) / 2) / (pos * (n - pos))).alias("other"))
    both = metrics.rank_metrics(df, ["l_returnflag"]).join(by_rank, "l_returnflag")
    return both.select("l_returnflag", (F.abs(F.col("roc_auc") - F.col("other")) <= 1e-10).alias("same"))
