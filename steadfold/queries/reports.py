"""Queries behind reports and figures: screens, nested subsets, convergence, checks of stored data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import corrupt, metrics, reweight, schema
from ..plans.frames import documents_frame, line_frame
from ..sources.store import same_rows
from ..sources.tables import table
from .metrics import AUC_SQL, CORR_SQL, LONG_DOC
from .models import POINTS_SQL, _points
from .registry import query
from .schema import LINE_FLAGS_SQL, flagged_lines
from .stress import SEED, _u


@query("WITH preds AS (SELECT 'e' || (i - 1) AS feature, label % 2 AS y, embedding[i]::DOUBLE AS p, 1.0::DOUBLE AS w FROM embeddings, range(1, 65) r(i)), " + AUC_SQL.replace("{k}", "feature") + " SELECT feature, round(greatest(roc_auc, 1 - roc_auc), 6) AS separation FROM a ORDER BY round(greatest(roc_auc, 1 - roc_auc), 6) DESC, feature LIMIT 10")
def report_top_screen(spark: SparkSession, d: str) -> DataFrame:
    """The ten components of the embeddings that separate odd labels from even ones best by themselves: the limit is the
    report."""
    rows = table(spark, d, "embeddings")
    names = [f"e{i}" for i in range(rows.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    df = rows.select((F.col("label") % 2).alias("y"), *[F.get("embedding", i).cast("double").alias(n) for i, n in enumerate(names)])
    out = metrics.feature_screen(df, names, "y").select("feature", r6("separation").alias("separation"))
    return out.orderBy(F.desc("separation"), "feature").limit(10)


@query("WITH {frame:doc}, " + LONG_DOC + ", " + CORR_SQL + ", o AS (SELECT feature, row_number() OVER (ORDER BY round(abs(corr), 9) DESC, feature) AS place FROM corr) SELECT k::INTEGER AS k, feature, place::INTEGER AS place FROM o, (VALUES (1), (3), (5)) t(k) WHERE place <= k")
def report_nested_subsets(spark: SparkSession, d: str) -> DataFrame:
    """The k features most correlated with the label, for several k; the window is over features, not rows."""
    frame = documents_frame(spark, d)
    corr = metrics.marginal_correlations(frame.df, frame.features, frame.label)
    placed = corr.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round(F.abs("corr"), 9)), "feature")))
    return placed.select(F.explode(F.array(*[F.lit(k) for k in (1, 3, 5)])).alias("k"), "feature", "place").where("place <= k")


@query("WITH " + POINTS_SQL + ", g AS (SELECT gen, max(auc) AS top, avg(auc) AS mean FROM pts GROUP BY 1) SELECT gen, round(max(top) OVER (ORDER BY gen), 6) AS best, round(mean, 6) AS mean FROM g")
def figure_convergence(spark: SparkSession, d: str) -> DataFrame:
    """Best so far and mean of each generation: what a convergence figure draws."""
    g = _points(spark, d).groupBy("gen").agg(F.max("auc").alias("top"), F.avg("auc").alias("mean"))
    return g.select("gen", r6(F.max("top").over(Window.orderBy("gen"))).alias("best"), r6("mean").alias("mean"))


@query("WITH {frame:doc}, s AS (SELECT label, round(avg_w * 4) / 4 AS bin, count(*) AS n FROM doc GROUP BY 1, 2) SELECT label, bin, n, round(sum(n) OVER (PARTITION BY label ORDER BY bin) / sum(n) OVER (PARTITION BY label), 6) AS upto FROM s")
def figure_score_distribution(spark: SparkSession, d: str) -> DataFrame:
    df = documents_frame(spark, d).df.groupBy("label", (F.round(F.col("avg_w") * 4) / 4).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("label")
    return df.select("label", "bin", "n", r6(F.sum("n").over(w.orderBy("bin")) / F.sum("n").over(w)).alias("upto"))


@query("WITH {frame:line}, " + LINE_FLAGS_SQL + ", d AS (SELECT rf_A AS a0, ls_F AS f0, CASE WHEN " + _u("under_recording", "rf_A") + " < 0.3 THEN 0 ELSE rf_A END AS a, CASE WHEN " + _u("under_recording", "ls_F") + " < 0.3 THEN 0 ELSE ls_F END AS f FROM fl) SELECT sum((a = 0 AND f = 0 AND NOT (a0 = 0 AND f0 = 0))::INTEGER)::BIGINT AS combinations, count(*) FILTER (WHERE a = 0 AND f = 0 AND NOT (a0 = 0 AND f0 = 0)) AS rows FROM d")
def corrupt_created_combinations(spark: SparkSession, d: str) -> DataFrame:
    df = flagged_lines(spark, d)
    dirty = corrupt.under_record(df, "rid", ["rf_A", "ls_F"], 0.3, 0, SEED)
    return corrupt.created_combinations(df, dirty, "rid", [("rf_A", "ls_F", 0, 0)])


@query("""WITH w AS (SELECT c_custkey, c_mktsegment FROM customer), p AS (SELECT * FROM w WHERE c_custkey % 2 = 0 UNION ALL SELECT * FROM w WHERE c_custkey % 2 = 1), q AS (SELECT * FROM p WHERE c_custkey < (SELECT max(c_custkey) FROM w))
SELECT NOT EXISTS (SELECT * FROM w EXCEPT ALL SELECT * FROM p) AND NOT EXISTS (SELECT * FROM p EXCEPT ALL SELECT * FROM w) AS same, NOT EXISTS (SELECT * FROM w EXCEPT ALL SELECT * FROM q) AND NOT EXISTS (SELECT * FROM q EXCEPT ALL SELECT * FROM w) AS shorter""")
def lineage_same_rows(spark: SparkSession, d: str) -> DataFrame:
    """Whether a table read in parts is the table, and whether it still is without its last key."""
    whole = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    parts = whole.where("c_custkey % 2 = 0").unionByName(whole.where("c_custkey % 2 = 1"))
    last = whole.agg(F.max("c_custkey")).first()[0]
    return spark.createDataFrame([(same_rows(whole, parts), same_rows(whole, parts.where(F.col("c_custkey") < last)))], "same boolean, shorter boolean")


@query()
def reweight_single_axis(spark: SparkSession, d: str) -> DataFrame:
    """Class-normalised weights along the first axis, clipped at two deviations, at two strengths each way."""
    frame = documents_frame(spark, d)
    values, vectors, reach, fit = reweight.principal_axes(frame.df, frame.features, F.col("train"))
    df = frame.df.withColumn("z", reweight.axis_columns(frame.features, values, vectors, reach, fit, 1)["PC1"] / F.lit(float(values[0]) ** 0.5))
    clipped = F.greatest(F.least(F.col("z"), F.lit(2.0)), F.lit(-2.0))
    df = df.select("doc_id", "label", clipped.alias("z"), F.explode(F.array(*[F.lit(s) for s in (-1.0, -0.5, 0.5, 1.0)])).alias("strength"))
    df = metrics.class_normalised(df.withColumn("w", F.exp(F.col("strength") * F.col("z"))), ["strength"], "label", "w")
    return metrics.ess_by_class(df, ["strength"], "label", "w").select("strength", F.round("ess_negatives", 4).alias("ess_negatives"), F.round("ess_positives", 4).alias("ess_positives"))


@query("WITH {frame:line}, " + LINE_FLAGS_SQL + ", n AS (SELECT unnest(['qty', 'rf_A', 'ls_F', 'price']) AS name, unnest([1, 2, 3, 4]) AS i), v AS (SELECT [qty, rf_A::DOUBLE, ls_F::DOUBLE, price] AS x FROM fl) SELECT a.name AS a, b.name AS b, round(corr(x[a.i], x[b.i]), 6) + 0.0 AS corr FROM v, n a JOIN n b ON a.i < b.i GROUP BY 1, 2")
def gram_line_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Correlations of all pairs of two numbers and two flags of lines."""
    return schema.correlations(flagged_lines(spark, d), ["qty", "rf_A", "ls_F", "price"]).withColumn("corr", r6("corr"))


@query("WITH {frame:line} SELECT count(*) AS n, count(DISTINCT rid) AS n_ids FROM line")
def lineage_row_ids(spark: SparkSession, d: str) -> DataFrame:
    """Rows and distinct row ids of the line frame: every hashed draw rests on their being the same."""
    ids = line_frame(spark, d).df.groupBy("rid").agg(F.count(F.lit(1)).alias("k"))
    return ids.agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_ids"))
