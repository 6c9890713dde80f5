"""Weighted rank metrics as DataFrame plans.

Rows (keys, y, p, w) are first summed by (keys, p), which combines on the map side and removes ties. Running sums over
scores are then taken within ranges of scores, as many as there are partitions, and the ranges' own sums put in front: no
task sorts all scores, even where there is a single key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..sources.staging import staged


def prefix_sums(df: DataFrame, keys: list[str], order: str, sums: dict[str, str], totals: dict[str, str] | None = None) -> DataFrame:
    """df with, for each name in sums, the sum of that column over the rows of the same keys with a smaller order, and for
    each in totals over all rows of the keys. Rows must be distinct in (keys, order).

    The rows are staged once, cut into ranges of (keys, order) as the engine cuts any sort: there are as many as there
    are partitions, a key with most of the rows has most of the ranges, and no task gets more than one at a time."""
    totals = totals or {}
    some = staged(df.repartitionByRange(*keys, order).withColumn("_b", F.spark_partition_id()), "ranges")
    inner = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wanted = {**{f"_t_{n}": c for n, c in sums.items()}, **{f"_a_{n}": c for n, c in totals.items()}}
    starts = some.groupBy(*keys, "_b").agg(*[F.sum(c).alias(n) for n, c in wanted.items()])  # a row for a range and key
    whole = [F.sum(f"_a_{n}").over(Window.partitionBy(*keys)).alias(n) for n in totals]
    starts = starts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_kb"), *[F.coalesce(F.sum(f"_t_{n}").over(outer), F.lit(0)).alias(f"_s_{n}") for n in sums], *whole)
    within = some.withColumns({n: F.coalesce(F.sum(c).over(inner), F.lit(0)) for n, c in sums.items()})
    same = F.col("_b") == F.col("_kb")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = within.join(starts, same)
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"_s_{n}")).alias(n) for n in sums], *totals)


def score_groups(preds: DataFrame, keys: list[str], y: str = "y", p: str = "p", w: str | None = None) -> DataFrame:
    """(keys, p, pos, neg): class weights at each distinct score."""
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    return preds.groupBy(*keys, F.col(p).alias("p")).agg(F.sum(F.when(F.col(y) == 1, weight).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col(y) == 0, weight).otherwise(0.0)).alias("neg"))


def rank_metrics(preds: DataFrame, keys: list[str], y: str = "y", p: str = "p", w: str | None = None) -> DataFrame:
    """(keys, roc_auc, pr_auc): the chance that a positive is above a negative, ties half; and average precision, with
    tied scores as one step. Null where a class has no weight."""
    sums = {"_pos_below": "pos", "_neg_below": "neg"}
    groups = prefix_sums(score_groups(preds, keys, y, p, w), keys, "p", sums, {"_pos": "pos", "_neg": "neg"})
    above_pos, above_neg = F.col("_pos") - F.col("_pos_below"), F.col("_neg") - F.col("_neg_below")
    step = F.col("pos") * ratio(above_pos, above_pos + above_neg)
    area = F.sum(F.col("pos") * (F.col("_neg_below") + F.col("neg") / 2))
    of = F.max  # the same in all rows of the keys
    return groups.groupBy(*keys).agg(ratio(area, of("_pos") * of("_neg")).alias("roc_auc"), F.when(of("_neg") > 0, ratio(F.sum(step), of("_pos"))).alias("pr_auc"))


def ess(df: DataFrame, keys: list[str], w: str) -> DataFrame:
    """(keys, ess, ess_fraction): the effective sample size of weights."""
    size = ratio(F.pow(F.sum(w), F.lit(2.0)), F.sum(F.col(w) * F.col(w)))
    return df.groupBy(*keys).agg(size.alias("ess"), (size / F.count(F.lit(1))).alias("ess_fraction"))


def ess_by_class(df: DataFrame, keys: list[str], y: str, w: str) -> DataFrame:
    """(keys, ess_negatives, ess_positives); 0 for a class without rows."""
    of = lambda c: F.coalesce(ratio(F.pow(F.sum(F.when(F.col(y) == c, F.col(w))), F.lit(2.0)), F.sum(F.when(F.col(y) == c, F.col(w) * F.col(w)))), F.lit(0.0))
    return df.groupBy(*keys).agg(of(0).alias("ess_negatives"), of(1).alias("ess_positives"))


def class_factors(df: DataFrame, keys: list[str], y: str, w: str) -> DataFrame:
    """(keys, y, factor): what makes a class's weights sum to its number of rows."""
    return df.groupBy(*keys, y).agg(ratio(F.count(F.lit(1)).cast("double"), F.sum(w)).alias("factor"))


def class_normalised(df: DataFrame, keys: list[str], y: str, w: str) -> DataFrame:
    """df with its weights scaled within each class; the factors, a row for each key and class, are joined."""
    return df.join(F.broadcast(class_factors(df, keys, y, w)) if not keys else class_factors(df, keys, y, w), [*keys, y]).withColumn(w, F.col(w) * F.col("factor")).drop("factor")


def calibration_weights(df: DataFrame, y: str, reference: float) -> DataFrame:
    """df with w: weights under which the prevalence is the reference."""
    share = df.agg(F.avg(F.col(y).cast("double")).alias("_pi"))
    return df.crossJoin(F.broadcast(share)).withColumn("w", F.when(F.col(y) == 1, ratio(F.lit(reference), F.col("_pi"))).otherwise(ratio(F.lit(1 - reference), 1 - F.col("_pi")))).drop("_pi")


def weighted_pearson(df: DataFrame, keys: list[str], x: str, y: str, w: str) -> DataFrame:
    """(keys, r): null where either has no spread."""
    c, wx = F.col, F.col(w)
    sums = df.groupBy(*keys).agg(F.sum(wx).alias("_w"), *[F.sum(wx * e).alias(n) for n, e in (("_x", c(x)), ("_y", c(y)), ("_xx", c(x) * c(x)), ("_yy", c(y) * c(y)), ("_xy", c(x) * c(y)))])
    mean = lambda n: ratio(c(n), c("_w"))
    vx, vy = mean("_xx") - mean("_x") * mean("_x"), mean("_yy") - mean("_y") * mean("_y")
    return sums.select(*keys, ratio(mean("_xy") - mean("_x") * mean("_y"), F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))).alias("r"))


def weighted_shift(df: DataFrame, keys: list[str], x: str, y: str, w: str) -> DataFrame:
    """(keys, mean_shift, sd_ratio, weighted_prevalence): the weighted mean in deviations from the unweighted one, the
    ratio of the deviations, and the weighted share of positives."""
    c, wx = F.col(x).cast("double"), F.col(w)
    sums = df.groupBy(*keys).agg(F.sum(wx).alias("_w"), F.sum(wx * c).alias("_x"), F.sum(wx * c * c).alias("_xx"), F.sum(wx * F.col(y)).alias("_y"), F.avg(c).alias("_m"), F.stddev_pop(c).alias("_s"))
    mean = ratio(F.col("_x"), F.col("_w"))
    spread = F.sqrt(F.greatest(ratio(F.col("_xx"), F.col("_w")) - mean * mean, F.lit(0.0)))
    return sums.select(*keys, ratio(mean - F.col("_m"), F.col("_s")).alias("mean_shift"), ratio(spread, F.col("_s")).alias("sd_ratio"), ratio(F.col("_y"), F.col("_w")).alias("weighted_prevalence"))


def long_form(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """(keep, feature, value): one row for each feature of each row, made within the row."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in features])
    return df.select(*keep, F.explode(pairs).alias("_x")).select(*keep, "_x.feature", "_x.value")


def marginal_correlations(df: DataFrame, features: list[str], label: str, keys: list[str] = ()) -> DataFrame:
    """(keys, feature, corr): Pearson with the label; 0 for a feature or label without spread. One pass and one
    exchange of a row for each feature and task, whatever the table's size."""
    long = long_form(df, features, [*keys, label])
    y = F.col(label).cast("double")
    r = ratio(F.covar_pop("value", y), F.stddev_pop("value") * F.stddev_pop(y))
    return long.groupBy(*keys, "feature").agg(F.coalesce(r, F.lit(0.0)).alias("corr"))


def sign_consistency(coefficients: DataFrame, correlations: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_features, n_consistent, n_inconsistent, sign_consistency): a coefficient is inconsistent if it and the
    marginal correlation have opposite signs or their product is zero (1e-12)."""
    product = F.col("coef") * F.col("corr")
    bad = ((product < 0) | (F.abs(product) <= 1e-12)).cast("long")
    joined = coefficients.join(correlations, "feature").withColumn("_bad", bad)
    n = F.count(F.lit(1))
    return joined.groupBy(*keys).agg(n.alias("n_features"), (n - F.sum("_bad")).alias("n_consistent"), F.sum("_bad").alias("n_inconsistent"), (1 - F.sum("_bad") / n).alias("sign_consistency"))


def feature_screen(df: DataFrame, features: list[str], label: str, least: float = 0.8) -> DataFrame:
    """(feature, auc, separation, prevalence, flagged): how far each feature alone separates the classes."""
    long = long_form(df, features, [label])
    auc = rank_metrics(long, ["feature"], label, "value").select("feature", F.col("roc_auc").alias("auc"))
    share = long.groupBy("feature").agg(F.avg((F.col("value") != 0).cast("double")).alias("prevalence"))
    separation = F.greatest("auc", 1 - F.col("auc"))
    return auc.join(share, "feature").select("feature", "auc", separation.alias("separation"), "prevalence", F.coalesce(separation >= least, F.lit(False)).cast("int").alias("flagged"))


def balanced_threshold(preds: DataFrame, keys: list[str], row_id: str, y: str = "y", p: str = "p") -> DataFrame:
    """(keys, threshold, sensitivity, specificity): from each place of the ascending scores on everything is called
    positive; the first place with the least difference between sensitivity and specificity. Ties by row id."""
    rows = preds.select(*keys, F.struct(F.col(p).cast("double").alias("p"), F.col(row_id).alias("id")).alias("at"), F.col(y).cast("long").alias("_y"), F.lit(1).cast("long").alias("_one"))
    rows = prefix_sums(rows, keys, "at", {"_below": "_y", "_i": "_one"}, {"_pos": "_y", "_n": "_one"})
    sensitivity = F.coalesce(ratio((F.col("_pos") - F.col("_below")).cast("double"), F.col("_pos")), F.lit(0.0))
    specificity = F.coalesce(ratio((F.col("_i") - F.col("_below")).cast("double"), F.col("_n") - F.col("_pos")), F.lit(0.0))
    rows = rows.withColumns({"sensitivity": sensitivity, "specificity": specificity})
    best = F.min_by(F.struct(F.col("at.p").alias("threshold"), "sensitivity", "specificity"), F.struct(F.round(F.abs(F.col("sensitivity") - F.col("specificity")), 12), "_i"))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def confusion(preds: DataFrame, keys: list[str], threshold: Column, y: str = "y", p: str = "p") -> DataFrame:
    """(keys, accuracy, f1_score, sensitivity, specificity, balanced_accuracy) of p >= threshold."""
    hit, pos = F.col(p) >= threshold, F.col(y) == 1
    cell = lambda c: F.sum(c.cast("double"))
    cells = preds.groupBy(*keys).agg(cell(hit & pos).alias("tp"), cell(hit & ~pos).alias("fp"), cell(~hit & pos).alias("fn"), cell(~hit & ~pos).alias("tn"))
    c = F.col
    sens, spec = F.coalesce(ratio(c("tp"), c("tp") + c("fn")), F.lit(0.0)), F.coalesce(ratio(c("tn"), c("tn") + c("fp")), F.lit(0.0))
    f1 = F.coalesce(ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")), F.lit(0.0))
    return cells.select(*keys, ratio(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")).alias("accuracy"), f1.alias("f1_score"), sens.alias("sensitivity"), spec.alias("specificity"), ((sens + spec) / 2).alias("balanced_accuracy"))


def score_triple(preds: DataFrame, keys: list[str], reference: float, y: str = "y", p: str = "p") -> DataFrame:
    """(keys, roc_auc, pr_auc, calibrated_pr_auc) in one pass: the last is under weights that bring the prevalence to the
    reference, and those only scale the two classes' running sums."""
    sums = {"_pos_below": "pos", "_neg_below": "neg"}
    groups = prefix_sums(score_groups(preds, keys, y, p), keys, "p", sums, {"_pos": "pos", "_neg": "neg"})
    tp, fp, of = F.col("_pos") - F.col("_pos_below"), F.col("_neg") - F.col("_neg_below"), F.max
    one, zero = ratio(F.lit(reference), F.col("_pos")), ratio(F.lit(1 - reference), F.col("_neg"))
    area = F.sum(F.col("pos") * (F.col("_neg_below") + F.col("neg") / 2))
    average = lambda a, b: F.when(of("_neg") > 0, ratio(F.sum(F.col("pos") * ratio(tp * a, tp * a + fp * b)), of("_pos")))
    return groups.groupBy(*keys).agg(ratio(area, of("_pos") * of("_neg")).alias("roc_auc"), average(F.lit(1.0), F.lit(1.0)).alias("pr_auc"), average(one, zero).alias("calibrated_pr_auc"))


#: What a score may be called by.
METRICS = {"roc": "roc_auc", "pr": "pr_auc"}


def score(preds: DataFrame, keys: list[str], metric: str, y: str = "y", p: str = "p", w: str | None = None) -> DataFrame:
    """(keys, score) by the metric's name, weighted if w is given."""
    if metric not in METRICS:
        raise ValueError(f"no such metric: {metric}; there are {sorted(METRICS)}")
    return rank_metrics(preds, keys, y, p, w).select(*keys, F.col(METRICS[metric]).alias("score"))


def weighted_shift_of(df: DataFrame, keys: list[str], x: str, y: str, w: str, mean: float, sd: float) -> DataFrame:
    """weighted_shift in deviations of other rows (the training rows), whose mean and deviation are given."""
    c, wx = F.col(x).cast("double"), F.col(w)
    sums = df.groupBy(*keys).agg(F.sum(wx).alias("_w"), F.sum(wx * c).alias("_x"), F.sum(wx * c * c).alias("_xx"), F.sum(wx * F.col(y)).alias("_y"), F.stddev_pop(c).alias("_s"))
    at = ratio(F.col("_x"), F.col("_w"))
    spread = F.sqrt(F.greatest(ratio(F.col("_xx"), F.col("_w")) - at * at, F.lit(0.0)))
    return sums.select(*keys, ratio(at - F.lit(mean), F.lit(sd)).alias("mean_shift"), ratio(spread, F.col("_s")).alias("sd_ratio"), ratio(F.col("_y"), F.col("_w")).alias("weighted_prevalence"))
