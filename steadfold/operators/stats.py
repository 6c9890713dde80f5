"""Rank statistics, paired comparisons, summaries, the stress grid's integral and the bootstrap."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .places import placed
from .vectors import vector_scores


def average_rank(df: DataFrame, keys: list[str], value: str, out: str, counts: str | None = None) -> DataFrame:
    """df with the rank of value, ties sharing their mean. counts: how many rows each row of df stands for."""
    return placed(df, keys, value, F.col(counts) if counts else None).withColumn(out, F.col("_below") + (F.col("_same") + 1) / 2).select(*df.columns, out)


def pearson(x: str, y: str) -> Column:
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, spearman); null where either is constant."""
    r = average_rank(average_rank(df, keys, x, "_rx"), keys, y, "_ry")
    return r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson("_rx", "_ry").alias("spearman"))


def partial_spearman(df: DataFrame, keys: list[str], x: str, y: str, z: str) -> DataFrame:
    """(keys, spearman, partial_spearman): of x and y, and given z, in the closed form of the three rank correlations;
    null where z explains either."""
    r = df
    for c in (x, y, z):
        r = average_rank(r, keys, c, f"_r_{c}")
    pair = lambda a, b: pearson(f"_r_{a}", f"_r_{b}")
    r = r.groupBy(*keys).agg(pair(x, y).alias("spearman"), pair(x, z).alias("_xz"), pair(y, z).alias("_yz"))
    left = (1 - F.col("_xz") * F.col("_xz")) * (1 - F.col("_yz") * F.col("_yz"))
    partial = F.when(left > 1e-12, (F.col("spearman") - F.col("_xz") * F.col("_yz")) / F.sqrt(F.greatest(left, F.lit(0.0))))
    return r.select(*keys, "spearman", F.coalesce(partial, F.when(F.col("_xz").isNull(), F.col("spearman"))).alias("partial_spearman"))


def signed_ranks(df: DataFrame, keys: list[str], difference: str) -> DataFrame:
    """(keys, n, w_plus, w_minus, ties, zeros): signed rank sums of differences rounded to 12 digits, nulls left out, and
    zeros, of which only the number is kept. ties: sum of t^3 - t over groups of equal size, for the variance."""
    some = df.withColumn("_d", F.round(F.col(difference).cast("double"), 12)).where(F.col("_d").isNotNull()).withColumn("_a", F.abs("_d"))
    zero = some.groupBy(*[F.col(k).alias(f"_z_{k}") for k in keys]).agg(F.count_if(F.col("_d") == 0).alias("zeros"))
    some = some.where("_d != 0")
    counts = some.groupBy(*keys, "_a").agg(F.count(F.lit(1)).alias("_k"), F.count_if(F.col("_d") > 0).alias("_p"))
    below = F.coalesce(F.sum("_k").over(Window.partitionBy(*keys).orderBy("_a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.col("_below") + (F.col("_k") + 1) / 2
    counts = counts.withColumn("_below", below)
    k = F.col("_k")
    sums = counts.groupBy(*keys).agg(F.sum("_k").alias("n"), F.sum(F.col("_p") * rank).alias("w_plus"), F.sum((k - F.col("_p")) * rank).alias("w_minus"), F.sum(k * k * k - k).alias("ties"))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_z_{c}"))
    return sums.join(zero, same).drop(*[f"_z_{c}" for c in keys])


def signed_rank_p(n: int, w_plus: float, w_minus: float, ties: int = 0, zeros: int = 0) -> float:
    """Two-sided. Exact by counting sign patterns if there are no ties or zeros and n <= 50, else normal with the
    variance corrected for ties and no continuity correction. nan for under two values."""
    if n + zeros < 2 or n == 0:
        return float("nan")
    low = min(w_plus, w_minus)
    if not ties and not zeros and n <= 50:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(low) + 1]) / 2**n)
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    z = (low - n * (n + 1) / 4) / spread if spread else 0.0
    return min(1.0, math.erfc(abs(z) / math.sqrt(2)))


def paired_differences(df: DataFrame, keys: list[str], seed: str, method: str, value: str, target: str) -> DataFrame:
    """(keys, baseline, seed, difference): target less each other method, seed by seed; a method that was scored once,
    with a null seed, is compared with every seed of the target."""
    t = df.where(F.col(method) == target).select(*keys, F.col(seed).alias("_seed"), F.col(value).alias("_t"))
    b = df.where(F.col(method) != target).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(method).alias("baseline"), F.col(seed).alias("_b_seed"), F.col(value).alias("_b"))
    same = F.col("_seed").eqNullSafe(F.col("_b_seed")) | F.col("_b_seed").isNull()
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return t.join(b, same).select(*keys, "baseline", F.col("_seed").alias("seed"), (F.col("_t") - F.col("_b")).alias("difference"))


def paired_table(differences: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_runs, mean_difference, median_difference, n_better): better means above zero after 12 digits."""
    d = F.round("difference", 12)
    return differences.where("difference IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_runs"), F.avg("difference").alias("mean_difference"), F.percentile("difference", F.lit(0.5)).alias("median_difference"), F.count_if(d > 0).alias("n_better"))


def share_better(df: DataFrame, keys: list[str], method: str, value: str, target: str, baseline: str) -> DataFrame:
    """(keys, share): of the units that keys tell apart but for the last, where target is above baseline."""
    of = lambda m: F.avg(F.when(F.col(method) == m, F.col(value)))
    units = df.groupBy(*keys).agg(of(target).alias("_t"), of(baseline).alias("_b")).where("_t IS NOT NULL AND _b IS NOT NULL")
    return units.groupBy(*keys[:-1]).agg(F.avg((F.col("_t") > F.col("_b")).cast("double")).alias("share"))


def family_scores(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mean, worst, sd, n_scenarios): of one model in one family at one severity. Null seeds stay a group."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("worst"), F.stddev_samp(value).alias("sd"), F.count(F.lit(1)).alias("n_scenarios"))


def family_summary(df: DataFrame, inner: list[str], outer: list[str], value: str) -> DataFrame:
    """(outer, n_runs, mean, sd): repetitions are averaged inside a run before runs are compared; sd is null for one."""
    runs = df.groupBy(*inner).agg(F.avg(value).alias("_v"))
    return runs.groupBy(*outer).agg(F.count(F.lit(1)).alias("n_runs"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sd"))


def summary_statistics(df: DataFrame, keys: list[str], value: str, digits: int = 4) -> DataFrame:
    r = lambda c: F.round(c, digits)
    return df.groupBy(*keys).agg(r(F.min(value).cast("double")).alias("min"), r(F.percentile(value, F.lit(0.5))).alias("median"), r(F.avg(value)).alias("mean"), r(F.max(value).cast("double")).alias("max"), r(F.stddev_samp(value)).alias("std"))


def grid_area(grid: DataFrame, keys: list[str], x: str, y: str, value: str) -> DataFrame:
    """(keys, aurs): the mean over the grid's area of value / value at (0, 0), by the trapezoid rule along x for each y,
    then along y. Null without a clean cell above zero."""
    cells = grid.groupBy(*keys, x, y).agg(F.avg(value).alias("_v"))
    clean = Window.partitionBy(*keys)
    cells = cells.withColumn("_c", F.max(F.when((F.col(x) == 0) & (F.col(y) == 0), F.col("_v"))).over(clean)).withColumn("_v", F.when(F.col("_c") > 0, F.col("_v") / F.col("_c")))
    along = Window.partitionBy(*keys, y).orderBy(x)
    strip = F.sum((F.col(x) - F.col("_lx")) * (F.col("_v") + F.col("_lv")) / 2)
    rows = cells.withColumns({"_lx": F.lag(x).over(along), "_lv": F.lag("_v").over(along)}).groupBy(*keys, y).agg((strip / F.nullif(F.max(x) - F.min(x), F.lit(0.0))).alias("_s"))
    across = Window.partitionBy(*keys).orderBy(y)
    rows = rows.withColumns({"_ly": F.lag(y).over(across), "_ls": F.lag("_s").over(across)})
    return rows.groupBy(*keys).agg((F.sum((F.col(y) - F.col("_ly")) * (F.col("_s") + F.col("_ls")) / 2) / F.nullif(F.max(y) - F.min(y), F.lit(0.0))).alias("aurs"))


#: The constants of a published 64-bit mixing function, by which a row's key and a sample's number give a draw.
STEP, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

#: The chance of fewer than 1, 2, ... draws of a row.
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]


def row_key(row_id: str, seed: int = 1) -> Column:
    """The halves of a 64-bit key of a row, from its id and the seed, as two numbers."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.lit("bootstrap"), F.col(row_id).cast("string")))
    return F.array(*[F.conv(F.substring(digest, at, 8), 16, 10).cast("double") for at in (1, 9)])


def draws(keys: np.ndarray, samples: int) -> np.ndarray:
    """(rows, samples): how often each row is drawn into each sample, Poisson with mean 1, from row_key()."""
    with np.errstate(over="ignore"):
        key = keys[:, 0].astype(np.uint64) << np.uint64(32) | keys[:, 1].astype(np.uint64)
        x = key[:, None] + np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(STEP)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
        u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.searchsorted(POISSON, u, side="right").astype(np.float64)


def bootstrap_scores(preds: DataFrame, keys: list[str], row_id: str, samples: int, seed: int = 1, y: str = "y", p: str = "p") -> DataFrame:
    """(keys, sample, roc_auc, pr_auc): rows are drawn alike for all keys, by hash, so no rows are counted beforehand and
    draws do not depend on partitioning. A sample is a place in the vectors of vector_scores(): no row is repeated."""
    fields = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_"))
    kinds = ", ".join(f"{k}: {kind}" for k, kind in preds.select(*keys).dtypes) if keys else "_: int"
    records = preds.where(F.col(p).isNotNull() & F.col(y).isin(0, 1)).select(F.to_json(fields).alias("model"), F.col(p).cast("double").alias("p"), F.col(y).cast("int").alias("y"), row_key(row_id, seed).alias("t"))
    out = vector_scores(records, lambda t: draws(t, samples), samples).withColumn("_k", F.from_json("model", f"struct<{kinds}>"))
    return out.select(*[F.col("_k")[k].alias(k) for k in keys], F.col("at").alias("sample"), "roc_auc", "pr_auc")


def percentile_interval(df: DataFrame, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    edge = (1 - level) / 2
    return df.groupBy(*keys).agg(F.percentile(value, F.lit(edge)).alias("low"), F.percentile(value, F.lit(1 - edge)).alias("high"), F.count(value).alias("n_samples"))


def largest_deviation(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(n, n_missing, deviation) between a table and its record; keys compare nulls as equal."""
    x = a.select(*keys, F.col(value).alias("_a"))
    y = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(value).alias("_b"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return x.join(y, same, "full_outer").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("n_missing"), F.coalesce(F.max(F.abs(F.col("_a") - F.col("_b"))), F.lit(0.0)).alias("deviation"))


def format_p(p: float | None) -> str:
    return "nan" if p is None or np.isnan(p) else f"{p:.1e}" if p < 1e-3 else f"{p:.3f}"


def pivoted(df: DataFrame, keys: list[str], column: str, names: list[str], value: str) -> DataFrame:
    """(keys, a column for each name): the mean value where column has that name; null where it has none."""
    return df.groupBy(*keys).pivot(column, names).agg(F.avg(value))


def with_intervals(tests: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """tests with the intervals of their keys, null where there is none."""
    return tests.join(intervals, keys, "left")


#: The families in the order of reports; the one whose severity falls with its level; the others' rises.
FAMILY_ORDER = ("population", "dependence_weaken", "dependence_strengthen", "noise", "redraw", "under_recording", "masking", "median_masking")
FALLING = "population"


def severity_rank(df: DataFrame, order: tuple[str, ...] = FAMILY_ORDER, falling: str = FALLING) -> DataFrame:
    """df with family_rank and severity_rank: ascending in both, families come in their order and the mildest level first.
    A family that is not in the order comes last."""
    place = F.array_position(F.array(*[F.lit(f) for f in order]), F.col("family"))
    rank = F.when(place > 0, place).otherwise(len(order) + 1).cast("int")
    mild = F.when(F.col("family") == falling, -F.col("severity")).otherwise(F.col("severity"))
    return df.withColumns({"family_rank": rank, "severity_rank": mild})


def headline_statistic(family: str) -> tuple[str, str]:
    """(score, change) that summarise a family: the worst scenario of the population's, whose directions would cancel in a
    mean; the mean of others."""
    return ("worst_roc_auc", "worst_delta_roc_auc") if family == "population" else ("roc_auc", "delta_roc_auc")


#: What a paired comparison may be of.
STATISTICS = ("roc_auc", "delta_roc_auc", "worst_roc_auc", "worst_delta_roc_auc")


def paired_tests(family_scores: DataFrame, target: str, statistics: tuple[str, ...] = STATISTICS) -> DataFrame:
    """(family, severity, statistic, baseline, n_runs, mean_difference, median_difference, n_better, p_value): target's runs
    against each other method's, seed by seed, or against its single value. The p-value's exact distribution takes
    place in a task for each comparison, over numbers that the aggregate has summed up."""
    long = family_scores.select("family", "severity", "method", "seed", F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).alias("value")) for s in statistics])).alias("x"))
    long = long.select("family", "severity", "method", "seed", "x.*").where("value IS NOT NULL")
    keys = ["family", "severity", "statistic"]
    diff = paired_differences(long, keys, "seed", "method", "value", target)
    sums = paired_table(diff, [*keys, "baseline"]).join(signed_ranks(diff, [*keys, "baseline"], "difference"), [*keys, "baseline"], "left")
    return with_p(sums, [*keys, "baseline", "n_runs", "mean_difference", "median_difference", "n_better"])


def with_p(sums: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, p_value) from n, w_plus, w_minus, ties and zeros: as many rows as there are comparisons."""
    kinds = dict(sums.dtypes)

    def run(batches):
        import pandas as pd

        for b in batches:
            ps = [float("nan") if pd.isna(r.n) else signed_rank_p(int(r.n), r.w_plus, r.w_minus, int(r.ties), int(r.zeros)) for r in b.itertuples()]
            yield b[keep].assign(p_value=ps)

    return sums.select(*keep, "n", F.col("w_plus").cast("double").alias("w_plus"), F.col("w_minus").cast("double").alias("w_minus"), F.col("ties").cast("long").alias("ties"), "zeros").mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", p_value double")


def small_cohorts(scenarios: DataFrame, least: int = 10, prefix: str = "dependence") -> DataFrame:
    """(family, units, excluded): families of pairs whose cohort has fewer than `least` units are left out of summaries."""
    counts = scenarios.groupBy("family").agg(F.count_distinct(F.when(F.col("in_cohort"), F.col("unit"))).alias("units"))
    return counts.select("family", "units", (F.col("family").startswith(prefix) & (F.col("units") < least)).alias("excluded"))


def seed_averaged_bootstrap(id_preds: DataFrame, ood_preds: DataFrame, row_id: str, target: str, samples: int, seed: int = 1, level: float = 0.95) -> DataFrame:
    """(baseline, metric, low, high, n_samples): percentile intervals of target's out-of-domain AUC, and of its drop from
    in-domain, less a baseline's; AUCs are averaged over seeds first. preds: row, model, seed, y, p. Rows of either side
    are drawn alike for all models and seeds; samples with one class have no AUC and drop out."""
    def side(preds: DataFrame, name: str) -> DataFrame:
        rows = preds.withColumn("_row", F.concat_ws("|", F.lit(name), F.col(row_id).cast("string")))
        auc = bootstrap_scores(rows, ["model", "seed"], "_row", samples, seed).where("roc_auc IS NOT NULL")
        return auc.groupBy("sample", "model").agg(F.avg("roc_auc").alias(name))

    both = side(id_preds, "id").join(side(ood_preds, "ood"), ["sample", "model"]).withColumn("drop", F.col("id") - F.col("ood"))
    t = both.where(F.col("model") == target).select("sample", F.col("ood").alias("_ood"), F.col("drop").alias("_drop"))
    out = both.where(F.col("model") != target).join(t, "sample").select("sample", F.col("model").alias("baseline"), F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), (F.col(f"_{c}") - F.col(c)).alias("value")) for n, c in (("ood_roc_auc", "ood"), ("roc_auc_drop", "drop"))])).alias("x")).select("baseline", "x.*")
    return percentile_interval(out, ["baseline", "metric"], "value", level)


def front_correlations(front: DataFrame, keys: list[str] = ("seed",)) -> DataFrame:
    """(keys, cv_s_vs_ood, cv_s_vs_ood_given_k, cv_s_vs_drop, final_s_vs_ood): rank correlations within each front of sign
    consistency with out-of-domain performance; null where either is constant."""
    keys = list(keys)
    named = lambda df, was, name: df.select(*keys, F.col(was).alias(name))
    given = partial_spearman(front, keys, "cv_sign_consistency", "ood_roc_auc", "n_features")
    out = named(given, "spearman", "cv_s_vs_ood").join(named(given, "partial_spearman", "cv_s_vs_ood_given_k"), keys)
    out = out.join(named(spearman(front, keys, "cv_sign_consistency", "roc_auc_drop"), "spearman", "cv_s_vs_drop"), keys)
    return out.join(named(spearman(front, keys, "sign_consistency", "ood_roc_auc"), "spearman", "final_s_vs_ood"), keys)
