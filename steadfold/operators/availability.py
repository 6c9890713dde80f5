"""Which flags say that which values are available: what the rows show, as one relation, and who is paired by it.

The evidence is an array over (flag, level, value column): each task fills its own and passes on the cells that it has, so
what is shuffled depends on the number of columns and tasks alone, and no row is repeated for a flag or a value."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..sources.staging import staged

#: Fixed value: what separates a column's stem from its suffix.
SEPARATORS = ":_."

#: A name with a separator that is neither its first character nor followed by another one.
SPLIT = re.compile(rf"(.+)([{SEPARATORS}])[^{SEPARATORS}]*", re.DOTALL)

EVIDENCE = "flag string, level int, value string, rows long, fill double, inside boolean, off_rows long, off_hits long, flag_at int, value_at int"


def split_name(name: str) -> tuple[str, str] | None:
    """The stem and the separator of a name that has both."""
    return found.groups() if (found := SPLIT.fullmatch(name)) else None


def _cells(df: DataFrame, flags: list[str], values: list[str], measure: Callable[[np.ndarray, np.ndarray, int, int], dict[str, np.ndarray]], start: dict[str, float], schema: str) -> DataFrame:
    """Runs measure(values of the rows at a level, flag, level) over all rows of a task, flag by flag, and emits the cells of
    (flag_at, level, value_at) that any of its rows fell into. start: of each measured number; min, max and sums merge."""
    merge = {"low": np.minimum, "high": np.maximum, "n": np.add, "hits": np.add}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: np.full((len(flags), 2, len(values)), x) for k, x in start.items()}
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            x = np.stack(columns[len(flags) :], axis=1)
            for f in range(len(flags)):
                for level in (0, 1):
                    mine = x[columns[f] == level]
                    if len(mine):
                        for k, found in measure(mine, f, level).items():
                            held[k][f, level] = merge[k](held[k][f, level], found)
        f, level, v = np.nonzero(held["n"] > 0)
        yield pa.RecordBatch.from_arrays([*(pa.array(a.astype(np.int32)) for a in (f, level, v)), *(pa.array(a[f, level, v].astype(np.int64) if k in ("n", "hits") else a[f, level, v]) for k, a in held.items())], ["flag_at", "level", "value_at", *held])

    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate([*flags, *values])])
    return rows.mapInArrow(run, f"flag_at int, level int, value_at int, {schema}")


def evidence(df: DataFrame, flags: list[str], values: list[str]) -> DataFrame:
    """(flag, level, value, rows, fill, inside, off_rows, off_hits, flag_at, value_at) for each level of each flag and value
    column: the rows of the level; the value that they all have, else null, and whether it lies between the extremes of
    all rows; the rows of the other level, and how many of them have it. Two passes: the ends of each cell, then
    matches with its fill."""
    spark = df.sparkSession
    if not flags or not values:
        return spark.createDataFrame([], EVIDENCE)
    key = ["flag_at", "level", "value_at"]
    ends = _cells(df, flags, values, lambda x, f, level: {"low": x.min(axis=0), "high": x.max(axis=0), "n": np.full(x.shape[1], len(x))}, {"low": np.inf, "high": -np.inf, "n": 0}, "low double, high double, n long")
    ends = staged(ends.groupBy(*key).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("rows")), "ends")
    fills = np.full((len(flags), 2, len(values)), np.nan)
    for r in ends.where("low = high").collect():  # a cell for a flag, level and column
        fills[r["flag_at"], r["level"], r["value_at"]] = r["low"]
    hits = _cells(df, flags, values, lambda x, f, level: {"n": np.full(x.shape[1], len(x)), "hits": (x == fills[f, 1 - level]).sum(axis=0)}, {"n": 0, "hits": 0}, "n long, hits long")
    hits = hits.groupBy("flag_at", (1 - F.col("level")).alias("level"), "value_at").agg(F.sum("n").alias("off_rows"), F.sum("hits").alias("off_hits"))
    span = Window.partitionBy("value_at")
    out = ends.withColumns({"least": F.min("low").over(span), "most": F.max("high").over(span)}).join(hits, key, "left")
    name = lambda names, at: F.get(F.array(*[F.lit(c) for c in names]), F.col(at))
    fill = F.when(F.col("low") == F.col("high"), F.col("low"))
    return out.select(name(flags, "flag_at").alias("flag"), "level", name(values, "value_at").alias("value"), "rows", fill.alias("fill"), ((F.col("low") > F.col("least")) & (F.col("high") < F.col("most"))).alias("inside"), F.coalesce("off_rows", F.lit(0)).alias("off_rows"), F.coalesce("off_hits", F.lit(0)).alias("off_hits"), "flag_at", "value_at")


def same_names(binary: list[str], others: list[str]) -> list[tuple[str, str]]:
    """(value, flag) wherever a name says so: the flag is the only binary of its stem and separator, and the value is the
    stem itself or has the same stem and separator."""
    parts = {c: split_name(c) for c in [*binary, *others]}
    n = Counter(parts[f] for f in binary)
    lone = [f for f in binary if parts[f] and n[parts[f]] == 1]
    return [(v, f) for v in others for f in lone if v == parts[f][0] or parts[v] == parts[f]]


def by_name(seen: DataFrame, asked: list[tuple[str, str]]) -> DataFrame:
    """(value, flag, off, fill, state, rivals): each pair that names suggest, with the state that the evidence leaves it in:
    `paired`; `several` flags ask for the value; it `varies` on both levels; or it `differs`, being constant on another
    level than the first value that the flag is paired with."""
    spark = seen.sparkSession
    names = spark.createDataFrame([(v, f, i) for i, (v, f) in enumerate(asked)], "value string, flag string, asked_at int")
    names = names.withColumn("rivals", F.array_sort(F.collect_list("flag").over(Window.partitionBy("value"))))
    level = seen.where("fill IS NOT NULL").groupBy("flag", "value").agg(F.min(F.struct("level", "fill")).alias("first"))
    met = names.join(F.broadcast(level), ["flag", "value"], "left")
    alone = F.size("rivals") == 1
    lead = F.min(F.when(alone & F.col("first").isNotNull(), F.struct("asked_at", F.col("first.level").alias("level")))).over(Window.partitionBy("flag"))
    state = F.when(~alone, "several").when(F.col("first").isNull(), "varies").when(F.col("first.level") != lead["level"], "differs").otherwise("paired")
    return met.withColumn("lead", lead["level"]).select("value", "flag", F.col("first.level").alias("off"), F.col("first.fill").alias("fill"), state.alias("state"), "rivals", "lead", "asked_at")


def by_rows(seen: DataFrame, settled: DataFrame, least_rows: int = 10, other_share: float = 0.05, chance: float = 1e-6) -> DataFrame:
    """(flag, level, value, rows, fill, share, rule, won): what the rows alone suggest for values that are not settled.

    A fill counts if both levels have least_rows and few other rows have it (`share`); or, at the level that a settled
    flag is off on, if it is no extreme value and so many equal ones would be rarer than `chance` by chance. There it is
    `near` otherwise. settled: (flag, value, off). A flag speaks for the level with more such values; of flags that
    speak for a value those win that are off on most rows, and share it if they agree on its fill."""
    off = settled.groupBy("flag").agg(F.min("off").alias("off"))
    open_ = seen.where(F.col("fill").isNotNull() & (F.col("rows") >= least_rows) & (F.col("off_rows") >= least_rows))
    open_ = open_.join(F.broadcast(off), "flag", "left").join(F.broadcast(settled.select("value").distinct()), "value", "left_anti")
    open_ = open_.where("off IS NULL OR off = level").withColumn("share", F.col("off_hits") / F.col("off_rows"))
    sure = F.col("off").isNotNull() & F.col("inside")
    rare = F.col("rows") * F.ln(F.greatest("share", F.lit(1e-300))) <= F.lit(math.log(chance))
    open_ = open_.withColumn("rule", F.when(F.col("share") <= other_share, "share").when(sure & rare, "chance").when(sure, "near")).where("rule IS NOT NULL")
    good = F.col("rule") != "near"
    side = Window.partitionBy("flag", "level")
    open_ = open_.withColumn("n", F.count_if(good).over(side)).withColumn("place", F.dense_rank().over(Window.partitionBy("flag").orderBy(F.desc("n"), "level")))
    speaks = good & (F.col("place") == 1)
    best = F.max(F.when(speaks, F.struct("rows", (-F.col("flag_at")).alias("at"), "fill"))).over(Window.partitionBy("value"))
    won = speaks & (F.col("rows") == best["rows"]) & (F.col("fill") == best["fill"])
    return open_.select("flag", "level", "value", "rows", "fill", "share", "rule", F.coalesce(won, F.lit(False)).alias("won"), "flag_at", "value_at")


def availability(df: DataFrame, binary: list[str], continuous: list[str], **rules: float) -> tuple[DataFrame, DataFrame]:
    """(pairs, doubts). pairs: flag, off (its level for `not available`), value, fill, by_name, flag_at. doubts: flag, value,
    reason, for pairs that names or rows suggest and the rows do not bear out. Both have at most a row for a flag and a
    value column."""
    spark = df.sparkSession
    seen = staged(evidence(df, binary, continuous), "evidence")
    asked = same_names(binary, continuous)
    named = staged(by_name(seen, asked), "named")
    settled = named.where("state = 'paired'").select("flag", "value", "off")
    rows = staged(by_rows(seen, settled, **rules), "suggested")
    at = F.broadcast(spark.createDataFrame(list(enumerate(binary)), "flag_at int, flag string"))
    pairs = named.where("state = 'paired'").join(at, "flag").select("flag", "off", "value", "fill", F.lit(True).alias("by_name"), "flag_at", "asked_at")
    pairs = pairs.unionByName(rows.where("won").select("flag", F.col("level").alias("off"), "value", "fill", F.lit(False).alias("by_name"), "flag_at", (F.lit(len(asked)) + F.col("value_at")).cast("int").alias("asked_at")))
    reason = F.when(F.col("state") == "several", F.concat(F.lit("several flags by name: "), F.array_join("rivals", ", "))).when(F.col("state") == "varies", "by name, but not constant on a level of the flag")
    reason = reason.otherwise(F.concat(F.lit("by name, but constant on level "), F.col("off"), F.lit(", where other values are on "), F.col("lead")))
    doubts = named.where("state != 'paired'").select("flag", "value", reason.alias("reason"), "asked_at")
    near = rows.where("rule = 'near'").join(F.broadcast(pairs.select("value")), "value", "left_anti")
    near = near.groupBy("value").agg(F.min_by(F.struct("flag", "fill", "rows", "share"), "flag_at").alias("n"), F.min("value_at").alias("value_at"))
    why = F.concat(F.col("n.fill").cast("string"), F.lit(" on all "), F.col("n.rows"), F.lit(" rows of the off level, but also on "), F.round(100 * F.col("n.share")).cast("int"), F.lit("% of the others: it can be chance"))
    return pairs, doubts.unionByName(near.select("n.flag", "value", why.alias("reason"), (F.lit(len(asked)) + F.col("value_at")).cast("int").alias("asked_at")))


def availability_named(df: DataFrame, names: list[str], binaries: list[str]) -> DataFrame:
    """(flag, feature, level, fill): pairs by name whose value column is constant on one level of the flag."""
    others = [c for c in names if c not in binaries]
    found = by_name(evidence(df, binaries, others), same_names(binaries, others))
    return found.where("state = 'paired'").select("flag", F.col("value").alias("feature"), F.col("off").alias("level"), "fill")


def availability_statistical(df: DataFrame, flags: list[str], values: list[str], least_rows: int = 10, other_share: float = 0.05, chance: float = 1e-6, confirmed: dict[str, int] | None = None) -> DataFrame:
    """(flag, feature, level, fill, off_level_rows, rule) by rows alone; confirmed: the off levels of flags that are settled."""
    settled = df.sparkSession.createDataFrame([(f, None, level) for f, level in (confirmed or {}).items()], "flag string, value string, off int")
    out = by_rows(evidence(df, flags, values), settled, least_rows, other_share, chance)
    return out.where("won").select("flag", F.col("value").alias("feature"), "level", "fill", F.col("rows").alias("off_level_rows"), "rule")


def pair_counts(df: DataFrame, binaries: list[str]) -> DataFrame:
    """(a, b, n, n_a, n_b, n_ab) for all pairs of flags, a before b by name: rows, ones of each, ones of both.

    Rows are turned into one string of bits for each flag, and a pair of strings meets in an `and`, 64 rows at a time: a
    task passes on one count for each pair, however many flags are set in a row."""
    names, p = sorted(binaries), len(binaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, both = 0, np.zeros((p, p), np.int64)
        for batch in batches:
            total += batch.num_rows
            ones = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            bits = np.packbits(np.pad(ones, ((0, 0), (0, -ones.shape[1] % 64))), axis=1).view(np.uint64)
            for i in range(p):
                both[i, i:] += np.bitwise_count(bits[i] & bits[i:]).sum(axis=1, dtype=np.int64)
        i, j = np.triu_indices(p)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(both[i, j]), pa.array(np.full(len(i), total))], ["i", "j", "n_ij", "n"])

    spark = df.sparkSession
    if not p:
        return spark.createDataFrame([], "a string, b string, n long, n_a long, n_b long, n_ab long")
    rows = df.select(*[F.coalesce(F.col(f"`{c}`") == 1, F.lit(False)).alias(f"c{i}") for i, c in enumerate(names)])
    counts = rows.mapInArrow(run, "i long, j long, n_ij long, n long").groupBy("i", "j").agg(F.sum("n_ij").alias("n_ij"), F.sum("n").alias("n"))
    every = spark.range(p).select(F.explode(F.sequence(F.col("id"), F.lit(p - 1))).alias("j"), F.col("id").alias("i"))
    counts = staged(every.join(counts, ["i", "j"], "left").na.fill(0, ["n_ij", "n"]), "pair_counts")  # a row for a pair of flags
    one = counts.where("i = j")
    side = lambda c, n: F.broadcast(one.select(F.col("i").alias(c), F.col("n_ij").alias(n)))
    name = lambda at: F.get(F.array(*[F.lit(c) for c in names]), F.col(at).cast("int"))
    return counts.where("i < j").join(side("i", "n_a"), "i").join(side("j", "n_b"), "j").select(name("i").alias("a"), name("j").alias("b"), "n", "n_a", "n_b", F.col("n_ij").alias("n_ab"))


def unseen_combinations(df: DataFrame, binaries: list[str], expected: float = 5.0) -> DataFrame:
    """(a, b, value_a, value_b, expected): cells of pairs of flags that no row is in though independence would put
    `expected` rows or more there."""
    c = F.col
    cells = F.array(*[F.struct(F.lit(x).alias("value_a"), F.lit(y).alias("value_b"), n.alias("seen"), ratio((c("n_a") if x else c("n") - c("n_a")).cast("double") * (c("n_b") if y else c("n") - c("n_b")), c("n")).alias("expected")) for x, y, n in ((1, 1, c("n_ab")), (1, 0, c("n_a") - c("n_ab")), (0, 1, c("n_b") - c("n_ab")), (0, 0, c("n") - c("n_a") - c("n_b") + c("n_ab")))])
    return pair_counts(df, binaries).select("a", "b", F.explode(cells).alias("x")).select("a", "b", "x.*").where((c("seen") == 0) & (c("expected") >= expected)).drop("seen")
