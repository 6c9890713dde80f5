"""Preparation of feature tables: sentinels, encoders, filters, joins, deduplication and splits.

Everything fitted (medians, levels, moments, constant columns) sees the rows of `train` alone. Fitted statistics are
one aggregate over the table; what reaches the driver has a row for each column, never for each row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_uniform, ratio
from .metrics import prefix_sums


def null_sentinels(df: DataFrame, sentinels: dict[str, list]) -> DataFrame:
    """Values that stand for a missing one become null, column by column."""
    return df.withColumns({c: F.when(~F.col(c).isin(values), F.col(c)) for c, values in sentinels.items()})


def to_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cast to double; a value that is no number fails the query."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def binarise(df: DataFrame, columns: dict[str, float]) -> DataFrame:
    """1 above the threshold, else 0; null stays null."""
    return df.withColumns({c: (F.col(c) > F.lit(t)).cast("int") for c, t in columns.items()})


def map_codes(c: Column, names: dict) -> Column:
    """A code's name; null for null and for codes without one."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), c)


#: Ranges of three-digit diagnosis codes (first, past the last), and single codes counted with them.
DIAGNOSES = {
    "Circulatory": ((390, 460), (785,)),
    "Respiratory": ((460, 520), (786,)),
    "Digestive": ((520, 580), (787,)),
    "Diabetes": ((250, 251), ()),
    "Injury": ((800, 1000), ()),
    "Musculoskeletal": ((710, 740), ()),
    "Genitourinary": ((580, 630), (788,)),
    "Neoplasms": ((140, 240), ()),
}


def diagnosis_group(code: Column) -> Column:
    """The group of a diagnosis code given as text: Missing for null and ?, Other for what is no number or in no group."""
    number = F.floor(F.try_to_number(F.regexp_extract(code, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*$", 1), F.lit("999999.999999")))
    out = F.when(code.isNull() | (F.trim(code) == "?"), "Missing")
    for name, ((low, high), single) in DIAGNOSES.items():
        out = out.when((number >= low) & (number < high) | number.isin(*single) if single else (number >= low) & (number < high), name)
    return out.otherwise("Other")


def null_category(df: DataFrame, columns: list[str], label: str = "Missing") -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(label)) for c in columns})


#: Levels of a categorical column at most: more columns than these a plan cannot have.
MOST_LEVELS = 10_000


def levels_of(df: DataFrame, columns: list[str]) -> dict[str, list]:
    """The distinct values of categorical columns, in order, in one pass over all of them. Refuses a column with over
    MOST_LEVELS, whose flags no table could hold."""
    kinds = dict(df.dtypes)
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)])
    found = df.select(F.explode(cells).alias("x")).select("x.i", "x.v").where("v IS NOT NULL").distinct()
    kept = found.groupBy("i").agg(F.slice(F.collect_set("v"), 1, MOST_LEVELS + 1).alias("v")).collect() if columns else []
    out: dict[str, list] = {c: [] for c in columns}
    for r in kept:
        c = columns[r["i"]]
        if len(r["v"]) > MOST_LEVELS:
            raise ValueError(f"{c} has over {MOST_LEVELS} values: it is no category")
        typed = df.sparkSession.createDataFrame([(v,) for v in r["v"]], "v string").select(F.col("v").cast(kinds[c])) if kinds[c] != "string" else None
        out[c] = sorted([x[0] for x in typed.collect()] if typed is not None else r["v"])
    return out


def levels(df: DataFrame, column: str) -> list:
    return levels_of(df, [column])[column]


def one_hot(df: DataFrame, columns: list[str], drop_first: bool = True) -> DataFrame:
    """<column>_<level> flags in place of each column; levels of all rows in order, the first dropped. Null is no level."""
    for c, found in levels_of(df, columns).items():
        df = df.select("*", *[F.coalesce(F.col(c) == F.lit(v), F.lit(False)).cast("int").alias(f"{c}_{v}") for v in found[int(drop_first) :]]).drop(c)
    return df


def missing_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """<column>:missing, for columns that have a null anywhere."""
    some = df.agg(*[F.max(F.col(c).isNull().cast("int")).alias(c) for c in columns]).first()
    return df.withColumns({f"{c}:missing": F.col(c).isNull().cast("int") for c in columns if some[c]})


def exact_quantiles(df: DataFrame, columns: list[str], q: float = 0.5, accuracy: int = 10_000) -> dict[str, float | None]:
    """Each column's quantile, between its two neighbours in proportion; null without values. An approximate pass brackets
    it, a second one counts what is below the bracket and each distinct value within, about 4 / accuracy of the rows: no
    task holds all values of a column."""
    edges = F.array(F.lit(max(q - 2 / accuracy, 0.0)), F.lit(min(q + 2 / accuracy, 1.0)))
    value = {c: F.col(f"`{c}`").cast("double") for c in columns}
    first = df.agg(*[F.percentile_approx(value[c], edges, accuracy).alias(f"e{i}") for i, c in enumerate(columns)], *[F.count(value[c]).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    known = {c: (first[f"e{i}"], first[f"n{i}"]) for i, c in enumerate(columns) if first[f"n{i}"]}
    if not known:
        return dict.fromkeys(columns)
    # what is below the bracket, or above, is counted together; of the latter the least may be the upper neighbour
    side = lambda c: F.when(value[c] < known[c][0][0], F.lit(float("-inf"))).when(value[c] > known[c][0][1], F.lit(float("inf"))).otherwise(value[c])
    cells = F.array(*[F.when(value[c].isNotNull(), F.struct(F.lit(c).alias("feature"), side(c).alias("value"), value[c].alias("v"))) for c in known])
    counts = df.select(F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("x")).groupBy("x.feature", "x.value").agg(F.count(F.lit(1)).alias("n"), F.min("x.v").alias("least"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("feature").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.create_map(*[F.lit(x) for c, (_, n) in known.items() for x in (c, q * (n - 1))])
    rank = F.element_at(place, F.col("feature"))
    counts = counts.withColumn("before", before)
    hit = lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("n"))
    rows = counts.where(hit(F.floor(rank)) | hit(F.ceil(rank))).select("feature", F.col("least").alias("value"), hit(F.floor(rank)).alias("lower"), hit(F.ceil(rank)).alias("upper")).collect()
    found = {}
    for c, (_, n) in known.items():
        a, b = (next(r["value"] for r in rows if r["feature"] == c and r[side]) for side in ("lower", "upper"))
        share = q * (n - 1) % 1
        found[c] = a if a == b else a * (1 - share) + b * share
    return {c: found.get(c) for c in columns}


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    return exact_quantiles(df, columns)


def impute_median(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Nulls become the median of the training rows."""
    fills = medians(df.where(train), columns)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(fills[c])) for c in columns})


def impute_implausible(df: DataFrame, column: str, low: float, high: float, measured: Column, train: Column) -> DataFrame:
    """What is not measured, null or outside [low, high] becomes the median of the training rows' usable values."""
    usable = measured & F.coalesce(F.col(column).between(low, high), F.lit(False))
    fill = medians(df.where(train & usable), [column])[column]
    return df.withColumn(column, F.when(usable, F.col(column)).otherwise(F.lit(fill)))


def filter_steps(df: DataFrame, steps: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The rows that pass every step, and (step, rows) left after each, from one pass."""
    passed, counts = F.lit(True), [F.count(F.lit(1)).alias("all rows")]
    for name, condition in steps.items():
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(passed).alias(name))
    names = ["all rows", *steps]
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("step"), F.col(f"`{n}`").alias("rows")) for i, n in enumerate(names)]))
    return df.where(passed), df.agg(*counts).select(pairs.alias("x")).select("x.*")


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n_null, n_distinct, null_share), in one pass over the table's long form."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    n = F.count(F.lit(1))
    return long.groupBy("feature").agg(F.count_if(F.col("value").isNull()).alias("n_null"), F.count_distinct("value").alias("n_distinct"), (F.count_if(F.col("value").isNull()) / n).alias("null_share"))


def sparse_columns(df: DataFrame, columns: list[str], most: float = 0.85) -> list[str]:
    """Columns whose share of nulls is over `most`."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is not None and row[c] > most]


def constant_columns(df: DataFrame, columns: list[str]) -> list[str]:
    row = df.agg(*[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def duplicate_columns(df: DataFrame, columns: list[str], row_id: list[str]) -> list[tuple[str, str]]:
    """(column, earlier column that it equals in every row). Order-independent hashes of (row, value) find them in one
    pass; each is then confirmed."""
    code = [F.sum(F.xxhash64(*row_id, F.col(c).cast("double")).cast("decimal(38,0)")).alias(c) for c in columns]
    codes, first = df.agg(*code).first().asDict(), {}
    pairs = [(c, first[codes[c]]) for c in columns if first.setdefault(codes[c], c) != c]
    if not pairs:
        return []
    same = df.agg(*[F.every(F.col(a).cast("double").eqNullSafe(F.col(b).cast("double"))).alias(str(i)) for i, (a, b) in enumerate(pairs)]).first()
    return [p for i, p in enumerate(pairs) if same[i]]


def rare_flags(df: DataFrame, columns: list[str], least: float, keep: list[str] = ()) -> list[str]:
    """Flags with a share of ones under `least`, but for those to keep."""
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first()
    return [c for c in columns if c not in keep and (row[c] or 0.0) < least]


def validated_left_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join that fails unless the key is unique on both sides."""
    for name, side in (("left", left), ("right", right)):
        if not side.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            raise ValueError(f"{key} is not unique in the {name} table")
    return left.join(right, key, "left")


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; order must be total."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_at = 1").drop("_at")


def first_values(df: DataFrame, keys: list[str], columns: list[str], order: Column) -> DataFrame:
    """Each column's first non-null value of each key, by order: an aggregate, without a sort."""
    return df.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns])


def moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column; a deviation of zero counts as one."""
    row = df.agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in columns}


def standardise(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    fit = moments(df.where(train), columns)
    return df.withColumns({c: (F.col(c) - F.lit(fit[c][0])) / F.lit(fit[c][1]) for c in columns})


def stratified_folds(df: DataFrame, label: str, row_id: str, k: int = 3, seed: int = 42) -> DataFrame:
    """fold 0..k-1: rows of a class in hashed order, dealt in turn. A class may have most of the rows: their places are
    found by ranges. Row ids are distinct within a class."""
    at = F.struct(hash_uniform(seed, "fold", F.col(row_id)).alias("u"), F.col(row_id).alias("id"))
    placed = prefix_sums(df.withColumns({"_at": at, "_one": F.lit(1).cast("long")}), [label], "_at", {"_i": "_one"})
    return placed.withColumn("fold", (F.col("_i") % k).cast("int")).drop("_at", "_one", "_i")


def hashed_split(df: DataFrame, row_id: str, share: float = 0.7, seed: int = 42) -> DataFrame:
    """train: whether a row's draw is below the share. Needs no shuffle, and a row keeps its side as others come."""
    return df.withColumn("train", hash_uniform(seed, "split", F.col(row_id)) < share)


def sequential_split(df: DataFrame, order: list[str], share: float = 0.7, buckets: int = 64) -> DataFrame:
    """train: the first floor(share * n) rows by order. The cut is found in a histogram of the first order column, so
    that no task sorts the whole table."""
    cuts = df.agg(F.percentile_approx(order[0], [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col(order[0]))) if cuts else F.lit(0)
    some = df.withColumn("_b", bucket)
    counts = {r["_b"]: r["n"] for r in some.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for b in sorted(counts):
        before[b], total = total, total + counts[b]
    start = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("_b")) if before else F.lit(0)
    at = F.row_number().over(Window.partitionBy("_b").orderBy(*order)) + start
    return some.withColumn("train", at <= int(share * total)).drop("_b")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other has not, with duplicates counted, and the side they are on."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def value_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total")))).select(*columns, "n", ratio(F.col("n"), F.col("total").cast("double")).alias("share"))


def class_means(df: DataFrame, flags: list[str], label: str) -> DataFrame:
    """(feature, prevalence, mean_positive, mean_negative), in one pass."""
    long = df.select(label, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in flags])).alias("x")).select(label, "x.*")
    of = lambda y: F.avg(F.when(F.col(label) == y, F.col("value")))
    return long.groupBy("feature").agg(F.avg("value").alias("prevalence"), of(1).alias("mean_positive"), of(0).alias("mean_negative"))


def redundant_flag(df: DataFrame, flag: str, value: str) -> bool:
    """Whether the flag is one exactly where the value is above zero."""
    return df.agg(F.every((F.col(value) > 0) == (F.col(flag) == 1))).first()[0]


def concat_ordered(parts: list[DataFrame]) -> DataFrame:
    """All rows, with the ordinal of the part they come from; columns by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])


def nonzero_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """1 where a value is not zero; null stays null."""
    return df.withColumns({c: (F.col(c) != 0).cast("int") for c in columns})


def row_sum(df: DataFrame, out: str, columns: list[str]) -> DataFrame:
    """A column with the sum of others, row by row; null if one of them is."""
    return df.withColumn(out, reduce(lambda a, b: a + b, [F.col(c) for c in columns]))


def exclude_codes(df: DataFrame, column: str, codes: list) -> DataFrame:
    """Rows whose code is not in the list; a null code is in no list."""
    return df.where(~F.coalesce(F.col(column).isin(codes), F.lit(False)))


def member_flag(df: DataFrame, out: str, column: str, members: list) -> DataFrame:
    """1 where the value is one of the members; a null is none."""
    return df.withColumn(out, F.coalesce(F.col(column).isin(members), F.lit(False)).cast("int"))


def complete_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without a null."""
    return df.na.drop(subset=columns)


def official_split(df: DataFrame, column: str, names: list[str]) -> dict[str, DataFrame]:
    """A frame for each name of an official split; fails if the column holds another one."""
    if not df.where(F.col(column).isNull() | ~F.col(column).isin(names)).isEmpty():
        raise ValueError(f"{column} has values other than {names}")
    return {n: df.where(F.col(column) == n).drop(column) for n in names}
