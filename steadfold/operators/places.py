"""Where rows stand in the order of a value, without a join on the value and without a task that sees all rows of a key.

Rows are cut into ranges of (keys, value, a hash of the row), so a value that most rows have has most of the ranges. What a
range needs to know of the others comes as a few rows: offsets of the keys that reach into it, and the sums of the values at
its borders, which alone can go on in the next one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


def _on(left_keys: list[str], prefix: str) -> Column:
    same = F.lit(True)
    for k in left_keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return same


def placed(df: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """df with _below, _same and _all: the sums of weight (a whole number; 1 unless given) over rows of the same keys with a
    smaller value, with the same one, and over all. Nulls are a value of their own, below all others.

    Runs when it is called, up to the ranges; the rest is broadcasts of at most two rows for a range."""
    plain = [c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
    rows = df.withColumns({"_w": F.lit(1).cast("long") if weight is None else weight.cast("long"), "_salt": F.xxhash64(F.spark_partition_id(), *plain)})
    rows = rows.repartitionByRange(*keys, value, "_salt").withColumn("_b", F.spark_partition_id()).drop("_salt")
    inside, ties, part = Window.partitionBy("_b", *keys).orderBy(value), Window.partitionBy("_b", *keys, value), Window.partitionBy("_b", *keys)
    rows = staged(rows.withColumns({"_upto": F.sum("_w").over(inside), "_n": F.sum("_w").over(ties), "_t": F.sum("_w").over(part)}), "places")
    at = F.struct(F.col(value).isNotNull().alias("real"), F.col(value).alias("v"))
    ends = rows.groupBy("_b", *keys).agg(F.first("_t").alias("t"), F.min(at).alias("low"), F.max(at).alias("high"), F.min_by("_n", at).alias("n_low"), F.max_by("_n", at).alias("n_high"))
    key = Window.partitionBy(*keys)
    ends = ends.withColumns({"off": F.coalesce(F.sum("t").over(key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "all": F.sum("t").over(key), "pieces": F.count(F.lit(1)).over(key)})
    ends = staged(ends.where("pieces > 1").drop("pieces"), "ends")  # keys with rows in several ranges: two rows for a range at most
    starts = ends.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_kb"), "off", "all")
    border = F.array(F.struct(F.col("high.v").alias("v"), F.col("n_high").alias("n"), (F.col("off") + F.col("t") - F.col("n_high")).alias("below")), F.when(~F.col("low").eqNullSafe(F.col("high")), F.struct(F.col("low.v").alias("v"), F.col("n_low").alias("n"), F.col("off").alias("below"))))
    border = ends.select(*keys, F.explode(F.filter(border, lambda x: x.isNotNull())).alias("x")).groupBy(*keys, F.col("x.v").alias("_v")).agg(F.sum("x.n").alias("_vn"), F.min("x.below").alias("_vb"))
    border = border.select(*[F.col(k).alias(f"_v_{k}") for k in keys], "_v", "_vn", "_vb", F.lit(True).alias("_is"))
    out = rows.join(F.broadcast(starts), (F.col("_b") == F.col("_kb")) & _on(keys, "_k_"), "left").join(F.broadcast(border), F.col(value).eqNullSafe(F.col("_v")) & _on(keys, "_v_"), "left")
    below = F.when(F.col("_is"), F.col("_vb")).otherwise(F.coalesce("off", F.lit(0)) + F.col("_upto") - F.col("_n"))
    return out.select(*df.columns, below.alias("_below"), F.when(F.col("_is"), F.col("_vn")).otherwise(F.col("_n")).alias("_same"), F.coalesce("all", "_t").alias("_all"))


def _undominated(keys: list[str], x: str, y: str):
    """Drops rows of a batch that another of its rows dominates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            a, b = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.float64) for c in (x, y))
            group = np.zeros(n, np.int64)
            for k in keys:
                code = batch.column(batch.schema.get_field_index(k)).dictionary_encode(null_encoding="encode").indices.to_numpy()
                group = np.unique(group * (int(code.max(initial=0)) + 1) + code, return_inverse=True)[1]
            order = np.lexsort((-b, -a, group))
            g, a, b = group[order], a[order], b[order]
            fresh = np.ones(n, bool)  # the first row of a point
            fresh[1:] = (g[1:] != g[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            first = np.nonzero(fresh)[0]
            gf, bf = g[first], b[first]
            stays = np.ones(len(first), bool)
            for low, high in zip(np.searchsorted(gf, np.unique(gf)), np.searchsorted(gf, np.unique(gf), side="right")):
                top = np.maximum.accumulate(bf[low:high])
                stays[low + 1 : high] = bf[low + 1 : high] > top[:-1]
            keep = np.sort(order[stays[np.cumsum(fresh) - 1]])
            yield batch.take(pa.array(keep))

    return run


def undominated(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """The rows of df that no other row of the keys dominates: none has as much of both and more of one. Rows equal in
    both stay together; rows with a null are on no front.

    Fronts are found within batches first. What is left is cut into ranges of falling x; within a range a row stays if no
    row before it has as much y, and then if no range before it has. Runs when it is called, up to the ranges."""
    some = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if all(dict(df.dtypes)[c] in ("double", "float", "int", "smallint", "tinyint") for c in (x, y)):
        some = some.mapInArrow(_undominated(keys, x, y), df.schema)
    some = some.repartitionByRange(*keys, F.desc(x)).withColumn("_b", F.spark_partition_id())
    most = F.max(F.struct(F.col(y).alias("y"), F.col(x).alias("x"))).over(Window.partitionBy("_b", *keys).orderBy(F.desc(x)))
    some = staged(some.withColumn("_m", most).where((F.col("_m.y") == F.col(y)) & (F.col("_m.x") == F.col(x))).drop("_m"), "fronts")
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    above = some.groupBy("_b", *keys).agg(F.max(y).alias("_top")).withColumn("_above", F.max("_top").over(before)).where("_above IS NOT NULL")
    above = above.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_kb"), "_above")  # a row for a range at most
    out = some.join(F.broadcast(above), (F.col("_b") == F.col("_kb")) & _on(keys, "_k_"), "left")
    return out.where(F.col("_above").isNull() | (F.col(y) > F.col("_above"))).select(*df.columns)
