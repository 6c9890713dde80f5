"""Rank metrics under many weightings at once: sums over rows are vectors with a place for each weighting.

A weighting is a function of a few numbers of a row. Rows go through with those numbers, are cut into ranges of their score
once, and a block of rows meets all weightings in one array operation: no row is repeated for a weighting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..sources.staging import staged

#: Rows of a block: with 2,000 weightings it takes 16 MB.
BLOCK = 1024

#: A score that so many rows of a batch share is summed before rows are exchanged; at most HELD of them at a time.
SHARED, HELD = 64, 256

#: Records of a range, about: a task of the second pass holds one range.
RANGE = 1 << 18

NAMES = ["model", "p", "y", "t", "neg", "pos"]
RECORD = "model string, p double, y int, t array<double>, neg binary, pos binary"

#: From the numbers of some rows, (rows, numbers), to their weights, (rows, weightings).
Weigh = Callable[[np.ndarray], np.ndarray]


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long arrays of numbers; missing ones are nan."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _with_shared(weigh: Weigh, n_weights: int):
    """Sums the rows of scores that many rows share, in a task, to one record with a vector for each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, float], np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            n = len(held)
            sums = list(held.values())
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.float64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.float64())), *(pa.array([s[c].tobytes() for s in sums], pa.binary()) for c in (0, 1))], NAMES)

        for batch in batches:
            models, p = batch.column(0).dictionary_encode(), batch.column(1).to_numpy(zero_copy_only=False)
            code = models.indices.to_numpy(zero_copy_only=False)
            pairs, back, counts = np.unique(np.stack([code, p.view(np.int64)]), axis=1, return_inverse=True, return_counts=True)
            often = counts >= SHARED
            if often.any():
                y, x = batch.column(2).to_numpy(zero_copy_only=False), matrix(batch.column(3))
                for g in np.nonzero(often)[0]:
                    mine = np.nonzero(back.ravel() == g)[0]
                    key = (models.dictionary[int(pairs[0, g])].as_py(), float(pairs[1, g : g + 1].view(np.float64)[0]))
                    total = held.setdefault(key, np.zeros((2, n_weights)))
                    for low in range(0, len(mine), BLOCK):
                        at = mine[low : low + BLOCK]
                        w = weigh(x[at])
                        total[1] += w[y[at] == 1].sum(axis=0)
                        total[0] += w[y[at] == 0].sum(axis=0)
                    if len(held) >= HELD:
                        yield flush()
                        held.clear()
                batch = batch.filter(pa.array(~often[back.ravel()]))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], NAMES)
        if held:
            yield flush()

    return run


def _class_sums(table: pa.Table, weigh: Weigh, n_weights: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(neg, pos), (scores, scenarios) each, for the distinct scores of records in ascending order, some at a time."""
    table = table.sort_by("p").combine_chunks()
    n = table.num_rows
    if not n:
        return
    p, y = table["p"].to_numpy(), table["y"].fill_null(-1).to_numpy()
    vectors, lists = [table[c].combine_chunks() for c in ("neg", "pos")], table["t"].combine_chunks()
    cuts = np.concatenate([[0], np.nonzero(np.diff(p))[0] + 1, [n]])
    i = 0
    while i + 1 < len(cuts):
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + BLOCK, side="right")) - 1)
        sums = np.zeros((2, j - i, n_weights))
        for low in range(cuts[i], cuts[j], BLOCK):  # one score may have more rows than a block
            at = np.arange(low, min(low + BLOCK, cuts[j]))
            place = np.searchsorted(cuts, at, side="right") - 1 - i
            plain = y[at] >= 0
            if plain.any():
                w, starts = weigh(matrix(lists.take(pa.array(at[plain])))), np.nonzero(np.diff(place[plain], prepend=-1))[0]
                for c in (0, 1):
                    sums[c, place[plain][starts]] += np.add.reduceat(w * (y[at[plain], None] == c), starts, axis=0)
            for k in np.nonzero(~plain)[0]:
                for c in (0, 1):
                    sums[c, place[k]] += np.frombuffer(vectors[c][int(at[k])].as_py())
        yield sums[0], sums[1]
        i = j


def range_starts(sums: DataFrame, key: str) -> DataFrame:
    """(key, range, s): of each range and weighting, the sums by class below it and of the whole key. sums: key, range, neg and
    pos, arrays with a place for each weighting; any number of rows to a range. They are staged by range."""
    each = sums.select(key, "range", F.posexplode(F.arrays_zip("neg", "pos")).alias("at", "x")).groupBy(key, "range", "at").agg(F.sum("x.neg").alias("neg"), F.sum("x.pos").alias("pos"))
    each = staged(each, "range_sums")
    whole = Window.partitionBy(key, "at")
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(key, "range", "at", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"{c}_below") for c in ("neg", "pos")], *[F.sum(c).over(whole).alias(f"{c}_all") for c in ("neg", "pos")])
    return each.groupBy(key, "range").agg(F.array_sort(F.collect_list(F.struct("at", "neg_below", "pos_below", "neg_all", "pos_all"))).alias("s"))


def start_arrays(starts: pa.Table) -> tuple[np.ndarray, ...]:
    """neg_below, pos_below, neg_all and pos_all of a row of range_starts()."""
    s = starts["s"].combine_chunks().flatten()
    return tuple(s.field(c).to_numpy().copy() for c in ("neg_below", "pos_below", "neg_all", "pos_all"))


def range_shares(sums: Iterator[tuple[np.ndarray, np.ndarray]], starts: tuple[np.ndarray, ...]) -> dict[str, np.ndarray]:
    """A range's share of the area and of the average precision, and its key's sums. sums: (neg, pos) of its scores, ascending."""
    neg_below, pos_below, neg_all, pos_all = starts
    area, average = np.zeros(len(neg_all)), np.zeros(len(neg_all))
    for neg, pos in sums:
        neg_to, pos_to = neg_below + np.cumsum(neg, axis=0), pos_below + np.cumsum(pos, axis=0)
        area += (pos * (neg_to - neg / 2)).sum(axis=0)
        above_pos, above_neg = pos_all - pos_to + pos, neg_all - neg_to + neg
        with np.errstate(all="ignore"):
            average += np.nan_to_num(pos * (above_pos / (above_pos + above_neg)), nan=0.0).sum(axis=0)
        neg_below, pos_below = neg_to[-1], pos_to[-1]
    return {"area": area, "average": average, "neg_all": neg_all, "pos_all": pos_all}


def vector_scores(records: DataFrame, weigh: Weigh, n_weights: int, n_records: int | None = None) -> DataFrame:
    """(model, at, roc_auc, pr_auc) for each model and weighting. records: model, p, y (0 or 1), t (an array of numbers).

    Records are cut into ranges of (model, p) and staged once, when this is called. One pass sums each range's weights by
    class; running sums over ranges go in front of a second pass, which takes every range's share of the area and of
    the average precision. Scores that many rows share are summed before the cut. Null where a class has no weight.
    There are as many ranges as keep one to RANGE records or so, where there are more than a few. n_records: how many
    records there are; counted if not given."""
    n = -(-(records.count() if n_records is None else n_records) // RANGE)
    ranges = [max(n, records.sparkSession.sparkContext.defaultParallelism)] if n > 8 else []
    made = records.select("model", (F.col("p") + F.lit(0.0)).alias("p"), "y", "t").mapInArrow(_with_shared(weigh, n_weights), RECORD)
    cut = staged(made.repartitionByRange(*ranges, "model", "p").withColumn("range", F.spark_partition_id()), "records")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = table.group_by(["model", "range"]).aggregate([])
            for model, at in zip(keys["model"].to_pylist(), keys["range"].to_pylist()):
                some = table.filter((pa.compute.field("model") == model) & (pa.compute.field("range") == at))
                sums = held.setdefault((model, at), np.zeros((2, n_weights)))
                for neg, pos in _class_sums(some, weigh, n_weights):
                    sums[0] += neg.sum(axis=0)
                    sums[1] += pos.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in held], pa.string()), pa.array([r for _, r in held], pa.int32()), *(pa.array([s[c].tolist() for s in held.values()], pa.list_(pa.float64())) for c in (0, 1))], ["model", "range", "neg", "pos"])

    # a row for a model and range (there are about as many as ranges and models), with a place for each weighting
    starts = range_starts(cut.mapInArrow(totals, "model string, range int, neg array<double>, pos array<double>"), "model")

    def shares(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = range_shares(_class_sums(left, weigh, n_weights), start_arrays(right))
        return pa.table({"model": pa.array([key[0].as_py()] * n_weights, pa.string()), "at": pa.array(np.arange(n_weights, dtype=np.int32)), **found})

    parts = cut.groupBy("model", "range").cogroup(starts.groupBy("model", "range")).applyInArrow(shares, "model string, at int, area double, average double, neg_all double, pos_all double")
    scored = parts.groupBy("model", "at").agg(F.sum("area").alias("area"), F.sum("average").alias("average"), F.first("neg_all").alias("neg"), F.first("pos_all").alias("pos"))
    return scored.select("model", "at", ratio(F.col("area"), F.col("pos") * F.col("neg")).alias("roc_auc"), F.when(F.col("neg") > 0, ratio(F.col("average"), F.col("pos"))).alias("pr_auc"))
