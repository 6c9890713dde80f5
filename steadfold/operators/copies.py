"""Rank metrics of many corrupted copies of a table: copies are scored in flight, and of each copy, model and range of scores
a task passes on two packed arrays of scores, one for each class. Eight bytes a score are written once and exchanged once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..sources.staging import staged
from .model import Package, score_column

#: Rows of copies that a task holds before it packs them: with six models 60 MB.
HELD = 1 << 20

#: Rows to a range of scores.
RANGE = 1 << 18

PACKED = "cell int, model int, range int, n_neg long, n_pos long, neg binary, pos binary"


def score_cuts(preds: DataFrame, packages: dict[str, Package], rows: int = RANGE) -> dict[str, list[float]]:
    """Scores of each model that cut its predictions (model, p) into ranges of about so many rows. Approximate ones do: a
    cut anywhere gives the same metrics."""
    most = preds.groupBy("model").count().agg(F.max("count")).first()[0] or 0
    n = -(-most // rows)
    if n < 2:
        return dict.fromkeys(packages, [])
    at = F.array(*[F.lit(i / n) for i in range(1, n)])
    found = preds.groupBy("model").agg(F.percentile_approx("p", at).alias("cuts")).collect()  # a row for a model
    return {r["model"]: sorted(set(r["cuts"])) for r in found}


def _packed(cuts: list[np.ndarray], held_rows: int):
    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        cell, y = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        for m, edges in enumerate(cuts):
            p = np.concatenate([h[2 + m] for h in held])
            code = (cell * (len(edges) + 1) + np.searchsorted(edges, p, side="right")) * 2 + y
            order = np.argsort(code, kind="stable")
            code, p = code[order], p[order]
            keys, starts = np.unique(code // 2, return_index=True)
            ends = np.append(starts[1:], len(code))
            middles = np.searchsorted(code, keys * 2 + 1)
            n = len(keys)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((keys // (len(edges) + 1)).astype(np.int32)), pa.array(np.full(n, m, np.int32)), pa.array((keys % (len(edges) + 1)).astype(np.int32)),
                    pa.array(middles - starts), pa.array(ends - middles),
                    pa.array([p[a:b].tobytes() for a, b in zip(starts, middles)], pa.binary()), pa.array([p[a:b].tobytes() for a, b in zip(middles, ends)], pa.binary()),
                ],
                ["cell", "model", "range", "n_neg", "n_pos", "neg", "pos"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held.append((columns[0].astype(np.int64), columns[1].astype(np.int64), *(c.astype(np.float64) for c in columns[2:])))
            n += batch.num_rows
            if n >= held_rows:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return run


def _shares(key: tuple, table: pa.Table) -> pa.Table:
    neg, pos = (np.sort(np.frombuffer(b"".join(table[c].to_pylist()), np.float64)) for c in ("neg", "pos"))
    neg_below, pos_below, neg_all, pos_all = (table[c][0].as_py() for c in ("neg_below", "pos_below", "neg_all", "pos_all"))
    at, counts = np.unique(pos, return_counts=True)
    under, upto = neg_below + np.searchsorted(neg, at), neg_below + np.searchsorted(neg, at, side="right")
    above_pos, above_neg = pos_all - pos_below - np.cumsum(counts) + counts, neg_all - under
    area, average = float((counts * ((under + upto) / 2)).sum()), float((counts * (above_pos / (above_pos + above_neg))).sum())
    return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "model": pa.array([key[1].as_py()], pa.int32()), "area": [area], "average": [average], "n_neg": pa.array([neg_all], pa.int64()), "n_pos": pa.array([pos_all], pa.int64())})


def copy_scores(copies: DataFrame, packages: dict[str, Package], cuts: dict[str, list[float]], cell: str = "cell", y: str = "y", held_rows: int = HELD) -> DataFrame:
    """(cell, model, roc_auc, pr_auc), as rank_metrics() has them, of every model on every copy. copies: rows with the number
    of their copy, a label and the models' features. cuts: of each model's scores, see score_cuts(). Null where a class
    has no row.

    Packed scores are staged when this is called. Counts of ranges go in front; then a task takes one range of one copy
    and model at a time."""
    names = list(packages)
    made = copies.where(F.col(y).isin(0, 1)).select(F.col(cell).cast("int").alias("cell"), F.col(y).cast("int").alias("y"), *[score_column(packages[n]).alias(f"p{i}") for i, n in enumerate(names)])
    packed = staged(made.mapInArrow(_packed([np.array(cuts[n], np.float64) for n in names], held_rows), PACKED), "packed")
    whole = Window.partitionBy("cell", "model")
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = packed.groupBy("cell", "model", "range").agg(F.sum("n_neg").alias("neg"), F.sum("n_pos").alias("pos"))  # a row for a copy, model and range
    starts = sums.select("cell", "model", "range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_below") for c in ("neg", "pos")], *[F.sum(c).over(whole).alias(f"{c}_all") for c in ("neg", "pos")])
    parts = packed.drop("n_neg", "n_pos").join(F.broadcast(starts), ["cell", "model", "range"]).groupBy("cell", "model", "range").applyInArrow(_shares, "cell int, model int, area double, average double, n_neg long, n_pos long")
    scored = parts.groupBy("cell", "model").agg(F.sum("area").alias("area"), F.sum("average").alias("average"), F.first("n_neg").alias("neg"), F.first("n_pos").alias("pos"))
    name = F.get(F.array(*[F.lit(n) for n in names]), F.col("model"))
    return scored.select("cell", name.alias("model"), ratio(F.col("area"), F.col("pos").cast("double") * F.col("neg")).alias("roc_auc"), F.when(F.col("neg") > 0, ratio(F.col("average"), F.col("pos").cast("double"))).alias("pr_auc"))
