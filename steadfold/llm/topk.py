"""Exact top-k inner-product search: tiled matrix products, partial selection, tree merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh_path, stash

LONG = np.iinfo(np.int64)


def quantise(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of every component, as whole doubles."""
    return np.floor(scale * vectors.astype(np.float64))


def scores(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Exact integer inner products. Doubles hold them up to 2**53; beyond that Python's integers do, and
    what a long cannot hold becomes its nearest end."""
    most = max(np.abs(queries).max(initial=0), 1) * max(np.abs(tile).max(initial=0), 1) * max(queries.shape[1], 1)
    if most < 2**53:
        return (queries @ tile.T).astype(np.int64)
    wide = lambda a: np.array([[int(x) for x in row] for row in a], dtype=object).reshape(a.shape)
    exact = wide(queries) @ wide(tile).T
    return np.array([[min(max(int(x), LONG.min), LONG.max) for x in row] for row in exact], dtype=np.int64).reshape(len(queries), len(tile))


def select(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, by score and then by the smaller id. ids is (columns,) or like score."""
    n = score.shape[1]
    ids = np.broadcast_to(ids, score.shape)
    if n > k:  # a row's kth score bounds it; only columns that reach it in some row are sorted
        bound = np.partition(score, n - k, axis=1)[:, n - k, None]
        reach = score >= bound
        if int(reach.sum(axis=1).max()) == k:
            at = np.nonzero(reach)[1].reshape(len(score), k)
        else:  # ties at the bound: the smaller ids among them
            at = np.stack([np.nonzero(r)[0][np.lexsort((i[r], ~s[r]))[:k]] for r, s, i in zip(reach, score, ids)])
        score, ids = np.take_along_axis(score, at, 1), np.take_along_axis(ids, at, 1)
    order = np.lexsort((ids, ~score), axis=1)  # ~score descends with score and cannot overflow
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def _finite(vector: str) -> Column:
    inf = float("inf")
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != inf))


def _best_in_part(batches: Iterator[pa.RecordBatch], block, k: int, scale: float, tile_rows: int) -> Iterator[pa.RecordBatch]:
    """One list of k for each query of the block and dimension, from all rows of this partition."""
    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    by_dim = block.value
    for batch in batches:
        lists = batch.column(1)
        sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
        ids, starts = batch.column(0).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
        for dim in np.unique(sizes):
            if int(dim) not in by_dim:
                continue
            query_ids, queries = by_dim[int(dim)]
            rows = np.nonzero(sizes == dim)[0]
            for at in range(0, len(rows), tile_rows):
                part = rows[at : at + tile_rows]
                tile = quantise(flat[starts[part][:, None] + np.arange(dim)], scale)
                for low in range(0, len(queries), tile_rows):
                    mine = slice(low, low + tile_rows)
                    got = scores(queries[mine], tile)
                    own = query_ids[mine, None] == ids[part][None, :]
                    key = (int(dim), low)
                    s, i = got, np.broadcast_to(ids[part], got.shape)
                    if own.any():  # the query's own row takes the lowest place and goes at the end
                        s = np.where(own, LONG.min, s)
                        i = np.where(own, LONG.max, i)
                    if key in kept:
                        s, i = np.concatenate([kept[key][0], s], axis=1), np.concatenate([kept[key][1], i], axis=1)
                    kept[key] = select(s, i, k)
    shard = TaskContext.get().partitionId()
    for (dim, low), (s, i) in kept.items():
        q = np.repeat(by_dim[dim][0][low : low + tile_rows], s.shape[1])
        s, i = s.ravel(), i.ravel()
        real = (i != LONG.max) | (s != LONG.min)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(real.sum(), shard, np.int64)), pa.array(q[real]), pa.array(i[real]), pa.array(s[real])], ["shard", "query_id", "vec_id", "score"])


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, block_rows: int = 8192, tile_rows: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row that is_query holds for, its k best other rows: query_id, rank, vec_id, score.

    Queries go out in blocks of about block_rows, whatever their number; each block is multiplied with all rows in
    one job, tile by tile, and a partition gives back k rows a query. Those lists are merged by groups of shards,
    then together. Vectors that are null or hold null, NaN or infinity take no part, nor do rows with a null id;
    vectors of different length are not compared. Of rows that share a query's id none is its candidate, and such
    an id is answered for the smallest of its vectors; other repeated ids are candidates once for each row. A score
    that no long can hold is its nearest end. Other columns take no part, whatever their names.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("_q"))
    rows = rows.where(F.col("vec_id").isNotNull() & _finite("v"))
    queries = stash(rows.where("_q").groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n_blocks = max(1, -(-queries.count() // block_rows))
    lists = fresh_path(spark, "lists")
    for b in range(n_blocks):  # one block is on the driver and out with the executors at a time
        by_dim: dict[int, tuple[list, list]] = {}
        for r in queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).toLocalIterator():
            ids, vs = by_dim.setdefault(len(r.v), ([], []))
            ids.append(r.vec_id)
            vs.append(r.v)
        block = spark.sparkContext.broadcast({d: (np.array(ids, np.int64), quantise(np.array(vs, np.float64).reshape(len(ids), d), scale)) for d, (ids, vs) in by_dim.items()})
        found = rows.select("vec_id", "v").mapInArrow(lambda it, block=block: _best_in_part(it, block, k, scale, tile_rows), "shard long, query_id long, vec_id long, score long")
        found.write.parquet(f"{lists}/block={b}")
        block.destroy()
    best = spark.read.schema("shard long, query_id long, vec_id long, score long").parquet(lists)
    order = [F.desc("score"), F.asc("vec_id")]
    group = Window.partitionBy("query_id", F.col("shard") % 64).orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= k).drop("rank")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
