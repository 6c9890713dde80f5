"""Exact k-means on whole numbers by exponion search: bounds say which vectors must look again, and rings around their
own centroid which centroids these look at."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_path, remove_path

#: Far more than the rounding of a square root and the few sums after it: bounds are widened by this share, so that what
#: they rule out is ruled out in exact numbers too.
SLACK = 1e-12

TILE = "tile long, ids array<long>, kind string, vectors binary"
STATE = "tile long, cluster binary, upper binary, lower binary, moved string, distance array<long>"
LONG_MAX = np.iinfo(np.int64).max


def pack(whole: np.ndarray) -> tuple[str, bytes]:
    """Whole doubles in the smallest kind of number that holds them."""
    most = np.abs(whole).max(initial=0)
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    return kind, whole.astype(kind).tobytes()


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances: doubles where they hold them, else Python's integers."""
    if vectors.dtype == object:
        return ((vectors - centroid) ** 2).sum(axis=1)
    away = vectors - centroid
    return np.einsum("ij,ij->i", away, away)


@dataclass
class Centroids:
    """What a round sends out, k rows: the centroids, how far each has moved, and for each one the others by distance."""

    points: list[list[int]]
    moved: np.ndarray  # of each
    others_moved: np.ndarray  # the farthest that another one has moved
    order: np.ndarray  # (k, k - 1): the others, nearest first
    apart: np.ndarray  # their distances
    near: np.ndarray  # the nearest other's distance

    @staticmethod
    def of(points: list[list[int]], before: list[list[int]] | None) -> Centroids:
        k, exact = len(points), np.array(points, dtype=object).reshape(len(points), -1)
        root = lambda a: np.sqrt(np.array([float(x) for x in a]))
        moved = root(((exact - np.array(before, dtype=object).reshape(exact.shape)) ** 2).sum(axis=1)) if before else np.zeros(k)
        others = np.array([max((m for j, m in enumerate(moved) if j != i), default=0.0) for i in range(k)])
        order, apart = np.zeros((k, max(k - 1, 0)), np.int64), np.zeros((k, max(k - 1, 0)))
        for i in range(k):
            d = root(((exact - exact[i]) ** 2).sum(axis=1))
            order[i] = [j for j in np.lexsort((np.arange(k), d)) if j != i]
            apart[i] = d[order[i]]
        return Centroids(points, moved, others, order, apart, apart[:, 0] if k > 1 else np.full(k, np.inf))


def step(vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (of equally near ones the first), with bounds on the distances to it and to
    the second nearest. Bounds come from the round before; a vector whose upper bound is under both its lower bound
    and half the way to the nearest other centroid keeps its own. The rest measure their own distance u, and, if that
    is not enough, all centroids in the ball of radius 2u + the nearest other's distance around their own, its edge
    included: the nearest and the second nearest are in it."""
    points = np.array(c.points, dtype=object if vectors.dtype == object else np.float64).reshape(len(c.points), -1)
    cluster = cluster.copy()
    upper = (upper + c.moved[cluster]) * (1 + SLACK)
    lower = np.maximum(lower - c.others_moved[cluster] * (1 + SLACK), 0) * (1 - SLACK)
    safe = np.maximum(lower, c.near[cluster] / 2 * (1 - SLACK))
    look = np.nonzero(~(upper < safe))[0]
    for a in np.unique(cluster[look]):
        mine = look[cluster[look] == a]
        own = squared(vectors[mine], points[a])
        upper[mine] = np.sqrt(own.astype(np.float64)) * (1 + SLACK)
        still = ~(upper[mine] < safe[mine])
        mine, best, best_at = mine[still], own[still], np.full(int(still.sum()), a)
        second = np.full(len(mine), np.inf)
        within = np.searchsorted(c.apart[a], (2 * upper[mine] + c.near[a]) * (1 + SLACK), side="right")
        for rank in range(int(within.max(initial=0))):  # the list is sorted: who needs this rank needs all before it
            at = np.nonzero(within > rank)[0]
            j, d = c.order[a, rank], squared(vectors[mine[at]], points[c.order[a, rank]])
            wins = ((d < best[at]) | ((d == best[at]) & (j < best_at[at]))).astype(bool)
            second[at] = np.where(wins, best[at], np.minimum(second[at], d)).astype(np.float64)
            best[at], best_at[at] = np.where(wins, d, best[at]), np.where(wins, j, best_at[at])
        cluster[mine], upper[mine] = best_at, np.sqrt(best.astype(np.float64)) * (1 + SLACK)
        lower[mine] = np.sqrt(second) * (1 - SLACK)
    return cluster, upper, lower


def _unpack(kind: str, raw: bytes, n: int, points: list[list[int]]) -> np.ndarray:
    """The vectors as doubles, or as Python's integers where squared distances to the centroids might exceed 2**53."""
    vectors = np.frombuffer(raw, kind).astype(np.float64).reshape(n, -1)
    most = max(np.abs(vectors).max(initial=0), max((abs(x) for p in points for x in p), default=0))
    if float(most) ** 2 * 4 * max(vectors.shape[1], 1) < 2**53:
        return vectors
    return np.array([[int(x) for x in row] for row in vectors], dtype=object).reshape(vectors.shape)


def _tiles(rows: DataFrame, dims: int, scale: float, tile_rows: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            whole = np.floor(scale * batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, dims)
            for at in range(0, len(whole), tile_rows):
                kind, raw = pack(whole[at : at + tile_rows])
                ids = pa.array([batch.column(0).slice(at, tile_rows).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([first + n], pa.int64()), ids, pa.array([kind]), pa.array([raw], pa.binary())], ["tile", "ids", "kind", "vectors"])
                n += 1

    # In order, so that a task that runs again cuts the same tiles.
    return rows.sortWithinPartitions("vec_id", "v").mapInArrow(cut, TILE)


class _Tables:
    """Tables bucketed by tile: the vectors, written once, and the state of each round, joined without an exchange."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.buckets, self.paths = spark, int(spark.conf.get("spark.sql.shuffle.partitions")), {}

    def write(self, df: DataFrame) -> str:
        name = f"exponion_{uuid.uuid4().hex}"
        self.paths[name] = fresh_path(self.spark, name)
        df.write.bucketBy(self.buckets, "tile").sortBy("tile").option("path", self.paths[name]).format("parquet").saveAsTable(name)
        return name

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        remove_path(self.spark, self.paths.pop(name))


def _round(both: DataFrame, c: Centroids, last: bool) -> DataFrame:
    """The state after a round: bounds, and, for each cluster that a tile's vectors left or joined, the change of its count
    and sums. The last round has the exact distances instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, kind, raw, n, old, upper, lower in zip(*(batch.column(i).to_pylist() for i in range(7))):
                vectors = _unpack(kind, raw, n, c.points)
                before = np.frombuffer(old, "<i4").astype(np.int64) if old is not None else np.zeros(n, np.int64)
                u, low = (np.frombuffer(upper, "<f8"), np.frombuffer(lower, "<f8")) if old is not None else (np.full(n, np.inf), np.zeros(n))
                cluster, u, low = step(vectors, before, u, low, c)
                moved, distance = {}, None
                if last:
                    distance = np.zeros(n, dtype=object)
                    for a in np.unique(cluster):
                        distance[cluster == a] = [min(int(x), LONG_MAX) for x in squared(vectors[cluster == a], np.array(c.points[a], dtype=vectors.dtype))]
                else:
                    changed = np.nonzero(cluster != before)[0] if old is not None else np.arange(n)
                    for side, sign in ((before, -1), (cluster, 1)) if old is not None else ((cluster, 1),):
                        for a in np.unique(side[changed]):
                            mine = vectors[changed[side[changed] == a]]
                            total = [sign * len(mine), *(sign * int(x) for x in (mine.sum(axis=0) if mine.dtype == object or np.abs(mine).max(initial=0) * len(mine) < 2**53 else mine.astype(object).sum(axis=0)))]
                            moved[int(a)] = [x + y for x, y in zip(moved[int(a)], total)] if int(a) in moved else total
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tile], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (cluster.astype("<i4"), u.astype("<f8"), low.astype("<f8"))), pa.array([json.dumps(moved) if moved else None], pa.string()), pa.array([None if distance is None else distance.tolist()], pa.list_(pa.int64()))],
                    ["tile", "cluster", "upper", "lower", "moved", "distance"],
                )

    return both.select("tile", "kind", "vectors", F.size("ids").alias("n"), "cluster", "upper", "lower").mapInArrow(run, STATE)


def _added(moved: list[str]) -> dict[int, list[int]]:
    total: dict[int, list[int]] = {}
    for text in moved:
        for a, x in json.loads(text).items():
            total[int(a)] = [p + q for p, q in zip(total[int(a)], x)] if int(a) in total else x
    return total


def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list[int]] = {}
    for batch in batches:
        total = _added([json.dumps(total), *batch.column(0).to_pylist()])
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(total)], pa.string())], ["moved"])


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: float = 1024.0, dims: int = 64, seed: int = 3, tile_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) for each vector that takes part, and the final centroids.

    Vectors of exactly dims components, none null or non-finite, take part, in whole numbers floor(scale * x). The first
    centroids are the k vectors of least sha256(seed:vec_id), null ids and then the vectors themselves deciding last;
    fewer vectors give fewer. Each round assigns every vector to its nearest centroid (the first of equally near ones) and
    moves each centroid that has vectors to the floor of their mean. A last assignment follows. All numbers are exact;
    a distance that no long can hold is the largest long. Rows with a null id take part; repeated rows each count. Other
    columns take no part, whatever their names. An empty table gives no rows and no centroids.

    Vectors lie in tiles in one bucketed table that is written once; a round reads it with the state of the round before
    (cluster and two bounds a vector, bucketed alike: no exchange) and writes the new state. What reaches the driver is
    a row of k x (dims + 1) sums for each 64 buckets; what goes out is k x dims numbers and k x k distances.
    """
    spark = vectors.sparkSession
    finite = lambda x: x.isNotNull() & (F.abs(x * F.lit(scale)) < F.lit(float("inf")))  # noqa: E731 (NaN is above all)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where((F.size("v") == dims) & F.forall("v", finite))
    first = rows.orderBy(F.asc_nulls_last(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)), "v").limit(k).collect()
    points = [[int(x) for x in np.floor(scale * np.array(r.v, np.float64))] for r in first]
    if not points:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    tables = _Tables(spark)
    tiles = tables.write(_tiles(rows, dims, scale, tile_rows).repartition(tables.buckets, "tile"))
    none = ["cluster binary", "upper binary", "lower binary"]
    before, state, held = None, None, {i: [0] * (dims + 1) for i in range(len(points))}
    for turn in range(rounds + 1):
        left = spark.table(tiles)
        both = left.join(spark.table(state).select("tile", "cluster", "upper", "lower").hint("merge"), "tile") if state else left.select("*", *[F.lit(None).cast("binary").alias(c.split()[0]) for c in none])
        made = tables.write(_round(both, Centroids.of(points, before), turn == rounds))
        if state:
            tables.drop(state)
        state = made
        if turn < rounds:
            parts = spark.table(state).where("moved IS NOT NULL").select("moved").mapInArrow(_sum_parts, "moved string")
            for a, change in _added([r.moved for r in parts.repartition(-(-tables.buckets // 64)).mapInArrow(_sum_parts, "moved string").collect()]).items():
                held[a] = [x + y for x, y in zip(held[a], change)]
            before, points = points, [[s // held[a][0] for s in held[a][1:]] if held[a][0] else p for a, p in enumerate(points)]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, cluster, distance in zip(*(batch.column(i).to_pylist() for i in range(3))):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.frombuffer(cluster, "<i4")), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    out = spark.table(tiles).select("tile", "ids").join(spark.table(state).select("tile", "cluster", "distance").hint("merge"), "tile")
    return out.select("ids", "cluster", "distance").mapInArrow(spread, "vec_id long, cluster int, distance long"), points
