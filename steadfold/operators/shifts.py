"""Rank metrics of models at many levels of noise under many weightings: a task scores its rows at every level and packs scores
by level, model and range, as in copies, but rows of one class and one number share a run: what a weighting depends on is
written once for a run, and a score takes eight bytes. No row is repeated for a level or a weighting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..sources.staging import staged
from .model import Package, score_column
from .vectors import SHARED, Weigh, range_shares, range_starts, start_arrays

#: Scores of a model, at all levels, that a task holds before it packs them.
HELD = 1 << 20

#: Records of a range, about, and sampled rows to one where ranges are cut.
RANGE, SAMPLED = 1 << 20, 400

#: Numbers of a block of the second pass: half a megabyte.
CELLS = 1 << 16

#: scores are in the order of runs; a run has its number and class, and how many scores it has. A score that many rows share
#: is not among them, but has its sums of weights, negatives first.
PACKED = "copy int, range int, scores binary, runs binary, counts binary, shared binary, sums binary, neg array<double>, pos array<double>"


def _noisy(packages: dict[str, Package], columns: list[str]) -> list[str]:
    """The features of the models that noise is put on."""
    used = {c for package in packages.values() for c, *_ in package}
    return [c for c in columns if c in used]


def level_cuts(sample: DataFrame, packages: dict[str, Package], levels: list[float], noise: dict[str, str]) -> list[list[list[float]]]:
    """For each level and model, scores that cut its records into ranges of about RANGE. sample: rows that a share of
    sampled_share() has; noise: see shifted_scores(). A cut anywhere gives the same metrics; these only even out the ranges."""
    n = -(-round(sample.count() / sampled_share()) // RANGE)
    cuts: list[list[list[float]]] = [[[] for _ in packages] for _ in levels]
    if n > 1:
        copies = sample.select("*", F.posexplode(F.array(*[F.lit(float(x)) for x in levels])).alias("_cell", "_level"))
        copies = copies.withColumns({c: F.col(f"`{c}`") + F.col("_level") * F.col(f"`{noise[c]}`") for c in _noisy(packages, list(noise))})
        scored = copies.select("_cell", *[score_column(p).alias(f"p{i}") for i, p in enumerate(packages.values())])
        at = F.array(*[F.lit(i / n) for i in range(1, n)])
        for r in scored.groupBy("_cell").agg(*[F.percentile_approx(f"p{i}", at).alias(f"p{i}") for i in range(len(packages))]).collect():  # a row for a level
            cuts[r["_cell"]] = [sorted(set(r[f"p{i}"] or [])) for i in range(len(packages))]
    return cuts


def sampled_share() -> float:
    return min(1.0, SAMPLED / RANGE)


def _firsts(p: np.ndarray) -> np.ndarray:
    """Where a score differs from the one before it; missing ones are alike."""
    return np.r_[True, (p[1:] != p[:-1]) & ~(np.isnan(p[1:]) & np.isnan(p[:-1]))] if len(p) else np.zeros(0, bool)


def _spans(lengths: np.ndarray, values: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths)
    return [values[a:b].tobytes() for a, b in zip(ends - lengths, ends)]


def _scores(package: Package, at: dict[str, int], x: np.ndarray, noise: dict[str, np.ndarray], level: float) -> np.ndarray:
    """score_column() of rows at a level of noise, in the same order of operations."""
    z = np.zeros(x.shape[1])
    for feature, mean, scale, coef in package:
        if feature == "(intercept)":
            z = z + coef
        else:
            value = x[at[feature]] + level * noise[feature] if feature in noise else x[at[feature]]
            z = z + coef * (value - mean) / scale
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-z)) + 0.0


def _packed(packages: list[Package], features: list[str], noisy: list[str], levels: list[float], cuts: list[list[np.ndarray]], weigh: Weigh, n_weights: int, held_rows: int):
    models, place = len(packages), {c: i for i, c in enumerate(features)}

    def flush(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        y, z, *x = (np.concatenate([h[k] for h in held]) for k in range(len(held[0])))
        x, noise = np.array(x[: len(features)]).reshape(-1, len(y)), dict(zip(noisy, x[len(features) :]))
        numbers, kind = np.unique(z, return_inverse=True)
        kinds = np.column_stack([np.repeat(numbers, 2), np.tile([0.0, 1.0], len(numbers))])  # a kind is a number and a class
        kind = kind * 2 + (y == 1)
        for m, package in enumerate(packages):
            # rows of a packed row, one after the other: a copy's scores ascend, so cuts are places in them
            p, at, bounds = np.empty(len(levels) * len(y)), np.empty(len(levels) * len(y), np.int64), []
            for c, level in enumerate(levels):
                mine, low = _scores(package, place, x, noise, level), c * len(y)
                order = np.argsort(mine)
                p[low : low + len(y)], at[low : low + len(y)] = mine[order], kind[order]
                bounds.append(np.r_[low, low + np.searchsorted(p[low : low + len(y)], cuts[c][m], side="left"), low + len(y)])
            sizes = np.concatenate([np.diff(b) for b in bounds])
            name = np.concatenate([np.full(len(b) - 1, c * models + m) for c, b in enumerate(bounds)])
            part = np.concatenate([np.arange(len(b) - 1) for b in bounds])
            name, part, sizes = name[sizes > 0], part[sizes > 0], sizes[sizes > 0]
            n = len(sizes)
            row = np.repeat(np.arange(n), sizes)
            total = np.zeros((n, 2, n_weights))

            first = np.nonzero(_firsts(p) | np.r_[True, row[1:] != row[:-1]])[0]
            same = np.diff(np.r_[first, len(p)])
            often = same >= SHARED
            shared, sums = first[often], np.zeros((int(often.sum()), 2, n_weights))
            for i, (a, k) in enumerate(zip(shared, same[often])):
                some, many = np.unique(at[a : a + k], return_counts=True)
                for low in range(0, len(some), step := max(1, CELLS // n_weights)):
                    which = kinds[some[low : low + step]]
                    w = weigh(which[:, :1]) * many[low : low + step, None]
                    for c in (0, 1):
                        sums[i, c] += w[which[:, 1] == c].sum(axis=0)
            shared_row, shared_p = row[shared], p[shared]
            np.add.at(total, shared_row, sums)
            if len(shared):
                rest = ~np.repeat(often, same)
                p, at, row = p[rest], at[rest], row[rest]

            code = row * len(kinds) + at
            order = np.argsort(code, kind="stable")
            p, code = p[order], code[order]
            start = np.nonzero(np.diff(code, prepend=-1))[0]
            counts = np.diff(np.r_[start, len(code)])
            run_row, run = np.divmod(code[start], len(kinds))
            for low in range(0, len(run), step := max(1, CELLS // n_weights)):
                mine = slice(low, low + step)
                w = weigh(kinds[run[mine], :1]) * counts[mine, None]
                for c in (0, 1):
                    inside = kinds[run[mine], 1] == c
                    np.add.at(total, (run_row[mine][inside], c), w[inside])
            plain, runs, many = (np.bincount(x, minlength=n) for x in (row, run_row, shared_row))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(name.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(_spans(plain, p), pa.binary()), pa.array(_spans(runs, kinds[run]), pa.binary()), pa.array(_spans(runs, counts.astype(np.int64)), pa.binary()),
                    pa.array(_spans(many, shared_p), pa.binary()), pa.array(_spans(many, sums), pa.binary()), *(pa.array(list(total[:, c]), pa.list_(pa.float64())) for c in (0, 1)),
                ],
                ["copy", "range", "scores", "runs", "counts", "shared", "sums", "neg", "pos"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held.append([c.astype(np.float64) for c in columns])
            n += batch.num_rows * len(levels)
            if n >= held_rows:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return run


def _class_sums(table: pa.Table, weigh: Weigh, n_weights: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(neg, pos), (scores, weightings) each, for the distinct scores of packed rows in ascending order, some at a time."""
    plain, runs, counts, shared, sums = (np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in (("scores", np.float64), ("runs", np.float64), ("counts", np.int64), ("shared", np.float64), ("sums", np.float64)))
    runs, sums = runs.reshape(-1, 2), sums.reshape(-1, n_weights)
    p = np.concatenate([plain, np.repeat(shared, 2)])
    run = np.concatenate([np.repeat(np.arange(len(runs)), counts), len(runs) + np.arange(len(sums))])  # sums are runs of one score
    positive = np.concatenate([runs[:, 1] == 1, np.tile([False, True], len(shared))])
    order = np.argsort(p)
    p, run = p[order], run[order]
    known = np.concatenate([weigh(runs[:, :1]), sums]) if len(runs) <= CELLS else None
    cuts = np.append(np.nonzero(_firsts(p))[0], len(p))
    i = 0
    while i + 1 < len(cuts):
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + max(1, CELLS // n_weights), side="right")) - 1)
        mine = run[cuts[i] : cuts[j]]
        if known is None:
            w, own = np.empty((len(mine), n_weights)), mine < len(runs)
            w[own], w[~own] = weigh(runs[mine[own], :1]), sums[mine[~own] - len(runs)]
        else:
            w = known[mine]
        pos = w * positive[mine][:, None]
        neg = w - pos
        if j - i < len(mine):
            neg, pos = (np.add.reduceat(x, cuts[i:j] - cuts[i], axis=0) for x in (neg, pos))
        yield neg, pos
        i = j


def shifted_scores(rows: DataFrame, packages: dict[str, Package], levels: list[float], noise: dict[str, str], cuts: list[list[list[float]]], weigh: Weigh, n_weights: int, y: str = "y", z: str = "z", held_rows: int = HELD) -> DataFrame:
    """(level, model, at, roc_auc, pr_auc), as vector_scores() has them, of every model at every level of noise under every
    weighting; level is its number. rows: a label (0 or 1), the number z, the models' features and their noise at level 1, in the
    column that noise names for a feature. weigh() has z of some rows; weights are scaled so that each class keeps its number
    of rows. cuts: see level_cuts(). Rows without a label or z do not count. Null where a class has no weight.

    Packed scores are staged when this is called, with the sums of their weights, which are added up over ranges before a
    task takes one range of one level and model at a time."""
    names, noisy, every = list(packages), _noisy(packages, list(noise)), n_weights + 1
    features = list(dict.fromkeys(c for p in packages.values() for c, *_ in p if c != "(intercept)"))
    with_ones: Weigh = lambda t: np.column_stack([weigh(t), np.ones(len(t))])  # noqa: E731 - the last place counts rows
    numbers = [F.col(y), F.col(z), *[F.col(f"`{c}`") for c in features], *[F.col(f"`{noise[c]}`") for c in noisy]]
    made = rows.where(F.col(y).isin(0, 1) & F.col(z).isNotNull()).select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(numbers)])
    edges = [[np.array(c, np.float64) for c in each] for each in cuts]
    packed = staged(made.mapInArrow(_packed(list(packages.values()), features, noisy, levels, edges, with_ones, every, held_rows), PACKED), "shifted")
    starts = range_starts(packed.select("copy", "range", "neg", "pos"), "copy")

    def shares(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        start = start_arrays(right)
        neg_scale, pos_scale = (np.divide(a[-1], a, out=np.zeros(every), where=a > 0) for a in start[2:])
        start = tuple(a * scale for a, scale in zip(start, (neg_scale, pos_scale) * 2))
        sums = ((neg * neg_scale, pos * pos_scale) for neg, pos in _class_sums(left, with_ones, every))
        found = {k: v[:-1] for k, v in range_shares(sums, start).items()}
        return pa.table({"copy": pa.array([key[0].as_py()] * n_weights, pa.int32()), "at": pa.array(np.arange(n_weights, dtype=np.int32)), **found})

    ranges = sum(len(c) + 1 for each in cuts for c in each)
    parts = max(-(-ranges // 4), packed.sparkSession.sparkContext.defaultParallelism)
    left, right = (df.repartition(parts, "copy", "range").groupBy("copy", "range") for df in (packed.drop("neg", "pos"), starts))
    each = left.cogroup(right).applyInArrow(shares, "copy int, at int, area double, average double, neg_all double, pos_all double")
    scored = each.groupBy("copy", "at").agg(F.sum("area").alias("area"), F.sum("average").alias("average"), F.first("neg_all").alias("neg"), F.first("pos_all").alias("pos"))
    model = F.get(F.array(*[F.lit(n) for n in names]), F.col("copy") % len(names))
    return scored.select(F.floor(F.col("copy") / len(names)).cast("int").alias("level"), model.alias("model"), "at", ratio(F.col("area"), F.col("pos") * F.col("neg")).alias("roc_auc"), F.when(F.col("neg") > 0, ratio(F.col("average"), F.col("pos"))).alias("pr_auc"))
