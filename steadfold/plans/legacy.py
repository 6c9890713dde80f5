"""The earlier stress grid: models under noise on numbers and shifts along one axis, both at eleven levels, a line of re-drawn
flags, and the area under the surface of what a model retains.

A row's noise is drawn once; it is scored once for a noise level and model; the shifts are weightings of those scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import corrupt, stats
from ..operators.model import Package, score_models
from ..operators.shifts import level_cuts, sampled_share, shifted_scores
from ..operators.vectors import vector_scores
from ..sources.staging import staged

#: The levels of noise, of shifts and of re-draws, and the noise that the line of shifts is read at.
NOISE = [x / 10 for x in range(11)]
SHIFTS = [x / 5 for x in range(-5, 6)]
FLIPS = [x / 10 for x in range(11)]
NOISE_OF_SHIFTS = 0.3


def stress_grid(test: DataFrame, row_id: str, label: str, packages: dict[str, Package], sd: dict[str, float], axis: Column, noise: list[float] = NOISE, shifts: list[float] = SHIFTS, seed: int = 20260926) -> DataFrame:
    """(model, noise, shift, roc_auc, pr_auc) for every model, noise level and shift. sd: the training deviation of each
    number that noise is put on. axis: of the shifts; its values beyond two deviations count as two. Weights are
    exp(shift * axis), scaled so that each class keeps its number of rows."""
    clipped = F.greatest(F.least(axis, F.lit(2.0)), F.lit(-2.0))
    steps, used = np.array(shifts), {c for package in packages.values() for c, *_ in package}
    rows = test.select(row_id, clipped.alias("_z"), (F.col(label) == 1).cast("int").alias("_y"), *[f"`{c}`" for c in test.columns if c in used and c != row_id])
    rows, sd = rows.where("_z IS NOT NULL"), {c: s for c, s in sd.items() if c in used}
    noised = lambda some: corrupt.with_noise(some, row_id, sd, 0, seed)
    named = {c: f"_noise_{c}" for c in sd}
    cuts = level_cuts(staged(noised(rows.sample(sampled_share(), seed)), "sample"), packages, noise, named)
    out = shifted_scores(noised(rows), packages, noise, named, cuts, lambda t: np.exp(t * steps), len(shifts), "_y", "_z")
    at = lambda values, i: F.get(F.array(*[F.lit(float(x)) for x in values]), F.col(i))
    return out.select("model", at(noise, "level").alias("noise"), at(shifts, "at").alias("shift"), "roc_auc", "pr_auc")


def redraw_line(test: DataFrame, row_id: str, label: str, packages: dict[str, Package], shares: dict[str, float], levels: list[float] = FLIPS, seed: int = 20260926) -> DataFrame:
    """(model, flip_rate, roc_auc, pr_auc): every cell of the flags in shares is drawn anew by itself, with a chance of
    flip_rate, as one with its share."""
    copies = test.withColumn("flip_rate", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    dirty = corrupt.redraw(copies, row_id, shares, {}, F.col("flip_rate"), 0, seed)
    scored = score_models(dirty.withColumn("_y", (F.col(label) == 1).cast("int")), packages, ["flip_rate", "_y"])
    records = scored.select(F.to_json(F.struct("model", "flip_rate")).alias("model"), "p", F.col("_y").alias("y"), F.array().cast("array<double>").alias("t"))
    out = vector_scores(records, lambda t: np.ones((len(t), 1)), 1, test.count() * len(levels) * len(packages)).withColumn("_k", F.from_json("model", "struct<model: string, flip_rate: double>"))
    return out.select("_k.model", "_k.flip_rate", "roc_auc", "pr_auc")


def by_seed(scores: DataFrame, instances: dict[str, tuple[str, int | None]], levels: list[str], metric: str = "roc_auc") -> DataFrame:
    """(seed, levels, auc_<method>): a column for each method; one that no seed changes has the same number for every seed."""
    seeds = sorted({s for _, s in instances.values() if s is not None}) or [0]
    methods = list(dict.fromkeys(m for m, _ in instances.values()))
    rows = [(name, m, x) for name, (m, s) in instances.items() for x in (seeds if s is None else [s])]
    names = F.broadcast(scores.sparkSession.createDataFrame(rows, "model string, method string, seed int"))  # a row for a model and seed
    return scores.join(names, "model").groupBy("seed", *levels).pivot("method", methods).agg(F.first(metric)).select("seed", *levels, *[F.col(m).alias(f"auc_{m}") for m in methods])


def areas(grid: DataFrame, instances: dict[str, tuple[str, int | None]], metric: str = "roc_auc") -> DataFrame:
    """(method, aurs): the area under what each method retains of its clean score, averaged over its runs before."""
    names = F.broadcast(grid.sparkSession.createDataFrame([(n, m) for n, (m, _) in instances.items()], "model string, method string"))
    return stats.grid_area(grid.join(names, "model"), ["method"], "noise", "shift", metric)
