"""What corruptions do at every level, counted in one pass over the clean rows.

A cell's draw is the same at all levels, so a cell that is struck at one level is struck at all above it: it changes once.
A row thus adds to the count of the level at which a cell changes, and the levels' own counts are running sums of that. A
combination of two flags holds on a range of levels, and adds one where the range begins and takes one where it ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .corrupt import draw
from .schema import TableProfile

COUNTS = ["eligible", "selected", "changed", "unseen_combinations", "rows_with_unseen_combination"]


def level_counts(df: DataFrame, row_id: str, profile: TableProfile, medians: dict[str, float], levels: list[float], repetitions: int, seed: int = 20260926) -> DataFrame:
    """(family, level, repetition, and COUNTS) for each family of corruptions that applies: cells or units that could be
    struck, that are struck, that are another than before, and combinations of two flags that no training row has and
    the clean row has not, with the rows that have one. levels must rise. A row is repeated for a repetition, not for a
    level. Nulls are never struck."""
    n_levels, names = len(levels), list(profile.kinds)
    at = {c: i for i, c in enumerate(names)}
    numbers, recorded, alone, flags = profile.of("continuous"), profile.listed("under_recording_inputs"), profile.listed("stand_alone_binary"), profile.flags
    units = [*alone, *profile.groups]
    families = {"noise": numbers, "redraw": units, "redraw value": units, "under_recording": recorded, "masking": list(flags), "median_masking": numbers}
    places, end = {}, 0
    for family, members in families.items():
        places[family] = slice(end, end := end + len(members))
    draws = F.array(*[draw(seed, family, F.col("repetition"), unit, row_id) for family, members in families.items() for unit in members])
    rows = df.select(row_id, F.array(*[F.col(f"`{c}`").cast("double") for c in names]).alias("x")).withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
    steps = np.array(levels)
    unseen = [(at[a], x, at[b], y) for a, b, x, y, _ in profile.unseen]

    def redrawn(x: np.ndarray, u: np.ndarray) -> dict[int, np.ndarray]:
        """Every flag's new value, were it drawn."""
        new = {at[c]: (u[:, i] < profile.shares[c]).astype(float) for i, c in enumerate(alone)}
        for i, (prefix, members) in enumerate(profile.groups.items(), len(alone)):
            below, rest = 0.0, 1 - sum(members.values()) > 1e-12
            for k, (c, share) in enumerate(members.items()):
                last = k == len(members) - 1 and not rest
                new[at[c]] = ((u[:, i] >= below) & ((u[:, i] < below + share) | last)).astype(float)
                below += share
        return new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            repetition = batch.column(1).to_numpy()
            whole, drawn = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(len(repetition), -1) for i in (0, 2))
            for r in np.unique(repetition):
                x, u = whole[repetition == r], drawn[repetition == r]
                first = {f: np.searchsorted(steps, u[:, s], side="right") for f, s in places.items()}  # the level a draw is under
                there = np.ones((len(x), len(numbers)), bool)
                for j, c in enumerate(numbers):
                    if c in profile.flag_of:
                        flag, off = profile.flag_of[c]
                        there[:, j] = x[:, at[flag]] != off
                    there[:, j] &= ~np.isnan(x[:, at[c]])

                def count(family: str, eligible: np.ndarray, begins: np.ndarray, changed: np.ndarray, switches: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
                    """switches: flag -> (the level from which it has another value, that value)."""
                    total = held.setdefault((family, int(r)), np.zeros((5, n_levels + 1)))
                    total[0, 0] += eligible.sum()
                    total[1] += np.bincount(begins[eligible], minlength=n_levels + 1)
                    total[2] += np.bincount(begins[eligible & changed], minlength=n_levels + 1)
                    some = np.zeros((len(x), n_levels), bool)
                    for a, va, b, vb in unseen:
                        if a not in switches and b not in switches:
                            continue
                        low, high = np.zeros(len(x), np.int64), np.full(len(x), n_levels)
                        for c, v in ((a, va), (b, vb)):
                            when, new = switches.get(c, (np.full(len(x), n_levels), x[:, c]))
                            before, after = x[:, c] == v, new == v
                            low = np.maximum(low, np.where(before, 0, np.where(after, when, n_levels)))
                            high = np.minimum(high, np.where(after, n_levels, np.where(before, when, 0)))
                        made = np.nonzero((low < high) & ~((x[:, a] == va) & (x[:, b] == vb)))[0]
                        np.add.at(total[3], low[made], 1)
                        np.add.at(total[3], high[made], -1)
                        some[made] |= (np.arange(n_levels) >= low[made, None]) & (np.arange(n_levels) < high[made, None])
                    total[4, :n_levels] += some.sum(axis=0)

                value = np.stack([x[:, at[c]] for c in numbers], axis=1) if numbers else np.zeros((len(x), 0))
                yes = np.ones((len(x), 1), bool)
                if numbers:
                    count("noise", there, np.zeros(there.shape, np.int64), there, {})
                    count("median_masking", there, first["median_masking"], value != np.array([medians[c] for c in numbers]), {})
                if units:
                    new, begins = redrawn(x, u[:, places["redraw value"]]), first["redraw"]
                    own = [[at[c]] for c in alone] + [[at[c] for c in m] for m in profile.groups.values()]
                    changed = np.stack([np.any([new[c] != x[:, c] for c in members], axis=0) for members in own], axis=1)
                    count("redraw", yes & np.ones(changed.shape, bool), begins, changed, {c: (begins[:, i], new[c]) for i, members in enumerate(own) for c in members})
                if recorded:
                    one = np.stack([x[:, at[c]] == 1 for c in recorded], axis=1)
                    count("under_recording", one, first["under_recording"], one, {at[c]: (first["under_recording"][:, i], np.zeros(len(x))) for i, c in enumerate(recorded)})
                if flags:
                    on = np.stack([x[:, at[f]] != off for f, (off, _) in flags.items()], axis=1)
                    count("masking", on, first["masking"], on, {at[f]: (first["masking"][:, i], np.full(len(x), float(off))) for i, (f, (off, _)) in enumerate(flags.items())})
        out = [(family, r, k, *total[:, k].astype(np.int64).tolist()) for (family, r), total in held.items() for k in range(n_levels)]
        kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], ["family", "repetition", "place", *COUNTS])

    some = rows.select("x", "repetition", draws.alias("u")).mapInArrow(run, "family string, repetition int, place int, " + ", ".join(f"{c} long" for c in COUNTS))
    some = some.groupBy("family", "repetition", "place").agg(*[F.sum(c).alias(c) for c in COUNTS])  # a row for a family, repetition and level
    upto = Window.partitionBy("family", "repetition").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    level = F.get(F.array(*[F.lit(float(x)) for x in levels]), F.col("place"))
    return some.select("family", level.alias("level"), "repetition", *[(F.col(c) if c.startswith("rows") else F.sum(c).over(upto)).alias(c) for c in COUNTS])
