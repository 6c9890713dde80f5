"""Corruptions of feature tables by hashed draws.

A draw depends on (seed, family, repetition, unit, row) alone: the same at every level, so what a level changes the
next one changes too, and the same however the table is partitioned. Nothing is stored; a corrupted copy is a
projection of the clean rows. Fitted numbers (deviations, shares, medians) are passed in, from training rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hash_uniform, probit, probit_parts

FAMILIES = ("noise", "redraw", "under_recording", "masking", "median_masking")


def draw(seed: int, family: str, rep: int | Column, unit: str, row_id: str) -> Column:
    return hash_uniform(seed, family, rep if isinstance(rep, Column) else F.lit(rep), unit, F.col(row_id))


def available(flag: str | None, off: int = 0) -> Column:
    return F.lit(True) if flag is None else F.col(f"`{flag}`") != off


def _normals(df: DataFrame, row_id: str, columns: list[str], rep: int | Column, seed: int) -> DataFrame:
    """df with _n_<column>, a normal draw. Draws and what the inverse normal names many times get projections of their own."""
    drawn = df.withColumns({f"_u_{c}": F.greatest(draw(seed, "noise", rep, c, row_id), F.lit(1e-12)) for c in columns})
    drawn = drawn.withColumns({f"_p{i}_{c}": part for c in columns for i, part in enumerate(probit_parts(F.col(f"`_u_{c}`")))})
    drawn = drawn.withColumns({f"_n_{c}": probit(F.col(f"`_u_{c}`"), (F.col(f"`_p0_{c}`"), F.col(f"`_p1_{c}`"))) for c in columns})
    return drawn.drop(*[f"{k}_{c}" for c in columns for k in ("_u", "_p0", "_p1")])


def gaussian(df: DataFrame, row_id: str, sd: dict[str, float], level: float | Column, rep: int | Column = 0, seed: int = 20260926, flags: dict[str, str] | None = None) -> DataFrame:
    """Each continuous column plus level times its deviation times a normal draw; cells that are not available stay."""
    flags = flags or {}
    drawn = _normals(df, row_id, list(sd), rep, seed)
    new = {c: F.when(available(flags.get(c)), F.col(f"`{c}`") + level * F.lit(s) * F.col(f"`_n_{c}`")).otherwise(F.col(f"`{c}`")) for c, s in sd.items()}
    return drawn.withColumns(new).drop(*[f"_n_{c}" for c in sd])


def with_noise(df: DataFrame, row_id: str, sd: dict[str, float], rep: int | Column = 0, seed: int = 20260926) -> DataFrame:
    """df with _noise_<column>, what gaussian() adds at level 1. Other levels are multiples of it, so a row is drawn for once and
    not for each level."""
    drawn = _normals(df, row_id, list(sd), rep, seed)
    return drawn.withColumns({f"_noise_{c}": F.lit(s) * F.col(f"`_n_{c}`") for c, s in sd.items()}).drop(*[f"_n_{c}" for c in sd])


def selected(seed: int, family: str, rep: int | Column, unit: str, row_id: str, level: float | Column) -> Column:
    return draw(seed, family, rep, unit, row_id) < level


def redraw(df: DataFrame, row_id: str, shares: dict[str, float], groups: dict[str, list[tuple[str, float]]], level: float | Column, rep: int | Column = 0, seed: int = 20260926) -> DataFrame:
    """Selected flags are drawn anew with their training share. A one-hot group is one unit: one of its members is drawn
    by share, or none, which has what is left of 1; if nothing is left the last member takes the rest."""
    out = {}
    for c, share in shares.items():
        new = (draw(seed, "redraw value", rep, c, row_id) < share).cast("int")
        out[c] = F.when(selected(seed, "redraw", rep, c, row_id, level), new).otherwise(F.col(f"`{c}`"))
    for prefix, members in groups.items():
        u, below = draw(seed, "redraw value", rep, prefix, row_id), 0.0
        some = 1 - sum(s for _, s in members) > 1e-12
        for i, (c, share) in enumerate(members):
            last = i == len(members) - 1 and not some
            new = ((u >= below) & (F.lit(True) if last else u < below + share)).cast("int")
            below += share
            out[c] = F.when(selected(seed, "redraw", rep, prefix, row_id, level), new).otherwise(F.col(f"`{c}`"))
    return df.withColumns(out)


def under_record(df: DataFrame, row_id: str, flags: list[str], level: float | Column, rep: int | Column = 0, seed: int = 20260926) -> DataFrame:
    """Selected ones become zeros."""
    return df.withColumns({c: F.when(selected(seed, "under_recording", rep, c, row_id, level), 0).otherwise(F.col(f"`{c}`")) for c in flags})


def mask_values(df: DataFrame, row_id: str, units: dict[str, tuple[int, dict[str, float]]], level: float | Column, rep: int | Column = 0, seed: int = 20260926) -> DataFrame:
    """units: flag -> (its level for not available, {value column: fill}). Where a flag says available and is selected,
    it takes that level and its values their fills."""
    out = {}
    for flag, (off, fills) in units.items():
        hit = selected(seed, "masking", rep, flag, row_id, level) & (F.col(f"`{flag}`") != off)
        out[flag] = F.when(hit, F.lit(off)).otherwise(F.col(f"`{flag}`"))
        out |= {c: F.when(hit, F.lit(fill)).otherwise(F.col(f"`{c}`")) for c, fill in fills.items()}
    return df.withColumns(out)


def mask_medians(df: DataFrame, row_id: str, medians: dict[str, float], level: float | Column, rep: int | Column = 0, seed: int = 20260926, flags: dict[str, str] | None = None) -> DataFrame:
    """Selected available cells become the training median; flags stay."""
    flags = flags or {}
    return df.withColumns({c: F.when(selected(seed, "median_masking", rep, c, row_id, level) & available(flags.get(c)), F.lit(m)).otherwise(F.col(f"`{c}`")) for c, m in medians.items()})


def changes(clean: DataFrame, dirty: DataFrame, row_id: str, columns: list[str], hits: dict[str, Column], eligible: dict[str, Column] | None = None) -> DataFrame:
    """(feature, eligible, selected, changed): cells that could be drawn, were drawn, and differ from the clean ones."""
    eligible = eligible or {}
    old = clean.select(row_id, *[F.col(f"`{c}`").alias(f"_old_{c}") for c in columns])
    new = dirty.select(row_id, *[F.col(f"`{c}`") for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), eligible.get(c, F.lit(True)).alias("e"), hits[c].alias("s"), (~F.col(f"`{c}`").eqNullSafe(F.col(f"_old_{c}"))).alias("x")) for c in columns])
    long = new.join(old, row_id).select(F.explode(cells).alias("c")).select("c.*")
    return long.groupBy("feature").agg(F.count_if("e").alias("eligible"), F.count_if(F.col("s") & F.col("e")).alias("selected"), F.count_if("x").alias("changed"))


def violations(clean: DataFrame, dirty: DataFrame, row_id: str, binaries: list[str], groups: dict[str, list[str]], units: dict[str, tuple[int, dict[str, float]]]) -> DataFrame:
    """(check, n): flags that are neither 0 nor 1; one-hot groups with more than one member set; cells that should hold
    their fill, and did not break that rule in the clean row. All n are zero for a sound corruption."""
    old = clean.select(row_id, *[F.col(f"`{c}`").alias(f"_old_{c}") for c in clean.columns if c != row_id])
    both = dirty.join(old, row_id)
    one = lambda c: F.col(f"`{c}`")
    checks = {"not 0 or 1": sum(((~one(c).isin(0, 1)).cast("long") for c in binaries), F.lit(0))}
    checks["two of a group"] = sum(((sum((one(c) for c in m), F.lit(0)) > 1).cast("long") for m in groups.values()), F.lit(0))
    broken = lambda flag, off, c, fill, pre: (F.col(f"`{pre}{flag}`") == off) & (F.col(f"`{pre}{c}`") != fill)
    checks["off without fill"] = sum(((broken(flag, off, c, fill, "") & ~broken(flag, off, c, fill, "_old_")).cast("long") for flag, (off, fills) in units.items() for c, fill in fills.items()), F.lit(0))
    return both.agg(*[F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(k) for k, v in checks.items()]).select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(f"`{k}`").alias("n")) for k in checks])).alias("x")).select("x.*")


def created_combinations(clean: DataFrame, dirty: DataFrame, row_id: str, unseen: list[tuple[str, str, int, int]]) -> DataFrame:
    """(combinations, rows): unseen pairs of flag values that the corruption made, and rows that have one."""
    old = clean.select(row_id, *[F.col(f"`{c}`").alias(f"_old_{c}") for c in {x for u in unseen for x in u[:2]}])
    both = dirty.join(old, row_id)
    made = [(F.col(f"`{a}`") == x) & (F.col(f"`{b}`") == y) & ~((F.col(f"`_old_{a}`") == x) & (F.col(f"`_old_{b}`") == y)) for a, b, x, y in unseen]
    n = sum((m.cast("long") for m in made), F.lit(0).cast("long"))
    return both.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("combinations"), F.count_if(n > 0).alias("rows"))


def bank(df: DataFrame, levels: list[float], repetitions: int) -> DataFrame:
    """df once for each (level_index, level, repetition). Copies are made in flight, after the scan, and never stored."""
    rows = [F.struct(F.lit(i).alias("level_index"), F.lit(float(x)).alias("level"), F.lit(r).alias("repetition")) for i, x in enumerate(levels) for r in range(repetitions)]
    return df.withColumn("_cell", F.explode(F.array(*rows))).select(*df.columns, "_cell.*")


def exhaustive_breaks(clean: DataFrame, dirty: DataFrame, row_id: str, groups: dict[str, list[str]]) -> DataFrame:
    """(prefix, n): rows in which a group that has a member set in every clean row has none."""
    total = lambda members, pre: sum((F.col(f"`{pre}{c}`") for c in members), F.lit(0))
    names = {c for m in groups.values() for c in m}
    both = dirty.select(row_id, *[F.col(f"`{c}`") for c in names]).join(clean.select(row_id, *[F.col(f"`{c}`").alias(f"_old_{c}") for c in names]), row_id)
    sums = both.agg(*[F.struct(F.min(total(m, "_old_")).alias("least"), F.count_if(total(m, "") == 0).alias("n")).alias(p) for p, m in groups.items()])
    cells = F.array(*[F.struct(F.lit(p).alias("prefix"), F.when(F.col(f"`{p}`")["least"] >= 1, F.col(f"`{p}`")["n"]).otherwise(0).cast("long").alias("n")) for p in groups])
    return sums.select(F.explode(cells).alias("x")).select("x.*")


def check_structure(clean: DataFrame, dirty: DataFrame, row_id: str, binaries: list[str], groups: dict[str, list[str]], units: dict[str, tuple[int, dict[str, float]]]) -> None:
    """Fails if a corruption has broken what the schema promises."""
    found = {r["check"]: r["n"] for r in violations(clean, dirty, row_id, binaries, groups, units).collect() if r["n"]}
    found |= {f"none of {r['prefix']}": r["n"] for r in exhaustive_breaks(clean, dirty, row_id, groups).collect() if r["n"]} if groups else {}
    if found:
        raise ValueError(f"the corrupted rows are not sound: {found}")


def legacy_noise(df: DataFrame, row_id: str, sd: dict[str, float], level: float | Column, rep: int | Column = 0, seed: int = 20260926) -> DataFrame:
    """Noise on every continuous column, whether its value is available or not; at level 0 the rows as they are."""
    return df if isinstance(level, float | int) and abs(level) <= 1e-9 else gaussian(df, row_id, sd, level, rep, seed)


def legacy_redraw(df: DataFrame, row_id: str, columns: list[str], level: float, shares: dict[str, float] | None = None, rep: int = 0, seed: int = 20260926) -> DataFrame:
    """Every cell of the columns by itself is drawn anew with a chance of level, one-hot groups or not; by the given
    (training) share, or the share of these rows."""
    if not 0 <= level <= 1:
        raise ValueError(f"level must lie between 0 and 1: {level}")
    if level <= 1e-9 or not columns:
        return df
    shares = shares or df.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(c) for c in columns]).first().asDict()
    return redraw(df, row_id, {c: shares[c] for c in columns if c in shares}, {}, level, rep, seed)
