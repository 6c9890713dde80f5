"""Search for feature masks: two-objective and one-objective evolution, and forward selection.

Variation and selection are cheap and run on the driver over masks, whose number is the population's; fits are the
cost, and every generation's new masks of all seeds are one distributed job. Masks are remembered by value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

Fitness = Callable[[list[str]], dict[str, tuple[float, float]]]


def mask_of(bits) -> str:
    return "".join("1" if b else "0" for b in bits)


def bits_of(mask: str, n: int | None = None) -> np.ndarray:
    if set(mask) - {"0", "1"} or (n is not None and len(mask) != n):
        raise ValueError(f"not a mask of {n} features: {mask!r}")
    return np.array([c == "1" for c in mask])


@dataclass
class Remembered:
    """A fitness that asks for each mask once."""

    ask: Fitness
    known: dict[str, tuple[float, float]] = field(default_factory=dict)
    asked: int = 0

    def __call__(self, masks: list[str]) -> list[tuple[float, float]]:
        new = sorted({m for m in masks if m not in self.known})
        self.asked += len(new)
        self.known.update(self.ask(new) if new else {})
        return [self.known[m] for m in masks]


def dominates(a: tuple[float, ...], b: tuple[float, ...]) -> bool:
    return all(x >= y for x, y in zip(a, b)) and any(x > y for x, y in zip(a, b))


def fronts(points: list[tuple[float, ...]]) -> list[list[int]]:
    """Indices by rank of non-domination."""
    p = np.array(points, float)
    ge = (p[:, None, :] >= p[None, :, :]).all(axis=2)
    over = ge & (p[:, None, :] > p[None, :, :]).any(axis=2)
    left, out = over.sum(axis=0), []
    alive = np.ones(len(p), bool)
    while alive.any():
        front = np.flatnonzero(alive & (left == 0))
        out.append(front.tolist())
        alive[front] = False
        left = left - over[front].sum(axis=0)
    return out


def crowding(points: list[tuple[float, ...]], front: list[int]) -> dict[int, float]:
    """The size of the box between a point's neighbours on the front, objective by objective; infinite at its ends."""
    out = dict.fromkeys(front, 0.0)
    for k in range(len(points[front[0]])):
        order = sorted(front, key=lambda i: points[i][k])
        span = points[order[-1]][k] - points[order[0]][k]
        out[order[0]] = out[order[-1]] = float("inf")
        for a, b, c in zip(order, order[1:], order[2:]):
            out[b] += (points[c][k] - points[a][k]) / span if span else 0.0
    return out


def ranked(points: list[tuple[float, ...]]) -> list[tuple[int, float]]:
    """(rank, minus crowding) of each point: smaller is better."""
    out: list[tuple[int, float]] = [(0, 0.0)] * len(points)
    for rank, front in enumerate(fronts(points)):
        for i, d in crowding(points, front).items():
            out[i] = (rank, -d)
    return out


def _child(rng: np.random.Generator, a: str, b: str, cross: float, mutate: float) -> list[str]:
    x, y = bits_of(a), bits_of(b)
    if rng.random() < cross:
        swap = rng.random(len(x)) < 0.5
        x, y = np.where(swap, y, x), np.where(swap, x, y)
    return [mask_of(z ^ (rng.random(len(z)) < 1 / len(z)) if rng.random() < mutate else z) for z in (x, y)]


@dataclass
class Evolved:
    seed: int
    population: list[str]
    points: list[tuple[float, float]]
    history: list[dict]


def nsga2(fitness: Fitness, n_features: int, seeds: list[int], size: int = 40, generations: int = 10, cross: float = 0.5, mutate: float = 0.3) -> list[Evolved]:
    """The elitist non-dominated sorting algorithm of Deb et al. (2002) for (auc, sign consistency). All seeds advance
    together, so a generation is one job. The same seed gives the same result whatever the others are."""
    if size % 4:
        raise ValueError("the population must be a multiple of 4")
    ask = Remembered(fitness)
    rngs = [np.random.default_rng(s) for s in seeds]
    pops = [[mask_of(r.random(n_features) < 0.5) for _ in range(size)] for r in rngs]
    flat = ask([m for p in pops for m in p])
    points = [flat[i * size : (i + 1) * size] for i in range(len(seeds))]
    archive = [set(p) for p in pops]
    out = [Evolved(s, p, q, []) for s, p, q in zip(seeds, pops, points)]

    def note(e: Evolved, gen: int, new: int) -> None:
        a = np.array(e.points)
        e.history.append({"gen": gen, "nevals": new, "archive": len(archive[seeds.index(e.seed)]), **{f"{f}_{n}": float(getattr(a[:, k], f)()) for k, n in enumerate(("auc", "sign")) for f in ("max", "mean", "std")}})

    for e in out:
        note(e, 0, len(set(e.population)))
    for gen in range(1, generations + 1):
        children = []
        for e, rng in zip(out, rngs):
            order = ranked(e.points)
            picks = []
            for _ in range(2):  # every member meets two others
                shuffled = rng.permutation(size)
                picks += [min(a, b, key=lambda i: (order[i], i)) for a, b in zip(shuffled[::2], shuffled[1::2])]
            children.append([c for a, b in zip(picks[::2], picks[1::2]) for c in _child(rng, e.population[a], e.population[b], cross, mutate)])
        got = ask([m for c in children for m in c])
        at = 0
        for i, (e, new) in enumerate(zip(out, children)):
            fresh = len(set(new) - archive[i])
            archive[i] |= set(new)
            pool, pool_points = e.population + new, e.points + got[at : at + len(new)]
            at += len(new)
            best = sorted(range(len(pool)), key=lambda j, o=ranked(pool_points): (o[j], j))[:size]
            e.population, e.points = [pool[j] for j in best], [pool_points[j] for j in best]
            note(e, gen, fresh)
    return out


def genetic(fitness: Fitness, n_features: int, seeds: list[int], size: int = 40, generations: int = 10, cross: float = 0.5, mutate: float = 0.3) -> list[Evolved]:
    """A mu-plus-lambda algorithm for auc alone, with tournaments of three; the first mask of a result is its best."""
    ask = Remembered(fitness)
    rngs = [np.random.default_rng(s) for s in seeds]
    pops = [[mask_of(r.random(n_features) < 0.5) for _ in range(size)] for r in rngs]
    flat = ask([m for p in pops for m in p])
    out = [Evolved(s, p, flat[i * size : (i + 1) * size], []) for i, (s, p) in enumerate(zip(seeds, pops))]
    for gen in range(1, generations + 1):
        children = []
        for e, rng in zip(out, rngs):
            pick = lambda e=e, rng=rng: e.population[max(rng.integers(0, size, 3), key=lambda i: (e.points[i][0], -i))]
            children.append([c for _ in range(size // 2) for c in _child(rng, pick(), pick(), cross, mutate)])
        got = ask([m for c in children for m in c])
        at = 0
        for e, new in zip(out, children):
            pool, points = e.population + new, e.points + got[at : at + len(new)]
            at += len(new)
            best = sorted(range(len(pool)), key=lambda j: (-points[j][0], j))[:size]
            e.population, e.points = [pool[j] for j in best], [points[j] for j in best]
            a = np.array(e.points)[:, 0]
            e.history.append({"gen": gen, "max": float(a.max()), "avg": float(a.mean()), "min": float(a.min()), "std": float(a.std())})
    return out


def forward(fitness: Fitness, n_features: int, gain: float = 1e-3) -> list[tuple[str, float]]:
    """The masks of forward selection with their AUC: the best feature is added while that gains more than `gain`.
    Each step's candidates are one job."""
    mask, best, path = "0" * n_features, None, []
    while "0" in mask:
        candidates = [mask[:i] + "1" + mask[i + 1 :] for i in range(n_features) if mask[i] == "0"]
        found = fitness(candidates)
        top = max(candidates, key=lambda m: (found[m][0], -m.index("1")))
        if best is not None and found[top][0] - best <= gain:
            break
        mask, best = top, found[top][0]
        path.append((mask, best))
    return path


def all_features(n_features: int) -> str:
    return "1" * n_features
