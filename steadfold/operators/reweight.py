"""Re-weighted populations: tilts towards a direction, and of the dependence within a pair of features.

Weights are functions of features alone. Solvers see compressed statistics - distinct scores with their counts, moments,
a Gram matrix - and not rows; score columns come as knots of a fine grid, or rounded where two are paired.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import probit, ratio
from .places import placed


def ecdf(df: DataFrame, value: str, train: Column, out: str = "cdf", keys: list[str] = ()) -> DataFrame:
    """df with the mid-rank share of the training rows (of the same keys) below each value, kept 1 / (2 n) away from 0
    and 1; null for a null value. Rows outside training are placed among training rows and do not move them. All keys go
    through one plan."""
    counted = F.coalesce((train & F.col(value).isNotNull()).cast("long"), F.lit(0))
    at = placed(df, list(keys), value, counted).withColumn("_all", F.greatest("_all", F.lit(1)))
    share, edge = (F.col("_below") + F.col("_same") / 2) / F.col("_all"), 1 / (2 * F.col("_all"))
    return at.select(*df.columns, F.when(F.col(value).isNotNull(), F.least(F.greatest(share, edge), 1 - edge)).alias(out))


def normal_scores(df: DataFrame, value: str, train: Column, out: str = "score", keys: list[str] = ()) -> DataFrame:
    return ecdf(df, value, train, "_cdf", keys).withColumn(out, probit(F.col("_cdf"))).drop("_cdf")


def tilt(df: DataFrame, t: str, strength: float, keys: list[str] = (), out: str = "w") -> DataFrame:
    """df with weights exp(strength * t), scaled to a mean of 1 (within keys); the exponent is taken from its maximum."""
    peak = df.groupBy(*keys).agg(F.max(F.lit(strength) * F.col(t)).alias("_peak"))
    joined = df.join(peak, list(keys)) if keys else df.crossJoin(F.broadcast(peak))
    raw = F.exp(F.lit(strength) * F.col(t) - F.col("_peak"))
    mean = joined.groupBy(*keys).agg(F.avg(raw).alias("_mean"))
    joined = joined.join(mean, list(keys)) if keys else joined.crossJoin(F.broadcast(mean))
    return joined.withColumn(out, raw / F.col("_mean")).drop("_peak", "_mean")


#: Knots to a unit of the inverse hyperbolic sine of a score: near zero two thousandths of a deviation, beyond in
#: proportion. So a score column has a few ten thousand knots at most, whatever its rows.
KNOTS = 500


def knots(df: DataFrame, t: str) -> tuple[np.ndarray, np.ndarray]:
    """Means and counts of the values in ranges of one fine grid, which is the same for every table."""
    place = F.floor(F.asinh(F.col(t)) * KNOTS)
    counts = df.where(F.col(t).isNotNull()).groupBy(place.alias("k")).agg(F.avg(t).alias("t"), F.count(F.lit(1)).alias("n"))
    rows = counts.orderBy("k").select(F.col("t").cast("double").alias("t"), "n").toArrow()
    return rows.column(0).to_numpy(), rows.column(1).to_numpy().astype(float)


def bisect(f: Callable[[float], float], low: float, high: float, tolerance: float = 1e-10) -> float:
    """A root of f between low and high, where its signs differ."""
    sign = f(low) > 0
    while high - low > tolerance:
        middle = (low + high) / 2
        if (f(middle) > 0) == sign:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def calibrate_ess(ess_at: Callable[[float], float], targets: list[float], first: float = 0.05, most: float = 20.0, accept: float = 1e-3) -> list[tuple[float, bool]]:
    """(strength, attainable) for each falling target of the effective share. The bracket doubles from `first`; from the
    first target that cannot be met on, the strength is `most` and not attainable."""
    if any(not 0 < t < 1 for t in targets) or any(a <= b for a, b in zip(targets, targets[1:])):
        raise ValueError("targets must fall and lie between 0 and 1")
    out, low = [], 0.0
    for target in targets:
        if out and not out[-1][1]:
            out.append((most, False))
            continue
        high = max(first, low)
        while high < most and ess_at(high) > target:
            high = min(2 * high, most)
        if ess_at(high) > target:
            out.append((most, False))
            continue
        root = bisect(lambda s, t=target: ess_at(s) - t, low, high)
        good = abs(ess_at(root) - target) <= accept
        out.append((root, True) if good else (most, False))
        low = root if good else low
    return out


def ess_share(values: np.ndarray, counts: np.ndarray) -> Callable[[float], float]:
    """The effective share of exponential weights on values that occur so often."""

    def at(strength: float) -> float:
        w = np.exp(strength * values - (strength * values).max())
        return float((w @ counts) ** 2 / ((w * w) @ counts) / counts.sum())

    return at


def principal_axes(df: DataFrame, features: list[str], train: Column, n_axes: int = 3, share: float = 0.8) -> tuple[np.ndarray, np.ndarray, int, dict[str, tuple[float, float]]]:
    """(eigenvalues, loadings by column, axes that reach `share` of the variance, moments). Loadings sum to zero or more."""
    from .prep import moments
    from .schema import correlations

    rows = df.where(train)
    fit, p = moments(rows, features), len(features)
    gram = np.eye(p)
    at = {c: i for i, c in enumerate(features)}
    for r in correlations(rows, features).collect():
        gram[at[r["a"]], at[r["b"]]] = gram[at[r["b"]], at[r["a"]]] = r["corr"]
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    keep = values > 1e-10 * values[0]
    values, vectors = values[keep], vectors[:, keep] * np.where(vectors[:, keep].sum(axis=0) < 0, -1, 1)
    reach = min(int(np.searchsorted(np.cumsum(values) / values.sum(), share)) + 1, len(values))
    return values, vectors, reach, fit


def axis_columns(features: list[str], values: np.ndarray, vectors: np.ndarray, reach: int, fit: dict[str, tuple[float, float]], n_axes: int = 3) -> dict[str, Column]:
    """PC1.. as dot products, and extremes: the distance from the middle in the leading components."""
    z = F.array(*[(F.col(f"`{c}`") - F.lit(fit[c][0])) / F.lit(fit[c][1]) for c in features])
    numbers = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    add = lambda s, x: s + x
    dot = lambda weights, over: F.aggregate(F.zip_with(weights, over, lambda w, x: w * x), F.lit(0.0), add)
    out = {f"PC{k + 1}": dot(numbers(vectors[:, k]), z) for k in range(min(n_axes, len(values)))}
    # a table of loadings in the plan, and not an expression for every product
    leading = F.array(*[numbers(vectors[:, k] / np.sqrt(values[k])) for k in range(reach)])
    length = F.transform(F.array(z), lambda one: F.aggregate(F.transform(leading, lambda w: dot(w, one)), F.lit(0.0), lambda s, x: s + x * x))
    out["extremes"] = F.sqrt(F.get(length, F.lit(0)))
    return out


def pair_selection(train: DataFrame, test: DataFrame, continuous: list[str], binaries: list[str], low: float = 0.3, high: float = 0.95, train_least: int = 20, test_least: int = 5, most: int = 200, excluded: set[frozenset[str]] = frozenset()) -> tuple[DataFrame, int]:
    """(a, b, corr, kind) of the strongest `most` pairs with low <= |corr| < high, and how many there are in all. Pairs
    with a flag need rows of each kind on both sides: every cell of two flags, each level of a single one."""
    from .availability import pair_counts
    from .schema import correlations

    features = sorted([*continuous, *binaries])
    flags = F.array(*[F.lit(b) for b in binaries]) if binaries else F.array().cast("array<string>")
    found = correlations(train, features).where((F.abs("corr") >= low) & (F.abs("corr") < high))
    kind = F.when(F.array_contains(flags, F.col("a")) & F.array_contains(flags, F.col("b")), "binary").when(F.array_contains(flags, F.col("a")) | F.array_contains(flags, F.col("b")), "mixed").otherwise("continuous")
    found = found.withColumn("kind", kind)
    spark = train.sparkSession
    if excluded:
        gone = spark.createDataFrame([tuple(sorted(x)) for x in excluded], "a string, b string")
        found = found.join(F.broadcast(gone), ["a", "b"], "left_anti")
    for side, least in ((train, train_least), (test, test_least)):
        if not binaries:
            break
        shares = side.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"`{b}`")).alias(b) for b in binaries]).first()
        levels = spark.createDataFrame([(b, int(min(shares[b] or 0, shares["n"] - (shares[b] or 0)))) for b in binaries], "name string, fewest long")
        cells = pair_counts(side, binaries).select("a", "b", F.least("n_ab", F.col("n_a") - F.col("n_ab"), F.col("n_b") - F.col("n_ab"), F.col("n") - F.col("n_a") - F.col("n_b") + F.col("n_ab")).alias("fewest_cell"))
        found = found.join(F.broadcast(cells), ["a", "b"], "left").join(F.broadcast(levels.select(F.col("name").alias("a"), F.col("fewest").alias("_fa"))), "a", "left").join(F.broadcast(levels.select(F.col("name").alias("b"), F.col("fewest").alias("_fb"))), "b", "left")
        enough = F.when(F.col("kind") == "binary", F.col("fewest_cell") >= least).when(F.col("kind") == "mixed", F.coalesce("_fa", "_fb") >= least).otherwise(True)
        found = found.where(enough).drop("fewest_cell", "_fa", "_fb")
    return found.orderBy(F.desc(F.round(F.abs("corr"), 12)), "a", "b").limit(most), found.count()


@dataclass
class Moved:
    """Weights exp(theta * a * b + bend . kept(a, b)) under which a pair of scores has another correlation. reached: the
    correlation that they give; error: the largest change of what was to be kept, in its own deviations."""

    theta: float
    bend: np.ndarray
    reached: float
    error: float
    mass: np.ndarray
    base: np.ndarray

    @property
    def ess_share(self) -> float:
        return float(1 / (self.mass**2 / self.base).sum())


class PairShift:
    """Maximum-entropy weights that give a pair of scores another correlation and keep their means, and the squares of
    continuous ones.

    With means and squares kept, the spreads stay, so a correlation is the same as a mean product, and all constraints are
    linear: one convex problem for each target, over the multiplier of the product and those of what is kept together.
    It is solved in whitened constraints by steps within a trusted radius. Scores come with counts, so a problem is as
    large as the pair's distinct scores. Two-valued scores need no square: it follows from their mean."""

    #: A multiplier of the product beyond this is taken for a target that cannot be reached, as is an error beyond NEAR.
    MOST, NEAR = 20.0, 1e-6

    def __init__(self, a: np.ndarray, b: np.ndarray, counts: np.ndarray, squares: tuple[bool, bool]):
        self.a, self.b, self.squares = a, b, squares
        self.base = counts / counts.sum()
        columns = np.column_stack([a * b, self.kept(a, b)])
        self.middle = self.base @ columns
        self.means = np.array([self.base @ a, self.base @ b])
        self.spreads = np.sqrt([self.base @ (a - self.means[0]) ** 2, self.base @ (b - self.means[1]) ** 2])
        centred = columns - self.middle
        # Whitened by the unweighted covariance; directions without spread (a square that the mean gives) fall away.
        values, vectors = np.linalg.eigh((centred * self.base[:, None]).T @ centred)
        use = values > 1e-10 * max(values.max(initial=0.0), 1e-300)
        self.whiten = vectors[:, use] / np.sqrt(values[use])
        self.z = centred @ self.whiten

    def kept(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.column_stack([a, b, *([a * a] if self.squares[0] else []), *([b * b] if self.squares[1] else [])])

    @property
    def start(self) -> float:
        """The correlation as it is; nan without spread."""
        wide = float(self.spreads.prod())
        return float((self.middle[0] - self.means.prod()) / wide) if wide > 0 else float("nan")

    def _state(self, u: np.ndarray) -> tuple[float, np.ndarray]:
        """log of the mean weight at multipliers u, and the shares of mass."""
        power = self.z @ u
        top = power.max()
        share = self.base * np.exp(power - top)
        total = share.sum()
        return float(np.log(total) + top), share / total

    def _solved(self, goal: np.ndarray, most_steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
        """Multipliers whose weighted means of z are the goal: a minimum of log mean weight less u . goal."""
        u, radius = np.zeros(self.z.shape[1]), 1.0
        log_mean, share = self._state(u)
        value = log_mean - u @ goal
        for _ in range(most_steps):
            mean = share @ self.z
            slope = mean - goal
            if np.abs(slope).max() < 1e-12:
                break
            curve = (self.z * share[:, None]).T @ self.z - np.outer(mean, mean)
            values, vectors = np.linalg.eigh(curve)
            along = vectors.T @ slope
            # the step of length `radius` at most that the quadratic model likes best: its shift by bisection
            size = lambda shift: float(np.linalg.norm(along / (values + shift)))
            low = max(0.0, 1e-14 - float(values.min()))
            if size(low + 1e-300) > radius:
                high = low + float(np.linalg.norm(slope)) / radius
                for _ in range(60):
                    middle = (low + high) / 2
                    low, high = (middle, high) if size(middle) > radius else (low, middle)
                low = high
            step = -vectors @ (along / (values + low + 1e-300))
            hoped = -(slope @ step + step @ curve @ step / 2)
            new_log, new_share = self._state(u + step)
            fallen = value - (new_log - (u + step) @ goal)
            good = fallen / hoped if hoped > 0 else 1.0 if fallen >= 0 else 0.0
            radius = radius / 4 if not good > 0.25 else 2 * radius if good > 0.75 else radius
            if good > 1e-4 or (abs(fallen) <= 1e-15 and np.abs(new_share @ self.z - goal).max() < np.abs(slope).max()):
                u, value, share = u + step, value - fallen, new_share
            elif radius < 1e-14:
                break
        return u, share

    def moved(self, target: float) -> Moved | None:
        """The weights for a correlation; None if it cannot be reached."""
        if not (abs(target) < 1 and np.isfinite(self.start)):
            return None
        goal = self.middle.copy()
        goal[0] = target * self.spreads.prod() + self.means.prod()
        with np.errstate(all="ignore"):
            u, share = self._solved((goal - self.middle) @ self.whiten)
        bend = self.whiten @ u
        ma, mb = share @ self.a, share @ self.b
        wide = np.sqrt((share @ (self.a - ma) ** 2) * (share @ (self.b - mb) ** 2))
        reached = float((share @ ((self.a - ma) * (self.b - mb))) / wide) if wide > 0 else float("nan")
        error = float(np.abs(share @ self.kept(self.a, self.b) - self.middle[1:]).max())
        if not (error <= self.NEAR and abs(reached - target) <= 1e-3 and abs(bend[0]) <= self.MOST):
            return None
        return Moved(float(bend[0]), bend[1:], reached, error, share, self.base)


#: Where scores of pairs are clipped, and the steps to a unit that they are rounded to: 251 * 251 distinct pairs at most.
CLIP, PAIR_STEPS = 2.5, 50


def pair_score(score: Column) -> Column:
    """A score clipped and rounded, as pairs take it."""
    return F.round(F.greatest(F.least(score, F.lit(CLIP)), F.lit(-CLIP)) * PAIR_STEPS) / PAIR_STEPS


def pair_problem(df: DataFrame, a: str, b: str, squares: tuple[bool, bool]) -> PairShift:
    """The problem of two columns of pair scores: their distinct pairs and counts go to the driver."""
    rows = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("a", "b").toArrow()
    x, y, n = (rows.column(i).to_numpy().astype(float) for i in range(3))
    return PairShift(x, y, n, squares)


def pair_targets(df: DataFrame, a: str, b: str, squares: tuple[bool, bool], shares: tuple[float, ...], strengthen: bool = False) -> tuple[list[Moved | None], list[float]]:
    """What reaches each target, and the targets: the correlation less (or, to strengthen, nearer to one by) each of the
    shares of what there is to go. After the first that cannot be reached there is None."""
    problem = pair_problem(df.select(*[(pair_score(F.col(c)) if square else F.col(c)).alias(n) for c, n, square in zip((a, b), "ab", squares)]), "a", "b", squares)
    start = problem.start
    targets = [start + s * (np.copysign(1.0, start) - start) if strengthen else start * (1 - s) for s in shares]
    out: list[Moved | None] = []
    for target in targets:
        out.append(None if out and out[-1] is None else problem.moved(target))
    return out, targets


def shift_column(a: Column, b: Column, squares: tuple[bool, bool], moved: Moved) -> Column:
    """The log of a row's weight, up to a constant: the same function for rows that the weights were not found on."""
    terms = [a, b, *([a * a] if squares[0] else []), *([b * b] if squares[1] else [])]
    return sum((F.lit(float(k)) * t for k, t in zip(moved.bend, terms)), F.lit(moved.theta) * a * b)


def calibrate_correlation(problem: PairShift, targets: list[float]) -> list[float]:
    """theta for each target, which move one way from the unweighted correlation; nan for the first that cannot be
    reached and all after it."""
    out: list[float] = []
    for target in targets:
        found = None if out and np.isnan(out[-1]) else problem.moved(target)
        out.append(found.theta if found else float("nan"))
    return out


def supported(train_ess: Column, test_ess: Column, class_ess: Column, train_least: float = 0.3, test_least: float = 0.3, class_least: float = 20.0) -> Column:
    return (train_ess >= train_least) & (test_ess >= test_least) & (class_ess >= class_least)


def cohort(scenarios: DataFrame, unit: list[str], usable: str = "usable") -> DataFrame:
    """scenarios with in_cohort: its unit is usable at every level that its family has."""
    levels = scenarios.groupBy("family").agg(F.count_distinct("level").alias("_levels"))
    usable_levels = scenarios.where(F.col(usable)).groupBy("family", *unit).agg(F.count_distinct("level").alias("_usable"))
    out = scenarios.join(F.broadcast(levels), "family").join(usable_levels, ["family", *unit], "left")
    return out.withColumn("in_cohort", F.coalesce(F.col("_usable") == F.col("_levels"), F.lit(False))).drop("_levels", "_usable")
