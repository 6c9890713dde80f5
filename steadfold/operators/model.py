"""L2 logistic regression for many feature subsets at once, and scores as Columns.

A final fit takes distributed Newton steps, whatever its table's size. A search fits many masks on the same folds: where
their arrays are within a checked size they are broadcast, and each mask is one task's local iteration; beyond it the same
fits take the distributed steps, all masks together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .metrics import marginal_correlations, rank_metrics
from .prep import moments

#: Bytes of training arrays that may be broadcast.
MOST_BROADCAST = 256 * 2**20


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 100) -> tuple[np.ndarray, float]:
    """Coefficients and intercept that minimise |b|^2 / 2 + c * sum of log losses; the intercept is free.

    Values are sums over rows, so their rounding grows with the rows: once a step has no more to gain than that, no line
    search can tell descent. The whole step is then the last one; it leaves the square of what was missing."""
    n, p = x.shape
    design = np.hstack([x, np.ones((n, 1))])
    ridge = np.r_[np.ones(p), 0.0]
    beta = np.zeros(p + 1)

    def value(b: np.ndarray) -> float:
        z = design @ b
        return float(0.5 * (ridge * b) @ b + c * (np.logaddexp(0, z) - y * z).sum())

    now = value(beta)
    for _ in range(steps):
        prob = 1 / (1 + np.exp(-np.clip(design @ beta, -700, 700)))
        gradient = ridge * beta + c * design.T @ (prob - y)
        if np.abs(gradient).max() < 1e-10:
            break
        hessian = c * (design * (prob * (1 - prob))[:, None]).T @ design + np.diag(ridge) + 1e-10 * np.eye(p + 1)
        step, size = np.linalg.solve(hessian, gradient), 1.0
        if gradient @ step <= 1e-11 * max(1.0, abs(now)):
            beta = beta - step
            break
        while size > 1e-10:
            new = value(beta - size * step)
            if new <= now - 1e-4 * size * (gradient @ step):
                beta, now = beta - size * step, new
                break
            size /= 2
        else:
            break
    return beta[:p], float(beta[p])


def auc(y: np.ndarray, p: np.ndarray) -> float:
    """The chance that a positive is above a negative, ties half; nan with one class."""
    pos = int(y.sum())
    if not 0 < pos < len(y):
        return float("nan")
    _, place, counts = np.unique(p, return_inverse=True, return_counts=True)
    rank = np.cumsum(counts) - (counts - 1) / 2
    return float((rank[place][y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos)))


def standardised(train: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    mean, sd = train.mean(axis=0), train.std(axis=0)
    sd = np.where(sd > 0, sd, 1.0)
    return [(a - mean) / sd for a in (train, *others)]


def correlations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """With y; 0 for a column or target without spread."""
    a, b = x - x.mean(axis=0), y - y.mean()
    spread = np.sqrt((a * a).sum(axis=0) * (b * b).sum())
    return np.divide(a.T @ b, spread, out=np.zeros(x.shape[1]), where=spread > 0)


def sign_share(coef: np.ndarray, corr: np.ndarray) -> float:
    product = coef * corr
    return float(((product > 0) & (np.abs(product) > 1e-12)).mean()) if len(coef) else 0.0


@dataclass
class Folds:
    """Standardised arrays of every fold, and each fold's correlations on its own training rows."""

    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def collect(df: DataFrame, features: list[str], label: str, row_id: str, fold: str = "fold") -> Folds:
        """From a frame with folds, whose arrays the caller knows to be small."""
        rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(label).cast("double").alias("y"), F.col(fold).alias("fold"), F.col(row_id).alias("id")).orderBy("id").toPandas()
        x, y, k = rows[[f"x{i}" for i in range(len(features))]].to_numpy(), rows["y"].to_numpy(), rows["fold"].to_numpy()
        parts = []
        for f in sorted(set(k.tolist())):
            tx, vx = standardised(x[k != f], x[k == f])
            parts.append((tx, y[k != f], vx, y[k == f], correlations(tx, y[k != f])))
        return Folds(parts)

    def fitness(self, mask: str) -> tuple[float, float]:
        """Mean AUC on the validation rows and mean share of consistent signs; (0, 0) for an empty mask."""
        use = np.array([m == "1" for m in mask])
        if not use.any():
            return 0.0, 0.0
        scores, signs = [], []
        for tx, ty, vx, vy, corr in self.parts:
            coef, free = fit_logistic(tx[:, use], ty)
            scores.append(auc(vy, vx[:, use] @ coef + free))
            signs.append(sign_share(coef, corr[use]))
        return float(np.nanmean(scores)), float(np.mean(signs))


def fitness(df: DataFrame, features: list[str], label: str, row_id: str, fold: str = "fold") -> Callable[[list[str]], dict[str, tuple[float, float]]]:
    """What gives masks their (auc, sign share), over the folds of df: by either way the same."""
    spark, n = df.sparkSession, df.count()
    if 8 * n * (len(features) + 1) <= MOST_BROADCAST:
        sent = spark.sparkContext.broadcast(Folds.collect(df, features, label, row_id, fold))
        return lambda masks: evaluate_masks(spark, sent, masks)
    return lambda masks: evaluate_distributed(df, features, label, masks, fold)


def evaluate_distributed(df: DataFrame, features: list[str], label: str, masks: list[str], fold: str = "fold") -> dict[str, tuple[float, float]]:
    """(auc, sign share) of each mask, on tables of any size: all masks' fits of a fold take their steps together."""
    subsets = {m: [f for f, bit in zip(features, m) if bit == "1"] for m in sorted(set(masks))}
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    scores: dict[str, list[tuple[float, float]]] = {m: [] for m in subsets if "1" in m}
    for f in folds:
        train, rest = df.where(F.col(fold) != f), df.where(F.col(fold) == f)
        made = fit_many(train, features, label, {m: subsets[m] for m in scores})
        corr = {r["feature"]: r["corr"] for r in marginal_correlations(train, features, label).collect()}
        found = {r["model"]: r["roc_auc"] for r in rank_metrics(score_models(rest, made, [label]), ["model"], label).collect()}
        for m, package in made.items():
            coef = np.array([c for name, _, _, c in package if name != "(intercept)"])
            scores[m].append((found[m] if found[m] is not None else float("nan"), sign_share(coef, np.array([corr[c] for c in subsets[m]]))))
    return {m: (float(np.nanmean([a for a, _ in scores[m]])), float(np.mean([s for _, s in scores[m]]))) if m in scores else (0.0, 0.0) for m in subsets}


def evaluate_masks(spark, folds, masks: list[str]) -> dict[str, tuple[float, float]]:
    """(auc, sign share) of each mask: one job over the distinct masks. folds: a broadcast of Folds."""
    distinct = sorted(set(masks))
    if not distinct:
        return {}
    n = min(len(distinct), max(spark.sparkContext.defaultParallelism, 1) * 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [folds.value.fitness(m) for m in batch["mask"]]
            yield pd.DataFrame({"mask": batch["mask"], "auc": [a for a, _ in made], "sign": [s for _, s in made]})

    df = spark.createDataFrame([(m,) for m in distinct], "mask string").repartition(n)
    return {r["mask"]: (r["auc"], r["sign"]) for r in df.mapInPandas(run, "mask string, auc double, sign double").collect()}


Package = list[tuple[str, float, float, float]]


def fit_many(df: DataFrame, features: list[str], label: str, subsets: dict[str, list[str]], steps: int = 100) -> dict[str, Package]:
    """A fit for each subset of the features, standardised by all rows: (feature, mean, scale, coef), and a last row for the
    intercept. The objective is fit_logistic's, |b|^2 / 2 + the sum of log losses.

    All fits take their Newton steps together: a step is one job, whose tasks sum up values, gradients and curvatures of
    their rows, so tables of any size take the same way, and what comes back has a cell for a pair of coefficients."""
    fit = moments(df, features) if features else {}
    at = {c: i for i, c in enumerate(features)}
    rows = staged(df.select(*[((F.col(f"`{c}`").cast("double") - F.lit(float(m))) / F.lit(float(s))).alias(f"x{at[c]}") for c, (m, s) in fit.items()], F.col(label).cast("double").alias("y")), "design")
    places = {name: [at[c] for c in chosen] for name, chosen in subsets.items()}

    def sums(points: dict[str, np.ndarray]) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
        """(value, gradient, curvature) of each open fit, without the ridge."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {n: np.zeros(1 + len(b) + len(b) ** 2) for n, b in points.items()}
            for batch in batches:
                columns = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                y = columns[:, -1]
                for n, b in points.items():
                    x = np.column_stack([columns[:, places[n]], np.ones(len(y))])
                    z = x @ b
                    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                    total[n] += np.concatenate([[(np.logaddexp(0, z) - y * z).sum()], x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])
            names = [n for n, t in total.items() for _ in t]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([i for t in total.values() for i in range(len(t))], pa.int64()), pa.array(np.concatenate(list(total.values())))], ["name", "i", "v"])

        got = {n: np.zeros(1 + len(b) + len(b) ** 2) for n, b in points.items()}
        for r in rows.mapInArrow(run, "name string, i long, v double").groupBy("name", "i").agg(F.sum("v").alias("v")).collect():
            got[r["name"]][r["i"]] = r["v"]
        return {n: (t[0], t[1 : 1 + len(points[n])], t[1 + len(points[n]) :].reshape(len(points[n]), -1)) for n, t in got.items()}

    now = {n: np.zeros(len(p) + 1) for n, p in places.items()}
    state: dict[str, tuple] = {}
    trial, size, done = dict(now), dict.fromkeys(now, 1.0), set()
    for _ in range(steps):
        if not trial:
            break
        for n, (value, gradient, curve) in sums(trial).items():
            b = trial[n]
            ridge = np.r_[np.ones(len(b) - 1), 0.0]
            value, gradient = value + float((ridge * b) @ b) / 2, gradient + ridge * b
            if n in state and not value <= state[n][0] + 1e-12 * abs(state[n][0]) and size[n] > 1e-8:
                size[n] /= 2  # no descent: half the step, from the same place
            else:
                size[n], now[n], state[n] = 1.0, b, (value, np.linalg.solve(curve + np.diag(ridge) + 1e-10 * np.eye(len(b)), gradient))
                if np.abs(gradient).max() < 1e-9 * max(1.0, abs(value)):
                    done.add(n)
        trial = {n: now[n] - size[n] * state[n][1] for n in now if n not in done}
    return {n: [*[(features[i], fit[features[i]][0], fit[features[i]][1], float(c)) for i, c in zip(places[n], b)], ("(intercept)", 0.0, 1.0, float(b[-1]))] for n, b in now.items()}


def fit_frame(df: DataFrame, features: list[str], label: str) -> Package:
    """One fit of all rows on all the features."""
    return fit_many(df, features, label, {"all": features})["all"]


def score_column(package: list[tuple[str, float, float, float]]) -> Column:
    """The probability by a model package, as a plain Column: no Python when scoring."""
    z = F.lit(0.0)
    for feature, mean, scale, coef in package:
        z = z + (F.lit(coef) if feature == "(intercept)" else F.lit(coef) * (F.col(f"`{feature}`") - F.lit(mean)) / F.lit(scale))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def score_models(df: DataFrame, packages: dict[str, list], keep: list[str]) -> DataFrame:
    """(keep, model, p) for every model: one projection with a column for each, unpivoted within the row."""
    made = F.array(*[F.struct(F.lit(name).alias("model"), score_column(p).alias("p")) for name, p in packages.items()])
    return df.select(*keep, F.explode(made).alias("_m")).select(*keep, "_m.model", "_m.p")


def out_of_fold(df: DataFrame, features: list[str], label: str, fold: str = "fold") -> DataFrame:
    """df with p, from a model of the rows of the other folds."""
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    p = F.lit(None).cast("double")
    for f in folds:
        p = F.when(F.col(fold) == f, score_column(fit_frame(df.where(F.col(fold) != f), features, label))).otherwise(p)
    return df.withColumn("p", p)
