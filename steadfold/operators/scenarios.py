"""Every model under every re-weighted population, without a row for each: a weight is a function of a few numbers of its
row, so rows go through with those numbers, and a block of rows meets all scenarios in one product of matrices.

What a scenario adds to the data is one row of coefficients. Sums over rows are vectors with a place for each scenario."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..sources.staging import staged
from .vectors import BLOCK, matrix, vector_scores


@dataclass(frozen=True)
class Tilt:
    """A scenario: a row's weight is exp(product * s * t + one * s + two * t + one2 * s^2 + two2 * t^2), up to a factor, where
    s and t are its numbers at the places `first` and `second`. raw: the places of what s and t are scores of."""

    scenario_id: str | int
    first: int
    second: int
    product: float = 0.0
    one: float = 0.0
    two: float = 0.0
    one2: float = 0.0
    two2: float = 0.0
    raw: tuple[int, int] | None = None


def log_weight(tilt: Tilt, numbers: str = "t") -> Column:
    """The logarithm of a row's weight under one scenario, up to a constant."""
    s, t = F.get(numbers, F.lit(tilt.first)), F.get(numbers, F.lit(tilt.second))
    return s * (F.lit(tilt.product) * t + F.lit(tilt.one) + F.lit(tilt.one2) * s) + t * (F.lit(tilt.two) + F.lit(tilt.two2) * t)


@dataclass(frozen=True)
class Tilts:
    """Scenarios as arrays. peak: of each one's logarithms, which weights are taken from; zeros until it is known."""

    first: np.ndarray
    second: np.ndarray
    coefficients: np.ndarray  # (5, scenarios)
    raw: np.ndarray  # (2, scenarios)
    peak: np.ndarray

    @staticmethod
    def of(tilts: list[Tilt]) -> Tilts:
        raw = [t.raw or (t.first, t.second) for t in tilts]
        table = np.array([[t.product, t.one, t.two, t.one2, t.two2] for t in tilts], np.float64).reshape(len(tilts), 5).T
        return Tilts(np.array([t.first for t in tilts], np.int64), np.array([t.second for t in tilts], np.int64), table, np.array(raw, np.int64).reshape(len(tilts), 2).T, np.zeros(len(tilts)))

    def logs(self, numbers: np.ndarray) -> np.ndarray:
        """(rows, scenarios); nan where a number is missing."""
        s, t, (st, one, two, ss, tt) = numbers[:, self.first], numbers[:, self.second], self.coefficients
        return s * (st * t + one + ss * s) + t * (two + tt * t)

    def weights(self, numbers: np.ndarray) -> np.ndarray:
        """(rows, scenarios); 0 where a number is missing."""
        return np.nan_to_num(np.exp(self.logs(numbers) - self.peak), nan=0.0)


#: What is summed for a scenario over the rows of a part: weights, their squares, of each class; and with weights the
#: products of the pair's scores (s_) and of its values (v_).
SUMS = ["w", "ww", "w1", "ww1", "s_a", "s_b", "s_aa", "s_bb", "s_ab", "v_a", "v_b", "v_aa", "v_bb", "v_ab"]


def moments(rows: DataFrame, tilts: list[Tilt], part: str = "train", y: str = "y", numbers: str = "t") -> DataFrame:
    """(scenario_id, part, n, n1, peak, and SUMS): one row for each scenario and part, in one pass over rows. Weights are
    taken from the part's peak. Rows whose weight is missing count for nothing."""
    known = Tilts.of(tilts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            parts, one, x = (batch.column(0).to_numpy(zero_copy_only=False).astype(bool), batch.column(1).to_numpy(zero_copy_only=False) == 1, matrix(batch.column(2)))
            for side in (False, True):
                at = np.nonzero(parts == side)[0]
                for low in range(0, len(at), BLOCK):
                    mine = at[low : low + BLOCK]
                    log, is1 = known.logs(x[mine]), one[mine, None]
                    peak, sums = held.get(side) or (np.full(len(tilts), -np.inf), np.zeros((len(SUMS) + 2, len(tilts))))
                    with np.errstate(invalid="ignore"):
                        top = np.fmax(peak, np.fmax.reduce(log, axis=0))
                        sums[2:] *= np.nan_to_num(np.exp(peak - top), nan=0.0)
                        sums[[3, 5]] *= np.nan_to_num(np.exp(peak - top), nan=0.0)
                        w = np.nan_to_num(np.exp(log - top), nan=0.0)
                    real = ~np.isnan(log)
                    sums[0] += real.sum(axis=0)
                    sums[1] += (real & is1).sum(axis=0)
                    terms = [w, w * w, w * is1, w * w * is1]
                    for a, b in ((known.first, known.second), (known.raw[0], known.raw[1])):
                        s, t = np.nan_to_num(x[mine][:, a]), np.nan_to_num(x[mine][:, b])
                        terms += [w * s, w * t, w * s * s, w * t * t, w * s * t]
                    for k, term in enumerate(terms):
                        sums[2 + k] += term.sum(axis=0)
                    held[side] = (top, sums)
        for side, (peak, sums) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tilts), dtype=np.int32)), pa.array(np.full(len(tilts), side)), pa.array(peak), *(pa.array(s) for s in sums)], ["at", "part", "peak", "n", "n1", *SUMS])

    spark = rows.sparkSession
    some = rows.select(F.col(part).cast("boolean").alias("part"), F.col(y).cast("int").alias("y"), numbers).mapInArrow(run, "at int, part boolean, peak double, n double, n1 double, " + ", ".join(f"{s} double" for s in SUMS))
    # a row for a scenario and part from each task: the peaks first, then the sums on the highest
    some = staged(some, "moments")
    top = some.groupBy("at", "part").agg(F.max("peak").alias("top"))
    scale = F.exp(F.col("peak") - F.col("top"))
    on = {s: F.col(s) * (scale * scale if s in ("ww", "ww1") else scale) for s in SUMS}
    out = some.join(F.broadcast(top), ["at", "part"]).groupBy("at", "part").agg(F.sum("n").cast("long").alias("n"), F.sum("n1").cast("long").alias("n1"), F.first("top").alias("peak"), *[F.sum(e).alias(s) for s, e in on.items()])
    kind = "string" if tilts and isinstance(tilts[0].scenario_id, str) else "int"
    names = spark.createDataFrame([(i, t.scenario_id) for i, t in enumerate(tilts)], f"at int, scenario_id {kind}")
    return out.join(F.broadcast(names), "at").drop("at")


def support(sums: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ess_fraction, ess_negatives, ess_positives, weighted_prevalence) of moments()."""
    c = F.col
    size = lambda w, ww: F.coalesce(ratio(w * w, ww), F.lit(0.0))
    return sums.select(*keys, (ratio(c("w") * c("w"), c("ww")) / c("n")).alias("ess_fraction"), size(c("w") - c("w1"), c("ww") - c("ww1")).alias("ess_negatives"), size(c("w1"), c("ww1")).alias("ess_positives"), ratio(c("w1"), c("w")).alias("weighted_prevalence"))


def pair_moments(sums: DataFrame, keys: list[str], of: str) -> DataFrame:
    """(keys, corr, mean_a, mean_b, sd_a, sd_b) under the weights; of: `s` for the scores, `v` for the values."""
    m = lambda x: ratio(F.col(f"{of}_{x}"), F.col("w"))
    va, vb = (F.greatest(m(x + x) - m(x) * m(x), F.lit(0.0)) for x in "ab")
    return sums.select(*keys, ratio(m("ab") - m("a") * m("b"), F.sqrt(va * vb)).alias("corr"), m("a").alias("mean_a"), m("b").alias("mean_b"), F.sqrt(va).alias("sd_a"), F.sqrt(vb).alias("sd_b"))


def scenario_scores(preds: DataFrame, rows: DataFrame, tilts: list[Tilt], row_id: str, y: str = "y", p: str = "p", peaks: list[float] | None = None) -> DataFrame:
    """(scenario_id, model, roc_auc, pr_auc, delta_roc_auc, delta_pr_auc): predictions are made once; scenarios change
    weights alone. preds: row, model, y, p; rows: row, t (an array of numbers, which tilts name by place). Deltas are from
    weights of 1. peaks: of the logarithms of each tilt's weights, if known. Predictions that carry t themselves are not
    joined with rows. See vector_scores()."""
    spark, n = preds.sparkSession, len(tilts) + 1
    scored = [F.col("model").cast("string").alias("model"), F.col(p).cast("double").alias("p"), F.col(y).cast("int").alias("y")]
    records = preds.select(*scored, "t") if "t" in preds.columns else preds.select(row_id, *scored).join(rows.select(row_id, "t"), row_id)
    records = records.where("p IS NOT NULL AND y IN (0, 1)")
    if peaks is None:
        found = moments(rows.select("t", F.lit(True).alias("all"), F.lit(0).alias("y")), tilts, "all") if tilts else None
        top = {r["scenario_id"]: r["peak"] for r in found.select("scenario_id", "peak").collect()} if tilts else {}
        peaks = [top[t.scenario_id] for t in tilts]
    known = Tilts.of([*tilts, Tilt("", 0, 0)])  # the last one is the clean population: all weights are 1
    known = Tilts(known.first, known.second, known.coefficients, known.raw, np.array([*peaks, 0.0]))
    scored = vector_scores(records, known.weights, n)
    clean = lambda c: F.max(F.when(F.col("at") == n - 1, F.col(c))).over(Window.partitionBy("model"))
    scored = scored.select("*", (F.col("roc_auc") - clean("roc_auc")).alias("delta_roc_auc"), (F.col("pr_auc") - clean("pr_auc")).alias("delta_pr_auc"))
    kind = "string" if tilts and isinstance(tilts[0].scenario_id, str) else "int"
    names = spark.createDataFrame([(i, t.scenario_id) for i, t in enumerate(tilts)], f"at int, scenario_id {kind}")
    return scored.join(F.broadcast(names), "at").select("scenario_id", "model", "roc_auc", "pr_auc", "delta_roc_auc", "delta_pr_auc")
