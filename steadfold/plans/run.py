"""A training run: the masks of four methods and several seeds, their final models, and which of them to deploy."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, model, pareto, prep, search
from ..sources.staging import staged
from .frames import FeatureFrame

#: The methods, in the order of reports; those whose result a seed changes.
METHODS = ("multi", "single", "forward", "all")
SEEDED = ("multi", "single")


@dataclass
class TrainedRun:
    """masks: of each (method, seed); a method that comes out alike for every seed is there once, with no seed. fronts: of
    the two-objective search: seed, ordinal, mask, auc, sign, n_features, each mask of a seed once. objective: the
    cross-validated one of each instance. folds: the training rows with their fold."""

    frame: FeatureFrame
    folds: DataFrame
    fronts: DataFrame
    masks: dict[tuple[str, int | None], str]
    objective: dict[tuple[str, int | None], float]

    @property
    def instances(self) -> dict[str, tuple[str, int | None]]:
        """The name of each instance: the method, and its seed if it has one."""
        return {m if s is None else f"{m}-{s}": (m, s) for m, s in self.masks}

    def chosen(self, mask: str) -> list[str]:
        return [f for f, bit in zip(self.frame.features, mask) if bit == "1"]

    def packages(self) -> dict[str, model.Package]:
        """The final model of each instance: each distinct mask is fitted once, on all training rows."""
        subsets = {m: self.chosen(m) for m in sorted(set(self.masks.values()))}
        made = model.fit_many(self.frame.part(True).df, self.frame.features, self.frame.label, subsets)
        return {name: made[self.masks[key]] for name, key in self.instances.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        """(model, method, seed, mask, n_features)."""
        rows = [(name, m, s, self.masks[m, s], self.masks[m, s].count("1")) for name, (m, s) in self.instances.items()]
        return spark.createDataFrame(rows, "model string, method string, seed int, mask string, n_features int")

    def thresholds(self, names: list[str]) -> dict[str, float]:
        """The threshold at which each instance's out-of-fold scores are balanced. All fits of a fold are made together."""
        subsets = {n: self.chosen(self.masks[self.instances[n]]) for n in names}
        f, scored = self.frame, None
        for fold in sorted(r[0] for r in self.folds.select("fold").distinct().collect()):
            made = model.fit_many(self.folds.where(F.col("fold") != fold), f.features, f.label, subsets)
            part = model.score_models(self.folds.where(F.col("fold") == fold), made, [f.row_id, f.label])
            scored = part if scored is None else scored.unionByName(part)
        return {r["model"]: r["threshold"] for r in metrics.balanced_threshold(scored, ["model"], f.row_id, f.label).collect()}

    def deployment_metrics(self) -> DataFrame:
        """(model, method, seed, cv_objective, n_features, threshold, accuracy, roc_auc, pr_auc, f1_score, sensitivity,
        specificity, balanced_accuracy, chosen) of every instance on the test rows, at the threshold that training rows
        give it; chosen: whether its method would deploy it, which no test row decides."""
        f, spark, best = self.frame, self.frame.df.sparkSession, {n for n, _ in self._best(METHODS).values()}
        at = self.thresholds(list(self.instances))
        rows = [(n, m, s, float(self.objective[m, s]), self.masks[m, s].count("1"), float(at[n]), n in best) for n, (m, s) in self.instances.items()]
        known = F.broadcast(spark.createDataFrame(rows, "model string, method string, seed int, cv_objective double, n_features int, threshold double, chosen boolean"))
        scored = staged(model.score_models(f.part(False).df, self.packages(), [f.row_id, f.label]).join(known.select("model", "threshold"), "model"), "deployment")
        cells = metrics.confusion(scored, ["model"], F.col("threshold"), f.label)
        out = known.join(cells, "model").join(metrics.rank_metrics(scored, ["model"], f.label), "model")
        return out.select("model", "method", "seed", "cv_objective", "n_features", "threshold", "accuracy", "roc_auc", "pr_auc", "f1_score", "sensitivity", "specificity", "balanced_accuracy", "chosen")

    def _best(self, methods: tuple[str, ...]) -> dict[str, tuple[str, tuple[str, int | None]]]:
        """method -> the instance with the best objective; of equals the one with the smaller seed."""
        rank = lambda x: (-self.objective[x[1]], x[1][1] if x[1][1] is not None else -1)
        return {m: min(((n, k) for n, k in self.instances.items() if k[0] == m), key=rank) for m in methods}

    def deployed(self, methods: tuple[str, ...] = METHODS) -> dict[str, tuple[str, float]]:
        """method -> (model, threshold): the instance with the best objective, of equals the one with the smaller seed, and
        the threshold at which its out-of-fold scores are balanced."""
        picked = self._best(methods)
        found = self.thresholds([n for n, _ in picked.values()])
        return {m: (n, found[n]) for m, (n, _) in picked.items()}


def distinct_masks(df: DataFrame, seed: str = "seed", mask: str = "mask", ordinal: str = "ordinal") -> DataFrame:
    """Each mask of a seed once: the row with the lowest ordinal."""
    rest = [c for c in df.columns if c not in (seed, mask, ordinal)]
    first = F.min_by(F.struct(ordinal, *rest), F.col(ordinal)).alias("_first")
    return df.groupBy(seed, mask).agg(first).select(seed, mask, "_first.*").select(*df.columns)


def train(frame: FeatureFrame, seeds: list[int], size: int = 40, generations: int = 10, rule: str = "knee") -> TrainedRun:
    """Search with every method on the training rows' folds. rule: which solution of a front is a run's. The frame and the
    folds are staged: dozens of jobs read them, and texts are parsed once."""
    spark = frame.df.sparkSession
    frame = replace(frame, df=staged(frame.df, "frame"))
    folds = staged(prep.stratified_folds(frame.df.where(F.col(frame.train)), frame.label, frame.row_id), "folds")
    fit = search.Remembered(model.fitness(folds, frame.features, frame.label, frame.row_id))
    ask = lambda masks: dict(zip(masks, fit(masks)))  # noqa: E731  one memory for all methods
    n = len(frame.features)
    evolved = search.nsga2(ask, n, seeds, size, generations)
    rows = [(e.seed, i, m, float(a), float(s), m.count("1")) for e in evolved for i, (m, (a, s)) in enumerate(zip(e.population, e.points))]
    points = spark.createDataFrame(rows, "seed int, ordinal int, mask string, auc double, sign double, n_features int")
    fronts = pareto.pareto_front(distinct_masks(points), ["seed"])
    masks: dict[tuple[str, int | None], str] = {("multi", r["seed"]): r["mask"] for r in pareto.select_solution(fronts, ["seed"], rule).collect()}
    masks |= {("single", e.seed): e.population[0] for e in search.genetic(ask, n, seeds, size, generations)}
    path = search.forward(ask, n)
    masks |= {("forward", s): path[-1][0] for s in seeds} | {("all", s): search.all_features(n) for s in seeds}
    once = [m for m in METHODS if m not in SEEDED and len({x for (k, _), x in masks.items() if k == m}) == 1]
    masks = {k: v for k, v in masks.items() if k[0] not in once} | {(m, None): next(v for k, v in masks.items() if k[0] == m) for m in once}
    order = sorted(masks, key=lambda k: (METHODS.index(k[0]), k[1] is not None, k[1] or 0))
    return TrainedRun(frame, folds, fronts, {k: masks[k] for k in order}, {k: fit([masks[k]])[0][0] for k in order})
