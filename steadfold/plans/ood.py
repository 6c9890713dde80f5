"""Evaluation of a run's models on in-domain and out-of-domain rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, model, stats
from ..sources.staging import staged
from .run import TrainedRun

#: Fixed value: the prevalence that calibrated average precision is given at.
REFERENCE = 0.5


@dataclass
class DomainEvaluation:
    """id_rows and ood_rows: of the run's frame, neither of them trained on."""

    run: TrainedRun
    id_rows: DataFrame
    ood_rows: DataFrame

    def _scored(self, rows: DataFrame, packages: dict[str, model.Package]) -> DataFrame:
        f = self.run.frame
        return model.score_models(rows.select(F.col(f.row_id).alias("row"), F.col(f.label).alias("y"), *f.features), packages, ["row", "y"])

    @cached_property
    def packages(self) -> dict[str, model.Package]:
        return self.run.packages()

    @cached_property
    def predictions(self) -> DataFrame:
        """(domain, row, y, model, method, seed, p), staged: every question reads them."""
        sides = [self._scored(rows, self.packages).withColumn("domain", F.lit(name)) for name, rows in (("id", self.id_rows), ("ood", self.ood_rows))]
        names = F.broadcast(self.run.table(self.id_rows.sparkSession).select("model", "method", "seed"))  # a row for an instance
        return staged(sides[0].unionByName(sides[1]).join(names, "model"), "domains")

    def _by_domain(self, preds: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, id_roc_auc, ..., ood_roc_auc, ..., roc_auc_drop, pr_auc_drop)."""
        out = metrics.score_triple(preds, ["domain", *keys], REFERENCE)
        names = ("roc_auc", "pr_auc", "calibrated_pr_auc")
        of = lambda d, c: F.max(F.when(F.col("domain") == d, F.col(c))).alias(f"{d}_{c}")
        wide = out.groupBy(*keys).agg(*[of(d, c) for d in ("id", "ood") for c in names])
        return wide.withColumns({f"{c}_drop": F.col(f"id_{c}") - F.col(f"ood_{c}") for c in ("roc_auc", "pr_auc")})

    def _signs(self, packages: dict[str, model.Package]) -> DataFrame:
        f = self.run.frame
        corr = metrics.marginal_correlations(f.part(True).df, f.features, f.label)
        coef = [(m, c, float(v)) for m, p in packages.items() for c, _, _, v in p if c != "(intercept)"]
        return metrics.sign_consistency(self.id_rows.sparkSession.createDataFrame(coef, "model string, feature string, coef double"), corr, ["model"])

    def per_seed(self) -> DataFrame:
        """(model, method, seed, n_features, n_inconsistent, sign_consistency, id_*, ood_*, drops)."""
        signs = self._signs(self.packages).select("model", "n_features", "n_inconsistent", "sign_consistency")
        return self._by_domain(self.predictions, ["model", "method", "seed"]).join(signs, "model")

    def tests(self, target: str = "multi") -> DataFrame:
        """(statistic, baseline, n_runs, ..., p_value): target's runs against each other method's, by seed."""
        scores = self.per_seed().select(F.lit("ood").alias("family"), F.lit(0.0).alias("severity"), "method", "seed", "ood_roc_auc", "ood_pr_auc", "roc_auc_drop", "sign_consistency")
        return stats.paired_tests(scores, target, ("ood_roc_auc", "ood_pr_auc", "roc_auc_drop", "sign_consistency")).drop("family", "severity")

    def bootstrap(self, samples: int = 2000, target: str = "multi") -> DataFrame:
        """(baseline, metric, low, high, n_samples) of differences of seed-averaged AUCs and drops."""
        preds = self.predictions.select("domain", "row", F.col("method").alias("model"), "seed", "y", "p")
        side = lambda d: preds.where(F.col("domain") == d).drop("domain")
        return stats.seed_averaged_bootstrap(side("id"), side("ood"), "row", target, samples)

    def tests_with_intervals(self, samples: int = 2000) -> DataFrame:
        made = self.bootstrap(samples).withColumnRenamed("metric", "statistic")
        return stats.with_intervals(self.tests(), made, ["baseline", "statistic"])

    def front(self) -> DataFrame:
        """(seed, ordinal, mask, cv_objective, cv_sign_consistency, n_features, sign_consistency, id_*, ood_*, drops) of every
        mask of every front; a mask that several seeds have is fitted and scored once."""
        masks = sorted({r["mask"] for r in self.run.fronts.select("mask").distinct().collect()})  # of fronts, not of rows
        f = self.run.frame
        made = model.fit_many(f.part(True).df, f.features, f.label, {m: self.run.chosen(m) for m in masks})
        sides = [self._scored(rows, made).withColumn("domain", F.lit(name)) for name, rows in (("id", self.id_rows), ("ood", self.ood_rows))]
        scores = self._by_domain(sides[0].unionByName(sides[1]), ["model"]).join(self._signs(made).select("model", "sign_consistency"), "model")
        fronts = self.run.fronts.select("seed", "ordinal", "mask", F.col("auc").alias("cv_objective"), F.col("sign").alias("cv_sign_consistency"), "n_features")
        return fronts.join(scores.withColumnRenamed("model", "mask"), "mask")

    def front_correlations(self) -> DataFrame:
        return stats.front_correlations(staged(self.front(), "front"))

    def verified_front(self, tolerance: float = 1e-9) -> DataFrame:
        """(n, n_missing, deviation): the fronts' stored objective against one computed again; beyond tolerance it fails."""
        masks = sorted({r["mask"] for r in self.run.fronts.select("mask").distinct().collect()})
        f = self.run.frame
        again = model.fitness(self.run.folds, f.features, f.label, f.row_id)(masks)  # the search's own way: scores that tie there tie here
        new = self.id_rows.sparkSession.createDataFrame([(m, float(a)) for m, (a, _) in again.items()], "mask string, auc double")
        out = stats.largest_deviation(self.run.fronts.select("mask", "auc").distinct(), new, ["mask"], "auc")
        if (row := out.first())["n_missing"] or row["deviation"] > tolerance:
            raise ValueError(f"the stored objectives are not those of these data: {row}")
        return out
