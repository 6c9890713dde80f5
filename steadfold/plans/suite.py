"""The robustness suite: models scored once, then under re-weighted populations, under other dependence within pairs of
features, and on corrupted rows; summarised, compared and tested.

Frames that several questions read are staged in the shared folder. What comes to the driver has a row for a column, a
scenario or a model."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corrupt, metrics, prep, reweight, scenarios, schema, stats
from ..operators.copies import copy_scores, score_cuts
from ..operators.level_counts import level_counts
from ..operators.model import Package, fit_many, score_models
from ..sources.staging import staged
from ..sources.store import RunStore, fingerprint
from .frames import FeatureFrame
from .legacy import NOISE_OF_SHIFTS, areas, by_seed, redraw_line, stress_grid
from .run import TrainedRun


@dataclass(frozen=True)
class SuiteSettings:
    """Levels and limits; orders and ranges are checked."""

    ess_levels: tuple[float, ...] = (0.9, 0.8, 0.7, 0.6)
    weaken: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0)
    strengthen: tuple[float, ...] = (0.125, 0.25, 0.375, 0.5)
    corruption_levels: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
    repetitions: int = 10
    seed: int = 20260926
    n_axes: int = 3
    least_pairs: int = 10
    headline: tuple[tuple[str, float], ...] = (("population", 0.6), ("dependence_weaken", 1.0), ("dependence_strengthen", 0.5), ("corruption", 0.5))

    def __post_init__(self):
        rising = lambda xs: all(a < b for a, b in zip(xs, xs[1:])) and all(0 < x <= 1 for x in xs)
        if not rising([1 - e for e in self.ess_levels]) or not all(0 < e < 1 for e in self.ess_levels):
            raise ValueError("ess_levels must fall and lie between 0 and 1")
        for name in ("weaken", "strengthen", "corruption_levels"):
            if not rising(getattr(self, name)):
                raise ValueError(f"{name} must rise and lie between 0 and 1")
        levels = {"population": self.ess_levels, "dependence_weaken": self.weaken, "dependence_strengthen": self.strengthen, "corruption": self.corruption_levels}
        if self.repetitions < 1 or any(x not in levels[k] for k, x in self.headline):
            raise ValueError("headline levels must be among the levels, and there must be a repetition")

    def headline_level(self, family: str) -> float:
        return dict(self.headline).get(family, dict(self.headline)["corruption"])


@dataclass
class Suite:
    """packages: of each model. instances: model -> (method, seed)."""

    frame: FeatureFrame
    packages: dict[str, Package] = field(default_factory=dict)
    settings: SuiteSettings = SuiteSettings()
    instances: dict[str, tuple[str, int | None]] = field(default_factory=dict)

    @staticmethod
    def of_masks(frame: FeatureFrame, masks: dict[str, str], settings: SuiteSettings = SuiteSettings()) -> Suite:
        """Fit each distinct mask once, on training rows."""
        subsets = {m: [f for f, bit in zip(frame.features, m) if bit == "1"] for m in set(masks.values())}
        made = fit_many(frame.part(True).df, frame.features, frame.label, subsets)
        return Suite(frame, {name: made[m] for name, m in masks.items()}, settings, {name: (name, None) for name in masks})

    @staticmethod
    def of_run(run: TrainedRun, settings: SuiteSettings = SuiteSettings()) -> Suite:
        return Suite(run.frame, run.packages(), settings, run.instances)

    @cached_property
    def schema(self) -> schema.TableProfile:
        return schema.infer(self.frame.part(True).df, self.frame.features)

    @cached_property
    def test(self) -> DataFrame:
        f = self.frame
        return staged(f.part(False).df.select(f.row_id, F.col(f.label).alias("y"), *[F.col(f"`{c}`") for c in f.features]), "test")

    @cached_property
    def predictions(self) -> DataFrame:
        """(row, model, y, p) of the test rows: each model is scored once."""
        return staged(score_models(self.test, self.packages, [self.frame.row_id, "y"]), "predictions")

    @cached_property
    def clean(self) -> DataFrame:
        return staged(metrics.rank_metrics(self.predictions, ["model"]), "clean")

    def _methods(self) -> DataFrame:
        rows = [(name, m, s) for name, (m, s) in self.instances.items()]
        return F.broadcast(self.frame.df.sparkSession.createDataFrame(rows, "model string, method string, seed int"))  # a row for a model

    def models(self) -> DataFrame:
        """(model, method, seed, n_features, n_consistent, n_inconsistent, sign_consistency, clean_roc_auc, clean_pr_auc)."""
        spark = self.frame.df.sparkSession
        corr = metrics.marginal_correlations(self.frame.part(True).df, self.frame.features, self.frame.label)
        coef = spark.createDataFrame([(m, f, float(c)) for m, p in self.packages.items() for f, _, _, c in p if f != "(intercept)"], "model string, feature string, coef double")
        clean = self.clean.select("model", F.col("roc_auc").alias("clean_roc_auc"), F.col("pr_auc").alias("clean_pr_auc"))
        return metrics.sign_consistency(coef, corr, ["model"]).join(clean, "model").join(self._methods(), "model")

    # --- re-weighted populations

    @cached_property
    def pairs(self) -> list[tuple[str, str, str]]:
        """(a, b, kind) of the pairs whose dependence is moved."""
        f, s = self.frame, self.schema
        found, _ = reweight.pair_selection(f.part(True).df, f.part(False).df, s.of("continuous"), s.of("binary"))
        return [(r["a"], r["b"], r["kind"]) for r in found.orderBy("a", "b").collect()]

    @cached_property
    def rows(self) -> tuple[DataFrame, dict[tuple[str, str], int]]:
        """(row, train, y, t), and where in t each number is: an axis's normal score; of a feature in a pair the score that
        pairs take (clipped and rounded, or for a flag in deviations), and its value. All weights are functions of t."""
        f, flags = self.frame, set(self.schema.of("binary"))
        values, vectors, reach, fit = reweight.principal_axes(f.df, f.features, F.col(f.train), self.settings.n_axes)
        axes = reweight.axis_columns(f.features, values, vectors, reach, fit, self.settings.n_axes)
        used = sorted({c for a, b, _ in self.pairs for c in (a, b)})
        plain = {c: f"v{i}" for i, c in enumerate(used)}
        ranked = {**{k: f"a{i}" for i, k in enumerate(axes)}, **{c: n for c, n in plain.items() if c not in flags}}
        wide = f.df.select(f.row_id, F.col(f.train).alias("train"), F.col(f.label).cast("int").alias("y"), *[F.round(c, 9).alias(ranked[k]) for k, c in axes.items()], *[F.col(f"`{c}`").cast("double").alias(n) for c, n in plain.items()])
        long = metrics.long_form(wide, list(ranked.values()), [f.row_id, "train"])
        scores = reweight.normal_scores(long, "value", F.col("train"), "score", ["feature"]).groupBy(f.row_id).pivot("feature", list(ranked.values())).agg(F.first("score"))
        both = wide.join(scores.select(f.row_id, *[F.col(n).alias(f"s_{n}") for n in ranked.values()]), f.row_id)
        moments = prep.moments(wide.where("train"), [n for c, n in plain.items() if c in flags]) if flags & set(used) else {}
        score = lambda c: (F.col(plain[c]) - F.lit(moments[plain[c]][0])) / F.lit(moments[plain[c]][1]) if c in flags else reweight.pair_score(F.col(f"s_{plain[c]}"))
        numbers = {**{("axis", k): F.col(f"s_{ranked[k]}") for k in axes}, **{("score", c): score(c) for c in used}, **{("value", c): F.col(plain[c]) for c in used}}
        return staged(both.select(f.row_id, "train", "y", F.array(*numbers.values()).alias("t")), "rows"), {k: i for i, k in enumerate(numbers)}

    def _population(self) -> tuple[list[dict], list[scenarios.Tilt]]:
        """Rows of the scenario table, and tilts along the principal axes and the distance from the middle, either way.
        Strengths come from training rows' knots; those of the way down from the same knots with their sign changed."""
        s, rows, tilts, (df, at) = self.settings, [], [], self.rows
        for axis in sorted(k for kind, k in at if kind == "axis"):
            place = at["axis", axis]
            values, counts = reweight.knots(df.where("train").select(F.get("t", F.lit(place)).alias("t")), "t")
            for direction, sign in (("up", 1.0), ("down", -1.0)):
                for level, (strength, ok) in zip(s.ess_levels, reweight.calibrate_ess(reweight.ess_share(sign * values, counts), list(s.ess_levels))):
                    name = f"{axis}-{direction}-{level:g}"
                    rows.append({"scenario_id": name, "family": "population", "unit": f"{axis}-{direction}", "direction": direction, "level": level, "strength": strength, "attainable": ok})
                    if ok:
                        tilts.append(scenarios.Tilt(name, place, place, one=sign * strength))
        return rows, tilts

    def _dependence(self) -> tuple[list[dict], list[scenarios.Tilt]]:
        """The same for pairs: each pair's problem is solved in a task of its own, on counts of distinct score pairs."""
        s, (df, at) = self.settings, self.rows
        if not self.pairs:
            return [], []
        places = [(at["score", a], at["score", b]) for a, b, _ in self.pairs]
        flags = set(self.schema.of("binary"))
        squares = [(a not in flags, b not in flags) for a, b, _ in self.pairs]
        ways = [("dependence_weaken", s.weaken), ("dependence_strengthen", s.strengthen)]

        def solve(key, rows):
            import pandas as pd

            k = int(key[0])
            rows, out = rows.sort_values(["a", "b"]), []
            problem = reweight.PairShift(rows["a"].to_numpy(), rows["b"].to_numpy(), rows["n"].to_numpy(float), squares[k])
            for family, levels in ways:
                found = None
                for i, level in enumerate(levels):
                    start = problem.start
                    target = start * (1 - level) if family == "dependence_weaken" else start + level * (np.copysign(1.0, start) - start)
                    found = problem.moved(target) if i == 0 or found else None
                    bend = list(found.bend) if found else [0.0, 0.0]
                    aa = bend.pop(2) if found and squares[k][0] else 0.0
                    bb = bend.pop(2) if found and squares[k][1] else 0.0
                    out.append((k, family, level, found.theta if found else None, bend[0], bend[1], aa, bb, found is not None))
            return pd.DataFrame(out, columns=["pair", "family", "level", "theta", "ba", "bb", "baa", "bbb", "attainable"])

        # each task counts its rows' score pairs before they are exchanged: 63,001 for a pair of numbers at most
        pair = F.array(*[F.struct(F.lit(k).alias("pair"), F.get("t", F.lit(i)).alias("a"), F.get("t", F.lit(j)).alias("b")) for k, (i, j) in enumerate(places)])
        counts = df.where("train").select(F.explode(pair).alias("x")).groupBy("x.pair", "x.a", "x.b").agg(F.count(F.lit(1)).alias("n"))
        made = counts.groupBy("pair").applyInPandas(solve, "pair int, family string, level double, theta double, ba double, bb double, baa double, bbb double, attainable boolean")
        rows, tilts = [], []
        for r in sorted(made.collect(), key=lambda r: (r["pair"], r["family"], r["level"])):  # a row for a pair, family and level
            a, b, kind = self.pairs[r["pair"]]
            name = f"{r['family']}-{a} x {b}-{r['level']:g}"
            rows.append({"scenario_id": name, "family": r["family"], "unit": f"{a} x {b}", "level": r["level"], "strength": r["theta"], "attainable": r["attainable"], "pair_a": a, "pair_b": b, "pair_kind": kind})
            if r["attainable"]:
                tilts.append(scenarios.Tilt(name, *places[r["pair"]], r["theta"], r["ba"], r["bb"], r["baa"], r["bbb"], (at["value", a], at["value", b])))
        return rows, tilts

    @cached_property
    def tilts(self) -> tuple[list[dict], list[scenarios.Tilt]]:
        """Rows of the scenario table, and the attainable scenarios."""
        (rows, tilts), (more, other) = self._population(), self._dependence()
        return rows + more, tilts + other

    @cached_property
    def moments(self) -> DataFrame:
        """scenarios.moments() of all scenarios on either side, and of each unit without weights under `base: unit`."""
        rows, tilts = self.tilts
        unit = {r["scenario_id"]: r["unit"] for r in rows}
        base = {unit[t.scenario_id]: scenarios.Tilt(f"base: {unit[t.scenario_id]}", t.first, t.second, raw=t.raw) for t in tilts}
        return staged(scenarios.moments(self.rows[0], [*tilts, *base.values()]), "moments")

    @cached_property
    def scenarios(self) -> DataFrame:
        """The scenario table. Test rows get the function that training rows give. For a pair: the correlation of its values
        and of its scores on either side, and the changes of means (in deviations) and deviations on test rows."""
        rows, _ = self.tilts
        kinds = {"scenario_id": "string", "family": "string", "unit": "string", "direction": "string", "level": "double", "strength": "double", "attainable": "boolean", "pair_a": "string", "pair_b": "string", "pair_kind": "string"}
        table = self.frame.df.sparkSession.createDataFrame([tuple(r.get(k) for k in kinds) for r in rows], ", ".join(f"{k} {v}" for k, v in kinds.items()))
        side = lambda train: self.moments.where(F.col("part") == F.lit(train))
        out = table.join(scenarios.support(side(True), ["scenario_id"]).select("scenario_id", F.col("ess_fraction").alias("train_ess")), "scenario_id", "left")
        out = out.join(scenarios.support(side(False), ["scenario_id"]).withColumnRenamed("ess_fraction", "test_ess"), "scenario_id", "left")
        for of, name in (("v", "correlation"), ("s", "score_correlation")):
            for train in (True, False):
                found = scenarios.pair_moments(side(train), ["scenario_id"], of)
                paired = F.when(F.col("pair_a").isNotNull(), F.col("corr")).alias(f"{name}_{'train' if train else 'test'}")
                out = out.join(found.select("scenario_id", "corr"), "scenario_id", "left").select(*out.columns, paired)
        found = scenarios.pair_moments(side(False), ["scenario_id"], "v")
        base = found.where("startswith(scenario_id, 'base: ')").select(F.expr("substr(scenario_id, 7)").alias("unit"), *[F.col(c).alias(f"base_{c}") for c in ("mean_a", "mean_b", "sd_a", "sd_b")])
        out = out.join(found.drop("corr"), "scenario_id", "left").join(base, "unit", "left")
        shifts = [((F.col(f"mean_{x}") - F.col(f"base_mean_{x}")) / F.nullif(F.col(f"base_sd_{x}"), F.lit(0.0))).alias(f"mean_shift_{x}") for x in "ab"]
        ratios = [(F.col(f"sd_{x}") / F.nullif(F.col(f"base_sd_{x}"), F.lit(0.0))).alias(f"sd_ratio_{x}") for x in "ab"]
        out = out.select(*[c for c in out.columns if not c.startswith(("base_", "mean_", "sd_"))], *shifts, *ratios)
        ok = F.coalesce(reweight.supported(F.col("train_ess"), F.col("test_ess"), F.least("ess_negatives", "ess_positives")), F.lit(False))
        out = out.withColumn("supported", ok).withColumn("usable", F.col("attainable") & F.col("supported"))
        return staged(reweight.cohort(out, ["unit"]), "scenarios")

    def weights(self, scenario_id: str) -> DataFrame:
        """(row, w) of the test rows under one scenario, with a mean of one."""
        (tilt,) = [t for t in self.tilts[1] if t.scenario_id == scenario_id]
        test = self.rows[0].where("NOT train").select(self.frame.row_id, scenarios.log_weight(tilt).alias("log"))
        return reweight.tilt(test, "log", 1.0).select(self.frame.row_id, "w")

    @cached_property
    def reweighting_scores(self) -> DataFrame:
        """(scenario_id, model, roc_auc, pr_auc, delta_roc_auc, delta_pr_auc)."""
        tilts, f = self.tilts[1], self.frame
        peaks = {r["scenario_id"]: r["peak"] for r in self.moments.where("NOT part").select("scenario_id", "peak").collect()}  # a row for a scenario
        rows = self.rows[0].where("NOT train").select(f.row_id, "t")
        return staged(scenarios.scenario_scores(self.predictions, rows, tilts, f.row_id, peaks=[peaks[t.scenario_id] for t in tilts]), "reweighted")

    # --- corrupted rows

    def corrupted(self) -> DataFrame:
        """The test rows once for each family that applies, level and repetition."""
        f, s, known = self.frame, self.settings, self.schema
        train = f.part(True).df
        # test rows are few bytes and many copies: they are dealt to all cores before they are copied
        rows = self.test.repartition(2 * self.test.sparkSession.sparkContext.defaultParallelism, f.row_id)
        copies = corrupt.bank(rows, list(s.corruption_levels), s.repetitions)
        level, rep, seed = F.col("level"), F.col("repetition"), s.seed
        flags = {c: flag for c, (flag, _) in known.flag_of.items()}
        out = []
        if numbers := known.of("continuous"):
            sd = train.agg(*[F.stddev_samp(F.col(f"`{c}`")).alias(c) for c in numbers]).first().asDict()
            off = {c: o for c, (_, o) in known.flag_of.items()}
            # an available cell is one whose flag is not at its off level; flags that are off at one are turned around
            turned = {c: F.when(F.col(f"`{fl}`") != off[c], 1).otherwise(0) for c, fl in flags.items()}
            here = copies.withColumns({f"_on_{c}": x for c, x in turned.items()})
            on = {c: f"_on_{c}" for c in flags}
            out.append((corrupt.gaussian(here, f.row_id, sd, level, rep, seed, on).drop(*on.values()), "noise"))
            out.append((corrupt.mask_medians(here, f.row_id, prep.medians(train, numbers), level, rep, seed, on).drop(*on.values()), "median_masking"))
        if (alone := known.listed("stand_alone_binary")) or known.groups:
            groups = {p: list(m.items()) for p, m in known.groups.items()}
            out.append((corrupt.redraw(copies, f.row_id, {c: known.shares[c] for c in alone}, groups, level, rep, seed), "redraw"))
        if recorded := known.listed("under_recording_inputs"):
            out.append((corrupt.under_record(copies, f.row_id, recorded, level, rep, seed), "under_recording"))
        if known.flags:
            out.append((corrupt.mask_values(copies, f.row_id, known.flags, level, rep, seed), "masking"))
        rows = [df.withColumn("family", F.lit(name)) for df, name in out]
        whole = rows[0]
        for r in rows[1:]:
            whole = whole.unionByName(r)
        return whole

    def check_structure(self) -> None:
        """Fails if any family's strongest corruption breaks what the profile promises: flags that are 0 or 1, one member of a
        group at most (and one where every clean row has one), and fills where a flag says not available."""
        f, known = self.frame, self.schema
        groups = {p: list(m) for p, m in known.groups.items()}
        dirty = staged(self.corrupted().where((F.col("level") == max(self.settings.corruption_levels)) & (F.col("repetition") == 0)), "strongest")
        for family in sorted(r["family"] for r in dirty.select("family").distinct().collect()):
            units = {} if family in ("noise", "redraw") else known.flags
            corrupt.check_structure(self.test, dirty.where(F.col("family") == family), f.row_id, known.of("binary"), groups, units)

    @cached_property
    def corruption_scores(self) -> DataFrame:
        """(model, family, level, repetition, roc_auc, pr_auc, delta_roc_auc, delta_pr_auc)."""
        self.check_structure()
        s = self.settings
        cells = [(f, float(x), r) for f in corrupt.FAMILIES for x in s.corruption_levels for r in range(s.repetitions)]
        family = F.array_position(F.array(*[F.lit(f) for f in corrupt.FAMILIES]), F.col("family")) - 1
        copies = self.corrupted().withColumn("cell", (family * len(s.corruption_levels) + F.col("level_index")) * s.repetitions + F.col("repetition"))
        scored = copy_scores(copies, self.packages, score_cuts(self.predictions, self.packages))
        names = self.frame.df.sparkSession.createDataFrame([(i, *c) for i, c in enumerate(cells)], "cell int, family string, level double, repetition int")
        out = scored.join(F.broadcast(names), "cell")  # a row for a copy
        clean = self.clean.select("model", F.col("roc_auc").alias("_r"), F.col("pr_auc").alias("_p"))
        return staged(out.join(clean, "model").select("model", "family", "level", "repetition", "roc_auc", "pr_auc", (F.col("roc_auc") - F.col("_r")).alias("delta_roc_auc"), (F.col("pr_auc") - F.col("_p")).alias("delta_pr_auc")), "corruption")

    @cached_property
    def corruption_diagnostics(self) -> DataFrame:
        """(family, level, repetition, eligible, selected, changed, unseen_combinations, rows_with_unseen_combination)."""
        f, s, known = self.frame, self.settings, self.schema
        medians = prep.medians(f.part(True).df, known.of("continuous")) if known.of("continuous") else {}
        return staged(level_counts(self.test, f.row_id, known, medians, list(s.corruption_levels), s.repetitions, s.seed), "diagnostics")

    # --- the earlier grid

    @cached_property
    def legacy(self) -> tuple[DataFrame, DataFrame]:
        """(grid, line): (model, noise, shift, roc_auc, pr_auc) and (model, flip_rate, roc_auc, pr_auc), by the earlier
        typing of columns: numbers have more than two values, all other zeros and ones are flags."""
        f, train = self.frame, self.frame.part(True).df
        kinds = {r["feature"]: r["kind"] for r in schema.legacy_types(train, f.features).collect()}
        numbers, flags = ([c for c in f.features if kinds[c] == k] for k in ("continuous", "dummy"))
        values, vectors, reach, fit = reweight.principal_axes(f.df, f.features, F.col(f.train))
        axis = reweight.axis_columns(f.features, values, vectors, reach, fit, 1)["PC1"] / F.lit(float(values[0]) ** 0.5)
        row = train.agg(*[F.stddev_samp(F.col(f"`{c}`")).alias(c) for c in numbers], *[F.avg(F.col(f"`{c}`").cast("double")).alias(c) for c in flags]).first()
        grid = stress_grid(self.test, f.row_id, "y", self.packages, {c: row[c] for c in numbers}, axis, seed=self.settings.seed)
        line = redraw_line(self.test, f.row_id, "y", self.packages, {c: row[c] for c in flags}, seed=self.settings.seed)
        return staged(grid, "grid"), staged(line, "flips")

    def legacy_tables(self, metric: str = "roc_auc") -> dict[str, DataFrame]:
        """The grid and the line of re-draws by seed, its slices without shift and at one noise, and the areas."""
        grid, line = (by_seed(df, self.instances, levels, metric) for df, levels in zip(self.legacy, (["noise", "shift"], ["flip_rate"])))
        near = lambda c, x: F.abs(F.col(c) - F.lit(x)) < 1e-9
        return {"grid": grid, "noise": grid.where(near("shift", 0.0)).drop("shift"), "shift": grid.where(near("noise", NOISE_OF_SHIFTS)).drop("noise"), "redraw": line, "areas": areas(self.legacy[0], self.instances, metric)}

    # --- summaries

    @cached_property
    def family_scores(self) -> DataFrame:
        """(family, severity, model, method, seed, roc_auc, delta_roc_auc, pr_auc, delta_pr_auc, worst_*, corruption_sd,
        n_scenarios): cohort scenarios alone; families of too few pairs are left out."""
        table = self.scenarios
        small = stats.small_cohorts(table, self.settings.least_pairs).where("excluded").select("family")
        chosen = table.where("usable AND in_cohort").join(small, "family", "left_anti").select("scenario_id", "family", F.col("level").alias("severity"))
        numbers = ["roc_auc", "delta_roc_auc", "pr_auc", "delta_pr_auc"]
        shifted = self.reweighting_scores.join(chosen, "scenario_id").select("family", "severity", "model", *numbers, F.lit(False).alias("dirty"))
        dirty = self.corruption_scores.select("family", F.col("level").alias("severity"), "model", *numbers, F.lit(True).alias("dirty"))
        worst = [F.min(F.when(~F.col("dirty"), F.col(c))).alias(f"worst_{c}") for c in ("roc_auc", "delta_roc_auc")]
        spread = F.stddev_samp(F.when(F.col("dirty"), F.col("roc_auc"))).alias("corruption_sd")
        out = shifted.unionByName(dirty).groupBy("family", "severity", "model").agg(*[F.avg(c).alias(c) for c in numbers], *worst, spread, F.count(F.lit(1)).alias("n_scenarios"))
        return staged(out.join(self._methods(), "model"), "families")

    def tables(self) -> dict[str, DataFrame]:
        """Every table of the suite, by its name."""
        named = {"models": self.models(), "scenarios": self.scenarios, "reweighting_scores": self.reweighting_scores, "corruption_scores": self.corruption_scores, "corruption_diagnostics": self.corruption_diagnostics}
        named |= {"model_family_scores": self.family_scores, "summary": self.summary(), "tests": self.tests(), "sign_vs_degradation": self.sign_vs_degradation()}
        return named | {f"legacy_{k}": df for k, df in self.legacy_tables().items()}

    def write(self, store: RunStore) -> list[str]:
        """Write every table into the run's folder, under the fingerprint of the data and the settings; refused, before
        anything is computed, where another evaluation is written. The tables' names."""
        f = self.frame
        marks = fingerprint(f.df.select(f.row_id, F.col(f.train).alias("train"), f.label, *[F.col(f"`{c}`") for c in f.features])) | {"settings": repr(self.settings), "models": "\n".join(sorted(self.packages))}
        store.claim(marks, list(marks))
        made = self.tables()
        for name, df in made.items():
            df.write.mode("overwrite").parquet(f"{store.path}/suite/{name}")
        return list(made)

    def summary(self) -> DataFrame:
        """(family, severity, method, n_runs, a mean and a deviation over runs of each number, n_scenarios), in order."""
        numbers = ["roc_auc", "delta_roc_auc", "pr_auc", "delta_pr_auc", "worst_roc_auc", "worst_delta_roc_auc", "corruption_sd"]
        out = self.family_scores.groupBy("family", "severity", "method").agg(F.count(F.lit(1)).alias("n_runs"), *[f(c).alias(f"{c}{end}") for c in numbers for f, end in ((F.avg, ""), (F.stddev_samp, "_sd"))], F.max("n_scenarios").alias("n_scenarios"))
        return stats.severity_rank(out).orderBy("family_rank", "severity_rank", "method").drop("family_rank", "severity_rank")

    def tests(self, target: str = "multi", rival: str = "single") -> DataFrame:
        """paired_tests() of the target, with the share of cohort scenarios in which its mean change is above the rival's."""
        known = self.scenarios.where("usable AND in_cohort").select("scenario_id", "family", F.col("level").alias("severity"))
        each = self.reweighting_scores.join(known, "scenario_id").join(self._methods(), "model")
        share = stats.share_better(each, ["family", "severity", "scenario_id"], "method", "delta_roc_auc", target, rival)
        share = share.select("family", "severity", F.lit("delta_roc_auc").alias("statistic"), F.lit(rival).alias("baseline"), F.col("share").alias("scenario_share_better"))
        return stats.paired_tests(self.family_scores, target).join(share, ["family", "severity", "statistic", "baseline"], "left")

    def sign_vs_degradation(self, methods: tuple[str, ...] = ("multi", "single"), least: int = 4) -> DataFrame:
        """(family, severity, n_models, spearman, partial_spearman): sign consistency against the change of each family's
        headline statistic at its headline level, and given the number of features."""
        families = [r["family"] for r in self.family_scores.select("family").distinct().collect()]
        change = F.lit(None).cast("double")
        wanted = F.lit(False)
        for name in families:
            at = (F.col("family") == name) & (F.abs(F.col("severity") - self.settings.headline_level(name)) < 1e-9)
            change, wanted = F.when(at, F.col(stats.headline_statistic(name)[1])).otherwise(change), wanted | at
        points = self.family_scores.where(wanted & F.col("method").isin(*methods)).withColumn("change", change).where("change IS NOT NULL")
        points = points.join(self.models().select("model", "sign_consistency", "n_features"), "model")
        enough = points.groupBy("family", "severity").agg(F.count(F.lit(1)).alias("n_models")).where(F.col("n_models") >= least)
        return enough.join(stats.partial_spearman(points, ["family", "severity"], "sign_consistency", "change", "n_features"), ["family", "severity"])

    def report(self) -> list[str]:
        """One line for each family, severity and method, by the family's headline statistic."""
        out = []
        for r in self.summary().collect():
            score = stats.headline_statistic(r["family"])[1]
            out.append(f"{r['family']} at {r['severity']:g}, {r['method']}: {score} {r[score]:+.4f} over {r['n_runs']} runs of {r['n_scenarios']} scenarios")
        return out

    def test_lines(self) -> list[str]:
        rows = stats.severity_rank(self.tests()).orderBy("family_rank", "severity_rank", "statistic", "baseline").collect()
        return [f"{r['family']} at {r['severity']:g}, {r['statistic']} against {r['baseline']}: {r['mean_difference']:+.4f}, better in {r['n_better']} of {r['n_runs']}, p = {stats.format_p(r['p_value'])}" for r in rows]
