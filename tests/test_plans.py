"""Schema inference, training runs, the suite and out-of-domain evaluation on small tables whose answers are known."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadfold.operators import availability, corrupt, metrics, model, pareto, prep, reweight, schema, search, stats
from steadfold.plans.frames import FeatureFrame
from steadfold.plans.ood import DomainEvaluation
from steadfold.plans.run import distinct_masks, train
from steadfold.plans.suite import Suite, SuiteSettings
from steadfold.sources import store, tables


def mixed(spark, n, seed=0):
    """Numbers, a flag with its value, two one-hot groups and flags of several kinds."""
    rng = np.random.default_rng(seed)
    x1 = rng.standard_normal(n)
    x2 = 0.7 * x1 + math.sqrt(0.51) * rng.standard_normal(n)
    on = (rng.random(n) < 0.7).astype(int)
    lab = np.where(on == 1, rng.normal(10, 2, n), 5.0)
    state, region = rng.choice(3, n, p=[0.5, 0.3, 0.2]), rng.choice(3, n, p=[0.4, 0.4, 0.2])
    common = (rng.random(n) < 0.7).astype(int)
    general = (rng.random(n) < 0.6).astype(int)
    sex = rng.random(n)
    columns = {
        "x1": x1, "x2": x2, "lab": lab, "lab_measured": on, "state_A": state == 0, "state_B": state == 1, "state_C": state == 2, "region_N": region == 0, "region_S": region == 1,
        "med_a": rng.random(n) < 0.4, "med_b": rng.random(n) < 0.4, "rare": rng.random(n) < 0.1, "common": common, "common2": np.where(rng.random(n) < 0.85, common, 1 - common),
        "general": general, "specific": general * (rng.random(n) < 0.6), "female": sex < 0.45, "male_code": sex > 0.6,
    }
    logit = x1 - 0.5 * x2 + 0.5 * on + 0.8 * columns["rare"] - 0.3 * columns["state_B"]
    columns["y"] = rng.random(n) < 1 / (1 + np.exp(-logit))
    names = list(columns)
    rows = [(i, *[float(v) if c in ("x1", "x2", "lab") else int(v) for c, v in zip(names, row)], bool(i % 10 < 7)) for i, row in enumerate(zip(*columns.values()))]
    kinds = ", ".join(f"{c} {'double' if c in ('x1', 'x2', 'lab') else 'int'}" for c in names)
    return FeatureFrame(spark.createDataFrame(rows, f"id long, {kinds}, train boolean"), "id", "y", names[:-1], "train")


def test_inference_on_mixed_columns(spark):
    frame = mixed(spark, 2000)
    found = schema.infer(frame.part(True).df, frame.features)
    assert found.of("continuous") == ["x1", "x2", "lab"] and set(found.groups) == {"state", "region"} and not found.doubts
    assert found.pairings == [("lab_measured", 0, "lab", 5.0, True)] and found.flags == {"lab_measured": (0, {"lab": 5.0})}
    assert list(found.units().values()) == [3, 11, 6, 1, 3]
    pairs = {(a, b, x, y) for a, b, x, y, _ in found.unseen}
    assert ("general", "specific", 0, 1) in pairs and ("female", "male_code", 1, 1) in pairs
    assert len(found.counts()) == 15 and json.loads(found.to_json())["indicators"][0]["fills"] == {"lab": 5.0}
    with pytest.raises(ValueError, match="nulls"):
        schema.infer(frame.df.withColumn("x1", F.when(F.col("id") > 3, F.col("x1"))), frame.features)


def flagged(spark, **columns):
    names = list(columns)
    return spark.createDataFrame([tuple(float(x) for x in row) for row in zip(*columns.values())], names)


def test_pairs_that_names_or_rows_leave_open(spark):
    rng = np.random.default_rng(1)
    n = 300
    off = (rng.random(n) < 0.3).astype(int)
    value = np.where(off == 1, 0.75, rng.random(n))
    other = (rng.random(n) < 0.5).astype(int)

    def pairs(df, names):
        binary = [c for c in names if set(np.unique([r[c] for r in df.collect()])) <= {0.0, 1.0}]
        found, open_ = availability.availability(df, binary, [c for c in names if c not in binary])
        return [(r.flag, r.value, r.by_name) for r in found.orderBy("flag_at").collect()], [(r.flag, r.value, r.reason) for r in open_.orderBy("asked_at").collect()]

    two = {"rate": value, "rate:missing": off, "rate_flag": other}
    found, open_ = pairs(flagged(spark, **two), list(two))
    assert found == [("rate:missing", "rate", False)] and {x[0] for x in open_} == {"rate:missing", "rate_flag"}
    loose = {"x": rng.random(n), "x:missing": off}
    found, open_ = pairs(flagged(spark, **loose), list(loose))
    assert found == [] and [x[:2] for x in open_] == [("x:missing", "x")]
    generic = {"feature_1": rng.random(n), "feature_2": off, "feature_3": rng.random(n), "feature_4": other}
    assert pairs(flagged(spark, **generic), list(generic)) == ([], [])
    same = {"rate": value, "rate:missing": off, "rate_all": rng.random(n)}
    found, _ = pairs(flagged(spark, **same), list(same))
    assert found == [("rate:missing", "rate", True)]
    # a block: act's flag also explains small_other, but 9 of 10 of the other rows hold its fill, too: by chance
    few = (np.arange(n) < 12).astype(int)
    block = {"act": np.where(few == 1, 0.5, rng.random(n)), "act:missing": few, "small_other": np.where((few == 1) | (np.arange(n) % 10 > 0), 0.4, rng.random(n))}
    found, open_ = pairs(flagged(spark, **block), list(block))
    assert found == [("act:missing", "act", True)] and [x[:2] for x in open_] == [("act:missing", "small_other")] and "chance" in open_[0][2]


@pytest.fixture(scope="module")
def run(spark):
    return train(mixed(spark, 1500), [42, 43], size=8, generations=2)


def test_run_has_every_method_once_for_each_seed(run, spark):
    assert [m for m, _ in run.masks].count("all") == 1 and ("all", None) in run.masks
    assert {s for m, s in run.masks if m == "multi"} == {42, 43}
    assert run.masks["all", None] == "1" * 18 and run.table(spark).count() == len(run.masks)
    packages = run.packages()
    assert all(len(p) == run.masks[run.instances[name]].count("1") + 1 for name, p in packages.items())
    name, threshold = run.deployed(("single",))["single"]
    best = max(run.objective[k] for k in run.masks if k[0] == "single")
    assert run.objective[run.instances[name]] == best and 0 < threshold < 1
    assert run.fronts.groupBy("seed", "mask").count().where("count > 1").isEmpty()


def test_suite_has_all_families(run, spark):
    settings = SuiteSettings(ess_levels=(0.9, 0.6), weaken=(0.5, 1.0), strengthen=(0.25, 0.5), corruption_levels=(0.5, 1.0), repetitions=1, least_pairs=1)
    suite = Suite.of_run(run, settings)
    kinds = {r["family"]: r["n"] for r in suite.scenarios.groupBy("family").agg(F.count("*").alias("n")).collect()}
    assert kinds["population"] == 4 * 2 * 2 and kinds["dependence_weaken"] == kinds["dependence_strengthen"] == 2 * len(suite.pairs) > 0
    assert ("x1", "x2") in [p[:2] for p in suite.pairs]
    # halving the dependence about halves it on test rows, though the weights were found on training rows
    name = "dependence_weaken-x1 x x2-0.5"
    scored = run.frame.df
    for c in ("x1", "x2"):
        scored = reweight.normal_scores(scored, c, F.col("train"), f"s_{c}").withColumn(f"s_{c}", reweight.pair_score(F.col(f"s_{c}")))
    test = scored.join(suite.weights(name), "id").withColumn("all", F.lit(1))
    before, after = (metrics.weighted_pearson(test.withColumn("o", F.lit(1.0)), ["all"], "s_x1", "s_x2", w).first()["r"] for w in ("o", "w"))
    assert before > 0.6 and abs(after - before / 2) < 0.15 and test.agg(F.avg("w")).first()[0] == pytest.approx(1.0)
    row = suite.scenarios.where(F.col("scenario_id") == name).first()
    assert row.score_correlation_test == pytest.approx(after) and row.pair_kind == "continuous" and abs(row.mean_shift_a) < 0.3 and abs(row.sd_ratio_a - 1) < 0.3
    # the factorised scores are those of rows with weights
    preds = suite.predictions.join(suite.weights(name), "id")
    plain = {r["model"]: r for r in metrics.rank_metrics(preds, ["model"], w="w").collect()}
    for r in suite.reweighting_scores.where(F.col("scenario_id") == name).collect():
        assert (r.roc_auc, r.pr_auc) == (pytest.approx(plain[r.model].roc_auc), pytest.approx(plain[r.model].pr_auc))
    families = {r["family"] for r in suite.family_scores.select("family").distinct().collect()}
    assert families >= {"population", "dependence_weaken", "noise", "redraw", "under_recording", "masking", "median_masking"}
    tests = suite.tests().collect()
    assert {r["statistic"] for r in tests} == set(stats.STATISTICS) and all(r["n_runs"] == 2 for r in tests if r["statistic"] == "roc_auc")
    assert suite.report() and all(line for line in suite.test_lines())
    order = [(r["family"], r["severity"]) for r in suite.summary().collect()]
    assert order[0] == ("population", 0.9) and order == sorted(order, key=lambda x: (stats.FAMILY_ORDER.index(x[0]), -x[1] if x[0] == "population" else x[1]))
    wide = suite.corrupted().where("family = 'masking' AND level = 1.0")
    units = {"lab_measured": (0, {"lab": 5.0})}
    corrupt.check_structure(suite.test, wide, "id", ["lab_measured"], {}, units)
    assert suite.sign_vs_degradation(least=2).count() > 0


def test_suite_tables_are_written_once(run, spark, tmp_path):
    settings = SuiteSettings(ess_levels=(0.6,), weaken=(1.0,), strengthen=(0.5,), corruption_levels=(0.5,), repetitions=1, least_pairs=1)
    some = {k: v for k, v in run.packages().items() if k in ("multi-42", "single-42", "all")}
    suite = Suite(run.frame, some, settings, {k: run.instances[k] for k in some})
    place = store.RunStore(spark, str(tmp_path / "run"))
    names = suite.write(place)
    assert {"scenarios", "corruption_diagnostics", "legacy_grid", "legacy_areas"} <= set(names)
    for name in names:
        assert spark.read.parquet(f"{place.path}/suite/{name}").columns
    other = Suite(run.frame, some, SuiteSettings(ess_levels=(0.6,), weaken=(1.0,), strengthen=(0.5,), corruption_levels=(0.5,), repetitions=2), suite.instances)
    with pytest.raises(ValueError, match="settings"):
        other.write(place)
    grid = spark.read.parquet(f"{place.path}/suite/legacy_grid")
    assert grid.count() == 121 and set(grid.columns) == {"seed", "noise", "shift", "auc_multi", "auc_single", "auc_all"}
    clean = grid.where("noise = 0 AND shift = 0").first()
    scores = {r.model: r.roc_auc for r in suite.clean.collect()}
    assert (clean.auc_multi, clean.auc_all) == (pytest.approx(scores["multi-42"]), pytest.approx(scores["all"]))
    flips = spark.read.parquet(f"{place.path}/suite/legacy_redraw")
    assert flips.count() == 11 and flips.where("flip_rate = 0").first().auc_all == pytest.approx(scores["all"])
    areas = {r.method: r.aurs for r in spark.read.parquet(f"{place.path}/suite/legacy_areas").collect()}
    assert set(areas) == {"multi", "single", "all"} and all(0.5 < a < 1.1 for a in areas.values())
    # diagnostics of a family are what comparing its copies with the clean rows gives
    found = {r.family: r for r in suite.corruption_diagnostics.collect()}
    dirty = suite.corrupted().where("family = 'under_recording'")
    lost = suite.schema.listed("under_recording_inputs")
    both = dirty.join(suite.test.select("id", *[F.col(c).alias(f"was_{c}") for c in lost]), "id")
    changed = sum(both.where(F.col(c) != F.col(f"was_{c}")).count() for c in lost)
    assert found["under_recording"].changed == changed > 0


def test_deployment_metrics(run):
    rows = run.deployment_metrics().collect()
    assert len(rows) == len(run.masks) and sum(r.chosen for r in rows) == 4
    for r in rows:
        assert r.balanced_accuracy == pytest.approx((r.sensitivity + r.specificity) / 2) and 0 < r.threshold < 1 and r.n_features == run.masks[run.instances[r.model]].count("1")
        assert not r.chosen or r.cv_objective == max(x.cv_objective for x in rows if x.method == r.method)


def test_domains(run, spark):
    rest = run.frame.df.where("NOT train")
    domains = DomainEvaluation(run, rest.where("x1 < 0.3"), rest.where("x1 >= 0.3"))
    out = domains.per_seed().collect()
    assert len(out) == len(run.masks) and all(r["roc_auc_drop"] == pytest.approx(r["id_roc_auc"] - r["ood_roc_auc"]) for r in out)
    assert domains.verified_front().first()["deviation"] < 1e-9
    intervals = domains.bootstrap(30).collect()
    assert {r["metric"] for r in intervals} == {"ood_roc_auc", "roc_auc_drop"} and all(r["low"] <= r["high"] for r in intervals)
    assert domains.front_correlations().count() == 2


def test_exact_quantiles_are_those_of_numpy(spark):
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 40_001):
        a, b = rng.standard_normal(n), rng.integers(0, 3, n).astype(float)
        df = spark.createDataFrame([(float(x), float(y) if i else None) for i, (x, y) in enumerate(zip(a, b))], "a double, b double")
        for q in (0.5, 0.1):
            got = prep.exact_quantiles(df, ["a", "b"], q)
            assert got["a"] == pytest.approx(np.quantile(a, q)) and got["b"] == (pytest.approx(np.quantile(b[1:], q)) if n > 1 else None)


def test_running_sums_with_one_key_for_most_rows(spark):
    rng = np.random.default_rng(5)
    rows = [("hot" if i % 10 else None if i % 20 else "rare", float(i)) for i in rng.permutation(3000)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7).withColumn("one", F.lit(1).cast("long"))
    got = metrics.prefix_sums(df, ["k"], "v", {"below": "one"}, {"n": "one"}).collect()
    place = {}
    for k, v in sorted(rows, key=lambda r: r[1]):
        place[k, v] = len([1 for x in place if x[0] == k])
    assert {(r.k, r.v): r.below for r in got} == place and {r.k: r.n for r in got} == {k: sum(x == k for x, _ in rows) for k in ("hot", "rare", None)}


def test_null_values_have_no_place(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 2.0)], "id int, v double")
    assert {r.id: r.cdf for r in reweight.ecdf(df, "v", F.lit(True)).collect()} == {1: 0.25, 2: None, 3: 0.75}


def test_signed_ranks_count_zeros_and_choose_the_approximation(spark):
    df = spark.createDataFrame([("a", d) for d in (0.1, 0.2, -0.3, 0.4, 0.0, 1e-17)] + [("b", 0.0), ("b", None)] + [("c", d) for d in (0.1, 0.2, 0.3, 0.4, 0.5)], "k string, d double")
    sums = stats.signed_ranks(df, ["k"], "d")
    got = {r.k: (r.n, r.w_plus, r.w_minus, r.zeros) for r in sums.collect()}
    assert got == {"a": (4, 7.0, 3.0, 2), "c": (5, 15.0, 0.0, 0)}
    p = {r.k: r.p_value for r in stats.with_p(sums, ["k"]).collect()}
    assert p["c"] == pytest.approx(2 / 32) and p["a"] == pytest.approx(math.erfc(2 / math.sqrt(4 * 5 * 9 / 24) / math.sqrt(2)))


def test_each_mask_is_asked_once():
    asked = []
    fit = search.Remembered(lambda masks: asked.extend(masks) or {m: (m.count("1") / 4, 0.0) for m in masks})
    fit(["1000", "1100", "1000"])
    fit(["1100", "1110"])
    assert asked == ["1000", "1100", "1110"] and fit.asked == 3
    assert search.all_features(4) == "1111"
    with pytest.raises(ValueError):
        search.bits_of("10a", 3)


def test_selection_rules(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 0.5), (1, 1, 0.6, 1.0), (1, 2, 0.96, 0.95), (1, 3, 0.8, 0.75)], "seed int, ordinal int, auc double, sign double")
    assert [pareto.select_solution(df, ["seed"], r).first()["ordinal"] for r in ("knee", "max_auc", "max_sign")] == [2, 0, 1]
    with pytest.raises(ValueError):
        pareto.select_solution(df, ["seed"], "other")
    same = spark.createDataFrame([(1, 4, "a", 0.1), (1, 2, "a", 0.2), (2, 9, "a", 0.3)], "seed int, ordinal int, mask string, auc double")
    assert sorted(tuple(r) for r in distinct_masks(same).collect()) == [(1, 2, "a", 0.2), (2, 9, "a", 0.3)]


def test_run_folder_refuses_resumes_and_finds(spark, tmp_path):
    run = store.RunStore(spark, str(tmp_path / "r1"))
    marks = {"rows": "3", "hash": "x"}
    assert run.open(marks, ["hash"]) == [] and run.open({**marks, "rows": "4"}, ["hash"]) == ["rows"]
    front = [(0, "10", 0.7, 1.0, 1)]
    assert run.import_results({1: front, 2: front}) == [1, 2] and run.import_results({2: front, 3: front}) == [3]
    assert run.seeds() == [1, 2, 3] and run.fronts().count() == 3
    run.claim({"hash": "x"}, ["hash"])
    with pytest.raises(ValueError):
        run.claim({"hash": "y"}, ["hash"])
    run.write_json("fingerprint.json", {"hash": "x", "rows": "5"})  # over the old one
    other = store.RunStore(spark, str(tmp_path / "r2"))
    other.open({"hash": "z"}, ["hash"])
    paths = [str(tmp_path / x) for x in ("r1", "r2", "r3")]
    assert store.newest_run(spark, paths, {"hash": "x"}, ["hash"]) == paths[0] and store.newest_run(spark, paths, {"hash": "q"}, ["hash"]) is None
    assert store.find_files(spark.range(3).toDF("a"), {"b": spark.range(4).toDF("a")}) is None


def test_scans(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.123456, "a,b"), (0, 2.0, None)], "y int, x double, s string")
    tables.write_csv(df, str(tmp_path / "c"), digits=3)
    assert tables.header_columns(spark, str(tmp_path / "c")) == ["y", "x", "s"]
    back = tables.csv_table(spark, str(tmp_path / "c"), "y int, x double, s string")
    assert sorted(tuple(r) for r in back.select("y", "x").collect()) == [(0, 2.0), (1, 0.123)]
    assert tables.checked_split(df, "y", ["x"]).columns == ["y", "x"]
    with pytest.raises(ValueError):
        tables.checked_split(df, "y", ["z"])
    with pytest.raises(ValueError):
        prep.official_split(df, "s", ["a,b"])
    with pytest.raises(ValueError):
        metrics.score(df, [], "other")


def test_structure_breaks_raise(spark):
    clean = spark.createDataFrame([(i, 1, 0) for i in range(5)], "id int, a int, b int")
    with pytest.raises(ValueError, match="none of g"):
        corrupt.check_structure(clean, clean.withColumn("a", F.lit(0)), "id", ["a", "b"], {"g": ["a", "b"]}, {})
    with pytest.raises(ValueError):
        corrupt.legacy_redraw(clean, "id", ["a"], 1.5)
    assert corrupt.legacy_noise(clean, "id", {"a": 1.0}, 0.0) is clean


def test_levels_refuse_what_is_no_category(spark, monkeypatch):
    monkeypatch.setattr(prep, "MOST_LEVELS", 5)
    with pytest.raises(ValueError):
        prep.one_hot(spark.range(9).withColumn("c", F.col("id").cast("string")), ["c"])


def test_names_split():
    assert [availability.split_name(x) for x in ("a:b", "a.b_c", "a_", "_a", "abc", "__a", "a__b")] == [("a", ":"), ("a.b", "_"), ("a", "_"), None, None, ("_", "_"), ("a_", "_")]


def test_knots_are_fine_and_few(spark):
    df = spark.range(20_000).select((F.randn(3) * 2).alias("t"))
    values, counts = reweight.knots(df, "t")
    exact = np.array([r.t for r in df.collect()])
    assert counts.sum() == 20_000 and len(values) < 4000
    for s in (0.3, 1.0):
        assert reweight.ess_share(values, counts)(s) == pytest.approx(reweight.ess_share(exact, np.ones(len(exact)))(s), rel=1e-4)


def test_packages_score_like_the_fit(run):
    frame = run.frame
    package = model.fit_frame(frame.part(True).df, ["x1", "x2"], "y")
    got = model.score_models(frame.part(False).df, {"m": package}, ["id", "y"])
    assert 0.6 < metrics.rank_metrics(got, ["model"]).first()["roc_auc"] < 0.95
