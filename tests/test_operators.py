"""Operators against definitions, closed forms and small tables made by hand."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadfold.functions.columns import hash_uniform, probit
from steadfold.operators import availability, corrupt, metrics, model, pareto, prep, reweight, schema, search, stats
from steadfold.sources.store import RunStore, compare_fingerprints, fingerprint, same_rows


def brute_auc(y, p, w):
    top = sum(a * b * ((x > z) + (x == z) / 2) for (x, a, k), (z, b, m) in itertools.product(list(zip(p, w, y)), repeat=2) if k and not m)
    return top / (sum(a for a, k in zip(w, y) if k) * sum(a for a, k in zip(w, y) if not k))


def brute_ap(y, p, w):
    out, pos = 0.0, sum(a for a, k in zip(w, y) if k)
    for t in sorted(set(p), reverse=True):
        tp = sum(a for a, k, x in zip(w, y, p) if k and x >= t)
        fp = sum(a for a, k, x in zip(w, y, p) if not k and x >= t)
        out += sum(a for a, k, x in zip(w, y, p) if k and x == t) / pos * tp / (tp + fp)
    return out


def frame(spark, **columns):
    names = list(columns)
    return spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in row) for row in zip(*columns.values())], names)


def test_weighted_rank_metrics_with_ties(spark):
    rng = np.random.default_rng(0)
    y, p, w = rng.integers(0, 2, 60), np.round(rng.random(60), 1), rng.random(60) + 0.1
    got = metrics.rank_metrics(frame(spark, y=y, p=p, w=w), [], "y", "p", "w").first()
    assert got.roc_auc == pytest.approx(brute_auc(y, p, w)) and got.pr_auc == pytest.approx(brute_ap(y, p, w))


def test_rank_metrics_null_with_one_class(spark):
    got = metrics.rank_metrics(frame(spark, y=[1, 1], p=[0.1, 0.2]), [], "y", "p").first()
    assert got.roc_auc is None and got.pr_auc is None


def test_rank_metrics_keep_null_keys(spark):
    df = spark.createDataFrame([(None, 1, 0.9), (None, 0, 0.1), (1, 1, 0.1), (1, 0, 0.9)], "seed int, y int, p double")
    assert {r.seed: r.roc_auc for r in metrics.rank_metrics(df, ["seed"]).collect()} == {None: 1.0, 1: 0.0}


def test_class_normalisation_keeps_auc(spark):
    rng = np.random.default_rng(1)
    df = frame(spark, y=rng.integers(0, 2, 50), p=rng.random(50), w=rng.random(50) + 0.1)
    after = metrics.class_normalised(df, [], "y", "w")
    assert metrics.rank_metrics(after, [], "y", "p", "w").first().roc_auc == pytest.approx(metrics.rank_metrics(df, [], "y", "p", "w").first().roc_auc)
    assert {r.y: r.s for r in after.groupBy("y").agg(F.sum("w").alias("s")).collect()} == pytest.approx({r.y: r.n for r in df.groupBy("y").agg(F.count("y").alias("n")).collect()})


def test_constant_column_correlates_to_zero(spark):
    df = frame(spark, a=[1.0, 1.0, 1.0], b=[1.0, 2.0, 4.0], y=[0, 1, 1])
    assert {r.feature: r["corr"] for r in metrics.marginal_correlations(df, ["a", "b"], "y").collect()}["a"] == 0.0


def test_balanced_threshold(spark):
    df = frame(spark, id=range(6), y=[0, 0, 0, 1, 1, 1], p=[0.1, 0.2, 0.3, 0.7, 0.8, 0.9], k=["a"] * 6)
    assert metrics.balanced_threshold(df, ["k"], "id").first().threshold == 0.7


def test_probit_and_draws(spark):
    ps = [1e-6, 0.01, 0.3, 0.5, 0.9, 0.999999]
    got = [r.z for r in frame(spark, p=ps).select(probit(F.col("p")).alias("z")).collect()]
    assert [0.5 * math.erfc(-z / math.sqrt(2)) for z in got] == pytest.approx(ps, rel=1e-6)
    df = spark.range(2000).select(hash_uniform(1, "x", F.col("id")).alias("u"))
    assert 0.47 < df.agg(F.avg("u")).first()[0] < 0.53


def test_tilt_strength_is_root_of_minus_log_ess():
    t = np.sort(np.random.default_rng(2).standard_normal(200_000))
    found = reweight.calibrate_ess(reweight.ess_share(t, np.ones(len(t))), [0.9, 0.8, 0.7, 0.6])
    assert [s for s, _ in found] == pytest.approx([math.sqrt(-math.log(e)) for e in (0.9, 0.8, 0.7, 0.6)], abs=0.02)
    two = reweight.calibrate_ess(reweight.ess_share(np.array([0.0, 1.0]), np.array([1.0, 9.0])), [0.95, 0.5])
    assert two[1] == (20.0, False)
    with pytest.raises(ValueError):
        reweight.calibrate_ess(lambda s: 1.0, [0.5, 0.6])


def test_pair_shift_keeps_means_and_reaches_targets():
    rng = np.random.default_rng(3)
    a = rng.standard_normal(400)
    b = 0.6 * a + 0.8 * rng.standard_normal(400)
    p = reweight.PairShift(np.clip(a, -2.5, 2.5), np.clip(b, -2.5, 2.5), np.ones(400), (True, True))
    thetas = [0.0]
    for target in [p.start * x for x in (0.75, 0.5, 0.25, 0.0)]:
        found = p.moved(target)
        assert found.error <= 1e-6 and found.reached == pytest.approx(target, abs=1e-6)
        for column in (p.a, p.b, p.a**2, p.b**2):
            assert found.mass @ column == pytest.approx(p.base @ column, abs=1e-6)
        log = np.log(found.mass) - found.theta * p.a * p.b - p.kept(p.a, p.b) @ found.bend
        assert np.ptp(log) < 1e-6  # weights of the exponential form, so of greatest entropy
        thetas.append(found.theta)
    assert thetas == sorted(thetas, reverse=True) and 0 < found.ess_share < 1
    assert p.moved(0.999) is None and reweight.calibrate_correlation(p, [0.9999, 0.5])[1] != 0.5


def test_pair_shift_of_flags_and_constants():
    x = np.array([0.0, 0.0, 1.0, 1.0])
    y = np.array([0.0, 1.0, 0.0, 1.0])
    p = reweight.PairShift(x, y, np.array([40.0, 10.0, 15.0, 35.0]), (False, False))
    found = p.moved(p.start / 2)
    q = found.mass
    assert q[2] + q[3] == pytest.approx(0.5) and q[1] + q[3] == pytest.approx(0.45)
    assert found.theta == pytest.approx(np.log(q[3] * q[0] / q[1] / q[2]) - np.log(35 * 40 / 10 / 15), abs=1e-6)
    assert reweight.PairShift(np.ones(3), y[:3], np.ones(3), (True, True)).moved(0.5) is None


def test_noise_is_linear_in_level_and_masking_nested(spark):
    df = spark.range(200).select("id", (F.col("id") * 1.0).alias("x"), F.lit(1).alias("f"))
    at = lambda level: {r.id: r.x for r in corrupt.gaussian(df, "id", {"x": 2.0}, level).collect()}
    zero, half, one = at(0.0), at(0.5), at(1.0)
    assert zero == {i: float(i) for i in range(200)}
    assert all(one[i] - i == pytest.approx(2 * (half[i] - i)) for i in range(200))
    hit = lambda level: {r.id for r in corrupt.under_record(df, "id", ["f"], level).where("f = 0").collect()}
    assert hit(0.2) < hit(0.6) and len(hit(1.0)) == 200


def test_masking_at_one_changes_all_and_is_sound(spark):
    df = frame(spark, id=range(40), flag=[0, 1] * 20, value=[7.0, 7.5] * 20)
    units = {"flag": (1, {"value": 7.5})}
    dirty = corrupt.mask_values(df, "id", units, 1.0)
    assert dirty.where("flag = 1 AND value = 7.5").count() == 40
    assert all(r.n == 0 for r in corrupt.violations(df, dirty, "id", ["flag"], {}, units).collect())
    assert corrupt.created_combinations(df, dirty.withColumn("other", F.lit(1)), "id", []).first()["rows"] == 0


def test_availability_by_name():
    names = ["rate", "rate:missing", "rate_flag", "lab", "lab_measured"]
    flags = ["rate:missing", "rate_flag", "lab_measured"]
    asked = availability.same_names(flags, [c for c in names if c not in flags])
    assert asked == [("rate", "rate:missing"), ("rate", "rate_flag"), ("lab", "lab_measured")]
    assert availability.same_names([], ["f_1", "f_2"]) == [] == availability.same_names(["f_1", "f_2"], ["f_3"])
    assert availability.split_name("_x") is None and availability.split_name("a.b_c") == ("a.b", "_")


def test_groups_need_exclusive_members(spark):
    df = frame(spark, s_A=[1, 0, 0], s_B=[0, 1, 0], m_a=[1, 1, 0], m_b=[1, 0, 0])
    rows = schema.onehot_groups(df, ["s_A", "s_B", "m_a", "m_b"]).collect()
    assert {r.feature for r in rows} == {"s_A", "s_B"} and rows[0].none_share == pytest.approx(1 / 3)


def test_statistical_pairs(spark):
    n = 200
    rng = np.random.default_rng(4)
    on = (np.arange(n) % 5 > 0).astype(int)
    df = frame(spark, on=on, lab=np.where(on == 1, rng.normal(10, 2, n), 5.0), free=rng.normal(0, 1, n))
    rows = availability.availability_statistical(df, ["on"], ["lab", "free"]).collect()
    assert [(r.flag, r.feature, r.level, r.fill) for r in rows] == [("on", "lab", 0, 5.0)]


def test_fits_ignore_test_rows(spark):
    rows = [(i, float(i % 7), i % 10 < 7) for i in range(50)]
    a = spark.createDataFrame(rows, "id int, x double, train boolean")
    b = spark.createDataFrame([(i, x if t else 1e6, t) for i, x, t in rows], "id int, x double, train boolean")
    left = prep.standardise(a, ["x"], F.col("train")).where("train").orderBy("id").collect()
    assert left == prep.standardise(b, ["x"], F.col("train")).where("train").orderBy("id").collect()


def test_join_refuses_repeated_keys(spark):
    one = frame(spark, k=[1, 2], v=[1, 2])
    with pytest.raises(ValueError):
        prep.validated_left_join(one, frame(spark, k=[1, 1], w=[1, 2]), "k")


def test_local_fit_stops_where_rounding_hides_descent(monkeypatch):
    rng = np.random.default_rng(3)
    n = np.floor(np.exp(rng.normal(6, 1.2, 4000)))
    x = np.tile(np.column_stack([n, np.floor(n / 6 + rng.normal(0, 3, 4000)), rng.random(4000) < 0.3, n / (np.floor(n / 6) + 1)]), (25, 1))
    y = np.tile((rng.random(4000) < 1 / (1 + np.exp(2 - np.log(n) / 3))).astype(float), 25)
    asked, plain = [], np.logaddexp
    monkeypatch.setattr(np, "logaddexp", lambda *a: asked.append(1) or plain(*a))
    (z,) = model.standardised(x)
    for use in ([0], [1], [0, 1], [0, 2], [1, 3], [0, 1, 2], [0, 1, 2, 3]):
        asked.clear()
        coef, free = model.fit_logistic(z[:, use], y)
        assert len(asked) <= 20
        off = np.r_[coef, 0.0] + np.column_stack([z[:, use], np.ones(len(y))]).T @ (1 / (1 + np.exp(-z[:, use] @ coef - free)) - y)
        assert np.abs(off).max() < 1e-10 * len(y)


def test_logistic_fit_and_distributed_fit_agree(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 3))
    y = (rng.random(300) < 1 / (1 + np.exp(-x @ [1, -2, 0.5]))).astype(int)
    df = frame(spark, id=range(300), a=x[:, 0], b=x[:, 1], c=x[:, 2], y=y)
    near = model.fit_frame(df, ["a", "b", "c"], "y")
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    coef, free = model.fit_logistic(z, y)
    assert [r[3] for r in near] == pytest.approx([*coef, free], abs=1e-8)
    two = model.fit_many(df, ["a", "b", "c"], "y", {"ac": ["a", "c"], "none": []})
    assert [r[3] for r in two["ac"]] == pytest.approx([*model.fit_logistic(z[:, [0, 2]], y)[0], model.fit_logistic(z[:, [0, 2]], y)[1]], abs=1e-8)
    assert two["none"] == [("(intercept)", 0.0, 1.0, pytest.approx(math.log(y.mean() / (1 - y.mean()))))]
    folds = prep.stratified_folds(df, "y", "id")
    masks = ["111", "101", "000"]
    local = model.fitness(folds, ["a", "b", "c"], "y", "id")(masks)
    spread = model.evaluate_distributed(folds, ["a", "b", "c"], "y", masks)
    assert all(local[m] == pytest.approx(spread[m], abs=1e-9) for m in masks)
    p = df.withColumn("p", model.score_column(near)).orderBy("id").toPandas()["p"]
    assert model.auc(y, p.to_numpy()) == pytest.approx(metrics.rank_metrics(df.withColumn("p", model.score_column(near)), [], "y", "p").first().roc_auc)


def test_search_is_reproducible_and_non_dominated():
    def fitness(masks):
        return {m: (m[:4].count("1") / 4, 1 - m.count("1") / 8) for m in masks}

    a, b = (search.nsga2(fitness, 8, s, size=16, generations=8) for s in ([1], [2, 1]))
    assert a[0].population == b[1].population
    points = a[0].points
    first = [points[i] for i in search.fronts(points)[0]]
    assert not any(search.dominates(p, q) for p in first for q in first)
    assert search.genetic(fitness, 8, [1], size=16, generations=8)[0].points[0][0] == 1.0
    assert [m for m, _ in search.forward(fitness, 8)][-1] == "11110000"
    with pytest.raises(ValueError):
        search.bits_of("01a", 3)


def test_knee(spark):
    df = spark.createDataFrame([(0, 1.0, 0.5), (1, 0.6, 1.0), (2, 0.96, 0.95), (3, 0.8, 0.75)], "ordinal int, auc double, sign double")
    assert pareto.knee(df, []).first().ordinal == 2
    assert {r.ordinal for r in pareto.pareto_front(df.withColumn("k", F.lit(1)), ["k"]).collect()} == {0, 1, 2}


def test_signed_rank_p():
    assert stats.signed_rank_p(5, 15, 0) == pytest.approx(2 / 32)
    assert math.isnan(stats.signed_rank_p(1, 1, 0))
    assert stats.signed_rank_p(10, 27.5, 27.5, ties=6) == pytest.approx(1.0)


def test_rounding_noise_is_a_tie(spark):
    df = spark.createDataFrame([(1, 1e-17), (1, 0.5), (1, -0.25), (1, None)], "k int, d double")
    r = stats.signed_ranks(df, ["k"], "d").first()
    assert (r.n, r.w_plus, r.w_minus) == (2, 2.0, 1.0)


def test_grid_area(spark):
    flat = [("m", x, y, 0.8) for x in (0.0, 0.5, 1.0) for y in (-1.0, 0.0, 3.0)]
    line = [("l", x, y, 0.8 * (1 - x / 2)) for x in (0.0, 0.2, 1.0) for y in (-1.0, 0.0, 3.0)]
    got = {r.k: r.aurs for r in stats.grid_area(spark.createDataFrame(flat + line, "k string, x double, y double, v double"), ["k"], "x", "y", "v").collect()}
    assert got == pytest.approx({"m": 1.0, "l": 0.75})


def test_repetitions_are_averaged_within_runs(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("a", 1, 1.0), ("a", 2, 0.5), ("b", None, 0.3)], "m string, seed int, v double")
    got = {r.m: (r.n_runs, r["mean"], r.sd) for r in stats.family_summary(df, ["m", "seed"], ["m"], "v").collect()}
    assert got == {"a": (2, 0.5, 0.0), "b": (1, 0.3, None)}


def test_store_resumes_with_missing_seeds(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/run")
    marks = fingerprint(spark.range(5).toDF("a")) | {"python": "1"}
    assert store.open(marks, ["hash"]) == [] and store.open(marks | {"python": "2"}, ["hash"]) == ["python"]
    with pytest.raises(ValueError):
        store.open(marks | {"hash": "0"}, ["hash"])
    asked = []

    def train(seed):
        asked.append(seed)
        return [(0, "01", 0.5, float(seed), 1)]

    assert store.finish([1, 2], train).count() == 2
    assert store.finish([1, 2, 3], train).count() == 3 and asked == [1, 2, 3]


def test_fingerprint_ignores_order(spark):
    df = spark.range(100).toDF("a")
    assert fingerprint(df) == fingerprint(df.orderBy(F.desc("a")).repartition(7))
    assert same_rows(df, df.orderBy(F.desc("a"))) and not same_rows(df, df.union(df.limit(1)))
    assert compare_fingerprints({"a": 1}, {"a": 1}, ["a"]) == []


def test_monitor_streams_like_it_reads(spark, tmp_path):
    from steadfold.streaming.monitor import event_stream, run_to_table, window_sums

    from .conftest import SF

    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    streamed = run_to_table(event_stream(spark, SF), str(tmp_path / "out"), str(tmp_path / "ck1"))
    key = lambda r: (r.start, r.bin, r.n, r.positives)
    assert sorted(map(key, streamed.collect())) == sorted(map(key, window_sums(batch).collect()))


def test_sequential_split_and_impute(spark):
    df = spark.range(100).select((F.col("id") * 3 % 101).alias("t"), F.when(F.col("id") % 4 > 0, F.col("id") * 1.0).alias("x"))
    out = prep.sequential_split(df, ["t"], 0.7)
    assert out.where("train").count() == 70 and out.where("train").agg(F.max("t")).first()[0] < out.where("NOT train").agg(F.min("t")).first()[0]
    assert prep.impute_median(out, ["x"], F.col("train")).where("x IS NULL").isEmpty()


def test_suite_settings_are_checked():
    from steadfold.plans.suite import SuiteSettings

    with pytest.raises(ValueError):
        SuiteSettings(ess_levels=(0.6, 0.9))
    with pytest.raises(ValueError):
        SuiteSettings(repetitions=0)


def test_all_components_of_embeddings_count(spark):
    from steadfold.queries import QUERIES

    from .conftest import SF

    x = np.array([r[0] for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").select("embedding").collect()], float)
    want = np.corrcoef(x.T)
    rows = QUERIES["gram_corr_matrix_whole"](spark, SF).collect()
    assert len(rows) == 2016
    assert all(r["corr"] == pytest.approx(want[int(r["a"][1:]), int(r["b"][1:])], abs=2e-6) for r in rows)
    axes = QUERIES["reweight_axes"](spark, SF).collect()
    assert len(axes) > 0 and all(r["n"] == len(x) for r in axes)
    sizes = []
    real = reweight.principal_axes
    reweight.principal_axes = lambda df, names, train: sizes.append(len(names)) or real(df, names, train)
    try:
        QUERIES["reweight_axes"](spark, SF)
    finally:
        reweight.principal_axes = real
    assert sizes == [64]


def test_grids_have_a_noise_level_for_every_line_number(spark):
    from steadfold.queries import QUERIES

    from .conftest import SF

    numbers = {r[0] for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_linenumber").distinct().collect()}
    assert {r["noise"] for r in QUERIES["grid_slices_whole"](spark, SF).collect()} == {(n - 1) * 0.25 for n in numbers}
    assert len(numbers) > 5 and all(r["aurs"] is not None for r in QUERIES["grid_aurs_whole"](spark, SF).collect())
