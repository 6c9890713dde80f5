"""Places, fronts and vector scores on skewed and large inputs, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadfold.operators import copies, corrupt, metrics, model, pareto, places, reweight, scenarios, shifts, stats, vectors
from steadfold.plans import legacy
from steadfold.sources import store, tables


def brute_places(rows):
    key = lambda v: (v is not None, v if v is not None else 0)
    out = []
    for k, v, w, i in rows:
        mine = [(key(x), y) for a, x, y, _ in rows if a == k]
        out.append((k, v, w, i, sum(y for x, y in mine if x < key(v)), sum(y for x, y in mine if x == key(v)), sum(y for _, y in mine)))
    return sorted(out, key=str)


def test_places_where_one_value_has_most_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(["a", "b", None][int(rng.integers(3))] if i % 4 else "a", 7.0 if rng.random() < 0.9 else [None, -1.0, 0.0, 7.5, float(rng.integers(5))][int(rng.integers(5))], int(rng.integers(3)), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v double, w int, i int").repartition(6)
    out = places.placed(df, ["k"], "v", F.col("w"))
    got = sorted(((r.k, r.v, r.w, r.i, r._below, r._same, r._all) for r in out.collect()), key=str)
    assert got == brute_places(rows)
    whole = places.placed(df.select("v"), [], "v").collect()
    assert sum(r._same == max(x._same for x in whole) for r in whole) == sum(v == 7.0 for _, v, _, _ in rows) and {r._all for r in whole} == {400}


def test_no_task_ranks_all_rows_of_a_value(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 10 > 0, 1.0).otherwise(F.col("id") / 1.0).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small ranges are not put together
    out = places.placed(df, [], "v")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    ranges = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in out.inputFiles() if "/places-" in f}).groupBy("_b").count().collect()
    assert len(ranges) > 1 and max(r["count"] for r in ranges) < 30_000
    ranks = stats.average_rank(df, [], "v", "r")
    assert ranks.where("v = 1").select("r").distinct().count() == 1 and ranks.agg(F.sum("r")).first()[0] == pytest.approx(40_000 * 40_001 / 2)
    scored = reweight.ecdf(df, "v", F.lit(True))
    assert scored.where("v = 1").first().cdf == pytest.approx((1 + 36_000 / 2) / 40_000) and scored.count() == 40_000


def brute_front(points):
    return sorted(p for p in points if not any(a >= p[0] and b >= p[1] and (a > p[0] or b > p[1]) for a, b, *_ in points))


@pytest.mark.parametrize("kind", ["double", "decimal(20,10)"])
def test_fronts_against_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    points = [(round(float(a), 2), round(float(b), 2), i) for i, (a, b) in enumerate(rng.random((300, 2)))] + [(0.99, 0.5, 300), (0.99, 0.5, 301), (0.5, 0.99, 302)]
    rows = [("s" if i % 2 else None, a, b, i) for a, b, i in points]
    df = spark.createDataFrame([*rows, ("s", None, 0.5, 900), ("s", 2.0, None, 901)], "seed string, auc double, sign double, i int").repartition(5).withColumns({c: F.col(c).cast(kind) for c in ("auc", "sign")})
    got = sorted((r.seed or "", float(r.auc), float(r.sign), r.i) for r in pareto.pareto_front(df, ["seed"]).collect())
    want = [("s" if odd else "", *p) for odd in (0, 1) for p in brute_front([x for x in points if x[2] % 2 == odd])]
    assert got == sorted(want)
    assert pareto.pareto_front(df.where("false"), []).collect() == []


def test_a_front_of_many_points_in_one_key(spark):
    n = 300_000
    angle = F.col("id") / F.lit(2.0 * n) * 3.14159
    circle = spark.range(n).select(F.cos(angle).alias("auc"), F.sin(angle).alias("sign"), F.lit(True).alias("real"))
    inside = spark.range(n).select((F.cos(F.col("id") * 1.0) * 0.7).alias("auc"), (F.sin(F.col("id") * 1.0) * 0.7).alias("sign"), F.lit(False).alias("real"))
    front = pareto.pareto_front(circle.unionAll(inside), [])
    assert front.groupBy("real").count().collect() == [(True, n)]


def plain_scores(y, p, w):
    pos, neg = w[y == 1].sum(), w[y == 0].sum()
    area = sum(wi * (w[(y == 0) & (p < pi)].sum() + w[(y == 0) & (p == pi)].sum() / 2) for yi, pi, wi in zip(y, p, w) if yi == 1)
    average = sum(wi * w[(y == 1) & (p >= pi)].sum() / max(w[p >= pi].sum(), 1e-300) for yi, pi, wi in zip(y, p, w) if yi == 1)
    return area / (pos * neg), average / pos


def test_vector_scores_with_scores_that_many_rows_share(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(2)
    n = 600
    p, y, t = np.where(rng.random(n) < 0.5, 0.25, rng.integers(0, 40, n) / 40), rng.integers(0, 2, n), rng.normal(size=n)
    rows = [(i, m, int(y[i]), float(p[i] if m == "a" else 0.5 if i % 3 else p[i] / 2)) for m in "ab" for i in range(n)]
    preds = spark.createDataFrame(rows, "id int, model string, y int, p double").repartition(3)
    numbers = spark.createDataFrame([(i, [float(t[i])]) for i in range(n)], "id int, t array<double>")
    tilts = [scenarios.Tilt(k, 0, 0, one=s, one2=q) for k, (s, q) in enumerate([(0.5, 0.0), (-1.0, 0.1), (0.0, 0.0)])]
    got = {(r.scenario_id, r.model): r for r in scenarios.scenario_scores(preds, numbers, tilts, "id").collect()}
    assert len(got) == 6
    for (k, m), r in got.items():
        mine = np.array([x[3] for x in rows if x[1] == m])
        roc, pr = plain_scores(y, mine, np.exp(tilts[k].one * t + tilts[k].one2 * t * t))
        assert (r.roc_auc, r.pr_auc) == (pytest.approx(roc), pytest.approx(pr))
        assert r.delta_roc_auc == pytest.approx(roc - plain_scores(y, mine, np.ones(n))[0])
    plan = scenarios.scenario_scores(preds, numbers, tilts, "id")
    assert plan.count() == 6


def test_moments_are_weighted_sums_however_rows_are_dealt(spark):
    rng = np.random.default_rng(3)
    t = rng.normal(size=(500, 2)) * 30  # logs far beyond what exp holds
    y = rng.integers(0, 2, 500)
    rows = spark.createDataFrame([(i % 3 > 0, int(y[i]), [float(x) for x in t[i]]) for i in range(500)] + [(True, 1, [None, 1.0])], "train boolean, y int, t array<double>")
    tilt = scenarios.Tilt("x", 0, 1, 0.3, 4.0, -2.0, 0.1, 0.05)
    for parts in (1, 7):
        found = scenarios.moments(rows.repartition(parts), [tilt]).where("part").first()
        mine = np.array([i % 3 > 0 for i in range(500)])
        log = 0.3 * t[:, 0] * t[:, 1] + 4 * t[:, 0] - 2 * t[:, 1] + 0.1 * t[:, 0] ** 2 + 0.05 * t[:, 1] ** 2
        w = np.exp(log[mine] - log[mine].max())
        assert (found.n, found.peak) == (mine.sum(), pytest.approx(log[mine].max())) and found.w == pytest.approx(w.sum()) and found.ww1 == pytest.approx((w**2 * y[mine]).sum())
        assert found.s_ab == pytest.approx((w * t[mine, 0] * t[mine, 1]).sum())


def test_bootstrap_draws_have_a_mean_and_variance_of_one(spark):
    keys = np.array(spark.range(500).select(stats.row_key("id").alias("k")).toPandas()["k"].tolist())
    w = stats.draws(keys, 400)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.15 and (w == stats.draws(keys, 500)[:, :400]).all()


def test_any_number_of_files_is_found(spark):
    parts = {f"f{k:02d}": spark.range(k * 10, k * 10 + 3 + k % 4).toDF("a") for k in range(20)}
    parts |= {"copy of f03": parts["f03"], "f05 and f06": parts["f05"].unionAll(parts["f06"]), "none": spark.range(0).toDF("a"), "other": spark.range(3).toDF("b")}
    of = lambda names: [parts[n] for n in names]
    union = lambda dfs: __import__("functools").reduce(type(dfs[0]).unionAll, dfs)
    nine = [f"f{k:02d}" for k in range(0, 18, 2)]
    assert store.find_files(union(of(nine)), parts) == nine
    assert store.find_files(union(of(["f03", "f03", "f05", "f06"])), parts) == ["copy of f03", "f03", "f05 and f06"]
    assert store.find_files(union(of(["f01", "f01"])), parts) is None and store.find_files(spark.range(0).toDF("a"), parts) == []


def test_rows_of_files_keep_their_order(spark, tmp_path):
    paths = []
    for k in range(2):
        path = tmp_path / f"{k}.csv"
        path.write_text("x,y\n" + "".join(f"{k}-{i},{'z' * (i % 50)}\n" for i in range(3000)))
        paths.append(str(path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = tables.files_in_order(spark, paths[::-1], "x string, y string").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.part, r.row, r.x) for r in rows) == [(p, i, f"{1 - p}-{i}") for p in range(2) for i in range(3000)]


def test_packed_copies_score_as_rows_do(spark):
    """Ties across ranges, copies of one class, and tasks that pack many times; a score is exchanged in eight bytes."""
    rng = np.random.default_rng(8)
    rows = [(i % 7, int(rng.random() < 0.4) if i % 7 else 1, float(np.round(rng.normal(), 1)), float(rng.normal())) for i in range(3000)]
    df = spark.createDataFrame(rows, "cell int, y int, a double, b double").repartition(5)
    packages = {"one": [("a", 0.0, 1.0, 1.0), ("(intercept)", 0.0, 1.0, 0.2)], "two": [("a", 0.0, 1.0, 0.5), ("b", 0.0, 1.0, -0.7), ("(intercept)", 0.0, 1.0, 0.0)]}
    preds = model.score_models(df, packages, ["cell", "y"])
    want = {(r.cell, r.model): (r.roc_auc, r.pr_auc) for r in metrics.rank_metrics(preds, ["cell", "model"]).collect()}
    cuts = copies.score_cuts(preds, packages, 700)
    assert all(len(c) >= 3 for c in cuts.values())
    for edges in (cuts, dict.fromkeys(packages, [])):
        out = copies.copy_scores(df, packages, edges, held_rows=100)
        got = {(r.cell, r.model): (r.roc_auc, r.pr_auc) for r in out.collect()}
        assert got.keys() == want.keys() and all(got[k] == (pytest.approx(a) if a is not None else None, pytest.approx(b) if b is not None else None) for k, (a, b) in want.items())
        packed = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in out.inputFiles() if "/packed-" in f})
        assert packed.agg(F.sum(F.length("neg") + F.length("pos"))).first()[0] == 8 * 2 * 3000


def test_ranges_of_vector_scores_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(vectors, "RANGE", 500)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    df = spark.range(6000).select(F.lit("m").alias("model"), (F.col("id") * 0.37 % 1).alias("p"), (F.col("id") * 7 % 10 < 4).cast("int").alias("y"), F.array(F.lit(1.0)).alias("t"))
    out = vectors.vector_scores(df, lambda t: np.ones((len(t), 1)), 1)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    cut = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in out.inputFiles() if "/records-" in f})
    assert cut.groupBy("range").count().agg(F.max("count")).first()[0] < 1500
    got, want = out.first(), metrics.rank_metrics(df, ["model"]).first()
    assert (got.roc_auc, got.pr_auc) == (pytest.approx(want.roc_auc), pytest.approx(want.pr_auc))


def test_predictions_that_carry_their_numbers_are_not_joined(spark):
    df = spark.range(300).select("id", F.lit("m").alias("model"), (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") * 17 % 101 / 101).alias("p"), F.array((F.col("id") % 7 / 7.0)).alias("t"))
    tilts = [scenarios.Tilt(0, 0, 0, one=0.8)]
    joined = scenarios.scenario_scores(df.drop("t"), df.select("id", "t"), tilts, "id").first()
    plans = []
    plain = scenarios.vector_scores
    scenarios.vector_scores = lambda records, *a: plans.append(records) or plain(records, *a)
    try:
        alone = scenarios.scenario_scores(df, df.select("id", "t"), tilts, "id").first()
    finally:
        scenarios.vector_scores = plain
    assert tuple(alone) == pytest.approx(tuple(joined)) and "Join" not in plans[0]._jdf.queryExecution().executedPlan().toString()


def test_counted_values_are_ranked_once(spark):
    rows = [("a", 1.0), ("a", 1.0), ("a", 2.0), ("a", None), ("b", 3.0), ("b", 3.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    each = {(r.k, r.v): r.r for r in stats.average_rank(df, ["k"], "v", "r").collect()}
    counted = stats.average_rank(df.groupBy("k", "v").count(), ["k"], "v", "r", "count").collect()
    assert len(counted) == 4 and {(r.k, r.v): r.r for r in counted} == each


@pytest.mark.parametrize(("held", "cells", "continuous"), [(1 << 20, 1 << 16, False), (700, 8, False), (700, 8, True)])
def test_a_grid_of_noise_and_shifts_repeats_no_row(spark, monkeypatch, held, cells, continuous):
    monkeypatch.setattr(shifts, "RANGE", 300)
    monkeypatch.setattr(shifts, "CELLS", cells)
    monkeypatch.setattr(shifts.shifted_scores, "__defaults__", ("y", "z", held))
    rng = np.random.default_rng(5)
    z = rng.normal(size=900) if continuous else rng.integers(-3, 4, 900) / 1.5
    rows = [(f"r{i}", None if i % 50 == 7 else int(i % 3 == 0), float(rng.integers(0, 30)) / 3, float(i % 2), None if i % 40 == 3 else float(z[i])) for i in range(900)]
    df = spark.createDataFrame(rows, "id string, label int, a double, b double, z double").repartition(3)
    packages = {"numbers": [("a", 4.0, 3.0, 0.9), ("b", 0.5, 0.5, -0.37), ("(intercept)", 0.0, 1.0, 0.2)], "flag": [("b", 0.5, 0.5, 0.7)]}
    levels, steps = [0.0, 0.5, 1.0], [-0.6, 0.0, 0.6]
    out = legacy.stress_grid(df, "id", "label", packages, {"a": 2.0}, F.col("z"), levels, steps, seed=3)
    got = {(r.model, r.noise, r["shift"]): (r.roc_auc, r.pr_auc) for r in out.collect()}
    assert len(got) == 18
    for level in levels:
        kept = [r for r in corrupt.gaussian(df, "id", {"a": 2.0}, level, 0, 3).collect() if r.label is not None]
        # least() passes over nulls, here and in the SQL of grid_models: a row without a place on the axis counts as two
        y, t = np.array([r.label for r in kept]), np.clip([2.0 if r.z is None else r.z for r in kept], -2, 2)
        for name, package in packages.items():
            p = sum(c if f == "(intercept)" else c * (np.array([r[f] for r in kept]) - m) / s for f, m, s, c in package)
            for step in steps:
                w = np.exp(step * t)
                w = np.where(y == 1, w / w[y == 1].mean(), w / w[y == 0].mean())
                assert got[name, level, step] == pytest.approx(plain_scores(y, p, w)), (name, level, step)
    packed = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in out.inputFiles() if "/shifted-" in f})
    n = len(kept)
    sizes = packed.groupBy("copy", "range").agg(F.sum(F.length("scores") / 8).alias("n"), F.sum(F.length("shared")).alias("shared"), F.max("copy").alias("c"))
    assert sizes.where("copy % 2 = 0").agg(F.sum("n")).first()[0] <= n * len(levels) and sizes.agg(F.max("n")).first()[0] < 500
    assert packed.where("copy % 2 = 1").agg(F.sum(F.length("scores") / 8)).first()[0] < n * len(levels)  # shared scores are summed
