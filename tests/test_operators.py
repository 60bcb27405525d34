"""Edge cases of the core operators, and their kernels against plain NumPy."""

from __future__ import annotations

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tidemark.functions.keys import clip_id, natural_key, session_clip
from tidemark.functions.numbers import fisher
from tidemark.operators import align, lasso, lookup, metrics, pooling, regression, report, rows, splits, windows
from tidemark.plans import encoding
from tidemark.sources import files, storage
from tidemark.streaming import arrivals
from tidemark.streaming.responses import binned


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_windows(spark):
    d = spark.createDataFrame([(1, 14.9), (2, 0.0), (3, None), (4, 1.0)], "id int, seconds double")
    w = values(windows.chunk_windows(d, "seconds").orderBy("id", "tr_index"), "id", "tr_index", "chunk_start", "chunk_end")
    assert [x[:2] for x in w] == [(1, k) for k in range(10)] + [(4, 0)]
    assert w[5][2] == pytest.approx(1.45) and w[5][3] == pytest.approx(9.45) and w[-1][2:] == (0.0, 1.0)
    for seconds in (1.49 * k for k in range(1, 60)):
        n, t = 0, 0.0
        while t < seconds:
            n, t = n + 1, t + 1.49
        got = windows.chunk_windows(spark.createDataFrame([(seconds,)], "s double"), "s", exact_steps=True).count() if n % 20 == 7 else n
        assert got == n
    with pytest.raises(ValueError):
        windows.chunk_windows(d, "seconds", lead=7.0)


def test_sample(spark):
    sizes = [(n,) for n in (0, 1, 5, 8, 9, 50, 399)]
    got = windows.uniform_sample(spark.createDataFrame(sizes, "n long"), "n", 0.2).groupBy("n").agg(F.array_sort(F.collect_list("tr_index")).alias("x"))
    for n, x in values(got, "n", "x"):
        k = min(n, max(8, round(n * 0.2)))
        assert x == list(np.unique(np.round(np.linspace(0, n - 1, k)).astype(int)))
    one = windows.uniform_sample(spark.createDataFrame([(9,)], "n long"), "n", 0.01, least=1)
    assert values(one, "tr_index") == [(0,)]


def test_frames(spark):
    d = spark.range(1).select(windows.frame_indices(F.lit(10), 4).alias("a"), windows.frame_indices(F.lit(3), 4).alias("b"), windows.frame_indices(F.lit(0), 4).alias("c"))
    assert tuple(d.first()) == ([0, 3, 6, 9], [0, 1, 2], [])


def test_keys(spark):
    names = ["b10.mkv", "b9.mkv", "B2.mkv", "a1"]
    d = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in d.orderBy(natural_key(F.col("n"))).collect()] == ["a1", "B2.mkv", "b9.mkv", "b10.mkv"]
    k = spark.createDataFrame([("ses-1_task-S01E02a",), ("nothing",), (None,)], "k string")
    assert values(k.select(clip_id(F.col("k")).alias("c"), session_clip(F.col("k")).alias("s")), "c", "s") == [("s01e02a", "friends_S01E02a"), (None, None), (None, None)]


def test_align(spark):
    x = spark.createDataFrame([("a", t, float(t)) for t in range(6)] + [("b", 0, 1.0)], "clip string, tr long, x double")
    y = spark.createDataFrame([("a", t, 10.0 * t) for t in range(6)] + [("b", 3, 1.0)], "clip string, tr long, y double")
    got = sorted(values(align.lag_align(x, y), "clip", "tr", "y"))
    assert got == [("a", 0, 30.0), ("a", 1, 40.0), ("a", 2, 50.0)]  # b has one pair only
    assert values(align.missing(x.select("clip").distinct(), spark.createDataFrame([("a",)], "clip string"), "clip"), "clip") == [("b",)]
    f = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "clip string, file int")
    assert values(align.matched_once(x.select("clip").distinct(), f, "clip"), "clip", "file") == [("b", 3)]
    s = spark.createDataFrame([("u", "a"), ("v", "a"), ("u", "b"), ("u", "b")], "subject string, clip string")
    assert values(align.shared_keys(s, "clip", "subject"), "clip") == [("a",)]


def test_contained(spark):
    """Against plain search, with short, empty, repeated, null and hot needles."""
    import random

    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("abcé", k=n))
    texts = [(k, word(rng.randint(0, 12))) for k in range(200)] + [(300, None), (301, ""), (302, "xx special one"), (303, "a%b_c.d")]
    needles = [(k, word(rng.randint(1, 6))) for k in range(60)] + [(70, None), (71, ""), (72, "special"), (73, "special"), (74, "%b"), (75, "._"), (76, "not there"), (77, "a"), (78, "xx")]
    n, t = spark.createDataFrame(needles, "k int, needle string").repartition(2), spark.createDataFrame(texts, "t int, text string").repartition(3)
    want = {(k, x, i) for k, x in needles for i, y in texts if x is not None and y is not None and x in y}
    for q in (1, 3, 5):
        got = values(align.contained(n, t, "needle", "text", q), "k", "needle", "t")
        assert len(got) == len(want) and set(got) == want
    once = {(k, x, i) for k, x, i in want if sum(k == j for j, _, _ in want) == 1}
    assert set(values(align.contained_once(n, t, "needle", "text"), "k", "needle", "t")) == once
    assert (72, "special", 302) in once and (73, "special", 302) in once
    plan = align.contained(n, t, "needle", "text")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    for a, b in ((n.where("false"), t), (n, t.where("false")), (n.where("needle is null"), t)):
        assert align.contained(a, b, "needle", "text").count() == 0 == align.contained_once(a, b, "needle", "text").count()


def test_contained_once_broadcasts_no_runs(spark, tmp_path):
    """Files are far smaller than the runs of their texts, which may not go by the driver."""
    spark.range(3000).selectExpr("id t", "concat('Text#', lpad(id, 9, '0')) text").write.parquet(str(tmp_path / "t"))
    spark.range(300).selectExpr("id k", "CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN lpad(id, 9, '0') ELSE '07' END needle").write.parquet(str(tmp_path / "n"))
    n, t = spark.read.parquet(str(tmp_path / "n")), spark.read.parquet(str(tmp_path / "t"))
    d = align.contained_once(n, t, "needle", "text")
    assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()
    assert sorted(values(d, "k", "t")) == [(k, k) for k in range(1, 300, 3)]


def test_contained_deals_out_hot_needles(spark, monkeypatch):
    """What one recurring needle stands for isn't made by one task, and no pair twice."""
    monkeypatch.setattr(align, "CELL", 64, raising=False)
    n = spark.range(1000).selectExpr("'ab' needle").repartition(2)
    t = spark.range(1000).selectExpr("IF(id % 2 = 0, 'xaby', 'none') text").repartition(2)
    d = align.contained(n.withColumn("k", F.lit(1)), t, "needle", "text").groupBy(F.spark_partition_id()).count()
    parts = [r["count"] for r in d.collect()]
    assert sum(parts) == 500_000 and max(parts) < 100_000
    d = align.contained(n.limit(3), t.limit(2).union(t.where("text = 'xaby'").limit(5)), "needle", "text")
    assert d.where("text = 'xaby'").count() % 3 == 0


def test_contained_copies_grow_as_the_input(spark, monkeypatch):
    """Of twice the needles and texts, four times the pairs are made from twice the shuffled rows."""
    monkeypatch.setattr(align, "CELL", 64)
    sc = spark.sparkContext
    sides = lambda size: (spark.range(size).selectExpr("id k", "'' needle"), spark.range(size).selectExpr("id t", "concat('text', id) text"))

    def shuffled(size):
        sc.setJobGroup(f"pairs of {size}", "")
        assert align.contained(*sides(size), "needle", "text").count() == size * size
        tracker, rows = sc.statusTracker(), 0
        for job in tracker.getJobIdsForGroup(f"pairs of {size}"):
            for stage in tracker.getJobInfo(job).stageIds:
                if tracker.getStageInfo(stage).numCompletedTasks:
                    rows += sc._jsc.sc().statusStore().lastStageAttempt(stage).shuffleWriteRecords()
        sc.setLocalProperty("spark.jobGroup.id", None)
        return rows

    assert shuffled(4000) < 2.5 * shuffled(2000)
    monkeypatch.setattr(align, "HELD", 16, raising=False)
    d = align.contained(*sides(300), "needle", "text").select("k", "t")
    assert d.count() == 90_000 == d.distinct().count()


def test_splits(spark):
    d = spark.createDataFrame([(k,) for k in range(10)], "clip long")
    assert [r.train for r in splits.clip_split(d).orderBy("clip").collect()] == [True] * 8 + [False] * 2
    with pytest.raises(Exception, match="too few clips"):
        splits.clip_split(d.where("clip < 4")).collect()
    sizes = splits.folds(d, 3, "clip").groupBy("fold").count().orderBy("fold")
    assert values(sizes, "fold", "count") == [(0, 4), (1, 3), (2, 3)]
    assert sorted(values(rows.with_index(d.where("clip % 2 = 1"), "clip"), "clip", "index")) == [(1, 0), (3, 1), (5, 2), (7, 3), (9, 4)]
    assert splits.folds(d.where("clip < 0"), 3, "clip").count() == 0


def test_metrics(spark):
    rng = np.random.default_rng(0)
    y, p = rng.normal(size=50), rng.normal(size=50)
    d = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(y, p)] + [(2, 1.0, float(b)) for b in p], "g int, y double, p double")
    got = {r.g: r for r in metrics.scores(d, "g").collect()}
    assert got[1].r == pytest.approx(np.corrcoef(y, p)[0, 1]) and got[1].r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert got[2].r is None and got[2].r2 == 0.0
    assert {r.g: r.r for r in metrics.scores(d, "g", zero_fill=True).collect()}[2] == 0.0
    assert metrics.scores(d.where("g = 3"), "g").count() == 0


def test_noise_ceiling(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=(3, 2, 20, 2))  # subject, clip, step, parcel
    y[2, 0, :, 0] = y[1, 0, :, 0]  # perfect: held below 1
    d = spark.createDataFrame([(s, c, t, p, float(y[s, c, t, p])) for s in range(3) for c in range(2) for t in range(20 - s) for p in range(2)], "subject int, clip int, tr int, parcel int, y double")
    z = np.zeros((2, 2))
    for c in range(2):
        for p in range(2):
            r = [np.corrcoef(y[a, c, : 20 - b, p], y[b, c, : 20 - b, p])[0, 1] for a in range(3) for b in range(a + 1, 3)]
            z[c, p] = np.tanh(np.mean(np.arctanh(np.clip(r, -0.9999, 0.9999))))
    got = metrics.noise_ceiling(d).first()
    assert got.noise_ceiling == pytest.approx(z.mean(0).mean()) and got.n == 2
    assert spark.range(1).select(fisher(F.lit(None).cast("double")).alias("z")).first().z is None


def test_standardised(spark):
    d = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0), (1, 5.0)], "f int, v double")
    assert sorted(values(metrics.standardised(d, d, "v", "f"), "f", "z")) == [(0, -1.0), (0, 1.0), (1, 0.0), (1, 0.0)]


def test_pooling(spark):
    assert pooling.bins(16, 3, False) == [(0, 5), (5, 10), (10, 16)] and pooling.bins(16, 3, True) == [(0, 6), (5, 11), (10, 16)]
    assert pooling.grid_of(3136) == (16, 14) and pooling.grid_of(8 * 49) == (8, 7)
    t = np.arange(2 * 9 * 2, dtype=float).reshape(18, 2)
    d = spark.createDataFrame([(t.tolist(),)], "t array<array<double>>")
    got = d.select(pooling.mean_tokens(F.col("t"), 2).alias("m"), pooling.cropped(F.col("t"), F.lit(1), F.lit(2), 9).alias("c")).first()
    assert np.allclose(got.m, t.mean(0)) and np.allclose(got.c, t[9:])
    assert np.allclose(pooling.pooled(d, "t", per_step=9).first().pooled, t.reshape(2, 9, 2).mean(0).ravel())
    assert np.allclose(pooling.pooled(d, "t", out=None).first().pooled, t.mean(0))
    assert pooling.without_class_token(F.col("t"), 18)[1] == 18 and pooling.without_class_token(F.col("t"), 17)[1] == 16


def test_lookup(spark):
    voxels = spark.createDataFrame([(1, 0), (2, 1), (3, 9)], "voxel int, label int")
    parcels = spark.createDataFrame([(1, 0.5)], "parcel int, r double")
    assert sorted(values(lookup.at_voxels(voxels, parcels), "voxel", "r")) == [(1, 0.0), (2, 0.5), (3, 0.0)]
    vertices = spark.createDataFrame([("L", 1, 0.9), ("R", 2, 1.0)], "hemi string, vertex int, label double")
    assert sorted(values(lookup.at_vertices(vertices, parcels), "vertex", "r")) == [(1, 0.5), (2, 0.0)]


def test_report(spark):
    d = spark.createDataFrame([(k, float(k % 7)) for k in range(50)] + [(99, None)], "parcel int, r double")
    top = values(report.top_parcels(d, 3), "parcel")
    assert top == [(6,), (13,), (20,)]
    h = report.histogram(d, "r", 6)
    assert h.agg(F.sum("n")).first()[0] == 50 and h.agg(F.max("bin")).first()[0] == 5
    assert values(report.histogram(d.where("r = 3"), "r"), "bin", "n") == [(0, 7)]
    assert report.histogram(d.where("parcel < 0"), "r").count() == 0


def fixed(seed, n, d, p):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    return x, x @ rng.normal(size=(d, p)) + rng.normal(size=(n, p))


def test_ridge_kernels():
    x, y = fixed(0, 30, 7, 3)
    n, sums = float(len(x)), (x.sum(0), y.sum(0), (x.T @ x).ravel(), (x.T @ y).ravel())
    w, b = regression.solve_primal(n, *sums, 5.0)
    a, c = x - x.mean(0), y - y.mean(0)
    assert np.allclose(a.T @ (c - a @ w), 5.0 * w)  # normal equations
    v, e = regression.solve_dual(x, y, 5.0)
    assert np.allclose(w, v) and np.allclose(b, e)
    parts, loo = regression.decomposed(n, *sums), []
    for k in range(0, 30, 10):  # in any parts of the rows
        loo.append(regression.left_out_errors(x[k : k + 10], y[k : k + 10], n, parts, regression.ALPHAS))
    s = x.std(0)
    for alpha, got in zip(regression.ALPHAS, np.sum(loo, axis=0), strict=True):
        error = 0.0
        for i in range(len(x)):
            k = np.arange(len(x)) != i
            # The scale is that of all rows; the constant is fitted anew.
            wi, bi = regression.solve_dual(x[k] / s, y[k], alpha)
            error += ((y[i] - x[i] / s @ wi - bi) ** 2).sum()
        assert np.isclose(got, error)
    mean, std, corr, prod = lasso.standardised(n, *sums)
    assert np.allclose(mean, x.mean(0)) and np.allclose(std, s)
    wl, off = lasso.lasso_block(corr, prod.copy(), 0.1)
    assert off < 1e-9 and lasso.lasso_block(corr, prod.copy(), 1e-4, rounds=1)[1] > 1e-9
    wl = wl / s[:, None]
    g = (a / s).T @ (c - a @ wl) / n  # subgradient
    assert np.all(np.abs(g) <= 0.1 + 1e-6) and np.allclose(g[np.abs(wl) > 1e-9], 0.1 * np.sign(wl)[np.abs(wl) > 1e-9], atol=1e-6)


def test_ridge_on_tables(spark):
    x, y = fixed(1, 60, 5, 2)
    d = spark.createDataFrame([(i % 2, i, x[i].tolist(), y[i].tolist()) for i in range(60)], "clip int, tr int, x array<double>, y array<double>")
    for form in (None, "rows", "sums"):
        fits = {r.clip: r for r in regression.ridge_fit(d, "clip", alpha=2.0, form=form).collect()}
        for k in (0, 1):
            w, b = regression.solve_dual(x[k::2], y[k::2], 2.0)
            assert np.allclose(fits[k].w, w.ravel()) and np.allclose(fits[k].b, b)
    w, b = regression.solve_dual(x[1::2], y[1::2], 2.0)
    odd = d.where("tr < 50").union(d.sparkSession.createDataFrame([(1, 99, None, [0.0]), (7, 98, [0.0] * 5, [0.0])], d.schema))
    for most in (10**6, 1):  # fits read whole, row by row
        got = regression.predict(odd, regression.ridge_fit(d, "clip", alpha=2.0), "clip", most=most).collect()
        p = {r.tr: r.p for r in got}
        assert np.allclose(p[3], x[3] @ w + b) and len(got) == 51 and 98 not in p
        assert not p[99] or p[99] == [None, None]


def test_folds_on_tables(spark):
    x, y = fixed(2, 40, 4, 2)
    d = spark.createDataFrame([(0, i, x[i].tolist(), y[i].tolist()) for i in range(40)], "clip int, tr int, x array<double>, y array<double>")
    got = encoding.cross_validated(d, 3.0, "ridge", 4).first()
    p = np.zeros_like(y)
    for f in range(4):
        test = np.arange(40) // 10 == f
        s = x[~test].std(0)
        w, b = regression.solve_dual(x[~test] / s, y[~test], 3.0)
        p[test] = x[test] / s @ w + b
    r = [np.corrcoef(p[:, k], y[:, k])[0, 1] for k in range(2)]
    assert got.mean_r == pytest.approx(np.mean(r)) and got.max_r == pytest.approx(max(r))
    # A parcel that doesn't vary counts as 0.
    flat = d.withColumn("y", F.concat("y", F.array(F.lit(1.0))))
    got = encoding.cross_validated(flat, 3.0, "ridge", 4).first()
    assert got.mean_r == pytest.approx(sum(r) / 3)


def test_groups_with_few_rows_are_solved_from_them(spark):
    x, y = fixed(3, 60, 9, 2)
    d = spark.createDataFrame([("few" if i < 6 else "many", i, x[i].tolist(), y[i].tolist()) for i in range(60)] + [(None, 60 + i, x[i].tolist(), y[i].tolist()) for i in range(6)], "clip string, tr int, x array<double>, y array<double>")
    fits = {r.clip: r for r in regression.ridge_fit(d, "clip", alpha=2.0).collect()}
    for k, s in (("few", slice(0, 6)), ("many", slice(6, 60))):
        w, b = regression.solve_dual(x[s], y[s], 2.0)
        assert np.allclose(fits[k].w, w.ravel()) and np.allclose(fits[k].b, b)
    p = {r.tr: r.p for r in regression.predict(d, regression.ridge_fit(d, "clip", alpha=2.0), "clip").collect()}
    w, b = regression.solve_dual(x[6:60], y[6:60], 2.0)
    assert np.allclose(p[30], x[30] @ w + b)


def test_leave_one_out_of_many_rows(spark):
    """More rows than one task takes at a time, and wide sums in several tiles."""
    n = 21_000
    d = spark.range(n).select((F.col("id") % 1).alias("clip"), F.array(*[F.sin(F.col("id") * (k + 1) * 0.7) for k in range(100)]).alias("x"), F.array(F.cos(F.col("id") * 0.3) + F.sin(F.col("id") * 0.7), F.rand(1)).alias("y"))
    assert 100 * 100 > regression.TILE
    rows = d.collect()
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    fit = regression.loo_fit(spark.createDataFrame(rows, d.schema).repartition(5), "clip").first()
    z = (x - x.mean(0)) / x.std(0)
    c, gram, errors = y - y.mean(0), None, []
    gram = z.T @ z
    for alpha in regression.ALPHAS:
        inverse = np.linalg.inv(gram + alpha * np.eye(100))
        h = 1 / n + np.einsum("ij,jk,ik->i", z, inverse, z)
        errors.append((((c - z @ (inverse @ (z.T @ c))) / (1 - h)[:, None]) ** 2).mean())
    assert fit.alpha == regression.ALPHAS[int(np.argmin(errors))] and fit.mse == pytest.approx(min(errors))
    w = np.linalg.inv(gram + fit.alpha * np.eye(100)) @ z.T @ c
    assert np.allclose(np.array(fit.w).reshape(100, 2), w / x.std(0)[:, None], atol=1e-8)


def slow_lasso(c, g, alpha, rounds=20_000):
    """Plain coordinate descent over all features, one target after another."""
    w = np.zeros_like(g)
    for t in range(g.shape[1]):
        for _ in range(rounds):
            before = w[:, t].copy()
            for j in range(len(c)):
                if c[j, j] > 1e-12:
                    rho = g[j, t] - c[j] @ w[:, t] + c[j, j] * w[j, t]
                    w[j, t] = np.sign(rho) * max(abs(rho) - alpha, 0) / c[j, j]
            if np.abs(w[:, t] - before).max() < 1e-12:
                break
    return w


@pytest.mark.parametrize("rows, d", [(200, 12), (15, 40)])
def test_lasso_fits_by_blocks_of_targets(spark, rows, d):
    rng = np.random.default_rng(rows)
    x = rng.standard_normal((rows, d)) @ rng.standard_normal((d, d)) * 0.3
    x[:, 1] = 4.0  # doesn't vary
    y = x[:, :3] @ rng.standard_normal((3, 5)) + rng.standard_normal((rows, 5))
    data = [(k % 3, k, x[k].tolist(), y[k].tolist()) for k in range(rows)]
    frame = spark.createDataFrame(data, "fold int, k int, x array<double>, y array<double>").repartition(3)
    sums = regression.gram(frame, "fold")
    got = {r.fold: r for r in lasso.lasso_fits(sums, "fold", 0.2, targets=2).collect()}
    assert set(got) == {0, 1, 2}
    for f, r in got.items():
        own = np.arange(rows) % 3 == f
        a, b = x[own], y[own]
        mean, std, c, g = lasso.standardised(len(a), a.sum(0), b.sum(0), (a.T @ a).ravel(), (a.T @ b).ravel())
        w = slow_lasso(c, g, 0.2) / std[:, None]
        assert r.converged and r.breach < 1e-6
        # Of fits that aren't unique, predictions are.
        assert np.allclose(a @ np.reshape(r.w, (d, 5)) + r.b, a @ w + b.mean(0) - mean @ w, atol=1e-5)
        if rows > 100:
            assert np.allclose(np.reshape(r.w, (d, 5)), w, atol=1e-6) and np.allclose(r.b, b.mean(0) - mean @ w, atol=1e-6)


def test_ranks_with_null_groups(spark):
    d = spark.createDataFrame([("a", 3), ("a", 1), (None, 5), (None, 4), (None, 200_000), ("b", 9)], "g string, k long")
    want = {("a", 1): 0, ("a", 3): 1, (None, 4): 0, (None, 5): 1, (None, 200_000): 2, ("b", 9): 0}
    for got in (rows.with_rank(d, ("g",), "k"), rows.with_rank_by_id(d, ("g",), "k"), rows.with_rank_by_id(d, ("g",), "k", block=2)):
        assert {(r.g, r.k): r["rank"] for r in got.collect()} == want
    many = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 - 9000).alias("k"))
    got = {(r.g, r.k): r["rank"] for r in rows.with_rank_by_id(many, ("g",), "k", block=100).collect()}
    assert all(got[i % 3, i * 7 - 9000] == i // 3 for i in range(5000))


def test_long_numbers_in_names(spark):
    names = ["a" + "9" * 21, "a" + "1" * 21, "a" + "1" * 20 + "2", "a" + "9" * 20, "a10", "a007", "a8", "A9b", "a9"]
    d = spark.createDataFrame([(n,) for n in names], "n string")
    want = sorted(names, key=lambda n: (int("".join(c for c in n if c.isdigit())), "b" in n))
    assert [r.n for r in d.orderBy(natural_key(F.col("n"))).collect()] == want


def test_least_values(spark):
    d = spark.createDataFrame([("a", k % 40) for k in range(400)] + [(None, 1), (None, None), ("b", None)], "g string, k int").repartition(3)
    got = {r.g: r.first for r in report.least_values(d, "k", "first", "g").collect()}
    assert got == {"a": list(range(10)), None: [1]}
    plan = report.least_values(d, "k", "first", "g")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "collect_set" not in plan


def test_percentile_of_one_common_value(spark):
    values = [5.0] * 9000 + [float(k) for k in range(1000)] + [-7.5] * 20 + [0.0] * 100
    d = spark.createDataFrame([(v,) for v in values], "v double")
    for share in (0.95, 0.5, 0.0, 1.0, 0.9137):
        assert report.upper_nonzero(d, "v", share).first()[0] == pytest.approx(np.percentile(np.abs([v for v in values if v]), 100 * share))


def test_scores_in_one_pass(spark):
    d = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 3.0), ("a", 4.0, None), ("c", 2.0, 2.0), ("c", 2.0, 2.0), ("d", 2.0, 1.0), ("d", 2.0, 2.0)], "g string, y double, p double")
    got = {r.g: (r.r2, r.n) for r in metrics.scores(d, "g").collect()}
    assert got["a"] == (pytest.approx(0.5), 3) and got["c"] == (1.0, 2) and got["d"] == (0.0, 2)
    assert metrics.scores(d, "g")._jdf.queryExecution().executedPlan().toString().count("Join") == 0


def test_ranks_within_groups(spark):
    d = spark.createDataFrame([(k % 3 if k % 7 else None, k) for k in range(200)], "g int, k int").repartition(9)
    for g in (0, 1, 2):
        got = sorted(values(rows.with_rank(d.where("g is not null"), ("g",), "k").where(f"g = {g}"), "k", "rank"))
        assert [r for _, r in got] == list(range(len(got)))


def test_crop_and_pool(spark):
    rng = np.random.default_rng(4)
    video, image = rng.normal(size=(4, 5, 5, 2)), rng.normal(size=(6, 10, 2))
    d = spark.createDataFrame([(video.reshape(-1, 2).tolist(), image.reshape(-1, 2).tolist(), 2.1, 5.0)], "v array<array<double>>, i array<array<double>>, a double, b double")
    crop = lambda c, steps, per_step: pooling.crop_pooled(d, c, "a", rel_start=F.col("a"), rel_end=F.col("b"), length=8.0, steps=steps, per_step=per_step).first().pooled

    def plain(grid, steps):
        a, b = round(2.1 / 8 * steps), round(5.0 / 8 * steps)
        ends = pooling.bins(grid.shape[1], 3, True)
        return np.array([[grid[a:b, t:u, x:z].mean((0, 1, 2)) for x, z in ends] for t, u in ends]).ravel()

    assert np.allclose(crop("v", 4, 25), plain(video, 4)) and np.allclose(crop("i", 6, 10), plain(image[:, 1:].reshape(6, 3, 3, 2), 6))
    with pytest.raises(ValueError):
        crop("v", 4, 7)


def test_pooling_of_real_size(spark):
    """A row of 3,136 tokens of 64 numbers, as 16 steps of 14 × 14, and odd rows."""
    import time

    rng = np.random.default_rng(6)
    t = rng.normal(size=(3136, 64)).astype(np.float32)
    d = spark.createDataFrame([(1, t.tolist(), 3, 9), (2, None, 0, 1), (3, [], 0, 1), (4, t[:196].tolist(), 0, 99), (5, t[:392].tolist(), 2, 2)], "id int, t array<array<float>>, a int, b int")
    got = {r.id: r.pooled for r in pooling.pooled(d, "t", "id", per_step=196, first="a", last="b", overlapping=True).collect()}
    grid = t.reshape(16, 14, 14, 64).astype(float)
    plain = lambda g: np.array([[g[:, a:b, x:y].mean((0, 1, 2)) for x, y in pooling.bins(14, 3, True)] for a, b in pooling.bins(14, 3, True)]).ravel()
    assert np.allclose(got[1], plain(grid[3:9])) and np.allclose(got[4], plain(grid[:1])) and got[2] is got[3] is got[5] is None
    start = time.process_time()
    for _ in range(10):
        pooling.bin_means(grid, 3, 9, pooling.bins(14, 3, True))
    assert time.process_time() - start < 5
    assert np.allclose(pooling.pooled(d.where("id = 1"), "t", "id").first().pooled, np.array([[grid[:, a:b, x:y].mean((0, 1, 2)) for x, y in pooling.bins(14, 3, False)] for a, b in pooling.bins(14, 3, False)]).ravel())


def test_percentile(spark):
    for n in (1, 2, 7, 40):
        v = np.random.default_rng(n).normal(size=n)
        d = spark.createDataFrame([(float(k),) for k in v] + [(0.0,), (None,)], "v double").repartition(3)
        assert report.upper_nonzero(d, "v").first().limit == pytest.approx(np.percentile(np.abs(v), 95))
    assert report.upper_nonzero(d.where("v = 0"), "v").first().limit is None


def test_settings_and_recordings(spark, tmp_path):
    (tmp_path / "run.json").write_text('{"lag_trs": 2, "subjects": ["a"], "tr": 2}')
    found = files.settings(spark, f"{tmp_path}/run.json", force=True)
    assert found["lag_trs"] == 2 and found["tr"] == 2.0 and found["force"] is True and found["train_fraction"] == 0.8
    for bad in ({"lag": 1}, {"lag_trs": "2"}, {"force": 1}):
        with pytest.raises(ValueError):
            files.settings(spark, None, **bad)
    (tmp_path / "movies").mkdir()
    for n in ("a.mkv", "b.mkv", "c.mkv"):
        (tmp_path / "movies" / n).write_bytes(b"1")
    found = files.recordings(spark, str(tmp_path / "movies"))
    assert values(files.allowed(found, spark.createDataFrame([("b.mkv",), ("b.mkv",)], "name string")), "name") == [("b.mkv",)]
    with pytest.raises(FileNotFoundError, match="z.mkv"):
        files.allowed(found, spark.createDataFrame([("b.mkv",), ("z.mkv",)], "name string"))
    assert values(files.shuffled(found), "name") == values(files.shuffled(found.repartition(3)), "name")
    assert files.vector("x", "bfloat16") is not None
    with pytest.raises(ValueError):
        files.vector("x", "int8")
    out = f"{tmp_path}/out"
    assert files.finished(spark, out).count() == 0
    f = spark.createDataFrame([("s01e01a", "k", t, [0.5, float(t)]) for t in range(3)], "clip string, feature_key string, tr long, x array<double>")
    m = spark.createDataFrame([("s01e01a", "k", 25.0, [{"tr_index": 0}])], "clip string, feature_key string, fps double, rows array<map<string,int>>")
    files.write_recording(f, m, out)
    files.write_recording(f.withColumn("clip", F.lit("s01e02b")), m.withColumn("clip", F.lit("s01e02b")), out)
    work = spark.createDataFrame([("s01e01a", "k"), ("s01e02b", "k"), ("s01e03a", "k")], "clip string, feature_key string")
    assert values(files.unfinished(work, files.finished(spark, out), "clip", "feature_key"), "clip") == [("s01e03a",)]
    assert spark.read.parquet(f"{out}/features").count() == 6 and spark.read.json(f"{out}/manifest").count() == 2


def test_arrivals_go_on_after_an_interruption(spark, tmp_path, monkeypatch):
    """Runs that end between any two writes, arrivals in between, equal and other settings."""
    schema, out, made = "clip string, feature_key string, n int", f"{tmp_path}/out", []

    def arrive(name, *clips):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.json").write_text("".join(json.dumps({"clip": c, "feature_key": "k", "n": 2}) + "\n" for c in clips))

    def make(rows):
        made.extend(sorted(r.clip for r in rows.collect()))
        steps = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
        return rows.select("clip", "feature_key", steps.alias("tr"), F.array(F.lit(1.0)).alias("x")), rows.select("clip", "feature_key", "n")

    def run(**own):
        made.clear()
        found = files.settings(spark, None, **own)
        arrivals.make_arriving(spark.readStream.schema(schema).json(f"{tmp_path}/in"), make, out, found).awaitTermination()
        assert spark.read.parquet(f"{out}/features").groupBy("clip", "tr").count().where("count > 1").count() == 0
        return files.digest(found)

    def done(key=None):
        return sorted(r.clip for r in files.finished(spark, out, key).collect())

    arrive("a", "one", "two", "two")
    for at in ("features", "manifest", "done"):  # what is written when the run ends

        def broken(self, path, *a, at=at, f=DataFrameWriter.parquet, **b):
            if path.endswith(at):
                raise OSError(at)
            return f(self, path, *a, **b)

        with monkeypatch.context() as m:
            m.setattr(DataFrameWriter, "parquet", broken)
            m.setattr(DataFrameWriter, "json", lambda self, path, *a, f=DataFrameWriter.json, at=at, **b: broken(self, path, *a, at=at, f=f, **b))
            with pytest.raises(Exception, match=at):
                run()
        assert done() == []
    first = run()
    assert made == ["one", "two"] and done(first) == ["one", "two"]
    arrive("b", "two", "three")
    assert run() == first and made == ["three"] and done(first) == ["one", "three", "two"]
    assert run() == first and made == []
    other = run(sample_fraction=0.5)
    assert other != first and made == ["one", "three", "two"] and done(other) == made and done(first) == []
    assert run(sample_fraction=0.5, lag_trs=1) == other and made == []  # features don't depend on a lag
    assert run(sample_fraction=0.5, force=True) == other and made == ["one", "three", "two"]
    assert {r.made_by for r in spark.read.json(f"{out}/manifest").collect()} == {other}
    assert spark.read.parquet(f"{out}/features").count() == 6


def test_subject_analysis(spark, tmp_path):
    """Against plain NumPy, with clips that one side lacks; written, and one subject again."""
    rng = np.random.default_rng(8)
    x = {c: rng.normal(size=(12 + c, 3)) for c in range(7)}
    y = {(s, c): np.vstack([np.zeros((3, 2)), x[c] @ rng.normal(size=(3, 2)) * 0.2 + rng.normal(size=(12 + c, 2))]) if c < 6 else rng.normal(size=(9, 2)) for s in "ab" for c in (*range(6 if s == "a" else 5), 9) if c != 9}
    y["a", 9] = rng.normal(size=(5, 2))
    features = spark.createDataFrame([(c, t, v.tolist()) for c in x for t, v in enumerate(x[c])], "clip long, tr long, x array<double>")
    responses = spark.createDataFrame([(s, c, t, v.tolist()) for (s, c), m in y.items() for t, v in enumerate(m)], "subject string, clip long, tr long, y array<double>")
    predictions, reports = encoding.subject_analysis(features, responses)
    got = {r.subject: r for r in reports.collect()}
    for s, n in (("a", 6), ("b", 5)):
        train = max(4, min(int(n * 0.8), n - 1))
        z, t = np.vstack([x[c] for c in range(train)]), np.vstack([y[s, c][3:] for c in range(train)])
        alpha, _ = regression.decomposed(float(len(z)), z.sum(0), t.sum(0), (z.T @ z).ravel(), (z.T @ t).ravel()), None
        errors = regression.left_out_errors(z, t, float(len(z)), alpha, regression.ALPHAS)
        best = regression.ALPHAS[int(np.argmin(errors))]
        w, b = regression.solve_dual(z / z.std(0), t, best)
        p, truth = np.vstack([x[c] for c in range(train, n)]) / z.std(0) @ w + b, np.vstack([y[s, c][3:] for c in range(train, n)])
        r = [np.corrcoef(p[:, k], truth[:, k])[0, 1] for k in range(2)]
        g = got[s]
        assert g.alpha == best and g.mean_test_pearson == pytest.approx(np.mean(r)) and (g.n_train_samples, g.n_test_samples) == (len(z), len(p))
        assert g.train_clip_ids == list(range(train)) and g.test_clip_ids == list(range(train, n)) and g.feature_dim == 3 and g.num_targets == 2
        assert g.missing_clips == [c for c in range(7) if c >= n] and g.unmatched_clips == ([9] if s == "a" else [])
        assert [c.clip for c in g.per_clip_test_metrics] == list(range(train, n)) and g.per_clip_alignment[0].num_response_trs_raw == 15
    files.write_analysis(predictions, reports, f"{tmp_path}/out")
    files.write_analysis(predictions.where("subject = 'b'"), reports.where("subject = 'b'"), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out/summary").count() == 2
    assert spark.read.parquet(f"{tmp_path}/out/predictions").count() == predictions.count()


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 400), st.integers(1, 9))
def test_contiguous_runs(n, parts):
    # The same rule in plain numbers: the first n % parts runs have one more.
    sizes = [n // parts + (k < n % parts) for k in range(parts)]
    small, more = n // parts, n % parts
    of = [i // (small + 1) if i < more * (small + 1) else more + (i - more * (small + 1)) // small for i in range(n)]
    assert [of.count(k) for k in range(parts)] == sizes and of == sorted(of)


def test_files(spark, tmp_path):
    for k, text in enumerate(('{"subject": "b", "mean_r": 0.5}', '{"subject": "a", "feature_key": "x"}', "{broken")):
        (tmp_path / f"r{k}.json").write_text(text)
    d = files.read_results(spark, f"{tmp_path}/*.json")
    assert values(report.result_table(d), "subject", "feature_key", "mean_r") == [("a", "x", None), ("b", None, 0.5)]
    for n in ("e10.mkv", "e9.mkv", "x.txt"):
        (tmp_path / n).write_bytes(b"1")
    found = files.recordings(spark, str(tmp_path)).orderBy("key")
    assert values(found, "name") == [("e9.mkv",), ("e10.mkv",)]
    with pytest.raises(FileNotFoundError):
        files.recordings(spark, str(tmp_path), "*.avi")
    f = spark.createDataFrame([("a", 1, [0.5])], "feature_key string, clip int, features array<double>")
    files.write_features(f, f"{tmp_path}/features")
    files.write_features(f.withColumn("feature_key", F.lit("b")), f"{tmp_path}/features")
    back = spark.read.parquet(f"{tmp_path}/features")
    assert sorted(values(back, "feature_key")) == [("a",), ("b",)]
    assert files.unfinished(back, f, "feature_key").count() == 1
    files.write_csv(d, f"{tmp_path}/csv")
    assert files.read_csv(spark, f"{tmp_path}/csv", d.schema).count() == 2
    assert json.loads((tmp_path / "r0.json").read_text())["subject"] == "b"


def test_stream_equals_table(spark, data, tmp_path):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    spark.read.parquet(f"{data}/events.parquet").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = binned(stream).writeStream.outputMode("complete").format("memory").queryName("binned").start()
    q.processAllAvailable()
    q.stop()
    a = {(r.subject, r.parcel, r.start): r.n for r in spark.table("binned").collect()}
    assert a == {(r.subject, r.parcel, r.start): r.n for r in binned(spark.read.parquet(f"{data}/events.parquet")).collect()}


def test_tables_on_the_way_go(spark):
    from pathlib import Path

    with pytest.raises(RuntimeError), storage.temporary(spark) as outer:
        kept = storage.written(spark.range(3), "x")
        with storage.temporary(spark) as inner:
            assert storage.written(spark.range(5), "y").count() == 5 and inner.startswith(outer)
        assert kept.count() == 3 and not Path(inner.removeprefix("file://")).exists() and len(list(Path(outer.removeprefix("file://")).iterdir())) == 1
        raise RuntimeError
    assert not Path(outer.removeprefix("file://")).exists()
    assert outer not in storage.new_path(spark, "z")


def test_spread(spark, tmp_path):
    spark.range(1000).withColumn("t", F.lit("x")).coalesce(1).write.parquet(f"{tmp_path}/one.parquet")
    d = storage.spread(storage.table(spark, str(tmp_path), "one"))
    assert d.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in d.collect()) == list(range(1000))
    many = spark.range(0, 1000, 1, 8 * spark.sparkContext.defaultParallelism)
    assert storage.spread(many) is many
    full = spark.range(0, 1000, 1, spark.sparkContext.defaultParallelism)
    assert storage.spread(full) is full
    assert storage.spread(spark.range(0)).count() == 0
