"""Regressions by products of rows against plain NumPy, on both sides of rows = features."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import kernels, metrics, regression
from tidemark.plans import encoding


def frame(spark, x, y, g="a", first=0):
    rows = [(g, 0, first + i, [float(v) for v in a], None if b is None else [float(v) for v in b]) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "g string, clip int, tr int, x array<double>, y array<double>")


def plain(x, y, other, alpha, scale=False):
    mean, std = x.mean(0), x.std(0) if scale else 1.0
    std = np.where(std <= 1e-12, 1.0, std)
    a, b, c = (x - mean) / std, (other - mean) / std, y - y.mean(0)
    return b @ a.T @ np.linalg.solve(a @ a.T + alpha * np.eye(len(a)), c) + y.mean(0)


def left_out(x, y, alpha):
    """Errors of fits without each row, but on features standardised with all rows."""
    std = np.where(x.std(0) <= 1e-12, 1.0, x.std(0))
    z = (x - x.mean(0)) / std
    errors = []
    for i in range(len(z)):
        keep = np.arange(len(z)) != i
        a, m = z[keep], z[keep].mean(0)
        w = (a - m).T @ np.linalg.solve((a - m) @ (a - m).T + alpha * np.eye(len(a)), y[keep] - y[keep].mean(0))
        errors.append((y[i] - y[keep].mean(0) - (z[i] - m) @ w) ** 2)
    return np.mean(errors)


def test_wide_features_by_blocks(spark):
    """50 rows of 20,000 features; no task has more than a block of them."""
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((50, 20_000)), rng.standard_normal((50, 3))
    x[:, 7] = 2.0
    train = frame(spark, x[:40], y[:40]).repartition(3)
    test = frame(spark, x[40:], [None] * 10, first=40)
    for scale in (False, True):
        fits, p = kernels.kernel_ridge(train, test, "g", scale=scale, numbers=50_000)
        got = np.array([r.p for r in p.orderBy("tr").collect()])
        assert np.allclose(got, plain(x[:40], y[:40], x[40:], 1000.0, scale), rtol=0, atol=1e-9)
    assert fits.collect()[0].asDict() == {"g": "a", "alpha": 1000.0, "mse": None, "n": 40, "num_targets": 3, "feature_dim": 20_000}
    widest = kernels.feature_blocks(train, "tr", size=1000).agg(F.max(F.size("x")), F.count("*")).first()
    assert tuple(widest) == (1000, 40 * 20)


@pytest.mark.parametrize("d", [3, 19, 20, 21, 200])
def test_leave_one_out_on_both_sides(spark, d):
    """The same alpha and error as from products of features, and as from plain refits."""
    rng = np.random.default_rng(d)
    x = rng.standard_normal((20, d))
    y = x[:, :2] @ rng.standard_normal((2, 4)) + rng.standard_normal((20, 4))
    alphas = (0.1, 1.0, 10.0, 100.0)
    train = frame(spark, x, y)
    fits, p = kernels.kernel_ridge(train, train.drop("y"), "g", alphas=alphas, scale=True, numbers=400)
    narrow = regression.loo_fit(train, "g", alphas=alphas)
    a, b = fits.first(), narrow.first()
    assert a.alpha == b.alpha and abs(a.mse - b.mse) < 1e-9 * max(1, b.mse)
    predicted = np.array([r.p for r in regression.predict(train, narrow, "g").orderBy("tr").collect()])
    assert np.allclose(np.array([r.p for r in p.orderBy("tr").collect()]), predicted, rtol=0, atol=1e-8)
    # Leaving a row out changes the mean as well: the leverage has the constant in it.
    assert min(alphas, key=lambda k: left_out(x, y, k)) == a.alpha and abs(left_out(x, y, a.alpha) - a.mse) < 1e-9 * max(1, a.mse)


def test_features_are_made_for_rows_and_for_products_only(spark):
    """Sizes, counts and answers come from rows that are kept without their features."""
    rng = np.random.default_rng(2)
    made = spark.sparkContext.accumulator(0)

    def wide(v):
        made.add(1)
        return v * 2

    wide = F.udf(wide, "array<double>").asNondeterministic()
    x, y = rng.standard_normal((30, 40)), rng.standard_normal((30, 2))
    train, test = frame(spark, x[:20], y[:20]).withColumn("x", wide("x")), frame(spark, x[20:], [None] * 10, first=20).withColumn("x", wide("x"))
    p = kernels.kernel_ridge(train, test, "g")[1]
    both = np.hstack([x, x])
    assert np.allclose([r.p for r in p.orderBy("tr").collect()], plain(both[:20], y[:20], both[20:], 1000.0))
    assert made.value == 2 * 30


def test_groups_and_odd_rows(spark):
    """Groups of their own sizes, null keys, rows with holes, groups without test or training rows."""
    rng = np.random.default_rng(3)
    parts, want = [], {}
    for g, n, d in (("a", 8, 30), (None, 5, 12), ("c", 3, 4), ("only train", 4, 9)):
        x, y = rng.standard_normal((n + 2, d)), rng.standard_normal((n + 2, 2))
        train, test = frame(spark, x[:n], y[:n], g), frame(spark, x[n:], y[n:], g, first=n)
        parts.append((train, test if g != "only train" else test.where("false")))
        if g != "only train":
            want |= {(g, n + i): v for i, v in enumerate(plain(x[:n], y[:n], x[n:], 10.0))}
    holes = spark.createDataFrame([("a", 0, 90, [1.0, None] + [0.0] * 28, [1.0, 2.0]), ("a", 0, 91, None, [1.0, 2.0]), ("a", 0, 92, [float("nan")] + [0.0] * 29, [1.0, 2.0])], parts[0][0].schema)
    train, test = parts[0][0].union(holes), parts[0][1].union(holes).union(frame(spark, [[1.0]], [[1.0]], "only test"))
    for a, b in parts[1:]:
        train, test = train.union(a), test.union(b)
    for most in (4096, 8):
        fits, p = kernels.kernel_ridge(train, test.drop("y"), "g", alphas=(10.0,), most_rows=most)
        got = {(r.g, r.tr): r.p for r in p.collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
        assert {(r.g, r.n, r.feature_dim) for r in fits.collect()} == {("a", 8, 30), (None, 5, 12), ("c", 3, 4), ("only train", 4, 9)}
    with pytest.raises(ValueError, match="more than 7"):
        kernels.kernel_ridge(train, test, "g", most_rows=7)
    fits, p = kernels.kernel_ridge(train.where("false"), test, "g")
    assert fits.count() == p.count() == 0
    fits, p = kernels.kernel_ridge(parts[0][0], parts[0][1], alphas=(10.0,))  # no groups
    assert fits.count() == 1 and np.allclose([r.p for r in p.orderBy("tr").collect()], [want["a", 8], want["a", 9]])


def test_sums_leave_rows_with_holes_out(spark):
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((30, 4)), rng.standard_normal((30, 2))
    d = frame(spark, x, y)
    holes = spark.createDataFrame([("a", 0, 90, [1.0, None, 0.0, 0.0], [1.0, 2.0]), ("a", 0, 91, [1.0] * 4, [1.0, None]), ("a", 0, 92, None, None)], d.schema)
    a, b = (regression.ridge_fit(f, "g", form="sums").first() for f in (d, d.union(holes)))
    assert np.allclose(a.w, b.w) and np.allclose(a.b, b.b)
    p = {r.tr: r.p for r in regression.predict(holes, regression.ridge_fit(d, "g"), "g").collect()}
    assert p[90] is None and p[92] is None and p[91] is not None


def test_sweep_reports_what_fails(spark):
    """Variants that can't be run have a reason, the others their scores."""
    rng = np.random.default_rng(7)
    y = rng.standard_normal((80, 3))
    step = [(c, t, y[10 * c + t].tolist()) for c in range(8) for t in range(10)]
    x = {(c, t): [float(v) for v in rng.standard_normal(2)] + [v[0] + 0.1 * rng.standard_normal()] for c, t, v in step}
    rows = [("good", c, t, x[c, t]) for c, t, _ in step]
    rows += [("few", c, t, x[c, t]) for c, t, _ in step if c < 4]
    rows += [("uneven", c, t, x[c, t][: 1 + c % 2]) for c, t, _ in step]
    rows += [("elsewhere", c + 100, t, x[c, t]) for c, t, _ in step] + [("empty", 1, 1, None), ("short", 1, 0, [1.0])]
    features = spark.createDataFrame(rows, "feature_key string, clip int, tr int, x array<double>")
    responses = spark.createDataFrame(step, "clip int, tr int, y array<double>")
    got = {(r.feature_key, r.lag, r.alpha): r for r in encoding.analysis_sweep(features, responses, (0, 9), (0.5, 50.0)).collect()}
    assert len(got) == 6 * 2 * 2
    reasons = {"few": "too few clips to split: 4", "uneven": "rows with different numbers of features or responses", "elsewhere": "no aligned steps", "empty": "no aligned steps", "short": "no aligned steps"}
    for (key, lag, _), r in got.items():
        if lag == 9 or key != "good":  # clips of one step don't count
            assert r.status == (reasons[key] if key in reasons and lag == 0 else "no aligned steps") and r.mean_r is None and r.n_train is None
    a = np.array([x[c, t] for c, t, _ in step])
    train = np.arange(80) < 60
    for alpha in (0.5, 50.0):
        r = got["good", 0, alpha]
        p = plain(a[train], y[train], a[~train], alpha, True)
        rs = [np.corrcoef(p[:, k], y[~train][:, k])[0, 1] for k in range(3)]
        r2 = 1 - ((p - y[~train]) ** 2).sum(0) / ((y[~train] - y[~train].mean(0)) ** 2).sum(0)
        assert r.status == "ok" and (r.n_clips, r.n_train, r.n_test) == (8, 60, 20)
        assert np.allclose([r.mean_r, r.median_r, r.mean_r2, r.median_r2], [np.mean(rs), np.median(rs), np.mean(r2), np.median(r2)])
    assert encoding.analysis_sweep(features.where("false"), responses, (0,), (1.0,)).count() == 0


def test_analysis_of_wide_features(spark):
    """A whole analysis has the same result with features that are copies, on either side."""
    rng = np.random.default_rng(9)
    y = rng.standard_normal((60, 4))
    rows = [(k // 10, k % 10, [float(y[k, 0] + rng.standard_normal()), float(rng.standard_normal())], y[k].tolist()) for k in range(60)]
    d = spark.createDataFrame(rows, "clip int, tr int, x array<double>, y array<double>")
    own = d.select(F.lit("s").alias("subject"), "clip", "tr", "y")
    found = []
    for n in (1, 64):
        x = d.select("clip", "tr", F.flatten(F.array_repeat("x", n)).alias("x"))
        p, r = encoding.subject_analysis(x, own, alphas=tuple(a * n for a in (1.0, 100.0)), lag=0)
        found.append(([q.p for q in p.orderBy("clip", "tr").collect()], r.first()))
    assert np.allclose(found[0][0], found[1][0]) and found[1][1].feature_dim == 128 and found[1][1].alpha == 64 * found[0][1].alpha
    assert found[0][1].mean_test_pearson == pytest.approx(found[1][1].mean_test_pearson) and found[1][1].num_targets == 4


def test_correlations_of_subjects_in_one_pass(spark):
    """As from pairs of rows, with holes, subjects that don't vary, large means and ties of steps."""
    rng = np.random.default_rng(11)
    rows = []
    for s in "abcd":
        for clip in range(2):
            for parcel in range(3):
                for tr in range(12):
                    if rng.random() < 0.8:
                        v = 1e6 + rng.standard_normal() + (tr if s in "ab" else 0)
                        rows.append((s, clip, tr, parcel, 1e6 + 5.0 if s == "d" and parcel == 1 else None if rng.random() < 0.1 else v))
    rows += [("a", 9, 0, 0, 1.0), (None, 0, 0, 0, 1.0), ("b", 9, 1, 0, float("nan"))]
    d = spark.createDataFrame(rows, "subject string, clip int, tr int, parcel int, y double").repartition(3)
    got = {(r.a, r.b, r.clip, r.parcel): r for r in metrics.subject_correlations(d).collect()}
    y = {(s, c, p, t): v for s, c, t, p, v in rows if s and v is not None and v == v}
    want = 0
    for a, b in ("ab", "ac", "ad", "bc", "bd", "cd"):
        for c in range(2):
            for p in range(3):
                both = [(y[a, c, p, t], y[b, c, p, t]) for t in range(12) if (a, c, p, t) in y and (b, c, p, t) in y]
                if not both:
                    continue
                want += 1
                u, v = np.array(both).T
                r = got[a, b, c, p]
                assert r.n == len(both)
                if len(both) < 2 or u.std() == 0 or v.std() == 0:
                    assert r.r is None
                else:
                    assert r.r == pytest.approx(np.corrcoef(u, v)[0, 1], abs=1e-6)
    assert len(got) == want
    plan = metrics.subject_correlations(d)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    for few in (d.where("subject = 'a'"), d.where("false")):
        assert metrics.inter_subject(few).count() == 0
    table = d.join(d.where("subject = 'a'").select("clip").distinct(), "clip")
    assert metrics.noise_ceiling(table).count() == 1
