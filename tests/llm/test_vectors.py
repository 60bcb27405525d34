"""Clusters and exact searches against plain loops over all pairs, and SQL."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import sql
from tidemark.llm.centroids import centroid_clusters, nearest, spread_out, to_pivots
from tidemark.llm.queries import op11_centroids, op13_top_products
from tidemark.llm.top_products import LEAST, Shard, top_products
from tidemark.llm.vectors import MOST, blocks, exact

SCHEMA = "vec_id long, embedding array<float>, cluster string, score string, row int, v int"


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    at = lambda v: min((dist(v, x), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = [at(v)[1] for _, v in kept]
        new = []
        for j, old in enumerate(c):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            new.append([sum(x) // len(mine) for x in zip(*mine)] if mine else old)
        c = new
    last = [at(v) for _, v in kept]
    inertia = Counter()
    for d, j in last:
        inertia[j] += d
    return Counter((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last))


def plain_search(rows, k=5, every=50):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for n, (i, q) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(q, v)), j is None, j or 0) for m, (j, v) in enumerate(kept) if m != n))[:k]
        out.update((i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(scored))
    return out


def odd_rows():
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(size=64).round(2).tolist()) for i in rng.permutation(300)]
    same = rng.normal(size=64).round(1).tolist()
    rows += [(400 + i, same) for i in range(60)] + [(450, same)] * 3  # ties and repeated rows
    rows += [(None, same), (None, rng.normal(size=64).tolist()), (-100, same), (500, None), (550, []), (600, [0.0] * 64), (650, [None] * 64), (700, [math.nan] * 64), (750, [math.inf] + [0.0] * 63)]
    rows += [(800, [1.0] * 3), (850, [0.5] * 200), (900, [-1.0] * 64), (950, [1e4] * 64), (1000, [-1e4] * 64), (1050, [2.0] * 5000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", 1, 2) for i, v in rows], SCHEMA)


def test_clusters(spark):
    for rows in (odd_rows(), [r for r in odd_rows() if r[1]][:7], [(5, [1.0] * 64)] * 40):
        assert Counter(map(tuple, centroid_clusters(frame(spark, rows).repartition(3)).collect())) == plain_clusters(rows)
    assert centroid_clusters(frame(spark, [(1, None), (2, [1.0])])).count() == 0
    far = [(i, [3e38 if i % 2 else -3e38] * 64) for i in range(40)]
    got = centroid_clusters(frame(spark, far), k=1).collect()
    assert len(got) == 40 and max(r.inertia for r in got) == (1 << 63) - 1  # held within bounds, and within a long


def test_bounds_prune_and_stay_exact():
    """Vectors in groups: pivots spare most distances, and results are those of a loop."""
    rng = np.random.default_rng(1)
    at = rng.integers(-500, 500, (16, 64))
    v = at[rng.integers(0, 16, 5000)] + rng.integers(-20, 21, (5000, 64))
    for scale in (1, 1 << 12):
        x, c = v * scale, at * scale
        p = spread_out(x[:512], 8)
        own, d, taken = nearest(x, to_pivots(x, p), c, to_pivots(c, p))
        every = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (own == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
        assert taken < 2 * len(v)
    far = np.array([[MOST] * 64, [-MOST] * 64])
    own, d, _ = nearest(far, to_pivots(far, far), far[:1], to_pivots(far[:1], far))
    assert d.tolist() == [0, 64 * (2 * MOST) ** 2]


def test_search(spark):
    rows = odd_rows()
    for part in (rows, rows[:4] + [(0, [1.0, 2.0])], [(50, [1.0])]):
        for sample in (4096, 3):
            got = top_products(frame(spark, part).repartition(3), sample=sample)
            assert got.columns == ["query_id", "rank", "vec_id", "score"] and Counter(map(tuple, got.collect())) == plain_search(part)
    assert top_products(frame(spark, [(50, None), (1, [1.0])])).count() == 0
    assert top_products(frame(spark, [(50, None)])).count() == 0


def test_competitive_rows():
    """Whatever the score to beat, all rows that reach it are found, with their scores."""
    rng = np.random.default_rng(2)
    for size, d in ((3, 1), (200, 5), (2000, 64)):
        for scale in (10, 3000, 1 << 24):
            v = rng.integers(-scale, scale, (size, d)) * (rng.random((size, d)) < 0.7)
            shard = Shard(v)
            for _ in range(5):
                q = rng.integers(-scale, scale, d)
                scores = v @ q
                for beat in (LEAST, -1, 0, 1, int(np.sort(scores)[-min(size, 3)]), int(scores.max()) + 1):
                    at, found = shard.competitive(q, beat)
                    assert at.tolist() == np.flatnonzero(scores >= beat).tolist() and (found == scores[at]).all()
    assert exact(5) is np.float32 and exact(1 << 30) is np.float64 and exact(1 << 60) is np.int64


def test_blocks():
    """Matrices of bounded size, whatever the batches; long vectors alone."""
    lengths = [3] * 50 + [40] + [1000] + [0] * 5 + [2] * 7
    v = [list(range(n)) for n in lengths]
    batches = [pa.record_batch({"i": list(range(a, min(a + 9, len(v)))), "v": pa.array(v[a : a + 9], pa.list_(pa.int32()))}) for a in range(0, len(v), 9)]
    seen = []
    for (i,), m in blocks(iter(batches), 1, 90):
        assert len(m) == 1 or m.size <= 90
        seen += [(k, row[: lengths[k]].tolist(), row[lengths[k] :].any()) for k, row in zip(i.to_pylist(), m)]
    assert seen == [(k, x, False) for k, x in enumerate(v)]
    assert list(blocks(iter([]), 1, 90)) == []


@pytest.mark.parametrize("query, oracle", [(op11_centroids, sql.CENTROIDS), (op13_top_products, sql.TOP_PRODUCTS)])
def test_against_sql(spark, data, query, oracle, tmp_path):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    found = c.execute(oracle)
    names = [x[0] for x in found.description]
    got = query(spark, data)
    assert set(got.columns) == set(names) and sorted(map(tuple, got.select(*names).collect())) == sorted(found.fetchall())
    spark.read.parquet(f"{data}/embeddings.parquet").limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert query(spark, str(tmp_path)).count() == 0
