"""Every registered query of the core against its SQL, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{data}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, db, name):
    df = catalog.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    if name not in catalog.ORACLE_SQL:
        assert rows and columns
        return
    found = db.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    wanted = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)
    assert len(rows) == len(wanted)
    keyed = lambda rs: sorted(rs, key=lambda r: [str(round(v, 4) + 0.0) if isinstance(v, float) else repr(v) for v in r])
    assert all(same(x, y) for a, b in zip(keyed(rows), keyed(wanted), strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", ["loo_wide_one", "ridge_loo_one"])
def test_equal_errors(spark, tmp_path, name):
    """Blocks of one step, and blocks and clips whose feature never changes, have the same error
    at every alpha: of these the SQL, in one thread, takes the last."""
    db = duckdb.connect()
    db.execute("SET threads = 1")
    vector = "[(CASE WHEN v % 3 = 1 OR v % 3 = 0 AND v // 60 = 1 THEN 0.5 ELSE hash(v) % 1000 / 1000 END)::FLOAT] || [(hash(v * 64 + p) % 1000 / 1000)::FLOAT for p in range(1, 64)]"
    db.execute(f"COPY (SELECT v vec_id, {vector} embedding, (v % 3)::INT \"label\" FROM range(0, 123) r(v)) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    found = db.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    wanted, got = sorted(found.fetchall()), sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).select(*names).collect())
    assert len(got) == len(wanted) and all(same(x, y) for a, b in zip(got, wanted, strict=True) for x, y in zip(a, b, strict=True))


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["parcel", "r", "n"] and df.count() == 64
    assert set(entry.oracle_sql()) <= set(entry.queries())
