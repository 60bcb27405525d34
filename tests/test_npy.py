"""Round trips of .npy files, and ranges that are read alone."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import npy


@pytest.fixture
def source(spark):
    spark.dataSource.register(npy.NpySource)
    return spark.read.format("npy")


@pytest.mark.parametrize("shape", [(7,), (7, 3), (5, 2, 4), (3, 2, 2, 2), (0, 3)])
@pytest.mark.parametrize("kind", ["<f2", "<f4", ">f8", "<i4", "u1", "?"])
def test_reads_what_numpy_wrote(source, tmp_path, shape, kind):
    x = (np.arange(np.prod(shape)).reshape(shape) % 5 - (kind != "u1") * (kind != "?")).astype(kind)
    np.save(f"{tmp_path}/a.npy", x)
    np.save(f"{tmp_path}/b.npy", np.asfortranarray(x))
    got = source.load(str(tmp_path)).orderBy("path", "row").collect()
    assert [r.row for r in got] == list(range(len(x))) * 2
    for k, r in enumerate(got):
        assert np.array_equal(np.array(r.value, float).reshape(x.shape[1:]), x[k % len(x)].astype(float))


def test_two_rows_of_a_large_file(source, tmp_path, monkeypatch):
    """A file that says it has a thousand million rows, and ends behind the first ones."""
    with open(f"{tmp_path}/x.npy", "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<f8", "fortran_order": False, "shape": (10**9, 4)})
        f.write(np.arange(40.0).tobytes())
    got = source.option("first", 3).option("last", 5).load(f"{tmp_path}/x.npy").orderBy("row").collect()
    assert [(r.row, r.value) for r in got] == [(3, [12.0, 13.0, 14.0, 15.0]), (4, [16.0, 17.0, 18.0, 19.0])]
    monkeypatch.setattr(npy, "PART", 3 * 32)
    parts = npy.NpyReader({"path": f"{tmp_path}/x.npy", "last": "10"}, npy.NpySource({"path": f"{tmp_path}/x.npy"}).schema()).partitions()
    assert [(p.first, p.last) for p in parts] == [(0, 3), (3, 6), (6, 9), (9, 10)]
    with pytest.raises(Exception, match="ends before row"):
        source.option("first", 0).option("last", 20).load(f"{tmp_path}/x.npy").collect()


@pytest.mark.parametrize("depth", [0, 1, 2])
def test_round_trip(spark, source, tmp_path, depth):
    value = F.col("id").cast("double")
    if depth:
        value = F.array(*[value + k / 8 for k in range(3)])
    if depth == 2:
        value = F.array(value, F.reverse(value))
    d = spark.range(1000).select(value.alias("value"))
    to = f"{tmp_path}/out"
    d.repartition(5).write.format("npy").option("kind", "<f2").mode("append").save(to)
    files = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert files == ["_SUCCESS", *[f"part-{k:05d}.npy" for k in range(5)]]
    assert np.load(f"{to}/part-00000.npy").dtype == np.float16
    back = source.load(to).select(F.col("value").cast(d.schema["value"].dataType).alias("value"))
    assert back.count() == 1000
    if not depth:  # whole numbers up to 2,048 are kept by halves
        assert back.exceptAll(d).count() == 0
    wide = d.coalesce(2)
    wide.write.format("npy").mode("overwrite").save(to)
    back = source.load(to).select("value")
    assert back.schema["value"].dataType.simpleString() == d.schema["value"].dataType.simpleString()
    assert back.exceptAll(d).count() == 0 == d.exceptAll(back).count() and len(list((tmp_path / "out").glob("*.npy"))) <= 2
    wide.limit(10).write.format("npy").mode("append").save(to)
    assert source.load(to).count() == 1010


def test_what_fails_leaves_nothing(spark, source, tmp_path):
    d = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "value array<double>").coalesce(1)
    for bad in (d, spark.createDataFrame([([1.0, None],), (None,)], "value array<double>")):
        with pytest.raises(Exception, match="shapes|null"):
            bad.write.format("npy").mode("append").save(f"{tmp_path}/x")
        assert not list(tmp_path.glob("x/*"))
    np.save(f"{tmp_path}/o.npy", np.array([{}, 1], object), allow_pickle=True)
    with pytest.raises(Exception, match="no numbers"):
        source.load(f"{tmp_path}/o.npy")
    with pytest.raises(Exception, match=r"no \.npy file"):
        (tmp_path / "none").mkdir()
        source.load(f"{tmp_path}/none")
    np.save(f"{tmp_path}/none/a.npy", np.zeros((2, 2)))
    np.save(f"{tmp_path}/none/b.npy", np.zeros((2, 2), np.float32))
    with pytest.raises(Exception, match="isn't as in the first file"):
        source.load(f"{tmp_path}/none").count()
