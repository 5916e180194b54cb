"""Parts of `.npy` files written and read, and row numbers of several Parquet files."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.sources import tables
from lodestone.sources.npy import part_files


def matrix(n, dims=4, seed=0):
    return np.random.default_rng(seed).normal(size=(n, dims)).astype(np.float32)


def back(df):
    rows = sorted(df.collect(), key=lambda r: r.row_id)
    assert [r.row_id for r in rows] == list(range(len(rows)))
    return np.array([r.vec for r in rows], np.float32)


@pytest.fixture
def in_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else such small parts become one
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_parts_are_read_back_in_order(spark, tmp_path, in_parts):
    m, path = matrix(1000), str(tmp_path / "vectors")
    tables.to_npy(tables.from_local(spark, m).repartition(7), path)
    files = part_files(path)
    assert len(files) > 1 and sorted(os.listdir(path)) == files  # nothing else is left
    assert np.array_equal(np.concatenate([np.load(os.path.join(path, f)) for f in files]), m)
    assert np.array_equal(back(tables.from_file(spark, path)), m)
    assert np.array_equal(back(spark.read.format("npy").option("rows_per_partition", 64).load(path)), m)


def test_overwriting_and_appending(spark, tmp_path):
    a, b, path = matrix(30), matrix(20, seed=1), str(tmp_path / "vectors")
    tables.to_npy(tables.from_local(spark, b), path)
    tables.to_npy(tables.from_local(spark, a), path)
    tables.to_npy(tables.from_local(spark, b), path, "append")
    assert np.array_equal(back(tables.from_file(spark, path)), np.concatenate([a, b]))


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = tables.from_local(spark, matrix(200)).repartition(4)
    path = str(tmp_path / "vectors")
    ragged = rows.withColumn("vec", F.when(F.col("row_id") == 117, F.slice("vec", 1, 3)).otherwise(F.col("vec")))
    for bad in (ragged, rows.withColumn("vec", F.when(F.col("row_id") != 5, F.col("vec")))):
        with pytest.raises(Exception, match="InconsistentDims|NullValues|null|dimension"):
            tables.to_npy(bad, path)
        assert not os.path.exists(path)
    tables.to_npy(rows, path)
    before = [np.load(os.path.join(path, f)) for f in part_files(path)]
    with pytest.raises(Exception, match="InconsistentDims|dimension"):
        tables.to_npy(ragged, path)
    assert all(np.array_equal(x, np.load(os.path.join(path, f))) for x, f in zip(before, sorted(os.listdir(path)), strict=True))


def test_parts_of_different_widths_are_refused(spark, tmp_path):
    np.save(tmp_path / "part-00000000.npy", matrix(3))
    np.save(tmp_path / "part-00000001.npy", matrix(3, 5))
    with pytest.raises(Exception, match="dimension"):
        tables.from_file(spark, str(tmp_path)).count()


def test_an_archive_is_unpacked_once(spark, tmp_path):
    m, path, to = matrix(300), str(tmp_path / "a.npz"), str(tmp_path / "unpacked.npy")
    np.savez_compressed(path, x=m, y=matrix(3))
    read = spark.read.format("npy").option("key", "x").option("rows_per_partition", 17)
    assert np.array_equal(back(read.load(path)), m)
    df = read.option("unpacked", to).load(path)
    assert np.array_equal(back(df), m) and np.array_equal(np.load(to), m)
    made = os.stat(to).st_mtime_ns
    assert df.count() == 300 and os.stat(to).st_mtime_ns == made
    assert np.array_equal(back(tables.from_file(spark, path, "x")), m)


def test_one_file_and_its_split_have_the_same_numbers(spark, tmp_path):
    m = matrix(500)
    rows = tables.from_local(spark, m).select("vec")
    one, many = str(tmp_path / "one.parquet"), str(tmp_path / "many.parquet")
    rows.coalesce(1).write.parquet(one)
    for i, (a, b) in enumerate([(0, 120), (120, 121), (121, 400), (400, 500)]):
        tables.from_local(spark, m[a:b]).select("vec").coalesce(1).write.parquet(f"{tmp_path}/p{i}")
        os.makedirs(many, exist_ok=True)
        (part,) = [f for f in os.listdir(f"{tmp_path}/p{i}") if f.endswith(".parquet")]
        os.rename(f"{tmp_path}/p{i}/{part}", f"{many}/part-{i}.parquet")
    assert np.array_equal(back(tables.from_file(spark, one, "vec")), m)
    assert np.array_equal(back(tables.from_file(spark, many, "vec")), m)
    plan = tables.from_file(spark, many, "vec")._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange hash" not in plan and "Exchange range" not in plan
