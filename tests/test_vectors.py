"""Vector functions, validation, ingest and the error model."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone import errors
from lodestone.functions import vectors as V
from lodestone.operators.validate import profile
from lodestone.options import IndexOptions, parse_backend
from lodestone.plans.index import VectorIndex, list_gpu_devices
from lodestone.sources import tables


def first(spark, rows, column, kind="array<double>"):
    return spark.createDataFrame([(rows,)], f"v {kind}").select(column.alias("x")).first().x


def test_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    r = df.select(V.dot(a, b).alias("dot"), V.l2_norm(a).alias("norm"), V.l2_normalize(a).alias("unit"), V.cosine(a, b).alias("cos"), V.cosine_distance(a, b).alias("away"), V.pad(a).alias("pad")).first()
    assert r.dot == 11 and r.norm == 5 and r.unit == [0.6, 0.8]
    assert r.cos == pytest.approx(11 / (5 * 5**0.5)) and r.away == 0
    assert r.pad == [3.0, 4.0] + [0.0] * 6


def test_dot_of_different_lengths_is_null(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert df.select(V.dot(F.col("a"), F.col("b")).alias("x")).first().x is None


def test_sql_functions(spark):
    assert set(V.register(spark)) == {"vec_dot", "vec_norm", "vec_unit", "vec_cosine"}
    r = spark.sql("SELECT vec_dot(array(1D, 2D), array(3D, 4D)) a, vec_norm(array(3D, 4D)) b, vec_unit(array(0D, 2D)) c, vec_cosine(array(1D, 0D), array(1D, 1D)) d").first()
    assert r.a == 11 and r.b == 5 and r.c == [0.0, 1.0] and r.d == pytest.approx(0.5**0.5)


def test_profile_counts_every_fault(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [0.0, -inf]), (5, [0.0, 0.0]), (6, [1.0])]
    p = profile(spark.createDataFrame(rows, "row_id long, vec array<float>"), "vec")
    assert (p.rows, p.null_rows, p.null_elements, p.non_finite, p.zero_norm, p.min_dims, p.max_dims) == (7, 1, 1, 2, 1, 1, 2)


def test_profile_of_nothing(spark):
    assert profile(spark.createDataFrame([], "row_id long, vec array<float>"), "vec").rows == 0


@pytest.mark.parametrize(
    ("rows", "error"),
    [
        ([], errors.ShapeMismatch),
        ([(0, None)], errors.NullValues),
        ([(0, [1.0, None])], errors.NullValues),
        ([(0, [1.0]), (1, [1.0, 2.0])], errors.InconsistentDims),
        ([(0, [])], errors.ShapeMismatch),
        ([(0, [float("inf"), 1.0])], errors.NonFiniteInput),
        ([(0, [0.0, 0.0])], errors.ZeroNorm),
        ([(0, [3.4e-4, 0.0])], errors.ZeroNorm),
    ],
)
def test_bad_rows(spark, rows, error):
    df = spark.createDataFrame(rows, "row_id long, vec array<float>")
    with pytest.raises(error) as e:
        VectorIndex(df).fit()
    assert isinstance(e.value, ValueError)


def test_zero_rows_pass_when_taken_as_they_are(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0])], "row_id long, vec array<float>")
    found = VectorIndex(df, IndexOptions(normalized=True, enable_cache=False)).search([[2.0, 0.0]], 2).orderBy("rank").collect()
    assert [(r.row_id, r.similarity) for r in found] == [(1, 2.0), (0, 0.0)]


def test_bad_searches(spark):
    index = VectorIndex.from_local(spark, np.eye(8, dtype=np.float32), enable_cache=False)
    with pytest.raises(errors.InvalidTopK):
        index.search([1.0] * 8, 0)
    with pytest.raises(errors.QueryDimensionMismatch) as e:
        index.search([1.0] * 4, 1)
    assert (e.value.expected, e.value.found) == (8, 4)
    with pytest.raises(errors.NonFiniteInput):
        index.search([float("nan")] * 8, 1)
    with pytest.raises(errors.ZeroNorm):
        index.search([0.0] * 8, 1)
    with pytest.raises(errors.PayloadMismatch, match="row count must match index rows"):
        index.search([1.0] * 8, 1, payload=spark.range(2).withColumnRenamed("id", "row_id"))


def test_backends():
    assert parse_backend("CPU") == "cpu"
    for name in ("gpu", "GPU", "tpu"):
        with pytest.raises(errors.BackendUnavailable):
            IndexOptions(backend=name)
    assert list_gpu_devices() == []
    assert IndexOptions(gpu_device_index=9).gpu_device_index == 9


def test_local_inputs():
    m = np.arange(6, dtype=np.float64).reshape(2, 3) + 1
    for data in (m, m.astype(np.float32), m.astype(np.int64), np.asfortranarray(m), m.tolist(), pd.DataFrame(m), m[::1]):
        got = tables.as_matrix(data)
        assert got.dtype == np.float32 and got.flags.c_contiguous and np.array_equal(got, m.astype(np.float32))
    assert tables.as_matrix(pd.Series([1.0, 2.0])).shape == (1, 2)
    assert tables.as_matrix(m[:, ::2]).tolist() == [[1, 3], [4, 6]]
    for data in ([], [[]], np.empty((0, 3)), np.zeros((1, 1, 1))):
        with pytest.raises(errors.ShapeMismatch):
            tables.as_matrix(data)
    with pytest.raises(errors.InconsistentDims):
        tables.as_matrix([[1.0], [1.0, 2.0]])


def test_columns_to_vectors(spark):
    df = spark.createDataFrame([(7, 1, 2.5)], "id int, x int, y double")
    assert tables.from_columns(df, ["x", "y"], "id").first().asDict() == {"row_id": 7, "vec": [1.0, 2.5]}
    with pytest.raises(errors.UnsupportedColumnType):
        tables.from_dataframe(df, "x", "id")
    with pytest.raises(errors.UnsupportedColumnType):
        tables.from_dataframe(df, "none", "id")
