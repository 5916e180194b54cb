"""Rows (row_id, vec) from frames, arrays, lists and files."""

from __future__ import annotations

from pathlib import PurePosixPath
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shared
from ..errors import InconsistentDims, MissingKey, ShapeMismatch, UnsupportedColumnType, UnsupportedExtension
from ..functions.vectors import as_floats, vector_from_columns
from ..operators.validate import check_type
from .npy import NpyDataSource, is_parts, local

#: Files whose table of first places is broadcast.
FEW_FILES = 20_000


def from_dataframe(df: DataFrame, vec_col: str, id_col: str) -> DataFrame:
    """Elements are cast to FLOAT; ids must be given, since a DataFrame has no order."""
    check_type(df, vec_col)
    return df.select(F.col(id_col).cast("long").alias("row_id"), as_floats(F.col(vec_col)).alias("vec"))


def from_columns(df: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("row_id"), vector_from_columns(*columns).alias("vec"))


def as_matrix(data: Any) -> np.ndarray:
    """float32 rows from an array, a frame or series, a list, or a list of lists; one dimension is one row."""
    if hasattr(data, "to_numpy"):
        data = data.to_numpy()
    if isinstance(data, np.ndarray):
        if data.dtype == object:
            data = data.tolist()
        elif data.ndim not in (1, 2):
            raise ShapeMismatch(0, data.ndim)
    if not isinstance(data, np.ndarray):
        rows = list(data)
        if rows and hasattr(rows[0], "__len__"):
            sizes = {len(r) for r in rows}
            if len(sizes) > 1:
                raise InconsistentDims(min(sizes), max(sizes))
        data = np.array(rows, np.float64)
    if not np.issubdtype(data.dtype, np.number):
        raise UnsupportedColumnType(f"elements are {data.dtype}, not numbers")
    matrix = np.ascontiguousarray(np.atleast_2d(data), np.float32)
    if 0 in matrix.shape:
        raise ShapeMismatch(*matrix.shape)
    return matrix


def from_local(spark: SparkSession, data: Any) -> DataFrame:
    """Row numbers become ids."""
    import pyarrow as pa

    matrix = as_matrix(data)
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    table = pa.table({"row_id": pa.array(np.arange(len(matrix), dtype=np.int64)), "vec": pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))})
    return spark.createDataFrame(table, schema="row_id long, vec array<float>")


def from_file(spark: SparkSession, path: str, key: str | None = None, id_col: str | None = None) -> DataFrame:
    """``.npy``, ``.npz`` (``key``: array) or ``.parquet`` (``key``: column of FLOAT lists).

    Parquet rows take ``id_col``, or else their place in all files, by name; so do those of a folder of ``.npy`` parts.
    """
    suffix = PurePosixPath(path).suffix.lower()
    if not suffix and is_parts(path):
        suffix = ".npy"
    if suffix not in (".npy", ".npz", ".parquet"):
        raise UnsupportedExtension(f"cannot load {suffix or 'a file without extension'}; use .npy, .npz or .parquet")
    if suffix != ".npy" and key is None:
        raise MissingKey(f"{suffix} files need a key")
    if suffix != ".parquet":
        spark.dataSource.register(NpyDataSource)
        reader = spark.read.format("npy")
        if suffix == ".npz":
            reader = reader.option("key", key).option("unpacked", local(shared.new_path(spark, "npz")) + ".npy")
        return reader.load(path)
    df = spark.read.parquet(path)
    check_type(df, key)
    if not isinstance(df.schema[key].dataType.elementType, T.FloatType):
        raise UnsupportedColumnType(f"{key} is {df.schema[key].dataType.simpleString()}, not array<float>")
    if id_col is not None:
        return df.select(F.col(id_col).cast("long").alias("row_id"), F.col(key).alias("vec"))
    return numbered(df).select("row_id", F.col(key).alias("vec"))


def numbered(df: DataFrame) -> DataFrame:
    """Add ``row_id``, the place in all of the files that ``df`` was read from, in order of their names.

    Files are counted, and each one's rows follow those of the files before it: rows are neither sorted nor shuffled.
    """
    spark = df.sparkSession
    rows = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"))
    counts = sorted((r["__file"], r.n) for r in rows.groupBy("__file").agg(F.count(F.lit(1)).alias("n")).collect())  # the files, which the driver lists anyway
    begins = np.cumsum([0, *[n for _, n in counts]]).tolist()
    table = spark.createDataFrame([(f, b) for (f, _), b in zip(counts, begins, strict=False)], "__file string, __begins long")
    table = F.broadcast(table) if len(counts) <= FEW_FILES else table
    return rows.join(table, "__file").withColumn("row_id", F.col("__begins") + F.col("__place")).drop("__file", "__place", "__begins")


def to_npy(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the vectors of ``rows`` (row_id, vec), in order of their ids, as ``.npy`` parts in the folder ``path``."""
    rows.sparkSession.dataSource.register(NpyDataSource)
    ordered = rows.repartitionByRange("row_id").sortWithinPartitions("row_id")
    ordered.select(as_floats(F.col("vec")).alias("vec")).write.format("npy").mode(mode).save(path)
