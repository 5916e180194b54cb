"""Checks of vector columns in one aggregate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InconsistentDims, NonFiniteInput, NullValues, QueryDimensionMismatch, ShapeMismatch, UnsupportedColumnType, ZeroNorm
from ..functions.vectors import has_non_finite, has_null, norm_sq

#: Squared lengths up to this are refused as zero: the spacing of 32-bit floats at 1 (fixed value).
ZERO_NORM_SQ = 1.1920928955078125e-07


@dataclass(frozen=True)
class VectorProfile:
    rows: int
    null_rows: int
    null_elements: int
    non_finite: int
    zero_norm: int
    min_dims: int
    max_dims: int


def profile_columns(v: Column) -> list[Column]:
    """Aggregates: rows, null_rows, rows with null elements, with non-finite ones, of zero length; dims."""
    whole = v.isNotNull() & ~has_null(v)
    count = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0).cast("long"))
    return [
        F.count(F.lit(1)).alias("rows"),
        count(v.isNull()).alias("null_rows"),
        count(has_null(v)).alias("null_elements"),
        count(has_non_finite(v)).alias("non_finite"),
        count(whole & ~has_non_finite(v) & (norm_sq(v) <= ZERO_NORM_SQ)).alias("zero_norm"),
        F.coalesce(F.min(F.size(v)), F.lit(0)).alias("min_dims"),
        F.coalesce(F.max(F.size(v)), F.lit(0)).alias("max_dims"),
    ]


@dataclass(frozen=True)
class IdProfile:
    known: int
    distinct: int | None


def profile(df: DataFrame, vec_col: str, id_col: str | None = None, distinct: bool = False) -> VectorProfile | tuple[VectorProfile, IdProfile]:
    """One aggregate; with ``id_col`` also how many ids are known, and how many of them are distinct if asked for."""
    ids = [F.count(id_col).alias("known")] if id_col else []
    if distinct:
        ids.append(F.count_distinct(F.col(id_col)).alias("distinct"))
    found = df.agg(*profile_columns(F.col(vec_col)), *ids).first().asDict()
    if not id_col:
        return VectorProfile(**found)
    known, different = found.pop("known"), found.pop("distinct", None)
    return VectorProfile(**found), IdProfile(known, different)


def check_type(df: DataFrame, vec_col: str) -> None:
    if vec_col not in df.columns:
        raise UnsupportedColumnType(f"no column {vec_col!r}")
    kind = df.schema[vec_col].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.NumericType):
        raise UnsupportedColumnType(f"{vec_col} is {kind.simpleString()}, not an array of numbers")


def check(found: VectorProfile, normalized: bool) -> None:
    """Raise what is wrong with indexed rows: shape first, then values."""
    if found.rows == 0:
        raise ShapeMismatch(0, found.max_dims)
    if found.null_rows or found.null_elements:
        raise NullValues(f"{found.null_rows} null rows, {found.null_elements} rows with null elements")
    if found.min_dims != found.max_dims:
        raise InconsistentDims(found.min_dims, found.max_dims)
    if found.max_dims == 0:
        raise ShapeMismatch(found.rows, 0)
    if found.non_finite:
        raise NonFiniteInput(f"{found.non_finite} rows with NaN or infinite elements")
    if found.zero_norm and not normalized:
        raise ZeroNorm(f"{found.zero_norm} rows of zero length")


def check_queries(found: VectorProfile, dims: int, normalized: bool) -> None:
    if found.rows and not found.null_rows and {found.min_dims, found.max_dims} != {dims}:
        raise QueryDimensionMismatch(dims, found.min_dims if found.min_dims != dims else found.max_dims)
    check(found, normalized)
