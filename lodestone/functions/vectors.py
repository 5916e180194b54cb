"""Vector functions as column expressions, evaluated in DOUBLE inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def as_floats(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("float"))


def dot(a: Column, b: Column) -> Column:
    """Inner product; null where lengths differ or an element is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, t: s + t)


def norm_sq(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def l2_norm(v: Column) -> Column:
    return F.sqrt(norm_sq(v))


def l2_normalize(v: Column) -> Column:
    """The vector divided by its length."""
    length = l2_norm(v)
    return F.transform(v, lambda x: x.cast("double") / length)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (l2_norm(a) * l2_norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    """For unit vectors; never below 0."""
    return F.greatest(1 - dot(a, b), F.lit(0.0))


def pad(v: Column, multiple: int = 8) -> Column:
    """Zeros appended up to a multiple of ``multiple`` elements."""
    missing = F.pmod(-F.size(v), F.lit(multiple))
    return F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), missing))


def has_non_finite(v: Column) -> Column:
    return F.exists(v, lambda x: F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))


def has_null(v: Column) -> Column:
    return F.exists(v, lambda x: x.isNull())


def vector_from_columns(*columns: str) -> Column:
    """One FLOAT vector from numeric columns."""
    return F.array(*[F.col(c).cast("float") for c in columns])


_SQL = {
    "vec_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, t) -> s + t)"),
    "vec_norm": ("a ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"),
    "vec_unit": ("a ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "transform(a, x -> x / sqrt(aggregate(a, 0D, (s, y) -> s + y * y)))"),
    "vec_cosine": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>",
        "DOUBLE",
        "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, t) -> s + t) / sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x))",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Make vec_dot, vec_norm, vec_unit and vec_cosine callable in this session's SQL."""
    for name, (args, kind, body) in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(_SQL)
