"""Exact cosine top-k: every query against every row, ranked by similarity, then row id.

Two physical forms give the same rows. ``knn_sql`` is pure column expressions, for few queries (a row for each pair). ``knn_arrow`` multiplies
blocks of queries with blocks of rows and merges what tasks find (see ``grid``), for any number of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidTopK
from ..functions.vectors import dot, l2_normalize
from .grid import WIDE, grid_top, ranked_by_query, write_queries

#: Rows of a table that is broadcast, and queries whose pairs with all rows are made by expressions.
FEW_ROWS, FEW_QUERIES = 20_000, 32


def unit(df: DataFrame, vec_col: str, normalized: bool) -> DataFrame:
    """``vec_col`` as unit vectors; left alone if ``normalized``."""
    return df if normalized else df.withColumn(vec_col, l2_normalize(F.col(vec_col)))


def rank_top(scored: DataFrame, k: int) -> DataFrame:
    """The first k rows of each qid: similarity descending, row_id ascending."""
    order = Window.partitionBy("qid").orderBy(F.desc("similarity"), F.asc("row_id"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("qid", "rank", "row_id", "similarity")


def knn_sql(matrix: DataFrame, queries: DataFrame, k: int, normalized: bool = False) -> DataFrame:
    """``matrix`` (row_id, vec) and ``queries`` (qid, qvec): up to FEW_QUERIES by expressions only, more by blocks."""
    if k < 1:
        raise InvalidTopK(k)
    asked = unit(queries.select("qid", "qvec"), "qvec", normalized)
    if not few(asked, min(FEW_QUERIES, FEW_ROWS)):
        return knn_arrow(matrix, queries.select("qid", "qvec"), k, matrix.select(F.size("vec")).first()[0], normalized)
    both = unit(matrix.select("row_id", "vec"), "vec", normalized).crossJoin(F.broadcast(asked))
    scored = both.select("qid", "row_id", dot(F.col("vec"), F.col("qvec")).alias("similarity"))
    return rank_top(scored, k)


def few(rows: DataFrame, most: int | None = None) -> bool:
    """Whether a table has at most so many rows, by default so many as may be broadcast. Reads no more than these."""
    most = FEW_ROWS if most is None else most
    return rows.limit(most + 1).count() <= most


def single_top(matrix: DataFrame, query: list[float], k: int, normalized: bool = False) -> DataFrame:
    """One query as a literal: Spark takes the ordered limit in each task first."""
    if k < 1:
        raise InvalidTopK(k)
    q = np.asarray(query, np.float64)
    q = q if normalized else q / np.linalg.norm(q)
    vec = F.col("vec") if normalized else l2_normalize(F.col("vec"))
    scored = matrix.select("row_id", dot(vec, F.array(*[F.lit(float(x)) for x in q])).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), F.asc("row_id")).limit(k)


def knn_arrow(matrix: DataFrame, queries: DataFrame, k: int, dims: int, normalized: bool = False, asked: int | None = None, rows: int | None = None) -> DataFrame:
    """``matrix`` (row_id, vec) and any number of ``queries`` (qid, qvec); ``rows`` and ``asked`` of them if that is known."""
    if k < 1:
        raise InvalidTopK(k)
    asked = queries.count() if asked is None else asked
    if k >= WIDE:
        rows = matrix.count() if rows is None else rows
        return ranked_by_query(matrix, queries, rows, asked, dims, min(k, max(1, rows)), normalized)
    path = write_queries(queries, asked, dims, k, normalized)
    return grid_top(matrix, path, k, normalized)
