"""Quality of an approximate result (qid, rank, row_id, similarity) against the exact one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(exact: DataFrame, approx: DataFrame) -> DataFrame:
    """For each query of ``exact``: overlap, top1_match, ndcg, rank_mae, overlap_mae, top1_delta, mean similarities.

    Overlap is the share of exact ids found. nDCG gains are exact similarities, 0 for other ids, discounted
    by log2(rank + 1). rank_mae compares similarities rank by rank, overlap_mae those of shared ids.
    """
    e = exact.select("qid", F.col("rank").alias("e_rank"), "row_id", F.col("similarity").alias("e_sim"))
    a = approx.select("qid", F.col("rank").alias("a_rank"), "row_id", F.col("similarity").alias("a_sim"))
    log_rank = lambda c: F.log2(F.col(c) + 1.0)
    ideal = e.groupBy("qid").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("e_sim") / log_rank("e_rank")).alias("ideal"), F.avg("e_sim").alias("exact_mean"), F.max(F.when(F.col("e_rank") == 1, F.col("e_sim"))).alias("e_top"))
    shared = e.join(a, ["qid", "row_id"]).groupBy("qid").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("e_sim") / log_rank("a_rank")).alias("gain"),
        F.avg(F.abs(F.col("e_sim") - F.col("a_sim"))).alias("overlap_mae"),
        F.max(((F.col("e_rank") == 1) & (F.col("a_rank") == 1)).cast("int")).alias("top"),
    )
    by_rank = e.join(a.select("qid", F.col("a_rank").alias("e_rank"), "a_sim"), ["qid", "e_rank"]).groupBy("qid").agg(
        F.avg(F.abs(F.col("e_sim") - F.col("a_sim"))).alias("rank_mae"), F.avg("a_sim").alias("approx_mean"), F.max(F.when(F.col("e_rank") == 1, F.abs(F.col("e_sim") - F.col("a_sim")))).alias("top1_delta")
    )
    joined = ideal.join(shared, "qid", "left").join(by_rank, "qid", "left")
    return joined.select(
        "qid",
        (F.coalesce("n", F.lit(0)) / F.col("k")).alias("overlap"),
        F.coalesce("top", F.lit(0)).alias("top1_match"),
        F.when(F.col("ideal") > 0, F.coalesce("gain", F.lit(0.0)) / F.col("ideal")).otherwise(F.lit(0.0)).alias("ndcg"),
        "rank_mae",
        "overlap_mae",
        "top1_delta",
        "exact_mean",
        "approx_mean",
    )


def summary(exact: DataFrame, approx: DataFrame) -> DataFrame:
    """One row: means over the queries, and the least overlap."""
    q = per_query(exact, approx)
    means = [F.avg(c).alias(f"mean_{c}") for c in q.columns if c != "qid"]
    return q.agg(F.count(F.lit(1)).alias("queries"), F.min("overlap").alias("min_overlap"), *means)
