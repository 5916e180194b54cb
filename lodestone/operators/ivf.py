"""Approximate search: spherical k-means clusters, probing, and exact ranking of the probed rows.

The index is two tables: centroids (cluster, cvec), at most ``MAX_LISTS`` rows, and assigned (row_id, vec,
cluster), as large as the input. Seeding, assignment and updates are passes over all rows with small partial
results. Queries are read by tasks, block by block, as for an exact search. ``tree`` has lists that grow with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidTopK
from ..functions.vectors import dot
from .. import shared
from .grid import FAN, PACKED, _packed, best_of, listed_blocks, merged, query_blocks, write_queries
from .knn import few, knn_arrow, rank_top, unit
from .probing import packed_by_list, scan
from .seeding import mean_vector, seed_centroids
from .topk import NEAREST, RunningTop, nearest, normalise_rows, stack

# Fixed values of the method.
MIN_ROWS, MIN_LISTS, MAX_LISTS = 256, 16, 512
ROUNDS = 12
FLOOR_ROWS_PER_K = 40
UNSCALED_NORM_SQ = 1e-30

#: Rows asked to measure how many probes a recall takes, and what the measured recall must exceed the wanted one by.
RECALL_ROWS, RECALL_MARGIN = 64, 0.03


def list_count(rows: int) -> int:
    """Clusters for so many rows: 1 below MIN_ROWS, else the square root, within bounds."""
    return 1 if rows < MIN_ROWS else min(max(math.isqrt(rows), MIN_LISTS), MAX_LISTS)


def probe_count(lists: int, k: int, rows: int) -> int:
    """Clusters to look into: 4, 6 or 8 % by k, enough for FLOOR_ROWS_PER_K rows of average lists for each result."""
    percent = 8 if k >= 50 else 6 if k >= 20 else 4
    average = max(rows // max(lists, 1), 1)
    wanted = max(-(-lists * percent // 100), -(-FLOOR_ROWS_PER_K * k // average))
    return min(max(wanted, 1), max(lists, 1))


def speeds_up(rows: int, lists: int) -> bool:
    return rows >= MIN_ROWS and lists >= 4


def list_count_column(rows: F.Column) -> F.Column:
    root = F.floor(F.sqrt(rows.cast("double"))).cast("int")
    return F.when(rows < MIN_ROWS, F.lit(1)).otherwise(F.greatest(F.lit(MIN_LISTS), F.least(F.lit(MAX_LISTS), root)))


def probe_count_column(lists: F.Column, k: F.Column, rows: F.Column) -> F.Column:
    percent = F.when(k >= 50, F.lit(8)).when(k >= 20, F.lit(6)).otherwise(F.lit(4))
    average = F.greatest(F.floor(rows / lists), F.lit(1))
    wanted = F.greatest(F.ceil(lists * percent / 100), F.ceil(k * FLOOR_ROWS_PER_K / average))
    return F.least(F.greatest(wanted, F.lit(1)), lists).cast("int")


def medoid(matrix: DataFrame, dims: int) -> DataFrame:
    """The row (row_id, similarity) with the largest inner product with the mean; the lowest id on ties."""
    mean = F.array(*[F.lit(float(x)) for x in mean_vector(matrix, dims)])
    scored = matrix.select("row_id", dot(F.col("vec"), mean).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "row_id").limit(1)


def assign(matrix: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add ``cluster``: the nearest centroid, the lowest number on ties."""
    shared = matrix.sparkSession.sparkContext.broadcast(centroids)  # MAX_LISTS rows
    at = matrix.columns.index("vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            best = nearest(stack(batch.column(at)), c)[0] if batch.num_rows else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int32))], names=[*batch.schema.names, "cluster"])

    return matrix.mapInArrow(run, T.StructType([*matrix.schema.fields, T.StructField("cluster", T.IntegerType())]))


def update(matrix: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: assign, sum each cluster, scale to unit length. Empty clusters become zero vectors."""
    lists, dims = centroids.shape
    shared = matrix.sparkSession.sparkContext.broadcast(centroids)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sums, counts = shared.value, np.zeros((lists, dims)), np.zeros(lists, np.int64)
        for batch in batches:
            if batch.num_rows:
                m = stack(batch.column(0))
                best = nearest(m, c)[0]
                order = np.argsort(best, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(best[order]) > 0))
                sums[best[order[first]]] += np.add.reduceat(m[order], first)
                counts += np.bincount(best, minlength=lists)
        some = np.flatnonzero(counts)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.float64()))], names=["cluster", "n", "sums"])

    def total(table: pa.Table) -> pa.Table:  # a row for each task that met the cluster
        sums = stack(table.column("sums").combine_chunks()).sum(axis=0) / max(1, int(table.column("n").to_numpy().sum()))
        return pa.table({"cluster": table.column("cluster").slice(0, 1), "mean": pa.array([sums], pa.list_(pa.float64()))})

    parts = matrix.select("vec").mapInArrow(partial, "cluster int, n long, sums array<double>")
    out = np.zeros((lists, dims))
    table = parts.groupBy("cluster").applyInArrow(total, "cluster int, mean array<double>").toArrow()  # MAX_LISTS rows
    if table.num_rows:
        out[table.column("cluster").to_numpy()] = stack(table.column("mean").combine_chunks())
    length = np.einsum("ij,ij->i", out, out)
    scaled = length > UNSCALED_NORM_SQ
    out[scaled] /= np.sqrt(length[scaled])[:, None]
    return out


def histogram(assigned: DataFrame) -> DataFrame:
    """cluster, rows, and where its rows begin in cluster order."""
    counts = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"))  # MAX_LISTS rows
    before = Window.orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("begins", F.coalesce(F.sum("rows").over(before), F.lit(0).cast("long")))


#: ``monotonically_increasing_id`` is the number of the task above so many bits, and the row's place in it below them.
TASK_BITS = 33


def ranged(assigned: DataFrame) -> DataFrame:
    """Rows in ranges of (cluster, row_id), written once: ``part`` in order of the ranges, ``within`` the place in the part.

    A range may begin and end inside of a cluster, so a cluster with half of all rows is spread over many tasks.
    """
    n = F.monotonically_increasing_id()
    ordered = assigned.repartitionByRange("cluster", "row_id").sortWithinPartitions("cluster", "row_id").withColumn("__n", n)
    part, within = F.shiftright("__n", TASK_BITS), F.col("__n").bitwiseAND(F.lit((1 << TASK_BITS) - 1))
    return shared.written(ordered.select(*assigned.columns, part.alias("part"), within.alias("within")), "cluster-order")


def cluster_order(assigned: DataFrame) -> DataFrame:
    """Add ``place``: each row's place when rows of a cluster stand together, by row id; from 0, without holes.

    Places are those within a range plus the rows of the ranges before it, so no task sees a cluster whole.
    """
    rows = ranged(assigned)
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each task
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    begins = F.broadcast(counts.select("part", before.alias("begin")))
    return rows.join(begins, "part").select(*assigned.columns, (F.col("begin") + F.col("within")).alias("place"))


def probe(centroids: DataFrame, queries: DataFrame, probes: int) -> DataFrame:
    """(qid, rank, cluster, similarity): each query's nearest clusters."""
    both = queries.select("qid", "qvec").crossJoin(F.broadcast(centroids.limit(MAX_LISTS)))
    scored = both.select("qid", F.col("cluster").cast("long").alias("row_id"), dot(F.col("cvec"), F.col("qvec")).alias("similarity"))
    return rank_top(scored, probes).select("qid", "rank", F.col("row_id").cast("int").alias("cluster"), "similarity")


def candidates(assigned: DataFrame, probes: DataFrame) -> DataFrame:
    """(qid, row_id) of all rows in the probed clusters. Few probes are broadcast, so that rows are not shuffled."""
    return assigned.select("cluster", "row_id").join(_small(probes.select("qid", "cluster")), "cluster").select("qid", "row_id")


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if few(rows) else rows


def rerank(assigned: DataFrame, probes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact top k among candidates: unit queries packed by cluster, read by the tasks that have its rows, so pairs are no rows."""
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("qvec")), F.lit(1)).alias("dims")).first()
    path = write_queries(queries, size.n, size.dims, k, normalized=True)
    rows = assigned.select(F.col("row_id").cast("long").alias("row_id"), "vec", F.col("cluster").cast("long").alias("list"))
    asks = packed_by_list(probes.select("qid", F.col("cluster").cast("long").alias("list")), path, size.dims, k)
    return rank_top(scan(rows, asks, k), k)


@dataclass
class IvfIndex:
    """``centroids``: cluster by number; ``assigned``: row_id, vec (unit), cluster."""

    centroids: np.ndarray
    assigned: DataFrame
    rows: int

    @classmethod
    def train(cls, matrix: DataFrame, rows: int, dims: int) -> IvfIndex:
        """``matrix``: row_id and unit vec. Assignments are those of the round before the last update."""
        lists = list_count(rows)
        matrix = shared.written(matrix, "unit-rows")  # unit vectors are made once
        now = seed_centroids(matrix, rows, dims, lists)
        before = now
        for _ in range(ROUNDS if lists > 1 else 0):
            before, now = now, update(matrix, now)
            if np.array_equal(before, now):  # more rounds would change nothing
                break
        return cls(now, assign(matrix, before), rows)

    def list_count(self) -> int:
        return len(self.centroids)

    def centroid_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(self.centroids)], "cluster int, cvec array<double>")

    def probes_for(self, recall: float, k: int) -> int:
        """Probes that give a mean recall of ``recall`` at k, measured: exact neighbours of RECALL_ROWS rows, picked by
        the hash of their ids, and the places of the neighbours' clusters among each row's."""
        rows = self.assigned.select(F.col("row_id").cast("long").alias("row_id"), "vec", "cluster")
        picked = rows.orderBy(F.xxhash64("row_id"), "row_id").limit(RECALL_ROWS).toArrow()
        asked = self.assigned.sparkSession.createDataFrame(list(zip(picked.column("row_id").to_pylist(), picked.column("vec").to_pylist(), strict=True)), "qid long, qvec array<double>")
        exact = knn_arrow(rows, asked, k, self.centroids.shape[1], normalized=True).select("qid", "row_id")
        found = rows.select("row_id", "cluster").join(F.broadcast(exact), "row_id").toArrow()  # RECALL_ROWS x k rows
        place = np.argsort(np.argsort(-(stack(picked.column("vec").combine_chunks()) @ self.centroids.T), axis=1, kind="stable"), axis=1)
        number = {q: i for i, q in enumerate(picked.column("row_id").to_pylist())}
        places = place[[number[q] for q in found.column("qid").to_pylist()], found.column("cluster").to_numpy()]
        share = np.cumsum(np.bincount(places, minlength=len(self.centroids))) / max(1, len(places))
        enough = np.flatnonzero(share >= min(1.0, recall + RECALL_MARGIN))
        return int(enough[0]) + 1 if len(enough) else len(self.centroids)

    def search(self, queries: DataFrame, k: int, normalized: bool = False, probes: int | None = None, asked: int | None = None) -> DataFrame:
        """May return fewer than k rows for a query if its lists are short; never made-up ones."""
        if k < 1:
            raise InvalidTopK(k)
        probes = probes or probe_count(len(self.centroids), k, self.rows)
        path = write_queries(queries, queries.count() if asked is None else asked, self.centroids.shape[1], k, normalized)
        context = self.assigned.sparkSession.sparkContext
        shared_centroids = context.broadcast(self.centroids)  # MAX_LISTS rows
        rows = self.assigned.select(F.col("row_id").cast("long").alias("row_id"), "vec", "cluster")
        if probes < len(self.centroids):
            needed = self._needed(path, shared_centroids, probes)
            if len(needed) < len(self.centroids):
                rows = rows.filter(F.col("cluster").isin(needed))
        return merged(rows.mapInArrow(_probed_scorer(path, shared_centroids, probes, k), PACKED), k)

    def _needed(self, path: str, shared_centroids, probes: int) -> list[int]:
        """Lists that any query probes: MAX_LISTS at most."""
        spark = self.assigned.sparkSession

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(len(shared_centroids.value), bool)
            for batch in batches:
                for qids, vectors in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    q = np.frombuffer(vectors).reshape(len(qids) // 8, -1)
                    seen[np.unique(_nearest(q, shared_centroids.value, probes))] = True
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen).astype(np.int32))], names=["cluster"])

        blocks = spark.read.schema("block long, qids binary, vectors binary").parquet(path).select("qids", "vectors")
        return sorted(r.cluster for r in blocks.mapInArrow(run, "cluster int").distinct().collect())

    def save(self, path: str) -> None:
        """Assigned rows partitioned by cluster, so that a search reads the probed ones only."""
        spark = self.assigned.sparkSession
        self.centroid_table(spark).write.mode("overwrite").parquet(f"{path}/centroids")
        self.assigned.repartition("cluster").write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/assigned")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IvfIndex:
        table = spark.read.parquet(f"{path}/centroids").toArrow().sort_by("cluster")
        assigned = spark.read.parquet(f"{path}/assigned")
        return cls(stack(table.column("cvec").combine_chunks()), assigned, assigned.count())


def _nearest(q: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each query, the lowest numbers on ties."""
    out = np.empty((len(q), min(n, len(centroids))), np.int32)
    step = max(1, NEAREST // max(1, len(centroids)))
    for at in range(0, len(q), step):
        out[at : at + step] = np.argsort(-(q[at : at + step] @ centroids.T), axis=1, kind="stable")[:, :n]
    return out


def _probed_scorer(path: str, shared_centroids, probes: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, part = shared_centroids.value, TaskContext.get().partitionId() % FAN
        for ids, m, cluster in listed_blocks(batches):
            order = np.argsort(cluster, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(cluster[order]) > 0))
            for block, qids, q in query_blocks(path):
                picked = np.zeros((len(q), len(centroids)), bool)
                np.put_along_axis(picked, _nearest(q, centroids, probes), True, axis=1)
                top = RunningTop.empty(len(q), k)
                for rows in np.split(order, first[1:]):
                    who = np.flatnonzero(picked[:, cluster[rows[0]]])
                    if len(who):
                        top.merge_some(who, best_of(q[who], ids[rows], m[rows], k))
                if np.isfinite(top.scores).any():
                    yield _packed(block, part, qids, top)

    return run


def prepare(matrix: DataFrame, normalized: bool) -> DataFrame:
    return unit(matrix.select("row_id", "vec"), "vec", normalized)


__all__ = ["IvfIndex", "assign", "candidates", "cluster_order", "histogram", "list_count", "medoid", "normalise_rows", "prepare", "probe", "probe_count", "rerank", "seed_centroids", "update"]
