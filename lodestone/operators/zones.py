"""Exact search that leaves out zones of rows: zone maps of vectors and the triangle inequality.

A zone is a list of rows that are stored together. Its map holds a pivot, the mean of its vectors, and a radius, the largest
distance of a row from it. A row of the zone is no nearer to a query than the pivot's distance less the radius, which bounds
its similarity. A search first looks into each query's most promising zones; the k-th score found there is the
bound for all others, and only zones that can reach it are read. Rows that tie with the k-th are in
such zones too, so the result is that of a full scan.

The map has a row for each zone, is written to the shared folder and read by tasks, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared
from ..errors import InvalidTopK
from .grid import write_queries
from .knn import rank_top
from .probing import BLOCKS, packed_by_list, scan, stored
from .topk import RunningTop, stack

#: Zones that a query looks into first, at least, and what bounds are widened by for rounding.
FIRST, ROUNDING = 2, 1e-9
ZONES = 4096


def zone_means(rows: DataFrame) -> DataFrame:
    """(list, n, pivot) of rows (row_id, vec, list): sums of each task's runs first, then of each zone."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m, lists = stack(batch.column(0)), batch.column(1).to_numpy()
            order = np.argsort(lists, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(lists[order]) != 0))
            sums = np.add.reduceat(m[order], first)
            n = np.diff(np.append(first, len(lists)))
            yield pa.RecordBatch.from_arrays([pa.array(lists[order[first]].astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(list(sums), pa.list_(pa.float64()))], names=["list", "n", "sums"])

    def total(table: pa.Table) -> pa.Table:  # a row for each batch that met the zone
        n = int(pc.sum(table.column("n")).as_py())
        mean = stack(table.column("sums").combine_chunks()).sum(axis=0) / n
        return pa.table({"list": table.column("list").slice(0, 1), "n": pa.array([n]), "pivot": pa.array([mean], pa.list_(pa.float64()))})

    parts = rows.select("vec", F.col("list").cast("long").alias("list")).mapInArrow(partial, "list long, n long, sums array<double>")
    return parts.groupBy("list").applyInArrow(total, "list long, n long, pivot array<double>")


def zone_map(rows: DataFrame) -> DataFrame:
    """(list, n, pivot, radius), written to the shared folder in order of the zones."""
    means = shared.new_path(rows.sparkSession, "zone-means")
    zone_means(rows).repartitionByRange("list").sortWithinPartitions("list").write.parquet(means)

    def radius(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.table(means)
        for batch in batches:
            if not batch.num_rows:
                continue
            m, lists = stack(batch.column(0)), batch.column(1).to_numpy()
            wanted = (pc.field("list") >= int(lists.min())) & (pc.field("list") <= int(lists.max()))
            for part in table.to_batches(filter=wanted, columns=["list", "pivot"]):
                for number, pivot in zip(part.column(0).to_pylist(), stack(part.column(1)), strict=True):
                    at = np.flatnonzero(lists == number)
                    if len(at):
                        far = np.sqrt(((m[at] - pivot) ** 2).sum(axis=1).max())
                        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([far])], names=["list", "radius"])

    far = rows.select("vec", F.col("list").cast("long").alias("list")).mapInArrow(radius, "list long, radius double").groupBy("list").agg(F.max("radius").alias("radius"))
    pivots = rows.sparkSession.read.schema("list long, n long, pivot array<double>").parquet(means)
    return shared.written(pivots.join(far, "list").select("list", "n", "pivot", "radius").repartitionByRange("list").sortWithinPartitions("list"), "zones")


def _zones(path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(zones, rows, pivots, radii) by blocks of ZONES; for tasks."""
    for part in shared.table(path).to_batches(columns=["list", "n", "pivot", "radius"], batch_size=ZONES):
        if part.num_rows:
            yield part.column(0).to_numpy(), part.column(1).to_numpy(), stack(part.column(2)), part.column(3).to_numpy()


def reach(q: np.ndarray, pivots: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The most that a row of each zone can be similar to each unit query."""
    apart = np.sqrt(np.maximum(1 - 2 * q @ pivots.T + np.einsum("ij,ij->i", pivots, pivots), 0))
    return 1 - np.maximum(apart - radii, 0) ** 2 / 2 + ROUNDING


@dataclass
class ZoneIndex:
    """``rows``: row_id, unit vec, list, in order of the lists; ``zones``: path of their map."""

    rows: DataFrame
    zones: str
    dims: int

    @classmethod
    def build(cls, rows: DataFrame, dims: int, in_order: bool = False) -> ZoneIndex:
        """``rows``: row_id, unit vec, and list, what is near together; stored anew unless ``in_order``."""
        rows = rows.select(F.col("row_id").cast("long").alias("row_id"), "vec", F.col("list").cast("long").alias("list"))
        rows = rows if in_order else stored(rows, "zone-rows")
        return cls(rows, zone_map(rows).inputFiles()[0].rsplit("/", 1)[0], dims)

    @property
    def map(self) -> DataFrame:
        return self.rows.sparkSession.read.schema("list long, n long, pivot array<double>, radius double").parquet(self.zones)

    def first_zones(self, path: str, k: int) -> DataFrame:
        """(qid, list): for each written query its zones of the highest reach, FIRST and as many as hold k rows."""
        zones = self.zones

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, ids, vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    qids = np.frombuffer(ids, np.int64)
                    q = np.frombuffer(vectors).reshape(len(qids), -1)
                    best, sizes = RunningTop(len(qids), max(FIRST, k)), {}
                    for numbers, n, pivots, radii in _zones(zones):
                        best.add(q @ pivots.T, numbers)  # nearness of the pivot: a wide zone reaches far and promises little
                        sizes |= dict(zip(numbers.tolist(), n.tolist(), strict=True))
                        sizes = {z: sizes[z] for z in np.unique(best.ids).tolist()}
                    held = np.vectorize(sizes.get, otypes=[np.int64])(best.ids)
                    before = np.cumsum(held, axis=1) - held
                    take = (before < k) | (np.arange(held.shape[1]) < FIRST)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, take.sum(axis=1))), pa.array(best.ids[take])], names=["qid", "list"])

        return self.rows.sparkSession.read.schema(BLOCKS).parquet(path).mapInArrow(run, "qid long, list long")

    def other_zones(self, path: str, bounds: DataFrame) -> DataFrame:
        """(qid, list): all zones that can reach each query's bound (qid, similarity); without a bound, all zones."""
        spark, zones = self.rows.sparkSession, self.zones
        known = shared.new_path(spark, "bounds")
        bounds.repartitionByRange("qid").sortWithinPartitions("qid").write.parquet(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = shared.table(known)
            for batch in batches:
                for _, ids, vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    qids = np.frombuffer(ids, np.int64)
                    q = np.frombuffer(vectors).reshape(len(qids), -1)
                    found = table.to_table(filter=pc.field("qid").isin(pa.array(qids)), columns=["qid", "similarity"])
                    least = dict(zip(found.column("qid").to_pylist(), found.column("similarity").to_pylist(), strict=True))
                    bound = np.array([least.get(i, -np.inf) for i in qids.tolist()])[:, None]
                    for numbers, _, pivots, radii in _zones(zones):
                        who, which = np.nonzero(reach(q, pivots, radii) >= bound)
                        yield pa.RecordBatch.from_arrays([pa.array(qids[who]), pa.array(numbers[which])], names=["qid", "list"])

        return spark.read.schema(BLOCKS).parquet(path).mapInArrow(run, "qid long, list long")

    def _both(self, queries: DataFrame, k: int, normalized: bool, asked: int | None) -> tuple[DataFrame, DataFrame, DataFrame, str]:
        """First zones, their scores, zones after them, and the queries' path."""
        if k < 1:
            raise InvalidTopK(k)
        path = write_queries(queries, queries.count() if asked is None else asked, self.dims, k, normalized)
        first = shared.written(self.first_zones(path, k), "first-zones")
        found = shared.written(scan(self.rows, packed_by_list(first, path, self.dims, k), k), "first-scores")
        bounds = rank_top(found, k).filter(F.col("rank") == k).select("qid", "similarity")
        more = shared.written(self.other_zones(path, bounds).join(first, ["qid", "list"], "left_anti"), "other-zones")
        return first, found, more, path

    def search(self, queries: DataFrame, k: int, normalized: bool = False, asked: int | None = None) -> DataFrame:
        """(qid, rank, row_id, similarity) of the best k rows of each query (qid, qvec)."""
        _, found, more, path = self._both(queries, k, normalized, asked)
        rest = scan(self.rows, packed_by_list(more, path, self.dims, k), k)
        return rank_top(found.unionByName(rest), k)

    def reads(self, queries: DataFrame, k: int, normalized: bool = False) -> DataFrame:
        """(qid, zones_read, rows_read, zones, rows): what a search reads for each query, of all."""
        first, _, more, _ = self._both(queries, k, normalized, None)
        every = self.map.agg(F.count(F.lit(1)).alias("zones"), F.sum("n").alias("rows"))  # one row
        asks = first.unionByName(more).join(self.map.select("list", "n"), "list")
        each = asks.groupBy("qid").agg(F.count(F.lit(1)).alias("zones_read"), F.sum("n").alias("rows_read"))
        return each.crossJoin(F.broadcast(every))
