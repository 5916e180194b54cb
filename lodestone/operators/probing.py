"""Ranking the rows of lists for the queries that ask for them: queries packed by list, rows stored by list.

Rows are (row_id, vec, list), unit vectors, stored by :func:`stored`. Neither side is collected: packs are files of the shared folder, of
which a task reads those for the lists that its rows are in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared
from .grid import best_of, listed_blocks, rows_per_block
from .knn import FEW_ROWS
from .topk import RunningTop

#: A pack is this part of a query block, about 1 MB; bytes of packs that a task reads at once.
PACKS, GROUP_BYTES = 8, 16 << 20
#: Lists that a filter names one by one.
NAMED = 1000
SCORED = "qid long, row_id long, similarity double"
BLOCKS = "block long, qids binary, vectors binary"


def stored(rows: DataFrame, tag: str) -> DataFrame:
    """Rows in order of their list, in files of about equal size: a list with half of all rows takes half of the files.

    Within a list, rows are dealt by the hash of their id and then stand by id.
    """
    ordered = rows.select("row_id", "vec", "list").repartitionByRange("list", F.xxhash64("row_id")).sortWithinPartitions("list", "row_id")
    return shared.written(ordered, tag)


def scored(qids: np.ndarray, top: RunningTop) -> pa.RecordBatch:
    live = np.isfinite(top.scores)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, live.sum(axis=1))), pa.array(top.ids[live]), pa.array(top.scores[live])], names=["qid", "row_id", "similarity"])


def packed_by_list(asks: DataFrame, path: str, dims: int, k: int) -> str:
    """``asks`` (qid, list) with the vectors of the queries written at ``path``, packed by list, in order of the lists; gives the packs' path."""
    spark, size = asks.sparkSession, max(1, rows_per_block(dims, k) // PACKS)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                width = len(vectors) // (len(ids) // 8)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)), pa.array([vectors[at : at + width] for at in range(0, len(vectors), width)])], names=["qid", "q"])

    def row(number: int, ids: list[int], vectors: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([b"".join(vectors)])], names=["list", "qids", "vectors"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors = None, [], []
        for batch in batches:
            for number, qid, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != now or len(ids) >= size:
                    if ids:
                        yield row(now, ids, vectors)
                    now, ids, vectors = number, [], []
                ids.append(qid)
                vectors.append(q)
        if ids:
            yield row(now, ids, vectors)

    queries = spark.read.schema(BLOCKS).parquet(path).select("qids", "vectors").mapInArrow(unpack, "qid long, q binary")
    to = shared.new_path(spark, "asks")
    joined = asks.select("qid", "list").join(queries, "qid").select("list", "qid", "q")
    joined.repartitionByRange("list", F.xxhash64("qid")).sortWithinPartitions("list").mapInArrow(pack, "list long, qids binary, vectors binary").write.option("parquet.block.size", GROUP_BYTES).option("parquet.block.size.row.check.min", 1).parquet(to)
    return to


def asked_rows(rows: DataFrame, packs: str) -> DataFrame:
    """Rows of the lists that are asked for, by a filter that reaches the scan where these are few."""
    met = rows.sparkSession.read.schema("list long").parquet(packs).distinct()
    some = [r.list for r in met.limit(FEW_ROWS + 1).collect()]
    if len(some) <= NAMED:
        return rows.filter(F.col("list").isin(some))
    if len(some) <= FEW_ROWS:
        return rows.filter(F.col("list").between(min(some), max(some))).join(F.broadcast(met), "list", "left_semi")
    return rows


def scan(rows: DataFrame, packs: str, k: int) -> DataFrame:
    """SCORED: the best k rows of each asked list for each query that asks for it, by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, m, numbers in listed_blocks(batches):
            order = np.argsort(numbers, kind="stable")
            ordered = numbers[order]
            wanted = (pc.field("list") >= int(numbers.min())) & (pc.field("list") <= int(numbers.max()))
            for part in shared.batches(packs, where=wanted):
                for number, of, vectors in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    at = order[np.searchsorted(ordered, number, "left") : np.searchsorted(ordered, number, "right")]
                    if len(at):
                        qids = np.frombuffer(of, np.int64)
                        yield scored(qids, best_of(np.frombuffer(vectors).reshape(len(qids), -1), ids[at], m[at], k))

    return asked_rows(rows, packs).select("row_id", "vec", "list").mapInArrow(run, SCORED)
