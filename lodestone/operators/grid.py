"""Exact top k for any number of queries and rows: a grid of query blocks by row blocks.

Queries are packed into blocks of bounded size and written to the shared folder once; they are never fetched to the driver
or broadcast. Each task of the matrix's one scan takes its rows in blocks too, reads the query blocks one after the
other and keeps the best k rows of each query, so it holds one block of either side. What it found is one packed row
for each query block. These are merged in a tree: first those of every ``FAN``-th task, then the rest. Merges
stream, a packed row at a time.

A task sends k rows a query and row block, whatever the block's size. A lost task reads its blocks again.

Where k is large, what tasks find is about as large as all pairs. Then the grid is read the other way: rows are the written
blocks, and each task ranks all of them for its own queries, so that no pair is shuffled (``ranked_by_query``). The blocks are
the only thing it puts on disk: one copy of the rows, in the type they have. A long ranking is made in pieces, so that a task
holds PIECE rows of it, however many there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shared
from .topk import RunningTop, column_products, lengths, normalise_rows, paired_products, ranking, stack

#: Bytes of a query block's vectors, or of its best rows if these are more; and of a row block.
QUERY_BYTES, ROW_BYTES = 8 << 20, 64 << 20
#: Queries and scores of one multiplication: 8 MB.
QUERY_TILE, SCORES = 1024, 1 << 20
#: From this k on, tasks rank all rows for their own queries; rows of one query's ranking, and bytes of all scores, that they hold at once.
WIDE, PIECE, RANKED_BYTES = 4096, 1 << 20, 32 << 20
#: Tasks that rankings are dealt to, if there are so many queries; rows of a batch of them: 7 MB.
RANKERS, RANKED_ROWS = 64, 1 << 18
#: Groups of tasks whose finds are merged first.
FAN = 64
PACKED = "block long, part int, qids binary, ids binary, scores binary"
RANKED = "qid long, rank int, row_id long, similarity double"


def rows_per_block(dims: int, k: int) -> int:
    return max(1, QUERY_BYTES // max(8 * dims, 16 * k, 1))


def filled(batches: Iterator[pa.RecordBatch], rows: int, dtype: type = np.float64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of ``rows`` rows each, the last of fewer; batches: id, vector."""
    ids, vectors = [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids.append(batch.column(0).to_numpy())
        vectors.append(stack(batch.column(1), dtype))
        while (held := sum(map(len, ids))) >= rows:
            n, m = np.concatenate(ids), np.concatenate(vectors)
            yield n[:rows], m[:rows]
            ids, vectors = [n[rows:]], [m[rows:]]
            if held == rows:
                break
    if sum(map(len, ids)):
        yield np.concatenate(ids), np.concatenate([v for v in vectors if len(v)])


def write_queries(queries: DataFrame, n: int, dims: int, k: int, normalized: bool) -> str:
    """Write ``queries`` (qid, qvec), ``n`` of them, as blocks; gives their path."""
    rows = rows_per_block(dims, k)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for made, (qids, q) in enumerate(filled(batches, rows)):
            unit = q if normalized else normalise_rows(q)
            yield pa.RecordBatch.from_arrays([pa.array([first + made], pa.int64()), pa.array([qids.tobytes()]), pa.array([unit.tobytes()])], names=["block", "qids", "vectors"])

    asked = queries.select(F.col("qid").cast("long").alias("qid"), F.transform("qvec", lambda x: x.cast("double")).alias("qvec"))
    path = shared.new_path(queries.sparkSession, "queries")
    asked.repartition(max(1, -(-n // rows)), "qid").mapInArrow(pack, "block long, qids binary, vectors binary").write.parquet(path)
    return path


def query_blocks(path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number, ids, unit vectors) of each block; for tasks."""
    for batch in shared.batches(path):
        for number, ids, vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            qids = np.frombuffer(ids, np.int64)
            yield number, qids, np.frombuffer(vectors).reshape(len(qids), -1)


def _packed(block: int, part: int, qids: np.ndarray, top: RunningTop) -> pa.RecordBatch:
    values = [pa.array([block], pa.int64()), pa.array([part], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (qids, top.ids, top.scores)]]
    return pa.RecordBatch.from_arrays(values, names=["block", "part", "qids", "ids", "scores"])


def best_of(q: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int) -> RunningTop:
    """A matrix product, less its rounding, tells which pairs can be among the best; these are summed in order."""
    top, held = RunningTop(len(q), k), min(k, len(m))
    parts = [_best_of(q[at : at + QUERY_TILE], ids, m, k) for at in range(0, len(q), QUERY_TILE)]
    if parts and held:
        top.scores, top.ids = np.concatenate([p.scores[:, :held] for p in parts]), np.concatenate([p.ids[:, :held] for p in parts])
    return top


def _best_of(q: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int) -> RunningTop:
    top = RunningTop(len(q), k)
    longest = np.sqrt(np.einsum("ij,ij->i", m, m).max(initial=0))
    rounding = (q.shape[1] + 2) * 2.0**-51 * np.sqrt(np.einsum("ij,ij->i", q, q)) * longest
    step = max(k, SCORES // max(1, len(q)))
    for at in range(0, len(m), step):
        rows, numbers, bar = m[at : at + step], ids[at : at + step], top.bar()
        scores = q @ rows.T
        near = scores >= (bar - rounding)[:, None]
        if len(rows) > k and np.count_nonzero(near) > 4 * k * len(q):
            bar = np.maximum(bar, np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k])
            near = scores >= (bar - rounding)[:, None]
        who, which = np.nonzero(near)
        if len(who):
            n = np.bincount(who, minlength=len(q))
            place = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
            found, of = np.full((len(q), n.max()), -np.inf), np.zeros((len(q), n.max()), np.int64)
            found[who, place], of[who, place] = paired_products(q, rows, who, which), numbers[which]
            top.merge(found, of)
    return top


def row_blocks(batches: Iterator[pa.RecordBatch], normalized: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of ROW_BYTES at most, about."""
    ids, vectors, size = [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        m = stack(batch.column(1))
        ids.append(batch.column(0).to_numpy())
        vectors.append(m if normalized else normalise_rows(m))
        size += m.nbytes
        if size >= ROW_BYTES:
            yield np.concatenate(ids), np.concatenate(vectors)
            ids, vectors, size = [], [], 0
    if ids:
        yield np.concatenate(ids), np.concatenate(vectors)


def listed_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors, lists) of row blocks; batches: row_id, unit vec, list."""
    lists: list[np.ndarray] = []

    def noted() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists.append(batch.column(2).to_numpy())
            yield batch

    for ids, m in row_blocks(noted(), normalized=True):
        yield ids, m, np.concatenate(lists)
        lists.clear()


def _scorer(path: str, k: int, normalized: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() % FAN
        for ids, m in row_blocks(batches, normalized):
            for block, qids, q in query_blocks(path):
                yield _packed(block, part, qids, best_of(q, ids, m, k))

    return run


def _merger(k: int, finish: Callable[[int, int, np.ndarray, RunningTop], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merges packed rows that stand together by (block, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, qids, top = None, None, None
        for batch in batches:
            for block, part, of, ids, scores in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (block, part):
                    if now is not None:
                        yield from finish(*now, qids, top)
                    now, qids = (block, part), np.frombuffer(of, np.int64)
                    top = RunningTop(len(qids), k)
                top.merge(np.frombuffer(scores).reshape(len(qids), -1), np.frombuffer(ids, np.int64).reshape(len(qids), -1))
        if now is not None:
            yield from finish(*now, qids, top)

    return run


def _ranked(block: int, part: int, qids: np.ndarray, top: RunningTop) -> Iterator[pa.RecordBatch]:
    width = top.ids.shape[1]
    step = max(1, (1 << 18) // max(1, width))
    for at in range(0, len(qids), step):
        live = np.isfinite(top.scores[at : at + step])
        rank = np.broadcast_to(np.arange(1, width + 1, dtype=np.int32), live.shape)
        qid = np.repeat(qids[at : at + step], live.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(rank[live]), pa.array(top.ids[at : at + step][live]), pa.array(top.scores[at : at + step][live])], names=["qid", "rank", "row_id", "similarity"])


def merged(parts: DataFrame, k: int) -> DataFrame:
    """(qid, rank, row_id, similarity) from PACKED rows."""
    def once(block: int, part: int, qids: np.ndarray, top: RunningTop) -> Iterator[pa.RecordBatch]:
        yield _packed(block, 0, qids, top)

    by_part = parts.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(_merger(k, once), PACKED)
    return by_part.repartition("block").sortWithinPartitions("block").mapInArrow(_merger(k, _ranked), RANKED)


def grid_top(matrix: DataFrame, path: str, k: int, normalized: bool = False) -> DataFrame:
    """The best k rows of ``matrix`` (row_id, vec) for each query written at ``path``."""
    rows = matrix.select(F.col("row_id").cast("long").alias("row_id"), "vec")
    return merged(rows.mapInArrow(_scorer(path, k, normalized), PACKED), k)


def _kept(matrix: DataFrame) -> type:
    """The type in which the elements of ``vec`` are stored."""
    return np.float32 if matrix.schema["vec"].dataType.elementType == T.FloatType() else np.float64


def row_columns(matrix: DataFrame, rows: int, dims: int, normalized: bool) -> DataFrame:
    """The ``rows`` rows of ``matrix`` (row_id, vec) as blocks: ids, lengths unless ``normalized``, and the vectors, one element of all after the other.

    FLOAT elements stay FLOAT. Partitions are put together, so that blocks are full, but no row is shuffled.
    """
    size, dtype = rows_per_block(dims, 1), _kept(matrix)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, m in filled(batches, size, dtype):
            columns = np.ascontiguousarray(m.T)
            scale = b"" if normalized else lengths(columns).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (ids.tobytes(), scale, columns.tobytes())], names=["ids", "lengths", "vectors"])

    vec = F.col("vec") if dtype is np.float32 else F.transform("vec", lambda x: x.cast("double"))
    packed = matrix.select(F.col("row_id").cast("long").alias("row_id"), vec.alias("vec"))
    return packed.coalesce(max(1, -(-rows // size))).mapInArrow(pack, "ids binary, lengths binary, vectors binary")


def write_rows(blocks: DataFrame) -> str:
    """Write ``row_columns``, a row group each; gives their path."""
    path = shared.new_path(blocks.sparkSession, "rows")
    blocks.write.option("parquet.block.row.count.limit", 1).parquet(path)
    return path


def _ranked_rows(qid: int, first: int, ids: np.ndarray, scores: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of one query, ranks after ``first``."""
    for at in range(0, len(ids), RANKED_ROWS):
        some = ids[at : at + RANKED_ROWS]
        ranks = np.arange(first + at + 1, first + at + len(some) + 1, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(some), qid, np.int64), ranks, some, scores[at : at + RANKED_ROWS])], names=["qid", "rank", "row_id", "similarity"])


def ranked_by_query(matrix: DataFrame, queries: DataFrame, rows: int, asked: int, dims: int, k: int, normalized: bool = False) -> DataFrame:
    """The best k of the ``rows`` rows of ``matrix`` (row_id, vec) for each of ``asked`` queries (qid, qvec), without a shuffle of pairs.

    A task reads the rows once for as many queries as RANKED_BYTES has room for. Up to PIECE rows all scores of a query are
    held and sorted; of more rows, the best PIECE are, then those that follow the last of these, in another reading, and so on to k.
    """
    path, dtype = write_rows(row_columns(matrix, rows, dims, normalized)), _kept(matrix)
    piece, whole = min(k, PIECE), rows <= PIECE
    size = max(1, RANKED_BYTES // (8 * max(1, rows) if whole else 32 * max(piece, rows_per_block(dims, 1))))

    def scored(q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for block in shared.batches(path):
            ids, scale, vectors = (np.frombuffer(c[0].as_buffer(), kind) for c, kind in zip(block.columns, (np.int64, np.float64, dtype), strict=True))
            yield ids, column_products(q, vectors.reshape(-1, len(ids)), None if normalized else scale)

    def rank_whole(qids: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, scores, held = np.empty(rows, np.int64), np.empty((len(q), rows)), 0
        for some, s in scored(q):
            ids[held : held + len(some)], scores[:, held : held + len(some)] = some, s
            held += len(some)
        for qid, s in zip(qids, scores, strict=True):
            order = ranking(s[:held], ids[:held])[:k]
            yield from _ranked_rows(qid, 0, ids[order], s[order])

    def best_after(q: np.ndarray, n: int, last: tuple[np.ndarray, np.ndarray] | None) -> RunningTop:
        top, ids, scores, held = RunningTop(len(q), n), [], [], 0
        for some, s in scored(q):
            if last is not None:
                s[(s > last[0]) | ((s == last[0]) & (some <= last[1]))] = -np.inf
            near = ((s >= top.bar()[:, None]) & (s > -np.inf)).any(axis=0)
            ids.append(some[near])
            scores.append(s[:, near])
            held += len(ids[-1])
            if held >= n:
                top.add(np.hstack(scores), np.concatenate(ids))
                ids, scores, held = [], [], 0
        if held:
            top.add(np.hstack(scores), np.concatenate(ids))
        return top

    def rank_pieces(qids: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        last = None
        for first in range(0, k, piece):
            top = best_after(q, min(piece, k - first), last)
            for qid, ids, scores in zip(qids, top.ids, top.scores, strict=True):
                yield from _ranked_rows(qid, first, ids, scores)
            last = top.scores[:, -1:], top.ids[:, -1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if rows else 0, size):
                some = batch.slice(at, size)
                q = stack(some.column(1))
                yield from (rank_whole if whole else rank_pieces)(some.column(0).to_numpy(), q if normalized else q / lengths(q.T)[:, None])

    dealt = queries.select(F.col("qid").cast("long").alias("qid"), "qvec").repartition(max(1, -(-asked // size), min(asked, RANKERS)), "qid")
    return dealt.mapInArrow(run, RANKED)
