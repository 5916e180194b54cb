"""Operator 13: SimHash near-duplicates by pigeonhole blocks.

A text's words (A-Z lower-cased) give its 3-word shingles, repeats included; a text of fewer words is one shingle, one
of none has no shingle and the fingerprint zero. A bit of the fingerprint is 1 where over half of the shingles'
XXH64 values (seed 42) have it. Fingerprints link when they differ in at most ``DISTANCE`` bits; classes are the
connected components of all links.

Equal fingerprints are one node from the start, so copies cost one row each. The 64 bits are split into
``DISTANCE`` + 1 blocks: two linked fingerprints are equal in one block at least, so nodes are dealt by
(block, value). Where a block is crowded, with over ``CROWD`` nodes, its nodes are dealt anew: the remaining bits are
split into as many blocks again, in one of which a linked pair is equal too, and so on. A crowd so shrinks until it is
small, whatever the number of nodes; no group over ``CROWD`` meets in one task, and no link is lost: with
12 bits left, a group has no more than 4096 nodes.

Within a group the Hamming distances are verified from node to node: what is near a node is linked with it and taken out
of the group before the search goes on from there, so a group of n near copies gives n - 1 links, not all pairs.

A null text has no words. A null id takes part, but a component's id is its smallest non-null id (null if it has none).
Repeated rows are copies of each other, each with its row in the result. Other columns pass through whatever their
names, but ``fingerprint`` and ``component_id`` are replaced. An empty table gives an empty result. A very long text
is hashed in blocks of words, so that its words are never all held at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .spark_io import discard, materialize
from .words import frugal

SHINGLE, SEED, BITS = 3, 42, 64
DISTANCE = 3
#: Largest group of nodes that one task compares; at least 2 ** DISTANCE, see ``parts``.
CROWD = 4096
#: About so many bytes of a text are cut into words at once.
BLOCK = 1 << 20
#: Groups up to this size are compared all together, by shifting the sorted table against itself.
SMALL = 8

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: bytes) -> Iterator[np.ndarray]:
    """XXH64 of all shingles, block by block."""
    at, held, seen = 0, [], False
    while at < len(text):
        to = at + BLOCK
        cut = _SPACE.search(text, to) if to < len(text) else None
        to = cut.start() if cut else len(text)
        held += text[at:to].lower().split()  # of bytes: A-Z, and ASCII white space
        at = to
        if len(held) >= SHINGLE:
            yield _hashes(held)
            held, seen = held[1 - SHINGLE :], True
    if held and not seen:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], "<u8")


def _hashes(found: list[bytes]) -> np.ndarray:
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.append(0, ends[:-1] + 1)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], "<u8")


def fingerprint(text: bytes) -> int:
    """The fingerprint, unsigned."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text):
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str, to: str) -> DataFrame:
    """``docs`` without its text, with the fingerprint as a long in column ``to``."""
    at = docs.columns.index(text_col)
    rest = [i for i in range(len(docs.columns)) if i != at]
    schema = T.StructType([*[docs.schema.fields[i] for i in rest], T.StructField(to, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(at), "")
            made = np.array([fingerprint(x.as_buffer().to_pybytes()) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], pa.array(made, pa.int64())], names=[f.name for f in schema])

    return docs.mapInArrow(frugal(run), schema)


def parts(mask: int, distance: int = DISTANCE) -> list[int]:
    """Masks of ``mask``'s bits with one of ``distance`` + 1 blocks of the other bits each."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    n = distance + 1
    return [mask | sum(1 << i for i in free[len(free) * k // n : len(free) * (k + 1) // n]) for k in range(n)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _links(found: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all linked fingerprints of one group: at most one less than there are."""
    a, b, rest, todo = [], [], found, []
    while len(todo) or len(rest) > 1:
        if not todo:
            todo, rest = [rest[0]], rest[1:]
        x = todo.pop()
        near = np.bitwise_count(rest ^ x) <= distance
        if near.any():
            b.append(rest[near])
            a.append(np.full(len(b[-1]), x))
            todo.extend(b[-1])
            rest = rest[~near]
        if not len(rest):
            break
    none = [np.empty(0, np.uint64)]
    return np.concatenate(a or none), np.concatenate(b or none)


def _group_links(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole groups, which stand together."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(first, len(key)))
    a, b = [], []
    small = np.repeat(size <= SMALL, size)
    own, own_key = fp[small], key[small]
    for shift in range(1, SMALL):
        near = (own_key[shift:] == own_key[:-shift]) & (np.bitwise_count(own[shift:] ^ own[:-shift]) <= distance)
        a.append(own[:-shift][near])
        b.append(own[shift:][near])
    for at, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        x, y = _links(fp[at : at + n], distance)
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def _verified(dealt: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) among rows (mask, value, fp) of groups of bounded size."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def made(mask: np.ndarray, value: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.append(True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1]))
        a, b = _group_links(np.cumsum(new), fp.view(np.uint64), distance)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            now = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            other = np.flatnonzero((now[0] != now[0][-1:]) | (now[1] != now[1][-1:]))  # the last group may go on in the next batch
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield made(*[x[:cut] for x in now])
            held = [x[cut:] for x in now]
        if len(held[0]):
            yield made(*held)

    return dealt.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp").mapInArrow(run, schema)


def near_fingerprints(nodes: DataFrame, fp: str, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints ``nodes[fp]`` (longs) at most ``distance`` bits apart."""
    if crowd < 2 ** (distance + 1):
        raise ValueError("crowd must be at least 2 ** (distance + 1)")
    spark = nodes.sparkSession
    masks, found = [0], []
    now = nodes.select(F.lit(0).cast("long").alias("mask"), F.col(fp).alias("fp"))
    while True:
        # as many masks as blocks, to the power of the level: 4096 at most, since 12 bits are then left
        table = spark.createDataFrame([(_signed(m), [_signed(p) for p in parts(m, distance)]) for m in masks], "mask long, next array<long>")
        dealt = now.join(F.broadcast(table), "mask").select(F.explode("next").alias("mask"), "fp")
        dealt = dealt.withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))).select("mask", "value", "fp")
        if len(masks) > 1:  # two ways may lead to one mask
            dealt = dealt.distinct()
        groups = materialize(dealt.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-groups")
        dealt = dealt.join(groups, ["mask", "value"])
        found.append(materialize(_verified(dealt.filter(F.col("n") <= crowd).select("mask", "value", "fp"), distance), "simhash-links"))
        crowded = dealt.filter(F.col("n") > crowd)
        if groups.filter(F.col("n") > crowd).isEmpty():
            break
        now = materialize(crowded.select("mask", "fp"), "simhash-crowded")
        masks = sorted({p for m in masks for p in parts(m, distance)})
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """``docs`` without its text, with fingerprint (16 hexadecimal digits) and component_id (of the type of ``id_col``)."""
    docs = docs.drop("fingerprint", "component_id")
    places = range(len(docs.columns))
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    plain = docs.toDF(*[f"__c{i}" for i in places])
    signed = materialize(fingerprints(plain, f"__c{text_at}", "__fp"), "simhash-rows")
    nodes = materialize(signed.groupBy("__fp").agg(F.min(f"__c{id_at}").alias("first_id")), "simhash-nodes")
    links = near_fingerprints(nodes, "__fp", distance, crowd)
    labels = materialize(connected_components(links, "a", "b").select(F.col("node").alias("__fp"), F.col("component").alias("comp")), "simhash-labels")
    least = materialize(nodes.join(labels, "__fp").groupBy("comp").agg(F.min("first_id").alias("least_id")), "simhash-least")
    linked = labels.join(least, "comp").select("__fp", "least_id")
    classes = nodes.join(linked, "__fp", "left").select("__fp", F.coalesce("least_id", "first_id").alias("component_id"))
    classes = materialize(classes, "simhash-classes")
    for spent in (nodes, labels, least):
        discard(spent)
    result = [F.col(f"__c{i}").alias(docs.columns[i]) for i in places if i != text_at]
    shown = F.lower(F.lpad(F.hex("__fp"), BITS // 4, "0")).alias("fingerprint")
    return signed.join(classes, "__fp").select(*result, shown, "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash_classes(docs).select("doc_id", "fingerprint", "component_id")
