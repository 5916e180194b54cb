"""Operator 12: phrase collocations from a weighted de Bruijn graph of word n-grams.

Texts (A-Z lower-cased) are split at sentence marks and line ends into pieces and those into words. Nodes are n-grams, and
an edge leads from an n-gram to the one that follows it, one word on; its weight counts the longer n-gram that both
make. Each position of a corpus gives exactly one edge, the longest n-gram (up to ``LONGEST`` words) that begins there
and does not pass the end of its piece. So all counts follow from the aggregated edges alone: a shorter n-gram occurs
as often as flows out of it along longer edges, plus what ended with it (``flows``). The flow of the empty n-gram is the
number of words.

Before edges are made, the way on is cut where no candidate can follow it: an n-gram does not grow by a word with which
its last two words, or its last one, stand fewer than ``least`` times in the corpus. A candidate's occurrences pass no
such cut, and a position whose word is rare gives the empty edge, so counts stay exact while the graph keeps the
frequent part of the corpus only. Which words, pairs and, of frequent pairs, triples are frequent is counted over the
whole corpus by hashes; they are set in a bit table of at most ``MAX_BLOCKS`` (8 MB). What it lets through too much
costs edges and changes no count.

Unary paths are compacted: an n-gram all of whose flow goes on to one longer edge, or comes from one, is part of that
one. This is all that the rule on contained candidates asks for: a longer candidate as frequent as a contained one
makes all n-grams between them as frequent, so looking one word to each side is enough.

A null text is empty, a null language is ``und``. Repeated rows count each. An empty table gives an empty result. Very
long texts are handled whole. Hashes have 64 bits; those of words cover every byte. Counts are exact in longs, scores
in decimals of 38 digits.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spark_io import discard, materialize
from .words import SLOTS, Words, chunks, frugal, keep_table, mix, words

LONGEST, LEAST, TOP = 5, 100, 2000
#: Hashes that a counting group has about, and that a task holds before it writes them.
GROUP, HOLD = 2_000_000, 1_000_000
#: Blocks of 64 bits of the table of frequent n-grams: one for two of them, within these bounds (8 MB); bits of each n-gram.
MIN_BLOCKS, MAX_BLOCKS, PROBES = 1 << 10, 1 << 20, 4
#: Bytes of texts worked on together, and n-grams a task holds before it writes them.
CHUNK, HOLD_GRAMS = 1 << 22, 200_000
NO_LANGUAGE = "und"
#: Languages whose numbers of words are broadcast.
FEW_LANGUAGES = 10_000

_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_KEEP = ~_ENDS
_KEEP[[0x20, 0x09]] = False
_TABLE = keep_table(_KEEP, fold=True)
_TABLE[0] = 0x20  # byte 0 is part of a word
#: Letters folded, tabs as spaces: what a phrase is cut from.
_SHOWN = np.arange(256, dtype=np.uint8)
_SHOWN[0x41:0x5B] += 32
_SHOWN[0x09] = 0x20
_SIZE = mix(np.arange(16, dtype=np.uint64) + np.uint64(0x2545F4914F6CDD1D))


class Chunk:
    """Words of a chunk of texts: hashes by language, and whether the next word is in the same piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, languages: np.ndarray):
        self.found: Words = words(data, offsets, _TABLE)
        self.language = np.repeat(languages, self.found.count)
        self.word = mix(self.found.hashes() ^ self.language)
        ends = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_ENDS[data], out=ends[1:])
        doc = self.found.doc()
        start, end = self.found.start, self.found.end
        self.goes_on = (doc[1:] == doc[:-1]) & (ends[start[1:]] == ends[end[:-1]])

    def pairs(self) -> np.ndarray:
        """Hash of each word with the next one (of any two words, in one piece or not)."""
        return mix(self.word[:-1] * SLOTS[0] + self.word[1:] * SLOTS[1] + _SIZE[2])

    def follow(self, word_ok: np.ndarray, pair_ok: np.ndarray) -> np.ndarray:
        """Whether each word goes on to the next one, as a frequent pair."""
        return self.goes_on & pair_ok & word_ok[1:] & word_ok[:-1]

    def triples(self, follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the triples of frequent pairs."""
        at = np.flatnonzero(follow[:-1] & follow[1:])
        return at, mix(self.word[at] * SLOTS[0] + self.word[at + 1] * SLOTS[1] + self.word[at + 2] * SLOTS[2] + _SIZE[3])

    def edges(self, passes: Callable[[np.ndarray], np.ndarray], longest: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and size of the longest n-gram at each position; size 0 for rare words. ``passes``: whether hashes are frequent."""
        n = len(self.word)
        word_ok = passes(self.word)
        follow = self.follow(word_ok, passes(self.pairs()))
        at, hashes = self.triples(follow)
        grows = np.zeros(n, bool)  # a third word may follow these two
        grows[at[passes(hashes)]] = True
        size = word_ok.astype(np.int64)
        sums = self.word * SLOTS[0]
        at = np.flatnonzero(follow)
        for k in range(1, longest):
            size[at] = k + 1
            sums[at] += self.word[at + k] * SLOTS[k]
            at = at[grows[at + k - 1]]
        return np.where(size > 0, mix(sums + _SIZE[size]), self.language), size


def _language_hashes(values: pa.Array) -> tuple[list[str], np.ndarray]:
    names = ["" if v is None else v for v in values.to_pylist()]
    known = {n: xxhash.xxh64_intdigest(n.encode(), 7) for n in set(names)}
    return names, np.array([known[n] for n in names], np.uint64)


def _read(batch: pa.RecordBatch) -> Iterator[tuple[Chunk, np.ndarray, list[str], np.ndarray]]:
    names, hashes = _language_hashes(batch.column(1))
    for first, data, offsets in chunks(batch.column(0), CHUNK):
        of = slice(first, first + len(offsets) - 1)
        yield Chunk(data, offsets, hashes[of]), data, names[of], hashes[of]


def _slot(group: np.ndarray, key: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The table's block of a key, and its PROBES bits there."""
    h = mix(key.astype(np.uint64) + group.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    bits = np.zeros(len(h), np.uint64)
    for probe in range(PROBES):
        bits |= np.uint64(1) << (h >> np.uint64(58 - 6 * probe) & np.uint64(63))
    return h & np.uint64(blocks - 1), bits


def _split(hashes: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Counting group, from the upper half, and key, the lower half."""
    return (hashes >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32), (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _frequent_keys(texts: DataFrame, groups: int, least: int, table: np.ndarray | None = None) -> DataFrame:
    """(group, key) of hashes that occur ``least`` times: of words and pairs; with a ``table`` of those, of triples.

    A hash that a task meets often is one entry of what it writes.
    """
    shared = texts.sparkSession.sparkContext.broadcast(table)  # MAX_BLOCKS longs
    schema = T.StructType([T.StructField("group", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType())])

    def write(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes, counts = np.unique(np.concatenate(held), return_counts=True)  # sorted, so groups stand together
        group, keys = _split(hashes, groups)
        order = np.lexsort((counts > 1, group))  # single ones need no count
        group, keys, counts = group[order], keys[order], counts[order].astype(np.uint32)
        cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        rows: list[list] = [[], [], []]
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True):
            many = counts[a:b]
            rows[0].append(int(group[a]))
            rows[1].append(keys[a:b].tobytes())
            rows[2].append(many[many > 1].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], names=[f.name for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for chunk, *_ in _read(batch):
                if shared.value is None:
                    held += [chunk.word, chunk.pairs()[chunk.goes_on]]
                else:
                    frequent = lambda h: _passes(h, groups, shared.value)
                    held += [chunk.triples(chunk.follow(frequent(chunk.word), frequent(chunk.pairs())))[1], chunk.word[:0]]
                n += len(held[-1]) + len(held[-2])
                if n >= HOLD:
                    yield from write(held)
                    held, n = [], 0
        if n:
            yield from write(held)

    def count(table: pa.Table) -> pa.Table:
        keys, weights = [], []
        for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True):
            k, c = np.frombuffer(k, np.uint32), np.frombuffer(c, np.uint32)
            keys.append(k)
            weights.append(np.concatenate([np.ones(len(k) - len(c), np.int64), c.astype(np.int64)]))
        key, weight = np.concatenate(keys), np.concatenate(weights)
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
        cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        often = key[cuts][np.add.reduceat(weight, cuts) >= least].astype(np.int64)
        return pa.table({"group": pa.array(np.full(len(often), table.column("group")[0].as_py(), np.int64)), "key": pa.array(often)})

    return texts.mapInArrow(frugal(run), schema).groupBy("group").applyInArrow(count, "group long, key long")


def _bit_table(keys: DataFrame) -> np.ndarray:
    """Blocks of 64 bits with the bits of all frequent keys; at most ``MAX_BLOCKS`` rows come to the driver."""
    blocks = MIN_BLOCKS
    while blocks < min(MAX_BLOCKS, keys.count() // 2):
        blocks *= 2
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("bits", T.LongType())])

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, bits = _slot(batch.column(0).to_numpy(), batch.column(1).to_numpy(), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(bits.view(np.int64))], names=["block", "bits"])

    rows = keys.mapInArrow(slots, schema).groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(blocks, np.uint64)
    table[rows.column("block").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return table


def _passes(hashes: np.ndarray, groups: int, table: np.ndarray) -> np.ndarray:
    at, bits = _slot(*_split(hashes, groups), len(table))
    return table[at] & bits == bits


def _edges(texts: DataFrame, groups: int, table: np.ndarray, longest: int) -> DataFrame:
    """(lang, phrase, size, c): edges, counted; phrases are joined by spaces.

    A task writes what it has counted as one row for each group of phrases and language, so a frequent phrase is
    one entry of it, and a group has about the edges of ``GROUP`` positions at most.
    """
    shared = texts.sparkSession.sparkContext.broadcast(table)  # MAX_BLOCKS longs
    schema = T.StructType([T.StructField("group", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("phrases", T.BinaryType()), T.StructField("counts", T.BinaryType())])

    def write(held: dict[tuple[str, bytes], int]) -> pa.RecordBatch:
        parts: dict[tuple[int, str], list[bytes]] = {}
        for lang, phrase in held:
            parts.setdefault((zlib.crc32(phrase) * groups >> 32, lang), []).append(phrase)
        rows: list[list] = [[], [], [], []]
        for (group, lang), phrases in parts.items():
            phrases.sort()
            rows[0].append(group)
            rows[1].append(lang)
            rows[2].append(b"\n".join(phrases))  # no phrase has a line feed
            rows[3].append(np.array([held[lang, p] for p in phrases], np.int64).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.binary())], names=[f.name for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], int] = {}
        for batch in batches:
            for chunk, data, names, hashes in _read(batch):
                if not len(chunk.word):
                    continue
                edge, size = chunk.edges(lambda h: _passes(h, groups, shared.value), longest)
                _, first, count = np.unique(edge, return_index=True, return_counts=True)
                size = size[first]
                start = chunk.found.start[first]
                end = np.where(size > 0, chunk.found.end[first + np.maximum(size, 1) - 1], start)
                language = dict(zip(hashes.tolist(), names, strict=True))
                raw = _SHOWN[data].tobytes()
                for h, a, b, c in zip(chunk.language[first].tolist(), start.tolist(), end.tolist(), count.tolist(), strict=True):
                    phrase = raw[a:b]
                    if b"  " in phrase:
                        phrase = b" ".join(phrase.split())
                    key = (language[h], phrase)
                    held[key] = held.get(key, 0) + c
                if len(held) >= HOLD_GRAMS:
                    yield write(held)
                    held = {}
        if held:
            yield write(held)

    def merge(parts: pa.Table) -> pa.Table:
        langs, phrases, counts = [], [], []
        for lang, p, c in zip(*(parts.column(x).to_pylist() for x in ("lang", "phrases", "counts")), strict=True):
            phrases += p.split(b"\n")
            counts.append(np.frombuffer(c, np.int64))
            langs += [lang] * len(counts[-1])
        every = pa.table({"lang": pa.array(langs, pa.string()), "phrase": pa.array(phrases, pa.binary()).cast(pa.string()), "c": pa.array(np.concatenate(counts))})
        found = every.group_by(["lang", "phrase"]).aggregate([("c", "sum")])
        size = pc.if_else(pc.equal(found.column("phrase"), ""), 0, pc.add(pc.count_substring(found.column("phrase"), " "), 1))
        return pa.table({"lang": found.column("lang"), "phrase": found.column("phrase"), "size": size.cast(pa.int32()), "c": found.column("c_sum")})

    return texts.mapInArrow(frugal(run), schema).groupBy("group").applyInArrow(merge, "lang string, phrase string, size int, c long")


def _first(phrase: str, k: Column | int) -> Column:
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), F.lit(k) if isinstance(k, int) else k)


def flows(edges: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, size, f) of all n-grams of edges (lang, phrase, size, c): the flow into longer ones, level by level,
    plus what ended with the n-gram."""
    total = F.sum("c").alias("c")
    level = edges.filter(F.col("size") == longest).groupBy("lang", "phrase").agg(total)
    found = level.withColumn("size", F.lit(longest))
    for k in range(longest - 1, -1, -1):
        flow = level.select("lang", _first("phrase", k).alias("phrase"), "c")
        level = flow.unionByName(edges.filter(F.col("size") == k).select("lang", "phrase", "c")).groupBy("lang", "phrase").agg(total)
        found = found.unionByName(level.withColumn("size", F.lit(k)))
    return found.withColumnRenamed("c", "f")


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, phrase, size, f): exact counts of all phrases of up to ``longest`` words that occur ``least`` times, and each
    language's number of words with the empty phrase. Written to the shared folder."""
    texts = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit(NO_LANGUAGE)).alias("lang"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    groups = min(1 << 30, 1 + size // 3 // GROUP)  # some two hashes for each six bytes
    keys = materialize(_frequent_keys(texts, groups, least), "collocation-keys")
    triples = materialize(_frequent_keys(texts, groups, least, _bit_table(keys)), "collocation-triples")
    table = _bit_table(keys.unionByName(triples))
    edges = materialize(_edges(texts, groups, table, longest), "collocation-edges")
    counts = materialize(flows(edges, longest).filter((F.col("f") >= least) | (F.col("size") == 0)), "collocation-counts")
    for spent in (keys, triples, edges):
        discard(spent)
    return counts


def compacted(counts: DataFrame) -> DataFrame:
    """Phrases of two words and more, without those that a longer one of ``counts`` contains as often."""
    longer = counts.filter("size > 2")
    inside = [longer.select("lang", part.alias("phrase"), "f") for part in (_first("phrase", F.col("size") - 1), _first("phrase", 1 - F.col("size")))]
    most = inside[0].unionByName(inside[1]).groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    return counts.filter("size > 1").join(most, ["lang", "phrase"], "left").filter("most IS NULL OR most < f").drop("most")


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """``phrases`` with l, r, n and score of the cut that scores least."""
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("*", _first("phrase", F.col("k")).alias("left"), _first("phrase", F.col("k") - F.col("size")).alias("right"))
    part = lambda name, to: counts.filter("size > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(to))
    total = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    if total.limit(FEW_LANGUAGES + 1).count() <= FEW_LANGUAGES:
        total = F.broadcast(total)  # so that phrases are not dealt by language
    joined = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(total, "lang")
    joined = joined.withColumns({"over": (F.lit(1000).cast("decimal(4,0)") * F.col("f").cast("decimal(15,0)") * exact("n")).cast("decimal(38,0)"), "under": (exact("l") * exact("r")).cast("decimal(38,0)")})
    joined = joined.withColumn("score", F.expr("over div under"))
    best = joined.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "n", F.col("f").alias("a"))).alias("b"))
    return best.select("lang", "phrase", *[f"b.{c}" for c in ("a", "l", "r", "n", "score")])


def mine_collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counts = phrase_counts(docs, text_col, lang_col, longest, least)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(compacted(counts), counts).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), total AS (
  SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang
), grams AS (
  SELECT lang, w, i, k FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces), (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w)
), f AS (
  SELECT lang, k, w[i:i + k - 1] AS p, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100
), kept AS (
  SELECT * FROM f WHERE k > 1 AND NOT EXISTS (
    SELECT 1 FROM f q WHERE q.lang = f.lang AND q.k > f.k AND q.a >= f.a
      AND contains(' ' || array_to_string(q.p, ' ') || ' ', ' ' || array_to_string(f.p, ' ') || ' '))
), cuts AS (
  SELECT lang, k, p, a, unnest(range(1, k)) AS c FROM kept
), s AS (
  SELECT cuts.lang, cuts.p, cuts.a, c, x.a AS l, y.a AS r, n,
         (1000 * cuts.a::HUGEINT * n::HUGEINT) // (x.a::HUGEINT * y.a::HUGEINT) AS score
  FROM cuts JOIN total USING (lang)
  JOIN f x ON x.lang = cuts.lang AND x.p = cuts.p[1:c] JOIN f y ON y.lang = cuts.lang AND y.p = cuts.p[c + 1:]
), one AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, c) = 1
), named AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM one
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM named QUALIFY rank <= 2000
"""
