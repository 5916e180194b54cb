"""Operator 2: benchmark decontamination with an FM-index of each training shard.

Texts are cut into words (A-Z lower-cased). A task collects the texts of about ``SHARD_WORDS`` words
into a shard. Words that no benchmark item has can be in no test phrase, so they are written as breaks;
over the rest the shard gets an FM-index: a suffix array by prefix doubling, its Burrows-Wheeler
transform in a level-wise wavelet tree, and suffix positions sampled every ``SAMPLE`` words. All test
phrases (windows of ``WINDOW`` words, or the whole of a shorter item) are searched backwards at once,
their occurrences are located by walking to sampled positions, and overlapping occurrences are merged
into removal spans of the texts.

Benchmarks of any size are taken in blocks of about ``BLOCK_BYTES``, one pass over the texts each. A pass's
result is written to the shared folder before the next one begins and its broadcast is then given up, so that
a task, and the driver, hold one block only. An item's text longer than a block is a block of its own.
There is no shuffle of texts. Words are compared by 64-bit hashes.

A null or empty text has no words, hits or items. Items without a word are never found; repeated items
of one id count once; a null item id is ignored. Repeated documents each get a row. An empty benchmark
leaves all texts clean. Output columns replace input columns of the same names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spark_io import discard, materialize
from .words import alnum_table, chunks, frugal, words

WINDOW = 10
SHARD_WORDS = 1_000_000
SAMPLE = 16
BLOCK_BYTES = 4 << 20
_TABLE = alnum_table()


class Phrases:
    """Distinct test phrases of a block of items, over the ids 1, 2, ... of their words."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.items = [i for i, _ in items]
        texts = pa.array([t for _, t in items], pa.string())
        hashes = [words(data, offsets, _TABLE) for _, data, offsets in chunks(texts, 1 << 40)]
        by_item: list[np.ndarray] = []
        for found in hashes:
            h = found.hashes()
            by_item += [h[a:b] for a, b in zip(found.first, found.first[1:], strict=False)]
        self.vocabulary = np.unique(np.concatenate(by_item)) if by_item else np.empty(0, np.uint64)
        number: dict[tuple[int, ...], int] = {}
        pairs = set()
        for item, h in enumerate(by_item):
            ids = (np.searchsorted(self.vocabulary, h) + 1).tolist()
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                pairs.add((number.setdefault(tuple(ids[at : at + window]), len(number)), item))
        self.sizes = np.array([len(p) for p in number], np.int64)
        self.ids = np.zeros((len(number), window), np.int64)  # right-aligned
        for i, p in enumerate(number):
            self.ids[i, window - len(p) :] = p
        pairs_in_order = sorted(pairs)
        self.pair_item = np.array([i for _, i in pairs_in_order], np.int64)
        self.pair_first = np.searchsorted([p for p, _ in pairs_in_order], np.arange(len(number) + 1))

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids; 0 for words that no item has."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


class WaveletTree:
    """A sequence of small integers with rank and access; one bit vector for each level."""

    def __init__(self, values: np.ndarray, top: int):
        self.n = len(values)
        self.levels = max(1, int(top).bit_length())
        self.zeros, self.bits, self.ones = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1 == 1
            packed = np.zeros(-(-(self.n + 1) // 64) * 8, np.uint8)
            squeezed = np.packbits(bit, bitorder="little")
            packed[: len(squeezed)] = squeezed
            packed = packed.view(np.uint64)
            ones = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=ones[1:])
            self.bits.append(packed)
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            values = np.concatenate([values[~bit], values[bit]])

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones of level ``k`` before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[k][word] + np.bitwise_count(self.bits[k][word] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        begin = np.zeros(len(at), np.int64)
        for k in range(self.levels):
            bit = (symbol >> (self.levels - 1 - k)) & 1 == 1
            one, one0 = self._ones(k, at), self._ones(k, begin)
            at = np.where(bit, self.zeros[k] + one, at - one)
            begin = np.where(bit, self.zeros[k] + one0, begin - one0)
        return at - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        for k in range(self.levels):
            one = self._ones(k, at)
            bit = self._ones(k, at + 1) > one
            symbol = symbol * 2 + bit
            at = np.where(bit, self.zeros[k] + one, at - one)
        return symbol


def suffix_array(text: np.ndarray, top: int) -> np.ndarray:
    """Suffixes in order, by prefix doubling. Zeros are breaks: each differs from every other and is
    smaller than any word, earlier ones first, so no comparison goes past a break."""
    n = len(text)
    breaks = text == 0
    rank = np.where(breaks, np.cumsum(breaks) - 1, text + int(breaks.sum()) - 1)
    order = np.argsort(rank, kind="stable")
    width = 1
    while True:
        key = rank[order]
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        if width > 1:
            follow = second[order]  # noqa: F821
            new[1:] |= follow[1:] != follow[:-1]
        group = np.cumsum(new) - 1
        renamed = np.empty(n, np.int64)
        renamed[order] = group
        # only groups of two and more are still unsorted
        single = new.copy()
        single[:-1] &= new[1:]
        rank = renamed
        if single.all():
            return order
        second = np.full(n, -1, np.int64)
        second[: n - width] = rank[width:]
        rest = np.flatnonzero(~single)
        part = order[rest]
        order[rest] = part[np.argsort(rank[part] * (n + 1) + second[part] + 1, kind="stable")]
        width *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, top: int):
        self.n = len(text)
        order = suffix_array(text, top)
        self.tree = WaveletTree(text[order - 1], top)  # the first suffix takes the last symbol, a break
        self.before = np.searchsorted(np.sort(text), np.arange(top + 2))
        start = np.zeros(self.n, bool)  # words that follow a break are sampled too
        start[1:] = text[:-1] == 0
        start[0] = True
        sampled = (order % SAMPLE == 0) | start[order]
        self.sampled = sampled
        self.nth = np.cumsum(sampled) - 1
        self.positions = order[sampled]

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that begin with each phrase."""
        low = np.zeros(len(phrases.ids), np.int64)
        high = np.full(len(phrases.ids), self.n, np.int64)
        for column in range(phrases.ids.shape[1] - 1, -1, -1):
            symbol = phrases.ids[:, column]
            live = np.flatnonzero((symbol > 0) & (low < high))
            if not len(live):
                break
            c = symbol[live]
            low[live] = self.before[c] + self.tree.rank(c, low[live])
            high[live] = self.before[c] + self.tree.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to a sampled one."""
        out = np.zeros(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            known = self.sampled[at]
            out[todo[known]] = self.positions[self.nth[at[known]]] + steps
            todo, at = todo[~known], at[~known]
            symbol = self.tree.access(at)
            at = self.before[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return out


class Shard:
    """Texts of one shard: words as ids, and where they stand."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.ids: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        self.words = 0

    def add(self, values: pa.Array) -> None:
        for _, data, offsets in chunks(values):
            found = words(data, offsets, _TABLE)
            self.ids.append(self.phrases.encode(found.hashes()))
            base = offsets[:-1][found.doc()]
            self.counts.append(found.count)
            self.starts.append((found.start - base).astype(np.int32))
            self.ends.append((found.end - base).astype(np.int32))
            self.words += len(found.start)

    def search(self) -> tuple[np.ndarray, list[np.ndarray], list[list[tuple[int, int]]], np.ndarray]:
        """For each text: words, numbers of the items found, byte spans to remove; and words hit."""
        counts = np.concatenate(self.counts)
        n, first = len(counts), np.concatenate([[0], np.cumsum(counts)])
        hit = np.zeros(self.words + 1, np.int64)
        items: list[np.ndarray] = [np.empty(0, np.int64)] * n
        spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        ids = np.concatenate(self.ids)
        doc = np.repeat(np.arange(n), counts)
        # runs of item words, each followed by one break
        usable = ids > 0
        follows = np.zeros(len(ids), bool)
        if len(ids):
            follows[1:] = usable[1:] & usable[:-1] & (doc[1:] == doc[:-1])
        head = np.flatnonzero(usable & ~follows)
        run = np.cumsum(usable & ~follows) - 1
        place = np.flatnonzero(usable)
        size = np.bincount(run[place], minlength=len(head))
        shortest = int(self.phrases.sizes.min()) if len(self.phrases.sizes) else WINDOW
        place = place[size[run[place]] >= shortest]
        if len(place):
            newrun = np.ones(len(place), bool)
            newrun[1:] = run[place[1:]] != run[place[:-1]]
            at = np.arange(len(place)) + np.cumsum(newrun)  # a break before each run
            text = np.zeros(at[-1] + 2, np.int64)
            text[at] = ids[place]
            source = np.zeros(len(text), np.int64)
            source[at] = place
            index = FMIndex(text, len(self.phrases.vocabulary))
            low, high = index.search(self.phrases)
            times = high - low
            which = np.repeat(np.arange(len(times)), times)
            if len(which):
                rows = np.repeat(low, times) + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
                word = source[index.locate(rows)]
                np.add.at(hit, word, 1)
                np.add.at(hit, word + self.phrases.sizes[which], -1)
                pair = np.unique(doc[word] * len(times) + which)
                where, phrase = pair // len(times), pair % len(times)
                many = np.diff(self.phrases.pair_first)[phrase]
                item = self.phrases.pair_item[np.repeat(self.phrases.pair_first[phrase], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                seen = np.unique(np.repeat(where, many) * len(self.phrases.items) + item)
                owner = seen // len(self.phrases.items)
                for d in np.unique(owner):
                    items[d] = seen[np.searchsorted(owner, d) : np.searchsorted(owner, d, "right")] % len(self.phrases.items)
        flag = np.cumsum(hit)[:-1] > 0
        if flag.any():
            starts, ends = np.concatenate(self.starts), np.concatenate(self.ends)
            joins = np.zeros(len(flag), bool)
            joins[1:] = flag[1:] & flag[:-1] & (doc[1:] == doc[:-1])
            opens = np.flatnonzero(flag & ~joins)
            closes = np.flatnonzero(flag & ~np.append(joins[1:], False))
            for a, b in zip(opens, closes, strict=True):
                spans[doc[a]].append((int(starts[a]), int(ends[b])))
        total = np.concatenate([[0], np.cumsum(flag)])
        return counts, items, spans, total[first[1:]] - total[first[:-1]]


def _merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(a + b):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def remove_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end
    return b"".join([*out, text[at:]])


_phrases: dict[int, Phrases] = {}


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", clean_col: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add n_words, n_hit, item_ids (sorted strings) and removal_spans (UTF-8 byte ranges) to ``docs``.

    With ``clean_col`` (which may be ``text_col``) that column holds the text without the spans; else the
    text itself is dropped.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).dropna().distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    new = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("removal_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))]
    names = {f.name for f in new}
    out = docs.select([docs[c] for c in docs.columns if c not in names])
    written: DataFrame | None = None
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for block in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        collected = sorted((r.item, r.text) for r in part.collect())  # block_bytes, about
        shared = spark.sparkContext.broadcast(collected)
        at = out.columns.index(text_col)
        first_pass, last_pass = block == 0, block == blocks - 1
        fields = [f for f in out.schema.fields if f.name not in names]
        if last_pass and clean_col != text_col:
            fields = [f for f in fields if f.name not in (text_col, clean_col)]
        carried = [f.name for f in fields]
        extra = [T.StructField(clean_col, T.StringType())] if last_pass and clean_col and clean_col != text_col else []
        schema = T.StructType([*fields, *extra, *new])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, at=at, first_pass=first_pass, last_pass=last_pass, carried=carried, extra=extra) -> Iterator[pa.RecordBatch]:
            key = hash(tuple(shared.value))
            if key not in _phrases:
                _phrases.clear()
                _phrases[key] = Phrases(shared.value)
            phrases = _phrases[key]

            def flush(held: list[pa.RecordBatch], shard: Shard) -> Iterator[pa.RecordBatch]:
                counts, items, spans, hits = shard.search()
                row = 0
                for batch in held:
                    n = batch.num_rows
                    ids = [[phrases.items[i] for i in items[row + i]] for i in range(n)]
                    cuts = [spans[row + i] for i in range(n)]
                    hit = hits[row : row + n].tolist()
                    if not first_pass:
                        was = batch.column(batch.schema.get_field_index("removal_spans")).to_pylist()
                        ids = [[*a, *b] for a, b in zip(batch.column(batch.schema.get_field_index("item_ids")).to_pylist(), ids, strict=True)]
                        cuts = [_merge([(s["start"], s["end"]) for s in a], b) for a, b in zip(was, cuts, strict=True)]
                    cuts_in = [i for i in range(n) if cuts[i]]
                    if not first_pass and last_pass:
                        texts = batch.column(at)
                        for i in cuts_in:  # words in the merged spans
                            raw = (texts[i].as_py() or "").encode()
                            hit[i] = sum(len(words(np.frombuffer(raw[s:e], np.uint8), np.array([0, e - s]), _TABLE).start) for s, e in cuts[i])
                    columns = {name: batch.column(batch.schema.get_field_index(name)) for name in carried}
                    if last_pass and clean_col:
                        texts = batch.column(at)
                        if cuts_in:
                            cleaned = texts.to_pylist()
                            for i in cuts_in:
                                cleaned[i] = remove_spans(cleaned[i].encode(), cuts[i]).decode()
                            texts = pa.array(cleaned, pa.string())
                        columns[clean_col] = texts
                    columns |= {
                        "n_words": pa.array(counts[row : row + n].astype(np.int64)),
                        "n_hit": pa.array(hit, pa.int64()),
                        "item_ids": pa.array([sorted(set(x)) for x in ids], pa.list_(pa.string())),
                        "removal_spans": pa.array([[{"start": s, "end": e} for s, e in x] for x in cuts], span_type),
                    }
                    order = [*carried, *[f.name for f in extra], *[f.name for f in new]]
                    yield pa.RecordBatch.from_arrays([columns[c] for c in order], names=order)
                    row += n

            held: list[pa.RecordBatch] = []
            shard = Shard(phrases)
            for whole in batches:
                for begin in range(0, whole.num_rows, 256):
                    batch = whole.slice(begin, 256)
                    held.append(batch)
                    shard.add(batch.column(at))
                    if shard.words >= SHARD_WORDS:
                        yield from flush(held, shard)
                        held, shard = [], Shard(phrases)
            if held:
                yield from flush(held, shard)

        out = out.mapInArrow(frugal(run), schema)
        if not last_pass:
            done = materialize(out, "decontaminate")
            shared.unpersist()
            if written is not None:
                discard(written)
            out = written = done
    return out


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), phrases AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i:i + least(len(w), 10) - 1] AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM phrases
), grams AS (
  SELECT rid, i, n, w[i:i + n - 1] AS p FROM (
    SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), found AS (
  SELECT rid, i, g.n, item_id FROM grams g JOIN phrases USING (n, p)
), hit AS (
  SELECT rid, count(DISTINCT k) AS n_hit FROM (
    SELECT rid, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT rid, i, n FROM found)) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM found) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""
