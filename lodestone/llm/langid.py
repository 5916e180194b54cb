"""Operator 3: language identification by cross-parsing entropy.

A suffix automaton is built for a bounded, labelled sample of each language. A text is parsed against
each automaton into longest matches (phrases); a language that explains the text needs few of them. The
number of phrases times log2 of the sample's length, per byte of text, is a cross-entropy estimate in
bits per byte; the language with the fewest bits wins, ties going to the first name.

Texts are lower-cased and every run of bytes that are neither ASCII letters nor part of a non-ASCII
character becomes one space. The whole text is one parse: NumPy parses its blocks of ``BLOCK`` bytes in
step, and blocks that a phrase runs into are parsed again from that phrase's state until both parses meet,
so the result is that of a parse from end to end, whatever the block size. A null text, an empty one, or one without a
letter is ``und`` with score 0 and null bits; with no labelled row at all every text is ``und``. Nulls in
other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import chunks, frugal

#: The labelled sample of each language: whole texts of so many rows with a letter, picked by the hash of their ids,
#: of so many characters in all. Rows of up to an even share come first, then longer ones, the shortest first; one
#: row is always taken.
SAMPLE_ROWS = 16
SAMPLE_CHARS = 64_000
BLOCK = 1024
CHUNK = 1 << 20
#: Bits per byte beyond which no language explains a text: raw bytes are then as cheap. One phrase is not
#: counted, since every parse, even of one letter, has one that its end cuts short.
REJECT_BITS = 8.0
UNKNOWN = "und"

_SPACE = 32
_CLASS = np.full(256, _SPACE, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased UTF-8 to letters and single spaces, without leading ones; new offsets."""
    codes = _CLASS[data]
    space = codes == _SPACE
    before = np.ones(len(codes), bool)
    before[1:] = space[:-1]
    starts = offsets[:-1]
    before[starts[starts < len(codes)]] = True
    keep = ~(space & before)
    total = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return codes[keep], total[offsets]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring of ``text``; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        now = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return step


class CrossParser:
    """Parses many texts against the automata of all languages."""

    def __init__(self, samples: list[tuple[str, bytes]]):
        self.languages = [name for name, _ in samples]
        self.letters = np.unique(np.concatenate([np.frombuffer(t, np.uint8) for _, t in samples])) if samples else np.empty(0, np.uint8)
        width = len(self.letters) + 1  # the last column: a byte that no sample has
        self.column = np.full(256, width - 1, np.int32)
        self.column[self.letters] = np.arange(width - 1)
        self.log_size = [math.log2(max(2, len(t))) for _, t in samples]
        self.tables = [self.dense(suffix_automaton(t), width) for _, t in samples]

    def dense(self, step: list[dict[int, int]], width: int) -> np.ndarray:
        """For state and byte: (offset of the next state's row) * 2, plus 1 where a new phrase starts.

        The state after the last one is reached by a byte that the sample lacks, and texts begin there:
        every byte starts a phrase.
        """
        dead = len(step)
        root = np.full(width, dead, np.int64)
        for c, to in step[0].items():
            root[self.column[c]] = to
        table = np.tile(root * width * 2 + 1, (dead + 1, 1))
        for state, moves in enumerate(step):
            for c, to in moves.items():
                table[state, self.column[c]] = to * width * 2
        return table.astype(np.int32).ravel()

    def phrases(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of phrases of each text (rows) in each language (columns)."""
        sizes = np.diff(offsets)
        blocks = -(-sizes // BLOCK)
        doc = np.repeat(np.arange(len(sizes)), blocks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = offsets[:-1][doc] + nth * BLOCK
        length = np.minimum(sizes[doc] - nth * BLOCK, BLOCK)
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(doc), np.int64)
        place[order] = np.arange(len(doc))
        before = np.where(nth > 0, place[np.arange(len(doc)) - 1], -1)[order] if len(doc) else nth  # each block's predecessor
        doc, start, length = doc[order], start[order], length[order]
        out = np.zeros((len(sizes), len(self.tables)), np.int64)
        if not len(doc):
            return out
        steps = int(length[0])
        active = np.searchsorted(-length, -np.arange(steps), "left")  # blocks longer than i
        base = np.cumsum(active) - active  # step i of block j stands at base[i] + j
        columns = self.column[codes]
        lined = np.concatenate([columns[start[:n] + i] for i, n in enumerate(active.tolist())])
        for k, table in enumerate(self.tables):
            fresh = np.int32(len(table) - len(self.letters) - 1)  # the state after nothing
            moves = np.empty(len(lined), np.int32)
            at = np.full(len(doc), fresh, np.int32)
            for i in range(steps):
                n, b = active[i], base[i]
                moves[b : b + n] = to = table[at[:n] + lined[b : b + n]]
                at[:n] = to >> 1
            entered = np.full(len(doc), fresh, np.int32)
            while True:
                final = moves[base[length - 1] + np.arange(len(doc))] >> 1
                wanted = np.where(before >= 0, final[before], fresh)
                todo = np.flatnonzero(wanted != entered)
                if not len(todo):
                    break
                entered[todo] = at = wanted[todo]
                for i in range(steps):
                    inside = length[todo] > i
                    todo, at = todo[inside], at[inside]
                    if not len(todo):
                        break
                    spot = base[i] + todo
                    to = table[at + lined[spot]]
                    apart = (to ^ moves[spot]) > 1  # in different states
                    moves[spot] = to
                    todo, at = todo[apart], (to >> 1)[apart]
            new = np.zeros(len(doc), np.int64)
            for i in range(steps):
                new[: active[i]] += moves[base[i] : base[i] + active[i]] & 1
            out[:, k] = np.bincount(doc, new, len(sizes)).astype(np.int64)
        return out

    def judge(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, bits per byte of the best language, and its phrases, for each text."""
        n = len(texts)
        names, score, bits, phrases = [UNKNOWN] * n, np.zeros(n), np.full(n, np.nan), np.zeros(n, np.int64)
        if not self.tables:
            return names, score, bits, phrases
        for first, data, offsets in chunks(pc.utf8_lower(texts), CHUNK):
            codes, at = normalise(data, offsets)
            size = np.diff(at)
            found = self.phrases(codes, at)
            cost = found * np.array(self.log_size) / np.maximum(size, 1)[:, None]
            letters = np.zeros(len(codes) + 1, np.int64)
            np.cumsum((codes >= 97) & (codes < 123), out=letters[1:])
            ascii_letters = letters[at[1:]] - letters[at[:-1]]
            best = np.argmin(cost, axis=1)
            for i in range(len(size)):
                row = first + i
                if not ascii_letters[i] and not any(c.isalpha() for c in texts[row].as_py() or ""):
                    continue
                b = cost[i, best[i]]
                rest = np.delete(cost[i], best[i])
                other = min(float(rest.min()) if len(rest) else REJECT_BITS, max(REJECT_BITS, b))
                names[row], bits[row], phrases[row] = self.languages[best[i]], b, found[i, best[i]]
                score[row] = other / (b + other)
        return names, score, bits, phrases


def learn_samples(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """A bounded sample for each language, as normalised bytes: whole texts.

    Rows without a letter are left out first. Rows are then picked by the hash of their ids without their
    texts, repeated ids counting once (with the least of their texts), and only the picked ones' texts
    reach the driver.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    size = F.length(text_col)
    late = F.when(size > SAMPLE_CHARS // SAMPLE_ROWS, size).otherwise(F.lit(0))
    order = Window.partitionBy("lang").orderBy("late", "h", "id")
    picked = (
        rows.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.xxhash64(id_col).alias("h"), late.alias("late"), size.alias("size"))
        .withColumn("rank", F.dense_rank().over(order))
        .filter(F.col("rank") <= SAMPLE_ROWS)
        .groupBy("lang", "id")
        .agg(F.min("rank").alias("rank"), F.max("size").alias("size"))
    )
    running = Window.partitionBy("lang").orderBy("rank", "id").rowsBetween(Window.unboundedPreceding, 0)
    picked = picked.withColumn("total", F.sum("size").over(running)).filter((F.col("rank") == 1) | (F.col("total") <= SAMPLE_CHARS)).select("lang", "id")
    texts = (
        rows.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("part"))
        .join(F.broadcast(picked), ["lang", "id"])
        .groupBy("lang", "id")
        .agg(F.min("part").alias("part"))
    )
    found: dict[str, list[tuple[str, str]]] = {}
    for r in texts.collect():
        found.setdefault(r.lang, []).append((str(r.id), r.part))
    out = []
    for lang in sorted(found):
        parts = pa.array([" ".join(p for _, p in sorted(found[lang])).lower()])
        codes = np.concatenate([normalise(data, offsets)[0] for _, data, offsets in chunks(parts)])
        if len(codes):
            out.append((lang, codes.tobytes()))
    return out


_parsers: dict[int, CrossParser] = {}


def _parser(samples: list[tuple[str, bytes]]) -> CrossParser:
    key = hash(tuple(samples))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = CrossParser(samples)
    return _parsers[key]


def identify_language(docs: DataFrame, samples: list[tuple[str, bytes]], text_col: str = "text") -> DataFrame:
    """Add lang_pred, score (0 to 1), bits_per_byte and lang_phrases to ``docs`` in one pass without a shuffle.

    Input columns with those names are replaced.
    """
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType()), T.StructField("lang_phrases", T.LongType())]
    names = {f.name for f in new}
    kept = docs.select([docs[c] for c in docs.columns if c not in names])
    at = kept.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(shared.value)
        for batch in batches:
            lang, score, bits, phrases = parser.judge(batch.column(at))
            made = [pa.array(lang, pa.string()), pa.array(score), pa.array(bits, from_pandas=True), pa.array(phrases)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *[f.name for f in new]])

    return kept.mapInArrow(frugal(run), T.StructType([*kept.schema.fields, *new]))


def rejected() -> F.Column:
    """Rows of :func:`identify_language` that no language explains."""
    return (F.col("lang_pred") == UNKNOWN) | (F.col("bits_per_byte") * (F.col("lang_phrases") - 1) > F.lit(REJECT_BITS) * F.col("lang_phrases"))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    samples = learn_samples(docs.filter(~held_out()))
    return identify_language(docs.select("doc_id", "text"), samples).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")
