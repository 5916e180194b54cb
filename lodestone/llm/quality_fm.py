"""Operator 7: a factorisation machine that scores documents for quality.

Features of a text are its words, hashed into ``BUCKETS`` (term frequencies, damped and scaled to unit
length), structure statistics (symbols, capitals, digits, repetition, line and word lengths) and one
piece of metadata, its length. The model is

    y = w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2 ]

whose pairwise part costs time linear in the features by the sum-of-squares identity. It is fitted by
Adam on a bounded sample of labelled rows and then scores all texts in one pass without a shuffle.

A null text counts as empty; an empty text has the bias and its statistics only, and a score like any
other. Labels that are null are not learned from; a document labelled twice counts once, with its lower
label. Without labels, or with one class only, every score is the share of label 1 (0.5 if there are
none). Repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import alnum_table, chunks, frugal, words

BUCKETS = 1 << 13
RANK = 8
#: Labelled rows to learn from, chosen by the hash of their ids.
SAMPLE_ROWS = 4000
#: Passes over the sample: at least EPOCHS, and so many that small samples get STEPS updates.
EPOCHS, STEPS, BATCH, RATE, DECAY, SEED = 12, 400, 128, 0.02, 1e-4, 17
THRESHOLD = 0.3

_WORDS = alnum_table()
_KINDS = 8
_KIND = np.full(256, 7, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[list(b"#*$%&<>")], _KIND[list(b"|")], _KIND[list(b"!")], _KIND[10] = 3, 4, 5, 6
_KIND[128:] = 0
#: Kind shares, repetition, mean word length, words a line, length.
STATISTICS = _KINDS + 4
STATISTICS_SCALE = 3.0
WIDTH = BUCKETS + STATISTICS


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of consecutive texts: row starts, feature numbers, values."""
    n = len(offsets) - 1
    found = words(data, offsets, _WORDS)
    doc = found.doc()
    key, count = np.unique(doc * BUCKETS + (found.hashes() % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    row, bucket = key // BUCKETS, key % BUCKETS
    value = np.log1p(count)
    value /= np.sqrt(np.bincount(row, value * value, n))[row]

    size = np.maximum(np.diff(offsets), 1)
    kinds = np.zeros((n, _KINDS))
    kind = _KIND[data]
    for k in range(_KINDS):
        total = np.zeros(len(kind) + 1, np.int64)
        np.cumsum(kind == k, out=total[1:])
        kinds[:, k] = total[offsets[1:]] - total[offsets[:-1]]
    n_words = found.count
    distinct = np.bincount(row, minlength=n)
    length = np.bincount(doc, found.end - found.start, n) / np.maximum(n_words, 1)
    stats = np.column_stack([
        np.sqrt(kinds / size[:, None]),
        1 - distinct / np.maximum(n_words, 1),
        length / 10,
        np.log1p(n_words / (kinds[:, 6] + 1)) / 5,
        np.log1p(np.diff(offsets)) / 10,
    ]) * STATISTICS_SCALE
    rows = np.concatenate([row, np.repeat(np.arange(n), STATISTICS)])
    order = np.argsort(rows, kind="stable")
    numbers = np.concatenate([bucket, np.tile(np.arange(BUCKETS, WIDTH), n)])[order]
    values = np.concatenate([value, stats.ravel()])[order]
    return np.searchsorted(rows[order], np.arange(n + 1)), numbers.astype(np.int32), values.astype(np.float32)


class FactorisationMachine:
    def __init__(self, width: int = WIDTH, rank: int = RANK, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.w = np.zeros(width, np.float32)
        self.v = rng.normal(0, 0.05, (width, rank)).astype(np.float32)

    def margins(self, starts: np.ndarray, numbers: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins of sparse rows (none of them empty), and their sums of v_i x_i."""
        vx = self.v[numbers] * values[:, None]
        sums = np.add.reduceat(vx, starts[:-1], axis=0)
        squares = np.add.reduceat((vx * vx).sum(1), starts[:-1])
        linear = np.add.reduceat(self.w[numbers] * values, starts[:-1])
        return self.bias + linear + 0.5 * ((sums * sums).sum(1) - squares), sums

    def scores(self, starts: np.ndarray, numbers: np.ndarray, values: np.ndarray) -> np.ndarray:
        if len(starts) < 2:
            return np.empty(0)
        margin, _ = self.margins(starts, numbers, values)
        return 1 / (1 + np.exp(-np.clip(margin.astype(np.float64), -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> FactorisationMachine:
        """``rows``: feature numbers and values of each; ``labels``: 0 or 1."""
        share = float(labels.mean()) if len(labels) else 0.5
        self.bias = float(np.log(min(max(share, 1e-6), 1 - 1e-6) / (1 - min(max(share, 1e-6), 1 - 1e-6))))
        if share in (0.0, 1.0) or not len(labels):
            self.v[:] = 0
            if not len(labels):
                self.bias = 0.0
            return self
        rng = np.random.default_rng(SEED)
        moments = [np.zeros_like(x) for x in (self.w, self.w, self.v, self.v)]
        step, bias_moments = 0, [0.0, 0.0]
        for _ in range(max(EPOCHS, -(-STEPS * BATCH // max(len(rows), BATCH)))):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                starts = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in part])])
                numbers = np.concatenate([rows[i][0] for i in part])
                values = np.concatenate([rows[i][1] for i in part])
                margin, sums = self.margins(starts, numbers, values)
                error = ((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[part]) / len(part)).astype(np.float32)
                row = np.repeat(np.arange(len(part)), np.diff(starts))
                pull = error[row] * values
                grad_w = np.bincount(numbers, pull, len(self.w)).astype(np.float32) + DECAY * self.w
                each = pull[:, None] * (sums[row] - self.v[numbers] * values[:, None])
                grad_v = np.column_stack([np.bincount(numbers, each[:, f], len(self.w)) for f in range(self.v.shape[1])]).astype(np.float32) + DECAY * self.v
                step += 1
                for x, g, m, s in ((self.w, grad_w, *moments[:2]), (self.v, grad_v, *moments[2:])):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
                g = float(error.sum())
                bias_moments = [0.9 * bias_moments[0] + 0.1 * g, 0.999 * bias_moments[1] + 0.001 * g * g]
                self.bias -= RATE * bias_moments[0] / (1 - 0.9**step) / ((bias_moments[1] / (1 - 0.999**step)) ** 0.5 + 1e-8)
        return self


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> FactorisationMachine:
    """Fit on at most SAMPLE_ROWS of the labelled rows; only their features reach the driver."""
    picked = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(SAMPLE_ROWS)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("numbers", T.BinaryType()), T.StructField("values", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], []]
            for _, data, offsets in chunks(batch.column(1)):
                starts, numbers, values = features(data, offsets)
                for a, b in zip(starts, starts[1:], strict=False):
                    out[0].append(numbers[a:b].tobytes())
                    out[1].append(values[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], names=[f.name for f in schema])

    got = texts.select(F.col("id").cast("string").alias("id"), "text", "label").mapInArrow(frugal(run), schema)
    got = got.groupBy("id").agg(F.min("label").alias("label"), F.min(F.struct("numbers", "values")).alias("x")).collect()
    got.sort(key=lambda r: r.id)
    rows = [(np.frombuffer(r.x.numbers, np.int32), np.frombuffer(r.x["values"], np.float32)) for r in got]
    return FactorisationMachine().fit(rows, np.array([r.label for r in got], np.float32))


def score_quality(docs: DataFrame, model: FactorisationMachine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` without its text, with ``score_col`` (an input column of that name is replaced)."""
    kept = docs.select([docs[c] for c in docs.columns if c != score_col])
    at = kept.columns.index(text_col)
    rest = [i for i in range(len(kept.columns)) if i != at]
    schema = T.StructType([*[kept.schema.fields[i] for i in rest], T.StructField(score_col, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH x (RANK + 1) floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.scores(*features(data, offsets)) for _, data, offsets in chunks(batch.column(at))]
            score = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], pa.array(score, pa.float64())], names=[f.name for f in schema])

    return kept.mapInArrow(frugal(run), schema)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op7_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").filter(~held_out())
    scored = score_quality(docs, learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
