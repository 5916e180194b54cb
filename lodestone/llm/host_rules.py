"""Operator 8: quality rules judged for documents and for their hosts.

Each text is measured once (words, symbols, repeated lines and word windows) and judged by the RULES: too few
words, too many words in repeated 3-word windows, too many symbols, too many repeated lines. The first two
are the base rules, which a document must pass. Failures are then summed by rule for each host (the ``source``
column). For each rule the hosts' failure rates are shrunk with a beta prior fitted to all hosts by the method
of moments, and documents of hosts whose shrunk rate exceeds the rule's limit under any rule are not kept.
The limit comes from the fitted prior: ``DEVIATIONS`` of its standard deviations above its mean, but at least
``LEAST_LIMIT`` (a host that differs by little is no bad host, however sure that is) and at most ``HOST_LIMIT``.
Shrinking keeps a host of two bad pages from being condemned. Rates are rounded to 9 places before they are
compared, so that the order of sums decides nothing.

A null text counts as empty: no words, so it fails. A null host has no verdict, so its documents are
judged alone. Repeated rows each get a row. An empty table gives an empty result. Measures are written
once to the shared folder; sums for each host are combined before they are shuffled. Up to
``BROADCAST_HOSTS`` hosts (they are counted) the verdicts are broadcast, so a hot host's documents are
not shuffled; beyond that Spark joins by hash and splits skewed hosts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spark_io import materialize
from .words import chunks, frugal, lines_table, mix, spaces_table, windows, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: More symbols than one in so many characters, and repeated lines than one in so many words, fail a text.
SYMBOL_SHARE, LINE_SHARE = 10, 20
#: A host is rejected when its shrunk failure rate lies so many deviations of the prior above the prior's mean,
#: and always beyond HOST_LIMIT, and never up to LEAST_LIMIT.
DEVIATIONS, LEAST_LIMIT, HOST_LIMIT = 3.0, 0.35, 0.5
BROADCAST_HOSTS = 100_000
#: Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (2.0, 1000.0)
RULES = ("few_words", "repetition", "symbols", "dup_lines")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_WORDS, _LINES = spaces_table(fold=False), lines_table()
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _in_doc(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The MEASURES of consecutive texts."""
    n = len(offsets) - 1
    found = words(data, offsets, _WORDS)
    word_chars = _per_doc((found.kept != 0) & ((data & 0xC0) != 0x80), offsets)
    symbols = _per_doc(_SYMBOL[data], offsets)

    lines = words(data, offsets, _LINES)
    worded = np.searchsorted(found.start, lines.end) > np.searchsorted(found.start, lines.start)
    line_doc = lines.doc()[worded]
    _, kept = np.unique(_in_doc(lines.hashes()[worded], line_doc), return_index=True)
    dup_lines = np.bincount(line_doc, minlength=n) - np.bincount(line_doc[kept], minlength=n)

    doc = found.doc()
    repeat = np.zeros(len(doc) + 1, np.int64)
    if len(doc) >= 3:
        whole = np.flatnonzero(doc[2:] == doc[:-2])
        _, inverse, count = np.unique(_in_doc(windows(found.hashes(), 3)[whole], doc[whole]), return_inverse=True, return_counts=True)
        again = whole[count[inverse] > 1]
        np.add.at(repeat, again, 1)
        np.add.at(repeat, again + 3, -1)
    repeat_words = np.bincount(doc, np.cumsum(repeat)[:-1] > 0, n).astype(np.int64)
    return [found.count, word_chars, symbols, dup_lines, repeat_words]


def measure_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the MEASURES (longs), failed_ and each of the RULES, and base_failed to ``docs``, without ``text_col``, in one pass.

    Input columns with those names are replaced.
    """
    drop = {*MEASURES, *(f"failed_{r}" for r in RULES), "base_failed"}
    kept = docs.select([docs[c] for c in docs.columns if c not in drop])
    at = kept.columns.index(text_col)
    rest = [i for i in range(len(kept.columns)) if i != at]
    schema = T.StructType([*[kept.schema.fields[i] for i in rest], *[T.StructField(m, T.LongType()) for m in MEASURES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure(data, offsets) for _, data, offsets in chunks(batch.column(at))]
            made = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True)] if parts else [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], *made], names=[f.name for f in schema])

    few = F.col("n_words") < MIN_WORDS
    repeated = 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    symbols = SYMBOL_SHARE * F.col("n_symbols") > F.col("word_chars")
    lines = LINE_SHARE * F.col("n_dup_lines") > F.col("n_words")
    failed = {f"failed_{r}": c for r, c in zip(RULES, (few, repeated, symbols, lines), strict=True)}
    return kept.mapInArrow(frugal(run), schema).withColumns({**failed, "base_failed": few | repeated})


def judge_hosts(measured: DataFrame, host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row for each non-null host: n_docs, and for each rule n_failed_, rate_ (shrunk), limit_, and host_rejected.

    ``limit``: the highest limit of any rule.
    """
    failed = [F.sum(F.col(f"failed_{r}").cast("long")).alias(f"n_failed_{r}") for r in RULES]
    hosts = measured.filter(F.col(host_col).isNotNull()).groupBy(host_col).agg(F.count(F.lit(1)).alias("n_docs"), *failed)
    rate = lambda r: F.col(f"n_failed_{r}") / F.col("n_docs")
    prior = hosts.agg(*[f(rate(r)).alias(f"{name}_{r}") for r in RULES for name, f in (("mean", F.avg), ("var", F.var_pop))])  # one row
    judged = hosts.join(F.broadcast(prior))
    for r in RULES:
        mean, var = F.col(f"mean_{r}"), F.col(f"var_{r}")
        weight = F.when(var > 0, mean * (1 - mean) / var - 1).otherwise(F.lit(PRIOR_WEIGHT[1]))
        weight = F.least(F.greatest(weight, F.lit(PRIOR_WEIGHT[0])), F.lit(PRIOR_WEIGHT[1]))
        far = mean + DEVIATIONS * F.sqrt(mean * (1 - mean) / (weight + 1))
        judged = judged.withColumns({
            f"rate_{r}": F.round((mean * weight + F.col(f"n_failed_{r}")) / (weight + F.col("n_docs")), 9),
            f"limit_{r}": F.round(F.least(F.greatest(far, F.lit(LEAST_LIMIT)), F.lit(limit)), 9),
        })
    rejected = functools.reduce(lambda x, y: x | y, [F.col(f"rate_{r}") > F.col(f"limit_{r}") for r in RULES])
    return judged.select(host_col, "n_docs", *[f"{n}_{r}" for r in RULES for n in ("n_failed", "rate", "limit")], rejected.alias("host_rejected"))


def apply_rules(docs: DataFrame, text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """``docs`` without its text, with the MEASURES, the failed rules, base_failed, host_rejected and kept."""
    measured = materialize(measure_documents(docs, text_col), "rules")
    hosts = materialize(judge_hosts(measured, host_col, limit).select(F.col(host_col).alias("__host"), "host_rejected"), "hosts")
    if hosts.count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    joined = measured.drop("host_rejected", "kept").join(hosts, F.col(host_col) == F.col("__host"), "left").drop("__host")
    return joined.withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False))).withColumn("kept", ~(F.col("base_failed") | F.col("host_rejected")))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return apply_rules(docs).select("doc_id", *MEASURES, "base_failed", "kept")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), again AS (
  SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) >= 2
), rep AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid
), lines AS (
  SELECT rid, line FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid
), m AS (
  SELECT d.rid, doc_id, source, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid)
), f AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m
), failures AS (
  SELECT source, 1 AS rule, n_words < 50 AS failed FROM m WHERE source IS NOT NULL
  UNION ALL SELECT source, 2, 100 * n_repeat_words > 50 * n_words FROM m WHERE source IS NOT NULL
  UNION ALL SELECT source, 3, 10 * n_symbols > word_chars FROM m WHERE source IS NOT NULL
  UNION ALL SELECT source, 4, 20 * n_dup_lines > n_words FROM m WHERE source IS NOT NULL
), h AS (
  SELECT source, rule, count(*) AS n, sum(failed::INT) AS bad FROM failures GROUP BY source, rule
), p AS (
  SELECT rule, avg(bad / n) AS mean, var_pop(bad / n) AS var FROM h GROUP BY rule
), q AS (
  SELECT rule, mean, least(greatest(CASE WHEN var > 0 THEN mean * (1 - mean) / var - 1 ELSE 1000.0 END, 2.0), 1000.0) AS weight FROM p
), v AS (
  SELECT source, bool_or(round((mean * weight + bad) / (weight + n), 9)
           > round(least(greatest(mean + 3.0 * sqrt(mean * (1 - mean) / (weight + 1)), 0.35), 0.5), 9)) AS rejected
  FROM h JOIN q USING (rule) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR coalesce(rejected, false)) AS kept
FROM f LEFT JOIN v USING (source)
"""
