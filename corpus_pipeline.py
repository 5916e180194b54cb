"""A corpus pipeline: language ID, near-duplicate removal, decontamination, sanitisation, tokens.

Each stage takes all its predecessor kept and returns the columns of ``documents``; the last adds
n_tokens and token_ids (with ``_`` appended where the documents have such columns). A stage's result is
written as Parquet in the shared folder and read again. Nulls in any column and empty tables pass through the
stages as their operators define. Extra columns of any name and type come out as they went in: a stage gives
them names of its own while it works.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, jaccard_join, langid, pii
from lodestone.llm.spark_io import bloom_blocks, bloom_mark, materialize


USED = ("doc_id", "text", "lang")


class _Apart:
    """``docs`` with the columns that no stage uses renamed, so that they cannot meet a stage's own columns."""

    def __init__(self, docs: DataFrame):
        self.columns = docs.columns
        self.names = [c if c in USED else f"__column_{i}" for i, c in enumerate(docs.columns)]
        self.docs = docs.toDF(*self.names)

    def back(self, df: DataFrame, *more: Column) -> DataFrame:
        return df.select(*[F.col(n).alias(c) for n, c in zip(self.names, self.columns, strict=True)], *more)

    def recount(self, df: DataFrame, changed: Column) -> DataFrame:
        """The columns as they were, but n_chars of changed texts."""
        if "n_chars" in self.columns:
            name = self.names[self.columns.index("n_chars")]
            df = df.withColumn(name, F.when(changed, F.length("text").cast(self.docs.schema[name].dataType)).otherwise(F.col(name)))
        return self.back(df)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter, and those that no learned language explains."""
    apart = _Apart(docs)
    samples = langid.learn_samples(docs.filter(~langid.held_out()))
    return apart.back(langid.identify_language(apart.docs, samples).filter(~langid.rejected()))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each class, and one row of it.

    A document is an id and a text (128 bits of hash): rows that share an id only are not merged. Of its repeated
    rows the one with the least hash of all columns (as JSON) stays. Documents to drop pass a bounded Bloom filter over
    the documents; only its hits are shuffled, to be matched exactly. A document without an id cannot be named and stays.
    """
    apart = _Apart(docs)
    names = apart.names
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h0"), F.xxhash64(F.lit(1), "text").alias("h1"))
    keyed = apart.docs.withColumn("__key", F.when(F.col("doc_id").isNotNull(), key))
    linked = jaccard_join.link_documents(keyed.select("__key", "text"), "__key")
    doubtful = (
        linked.filter(F.col("__key").isNotNull())
        .groupBy("__key")
        .agg(F.count(F.lit(1)).alias("__rows"), F.min(F.coalesce(F.col("component_id") == F.col("__key"), F.lit(True))).alias("__first"))
        .filter((F.col("__rows") > 1) | ~F.col("__first"))
        .withColumnRenamed("__key", "__id")
    )
    doubtful = materialize(doubtful, "copies")
    table, blocks = bloom_blocks(doubtful, "__id", doubtful.count())
    marked = bloom_mark(keyed, "__key", table, blocks, "__maybe")
    maybe = F.col("__maybe") & F.col("__key").isNotNull()
    sure = marked.filter(~maybe).select(*names)
    looked_up = marked.filter(maybe).join(doubtful, F.col("__key") == F.col("__id"), "left")
    single = looked_up.filter(F.col("__id").isNull()).select(*names)
    whole = F.struct(*names)
    least = F.min_by(whole, F.xxhash64(F.to_json(whole)))  # combined before the shuffle, however often a row repeats
    repeated = looked_up.filter(F.col("__first")).groupBy("__key").agg(least.alias("__row")).select(*[F.col("__row")[n].alias(n) for n in names])
    return apart.back(sure.unionByName(single).unionByName(repeated))


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove benchmark passages from the texts; a text that is nothing else goes."""
    apart = _Apart(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_contamination(apart.docs, benchmark, clean_col="text")
    found = found.filter((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words")))
    return apart.recount(found, F.col("n_hit") > 0)


def sanitise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data, and generalise or remove the terms that reveal it."""
    apart = _Apart(docs)
    found = pii.sanitise(apart.docs, clean_col="text")
    return apart.recount(found, F.size("pii_spans") > 0)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the number of tokens and their ids, packed as little-endian 32-bit integers."""
    apart = _Apart(docs)

    def free(name: str) -> str:
        while name in docs.columns:
            name += "_"
        return name

    tokens = (F.octet_length("token_ids") / 4).cast("long").alias(free("n_tokens"))
    return apart.back(bpe.bpe_encode(apart.docs), tokens, F.col("token_ids").alias(free("token_ids")))


STAGES = [
    ("language_id", keep_known_languages),
    ("jaccard_join", keep_one_of_near_copies),
    ("decontamination", cut_benchmark_passages),
    ("pii", sanitise_personal_data),
    ("bpe", encode_tokens),
]

#: Language ID and the encoder are learned models and vocabularies that SQL cannot express; the result is
#: tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
