"""Code search: discover, chunk, embed, keep as Parquet, and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import LoadError, ModelMismatch
from ..operators.chunking import MAX_CHARS, chunk_files, line_range
from ..operators.embed_store import BUCKETS, embed_stored
from ..operators.embedding import Provider, embed_query
from ..sources.code_files import discover
from .index import VectorIndex


def build(spark: SparkSession, root: str, store: str, provider: Provider, max_chars: int = MAX_CHARS, buckets: int = BUCKETS) -> DataFrame:
    """Write ``store``/chunks (chunk_id, location, preview, vec) and ``store``/meta; return meta.

    Vectors go through ``store``/vectors first, so that a run after a killed one, or after some files have changed,
    sends only the chunks that are new.
    """
    chunks = chunk_files(discover(spark, root), max_chars)
    embedded = embed_stored(chunks, provider, f"{store}/vectors", buckets=buckets).withColumn("chunk_id", F.xxhash64("file_path", "start_line"))
    embedded.drop("content").write.mode("overwrite").parquet(f"{store}/chunks")
    written = spark.read.parquet(f"{store}/chunks")
    meta = written.agg(F.lit(provider.model_id).alias("model"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("dims"), F.count(F.lit(1)).alias("num_chunks"))
    meta.write.mode("overwrite").parquet(f"{store}/meta")
    return spark.read.parquet(f"{store}/meta")


def load(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, meta); they must agree on the number of chunks."""
    chunks, meta = spark.read.parquet(f"{store}/chunks"), spark.read.parquet(f"{store}/meta")
    said, found = meta.first().num_chunks, chunks.count()
    if said != found:
        raise LoadError(f"the index says {said} chunks but has {found}")
    return chunks, meta


def format_results(result: DataFrame, chunks: DataFrame) -> DataFrame:
    """rank, file, lines, similarity, preview."""
    joined = result.join(chunks.select("chunk_id", "file_path", "start_line", "end_line", "preview"), result["row_id"] == F.col("chunk_id"))
    return joined.select("rank", F.col("file_path").alias("file"), line_range().alias("lines"), "similarity", "preview")


def search(spark: SparkSession, store: str, query: str, provider: Provider, k: int = 10) -> DataFrame:
    chunks, meta = load(spark, store)
    if (model := meta.first().model) != provider.model_id:
        raise ModelMismatch(f"the index is of model {model}, the query of {provider.model_id}")
    index = VectorIndex.from_dataframe(chunks, "vec", "chunk_id", enable_cache=False)
    return format_results(index.search([embed_query(query, provider)], k), chunks).orderBy("rank")
