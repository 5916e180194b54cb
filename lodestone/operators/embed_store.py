"""Embeddings that survive a killed run: a store keyed by the hash of what was embedded.

A key is the SHA-256 of model, task and text, so equal texts are sent once, and a text that changes or another
model gets a new key. ``fill`` sends what the store lacks (an anti join by key): texts are dealt by bucket of
their key, each task sends batches in order of the keys, and writes a file of vectors, made under a hidden name and
then renamed, after each ``per_file`` texts. So the work of a task that dies is lost from its last file on
only: its next attempt, or the next run, reads the keys of the bucket's files and sends the rest.

A null text counts as empty. Two attempts of one task can run at once and both store a vector of a key; readers
take one of each key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from .embedding import BATCH, Provider, vectors_of

#: Texts of one file of vectors, and so the most that a lost task has sent in vain.
PER_FILE = 1024
#: Buckets of a store; each is one task's share at least.
BUCKETS = 256
SCHEMA = "key string, vec array<float>, bucket int"
_FILE = pa.schema([("key", pa.string()), ("vec", pa.list_(pa.float32()))])


def key_of(text: Column, model: str, task: str = "document") -> Column:
    return F.sha2(F.concat(F.lit(f"{model}\0{task}\0"), F.coalesce(text, F.lit(""))), 256)


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return shared.place(uri if "://" in uri or uri.startswith("file:/") else f"file://{uri}")


def _stored_keys(uri: str, bucket: int) -> set[str]:
    """Keys of one bucket's files; for tasks."""
    system, folder = _place(f"{uri}/bucket={bucket}")
    files = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    keys: set[str] = set()
    for f in files:
        if f.type == fs.FileType.File and not f.base_name.startswith("."):
            keys.update(pq.read_table(f.path, filesystem=system, columns=["key"], schema=_FILE).column(0).to_pylist())
    return keys


def _write(uri: str, bucket: int, keys: list[str], vectors: list[list[float]]) -> None:
    """One file, whole or not at all; equal keys have an equal name, so a second attempt replaces it."""
    system, folder = _place(f"{uri}/bucket={bucket}")
    system.create_dir(folder, recursive=True)
    name = hashlib.sha256("".join(keys).encode()).hexdigest()[:32]
    pq.write_table(pa.Table.from_arrays([pa.array(keys), pa.array(vectors, pa.list_(pa.float32()))], schema=_FILE), f"{folder}/.{name}", filesystem=system)
    system.move(f"{folder}/.{name}", f"{folder}/{name}.parquet")


class EmbeddingStore:
    """Vectors by key in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def vectors(self) -> DataFrame:
        """(key, vec), one row a key; empty before the first fill."""
        system, folder = _place(self.path)
        system.create_dir(folder, recursive=True)
        found = self.spark.read.schema(SCHEMA).option("basePath", self.path).parquet(self.path)
        return found.groupBy("key").agg(F.first("vec").alias("vec"))

    def missing(self, texts: DataFrame, model: str, text_col: str = "content", task: str = "document") -> DataFrame:
        """(key, text) of each distinct text that has no vector yet."""
        asked = texts.select(key_of(F.col(text_col), model, task).alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
        return asked.groupBy("key").agg(F.first("text").alias("text")).join(self.vectors().select("key"), "key", "left_anti")

    def fill(self, texts: DataFrame, provider: Provider, text_col: str = "content", task: str = "document", batch: int = BATCH, per_file: int = PER_FILE) -> int:
        """Embed what is missing; return the number of texts sent by the attempts that ended well."""
        uri, buckets = self.path, self.buckets
        step = max(batch, per_file // batch * batch)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bucket, stored, keys, waiting = None, set(), [], []

            def send() -> int:
                if not keys:
                    return 0
                vectors = [v for a in range(0, len(keys), batch) for v in vectors_of(provider, waiting[a : a + batch], task)]
                _write(uri, bucket, keys, vectors)
                n = len(keys)
                keys.clear()
                waiting.clear()
                return n

            sent = 0
            for rows in batches:
                for b, key, text in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                    if b != bucket:
                        sent += send()
                        bucket, stored = b, _stored_keys(uri, b)
                    if key in stored:
                        continue
                    keys.append(key)
                    waiting.append(text)
                    if len(keys) == step:
                        sent += send()
            sent += send()
            yield pa.RecordBatch.from_arrays([pa.array([sent], pa.int64())], names=["sent"])

        bucket = F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
        dealt = self.missing(texts, provider.model_id, text_col, task).select(bucket.alias("bucket"), "key", "text")
        dealt = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "key")
        return dealt.mapInArrow(run, "sent long").agg(F.coalesce(F.sum("sent"), F.lit(0))).first()[0]

    def attach(self, df: DataFrame, model: str, text_col: str = "content", vec_col: str = "vec", task: str = "document") -> DataFrame:
        """``df`` with the stored vector of its text, null where there is none."""
        stored = self.vectors().select(F.col("key").alias("__key"), F.col("vec").alias("__vec"))
        keyed = df.drop("__key", "__vec", vec_col).withColumn("__k", key_of(F.col(text_col), model, task))
        return keyed.join(stored, F.col("__k") == F.col("__key"), "left").withColumn(vec_col, F.col("__vec")).drop("__k", "__key", "__vec")


def embed_stored(df: DataFrame, provider: Provider, path: str, text_col: str = "content", vec_col: str = "vec", batch: int = BATCH, buckets: int = BUCKETS) -> DataFrame:
    """Like ``embed``, but through the store at ``path``: what an earlier run stored is not sent again."""
    store = EmbeddingStore(df.sparkSession, path, buckets)
    store.fill(df, provider, text_col, batch=batch)
    return store.attach(df, provider.model_id, text_col, vec_col)
