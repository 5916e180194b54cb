"""Shared-folder tables and a bounded blocked Bloom filter, as DataFrame operations."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A Bloom block is one long, so a key is looked up by one read and one comparison.
BITS_PER_KEY = 24
PROBES = 4
#: The filter never has more blocks than this (2 MB of longs), whatever the list's size, so that
#: broadcasting it is safe; a longer list raises the false positive rate only.
MAX_BLOCKS = 1 << 18
#: The folder of our own in local mode, once it is needed.
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own where none is set and all runs in this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[0-9*, ]+\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all of {master} shares")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="lodestone-"))
        folder = _own[0]
    return folder.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` wrote and no plan needs any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if name.startswith(shared_dir(spark).replace("file://", "file:")) or name.startswith(shared_dir(spark)):
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bloom_blocks(keys: DataFrame, key: str, count: int) -> tuple[DataFrame, int]:
    """Blocked Bloom filter of ``keys[key]``: a table (block, bits) and its number of blocks.

    ``count`` is the number of keys. The table is at most ``MAX_BLOCKS`` rows.
    """
    blocks = 1
    while blocks < min(MAX_BLOCKS, max(1, count) * BITS_PER_KEY // 64 + 1):
        blocks *= 2
    hashed = keys.filter(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h"))
    table = hashed.select(_block(F.col("h"), blocks).alias("block"), _mask(F.col("h")).alias("bits")).groupBy("block").agg(F.bit_or("bits").alias("bits"))
    return table, blocks


def bloom_mark(df: DataFrame, key: str, table: DataFrame, blocks: int, flag: str) -> DataFrame:
    """Add boolean ``flag``: false only where ``df[key]`` is certainly not in the filter."""
    small = F.broadcast(table.toDF("__block", "__bits"))
    hashed = df.withColumn("__hash", F.xxhash64(key))
    marked = hashed.join(small, _block(F.col("__hash"), blocks) == F.col("__block"), "left")
    mask = _mask(F.col("__hash"))
    return marked.withColumn(flag, F.coalesce(F.col("__bits").bitwiseAND(mask) == mask, F.lit(False))).drop("__block", "__bits", "__hash")


def _block(h: Column, blocks: int) -> Column:
    """From the low bits."""
    return h.bitwiseAND(F.lit(blocks - 1)).cast("int")


def _mask(h: Column) -> Column:
    """PROBES bits of a long, from six high bits of the hash each."""
    one = F.lit(1).cast("long")
    mask = F.lit(0).cast("long")
    for probe in range(PROBES):
        at = F.shiftrightunsigned(h, 58 - 6 * probe).cast("int").bitwiseAND(F.lit(63))
        mask = mask.bitwiseOR(F.call_function("shiftleft", one, at))
    return mask
