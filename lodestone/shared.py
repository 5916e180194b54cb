"""The folder that the driver and all executors share: tables written there, and read by tasks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession

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


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage is cut, and lost executors take nothing with them."""
    path = path or new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it; for tasks."""
    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))


def table(path: str) -> ds.Dataset:
    """A written table; for tasks."""
    where, inner = place(path)
    return ds.dataset(inner, filesystem=where, format="parquet")


def batches(path: str, columns: list[str] | None = None, where: ds.Expression | None = None) -> Iterator[pa.RecordBatch]:
    """Its rows, one group of a file after the other, so that a task holds one part of it at a time."""
    for fragment in sorted(table(path).get_fragments(), key=lambda f: f.path):
        for group in fragment.split_by_row_group(where):
            yield from group.to_batches(columns=columns, filter=where, batch_size=1024 if columns else 1, batch_readahead=0, fragment_readahead=0, use_threads=False)
