"""Text files of a directory tree, as a DataFrame (file_path, rel_path, content)."""

from __future__ import annotations

import mimetypes
import os
import re
from collections.abc import Iterator
from fnmatch import translate
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from .globs import Globs

#: Subtypes of ``application`` that are text all the same.
TEXT_APPLICATIONS = {
    "json", "manifest+json", "n-quads", "n-triples", "trig", "vnd.apple.mpegurl", "xml",
    "x-csh", "x-latex", "x-sh", "x-tcl", "x-tex", "x-texinfo", "x-troff", "x-troff-man", "x-troff-me", "x-troff-ms",
}
#: Extensions that the media types lack: archives, databases, compiled code, fonts, models and column files.
MORE_BINARY_EXTENSIONS = (
    ".7z", ".bz2", ".gz", ".lz4", ".rar", ".tgz", ".xz", ".zst",
    ".db", ".sqlite", ".class", ".dylib", ".jar", ".lib",
    ".docx", ".pptx", ".xlsx", ".eot", ".otf", ".ttf", ".woff", ".woff2", ".flac", ".mkv",
    ".arrow", ".gguf", ".npy", ".npz", ".onnx", ".parquet", ".pkl", ".pt", ".pth", ".safetensors",
)


def binary_extensions() -> list[str]:
    """Extensions whose media type is no text, and MORE_BINARY_EXTENSIONS; other binary files are found by their bytes."""
    found = set(MORE_BINARY_EXTENSIONS)
    for extension, kind in mimetypes.MimeTypes(filenames=()).types_map[True].items():
        main, sub = kind.split("/")
        if main in ("audio", "font", "image", "video") or (main == "application" and sub not in TEXT_APPLICATIONS):
            found.add(extension)
    return sorted(found)


BINARY_EXTENSIONS = binary_extensions()
SKIPPED_FOLDERS = ("__pycache__", "node_modules", "venv")  # and all hidden ones
SNIFF_BYTES = 8192
FILES_PER_PARTITION = 200
#: Entries that a task lists before it hands folders on, and names of one batch of its output.
ENTRIES_PER_TASK, LISTED_PER_BATCH = 20_000, 4096


def ignore_patterns(text: str) -> list[str]:
    """Patterns of an ignore file: no comments, no blank lines, no closing slashes."""
    return [line.strip().rstrip("/") for line in text.splitlines() if line.strip() and not line.strip().startswith("#")]


def hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\.")


def in_skipped_folder(path: Column) -> Column:
    return path.rlike("(^|/)(" + "|".join(map(re.escape, SKIPPED_FOLDERS)) + ")/")


def binary_name(path: Column) -> Column:
    return F.lower(path).rlike("(" + "|".join(map(re.escape, BINARY_EXTENSIONS)) + ")$")


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the path, its name, or a folder above it matches a glob (no negation, no anchors)."""
    parts = [translate(p).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z") for p in patterns]
    if not parts:
        return F.lit(False)
    return path.rlike("(?s)^(?:.*/)?(?:" + "|".join(parts) + ")(?:/.*)?$")


def root_patterns(root: str) -> list[str]:
    """The patterns of the ignore file at the root, if there is one."""
    try:
        with open(os.path.join(root, ".gitignore"), errors="replace") as f:
            return ignore_patterns(f.read())
    except FileNotFoundError:
        return []


def list_folder(root: str, rel: str, state: int, globs: Globs) -> Iterator[tuple[str, int | None]]:
    """What a folder holds: (path below the root, None) of each file that its name lets through, (path, state) of each folder to enter.

    ``state`` is where the globs stand after the folder's own path, so that only names are read. Links to folders are
    not followed, folders that cannot be read hold nothing.
    """
    try:
        entries = sorted(os.scandir(os.path.join(root, rel)), key=lambda e: e.name)
    except OSError:
        return
    inside = globs.step(state, "/") if rel else state
    for e in entries:
        after = globs.step(inside, e.name)
        if e.name.startswith(".") or globs.accepts(after) or globs.match(e.name):
            continue
        path = f"{rel}/{e.name}" if rel else e.name
        if e.is_dir():
            if e.name not in SKIPPED_FOLDERS and not e.is_symlink():
                yield path, after
        elif e.is_file() and os.path.splitext(e.name)[1].lower() not in BINARY_EXTENSIONS:
            yield path, None


def list_files(spark: SparkSession, root: str, per_task: int = ENTRIES_PER_TASK) -> DataFrame:
    """(rel_path) of the files below ``root``, listed by tasks in rounds.

    The frontier is a table of folders. A task goes down from its folders until it has met ``per_task`` entries; the
    folders that it has not entered by then are the next round's frontier, dealt to all tasks anew. So a small tree takes one
    round, and a deep or a wide one is spread. Each round is written to the shared folder; the driver sees whether
    folders are left, never a name.
    """
    patterns = root_patterns(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        globs = Globs(patterns)
        seen = 0
        for rows in batches:
            for folder, state in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                waiting = [(folder, int(state, 16))]
                names, states = [], []
                while waiting:
                    path, at = waiting.pop()
                    if seen >= per_task:
                        names.append(path)
                        states.append(f"{at:x}")
                        continue
                    for found, after in list_folder(root, path, at, globs):
                        seen += 1
                        if after is not None:
                            waiting.append((found, after))
                        else:
                            names.append(found)
                            states.append(None)
                        if len(names) >= LISTED_PER_BATCH:
                            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(states, pa.string())], names=["rel_path", "state"])
                            names, states = [], []
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(states, pa.string())], names=["rel_path", "state"])

    schema = "rel_path string, state string"
    frontier = spark.createDataFrame([("", f"{Globs(patterns).start:x}")], schema)
    rounds = []
    while True:
        found = shared.written(frontier.mapInArrow(run, schema), "listing")
        rounds.append(found.filter("state IS NULL").select("rel_path"))
        folders = found.filter("state IS NOT NULL")
        left = folders.count()
        if not left:
            return reduce(DataFrame.unionAll, rounds)
        frontier = folders.repartition(min(left, max(1, spark.sparkContext.defaultParallelism) * 4))


def read_files(paths: DataFrame, root: str) -> DataFrame:
    """(file_path, rel_path, content) of the text files at ``paths`` (rel_path): no zero byte near their beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for rel in rows.column(0).to_pylist():
                path = os.path.join(root, rel)
                try:
                    with open(path, "rb") as f:
                        data = f.read()
                except OSError:
                    continue
                if b"\0" not in data[:SNIFF_BYTES]:
                    columns = [pa.array([x], pa.string()) for x in (path, rel, data.decode(errors="replace"))]
                    yield pa.RecordBatch.from_arrays(columns, names=["file_path", "rel_path", "content"])

    return paths.mapInArrow(run, "file_path string, rel_path string, content string")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Readable text files below ``root``, without hidden, skipped, ignored and binary ones.

    Spark's own file sources leave out names that begin with an underscore, which source trees have.
    """
    root = re.sub("^file:/*", "/", root).rstrip("/") or "/"
    paths = list_files(spark, root)
    parts = max(spark.sparkContext.defaultParallelism, -(-paths.count() // FILES_PER_PARTITION))
    return read_files(paths.repartition(parts), root)
