"""Chunks of source files: whole small files, groups of definitions, or overlapping line windows."""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHARS, OVERLAP_LINES, PREVIEW_CHARS = 4000, 5, 100
CHUNK = "file_path string, start_line int, end_line int, content string, preview string"

class Grammar(NamedTuple):
    """Words that may stand before a definition, in any number and order, and words that begin one."""

    modifiers: tuple[str, ...]
    keywords: tuple[str, ...]

    @property
    def pattern(self) -> str:
        """Matches a line that begins a definition at its first column; a modifier may have an argument, as in ``pub(crate)`` or ``extern "C"``."""
        argument = r"""(?:\([^()]*\)|\s+"[^"]*")?"""
        return f"^(?:(?:{'|'.join(self.modifiers)}){argument}\\s+)*(?:{'|'.join(self.keywords)})[\\s*]"


# Items of the language references: Rust's items that have a body or a value, declarations of ECMAScript and
# TypeScript that make a scope or a type.
RUST = Grammar(
    modifiers=("pub", "default", "const", "async", "unsafe", "safe", "extern"),
    keywords=("const", "enum", "fn", "impl", "macro_rules!", "mod", "static", "struct", "trait", "type", "union"),
)
SCRIPT = Grammar(modifiers=("export", "default", "async"), keywords=("class", "function"))
TYPED = Grammar(modifiers=(*SCRIPT.modifiers, "abstract", "declare", "const"), keywords=(*SCRIPT.keywords, "enum", "interface", "namespace", "type"))
GRAMMARS = {".rs": RUST, ".js": SCRIPT, ".jsx": SCRIPT, ".mjs": SCRIPT, ".cjs": SCRIPT, ".ts": TYPED, ".tsx": TYPED, ".mts": TYPED}


def preview(content: Column) -> Column:
    return F.trim(F.translate(F.substring(content, 1, PREVIEW_CHARS), "\n", " "))


def small_chunks(files: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Files of at most ``max_chars`` characters, one chunk each; blank ones have none."""
    content = F.col("content")
    small = files.filter(content.rlike(r"\S") & (F.length(content) <= max_chars))
    return small.select("file_path", F.lit(1).alias("start_line"), F.size(F.split(content, "\n", -1)).alias("end_line"), "content", preview(content).alias("preview"))


def definition_lines(files: DataFrame, suffix: str) -> DataFrame:
    """(file_path, line): 1-based lines that begin a definition in languages told by pattern."""
    lines = files.select("file_path", F.posexplode(F.split("content", "\n", -1)).alias("pos", "text"))
    return lines.filter(F.col("text").rlike(GRAMMARS[suffix].pattern)).select("file_path", (F.col("pos") + 1).alias("line"))


def parsed_definition_lines(files: DataFrame) -> DataFrame:
    """(file_path, line): 1-based lines of the top-level definitions of Python sources; none where they cannot be parsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(path, line + 1) for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for line in boundaries(text or "", ".py")]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32())], names=["file_path", "line"])

    return files.select("file_path", "content").mapInArrow(run, "file_path string, line int")


def boundaries(text: str, suffix: str) -> list[int]:
    """0-based lines that begin top-level definitions; none if the text cannot be parsed."""
    if suffix == ".py":
        try:
            body = ast.parse(text).body
        except (SyntaxError, ValueError):
            return []
        return sorted(n.lineno - 1 for n in body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef))
    if suffix not in GRAMMARS:
        return []
    begins = re.compile(GRAMMARS[suffix].pattern).match
    return [i for i, line in enumerate(text.split("\n")) if begins(line + "\n")]


def definition_spans(lines: list[str], starts: list[int], max_chars: int) -> Iterator[tuple[int, int, str]]:
    """(first line, end line, text) of groups of definitions, 0-based: as many whole ones as fit.

    Text before the first definition leads the first group. End lines are those of the source; blank
    lines that end a definition are left out of the text.
    """
    cuts = [0, *starts] if "\n".join(lines[: starts[0]]).strip() else starts
    pieces = [(a, b, "\n".join(lines[a:b]).rstrip()) for a, b in zip(cuts, [*cuts[1:], len(lines)], strict=True) if a < b]
    group: list[tuple[int, int, str]] = []
    for piece in pieces:
        if group and sum(len(t) + 1 for _, _, t in group) + len(piece[2]) > max_chars:
            yield group[0][0], group[-1][0] + group[-1][2].count("\n") + 1, "\n".join(t for _, _, t in group)
            group = []
        group.append(piece)
    if group:
        yield group[0][0], group[-1][0] + group[-1][2].count("\n") + 1, "\n".join(t for _, _, t in group)


def window_spans(lines: list[str], max_chars: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """Windows of lines that reach ``max_chars``, the last line included, each beginning ``overlap`` lines back."""
    total = [0, *accumulate(len(line) + 1 for line in lines)]
    begin = 0
    while True:
        end = min(max(bisect_left(total, total[begin] + max_chars), begin + 1), len(lines))
        yield begin, end, "\n".join(lines[begin:end])
        if end >= len(lines):
            return
        begin += max(1, end - begin - overlap)


def large_chunks(files: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_LINES) -> DataFrame:
    """Chunks of longer files: groups of definitions where there are any, else windows of lines."""
    content = F.col("content")
    large = files.filter(content.rlike(r"\S") & (F.length(content) > max_chars)).select("file_path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = text.split("\n")
                dot = path.rfind(".")
                starts = boundaries(text, path[dot:].lower() if dot > path.rfind("/") else "")
                spans = definition_spans(lines, starts, max_chars) if starts else window_spans(lines, max_chars, overlap)
                for begin, end, part in spans:
                    for column, value in zip(out, (path, begin + 1, end, part), strict=True):
                        column.append(value)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["file_path", "start_line", "end_line", "content"])

    made = large.mapInArrow(run, "file_path string, start_line int, end_line int, content string")
    return made.withColumn("preview", preview(F.col("content")))


def chunk_files(files: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_LINES) -> DataFrame:
    """All chunks of ``files`` (file_path, content)."""
    return small_chunks(files, max_chars).unionByName(large_chunks(files, max_chars, overlap))


def line_range(start: str = "start_line", end: str = "end_line") -> Column:
    return F.concat_ws("-", F.col(start).cast("string"), F.col(end).cast("string"))
