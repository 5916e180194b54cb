"""Operator 9: unigram token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a word between spaces with a leading ``▁``. Its tokens are the split into vocabulary
pieces with the best total score (the fewest pieces among equals). The forward score of a position
depends on the letters before it only, so pre-tokens with a common prefix share it: the distinct
pre-tokens of a shard are put in order, which walks their trie depth first, and each node's score is
computed once; only the path to the current node is kept. Terminal nodes give the counts, which are
added up for each document.

The vocabulary file has no unigram scores, and tokenizers are not trained here; a piece's score is the
logarithm of Zipf's law over its rank in the file. A character without a piece counts as its UTF-8 bytes.

A null, empty or blank text has no pre-tokens and no tokens. Repeated rows are counted each. There is no
shuffle; memory is bounded by ``SHARD_WORDS`` and by the longest text. Output columns replace input
columns of the same names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .words import chunks, frugal, spaces_table, words

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
SHARD_WORDS = 1_000_000
#: Score of one byte of a character that has no piece.
BYTE_SCORE = -20.0
_TABLE = spaces_table(fold=False)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def load_pieces(path: str) -> dict[str, float]:
    """Ordinary pieces of a sentencepiece file, with their scores by rank."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = sum(1 / (r + 1) for r in range(len(pieces)))
    return {p: -math.log((r + 1) * total) for r, p in enumerate(pieces)}


class UnigramTrie:
    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)

    def counts(self, pretokens: list[str]) -> list[int]:
        """Number of tokens of each of the distinct ``pretokens``, which must be in order."""
        out = []
        best, tokens = [0.0], [0]  # along the path from the root
        before = ""
        get, longest = self.pieces.get, self.longest
        for word in pretokens:
            depth = 0
            for a, b in zip(before, word):  # noqa: B905
                if a != b:
                    break
                depth += 1
            del best[depth + 1 :], tokens[depth + 1 :]
            for end in range(depth + 1, len(word) + 1):
                top, n = -math.inf, 0
                for start in range(max(0, end - longest), end):
                    score = get(word[start:end])
                    if score is not None:
                        score += best[start]
                        if score > top or (score == top and tokens[start] + 1 < n):
                            top, n = score, tokens[start] + 1
                if n == 0:  # no piece ends here: the character's bytes
                    size = len(word[end - 1].encode())
                    top, n = best[end - 1] + size * BYTE_SCORE, tokens[end - 1] + size
                best.append(top)
                tokens.append(n)
            out.append(tokens[-1])
            before = word
        return out


_tries: dict[int, UnigramTrie] = {}


def _count_shard(trie: UnigramTrie, held: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens and tokens of each text of a shard."""
    hashes, numbers, texts = [], [], {}
    for values in held:
        for _, data, offsets in chunks(values):
            found = words(data, offsets, _TABLE)
            h = found.hashes()
            hashes.append(h)
            numbers.append(found.count)
            unique, first = np.unique(h, return_index=True)
            raw = data.tobytes()
            for key, a, b in zip(unique.tolist(), found.start[first].tolist(), found.end[first].tolist(), strict=True):
                if key not in texts:
                    texts[key] = SPACE + raw[a:b].decode()
    by_text = sorted(texts.items(), key=lambda x: x[1])
    keys = np.array([k for k, _ in by_text], np.uint64)
    counts = np.array(trie.counts([t for _, t in by_text]), np.int64)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    n_words = np.concatenate(numbers)
    every = np.concatenate(hashes)
    total = np.zeros(len(every) + 1, np.int64)
    if len(every):
        np.cumsum(counts[np.searchsorted(keys, every)], out=total[1:])
    ends = np.cumsum(n_words)
    return n_words, total[ends] - total[ends - n_words]


def count_tokens(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``docs`` without its text, with n_pretokens and n_tokens. ``vocabulary``: a path on the driver."""
    new = ["n_pretokens", "n_tokens"]
    kept = docs.select([docs[c] for c in docs.columns if c not in new])
    at = kept.columns.index(text_col)
    rest = [i for i in range(len(kept.columns)) if i != at]
    schema = T.StructType([*[kept.schema.fields[i] for i in rest], *[T.StructField(n, T.LongType()) for n in new]])
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(vocabulary or default_vocabulary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = id(shared.value)
        if key not in _tries:
            _tries.clear()
            _tries[key] = UnigramTrie(shared.value)

        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n_words, n_tokens = _count_shard(_tries[key], [b.column(at) for b in held])
            row = 0
            for b in held:
                part = slice(row, row + b.num_rows)
                row += b.num_rows
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in rest], pa.array(n_words[part].astype(np.int64)), pa.array(n_tokens[part])], names=[f.name for f in schema])

        held, size = [], 0
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                held.append(batch)
                size += batch.column(at).nbytes // 6  # about so many words
                if size >= SHARD_WORDS:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return kept.mapInArrow(frugal(run), schema)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs)
