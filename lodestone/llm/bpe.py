"""Operator 10: BPE encoding and decoding by forced-boundary splitting.

Two neighbouring symbols of a pre-token that stand side by side inside no vocabulary token can never
be merged over, so the place between them is a certain cut. Each pre-token is cut there, the fragments
are encoded on their own, and the ids are concatenated. Decoding joins the token strings.

Texts are cut into words (runs without white space) in chunks of whole texts, about ``CHUNK`` bytes each; a
chunk's distinct words are cut and encoded together with NumPy, the lowest-ranked pair of every fragment at a
time, and the ids of all words are put in place from them. Words of a chunk are told apart by 64-bit hashes and
their lengths. Long words, words with an apostrophe and texts with unusual characters take a path of their own
with bounded caches. Decoding gathers the bytes of the token strings.

Nulls count as empty texts; an empty text has no tokens and decodes to an empty text. Other columns of
the input pass through untouched. Order and number of rows stay as they are; repeated rows are encoded
each. There is no shuffle: one pass over the rows.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import chunks, frugal, spaces_table, words

VOCABULARY = "word_bpe_49k.json"
#: Entries of each of the two generations of a worker's caches.
CACHE = 100_000
#: Longest word, in bytes, that is encoded together with others or remembered.
SHORT = 64
END = "</w>"

# Characters on which NFC does nothing, white space is the same for every library, and lower-casing
# makes no combining mark; other texts go through the library's own normaliser and pre-tokeniser.
_PLAIN = re.compile("[^\t\n\x0b\x0c\r -~\xa0-įı-ɏ]")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_TABLE = spaces_table(fold=False)
_LETTER, _DIGIT, _OTHER = 0, 1, 2
_KINDS = {"L": _LETTER, "N": _DIGIT}
_KIND = np.array([_KINDS.get(unicodedata.category(chr(b))[0], _OTHER) if b < 128 else _OTHER for b in range(256)], np.uint8)
_LATIN_KIND = np.full((2, 256), _OTHER, np.uint8)  # by first and second byte, U+0080 to U+00FF
_LATIN_KIND[:, 128:192] = [[_KINDS.get(unicodedata.category(chr(64 * n + 128 + b))[0], _OTHER) for b in range(64)] for n in range(2)]


class _Cache:
    """What ``make`` gave for recent keys: a full generation becomes the old one, whose used entries move on."""

    def __init__(self, make: Callable):
        self.make = make
        self.new: dict = {}
        self.old: dict = {}

    def __call__(self, key):
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is None:
                value = self.make(key)
            if len(self.new) >= CACHE:
                self.old, self.new = self.new, {}
            self.new[key] = value
        return value


class ForcedBoundaryEncoder:
    """Encodes whole texts as the file's tokenizer does without added special tokens.

    Symbols are ids of the vocabulary; a pair of symbols is one integer, left << 16 | right.
    """

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.source = source
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.names = [names.get(i) for i in range(max(names) + 1)]
        self.pieces = _Pieces(self.names)
        letters = byte_alphabet()
        self.inner = {c: vocab[c] for c in letters.values()}
        self.final = {c: vocab[c + END] for c in letters.values()}
        self.bytes_to_symbols = {b: ord(c) for b, c in letters.items()}
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for merge in model["merges"]:
            left, right = merge.split(" ", 1) if isinstance(merge, str) else merge
            self.rank.setdefault(vocab[left] << 16 | vocab[right], len(self.merged))
            self.merged.append(vocab[left + right])
        self.joined: set[int] = set()
        for token in vocab:
            text = token.removesuffix(END)
            if text and all(c in self.inner for c in text):
                symbols = self.symbols(text) if text != token else [self.inner[c] for c in text]
                self.joined.update(a << 16 | b for a, b in zip(symbols, symbols[1:], strict=False))
        self.fragments = _Cache(self.encode_fragment)
        self.pretokens = _Cache(self.encode_pretoken)
        self._tables()
        self.library = None

    def _tables(self) -> None:
        """The same as arrays: ranks by sorted pairs; for pairs of bytes (the second may end its piece) direct tables."""
        pairs = np.array(list(self.rank), np.int64)
        order = np.argsort(pairs)
        self.pairs, self.ranks = pairs[order], np.array(list(self.rank.values()), np.int64)[order]
        self.results = np.array(self.merged, np.int64)
        letters = byte_alphabet()
        plain = [self.inner[letters[b]] for b in range(256)]
        self.byte_symbols = np.array([*plain, *[self.final[letters[b]] for b in range(256)]], np.int64)
        both = self.byte_symbols[:256, None] << 16 | self.byte_symbols[None, :]
        self.byte_ranks = self._rank(both.ravel()).reshape(both.shape)
        joined = np.sort(np.fromiter(self.joined, np.int64, len(self.joined)))
        self.byte_joined = _is_in(both, joined)

    def _rank(self, pairs: np.ndarray) -> np.ndarray:
        """Ranks of pairs; the number of merges for those without one."""
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, self.ranks[at], len(self.merged))

    def symbols(self, text: str) -> list[int]:
        """Symbols of a pre-token in the byte-level alphabet; the last one ends the word."""
        inner = self.inner
        out = [inner[c] for c in text]
        out[-1] = self.final[text[-1]]
        return out

    def cuts(self, symbols: list[int]) -> list[tuple[int, ...]]:
        """Fragments between forced boundaries."""
        joined, out, at = self.joined, [], 0
        for i in range(1, len(symbols)):
            if symbols[i - 1] << 16 | symbols[i] not in joined:
                out.append(tuple(symbols[at:i]))
                at = i
        out.append(tuple(symbols[at:]))
        return out

    def encode_fragment(self, fragment: Sequence[int]) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until no pair has a rank."""
        if len(fragment) > 64:
            return self.encode_long(fragment)
        none, rank = len(self.merged), self.rank
        parts = list(fragment)
        get, merged = rank.get, self.merged
        ranks = [get(a << 16 | b, none) for a, b in zip(parts, parts[1:], strict=False)]
        ranks.append(none)  # stands after the last symbol, so that the loop needs no bounds checks there
        while (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i] = new = merged[best]
            del parts[i + 1], ranks[i]
            if i + 1 < len(ranks):
                ranks[i] = get(new << 16 | parts[i + 1], none)
            if i:
                ranks[i - 1] = get(parts[i - 1] << 16 | new, none)
        return parts

    def encode_long(self, fragment: Sequence[int]) -> list[int]:
        """The same over a linked list with a heap, in n log n."""
        parts: list[int] = list(fragment)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        pair = lambda i: parts[i] << 16 | parts[after[i]]
        heap = [(self.rank[p], i, p) for i in range(len(parts) - 1) if (p := pair(i)) in self.rank]
        heapq.heapify(heap)
        while heap:
            rank, i, was = heapq.heappop(heap)
            if parts[i] < 0 or after[i] >= len(parts) or pair(i) != was:
                continue
            j = after[i]
            parts[i], parts[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(parts) and (p := pair(k)) in self.rank:
                    heapq.heappush(heap, (self.rank[p], k, p))
        return [p for p in parts if p >= 0]

    def encode_pretoken(self, text: str) -> list[int]:
        """``text``: one pre-token in the byte-level alphabet."""
        symbols = self.symbols(text)
        if self.joined.issuperset([a << 16 | b for a, b in zip(symbols, symbols[1:], strict=False)]):
            return self.encode_fragment(symbols)
        out: list[int] = []
        for fragment in self.cuts(symbols):
            if len(fragment) == 1:
                out += fragment
            else:
                out += self.fragments(fragment) if len(fragment) <= 64 else self.encode_long(fragment)
        return out

    def encode_word(self, word: bytes) -> bytes:
        """``word``: lower-cased text without white space."""
        ids: list[int] = []
        for piece in _PIECES.findall(word.decode()):
            text = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.bytes_to_symbols)
            ids += self.pretokens(text) if len(text) <= SHORT else self.encode_pretoken(text)
        return np.array(ids, "<u4").tobytes()

    def section(self, text: str) -> bytes:
        """A text without added tokens, by the library's own normaliser and pre-tokeniser."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.source)
        normal = self.library.normalizer.normalize_str(text)
        ids: list[int] = []
        for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal):
            ids += self.pretokens(piece) if len(piece) <= SHORT else self.encode_pretoken(piece)
        return np.array(ids, "<u4").tobytes()

    def encode_apart(self, text: str) -> bytes:
        """One text with added tokens or with characters beyond _PLAIN."""
        parts = self.split_added.split(text) if self.split_added else [text]
        done = [np.array([self.added[part]], "<u4").tobytes() if i % 2 else self.section(part) for i, part in enumerate(parts)]
        return b"".join(done)

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of each text (null: empty) as little-endian 32-bit integers."""
        out = [self._encode_chunk(texts.slice(first, len(offsets) - 1)) for first, _, offsets in chunks(texts)]
        return pa.concat_arrays(out) if out else pa.array([], pa.large_binary())

    def _encode_chunk(self, texts: pa.Array) -> pa.Array:
        apart: dict[int, bytes] = {}
        plain = texts.to_pylist()
        for i, text in enumerate(plain):
            if text and (_PLAIN.search(text) or (self.split_added and "<|" in text)):
                apart[i] = self.encode_apart(text)
                plain[i] = ""
            elif text:
                plain[i] = text.lower().replace("\xa0", " ")
        ids, ends = self._encode_plain(pa.array(plain, pa.large_string()))
        if apart:
            begins = [0, *ends.tolist()]
            ids = np.concatenate([np.frombuffer(apart[i], "<u4") if i in apart else ids[begins[i] : begins[i + 1]] for i in range(len(plain))])
            ends = ends + np.cumsum([len(apart.get(i, b"")) // 4 for i in range(len(plain))])
        return _binary(ids, ends * 4, pa.large_binary())

    def _encode_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of one chunk, and where each text's ids end."""
        all_ids, all_counts = [], []
        for _, data, offsets in chunks(texts):
            found = words(data, offsets, _TABLE)
            _, first, which = np.unique(found.hashes(), return_index=True, return_inverse=True)
            ids, sizes = self._encode_distinct(data, found.start[first], found.end[first])
            all_ids.append(ids[_places(np.cumsum(sizes) - sizes, sizes, which)])
            total = np.concatenate([[0], np.cumsum(sizes[which])])
            all_counts.append(total[found.first[1:]] - total[found.first[:-1]])
        if not all_ids:
            return np.empty(0, "<u4"), np.zeros(len(texts), np.int64)
        return np.concatenate(all_ids), np.cumsum(np.concatenate(all_counts))

    def _encode_distinct(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at ``start`` to ``end``, one word after the other, and how many each has."""
        size = end - start
        bytes_ = data[_places(start, size, np.arange(len(size)))]
        begin = np.cumsum(size) - size
        alone = size > SHORT
        if len(size):
            alone |= np.add.reduceat(bytes_ == ord("'"), begin) > 0
        first = np.zeros(len(bytes_), bool)
        first[begin] = True
        kind = _kinds(bytes_)
        # a piece begins with each word, where the kind of character changes, and at each digit
        piece = first | ((bytes_ & 0xC0) != 0x80) & ((kind == _DIGIT) | np.append(True, kind[1:] != kind[:-1])[: len(kind)])
        last = np.append(piece[1:], True)[: len(piece)]
        code = bytes_ + np.where(last, 256, 0)
        out, live = self.byte_symbols[code], np.ones(len(code), bool)
        cut = piece.copy()
        cut[1:] |= ~self.byte_joined[bytes_[:-1], code[1:]]
        cut |= np.repeat(alone, size)
        self._merge(bytes_, code, out, live, cut)
        counts = np.add.reduceat(live, begin).astype(np.int64) if len(size) else size
        ids = out[live].astype("<u4")
        if not alone.any():
            return ids, counts
        where = np.concatenate([[0], np.cumsum(counts)]).tolist()
        parts = [np.frombuffer(self.encode_word(bytes_[begin[i] : begin[i] + size[i]].tobytes()), "<u4") if alone[i] else ids[where[i] : where[i + 1]] for i in range(len(size))]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _merge(self, bytes_: np.ndarray, code: np.ndarray, out: np.ndarray, live: np.ndarray, cut: np.ndarray) -> None:
        """Merge inside the fragments that begin at ``cut``: a round merges the lowest-ranked pair, leftmost first,
        of every fragment that has one. ``out`` gets the ids, ``live`` says which places still have one."""
        none = len(self.merged)
        rank = np.full(len(code), none, np.int64)
        inside = np.flatnonzero(~cut[1:])
        rank[inside] = self.byte_ranks[bytes_[inside], code[inside + 1]]
        at = np.arange(len(code))
        begins = np.flatnonzero(cut)
        while len(begins):
            lowest = np.minimum.reduceat(rank, begins)
            some = lowest < none
            sizes = np.diff(np.append(begins, len(at)))
            if not some.all():  # go on with these fragments alone
                keep = np.repeat(some, sizes)
                at, rank = at[keep], rank[keep]
                sizes, lowest = sizes[some], lowest[some]
                if not len(sizes):
                    return
                begins = np.cumsum(sizes) - sizes
            hits = np.flatnonzero(rank == np.repeat(lowest, sizes))
            place = hits[np.searchsorted(hits, begins)]
            right = place + 1
            new = self.results[lowest]
            out[at[place]] = new
            live[at[right]] = False
            end = begins + sizes
            rank[place] = none
            more = np.flatnonzero(right + 1 < end)
            rank[place[more]] = self._rank(new[more] << 16 | out[at[right[more] + 1]])
            less = np.flatnonzero(place > begins)
            rank[place[less] - 1] = self._rank(out[at[place[less] - 1]] << 16 | new[less])
            keep = np.ones(len(at), bool)
            keep[right] = False
            at, rank = at[keep], rank[keep]
            begins = begins - np.arange(len(begins))

    def decode(self, packed: pa.Array) -> pa.Array:
        """Token strings joined by spaces, as the library does for a file without a decoder; unknown ids are skipped."""
        out = [self.pieces.join(packed.slice(first, len(offsets) - 1), data, offsets) for first, data, offsets in chunks(packed)]
        return pa.concat_arrays(out) if out else pa.array([], pa.large_string())


class _Pieces:
    """Token strings as one run of bytes, each followed by a space."""

    def __init__(self, names: list[str | None]):
        spaced = [b"" if n is None else n.encode() + b" " for n in names]
        self.sizes = np.array([len(b) for b in spaced], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(spaced), np.uint8)

    def join(self, texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.Array:
        if (offsets % 4).any():  # no whole ids: what is left of an id is left out
            texts = pa.array([(t or b"")[: len(t or b"") // 4 * 4] for t in texts.to_pylist()], pa.large_binary())
            return pa.concat_arrays([self.join(texts, d, o) for _, d, o in chunks(texts, 1 << 62)])
        ids = np.frombuffer(data.tobytes(), "<u4").astype(np.int64)
        known = ids < len(self.sizes)
        known[known] = self.sizes[ids[known]] > 0
        counts = np.concatenate([[0], np.cumsum(known)])[offsets // 4]  # known ids before each text's begin
        ids = ids[known]
        sizes = self.sizes[ids]
        last = counts[1:][counts[1:] > counts[:-1]] - 1  # no space after a text's last token
        sizes[last] -= 1
        total = np.concatenate([[0], np.cumsum(sizes)])
        step = np.ones(int(total[-1]), np.int64)  # places of the bytes, by differences
        if len(ids):
            some = sizes > 0
            at, begin, size = total[:-1][some], self.starts[ids][some], sizes[some]
            step[at[0]] = begin[0]
            step[at[1:]] = begin[1:] - (begin[:-1] + size[:-1] - 1)
        return _binary(self.data[np.cumsum(step)], total[counts[1:]], pa.large_string())


def _is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(values.shape, bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _kinds(data: np.ndarray) -> np.ndarray:
    """Letter, digit or other for each byte of UTF-8 text of the characters that _PLAIN lets through."""
    kind = _KIND[data]
    lead = np.flatnonzero((data == 0xC2) | (data == 0xC3))
    kind[lead] = kind[lead + 1] = _LATIN_KIND[data[lead] - 0xC2, data[lead + 1]]
    more = np.flatnonzero(data >= 0xC4)
    kind[more] = kind[more + 1] = _LETTER
    return kind


def _places(starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of the entries of the runs ``which``, one run after the other."""
    many = sizes[which]
    ends = np.cumsum(many)
    return np.repeat(starts[which] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)


def _binary(data: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


_encoders: dict[int, ForcedBoundaryEncoder] = {}


def _encoder(source: str) -> ForcedBoundaryEncoder:
    key = hash(source)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = ForcedBoundaryEncoder(source)
    return _encoders[key]


def _with_column(df: DataFrame, source_col: str, new_col: str, kind: T.DataType, vocabulary: str | None, make: Callable) -> DataFrame:
    """``df`` with ``new_col`` (which is replaced), made from ``source_col`` by ``make(encoder, array)``."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        source = df.sparkSession.sparkContext.broadcast(f.read())  # one file of fixed size
    kept = df.select([df[c] for c in df.columns if c != new_col or c == source_col])
    at = kept.columns.index(source_col)
    passed = [i for i, c in enumerate(kept.columns) if c != new_col]
    schema = T.StructType([*[kept.schema.fields[i] for i in passed], T.StructField(new_col, kind)])
    arrow = pa.binary() if isinstance(kind, T.BinaryType) else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(source.value)
        for whole in batches:
            for begin in range(0, whole.num_rows, 1024):
                batch = whole.slice(begin, 1024)
                made = make(encoder, batch.column(at)).cast(arrow)
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in passed], made], names=[*[batch.schema.names[i] for i in passed], new_col])

    return kept.mapInArrow(frugal(run), schema)


def bpe_encode(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, ids_col: str = "token_ids") -> DataFrame:
    """Add ``ids_col`` (binary: little-endian unsigned 32-bit ids). ``vocabulary``: a path on the driver.

    An input column with the name of the output column is replaced.
    """
    return _with_column(docs, text_col, ids_col, T.BinaryType(), vocabulary, ForcedBoundaryEncoder.encode)


def bpe_decode(tokens: DataFrame, ids_col: str = "token_ids", vocabulary: str | None = None, decoded_col: str = "decoded_text") -> DataFrame:
    """Add ``decoded_col``: the text of the ids in ``ids_col`` (null: empty)."""
    return _with_column(tokens, ids_col, decoded_col, T.StringType(), vocabulary, ForcedBoundaryEncoder.decode)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return bpe_decode(bpe_encode(docs).select("doc_id", "token_ids")).select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded_text").cast("binary"), 256).alias("decoded_sha256"),
    )
