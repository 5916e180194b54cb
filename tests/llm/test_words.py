"""The byte-level word tables against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import words as W

TEXTS = st.lists(st.text(alphabet="ab Z9é語\n\t\x00\x01-!", max_size=40), max_size=8)
PATTERNS = [(W.spaces_table(False), "[^\\x20\\x09-\\x0D]+", False), (W.spaces_table(True), "[^\\x20\\x09-\\x0D]+", True), (W.alnum_table(), "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", True)]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@settings(max_examples=80, deadline=None)
@given(TEXTS, st.sampled_from([0, 1, 2]), st.integers(1, 60))
def test_words_and_hashes(texts, which, limit):
    table, pattern, fold = PATTERNS[which]
    by_hash = {}
    for first, data, offsets in W.chunks(pa.array(texts, pa.string()), limit):
        found = W.words(data, offsets, table)
        hashes = found.hashes()
        for i in range(len(offsets) - 1):
            text = lower(texts[first + i]) if fold else texts[first + i]
            a, b = found.first[i], found.first[i + 1]
            want = re.findall(pattern, text)
            got = [bytes(data[s:e]).decode() for s, e in zip(found.start[a:b], found.end[a:b], strict=True)]
            assert [lower(g) if fold else g for g in got] == want
            for word, h in zip(want, hashes[a:b].tolist(), strict=True):
                assert by_hash.setdefault(word, h) == h
    assert len(set(by_hash.values())) == len(by_hash)


def test_chunks_take_nulls_slices_and_long_rows():
    values = pa.array(["x" * 50, None, "", "ab", "c"]).slice(1)
    got = [(first, bytes(data), offsets.tolist()) for first, data, offsets in W.chunks(values, 2)]
    assert got == [(0, b"ab", [0, 0, 0, 2]), (3, b"c", [0, 1])]
    assert [x[0] for x in W.chunks(pa.array(["long" * 9, "b"]), 4)] == [0, 1]
    assert list(W.chunks(pa.array([], pa.string()))) == []


def test_windows():
    h = np.arange(5, dtype=np.uint64)
    assert len(W.windows(h, 3)) == 3 and len(set(W.windows(h, 3).tolist())) == 3 and len(W.windows(h, 6)) == 0


def test_a_word_and_its_complement_have_different_hashes():
    for size in (64, 128, 1024, 4096):
        word = "".join("ab"[i.bit_count() % 2] for i in range(size))
        text = f"{word} {word.translate(str.maketrans('ab', 'ba'))} {word}"
        data = np.frombuffer(text.encode(), np.uint8)
        h = W.words(data, np.array([0, len(data)]), W.spaces_table(False)).hashes().tolist()
        assert h[0] == h[2] != h[1]
