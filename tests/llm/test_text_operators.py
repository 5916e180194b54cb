"""Encoding, language ID, quality scores and rules: edge cases and brute force."""

import hashlib
import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import bpe, host_rules, langid, quality_fm
from lodestone.llm.words import chunks

from .helpers import TWINS, documents, oracle, same, sentence, vocabulary, write

ODD = [None, "", " ", "\n\n", "a", "x" * 20_000, "the cat " * 4000, "<|endoftext|>hi<|startoftext|>", "ΑΣ İstanbul é", "日本語 テスト", "I'll don't 'S", "²½ªº\x1c\x85", *TWINS]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def encoder():
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        return bpe.ForcedBoundaryEncoder(f.read())


def packed(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abthein é'sS1²#<|>_\n\xa0ßİΣ語\x1f-", max_size=60)), max_size=8))
def test_encoding_equals_the_library(encoder, library, texts):
    ids = encoder.encode(pa.array(texts, pa.string()))
    assert ids.to_pylist() == [packed(library, t) for t in texts]
    want = [library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for t in texts]
    assert encoder.decode(ids).to_pylist() == want


def test_long_fragments_equal_the_library(encoder, library):
    rng = random.Random(3)
    texts = ["".join(rng.choice("etaoinsh") for _ in range(n)) for n in (63, 64, 65, 300, 5000)]
    assert encoder.encode(pa.array(texts)).to_pylist() == [packed(library, t) for t in texts]


def test_many_chunks_equal_one(encoder, library, monkeypatch):
    rng, v = random.Random(5), vocabulary(5)
    texts = [sentence(rng, rng.randint(0, 60), v) for _ in range(200)] + ["<|endoftext|> a", "b\xa0c", ""]
    monkeypatch.setattr(bpe.chunks, "__defaults__", (300,))
    monkeypatch.setattr(bpe, "CACHE", 20)
    assert encoder.encode(pa.array(texts)).to_pylist() == [packed(library, t) for t in texts]


def test_unknown_ids_are_skipped(encoder):
    one = encoder.encode(pa.array(["a cat"])).to_pylist()[0]
    odd = [one, b"\xff\xff\xff\xff" + one, one + b"\xff\xff\xff\x7f", b"\xff\xff\xff\xff", b"", None, one + b"\x01"]
    text = encoder.decode(pa.array([one])).to_pylist()[0]
    assert encoder.decode(pa.array(odd, pa.binary())).to_pylist() == [text, text, text, "", "", "", text]


def test_no_token_straddles_a_forced_boundary(encoder):
    symbols = encoder.symbols("zqxjé".encode().decode("latin-1").translate(encoder.bytes_to_symbols))
    cuts = encoder.cuts(symbols)
    assert [s for c in cuts for s in c] == symbols and len(cuts) > 1
    assert [i for c in cuts for i in encoder.encode_fragment(c)] == encoder.encode_fragment(symbols)


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    made = []
    cache = bpe._Cache(lambda k: made.append(k) or k)
    assert [cache(i) for i in range(10)] == list(range(10)) and len(cache.new) + len(cache.old) <= 6
    assert [cache(9) for _ in range(20)] == [9] * 20 and made == list(range(10))


def odd_documents(spark):
    return documents(spark, [(i, t) for i, t in enumerate(ODD)] + [(0, None), (None, "same"), (None, "same")])


def test_encoding_of_odd_rows(spark, library):
    df = odd_documents(spark).withColumn("token_ids", F.lit(1)).withColumn("extra", F.lit("x")).withColumn("decoded_text", F.lit("y"))
    encoded = bpe.bpe_encode(df)
    rows = bpe.bpe_decode(encoded).collect()
    assert len(rows) == len(ODD) + 3 and rows[0].extra == "x" and encoded.first().decoded_text == "y"
    for r in rows:
        assert bytes(r.token_ids) == packed(library, r.text)
        assert r.decoded_text == library.decode(library.encode(r.text or "", add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.bpe_encode(df.limit(0)).count() == 0
    assert bpe.bpe_encode(df.select(F.col("text").alias("token_ids")), "token_ids").count() == len(rows)


def test_the_query_gives_the_digests(spark, library, tmp_path):
    folder = write(spark, tmp_path, documents=odd_documents(spark))
    want = []
    for i, text in [*enumerate(ODD), (0, None), (None, "same"), (None, "same")]:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(packed(library, text)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = bpe.op10_bpe(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


# language ID


def naive_phrases(train: bytes, text: bytes) -> int:
    """Longest matches, one after another, over the whole text."""
    n = at = 0
    while at < len(text):
        to = at + 1
        while to < len(text) and text[at : to + 1] in train:
            to += 1
        n, at = n + 1, to if text[at : at + 1] in train else at + 1
    return n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcé", min_size=1, max_size=60), min_size=1, max_size=3), st.lists(st.text(alphabet="abcdé Z!", max_size=80), min_size=1, max_size=6), st.sampled_from([1, 2, 7, 1024]))
def test_phrases_equal_greedy_search(trains, texts, block):
    before, langid.BLOCK = langid.BLOCK, block
    try:
        check_phrases(trains, texts)
    finally:
        langid.BLOCK = before


def check_phrases(trains, texts):
    samples = [(str(i), t.encode()) for i, t in enumerate(trains)]
    parser = langid.CrossParser(samples)
    for _, data, offsets in chunks(pa.array([t.lower() for t in texts])):
        codes, at = langid.normalise(data, offsets)
        got = parser.phrases(codes, at)
        for i in range(len(at) - 1):
            text = codes[at[i] : at[i + 1]].tobytes()
            assert got[i].tolist() == [naive_phrases(t, text) for _, t in samples]


def test_phrases_over_many_blocks():
    rng = random.Random(1)
    train = "".join(rng.choice("abcd") for _ in range(300)).encode()
    text = "".join(rng.choice("abcde") for _ in range(5000)).encode()
    codes = np.frombuffer(text, np.uint8)
    got = langid.CrossParser([("x", train)]).phrases(codes, np.array([0, 2500, 2500, 5000]))
    assert got.ravel().tolist() == [naive_phrases(train, text[:2500]), 0, naive_phrases(train, text[2500:])]


@pytest.fixture(scope="module")
def two_languages(spark):
    rng = random.Random(9)
    a, b = ["tha", "ing", "er", "ou", "sh"], ["ción", "ñe", "qui", "ll", "os"]
    word = lambda parts: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    rows = [(i, " ".join(word(a if i % 2 else b) for _ in range(rng.randint(3, 150))), "en" if i % 2 else "es") for i in range(300)]
    rows += [(1000 + i, t, None) for i, t in enumerate(["", "12 !?", None, "...", "Ñ", "日本"])]
    return documents(spark, [(*r, "s", None) for r in rows])


def test_languages_are_told_apart(spark, two_languages, tmp_path):
    folder = write(spark, tmp_path, documents=two_languages)
    rows = langid.op3_langid(spark, folder).join(two_languages, "doc_id").collect()
    assert len(rows) == 306
    held = [r for r in rows if r.held_out and r.lang]
    assert len(held) > 50 and sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: r for r in rows if r.lang is None}
    assert [odd[1000 + i].lang_pred for i in range(4)] == ["und"] * 4 and odd[1000].score == 0
    assert odd[1004].lang_pred != "und" and odd[1005].lang_pred != "und"


def plain(text):
    return re.sub(b"[^a-z\x80-\xff]+", b" ", (text or "").lower().encode()).lstrip(b" ")


def test_the_query_equals_brute_force(spark, two_languages, tmp_path):
    long = [(2000 + i, " ".join(t.text for t in two_languages.filter(f"doc_id % 2 = {i} and doc_id < 120").collect()), None, "s", None) for i in (0, 1)]
    docs = two_languages.unionByName(documents(spark, long))
    folder = write(spark, tmp_path, documents=docs)
    samples = langid.learn_samples(docs.filter(~langid.held_out()))
    learned = {}
    for r in docs.filter(~langid.held_out()).filter("lang is not null").collect():
        learned.setdefault(r.lang, []).append(plain(r.text).strip())
    for lang, sample in samples:  # whole texts of learned rows
        assert sum(t in sample for t in learned[lang]) >= langid.SAMPLE_ROWS
    got = {r.doc_id: r for r in langid.op3_langid(spark, folder).collect()}
    for r in docs.collect():
        text = plain(r.text)
        want, score = "und", 0.0
        if any(c.isalpha() for c in r.text or ""):
            costs = [naive_phrases(s, text) * math.log2(len(s)) / len(text) for _, s in samples]
            want, best, other = samples[costs.index(min(costs))][0], min(costs), max(costs)
            other = min(other, max(langid.REJECT_BITS, best))
            score = other / (best + other)
        assert got[r.doc_id].lang_pred == want and got[r.doc_id].score == pytest.approx(score)


def test_samples_skip_blank_rows_and_take_long_ones_last(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 2)
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 40)
    rows = [(i, "", "en") for i in range(50)] + [(60, "the only one", "en"), (60, "the second text", "en"), (70, None, "fr"), (80, "x" * 500, "de"), (81, "y" * 400, "de"), (82, "long " * 30, "es"), (83, "kurz", "es")]
    assert langid.learn_samples(documents(spark, [(*r, "s", None) for r in rows])) == [("de", b"y" * 400), ("en", b"the only one"), ("es", b"kurz")]


def test_languages_without_labels_or_rows(spark):
    df = documents(spark, [(1, "abc", None, "s", 1), (2, None, None, None, None)])
    assert langid.learn_samples(df) == []
    rows = langid.identify_language(df.withColumn("score", F.lit("clash")), []).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)] * 2
    assert langid.identify_language(df.limit(0), [("en", b"abc")]).count() == 0


def test_equal_languages_go_to_the_first_name():
    parser = langid.CrossParser([("aa", b"abcabc"), ("bb", b"abcabc")])
    names, score, bits, _ = parser.judge(pa.array(["abc", "zzz"]))
    assert names == ["aa", "aa"] and score[0] == 0.5 and bits[1] > bits[0]


# quality


def test_factorisation_equals_all_pairs():
    rng = np.random.default_rng(2)
    model = quality_fm.FactorisationMachine(width=12, rank=3)
    model.w[:] = rng.normal(size=12)
    model.v[:] = rng.normal(size=(12, 3))
    x = rng.normal(size=12).astype(np.float32)
    want = model.bias + x @ model.w + sum(model.v[i] @ model.v[j] * x[i] * x[j] for i in range(12) for j in range(i))
    got, _ = model.margins(np.array([0, 12]), np.arange(12), x)
    assert got[0] == pytest.approx(want, rel=1e-4)


def naive_features(text):
    """Feature number to value, by plain loops over one text."""
    data = text.encode()
    found = re.findall(rb"[0-9A-Za-z\x80-\xff]+", data)
    _, bytes_, offsets = next(iter(chunks(pa.array([text]))))
    hashed = [int(h) % quality_fm.BUCKETS for h in quality_fm.words(bytes_, offsets, quality_fm._WORDS).hashes()]
    assert len(hashed) == len(found)
    times = Counter(hashed)
    norm = math.sqrt(sum(math.log1p(c) ** 2 for c in times.values()))
    out = {b: math.log1p(c) / norm for b, c in times.items()}
    kinds = [rb"[a-z\x80-\xff]", rb"[A-Z]", rb"[0-9]", rb"[#*$%&<>]", rb"[|]", rb"[!]", rb"\n", rb"[^a-zA-Z0-9#*$%&<>|!\n\x80-\xff]"]
    counts = [len(re.findall(k, data)) for k in kinds]
    n = max(len(found), 1)
    stats = [math.sqrt(c / max(len(data), 1)) for c in counts]
    stats += [1 - len(times) / n, sum(map(len, found)) / n / 10, math.log1p(len(found) / (counts[6] + 1)) / 5, math.log1p(len(data)) / 10]
    return out | {quality_fm.BUCKETS + i: quality_fm.STATISTICS_SCALE * x for i, x in enumerate(stats)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB é\n\t#|!\x007語.", max_size=60), min_size=1, max_size=5), st.integers(1, 80))
def test_features_equal_plain_loops(texts, limit):
    for first, data, offsets in chunks(pa.array(texts), limit):
        starts, numbers, values = quality_fm.features(data, offsets)
        for i, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
            want = naive_features(texts[first + i])
            assert sorted(numbers[a:b]) == sorted(want)
            assert all(v == pytest.approx(want[k], rel=1e-5, abs=1e-6) for k, v in zip(numbers[a:b].tolist(), values[a:b], strict=True))


def test_one_step_equals_numeric_gradients(monkeypatch):
    """Adam's first step moves every weight by the rate, against the sign of its numeric gradient."""
    for name, value in (("EPOCHS", 1), ("STEPS", 1), ("BATCH", 16)):
        monkeypatch.setattr(quality_fm, name, value)
    rng = np.random.default_rng(8)
    rows = [(np.arange(5, dtype=np.int32), rng.normal(size=5).astype(np.float32)) for _ in range(16)]
    y = np.array([i % 3 == 0 for i in range(16)], np.float32)
    start = quality_fm.FactorisationMachine(width=5, rank=2)
    bias, w, v = math.log(6 / 10), start.w.astype(float), start.v.astype(float)

    def loss(bias, w, v):
        total = quality_fm.DECAY / 2 * ((w * w).sum() + (v * v).sum())
        for (_, x), label in zip(rows, y, strict=True):
            margin = bias + x @ w + sum(v[i] @ v[j] * x[i] * x[j] for i in range(5) for j in range(i))
            total += (math.log1p(math.exp(margin)) - label * margin) / len(rows)
        return total

    after = quality_fm.FactorisationMachine(width=5, rank=2).fit(rows, y)
    for old, new, swap in ((w, after.w, lambda z: (bias, z, v)), (v, after.v, lambda z: (bias, w, z))):
        for at in np.ndindex(old.shape):
            near = old.copy()
            near[at] += 1e-5
            slope = (loss(*swap(near)) - loss(bias, w, v)) / 1e-5
            if abs(slope) > 1e-3:
                assert new[at] - old[at] == pytest.approx(-quality_fm.RATE * np.sign(slope), rel=1e-2)
    slope = (loss(bias + 1e-5, w, v) - loss(bias, w, v)) / 1e-5
    assert after.bias - bias == pytest.approx(-quality_fm.RATE * np.sign(slope), rel=1e-2)


def test_gradients_reduce_the_loss():
    rng = np.random.default_rng(4)
    rows = [(np.arange(6, dtype=np.int32), rng.normal(size=6).astype(np.float32)) for _ in range(400)]
    y = np.array([r[1][0] * r[1][1] > 0 for r in rows], np.float32)  # pairs only
    model = quality_fm.FactorisationMachine(width=6).fit(rows, y)
    score = np.concatenate([model.scores(np.array([0, 6]), *r) for r in rows])
    assert ((score > 0.5) == y).mean() > 0.9


@pytest.fixture(scope="module")
def good_and_bad(spark):
    rng, v = random.Random(5), vocabulary(5)
    good = lambda: sentence(rng, rng.randint(30, 200), v).capitalize() + "."
    bad = [lambda: " ".join(w + "###" for w in good().split()), lambda: good().upper() + "!!", lambda: (rng.choice(v) + " ") * 80]
    rows = [(i, bad[i % 3]() if i % 5 == 0 else good()) for i in range(900)]
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1, 0) for i in range(0, 900)] + [(1, None, 0), (None, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    odd = [(2000 + i, t) for i, t in enumerate(ODD)] + [(2000, None)]
    return documents(spark, rows + odd), labels


def test_quality_on_held_out_rows(spark, good_and_bad, tmp_path):
    docs, labels = good_and_bad
    folder = write(spark, tmp_path, documents=docs, labels=labels)
    rows = quality_fm.op7_quality_fm(spark, folder).collect()
    assert len(rows) == 915 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 100 and sum(r.predicted == int(r.doc_id % 5 != 0) for r in held) >= 0.97 * len(held)
    assert len({r.score for r in rows if r.doc_id == 2000}) == 1


def test_quality_without_labels_or_with_one(spark, good_and_bad):
    docs, labels = good_and_bad
    none = quality_fm.learn(docs, labels.limit(0))
    ones = quality_fm.learn(docs, labels.filter("quality = 1").limit(5))
    some = docs.limit(3).withColumn("score", F.lit("clash"))
    assert {round(r.score, 6) for r in quality_fm.score_quality(some, none).collect()} == {0.5}
    assert all(r.score > 0.99 for r in quality_fm.score_quality(some, ones).collect())
    assert quality_fm.score_quality(docs.limit(0), none).count() == 0


# rules


def naive_measures(text):
    w = re.findall("[^\x20\x09-\x0d]+", text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {i + k for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return [len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t#|\x00語", max_size=60), min_size=1, max_size=6), st.integers(1, 80))
def test_measures_equal_plain_python(texts, limit):
    for first, data, offsets in chunks(pa.array(texts), limit):
        got = np.array(host_rules.measure(data, offsets)).T.tolist()
        assert got == [naive_measures(t) for t in texts[first : first + len(got)]]


def test_rules_equal_the_sql(spark, tmp_path):
    rng, v = random.Random(6), vocabulary(6)
    rows = [(i, sentence(rng, rng.choice([10, 60, 90]), v) + "\n" * (i % 3) + "#|x", "en", f"s{i % 4}") for i in range(120)]
    rows += [(500 + i, t, "en", [None, "s1", "bad"][i % 3]) for i, t in enumerate(ODD)] + [(600 + i, "short", "en", "bad") for i in range(30)]
    rows += [(700, sentence(rng, 80, v), "en", "bad"), (701, sentence(rng, 80, v), "en", None), (0, "twice", "en", "s1"), (0, "twice", "en", "s1")]
    folder = write(spark, tmp_path, documents=documents(spark, [(*r, None) for r in rows]))
    result = host_rules.op8_host_rules(spark, folder)
    same(result, oracle(host_rules.ORACLE_SQL, folder, ["documents"]), "doc_id")
    kept = {r.doc_id: r for r in result.collect()}
    assert not kept[700].kept and not kept[700].base_failed  # the host's verdict
    assert kept[701].kept  # no host


def test_rules_on_nothing_and_by_hash_join(spark, monkeypatch):
    df = documents(spark, [(1, "a b c", "en", "s", None), (2, None, None, None, None)]).withColumn("kept", F.lit("clash"))
    assert host_rules.apply_rules(df.limit(0)).count() == 0
    one = sorted(map(str, host_rules.apply_rules(df).collect()))
    monkeypatch.setattr(host_rules, "BROADCAST_HOSTS", -1)
    assert sorted(map(str, host_rules.apply_rules(df).collect())) == one


def judged(spark, rows, **more):
    """Hosts of rows (source, failed rules)."""
    flags = [(h, *(r in f for r in host_rules.RULES)) for h, f in rows]
    names = ", ".join(f"failed_{r} boolean" for r in host_rules.RULES)
    return {r.source: r for r in host_rules.judge_hosts(spark.createDataFrame(flags, f"source string, {names}"), **more).collect()}


def test_shrinking_spares_small_hosts(spark):
    few = {True: ("few_words",), False: ()}
    rows = [("big", few[i % 10 == 0]) for i in range(1000)] + [("mid", few[i % 5 == 0]) for i in range(100)] + [("tiny", few[True])]
    hosts = judged(spark, rows, limit=0.9)
    assert hosts["tiny"].rate_few_words < 0.9 and not any(r.host_rejected for r in hosts.values()) and abs(hosts["big"].rate_few_words - 0.1) < 0.01


def test_one_rule_is_enough_but_rules_do_not_add_up(spark):
    rows = [("marked", ("symbols",)) for i in range(60)] + [("some", (("few_words",), ("symbols",), ("dup_lines",))[i % 3]) for i in range(60)] + [(f"h{i}", ()) for i in range(30) for _ in range(20)]
    hosts = judged(spark, rows)
    assert hosts["marked"].host_rejected and not hosts["some"].host_rejected and hosts["marked"].rate_few_words < 0.1


def test_limits_follow_the_prior(spark):
    """Where hosts are alike, one that fails 45 in 100 is rejected; where many fail as often, it is not."""
    fails = lambda host, n, of20: [(host, ("few_words",) if i % 20 < of20 else ()) for i in range(n)]
    alike = [r for h in range(30) for r in fails(f"h{h}", 40, 1)]
    hosts = judged(spark, alike + fails("other", 400, 9))
    assert hosts["other"].host_rejected and sum(r.host_rejected for r in hosts.values()) == 1
    assert hosts["other"].limit_few_words == 0.35 < hosts["other"].rate_few_words < 0.45
    wide = [r for h in range(30) for r in fails(f"h{h}", 40, 1 if h % 2 else 9)]
    assert not any(r.host_rejected for r in judged(spark, wide + fails("other", 400, 9)).values())
    assert not any(r.host_rejected for r in judged(spark, alike + fails("other", 400, 6)).values())  # up to LEAST_LIMIT
