"""Sanitisation, decontamination, URL filters, the Jaccard join and the pipeline: SQL, brute force, odd rows."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import bpe, components, decontaminate, jaccard_join, langid, pii, spark_io, url_filter

from .helpers import TWINS, documents, oracle, same, sentence, vocabulary, write

ODD = [None, "", " ", "\n", "word", "x" * 30_000, "a b c d e f g h i j k " * 900, *TWINS]


# Bloom filter and components


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k")).unionByName(spark.createDataFrame([(None,)], "k string"))
    table, blocks = spark_io.bloom_blocks(keys, "k", 3000)
    other = spark.range(20_000).select(F.concat(F.lit("o"), "id").alias("k"))
    assert spark_io.bloom_mark(keys.dropna(), "k", table, blocks, "hit").filter("hit").count() == 3000
    assert spark_io.bloom_mark(other, "k", table, blocks, "hit").filter("hit").count() < 400
    assert table.count() <= blocks <= spark_io.MAX_BLOCKS
    empty, one = spark_io.bloom_blocks(keys.limit(0), "k", 0)
    assert spark_io.bloom_mark(other, "k", empty, one, "hit").filter("hit").count() == 0


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5200)] + [(7, 7), (None, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# personal data

PLAIN = {"email": pii.EMAIL, "ip": pii.IP, "card": pii.CARD, "phone": pii.PHONE}


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab@.+1 2-()3é😀_") for _ in range(60)) for _ in range(150)]
    texts += ["4111 1111 1111 1111", "4111-1111-1111-1112", "x@y.z@w.v", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.0255", "+1 (555) 123-4567.", "9" * 5000, "a" * 50_000 + "@b.c", "+" + "1 " * 3000, None]

    def luhn(d):
        return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    def naive(text):
        out = []
        for n, kind in enumerate(pii.KINDS):
            for m in re.finditer(pii._PATTERNS[kind], text or "", re.A):
                d = re.sub("[^0-9]", "", m[0])
                ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
                if ok:
                    out.append((m.start(), n, m.end(), kind, m[0]))
        return sorted(out)

    df = pii.find_base(documents(spark, list(enumerate(texts))))
    for r in df.collect():
        assert [tuple(s) for s in r["__base"]] == naive(r.text), r.text[:80]


def private_rows():
    rng, v = random.Random(3), [w + "xx" for w in vocabulary(3)]
    secret = ["ann@mail.example.com", "10.20.30.40", "4111 1111 1111 1111", "+1 (555) 123-4567"]
    rows = []
    for i in range(120):
        text = sentence(rng, rng.randint(5, 60), v)
        if i % 3 == 0:
            text += f" agent{'abcd'[i % 4]}zulu {secret[i % 4]} {sentence(rng, 9, v)}"
        rows.append((i, text))
    return rows + [(500 + i, t) for i, t in enumerate(ODD)] + [(None, "call +1 (555) 123-4567 agentdzulu"), (None, None), (0, rows[0][1]), (501, "10.20.30.40 10.20.30.40")]


def test_sanitisation_equals_the_sql(spark, tmp_path):
    rows = private_rows()
    folder = write(spark, tmp_path, documents=documents(spark, rows + rows[:40] + rows[:10] * 5))
    result = pii.op1_pii(spark, folder)
    same(result, oracle(pii.ORACLE_SQL, folder, ["documents"]), "doc_id")
    assert result.filter("spans like '%term%'").count() > 20
    same(pii.op1_pii_any_support(spark, folder), oracle(pii.ANY_SUPPORT_SQL, folder, ["documents"]), "doc_id")


def test_many_matches_in_one_text(spark, tmp_path):
    rng = random.Random(6)
    numbers = " ".join(str(rng.randrange(10**6)) + "," for _ in range(200_000))
    mails = "; ".join(f"someone{i} wrote u{i}@mail.example.com, 10.{i % 200}.3.4" for i in range(5000))
    folder = write(spark, tmp_path, documents=documents(spark, [(1, numbers), (2, mails), (3, mails + " again")]))
    began = time.time()
    got = {r.doc_id: r for r in pii.op1_pii_any_support(spark, folder).collect()}
    assert time.time() - began < 60
    assert (got[1].n_card, got[2].n_email, got[2].n_ip) == (0, 5000, 5000)
    assert got[2].base_sha256 == got[3].base_sha256
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.read.parquet(f"{folder}/documents.parquet"), clean_col="text").collect()}
    assert clean[1] == numbers and clean[2].count("[EMAIL], [IP]") == clean[3].count("[EMAIL], [IP]") == 5000


def test_sanitised_texts(spark):
    df = documents(spark, private_rows()).withColumn("pii_spans", F.lit("clash")).withColumn("extra", F.lit(1))
    out = pii.sanitise(df, clean_col="text")
    assert out.columns == [*[c for c in df.columns if c != "pii_spans"], "pii_spans"] and out.count() == df.count()
    texts = [r.text or "" for r in out.collect()]
    assert not any("@" in t or "4111" in t or "555" in t or "zulu" in t for t in texts)
    assert any("[EMAIL]" in t for t in texts) and any("[IP] [IP]" == t for t in texts)
    assert pii.sanitise(df.limit(0)).count() == 0


def unique_rows():
    """Copies of a document whose address and name stand nowhere else, among documents of common words."""
    rng, v = random.Random(4), [w + "xx" for w in vocabulary(4, 30)]
    rows = [(i, sentence(rng, 60, v)) for i in range(200)]
    rare = [(300 + i, f"{sentence(rng, 30, v)} {c}quimbyzulu {c}@mail.example.com {sentence(rng, 30, v)}") for i, c in enumerate("abc")]
    return rows + rare + [(i + 100, t) for i, t in rare]


def test_entities_of_one_document_yield_terms_after_deduplication(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = documents(spark, unique_rows())
    once = pipeline.keep_one_of_near_copies(spark, docs, str(tmp_path))
    assert once.filter("text like '%zulu%'").count() == 3
    clean = {r.doc_id: r.text for r in pipeline.sanitise_personal_data(spark, once, str(tmp_path)).collect()}
    before = dict(unique_rows())
    for i in (300, 301, 302):
        assert "zulu" not in clean[i] and "[EMAIL]" in clean[i]
        common = [w for w in before[i].split() if w.endswith("xx")]
        assert [w for w in clean[i].split() if w.endswith("xx")] == common  # terms of many documents stay
    folder = write(spark, tmp_path, documents=once)
    assert pii.op1_pii_any_support(spark, folder).filter("spans like '%term%'").count() == 3


def test_overlapping_spans_are_replaced_once(spark):
    row = spark.createDataFrame([("ab 4111 cd",)], "t string")
    spans = F.expr("array(struct(3 start, 2 ord, 7 end, 'card' kind, '' value), struct(5 start, 3 ord, 9 end, 'phone' kind, '' value), struct(9 start, 4 ord, 10 end, 'term' kind, 'remove' value))")
    assert row.select(pii.replace_spans(F.col("t"), spans).alias("x")).first().x == "ab [CARD]"


# decontamination


def naive_suffixes(text):
    breaks = {p: i for i, p in enumerate(np.flatnonzero(text == 0))}
    key = lambda p: [(0, breaks[q]) if text[q] == 0 else (1, text[q]) for q in range(p, len(text))]
    return sorted(range(len(text)), key=key)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_fm_index_finds_all_occurrences(middle):
    text = np.array([0, *middle, 0])
    assert decontaminate.suffix_array(text, 3).tolist() == naive_suffixes(text)
    index = decontaminate.FMIndex(text, 3)
    assert index.tree.access(np.arange(len(text))).tolist() == text[np.array(naive_suffixes(text)) - 1].tolist()

    class Phrases:
        ids = np.array([[0, 0, 1], [0, 1, 2], [1, 2, 3], [3, 3, 3], [2, 1, 2]])

    low, high = index.search(Phrases)
    for p, a, b in zip(Phrases.ids, low, high, strict=True):
        p = p[p > 0]
        want = [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def contaminated(spark, tmp_path):
    rng, v = random.Random(4), vocabulary(4, 40)
    items = [(i, sentence(rng, n, v)) for i, n in enumerate([3, 9, 10, 11, 25, 40, 12, 1])]
    items += [(20, items[4][1]), (20, "second text of one id here for sure to be found now"), (21, ""), (22, None), (None, "no id"), (23, "!!")]
    rows = [(i, sentence(rng, rng.randint(0, 80), v)) for i in range(60)]
    rows += [(100 + i, f"{sentence(rng, 8, v)}. {t.upper() if t else t}! {sentence(rng, 4, v)} É") for i, (_, t) in enumerate(items)]
    rows += [(200 + i, t) for i, t in enumerate(ODD)] + [(300, rows[62][1])] * 2 + [(None, items[5][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    return write(spark, tmp_path, documents=documents(spark, rows), benchmark=benchmark)


def test_decontamination_equals_the_sql(spark, tmp_path):
    folder = contaminated(spark, tmp_path)
    same(decontaminate.op2_decontaminate(spark, folder), oracle(decontaminate.ORACLE_SQL, folder, ["documents", "benchmark"]), "doc_id")


def test_blocks_and_small_shards_change_nothing(spark, tmp_path, monkeypatch):
    folder = contaminated(spark, tmp_path)
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    docs = docs.withColumn("n_hit", F.lit("clash"))
    key = lambda df: sorted(map(str, df.collect()))
    whole = decontaminate.find_contamination(docs, items, clean_col="text")
    assert key(whole) == key(decontaminate.find_contamination(docs, items, clean_col="text", block_bytes=100))
    left = decontaminate.find_contamination(whole.select("doc_id", "text"), items.filter("length(text) > 60"))
    assert left.filter("n_hit > 0").count() == 0
    assert decontaminate.find_contamination(docs, items.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.find_contamination(docs.limit(0), items).count() == 0


# URLs


def test_url_filter_equals_the_sql(spark, tmp_path):
    urls = ["http://a.com/x", "https://EXAMPLE.com/en/1", "http://www.example.com/en/1?x", "http://sub.www.example.com/en/", "http://x.example.net/es/1", "http://example.com", "http://com/", "http://notexample.com/en/", "x", None, "", "://", "http://spam-farm.example.org/en/1", "https://www.spam-farm.example.org/en/1.html#top", "https://m.spam-farm.example.org/en/1/", "http://fine.example.org/en/1", "http://a.org?x=http://b.com/", "http://free-bets.example.org/a/index.html", "http://h.org/p\n/q"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)] + [(0, urls[0], ""), (None, urls[12], None)], "page_id long, url string, html string")
    digest = lambda x: hashlib.md5(str(x).encode()).hexdigest()
    chosen = {what: next(i for i in range(100, 9000) if digest(i).startswith(start)) for what, start in url_filter.LISTED.items()}
    assert not any(digest(i).startswith(tuple(url_filter.LISTED.values())) for i in (15, 17))
    more = [(chosen["page"], "https://m.spam-farm.example.org/en/1?x"), (chosen["section"], "http://www.part.example.org/en/7"), (chosen["site"], "http://all.example.org/de/7")]
    more += [(9100 + i, u) for i, u in enumerate(["http://part.example.org/en/", "http://m.part.example.org/en/x/y", "http://part.example.org/fr/7", "http://part.example.org/en", "https://all.example.org", "http://www.all.example.org/x", "http://sub.all.example.org/x", "http://all.example.com/de/7"]) if not digest(9100 + i).startswith(tuple(url_filter.LISTED.values()))]
    pages = pages.unionByName(spark.createDataFrame([(i, u, "") for i, u in more], pages.schema))
    folder = write(spark, tmp_path, pages=pages)
    result = url_filter.op4_url_filter(spark, folder)
    same(result, oracle(url_filter.ORACLE_SQL, folder, ["pages"]), "page_id")
    by = {r.page_id: r for r in result.collect()}
    assert [by[i].verdict for i in range(9)] == ["allow", "block", "allow", "allow", "block", "allow", "allow", "allow", "allow"]
    assert by[12].verdict == by[13].verdict == by[14].verdict == by[chosen["page"]].verdict == by[None].verdict == "block" and by[15].verdict == by[17].verdict == "allow"
    assert (by[9].host, by[9].path, by[9].rule) == ("", "", None)
    wanted = {9100: "block", 9101: "block", 9102: "allow", 9103: "allow", 9104: "block", 9105: "block", 9106: "allow", 9107: "allow"}
    assert len(more) > 8 and all(by[i].verdict == wanted[i] for i, _ in more[3:])


def test_url_filter_on_nothing(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", "clash")], "page_id long, url string, verdict string")
    assert [r.verdict for r in url_filter.filter_urls(pages, pages.limit(0)).collect()] == ["allow"]
    assert url_filter.filter_urls(pages.limit(0), pages).count() == 0
    assert [r.verdict for r in url_filter.filter_urls(pages, pages).collect()] == ["block"]


# Jaccard join


@pytest.mark.parametrize("a", range(1, 40))
def test_bounds(a):
    for b in range(1, 60):
        possible = [o for o in range(1, min(a, b) + 1) if 100 * o >= 75 * (a + b - o)]
        assert (b in jaccard_join.partners(a)) == bool(possible)
        if possible:
            assert jaccard_join.needed(a, b) == min(possible)
            assert min(possible) >= a - jaccard_join.prefix_length(a) + 1


def near_copies(seed=7):
    rng, v = random.Random(seed), vocabulary(7, 60)
    rows, n = [], 0
    for size in [*range(1, 26), 40, 60, 90, 150]:
        base = sentence(rng, size, v).split()
        for _ in range(4):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, size // 40 + 1])):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([0, 1])] = [rng.choice(v)]
            rows.append((n, " ".join(words).upper() if n % 3 else "\t".join(words)))
            n += 1
    long = sentence(rng, 200, v).split()
    for i in range(40):  # a chain: each differs a little from the one before
        long[i * 4] = f"new{i}"
        rows.append((1000 - i, " ".join(long)))
    same_line = " ".join(v[:30])
    rows += [(2000 + i, f"{same_line} {sentence(rng, rng.randint(5, 60), v)}") for i in range(40)]
    return rows + [(3000 + i, t) for i, t in enumerate(ODD)] + [(3100, ODD[6]), (3100, ODD[6]), (None, rows[0][1]), (None, "lonely text of its own with words"), (None, None)]


@pytest.mark.parametrize(("boundary", "hot"), [(None, 512), (0, 3), (6, 2), (12, 512)])
def test_join_equals_the_sql(spark, tmp_path, monkeypatch, boundary, hot):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    if boundary is not None:
        monkeypatch.setattr(jaccard_join, "choose_boundary", lambda *_: boundary)
    folder = write(spark, tmp_path, documents=documents(spark, near_copies()))
    result = jaccard_join.op5_jaccard_join(spark, folder)
    same(result, oracle(jaccard_join.ORACLE_SQL, folder, ["documents"]), "doc_id")
    assert result.filter("component_id = 961").count() == 40


def test_sets_with_one_digest_stay_apart(spark, tmp_path, monkeypatch):
    real = jaccard_join.digest
    monkeypatch.setattr(jaccard_join, "digest", lambda s, twins=frozenset(), salt=0: real(s, salt=99) if salt or real(s) % 7 in twins else real(s) % 7)
    folder = write(spark, tmp_path, documents=documents(spark, near_copies()[:60]))
    same(jaccard_join.op5_jaccard_join(spark, folder), oracle(jaccard_join.ORACLE_SQL, folder, ["documents"]), "doc_id")


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1), st.sets(st.integers(0, 400)), st.sets(st.integers(0, 400)))
def test_sketches_bound_the_difference(both, x, y):
    sets = [np.array(sorted(both | s), np.uint64) for s in (x, y)]
    sets = [np.unique(jaccard_join.mix(s)) for s in sets]
    a, b = (jaccard_join.sketch(s) for s in sets)
    while len(a) != len(b):
        a, b = (a[: len(a) // 2] ^ a[len(a) // 2 :], b) if len(a) > len(b) else (a, b[: len(b) // 2] ^ b[len(b) // 2 :])
    assert int(np.bitwise_count((a ^ b).view(np.uint64)).sum()) <= len(np.setxor1d(*sets))


def test_sketch_differences_in_columns(spark):
    rng = np.random.default_rng(3)
    rows = []
    for n in (1, 60, 64, 65, 100, 128, 129, 300):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x, rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)]))
        rows.append((jaccard_join.sketch(x).tolist(), jaccard_join.sketch(y).tolist(), len(y) - len(x)))
    got = spark.createDataFrame(rows, "x array<long>, y array<long>, d long").select("d", jaccard_join.sketch_difference(F.col("x"), F.col("y")).alias("n")).collect()
    assert all(r.n <= r.d for r in got) and any(r.n > 0 for r in got)
    assert all(r.n == 0 for r in spark.createDataFrame(rows, "x array<long>, y array<long>, d long").select(jaccard_join.sketch_difference(F.col("x"), F.col("x")).alias("n")).collect())


def test_boundary_follows_the_cost():
    assert jaccard_join.choose_boundary({}, 2.0) == 0
    assert jaccard_join.choose_boundary({3: 1000, 300: 5}, 1.0) >= 3
    assert jaccard_join.choose_boundary({12: 1000}, 0.0) < 12


CLASHING = ("digest", "check", "text_key", "id", "size", "tok", "comp", "a", "__key", "__digest", "__text", "sketch", "n")


def test_join_on_nothing_and_clashing_names(spark):
    df = documents(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, None)]).withColumn("component_id", F.lit("x"))
    for i, name in enumerate(CLASHING):
        df = df.withColumn(name, F.concat(F.lit(f"v{i}-"), F.col("doc_id").cast("string")))
    df = df.withColumn("a.b", F.create_map(F.lit("k"), F.col("doc_id")))
    assert jaccard_join.link_documents(df.limit(0)).count() == 0
    rows = sorted(jaccard_join.link_documents(df).collect(), key=lambda r: r.doc_id)
    assert [r.component_id for r in rows] == [1, 1, 3]
    for r in rows:
        assert [r[c] for c in CLASHING] == [f"v{i}-{r.doc_id}" for i in range(len(CLASHING))] and r["a.b"] == {"k": r.doc_id}


# the pipeline


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    en = [a + b for a in ["tha", "ing", "er", "ou", "sh"] for b in ["tion", "ly", "nd", "st", "wh"]]
    base = [sentence(rng, 120, en) for _ in range(30)]
    item = sentence(rng, 30, en)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t) for i, t in enumerate(base[:5])]  # copies
    rows += [(200 + i, t + " extra") for i, t in enumerate(base[5:8])]  # near copies
    rows += [(300, f"{sentence(rng, 60, en)} {item} {sentence(rng, 60, en)}"), (301, item), (302, sentence(rng, 60, en) + " write to bo@mail.example.com now"), (303, "12 34 !!"), (304, None), (305, "")]
    docs = documents(spark, [(*r, "en", "s0", len(r[1]) if r[1] else None) for r in rows])
    folder = write(spark, tmp_path, documents=docs, benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    out = {r.doc_id: r for r in pipeline.run(spark, folder).collect()}
    assert set(out) == {*range(30), 300, 302}
    assert item not in out[300].text and out[300].n_chars == len(out[300].text)
    assert "[EMAIL]" in out[302].text and "bo@mail" not in out[302].text
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    for r in out.values():
        assert np.frombuffer(bytes(r.token_ids), "<u4").tolist() == library.encode(r.text, add_special_tokens=False).ids and r.n_tokens == len(r.token_ids) // 4
    untouched = {i: t for i, t in rows if i < 30}
    assert all(out[i].text == untouched[i] for i in range(30))
    stage = pipeline.STAGES[0][1](spark, docs, folder)
    assert stage.columns == docs.columns and stage.count() == len(rows) - 3
    assert langid.UNKNOWN == "und"


EXTRA = ("score", "bits_per_byte", "lang_pred", "lang_phrases", "n_words", "n_hit", "item_ids", "removal_spans", "pii_spans", "n_tokens", "token_ids", "digest", "check", "text_key", "__key", "a.b")


def test_pipeline_keeps_extra_columns_and_takes_nothing(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    text = "some words for the stage here and more of them mail bo@mail.example.com"
    docs = documents(spark, [(1, text, "en", None, 5), (1, text, "en", None, 5), (2, text, "en", "s", 5), (None, "no id at all", None, None, None)])
    for i, name in enumerate(EXTRA):
        docs = docs.withColumn(name, F.concat(F.lit(f"v{i}-"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("string")))
    docs = docs.withColumn("map", F.create_map(F.lit("k"), F.array("doc_id")))
    folder = write(spark, tmp_path, documents=docs, benchmark=spark.createDataFrame([], "item_id long, text string"))

    def check(rows):
        for r in rows:
            d = r.doc_id
            assert [r[c] for c in EXTRA] == [f"v{i}-{d or 0}" for i in range(len(EXTRA))] and r["map"] == {"k": [d]}

    for name, stage in pipeline.STAGES:
        got = stage(spark, docs, folder)
        rows = got.collect()
        assert got.columns[: len(docs.columns)] == docs.columns
        assert len(rows) == (2 if name == "jaccard_join" else 4)
        check(rows)
        assert stage(spark, docs.limit(0), folder).count() == 0
    out = pipeline.run(spark, folder)
    assert out.columns == [*docs.columns, "n_tokens_", "token_ids_"]
    check(out.collect())
    assert out.count() == 2


def brute_pipeline(spark, folder, rows, items):
    """The pipeline's rows (id, text, token ids) in plain Python, with the SQL of op1 for the spans."""
    from tokenizers import Tokenizer

    from .test_text_operators import naive_phrases, packed, plain

    docs = documents(spark, rows)
    samples = langid.learn_samples(docs.filter(~langid.held_out()))
    kept = []
    for i, text, *_ in rows:
        if not any(c.isalpha() for c in text or ""):
            continue
        codes = plain(text)
        bits, n = min((naive_phrases(s, codes) * math.log2(len(s)) / len(codes), naive_phrases(s, codes)) for _, s in samples)
        if bits * (n - 1) <= langid.REJECT_BITS * n:
            kept.append((i, text))

    sets = {}
    for i, text in kept:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                one, other = sorted((group[a], group[b]))
                group = {k: one if v == other else v for k, v in group.items()}
    kept = [(i, t) for i, t in kept if group[i] == i]

    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t)
    windows = set()
    for _, t in items:
        w = word.findall(low(t))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    clean = []
    for i, text in kept:
        at = [m.span() for m in word.finditer(low(text))]
        w = [low(text)[a:b] for a, b in at]
        hit = [False] * len(w)
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit[k : k + size] = [True] * size
        if w and all(hit):
            continue
        out, last, k = [], 0, 0
        while k < len(w):
            if hit[k]:
                first = k
                while k + 1 < len(w) and hit[k + 1]:
                    k += 1
                out.append(text[last : at[first][0]])
                last = at[k][1]
            k += 1
        clean.append((i, "".join(out) + text[last:]))

    write(spark, folder / "clean", documents=documents(spark, clean))
    spans = {r.doc_id: r.spans for r in oracle(pii._oracle(), folder / "clean", ["documents"]).itertuples()}
    strong = {(r["__key"], s.start): s.value for r in pii.sanitise(spark.read.parquet(f"{folder}/clean/documents.parquet")).withColumn("__key", F.col("doc_id")).collect() for s in r.pii_spans if s.kind == "term"}
    library = Tokenizer.from_file(bpe.default_vocabulary())
    found = []
    for i, text in clean:
        out, last = [], 0
        for kind, a, b in (s.split(":") for s in spans[i].split(",") if s):
            a, b = int(a), int(b)
            if a >= last:
                out += [text[last:a], {"term": {"generalise": "[TERM]", "remove": ""}.get(strong.get((i, a))) or ""}.get(kind, f"[{kind.upper()}]")]
            last = max(last, b)
        done = "".join(out) + text[last:]
        found.append((i, done, packed(library, done)))
    return sorted(found)


def test_pipeline_equals_brute_force(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng, v = random.Random(21), vocabulary(21, 300)
    items = [(i, sentence(rng, n, v)) for i, n in enumerate([30, 12, 6])]
    base = [sentence(rng, rng.randint(20, 90), v) for _ in range(50)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t.upper()) for i, t in enumerate(base[:6])] + [(120 + i, t + " more") for i, t in enumerate(base[6:12])]
    rows += [(200 + i, f"{sentence(rng, 20, v)}. {items[i % 3][1].title()}; {sentence(rng, 25, v)}") for i in range(9)] + [(220, items[0][1])]
    rows += [(300 + i, f"{sentence(rng, 30, v)} {'xyz'[i % 3]}quimby {'xyz'[i % 3]}@mail.example.com, 10.0.0.{i} {sentence(rng, 12, v)}") for i in range(8)]
    rows += [(400, "12 3!"), (401, ""), (402, None), (403, "Ж" * 3 + "ЫЯ " * 40), (404, "a"), (405, "日本語 テスト " * 5), (406, "\n".join(base[20:24]) * 3)]
    folder = write(spark, tmp_path, documents=documents(spark, [(*r, "en", "s0", None) for r in rows]), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((r.doc_id, r.text, bytes(r.token_ids)) for r in pipeline.run(spark, folder).collect())
    want = brute_pipeline(spark, tmp_path, [(*r, "en", "s0", None) for r in rows], items)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert got == want
    assert 20 < len(got) < len(rows) - 10


def test_rows_that_share_an_id_only_are_not_merged(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    v = vocabulary(5)
    a, b, c, d = (sentence(random.Random(i), 80, v) for i in range(4))
    rows = [(5, a), (5, b), (3, b), (7, a), (5, c), (5, c), (9, d), (9, d + " end"), (8, "hm"), (8, None), (None, a), (None, a)]
    kept = [(r.doc_id, r.text) for r in pipeline.keep_one_of_near_copies(spark, documents(spark, rows), str(tmp_path)).collect()]
    one = (9, d) if (9, d) in kept else (9, d + " end")
    assert sorted(kept, key=str) == sorted([(5, a), (3, b), (5, c), one, (8, "hm"), (8, None), (None, a), (None, a)], key=str)
