"""Operators 11 to 13 against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import collocations, conversation_repair, oracle_sql, queries, simhash

from .helpers import documents, oracle, same, write

CONVERSATIONS = "conv_id long, turn long, role string, text string"
ODD = [None, "", " ", "\n\t", "one", "two words", "x" * 20_000, "the cat " * 4000, "ΑΣ É 日本語 😀 End", "A\tB  c.D e;f\x0bg\rh a\x00b"]
words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# conversation repair

STEP = {"": "su", "s": "u", "u": "a", "a": "u"}


def brute_repair(turns):
    """Cheapest (cost, audit, lines) of (role, text, fault), by Dijkstra over plain strings."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(turns) and state in ("", "a"):
            return cost, audit, list(lines)
        for s, name in (("u", "user"), ("a", "assistant")):
            if s in STEP[state]:
                heapq.heappush(heap, (cost + 3, audit + "I", i, s, (*lines, name + ":")))
        if i < len(turns):
            role, text, fault = turns[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, lines))
            more = 3 * (fault == 3)
            if fault in (1, 2):
                continue
            if role and role[0] in STEP[state]:
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*lines, f"{role}:{text}")))
            for s, name in (("u", "user"), ("a", "assistant")):
                if s in STEP[state]:
                    heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, s, (*lines, f"{name}:{text}")))
    raise AssertionError


def brute_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append((role, text, 1 if not last else 2 if (role, text) in seen else 3 if last[-1] not in ".!?" else 0))
        seen.add((role, text))
    return out


def brute_report(rows):
    found = {}
    for conv, turn, role, text in rows:
        at = found.setdefault(conv, [])
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        at.extend([(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
    out = []
    for conv, at in found.items():
        at.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = brute_faults([r[1:] for r in at])
        cost, audit, lines = brute_repair(turns)
        numbers = {r[0] for r in at} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        count = Counter(t[2] for t in turns)
        out.append((conv, gaps, count[1], count[2], count[3], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


TURN = st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", " "]), st.just("t"), st.sampled_from([0, 0, 0, 1, 2, 3]))


def repaired(turns):
    repair, lines = conversation_repair.Repair(), []
    for t in turns:
        lines += [f"{role}:{text}" for _, role, text in repair.take(*t)]
    lines += [f"{role}:{text}" for _, role, text in repair.end()]
    return repair.paths.cost, "".join(repair.audit), lines


@settings(max_examples=400, deadline=None)
@given(st.lists(TURN, max_size=9))
def test_repairs_are_the_cheapest_and_first(turns):
    assert repaired(turns) == brute_repair(turns)


@pytest.mark.parametrize("roles", [["user", "assistant"], ["system"], ["user"], ["assistant", "system"], ["tool"], ["system", "user", "assistant", "tool"]])
def test_long_conversations_pass_through_the_window(roles):
    rng = random.Random(5)
    for n in (23, 24, 25, 47, 48, 700):
        turns = [(rng.choice(roles), str(i), rng.choice([0, 0, 0, 0, 1, 2, 3])) for i in range(n)]
        assert repaired(turns) == brute_repair(turns)
    repair = conversation_repair.Repair()
    for i in range(20_000):
        list(repair.take("user" if i % 2 else "assistant", "t", 0))
        assert len(repair.waiting) < 200 and repair.paths.width < 1000
    list(repair.end())
    assert len("".join(repair.audit)) >= 20_000


def conversation_rows():
    rng, rows = random.Random(3), []
    texts = ["Yes.", "No!", "What?", "cut off", "", " \n", None, "Ends. ", "dots.. \x0b", "ΑΣ É 日本語。", "q" * 5000 + "."]
    for conv in range(60):
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, turn * rng.choice([1, 1, 1, 2]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts)))
    rows += [(None, 1, "user", "a."), (None, None, "assistant", "b."), (70, None, "user", "c."), (70, None, "user", "c."), (71, 5, "user", "d."), (71, 5, "user", "d."), (72, 2**40, "user", "e."), (72, -5, "assistant", "f.")]
    rows += [(100 + i, 0, "user", "one turn.") for i in range(60)]
    return rows


def test_the_query_equals_brute_force_and_its_sql(spark, tmp_path):
    rows = conversation_rows()
    folder = write(spark, tmp_path, conversations=spark.createDataFrame(rows, CONVERSATIONS))
    result = queries()["op11_conversation_repair"](spark, folder)
    got = sorted(map(str, (tuple(r) for r in result.collect())))
    assert got == sorted(map(str, brute_report(rows)))
    assert any("''" in g and hashlib.sha256(b"").hexdigest() in g for g in got)  # all turns dropped
    same(result, oracle(oracle_sql()["op11_conversation_repair"], folder, ["conversations"]), "conv_id")


def test_repaired_turns_and_other_ids(spark):
    rows = [("x", 0, "assistant", "Hi.", 9), ("x", 1, "tool", "Go", 9), ("x", 2, "tool", "Go", 9), ("y", 0, None, None, 9)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, cost int")
    turns = [tuple(r) for r in conversation_repair.repaired_turns(df).orderBy("conv_id", "step").collect()]
    cost, audit, lines = brute_repair(brute_faults([("assistant", "Hi."), ("tool", "Go"), ("tool", "Go")]))
    assert [f"{t[3]}:{t[4]}" for t in turns] == lines and "".join(t[2] for t in turns) == audit.replace("D", "")
    report = {r.conv_id: r for r in conversation_repair.repair_report(df).collect()}
    assert report["x"].cost == cost and report["y"].audit == "D" and report["y"].blank == 1
    assert conversation_repair.repair_report(df.limit(0)).count() == 0 and conversation_repair.repaired_turns(df.limit(0)).count() == 0


# collocations


def brute_collocations(docs, longest=5, least=100, top=2000):
    f, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, min(longest, len(w) - i) + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    often = {g: a for g, a in f.items() if a >= least and len(g[1]) > 1}
    out = {}
    for (lang, p), a in often.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
        if any(la == lang and len(q) > len(p) and b >= a and inside(q) for (la, q), b in often.items()):
            continue
        cuts = [(Fraction(1000 * a * total[lang], f[lang, p[:k]] * f[lang, p[k:]]).__floor__(), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], total[lang]))
    rows = []
    for lang, found in out.items():
        rows += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r, n) in enumerate(sorted(found)[:top])]
    return sorted(rows)


def phrase_documents():
    rng = random.Random(11)
    vocabulary = ["The", "cat", "sat", "on", "mat", "a", "É", "日本", "x\x00y", "é"]
    rows = []
    for i in range(1500):
        parts = [rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]).join(rng.choice(vocabulary[: rng.choice([3, 10])]) for _ in range(rng.randint(1, 40)))]
        if i % 3 == 0:
            parts.append("once upon a time in the west the end")
        rows.append((i, rng.choice([" ", ";", "\r"]).join(parts), rng.choice(["en", "de", "und", None])))
    rows += [(1000 + i, t, "en") for i, t in enumerate(ODD)] + [(7, "w" * 3000 + " " + "v" * 3000, "en")] * 120
    return [(*r, "s", None) for r in rows]


def test_collocations_equal_brute_force_and_sql(spark, tmp_path, monkeypatch):
    rows = phrase_documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = brute_collocations([(r[2], r[1]) for r in rows])
    folder = write(spark, tmp_path, documents=docs)
    result = queries()["op12_collocations"](spark, folder)
    assert sorted(tuple(r) for r in result.collect()) == want and len(want) > 20
    same(result, oracle(oracle_sql()["op12_collocations"], folder, ["documents"]), "phrase")
    for name, value in (("CHUNK", 300), ("HOLD", 100), ("HOLD_GRAMS", 20), ("GROUP", 500), ("MIN_BLOCKS", 1), ("MAX_BLOCKS", 2)):
        monkeypatch.setattr(collocations, name, value)  # many parts, and a bit table that lets through nearly all
    small = collocations.mine_collocations(docs.repartition(5), longest=4, least=40, top=30)
    assert sorted(tuple(r) for r in small.collect()) == brute_collocations([(r[2], r[1]) for r in rows], 4, 40, 30)


def test_collocations_of_nothing_and_of_clashing_columns(spark):
    docs = documents(spark, [(1, None), (2, "")]).withColumns({"phrase": F_lit("p"), "size": F_lit("s"), "c": F_lit("c")})
    assert collocations.mine_collocations(docs).collect() == collocations.mine_collocations(docs.limit(0)).collect() == []
    assert [r.rank for r in collocations.mine_collocations(documents(spark, [(1, "a b " * 200)])).collect()] == [1, 2, 3, 4]


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_scores_pass_64_bits_and_stay_exact(spark):
    a, l, r, n = 3_000_000_007, 4_000_000_007, 5_000_000_003, 9_000_000_000_011
    counts = spark.createDataFrame([("en", "", 0, n), ("en", "x", 1, l), ("en", "y", 1, r), ("en", "x y", 2, a)], "lang string, phrase string, size int, f long")
    (row,) = collocations.scored(counts.filter("size = 2"), counts).collect()
    assert (row.a, row.l, row.r, row.n, row.score) == (a, l, r, n, 1000 * a * n // (l * r))


# simhash


def brute_fingerprint(text):
    w = words(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def components(fps, distance=3):
    least = {}
    todo = set(fps)
    while todo:
        stack, group = [todo.pop()], []
        while stack:
            x = stack.pop()
            group.append(x)
            near = {y for y in todo if (x ^ y).bit_count() <= distance}
            todo -= near
            stack += near
        least |= {x: min(group) for x in group}
    return least


def test_fingerprints_equal_brute_force(monkeypatch):
    for block in (1 << 20, 50, 1):
        monkeypatch.setattr(simhash, "BLOCK", block)
        for text in [*ODD[:6], *ODD[8:], "Some Words here " * 30, "a b c", "a b", " lead and trail  "]:
            assert simhash.fingerprint((text or "").encode()) == brute_fingerprint(text)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 300), st.integers(0, 8))
def test_links_of_a_group_join_its_components(seed, n, flips):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = sorted({rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, flips))) for _ in range(n)})
    found = np.array(fps, np.uint64)
    a, b = simhash._links(found, 3)
    assert len(a) < max(1, len(fps)) and all((x ^ y).bit_count() <= 3 for x, y in zip(a.tolist(), b.tolist(), strict=True))
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        parent[max(root(x), root(y))] = min(root(x), root(y))
    assert {x: root(x) for x in fps} == components(fps)


def test_every_split_of_the_bits_keeps_links():
    masks = [0]
    for _ in range(4):
        masks = sorted({p for m in masks for p in simhash.parts(m)})
    rng = random.Random(1)
    for _ in range(200):
        flips = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not m & flips for m in masks)


def test_crowded_blocks_are_dealt_anew(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(200)} | {0, 7, 1 << 63}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    links = simhash.near_fingerprints(nodes, "fp", crowd=16).collect()
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        x, y = r.a % (1 << 64), r.b % (1 << 64)
        assert (x ^ y).bit_count() <= 3
        parent[max(root(x), root(y))] = min(root(x), root(y))
    assert {x: root(x) for x in fps} == components(fps)


def test_the_simhash_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    v = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    base = [[rng.choice(v) for _ in range(rng.randint(40, 300))] for _ in range(25)]
    rows = []
    for i in range(200):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            w[rng.randrange(len(w))] = rng.choice(v).upper()
        rows.append((i, rng.choice([" ", "\n"]).join(w)))
    rows += [(500 + i, t) for i, t in enumerate(ODD)] + [(600, rows[0][1]), (600, rows[0][1]), (None, rows[1][1]), (None, None), (None, "alone in the world " * 9)]
    folder = write(spark, tmp_path, documents=documents(spark, rows))
    got = sorted(map(str, (tuple(r) for r in queries()["op13_simhash"](spark, folder).collect())))
    fp = [brute_fingerprint(t) for _, t in rows]
    comp = components(fp)
    ids = {}
    for (i, _), x in zip(rows, fp, strict=True):
        if i is not None:
            ids[comp[x]] = min(i, ids.get(comp[x], i))
    assert got == sorted(str((i, f"{x:016x}", ids.get(comp[x]))) for (i, _), x in zip(rows, fp, strict=True))
    assert len(set(comp.values())) < len(set(fp)) < len(rows)


def test_simhash_keeps_other_columns(spark):
    docs = spark.createDataFrame([("b", "same text here", 1, 2, 3), ("a", "same text here", 4, 5, 6)], "id string, body string, __fp int, fingerprint int, least_id int")
    out = simhash.simhash_classes(docs, "id", "body")
    assert sorted(out.columns) == sorted(["id", "__fp", "least_id", "fingerprint", "component_id"])
    assert sorted((r.id, r["__fp"], r.least_id, r.component_id) for r in out.collect()) == [("a", 4, 6, "a"), ("b", 1, 3, "a")]
    assert simhash.simhash_classes(docs.limit(0), "id", "body").count() == 0
