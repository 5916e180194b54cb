"""Tool-call linking and token counts: SQL, brute force, odd rows."""

import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import token_counts, tool_calls

from .helpers import TWINS, documents, oracle, same, sentence, vocabulary, write

ODD = [None, "", " \n", "word", "x" * 20_000, "the cat " * 4000, "ΑΣ é 日本語 😀", "▁a ▁", "a\x00b", *TWINS]


# token counts


def naive_count(word, pieces):
    best, longest = [(0.0, 0)], max(map(len, pieces))
    for end in range(1, len(word) + 1):
        starts = range(max(0, end - longest), end)
        found = [(-(best[a][0] + pieces[word[a:end]]), best[a][1] + 1) for a in starts if word[a:end] in pieces]
        if found:
            score, n = min(found)
            best.append((-score, n))
        else:
            size = len(word[end - 1].encode())
            best.append((best[-1][0] + size * token_counts.BYTE_SCORE, best[-1][1] + size))
    return best[-1][1]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text(alphabet="abcé", min_size=1, max_size=4), st.floats(-9, -0.1), min_size=1, max_size=12), st.sets(st.text(alphabet="abcdé語", max_size=9), min_size=1, max_size=12))
def test_shared_prefixes_change_nothing(pieces, words):
    words = sorted(words)
    assert token_counts.UnigramTrie(pieces).counts(words) == [naive_count(w, pieces) for w in words]


@pytest.mark.parametrize("shard", [token_counts.SHARD_WORDS, 50])
def test_counts_of_documents(spark, monkeypatch, shard):
    monkeypatch.setattr(token_counts, "SHARD_WORDS", shard)
    rng, v = random.Random(2), vocabulary(2)
    rows = [(i, sentence(rng, rng.randint(0, 60), v)) for i in range(80)] + [(100 + i, t) for i, t in enumerate(ODD)] + [(0, "twice"), (0, "twice"), (None, "no id")]
    df = documents(spark, rows).withColumn("n_tokens", F.lit("clash"))
    pieces = token_counts.load_pieces(token_counts.default_vocabulary())
    got = token_counts.count_tokens(df).collect()
    want = [(i, len(w := re.findall("[^\x20\x09-\x0d]+", t or "")), sum(naive_count("▁" + x, pieces) for x in w)) for i, t in rows]
    assert sorted(map(str, ((r.doc_id, r.n_pretokens, r.n_tokens) for r in got))) == sorted(map(str, want))
    assert token_counts.count_tokens(df.limit(0)).count() == 0


def test_the_query_counts_whole_texts(spark, tmp_path):
    rng, v = random.Random(9), vocabulary(9)
    rows = [(i, sentence(rng, rng.randint(0, 60), v)) for i in range(30)] + [(100 + i, t) for i, t in enumerate(ODD)]
    folder = write(spark, tmp_path, documents=documents(spark, rows))
    pieces = token_counts.load_pieces(token_counts.default_vocabulary())
    want = [(i, len(w := re.findall("[^\x20\x09-\x0d]+", t or "")), sum(naive_count("▁" + x, pieces) for x in w)) for i, t in rows]
    got = token_counts.op9_token_counts(spark, folder)
    assert got.columns == ["doc_id", "n_pretokens", "n_tokens"] and sorted(map(tuple, got.collect())) == sorted(want)


# tool calls

PLAIN = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text(max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=6)


@given(PLAIN)
def test_canonical_json(value):
    text = tool_calls.canonical(value)
    assert json.loads(text) == value and tool_calls.canonical(json.loads(text)) == text


@pytest.mark.parametrize(
    ("value", "errors"),
    [
        ({"text": "a", "words": 7}, []),
        ({"words": 7}, ["/text: required"]),
        ({"text": "", "words": 2, "more": 1}, ["/more: unknown", "/text: minLength", "/words: minimum"]),
        ({"text": 5, "words": True}, ["/text: not string", "/words: not integer"]),
        ([], ["/: not object"]),
    ],
)
def test_schema(value, errors):
    assert tool_calls.schema_errors(value, tool_calls.SCHEMAS["reply"]) == errors


def test_schema_of_lists_and_enums():
    schema = {"type": "array", "items": {"type": "number", "enum": [1, 2.5], "maximum": 2}}
    assert tool_calls.schema_errors([1, 2.5, "x"], schema) == ["/1: maximum", "/2: not number"]


def test_links_levels_and_errors(spark):
    ok = json.dumps({"text": "a", "words": 9})
    calls = spark.createDataFrame(
        [
            (1, 0, "a", "reply", ok, None), (1, 1, "b", "reply", ok, ["a"]), (1, 2, "c", "reply", ok, ["a", "b"]), (1, 3, "d", "reply", ok, ["none"]),
            (2, 0, "x", "reply", ok, ["y"]), (2, 1, "y", "reply", ok, ["x"]), (2, 2, "z", "reply", ok, ["y", "a"]), (2, 3, "s", "reply", ok, ["s"]),
            (3, 0, None, "reply", ok, []), (3, 1, "e", "nothing", ok, []), (3, 2, "f", "reply", "{bad", []), (3, 3, "g", "reply", None, []), (3, 4, "g", "reply", ok, []),
        ],
        tool_calls.CALLS,
    )
    results = spark.createDataFrame([(1, 1, "a", "first"), (1, 2, "a", "late"), (1, 2, "b", None), (9, 9, "q", "orphan"), (9, 9, None, "nameless")], tool_calls.RESULTS)
    got = tool_calls.link_tool_calls(calls, results).collect()
    by = {(r.call_id, r.turn): r for r in got}
    assert len(got) == 15
    assert {k[0]: r.level for k, r in by.items()} | {} == {"a": 0, "b": 1, "c": 2, "d": 0, "x": None, "y": None, "z": None, "s": None, None: None, "e": 0, "f": 0, "g": 0, "q": None}
    assert (by["a", 0].status, by["a", 0].n_results, json.loads(by["a", 0].record)["result"]) == ("linked", 2, "first")
    assert by["b", 1].status == "linked" and by["c", 2].status == "missing_result" and by["q", 9].status == by[None, 9].status == "orphan_result"
    assert by["d", 3].errors == ["unresolved dependency"] and by["x", 0].errors == ["cyclic dependency"] and by["z", 2].errors == ["unresolved dependency", "cyclic dependency"]
    assert by[None, 0].errors == [] and by["e", 1].errors == ["unknown tool"] and by["f", 2].errors == by["g", 3].errors == ["/: not JSON"] and by["g", 4].errors == []
    assert tool_calls.link_tool_calls(calls.limit(0), results.limit(0)).count() == 0
    assert tool_calls.link_tool_calls(calls.limit(0), results).count() == 5


def link(spark, calls, results=(), schemas=None):
    rows = tool_calls.link_tool_calls(spark.createDataFrame(calls, tool_calls.CALLS), spark.createDataFrame(list(results), tool_calls.RESULTS), schemas)
    return {(r.conv_id, r.call_id): r for r in rows.collect()}


def test_identifiers_belong_to_their_conversation(spark):
    ok = json.dumps({"text": "a", "words": 9})
    by = link(spark, [(1, 0, "call_0", "reply", ok, None), (2, 0, "call_0", "reply", ok, ["call_1"]), (2, 1, "call_1", "reply", ok, []), (None, 0, "call_0", "reply", ok, [])], [(1, 1, "call_0", "one"), (2, 1, "call_0", "two"), (None, 1, "call_0", "none")])
    assert [json.loads(by[c, "call_0"].record)["result"] for c in (1, 2, None)] == ["one", "two", "none"]
    assert all(by[c, "call_0"].n_results == 1 for c in (1, 2, None)) and (by[1, "call_0"].level, by[2, "call_0"].level) == (0, 1)


def test_odd_arguments_are_errors(spark):
    schema = {"t": {"type": ["object", "null"], "properties": {"n": {"type": "integer"}, "c": {"const": 1}}}, "bad": {"type": "nonsense"}, "none": False}
    texts = ['{"text":"\\ud800x"}', "null", '{"n":NaN}', '{"n":Infinity}', '{"n":1e999}', '{"n":2.0}', '{"n":2.5}', '{"c":true}', '{"\\udfff":[]}', "[]"]
    by = link(spark, [(1, i, str(i), "t", t, None) for i, t in enumerate(texts)] + [(1, 20, "bad", "bad", "{}", None), (1, 21, "none", "none", "1", [None, "0", "0"])], schemas=schema)
    errors = [by[1, str(i)].errors for i in range(len(texts))]
    assert errors == [[], [], ["/: not JSON"], ["/: not JSON"], ["/: not JSON"], [], ["/n: not integer"], ["/c: not the constant"], [], ["/: not object or null"]]
    assert json.loads(by[1, "0"].record)["arguments"]["text"] == "\ud800x" and "NaN" not in by[1, "2"].record
    assert by[1, "bad"].errors == ["/: schema cannot be applied (KeyError)"] and by[1, "none"].errors == ["/: not allowed"] and by[1, "none"].level == 1


def test_levels_of_diamonds_take_few_rounds(spark, monkeypatch):
    rng, n = random.Random(4), 40
    calls = [(1, i, f"d{i}_{side}", "t", "1", [] if i == 0 else [f"d{i - 1}_a", f"d{i - 1}_b"]) for i in range(n) for side in "ab"]
    calls += [(2, i, f"c{i}", "t", "1", rng.sample([f"c{j}" for j in range(i)], min(i, rng.randint(0, 6)))) for i in range(60)]
    want = {(1, f"d{i}_{side}"): i for i in range(n) for side in "ab"}
    for _, i, name, _, _, after in calls[2 * n :]:
        want[2, name] = max((want[2, a] + 1 for a in after), default=0)
    rounds = []
    real = tool_calls.materialize
    monkeypatch.setattr(tool_calls, "materialize", lambda df, tag: rounds.append(tag) or real(df, tag))
    df = spark.createDataFrame(calls, tool_calls.CALLS).withColumnRenamed("conv_id", "conv")
    assert {(r.conv, r.call_id): r.level for r in tool_calls.levels(df).collect()} == want
    assert rounds.count("call-met") <= 12


def brute_levels(after):
    """Longest ways by repeated fixing of calls whose dependencies are fixed; None for the others."""
    found = {}
    while ready := [c for c in after if c not in found and all(d in found for d in after[c])]:
        found |= {c: max((found[d] + 1 for d in after[c]), default=0) for c in ready}
    return {c: found.get(c) for c in after}


def test_levels_of_lattices_and_cycles(spark, monkeypatch):
    rng = random.Random(7)
    convs = {1: {f"call_{t}": [f"call_{d}" for d in ((t - 4, t - 2) if t >= 4 and t % 4 == 0 else (t - 2,)) if d >= 0] for t in range(0, 400, 2)}}
    convs[2] = {f"n{i}": [f"n{j}" for j in (i - 1, i - 3) if j >= 0] for i in range(120)}
    for conv in range(3, 15):  # with cycles of any length, loops, and calls above them
        n = rng.randint(2, 14)
        convs[conv] = {f"k{i}": [f"k{j}" for j in rng.sample(range(n), rng.randint(0, min(3, n)))] for i in range(n)}
    convs[15] = {"a": ["b"], "b": ["a"], "x": ["a", "b"], "y": ["x", "z"], "z": []}
    turn = lambda name, conv: int("".join(c for c in name if c.isdigit()) or 0) if conv != 2 else None
    rows = [(conv, turn(name, conv), name, "t", "1", deps) for conv, after in convs.items() for name, deps in after.items()]
    rounds = []
    real = tool_calls.materialize
    monkeypatch.setattr(tool_calls, "materialize", lambda df, tag: rounds.append(tag) or real(df, tag))
    df = spark.createDataFrame(rows, tool_calls.CALLS).withColumnRenamed("conv_id", "conv")
    want = {(conv, name): level for conv, after in convs.items() for name, level in brute_levels(after).items()}
    assert {(r.conv, r.call_id): r.level for r in tool_calls.levels(df).collect()} == want
    assert rounds.count("call-met") <= 14


def test_conversations_equal_the_sql(spark, tmp_path):
    rng, v = random.Random(1), vocabulary(1)
    rows = []
    for conv in range(60):
        turn = rng.choice([0, 1])
        for _ in range(rng.randint(1, 6)):
            for role in ("user", "assistant"):
                if rng.random() < 0.85:
                    rows.append((conv, turn, role, sentence(rng, rng.randint(1, 20), v) + rng.choice(["", ' "é"\n', "\\ /\t"])))
                turn += 1
    rows += [(500, 0, "user", ""), (500, 1, "assistant", "two"), (500, 1, "assistant", "one"), (501, 0, "system", "x")]
    folder = write(spark, tmp_path, conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    same(tool_calls.op6_tool_calls(spark, folder), oracle(tool_calls.ORACLE_SQL, folder, ["conversations"]), "call_id")


def test_conversations_with_nulls(spark, tmp_path):
    rows = [(None, 0, "user", "a"), (1, None, "user", None), (1, 1, None, "x"), (None, 1, "assistant", None), (2, 0, "user", None), (2, 0, "user", None)]
    folder = write(spark, tmp_path, conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = tool_calls.op6_tool_calls(spark, folder).collect()
    assert sorted(r.status for r in got) == ["missing_result"] * 4 + ["orphan_result"] and all(r.n_errors for r in got if r.status == "missing_result")
