"""Operator 6: tool-call linking for chat records.

Calls and results are joined by conversation and identifier with a hash join: identifiers are those of their
conversation, as logs reuse them. Calls are put in topological order of the calls they depend on: level 0
depends on none, each other call is one above the highest call it depends on. Arguments are validated against the
schema of their tool, and each call becomes one line of canonical JSON (sorted keys, no spaces, no escapes for
non-ASCII characters; lone surrogates, which UTF-8 cannot hold, stay escaped).

An identifier's first result (by turn, then text) is the one that is linked; more are counted in
n_results, so that repeated results multiply nothing. Results without a call are rows of status
``orphan_result``, calls without a result ``missing_result``; a call or result with a null identifier links
with nothing. A null conversation is one of its own kind: identifiers link within it. Repeated calls are rows each.
Dependencies that do not exist in the conversation count as errors; calls on a cycle, or above one, have a null level
and an error. Null or malformed arguments, and NaN or infinite numbers, which JSON lacks, are errors, never
failures; so is a schema that is no schema. Other columns are left out. Empty tables give empty results.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spark_io import discard, materialize

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"
#: Schemas by tool: the part of JSON Schema that is checked.
SCHEMAS: dict[str, dict] = {
    "reply": {
        "type": "object",
        "required": ["text", "words"],
        "properties": {"text": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 5}, "after": {"type": "array", "items": {"type": "string"}}},
        "additionalProperties": False,
    },
    "recall": {
        "type": ["object", "null"],
        "required": ["after", "text"],
        "properties": {"text": {"type": ["string", "null"], "minLength": 1}, "words": {"type": "integer", "minimum": 8}, "after": {"type": "array", "items": {"type": "string"}}},
        "additionalProperties": False,
    },
}
#: Most dependencies of a call that is skipped over, and most edges of a call that skips.
FAN, EDGES = 4, 16
_TYPES: dict[str, tuple[type, ...]] = {"object": (dict,), "array": (list,), "string": (str,), "integer": (int,), "number": (int, float), "boolean": (bool,), "null": (type(None),)}


def canonical(value: Any) -> str:
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def parse(text: str | None) -> Any:
    """The value of a JSON text; ValueError if it is none."""

    def refuse(name: str) -> None:
        raise ValueError(f"{name} is not JSON")

    def finite(number: str) -> float:
        if (value := float(number)) in (math.inf, -math.inf):
            raise ValueError(f"{number} is too large")
        return value

    if text is None:
        raise ValueError("nothing")
    return json.loads(text, parse_constant=refuse, parse_float=finite)


def _is(value: Any, kind: str) -> bool:
    """Whether a value has a type of JSON Schema; a number without a fraction is an integer, a boolean is no number."""
    if kind == "integer" and isinstance(value, float):
        return value.is_integer()
    return isinstance(value, _TYPES[kind]) and not (isinstance(value, bool) and kind in ("integer", "number"))


def _equal(a: Any, b: Any) -> bool:
    """Equality of JSON values: true is not 1."""
    return canonical(a) == canonical(b) or (isinstance(a, int | float) and isinstance(b, int | float) and not isinstance(a, bool) and not isinstance(b, bool) and a == b)


def schema_errors(value: Any, schema: dict | bool, at: str = "") -> list[str]:
    """What ``value`` breaks of type (one or a list), enum, const, minimum, maximum, minLength, maxLength, required,
    properties, additionalProperties and items."""
    here = at or "/"
    if isinstance(schema, bool):
        return [] if schema else [f"{here}: not allowed"]
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else list(kinds)
        if not any(_is(value, k) for k in kinds):
            return [f"{here}: not {' or '.join(kinds)}"]
    found = []
    if "enum" in schema and not any(_equal(value, x) for x in schema["enum"]):
        found.append(f"{here}: not in enum")
    if "const" in schema and not _equal(value, schema["const"]):
        found.append(f"{here}: not the constant")
    if isinstance(value, int | float) and not isinstance(value, bool):
        found += [f"{here}: {name}" for name, bad in (("minimum", value < schema.get("minimum", value)), ("maximum", value > schema.get("maximum", value))) if bad]
    if isinstance(value, str):
        found += [f"{here}: {name}" for name, bad in (("minLength", len(value) < schema.get("minLength", 0)), ("maxLength", len(value) > schema.get("maxLength", len(value)))) if bad]
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += schema_errors(x, schema["items"], f"{at}/{i}")
    if isinstance(value, dict):
        known, others = schema.get("properties", {}), schema.get("additionalProperties", True)
        found += [f"{at}/{k}: required" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                found += schema_errors(value[k], known[k], f"{at}/{k}")
            elif others is False:
                found.append(f"{at}/{k}: unknown")
            elif others is not True:
                found += schema_errors(value[k], others, f"{at}/{k}")
    return found


def argument_errors(value: Any, schema: dict | bool | None) -> list[str]:
    """Errors of a call's arguments, as text that UTF-8 can hold."""
    if schema is None:
        return ["unknown tool"]
    try:
        found = schema_errors(value, schema)
    except (AttributeError, KeyError, RecursionError, TypeError, ValueError) as e:
        found = [f"/: schema cannot be applied ({type(e).__name__})"]
    return [re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", x) for x in found]


def _needed(edges: DataFrame) -> DataFrame:
    """``edges`` (conv, call_id, dep, at, w) without those that a way of two edges, of as many steps or more, makes idle.

    The call between must come after the dependency, by (at, id): so of a call's edges to calls on or above a cycle the
    one that comes last stays, and cycles stay cycles. Levels stay too: the longest ways have edges that stay. Ways
    are looked for under the limits FAN and EDGES.
    """
    counts = edges.groupBy("conv", "call_id").agg(F.count(F.lit(1)).alias("n"))
    above = edges.join(counts.filter(F.col("n") <= EDGES), ["conv", "call_id"]).select("conv", "call_id", F.col("dep").alias("over"), F.col("at").alias("over_at"), F.col("w").alias("first"))
    below = edges.join(counts.filter(F.col("n") <= FAN), ["conv", "call_id"]).select("conv", F.col("call_id").alias("over"), "dep", "at", F.col("w").alias("second"))
    ways = above.join(below, ["conv", "over"]).filter(F.struct("over_at", "over") > F.struct("at", "dep"))
    longest = ways.groupBy("conv", "call_id", "dep").agg(F.max(F.col("first") + F.col("second")).alias("way"))
    kept = edges.join(longest, ["conv", "call_id", "dep"], "left").filter(F.col("way").isNull() | (F.col("way") < F.col("w")))
    return kept.select("conv", "call_id", "dep", "at", "w")


def levels(calls: DataFrame) -> DataFrame:
    """(conv, call_id, level) of calls (conv, call_id, after, and turn if there is one): topological levels over ``after``;
    null on and above cycles.

    Each round fixes the calls whose dependencies are all fixed, and lets edges skip over dependencies that have at
    most FAN of their own, adding up the steps, for calls with at most EDGES edges. Idle edges are dropped before, so
    that skips do not add up edges. Ways of n steps, diamonds and lattices among them, so take log n rounds; where
    calls need more dependencies than that, a round for each level.
    """
    known = calls.filter(F.col("call_id").isNotNull())
    at = F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long")) if "turn" in calls.columns else F.lit(0).cast("long")
    nodes = known.select("conv", "call_id").distinct()
    places = known.select("conv", F.col("call_id").alias("dep"), at.alias("at")).groupBy("conv", "dep").agg(F.min("at").alias("at"))
    whole = known.select("conv", "call_id", F.explode("after").alias("dep")).distinct().join(places, ["conv", "dep"])
    whole = materialize(whole.select("conv", "call_id", "dep", "at", F.lit(1).cast("long").alias("w")), "call-edges")
    edges = materialize(_needed(whole), "call-edges")
    discard(whole)
    done = materialize(nodes.join(edges, ["conv", "call_id"], "left_anti").select("conv", "call_id", F.lit(0).cast("long").alias("level")), "call-levels")
    while not edges.isEmpty():
        fixed = done.withColumnRenamed("call_id", "dep")
        counts = edges.groupBy("conv", "call_id").agg(F.count(F.lit(1)).alias("n"))
        below = edges.join(counts.filter(F.col("n") <= FAN), ["conv", "call_id"]).select("conv", F.col("call_id").alias("dep"), F.col("dep").alias("next"), F.col("at").alias("next_at"), F.col("w").alias("more"))
        few = edges.join(counts, ["conv", "call_id"]).join(fixed, ["conv", "dep"], "left")
        far = F.when(F.col("level").isNull() & (F.col("n") <= EDGES), F.col("dep")).alias("over")
        met = few.select("conv", "call_id", "dep", "at", "w", "level", far).join(below.withColumnRenamed("dep", "over"), ["conv", "over"], "left")
        skips = F.col("next").isNotNull()
        met = met.select("conv", "call_id", F.when(skips, F.col("next")).otherwise(F.col("dep")).alias("dep"), F.when(skips, F.col("next_at")).otherwise(F.col("at")).alias("at"), F.when(skips, F.least(F.col("w") + F.col("more"), F.lit(1 << 50))).otherwise(F.col("w")).alias("w"), (F.col("level") + F.col("w")).alias("value"))
        met = materialize(met.groupBy("conv", "call_id", "dep").agg(F.max("at").alias("at"), F.max("w").alias("w"), F.when(F.count("value") == F.count(F.lit(1)), F.max("value")).alias("value")), "call-met")
        ready = met.groupBy("conv", "call_id").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("k"), F.max("value").alias("level")).filter("n = k").select("conv", "call_id", "level")
        ready = materialize(ready, "call-ready")
        if ready.isEmpty():
            break
        done = done.unionByName(ready)
        rest = materialize(_needed(met.join(ready, ["conv", "call_id"], "left_anti").select("conv", "call_id", "dep", "at", "w")), "call-edges")
        for spent in (edges, met):
            discard(spent)
        edges = rest
    return nodes.join(done, ["conv", "call_id"], "left").select("conv", "call_id", F.col("level").cast("int").alias("level"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """conv_id, turn, call_id, status, level, n_results, n_errors, errors, record (canonical JSON).

    ``calls`` and ``results`` have the columns of CALLS and RESULTS; others are left out.
    """
    spark = calls.sparkSession
    known = spark.sparkContext.broadcast(SCHEMAS if schemas is None else schemas)
    conv = F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("id")).alias("conv")  # null is a conversation
    after = F.array_distinct(F.filter(F.coalesce("after", F.array().cast("array<string>")), lambda x: x.isNotNull()))
    calls = calls.select(conv, "conv_id", "turn", "call_id", "name", "arguments", after.alias("after"))
    results = results.select(conv, "conv_id", "turn", "call_id", "content")
    named = results.filter(F.col("call_id").isNotNull())
    first = named.groupBy("conv", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    ids = calls.filter(F.col("call_id").isNotNull()).select("conv", "call_id").distinct()
    exist = calls.select("conv", "call_id", F.explode("after").alias("dep")).distinct().join(ids.withColumnRenamed("call_id", "dep"), ["conv", "dep"], "left_anti").groupBy("conv", "call_id").agg(F.count(F.lit(1)).alias("unresolved"))
    linked = (
        calls.join(first, ["conv", "call_id"], "left")
        .join(levels(calls), ["conv", "call_id"], "left")
        .join(exist, ["conv", "call_id"], "left")
        .select(
            "conv_id", "turn", "call_id", F.when(F.col("r").isNotNull(), F.lit("linked")).otherwise(F.lit("missing_result")).alias("status"), "level",
            F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"), "name", "arguments", "after", F.col("r.content").alias("content"), F.coalesce("unresolved", F.lit(0).cast("long")).alias("unresolved"),
        )
    )
    orphans = results.join(ids, ["conv", "call_id"], "left_anti").select(
        "conv_id", "turn", "call_id", F.lit("orphan_result").alias("status"), F.lit(None).cast("int").alias("level"), F.lit(1).cast("long").alias("n_results"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), F.array().cast("array<string>").alias("after"), "content", F.lit(0).cast("long").alias("unresolved"),
    )
    out = "conv_id long, turn long, call_id string, status string, level int, n_results long, n_errors long, errors array<string>, record string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors, records = [], []
            for r in batch.to_pylist():
                found: list[str] = []
                arguments = None
                if r["status"] != "orphan_result":
                    try:
                        arguments = parse(r["arguments"])
                    except (ValueError, RecursionError):
                        found.append("/: not JSON")
                    else:
                        found += argument_errors(arguments, known.value.get(r["name"]))
                    found += ["unresolved dependency"] * r["unresolved"]
                    if r["level"] is None and r["call_id"] is not None:
                        found.append("cyclic dependency")
                errors.append(found)
                keys = ("conv_id", "turn", "call_id", "status", "level", "name", "after")
                records.append(canonical({k: r[k] for k in keys} | {"arguments": arguments, "result": r["content"]}))
            kept = [batch.column(i) for i in range(6)]
            made = [pa.array([len(e) for e in errors], pa.int64()), pa.array(errors, pa.list_(pa.string())), pa.array(records, pa.string())]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*batch.schema.names[:6], "n_errors", "errors", "record"])

    return linked.unionByName(orphans).mapInArrow(run, out)


def calls_of_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations. Each user turn calls ``reply`` after the user turn two before it, if
    there could be one; from turn 4 on every second one calls ``recall`` instead, after the turns two and four before.
    Each assistant turn answers the turn before it. Identifiers count turns, so all conversations have the same ones."""
    name = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    users = turns.filter(F.col("role") == "user")
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    turn = F.col("turn")
    recalls = known & (turn >= 4) & (turn % 4 == 0)
    after = F.when(recalls, F.array(name(turn - 4), name(turn - 2))).when(known & (turn >= 2), F.array(name(turn - 2))).otherwise(F.array().cast("array<string>"))
    arguments = F.to_json(F.struct("text", words.alias("words"), F.when(F.size("after") > 0, F.col("after")).alias("after")))
    tool = F.when(recalls, F.lit("recall")).otherwise(F.lit("reply"))
    calls = users.withColumn("after", after).select("conv_id", "turn", F.when(known, name(turn)).alias("call_id"), tool.alias("name"), arguments.alias("arguments"), "after")
    results = turns.filter(F.col("role") == "assistant").select("conv_id", "turn", F.when(known, name(turn - 1)).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    linked = link_tool_calls(*calls_of_conversations(turns))
    return linked.select("conv_id", "turn", "call_id", "status", "level", "n_results", "n_errors", F.sha2(F.col("record").cast("binary"), 256).alias("record_sha256"))


ORACLE_SQL = r"""
WITH RECURSIVE c AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, 'call_' || turn AS call_id, text, turn >= 4 AND turn % 4 = 0 AS recalls,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         CASE WHEN turn >= 4 AND turn % 4 = 0 THEN ['call_' || (turn - 4), 'call_' || (turn - 2)] WHEN turn >= 2 THEN ['call_' || (turn - 2)] ELSE [] END AS deps
  FROM conversations WHERE role = 'user'
), r AS (
  SELECT conv_id, turn, 'call_' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'assistant'
), f AS (
  SELECT conv_id, call_id, count(*) AS n_results, arg_min(text, (turn, text)) AS result FROM r WHERE call_id IS NOT NULL GROUP BY ALL
), e AS (
  SELECT DISTINCT conv_id, call_id, dep FROM (SELECT conv_id, call_id, unnest(deps) AS dep FROM c)
), found AS (
  SELECT e.* FROM e SEMI JOIN c ON c.conv_id = e.conv_id AND c.call_id = e.dep
), ways AS (
  SELECT DISTINCT conv_id, call_id, 0 AS level FROM c
  UNION
  SELECT found.conv_id, found.call_id, ways.level + 1 FROM found JOIN ways ON found.conv_id = ways.conv_id AND found.dep = ways.call_id
), l AS (
  SELECT conv_id, call_id, max(level) AS level FROM ways GROUP BY ALL
), gone AS (
  SELECT conv_id, call_id, count(*) AS n FROM e ANTI JOIN c ON c.conv_id = e.conv_id AND c.call_id = e.dep GROUP BY ALL
), j AS (
  SELECT c.conv_id, c.turn, c.call_id, CASE WHEN f.call_id IS NULL THEN 'missing_result' ELSE 'linked' END AS status, l.level,
         coalesce(n_results, 0) AS n_results,
         (c.words < CASE WHEN recalls THEN 8 ELSE 5 END)::INT + (length(c.text) < 1)::INT + coalesce(gone.n, 0) AS n_errors,
         '{"after":' || to_json(deps) || ',"arguments":{' || CASE WHEN len(deps) = 0 THEN '' ELSE '"after":' || to_json(deps) || ',' END
           || '"text":' || to_json(c.text) || ',"words":' || c.words || '},"call_id":"' || c.call_id
           || '","conv_id":' || c.conv_id || ',"level":' || l.level || ',"name":"' || CASE WHEN recalls THEN 'recall' ELSE 'reply' END || '","result":' || coalesce(to_json(f.result)::VARCHAR, 'null')
           || ',"status":"' || CASE WHEN f.call_id IS NULL THEN 'missing_result' ELSE 'linked' END || '","turn":' || c.turn || '}' AS record
  FROM c JOIN l ON l.conv_id = c.conv_id AND l.call_id = c.call_id LEFT JOIN f ON f.conv_id = c.conv_id AND f.call_id = c.call_id
    LEFT JOIN gone ON gone.conv_id = c.conv_id AND gone.call_id = c.call_id
  UNION ALL
  SELECT conv_id, turn, call_id, 'orphan_result', NULL, 1, 0,
         '{"after":[],"arguments":null,"call_id":"' || call_id || '","conv_id":' || conv_id || ',"level":null,"name":null,"result":' || to_json(text)
           || ',"status":"orphan_result","turn":' || turn || '}'
  FROM r ANTI JOIN c ON c.conv_id = r.conv_id AND c.call_id = r.call_id
)
SELECT conv_id, turn, call_id, status, level::INT AS level, n_results::BIGINT AS n_results, n_errors::BIGINT AS n_errors, sha256(record) AS record_sha256 FROM j
"""
