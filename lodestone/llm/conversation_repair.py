"""Operator 11: the cheapest repair of a conversation's structure, with an audit of its edits.

A conversation's turns are taken by turn number (nulls first; equal ones by role, then text). A turn's first fault counts:
blank (no character but white space), duplicate (role and text of an earlier turn), truncated (it does not end
with ``.``, ``!`` or ``?``). Edits make the initials of the roles match ``(s?(ua)+)?``: K keeps a turn, R gives
it the role user or assistant, D deletes it (blank and duplicate turns must go), I inserts an empty turn. The repair
is the cheapest one; of equally cheap ones, that whose audit, the edits' initials in order, comes first in ASCII.

Everything is decided by one integer for each path through the graph of (turns taken, state of the pattern): its high
digits are the cost, and its low digits, of ``WIDTH`` bits each, the letters by their places, with zeros after the
last one. The least integer is the least cost and then the first audit. Two audits of equal cost up to one node never
begin one another, since the longer one would have more inserts, which cost, so later letters cannot turn a decision.

Turns stream through a task, sorted. What all surviving paths have in common is decided: its letters and turns leave the window
of the integers, so that these stay short and a conversation of any length needs the memory of its undecided turns.
Paths that cost over ``SLACK`` more than the cheapest can't win, since the cheapest can follow any of them at that price.
One conversation is one task's work, as the digest of one text must be; it is sorted and windowed by Spark, which spills.

Conversations all of whose turns were dropped have a row of zeros. A null id is one conversation. Null roles and texts count as
one space. A role that is empty fits nowhere. Repeated rows are repeated turns. Further columns are left aside. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import frugal

#: Costs of edits, and of a truncated turn that stays.
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Letters in ASCII order; a letter's digit is its place, from 1 on.
LETTERS, WIDTH = "DIKR", 3
_D, _I, _K, _R = 1, 2, 3, 4
#: States of the pattern: nothing yet, after a system turn, after a user's, after an assistant's.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {("s", BEGIN): SYSTEM, ("u", BEGIN): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
ROLES = {"u": "user", "a": "assistant"}
#: From any state, any other state's edits can be followed for at most this much more.
SLACK = 10
#: Letters in a window at first, and turns after which it is looked through for decided ones.
WINDOW, LOOK = 96, 24
BLANK, DUPLICATE, CUT = 1, 2, 3
SPACES = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}


class Paths:
    """The least integer of each state, over the turns taken so far, and the letters decided."""

    def __init__(self) -> None:
        self.width = WINDOW
        self.least: dict[int, tuple[int, int]] = {BEGIN: (0, 0)}  # state: integer, letters in the window
        self.cost = 0

    def _edge(self, node: tuple[int, int], cost: int, letter: int) -> tuple[int, int]:
        weight, n = node
        return weight + (cost << WIDTH * self.width) + (letter << WIDTH * (self.width - 1 - n)), n + 1

    def _offer(self, to: dict[int, tuple[int, int]], state: int, node: tuple[int, int]) -> bool:
        if state in to and to[state] <= node:
            return False
        to[state] = node
        return True

    def _inserts(self) -> None:
        todo = list(self.least)
        while todo:
            state = todo.pop()
            for initial in ROLES:
                to = NEXT.get((initial, state))
                if to is not None and self._offer(self.least, to, self._edge(self.least[state], INSERT, _I)):
                    todo.append(to)

    def take(self, initial: str, fault: int) -> None:
        """One more turn."""
        if max(n for _, n in self.least.values()) + 8 > self.width:
            self._widen()
        self._inserts()
        to: dict[int, tuple[int, int]] = {}
        more = TRUNCATED if fault == CUT else 0
        for state, node in self.least.items():
            self._offer(to, state, self._edge(node, DELETE, _D))
            if fault in (BLANK, DUPLICATE):
                continue
            kept = NEXT.get((initial, state))
            if kept is not None:
                self._offer(to, kept, self._edge(node, more, _K))
            for other in ROLES:
                renamed = NEXT.get((other, state))
                if renamed is not None:
                    self._offer(to, renamed, self._edge(node, RENAME + more, _R))
        self.least = to

    def _widen(self) -> None:
        digits = (1 << WIDTH * self.width) - 1
        wide = self.width + WINDOW
        self.least = {s: ((w >> WIDTH * self.width << WIDTH * wide) | (w & digits) << WIDTH * WINDOW, n) for s, (w, n) in self.least.items()}
        self.width = wide

    def decided(self) -> str:
        """Letters that all paths still in question have in common; they leave the window."""
        shift = WIDTH * self.width
        cheapest = min(w for w, _ in self.least.values()) >> shift
        self.least = {s: (w, n) for s, (w, n) in self.least.items() if (w >> shift) - cheapest <= SLACK}
        digits = [w & (1 << shift) - 1 for w, _ in self.least.values()]
        differ = 0
        for d in digits[1:]:
            differ |= d ^ digits[0]
        common = min(self.width - -(-differ.bit_length() // WIDTH), *(n for _, n in self.least.values()), self.width)
        letters = self._letters(digits[0], common)
        rest = (1 << WIDTH * (self.width - common)) - 1
        self.least = {s: (((w >> shift) - cheapest << shift) | (w & rest) << WIDTH * common, n - common) for s, (w, n) in self.least.items()}
        self.cost += cheapest
        return letters

    def _letters(self, digits: int, n: int) -> str:
        return "".join(LETTERS[(digits >> WIDTH * (self.width - 1 - i) & 7) - 1] for i in range(n))

    def end(self) -> str:
        """The last letters of the cheapest path; ``cost`` is then the whole cost."""
        if max(n for _, n in self.least.values()) + 8 > self.width:
            self._widen()
        self._inserts()
        weight, n = min(self.least[s] for s in (BEGIN, ASSISTANT) if s in self.least)
        self.cost += weight >> WIDTH * self.width
        return self._letters(weight, n)


class Repair:
    """Takes the turns of one conversation in order; ``turns`` yields what stands in the repaired one: (edit, role, text)."""

    def __init__(self) -> None:
        self.paths, self.waiting = Paths(), deque()
        self.state, self.audit, self.taken = BEGIN, [], 0

    def take(self, role: str, text: str, fault: int) -> Iterator[tuple[str, str, str]]:
        self.waiting.append((role, text))
        self.paths.take(role[:1], fault)
        self.taken += 1
        if self.taken % LOOK == 0:
            yield from self._apply(self.paths.decided())

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._apply(self.paths.end())

    def _apply(self, letters: str) -> Iterator[tuple[str, str, str]]:
        self.audit.append(letters)
        for edit in letters:
            role, text = ("", "") if edit == "I" else self.waiting.popleft()
            if edit == "D":
                continue
            if edit != "K":
                role = ROLES["a" if self.state == USER else "u"]
            self.state = NEXT[role[:1], self.state]
            yield edit, role, text


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): rows with the faults that crc32 of ``conv_id:turn`` gives them."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), F.explode(times).alias("copy")).drop("copy")


def faults(turns: DataFrame) -> DataFrame:
    """``turns`` with ``fault`` (0: none), in order within the partitions of ``conv_id``.

    Both sorts are done on one shuffle by conversation.
    """
    earlier = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy("turn")
    ended = F.rtrim("text", F.lit(SPACES))
    fault = (
        F.when(ended == "", BLANK)
        .when(F.col("again") > 1, DUPLICATE)
        .when(~F.substring(ended, -1, 1).isin(".", "!", "?"), CUT)
        .otherwise(0)
    )
    marked = turns.repartition("conv_id").withColumn("again", F.row_number().over(earlier)).withColumn("fault", fault).drop("again")
    return marked.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def _text_columns(conversations: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    dropped = F.col("dropped") if "dropped" in conversations.columns else F.lit(False).alias("dropped")
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"), dropped)


REPORT = [*[T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]


class _Report:
    """Measures of one conversation."""

    def __init__(self) -> None:
        self.repair, self.digest, self.lines = Repair(), hashlib.sha256(), 0
        self.low = self.high = self.turn = None
        self.turns, self.counts, self.illegal, self.initial = 0, [0, 0, 0, 0], 0, None

    def take(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        self.counts[fault] += 1
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in LEGAL
        self.initial = role[:1]
        self._hash(self.repair.take(role, text, fault))

    def _hash(self, turns: Iterator[tuple[str, str, str]]) -> None:
        for _, role, text in turns:
            self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
            self.lines += 1

    def row(self) -> list:
        self._hash(self.repair.end())
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return [gaps, *self.counts[1:], self.illegal, self.repair.paths.cost, "".join(self.repair.audit), self.digest.hexdigest()]


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


_none = object()


def repair_report(conversations: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id and the REPORT columns.

    ``conversations``: conv_id, turn, role, text; rows of a true ``dropped`` only tell that the conversation was there.
    """
    rows = faults(_text_columns(conversations)).select("conv_id", "turn", "role", "text", "dropped", "fault")
    schema = T.StructType([rows.schema["conv_id"], *REPORT])
    names = schema.names

    def batch(made: list[list], arrow: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*made, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], arrow), *[pa.array(c, pa.int64()) for c in columns[1:7]], *[pa.array(c, pa.string()) for c in columns[7:]]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind: list[pa.DataType] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for b in batches:
                kind[:] = [b.schema.field(0).type]
                yield b

        made, now, report = [], _none, _Report()
        for conv, turn, role, text, dropped, fault in _turns(seen()):
            if now is _none or conv != now:
                if now is not _none:
                    made.append([now, *report.row()])
                    if len(made) >= 1000:
                        yield batch(made, kind[0])
                        made = []
                now, report = conv, _Report()
            if not dropped:
                report.take(turn, role, text, fault)
        if now is not _none:
            made.append([now, *report.row()])
            yield batch(made, kind[0])

    return rows.mapInArrow(frugal(run), schema)


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, step (from 0), edit (K, R or I), role, text."""
    rows = faults(_text_columns(conversations)).filter("not dropped").select("conv_id", "role", "text", "fault")
    schema = T.StructType([rows.schema["conv_id"], T.StructField("step", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("edit", "role", "text")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, repair, step = _none, Repair(), 0
        for b in batches:
            made: list[tuple] = []
            for conv, role, text, fault in _turns(iter([b])):
                if now is _none or conv != now:
                    if now is not _none:
                        made += [(now, step + i, *t) for i, t in enumerate(repair.end())]
                    now, repair, step = conv, Repair(), 0
                for t in repair.take(role, text, fault):
                    made.append((now, step, *t))
                    step += 1
            if made:
                yield _rows(made, b.schema.field(0).type)
            kind = b.schema.field(0).type
        if now is not _none and (made := [(now, step + i, *t) for i, t in enumerate(repair.end())]):
            yield _rows(made, kind)

    def _rows(made: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*made, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.string()) for c in columns[2:]]], names=schema.names)

    return rows.mapInArrow(frugal(run), schema)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))


def _sql() -> str:
    """The same by a step for each turn: a row for each conversation holds the best (cost, audit, text) of each state."""

    def edge(node: str, cost: str, letter: str, line: str | None) -> str:
        text = f"{node}.t" if line is None else f"CASE WHEN {node}.a = '' OR {node}.t IS NULL THEN {line} ELSE {node}.t || chr(10) || {line} END"
        return f"CASE WHEN {node} IS NOT NULL THEN {{'c': {node}.c + {cost}, 'a': {node}.a || '{letter}', 't': {text}}} END"

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    def closed(source: str, name: str, rest: str) -> list[str]:
        """Three rounds of inserts."""
        out = []
        for i in range(3):
            u = least("u", edge("b", "3", "I", "'user:'"), edge("s", "3", "I", "'user:'"), edge("a", "3", "I", "'user:'"))
            a = least("a", edge("u", "3", "I", "'assistant:'"))
            out.append(f"{name}{i} AS (SELECT {rest}, b, s, {u} AS u, {a} AS a FROM {source if i == 0 else f'{name}{i - 1}'})")
        return out

    def moved(state: str, keeps: dict[str, tuple[str, ...]], role: str | None) -> str:
        options = [edge(state, "4", "D", None)]
        for initial, sources in keeps.items():
            for q in sources:
                options.append(f"CASE WHEN NOT gone AND role[1] = '{initial}' THEN {edge(q, 'more', 'K', 'role || chr(58) || text')} END")
        if role:
            for q in keeps[role[0]]:
                options.append(f"CASE WHEN NOT gone THEN {edge(q, '3 + more', 'R', f"'{role}:' || text")} END")
        return least(*options)

    steps = {"b": moved("b", {}, None), "s": moved("s", {"s": ("b",)}, None), "u": moved("u", {"u": ("b", "s", "a")}, "user"), "a": moved("a", {"a": ("u",)}, "assistant")}
    inner = ",\n  ".join(closed("(SELECT path.*, role, text, gone, more FROM path JOIN marked ON marked.conv IS NOT DISTINCT FROM path.conv AND marked.i = path.i + 1)", "x", "conv, i, role, text, gone, more"))
    outer = ",\n".join(closed("(SELECT path.* FROM path JOIN counted c ON c.conv IS NOT DISTINCT FROM path.conv AND c.n = path.i)", "y", "conv, i"))
    bit = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    crc = "c"
    for _ in range(8):
        crc = f"list_transform([{crc}], lambda c: {bit})[1]" if crc != "c" else bit
    none = "NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    return rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), damaged AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: unicode(x)::BIGINT)),
    lambda h, x: list_transform([xor(h, x)], lambda c: {crc})[1]), 4294967295::BIGINT) % 20 AS kind FROM keyed
), after_ AS (
  SELECT conv_id AS conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) FROM damaged WHERE kind <> 0)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ended FROM after_
), told AS (
  SELECT *, CASE WHEN ended = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 2
                 WHEN ended[-1] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(role[1]) OVER (PARTITION BY conv ORDER BY i) || role[1] AS pair FROM placed
), marked AS (
  SELECT conv, i, role, text, fault IN (1, 2) AS gone, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS more FROM told
), ids AS (
  SELECT DISTINCT conv_id AS conv FROM conversations
), counted AS (
  SELECT ids.conv, count(told.i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM ids LEFT JOIN told ON told.conv IS NOT DISTINCT FROM ids.conv GROUP BY ids.conv
), path AS (
  SELECT conv, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': NULL::VARCHAR}} AS b, {none} AS s, {none} AS u, {none} AS a FROM ids
  UNION ALL
  (WITH {inner}
  SELECT conv, i + 1, {steps['b']}, {steps['s']}, {steps['u']}, {steps['a']} FROM x2)
), {outer}, best AS (
  SELECT conv, {least('b', 'a')} AS p FROM y2
)
SELECT counted.conv AS conv_id, gaps::BIGINT AS gaps, blank, duplicate, truncated, illegal, p.c AS cost, p.a AS audit, sha256(coalesce(p.t, '')) AS repaired_sha256
FROM counted JOIN best ON best.conv IS NOT DISTINCT FROM counted.conv
"""


ORACLE_SQL = _sql()
