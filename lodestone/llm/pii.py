"""Operator 1: personal data and what reveals it, by information-theoretic sanitisation.

Protected entities are e-mail addresses, IP addresses, payment cards and phone numbers found by pattern.
Terms near an entity can reveal it. For each entity e and each term t in its context (``CONTEXT``
characters on both sides), documents of the whole corpus are counted: n(e), n(t), and n(t, e) where t
stands in a context of e. The disclosure of e by t is

    PMI(t; e) / IC(e) = log2(N n(t, e) / (n(t) n(e))) / log2(N / n(e)),

the share of the entity's information that the term gives away: 1 if t occurs only near e. Terms from
``GENERALISE`` on are generalised, from ``REMOVE`` on removed. The counts are those of the whole corpus, no
sample, and an entity of one document is judged as any other.

Everything is DataFrame expressions: no Python runs on the executors. Only contexts, and those terms of
the corpus that a bounded Bloom filter lets through, are shuffled.

Work is linear in a text's length and matches, but for products with the few spans of over ``CONTEXT`` characters:
places come from sums over blocks of matches, and pieces of a long text are cut from blocks of it.

A null text counts as empty: no spans. Documents are told apart by id and text (128 bits of hash), so repeated rows count
once in all four statistics and each get their spans. Spans of one kind never overlap; ties of start are
ordered by kind. A null id is an ordinary value. Output columns replace input columns of those names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spark_io import bloom_blocks, bloom_mark, materialize

#: Matches in a block of sums; characters in a block of text; most spans that begin within 2 CONTEXT of a span.
MATCHES, CHARACTERS, NEIGHBOURS = 128, 1024, 100
#: Kind, pattern, and a cheap test that every text with a match passes. Possessive repeats and the
#: look-behind give the same leftmost matches as the plain patterns, without trying the middles of runs.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+"  # whole runs, of 14 digits on
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
CONTEXT = 80
TERM_LETTERS = 4
GENERALISE, REMOVE = 0.8, 0.95

_SPAN = "struct<start:int,ord:int,end:int,kind:string,value:string>"
_NONE = f"cast(array() as array<{_SPAN}>)"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body's own lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each of the ints ``values``: all before it merged, from ``zero`` on.

    Arrays grow by copies, so blocks of MATCHES are scanned apart, from the scan of their merged values on.
    """
    none = F.expr("cast(array() as array<int>)")

    def within(block: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(merge(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(block, F.struct(start.cast("int").alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def scan(v: Column) -> Column:
        cut = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / MATCHES).cast("int")), lambda i: F.slice(w, i * MATCHES + 1, F.lit(MATCHES)))
        total = lambda block: F.aggregate(block, zero.cast("int"), merge)
        both = lambda blocks: F.flatten(F.zip_with(blocks, within(F.transform(blocks, total), zero), within))
        return F.when(F.size(v) <= MATCHES, within(v, zero)).otherwise(_let(cut(v), both))

    return _let(values, scan)


def _runs(text: Column, pattern: str, shift: Column) -> Column:
    """Matches of ``pattern`` in ``text`` as structs (start, end, value), moved by ``shift``."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(found: Column) -> Column:
        # the text ends with a gap, which has no match after it
        sizes = F.transform(found, lambda x: F.length(x["gap"]) + F.length(F.coalesce(x["value"], F.lit(""))))
        run = lambda x, at: F.struct(
            (at + F.length(x["gap"])).cast("int").alias("start"), (at + F.length(x["gap"]) + F.length(x["value"])).cast("int").alias("end"), x["value"].alias("value")
        )
        return F.filter(F.zip_with(found, _scan(sizes, shift, lambda a, b: a + b), run), lambda r: r["value"].isNotNull())

    return _let(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("value")), place)


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHARACTERS}}}"), F.lit(0))


def _cut(blocks: Column, at: Column, to: Column) -> Column:
    """Characters ``at`` to ``to`` of the text in ``blocks``; substring() would count them from the text's begin."""
    first = F.floor(at / CHARACTERS).cast("int")
    many = F.greatest(F.floor((to - 1) / CHARACTERS).cast("int") - first + 1, F.lit(0))
    return F.when(to > at, F.substring(F.array_join(F.slice(blocks, first + 1, many), ""), (at - first * CHARACTERS + 1).cast("int"), (to - at).cast("int"))).otherwise(F.lit(""))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.length(_digits(value)).between(14, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _kind_spans(text: Column, n: int, kind: str, pattern: str) -> Column:
    runs = F.filter(_runs(text, pattern, F.lit(0)), lambda r: _valid(kind, r["value"]))
    return F.transform(runs, lambda r: F.struct(r["start"].alias("start"), F.lit(n).alias("ord"), r["end"].alias("end"), F.lit(kind).alias("kind"), r["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start, then kind."""
    parts = []
    tests = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), "phone": text.rlike(r"\+[0-9]")}
    for n, (kind, pattern) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True)):
        parts.append(F.when(tests[kind], _kind_spans(text, n, kind, pattern)).otherwise(F.expr(_NONE)))
    return F.array_sort(F.concat(*parts))


def find_base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add __text (null: empty) and __base (its base spans) to ``docs``."""
    with_text = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    return with_text.withColumn("__base", base_spans(F.col("__text")))


def _meets(at: Column, to: Column) -> Callable[[Column], Column]:
    return lambda b: (b["start"] < to) & (b["end"] > at)


def contexts(found: DataFrame) -> DataFrame:
    """Terms near entities: __key, entity, term, start, end; terms that touch a base span are left out."""
    base = F.col("__base")

    def windows(blocks: Column, size: Column, long: Column) -> Column:
        def around(s: Column, i: Column) -> Column:
            near = F.concat(F.slice(base, F.greatest(i + 1 - NEIGHBOURS, F.lit(1)), F.lit(2 * NEIGHBOURS)), long)
            entity = F.concat_ws(":", s["kind"], F.lower(s["value"]))
            sides = []
            left, right = F.greatest(s["start"] - CONTEXT, F.lit(0)), F.least(s["end"] + CONTEXT, size)
            for at, to, cut_left, cut_right in ((left, s["start"], left > 0, F.lit(False)), (s["end"], right, F.lit(False), right < size)):
                touching = F.filter(near, _meets(at, to))
                part = F.struct(at.alias("at"), to.alias("to"), cut_left.alias("cut_left"), cut_right.alias("cut_right"))
                sides.append(F.struct(entity.alias("entity"), part.alias("w"), _cut(blocks, at, to).alias("text"), touching.alias("touching")))
            return F.array(*sides)

        return F.flatten(F.transform(base, around))

    long = F.filter(base, lambda b: b["end"] - b["start"] > CONTEXT)
    parts = _let(F.struct(_blocks(F.col("__text")).alias("blocks"), F.length("__text").alias("size"), long.alias("long")), lambda x: windows(x["blocks"], x["size"], x["long"]))
    rows = found.filter(F.size("__base") > 0).select("__key", F.explode(parts).alias("c"))
    rows = rows.select("__key", "c.entity", "c.w", "c.touching", _runs(F.col("c.text"), r"\p{L}+", F.col("c.w.at")).alias("runs"))
    rows = rows.select("__key", "entity", "w", "touching", F.explode("runs").alias("r"))
    whole = ~((F.col("w.cut_left") & (F.col("r.start") == F.col("w.at"))) | (F.col("w.cut_right") & (F.col("r.end") == F.col("w.to"))))
    free = ~F.exists("touching", lambda b: (b["start"] < F.col("r.end")) & (b["end"] > F.col("r.start")))
    kept = rows.filter(whole & free & (F.length("r.value") >= TERM_LETTERS))
    return kept.select("__key", "entity", F.lower("r.value").alias("term"), F.col("r.start").alias("start"), F.col("r.end").alias("end"))


def document_counts(docs: DataFrame, terms: DataFrame, repeated: DataFrame) -> DataFrame:
    """n(t) for each of ``terms.term``, over all documents (__key, __text) of the corpus.

    All rows are counted, combined by term before the shuffle; then what the repeated documents (__key, extra rows)
    have too many is taken away.
    """
    filter_table, blocks = bloom_blocks(terms, "term", terms.count())

    def words(rows: DataFrame, *more: str) -> DataFrame:
        split_up = F.array_distinct(F.split(F.lower("__text"), r"\P{L}+"))
        found = rows.select(*more, F.explode(split_up).alias("term")).filter(F.length("term") >= TERM_LETTERS)
        return bloom_mark(found, "term", filter_table, blocks, "maybe").filter("maybe")

    counted = words(docs).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    if not repeated.isEmpty():
        key_table, key_blocks = bloom_blocks(repeated, "__key", repeated.count())
        some = bloom_mark(docs, "__key", key_table, key_blocks, "maybe").filter("maybe").groupBy("__key").agg(F.first("__text").alias("__text"))
        extra = words(some.join(repeated, "__key"), "extra").groupBy("term").agg(F.sum("extra").alias("extra"))
        counted = counted.join(extra, "term", "left").select("term", (F.col("n_t") - F.coalesce("extra", F.lit(0))).alias("n_t"))
    return counted.join(terms, "term")  # an inner join: Spark would push a semi join below the count


def disclosures(near: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (entity, term) with their disclosure, from GENERALISE on."""
    keys = docs.groupBy("__key").agg((F.count(F.lit(1)) - 1).alias("extra"))
    repeated = materialize(keys.filter("extra > 0"), "pii-repeated")
    total = max(1, docs.count() - (repeated.agg(F.sum("extra")).first()[0] or 0))
    seen = near.select("__key", "entity", "term").distinct()
    pairs = seen.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te"))
    pairs = materialize(pairs, "pii-pairs")
    n_e = near.select("__key", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    n_t = document_counts(docs, pairs.select("term").distinct(), repeated)
    joined = pairs.join(n_e, "entity").join(n_t, "term", "left").withColumn("n_t", F.greatest(F.coalesce("n_t", "n_te"), "n_te"))
    information = F.log2(F.lit(float(total)) / F.col("n_e"))
    mutual = F.log2(F.lit(float(total)) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    share = F.when(information > 0, mutual / information).otherwise(F.lit(0.0))
    return joined.select("entity", "term", F.round(share, 9).alias("disclosure")).filter(F.col("disclosure") >= GENERALISE)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", clean_col: str | None = None) -> DataFrame:
    """``docs`` with pii_spans: all base and term spans, by start, then kind (email, ip, card, phone, term).

    A span is (start, ord, end, kind, value); start and end count code points, and a term's value is
    ``generalise`` or ``remove``. Without ``clean_col`` the text is dropped, else that column (which may be
    ``text_col``) has the text with entities as ``[KIND]``, generalised terms as ``[TERM]`` and removed terms left out.
    """
    docs = docs.drop("pii_spans")
    parts = (F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).isNull())
    key = F.struct(F.xxhash64(*parts).alias("h0"), F.xxhash64(F.lit(1), *parts).alias("h1"))
    small = find_base(docs.select(F.col(id_col), F.col(text_col)).withColumn("__key", key), text_col)
    near = materialize(contexts(small), "pii-contexts")
    corpus = docs.select(key.alias("__key"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    strong = disclosures(near, corpus)
    span = F.struct(
        "start", F.lit(len(KINDS)).alias("ord"), "end", F.lit(TERM).alias("kind"),
        F.when(F.col("disclosure") >= REMOVE, F.lit("remove")).otherwise(F.lit("generalise")).alias("value"), "disclosure",
    )
    # a term that discloses several entities gets its strongest action
    best = near.join(strong, ["entity", "term"]).select("__key", span.alias("s")).groupBy("__key", F.col("s.start").alias("start")).agg(F.max_by("s", "s.disclosure").alias("s"))
    terms = best.groupBy("__key").agg(F.collect_list(F.struct("s.start", "s.ord", "s.end", "s.kind", "s.value")).alias("__terms"))
    terms = materialize(terms, "pii-terms")

    found = find_base(docs.withColumn("__key", key), text_col)
    rest = [c for c in docs.columns if c != text_col]
    carried = [*rest, "__base", *(["__text", text_col] if clean_col else [])]
    found = found.select("__key", *carried)
    plain = found.filter(F.size("__base") == 0).select(*carried, F.expr(_NONE).alias("pii_spans"))
    joined = found.filter(F.size("__base") > 0).join(terms, "__key", "left")
    marked = joined.select(*carried, F.array_sort(F.concat("__base", F.coalesce("__terms", F.expr(_NONE)))).alias("pii_spans"))
    both = plain.unionByName(marked)
    if clean_col:
        both = both.withColumn("__clean", F.when(F.size("pii_spans") > 0, replace_spans(F.col("__text"), F.col("pii_spans"))).otherwise(F.col(text_col)))
        both = both.drop(clean_col).withColumnRenamed("__clean", clean_col)
        return both.select(*[c for c in dict.fromkeys([*docs.columns, clean_col])], "pii_spans")
    return both.select(*rest, "pii_spans")


def replace_spans(text: Column, spans: Column) -> Column:
    """The text with its spans replaced; a span that begins inside another goes with that one."""

    def pieces(x: Column) -> Column:
        covered = _scan(F.transform(x["spans"], lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b))  # by spans before

        def piece(s: Column, at: Column) -> Column:
            mark = F.when(s["kind"] != TERM, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["value"] == "generalise", F.lit("[TERM]")).otherwise(F.lit(""))
            return F.when(s["start"] >= at, F.concat(_cut(x["blocks"], at, s["start"]), mark)).otherwise(F.lit(""))

        last = F.coalesce(F.array_max(F.transform(x["spans"], lambda s: s["end"])), F.lit(0))
        return F.concat(F.array_join(F.zip_with(x["spans"], covered, piece), ""), _cut(x["blocks"], last, x["size"]))

    return _let(F.struct(_blocks(text).alias("blocks"), spans.alias("spans"), F.length(text).alias("size")), pieces)


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = F.col("pii_spans")
    kinds = F.transform(spans, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.filter(spans, lambda s: s["kind"] != TERM)
    return sanitise(docs).select("doc_id", *counts, F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(spans).alias("spans"))


def op1_pii_any_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, under the name that it had beside a form for pairs of two documents."""
    return op1_pii(spark, sf_dir)


_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_RAW = "\n  UNION ALL\n".join(
    f"  SELECT rid, {n} AS ord, '{kind}' AS kind, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS vals FROM d"
    for n, (kind, p) in enumerate(_PATTERNS.items())
)


def _oracle() -> str:
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, dense_rank() OVER (ORDER BY doc_id, coalesce(text, '')) AS did, doc_id, coalesce(text, '') AS t FROM documents
), raw AS (
{_RAW}
), cut AS (
  SELECT rid, ord, kind, i, length(gaps[i]) AS gap, vals[i] AS value
  FROM (SELECT *, unnest(range(1, len(vals) + 1)) AS i FROM raw WHERE len(vals) > 0)
), placed AS (
  SELECT rid, ord, kind, value, (sum(gap + length(value)) OVER (PARTITION BY rid, ord ORDER BY i))::INT AS stop FROM cut
), digits AS (
  SELECT *, stop - length(value) AS start, regexp_replace(value, '[^0-9]', '', 'g') AS ds FROM placed
), base AS (
  SELECT rid, ord, kind, value, start, stop FROM digits WHERE kind = 'email'
    OR (kind = 'ip' AND len(list_filter(string_split(value, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0)
    OR (kind = 'phone' AND length(ds) BETWEEN 10 AND 15)
    OR (kind = 'card' AND length(ds) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(ds) + 1), lambda k:
         CASE WHEN k % 2 = 1 THEN substr(ds, length(ds) - k + 1, 1)::INT
              WHEN substr(ds, length(ds) - k + 1, 1)::INT > 4 THEN 2 * substr(ds, length(ds) - k + 1, 1)::INT - 9
              ELSE 2 * substr(ds, length(ds) - k + 1, 1)::INT END)) % 10 = 0)
), sides AS (
  SELECT rid, kind || ':' || lower(value) AS entity, greatest(start - {CONTEXT}, 0) AS a, start AS z, start > {CONTEXT} AS cut_left, false AS cut_right, t FROM base JOIN d USING (rid)
  UNION ALL
  SELECT rid, kind || ':' || lower(value), stop, least(stop + {CONTEXT}, length(t)), false, stop + {CONTEXT} < length(t), t FROM base JOIN d USING (rid)
), win AS (
  SELECT row_number() OVER () AS wid, rid, entity, a, z, cut_left, cut_right, substr(t, a + 1, z - a) AS w FROM sides
), runs AS (
  SELECT wid, rid, entity, a, z, cut_left, cut_right, i, length(string_split_regex(w, '\p{{L}}+')[i]) AS gap, regexp_extract_all(w, '\p{{L}}+')[i] AS value
  FROM (SELECT *, unnest(range(1, len(regexp_extract_all(w, '\p{{L}}+')) + 1)) AS i FROM win)
), located AS (
  SELECT *, (a + sum(gap + length(value)) OVER (PARTITION BY wid ORDER BY i))::INT AS stop FROM runs
), near AS (
  SELECT rid, entity, lower(value) AS term, stop - length(value) AS start, stop FROM located
  WHERE length(value) >= {TERM_LETTERS} AND NOT (cut_left AND stop - length(value) = a) AND NOT (cut_right AND stop = z)
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = located.rid AND b.start < located.stop AND b.stop > located.stop - length(located.value))
), pairs AS (
  SELECT entity, term, count(DISTINCT did) AS n_te FROM near JOIN d USING (rid) GROUP BY ALL
), ne AS (
  SELECT entity, count(DISTINCT did) AS n_e FROM near JOIN d USING (rid) GROUP BY entity
), words AS (
  SELECT DISTINCT did, unnest(string_split_regex(lower(t), '\P{{L}}+')) AS term FROM d
), nt AS (
  SELECT term, count(*) AS n_t FROM words WHERE term IN (SELECT term FROM pairs) GROUP BY term
), n AS (
  SELECT count(DISTINCT did)::DOUBLE AS total FROM d
), strong AS (
  SELECT entity, term FROM pairs JOIN ne USING (entity) JOIN nt USING (term), n
  WHERE log2(total / n_e) > 0 AND round(log2(total * n_te / (greatest(n_t, n_te) * n_e)) / log2(total / n_e), 9) >= {GENERALISE}
), spans AS (
  SELECT rid, ord, kind, start, stop FROM base
  UNION ALL
  SELECT DISTINCT rid, 4, 'term', start, stop FROM near JOIN strong USING (entity, term)
), joined AS (
  SELECT rid, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
         count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (kind <> 'term') AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans
  FROM spans GROUP BY rid
)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card,
       coalesce(n_phone, 0)::BIGINT AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (rid)
"""


ORACLE_SQL = ANY_SUPPORT_SQL = _oracle()
