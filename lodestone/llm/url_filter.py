"""Operator 4: URL filtering by rules and by a list of URLs.

Every URL is cut into host and path. Host-and-path rules come first: a rule fits its host and all
subdomains if the path starts with the rule's path, and the longest fitting rule decides. URLs without
a rule are held against a list. An entry of the list names a site (no path, or ``/``), a section (a first
path segment closed by a slash: all below it), or a page; a URL meets it by the same three canonical keys.
The list's keys are put into a blocked Bloom filter of bounded size, which is broadcast; URLs with a
possible hit under any key alone go to exact hash joins with the list, which remove the filter's false
positives. URLs that the filter rules out are never shuffled.

All of it is DataFrame expressions. The list's distinct keys are written once to the shared folder, since the
count, the filter and the joins all read them. A null URL, or one without ``://``, has an empty host and path, fits
no rule and is on no list, so it is allowed. Repeated rows each get a verdict; an empty list or table is
fine. Output columns replace input columns of the same names.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spark_io import bloom_blocks, bloom_mark, materialize

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: The query's list: from pages whose ids' MD5 sums begin so, their page, their section, their site.
LISTED = {"page": "1", "section": "00", "site": "01"}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def site(host: Column) -> Column:
    """Host without ``www.`` or ``m.``."""
    return F.regexp_replace(host, r"^(?:www|m)\.", "")


def canonical(host: Column, path: Column) -> Column:
    """Site, and path without index page, ``.html`` or closing slashes; null for an empty host."""
    return F.when(host != "", F.concat(site(host), F.regexp_replace(path, r"(?:/index)?(?:\.html?)?/*$", "")))


def section(host: Column, path: Column) -> Column:
    """Site, and the first path segment that is closed by a slash, if any; it ends in a slash. Null for an empty host."""
    top = F.regexp_extract(path, r"^/[^/]+/", 0)
    return F.when(host != "", F.concat(site(host), F.when(top != "", top).otherwise(F.lit("/"))))


def entry_key(host: Column, path: Column) -> Column:
    """The key of a list's entry: site and ``/``, a section, or a page's canonical form."""
    whole = path.isin("", "/") | path.rlike(r"^/[^/]+/$")
    return F.when(whole, section(host, path)).otherwise(canonical(host, path))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest fitting rule, written host then path, and its verdict; nulls without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def filter_urls(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, url_col: str = "url", listed_col: str = "url", listed_count: int | None = None) -> DataFrame:
    """Add host, path, rule and verdict to ``pages``. ``listed[listed_col]``: the list's entries, URLs in any form."""
    made = ("__page", "__section", "__site")
    new = ("host", "path", "rule", "verdict", "__ruled", "__maybe", *made)
    host, path = split_url(F.col(url_col))
    cut = pages.drop(*new).withColumns({"host": host, "path": path})
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    host, path = F.col("host"), F.col("path")
    cut = cut.withColumns({"rule": name, "__ruled": verdict, "__page": canonical(host, path), "__section": section(host, path), "__site": section(host, F.lit(""))})
    keep = [c for c in cut.columns if c not in ("__ruled", *made)]

    cut_list = listed.select(*(c.alias(n) for c, n in zip(split_url(F.col(listed_col)), ("host", "path"), strict=True)))
    keys = materialize(cut_list.select(entry_key(F.col("host"), F.col("path")).alias("__listed")).distinct(), "listed").filter(F.col("__listed").isNotNull())
    count = keys.count() if listed_count is None else listed_count
    table, blocks = bloom_blocks(keys, "__listed", count)
    marked = cut.withColumn("__maybe", F.lit(False))
    for key in made:
        marked = bloom_mark(marked, key, table, blocks, f"__in{key}")
        marked = marked.withColumn("__maybe", F.col("__maybe") | F.col(f"__in{key}")).drop(f"__in{key}")
    possible = F.col("__ruled").isNull() & F.col("__site").isNotNull() & F.col("__maybe")
    sure = marked.filter(~possible).select(*keep, F.coalesce("__ruled", F.lit("allow")).alias("verdict"))
    hits = marked.filter(possible).withColumn("__hit", F.lit(False))
    for key in made:
        entry = f"__entry{key}"
        hits = hits.join(keys.toDF(entry), F.col(key) == F.col(entry), "left").withColumn("__hit", F.col("__hit") | F.col(entry).isNotNull()).drop(entry)
    return sure.unionByName(hits.select(*keep, F.when(F.col("__hit"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict")))


def reported(pages: DataFrame) -> DataFrame:
    """A block list (url) as readers' reports would give one: some pages, by their ids' hashes, name their page, section or site (null without a host).

    The list spells URLs in its own way (``http://www.``, host in capitals, pages with ``/index.html``), so entries
    meet those pages, all below the same section or site, and other spellings, in canonical form only. Entries of
    pages that have a rule may meet nothing.
    """
    digest = F.md5(F.col("page_id").cast("string").cast("binary"))
    host, path = split_url(F.col("url"))
    start = F.concat(F.lit("http://www."), F.upper(site(host)))
    page = F.concat(start, F.regexp_replace(path, r"(?:/index)?(?:\.html?)?/*$", ""), F.lit("/index.html"))
    top = F.regexp_extract(path, r"^/[^/]+/", 0)
    url = F.when(digest.startswith(LISTED["page"]), page)
    url = url.when(digest.startswith(LISTED["section"]), F.concat(start, F.when(top != "", top).otherwise(F.lit("/"))))
    url = url.when(digest.startswith(LISTED["site"]), F.concat(start, F.lit("/")))
    picked = functools.reduce(lambda x, y: x | y, [digest.startswith(d) for d in LISTED.values()])
    return pages.filter(picked).select(F.when(host != "", url).alias("url"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, materialize(reported(pages), "reports").filter(F.col("url").isNotNull())).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r AS (
  SELECT *, regexp_replace(host, '^(www|m)\.', '') AS site,
    CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule,
    md5(page_id::VARCHAR) AS digest
  FROM q
), k AS (
  SELECT *, site || regexp_replace(path, '(/index)?(\.html?)?/*$', '') AS page,
    site || coalesce(nullif(regexp_extract(path, '^/[^/]+/'), ''), '/') AS section FROM r
), listed AS (
  SELECT DISTINCT CASE WHEN substr(digest, 1, 1) = '1' THEN page WHEN substr(digest, 1, 2) = '00' THEN section ELSE site || '/' END AS entry
  FROM k WHERE host <> '' AND (substr(digest, 1, 1) = '1' OR substr(digest, 1, 2) IN ('00', '01'))
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN host <> '' AND (page IN (SELECT entry FROM listed) OR section IN (SELECT entry FROM listed)
                            OR site || '/' IN (SELECT entry FROM listed)) THEN 'block' ELSE 'allow' END AS verdict
FROM k
"""
