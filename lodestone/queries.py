"""Registered queries of the vector engine, and DuckDB SQL that checks them.

Queries of a search are the rows of ``embeddings`` whose vec_id is divisible by 20, against all rows.
Similarities are computed in DOUBLE and rounded to 6 decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .functions import vectors as V
from .options import IndexOptions
from .operators.embed_store import embed_stored, key_of
from .operators import chunking, evaluate, ivf, knn, results, topk, validate, zones
from .plans.index import VectorIndex
from .sources import code_files, tables

K, STEP, PROBES = 10, 20, 3
RECALL = 0.9


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.from_dataframe(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", "vec_id")


def _asked(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("row_id") % STEP == 0).select(F.col("row_id").alias("qid"), F.col("vec").alias("qvec"))


def _rounded(result: DataFrame) -> DataFrame:
    return result.withColumn("similarity", F.round("similarity", 6))


def _options(**options) -> IndexOptions:
    return IndexOptions(enable_cache=False, **options)


def _index(spark: SparkSession, sf_dir: str, **options) -> VectorIndex:
    return VectorIndex(_rows(spark, sf_dir), _options(**options))


def exact_top10_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return _rounded(_index(spark, sf_dir).search(_asked(rows), K))


def exact_top10_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return _rounded(knn.knn_sql(rows, _asked(rows), K))


def exact_top10_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query is the mean of all rows."""
    rows = _rows(spark, sf_dir)
    mean = rows.select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m")).orderBy("pos")
    return _rounded(knn.single_top(rows, [r.m for r in mean.collect()], K))


def top1_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return _rounded(knn.knn_sql(rows, _asked(rows), 1))


def k_exceeds_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is ranked for the queries: the result has as many rows as pairs, which is what it is for."""
    rows = _rows(spark, sf_dir)
    return _rounded(_index(spark, sf_dir).search(_asked(rows), 1_000_000))


def prenormalized_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows scaled by 1 + vec_id % 3 and taken as they are."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    scale = (F.col("vec_id") % 3 + 1).cast("double")
    rows = df.select(F.col("vec_id").alias("row_id"), F.transform("embedding", lambda x: x.cast("double") * scale).alias("vec"))
    return _rounded(VectorIndex(rows, _options(normalized=True)).search(_asked(rows), K))


def f64_input_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOUBLE elements become FLOAT; the sum of each vector shows them."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    doubles = df.select("vec_id", F.transform("embedding", lambda x: x.cast("double") / 3).alias("v"))
    rows = tables.from_dataframe(doubles, "v", "vec_id")
    return rows.select("row_id", F.posexplode("vec").alias("pos", "x")).select("row_id", "pos", F.col("x").cast("double").alias("x"))


def l2_normalize_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price, quantity, discount and tax of lineitem as unit vectors."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = df.select("l_orderkey", "l_linenumber", F.array("l_extendedprice", "l_quantity", "l_discount", "l_tax").alias("v"))
    unit = V.l2_normalize(F.col("v"))
    return rows.select("l_orderkey", "l_linenumber", *[F.round(unit[i], 6).alias(f"u{i}") for i in range(4)], F.round(V.l2_norm(F.col("v")), 4).alias("length"))


def pad_to_multiple_of_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    padded = V.pad(V.vector_from_columns("p_size", "p_retailprice"))
    rows = df.select("p_partkey", F.posexplode(padded).alias("pos", "x"))
    return rows.select("p_partkey", "pos", F.round(F.col("x").cast("double"), 2).alias("x"))


def columns_to_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten parts nearest in direction to each part whose key is divisible by 20, over size and price."""
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = df.select(F.col("p_partkey").alias("row_id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 100).alias("vec"))
    return _rounded(VectorIndex(rows, _options()).search(_asked(rows), K)).select("qid", "rank", "similarity")


def vector_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return df.agg(*validate.profile_columns(F.col("embedding")))


def dataframe_attach_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = _index(spark, sf_dir).search(_asked(_rows(spark, sf_dir)), K)
    return _rounded(results.attach(found, df.select("vec_id", "label"), "vec_id"))


def batch_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the neighbours in one string for each query."""
    found = results.nested(knn.knn_sql(rows := _rows(spark, sf_dir), _asked(rows), K))
    ids = F.array_join(F.transform("neighbors", lambda x: x["row_id"].cast("string")), ",")
    return found.select("qid", ids.alias("ids"), F.size("neighbors").cast("long").alias("n"))


def medoid_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ivf.prepare(_rows(spark, sf_dir), False)
    return _rounded(ivf.medoid(rows, 64))


def _label_centroids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(unit rows, centroids, assigned): clusters around the mean of each label."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    unit = df.select(F.col("vec_id").alias("row_id"), V.l2_normalize(F.col("embedding")).alias("vec"), "label")
    means = zones.zone_means(unit.select("vec", F.col("label").alias("list"))).orderBy("list").limit(ivf.MAX_LISTS).toArrow()
    labels = means.column("list").to_pylist()
    vectors = topk.normalise_rows(topk.stack(means.column("pivot").combine_chunks()))
    centroids = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in zip(labels, vectors, strict=True)], "cluster int, cvec array<double>")  # MAX_LISTS rows
    placed = ivf.assign(unit.select("row_id", "vec"), vectors)  # in the scan, by the centroids alone
    assigned = placed.select("row_id", "vec", F.element_at(F.array(*[F.lit(n) for n in labels]), F.col("cluster") + 1).alias("cluster"))
    return unit.select("row_id", "vec"), centroids, assigned


def kmeans_assign_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _label_centroids(spark, sf_dir)[2].select("row_id", "cluster")


def kmeans_update_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the assigned rows, scaled to unit length; zeros for a cluster without rows."""
    _, centroids, assigned = _label_centroids(spark, sf_dir)
    mean = assigned.select("cluster", F.posexplode("vec").alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg("x").alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"])  # dims values
    new = mean.groupBy("cluster").agg(V.l2_normalize(ordered).alias("v"))
    every = centroids.join(new, "cluster", "left").select("cluster", F.coalesce("v", F.transform("cvec", lambda x: x * 0)).alias("v"))
    return every.select("cluster", F.posexplode("v").alias("pos", "x")).select("cluster", "pos", F.round("x", 6).alias("x"))


def cluster_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's place when rows of a cluster stand together, by id."""
    return ivf.cluster_order(_label_centroids(spark, sf_dir)[2].select("row_id", "cluster"))


def cluster_histogram_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.histogram(_label_centroids(spark, sf_dir)[2])


def ivf_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists and probes for as many rows as each order's price in cents, and k of 1, 10, 20 and 50."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.round(F.col("o_totalprice")).cast("long").alias("n"))
    grid = rows.select("o_orderkey", "n", F.explode(F.array(*[F.lit(k) for k in (1, 10, 20, 50)])).alias("k"))
    grid = grid.withColumn("lists", ivf.list_count_column(F.col("n")))
    return grid.withColumn("probes", ivf.probe_count_column(F.col("lists"), F.col("k"), F.greatest("n", F.lit(1))))


def _probes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    unit, centroids, assigned = _label_centroids(spark, sf_dir)
    asked = _asked(unit)
    return unit, assigned, asked, ivf.probe(centroids, asked, PROBES)


def ivf_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_probes(spark, sf_dir)[3])


def ivf_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, assigned, _, probes = _probes(spark, sf_dir)
    return ivf.candidates(assigned, probes)


def ivf_search_label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, assigned, asked, probes = _probes(spark, sf_dir)
    return _rounded(ivf.rerank(assigned, probes, asked, K))


def _searches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Exact and probed results, written once."""
    unit, assigned, asked, probes = _probes(spark, sf_dir)
    exact, approx = knn.knn_arrow(unit, asked, K, 64, normalized=True), ivf.rerank(assigned, probes, asked, K)
    return shared.written(exact, "exact"), shared.written(approx, "probed")


def recall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of the probed search against the exact one, for each query."""
    q = evaluate.per_query(*_searches(spark, sf_dir))
    return q.select("qid", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in q.columns if c != "qid"])


def recall_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluate.summary(*_searches(spark, sf_dir))
    return s.select("queries", *[F.round(F.col(c), 6).alias(c) for c in ("min_overlap", "mean_overlap", "mean_top1_match", "mean_ndcg")])


def ivf_search_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes as many of the trained lists as a recall of RECALL takes."""
    rows = _rows(spark, sf_dir)
    return _rounded(_index(spark, sf_dir, approx=True, recall=RECALL).search(_asked(rows), K))


def ivf_recall_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of that search against the exact one, for each query, with its lists and probes."""
    rows = _rows(spark, sf_dir)
    index = _index(spark, sf_dir, approx=True, recall=RECALL)
    approx, exact = index.search(_asked(rows), K), _index(spark, sf_dir).search(_asked(rows), K)
    q = evaluate.per_query(exact, approx)
    lists = len(index.fit()._ivf.centroids) if index._ivf else 1
    return q.select("qid", F.round(F.col("overlap").cast("double"), 6).alias("recall"), F.lit(lists).alias("lists"), F.lit(index.probes(K) or 1).alias("probes"))


def tree_search_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of an index of two levels, with the probes that a recall of RECALL takes."""
    rows = _rows(spark, sf_dir)
    return _rounded(_index(spark, sf_dir, approx=True, recall=RECALL, levels=2).search(_asked(rows), K))


def tree_recall_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of that search against the exact one, for each query, with what it probes of each level."""
    rows = _rows(spark, sf_dir)
    index = _index(spark, sf_dir, approx=True, recall=RECALL, levels=2)
    approx, exact = index.search(_asked(rows), K), _index(spark, sf_dir).search(_asked(rows), K)
    q = evaluate.per_query(exact, approx)
    wide, deep = index.probes(K)
    return q.select("qid", F.round(F.col("overlap").cast("double"), 6).alias("recall"), F.lit(index._ivf.list_count()).alias("lists"), F.lit(wide).alias("upper_probes"), F.lit(deep).alias("probes"))


def _zoned(spark: SparkSession, sf_dir: str) -> tuple[zones.ZoneIndex, DataFrame]:
    """Rows in zones by label, and the queries."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    unit = df.select(F.col("vec_id").alias("row_id"), V.l2_normalize(F.col("embedding")).alias("vec"), F.col("label").alias("list"))
    return zones.ZoneIndex.build(unit, 64), _asked(_rows(spark, sf_dir))


def zone_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact search, reading those zones only that can hold a result."""
    index, asked = _zoned(spark, sf_dir)
    return _rounded(index.search(asked, K))


def zone_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones and rows that this search reads for each query."""
    index, asked = _zoned(spark, sf_dir)
    return index.reads(asked, K)


def zone_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, radius and length of the pivot of each zone."""
    index, _ = _zoned(spark, sf_dir)
    return index.map.select(F.col("list").cast("int").alias("label"), "n", F.round("radius", 6).alias("radius"), F.round(V.l2_norm(F.col("pivot")), 6).alias("pivot_length"))


def parquet_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the rows in their files, taken as one, with the first element of each vector."""
    rows = tables.from_file(spark, f"{sf_dir}/embeddings.parquet", "embedding")
    return rows.select("row_id", F.col("vec")[0].alias("x"))


def _documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(F.concat(F.lit("/docs/"), "doc_id", F.lit(".txt")).alias("file_path"), F.col("text").alias("content"))


def chunk_small_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.small_chunks(_documents_as_files(spark, sf_dir))
    return found.select("file_path", "start_line", "end_line", F.length("content").alias("n"), "preview")


def chunk_sliding_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.large_chunks(_documents_as_files(spark, sf_dir))
    return found.select("file_path", "start_line", "end_line", F.length("content").alias("n"), "preview")


def definition_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of web pages that would begin a definition in a script file, after splitting at tags."""
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    lines = df.select(F.col("page_id").cast("string").alias("file_path"), F.regexp_replace(F.regexp_replace("html", "<[^>]*>", "\n"), "(?i)\n(the|de) ", "\nfunction ").alias("content"))
    return chunking.definition_lines(lines, ".js")


def _tag_lines(spark: SparkSession, sf_dir: str, opening: str) -> DataFrame:
    """Pages cut into lines at their tags, with ``opening`` in front of lines that begin with an article."""
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    lines = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", "\n"), "(?i)\n(the|de|die|der|la|el) ", f"\n{opening} ")
    return df.select(F.col("page_id").cast("string").alias("file_path"), lines.alias("content"))


def rust_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.definition_lines(_tag_lines(spark, sf_dir, "pub(crate) unsafe fn"), ".rs")


def typed_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.definition_lines(_tag_lines(spark, sf_dir, "export abstract interface"), ".ts")


def python_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of a Python source for each order: decorated functions, classes and assignments by return flag."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag")
    n = F.col("l_linenumber").cast("string")
    code = (
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("@seen\ndef f"), n, F.lit("():\n    return 1\n")))
        .when(F.col("l_returnflag") == "A", F.concat(F.lit("class C"), n, F.lit(":\n    def inner(self): pass\n")))
        .otherwise(F.concat(F.lit("x"), n, F.lit(" = 1\n")))
    )
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", code.alias("code"))))  # lines of one order
    files = items.groupBy("l_orderkey").agg(F.array_join(F.transform(parts, lambda p: p["code"]), "").alias("content"))
    return chunking.parsed_definition_lines(files.select(F.col("l_orderkey").cast("string").alias("file_path"), "content"))


def search_result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank, place and preview of the small documents whose ids the nearest rows have, as its SQL has it.

    search_result_chunks leaves out no document.
    """
    found = _index(spark, sf_dir).search(_asked(_rows(spark, sf_dir)), K)
    chunks = chunking.small_chunks(_documents_as_files(spark, sf_dir))
    chunks = chunks.withColumn("chunk_id", F.regexp_extract("file_path", "([0-9]+)", 1).cast("long"))
    joined = found.join(chunks, F.col("row_id") == F.col("chunk_id"))
    return _rounded(joined).select("qid", "rank", F.col("file_path").alias("file"), chunking.line_range().alias("lines"), "similarity", "preview")


def search_result_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank, place and preview of all chunks of the documents whose ids the nearest rows have.

    A long document has a row for each chunk; a hit whose document is blank or absent has a row without a file.
    """
    found = _index(spark, sf_dir).search(_asked(_rows(spark, sf_dir)), K)
    chunks = chunking.chunk_files(_documents_as_files(spark, sf_dir).filter(F.col("file_path").isNotNull()))
    chunks = chunks.withColumn("chunk_id", F.regexp_extract("file_path", "(-?[0-9]+)", 1).cast("long"))
    joined = found.join(chunks, F.col("row_id") == F.col("chunk_id"), "left")
    lines = F.when(F.col("chunk_id").isNotNull(), chunking.line_range())
    return _rounded(joined).select("qid", "rank", F.col("file_path").alias("file"), lines.alias("lines"), "similarity", "preview")


class LetterCounts:
    """A provider that needs no model: how often a text has e, t and a."""

    model_id = "letter-counts"

    def get_embeddings(self, texts: list[str], task: str) -> list[list[float]]:
        return [[float(t.count(c)) for c in "eta"] for t in texts]


def stored_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents embedded through a store that already has those in English, from a run before."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    provider, path = LetterCounts(), shared.new_path(spark, "embeddings")
    embed_stored(df.filter("lang = 'en'"), provider, path, "text", buckets=32)
    found = embed_stored(df, provider, path, "text", buckets=32)
    counts = [F.col("vec")[i].cast("long").alias(f"n_{c}") for i, c in enumerate("eta")]
    return found.select("doc_id", key_of(F.col("text"), provider.model_id).alias("key"), *counts)


def file_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paths of the pages' URLs a code search would skip."""
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    rows = df.select("page_id", path.alias("path"))
    name = F.regexp_replace("path", r"\.html$", ".pdf")
    return rows.select(
        "page_id",
        code_files.hidden(F.col("path")).alias("hidden"),
        code_files.binary_name(name).alias("binary"),
        code_files.ignored(F.col("path"), ["en", "*.html", "9[0-9]*"]).alias("ignored"),
    )


def index_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).info(spark)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        exact_top10_batch, exact_top10_sql, exact_top10_single, top1_batch, k_exceeds_rows, prenormalized_inner_product,
        f64_input_cast, l2_normalize_vectors, pad_to_multiple_of_8, columns_to_vector, vector_profile, dataframe_attach_label,
        batch_nested, medoid_row, kmeans_assign_once, kmeans_update_once, cluster_histogram_offsets, ivf_parameters, ivf_probe,
        ivf_candidates, ivf_search_label_centroids, recall_metrics, recall_summary, ivf_search_trained, chunk_small_documents,
        chunk_sliding_documents, definition_boundaries, search_result_lines, file_predicates, index_info, stored_embeddings,
        tree_search_trained, tree_recall_trained, zone_search, zone_reads, zone_map, parquet_row_numbers,
        search_result_chunks, cluster_order, ivf_recall_trained, rust_definitions, typed_definitions, python_definitions,
    ]
    return {f.__name__: f for f in found}


_UNIT = """
e AS (
  SELECT vec_id AS row_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings
), q AS (
  SELECT row_id AS qid, v AS qv FROM e WHERE row_id % 20 = 0
)"""
_RANKED = "row_number() OVER (PARTITION BY qid ORDER BY s DESC, row_id)::INT AS rank"
_EXACT = f"""
, scored AS (SELECT qid, row_id, label, list_dot_product(v, qv) AS s FROM e, q)
, exact AS (SELECT qid, {_RANKED}, row_id, label, s FROM scored QUALIFY rank <= 10)"""
_CENTROIDS = """
, parts AS (SELECT row_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e)
, means AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM parts GROUP BY ALL) GROUP BY label)
, cents AS (SELECT label AS cluster, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS cv FROM means)
, assigned AS (SELECT row_id, v, cluster FROM e, cents QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY list_dot_product(v, cv) DESC, cluster) = 1)"""
_PROBES = f"""
, probes AS (SELECT qid, qv, row_number() OVER (PARTITION BY qid ORDER BY list_dot_product(qv, cv) DESC, cluster)::INT AS rank, cluster,
               list_dot_product(qv, cv) AS similarity FROM q, cents QUALIFY rank <= {PROBES})"""
_APPROX = f"""
, near AS (SELECT qid, row_id, list_dot_product(v, qv) AS s FROM assigned JOIN probes USING (cluster))
, approx AS (SELECT qid, {_RANKED}, row_id, s FROM near QUALIFY rank <= 10)"""
_METRICS = """
, ideal AS (SELECT qid, count(*) AS k, sum(s / log2(rank + 1)) AS ideal, avg(s) AS exact_mean FROM exact GROUP BY qid)
, both_ids AS (SELECT x.qid, count(*) AS n, sum(x.s / log2(a.rank + 1)) AS gain, avg(abs(x.s - a.s)) AS overlap_mae, max((x.rank = 1 AND a.rank = 1)::INT) AS top
              FROM exact x JOIN approx a ON x.qid = a.qid AND x.row_id = a.row_id GROUP BY ALL)
, by_rank AS (SELECT x.qid, avg(abs(x.s - a.s)) AS rank_mae, avg(a.s) AS approx_mean, max(CASE WHEN x.rank = 1 THEN abs(x.s - a.s) END) AS top1_delta
              FROM exact x JOIN approx a ON x.qid = a.qid AND x.rank = a.rank GROUP BY ALL)
, metrics AS (SELECT qid, coalesce(n, 0) / k AS overlap, coalesce(top, 0) AS top1_match, CASE WHEN ideal > 0 THEN coalesce(gain, 0) / ideal ELSE 0 END AS ndcg,
              rank_mae, overlap_mae, top1_delta, exact_mean, approx_mean FROM ideal LEFT JOIN both_ids USING (qid) LEFT JOIN by_rank USING (qid))"""
def _tag_sql(opening: str, pattern: str) -> str:
    return rf"""WITH c AS (SELECT page_id::VARCHAR AS file_path, string_split(regexp_replace(regexp_replace(html, '<[^>]*>', chr(10), 'g'), '(?i)\n(the|de|die|der|la|el) ', chr(10) || '{opening} ', 'g'), chr(10)) AS l FROM pages)
            , u AS (SELECT file_path, unnest(l) AS t, generate_subscripts(l, 1)::INT AS line FROM c)
            SELECT file_path, line FROM u WHERE regexp_matches(t, '{pattern}')"""


_SMALL = r"""
small AS (
  SELECT doc_id, '/docs/' || doc_id || '.txt' AS file_path, text, len(string_split(text, chr(10)))::INT AS end_line,
         trim(replace(substr(text, 1, 100), chr(10), ' ')) AS preview
  FROM documents WHERE regexp_matches(text, '\S') AND length(text) <= 4000)"""

#: Windows of the long texts of d (file_path, lines l): lines a + 1 to b.
_WINDOWS = r"""
            , t AS (SELECT file_path, l, list_transform(range(0, len(l) + 1), lambda i: coalesce(list_sum(list_transform(l[1:i], lambda x: length(x) + 1)), 0)::BIGINT) AS total FROM d)
            , w AS (
              SELECT file_path, l, total, 0 AS a, least(len(l), 0 + greatest(1, len(list_filter(total, lambda s: s < total[1] + 4000)))) AS b FROM t
              UNION ALL
              SELECT file_path, l, total, na, least(len(l), na + greatest(1, len(list_filter(total[na + 1:], lambda s: s < total[na + 1] + 4000)))) FROM
                (SELECT file_path, l, total, a + greatest(1, b - a - 5) AS na FROM w WHERE b < len(l)))"""


def oracle_sql() -> dict[str, str]:
    top10 = f"WITH {_UNIT}{_EXACT} SELECT qid, rank, row_id, round(s, 6) AS similarity FROM exact"
    return {
        "exact_top10_batch": top10,
        "exact_top10_sql": top10,
        "zone_search": top10,
        "parquet_row_numbers": "SELECT row_number() OVER () - 1 AS row_id, embedding[1] AS x FROM embeddings",
        "zone_map": f"""WITH {_UNIT}, parts AS (SELECT row_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e)
            , m AS (SELECT label, pos, avg(x) AS m FROM parts GROUP BY ALL)
            , far AS (SELECT row_id, label, sqrt(sum((x - m) * (x - m))) AS d FROM parts JOIN m USING (label, pos) GROUP BY ALL)
            , len AS (SELECT label, sqrt(sum(m * m)) AS l FROM m GROUP BY label)
            SELECT label, count(*) AS n, round(max(d), 6) AS radius, round(any_value(l), 6) AS pivot_length FROM far JOIN len USING (label) GROUP BY label""",
        "exact_top10_single": f"""WITH {_UNIT}, m AS (SELECT list(m ORDER BY pos) AS c FROM (SELECT pos, avg(x::DOUBLE) AS m FROM
            (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos))
            SELECT row_id, round(list_dot_product(v, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c)))), 6) AS similarity FROM e, m
            ORDER BY list_dot_product(v, c) DESC, row_id LIMIT 10""",
        "top1_batch": f"WITH {_UNIT}{_EXACT} SELECT qid, rank, row_id, round(s, 6) AS similarity FROM exact WHERE rank = 1",
        "k_exceeds_rows": f"WITH {_UNIT} SELECT qid, {_RANKED}, row_id, round(s, 6) AS similarity FROM (SELECT qid, row_id, list_dot_product(v, qv) AS s FROM e, q)",
        "prenormalized_inner_product": f"""WITH e AS (SELECT vec_id AS row_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id % 3 + 1)) AS v FROM embeddings)
            , q AS (SELECT row_id AS qid, v AS qv FROM e WHERE row_id % 20 = 0), s AS (SELECT qid, row_id, list_dot_product(v, qv) AS s FROM e, q)
            SELECT qid, {_RANKED}, row_id, round(s, 6) AS similarity FROM s QUALIFY rank <= 10""",
        "f64_input_cast": "SELECT vec_id AS row_id, (generate_subscripts(embedding, 1) - 1)::INT AS pos, (unnest(embedding)::DOUBLE / 3)::FLOAT::DOUBLE AS x FROM embeddings",
        "l2_normalize_vectors": """WITH n AS (SELECT *, sqrt(l_extendedprice * l_extendedprice + l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax) AS len FROM lineitem)
            SELECT l_orderkey, l_linenumber, round(l_extendedprice / len, 6) AS u0, round(l_quantity / len, 6) AS u1, round(l_discount / len, 6) AS u2,
            round(l_tax / len, 6) AS u3, round(len, 4) AS length FROM n""",
        "pad_to_multiple_of_8": """SELECT p_partkey, (generate_subscripts(v, 1) - 1)::INT AS pos, round(unnest(v)::DOUBLE, 2) AS x FROM
            (SELECT p_partkey, list_concat([p_size::FLOAT, p_retailprice::FLOAT], [0::FLOAT, 0::FLOAT, 0::FLOAT, 0::FLOAT, 0::FLOAT, 0::FLOAT]) AS v FROM part)""",
        "columns_to_vector": """WITH e AS (SELECT p_partkey AS row_id, p_size::DOUBLE AS x, p_retailprice / 100 AS y FROM part)
            , u AS (SELECT row_id, x / sqrt(x * x + y * y) AS x, y / sqrt(x * x + y * y) AS y FROM e)
            , s AS (SELECT a.row_id AS qid, b.row_id, a.x * b.x + a.y * b.y AS s FROM u a, u b WHERE a.row_id % 20 = 0)
            SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY s DESC, row_id)::INT AS rank, round(s, 6) AS similarity FROM s QUALIFY rank <= 10""",
        "vector_profile": """SELECT count(*) AS rows, count(*) FILTER (embedding IS NULL) AS null_rows,
            count(*) FILTER (len(list_filter(embedding, lambda x: x IS NULL)) > 0) AS null_elements,
            count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0) AS non_finite,
            count(*) FILTER (list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) <= 1.1920928955078125e-07) AS zero_norm,
            min(len(embedding))::INT AS min_dims, max(len(embedding))::INT AS max_dims FROM embeddings""",
        "dataframe_attach_label": f"WITH {_UNIT}{_EXACT} SELECT qid, rank, row_id AS vec_id, label, round(s, 6) AS similarity FROM exact",
        "batch_nested": f"WITH {_UNIT}{_EXACT} SELECT qid, string_agg(row_id, ',' ORDER BY rank) AS ids, count(*) AS n FROM exact GROUP BY qid",
        "medoid_row": f"""WITH {_UNIT}, m AS (SELECT list(m ORDER BY pos) AS c FROM (SELECT pos, avg(x) AS m FROM
            (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY pos))
            SELECT row_id, round(list_dot_product(v, c), 6) AS similarity FROM e, m ORDER BY list_dot_product(v, c) DESC, row_id LIMIT 1""",
        "kmeans_assign_once": f"WITH {_UNIT}{_CENTROIDS} SELECT row_id, cluster FROM assigned",
        "kmeans_update_once": f"""WITH {_UNIT}{_CENTROIDS}, p AS (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM assigned)
            , m AS (SELECT cluster, pos, avg(x) AS m FROM p GROUP BY ALL)
            SELECT cluster, (pos - 1)::INT AS pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY cluster)), 6) AS x FROM m
            UNION ALL SELECT cluster, i::INT, 0.0 FROM cents, range(64) r(i) WHERE cluster NOT IN (SELECT cluster FROM assigned)""",
        "cluster_histogram_offsets": f"""WITH {_UNIT}{_CENTROIDS}, c AS (SELECT cluster, count(*) AS rows FROM assigned GROUP BY cluster)
            SELECT cluster, rows, coalesce(sum(rows) OVER (ORDER BY cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins FROM c""",
        "ivf_parameters": """WITH g AS (SELECT o_orderkey, round(o_totalprice)::BIGINT AS n, unnest([1, 10, 20, 50]) AS k FROM orders)
            , l AS (SELECT *, CASE WHEN n < 256 THEN 1 ELSE greatest(16, least(512, floor(sqrt(n))))::INT END AS lists FROM g)
            SELECT o_orderkey, n, k, lists, least(greatest(ceil(lists * CASE WHEN k >= 50 THEN 8 WHEN k >= 20 THEN 6 ELSE 4 END / 100),
            ceil(40 * k / greatest(floor(greatest(n, 1) / lists), 1)), 1), lists)::INT AS probes FROM l""",
        "ivf_probe": f"WITH {_UNIT}{_CENTROIDS}{_PROBES} SELECT qid, rank, cluster, round(similarity, 6) AS similarity FROM probes",
        "ivf_candidates": f"WITH {_UNIT}{_CENTROIDS}{_PROBES} SELECT qid, row_id FROM assigned JOIN probes USING (cluster)",
        "ivf_search_label_centroids": f"WITH {_UNIT}{_CENTROIDS}{_PROBES}{_APPROX} SELECT qid, rank, row_id, round(s, 6) AS similarity FROM approx",
        "recall_metrics": f"""WITH {_UNIT}{_EXACT}{_CENTROIDS}{_PROBES}{_APPROX}{_METRICS}
            SELECT qid, round(overlap, 6) AS overlap, round(top1_match::DOUBLE, 6) AS top1_match, round(ndcg, 6) AS ndcg, round(rank_mae, 6) AS rank_mae,
            round(overlap_mae, 6) AS overlap_mae, round(top1_delta, 6) AS top1_delta, round(exact_mean, 6) AS exact_mean, round(approx_mean, 6) AS approx_mean FROM metrics""",
        "recall_summary": f"""WITH {_UNIT}{_EXACT}{_CENTROIDS}{_PROBES}{_APPROX}{_METRICS}
            SELECT count(*) AS queries, round(min(overlap), 6) AS min_overlap, round(avg(overlap), 6) AS mean_overlap, round(avg(top1_match), 6) AS mean_top1_match,
            round(avg(ndcg), 6) AS mean_ndcg FROM metrics""",
        "chunk_small_documents": f"WITH {_SMALL} SELECT file_path, 1::INT AS start_line, end_line, length(text)::INT AS n, preview FROM small",
        "chunk_sliding_documents": r"""WITH RECURSIVE d AS (SELECT '/docs/' || doc_id || '.txt' AS file_path, string_split(text, chr(10)) AS l FROM documents
            WHERE length(text) > 4000 AND regexp_matches(text, '\S'))""" + _WINDOWS + r"""
            SELECT file_path, (a + 1)::INT AS start_line, b::INT AS end_line, length(array_to_string(l[a + 1:b], chr(10)))::INT AS n,
            trim(replace(substr(array_to_string(l[a + 1:b], chr(10)), 1, 100), chr(10), ' ')) AS preview FROM w""",
        "definition_boundaries": r"""WITH c AS (SELECT page_id::VARCHAR AS file_path, string_split(regexp_replace(regexp_replace(html, '<[^>]*>', chr(10), 'g'), '(?i)\n(the|de) ', chr(10) || 'function ', 'g'), chr(10)) AS l FROM pages)
            , u AS (SELECT file_path, unnest(l) AS t, generate_subscripts(l, 1)::INT AS line FROM c)
            SELECT file_path, line FROM u WHERE regexp_matches(t, '^((export|default|async)\s+)*(class|function)[\s*]')""",
        "stored_embeddings": """SELECT doc_id, sha256('letter-counts' || chr(0) || 'document' || chr(0) || coalesce(text, '')) AS key,
            length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')) AS n_e,
            length(coalesce(text, '')) - length(replace(coalesce(text, ''), 't', '')) AS n_t,
            length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'a', '')) AS n_a FROM documents""",
        "search_result_lines": f"""WITH {_UNIT}{_EXACT}, {_SMALL} SELECT qid, rank, file_path AS file, '1-' || end_line AS lines, round(s, 6) AS similarity, preview
            FROM exact JOIN small ON row_id = doc_id""",
        "search_result_chunks": f"WITH RECURSIVE {_UNIT}{_EXACT}, {_SMALL}" + r""", d AS (SELECT '/docs/' || doc_id || '.txt' AS file_path, string_split(text, chr(10)) AS l FROM documents
            WHERE length(text) > 4000 AND regexp_matches(text, '\S') AND doc_id IN (SELECT row_id FROM exact))""" + _WINDOWS + r"""
            , c AS (SELECT file_path, '1-' || end_line AS lines, preview FROM small
              UNION ALL SELECT file_path, (a + 1) || '-' || b, trim(replace(substr(array_to_string(l[a + 1:b], chr(10)), 1, 100), chr(10), ' ')) FROM w)
            SELECT qid, rank, file_path AS file, lines, round(s, 6) AS similarity, preview FROM exact LEFT JOIN c ON file_path = '/docs/' || row_id || '.txt'""",
        "file_predicates": r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages)
            SELECT page_id, regexp_matches(path, '(^|/)\.') AS hidden, regexp_matches(regexp_replace(path, '\.html$', '.pdf'), '\.(pdf|png|gz|zip|so|o|a|db)$') AS "binary",
            regexp_matches(path, '^(.*/)?(en|[^\n]*\.html|9[0-9].*)(/.*)?$') AS ignored FROM p""",
        "cluster_order": f"WITH {_UNIT}{_CENTROIDS} SELECT row_id, cluster, row_number() OVER (ORDER BY cluster, row_id) - 1 AS place FROM assigned",
        "rust_definitions": _tag_sql("pub(crate) unsafe fn", r"^(pub(\([a-z]*\))?\s+|unsafe\s+)*(const|enum|fn|impl|mod|static|struct|trait|type|union)[\s*<]"),
        "typed_definitions": _tag_sql("export abstract interface", r"^((export|default|async|abstract|declare|const)\s+)*(class|function|enum|interface|namespace|type)[\s*<]"),
        "python_definitions": """WITH i AS (SELECT l_orderkey, l_linenumber, l_returnflag, CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END AS n FROM lineitem)
            , p AS (SELECT l_orderkey, l_returnflag, sum(n) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag ROWS UNBOUNDED PRECEDING) - n + 1 AS begins FROM i)
            SELECT l_orderkey::VARCHAR AS file_path, (begins + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::INT AS line FROM p WHERE l_returnflag IN ('R', 'A')""",
        "index_info": "SELECT count(*) AS rows, max(len(embedding))::INT AS dims, 'cpu' AS backend, false AS normalized, 0::INT AS lists FROM embeddings",
    }
