"""Searches that read part of the rows: the centroid tree and zone maps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import evaluate, grid, ivf, knn, probing, tree, zones
from lodestone.operators.ivf import prepare
from lodestone.operators.topk import normalise_rows
from lodestone.options import IndexOptions
from lodestone.plans.index import VectorIndex
from lodestone.sources import tables


def clustered(seed, n, dims, centres, spread):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dims))
    return (c[r.integers(0, centres, n)] + r.normal(0, spread, (n, dims))).astype(np.float32)


def asked(spark, q):
    return tables.from_local(spark, q).select(F.col("row_id").alias("qid"), F.col("vec").alias("qvec"))


def rounded(df):
    return sorted(map(tuple, df.select("qid", "rank", "row_id", F.round("similarity", 9)).collect()))


@pytest.fixture(scope="module")
def forest(spark):
    m = clustered(1, 6000, 16, 60, 0.3)
    rows = tables.from_local(spark, m)
    return m, rows, tree.TreeIndex.train(prepare(rows, False), 6000, 16, lists=64)


def test_a_tree_reaches_its_recall_on_a_small_share_of_the_rows(spark, forest):
    m, rows, index = forest
    sizes = {r.list: r.n for r in index.list_sizes().collect()}
    assert sum(sizes.values()) == 6000 and len(index.top) == 8 and 40 <= len(sizes) <= 80
    probes = index.probes_for(0.9, 10)
    q = asked(spark, m[::60])
    found, exact = index.search(q, 10, probes=probes), knn.knn_arrow(rows, q, 10, 16)
    s = evaluate.summary(exact, found).first()
    assert s.queries == 100 and s.mean_overlap >= 0.9
    near = index.nearest_lists(grid.write_queries(q, 100, 16, 10, False), *probes).collect()
    assert sum(sizes[r.row_id] for r in near) / (100 * 6000) <= 0.15


def test_every_list_and_every_top_gives_the_exact_result(spark, forest):
    m, rows, index = forest
    q = asked(spark, m[:7])
    everything = index.search(q, 5, probes=(len(index.top), tree.MAX_FINE * len(index.top)))
    assert rounded(everything) == rounded(knn.knn_arrow(rows, q, 5, 16))


def test_rows_go_to_the_nearest_list_below_their_top(spark, forest):
    m, _, index = forest
    unit, lower = normalise_rows(m.astype(np.float64)), tree._Lower(index.fine)
    for r in index.lists.filter("row_id % 97 = 0").collect():
        numbers, c = lower(r.list // tree.MAX_FINE)
        assert int(np.argmax(index.top @ unit[r.row_id])) == r.list // tree.MAX_FINE
        assert numbers[np.argmax(c @ unit[r.row_id])] == r.list


def test_a_tree_of_equal_rows_and_a_hot_list(spark):
    m = np.concatenate([np.ones((900, 4)), np.random.default_rng(3).normal(size=(300, 4))]).astype(np.float32)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join parts as small as these
    index = tree.TreeIndex.train(prepare(tables.from_local(spark, m), False), 1200, 4, lists=16)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = index.lists.select(F.input_file_name().alias("f"), "list").groupBy("list").agg(F.count_distinct("f").alias("files"), F.count(F.lit(1)).alias("n"))
    hot = files.orderBy(F.desc("n")).first()
    assert hot.n >= 900 and hot.files > 1  # dealt over files, not one task
    top = index.search(asked(spark, m[:1]), 3, probes=(1, 1)).collect()
    assert [(r.rank, r.row_id) for r in sorted(top, key=lambda r: r["rank"])] == [(1, 0), (2, 1), (3, 2)]
    assert index.search(spark.createDataFrame([], "qid long, qvec array<float>"), 3, probes=(1, 1)).count() == 0


@pytest.mark.parametrize("many", [0, 1, 1000])
def test_asked_lists_by_name_by_join_or_by_scan(spark, forest, monkeypatch, many):
    m, rows, index = forest
    monkeypatch.setattr(probing, "NAMED", many)
    monkeypatch.setattr(probing, "FEW_ROWS", 3 if many == 0 else 20_000)
    q = asked(spark, m[:5])
    found = index.search(q, 4, probes=(len(index.top), tree.MAX_FINE * len(index.top)))
    assert rounded(found) == rounded(knn.knn_arrow(rows, q, 4, 16))


@pytest.mark.parametrize("spread", [0.1, 3.0])
def test_zones_give_the_rows_of_a_full_scan(spark, spread, monkeypatch):
    m = clustered(7, 1500, 8, 25, spread)
    rows = tables.from_local(spark, np.concatenate([m, m[:40]]))  # with ties
    zoned = prepare(rows, False).withColumn("list", F.col("row_id") % 1500 % 25 if spread > 1 else F.lit(0))
    if spread < 1:
        zoned = tree.TreeIndex.train(prepare(rows, False), 1540, 8, lists=36).lists
    monkeypatch.setattr(zones, "ZONES", 7)
    index = zones.ZoneIndex.build(zoned, 8)
    q = asked(spark, m[::50])
    for k in (1, 10, 2000):
        k = min(k, 1540)
        assert rounded(index.search(q, k)) == rounded(knn.knn_arrow(rows, q, k, 8))
    reads = index.reads(q, 5).collect()
    assert len(reads) == 30 and all(r.rows == 1540 for r in reads)
    if spread < 1:
        assert sum(r.zones_read for r in reads) < 0.4 * sum(r.zones for r in reads)


def test_an_index_of_two_levels(spark):
    m = clustered(4, 900, 8, 20, 0.2)
    index = VectorIndex(tables.from_local(spark, m), IndexOptions(approx=True, enable_cache=False, levels=2, recall=0.9))
    exact = VectorIndex(tables.from_local(spark, m), IndexOptions(enable_cache=False)).search(m[:30], 5)
    assert evaluate.summary(exact, index.search(m[:30], 5)).first().mean_overlap >= 0.85
    assert isinstance(index._ivf, tree.TreeIndex) and index.info(spark).first().lists == index._ivf.list_sizes().count()


def test_zone_maps_bound_their_rows(spark):
    m = normalise_rows(clustered(9, 300, 6, 5, 1.0).astype(np.float64))
    rows = spark.createDataFrame([(i, [float(x) for x in v], i % 7) for i, v in enumerate(m)], "row_id long, vec array<double>, list int")
    index = zones.ZoneIndex.build(rows, 6)
    q = normalise_rows(np.random.default_rng(2).normal(size=(20, 6)))
    for z in index.map.collect():
        own = m[z.list :: 7]
        assert z.n == len(own) and np.allclose(z.pivot, own.mean(axis=0))
        assert np.isclose(z.radius, np.linalg.norm(own - own.mean(axis=0), axis=1).max())
        assert (zones.reach(q, np.array([z.pivot]), np.array([z.radius]))[:, 0] >= (q @ own.T).max(axis=1)).all()


@pytest.mark.parametrize("shuffle", [1, 6])
def test_a_cluster_with_half_of_all_rows_is_spread_and_placed(spark, shuffle):
    rows = [(i, 3 if i % 2 else i % 5) for i in range(4000)]
    spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else parts this small become one
    try:
        df = spark.createDataFrame(rows, "row_id long, cluster int").repartition(3, "row_id").withColumn("more", F.lit("x"))
        tasks = ivf.ranged(df).filter("cluster = 3").groupBy("part").count().collect()
        placed = ivf.cluster_order(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) >= shuffle // 2
    in_order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert [(r.row_id, r.cluster) for r in sorted(placed, key=lambda r: r.place)] == in_order and {r.place for r in placed} == set(range(4000))
    assert placed[0].more == "x" and ivf.cluster_order(df.limit(0)).count() == 0
