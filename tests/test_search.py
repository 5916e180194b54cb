"""Exact and approximate search against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import errors, queries, shared
from lodestone.operators import chunking, evaluate, grid, ivf, knn, plane, results, seeding, topk
from lodestone.options import IndexOptions
from lodestone.plans.index import VectorIndex
from lodestone.sources import tables


def naive(m, q, k):
    m = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    q = np.atleast_2d(q).astype(np.float64)
    s = q / np.linalg.norm(q, axis=1, keepdims=True) @ m.T
    order = np.lexsort((np.broadcast_to(np.arange(s.shape[1]), s.shape), -s), axis=1)[:, :k]
    return order, np.take_along_axis(s, order, 1)


def asked(spark, q):
    return tables.from_local(spark, q).select(F.col("row_id").alias("qid"), F.col("vec").alias("qvec"))


def test_three_rows(spark):
    m = np.zeros((3, 8), np.float32)
    m[0, 0] = m[1, 1] = m[2, 0] = m[2, 1] = 1
    ids, sims = results.to_numpy(VectorIndex.from_local(spark, m, enable_cache=False).search([0.8, 0.6] + [0.0] * 6, 2))
    assert ids.tolist() == [[2, 0]] and np.allclose(sims, [[0.98994946, 0.8]])


def test_k_is_capped_and_ties_go_to_low_ids(spark):
    m = np.tile(np.eye(1, 8, dtype=np.float32), (5, 1))
    index = VectorIndex.from_local(spark, m, enable_cache=False)
    ids, sims = results.to_numpy(index.search(-m[:4], 3))
    assert ids.tolist() == [[0, 1, 2]] * 4 and (sims == -1).all()
    assert results.to_numpy(index.search(m[:1], 100))[0].tolist() == [[0, 1, 2, 3, 4]]
    assert (index.rows, index.dims, index.backend, index.gpu_info) == (5, 8, "cpu", None)


SCENARIOS = {
    "uniform": lambda r: r.uniform(-1, 1, (512, 32)),
    "products": lambda r: np.column_stack([x := r.normal(size=(600, 11)), x**2, np.sin(x * x[:, :1])]),
    "shells": lambda r: (x := r.normal(size=(500, 129))) / np.linalg.norm(x, axis=1, keepdims=True) * r.choice([1, 2, 4, 8], (500, 1)),
    "low_rank": lambda r: r.normal(size=(700, 12)) @ r.normal(size=(12, 192)) + 0.01 * r.normal(size=(700, 192)),
    "sparse": lambda r: r.normal(size=(400, 640)) * (r.random((400, 640)) < 0.02) + 0.01,
    "bits": lambda r: r.choice([-1.0, 1.0], (500, 64)) @ r.normal(size=(64, 96)),
}


@pytest.mark.parametrize("name", SCENARIOS)
def test_exact_matches_numpy(spark, name):
    r = np.random.default_rng(42)
    m = SCENARIOS[name](r).astype(np.float32)
    q = (m[r.integers(0, len(m), 9)] + r.normal(0, 0.02, (9, m.shape[1]))).astype(np.float32)
    want, sims = naive(m, q, 15)
    rows = tables.from_local(spark, m).repartition(3)
    for found in (knn.knn_arrow(rows, asked(spark, q), 15, m.shape[1]), knn.knn_sql(rows, asked(spark, q), 15)):
        ids, got = results.to_numpy(found)
        assert np.array_equal(ids, want) and np.allclose(got, sims, atol=1e-5)
    single = [x.row_id for x in knn.single_top(rows, q[0].tolist(), 15).collect()]
    assert single == want[0].tolist()


def test_query_blocks_change_nothing(spark, monkeypatch):
    r = np.random.default_rng(3)
    m, q = r.normal(size=(200, 8)).astype(np.float32), r.normal(size=(23, 8)).astype(np.float32)
    for name, value in (("QUERY_BYTES", 8 * 8 * 5), ("ROW_BYTES", 8 * 8 * 7), ("SCORES", 11), ("FAN", 3)):
        monkeypatch.setattr(grid, name, value)
    ids, _ = results.to_numpy(knn.knn_arrow(tables.from_local(spark, m).repartition(5), asked(spark, q), 4, 8))
    assert np.array_equal(ids, naive(m, q, 4)[0])
    some = list(grid.query_blocks(grid.write_queries(asked(spark, q), 23, 8, 4, False)))
    assert len(some) >= 5 and max(len(b[1]) for b in some) == 5 and sorted(np.concatenate([b[1] for b in some]).tolist()) == list(range(23))


def test_queries_are_neither_fetched_nor_counted_twice(spark):
    """A search of known size takes one job before its result is asked for, however many blocks there are."""
    m = np.random.default_rng(1).normal(size=(50, 8)).astype(np.float32)
    rows, q = tables.from_local(spark, m), asked(spark, m)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("grid-jobs", "")
    knn.knn_arrow(rows, q, 3, 8, asked=50)
    jobs = len(tracker.getJobIdsForGroup("grid-jobs"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs <= 2  # the write, and what Spark does for its shuffle


def test_no_queries(spark):
    index = VectorIndex.from_local(spark, np.eye(3), enable_cache=False)
    none = spark.createDataFrame([], "qid long, qvec array<float>")
    assert knn.knn_arrow(tables.from_local(spark, np.eye(3)), none, 2, 3).count() == 0
    assert index.rows == 3


def test_running_top_keeps_ties_by_id():
    top = topk.RunningTop(1, 2)
    top.add(np.array([[0.5, 0.5]]), np.array([9, 4]))
    top.add(np.array([[0.5, 0.1]]), np.array([1, 2]))
    assert top.ids.tolist() == [[1, 4]]


def test_payload_and_shapes(spark):
    m = np.eye(4, dtype=np.float32)
    index = VectorIndex.from_local(spark, m, enable_cache=False)
    payload = spark.createDataFrame([(i, f"n{i}", 9.0) for i in range(4)], "row_id long, name string, similarity double")
    got = index.search(m[:2], 1, payload=payload).orderBy("qid").collect()
    assert [(r.name, r.similarity) for r in got] == [("n0", 1.0), ("n1", 1.0)]
    found = index.search(m[:2], 2)
    assert [len(r.neighbors) for r in results.nested(found).collect()] == [2, 2]
    assert [f.count() for f in results.split_by_query(found)] == [2, 2]


def test_plans_rank_within_tasks_first(spark):
    m = tables.from_local(spark, np.eye(8))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan(knn.knn_sql(m, asked(spark, np.eye(8)), 2))
    assert "CartesianProduct" not in plan(knn.knn_sql(m, asked(spark, np.eye(8)), 2))
    assert "TakeOrderedAndProject" in plan(knn.single_top(m, [1.0] * 8, 2))


@pytest.mark.parametrize(("rows", "lists"), [(0, 1), (255, 1), (256, 16), (500, 22), (2000, 44), (10**6, 512), (10**9, 512)])
def test_list_count(rows, lists):
    assert ivf.list_count(rows) == lists


@pytest.mark.parametrize(("lists", "k", "rows", "probes"), [(22, 10, 500, 19), (44, 1, 2000, 2), (44, 10, 2000, 9), (44, 20, 2000, 18), (1, 5, 100, 1), (512, 50, 10**6, 41)])
def test_probe_count(lists, k, rows, probes):
    assert ivf.probe_count(lists, k, rows) == probes


def test_training_follows_a_direct_version(spark):
    r = np.random.default_rng(5)
    m = r.normal(size=(300, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "row_id long, vec array<double>").coalesce(1)
    index = ivf.IvfIndex.train(rows, 300, 8)
    c = direct_seeds(m, 17, 8)
    for _ in range(ivf.ROUNDS):
        best = np.argmax(m @ c.T, axis=1)
        c = np.array([m[best == i].mean(axis=0) if (best == i).any() else np.zeros(8) for i in range(17)])
        n = np.linalg.norm(c, axis=1, keepdims=True)
        c = np.where(n > 0, c / np.where(n > 0, n, 1), c)
    assert np.allclose(index.centroids, c, atol=1e-9)
    got = {x.row_id: x.cluster for x in index.assigned.collect()}
    assert [got[i] for i in range(300)] == best.tolist()


def test_seeding_repeats_when_all_rows_are_equal(spark):
    same = shared.written(tables.from_local(spark, np.ones((4, 2)) / 2**0.5), "seeds")
    assert np.allclose(seeding.seed_centroids(same, 4, 2, 3), np.ones((3, 2)) / 2**0.5)


def direct_seeds(m, lists, padded):
    """k-means++ over all rows of one array."""
    draw = seeding.Generator(len(m), padded)
    return seeding.weighted_seeds(m, np.ones(len(m)), int(np.argmax(m @ m.mean(axis=0))), lists, draw)


def direct_rounds(m, lists, padded, picks):
    """The oversampling and its reduction on one array."""
    starts, first = seeding.Generator(len(m) + 1, padded), int(np.argmax(m @ m.mean(axis=0)))
    chosen = np.array([first])
    for _ in range(seeding.SAMPLING_ROUNDS):
        away = np.maximum(1 - (m @ m[chosen].T).max(axis=1), 0)
        line, start = np.cumsum(away), starts()
        chosen = np.union1d(chosen, np.searchsorted(line, (start + np.arange(picks)) * line[-1] / picks, "left"))
    weights = np.bincount(np.argmax(m @ m[chosen].T, axis=1), minlength=len(chosen))
    return seeding.weighted_seeds(m[chosen], weights, int(np.searchsorted(chosen, first)), lists, seeding.Generator(len(m), padded))


def test_seeds_of_partitions_equal_those_of_one_array(spark, monkeypatch):
    m = topk.normalise_rows(np.random.default_rng(2).normal(size=(900, 6)))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "row_id long, vec array<double>")
    spread = rows.repartitionByRange(5, "row_id").sortWithinPartitions("row_id").cache()
    assert np.allclose(seeding.seed_centroids(spread, 900, 6, 12), direct_seeds(m, 12, 8))
    monkeypatch.setattr(seeding, "PICKS", 1)
    assert np.allclose(seeding.seed_centroids(spread, 900, 6, 12), direct_rounds(m, 12, 8, 48))


def test_weighted_picks_follow_the_distances():
    away = np.array([0, 0, 5.0, 0, 1, 4, 0])
    assert seeding.spaced_picks(away, 0, 10, 10, 0.5).tolist() == [2, 4, 5]
    assert seeding.spaced_picks(away, 0, 10, 2, 0.5).tolist() == [2, 5]
    a, b = seeding.spaced_picks(away[:3], 0, 10, 2, 0.5), seeding.spaced_picks(away[3:], 5, 10, 2, 0.5) + 3
    assert a.tolist() + b.tolist() == [2, 5]


def test_wanted_recall_is_reached(spark):
    r = np.random.default_rng(3)
    m = r.normal(size=(2000, 32)).astype(np.float32)
    rows, q = tables.from_local(spark, m), asked(spark, m[::40])
    index = VectorIndex(rows, IndexOptions(approx=True, enable_cache=False, recall=0.9))
    s = evaluate.summary(VectorIndex(rows, IndexOptions(enable_cache=False)).search(q, 10), index.search(q, 10)).first()
    assert s.mean_overlap >= 0.9 and 1 < index.probes(10) < 44


def test_top_with_many_ties():
    top = topk.RunningTop(2, 3)
    top.add(np.array([[1.0, 1, 1, 1, 0], [0, 2, 1, 3, 1]]), np.array([9, 4, 7, 1, 2]))
    top.add(np.array([[1.0, 0.5], [1, 1]]), np.array([0, 3]))
    assert top.ids.tolist() == [[0, 1, 4], [1, 4, 0]]


def test_ids_must_be_right(spark):
    rows = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(4)], "row_id long, vec array<double>")
    index = VectorIndex(rows, IndexOptions(enable_cache=False))
    ask = lambda ids: spark.createDataFrame([(i, [1.0, 2.0]) for i in ids], "qid long, qvec array<double>")
    for ids in ([None], [1, 1]):
        with pytest.raises(errors.InvalidQueryIds):
            index.search(ask(ids), 2)
    payload = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (9, "d")], "id long, x string")
    with pytest.raises(errors.PayloadMismatch):
        index.search(ask([1]), 2, payload, "id")
    with pytest.raises(errors.NullValues):
        VectorIndex(rows.unionByName(spark.createDataFrame([(None, [1.0, 1.0])], rows.schema)), IndexOptions(enable_cache=False)).fit()


def test_many_queries_are_not_broadcast_as_a_table(spark, monkeypatch):
    m = np.random.default_rng(5).normal(size=(60, 4)).astype(np.float32)
    rows, q = tables.from_local(spark, m), asked(spark, m[:9])
    one = sorted(map(tuple, knn.knn_sql(rows, q, 4).withColumn("similarity", F.round("similarity", 9)).collect()))
    monkeypatch.setattr(knn, "FEW_ROWS", 3)
    assert sorted(map(tuple, knn.knn_sql(rows, q, 4).withColumn("similarity", F.round("similarity", 9)).collect())) == one


@pytest.mark.parametrize(("rows", "dims", "k", "bar", "seed"), [(2048, 64, 10, 0.5, 42), (4096, 64, 20, 0.6, 7)])
def test_approximate_recall(spark, rows, dims, k, bar, seed):
    r = np.random.default_rng(seed)
    m = r.uniform(-1, 1, (rows, dims)).astype(np.float32)
    index = VectorIndex(tables.from_local(spark, m), IndexOptions(approx=True, enable_cache=False))
    q = asked(spark, m[:8] + r.normal(0, 0.02, (8, dims)).astype(np.float32))
    exact, approx = VectorIndex(tables.from_local(spark, m), IndexOptions(enable_cache=False)).search(q, k), index.search(q, k)
    s = evaluate.summary(exact, approx).first()
    assert s.queries == 8 and s.mean_overlap >= bar and s.mean_top1_match >= 0.9 and s.mean_ndcg > 0.5
    one = index.search(q.filter("qid = 3"), k).orderBy("rank").collect()
    assert [x.row_id for x in one] == [x.row_id for x in approx.filter("qid = 3").orderBy("rank").collect()]


def test_small_tables_are_searched_exactly(spark):
    index = VectorIndex.from_local(spark, np.eye(8), approx=True, enable_cache=False).fit()
    assert index._ivf is None


def test_index_is_saved_and_loaded(spark, tmp_path):
    m = np.random.default_rng(1).normal(size=(400, 8)).astype(np.float32)
    index = VectorIndex(tables.from_local(spark, m), IndexOptions(approx=True, enable_cache=False)).fit()
    index._ivf.save(str(tmp_path / "ivf"))
    loaded = ivf.IvfIndex.load(spark, str(tmp_path / "ivf"))
    q = asked(spark, m[:3])
    key = lambda df: sorted((x.qid, x["rank"], x.row_id) for x in df.collect())
    assert key(loaded.search(q, 5)) == key(index.search(q, 5))


def test_short_lists_give_fewer_rows(spark):
    m = np.eye(4)
    assigned = spark.createDataFrame([(i, m[i].tolist(), i) for i in range(4)], "row_id long, vec array<double>, cluster int")
    found = ivf.IvfIndex(m, assigned, 4).search(asked(spark, m[:1]), 3, probes=2)
    assert found.count() == 2


def test_metrics_of_equal_and_of_empty_results(spark):
    exact = spark.createDataFrame([(0, 1, 5, 0.9), (0, 2, 6, 0.8), (1, 1, 7, 0.5)], "qid long, rank int, row_id long, similarity double")
    same = evaluate.per_query(exact, exact).orderBy("qid").collect()
    assert all(r.overlap == 1 and r.ndcg == pytest.approx(1) and r.top1_match == 1 and r.rank_mae == 0 for r in same)
    none = evaluate.per_query(exact, exact.filter("qid = 1")).orderBy("qid").collect()
    assert none[0].overlap == 0 and none[0].ndcg == 0 and none[0].rank_mae is None


def test_every_hit_has_its_chunks(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = [(i, i % 3, [float(x) for x in r.normal(size=8)]) for i in range(45)]
    long = "\n".join(f"line {i} of a long document" for i in range(600))
    texts = {i: ["short\ntext", long, " \n", None, "x" * 9000][i % 5] for i in range(40)}
    spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([*texts.items(), (None, long)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for hit in queries.exact_top10_batch(spark, str(tmp_path)).collect():
        text = texts.get(hit.row_id) or ""
        lines = text.split("\n")
        spans = [(0, len(lines), text)] if len(text) <= 4000 else list(chunking.window_spans(lines, 4000, 5))
        for begin, end, part in spans if text.strip() else []:
            expected.append((hit.qid, hit["rank"], f"/docs/{hit.row_id}.txt", f"{begin + 1}-{end}", hit.similarity, part[:100].replace("\n", " ").strip()))
        if not text.strip():
            expected.append((hit.qid, hit["rank"], None, None, hit.similarity, None))
    found = [tuple(x) for x in queries.search_result_chunks(spark, str(tmp_path)).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert {(x[0], x[1]) for x in found} == {(q, n) for q in (0, 20, 40) for n in range(1, 11)}
    assert any(x[3] and not x[3].startswith("1-") for x in found)


def test_a_large_k_shuffles_no_pairs(spark):
    r = np.random.default_rng(5)
    m = r.normal(size=(5000, 6)).astype(np.float32)
    m[3000:3600] = m[7]  # ties
    rows = tables.from_local(spark, m).repartition(3)
    for k in (grid.WIDE, 1_000_000):
        found = VectorIndex(rows, IndexOptions(enable_cache=False)).search(asked(spark, m[[7, 11, 3001]]), k)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # that of the queries
        ids, sims = results.to_numpy(found)
        want, values = naive(m, m[[7, 11, 3001]], k)
        assert ids.shape == (3, min(k, 5000)) and np.allclose(sims, values)
        assert ids[0, :601].tolist() == [7, *range(3000, 3600)] and ids[2].tolist() == ids[0].tolist()
        assert sorted(ids[1].tolist()[:4000]) == sorted(want[1].tolist()[:4000])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_many_queries_are_no_rows(spark):
    """top1_batch, exact_top10_sql and batch_nested: beyond a few queries pairs are made in blocks."""
    m = np.random.default_rng(6).normal(size=(knn.FEW_QUERIES + 1, 8)).astype(np.float32)
    rows = tables.from_local(spark, m)
    assert "Join" in plan_of(knn.knn_sql(rows, asked(spark, m[:-1]), 1))
    found = knn.knn_sql(rows, asked(spark, m), 1)
    assert "Join" not in plan_of(found) and sorted((r.qid, r.row_id) for r in found.collect()) == [(i, i) for i in range(len(m))]


def test_equal_rows_tie_wherever_they_stand():
    r = np.random.default_rng(9)
    for dims, n in ((3, 1001), (64, 517), (129, 2050)):
        m, q = topk.normalise_rows(r.normal(size=(n, dims))), topk.normalise_rows(r.normal(size=(1500, dims)))
        same = np.sort(r.choice(n, 90, replace=False))
        m[same] = m[same[0]]
        q[1400:] = m[same[0]] + 1e-3 * q[1400:]
        top = grid.best_of(q, np.arange(n), m, 20)
        assert (top.ids[1400:] == same[:20]).all() and (top.scores[1400:] == top.scores[1400:, :1]).all()
        s = topk.products(q[:50], m)
        want = np.lexsort((np.broadcast_to(np.arange(n), s.shape), -s), axis=1)[:, :20]
        assert np.array_equal(top.ids[:50], want) and np.array_equal(top.scores[:50], np.take_along_axis(s, want, 1))


def test_two_dimensions_are_searched_by_angle(spark):
    """columns_to_vector: as the grid finds, with copies, opposite directions and equal lengths."""
    r = np.random.default_rng(2)
    m = np.vstack([r.normal(size=(3000, 2)), np.tile([[3.0, 4.0]], (2500, 1)), [[-1, 0], [1, 0], [0, -1], [-1, -1e-7]], r.integers(1, 50, (500, 2))])
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "row_id long, vec array<double>").repartition(4)
    q = rows.filter("row_id % 37 = 0 or row_id between 5495 and 5510").select(F.col("row_id").alias("qid"), F.col("vec").alias("qvec"))
    found, want = plane.plane_top(rows, q, 7).toPandas(), knn.knn_arrow(rows, q, 7, 2).toPandas()
    by = ["qid", "rank"]
    found, want = found.sort_values(by), want.sort_values(by)
    assert found[by].values.tolist() == want[by].values.tolist() and np.allclose(found.similarity, want.similarity, rtol=0, atol=1e-14)
    copies = want[want.similarity.groupby(want.qid).transform("nunique") > 1]
    assert len(copies) and found[found.qid == 3004].row_id.tolist() == list(range(3000, 3007)) or 3004 not in set(found.qid)


def test_probed_rows_are_ranked_in_blocks(spark):
    """ivf_search_label_centroids, recall_metrics, recall_summary: pairs of queries and probed rows are no rows of a join."""
    r = np.random.default_rng(8)
    m = topk.normalise_rows(r.normal(size=(300, 5)))
    assigned = spark.createDataFrame([(i, v, i % 4) for i, v in enumerate(m.tolist())], "row_id long, vec array<double>, cluster int")
    q = assigned.filter("row_id < 9").select(F.col("row_id").alias("qid"), F.col("vec").alias("qvec"))
    probes = spark.createDataFrame([(i, c) for i in range(9) for c in (i % 4, (i + 1) % 4)], "qid long, cluster int")
    found = ivf.rerank(assigned, probes, q, 6)
    assert "Join" not in plan_of(found)
    ids, _ = results.to_numpy(found)
    for i in range(9):
        some = np.flatnonzero(np.isin(np.arange(300) % 4, [i % 4, (i + 1) % 4]))
        assert ids[i].tolist() == some[np.argsort(-(m[some] @ m[i]), kind="stable")][:6].tolist()


def test_nearest_centroids_hold_few_scores(monkeypatch):
    """Training of ivf_search_trained and tree_search_trained: one batch by all candidates was over 1 GB."""
    r = np.random.default_rng(4)
    m, c = r.normal(size=(500, 4)), r.normal(size=(40, 4))
    c[7] = c[3]
    monkeypatch.setattr(topk, "NEAREST", 100)
    best, score = topk.nearest(m, c)
    assert np.array_equal(best, np.argmax(m @ c.T, axis=1)) and np.allclose(score, (m @ c.T).max(axis=1))


def test_a_large_k_writes_one_copy_of_the_rows(spark, monkeypatch):
    """k_exceeds_rows: rows go to the shared folder in the type they have, without a shuffle, in row groups that a task can hold."""
    m = np.random.default_rng(3).normal(size=(5000, 16)).astype(np.float32)
    rows, paths = tables.from_local(spark, m).repartition(3), []
    assert plan_of(grid.row_columns(rows, 5000, 16, False)).count("Exchange") == 1  # that of the test
    monkeypatch.setattr(grid, "QUERY_BYTES", 8 * 16 * 300)
    monkeypatch.setattr(shared, "new_path", lambda session, tag, of=shared.new_path: paths.append(of(session, tag)) or paths[-1])
    found = knn.knn_arrow(rows, asked(spark, m[:2]), 5000, 16)
    blocks = spark.read.parquet(paths[0])
    assert len(paths) == 1 and blocks.selectExpr("sum(length(vectors))", "sum(length(ids))").first()[:] == (4 * m.size, 8 * len(m))
    groups = [g.num_rows for f in shared.table(paths[0]).get_fragments() for g in f.row_groups]
    assert groups == [1] * blocks.count() and len(groups) > 16
    assert np.array_equal(results.to_numpy(found)[0], naive(m, m[:2], 5000)[0])


@pytest.mark.parametrize(("k", "kind"), [(4200, "float"), (5000, "float"), (4999, "double")])
def test_a_long_ranking_is_made_in_pieces(spark, monkeypatch, k, kind):
    """k_exceeds_rows: one task held all of a query's ranking. Ties go on from one piece to the next."""
    m = np.random.default_rng(4).normal(size=(5000, 6)).astype(np.float32)
    m[1000:3500] = m[7]
    rows = tables.from_local(spark, m).repartition(3).select("row_id", F.col("vec").cast(f"array<{kind}>").alias("vec"))
    monkeypatch.setattr(grid, "RANKED_ROWS", 100)
    want = sorted(map(tuple, knn.knn_arrow(rows, asked(spark, m[[7, 11, 40]]), k, 6).collect()))
    monkeypatch.setattr(grid, "PIECE", 900)
    monkeypatch.setattr(grid, "RANKED_BYTES", 64 * grid.rows_per_block(6, 1))  # two queries at once
    assert sorted(map(tuple, knn.knn_arrow(rows, asked(spark, m[[7, 11, 40]]), k, 6).collect())) == want
    assert [x[1] for x in want] == [*range(1, k + 1)] * 3
    assert [x[2] for x in want[:2501]] == [7, *range(1000, 3500)]


def test_a_ranking_sorts_ties_by_id():
    r = np.random.default_rng(5)
    for some in ([], [3.0], r.normal(size=50), r.integers(0, 3, 400) / 2, np.zeros(30), np.array([0.0, -0.0, 1.0, 0.0])):
        scores, ids = np.asarray(some, np.float64), r.permutation(len(some))
        assert np.array_equal(topk.ranking(scores, ids), np.lexsort((ids, -scores)))
