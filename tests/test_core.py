"""Vector tables, searches, changes, codes, graphs, rankings and files."""

import itertools
import json
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide import errors
from vectide.config import Builder, IndexConfig
from vectide.functions import metrics
from vectide.functions.vectors import normalize
from vectide.operators import evaluate, graph, quantize, rank, search
from vectide.plans import ranking_queries, search_queries
from vectide.scratch import scratch_path
from vectide.sources import files, reports, snapshot
from vectide.streaming import ingest
from vectide.table import PairedTable, VectorTable, dense_ids


def line(spark, n=100):
    return VectorTable.create(spark.range(n).select("id", F.array(F.col("id").cast("float")).alias("vector")), id="id")


def ids(spark, values):
    return spark.createDataFrame([(int(v),) for v in values], "id long")


def found(df):
    return [r.id for r in df.orderBy("rank").collect()]


def uniform(spark, n, dim, seed, name="id"):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.random((n, dim), dtype=np.float32))], f"{name} long, vector array<float>")


def test_filter_comes_before_the_nearest(spark):
    t = line(spark)
    assert found(t.search([12.1], 3, "id % 10 = 0")) == [10, 20, 0]
    assert found(t.search([0.0], 1, "id = 99")) == [99]
    assert found(t.search([5.2], 200)) == sorted(range(100), key=lambda i: (abs(i - 5.2), i))


def test_removed_rows(spark):
    t, told = line(spark).remove(ids(spark, [20, 40]))
    assert {tuple(r) for r in told.collect()} == {(20, True), (40, True)}
    assert found(t.search([0.0], 5, "id % 20 = 0")) == [0, 60, 80]
    again, told = t.remove(ids(spark, [20, 60]))
    assert {tuple(r) for r in told.collect()} == {(20, False), (60, True)}
    assert (again.len(), again.deleted_count(), again.live_len()) == (100, 3, 97)
    back, told = again.restore(ids(spark, [20, 61]))
    assert {tuple(r) for r in told.collect()} == {(20, True), (61, False)}
    assert back.is_deleted(40) and not back.is_deleted(20)
    with pytest.raises(errors.IdOutOfBounds):
        t.remove(ids(spark, [100]))


def test_compaction_numbers_densely(spark):
    t, _ = line(spark).remove(ids(spark, range(0, 100, 2)))
    new, names = t.compacted()
    assert {(r.new_id, r.old_id) for r in names.collect()} == {(n, 2 * n + 1) for n in range(50)}
    assert {(r.id, r.vector[0]) for r in new.rows.collect()} == {(n, 2.0 * n + 1) for n in range(50)}


def test_dense_ids_cross_ranges(spark):
    values = sorted(random.Random(1).sample(range(-(1 << 40), 1 << 40), 60)) + [1 << 41, (1 << 41) + 1]
    got = dense_ids(spark.createDataFrame([(v,) for v in values], "v long"), "v", "n").collect()
    assert {r.v: r.n for r in got} == {v: i for i, v in enumerate(values)}


def test_checks(spark):
    t = line(spark)
    with pytest.raises(errors.DimensionMismatch):
        t.search([1.0, 2.0], 0)  # the dimension counts first
    with pytest.raises(errors.ZeroK):
        t.search([1.0], 0)
    with pytest.raises(errors.InvalidVector):
        t.search([float("nan")], 1)
    with pytest.raises(errors.IdOutOfBounds):
        t.get(100)
    with pytest.raises(errors.ReadOnly):
        t.frozen().remove(ids(spark, [1]))
    for bad in ("array(1f, 2f)", "cast(null as array<float>)", "array(float('nan'))", "array(cast(null as float))"):
        with pytest.raises(Exception, match="not finite or not of dimension"):
            t.insert(spark.sql(f"select 1L as o, {bad} as vector"), "o").rows.collect()
    with pytest.raises(errors.DimensionMismatch):
        search.knn_join(spark.sql("select 1L as query_id, array(1f, 2f) as vector"), t.rows, 3)
    empty = VectorTable.create(spark.createDataFrame([], "id long, vector array<float>"), id="id")
    assert empty.is_empty() and found(empty.search([1.0, 2.0], 3)) == []
    assert search.knn_join(spark.sql("select 1L as query_id, array(1f) as vector"), empty.rows, 3).count() == 0


@pytest.mark.parametrize("bad", [{"m": 1}, {"m": 16, "ef_construction": 8}, {"m": 16, "m0": 4}, {"prune_strategy": "none"}, {"shards": 0}])
def test_settings(bad):
    with pytest.raises(errors.InvalidConfig):
        IndexConfig(**bad)


def test_builder(spark):
    b = Builder().m(8).ef_construction(50).prune_strategy("heuristic").shards(2).seed(3).metric("cosine")
    assert (b.config.m, b.config.m0, b.config.shards, b.metric_name) == (8, 16, 2, "cosine")
    assert IndexConfig.from_json(b.config.to_json()) == b.config
    assert b.build(line(spark).rows, id="id").metric is metrics.COSINE


def brute(q, v, name):
    q, v = q.astype(np.float64), v.astype(np.float64)
    if name == "cosine":
        n = np.linalg.norm(q) * np.linalg.norm(v, axis=1)
        return np.where(n == 0, 1.0, 1 - np.clip(v @ q / np.where(n == 0, 1, n), -1, 1))
    return {"sqeuclidean": ((v - q) ** 2).sum(1), "euclidean": np.sqrt(((v - q) ** 2).sum(1)), "dot": 1 - v @ q, "manhattan": np.abs(v - q).sum(1)}[name]


@pytest.mark.parametrize("name", search_queries.METRICS)
@pytest.mark.parametrize("dim", [1, 5, 200])
def test_metrics_agree(spark, name, dim):
    r = np.random.default_rng(dim)
    v = r.normal(size=(40, dim))
    v[7] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    for q in (r.normal(size=dim), np.zeros(dim)):
        want = brute(q, v, name)
        got = df.select("id", metrics.metric(name).column(F.col("vector"), search.array_of(q), dim).alias("d")).orderBy("id").collect()
        assert np.allclose([x.d for x in got], want, atol=1e-9) and np.allclose(metrics.metric(name).kernel(q, v), want, atol=1e-9)


def test_metric_tells_directions_from_places(spark):
    df = spark.createDataFrame([(0, [10.0, 0.0]), (1, [0.9, 0.9])], "id long, vector array<float>")
    assert found(search.exact_search(df, [1.0, 0.0], 1, "cosine")) == [0]
    assert found(search.exact_search(df, [1.0, 0.0], 1, "euclidean")) == [1]


def test_own_metric(spark):
    own = metrics.register(metrics.Metric(2000, "chebyshev", lambda a, b, d: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))), lambda q, v: np.abs(v - q).max(axis=1)))
    t = VectorTable.create(spark.createDataFrame([(0, [3.0, 0.0]), (1, [2.0, 2.0])], "id long, vector array<float>"), own, id="id")
    assert found(t.search([0.0, 0.0], 1)) == [1]
    for bad in (metrics.Metric(5, "x", None, None), metrics.Metric(2000, "y", None, None), metrics.Metric(3000, "cosine", None, None)):
        with pytest.raises(errors.InvalidConfig):
            metrics.register(bad)
    with pytest.raises(errors.InvalidConfig):
        metrics.check_identity(2, metrics.COSINE)
    metrics.check_identity(0, metrics.COSINE)


def test_join_takes_queries_in_lots(spark, monkeypatch):
    v, q = uniform(spark, 300, 8, 1), uniform(spark, 50, 8, 2, "query_id")
    whole = {tuple(r) for r in search.knn_join(q, v, 7).collect()}
    monkeypatch.setattr(search, "QUERY_COMPONENTS", 8 * 13)
    assert {tuple(r) for r in search.knn_join(q, v.repartition(5), 7).collect()} == whole and len(whole) == 350


def test_normalizing_a_zero_vector_fails(spark):
    with pytest.raises(Exception, match="can't be normalized"):
        spark.sql("select array(0d, 0d) as v").select(normalize(F.col("v"))).collect()


def test_pairs(spark):
    rows = [(0, [1.0, 0.0], [0.0, 0.0, 1.0]), (1, [0.0, 1.0], [0.0, 1.0, 0.0]), (2, [0.7, 0.7], [1.0, 0.0, 0.0])]
    p = PairedTable.create(spark.createDataFrame(rows, "id long, a array<float>, b array<float>"), "a", "b", "euclidean", "cosine")
    assert found(p.search_by_a([0.9, 0.1], 1)) == [0] and found(p.search_by_b([0.1, 0.9, 0.0], 1)) == [1]
    assert p.search_by_a([0.9, 0.1], 1).first().emb_b == [0.0, 0.0, 1.0]
    gone, _ = p.remove(ids(spark, [0]))
    assert found(gone.search_by_a([0.9, 0.1], 3)) == [2, 1] and found(gone.search_by_b([0.0, 0.0, 1.0], 3)) == [1, 2]
    new, names = gone.compacted()
    assert new.a.len() == 2 and {tuple(r) for r in names.collect()} == {(0, 1), (1, 2)}
    grown = gone.insert(spark.sql("select 1L as o, array(0.95f, 0f) as emb_a, array(1f, 1f, 1f) as emb_b"), "o")
    assert found(grown.search_by_a([0.9, 0.1], 1)) == [3]
    apart = PairedTable(p.a.remove(ids(spark, [1]))[0], p.b)
    with pytest.raises(errors.DesynchronizedPair):
        apart.compacted()
    path = scratch_path(spark, "pair")
    snapshot.save_pair(p, path)
    assert found(snapshot.load_pair(spark, path, "euclidean", "cosine").search_by_b([0.1, 0.9, 0.0], 1)) == [1]
    with pytest.raises(errors.InvalidConfig):
        snapshot.load_pair(spark, path, "cosine", "cosine")
    with pytest.raises(errors.InvalidConfig):
        snapshot.save_pair(gone, path + "x")


# graphs


def recalls(g, e, q, k, ef, **options):
    exact = search.knn_join(q, e, k, g.metric)
    return evaluate.recall_at_k(g.search(q, k, ef, **options), exact, k).agg(F.avg("recall")).first()[0]


@pytest.fixture(scope="module")
def built(spark):
    e = uniform(spark, 1000, 32, 1).cache()
    t = VectorTable.create(e, id="id")
    path = scratch_path(spark, "graph")
    snapshot.save_graph(graph.build(t, IndexConfig(shards=2, ef_construction=100)), path)
    return path, t, e, uniform(spark, 60, 32, 2, "query_id")


def test_graph_recall_on_held_out_queries(spark, built):
    path, t, e, q = built
    g, _ = snapshot.load_graph(spark, path, "euclidean")
    assert recalls(g, e, q, 10, 100) >= 0.95
    assert recalls(g, e, q, 10, 1000) == 1.0
    some = g.search(q, 10, 1000, where="id % 7 = 0", payload=e.select("id"), counters=True)
    exact = search.knn_join(q, e, 10, where="id % 7 = 0")
    assert evaluate.recall_at_k(some, exact, 10).agg(F.min("recall")).first()[0] == 1.0
    assert some.agg(F.min("refused")).first()[0] > 0 and some.where("id % 7 <> 0").isEmpty()
    gone = g.remove(e.where("id % 2 = 0").select("id"))
    assert gone.search(q, 5, 50).where("id % 2 = 0").isEmpty()
    assert gone.restore(e.select("id")).search(q, 5, 50).where("id % 2 = 0").count() > 0


@pytest.mark.parametrize("change", [{"prune_strategy": "heuristic"}, {"use_heuristic": False}, {"extend_candidates": True}, {"keep_pruned": False}])
def test_graph_variants(spark, change):
    e, q = uniform(spark, 300, 16, 3), uniform(spark, 30, 16, 4, "query_id")
    g = graph.build(VectorTable.create(e, id="id"), IndexConfig(m=8, ef_construction=60, **change))
    g = graph.GraphIndex(g.nodes.cache(), g.dim, g.metric, g.config)
    assert recalls(g, e, q, 10, 100) >= 0.9
    assert not any(g.integrity().first())


def test_graph_is_reproducible_and_grows(spark, built):
    path, t, e, q = built
    g, _ = snapshot.load_graph(spark, path, "euclidean", mutable=True)
    half = graph.build(VectorTable.create(e.where("id < 900"), id="id"), g.config).insert(e.where("id >= 900"))
    assert half.nodes.select("id", "level", "links").exceptAll(g.nodes.select("id", "level", "links")).isEmpty()
    s = {r.layer: r for r in g.stats().collect()}
    assert s[0].nodes == 1000 and s[0].edges <= 1000 * 32
    compact = g.compact()
    assert "dists" not in compact.nodes.columns and compact.search(q, 3, 50).exceptAll(g.search(q, 3, 50)).isEmpty()
    with pytest.raises(errors.ReadOnly):
        compact.insert(e)
    with pytest.raises(errors.ZeroK):
        g.search(q, 0, 5)
    with pytest.raises(errors.DimensionMismatch):
        g.search(uniform(spark, 1, 3, 1, "query_id"), 1, 5)


def test_refused_rows_count_in_shards_without_hits(spark, built):
    """The condition holds in one shard only; rows of the other are met and refused, though it returns nothing."""
    path, t, e, q = built
    g, _ = snapshot.load_graph(spark, path, "euclidean")
    shard = F.crc32(F.col("id").cast("string").cast("binary")) % 2
    got = g.search(q, 5, 1000, where=shard == 0, payload=e.select("id"), counters=True)
    other = e.where(shard == 1).count()
    assert other > 0 and {r.refused for r in got.select("refused").distinct().collect()} == {other}


def shard_of(n, dim, seed, by="euclidean", **change):
    """A graph of n normal vectors, without Spark."""
    m = metrics.metric(by)
    g = graph.Graph(dim, m, IndexConfig(m=8, ef_construction=40, shards=1, **change))
    g.add(np.arange(n), np.random.default_rng(seed).normal(size=(n, dim)))
    return g, graph.scored(m, g.vectors, g.vectors)


@pytest.mark.parametrize("filtered", [False, True])
def test_beams_without_end_meet_all_nodes(filtered, monkeypatch):
    """Also those that no links lead to, without steps."""
    g, score = shard_of(300, 8, 1)
    base, ok = g.layers[0], np.arange(300) % 3 > 0 if filtered else None
    base.near[np.isin(base.near, np.arange(40, 90))] = -1
    q, some = np.arange(0, 300, 7), np.arange(300) if ok is None else np.flatnonzero(ok)
    monkeypatch.setattr(graph.Graph, "_beam", None)
    products = graph.Products.of(g.metric, g.vectors)
    for lists in (None, lambda who, k, rows: products.lists(g.vectors[q[who]], k, rows)):
        got = g.search(g.vectors[q], lambda who, to: score(q[who], to), 9, 300, ok, None, lists)
        for x, y, i in zip(got[0], got[1], q):
            d = score(np.full(len(some), i), some)
            order = np.lexsort((some, d))[:9]
            assert x.tolist() == some[order].tolist() and np.array_equal(y, d[order])
        assert got[2].tolist() == [300 - len(some)] * len(q)


def test_wide_beams_take_little_memory():
    g, score = shard_of(2000, 8, 2)
    products = graph.Products.of(g.metric, g.vectors)
    tracemalloc.start()
    got = g.search(g.vectors[:1000], score, 5, 2000, np.arange(2000) % 2 == 0, None, lambda who, k, rows: products.lists(g.vectors[who], k, rows))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x[0] for x in got[0][::2]] == list(range(0, 1000, 2)) and peak < 60e6


@pytest.mark.parametrize("by", ["euclidean", "sqeuclidean", "cosine", "dot", "manhattan"])
def test_candidates_are_the_nearest(by):
    """Also of vectors so far from the origin that products tell little, with copies."""
    g, _ = shard_of(10, 6, 3, by)
    v = 1e4 + np.random.default_rng(4).normal(size=(400, 6)) * 1e-5
    v[200:210] = v[100]
    g.vectors = v
    layer = graph.Layer.empty(4)
    layer.grow(400, np.arange(400))
    nodes, between = np.arange(350, 382), graph.pairs(g.metric)
    for node, (at, d) in zip(nodes, g._candidates(layer, nodes, graph.Products.of(g.metric, v))):
        true = between(v[np.full(node, node)], v[:node])
        order = np.lexsort((np.arange(node), true))[:40]
        assert at.tolist() == order.tolist() and np.allclose(d, true[order], rtol=0, atol=1e-12)


def test_own_metrics_get_many_rows_at_once():
    calls = []
    own = metrics.Metric(2001, "most", lambda a, b, d: a, lambda q, v: calls.append(len(v)) or np.abs(v - q).max(axis=1))
    g = graph.Graph(4, own, IndexConfig(m=8, ef_construction=40, shards=1, use_heuristic=False))
    v = np.random.default_rng(5).normal(size=(500, 4))
    g.add(np.arange(500), v)
    calls.clear()
    got = g.search(v[:20], graph.scored(own, v[:20], v), 3, 500)
    assert [x[0] for x in got[0]] == list(range(20)) and len(calls) < 20 * 12
    assert all(np.array_equal(x, np.lexsort((np.arange(500), np.abs(v - q).max(axis=1)))[:3]) for x, q in zip(got[0], v))


def test_codes_of_other_rows_are_refused(spark):
    e = uniform(spark, 200, 64, 5)
    c = quantize.Codec(64)
    g = graph.build(VectorTable.create(e, "cosine", id="id"), IndexConfig(m=8, ef_construction=60))
    q = spark.createDataFrame([(0, [1.0] * 64)], "query_id long, vector array<double>")
    rows = quantize.quantize(e, c)
    for odd in (rows.where("id % 2 = 0"), rows.unionByName(quantize.quantize(uniform(spark, 210, 64, 5).where("id >= 200"), c))):
        with pytest.raises(errors.IncompatibleIndex):
            g.search(q, 5, 50, codes=odd, codec=c)


def test_shards_by_rows(spark, monkeypatch):
    monkeypatch.setattr(graph, "SHARD_ROWS", 60)
    g = graph.build(VectorTable.create(uniform(spark, 250, 8, 1), id="id"), IndexConfig(m=8, ef_construction=40))
    assert g.config.shards == 5 and g.nodes.select("shard").distinct().count() == 5


def test_shards_have_tasks_of_their_own(spark):
    g = graph.build(VectorTable.create(uniform(spark, 400, 8, 1), id="id"), IndexConfig(m=8, ef_construction=40, shards=4))
    tasks = g.nodes.select("shard", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(tasks) == len({r.shard for r in tasks}) == len({r.task for r in tasks}) == 4


def test_products_take_half_the_memory():
    r = np.random.default_rng(3)
    v = r.normal(size=(20000, 16))
    products = graph.Products("euclidean", v)
    products.lists(v[:2], 10)
    tracemalloc.start()
    some = products.lists(v[:64], 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 * 20000 * 6
    for x, q in zip(some, v[:64]):
        d = ((v - q) ** 2).sum(axis=1)
        assert set(np.argsort(d)[:10]) <= set(x.tolist()) and len(x) < 80
    far = v[:3000] * 1e-4 + 1000  # single precision can't tell these apart
    d = ((far[:, None, :] - far[None, :20]) ** 2).sum(axis=2)
    products = graph.Products("euclidean", far)
    for i, x in enumerate(products.lists(far[:20], 10)):
        assert set(np.argsort(d[:, i])[:10]) <= set(x.tolist())


def test_growing_and_searching_builds_once(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def kernel(q, v):
        with open(calls, "a") as f:
            f.write(f"{len(v)}\n")
        return np.abs(v - q).max(axis=1, initial=0)

    def told():
        n = sum(map(int, open(calls)))
        open(calls, "w").close()
        return n

    own = metrics.Metric(4001, "chebyshev_told", metrics.metric("manhattan").column, kernel)
    e = uniform(spark, 240, 4, 2)
    path = scratch_path(spark, "graph")
    config = IndexConfig(m=4, ef_construction=20, shards=2)
    snapshot.save_graph(graph.build(VectorTable.create(e.where("id < 120"), own, id="id"), config), path)
    g = snapshot.load_graph(spark, path, own, mutable=True)[0].insert(e.where("id >= 120"))
    open(calls, "w").close()
    g.nodes.write.format("noop").mode("overwrite").save()
    once = told()
    q = e.where("id < 1").select(F.col("id").alias("query_id"), "vector")
    assert g.search(q, 3, 240).where("rank = 0").first().id == 0
    assert told() == once + 240


def count_of(df, what):
    """How often a plan has something."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(what)


def test_filters_leave_the_nodes_where_they_are(spark, built):
    path, t, e, q = built
    g = snapshot.load_graph(spark, path, "euclidean")[0].remove(e.where("id % 7 = 2").select("id"))
    payload = e.where("id % 5 <> 3").select("id", (F.col("id") % 4).alias("level"), (F.col("id") % 3).alias("vector"))
    told = g.search(q, 10, 1000, where="coalesce(level, 9) in (1, 9) and coalesce(vector, 0) < 2", payload=payload, counters=True)
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert not any("vector" in x and "Join" in x for x in plan.splitlines())  # no join has vectors
    left = [i for i in range(1000) if i % 7 != 2 and (i % 5 == 3 or (i % 4 == 1 and i % 3 < 2))]
    exact = search.knn_join(q, e.join(ids(spark, left), "id", "left_semi"), 10)
    assert told.select("query_id", "rank", "id").exceptAll(exact.select("query_id", "rank", "id")).isEmpty() and told.count() == exact.count()
    assert {r.refused for r in told.select("refused").distinct().collect()} == {1000 - len(left)}
    assert count_of(told, "Join LeftOuter") == 1  # of the counts with the results


def test_integrity_finds_damage_and_makes_no_row_of_each_link(spark, built):
    path, t, e, q = built
    g, _ = snapshot.load_graph(spark, path, "euclidean")
    assert not any(g.integrity().first())
    shorter = F.when(F.col("id") == 5, F.transform("dists", lambda x: F.slice(x, 1, 2))).otherwise(F.col("dists"))
    assert graph.GraphIndex(g.nodes.withColumn("dists", shorter), g.dim, g.metric, g.config).integrity().first().unknown_neighbours > 0
    g = g.compact()

    def told(change, where="id = 5"):
        nodes = g.nodes.withColumns({k: F.when(F.expr(where), F.expr(v)).otherwise(F.col(k)) for k, v in change.items()})
        return {k: v for k, v in graph.GraphIndex(nodes, g.dim, g.metric, g.config).integrity().first().asDict().items() if v}

    other = g.nodes.where(f"shard <> {g.nodes.where('id = 5').first().shard} and level = 0").first().id
    base = "transform(links, (x, i) -> case when i = 0 then {} else x end)"
    assert told({}) == {}
    assert told({"links": base.format("array(5L)")}) == {"loops": 1}
    assert told({"links": base.format(f"array({other}L, {other}L)")}) == {"across_shards": 2, "double_links": 1}
    assert told({"links": base.format("array(77777L, null)")}) == {"unknown_neighbours": 2}
    assert told({"links": base.format("transform(sequence(100000, 100099), y -> cast(y as long))")}) == {"unknown_neighbours": 100, "too_many_links": 1}
    assert told({"level": "level + 1"}) == {"wrong_levels": 1}
    assert told({"links": "concat(links, array(array(other)))".replace("other", f"{g.nodes.where('id <> 5 and level = 0 and shard = ' + str(g.nodes.where('id = 5').first().shard)).first().id}L")}) == {"above_level": 1, "wrong_levels": 1}
    assert count_of(g.integrity(), "Generate") == 0


@pytest.mark.parametrize("name", ["search_gates", "search_gates_spoiled"])
def test_gates_run_each_search_once(spark, sf, name):
    assert count_of(ranking_queries.QUERIES[name](spark, sf), "FlatMapGroupsInArrow") == 0


@pytest.mark.parametrize("name", ["search_gates", "search_gates_spoiled"])
def test_gates_get_shards_by_rows(spark, sf, name, monkeypatch):
    """A shard is held by one task, so it doesn't grow with the table; the gates are the same."""
    built, build = [], graph.build
    monkeypatch.setattr(graph, "SHARD_ROWS", 50)
    monkeypatch.setattr(graph, "build", lambda *a: built.append(build(*a)) or built[-1])
    row = ranking_queries.QUERIES[name](spark, sf).first()
    sizes = [r["count"] for r in built[0].nodes.groupBy("shard").count().collect()]
    assert sum(sizes) == 500 and max(sizes) < 100
    spoiled = name.endswith("spoiled")
    assert row.asDict() == {"all_results_complete": not spoiled, "accept_all_matches_dense": True, "no_excluded_emitted": not spoiled, "refused_observed": True, "passed": not spoiled}


def test_scorers_and_lots(spark, built, monkeypatch):
    """Any distance of query and ids; queries in several lots give what one lot gives."""
    path, t, e, q = built
    g, _ = snapshot.load_graph(spark, path, "euclidean")
    whole = sorted(map(tuple, g.search(q, 5, 60).collect()))
    monkeypatch.setattr(search, "QUERY_COMPONENTS", 32 * 7)
    assert sorted(map(tuple, g.search(q, 5, 60).collect())) == whole
    got = g.search(q.where("query_id = 3"), 4, 1000, scorer=lambda x, ids: abs(ids - 500.25) + 0 * x[0]).orderBy("rank").collect()
    assert [r.id for r in got] == [500, 501, 499, 502] and got[0].distance == 0.25


def test_provenance():
    told = {"model": "m", "revision": "r", "sha": "a" * 64}
    assert evaluate.provenance_gate(told, {"model": "m"}, ("sha",))
    assert not evaluate.provenance_gate(told, {"model": "n"}) and not evaluate.provenance_gate(told, {}, ("revision",)) and not evaluate.provenance_gate(told, {}, ("none",))


def test_graph_snapshot_finds_damage(spark, built):
    path, t, e, q = built
    g, _ = snapshot.load_graph(spark, path, "euclidean")
    with pytest.raises(errors.InvalidConfig):
        snapshot.load_graph(spark, path, "cosine")
    with pytest.raises(errors.InvalidConfig):
        snapshot.save_graph(g.remove(ids(spark, [1])), path + "x")
    other = scratch_path(spark, "graph")
    snapshot.save_graph(graph.GraphIndex(g.nodes.where("id <> 5"), g.dim, g.metric, g.config), other)
    with pytest.raises(errors.InvalidSnapshot, match="broken"):
        snapshot.load_graph(spark, other, "euclidean")
    third = scratch_path(spark, "graph")
    snapshot.save_graph(g.compact(), third, e.select("id", F.lit("x").alias("name")))
    with pytest.raises(errors.InvalidSnapshot):
        snapshot.load_graph(spark, third, "euclidean", mutable=True)
    assert snapshot.load_graph(spark, third, "euclidean")[1].count() == 1000


def test_snapshots(spark):
    t = VectorTable.create(uniform(spark, 50, 4, 1).withColumn("name", F.concat(F.lit("n"), F.col("id"))).withColumn("pair", F.struct("id", "name")), "dot", id="id")
    path = scratch_path(spark, "table")
    snapshot.save(t, path)
    got = snapshot.load(spark, path, "dot", verify=True)
    assert got.payload == ("name", "pair") and got.rows.exceptAll(t.rows).isEmpty()
    with pytest.raises(errors.InvalidConfig):
        snapshot.save(t.remove(ids(spark, [1]))[0], path + "x")
    with pytest.raises(errors.InvalidSnapshot):
        snapshot.load_pair(spark, path, "dot", "dot")
    with pytest.raises(errors.InvalidSnapshot):
        snapshot.load(spark, path + "y", "dot")
    for change in ({"version": 9}, {"n": 49}, {"dim": 5}, {"payload": ["none"]}, {"n": None}):
        m = {"kind": "vectors", "version": 1, "n": 50, "dim": 4, "metric": 4, "payload": ["name", "pair"]} | change
        snapshot._write_metadata(spark, path, m)
        with pytest.raises(errors.InvalidSnapshot):
            snapshot.load(spark, path, "dot", verify=True)
    empty = VectorTable.create(spark.createDataFrame([], "id long, vector array<float>"), id="id")
    snapshot.save(empty, path + "e")
    assert snapshot.load(spark, path + "e", "euclidean", verify=True).is_empty()


# codes


@pytest.mark.parametrize("bits, dim", list(itertools.product((2, 3, 4), (1, 8, 20, 64, 96))))
def test_codes(bits, dim):
    c = quantize.Codec(dim, bits)
    r = np.random.default_rng(dim)
    rot = c.rotation()
    assert np.allclose(rot @ rot.T, np.eye(dim)) and rot.shape == (dim, c.padded)
    v = r.normal(size=(30, dim))
    codes, scale = c.encode(v)
    assert (c.unpack(c.pack(codes)) == codes).all() and c.pack(codes).shape[1] == c.row_bytes
    if dim >= 64:
        own = [c.levels[codes[i]] @ c.prepare(v[i]).rotated * scale[i] for i in range(30)]
        assert min(own) > 0.75
    assert len(c.levels) == 1 << bits and (np.diff(c.levels) > 0).all()


def test_blocks():
    assert [quantize.block_size(d) for d in (512, 1024, 384, 100, 8, 20)] == [(512, 512), (512, 1024), (128, 384), (8, 104), (8, 8), (8, 24)]


def test_code_errors(spark):
    c = quantize.Codec(8)
    for call, kind in ((lambda: quantize.Codec(8, 5), errors.InvalidBits), (lambda: quantize.Codec(0), errors.InvalidConfig), (lambda: quantize.Codec(8, 4, "euclidean"), errors.InvalidConfig), (lambda: c.prepare([1.0]), errors.DimensionMismatch), (lambda: c.prepare([0.0] * 8), errors.InvalidVector), (lambda: c.prepare([float("nan")] * 8), errors.InvalidVector), (lambda: c.encode(np.zeros((1, 8))), errors.InvalidVector), (lambda: c.prepare([1.0] * 8).check(quantize.Codec(8, 3)), errors.IncompatibleQuery)):
        with pytest.raises(kind):
            call()
    assert quantize.Codec(8, 4, "dot").encode(np.zeros((1, 8)))[1][0] == 0


def test_quantized_search_overlaps_exact(spark):
    e = uniform(spark, 256, 64, 5).withColumn("vector", F.transform("vector", lambda x: x - 0.5)).cache()
    c = quantize.Codec(64)
    rows = quantize.quantize(e, c).cache()
    q = [float(x) for x in e.where("id = 3").first().vector]
    got, want = found(quantize.quantized_search(rows, c.prepare(q), 10, c)), found(search.exact_search(e, q, 10, "cosine"))
    assert len(set(got) & set(want)) >= 7 and got[0] == 3
    g = graph.build(VectorTable.create(e, "cosine", id="id"), IndexConfig(m=8, ef_construction=60))
    near = g.search(spark.createDataFrame([(0, q)], "query_id long, vector array<double>"), 10, 256, codes=rows, codec=c)
    assert found(near) == got
    with pytest.raises(errors.IncompatibleIndex):
        graph.build(VectorTable.create(e, id="id")).search(spark.createDataFrame([(0, q)], "query_id long, vector array<double>"), 1, 5, codes=rows, codec=c)
    path = scratch_path(spark, "codes")
    snapshot.save_codes(rows, c, path)
    assert snapshot.load_codes(spark, path, verify=True)[1] == c
    rows.where("id <> 4").unionByName(rows.where("id = 4").withColumn("codes", F.reverse("codes"))).write.mode("overwrite").parquet(f"{path}/rows")
    with pytest.raises(errors.InvalidSnapshot):
        snapshot.load_codes(spark, path, verify=True)


# rankings


def ranks(spark, lists):
    return spark.createDataFrame([(q, r, int(i)) for q, xs in lists.items() for r, i in enumerate(xs)], "query_id long, rank int, id long")


def test_recall(spark):
    exact = ranks(spark, {0: range(1, 11)})
    a, short = ranks(spark, {0: [1, 8, 2, 12, 13, 3, 4, 5, 6, 7]}), ranks(spark, {0: [1, 2]})
    assert [evaluate.recall_at_k(a, exact, k).first().recall for k in (1, 5, 10)] == [1.0, 0.4, 0.8]
    assert evaluate.recall_at_k(short, exact, 10).first().recall == 0.2
    none = ranks(spark, {})
    assert evaluate.recall_at_k(short, none, 10).first().recall == 0.0
    lists = spark.sql("select array(1L, 8L) as f, array() as n").select(evaluate.list_recall(F.col("n"), F.col("n"), 3), evaluate.list_recall(F.col("f"), F.col("n"), 3)).first()
    assert tuple(lists) == (1.0, 0.0)


def test_counts_and_latencies(spark):
    c = evaluate.returned_counts(spark.createDataFrame([(x,) for x in (50, 7, 20, 50)], "n long"), 50).first()
    assert (c.min, c.p50, c.mean, c.max, c.short) == (7, 20, 31.75, 50, 2)
    s = evaluate.latency_summary(spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "us double")).first()
    assert (s.n, s.p50, s.p95, s.median) == (4, 3.0, 4.0, 3.0)


def test_shadow_sets_nest(spark):
    hits = spark.createDataFrame([(0, 0, "b"), (0, 1, "a"), (1, 0, "c"), (1, 1, "b")], "query_order long, rank int, file string")
    every = spark.createDataFrame([(x,) for x in "zyabc"], "file string")
    got = evaluate.shadow_sets(hits, every, (0, 2, 4)).collect()
    assert {(r.set_name, r.place, r.file) for r in got} == {("exclude_2", 0, "b"), ("exclude_2", 1, "c"), ("exclude_4", 0, "b"), ("exclude_4", 1, "c"), ("exclude_4", 2, "a"), ("exclude_4", 3, "y")}


def test_filtered_check(spark):
    out = ids(spark, [3])
    got = evaluate.filtered_check(ranks(spark, {0: [1, 2], 1: [1, 3], 2: [1, 1], 3: [99]}), out, 10).collect()
    assert {r.query_id: r.valid for r in got} == {0: True, 1: False, 2: False, 3: False}


def test_saturation_equals_the_greedy_loop(spark):
    r = random.Random(4)
    rows = [(q, i, r.randint(0, 4), i, r.choice([0.0, 0.25, 0.5, 0.5, 1.0])) for q in range(20) for i in range(r.randint(1, 25))]
    got = rank.file_saturation(spark.createDataFrame(rows, "query_id long, id long, file int, candidate_order int, score double")).collect()
    for q in range(20):
        left, taken, want = [x for x in rows if x[0] == q], {}, []
        while left and len(want) < 10:
            best = min(left, key=lambda x: (-x[4] * 0.5 ** taken.get(x[2], 0), x[3]))
            want.append(best[4] * 0.5 ** taken.get(best[2], 0))
            taken[best[2]] = taken.get(best[2], 0) + 1
            left.remove(best)
        assert [x.score for x in sorted((g for g in got if g.query_id == q), key=lambda x: x.rank)] == want


def test_gates(spark):
    m = spark.sql("select 1 as ef, 0.9 as recall union all select 2, 0.99")
    g = evaluate.gates(m, {"a": "recall > 0.5", "b": "recall > 0.95"}).first()
    assert (g.a, g.b, g.passed) == (True, False, False)


# files


def test_fvecs(spark, tmp_path):
    v = uniform(spark, 20, 5, 1)
    path = str(tmp_path / "a.fvecs")
    files.write_fvecs(v, path)
    got = {r.row: r.vector for r in files.read_fvecs(spark, path).collect()}
    assert got == {r.id: r.vector for r in v.collect()}
    assert files.read_fvecs(spark, path, 3).count() == 3 and files.fvecs_rows(spark, path, [7]).first().vector == got[7]
    assert [r.row for r in files.fvecs_rows(spark, path, [2, 0, 10_000]).collect()] == [0, 2]
    for name, data in {"dim": np.array([-1, 0], "<i4").tobytes(), "cut": np.array([2, 0], "<i4").tobytes(), "mixed": np.array([1, 0, 2, 0], "<i4").tobytes(), "nan": np.array([1], "<i4").tobytes() + np.array([np.nan], "<f4").tobytes()}.items():
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception):
            files.read_fvecs(spark, str(tmp_path / name)).collect()


def test_matrices(spark, tmp_path):
    v, path = uniform(spark, 20, 5, 2), str(tmp_path / "a.f32")
    m = files.write_matrix(v, path)
    assert (m["rows"], m["columns"], m["bytes"]) == (20, 5, 400)
    assert {r.row: r.vector for r in files.read_matrix(spark, path, 20, 5, m["sha256"]).collect()} == {r.id: r.vector for r in v.collect()}
    assert files.checksums(spark, path).first().sha256 == m["sha256"]
    for args in ((20, 4, None), (20, 5, "0" * 64)):
        with pytest.raises(Exception):
            files.read_matrix(spark, path, *args).collect()


def test_query_files_and_receipts(spark, tmp_path):
    q = tmp_path / "q.json"
    q.write_text(json.dumps([{"id": "y01", "kind": "nl", "query": "what", "targets": ["a.py"]}]))
    assert reports.read_queries(spark, str(q)).first().targets == ["a.py"]
    q.write_text(json.dumps([{"id": "y01", "kind": "other", "query": "what", "targets": []}]))
    with pytest.raises(errors.InvalidSnapshot):
        reports.read_queries(spark, str(q))
    reports.write_receipt(spark, {"passed": True, "list": [1]}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"passed": True, "list": [1]} and "| passed | True |" in (tmp_path / "r.md").read_text()


def test_fixture_checks(spark, tmp_path):
    chunk = {"index": 0, "id": "c", "file_path": "a.py", "start_line": 1, "end_line": 2, "language": "py", "content_sha256": "", "file_sha256": "", "path_penalty": 1.0}
    hits = [{"chunk_index": 0, "score": 0.5}]
    q = {"id": "q", "kind": "nl", "text": "t", "targets": ["a.py"], "query_vector_row": 0, "alpha": 0.5, "exact_dense": hits, "bm25": hits, "hybrid_control": hits, "filtered_exact": {"0": hits}, "control_candidate_order": [0], "query_boost_existing": [], "query_boost_injected": [], "timings_us": {"x": 1.0}}
    p = tmp_path / "f.json"
    p.write_text(json.dumps({"chunks": [chunk], "queries": [q]}))
    assert not any(reports.check_fixture(*reports.read_fixture(spark, str(p))).first())
    p.write_text(json.dumps({"chunks": [chunk | {"index": 4}], "queries": [q, q | {"alpha": 2.0}]}))
    assert sum(map(bool, reports.check_fixture(*reports.read_fixture(spark, str(p))).first())) >= 3


def test_streams(spark, tmp_path):
    v = uniform(spark, 30, 3, 1)
    v.where("id < 20").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(v.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.append_stream(stream, str(tmp_path / "out"), 3, str(tmp_path / "check"), availableNow=True).awaitTermination()
        v.where("id >= 15").withColumn("vector", F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float"), F.lit(3.0).cast("float"))).write.mode("append").parquet(str(tmp_path / "in"))
    got = {r.id: r.vector for r in ingest.appended(spark, str(tmp_path / "out")).collect()}
    assert len(got) == 30 and got[17] == [1.0, 2.0, 3.0] and got[3] == v.where("id = 3").first().vector
    near = ingest.standing_radius(stream, [1.0, 2.0, 3.0], 0.1)
    assert near.isStreaming


# plans


def test_filters_and_columns_reach_the_scan(spark, sf):
    e = search_queries.embeddings(spark, sf)
    plan = search.exact_search(e.drop("label"), search_queries.first_vector(e), 5, where="id > 10")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(vec_id), GreaterThan(vec_id,10)]" in plan and "TakeOrderedAndProject" in plan and "label" not in plan.split("ReadSchema")[-1]
    join = search.knn_join(search_queries.batch(e), e, 5, where="label = 3")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in join and "EqualTo(label,3)" in join and "CartesianProduct" not in join and "BroadcastNestedLoopJoin" not in join


@pytest.mark.parametrize("name", ["knn_join_euclidean", "exact_search_cosine", "labeled_search_filtered", "compacted_map", "quant_topk", "hybrid", "recall_at_k", "latency_summary", "snapshot_roundtrip"])
def test_queries_equal_their_sql(spark, sf, name):
    import duckdb

    q, s = search_queries.QUERIES | ranking_queries.QUERIES, search_queries.SQL | ranking_queries.SQL
    c = duckdb.connect()
    for t in ("embeddings", "documents", "events"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = q[name](spark, sf)
    columns = sorted(got.columns)
    want = c.sql(s[name]).df()
    assert columns == sorted(want.columns)
    number = lambda v: float(v) if isinstance(v, (float, np.floating)) else v.item() if isinstance(v, np.generic) else v
    assert sorted(repr([number(r[x]) for x in columns]) for r in got.collect()) == sorted(repr([number(v) for v in r]) for r in want[columns].itertuples(index=False))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
