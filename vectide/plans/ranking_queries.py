"""Queries that evaluate and fuse rankings; with SQL that says the same."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate, graph, rank, search
from ..scratch import scratch_path
from ..sources import files, reports
from . import search_queries as base
from .search_queries import GRAPH, K, _E, batch, distance_sql, embeddings, held_out, index

QUERIES: dict = {}
SQL: dict[str, str] = {}
WIDE = 50
DIGITS = 9


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def ranking(spark, sf_dir, by: str, k: int = K, where: str | None = None) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return search.knn_join(batch(e), e, k, by, where)


def _ranking_sql(name: str, by: str, k: int = K, where: str = "true") -> str:
    """Two CTEs: name holds (query_id, rank, id, distance)."""
    return f"{name}_d AS (SELECT q.id AS query_id, e.id, {distance_sql(by, 'q.v', 'e.v')} AS distance FROM e AS q, e WHERE q.id % 100 = 0 AND ({where})), {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) - 1 AS rank FROM {name}_d) WHERE rank < {k})"


_TWO = f"WITH e AS ({_E}), {_ranking_sql('f', 'manhattan')}, {_ranking_sql('x', 'euclidean')}"
_HITS = "h AS (SELECT x.query_id, count(*) AS n_exact, count(f.id) AS hits FROM x LEFT JOIN f USING (query_id, id) GROUP BY 1)"


@query("recall_at_k", f"{_TWO}, {_HITS} SELECT query_id, round(hits / n_exact, {DIGITS}) AS recall FROM h")
def recall_at_k(spark, sf_dir):
    got = evaluate.recall_at_k(ranking(spark, sf_dir, "manhattan"), ranking(spark, sf_dir, "euclidean"), K)
    return got.withColumn("recall", F.round("recall", DIGITS))


@query("recall_of_lists", f"{_TWO}, {_HITS} SELECT query_id, round(hits / n_exact, {DIGITS}) AS recall FROM h")
def recall_of_lists(spark, sf_dir):
    ids = lambda by, name: ranking(spark, sf_dir, by).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias(name))
    both = ids("manhattan", "found").join(ids("euclidean", "exact"), "query_id")
    return both.select("query_id", F.round(evaluate.list_recall(F.col("found"), F.col("exact"), K), DIGITS).alias("recall"))


@query("mean_recall", f"{_TWO} SELECT round(count(*) / (10.0 * (SELECT count(*) FROM e WHERE id % 100 = 0)), {DIGITS}) AS recall FROM f JOIN x USING (query_id, id)")
def mean_recall(spark, sf_dir):
    n = batch(embeddings(spark, sf_dir)).count()
    got = evaluate.mean_recall(ranking(spark, sf_dir, "manhattan"), ranking(spark, sf_dir, "euclidean"), n, K)
    return got.withColumn("recall", F.round("recall", DIGITS))


def _targets(e: DataFrame) -> DataFrame:
    return batch(e).select("query_id", F.explode(F.array((F.col("query_id") / 100 % 10).cast("int"), ((F.col("query_id") / 100 + 3) % 10).cast("int"))).alias("target"))


@query(
    "target_metrics",
    f"WITH e AS ({_E}), {_ranking_sql('x', 'cosine')}, t AS (SELECT id AS query_id, unnest([id // 100 % 10, (id // 100 + 3) % 10]) AS target FROM e WHERE id % 100 = 0), "
    "h AS (SELECT x.query_id, count(DISTINCT e.label) AS n, min(x.rank) AS first FROM x JOIN e ON e.id = x.id JOIN t ON t.query_id = x.query_id AND t.target = e.label GROUP BY 1), w AS (SELECT query_id, count(DISTINCT target) AS m FROM t GROUP BY 1) "
    f"SELECT w.query_id, round(coalesce(n, 0) / m, {DIGITS}) AS target_recall, round(coalesce(1.0::DOUBLE / (first + 1), 0), {DIGITS}) AS reciprocal_rank FROM w LEFT JOIN h USING (query_id)",
)
def target_metrics(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    got = evaluate.target_metrics(ranking(spark, sf_dir, "cosine"), e.select("id", F.col("label").alias("file")), _targets(e), K)
    return got.select("query_id", F.round("target_recall", DIGITS).alias("target_recall"), F.round("reciprocal_rank", DIGITS).alias("reciprocal_rank"))


@query(
    "control_agreement",
    f"{_TWO}, {_HITS}, t AS (SELECT f.query_id, f.rank AS place FROM f JOIN x ON x.query_id = f.query_id AND x.id = f.id AND x.rank = 0) "
    f"SELECT h.query_id, round(hits / n_exact, {DIGITS}) AS recall, round(coalesce(1.0::DOUBLE / (place + 1), 0), {DIGITS}) AS top1_reciprocal_rank FROM h LEFT JOIN t USING (query_id)",
)
def control_agreement(spark, sf_dir):
    got = evaluate.control_agreement(ranking(spark, sf_dir, "manhattan"), ranking(spark, sf_dir, "euclidean"), K)
    return got.select("query_id", F.round("recall", DIGITS).alias("recall"), F.round("top1_reciprocal_rank", DIGITS).alias("top1_reciprocal_rank"))


@query(
    "returned_counts",
    f"WITH e AS ({_E}), {_ranking_sql('x', 'euclidean', WIDE)}, n AS (SELECT x.query_id, count(*) FILTER (e.label < 8) AS n FROM x JOIN e ON e.id = x.id GROUP BY 1), l AS (SELECT list_sort(list(n)) AS l FROM n) "
    "SELECT l[1] AS min, l[(len(l) - 1) // 2 + 1] AS p50, round(list_avg(l), 6) AS mean, l[-1] AS max, CAST(len([x for x in l if x < 42]) AS BIGINT) AS short FROM l",
)
def returned_counts(spark, sf_dir):
    n = ranking(spark, sf_dir, "euclidean", WIDE).join(embeddings(spark, sf_dir).select("id", "label"), "id").groupBy("query_id").agg(F.count_if(F.col("label") < 8).alias("n"))
    return evaluate.returned_counts(n, 42).withColumn("mean", F.round("mean", 6))


@query(
    "latency_summary",
    "WITH l AS (SELECT event_type, list_sort(list(value)) AS l FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, len(l) AS n, l[CAST(ceil((len(l) - 1) * 0.5) AS BIGINT) + 1] AS p50, l[CAST(ceil((len(l) - 1) * 0.95) AS BIGINT) + 1] AS p95, l[len(l) // 2 + 1] AS median FROM l",
)
def latency_summary(spark, sf_dir):
    return evaluate.latency_summary(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", ["event_type"])


@query(
    "filtered_check",
    f"WITH e AS ({_E}), {_ranking_sql('x', 'euclidean')} SELECT q.id AS query_id, count(x.id) > 0 AND count(*) FILTER (e.label = 3) = 0 AS valid FROM e AS q LEFT JOIN x ON x.query_id = q.id AND q.id % 300 <> 0 LEFT JOIN e ON e.id = x.id WHERE q.id % 100 = 0 GROUP BY 1",
)
def filtered_check(spark, sf_dir):
    """Unfiltered rankings, of which some return excluded rows and some are missing."""
    e = embeddings(spark, sf_dir)
    found = ranking(spark, sf_dir, "euclidean").where("query_id % 300 <> 0")
    return evaluate.filtered_check(found, e.where("label = 3").select("id"), e.count(), batch(e))


@query(
    "shadow_sets",
    f"WITH e AS ({_E}), {_ranking_sql('x', 'euclidean')}, f AS (SELECT id % 97 AS file, min((rank, query_id)) AS f FROM x GROUP BY 1), a AS (SELECT DISTINCT id % 97 AS file FROM e), "
    "o AS (SELECT a.file, row_number() OVER (ORDER BY f.f IS NULL, f.f, a.file) - 1 AS place FROM a LEFT JOIN f USING (file)) "
    "SELECT 'exclude_' || s AS set_name, CAST(place AS INTEGER) AS place, file FROM o, (SELECT unnest([0, 10, 50]) AS s) WHERE place < s",
)
def shadow_sets(spark, sf_dir):
    hits = ranking(spark, sf_dir, "euclidean").select(F.col("query_id").alias("query_order"), "rank", (F.col("id") % 97).alias("file"))
    return evaluate.shadow_sets(hits, embeddings(spark, sf_dir).select((F.col("id") % 97).alias("file")))


@query(
    "parity",
    f"{_TWO}, j AS (SELECT query_id, rank, f.id AS a, x.id AS b, abs((1 - f.distance) - (1 - x.distance)) <= 5e-4 AS near FROM f FULL JOIN x USING (query_id, rank)) "
    "SELECT query_id, bool_and(a IS NOT DISTINCT FROM b) AS same_order, list_sort(list(a)) = list_sort(list(b)) AS same_set, bool_and(rank > 0 OR a IS NOT DISTINCT FROM b) AS same_top1, bool_and(coalesce(near, false)) AS within FROM j GROUP BY 1",
)
def parity(spark, sf_dir):
    """Rankings by two metrics against each other."""
    scored = lambda by: ranking(spark, sf_dir, by).withColumn("score", 1 - F.col("distance"))
    return evaluate.parity(scored("manhattan"), scored("euclidean"))


# fusion: dense by cosine, lexical stood in for by another ranking

_CHUNKS = "c AS (SELECT id, label AS file, id * 37 % 1009 AS start_line, 1 - (id % 4) / 10.0::DOUBLE AS penalty FROM e)"
_FUSION = (
    f"WITH e AS ({_E}), {_ranking_sql('d', 'cosine', WIDE)}, {_ranking_sql('l', 'manhattan', WIDE)}, {_CHUNKS}, "
    "u AS (SELECT query_id, id, 0.5::DOUBLE / (61 + rank) AS s FROM d UNION ALL SELECT query_id, id, 0.5::DOUBLE / (61 + rank) FROM l), rrf AS (SELECT query_id, id, sum(s) AS score FROM u GROUP BY ALL)"
)
_ORDERED = f"{_FUSION}, o AS (SELECT rrf.*, c.file, row_number() OVER (PARTITION BY rrf.query_id ORDER BY c.start_line, d.rank NULLS LAST, rrf.id) - 1 AS candidate_order FROM rrf JOIN c ON c.id = rrf.id LEFT JOIN d ON d.query_id = rrf.query_id AND d.id = rrf.id)"
_COHERENT = f"""{_ORDERED}, k0 AS (SELECT *, sum(score) OVER (PARTITION BY query_id, file) AS fs, row_number() OVER (PARTITION BY query_id, file ORDER BY score DESC, candidate_order) = 1 AS best, max(score) OVER (PARTITION BY query_id) AS ms FROM o),
k AS (SELECT query_id, id, file, candidate_order, score + CASE WHEN best THEN 0.2 * ms * fs / max(fs) OVER (PARTITION BY query_id) ELSE 0 END AS score FROM k0)"""
_BOOSTED = f"""{_COHERENT}, m AS (SELECT query_id, max(score) AS ms FROM k GROUP BY 1),
b AS (SELECT k.query_id, k.id, k.file, k.candidate_order, k.score + CASE WHEN k.id % 7 = 0 THEN 0.3 * m.ms ELSE 0 END AS score FROM k JOIN m USING (query_id)
  UNION ALL SELECT m.query_id, e.id, e.label, 1000 + e.id, 0.4 * m.ms FROM m JOIN e ON e.id IN (m.query_id + 1, m.query_id + 2) WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.query_id = m.query_id AND k.id = e.id))"""
_PENALISED = f"{_BOOSTED}, p AS (SELECT b.query_id, b.id, b.file, b.candidate_order, b.score * c.penalty AS score FROM b JOIN c USING (id))"


def _saturated(source: str) -> str:
    return (
        f", s AS (SELECT query_id, id, candidate_order, score * pow(0.5::DOUBLE, greatest(0, row_number() OVER (PARTITION BY query_id, file ORDER BY score DESC, candidate_order) - 1)) AS score FROM {source}), "
        f"z AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_order) - 1 AS INTEGER) AS rank FROM s) SELECT query_id, rank, id, round(score, {DIGITS}) AS score FROM z WHERE rank < 10"
    )


class Inputs:
    """What fusion needs, made from the embeddings."""

    def __init__(self, spark, sf_dir):
        e = embeddings(spark, sf_dir)
        self.dense = ranking(spark, sf_dir, "cosine", WIDE)
        self.lexical = ranking(spark, sf_dir, "manhattan", WIDE)
        self.chunks = e.select("id", F.col("label").alias("file"), (F.col("id") * 37 % 1009).alias("start_line"), (1 - F.col("id") % 4 / 10.0).alias("penalty"))
        q = batch(e).select("query_id")
        self.existing = rank.rrf(self.dense, self.lexical).where("id % 7 = 0").select("query_id", "id", F.lit(0.3).alias("coefficient"))
        injected = q.select("query_id", F.explode(F.array(F.col("query_id") + 1, F.col("query_id") + 2)).alias("id"))
        self.injected = injected.join(e.select("id", F.col("label").alias("file")), "id").withColumn("candidate_order", (F.col("id") + 1000).cast("int")).withColumn("coefficient", F.lit(0.4))

    def ordered(self) -> DataFrame:
        fused = rank.candidate_order(rank.rrf(self.dense, self.lexical), self.chunks, self.dense)
        return fused.join(self.chunks.select("id", "file"), "id").select("query_id", "id", "file", "candidate_order", "score")


def _told(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", DIGITS))


@query("rrf", f"{_FUSION} SELECT query_id, id, round(score, {DIGITS}) AS score FROM rrf")
def rrf(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return _told(rank.rrf(i.dense, i.lexical))


@query("candidate_order", f"{_ORDERED} SELECT query_id, id, CAST(candidate_order AS INTEGER) AS candidate_order FROM o")
def candidate_order(spark, sf_dir):
    return Inputs(spark, sf_dir).ordered().select("query_id", "id", "candidate_order")


@query("file_coherence", f"{_COHERENT} SELECT query_id, id, round(score, {DIGITS}) AS score FROM k")
def file_coherence(spark, sf_dir):
    return _told(rank.file_coherence(Inputs(spark, sf_dir).ordered())).select("query_id", "id", "score")


@query("query_boosts", f"{_BOOSTED} SELECT query_id, id, round(score, {DIGITS}) AS score FROM b")
def query_boosts(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return _told(rank.query_boosts(rank.file_coherence(i.ordered()), i.existing, i.injected)).select("query_id", "id", "score")


@query("path_penalty", f"{_ORDERED} SELECT o.query_id, o.id, round(o.score * c.penalty, {DIGITS}) AS score FROM o JOIN c USING (id)")
def path_penalty(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return _told(rank.path_penalty(i.ordered(), i.chunks)).select("query_id", "id", "score")


@query("file_saturation", _ORDERED + _saturated("o"))
def file_saturation(spark, sf_dir):
    return _told(rank.file_saturation(Inputs(spark, sf_dir).ordered()))


@query("hybrid", _PENALISED + _saturated("p"))
def hybrid(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return _told(rank.hybrid(i.dense, i.lexical, i.chunks, i.dense, i.existing, i.injected))


@query(
    "control_check",
    f"{_TWO} "
    "SELECT query_id, bool_and(coalesce(a = b AND abs(s - t) <= 1e-10, false)) AS matches FROM (SELECT x.query_id, x.rank, x.id AS a, x.id AS b, x.distance AS s, x.distance + CASE WHEN x.query_id % 200 = 0 THEN 1e-6 ELSE 0 END AS t FROM x WHERE x.query_id % 300 <> 0 UNION ALL SELECT f.query_id, f.rank, f.id, x.id, f.distance, x.distance FROM f JOIN x USING (query_id, rank) WHERE f.query_id % 300 = 0) GROUP BY 1",
)
def control_check(spark, sf_dir):
    """Rankings of which some have other ids, and some scores that are off by a millionth."""
    x, f = (ranking(spark, sf_dir, by).withColumn("score", F.col("distance")) for by in ("euclidean", "manhattan"))
    found = x.where("query_id % 300 <> 0").unionByName(f.where("query_id % 300 = 0"))
    off = F.when((F.col("query_id") % 200 == 0) & (F.col("query_id") % 300 != 0), 1e-6).otherwise(0.0)
    return rank.control_check(found, x.withColumn("score", F.col("score") + off))


def sweep(spark, sf_dir, beams=(10, 50, 100, 200, 400)) -> DataFrame:
    """(ef, recall, filtered_recall): mean recall of held-out queries, all rows and without one label."""
    g, e = index(spark, sf_dir)
    q = held_out(e)
    out = None
    labels = e.select("id", "label")
    exact, exact_f = search.knn_join(q, e, K), search.knn_join(q, e, K, where="label <> 3")
    for ef in beams:
        a = evaluate.recall_at_k(g.search(q, K, ef), exact, K).agg(F.avg("recall").alias("recall"))
        b = evaluate.recall_at_k(g.search(q, K, ef, where="label <> 3", payload=labels), exact_f, K).agg(F.avg("recall").alias("filtered_recall"))
        row = a.join(F.broadcast(b)).select(F.lit(ef).alias("ef"), "recall", "filtered_recall")
        out = row if out is None else out.unionByName(row)
    return out


@query("ef_sweep")
def ef_sweep(spark, sf_dir):
    return sweep(spark, sf_dir).select("ef", F.round("recall", 4).alias("recall"), F.round("filtered_recall", 4).alias("filtered_recall"))


@query("gates", "SELECT true AS recall_at_widest, true AS filtered_at_widest, true AS passed")
def gates(spark, sf_dir):
    measured = sweep(spark, sf_dir, (100, 400))
    return evaluate.gates(measured, {"recall_at_widest": "ef < 400 or recall >= 0.98", "filtered_at_widest": "ef < 400 or filtered_recall >= 0.98"})


def _kept(rows: DataFrame) -> DataFrame:
    """rows from the scratch folder, so that a search that several conditions look at runs once."""
    path = scratch_path(rows.sparkSession, "found")
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _evaluation(spark, sf_dir, spoiled: bool) -> DataFrame:
    """Gates of filtered searches of the graph; spoiled ones return an excluded row and lack a result.

    A task holds a whole shard, so a large table has more of them; the beam is as wide as the table, where any number of
    shards gives the exact answer.
    """
    n = embeddings(spark, sf_dir).count()
    g, e = index(spark, sf_dir, config=replace(GRAPH, shards=max(GRAPH.shards, -(-n // graph.SHARD_ROWS))))
    q, labels = batch(e), e.select("id", "label")
    sets = {"exclude_none": "true", "exclude_label": "label <> 3"}
    dense = _kept(g.search(q, K, n))
    got = [_kept(g.search(q, K, n, where=w, payload=labels, counters=True)).withColumn("set_name", F.lit(name)) for name, w in sets.items()]
    found = got[0].unionByName(got[1])
    excluded = e.where("label = 3").select(F.lit("exclude_label").alias("set_name"), "id").unionByName(spark.createDataFrame([("exclude_none", None)], "set_name string, id long"))
    if spoiled:
        bad = e.where("label = 3").agg(F.min("id")).first()[0]
        found = found.where("set_name <> 'exclude_label' or rank < 9 or query_id > 0").withColumn("id", F.when((F.col("set_name") == "exclude_label") & (F.col("rank") == 1), F.lit(bad)).otherwise(F.col("id")))
    return evaluate.search_gates(q, dense, found, excluded, found.select("set_name", "query_id", "refused").distinct(), K)


@query("search_gates", "SELECT true AS all_results_complete, true AS accept_all_matches_dense, true AS no_excluded_emitted, true AS refused_observed, true AS passed")
def search_gates(spark, sf_dir):
    return _evaluation(spark, sf_dir, False)


@query("search_gates_spoiled", "SELECT false AS all_results_complete, true AS accept_all_matches_dense, false AS no_excluded_emitted, true AS refused_observed, false AS passed")
def search_gates_spoiled(spark, sf_dir):
    return _evaluation(spark, sf_dir, True)


# files of evaluations


def _query_rows(spark, sf_dir) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return batch(e).select(F.concat(F.lit("y"), F.col("query_id").cast("string")).alias("id"), F.when(F.col("query_id") % 200 == 0, "nl").otherwise("sym").alias("kind"), F.concat(F.lit("find "), F.col("query_id").cast("string")).alias("query"), F.array((F.col("query_id") % 7).cast("string"), F.lit("x")).alias("targets"))


@query("query_file", f"WITH e AS ({_E}) SELECT 'y' || id AS id, CASE WHEN id % 200 = 0 THEN 'nl' ELSE 'sym' END AS kind, 'find ' || id AS query, unnest([(id % 7)::VARCHAR, 'x']) AS target FROM e WHERE id % 100 = 0")
def query_file(spark, sf_dir):
    """Queries written as a JSON array and read back."""
    path = scratch_path(spark, "queries") + "/queries.json"
    rows = [r.asDict() for r in _query_rows(spark, sf_dir).collect()]  # a query set is small
    files._put(spark, path, json.dumps(rows).encode())
    return reports.read_queries(spark, path).select("id", "kind", "query", F.explode("targets").alias("target"))


@query("receipt", f"WITH e AS ({_E}) SELECT count(*) AS n, 64::BIGINT AS dim, true AS table_there FROM e")
def receipt(spark, sf_dir):
    """A receipt of JSON and Markdown, read back."""
    e = embeddings(spark, sf_dir)
    path = scratch_path(spark, "receipt") + "/receipt.json"
    reports.write_receipt(spark, {"n": e.count(), "dim": 64, "gates": {"passed": True}}, path)
    there = spark.read.text(path.removesuffix(".json") + ".md").where("value like '| n |%'").count() == 1
    return spark.read.option("multiLine", True).json(path).select("n", "dim", F.lit(there).alias("table_there"))


@query("bench_rows", f"WITH e AS ({_E}) SELECT label, count(*) AS n FROM e GROUP BY 1 UNION ALL SELECT label + 1000, count(*) FROM e GROUP BY 1")
def bench_rows(spark, sf_dir):
    """Benchmark rows written as JSON lines and as CSV, and read back."""
    rows = embeddings(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    a, b = scratch_path(spark, "rows"), scratch_path(spark, "rows")
    reports.write_rows(rows, a)
    reports.write_rows(rows.withColumn("label", F.col("label") + 1000), b, "csv")
    kind = rows.schema["label"].dataType
    both = [spark.read.schema("label long, n long").json(a), spark.read.schema("label long, n long").option("header", True).csv(b)]
    return both[0].unionByName(both[1]).select(F.col("label").cast(kind).alias("label"), "n")


def _fixture(spark, sf_dir, spoiled: bool) -> DataFrame:
    """check_fixture() of a fixture made of the first 60 rows, written as JSON and read back."""
    e = embeddings(spark, sf_dir).where("id < 60")
    near = {r[0]: r[1] for r in search.knn_join(e.where("id < 6").select(F.col("id").alias("query_id"), "vector"), e, K, "cosine").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "distance")))).collect()}
    chunks = [{"index": i, "id": f"c{i}", "file_path": f"f{i % 20}", "start_line": i, "end_line": i + 3, "language": "text", "content_sha256": "0" * 64, "file_sha256": "1" * 64, "path_penalty": 1 - i % 4 / 10} for i in range(60)]
    queries = []
    for i, hits in sorted(near.items()):
        got = [{"chunk_index": h["id"], "score": 1 - h["distance"]} for h in hits]
        queries.append({"id": f"y{i:02}", "kind": "sym" if i % 2 else "nl", "text": f"find {i}", "targets": ["f1"], "query_vector_row": i, "alpha": 0.3 if i % 2 else 0.5, "exact_dense": got, "bm25": got[:4], "hybrid_control": got[:5], "filtered_exact": {"none": got}, "control_candidate_order": [h["chunk_index"] for h in got], "query_boost_existing": [{"chunk_index": 3, "coefficient": 0.5}], "query_boost_injected": [], "timings_us": {"dense": 1.5}})
    if spoiled:
        chunks[7]["end_line"] = 0
        queries[0] |= {"kind": "other", "text": "  "}
        queries[1] |= {"alpha": 0.4, "exact_dense": queries[1]["exact_dense"][::-1]}
        queries[2] |= {"hybrid_control": [], "query_boost_injected": [{"chunk_index": 99, "coefficient": 1.0}], "query_vector_row": 1}
    path = scratch_path(spark, "fixture") + "/fixture.json"
    files._put(spark, path, json.dumps({"chunks": chunks, "queries": queries}).encode())
    shadows = spark.createDataFrame([("none", [], [])], "name string, files array<string>, chunk_indices array<long>")
    return reports.check_fixture(*reports.read_fixture(spark, path), shadows, K, 5, {"nl": 0.5, "sym": 0.3})


_FAULTS = ("double_indexes", "gaps", "lines", "penalties", "unknown_chunks", "scores", "unsorted", "double_hits", "wrong_sizes", "double_ids", "kinds", "incomplete", "alphas", "vector_rows", "boosts", "shadow_members", "shadow_missing", "shadow_emitted")
_SPOILED = {"lines": 1, "unsorted": 1, "wrong_sizes": 1, "kinds": 1, "incomplete": 1, "alphas": 1, "vector_rows": 1, "boosts": 1}


@query("fixture", "SELECT " + ", ".join(f"0::BIGINT AS {x}" for x in _FAULTS))
def fixture(spark, sf_dir):
    return _fixture(spark, sf_dir, False)


@query("fixture_spoiled", "SELECT " + ", ".join(f"{_SPOILED.get(x, 0)}::BIGINT AS {x}" for x in _FAULTS))
def fixture_spoiled(spark, sf_dir):
    return _fixture(spark, sf_dir, True)


@query("content_identity", "WITH h AS (SELECT doc_id, sha256('doc_id:' || strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR || 'text:' || strlen(coalesce(text, '')) || ':' || coalesce(text, '')) AS h FROM documents), r AS (SELECT doc_id >> 12 AS r, sha256(string_agg(h, '' ORDER BY doc_id)) AS h FROM h GROUP BY 1) SELECT sha256(string_agg(h, '' ORDER BY r)) AS identity FROM r")
def content_identity(spark, sf_dir):
    return evaluate.content_identity(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id", "text"], "doc_id")


assert not set(QUERIES) & set(base.QUERIES)
