"""Queries over the embeddings table: distances, searches, changes, quantization, graphs, files; with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Builder, IndexConfig
from ..errors import IncompatibleIndex, InvalidConfig, InvalidSnapshot
from ..functions.metrics import Metric, metric, register
from ..functions.vectors import dot, mixture, norm, normalize
from ..operators import graph, quantize, search
from ..scratch import scratch_path
from ..sources import files, snapshot
from ..table import PairedTable, VectorTable

K = 10
DIGITS = 6
METRICS = ("sqeuclidean", "euclidean", "cosine", "dot", "manhattan")
GRAPH = IndexConfig(m=16, ef_construction=100, shards=4)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def embeddings(spark: SparkSession, sf_dir: str, scale: bool = False) -> DataFrame:
    """(id, vector, label); scaled by 1 + id mod 7, which tells the metrics apart."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    if scale:
        e = e.withColumn("vector", F.transform("vector", lambda x: x.cast("double") * (1 + F.col("id") % 7)))
    return e


def first_vector(e: DataFrame) -> list[float]:
    return [float(x) for x in e.where("id = 0").select("vector").first()[0]]


def batch(e: DataFrame) -> DataFrame:
    """The query set: every row whose id is divisible by 100."""
    return e.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")


def rounded(df: DataFrame, column: str = "distance") -> DataFrame:
    return df.withColumn(column, F.round(column, DIGITS) + 0.0)  # no negative zero


_E = "SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings"
_S = "SELECT vec_id AS id, [x * (1 + vec_id % 7) for x in embedding::DOUBLE[]] AS v, label FROM embeddings"


def distance_sql(name: str, a: str, b: str) -> str:
    return {
        "sqeuclidean": f"pow(list_distance({a}, {b}), 2)",
        "euclidean": f"list_distance({a}, {b})",
        "cosine": f"(CASE WHEN list_inner_product({a}, {a}) = 0 OR list_inner_product({b}, {b}) = 0 THEN 1 ELSE 1 - greatest(-1, least(1, list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b}))))) END)",
        "dot": f"(1 - list_inner_product({a}, {b}))",
        "manhattan": f"list_sum([abs(x[1] - x[2]) for x in list_zip({a}, {b})])",
    }[name]


def knn_sql(name: str, where: str = "true", k: int = K, source: str = _E, a: str = "q.v", b: str = "e.v") -> str:
    """(query_id, rank, id, distance) of the query set against a source."""
    return (
        f"WITH e AS ({source}), d AS (SELECT q.id AS query_id, e.id, {distance_sql(name, a, b)} AS distance FROM e AS q, e WHERE q.id % 100 = 0 AND ({where})), "
        f"r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) - 1 AS INTEGER) AS rank FROM d) SELECT query_id, rank, id, round(distance, {DIGITS}) + 0.0 AS distance FROM r WHERE rank < {k}"
    )


def one_sql(name: str, where: str = "true", k: int = K, source: str = _E, columns: str = "", a: str = "q.v", b: str = "e.v") -> str:
    """(rank, id, distance, ...) of row 0 against a source."""
    return (
        f"WITH e AS ({source}), d AS (SELECT e.*, {distance_sql(name, a, b)} AS distance FROM e AS q, e WHERE q.id = 0 AND ({where})), "
        f"r AS (SELECT *, CAST(row_number() OVER (ORDER BY distance, id) - 1 AS INTEGER) AS rank FROM d) SELECT rank, id, round(distance, {DIGITS}) + 0.0 AS distance{columns} FROM r WHERE rank < {k}"
    )


def _add_metrics() -> None:
    for name in METRICS:

        @query(f"dist_{name}", f"WITH e AS ({_S}) SELECT e.id, round({distance_sql(name, 'q.v', 'e.v')}, {DIGITS}) + 0.0 AS distance FROM e AS q, e WHERE q.id = 0")
        def distances(spark, sf_dir, name=name):
            e = embeddings(spark, sf_dir, True)
            q = first_vector(e)
            return rounded(e.select("id", metric(name).column(F.col("vector"), search.array_of(q), len(q)).alias("distance")))

        @query(f"exact_search_{name}", one_sql(name, source=_S))
        def nearest(spark, sf_dir, name=name):
            e = embeddings(spark, sf_dir, True)
            return rounded(search.exact_search(e, first_vector(e), K, name).select("rank", "id", "distance"))

        @query(f"knn_join_{name}", knn_sql(name, source=_S))
        def join(spark, sf_dir, name=name):
            e = embeddings(spark, sf_dir, True)
            return rounded(search.knn_join(batch(e), e, K, name))


_add_metrics()

_ZERO = "SELECT vec_id AS id, [CASE WHEN vec_id % 3 = 1 THEN 0 ELSE x END for x in embedding::DOUBLE[]] AS v, label FROM embeddings"


@query("dist_cosine_zero_norm", f"WITH e AS ({_ZERO}) SELECT e.id, round({distance_sql('cosine', 'q.v', 'e.v')}, {DIGITS}) + 0.0 AS distance FROM e AS q, e WHERE q.id = 0")
def dist_cosine_zero_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir).withColumn("vector", F.when(F.col("id") % 3 == 1, F.transform("vector", lambda x: x * 0)).otherwise(F.col("vector")))
    q = first_vector(e)
    return rounded(e.select("id", metric("cosine").column(F.col("vector"), search.array_of(q), len(q)).alias("distance")))


@query("knn_join_filtered_mod", knn_sql("euclidean", "e.id % 4 = 0"))
def knn_join_filtered_mod(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return rounded(search.knn_join(batch(e), e, K, where="id % 4 = 0"))


@query("knn_join_filtered_label", knn_sql("cosine", "e.label = 3"))
def knn_join_filtered_label(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return rounded(search.knn_join(batch(e), e, K, "cosine", where="label = 3"))


@query("radius_search", f"WITH e AS ({_E}) SELECT e.id, round(list_distance(q.v, e.v), {DIGITS}) AS distance FROM e AS q, e WHERE q.id = 0 AND list_distance(q.v, e.v) <= 1.3")
def radius_search(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return rounded(search.radius_search(e, first_vector(e), 1.3)).select("id", "distance")


@query("labeled_search", one_sql("euclidean", columns=", label"))
def labeled_search(spark, sf_dir):
    t = VectorTable.create(embeddings(spark, sf_dir), id="id")
    return rounded(t.search(first_vector(t.rows), K)).drop("vector")


@query("labeled_search_filtered", one_sql("euclidean", "e.label IN (1, 4) AND e.id % 2 = 0", columns=", label"))
def labeled_search_filtered(spark, sf_dir):
    t = VectorTable.create(embeddings(spark, sf_dir), id="id")
    return rounded(t.search(first_vector(t.rows), K, "label in (1, 4) and id % 2 = 0")).drop("vector")


def _pair(spark, sf_dir) -> PairedTable:
    e = embeddings(spark, sf_dir)
    return PairedTable.create(e.select("id", F.slice("vector", 1, 24).alias("a"), F.slice("vector", 25, 40).alias("b")), "a", "b", "euclidean", "cosine")


_OTHER = f", round(list_sum({{}}), {DIGITS}) AS other_sum"


@query("paired_by_a", one_sql("euclidean", a="q.v[1:24]", b="e.v[1:24]", columns=_OTHER.format("v[25:64]")))
def paired_by_a(spark, sf_dir):
    p = _pair(spark, sf_dir)
    got = p.search_by_a(first_vector(p.a.rows), K)
    return rounded(got).select("rank", "id", "distance", F.round(F.aggregate("emb_b", F.lit(0.0), lambda s, x: s + x.cast("double")), DIGITS).alias("other_sum"))


@query("paired_by_b", one_sql("cosine", a="q.v[25:64]", b="e.v[25:64]", columns=_OTHER.format("v[1:24]")))
def paired_by_b(spark, sf_dir):
    p = _pair(spark, sf_dir)
    got = p.search_by_b(first_vector(p.b.rows), K)
    return rounded(got).select("rank", "id", "distance", F.round(F.aggregate("emb_a", F.lit(0.0), lambda s, x: s + x.cast("double")), DIGITS).alias("other_sum"))


def _some_removed(spark, sf_dir) -> VectorTable:
    t = VectorTable.create(embeddings(spark, sf_dir), id="id")
    return t.remove(t.rows.where("id % 5 = 1 or label = 2").select("id"))[0]


_GONE = "(e.id % 5 = 1 OR e.label = 2)"


@query("remove_search", knn_sql("euclidean", f"NOT {_GONE}"))
def remove_search(spark, sf_dir):
    t = _some_removed(spark, sf_dir)
    return rounded(t.knn_join(batch(t.rows), K))


@query("restore_search", knn_sql("euclidean", f"NOT {_GONE} OR e.id % 10 = 1"))
def restore_search(spark, sf_dir):
    t = _some_removed(spark, sf_dir)
    t = t.restore(t.rows.where("id % 10 = 1").select("id"))[0]
    return rounded(t.knn_join(batch(t.rows), K))


@query("remove_with_filter", knn_sql("euclidean", f"NOT {_GONE} AND e.id % 3 = 0"))
def remove_with_filter(spark, sf_dir):
    t = _some_removed(spark, sf_dir)
    return rounded(t.knn_join(batch(t.rows), K, "id % 3 = 0"))


@query("remove_changes", "SELECT vec_id AS id, NOT (vec_id % 5 = 1 OR label = 2) AS changed FROM embeddings WHERE vec_id % 2 = 0")
def remove_changes(spark, sf_dir):
    t = _some_removed(spark, sf_dir)
    return t.remove(t.rows.where("id % 2 = 0").select("id"))[1]


@query("compacted_map", f"SELECT row_number() OVER (ORDER BY e.id) - 1 AS new_id, e.id AS old_id FROM ({_E}) AS e WHERE NOT {_GONE}")
def compacted_map(spark, sf_dir):
    return _some_removed(spark, sf_dir).compacted()[1].withColumn("new_id", F.col("new_id").cast("long"))


@query("compacted_search", one_sql("euclidean", source=f"SELECT row_number() OVER (ORDER BY e.id) - 1 AS id, e.v, e.label FROM ({_E}) AS e WHERE NOT {_GONE}", columns=", label"))
def compacted_search(spark, sf_dir):
    t = _some_removed(spark, sf_dir).compacted()[0]
    return rounded(t.search(first_vector(t.rows), K)).drop("vector")


_APPENDED = f"{_E} UNION ALL SELECT (SELECT max(vec_id) FROM embeddings) + row_number() OVER (ORDER BY vec_id), [-x for x in embedding::DOUBLE[]], label FROM embeddings WHERE label = 1"


@query("insert_search", one_sql("dot", source=_APPENDED, a="[-x for x in q.v]", columns=", label"))
def insert_search(spark, sf_dir):
    t = VectorTable.create(embeddings(spark, sf_dir), "dot", id="id")
    new = t.rows.where("label = 1").select(F.col("id").alias("o"), F.transform("vector", lambda x: -x).alias("vector"), "label")
    return rounded(t.insert(new, "o").search([-x for x in first_vector(t.rows)], K)).drop("vector")


@query("point_lookup", f"SELECT vec_id AS id, label, round(list_sum(embedding::DOUBLE[]), {DIGITS}) AS total FROM embeddings WHERE vec_id = 42")
def point_lookup(spark, sf_dir):
    row = VectorTable.create(embeddings(spark, sf_dir), id="id").get(42)
    return row.select("id", "label", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), DIGITS).alias("total"))


@query("introspection", "SELECT count(*) AS n, count(*) FILTER (vec_id % 5 = 1 OR label = 2) AS deleted, count(*) FILTER (NOT (vec_id % 5 = 1 OR label = 2)) AS live, CAST(max(len(embedding)) AS INTEGER) AS dim, 'euclidean' AS metric FROM embeddings")
def introspection(spark, sf_dir):
    return _some_removed(spark, sf_dir).introspect()


@query("normalize", f"WITH e AS ({_S}) SELECT id, round(sqrt(list_inner_product(v, v)), {DIGITS}) AS before, round(list_sum(v) / sqrt(list_inner_product(v, v)), {DIGITS}) AS total, 1.0::DOUBLE AS after FROM e")
def normalized(spark, sf_dir):
    e = embeddings(spark, sf_dir, True).withColumn("unit", normalize(F.col("vector"), 64))
    return e.select("id", F.round(norm(F.col("vector"), 64), DIGITS).alias("before"), F.round(F.aggregate("unit", F.lit(0.0), lambda s, x: s + x), DIGITS).alias("total"), F.round(norm(F.col("unit"), 64), DIGITS).alias("after"))


def mixtures(e: DataFrame, n: int) -> DataFrame:
    """(query_id, vector): for each row i 0.85 of row 7919 i mod n and 0.15 of another, normalized."""
    i = e.select(F.col("id").alias("query_id")).withColumn("t", F.col("query_id") * 7919 % n)
    i = i.withColumn("o", (F.col("t") + n // 2 + F.col("query_id") + 1) % n)
    a, b = e.select(F.col("id").alias("t"), F.col("vector").alias("va")), e.select(F.col("id").alias("o"), F.col("vector").alias("vb"))
    return i.join(a, "t").join(b, "o").select("query_id", mixture(F.col("va"), F.col("vb")).alias("vector"))


_MIX = (
    f"e AS ({_E}), n AS (SELECT count(*) AS n FROM embeddings), i AS (SELECT id AS query_id, (id * 7919) % n AS t, ((id * 7919) % n + n // 2 + id + 1) % n AS o FROM e, n), "
    "m AS (SELECT i.query_id, [x[1] * 0.85 + x[2] * 0.15 for x in list_zip(a.v, b.v)] AS v FROM i JOIN e AS a ON a.id = i.t JOIN e AS b ON b.id = i.o), "
    "q AS (SELECT query_id, [x / sqrt(list_inner_product(v, v)) for x in v] AS v FROM m)"
)


@query("perturbed_queries", f"WITH {_MIX} SELECT query_id, round(list_sum(v), {DIGITS}) AS total, round(v[1], {DIGITS}) AS first FROM q")
def perturbed_queries(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    q = mixtures(e, e.count())
    return q.select("query_id", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), DIGITS).alias("total"), F.round(F.get("vector", F.lit(0)), DIGITS).alias("first"))


def held_out(e: DataFrame) -> DataFrame:
    """Mixtures for the query set, which aren't rows of the table."""
    return mixtures(e, e.count()).where("query_id % 100 = 0")


_HELD = f"WITH {_MIX}, d AS (SELECT q.query_id, e.id, {{}} AS distance FROM q, e WHERE q.query_id % 100 = 0 AND ({{}})), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) - 1 AS INTEGER) AS rank FROM d) SELECT query_id, rank, id, round(distance, {DIGITS}) + 0.0 AS distance FROM r WHERE rank < {K}"


@query("knn_join_held_out", _HELD.format("list_distance(q.v, e.v)", "true"))
def knn_join_held_out(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return rounded(search.knn_join(held_out(e), e, K))


# codes

CODEC = quantize.Codec(64, 4, "cosine")
_ROT = "[" + ", ".join("[" + ", ".join(f"{x:.17g}" for x in col) + "]" for col in CODEC.rotation().T) + "]::DOUBLE[][]"
_BOUNDS = "[" + ", ".join(f"{x:.17g}" for x in CODEC.boundaries) + "]::DOUBLE[]"
_LEVELS = "[" + ", ".join(f"{x:.17g}" for x in CODEC.levels) + "]::DOUBLE[]"
_CODES = (
    f"WITH k AS (SELECT {_ROT} AS rot, {_BOUNDS} AS bounds, {_LEVELS} AS levels), e AS (SELECT vec_id AS id, [x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) for x in embedding::DOUBLE[]] AS v FROM embeddings), "
    "t AS (SELECT id, [list_inner_product(r, v) for r in rot] AS y, bounds, levels FROM e, k), "
    "c AS (SELECT id, y, levels, [len([b for b in bounds if b < x]) for x in y] AS codes FROM t), "
    "s AS (SELECT id, y, codes, [levels[i + 1] for i in codes] AS stood FROM c), "
    "w AS (SELECT id, y, codes, stood, CAST(1 / sqrt(list_inner_product(stood, stood)) AS FLOAT) AS scale FROM s)"
)


def codes(spark, sf_dir) -> DataFrame:
    return quantize.quantize(embeddings(spark, sf_dir), CODEC)


@query("quant_codes", f"{_CODES} SELECT id, list_aggregate([c::VARCHAR for c in codes], 'string_agg', ',') AS codes, round(scale::DOUBLE, 5) AS scale FROM w")
def quant_codes(spark, sf_dir):
    got = quantize.decode_codes(codes(spark, sf_dir), CODEC)
    return got.select("id", F.array_join(F.transform("codes", lambda x: x.cast("string")), ",").alias("codes"), F.round(F.col("scale").cast("double"), 5).alias("scale"))


_SCORE = "list_inner_product(q.y, w.stood) * w.scale"


@query("quant_scores", f"{_CODES} SELECT w.id, round({_SCORE}, 5) AS score FROM w, w AS q WHERE q.id = 0")
def quant_scores(spark, sf_dir):
    p = CODEC.prepare(first_vector(embeddings(spark, sf_dir)))
    return quantize.scores(codes(spark, sf_dir), p).withColumn("score", F.round("score", 5))


@query("quant_topk", f"{_CODES}, r AS (SELECT w.id, 1 - {_SCORE} AS distance, CAST(row_number() OVER (ORDER BY 1 - {_SCORE}, w.id) - 1 AS INTEGER) AS rank FROM w, w AS q WHERE q.id = 0) SELECT rank, id, round(distance, 5) AS distance FROM r WHERE rank < {K}")
def quant_topk(spark, sf_dir):
    p = CODEC.prepare(first_vector(embeddings(spark, sf_dir)))
    return quantize.quantized_search(codes(spark, sf_dir), p, K).withColumn("distance", F.round("distance", 5))


@query("quant_storage", f"SELECT count(*) AS n, CAST(count(*) * {CODEC.row_bytes + 4} AS BIGINT) AS packed_bytes, {CODEC.row_bytes} AS row_stride FROM embeddings")
def quant_storage(spark, sf_dir):
    return quantize.storage(codes(spark, sf_dir), CODEC).drop("checksum")


# graphs


def index(spark, sf_dir, by: str = "euclidean", config: IndexConfig = GRAPH) -> tuple[graph.GraphIndex, DataFrame]:
    """A graph of the whole table, kept in the scratch folder, and the table."""
    e = embeddings(spark, sf_dir)
    path = scratch_path(spark, "graph")
    snapshot.save_graph(graph.build(VectorTable.create(e, by, id="id"), config), path)
    return snapshot.load_graph(spark, path, by, verify=False)[0], e


@query("ann_search", _HELD.format("list_distance(q.v, e.v)", "true"))
def ann_search(spark, sf_dir):
    """At a beam as wide as the table, where the answer is the exact one."""
    g, e = index(spark, sf_dir)
    return rounded(g.search(held_out(e), K, e.count()))


@query("ann_search_filtered", _HELD.format("list_distance(q.v, e.v)", "e.label = 3"))
def ann_search_filtered(spark, sf_dir):
    g, e = index(spark, sf_dir)
    return rounded(g.search(held_out(e), K, e.count(), where="label = 3", payload=e.select("id", "label")))


@query("ann_search_removed", _HELD.format("list_distance(q.v, e.v)", "e.id % 5 <> 1"))
def ann_search_removed(spark, sf_dir):
    g, e = index(spark, sf_dir)
    return rounded(g.remove(e.where("id % 5 = 1").select("id")).search(held_out(e), K, e.count()))


@query("ann_narrow")
def ann_narrow(spark, sf_dir):
    """At a narrow beam, where the answer is approximate, with the count of refused rows."""
    g, e = index(spark, sf_dir)
    return rounded(g.search(held_out(e), K, 50, where="label <> 3", payload=e.select("id", "label"), counters=True))


@query(
    "ann_narrow_check",
    f"WITH {_MIX} SELECT query_id, {K}::BIGINT AS n, 0::BIGINT AS refused_returned, 0::BIGINT AS wrong_distances, true AS nearer_ones_first FROM q WHERE query_id % 100 = 0",
)
def ann_narrow_check(spark, sf_dir):
    """What a narrow beam returns: enough rows, none refused, with their true distances, in order."""
    g, e = index(spark, sf_dir)
    q = held_out(e)
    got = g.search(q, K, 50, where="label <> 3", payload=e.select("id", "label")).join(e, "id").join(q.withColumnRenamed("vector", "asked"), "query_id")
    true = metric("euclidean").column(F.col("asked"), F.col("vector"), 64)
    told = got.withColumn("off", F.abs(true - F.col("distance")) > 1e-9).groupBy("query_id")
    in_order = F.array_sort(F.collect_list(F.struct("rank", "distance")))
    return told.agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 3).alias("refused_returned"), F.count_if("off").alias("wrong_distances"),
        (F.transform(in_order, lambda x: x["distance"]) == F.array_sort(F.collect_list("distance"))).alias("nearer_ones_first"),
    )


@query("ann_recall_bounds", "SELECT * FROM (VALUES (50, 0.9::DOUBLE, true), (100, 0.97::DOUBLE, true), (200, 0.99::DOUBLE, true)) AS t(ef, at_least, holds)")
def ann_recall_bounds(spark, sf_dir):
    """Mean recall against the exact neighbours, at beams much narrower than the table."""
    from ..operators import evaluate

    g, e = index(spark, sf_dir)
    q = held_out(e)
    exact, out = search.knn_join(q, e, K), None
    for ef, least in ((50, 0.9), (100, 0.97), (200, 0.99)):
        row = evaluate.recall_at_k(g.search(q, K, ef), exact, K).agg(F.avg("recall").alias("r")).select(F.lit(ef).alias("ef"), F.lit(least).alias("at_least"), (F.col("r") >= least).alias("holds"))
        out = row if out is None else out.unionByName(row)
    return out


@query("ann_refused", f"WITH {_MIX} SELECT query_id, (SELECT count(*) FROM embeddings WHERE label = 3) AS refused FROM q WHERE query_id % 100 = 0")
def ann_refused(spark, sf_dir):
    """A beam as wide as the table meets every refused row, in shards that return nothing too."""
    g, e = index(spark, sf_dir)
    found = g.search(held_out(e), K, e.count(), where="label <> 3", payload=e.select("id", "label"), counters=True)
    return found.groupBy("query_id").agg(F.max("refused").alias("refused"))


_SCORER = "(e.id * 37 % 1009 + q.query_id % 7)::DOUBLE"


def _scored(query, ids):
    """Distances that have nothing to do with the vectors; the query's first component tells its number."""
    return (ids * 37 % 1009).astype(float) + float(query[0])


def _numbered(e: DataFrame) -> DataFrame:
    return batch(e).select("query_id", F.concat(F.array((F.col("query_id") % 7).cast("double")), F.array_repeat(F.lit(0.0), 63)).alias("vector"))


def _external_sql(where: str) -> str:
    return (
        f"WITH e AS ({_E}), q AS (SELECT id AS query_id FROM e WHERE id % 100 = 0), d AS (SELECT q.query_id, e.id, {_SCORER} AS distance FROM q, e WHERE {where}), "
        f"r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) - 1 AS INTEGER) AS rank FROM d) SELECT query_id, rank, id, distance FROM r WHERE rank < {K}"
    )


@query("ann_external", _external_sql("true"))
def ann_external(spark, sf_dir):
    """A graph of one distance walked by another, of the id."""
    g, e = index(spark, sf_dir)
    return g.search(_numbered(e), K, e.count(), scorer=_scored)


@query("ann_external_filtered", _external_sql("e.label IN (1, 4)"))
def ann_external_filtered(spark, sf_dir):
    g, e = index(spark, sf_dir)
    return g.search(_numbered(e), K, e.count(), where="label in (1, 4)", payload=e.select("id", "label"), scorer=_scored)


@query("ann_quantized")
def ann_quantized(spark, sf_dir):
    g, e = index(spark, sf_dir, "cosine")
    return g.search(held_out(e), K, 100, codes=codes(spark, sf_dir), codec=CODEC).withColumn("distance", F.round("distance", 4))


@query(
    "ann_quantized_exhaustive",
    f"{_CODES}, r AS (SELECT q.id AS query_id, w.id, 1 - {_SCORE} AS distance, CAST(row_number() OVER (PARTITION BY q.id ORDER BY 1 - {_SCORE}, w.id) - 1 AS INTEGER) AS rank FROM w, w AS q WHERE q.id % 100 = 0) SELECT query_id, rank, id, round(distance, 5) AS distance FROM r WHERE rank < {K}",
)
def ann_quantized_exhaustive(spark, sf_dir):
    """The graph walked by distances from codes, at a beam as wide as the table."""
    g, e = index(spark, sf_dir, "cosine")
    return g.search(batch(e), K, e.count(), codes=codes(spark, sf_dir), codec=CODEC).withColumn("distance", F.round("distance", 5))


@query("ann_other_rows_refused", "SELECT true AS refused")
def ann_other_rows_refused(spark, sf_dir):
    """Codes of other rows than the graph's are an error before any walk."""
    g, e = index(spark, sf_dir, "cosine")
    try:
        g.search(batch(e), K, 50, codes=codes(spark, sf_dir).where("id % 10 <> 0"), codec=CODEC)
        refused = False
    except IncompatibleIndex:
        refused = True
    return spark.createDataFrame([(refused,)], "refused boolean")


_MORE = f"{_E} UNION ALL SELECT (SELECT max(vec_id) FROM embeddings) + 1 + vec_id, [-x for x in embedding::DOUBLE[]], label FROM embeddings WHERE label = 1"


def _grown(spark, sf_dir, compact: bool = False) -> tuple[graph.GraphIndex, DataFrame]:
    """The saved graph, loaded to be changed and grown by the negatives of one label; and the rows in it."""
    e = embeddings(spark, sf_dir)
    path = scratch_path(spark, "graph")
    snapshot.save_graph(graph.build(VectorTable.create(e, "euclidean", id="id"), GRAPH), path)
    last = e.agg(F.max("id")).first()[0]
    new = e.where("label = 1").select((F.col("id") + last + 1).alias("id"), F.transform("vector", lambda x: -x).alias("vector"), "label")
    g = snapshot.load_graph(spark, path, "euclidean", mutable=True)[0].insert(new)
    return (g.compact() if compact else g), e.unionByName(new)


@query("ann_insert", knn_sql("euclidean", source=_MORE))
def ann_insert(spark, sf_dir):
    g, rows = _grown(spark, sf_dir)
    return rounded(g.search(batch(embeddings(spark, sf_dir)).unionByName(batch(rows.where(F.col("id") >= embeddings(spark, sf_dir).count()))).distinct(), K, rows.count()))


@query(
    "ann_compact_roundtrip",
    _HELD.format("list_distance(q.v, e.v)", "true").replace("SELECT query_id, rank, id,", "SELECT query_id, rank, r.id, e.label,").replace(" FROM r WHERE", " FROM r JOIN e ON e.id = r.id WHERE"),
)
def ann_compact_roundtrip(spark, sf_dir):
    """A compact graph saved with a payload, opened and searched."""
    g, e = index(spark, sf_dir)
    path = scratch_path(spark, "compact")
    snapshot.save_graph(g.compact(), path, e.select("id", "label"))
    again, payload = snapshot.load_graph(spark, path, "euclidean")
    return rounded(again.search(held_out(e), K, e.count()).join(payload, "id").select("query_id", "rank", "id", "label", "distance"))


@query("graph_damage", "SELECT * FROM (VALUES ('compact can''t grow', true), ('entry isn''t there', true), ('node is missing', true), ('other metric', true), ('other version', true)) AS t(damage, refused)")
def graph_damage(spark, sf_dir):
    """Saved graphs that are damaged or asked for something they aren't are refused."""
    g, e = index(spark, sf_dir)
    paths = {x: scratch_path(spark, "damaged") for x in ("whole", "compact", "node")}
    snapshot.save_graph(g, paths["whole"])
    snapshot.save_graph(g.compact(), paths["compact"])
    snapshot.save_graph(graph.GraphIndex(g.nodes.where("id <> 5"), g.dim, g.metric, g.config), paths["node"])

    def altered(change: str) -> str:
        path = scratch_path(spark, "damaged")
        spark.read.text(f"{paths['whole']}/metadata").select(F.expr(change).alias("value")).coalesce(1).write.text(f"{path}/metadata")
        spark.read.parquet(f"{paths['whole']}/nodes").write.partitionBy("shard").parquet(f"{path}/nodes")
        return path

    cases = {
        "compact can't grow": (paths["compact"], "euclidean", True), "node is missing": (paths["node"], "euclidean", False), "other metric": (paths["whole"], "cosine", False),
        "other version": (altered("regexp_replace(value, '\"version\": 1', '\"version\": 99')"), "euclidean", False), "entry isn't there": (altered("regexp_replace(value, '\"entry_id\": [0-9]+', '\"entry_id\": -7')"), "euclidean", False),
    }
    told = []
    for what, (path, by, mutable) in cases.items():
        try:
            snapshot.load_graph(spark, path, by, mutable)
            told.append((what, False))
        except (InvalidSnapshot, InvalidConfig):
            told.append((what, True))
    return spark.createDataFrame(told, "damage string, refused boolean")


@query("graph_stats")
def graph_stats(spark, sf_dir):
    return index(spark, sf_dir)[0].stats()


_LEVEL = f"CAST(floor(-ln((('0x' || substr(md5('{GRAPH.seed}:' || vec_id), 1, 8))::BIGINT + 1) / 4294967296.0) / ln({GRAPH.m})) AS INTEGER)"


@query(
    "graph_levels",
    f"WITH l AS (SELECT vec_id, {_LEVEL} AS level FROM embeddings) "
    "SELECT CAST(g.layer AS INTEGER) AS layer, count(*) AS nodes FROM l, generate_series(0, 20) AS g(layer) WHERE g.layer <= l.level GROUP BY 1",
)
def graph_levels(spark, sf_dir):
    return index(spark, sf_dir)[0].stats().select("layer", "nodes")


@query("graph_degrees", f"WITH l AS (SELECT vec_id, {_LEVEL} AS level FROM embeddings) SELECT count(*) AS nodes, sum(level + 1)::BIGINT AS lists, 0::BIGINT AS lonely, 0::BIGINT AS wrong_distances FROM l")
def graph_degrees(spark, sf_dir):
    """Every node has links in the base layer, and each link the true distance."""
    g, e = index(spark, sf_dir)
    lists = g.nodes.select(F.size("links").alias("lists"), F.size(F.get("links", F.lit(0))).alias("base")).agg(F.count("*").alias("nodes"), F.sum("lists").alias("lists"), F.count_if(F.col("base") == 0).alias("lonely"))
    ends = g.edges().join(e.select(F.col("id").alias("node"), F.col("vector").alias("a")), "node").join(e.select(F.col("id").alias("nbr"), F.col("vector").alias("b")), "nbr")
    off = ends.agg(F.count_if(F.abs(metric("euclidean").column(F.col("a"), F.col("b"), 64) - F.col("dist")) > 1e-5).alias("wrong_distances"))
    return lists.join(F.broadcast(off))


@query("graph_introspection", f"SELECT count(*) AS n, count(*) FILTER (vec_id % 5 = 1) AS deleted, count(*) FILTER (vec_id % 5 <> 1) AS live, 64::INTEGER AS dim, 'euclidean' AS metric, max({_LEVEL}) AS max_level, '{GRAPH.to_json()}' AS config FROM embeddings")
def graph_introspection(spark, sf_dir):
    g, e = index(spark, sf_dir)
    return g.remove(e.where("id % 5 = 1").select("id")).introspect()


@query("graph_integrity", "SELECT 0::BIGINT AS unknown_neighbours, 0::BIGINT AS above_level, 0::BIGINT AS across_shards, 0::BIGINT AS loops, 0::BIGINT AS too_many_links, 0::BIGINT AS double_links, 0::BIGINT AS wrong_levels")
def graph_integrity(spark, sf_dir):
    return index(spark, sf_dir)[0].integrity()


def _settings(config: IndexConfig) -> tuple:
    return (config.m, config.m0, config.ef_construction, config.prune_strategy, config.shards, config.seed)


@query("builder", "SELECT 12::INTEGER AS m, 24::INTEGER AS m0, 70::INTEGER AS ef_construction, 'heuristic' AS prune_strategy, 3::INTEGER AS shards, 9::INTEGER AS seed, true AS same_after_json, count(*) AS n FROM embeddings")
def builder(spark, sf_dir):
    """Settings by the builder, through JSON, and in the graph that it builds."""
    made = Builder().m(12).ef_construction(70).prune_strategy("heuristic").shards(3).seed(9)
    table = made.metric("euclidean").build(embeddings(spark, sf_dir), id="id")
    g = made.build_graph(table)
    same = IndexConfig.from_json(g.config.to_json()) == made.config == g.config
    return g.nodes.agg(F.count("*").alias("n")).select(*[F.lit(x).alias(n) for n, x in zip(("m", "m0", "ef_construction", "prune_strategy", "shards", "seed"), _settings(g.config))], F.lit(same).alias("same_after_json"), "n")


def _chebyshev() -> Metric:
    import numpy as np

    return register(Metric(2000, "chebyshev", lambda a, b, d: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))), lambda q, v: np.abs(v - q).max(axis=1)))


_CHEBYSHEV = "list_max([abs(x[1] - x[2]) for x in list_zip(q.v, e.v)])"


@query("custom_metric", f"WITH e AS ({_E}), d AS (SELECT q.id AS query_id, e.id, {_CHEBYSHEV} AS distance FROM e AS q, e WHERE q.id % 100 = 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) - 1 AS INTEGER) AS rank FROM d) SELECT query_id, rank, id, round(distance, {DIGITS}) AS distance FROM r WHERE rank < {K}")
def custom_metric(spark, sf_dir):
    """A metric of one's own in the graph, at a beam as wide as the table."""
    e = embeddings(spark, sf_dir)
    g = graph.build(VectorTable.create(e, _chebyshev(), id="id"), IndexConfig(m=16, ef_construction=50, shards=4, use_heuristic=False))
    return rounded(g.search(batch(e), K, e.count()))


@query("custom_metric_exact", f"WITH e AS ({_E}), d AS (SELECT e.id, {_CHEBYSHEV} AS distance FROM e AS q, e WHERE q.id = 0) SELECT id, round(distance, {DIGITS}) AS distance FROM d ORDER BY distance, id LIMIT {K}")
def custom_metric_exact(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return rounded(search.exact_search(e, first_vector(e), K, _chebyshev())).select("id", "distance")


# files

_SAME = f"SELECT vec_id AS id, round(list_sum(embedding::DOUBLE[]), {DIGITS}) AS total, round(embedding[64]::DOUBLE, {DIGITS}) AS last"


def _told(rows: DataFrame, id: str, *more: str) -> DataFrame:
    return rows.select(F.col(id).alias("id"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), DIGITS).alias("total"), F.round(F.get("vector", F.lit(63)).cast("double"), DIGITS).alias("last"), *more)


@query("snapshot_roundtrip", f"{_SAME}, label FROM embeddings")
def snapshot_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "snapshot")
    snapshot.save(VectorTable.create(embeddings(spark, sf_dir), "cosine", id="id"), path)
    return _told(snapshot.load(spark, path, "cosine", verify=True).rows, "id", "label")


@query("fvecs_roundtrip", f"{_SAME} FROM embeddings")
def fvecs_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "fvecs") + "/all.fvecs"
    files.write_fvecs(embeddings(spark, sf_dir), path)
    return _told(files.read_fvecs(spark, path), "row")


@query("fvecs_rows", f"SELECT o - 1 AS row, round(list_sum(embedding::DOUBLE[]), {DIGITS}) AS total FROM (SELECT *, row_number() OVER (ORDER BY vec_id) AS o FROM embeddings) WHERE (o - 1) % 37 = 5 AND o <= 400")
def fvecs_rows(spark, sf_dir):
    """Single rows of a file, by their places."""
    path = scratch_path(spark, "fvecs") + "/all.fvecs"
    files.write_fvecs(embeddings(spark, sf_dir), path)
    got = files.fvecs_rows(spark, path, list(range(5, 400, 37)))
    return got.select("row", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), DIGITS).alias("total"))


@query("matrix_roundtrip", f"{_SAME} FROM embeddings")
def matrix_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "matrix") + "/all.f32"
    told = files.write_matrix(embeddings(spark, sf_dir), path)
    return _told(files.read_matrix(spark, path, told["rows"], told["columns"], told["sha256"]), "row")


@query("codes_roundtrip", f"{_CODES} SELECT id, list_aggregate([c::VARCHAR for c in codes], 'string_agg', ',') AS codes, round(scale::DOUBLE, 5) AS scale, 32::INTEGER AS width FROM w")
def codes_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "codes")
    snapshot.save_codes(codes(spark, sf_dir), CODEC, path)
    rows, codec = snapshot.load_codes(spark, path, verify=True)
    got = quantize.decode_codes(rows, codec).join(rows.select("id", F.octet_length("codes").alias("width")), "id")
    return got.select("id", F.array_join(F.transform("codes", lambda x: x.cast("string")), ",").alias("codes"), F.round(F.col("scale").cast("double"), 5).alias("scale"), "width")


@query("paired_insert_roundtrip", one_sql("cosine", source=_APPENDED, a="q.v[25:64]", b="e.v[25:64]", columns=_OTHER.format("v[1:24]")))
def paired_insert_roundtrip(spark, sf_dir):
    """Rows added to both spaces, saved, opened and searched by the second."""
    p = _pair(spark, sf_dir)
    e = embeddings(spark, sf_dir)
    new = e.where("label = 1").select(F.col("id").alias("o"), *[F.transform(F.slice("vector", *x), lambda v: -v).alias(n) for n, x in (("emb_a", (1, 24)), ("emb_b", (25, 40)))])
    path = scratch_path(spark, "paired")
    snapshot.save_pair(p.insert(new, "o"), path)
    again = snapshot.load_pair(spark, path, "euclidean", "cosine")
    got = again.search_by_b(first_vector(again.b.rows), K)
    return rounded(got).select("rank", "id", "distance", F.round(F.aggregate("emb_a", F.lit(0.0), lambda s, x: s + x.cast("double")), DIGITS).alias("other_sum"))


@query("vector_products", f"WITH e AS ({_S}) SELECT e.id, round(list_inner_product(q.v, e.v), {DIGITS}) AS dot FROM e AS q, e WHERE q.id = 0")
def vector_products(spark, sf_dir):
    e = embeddings(spark, sf_dir, True)
    return e.select("id", F.round(dot(F.col("vector"), search.array_of(first_vector(e)), 64), DIGITS).alias("dot"))
