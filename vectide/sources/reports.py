"""Evaluation inputs and outputs: query files, fixtures with their invariants, receipts and benchmark rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidSnapshot
from .files import _put

HIT = "struct<chunk_index:bigint,score:double>"
BOOST = "struct<chunk_index:bigint,coefficient:double>"
QUERIES = "id string, kind string, query string, targets array<string>"
CHUNKS = "index bigint, id string, file_path string, start_line bigint, end_line bigint, language string, content_sha256 string, file_sha256 string, path_penalty double"
FIXTURE_QUERIES = (
    "id string, kind string, text string, targets array<string>, query_vector_row bigint, alpha double, "
    f"exact_dense array<{HIT}>, bm25 array<{HIT}>, hybrid_control array<{HIT}>, filtered_exact map<string,array<{HIT}>>, "
    f"control_candidate_order array<bigint>, query_boost_existing array<{BOOST}>, query_boost_injected array<{BOOST}>, timings_us map<string,double>"
)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, query, targets) of a JSON array of queries. Ids must differ and kinds be nl or sym."""
    q = spark.read.schema(QUERIES).option("multiLine", True).json(path)
    bad = q.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count_if(~F.coalesce(F.col("kind").isin("nl", "sym"), F.lit(False))).alias("kinds"), F.count_if(F.coalesce(F.size("targets"), F.lit(0)) < 1).alias("none")).first()
    if bad["n"] != bad["ids"] or bad["kinds"] or bad["none"]:
        raise InvalidSnapshot(f"queries: {bad.asDict()}")
    return q


def read_fixture(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, queries) of a fixture, which is one JSON object; see check_fixture()."""
    whole = spark.read.schema(f"chunks array<struct<{', '.join(_colons(CHUNKS))}>>, queries array<struct<{', '.join(_colons(FIXTURE_QUERIES))}>>").option("multiLine", True).json(path)
    return whole.select(F.inline("chunks")), whole.select(F.inline("queries"))


def _colons(ddl: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [x.replace(" ", ":", 1) for x in [*out, part.strip()]]


def check_fixture(chunks: DataFrame, queries: DataFrame, shadows: DataFrame | None = None, candidates: int | None = None, top_k: int | None = None, alphas: dict[str, float] | None = None) -> DataFrame:
    """One row of counts that are all 0 in a sound fixture.

    Chunks are numbered without gaps, with lines in order and penalties from 0 to 1. Queries have different ids, a kind, a
    text, targets, a vector row of their own and a weight alpha from 0 to 1, that of their kind if alphas are given. Hits
    are of known chunks, with finite scores that don't rise, none twice; exact and filtered ones number candidates and
    hybrid ones top_k, if these are given. Boosts are of known chunks and not negative. Shadow sets (name, files,
    chunk_indices) have the chunks of just their files, exact results for every query, and none of them emitted there.
    """
    n = chunks.count()
    known = lambda c: (c >= 0) & (c < n)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    c = chunks.agg((F.count("*") - F.countDistinct("index")).alias("double_indexes"), F.count_if(~known(F.col("index"))).alias("gaps"), F.count_if(F.col("end_line") < F.col("start_line")).alias("lines"), F.count_if(~F.coalesce(F.col("path_penalty").between(0.0, 1.0), F.lit(False))).alias("penalties"))
    none = F.array().cast(f"array<{HIT}>")
    lists = queries.select("id", F.explode(F.concat(F.array(*[F.struct(F.lit(x).alias("name"), F.coalesce(x, none).alias("hits")) for x in ("exact_dense", "bm25", "hybrid_control")]), F.transform(F.map_entries(F.coalesce("filtered_exact", F.create_map().cast(f"map<string,array<{HIT}>>"))), lambda e: F.struct(F.concat(F.lit("filtered "), e["key"]).alias("name"), e["value"].alias("hits"))))).alias("l")).select("id", "l.name", "l.hits")
    rising = lambda a: F.exists(F.zip_with(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, F.lit(2), F.size(a)), lambda x, y: F.coalesce(x["score"] < y["score"], F.lit(False))), lambda x: x)
    wrong = F.lit(False)
    if candidates is not None:
        wrong = wrong | ((F.col("name") == "exact_dense") | F.col("name").startswith("filtered ")) & (F.size("hits") != candidates)
    if top_k is not None:
        wrong = wrong | (F.col("name") == "hybrid_control") & (F.size("hits") != top_k)
    h = lists.agg(
        F.count_if(F.exists("hits", lambda x: ~F.coalesce(known(x["chunk_index"]), F.lit(False)))).alias("unknown_chunks"), F.count_if(F.exists("hits", lambda x: ~finite(x["score"]))).alias("scores"),
        F.count_if(rising(F.col("hits"))).alias("unsorted"), F.count_if(F.size(F.array_distinct(F.transform("hits", lambda x: x["chunk_index"]))) != F.size("hits")).alias("double_hits"), F.count_if(wrong).alias("wrong_sizes"),
    )
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    alpha = ~F.coalesce(F.col("alpha").between(0.0, 1.0), F.lit(False))
    for kind, value in (alphas or {}).items():
        alpha = alpha | (F.col("kind") == kind) & (F.abs(F.col("alpha") - value) > 1e-12)
    boosts = F.concat(*[F.coalesce(x, F.array().cast(f"array<{BOOST}>")) for x in ("query_boost_existing", "query_boost_injected")])
    q = queries.agg(
        (F.count("*") - F.countDistinct("id")).alias("double_ids"), F.count_if(~F.coalesce(F.col("kind").isin("nl", "sym"), F.lit(False))).alias("kinds"), F.count_if(blank | (F.coalesce(F.size("targets"), F.lit(0)) < 1)).alias("incomplete"), F.count_if(alpha).alias("alphas"),
        (F.count("*") - F.countDistinct(F.when(F.col("query_vector_row") >= 0, F.col("query_vector_row")))).alias("vector_rows"), F.count_if(F.exists(boosts, lambda x: ~F.coalesce(known(x["chunk_index"]) & finite(x["coefficient"]) & (x["coefficient"] >= 0), F.lit(False)))).alias("boosts"),
    )
    out = c.join(F.broadcast(h)).join(F.broadcast(q))
    if shadows is None:
        return out
    own = shadows.select("name", F.explode("files").alias("file_path")).join(chunks.select("file_path", "index"), "file_path").groupBy("name").agg(F.array_sort(F.collect_set("index")).alias("members"))
    told = shadows.join(own, "name", "left").agg(F.count_if(F.array_sort("chunk_indices") != F.coalesce("members", F.array().cast("array<bigint>"))).alias("shadow_members"))
    pairs = shadows.select("name", "chunk_indices").join(F.broadcast(queries.select("id", "filtered_exact")))
    hits = F.element_at("filtered_exact", F.col("name"))
    seen = pairs.agg(F.count_if(~F.array_contains(F.map_keys("filtered_exact"), F.col("name"))).alias("shadow_missing"), F.count_if(F.coalesce(F.arrays_overlap(F.transform(hits, lambda x: x["chunk_index"]), "chunk_indices"), F.lit(False))).alias("shadow_emitted"))
    return out.join(F.broadcast(told)).join(F.broadcast(seen))


def write_receipt(spark: SparkSession, receipt: dict, path: str) -> None:
    """A JSON receipt and beside it a Markdown table of its top-level values; each appears whole or not at all."""
    _put(spark, path, json.dumps(receipt, indent=2, sort_keys=True).encode())
    lines = ["| what | value |", "|---|---|"] + [f"| {k} | {json.dumps(v) if isinstance(v, (dict, list)) else v} |" for k, v in sorted(receipt.items())]
    _put(spark, path.removesuffix(".json") + ".md", ("\n".join(lines) + "\n").encode())


def write_rows(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Benchmark rows as JSON lines or CSV."""
    w = rows.coalesce(1).write.mode("overwrite")
    w.json(path) if kind == "json" else w.option("header", True).csv(path)
