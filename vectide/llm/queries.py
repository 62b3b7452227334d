"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, imatch, language_id, line_dedup, mixing, packing, secret_scan, simhash, suffix_dedup, warc
from .common import new_path, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed_spans", lambda x: F.concat_ws(":", x["s"].cast("string"), x["e"].cast("string"))), ",")
    gone = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])
    return cut.select("doc_id", F.size("removed_spans").cast("long").alias("n_spans"), gone.alias("n_removed"), spans.alias("removed_spans"), "text")


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda k: F.size(F.filter("secret_spans", lambda x: x["k"] == k)).cast("long")
    base = secret_scan.render(F.filter("secret_spans", lambda x: x["k"] < 3))
    return rows.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), secret_scan.render(F.col("secret_spans")).alias("spans")
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out(F.col("doc_id")))
    return language_id.identify(docs, language_id.learn(docs.where(~F.col("held_out"))), ["doc_id", "held_out"])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed_bytes", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])
    return cut.select("doc_id", (F.octet_length("kept") + gone).cast("long").alias("n_bytes"), gone.alias("n_removed"), F.size("removed_bytes").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return near.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_line_dedup": op2_line_dedup,
        "op3_imatch": op3_imatch,
        "op4_secret_scan": op4_secret_scan,
        "op5_language_id": op5_language_id,
        "op6_simhash": op6_simhash,
        "op7_pfair_mixing": op7_pfair_mixing,
        "op8_suffix_array_dedup": op8_suffix_array_dedup,
        "op9_warc_zstd": op9_warc_zstd,
        "op10_epsilon_grid_join": op10_epsilon_grid_join,
        "pipeline": corpus_pipeline.run,
    }


# SQL that says the same by brute force.

OP8_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT doc_id, o, substring(h, 2 * o + 1, 910) AS h FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199, 256)) AS o FROM d WHERE len(h) >= 400)),
w AS (SELECT doc_id, o + j AS i, md5(substring(h, 2 * j + 1, 400)) AS m FROM (SELECT doc_id, o, h, unnest(range(len(h) // 2 - 199)) AS j FROM x)),
t AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
s AS (SELECT doc_id, i FROM w JOIN t USING (m)),
g AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 200 AS gap FROM s),
k AS (SELECT doc_id, i, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
r AS (SELECT doc_id, min(i) AS s, max(i) + 200 AS e FROM k GROUP BY doc_id, k),
p AS (SELECT doc_id, coalesce(lag(e) OVER o, 0) AS a, s AS b FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY s) UNION ALL SELECT d.doc_id, coalesce(max(r.e), 0), len(d.h) // 2 FROM d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id, len(d.h)),
q AS (SELECT doc_id, string_agg(substring(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, len(d.h) // 2 AS n_bytes, len(d.h) // 2 - len(kept) // 2 AS n_removed, (SELECT count(*) FROM r WHERE r.doc_id = d.doc_id) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN q USING (doc_id)
"""

OP9_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""

OP10_SQL = """
WITH RECURSIVE u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM u),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n AS a JOIN n AS b ON a.vec_id <> b.vec_id AND list_inner_product(a.v, b.v) >= 0.95 * a.n * b.n AND a.n > 0 AND b.n > 0),
r AS (SELECT vec_id AS a, vec_id AS b FROM u UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_suffix_array_dedup": OP8_SQL, "op9_warc_zstd": OP9_SQL, "op10_epsilon_grid_join": OP10_SQL}
