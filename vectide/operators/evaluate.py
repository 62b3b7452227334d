"""Quality of retrieval: recall, targets, agreement, summaries of counts and latencies, checks of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall_at_k(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(query_id, recall) of ranked ids (query_id, rank, id): hits among the first k over min(exact ones, k).

    A query without exact results has recall 1 if nothing was found for it, else 0.
    """
    f = found.where(F.col("rank") < k).select("query_id", "id").distinct()
    e = exact.where(F.col("rank") < k).select("query_id", "id").distinct()
    hits = f.join(e, ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("hits"))
    sizes = e.groupBy("query_id").agg(F.count("*").alias("n_exact"))
    every = f.select("query_id").union(e.select("query_id")).distinct()
    joined = every.join(sizes, "query_id", "left").join(hits, "query_id", "left")
    return joined.select("query_id", F.when(F.col("n_exact").isNull(), 0.0).otherwise(F.coalesce("hits", F.lit(0)) / F.col("n_exact")).alias("recall"))


def list_recall(found: Column, exact: Column, k: int) -> Column:
    """recall_at_k() of arrays of ids."""
    hits = F.size(F.array_intersect(F.slice(found, 1, k), F.slice(exact, 1, k)))
    return F.when(F.size(exact) == 0, F.when(F.size(found) == 0, 1.0).otherwise(0.0)).otherwise(hits / F.least(F.size(exact), F.lit(k)))


def mean_recall(found: DataFrame, exact: DataFrame, queries: int, k: int) -> DataFrame:
    """One row, recall: hits over queries * k."""
    hits = found.where(F.col("rank") < k).join(exact.where(F.col("rank") < k).select("query_id", "id"), ["query_id", "id"])
    return hits.agg((F.count("*") / F.lit(float(queries * k))).alias("recall"))


def target_metrics(found: DataFrame, chunks: DataFrame, targets: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, target_recall, reciprocal_rank): of (query_id, target) the share of files among the first k hits' files
    (chunks: id, file), and one over the place of the first hit in a target."""
    hits = found.where(F.col("rank") < k).join(chunks.select("id", "file"), "id").join(targets.select("query_id", F.col("target").alias("file")), ["query_id", "file"])
    got = hits.groupBy("query_id").agg(F.countDistinct("file").alias("n"), F.min("rank").alias("first"))
    want = targets.groupBy("query_id").agg(F.countDistinct("target").alias("m"))
    return want.join(got, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) / F.col("m")).alias("target_recall"), F.coalesce(1.0 / (F.col("first") + 1), F.lit(0.0)).alias("reciprocal_rank"))


def control_agreement(found: DataFrame, control: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, top1_reciprocal_rank): against a control ranking, with one over the place of its first result."""
    top = control.where("rank = 0").select("query_id", "id")
    at = found.join(top, ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("at"))
    rec = recall_at_k(found, control, k)
    return rec.join(at, "query_id", "left").select("query_id", "recall", F.coalesce(1.0 / (F.col("at") + 1), F.lit(0.0)).alias("top1_reciprocal_rank"))


def _ranked(values: DataFrame, column: str, group: list[str]) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(column)
    return values.where(F.col(column).isNotNull()).select(*group, F.col(column).alias("__v"), (F.row_number().over(w) - 1).alias("__i"), F.count("*").over(Window.partitionBy(*group)).alias("__n"))


def returned_counts(counts: DataFrame, requested: int, column: str = "n", group: list[str] | None = None) -> DataFrame:
    """min, p50 (the lower middle), mean, max and the number below requested."""
    g = group or []
    at = _ranked(counts, column, g)
    return at.groupBy(*g).agg(
        F.min("__v").alias("min"), F.max(F.when(F.col("__i") == F.floor((F.col("__n") - 1) / 2), F.col("__v"))).alias("p50"), F.avg("__v").alias("mean"), F.max("__v").alias("max"), F.count_if(F.col("__v") < requested).alias("short")
    )


def latency_summary(samples: DataFrame, column: str = "us", group: list[str] | None = None) -> DataFrame:
    """n, p50 and p95 at places ceil((n - 1) q), and the median at n div 2, without interpolation."""
    g = group or []
    at = _ranked(samples, column, g)
    pick = lambda place: F.max(F.when(F.col("__i") == place, F.col("__v")))
    return at.groupBy(*g).agg(F.max("__n").alias("n"), pick(F.ceil((F.col("__n") - 1) * F.lit(0.5))).alias("p50"), pick(F.ceil((F.col("__n") - 1) * F.lit(0.95))).alias("p95"), pick(F.floor(F.col("__n") / 2)).alias("median"))


def filtered_check(found: DataFrame, excluded: DataFrame, n: int, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, valid): results are there, within 0 to n - 1, none excluded (id), none twice.

    queries (query_id) are those that should have results; without them only queries that have some are told.
    """
    out = excluded.select("id").distinct().withColumn("__out", F.lit(True))
    marked = found.join(out, "id", "left")
    told = marked.groupBy("query_id").agg((F.bool_and((F.col("id") >= 0) & (F.col("id") < n) & F.col("__out").isNull()) & (F.count("*") == F.countDistinct("id"))).alias("valid"))
    if queries is None:
        return told
    return queries.select("query_id").distinct().join(told, "query_id", "left").select("query_id", F.coalesce("valid", F.lit(False)).alias("valid"))


def shadow_sets(hits: DataFrame, files: DataFrame, sizes: tuple[int, ...] = (0, 10, 50)) -> DataFrame:
    """(set_name, place, file): nested sets of files to leave out, by first appearance.

    Files go by their first (rank, query order) among hits (query_order, rank, file); those without a hit follow by name.
    """
    first = hits.groupBy("file").agg(F.min(F.struct("rank", "query_order")).alias("f"))
    ordered = files.select("file").distinct().join(first, "file", "left")
    most = max(sizes)
    top = ordered.orderBy(F.col("f").isNull(), F.col("f.rank"), F.col("f.query_order"), "file").limit(most)
    placed = top.select("file", (F.row_number().over(Window.orderBy(F.col("f").isNull(), F.col("f.rank"), F.col("f.query_order"), "file")) - 1).alias("place"))
    named = placed.select("file", "place", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size")).where("place < size")
    return named.select(F.concat(F.lit("exclude_"), F.col("size").cast("string")).alias("set_name"), "place", "file")


def parity(found: DataFrame, recorded: DataFrame, tolerance: float = 5e-4) -> DataFrame:
    """(query_id, same_order, same_set, same_top1, within): rankings (query_id, rank, id, score) against recorded ones."""
    a = found.select("query_id", "rank", F.col("id").alias("id_a"), F.col("score").alias("score_a"))
    b = recorded.select("query_id", "rank", F.col("id").alias("id_b"), F.col("score").alias("score_b"))
    both = a.join(b, ["query_id", "rank"], "full")
    same = F.coalesce(F.col("id_a") == F.col("id_b"), F.lit(False))
    return both.groupBy("query_id").agg(
        F.bool_and(same).alias("same_order"), (F.array_sort(F.collect_set("id_a")) == F.array_sort(F.collect_set("id_b"))).alias("same_set"),
        F.bool_and((F.col("rank") > 0) | same).alias("same_top1"), F.bool_and(F.coalesce(F.abs(F.col("score_a") - F.col("score_b")) <= tolerance, F.lit(False))).alias("within"),
    )


def gates(measured: DataFrame, rules: dict[str, str]) -> DataFrame:
    """One row: a column for each rule, a condition that all rows must meet, and passed."""
    row = measured.agg(*[F.coalesce(F.bool_and(F.expr(rule)), F.lit(False)).alias(name) for name, rule in rules.items()])
    ok = F.lit(True)
    for name in rules:
        ok = ok & F.col(name)
    return row.withColumn("passed", ok)


def search_gates(queries: DataFrame, dense: DataFrame, filtered: DataFrame, excluded: DataFrame, refused: DataFrame, k: int) -> DataFrame:
    """One row of conditions that an evaluation of filtered searches must meet, and passed.

    queries (query_id), dense (query_id, rank, id), filtered (set_name, query_id, rank, id), excluded (set_name, id, null for
    a set that excludes nothing), refused (set_name, query_id, refused): all have k results for each query, in ranks 0 to
    k - 1 and of different ids; sets that exclude nothing give what the dense search gives; no excluded id is returned;
    each query meets refused rows in the sets that exclude some.
    """
    sets = excluded.groupBy("set_name").agg(F.count("id").alias("out"))
    every = F.lit("")
    all_found = filtered.select("set_name", "query_id", "rank", "id").unionByName(dense.select(every.alias("set_name"), "query_id", "rank", "id"))
    wanted = sets.select("set_name").unionByName(sets.sparkSession.range(1).select(every.alias("set_name"))).join(F.broadcast(queries.select("query_id")))
    whole = all_found.groupBy("set_name", "query_id").agg(((F.count("*") == k) & (F.countDistinct("id") == k) & (F.countDistinct("rank") == k) & (F.min("rank") == 0) & (F.max("rank") == k - 1)).alias("whole"))
    complete = wanted.join(whole, ["set_name", "query_id"], "left").agg(F.coalesce(F.bool_and(F.coalesce("whole", F.lit(False))), F.lit(False)).alias("all_results_complete"))
    open_sets = sets.where("out = 0").select("set_name")
    a = filtered.join(F.broadcast(open_sets), "set_name").select("set_name", "query_id", "rank", F.col("id").alias("a"))
    b = dense.join(F.broadcast(open_sets)).select("set_name", "query_id", "rank", F.col("id").alias("b"))
    same = a.join(b, ["set_name", "query_id", "rank"], "full").agg(F.coalesce(F.bool_and(F.coalesce(F.col("a") == F.col("b"), F.lit(False))), F.lit(False)).alias("accept_all_matches_dense"))
    emitted = filtered.join(excluded.where("id is not null"), ["set_name", "id"], "left_semi").agg((F.count("*") == 0).alias("no_excluded_emitted"))
    shut = sets.where("out > 0").select("set_name").join(F.broadcast(queries.select("query_id"))).join(refused, ["set_name", "query_id"], "left")
    met = shut.agg(F.coalesce(F.bool_and(F.coalesce(F.col("refused") > 0, F.lit(False))), F.lit(True)).alias("refused_observed"))
    row = complete.join(F.broadcast(same)).join(F.broadcast(emitted)).join(F.broadcast(met))
    return row.withColumn("passed", F.col("all_results_complete") & F.col("accept_all_matches_dense") & F.col("no_excluded_emitted") & F.col("refused_observed"))


def provenance_gate(recorded: dict, expected: dict, hashes: tuple[str, ...] = ()) -> bool:
    """Whether all expected fields are recorded as they should be, and the named fields hold SHA-256s in hexadecimal."""
    digits = set("0123456789abcdef")
    return all(recorded.get(k) == v for k, v in expected.items()) and all(isinstance(recorded.get(h), str) and len(recorded[h]) == 64 and set(recorded[h].lower()) <= digits for h in hashes)


def content_identity(rows: DataFrame, parts: list[str], order: str) -> DataFrame:
    """(identity): SHA-256 of the SHA-256s of ranges of 4096 values of a long column of different values, each over its
    rows' SHA-256s of their tagged, length-prefixed parts, in order."""
    pieces = [F.concat(F.lit(f"{p}:"), F.octet_length(F.coalesce(F.col(p).cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(F.col(p).cast("string"), F.lit(""))) for p in parts]

    def joined(o: str, h: str):
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(o, h))), lambda x: x[h]), ""), 256)

    each = rows.select(F.col(order).alias("__o"), F.sha2(F.concat(*pieces), 256).alias("__h"))
    ranges = each.groupBy(F.shiftright("__o", 12).alias("__r")).agg(joined("__o", "__h").alias("__h"))
    return ranges.agg(joined("__r", "__h").alias("identity"))
