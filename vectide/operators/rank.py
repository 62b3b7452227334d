"""Hybrid ranking: fusion of two rankings, then boosts, penalties and saturation by file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Recipe:
    """The constants of the pipeline."""

    top_k: int = 10
    candidate_multiplier: int = 5
    rrf_k: int = 60
    coherence: float = 0.2
    saturation_threshold: int = 1
    saturation_decay: float = 0.5

    @property
    def candidates(self) -> int:
        return self.top_k * self.candidate_multiplier


def rrf(dense: DataFrame, lexical: DataFrame, alpha: float | str = 0.5, recipe: Recipe = Recipe()) -> DataFrame:
    """(query_id, id, score): weighted reciprocal ranks of the first candidates of both rankings (query_id, rank, id).

    alpha is a number, or a column of dense with the weight of its query.
    """
    keep = F.col("rank") < recipe.candidates
    weight = F.col(alpha) if isinstance(alpha, str) else F.lit(float(alpha))
    by = 1.0 / (recipe.rrf_k + F.col("rank") + 1)
    d = dense.where(keep).select("query_id", "id", (weight * by).alias("__d"))
    if isinstance(alpha, str):
        weights = dense.select("query_id", F.col(alpha).alias("__alpha")).distinct()
        lex = lexical.where(keep).join(weights, "query_id").select("query_id", "id", ((1 - F.col("__alpha")) * by).alias("__l"))
    else:
        lex = lexical.where(keep).select("query_id", "id", ((1 - weight) * by).alias("__l"))
    both = d.join(lex, ["query_id", "id"], "full")
    return both.select("query_id", "id", (F.coalesce("__d", F.lit(0.0)) + F.coalesce("__l", F.lit(0.0))).alias("score"))


def candidate_order(candidates: DataFrame, chunks: DataFrame, control: DataFrame) -> DataFrame:
    """candidates (query_id, id, ...) with candidate_order, by start_line, then rank in the control ranking, then id."""
    c = candidates.join(chunks.select("id", "start_line"), "id").join(control.select("query_id", "id", F.col("rank").alias("__control")), ["query_id", "id"], "left")
    w = Window.partitionBy("query_id").orderBy("start_line", F.col("__control").asc_nulls_last(), "id")
    return c.withColumn("candidate_order", F.row_number().over(w) - 1).drop("start_line", "__control")


def file_coherence(candidates: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """(query_id, id, file, candidate_order, score): the best chunk of each file gains coherence * best score * its file's
    sum over the largest file's sum."""
    f, q = Window.partitionBy("query_id", "file"), Window.partitionBy("query_id")
    c = candidates.withColumn("__sum", F.sum("score").over(f)).withColumn("__best", F.row_number().over(f.orderBy(F.desc("score"), "candidate_order")) == 1)
    c = c.withColumn("__max", F.max("score").over(q)).withColumn("__top", F.max("__sum").over(q))
    gain = F.when(F.col("__best") & (F.col("__top") > 0), recipe.coherence * F.col("__max") * F.col("__sum") / F.col("__top")).otherwise(0.0)
    return c.withColumn("score", F.col("score") + gain).drop("__sum", "__best", "__max", "__top")


def query_boosts(candidates: DataFrame, existing: DataFrame, injected: DataFrame) -> DataFrame:
    """Adds coefficient * best score to boosted chunks (query_id, id, coefficient); injected ones (with file,
    candidate_order) enter only if they aren't candidates."""
    best = candidates.groupBy("query_id").agg(F.max("score").alias("__max"))
    b = existing.groupBy("query_id", "id").agg(F.sum("coefficient").alias("__c"))
    new = injected.select("query_id", "id", *[F.col(c).alias(f"__{c}") for c in ("file", "candidate_order", "coefficient")])
    every = candidates.join(new, ["query_id", "id"], "full").join(best, "query_id").join(b, ["query_id", "id"], "left")
    raised = F.col("score") + F.coalesce("__c", F.lit(0.0)) * F.col("__max")
    return every.select("query_id", "id", *[F.coalesce(c, f"__{c}").alias(c) for c in ("file", "candidate_order")], F.coalesce(raised, F.col("__coefficient") * F.col("__max")).alias("score")).select(*candidates.columns)


def path_penalty(candidates: DataFrame, penalties: DataFrame, alpha: str | float = 0.5) -> DataFrame:
    """Multiplies scores by the chunk's penalty (id, penalty) unless the query's weight alpha is one."""
    weight = F.col(alpha) if isinstance(alpha, str) else F.lit(float(alpha))
    p = candidates.join(penalties.select("id", "penalty"), "id", "left")
    return p.withColumn("score", F.when(weight < 1, F.col("score") * F.coalesce("penalty", F.lit(1.0))).otherwise(F.col("score"))).select(*candidates.columns)


def file_saturation(candidates: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """(query_id, rank, id, score): the first top_k, the n-th chunk of a file beyond the threshold decayed n times.

    Taking the best chunk again and again gives the same for scores >= 0 and a decay of at most one.
    """
    f = Window.partitionBy("query_id", "file").orderBy(F.desc("score"), "candidate_order")
    excess = F.greatest(F.lit(0), F.row_number().over(f) - recipe.saturation_threshold)
    c = candidates.withColumn("score", F.col("score") * F.pow(F.lit(recipe.saturation_decay), excess))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate_order")
    return c.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < recipe.top_k).select("query_id", "rank", "id", "score")


def hybrid(dense: DataFrame, lexical: DataFrame, chunks: DataFrame, control: DataFrame, existing: DataFrame, injected: DataFrame, alpha: float = 0.5, recipe: Recipe = Recipe()) -> DataFrame:
    """The whole: fusion, coherence, boosts, penalties, saturation. chunks: (id, file, start_line, penalty)."""
    fused = candidate_order(rrf(dense, lexical, alpha, recipe), chunks, control).join(chunks.select("id", "file"), "id")
    boosted = query_boosts(file_coherence(fused, recipe), existing, injected)
    return file_saturation(path_penalty(boosted, chunks, alpha), recipe)


def control_check(found: DataFrame, control: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """(query_id, matches): the same ids at the same ranks, scores within the tolerance."""
    a, b = (x.select("query_id", "rank", F.col("id").alias(f"id_{n}"), F.col("score").alias(f"s_{n}")) for x, n in ((found, "a"), (control, "b")))
    both = a.join(b, ["query_id", "rank"], "full")
    ok = F.coalesce((F.col("id_a") == F.col("id_b")) & (F.abs(F.col("s_a") - F.col("s_b")) <= tolerance), F.lit(False))
    return both.groupBy("query_id").agg(F.bool_and(ok).alias("matches"))
