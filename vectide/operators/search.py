"""Exact nearest neighbours: one query, or many against a table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..arrow import matrix
from ..errors import DimensionMismatch, InvalidVector, ZeroK
from ..functions.metrics import Metric, metric

#: Queries sent to the executors at once, in components: 64 MB of doubles. More go in further passes over the table.
QUERY_COMPONENTS = 8 << 20


def dimension(vectors: DataFrame, vector: str = "vector") -> int:
    """The dimension of the first vector; 0 if there is none."""
    row = vectors.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    return row[0] if row else 0


def check_query(query: Sequence[float], dim: int, k: int) -> None:
    """The dimension counts first, then k; an empty table takes any query."""
    if dim and len(query) != dim:
        raise DimensionMismatch(dim, len(query))
    if k < 1:
        raise ZeroK()
    if not all(np.isfinite(query)):
        raise InvalidVector("a query must be finite")


def array_of(query: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query])


def exact_search(vectors: DataFrame, query: Sequence[float], k: int, by: str | Metric = "euclidean", where: Column | str | None = None, dim: int | None = None, id: str = "id", vector: str = "vector") -> DataFrame:
    """The k nearest rows of vectors (id, vector, ...) to a query, with rank from 0 and distance; all other columns stay.

    where chooses rows before the k nearest are taken, so that fewer come back only if fewer are eligible. Equal
    distances are ordered by id.
    """
    dim = dimension(vectors, vector) if dim is None else dim
    check_query(query, dim, k)
    if where is not None:
        vectors = vectors.where(where)
    near = vectors.withColumn("distance", metric(by).column(F.col(vector), array_of(query), dim or None)).orderBy("distance", id).limit(k)
    return near.withColumn("rank", F.row_number().over(Window.orderBy("distance", id)) - 1)


def _nearest(ids: np.ndarray, q: np.ndarray, at: np.ndarray, v: np.ndarray, k: int, m: Metric) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k nearest rows: query numbers, ids, distances."""
    out = []
    for i, x in zip(at, q):
        d = m.kernel(x, v)
        if len(d) > k:
            near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        else:
            near = np.arange(len(d))
        near = near[np.lexsort((ids[near], d[near]))[:k]]
        out.append((np.full(len(near), i), ids[near], d[near]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _scan(query_ids: np.ndarray, queries: np.ndarray, k: int, m: Metric):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(len(queries))
        kept: tuple | None = None
        for b in batches:
            ids, v = b.column(0).to_numpy(), matrix(b.column(1), queries.shape[1])
            if not len(ids):
                continue
            new = _nearest(ids, queries, number, v, k, m)
            kept = new if kept is None else tuple(np.concatenate(x) for x in zip(kept, new))
            order = np.lexsort((kept[1], kept[2], kept[0]))
            kept = tuple(x[order] for x in kept)
            first = np.searchsorted(kept[0], number)
            place = np.arange(len(kept[0])) - first[kept[0]]
            kept = tuple(x[place < k] for x in kept)
        if kept is not None:
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[kept[0]]), pa.array(kept[1]), pa.array(kept[2])], names=["query_id", "id", "distance"])

    return run


def query_lots(queries: DataFrame, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries (query_id, vector) as numbers and matrices of at most QUERY_COMPONENTS components; wrong ones are errors."""
    held: list = []

    def lot() -> tuple[np.ndarray, np.ndarray]:
        return np.array([r[0] for r in held], dtype=np.int64), np.array([r[1] for r in held], dtype=np.float64)

    asked = queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>"))
    most = max(1, QUERY_COMPONENTS // max(dim, 1))
    first = asked.limit(most + 1).collect()  # mostly all
    for r in first if len(first) <= most else asked.toLocalIterator():
        if r[1] is None or None in r[1]:
            raise InvalidVector(f"query {r[0]} is null or has null components")
        if len(r[1]) != (dim or len(held[0][1] if held else r[1])):
            raise DimensionMismatch(dim or len(held[0][1]), len(r[1]))
        held.append(r)
        if len(held) >= most:
            yield lot()
            held = []
    if held:
        yield lot()


def knn_join(queries: DataFrame, vectors: DataFrame, k: int, by: str | Metric = "euclidean", where: Column | str | None = None, dim: int | None = None) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest rows of vectors (id, vector) for each query (query_id, vector).

    Queries come to the driver and go to every task, at most QUERY_COMPONENTS numbers at a time; each further lot is
    another pass over the table. A task keeps k rows a query, so what is shuffled is tasks x queries x k rows whatever
    the table's size. where chooses rows of the table before the nearest are taken.
    """
    spark = vectors.sparkSession
    dim = dimension(vectors) if dim is None else dim
    if k < 1:
        raise ZeroK()
    if where is not None:
        vectors = vectors.where(where)
    rows = vectors.select(F.col("id").cast("long"), "vector")
    m, found = metric(by), []
    for ids, q in query_lots(queries, dim):
        found.append(rows.mapInArrow(_scan(ids, q, k, m), "query_id long, id long, distance double"))
    if not found or not dim:
        return spark.createDataFrame([], "query_id long, rank int, id long, distance double")
    near = found[0]
    for other in found[1:]:
        near = near.unionByName(other)
    return top_k(near, k)


def top_k(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of (query_id, id, distance) for each query, ranked from 0."""
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    first = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)  # in this form each task keeps k rows before the shuffle
    return first.select("query_id", (F.col("rank") - 1).alias("rank"), "id", "distance")


def radius_search(vectors: DataFrame, query: Sequence[float], radius: float, by: str | Metric = "euclidean", dim: int | None = None) -> DataFrame:
    """The rows within a distance of the query, with that distance."""
    dim = dimension(vectors) if dim is None else dim
    check_query(query, dim, 1)
    return vectors.withColumn("distance", metric(by).column(F.col("vector"), array_of(query), dim or None)).where(F.col("distance") <= radius)
