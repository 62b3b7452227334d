"""Tables of vectors with payloads, soft deletes and pairs of embedding spaces. All operations return new tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .errors import DesynchronizedPair, DimensionMismatch, IdOutOfBounds, InvalidConfig, ReadOnly
from .functions.metrics import Metric, metric
from .operators import search

#: Rows numbered in one task when ids are made dense, about.
NUMBERING = 1 << 16


def dense_ids(rows: DataFrame, order: str, name: str) -> DataFrame:
    """rows with a dense number from 0 in the order of a long column of different values, none of them null.

    The values' span is cut into ranges of equal width, so wide that evenly spread values make NUMBERING rows each; ranges
    are counted, their starts summed, and rows numbered within them.
    """
    n, low, high = rows.agg(F.count("*"), F.min(order), F.max(order)).first()
    bits = max(0, ((high - low + 1) * NUMBERING // max(n, 1)).bit_length() - 1) if n else 0
    r = F.shiftright(F.col(order).cast("long"), min(bits, 63))
    sizes = rows.groupBy(r.alias("__range")).agg(F.count("*").alias("__n"))
    w = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    starts = sizes.select("__range", (F.sum("__n").over(w) - F.col("__n")).alias("__start"))
    inner = rows.withColumn("__range", r).withColumn("__i", F.row_number().over(Window.partitionBy("__range").orderBy(order)) - 1)
    return inner.join(starts, "__range").withColumn(name, F.col("__start") + F.col("__i")).drop("__range", "__start", "__i")


def checked(vectors: DataFrame, column: str, dim: int) -> DataFrame:
    """Fails the job on a vector that is null, of another dimension or not finite."""
    v = F.col(column)
    bad = v.isNull() | (F.size(v) != dim) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kind = vectors.schema[column].dataType.simpleString()
    return vectors.withColumn(column, F.when(bad, F.raise_error(F.lit(f"a vector is null, not finite or not of dimension {dim}")).cast(kind)).otherwise(v))


@dataclass(frozen=True)
class VectorTable:
    """rows: (id, vector, payload columns ...). deleted: (id) of removed rows, which keep their slot until compacted."""

    rows: DataFrame
    dim: int
    metric: Metric
    payload: tuple[str, ...] = ()
    deleted: DataFrame | None = None
    read_only: bool = False

    @classmethod
    def create(cls, vectors: DataFrame, metric: str | Metric = "euclidean", id: str | None = None, vector: str = "vector", payload: Sequence[str] | None = None, order: str | None = None) -> VectorTable:
        """A table of a DataFrame. Without an id column rows are numbered by the long column order."""
        if id is None:
            if order is None:
                raise InvalidConfig("rows need an id column, or an order to number them by")
            vectors, id = dense_ids(vectors, order, "__id"), "__id"
        names = [c for c in vectors.columns if c not in (id, vector)] if payload is None else list(payload)
        rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"), *names)
        dim = search.dimension(rows)
        if dim == 0 and rows.select("vector").where("vector is not null").limit(1).count():
            raise DimensionMismatch(1, 0)
        return cls(checked(rows, "vector", dim), dim, globals()["metric"](metric), tuple(names))

    # what is there

    @property
    def live(self) -> DataFrame:
        return self.rows if self.deleted is None else self.rows.join(self.deleted, "id", "left_anti")

    def len(self) -> int:
        """Slots, removed ones included."""
        return self.rows.count()

    def deleted_count(self) -> int:
        return 0 if self.deleted is None else self.deleted.count()

    def live_len(self) -> int:
        return self.len() - self.deleted_count()

    def is_empty(self) -> bool:
        return self.rows.isEmpty()

    def introspect(self) -> DataFrame:
        """One row: n, deleted, live, dim, metric."""
        gone = self.deleted_frame().agg(F.count("*").alias("deleted"))
        n = self.rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim"))
        return n.join(F.broadcast(gone)).select("n", "deleted", (F.col("n") - F.col("deleted")).alias("live"), "dim", F.lit(self.metric.name).alias("metric"))

    def deleted_frame(self) -> DataFrame:
        return self.rows.sparkSession.createDataFrame([], "id long") if self.deleted is None else self.deleted

    def get(self, id: int) -> DataFrame:
        """The row of an id, removed or not; an error if there is none."""
        row = self.rows.where(F.col("id") == id)
        if row.isEmpty():
            raise IdOutOfBounds(id, self.len())
        return row

    # searches

    def search(self, query: Sequence[float], k: int, where: Column | str | None = None) -> DataFrame:
        """rank, id, distance, payload and vector of the k nearest live rows; where sees id and the payload columns."""
        near = search.exact_search(self.live, query, k, self.metric, where, self.dim)
        return near.select("rank", "id", "distance", *self.payload, "vector")

    def knn_join(self, queries: DataFrame, k: int, where: Column | str | None = None) -> DataFrame:
        return search.knn_join(queries, self.live, k, self.metric, where, self.dim)

    # changes

    def _writable(self) -> None:
        if self.read_only:
            raise ReadOnly("the table is frozen")

    def insert(self, vectors: DataFrame, order: str) -> VectorTable:
        """Appends rows (vector, payload ...), numbered behind the last id by the long column order. All or none go in."""
        self._writable()
        dim = self.dim or search.dimension(vectors)
        last = self.rows.agg(F.max("id")).first()[0]
        new = dense_ids(checked(vectors, "vector", dim), order, "id").withColumn("id", F.col("id") + (0 if last is None else last + 1))
        return replace(self, rows=self.rows.unionByName(new.select("id", "vector", *self.payload)), dim=dim)

    def remove(self, ids: DataFrame) -> tuple[VectorTable, DataFrame]:
        """Marks rows (id) as removed; also (id, changed), changed being false for those removed before. Unknown ids are errors."""
        self._writable()
        ids = ids.select(F.col("id").cast("long")).distinct()
        self._known(ids)
        gone = self.deleted_frame()
        told = ids.join(gone.withColumn("__was", F.lit(True)), "id", "left").select("id", F.col("__was").isNull().alias("changed"))
        return replace(self, deleted=gone.union(told.where("changed").select("id"))), told

    def restore(self, ids: DataFrame) -> tuple[VectorTable, DataFrame]:
        """Takes marks back; also (id, changed)."""
        self._writable()
        ids = ids.select(F.col("id").cast("long")).distinct()
        self._known(ids)
        gone = self.deleted_frame()
        told = ids.join(gone.withColumn("__was", F.lit(True)), "id", "left").select("id", F.col("__was").isNotNull().alias("changed"))
        return replace(self, deleted=gone.join(ids, "id", "left_anti")), told

    def _known(self, ids: DataFrame) -> None:
        odd = ids.join(self.rows, "id", "left_anti").first()
        if odd is not None:
            raise IdOutOfBounds(odd[0], self.len())

    def is_deleted(self, id: int) -> bool:
        self.get(id)
        return not self.deleted_frame().where(F.col("id") == id).isEmpty()

    def compacted(self) -> tuple[VectorTable, DataFrame]:
        """The live rows numbered anew without gaps, in the old order, and (new_id, old_id)."""
        self._writable()
        new = dense_ids(self.live, "id", "new_id")
        rows = new.select(F.col("new_id").alias("id"), "vector", *self.payload)
        return replace(self, rows=rows, deleted=None), new.select("new_id", F.col("id").alias("old_id"))

    def frozen(self) -> VectorTable:
        return replace(self, read_only=True)


@dataclass(frozen=True)
class PairedTable:
    """Rows with a vector in each of two spaces: (id, emb_a, emb_b, payload ...). No distance joins the spaces."""

    a: VectorTable
    b: VectorTable

    @classmethod
    def create(cls, vectors: DataFrame, a: str, b: str, metric_a: str | Metric = "euclidean", metric_b: str | Metric = "euclidean", id: str = "id", payload: Sequence[str] = ()) -> PairedTable:
        rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(a).alias("emb_a"), F.col(b).alias("emb_b"), *payload)
        dims = [search.dimension(rows, c) for c in ("emb_a", "emb_b")]
        rows = checked(checked(rows, "emb_a", dims[0]), "emb_b", dims[1])
        return cls._of(rows, dims, (metric(metric_a), metric(metric_b)), tuple(payload), None)

    @classmethod
    def _of(cls, rows: DataFrame, dims: Sequence[int], metrics: Sequence[Metric], payload: tuple[str, ...], deleted: DataFrame | None) -> PairedTable:
        side = lambda own, other, i: VectorTable(rows.withColumn("vector", F.col(own)), dims[i], metrics[i], (other, *payload), deleted)
        return cls(side("emb_a", "emb_b", 0), side("emb_b", "emb_a", 1))

    def search_by_a(self, query: Sequence[float], k: int, where: Column | str | None = None) -> DataFrame:
        """The nearest in the first space, with both vectors."""
        return self.a.search(query, k, where).withColumnRenamed("vector", "emb_a")

    def search_by_b(self, query: Sequence[float], k: int, where: Column | str | None = None) -> DataFrame:
        return self.b.search(query, k, where).withColumnRenamed("vector", "emb_b")

    def insert(self, vectors: DataFrame, order: str) -> PairedTable:
        """Appends rows (emb_a, emb_b, payload ...) to both sides; both vectors are checked first."""
        rows = self.a.rows.drop("vector")
        last = rows.agg(F.max("id")).first()[0]
        new = checked(checked(vectors, "emb_a", self.a.dim or search.dimension(vectors, "emb_a")), "emb_b", self.b.dim or search.dimension(vectors, "emb_b"))
        new = dense_ids(new, order, "id").withColumn("id", F.col("id") + (0 if last is None else last + 1)).select(*rows.columns)
        return self._of(rows.unionByName(new), (self.a.dim, self.b.dim), (self.a.metric, self.b.metric), self.a.payload[1:], self.a.deleted)

    def remove(self, ids: DataFrame) -> tuple[PairedTable, DataFrame]:
        a, told = self.a.remove(ids)
        return PairedTable(a, replace(self.b, deleted=a.deleted)), told

    def restore(self, ids: DataFrame) -> tuple[PairedTable, DataFrame]:
        a, told = self.a.restore(ids)
        return PairedTable(a, replace(self.b, deleted=a.deleted)), told

    def compacted(self) -> tuple[PairedTable, DataFrame]:
        """Both sides numbered anew; an error if their removed rows differ."""
        a, b = self.a.deleted_frame(), self.b.deleted_frame()
        if not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()):
            raise DesynchronizedPair("the two sides have different removed rows")
        new, ids = self.a.compacted()
        return self._of(new.rows.withColumnRenamed("vector", "emb_a"), (self.a.dim, self.b.dim), (self.a.metric, self.b.metric), self.a.payload[1:], None), ids
