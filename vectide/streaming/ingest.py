"""Vectors that arrive as a stream: micro-batches appended to a stored table, and standing queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import InvalidSnapshot
from ..functions.metrics import Metric, metric
from ..operators import search
from ..table import checked


def append_stream(stream: DataFrame, path: str, dim: int, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends rows (id, vector, ...) of a stream to the Parquet table at the path; each batch is a folder of its own, so
    that a repeated batch replaces what it wrote before. Bad vectors stop the stream."""

    def write(batch: DataFrame, epoch: int) -> None:
        checked(batch, "vector", dim).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def appended(spark: SparkSession, path: str) -> DataFrame:
    """The table so far. Of rows with the same id the one of the latest batch counts."""
    try:
        rows = spark.read.parquet(path)
    except Exception as e:
        raise InvalidSnapshot(f"{path}: nothing was appended yet") from e
    latest = rows.groupBy("id").agg(F.max("batch").alias("batch"))
    return rows.join(latest, ["id", "batch"]).drop("batch")


def standing_radius(stream: DataFrame, query: list[float], radius: float, by: str | Metric = "euclidean") -> DataFrame:
    """The rows of a stream within a distance of a fixed query, with that distance, as they arrive."""
    d = metric(by).column(F.col("vector"), search.array_of(query), len(query))
    return stream.withColumn("distance", d).where(F.col("distance") <= radius)
