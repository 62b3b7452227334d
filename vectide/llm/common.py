"""Shared plumbing of the corpus operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what spark.checkpoint.dir names. Only a local master may lack it; a folder of this process is then set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vectide-"))
    return spark.sparkContext.getCheckpointDir()


_scopes: list[set[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/vectide-{name}-{uuid.uuid4().hex}"
    for made in _scopes:
        made.add(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[set[str]]:
    """The paths of the tables that are made inside; those that are still in it at the end are deleted."""
    made: set[str] = set()
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes[:] = [x for x in _scopes if x is not made]
        for path in made:
            delete(spark, path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder and returns a scan of them, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes a table made by cut() that no plan needs any more."""
    spark = df.sparkSession
    paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for p in paths:
        if "/vectide-" in p:
            delete(spark, p)


def _parquet_scan(df: DataFrame) -> bool:
    """Whether df is nothing but whole Parquet files."""
    plan = df._jdf.queryExecution().analyzed()
    return plan.getClass().getSimpleName() == "LogicalRelation" and plan.simpleString(100).rstrip().lower().endswith("parquet")


def _file_order(path: str) -> list[str | int]:
    """Sorts by the numbers in paths as numbers, as Spark numbers the files that it writes."""
    return [int(x) if x.isdecimal() else x for x in re.split(r"([0-9]+)", path)]


def numbered(df: DataFrame, names: list[str], place: str) -> DataFrame:
    """The columns of those names and the place of each row, from 0 without gaps, in the order in which the rows are.

    Rows of Parquet files are in the order of the files and in that of the rows in each, however a scan deals them out.
    Others are written to the shared folder first, in the order of their partitions. What the driver holds is a count for
    each file.
    """
    if not _parquet_scan(df):
        df = cut(df.select(*quoted(names)), "ordered")
    at = df.metadataColumn("_metadata")
    counts = df.select(at["file_path"].alias("file")).groupBy("file").agg(F.count("*").alias("n")).collect()
    ahead, total = [], 0
    for r in sorted(counts, key=lambda r: _file_order(r["file"])):
        ahead.append((r["file"], total))
        total += r["n"]
    file, row, b_file, b_n = (free_name(df, x) for x in ("__file", "__row", "__b_file", "__b_n"))
    before = df.sparkSession.createDataFrame(ahead, f"{b_file} string, {b_n} long")
    rows = df.select(*quoted(names), at["file_path"].alias(file), at["row_index"].alias(row))
    return rows.join(F.broadcast(before), F.col(file) == F.col(b_file)).select(*quoted(names), (F.col(b_n) + F.col(row)).alias(place))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, whatever the case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def quoted(names: list[str]) -> list[Column]:
    """Columns by their exact names, dots and all."""
    return [F.col("`" + x.replace("`", "``") + "`") for x in names]


def row_hash(df: DataFrame) -> Column:
    """XXH64 of a row, without columns that hold maps, which have no hash."""
    return F.xxhash64(*quoted([f.name for f in df.schema if "map<" not in f.dataType.simpleString()]))


def map_arrow(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """df.mapInArrow() for columns of any names, with dots and backticks too; run must go by places."""
    names = [f"c{i}" for i in range(len(schema))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=names)

    plain = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, schema)])
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(renamed, plain).toDF(*[f.name for f in schema])


def parts(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in stretches that have about so many bytes in a column of strings, and a row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: str = "4m") -> bool:
    """From now on rows go to Python workers in batches of so many bytes and a row more; tells whether that is new.

    Without a bound 10,000 rows are a batch, whatever they hold, of which executor and worker have copies. A bound that the
    session has stays.
    """
    new = spark.conf.get(BATCH_BYTES, None) is None
    if new:
        spark.conf.set(BATCH_BYTES, most)
    return new


def release() -> None:
    """Gives memory that Arrow and the allocator hold for later back, so that workers that wait don't keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
