"""Snapshots: Parquet rows and a JSON line of metadata, which is written last and checked on opening."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IndexConfig
from ..errors import InvalidConfig, InvalidSnapshot
from ..functions.metrics import Metric, check_identity, metric
from ..operators.graph import GraphIndex
from ..operators.quantize import Codec
from ..table import PairedTable, VectorTable

VERSION = 1


def _write_metadata(spark: SparkSession, path: str, fields: dict) -> None:
    spark.createDataFrame([(json.dumps(fields, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def _metadata(spark: SparkSession, path: str, kind: str) -> dict:
    try:
        lines = [r[0] for r in spark.read.text(f"{path}/metadata").limit(2).collect()]
        got = json.loads(lines[0]) if len(lines) == 1 else None
    except Exception as e:  # whatever the file system or the parser says
        raise InvalidSnapshot(f"{path} has no readable metadata: {str(e).splitlines()[0]}") from e
    if not isinstance(got, dict) or got.get("kind") != kind:
        raise InvalidSnapshot(f"{path} doesn't hold a {kind}")
    if got.get("version") != VERSION:
        raise InvalidSnapshot(f"version {got.get('version')} isn't known")
    for name in ("n", "dim"):
        if not isinstance(got.get(name), int) or got[name] < 0:
            raise InvalidSnapshot(f"{name} is {got.get(name)!r}")
    return got


def _count(rows: DataFrame, n: int, what: str) -> None:
    have = rows.count()
    if have != n:
        raise InvalidSnapshot(f"{have} {what}, not {n}")


def _no_removed(table: VectorTable) -> None:
    if table.deleted_count():
        raise InvalidConfig("a table with removed rows must be compacted before it is saved")


def save(table: VectorTable, path: str) -> None:
    """Writes a table without removed rows; the path must be new."""
    _no_removed(table)
    table.rows.write.parquet(f"{path}/rows")
    _write_metadata(table.rows.sparkSession, path, {"kind": "vectors", "version": VERSION, "n": table.len(), "dim": table.dim, "metric": table.metric.id, "payload": list(table.payload)})


def load(spark: SparkSession, path: str, by: str | Metric, verify: bool = False) -> VectorTable:
    """Opens a table lazily. The metric must be that of the writer; verify also checks the number of rows and their vectors."""
    m, own = _metadata(spark, path, "vectors"), metric(by)
    check_identity(m.get("metric", 0), own)
    rows = spark.read.parquet(f"{path}/rows")
    missing = [c for c in ("id", "vector", *m["payload"]) if c not in rows.columns]
    if missing:
        raise InvalidSnapshot(f"columns {missing} are missing")
    if verify:
        _count(rows, m["n"], "rows")
        _count(rows.where(F.size("vector") == m["dim"]), m["n"], f"vectors of dimension {m['dim']}")
        _count(rows.select("id").distinct(), m["n"], "different ids")
    return VectorTable(rows, m["dim"], own, tuple(m["payload"]))


def save_pair(table: PairedTable, path: str) -> None:
    """Writes both sides of a paired table in the same rows, so that they can't differ in number."""
    _no_removed(table.a)
    _no_removed(table.b)
    table.a.rows.drop("vector").write.parquet(f"{path}/rows")
    fields = {"kind": "pair", "version": VERSION, "n": table.a.len(), "dim": table.a.dim, "dim_b": table.b.dim, "metric": table.a.metric.id, "metric_b": table.b.metric.id, "payload": list(table.a.payload[1:])}
    _write_metadata(table.a.rows.sparkSession, path, fields)


def load_pair(spark: SparkSession, path: str, by_a: str | Metric, by_b: str | Metric) -> PairedTable:
    m = _metadata(spark, path, "pair")
    a, b = metric(by_a), metric(by_b)
    check_identity(m.get("metric", 0), a)
    check_identity(m.get("metric_b", 0), b)
    rows = spark.read.parquet(f"{path}/rows")
    _count(rows, m["n"], "rows")
    return PairedTable._of(rows, (m["dim"], m["dim_b"]), (a, b), tuple(m["payload"]), None)


def save_graph(index: GraphIndex, path: str, payload: DataFrame | None = None) -> None:
    """Writes a graph, with a payload (id, ...) if there is one. A compact graph stays compact. Removed rows are refused."""
    if index.deleted is not None and not index.deleted.isEmpty():
        raise InvalidConfig("a graph with removed rows can't be saved")
    spark = index.nodes.sparkSession
    index.nodes.write.partitionBy("shard").parquet(f"{path}/nodes")
    if payload is not None:
        payload.write.parquet(f"{path}/payload")
    kept = spark.read.parquet(f"{path}/nodes")  # not built again
    top = kept.orderBy(F.desc("level"), "id").select("id", "level").first()
    fields = {"kind": "graph", "version": VERSION, "n": kept.count(), "dim": index.dim, "metric": index.metric.id, "config": json.loads(index.config.to_json()), "compact": "dists" not in index.nodes.columns, "payload": payload is not None}
    _write_metadata(spark, path, fields | {"entry_id": top[0] if top else None, "entry_level": top[1] if top else None})


def load_graph(spark: SparkSession, path: str, by: str | Metric, mutable: bool = False, verify: bool = True) -> tuple[GraphIndex, DataFrame | None]:
    """The graph and its payload. mutable refuses compact ones; verify runs the integrity counts."""
    m, own = _metadata(spark, path, "graph"), metric(by)
    check_identity(m.get("metric", 0), own)
    if mutable and m["compact"]:
        raise InvalidSnapshot("a compact graph can't be changed")
    try:
        config = IndexConfig(**m["config"])
    except TypeError as e:
        raise InvalidSnapshot(f"settings {m['config']}") from e
    nodes = spark.read.parquet(f"{path}/nodes").withColumn("shard", F.col("shard").cast("int"))
    index = GraphIndex(nodes, m["dim"], own, config, m["compact"])
    payload = spark.read.parquet(f"{path}/payload") if m["payload"] else None
    if verify:
        _count(nodes, m["n"], "nodes")
        if payload is not None:
            _count(payload, m["n"], "payload rows")
        top = nodes.where(F.col("id") == F.lit(m.get("entry_id"))).select("level").first()
        highest = nodes.agg(F.max("level")).first()[0]
        if m["n"] and (top is None or top[0] != m.get("entry_level") or highest != m.get("entry_level")):
            raise InvalidSnapshot(f"node {m.get('entry_id')} of level {m.get('entry_level')} isn't where searches begin")
        bad = {k: v for k, v in index.integrity().first().asDict().items() if v}
        if bad:
            raise InvalidSnapshot(f"the graph is broken: {bad}")
    return index, payload


def save_codes(rows: DataFrame, codec: Codec, path: str) -> None:
    """Writes codes (id, codes, scale) with a checksum that doesn't depend on the rows' order."""
    rows.write.parquet(f"{path}/rows")
    kept = rows.sparkSession.read.parquet(f"{path}/rows")
    n, check = kept.agg(F.count("*"), F.sum(F.crc32(F.concat(F.col("id").cast("string").cast("binary"), "codes")))).first()
    _write_metadata(rows.sparkSession, path, {"kind": "codes", "n": n, "dim": codec.dim, "crc": int(check or 0)} | codec.metadata())


def load_codes(spark: SparkSession, path: str, verify: bool = False) -> tuple[DataFrame, Codec]:
    """Codes and their codec; verify checks number, row width and checksum."""
    m = _metadata(spark, path, "codes")
    codec = Codec(m["dimensions"], m["bits"], m["metric"], m["seed"])
    if codec.metadata() != {k: m.get(k) for k in codec.metadata()}:
        raise InvalidSnapshot("the codec's metadata contradict each other")
    rows = spark.read.parquet(f"{path}/rows")
    if verify:
        n, check, odd = rows.agg(F.count("*"), F.sum(F.crc32(F.concat(F.col("id").cast("string").cast("binary"), "codes"))), F.count_if(F.octet_length("codes") != codec.row_bytes)).first()
        if n != m["n"] or int(check or 0) != m["crc"] or odd:
            raise InvalidSnapshot(f"{n} rows of {m['n']}, {odd} of a wrong width, checksum {check} for {m['crc']}")
    return rows, codec
