"""Connected components by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

#: Edges that one task takes at once, some 16 MB.
FEW = 1 << 20


def forest_edges(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the given edges: every node with the smallest node it reaches."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)].tolist(), flat[len(u) :].tolist()
    parent = list(range(len(nodes)))
    for x, y in zip(a, b):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    for i, p in enumerate(parent):  # a parent has a smaller index, so its root is known
        parent[i] = parent[p]
    root = np.asarray(parent)
    apart = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[apart], nodes[root[apart]]


def _whole_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cols = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if cols:
        u, v = forest_edges(*(np.concatenate(x) for x in zip(*cols)))
        one = np.unique(v)  # the roots are nodes too
        yield pa.RecordBatch.from_arrays([pa.array(np.append(u, one)), pa.array(np.append(v, one))], names=["node", "component"])


def _contract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for b in batches:
        if b.num_rows:
            held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)))
            rows += b.num_rows
        if rows > 1_000_000:  # holds memory down; what is left is one edge a node
            held = [forest_edges(*(np.concatenate(x) for x in zip(*held)))]
            rows = len(held[0][0])
            if rows > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], names=["u", "v"])
                held, rows = [], 0
    if held:
        u, v = forest_edges(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def local_forest(edges: DataFrame) -> DataFrame:
    """Replaces the edges (u, v) within each partition by a spanning star forest: at most one edge for each node."""
    return edges.mapInArrow(_contract_batches, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (u, v): component is the smallest node that it reaches.

    Each round points every node to its smallest neighbour, shortens the paths by doubling, and relabels the edges; as
    every node points to a smaller one, roots are the smallest of their trees. Rounds are about the logarithm of the
    longest path. A hub only meets sums (min) and joins whose other side has unique keys. Null ends and loops are
    dropped; no edges give no rows. Each round is written to the shared folder. Once FEW edges or fewer are left, one task
    takes them all.
    """
    spark = edges.sparkSession
    edges = edges.where("u is not null and v is not null and u <> v")
    edges = cut(local_forest(edges).distinct(), "edges")
    labels = None
    while count := edges.count():
        if count <= FEW:
            last = cut(edges.coalesce(1).mapInArrow(_whole_forest, "node long, component long"), "labels")
            drop(edges)
            if labels is None:
                return last
            step = last.select(F.col("node").alias("component"), F.col("component").alias("next"))
            moved = cut(labels.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "labels")
            drop(labels)
            drop(last)
            return moved
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("to"))
        to = cut(to, "hook")
        for _ in range(2):
            up = to.select(F.col("u").alias("to"), F.col("to").alias("up"))
            shorter = cut(to.join(up, "to").select("u", F.col("up").alias("to")), "hook")
            drop(to)
            to = shorter
        mine = to.select("u", F.col("to").alias("tu"))
        other = to.select(F.col("u").alias("v"), F.col("to").alias("tv"))
        left = edges.join(mine, "u").join(other, "v").where("tu <> tv")
        left = local_forest(left.select(F.greatest("tu", "tv").alias("u"), F.least("tu", "tv").alias("v")).distinct())
        after = cut(left, "edges")
        drop(edges)
        edges = after
        if labels is None:
            labels = to.select(F.col("u").alias("node"), F.col("to").alias("component"))
        else:
            step = to.select(F.col("u").alias("component"), F.col("to").alias("next"))
            moved = cut(labels.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "labels")
            drop(labels)
            drop(to)
            labels = moved
    drop(edges)
    return spark.createDataFrame([], "node long, component long") if labels is None else labels
