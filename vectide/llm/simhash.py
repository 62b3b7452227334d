"""SimHash near-duplicates: segment popcounts embed fingerprints in a grid where Manhattan distance bounds Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release
from .components import components

#: Two-bit segments, so that a fingerprint is a point of {0, 1, 2}^32; two groups of 16 segments make two grids.
SEGMENT_BITS, GROUP_SEGMENTS = 2, 16
#: A cell with more distinct fingerprints than this is joined through shared neighbours instead of pairwise.
CELL_PAIRS = 128
#: The links wanted: this many differing bits or fewer. The grids below are made for it.
MAX_BITS = 2


def shingle_hashes(text: bytes, words: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle of a lower-cased text; one of all words if there are fewer; none for no words."""
    w = text.lower().split()
    h = xxhash.xxh64_intdigest
    if len(w) < words:
        return np.array([h(b" ".join(w), 42)] if w else [], dtype=np.uint64)
    if words == 3:
        return np.array([h(p + b" " + q + b" " + r, 42) for p, q, r in zip(w, w[1:], w[2:])], dtype=np.uint64)
    return np.array([h(b" ".join(w[i : i + words]), 42) for i in range(len(w) - words + 1)], dtype=np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [simhash(shingle_hashes(x.as_py() or b"", words)) for x in b.column(1)]
            f = np.array(got, dtype=np.uint64)
            grid = f - ((f >> np.uint64(1)) & np.uint64(0x5555555555555555))  # popcounts of the segments, side by side
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.view(np.int64)), pa.array(grid.view(np.int64))], names=["doc_id", "fp", "grid"])
        release()

    return run


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, grid) of every whole text: fp is the SimHash as a signed long, grid its 32 segment popcounts at two bits each.

    A null text counts as empty, an empty one has fingerprint zero. Rows are kept as they are, repeats and null ids included.
    """
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("t")).mapInArrow(
        _fingerprints(words), "doc_id long, fp long, grid long"
    )


def popcounts(fp: Column) -> Column:
    """The 32 segment popcounts of fingerprints (long) at two bits each: grid, as fingerprints() has it."""
    odd = F.lit(0x5555555555555555)
    up = F.shiftrightunsigned(fp, 1)
    both = F.shiftleft(fp.bitwiseAND(up).bitwiseAND(odd), 1)
    return both.bitwiseOR(fp.bitwiseXOR(up).bitwiseAND(odd))


def _cells(points: DataFrame, probes: bool) -> DataFrame:
    """The grid cell of each point in each group; with probes also the cells one step up.

    Of two fingerprints with two differing bits or fewer, the popcounts of one group differ by one at most in all, so
    one of them finds the other in its own cell or one step up from it.
    """
    low, high = F.col("grid").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("grid", 32)
    out = []
    for g, v in ((0, low), (1, high)):
        out.append(F.struct(F.lit(2 * g).alias("g"), v.alias("cell")))
        if probes:
            for s in range(GROUP_SEGMENTS):
                below = v.bitwiseAND(F.lit(2 << (2 * s))) == 0  # popcount 0 or 1
                out.append(F.when(below, F.struct(F.lit(2 * g + 1).alias("g"), (v + F.lit(1 << (2 * s))).alias("cell"))))
    cells = points.select("fp", "rep", F.explode(F.array_compact(F.array(*out))).alias("x"))
    return cells.select(F.expr("x.g div 2").alias("g"), "x.cell", (F.col("x.g") % 2 == 1).alias("probe"), "fp", "rep")


def links(points: DataFrame) -> DataFrame:
    """Edges (u, v) of representatives that connect all fingerprints of distinct points (fp, grid, rep) within two bits.

    Grid range-join: cells meet under the Manhattan bound, and the exact bit count is part of the join. In cells with
    over CELL_PAIRS points the links run through common neighbours: two fingerprints are within two bits exactly if some
    value is within one bit of both, so all points around such a value (65 at most) are linked with the smallest of
    them. That is exact too and makes 65 rows a point, not pairs.
    """
    home, every = _cells(points, False), _cells(points, True)
    full = home.groupBy("g", "cell").count().where(F.col("count") > CELL_PAIRS).select("g", "cell")
    b = home.join(full, ["g", "cell"], "left_anti").select("g", "cell", F.col("fp").alias("fp2"), F.col("rep").alias("v"))
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= MAX_BITS) & (F.col("probe") | (F.col("fp") < F.col("fp2")))
    pairs = every.alias("a").join(b.alias("b"), (F.col("a.g") == F.col("b.g")) & (F.col("a.cell") == F.col("b.cell")) & near).select(F.col("rep").alias("u"), "v")
    crowded = every.join(full, ["g", "cell"], "left_semi").select("fp", "rep").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(v - (1 << 64) if v >> 63 else v) for v in (1 << i for i in range(64))])
    around = crowded.select("rep", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("z"))
    stars = around.groupBy("z").agg(F.collect_set("rep").alias("all"), F.min("rep").alias("v")).where(F.size("all") > 1)
    stars = stars.select(F.explode("all").alias("u"), "v").where("u <> v")
    return pairs.unionByName(stars)


def simhash_groups(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text, ...): near-duplicate groups by SimHash.

    Documents link at two differing bits or fewer; component_id is the smallest doc_id reachable. Equal fingerprints are
    collapsed first. A row whose doc_id is null gets the group of its fingerprint, or null if no document that has an id
    shares it. No rows give no rows. Other columns of docs are ignored.
    """
    fp = cut(fingerprints(docs, words), "simhash")
    points = cut(fp.groupBy("fp", "grid").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "points")
    comp = components(links(points))
    group = points.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fp.select("doc_id", "fp").join(group, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 3) -> DataFrame:
    """The rows of docs without those whose group has a document with a smaller id; of repeated rows of an id one stays.

    Rows with a null doc_id stay.
    """
    return keep_smallest(docs, simhash_groups(docs, words))


def keep_smallest(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """keep_one() for groups (doc_id, component_id) of any kind."""
    gone = groups.where("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct()
    left = docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
    named = left.where("doc_id is not null").dropDuplicates(["doc_id"])
    return named.unionByName(left.where("doc_id is null"))
