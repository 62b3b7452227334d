"""Near-duplicates by similarity of word-shingle sets: the SimHash grid, then shared rare shingles, find the pairs; set intersection verifies them.

The grid of popcounts finds the sets whose fingerprints are within two bits. It can't find all similar ones: at similarity
0.8 about 10 of 64 bits differ, up to 24 by chance, and a grid join of that radius opens a third of all pairs. So what the
grid leaves apart meets in the shingles that any similar sets must share, and SimHash decides there which are worth comparing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, parts, release
from .components import components
from .simhash import keep_smallest, popcounts, simhash
from .simhash import links as grid_links

#: Where more sets than this meet, those that are not connected yet are compared in one place instead of as pairs of rows;
#: where more than BLOCK, in several places, each for two blocks of them.
PAIRS, BLOCK = 64, 4096
#: Pairs with more differing SimHash bits aren't verified; at similarity 0.8 about 10 differ, with a deviation of 3. Sets of
#: fewer members are verified whatever their bits.
BITS, FEW = 24, 8
#: Common shingles go last in the prefix order: those that occur in so many texts of one in so many, the most frequent MOST of
#: them. Any order is right; this one makes few sets meet.
COMMON, SAMPLED, MOST = 4, 16, 2_000_000
#: So many hashes of wanted texts are broadcast; more are joined by a shuffle of the texts.
WANTED = 4_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """The distinct hashes, ascending, of the word shingles of a lower-cased text; one of all words if there are fewer."""
    w = (text or b"").lower().split()
    if len(w) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)] if w else [], dtype="<u8")
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    x = np.zeros(len(w) - words + 1, dtype=np.uint64)
    for k in range(words):
        x = (x ^ h[k : k + len(x)]) * _ODD
        x ^= x >> np.uint64(29)
    return np.unique(x).astype("<u8")


def _set_id(members: np.ndarray) -> int:
    x = xxhash.xxh64_intdigest(members.tobytes(), 7)
    return x - (1 << 64) if x >> 63 else x


def _shingles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b, 0):
                all_h = [shingle_set(x.as_py(), words) for x in part.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(all_h).view("<i8"))], names=["h"])

    return run


def _whole(words: int):
    """Texts to the number of their set and half of each hash in it, which is enough to compare two sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b, 0):
                got = [shingle_set(x.as_py(), words) for x in part.column(0)]
                halves = [np.unique((x >> np.uint64(32)).astype("<u4")).tobytes() for x in got]
                yield pa.RecordBatch.from_arrays([pa.array([_set_id(x) for x in got], pa.int64()), pa.array(halves, pa.binary())], names=["set_id", "shingles"])
        release()

    return run


def needed(n: int, similarity: float) -> int:
    """Members that a set of n must share with any set that is similar enough."""
    return math.ceil(similarity * n - 1e-9)


def _prefixes(words: int, similarity: float, often: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = often.value
        for b in batches:
            for part in parts(b, 2):
                ids, sizes, fps, keys = [], [], [], []
                for x in part.column(2):
                    h = shingle_set(x.as_py(), words)
                    ids.append(_set_id(h)), sizes.append(len(h)), fps.append(simhash(h))
                    late = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h if len(common) else np.zeros(len(h), bool)
                    keys.append(np.concatenate([h[~late], h[late]])[: len(h) - needed(len(h), similarity) + 1 if len(h) else 0].view("<i8"))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), lists], names=["doc_id", "t", "set_id", "n", "fp", "keys"])
        release()

    return run


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of rows that are sorted by the first one, in stretches that hold all rows of their keys."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [x.to_numpy(zero_copy_only=False) for x in b.columns]
        last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last key may go on
        if last or (held and held[-1][0][-1] != cols[0][0]):
            whole = held + [[x[:last] for x in cols]]
            yield tuple(np.concatenate(x) for x in zip(*whole))
            held = []
        held.append([x[last:] for x in cols])
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _fit(n: np.ndarray, fp: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float, bits: int) -> np.ndarray:
    """Whether the sets at a and b may be similar, by their sizes and SimHash bits."""
    small = np.minimum(n[a], n[b])
    return (small >= similarity * np.maximum(n[a], n[b]) - 1e-9) & ((small < FEW) | (np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64)) <= bits))


def _majority(fps: np.ndarray) -> np.ndarray:
    """For rows of fingerprints the one that has each bit that most of them have."""
    groups, m = fps.shape
    ones = np.zeros((groups, 64), dtype=np.int64)
    for at in range(0, m, 1 << 16):
        part = np.ascontiguousarray(fps[:, at : at + (1 << 16)]).view(np.uint8).reshape(groups, -1, 8)
        ones += np.unpackbits(part, axis=2).sum(axis=1, dtype=np.int64)
    return np.packbits(2 * ones > m, axis=1).view(fps.dtype).ravel()


def _stars(similarity: float, bits: int):
    """From rows (key, set_id, n, fp) sorted by key: (u, v, key, m, near), each of the m sets of a key with their leader v.

    The leader is the set whose fingerprint is nearest to the bits that most have, so that the original of many altered
    copies leads wherever it is. Pairs that can't be similar aren't near; where only two meet they are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, n, fp in _by_key(batches):
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(first, len(key)))
            for m in np.unique(size[size > 1]).tolist():
                same = first[size == m]
                for at in np.array_split(same, max(1, len(same) * m // 50_000)):
                    i = at[:, None] + np.arange(m)
                    far = np.bitwise_count((fp[i] ^ _majority(fp[i])[:, None]).view(np.uint64)).astype(np.uint64)
                    mixed = node[i].view(np.uint64) * _ODD
                    lead = np.argmin(far << np.uint64(56) | mixed >> np.uint64(8), axis=1)
                    u = i[np.arange(m) != lead[:, None]]
                    v = np.repeat(i[np.arange(len(at)), lead], m - 1)
                    near = _fit(n, fp, u, v, similarity, bits)
                    if m == 2:
                        u, v, near = u[near], v[near], near[near]
                    if len(u):
                        yield pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v]), pa.array(key[u], mask=np.full(len(u), m == 2)), pa.array(np.full(len(u), m, np.int32)), pa.array(near)], names=["u", "v", "key", "m", "near"])
        release()

    return run


def _cross_pairs(similarity: float, bits: int):
    """From rows (key, set_id, n, fp, component) sorted by key: (u, v), pairs of different components that may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, n, fp, comp in _by_key(batches):
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(first, len(key)))
            for m in np.unique(size).tolist():
                i, j = np.triu_indices(m, 1)
                same = first[size == m]
                for at in np.array_split(same, max(1, len(same) * len(i) // 500_000)):
                    a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                    ok = (comp[a] != comp[b]) & _fit(n, fp, a, b, similarity, bits)
                    if ok.any():
                        u, v = node[a[ok]], node[b[ok]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])
        release()

    return run


def connecting(n: np.ndarray, comp: np.ndarray, block: np.ndarray, before: list[np.ndarray], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (places) that connect the components of sets (distinct shingles) as all links between them do.

    Overlaps are counted through lists of the sets that have a shingle. Sets of one block are only compared if all are of
    one; sets that share one of the keys before are compared where that is the key.
    """
    m = len(n)
    lengths = np.array([len(x) for x in sets])
    offset = np.concatenate([[0], np.cumsum(lengths)])
    _, of = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), lengths)[np.argsort(of, kind="stable")]
    start = np.concatenate([[0], np.cumsum(np.bincount(of))])
    names, own, counts = np.unique(comp, return_inverse=True, return_counts=True)
    main, joined = counts.argmax(), np.arange(len(names))
    have: dict[int, np.ndarray] = {}
    for i, keys in enumerate(before):
        for k in keys.tolist():
            have.setdefault(k, np.zeros(m, dtype=bool))[i] = True
    apart = block.min() != block.max()
    out = []
    for a in np.flatnonzero(own != main):
        may = (joined[own] != joined[own[a]]) & (np.minimum(n, n[a]) >= similarity * np.maximum(n, n[a]) - 1e-9) & ((own == main) | (np.arange(m) < a))
        if apart:
            may &= block != block[a]
        for k in before[a].tolist():
            may &= ~have[k]
        if not may.any():
            continue
        at = of[offset[a] : offset[a + 1]]
        both = np.bincount(np.concatenate([owner[start[x] : start[x + 1]] for x in at.tolist()]), minlength=m)
        for b in np.flatnonzero(may & (both >= similarity * (lengths + lengths[a] - both) - 1e-9)):
            if joined[own[a]] != joined[own[b]]:
                joined[joined == joined[own[b]]] = joined[own[a]]
                out.append((int(a), int(b)))
    return out


def _dense(similarity: float):
    """connecting() for the sets (set_id, n, component, block, before, shingles) of a key and two of its blocks."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("set_id")
        node = rows["set_id"].to_numpy()
        before = [np.array(x, dtype=np.int64) for x in rows["before"].to_pylist()]
        sets = [np.frombuffer(x, "<u4") for x in rows["shingles"].to_pylist()]
        got = connecting(rows["n"].to_numpy(), rows["component"].to_numpy(), rows["block"].to_numpy(), before, sets, similarity)
        u, v = (np.array([node[x[i]] for x in got], dtype=np.int64) for i in (0, 1))
        del sets
        release()
        return pa.table({"u": np.maximum(u, v), "v": np.minimum(u, v)})

    return run


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                p, q = np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4")
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["u", "v"])
        release()

    return run


def on_grid(sizes: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets (set_id, fp) whose fingerprints the SimHash grid links, with u > v.

    Sets of equal fingerprints pair with the smallest of them, and that one with those of other fingerprints.
    """
    points = cut(sizes.groupBy("fp").agg(F.min("set_id").alias("rep")).withColumn("grid", popcounts(F.col("fp"))), "points")
    other = grid_links(points).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    same = sizes.join(points, "fp").where("set_id <> rep").select(F.col("set_id").alias("u"), F.col("rep").alias("v"))
    return other.unionByName(same)


def links(sets: DataFrame, texts: DataFrame, words: int, similarity: float, bits: int) -> DataFrame:
    """Edges (u, v) of set_ids that connect the similar ones of sets (t, set_id, n, fp, keys), made of texts (t, text).

    The pairs that the grid links are compared first. Others need not be within its radius, but two sets of Jaccard
    similarity s share a member among the first n - ceil(s n) + 1 of each, the keys, in any order of all members. All that
    meet in a key are compared with a leader, so that a cluster of many alike sets makes rows in proportion to their number.
    Then all pairs that aren't connected yet are compared: as rows, if they aren't over so many SimHash bits apart, or,
    where over PAIRS sets meet, by counting their overlaps in one place, so that many sets that are almost similar make no
    pairs. Every link is verified on the whole sets.
    """
    sizes = cut(sets.groupBy("set_id").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.min("t").alias("t")), "sizes")

    def whole(wanted: DataFrame) -> DataFrame:
        """(set_id, shingles) of the wanted sets (set_id)."""
        hashes = cut(wanted.distinct().join(sizes, "set_id").select("t"), "wanted")
        some = texts.join(F.broadcast(hashes) if hashes.count() <= WANTED else hashes, "t", "left_semi").dropDuplicates(["t"]).select("text")
        out = cut(some.mapInArrow(_whole(words), "set_id long, shingles binary"), "whole")
        drop(hashes)
        return out

    def verify(pairs: DataFrame) -> DataFrame:
        ends = cut(pairs, "ends")
        both = whole(ends.select(F.col("u").alias("set_id")).union(ends.select("v")))
        p = both.select(F.col("set_id").alias("v"), F.col("shingles").alias("q"))
        o = both.select(F.col("set_id").alias("u"), F.col("shingles").alias("p"))
        like = cut(ends.join(p, "v").join(o, "u").select("u", "v", "p", "q").mapInArrow(_verified(similarity), "u long, v long"), "like")
        drop(ends)
        drop(both)
        return like

    def unlinked(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """The pairs (u, v) that aren't connected yet."""
        of = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias("c" + x))
        return pairs.join(of("u"), "u", "left").join(of("v"), "v", "left").where("coalesce(cu, u) <> coalesce(cv, v)")

    near = cut(on_grid(sizes), "near")
    gridded = verify(near.groupBy("u").agg(F.min("v").alias("v")))  # connects most, so that few of many alike sets' links are left
    gridded = gridded.unionByName(verify(unlinked(near, components(gridded)).select("u", "v")))
    joined = components(gridded)
    drop(near)

    again = sets.groupBy("set_id").agg(F.count("*").alias("c"), F.min("row").alias("keep")).where("c > 1").select("set_id", "keep")
    again = cut(again, "again")  # copies; so few rows that the join needs no shuffle of the keys
    once = sets.join(again, "set_id", "left").where("keep is null or keep = row").select(F.explode("keys").alias("key"), "set_id", "n", "fp")
    met = cut(once.repartition("key").sortWithinPartitions("key").mapInArrow(_stars(similarity, bits), "u long, v long, key long, m int, near boolean"), "met")
    found = gridded.unionByName(verify(unlinked(met.where("near").select("u", "v").distinct(), joined).select("u", "v")))
    met, labels = met.where("key is not null"), components(found)

    apart = unlinked(met, labels).select("key").distinct()  # the keys whose sets aren't all connected
    rows = met.join(cut(apart, "apart"), "key", "left_semi")
    members = rows.select("key", "m", F.col("u").alias("set_id")).unionByName(rows.groupBy("key", "m").agg(F.min("v").alias("set_id")))
    members = members.join(sizes.select("set_id", "n", "fp"), "set_id").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
    members = cut(members.select("key", "m", "set_id", "n", "fp", F.coalesce("component", "set_id").alias("component")), "members")

    few = members.where(f"m <= {PAIRS}").select("key", "set_id", "n", "fp", "component").repartition("key").sortWithinPartitions("key")
    found = found.unionByName(verify(few.mapInArrow(_cross_pairs(similarity, bits), "u long, v long").distinct()))
    many = members.where(f"m > {PAIRS}")
    if many.isEmpty():
        return found
    keys = many.groupBy("set_id").agg(F.collect_list("key").alias("keys"))  # at most as many as the set has prefix members
    many = many.join(keys, "set_id").join(whole(many.select("set_id")), "set_id")
    blocks = F.expr(f"cast(ceil(m / {BLOCK}) as int)")
    many = many.withColumn("block", F.pmod(F.xxhash64("set_id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    many = many.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "set_id", "n", "component", "block", F.filter("keys", lambda x: x < F.col("key")).alias("before"), "shingles")
    return found.unionByName(cut(many.groupBy("key", "low", "high").applyInArrow(_dense(similarity), "u long, v long"), "like"))


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = BITS) -> DataFrame:
    """(doc_id, component_id) for every row of docs (doc_id, text, ...): documents linked by similar sets of word shingles.

    Similarity is Jaccard's, of the sets of shingles of the whole lower-cased texts; component_id is the smallest doc_id
    reachable. A text of fewer words has one shingle, of all of them; those without words are alike. A row whose doc_id
    is null gets the group of its set, or null if no document there has an id. Other columns of docs are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("t"), text.alias("text"))
    often = rows.where(F.pmod(F.xxhash64("t"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(_shingles(words), "h long")
    often = often.groupBy("h").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(MOST).select("h").toArrow()
    common = docs.sparkSession.sparkContext.broadcast(np.sort(often.column("h").to_numpy().view(np.uint64)))  # 16 MB at most
    sets = cut(rows.mapInArrow(_prefixes(words, similarity, common), "doc_id long, t long, set_id long, n int, fp long, keys array<long>").withColumn("row", F.monotonically_increasing_id()), "sets")
    comp = components(links(sets, rows.select("t", "text"), words, similarity, bits))
    least = sets.groupBy("set_id").agg(F.min("doc_id").alias("least")).join(comp.withColumnRenamed("node", "set_id"), "set_id", "left")
    least = least.select("set_id", "least", F.coalesce("component", "set_id").alias("component"))
    ids = least.groupBy("component").agg(F.min("least").alias("component_id"))
    group = least.join(ids, "component").select("set_id", "component_id")
    return sets.select("doc_id", "set_id").join(group, "set_id").select("doc_id", "component_id")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = BITS) -> DataFrame:
    """The rows of docs without those whose group has a document with a smaller id; of repeated rows of an id one stays.

    Rows with a null doc_id stay.
    """
    return keep_smallest(docs, similar_groups(docs, words, similarity, bits))
