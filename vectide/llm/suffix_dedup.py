"""Removes every byte covered by a long string that occurs twice, by suffix arrays of shards that hold all that can match.

A string of WINDOW bytes belongs to the least of its ANCHOR-byte substrings in the order of a hash, as equal strings do
to equal ones. A run is a stretch of starts that belong to one place; the runs of a document share out its starts. Only
runs whose anchor occurs elsewhere can match, and only with runs of equal anchors, so a shard takes all runs of some
anchors, and its suffix array shows which starts have WINDOW bytes in common with another.

An anchor that very many different runs share is split: the starts that have more bytes before it go by the bytes just
before it, the others by those just behind it. Equal strings go the same way, and each split halves what is not yet known
of them, so that eight splits of a window of 200 leave equal strings only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop, free_name, map_arrow, parts, quoted, release
from .suffix_array import common_prefixes, suffix_array

WINDOW, ANCHOR = 200, 64
#: Bytes hashed at once and bytes of a shard, about.
CHUNK, SHARD = 512 << 10, 192 << 10
#: The starts of an anchor with more different runs than this are split by more of the bytes around it, again and again.
CROWD = 500
_POSITION_BITS = 23
#: A run is packed in a long: 22 bits of its text's hash (which only tell rows of one id apart), 31 of its first start,
#: 10 of its number of starts.
_COUNT_BITS, _START_BITS = 10, 31
_COUNT, _START = (1 << _COUNT_BITS) - 1, (1 << _START_BITS) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


class Hasher:
    """Finds the runs of joined texts. The tables grow with the longest input, which is CHUNK bytes and a window."""

    def __init__(self, window: int = WINDOW, anchor: int = ANCHOR):
        self.window, self.anchor = window, anchor
        self.up = self.down = np.zeros(0, dtype=np.uint64)
        self.code = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD)

    def _least(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each anchor-long string, and for each start of a window the place of the least of those in it."""
        n, k, w = len(data), self.anchor, self.window - self.anchor + 1
        if len(self.up) < n:
            self.up, self.down = _powers(n, _ODD), _powers(n, _INVERSE)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.code[data] * self.up[:n], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * self.down[: n - k + 1]
        del sums
        h = _mix(h)
        m = len(h)
        size = -(-m // w) * w
        key = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
        key[:m] = (h & ~np.uint64((1 << _POSITION_BITS) - 1)) | np.arange(m, dtype=np.uint64)
        key = key.reshape(-1, w)
        left = np.minimum.accumulate(key, axis=1).ravel()
        right = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - self.window + 1
        return h, (np.minimum(right[:starts], left[w - 1 : w - 1 + starts]) & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)

    def places(self, data: np.ndarray) -> np.ndarray:
        """For each start of a window the place of its anchor."""
        return self._least(data)[1]

    def runs(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first start, number of starts, anchor hash) of the runs of bytes whose texts end at the given places."""
        none = np.zeros(0, dtype=np.int64)
        n = len(data)
        if n < self.window:
            return none, none, none
        h, at = self._least(data)
        starts = len(at)
        valid = np.ones(starts, dtype=bool)
        step = np.zeros(starts + 1, dtype=np.int32)
        for e in ends[ends <= n]:
            step[max(0, e - self.window + 1) : max(0, min(e, starts)) + 1][[0, -1]] += (1, -1) if e - self.window + 1 < starts else (0, 0)
        if len(ends) > 1 or (len(ends) and ends[-1] < n):
            valid = np.cumsum(step[:-1]) == 0
        new = valid.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
        first = np.flatnonzero(new)
        if not len(first):
            return none, none, none
        count = np.add.reduceat(valid.astype(np.int64), first)
        return first, count, h[at[first]].view(np.int64)


def _text_runs(hasher: Hasher, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start in it, number, anchor hash) of the runs of all texts; long ones are taken in overlapping parts."""
    out: list[tuple] = []
    over = hasher.window - 1
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if not held:
            return
        lengths = np.array([len(p) for _, _, p in held])
        ends = np.cumsum(lengths)
        first, count, key = hasher.runs(np.frombuffer(b"".join(p for _, _, p in held), dtype=np.uint8), ends)
        part = np.searchsorted(ends, first, side="right")
        base = np.array([o for _, o, _ in held]) - (ends - lengths)
        out.append((np.array([i for i, _, _ in held])[part], first + base[part], count, key))
        held, size = [], 0

    for i, text in enumerate(texts):
        for o in range(0, max(len(text) - over, 0), CHUNK):
            part = text[o : o + CHUNK + over]
            if size + len(part) > CHUNK:
                flush()
            held.append((i, o, part))
            size += len(part)
    flush()
    if not out:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*out))


def _emit_runs(window: int, anchor: int, digests: bool):
    """Runs of rows (doc, tag, t), as (doc, run, key, d) or the key alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(window, anchor)
        h = xxhash.xxh3_64_intdigest
        for b in batches:
            for part in parts(b, b.num_columns - 1):
                texts = part.column(part.num_columns - 1).to_pylist()
                i, first, count, key = _text_runs(hasher, texts)
                if not len(i):
                    continue
                if not digests:
                    yield pa.RecordBatch.from_arrays([pa.array(key)], names=["key"])
                    continue
                d = np.fromiter((h(texts[j][f:e]) for j, f, e in zip(i.tolist(), first.tolist(), (first + count + window - 1).tolist())), np.uint64, len(i)).view(np.int64)
                run = part.column(1).to_numpy()[i] << (_COUNT_BITS + _START_BITS) | first << _COUNT_BITS | count
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), pa.array(run), pa.array(key), pa.array(d)], names=["doc", "run", "key", "d"])
        del hasher
        release()

    return run


def _cut_fragments(window: int):
    """The bytes of runs: rows (packed text, runs), runs being structs (run, key, d, c, different), to fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b, 0, 1 << 20):
                lists = part.column(1)
                flat = lists.flatten()
                of = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                run = flat.field("run").to_numpy()
                first, count = run >> _COUNT_BITS & _START, run & _COUNT
                texts = [zstandard.decompress(x.as_py()) for x in part.column(0)]
                frags = [texts[j][f : f + n + window - 1] for j, f, n in zip(of.tolist(), first.tolist(), count.tolist())]
                around = pa.array(np.full(len(frags), -1, np.int32))
                yield pa.RecordBatch.from_arrays([*(flat.field(x) for x in ("key", "d", "c", "different")), pa.array(frags, pa.binary()), around, around], names=["key", "d", "c", "different", "frag", "lo", "hi"])
        release()

    return run


def _anchor_at(hasher: Hasher, fragment: bytes) -> int:
    """Where in a run's bytes its anchor is."""
    return hasher.places(np.frombuffer(fragment[: hasher.window], dtype=np.uint8))[0]


def _split(window: int, anchor: int):
    """Fragments whose bytes lo to hi are known to be alike in their group, to halves of theirs by more of these bytes.

    A start at s has lo - s bytes of its string before lo. Those with half of the unknown ones there or more go by the
    bytes before lo, the others by the bytes behind hi.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(window, anchor)
        h = xxhash.xxh3_64_intdigest
        for b in batches:
            for part in parts(b, b.schema.names.index("frag"), 1 << 20):
                out: list[tuple] = []
                for k, d, c, frag, lo, hi in zip(*(part.column(x).to_pylist() for x in ("key", "d", "c", "frag", "lo", "hi"))):
                    if lo < 0:
                        lo = _anchor_at(hasher, frag)
                        hi = lo + anchor
                    n, unknown = len(frag) - window + 1, window - (hi - lo)
                    before = (unknown + 1) // 2
                    middle = min(n, max(0, lo - before + 1))
                    for side, s, e, left, right in ((0, 0, middle, lo - before, hi), (1, middle, n, lo, hi + unknown - before + 1)):
                        if s < e:
                            own = frag[s : e - 1 + window]
                            out.append((k, d, s, h(frag[left:right], side) - (1 << 63), h(own) - (1 << 63), c, own, left - s, right - s))
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), _HALVES)], schema=_HALVES)
        release()

    return run


def _small(rows: DataFrame, text: str) -> DataFrame:
    """rows with a column of bytes packed by Zstandard, so that their shuffle takes half the disk; nulls become empty."""
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for whole in batches:
            for b in parts(whole, at):
                yield b.set_column(at, b.schema.names[at], pa.array([pack(x.as_py() or b"") for x in b.column(at)], pa.binary()))
        release()

    return map_arrow(rows, run, rows.schema)


def repeated_starts(fragments: list[bytes], counts: list[int], window: int = WINDOW) -> list[np.ndarray]:
    """For each different fragment, which of its starts have a window that occurs at another start of any or in a copy of it."""
    lengths = np.array([len(f) for f in fragments])
    base = np.cumsum(lengths + 1) - lengths - 1
    data = b"\0".join(fragments) + b"\0"
    symbols = np.append(np.frombuffer(data, dtype=np.uint8).astype(np.int32) + 2, np.int32(0))
    symbols[base + lengths] = 1  # apart from every byte
    ok = np.zeros(len(data), dtype=bool)
    for s, n in zip(base, lengths):
        ok[s : s + n - window + 1] = True
    sa = suffix_array(symbols, 258)
    shared = common_prefixes(data, sa, ok, window)
    hit = shared >= window
    twice = hit.copy()
    before = np.full(len(symbols), -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    twice[before[np.flatnonzero(hit)]] = True
    return [np.ones(n - window + 1, dtype=bool) if c > 1 else twice[s : s + n - window + 1] for s, n, c in zip(base, lengths, counts)]


def _spans(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"s": int(s), "e": int(e)} for s, e in zip(edge[::2], edge[1::2])]


_HALVES = pa.schema([("key", pa.int64()), ("d", pa.int64()), ("at", pa.int32()), ("key2", pa.int64()), ("d2", pa.int64()), ("c", pa.int64()), ("frag", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32())])
_FOUND = pa.schema([("key", pa.int64()), ("d", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))])


def _shard(window: int):
    def run(group: pa.Table) -> pa.Table:
        hits = repeated_starts([f.as_py() for f in group.column("frag")], group.column("c").to_pylist(), window)
        rows = [{"key": k, "d": d, "spans": _spans(h)} for k, d, h in zip(group.column("key").to_pylist(), group.column("d").to_pylist(), hits) if h.any()]
        del hits
        release()
        return pa.Table.from_pylist(rows, schema=_FOUND)

    return run


def _remove(window: int):
    spans_type = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in parts(whole, 0, 1 << 20):
                removed, kept = [], []
                for text, spans in zip(b.column(0), b.column(1)):
                    data = zstandard.decompress(text.as_py())
                    if not spans.is_valid or not len(spans):
                        removed.append([])
                        kept.append(data)
                        continue
                    flat = spans.values
                    s = np.stack([flat.field("s").to_numpy(), flat.field("e").to_numpy() + window - 1], axis=1)
                    s = s[np.argsort(s[:, 0], kind="stable")]
                    reach = np.maximum.accumulate(s[:, 1])
                    first = np.append(True, s[1:, 0] > reach[:-1])
                    starts = s[first, 0].tolist()
                    ends = reach[np.append(np.flatnonzero(first)[1:] - 1, len(s) - 1)].tolist()
                    removed.append([{"s": x, "e": y} for x, y in zip(starts, ends)])
                    kept.append(b"".join(data[x:y] for x, y in zip([0, *ends], [*starts, len(data)])))
                yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(removed, spans_type), pa.array(kept, pa.binary())], names=[*b.schema.names[2:], "removed_bytes", "kept"])
        release()

    return run


def _found(frags: DataFrame, window: int, anchor: int) -> DataFrame:
    """(key, d, spans) of the fragments (key, d, c, different, frag, lo, hi) that have repeated starts.

    different is the number of fragments of the key. Groups of up to CROWD go to suffix arrays; larger ones are split,
    equal halves are collapsed, and what is found in a half goes back to the fragments that it is from.
    """
    same, form = ["key", "d"], "key long, d long, spans array<struct<s:int,e:int>>"
    found, ways = [], []
    while True:
        few = frags.where(f"different between 2 and {CROWD}")
        total = few.agg(F.sum(F.octet_length("frag"))).first()[0] or 0
        shard = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-total // SHARD))))
        got = few.select("key", "d", "c", "frag", shard.alias("shard")).groupBy("shard").applyInArrow(_shard(window), form)
        alone = frags.where("different = 1 and c > 1")
        whole = F.array(F.struct(F.lit(0).alias("s"), (F.octet_length("frag") - (window - 1)).cast("int").alias("e")))
        found.append(got.unionByName(alone.select(*same, whole.alias("spans"))))
        crowd = frags.where(f"different > {CROWD}")
        if crowd.isEmpty():
            break
        halves = cut(crowd.drop("different").mapInArrow(_split(window, anchor), "key long, d long, at int, key2 long, d2 long, c long, frag binary, lo int, hi int"), "halves")
        ways.append(halves.select("key", "d", "at", "key2", "d2"))
        kinds = halves.groupBy("key2", "d2").agg(F.sum("c").alias("c"), F.first("frag").alias("frag"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
        kinds = kinds.select(F.col("key2").alias("key"), F.col("d2").alias("d"), "c", "frag", "lo", "hi")
        kinds = cut(kinds, "kinds")
        frags = cut(kinds.join(kinds.groupBy("key").agg(F.count("*").alias("different")), "key"), "fragments")
        drop(kinds)
    out = found.pop()
    while ways:
        low = out.select(F.col("key").alias("key2"), F.col("d").alias("d2"), "spans")
        moved = F.transform("spans", lambda x: F.struct((x["s"] + F.col("at")).alias("s"), (x["e"] + F.col("at")).alias("e")))
        out = found.pop().unionByName(ways.pop().join(low, ["key2", "d2"]).select(*same, moved.alias("spans")))
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The columns of docs (doc_id, text, ...) but text, removed_bytes, an array of (s, e) in UTF-8 bytes of the text, and
    kept, the bytes left.

    A byte goes if a string of window bytes that covers it starts at another place too, of the same document or another;
    strings don't cross documents and are judged on the input. A null text counts as empty; texts shorter than the window
    stay. Repeated rows are copies of each other; rows with a null doc_id count too, and stay apart by their texts.
    Columns removed_bytes and kept of docs are replaced; others stay whatever their names.
    """
    if window - anchor + 1 > _COUNT or window + CHUNK >= 1 << _POSITION_BITS or not 0 < anchor <= window:
        raise ValueError(f"a window has at most {_COUNT - 1} bytes more than its anchor")
    docs = docs.drop("removed_bytes", "kept")
    others = [f for f in docs.schema if f.name.lower() != "text"]
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    doc, tag = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(data)), F.xxhash64(data).bitwiseAND(F.lit((1 << 22) - 1))
    rows = docs.select(doc.alias("doc"), tag.alias("tag"), data.alias("t")).where(F.octet_length("t") >= window)
    keys = rows.select("t").mapInArrow(_emit_runs(window, anchor, False), "key long")
    twice = keys.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    twice = cut(twice, "keys")  # a table of its own, so that the join may split a hot anchor's partition
    same = ["key", "d"]
    tag_of = lambda run: F.shiftright(run, _COUNT_BITS + _START_BITS)
    runs = rows.mapInArrow(_emit_runs(window, anchor, True), "doc long, run long, key long, d long")
    runs = cut(runs.join(twice, "key"), "runs")
    kinds = cut(runs.groupBy(*same).agg(F.count("*").alias("c"), F.min(F.struct("doc", "run")).alias("first")), "kinds")
    kinds = kinds.join(kinds.groupBy("key").agg(F.count("*").alias("different")), "key")
    alone = kinds.where("different = 1 and c > 1")
    whole = alone.select(*same, F.array(F.struct(F.lit(0).alias("s"), F.col("first.run").bitwiseAND(F.lit(_COUNT)).cast("int").alias("e"))).alias("spans"))
    several = kinds.where("different > 1").groupBy("first.doc", tag_of(F.col("first.run")).alias("tag")).agg(F.collect_list(F.struct("first.run", *same, "c", "different")).alias("runs"))
    texts = _small(rows, "t").join(several, ["doc", "tag"])
    frags = cut(texts.select("t", "runs").mapInArrow(_cut_fragments(window), "key long, d long, c long, different long, frag binary, lo int, hi int"), "fragments")
    spans = cut(whole.unionByName(_found(frags, window, anchor)), "spans")
    lo = F.shiftright("run", _COUNT_BITS).bitwiseAND(F.lit(_START))
    hits = runs.join(spans, same).select("doc", tag_of(F.col("run")).alias("tag"), lo.alias("lo"), F.explode("spans").alias("x"))
    hits = hits.groupBy("doc", "tag").agg(F.collect_list(F.struct((F.col("lo") + F.col("x.s")).alias("s"), (F.col("lo") + F.col("x.e")).alias("e"))).alias("hits"))
    k_doc, k_tag, k_data, h_doc, h_tag, h_hits = (free_name(docs, x) for x in ("__doc", "__tag", "__data", "__h_doc", "__h_tag", "__hits"))
    own = quoted([f.name for f in others])
    keyed = _small(docs.select(*own, doc.alias(k_doc), tag.alias(k_tag), data.alias(k_data)), k_data)
    hits = hits.select(F.col("doc").alias(h_doc), F.col("tag").alias(h_tag), F.col("hits").alias(h_hits))
    joined = keyed.join(hits, (F.col(k_doc) == F.col(h_doc)) & (F.col(k_tag) == F.col(h_tag)), "left").select(k_data, h_hits, *own)
    span = T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())])
    return map_arrow(joined, _remove(window), T.StructType([*others, T.StructField("removed_bytes", T.ArrayType(span)), T.StructField("kept", T.BinaryType())]))
