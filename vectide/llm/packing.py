"""Best-fit packing of token pieces, improved by swaps between underfull sequences."""

from __future__ import annotations

import base64
import bisect
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import mixing
from .common import cut, numbered, release

CONTEXT, END_ID = 1024, 2
#: The strings of the vocabulary that are tokens of their own wherever a text has them.
SPECIAL = {"<|endoftext|>": 50256}
#: Places of the mix that are packed together when sequences keep its order.
WINDOW = 2048
VOCABULARY = "byte_bpe_50k.tiktoken"

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The byte-level BPE of a rank file, one for each Python process."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _encoders[path]


def token_ids(enc, text: str, end_id: int) -> np.ndarray:
    """The ids of a text and the end mark; a special token's string is that token."""
    return np.array([*enc.encode(text, allowed_special="all"), end_id], dtype="<u4")


def cut_points(n: int, context: int = CONTEXT) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: pieces of full context, the first one shorter if need be."""
    first = n % context or context
    return [(0, min(first, n))] + [(s, context) for s in range(first, n, context)]


def _tokenise(path: str, end_id: int, context: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        chunk, seen, full = TaskContext.get().partitionId(), np.zeros(context + 1, dtype=np.int64), 0

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "piece", "start", "length", "ids", "chunk", "nth"])

        for b in batches:
            rows, held = [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = token_ids(enc, text.as_py() or "", end_id)
                for k, (s, n) in enumerate(cut_points(len(ids), context)):
                    rows.append((doc, k, s, n, ids[s : s + n].tobytes(), chunk, int(seen[n])))
                    seen[n] += 1
                    held += n
                if held > 2_000_000:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)
        release()

    return run


def pieces(docs: DataFrame, vocabulary: str | None = None, context: int = CONTEXT, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids, chunk, nth): the tokens of every whole text, cut to the context, kept in the shared folder.

    ids are little-endian unsigned 32-bit numbers. nth counts the pieces of the same length that the same task, chunk,
    made before. A null text counts as empty: one piece, the end mark. Rows are kept, repeats and null ids included.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    made = rows.mapInArrow(_tokenise(vocabulary, end_id, context), "doc_id long, piece int, start long, length long, ids binary, chunk int, nth long")
    return cut(made, "pieces")


class Bins:
    """Alike sequences: how many there are of each content, a content being the sorted lengths in it."""

    def __init__(self, context: int):
        self.context, self.count = context, Counter()

    def add(self, content: Iterable[int], n: int) -> None:
        c = tuple(sorted(content, reverse=True))
        self.count[c] += n
        if not self.count[c]:
            del self.count[c]


def best_fit(lengths: dict[int, int], context: int) -> Bins:
    """Best-fit decreasing on counts of lengths: the fullest sequence that still takes a piece gets it.

    Alike pieces meet alike sequences, so that a step places many; steps number thousands whatever the counts.
    """
    bins, by_room = Bins(context), {}  # room: {content: count}
    for size in sorted(lengths, reverse=True):
        left = lengths[size]
        for room in range(size, context):
            for content, n in list(by_room.get(room, {}).items()):
                if not left:
                    break
                each = room // size
                full, part = min(n, left // each), 0
                if full < n and left - full * each:
                    part = left - full * each
                for k, m in ((each, full), (part, 1 if part else 0)):
                    if m:
                        by_room[room][content] -= m
                        by_room.setdefault(room - k * size, {})
                        after = content + (size,) * k
                        by_room[room - k * size][after] = by_room[room - k * size].get(after, 0) + m
                        left -= k * m
                if not by_room[room][content]:
                    del by_room[room][content]
        each = context // size
        for k, m in ((each, left // each), (left % each, 1 if left % each else 0)):
            if m:
                by_room.setdefault(context - k * size, {})
                content = (size,) * k
                by_room[context - k * size][content] = by_room[context - k * size].get(content, 0) + m
    for kept in by_room.values():
        for content, n in kept.items():
            bins.add(content, n)
    return bins


def _exchange(low: tuple[int, ...], high: tuple[int, ...], room: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """What to take from the emptier and what from the fuller sequence, so that the fuller gains the most that fits.

    Nothing, one or two pieces come from the emptier one, nothing or one from the fuller.
    """
    best, found = 0, None
    give = sorted({0, *high})
    take = {x: (x,) for x in low} | {x + y: (x, y) for i, x in enumerate(low) for y in low[i + 1 :]}
    for s, t in take.items():
        i = bisect.bisect_left(give, s - room)
        if i < len(give) and s - give[i] > best:
            best, found = s - give[i], (t, (give[i],) if give[i] else ())
    return found


def improve(bins: Bins) -> Bins:
    """Local search: moves, one-for-one and two-for-one exchanges between underfull sequences that increase squared fill.

    The emptiest content gives to fuller ones until nothing more fits; contents are taken with their counts, so that a
    step changes many sequences. Each step raises the sum of squared fills, so it ends: when no exchange gains, or once
    the number of sequences is the least that the tokens need. Pairs that can't gain aren't tried again.
    """
    context = bins.context
    least = -(-sum(sum(c) * n for c, n in bins.count.items()) // context)
    total = sum(bins.count.values())
    under = sorted((sum(c), c) for c in bins.count if sum(c) < context)
    vain: set = set()
    changed = True
    while changed and total > least:
        changed = False
        for fill, low in list(under):
            for filled, high in reversed(under[bisect.bisect_left(under, (fill, low)) :]):
                n = bins.count[low] // 2 if low == high else min(bins.count[low], bins.count[high])
                if not n or (low, high) in vain or total <= least:
                    continue
                found = _exchange(low, high, context - filled)
                if not found or (low == high and sum(found[0]) == sum(found[1])):
                    vain.add((low, high))
                    continue
                t, g = found
                a, b = Counter(low), Counter(high)
                a.subtract(t)
                a.update(g)
                b.subtract(g)
                b.update(t)
                for content, m in ((low, -n), (high, -n), (a.elements(), n), (b.elements(), n)):
                    key = tuple(sorted(content, reverse=True))
                    if not key:
                        total -= n
                        continue
                    if key not in bins.count and sum(key) < context:
                        bisect.insort(under, (sum(key), key))
                    bins.add(key, m)
                    if key not in bins.count and sum(key) < context:
                        del under[bisect.bisect_left(under, (sum(key), key))]
                changed = True
    return bins


def places(bins: Bins) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, last, sequence, each, offset): of the pieces of a length, numbers first to last (exclusive) go to the
    sequences from the given number on, each many to one, the first at the offset and the others behind it."""
    used, at, out = Counter(), 0, []
    for content, n in sorted(bins.count.items(), key=lambda x: (-sum(x[0]), x[0])):
        offset = 0
        for size, each in Counter(content).items():
            out.append((size, used[size], used[size] + n * each, at, each, offset))
            used[size] += n * each
            offset += size * each
        at += n
    return out


def pack(cut_pieces: DataFrame, context: int = CONTEXT) -> DataFrame:
    """The rows of pieces() with sequence_id and offset: as few sequences of at most context tokens as best fit and swaps find.

    Only the counts of lengths reach the driver, at most context of them; the plan made there has a number of rows that
    depends on the context alone and is broadcast. Full pieces are sequences of their own, with negative numbers. Other
    pieces are numbered by (task, order in it) within their length. Every row is placed once; none give none.
    """
    spark = cut_pieces.sparkSession
    sizes = cut_pieces.groupBy("length", "chunk").agg((F.max("nth") + 1).alias("n"))
    short = sizes.where(F.col("length") < context)
    counts = {r["length"]: r["n"] for r in short.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = places(improve(best_fit(counts, context)))
    before = short.select(F.col("length").alias("b_length"), F.col("chunk").alias("b_chunk"), (F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("b_n"))
    steps = spark.createDataFrame(plan, "p_length int, p_first long, p_last long, p_sequence long, p_each int, p_offset int")
    rows = cut_pieces.where(F.col("length") < context)
    rows = rows.join(before, (F.col("length") == F.col("b_length")) & (F.col("chunk") == F.col("b_chunk"))).withColumn("b_n", F.col("b_n") + F.col("nth"))
    rows = rows.join(F.broadcast(steps), (F.col("length") == F.col("p_length")) & (F.col("b_n") >= F.col("p_first")) & (F.col("b_n") < F.col("p_last")))
    i = F.col("b_n") - F.col("p_first")
    inner = rows.select("doc_id", "piece", "start", "length", "ids", (F.col("p_sequence") + F.expr("(b_n - p_first) div p_each")).alias("sequence_id"), (F.col("p_offset") + (i % F.col("p_each")) * F.col("length")).cast("long").alias("offset"))
    alone = cut_pieces.where(F.col("length") >= context)
    own = -(F.col("chunk").cast("long") * F.lit(1 << 40) + F.col("nth") + 1)
    return inner.unionByName(alone.select("doc_id", "piece", "start", "length", "ids", own.alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def pack_documents(docs: DataFrame, vocabulary: str | None = None, context: int = CONTEXT, end_id: int = END_ID) -> DataFrame:
    """Tokenises docs (doc_id, text, ...) and packs the pieces; see pieces() and pack()."""
    return pack(pieces(docs, vocabulary, context, end_id), context)


def _tokens(path: str, end_id: int, context: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        names = ["window", "place", "doc_id", "piece", "start", "length", "ids"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for b in batches:
            rows, held = [], 0
            for window, place, doc, text in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                ids = token_ids(enc, text.as_py() or "", end_id)
                for k, (s, n) in enumerate(cut_points(len(ids), context)):
                    rows.append((window, place, doc, k, s, n, ids[s : s + n].tobytes()))
                    held += n
                if held > 2_000_000:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)
        release()

    return run


def _pack_window(context: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("place", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        length, place = t["length"].to_numpy(), t["place"].to_numpy()
        own = np.empty(len(length), dtype=np.int64)
        offset = np.zeros(len(length), dtype=np.int64)
        alone = np.flatnonzero(length >= context)
        own[alone] = np.arange(len(alone))
        of = {int(n): np.flatnonzero(length == n) for n in np.unique(length[length < context])}
        for size, first, last, sequence, each, at in places(improve(best_fit({n: len(x) for n, x in of.items()}, context))):
            i = np.arange(last - first)
            own[of[size][first:last]] = len(alone) + sequence + i // each
            offset[of[size][first:last]] = at + i % each * size
        least = np.full(own.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, own, place)
        rank = np.empty(len(least), dtype=np.int64)
        rank[np.argsort(least, kind="stable")] = np.arange(len(least))  # by the first document in each
        number = (t["window"].to_numpy() << 32) + rank[own]
        return t.select(["doc_id", "piece", "start", "length", "ids"]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    return run


def _pack_windows(rows: DataFrame, vocabulary: str | None, context: int, end_id: int) -> DataFrame:
    """Rows (window, place, doc_id, text) to pieces with sequences and offsets; each window is packed by itself."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    rows = rows.select("window", "place", F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    made = rows.mapInArrow(_tokens(vocabulary, end_id, context), "window long, place long, doc_id long, piece int, start long, length long, ids binary")
    return made.groupBy("window").applyInArrow(_pack_window(context), "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")


def pack_in_order(docs: DataFrame, vocabulary: str | None = None, context: int = CONTEXT, end_id: int = END_ID, window: int | None = None, block: int = mixing.BLOCK, **options) -> DataFrame:
    """The rows of pack_documents(), with sequences numbered in the order of the mix of docs (doc_id, text, source, ...).

    Each window of so many places of the mix is packed by itself, and sequence_id ascends from window to window: all
    sequences before a window hold the documents of a beginning of the mix, whole. Within a window sequences go by their
    first document. A window holds a bounded number of documents, so all windows are packed side by side.
    """
    mixed = mixing.mix(docs.select("doc_id", "text", "source"), block=block, **options)
    rows = mixed.select(F.expr(f"(mix_slot * {block} + mix_index) div {window or WINDOW}").alias("window"), (F.col("mix_slot") * block + F.col("mix_index")).alias("place"), "doc_id", "text")
    return _pack_windows(rows, vocabulary, context, end_id)


def pack_as_given(docs: DataFrame, vocabulary: str | None = None, context: int = CONTEXT, end_id: int = END_ID, window: int | None = None) -> DataFrame:
    """As pack_in_order(), but in the order that the rows of docs (doc_id, text, ...) have, which mixing.in_order() may have made."""
    rows = numbered(docs, ["doc_id", "text"], "place").withColumn("window", F.expr(f"place div {window or WINDOW}"))
    return _pack_windows(rows, vocabulary, context, end_id)
