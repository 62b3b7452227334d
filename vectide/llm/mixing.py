"""Mixing sources to target weights by Pfair scheduling: blocks have release times and deadlines, and the earliest deadline goes first.

The ideal is a fluid that serves every source that has blocks left in proportion to its weight. A block is released in the
slot in which the fluid begins it and due when the fluid ends it, so that each source is always less than a block from the
ideal. Stretches of slots are scheduled side by side: the driver only settles which of the blocks that the fluid has begun at
the border of two stretches come before it, see border().
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, quoted, row_hash

#: Documents in a block, documents in a part that is numbered at once, blocks in a row of the plan, slots that a task schedules at once.
BLOCK, PART, RUN, STRETCH = 16, 2048, 64, 16384
#: Sources at most: what is known of each, some 200 bytes, goes to the driver and to every task.
MAX_SOURCES = 100_000


def exact_weights(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportion of the weights, which are positive and finite."""
    parts = {x: Fraction(w) for x, w in weights.items()}
    d = lcm(*(f.denominator for f in parts.values()))
    return {x: int(f * d) for x, f in parts.items()}


@dataclass(frozen=True)
class Fluid:
    """Sources with so many blocks and whole weights, served in proportion until they run out, a block a slot in all.

    With v the service for each unit of weight, v is between two of the ends at which sources run out, and up to there
    base + rate * v slots have passed: base blocks of sources that have ended, and rate is the weight of the others. Every
    number is exact.
    """

    blocks: tuple[int, ...]
    weights: tuple[int, ...]
    ends: tuple[Fraction, ...]
    slots: tuple[Fraction, ...]
    base: tuple[int, ...]
    rate: tuple[int, ...]

    @classmethod
    def of(cls, blocks: list[int], weights: list[int]) -> Fluid:
        by_end: dict[Fraction, list[int]] = {}
        for k, (n, w) in enumerate(zip(blocks, weights)):
            by_end.setdefault(Fraction(n, w), []).append(k)
        ends, base, rate = [Fraction(0)], [0], [sum(weights)]
        for end in sorted(by_end):
            ends.append(end)
            base.append(base[-1] + sum(blocks[k] for k in by_end[end]))
            rate.append(rate[-1] - sum(weights[k] for k in by_end[end]))
        slots = [b + r * e for b, r, e in zip(base, rate, ends)]
        return cls(tuple(blocks), tuple(weights), tuple(ends), tuple(slots), tuple(base), tuple(rate))

    @property
    def total(self) -> int:
        return self.base[-1]

    def windows(self, k: int, first: int, last: int) -> Iterator[tuple[int, int]]:
        """(release, deadline) of blocks first to last (exclusive) of source k."""
        w = self.weights[k]
        j = bisect_right(self.ends, Fraction(first, w)) - 1
        for i in range(first, last):
            while j + 1 < len(self.ends) and self.ends[j + 1] * w <= i:
                j += 1
            e = j
            while e + 1 < len(self.ends) and self.ends[e + 1] * w < i + 1:
                e += 1
            yield self.base[j] + self.rate[j] * i // w, self.base[e] - (-self.rate[e] * (i + 1) // w)

    def phase(self, slot: int) -> int:
        """How many times a source has run out before a slot ends."""
        return bisect_left(self.slots, slot + 1) - 1

    def begun(self, slot: int) -> tuple[list[int], list[int], int]:
        """How many blocks of each source have ended before a slot, and which part of the next has, in units of one by the last number."""
        j = min(bisect_right(self.slots, slot) - 1, len(self.rate) - 2)
        over, rate = slot - self.base[j], self.rate[j]
        whole, part = [], []
        for n, w in zip(self.blocks, self.weights):
            i, f = divmod(w * over, rate)
            whole.append(min(i, n))
            part.append(f if i < n else 0)
        return whole, part, rate


class _Flow:
    """A largest flow by shortest augmenting paths, which take a unit each."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def edge(self, u: int, v: int, room: int = 1) -> int:
        e = len(self.to)
        self.out[u].append(e)
        self.out[v].append(e + 1)
        self.to += [v, u]
        self.room += [room, 0]
        return e

    def grow(self, source: int, sink: int) -> None:
        out, to, room = self.out, self.to, self.room
        while True:
            level = [-1] * len(out)
            level[source] = 0
            todo = deque([source])
            while todo:
                u = todo.popleft()
                for e in out[u]:
                    if room[e] and level[to[e]] < 0:
                        level[to[e]] = level[u] + 1
                        todo.append(to[e])
            if level[sink] < 0:
                return
            at, path, u = [0] * len(out), [], source
            while True:
                if u == sink:
                    for e in path:
                        room[e] -= 1
                        room[e ^ 1] += 1
                    path, u = [], source
                elif at[u] < len(out[u]):
                    e = out[u][at[u]]
                    if room[e] and level[to[e]] == level[u] + 1:
                        path.append(e)
                        u = to[e]
                    else:
                        at[u] += 1
                elif u == source:
                    break
                else:
                    u = to[path.pop() ^ 1]
                    at[u] += 1


def border(fluid: Fluid, start: int, slot: int, earlier: list[int]) -> list[int]:
    """How many blocks of each source come before a slot, so that all windows can be kept from the border at start on.

    earlier blocks come before start. Of the blocks that the fluid has begun but not ended, so many come before the slot
    as their parts make in all, and with them those that came before start. By Hall's theorem the slots between can hold
    what is due there if, for any s behind start, the blocks chosen that are released from s on fit beside those whose
    windows lie between s and the slot; and what is left can be kept behind if, for any t, the blocks not chosen that are
    due by t fit beside those whose windows lie between the slot and t. The sets that these limits speak of contain each
    other, so that a choice is a flow through two chains. There is one: earliest deadline first from start makes one.
    """
    whole, part, unit = fluid.begun(slot)
    some = [k for k, f in enumerate(part) if f]
    if not some:
        return whole
    windows = {k: next(fluid.windows(k, whole[k], whole[k] + 1)) for k in some}
    chosen, n = sum(part[k] for k in some) // unit, len(some)
    upper = [w + (f > 0) for w, f in zip(whole, part)]
    releases, dues = sorted({max(start, r) for r, _ in windows.values()}), sorted({d for _, d in windows.values()})
    flow = _Flow(2 * n + len(releases) + len(dues) + 2)
    by_release = {r: 2 * n + i for i, r in enumerate(releases)}
    by_due = {d: 2 * n + len(releases) + i for i, d in enumerate(dues)}
    source, sink = 2 * n + len(releases) + len(dues), 2 * n + len(releases) + len(dues) + 1
    for low, r in zip([None, *releases], releases):
        room = chosen
        if low is not None:
            done, over, _ = fluid.begun(r)
            room = slot - r - sum(max(0, w - x - (f > 0)) for w, x, f in zip(whole, done, over))
        flow.edge(source if low is None else by_release[low], by_release[r], min(chosen, room))
    flow.edge(by_due[dues[0]], sink, chosen)
    for d, high in zip(dues, dues[1:]):
        done, _, _ = fluid.begun(d)
        need = sum(windows[k][1] <= d for k in some) - (d - slot) + sum(max(0, x - u) for x, u in zip(done, upper))
        flow.edge(by_due[high], by_due[d], chosen - max(0, need))
    through, held = {}, {k for k in some if earlier[k] > whole[k]}
    for i, k in enumerate(some):
        flow.edge(by_release[max(start, windows[k][0])], 2 * i)
        through[k] = flow.edge(2 * i, 2 * i + 1, int(k in held))
        flow.edge(2 * i + 1, by_due[windows[k][1]])
    flow.grow(source, sink)  # those that came before start
    for k, e in through.items():
        if k in held:
            if flow.room[e]:
                raise AssertionError("a block can't stay before the border")
            flow.room[e ^ 1] = 0
        else:
            flow.room[e] = 1
    flow.grow(source, sink)
    for k, e in through.items():
        whole[k] += k in held or not flow.room[e]
    return whole


def borders(fluid: Fluid, step: int) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """(first slot, last slot (exclusive), blocks before the first, before the last) of stretches of so many slots."""
    before = [0] * len(fluid.blocks)
    for first in range(0, fluid.total, step):
        last = min(first + step, fluid.total)
        after = border(fluid, first, last, before)
        yield first, last, before, after
        before = after


def stretch(fluid: Fluid, first: int, last: int, before: list[int], after: list[int]) -> dict[int, tuple[int, list[int]]]:
    """For slots first to last (exclusive): of each source there the first block, and the slot of each.

    Earliest deadline first, ties by the source's number; no block is before its release or behind its deadline.
    """
    out: dict[int, tuple[int, list[int]]] = {}
    waiting: list[tuple[int, int, int]] = []
    windows = {}

    def wait(k: int) -> None:
        got = next(windows[k], None)
        if got is not None:
            heapq.heappush(waiting, (got[0], min(got[1], last), k))

    for k, (a, b) in enumerate(zip(before, after)):
        if a < b:
            out[k] = (a, [])
            windows[k] = fluid.windows(k, a, b)
            wait(k)
    ready: list[tuple[int, int]] = []
    for slot in range(first, last):
        while waiting and waiting[0][0] <= slot:
            _, due, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, k))
        due, k = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a deadline was missed")
        out[k][1].append(slot)
        wait(k)
    return out


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float], step: int = STRETCH) -> dict[str, list[tuple[int, int]]]:
    """(slot, phase) of each block of each source, made at once; what mix() has tasks do side by side."""
    names = sorted(x for x, n in blocks.items() if n > 0)
    whole = exact_weights({x: weights[x] for x in names})
    fluid = Fluid.of([blocks[x] for x in names], [whole[x] for x in names])
    out: dict[str, list[tuple[int, int]]] = {x: [] for x in names}
    for first, last, before, after in borders(fluid, step):
        for k, (_, slots) in stretch(fluid, first, last, before, after).items():
            out[names[k]] += [(x, fluid.phase(x)) for x in slots]
    return out


_STRETCH, _PLAN = "plan int, first long, last long, before array<int>, after array<int>", "src string, run long, first long, slots array<long>, phases array<int>"


def _stretches(plans) -> Iterator[tuple[int, int, int, list[int], list[int]]]:
    """The stretches of all plans; of the blocks at a border only those that the fluid has not ended are named, by their sources."""
    for p, (_, fluid, _, _, step) in enumerate(plans):
        early: list[int] = []
        for first, last, _, after in borders(fluid, step):
            ended, _, _ = fluid.begun(last)
            late = [k for k, (a, b) in enumerate(zip(ended, after)) if b > a]
            yield p, first, last, early, late
            early = late


def _scheduled(plans):
    """Stretches to their blocks, at most RUN in a row. plans: (names, fluid, slots before, phases before, step)."""

    def counts(fluid: Fluid, slot: int, more: list[int]) -> list[int]:
        out, _, _ = fluid.begun(slot)
        for k in more:
            out[k] += 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, first, last, early, late in zip(*(x.to_pylist() for x in b.columns)):
                names, fluid, slots_before, phases_before, _ = plans.value[p]
                rows = []
                for k, (at, slots) in stretch(fluid, first, last, counts(fluid, first, early), counts(fluid, last, late)).items():
                    i = 0
                    while i < len(slots):
                        end = min(len(slots), (at + i) // RUN * RUN + RUN - at)
                        rows.append((names[k], (at + i) // RUN, at + i, [x + slots_before for x in slots[i:end]], [fluid.phase(x) + phases_before for x in slots[i:end]]))
                        i = end
                types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["src", "run", "first", "slots", "phases"])

    return run


def _key(source: str) -> Column:
    """A null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = 0.5, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """docs (doc_id, source, ...) with mix_phase, mix_slot and mix_index: its phase, its block's slot and its place in the block.

    Sorted by (mix_slot, mix_index) the rows hold the target weights to less than a block at every slot of phase 0; a
    source that runs out begins a phase in which the rest keep to their weights in proportion, again to less than a block.
    Every row is placed once. Weights are per source (those not named get none and so come last); without any, a source
    has its number of rows to the given power. The order within a source is that of a hash of doc_id, then of the row; of
    equal rows any may be first. A null source is one of its own. Columns mix_phase, mix_slot, mix_index of docs are
    replaced, others stay whatever their names.

    The driver and each task know the number of rows of each source, for at most MAX_SOURCES of them; more are an error.
    The plan is a table that tasks make by stretches of slots; documents are shuffled once.
    """
    docs = docs.drop("mix_phase", "mix_slot", "mix_index")
    spark = docs.sparkSession
    src, part, order, tie, rank, b_src, b_part, b_n, b_first, b_slots, b_phases = (free_name(docs, x) for x in ("__src", "__part", "__order", "__tie", "__rank", "__b_src", "__b_part", "__b_n", "__b_first", "__b_slots", "__b_phases"))
    whole = row_hash(docs)
    keyed = docs.withColumns({src: _key("source"), order: F.xxhash64(F.col("doc_id"), F.lit(seed)), tie: F.when(F.col("doc_id").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(whole)})
    counts = keyed.groupBy(src).agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = {r[src]: r["n"] for r in counts}
    if not rows:
        return docs.withColumns({"mix_phase": F.lit(0), "mix_slot": F.lit(0).cast("long"), "mix_index": F.lit(0)})
    if weights is None:
        wanted = {x: k**power for x, k in rows.items()}
    else:
        named = {"n" if s is None else f"s{s}": float(w) for s, w in weights.items()}
        wanted = {x: named.get(x, 0.0) for x in rows}
    plans, slots, phases = [], 0, 0
    for group in ({x: w for x, w in wanted.items() if w > 0}, {x: rows[x] for x, w in wanted.items() if not w > 0}):
        if group:  # those without a weight come after the others, in proportion to their rows
            names, exact = sorted(group), exact_weights(group)
            fluid = Fluid.of([-(-rows[x] // block) for x in names], [exact[x] for x in names])
            plans.append((names, fluid, slots, phases, max(STRETCH, len(names) ** 2)))  # a border takes time with the square of the sources
            slots, phases = slots + fluid.total, phases + len(fluid.ends) - 1
    made = spark.createDataFrame(list(_stretches(plans)), _STRETCH)
    steps = made.repartition(min(10_000, -(-slots // STRETCH)), "plan", "first").mapInArrow(_scheduled(spark.sparkContext.broadcast(plans)), _PLAN)
    steps = cut(steps, "plan")

    parts = max(1, -(-sum(rows.values()) // PART))
    keyed = keyed.withColumn(part, F.pmod(F.xxhash64(F.col(order), F.col(tie)), F.lit(parts)))
    sizes = keyed.groupBy(F.col(src).alias("src"), F.col(part).alias("part")).agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    before = sizes.select("src", "part", "n", ahead.alias("off"))
    runs = before.withColumn("run", F.explode(F.sequence(F.expr(f"off div {block * RUN}"), F.expr(f"(off + n - 1) div {block * RUN}"))))
    met = runs.join(steps, ["src", "run"]).groupBy("src", "part").agg(F.first("off").alias("off"), F.array_sort(F.collect_list(F.struct("first", "slots", "phases"))).alias("p"))
    placed = met.select(F.col("src").alias(b_src), F.col("part").alias(b_part), F.col("off").alias(b_n), F.col("p")[0]["first"].alias(b_first), F.flatten("p.slots").alias(b_slots), F.flatten("p.phases").alias(b_phases))

    ranked = keyed.withColumn(rank, F.row_number().over(Window.partitionBy(src, part).orderBy(order, tie)) - 1)
    ranked = ranked.join(placed, (F.col(src) == F.col(b_src)) & (F.col(part) == F.col(b_part)))
    at = F.col(rank) + F.col(b_n)
    nth = (F.floor(at / block) - F.col(b_first)).cast("int")
    return ranked.select(*quoted(docs.columns), F.get(F.col(b_phases), nth).alias("mix_phase"), F.get(F.col(b_slots), nth).alias("mix_slot"), (at % block).cast("int").alias("mix_index"))


def in_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, unchanged, range-partitioned and sorted in the order of the mix."""
    slot, index = free_name(docs, "__mix_slot"), free_name(docs, "__mix_index")
    own = [c for c in docs.columns if c in ("mix_phase", "mix_slot", "mix_index")]
    kept = {c: free_name(docs, f"__kept_{c}") for c in own}
    for c, name in kept.items():
        docs = docs.withColumnRenamed(c, name)
    mixed = mix(docs, **options).withColumnRenamed("mix_slot", slot).withColumnRenamed("mix_index", index).drop("mix_phase")
    for c, name in kept.items():
        mixed = mixed.withColumnRenamed(name, c)
    ordered = mixed.repartitionByRange(slot, index).sortWithinPartitions(slot, index)
    return ordered.drop(slot, index)
