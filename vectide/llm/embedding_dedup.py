"""Near-duplicate vectors by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

#: Vectors in a block and in a leaf of the recursion, neighbouring blocks that are shipped together; leading principal
#: dimensions of the boxes, and those of the grid.
BLOCK, LEAF, TILE, DIMS, CELLS = 4096, 16, 16, 16, 16
#: Components that a block of longer vectors has at most, so that a pair of tiles fits a task.
MOST = BLOCK * 64
#: The dimensions are found from so many vectors at most, those with the smallest hash; they set the order, not the result.
SAMPLE = 4096
#: Children of an interval are found by this many bits of the sequence number.
FAN_BITS = 4
#: Single-precision cosines this far from the threshold need no second look.
MARGIN = 1e-4


def _doubles(vectors: bytes, dim: int) -> np.ndarray:
    """Vectors that are kept in single precision if they came so, else in double."""
    return np.frombuffer(vectors[1:], dtype="<f4" if vectors[:1] == b"4" else "<f8").reshape(-1, dim).astype(np.float64)


def _joined(vectors: list[bytes]) -> bytes:
    return vectors[0][:1] + b"".join(x[1:] for x in vectors)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pack_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out, dims = [], []
        single = pa.types.is_float32(b.schema.field(1).type.value_type)
        for x in b.column(1):
            v = x.values
            ok = x.is_valid and len(v) and not v.null_count
            a = np.asarray(v.to_numpy(zero_copy_only=False), dtype="<f4" if single else "<f8") if ok else None
            ok = ok and np.isfinite(a).all() and a.any()
            out.append((b"4" if single else b"8") + (a + a.dtype.type(0)).tobytes() if ok else None)  # no negative zeros
            dims.append(len(a) if ok else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.array(dims, pa.int32())], names=["vec_id", "v", "dim"])


def _rotate(axes: dict[int, np.ndarray], eps: float):
    """Adds y, the place on the axes and the length of what is off them, so that distances of y bound those of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                x, turn = _unit(_doubles(_joined(part.column("v").to_pylist()), dim)), axes[int(dim)]
                y = np.zeros((part.num_rows, DIMS + 1))
                got = x @ turn
                y[:, : got.shape[1]] = got
                y[:, DIMS] = np.linalg.norm(x - got @ turn.T, axis=1)
                cells = [pa.array(np.floor(y[:, i] / eps).astype(np.int32)) for i in range(CELLS)]
                flat = pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), DIMS + 1).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(n) for n in ("rep", "m", "dim", "v")] + [flat] + cells, names=["rep", "m", "dim", "v", "y", *[f"c{i}" for i in range(CELLS)]])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts a sorted partition into blocks of one dimension with their boxes."""
    part, seq = TaskContext.get().partitionId(), 0
    held: list[tuple] = []

    def block() -> pa.RecordBatch:
        nonlocal seq, held
        y = np.array([h[4] for h in held])
        row = {"part": [part], "seq": [seq], "dim": [held[0][2]], "lo": [y.min(axis=0).tolist()], "hi": [y.max(axis=0).tolist()]}
        row |= {"ids": [np.array([h[0] for h in held], "<i8").tobytes()], "ms": [np.array([h[1] for h in held], "<i8").tobytes()], "vs": [_joined([h[3] for h in held])], "ys": [y.astype("<f4").tobytes()]}
        seq, held = seq + 1, []
        return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("dim", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("ids", pa.binary()), ("ms", pa.binary()), ("vs", pa.binary()), ("ys", pa.binary())]))

    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(5))):
            if held and (len(held) >= min(BLOCK, max(LEAF, MOST // held[0][2])) or held[0][2] != row[2]):
                yield block()
            held.append(row)
    if held:
        yield block()


def _apart(eps: float) -> Column:
    """Whether boxes (lo, hi) and (lo2, hi2) are farther apart than eps."""
    gaps = [F.greatest(F.lit(0.0), F.get("lo2", F.lit(i)) - F.get("hi", F.lit(i)), F.get("lo", F.lit(i)) - F.get("hi2", F.lit(i))) for i in range(DIMS + 1)]
    return sum(g * g for g in gaps) > F.lit(eps * eps)


def near_blocks(boxes: DataFrame, top: int, eps: float) -> DataFrame:
    """Pairs (a, b), a <= b, of block numbers whose boxes (id, dim, lo, hi) are within eps, by recursion over the sequence.

    Intervals of 2^FAN_BITS neighbours have the box of all; a pair of intervals is opened only if its boxes are near.
    """
    pick = lambda f, c: F.array(*[f(F.get(c, F.lit(i))) for i in range(DIMS + 1)]).alias(c)
    levels = [boxes.select("id", "dim", "lo", "hi")]
    while top >> FAN_BITS * (len(levels) - 1):
        at = levels[-1].withColumn("id", F.shiftright("id", FAN_BITS))
        levels.append(at.groupBy("id", "dim").agg(pick(F.min, "lo"), pick(F.max, "hi")))
    pairs = levels[-1].select(F.col("id").alias("a"), F.col("id").alias("b"), "dim")
    for nodes in levels[-2::-1]:
        up = F.shiftright("id", FAN_BITS)
        one = nodes.select(up.alias("a"), "dim", F.col("id").alias("a1"), "lo", "hi")
        two = nodes.select(up.alias("b"), "dim", F.col("id").alias("b1"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        opened = pairs.join(one, ["a", "dim"]).join(two, ["b", "dim"]).where((F.col("a1") <= F.col("b1")) & ~_apart(eps))
        pairs = opened.select(F.col("a1").alias("a"), F.col("b1").alias("b"), "dim")
    return pairs.select("a", "b")


def _halves(lo: np.ndarray, hi: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Boxes of intervals of 1, 2, 4 ... neighbouring leaves, up to one of all."""
    out = [(lo, hi)]
    while len(lo) > 1:
        at = np.arange(0, len(lo), 2)
        lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
        out.append((lo, hi))
    return out


def near_leaves(ya: np.ndarray, yb: np.ndarray, eps: float) -> np.ndarray:
    """Which leaves (intervals of LEAF rows) of two blocks may hold links: halves of intervals are compared if the intervals are near."""

    def leaves(y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        at = np.arange(0, len(y), LEAF)
        return _halves(np.minimum.reduceat(y, at), np.maximum.reduceat(y, at))

    a, b = leaves(ya), leaves(yb)
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(max(len(a), len(b)) - 1, -1, -1):
        (al, ah), (bl, bh) = a[min(level, len(a) - 1)], b[min(level, len(b) - 1)]
        if level + 1 < len(a):
            i, j = np.repeat(2 * i, 2), np.repeat(j, 2)
            i[1::2] += 1
        if level + 1 < len(b):
            i, j = np.repeat(i, 2), np.repeat(2 * j, 2)
            j[1::2] += 1
        keep = (i < len(al)) & (j < len(bl))
        i, j = i[keep], j[keep]
        gap = np.maximum(0.0, np.maximum(bl[j] - ah[i], al[i] - bh[j]))
        near = (gap * gap).sum(axis=1) <= eps * eps
        i, j = i[near], j[near]
    out = np.zeros((len(a[0][0]), len(b[0][0])), dtype=bool)
    out[i, j] = True
    return out


def join_blocks(a: dict, b: dict, same: bool, threshold: float, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(links of each row of a, of each row of b, edges u, edges v, pairs compared): links count copies; edges are a forest of the links."""
    na, nb = len(a["ids"]), len(b["ids"])
    fa, fb = a["f"], b["f"]
    la, lb = np.zeros(na, np.int64), np.zeros(nb, np.int64)
    label = np.arange(na + (0 if same else nb))
    near, compared = near_leaves(a["y"], b["y"], eps), 0
    rows_b = np.arange(nb)
    step = 1 if near.mean() < 0.5 else 16  # leaves of a that are taken at once
    for leaf in range(0, len(near), step):
        ra = slice(leaf * LEAF, min(na, (leaf + step) * LEAF))
        some = near[leaf : leaf + step].any(axis=0)
        if same:
            some &= np.arange(len(some)) >= leaf
        cols = rows_b[np.repeat(some, LEAF)[:nb]]
        if not len(cols):
            continue
        cos = fa[ra] @ (fb if len(cols) == nb else fb[cols]).T
        compared += cos.size
        hit = cos >= np.float32(threshold - MARGIN)
        if same:
            hit &= cols > np.arange(ra.start, ra.stop)[:, None]
        if not hit.any():
            continue
        i, j = np.nonzero(hit & (cos < np.float32(threshold + MARGIN)))
        if len(i):
            exact = np.einsum("ij,ij->i", a["u"][ra][i], b["u"][cols[j]])
            hit[i[exact < threshold], j[exact < threshold]] = False
        la[ra] += hit @ b["m"][cols]
        lb[cols] += hit.T @ a["m"][ra]
        base = cols + (0 if same else na)
        for k in np.flatnonzero(hit.any(axis=1)):
            seen = np.unique(label[np.append(base[hit[k]], ra.start + k)])
            if len(seen) > 1:
                label[np.isin(label, seen)] = seen[0]
    ids = a["ids"] if same else np.concatenate([a["ids"], b["ids"]])
    moved = np.flatnonzero(label != np.arange(len(label)))
    return (la + lb if same else la), (np.zeros(0, np.int64) if same else lb), ids[moved], ids[label[moved]], compared


_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])


def _join(threshold: float, eps: float, log_tile: int):
    """Joins the blocks of two tiles (ta, tb, a block a row, with the blocks of the other tile that it may meet).

    Rows (u, null, n) have links of u, (u, v, 0) edges, (null, null, n) the number of pairs compared.
    """

    def block(row: dict) -> dict:
        ids = np.frombuffer(row["ids"], "<i8")
        u = _unit(_doubles(row["vs"], row["dim"]))
        return {"ids": ids, "m": np.frombuffer(row["ms"], "<i8"), "u": u, "f": u.astype(np.float32), "y": np.frombuffer(row["ys"], "<f4").reshape(len(ids), -1)}

    def run(rows: pa.Table) -> pa.Table:
        ta, tb = rows["ta"][0].as_py(), rows["tb"][0].as_py()
        rows = rows.sort_by("id")
        number, meets = rows["id"].to_pylist(), rows["meets"].to_pylist()
        of = {k: i for i, k in enumerate(number)}
        made = lambda k: block(rows.slice(of[k], 1).to_pylist()[0])
        ready = {k: made(k) for k in number if k >> log_tile == tb}
        found, compared = [pa.table({x: pa.array([], pa.int64()) for x in _LINKS.names})], 0
        for k, others in zip(number, meets):
            if k >> log_tile != ta or not others:
                continue
            a = ready[k] if ta == tb else made(k)
            for other in others:
                b = ready[other]
                la, lb, u, v, n = join_blocks(a, b, k == other, threshold, eps)
                ids, links = (a["ids"], la) if k == other else (np.concatenate([a["ids"], b["ids"]]), np.concatenate([la, lb]))
                some = np.flatnonzero(links)
                to = pa.array(np.concatenate([np.zeros(len(some), np.int64), v]), mask=np.arange(len(some) + len(u)) < len(some))
                found.append(pa.table([pa.array(np.concatenate([ids[some], u])), to, pa.array(np.concatenate([links[some], np.zeros(len(u), np.int64)]))], schema=_LINKS))
                compared += n
        found.append(pa.table([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([compared], pa.int64())], schema=_LINKS))
        return pa.concat_tables(found)

    return run


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension that vectors (rep, dim, v) have, the leading principal directions of at most SAMPLE of them."""
    axes = {}
    for r in vectors.groupBy("dim").count().collect():
        dim = r["dim"]
        got = vectors.where(F.col("dim") == dim).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").collect()
        x = _unit(_doubles(_joined([bytes(g["v"]) for g in got]), dim))
        axes[dim] = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:DIMS].T
    return axes


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id) for each row of vectors (vec_id, embedding, ...): links at cosine >= threshold.

    n_links counts the other rows linked directly; component_id is the smallest vec_id reachable, itself included.
    Vectors that are null, empty, zero or hold null or non-finite numbers, and rows with a null vec_id, link with
    nothing, nor do vectors of different dimensions. Equal vectors are collapsed and counted. The join is exact: blocks
    of the grid order are skipped only if their boxes on the leading principal dimensions are too far apart, and cosines
    near the threshold are computed in double precision. Counts and a spanning forest leave a block pair, never pairs.
    Blocks are shipped by tiles of neighbours, so that a block goes to one task for each tile that it may meet. Other
    columns of vectors are ignored. No rows give no rows.
    """
    return joined(vectors, threshold)[0]


def joined(vectors: DataFrame, threshold: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """near_duplicates() and the table (rows, compared): distinct vectors, and pairs of them whose cosine was computed."""
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-5  # boxes within blocks are in single precision
    rows = cut(vectors.select(F.col("vec_id").cast("long"), F.col("embedding")).mapInArrow(_pack_vectors, "vec_id long, v binary, dim int"), "vectors")
    valid = rows.where("v is not null and vec_id is not null")
    distinct = cut(valid.groupBy("v", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")), "distinct")
    turned = distinct.mapInArrow(_rotate(principal_axes(distinct), eps), "rep long, m long, dim int, v binary, y array<double>, " + ", ".join(f"c{i} int" for i in range(CELLS)))
    turned = cut(turned, "turned")
    order = ["dim", *[f"c{i}" for i in range(CELLS)], F.get("y", F.lit(0)), "rep"]
    parts = max(1, -(-distinct.count() // (2 * BLOCK)))
    sequence = turned.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("rep", "m", "dim", "v", "y")
    blocks = cut(sequence.mapInArrow(_blocks, "part int, seq int, dim int, lo array<double>, hi array<double>, ids binary, ms binary, vs binary, ys binary"), "blocks")
    last = blocks.agg(F.max("part"), F.max("seq")).first()
    bits = int(last[1] or 0).bit_length()
    blocks = blocks.withColumn("id", F.shiftleft(F.col("part").cast("long"), bits) + F.col("seq"))
    pairs = near_blocks(blocks, ((last[0] or 0) << bits) + (last[1] or 0), eps)
    log_tile = TILE.bit_length() - 1
    tile = lambda c: F.shiftright(c, log_tile)
    # each block once for each pair of tiles that has a use for it, with the blocks that it is to be joined with
    pairs = cut(pairs.select(tile("a").alias("ta"), tile("b").alias("tb"), "a", "b"), "pairs")
    first = pairs.groupBy("ta", "tb", F.col("a").alias("id")).agg(F.collect_list("b").alias("meets"))
    second = pairs.groupBy("ta", "tb", F.col("b").alias("id")).agg(F.array().cast("array<bigint>").alias("meets"))
    used = first.unionByName(second).groupBy("ta", "tb", "id").agg(F.max("meets").alias("meets"))
    apart = used.join(blocks.select("id", "dim", "ids", "ms", "vs", "ys"), "id")
    found = cut(apart.groupBy("ta", "tb").applyInArrow(_join(threshold, eps, log_tile), "u long, v long, n long"), "links")
    counts = found.where("v is null and u is not null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    comp = components(found.where("v is not null").select("u", "v")).withColumnRenamed("node", "rep")
    told = distinct.join(counts, "rep", "left").join(comp, "rep", "left")
    told = told.select("v", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    linked = valid.join(told, "v").select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where("v is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    compared = found.where("u is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("compared"))
    return linked.unionByName(alone), distinct.agg(F.count("*").alias("rows")).join(F.broadcast(compared))
