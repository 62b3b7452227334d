"""Approximate nearest neighbours: navigable small-world graphs, one for each shard of the table.

A shard is built in ascending id, so a build can be repeated. Every search visits all shards; there the queries of a batch
walk together, so that a step is a few operations on arrays.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..arrow import matrix
from ..config import IndexConfig
from ..errors import IncompatibleIndex, InvalidConfig, ReadOnly, ZeroK
from ..functions.metrics import FIRST_CUSTOM_ID, Metric
from ..table import VectorTable
from .quantize import Codec
from .search import query_lots, top_k

#: No level is higher: a node gets there with a probability of m to the power of minus it.
MOST_LEVEL = 64
#: Rows of a shard where the number of shards isn't set; nodes whose neighbours are chosen at once; marks of visited nodes.
SHARD_ROWS, BATCH, VISITED = 8192, 32, 32 << 20
#: Numbers of vectors that an own metric gets at once; places that the lists of a lot of queries have at most.
STRETCH, PLACES = 1 << 16, 4 << 20
#: So many times the rows asked for are left by products in single precision at most; else double precision tells them.
MOST_LEFT = 8

NODES = "shard int, id long, vector array<double>, level int, links array<array<long>>, dists array<array<float>>"


def level_of(id: int, seed: int, m: int) -> int:
    """The top layer of a node: geometric, from the first 32 bits of MD5 of "seed:id"."""
    u = (int(hashlib.md5(f"{seed}:{id}".encode()).hexdigest()[:8], 16) + 1) / 2.0**32
    return int(-math.log(u) / math.log(m))


def pairs(metric: Metric) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Distances of the rows of one matrix to those of another, by differences as the metric has them."""

    def cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
        both = np.sqrt(np.einsum("ij,ij->i", q, q) * np.einsum("ij,ij->i", v, v))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(both == 0, 1.0, 1 - np.clip(np.einsum("ij,ij->i", q, v) / both, -1.0, 1.0))

    def squared(q: np.ndarray, v: np.ndarray) -> np.ndarray:
        d = v - q
        return np.einsum("ij,ij->i", d, d)

    known = {
        "sqeuclidean": squared,
        "euclidean": lambda q, v: np.sqrt(squared(q, v)),
        "cosine": cosine,
        "dot": lambda q, v: 1 - np.einsum("ij,ij->i", q, v),
        "manhattan": lambda q, v: np.abs(v - q).sum(axis=1),
    }
    if metric.id < FIRST_CUSTOM_ID and metric.name in known:
        return known[metric.name]
    return lambda q, v: np.array([metric.kernel(x, y[None])[0] for x, y in zip(q, v)])


def _kernel(metric: Metric, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """metric.kernel() in stretches that stay in the processor's cache."""
    step = max(1, STRETCH // max(v.shape[1], 1))
    return np.concatenate([metric.kernel(q, v[at : at + step]) for at in range(0, len(v), step)]) if len(v) else np.zeros(0)


def scored(metric: Metric, q: np.ndarray, v: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """score(rows of q, rows of v): pairs(), or for own metrics a call for each stretch of rows of one query."""
    if metric.id < FIRST_CUSTOM_ID:
        between = pairs(metric)
        return lambda who, at: between(q[who], v[at])

    def score(who: np.ndarray, at: np.ndarray) -> np.ndarray:
        ends = np.append(np.flatnonzero(who[1:] != who[:-1]) + 1, len(who)) if len(who) else []
        starts = np.append(0, ends[:-1]) if len(who) else []
        return np.concatenate([np.zeros(0), *[_kernel(metric, q[who[a]], v[at[a:b]]) for a, b in zip(starts, ends)]])

    return score


def _units(x: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


class Products:
    """Tells by matrix products which rows of a matrix may be among the k nearest to a query.

    That is all but those that are farther than the k-th by more than products can err by, so the exact distances of the
    rows that are left decide. Products are in single precision until that leaves too many rows.
    """

    def __init__(self, by: str, v: np.ndarray):
        self.by, self.v = by, _units(v) if by == "cosine" else v
        self.squares = np.einsum("ij,ij->i", self.v, self.v)
        self.longest = math.sqrt(self.squares.max(initial=0))
        self.single = (self.v.astype(np.float32), self.squares.astype(np.float32)) if 1e-15 < self.longest < 1e15 else None

    @classmethod
    def of(cls, metric: Metric, *all_rows: np.ndarray) -> Products | None:
        """For the last matrix; None for metrics that aren't told by products, and for numbers whose squares leave the range."""
        if metric.id >= FIRST_CUSTOM_ID or metric.name not in ("euclidean", "sqeuclidean", "cosine", "dot"):
            return None
        for x in all_rows:
            most = np.abs(x).max(axis=1, initial=0)
            if not (most < 1e70).all() or (metric.name == "cosine" and ((most > 0) & (most < 1e-70)).any()):
                return None
        return cls(metric.name, all_rows[-1])

    def lists(self, q: np.ndarray, k: int, rows: np.ndarray | slice = slice(None), first: np.ndarray | None = None) -> list[np.ndarray]:
        """For each query the places among rows, or among so many first of them, that may be of the k nearest."""
        if self.by == "cosine":
            q = _units(q)
        length = np.sqrt(np.einsum("ij,ij->i", q, q))
        if self.single and length.max(initial=0) < 1e15:
            out = self._lists(q.astype(np.float32), length, k, *self.single, rows, first)
            if max(map(len, out), default=0) <= MOST_LEFT * k:
                return out
            self.single = None
        return self._lists(q, length, k, self.v, self.squares, rows, first)

    def _lists(self, q: np.ndarray, length: np.ndarray, k: int, v: np.ndarray, squares: np.ndarray, rows: np.ndarray | slice, first: np.ndarray | None) -> list[np.ndarray]:
        s = q @ v[rows].T
        eps, one = np.finfo(v.dtype).eps, np.finfo(float).eps
        if self.by in ("cosine", "dot"):
            s, size = np.negative(s, out=s), self.longest * length + one / eps
        else:
            s *= -2
            s += squares[rows]
            size = (self.longest + length) ** 2
        off = 16 * (q.shape[1] + 8) * eps * size + (1e-300 if v.dtype == float else 1e-36 * q.shape[1])
        out = []
        for i, x in enumerate(s):
            x = x if first is None else x[: first[i]]
            if len(x) <= k:
                out.append(np.arange(len(x)))
                continue
            most = np.partition(x, k - 1)[k - 1] + off[i]
            out.append(np.flatnonzero(x <= np.nextafter(most.astype(x.dtype), x.dtype.type(np.inf))))
        return out


def rough(metric: Metric, q: np.ndarray, v: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray] | None:
    """score(rows of q, rows of v): pairs() in single precision, squared if Euclidean; None where that isn't enough."""
    if metric.id >= FIRST_CUSTOM_ID or not (np.abs(q).max(initial=0) < 1e15 and np.abs(v).max(initial=0) < 1e15):
        return None

    if metric.name == "cosine":
        q, v = _units(q), _units(v)
    q, v = q.astype(np.float32), v.astype(np.float32)
    if metric.name in ("cosine", "dot"):
        return lambda who, at: 1 - np.einsum("ij,ij->i", q[who], v[at])
    if metric.name in ("euclidean", "sqeuclidean"):

        def squared(who: np.ndarray, at: np.ndarray) -> np.ndarray:
            d = v[at]
            d -= q[who]
            return np.einsum("ij,ij->i", d, d)

        return squared
    return None


def _among(metric: Metric, x: np.ndarray) -> np.ndarray:
    """Distances between all rows of each matrix of a stack, squared if Euclidean, good enough to tell which of two is larger."""
    if metric.id < FIRST_CUSTOM_ID and metric.name in ("sqeuclidean", "euclidean"):
        x = x - x[:, :1]  # near each other, so that little cancels
        if x.max(initial=0) - x.min(initial=0) < 1e15:
            x = x.astype(np.float32)
        n = np.einsum("bij,bij->bi", x, x)
        d = x @ x.transpose(0, 2, 1)
        d *= -2
        d += n[:, :, None]
        d += n[:, None, :]
        return d
    if metric.id < FIRST_CUSTOM_ID and metric.name in ("cosine", "dot"):
        if metric.name == "cosine":
            n = np.sqrt(np.einsum("bij,bij->bi", x, x))[:, :, None]
            x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
        return 1 - x @ x.transpose(0, 2, 1)
    return np.stack([np.stack([metric.kernel(row, y) for row in y]) for y in x])


@dataclass
class Layer:
    """The nodes of a layer (places), where each is among them, and a row of neighbours (places, -1 behind the last) for each."""

    nodes: np.ndarray
    row: np.ndarray
    near: np.ndarray
    dist: np.ndarray
    count: np.ndarray

    @classmethod
    def empty(cls, most: int) -> Layer:
        return cls(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros((0, most), np.int32), np.zeros((0, most), np.float32), np.zeros(0, np.int32))

    def grow(self, total: int, nodes: np.ndarray) -> None:
        """Adds nodes without links to a layer of a graph that has now so many nodes."""
        old, k = len(self.nodes), len(nodes)
        row = np.full(total, -1, dtype=np.int32)
        row[: len(self.row)] = self.row
        row[nodes] = np.arange(old, old + k)
        most = self.near.shape[1]
        self.nodes, self.row = np.concatenate([self.nodes, nodes.astype(np.int32)]), row
        self.near = np.concatenate([self.near, np.full((k, most), -1, np.int32)])
        self.dist = np.concatenate([self.dist, np.full((k, most), np.inf, np.float32)])
        self.count = np.concatenate([self.count, np.zeros(k, np.int32)])


class Graph:
    """One shard: places are numbers from 0 in insertion order, which is that of ids.

    A new node's candidates are the ef_construction nearest of the earlier nodes of a layer, found by their distances, as
    shards are bounded; so they don't depend on the links, and a graph that has grown equals one built at once.
    """

    def __init__(self, dim: int, metric: Metric, config: IndexConfig):
        self.dim, self.metric, self.config = dim, metric, config
        self.ids = np.zeros(0, dtype=np.int64)
        self.vectors = np.zeros((0, dim))
        self.levels = np.zeros(0, dtype=np.int32)
        self.layers: list[Layer] = []

    # building

    def choose(self, dist: np.ndarray, between: np.ndarray, most: int, diverse: bool) -> list[np.ndarray]:
        """For each row of ascending candidate distances (inf behind the last) the places of those that are taken.

        The nearest, or those nearer to the node than to any taken before; then, with keep_pruned, the nearest others.
        """
        rows, c = dist.shape
        real = np.isfinite(dist)
        enough = real.sum(axis=1) <= most
        taken = np.zeros((rows, c), dtype=bool)
        if diverse and not enough.all():
            if self.metric.name == "euclidean" and self.metric.id < FIRST_CUSTOM_ID:
                dist = dist * dist  # as between has it
            n = np.zeros(rows, dtype=np.int64)
            for t in range(c):
                close = (taken & (between[:, t] <= dist[:, t, None])).any(axis=1)
                taken[:, t] = real[:, t] & (n < most) & ~close
                n += taken[:, t]
            if self.config.keep_pruned:
                spare = real & ~taken
                taken |= spare & (np.cumsum(spare, axis=1) <= (most - n)[:, None])
        else:
            taken = real & (np.cumsum(real, axis=1) <= most)
        taken[enough] = real[enough]
        return [np.flatnonzero(x) for x in taken]

    def _link(self, layer: Layer, most: int, node: int, to: np.ndarray, dist: np.ndarray) -> None:
        """Links a new node with those chosen, and these with it; a list that is too long loses its farthest, or what isn't diverse."""
        at = layer.row[node]
        k = len(to)
        layer.near[at, :k], layer.dist[at, :k], layer.count[at] = to, dist, k
        rows = layer.row[to]
        full = layer.count[rows] >= most
        free = rows[~full]
        layer.near[free, layer.count[free]], layer.dist[free, layer.count[free]] = node, dist[~full]
        layer.count[free] += 1
        rows, dist = rows[full], dist[full]
        if self.config.prune_strategy != "heuristic":
            last = layer.dist[rows].argmax(axis=1)
            nearer = dist < layer.dist[rows, last]
            rows, last = rows[nearer], last[nearer]
            layer.near[rows, last], layer.dist[rows, last] = node, dist[nearer]
            return
        for r, d in zip(rows.tolist(), dist.tolist()):
            near, far = np.append(layer.near[r], node), np.append(layer.dist[r], np.float32(d))
            order = np.lexsort((near, far))
            near, far = near[order], far[order]
            kept = self.choose(far[None], _among(self.metric, self.vectors[near][None]), most, True)[0]
            layer.near[r, len(kept) :], layer.dist[r, len(kept) :] = -1, np.inf
            layer.near[r, : len(kept)], layer.dist[r, : len(kept)], layer.count[r] = near[kept], far[kept], len(kept)

    def _candidates(self, layer: Layer, nodes: np.ndarray, products: Products | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of some ascending nodes the nearest earlier nodes of a layer, ascending by distance and place."""
        ef, first = self.config.ef_construction, np.searchsorted(layer.nodes, nodes)
        earlier = layer.nodes[: first[-1]]
        rows = slice(0, len(earlier)) if len(earlier) == nodes[-1] else earlier  # all nodes, or some
        if products is None:
            v = self.vectors[rows]
            lists, dists = [np.arange(n) for n in first], [_kernel(self.metric, self.vectors[x], v[:n]) for x, n in zip(nodes, first)]
        else:
            lists = products.lists(self.vectors[nodes], ef, rows, first)
            sizes = [len(x) for x in lists]
            d = pairs(self.metric)(self.vectors[np.repeat(nodes, sizes)], self.vectors[earlier[np.concatenate(lists)]])
            dists = np.split(d, np.cumsum(sizes)[:-1])
        out = []
        for at, d in zip(lists, dists):
            if len(d) > ef:
                some = np.flatnonzero(d <= np.partition(d, ef - 1)[ef - 1])
                at, d = at[some], d[some]
            order = np.lexsort((at, d))[:ef]
            out.append((earlier[at[order]], d[order]))
        return out

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Inserts rows in ascending id."""
        c, first = self.config, len(self.ids)
        self.ids, self.vectors = np.concatenate([self.ids, ids]), np.concatenate([self.vectors, vectors])
        levels = np.array([level_of(i, c.seed, c.m) for i in ids.tolist()], dtype=np.int32)
        self.levels = np.concatenate([self.levels, levels])
        while len(self.layers) <= int(self.levels.max(initial=-1)):
            self.layers.append(Layer.empty(c.max_links(len(self.layers))))
        for number, layer in enumerate(self.layers):
            layer.grow(len(self.ids), first + np.flatnonzero(levels >= number))
        step = 1 if c.use_heuristic and c.extend_candidates else BATCH
        products = Products.of(self.metric, self.vectors)
        for number, layer in enumerate(self.layers):
            most, new = c.max_links(number), layer.nodes[np.searchsorted(layer.nodes, first) :]
            for at in range(0, len(new), step):
                self._insert(layer, most, new[at : at + step], products)

    def _insert(self, layer: Layer, most: int, nodes: np.ndarray, products: Products | None) -> None:
        c = self.config
        found = self._candidates(layer, nodes, products)
        if c.use_heuristic and c.extend_candidates and len(found[0][0]):
            near, d = found[0]
            more = np.setdiff1d(layer.near[layer.row[near]], np.append(near, -1))
            near, d = np.append(near, more), np.append(d, self.metric.kernel(self.vectors[int(nodes[0])], self.vectors[more]) if len(more) else d[:0])
            order = np.lexsort((near, d))
            found = [(near[order], d[order])]
        width = max(c.ef_construction, len(found[0][0]))
        near, dist = np.zeros((len(nodes), width), np.int32), np.full((len(nodes), width), np.inf)
        for i, (x, d) in enumerate(found):
            near[i, : len(x)], dist[i, : len(x)] = x, d
        between = _among(self.metric, self.vectors[near]) if c.use_heuristic and np.isfinite(dist[:, min(most, width - 1)]).any() else np.zeros((len(nodes), width, 1))
        for i, (node, kept) in enumerate(zip(nodes.tolist(), self.choose(dist, between, most, c.use_heuristic))):
            if len(kept):
                self._link(layer, most, node, near[i, kept], dist[i, kept].astype(np.float32))

    # searching

    def search(self, queries: np.ndarray, score: Callable, k: int, ef: int, ok: np.ndarray | None = None, walk: Callable | None = None, lists: Callable | None = None) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """For each query the places and distances of the k nearest that a beam of ef finds, and how many refused nodes it met.

        score(query numbers, places) gives distances; walk does so roughly, for all but the results. All queries walk together, a step of each at a time. Nodes that
        aren't ok are walked through but not returned; then a walk ends once its nearest open node is farther than ef
        results. Where nothing can end a walk or shorten its list, as ef is all nodes or more than are ok, it goes on from nodes
        that no links lead to, so it meets all whatever their distances, and the order of steps is left out;
        lists(query numbers, k, places) may then tell for each query which of the places can be among the k nearest.
        """
        n, ef = len(self.ids), min(max(ef, k), max(len(self.ids), 1))
        places: list[np.ndarray] = []
        dists: list[np.ndarray] = []
        refused = np.zeros(len(queries), dtype=np.int64)
        if not n:
            return [np.zeros(0, np.int64)] * len(queries), [np.zeros(0)] * len(queries), refused
        width = ef if ok is None else min(n, int(2 * ef / max(ok.mean(), 1e-9)) + 64)
        endless = ef >= n or (ok is not None and ok.sum() < ef)
        lot = max(1, min(VISITED // n, PLACES // width))
        for first in range(0, len(queries), lot):
            q = np.arange(first, min(first + lot, len(queries)))
            if endless:
                for x, y, r in self._everywhere(score, q, k, ok, lists):
                    places.append(x)
                    dists.append(y)
                    refused[len(places) - 1] = r
                continue
            at, d = self._descend(walk or score, q)
            got, wider = self._beam(walk or score, q, at, d, ef, width, ok), width
            while ok is not None and got[3].any():  # some lists were too short to go on
                cut = np.flatnonzero(got[3])
                wider = min(n, 4 * wider)
                for again in np.array_split(cut, -(-len(cut) * wider // PLACES)):
                    more = self._beam(walk or score, q[again], at[again], d[again], ef, wider, ok)
                    for j, i in enumerate(again):
                        got[0][i], got[1][i], got[2][i], got[3][i] = more[0][j], more[1][j], more[2][j], more[3][j]
            if walk is not None:
                sizes = [len(x) for x in got[0]]
                got = (got[0], np.split(score(np.repeat(q, sizes), np.concatenate(got[0])), np.cumsum(sizes)[:-1]), got[2], got[3])
            for x, y in zip(got[0], got[1]):
                order = np.lexsort((x, y))[:k]
                places.append(x[order])
                dists.append(y[order])
            refused[q] = got[2]
        return places, dists, refused

    def _everywhere(self, score: Callable, q: np.ndarray, k: int, ok: np.ndarray | None, lists: Callable | None):
        """(places, distances, refused) of each query, of walks that meet all nodes."""
        some = np.arange(len(self.ids)) if ok is None else np.flatnonzero(ok)
        step = max(1, PLACES // len(self.ids)) if lists else 1
        for first in range(0, len(q), step):
            mine = q[first : first + step]
            short = [some[x] for x in lists(mine, k, some)] if lists else [some]
            sizes = [len(x) for x in short]
            dist = score(np.repeat(mine, sizes), np.concatenate(short))
            for x, y in zip(short, np.split(dist, np.cumsum(sizes)[:-1])):
                if len(y) > k:
                    kept = np.flatnonzero(~(y > np.partition(y, k - 1)[k - 1]))
                    x, y = x[kept], y[kept]
                order = np.lexsort((x, y))[:k]
                yield x[order], y[order], len(self.ids) - len(some)

    def _descend(self, score: Callable, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest nodes that walking downhill reaches above the base layer."""
        entry = int(self.levels.argmax())
        at = np.full(len(q), entry)
        d = score(q, at)
        for layer in self.layers[:0:-1]:
            moving = np.arange(len(q))
            while len(moving):
                near = layer.near[layer.row[at[moving]]]
                r, c = np.nonzero(near >= 0)
                if not len(r):
                    break
                all_d = np.full(near.shape, np.inf)
                all_d[r, c] = score(q[moving[r]], near[r, c])
                best = all_d.argmin(axis=1)
                best_d = all_d[np.arange(len(moving)), best]
                better = best_d < d[moving]
                moving, best, best_d, near = moving[better], best[better], best_d[better], near[better]
                at[moving], d[moving] = near[np.arange(len(moving)), best], best_d
        return at, d

    def _beam(self, score: Callable, q: np.ndarray, at: np.ndarray, d: np.ndarray, ef: int, width: int, ok: np.ndarray | None):
        """(places, distances, refused, cut) of each query: best-first in the base layer, with lists of the width nearest seen."""
        b, n, layer = len(q), len(self.ids), self.layers[0]
        seen = np.zeros((b, n), dtype=bool)
        seen[np.arange(b), at] = True
        place, dist, done = np.full((b, width), -1), np.full((b, width), np.inf), np.ones((b, width), dtype=bool)
        place[:, 0], dist[:, 0], done[:, 0] = at, d, False
        lost = np.zeros(b, dtype=bool)
        alive = np.arange(b)
        most = layer.near.shape[1]
        at_once = max(1, min(16, width // 16))  # open nodes of a walk that a step takes
        while len(alive):
            open_ = np.where(done[alive], np.inf, dist[alive])
            best = np.argpartition(open_, at_once - 1, axis=1)[:, :at_once] if at_once < width else np.arange(width)[None].repeat(len(alive), axis=0)
            best_d = np.take_along_axis(open_, best, axis=1)
            go = np.isfinite(best_d)
            if ok is not None:
                mine = np.where((place[alive] >= 0) & ok[place[alive]], dist[alive], np.inf)
                go &= best_d <= np.partition(mine, ef - 1, axis=1)[:, ef - 1 : ef]
            some = go.any(axis=1)
            alive, best, go = alive[some], best[some], go[some]
            if not len(alive):
                break
            done[alive[:, None], best] |= go
            near = np.full((len(alive), at_once * most), -1)
            for j in range(at_once):
                r = np.flatnonzero(go[:, j])
                own = layer.near[place[alive[r], best[r, j]]]
                own = np.where((own >= 0) & ~seen[alive[r, None], own], own, -1)
                i, c = np.nonzero(own >= 0)
                seen[alive[r[i]], own[i, c]] = True
                near[r, j * most : (j + 1) * most] = own
            near = near[:, (near >= 0).any(axis=0)]
            r, c = np.nonzero(near >= 0)
            if not len(r):
                continue
            new = np.full(near.shape, np.inf)
            new[r, c] = score(q[alive[r]], near[r, c])
            all_d = np.concatenate([dist[alive], new], axis=1)
            keep = np.argpartition(all_d, width - 1, axis=1)[:, :width]
            if ok is not None:
                lost[alive] |= np.isfinite(all_d).sum(axis=1) > width
            dist[alive] = np.take_along_axis(all_d, keep, axis=1)
            place[alive] = np.take_along_axis(np.concatenate([place[alive], near], axis=1), keep, axis=1)
            done[alive] = np.take_along_axis(np.concatenate([done[alive], near < 0], axis=1), keep, axis=1)
        good = np.isfinite(dist)
        refused = np.zeros(b, dtype=np.int64)
        if ok is not None:
            good &= ok[place]
            refused = (seen & ~ok).sum(axis=1)
            lost &= good.sum(axis=1) < ef
            lost &= width < n
        return [p[g] for p, g in zip(place, good)], [x[g] for x, g in zip(dist, good)], refused, lost

    # as rows

    def table(self, shard: int) -> pa.Table:
        n = len(self.ids)
        node = np.repeat(np.arange(n), self.levels + 1)
        start = np.concatenate([[0], np.cumsum(self.levels + 1)])
        counts = np.zeros(len(node), dtype=np.int64)
        for number, layer in enumerate(self.layers):
            counts[start[layer.nodes] + number] = layer.count
        inner = np.concatenate([[0], np.cumsum(counts)])
        near, dist = np.zeros(inner[-1], np.int64), np.zeros(inner[-1], np.float32)
        for number, layer in enumerate(self.layers):
            used = np.arange(layer.near.shape[1]) < layer.count[:, None]
            to = (inner[start[layer.nodes] + number][:, None] + np.arange(layer.near.shape[1]))[used]
            near[to], dist[to] = self.ids[layer.near[used]], layer.dist[used]

        def nested(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.ListArray.from_arrays(pa.array(inner, pa.int32()), values))

        flat = pa.array(self.vectors.ravel())
        return pa.table(
            {
                "shard": pa.array(np.full(n, shard, np.int32)),
                "id": pa.array(self.ids),
                "vector": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * self.dim, pa.int32()), flat),
                "level": pa.array(self.levels),
                "links": nested(pa.array(near)),
                "dists": nested(pa.array(dist)),
            }
        )

    @classmethod
    def of(cls, rows: pa.Table, dim: int, metric: Metric, config: IndexConfig) -> Graph:
        rows = rows.sort_by("id").combine_chunks()
        out = cls(dim, metric, config)
        out.ids = rows.column("id").to_numpy()
        out.vectors = matrix(rows.column("vector"), dim)
        links = rows.column("links").combine_chunks()
        links = links.chunk(0) if isinstance(links, pa.ChunkedArray) else links
        outer = links.offsets.to_numpy().astype(np.int64)
        lists = links.values
        inner = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy(zero_copy_only=False)
        dists = None
        if "dists" in rows.column_names:
            column = rows.column("dists").combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            dists = column.flatten().flatten().to_numpy(zero_copy_only=False)
        base = inner[outer[0]] if len(outer) and len(inner) else 0
        out.levels = (np.diff(outer) - 1).astype(np.int32)
        place = np.searchsorted(out.ids, values)
        if len(values) and (out.ids[np.minimum(place, len(out.ids) - 1)] != values)[base : inner[outer[-1]]].any():
            raise IncompatibleIndex("a link leads to a node that isn't there")
        for number in range(int(out.levels.max(initial=-1)) + 1):
            nodes = np.flatnonzero(out.levels >= number)
            first, last = inner[outer[nodes] + number], inner[outer[nodes] + number + 1]
            layer = Layer.empty(max(config.max_links(number), int((last - first).max(initial=0))))
            layer.grow(len(out.ids), nodes)
            layer.count = (last - first).astype(np.int32)
            used = np.arange(layer.near.shape[1]) < layer.count[:, None]
            at = (first[:, None] + np.arange(layer.near.shape[1]))[used]
            layer.near[used] = place[at]
            if dists is not None:
                layer.dist[used] = dists[at - base]
            out.layers.append(layer)
        return out


_FOUND = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64()), ("refused", pa.int64())])


@dataclass(frozen=True)
class GraphIndex:
    """nodes: (shard, id, vector, level, links, dists), links by layer. A compact index has no dists and can't grow."""

    nodes: DataFrame
    dim: int
    metric: Metric
    config: IndexConfig
    read_only: bool = False
    deleted: DataFrame | None = None

    def search(self, queries: DataFrame, k: int, ef: int, where: Column | str | None = None, payload: DataFrame | None = None, codes: DataFrame | None = None, codec: Codec | None = None, counters: bool = False, scorer: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
        """(query_id, rank, id, distance) for queries (query_id, vector): the nearest that beams of ef find in each shard.

        where is a condition on id and the columns of payload (id, ...); rows it refuses, and removed ones, are walked
        through but not returned, and a row without a payload has nulls there. With codes (id, codes, scale) and their codec distances come from the codes; there must
        be codes for the nodes and no others. With a scorer(vector of a query, ids) they are what it returns. counters
        adds refused, how many refused rows the walks of a query met in all shards. Queries go to every shard, at most
        QUERY_COMPONENTS numbers at a time; each further lot is another pass.
        """
        if k < 1:
            raise ZeroK()
        if codec is not None and (codec.dim != self.dim or codec.metric != self.metric.name):
            raise IncompatibleIndex("the codes are of another dimension or metric than the graph")
        nodes = self.nodes.select("shard", "id", "vector", "level", "links")
        masked = where is not None or self.deleted is not None
        told, marks = F.lit(True), None
        if where is not None:
            told = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
        if payload is None:
            nodes = nodes.withColumn("ok", told)
        else:  # ids go to the shards with what is told of them; the nodes only meet an empty table, for those without a payload
            marks = payload.where(F.col("id").isNotNull()).withColumn("ok", told).select(F.col("id").cast("long"), "ok")
            alone = nodes.select(F.col("id"), F.struct("shard", "vector", "level", "links").alias("__node")).join(payload.where(F.lit(False)), "id", "left")
            nodes = alone.withColumn("ok", told).select("__node.shard", "id", "__node.vector", "__node.level", "__node.links", "ok")
        if self.deleted is not None:
            gone = self.deleted.select(F.col("id").cast("long"), F.lit(None).cast("boolean").alias("ok"))
            marks = gone if marks is None else marks.unionByName(gone)
        if codes is not None:
            both = self.nodes.select("id").join(codes.select("id", F.lit(True).alias("__coded")), "id", "full").agg(F.count("*"), F.count("__coded")).first()
            if both[0] != both[1] or both[0] != self.nodes.count():
                raise IncompatibleIndex("the graph and the codes are not of the same rows")
            nodes = nodes.join(codes.select("id", "codes", "scale"), "id")
        nodes = nodes.withColumn("mark", F.lit(False))
        if marks is not None:
            nodes = nodes.unionByName(marks.withColumns({"shard": _shard(F.col("id"), self.config.shards), "mark": F.lit(True)}), allowMissingColumns=True)
        dim, metric, config = self.dim, self.metric, self.config

        def searched(numbers: np.ndarray, q: np.ndarray):
            def run(rows: pa.Table) -> pa.Table:
                marks, rows = rows.filter(rows.column("mark")), rows.filter(pc.invert(rows.column("mark"))).sort_by("id")
                graph, walk, lists = Graph.of(rows, dim, metric, config), None, None
                mask = _marked(graph.ids, rows.column("ok").to_numpy(), marks, config.shards) if masked else None
                if scorer is not None:

                    def score(who: np.ndarray, at: np.ndarray) -> np.ndarray:
                        out = np.empty(len(at))
                        for i in np.unique(who):
                            out[who == i] = scorer(q[i], graph.ids[at[who == i]])
                        return out

                elif codec is not None:
                    packed = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(rows.num_rows, codec.row_bytes)
                    stood = codec.levels[codec.unpack(packed)] * rows.column("scale").to_numpy()[:, None]
                    turned = np.array([codec.prepare(x).rotated for x in q])
                    score = lambda who, at: 1 - np.einsum("ij,ij->i", stood[at], turned[who])
                    product = Products("dot", stood)
                    lists = lambda who, k, at: product.lists(turned[who], k, at)
                else:
                    score, walk = scored(metric, q, graph.vectors), rough(metric, q, graph.vectors)
                    products = Products.of(metric, q, graph.vectors)
                    lists = products and (lambda who, k, at: products.lists(q[who], k, at))
                places, dists, refused = graph.search(q, score, k, ef, mask, walk, lists)
                sizes = [len(x) for x in places]
                told = np.flatnonzero(refused)
                none = pa.nulls(len(told), pa.int64())
                hits = pa.table([np.repeat(numbers, sizes), graph.ids[np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64)], np.concatenate([*dists, np.zeros(0)]), np.zeros(sum(sizes), np.int64)], schema=_FOUND)
                return pa.concat_tables([hits, pa.table([numbers[told], none, none.cast(pa.float64()), refused[told]], schema=_FOUND)])

            return run

        found = None
        for numbers, q in query_lots(queries, dim):
            own = _apart(nodes, config).groupBy("shard").applyInArrow(searched(numbers, q), "query_id long, id long, distance double, refused long")
            found = own if found is None else found.unionByName(own)
        if found is None:
            found = nodes.sparkSession.createDataFrame([], "query_id long, id long, distance double, refused long")
        ranked = top_k(found.where("id is not null"), k)
        if not counters:
            return ranked
        met = found.where("id is null").groupBy("query_id").agg(F.sum("refused").alias("refused"))  # also of shards without results
        return ranked.join(met, "query_id", "left").withColumn("refused", F.coalesce("refused", F.lit(0).cast("long")))

    def insert(self, rows: DataFrame) -> GraphIndex:
        """Links new rows (id, vector) into their shards, in ascending id."""
        if self.read_only:
            raise ReadOnly("a compact graph can't grow")
        old = self.nodes.select("shard", "id", "vector", "level", "links", "dists", F.lit(False).alias("new"))
        new = rows.select(_shard(F.col("id"), self.config.shards).alias("shard"), F.col("id").cast("long"), F.col("vector").cast("array<double>"), F.lit(True).alias("new"))
        dim, metric, config = self.dim, self.metric, self.config

        def run(group: pa.Table) -> pa.Table:
            old, added = group.filter(pc.invert(group.column("new"))), group.filter(group.column("new")).sort_by("id")
            graph = Graph.of(old, dim, metric, config) if old.num_rows else Graph(dim, metric, config)
            if added.num_rows:
                graph.add(added.column("id").to_numpy(), matrix(added.column("vector"), dim))
            return graph.table(group.column("shard")[0].as_py())

        both = old.unionByName(new, allowMissingColumns=True)
        return replace(self, nodes=_apart(both, config).groupBy("shard").applyInArrow(run, NODES))

    def remove(self, ids: DataFrame) -> GraphIndex:
        gone = ids.select(F.col("id").cast("long")).distinct()
        return replace(self, deleted=gone if self.deleted is None else self.deleted.union(gone).distinct())

    def restore(self, ids: DataFrame) -> GraphIndex:
        return self if self.deleted is None else replace(self, deleted=self.deleted.join(ids.select("id"), "id", "left_anti"))

    def compact(self) -> GraphIndex:
        """Without distances of links, and read-only."""
        return replace(self, nodes=self.nodes.drop("dists"), read_only=True)

    def edges(self) -> DataFrame:
        """(shard, node, layer, nbr, dist)."""
        each = self.nodes.select("shard", F.col("id").alias("node"), F.posexplode("links").alias("layer", "nbrs"), *(["dists"] if "dists" in self.nodes.columns else []))
        if "dists" not in self.nodes.columns:
            return each.select("shard", "node", "layer", F.explode("nbrs").alias("nbr"))
        pair = each.select("shard", "node", "layer", F.explode(F.arrays_zip(F.col("nbrs").alias("nbr"), F.get("dists", "layer").alias("dist"))).alias("x"))
        return pair.select("shard", "node", "layer", "x.nbr", "x.dist")

    def stats(self) -> DataFrame:
        """(layer, nodes, edges): edges are directed."""
        layers = self.nodes.select("id", F.posexplode("links").alias("layer", "nbrs"))
        return layers.groupBy("layer").agg(F.count("*").alias("nodes"), F.sum(F.size("nbrs")).cast("long").alias("edges"))

    def introspect(self) -> DataFrame:
        """One row: n, deleted, live, dim, metric, max_level, config (JSON)."""
        spark = self.nodes.sparkSession
        gone = (spark.createDataFrame([], "id long") if self.deleted is None else self.deleted).agg(F.count("*").alias("deleted"))
        told = self.nodes.agg(F.count("*").alias("n"), F.max("level").alias("max_level")).join(F.broadcast(gone))
        return told.select("n", "deleted", (F.col("n") - F.col("deleted")).alias("live"), F.lit(self.dim).alias("dim"), F.lit(self.metric.name).alias("metric"), "max_level", F.lit(self.config.to_json()).alias("config"))

    def integrity(self) -> DataFrame:
        """One row of counts that are all 0 in a sound index."""
        names = ("too_many_links", "double_links", "above_level", "loops", "wrong_levels")
        config = self.config

        def run(rows: pa.Table) -> pa.Table:
            """A row of the counts of a shard, and a row for each link to a node that isn't in it."""
            counts, far = _sound(rows.sort_by("id").combine_chunks(), config)
            n = far.num_rows
            return pa.table({"nbr": pa.concat_arrays([pa.nulls(1, pa.int64()), *far.column("nbr").chunks]), "layer": pa.concat_arrays([pa.nulls(1, pa.int32()), *far.column("layer").chunks]), **{k: np.append(counts[k], np.zeros(n, np.int64)) for k in names}})

        told = self.nodes.select("shard", "id", "level", "links").groupBy("shard").applyInArrow(run, "nbr long, layer int, " + ", ".join(f"{k} long" for k in names))
        n = self.nodes.select(F.col("id").alias("nbr"), F.col("level").alias("nbr_level"))
        far = told.where("layer is not null").join(n, "nbr", "left")
        beyond = far.agg(F.count_if(F.col("nbr_level").isNull()).alias("unknown_neighbours"), F.count_if(F.col("nbr_level").isNotNull()).alias("across_shards"), F.count_if(F.col("layer") > F.col("nbr_level")).alias("above"))
        twice = self.nodes.groupBy("id").count().agg(F.count_if(F.col("count") > 1).alias("twice"))
        within = told.agg(*[F.coalesce(F.sum(k), F.lit(0)).cast("long").alias(k) for k in names])
        unequal = F.lit(0)
        if "dists" in self.nodes.columns:
            length = lambda x: F.coalesce(F.size(x), F.lit(0))
            unequal = F.aggregate(F.zip_with("links", "dists", lambda a, b: F.abs(length(a) - length(b))), F.lit(0), lambda a, b: a + b)
        spare = self.nodes.agg(F.coalesce(F.sum(unequal), F.lit(0)).cast("long").alias("spare"))  # distances without links, or links without
        row = within.join(F.broadcast(beyond)).join(F.broadcast(twice)).join(F.broadcast(spare))
        return row.select((F.col("unknown_neighbours") + F.col("spare")).alias("unknown_neighbours"), (F.col("above_level") + F.col("above")).alias("above_level"), (F.col("across_shards") + F.col("twice")).alias("across_shards"), "loops", "too_many_links", "double_links", "wrong_levels")


def _sound(rows: pa.Table, config: IndexConfig) -> tuple[dict[str, int], pa.Table]:
    """Counts of what is wrong among the nodes (id, level, links) of a shard in ascending id, and links (nbr, layer) to others."""
    ids = rows.column("id").to_numpy()
    levels = rows.column("level").fill_null(-1).to_numpy()
    table = pa.table({"node": np.arange(len(ids)), "lists": rows.column("links")})
    lists = pa.table({"node": pc.take(table["node"], pc.list_parent_indices(table["lists"])), "list": pc.list_flatten(table["lists"])})
    sizes = pc.fill_null(pc.list_value_length(table["lists"]), -1).to_numpy()
    wrong = int(((sizes != levels + 1) | (levels < 0) | (levels > MOST_LEVEL)).sum())
    owner = lists["node"].to_numpy()
    layer = np.arange(len(owner)) - np.searchsorted(owner, owner)
    at = pc.list_parent_indices(lists["list"]).to_numpy()
    nbr = pc.list_flatten(lists["list"])
    unknown, nbr = pc.is_null(nbr).to_numpy(), nbr.fill_null(0).to_numpy()
    place = np.minimum(np.searchsorted(ids, nbr), max(len(ids) - 1, 0))
    here = (ids[place] == nbr) & ~unknown
    degree = np.bincount(at, minlength=len(owner))
    order = np.lexsort((nbr, at))
    same = (at[order][1:] == at[order][:-1]) & (nbr[order][1:] == nbr[order][:-1])
    counts = {
        "too_many_links": int((degree > np.where(layer == 0, config.m0, config.m)).sum()),
        "double_links": len(np.unique(at[order][1:][same])),
        "above_level": int((layer[at] > levels[place])[here].sum()),
        "loops": int(((ids[owner[at]] == nbr) & ~unknown).sum()),
        "wrong_levels": wrong,
    }
    return counts, pa.table({"nbr": pa.array(nbr[~here], mask=unknown[~here]), "layer": pa.array(layer[at][~here].astype(np.int32))})


def _shard(id: Column, shards: int) -> Column:
    return F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(shards)).cast("int")


def _marked(ids: np.ndarray, ok: np.ndarray, marks: pa.Table, shards: int | None) -> np.ndarray:
    """ok of ascending ids as marks (id, ok) have it where there are some; null is for removed rows, whatever else is marked."""
    if not marks.num_rows or not len(ids):
        return ok
    if any(zlib.crc32(b"%d" % i) % shards != zlib.crc32(b"%d" % ids[0]) % shards for i in ids.tolist()):
        raise IncompatibleIndex("a node is in another shard than its id tells")
    ok, at = ok.copy(), np.searchsorted(ids, marks.column("id").to_numpy())
    here = ids[np.minimum(at, len(ids) - 1)] == marks.column("id").to_numpy()
    let = pc.cast(marks.column("ok"), pa.int8()).fill_null(-1).to_numpy()
    ok[at[here]] = False
    ok[at[here & (let == 1)]] = True
    ok[at[here & (let == -1)]] = False
    return ok


def _apart(rows: DataFrame, config: IndexConfig) -> DataFrame:
    """rows with each shard in a task of its own, which a hash of few shards wouldn't give, nor ranges without reading all twice."""
    return rows.repartitionById(config.shards or 1, "shard")


def build(table: VectorTable, config: IndexConfig = IndexConfig()) -> GraphIndex:
    """The graphs of a table's rows, dealt out by a hash of the id to config.shards, or if that is None to one for every
    SHARD_ROWS rows. Removed rows stay removed."""
    if table.dim < 1 and not table.is_empty():
        raise InvalidConfig("vectors need a dimension")
    if config.shards is None:
        config = replace(config, shards=max(1, -(-table.rows.count() // SHARD_ROWS)))
    rows = table.rows.select(_shard(F.col("id"), config.shards).alias("shard"), "id", F.col("vector").cast("array<double>").alias("vector"))
    dim, metric = table.dim, table.metric

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        graph = Graph(dim, metric, config)
        graph.add(group.column("id").to_numpy(), matrix(group.column("vector"), dim))
        return graph.table(group.column("shard")[0].as_py())

    return GraphIndex(_apart(rows, config).groupBy("shard").applyInArrow(run, NODES), table.dim, table.metric, config, False, table.deleted)
