"""Suffix arrays by induced sorting, with doubling for large alphabets, and common prefixes in text order."""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced bucket by bucket; suffixes of larger ones are ordered by doubling.
ARRAY_ALPHABET = 1024


def _types(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one; the last, a unique least symbol, counts as smaller."""
    n = len(t)
    known = np.ones(n, dtype=np.int8)
    known[:-1] = np.where(t[:-1] < t[1:], 1, np.where(t[:-1] > t[1:], 0, -1))
    at = np.where(known >= 0, np.arange(n, dtype=np.int32), np.int32(n))
    return known[np.minimum.accumulate(at[::-1])[::-1]] == 1


def _by_symbol(at: np.ndarray, symbols: np.ndarray, into: list[list[np.ndarray]]) -> None:
    if not len(at):
        return
    order = np.argsort(symbols, kind="stable")
    at, symbols = at[order], symbols[order]
    ends = (np.flatnonzero(symbols[1:] != symbols[:-1]) + 1).tolist()
    start = 0
    for c, end in zip(symbols[[0, *ends]].tolist(), [*ends, len(at)]):
        into[c].append(at[start:end])
        start = end


def _induce(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """The suffix array that the sorted leftmost-smaller suffixes (seeds) induce: larger suffixes upwards, then smaller ones downwards.

    Within a bucket whole arrays move at once: those whose predecessor has the same symbol make the next array.
    """
    none = np.zeros(0, dtype=np.int32)
    symbol = t.astype(np.uint16)
    # Of the suffix before each: its symbol, and whether it is a larger or a smaller one; none is before the first.
    prior = np.append(symbol[:1], symbol[:-1])
    to_larger, to_smaller = np.append(False, ~small[:-1]), np.append(False, small[:-1])

    def bucket(c: int, wait: list[list[np.ndarray]], goes: np.ndarray) -> list[np.ndarray]:
        got, now = [], np.concatenate(wait[c]) if wait[c] else none
        while len(now):
            got.append(now)
            p = now[goes[now]]
            s = prior[p]
            p -= 1
            same = s == c
            if same.any():
                _by_symbol(p[~same], s[~same], wait)
                now = p[same]
            else:
                _by_symbol(p, s, wait)
                break
        return got

    start: list[list[np.ndarray]] = [[] for _ in range(k)]
    _by_symbol(seeds.astype(np.int32), symbol[seeds], start)
    wait: list[list[np.ndarray]] = [[] for _ in range(k)]
    larger: list[np.ndarray] = []
    for c in range(k):
        got = bucket(c, wait, to_larger)
        larger.append(np.concatenate(got) if got else none)
        if start[c]:
            p = np.concatenate(start[c])
            p = p[p > 0]
            _by_symbol(p - 1, prior[p], wait)
    wait = [[] for _ in range(k)]
    out: list[np.ndarray] = []
    for c in range(k - 1, -1, -1):
        got = bucket(c, wait, to_smaller)
        if c == 0:
            got = [np.array([len(t) - 1], dtype=np.int32)]
        p = larger[c][::-1]
        p = p[to_smaller[p]]
        _by_symbol(p - 1, prior[p], wait)
        if got:
            out.append(np.concatenate(got)[::-1])
        out.append(larger[c])
    return np.concatenate(out[::-1])


def _packed(t: np.ndarray, at: np.ndarray, count: int, bits: int, ends: np.ndarray) -> np.ndarray:
    """The symbols of t at each place and behind it as one number, zero from the ends on."""
    out = np.zeros(len(at), dtype=np.int64)
    for o in range(count):
        i = at + o
        out <<= bits
        out |= np.where(i < ends, t[np.minimum(i, len(t) - 1)], 0)
    return out


def _settle(order: np.ndarray, rank: np.ndarray, live: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Orders what is at the live places by the keys, and returns the places of those that still share a rank.

    A rank is the first place of those that share it; keys of what shares none so far go by rank.
    """
    by = np.argsort(key)
    key, own = key[by], order[live[by]]
    order[live] = own
    new = np.append(True, key[1:] != key[:-1])
    rank[own] = live[new][np.cumsum(new) - 1]
    return live[~(new & np.append(new[1:], True))]


def _sorted_substrings(t: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the leftmost-smaller substrings, as numbers in text order, and their ranks; equal ones share a rank.

    A symbol with its type is more than the same of a larger suffix. So no substring begins another, as its end, known by
    two types, would be that of the other too.
    """
    m = len(lms)
    typed = t.astype(np.int64) * 2 + small
    bits = (2 * k - 1).bit_length()
    count = 63 // bits
    ends = np.append(lms[1:], len(t) - 1) + 1
    order, rank, live, at = np.arange(m), np.zeros(m, dtype=np.int64), np.arange(m), lms.astype(np.int64)
    live = _settle(order, rank, live, _packed(typed, at, count, bits, ends))
    o = count
    while True:
        own = order[live]
        more = at[own] + o < ends[own]  # all that share a rank, or none
        live, own = live[more], own[more]
        if not len(live):
            return order, rank
        word = np.unique(_packed(typed, at[own] + o, count, bits, ends[own]), return_inverse=True)[1]
        live = _settle(order, rank, live, rank[own] * len(live) + word)
        o += count


def _by_doubling(t: np.ndarray, k: int) -> np.ndarray:
    """suffix_array() by ranks of prefixes of twice the length each time, of suffixes that are not alone in theirs."""
    n = len(t)
    bits = max(1, (k - 1).bit_length())
    length = 63 // bits
    order, rank = np.arange(n), np.zeros(n, dtype=np.int64)
    live = _settle(order, rank, np.arange(n), _packed(t, np.arange(n), length, bits, np.int64(n)))
    while len(live):
        own = order[live]  # neither reaches the last symbol, which is the only one of its kind
        live = _settle(order, rank, live, rank[own] * n + rank[own + length])
        length *= 2
    return order


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """The suffixes of t in order, by induced sorting; symbols are 0 to k - 1, the last one is 0 and no other is.

    Leftmost-smaller substrings are sorted by words of several symbols. Their suffixes, having a large alphabet, are
    ordered by doubling.
    """
    n = len(t)
    if k > ARRAY_ALPHABET or n < 2:
        return _by_doubling(t, k)
    small = _types(t)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    order, rank = _sorted_substrings(t, small, lms, k)
    if len(np.unique(rank)) < len(lms):
        order = _by_doubling(rank, len(lms))
    return _induce(t, small, lms[order], k)


def common_prefixes(data: bytes, sa: np.ndarray, ok: np.ndarray, most: int) -> np.ndarray:
    """In text order, the bytes that the suffix at each place has in common with the one before it in the array.

    Only pairs of places that are both ok count, others have 0; places that are ok must have most bytes; longer common
    prefixes count as most.
    """
    before = np.full(len(ok), -1, dtype=np.int64)
    inside = sa < len(ok)
    before[sa[1:][inside[1:]]] = np.where(inside[:-1], sa[:-1], -1)[inside[1:]]
    i = np.flatnonzero(ok & (before >= 0))
    i = i[ok[before[i]]]
    j = before[i]
    out = np.zeros(len(ok), dtype=np.int64)
    raw = np.frombuffer(data + bytes(8), dtype=np.uint8)
    words = np.lib.stride_tricks.as_strided(raw, (len(data) + 1, 8), (1, 1)).copy().view("<u8").ravel()
    live = np.arange(len(i))
    for o in range(0, most - 7, 8):
        equal = words[i[live] + o] == words[j[live] + o]
        live = live[equal]
        out[i[live]] += 8
    for o in range(most - most % 8, most):
        live = live[out[i[live]] == o]
        equal = raw[i[live] + o] == raw[j[live] + o]
        live = live[equal]
        out[i[live]] += 1
    return out
