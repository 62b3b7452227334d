"""Language mixtures of documents: expectation-maximisation over letter n-gram models, the set chosen by penalised likelihood."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_arrow, parts, quoted, release

#: Symbols of six bits, so that a model of trigrams has 2^18 entries for each language, whatever the corpus.
SYMBOL_BITS, GRAMS = 6, 1 << 18
#: Texts are taken in pieces of so many bytes at most, which bounds memory; every piece counts.
PIECE_BYTES = 1 << 20
#: Bytes of texts, and a text at least, that are fitted together; their trigrams take some fifty times that.
TOGETHER = 1 << 18
#: Languages that a model has at most: each takes a megabyte in the driver and in every worker.
MOST_LANGUAGES = 256
#: Log likelihood that further steps of expectation-maximisation might add. A text that no set of languages can explain better
#: than its best language alone, even with so much more, isn't fitted again.
STEPS_LEFT = 2.0
#: Overlapping trigrams count as this many independent ones each.
INDEPENDENT = 1 / 3


def _symbols() -> np.ndarray:
    """Byte to symbol: 0 for what isn't a letter, 1-26 for a-z in either case, 27-63 for bytes of other letters."""
    code = np.zeros(256, dtype=np.uint32)
    for i in range(26):
        code[97 + i] = code[65 + i] = 1 + i
    code[128:] = 27 + np.arange(128) % 37
    return code


_CODE = _symbols()


def _squeezed(s: np.ndarray) -> np.ndarray:
    """Symbols without those non-letters that follow one."""
    return s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])] if len(s) > 1 else s


def _trigrams(s: np.ndarray) -> np.ndarray:
    if len(s) < 3:
        return np.zeros(0, dtype=np.uint32)
    g = (s[:-2] << np.uint32(12)) | (s[1:-1] << np.uint32(6)) | s[2:]
    return g[g != 0]


def gram_ids(text: bytes) -> np.ndarray:
    """The trigrams of a text, framed by non-letters, as numbers below GRAMS; those without a letter are left out."""
    return _trigrams(_squeezed(_CODE[np.frombuffer(b" " + text + b" ", dtype=np.uint8)]))


def gram_pieces(text: bytes) -> Iterator[np.ndarray]:
    """gram_ids() of a long text in pieces: the last two symbols of one go before the next, and only the ends are framed."""
    tail = np.zeros(1, dtype=np.uint32)
    for i in range(0, max(len(text), 1), PIECE_BYTES):
        own = _CODE[np.frombuffer(text[i : i + PIECE_BYTES], dtype=np.uint8)]
        end = np.zeros(1 if i + PIECE_BYTES >= len(text) else 0, dtype=np.uint32)
        s = _squeezed(np.concatenate([tail, own, end]))
        yield _trigrams(s)
        tail = s[-2:]


def gram_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The different trigrams of a text, ascending, and how often it has each."""
    if len(text) <= PIECE_BYTES:
        return np.unique(gram_ids(text), return_counts=True)
    own = np.zeros(GRAMS, dtype=np.int64)
    for grams in gram_pieces(text):
        ids, n = np.unique(grams, return_counts=True)
        own[ids] += n
    return np.flatnonzero(own), own[own > 0]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_likelihood: np.ndarray  # languages x GRAMS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for b in (part for whole in batches for part in parts(whole, 1)):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            own = counts.setdefault(lang, np.zeros(GRAMS, dtype=np.int64))
            ids, n = gram_counts(text.as_py())
            own[ids] += n
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "gram", "n"])


def learn(labelled: DataFrame, smoothing: float = 0.5) -> Model:
    """Trigram models of all rows (lang, text) that have both. What reaches the driver is at most GRAMS counts a language.

    No labelled row gives a model without languages; more than MOST_LANGUAGES are an error.
    """
    labels = labelled.where("lang is not null and text is not null").select(F.col("lang").cast("string")).distinct()
    if len(labels.limit(MOST_LANGUAGES + 1).collect()) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows = labelled.where("lang is not null and text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string").cast("binary").alias("t"))
    sums = rows.mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(sums.column("lang").to_pylist()))
    counts = np.full((len(langs), GRAMS), smoothing)
    if langs:
        place = {x: i for i, x in enumerate(langs)}
        counts[np.array([place[x] for x in sums.column("lang").to_pylist()]), sums.column("gram").to_numpy()] += sums.column("n").to_numpy()
    return Model(tuple(langs), np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32) if langs else np.zeros((0, GRAMS), np.float32))


def _penalty(size: int, total: np.ndarray) -> np.ndarray:
    """What a set of so many languages costs a text of so many independent trigrams."""
    return 0.5 * (size - 1) * np.log(np.maximum(total, 2.0)) + 2.0 * (size - 1)


def _mixtures(doc: np.ndarray, gram: np.ndarray, n: np.ndarray, docs: int, loglik: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The language proportions of each document (documents x languages, zero outside the chosen set) and a confidence.

    doc, gram, n: trigram counts by document, ascending. For each set size the likeliest languages of the full mixture
    are fitted anew, unless the full one shows that no mixture can beat one language; half the logarithm of the count for
    each proportion decides between the sizes.
    """
    langs = loglik.shape[0]
    ll = loglik.T[gram].astype(np.float64)  # entries x languages
    top = ll.max(axis=1, keepdims=True)
    like, w = np.exp(ll - top), n * INDEPENDENT
    starts = np.searchsorted(doc, np.arange(docs))
    some = np.bincount(doc, minlength=docs) > 0
    total = np.bincount(doc, weights=w, minlength=docs)

    def by_doc(x: np.ndarray) -> np.ndarray:
        out = np.zeros((docs, *x.shape[1:]))
        out[some] = np.add.reduceat(x, starts[some], axis=0) if some.any() else 0
        return out

    shift = by_doc(w * top[:, 0])
    single = by_doc(w[:, None] * ll)
    order = np.argsort(-single, axis=1, kind="stable")
    rows = np.arange(docs)
    best = single[rows, order[:, 0]]
    pick = np.zeros((docs, langs))
    pick[rows, order[:, 0]] = 1.0
    gain = best - 0.0
    if langs > 1:
        pi = np.full((docs, langs), 1.0 / langs)
        ahead = np.ones(docs, dtype=bool)
        for size in range(langs, 1, -1):
            # the mixture is narrowed from all languages, smallest proportion first; only texts that mix are fitted on
            live = ahead[doc]
            d, p, ww = doc[live], like[live], w[live]
            if not len(d):
                break
            first = np.concatenate([[0], np.flatnonzero(np.diff(d)) + 1])
            own = d[first]
            here = np.repeat(np.arange(len(own)), np.diff(np.append(first, len(d))))
            q = pi[own]
            for _ in range(steps):
                r = q[here] * p
                s = r.sum(axis=1)
                q = np.add.reduceat(r * (ww / np.maximum(s, 1e-300))[:, None], first, axis=0)
                q /= np.maximum(q.sum(axis=1, keepdims=True), 1e-300)
            value = np.add.reduceat(ww * np.log(np.maximum((q[here] * p).sum(axis=1), 1e-300)), first) + shift[own]
            most = value  # no smaller set has a larger likelihood than all, but for what further steps would add
            value = value - _penalty(size, total[own])
            better = value > gain[own]
            gain[own[better]] = value[better]
            pick[own[better]] = q[better]
            least = np.argmin(np.where(q > 0, q, np.inf), axis=1)
            q[np.arange(len(own)), least] = 0.0
            pi[own] = q / np.maximum(q.sum(axis=1, keepdims=True), 1e-300)
            if size == langs:
                ahead[own] = most + STEPS_LEFT - _penalty(2, total[own]) > gain[own]
    outside = np.where(pick > 0, -np.inf, single).max(axis=1)
    inside = np.where(pick > 0, single, -np.inf).max(axis=1)
    sure = 1.0 / (1.0 + np.exp(np.clip(outside - inside, -50, 50)))
    return pick, sure


def _predict(languages: tuple[str, ...], table: Broadcast, steps: int, names: list[str], places: list[int | None]):
    """Rows (text, whether it has no language, other columns) to those at the places, None being the text, with what is told.

    table holds the log likelihoods of the languages.
    """

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[str], list[float], list[str]]:
        sizes = [len(g) for g, _ in held]
        doc = np.repeat(np.arange(len(held)), sizes)
        gram, n = (np.concatenate([x[i] for x in held]) if held else np.zeros(0, np.int64) for i in (0, 1))
        pick, sure = _mixtures(doc, gram, n, len(held), table.value, steps)
        at = pick.argmax(axis=1)
        score = np.clip(pick[np.arange(len(held)), at] * sure, 0.0, 1.0)
        told = [",".join(f"{languages[j]}:{p[j]:.3f}" for j in np.argsort(-p, kind="stable") if p[j] > 0) for p in pick]
        return [languages[i] for i in at], score.tolist(), told

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for whole in batches:
            for b in parts(whole, 0, TOGETHER):
                skip = b.column(1).to_pylist()
                lang, score, mix = [None] * b.num_rows, [0.0] * b.num_rows, [""] * b.num_rows
                if languages:
                    lang, score, mix = flush([nothing if s else gram_counts(x.as_buffer().to_pybytes()) for x, s in zip(b.column(0), skip)])
                lang = ["und" if s or x is None else x for x, s in zip(lang, skip)]
                score = [0.0 if x == "und" else s for x, s in zip(lang, score)]
                mix = ["" if x == "und" else m for x, m in zip(lang, mix)]
                kept = [b.column(0 if i is None else i) for i in places]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(mix, pa.string())], names=names)
        release()

    return run


TOLD = ("lang_pred", "score", "mixture")


def identify(docs: DataFrame, model: Model, keep: list[str], steps: int = 12, told: tuple[str, str, str] = TOLD) -> DataFrame:
    """The columns keep of docs (text, ...), then lang_pred, score, mixture ("de:0.700,fr:0.300"), or as told names them.

    lang_pred is the language of largest proportion, or "und" with score 0 if the text is null, has no letter or the
    model has no language. score is that proportion times the confidence in the chosen set. Whole texts count; rows are
    kept, repeats included. Columns of docs that are named like the told ones are replaced.
    """
    taken = {x.lower() for x in told}
    out = [f for f in docs.schema if f.name in keep and f.name.lower() not in taken]
    text = F.col("text").cast("string")
    t, none = free_name(docs, "__t"), free_name(docs, "__none")
    same = lambda f: f.name == "text" and isinstance(f.dataType, T.StringType)  # noqa: E731  sent once
    others = [f.name for f in out if not same(f)]
    rows = docs.select(text.alias(t), (~F.coalesce(text.rlike(r"\p{L}"), F.lit(False))).alias(none), *quoted(others))
    new = [T.StructField(told[0], T.StringType()), T.StructField(told[1], T.DoubleType()), T.StructField(told[2], T.StringType())]
    places = [None if same(f) else 2 + others.index(f.name) for f in out]
    table = docs.sparkSession.sparkContext.broadcast(model.log_likelihood)  # at most MOST_LANGUAGES megabytes
    return map_arrow(rows, _predict(model.languages, table, steps, [f.name for f in out] + list(told), places), T.StructType([*out, *new]))


def held_out(doc_id: Column) -> Column:
    """Whether a document is outside the learning set: crc32 of its id as text, modulo 3, is 1. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))
