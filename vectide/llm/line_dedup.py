"""Repeated lines and sentences: units are normalised and hashed, the first of each is kept, passages of others are cut out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name, map_arrow, parts, quoted, release

#: Units with fewer words are too common to be copies: lines, sentences within lines.
LINE_WORDS, SENTENCE_WORDS = 5, 5
#: Neighbouring repeated units of fewer words together stay: headings, licence lines and phrases that clean texts share.
PASSAGE_WORDS = 15

_LINE, _SENTENCE = re.compile(r"[^\r\n]+"), re.compile(r"(?<=[.!?…])\s+")
_LAST = (1 << 63) - 1


def _units(text: str, line_words: int, sentence_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of the lines of a text, and of the sentences of lines that have several."""
    for m in _LINE.finditer(text):
        line, at = m[0], m.start()
        words = line.lower().split()
        if len(words) < min(line_words, sentence_words):
            continue
        left, right = at + len(line) - len(line.lstrip()), at + len(line.rstrip())
        if len(words) >= line_words:
            yield left, right, xxhash.xxh3_128_digest(" ".join(words))
        s = left
        ends = [(x.start(), x.end()) for x in _SENTENCE.finditer(text, left, right)]
        if not ends:
            continue
        for e, after in [*ends, (right, right)]:
            own = text[s:e].lower().split()
            if len(own) >= sentence_words:
                yield s, e, xxhash.xxh3_128_digest(" ".join(own))
            s = after


def _emit(line_words: int, sentence_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column(0).to_pylist(), b.column(1).to_pylist()
            doc, key, start, end, digests = [], [], [], [], []

            def batch() -> pa.RecordBatch:
                h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                cols = [pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())]
                return pa.RecordBatch.from_arrays(cols, names=["doc", "key", "s", "e", "h1", "h2"])

            for i, k, text in zip(ids, keys, b.column(2)):
                for s, e, d in _units(text.as_py(), line_words, sentence_words):
                    doc.append(i)
                    key.append(k)
                    start.append(s)
                    end.append(e)
                    digests.append(d)
                if len(doc) > 200_000:
                    yield batch()
                    doc, key, start, end, digests = [], [], [], [], []
            if doc:
                yield batch()

    return run


def repeated_spans(docs: DataFrame, line_words: int = LINE_WORDS, sentence_words: int = SENTENCE_WORDS) -> DataFrame:
    """(doc, key, s, e) of every unit of docs (doc_id, text, ...) that occurs earlier; key tells texts of an id apart.

    Units are lines of line_words words or more and sentences of sentence_words or more, compared without case and with
    white space made even, by a 128-bit digest. The earliest is that of the smallest doc_id, then place; rows with a null
    doc_id come last, with doc the largest long. Offsets are code points of the text as it was. The counts come before
    the join, so that a unit that fills the corpus meets one row; rows of the same id and text keep the same units.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), F.xxhash64(text), text.alias("t"))
    units = rows.mapInArrow(_emit(line_words, sentence_words), "doc long, key long, s int, e int, h1 long, h2 long")
    place = F.struct("doc", "key", "s")
    first = units.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    first = cut(first, "units")  # a table of its own, so that the join may split a hot unit's partition
    return units.join(first, ["h1", "h2"]).where(place != F.col("first")).select("doc", "key", "s", "e")


def passages(text: str, units: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Ascending stretches of the repeated units (s, e) of a text, without those that with their neighbours, only white space
    lying between, have fewer words than the least."""
    merged: list[list[int]] = []
    for s, e in sorted(units):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    out: list[tuple[int, int]] = []
    at = 0
    while at < len(merged):
        end = at + 1
        while end < len(merged) and not text[merged[end - 1][1] : merged[end][0]].strip():
            end += 1
        if len(text[merged[at][0] : merged[end - 1][1]].split()) >= least:
            out += [tuple(x) for x in merged[at:end]]
        at = end
    return out


def _cut(place: int, least: int):
    """Cuts rows (the columns of documents, units): at the given place is the text, which goes last but one as it was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        for b in batches:
            for part in parts(b, place):
                texts, gone = part.column(place).to_pylist(), []
                for i, units in enumerate(part.column(part.num_columns - 1)):
                    gone.append([])
                    if units.is_valid:
                        flat, text = units.values, texts[i]
                        found = passages(text, list(zip(flat.field("s").to_pylist(), flat.field("e").to_pylist())), least)
                        ends = [0, *(e for _, e in found)]
                        texts[i] = "".join(text[x:y] for x, y in zip(ends, [*(s for s, _ in found), len(text)]))
                        gone[-1] = [{"s": x, "e": y} for x, y in found]
                cols = part.columns[:-1]
                cols[place] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*cols, part.column(place), pa.array(gone, kind)], names=[*part.schema.names[:-1], "text_before", "removed_spans"])
        release()

    return run


def cut_repeats(docs: DataFrame, line_words: int = LINE_WORDS, sentence_words: int = SENTENCE_WORDS, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """docs with text without its repeated units, text_before, and removed_spans: array of (s, e), merged, in order.

    See repeated_spans() for what repeats. Repeated units stay where they and their repeated neighbours have fewer than
    passage_words words in all. Line breaks stay, as do texts without repeats, null ones included. Rows are kept, as are
    other columns whatever their names; columns text_before and removed_spans of docs are replaced.
    """
    docs = docs.drop("text_before", "removed_spans")
    doc, key, r_doc, r_key, units = (free_name(docs, x) for x in ("__doc", "__key", "__r_doc", "__r_key", "__units"))
    spans = repeated_spans(docs, line_words, sentence_words).groupBy("doc", "key").agg(F.collect_set(F.struct("s", "e")).alias("units"))
    spans = spans.select(F.col("doc").alias(r_doc), F.col("key").alias(r_key), F.col("units").alias(units))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = [F.col("text").cast("string").alias(c) if c == "text" else x for c, x in zip(docs.columns, quoted(docs.columns))]
    keyed = docs.select(*own, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias(doc), F.xxhash64(text).alias(key))
    out = keyed.join(spans, (F.col(doc) == F.col(r_doc)) & (F.col(key) == F.col(r_key)), "left").select(*quoted(docs.columns), units)
    fields = [T.StructField("text", T.StringType()) if f.name == "text" else f for f in docs.schema]
    span = T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])
    schema = T.StructType([*fields, T.StructField("text_before", T.StringType()), T.StructField("removed_spans", T.ArrayType(span))])
    return map_arrow(out, _cut(docs.columns.index("text"), passage_words), schema)
