"""I-Match fingerprints over randomised lexicon subsets. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: A term counts if the share of documents that have it is in this band. The lower end bounds the lexicon: documents of t
#: terms on average have at most t / LEAST_SHARE such terms, however many documents there are.
LEAST_SHARE, MOST_SHARE = 1 / 1000, 1 / 10
#: Random families of nested subsets; the subset of level s has one in 2^s terms.
FAMILIES, LEVELS = 16, 12
#: A lexicon of more terms, at some 100 bytes each, is joined by a shuffle instead of a broadcast.
BROADCAST_TERMS = 500_000
#: Rows of a bucket, about; buckets are made from so many quantiles of the ids; an id with a larger share of rows has buckets of its own.
BUCKET, QUANTILES, HOT_SHARE = 512, 64, 1 / 100
_SUB_BITS, _GROUP_BITS = 32, 9


def terms(text: Column) -> Column:
    """The distinct terms of a text: runs of letters and digits, in lower case."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))


def lexicon(texts: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """(term, h, levels, has) of the terms of texts (text) within the band of document frequencies, counted over all rows.

    Terms in one document only are left out. levels holds, four bits a family, how many of its subsets have the term; has
    holds four longs with 16 bits a family, of which the bit of the sparsest such subset is set.
    """
    counts = texts.select(F.explode(terms(F.col("text"))).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    n = texts.count()
    kept = counts.where((F.col("df") >= max(2, least * n)) & (F.col("df") <= max(2, most * n)))
    low = (1 << LEVELS) - 1
    level, has = F.lit(0).cast("long"), [F.lit(0).cast("long")] * (FAMILIES // 4)
    for j in range(FAMILIES):
        r = F.xxhash64("term", F.lit(j))
        zeros = F.bit_count((r.bitwiseAND(F.lit(low)) - 1).bitwiseAND(F.bitwise_not(r)).bitwiseAND(F.lit(low)))  # trailing zeros
        level = level.bitwiseOR(F.shiftleft(zeros.cast("long"), 4 * j))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), (zeros - 1 + 16 * (j % 4)).cast("int"))
        has[j // 4] = has[j // 4].bitwiseOR(F.when(zeros > 0, one).otherwise(F.lit(0).cast("long")))
    return kept.select("term", F.xxhash64("term").alias("h"), level.alias("levels"), *[x.alias(f"has{i}") for i, x in enumerate(has)])


def sparsest(has: list[Column]) -> Column:
    """The level, four bits a family, of the sparsest subset that any of the terms has whose bits are joined in has."""
    out = F.lit(0).cast("long")
    for j in range(FAMILIES):
        lane = F.shiftrightunsigned(has[j // 4], 16 * (j % 4)).bitwiseAND(F.lit(0xFFFF))
        top = F.when(lane > 0, F.floor(F.log2(lane.cast("double") + 0.5)) + 1).otherwise(F.lit(0).cast("long"))  # one half, as log2 may be a little low
        out = out.bitwiseOR(F.shiftleft(top.cast("long"), 4 * j))
    return out


def subset_hashes(terms_in: Column, top: Column) -> Column:
    """For sorted structs (h, levels), and their sparsest levels, a long a family: the level, four bits, and 60 of the hash
    of the terms in that subset; 0 for families without a subset that has any."""
    lanes = F.lit(0x1111111111111111)

    def tops(x: Column) -> Column:  # whether a family's four bits equal the top's
        d = x["levels"].bitwiseXOR(top)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        return d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(lanes) != lanes

    few = F.filter(terms_in, tops)

    def family(few: Column):
        def of(j: Column) -> Column:
            four = lambda x: F.call_function("shiftrightunsigned", x, 4 * j).bitwiseAND(F.lit(15))
            some = F.transform(F.filter(few, lambda t: four(t["levels"]) == four(top)), lambda t: t["h"])
            return F.when(four(top) > 0, F.shiftleft(four(top), 60).bitwiseOR(F.xxhash64(some).bitwiseAND(F.lit((1 << 60) - 1)))).otherwise(F.lit(0).cast("long"))

        return of

    return F.get(F.transform(F.array(few), lambda few: F.transform(F.sequence(F.lit(0), F.lit(FAMILIES - 1)), family(few))), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """The share of families whose sparsest subset that either text meets has equal hashes; families that neither meets don't count."""
    met = F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: (p["x"] != 0) | (p["y"] != 0))
    same = lambda p: F.size(F.filter(p, lambda q: q["x"] == q["y"])).cast("double") / F.size(p)
    return F.get(F.transform(F.array(met), lambda p: F.when(F.size(p) > 0, same(p)).otherwise(0.0)), F.lit(0))


def render(hashes: Column) -> Column:
    """16 hexadecimal digits a hash, the first of which is its level."""
    return F.lower(F.array_join(F.transform(hashes, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def _buckets(docs: DataFrame) -> Column:
    """The bucket of a row by ascending doc_id, nulls first, then by th, a hash; some BUCKET rows each whatever the ids.

    Ids between two neighbours of QUANTILES are dealt evenly by their value; rows of an id, or of none, that has a
    HOT_SHARE of all, by th. What the driver gets is those quantiles and at most 1 / HOT_SHARE ids.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    n = ids.count()
    hot = {r["id"]: r["n"] for r in ids.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > max(2 * BUCKET, HOT_SHARE * n)).collect()}
    marks = sorted(set(ids.where("id is not null").approxQuantile("id", [i / QUANTILES for i in range(QUANTILES + 1)], 1 / (4 * QUANTILES))))
    per = max(1, -(-n // (QUANTILES * BUCKET)))
    value = F.col("doc_id").cast("long").cast("double")
    place = F.lit(0).cast("long")
    for i, (low, high) in enumerate(zip(marks, marks[1:])):
        inside = F.least(F.lit(per - 1), F.greatest(F.lit(0), F.floor((value - low) / ((high - low) / per)))).cast("long")
        place = F.when(value >= low, inside + F.lit(1 + i * per)).otherwise(place)
    if marks:
        place = F.when(value >= marks[-1], F.lit(1 + len(marks) * per).cast("long")).otherwise(place)
    even = lambda k: F.floor((F.col("th").cast("double") / 2.0**64 + 0.5) * -(-k // BUCKET)).cast("long")
    sub = F.lit(0).cast("long")
    for id, k in hot.items():
        if id is not None:  # larger ids come behind all buckets of this one
            own = F.col("doc_id").cast("long")
            sub = sub + F.when(own == id, 1 + even(k)).when(own > id, F.lit(2 - -k // BUCKET).cast("long")).otherwise(F.lit(0).cast("long"))
    place, sub = F.when(F.col("doc_id").isNull(), F.lit(-1).cast("long")).otherwise(place), F.when(F.col("doc_id").isNull(), even(hot.get(None, 1))).otherwise(sub)
    return F.shiftleft(place, _SUB_BITS) + sub


def following(keys: DataFrame, bits: int = _SUB_BITS + _GROUP_BITS, levels: int = 2) -> DataFrame:
    """(k, nxt): for each distinct long k the next larger one, null for the largest.

    Keys are sorted within groups that share all but so many bits; groups go by the next ones, so that what one task
    sorts at last is a small part of the keys.
    """
    if not levels:
        return keys.select("k", F.lead("k").over(Window.orderBy("k")).alias("nxt"))
    g = F.shiftright("k", bits)
    inner = keys.select("k", g.alias("g")).withColumn("in_g", F.lead("k").over(Window.partitionBy("g").orderBy("k")))
    firsts = keys.groupBy(g.alias("g")).agg(F.min("k").alias("first"))
    after = following(firsts.select(F.col("g").alias("k")), _GROUP_BITS, levels - 1)
    to = after.join(firsts, after["nxt"] == firsts["g"]).select(F.col("k").alias("g"), F.col("first").alias("after"))
    return inner.join(to, "g", "left").select("k", F.coalesce("in_g", "after").alias("nxt"))


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, rn, doc_id, text, nxt, last): each text with the next row's, by ascending doc_id; after the last the first.

    Null ids come first, rows of an id go by XXH64 of their texts, null texts are empty. Rows are sorted within buckets;
    only the first text of a bucket goes to another one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    rows = rows.withColumn("bucket", _buckets(docs))
    w = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "th")
    rows = rows.select("bucket", F.row_number().over(w).alias("rn"), "doc_id", "text", F.lead("text").over(w).alias("follow"))
    firsts = cut(rows.where("rn = 1").select(F.col("bucket").alias("k"), F.col("text").alias("first")), "firsts")
    after = following(firsts.select("k"))
    least = firsts.agg(F.min("k").alias("k")).first()["k"]
    to = after.select(F.col("k").alias("bucket"), F.coalesce("nxt", F.lit(least).cast("long")).alias("k")).join(firsts, "k").select("bucket", "first")
    return rows.join(to, "bucket").select("bucket", "rn", "doc_id", "text", F.coalesce("follow", "first").alias("nxt"), F.col("follow").isNull().alias("last"))


def compare(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs (doc_id, text, ...).

    A fingerprint has, for each of FAMILIES families of nested random subsets of the lexicon, the level and the hash of the
    sparsest subset that the text meets: of its sorted distinct terms in it. A text without lexicon terms has one of all
    its terms, and one without any term one of itself, in every place; so equal texts have equal fingerprints. The edited
    text has its last half replaced by the beginning of the next one's. Rows are kept, repeats and null ids included; other
    columns of docs are ignored; no rows give no rows.
    """
    rows = with_next(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("nxt"), F.lit(1), half)))
    words = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = cut(lexicon(words), "lexicon")

    def side(which: int, text: str) -> Column:
        return F.struct(F.lit(which).alias("which"), F.concat(terms(F.col(text)), F.array(F.lit(None).cast("string"))).alias("terms"), F.xxhash64(F.array_sort(terms(F.col(text))), F.when(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "") == "", F.col(text))).alias("all"))

    none = F.lit(None).cast("struct<which:int,terms:array<string>,all:long>")
    sides = rows.select("bucket", "rn", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), F.explode(F.array_compact(F.array(side(0, "text"), side(1, "edited"), F.when(F.col("last"), side(2, "nxt")).otherwise(none)))).alias("x"))
    each = sides.select("bucket", "rn", "doc_id", "n_chars", "sha", "x.which", "x.all", F.explode("x.terms").alias("term"))
    found = each.join(F.broadcast(known) if known.count() <= BROADCAST_TERMS else known, "term", "left").where("h is not null or term is null")
    own = lambda k, x: F.when((F.col("which") == k) & F.col("h").isNotNull(), x)
    in_set = [F.array_sort(F.collect_list(own(k, F.struct("h", "levels")))).alias(f"t{k}") for k in range(3)]
    bits = [F.coalesce(F.bit_or(own(k, F.col(f"has{i}"))), F.lit(0).cast("long")).alias(f"b{k}_{i}") for k in range(3) for i in range(FAMILIES // 4)]
    whole = [F.max(F.when(F.col("which") == k, F.col("all"))).alias(f"a{k}") for k in range(3)]
    prints = found.groupBy("bucket", "rn").agg(F.max("doc_id").alias("doc_id"), F.max("n_chars").alias("n_chars"), F.max("sha").alias("edited_sha256"), *in_set, *bits, *whole)
    prints = prints.withColumns({f"top{k}": sparsest([F.col(f"b{k}_{i}") for i in range(FAMILIES // 4)]) for k in range(3)})
    plain = lambda k: F.array_repeat(F.greatest(F.lit(1).cast("long"), F.col(f"a{k}").bitwiseAND(F.lit((1 << 60) - 1))), FAMILIES)
    prints = prints.withColumns({f"t{k}": F.when(F.col(f"a{k}").isNotNull(), F.when(F.col(f"top{k}") == 0, plain(k)).otherwise(subset_hashes(F.col(f"t{k}"), F.col(f"top{k}")))) for k in range(3)})
    w = Window.partitionBy("bucket").orderBy("rn")
    prints = prints.withColumn("t2", F.coalesce(F.lead("t0").over(w), F.col("t2")))
    return prints.select("doc_id", "n_chars", "edited_sha256", render(F.col("t0")).alias("fingerprint"), render(F.col("t1")).alias("edited_fingerprint"), likeness(F.col("t0"), F.col("t1")).alias("near_edited"), likeness(F.col("t0"), F.col("t2")).alias("near_next"))
