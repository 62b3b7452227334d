"""Secret spans in texts: fixed patterns, and tokens that pass a battery of randomness tests. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

# The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])"
KINDS = ("assign", "access", "hex", "random")

_SPANS = "array<struct<s:int,k:int,e:int>>"
#: Bins of p-values; every class is judged as if it had so many more candidates, that are like those of all classes.
_BINS, PRIOR = 50, 20


def _scan(rows: Column, step, kind: str) -> Column:
    """The arrays that step(state, row) -> (state, array) gives for each row, joined; the state is an int, 0 at first.

    Rows are taken in stretches of about the root of their number, so that no long array is copied for each row.
    """

    def blocks(rows: Column) -> Column:
        k = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(rows).cast("double"))).cast("int"))
        return F.transform(F.sequence(F.lit(0), k - 1), lambda b: F.slice(rows, b * k + 1, k))

    def one(acc: Column, x: Column) -> Column:
        at, out = step(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], out).alias("out")).cast(f"struct<at:int,out:{kind}>")

    def block(acc: Column, rows: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), F.array().cast(kind).alias("out"))
        return F.aggregate(rows, start, one, lambda got: F.struct(got["at"].alias("at"), F.concat(acc["out"], F.array(got["out"])).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    bound = F.get(F.transform(F.array(rows), blocks), F.lit(0))  # bound, so that rows are found once
    return F.aggregate(bound, start, block, lambda acc: F.flatten(acc["out"]))


def _positions(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches whose group has so many characters, in code points."""
    found = F.arrays_zip(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias("before"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
    )
    steps = F.transform(found, lambda x: F.struct(F.length(x["before"]).alias("gap"), F.length(x["hit"]).alias("n"), F.length(x["part"]).alias("part")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        s = at + x["gap"]
        one = F.array(F.struct(s.alias("s"), F.lit(kind).alias("k"), (s + x["n"]).alias("e"))).cast(_SPANS)
        return s + x["n"], F.when(x["part"] >= least, one).otherwise(F.array().cast(_SPANS))

    return _scan(steps, step, _SPANS)


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by start and then kind."""
    low, none = F.lower(text), F.array().cast(_SPANS)
    words = F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api"))
    assign = F.when(words, _positions(text, ASSIGN, 0, 2, 8)).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), _positions(text, ACCESS, 1)).otherwise(none)
    hexes = F.when(text.rlike(HEX), _positions(text, HEX, 2)).otherwise(none)
    return F.array_sort(F.concat(assign, access, hexes))


def _tail(z: Column) -> Column:
    """Probability of a larger standard normal, to about 2e-4."""
    z = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1.0 / (1.0 + F.exp(1.5976 * z + 0.070565992 * z * z * z))


# The alphabets in the order of their codes.
_HEX_LOW, _HEX_UP, _B32 = "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_B64, _URL64 = _ALNUM + "+/", _ALNUM + "-_"


def alphabet(token: Column) -> Column:
    """The smallest of the known alphabets that has all characters of the token; null if none has."""
    kinds = [("^[0-9a-f]+$", _HEX_LOW), ("^[0-9A-F]+$", _HEX_UP), ("^[A-Z2-7]+$", _B32), ("^[A-Za-z0-9]+$", _ALNUM), ("^[A-Za-z0-9+/]+$", _B64), ("^[A-Za-z0-9_-]+$", _URL64)]
    return F.coalesce(*[F.when(token.rlike(p), F.lit(a)) for p, a in kinds])


def _with(rows: Column, **fields) -> Column:
    """An array of structs with more fields, each a function of the struct; every step is evaluated once an element."""
    return F.transform(rows, lambda x: F.struct(x["old"].alias("old"), *[f(x).alias(k) for k, f in fields.items()]))


def randomness(tokens: Column) -> Column:
    """For an array of structs (token, chars), each struct with p: Sidak's p-value of three tests of the token as
    draws from its alphabet chars, small if it isn't random; null without an alphabet.

    Chi-squared: characters repeat more than if uniform. Runs: codes change sides of the middle too often or seldom.
    Serial correlation: neighbouring codes are too alike or unlike.
    """

    def add(array: Column) -> Column:
        return F.aggregate(array, F.lit(0.0), lambda acc, v: acc + v)

    def pairs(x: Column, f) -> Column:
        return F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), f)

    rows = F.transform(tokens, lambda x: F.struct(x.alias("old"), F.split(x["token"], "(?<=.)(?=.)").alias("c"), F.length(x["token"]).cast("double").alias("n"), F.length(x["chars"]).cast("double").alias("k")))
    keep = {y: (lambda x, y=y: x[y]) for y in ("n", "k")}
    rows = _with(
        rows,
        **keep,
        x=lambda r: F.transform(r["c"], lambda c: F.instr(r["old"]["chars"], c) - (r["k"] + 1) / 2),
        same=lambda r: F.aggregate(F.array_distinct(r["c"]), F.lit(0.0), lambda acc, c: acc + F.pow(r["n"] - F.length(F.replace(r["old"]["token"], c, F.lit(""))), F.lit(2.0))),
    )
    rows = _with(
        rows,
        **keep,
        x=lambda r: r["x"],
        chi=lambda r: r["k"] / r["n"] * r["same"] - r["n"],
        up=lambda r: add(F.transform(r["x"], lambda v: F.when(v > 0, 1.0).otherwise(0.0))),
        turns=lambda r: add(pairs(r["x"], lambda a, b: F.when((a > 0) != (b > 0), 1.0).otherwise(0.0))),
        mean=lambda r: add(r["x"]) / r["n"],
        square=lambda r: add(F.transform(r["x"], lambda v: v * v)),
    )
    rows = _with(
        rows,
        n=lambda r: r["n"],
        p1=lambda r: _tail((r["chi"] - (r["k"] - 1)) / F.sqrt(2 * (r["k"] - 1) * (1 - 1 / r["n"]))),
        turns=lambda r: r["turns"],
        both=lambda r: 2 * r["up"] * (r["n"] - r["up"]),
        lag=lambda r: add(pairs(r["x"], lambda a, b: (a - r["mean"]) * (b - r["mean"]))),
        square=lambda r: r["square"] - r["n"] * r["mean"] * r["mean"],
    )
    rows = _with(
        rows,
        p1=lambda r: r["p1"],
        runs=lambda r: F.when(r["both"] > r["n"], F.abs(r["turns"] - r["both"] / r["n"]) * r["n"] * F.sqrt((r["n"] - 1) / (r["both"] * (r["both"] - r["n"])))).otherwise(8.0),
        serial=lambda r: F.when(r["square"] > 0, F.abs(r["lag"] / r["square"] + 1 / r["n"]) * F.sqrt(r["n"])).otherwise(8.0),
    )
    return F.transform(rows, lambda r: F.struct(r["old"].alias("old"), (1 - F.pow(1 - F.least(r["p1"], 2 * _tail(r["runs"]), 2 * _tail(r["serial"]), F.lit(1.0)), F.lit(3.0))).alias("p")))


def _length_class(n: Column) -> Column:
    """Half octaves of the length."""
    return F.floor(2 * F.log2(n.cast("double"))).cast("int")


def candidates(text: Column) -> Column:
    """Long tokens that have letters and digits: array of (s, e, cls, p)."""
    none = F.array().cast("array<struct<s:int,e:int,cls:int,p:double>>")
    tokens = F.transform(_positions(text, TOKEN, 3), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.regexp_replace(F.substring(text, x["s"] + 1, x["e"] - x["s"]), "=+$", "").alias("token")))
    tokens = F.filter(tokens, lambda x: x["token"].rlike("[A-Za-z]") & x["token"].rlike("[0-9]"))
    tokens = F.transform(tokens, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["token"].alias("token"), alphabet(x["token"]).alias("chars")))
    judged = randomness(F.filter(tokens, lambda x: x["chars"].isNotNull()))
    found = F.transform(judged, lambda x: F.struct(x["old"]["s"].alias("s"), x["old"]["e"].alias("e"), _length_class(F.length(x["old"]["token"])).alias("cls"), x["p"].alias("p")))
    return F.when(text.rlike(TOKEN), found).otherwise(none)


def thresholds(docs: DataFrame, fdr: float = 0.05) -> dict[int, float]:
    """The least p-value that counts as random, by length class: false-discovery control after Storey.

    Random tokens have uniform p-values and others small ones, less small the shorter they are; _least() finds the
    threshold of a class from its p-values. Each class borrows PRIOR candidates from all classes in proportion, so that
    what one of few candidates gets is near to what all get. A class without a candidate isn't named. The histogram of
    all candidates has 50 bins for each of at most 64 classes, whatever the input.
    """
    bins = (
        docs.select(F.explode(candidates(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("x"))
        .groupBy(F.col("x.cls").alias("cls"), F.least(F.floor(F.col("x.p") * _BINS), F.lit(_BINS - 1)).cast("int").alias("bin"))
        .count()
        .collect()
    )
    hist: dict[int, list[int]] = {}
    for r in bins:
        hist.setdefault(r["cls"], [0] * _BINS)[r["bin"]] += r["count"]
    pooled = [sum(x) for x in zip(*hist.values())]
    more = PRIOR / max(1, sum(pooled))
    return {cls: _least([x + more * y for x, y in zip(h, pooled)], fdr) for cls, h in hist.items()}


def _least(h: list[float], fdr: float) -> float:
    """The least p-value from 0.02 on above which the share of tokens that aren't random is at most fdr, as estimated; 2 if none is.

    The random tokens' number follows from how many there are above some p, as those p-values are uniform. It is taken
    from 0.2 on, and lower if fewer are found from some larger p on, by more than a standard deviation. A tenth of fdr is
    left for taking the least of many thresholds.
    """
    n = sum(h[_BINS // 5 :])
    true = n / 0.8
    for part in (0.35, 0.5, 0.65, 0.8):
        q = (1 - part) / 0.8
        true = min(true, (sum(h[round(_BINS * part) :]) + math.sqrt(n * q * (1 - q))) / (1 - part))
    return next((i / _BINS for i in range(1, _BINS) if (over := sum(h[i:])) > 0 and 1 - true * (1 - i / _BINS) / over <= 0.9 * fdr), 2.0)


def scan(docs: DataFrame, fdr: float = 0.05) -> DataFrame:
    """docs (doc_id, text, ...) with secret_spans: array of (s, k, e), by start and then kind.

    k indexes KINDS; s and e are code points, e exclusive. Spans of the base patterns always count; a token that passes
    the randomness tests is added where it meets none of them. A null text counts as empty; rows, repeats and null ids
    are kept; other columns stay, and a column secret_spans of docs is replaced. Very long tokens and texts of many
    spans take time in proportion to their length.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    least = thresholds(docs, fdr)
    bounds = F.create_map(*[F.lit(x) for kv in least.items() for x in kv]) if least else F.create_map(F.lit(-1), F.lit(2.0))
    rows = docs.drop("secret_spans").withColumn("secret_spans", base_spans(text))

    def fresh(x: Column) -> Column:
        return (x["p"] >= F.coalesce(bounds[x["cls"]], F.lit(2.0))) & ~F.exists("secret_spans", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))

    more = F.transform(F.filter(candidates(text), fresh), lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("k"), x["e"].alias("e")))
    return rows.withColumn("secret_spans", F.array_sort(F.concat("secret_spans", more.cast(_SPANS))))


def render(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", fdr: float = 0.05) -> DataFrame:
    """docs with every secret span of text replaced by a mark and n_chars, if there, set anew; overlapping spans become one.

    Texts without secrets, null ones included, stay as they are.
    """
    rows = scan(docs, fdr)
    none = F.array().cast("array<struct<s:int,e:int>>")

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        gap = F.array(F.struct(at.alias("s"), x["s"].alias("e"))).cast("array<struct<s:int,e:int>>")
        return F.greatest(at, x["e"]), F.when(x["s"] >= at, gap).otherwise(none)

    gaps = _scan(F.col("secret_spans"), step, "array<struct<s:int,e:int>>")
    end = F.struct(F.array_max(F.transform("secret_spans", lambda x: x["e"])).alias("s"), F.length("text").alias("e"))
    letters = lambda text: F.transform(F.array(F.split(text, "")), lambda c: F.array_join(F.transform(F.concat(gaps, F.array(end)), lambda x: F.array_join(F.slice(c, x["s"] + 1, x["e"] - x["s"]), "")), mark))
    has = F.size("secret_spans") > 0
    out = rows.withColumn("text", F.when(has, F.get(letters(F.col("text")), F.lit(0))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(has, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*quoted(docs.columns)) if "secret_spans" not in docs.columns else out
