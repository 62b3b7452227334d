"""Vector functions as columns: in double precision, from arrays of any number type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to this dimension sums are written out, which Spark compiles; beyond it they are lambdas.
UNROLL = 128


def _sum(terms: list[Column]) -> Column:
    """The sum from left to right, as the lambdas add too."""
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def total(a: Column, b: Column, term, dim: int | None) -> Column:
    """The sum of term(x, y) over the components of two arrays."""
    if dim is not None and dim <= UNROLL:
        return _sum([term(F.get(a, F.lit(i)).cast("double"), F.get(b, F.lit(i)).cast("double")) for i in range(dim)])
    return F.aggregate(F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column, dim: int | None = None) -> Column:
    return total(a, b, lambda x, y: x * y, dim)


def norm(a: Column, dim: int | None = None) -> Column:
    return F.sqrt(dot(a, a, dim))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * by)


def normalize(a: Column, dim: int | None = None) -> Column:
    """The vector divided by its norm. A zero or non-finite vector fails the job."""
    n = norm(a, dim)
    bad = n.isNull() | F.isnan(n) | (n == 0) | (n == float("inf"))
    return F.when(bad, F.raise_error(F.lit("a zero or non-finite vector can't be normalized")).cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def mixture(a: Column, b: Column, share: float = 0.85) -> Column:
    """share * a + (1 - share) * b, normalized."""
    return normalize(F.zip_with(a, b, lambda x, y: x.cast("double") * share + y.cast("double") * (1 - share)))
