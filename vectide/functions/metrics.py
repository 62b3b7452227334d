"""Distances between vectors: as columns, and as NumPy kernels over batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidConfig
from .vectors import dot, norm, total

#: Identifiers below this are the library's; 0 means that none is recorded.
FIRST_CUSTOM_ID = 1024


@dataclass(frozen=True)
class Metric:
    """column(a, b, dim) and kernel(query, vectors) compute the same distance; the smaller the nearer."""

    id: int
    name: str
    column: Callable[[Column, Column, int | None], Column]
    kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]

    def __post_init__(self):
        if not self.name:
            raise InvalidConfig("a metric needs a name")


def _squared(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    d = v - q  # never by norms, which cancel for close vectors
    return np.einsum("ij,ij->i", d, d)


def _cosine_column(a: Column, b: Column, dim: int | None) -> Column:
    both = norm(a, dim) * norm(b, dim)
    return F.when(both == 0, F.lit(1.0)).otherwise(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b, dim) / both)))


def _cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    both = np.sqrt(q @ q) * np.sqrt(np.einsum("ij,ij->i", v, v))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(both == 0, 1.0, 1 - np.clip(v @ q / both, -1.0, 1.0))


SQUARED_EUCLIDEAN = Metric(1, "sqeuclidean", lambda a, b, d: total(a, b, lambda x, y: (x - y) * (x - y), d), _squared)
EUCLIDEAN = Metric(2, "euclidean", lambda a, b, d: F.sqrt(total(a, b, lambda x, y: (x - y) * (x - y), d)), lambda q, v: np.sqrt(_squared(q, v)))
COSINE = Metric(3, "cosine", _cosine_column, _cosine)
DOT_PRODUCT = Metric(4, "dot", lambda a, b, d: 1 - dot(a, b, d), lambda q, v: 1 - v @ q)
MANHATTAN = Metric(5, "manhattan", lambda a, b, d: total(a, b, lambda x, y: F.abs(x - y), d), lambda q, v: np.abs(v - q).sum(axis=1))

_BY_NAME = {m.name: m for m in (SQUARED_EUCLIDEAN, EUCLIDEAN, COSINE, DOT_PRODUCT, MANHATTAN)}


def metric(name: str | Metric) -> Metric:
    if isinstance(name, Metric):
        return name
    if name not in _BY_NAME:
        raise InvalidConfig(f"no metric {name}; known: {', '.join(_BY_NAME)}")
    return _BY_NAME[name]


def register(own: Metric) -> Metric:
    """Makes a metric known by its name. Its id must be FIRST_CUSTOM_ID or more, and new, or 0 for none."""
    if 0 < own.id < FIRST_CUSTOM_ID:
        raise InvalidConfig(f"ids below {FIRST_CUSTOM_ID} are reserved")
    if any(m.id == own.id != 0 and m.name != own.name for m in _BY_NAME.values()):
        raise InvalidConfig(f"another metric has id {own.id}")
    if own.name in _BY_NAME and 0 < _BY_NAME[own.name].id < FIRST_CUSTOM_ID:
        raise InvalidConfig(f"{own.name} is reserved")
    _BY_NAME[own.name] = own
    return own


def check_identity(recorded: int, asked: Metric) -> None:
    """A table may be opened with the metric it was written with; a recorded 0 accepts any, an asked 0 no recorded one."""
    if recorded not in (0, asked.id):
        raise InvalidConfig(f"written with metric {recorded}, not {asked.id}")
