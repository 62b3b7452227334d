"""Errors of the library."""

from __future__ import annotations


class VectideError(Exception):
    """Base of all errors here."""


class DimensionMismatch(VectideError, ValueError):
    def __init__(self, expected: int, actual: int):
        super().__init__(f"dimension {actual}, not {expected}")
        self.expected, self.actual = expected, actual


class ZeroK(VectideError, ValueError):
    def __init__(self):
        super().__init__("k must be at least 1")


class ReadOnly(VectideError):
    """A frozen table was to be changed."""


class IdOutOfBounds(VectideError, LookupError):
    def __init__(self, id: int, n: int):
        super().__init__(f"no row {id} among {n}")
        self.id, self.n = id, n


class InvalidConfig(VectideError, ValueError):
    """Settings that contradict each other."""


class DesynchronizedPair(VectideError):
    """The two sides of a paired table differ."""


class InvalidSnapshot(VectideError, OSError):
    """Stored files that are incomplete or inconsistent."""


class InvalidVector(VectideError, ValueError):
    """A vector that is null, empty, or has null or non-finite components."""


class InvalidBits(VectideError, ValueError):
    def __init__(self, bits: int):
        super().__init__(f"{bits} bits; 2, 3 and 4 are known")


class IncompatibleQuery(VectideError, ValueError):
    """A prepared query of another codec."""


class IncompatibleIndex(VectideError, ValueError):
    """A graph and codes that don't belong together."""
