"""Vectors in two to four bits a dimension: random rotation, Gaussian quantization, scores from codes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import matrix
from ..errors import DimensionMismatch, IncompatibleQuery, InvalidBits, InvalidConfig, InvalidVector, ZeroK
from .search import top_k

# Positive Lloyd-Max levels of a unit Gaussian for 2, 3 and 4 bits, the default seed, the metrics.
LEVELS = {
    2: (0.4528, 1.5104),
    3: (0.2451, 0.7560, 1.3439, 2.1520),
    4: (0.1284, 0.3881, 0.6568, 0.9424, 1.2562, 1.6181, 2.0690, 2.7326),
}
SEED = 0x46485156
METRICS = ("cosine", "dot")


def block_size(dim: int) -> tuple[int, int]:
    """(block, padded dimension): the largest power of two from 8 to 512 that divides the dimension, or 8 with padding."""
    sizes = [1 << b for b in range(9, 2, -1)]
    fit = next((s for s in sizes if dim % s == 0), None)
    return (fit, dim) if fit else (8, -(-dim // 8) * 8)


def signs(n: int, seed: int) -> np.ndarray:
    """n random signs: the low bits of a SplitMix64 stream."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    return np.where(z & np.uint64(1), -1.0, 1.0)


def hadamard(n: int) -> np.ndarray:
    """The orthonormal Walsh-Hadamard matrix of a power of two."""
    bits = np.bitwise_count(np.arange(n)[:, None] & np.arange(n)[None, :])
    return np.where(bits & 1, -1.0, 1.0) / np.sqrt(n)


@dataclass(frozen=True)
class Codec:
    """Equal codecs make and read the same codes."""

    dim: int
    bits: int = 4
    metric: str = "cosine"
    seed: int = SEED

    def __post_init__(self):
        if self.bits not in LEVELS:
            raise InvalidBits(self.bits)
        if self.dim < 1:
            raise InvalidConfig("vectors need a dimension")
        if self.metric not in METRICS:
            raise InvalidConfig(f"codes are for {METRICS}")

    @property
    def padded(self) -> int:
        return block_size(self.dim)[1]

    @property
    def row_bytes(self) -> int:
        return -(-self.padded * self.bits // 8)

    @property
    def levels(self) -> np.ndarray:
        half = np.array(LEVELS[self.bits]) / np.sqrt(self.padded)
        return np.concatenate([-half[::-1], half])

    @property
    def boundaries(self) -> np.ndarray:
        return (self.levels[1:] + self.levels[:-1]) / 2

    def rotation(self) -> np.ndarray:
        """dim x padded: multiply a row vector by it."""
        block, padded = block_size(self.dim)
        h, out = hadamard(block), np.zeros((padded, padded))
        for s in range(0, padded, block):
            out[s : s + block, s : s + block] = h
        return (signs(padded, self.seed)[:, None] * out)[: self.dim]

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, scales): a level number for each padded dimension, and the factor that restores the norm."""
        if not np.isfinite(v).all():
            raise InvalidVector("a vector must be finite")
        n = np.sqrt(np.einsum("ij,ij->i", v, v))
        if self.metric == "cosine" and (n == 0).any():
            raise InvalidVector("a zero vector has no direction")
        tiny = n <= np.finfo(np.float32).eps
        codes = np.searchsorted(self.boundaries, np.where(tiny[:, None], 0.0, v / np.where(tiny, 1.0, n)[:, None]) @ self.rotation(), side="left").astype(np.uint8)
        level = self.levels[codes]
        restored = np.sqrt(np.einsum("ij,ij->i", level, level))
        return codes, (1.0 if self.metric == "cosine" else n) / restored

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """bytes x rows of codes, the lowest bits first."""
        bits = (codes[:, :, None] >> np.arange(self.bits, dtype=np.uint8)) & 1
        return np.packbits(bits.reshape(len(codes), -1), axis=1, bitorder="little")

    def unpack(self, packed: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(packed, axis=1, bitorder="little")[:, : self.padded * self.bits].reshape(len(packed), self.padded, self.bits)
        return (bits << np.arange(self.bits, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)

    def prepare(self, query: Sequence[float]) -> PreparedQuery:
        q = np.asarray(query, dtype=np.float64)
        if len(q) != self.dim:
            raise DimensionMismatch(self.dim, len(q))
        if not np.isfinite(q).all():
            raise InvalidVector("a query must be finite")
        if self.metric == "cosine":
            n = np.sqrt(q @ q)
            if n == 0:
                raise InvalidVector("a zero query has no direction")
            q = q / n
        return PreparedQuery(self, q @ self.rotation())

    def metadata(self) -> dict:
        block, padded = block_size(self.dim)
        return {"version": 1, "dimensions": self.dim, "padded_dimensions": padded, "metric": self.metric, "bits": self.bits, "seed": self.seed, "block_size": block, "row_stride": self.row_bytes}


@dataclass(frozen=True)
class PreparedQuery:
    """A rotated query, bound to its codec."""

    codec: Codec
    rotated: np.ndarray

    def check(self, codec: Codec) -> None:
        if codec != self.codec:
            raise IncompatibleQuery("the query was prepared for another codec")


def quantize(vectors: DataFrame, codec: Codec) -> DataFrame:
    """(id, codes, scale) of vectors (id, vector): packed codes and a float scale."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes, scales = codec.encode(matrix(b.column(1), codec.dim))
                packed = codec.pack(codes)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(scales.astype(np.float32))], names=["id", "codes", "scale"])

    return vectors.select(F.col("id").cast("long"), "vector").mapInArrow(run, "id long, codes binary, scale float")


def decode_codes(rows: DataFrame, codec: Codec) -> DataFrame:
    """(id, codes, scale) with codes as an array of level numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = codec.unpack(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, codec.row_bytes))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.astype(np.int32).tolist(), pa.list_(pa.int32())), b.column(2)], names=["id", "codes", "scale"])

    return rows.select("id", "codes", "scale").mapInArrow(run, "id long, codes array<int>, scale float")


def scores(rows: DataFrame, prepared: PreparedQuery) -> DataFrame:
    """(id, score) of all rows (id, codes, scale): the query's inner product with what the codes stand for."""
    codec = prepared.codec

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = codec.levels
        for b in batches:
            if b.num_rows:
                codes = codec.unpack(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, codec.row_bytes))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(levels[codes] @ prepared.rotated * b.column(2).to_numpy())], names=["id", "score"])

    return rows.select(F.col("id").cast("long"), "codes", "scale").mapInArrow(run, "id long, score double")


def quantized_search(rows: DataFrame, prepared: PreparedQuery, k: int, codec: Codec | None = None) -> DataFrame:
    """(rank, id, distance): the k rows of least 1 - score, from the codes alone."""
    if codec is not None:
        prepared.check(codec)
    if k < 1:
        raise ZeroK()
    near = scores(rows, prepared).select(F.lit(0).alias("query_id"), "id", (1 - F.col("score")).alias("distance")).orderBy("distance", "id").limit(k)
    return top_k(near, k).drop("query_id")


def storage(rows: DataFrame, codec: Codec) -> DataFrame:
    """One row: number of rows, bytes of codes and scales, checksum over the rows' CRC32s, which doesn't depend on their order."""
    return rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("codes") + 4).alias("packed_bytes"), F.sum(F.crc32("codes")).alias("checksum"), F.lit(codec.row_bytes).alias("row_stride"))
