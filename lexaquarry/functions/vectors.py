"""Quantization and distances on array columns, inside Catalyst."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BINARY, FLOAT32, INT8
from .text import let


def as_array(vector: list[float], kind: str = "array<double>") -> Column:
    """A query's vector as a literal column."""
    return F.array(*[F.lit(float(x)) for x in vector]).cast(kind)


def dot(a: Column, b: Column) -> Column:
    """In the arrays' order, in double precision."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0).cast("double"), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cosine; 1 where a vector has no length."""
    n = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(n > 0, 1 - dot(a, b) / n).otherwise(F.lit(1.0))


def score(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))


def prefix(a: Column, dimension: int) -> Column:
    return F.slice(a, 1, dimension)


def to_float32(v: Column) -> Column:
    return v.cast("array<float>")


def to_int8(v: Column) -> Column:
    """Unit length, times 127, rounded away from zero; a vector without length stays zero."""
    whole = lambda n: F.when(n > 0, F.transform(v.cast("array<double>"), lambda x: F.round(x / n * 127).cast("tinyint"))).otherwise(F.transform(v, lambda x: F.lit(0).cast("tinyint")))
    return let(norm(v), whole)


def from_int8(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / 127)


def to_bits(v: Column) -> Column:
    """Signs as 64-bit words, first component in the lowest bit; a bit is set for components of at least 0."""
    n = F.size(v)
    word = lambda w: F.aggregate(F.sequence(F.lit(0), F.least(F.lit(63), n - w * 64 - 1)), F.lit(0).cast("bigint"), lambda s, i: s.bitwiseOR(F.when(F.get(v, w * 64 + i) >= 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.ceil(n / 64).cast("int") - 1), word)).otherwise(F.array().cast("array<bigint>"))


def from_bits(words: Column, dimension: int) -> Column:
    """Signs as -1 and 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.when(F.getbit(F.get(words, F.floor(i / 64).cast("int")), i % 64) == 1, F.lit(1.0)).otherwise(F.lit(-1.0)))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def quantized(v: Column, mode: str) -> Column:
    """How vectors are kept in each mode; the binary mode keeps full vectors beside the signs."""
    return {FLOAT32: to_float32, INT8: to_int8, BINARY: to_float32}[mode](v)


def check_dimension(mode: str, dimension: int) -> None:
    if dimension <= 0 or (mode == BINARY and dimension % 8):
        raise ValueError(f"dimension {dimension} doesn't fit {mode} vectors")


# one vector as bytes, for exchange with other programs


def pack(vector: list[float], mode: str = FLOAT32) -> bytes:
    if mode == FLOAT32:
        return struct.pack(f"<{len(vector)}f", *vector)
    check_dimension(mode, len(vector))
    if mode == INT8:
        n = sum(x * x for x in vector) ** 0.5
        away = lambda x: int(abs(x) + 0.5) * (1 if x >= 0 else -1)
        return struct.pack(f"<{len(vector)}b", *(away(x / n * 127) if n else 0 for x in vector))
    return bytes(sum((vector[i + j] >= 0) << j for j in range(8)) for i in range(0, len(vector), 8))


def unpack(blob: bytes, mode: str = FLOAT32) -> list[float]:
    if mode == FLOAT32:
        if len(blob) % 4:
            raise ValueError("a float32 vector has four bytes a component")
        return list(struct.unpack(f"<{len(blob) // 4}f", blob))
    if mode == INT8:
        return [x / 127 for x in struct.unpack(f"<{len(blob)}b", blob)]
    return [1.0 if (b >> j) & 1 else -1.0 for b in blob for j in range(8)]
