"""Vector expressions: hashing, normalising, cosine, and four-bit quantisation with sign residuals."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 384
# The 32-bit FNV-1a offset and prime, and the weight of a trigram against its word.
FNV_OFFSET, FNV_PRIME, TRIGRAM_WEIGHT = 2166136261, 16777619, 0.45
# Quantiser scale, code range, and the residual's size.
SCALE, LOW, HIGH, RESIDUAL = 12, -8, 7, 0.02


def fnv1a(c: Column) -> Column:
    """The signed 32-bit FNV-1a hash of a string's code points, as a long."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    step = lambda h, x: (h.bitwiseXOR(x) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(codes, F.lit(FNV_OFFSET).cast("long"), step, lambda h: F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h))


def fnv1a_py(text: str) -> int:
    """The same hash in Python."""
    h = FNV_OFFSET
    for c in text:
        h = ((h ^ ord(c)) * FNV_PRIME) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def fnv1a_rows(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The same hash of the first ``lengths`` code points in each row of a matrix."""
    h = np.full(len(codes), FNV_OFFSET, np.uint64)
    for k in range(codes.shape[1]):
        step = ((h ^ codes[:, k]) * np.uint64(FNV_PRIME)) & np.uint64(0xFFFFFFFF)
        h = np.where(k < lengths, step, h)
    return h.astype(np.uint32).view(np.int32).astype(np.int64)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column, digits: int = 6) -> Column:
    """Scaled to length one (zero stays zero), components rounded."""
    n = norm(v)
    return F.transform(v, lambda x: F.round(x / F.when(n == 0, 1.0).otherwise(n), digits))


def cosine(a: Column, b: Column, digits: int = 4) -> Column:
    """Cosine over the shorter length, rounded, within -1..1; 0 if either norm is 0."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    both = norm(x) * norm(y)
    raw = F.round(dot(x, y) / both, digits)
    return F.when(both > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))).otherwise(F.lit(0.0))


def rotation(d: int) -> np.ndarray:
    """The fixed matrix of the quantiser, (2 sin(13.37 i + 42.1 j) - 1) / sqrt(d) in row i and column j.

    It is not orthogonal; the formula defines the codes and is kept.
    """
    i, j = np.meshgrid(np.arange(d), np.arange(d), indexing="ij")
    return (np.sin(i * 13.37 + j * 42.1) * 2 - 1) / math.sqrt(d)


def quantize(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Norms, codes (LOW..HIGH) and residual bits of the rows of ``x``; a zero row has norm 1."""
    norms = np.sqrt((x * x).sum(axis=1))
    norms[norms == 0] = 1
    y = (x / norms[:, None]) @ rotation(x.shape[1]).T
    codes = np.clip(np.floor(y * SCALE + 0.5), LOW, HIGH)
    return norms, codes.astype(np.int8), y - codes / SCALE >= 0


def pack_codes(codes: np.ndarray, bits: np.ndarray) -> list[bytes]:
    """Each row's codes, a byte each, and its residual bits, eight in a byte."""
    return [c.tobytes() + b.tobytes() for c, b in zip(codes.astype(np.int8), np.packbits(bits, axis=1))]


def unpack_codes(rows: list[bytes], d: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, residual bits) of ``pack_codes`` for rows of ``d`` components."""
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    return raw[:, :d].view(np.int8), np.unpackbits(raw[:, d:], axis=1, count=d).astype(bool)


def estimate(queries: np.ndarray, codes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Estimated products, queries by rows, within -1..1 and rounded to 4 digits."""
    y = codes / SCALE + np.where(bits, RESIDUAL, -RESIDUAL)
    return np.clip(np.round((queries @ rotation(queries.shape[1]).T) @ y.T, 4), -1, 1) + 0.0


def fit(v, d: int) -> list[float]:
    """A vector cut or padded with zeros to ``d`` components."""
    v = [] if v is None else list(v)[:d]
    return v + [0.0] * (d - len(v))
