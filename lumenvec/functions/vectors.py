"""Vector expressions (P7-P11, P20-P24) and the blob codec (P8). Arithmetic is in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(u: Column, v: Column) -> Column:
    """Inner product; null vectors give 0."""
    return F.coalesce(F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x), F.lit(0.0))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """V over its length; a zero vector is null (its row is to be dropped)."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def validate_norm(v: Column, tolerance: float = 0.01) -> Column:
    """V itself if its length is within tolerance of 1, else made a unit; zero is null."""
    n = norm(v)
    return F.when(F.abs(n - 1) <= tolerance, F.transform(v, lambda x: x.cast("double"))).otherwise(unit(v))


def cosine(u: Column, v: Column) -> Column:
    """P10: with the guard of 1e-8 in the divisor."""
    return dot(u, v) / (norm(u) * norm(v) + 1e-8)


def band(similarity: Column) -> Column:
    """P11."""
    return F.when(similarity > 0.85, "redundant").when(similarity >= 0.70, "same_person").otherwise("different_person")


def iou(a: Column, b: Column) -> Column:
    """P20: intersection over union of boxes; 0 for an empty union."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    both = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return F.when(union > 0, both / F.nullif(union, F.lit(0.0))).otherwise(0.0)


def box_ratio(box: Column) -> Column:
    """Width over height; 1 for no height."""
    height = box[3] - box[1]
    return F.when(height > 0, (box[2] - box[0]) / F.nullif(height, F.lit(0.0))).otherwise(1.0)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hexadecimal hashes; 64 if either is empty or invalid."""
    valid = lambda h: h.rlike("^[0-9a-fA-F]{16}$")
    part = lambda h, at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
    bits = F.bit_count(part(a, 1).bitwiseXOR(part(b, 1))) + F.bit_count(part(a, 9).bitwiseXOR(part(b, 9)))
    return F.when(F.coalesce(valid(a) & valid(b), F.lit(False)), bits).otherwise(64).cast("int")


def near_duplicate(a: Column, b: Column, most: int = 5) -> Column:
    """Fewer than most differing bits."""
    return hamming(a, b) < most


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_blob(blobs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Little-endian float32 bytes of a column as vectors."""
    for s in blobs:
        yield s.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


@F.pandas_udf(T.BinaryType())
def encode_blob(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Vectors as little-endian float32 bytes."""
    for s in vectors:
        yield s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())
