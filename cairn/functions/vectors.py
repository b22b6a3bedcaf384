"""Vector functions: cosine as an expression, and the deterministic hash embedding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is empty or zero; null where the lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm > 0, dot(a, b) / norm).otherwise(0.0))


def hash_embedding(text: Column, dims: int) -> Column:
    """Bytes of the text's SHA-256, read round and round, shifted to -0.5..0.5 and brought to length 1."""
    digest = F.sha2(text.cast("binary"), 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.conv(F.substring(digest, ((i * 7) % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255 - 0.5)
    return F.get(F.transform(F.array(raw), lambda r: F.transform(r, lambda x: x / F.sqrt(dot(r, r)))), F.lit(0))
