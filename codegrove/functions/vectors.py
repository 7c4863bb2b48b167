"""Vector arithmetic on array columns, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values: Sequence[float]) -> Column:
    """A constant query vector."""
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    squares = F.transform(a, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def cosine(a: Column, b: Column, b_norm: float | None = None) -> Column:
    """Cosine similarity; 0 when either vector has no length."""
    def ratio(v: Column) -> Column:
        size = norm(v) * (norm(b) if b_norm is None else F.lit(b_norm))
        return F.coalesce(F.try_divide(dot(v, b), size), F.lit(0.0))

    return bound(a, ratio)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body (or a lambda in it) uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalised(a: Column) -> Column:
    def divide(s: Column) -> Column:
        return F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"])

    return bound(a, lambda v: bound(F.struct(v.alias("v"), norm(v).alias("n")), divide))


def mock_embedding(text: Column, dims: int = 1024, normalise: bool = True) -> Column:
    """deterministic stand-in for a model: SHA-256 bytes, repeated, scaled to [-1, 1].

    The 32 distinct values are computed once and tiled, whatever the number of dimensions.
    """

    def scaled(digest: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(31)),
            lambda i: F.conv(F.substr(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double")
            / 255.0 * 2.0 - 1.0,
        )

    base = bound(F.sha2(text, 256), scaled)
    tiled = F.slice(F.flatten(F.array_repeat(base, -(-dims // 32))), 1, dims)
    return normalised(tiled) if normalise else tiled


def mock_embedding_local(text: str, dims: int = 1024) -> list[float]:
    """The same vector for one query string, computed on the driver."""
    import hashlib
    import math

    digest = hashlib.sha256(text.encode()).digest()
    raw = [digest[i % 32] / 255.0 * 2.0 - 1.0 for i in range(dims)]
    length = math.sqrt(math.fsum(v * v for v in raw))
    return [v / length for v in raw] if length > 0 else raw
