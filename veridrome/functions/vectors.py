"""Vector measures over arrays of floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridrome.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def boundary(a: Column, normal: Column, offset: Column) -> Column:
    """Signed distance to a hyperplane."""
    return dot(a, normal) - offset


def peak(a: Column) -> Column:
    return F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))


def quantise(a: Column, bits: int = 8) -> Column:
    """Symmetric codes: round(x * (2^(bits-1) - 1) / max|x|), half to even; zeros for a zero vector."""
    top = float(2 ** (bits - 1) - 1)
    return let(peak(a), lambda m: F.transform(a, lambda x: F.when(m == 0, F.lit(0)).otherwise(F.bround(x.cast("double") * top / m)).cast("int")))


def dequantise(codes: Column, scale: Column) -> Column:
    """Back from codes; ``scale`` is max|x| / (2^(bits-1) - 1)."""
    return let(scale, lambda s: F.transform(codes, lambda q: q.cast("double") * s))


def affine(a: Column, bits: int = 8) -> Column:
    """Codes between the least and the greatest value: 0 .. 2^bits - 1."""
    edge = F.struct(F.array_min(a).cast("double").alias("lo"), F.array_max(a).cast("double").alias("hi"))

    def codes(e: Column) -> Column:
        return F.transform(a, lambda x: F.when(e["hi"] == e["lo"], F.lit(0)).otherwise(F.bround((x.cast("double") - e["lo"]) * float(2**bits - 1) / (e["hi"] - e["lo"]))).cast("int"))

    return let(edge, codes)


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    return let(norm(a), lambda n: F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n)))


def softmax(a: Column) -> Column:
    """Stable softmax."""
    powers = let(F.array_max(a).cast("double"), lambda top: F.transform(a, lambda x: F.exp(x.cast("double") - top)))

    def shares(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(e, lambda x: x / total))

    return let(powers, shares)


def mask(a: Column, forbidden: Column, value: float = -1e9) -> Column:
    """Entries at the forbidden 0-based places set to ``value``."""
    return F.transform(a, lambda x, i: F.when(F.array_contains(forbidden, i), F.lit(value)).otherwise(x.cast("double")))


def nonzero_share(a: Column) -> Column:
    """Share of entries that are not 0."""
    return F.size(F.filter(a, lambda x: x != 0)) / F.size(a)


def prune(a: Column, share: float) -> Column:
    """Zero the entries with the least magnitudes: floor(share * n) of them, and equals of the last."""
    sizes = F.array_sort(F.transform(a, lambda x: F.abs(x.cast("double"))))
    k = F.floor(F.size(a) * share).cast("int")
    limit = F.when(k > 0, F.element_at(sizes, F.greatest(k, F.lit(1)))).otherwise(F.lit(-1.0))
    return let(limit, lambda m: F.transform(a, lambda x: F.when(F.abs(x.cast("double")) <= m, F.lit(0.0)).otherwise(x.cast("double"))))
