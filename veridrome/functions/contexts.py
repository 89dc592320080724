"""Predicates over context maps and settings, and pieces of JSON, as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def has(context: Column, key: str, value: str | None = None) -> Column:
    """A key exists, and has the value if one is given; false for a null map."""
    v = F.try_element_at(context, F.lit(key))
    return F.coalesce(v.isNotNull() if value is None else v == value, F.lit(False))


def has_pair(context: Column, pair: str) -> Column:
    """The condition ``key:value``; without a colon only the key counts."""
    key, colon, value = pair.partition(":")
    return has(context, key, value if colon else None)


def has_all(context: Column, pairs: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [has_pair(context, p) for p in pairs], F.lit(True))


def match_share(context: Column, weights: dict[str, float]) -> Column:
    """Share of the weight of the conditions that hold."""
    total = sum(weights.values())
    return sum(F.when(has_pair(context, p), w).otherwise(0.0) for p, w in weights.items()) / total


def content_ready(text: Column, required: list[str], least: int = 0) -> Column:
    """All required pieces occur and the text is long enough."""
    low = F.lower(text)
    parts = [low.contains(r.lower()) for r in required] + [F.length(text) >= least]
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


def applicable(requested: Column, supported: list[str], by_domain: dict[str, list[str]], domain: Column) -> Column:
    """Requested and supported, else what the domain calls for, else all supported."""
    every = F.array(*[F.lit(s) for s in supported])
    asked = F.array_intersect(F.coalesce(requested, F.array().cast("array<string>")), every)
    called = F.array().cast("array<string>")
    for d, fs in by_domain.items():
        called = F.when(domain == d, F.array_intersect(F.array(*[F.lit(f) for f in fs]), every)).otherwise(called)
    return F.when(F.size(asked) > 0, asked).when(F.size(called) > 0, called).otherwise(every)


def problems(checks: dict[str, Column]) -> Column:
    """Names of the checks that fail (a null counts as failing)."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), None).otherwise(F.lit(k)) for k, c in checks.items()]))


def at_path(json: Column, path: str, default: str | None = None) -> Column:
    """A dotted path such as ``a.b[0].c`` in JSON text."""
    v = F.get_json_object(json, f"$.{path}")
    return v if default is None else F.coalesce(v, F.lit(default))


def masked(context: Column, secret: list[str]) -> Column:
    """A map with the values of secret keys hidden."""
    return F.transform_values(context, lambda k, v: F.when(k.isin(*secret), F.lit("***")).otherwise(v))


def digest(value: Column) -> Column:
    """SHA-256 of canonical JSON (map entries sorted by key)."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(value)))), 256)
