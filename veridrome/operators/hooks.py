"""Extension points: named column functions, model outputs and ordered interventions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Registry:
    """Named extensions.  ``columns`` map a text column to a column; ``tables`` map documents to spans."""

    columns: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    tables: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def column(self, name: str):
        """Decorator that registers a column function; a second of the same name is an error."""

        def put(f):
            if name in self.columns:
                raise ValueError(f"registered twice: {name}")
            self.columns[name] = f
            return f

        return put

    def apply(self, df: DataFrame, text: str, names: list[str]) -> DataFrame:
        """Add the named columns."""
        return df.withColumns({n: self.columns[n](F.col(text)) for n in names})

    def run_all(self, docs: DataFrame) -> DataFrame:
        """Union of the rows of all registered table functions, with their name."""
        out = None
        for n, f in self.tables.items():
            rows = f(docs).withColumn("model", F.lit(n))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out


@dataclass(frozen=True)
class Intervention:
    """A step over a text: it may block it (``blocks``) or rewrite it (``rewrites``)."""

    name: str
    blocks: Callable[[Column], Column] | None = None
    rewrites: Callable[[Column], Column] | None = None


def intervene(df: DataFrame, text: str, steps: list[Intervention]) -> DataFrame:
    """Run steps in order; after a block nothing else happens.  Adds ``output`` (null if blocked) and ``blocked_by``."""
    out, by = F.col(text), F.lit(None).cast("string")
    for s in steps:
        if s.blocks:
            by = F.when(by.isNull() & F.coalesce(s.blocks(out), F.lit(False)), F.lit(s.name)).otherwise(by)
        if s.rewrites:
            out = F.when(by.isNull(), s.rewrites(out)).otherwise(out)
    return df.withColumns({"output": F.when(by.isNull(), out), "blocked_by": by})


def route(df: DataFrame, model: str, explicit: dict[str, str], candidates: list[tuple[str, str]], default: str, failed: list[str] | None = None) -> DataFrame:
    """Provider of each request: the explicit one, else the first candidate whose prefix fits, else the default; failed ones are skipped."""
    skip = set(failed or [])
    out = F.lit(default if default not in skip else None)
    for prefix, provider in reversed(candidates):
        if provider not in skip:
            out = F.when(F.col(model).startswith(prefix), F.lit(provider)).otherwise(out)
    for m, provider in explicit.items():
        if provider not in skip:
            out = F.when(F.col(model) == m, F.lit(provider)).otherwise(out)
    return df.withColumn("provider", out)
