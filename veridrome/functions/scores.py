"""Severity scales and score ladders.  Six scales differ; never share one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The scales by severity.
SEVERITIES = ("low", "medium", "high", "critical")
EXPONENT = {"low": 0.5, "medium": 1.0, "high": 2.0, "critical": 3.0}
WEIGHT = {"critical": 100, "high": 50, "medium": 10, "low": 1}
LADDER = {"critical": 1, "high": 2, "medium": 5, "low": 10}
PENALTY = {"low": 0.1, "medium": 0.3, "high": 0.6, "critical": 1.0}
NGRAM = {"low": 1, "medium": 3, "high": 7, "critical": 10}
ENTITY = {"low": 1, "medium": 3, "high": 6, "critical": 10}
REASONER = {"critical": 1.0, "high": 0.75, "medium": 0.5, "low": 0.25}
PRIORITY = {"critical": 0, "high": 10, "medium": 50, "low": 100}
#: Score from which content complies, by mode.
MODES = {"strict": 0.95, "standard": 0.85, "relaxed": 0.75}


def scale(severity: Column, values: dict, default=None) -> Column:
    """The value of a severity on a scale."""
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(severity == k, F.lit(v)).otherwise(out)
    return out


def rank(severity: Column) -> Column:
    """1 for low to 4 for critical; 0 for anything else."""
    return scale(severity, {s: i for i, s in enumerate(SEVERITIES, 1)}, 0)


def ladder(value: Column, steps: list[tuple[float, object]], otherwise) -> Column:
    """The label of the first step that is above the value."""
    out = F.lit(otherwise)
    for limit, label in reversed(steps):
        out = F.when(value < limit, F.lit(label)).otherwise(out)
    return out


def sigmoid(x: Column, slope: float = 10.0, middle: float = 0.5) -> Column:
    return 1 / (1 + F.exp(-slope * (x - middle)))


def safe_ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b, or ``empty`` where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))
