"""Reports over audit entries and events: filters, roll-ups, rates, histograms."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veridrome.functions import scores as S


def matching(
    df: DataFrame,
    since: datetime | str | None = None,
    until: datetime | str | None = None,
    equals: dict[str, object] | None = None,
    among: dict[str, list] | None = None,
    overlaps: dict[str, list] | None = None,
    time: str = "timestamp",
) -> DataFrame:
    """Rows that meet all given conditions; an option that is None or empty is no condition.

    Both ends of the time range belong to it.  All conditions are plain
    comparisons, so they reach the scan; a null value meets no condition.
    """
    if since:
        df = df.where(F.col(time) >= F.lit(since).cast("timestamp"))
    if until:
        df = df.where(F.col(time) <= F.lit(until).cast("timestamp"))
    for c, v in (equals or {}).items():
        if v is not None:
            df = df.where(F.col(c) == F.lit(v))
    for c, vs in (among or {}).items():
        if vs:
            df = df.where(F.col(c).isin(*vs))
    for c, vs in (overlaps or {}).items():
        if vs:
            df = df.where(F.arrays_overlap(F.col(c), F.array(*[F.lit(v) for v in vs])))
    return df


def latest(df: DataFrame, n: int, time: str = "timestamp", key: str = "entry_id") -> DataFrame:
    """The newest ``n`` rows, ties by key (a top-n, no full sort)."""
    return df.orderBy(F.desc_nulls_last(time), key).limit(n)


def compliance_rates(df: DataFrame, by: list[str], ok: str, score: str | None = None) -> DataFrame:
    """Rows, compliant rows, rate (1 if there is none) and mean score per group."""
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(F.col(ok)).alias("n_compliant")]
    if score:
        aggs.append(F.round(F.coalesce(F.avg(score), F.lit(0.0)), 9).alias("mean_score"))
    g = df.groupBy(*by).agg(*aggs)
    return g.withColumn("rate", F.round(S.safe_ratio(F.col("n_compliant"), F.col("n"), 1.0), 6))


def most_common(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent values, ties by value."""
    g = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("n"), column).limit(n)


def severity_profile(df: DataFrame, by: list[str], severity: str = "severity") -> DataFrame:
    """Counts per severity, weighted score, the highest severity present and the one whose count reaches its step."""
    counts = [F.count_if(F.col(severity) == s).alias(f"n_{s}") for s in S.SEVERITIES]
    g = df.groupBy(*by).agg(*counts)
    n = {s: F.col(f"n_{s}") for s in S.SEVERITIES}
    weighted = sum(n[s] * w for s, w in S.WEIGHT.items())
    highest, reached = F.lit("low"), F.lit("none")
    for s in S.SEVERITIES:
        highest = F.when(n[s] > 0, F.lit(s)).otherwise(highest)
        reached = F.when(n[s] >= S.LADDER[s], F.lit(s)).otherwise(reached)
    return g.withColumns({"weighted": weighted, "highest": highest, "reached": reached})


def penalty_score(df: DataFrame, by: list[str], severity: str = "severity") -> DataFrame:
    """1 - min(1, sum of penalties), rounded."""
    p = F.sum(S.scale(F.col(severity), S.PENALTY, 0.0))
    return df.groupBy(*by).agg(F.round(1 - F.least(F.lit(1.0), p), 6).alias("score"))


def share_of_total(df: DataFrame, column: str) -> DataFrame:
    """Counts per value with share and cumulative share, most frequent first (ties by value).

    The window runs over one row per value, not over the rows counted.
    """
    g = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    running = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), column).rowsBetween(Window.unboundedPreceding, 0))
    return g.select(column, "n", F.round(F.col("n") / total, 6).alias("share"), F.round(running / total, 6).alias("cumulative"))


def confusion(df: DataFrame, by: list[str], predicted: Column, actual: Column) -> DataFrame:
    """Counts of the four outcomes and precision, recall, F1, accuracy (0 where undefined)."""
    g = df.groupBy(*by).agg(
        F.count_if(predicted & actual).alias("tp"),
        F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"),
        F.count_if(~predicted & ~actual).alias("tn"),
    )
    return with_rates(g)


def with_rates(g: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy from tp, fp, fn, tn."""
    p, r = S.safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), S.safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return g.withColumns({
        "precision": F.round(p, 6),
        "recall": F.round(r, 6),
        "f1": F.round(S.safe_ratio(2 * p * r, p + r), 6),
        "accuracy": F.round(S.safe_ratio(F.col("tp") + F.col("tn"), total), 6),
    })


def percentiles(df: DataFrame, by: list[str], value: str, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Mean and exact percentiles (linear between neighbours) per group."""
    aggs = [F.round(F.percentile(value, p), 9).alias(f"p{round(p * 100)}") for p in at]
    return df.groupBy(*by).agg(F.round(F.avg(value), 9).alias("mean"), *aggs)


def conflicts(df: DataFrame, key: str, items: str) -> DataFrame:
    """Keys whose array column names more than one distinct item over all their rows."""
    g = df.select(key, F.explode(items).alias("item")).groupBy(key).agg(F.count_distinct("item").alias("n_items"))
    return g.where(F.col("n_items") > 1)


def best_by(df: DataFrame, key: str, pick: str, order: list[Column]) -> DataFrame:
    """``pick`` of each key's first row in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, pick)
