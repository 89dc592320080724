"""Ranking of candidates: merging of hit lists, boosts, diversity.  Budgets: ``operators/selection.py``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_hits(a: DataFrame, b: DataFrame, key: str, alpha: float = 0.7) -> DataFrame:
    """alpha times the score of ``a`` plus the rest times that of ``b``; absent hits score 0."""
    j = a.select(key, F.col("score").alias("_a")).join(b.select(key, F.col("score").alias("_b")), key, "full_outer")
    return j.select(key, F.round(alpha * F.coalesce("_a", F.lit(0.0)) + (1 - alpha) * F.coalesce("_b", F.lit(0.0)), 6).alias("score"))


def rerank(df: DataFrame, text: str, context: list[str], step: float = 0.05) -> DataFrame:
    """Scores raised by ``step`` for each context word a text contains."""
    n = sum(F.when(F.col(text).contains(w), 1).otherwise(0) for w in context)
    return df.withColumn("score", F.round(F.col("score") * (1 + step * n), 6))


def first_per_group(df: DataFrame, group: str, key: str) -> DataFrame:
    """The best-scored row of each group, ties by key."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), key)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def mix(df: DataFrame, source: str, key: str, quotas: dict[str, int]) -> DataFrame:
    """A fixed number of rows a source, those with the smallest hashes (a sampling operator)."""
    w = Window.partitionBy(source).orderBy(F.md5(F.col(key).cast("string")), key)
    quota = F.lit(0)
    for s, n in quotas.items():
        quota = F.when(F.col(source) == s, n).otherwise(quota)
    picked = df.where(F.col(source).isin(*quotas)).withColumn("_r", F.row_number().over(w))
    return picked.where(F.col("_r") <= quota).drop("_r")


def normalised_weights(df: DataFrame, group: str) -> DataFrame:
    """Share of each group's rows."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("weight", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))
