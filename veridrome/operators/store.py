"""Mutations of stored tables: upsert, insert-if-new, purge, and audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(stored: DataFrame, fresh: DataFrame, key: str, version: str) -> DataFrame:
    """Stored and fresh rows, of each key the one with the highest version (fresh wins ties)."""
    both = stored.withColumn("_s", F.lit(0)).unionByName(fresh.withColumn("_s", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(version), F.desc("_s"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_s")


def insert_new(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Fresh rows whose key is not stored, one a key."""
    return fresh.dropDuplicates([key]).join(stored.select(key).distinct(), key, "left_anti")


def purge(df: DataFrame, time: str, as_of: str, days: int) -> DataFrame:
    """Rows not older than ``days`` days at ``as_of``; rows without a time stay."""
    limit = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    return df.where(F.col(time).isNull() | (F.col(time) >= limit))


def verification_row(text: Column, rewritten: Column, ok: Column, score: Column) -> Column:
    """An audit row: hashes of both texts, whether they differ, verdict and score."""
    a, b = F.md5(text), F.md5(rewritten)
    return F.struct(a.alias("content_hash"), b.alias("output_hash"), (a != b).alias("was_modified"), ok.alias("compliance_result"), score.alias("compliance_score"))


def alert_rows(updates: DataFrame, key: str, epoch_s: Column) -> DataFrame:
    """Alerts with an id from key and second."""
    return updates.select(F.md5(F.concat_ws(":", F.col(key), epoch_s.cast("string"))).alias("alert_id"), F.col(key).alias("update_id"))


def write_log(df: DataFrame, path: str, time: str = "timestamp") -> None:
    """Append rows to a log partitioned by day, so that range queries and purges touch whole folders."""
    df.withColumn("event_date", F.to_date(time)).write.mode("append").partitionBy("event_date").parquet(path)


def export(df: DataFrame, path: str, form: str) -> None:
    """Export as JSON lines or as CSV (nested columns as JSON text); ValueError for other forms."""
    if form == "json":
        df.write.mode("overwrite").json(path)
    elif form == "csv":
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"unknown form of export: {form}")
