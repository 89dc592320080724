"""Scans of the Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings sources updates "
    "content_events compliance_events audit_entries rule_tasks text_chunks eval_items doc_labels"
).split()


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Scan ``name`` of ``folder``; ``columns`` prunes the scan to these."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def register_views(spark: SparkSession, folder: str, names: list[str] | None = None) -> None:
    """Register the tables as temporary views for SQL."""
    for n in names or TABLES:
        table(spark, folder, n).createOrReplaceTempView(n)
