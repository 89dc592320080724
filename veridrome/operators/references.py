"""References to records that do not exist (problem 2).

Distinct non-null foreign keys are anti-joined with the periods in which the
parent key existed; the remaining pairs are joined back to the child rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridrome.functions.keys import id_key
from veridrome.operators.skew import salted_join


def missing_keys(child: DataFrame, parent: DataFrame, salt: int = 8) -> DataFrame:
    """The (key, at) pairs of ``child`` for which no period of ``parent`` holds.

    ``child`` has ``key`` and ``at``; ``parent`` has ``key``, ``since`` and
    ``until`` (null: still there).  Null keys refer to nothing and give no pair.
    A null ``at`` or a null ``since`` lies in no period.  Result: distinct
    (key, at).  A key with a third of all rows is first cut to its distinct
    times and then spread over ``salt`` tasks.
    """
    pairs = child.where(F.col("key").isNotNull()).select("key", "at").distinct()
    periods = parent.where(F.col("key").isNotNull() & F.col("since").isNotNull()).select("key", "since", "until").distinct()
    # a null time stays in: it matches no period, so the anti-join keeps it
    holds = (F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("until") > F.col("at")))
    return salted_join(pairs, periods, ["key"], "left_anti", salt, F.xxhash64("at"), holds)


def orphans(child: DataFrame, parent: DataFrame, salt: int = 8) -> DataFrame:
    """The rows of ``child`` whose key did not exist at their time.

    Takes the columns of :func:`missing_keys`; ``child`` may have more columns.
    All its rows, repeats included, are kept.
    """
    gone = missing_keys(child, parent, salt).select("key", F.coalesce("at", F.lit(0).cast("timestamp")).alias("_at"), F.col("at").isNull().alias("_none"))
    rows = child.where(F.col("key").isNotNull())
    rows = rows.withColumns({"_at": F.coalesce("at", F.lit(0).cast("timestamp")), "_none": F.col("at").isNull()})
    return rows.join(gone, ["key", "_at", "_none"], "left_semi").drop("_at", "_none")


def orphan_report(found: DataFrame, record: str, table: Column, period: Column) -> DataFrame:
    """Orphan records per table and period: (table_name, period, n_orphans)."""
    slim = found.select(table.alias("table_name"), period.alias("period"), F.col(record).alias("_r")).distinct()
    return slim.groupBy("table_name", "period").agg(F.count(F.lit(1)).alias("n_orphans"))


def update_references(updates: DataFrame) -> DataFrame:
    """Updates with a source as child rows: (id, key, at)."""
    return updates.where(F.col("source_id").isNotNull()).select("id", id_key(F.col("source_id")).alias("key"), F.col("found_date").alias("at"))


def source_periods(sources: DataFrame) -> DataFrame:
    """Sources as parent periods: (key, since, until)."""
    return sources.select(id_key(F.col("id")).alias("key"), F.col("added_at").alias("since"), F.col("removed_at").alias("until"))
