"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType as _MAPS

#: Rows and bytes up to which a side may be sent to every executor.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 48 << 20


def broadcast_if_small(df: DataFrame, row_bytes: int = 64, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Mark ``df`` for broadcast if a count proves that it is small.

    Runs one job that counts at most ``limit + 1`` rows.  ``row_bytes`` is a
    bound of a row's size that the caller knows from the column types.
    """
    limit = min(rows, BROADCAST_BYTES // max(1, row_bytes))
    small = df.limit(limit + 1).count() <= limit
    return (F.broadcast(df) if small else df), small


def salted_join(
    many: DataFrame,
    few: DataFrame,
    keys: list[str],
    how: str = "inner",
    salt: int | None = None,
    spread: Column | None = None,
    condition: Column | None = None,
) -> DataFrame:
    """Join a table whose keys may be very skewed with one that has few rows a key.

    Every key of ``many`` is split over ``salt`` buckets and each row of ``few``
    is repeated once a bucket, so a key that holds a third of all rows is
    spread over ``salt`` tasks (default: a third of the cluster's cores, at
    least 8, so such a key keeps no task longer than its fair share).  Every row keeps exactly one bucket, so inner,
    left, left_semi and left_anti joins give the same rows as without salt.
    ``spread`` picks the bucket (default: the hash of the whole row).  The key
    columns of ``few`` are dropped from the result.  Null keys match nothing.
    """
    salt = salt or max(8, -(-many.sparkSession.sparkContext.defaultParallelism // 3))
    spread = F.xxhash64(*[many[c] for c in many.columns if not isinstance(many.schema[c].dataType, _MAPS)]) if spread is None else spread
    left = many.withColumn("_salt", F.pmod(spread, F.lit(salt)).cast("int"))
    right = few.withColumnsRenamed({k: f"_few_{k}" for k in keys}).withColumn(
        "_few_salt", F.explode(F.array(*[F.lit(i) for i in range(salt)]))
    )
    on = F.col("_salt") == F.col("_few_salt")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_few_{k}"))
    if condition is not None:
        on = on & condition
    out = left.join(right, on, how)
    return out.drop("_salt", "_few_salt", *[f"_few_{k}" for k in keys])


def spread(df: DataFrame) -> DataFrame:
    """Repartition a scan that has fewer partitions than the cluster has cores.

    For passes that are heavy per row.  The decision takes the size of the scanned
    files from the plan's statistics, without a job: from ``openCostInBytes`` a
    core on, scans make at least one partition a core, and from half of that on
    nearly so many that shuffling would cost more than it gains.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    most = spark._jsparkSession.sessionState().conf().filesOpenCostInBytes()
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return df if 2 * size >= cores * most else df.repartition(cores)
