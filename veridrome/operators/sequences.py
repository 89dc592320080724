"""Order-dependent operators over events: sessions, runs, sequences, trends.

Every window has a key.  A key may hold a third of all rows; operators that can
first cut the rows to counts do so, and those that need the rows in order sort
them within the key, which spills but does not collect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sessions(df: DataFrame, key: str, time: str, order: str, gap_s: int) -> DataFrame:
    """Number the sessions of each key; a gap of more than ``gap_s`` seconds starts the next."""
    w = Window.partitionBy(key).orderBy(time, order)
    new = F.when(F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp")) > gap_s * 1_000_000, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def session_summary(df: DataFrame, key: str, time: str, order: str, gap_s: int, least: int = 2) -> DataFrame:
    """Sessions with ``least`` rows or more: begin, end, size."""
    g = sessions(df, key, time, order, gap_s).groupBy(key, "session")
    return g.agg(F.min(time).alias("first_at"), F.max(time).alias("last_at"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def runs(df: DataFrame, key: str, value: str, time: str, order: str) -> DataFrame:
    """Runs of equal neighbouring values: (key, value, run, n)."""
    w = Window.partitionBy(key).orderBy(time, order)
    change = F.when(F.col(value) == F.lag(value).over(w), 0).otherwise(1)
    numbered = df.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, value, "run").agg(F.count(F.lit(1)).alias("n"))


def ngrams(df: DataFrame, key: str, value: str, time: str, order: str, n: int, least: int = 3) -> DataFrame:
    """Runs of ``n`` neighbouring values in time order that occur ``least`` times or more."""
    w = Window.partitionBy(key).orderBy(time, order)
    steps = [F.col(value), *[F.lead(value, k).over(w) for k in range(1, n)]]
    rows = df.select(F.array(*steps).alias("s")).where(F.forall("s", lambda x: x.isNotNull()))
    return rows.groupBy(F.array_join("s", ">").alias("sequence")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def last_rows(df: DataFrame, key: str, n: int, order: list[Column]) -> DataFrame:
    """The last ``n`` rows of each key (the order lists the newest first)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def islands(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Maximal ranges of consecutive integers per group: (first, last, n)."""
    w = Window.partitionBy(*by).orderBy(value) if by else Window.partitionBy(F.lit(0)).orderBy(value)
    marked = df.select(*by, value).distinct().withColumn("_g", F.col(value) - F.row_number().over(w))
    return marked.groupBy(*by, "_g").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count(F.lit(1)).alias("n")).drop("_g")


def histogram(df: DataFrame, part: Column, name: str) -> DataFrame:
    """Rows per part of their time."""
    return df.groupBy(part.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def peaks(df: DataFrame, part: Column, name: str, factor: float = 1.5, least: int = 3) -> DataFrame:
    """Parts whose count reaches ``factor`` times the mean of the parts that occur, and ``least``."""
    h = histogram(df, part, name)
    mean = F.avg("n").over(Window.partitionBy(F.lit(0)))
    return h.withColumn("_m", mean).where((F.col("n") >= factor * F.col("_m")) & (F.col("n") >= least)).drop("_m")


def frequency_change(df: DataFrame, key: str, time: str, as_of: str, days: tuple[int, ...] = (1, 7, 30, 90, 365)) -> DataFrame:
    """Rows a day over the last 1, 7, 30, ... days before ``as_of``, per key."""
    end = F.lit(as_of).cast("timestamp")
    aggs = [
        F.round(F.count_if((F.col(time) > end - F.expr(f"INTERVAL {n} DAYS")) & (F.col(time) <= end)) / float(n), 6).alias(f"per_day_{n}") for n in days
    ]
    return df.groupBy(key).agg(*aggs)


def moving(df: DataFrame, key: str, order: list[str], value: Column, name: str, rows: int) -> DataFrame:
    """Mean of a value over the last ``rows`` rows of its key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(rows - 1), 0)
    return df.withColumn(name, F.round(F.avg(value).over(w), 6))


def running_alerts(df: DataFrame, key: str, order: list[str], threshold: int) -> DataFrame:
    """Rows at which a key's running count reaches a multiple of the threshold (a counter that starts anew)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = df.withColumn("running", F.count(F.lit(1)).over(w))
    return n.where(F.col("running") % threshold == 0).withColumn("alert_no", (F.col("running") / threshold).cast("long"))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Each left row with the newest right value at or before its time (null if none).

    One union sorted within the key instead of a join of all pairs.  Of right
    rows at one time the greatest value counts; right rows at the left's time
    count as before it.
    """
    # a shared struct type, so both sides meet in one sort
    r = right.groupBy(key, time).agg(F.max(value).alias("_v")).select(key, time, "_v", F.lit(0).alias("_side"), F.lit(None).alias("_row"))
    packed = F.struct(*[F.col(c) for c in left.columns])
    lhs = left.select(key, time, F.lit(None).alias("_v"), F.lit(1).alias("_side"), packed.alias("_row"))
    w = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(lhs).withColumn("as_of_value", F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").select("_row.*", "as_of_value")
