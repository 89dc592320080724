"""Streaming twins of the event operators.

Streams come from folders of files or any source with the same columns.  Every
stateful operator has a watermark or a timeout, so its state is bounded by time
and by the number of active keys, not by the stream's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def read_folder(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 16) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def read_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A stream of JSON lines; unreadable lines give null columns."""
    return spark.readStream.schema(schema).json(path)


def windowed_counts(events: DataFrame, time: str, by: list[str], size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per window and key; events later than ``late`` are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, time: str, key: str, gap: str = "60 seconds", late: str = "1 day") -> DataFrame:
    """Sessions of each key."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))


def without_repeats(events: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Events without repeats of an id within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


#: Violations of a severity after which an alert is raised.
THRESHOLDS = {"critical": 1, "high": 3, "medium": 10}


def alerts(violations: DataFrame, thresholds: dict[str, int] = THRESHOLDS) -> DataFrame:
    """Alerts of (severity, id) rows: a counter a severity that fires at its threshold and starts anew.

    Result: (severity, alert_no, n).  A surplus within one batch counts on.
    State: two integers for each severity of ``thresholds``, so it needs no timeout.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, fired = state.get if state.exists else (0, 0)
        limit = thresholds[key[0]]
        count += sum(len(f) for f in frames)
        due = count // limit
        state.update((count - due * limit, fired + due))
        if due:
            yield pd.DataFrame({"severity": key[0], "alert_no": range(fired + 1, fired + due + 1), "n": limit})

    known = violations.where(F.col("severity").isin(*thresholds))
    return known.groupBy("severity").applyInPandasWithState(step, "severity string, alert_no long, n long", "count long, fired long", "append", GroupStateTimeout.NoTimeout)


def running_words(chunks: DataFrame, time: str, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Words so far of each streamed answer (request_id, delta_text, finish_reason, and its event time).

    ``finish_reason`` ends an answer.  State: one integer an open answer, dropped
    ``idle`` of event time after its last chunk.
    """
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (total,) = state.get if state.exists else (0,)
        ended, newest = False, 0
        for f in frames:
            total += int(f["delta_text"].fillna("").str.split().str.len().sum())
            ended |= bool(f["finish_reason"].notna().any())
            newest = max(newest, int(f[time].max().timestamp() * 1000))
        if ended:
            if state.exists:
                state.remove()
        else:
            state.update((total,))
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + ms)
        yield pd.DataFrame({"request_id": [key[0]], "n_words": [total], "ended": [ended]})

    marked = chunks.where(F.col(time).isNotNull()).withWatermark(time, late)
    return marked.groupBy("request_id").applyInPandasWithState(step, "request_id string, n_words long, ended boolean", "total long", "append", GroupStateTimeout.EventTimeTimeout)


def fan_out(stream: DataFrame, sinks: dict[str, tuple], checkpoint: str) -> StreamingQuery:
    """Write each batch to several sinks: name to (condition, function of a batch frame).

    The batch is kept while its sinks are written, so its source is read once.
    """

    def write(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            for condition, put in sinks.values():
                put(batch.where(condition))
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def append_to(path: str, partition: str | None = None) -> Callable[[DataFrame], None]:
    """A sink for :func:`fan_out` that appends Parquet files."""

    def put(df: DataFrame) -> None:
        w = df.write.mode("append")
        (w.partitionBy(partition) if partition else w).parquet(path)

    return put
