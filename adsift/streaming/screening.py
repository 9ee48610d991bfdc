"""Streams of texts: the batch screening expressions on a readStream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.screen import alerts, screen
from ..session import exists, scratch
from .runs import DELAY_SECONDS, drain


def screened(stream: DataFrame, text: str = "text", url: str = "url", p: str = "p") -> DataFrame:
    """Stateless: one projection a row."""
    return screen(stream, text, url, p)


def alerting(stream: DataFrame, forced: Column | bool = False) -> DataFrame:
    return alerts(screened(stream), forced=forced)


def debounced(
    stream: DataFrame, key: str, ts: str, uid: str, gap_seconds: float, delay: float = DELAY_SECONDS,
    out: str | None = None, checkpoint: str | None = None, finish: bool = True,
) -> DataFrame:
    """The last event of each burst (see burst_ends): session windows that come out when the watermark has passed them.

    Events may arrive out of order within the delay; those of bursts that have come out already are dropped and counted
    (`<out>/late`: a number for each run, of what a task's partial sessions held). Events without a time belong to no burst. With
    `finish`, the result also holds the bursts that are still open, read from the state; the stream may go on nevertheless.
    """
    spark = stream.sparkSession
    out, checkpoint = out or scratch(spark, "debounced"), checkpoint or scratch(spark, "debounced-checkpoint")
    events = stream.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.col(uid).alias("_uid"), F.col(ts).cast("timestamp").alias("_t"))
    # A window is closed on the left only: a microsecond more lets a gap equal to the limit merge.
    window = F.session_window("_t", f"{int(gap_seconds * 1_000_000) + 1} microseconds")
    last = F.max(F.struct("_t", "_uid", "_ts")).alias("last")
    marked = events.withWatermark("_t", f"{int(delay * 1000)} milliseconds")
    sessions = marked.groupBy("_key", window).agg(last).select("_key", "last")
    progress: list = []
    done = drain(sessions, "debounced", f"{out}/decided", checkpoint, progress)
    late = sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"])
    spark.createDataFrame([(late,)], "late long").coalesce(1).write.mode("append").parquet(f"{out}/late")
    if finish and exists(spark, f"{checkpoint}/state"):
        state = spark.read.format("statestore").option("path", checkpoint).load()
        # A session's state is its key, its window and the buffer of the one aggregate.
        names = state.schema["value"].dataType.names
        still = state.select(F.col("value")[names[0]].alias("_key"), F.col("value")[names[-1]].alias("last"))
        done = done.unionByName(still)
    return done.select(F.col("_key").alias(key), F.col("last._uid").alias(uid), F.col("last._ts").alias(ts))
