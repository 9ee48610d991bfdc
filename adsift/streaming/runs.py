"""Start streams over tables and drain them into tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch

DELAY_SECONDS = 3600.0


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over a parquet table (a folder or one file), with the table's own schema.

    The path is given as a pattern, because a plain path of a single file is not accepted by the stream.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def drain(
    stream: DataFrame, name: str, out: str | None = None, checkpoint: str | None = None, progress: list | None = None,
) -> DataFrame:
    """Append everything available to a parquet table and return it; `progress` gets the run's progress reports."""
    spark = stream.sparkSession
    out = out or scratch(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint or scratch(spark, f"{name}-checkpoint"))
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    if progress is not None:
        progress.extend(json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress)
    return spark.read.schema(stream.schema).parquet(out)


def drain_batches(
    stream: DataFrame, name: str, step: Callable[[DataFrame, int], None], mode: str = "append",
    checkpoint: str | None = None, every: str | None = None,
) -> None:
    """Hand everything available to `step` batch by batch; with `every`, at that interval until all is processed."""
    spark = stream.sparkSession
    writer = stream.writeStream.foreachBatch(step).outputMode(mode)
    writer = writer.option("checkpointLocation", checkpoint or scratch(spark, f"{name}-checkpoint"))
    if every is None:
        writer.trigger(availableNow=True).start().awaitTermination()
        return
    query = writer.trigger(processingTime=every).start()
    query.processAllAvailable()
    query.stop()
