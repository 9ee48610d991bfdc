"""Debounce: the last event of each burst of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def burst_ends(df: DataFrame, key: str, ts: str, uid: str, gap_seconds: float) -> DataFrame:
    """(key, uid, ts) of events that no event of the same key follows within the gap; a gap equal to the limit merges.

    Time is cut into cells of one gap. Only the last event of a cell can end a burst, and it does so unless the next
    cell starts within the gap. Cells are folded by partial aggregation and matched by equality on (key, cell), so a
    busy key spreads over its cells.
    """
    span = int(gap_seconds * 1_000_000)
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    cells = (
        df.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.col(uid).alias("_uid"), t.alias("_t"))
        .withColumn("_cell", F.floor(F.col("_t") / F.lit(span)).cast("bigint"))
        .groupBy("_key", "_cell")
        .agg(F.max(F.struct("_t", "_uid", "_ts")).alias("_last"), F.min("_t").alias("_first"))
    )
    following = cells.select(
        F.col("_key").alias("_k2"), (F.col("_cell") - 1).alias("_c2"), F.col("_first").alias("_next")
    )
    joined = cells.join(following, F.col("_key").eqNullSafe(F.col("_k2")) & (F.col("_cell") == F.col("_c2")), "left")
    ends = joined.filter(F.col("_next").isNull() | (F.col("_next") - F.col("_last._t") > span))
    return ends.select(
        F.col("_key").alias(key), F.col("_last._uid").alias(uid), F.col("_last._ts").alias(ts)
    )
