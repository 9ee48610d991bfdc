"""Equi-joins with a table of unique keys when a few keys hold much of the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of the frequent part: it is a top-k list, so its broadcast is bounded by this number.
FREQUENT_ROWS = 50_000


def lookup(df: DataFrame, table: DataFrame, key: str, weight: str, spread_by: str) -> DataFrame:
    """Left-join df with `table` (unique string `key`) on key.

    The keys with the largest `weight` come from a broadcast. Rows they served then get a key of their own, made from
    `spread_by`, that matches nothing and keeps them evenly spread, so the shuffle join sees only rare keys. `table` is
    read twice and should be stored.
    """
    names = [c for c in table.columns if c != key]
    frequent = table.orderBy(F.desc(weight), key).limit(FREQUENT_ROWS).withColumn("_seen", F.lit(True))
    head = df.join(F.broadcast(frequent), key, "left")
    alone = F.concat(F.lit("\u0001"), F.col(spread_by).cast("string"))
    keyed = head.withColumn("_key", F.when(F.col("_seen").isNull(), F.col(key)).otherwise(alone))
    rest = table.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in names])
    joined = keyed.join(rest, "_key", "left")
    return joined.select(*df.columns, *[F.coalesce(c, f"_{c}").alias(c) for c in names])
