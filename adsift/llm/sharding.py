"""Sharding by rendezvous hashing, with DataFrame expressions only.

Each record key draws one number for every shard; the shard with the smallest exponential draw over its weight wins. A
further shard can only win keys for itself, so growing from n to n + 1 shards moves about one key in n + 1 and moves none
between old shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adsift.llm import running
from adsift.session import materialise

SEED = 20_241
ROW_BYTES = 16


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key; shard k has weights[k] (not below 0, some above 0). Null keys count as one key."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be below 0, and one must be above 0")
    text = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))
    draws = []
    for k, weight in enumerate(weights):
        if weight:
            u = (F.shiftrightunsigned(F.xxhash64(text, F.lit(SEED), F.lit(k)), 11).cast("double") + 0.5) * 2.0**-53
            draws.append(F.struct((-F.log(u) / float(weight)).alias("draw"), F.lit(k).alias("shard")))
    return F.array_min(F.array(*draws))["shard"]


def assign(docs: DataFrame, shards: int = 40, weights: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The shard depends on doc_id and the shard count alone (rows of equal id, null among them, go together); slots number
    the rows of a shard without gaps, ordered by a hash of id and text, and reruns agree (identical rows may swap).
    Null texts have no bytes. Empty tables give empty results; other columns are not read.
    """
    weights = list(weights or [1.0] * shards)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(id_col), text).alias("_order"),
        shard_of(F.col(id_col), weights).alias("shard"),
        shard_of(F.col(id_col), [*weights, sum(weights) / len(weights)]).alias("grown_shard"),
    )
    rows = materialise(rows, "sharded").withColumn("_one", F.lit(1).cast("long"))
    cells = running.with_cells(rows, "_order")
    offsets = running.cell_offsets(cells, "shard", "_one")
    placed = running.running(cells, offsets, "shard", ["_order", "doc_id", "text_crc32"], "_one", "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 40, weights: Sequence[float] | None = None, id_col: str = "doc_id") -> None:
    """Write docs as one folder of Parquet files a shard (column shard_no)."""
    placed = docs.withColumn("shard_no", shard_of(F.col(id_col), list(weights or [1.0] * shards)))
    placed.write.partitionBy("shard_no").parquet(path)
