"""Running sums and gapless numbers inside groups of any size.

A group is ordered by a 64-bit hash. Its rows fall into 256 x 256 cells by the hash's leading bits; sums by cell are
added up over at most 256 rows a window, and only the rows of one cell are sorted together. A group of a third of all
rows is therefore spread over 65,536 cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL = ("_coarse", "_fine")


def with_cells(df: DataFrame, order: str) -> DataFrame:
    coarse, fine = F.shiftrightunsigned(order, 56), F.shiftrightunsigned(order, 48).bitwiseAND(255)
    return df.withColumn("_coarse", coarse.cast("int")).withColumn("_fine", fine.cast("int"))


def cell_offsets(df: DataFrame, group: str, value: str) -> DataFrame:
    """For each cell of df (with_cells) the sum of value in the cells before it in its group. The group is never null."""
    fine = df.groupBy(group, *CELL).agg(F.sum(value).alias("_sum"))
    coarse = fine.groupBy(group, "_coarse").agg(F.sum("_sum").alias("_coarse_sum"))
    ahead = Window.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    before = F.coalesce(F.sum("_coarse_sum").over(ahead.partitionBy(group).orderBy("_coarse")), none)
    coarse = coarse.withColumn("_coarse_before", before)
    inside = F.coalesce(F.sum("_sum").over(ahead.partitionBy(group, "_coarse").orderBy("_fine")), none)
    fine = fine.withColumn("_fine_before", inside).join(coarse, [group, "_coarse"])
    return fine.select(group, *CELL, (F.col("_coarse_before") + F.col("_fine_before")).alias("_before"))


def running(df: DataFrame, offsets: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of value over the rows ahead in its group; offsets may bring further columns of each cell."""
    ahead = Window.partitionBy(group, *CELL).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(offsets, [group, *CELL])
    here = F.coalesce(F.sum(value).over(ahead), F.lit(0).cast("long"))
    return joined.withColumn(name, F.col("_before") + here).drop("_before", *CELL)
