"""Running totals over a global order without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def range_bucket(value: Column, bounds: list[float]) -> Column:
    """How many bounds lie strictly below the value: a binary search over a literal array."""
    if not bounds:
        return F.lit(0)
    edges = F.lit([float(b) for b in bounds])
    steps = []
    step = 1 << (len(bounds).bit_length() - 1)
    while step:
        steps.append(step)
        step >>= 1
    walk = F.array(*[F.lit(s) for s in steps])
    return F.aggregate(
        walk,
        F.lit(0),
        lambda pos, s: F.when(F.coalesce(F.get(edges, pos + s - 1) < value, F.lit(False)), pos + s).otherwise(pos),
    )


def running_totals(df: DataFrame, order: str, sums: list[str], ascending: bool = True) -> DataFrame:
    """Add `<c>_before`: the sum of c over all rows with a smaller (or larger) order value, and `<c>_total`.

    df must hold one row for each order value. Rows are cut into ranges at quantiles, each range is summed in its own
    task, and only the range totals (at most BUCKETS rows) meet in one place. The cuts are literals, so a task that
    runs again puts its rows into the same ranges; how even they are affects speed, never the result.
    """
    probs = [i / BUCKETS for i in range(1, BUCKETS)]
    found = df.select(F.col(order).cast("double").alias(order)).approxQuantile(order, probs, 1.0 / (4 * BUCKETS))
    bounds = sorted(set(found))
    ranged = df.withColumn("_range", range_bucket(F.col(order).cast("double"), bounds))

    def by(name):
        return F.asc(name) if ascending else F.desc(name)

    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(c) for c in sums])
    before = Window.orderBy(by("_range")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}_offset") for c in sums],
        *[F.sum(c).over(Window.partitionBy()).alias(f"{c}_total") for c in sums],
    )
    inside = Window.partitionBy("_range").orderBy(by(order)).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_{c}_inside") for c in sums])
    out = out.join(F.broadcast(offsets), "_range")
    for c in sums:
        out = out.withColumn(f"{c}_before", F.col(f"_{c}_offset") + F.col(f"_{c}_inside"))
    return out.drop("_range", *[f"_{c}_offset" for c in sums], *[f"_{c}_inside" for c in sums])
