"""Components of tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adsift.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that a link (a, b) joins with another: one name for each component.

    In each round every node takes that one of its neighbours and itself which comes first by a hash of the round; links
    are then between the nodes so taken. A link between a node and its choice keeps what belongs together connected, and
    the hash makes the number of nodes fall by a constant factor whatever the shape. Hot nodes take part as partial
    minima and as the wide side of joins that Spark splits; every round's tables are stored.
    """
    graph = materialise(edges.select("a", "b").where("a <> b").distinct(), "links")
    steps: list[DataFrame] = []
    while not graph.isEmpty():
        first = lambda c, salt=len(steps): F.struct(F.xxhash64(c, F.lit(salt)).alias("h"), F.col(c).alias("node"))
        ends = graph.select("a", first("b").alias("x")).unionByName(graph.select(F.col("b").alias("a"), first("a").alias("x")))
        took = ends.groupBy("a").agg(F.min("x").alias("x")).select("a", F.least("x", first("a"))["node"].alias("to"))
        took = materialise(took, "choices")
        steps.append(took)
        for end in ("a", "b"):
            names = took.select(F.col("a").alias(end), "to")
            graph = graph.join(names, end).drop(end).withColumnRenamed("to", end)
        graph = graph.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        graph = materialise(graph.distinct(), "links")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    found = steps[0].select(F.col("a").alias("node"), F.col("to").alias("component"))
    for step in steps[1:]:
        moved = found.join(step.withColumnRenamed("a", "component"), "component", "left")
        found = materialise(moved.select("node", F.coalesce("to", "component").alias("component")), "components")
    return found
