"""Labelled corpora: clean, stack, deduplicate, split, describe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import banks
from ..functions.hashing import draw

MAX_CLASSES = 1000


def fill_nulls(df: DataFrame, defaults: dict[str, str] = banks.JOB_NULLS) -> DataFrame:
    return df.na.fill({c: v for c, v in defaults.items() if c in df.columns})


def drop_null(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def union_corpora(*corpora: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), corpora)


def distinct_text(df: DataFrame, order: str, text: str = "text") -> DataFrame:
    """Drop rows whose text occurred before, in the order of a unique integer column.

    Copies are found on (sha256, smallest order): partial aggregation folds a hot text inside each map task, and only
    short keys travel. The texts themselves move once, in the semi-join on the unique column.
    """
    firsts = df.groupBy(F.sha2(F.col(text), 256).alias("_h")).agg(F.min(order).alias(order)).select(order)
    return df.join(firsts, order, "left_semi")


def random_split(df: DataFrame, id_col: str, seed: int = 42, test_percent: int = 20) -> DataFrame:
    """Add `split`: test for the ids whose hash falls into the first buckets of a hundred. No shuffle."""
    bucket = draw(seed, id_col) % 100
    return df.withColumn("split", F.when(bucket < test_percent, "test").otherwise("train"))


def stratified_split(
    df: DataFrame, id_col: str, label: str = "label", seed: int = 42, test_share: float = 0.2
) -> DataFrame:
    """Add `split`: in each class, the ceil(share * n) rows with the smallest (hash, id) are the test rows.

    No class is sorted as a whole. Hash values fall into 65,536 even buckets; counting buckets shows where each class
    is cut, and only the rows of that one bucket are ranked. The cut (one row a class) then becomes part of a plain
    row-wise predicate.
    """
    keyed = df.select(F.col(label).alias("_l"), F.col(id_col).alias("_id"), draw(seed, id_col).alias("_h"))
    keyed = keyed.withColumn("_b", F.shiftright("_h", 16))
    counts = keyed.groupBy("_l", "_b").agg(F.count("*").alias("_n"))
    by_label = Window.partitionBy("_l")
    running = by_label.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        counts.withColumn("_cum", F.sum("_n").over(running))
        .withColumn("_target", F.ceil(F.sum("_n").over(by_label) * F.lit(float(test_share))))
        .filter((F.col("_cum") >= F.col("_target")) & (F.col("_cum") - F.col("_n") < F.col("_target")))
        .select("_l", F.col("_b"), (F.col("_target") - F.col("_cum") + F.col("_n")).alias("_need"))
    )
    cuts = cut.limit(MAX_CLASSES + 1).collect()
    if not cuts:
        return df.withColumn("split", F.lit("train"))
    small = len(cuts) <= MAX_CLASSES
    if small:
        need = _by_class(F.col("_l"), [(r["_l"], F.struct(F.lit(r["_b"]).alias("b"), F.lit(r["_need"]).alias("k"))) for r in cuts])
        edge = keyed.withColumn("_c", need).filter(F.col("_b") == F.col("_c.b")).withColumn("_need", F.col("_c.k"))
    else:
        ends = cut.select(F.col("_l").alias("_cl"), F.col("_b").alias("_cb"), "_need")
        same = F.col("_l").eqNullSafe(F.col("_cl")) & (F.col("_b") == F.col("_cb"))
        edge = keyed.join(ends, same).drop("_cl", "_cb")
    rank = F.row_number().over(by_label.orderBy("_h", "_id"))
    last = edge.withColumn("_r", rank).filter(F.col("_r") == F.col("_need")).select("_l", "_h", "_id")
    h = draw(seed, id_col)

    def inside(edge_h, edge_id):
        return (h < edge_h) | ((h == edge_h) & (F.col(id_col) <= edge_id))

    if small:
        ends = last.collect()
        ok = _by_class(F.col(label), [(r["_l"], inside(F.lit(r["_h"]), F.lit(r["_id"]))) for r in ends])
        return df.withColumn("split", F.when(ok, "test").otherwise("train"))
    joined = df.join(last, F.col(label).eqNullSafe(F.col("_l")), "left")
    ok = inside(F.col("_h"), F.col("_id"))
    return joined.withColumn("split", F.when(ok, "test").otherwise("train")).drop("_l", "_h", "_id")


def _by_class(col, pairs):
    out = None
    for value, result in pairs:
        test = col.isNull() if value is None else col == F.lit(value)
        out = F.when(test, result) if out is None else out.when(test, result)
    return out


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def null_counts(df: DataFrame) -> DataFrame:
    """One row a column: name, nulls, rows and columns of the table, all from a single pass."""
    one = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in df.columns])
    return one.select("_rows", F.explode(pairs).alias("p")).select(
        "p.column_name", "p.n_null", F.col("_rows").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns")
    )


def length_by_class(df: DataFrame, label: str, text: str = "text") -> DataFrame:
    return df.groupBy(label).agg(F.round(F.avg(F.length(text)), 6).alias("mean_length"))


def top_words(df: DataFrame, label: str = "label", text: str = "text", k: int = 20) -> DataFrame:
    """The k most frequent words of each class; the rank limit is applied before the shuffle by class."""
    words = df.select(label, F.explode(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")).alias("word"))
    counts = words.groupBy(label, "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.desc("n"), "word"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def longest(df: DataFrame, id_col: str, text: str = "text", k: int = 5) -> DataFrame:
    return df.withColumn("message_length", F.length(text)).orderBy(F.desc("message_length"), id_col).limit(k)


def sample_rows(df: DataFrame, id_col: str, k: int = 10, seed: int = 42) -> DataFrame:
    """k rows in hash order: a top-k, not a full sort."""
    return df.orderBy(draw(seed, id_col), id_col).limit(k)


def shuffled(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """All rows in hash order: a range-partitioned sort."""
    return df.orderBy(draw(seed, id_col), id_col)
