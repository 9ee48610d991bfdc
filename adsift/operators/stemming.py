"""Stemming of a corpus through its vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stem import stem
from ..functions.text import positions
from ..session import materialise
from .lookup import lookup


def _words(text: str):
    return F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")


def vocabulary_stems(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n, stem) for each distinct word of the corpus and the number of its occurrences."""
    counts = df.select(F.explode(_words(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.withColumn("stem", stem(F.col("word")))


def stem_text(df: DataFrame, id_col: str, text: str = "text", out: str = "text") -> DataFrame:
    """Replace each word by its stem.

    Every distinct word is stemmed once and stored. Texts are turned into (word, places) inside their row, so a word
    costs one join row a text, frequent words are served by a broadcast, and the order comes back from the places.
    """
    stems = materialise(vocabulary_stems(df, text), "stems")
    spots = df.select(id_col, F.explode(positions(_words(text))).alias("p")).select(id_col, "p.word", "p.at")
    found = lookup(spots, stems, "word", "n", id_col)
    placed = found.select(
        id_col, F.transform("at", lambda a: F.struct(a.alias("at"), F.col("stem").alias("stem"))).alias("spots")
    )
    whole = placed.groupBy(id_col).agg(F.sort_array(F.flatten(F.collect_list("spots"))).alias("spots"))
    joined = whole.select(id_col, F.array_join(F.transform("spots", lambda s: s["stem"]), " ").alias("_stemmed"))
    return (
        df.join(joined, id_col, "left")
        .withColumn(out, F.when(F.col(text).isNotNull(), F.coalesce("_stemmed", F.lit(""))))
        .drop("_stemmed")
    )
