"""Term features: counts, vocabulary, TF-IDF inside the row, the same in long form, and vectors."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.text import literal_rows
from ..session import ship
from .lookup import lookup

ship(__name__)

# A vocabulary is a top-k list, so what a plan holds of it is bounded by this many rows.
MAX_VOCABULARY = 50_000
# The column of weights inside a row, and its type.
WEIGHTS, KIND = "_weights", "array<struct<idx:int,weight:double>>"


def term_counts(df: DataFrame, id_col: str, terms: Column) -> DataFrame:
    """(id, term, n), counted inside each row: no shuffle."""
    return df.select(id_col, F.explode(tx.bag(terms)).alias("b")).select(id_col, "b.term", "b.n")


def doc_freq(df: DataFrame, terms: Column) -> DataFrame:
    """Documents and occurrences of each term: one shuffle of partial counts."""
    counts = df.select(F.explode(tx.bag(terms)).alias("b")).select("b.term", "b.n")
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))


def with_doc_freq(counts: DataFrame, freq: DataFrame, id_col: str) -> DataFrame:
    """Join (id, term, n) with a stored table (term, df, cf) for a vocabulary of any size."""
    return lookup(counts, freq, "term", "df", id_col)


def vocabulary(df: DataFrame, terms: Column, max_features: int) -> DataFrame:
    """The max_features most frequent terms as (idx, term, df, cf, idf); idx follows term order.

    Ties are cut by term. The number of documents comes from the same table; idf = ln((1+n)/(1+df)) + 1.
    """
    if max_features > MAX_VOCABULARY:
        raise ValueError(f"max_features is limited to {MAX_VOCABULARY}: the vocabulary is part of the plan")
    top = doc_freq(df, terms).orderBy(F.desc("cf"), "term").limit(max_features)
    n_docs = df.agg(F.count("*").alias("n")).scalar()
    idf = F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1
    # This window sees the top-k rows only.
    index = F.row_number().over(Window.orderBy("term")) - 1
    return top.withColumn("n_docs", n_docs).withColumn("idf", idf).withColumn("idx", index).drop("n_docs")


def weighted(df: DataFrame, terms: Column, vocab: DataFrame, sublinear: bool = False, counts: bool = False, out: str = WEIGHTS) -> DataFrame:
    """df with the text's vocabulary terms as array<struct<idx, weight>>, sorted by idx: tf * idf scaled to length one, or counts.

    A fitted vocabulary counts the terms of a row in one hash table; idf and length are arithmetic on the row's array. There is no
    exchange, so it serves streams as well. The vocabulary has at most MAX_VOCABULARY rows and is part of the plan.
    """
    entries = vocab.select("idx", "term", "idf").orderBy("idx").collect()
    if not entries:
        return df.withColumn(out, F.array().cast(KIND))
    counter = CountVectorizerModel.from_vocabulary([r.term for r in entries], "_terms", "_counted")
    none = F.array().cast("array<string>")
    counted = counter.transform(df.withColumn("_terms", F.coalesce(terms, none))).withColumn("_counted", F.unwrap_udt("_counted"))
    found, n = F.col("_counted.indices"), F.col("_counted.values")
    if counts:
        pairs = F.zip_with(found, n, lambda i, n: F.struct(i.alias("idx"), n.alias("weight")))
        return counted.withColumn(out, pairs.cast(KIND)).drop("_terms", "_counted")
    idf = literal_rows([r.idf for r in entries], "array<double>")
    raw = F.zip_with(found, n, lambda i, n: F.struct(i.alias("idx"), ((1 + F.log(n) if sublinear else n) * F.get(idf, i)).alias("raw")))

    def scaled(pairs: Column) -> Column:
        length = F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + p["raw"] * p["raw"]))
        return tx.bound(length, lambda norm: F.transform(pairs, lambda p: F.struct(p["idx"].alias("idx"), (p["raw"] / norm).alias("weight"))))

    return counted.withColumn(out, tx.bound(raw, scaled).cast(KIND)).drop("_terms", "_counted")


def _long(df: DataFrame, id_col: str, vocab: DataFrame) -> DataFrame:
    names = tx.literal([r.term for r in vocab.select("idx", "term").orderBy("idx").collect()])
    flat = df.select(id_col, F.explode(WEIGHTS).alias("w"))
    return flat.select(id_col, "w.idx", F.get(names, F.col("w.idx")).alias("term"), "w.weight")


def count_vectors(df: DataFrame, id_col: str, terms: Column, vocab: DataFrame) -> DataFrame:
    """(id, idx, term, weight) with raw counts of vocabulary terms."""
    return _long(weighted(df, terms, vocab, counts=True), id_col, vocab)


def tfidf(df: DataFrame, id_col: str, terms: Column, vocab: DataFrame, sublinear: bool = False) -> DataFrame:
    """(id, idx, term, weight): tf * idf, each document scaled to length one; see weighted."""
    return _long(weighted(df, terms, vocab, sublinear), id_col, vocab)


def vector(pairs: Column, size: int) -> Column:
    """A sparse ML vector from array<struct<idx, weight>> sorted by idx: the same values under the vector's type."""
    body = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(size).alias("size"),
        F.transform(pairs, lambda p: p["idx"]).alias("indices"),
        F.transform(pairs, lambda p: p["weight"]).alias("values"),
    )
    # Marked as not deterministic, so that a filter on what a model makes of it is not pushed below it.
    return F.arrow_udf(lambda given: given, VectorUDT()).asNondeterministic()(body)


def vectors(df: DataFrame, terms: Column, vocab: DataFrame, sublinear: bool = False) -> DataFrame:
    """df with a `features` vector of TF-IDF weights; texts without any vocabulary term get the zero vector."""
    rows = weighted(df, terms, vocab, sublinear)
    return rows.withColumn("features", vector(F.col(WEIGHTS), vocab.count())).drop(WEIGHTS)


def term_gains(labelled: DataFrame, terms: Column, vocab: DataFrame) -> DataFrame:
    """(idx, phrase, gain) for every vocabulary term: how much Gini impurity of `label` (0/1) the term's presence removes.

    This is what a tree of depth one gains by splitting on the term. One shuffle of partial counts by (term, class).
    """
    rows = weighted(labelled.select("label", "text"), terms, vocab, counts=True).select("label", F.explode(WEIGHTS).alias("w"))
    of = lambda label: F.count_if(F.col("label") == label)
    held = rows.groupBy("w.idx").agg(of(0).alias("n0"), of(1).alias("n1"))
    all_ = labelled.agg(F.struct(of(0).alias("n0"), of(1).alias("n1")).alias("t")).scalar()
    full = vocab.select("idx", F.col("term").alias("phrase")).join(held, "idx", "left").na.fill(0, ["n0", "n1"]).withColumn("t", all_)

    def gini(a: Column, b: Column) -> Column:
        n = (a + b).cast("double")
        return F.when(n > 0, 1 - (a / n) * (a / n) - (b / n) * (b / n)).otherwise(0.0)

    a, b, t0, t1 = F.col("n0"), F.col("n1"), F.col("t.n0"), F.col("t.n1")
    n = (t0 + t1).cast("double")
    inside = (a + b) / n * gini(a, b) + (t0 - a + t1 - b) / n * gini(t0 - a, t1 - b)
    return full.select("idx", "phrase", (gini(t0, t1) - inside).alias("gain"))
