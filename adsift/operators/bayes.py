"""Multinomial naive Bayes: fitting is one aggregation, predicting is arithmetic inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.text import literal_rows
from ..session import materialise
from .features import WEIGHTS


def fit(rows: DataFrame, vocab: DataFrame, alpha: float = 1.0) -> tuple:
    """Return (terms, prior).

    terms: (idx, lp0, lp1) smoothed log probabilities for every vocabulary term. prior: one value, the log odds of the
    unsmoothed class shares. `rows` holds label (0/1) and the weights of each text (see features.weighted); the sums by
    term are the only shuffle.
    """
    flat = rows.select("label", F.explode(WEIGHTS).alias("w"))
    of = lambda label: F.sum(F.when(F.col("label") == label, F.col("w.weight")).otherwise(0.0))
    sums = flat.groupBy("w.idx").agg(of(0).alias("s0"), of(1).alias("s1"))
    # From here on at most one row a vocabulary term.
    full = vocab.select("idx").join(sums, "idx", "left").na.fill(0.0, ["s0", "s1"])
    totals = full.agg(
        F.struct(F.sum("s0").alias("t0"), F.sum("s1").alias("t1"), F.count("*").alias("v")).alias("t")
    ).scalar()

    def log_prob(s, t):
        return F.log(F.col(s) + F.lit(float(alpha))) - F.log(F.col("t")[t] + F.lit(float(alpha)) * F.col("t")["v"])

    terms = full.withColumn("t", totals).select("idx", log_prob("s0", "t0").alias("lp0"), log_prob("s1", "t1").alias("lp1"))
    prior = rows.agg(
        (F.log(F.count_if(F.col("label") == 1).cast("double")) - F.log(F.count_if(F.col("label") == 0).cast("double"))).alias("p")
    )
    return terms, prior


def fit_counts(labelled: DataFrame, terms: Column, alpha: float = 1.0) -> DataFrame:
    """(term, lp0, lp1) over the whole vocabulary of the texts of `labelled` (label 0/1), from counts; terms are arrays.

    One shuffle of partial sums; no term is left out, however many there are.
    """
    counts = labelled.select("label", F.explode(tx.bag(terms)).alias("b")).select("label", "b.term", "b.n")
    of = lambda label: F.coalesce(F.sum(F.when(F.col("label") == label, F.col("n"))), F.lit(0)).cast("double")
    sums = materialise(counts.groupBy("term").agg(of(0).alias("s0"), of(1).alias("s1")), "term-sums")
    t = sums.agg(F.coalesce(F.sum("s0"), F.lit(0.0)).alias("t0"), F.coalesce(F.sum("s1"), F.lit(0.0)).alias("t1"), F.count("*").alias("v")).first()
    log_prob = lambda s, total: F.log(F.col(s) + F.lit(float(alpha))) - F.log(F.lit(float(total)) + F.lit(float(alpha)) * F.lit(t.v))
    return sums.select("term", log_prob("s0", t.t0).alias("lp0"), log_prob("s1", t.t1).alias("lp1"))


def predict(rows: DataFrame, model: tuple) -> DataFrame:
    """rows (with weights, see features.weighted) and p = P(class 1), predicted: the likelier class (ties go to class 0).

    The model is a list as long as the vocabulary and one number, looked up inside the row: no exchange, no join, so it
    scores streams as well.
    """
    terms, prior = model
    # A number a vocabulary term; idx counts the terms from 0.
    odds = [r.odds for r in terms.select("idx", (F.col("lp1") - F.col("lp0")).alias("odds")).orderBy("idx").collect()]
    start = prior.first()[0]
    table = literal_rows(odds, "array<double>")
    margin = F.aggregate(WEIGHTS, F.lit(0.0), lambda acc, w: acc + w["weight"] * F.get(table, w["idx"])) + F.lit(start).cast("double")
    scored = rows.withColumn("_odds", margin)
    p = 1 / (1 + F.exp(-F.col("_odds")))
    return scored.withColumn("p", p).withColumn("predicted", F.when(F.col("_odds") > 0, 1).otherwise(0)).drop("_odds", WEIGHTS)
