"""Evaluation of predictions: confusion, class report, ROC."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .ranking import running_totals


def confusion(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Two rows: actual class with the number predicted as 0 and as 1."""
    return df.groupBy(F.col(label).alias("actual")).agg(
        F.count_if(F.col(predicted) == 0).alias("predicted_0"), F.count_if(F.col(predicted) == 1).alias("predicted_1")
    )


def _ratio(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def class_report(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support for each class, then accuracy, macro and weighted averages.

    The table is read once: four counters hold all there is to know.
    """
    y, q = F.col(label), F.col(predicted)
    c = df.agg(
        F.count_if((y == 1) & (q == 1)).alias("tp"),
        F.count_if((y == 0) & (q == 1)).alias("fp"),
        F.count_if((y == 1) & (q == 0)).alias("fn"),
        F.count_if((y == 0) & (q == 0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))

    def line(name, hit, predicted_n, actual_n):
        precision, recall = _ratio(hit, predicted_n), _ratio(hit, actual_n)
        f1 = F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            actual_n.alias("support"),
        )

    lines = c.select(
        line("0", tn, tn + fn, tn + fp).alias("a"),
        line("1", tp, tp + fp, tp + fn).alias("b"),
        (tp + fp + fn + tn).alias("n"),
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
    )
    a, b, n = F.col("a"), F.col("b"), F.col("n")

    def average(name, how):
        return F.struct(
            F.lit(name).alias("class"),
            *[how(a[m], b[m]).alias(m) for m in ("precision", "recall", "f1")],
            n.alias("support"),
        )

    accuracy = F.col("accuracy")
    rows = F.array(
        a,
        b,
        average("accuracy", lambda x, y: accuracy),
        average("macro avg", lambda x, y: (x + y) / 2),
        average("weighted avg", lambda x, y: _ratio(x * a["support"] + y * b["support"], n)),
    )
    out = lines.select(F.explode(rows).alias("r")).select("r.*")
    return out.select("class", *[F.round(m, 6).alias(m) for m in ("precision", "recall", "f1")], "support")


def model_stats(report: DataFrame) -> DataFrame:
    """The headline figures in percent, one decimal."""
    def percent(name, metric):
        return F.round(F.max(F.when(F.col("class") == name, F.col(metric))) * 100, 1)

    return report.agg(
        percent("accuracy", "precision").alias("accuracy"),
        percent("1", "precision").alias("precision"),
        percent("1", "recall").alias("recall"),
        percent("1", "f1").alias("f1_score"),
        F.max(F.when(F.col("class") == "accuracy", F.col("support"))).alias("n_test"),
    )


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives of each distinct score; equal scores are folded before anything is ordered.

    The folded table is written once: quantiles, range totals and rows all come from it, not from the input again.
    """
    folded = df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    return materialise(folded, "scores")


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve; ties count half."""
    ranked = running_totals(_by_score(df, label, score), "score", ["pos", "neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    return ranked.agg(F.round(wins / (F.sum("pos") * F.sum("neg")), 6).alias("auc"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """False and true positive rate at each distinct score, highest first."""
    ranked = running_totals(_by_score(df, label, score), "score", ["pos", "neg"], ascending=False)
    return ranked.select(
        F.col("score").alias("threshold"),
        F.round((F.col("neg_before") + F.col("neg")) / F.col("neg_total"), 6).alias("fpr"),
        F.round((F.col("pos_before") + F.col("pos")) / F.col("pos_total"), 6).alias("tpr"),
    )
