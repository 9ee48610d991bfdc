"""Screening rules as Column expressions over a text and its model probability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import banks
from .text import bound, literal, literal_rows, phrases_in


def count_in(text: Column, phrases: list[str]) -> Column:
    """How many distinct phrases the lower-cased text contains."""
    return F.size(phrases_in(text, phrases))


def keyword_map(text: Column, bank: dict[str, list[str]] = banks.KEYWORDS) -> Column:
    """Category -> matched phrases in bank order; categories without a hit are left out."""
    entries = literal_rows(
        [{"key": cat, "value": kws} for cat, kws in bank.items()], "array<struct<key:string,value:array<string>>>"
    )

    def matched(low: Column) -> Column:
        hits = F.transform(
            entries,
            lambda e: F.struct(
                e["key"].alias("key"), F.filter(e["value"], lambda p: F.contains(low, p)).alias("value")
            ),
        )
        return F.map_from_entries(F.filter(hits, lambda e: F.size(e["value"]) > 0))

    return bound(F.lower(text), matched)


def map_total(kw_map: Column) -> Column:
    """Number of phrases in a keyword map; null counts as none."""
    sizes = F.transform(F.map_values(kw_map), F.size)
    return F.coalesce(F.aggregate(sizes, F.lit(0), lambda a, b: a + b), F.lit(0))


def keyword_bonus(hits: Column) -> Column:
    """Three points for each hit, twenty at most."""
    return F.least(hits * 3, F.lit(20))


def risk_score(p: Column, bonus: Column) -> Column:
    """Truncated percentage plus bonus, one hundred at most."""
    return F.least(F.floor(p * F.lit(100.0)).cast("int") + bonus, F.lit(100))


def fraud_type(text: Column, profile: str = "service") -> Column:
    """The family with most distinct signals; earlier families win ties."""
    signals = dict(banks.SIGNALS[profile])
    none = signals.pop("none")
    families = literal(list(signals))
    lists = literal_rows(list(signals.values()), "array<array<string>>")

    def winner(counts: Column) -> Column:
        best = F.array_max(counts)
        return F.when(best == 0, F.lit(none)).otherwise(F.get(families, F.array_position(counts, best) - 1))

    def count(low: Column) -> Column:
        return bound(F.transform(lists, lambda ps: F.size(F.filter(ps, lambda p: F.contains(low, p)))), winner)

    return bound(F.lower(text), count)


def verdict(score: Column) -> Column:
    return F.when(score > 40, "FAKE").otherwise("GENUINE")


def fraud_category(score: Column, kind: Column) -> Column:
    """The fraud type of fake texts only."""
    return F.when(score > 40, kind).otherwise("Not Applicable")


def ui_verdict(predicted: Column) -> Column:
    """The UI profile asks the model's class, not the score."""
    return F.when(predicted == 1, "FAKE").otherwise("GENUINE")


def risk_band(score: Column, scheme: str = "floor") -> Column:
    limits = banks.RISK_BANDS[scheme]
    out = None
    for limit, label in limits[:-1]:
        test = score >= limit if scheme != "ceiling" else score <= limit
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(limits[-1][1])


def override(text: Column, p: Column) -> Column:
    """struct<risk_score, label>: the first listed word in the text decides, else the model."""
    lower = F.lower(text)
    out = None
    for word, score, label in banks.OVERRIDES:
        value = F.struct(F.lit(float(score)).alias("risk_score"), F.lit(label).alias("label"))
        test = F.contains(lower, F.lit(word))
        out = F.when(test, value) if out is None else out.when(test, value)
    percent = F.round(p * F.lit(100.0), 2)  # here the label follows the rounded figure
    model = F.struct(percent.alias("risk_score"), F.when(percent > 50, "Scam").otherwise("Safe").alias("label"))
    return out.otherwise(model)


def text_label(p: Column) -> Column:
    """struct<risk_score, label> from the model alone."""
    percent = p * F.lit(100.0)
    return F.struct(
        F.round(percent, 2).alias("risk_score"),
        F.when(percent > 50, "Scam").otherwise("Safe").alias("label"),
    )
