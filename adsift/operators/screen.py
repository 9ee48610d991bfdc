"""Screening of texts and URLs: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import banks, rules, text as tx, urls


def text_bounds(df: DataFrame, text: str = "text", low: int = 5, high: int = 10_000) -> DataFrame:
    """Texts whose length before stripping is within bounds and that are not blank."""
    return df.filter(F.length(text).between(low, high) & tx.not_blank(F.col(text)))


def page_gate(df: DataFrame, text: str = "text", forced: Column | bool = False) -> DataFrame:
    """Pages worth a scan: long enough, and forced or with enough trigger phrases."""
    hits = rules.count_in(F.col(text), banks.TRIGGERS)
    forced = forced if isinstance(forced, Column) else F.lit(forced)
    return df.filter((F.length(text) >= banks.MIN_PAGE_CHARS) & (forced | (hits >= banks.TRIGGER_THRESHOLD)))


def message_gate(df: DataFrame, text: str = "text", low: int = 10) -> DataFrame:
    return df.filter(F.length(text) >= low)


def reportable(df: DataFrame, score: str = "risk_score", surface: str = "bot") -> DataFrame:
    """Results that offer a report: above 40 in chat, any non-zero online result in the popup."""
    if surface == "bot":
        return df.filter(F.col(score) > 40)
    online = ~F.coalesce(F.col("offline"), F.lit(False)) if "offline" in df.columns else F.lit(True)
    return df.filter(online & (F.col(score) != 0))


def score_text(df: DataFrame, text: str = "text", p: str = "p") -> DataFrame:
    """Add flagged_keywords, keyword_hits, keyword_bonus and risk_score.

    Hits are counted on their own, so a query that does not read the map never builds it.
    """
    # No phrase starts or ends with white space, so the text need not be stripped first.
    body = F.col(text)
    return (
        df.withColumn("flagged_keywords", rules.keyword_map(body))
        .withColumn("keyword_hits", rules.count_in(body, banks.phrase_list()))
        .withColumn("keyword_bonus", rules.keyword_bonus(F.col("keyword_hits")))
        .withColumn("risk_score", rules.risk_score(F.col(p), F.col("keyword_bonus")))
    )


def screen(df: DataFrame, text: str = "text", url: str = "url", p: str = "p") -> DataFrame:
    """The whole answer of one screening: score, verdict, category, keywords, URL check, snippet.

    Cheap bounds come first; everything is a Column expression over the input row, so the plan has no exchange and
    serves batch tables and streams alike.
    """
    scored = score_text(text_bounds(df, text), text, p)
    checked = urls.with_url_check(scored, url, "service", "url_")
    return (
        checked.withColumn("verdict", rules.verdict(F.col("risk_score")))
        .withColumn("fraud_category", rules.fraud_category(F.col("risk_score"), rules.fraud_type(F.col(text))))
        .withColumn("model_confidence", F.round(F.col(p), 4))
        .withColumn("text_snippet", tx.snippet(F.col(text)))
    )


def scan_digest(df: DataFrame, kw_map: str = "flagged_keywords") -> DataFrame:
    """Add flag_total and digest: the first three categories with their first three phrases."""
    entries = F.slice(F.map_entries(F.col(kw_map)), 1, 3)
    lines = F.transform(
        entries, lambda e: F.concat(e["key"], F.lit(": "), F.array_join(F.slice(e["value"], 1, 3), ", "))
    )
    return df.withColumn("flag_total", rules.map_total(F.col(kw_map))).withColumn("digest", F.array_join(lines, "; "))


def report_card(df: DataFrame) -> DataFrame:
    """Add the display columns of a report row: flag count, short URL, short category."""
    bare = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"(?s)^(.*?)https?://", "$1")
    return (
        df.withColumn("flag_count", rules.map_total(F.col("flagged_keywords")))
        .withColumn("short_url", F.substring(bare, 1, 30))
        .withColumn("short_category", tx.strip(F.get(F.split(F.col("fraud_category"), "/"), 0)))
    )


def alerts(df: DataFrame, score: str = "risk_score", forced: Column | bool = False) -> DataFrame:
    """Results that raise a notice: badge above 20 or forced, alert from 80."""
    forced = forced if isinstance(forced, Column) else F.lit(forced)
    badge, alert = (F.col(score) > 20) | forced, F.col(score) >= 80
    return df.withColumn("badge", badge).withColumn("alert", alert).filter(badge | alert)


def url_flag_summary(df: DataFrame, url: str = "url", profile: str = "service") -> DataFrame:
    """Pages and mean score for each URL flag."""
    checked = urls.with_url_check(df.select(url), url, profile, "url_")
    return (
        checked.select("url_risk_score", F.explode("url_flags").alias("flag"))
        .groupBy("flag")
        .agg(F.count("*").alias("pages"), F.round(F.avg("url_risk_score"), 6).alias("mean_score"))
    )
