"""URL checks: points, flags and level of one URL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import banks
from .text import literal, strip


def with_scheme(url: Column) -> Column:
    """Prepend http:// unless the URL starts with a lower-case http:// or https://."""
    ready = url.startswith("http://") | url.startswith("https://")
    return F.when(ready, url).otherwise(F.concat(F.lit("http://"), url))


def net_location(full: Column) -> Column:
    """Lower-case part between scheme and path, user info and port included."""
    return F.lower(F.regexp_extract(full, r"^https?://([^/?#]*)", 1))


def _first(entries: list[str], test) -> Column:
    """The first entry that passes, in list order, else null."""
    return F.get(F.filter(literal(entries), test), 0)


def with_url_check(df, url: str = "url", profile: str = "service", prefix: str = "url_"):
    """Add `<prefix>risk_score` and `<prefix>flags` to df.

    The normalised URL and its location are materialised as columns so that later rules share them.
    """
    full, domain = f"_{prefix}full", f"_{prefix}domain"
    staged = df.withColumn(full, with_scheme(F.coalesce(F.col(url), F.lit("")))).withColumn(
        domain, net_location(F.col(full))
    )
    score, flags = url_check(F.col(url), F.col(full), F.col(domain), profile)
    return staged.withColumn(f"{prefix}risk_score", score).withColumn(f"{prefix}flags", flags).drop(full, domain)


def url_check(url: Column, full: Column, domain: Column, profile: str) -> tuple[Column, Column]:
    text, points = banks.URL_MESSAGES[profile], banks.URL_POINTS
    tld = _first(banks.TLDS, lambda t: domain.endswith(t))
    host = _first(banks.HOSTS[profile], lambda h: domain.contains(h))
    brand = _first(
        banks.BRANDS[profile],
        lambda b: domain.contains(b)
        & ~domain.contains(F.concat(b, F.lit(".com")))
        & ~domain.contains(F.concat(b, F.lit(".co.in"))),
    )
    dots = F.length(domain) - F.length(F.replace(domain, F.lit("."), F.lit("")))
    hits = {
        "ip": F.when(domain.rlike(r"^\d{1,3}(\.\d{1,3}){3}"), F.lit("")),
        "http": F.when(full.startswith("http://"), F.lit("")),
        "tld": tld,
        "host": host,
        "brand": brand,
        "dots": F.when(dots >= 3, F.lit("")),
    }
    if profile == "ui":
        hits["word"] = _first(banks.URL_WORDS, lambda w: F.lower(full).contains(w))
        hits["long"] = F.when(F.length(full) > 100, F.lit(""))
        hits["digits"] = F.when(domain.rlike(r"\d{4,}"), F.lit(""))

    total = reduce(
        lambda a, b: a + b, [F.when(hit.isNotNull(), points[rule]).otherwise(0) for rule, hit in hits.items()]
    )

    def message(rule: str, hit: Column) -> Column:
        before, _, after = text[rule].partition("{}")
        return F.when(hit.isNotNull(), F.concat(F.lit(before), hit, F.lit(after)))

    found = F.array_compact(F.array(*[message(rule, hit) for rule, hit in hits.items()]))

    missing = F.coalesce(url, F.lit("")) == "" if profile == "service" else strip(F.coalesce(url, F.lit(""))) == ""
    if profile == "service":
        missing = missing | (url == "about:blank")
    bad = domain.contains("[") != domain.contains("]")
    empty = F.array().cast("array<string>")
    score = F.when(missing, 0).when(bad, banks.BAD_URL_SCORE[profile]).otherwise(F.least(total, F.lit(100)))
    flags = F.when(missing, empty).when(bad, F.array(F.lit(text["bad"]))).otherwise(found)
    return score, flags


def url_level(score: Column, flags: Column, url: Column) -> Column:
    """Display level of a UI check; blank URLs and those that cannot be parsed have none."""
    blank = strip(F.coalesce(url, F.lit(""))) == ""
    out = F.when(blank | F.array_contains(flags, banks.URL_MESSAGES["ui"]["bad"]), "")
    for limit, label in banks.URL_LEVELS[:-1]:
        out = out.when(score >= limit, label)
    return out.otherwise(banks.URL_LEVELS[-1][1])


def url_suspicious(score: Column) -> Column:
    return score >= banks.SUSPICIOUS_URL_SCORE
