"""Deterministic choices: a value depends on its key only, never on partitioning or retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int | str, *keys: Column | str) -> Column:
    """A uniform integer in 0 .. 2**32-1 from md5(seed|key|key..)."""
    parts = [F.lit(str(seed))] + [F.col(k) if isinstance(k, str) else k for k in keys]
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def draw_sql(seed: int | str, *keys: str) -> str:
    """The same integer in DuckDB SQL."""
    parts = "||'|'||".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"(('0x'||substr(md5({parts}),1,8))::BIGINT)"


def report_id(*keys: Column | str) -> Column:
    """CG- and eight upper-case hex digits, the same for every retry of the same report."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    digest = F.sha2(F.concat_ws("|", *[c.cast("string") for c in cols]), 256)
    return F.concat(F.lit("CG-"), F.upper(F.substring(digest, 1, 8)))


def url_key(url: Column | str) -> Column:
    """Sixteen hex digits of the URL's sha256; a missing URL counts as blank."""
    url = F.col(url) if isinstance(url, str) else url
    return F.substring(F.sha2(F.coalesce(url, F.lit("")), 256), 1, 16)
