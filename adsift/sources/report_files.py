"""Report files: JSON lines in and out, and a table partitioned by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import report_id

REPORT_SCHEMA = """
  report_type string, timestamp string, reporter_name string, comment string, url string, page_title string,
  risk_score int, verdict string, fraud_category string, flagged_keywords map<string,array<string>>,
  evidence_text string, tab_id string, received_at string, report_id string
"""
# What a report holds when a field is not sent.
DEFAULTS = {
    "report_type": "CHROME_EXTENSION", "reporter_name": "Anonymous", "comment": "", "url": "", "page_title": "",
    "risk_score": 0, "verdict": "", "fraud_category": "", "evidence_text": "",
}
EVIDENCE_CHARS = 500
BAD = "_corrupt_record"


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Reports with a column that holds the lines which are not valid; blank lines are no reports."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", f"{REPORT_SCHEMA}, {BAD} string", options).alias("r")).select("r.*")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Valid reports with defaults filled; bad lines are skipped (see line_counts)."""
    return read_raw(spark, path).filter(F.col(BAD).isNull()).drop(BAD).na.fill(DEFAULTS)


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """One row: parsed and skipped lines."""
    bad = F.col(BAD)
    return read_raw(spark, path).agg(
        F.count_if(bad.isNull()).alias("parsed"), F.count_if(bad.isNotNull()).alias("skipped")
    )


def append_reports(df: DataFrame, path: str, *key: str) -> None:
    """Append report lines; the id comes from the key columns, so a retried write repeats it."""
    df.withColumn("report_id", report_id(*key)).write.mode("append").json(path)


def as_rows(df: DataFrame) -> DataFrame:
    """The stored shape: evidence cut, status set, keywords as JSON text, day as partition column."""
    out = df.withColumn("evidence_text", F.substring("evidence_text", 1, EVIDENCE_CHARS))
    if "flagged_keywords" in df.columns:
        out = out.withColumn("flagged_keywords", F.to_json("flagged_keywords"))
    return out.withColumn("status", F.lit("FILED")).withColumn("filed_on", F.to_date("received_at"))


def parse_keywords(column: str = "flagged_keywords"):
    """Keyword map of a stored row; text that is not valid becomes an empty map."""
    kind = "map<string,array<string>>"
    return F.coalesce(F.from_json(column, kind), F.create_map().cast(kind))
