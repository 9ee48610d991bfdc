"""Labelled corpora in CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import banks
from ..functions.text import join_text
from . import quoted

CSV = {
    "header": True, "multiLine": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


# A line break inside a field, as write_corpus writes it; files without line breaks in fields can be split.
ESCAPED, ESCAPES = "\\", {"\\": "\\\\", "\n": "\\n", "\r": "\\r"}


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", multi_line: bool = True, **options) -> DataFrame:
    """All columns as strings; nothing is inferred.

    Fields may hold line breaks. Files are split all the same, at records (see quoted); only where quotes are not paired, or with
    multi_line="whole", a file is one task's work. With multi_line off a line is a record.
    """
    settings = {**CSV, "multiLine": bool(multi_line), **options}
    plain = spark.read.options(**settings).option("encoding", encoding).csv(path)
    if multi_line is not True:
        return plain
    texts = quoted.records(spark, path)
    if texts is None:
        return plain
    # A record may end with the first half of a two-character line break.
    text = F.regexp_replace(F.decode("text", encoding), r"\r\z", "")
    schema = ", ".join(f"`{c}` string" for c in plain.columns)
    parser = {k: str(v).lower() if isinstance(v, bool) else v for k, v in settings.items() if k not in ("header", "multiLine")}
    rows = texts.select(text.alias("t")).where(F.trim("t") != "").select(F.from_csv("t", schema, parser).alias("r"))
    return rows.select("r.*")


def _escaped(column: Column) -> Column:
    for char, written in ESCAPES.items():
        column = F.replace(column, F.lit(char), F.lit(written))
    return column


def _unescaped(column: Column) -> Column:
    """Each escape once, from left to right: doubled backslashes are set aside first."""
    parts = F.split(column, r"\\\\", -1)
    back = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.array_join(back, ESCAPED)


def read_labelled(
    spark: SparkSession, path: str, text_cols: list[str], label_col: str, label_map: dict[str, int] | None = None,
    categories: dict[int, str] | None = None, encoding: str = "UTF-8", escaped: bool = False,
) -> DataFrame:
    """(text, category, label) from a CSV file; rows without text or label are dropped, other columns are not read.

    `escaped` files come from write_corpus and can be split.
    """
    raw = read_csv(spark, path, encoding, multi_line=not escaped)
    if escaped:
        raw = raw.select(*[_unescaped(F.col(c)).alias(c) for c in raw.columns])
    label = F.col(label_col)
    if label_map:
        mapped = F.coalesce(*[F.when(label == k, F.lit(v)) for k, v in label_map.items()])
    else:
        mapped = label.try_cast("int")
    text = join_text(*text_cols) if len(text_cols) > 1 else F.col(text_cols[0])
    out = raw.select(text.alias("text"), mapped.alias("label"))
    if categories:
        named = F.coalesce(*[F.when(F.col("label") == k, F.lit(v)) for k, v in categories.items()])
    else:
        named = F.lit("")
    return out.na.drop("any").select("text", named.alias("category"), "label")


def read_job_postings(spark: SparkSession, path: str) -> DataFrame:
    """Every column the job-posting corpus has, nulls filled, `fraudulent` as int."""
    raw = read_csv(spark, path)
    cols = [c for c in banks.JOB_NULLS if c in raw.columns]
    return raw.select(*cols, F.col("fraudulent").try_cast("int").alias("fraudulent")).na.fill(
        {c: banks.JOB_NULLS[c] for c in cols}
    )


def read_sms(spark: SparkSession, path: str) -> DataFrame:
    """The SMS corpus: latin-1, v1 = spam or ham, v2 = text, junk columns left out."""
    # The corpus's own column and class names.
    return read_labelled(spark, path, ["v2"], "v1", {"spam": 1, "ham": 0}, encoding="ISO-8859-1")


def write_corpus(df: DataFrame, path: str, encoding: str = "UTF-8", escaped: bool = False) -> None:
    """Write a CSV folder; `escaped` writes line breaks and backslashes in strings as escapes, for split reading."""
    if escaped:
        df = df.select(*[_escaped(F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes])
    options = {k: v for k, v in CSV.items() if k != "multiLine"}
    df.write.mode("overwrite").options(**options).option("encoding", encoding).csv(path)
