"""Inputs of the registered queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import banks, rules
from ..functions.text import literal
from ..session import prepare, spread

URL_CASES = [
    (-1, ""), (-2, "about:blank"), (-3, "shop.example.com"), (-4, "http://192.168.10.5/login"),
    (-5, "https://gift.example.xyz"), (-6, "https://gift.example.xyz:8443/a"), (-7, "https://demo.github.io/x"),
    (-8, "http://sbi-loan-offer.xyz/apply"), (-9, "https://www.sbi.co.in/home"), (-10, "https://arbitrary.com/"),
    (-11, "https://a.b.c.example.com/free"), (-12, "HTTP://UPPER.example.com/"),
    (-13, "https://u@amazon.com@evil.top/"), (-14, "https://example20240.com/"),
    (-15, "https://example.com/" + "a" * 90), (-16, "http://[broken/path"), (-17, "https://my.blogspot.com/jio"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of texts, dealt out to the cores when it comes in very few splits."""
    return spread(table(spark, sf_dir, name))


def _phrase(index):
    return F.get(literal(banks.phrase_list()), index)


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, label, p): whole documents, three in five with bank phrases added, and a given probability."""
    return ads_from(texts(spark, sf_dir))


def ads_from(documents: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    n = len(banks.phrase_list())
    tail = F.when(d % 4 == 0, "job").when(d % 4 == 1, "loan").when(d % 4 == 2, "invest trading").otherwise("")
    added = F.concat(
        F.col("text"), F.lit(" "), _phrase(d % n), F.lit(". "), F.upper(_phrase((d * 7 + 3) % n)), F.lit(". "), tail
    )
    fake = d % 5 < 3
    return documents.select(
        "doc_id",
        F.when(fake, added).otherwise(F.col("text")).alias("text"),
        fake.cast("int").alias("label"),
        ((d % 101).cast("double") / F.lit(100.0)).alias("p"),
    )


def ad_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ads with the URL of the page of the same number."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return ads(spark, sf_dir).join(pages, "doc_id", "left").withColumn("url", F.coalesce("url", F.lit("")))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report an event, with a page's URL and two bank phrases as evidence."""
    events, pages = table(spark, sf_dir, "events"), table(spark, sf_dir, "pages")
    e = F.col("event_id")
    n = len(banks.phrase_list())
    kinds = list(banks.SIGNALS["service"])[:3] + [banks.SIGNALS["service"]["none"]]
    evidence = F.concat(_phrase(e % n), F.lit(" "), _phrase((e * 11 + 5) % n))
    staged = events.withColumn("n_pages", pages.agg(F.count("*").alias("n")).scalar())
    staged = staged.withColumn("page_id", e % F.col("n_pages"))
    return staged.join(pages.select("page_id", "url"), "page_id").select(
        F.concat(F.lit("R-"), F.upper(F.substring(F.md5(e.cast("string")), 1, 8))).alias("report_id"),
        "event_id",
        F.col("ts").alias("received_at"),
        F.col("user_id").cast("string").alias("client"),
        "url",
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("reporter_name"),
        F.least(F.floor("value"), F.lit(100)).cast("int").alias("risk_score"),
        F.get(literal(kinds), e % 4).alias("fraud_category"),
        F.when(F.col("event_type") == "error", "REVIEWED").otherwise("FILED").alias("status"),
        evidence.alias("evidence_text"),
        F.lit("seen in a forwarded message").alias("comment"),
    )


def url_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("case_id"), "url")
    return pages.unionByName(spark.createDataFrame(URL_CASES, "case_id bigint, url string"))


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, word_idx, word, conf): documents as if read word by word."""
    words = texts(spark, sf_dir).select(
        F.col("doc_id").alias("image_id"), F.posexplode(F.split("text", " ")).alias("word_idx", "word")
    )
    conf = (F.col("image_id") * 31 + F.col("word_idx") * 17) % 102 - 1
    return words.withColumn("conf", conf.cast("int"))


def keyword_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reports with the keyword map of their evidence."""
    return reports(spark, sf_dir).withColumn("flagged_keywords", rules.keyword_map(F.col("evidence_text")))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, label): documents with their toxicity label."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id")


def nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with missing languages and sources."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        F.nullif(F.col("lang"), F.lit("de")).alias("department"),
        F.nullif(F.col("source"), F.lit("src1")).alias("industry"),
    )
