"""Rows written by hand: page text, URL levels, rounding, and both sides of former limits."""

import pytest
from pyspark.sql import functions as F

from adsift.functions import html, rules, urls
from adsift.operators import augment, bayes, corpus, keywords

PAGES = [
    ('<body><p title="a>bcdef">shown text</p></body>', "shown text"),
    ("<body>Tom &amp Jerry &copy 2024</body>", "Tom & Jerry © 2024"),
    ("<!-- <body> --><html><head><title>hidden title</title></head><body>visible words</body></html>", "visible words"),
    ("<body>one more<script>var a = '<!--';</script>two more<!-- no --> three more</body>", "one more two more three more"),
    ("<body><nav>menu entry</nav>main part</body>", "main part"),
    ("<body></body>", ""),
    (None, None),
]


def test_page_text(spark):
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PAGES)], "i int, html string")
    got = {r.i: r.text for r in html.page_text(rows).collect()}
    assert got == {i: want for i, (_, want) in enumerate(PAGES)}


def test_blank_url_has_no_level(spark):
    rows = spark.createDataFrame([("",), ("  ",), (None,), ("https://example.org/",)], "url string")
    checked = urls.with_url_check(rows, "url", "ui", "url_")
    levels = checked.select(urls.url_level(F.col("url_risk_score"), F.col("url_flags"), F.col("url")).alias("l")).collect()
    assert [r.l for r in levels][:3] == ["", "", ""] and levels[3].l != ""


def test_override_rounds_before_it_labels(spark):
    row = spark.range(1).select(rules.override(F.lit("hello"), F.lit(0.50004)).alias("o"), rules.text_label(F.lit(0.50004)).alias("t")).first()
    assert (row.o.risk_score, row.o.label, row.t.label) == (50.0, "Safe", "Scam")


@pytest.mark.parametrize("most", [10**6, 1])
def test_stratified_split_with_null_class(spark, monkeypatch, most):
    monkeypatch.setattr(corpus, "MAX_CLASSES", most)
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 3) for i in range(300)], "doc_id long, label int")
    out = corpus.stratified_split(rows, "doc_id")
    tests = {r.label: r.n for r in out.where("split = 'test'").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert tests == {None: 20, 1: 20, 2: 20}


@pytest.mark.parametrize("most", [2000, 1])
def test_blank_and_null_phrases_hit_nothing(spark, monkeypatch, most):
    monkeypatch.setattr(keywords, "LITERAL_BANK_ROWS", most)
    bank = spark.createDataFrame([("",), (" ",), (None,), ("free money",), ("now",)], "phrase string")
    texts = spark.createDataFrame([(1, "FREE MONEY now"), (2, "nothing"), (3, None), (4, "know")], "doc_id long, text string")
    got = sorted((r.doc_id, r.phrase) for r in keywords.phrase_hits(texts, bank, "doc_id").collect())
    assert got == [(1, "free money"), (1, "now"), (4, "now")]


def test_amounts_of_any_length(spark):
    amount = "9" * 30
    rows = spark.createDataFrame([(1, f"pay ₹{amount} or ₹1,000 or ₹, now")], "doc_id long, text string")
    text = rows.select(augment.vary_numbers(F.col("text"), "doc_id").alias("t")).first().t
    first, second = text.split("₹")[1].split()[0], text.split("₹")[2].split()[0]
    value = int(first.replace(",", ""))
    assert 0.84 * int(amount) < value < 1.21 * int(amount) and first == f"{value:,}"
    assert 850 <= int(second.replace(",", "")) <= 1200 and text.endswith("₹, now")


def test_counts_over_the_whole_vocabulary(spark):
    rows = spark.createDataFrame([(1, "a a b"), (0, "b c"), (0, None)], "label int, text string")
    got = {r.term: (round(r.lp0, 6), round(r.lp1, 6)) for r in bayes.fit_counts(rows, F.split("text", " ")).collect()}
    import math

    ln = lambda k, n: round(math.log((k + 1) / (n + 3)), 6)
    assert got == {"a": (ln(0, 2), ln(2, 3)), "b": (ln(1, 2), ln(1, 3)), "c": (ln(1, 2), ln(0, 3))}
