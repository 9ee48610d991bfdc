"""Golden rows, worked out by hand from the rules."""

import pytest
from pyspark.sql import functions as F

from adsift.functions import banks, rules, text as tx, urls
from adsift.functions.stem import stem
from adsift.operators import keywords, screen

AD = "Warehouse vacancy in Pune, urgent: two shifts, salary each week, no experience needed"
PAGE = "Typing club for students: no experience needed, work from home. Plans with 100% guaranteed returns, immediate joining; Whatsapp now"


def one(spark, text, *cols):
    return spark.createDataFrame([(text,)], "text string").select(*cols).collect()[0]


def test_bank_sizes():
    assert len(banks.phrase_list()) == 61 and len(banks.KEYWORDS) == 6
    assert len(banks.TRIGGERS) == 30 and len(banks.STOP_WORDS) == 181


def test_keywords_of_sample_ad(spark):
    t = F.col("text")
    row = one(spark, AD, rules.keyword_map(t).alias("m"), rules.fraud_type(t).alias("k"))
    assert row.m == {
        "Urgency / Pressure Tactics": ["urgent"],
        "No-Document / No-Check Schemes": ["no experience needed"],
    }
    assert row.k == "Job / Employment Fraud"


def test_keywords_and_triggers_of_sample_page(spark):
    t = F.col("text")
    row = one(spark, PAGE, rules.phrases_in(t, banks.phrase_list()).alias("k"), rules.count_in(t, banks.TRIGGERS).alias("n"))
    assert row.k == ["no experience needed", "100% guaranteed", "guaranteed returns", "whatsapp now"]
    assert row.n == 6


@pytest.mark.parametrize(
    "hits,p,bonus,score,verdict",
    [(0, 0.4, 0, 40, "GENUINE"), (1, 0.4, 3, 43, "FAKE"), (7, 0.99, 20, 100, "FAKE"), (6, 0.0, 18, 18, "GENUINE")],
)
def test_score(spark, hits, p, bonus, score, verdict):
    b = rules.keyword_bonus(F.lit(hits))
    row = spark.range(1).select(
        b.alias("b"), rules.risk_score(F.lit(p), b).alias("s"), rules.verdict(rules.risk_score(F.lit(p), b)).alias("v")
    ).collect()[0]
    assert (row.b, row.s, row.v) == (bonus, score, verdict)


def test_fraud_type_ties_and_profiles(spark):
    t = F.col("text")
    cols = [rules.fraud_type(t).alias("s"), rules.fraud_type(t, "ui").alias("u")]
    assert one(spark, "a job and a loan", *cols).s == "Job / Employment Fraud"
    assert one(spark, "a loan in crypto", *cols).s == "Financial Loan Scam"
    assert one(spark, "plain words", *cols).asDict() == {"s": "General / Unknown Fraud", "u": "General Fraud"}
    assert one(spark, "sebi ipo", *cols).asDict() == {"s": "General / Unknown Fraud", "u": "Investment / Ponzi Scheme"}


URLS = [
        ("", 0, 0),
        ("about:blank", 0, 10),
        ("http://sbi-loan-offer.xyz/apply", 70, 80),
        ("https://arbitrary.com/", 35, 35),
        ("https://www.sbi.co.in/home", 15, 15),
        ("https://gift.example.xyz", 25, 25),
        ("https://gift.example.xyz:8443/a", 0, 10),
        ("http://192.168.10.5/login", 55, 55),
        ("HTTP://upper.example.com", 10, 10),
        ("http://[broken/path", 0, 80),
        ("https://example20240.com/", 0, 10),
    ]


def test_url_scores(spark):
    df = spark.createDataFrame([(u,) for u, _, _ in URLS], "url string")
    for at, profile in ((1, "service"), (2, "ui")):
        got = urls.with_url_check(df, "url", profile, "c_").select("url", "c_risk_score")
        assert {r.url: r.c_risk_score for r in got.collect()} == {u[0]: u[at] for u in URLS}


def test_url_first_match_only(spark):
    df = spark.createDataFrame([("https://sbi-hdfc-axis.example.tk",)], "url string")
    row = urls.with_url_check(df, "url", "service", "c_").collect()[0]
    assert row.c_flags == ["Suspicious TLD: .tk", "Brand impersonation: sbi"]


def test_bands(spark):
    rows = spark.createDataFrame([(s,) for s in (0, 30, 31, 35, 60, 61, 80, 81)], "s int").select(
        "s", rules.risk_band(F.col("s"), "floor").alias("f"), rules.risk_band(F.col("s"), "ceiling").alias("c")
    )
    got = {r.s: (r.f, r.c) for r in rows.collect()}
    assert got[80] == ("CRITICAL RISK", "HIGH RISK") and got[81] == ("CRITICAL RISK", "CRITICAL")
    assert got[35] == ("MEDIUM RISK", "CAUTION") and got[30] == ("LOW RISK", "SAFE")


def test_override_order(spark):
    t = F.col("text")
    assert one(spark, "You WON a Netflix year", rules.override(t, F.lit(0.9)).alias("o")).o.label == "Safe"
    assert one(spark, "You WON", rules.override(t, F.lit(0.1)).alias("o")).o.risk_score == 98.42
    assert one(spark, "hello", rules.override(t, F.lit(0.5)).alias("o")).o.label == "Safe"


def test_tokens_and_ngrams(spark):
    t = F.col("text")
    row = one(spark, "A b2b DEAL, for é₹5 ab", tx.tokens(t).alias("w"), tx.ngram_range(tx.tokens(t), 1, 2).alias("g"))
    assert row.w == ["b2b", "deal", "for", "ab"]
    assert row.g == ["b2b", "deal", "for", "ab", "b2b deal", "deal for", "for ab"]
    assert one(spark, "x", tx.ngram_range(tx.tokens(t), 1, 3).alias("g")).g == []
    words = one(spark, "pay ₹500 a₹5 abç now", tx.learning_tokens(t).alias("w")).w
    assert words == ["pay", "500", "a₹5", "now"]


def test_bag(spark):
    row = one(spark, "b a b c a b", tx.bag(F.split("text", " ")).alias("b"))
    assert [(x.term, x.n) for x in row.b] == [("a", 2), ("b", 3), ("c", 1)]
    assert one(spark, "", tx.bag(F.array().cast("array<string>")).alias("b")).b == []


def test_highlight_longest_first(spark):
    row = one(spark, "URGENT: guaranteed Returns", tx.highlight(F.col("text"), ["urgent", "guaranteed returns", "returns"]).alias("h"))
    assert row.h == "<mark>URGENT</mark>: <mark>guaranteed <mark>Returns</mark></mark>"


def test_normalise_order(spark):
    t = F.col("text")
    row = one(spark, "The 2nd  OFFER, is won't 50%!", tx.normalise_jobs(t).alias("j"), tx.normalise_sms(t).alias("s"))
    assert row.j == "nd offer wont"
    assert row.s == "2nd offer wont 50"


STEMS = [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("agreed", "agre"),
        ("feed", "feed"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"),
        ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("filing", "file"), ("happy", "happi"),
        ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("rational", "ration"),
        ("vietnamization", "vietnam"), ("operator", "oper"), ("hopefulness", "hope"), ("triplicate", "triplic"),
        ("electrical", "electr"), ("revival", "reviv"), ("adoption", "adopt"), ("replacement", "replac"),
        ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"),
        ("dying", "die"), ("news", "news"), ("died", "die"), ("cried", "cri"), ("by", "by"), ("say", "say"),
        ("winner", "winner"), ("congratulations", "congratul"), ("geologi", "geolog"),
        ("yelling", "yell"), ("enjoy", "enjoy"), ("spies", "spi"), ("flies", "fli"),
    ]


def test_stem(spark):
    rows = spark.createDataFrame(STEMS, "word string, want string").select("word", "want", stem(F.col("word")).alias("got"))
    assert {r.word: r.got for r in rows.collect()} == dict(STEMS)


def test_text_bounds(spark):
    df = spark.createDataFrame([("1234",), ("12345",), ("     ",), ("x" * 10_000,), ("x" * 10_001,)], "text string")
    assert sorted(len(r.text) for r in screen.text_bounds(df).collect()) == [5, 10_000]


def test_report_card_and_digest(spark):
    df = spark.createDataFrame(
        [("https://a.example.com/abcdefghijklmnopqrstuvwxyz", "Job / Employment Fraud", {"A": ["x", "y"], "B": ["z"]})],
        "url string, fraud_category string, flagged_keywords map<string,array<string>>",
    )
    row = screen.scan_digest(screen.report_card(df)).collect()[0]
    assert (row.flag_count, row.short_category) == (3, "Job")
    assert row.short_url == "a.example.com/abcdefghijklmnop"
    assert row.digest == "A: x, y; B: z"


def test_large_bank_join_equals_literal_bank(spark, monkeypatch):
    texts = spark.createDataFrame(
        [(1, "Apply now, work from home"), (2, "no such thing"), (3, "WORK hard at home"), (4, "")], "id int, text string"
    )
    bank = spark.createDataFrame([("work",), ("home",), ("no",), ("w",), ("work from",), ("zzz",)], "phrase string")
    small = sorted(map(tuple, keywords.phrase_hits(texts, bank, "id").collect()))
    monkeypatch.setattr(keywords, "LITERAL_BANK_ROWS", 2)
    large = sorted(map(tuple, keywords.phrase_hits(texts, bank, "id").collect()))
    assert small == large and (1, "work from") in small and (4, "w") not in small


def test_hits_of_a_large_bank(spark):
    """100,000 phrases, nested, overlapping and of any script, in one automaton and in several: what `in` finds."""
    import random

    draw = random.Random(3)
    words = ["".join(draw.choice("abcdeé日 ") for _ in range(draw.randint(1, 5))) for _ in range(400)]
    bank = sorted({w for _ in range(160_000) if (w := " ".join(draw.choice(words) for _ in range(draw.randint(2, 4)))).strip()})[:100_000] + ["", " ", "Upper"]
    texts = [(i, " ".join(draw.choice(words) for _ in range(60)).upper() if i % 2 else "".join(draw.choice(words) for _ in range(60))) for i in range(12)]
    texts += [(100, None), (101, ""), (102, "upper")]
    want = sorted((i, p) for i, t in texts if t for p in bank if p.strip() and p in t.lower())
    df = spark.createDataFrame(texts, "id long, text string")
    phrases = spark.createDataFrame([(p,) for p in bank], "phrase string").repartition(3)
    assert len(bank) > 90_000 and len(want) > 1000
    for shard in (100_000, 40_000):
        hits = keywords.phrase_hits(df, phrases, "id", shard_rows=shard)
        assert sorted(map(tuple, hits.collect())) == want
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Exchange" not in plan


def test_screen_plan_has_no_exchange(spark):
    df = spark.createDataFrame([(1, AD, "http://sbi-loan-offer.xyz/apply", 0.915)], "id int, text string, url string, p double")
    out = screen.screen(df)
    row = out.collect()[0]
    assert (row.risk_score, row.verdict, row.url_risk_score) == (97, "FAKE", 70)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_bank_of_some_hundred_phrases_walks_a_text_once(spark):
    """Not once a phrase: such a bank is an automaton, and finds what the literal array finds."""
    phrases = [f"word{i} word{i + 1}" for i in range(300)]
    rows = [(1, "WORD7 word8 word9"), (2, "xword299 word300x"), (3, None), (4, "word1"), (1, "word7 word8")]
    hits = keywords.phrase_hits(spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([(p,) for p in phrases], "phrase string"), "id")
    assert "MapInArrow" in hits._jdf.queryExecution().executedPlan().toString()
    want = [(i, p) for i, t in rows for p in phrases if t and p in t.lower()]
    assert sorted(map(tuple, hits.collect())) == sorted(want)
