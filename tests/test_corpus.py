"""Corpora, features, metrics, pages, augmentation and files."""

import math
import random

import pytest
from pyspark.sql import functions as F

from adsift.functions import html, text as tx
from adsift.functions.hashing import draw
from adsift.operators import augment, bayes, corpus, features, learning, lookup, metrics, ranking, reports as rp, stemming
from adsift.session import scratch
from adsift.sources import corpora, keyword_files, models, quoted, report_files


def test_distinct_text_keeps_first(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None)], "id bigint, text string")
    assert sorted(r.id for r in corpus.distinct_text(df, "id").collect()) == [1, 2, 4]


@pytest.mark.parametrize("classes", [2, 5])
def test_stratified_split_is_exact(spark, monkeypatch, classes):
    monkeypatch.setattr(corpus, "MAX_CLASSES", 3)
    df = spark.range(1000).withColumn("label", (F.col("id") % classes).cast("int")).withColumnRenamed("id", "doc_id")
    out = corpus.stratified_split(df, "doc_id").cache()
    n = {r.label: r["count"] for r in out.filter("split = 'test'").groupBy("label").count().collect()}
    assert n == {c: math.ceil(0.2 * 1000 / classes) for c in range(classes)}
    keyed = out.withColumn("h", draw(42, "doc_id"))
    edges = keyed.groupBy("label").agg(
        F.max(F.when(F.col("split") == "test", F.col("h"))).alias("a"), F.min(F.when(F.col("split") == "train", F.col("h"))).alias("b")
    )
    assert all(r.a <= r.b for r in edges.collect())


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label"))
    a = {(r.doc_id, r.split) for r in corpus.stratified_split(df.repartition(1), "doc_id").collect()}
    b = {(r.doc_id, r.split) for r in corpus.stratified_split(df.repartition(7), "doc_id").collect()}
    assert a == b


def test_running_totals(spark):
    rng = random.Random(1)
    values = sorted({round(rng.random() ** 6, 7) for _ in range(3000)})
    rows = [(v, rng.randrange(5)) for v in values]
    out = ranking.running_totals(spark.createDataFrame(rows, "v double, n bigint"), "v", ["n"])
    got = {r.v: (r.n_before, r.n_total) for r in out.collect()}
    total, want = 0, {}
    for v, n in rows:
        want[v] = total
        total += n
    assert got == {v: (b, total) for v, b in want.items()}


def test_roc_auc_with_ties(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.1), (0, 0.2)]
    df = spark.createDataFrame(rows, "label int, score double")
    pairs = [(p, n) for l, p in rows if l for m, n in rows if not m]
    wins = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs)
    assert metrics.roc_auc(df).collect()[0].auc == round(wins / len(pairs), 6)
    curve = metrics.roc_curve(df).orderBy(F.desc("threshold")).collect()
    assert (curve[0].fpr, curve[0].tpr) == (round(1 / 3, 6), 0.5) and (curve[-1].fpr, curve[-1].tpr) == (1.0, 1.0)


def test_class_report_without_predictions(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (0, 0)], "label int, predicted int")
    got = {r["class"]: r for r in metrics.class_report(df).collect()}
    assert got["1"].precision == 0.0 and got["1"].f1 == 0.0 and got["0"].recall == 1.0
    assert metrics.model_stats(metrics.class_report(df)).collect()[0].accuracy == 66.7


def test_tfidf_has_unit_length(spark):
    df = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc"), (3, "!!")], "doc_id bigint, text string")
    terms = tx.tokens(F.col("text"))
    vocab = features.vocabulary(df, terms, 2)
    assert [r.term for r in vocab.orderBy("idx").collect()] == ["aa", "bb"]
    w = features.tfidf(df, "doc_id", terms, vocab, sublinear=True)
    norms = w.groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert {r.doc_id: round(r.s, 9) for r in norms} == {1: 1.0, 2: 1.0}
    vecs = {r.doc_id: r.features for r in features.vectors(df, terms, vocab, sublinear=True).collect()}
    long = {(r.doc_id, r.idx): r.weight for r in w.collect()}
    assert {(d, int(i)): x for d, v in vecs.items() for i, x in zip(v.indices, v.values)} == long
    assert vecs[3].numNonzeros() == 0 and vecs[2].indices.tolist() == [1] and vecs[1].size == 2


def test_doc_freq_join_past_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lookup, "FREQUENT_ROWS", 1)
    df = spark.createDataFrame([(1, "aa bb"), (2, "aa cc"), (3, "aa")], "doc_id bigint, text string")
    terms = tx.tokens(F.col("text"))
    out = features.with_doc_freq(features.term_counts(df, "doc_id", terms), features.doc_freq(df, terms), "doc_id")
    got = sorted((r.doc_id, r.term, r.df) for r in out.collect())
    assert got == [(1, "aa", 3), (1, "bb", 1), (2, "aa", 3), (2, "cc", 1), (3, "aa", 3)]


def test_stem_text_keeps_order(spark, monkeypatch):
    monkeypatch.setattr(lookup, "FREQUENT_ROWS", 1)
    df = spark.createDataFrame([(1, "cats running cats hopping"), (2, ""), (3, "running ponies")], "id bigint, text string")
    got = {r.id: r.text for r in stemming.stem_text(df, "id").collect()}
    assert got == {1: "cat run cat hop", 2: "", 3: "run poni"}


def test_naive_bayes_by_hand(spark):
    df = spark.createDataFrame([(1, "win win cash", 1), (2, "meet today", 0), (3, "cash today", 0)], "doc_id bigint, text string, label int")
    terms = tx.tokens(F.col("text"))
    vocab = features.vocabulary(df, terms, 10)
    long = features.count_vectors(df, "doc_id", terms, vocab)
    assert {(r.doc_id, r.term): r.weight for r in long.collect()}[1, "win"] == 2.0
    counts = features.weighted(df, terms, vocab, counts=True)
    model = bayes.fit(counts, vocab, alpha=1.0)
    lp = {r.term: (r.lp0, r.lp1) for r in model[0].join(vocab, "idx").collect()}
    assert lp["win"][1] == pytest.approx(math.log(3 / 7)) and lp["today"][0] == pytest.approx(math.log(3 / 8))
    got = {r.doc_id: r.predicted for r in bayes.predict(counts, model).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


def test_scoring_and_features_have_no_exchange(spark):
    """The weights of a text, its vector and its score are worked out inside the row; blank texts get the prior."""
    df = spark.createDataFrame([(1, "win win cash", 1), (2, "meet today", 0), (3, None, 0), (4, "", 0)], "doc_id bigint, text string, label int")
    terms = tx.tokens(F.col("text"))
    vocab = features.vocabulary(df, terms, 10)
    weights = features.weighted(df, terms, vocab)
    model = bayes.fit(weights, vocab)
    featuriser = learning.Featuriser(high=1).fit(df)
    for out in (weights, bayes.predict(weights, model), featuriser.transform(df), features.tfidf(df, "doc_id", terms, vocab)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan and "to_json" not in plan
    assert {r.doc_id: round(r.p, 9) for r in bayes.predict(weights, model).collect()}[3] == pytest.approx(0.25)
    assert features.weighted(df, terms, vocab.limit(0)).collect()[0]._weights == []


def test_gains_are_those_of_trees_of_depth_one(spark):
    """What a tree of one split gains on a term's presence, and which term it takes first; a wrong label changes both."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector

    words = ["cash", "prize", "team", "note", "other"]
    rows = []
    for i in range(200):
        has = [i % 2 and i % 10 < 8, i % 3 == 0, not i % 2 and i % 7 < 6, i % 5 == 0, i % 11 < 4]
        rows.append((i, " ".join(w for w, h in zip(words, has) if h), i % 2))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    terms = tx.tokens(F.col("text"))
    vocab = features.vocabulary(df, terms, 10)
    gains = {r.phrase: r.gain for r in features.term_gains(df, terms, vocab).collect()}
    for w in words:
        one = df.select(F.col("label").cast("double").alias("label"), array_to_vector(F.array(F.contains("text", F.lit(w)).cast("double"))).alias("features"))
        tree = DecisionTreeClassifier(maxDepth=1, minInfoGain=0.0).fit(one)
        root = tree._java_obj.rootNode()
        assert (root.gain() if tree.depth else 0.0) == pytest.approx(gains[w], abs=1e-12)
    featuriser = learning.Featuriser(high=1, sublinear=False)
    model = learning.train(df, learning.random_forest(trees=1, depth=1).setFeatureSubsetStrategy("all").setBootstrap(False), featuriser)
    best = max(gains, key=gains.get)
    assert learning.top_keywords(learning.feature_importance(model, featuriser), 1).first().phrase == best
    wrong = {r.phrase: r.gain for r in features.term_gains(df.withColumn("label", F.col("doc_id").cast("int") % 3 % 2), terms, vocab).collect()}
    assert max(wrong, key=wrong.get) != best


def test_fit_on_all_rows(spark):
    df = spark.createDataFrame([(1, "aa bb", 1), (2, "bb cc", 0), (3, "dd", 1), (4, "dd cc", 0)], "doc_id bigint, text string, label int")
    some, whole = learning.Featuriser(high=1), learning.Featuriser(high=1)
    learning.train(df.filter("doc_id < 3"), learning.logistic, some)
    learning.train(df.filter("doc_id < 3"), learning.logistic, whole, fit_on=df)
    assert (some.size, whole.size) == (3, 4)


def test_forest_trains_on_bounded_partitions(spark, monkeypatch):
    """However few files hold the features, no task of the training holds more dense rows than the bound."""
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("one two six").alias("text"), (F.col("id") % 2).alias("label")).coalesce(1)
    seen = []
    monkeypatch.setattr(learning, "DENSE_BYTES", 25 * 3 * 4)
    monkeypatch.setattr(learning.RandomForestClassifier, "fit", lambda self, table: seen.append(table))
    learning.train(df, learning.random_forest(trees=1, depth=1), learning.Featuriser(high=1))
    sizes = [len(part) for part in seen[0].rdd.glom().collect()]
    assert sum(sizes) == 200 and max(sizes) <= 25


def test_forest_round_trip(spark):
    rows = [(i, "free cash prize now" if i % 2 else "team meeting agenda notes", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    featuriser = learning.Featuriser(max_features=20)
    model = learning.train(df, learning.random_forest(trees=5, depth=3), featuriser)
    assert learning.predict(df, model, featuriser).filter("predicted <> label").count() == 0
    top = learning.top_keywords(learning.feature_importance(model, featuriser), 3).collect()
    assert len(top) == 3 and top[0].importance >= top[1].importance
    path = scratch(spark, "model")
    models.save(model, featuriser, path)
    again = models.load(spark, path, featuriser)
    a = learning.predict(df, model, featuriser).select("doc_id", "p").collect()
    b = learning.predict(df, *again).select("doc_id", "p").collect()
    assert sorted(a) == sorted(b)


def test_logistic(spark):
    rows = [(i, "free cash prize now" if i % 2 else "team meeting agenda notes", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    featuriser = learning.Featuriser(max_features=20, sublinear=False)
    model = learning.train(df, learning.logistic, featuriser)
    assert learning.predict(df, model, featuriser).filter("predicted <> label").count() == 0


@pytest.mark.parametrize(
    "page,text",
    [
        ("<html><head><title>Never</title></head><body><p>Hello &amp; bye</p><b>abc</b> tail text</body></html>", "Hello & bye tail text"),
        ("<body><nav>menu <header>deep</header> more</nav><p>kept text</p></body>", "kept text"),
        ("<body><nav><nav><nav><nav><nav><nav>x1 deep</nav></nav></nav></nav></nav> hidden</nav><p>kept text</p></body>", "kept text"),
        ("<body><script>var t='<p>no</p>'</script><p>one&nbsp;two &eacute;t&#233;</p><!-- skip me --></body>", "one two été"),
        ("<p>no body here</p>", "no body here"),
        ("<body>first<br>second   line\n here</body>", "first second line here"),
    ],
)
def test_page_text(spark, page, text):
    df = spark.createDataFrame([(page,)], "html string")
    assert html.page_text(df).collect()[0].text == text


def test_page_text_is_cut(spark):
    df = spark.createDataFrame([(f"<body><p>{'word ' * 2000}</p></body>",), (None,)], "html string")
    assert [len(r.text) if r.text else r.text for r in html.page_text(df).collect()] == [3000, None]


def test_numbers_and_sentences(spark):
    df = spark.createDataFrame([(1, "Pay ₹1,000 or ₹, now ₹50"), (2, "One. Two! Three? Four"), (3, "a. b")], "doc_id bigint, text string")
    numbers = {r.doc_id: r.t for r in df.select("doc_id", augment.vary_numbers(F.col("text"), "doc_id").alias("t")).collect()}
    amount = int(numbers[1].split("₹")[1].split(" ")[0].replace(",", ""))
    assert 850 <= amount <= 1200 and "₹," in numbers[1] and numbers[1].endswith("₹100")
    shuffled = {r.doc_id: r.t for r in df.select("doc_id", augment.shuffle_sentences(F.col("text"), "doc_id").alias("t")).collect()}
    assert sorted(shuffled[2][:-1].split(". ")) == ["Four", "One", "Three", "Two"] and shuffled[3] == "a. b."


def test_synonyms_replace_first_only(spark):
    df = spark.createDataFrame([(7, "No CIBIL here, no cibil there")], "doc_id bigint, text string")
    got = df.select(augment.synonyms(F.col("text"), "doc_id").alias("t")).collect()[0].t
    assert not got.lower().startswith("no cibil") and got.endswith("here, no cibil there")


def test_expand_invariants(spark):
    rows = [(i, f"Work from home {i}. Earn ₹{i}00. Call now. Urgent", "fake_job", 1) for i in range(1, 30)]
    rows += [(i, f"Plain offer {i}. No hurry.", "genuine", 0) for i in range(30, 40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, category string, label int")
    out = augment.expand(df, "doc_id", n=4).collect()
    texts = [r.text for r in out]
    assert len(texts) == len(set(texts)) and {r.text for r in out if r.variant == 0} == {r[1] for r in rows}
    assert all(r.label == 1 for r in out if r.variant) and len(out) > len(rows)
    assert sorted(augment.expand(df.repartition(5), "doc_id", n=4).collect()) == sorted(out)


def test_csv_sources(spark):
    path = scratch(spark, "sms")
    rows = [("ham", 'He said "hi",\nthen left  ', None), ("spam", "café £5", None), ("other", "x", None)]
    spark.createDataFrame(rows, "v1 string, v2 string, junk string").coalesce(1).write.options(
        header=True, quote='"', escape='"', encoding="ISO-8859-1", ignoreTrailingWhiteSpace=False
    ).csv(path)
    got = {r.text: r.label for r in corpora.read_sms(spark, path).collect()}
    assert got == {'He said "hi",\nthen left  ': 0, "café £5": 1}


def test_job_postings(spark):
    path = scratch(spark, "jobs")
    rows = [("Clerk", None, "Do work", "1"), (None, "Delhi", "Call", "0")]
    spark.createDataFrame(rows, "title string, location string, description string, fraudulent string").write.option("header", True).csv(path)
    got = sorted((r.title, r.location, r.fraudulent) for r in corpora.read_job_postings(spark, path).collect())
    assert got == [(" ", "Delhi", 0), ("Clerk", "Unknown", 1)]
    two = corpora.read_labelled(spark, path, ["title", "description"], "fraudulent", None, {1: "fake", 0: "genuine"})
    assert sorted(r.text for r in two.collect()) == ["Call", "Clerk Do work"]


def test_report_lines(spark):
    path = scratch(spark, "lines")
    lines = ['{"report_id":"A","risk_score":80,"tab_id":7,"flagged_keywords":{"x":["y"]}}', '{"report_id":"B"', "", '{"report_id":"C","tab_id":"t"}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    good = {r.report_id: r for r in report_files.read_reports(spark, path).collect()}
    assert set(good) == {"A", "C"} and good["A"].tab_id == "7" and good["C"].reporter_name == "Anonymous"
    assert report_files.line_counts(spark, path).collect()[0].asDict() == {"parsed": 2, "skipped": 1}


def test_append_is_repeatable(spark):
    path = scratch(spark, "append")
    df = spark.createDataFrame([(1, "http://a"), (2, "http://b")], "event_id bigint, url string")
    report_files.append_reports(df, path, "event_id")
    report_files.append_reports(df, path, "event_id")
    ids = [r.report_id for r in report_files.read_raw(spark, path).collect()]
    assert len(ids) == 4 and len(set(ids)) == 2 and all(len(i) == 11 and i.startswith("CG-") for i in ids)


def test_stored_rows(spark):
    df = spark.createDataFrame([("x" * 700, "2024-01-02 03:04:05", {"a": ["b"]})], "evidence_text string, received_at string, flagged_keywords map<string,array<string>>")
    row = report_files.as_rows(df).withColumn("m", report_files.parse_keywords()).collect()[0]
    assert len(row.evidence_text) == 500 and row.status == "FILED" and str(row.filed_on) == "2024-01-02" and row.m == {"a": ["b"]}
    bad = spark.createDataFrame([("not json",)], "flagged_keywords string").select(report_files.parse_keywords().alias("m"))
    assert bad.collect()[0].m == {}


def test_keyword_bank(spark):
    path = scratch(spark, "bank")
    model = spark.createDataFrame([("cash", 0.5)], "phrase string, importance double")
    learned = spark.createDataFrame([("call now", 3)], "phrase string, n bigint")
    keyword_files.write_bank(model, learned, path, "2024-01-01")
    assert [r.phrase for r in keyword_files.load_bank(spark, path).collect()] == ["cash"]
    assert [r.phrase for r in keyword_files.load_learned(spark, path).collect()] == ["call now"]


def test_phrase_counts_span_and_threshold(spark):
    rows = [(80, "pay now", "fast"), (90, "pay now", "fast"), (71, "pay now pay now", "x"), (69, "pay now", "fast")]
    df = spark.createDataFrame(rows, "risk_score int, evidence_text string, comment string")
    got = {r.phrase: r.n for r in rp.phrase_counts(df).collect()}
    assert got == {"pay now": 4}
    assert rp.phrase_counts(df, by_report=True).collect()[0].n == 3
    assert {r.phrase for r in rp.phrase_counts(df, min_count=2).collect()} >= {"now fast", "pay now fast"}


def test_ocr_text(spark):
    rows = [(1, 0, "Earn", 96), (1, 1, " ", 95), (1, 2, "cash", 41), (1, 3, "noise", 40), (1, 4, "", -1), (2, 0, "x", 10)]
    df = spark.createDataFrame(rows, "image_id int, word_idx int, word string, conf int")
    got = {r.image_id: (r.text, r.confidence, r.word_count) for r in rp.ocr_text(df).collect()}
    assert got == {1: ("Earn cash", 68.0, 2), 2: ("", 10.0, 0)}


def test_empty_stats(spark):
    df = spark.createDataFrame([], "risk_score int, received_at timestamp_ntz")
    row = rp.report_stats(df, F.lit("2024-01-01")).collect()[0]
    assert row.asDict() == {"total_reports": 0, "high_risk": 0, "filed_today": 0, "avg_risk_score": 0.0}


@pytest.mark.parametrize("split", [40, 97, 1000, 10**6])
@pytest.mark.parametrize("end,encoding", [("\n", "UTF-8"), ("\r\n", "UTF-8"), ("\n", "ISO-8859-1")])
def test_csv_with_line_breaks_is_split(spark, tmp_path, split, end, encoding):
    """Files of another writer, with line breaks, doubled quotes and blank lines, read in splits of any size: the same rows."""
    import csv
    import random

    draw = random.Random(split)
    bits = ["a", "é", '"', ",", "\n", end, " ", "\\", "word", "\n\n", '""']
    rows = []
    for part in range(3):
        with open(tmp_path / f"p{part}.csv", "w", newline="", encoding=encoding) as file:
            out = csv.writer(file, lineterminator=end, quoting=csv.QUOTE_ALL if part == 2 else csv.QUOTE_MINIMAL)
            out.writerow(["id", "text", "label"])
            for i in range(60):
                text = "".join(draw.choice(bits) for _ in range(draw.randint(1, 30 if i else 900))) + "."
                rows.append((str(100 * part + i), text, str(i % 2)))
                out.writerow(rows[-1])
                if i % 20 == 7:
                    file.write(end)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = corpora.read_csv(spark, str(tmp_path), encoding)
        assert sorted(map(tuple, got.collect())) == sorted(rows)
        if split < 1000:
            assert quoted._lines(spark, str(tmp_path)).select("block").distinct().count() > 10
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_csv_with_unpaired_quotes_is_read_whole(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,5" disk\n2,plain\n')
    got = sorted(map(tuple, corpora.read_csv(spark, str(tmp_path)).collect()))
    assert got == sorted(map(tuple, corpora.read_csv(spark, str(tmp_path), multi_line="whole").collect())) and len(got) == 2


@pytest.mark.parametrize("by_report", [False, True])
def test_pruned_phrase_counts(spark, monkeypatch, by_report):
    """Pruning by frequent pairs changes no count, and far fewer phrases are shuffled."""
    import random

    from adsift.operators import reports

    draw = random.Random(1)
    rows = [(i, " ".join(draw.choice("abcdefghijklmnop") + draw.choice("xyz") for _ in range(20)), "the same words again", 60 + i % 40) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, evidence_text string, comment string, risk_score int")
    got = sorted(map(tuple, reports.phrase_counts(df, by_report=by_report).collect()))
    monkeypatch.setattr(reports, "FREQUENT_PAIRS", 0)
    assert got == sorted(map(tuple, reports.phrase_counts(df, by_report=by_report).collect()))
    every = {p: n for p, n in map(tuple, reports.phrase_counts(df, min_count=1, by_report=by_report).collect()) if n >= 3}
    assert got == sorted(every.items()) and any(p.count(" ") == 2 for p, _ in got)
    words = df.filter("risk_score >= 70").select(tx.learning_tokens(F.concat_ws(" ", "evidence_text", "comment")).alias("_w"))
    pairs = spark.createDataFrame([(p, n) for p, n in got if p.count(" ") == 1], "phrase string, n long")
    pruned = reports._pruned(words, pairs, by_report).count()
    assert pruned < reports._counted(words, tx.ngram_range(F.col("_w"), 3, 3), by_report).count()


def test_learning_keeps_one_table(spark):
    from pathlib import Path

    from adsift.streaming import reports as sr, runs

    path, out = scratch(spark, "in"), scratch(spark, "learn")
    for k in range(5):
        rows = [(f"send money now {k % 2}", "friend", 90)] * 2
        spark.createDataFrame(rows, "evidence_text string, comment string, risk_score int").coalesce(1).write.mode("append").parquet(path)
        got = sr.learned_phrases(runs.read_stream(spark, path), min_count=4, out=out)
    assert {r.phrase: r.n for r in got.collect()}["send money now"] == 10
    assert len([p for p in Path(out).glob("batch=*")]) == 2


def test_ocr_words_travel_in_lists(spark):
    """Words of an image that stand together move as one row; any order of the rows, nulls and repeated places give the same text."""
    rows = [(i % 3 if i % 5 else None, i // 3, [f"w{i}", " ", None, ""][0 if i % 4 else i // 4 % 4], [95, 41, 40, 0, -1, None][i % 6]) for i in range(200)]
    rows += [(7, k, f"v{k % 2}", 90) for k in (3, 1, 2, 1)] + [(8, 0, "x", 10)]
    frame = spark.createDataFrame(rows, "image_id long, word_idx int, word string, conf int")
    want = {}
    for image in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == image]
        kept = sorted((at, word) for _, at, word, conf in mine if conf is not None and conf > 40 and word and word.strip())
        known = [conf for *_, conf in mine if conf is not None and conf > 0]
        want[image] = (" ".join(w for _, w in kept), round(sum(known) / len(known), 1) if known else 0.0, len(kept))
    for order in ("conf", "image_id"):
        got = {r.image_id: (r.text, r.confidence, r.word_count) for r in rp.ocr_text(frame.coalesce(1).sortWithinPartitions(order)).collect()}
        assert {k: (t, pytest.approx(c, abs=0.051), n) for k, (t, c, n) in want.items()} == got
    lists = rp._in_lists(frame.filter("image_id = 7").toArrow().to_batches())
    assert [b.column("at").to_pylist() for b in lists] == [[[3, 1, 2, 1]]]
