"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import banks, html, rules, text as tx, urls
from ..functions.hashing import report_id
from ..operators import (
    augment, bayes, bursts, corpus, features, greedy, keywords, learning, metrics, reports as rp, screen, stemming,
)
from ..session import count_files, materialise, prepare, scratch, shared
from ..sources import corpora, keyword_files, models, report_files
from ..streaming import reports as sr, runs, screening
from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

AS_OF = "2024-01-15"
SEED = 42


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- sources and sinks -------------------------------------------------------------------------------------------


@query
def src_labelled_csv(spark, sf_dir):
    path = scratch(prepare(spark), "sms-csv")
    raw = views.labelled(spark, sf_dir)
    corpora.write_corpus(
        raw.select(F.when(F.col("label") == 1, "spam").otherwise("ham").alias("v1"), F.col("text").alias("v2"),
                   F.lit(None).cast("string").alias("junk")),
        path,
    )
    return corpora.read_labelled(
        spark, path, ["v2"], "v1", {"spam": 1, "ham": 0}, {1: "fake_sms", 0: "genuine_sms"}
    )


def _report_lines(spark, sf_dir) -> str:
    """Report lines in the shared folder; the line of each reviewed report is broken off."""
    path = scratch(prepare(spark), "report-lines")
    rows = views.keyword_reports(spark, sf_dir)
    line = F.to_json(
        F.struct("report_id", "risk_score", "fraud_category", "evidence_text", "reporter_name", "flagged_keywords")
    )
    broken = F.when(F.col("status") == "REVIEWED", F.substring(line, 1, 30)).otherwise(line)
    rows.select(broken.alias("value")).write.text(path)
    return path


@query
def src_reports_jsonl(spark, sf_dir):
    good = report_files.read_reports(spark, _report_lines(spark, sf_dir))
    return good.select(
        "report_id", "risk_score", "fraud_category", "evidence_text", "reporter_name", "report_type",
        rules.map_total(F.col("flagged_keywords")).alias("n_phrases"),
    )


@query
def src_reports_jsonl_lines(spark, sf_dir):
    return report_files.line_counts(spark, _report_lines(spark, sf_dir))


@query
def snk_reports_jsonl(spark, sf_dir):
    path = scratch(prepare(spark), "reports-jsonl")
    sent = views.reports(spark, sf_dir).drop("report_id")
    report_files.append_reports(sent.withColumn("tab_id", F.col("event_id").cast("string")), path, "event_id")
    return report_files.read_reports(spark, path).select("report_id", "tab_id", "risk_score", "url", "fraud_category")


@query
def snk_reports_table(spark, sf_dir):
    stream = _report_stream(spark, sf_dir, close=True)
    table = sr.filed_reports(stream, "filed", delay=STREAM_DELAY, bulk=True)
    return table.select("event_id", "url_hash", "risk_score", "status", "evidence_text", "filed_on")


@query
def src_sms_latin1(spark, sf_dir):
    path = scratch(prepare(spark), "latin1-csv")
    rows = views.labelled(spark, sf_dir)
    text = F.regexp_replace("text", r"[^\x00-\xff]", "")
    named = F.when(F.col("label") == 1, "spam").otherwise("ham").alias("v1")
    corpora.write_corpus(rows.select(named, text.alias("v2"), F.lit("").alias("junk")), path, encoding="ISO-8859-1")
    return corpora.read_sms(spark, path)


@query
def src_job_postings(spark, sf_dir):
    path = scratch(prepare(spark), "jobs-csv")
    rows = views.nullable(spark, sf_dir)
    none = F.lit(None).cast("string").alias("benefits")
    # The posting's number travels in a column the reader keeps as it is.
    corpora.write_corpus(
        rows.select(F.col("doc_id").cast("string").alias("title"), "department", "industry", none, (F.col("doc_id") % 2).alias("fraudulent")), path
    )
    jobs = corpora.read_job_postings(spark, path)
    return jobs.select(F.col("title").cast("bigint").alias("doc_id"), "department", "industry", "benefits", "fraudulent")


@query
def snk_corpus_csv(spark, sf_dir):
    path = scratch(prepare(spark), "corpus-csv")
    rows = views.ads(spark, sf_dir)
    corpora.write_corpus(rows.select("text", F.lit("ad").alias("category"), "label"), path, escaped=True)
    return corpora.read_labelled(spark, path, ["text"], "label", None, {0: "genuine", 1: "fake"}, escaped=True)


@query
def snk_keyword_bank(spark, sf_dir):
    """The learned part of the bank as it is read back, with the number of its model phrases and whether they are the model's."""
    path = scratch(prepare(spark), "keyword-bank")
    model, featuriser = _forest(spark, sf_dir)
    importance = materialise(learning.feature_importance(model, featuriser), "importances")
    learned = rp.phrase_counts(views.reports(spark, sf_dir))
    keyword_files.write_bank(learning.top_keywords(importance, 100), learned, path, AS_OF)
    total = keyword_files.load_totals(spark, path).select("total_learned").scalar()
    bank = keyword_files.load_bank(spark, path)
    _, strong = _gains(spark, sf_dir, model, featuriser)
    # Read back, the bank holds no less than any 100 phrases of the model do.
    most = importance.orderBy(F.desc("importance")).limit(100).agg(F.round(F.sum("importance"), 5).alias("m"))
    held = bank.agg(F.round(F.sum("importance"), 5).alias("m"))
    whole = held.join(most, held.m == most.m).agg((F.count("*") == 1).alias("w")).scalar()
    rows = keyword_files.load_learned(spark, path).withColumn("total_learned", total)
    return rows.withColumn("n_model", bank.agg(F.count("*").alias("n")).scalar()).withColumn("strong", strong).withColumn("whole", whole)


# --- projections -------------------------------------------------------------------------------------------------


@query
def prj_fill_nulls(spark, sf_dir):
    return corpus.fill_nulls(views.nullable(spark, sf_dir)).select("doc_id", "department", "industry")


@query
def prj_combine_text(spark, sf_dir):
    rows = views.nullable(spark, sf_dir)
    return rows.select("doc_id", tx.join_text("department", "text", "industry").alias("text"))


@query
def prj_normalise_jobs(spark, sf_dir):
    docs = views.texts(spark, sf_dir)
    return docs.select("doc_id", tx.normalise_jobs(F.col("text")).alias("text"))


def _messages(spark, sf_dir):
    """(message_id, role, text, label): conversation turns as short messages; the user's are label 1."""
    return views.texts(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("message_id"), "role", "text",
        (F.col("role") == "user").cast("int").alias("label"),
    )


@query
def prj_normalise_sms(spark, sf_dir):
    return _messages(spark, sf_dir).select("message_id", tx.normalise_sms(F.col("text")).alias("text"))


@query
def prj_stem_vocabulary(spark, sf_dir):
    rows = views.ads(spark, sf_dir).select("doc_id", tx.normalise_sms(F.col("text")).alias("text"))
    return stemming.vocabulary_stems(rows).select("word", "stem")


@query
def prj_stem_text(spark, sf_dir):
    rows = _messages(spark, sf_dir).select("message_id", tx.normalise_sms(F.col("text")).alias("text"))
    return stemming.stem_text(rows, "message_id")


@query
def prj_message_length(spark, sf_dir):
    return _messages(spark, sf_dir).select("message_id", F.length("text").alias("message_length"))


@query
def prj_tokens(spark, sf_dir):
    docs = views.texts(spark, sf_dir).select("doc_id", tx.tokens(F.col("text")).alias("w"))
    return docs.select("doc_id", F.size("w").alias("n_tokens"), F.array_join("w", " ").alias("tokens"))


@query
def prj_ngrams(spark, sf_dir):
    docs = views.texts(spark, sf_dir).select("doc_id", tx.tokens(F.col("text")).alias("w"))
    terms = docs.select("doc_id", tx.ngram_range(F.col("w"), 1, 2).alias("t"))
    return terms.select("doc_id", F.size("t").alias("n_terms"), F.array_join("t", "|").alias("terms"))


@query
def prj_page_text(spark, sf_dir):
    return html.page_text(views.texts(spark, sf_dir, "pages")).select("page_id", "text")


@query
def prj_snippet(spark, sf_dir):
    docs = views.texts(spark, sf_dir)
    return docs.select(
        "doc_id",
        tx.snippet(F.col("text")).alias("text_snippet"),
        F.substring("text", 1, report_files.EVIDENCE_CHARS).alias("evidence_text"),
    )


@query
def prj_highlight(spark, sf_dir):
    rows = views.ads(spark, sf_dir)
    return rows.select("doc_id", tx.highlight(F.col("text"), banks.phrase_list()).alias("highlighted"))


@query
def prj_report_card(spark, sf_dir):
    cards = screen.report_card(views.keyword_reports(spark, sf_dir))
    return cards.select("report_id", "flag_count", "short_url", "short_category")


@query
def prj_scan_digest(spark, sf_dir):
    rows = screen.score_text(views.ads(spark, sf_dir))
    return screen.scan_digest(rows).select("doc_id", "flag_total", "digest")


# --- filters -----------------------------------------------------------------------------------------------------


@query
def flt_text_bounds(spark, sf_dir):
    return screen.text_bounds(views.ads(spark, sf_dir)).select("doc_id", F.length("text").alias("n_chars"))


@query
def flt_page_gate(spark, sf_dir):
    rows = screen.page_gate(views.ads(spark, sf_dir), forced=F.col("p") >= 0.95)
    return rows.select("doc_id", rules.count_in(F.col("text"), banks.TRIGGERS).alias("hits"))


@query
def flt_message_gate(spark, sf_dir):
    return screen.message_gate(_messages(spark, sf_dir)).select("message_id", F.length("text").alias("n_chars"))


@query
def flt_drop_null(spark, sf_dir):
    return corpus.drop_null(views.nullable(spark, sf_dir)).select("doc_id", "department", "industry")


@query
def flt_reports(spark, sf_dir):
    rows = rp.filter_reports(views.reports(spark, sf_dir), 50, 30, "FILED")
    return rows.select("report_id", "event_id", "risk_score", "status", "received_at")


@query
def flt_report_search(spark, sf_dir):
    rows = rp.search_reports(views.reports(spark, sf_dir), "USER-1", "Financial Loan Scam", 20)
    return rows.select("report_id", "risk_score", "fraud_category", "url", "reporter_name")


@query
def flt_reportable(spark, sf_dir):
    scored = screen.score_text(views.ads(spark, sf_dir)).withColumn("offline", F.col("doc_id") % 7 == 0)
    bot = screen.reportable(scored, surface="bot").select("doc_id", "risk_score", F.lit("bot").alias("surface"))
    popup = screen.reportable(scored, surface="popup").select("doc_id", "risk_score", F.lit("popup").alias("surface"))
    return bot.unionByName(popup)


# --- rules -------------------------------------------------------------------------------------------------------


@query
def rule_keyword_bonus(spark, sf_dir):
    return screen.score_text(views.ads(spark, sf_dir)).select("doc_id", "keyword_hits", "keyword_bonus")


@query
def rule_risk_score(spark, sf_dir):
    return screen.score_text(views.ads(spark, sf_dir)).select("doc_id", "risk_score")


@query
def rule_verdict(spark, sf_dir):
    rows = screen.score_text(views.ads(spark, sf_dir))
    score, text = F.col("risk_score"), F.col("text")
    return rows.select(
        "doc_id",
        rules.verdict(score).alias("verdict"),
        rules.fraud_category(score, rules.fraud_type(text)).alias("fraud_category"),
        rules.ui_verdict((F.col("p") > 0.5).cast("int")).alias("ui_verdict"),
        rules.fraud_type(text, "ui").alias("ui_category"),
    )


@query
def rule_fraud_type(spark, sf_dir):
    text = F.col("text")
    return views.ads(spark, sf_dir).select(
        "doc_id", rules.fraud_type(text, "service").alias("service_type"), rules.fraud_type(text, "ui").alias("ui_type")
    )


def _checked(spark, sf_dir, profile):
    return urls.with_url_check(views.url_cases(spark, sf_dir), "url", profile, "url_")


@query
def rule_url_flags(spark, sf_dir):
    both = [
        _checked(spark, sf_dir, profile).select(
            "case_id", F.lit(profile).alias("profile"), "url_risk_score", F.array_join("url_flags", " | ").alias("flags")
        )
        for profile in ("service", "ui")
    ]
    return both[0].unionByName(both[1])


@query
def rule_url_level(spark, sf_dir):
    score, flags = F.col("url_risk_score"), F.col("url_flags")
    return _checked(spark, sf_dir, "ui").select(
        "case_id", urls.url_level(score, flags, F.col("url")).alias("level"), urls.url_suspicious(score).alias("is_suspicious")
    )


@query
def rule_risk_band(spark, sf_dir):
    rows = screen.score_text(views.ads(spark, sf_dir))
    score = F.col("risk_score")
    return rows.select(
        "doc_id", rules.risk_band(score, "floor").alias("floor_band"), rules.risk_band(score, "ceiling").alias("ceiling_band"),
        rules.risk_band(score, "chat").alias("chat_band"),
    )


@query
def rule_override(spark, sf_dir):
    rows = views.ads(spark, sf_dir).select("doc_id", rules.override(F.col("text"), F.col("p")).alias("o"))
    return rows.select("doc_id", "o.risk_score", "o.label")


@query
def rule_text_label(spark, sf_dir):
    rows = views.ads(spark, sf_dir).select("doc_id", rules.text_label(F.col("p")).alias("o"))
    return rows.select("doc_id", "o.risk_score", "o.label")


# --- joins -------------------------------------------------------------------------------------------------------


@query
def jn_keyword_hits(spark, sf_dir):
    return keywords.keyword_hits(views.ads(spark, sf_dir), "doc_id").select("doc_id", "category", "phrase")


@query
def jn_trigger_hits(spark, sf_dir):
    hits = keywords.keyword_hits(views.ads(spark, sf_dir), "doc_id", bank={"trigger": banks.TRIGGERS})
    return hits.select("doc_id", "phrase")


@query
def jn_learned_hits(spark, sf_dir):
    learned = materialise(rp.phrase_counts(views.reports(spark, sf_dir)).select("phrase"), "learned")
    return keywords.phrase_hits(views.ads(spark, sf_dir), learned, "doc_id")


@query
def jn_tfidf(spark, sf_dir):
    docs = views.texts(spark, sf_dir)
    terms = tx.tokens(F.col("text"))
    freq = materialise(features.doc_freq(docs, terms), "doc-freq")
    n_docs = docs.agg(F.count("*").alias("n")).scalar()
    joined = features.with_doc_freq(features.term_counts(docs, "doc_id", terms), freq, "doc_id")
    idf = F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1
    return joined.withColumn("n_docs", n_docs).select(
        "doc_id", "term", "n", "df", F.round(F.col("n") * idf, 6).alias("tfidf")
    )


@query
def jn_screen_assemble(spark, sf_dir):
    rows = screen.screen(views.ad_pages(spark, sf_dir))
    return rows.select(
        "doc_id", "risk_score", "verdict", "fraud_category", "keyword_hits", "url_risk_score",
        F.array_join("url_flags", " | ").alias("url_flags"), "model_confidence", "text_snippet",
    )


@query
def jn_scan_pages(spark, sf_dir):
    """Page to answer in one plan: visible text, trigger gate (every third page is forced), screening."""
    pages = html.page_text(views.texts(spark, sf_dir, "pages"))
    given = pages.withColumn("p", (F.col("page_id") % 101).cast("double") / 100)
    rows = screen.screen(screen.page_gate(given, forced=F.col("page_id") % 3 == 0))
    return rows.select("page_id", "risk_score", "verdict", "fraud_category", "keyword_hits", "url_risk_score", "text_snippet")


@query
def jn_screen_with_model(spark, sf_dir):
    """The main path: text, the trained model's probability, screening."""
    docs, score = _bayes_score(spark, sf_dir)
    return _screened_by_model(docs, score)


def _screened_by_model(docs, score):
    test = corpus.random_split(docs, "doc_id").filter("split = 'test'").drop("p")
    rows = screen.screen(score(test).withColumn("p", F.round("p", 6)).withColumn("url", F.lit("")))
    return rows.select("doc_id", "risk_score", "verdict", "fraud_category", "keyword_hits", "model_confidence")


@query
def jn_new_phrases(spark, sf_dir):
    return keywords.new_phrases(rp.phrase_counts(views.reports(spark, sf_dir)))


@query
def jn_duplicate_origin(spark, sf_dir):
    rows = greedy.deduplicate(views.reports(spark, sf_dir))
    answer = F.when(F.col("accepted"), report_id("event_id")).otherwise(
        F.concat(report_id("origin"), F.lit("-DUP"))
    )
    return rows.select("event_id", "origin", answer.alias("answer"))


# --- aggregations ------------------------------------------------------------------------------------------------


@query
def agg_keyword_map(spark, sf_dir):
    rows = views.ads(spark, sf_dir).select("doc_id", F.explode(rules.keyword_map(F.col("text"))).alias("category", "kws"))
    return rows.select("doc_id", "category", F.array_join("kws", "|").alias("phrases"))


@query
def agg_report_stats(spark, sf_dir):
    return rp.report_stats(views.reports(spark, sf_dir), F.lit(AS_OF))


@query
def agg_reports_by_category(spark, sf_dir):
    return rp.by_category(views.reports(spark, sf_dir))


@query
def agg_label_counts(spark, sf_dir):
    return corpus.label_counts(views.labelled(spark, sf_dir))


@query
def agg_null_counts(spark, sf_dir):
    return corpus.null_counts(views.nullable(spark, sf_dir))


@query
def agg_length_by_class(spark, sf_dir):
    return corpus.length_by_class(_messages(spark, sf_dir), "role")


@query
def agg_doc_freq(spark, sf_dir):
    return features.doc_freq(views.texts(spark, sf_dir), tx.tokens(F.col("text")))


@query
def agg_phrase_counts(spark, sf_dir):
    return rp.phrase_counts(views.reports(spark, sf_dir))


@query
def agg_phrase_reports(spark, sf_dir):
    return rp.phrase_counts(views.reports(spark, sf_dir), by_report=True)


def _predicted(spark, sf_dir):
    """ads with the class that the given probability stands for."""
    return views.ads(spark, sf_dir).withColumn("predicted", (F.col("p") > 0.5).cast("int"))


@query
def agg_confusion(spark, sf_dir):
    return metrics.confusion(_predicted(spark, sf_dir))


@query
def agg_class_report(spark, sf_dir):
    return metrics.class_report(_predicted(spark, sf_dir))


@query
def agg_model_stats(spark, sf_dir):
    return metrics.model_stats(metrics.class_report(_predicted(spark, sf_dir)))


@query
def agg_roc_auc(spark, sf_dir):
    return metrics.roc_auc(views.ads(spark, sf_dir).select("label", "p"), score="p")


@query
def agg_ocr_text(spark, sf_dir):
    return rp.ocr_text(views.ocr_words(spark, sf_dir))


@query
def agg_url_flag_summary(spark, sf_dir):
    return screen.url_flag_summary(views.url_cases(spark, sf_dir))


# --- windows, sorts, sets ----------------------------------------------------------------------------------------


@query
def win_stratified_split(spark, sf_dir):
    return corpus.stratified_split(views.labelled(spark, sf_dir).select("doc_id", "label"), "doc_id")


@query
def win_random_split(spark, sf_dir):
    return corpus.random_split(views.table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query
def win_top_words(spark, sf_dir):
    rows = views.labelled(spark, sf_dir).select("label", tx.normalise_jobs(F.col("text")).alias("text"))
    return corpus.top_words(rows)


@query
def win_roc_curve(spark, sf_dir):
    return metrics.roc_curve(views.ads(spark, sf_dir).select("label", "p"), score="p")


@query
def win_chatter_gap(spark, sf_dir):
    return bursts.burst_ends(views.table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3600)


@query
def srt_recent_reports(spark, sf_dir):
    rows = rp.recent_reports(views.reports(spark, sf_dir))
    return rows.select("report_id", "received_at", "risk_score", "total")


@query
def srt_longest_messages(spark, sf_dir):
    return corpus.longest(_messages(spark, sf_dir), "message_id").select("message_id", "message_length")


@query
def srt_sample_rows(spark, sf_dir):
    rows = _predicted(spark, sf_dir).select("doc_id", F.col("label").alias("actual"), "predicted")
    return corpus.sample_rows(rows, "doc_id")


@query
def set_union_corpora(spark, sf_dir):
    docs = views.labelled(spark, sf_dir).select("text", "label")
    sms = _messages(spark, sf_dir).select("text", "label")
    return corpus.union_corpora(docs, sms, views.ads(spark, sf_dir).select("text", "label"))


@query
def set_distinct_text(spark, sf_dir):
    return corpus.distinct_text(views.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


# --- augmentation ------------------------------------------------------------------------------------------------


@query
def aug_synonyms(spark, sf_dir):
    return views.ads(spark, sf_dir).select("doc_id", augment.synonyms(F.col("text"), "doc_id").alias("text"))


@query
def aug_numbers(spark, sf_dir):
    return views.ads(spark, sf_dir).select("doc_id", augment.vary_numbers(F.col("text"), "doc_id").alias("text"))


@query
def aug_sentence_shuffle(spark, sf_dir):
    return views.ads(spark, sf_dir).select("doc_id", augment.shuffle_sentences(F.col("text"), "doc_id").alias("text"))


@query
def aug_expand(spark, sf_dir):
    rows = views.ads(spark, sf_dir).withColumn("category", F.when(F.col("label") == 1, "fake").otherwise("genuine"))
    return augment.expand(rows, "doc_id")


# --- learning ----------------------------------------------------------------------------------------------------


def _train(df, id_col="doc_id"):
    return corpus.random_split(df, id_col).filter("split = 'train'").drop("split")


@query
def ml_tfidf(spark, sf_dir):
    docs = views.ads(spark, sf_dir)
    terms = tx.ngram_range(tx.tokens(F.col("text")), 1, 2)
    # Written once: the weights and the names of the terms both read it.
    vocab = materialise(features.vocabulary(_train(docs), terms, 5000), "tfidf-vocabulary")
    weights = features.tfidf(docs, "doc_id", terms, vocab, sublinear=True)
    return weights.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query
def ml_count_vectors(spark, sf_dir):
    rows = _messages(spark, sf_dir).select("message_id", tx.normalise_sms(F.col("text")).alias("text"))
    counts = features.term_counts(rows, "message_id", tx.tokens(F.col("text")))
    return counts.select("message_id", "term", "n")


def _bayes(spark, sf_dir, scope="train"):
    """(ads, terms, vocabulary, fitted model); scope tells whether all rows or the training rows make the vocabulary."""
    docs = views.ads(spark, sf_dir)
    terms = tx.tokens(F.col("text"))
    train = _train(docs)
    # Written once: the vocabulary serves the training and the scoring features.
    vocab = materialise(features.vocabulary(train if scope == "train" else docs, terms, 5000), "bayes-vocabulary")
    return docs, terms, vocab, bayes.fit(features.weighted(train, terms, vocab), vocab)


def _bayes_score(spark, sf_dir, scope="train"):
    """(ads, a function that adds p and predicted to texts, streams included)."""
    docs, terms, vocab, fitted = _bayes(spark, sf_dir, scope)
    return docs, lambda texts: bayes.predict(features.weighted(texts, terms, vocab), fitted)


@query
def ml_naive_bayes(spark, sf_dir):
    _, _, vocab, (terms, _) = _bayes(spark, sf_dir)
    named = terms.join(F.broadcast(vocab.select("idx", "term")), "idx")
    return named.select("term", F.round("lp0", 6).alias("log_prob_0"), F.round("lp1", 6).alias("log_prob_1"))


@query
def ml_naive_bayes_counts(spark, sf_dir):
    rows = _messages(spark, sf_dir).withColumn("text", tx.normalise_sms(F.col("text")))
    terms = tx.tokens(F.col("text"))
    train = _train(rows, "message_id")
    fitted = bayes.fit_counts(train, terms, alpha=0.1)
    return fitted.select("term", F.round("lp0", 6).alias("log_prob_0"), F.round("lp1", 6).alias("log_prob_1"))


def _test_scores(spark, sf_dir, scope):
    docs, score = _bayes_score(spark, sf_dir, scope)
    test = corpus.random_split(docs, "doc_id").filter("split = 'test'").drop("p")
    return score(test).select("doc_id", F.round("p", 6).alias("p"), "predicted")


@query
def ml_predict(spark, sf_dir):
    return _test_scores(spark, sf_dir, "train")


@query
def ml_predict_fit_all(spark, sf_dir):
    """Vocabulary and idf from all rows, the classifier from the training rows."""
    return _test_scores(spark, sf_dir, "all")


def _forest(spark, sf_dir, trees=200, depth=20):
    """The service's model on the training part of ads, trained once an application and table and then loaded."""
    prepare(spark)
    featuriser = learning.Featuriser()
    path = shared(spark, f"forest-{trees}-{depth}", sf_dir)
    if not models.saved(spark, path):
        train = _train(views.ads(spark, sf_dir)).select("doc_id", "text", "label")
        models.save(learning.train(train, learning.random_forest(trees, depth), featuriser), featuriser, path)
    return models.load(spark, path, featuriser)


def _beats_majority(report_of):
    """(label, support, beats_majority): the support of each class, and whether more rows are right than the larger class has."""
    right = report_of.agg(F.count_if(F.col("label") == F.col("predicted")).alias("right"))
    classes = report_of.groupBy("label").agg(F.count("*").alias("support"))
    most = classes.agg(F.max("support").alias("most"))
    better = right.join(F.broadcast(most)).select((F.col("right") > F.col("most")).alias("b"))
    return classes.withColumn("beats_majority", better.scalar())


def _test_part(spark, sf_dir):
    return corpus.random_split(views.ads(spark, sf_dir), "doc_id").filter("split = 'test'").select("doc_id", "text", "label")


@query
def ml_random_forest(spark, sf_dir):
    model, featuriser = _forest(spark, sf_dir)
    return _beats_majority(learning.predict(_test_part(spark, sf_dir), model, featuriser))


@query
def ml_logistic(spark, sf_dir):
    """Messages cleaned and stemmed, one- and two-word terms of all messages, logistic regression on the training part."""
    rows = _messages(spark, sf_dir).select("message_id", tx.normalise_sms(F.col("text")).alias("text"), "label")
    rows = materialise(stemming.stem_text(rows, "message_id"), "stemmed")
    featuriser = learning.Featuriser(id_col="message_id", max_features=3000, sublinear=False)
    model = learning.train(_train(rows, "message_id"), learning.logistic, featuriser, fit_on=rows)
    test = corpus.random_split(rows, "message_id").filter("split = 'test'").drop("split")
    return _beats_majority(learning.predict(test, model, featuriser))


@query
def ml_augmented_forest(spark, sf_dir):
    """Variants of the fraudulent ads, a split by class, 8,000 terms, 300 trees."""
    ads = views.ads(spark, sf_dir)
    rows = augment.expand(ads.withColumn("category", F.when(F.col("label") == 1, "fake").otherwise("genuine")), "doc_id")
    rows = rows.select(F.concat_ws("-", "doc_id", "variant").alias("row_id"), "text", "label")
    rows = materialise(corpus.stratified_split(rows, "row_id"), "augmented")
    featuriser = learning.Featuriser(id_col="row_id", max_features=8000)
    train = rows.filter("split = 'train'").drop("split")
    model = learning.train(train, learning.random_forest(300, 30), featuriser)
    return _beats_majority(learning.predict(rows.filter("split = 'test'").drop("split"), model, featuriser))


def _gains(spark, sf_dir, model, featuriser):
    """(gains, strong): each term's impurity gain on the training rows, and whether the model agrees with them: the 50 terms
    of the largest gains hold eight times the importance that as many terms would hold on average."""
    train = _train(views.ads(spark, sf_dir))
    gains = materialise(features.term_gains(train, featuriser.terms(), featuriser.vocab), "gains")
    gains = gains.select("phrase", F.round("gain", 9).alias("gain"))
    top = gains.orderBy(F.desc("gain"), "phrase").limit(50)
    held = learning.feature_importance(model, featuriser).join(F.broadcast(top), "phrase", "left_semi")
    strong = held.agg((F.sum("importance") > 8 * 50.0 / featuriser.size).alias("s")).scalar()
    return gains, strong


@query
def ml_feature_importance(spark, sf_dir):
    gains, strong = _gains(spark, sf_dir, *_forest(spark, sf_dir))
    return gains.withColumn("strong", strong)


@query
def srt_top_keywords(spark, sf_dir):
    gains, strong = _gains(spark, sf_dir, *_forest(spark, sf_dir))
    top = gains.orderBy(F.desc("gain"), "phrase").limit(50)
    order = Window.orderBy(F.desc("gain"), "phrase")
    return top.withColumn("rank", F.row_number().over(order)).withColumn("strong", strong)


@query
def snk_model(spark, sf_dir):
    model, featuriser = _forest(spark, sf_dir)
    path = scratch(spark, "model")
    models.save(model, featuriser, path)
    loaded = models.load(spark, path, featuriser)
    test = _test_part(spark, sf_dir)
    before = learning.predict(test, model, featuriser).select("doc_id", F.col("p").alias("before"))
    after = learning.predict(test, *loaded).select("doc_id", "p")
    return after.join(before, "doc_id").select("doc_id", (F.abs(F.col("p") - F.col("before")) < 1e-12).alias("same"))


# --- streaming ---------------------------------------------------------------------------------------------------


# Rows arrive up to JITTER after their time, in parts that come one a trigger; the delay covers that, so no row is late.
STREAM_PARTS, STREAM_DELAY, JITTER = 5, 24 * 3600.0, 20 * 3600


def _arriving(spark, df, uid, ts, close=True):
    """A table as an arriving stream: parts in the order of arrival, a little out of order in time, read one by one.

    A part has as many files as the table has splits, and a trigger reads just these: the number of triggers does not grow with the
    table, and no trigger sees half a part, whose other half would be late. With close, a last part holds nothing but a time far
    ahead, so that the watermark passes every row of the table.
    """
    path = scratch(prepare(spark), "stream-in")
    seconds = F.unix_timestamp(F.col(ts).cast("timestamp")) + F.pmod(F.xxhash64(uid), F.lit(JITTER))
    rows = materialise(df.withColumn("_arrives", seconds), "arrivals")
    ends = rows.agg(F.min("_arrives").alias("first"), F.max("_arrives").alias("last"), F.max(ts).alias("newest")).first()
    step = ((ends.last or 0) - (ends.first or 0)) // STREAM_PARTS + 1
    part = (F.col("_arrives") - (ends.first or 0)) / step
    files = max(1, rows.rdd.getNumPartitions())
    nothing = spark.createDataFrame([], df.schema).coalesce(1)
    for number in range(STREAM_PARTS):
        rows.filter(F.floor(part) == number).drop("_arrives").repartition(files, uid, ts).write.mode("append").parquet(path)
        for _ in range((number + 1) * files - count_files(spark, path)):  # a file that got no rows was not written
            nothing.write.mode("append").parquet(path)
    if close and ends.newest:
        ahead = [F.lit(None).cast(kind).alias(c) if c != ts else F.lit(ends.newest + timedelta(days=30)).cast(kind).alias(c) for c, kind in df.dtypes]
        spark.range(1).select(*ahead).write.mode("append").parquet(path)
    return runs.read_stream(spark, path, files_per_trigger=files)


def _report_stream(spark, sf_dir, close=False):
    return _arriving(spark, views.reports(spark, sf_dir), "event_id", "received_at", close)


def _ad_stream(spark, sf_dir):
    documents = runs.read_stream(prepare(spark), f"{sf_dir}/documents.parquet")
    return views.ads_from(documents).withColumn("url", F.concat(F.lit("http://ads.example.xyz/"), F.col("doc_id").cast("string")))


@query
def st_screen(spark, sf_dir):
    out = screening.screened(_ad_stream(spark, sf_dir))
    return runs.drain(
        out.select("doc_id", "risk_score", "verdict", "fraud_category", "url_risk_score", "text_snippet"), "screened"
    )


@query
def st_screen_with_model(spark, sf_dir):
    """The trained model on a stream of ads: the same rows as jn_screen_with_model."""
    _, score = _bayes_score(spark, sf_dir)
    return runs.drain(_screened_by_model(_ad_stream(spark, sf_dir), score), "screened-by-model")


@query
def st_alerts(spark, sf_dir):
    out = screening.alerting(_ad_stream(spark, sf_dir), forced=F.col("p") == 0)
    return runs.drain(out.select("doc_id", "risk_score", "badge", "alert"), "alerts")


@query
def st_dedup_reports(spark, sf_dir):
    rows = greedy.deduplicate(views.reports(spark, sf_dir))
    return rows.select("event_id", "url_hash", "accepted", "origin")


@query
def st_dedup_reports_stream(spark, sf_dir):
    from ..functions.hashing import url_key

    stream = _report_stream(spark, sf_dir, close=True).withColumn("url_hash", url_key("url"))
    rows = sr.accepted_reports(stream, "dedup", "url_hash", "received_at", "event_id", 24 * 3600, 1, delay=STREAM_DELAY, finish=False, bulk=True)
    return rows.select("event_id", "url_hash", "accepted", "origin")


@query
def st_rate_limit(spark, sf_dir):
    rows = greedy.rate_limit(views.reports(spark, sf_dir), limit=2, seconds=24 * 3600)
    return rows.select("event_id", "client", "accepted")


@query
def st_rate_limit_stream(spark, sf_dir):
    stream = _report_stream(spark, sf_dir, close=True)
    rows = sr.accepted_reports(stream, "limit", "client", "received_at", "event_id", 24 * 3600, 2, delay=STREAM_DELAY, finish=False, bulk=True)
    return rows.select("event_id", "client", "accepted")


@query
def st_debounce(spark, sf_dir):
    stream = _arriving(spark, views.table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "event_id", "ts")
    return screening.debounced(stream, "user_id", "ts", "event_id", 3600, delay=STREAM_DELAY, finish=False)


@query
def st_report_stats(spark, sf_dir):
    return sr.running_stats(_report_stream(spark, sf_dir), today=F.lit(AS_OF).cast("date"))


@query
def st_learn_keywords(spark, sf_dir):
    return sr.learned_phrases(_report_stream(spark, sf_dir))
