"""The registered queries as a whole, and a sample of them against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
from adsift.plans import queries as entry_queries
from adsift.plans.oracles import ORACLES
from adsift.plans.queries import QUERIES
from adsift.session import scratch

SAMPLE = [
    "jn_screen_assemble", "rule_url_flags", "agg_keyword_map", "agg_class_report", "win_roc_curve", "win_stratified_split",
    "st_dedup_reports", "st_rate_limit", "win_chatter_gap", "set_distinct_text", "aug_synonyms", "prj_page_text",
]
# Queries without a SQL twin.
NO_SQL: set[str] = set()


def test_every_query_has_sql_or_a_reason():
    names, sql = set(QUERIES), set(ORACLES)
    assert sql <= names and names - sql == NO_SQL
    assert names <= set(entry.queries()) and sql <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    frame = entry.entry(spark)
    assert {"doc_id", "risk_score", "verdict"} <= set(frame.columns) and frame.count() > 0


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in check.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, sf_dir, name):
    result, _ = check.compare(spark, con, sf_dir, name, entry.queries()[name], entry.oracle_sql()[name])
    assert result.startswith("ok") and "EMPTY" not in result


@pytest.mark.parametrize(
    "batch,stream", [("agg_phrase_counts", "st_learn_keywords"), ("st_dedup_reports", "st_dedup_reports_stream"),
                     ("st_rate_limit", "st_rate_limit_stream"), ("win_chatter_gap", "st_debounce")]
)
def test_stream_equals_batch(spark, sf_dir, batch, stream):
    queries = entry.queries()
    a, b = queries[batch](spark, sf_dir), queries[stream](spark, sf_dir)
    cols = sorted(a.columns)
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def test_top_words_limit_before_shuffle(spark, sf_dir):
    plan = entry.queries()["win_top_words"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", ["snk_keyword_bank", "snk_model", "srt_top_keywords", "ml_feature_importance"])
def test_queries_train_the_services_forest(spark, sf_dir, monkeypatch, name):
    from adsift.operators import learning
    from adsift.sources import models

    class Seen(Exception):
        pass

    def train(df, estimator, featuriser):
        raise Seen(estimator.getNumTrees(), estimator.getMaxDepth())

    monkeypatch.setattr(learning, "train", train)
    monkeypatch.setattr(models, "saved", lambda spark, path: False)
    with pytest.raises(Seen) as seen:
        entry.queries()[name](spark, sf_dir)
    assert seen.value.args == (200, 20)


def test_wrong_model_is_noticed(spark, sf_dir, monkeypatch):
    """A forest that was trained on labels without sense fails the facts that the queries about it state."""
    from adsift.operators import learning
    from adsift.sources import models

    whole = learning.train

    def train(df, estimator, featuriser, fit_on=None):
        return whole(df.withColumn("label", (F.xxhash64("doc_id") % 2 == 0).cast("int")), learning.random_forest(5, 5), featuriser, fit_on)

    monkeypatch.setattr(learning, "train", train)
    monkeypatch.setattr(models, "saved", lambda spark, path: False)
    monkeypatch.setattr(entry_queries, "shared", lambda spark, name, *of: scratch(spark, "wrong-model"))
    assert [r.strong for r in entry.queries()["srt_top_keywords"](spark, sf_dir).collect()] == [False] * 50


def test_screening_with_the_model_has_no_exchange(spark, sf_dir):
    """Once the model is fitted, neither the batch nor the stream moves a row, and both give the same."""
    queries = entry.queries()
    batch = queries["jn_screen_with_model"](spark, sf_dir)
    plan = batch._jdf.queryExecution().executedPlan().toString()
    # A table of one file is dealt out to the cores first (see session.spread); nothing moves by a key.
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "Join" not in plan
    stream = queries["st_screen_with_model"](spark, sf_dir)
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream.select(batch.columns).collect()))


def test_stream_parts_arrive_whole(spark):
    """A table of many splits arrives in as many triggers as one of a single split, and none of its rows comes late."""
    from datetime import datetime, timedelta

    from adsift.streaming import reports as sr

    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    out, checkpoint = scratch(spark, "out"), scratch(spark, "checkpoint")
    try:
        rows = [(i, f"k{i % 7}", datetime(2024, 1, 1) + timedelta(minutes=20 * i)) for i in range(2000)]
        table = spark.createDataFrame(rows, "uid long, k string, ts timestamp_ntz").repartition(4)
        stream = entry_queries._arriving(spark, table, "uid", "ts")
        got = sr.accepted_reports(stream, "t", "k", "ts", "uid", 3600, 1, out, checkpoint, delay=entry_queries.STREAM_DELAY, finish=False)
        assert got.count() == 2000 and sr.late_rows(spark, out).filter("uid is not null").count() == 0
        from pathlib import Path

        sources = [p for p in Path(checkpoint, "sources", "0").glob("[0-9]*")]
        assert len(sources) == entry_queries.STREAM_PARTS + 1
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_registered_streams_do_not_ask_state_key_by_key(spark, sf_dir, monkeypatch):
    """Their batches hold many keys: the state is in tables, and the answers are those of the batch job."""
    from adsift.streaming import reports as sr

    def asked(*given):
        raise AssertionError("a processor that is called once a key")

    monkeypatch.setattr(sr, "Acceptance", asked)
    queries = entry.queries()
    for name in ("st_dedup_reports", "st_rate_limit"):
        stream = queries[f"{name}_stream"](spark, sf_dir)
        assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, queries[name](spark, sf_dir).select(stream.columns).collect()))
    assert queries["snk_reports_table"](spark, sf_dir).count() == queries["st_dedup_reports"](spark, sf_dir).filter("accepted").count()


def test_tfidf_counts_its_vocabulary_once(spark, sf_dir, monkeypatch):
    """The weights and the names of the terms read a stored vocabulary instead of counting all terms again."""
    from adsift.operators import features

    plans = []
    whole = features.tfidf

    def tfidf(docs, id_col, terms, vocab, **options):
        plans.append(vocab._jdf.queryExecution().optimizedPlan().toString())
        return whole(docs, id_col, terms, vocab, **options)

    monkeypatch.setattr(features, "tfidf", tfidf)
    entry.queries()["ml_tfidf"](spark, sf_dir)
    assert len(plans) == 1 and "Aggregate" not in plans[0]
