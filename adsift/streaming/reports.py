"""Streams of reports: acceptance with state across batches, counters, keyword learning."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.greedy import HOT_ROWS, accept
from ..operators.reports import HIGH_RISK, phrase_counts
from ..session import exists, remove, scratch
from ..sources.report_files import as_rows
from .acceptance import AT, LATE, Acceptance
from .runs import DELAY_SECONDS, drain_batches

TIE = "_tie"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def accepted_reports(
    stream: DataFrame, name: str, key: str, ts: str, uid: str, window: float, limit: int,
    out: str | None = None, checkpoint: str | None = None, hot_rows: int = HOT_ROWS, file_rows: bool = False,
    delay: float = DELAY_SECONDS, finish: bool = True, bulk: bool = False,
) -> DataFrame:
    """Run the greedy acceptance over a stream and return the table of all decided rows.

    Rows wait in keyed state until the watermark (the newest time less `delay` seconds) has passed them and are then decided
    in time order, whatever the order of arrival (see Acceptance). What comes later than that is not decided; see late_rows.
    Each batch writes a folder of its own under `<out>/judged`, so a batch that runs twice leaves one copy. With `file_rows`,
    accepted rows are also stored in their filed shape under `<out>/table`, by batch and day. With `finish`, the result also
    holds the rows that still wait, decided as if nothing else came: they are read from the state and replayed by the
    batch operator, and the stream may go on from its state nevertheless.

    The state store is asked key by key, which serves a trickle of reports. With `bulk`, for batches of many keys, the same state
    is two tables under the checkpoint and a batch is decided by the batch operator; the rows are the same. A checkpoint goes on
    as it began.
    """
    spark = stream.sparkSession
    if bulk:
        return _in_bulk(stream, name, key, ts, uid, window, limit, out or scratch(spark, name), checkpoint or scratch(spark, f"{name}-checkpoint"), hot_rows, file_rows, delay, finish)
    # Lists and timers of a key need the store that keeps state outside the heap.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out, checkpoint = out or scratch(spark, name), checkpoint or scratch(spark, f"{name}-checkpoint")
    columns = stream.schema
    blank = F.coalesce(F.col(key).cast("string"), F.lit(""))
    # The mark's own column goes, so that late rows reach the operator instead of being dropped before it.
    marked = stream.withColumn("_key", blank).withColumn("_mark", F.col(ts).cast("timestamp")).withWatermark("_mark", f"{int(delay * 1000)} milliseconds")
    keyed = marked.withColumn(AT, F.unix_micros("_mark")).drop("_mark")
    held = T.StructType([*columns.fields, T.StructField(AT, T.LongType())])
    answer = [T.StructField("accepted", T.BooleanType()), T.StructField("origin", columns[uid].dataType), T.StructField(LATE, T.BooleanType())]
    result = T.StructType([*columns.fields, *answer])
    processor = Acceptance(held, uid, int(window * 1_000_000), limit)
    decided = keyed.groupBy("_key").transformWithState(processor, result, "append", "eventTime")

    def step(batch: DataFrame, number: int) -> None:
        target = f"{out}/judged/batch={number}"
        batch.write.mode("overwrite").parquet(target)
        if file_rows:
            _file(batch.sparkSession.read.schema(result).parquet(target), out, number)

    drain_batches(decided, name, step, checkpoint=checkpoint)
    done = _stored(spark, f"{out}/judged", result).filter(~F.col(LATE)).drop(LATE)
    if not finish or not exists(spark, f"{checkpoint}/state"):
        return done
    state = lambda variable: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load()
    waiting = state("waiting").select("list_element.*").drop(AT)
    seeds = state("taken").select(
        F.col("key._key").try_cast(columns[key].dataType).alias(key),
        F.timestamp_micros("list_element.at").cast(columns[ts].dataType).alias(ts), F.col("list_element.uid").alias(uid),
    )
    return done.unionByName(accept(waiting, key, ts, uid, window, limit, hot_rows, seeds).select(done.columns))


def _file(judged: DataFrame, out: str, number: int) -> None:
    rows = as_rows(judged.filter("accepted").drop("accepted", "origin", LATE))
    rows.write.mode("overwrite").partitionBy("filed_on").parquet(f"{out}/table/batch={number}")


def _in_bulk(
    stream: DataFrame, name: str, key: str, ts: str, uid: str, window: float, limit: int, out: str, checkpoint: str,
    hot_rows: int, file_rows: bool, delay: float, finish: bool,
) -> DataFrame:
    """accepted_reports with the state in tables: the mark in milliseconds, the rows that wait for it, and the rows that one window
    before it accepted, by batch under `<checkpoint>/held`. A batch reads the tables of the one before and writes its own, so it may run
    twice; a row is decided by the batch that moves the mark past it."""
    spark, held, span = stream.sparkSession, f"{checkpoint}/held", int(window * 1_000_000)
    columns = stream.schema
    kept = T.StructType([*columns.fields, T.StructField(AT, T.LongType()), T.StructField(TIE, T.StructType([T.StructField("batch", T.LongType()), T.StructField("row", T.LongType())]))])
    seed = T.StructType([columns[key], columns[ts], columns[uid]])
    result = T.StructType([*columns.fields, T.StructField("accepted", T.BooleanType()), T.StructField("origin", columns[uid].dataType), T.StructField(LATE, T.BooleanType())])
    table = lambda kind, number, schema: spark.read.schema(schema).parquet(f"{held}/{kind}/batch={number}") if number >= 0 else spark.createDataFrame([], schema)
    at = F.unix_micros(F.col(ts).cast("timestamp"))

    def decided(rows: DataFrame, seeds: DataFrame) -> DataFrame:
        return accept(rows, key, ts, uid, window, limit, hot_rows, seeds, tie=TIE).drop(AT, TIE)

    def step(batch: DataFrame, number: int) -> None:
        numbered = batch.withColumn(AT, at).withColumn(TIE, F.struct(F.lit(number).cast("long").alias("batch"), F.monotonically_increasing_id().alias("row")))
        numbered.write.mode("overwrite").parquet(f"{held}/came/batch={number}")
        came, before = table("came", number, kept), number - 1
        past = 0 if number == 0 else table("mark", before, "mark long").first().mark
        newest = came.agg(F.max(AT).alias("at")).first()["at"]
        mark = past if newest is None else max(past, newest // 1000 - int(delay * 1000))
        waits = table("waiting", before, kept).unionByName(came.filter(F.col(AT) >= past * 1000))
        taken = table("taken", before, seed)
        none = [F.lit(None).cast(result[c].dataType).alias(c) for c in ("accepted", "origin")]
        late = came.filter(F.col(AT).isNull() | (F.col(AT) < past * 1000)).select(*columns.names, *none, F.lit(True).alias(LATE))
        judged = decided(waits.filter(F.col(AT) < mark * 1000), taken).withColumn(LATE, F.lit(False))
        judged.unionByName(late).write.mode("overwrite").parquet(f"{out}/judged/batch={number}")
        judged = spark.read.schema(result).parquet(f"{out}/judged/batch={number}")
        if file_rows:
            _file(judged, out, number)
        waits.filter(F.col(AT) >= mark * 1000).write.mode("overwrite").parquet(f"{held}/waiting/batch={number}")
        both = taken.unionByName(judged.filter("accepted").select(key, ts, uid))
        both.filter(at > mark * 1000 - span).write.mode("overwrite").parquet(f"{held}/taken/batch={number}")
        spark.range(1).select(F.lit(mark).cast("long").alias("mark")).write.mode("overwrite").parquet(f"{held}/mark/batch={number}")
        remove(spark, f"{held}/came/batch={number}")
        for kind in ("mark", "waiting", "taken"):
            remove(spark, f"{held}/{kind}/batch={number - 2}")

    drain_batches(stream, name, step, checkpoint=checkpoint)
    done = _stored(spark, f"{out}/judged", result).filter(~F.col(LATE)).drop(LATE)
    if not finish or not exists(spark, f"{held}/mark"):
        return done
    last = spark.read.schema("mark long, batch long").parquet(f"{held}/mark").agg(F.max("batch").alias("n")).first().n
    return done.unionByName(decided(table("waiting", last, kept), table("taken", last, seed)).select(done.columns))


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What the batches wrote so far; nothing before the first one."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(schema.names)


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """The rows that came behind the mark, or without a time, and were not decided."""
    rows = spark.read.parquet(f"{out}/judged")
    return rows.filter(LATE).drop("accepted", "origin", LATE, "batch")


def filed_reports(stream: DataFrame, name: str, out: str | None = None, **options) -> DataFrame:
    """The report table, as its folder holds it: one kept report for each URL and day, evidence cut, by day under `<out>/table`.

    Reports that still wait for the watermark are not in it yet.
    """
    from ..functions.hashing import url_key

    spark = stream.sparkSession
    out = out or scratch(spark, name)
    hashed = stream.withColumn("url_hash", url_key("url"))
    accepted_reports(hashed, name, "url_hash", "received_at", "event_id", 24 * 3600, 1, out, file_rows=True, finish=False, **options)
    filed = as_rows(spark.createDataFrame([], hashed.schema)).schema
    return _stored(spark, f"{out}/table", filed)


def running_stats(
    stream: DataFrame, name: str = "report-stats", refresh: str | None = None, out: str | None = None,
    checkpoint: str | None = None, today: Column | None = None, ts: str = "received_at",
) -> DataFrame:
    """Totals over all reports so far; the newest version of the one-row table is returned.

    With `refresh` (such as "30 seconds") a version is made at that interval, otherwise once for all that is available;
    with `out` and `checkpoint` a restarted stream goes on counting. filed_today counts reports of the date `today`, the
    current one by default. Without any report all totals are 0.
    """
    spark = stream.sparkSession
    out = out or scratch(spark, name)

    # State holds a row a day; a batch is a static frame, so the current date may be asked for there.
    daily = stream.groupBy(F.col(ts).cast("date").alias("day")).agg(
        F.count("*").alias("n"), F.count_if(F.col("risk_score") >= HIGH_RISK).alias("high"),
        F.sum("risk_score").alias("total"), F.count("risk_score").alias("scored"),
    )

    def totals(days: DataFrame) -> DataFrame:
        zero = F.lit(0).cast("long")
        now = F.current_date() if today is None else today
        return days.withColumn("now", now).agg(
            F.coalesce(F.sum("n"), zero).alias("total_reports"),
            F.coalesce(F.sum("high"), zero).alias("high_risk"),
            F.coalesce(F.round(F.try_divide(F.sum("total"), F.sum("scored")), 1), F.lit(0.0)).alias("avg_risk_score"),
            F.coalesce(F.sum(F.when(F.col("day") == F.col("now"), F.col("n"))), zero).alias("filed_today"),
        )

    def step(batch: DataFrame, number: int) -> None:
        totals(batch).write.mode("overwrite").parquet(f"{out}/version={number}")
        remove(batch.sparkSession, f"{out}/version={number - 2}")

    drain_batches(daily, name, step, mode="complete", checkpoint=checkpoint, every=refresh)
    empty = totals(spark.createDataFrame([], daily.schema))
    try:
        versions = spark.read.schema(f"{_ddl(empty)}, version long").parquet(out)
    except AnalysisException:
        return empty
    newest = versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == newest).drop("version") if newest is not None else empty


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in df.dtypes)


def learned_phrases(
    stream: DataFrame, name: str = "learn", min_count: int = 3, out: str | None = None, checkpoint: str | None = None,
) -> DataFrame:
    """Phrase counts kept batch by batch; a scheduled run adds what arrived since the last one.

    Each batch merges its counts with the table of the batch before into one of its own and removes the one before that, so
    there is one table however many batches there were, and a batch may run twice.
    """
    spark = stream.sparkSession
    out = out or scratch(spark, name)
    schema = "phrase string, n long"

    def step(batch: DataFrame, number: int) -> None:
        counts = phrase_counts(batch, min_count=1)
        if number:
            before = batch.sparkSession.read.schema(schema).parquet(f"{out}/batch={number - 1}")
            counts = counts.unionByName(before).groupBy("phrase").agg(F.sum("n").alias("n"))
        counts.write.mode("overwrite").parquet(f"{out}/batch={number}")
        remove(batch.sparkSession, f"{out}/batch={number - 2}")

    drain_batches(stream, name, step, checkpoint=checkpoint or f"{out}-checkpoint")
    if not exists(spark, out):
        return spark.createDataFrame([], schema)
    counts = spark.read.schema(f"{schema}, batch long").parquet(out)
    newest = counts.agg(F.max("batch")).first()[0]
    return counts.filter((F.col("batch") == newest) & (F.col("n") >= min_count)).drop("batch")
