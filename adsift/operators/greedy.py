"""Greedy acceptance: at most `limit` accepted rows of a key within any `window` seconds.

With limit 1 this is deduplication against the kept row; with a larger limit it is a rate limiter whose rejected hits
are not recorded. Whether a row is accepted depends on earlier accepted rows, so no window frame expresses it.

Ordinary keys are sorted in their partition and replayed with at most `limit` times in memory. A key with more than
`hot_rows` rows is never sent to one task; its timeline is cut into cells of one window.

With limit 1 every row points to the row that would be accepted next if it were accepted itself: the first one a window
later, which lies in the next cell or begins the next one that holds rows. Following the pointers from a key's first row gives
what is accepted, and doubling them (a pointer's pointer) finds all of it in a logarithmic number of rounds.

With a larger limit the state is several times and cannot be doubled. But behind a gap of a whole window the state is
empty, so the pieces between such gaps are decided side by side. Inside a piece, neighbouring cells are taken together up
to `hot_rows` rows and replayed at once; the number of rounds follows the rows of the longest piece, not its cells. A cell
that is larger by itself is first reduced: the times at which earlier rows expire cut it into at most limit + 1 stretches,
and the accepted rows of a stretch are its first ones, so the first `limit` rows of each stretch, found by a rank with a
map-side limit, are all the candidates.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise, scratch

HOT_ROWS = 1_000_000
STEP_FILES = 16
_KEY, _TS, _SEED, _OWN = "_key", "_ts", "_seed", "_own_uid"


def accept(
    df: DataFrame,
    key: str,
    ts: str,
    uid: str,
    window: float,
    limit: int = 1,
    hot_rows: int = HOT_ROWS,
    seeds: DataFrame | None = None,
    tie: str | None = None,
) -> DataFrame:
    """Add `accepted` and `origin` (uid of the latest accepted row of the key, itself when accepted) to df.

    `uid` is unique and breaks ties of `ts`; where it may repeat, `tie` names a column that tells such rows apart. `seeds` holds
    rows (key, ts, uid) accepted earlier, all of them before the rows of df. A null key counts as blank.
    """
    span = int(window * 1_000_000)
    keyed = _keyed(df, key, ts)
    past = None if seeds is None else _keyed(seeds, key, ts).select(_KEY, _TS, F.col(uid).alias(uid))
    counts = keyed.groupBy(_KEY).agg(F.count("*").alias("_n"))
    # Up to (all rows / hot_rows) keys, as a table: Spark broadcasts it where it is small enough.
    hot = materialise(counts.filter(F.col("_n") > hot_rows).select(_KEY), "hot-keys")
    if hot.isEmpty():
        return _replay(keyed, past, uid, span, limit).drop(_KEY, _TS)
    cold = keyed.join(hot, _KEY, "left_anti")
    cold_past = None if past is None else past.join(hot, _KEY, "left_anti")
    warm = keyed.join(hot, _KEY, "left_semi")
    warm_past = None if past is None else past.join(hot, _KEY, "left_semi")
    done = _replay(cold, cold_past, uid, span, limit)
    if tie is None:
        return done.unionByName(_replay_hot(warm, warm_past, uid, span, limit, hot_rows)).drop(_KEY, _TS)
    none = F.lit(None).cast(df.schema[tie].dataType)
    warm = warm.withColumn(_OWN, F.struct(F.col(uid).alias("uid"), F.col(tie).alias("tie")))
    if warm_past is not None:
        warm_past = warm_past.select(_KEY, _TS, F.struct(F.col(uid).alias("uid"), none.alias("tie")).alias(_OWN))
    hot_done = _replay_hot(warm, warm_past, _OWN, span, limit, hot_rows).withColumn("origin", F.col("origin.uid")).drop(_OWN)
    return done.unionByName(hot_done).drop(_KEY, _TS)


def _keyed(df: DataFrame, key: str, ts: str) -> DataFrame:
    blank = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return df.withColumn(_KEY, blank).withColumn(_TS, F.unix_micros(F.col(ts).cast("timestamp")))


def _replay(df: DataFrame, past: DataFrame | None, uid: str, span: int, limit: int) -> DataFrame:
    """Sort each partition by key and time and walk it once; memory is `limit` times for the current key."""
    rows = df.withColumn(_SEED, F.lit(False))
    if past is not None:
        rows = rows.unionByName(past.withColumn(_SEED, F.lit(True)), allowMissingColumns=True)
    names = rows.columns
    at = {c: names.index(c) for c in (_KEY, _TS, _SEED, uid)}
    fields = [f for f in df.schema.fields] + [
        T.StructField("accepted", T.BooleanType()),
        T.StructField("origin", df.schema[uid].dataType),
    ]
    keep = [i for i, c in enumerate(names) if c != _SEED]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, times, last = None, deque(), None
        for batch in batches:
            keys, stamps, seeded, ids = (batch.column(at[c]).to_pylist() for c in (_KEY, _TS, _SEED, uid))
            taken, origin, mine = [], [], []
            for k, t, s, i in zip(keys, stamps, seeded, ids):
                if k != current:
                    current, last = k, None
                    times.clear()
                while times and t - times[0] >= span:
                    times.popleft()
                ok = s or len(times) < limit
                if ok:
                    times.append(t)
                    last = i
                taken.append(ok)
                origin.append(last)
                mine.append(not s)
            arrays = [batch.column(i) for i in keep]
            arrays += [pa.array(taken, pa.bool_()), pa.array(origin, batch.column(at[uid]).type)]
            out = pa.RecordBatch.from_arrays(arrays, names=[names[i] for i in keep] + ["accepted", "origin"])
            yield out if all(mine) else out.filter(pa.array(mine))

    placed = rows.repartition(_KEY).sortWithinPartitions(_KEY, _TS, F.desc(_SEED), uid)
    return placed.mapInArrow(walk, T.StructType(fields))


def _replay_hot(df: DataFrame, past: DataFrame | None, uid: str, span: int, limit: int, hot_rows: int) -> DataFrame:
    cell = F.floor(F.col(_TS) / F.lit(span)).cast("bigint")
    stored = materialise(df.select(_KEY, _TS, uid).withColumn("cell", cell), "greedy-rows")
    seeds = None if past is None else materialise(past.select(_KEY, _TS, uid), "greedy-seeds")
    taken = _chained(stored, seeds, uid, span) if limit == 1 else _stepped(stored, seeds, uid, span, limit, hot_rows)
    if seeds is not None:
        taken = taken.unionByName(seeds.withColumn("cell", cell))

    # The origin of a row is the last accepted row up to it, which lies in its own cell or in an earlier one. A key has
    # one row a cell here, so the window is as long as its history, not as its rows.
    own = taken.groupBy(_KEY, "cell").agg(F.sort_array(F.collect_list(F.struct(_TS, uid))).alias("_own"))
    every = stored.select(_KEY, "cell").unionByName(taken.select(_KEY, "cell")).distinct()
    order = Window.partitionBy(_KEY).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    lists = every.join(own, [_KEY, "cell"], "left").withColumn("_end", F.try_element_at("_own", F.lit(-1)))
    lists = lists.withColumn("_prev", F.last("_end", ignorenulls=True).over(order)).drop("_end")
    everywhere = df.withColumn("cell", cell)
    joined = everywhere.join(lists, [_KEY, "cell"], "left")
    here = F.filter("_own", lambda a: (a[_TS] < F.col(_TS)) | ((a[_TS] == F.col(_TS)) & (a[uid] <= F.col(uid))))
    mine = F.coalesce(F.try_element_at(here, F.lit(-1)), F.col("_prev"))
    out = joined.withColumn("_from", mine)
    return out.select(
        *df.columns,
        F.coalesce(F.exists("_own", lambda a: a[uid] == F.col(uid)), F.lit(False)).alias("accepted"),
        F.col("_from")[uid].alias("origin"),
    )


def _chained(rows: DataFrame, seeds: DataFrame | None, uid: str, span: int) -> DataFrame:
    """The accepted rows (limit 1) of rows: key, time, uid, cell."""
    node = F.struct(_TS, uid)
    starts = rows if seeds is None else rows.join(seeds.groupBy(_KEY).agg(F.max(_TS).alias("_seeded")), _KEY, "left").where(
        F.col("_seeded").isNull() | (F.col(_TS) - F.col("_seeded") >= span))
    taken = materialise(starts.groupBy(_KEY).agg(F.min(node).alias("at")), "chain")

    # A key has one row a cell here.
    by_cell = Window.partitionBy(_KEY).orderBy("cell")
    firsts = rows.groupBy(_KEY, "cell").agg(F.min(node).alias("first"))
    next_cell = F.lead("cell").over(by_cell)
    beyond = F.when(next_cell == F.col("cell") + 1, F.lead("first", 2).over(by_cell)).otherwise(F.lead("first").over(by_cell))
    beyond = firsts.select(_KEY, "cell", beyond.alias("beyond"))
    none = F.lit(None).cast(firsts.schema["first"].dataType)
    given = rows.select(_KEY, "cell", F.col(_TS).alias("at"), F.lit(0).alias("asks"), node.alias("here"), none.alias("beyond"))
    asked = rows.join(beyond, [_KEY, "cell"]).select(
        _KEY, (F.col("cell") + 1).alias("cell"), (F.col(_TS) + span).alias("at"), F.lit(1).alias("asks"), node.alias("here"), "beyond")
    # From the latest back: what was given last is the first row at or after the time asked for.
    back = Window.partitionBy(_KEY, "cell").orderBy(F.desc("at"), "asks", F.desc("here")).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("asks") == 0, F.col("here")), ignorenulls=True).over(back)
    both = given.unionByName(asked).withColumn("found", found).where("asks = 1")
    jumps = both.select(_KEY, F.col("here").alias("at"), F.coalesce("found", "beyond").alias("to")).where("to is not null")
    jumps = materialise(jumps, "jumps")
    # Only what something points to can be reached.
    met = jumps.select(_KEY, F.col("to").alias("at")).unionByName(taken).distinct()
    jumps = materialise(jumps.join(met, [_KEY, "at"], "left_semi"), "jumps")
    while not jumps.isEmpty():
        reached = taken.join(jumps, [_KEY, "at"]).select(_KEY, F.col("to").alias("at"))
        taken = materialise(taken.unionByName(reached), "chain")
        further = jumps.select(_KEY, F.col("at").alias("to"), F.col("to").alias("_to"))
        jumps = materialise(jumps.join(further, [_KEY, "to"]).select(_KEY, "at", F.col("_to").alias("to")), "jumps")
    cell = F.floor(F.col(_TS) / F.lit(span)).cast("bigint")
    return taken.select(_KEY, "at.*").withColumn("cell", cell)


def _stepped(rows: DataFrame, seeds: DataFrame | None, uid: str, span: int, limit: int, hot_rows: int) -> DataFrame:
    """The accepted rows of rows: key, time, uid, cell; pieces side by side, and the blocks of a piece one after the other."""
    spark = rows.sparkSession
    # A key has one row a cell here.
    by_cell = Window.partitionBy(_KEY).orderBy("cell")
    cells = rows.groupBy(_KEY, "cell").agg(F.count("*").alias("n"), F.min(_TS).alias("low"), F.max(_TS).alias("high"))
    apart = F.coalesce(F.col("low") - F.lag("high").over(by_cell) >= span, F.lit(False))
    cells = cells.withColumn("piece", F.sum(apart.cast("long")).over(by_cell))
    in_piece = Window.partitionBy(_KEY, "piece").orderBy("cell")
    ahead = F.sum("n").over(in_piece) - F.col("n")
    cells = cells.withColumn("big", F.col("n") > hot_rows).withColumn("bucket", F.floor(ahead / F.lit(hot_rows)))
    # A piece's first cell is in step 0, a big one too.
    new = F.lag("bucket").over(in_piece).isNotNull() & ((F.col("bucket") != F.lag("bucket").over(in_piece)) | F.col("big") | F.lag("big").over(in_piece))
    cells = cells.withColumn("step", F.sum(F.coalesce(new, F.lit(False)).cast("long")).over(in_piece))
    placed = rows.join(cells.select(_KEY, "cell", "piece", "big", "step"), [_KEY, "cell"])
    base = scratch(spark, "greedy")
    # A few files a step, however many tasks the input has and however full a cell is.
    placed.repartition("step", F.pmod(F.xxhash64(uid), F.lit(STEP_FILES))).write.partitionBy("step").parquet(f"{base}/rows")
    schema = placed.drop("step").schema
    last = spark.read.schema(placed.schema).parquet(f"{base}/rows").agg(F.max("step")).first()[0]

    before = rows.limit(0).select(_KEY, _TS, uid, F.lit(0).cast("long").alias("piece"))
    if seeds is not None:
        before = seeds.withColumn("piece", F.lit(0).cast("long"))
    paths = []
    for step in range((-1 if last is None else last) + 1):
        block = spark.read.schema(schema).parquet(f"{base}/rows/step={step}")
        # At most `limit` times a piece in the window before its block.
        expiry = before.groupBy(_KEY, "piece").agg(F.sort_array(F.collect_list(F.col(_TS) + span)).alias("_expiry"))
        staged = block.where("big").join(expiry, [_KEY, "piece"], "left").withColumn(
            "_stretch", F.coalesce(F.size(F.filter("_expiry", lambda x: x <= F.col(_TS))), F.lit(0)))
        rank = F.row_number().over(Window.partitionBy(_KEY, "piece", "_stretch").orderBy(_TS, uid))
        large = staged.withColumn("_rank", rank).filter(F.col("_rank") <= limit).select(block.columns)
        both = block.where("not big").unionByName(large)
        # A piece of a key is replayed as a key of its own; seeds keep to the pieces that follow them.
        name = F.concat(F.col("piece").cast("string"), F.lit(":"), F.col(_KEY))
        alone = lambda rows, name=name: rows.withColumn("_own_key", F.col(_KEY)).withColumn(_KEY, name)
        decided = _replay(alone(both), alone(before).select(_KEY, _TS, uid), uid, span, limit).filter("accepted")
        done = decided.select(F.col("_own_key").alias(_KEY), _TS, uid, "cell", "piece")
        path = f"{base}/accepted/step={step}"
        done.write.parquet(path)
        paths.append(path)
        done = spark.read.schema(done.schema).parquet(path)
        # What the next block of a piece has to know: at most `limit` rows of the last window.
        newest = Window.partitionBy(_KEY, "piece").orderBy(F.desc(_TS), F.desc(uid))
        both = before.unionByName(done.select(before.columns)).withColumn("_rank", F.row_number().over(newest))
        before = materialise(both.filter(F.col("_rank") <= limit).drop("_rank"), "greedy-before")
    if not paths:
        return rows.limit(0)
    return spark.read.schema(rows.schema).parquet(*paths)


def deduplicate(
    df: DataFrame, url: str = "url", ts: str = "received_at", uid: str = "event_id", hours: float = 24,
    skip_blank: bool = False, **options,
) -> DataFrame:
    """Reports with url_hash, accepted and origin: a report is a duplicate while a kept one is under 24 h old.

    Blank URLs share one hash, so they suppress each other; skip_blank keeps every one of them.
    """
    from ..functions.hashing import url_key

    hashed = df.withColumn("url_hash", url_key(url))
    if not skip_blank:
        return accept(hashed, "url_hash", ts, uid, hours * 3600, 1, **options)
    blank = F.coalesce(F.col(url), F.lit("")) == ""
    alone = hashed.filter(blank).withColumn("accepted", F.lit(True)).withColumn("origin", F.col(uid))
    return accept(hashed.filter(~blank), "url_hash", ts, uid, hours * 3600, 1, **options).unionByName(alone)


def rate_limit(
    df: DataFrame, client: str = "client", ts: str = "received_at", uid: str = "event_id", limit: int = 20,
    seconds: float = 3600, **options,
) -> DataFrame:
    """Reports with `accepted`: at most `limit` for each client in any `seconds`; rejected hits do not count."""
    return accept(df, client, ts, uid, seconds, limit, **options).drop("origin")
