"""Greedy acceptance against a sequential replay, on ordinary and on hot keys."""

import random
from collections import defaultdict, deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from adsift.operators import bursts, greedy
from adsift.session import scratch
from adsift.streaming import reports as sr, runs, screening

START = datetime(2024, 1, 1)
SCHEMA = "uid bigint, k string, ts timestamp_ntz"


def make(n, keys, hours, seed):
    rng = random.Random(seed)
    rows = []
    for uid in range(n):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(keys)}"
        rows.append((uid, key, START + timedelta(seconds=int(rng.random() * hours * 3600))))
    return rows


def replay(rows, window, limit):
    out, kept, last = {}, defaultdict(deque), {}
    for uid, key, ts in sorted(rows, key=lambda r: (r[1] or "", r[2], r[0])):
        times = kept[key]
        while times and (ts - times[0]).total_seconds() >= window:
            times.popleft()
        ok = len(times) < limit
        if ok:
            times.append(ts)
            last[key] = uid
        out[uid] = (ok, last[key])
    return out


@pytest.mark.parametrize("limit,hot_rows,partitions", [(1, 10**6, 1), (1, 50, 4), (3, 10**6, 8), (3, 50, 4), (7, 50, 4)])
def test_accept_equals_replay(spark, limit, hot_rows, partitions):
    rows = make(500, 6, 5, limit)
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    got = greedy.accept(df, "k", "ts", "uid", 3600, limit, hot_rows)
    assert {r.uid: (r.accepted, r.origin) for r in got.collect()} == replay(rows, 3600, limit)


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_cells_that_accept_nothing(spark, limit):
    """Cells whose rows are all rejected, gaps of a whole window and long pieces without one."""
    rng, rows, at = random.Random(limit), [], 0
    for uid in range(400):
        at += rng.choice([1, 1, 1, 5, 900, 1700, 3599, 3600, 3601, 9000]) if uid % 7 else 1
        rows.append((uid, "a" if uid % 3 else None, START + timedelta(seconds=at)))
    df = spark.createDataFrame(rows, SCHEMA)
    for hot_rows in (3, 20, 150):
        got = greedy.accept(df, "k", "ts", "uid", 3600, limit, hot_rows)
        assert {r.uid: (r.accepted, r.origin) for r in got.collect()} == replay(rows, 3600, limit)


def jobs_of(spark, df, limit, hot_rows):
    """How many jobs the acceptance of df runs."""
    group = f"greedy-{random.random()}"
    spark.sparkContext.setJobGroup(group, "count")
    greedy.accept(df, "k", "ts", "uid", 3600, limit, hot_rows).write.format("noop").mode("overwrite").save()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_do_not_follow_the_cells(spark):
    """As many rows over 10 and over 1,000 cells: with a larger limit as many jobs, with limit 1 a logarithm more."""
    jobs = {}
    for cells in (10, 1000):
        rows = [(i, "a", START + timedelta(seconds=i * cells * 3600 // 2000)) for i in range(2000)]
        df = spark.createDataFrame(rows, SCHEMA)
        jobs[cells] = [jobs_of(spark, df, limit, 500) for limit in (1, 3)]
    assert jobs[1000][1] <= jobs[10][1] + 4 and jobs[1000][0] <= jobs[10][0] + 12 * 7
    assert max(jobs[1000]) < 200


def test_exact_gap_is_kept(spark):
    rows = [(1, "a", START), (2, "a", START + timedelta(hours=24)), (3, "a", START + timedelta(hours=47, minutes=59))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.uid: r.accepted for r in greedy.accept(df, "k", "ts", "uid", 24 * 3600).collect()}
    assert got == {1: True, 2: True, 3: False}


def test_blank_urls(spark):
    rows = [(1, "", START), (2, None, START + timedelta(hours=1)), (3, "http://x", START)]
    df = spark.createDataFrame(rows, SCHEMA)
    args = dict(url="k", ts="ts", uid="uid")
    assert {r.uid for r in greedy.deduplicate(df, **args).filter("accepted").collect()} == {1, 3}
    kept = greedy.deduplicate(df, **args, skip_blank=True).filter("accepted")
    assert {r.uid for r in kept.collect()} == {1, 2, 3}


def test_dedup_is_idempotent(spark):
    df = spark.createDataFrame(make(300, 5, 100, 9), SCHEMA)
    kept = greedy.accept(df, "k", "ts", "uid", 3600).filter("accepted").select("uid", "k", "ts")
    assert greedy.accept(kept, "k", "ts", "uid", 3600).filter("NOT accepted").count() == 0


@pytest.mark.parametrize("hot_rows", [10**6, 40])
def test_stream_continues_across_batches(spark, hot_rows):
    rows = make(400, 5, 4, 4)  # in no order of time
    path, out = scratch(spark, "in"), scratch(spark, "out")
    checkpoint = scratch(spark, "checkpoint")
    for part in (rows[:150], rows[150:160], rows[160:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = runs.read_stream(spark, path)
        got = sr.accepted_reports(
            stream, "t", "k", "ts", "uid", 3600, 2, out=out, checkpoint=checkpoint, hot_rows=hot_rows, delay=10**7
        )
    assert sr.late_rows(spark, out).count() == 0
    assert {r.uid: r.accepted for r in got.collect()} == {u: a for u, (a, _) in replay(rows, 3600, 2).items()}


def test_late_rows_go_aside(spark):
    path, out, checkpoint = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "checkpoint")
    parts = [[(1, "a", START), (2, "b", START + timedelta(hours=2))], [(3, "a", START + timedelta(hours=1)), (4, "a", START + timedelta(hours=3))]]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        got = sr.accepted_reports(
            runs.read_stream(spark, path), "t", "k", "ts", "uid", 3600, 1, out=out, checkpoint=checkpoint, delay=1800
        )
    assert {r.uid for r in got.collect()} == {1, 2, 4}
    assert [r.uid for r in sr.late_rows(spark, out).collect()] == [3]


def test_stream_in_time_order_with_a_short_delay(spark):
    """Rows a little out of order, a delay that covers it: decided batch by batch as the batch job would."""
    rows = sorted(make(400, 5, 4, 4), key=lambda r: r[2] + timedelta(seconds=hash(r[0] * 7919) % 1200))
    path, out, checkpoint = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "checkpoint")
    for k in range(0, 400, 100):
        spark.createDataFrame(rows[k : k + 100], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        got = sr.accepted_reports(
            runs.read_stream(spark, path), "t", "k", "ts", "uid", 3600, 2, out=out, checkpoint=checkpoint, delay=1200
        )
    batches = spark.read.parquet(f"{out}/judged").groupBy("batch").count().collect()
    assert len(batches) > 2 and sum(r["count"] for r in batches) > 200
    assert {r.uid: (r.accepted, r.origin) for r in got.collect()} == replay(rows, 3600, 2)


@pytest.mark.parametrize("limit,hot_rows", [(1, 10**6), (2, 15)])
def test_a_stream_with_its_state_in_tables_decides_the_same(spark, limit, hot_rows):
    """Decided batch by batch as a replay does; late rows go aside, of rows that come twice each is decided, a batch may run twice."""
    from pathlib import Path

    rows = sorted(make(200, 5, 4, 4), key=lambda r: r[2] + timedelta(seconds=hash(r[0] * 7919) % 1200))
    parts = [[r for r in rows[k : k + 70] for _ in range(1 + (r[0] % 9 == 0))] for k in range(0, 200, 70)]
    everything = [r for part in parts for r in part] + [(902, None, START + timedelta(hours=5))]
    late = [(900, "hot", START - timedelta(hours=9)), (901, "hot", None), (None, "k3", START - timedelta(hours=9))]
    parts.append([*late, everything[-1]])
    path, out, checkpoint = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "checkpoint")

    def go(finish):
        got = sr.accepted_reports(
            runs.read_stream(spark, path), "t", "k", "ts", "uid", 3600, limit, out=out, checkpoint=checkpoint, hot_rows=hot_rows, delay=1200, finish=finish, bulk=True
        )
        return sorted((r.uid, r.accepted, r.origin) for r in got.collect())

    sizes = []
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        sizes.append(len(go(False)))
    assert 0 < sizes[0] < sizes[1] < sizes[2] < sizes[3] == len(everything) - 1
    commits = sorted(Path(checkpoint, "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for name in (commits[-1].name, f".{commits[-1].name}.crc"):
        Path(checkpoint, "commits", name).unlink(missing_ok=True)
    assert len(go(False)) == sizes[3]
    # Rows by their place: a second copy of a row stands right behind the first.
    placed = [(i, k, t) for i, (_, k, t) in enumerate(sorted(everything, key=lambda r: (r[1] or "", r[2], r[0])))]
    uids = [u for u, _, _ in sorted(everything, key=lambda r: (r[1] or "", r[2], r[0]))]
    assert go(True) == sorted((uids[i], ok, uids[last]) for i, (ok, last) in replay(placed, 3600, limit).items())
    assert sorted(str(r.uid) for r in sr.late_rows(spark, out).collect()) == ["900", "901", "None"]
    held = {v: spark.read.parquet(f"{checkpoint}/held/{v}") for v in ("waiting", "taken")}
    assert held["waiting"].filter("batch = 3").count() == 1 and held["waiting"].select("batch").distinct().count() <= 2
    assert held["taken"].filter("batch = 3").count() < 20


def test_state_follows_the_window(spark):
    """What a key holds in state is what waits and what one window accepted; a key that falls silent holds nothing."""
    path, out, checkpoint = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "checkpoint")
    rows = [(i, f"k{i // 40}", START + timedelta(minutes=5 * i)) for i in range(400)]
    for k in range(0, 400, 80):
        spark.createDataFrame(rows[k : k + 80], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        got = sr.accepted_reports(
            runs.read_stream(spark, path), "t", "k", "ts", "uid", 1800, 2, out=out, checkpoint=checkpoint, delay=600, finish=False
        )
    held = {v: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", v).load() for v in ("waiting", "taken")}
    assert {r.key[0] for r in held["taken"].collect()} <= {"k9"} and held["taken"].count() <= 2
    assert 0 < held["waiting"].count() <= 4 and got.count() == 400 - held["waiting"].count()


def test_a_batch_that_runs_twice_leaves_one_copy(spark):
    """The report table is what its folder holds; the last batch is run again from a checkpoint that lost its commit."""
    from pathlib import Path

    path, out, checkpoint = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "checkpoint")
    for k in range(4):
        rows = [(10 * k + i, f"http://x/{i % 4}", START + timedelta(hours=30 * k + i), "text", 50) for i in range(10)]
        frame = spark.createDataFrame(rows, "event_id long, url string, received_at timestamp_ntz, evidence_text string, risk_score int")
        frame.coalesce(1).write.mode("append").parquet(path)
        got = sr.filed_reports(runs.read_stream(spark, path), "t", out, checkpoint=checkpoint, delay=3600)
    once = sorted((r.event_id, str(r.filed_on)) for r in got.collect())
    assert [i for i, _ in once] == [0, 1, 2, 3, 10, 11, 12, 13, 20, 21, 22, 23, 30, 31, 32, 33]
    days = [p.name for p in Path(out, "table").glob("batch=*/*") if p.is_dir()]
    assert {f"filed_on={d}" for _, d in once} == set(days)
    commits = sorted(Path(checkpoint, "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for name in (commits[-1].name, f".{commits[-1].name}.crc"):
        Path(checkpoint, "commits", name).unlink(missing_ok=True)
    again = sr.filed_reports(runs.read_stream(spark, path), "t", out, checkpoint=checkpoint, delay=3600)
    assert sorted((r.event_id, str(r.filed_on)) for r in again.collect()) == once


def test_debounce_stream_equals_batch(spark):
    rows = make(400, 4, 6, 2)
    rows = [(u, None if k == "k1" else k, t) for u, k, t in rows]
    path, checkpoint, out = scratch(spark, "in"), scratch(spark, "checkpoint"), scratch(spark, "out")
    for part in (rows[:130], rows[130:260], rows[260:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        got = screening.debounced(runs.read_stream(spark, path), "k", "ts", "uid", 60, delay=10**7, out=out, checkpoint=checkpoint)
    want = bursts.burst_ends(spark.createDataFrame(rows, SCHEMA), "k", "ts", "uid", 60)
    assert {r.uid for r in got.collect()} == {r.uid for r in want.collect()}


def test_debounce_decides_in_the_stream(spark):
    """With a short delay bursts come out before the stream ends; events of bursts that are out are dropped and counted."""
    rows = sorted(make(400, 4, 6, 2), key=lambda r: r[2] + timedelta(seconds=hash(r[0] * 7919) % 600))
    path, checkpoint, out = scratch(spark, "in"), scratch(spark, "checkpoint"), scratch(spark, "out")
    sizes = []
    for k in range(0, 400, 100):
        spark.createDataFrame(rows[k : k + 100], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        got = screening.debounced(runs.read_stream(spark, path), "k", "ts", "uid", 60, delay=600, out=out, checkpoint=checkpoint)
        sizes.append(spark.read.parquet(f"{out}/decided").count())
    want = {r.uid for r in bursts.burst_ends(spark.createDataFrame(rows, SCHEMA), "k", "ts", "uid", 60).collect()}
    assert {r.uid for r in got.collect()} == want
    assert 0 < sizes[0] < sizes[1] < sizes[2] < sizes[3] < len(want)
    late = [(900, "k1", START - timedelta(hours=1)), (901, None, START - timedelta(hours=2))]
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    got = screening.debounced(runs.read_stream(spark, path), "k", "ts", "uid", 60, delay=600, out=out, checkpoint=checkpoint)
    assert {r.uid for r in got.collect()} == want
    assert spark.read.parquet(f"{out}/late").agg({"late": "sum"}).first()[0] == 2


def test_stats_of_an_empty_stream(spark):
    path = scratch(spark, "in")
    spark.createDataFrame([], "risk_score int, received_at timestamp").write.parquet(path)
    assert [tuple(r) for r in sr.running_stats(runs.read_stream(spark, path)).collect()] == [(0, 0, 0.0, 0)]


def test_burst_ends_equal_lead(spark):
    rows = make(400, 4, 6, 2)
    got = {r.uid for r in bursts.burst_ends(spark.createDataFrame(rows, SCHEMA), "k", "ts", "uid", 60).collect()}
    by_key = defaultdict(list)
    for uid, key, ts in rows:
        by_key[key].append((ts, uid))
    want = set()
    for items in by_key.values():
        items.sort()
        for i, (ts, uid) in enumerate(items):
            if i + 1 == len(items) or (items[i + 1][0] - ts).total_seconds() > 60:
                want.add(uid)
    assert got == want


def test_burst_gap_equal_to_limit_merges(spark):
    rows = [(1, "a", START), (2, "a", START + timedelta(seconds=60)), (3, "a", START + timedelta(seconds=121))]
    got = bursts.burst_ends(spark.createDataFrame(rows, SCHEMA), "k", "ts", "uid", 60)
    assert sorted(r.uid for r in got.collect()) == [2, 3]
