"""Rate rules against plain sequential code, with a key that holds a third of the rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from adgauge.operators import rates

SECOND = 1_000_000


@pytest.fixture(scope="module")
def feed(spark):
    rng = random.Random(5)
    rows, now = [], 1_700_000_000 * SECOND
    for i in range(900):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(12)}"
        now += rng.choice([0, 10_000, 90_000, 2 * SECOND, 15 * SECOND, 30 * SECOND, 400 * SECOND])
        rows.append((f"e{i:04d}", key, now))
    for i in range(400):  # a dense stretch of the hot key, longer than several windows
        now += rng.choice([0, 1, 500_000, SECOND])
        rows.append((f"f{i:04d}", "hot", now))
    rows.append(("null-key", None, now))
    df = spark.createDataFrame(rows, "impression_id string, ip string, us bigint").select(
        "impression_id", "ip", F.timestamp_micros("us").alias("timestamp_utc"))
    by_key = defaultdict(list)
    for event, key, t in rows:
        if key is not None:
            by_key[key].append((t, event))
    for events in by_key.values():
        events.sort()
    return df, by_key


def collected(df, *names):
    return {r.impression_id: tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize(("cell", "heavy"), [(0.5, 0), (10.0, 100), (1000.0, 0), (10.0, 1_000_000)])
def test_trailing_counts(feed, cell, heavy):
    df, by_key = feed
    got = rates.trailing_counts(rates.points(df, "ip", "timestamp_utc"), {"a": 60, "b": 3600}, cell, cell_rows=heavy)
    got = {(r.key, r.t): (r.a, r.b) for r in got.collect()}
    for key, events in by_key.items():
        for t, _ in events:
            want = tuple(sum(t - w * SECOND < u <= t for u, _ in events) for w in (60, 3600))
            assert got[key, t] == want


def test_closed_window_includes_its_far_end(spark):
    rows = [("a", "k", 0), ("b", "k", 60 * SECOND)]
    df = spark.createDataFrame(rows, "impression_id string, ip string, us bigint").select(
        "impression_id", "ip", F.timestamp_micros("us").alias("timestamp_utc"))
    pts = rates.points(df, "ip", "timestamp_utc")
    counts = {closed: {r.t: r.n for r in rates.trailing_counts(pts, {"n": 60}, closed=closed).collect()}
              for closed in (False, True)}
    assert counts[False][60 * SECOND] == 1 and counts[True][60 * SECOND] == 2


def test_null_keys_are_kept_and_unrated(feed):
    df, _ = feed
    got = collected(rates.ip_rate(df), "n_minute")
    assert got["null-key"] == (None,) and len(got) == df.count()


@pytest.mark.parametrize("gap", [5, 100, 3000])
def test_rapid(feed, gap):
    df, by_key = feed
    got = collected(rates.rapid(df, gap_ms=gap), "rapid")
    pts = rates.points(df, "ip", "timestamp_utc")
    split = {(r.key, r.t): r.rapid for r in rates.rapid_instants(pts, gap, cell_seconds=0.7, cell_rows=50).collect()}
    for events in by_key.values():
        times = [t for t, _ in events]
        for t, event in events:
            recent = [u for u in times if t - 60 * SECOND < u <= t]
            want = any(b - a < gap * 1000 for a, b in zip(recent, recent[1:]))
            assert got[event] == (want,), event
    keys = {event: key for key, events in by_key.items() for _, event in events}
    assert all(split[keys[e], t] == got[e][0] for events in by_key.values() for t, e in events)


@pytest.mark.parametrize(
    ("window", "cell", "cell_rows"),
    [(1, 10, 100), (1, 0.3, 1), (60, 10, 1), (60, 7, 30), (60, 10, 100_000), (3000, 10, 1), (3000, 10, 100)])
def test_anchored_rate(feed, window, cell, cell_rows):
    df, by_key = feed
    got = collected(
        rates.anchored_rate(df, limit=3, window_seconds=window, cell_seconds=cell, cell_rows=cell_rows),
        "window_count", "rate_exceeded")
    for events in by_key.values():
        anchor, seen = None, 0
        for t, event in events:
            if anchor is None or t - anchor >= window * SECOND:
                anchor, seen = t, 0
            seen += 1
            assert got[event] == (seen, seen > 3), event
    assert got["null-key"] == (None, False)


@pytest.mark.parametrize(("limit", "window", "batch"), [(3, 60, 10_000), (3, 60, 7), (20, 60, 50), (2, 5, 1), (0, 60, 100)])
def test_sliding_admission(feed, limit, window, batch):
    df, by_key = feed
    size, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession
    spark.conf.set(size, batch)  # a block then comes in several batches
    try:
        decided = rates.admitted_instants(rates.points(df, "ip", "timestamp_utc"), limit, window, cell_rows=100)
        got = {(r.key, r.t): (r.n, r.admitted) for r in decided.collect()}
    finally:
        spark.conf.unset(size)
    for key, events in by_key.items():
        kept, want = [], defaultdict(lambda: [0, 0])
        for t, _ in events:
            kept = [u for u in kept if u >= t - window * SECOND]
            want[t][0] += 1
            if len(kept) < limit:
                kept.append(t)
                want[t][1] += 1
        assert {t: v for (k, t), v in got.items() if k == key} == {t: tuple(v) for t, v in want.items()}


def test_quota(spark):
    rows = [("k", 10 * SECOND, 1, 1), ("k", 50 * SECOND, 2, 2), ("k", 90 * SECOND, 1, 1), ("old", 0, 1, 1)]
    df = spark.createDataFrame(rows, "key string, t bigint, n bigint, admitted bigint")
    now = F.timestamp_micros(F.lit(75 * SECOND))
    got = {r.key: (r.remaining, r.reset_seconds) for r in rates.quota(df, now, 5, 60).collect()}
    assert got == {"k": (3, 35.0), "old": (5, 0.0)}


def test_windows_reach_across_batches(feed):
    df, by_key = feed
    spark = df.sparkSession
    cuts = [int(r.t) for r in df.agg(F.expr("explode(percentile_approx(unix_micros(timestamp_utc), array(0.3, 0.7)))").alias("t")).collect()]
    part = sum((F.unix_micros("timestamp_utc") > c).cast("int") for c in cuts)
    carried = spark.createDataFrame([], "key string, anchor bigint, seen bigint")
    got = {}
    for i in range(3):
        rated, carried = rates.rate_batch(df.filter(part == i), carried, limit=3, ttl_seconds=100_000)
        got |= collected(rated, "rate_exceeded")
        keys = [r.key for r in carried.collect()]
        assert len(keys) == len(set(keys))
    for events in by_key.values():
        anchor, seen = None, 0
        for t, event in events:
            if anchor is None or t - anchor >= 60 * SECOND:
                anchor, seen = t, 0
            seen += 1
            assert got[event] == (seen > 3,), event
    assert got["null-key"] == (False,)


def test_late_and_equal_instants_count_in_the_open_window(spark):
    rows = [("a", 100, 1), ("b", 90, 2), ("c", 100, 2), ("d", 159, 2), ("e", 160, 2)]
    df = spark.createDataFrame(rows, "impression_id string, s bigint, part int").select(
        "impression_id", F.lit("k").alias("ip"), F.timestamp_seconds("s").alias("timestamp_utc"), "part")
    carried = spark.createDataFrame([], "key string, anchor bigint, seen bigint")
    got = {}
    for i in (1, 2):
        rated, carried = rates.rate_batch(df.filter(F.col("part") == i), carried, limit=2)
        got |= collected(rated, "rate_exceeded")
    assert got == {"a": (False,), "b": (False,), "c": (True,), "d": (True,), "e": (False,)}
    assert [tuple(r) for r in carried.collect()] == [("k", 160 * SECOND, 1)]
    _, dropped = rates.rate_batch(df.filter("part = 1").withColumns({"ip": F.lit("other"), "timestamp_utc": F.timestamp_seconds(F.lit(1000))}), carried)
    assert [r.key for r in dropped.collect()] == ["other"]
