"""Event decoding, the keyed sink and the streaming jobs."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from adgauge import schemas
from adgauge.operators import events, rates
from adgauge.plans import views
from adgauge.plans.catalog_streams import StreamViews, _finish
from adgauge.session import scratch_path, shared_dir
from adgauge.sources import keyed, readers, sinks
from adgauge.streaming import ingest
from tests.conftest import SMALL


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_validity_reasons(spark):
    rows = [('{"event_id":"e","campaign_id":"c","s2s_flag":true,"extra":1}',), ('{"event_id":" ","campaign_id":"c"}',),
            ('{"event_id":"e"}',), ("{nope",), ("null",), ("  ",), (None,)]
    df = spark.createDataFrame(rows, "body string")
    got = [r.error_reason for r in events.validity(df).collect()]
    assert got == [None, "Missing required fields", "Missing required fields", "JSON error: body does not decode",
                   "Deserialization failed", "Deserialization failed", "Deserialization failed"]
    valid, rejected = events.split_valid(df)
    assert valid.count() == 1 and rejected.count() == 6


def test_each_body_is_decoded_once(spark):
    df = spark.createDataFrame([("{}",)], "body string")
    valid, _ = events.split_valid(df)
    plan = ingest.classify(events.flatten_events(valid, F.current_timestamp()))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("from_json") == 1


def test_producer_and_consumer_fields_align():
    names = schemas.TRACKING_EVENT.fieldNames()
    assert len(names) == 13 and {"event_id", "timestamp", "s2s_flag", "tracking_hash"} <= set(names)
    produced = set(names) | {"is_bot", "bot_detection_reason", "country_code", "country_name", "city", "region",
                             "latitude", "longitude", "processed_at", "date"}
    assert set(schemas.STAGING_COLUMNS) <= produced


def batch(spark, rows):
    return spark.createDataFrame(rows, "tracking_hash string, event_id string, processed_at timestamp, date date")


def table(spark, path, **more):
    return sorted((r.tracking_hash or "", r.event_id, str(r.date)) for r in keyed.read_keyed(spark, path, **more).collect())


def day(n):
    return dt.date(2024, 1, n)


def test_upsert_moves_keys_and_survives_replay(spark):
    target, t0 = scratch_path(spark, "t"), dt.datetime(2024, 1, 1)
    first = batch(spark, [("a", "e1", t0, day(1)), ("b", "e2", t0, day(2)), ("b", "e3", t0, day(2))])
    second = batch(spark, [("b", "e4", t0, day(3)), ("c", "e5", t0, day(1))])
    for _ in range(2):
        keyed.upsert_batch(first, 0, target)
    assert table(spark, target) == [("a", "e1", "2024-01-01"), ("b", "e3", "2024-01-02")]
    want = [("a", "e1", "2024-01-01"), ("b", "e4", "2024-01-03"), ("c", "e5", "2024-01-01")]
    for _ in range(2):
        keyed.upsert_batch(second, 1, target)
        assert table(spark, target) == want
    keyed.upsert_batch(second.limit(0), 2, target)
    assert table(spark, target) == want and keyed.version(spark, target) == 1


def test_upsert_keeps_rows_without_date_or_key(spark):
    target, t0 = scratch_path(spark, "t"), dt.datetime(2024, 1, 1)
    first = batch(spark, [("a", "e1", t0, None), ("b", "e2", t0, None), (None, "e3", t0, None), (None, "e4", t0, t0.date())])
    second = batch(spark, [("a", "e5", t0, None), (None, "e3", t0, t0.date())])
    for number, rows in enumerate((first, second, second.limit(0))):
        for _ in range(2):
            keyed.upsert_batch(rows, number, target)
    want = [("", "e3", "2024-01-01"), ("", "e3", "None"), ("", "e4", "2024-01-01"), ("a", "e5", "None"), ("b", "e2", "None")]
    assert table(spark, target) == want
    keyed.compact(spark, target)
    assert table(spark, target, schema=first.schema) == want == table(spark, target)


def test_batch_writes_its_own_rows_only_and_unpublished_ones_are_not_read(spark):
    target, t0 = scratch_path(spark, "t"), dt.datetime(2024, 1, 1)
    keyed.upsert_batch(batch(spark, [(f"k{i}", f"e{i}", t0, day(1 + i % 20)) for i in range(500)]), 0, target)
    keyed.compact(spark, target)
    one = batch(spark, [("k3", "x", t0, day(30))])
    keyed.upsert_batch(one, 1, target)
    assert spark.read.parquet(f"{target}/changes/batch=1").count() == 1
    one.withColumn(keyed.ORDER, F.lit(2)).write.parquet(f"{target}/changes/batch=2")  # a writer that died before publishing
    rows = table(spark, target)
    assert len(rows) == 500 and ("k3", "x", "2024-01-30") in rows


def test_version_of_a_lost_writer_is_taken_over(spark, monkeypatch):
    target, t0 = scratch_path(spark, "t"), dt.datetime(2024, 1, 1)
    keyed.upsert_batch(batch(spark, [("a", "e1", t0, day(1))]), 0, target)
    spark.range(1).write.json(f"{target}/versions/v=1")
    sinks.remove(spark, f"{target}/versions/v=1/_SUCCESS")
    monkeypatch.setattr(keyed, "STALE_SECONDS", 0)
    assert table(spark, target) == [("a", "e1", "2024-01-01")]
    keyed.upsert_batch(batch(spark, [("a", "e2", t0, day(1))]), 1, target)
    assert keyed.version(spark, target) == 1 and table(spark, target) == [("a", "e2", "2024-01-01")]


def test_compaction_beside_batches_and_cleaning(spark, monkeypatch):
    target, t0 = scratch_path(spark, "t"), dt.datetime(2024, 1, 1)
    rows = lambda n: batch(spark, [(f"k{n % 3}", f"e{n}", t0, day(1 + n)), (None, f"n{n}", t0, None)])
    for n in range(3):
        keyed.upsert_batch(rows(n), n, target)
    publish, met = keyed._publish, []

    def slow(spark, target, number, *rest):
        if not met:  # a batch is published while the compaction writes
            met.append(number)
            keyed.upsert_batch(rows(3), 3, target)
        publish(spark, target, number, *rest)

    monkeypatch.setattr(keyed, "_publish", slow)
    keyed.compact(spark, target)
    want = [("", f"n{n}", "None") for n in range(4)] + [("k0", "e3", "2024-01-04"), ("k1", "e1", "2024-01-02"), ("k2", "e2", "2024-01-03")]
    assert table(spark, target) == want and met == [3] and keyed.version(spark, target) == 4
    keyed.fold_changes(spark, target)
    keyed.upsert_batch(rows(4), 4, target)
    keyed.fold_changes(spark, target)
    assert ("k1", "e4", "2024-01-05") in table(spark, target) and len(table(spark, target)) == 8
    keyed.clean(spark, target, keep=1)
    assert sinks.folders(spark, f"{target}/versions") == [f"v={keyed.version(spark, target)}"]
    assert len(sinks.folders(spark, f"{target}/changes")) == len(sinks.folders(spark, f"{target}/base")) == 1
    assert len(table(spark, target)) == 8


def test_keyless_events_pass(spark):
    rows = [("e", None, 1), ("e", None, 1), (None, " ", 2), (None, " ", 2), ("x", "k", 3), ("y", "k", 4)]
    df = spark.createDataFrame(rows, "event_id string, idempotency_key string, s long").select(
        "event_id", "idempotency_key", F.timestamp_seconds("s").alias("timestamp"))
    source, out = scratch_path(spark, "src"), scratch_path(spark, "out")
    for i in range(2):
        df.filter(F.col("timestamp").cast("long") % 2 == i).coalesce(1).write.mode("append").parquet(source)
    stream = ingest.drop_repeats(readers.read_table_stream(spark, source, df.schema, max_files=1), delay="1 hour")
    _finish(ingest.checkpointed(stream.writeStream.format("parquet").option("path", out), f"{out}-c").trigger(availableNow=True).start())
    for got in (ingest.drop_repeats(df), spark.read.parquet(out)):
        keys = sorted((r.idempotency_key or "") for r in got.collect())
        assert keys == ["", "", " ", " ", "k"]


def test_stream_ingest_equals_batch(spark):
    v = views.Views(spark, SMALL)
    base = scratch_path(spark, "ingest")
    _finish(ingest.run_ingest(
        StreamViews(spark, SMALL).bodies, f"{base}/s", f"{base}/t", f"{base}/d", f"{base}/c",
        processed_at=v.now, **ingest.ingest_trigger(once=True)))
    valid, rejected = events.split_valid(v.bodies)
    want = ingest.classify(events.flatten_events(valid, v.now)).select(*schemas.STAGING_COLUMNS).drop("raw_headers")
    got = readers.read_table(spark, f"{base}/s").select(*want.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    assert spark.read.json(f"{base}/d").count() == rejected.count()
    assert keyed.read_keyed(spark, f"{base}/t").count() == want.select("tracking_hash").distinct().count()


def test_triggers():
    assert ingest.ingest_trigger() == {"processingTime": "30 seconds"}
    assert ingest.ingest_trigger(once=True) == {"availableNow": True}


def test_stream_rate_across_batches(spark):
    """Two files, two micro-batches: the window of a key spans both."""
    source, out = scratch_path(spark, "src"), scratch_path(spark, "out")
    base = 1_700_000_000
    for part, seconds in enumerate(([0, 10, 50], [55, 61, 70])):
        rows = [(f"e{part}{i}", "ip", base + s) for i, s in enumerate(seconds)]
        spark.createDataFrame(rows, "impression_id string, ip string, s bigint").select(
            "impression_id", "ip", F.timestamp_seconds("s").alias("timestamp_utc")
        ).coalesce(1).write.mode("append").parquet(source)
        schema = spark.read.parquet(source).schema
        stream = readers.read_table_stream(spark, source, schema, max_files=1)
        _finish(ingest.stream_rate(stream, out, f"{out}-c", limit=3, availableNow=True))
    got = {r.impression_id: (r.window_count, r.rate_exceeded) for r in spark.read.parquet(out).collect()}
    assert got == {"e00": (1, False), "e01": (2, False), "e02": (3, False),
                   "e10": (4, True), "e11": (1, False), "e12": (2, False)}


def test_late_event_counts_in_the_open_window_of_the_stream(spark):
    source, out = scratch_path(spark, "src"), scratch_path(spark, "out")
    base = 1_700_000_000
    for part, seconds in enumerate(([100, 100], [70, 159, 160, 160])):
        rows = [(f"e{part}{i}", "ip", base + s) for i, s in enumerate(seconds)]
        spark.createDataFrame(rows, "impression_id string, ip string, s bigint").select(
            "impression_id", "ip", F.timestamp_seconds("s").alias("timestamp_utc")
        ).coalesce(1).write.mode("append").parquet(source)
        schema = spark.read.parquet(source).schema
        stream = readers.read_table_stream(spark, source, schema, max_files=1)
        _finish(ingest.stream_rate(stream, out, f"{out}-c", limit=3, availableNow=True))
    got = {r.impression_id: (r.window_count, r.rate_exceeded) for r in spark.read.parquet(out).collect()}
    assert got == {"e00": (1, False), "e01": (2, False), "e10": (3, False), "e11": (4, True), "e12": (1, False), "e13": (2, False)}


def test_open_windows_outlast_minutes_and_future_dates(spark):
    """A window of an hour stays open over batches minutes apart, though another address sends a date far ahead."""
    work, base = scratch_path(spark, "rates"), 1_700_000_000

    def run(number, *rows):
        df = spark.createDataFrame([(f"e{number}{i}", ip, base + s if s is not None else None) for i, (ip, s) in enumerate(rows)], "event_id string, ip string, s bigint").select(
            "event_id", "ip", F.lit("Mozilla/5.0").alias("user_agent"), F.timestamp_seconds("s").alias("timestamp"), F.timestamp_seconds(F.lit(base + 20_000)).alias("processed_at"))
        rated = ingest.rate_events(df, number, work, limit=2, window_seconds=3600)
        assert rated.columns == [*df.columns, "rate_exceeded"]
        return [r.rate_exceeded for r in rated.orderBy("event_id").collect()]

    def windows(number):
        return sorted((r.key, r.anchor // 10**6 - base, r.seen) for r in spark.read.parquet(f"{work}/rates/batch={number}").collect())

    assert run(0, ("a", 0), ("a", 10), ("b", 5)) == [False] * 3
    assert run(1, ("b", 900), ("c", 10**8), ("d", None)) == [False] * 3
    assert windows(1) == [("a", 0, 2), ("b", 5, 2), ("c", 10**8, 1)]
    assert run(2, ("a", 1800), ("b", 3604), ("b", 3605)) == [True, True, False]
    assert run(3, ("b", 7000)) == [False]
    assert windows(3) == [("b", 3605, 2), ("c", 10**8, 1)]


def test_hot_address_of_the_stream_is_split_over_tasks(spark):
    """Half of all events come from one address; its cells are rated by many tasks, and as one window chain."""
    base, work = 1_700_000_000, scratch_path(spark, "hot")
    df = spark.range(6000).select(
        F.col("id").cast("string").alias("impression_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("ip"), F.col("id") % 400)).alias("ip"),
        F.timestamp_seconds(F.lit(base) + F.col("id")).alias("timestamp_utc"))
    for part in range(2):
        rows = df.filter(F.floor(F.col("impression_id").cast("long") / 3000) == part)
        got = ingest.rated_batch(rows, part, work, "ip", "timestamp_utc", "impression_id", 20, 60.0)
        hot = got.filter("ip = 'hot'").select(F.col("impression_id").cast("long").alias("i"), "window_count").collect()
        assert {r.i: r.window_count for r in hot} == {i: (i % 60) // 2 + 1 for i in range(3000 * part, 3000 * part + 3000, 2)}
    cells = rates.celled(rates.points(df, "ip", "timestamp_utc"), 10.0, 100)
    assert cells.filter("key = 'hot'").select(F.expr("t div w")).distinct().count() > 20


def test_retry_routes(spark):
    rows = [("x", 0, None), (None, 0, None), (None, 2, "f"), (None, 3, "f"), (None, None, "f")]
    df = spark.createDataFrame(rows, "error_reason string, retry_count int, failure string")
    routed = events.route_failures(df.withColumn("data", F.lit(1)))
    assert [r.route for r in routed.collect()] == ["dead_letter", "ok", "retry", "dead_letter", "retry"]
    ok, dead = events.split_routed(routed)
    assert ok.count() == 1 and sorted(r.error_reason for r in dead.collect()) == ["Max retries exceeded: f", "x"]


def raw(spark, path, rows):
    """Appends raw events (number, second) to a stream's folder."""
    body = F.to_json(F.struct(
        F.concat(F.lit("e"), "n").alias("event_id"), F.lit("c").alias("campaign_id"), F.concat(F.lit("h"), "n").alias("tracking_hash"), F.lit("1.2.3.4").alias("ip"),
        F.lit("Mozilla/5.0 Chrome/120").alias("user_agent"),
        F.date_format(F.timestamp_seconds("s"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")))
    df = spark.createDataFrame(rows, "n long, s long")
    df.select(body.alias("body"), F.col("n").alias("sequenceNumber")).coalesce(1).write.mode("append").json(path)


def again(spark, checkpoint):
    """Makes the stream run its last micro-batch again, as after a lost driver."""
    last = max(int(p.name) for p in Path(checkpoint.removeprefix("file:")).joinpath("commits").iterdir() if p.name.isdigit())
    sinks.remove(spark, f"{checkpoint}/commits/{last}")


def test_failing_events_are_retried_and_a_replay_gives_the_same(spark):
    base = scratch_path(spark, "r")
    failure = F.when((F.col("sequenceNumber") < 5) & (F.col("retry_count") < F.col("sequenceNumber")), F.concat(F.lit("down "), "sequenceNumber"))

    def run():
        stream = readers.read_events_stream(spark, f"{base}/in", max_files=100)
        _finish(ingest.run_ingest(stream, f"{base}/s", f"{base}/t", f"{base}/d", f"{base}/c", processed_at=F.lit("2024-01-01").cast("timestamp"),
                                  failure=failure, availableNow=True))

    def state():
        done = sorted((r.event_id, r.retry_count, r.batch_id) for r in spark.read.parquet(f"{base}/s").collect())
        dead = sorted((r.sequence_number, r.retry_count, r.error_reason) for r in spark.read.schema("sequence_number long, retry_count int, error_reason string").json(f"{base}/d").collect())
        return done, dead

    for part in range(5):
        raw(spark, f"{base}/in", [(n, 1_700_000_000 + n) for n in (range(5) if part == 0 else [10 + part])])
        run()
        before = state()
        if part in (1, 3):
            again(spark, f"{base}/c")
            run()
            assert state() == before
    done, dead = state()
    assert done == sorted([("e0", 0, 0), ("e1", 1, 1), ("e2", 2, 2), ("e3", 3, 3), *[(f"e{10 + p}", 0, p) for p in range(1, 5)]])
    assert dead == [(4, 3, "Max retries exceeded: down 4")]


def test_watermark_is_kept_and_late_events_are_set_aside(spark):
    base, t0 = scratch_path(spark, "w"), 1_700_000_000

    def run():
        stream = readers.read_events_stream(spark, f"{base}/in", max_files=100)
        _finish(ingest.run_ingest(
            stream, f"{base}/s", f"{base}/t", f"{base}/d", f"{base}/c", processed_at=F.timestamp_seconds(F.lit(t0 + 9000)), late=f"{base}/late", lateness=600.0,
            bot_rules="scored", score_limits={"per_minute": 2}, availableNow=True))

    def parts():
        return [sorted(r.event_id for r in spark.read.schema("event_id string").parquet(f"{base}/{p}").collect()) for p in ("s", "late")]

    # within a batch nothing is late; a date after the processing counts as that
    feeds = ([(0, t0 + 1000), (1, t0)], [(2, t0 + 399), (3, t0 + 400), (4, t0 + 99_999)], [(5, t0 + 8399), (6, t0 + 8400)])
    wanted = ([["e0", "e1"], []], [["e0", "e1", "e3", "e4"], ["e2"]], [["e0", "e1", "e3", "e4", "e6"], ["e2", "e5"]])
    for feed, want in zip(feeds, wanted, strict=True):
        raw(spark, f"{base}/in", feed)
        run()
        assert parts() == want
        again(spark, f"{base}/c")
        run()
        assert parts() == want
    with pytest.raises(ValueError):
        ingest.run_ingest(None, "s", "t", "d", "c", bot_rules="scored")


def test_event_within_the_lateness_is_counted_with_all_its_points(spark):
    path, base = scratch_path(spark, "points"), 1_700_000_000

    def run(number, seconds):
        df = spark.createDataFrame([(f"e{s}", "ip", base + s) for s in seconds], "event_id string, ip string, s bigint").select(
            "event_id", "ip", F.timestamp_seconds("s").alias("timestamp"), F.timestamp_seconds(F.lit(base + 10**6)).alias("processed_at"))
        return {r.event_id: r.n_minute for r in ingest.with_history(df, number, path, "ip", {"n_minute": 60}, lateness=20_000).collect()}

    assert run(0, [0, 10, 20]) == {"e0": 1, "e10": 2, "e20": 3}
    assert run(1, [20_000]) == {"e20000": 1}
    assert run(2, [19_000]) == {"e19000": 1}
    assert run(3, [30]) == {"e30": 4}


def test_batch_over_many_days_leaves_only_points_that_later_events_reach(spark):
    path, base = scratch_path(spark, "points"), 1_699_999_200  # a whole hour
    days = [i * 600 for i in range(6 * 144)]

    def run(number, seconds):
        df = spark.createDataFrame([(f"e{s}", f"ip{s % 7}", base + s) for s in seconds], "event_id string, ip string, s bigint").repartition(4).select(
            "event_id", "ip", F.timestamp_seconds("s").alias("timestamp"), F.timestamp_seconds(F.lit(base + 10**7)).alias("processed_at"))
        return {r.event_id: r.n_day for r in ingest.with_history(df, number, path, "ip", {"n_day": 86400}, lateness=3600).collect()}

    def wanted(s, seen):
        return sum(x % 7 == s % 7 and s - 86400 < x <= s for x in seen)

    assert run(0, days) == {f"e{s}": wanted(s, days) for s in days}
    hours = {int(name[5:]) - base // 3600: sinks.folders(spark, f"{path}/{name}") for name in sinks.folders(spark, path) if name.startswith("hour=")}
    last = days[-1] // 3600
    assert sorted(hours) == list(range((days[-1] - 90_000) // 3600, last + 1)) and all(v == ["batch=0"] for v in hours.values())
    files = [len(spark.read.parquet(f"{path}/hour={h + base // 3600}").inputFiles()) for h in hours]
    assert files == [1] * len(hours)
    later = [days[-1] - 3600, days[-1] + 60, days[-1] + 420]  # the first as late as may be
    assert run(1, later) == {f"e{s}": wanted(s, days + later) for s in later}


def test_unknown_rules_are_rejected(spark):
    with pytest.raises(ValueError):
        events.apply_bot_rules(spark.range(1).select(F.lit("x").alias("user_agent")), "nope")


def test_history_spans_batches_and_survives_replay(spark):
    """Counts reach into earlier batches, a replayed batch counts as at first, hours out of reach go."""
    path, base = scratch_path(spark, "points"), 1_700_000_000

    def run(number, seconds, key="ip"):
        rows = [(f"e{s}", key if s is not None else None, base + (s or 0)) for s in seconds]
        df = spark.createDataFrame(rows, "event_id string, ip string, s bigint").select(
            "event_id", "ip", F.timestamp_seconds("s").alias("timestamp"), F.timestamp_seconds(F.lit(base + 40_010)).alias("processed_at"))
        rated = ingest.with_history(df, number, path, "ip", {"n_minute": 60, "n_hour": 3600}, 100)
        return sorted((r.event_id, r.n_minute, r.n_hour, r.rapid) for r in rated.collect())

    assert run(0, [0, 10, 10]) == [("e0", 1, 1, False), ("e10", 3, 3, True), ("e10", 3, 3, True)]
    second = run(1, [20, 65, None])
    assert second == [("e20", 4, 4, True), ("e65", 4, 5, True), ("eNone", None, None, None)]
    assert run(1, [20, 65, None]) == second
    assert run(2, [40_000]) == [("e40000", 1, 1, False)]
    hours = [int(name[5:]) for name in sinks.folders(spark, path) if name.startswith("hour=")]
    assert hours == [(base + 40_000) // 3600]
    assert run(3, []) == []
    assert run(4, [10**8]) == [("e100000000", 1, 1, False)]  # dated after its processing
    assert run(5, [40_001]) == [("e40001", 2, 2, False)]
