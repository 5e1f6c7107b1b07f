"""Stream limiter, live reach, capped batches, staged days, addresses by ranges."""

import datetime as dt
import ipaddress
import random
from pathlib import Path

from pyspark.sql import functions as F

from adgauge.operators import addresses, rates
from adgauge.plans.catalog_streams import _finish
from adgauge.plans.registry import QUERIES
from adgauge.session import scratch_path
from adgauge.sources import readers, sinks, staged
from adgauge.streaming import ingest, reach

T0 = 1_700_000_000


def events(spark, rows):
    return spark.createDataFrame(rows, "impression_id string, ip string, s bigint").select(
        "impression_id", "ip", F.timestamp_seconds("s").alias("timestamp_utc"))


def brute_limiter(rows, limit, window):
    """rows in order: (id, key, second)."""
    kept, out = {}, {}
    for i, key, t in rows:
        live = [x for x in kept.get(key, []) if x >= t - window]
        out[i] = len(live) < limit
        kept[key] = [*live, t] if out[i] else live
    return out


def test_limiter_over_batches_equals_one_pass(spark):
    rng = random.Random(11)
    rows = sorted(((T0 + rng.randint(0, 900), f"k{min(rng.randint(0, 5), 2)}", f"e{i:04d}") for i in range(600)), key=lambda r: (r[0], r[2]))
    want = brute_limiter([(i, k, t) for t, k, i in rows], 5, 60)
    carried, got = spark.createDataFrame([], "key string, t bigint, n bigint"), {}
    for n in range(4):
        part = [(i, k, t) for t, k, i in rows if (t - T0) // 226 == n]
        out, carried = rates.admit_batch(events(spark, part), carried, limit=5)
        got |= {r.impression_id: r.allowed for r in out.collect()}
        held = carried.groupBy("key").agg(F.sum("n").alias("n")).collect()
        assert all(r.n <= 5 for r in held)
    assert got == want and not all(want.values())


def test_late_and_keyless_events_of_the_limiter(spark):
    none = spark.createDataFrame([], "key string, t bigint, n bigint")
    out, carried = rates.admit_batch(events(spark, [("a", "x", T0 + 100), ("b", "x", T0 + 110), ("c", None, T0), ("d", "x", None)]), none, limit=2)
    assert {r.impression_id: r.allowed for r in out.collect()} == {"a": True, "b": True, "c": True, "d": True}
    late, carried = rates.admit_batch(events(spark, [("e", "x", T0), ("f", "x", T0 + 161), ("g", "y", T0 + 5)]), carried, limit=2)
    assert {r.impression_id: r.allowed for r in late.collect()} == {"e": False, "f": True, "g": True}
    assert sorted((r.key, r.t // 10**6 - T0, r.n) for r in carried.collect()) == [("x", 110, 1), ("x", 161, 1), ("y", 5, 1)]
    _, left = rates.admit_batch(events(spark, [("h", "z", T0 + 2000)]), carried, limit=2)
    assert [r.key for r in left.collect()] == ["z"]


def again(spark, checkpoint):
    last = max(int(p.name) for p in Path(checkpoint.removeprefix("file:")).joinpath("commits").iterdir() if p.name.isdigit())
    sinks.remove(spark, f"{checkpoint}/commits/{last}")


def test_limiter_stream_survives_replay(spark):
    base = scratch_path(spark, "limiter")
    for part, rows in enumerate(([("a", "x", T0), ("b", "x", T0 + 1)], [("c", "x", T0 + 30), ("d", "x", T0 + 61)])):
        events(spark, rows).coalesce(1).write.mode("append").parquet(f"{base}/in")
        for _ in range(2):
            stream = readers.read_table_stream(spark, f"{base}/in", events(spark, rows).schema)
            _finish(ingest.stream_limiter(stream, f"{base}/out", f"{base}/c", limit=2, availableNow=True))
            if part:
                again(spark, f"{base}/c")
    got = {r.impression_id: r.allowed for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {"a": True, "b": True, "c": False, "d": True}


def test_reach_merges_late_hours(spark):
    base = scratch_path(spark, "reach")

    def part(n, seconds, people):
        df = spark.createDataFrame([("c", str(p), T0 + s, p % 10 == 9) for s in seconds for p in people], "campaign_id string, panelist_id string, s bigint, is_bot boolean")
        reach.hourly_sketches(df.withColumn("timestamp_utc", F.timestamp_seconds("s"))).write.mode("overwrite").parquet(f"{base}/batch_id={n}")

    part(0, [0, 7200], range(3000))
    part(1, [10], range(2000, 6000))  # an hour that was written before
    rows = reach.reach(spark, base, F.date_trunc("hour", "hour")).orderBy("period").collect()
    bound = 4 * reach.standard_error()
    for r, exact, seen in zip(rows, (5400, 2700), (2700 + 3600, 2700), strict=True):
        assert abs(r.panelists - exact) <= bound * exact and r.impressions == seen
    total = reach.reach(spark, base, by_campaign=False).collect()
    assert len(total) == 1 and abs(total[0].panelists - 5400) <= bound * 5400


def test_landed_files_hold_no_more_than_asked(spark):
    base = scratch_path(spark, "landed")
    for part in range(2):
        spark.range(part * 25, part * 25 + 25).coalesce(1).write.mode("append").parquet(f"{base}/in")
        _finish(ingest.land_events(readers.read_table_stream(spark, f"{base}/in", spark.range(1).schema), f"{base}/out", f"{base}/c", 10, availableNow=True))
    sizes = []
    stream = readers.read_landed_stream(spark, f"{base}/out", spark.range(1).schema)
    writer = stream.writeStream.foreachBatch(lambda batch, n: sizes.append(batch.count())).option("checkpointLocation", f"{base}/d")
    _finish(writer.trigger(availableNow=True).start())
    assert sum(sizes) == 50 and max(sizes) <= 10


def test_lanes_have_every_capped_file_once(spark):
    base, schema = scratch_path(spark, "lanes"), spark.range(1).schema
    for start, end in ((0, 112), (112, 115)):  # 23 files and one
        spark.range(start, end).coalesce(1).write.mode("append").parquet(f"{base}/in")
        _finish(ingest.land_events(readers.read_table_stream(spark, f"{base}/in", schema), f"{base}/out", f"{base}/c", 5, availableNow=True))
    batches = []

    def start(lane):
        stream = readers.read_landed_stream(spark, f"{base}/out", schema, lane)
        writer = stream.writeStream.foreachBatch(lambda batch, n: batches.append((lane, n, [r.id for r in batch.collect()])))
        return writer.option("checkpointLocation", f"{base}/d/{lane}").trigger(availableNow=True).start()

    for handle in [start(lane) for lane in range(readers.LANES)]:
        _finish(handle)
    assert sorted(i for *_, ids in batches for i in ids) == [*range(115)]
    assert len({(lane, n) for lane, n, _ in batches}) == len(batches) == 24 and max(len(ids) for *_, ids in batches) == 5
    assert {lane for lane, *_ in batches} == {*range(readers.LANES)}


def test_streams_with_plain_commits_go_on_after_a_restart(spark):
    base, schema = scratch_path(spark, "plain"), spark.range(1).schema
    assert spark.conf.get(ingest.COMMIT_MANAGER, None) is None
    seen = []
    for start, end in ((0, 12), (12, 15)):
        spark.range(start, end).coalesce(1).write.mode("append").parquet(f"{base}/in")
        with ingest.plain_commits(spark):
            stream = readers.read_table_stream(spark, f"{base}/in", schema)
            writer = stream.writeStream.foreachBatch(lambda batch, n: seen.append((n, sorted(r.id for r in batch.collect()))))
            handle = ingest.checkpointed(writer, f"{base}/c").trigger(availableNow=True).start()
        assert spark.conf.get(ingest.COMMIT_MANAGER, None) is None
        _finish(handle)
    assert seen == [(0, [*range(12)]), (1, [*range(12, 15)])]


def test_capped_batches_are_opened_once(spark):
    base = scratch_path(spark, "tables")
    columns = ["id AS event_id", "timestamp_seconds(id) AS ts", "id % 9 AS user_id", "'click' AS event_type", "0.5D AS value", "'{\"k\": 1}' AS props"]
    spark.range(900).selectExpr(*columns).coalesce(1).write.parquet(f"{base}/events.parquet")
    df = QUERIES["a05_capped_batches"](spark, base)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert df.filter("within").count() == df.select("seq").distinct().count() == 900


def test_staged_days_are_folded_beside_the_stream(spark):
    path, schema = scratch_path(spark, "staged"), "n long, date date"
    day = lambda n: dt.date(2024, 1, n)
    frames = [spark.createDataFrame([(10 * b + i, day(1 + i % 3) if i < 8 else None) for i in range(9)], schema).repartition(4) for b in range(4)]
    schema = frames[0].schema
    read = lambda: sorted((r.n, str(r.date)) for r in staged.read_staged(spark, path, schema).collect())
    whole = lambda k: sorted((r.n, str(r.date)) for f in frames[:k] for r in f.collect())
    for b in range(3):
        staged.stage_batch(frames[b], b, path)
        staged.stage_batch(frames[b], b, path)
    frames[3].write.partitionBy("date").parquet(f"{path}/live/batch_id=3")
    sinks.remove(spark, f"{path}/live/batch_id=3/_SUCCESS")  # a batch that is being written
    assert read() == whole(3)
    staged.compact(spark, path, schema, upto=1)
    assert read() == whole(3)
    files = [p for p in Path(path.removeprefix("file:")).joinpath("folded/v=0").rglob("*.parquet")]
    assert len(files) == 4  # three days and rows without one
    staged.stage_batch(frames[3].filter(F.col("date") == day(2)), 3, path)
    staged.compact(spark, path, schema, upto=2)
    staged.compact(spark, path, schema, upto=3)
    staged.clean(spark, path, keep=1)
    want = sorted(whole(3) + [(r.n, str(r.date)) for r in frames[3].collect() if r.date == day(2)])
    assert read() == want
    assert sinks.folders(spark, f"{path}/live") == []
    assert sorted(sinks.folders(spark, f"{path}/folded/v=2")) == ["date=2024-01-02"]
    staged.compact(spark, path, schema, upto=3)
    assert read() == want


def test_narrowest_range_wins(spark):
    rng = random.Random(4)
    ranges = [("0.0.0.0", "255.255.255.255", "all"), ("10.0.0.0", "10.255.255.255", "ten"), ("10.0.0.5", "10.0.0.5", "one"), ("9.0.0.0", "8.0.0.0", "none"), ("x", "10.0.0.1", "bad")]
    for i in range(40):
        a, b = sorted(rng.randrange(10 << 24, 11 << 24) for _ in range(2))
        ranges.append((str(ipaddress.ip_address(a)), str(ipaddress.ip_address(b)), f"r{i}"))
    ips = ["10.0.0.5", "10.0.0.6", "255.255.255.255", "0.0.0.0", None, "::1", "300.1.1.1", "1.2.3"] + [str(ipaddress.ip_address(rng.randrange(10 << 24, 11 << 24))) for _ in range(300)] + ["10.1.2.3"] * 500
    given = spark.createDataFrame([(i, ip, "old") for i, ip in enumerate(ips)], "id long, ip string, country string")
    table = spark.createDataFrame(ranges, "low string, high string, country string")

    def number(x):
        try:
            return int(ipaddress.IPv4Address(x))
        except ValueError:
            return None

    held = [(number(lo), number(hi), c) for lo, hi, c in ranges if number(lo) is not None and number(lo) <= number(hi)]
    got = {r.id: r.country for r in addresses.by_ranges(given, table).collect()}
    assert len(got) == len(ips)
    for i, ip in enumerate(ips):
        n = number(ip) if ip else None
        fits = [(hi - lo, lo, c) for lo, hi, c in held if n is not None and lo <= n <= hi]
        assert got[i] == (min(fits)[2] if fits else "XX")
    assert {r.country for r in addresses.by_ranges(given, table.limit(0)).collect()} == {"XX"}
    assert addresses.by_ranges(given.limit(0), table).count() == 0
