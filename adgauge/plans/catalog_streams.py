"""Catalogue: streaming jobs, run to completion over the event table as a file stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from adgauge.functions import identity
from adgauge.operators.events import add_date_parts
from adgauge.plans import views
from adgauge.plans.catalog_events import ADMITTED_SQL, COMBINED_SQL, ELIGIBLE_SQL, REASON_SQL, anchor_sql, ts
from adgauge.plans.registry import query
from adgauge.plans.views import CONSUMER_PATTERN, stamp
from adgauge.session import scratch_path
from adgauge.sources import keyed, readers, staged
from adgauge.streaming import ingest, reach


class StreamViews(views.Views):
    """The same views with the event table as a stream."""

    def table(self, name):
        if name != "events":
            return super().table(name)
        batch = super().table("events")
        return readers.read_table_stream(
            self.spark, self.folder, batch.schema, "parquet", 1, glob="events.parquet"
        )


def _finish(query_handle):
    query_handle.awaitTermination()
    if query_handle.exception():
        raise RuntimeError(str(query_handle.exception()))


def _to_table(v, df, mode="append"):
    path, check = scratch_path(v.spark, "out"), scratch_path(v.spark, "check")
    writer = df.writeStream.format("parquet").outputMode(mode).option("path", path)
    _finish(ingest.checkpointed(writer, check).trigger(**ingest.ingest_trigger(once=True)).start())
    return readers.read_table(v.spark, path)


def _streamed(v):
    return StreamViews(v.spark, v.folder)


def _event_stream(v):
    """Every streamed event, beside the roll-up of its campaign in the written table."""
    rows = _to_table(v, _streamed(v).events.select("event_id", "campaign_id", "seq"))
    told = rows.groupBy(F.col("campaign_id").alias("of")).agg(F.count("*").alias("n"), F.sum("seq").alias("seq_sum"))
    return rows.join(told, F.col("campaign_id").eqNullSafe(F.col("of"))).drop("of")


query(
    "a05_event_stream_source", _event_stream,
    """SELECT event_id, campaign_id, seq, n, seq_sum FROM raw_events JOIN (SELECT campaign_id AS of_campaign, count(*) AS n, sum(seq)::bigint AS seq_sum
      FROM raw_events GROUP BY 1) ON campaign_id IS NOT DISTINCT FROM of_campaign""",
)


EVENTS_PER_BATCH = 200


def _capped(v):
    """Events with the size of their micro-batch, of a stream that is cut to so many events, stopped and started again.

    A micro-batch is mostly commits that wait for one another, so the cut files are read in lanes beside each other. The feed
    arrives in files of fifty micro-batches, which land in tasks beside each other."""
    base = scratch_path(v.spark, "capped")
    feed = v.events.select("event_id", "campaign_id", "seq")
    for part in range(2):
        feed.filter(F.col("seq") % 2 == part).write.mode("append").option("maxRecordsPerFile", 50 * EVENTS_PER_BATCH).parquet(f"{base}/source")
        stream = readers.read_table_stream(v.spark, f"{base}/source", feed.schema)
        _finish(ingest.land_events(stream, f"{base}/landed", f"{base}/check", EVENTS_PER_BATCH, **ingest.ingest_trigger(once=True)))

    def start(lane):
        def write(batch, batch_id):
            batch.write.mode("overwrite").option(*ingest.NO_MARKER).parquet(f"{base}/out/lane={lane}/batch_id={batch_id}")

        # every file is a micro-batch; a period that has more events takes more files, as a feed's periods differ
        landed = readers.read_landed_stream(v.spark, f"{base}/landed", feed.schema, lane)
        return ingest.checkpointed(landed.writeStream.foreachBatch(write), f"{base}/out-check/{lane}").trigger(**ingest.ingest_trigger(once=True)).start()

    with ingest.plain_commits(v.spark):
        handles = [start(lane) for lane in range(readers.LANES)]
    for handle in handles:
        _finish(handle)
    # a window over a micro-batch holds what it counts, and opens the many small files once
    size = F.count("*").over(Window.partitionBy("lane", "batch_id"))
    return readers.read_table(v.spark, f"{base}/out").select("event_id", "campaign_id", "seq", (size <= EVENTS_PER_BATCH).alias("within"))


query("a05_capped_batches", _capped, "SELECT event_id, campaign_id, seq, true AS within FROM raw_events")


def _ingested(v):
    """The whole ingest job over the stream; returns its folder."""
    base = scratch_path(v.spark, "ingest")
    _finish(ingest.run_ingest(
        _streamed(v).bodies, f"{base}/staging", f"{base}/target", f"{base}/dlq", f"{base}/check",
        processed_at=v.now, **ingest.ingest_trigger(once=True),
    ))
    return base


def _ingest_target(v):
    """The rows of all three sinks by their ids; a rejected row by its sequence number."""
    base = _ingested(v)
    sinks = (
        (readers.read_table(v.spark, f"{base}/staging"), F.lit("staging"), "event_id"),
        (keyed.read_keyed(v.spark, f"{base}/target"), F.lit("target"), "tracking_hash"),
        (v.spark.read.json(f"{base}/dlq"), F.col("error_reason"), "sequence_number"),
    )
    rows = [df.select(part.alias("part"), F.col(name).cast("string").alias("id")) for df, part, name in sinks]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


query(
    "i01_ingest", _ingest_target,
    f"""SELECT 'staging' AS part, event_id AS id FROM raw_events WHERE {REASON_SQL} IS NULL
    UNION ALL SELECT DISTINCT 'target', concat('h', seq - seq % 4) FROM raw_events WHERE {REASON_SQL} IS NULL
    UNION ALL SELECT {REASON_SQL}, seq::varchar FROM raw_events WHERE {REASON_SQL} IS NOT NULL""",
)


def _upsert_target(v):
    base = _ingested(v)
    return keyed.read_keyed(v.spark, f"{base}/target").select(
        "tracking_hash", "event_id", "campaign_id", "is_bot", "country_code", F.col("date").cast("string").alias("date"))


query(
    "i05_tracking_hash_upsert", _upsert_target,
    f"""SELECT concat('h', seq - seq % 4) AS tracking_hash, event_id, campaign_id, ({views.BOT_REASON}) IS NOT NULL AS is_bot, {views.COUNTRY} AS country_code,
    timestamp::date::varchar AS date FROM raw_events WHERE {REASON_SQL} IS NULL
    QUALIFY row_number() OVER (PARTITION BY seq - seq % 4 ORDER BY event_id DESC) = 1""",
)


def _ingest_consumer(v):
    """The ingest job under the consumer rules: three micro-batches by event time, a restart before each."""
    base = scratch_path(v.spark, "consumer")
    period = F.expr("greatest(0, least(2, datediff(enqueuedTime, date '2024-01-01') div 11))")
    for part in range(3):
        v.bodies.filter(period == part).drop("retry_count").write.mode("append").json(f"{base}/source")
        stream = readers.read_events_stream(v.spark, f"{base}/source", max_files=1_000_000)
        _finish(ingest.run_ingest(
            stream, f"{base}/staging", f"{base}/target", f"{base}/dlq", f"{base}/check", processed_at=v.now,
            bot_rules="consumer", geo_rules="consumer", rate_limit=2, rate_seconds=3600, **ingest.ingest_trigger(once=True),
        ))
    return readers.read_table(v.spark, f"{base}/staging").select("event_id", "ip", "is_bot", "bot_detection_reason")


query(
    "i01_ingest_consumer", _ingest_consumer,
    f"""SELECT event_id, ip, reason IS NOT NULL AS is_bot, reason AS bot_detection_reason FROM (
    SELECT x.event_id, x.ip, CASE WHEN user_agent IS NULL OR trim(user_agent) = '' THEN 'Empty user agent'
      WHEN regexp_matches(lower(user_agent), '{CONSUMER_PATTERN}') THEN 'Bot pattern in user agent'
      WHEN w.window_count > 2 THEN 'Rate limit exceeded' END AS reason FROM raw_events x
    LEFT JOIN ({anchor_sql(f"{REASON_SQL} IS NULL AND {ELIGIBLE_SQL}", 3600, 'SELECT event_id, window_count FROM c')}) w ON w.event_id = x.event_id
    WHERE {REASON_SQL} IS NULL)""",
)


def _ingest_scored(v):
    """The ingest job under the scored rules: three micro-batches by event time, a restart before each."""
    base = scratch_path(v.spark, "scored")
    feed = v.bodies_with({"raw_headers": F.expr("str_to_map(headers_text, ';', '=')")})
    period = F.expr("greatest(0, least(2, datediff(enqueuedTime, date '2024-01-01') div 11))")
    own = F.when(F.col("eventhub_sequence_number") % 3 == 0, F.concat(F.lit("fp"), "ip")).otherwise(
        identity.device_fingerprint("user_agent", F.lit("1920x1080"), F.lit(0), F.array(F.lit("pdf"))))
    for part in range(3):
        feed.filter(period == part).drop("retry_count").write.mode("append").json(f"{base}/source")
        stream = readers.read_events_stream(v.spark, f"{base}/source", max_files=1_000_000)
        _finish(ingest.run_ingest(
            stream, f"{base}/staging", f"{base}/target", f"{base}/dlq", f"{base}/check", processed_at=v.now,
            bot_rules="scored", fingerprint=own, late=f"{base}/late", **ingest.ingest_trigger(once=True),
            score_limits={"per_minute": 1, "per_hour": 2, "overused": 20, "suspicious": 5, "threshold": 0.66, "gap_ms": 20_000},
        ))
    return readers.read_table(v.spark, f"{base}/staging").select("event_id", "ip", "is_bot", "bot_detection_reason")


query(
    "i01_ingest_scored", _ingest_scored,
    f"""WITH valid AS (SELECT * FROM raw_events WHERE {REASON_SQL} IS NULL),
    s AS ({COMBINED_SQL.replace("FROM raw_events", "FROM valid")})
    SELECT event_id, ip, confidence >= 0.66 AS is_bot, CASE WHEN confidence >= 0.66 THEN reasons END AS bot_detection_reason
    FROM s JOIN valid ON event_id = impression_id""",
)


def _triggers(v):
    """The stream under both triggers: a period, ended when nothing is left to read, and once."""
    runs = []
    for name, options in (("period", ingest.ingest_trigger(1)), ("once", ingest.ingest_trigger(once=True))):
        path, check = scratch_path(v.spark, "trigger"), scratch_path(v.spark, "check")
        handle = ingest.append_partitions(add_date_parts(_streamed(v).events.select("event_id", "timestamp")), path, check, **options)
        if name == "period":
            handle.processAllAvailable()
            handle.stop()
        else:
            _finish(handle)
        runs.append(readers.read_table(v.spark, path).select(F.lit(name).alias("trigger"), "event_id", "year", "month", "day"))
    return runs[0].unionByName(runs[1])


query(
    "i02_triggers", _triggers,
    """SELECT t.name AS trigger, event_id, year(timestamp)::int AS year, month(timestamp)::int AS month, day(timestamp)::int AS day
    FROM raw_events, (VALUES ('period'), ('once')) t(name)""",
)


def _resumed(v):
    """A stream over JSON-lines files, stopped and started again after more files arrived."""
    base = scratch_path(v.spark, "resume")
    source, out = f"{base}/source", f"{base}/out"
    feed = v.bodies
    for part in range(2):
        (
            feed.filter(F.col("sequenceNumber") % 2 == part).drop("retry_count")
            .write.mode("append").json(source)
        )
        stream = readers.read_events_stream(v.spark, source, max_files=2)
        writer = stream.writeStream.format("parquet").option("path", out)
        _finish(
            ingest.checkpointed(writer, f"{base}/check").trigger(**ingest.ingest_trigger(once=True)).start()
        )
    return readers.read_table(v.spark, out).select("partitionKey", "offset", "sequenceNumber")


query(
    "i03_checkpoint_resume", _resumed,
    """SELECT (seq % 4)::varchar AS "partitionKey", seq::varchar AS "offset", seq AS "sequenceNumber" FROM raw_events""",
)


def _partitions(v):
    path, check = scratch_path(v.spark, "parts"), scratch_path(v.spark, "check")
    stream = add_date_parts(_streamed(v).events.select("event_id", "timestamp"))
    _finish(ingest.append_partitions(stream, path, check, **ingest.ingest_trigger(once=True)))
    return readers.read_table(v.spark, path).select("event_id", "year", "month", "day")


query(
    "i10_append_partitions", _partitions,
    "SELECT event_id, year(timestamp)::int AS year, month(timestamp)::int AS month, day(timestamp)::int AS day FROM raw_events",
)


def _keyed(events):
    # keyless events share event ids, or have none
    shared = F.when(F.expr("seq % 10 = 0"), F.lit(None)).when(F.expr("seq % 10 = 1"), F.lit("e")).otherwise(F.col("event_id"))
    return events.select(
        shared.alias("event_id"), "timestamp",
        F.when(F.expr("seq % 5 = 0"), F.lit(None)).when(F.expr("seq % 5 = 1"), F.lit(" ")).otherwise(
            F.concat(F.lit("k"), F.expr("cast(user_id * 7 + seq % 3 as string)"))).alias("idempotency_key"),
    )


query(
    "i04_drop_repeats",
    lambda v: ingest.drop_repeats(_keyed(v.events)).select("event_id", "idempotency_key"),
    """WITH k AS (SELECT CASE seq % 10 WHEN 0 THEN NULL WHEN 1 THEN 'e' ELSE event_id END AS event_id, timestamp, CASE seq % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE concat('k', user_id * 7 + seq % 3) END AS idempotency_key FROM raw_events)
    SELECT event_id, idempotency_key FROM k QUALIFY trim(coalesce(idempotency_key, '')) = '' OR row_number() OVER (PARTITION BY idempotency_key ORDER BY timestamp, event_id) = 1""",
)
query(
    "i04_drop_repeats_stream",
    # which of a key's events is first on a stream is not defined, so keyed ones are told by their key
    lambda v: _to_table(v, ingest.drop_repeats(_keyed(_streamed(v).events), delay="60 days")).select(
        "idempotency_key", F.when(F.trim(F.coalesce("idempotency_key", F.lit(""))) == "", F.coalesce("event_id", F.lit("none"))).alias("event_id")),
    """SELECT CASE seq % 5 WHEN 0 THEN NULL ELSE ' ' END AS idempotency_key, CASE seq % 10 WHEN 0 THEN 'none' WHEN 1 THEN 'e' ELSE event_id END AS event_id
    FROM raw_events WHERE seq % 5 < 2 UNION ALL SELECT DISTINCT concat('k', user_id * 7 + seq % 3), NULL FROM raw_events WHERE seq % 5 > 1""",
)


def _retried(v):
    """Five micro-batches, a restart before each; every 109th event fails as often as its number says, by 5."""
    base = scratch_path(v.spark, "retries")
    number = F.col("sequenceNumber")
    part_of = F.when(number % 109 == 0, number % 2).otherwise(number % 5)
    failure = F.when((number % 109 == 0) & (F.col("retry_count") < number % 5), "Store not reachable")
    for part in range(5):
        v.bodies.filter(part_of == part).drop("retry_count").write.mode("append").json(f"{base}/source")
        stream = readers.read_events_stream(v.spark, f"{base}/source", max_files=1_000_000)
        _finish(ingest.run_ingest(
            stream, f"{base}/staging", f"{base}/target", f"{base}/dlq", f"{base}/check", processed_at=v.now,
            failure=failure, **ingest.ingest_trigger(once=True)))
    done = readers.read_table(v.spark, f"{base}/staging").select(
        F.col("eventhub_sequence_number").alias("sequence_number"), F.lit("ok").alias("outcome"), F.col("retry_count").cast("bigint").alias("retry_count"),
        F.lit(None).cast("string").alias("reason"))
    dead = v.spark.read.json(f"{base}/dlq").select("sequence_number", F.lit("dead_letter"), "retry_count", "error_reason")
    return done.union(dead)


query(
    "i06_route_failures", _retried,
    f"""WITH r AS (SELECT seq, {REASON_SQL} AS reason, seq % 109 = 0 AS fails FROM raw_events)
    SELECT seq AS sequence_number, CASE WHEN reason IS NOT NULL OR (fails AND seq % 5 = 4) THEN 'dead_letter' ELSE 'ok' END AS outcome,
      CASE WHEN reason IS NULL AND fails THEN least(3, seq % 5) ELSE 0 END::bigint AS retry_count,
      CASE WHEN reason IS NOT NULL THEN reason WHEN fails AND seq % 5 = 4 THEN 'Max retries exceeded: Store not reachable' END AS reason FROM r""",
)


def _eligible(v):
    from adgauge.functions.bots import passes_agent_checks

    return v.events.filter(passes_agent_checks("user_agent")).select(
        F.col("event_id").alias("impression_id"), F.col("timestamp").alias("timestamp_utc"), "ip")


def _stream_rated(v):
    out, check = scratch_path(v.spark, "rated"), scratch_path(v.spark, "check")
    _finish(ingest.stream_rate(
        _eligible(_streamed(v)), out, check, limit=2, window_seconds=3600, ttl_seconds=7200, **ingest.ingest_trigger(once=True)))
    return readers.read_table(v.spark, out).select("impression_id", "window_count", "rate_exceeded")


query(
    "i07_stream_rate", _stream_rated,
    anchor_sql(ELIGIBLE_SQL, 3600, "SELECT event_id AS impression_id, window_count, window_count > 2 AS rate_exceeded FROM c"),
)


def _live(v):
    path = scratch_path(v.spark, "live")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    counts = ingest.live_counts(_streamed(v).impressions, "1 hour")
    writer = counts.writeStream.outputMode("update").foreachBatch(keep)
    check = scratch_path(v.spark, "check")
    _finish(ingest.checkpointed(writer, check).trigger(**ingest.ingest_trigger(once=True)).start())
    rows = readers.read_table(v.spark, path)
    keys = ["window_start", "campaign_id", "ingest_source"]
    return rows.groupBy(*keys).agg(
        F.max_by("events", "batch").alias("events"), F.max_by("bots", "batch").alias("bots")
    ).withColumn("window_start", stamp("window_start"))


query(
    "i08_live_counts", _live,
    f"""SELECT {ts("date_trunc('hour', timestamp_utc)")} AS window_start, campaign_id, ingest_source, count(*) AS events, count(*) FILTER (is_bot) AS bots
    FROM impressions GROUP BY 1, 2, 3""",
)


LATE_DAYS = 5


def _late(v):
    """The ingest job over three micro-batches by event time; every 50th event comes with the next one."""
    base = scratch_path(v.spark, "late")
    period = F.expr("greatest(0, least(2, datediff(enqueuedTime, date '2024-01-01') div 11))")
    part_of = F.least(F.lit(2), period + (F.col("sequenceNumber") % 50 == 7).cast("int"))
    for part in range(3):
        v.bodies.filter(part_of == part).drop("retry_count").write.mode("append").json(f"{base}/source")
        stream = readers.read_events_stream(v.spark, f"{base}/source", max_files=1_000_000)
        _finish(ingest.run_ingest(
            stream, f"{base}/staging", f"{base}/target", f"{base}/dlq", f"{base}/check", processed_at=v.now,
            late=f"{base}/late", lateness=LATE_DAYS * 86400.0, **ingest.ingest_trigger(once=True)))
    columns = ["event_id", "campaign_id", "ip", F.col("batch_id").cast("bigint").alias("batch")]
    on_time, late = (readers.read_table(v.spark, f"{base}/{part}").select(*columns) for part in ("staging", "late"))
    return on_time.withColumn("part", F.lit("on time")).unionByName(late.withColumn("part", F.lit("late")))


query(
    "i09_split_late", _late,
    f"""WITH d AS (SELECT event_id, campaign_id, ip, timestamp, least(2, greatest(0, least(2, date_diff('day', date '2024-01-01', timestamp::date) // 11))
        + (seq % 50 = 7)::int)::bigint AS batch FROM raw_events WHERE {REASON_SQL} IS NULL),
      n AS (SELECT batch, max(least(timestamp, timestamp '{views.NOW}')) AS newest FROM d GROUP BY 1),
      w AS (SELECT a.batch, max(b.newest) - INTERVAL {LATE_DAYS} DAY AS mark FROM n a JOIN n b ON b.batch < a.batch GROUP BY 1)
    SELECT event_id, campaign_id, ip, d.batch, CASE WHEN timestamp < mark THEN 'late' ELSE 'on time' END AS part FROM d LEFT JOIN w ON w.batch = d.batch""",
)


def _by_period(v, rows, ts, path):
    """Three sets of files by time, the stream stopped and started before each; every 50th row comes with the next."""
    period = F.expr(f"greatest(0, least(2, datediff({ts}, date '2024-01-01') div 11))")
    part_of = F.least(F.lit(2), period + (F.col("seq") % 50 == 7).cast("int"))
    for part in range(3):
        rows.filter(part_of == part).write.mode("append").parquet(path)
        yield readers.read_table_stream(v.spark, path, rows.schema, max_files=1_000_000)


def _limited(v):
    base = scratch_path(v.spark, "limited")
    rows = v.events.select(F.col("event_id").alias("impression_id"), F.col("timestamp").alias("timestamp_utc"), "ip", F.lit(0).alias("seq"))
    for stream in _by_period(v, rows, "timestamp_utc", f"{base}/source"):
        _finish(ingest.stream_limiter(stream, f"{base}/out", f"{base}/check", limit=2, window_seconds=43200, **ingest.ingest_trigger(once=True)))
    return readers.read_table(v.spark, f"{base}/out").select("impression_id", "allowed")


query("f06_stream_limiter", _limited, ADMITTED_SQL)


def _live_reach(v):
    """Estimated reach of a stream, late events included, per hour, day and campaign beside the exact count."""
    base = scratch_path(v.spark, "reach")
    rows = v.impressions.select("campaign_id", "panelist_id", "timestamp_utc", "is_bot", F.col("impression_id").substr(5, 20).cast("long").alias("seq"))
    for stream in _by_period(v, rows, "timestamp_utc", f"{base}/source"):
        _finish(reach.stream_reach(stream, f"{base}/out", f"{base}/check", **ingest.ingest_trigger(once=True)))
    bound = 4 * reach.standard_error()
    parts = []
    for level, by_campaign in (("hour", True), ("day", True), ("day", False), (None, True), (None, False)):
        unit = lambda c, level=level: F.date_trunc(level, c) if level else F.lit(None).cast("timestamp")
        campaign = F.col("campaign_id") if by_campaign else F.lit(None).cast("string")
        exact = rows.filter("NOT is_bot").groupBy(unit("timestamp_utc").alias("period"), campaign.alias("campaign_id")).agg(
            F.count_distinct("panelist_id").alias("exact"), F.count("*").alias("impressions"))
        found = reach.reach(v.spark, f"{base}/out", unit("hour"), by_campaign).withColumnsRenamed({"period": "p", "campaign_id": "c", "impressions": "i"})
        met = exact["period"].eqNullSafe(found["p"]) & exact["campaign_id"].eqNullSafe(found["c"])
        near = F.abs(F.col("panelists") - F.col("exact")) <= F.greatest(F.lit(1.0), bound * F.col("exact"))
        parts.append(exact.join(found, met, "full").select(
            F.lit(level or "all").alias("level"), stamp("period").alias("period"), "campaign_id", "exact",
            (near & (F.col("i") == F.col("impressions"))).alias("within")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


query(
    "e02_live_reach", _live_reach,
    " UNION ALL ".join(
        f"""SELECT '{level or "all"}' AS level, {ts(f"date_trunc('{level}', timestamp_utc)") if level else "NULL::varchar"} AS period,
        {"campaign_id" if by else "NULL::varchar"} AS campaign_id, count(DISTINCT panelist_id) AS exact, true AS within
        FROM impressions WHERE NOT is_bot GROUP BY 1, 2, 3"""
        for level, by in (("hour", True), ("day", True), ("day", False), (None, True), (None, False))),
)


def _compacted(v):
    """Three micro-batches staged by day; the first two are folded, the third comes beside them, all are read."""
    base = scratch_path(v.spark, "staged")
    rows = v.events.select("event_id", "campaign_id", "seq", F.to_date("timestamp").alias("date"))
    schema = rows.schema
    for number, stream in enumerate(_by_period(v, rows, "date", f"{base}/source")):
        writer = stream.writeStream.foreachBatch(lambda batch, i: staged.stage_batch(batch, i, f"{base}/table"))
        _finish(ingest.checkpointed(writer, f"{base}/check").trigger(**ingest.ingest_trigger(once=True)).start())
        if number == 1:
            staged.compact(v.spark, f"{base}/table", schema, upto=1)
            staged.clean(v.spark, f"{base}/table", keep=1)
    return staged.read_staged(v.spark, f"{base}/table", schema).withColumn("date", F.col("date").cast("string"))


query(
    "i10_compacted_staging", _compacted,
    "SELECT event_id, campaign_id, seq, timestamp::date::varchar AS date FROM raw_events",
)
