"""Event ingest as streaming queries."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from adgauge.functions import bots
from adgauge.operators import events, rates
from adgauge.operators.impressions import ops_counts
from adgauge.session import cut
from adgauge.sources import keyed, sinks


def ingest_trigger(seconds: int = 30, once: bool = False) -> dict:
    """Trigger options: a fixed period, or everything available and stop."""
    return {"availableNow": True} if once else {"processingTime": f"{seconds} seconds"}


def checkpointed(writer: DataStreamWriter, path: str) -> DataStreamWriter:
    """One checkpoint folder per sink."""
    return writer.option("checkpointLocation", path)


# Write option for tables of one micro-batch each: nobody looks for the marker, and it costs as much as the rows.
NO_MARKER = ("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")

COMMIT_MANAGER = "spark.sql.streaming.checkpointFileManagerClass"
PLAIN_MANAGER = "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"


@contextmanager
def plain_commits(spark: SparkSession) -> Iterator[None]:
    """Streams started inside write their logs through the plain file system interface.

    A log entry is still a temporary file that is renamed, at a fraction of the cost where the file system has no native
    library. Unlike the default it does not hinder two runs that share a checkpoint by mistake, so a checkpoint needs one
    writer, as it does on object stores. A stream copies the session's settings when it starts; they are put back after.
    """
    before = spark.conf.get(COMMIT_MANAGER, None)
    spark.conf.set(COMMIT_MANAGER, PLAIN_MANAGER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(COMMIT_MANAGER)
        else:
            spark.conf.set(COMMIT_MANAGER, before)


def classify(
    parsed: DataFrame, bot_rules: str = "stream", geo_rules: str = "octet", rate_exceeded: str | None = None,
    limits: dict | None = None,
) -> DataFrame:
    """Bot flag, geography and date parts of parsed events."""
    flagged = events.apply_bot_rules(parsed, bot_rules, rate_exceeded, limits)
    return events.add_date_parts(events.enrich_geo(flagged, geo_rules))


def append_partitions(
    stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
    partitions: tuple[str, ...] = ("year", "month", "day"), **trigger,
) -> StreamingQuery:
    """Append-mode sink in date folders."""
    writer = (
        stream.writeStream.format(fmt).outputMode("append").option("path", path)
        .partitionBy(*partitions).trigger(**(trigger or ingest_trigger()))
    )
    return checkpointed(writer, checkpoint).start()


def rate_events(
    rows: DataFrame, batch_id: int, work: str, limit: int = 100, window_seconds: float = 60.0
) -> DataFrame:
    """Adds rate_exceeded to the events of a micro-batch, by the anchored rule per address.

    Only events that pass the agent checks count. The open windows are a table per batch id under `work`:
    a replayed batch starts from the table of the batch before, as the first time.
    """
    counted = rows.withColumn("_ip", F.when(bots.passes_agent_checks("user_agent"), F.col("ip")))
    rated = rated_batch(counted, batch_id, work, "_ip", "timestamp", "event_id", limit, window_seconds, processed="processed_at")
    return rated.drop("_ip", "window_count")


def rated_batch(
    rows: DataFrame, batch_id: int, work: str, key: str, ts: str, tie: str, limit: int, window_seconds: float,
    ttl_seconds: float = 300.0, processed: str | None = None,
) -> DataFrame:
    """A micro-batch with window_count and rate_exceeded, from the open windows of the batch before; writes its own."""
    spark = rows.sparkSession
    before, after = f"{work}/rates/batch={batch_id - 1}", f"{work}/rates/batch={batch_id}"
    shape = "key string, anchor bigint, seen bigint"
    carried = spark.read.schema(shape).parquet(before) if sinks.exists(spark, before) else spark.createDataFrame([], shape)
    rated, windows = rates.rate_batch(rows, carried, key, ts, tie, limit, window_seconds, ttl_seconds, processed)
    windows.write.mode("overwrite").parquet(after)
    sinks.remove(spark, f"{work}/rates/batch={batch_id - 2}")
    return rated


def stream_rate(
    stream: DataFrame, out: str, checkpoint: str, key: str = "ip", ts: str = "timestamp_utc", tie: str = "impression_id",
    limit: int = 100, window_seconds: float = 60.0, ttl_seconds: float = 300.0, **trigger,
) -> StreamingQuery:
    """The anchored rate per key as a stream: the rows with window_count and rate_exceeded, by batch id under `out`.

    A micro-batch is rated as the ingest job does it: the instants of a key are dealt over time cells whose chains are
    followed by pointers, so an address with half of all events is no single task. The state is the open window of each
    key, a table per batch id; a replayed batch starts from the same windows and overwrites its own rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rated = rated_batch(batch, batch_id, checkpoint, key, ts, tie, limit, window_seconds, ttl_seconds)
        rated.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write).trigger(**(trigger or ingest_trigger()))
    return checkpointed(writer, checkpoint).start()


def stream_limiter(
    stream: DataFrame, out: str, checkpoint: str, key: str = "ip", ts: str = "timestamp_utc", tie: str = "impression_id",
    limit: int = 1000, window_seconds: float = 60.0, ttl_seconds: float = 300.0, **trigger,
) -> StreamingQuery:
    """The sliding limiter as a stream: the rows with `allowed`, by batch id under `out`.

    The state is the admitted stamps that are still in a window, a table per batch id; see `rates.admit_batch`. A
    replayed batch starts from the same stamps and overwrites its own rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, shape = batch.sparkSession, "key string, t bigint, n bigint"
        before = f"{checkpoint}/admitted/batch={batch_id - 1}"
        carried = spark.read.schema(shape).parquet(before) if sinks.exists(spark, before) else spark.createDataFrame([], shape)
        rows, stamps = rates.admit_batch(batch, carried, key, ts, tie, limit, window_seconds, ttl_seconds)
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        stamps.write.mode("overwrite").parquet(f"{checkpoint}/admitted/batch={batch_id}")
        sinks.remove(spark, f"{checkpoint}/admitted/batch={batch_id - 2}")

    writer = stream.writeStream.foreachBatch(write).trigger(**(trigger or ingest_trigger()))
    return checkpointed(writer, checkpoint).start()


def land_events(stream: DataFrame, path: str, checkpoint: str, max_events: int = 10_000, **trigger) -> StreamingQuery:
    """Copies a stream of files into files of at most `max_events` rows.

    Read with one file per trigger (`readers.read_landed_stream`), a micro-batch then has no more events than that, however
    large the files that arrive. Spark's file sink lists each file once, so nothing is lost or doubled over a restart.
    """
    writer = stream.writeStream.format("parquet").option("path", path).option("maxRecordsPerFile", max_events)
    return checkpointed(writer, checkpoint).trigger(**(trigger or ingest_trigger())).start()


HOUR = 3600 * rates.SECOND


def with_history(
    rows: DataFrame, batch_id: int, path: str, key: str, windows: dict[str, float], gap_ms: int | None = None,
    lateness: float = 0.0,
) -> DataFrame:
    """Adds trailing counts per key that reach across micro-batches.

    Each batch adds its points, (key, t, n), to a table by hour and batch, and reads those of earlier batches
    from the hours that its own windows reach. A replayed batch overwrites its own points. Hours that neither this
    batch nor the widest window before its newest event needs, with `lateness` seconds to spare, are removed; events
    dated after their processing do not count as newest. An event within the lateness thus finds all points of its windows.
    Of its own points a batch adds only those that a later event within the lateness can reach, an hour in one file
    unless it is large: a batch that spans many days leaves the files of its last hours, whatever its number of tasks.
    """
    spark, span = rows.sparkSession, int(max(windows.values()) * rates.SECOND)
    at = F.unix_micros("timestamp")
    first, newest = rows.agg(F.min(at), F.least(F.max(at), F.unix_micros(F.max("processed_at")))).first()
    low = None if first is None else (first - span) // HOUR
    earlier = spark.createDataFrame([], "key string, t bigint, n bigint")
    hours = sinks.folders(spark, path)
    if hours and low is not None:
        table = spark.read.schema("key string, t bigint, n bigint, hour bigint, batch bigint").parquet(path)
        earlier = table.filter((F.col("hour") >= low) & (F.col("batch") < batch_id)).groupBy("key", "t").agg(F.sum("n").alias("n"))
    rated, own = rates.trailing_batch(rows, earlier, key, "timestamp", windows, gap_ms)
    rated = cut(rated)
    if low is not None:
        reach = (newest - span - int(lateness * rates.SECOND)) // HOUR
        stamped = own.select("key", "t", "n", F.floor(F.col("t") / HOUR).alias("hour"), F.lit(batch_id).cast("bigint").alias("batch"))
        kept = stamped.filter(F.col("hour") >= reach).hint("rebalance", "hour")
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour", "batch").parquet(path)
        needed = min(low, reach)
        for name in hours:
            if name.startswith("hour=") and name[5:].lstrip("-").isdigit() and int(name[5:]) < needed:
                sinks.remove(spark, f"{path}/{name}")
    return rated


def score_events(
    rows: DataFrame, batch_id: int, work: str, fingerprint: Column | None = None, gap_ms: int = 100,
    lateness: float = 0.0,
) -> DataFrame:
    """Adds fingerprint, n_minute, n_hour, rapid and n_day to the events of a micro-batch.

    Events carry no fingerprint of their own; without an expression for it that part of the score is skipped.
    """
    print_of = fingerprint if fingerprint is not None else F.lit(None).cast("string")
    rated = with_history(rows, batch_id, f"{work}/points/address", "ip", {"n_minute": 60, "n_hour": 3600}, gap_ms, lateness)
    marked = rated.withColumn("fingerprint", print_of)
    if fingerprint is None:
        return marked.withColumn("n_day", F.lit(None).cast("bigint"))
    return with_history(marked, batch_id, f"{work}/points/fingerprint", "fingerprint", {"n_day": 86400}, lateness=lateness)


def split_by_watermark(
    rows: DataFrame, batch_id: int, work: str, lateness: float, ts: str = "timestamp", processed: str = "processed_at"
) -> tuple[DataFrame, DataFrame]:
    """(on time, late) of a micro-batch against a watermark that is kept across micro-batches.

    The watermark of a batch is the newest event time of all batches before it, less `lateness` seconds; events dated
    after their processing count at their processing time. It is a one-row table per batch id under `work`: a replayed
    batch starts from the one before, and splits as at first. Rows of one batch do not make each other late, rows
    without a time are on time, and before the first event nothing is late.
    """
    spark, shape = rows.sparkSession, "newest timestamp"
    before = f"{work}/newest/batch={batch_id - 1}"
    held = spark.read.schema(shape).parquet(before).first()["newest"] if sinks.exists(spark, before) else None
    own = rows.agg(F.max(F.least(ts, processed)).alias("newest"))
    own.select(F.greatest("newest", F.lit(held).cast("timestamp")).alias("newest")).write.mode("overwrite").parquet(f"{work}/newest/batch={batch_id}")
    sinks.remove(spark, f"{work}/newest/batch={batch_id - 2}")
    if held is None:
        return rows, rows.limit(0)
    return split_late(rows, F.lit(held).cast("timestamp"), ts, f"{lateness} seconds")


def with_retries(batch: DataFrame, batch_id: int, work: str) -> DataFrame:
    """A micro-batch and the events that the one before left to be tried again, with retry_count.

    The events to retry are a table per batch id under `work`, so a replayed batch tries the same ones again.
    """
    spark, before = batch.sparkSession, f"{work}/retries/batch={batch_id - 1}"
    count = F.coalesce("retry_count", F.lit(0)) if "retry_count" in batch.columns else F.lit(0)
    counted = batch.withColumn("retry_count", count.cast("int"))
    if not sinks.exists(spark, before):
        return counted
    return counted.unionByName(spark.read.schema(counted.schema).parquet(before))


def keep_retries(judged: DataFrame, columns: list[str], batch_id: int, work: str) -> None:
    """Writes the events of route `retry` for the next micro-batch, their count raised by one."""
    again = judged.filter("route = 'retry'").select(*columns).withColumn("retry_count", F.col("retry_count") + 1)
    again.write.mode("overwrite").parquet(f"{work}/retries/batch={batch_id}")
    sinks.remove(judged.sparkSession, f"{work}/retries/batch={batch_id - 2}")


def run_ingest(
    raw: DataFrame, staging: str, target: str, dead_letters: str, checkpoint: str,
    processed_at: Column | None = None, bot_rules: str = "stream", geo_rules: str = "octet",
    rate_limit: int = 100, rate_seconds: float = 60.0, fingerprint: Column | None = None,
    score_limits: dict | None = None, late: str | None = None, lateness: float = 3600.0,
    failure: Column | None = None, max_retries: int = 3, **trigger,
) -> StreamingQuery:
    """Raw bodies -> staging append, keyed upsert, late rows and dead letters, from one read of the source.

    Staging is written per batch id, so a replayed batch overwrites its own folder. The `consumer` rules
    include the rate per address, the `scored` rules trailing counts per address and `fingerprint`; the windows of
    both reach across micro-batches. `score_limits` replaces entries of `bots.SCORE_LIMITS`.

    With `late`, events more than `lateness` seconds behind the watermark go there, by batch id, and are neither counted
    nor staged; the scored rules need it, as the points of such events' windows may be gone. `failure` is a column over
    `data` and the envelope that says why processing an event failed, or null. A failed event comes again with the next
    micro-batch, its retry_count one higher; with `max_retries` it is a dead letter. Staging then has the column retry_count.
    """
    limits = bots.SCORE_LIMITS | (score_limits or {})
    if bot_rules == "scored" and late is None:
        raise ValueError("the scored rules need a folder for late events")

    def write(batch: DataFrame, batch_id: int) -> None:
        stamp = processed_at if processed_at is not None else F.current_timestamp()
        fed = batch if failure is None else with_retries(batch, batch_id, checkpoint)
        # One decoding per body: all sinks read the persisted, judged batch.
        judged = events.validity(fed)
        if failure is not None:
            judged = events.route_failures(judged.withColumn("failure", failure), max_retries)
        judged = judged.persist()
        valid, rejected = events.split_judged(judged)
        if failure is not None:
            keep_retries(judged, fed.columns, batch_id, checkpoint)
            valid, rejected = events.split_routed(judged)
        parsed, flag = events.flatten_events(valid, stamp, ("retry_count",) if failure is not None else ()), None
        if late is not None:
            parsed, behind = split_by_watermark(parsed, batch_id, checkpoint, lateness)
            behind.write.mode("overwrite").parquet(f"{late}/batch_id={batch_id}")
        if bot_rules == "consumer":
            parsed, flag = rate_events(parsed, batch_id, checkpoint, rate_limit, rate_seconds), "rate_exceeded"
        elif bot_rules == "scored":
            parsed = score_events(parsed, batch_id, checkpoint, fingerprint, limits["gap_ms"], lateness)
        rows = classify(parsed, bot_rules, geo_rules, flag, limits)
        rows = rows.drop("rate_exceeded", "window_count", "fingerprint", "n_minute", "n_hour", "rapid", "n_day").persist()
        try:
            (
                rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch_id", "year", "month", "day").parquet(staging)
            )
            keyed.upsert_batch(events.staging_columns(rows), batch_id, target)
            sinks.write_dead_letters(
                rejected, f"{dead_letters}/batch_id={batch_id}", stamp, mode="overwrite"
            )
        finally:
            rows.unpersist()
            judged.unpersist()

    writer = raw.writeStream.foreachBatch(write).trigger(**(trigger or ingest_trigger()))
    return checkpointed(writer, checkpoint).start()


def drop_repeats(
    df: DataFrame, key: str = "idempotency_key", ts: str = "timestamp", delay: str = "10 minutes"
) -> DataFrame:
    """Drops repeats of a seen key; every row without a key passes. Exact in batch, within the watermark
    on a stream, where keyless rows enter no state and are never late."""
    blank = F.col(key).isNull() | (F.trim(F.col(key)) == "")
    keyed, keyless = df.filter(~blank), df.filter(blank)
    if df.isStreaming:
        unique = keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
    else:
        row = F.struct(*[F.col(c) for c in df.columns])
        unique = keyed.groupBy(F.col(key).alias("_dedupe")).agg(
            F.min_by(row, F.struct(ts, "event_id")).alias("r")
        ).select("r.*")
    return unique.unionByName(keyless)


def live_counts(
    stream: DataFrame, window: str = "1 minute", delay: str = "10 minutes", ts: str = "timestamp_utc"
) -> DataFrame:
    """Counts per window, campaign and source for update- or append-mode sinks."""
    watermarked = stream.withWatermark(ts, delay) if stream.isStreaming else stream
    return ops_counts(watermarked, window, ts)


def split_late(
    df: DataFrame, newest: Column, ts: str = "timestamp", delay: str = "10 minutes"
) -> tuple[DataFrame, DataFrame]:
    """(on time, late) against the newest event time already seen, for a sink of late rows."""
    late = F.col(ts) < newest - F.expr(f"interval {delay}")
    return df.filter(~late | F.col(ts).isNull()), df.filter(late)
