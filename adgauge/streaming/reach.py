"""Unique panelists of a stream, as sketches per hour and campaign that roll up without the events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from adgauge.streaming.ingest import checkpointed, ingest_trigger

LOG_SIZE = 12  # sketches of 4096 registers, a few kilobytes each
SHAPE = "hour timestamp, campaign_id string, sketch binary, impressions bigint, batch_id bigint"


def standard_error(log_size: int = LOG_SIZE) -> float:
    """Relative standard error of an estimate; small counts are near exact."""
    return 1.04 / 2 ** (log_size / 2)


def hourly_sketches(impressions: DataFrame, log_size: int = LOG_SIZE, ts: str = "timestamp_utc") -> DataFrame:
    """hour, campaign_id, sketch, impressions of valid impressions; combined by tasks before the shuffle."""
    valid = impressions.filter(~F.col("is_bot"))
    return valid.groupBy(F.date_trunc("hour", ts).alias("hour"), "campaign_id").agg(
        F.hll_sketch_agg("panelist_id", F.lit(log_size)).alias("sketch"), F.count("*").alias("impressions"))


def stream_reach(stream: DataFrame, path: str, checkpoint: str, log_size: int = LOG_SIZE, **trigger) -> StreamingQuery:
    """Writes the sketches of each micro-batch under `path`, by batch id; a replayed batch overwrites its own.

    An hour that events reach late gets another row, and the merge of its rows is its answer: nothing is revised.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        hourly_sketches(batch, log_size).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write).trigger(**(trigger or ingest_trigger()))
    return checkpointed(writer, checkpoint).start()


def reach(spark: SparkSession, path: str, period: Column | None = None, by_campaign: bool = True) -> DataFrame:
    """period, campaign_id, panelists (estimated), impressions; `period` is an expression over `hour`, none for all time."""
    hours = spark.read.schema(SHAPE).parquet(path)
    keys = [(period if period is not None else F.lit(None).cast("timestamp")).alias("period")]
    keys.append((F.col("campaign_id") if by_campaign else F.lit(None).cast("string")).alias("campaign_id"))
    return hours.groupBy(*keys).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("panelists"), F.sum("impressions").alias("impressions"))
