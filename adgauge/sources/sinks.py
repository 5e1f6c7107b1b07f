"""Writers: partitioned appends, dead letters and exports. The keyed table is in `keyed`."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, partitions: tuple[str, ...] = ("campaign_id", "processing_batch_id")) -> None:
    """Appends to a partitioned table; readers of one campaign and batch open one folder."""
    keys = [c for c in partitions if c in df.columns]
    df.write.mode("append").partitionBy(*keys).parquet(path)


def write_staging(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Batch append by year, month and day."""
    df.write.format(fmt).mode("append").partitionBy("year", "month", "day").save(path)


def write_dead_letters(df: DataFrame, path: str, now: Column, mode: str = "append") -> None:
    """Rejected events with reason and envelope, one folder per day."""
    optional = {
        "sequenceNumber": "sequence_number", "offset": "offset",
        "partitionKey": "partition_key", "enqueuedTime": "enqueued_time", "retry_count": "retry_count",
    }
    df.select(
        F.col("body").cast("string").alias("original_event"),
        "error_reason",
        now.alias("timestamp"),
        *[F.col(c).alias(name) for c, name in optional.items() if c in df.columns],
        F.to_date(now).alias("dlq_date"),
    ).write.mode(mode).partitionBy("dlq_date").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_arrays(lines: DataFrame, path: str, files: int = 8) -> None:
    """JSON documents, one per row of `value`, as files that hold one JSON array each; a task streams its file."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for batch in batches:
            rows = [("," if i else before) + row for i, row in enumerate(batch.column("value").to_pylist())]
            before = "," if rows else before
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if before == "[" else "]"])], ["value"])

    lines.select("value").repartition(files, "value").mapInArrow(marked, "value string").write.mode("overwrite").text(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it does not exist."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(target) if s.isDirectory()] if system.exists(target) else []
