"""Table scans, document files and event streams. Filters and columns reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from adgauge import schemas
from adgauge.sources import documents


def read_table(
    spark: SparkSession, path: str, schema: StructType | None = None,
    jdbc: dict[str, str] | None = None,
) -> DataFrame:
    """Parquet table at `path`, or the JDBC table `path` when connection options are given.

    A large JDBC table needs partitionColumn, lowerBound, upperBound and numPartitions in `jdbc`
    to be read by more than one task.
    """
    if jdbc:
        return spark.read.format("jdbc").options(dbtable=path, **jdbc).load()
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def exposures(mapping: DataFrame, campaign_id: str) -> DataFrame:
    """Human exposures of a campaign; the filter is pushed to the scan."""
    return mapping.filter((F.col("campaign_id") == campaign_id) & ~F.col("is_bot")).select(
        "panelist_id", "impression_id", "campaign_id", "creative_id", "impression_ts",
        "device_type", "country_code", "is_bot",
        F.col("impression_id").isNotNull().cast("int").alias("exposed"),
    )


def cohorts(table: DataFrame, campaign_id: str, batch_id: str) -> DataFrame:
    return table.filter(
        (F.col("campaign_id") == campaign_id) & (F.col("processing_batch_id") == batch_id)
    ).select(
        "panelist_id", "campaign_id", "cohort_type", "match_id", "propensity_score", "balance_score"
    )


def survey_metrics(table: DataFrame, campaign_id: str) -> DataFrame:
    return table.filter(F.col("campaign_id") == campaign_id)


def read_documents(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Files that hold a JSON array of documents, with a fixed schema; files of any size are split over tasks."""
    read = documents.document_texts(spark, path)
    folders = read.schema["folder"].dataType.names if "folder" in read.columns else []
    carried = ["folder"] if folders else []
    rows = read.select(*[F.col(c).alias("_folder") for c in carried], F.inline(F.array(F.from_json("text", schema))))
    kinds = {f.name: f.dataType for f in (*(read.schema["folder"].dataType if folders else ()), *schema)}
    own = [F.col(f"`{c}`") for c in schema.names if c not in folders]
    return rows.select(*own, *[F.col(f"_folder.`{c}`").cast(kinds[c]).alias(c) for c in folders])


def read_json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One document per line: files of any size are split over tasks."""
    return spark.read.schema(schema).json(path)


def read_table_stream(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
    max_files: int = 100, glob: str | None = None,
) -> DataFrame:
    """File stream with a bounded micro-batch."""
    reader = (
        spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files)
    )
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def read_events_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Raw events (body text plus envelope) from JSON-lines files."""
    return read_table_stream(spark, path, schemas.RAW_EVENT, "json", max_files)


LANES = 10


def read_landed_stream(spark: SparkSession, path: str, schema: StructType, lane: int | None = None) -> DataFrame:
    """Events that `ingest.land_events` cut into small files: a micro-batch is one file.

    With `lane` only the files whose number ends in that digit: `LANES` streams, each with a checkpoint of its own, have every
    file once between them. Micro-batches follow one another inside a lane only, as in the partitions of a feed.
    """
    return read_table_stream(spark, path, schema, "parquet", 1, None if lane is None else f"*{lane}.*parquet")


def read_kafka_stream(spark: SparkSession, servers: str, topic: str, max_offsets: int = 10_000) -> DataFrame:
    """Raw events from a broker that speaks the Kafka protocol, with the same envelope names."""
    stream = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic).option("maxOffsetsPerTrigger", max_offsets).load()
    )
    return stream.select(
        F.col("value").cast("string").alias("body"),
        F.col("timestamp").alias("enqueuedTime"),
        F.col("offset").cast("string").alias("offset"),
        F.col("offset").alias("sequenceNumber"),
        F.lit(None).cast("string").alias("publisher"),
        F.col("key").cast("string").alias("partitionKey"),
    )


def event_body(columns: dict[str, Column]) -> Column:
    """Tracking-event JSON from columns by wire name; absent names become null fields."""
    fields = [
        columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.TRACKING_EVENT.fields
    ]
    return F.to_json(F.struct(*fields))
