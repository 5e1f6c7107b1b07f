"""Exact de-duplication as a stream with keyed state on disk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adgauge.llm.common import keep_rows, settings, text_key
from adgauge.session import cut, scratch_path

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STAYS = ("doc_id", "row", "file")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def fold_stream(spark: SparkSession, log: str, schema: str, state: str, out: str, files_per_trigger: int | None = None) -> None:
    """Streams the rows of `log` into the state per digest and writes the digests each batch changed.

    The state has digest, number of rows, and of the row that stays the identifier and the file that
    holds its text. It has no watermark, so nothing expires, and lies in RocksDB on the executors' disks
    with its change log under `state`. Called again with the same folders, it takes only new files.
    A batch that is run again overwrites its own folder.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    kept = reader.parquet(log).groupBy("digest").agg(F.max(F.struct(*STAYS)).alias("stays"), F.count("*").alias("group_size"))

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    with settings(
        spark, spark__sql__streaming__stateStore__providerClass=STATE_STORE,
        spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled="true",
        spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage="true",
        spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB="128",
        spark__sql__streaming__stateStore__rocksdb__writeBufferSizeMB="4",  # per partition of the state, beside the heap
        spark__sql__streaming__stateStore__rocksdb__allowFAllocate="false",  # else each partition reserves megabytes
    ):
        stream = kept.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True)
        stream.foreachBatch(write).start().awaitTermination()


def find_copies(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_trigger: int | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, digest, keep_id, group_size, kept, key (the `text_key`).

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the largest
    doc_id stays (null is smallest); of rows that also share the doc_id, one. The stream groups by digest
    and keeps no text. Then the bytes are checked: each task reduces its (digest, text) pairs, and a
    digest that more than one text has is grouped anew by the texts themselves, so that a weak digest
    costs time, not rows. An empty table gives no rows; other columns, whatever their names,
    are not read.
    """
    spark = docs.sparkSession
    content = F.coalesce(docs["text"], F.lit(""))
    texts = docs.select(docs["doc_id"].alias("doc_id"), digest(content).alias("digest"), content.alias("text"))
    log = scratch_path(spark, "digests")
    rows = texts.select("doc_id", "digest", text_key(F.col("text")).alias("key"), F.monotonically_increasing_id().alias("row"), F.input_file_name().alias("file"))
    rows.write.parquet(log)
    out = scratch_path(spark, "copies")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    fold_stream(spark, log, schema, scratch_path(spark, "state"), out, files_per_trigger)
    said = "digest binary, stays struct<doc_id:bigint,row:bigint,file:string>, group_size bigint, batch int"
    said = said.replace("digest binary", f"digest {rows.schema['digest'].dataType.simpleString()}").replace("doc_id:bigint", f"doc_id:{rows.schema['doc_id'].dataType.simpleString()}")
    spark.createDataFrame([], said).write.mode("append").partitionBy("batch").parquet(out)  # an empty table has no batch
    latest = spark.read.schema(said).parquet(out).groupBy("digest").agg(F.max_by(F.struct("stays", "group_size"), "batch").alias("last")).select("digest", "last.stays", "last.group_size")
    latest = cut(latest)  # joined as a table, so that a hot digest can be split
    logged = spark.read.schema(rows.schema).parquet(log)

    several = texts.groupBy("digest", "text").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest")
    several = cut(several)  # digests of which the bytes differ: none, unless the digest is weak
    clean = logged.join(several, "digest", "left_anti").join(latest, "digest")
    clean = clean.select("doc_id", "digest", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("stays.row")).alias("kept"), "key")

    again = cut(texts.join(several, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()))
    best = again.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "row")).alias("stays"), F.count("*").alias("group_size"))
    exact = again.join(best, ["digest", "text"]).select("doc_id", "digest", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("stays.row")).alias("kept"), text_key(F.col("text")).alias("key"))
    return clean.unionByName(exact)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with their own columns; see `find_copies`."""
    found = find_copies(docs)
    same = found.filter("doc_id <=> keep_id").groupBy(F.col("doc_id").alias("win_id"), F.col("key").alias("win_key")).agg(F.count("*").alias("win_rows"))
    return keep_rows(docs, cut(same))


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
  count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents"""
