"""A keyed table on Parquet: micro-batches add change files, readers merge them, a job folds them together.

The folder of a table has

* ``changes/batch=<id>``: the last row of each key of one micro-batch, with its order of arrival,
* ``base/v=<n>``: rows merged by a compaction, partitioned by date,
* ``versions/v=<n>``: one small table that names the base and the change folders which make up version n.

A version is there once its folder has its success marker, which Spark writes last. Readers take the newest version
and open only what it names, so no reader sees half a batch or half a compaction, and a micro-batch writes in
proportion to its own rows, however large the table and wherever its keys were before.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adgauge.operators.changes import last_of_each
from adgauge.sources import sinks

ORDER = "_arrived"
VERSION = "base string, changes array<string>, batches array<bigint>"
#: What readers of the same time may still hold.
KEPT_VERSIONS = 3
LISTED_VERSIONS = 50
STALE_SECONDS = 60


def _versions(spark: SparkSession, target: str) -> list[int]:
    """Numbers of all version folders, newest first; one without a success marker is being written, or never was."""
    return sorted((int(n[2:]) for n in sinks.folders(spark, f"{target}/versions") if n.startswith("v=")), reverse=True)


def _done(spark: SparkSession, target: str, number: int) -> bool:
    return sinks.exists(spark, f"{target}/versions/v={number}/_SUCCESS")


def _newest(spark: SparkSession, target: str) -> tuple[int, str | None, list[str], list[int]]:
    """(version, base, change folders, ids of the last batches)."""
    number = next((n for n in _versions(spark, target) if _done(spark, target, n)), -1)
    if number < 0:
        return -1, None, [], []
    row = spark.read.schema(VERSION).json(f"{target}/versions/v={number}").first()
    return number, row["base"], row["changes"], row["batches"]


def _publish(spark: SparkSession, target: str, number: int, base: str | None, changes: list[str], batches: list[int]) -> None:
    """Fails if the version is there: another writer was first. One that was begun and stays unfinished is of a lost writer."""
    path = f"{target}/versions/v={number}"
    end = time.monotonic() + STALE_SECONDS
    while sinks.exists(spark, path) and not _done(spark, target, number):
        if time.monotonic() >= end:
            sinks.remove(spark, path)
            break
        time.sleep(1)
    spark.createDataFrame([(base, changes, batches)], VERSION).coalesce(1).write.mode("error").json(path)
    sinks.remove(spark, f"{target}/versions/v={number - LISTED_VERSIONS}")  # the list alone; its folders go with `clean`


def _advance(spark: SparkSession, target: str, change: Callable[[str | None, list[str], list[int]], tuple]) -> None:
    """Publishes what `change` makes of the newest version; anew if another writer was first."""
    while True:
        number, *now = _newest(spark, target)
        try:
            _publish(spark, target, number + 1, *change(*now))
            return
        except Exception:
            if _newest(spark, target)[0] == number:  # nobody was
                raise


def upsert_batch(
    batch: DataFrame, batch_id: int, target: str, key: str = "tracking_hash",
    order: tuple[str, ...] = ("processed_at", "event_id"),
) -> None:
    """Merges a micro-batch into the table: per key the last row of the last batch wins.

    Rows without a key match nothing and are all added. A batch that is replayed writes the same folder again and
    publishes it once; an empty batch publishes nothing. Batch ids rise, as those of a stream do.
    """
    spark = batch.sparkSession
    if batch_id in _newest(spark, target)[3] or batch.isEmpty():
        return
    folder = f"changes/batch={batch_id}"
    arrived = F.lit(batch_id).cast("bigint").alias(ORDER)
    last_of_each(batch, key, list(order)).select("*", arrived).write.mode("overwrite").parquet(f"{target}/{folder}")
    # of the batches only the newest can come again
    _advance(spark, target, lambda base, changes, batches: (base, [*changes, folder], [*batches, batch_id][-KEPT_VERSIONS:]))


def _merged(base: DataFrame | None, changes: DataFrame | None, key: str) -> DataFrame:
    """Per key the row that arrived last; rows of the base that no change touches pass without a shuffle of their own."""
    if changes is None:
        return base
    keyless = changes.filter(F.col(key).isNull())
    latest = changes.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(
        F.max_by(F.struct(*changes.columns), ORDER).alias("row")).select("row.*")
    changed = latest.unionByName(keyless)
    if base is None:
        return changed
    return base.join(latest.select(key), key, "left_anti").select(*changed.columns).unionByName(changed)


def _schema(rows) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.fields)


def _read(spark: SparkSession, target: str, schema: str, base: str | None, changes: list[str], key: str) -> DataFrame:
    full = f"{schema}, {ORDER} bigint"
    held = spark.read.schema(full).parquet(f"{target}/{base}") if base else None
    new = spark.read.schema(full).parquet(*[f"{target}/{c}" for c in changes]) if changes else None
    if held is None and new is None:
        return spark.createDataFrame([], full)
    return _merged(held, new, key)


def read_keyed(spark: SparkSession, target: str, schema=None, key: str = "tracking_hash", version: int | None = None) -> DataFrame:
    """The table at its newest version, or at one of the versions kept; `schema` is that of the rows, or read from a file."""
    number, base, changes, _ = _newest(spark, target)
    if version is not None and version != number:
        row = spark.read.schema(VERSION).json(f"{target}/versions/v={version}").first()
        base, changes = row["base"], row["changes"]
    if schema is None:
        schema = spark.read.parquet(f"{target}/{changes[0] if changes else base}").drop(ORDER).schema
    return _read(spark, target, _schema(schema), base, changes, key).drop(ORDER)


def version(spark: SparkSession, target: str) -> int:
    """Number of the newest version, -1 before the first."""
    return _newest(spark, target)[0]


def fold_changes(spark: SparkSession, target: str, schema=None, key: str = "tracking_hash") -> None:
    """Makes one change folder of all, at a cost that follows the changes and not the table."""
    _compact(spark, target, schema, key, None)


def compact(spark: SparkSession, target: str, schema=None, key: str = "tracking_hash", partition: str = "date") -> None:
    """Makes a new base of the base and all changes, partitioned by `partition`, files by size.

    Runs beside the stream: batches published meanwhile stay as changes of the new version.
    """
    _compact(spark, target, schema, key, partition)


def _compact(spark: SparkSession, target: str, schema, key: str, partition: str | None) -> None:
    number, base, changes, _ = _newest(spark, target)
    if not changes or (partition is None and len(changes) == 1):
        return
    if schema is None:
        schema = spark.read.parquet(f"{target}/{changes[0]}").drop(ORDER).schema
    if partition is None:
        made = f"changes/folded={number}"
        _read(spark, target, _schema(schema), None, changes, key).write.mode("overwrite").parquet(f"{target}/{made}")
    else:
        made = f"base/v={number}"
        rows = _read(spark, target, _schema(schema), base, changes, key)
        rows.hint("rebalance", partition).write.mode("overwrite").partitionBy(partition).parquet(f"{target}/{made}")

    def change(now_base: str | None, now: list[str], batches: list[int]) -> tuple:
        rest = [c for c in now if c not in changes]
        return (now_base, [made, *rest], batches) if partition is None else (made, rest, batches)

    _advance(spark, target, change)


def clean(spark: SparkSession, target: str, keep: int = KEPT_VERSIONS) -> None:
    """Removes the versions before the last `keep`, and the folders that none of the rest names.

    A change folder of a batch that is being written is newer than all that are named, and stays.
    """
    numbers = sorted(n for n in _versions(spark, target) if _done(spark, target, n))
    kept = numbers[-keep:]
    if not kept:
        return
    rows = spark.read.schema(VERSION).json([f"{target}/versions/v={n}" for n in kept]).collect()
    named = {r["base"] for r in rows} | {c for r in rows for c in r["changes"]}
    newest = max((b for r in rows for b in r["batches"]), default=-1)
    for part in ("base", "changes"):
        for name in sinks.folders(spark, f"{target}/{part}"):
            done = not name.startswith("batch=") or int(name[6:]) <= newest
            fresh = part == "base" and name.startswith("v=") and int(name[2:]) >= kept[-1]
            if f"{part}/{name}" not in named and done and not fresh:
                sinks.remove(spark, f"{target}/{part}/{name}")
    for n in numbers[:-keep]:
        sinks.remove(spark, f"{target}/versions/v={n}")
