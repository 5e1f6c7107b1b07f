"""Staging by micro-batch, and the job that folds its small files into files by size.

A stream writes ``live/batch_id=<id>/date=<day>``. A compaction takes all batches up to one that is complete and
rewrites the days they touch, with what was folded of those days before, to ``folded/v=<n>/date=<day>``. The version
table says up to which batch the live folders are folded and which version holds each day. Readers take the newest version
whose success marker is there: they open the named days and the live batches beyond, so a compaction may run beside the
stream and beside readers; `clean` removes later what no kept version needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adgauge.sources import sinks

VERSION = "upto bigint, days map<string,bigint>"
NO_DATE = "__HIVE_DEFAULT_PARTITION__"


def stage_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """Rows with a `date`, written by batch; a replayed batch overwrites its own folder."""
    rows.write.mode("overwrite").partitionBy("date").parquet(f"{path}/live/batch_id={batch_id}")


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    cut = len(prefix)
    return sorted(int(n[cut:]) for n in sinks.folders(spark, path) if n.startswith(prefix))


def _done(spark: SparkSession, path: str) -> list[int]:
    """Versions with a success marker."""
    return [n for n in _numbers(spark, f"{path}/versions", "v=") if sinks.exists(spark, f"{path}/versions/v={n}/_SUCCESS")]


def _newest(spark: SparkSession, path: str) -> tuple[int, int, dict[str, int]]:
    """(version, last batch folded, day -> version that holds it)."""
    done = _done(spark, path)
    if not done:
        return -1, -1, {}
    row = spark.read.schema(VERSION).json(f"{path}/versions/v={done[-1]}").first()
    return done[-1], row["upto"], row["days"] or {}


def _live(spark: SparkSession, path: str, after: int, upto: int | None = None) -> list[str]:
    """Folders of complete batches."""
    ids = [n for n in _numbers(spark, f"{path}/live", "batch_id=") if n > after and (upto is None or n <= upto)]
    return [f"{path}/live/batch_id={n}" for n in ids if sinks.exists(spark, f"{path}/live/batch_id={n}/_SUCCESS")]


def _rows(spark: SparkSession, schema, folders: list[str], dated: list[tuple[str, str]]) -> DataFrame:
    """Rows of batch folders (partitioned by date) and of single days."""
    names = schema.fieldNames()
    frames = [spark.read.schema(schema).parquet(f) for f in folders]
    for base in sorted({b for b, _ in dated}):
        days = [f"{base}/date={d}" for b, d in dated if b == base]
        frames.append(spark.read.schema(schema).option("basePath", base).parquet(*days))
    out = spark.createDataFrame([], schema)
    for frame in frames:
        out = out.unionByName(frame.select(*names))
    return out


def read_staged(spark: SparkSession, path: str, schema) -> DataFrame:
    _, upto, days = _newest(spark, path)
    return _rows(spark, schema, _live(spark, path, upto), [(f"{path}/folded/v={v}", d) for d, v in days.items()])


def compact(spark: SparkSession, path: str, schema, upto: int) -> None:
    """Folds the live batches up to `upto`, one that the stream has completed. Rewrites the days that they touch only.

    One compaction runs at a time; what a lost one began is overwritten by the next.
    """
    number, before, days = _newest(spark, path)
    folders = _live(spark, path, before, upto)
    if not folders:
        return
    touched = sorted({n[5:] for f in folders for n in sinks.folders(spark, f) if n.startswith("date=")})
    old = [(f"{path}/folded/v={days[d]}", d) for d in touched if d in days]
    made = number + 1
    rows = _rows(spark, schema, folders, old)
    rows.hint("rebalance", "date").write.mode("overwrite").partitionBy("date").parquet(f"{path}/folded/v={made}")
    row = spark.createDataFrame([(upto, {**days, **dict.fromkeys(touched, made)})], VERSION)
    row.coalesce(1).write.mode("overwrite").json(f"{path}/versions/v={made}")


def clean(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Removes live batches, days and versions that none of the last `keep` versions needs."""
    numbers = _done(spark, path)[-keep:]
    if not numbers:
        return
    kept = spark.read.schema(VERSION).json([f"{path}/versions/v={n}" for n in numbers]).collect()
    needed = {(v, d) for r in kept for d, v in (r["days"] or {}).items()}
    for n in _numbers(spark, f"{path}/live", "batch_id="):
        if n <= min(r["upto"] for r in kept):
            sinks.remove(spark, f"{path}/live/batch_id={n}")
    for v in _numbers(spark, f"{path}/folded", "v="):
        for name in sinks.folders(spark, f"{path}/folded/v={v}") if v <= numbers[-1] else []:
            if name.startswith("date=") and (v, name[5:]) not in needed:
                sinks.remove(spark, f"{path}/folded/v={v}/{name}")
    for n in _numbers(spark, f"{path}/versions", "v="):
        if n < numbers[0]:
            sinks.remove(spark, f"{path}/versions/v={n}")
