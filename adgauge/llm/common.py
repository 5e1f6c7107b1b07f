"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(c, UPPER, LOWER)


def n_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """With the doc_id, tells rows of different texts apart; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the time of a block; underscores in pairs stand for dots."""
    named = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in named}
    for k, v in named.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def keep_rows(docs: DataFrame, winners: DataFrame) -> DataFrame:
    """The rows of `docs` that `winners` names, with their own columns.

    `winners` has the columns win_id and win_key (the `text_key`), each pair once, and win_rows, the
    number of rows of `docs` with that pair. Where rows repeat, the first in the order of their columns
    stays (as JSON if a column has no order, as maps have none); repeats meet only after each task has reduced
    its own to one.
    """
    names = docs.columns
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_key(F.col("text")).alias("key"))

    def among(chosen: DataFrame) -> DataFrame:
        match = packed["id"].eqNullSafe(chosen["win_id"]) & (packed["key"] == chosen["win_key"])
        return packed.join(chosen, match, "left_semi")

    single = among(winners.filter("win_rows = 1")).select("row")
    ordered = not any(kind in docs.schema.simpleString() for kind in ("map<", "variant"))
    first = F.min("row") if ordered else F.min_by("row", F.to_json("row"))
    several = among(winners.filter("win_rows > 1")).groupBy("id", "key").agg(first.alias("row")).select("row")
    return single.unionByName(several).select(*[F.col("row").getField(n).alias(n) for n in names])
