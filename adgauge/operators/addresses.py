"""Attributes of addresses by ranges: an equi-join on prefixes instead of a comparison with every range."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adgauge.session import cut

BITS = 32
IPV4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)\.(25[0-5]|2[0-4]\d|1?\d?\d)\.(25[0-5]|2[0-4]\d|1?\d?\d)\.(25[0-5]|2[0-4]\d|1?\d?\d)$"


def address_number(ip: Column) -> Column:
    """A dotted IPv4 address as a whole number, null for anything else."""
    parts = [F.regexp_extract(ip, IPV4, i + 1).cast("long") * 256 ** (3 - i) for i in range(4)]
    return F.when(ip.rlike(IPV4), parts[0] + parts[1] + parts[2] + parts[3])


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each range as blocks of a power of two that begin at a multiple of their size, at most two per size."""
    for ranges in batches:
        out = []
        for low, high, number in zip(ranges["low"], ranges["high"], ranges["range"], strict=True):
            at = int(low)
            while at <= high:
                free = (at & -at).bit_length() - 1 if at else BITS
                size = min(free, (int(high) - at + 1).bit_length() - 1)
                out.append((number, size, at >> size))
                at += 1 << size
        yield pd.DataFrame(out, columns=["range", "size", "prefix"])


def by_ranges(df: DataFrame, ranges: DataFrame, ip: str = "ip", value: str = "country", default: str = "XX") -> DataFrame:
    """Adds `value` of the narrowest range that holds the address, `default` where none does.

    `ranges` has low, high (dotted addresses, both inside) and `value`; of ranges of one width the lower start wins, then the
    lower value. Ranges are cut into aligned blocks, and each distinct address looks up its prefix of every block size
    that occurs, so a prefix with most of the addresses is a hot key of an equi-join, whose addresses may be split over
    tasks, and no address is compared with ranges elsewhere. Ranges that end before they start hold nothing.
    """
    numbered = ranges.select(address_number(F.col("low")).alias("low"), address_number(F.col("high")).alias("high"), F.col(value).alias("#value"))
    numbered = cut(numbered.filter("low <= high").withColumn("range", F.monotonically_increasing_id()))
    blocks = cut(numbered.select("low", "high", "range").mapInPandas(_blocks, "range long, size int, prefix long"))
    sizes = [r["size"] for r in blocks.select("size").distinct().collect()]  # 33 at most
    addresses = df.select(F.col(ip).alias("#ip")).distinct().select("#ip", address_number(F.col("#ip")).alias("n")).filter("n IS NOT NULL")
    tried = addresses.select("#ip", "n", F.explode(F.array(*[F.lit(s) for s in sizes]).cast("array<int>")).alias("size"))
    met = tried.withColumn("prefix", F.expr("shiftright(n, size)")).join(blocks, ["size", "prefix"])
    wide = F.struct((F.col("high") - F.col("low")).alias("width"), "low", "#value")
    best = met.join(numbered, "range").groupBy("#ip").agg(F.min(wide).alias("best")).select("#ip", F.col("best.#value").alias("#value"))
    joined = df.join(best, df[ip] == best["#ip"], "left")
    return joined.select(*[df[c] for c in df.columns if c != value], F.coalesce("#value", F.lit(default)).alias(value))
