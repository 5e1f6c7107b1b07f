"""Best-fit packing of documents into bins of a fixed length, under conflicts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adgauge.llm.mixing import n_tokens
from adgauge.session import cut

CAPACITY = 2048
GROUP_PIECES = 4096
COPIES = 1024
PIECE = "doc_id long, nameless boolean, source string, cluster long, length long, piece long, copy long, group long"
PACKED = "doc_id long, nameless boolean, source string, cluster long, piece long, copy long, length long, group long, bin long, start long, residual long"


class Bins:
    """Open bins by residual, in a tree over the residuals 0 to `capacity`.

    A bin has a bitmap of the sources and duplicate clusters in it. A node of the tree holds the bits that
    all bins below it have in common, or none if there is no bin: where they include a bit that a piece
    must not meet, no bin below is compatible, and the search goes on to the next residual.
    """

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << (capacity).bit_length()
        self.common: list[int | None] = [None] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits: list[int] = []
        self.residual: list[int] = []

    def _renew(self, residual: int) -> None:
        common = None
        for b in self.at[residual]:
            common = self.bits[b] if common is None else common & self.bits[b]
            if not common:
                break
        node = residual + self.leaves
        self.common[node] = common
        while node > 1:
            node >>= 1
            left, right = self.common[2 * node], self.common[2 * node + 1]
            both = right if left is None else left if right is None else left & right
            if both == self.common[node]:
                break
            self.common[node] = both

    def _search(self, node: int, low: int, high: int, least: int, mask: int) -> int | None:
        """The first compatible bin below a node with a residual of `least` or more."""
        if high < least or self.common[node] is None or self.common[node] & mask:
            return None
        if low == high:
            return next((b for b in self.at[low] if not self.bits[b] & mask), None)
        middle = (low + high) // 2
        found = self._search(2 * node, low, middle, least, mask)
        return self._search(2 * node + 1, middle + 1, high, least, mask) if found is None else found

    def put(self, length: int, mask: int, capacity: int) -> tuple[int, int]:
        """Puts a piece into the tightest compatible bin, or a new one; gives the bin and the start in it."""
        b = self._search(1, 0, self.leaves - 1, length, mask)
        if b is None:
            b = len(self.bits)
            self.bits.append(0)
            self.residual.append(capacity)
        else:
            self.at[self.residual[b]].remove(b)
            self._renew(self.residual[b])
        start = capacity - self.residual[b]
        self.bits[b] |= mask
        self.residual[b] -= length
        self.at[self.residual[b]].append(b)
        self._renew(self.residual[b])
        return b, start


def pack_group(pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Best fit, longest piece first. `pieces` has the columns of `PIECE`."""
    ordered = pieces.sort_values(["length", "nameless", "doc_id", "source", "cluster", "piece", "copy"], ascending=[False, True, True, True, True, True, True], kind="stable")
    bits: dict[tuple, int] = {}
    bins, where = Bins(capacity), []
    for source, cluster, length in zip(ordered["source"], ordered["cluster"], ordered["length"], strict=True):
        # a missing source (None or NaN) is one source
        source_bit = 1 << bits.setdefault(("source", source if isinstance(source, str) else None), len(bits))
        cluster_bit = 1 << bits.setdefault(("cluster", int(cluster)), len(bits))
        where.append(bins.put(int(length), source_bit | cluster_bit, capacity))
    out = ordered.assign(bin=[b for b, _ in where], start=[s for _, s in where])
    return out.assign(residual=[bins.residual[b] for b, _ in where])


def pack(docs: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, length: Column | None = None, cluster: Column | None = None) -> DataFrame:
    """Packs documents into bins: a row per piece, with doc_id, source, cluster, piece, copy, length, group, bin, start, residual.

    No bin has two pieces of one source or of one duplicate cluster. A document longer than `capacity` is
    cut into full pieces and a rest; pieces are numbered from 0 and piece p starts at token p * capacity.
    Pieces are dealt by hash over groups of about `group_pieces`, and each group is packed by itself, so that the
    work of a task is bounded and what is lost to part-filled bins at the edges of groups stays small.
    (group, bin) names a bin; start is the piece's place in it, residual what is free in the end.

    Lengths are words unless `length` is given; clusters are texts equal but for case, unless `cluster`
    is given. Null texts and texts without words have one piece of length 0. A null source is a source of its own.
    Equal rows are counted first and numbered as copies; they conflict like any. An empty table gives no rows; other columns,
    whatever their names, are not read.
    """
    text = docs["text"]
    length = n_tokens(text) if length is None else length
    cluster = F.xxhash64(F.lower(F.coalesce(text, F.lit("")))) if cluster is None else cluster
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), cluster.cast("long").alias("cluster"), length.cast("long").alias("length"))
    equal = rows.groupBy("doc_id", "source", "cluster", "length").agg(F.count("*").alias("n"))
    lists = equal.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("list"))
    copies = lists.withColumn("copy", F.explode(F.sequence(F.col("list") * COPIES, F.least(F.col("n"), (F.col("list") + 1) * COPIES) - 1)))
    last = F.greatest(F.ceil(F.col("length") / capacity) - 1, F.lit(0))
    pieces = copies.select("doc_id", "source", "cluster", F.col("length").alias("whole"), "copy", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    pieces = cut(pieces.select("doc_id", "source", "cluster", F.least(F.lit(capacity).cast("long"), F.col("whole") - F.col("piece") * capacity).alias("length"), "piece", "copy"))
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "cluster", "length", "piece", "copy"), F.lit(groups)))
    dealt = dealt.select("*", F.col("doc_id").isNull().alias("nameless")).fillna({"doc_id": 0})  # pandas has no null long

    def packed(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pack_group(group, capacity)[[c.split()[0] for c in PACKED.split(", ")]]

    out = dealt.groupBy("group").applyInPandas(packed, PACKED)
    return out.withColumn("doc_id", F.when(~F.col("nameless"), F.col("doc_id"))).drop("nameless")
