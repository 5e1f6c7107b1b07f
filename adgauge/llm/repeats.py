"""Removal of long byte strings that occur more than once in the corpus.

The strings compared are the windows of `length` bytes of each text. A collection of whole texts cannot be sorted
column by column at scale (a round per byte of the longest text, each over all texts), so it is first parted into
small collections of short strings that hold all windows that can be equal:

1. Each window is assigned to its anchor, the least of the hashes of its short grams (the first, if equal). Equal
   windows have their anchor in the same place. Neighbouring windows of one anchor form a segment; it is split in
   two where the anchor lies in the first or second half of the window, so that all windows of a segment share a core,
   of over half a window. Equal windows have equal cores, so segments of a core that occurs once are done.
2. The segments of one core, aligned at the anchor, are a collection. Collections with more than `largest` strings are
   parted by longer cores of half their windows, again and again; at a single window the core is the window.
3. Collections are sorted column by column, from the last to the first. Each round puts one symbol before every string:
   the Burrows-Wheeler column of the round, by which the order of the strings and their common prefixes are brought
   up to date. A window whose common prefix with a neighbour reaches `length` occurs again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adgauge.session import cut

LENGTH = 400
GRAM = 16  # bytes, a power of two
LARGEST = 20_000  # strings in a collection that one task sorts
BATCH = 1 << 23  # bytes of strings that are sorted together; a collection is never split
PIECE = 1 << 19  # bytes of text hashed at once; a longer text is taken in overlapping pieces
PLACE_BITS = 24
SEGMENT = "rid long, core long, content long, start int, n int, o2 int, digest binary, doc_id long"


def text_digest(content: Column) -> Column:
    return F.unhex(F.substring(F.sha2(content, 256), 1, 32))


def gram_hashes(symbols: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the `gram` bytes from each position, by doubling."""
    h = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64)[symbols]
    width = 1
    while width < gram:
        h = (h[:-width] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[width:] + (h[:-width] >> np.uint64(29)))
        width *= 2
    h ^= h >> np.uint64(31)
    return h * np.uint64(0xD6E8FEB86659FD93)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of `width` values from each position."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def segments(symbols: np.ndarray, ends: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Segments of the windows of some texts laid end to end; `ends` are the texts' ends.

    Gives the anchor, and the windows as distances o1 to o2 of the anchor from their starts.
    """
    none = {k: np.zeros(0, np.int64) for k in ("anchor", "o1", "o2")}
    if len(symbols) < length:
        return none
    places = np.arange(len(symbols) - gram + 1, dtype=np.uint64)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    anchor = (sliding_least((gram_hashes(symbols, gram) & ~mask) | places, length - gram + 1) & mask).astype(np.int64)
    first = np.concatenate(([0], ends[:-1]))
    valid = np.arange(len(anchor)) + length <= np.repeat(ends, ends - first)[: len(anchor)]
    change = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])))
    low = np.flatnonzero(change)
    high = np.concatenate((low[1:], [len(anchor)])) - 1
    low, high = low[valid[low]], high[valid[low]]
    a = anchor[low]
    half = (length - gram + 1) // 2
    parts = []
    for o1, o2 in ((a - high, np.minimum(a - low, half - 1)), (np.maximum(a - high, half), a - low)):
        some = o1 <= o2
        parts.append((a[some], o1[some], o2[some]))
    return dict(zip(none, map(np.concatenate, zip(*parts, strict=True)), strict=True))


def bounds(o2: Column, length: int, gram: int) -> tuple[Column, Column]:
    """The distances that a segment with this o2 may have at all."""
    half = (length - gram + 1) // 2
    near = o2 < half
    return F.when(near, 0).otherwise(half), F.when(near, half - 1).otherwise(length - gram)


def _segment_rows(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_64_intdigest as xxh3

    half = (length - gram + 1) // 2
    for batch in batches:
        text = batch.column("text")
        offsets = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4).astype(np.int64)
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        raw = memoryview(data)
        rid = batch.column("rid").to_numpy()
        work: list[tuple[int, int, np.ndarray]] = []  # first and last text, and the borders of the texts between
        row, n = 0, len(text)
        while row < n:
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
            stop = min(stop, n)
            low, high = offsets[row], offsets[stop]
            if high - low > PIECE:  # a long text
                for at in range(low, max(low + 1, high - length + 1), PIECE):
                    work.append((row, stop, np.array([at, min(at + PIECE + length - 1, high)])))
            else:
                work.append((row, stop, offsets[row : stop + 1]))
            row = stop
        met: set[int] = set()
        for row, stop, borders in work:
            base = borders[0]
            found = segments(data[base : borders[-1]], borders[1:] - base, length, gram)
            if not len(found["anchor"]):
                continue
            order = np.argsort(found["anchor"], kind="stable")
            anchor, o1, o2 = (found[k][order] for k in ("anchor", "o1", "o2"))
            owner = row + np.searchsorted(borders, base + anchor, "right") - 1 if stop > row + 1 else np.full(len(anchor), row)
            begin, end = base + anchor - o2, base + anchor - o1 + length
            near = o2 < half
            g1, g2 = np.where(near, 0, half), np.where(near, half - 1, length - gram)
            core = [xxh3(raw[x:y], int(s)) for x, y, s in zip((base + anchor - g1).tolist(), (base + anchor - g2 + length).tolist(), near, strict=True)]
            content = [xxh3(raw[x:y], int(s)) for x, y, s in zip(begin.tolist(), end.tolist(), o2.tolist(), strict=True)]
            new = np.concatenate(([True], owner[1:] != owner[:-1])) & ~np.isin(owner, [*met])
            met.update(owner[new].tolist())
            named = pa.array(owner, mask=~new)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rid[owner]), pa.array(np.array(core, np.uint64).view(np.int64)), pa.array(np.array(content, np.uint64).view(np.int64)),
                    pa.array((begin - offsets[owner]).astype(np.int32)), pa.array((o2 - o1 + 1).astype(np.int32)), pa.array(o2.astype(np.int32)),
                    batch.column("digest").take(named), batch.column("doc_id").take(named),
                ],
                names=[c.split()[0] for c in SEGMENT.split(", ")],
            )


def repeated_windows(collection: np.ndarray, strings: list[bytes], o2: np.ndarray, windows: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(string, first, last): runs of windows of a string that occur again in its collection in the same place.

    The strings are laid under each other with their anchors in one column and sorted column by column. `o2` is the
    distance of the anchor from the start of a string, `windows` its number of windows.
    """
    n = len(strings)
    names, number = np.unique(collection, return_inverse=True)
    furthest = np.zeros(len(names), np.int64)
    np.maximum.at(furthest, number, o2)
    left = furthest[number] - o2
    sizes = np.array([len(s) for s in strings])
    width = int((left + sizes).max())
    laid = np.zeros((n, width), np.uint8)
    for i, (first, string) in enumerate(zip(left.tolist(), strings, strict=True)):
        laid[i, first : first + len(string)] = np.frombuffer(string, np.uint8)
    symbols = np.ascontiguousarray(laid.T)
    del laid
    order = np.argsort(number, kind="stable")
    common = np.zeros(n, np.int32)  # common prefix of each suffix with the one before it in order
    again = np.zeros((int((left + windows).max()), n), bool)
    for c in range(width - 1, -1, -1):
        inside = (left[order] <= c) & (c < (left + sizes)[order])
        bwt = np.where(inside, symbols[c, order].astype(np.int64) + 1, 0)  # beside a string, less than any byte
        key = number[order] * 257 + bwt
        new = np.zeros(n, np.int32)
        if (key[1:] < key[:-1]).any():
            by = np.argsort(key, kind="stable")
            key, inside = key[by], inside[by]
            alike = (key[1:] == key[:-1]) & inside[1:] & inside[:-1]
            pairs = np.empty(2 * np.count_nonzero(alike), np.int64)
            pairs[0::2], pairs[1::2] = by[:-1][alike] + 1, by[1:][alike] + 1
            if len(pairs):
                new[1:][alike] = np.minimum.reduceat(np.append(common, 0), pairs)[::2] + 1
            order = order[by]
        else:
            alike = (key[1:] == key[:-1]) & inside[1:] & inside[:-1]
            new[1:][alike] = common[1:][alike] + 1
        common = new
        if c < len(again):
            again[c, order] = np.maximum(common, np.append(common[1:], 0)) >= length
    place = np.arange(len(again))[:, None]
    again &= (place >= left) & (place < left + windows)
    edges = np.diff(np.pad(again, ((1, 1), (0, 0))).astype(np.int8), axis=0).T
    for (string, first), (_, last) in zip(np.argwhere(edges == 1), np.argwhere(edges == -1), strict=True):
        yield int(string), int(first - left[string]), int(last - 1 - left[string])


def _sorted_collections(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Rows come ordered by core. Collections are sorted in batches of about `BATCH` bytes."""

    def done(rows: pd.DataFrame) -> pd.DataFrame:
        found = repeated_windows(rows["core"].to_numpy(), rows["bytes"].tolist(), rows["o2"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), length)
        out = pd.DataFrame(found, columns=["string", "first", "last"], dtype="int64")
        own = rows.iloc[out["string"].to_numpy()]
        shift = own["shift"].to_numpy()
        return pd.DataFrame({"core0": own["core0"].to_numpy(), "content0": own["content0"].to_numpy(), "first": out["first"] + shift, "last": out["last"] + shift})

    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += int(batch["bytes"].str.len().sum())
        if size >= BATCH:
            rows = pd.concat(held, ignore_index=True)
            open_core = rows["core"].iloc[-1]
            closed = rows["core"] != open_core
            if closed.any():
                yield done(rows[closed])
                held = [rows[~closed]]
                size = int(held[0]["bytes"].str.len().sum())
    if held:
        yield done(pd.concat(held, ignore_index=True))


def _halves(big: DataFrame, length: int) -> DataFrame:
    """Each string of a large collection as two, of the windows with the anchor nearer and farther, with longer cores."""
    middle = F.floor((F.col("g1") + F.col("g2")) / 2).cast("int")
    parts = []
    for low, high in ((F.col("g1"), middle), (middle + 1, F.col("g2"))):
        cutting = big.select("core0", "content0", "shift", "bytes", "o1", "o2", low.alias("g1"), high.alias("g2"))
        near, far = F.greatest("o1", "g1"), F.least("o2", "g2")
        core = F.expr(f"substring(bytes, o2 - g1 + 1, {length} - g2 + g1)")
        own = F.expr(f"substring(bytes, o2 - least(o2, g2) + 1, least(o2, g2) - greatest(o1, g1) + {length})")
        parts.append(cutting.filter(near <= far).select("core0", "content0", (F.col("shift") + F.col("o2") - far).alias("shift"), own.alias("bytes"), near.alias("o1"), far.alias("o2"), "g1", "g2", F.xxhash64(core, "g1", "g2").alias("core")))
    return parts[0].unionByName(parts[1]).select("*", F.xxhash64("core", "o2", "bytes").alias("content"))


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, largest: int = LARGEST) -> DataFrame:
    """(digest, spans) of the texts with repeated strings; spans are (start, end) in bytes and may overlap.

    `texts` has doc_id, content (binary) and digest.
    """
    numbered = texts.filter(F.octet_length("content") >= length).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "digest", F.col("content").alias("text"))
    found = cut(numbered.mapInArrow(lambda batches: _segment_rows(batches, length, gram), SEGMENT))
    named = found.filter("digest IS NOT NULL").select("rid", "digest", "doc_id")
    cores = cut(found.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core"))  # a table, so that a hot core can be split
    alive = cut(found.drop("digest", "doc_id").join(cores, "core", "left_semi"))
    kinds = cut(alive.groupBy("core", "content").agg(F.count("*").alias("n_same"), F.min(F.struct("rid", "start", "n", "o2")).alias("at")))
    mixed = cut(kinds.groupBy("core").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("core"))

    # the bytes of one segment of each kind
    wanted = kinds.join(mixed, "core", "left_semi").select("core", "content", "at.*").join(named, "rid")
    per_text = wanted.groupBy("digest", "doc_id").agg(F.collect_list(F.struct("core", "content", "start", "n", "o2")).alias("list"))
    here = (texts["digest"] == per_text["digest"]) & texts["doc_id"].eqNullSafe(per_text["doc_id"])
    sliced = F.transform("list", lambda x: F.struct(x["core"].alias("core"), x["content"].alias("content"), x["n"].alias("n"), x["o2"].alias("o2"), F.substring(F.col("content"), x["start"] + 1, x["n"] - 1 + length).alias("bytes")))
    strings = texts.join(per_text, here).select(F.explode(sliced).alias("s")).select("s.*")
    g1, g2 = bounds(F.col("o2"), length, gram)
    work = strings.select(
        F.col("core").alias("core0"), F.col("content").alias("content0"), F.lit(0).alias("shift"), "bytes",
        (F.col("o2") - F.col("n") + 1).alias("o1"), "o2", g1.alias("g1"), g2.alias("g2"), "core", "content",
    )
    small, whole = [], []
    while True:
        work = cut(work)
        counts = work.groupBy("core").agg(F.count("*").alias("strings"), F.min("content").alias("least"), F.max("content").alias("most")).filter("strings > 1")
        work = work.join(cut(counts), "core")
        whole.append(work.filter("least = most"))
        small.append(work.filter(f"least < most AND strings <= {largest}"))
        big = work.filter(f"least < most AND strings > {largest}")
        if big.isEmpty():
            break
        work = _halves(big, length)
    columns = ["core0", "content0", "shift", "bytes", "o2", "core"]
    collections = reduce(DataFrame.unionByName, [d.select(*columns, (F.col("o2") - F.col("o1") + 1).alias("n")) for d in small])
    runs = collections.repartition("core").sortWithinPartitions("core").mapInPandas(lambda batches: _sorted_collections(batches, length), "core0 long, content0 long, first int, last int")
    runs = reduce(DataFrame.unionByName, [runs, *[d.select("core0", "content0", F.col("shift").alias("first"), (F.col("shift") + F.col("o2") - F.col("o1")).cast("int").alias("last")) for d in whole]])

    # segments that are alike repeat as a whole, the others where they met another kind
    alike = alive.join(kinds.filter("n_same > 1").select("core", "content"), ["core", "content"], "left_semi")
    alike = alike.select("rid", F.col("start").alias("first"), (F.col("start") + F.col("n") - 1).alias("last"))
    alone = kinds.filter("n_same = 1").select("core", "content", "at.rid", "at.start")
    met = runs.join(alone, (F.col("core0") == F.col("core")) & (F.col("content0") == F.col("content")))
    met = met.select("rid", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))
    spans = alike.unionByName(met).groupBy("rid").agg(F.collect_list(F.struct(F.col("first").cast("int").alias("start"), (F.col("last") + length).cast("int").alias("end"))).alias("spans"))
    return spans.join(named.select("rid", "digest"), "rid").groupBy("digest").agg(F.any_value("spans").alias("spans"))


def _without(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, content = batch.column("spans"), batch.column("content")
        kept, merged, sizes = [], [], []
        for raw, found in zip((x.as_py() for x in content), spans.to_pylist(), strict=True):
            runs: list[list[int]] = []
            for s in sorted((x["start"], x["end"]) for x in found or ()):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append([*s])
            edges = [0, *[e for run in runs for e in run], len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if runs else raw)
            merged.append([{"start": a, "end": b} for a, b in runs])
            sizes.append(len(raw))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(merged, schema.field("spans").type), pa.array(kept, pa.binary())], schema=schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, largest: int = LARGEST) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, spans (start, end; maximal, in order), kept (binary, the bytes left).

    A byte goes if a string of `length` bytes covers it that also starts anywhere else, in the same text or another;
    overlaps count, and texts are judged as they came. Texts are bytes of UTF-8, a string never crosses texts, null
    counts as empty. Texts shorter than `length` stay. Copies and repeated rows lose what they share, the first too.
    The result does not depend on `gram` and `largest`. Hashes of 64 bits and digests of 128 stand for equal cores,
    segments and texts. An empty table gives no rows; other columns are not read.
    """
    content = F.coalesce(docs["text"], F.lit(""))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), content.cast("binary").alias("content"), text_digest(content).alias("digest"))
    spans = cut(repeated_spans(texts, length, gram, largest))  # a table, so that a hot digest can be split
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.binary())])
    joined = texts.join(spans, "digest", "left").select("doc_id", "content", "spans")
    return joined.mapInArrow(lambda batches: _without(batches, schema), "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
