"""Per-key rate rules on event time, safe for a key that holds a large part of all rows.

A window partitioned by key alone would put a hot key into one task. Every running value here is
built in two levels instead: inside (key, time cell) partitions, plus a prefix over one row per
cell. The cell width of a key follows from its own instants and the time they span, so that a cell holds
about `cell_rows` of them whatever the traffic.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adgauge.session import cut

SECOND = 1_000_000
# Instants of a key in one cell, on average over the time it spans.
CELL_ROWS = 100_000
_AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min}


def _merge(kind: str, outer: Column, inner: Column) -> Column:
    if kind == "sum":
        return F.coalesce(outer, F.lit(0)) + F.coalesce(inner, F.lit(0))
    return F.greatest(outer, inner) if kind == "max" else F.least(outer, inner)


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    cell: Column,
    values: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    forward: bool = True,
) -> DataFrame:
    """Adds running aggregates over `order` within `keys`: name -> (sum|max|min, expression).

    `cell` must not decrease with `order`. Rows equal in `order` are peers: with `inclusive` they
    see each other, without it they see strictly earlier rows only (`order` must be integral).
    With `forward=False` the direction is reversed.
    """
    direction = F.asc if forward else F.desc
    first = Window.unboundedPreceding
    inner = (
        Window.partitionBy(*keys, "_cell").orderBy(direction(order))
        .rangeBetween(first, Window.currentRow if inclusive else -1)
    )
    outer = Window.partitionBy(*keys).orderBy(direction("_cell")).rowsBetween(first, -1)
    named = df.withColumns({"_cell": cell, **{f"_v_{n}": e for n, (_, e) in values.items()}})
    inside = named.withColumns(
        {f"_in_{n}": _AGGREGATES[kind](f"_v_{n}").over(inner) for n, (kind, _) in values.items()}
    )
    cells = named.groupBy(*keys, "_cell").agg(
        *[_AGGREGATES[kind](f"_v_{n}").alias(f"_c_{n}") for n, (kind, _) in values.items()]
    )
    before = cells.select(
        *keys, "_cell",
        *[_AGGREGATES[kind](f"_c_{n}").over(outer).alias(f"_out_{n}")
          for n, (kind, _) in values.items()],
    )
    merged = {
        n: _merge(kind, F.col(f"_out_{n}"), F.col(f"_in_{n}")) for n, (kind, _) in values.items()
    }
    return inside.join(before, [*keys, "_cell"]).withColumns(merged).select(*df.columns, *merged)


def celled(pts: DataFrame, cell_seconds: float = 10.0, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Materialised points with `w`, the cell width of their key in microseconds.

    A key of m instants over a span s has cells of s * cell_rows / m, `cell_seconds` at least.
    """
    if "w" in pts.columns:
        return pts
    pts = cut(pts)
    keys = pts.groupBy("key").agg(F.count("*").alias("m"), (F.max("t") - F.min("t")).alias("span"))
    even = F.floor(F.col("span").cast("double") * cell_rows / F.col("m")) + 1
    widths = cut(keys.select("key", F.greatest(even, F.lit(int(cell_seconds * SECOND))).cast("long").alias("w")))
    return pts.join(widths, "key")


def _time_cell() -> Column:
    return F.expr("t div w")


def points(df: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, t, n): distinct instants of a key in microseconds with their number of events."""
    return (
        df.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
        .groupBy(F.col(key).alias("key"), F.unix_micros(F.col(ts)).alias("t"))
        .agg(F.count("*").alias("n"))
    )


def attach(
    df: DataFrame, values: DataFrame, key: str, ts: str, tie: str | None = None
) -> DataFrame:
    """Joins per-instant values back to the events; the instant in the key spreads a hot key.

    With `tie`, `_place` numbers the events of an instant in that order, over the same shuffle.
    """
    keyed = df.withColumns({"_k": F.col(key), "_t": F.unix_micros(F.col(ts))})
    if tie:
        same = Window.partitionBy("_k", "_t").orderBy(tie)
        keyed = keyed.withColumn("_place", F.row_number().over(same))
    right = values.withColumnsRenamed({"key": "_k", "t": "_t"})
    return keyed.join(right, ["_k", "_t"], "left").drop("_k", "_t")


def trailing_counts(
    pts: DataFrame, windows: dict[str, float], cell_seconds: float = 10.0, closed: bool = False,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(key, t, <name>...): events of the key in (t - W, t], or [t - W, t] if `closed`.

    A count is a difference of two cumulative counts, so frames never slide: each instant also
    enters as a zero-weight probe at the far end of each window.
    """
    pts = celled(pts, cell_seconds, cell_rows)
    probes = [
        pts.select(
            "key", "w",
            (F.col("t") - int(seconds * SECOND) - int(closed)).alias("t"),
            F.lit(0).cast("bigint").alias("n"),
            F.lit(name).alias("probe"),
            F.col("t").alias("origin"),
        )
        for name, seconds in windows.items()
    ]
    both = pts.select("key", "w", "t", "n", F.lit("self").alias("probe"), F.col("t").alias("origin"))
    for probe in probes:
        both = both.unionByName(probe)
    summed = running(both, ["key"], "t", _time_cell(), {"c": ("sum", F.col("n"))})

    def at(name: str) -> Column:
        return F.max(F.when(F.col("probe") == name, F.col("c")))

    return summed.groupBy("key", F.col("origin").alias("t")).agg(
        *[(at("self") - at(name)).alias(name) for name in windows]
    )


def rapid_instants(
    pts: DataFrame, gap_ms: int = 100, window_seconds: float = 60.0, cell_seconds: float = 10.0,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(key, t, rapid): some neighbours less than `gap_ms` apart, both in the strict trailing window.

    The pair whose earlier member is newest decides, so one running maximum is enough.
    """
    pts, cell = celled(pts, cell_seconds, cell_rows), _time_cell()
    linked = running(pts, ["key"], "t", cell, {"prev": ("max", F.col("t"))}, inclusive=False)
    pair_start = F.when(F.col("n") > 1, F.col("t")).when(
        F.col("t") - F.col("prev") < gap_ms * 1000, F.col("prev")
    )
    newest = running(linked, ["key"], "t", cell, {"pair": ("max", pair_start)})
    inside = F.col("pair") > F.col("t") - int(window_seconds * SECOND)
    return newest.select("key", "t", F.coalesce(inside, F.lit(False)).alias("rapid"))


def ip_rate(
    df: DataFrame, key: str = "ip", ts: str = "timestamp_utc",
    per_minute: int = 100, per_hour: int = 1000,
) -> DataFrame:
    """Adds n_minute, n_hour (current event included) and the two limit flags."""
    counts = trailing_counts(points(df, key, ts), {"n_minute": 60, "n_hour": 3600})
    return attach(df, counts, key, ts).withColumns({
        "minute_exceeded": F.col("n_minute") > per_minute,
        "hour_exceeded": F.col("n_hour") > per_hour,
    })


def rapid(df: DataFrame, key: str = "ip", ts: str = "timestamp_utc", gap_ms: int = 100) -> DataFrame:
    return attach(df, rapid_instants(points(df, key, ts), gap_ms), key, ts)


def address_rates(
    df: DataFrame, key: str = "ip", ts: str = "timestamp_utc", gap_ms: int = 100
) -> DataFrame:
    """Adds n_minute, n_hour and rapid with one join back to the events."""
    pts = celled(points(df, key, ts))
    counts = trailing_counts(pts, {"n_minute": 60, "n_hour": 3600})
    return attach(df, counts.join(rapid_instants(pts, gap_ms), ["key", "t"]), key, ts)


def fingerprint_rate(
    df: DataFrame, key: str = "fingerprint", ts: str = "timestamp_utc",
    overused: int = 1000, suspicious: int = 500,
) -> DataFrame:
    """Adds n_day and the usage class of the fingerprint over the trailing 24 hours."""
    counts = trailing_counts(points(df, key, ts), {"n_day": 86400})
    usage = F.when(F.col("n_day") > overused, "overused").when(
        F.col("n_day") > suspicious, "suspicious"
    ).otherwise("normal")
    return attach(df, counts, key, ts).withColumn("fingerprint_usage", usage)


def _changes(rows: pd.DataFrame, names: list[str]) -> np.ndarray:
    """Where a row differs from the one before in any of the named columns; the first row does."""
    new = np.zeros(len(rows), bool)
    for name in names:
        values = rows[name].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    new[:1] = True
    return new


def _whole_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (key, start, cell, t) in frames that end where a cell ends."""
    held = None
    for rows in batches:
        rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
        last = np.flatnonzero(_changes(rows, ["key", "start", "cell"]))[-1] if len(rows) else 0
        held = rows.iloc[last:]
        if last:
            yield rows.iloc[:last]
    if held is not None and len(held):
        yield held


def _hops(rows: pd.DataFrame) -> np.ndarray:
    """Of each row the place of its `next` in the same cell; its own place if that lies elsewhere."""
    head, t, place = _changes(rows, ["key", "start", "cell"]), rows["t"].to_numpy(), np.arange(len(rows))
    group, firsts = np.cumsum(head) - 1, np.flatnonzero(head)
    lasts = np.append(firsts[1:], len(rows)) - 1
    base = np.concatenate(([0], np.cumsum(t[lasts] - t[firsts] + 1)[:-1]))  # cells one after the other
    shift = (base - t[firsts])[group]
    target = np.searchsorted(t + shift, rows["next"].to_numpy() + shift)
    return np.where(rows["inside"].to_numpy(bool), np.minimum(target, len(rows) - 1), place)


def _exits(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """Of each instant that a chain can enter a cell at, the instant at which it enters a later one."""
    for rows in _whole_cells(batches):
        last = _hops(rows)
        while not np.array_equal(further := last[last], last):
            last = further
        t = rows["t"].to_numpy()
        # whoever points here from an earlier cell is less than a window before the instant that precedes it
        early = np.append(0, t[:-1]) < rows["edge"].to_numpy() + window
        entry = (_changes(rows, ["key", "start", "cell"]) | early) & rows["ahead"].to_numpy(bool)[last]
        found = pd.DataFrame({"key": rows["key"].to_numpy(), "t": t, "next": rows["next"].to_numpy()[last]})
        yield found[entry]


def _inner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The entries reached, and all instants that the chains visit from there inside the cells."""
    for rows in _whole_cells(batches):
        hops, visited = _hops(rows), rows["reached"].to_numpy(bool).copy()
        here = np.flatnonzero(visited)
        while len(here):
            here = np.unique(hops[here])
            here = here[~visited[here]]
            visited[here] = True
        yield rows.loc[visited, ["key", "t"]]


def _walk(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """All instants that the chains visit from the first of each stretch, for stretches that lie in one cell."""
    for rows in _whole_cells(batches):
        head, t, place = _changes(rows, ["key", "start", "cell"]), rows["t"].to_numpy(), np.arange(len(rows))
        group, firsts = np.cumsum(head) - 1, np.flatnonzero(head)
        ends = np.append(firsts[1:], len(rows))
        base = np.concatenate(([0], np.cumsum(t[ends - 1] - t[firsts] + window + 1)[:-1]))  # stretches over a window apart
        laid = t + (base - t[firsts])[group]
        target = np.searchsorted(laid, laid + window)
        hops = np.where(target < ends[group], target, place)
        visited, here = np.zeros(len(rows), bool), firsts
        while len(here):
            visited[here] = True
            here = hops[here]
            here = here[~visited[here]]
        yield rows.loc[visited, ["key", "t"]]


def _window_anchors(pts: DataFrame, window: int) -> DataFrame:
    """(key, t) where a fixed window starts: the first instant of a key, then each time the first
    instant at least one window after the last start.

    An instant that follows a pause of a full window always starts one, so stretches between such
    pauses are independent and one shorter than a window has no further start. In longer ones each
    instant points to the first instant a window later. A stretch that lies in one cell is followed by one task. In the
    others tasks follow the pointers inside (key, cell) groups; across cells, entry points are joined in rounds that double
    the number of cells covered.
    """
    cell, unset = _time_cell(), F.lit(None).cast("bigint")
    linked = running(pts, ["key"], "t", cell, {"prev": ("max", F.col("t"))}, inclusive=False)
    root = F.col("prev").isNull() | (F.col("t") - F.col("prev") >= window)
    grouped = cut(
        running(
            linked.withColumn("root", root), ["key"], "t", cell,
            {"start": ("max", F.when(F.col("root"), F.col("t")))},
        ).select("key", "w", "t", "start")
    )
    roots = grouped.filter(F.col("t") == F.col("start")).select("key", "t")
    spans = grouped.groupBy("key", "start").agg(F.max("t").alias("end")).filter(F.col("end") - F.col("start") >= window)
    long = cut(grouped.join(spans, ["key", "start"]).withColumn("crossed", F.expr("end div w - start div w")))
    whole = long.filter("crossed = 0").select("key", "start", F.lit(0).alias("cell"), "t")
    whole = whole.repartition("key", "start").sortWithinPartitions("key", "start", "cell", "t")
    anchors = roots.unionByName(whole.mapInPandas(lambda b: _walk(b, window), "key string, t bigint"))
    most = long.agg(F.max("crossed")).first()[0] or 0
    if not most:
        return anchors.distinct()
    busy = long.filter("crossed > 0").drop("crossed")

    here = busy.select("key", "start", "w", "t", F.col("t").alias("seen"), unset.alias("origin"))
    ahead = busy.select("key", "start", "w", (F.col("t") + window).alias("t"), unset.alias("seen"), F.col("t").alias("origin"))
    found = running(
        here.unionByName(ahead), ["key", "start"], "t", cell, {"next": ("min", F.col("seen"))}, forward=False,
    ).filter(F.col("origin").isNotNull())
    own = F.expr("origin div w")
    pointed = cut(
        found.select(
            "key", "start", own.alias("cell"), (own * F.col("w")).alias("edge"), F.col("origin").alias("t"),
            F.coalesce("next", "origin").alias("next"), F.col("next").isNotNull().alias("ahead"),
            F.coalesce(F.expr("next div w") == own, F.lit(False)).alias("inside"),
        )
    )

    def by_cell(rows: DataFrame) -> DataFrame:
        return rows.repartition("key", "start", "cell").sortWithinPartitions("key", "start", "cell", "t")

    jumps = cut(by_cell(pointed).mapInPandas(lambda b: _exits(b, window), "key string, t bigint, next bigint"))
    entered = busy.filter(F.col("t") == F.col("start")).select("key", "t")
    rounds = math.ceil(math.log2(most + 1))
    for i in range(rounds):
        reached = entered.join(jumps, ["key", "t"]).select("key", F.col("next").alias("t"))
        entered = cut(entered.unionByName(reached).distinct())
        if i + 1 < rounds:
            hop = jumps.select("key", F.col("t").alias("next"), F.col("next").alias("after"))
            jumps = cut(jumps.join(hop, ["key", "next"]).select("key", "t", F.col("after").alias("next")))
    marked = pointed.join(entered.withColumn("in", F.lit(True)), ["key", "t"], "left")
    marked = marked.withColumn("reached", F.coalesce("in", F.lit(False))).drop("in")
    return anchors.unionByName(by_cell(marked).mapInPandas(_inner, "key string, t bigint")).distinct()


def anchored_rate(
    df: DataFrame, key: str = "ip", ts: str = "timestamp_utc", tie: str = "impression_id",
    limit: int = 100, window_seconds: float = 60.0, cell_seconds: float = 10.0,
    cell_rows: int = CELL_ROWS, carried: DataFrame | None = None,
) -> DataFrame:
    """Adds window_anchor (microseconds), window_count and rate_exceeded for the fixed window anchored at the first event.

    The count restarts with the first event at least one window after the anchor. Events of one
    instant are counted in `tie` order. `carried` has windows that are open already: (key, anchor, seen), a
    row per key, none later than the key's events in `df`.
    """
    window = int(window_seconds * SECOND)
    pts = points(df, key, ts)
    if carried is not None:
        before = carried.join(pts.select("key").distinct(), "key", "left_semi")
        before = cut(before.select("key", F.col("anchor").alias("t"), F.col("seen").alias("n")))
        pts = pts.unionByName(before).groupBy("key", "t").agg(F.sum("n").alias("n"))
    pts = celled(pts, cell_seconds, cell_rows)
    anchors = _window_anchors(pts, window).withColumn("anchor", F.lit(True))
    marked = pts.join(anchors, ["key", "t"], "left")
    cell = _time_cell()
    summed = running(
        marked, ["key"], "t", cell, {"before": ("sum", F.col("n"))}, inclusive=False
    )
    based = running(
        summed, ["key"], "t", cell, {
            "base": ("max", F.when(F.col("anchor"), F.col("before"))),
            "window_anchor": ("max", F.when(F.col("anchor"), F.col("t"))),
        },
    )
    offsets = based.select("key", "t", "window_anchor", (F.col("before") - F.col("base")).alias("_offset"))
    if carried is not None:  # what was seen before precedes the events of the anchor's own instant
        offsets = offsets.join(before, ["key", "t"], "left").withColumn("_offset", F.col("_offset") + F.coalesce("n", F.lit(0))).drop("n")
    return (
        attach(df, offsets, key, ts, tie)
        .withColumn("window_count", F.when(F.col(key).isNotNull(), F.col("_offset") + F.col("_place")))
        .withColumn("rate_exceeded", F.coalesce(F.col("window_count") > limit, F.lit(False)))
        .drop("_offset", "_place")
    )


def rate_batch(
    df: DataFrame, carried: DataFrame, key: str = "ip", ts: str = "timestamp_utc", tie: str = "impression_id",
    limit: int = 100, window_seconds: float = 60.0, ttl_seconds: float = 300.0, processed: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """One micro-batch under the anchored rule: (the rows with window_count and rate_exceeded, the windows to carry on).

    `carried` is (key, anchor, seen), a row per key, as the batch before left it. An event older than its key's
    open window is counted in that window. Windows that began over `ttl_seconds`, or the window itself if that is
    longer, before the newest event are dropped. With `processed`, a column of processing times, events dated
    after their processing do not count as newest.
    """
    place = F.col(ts)
    held = carried.select(F.col("key").alias(key), "anchor")
    timed = df.join(held, key, "left").withColumn("_at", F.greatest(place, F.timestamp_micros("anchor"))).drop("anchor")
    timed = timed.withColumn("_at", F.when(place.isNotNull(), F.col("_at")))
    rated = cut(anchored_rate(timed, key, "_at", tie, limit, window_seconds, carried=carried))
    latest = rated.filter(F.col("window_anchor").isNotNull()).select(
        F.col(key).alias("key"), F.col("window_anchor").alias("anchor"), F.col("window_count").alias("seen"))
    open_now = latest.unionByName(carried).groupBy("key").agg(F.max(F.struct("anchor", "seen")).alias("last")).select("key", "last.*")
    at = F.unix_micros(ts)
    known = F.coalesce(at <= F.unix_micros(processed), F.lit(True)) if processed else F.lit(True)
    newest = rated.agg(F.max(F.when(known, at))).first()[0]
    if newest is not None:
        open_now = open_now.filter(F.col("anchor") >= newest - int(max(window_seconds, ttl_seconds) * SECOND))
    return rated.select(*df.columns, "window_count", "rate_exceeded"), open_now


def trailing_batch(
    df: DataFrame, earlier: DataFrame, key: str, ts: str, windows: dict[str, float], gap_ms: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """One micro-batch under trailing counts: (the rows with a count per window, the batch's own `points`).

    `earlier` has the points of earlier micro-batches. With `gap_ms`, `rapid` is added too. A late event is counted
    with the points known by then; counts given out before are not revised.
    """
    own = cut(points(df, key, ts))
    known = earlier.join(own.select("key").distinct(), "key", "left_semi")
    pts = celled(own.unionByName(known).groupBy("key", "t").agg(F.sum("n").alias("n")))
    values = trailing_counts(pts, windows)
    if gap_ms is not None:
        values = values.join(rapid_instants(pts, gap_ms), ["key", "t"])
    return attach(df, values, key, ts), own


def _admit(batches: Iterator[pd.DataFrame], limit: int, window: int) -> Iterator[pd.DataFrame]:
    """Sliding admission over rows sorted by (key, block, t), batch by batch.

    Holds the kept stamps of one block only, `limit` at most. While the limiter is full it refuses up to the end of
    the oldest stamp's window, which is looked up, so the work follows the admissions and not the rows.
    """
    block, kept, total = None, deque(), 0
    for rows in batches:
        t, n, taken = rows["t"].to_numpy(), rows["n"].to_numpy(), np.zeros(len(rows), np.int64)
        edges = [*np.flatnonzero(_changes(rows, ["key", "block"])), len(rows)]
        for i, end in zip(edges, edges[1:]):
            here = (rows["key"].iloc[i], rows["block"].iloc[i])
            if here != block:
                block, kept, total = here, deque(), 0
            while i < end:
                while kept and kept[0][0] < t[i] - window:
                    total -= kept.popleft()[1]
                if total < limit:
                    taken[i] = min(n[i], limit - total)
                    kept.append((t[i], taken[i]))
                    total += taken[i]
                    i += 1
                else:
                    i = i + np.searchsorted(t[i:end], kept[0][0] + window, side="right") if kept else end
        yield rows.assign(admitted=taken)[["key", "t", "n", "admitted"]]


def admitted_instants(
    pts: DataFrame, limit: int = 1000, window_seconds: float = 60.0,
    cell_seconds: float = 10.0, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(key, t, n, admitted): how many events of the instant a sliding limiter lets in.

    The limiter keeps admitted stamps not older than the window and refuses at `limit`; refused
    events leave no trace. Where the raw trailing count stays within the limit everything is let
    in, which is decided without Python. Only congested blocks run the recurrence, in one ordered
    pass that streams a block through its task: each answer depends on the one before, so a block cannot
    be split, but its task never holds more than a batch of rows and `limit` stamps.
    """
    window = int(window_seconds * SECOND)
    pts, cell = celled(pts, cell_seconds, cell_rows), _time_cell()
    raw = trailing_counts(pts, {"raw": window_seconds}, closed=True)
    full = cut(pts.join(raw, ["key", "t"]).withColumn("tight", F.col("raw") > limit))
    tight_t = F.when(F.col("tight"), F.col("t"))
    last = cut(running(full, ["key"], "t", cell, {"last": ("max", tight_t)}, inclusive=False))
    fresh = F.col("tight") & (F.col("last").isNull() | (F.col("last") < F.col("t") - window))
    opened = running(
        last, ["key"], "t", cell, {"opened": ("max", F.when(fresh, F.col("t")))}
    )
    following = running(
        opened, ["key"], "t", cell, {"following": ("min", tight_t)}, forward=False
    )
    near = F.col("following") - F.col("t") <= window
    block = F.when(
        F.col("tight") | (F.col("following") - F.col("last") <= window), F.col("opened")
    ).otherwise(F.col("following"))
    judged = cut(following.withColumn("block", F.when(near, block)).select("key", "t", "n", "block"))
    calm = judged.filter(F.col("block").isNull()).select("key", "t", "n", F.col("n").alias("admitted"))
    congested = judged.filter(F.col("block").isNotNull()).repartition("key", "block").sortWithinPartitions("key", "block", "t")
    shape = "key string, t bigint, n bigint, admitted bigint"
    return calm.unionByName(congested.mapInPandas(lambda batches: _admit(batches, limit, window), shape))


def admitted(
    df: DataFrame, key: str = "ip", ts: str = "timestamp_utc", tie: str = "impression_id",
    limit: int = 1000, window_seconds: float = 60.0,
) -> DataFrame:
    """Adds `allowed`: the sliding limiter's answer for each event, in (time, tie) order."""
    decided = admitted_instants(points(df, key, ts), limit, window_seconds)
    return (
        attach(df, decided.drop("n"), key, ts, tie)
        .withColumn("allowed", F.coalesce(F.col("_place") <= F.col("admitted"), F.lit(True)))
        .drop("_place", "admitted")
    )


def admit_batch(
    df: DataFrame, carried: DataFrame, key: str = "ip", ts: str = "timestamp_utc", tie: str = "impression_id",
    limit: int = 1000, window_seconds: float = 60.0, ttl_seconds: float = 300.0,
) -> tuple[DataFrame, DataFrame]:
    """One micro-batch under the sliding limiter: (the rows with `allowed`, the admitted stamps to carry on).

    `carried` is (key, t, n), the stamps let in that an event may still meet, as the batch before left them: at most `limit`
    per key. Stamps let in before are let in again, as refused events leave no trace, so the batch runs over both. An event
    older than its key's last stamp counts at that stamp. Stamps that lie over `ttl_seconds`, or the window if that is
    longer, before the newest event are dropped, with their key if it has no other.
    """
    window = int(window_seconds * SECOND)
    last = carried.groupBy(F.col("key").alias(key)).agg(F.max("t").alias("_last"))
    at = F.when(F.col(ts).isNotNull(), F.greatest(F.col(ts), F.timestamp_micros("_last")))
    timed = cut(df.join(last, key, "left").withColumn("_at", at).drop("_last"))
    own = points(timed, key, "_at")
    held = carried.join(own.select("key").distinct(), "key", "left_semi")
    pts = own.unionByName(held).groupBy("key", "t").agg(F.sum("n").alias("n"))
    decided = cut(admitted_instants(pts, limit, window_seconds).select("key", "t", "admitted"))
    before = held.select("key", "t", F.col("n").alias("_before"))
    fresh = decided.join(before, ["key", "t"], "left").select("key", "t", (F.col("admitted") - F.coalesce("_before", F.lit(0))).alias("admitted"))
    rows = attach(timed, fresh, key, "_at", tie)
    rows = rows.withColumn("allowed", F.coalesce(F.col("_place") <= F.col("admitted"), F.lit(True))).select(*df.columns, "allowed")
    kept = decided.filter("admitted > 0").select("key", "t", F.col("admitted").alias("n"))
    kept = kept.unionByName(carried.join(own.select("key").distinct(), "key", "left_anti"))
    newest = own.agg(F.max("t")).first()[0]
    if newest is not None:
        kept = kept.filter(F.col("t") >= newest - max(window, int(ttl_seconds * SECOND)))
    reach = kept.groupBy("key").agg(F.max("t").alias("_newest"))
    return rows, kept.join(reach, "key").filter(F.col("t") >= F.col("_newest") - window).select("key", "t", "n")


def quota(decided: DataFrame, now: Column, limit: int = 1000, window_seconds: float = 60.0) -> DataFrame:
    """Per key at `now`: requests left and seconds until the oldest kept stamp expires."""
    window = int(window_seconds * SECOND)
    instant = F.unix_micros(now)
    seen = decided.filter(F.col("t") <= instant)
    kept = (F.col("t") >= instant - window) & (F.col("admitted") > 0)
    return seen.groupBy("key").agg(
        F.greatest(
            F.lit(0), F.lit(limit) - F.coalesce(F.sum(F.when(kept, F.col("admitted"))), F.lit(0))
        ).cast("bigint").alias("remaining"),
        F.greatest(
            F.lit(0.0),
            F.coalesce((F.min(F.when(kept, F.col("t"))) + window - instant) / SECOND, F.lit(0.0)),
        ).alias("reset_seconds"),
    )
