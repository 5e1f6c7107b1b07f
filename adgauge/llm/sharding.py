"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adgauge.llm.common import n_bytes
from adgauge.session import cut

CIRCLE = 1 << 32
BUCKET = 1 << 20  # the ring is looked up by equal stretches of this length
COPIES = 1024  # equal rows are counted, then written out in lists of at most this many


def _spot(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(CIRCLE))


def ring(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """The arcs of the ring: arc (0 to shards * vnodes - 1, clockwise), its last position, its shard.

    A row per virtual node; its number is a parameter, so one task orders them.
    """
    nodes = spark.range(shards * vnodes).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("replica"))
    nodes = nodes.select(_spot(F.lit("node"), F.col("shard"), F.col("replica")).alias("last"), "shard", "replica")
    clockwise = Window.orderBy("last", "shard", "replica")
    return nodes.select((F.row_number().over(clockwise) - 1).alias("arc"), "last", "shard", F.lag("last", 1, -1).over(clockwise).alias("before"))


def _lookup(arcs: DataFrame) -> DataFrame:
    """The arcs by stretches of the ring: (bucket, before, last, arc); the end of the circle belongs to arc 0."""
    end = arcs.agg(F.max("last").alias("before")).select(F.lit(0).alias("arc"), F.lit(CIRCLE - 1).alias("last"), "before")
    both = arcs.select("arc", "last", "before").unionByName(end).filter("before < last")
    first, last = F.floor((F.col("before") + 1) / BUCKET), F.floor(F.col("last") / BUCKET)
    return both.select(F.explode(F.sequence(first, last)).alias("bucket"), "before", "last", "arc")


def _fill(arcs: DataFrame, totals: DataFrame, shards: int, slack: float) -> DataFrame:
    """What each shard takes of each arc: (arc, shard, first, end, base), ranks first to end - 1 of the arc.

    Keys arrive in ring order. Those of an arc go to the arc's own shard until it is full, then on
    clockwise to the next shard with room. One row per arc is all this looks at, so it is one fold.
    """
    counted = arcs.join(totals, "arc", "left").select("arc", "shard", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    one = counted.agg(F.sort_array(F.collect_list(F.struct("arc", "shard", "n"))).alias("nodes"), F.sum("n").alias("all"))
    even = F.floor(F.col("all") / shards)
    if slack:
        room = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.ceil(F.col("all") * (1 + slack) / shards))
    else:
        room = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: even + F.when(s < F.col("all") % shards, 1).otherwise(0))
    taken = "array<struct<arc:int,shard:int,first:bigint,end:bigint,base:bigint>>"
    one = one.withColumn("room", room)
    owners = F.col("nodes.shard")

    def arc_in(state: Column, arc: Column) -> Column:
        walk = F.array_distinct(F.concat(F.slice(owners, arc["arc"] + 1, F.size("nodes")), F.slice(owners, 1, arc["arc"])))

        def shard_in(inner: Column, shard: Column) -> Column:
            load = F.get(inner["load"], shard)
            take = F.least(arc["n"] - inner["done"], F.get(F.col("room"), shard) - load)
            part = F.struct(arc["arc"].cast("int").alias("arc"), shard.alias("shard"), inner["done"].alias("first"), (inner["done"] + take).alias("end"), load.alias("base"))
            return F.struct(
                F.transform(inner["load"], lambda x, i: F.when(i == shard, x + take).otherwise(x)).alias("load"),
                F.when(take > 0, F.concat(inner["out"], F.array(part))).otherwise(inner["out"]).alias("out"),
                (inner["done"] + take).alias("done"),
            )

        start = F.struct(state["load"].alias("load"), state["out"].alias("out"), F.lit(0).cast("long").alias("done"))
        after = F.aggregate(walk, start, shard_in)
        return F.struct(after["load"].alias("load"), after["out"].alias("out"))

    empty = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.from_json(F.lit("[]"), taken).alias("out"))
    return one.select(F.explode(F.aggregate(F.filter("nodes", lambda a: a["n"] > 0), empty, arc_in)["out"]).alias("part")).select("part.*")


def place(docs: DataFrame, shards: int, vnodes: int = 64, cells: int = 64, slack: float = 0.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Puts every row into a shard: (key, size, text_crc32, shard, slot), slots gapless from 0 in each shard.

    A key hashes to a place on the ring and belongs to the next virtual node clockwise; keys that
    overflow a full shard continue clockwise. With no slack a shard's load is the mean number of rows,
    rounded up or down, so loads differ by one at most; with slack s it is at most (1 + s) times the mean,
    and fewer rows move when a shard is added. Within an arc, rows are ranked by cell (of the text's
    checksum), place, key, size and checksum: `cells` parts of every arc are ordered apart, and their
    counts added up, so an arc never meets in one task.

    size is the text's UTF-8 bytes plus 1, null counting as none. Rows that repeat, null keys and null
    texts are placed like others. Equal rows are counted first and written out at the end. An empty table
    gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    content = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[key].alias("key"), (n_bytes(docs[text]) + 1).alias("size"), F.crc32(content).alias("crc"))
    arcs = ring(spark, shards, vnodes)
    equal = rows.groupBy("key", "size", "crc").agg(F.count("*").alias("n"))
    spot = equal.withColumns({"spot": _spot(F.lit("key"), F.col("key")), "cell": F.pmod("crc", F.lit(cells))})
    near = F.broadcast(_lookup(arcs))  # a row per virtual node and stretch: both are parameters
    at = (F.floor(spot["spot"] / BUCKET) == near["bucket"]) & (spot["spot"] > near["before"]) & (spot["spot"] <= near["last"])
    placed = cut(spot.join(near, at).drop("bucket", "before", "last"))
    in_cells = placed.groupBy("arc", "cell").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = in_cells.select("arc", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cell_base"))
    parts = _fill(arcs, in_cells.groupBy("arc").agg(F.sum("n").alias("n")), shards, slack)
    within = Window.partitionBy("arc", "cell").orderBy("spot", "key", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("rank", F.coalesce(F.sum("n").over(within), F.lit(0)))
    ranked = ranked.join(F.broadcast(bases), ["arc", "cell"])  # at most shards * vnodes * cells rows
    first = F.col("rank") + F.col("cell_base")
    lists = ranked.select("arc", "key", "size", "crc", first.alias("from"), "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("list"))
    each = lists.select("arc", "key", "size", "crc", F.explode(F.sequence(F.col("from") + F.col("list") * COPIES, F.col("from") + F.least(F.col("n"), (F.col("list") + 1) * COPIES) - 1)).alias("rank"))
    parts = F.broadcast(parts.withColumnRenamed("arc", "of"))  # at most a row per arc and shard
    fits = (each["arc"] == parts["of"]) & (each["rank"] >= parts["first"]) & (each["rank"] < parts["end"])
    return each.join(parts, fits).select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("base") + F.col("rank") - F.col("first")).alias("slot"))
