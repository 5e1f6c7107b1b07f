"""Mixing sources to target weights: raked cell weights, then sampling by calibrated probabilities."""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adgauge.session import cut

OTHER = "other"
ROUNDS = 1000
TOLERANCE = 1e-10
PLACES = 1 << 53

#: Target shares of the tokens. A level that is not named counts as `other`; a margin without any
#: names has a target for every level in the table, from the tokens of the levels (`tempered`).
TARGETS: dict[str, dict[str, float]] = {
    "source": {},
    "lang": {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.1, OTHER: 0.01},
    "topic": {"notice": 0.03, "listing": 0.07, "short prose": 0.35, "long prose": 0.549, OTHER: 0.001},
}
TEMPER = 0.7  # power of a level's tokens that its share is in proportion to
MISS = 0.002  # a margin off by more is reported
SHARE = 0.5  # of all tokens
DRIVER_CELLS = 50_000  # combinations of levels that the driver rakes itself


def n_tokens(text: Column) -> Column:
    """Words of a text: runs of characters other than space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """A stand-in for a topic, as the tables have none: the kind of text, from the whole of it."""
    whole = F.coalesce(text, F.lit(""))
    low = F.lower(whole)
    notice = low.contains("license") | low.contains("licence") | low.contains("copyright")
    marks = F.regexp_count(whole, F.lit("[|#*$%&<>]"))
    return (
        F.when(notice, "notice").when(marks * 20 > tokens, "listing")
        .when(tokens < 20, OTHER).when(tokens < 400, "short prose").otherwise("long prose")
    )


def rake(
    cells: Mapping[tuple[str, ...], float], targets: Mapping[str, Mapping[str, float]], share: float = 0.0,
    rounds: int = ROUNDS, tolerance: float = TOLERANCE,
) -> dict[tuple[str, ...], float]:
    """Weights of the cells (shares of 1) whose margins are the targets, by proportional fitting.

    Each step scales the cells of a level to its target, and each round ends by lowering the cells whose weight
    is more than they hold, if `share` of all tokens is to be given out; the next round makes up for it
    elsewhere. Levels without tokens are left out and the other targets of that margin scaled up. Ends when no
    margin is off by more than `tolerance`; where the cells allow no fit, after `rounds`, with what they hold.
    """
    places = [{x: i for i, x in enumerate(t)} for t in targets.values()]
    at = [np.array([place[levels[axis]] for levels in cells], np.int64) for axis, place in enumerate(places)]
    start = np.array([*cells.values()], float)
    if start.sum() <= 0:
        return {levels: 0.0 for levels in cells}
    weight = held = start / start.sum()
    most = held / share if share else np.inf
    goals = []
    for axis, wanted in enumerate(targets.values()):
        there = np.bincount(at[axis], start, len(wanted)) > 0
        goal = np.where(there, [*wanted.values()], 0.0)
        if goal.sum() <= 0:
            raise ValueError(f"no level of {[*targets][axis]} with tokens has a target")
        goals.append(goal / goal.sum())
    for _ in range(rounds):
        off = 0.0
        for own, goal in zip(at, goals, strict=True):
            margin = np.bincount(own, weight, len(goal))
            off = max(off, np.abs(margin - goal).max())
            weight = weight * np.divide(goal, margin, out=np.zeros_like(goal), where=margin > 0)[own]
        weight = np.minimum(weight, most)
        if off <= tolerance:
            break
    return dict(zip(cells, weight.tolist(), strict=True))


def tempered(tokens: Mapping[str, float], share: float = 0.0, power: float = TEMPER) -> dict[str, float]:
    """Shares in proportion to a power of each level's tokens; no level beyond what it holds if `share` of all is given out."""
    total = sum(tokens.values())
    if total <= 0:
        return {k: 1 / len(tokens) for k in tokens}
    wanted = {k: (v / total) ** power if v > 0 else 0.0 for k, v in tokens.items()}
    most = {k: v / total / share if share else 1.0 for k, v in tokens.items()}
    full: dict[str, float] = {}
    while True:
        rest = {k: v for k, v in wanted.items() if k not in full}
        scale = (1 - sum(full.values())) / sum(rest.values()) if sum(rest.values()) > 0 else 0.0
        over = {k: most[k] for k, v in rest.items() if v > 0 and v * scale > most[k]}
        if not over:
            return {k: full.get(k, wanted[k] * scale) for k in tokens}
        full |= over


def misses(cells: Mapping[tuple[str, ...], float], weights: Mapping[tuple[str, ...], float], targets: Mapping[str, Mapping[str, float]]) -> dict[tuple[str, str], float]:
    """How far each (margin, level) with tokens is from its target, as a share of all that is given out."""
    out = {}
    for axis, (margin, wanted) in enumerate(targets.items()):
        held, got = dict.fromkeys(wanted, 0.0), dict.fromkeys(wanted, 0.0)
        for levels, n in cells.items():
            held[levels[axis]] += n
            got[levels[axis]] += weights[levels]
        there = sum(v for k, v in wanted.items() if held[k] > 0)
        out |= {(margin, k): got[k] - v / there for k, v in wanted.items() if held[k] > 0}
    return out


def probabilities(cells: Mapping[tuple[str, ...], float], weights: Mapping[tuple[str, ...], float], share: float) -> dict[tuple[str, ...], float]:
    """Chance of a document of each cell, so that `share` of all tokens is expected, in proportion to the weights."""
    total = sum(cells.values()) * share
    return {k: min(1.0, w * total / cells[k]) if cells[k] else 0.0 for k, w in weights.items()}


def _tempered_table(held: DataFrame, total: float, share: float) -> DataFrame:
    """`tempered` over a table (level, n): (level, goal)."""
    part = F.col("n") / total
    levels = held.select("level", F.when(F.col("n") > 0, F.pow(part, TEMPER)).otherwise(0.0).alias("wanted"), (part / share if share else F.lit(1.0)).alias("most"), F.lit(False).alias("full"))
    while True:
        fixed, rest = levels.agg(F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)), F.sum(F.when(~F.col("full"), F.col("wanted")).otherwise(0.0))).first()
        scale = (1 - fixed) / rest if rest else 0.0
        over = ~F.col("full") & (F.col("wanted") > 0) & (F.col("wanted") * scale > F.col("most"))
        if levels.filter(over).isEmpty():
            return levels.select("level", F.when(F.col("full"), F.col("most")).otherwise(F.col("wanted") * scale).alias("goal"))
        levels = cut(levels.withColumn("full", F.col("full") | over))


def rake_table(
    cells: DataFrame, targets: Mapping[str, Mapping[str, float]], share: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE,
) -> DataFrame:
    """`rake`, `probabilities` and `misses` over a table of cells (mix_<margin>..., n), in Spark: adds probability and margin_off.

    A step adds up the weights by level and scales the cells by a join with the levels; a round is written, so that its
    plan does not grow. Nothing but totals comes to the driver.
    """
    total = float(cells.agg(F.sum("n")).first()[0] or 0)
    if total <= 0:
        return cells.withColumns({"probability": F.lit(0.0), "margin_off": F.lit(0.0)})
    goals = {}
    for margin, wanted in targets.items():
        held = cut(cells.groupBy(F.col(f"mix_{margin}").alias("level")).agg(F.sum("n").cast("double").alias("n")))
        if wanted:
            named = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in ({OTHER: 0.0} | dict(wanted)).items()], "level string, goal double")
            goal = held.filter("n > 0").join(named, "level", "left").select("level", F.coalesce("goal", F.lit(0.0)).alias("goal"))
        else:
            goal = _tempered_table(held, total, share).join(held.filter("n > 0"), "level").select("level", "goal")
        whole = goal.agg(F.sum("goal")).first()[0] or 0.0
        if whole <= 0:
            raise ValueError(f"no level of {margin} with tokens has a target")
        goals[margin] = cut(goal.select("level", (F.col("goal") / whole).alias("goal")))
    most = F.col("n") / (total * share) if share else F.lit(float("inf"))
    weighed = cells.withColumn("w", F.col("n") / total)

    def levels_of(margin: str) -> DataFrame:
        sums = weighed.groupBy(F.col(f"mix_{margin}").alias("level")).agg(F.sum("w").alias("sum"))
        return sums.join(goals[margin], "level")

    for _ in range(rounds):
        off = 0.0
        for margin in targets:
            scaled = cut(levels_of(margin).select(F.col("level").alias(f"mix_{margin}"), F.when(F.col("sum") > 0, F.col("goal") / F.col("sum")).otherwise(0.0).alias("f"), F.abs(F.col("sum") - F.col("goal")).alias("off")))
            off = max(off, scaled.agg(F.max("off")).first()[0])
            weighed = weighed.join(scaled.drop("off"), f"mix_{margin}", "left").withColumn("w", F.col("w") * F.coalesce("f", F.lit(0.0))).drop("f")
        weighed = cut(weighed.withColumn("w", F.least("w", most)))
        if off <= tolerance:
            break
    found = weighed.withColumn("probability", F.when(F.col("n") > 0, F.least(F.lit(1.0), F.col("w") * total * share / F.col("n"))).otherwise(0.0)).withColumn("margin_off", F.lit(0.0))
    missed = []
    for margin in targets:
        ends = cut(levels_of(margin).select(F.col("level").alias(f"mix_{margin}"), (F.col("sum") - F.col("goal")).alias("off")))
        missed += [(margin, *r) for r in ends.filter(F.abs("off") > MISS).orderBy(F.desc(F.abs("off"))).limit(20).collect()]
        found = found.join(ends, f"mix_{margin}", "left").withColumn("margin_off", F.greatest("margin_off", F.abs(F.coalesce("off", F.lit(0.0))))).drop("off")
    if missed:
        warnings.warn("margins missed by more than " + f"{MISS}: " + ", ".join(f"{m} {x} by {d:+.4f}" for m, x, d in missed), stacklevel=3)
    return cut(found.drop("w"))


def chance(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(PLACES))).cast("double")


def mix(
    docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, share: float = SHARE, driver_cells: int = DRIVER_CELLS,
) -> DataFrame:
    """Adds mix_source, mix_lang, mix_topic, tokens, probability, margin_off and sampled to each row.

    The tokens of each cell (source, language, topic, with levels that have no target as `other`) are added up
    by Spark and joined back with their probabilities. Up to `driver_cells` cells, a row per combination of levels, are raked
    on the driver, more of them in Spark (`rake_table`), with the same answer. A margin without named targets has one for every level, `tempered` from the levels' tokens. margin_off is how far the
    row's worst margin ends from its target; margins off by more than `MISS` are named in a warning. A row is sampled if the number in [0, 1) that its doc_id and text hash to is below its
    cell's probability, so rows that repeat are taken or left together. Null levels are `other`, null
    texts have no tokens. An empty table gives no rows. Columns of the new names are replaced.
    """
    targets = targets or TARGETS
    new = ("mix_source", "mix_lang", "mix_topic", "tokens", "probability", "margin_off", "sampled")
    rest = [c for c in docs.columns if c not in new]
    text, tokens = docs["text"], n_tokens(docs["text"])

    def level(value: Column, margin: str) -> Column:
        return F.when(value.isin([*targets[margin]]), value).otherwise(OTHER) if targets[margin] else F.coalesce(value, F.lit(OTHER))

    marked = docs.select(*[docs[c] for c in rest], docs["source"].alias("#source"), docs["lang"].alias("#lang"), text.alias("#text"), tokens.alias("tokens"), F.xxhash64(docs["doc_id"], text).alias("#place"))
    marked = marked.withColumn("#topic", topic_of(F.col("`#text`"), F.col("tokens"))).drop("#text")
    marked = marked.select(*[f"`{c}`" for c in rest], level(F.col("`#source`"), "source").alias("mix_source"), level(F.col("`#lang`"), "lang").alias("mix_lang"), level(F.col("`#topic`"), "topic").alias("mix_topic"), "tokens", "`#place`")
    cell = ["mix_source", "mix_lang", "mix_topic"]
    counted = cut(marked.groupBy(*cell).agg(F.sum("tokens").alias("n")))
    if counted.count() > driver_cells:
        found = rake_table(counted, targets, share).drop("n")
        return _sampled(marked, found, rest, cell)
    cells = {tuple(r[:3]): float(r["n"]) for r in counted.collect()}
    whole: dict[str, dict[str, float]] = {}
    for axis, (margin, wanted) in enumerate(targets.items()):
        whole[margin] = dict(wanted) if OTHER in wanted else {**wanted, OTHER: 0.0}
        if not wanted:
            held: dict[str, float] = {}
            for levels, n in cells.items():
                held[levels[axis]] = held.get(levels[axis], 0.0) + n
            whole[margin] = tempered(held, share)
    weights = rake(cells, whole, share)
    rates = probabilities(cells, weights, share)
    off = misses(cells, weights, whole) if sum(cells.values()) > 0 else {}
    missed = {k: v for k, v in off.items() if abs(v) > MISS}
    if missed:
        worst = sorted(missed, key=lambda k: -abs(missed[k]))
        warnings.warn(f"{len(missed)} of {len(off)} margins missed by more than {MISS}: " + ", ".join(f"{m} {x} by {missed[m, x]:+.4f}" for m, x in worst[:20]), stacklevel=2)
    far = {k: max(abs(off.get(place, 0.0)) for place in zip(targets, k, strict=True)) for k in cells}
    spark = docs.sparkSession
    shape = "mix_source string, mix_lang string, mix_topic string, probability double, margin_off double"
    # a table, so that Spark knows its size and need not shuffle the documents while it is small
    found = cut(spark.createDataFrame([(*k, p, far[k]) for k, p in rates.items()], shape))
    return _sampled(marked, found, rest, cell)


def _sampled(marked: DataFrame, found: DataFrame, rest: list[str], cell: list[str]) -> DataFrame:
    joined = marked.join(found, cell)
    return joined.select(*[f"`{c}`" for c in rest], *cell, "tokens", "probability", "margin_off", (chance(F.col("`#place`")) < F.col("probability")).alias("sampled"))


def sample_mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, share: float = SHARE) -> DataFrame:
    """The sampled rows of `docs`, with their own columns."""
    source = docs.select(F.struct("*").alias("row"), "doc_id", "text", "lang", "source")
    return mix(source, targets, share).filter("sampled").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
