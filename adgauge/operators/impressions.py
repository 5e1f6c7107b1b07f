"""Impression summaries. One row of every campaign may be hot: all group keys here aggregate
map-side first, so a hot campaign shuffles one partial row per key and input partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid() -> Column:
    return ~F.col("is_bot")


def hour_key() -> Column:
    return F.date_format("timestamp_utc", "yyyy-MM-dd HH:00")


def impression_totals(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Total, valid, bot impressions and unique valid panelists per campaign."""
    valid_panelist = F.when(valid(), F.col("panelist_id"))
    unique = F.approx_count_distinct if approximate else F.count_distinct
    return df.groupBy("campaign_id").agg(
        F.count("*").alias("total_impressions"),
        F.count_if(valid()).alias("valid_impressions"),
        F.count_if(F.col("is_bot")).alias("bot_impressions"),
        unique(valid_panelist).alias("unique_panelists"),
    )


def counts_by(df: DataFrame, key: str | Column, name: str, valid_only: bool = True) -> DataFrame:
    """Impressions per campaign and one dimension."""
    rows = df.filter(valid()) if valid_only else df
    column = F.col(key) if isinstance(key, str) else key
    return rows.groupBy("campaign_id", column.alias(name)).agg(F.count("*").alias("impressions"))


def by_creative(df: DataFrame) -> DataFrame:
    return counts_by(df, "creative_id", "creative_id").orderBy(
        "campaign_id", F.desc("impressions"), "creative_id"
    )


def by_device(df: DataFrame) -> DataFrame:
    return counts_by(df, "device_type", "device_type")


def by_country(df: DataFrame) -> DataFrame:
    return counts_by(df, "country", "country")


def by_source(df: DataFrame) -> DataFrame:
    """All impressions, bots too."""
    return counts_by(df, "ingest_source", "ingest_source", valid_only=False)


def by_hour(df: DataFrame) -> DataFrame:
    return counts_by(df, hour_key(), "hour").orderBy("campaign_id", "hour")


SECTIONS = {
    "creative": "creative_id", "device": "device_type", "country": "country",
    "source": "ingest_source", "hour": "hour",
}


def breakdowns(df: DataFrame, sections: dict[str, str] = SECTIONS) -> DataFrame:
    """(campaign, section, key, n) for every dimension from one pass over the impressions.

    The raw rows shrink to one cube by all dimensions first; only cube rows are fanned out.
    """
    dims = list(sections.values())
    cube = (
        df.withColumn("hour", hour_key())
        .groupBy("campaign_id", "is_bot", *dims)
        .agg(F.count("*").alias("n"))
    )
    entries = F.array(*[
        F.struct(F.lit(name).alias("section"),
                 F.coalesce(F.col(dim), F.lit("Unknown")).alias("key"))
        for name, dim in sections.items()
    ])
    fanned = cube.select("campaign_id", "is_bot", "n", F.explode(entries).alias("e"))
    counted = fanned.filter(valid() | (F.col("e.section") == "source"))
    return counted.groupBy("campaign_id", "e.section", "e.key").agg(F.sum("n").alias("n"))


def all_summaries(df: DataFrame, with_hours: bool = False) -> DataFrame:
    """One summary document per campaign; list and map sizes follow the dimensions, not the rows."""
    sections = {k: v for k, v in SECTIONS.items() if with_hours or k != "hour"}
    entry = F.struct("key", F.col("n").alias("value"))

    def collected(section: str) -> Column:
        return F.collect_list(F.when(F.col("section") == section, entry))

    parts = breakdowns(df, sections).groupBy("campaign_id").agg(
        *[collected(name).alias(name) for name in sections]
    )
    by_count = F.transform(
        F.sort_array(F.transform(
            "creative", lambda e: F.struct((-e["value"]).alias("m"), e["key"].alias("k"))
        )),
        lambda e: F.struct(e["k"].alias("creative_id"), (-e["m"]).alias("count")),
    )
    maps = {
        f"by_{name}": F.map_from_entries(F.sort_array(F.col(name)))
        for name in sections if name != "creative"
    }
    shaped = parts.select(
        "campaign_id", by_count.alias("by_creative"), *[c.alias(n) for n, c in maps.items()]
    )
    # A bot-only campaign still has its source section, so both sides hold every campaign.
    return impression_totals(df).join(shaped, "campaign_id", "left")


def campaign_summary(df: DataFrame, campaign_id: str) -> DataFrame:
    """The summary document of one campaign, with its hour map."""
    return all_summaries(df.filter(F.col("campaign_id") == campaign_id), with_hours=True)


def panelist_exposure(df: DataFrame, min_impressions: int = 1) -> DataFrame:
    """(campaign, panelist, impression_count) of panelists with enough valid impressions."""
    if min_impressions < 1:
        raise ValueError("min_impressions must be at least 1")
    return (
        df.filter(valid() & F.col("panelist_id").isNotNull())
        .groupBy("campaign_id", "panelist_id")
        .agg(F.count("*").alias("impression_count"))
        .filter(F.col("impression_count") >= min_impressions)
    )


def exposed_panelists(df: DataFrame, campaign_id: str, min_impressions: int = 1) -> DataFrame:
    """Exposed panelists of one campaign, most exposed first."""
    rows = df.filter(F.col("campaign_id") == campaign_id)
    return panelist_exposure(rows, min_impressions).orderBy(
        F.desc("impression_count"), "panelist_id"
    )


def exposed_total(df: DataFrame, min_impressions: int = 1) -> DataFrame:
    """Number of exposed panelists per campaign."""
    return panelist_exposure(df, min_impressions).groupBy("campaign_id").agg(
        F.count("*").alias("total_exposed_panelists")
    )


def global_totals(df: DataFrame) -> DataFrame:
    """Totals over all campaigns; panelists both as the sum of campaign reach and as true reach.

    One shuffle by (campaign, panelist) feeds both figures.
    """
    pairs = df.groupBy("campaign_id", "panelist_id").agg(
        F.count("*").alias("total"), F.count_if(valid()).alias("valid")
    )
    reached = F.col("valid") > 0
    return pairs.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total_impressions"),
        F.coalesce(F.sum("valid"), F.lit(0)).alias("valid_impressions"),
        F.coalesce(F.sum(F.col("total") - F.col("valid")), F.lit(0)).alias("bot_impressions"),
        F.count_distinct("campaign_id").alias("campaigns"),
        F.count_if(reached & F.col("panelist_id").isNotNull()).alias("sum_unique_panelists"),
        F.count_distinct(F.when(reached, F.col("panelist_id"))).alias("distinct_panelists"),
    )


def global_breakdowns(df: DataFrame) -> DataFrame:
    """Device (valid) and source (all) totals over all campaigns."""
    sections = {"device": "device_type", "source": "ingest_source"}
    return breakdowns(df, sections).groupBy("section", "key").agg(F.sum("n").alias("impressions"))


def top_creative(df: DataFrame) -> DataFrame:
    """The most shown creative of each campaign, ties to the smaller id."""
    counts = counts_by(df, "creative_id", "creative_id")
    best = F.min(F.struct((-F.col("impressions")).alias("m"), "creative_id"))
    return counts.groupBy("campaign_id").agg(best.alias("b")).select(
        "campaign_id", F.col("b.creative_id").alias("creative_id"),
        (-F.col("b.m")).alias("impressions"),
    )


def status_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count("*").alias("n"))


def activity(df: DataFrame) -> DataFrame:
    """Total, active and completed rows of any document set with a status."""
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "Active").alias("active"),
        F.count_if(F.col("status") == "Completed").alias("completed"),
    )


def panelist_stats(df: DataFrame) -> DataFrame:
    """Total, consented, countries and average points rounded half up (missing = 0)."""
    points = F.avg(F.coalesce(F.col("points_balance"), F.lit(0)))
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("consent_given")).alias("consented"),
        F.count_distinct(F.when(F.col("country") != "", F.col("country"))).alias("countries"),
        F.coalesce(F.floor(points + 0.5), F.lit(0)).cast("bigint").alias("average_points"),
    )


def panelist_profile(df: DataFrame) -> DataFrame:
    """Panelists by gender, by age range and by country, in one grouping-sets pass."""
    dims = {"gender": "gender", "age_range": "age_range", "country": "country"}
    names = list(dims)
    grouped = df.groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names]).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("panelists")
    )
    # grouping_id has a 0 bit for the one dimension that is present.
    chosen = {3: "gender", 5: "age_range", 6: "country"}
    dimension = F.coalesce(*[F.when(F.col("gid") == g, F.lit(n)) for g, n in chosen.items()])
    value = F.coalesce(*[F.when(F.col("gid") == g, F.col(n)) for g, n in chosen.items()])
    return grouped.select(dimension.alias("dimension"), value.alias("value"), "panelists")


def response_counts(df: DataFrame) -> DataFrame:
    """Responses by survey and cohort (null cohort = none)."""
    return df.groupBy("survey_id", "cohort_type").agg(F.count("*").alias("responses"))


def session_summary(log: DataFrame) -> DataFrame:
    """Tracker log: calls by kind, errors, mean latency of the successes."""
    ok = F.col("success")
    return log.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("kind") == "pixel").alias("pixel"),
        F.count_if(F.col("kind") == "s2s").alias("s2s"),
        F.count_if(~ok).alias("errors"),
        F.avg(F.when(ok, F.col("latency_ms"))).alias("average_latency_ms"),
    )


def ops_counts(df: DataFrame, window: str = "1 hour", ts: str = "timestamp_utc") -> DataFrame:
    """Events per window, campaign and source; the same code runs on a stream."""
    return df.groupBy(
        F.window(ts, window).alias("w"), "campaign_id", "ingest_source"
    ).agg(F.count("*").alias("events"), F.count_if(F.col("is_bot")).alias("bots")).select(
        F.col("w.start").alias("window_start"), "campaign_id", "ingest_source", "events", "bots"
    )


def kpi_progress(summary: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Share of the impression and reach targets in %, one decimal, 0 without a target."""

    def share(part: str, target: str) -> Column:
        goal = F.col(f"kpis.{target}")
        done = F.coalesce(F.col(part), F.lit(0))
        return F.when(goal > 0, F.round(done / goal * 100, 1)).otherwise(F.lit(0.0))

    return campaigns.join(summary, "campaign_id", "left").select(
        "campaign_id",
        share("valid_impressions", "target_impressions").alias("impression_progress_pct"),
        share("unique_panelists", "target_reach").alias("reach_progress_pct"),
    )


def campaign_actuals(df: DataFrame, results: DataFrame) -> DataFrame:
    """(campaign, impressions, reach, average_lift) to be written back to the campaigns."""
    lift = results.groupBy("campaign_id").agg(F.avg("lift_relative_pct").alias("average_lift"))
    return impression_totals(df).select(
        "campaign_id",
        F.col("valid_impressions").alias("impressions"),
        F.col("unique_panelists").alias("reach"),
    ).join(lift, "campaign_id", "left")
