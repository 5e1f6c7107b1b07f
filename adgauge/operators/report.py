"""Report feeds over the lift table and the exposure mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def star(fact: DataFrame, campaigns: DataFrame, dates: DataFrame, ts: str) -> DataFrame:
    """Facts with campaign and calendar attributes. Spark broadcasts a dimension when its
    measured size allows and sort-merges it otherwise."""
    c = campaigns.select("campaign_id", "campaign_name", "industry", F.col("status").alias("campaign_status"))
    d = dates.select(F.col("date").alias("_date"), "year", "quarter", "month", "week", "day_of_week")
    return (
        fact.withColumn("_date", F.to_date(ts)).join(c, "campaign_id", "left")
        .join(d, "_date", "left").withColumnRenamed("_date", "calendar_date")
    )


def report_scope(
    results: DataFrame, campaigns: DataFrame, today: Column, days: int = 90, min_sample: int = 0,
    statuses: tuple[str, ...] = ("Active", "Completed"),
) -> DataFrame:
    """The default report filters: recent runs, campaign status, enough sample in both arms."""
    kept = campaigns.filter(F.col("status").isin(*statuses)).select("campaign_id")
    recent = F.to_date("run_ts").between(F.date_sub(today, days), today)
    enough = F.least("cohort_size_exposed", "cohort_size_control") >= min_sample
    return results.filter(recent & enough).join(kept, "campaign_id", "left_semi")


def scope_rows(df: DataFrame, role: str, principal: str, users: DataFrame | None = None) -> DataFrame:
    """Rows a principal may see: a client its own, an agency those of its agency id, admin all."""
    if role == "admin":
        return df
    if role == "client":
        return df.filter(F.col("client_id") == principal)
    if role == "agency":
        mine = users.filter(F.col("email") == principal).select("agency_id")
        return df.join(mine, "agency_id", "left_semi")
    raise ValueError(f"unknown role: {role}")


def retention_split(
    df: DataFrame, today: Column, date: str = "exposure_date", fresh_days: int = 90,
    archive_days: int = 730,
) -> DataFrame:
    """Adds `tier`: refresh (rolling window), archive, or expired."""
    age = F.datediff(today, F.col(date))
    return df.withColumn(
        "tier",
        F.when(age <= fresh_days, "refresh").when(age <= archive_days, "archive").otherwise("expired"),
    )


def refresh_window(df: DataFrame, today: Column, path: str, date: str = "exposure_date", days: int = 90) -> None:
    """Rewrites only the partitions of the rolling window."""
    fresh = df.filter(F.datediff(today, F.col(date)) <= days)
    (
        fresh.hint("rebalance", date).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(date).parquet(path)
    )


def bi_measures(results: DataFrame, exposures: DataFrame) -> DataFrame:
    """The report's headline measures in one row."""
    size = F.col("cohort_size_exposed")
    lift = results.agg(
        F.count_distinct("campaign_id").alias("campaigns"),
        F.avg("lift_relative_pct").alias("average_lift_pct"),
        F.count_if("is_significant").alias("significant_lifts"),
        F.coalesce(F.try_divide(F.count_if("is_significant"), F.count("*")), F.lit(0.0))
        .alias("significance_rate"),
        F.coalesce(
            F.try_divide(F.sum(F.col("lift_relative_pct") * size), F.sum(size)), F.lit(0.0)
        ).alias("weighted_average_lift"),
        F.avg(F.col("confidence_interval_upper") - F.col("confidence_interval_lower"))
        .alias("ci_width"),
    )
    return lift.select(
        "*",
        exposures.agg(F.count("*")).scalar().alias("total_impressions"),
        exposures.agg(F.count_distinct("panelist_id")).scalar().alias("unique_panelists"),
    )


def metric_lift(results: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Average lift restricted to each metric, as columns."""
    return results.agg(*[
        F.avg(F.when(F.col("metric_name") == m, F.col("lift_relative_pct"))).alias(f"{m}_lift")
        for m in metrics
    ])


def lift_results_agg(results: DataFrame) -> DataFrame:
    return results.groupBy("campaign_id", "metric_name").agg(
        F.avg("lift_relative_pct").alias("avg_lift"),
        F.count("*").alias("measurement_count"),
        F.count_if("is_significant").alias("significant_count"),
    )


def metric_chart(results: DataFrame) -> DataFrame:
    return results.groupBy("metric_name").agg(
        F.avg("lift_relative_pct").alias("average_lift"),
        F.avg("exposed_value").alias("average_exposed"),
        F.avg("control_value").alias("average_control"),
        F.max("is_significant").alias("any_significant"),
    )


def time_drill(exposures: DataFrame, ts: str = "impression_ts") -> DataFrame:
    """Impressions per campaign rolled up year, quarter, month, day."""
    at = F.col(ts)
    dated = exposures.select(
        "campaign_id", F.year(at).alias("year"), F.quarter(at).alias("quarter"),
        F.month(at).alias("month"), F.dayofmonth(at).alias("day"),
    )
    # Days shrink the rows before the roll-up multiplies them.
    daily = dated.groupBy("campaign_id", "year", "quarter", "month", "day").agg(
        F.count("*").alias("n")
    )
    levels = [["year"], ["year", "quarter"], ["year", "quarter", "month"],
              ["year", "quarter", "month", "day"]]
    sets = [[F.col("campaign_id"), *[F.col(c) for c in level]] for level in levels]
    columns = [F.col(c) for c in ("campaign_id", "year", "quarter", "month", "day")]
    return daily.groupingSets(sets, *columns).agg(F.sum("n").alias("impressions"))


def lift_histogram(results: DataFrame, bins: int = 10, value: str = "lift_relative_pct") -> DataFrame:
    """Equal-width bins over the range of the lift; the top edge belongs to the last bin."""
    v = F.col(value)
    low, high = results.agg(F.min(v)).scalar(), results.agg(F.max(v)).scalar()
    width = (F.col("high") - F.col("low")) / bins
    place = F.when(width > 0, F.least(F.floor((v - F.col("low")) / width) + 1, F.lit(bins))).otherwise(F.lit(1))
    binned = results.filter(v.isNotNull()).select(v, low.alias("low"), high.alias("high"))
    return binned.groupBy(
        place.cast("int").alias("bin"), "low", "high"
    ).agg(F.count("*").alias("n")).select(
        "bin",
        (F.col("low") + (F.col("bin") - 1) * width).alias("bin_low"),
        (F.col("low") + F.col("bin") * width).alias("bin_high"),
        "n",
    )


def scatter_feed(results: DataFrame) -> DataFrame:
    return results.select(
        "campaign_id", "metric_name", "cohort_size_exposed", "p_value",
        F.abs("lift_relative_pct").alias("lift_magnitude"), "is_significant",
    )


def ci_feed(results: DataFrame) -> DataFrame:
    return results.groupBy("metric_name").agg(
        F.avg("lift_absolute").alias("lift_absolute"),
        F.avg("confidence_interval_lower").alias("ci_lower"),
        F.avg("confidence_interval_upper").alias("ci_upper"),
    )


def sample_sizes(results: DataFrame) -> DataFrame:
    return results.agg(
        F.sum("cohort_size_exposed").alias("exposed_total"),
        F.sum("cohort_size_control").alias("control_total"),
        F.try_divide(F.sum("cohort_size_control"), F.sum("cohort_size_exposed")).alias("match_ratio"),
    )
