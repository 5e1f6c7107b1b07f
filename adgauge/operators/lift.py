"""Brand lift: cohort moments in one conditional aggregate, then arithmetic on few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adgauge.functions import stats, survey
from adgauge.functions.text import metric_label, stable_id

COHORTS = ("exposed", "control")


def join_metrics(cohorts: DataFrame, metrics: DataFrame) -> DataFrame:
    """Cohort rows with their survey metric values, on (panelist, campaign).

    Metric rows stream past the cohort rows of their shuffled partition: they are not sorted, and no machine holds all cohorts."""
    return cohorts.hint("shuffle_hash").join(metrics, ["panelist_id", "campaign_id"])


def cohort_moments(
    df: DataFrame, keys: list[str], value: str = "metric_value", population: bool = False
) -> DataFrame:
    """Mean, standard deviation and size of both arms for every key at once."""
    deviation = F.stddev_pop if population else F.stddev_samp
    aggregates = []
    for arm in COHORTS:
        v = F.when(F.col("cohort_type") == arm, F.col(value))
        aggregates += [
            F.avg(v).alias(f"{arm}_value"),
            deviation(v).alias(f"{arm}_std_dev"),
            F.count(v).alias(f"{arm}_sample_size"),
        ]
    return df.groupBy(*keys).agg(*aggregates)


def _pooled_t() -> Column:
    ne, nc = (F.col(f"{a}_sample_size").cast("double") for a in COHORTS)
    se, sc = F.col("exposed_std_dev"), F.col("control_std_dev")
    pooled = F.try_divide((ne - 1) * se * se + (nc - 1) * sc * sc, ne + nc - 2)
    error = F.sqrt(pooled * (F.try_divide(F.lit(1.0), ne) + F.try_divide(F.lit(1.0), nc)))
    return F.try_divide(F.col("lift_absolute"), error)


def lift_statistics(moments: DataFrame, p_rule: str = "exact", alpha: float = 0.05) -> DataFrame:
    """Adds lift, pooled two-sample t, p, significance and the unpooled 95 % interval.

    `p_rule="exact"` uses the t distribution, `"step"` the coarse table on |t|.
    """
    variance = (
        F.try_divide(F.col("exposed_std_dev") ** 2, F.col("exposed_sample_size"))
        + F.try_divide(F.col("control_std_dev") ** 2, F.col("control_sample_size"))
    )
    with_t = (
        moments.withColumn("lift_absolute", F.col("exposed_value") - F.col("control_value"))
        .withColumn(
            "lift_relative_pct",
            F.when(F.col("control_value") > 0, F.col("lift_absolute") / F.col("control_value") * 100)
            .otherwise(F.lit(0.0)),
        )
        .withColumn("t_statistic", _pooled_t())
        .withColumn(
            "degrees_of_freedom", F.col("exposed_sample_size") + F.col("control_sample_size") - 2
        )
        .withColumn("margin", F.lit(stats.Z_95) * F.sqrt(variance))
    )
    if p_rule == "exact":
        p = stats.t_pvalue("t_statistic", F.col("degrees_of_freedom").cast("double"))
    elif p_rule == "step":
        p = F.when(F.col("t_statistic").isNotNull(), stats.step_p("t_statistic"))
    else:
        raise ValueError(f"unknown p rule: {p_rule}")
    return (
        with_t.withColumn("p_value", p)
        .withColumns({
            "is_significant": F.coalesce(F.col("p_value") < alpha, F.lit(False)),
            "confidence_interval_lower": F.col("lift_absolute") - F.col("margin"),
            "confidence_interval_upper": F.col("lift_absolute") + F.col("margin"),
        })
        .drop("margin")
    )


def lift_results(
    statistics: DataFrame, batch: Column, run_ts: Column, balance_scores: DataFrame | None = None,
    caliper: float = 0.1, window_days: int = 30, model_version: str = "v1.0",
    created_by: str = "lift_job",
) -> DataFrame:
    """Lift statistics with run metadata, in the layout of the lift table.

    Statistics that name their `statistical_test` keep it; others are those of the t test.
    """
    start, end = survey.window_dates(run_ts, window_days)
    job = survey.batch_id("lift", "campaign_id", run_ts)
    if balance_scores is None:
        scored = statistics.withColumn("balance_score", F.lit(None).cast("double"))
    else:
        scored = statistics.join(
            balance_scores.select("campaign_id", "balance_score"), "campaign_id", "left"
        )
    return scored.withColumns({
        "lift_result_id": stable_id("lift_", job, F.col("campaign_id"), F.col("metric_name")),
        "statistical_test": F.col("statistical_test") if "statistical_test" in statistics.columns else F.lit("t-test"),
        "cohort_definition": survey.cohort_definition(batch, caliper=caliper),
        "cohort_size_exposed": F.col("exposed_sample_size"),
        "cohort_size_control": F.col("control_sample_size"),
        "analysis_start_date": start,
        "analysis_end_date": end,
        "measurement_window_days": F.lit(window_days),
        "run_ts": run_ts,
        "processing_job_id": job,
        "model_version": F.lit(model_version),
        "created_by": F.lit(created_by),
    })


def segmented_metrics(joined: DataFrame, panelists: DataFrame) -> DataFrame:
    """Metric rows with the panelist's segment columns."""
    segments = panelists.select(
        "panelist_id", "age_range", "gender", "country", "device_type",
        F.col("hh_income_bucket").alias("income_bucket"),
    )
    return joined.join(segments, "panelist_id")


# Segmentations of the report, each a list of segment columns.
SEGMENT_SETS = (["device_type"], ["country"], ["age_range", "gender", "income_bucket"])


def segment_lift(
    df: DataFrame, sets: tuple[list[str], ...] = SEGMENT_SETS, p_rule: str = "exact"
) -> DataFrame:
    """Lift per campaign, metric and segment for several segmentations in one grouping-sets pass."""
    keys = ["campaign_id", "metric_name"]
    dims = list(dict.fromkeys(d for s in sets for d in s))
    arms = []
    for arm in COHORTS:
        v = F.when(F.col("cohort_type") == arm, F.col("metric_value"))
        arms += [
            F.avg(v).alias(f"{arm}_value"),
            F.stddev_samp(v).alias(f"{arm}_std_dev"),
            F.count(v).alias(f"{arm}_sample_size"),
        ]
    columns = [F.col(c) for c in keys + dims]
    grouped = df.groupingSets([[F.col(c) for c in keys + s] for s in sets], *columns)
    labels = F.concat_ws(" x ", *[F.when(F.grouping(d) == 0, F.lit(d)) for d in dims])
    moments = grouped.agg(labels.alias("segmentation"), *arms)
    return lift_statistics(moments, p_rule)


def lift_by_question(values: DataFrame, now: Column | None = None) -> DataFrame:
    """Question-level lift for display, from (survey, campaign, question, metric, cohort, value).

    Means, population deviations (about the rounded mean) and intervals are rounded half-even to
    2 places; t uses sample variances of the raw values; p comes from the step table. Questions
    without a numeric answer in both arms are left out.
    """
    keys = ["survey_id", "campaign_id", "question_id", "metric_name"]
    aggregates = []
    for arm in COHORTS:
        v = F.when(F.col("cohort_type") == arm, F.col("numeric_value"))
        aggregates += [
            F.avg(v).alias(f"{arm}_raw"), F.var_pop(v).alias(f"{arm}_vp"),
            F.var_samp(v).alias(f"{arm}_vs"), F.count(v).alias(f"{arm}_n"),
        ]
    m = values.groupBy(*keys).agg(*aggregates).filter(
        (F.col("exposed_n") > 0) & (F.col("control_n") > 0)
    )
    for arm in COHORTS:
        mean = stats.round_even(f"{arm}_raw", 2)
        m = m.withColumn(f"{arm}_mean", mean)
        m = m.withColumn(
            f"{arm}_std_dev",
            stats.round_even(F.sqrt(F.col(f"{arm}_vp") + (F.col(f"{arm}_raw") - F.col(f"{arm}_mean")) ** 2), 2),
        )
        low, high = stats.mean_ci(f"{arm}_mean", f"{arm}_std_dev", f"{arm}_n")
        m = m.withColumns({f"{arm}_ci_lower": low, f"{arm}_ci_upper": high})
    enough = (F.col("exposed_n") >= 2) & (F.col("control_n") >= 2)
    ne, nc = F.col("exposed_n").cast("double"), F.col("control_n").cast("double")
    pooled = ((ne - 1) * F.col("exposed_vs") + (nc - 1) * F.col("control_vs")) / F.nullif(ne + nc - 2, F.lit(0.0))
    error = F.sqrt(pooled) * F.sqrt(1 / ne + 1 / nc)
    gap = F.col("exposed_mean") - F.col("control_mean")
    raw_t = F.when(
        enough & (error > 0),
        F.try_divide(F.col("exposed_raw") - F.col("control_raw"), error),
    ).otherwise(F.lit(0.0))
    m = m.withColumn("_t", raw_t).withColumns({
        "absolute_lift": stats.round_even(gap, 2),
        "lift_pct": F.when(
            F.col("control_mean") > 0, stats.round_even(gap / F.col("control_mean") * 100, 2)
        ).otherwise(F.lit(0.0)),
        "p_value": F.when(enough, stats.step_p("_t")).otherwise(F.lit(1.0)),
        "t_statistic": stats.round_even("_t", 3),
        "degrees_of_freedom": F.when(enough, F.col("exposed_n") + F.col("control_n") - 2),
        "metric_display_name": metric_label("metric_name"),
    })
    m = m.withColumns({
        "is_significant": F.col("p_value") < 0.05,
        "significance_level": stats.stars("p_value"),
    })
    if now is not None:
        m = m.withColumn("calculated_at", now)
    return m.drop("_t", *[f"{a}_{s}" for a in COHORTS for s in ("raw", "vp", "vs")])


def lift_by_metric(results: DataFrame, lift: str = "lift_relative_pct") -> DataFrame:
    """Average lift, significant and total measurements per metric."""
    return results.groupBy("metric_name").agg(
        F.avg(lift).alias("average_lift"),
        F.count_if("is_significant").alias("significant"),
        F.count("*").alias("measurements"),
    )


def lift_overall(results: DataFrame, lift: str = "lift_relative_pct") -> DataFrame:
    return results.agg(
        F.avg(lift).alias("average_lift"),
        F.count_if("is_significant").alias("significant"),
        F.count("*").alias("measurements"),
    )


def lift_report(results: DataFrame) -> DataFrame:
    """Best relative lift first."""
    return results.orderBy(F.desc("lift_relative_pct"), "campaign_id", "metric_name")


def latest_runs(results: DataFrame) -> DataFrame:
    """The newest run of every campaign and metric; partial aggregation, no per-key sort."""
    row = F.struct(*[F.col(c) for c in results.columns])
    order = F.struct("run_ts", "lift_result_id")
    return results.groupBy("campaign_id", "metric_name").agg(
        F.max_by(row, order).alias("r")
    ).select("r.*")


def significant_only(results: DataFrame) -> DataFrame:
    return results.filter("is_significant")
