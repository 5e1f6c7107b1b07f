"""One campaign from exposure to lift: the reference flow as a single job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adgauge.functions.survey import batch_id
from adgauge.operators import lift, matching
from adgauge.operators.impressions import panelist_exposure
from adgauge.session import cut


@dataclass
class Measurement:
    """Tables of one run."""

    scored: DataFrame
    pairs: DataFrame
    balance: DataFrame
    cohorts: DataFrame
    summary: DataFrame
    results: DataFrame


def first_impressions(impressions: DataFrame) -> DataFrame:
    """Earliest valid impression of each (campaign, panelist)."""
    return impressions.filter(~F.col("is_bot")).groupBy("campaign_id", "panelist_id").agg(
        F.min_by("impression_id", F.struct("timestamp_utc", "impression_id")).alias("impression_id")
    )


def measure_campaign(
    impressions: DataFrame, panelists: DataFrame, metrics: DataFrame, campaign_id: str,
    run_ts: Column, min_impressions: int = 1, caliper: float = 0.1, ratio: int = 1,
    score: Column | None = None, p_rule: str = "exact",
) -> Measurement:
    """Exposed and control panelists of a campaign, matched on the propensity score, and the lift
    of every survey metric between the matched arms.

    `score` replaces the fitted model by a given expression over the encoded features.
    """
    mine = impressions.filter(F.col("campaign_id") == campaign_id)
    exposure = panelist_exposure(mine, min_impressions)
    panel = matching.encode_features(
        matching.fill_features(matching.campaign_panel(panelists, exposure, campaign_id))
    )
    if score is None:
        panel = cut(panel)
        scored = matching.score(matching.fit_propensity(panel), panel)
    else:
        scored = panel.withColumn("propensity_score", score)
    # Panel and pairs are read several times below; both are small next to the events.
    scored = cut(scored)
    pairs = cut(matching.match(scored, caliper, ratio))
    balance = cut(matching.balance(scored, pairs))
    scores = matching.balance_score(balance)
    cohorts = matching.cohort_rows(pairs, scores, run_ts, first_impressions(mine))
    arms = matching.distinct_cohort(cohorts)
    joined = lift.join_metrics(arms.drop("balance_score"), metrics)
    statistics = lift.lift_statistics(
        lift.cohort_moments(joined, ["campaign_id", "metric_name"]), p_rule
    )
    batch = batch_id("psm", "campaign_id", run_ts)
    return Measurement(
        scored, pairs, balance, cohorts,
        matching.psm_summary(scored, pairs, scores, caliper, run_ts),
        lift.lift_results(statistics, batch, run_ts, scores, caliper),
    )
