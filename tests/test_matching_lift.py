"""Matching against brute force; lift and balance on hand-worked numbers."""

import random

import pytest
from pyspark.sql import functions as F

from adgauge.operators import lift, matching


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(3)
    rows = []
    for campaign, size in (("big", 400), ("small", 60), ("lonely", 5)):
        for i in range(size):
            exposed = 1 if campaign == "lonely" else int(rng.random() < 0.4)
            # Coarse scores make ties; one score of the big campaign holds a third of its rows.
            score = 0.5 if campaign == "big" and i % 3 == 0 else rng.randrange(1000) / 1000
            rows.append((campaign, f"p{i:03d}", exposed, score))
    return spark.createDataFrame(
        rows, "campaign_id string, panelist_id string, exposed int, propensity_score double"), rows


def brute(rows, caliper, ratio):
    want = {}
    for campaign, person, exposed, score in rows:
        if not exposed:
            continue
        near = sorted(
            (abs(score - s), p) for c, p, e, s in rows
            if c == campaign and not e and abs(score - s) <= caliper
        )
        for rank, (gap, control) in enumerate(near[:ratio], 1):
            want[campaign, person, rank] = (control, gap)
    return want


@pytest.mark.parametrize("ratio", [1, 2, 5])
@pytest.mark.parametrize("caliper", [0.1, 0.0015])
def test_match_equals_brute_force(panel, ratio, caliper):
    df, rows = panel
    got = {
        (r.campaign_id, r.exposed_id, r.match_rank): (r.control_id, r.ps_diff)
        for r in matching.match(df, caliper, ratio, cells=64).collect()
    }
    assert got == brute(rows, caliper, ratio)


def test_caliper_counts(panel):
    df, rows = panel
    got = {(r.campaign_id, r.panelist_id): r.candidates for r in matching.caliper_counts(df, 0.0105).collect()}
    want = {
        (c, p): sum(c2 == c and not e2 and abs(s - s2) <= 0.0105 for c2, _, e2, s2 in rows)
        for c, p, e, s in rows if e
    }
    assert got == want


def test_match_id_is_stable(panel):
    df, _ = panel
    first = {r.match_id for r in matching.match(df).collect()}
    assert first == {r.match_id for r in matching.match(df.repartition(7)).collect()}


def test_balance_by_hand(spark):
    rows = [("c", "e1", 1, 2.0), ("c", "e2", 1, 4.0), ("c", "c1", 0, 1.0), ("c", "c2", 0, 3.0), ("c", "c3", 0, 9.0)]
    df = spark.createDataFrame(rows, "campaign_id string, panelist_id string, exposed int, x double")
    pairs = spark.createDataFrame([("c", "e1", "c2"), ("c", "e2", "c2")], "campaign_id string, exposed_id string, control_id string")
    [row] = matching.balance(df, pairs, ["x"]).collect()
    # Before: means 3 and 13/3, variances 2 and 52/3. After: one control, so no variance.
    assert row.smd_before == pytest.approx((3 - 13 / 3) / ((2 + 52 / 3) / 2) ** 0.5)
    assert row.smd_after is None and row.balanced is False
    both = spark.createDataFrame([("c", "e1", "c1"), ("c", "e2", "c2")], "campaign_id string, exposed_id string, control_id string")
    [row] = matching.balance(df, both, ["x"]).collect()
    assert row.smd_after == pytest.approx(1 / 2**0.5)


def test_fit_needs_both_arms(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.2)], "exposed int, age_normalized double")
    with pytest.raises(ValueError):
        matching.fit_propensity(df, ["age_normalized"])


def test_income_bands_ignore_case_and_blanks(spark):
    rows = [("< 25k",), ("25K-50K",), ("150K+",), ("100K-150K",), ("50k-75k",), (None,)]
    df = spark.createDataFrame(rows, "hh_income_bucket string")
    for name, kind in (("age", "int"), ("gender", "string"), ("country", "string"), ("device_type", "string")):
        df = df.withColumn(name, F.lit(None).cast(kind))
    got = [(r.income_low, r.income_high) for r in matching.encode_features(matching.fill_features(df)).collect()]
    assert got == [(1, 0), (1, 0), (0, 1), (0, 1), (0, 0), (0, 0)]


@pytest.fixture(scope="module")
def answers(spark):
    values = [("exposed", v) for v in (4.0, 5.0, 5.0, 4.0)] + [("control", v) for v in (2.0, 3.0, 2.0, 3.0)]
    rows = [("s", "c", "q1", "brand_awareness", cohort, v, f"p{i}") for i, (cohort, v) in enumerate(values)]
    return spark.createDataFrame(
        rows, "survey_id string, campaign_id string, question_id string, metric_name string, "
        "cohort_type string, numeric_value double, panelist_id string")


def test_lift_by_hand(answers):
    df = answers.withColumnRenamed("numeric_value", "metric_value")
    [row] = lift.lift_statistics(lift.cohort_moments(df, ["campaign_id", "metric_name"])).collect()
    assert (row.exposed_value, row.control_value, row.lift_absolute, row.lift_relative_pct) == (4.5, 2.5, 2.0, 80.0)
    assert row.t_statistic == pytest.approx(4.898979, abs=1e-6) and row.degrees_of_freedom == 6
    assert row.p_value == pytest.approx(0.0027, abs=1e-4) and row.is_significant
    assert row.confidence_interval_lower == pytest.approx(2 - 1.96 * (1 / 6) ** 0.5)


def test_question_lift_by_hand(answers):
    [row] = lift.lift_by_question(answers).collect()
    assert (row.exposed_mean, row.exposed_std_dev, row.exposed_ci_lower, row.exposed_ci_upper) == (4.5, 0.5, 4.01, 4.99)
    assert (row.lift_pct, row.t_statistic, row.p_value, row.significance_level) == (80.0, 4.899, 0.001, "**")
    assert row.metric_display_name == "Brand Awareness"


def test_lift_edge_cases(spark):
    rows = [("a", "exposed", 1.0), ("a", "control", 0.0), ("a", "control", 0.0),
            ("b", "exposed", 1.0), ("b", "exposed", 2.0),
            ("z", "exposed", 3.0), ("z", "exposed", 3.0), ("z", "control", 3.0), ("z", "control", 3.0)]
    df = spark.createDataFrame(rows, "metric_name string, cohort_type string, metric_value double")
    got = {r.metric_name: r for r in lift.lift_statistics(lift.cohort_moments(df, ["metric_name"])).collect()}
    assert got["a"].lift_relative_pct == 0.0
    assert got["b"].control_value is None and got["b"].p_value is None and got["b"].is_significant is False
    assert got["z"].t_statistic is None and got["z"].lift_absolute == 0.0
