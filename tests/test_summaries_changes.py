"""Summary invariants, paging and change application."""

import pytest
from pyspark.sql import functions as F

from adgauge.operators import changes, impressions, report, surveys, tables
from adgauge.plans.views import Views
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def v(spark):
    return Views(spark, SMALL)


def test_summary_invariants(v):
    for r in impressions.all_summaries(v.impressions, with_hours=True).collect():
        assert r.total_impressions == r.valid_impressions + r.bot_impressions
        for part in (r.by_device, r.by_country, r.by_hour):
            assert sum(part.values()) == r.valid_impressions
        assert sum(r.by_source.values()) == r.total_impressions
        counts = [c["count"] for c in r.by_creative]
        assert sum(counts) == r.valid_impressions and counts == sorted(counts, reverse=True)


def test_bot_only_campaign_keeps_its_summary(spark):
    rows = [("c", "cr", "p", "d", "US", True, "S2S", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(
        rows, "campaign_id string, creative_id string, panelist_id string, device_type string, country string, "
        "is_bot boolean, ingest_source string, ts string").withColumn("timestamp_utc", F.col("ts").cast("timestamp"))
    [r] = impressions.all_summaries(df).collect()
    assert (r.total_impressions, r.valid_impressions, r.by_device, r.by_source) == (1, 0, {}, {"S2S": 1})


def test_min_impressions_must_be_positive(v):
    with pytest.raises(ValueError):
        impressions.exposed_panelists(v.impressions, "camp_0", 0)


def test_reach_is_reported_both_ways(v):
    [r] = impressions.global_totals(v.impressions).collect()
    assert r.distinct_panelists <= r.sum_unique_panelists


def test_page_is_clamped(v):
    order = ["impression_id"]
    last = tables.page(v.impressions, 10_000, 300, order).collect()
    assert {(r.page, r.page_count) for r in last} == {(4, 4)} and len(last) == 100
    assert tables.page(v.impressions, -3, 300, order).first().page == 1
    assert tables.page(v.impressions.limit(0), 1, 10, order).count() == 0


def test_eligible_counts_equal_pairs(v):
    pairs = tables.eligible_panelists(v.panelists, v.campaigns)
    assert pairs.count() == pairs.distinct().count()
    counted = pairs.groupBy("campaign_id").agg(F.count("*").alias("eligible"))
    totals = tables.eligible_counts(v.panelists, v.campaigns).filter("eligible > 0")
    assert totals.exceptAll(counted).count() == 0 and totals.count() == counted.count()


def test_upsert_is_idempotent_and_last_wins(spark):
    target = spark.createDataFrame([("a", 1), ("b", 1)], "k string, n int")
    feed = spark.createDataFrame([("b", 2), ("b", 5), ("c", 3)], "k string, n int")
    once = changes.upsert_latest(target, feed, "k", ["n"])
    twice = changes.upsert_latest(once, feed, "k", ["n"])
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 5), ("c", 3)]
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_insert_only_keeps_existing(spark):
    target = spark.createDataFrame([("a", 1)], "k string, n int")
    feed = spark.createDataFrame([("a", 9), ("b", 4), ("b", 2)], "k string, n int")
    got = changes.insert_new(target, feed, "k", ["n"])
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("b", 2)]


def test_campaign_status_edges(spark):
    rows = [("2024-01-02", "2024-01-09"), ("2024-01-01", "2024-01-01"), ("2023-01-01", "2023-12-31")]
    df = spark.createDataFrame(rows, "s string, e string").select(
        F.col("s").cast("timestamp").alias("start_date"), F.col("e").cast("timestamp").alias("end_date"))
    now = F.lit("2024-01-01").cast("timestamp")
    assert [r[0] for r in df.select(changes.campaign_status(now)).collect()] == ["Scheduled", "Active", "Completed"]


def test_completion_ladder(spark):
    responses = spark.createDataFrame(
        [("p1", "Pending", "exposed", "u1", "s1", "c1", 3, "2024-01-01"), ("p2", "Completed", "control", "u2", "s1", "c1", None, "2024-01-01")],
        "response_id string, status string, cohort_type string, panelist_id string, survey_id string, campaign_id string, impression_count int, created_at string")
    submissions = spark.createDataFrame(
        [(1, "p1", "s1", "x"), (2, "p1", "s1", "x"), (3, "p2", "s1", "x"), (4, None, "s1", "y"), (5, "gone", "s1", "z"), (6, None, "nope", "q")],
        "submission_id int, pending_response_id string, survey_id string, panelist_id string"
    ).selectExpr("*", "'a' AS answers", "5 AS response_time", "'Mobile' AS device_type")
    known = spark.createDataFrame([("s1", "c1")], "survey_id string, campaign_id string")
    got = {r.submission_id: r for r in surveys.complete_responses(responses, submissions, known, F.lit("now")).collect()}
    assert [got[i].outcome for i in range(1, 7)] == [
        "completed", "already_completed", "already_completed", "created", "created", "survey_not_found"]
    assert (got[1].panelist_id, got[1].cohort_type, got[1].impression_count) == ("u1", "exposed", 3)
    assert got[4].cohort_type is None and got[5].panelist_id == "z"


def test_scope_rows(spark):
    df = spark.createDataFrame([("c1", "a1"), ("c2", "a1"), ("c3", "a2")], "client_id string, agency_id string")
    users = spark.createDataFrame([("u@x.example", "a1")], "email string, agency_id string")
    assert report.scope_rows(df, "admin", "").count() == 3
    assert report.scope_rows(df, "client", "c3").count() == 1
    assert report.scope_rows(df, "agency", "u@x.example", users).count() == 2
    with pytest.raises(ValueError):
        report.scope_rows(df, "guest", "")
