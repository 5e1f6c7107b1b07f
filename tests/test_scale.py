"""Plans and results of steps that must not hold a whole table in one task or on the driver."""

import random

import duckdb
import pytest

import __spark_entry__ as contract
from adgauge.operators import surveys, tables
from adgauge.plans.views import Views
from adgauge.schemas import ANSWERS
from tests.conftest import SMALL
from tests.test_catalog import canonical


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_answers_meet_surveys_without_a_broadcast(spark):
    rng = random.Random(5)
    ids = [None, "s1", "s1", "s2", "s3"]  # survey s1 comes twice, one has no id
    asked = [(s, f"camp{i}", [("q1", "?", "Rating", "m1"), ("q2", "?", "YesNo", f"m{i}"), (None, "?", "Rating", "m0")][: i or 3] + [("q1", "again", "Rating", "m9")] * (i % 2))
             for i, s in enumerate(ids)] + [("s4", "camp9", None)]
    given = [(f"r{i}", rng.choice(["s1", "s1", "s2", "s4", "s9", None]), f"p{i % 7}", rng.choice(["exposed", "control", None]), "Completed", None,
              rng.choice([None, [], [("q1", "3", 3.0), ("q2", None, None)], [(None, "x", 1.0), ("q2", "Yes", 1.0), ("q2", "No", 0.0)]])) for i in range(60)]
    s = spark.createDataFrame(asked, "survey_id string, campaign_id string, questions array<struct<question_id string, question_text string, question_type string, metric string>>")
    r = spark.createDataFrame(given, f"response_id string, survey_id string, panelist_id string, cohort_type string, status string, completed_at timestamp, answers {ANSWERS.simpleString()}")
    found = surveys.answers_long(s, r)
    want = [(x[0], x[1], a[0], a[1], a[2], c, q[1], q[3]) for x in given for a in x[6] or () for sid, c, qs in asked
            if sid is not None and sid == x[1] for q in qs or () if q[0] is not None and q[0] == a[0]]
    columns = ["response_id", "survey_id", "question_id", "answer", "numeric_value", "campaign_id", "question_text", "metric_name"]
    assert sorted(map(tuple, found.select(*columns).collect()), key=repr) == sorted(want, key=repr) and len(want) > 50
    assert "Broadcast" not in plan(found)


@pytest.mark.parametrize("name", ["c10_answers_long", "d02_distinct_values", "h22_metric_label", "e17_survey_results", "e18_answer_counts", "e22_lift_by_question"])
def test_surveys_are_not_broadcast(spark, name):
    shown = plan(contract.queries()[name](spark, SMALL))
    assert "ShuffledHashJoin [survey_id" in shown and "BroadcastHashJoin [survey_id" not in shown


def test_pool_of_panelists_is_not_broadcast(spark):
    shown = plan(Views(spark, SMALL).joined)
    assert "LeftSemi" in shown and not any("BroadcastHashJoin" in x and "LeftSemi" in x for x in shown.splitlines())


def test_metric_rows_stream_past_exposures_and_cohorts(spark):
    for name in ("e19_cohort_moments", "c04_join_metrics"):
        shown = plan(contract.queries()[name](spark, SMALL))
        assert "SortMergeJoin" not in shown and "BroadcastHashJoin [campaign_id" not in shown and "BroadcastHashJoin [panelist_id" not in shown
        assert any("ShuffledHashJoin" in x and "campaign_id" in x for x in shown.splitlines())


def test_tests_of_lift_share_the_written_rows(spark):
    shown = plan(contract.queries()["e21_lift_results_by_test"](spark, SMALL))
    assert not any(name in shown for name in ("customer.parquet", "orders.parquet", "part.parquet", "events.parquet"))


def test_eligible_panelists_by_counts_of_audiences(spark):
    rng = random.Random(3)
    some = lambda values, least: ",".join(rng.sample(values, rng.randint(least, len(values))))
    people = [(rng.choice([None, *(f"p{i}" for i in range(40))]), rng.choice(["18-24", "25-34", None]), rng.choice(["M", "F", ""]), rng.choice(["US", "DE", None]),
               rng.choice([None, "", some(["Sport", "news", "cars"], 1)])) for _ in range(60)]
    wanted = [(f"c{rng.randint(0, 25)}", some(["18-24", "25-34"], 0), some(["M", "F"], 0), some(["US", "DE"], 1), some(["sport", "News"], 0)) for _ in range(40)]
    p = spark.createDataFrame(people, "panelist_id string, age_range string, gender string, country string, interests string")
    split = lambda c: f"filter(split({c}, ','), x -> x <> '') AS {c}"
    c = spark.createDataFrame(wanted, "campaign_id string, age_range string, gender string, countries string, interests string").selectExpr(
        "campaign_id", f"struct({', '.join(split(x) for x in ('age_range', 'gender', 'interests', 'countries'))}) AS target_audience")
    pairs = tables.eligible_panelists(p, c).groupBy("panelist_id").agg({"*": "count", "campaign_id": "min"}).selectExpr("panelist_id", "`count(1)`", "`min(campaign_id)`")
    found = tables.eligible_panelists(p, c, per_panelist=True).select("panelist_id", "campaigns", "first_campaign")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, pairs.collect()), key=repr) and found.count() > 10


def test_stream_source_tells_events_and_campaigns(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
    df = contract.queries()["a05_event_stream_source"](spark, SMALL)
    cursor = con.execute(contract.oracle_sql()["a05_event_stream_source"])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns) == ["campaign_id", "event_id", "n", "seq", "seq_sum"]
    rows = cursor.fetchall()
    assert canonical(df.collect(), df.columns) == canonical(rows, columns) and rows
