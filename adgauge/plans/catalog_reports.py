"""Catalogue: documents, joins, sets, aggregates, order, changes, matching, lift, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from adgauge import schemas
from adgauge.functions import survey as survey_rules
from adgauge.operators import changes, impressions as imp, lift, matching, report, significance, surveys, tables
from adgauge.plans.catalog_events import _mapping, t_p_sql, ts
from adgauge.plans.measure import measure_campaign
from adgauge.plans.registry import query
from adgauge.plans.views import AGE_RANGE, CAMPAIGN, NOW, SCORE, stamp
from adgauge.session import cut, scratch_path

CALIPER = 0.0105


def _dates(v):
    return v.events.select(F.to_date("timestamp").alias("date"))


# ---- B: documents -----------------------------------------------------------------------------

query(
    "b15_dim_panelist",
    lambda v: tables.build_dim_panelist(v.panelists).withColumns({
        "interests": F.array_join("interests", "|"), "created_at": stamp("created_at")}),
    f"""SELECT panelist_id, age_range, gender, hh_income_bucket AS income_bucket, country, device_type, browser,
    array_to_string(list_filter(list_transform(string_split(interests, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS interests,
    consent_gdpr, consent_ccpa, points_balance, is_active, {ts('created_at')} AS created_at FROM panelists""",
)
query(
    "b15_dim_campaign",
    lambda v: tables.build_dim_campaign(v.campaigns).withColumns({
        "start_date": F.col("start_date").cast("string"), "end_date": F.col("end_date").cast("string"),
        "budget": F.col("budget").cast("double"), "created_at": stamp("created_at")}),
    f"""SELECT campaign_id, campaign_name, advertiser, industry, start_date::date::varchar AS start_date, end_date::date::varchar AS end_date,
    budget::double AS budget, target_impressions, target_reach, target_lift, status, {ts('created_at')} AS created_at FROM campaigns""",
)
query(
    "b16_dim_time",
    lambda v: tables.build_dim_time(_dates(v)).withColumn("date", F.col("date").cast("string")),
    """SELECT d::date::varchar AS date, year(d)::int AS year, quarter(d)::int AS quarter, month(d)::int AS month, week(d)::int AS week,
    (dayofweek(d) + 1)::int AS day_of_week FROM (SELECT unnest(generate_series(min(timestamp)::date::timestamp, max(timestamp)::date::timestamp, INTERVAL 1 DAY)) AS d FROM raw_events)""",
)
query(
    "b17_list_campaigns",
    lambda v: tables.list_documents(v.campaigns, "campaign_id", status="Active", industry="ECONOMY").select(
        "campaign_id", "status", "industry", stamp("created_at").alias("created_at")),
    f"SELECT campaign_id, status, industry, {ts('created_at')} AS created_at FROM campaigns WHERE status = 'Active' AND industry = 'ECONOMY'",
)
query(
    "b17_list_responses",
    lambda v: tables.list_documents(v.responses, "response_id", survey_id="survey_3").select("response_id", "status"),
    "SELECT response_id, status FROM responses WHERE survey_id = 'survey_3'",
)
query(
    "b18_active_campaigns",
    lambda v: tables.active_campaigns(v.campaigns).select("campaign_id", "status"),
    "SELECT campaign_id, status FROM campaigns WHERE status = 'Active'",
)
query(
    "b18_active_panelists",
    lambda v: tables.active_panelists(v.panelists).select("panelist_id"),
    "SELECT panelist_id FROM panelists WHERE is_active",
)
query(
    "b19_filter_impressions",
    lambda v: tables.filter_impressions(v.impressions, CAMPAIGN, "Pixel", "Tablet", False, "4").select("impression_id", "panelist_id"),
    f"""SELECT impression_id, panelist_id FROM impressions WHERE campaign_id = '{CAMPAIGN}' AND ingest_source = 'Pixel'
    AND device_type = 'Tablet' AND NOT is_bot AND contains(panelist_id, '4')""",
)
query(
    "b20_search_panelists",
    lambda v: tables.search_panelists(v.panelists, "FirsT7").select("panelist_id"),
    """SELECT panelist_id FROM panelists WHERE contains(lower(first_name), 'first7') OR contains(lower(last_name), 'first7')
    OR contains(lower(email), 'first7') OR contains(lower(country), 'first7')""",
)
query(
    "b21_audience",
    lambda v: tables.audience(v.panelists, "25-34", "F", "US").select("panelist_id"),
    "SELECT panelist_id FROM panelists WHERE age_range = '25-34' AND gender = 'F' AND country = 'US'",
)
ELIGIBLE_SQL = """SELECT c.campaign_id, p.panelist_id FROM campaigns c JOIN (SELECT panelist_id, age_range, gender, country,
      list_filter(list_transform(string_split(interests, ','), lambda x: lower(trim(x))), lambda x: x <> '') AS own FROM panelists) p ON
    (c.ages = '' OR list_contains(string_split(c.ages, ','), p.age_range)) AND (c.genders = '' OR list_contains(string_split(c.genders, ','), p.gender))
    AND list_contains(string_split(c.countries, ','), p.country)
    AND (c.wanted_interests = '' OR list_has_any(string_split(lower(c.wanted_interests), ','), p.own))"""
query(
    "b22_eligible_panelists",
    lambda v: tables.eligible_panelists(v.panelists, v.campaigns, per_panelist=True),
    f"SELECT panelist_id, count(*) AS campaigns, min(campaign_id) AS first_campaign FROM ({ELIGIBLE_SQL}) GROUP BY 1",
)
query(
    "b22_eligible_counts",
    lambda v: tables.eligible_counts(v.panelists, v.campaigns),
    f"""SELECT c.campaign_id, count(e.panelist_id) AS eligible FROM campaigns c LEFT JOIN ({ELIGIBLE_SQL}) e ON e.campaign_id = c.campaign_id GROUP BY 1""",
)
query(
    "b23_campaign_status",
    lambda v: v.flat_campaigns.select("campaign_id", changes.campaign_status(v.now).alias("status")),
    "SELECT campaign_id, status FROM campaigns",
)
query(
    "b24_kpi_progress",
    lambda v: imp.kpi_progress(imp.impression_totals(v.impressions), v.campaigns),
    """WITH t AS (SELECT campaign_id, count(*) FILTER (NOT is_bot) AS valid, count(DISTINCT CASE WHEN NOT is_bot THEN panelist_id END) AS uniq
      FROM impressions GROUP BY 1)
    SELECT c.campaign_id, CASE WHEN target_impressions > 0 THEN round(coalesce(valid, 0) / target_impressions * 100, 1) ELSE 0 END::double AS impression_progress_pct,
    CASE WHEN target_reach > 0 THEN round(coalesce(uniq, 0) / target_reach * 100, 1) ELSE 0 END::double AS reach_progress_pct
    FROM campaigns c LEFT JOIN t ON t.campaign_id = c.campaign_id""",
)
query(
    "b25_check_consent",
    lambda v: tables.check_consent(v.table("orders").select(
        (F.col("o_custkey") * 2).cast("string").alias("panelist_id")).distinct(), v.panelists),
    """SELECT o.panelist_id, coalesce(p.consent_given, false) AS consent_given FROM (SELECT DISTINCT (o_custkey * 2)::varchar AS panelist_id FROM orders) o
    LEFT JOIN panelists p ON p.panelist_id = o.panelist_id""",
)
query(
    "b26_report_scope",
    lambda v: report.report_scope(v.lift, v.campaigns, F.to_date(v.now), 90, 3).select("campaign_id", "metric_name"),
    """SELECT campaign_id, metric_name FROM lift WHERE least(cohort_size_exposed, cohort_size_control) >= 3
    AND campaign_id IN (SELECT campaign_id FROM campaigns WHERE status IN ('Active', 'Completed'))""",
)


def _users(v):
    return v.flat_campaigns.select(
        F.concat(F.lit("u"), F.col("partkey").cast("string"), F.lit("@x.example")).alias("email"), "agency_id")


query(
    "b27_row_level_scope",
    lambda v: report.scope_rows(v.campaigns, "agency", "u3@x.example", _users(v)).select(
        "campaign_id", F.lit("agency").alias("role")).unionByName(
        report.scope_rows(v.campaigns, "client", "client_5").select("campaign_id", F.lit("client").alias("role"))).unionByName(
        report.scope_rows(v.campaigns, "admin", "").select("campaign_id", F.lit("admin").alias("role"))),
    """SELECT campaign_id, 'agency' AS role FROM campaigns WHERE agency_id = 'agency_3' UNION ALL
    SELECT campaign_id, 'client' FROM campaigns WHERE client_id = 'client_5' UNION ALL SELECT campaign_id, 'admin' FROM campaigns""",
)
query(
    "b28_retention_split",
    lambda v: report.retention_split(
        v.table("orders").select("o_orderkey", F.to_date("o_orderdate").alias("exposure_date")),
        F.lit("1999-06-01").cast("date")).select("o_orderkey", "tier"),
    """SELECT o_orderkey, CASE WHEN date '1999-06-01' - o_orderdate::date <= 90 THEN 'refresh' WHEN date '1999-06-01' - o_orderdate::date <= 730 THEN 'archive'
    ELSE 'expired' END AS tier FROM orders""",
)


def _refreshed(v):
    """A table by month of which the last 90 days are written anew with a mark."""
    path, today = scratch_path(v.spark, "window"), F.lit("1998-08-01").cast("date")
    orders = v.table("orders").select("o_orderkey", F.trunc(F.to_date("o_orderdate"), "month").alias("exposure_date"), F.lit("old").alias("mark"))
    orders.hint("rebalance", "exposure_date").write.partitionBy("exposure_date").parquet(path)
    report.refresh_window(orders.withColumn("mark", F.lit("new")), today, path)
    return v.spark.read.parquet(path).select("o_orderkey", "mark", F.col("exposure_date").cast("string").alias("exposure_date"))


query(
    "b28_refresh_window", _refreshed,
    """SELECT o_orderkey, CASE WHEN date '1998-08-01' - d <= 90 THEN 'new' ELSE 'old' END AS mark, d::varchar AS exposure_date
    FROM (SELECT o_orderkey, date_trunc('month', o_orderdate)::date AS d FROM orders)""",
)
query(
    "b29_significant_only",
    lambda v: lift.significant_only(v.lift).select("campaign_id", "metric_name"),
    "SELECT campaign_id, metric_name FROM lift WHERE is_significant",
)

# ---- C: joins ---------------------------------------------------------------------------------

query(
    "c01_exposure_features",
    lambda v: tables.join_features(
        v.impressions.filter(~F.col("is_bot")).select("impression_id", "panelist_id", "device_type"),
        tables.panelist_features(v.panelists, v.impressions, CAMPAIGN)).select(
        "impression_id", "panelist_id", "device_type", "age", "gender", "panelist_device_type"),
    f"""SELECT i.impression_id, i.panelist_id, i.device_type, p.age, p.gender, p.device_type AS panelist_device_type FROM impressions i
    LEFT JOIN panelists p ON p.panelist_id = i.panelist_id AND p.panelist_id IN (SELECT panelist_id FROM impressions WHERE campaign_id = '{CAMPAIGN}')
    WHERE NOT i.is_bot""",
)
query(
    "c03_nearest_score_candidates",
    lambda v: matching.nearest_scores(v.scored, CALIPER).select("campaign_id", "exposed_score", "control_score"),
    f"""WITH e AS (SELECT DISTINCT campaign_id, propensity_score AS s FROM scored WHERE exposed = 1),
      c AS (SELECT DISTINCT campaign_id, propensity_score AS s FROM scored WHERE exposed = 0),
      n AS (SELECT e.campaign_id, e.s AS exposed_score, (SELECT max(c.s) FROM c WHERE c.campaign_id = e.campaign_id AND c.s <= e.s) AS a,
        (SELECT min(c.s) FROM c WHERE c.campaign_id = e.campaign_id AND c.s > e.s) AS b FROM e)
    SELECT campaign_id, exposed_score, x AS control_score FROM (SELECT campaign_id, exposed_score, a AS x FROM n UNION ALL SELECT campaign_id, exposed_score, b FROM n)
    WHERE abs(exposed_score - x) <= {CALIPER}""",
)
query(
    "c03_caliper_candidate_counts",
    lambda v: matching.caliper_counts(v.scored, CALIPER).select("campaign_id", "panelist_id", "candidates"),
    f"""SELECT e.campaign_id, e.panelist_id, count(c.panelist_id) AS candidates FROM scored e LEFT JOIN scored c ON c.campaign_id = e.campaign_id
    AND c.exposed = 0 AND abs(e.propensity_score - c.propensity_score) <= {CALIPER} WHERE e.exposed = 1 GROUP BY 1, 2""",
)
query(
    "c04_join_metrics",
    lambda v: lift.join_metrics(
        v.exposure_counts.select("campaign_id", "panelist_id"), v.metrics).select(
        "campaign_id", "panelist_id", "metric_name", "metric_value"),
    """SELECT campaign_id, panelist_id, metric_name, metric_value FROM exposure_counts JOIN metrics USING (campaign_id, panelist_id)""",
)
query(
    "c05_matched_sample",
    lambda v: matching.matched_sample(v.scored, matching.match(v.scored, CALIPER)).select("campaign_id", "panelist_id", "exposed"),
    """SELECT DISTINCT campaign_id, exposed_id AS panelist_id, 1 AS exposed FROM pairs UNION ALL SELECT DISTINCT campaign_id, control_id, 0 FROM pairs""",
)


def _requests(v):
    return v.table("lineitem").select(
        F.concat(F.lit("survey_"), (F.col("l_partkey") % 24).cast("string")).alias("survey_id"),
        (F.col("l_suppkey") * 13 + F.col("l_linenumber")).cast("string").alias("panelist_id"),
        F.when(F.col("l_partkey") % 24 > 11, "control").alias("cohort_type"),
    )


REQUESTS_SQL = """SELECT concat('survey_', l_partkey % 24) AS survey_id, (l_suppkey * 13 + l_linenumber)::varchar AS panelist_id,
  CASE WHEN l_partkey % 24 > 11 THEN 'control' END AS cohort_type FROM lineitem"""


def _split_invited(v):
    fresh, known = surveys.split_already_invited(_requests(v).distinct(), v.responses)
    return fresh.withColumn("state", F.lit("open")).unionByName(known.withColumn("state", F.lit("known"))).groupBy(
        "survey_id", "state").agg(F.count("*").alias("n"))


query(
    "c06_already_invited", _split_invited,
    f"""SELECT survey_id, CASE WHEN EXISTS (SELECT 1 FROM responses s WHERE s.survey_id = r.survey_id AND s.panelist_id = r.panelist_id)
    THEN 'known' ELSE 'open' END AS state, count(*) AS n FROM (SELECT DISTINCT * FROM ({REQUESTS_SQL})) r GROUP BY 1, 2""",
)
query(
    "c07_enrich_response",
    lambda v: surveys.enrich_response(v.responses, v.surveys).select("response_id", "survey_id", "campaign_id"),
    "SELECT response_id, r.survey_id, s.campaign_id FROM responses r JOIN surveys s ON s.survey_id = r.survey_id",
)
query(
    "c08_campaign_name",
    lambda v: tables.with_campaign_name(v.impressions.select("impression_id", "campaign_id"), v.campaigns.filter(
        F.col("status") != "Scheduled")),
    """SELECT impression_id, i.campaign_id, coalesce(c.campaign_name, i.campaign_id) AS campaign_name FROM impressions i
    LEFT JOIN campaigns c ON c.campaign_id = i.campaign_id AND c.status <> 'Scheduled'""",
)
query(
    "c09_response_demographics",
    lambda v: tables.responses_with_demographics(v.responses.select("response_id", "panelist_id"), v.panelists),
    """SELECT response_id, r.panelist_id, p.age_range, p.gender, p.country FROM responses r LEFT JOIN panelists p ON p.panelist_id = r.panelist_id""",
)
query(
    "c10_answers_long",
    lambda v: v.answers.select("response_id", "survey_id", "campaign_id", "question_id", "metric_name", "answer", "numeric_value"),
    "SELECT response_id, survey_id, campaign_id, question_id, metric_name, answer, numeric_value FROM answers",
)
query(
    "c11_star_join",
    lambda v: report.star(v.impressions, v.campaigns, tables.build_dim_time(_dates(v)), "timestamp_utc").select(
        "impression_id", "campaign_id", "campaign_name", "industry", "campaign_status", "year", "quarter", "week",
        F.col("calendar_date").cast("string").alias("calendar_date")),
    """SELECT impression_id, i.campaign_id, campaign_name, industry, status AS campaign_status, year(timestamp_utc)::int AS year,
    quarter(timestamp_utc)::int AS quarter, week(timestamp_utc)::int AS week, timestamp_utc::date::varchar AS calendar_date
    FROM impressions i LEFT JOIN campaigns c ON c.campaign_id = i.campaign_id""",
)
query(
    "c12_impression_count",
    lambda v: surveys.with_impression_count(
        surveys.enrich_response(v.responses, v.surveys), v.exposure_counts).select("response_id", "impression_count"),
    """SELECT response_id, impression_count FROM responses r JOIN surveys s ON s.survey_id = r.survey_id LEFT JOIN exposure_counts e
    ON e.campaign_id = s.campaign_id AND e.panelist_id = r.panelist_id""",
)
query(
    "c13_panelist_journey",
    lambda v: tables.panelist_journey("17", v.panelists, v.impressions, surveys.enrich_response(v.responses, v.surveys)).withColumn("at", stamp("at")),
    f"""SELECT panelist_id, 'profile' AS kind, {ts('created_at')} AS at, panelist_id AS item_id, country, NULL::varchar AS campaign_id,
      NULL::boolean AS is_bot, NULL::varchar AS status FROM panelists WHERE panelist_id = '17'
    UNION ALL SELECT panelist_id, 'impression', {ts('timestamp_utc')}, impression_id, NULL, campaign_id, is_bot, NULL FROM impressions WHERE panelist_id = '17'
    UNION ALL SELECT panelist_id, 'response', CASE WHEN r.status = 'Completed' THEN {ts('completed_at')} END, response_id, NULL, s.campaign_id, NULL, r.status
      FROM responses r JOIN surveys s ON s.survey_id = r.survey_id WHERE panelist_id = '17'""",
)
query(
    "c14_segmented_metrics",
    lambda v: lift.segmented_metrics(v.joined, v.panelists).groupBy(
        "campaign_id", "metric_name", "age_range", "gender", "income_bucket").agg(F.count("*").alias("n")),
    """SELECT campaign_id, metric_name, age_range, gender, hh_income_bucket AS income_bucket, count(*) AS n
    FROM joined j JOIN panelists p ON p.panelist_id = j.panelist_id GROUP BY ALL""",
)

# ---- D: sets ----------------------------------------------------------------------------------


def _cohort_rows(v):
    pairs = cut(matching.match(v.scored, CALIPER))
    scores = matching.balance_score(matching.balance(matching.encode_features(v.scored), pairs))
    return matching.cohort_rows(pairs, scores, v.now)


COHORT_SQL = f"""SELECT exposed_id AS panelist_id, campaign_id, exposed_score AS propensity_score, ps_diff AS match_quality_score, 'exposed' AS cohort_type,
  true AS matched_control_flag, 'psm_' || campaign_id || '_20240125_120000' AS processing_batch_id FROM pairs
UNION ALL SELECT control_id, campaign_id, control_score, ps_diff, 'control', true, 'psm_' || campaign_id || '_20240125_120000' FROM pairs"""
query(
    "d01_union_cohorts",
    lambda v: _cohort_rows(v).select("panelist_id", "campaign_id", "propensity_score", "match_quality_score",
                                     "cohort_type", "matched_control_flag", "processing_batch_id"),
    COHORT_SQL, rounded="match_quality_score",
)
query(
    "d02_distinct_values",
    lambda v: tables.distinct_values(v.metrics, "metric_name"),
    "SELECT DISTINCT metric_name FROM metrics",
)
query(
    "d03_filter_values",
    lambda v: tables.filter_values(v.panelists),
    """SELECT DISTINCT 'age_range' AS name, age_range AS value FROM panelists WHERE age_range <> '' UNION ALL
    SELECT DISTINCT 'gender', gender FROM panelists WHERE gender <> '' UNION ALL SELECT DISTINCT 'country', country FROM panelists WHERE country <> ''""",
)
query(
    "d04_invite_targets",
    lambda v: surveys.invite_targets(v.impressions, v.responses),
    "SELECT panelist_id FROM impressions UNION SELECT panelist_id FROM responses",
)

# ---- E: aggregates ----------------------------------------------------------------------------

query(
    "e01_impression_totals",
    lambda v: imp.impression_totals(v.impressions).drop("unique_panelists"),
    """SELECT campaign_id, count(*) AS total_impressions, count(*) FILTER (NOT is_bot) AS valid_impressions,
    count(*) FILTER (is_bot) AS bot_impressions FROM impressions GROUP BY 1""",
)
query(
    "e02_unique_panelists",
    lambda v: imp.impression_totals(v.impressions).select("campaign_id", "unique_panelists"),
    "SELECT campaign_id, count(DISTINCT CASE WHEN NOT is_bot THEN panelist_id END) AS unique_panelists FROM impressions GROUP BY 1",
)
for _name, _fn, _key, _expr, _where in (
    ("e03_by_creative", imp.by_creative, "creative_id", "creative_id", "WHERE NOT is_bot"),
    ("e04_by_device", imp.by_device, "device_type", "device_type", "WHERE NOT is_bot"),
    ("e05_by_country", imp.by_country, "country", "country", "WHERE NOT is_bot"),
    ("e06_by_source", imp.by_source, "ingest_source", "ingest_source", ""),
    ("e07_by_hour", imp.by_hour, "hour", "strftime(timestamp_utc, '%Y-%m-%d %H:00')", "WHERE NOT is_bot"),
):
    query(
        _name, lambda v, _fn=_fn: _fn(v.impressions),
        f"SELECT campaign_id, {_expr} AS {_key}, count(*) AS impressions FROM impressions {_where} GROUP BY 1, 2",
    )


def _pairs_text(name):
    return F.array_join(F.transform(
        F.sort_array(F.map_entries(name)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|").alias(name)


def _summary_text(df, hours):
    maps = ["by_device", "by_country", "by_source"] + (["by_hour"] if hours else [])
    creative = F.array_join(F.transform("by_creative", lambda e: F.concat(
        e["creative_id"], F.lit("="), e["count"].cast("string"))), "|").alias("by_creative")
    return df.select("campaign_id", "total_impressions", "valid_impressions", "bot_impressions",
                     "unique_panelists", creative, *[_pairs_text(m) for m in maps])


def _summary_sql(hours: bool, where: str = "") -> str:
    dims = {"by_device": "device_type", "by_country": "country"}
    if hours:
        dims["by_hour"] = "strftime(timestamp_utc, '%Y-%m-%d %H:00')"
    parts = [
        f"(SELECT string_agg(k || '=' || n, '|' ORDER BY k) FROM (SELECT {e} AS k, count(*) AS n FROM impressions j "
        f"WHERE j.campaign_id = i.campaign_id AND NOT j.is_bot GROUP BY 1)) AS {name}" for name, e in dims.items()]
    parts.append("(SELECT string_agg(k || '=' || n, '|' ORDER BY k) FROM (SELECT ingest_source AS k, count(*) AS n FROM impressions j "
                 "WHERE j.campaign_id = i.campaign_id GROUP BY 1)) AS by_source")
    parts.append("(SELECT string_agg(k || '=' || n, '|' ORDER BY n DESC, k) FROM (SELECT creative_id AS k, count(*) AS n FROM impressions j "
                 "WHERE j.campaign_id = i.campaign_id AND NOT j.is_bot GROUP BY 1)) AS by_creative")
    return f"""SELECT i.*, {', '.join(parts)} FROM (SELECT campaign_id, count(*) AS total_impressions, count(*) FILTER (NOT is_bot) AS valid_impressions,
      count(*) FILTER (is_bot) AS bot_impressions, count(DISTINCT CASE WHEN NOT is_bot THEN panelist_id END) AS unique_panelists
      FROM impressions {where} GROUP BY 1) i"""


query("e08_campaign_summary", lambda v: _summary_text(imp.campaign_summary(v.impressions, CAMPAIGN), True),
      _summary_sql(True, f"WHERE campaign_id = '{CAMPAIGN}'"))
query("e09_all_summaries", lambda v: _summary_text(imp.all_summaries(v.impressions), False), _summary_sql(False))
query(
    "e10_exposed_panelists",
    lambda v: imp.exposed_panelists(v.impressions, CAMPAIGN, 2),
    f"""SELECT campaign_id, panelist_id, impression_count FROM exposure_counts WHERE campaign_id = '{CAMPAIGN}' AND impression_count >= 2""",
)
query(
    "e10_exposed_total",
    lambda v: imp.exposed_total(v.impressions, 2),
    "SELECT campaign_id, count(*) AS total_exposed_panelists FROM exposure_counts WHERE impression_count >= 2 GROUP BY 1",
)
query(
    "e11_global_totals",
    lambda v: imp.global_totals(v.impressions),
    """SELECT count(*) AS total_impressions, count(*) FILTER (NOT is_bot) AS valid_impressions, count(*) FILTER (is_bot) AS bot_impressions,
    count(DISTINCT campaign_id) AS campaigns, (SELECT count(*) FROM exposure_counts) AS sum_unique_panelists,
    count(DISTINCT panelist_id) FILTER (NOT is_bot) AS distinct_panelists FROM impressions""",
)
query(
    "e12_global_breakdowns",
    lambda v: imp.global_breakdowns(v.impressions),
    """SELECT 'device' AS section, device_type AS key, count(*) AS impressions FROM impressions WHERE NOT is_bot GROUP BY 2
    UNION ALL SELECT 'source', ingest_source, count(*) FROM impressions GROUP BY 2""",
)
query(
    "e13_status_counts",
    lambda v: imp.status_counts(v.responses),
    "SELECT status, count(*) AS n FROM responses GROUP BY 1",
)
query(
    "e13_campaign_activity",
    lambda v: imp.activity(v.campaigns),
    """SELECT count(*) AS total, count(*) FILTER (status = 'Active') AS active, count(*) FILTER (status = 'Completed') AS completed FROM campaigns""",
)
query(
    "e14_panelist_stats",
    lambda v: imp.panelist_stats(v.panelists),
    """SELECT count(*) AS total, count(*) FILTER (consent_given) AS consented, count(DISTINCT nullif(country, '')) AS countries,
    floor(avg(coalesce(points_balance, 0)) + 0.5)::bigint AS average_points FROM panelists""",
)
query(
    "e15_panelist_profile",
    lambda v: imp.panelist_profile(v.panelists),
    """SELECT 'gender' AS dimension, gender AS value, count(*) AS panelists FROM panelists GROUP BY 2 UNION ALL
    SELECT 'age_range', age_range, count(*) FROM panelists GROUP BY 2 UNION ALL SELECT 'country', country, count(*) FROM panelists GROUP BY 2""",
)
query(
    "e16_response_counts",
    lambda v: imp.response_counts(v.responses),
    "SELECT survey_id, cohort_type, count(*) AS responses FROM responses GROUP BY 1, 2",
)
query(
    "e17_survey_results",
    lambda v: surveys.question_results(v.surveys, v.responses).drop("question_text"),
    """SELECT s.survey_id, s.campaign_id, q.question_id, q.metric_name, CASE WHEN e IS NOT NULL AND c IS NOT NULL THEN e END AS exposed_mean,
      CASE WHEN e IS NOT NULL AND c IS NOT NULL THEN c END AS control_mean, CASE WHEN e IS NOT NULL AND c > 0 THEN (e - c) / c * 100 END AS lift_percent
    FROM surveys s CROSS JOIN (VALUES ('q1', 'brand_awareness'), ('q2', 'purchase_intent'), ('q3', 'brand_favorability'), ('q4', 'message_recall')) q(question_id, metric_name)
    LEFT JOIN (SELECT survey_id, question_id, avg(numeric_value) FILTER (cohort_type = 'exposed') AS e, avg(numeric_value) FILTER (cohort_type = 'control') AS c
      FROM answers GROUP BY 1, 2) a ON a.survey_id = s.survey_id AND a.question_id = q.question_id""",
    rounded="exposed_mean control_mean lift_percent",
)
query(
    "e17_survey_result_documents",
    lambda v: surveys.survey_results(v.surveys, v.responses).select(
        "survey_id", "campaign_id", "total_responses", "exposed_responses", "control_responses", "completed_responses",
        F.size("question_results").cast("bigint").alias("questions"),
        F.array_join(F.transform("question_results", lambda q: F.concat(q["question_id"], F.lit(":"), F.coalesce(
            F.array_join(F.transform(q["response_counts"], lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|"),
            F.lit("")))), ";").alias("counts")),
    """SELECT s.survey_id, s.campaign_id, coalesce(total, 0) AS total_responses, coalesce(e, 0) AS exposed_responses, coalesce(c, 0) AS control_responses,
      coalesce(d, 0) AS completed_responses, 4::bigint AS questions, (SELECT string_agg(q.question_id || ':' || coalesce(l.listed, ''), ';' ORDER BY q.question_id)
        FROM (VALUES ('q1'), ('q2'), ('q3'), ('q4')) q(question_id) LEFT JOIN (SELECT survey_id, question_id, string_agg(k || '=' || n, '|' ORDER BY k) AS listed
          FROM (SELECT survey_id, question_id, coalesce(answer, '') AS k, count(*) AS n FROM answers WHERE cohort_type = 'exposed' GROUP BY ALL) GROUP BY ALL) l
        ON l.survey_id = s.survey_id AND l.question_id = q.question_id) AS counts
    FROM surveys s LEFT JOIN (SELECT survey_id, count(*) AS total, count(*) FILTER (cohort_type = 'exposed') AS e, count(*) FILTER (cohort_type = 'control') AS c,
      count(*) FILTER (status = 'Completed') AS d FROM responses GROUP BY 1) r ON r.survey_id = s.survey_id""",
)
query(
    "e18_answer_counts",
    lambda v: surveys.answer_counts(v.surveys, v.responses),
    "SELECT survey_id, question_id, coalesce(answer, '') AS answer, count(*) AS n FROM answers WHERE cohort_type = 'exposed' GROUP BY 1, 2, 3",
)
MOMENTS = "exposed_value exposed_std_dev control_value control_std_dev"
query(
    "e19_cohort_moments",
    lambda v: lift.cohort_moments(v.joined, ["campaign_id", "metric_name"]),
    "SELECT * FROM moments", rounded=MOMENTS,
)
LIFT_COLS = ["campaign_id", "metric_name", *MOMENTS.split(), "exposed_sample_size", "control_sample_size", "lift_absolute",
             "lift_relative_pct", "t_statistic", "degrees_of_freedom", "p_value", "is_significant",
             "confidence_interval_lower", "confidence_interval_upper"]
LIFT_ROUNDED = MOMENTS + " lift_absolute lift_relative_pct t_statistic p_value confidence_interval_lower confidence_interval_upper"
P_EXACT = t_p_sql("t_statistic", "degrees_of_freedom")
query(
    "e20_lift_statistics",
    lambda v: lift.lift_statistics(lift.cohort_moments(v.joined, ["campaign_id", "metric_name"])).select(*LIFT_COLS),
    f"""SELECT {', '.join(LIFT_COLS)} FROM (SELECT * REPLACE ({P_EXACT} AS p_value, coalesce(({P_EXACT}) < 0.05, false) AS is_significant) FROM lift)""",
    rounded=LIFT_ROUNDED,
)
query(
    "e21_lift_results",
    lambda v: v.lift.select("campaign_id", "metric_name", "cohort_definition", "cohort_size_exposed", "cohort_size_control",
                            F.col("analysis_start_date").cast("string").alias("analysis_start_date"),
                            F.col("analysis_end_date").cast("string").alias("analysis_end_date"),
                            "measurement_window_days", "processing_job_id", "model_version", "statistical_test"),
    """SELECT campaign_id, metric_name, '{"batch_id":"psm_' || campaign_id || '_20240125_120000","matching_method":"propensity_score_matching","caliper":0.1}' AS cohort_definition,
    cohort_size_exposed, cohort_size_control, '2023-12-26' AS analysis_start_date, '2024-01-25' AS analysis_end_date, 30 AS measurement_window_days,
    'lift_' || campaign_id || '_20240125_120000' AS processing_job_id, 'v1.0' AS model_version, 't-test' AS statistical_test FROM lift""",
)
# twice the normal tail beyond |z|, by Simpson's rule over ten deviations
NORMAL_P = """(SELECT CASE WHEN {z} IS NOT NULL THEN least(1, sum(CASE WHEN i % 2000 = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
  * exp(-0.5 * (abs({z}) + i * 0.005::double) ** 2)) * 0.005::double / 3 * sqrt(2 / pi())) END FROM range(2001) r(i))"""
CHI_SQL = f"""WITH t AS (SELECT campaign_id, metric_name, count(*) FILTER (cohort_type = 'exposed' AND metric_value = 1) AS exposed_yes,
    count(*) FILTER (cohort_type = 'exposed' AND metric_value = 0) AS exposed_no, count(*) FILTER (cohort_type = 'control' AND metric_value = 1) AS control_yes,
    count(*) FILTER (cohort_type = 'control' AND metric_value = 0) AS control_no FROM joined GROUP BY ALL HAVING count(*) FILTER (metric_value NOT IN (0, 1)) = 0),
  s AS (SELECT *, exposed_yes + exposed_no AS e, control_yes + control_no AS c, exposed_yes + control_yes AS y, exposed_no + control_no AS n FROM t),
  x AS (SELECT *, (e + c) * (exposed_yes * control_no - exposed_no * control_yes)::double ** 2 / nullif(e::double * c * y * n, 0) AS chi_square FROM s),
  p AS (SELECT *, {NORMAL_P.format(z='sqrt(chi_square)')} AS p_value FROM x)
SELECT campaign_id, metric_name, exposed_yes, exposed_no, control_yes, control_no, chi_square, p_value, coalesce(p_value < 0.05, false) AS is_significant,
  'chi-square' AS statistical_test FROM p"""
RANK_SQL = f"""WITH r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY campaign_id, metric_name, metric_value) - 1) / 2.0::double AS midrank,
    count(*) OVER (PARTITION BY campaign_id, metric_name, metric_value) AS t FROM joined WINDOW w AS (PARTITION BY campaign_id, metric_name ORDER BY metric_value)),
  s AS (SELECT campaign_id, metric_name, count(*) FILTER (cohort_type = 'exposed') AS exposed_sample_size, count(*) FILTER (cohort_type = 'control') AS control_sample_size,
    coalesce(sum(midrank) FILTER (cohort_type = 'exposed'), 0) AS ranks, sum(t::double * t - 1) AS ties, count(*)::double AS n FROM r GROUP BY ALL),
  u AS (SELECT *, ranks - exposed_sample_size * (exposed_sample_size + 1) / 2.0::double AS u_statistic,
    exposed_sample_size * control_sample_size / 12.0::double * (n + 1 - CASE WHEN n > 1 THEN ties / (n * (n - 1)) END) AS v FROM s),
  z AS (SELECT *, CASE WHEN v > 0 THEN (u_statistic - exposed_sample_size * control_sample_size / 2.0::double) / sqrt(v) END AS z_statistic FROM u),
  p AS (SELECT *, {NORMAL_P.format(z='z_statistic')} AS p_value FROM z)
SELECT campaign_id, metric_name, exposed_sample_size, control_sample_size, u_statistic, z_statistic, p_value, coalesce(p_value < 0.05, false) AS is_significant,
  'mann-whitney' AS statistical_test FROM p"""
KEYS = ["campaign_id", "metric_name"]
query("m_chi_square", lambda v: significance.chi_square(v.joined, KEYS), CHI_SQL, rounded="chi_square p_value")
query("m_mann_whitney", lambda v: significance.mann_whitney(v.joined, KEYS), RANK_SQL, rounded="u_statistic z_statistic p_value")


def _by_test(v):
    """Lift rows under each of the three tests, in the layout of the lift table; the metric rows are written once for all three."""
    joined = cut(v.joined)
    statistics = lift.lift_statistics(lift.cohort_moments(joined, KEYS))
    batch = survey_rules.batch_id("psm", "campaign_id", v.now)
    others = [significance.with_test(statistics, test(joined, KEYS), KEYS) for test in (significance.chi_square, significance.mann_whitney)]
    names = ["campaign_id", "metric_name", "statistical_test", "p_value", "is_significant", "lift_absolute", "cohort_size_exposed", "processing_job_id"]
    parts = [lift.lift_results(s, batch, v.now).select(*names) for s in (statistics, *others)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


query(
    "e21_lift_results_by_test", _by_test,
    f"""WITH tests AS (SELECT campaign_id, metric_name, 't-test' AS statistical_test, {P_EXACT} AS p_value, coalesce(({P_EXACT}) < 0.05, false) AS is_significant FROM lift
      UNION ALL SELECT campaign_id, metric_name, statistical_test, p_value, is_significant FROM ({CHI_SQL})
      UNION ALL SELECT campaign_id, metric_name, statistical_test, p_value, is_significant FROM ({RANK_SQL}))
    SELECT campaign_id, metric_name, statistical_test, tests.p_value, tests.is_significant, lift_absolute, cohort_size_exposed,
      'lift_' || campaign_id || '_20240125_120000' AS processing_job_id FROM tests JOIN lift USING (campaign_id, metric_name)""",
    rounded="p_value lift_absolute",
)
Q_SQL = """WITH m AS (SELECT survey_id, campaign_id, question_id, metric_name, {arms} FROM answers GROUP BY 1, 2, 3, 4),
  r AS (SELECT *, round_even(er, 2) AS em, round_even(cr, 2) AS cm FROM m WHERE en > 0 AND cn > 0),
  d AS (SELECT *, round_even(sqrt(evp + (er - em) ** 2), 2) AS ed, round_even(sqrt(cvp + (cr - cm) ** 2), 2) AS cd,
    sqrt(((en - 1) * evs + (cn - 1) * cvs) / nullif(en + cn - 2, 0)) * sqrt(1.0 / en + 1.0 / cn) AS se FROM r),
  t AS (SELECT *, CASE WHEN en >= 2 AND cn >= 2 AND se > 0 THEN (er - cr) / se ELSE 0 END AS tt FROM d),
  p AS (SELECT *, CASE WHEN en < 2 OR cn < 2 THEN 1.0 WHEN abs(tt) > 2.576 THEN 0.001 WHEN abs(tt) > 1.96 THEN 0.01 WHEN abs(tt) > 1.645 THEN 0.05 ELSE 0.1 END::double AS p_value FROM t)
SELECT survey_id, campaign_id, question_id, metric_name, en AS exposed_n, cn AS control_n, em AS exposed_mean, cm AS control_mean,
  ed AS exposed_std_dev, cd AS control_std_dev, CASE WHEN en < 2 THEN em ELSE round_even(em - 1.96 * (ed / sqrt(en)), 2) END AS exposed_ci_lower,
  CASE WHEN en < 2 THEN em ELSE round_even(em + 1.96 * (ed / sqrt(en)), 2) END AS exposed_ci_upper,
  CASE WHEN cn < 2 THEN cm ELSE round_even(cm - 1.96 * (cd / sqrt(cn)), 2) END AS control_ci_lower,
  CASE WHEN cn < 2 THEN cm ELSE round_even(cm + 1.96 * (cd / sqrt(cn)), 2) END AS control_ci_upper,
  round_even(em - cm, 2) AS absolute_lift, CASE WHEN cm > 0 THEN round_even((em - cm) / cm * 100, 2) ELSE 0 END AS lift_pct,
  p_value, round_even(tt, 3) AS t_statistic, CASE WHEN en >= 2 AND cn >= 2 THEN en + cn - 2 END AS degrees_of_freedom,
  CASE metric_name WHEN 'brand_awareness' THEN 'Brand Awareness' WHEN 'purchase_intent' THEN 'Purchase Intent' ELSE 'Brand Favorability' END AS metric_display_name,
  p_value < 0.05 AS is_significant, CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE 'ns' END AS significance_level FROM p"""
_arms = ", ".join(
    f"avg(numeric_value) FILTER (cohort_type = '{c}') AS {k}r, var_pop(numeric_value) FILTER (cohort_type = '{c}') AS {k}vp, "
    f"var_samp(numeric_value) FILTER (cohort_type = '{c}') AS {k}vs, count(numeric_value) FILTER (cohort_type = '{c}') AS {k}n"
    for c, k in (("exposed", "e"), ("control", "c")))
query(
    "e22_lift_by_question",
    lambda v: lift.lift_by_question(v.answers),
    Q_SQL.format(arms=_arms),
    rounded="exposed_mean control_mean exposed_std_dev control_std_dev exposed_ci_lower exposed_ci_upper control_ci_lower control_ci_upper absolute_lift lift_pct t_statistic",
)
query(
    "e23_lift_by_metric",
    lambda v: lift.lift_by_metric(v.lift),
    "SELECT metric_name, avg(lift_relative_pct) AS average_lift, count(*) FILTER (is_significant) AS significant, count(*) AS measurements FROM lift GROUP BY 1",
    rounded="average_lift",
)
query(
    "e23_lift_overall",
    lambda v: lift.lift_overall(v.lift),
    "SELECT avg(lift_relative_pct) AS average_lift, count(*) FILTER (is_significant) AS significant, count(*) AS measurements FROM lift",
    rounded="average_lift",
)
query(
    "e24_bi_measures",
    lambda v: report.bi_measures(v.lift, v.impressions),
    """SELECT * FROM (SELECT count(DISTINCT campaign_id) AS campaigns, avg(lift_relative_pct) AS average_lift_pct, count(*) FILTER (is_significant) AS significant_lifts,
    coalesce(count(*) FILTER (is_significant) / nullif(count(*), 0), 0)::double AS significance_rate,
    coalesce(sum(lift_relative_pct * cohort_size_exposed) / nullif(sum(cohort_size_exposed), 0), 0) AS weighted_average_lift,
    avg(confidence_interval_upper - confidence_interval_lower) AS ci_width FROM lift),
    (SELECT count(*) AS total_impressions, count(DISTINCT panelist_id) AS unique_panelists FROM impressions)""",
    rounded="average_lift_pct significance_rate weighted_average_lift ci_width",
)
query(
    "e25_metric_lift",
    lambda v: report.metric_lift(v.lift, ("brand_favorability", "brand_awareness", "purchase_intent")),
    """SELECT avg(lift_relative_pct) FILTER (metric_name = 'brand_favorability') AS brand_favorability_lift,
    avg(lift_relative_pct) FILTER (metric_name = 'brand_awareness') AS brand_awareness_lift,
    avg(lift_relative_pct) FILTER (metric_name = 'purchase_intent') AS purchase_intent_lift FROM lift""",
    rounded="brand_favorability_lift brand_awareness_lift purchase_intent_lift",
)
query(
    "e26_lift_results_agg",
    lambda v: report.lift_results_agg(v.lift),
    """SELECT campaign_id, metric_name, avg(lift_relative_pct) AS avg_lift, count(*) AS measurement_count,
    count(*) FILTER (is_significant) AS significant_count FROM lift GROUP BY 1, 2""",
    rounded="avg_lift",
)
query(
    "e27_metric_chart",
    lambda v: report.metric_chart(v.lift),
    """SELECT metric_name, avg(lift_relative_pct) AS average_lift, avg(exposed_value) AS average_exposed, avg(control_value) AS average_control,
    bool_or(is_significant) AS any_significant FROM lift GROUP BY 1""",
    rounded="average_lift average_exposed average_control",
)
query(
    "e28_time_drill",
    lambda v: report.time_drill(v.impressions, "timestamp_utc"),
    """SELECT campaign_id, y AS year, q AS quarter, m AS month, d AS day, count(*) AS impressions FROM (SELECT campaign_id, year(timestamp_utc)::int AS y,
    quarter(timestamp_utc)::int AS q, month(timestamp_utc)::int AS m, day(timestamp_utc)::int AS d FROM impressions)
    GROUP BY GROUPING SETS ((campaign_id, y), (campaign_id, y, q), (campaign_id, y, q, m), (campaign_id, y, q, m, d))""",
)
query(
    "e29_lift_histogram",
    lambda v: report.lift_histogram(v.lift.withColumn("lift_relative_pct", F.round("lift_relative_pct", 6))),
    """WITH r AS (SELECT round(lift_relative_pct, 6) AS lift_relative_pct FROM lift), b AS (SELECT min(lift_relative_pct) AS low, max(lift_relative_pct) AS high FROM r)
    SELECT bin, low + (bin - 1) * ((high - low) / 10) AS bin_low, low + bin * ((high - low) / 10) AS bin_high, count(*) AS n FROM
    (SELECT low, high, least(floor((lift_relative_pct - low) / ((high - low) / 10)) + 1, 10)::int AS bin FROM r, b WHERE lift_relative_pct IS NOT NULL) GROUP BY bin, low, high""",
    rounded="bin_low bin_high",
)
query(
    "e30_scatter_feed",
    lambda v: report.scatter_feed(v.lift),
    "SELECT campaign_id, metric_name, cohort_size_exposed, p_value, abs(lift_relative_pct) AS lift_magnitude, is_significant FROM lift",
    rounded="lift_magnitude",
)
query(
    "e30_ci_feed",
    lambda v: report.ci_feed(v.lift),
    """SELECT metric_name, avg(lift_absolute) AS lift_absolute, avg(confidence_interval_lower) AS ci_lower, avg(confidence_interval_upper) AS ci_upper
    FROM lift GROUP BY 1""",
    rounded="lift_absolute ci_lower ci_upper",
)
query(
    "e31_sample_sizes",
    lambda v: report.sample_sizes(v.lift),
    """SELECT sum(cohort_size_exposed)::bigint AS exposed_total, sum(cohort_size_control)::bigint AS control_total,
    sum(cohort_size_control) / sum(cohort_size_exposed)::double AS match_ratio FROM lift""",
    rounded="match_ratio",
)
SEG_SQL = """WITH s AS (SELECT j.*, p.device_type, p.country, p.age_range, p.gender, p.hh_income_bucket AS income_bucket FROM joined j JOIN panelists p ON p.panelist_id = j.panelist_id),
  m AS (SELECT campaign_id, metric_name, device_type, country, age_range, gender, income_bucket,
    CASE grouping(device_type, country, gender) WHEN 3 THEN 'device_type' WHEN 5 THEN 'country' ELSE 'age_range x gender x income_bucket' END AS segmentation,
    avg(metric_value) FILTER (cohort_type = 'exposed') AS exposed_value, avg(metric_value) FILTER (cohort_type = 'control') AS control_value,
    count(metric_value) FILTER (cohort_type = 'exposed') AS exposed_sample_size, count(metric_value) FILTER (cohort_type = 'control') AS control_sample_size,
    stddev_samp(metric_value) FILTER (cohort_type = 'exposed') AS es, stddev_samp(metric_value) FILTER (cohort_type = 'control') AS cs
    FROM s GROUP BY GROUPING SETS ((campaign_id, metric_name, device_type), (campaign_id, metric_name, country), (campaign_id, metric_name, age_range, gender, income_bucket))),
  t AS (SELECT *, exposed_value - control_value AS lift_absolute, (exposed_value - control_value) / nullif(sqrt(((exposed_sample_size - 1) * es ** 2 + (control_sample_size - 1) * cs ** 2)
    / nullif(exposed_sample_size + control_sample_size - 2, 0) * (1.0 / nullif(exposed_sample_size, 0) + 1.0 / nullif(control_sample_size, 0))), 0) AS t_statistic FROM m)
SELECT campaign_id, metric_name, device_type, country, age_range, gender, income_bucket, segmentation, exposed_value, control_value, exposed_sample_size,
  control_sample_size, lift_absolute, CASE WHEN control_value > 0 THEN lift_absolute / control_value * 100 ELSE 0 END AS lift_relative_pct, t_statistic,
  coalesce(CASE WHEN t_statistic IS NOT NULL THEN abs(t_statistic) > 1.96 END, false) AS is_significant FROM t"""
query(
    "e32_segment_lift",
    lambda v: lift.segment_lift(lift.segmented_metrics(v.joined, v.panelists), p_rule="step").select(
        "campaign_id", "metric_name", "device_type", "country", "age_range", "gender", "income_bucket", "segmentation",
        "exposed_value", "control_value", "exposed_sample_size", "control_sample_size", "lift_absolute",
        "lift_relative_pct", "t_statistic", "is_significant"),
    SEG_SQL, rounded="exposed_value control_value lift_absolute lift_relative_pct t_statistic",
)


def _encoded(v):
    return matching.encode_features(matching.fill_features(v.scored))


def _balance(v):
    df = _encoded(v)
    return matching.balance(df, cut(matching.match(df, CALIPER)))


def _smd_sql(source: str, name: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT campaign_id, '{f}' AS feature, CASE WHEN sqrt((ve + vc) / 2) > 0 THEN (me - mc) / sqrt((ve + vc) / 2) WHEN sqrt((ve + vc) / 2) = 0 AND me = mc THEN 0 END AS {name}
        FROM (SELECT campaign_id, avg({f}) FILTER (exposed = 1) AS me, avg({f}) FILTER (exposed = 0) AS mc, var_samp({f}) FILTER (exposed = 1) AS ve,
        var_samp({f}) FILTER (exposed = 0) AS vc FROM {source} GROUP BY 1)""" for f in matching.FEATURES)


BALANCE_SQL = f"""SELECT b.campaign_id, b.feature, b.smd_before, a.smd_after, abs(b.smd_before) - abs(a.smd_after) AS improvement,
  coalesce(abs(a.smd_after) < 0.1, false) AS balanced FROM ({_smd_sql('features', 'smd_before')}) b LEFT JOIN (
  {_smd_sql('''(SELECT * FROM features f WHERE EXISTS (SELECT 1 FROM pairs p WHERE p.campaign_id = f.campaign_id AND ((f.exposed = 1 AND p.exposed_id = f.panelist_id)
  OR (f.exposed = 0 AND p.control_id = f.panelist_id))))''', 'smd_after')}) a ON a.campaign_id = b.campaign_id AND a.feature = b.feature"""
query("e33_balance", _balance, BALANCE_SQL, rounded="smd_before smd_after improvement")
query(
    "e34_balance_score",
    lambda v: matching.balance_score(_balance(v)),
    f"""SELECT campaign_id, count(*) FILTER (balanced) AS balanced_features, count(*) AS features, count(*) FILTER (balanced) / count(*)::double AS balance_score
    FROM ({BALANCE_SQL}) GROUP BY 1""",
    rounded="balance_score",
)


def _psm_summary(v):
    df = _encoded(v)
    pairs = cut(matching.match(df, CALIPER))
    scores = matching.balance_score(matching.balance(df, pairs))
    return matching.psm_summary(df, pairs, scores, CALIPER, v.now).withColumn("run_timestamp", stamp("run_timestamp"))


query(
    "e35_psm_summary", _psm_summary,
    f"""SELECT s.campaign_id, 'psm_' || s.campaign_id || '_20240125_120000' AS batch_id, total_exposed, total_control, coalesce(n, 0) AS matched_pairs,
    coalesce(n / nullif(total_exposed, 0)::double, 0) AS match_rate, balance_score, {CALIPER}::double AS caliper_width, '{NOW}.000000' AS run_timestamp
    FROM (SELECT campaign_id, count(*) FILTER (exposed = 1) AS total_exposed, count(*) FILTER (exposed = 0) AS total_control FROM scored GROUP BY 1) s
    LEFT JOIN (SELECT campaign_id, count(*) AS n FROM pairs GROUP BY 1) p ON p.campaign_id = s.campaign_id
    LEFT JOIN (SELECT campaign_id, count(*) FILTER (balanced) / count(*)::double AS balance_score FROM ({BALANCE_SQL}) GROUP BY 1) b ON b.campaign_id = s.campaign_id""",
    rounded="match_rate balance_score",
)
query(
    "e36_score_profile",
    lambda v: matching.score_profile(v.scored),
    """SELECT campaign_id, exposed, count(propensity_score) AS n, avg(propensity_score) AS mean, stddev_samp(propensity_score) AS stddev,
    min(propensity_score) AS min, max(propensity_score) AS max FROM scored GROUP BY 1, 2""",
    rounded="mean stddev",
)
query(
    "e37_session_summary",
    lambda v: imp.session_summary(v.events.select(
        F.when(F.col("s2s_flag"), "s2s").otherwise("pixel").alias("kind"), (F.col("seq") % 9 != 0).alias("success"),
        F.col("event_value").alias("latency_ms"))),
    """SELECT count(*) AS total, count(*) FILTER (NOT s2s_flag) AS pixel, count(*) FILTER (s2s_flag) AS s2s, count(*) FILTER (seq % 9 = 0) AS errors,
    avg(event_value) FILTER (seq % 9 <> 0) AS average_latency_ms FROM raw_events""",
    rounded="average_latency_ms",
)
ACTUALS_SQL = """SELECT t.campaign_id, impressions, reach, average_lift FROM (SELECT campaign_id, count(*) FILTER (NOT is_bot) AS impressions,
  count(DISTINCT CASE WHEN NOT is_bot THEN panelist_id END) AS reach FROM impressions GROUP BY 1) t
  LEFT JOIN (SELECT campaign_id, avg(lift_relative_pct) AS average_lift FROM lift GROUP BY 1) l ON l.campaign_id = t.campaign_id"""
# The shared view name "impressions" is also a column here, so the alias is quoted in the twin.
query("e38_campaign_actuals", lambda v: imp.campaign_actuals(v.impressions, v.lift), ACTUALS_SQL, rounded="average_lift")
query(
    "e39_common_support",
    lambda v: matching.common_support(v.scored),
    """WITH b AS (SELECT campaign_id, greatest(min(propensity_score) FILTER (exposed = 1), min(propensity_score) FILTER (exposed = 0)) AS low,
      least(max(propensity_score) FILTER (exposed = 1), max(propensity_score) FILTER (exposed = 0)) AS high FROM scored GROUP BY 1)
    SELECT s.campaign_id, count(*) AS panelists, count(*) FILTER (propensity_score BETWEEN low AND high) AS in_support,
    count(*) FILTER (propensity_score BETWEEN low AND high) / count(*)::double * 100 AS common_support_pct FROM scored s JOIN b ON b.campaign_id = s.campaign_id GROUP BY 1""",
    rounded="common_support_pct",
)
query(
    "e40_ops_counts",
    lambda v: imp.ops_counts(v.impressions).withColumn("window_start", stamp("window_start")),
    f"""SELECT {ts("date_trunc('hour', timestamp_utc)")} AS window_start, campaign_id, ingest_source, count(*) AS events, count(*) FILTER (is_bot) AS bots
    FROM impressions GROUP BY 1, 2, 3""",
)

# ---- F, G: ranks, pages, heads ----------------------------------------------------------------

query(
    "f01_nearest_control",
    lambda v: matching.match(v.scored, CALIPER).select("campaign_id", "exposed_id", "control_id", "match_rank"),
    "SELECT campaign_id, exposed_id, control_id, match_rank::int AS match_rank FROM pairs",
)
query(
    "f01_three_nearest_controls",
    lambda v: matching.match(v.scored, CALIPER, 3).select("campaign_id", "exposed_id", "control_id", "match_rank"),
    f"""SELECT campaign_id, exposed_id, control_id, r::int AS match_rank FROM (SELECT e.campaign_id, e.panelist_id AS exposed_id, c.panelist_id AS control_id,
    row_number() OVER (PARTITION BY e.campaign_id, e.panelist_id ORDER BY abs(e.propensity_score - c.propensity_score), c.panelist_id) AS r
    FROM scored e JOIN scored c ON e.campaign_id = c.campaign_id AND e.exposed = 1 AND c.exposed = 0 AND abs(e.propensity_score - c.propensity_score) <= {CALIPER}) WHERE r <= 3""",
)
query(
    "f08_page",
    lambda v: tables.page(v.impressions, 7, 25, [F.desc("timestamp_utc"), "impression_id"]).select("impression_id", "page", "page_count"),
    """SELECT impression_id, 7 AS page, (SELECT ceil(count(*) / 25)::int FROM impressions) AS page_count FROM impressions
    ORDER BY timestamp_utc DESC, impression_id LIMIT 25 OFFSET 150""",
)
query(
    "f08_last_page",
    lambda v: tables.page(v.impressions, 1_000_000_000, 25, [F.desc("timestamp_utc"), "impression_id"]).select("impression_id", "page", "page_count"),
    """WITH n AS (SELECT impression_id, row_number() OVER (ORDER BY timestamp_utc DESC, impression_id) AS r, ceil(count(*) OVER () / 25)::int AS page_count FROM impressions)
    SELECT impression_id, page_count AS page, page_count FROM n WHERE r > (page_count - 1) * 25""",
)
MATCH_ID_SQL = "'match_' || substr(sha256(concat_ws(chr(1), campaign_id, exposed_id, control_id)), 1, 32)"
query(
    "f09_match_id",
    lambda v: matching.match(v.scored, CALIPER).select("campaign_id", "exposed_id", "control_id", "match_id"),
    f"SELECT campaign_id, exposed_id, control_id, {MATCH_ID_SQL} AS match_id FROM pairs",
)


def _runs(v):
    older = v.lift.withColumns({
        "run_ts": F.col("run_ts") - F.expr("INTERVAL 1 DAY"), "lift_absolute": F.col("lift_absolute") - 1})
    return v.lift.unionByName(older)


query(
    "f10_latest_runs",
    lambda v: lift.latest_runs(_runs(v)).select("campaign_id", "metric_name", "lift_absolute", stamp("run_ts").alias("run_ts")),
    f"SELECT campaign_id, metric_name, lift_absolute, '{NOW}.000000' AS run_ts FROM lift", rounded="lift_absolute",
)
query(
    "f11_top_creative",
    lambda v: imp.top_creative(v.impressions),
    """SELECT campaign_id, creative_id, n AS impressions FROM (SELECT campaign_id, creative_id, count(*) AS n FROM impressions WHERE NOT is_bot GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY campaign_id ORDER BY n DESC, creative_id) = 1""",
)
query(
    "g01_newest_of_campaign",
    lambda v: tables.newest_impressions(v.impressions, CAMPAIGN).select("impression_id", stamp("timestamp_utc").alias("at")),
    f"SELECT impression_id, {ts('timestamp_utc')} AS at FROM impressions WHERE campaign_id = '{CAMPAIGN}' ORDER BY timestamp_utc DESC, impression_id LIMIT 100",
)
query(
    "g01_newest_of_all",
    lambda v: tables.newest_impressions(v.impressions).select("impression_id", stamp("timestamp_utc").alias("at")),
    f"SELECT impression_id, {ts('timestamp_utc')} AS at FROM impressions ORDER BY timestamp_utc DESC, impression_id LIMIT 500",
)
def _placed(ordered, group):
    """The place of each row among the rows of its group, as the ordered rows come out."""
    numbered = ordered.withColumns({"_at": F.monotonically_increasing_id(), "_group": group})
    return numbered.withColumn("place", F.row_number().over(Window.partitionBy("_group").orderBy("_at")).cast("bigint"))


query(
    "g02_newest_first",
    lambda v: _placed(tables.newest_first(v.campaigns, "campaign_id"), F.date_format("created_at", "yyyy-MM")).select(
        "campaign_id", stamp("created_at").alias("created_at"), "place"),
    f"""SELECT campaign_id, {ts('created_at')} AS created_at,
    row_number() OVER (PARTITION BY strftime(created_at, '%Y-%m') ORDER BY created_at DESC, campaign_id) AS place FROM campaigns""",
)
query(
    "g03_top_five_campaigns",
    lambda v: tables.head_n(imp.impression_totals(v.impressions), [F.desc("total_impressions"), "campaign_id"], 5).select("campaign_id", "total_impressions"),
    "SELECT campaign_id, count(*) AS total_impressions FROM impressions GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
)
query(
    "g04_balance_report",
    lambda v: _placed(matching.balance_report(_balance(v)), F.col("campaign_id")).select(
        "campaign_id", F.round(F.abs("smd_after"), 6).alias("size"), "place"),
    f"""SELECT campaign_id, round(abs(smd_after), 6) AS size, row_number() OVER (PARTITION BY campaign_id ORDER BY abs(smd_after) DESC) AS place
    FROM ({BALANCE_SQL})""",
)
query(
    "g05_lift_report",
    lambda v: _placed(lift.lift_report(v.lift), F.col("metric_name")).select("metric_name", "lift_relative_pct", "place"),
    """SELECT metric_name, lift_relative_pct, row_number() OVER (PARTITION BY metric_name ORDER BY lift_relative_pct DESC) AS place FROM lift""",
    rounded="lift_relative_pct",
)
query(
    "g06_ordered_hours",
    lambda v: tables.ordered_hours(imp.all_summaries(v.impressions, with_hours=True)).select(
        "campaign_id", F.array_join(F.transform("hours", lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|").alias("hours")),
    """SELECT campaign_id, string_agg(h || '=' || n, '|' ORDER BY h) AS hours FROM (SELECT campaign_id, strftime(timestamp_utc, '%Y-%m-%d %H:00') AS h,
    count(*) AS n FROM impressions WHERE NOT is_bot GROUP BY 1, 2) GROUP BY 1""",
)
query(
    "g07_first_page_of_active",
    lambda v: tables.first_page(tables.active_panelists(v.panelists), "panelist_id").select("panelist_id"),
    "SELECT panelist_id FROM panelists WHERE is_active ORDER BY panelist_id LIMIT 100",
)

# ---- J: change application --------------------------------------------------------------------

query(
    "j01_insert_new",
    lambda v: changes.insert_new(
        v.impressions.filter(F.col("creative_id") == "cr_0").select("panelist_id", "campaign_id", "impression_id", "timestamp_utc"),
        v.impressions.select("panelist_id", F.lit("new").alias("campaign_id"), F.substring_index("impression_id", "0", 1).alias("impression_id"), "timestamp_utc"),
        "impression_id", ["timestamp_utc", "panelist_id"]).withColumn("timestamp_utc", stamp("timestamp_utc")),
    f"""WITH t AS (SELECT panelist_id, campaign_id, impression_id, timestamp_utc FROM impressions WHERE creative_id = 'cr_0'),
    f AS (SELECT panelist_id, 'new' AS campaign_id, split_part(impression_id, '0', 1) AS impression_id, timestamp_utc FROM impressions)
    SELECT * REPLACE ({ts('timestamp_utc')} AS timestamp_utc) FROM (SELECT * FROM t UNION ALL (SELECT * FROM f WHERE impression_id NOT IN (SELECT impression_id FROM t)
    QUALIFY row_number() OVER (PARTITION BY impression_id ORDER BY timestamp_utc, panelist_id) = 1))""",
)
query(
    "j02_upsert_latest",
    lambda v: changes.upsert_latest(
        v.panelists.select("panelist_id", F.lit(None).cast("timestamp").alias("last_seen"), F.lit(None).cast("string").alias("last_campaign")),
        v.impressions.select("panelist_id", F.col("timestamp_utc").alias("last_seen"), F.col("campaign_id").alias("last_campaign")),
        "panelist_id", ["last_seen", "last_campaign"]).withColumn("last_seen", stamp("last_seen")),
    f"""SELECT panelist_id, {ts('last_seen')} AS last_seen, last_campaign FROM (SELECT p.panelist_id, i.timestamp_utc AS last_seen, i.campaign_id AS last_campaign FROM panelists p
    LEFT JOIN (SELECT * FROM impressions QUALIFY row_number() OVER (PARTITION BY panelist_id ORDER BY timestamp_utc DESC, campaign_id DESC) = 1) i ON i.panelist_id = p.panelist_id)""",
)
query(
    "j03_create_panelists",
    lambda v: changes.create_panelists(v.registrations, v.now).select(
        "panelist_id", "hashed_email", "hashed_phone", "age_range", "consent_given", stamp("consent_timestamp").alias("consent_timestamp"),
        "points_balance", "is_active", stamp("created_at").alias("created_at")),
    f"""SELECT panelist_id, hashed_email, hashed_phone, age_range, consent_given, CASE WHEN consent_given THEN '{NOW}.000000' END AS consent_timestamp,
    0 AS points_balance, true AS is_active, '{NOW}.000000' AS created_at FROM panelists""",
)


def _panelist_patches(v):
    return v.table("orders").select(
        F.col("o_custkey").cast("string").alias("panelist_id"), F.col("o_orderkey").alias("change_seq"),
        F.when(F.expr("o_orderkey % 3 = 0"), F.concat(F.lit("New"), F.col("o_orderkey").cast("string"), F.lit("@x.example"))).alias("email"),
        F.when(F.expr("o_orderkey % 5 = 0"), F.lit("555 0100")).alias("phone"),
        F.when(F.expr("o_orderkey % 2 = 0"), (F.lit(20) + F.col("o_orderkey") % 50).cast("int")).alias("age"),
        F.when(F.expr("o_orderkey % 7 = 0"), F.lit("55-64")).alias("age_range"),
        *[F.lit(None).cast(t).alias(n) for n, t in (
            ("first_name", "string"), ("last_name", "string"), ("gender", "string"), ("hh_income_bucket", "string"),
            ("interests", "string"), ("postal_code", "string"), ("device_type", "string"), ("browser", "string"),
            ("consent_ccpa", "boolean"), ("consent_given", "boolean"), ("is_active", "boolean"))],
        F.when(F.expr("o_orderkey % 4 = 0"), F.lit("UK")).alias("country"),
        F.when(F.expr("o_orderkey % 6 = 0"), F.expr("o_orderkey % 12 = 0")).alias("consent_gdpr"),
        F.when(F.expr("o_orderkey % 9 = 0"), F.lit(7)).alias("points_balance"),
    )


query(
    "j04_update_panelists",
    lambda v: changes.update_panelists(v.panelists, _panelist_patches(v), F.lit("2024-02-01 00:00:00").cast("timestamp")).select(
        "panelist_id", "email", "hashed_email", "hashed_phone", "age", "age_range", "country", "consent_gdpr", "points_balance",
        stamp("consent_timestamp").alias("consent_timestamp"), stamp("updated_at").alias("updated_at")),
    f"""WITH c AS (SELECT o_custkey::varchar AS pid, o_orderkey AS k FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
    SELECT panelist_id, CASE WHEN k % 3 = 0 THEN 'New' || k || '@x.example' ELSE email END AS email,
      CASE WHEN k % 3 = 0 THEN sha256('new' || k || '@x.example') ELSE hashed_email END AS hashed_email,
      CASE WHEN k % 5 = 0 THEN sha256('5550100') ELSE hashed_phone END AS hashed_phone, CASE WHEN k % 2 = 0 THEN (20 + k % 50)::int ELSE p.age END AS age,
      CASE WHEN k % 7 = 0 THEN '55-64' WHEN k % 2 = 0 THEN (SELECT {AGE_RANGE} FROM (SELECT (20 + k % 50) AS age)) ELSE age_range END AS age_range,
      CASE WHEN k % 4 = 0 THEN 'UK' ELSE country END AS country, CASE WHEN k % 6 = 0 THEN k % 12 = 0 ELSE consent_gdpr END AS consent_gdpr,
      CASE WHEN k % 9 = 0 THEN 7 ELSE points_balance END AS points_balance,
      CASE WHEN k % 12 = 0 THEN '2024-02-01 00:00:00.000000' WHEN consent_given THEN '{NOW}.000000' END AS consent_timestamp,
      CASE WHEN k IS NULL THEN '{NOW}.000000' ELSE '2024-02-01 00:00:00.000000' END AS updated_at
    FROM panelists p LEFT JOIN c ON c.pid = p.panelist_id""",
)
query(
    "j05_soft_delete",
    lambda v: changes.soft_delete(v.panelists, v.table("orders").filter("o_totalprice > 450000").select(
        F.col("o_custkey").cast("string").alias("panelist_id")), F.lit("2024-02-01 00:00:00").cast("timestamp")).select(
        "panelist_id", "is_active", stamp("updated_at").alias("updated_at")),
    f"""SELECT panelist_id, is_active AND g IS NULL AS is_active, CASE WHEN g IS NULL THEN '{NOW}.000000' ELSE '2024-02-01 00:00:00.000000' END AS updated_at
    FROM panelists LEFT JOIN (SELECT DISTINCT o_custkey::varchar AS g FROM orders WHERE o_totalprice > 450000) ON g = panelist_id""",
)


def _campaign_patches(v):
    return v.table("lineitem").select(
        F.concat(F.lit("camp_"), F.col("l_partkey").cast("string")).alias("campaign_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("change_seq"),
        F.when(F.expr("l_orderkey % 3 = 0"), "").when(F.expr("l_orderkey % 3 = 1"), F.concat(F.lit("N"), F.col("l_orderkey").cast("string"))).alias("campaign_name"),
        F.when(F.expr("l_orderkey % 5 = 0"), "Paused").alias("status"),
        F.when(F.expr("l_orderkey % 2 = 0"), F.expr("cast(l_orderkey as decimal(18,2))")).alias("budget"),
        F.when(F.expr("l_orderkey % 4 = 0"), F.array().cast(schemas.CREATIVES)).alias("creatives"),
    )


query(
    "j06_create_campaigns",
    lambda v: changes.create_campaigns(v.campaigns.drop("status", "created_at", "updated_at"), F.lit("2024-01-16 00:00:00").cast("timestamp")).select(
        "campaign_id", "status", stamp("created_at").alias("created_at"), stamp("updated_at").alias("updated_at")),
    """SELECT campaign_id, CASE WHEN timestamp '2024-01-16' < start_date THEN 'Scheduled' WHEN timestamp '2024-01-16' <= end_date THEN 'Active'
    ELSE 'Completed' END AS status, '2024-01-16 00:00:00.000000' AS created_at, '2024-01-16 00:00:00.000000' AS updated_at FROM campaigns""",
)
query(
    "j06_campaign_changes",
    lambda v: changes.apply_campaign_changes(v.campaigns, _campaign_patches(v), F.lit("2024-02-01 00:00:00").cast("timestamp")).select(
        "campaign_id", "campaign_name", "status", F.col("budget").cast("double").alias("budget"),
        F.size("creatives").cast("bigint").alias("creatives"), stamp("updated_at").alias("updated_at")),
    f"""WITH c AS (SELECT l_partkey AS pk, l_orderkey AS k FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber DESC) = 1)
    SELECT campaign_id, CASE WHEN k % 3 = 1 THEN 'N' || k ELSE campaign_name END AS campaign_name, CASE WHEN k % 5 = 0 THEN 'Paused' ELSE status END AS status,
    CASE WHEN k % 2 = 0 THEN k ELSE budget END::double AS budget, 1::bigint AS creatives,
    CASE WHEN k IS NULL THEN {ts('created_at')} ELSE '2024-02-01 00:00:00.000000' END AS updated_at FROM campaigns LEFT JOIN c ON pk = partkey""",
)
query(
    "j07_delete_campaigns",
    lambda v: changes.delete_rows(v.campaigns, v.table("part").filter("p_size > 25").select(
        F.concat(F.lit("camp_"), F.col("p_partkey").cast("string")).alias("campaign_id")), "campaign_id").select("campaign_id"),
    "SELECT concat('camp_', p_partkey) AS campaign_id FROM part WHERE p_size <= 25",
)


def _invited(v):
    return surveys.invite(v.surveys, _requests(v), v.responses, v.exposure_counts, v.now)


INVITE_SQL = f"""WITH r AS (SELECT survey_id, panelist_id, min(cohort_type) AS cohort_type FROM ({REQUESTS_SQL}) GROUP BY 1, 2),
  j AS (SELECT r.survey_id, r.panelist_id, s.campaign_id, coalesce(r.cohort_type, 'exposed') AS cohort_type,
    CASE WHEN s.status IS NULL THEN 'SurveyNotFound' WHEN s.status <> 'Active' THEN 'SurveyNotActive'
    WHEN EXISTS (SELECT 1 FROM responses x WHERE x.survey_id = r.survey_id AND x.panelist_id = r.panelist_id) THEN 'AlreadyResponded' ELSE 'Triggered' END AS outcome
    FROM r LEFT JOIN surveys s ON s.survey_id = r.survey_id)"""
query(
    "j08_invite",
    lambda v: _invited(v).select("survey_id", "campaign_id", "panelist_id", "cohort_type", "outcome", "status", "impression_count"),
    f"""SELECT * FROM ({INVITE_SQL} SELECT j.survey_id, j.campaign_id, j.panelist_id, j.cohort_type, j.outcome, CASE WHEN outcome = 'Triggered' THEN 'Pending' END AS status,
    CASE WHEN outcome = 'Triggered' THEN e.impression_count END::int AS impression_count FROM j
    LEFT JOIN exposure_counts e ON e.campaign_id = j.campaign_id AND e.panelist_id = j.panelist_id)""",
)
query(
    "j08_invite_totals",
    lambda v: surveys.invite_totals(_invited(v)),
    f"""SELECT * FROM ({INVITE_SQL} SELECT survey_id, count(*) FILTER (outcome = 'Triggered') AS total_triggered,
    count(*) FILTER (outcome <> 'Triggered') AS total_skipped FROM j GROUP BY 1)""",
)


def _submissions(v):
    return v.table("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("submission_id"),
        F.when(F.expr("l_linenumber % 3 = 0"), F.lit(None)).when(
            F.expr("l_linenumber % 3 = 1"), F.concat(F.lit("resp_"), F.col("l_orderkey").cast("string"))).otherwise(
            F.concat(F.lit("gone_"), F.col("l_orderkey").cast("string"))).alias("pending_response_id"),
        F.concat(F.lit("survey_"), (F.col("l_orderkey") % 20).cast("string")).alias("survey_id"),
        F.col("l_suppkey").cast("string").alias("panelist_id"), F.lit("an answer").alias("answers"),
        F.lit(9).alias("response_time"), F.lit("Mobile").alias("device_type"),
    )


query(
    "j09_complete_responses",
    lambda v: surveys.complete_responses(
        v.responses, _submissions(v).groupBy("submission_id").agg(*[
            F.min(c).alias(c) for c in ("pending_response_id", "survey_id", "panelist_id", "answers", "response_time", "device_type")]),
        v.surveys, v.now).select("submission_id", "outcome", "survey_id", "panelist_id", "cohort_type", "status"),
    """WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS submission_id, l_linenumber % 3 AS m, min(l_orderkey) AS ok, min(l_suppkey::varchar) AS panelist_id FROM lineitem GROUP BY 1, 2),
    f AS (SELECT ok, min(submission_id) AS first FROM s WHERE m = 1 GROUP BY 1),
    j AS (SELECT s.*, r.status AS st, r.cohort_type AS ct, r.panelist_id AS rp, r.survey_id AS rs, f.first, concat('survey_', s.ok % 20) AS sid FROM s
      LEFT JOIN responses r ON s.m = 1 AND r.orderkey = s.ok LEFT JOIN f ON s.m = 1 AND f.ok = s.ok),
    o AS (SELECT *, CASE WHEN st IS NULL THEN 'created' WHEN st = 'Completed' OR submission_id <> first THEN 'already_completed' ELSE 'completed' END AS outcome FROM j)
    SELECT submission_id, outcome, CASE outcome WHEN 'completed' THEN rs ELSE sid END AS survey_id, CASE outcome WHEN 'completed' THEN rp ELSE panelist_id END AS panelist_id,
    CASE outcome WHEN 'completed' THEN ct END AS cohort_type, CASE WHEN outcome <> 'already_completed' THEN 'Completed' END AS status FROM o""",
)
query(
    "j10_set_survey_status",
    lambda v: changes.set_status(v.surveys, v.table("lineitem").select(
        F.concat(F.lit("survey_"), F.col("l_partkey").cast("string")).alias("survey_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("change_seq"),
        F.concat(F.lit("S"), (F.col("l_orderkey") % 3).cast("string")).alias("status")), "survey_id",
        F.lit("2024-02-01 00:00:00").cast("timestamp")).select("survey_id", "status", stamp("updated_at").alias("updated_at")),
    f"""WITH c AS (SELECT l_partkey AS pk, l_orderkey AS k FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber DESC) = 1)
    SELECT survey_id, CASE WHEN k IS NULL THEN status ELSE 'S' || k % 3 END AS status, CASE WHEN k IS NULL THEN {ts('created_at')} ELSE '2024-02-01 00:00:00.000000' END AS updated_at
    FROM surveys LEFT JOIN c ON pk = partkey""",
)
query(
    "j11_write_actuals",
    lambda v: changes.write_actuals(v.campaigns, imp.campaign_actuals(v.impressions, v.lift), v.now).select(
        "campaign_id", "actual_metrics.impressions", "actual_metrics.reach", "actual_metrics.average_lift"),
    f"""SELECT c.campaign_id, a.impressions, a.reach, a.average_lift FROM campaigns c LEFT JOIN ({ACTUALS_SQL}) a ON a.campaign_id = c.campaign_id""",
    rounded="average_lift",
)

# ---- K: model and matching --------------------------------------------------------------------


def _model_panel(v):
    mine = v.exposure_counts
    return matching.encode_features(matching.fill_features(matching.campaign_panel(v.panelists, mine, CAMPAIGN)))


PANEL_SQL = f"""SELECT p.panelist_id, CASE WHEN e.panelist_id IS NULL THEN 0 ELSE 1 END AS exposed, {{cols}} FROM panelists p
  LEFT JOIN exposure_counts e ON e.campaign_id = '{CAMPAIGN}' AND e.panelist_id = p.panelist_id WHERE p.consent_given AND p.is_active"""


def _vector(v):
    from pyspark.ml.functions import vector_to_array

    df = matching.assemble(_model_panel(v))
    a = vector_to_array("features_raw")
    return df.select("panelist_id", "exposed", F.array_join(F.transform(a, lambda x: F.round(x * 100).cast("int").cast("string")), ",").alias("vector"))


query(
    "k01_feature_vector", _vector,
    PANEL_SQL.format(cols="""concat_ws(',', coalesce(age, 0), 100 * (coalesce(gender, '') = 'M')::int, 100 * (coalesce(gender, '') = 'F')::int,
      100 * (coalesce(device_type, '') = 'Mobile')::int, 100 * (coalesce(device_type, '') = 'Tablet')::int, 100 * (country = 'US')::int, 100 * (country = 'UK')::int,
      100 * (lower(replace(hh_income_bucket, ' ', '')) IN ('<25k', '25k-50k'))::int, 100 * (lower(replace(hh_income_bucket, ' ', '')) IN ('100k-150k', '150k+'))::int) AS vector"""),
)


def _scaled(v):
    from pyspark.ml.functions import vector_to_array

    df = matching.scale(matching.assemble(_model_panel(v)))
    a = vector_to_array("features")
    return df.select("panelist_id", *[a[i].alias(f"{name}_scaled") for i, name in enumerate(matching.FEATURES)])


#: The nine features in SQL, in the model's order.
FEATURE_SQL = {
    "age_normalized": "coalesce(age, 0) / 100.0", "gender_m": "coalesce(gender, '') = 'M'", "gender_f": "coalesce(gender, '') = 'F'",
    "device_mobile": "coalesce(device_type, '') = 'Mobile'", "device_tablet": "coalesce(device_type, '') = 'Tablet'",
    "country_us": "coalesce(country, '') = 'US'", "country_uk": "coalesce(country, '') = 'UK'",
    "income_low": "coalesce(lower(replace(hh_income_bucket, ' ', '')), '') IN ('<25k', '25k-50k')",
    "income_high": "coalesce(lower(replace(hh_income_bucket, ' ', '')), '') IN ('100k-150k', '150k+', '>150k')",
}
FEATURE_COLUMNS = ", ".join(f"({sql})::double AS {name}" for name, sql in FEATURE_SQL.items())
query(
    "k02_standardize", _scaled,
    f"""SELECT panelist_id, {", ".join(f"coalesce(({n} - avg({n}) OVER ()) / nullif(stddev_samp({n}) OVER (), 0), 0) AS {n}_scaled" for n in FEATURE_SQL)}
    FROM ({PANEL_SQL.format(cols=FEATURE_COLUMNS)})""",
    rounded=" ".join(f"{n}_scaled" for n in FEATURE_SQL),
)


def _fitted(v):
    panel = _model_panel(v)
    return matching.score(matching.fit_propensity(panel), panel)


def _fit_sql() -> str:
    """The model in SQL: (panelist_id, exposed, the features, s), s the score.

    Panelists are collapsed to distinct feature rows, and accelerated proximal gradient steps on the
    elastic-net loss run in a recursive table of one row until no weight moves.
    """
    step, momentum, l1, l2 = 0.5, 0.6, 0.005, 0.005
    names, ks = [*FEATURE_SQL], range(10)
    dot = " + ".join(f"y{k} * x{k}" for k in ks)
    moved = {k: f"y{k} - {step} * (g{k} + {l2 if k else 0} * y{k})" for k in ks}
    new = {k: f"sign({m}) * greatest(abs({m}) - {step * l1}, 0)" if k else m for k, m in moved.items()}
    scaled = ", ".join(f"coalesce(({n} - avg({n}) OVER ()) / nullif(stddev_samp({n}) OVER (), 0), 0) AS x{k + 1}" for k, n in enumerate(names))
    return f"""WITH RECURSIVE z AS MATERIALIZED (SELECT *, 1.0::double AS x0, {scaled} FROM ({PANEL_SQL.format(cols=FEATURE_COLUMNS)})),
      cells AS MATERIALIZED (SELECT {", ".join(f"x{k}" for k in ks)}, count(*)::double AS n, sum(exposed)::double AS hits, sum(count(*)) OVER ()::double AS total
        FROM z GROUP BY {", ".join(f"x{k}" for k in ks)}),
      fit AS (SELECT 0 AS i, {", ".join(f"0.0::double AS w{k}, 0.0::double AS p{k}" for k in ks)}, 1.0::double AS moved
        UNION ALL SELECT i + 1, {", ".join(f"n{k}, w{k}" for k in ks)}, greatest({", ".join(f"abs(n{k} - w{k})" for k in ks)})
        FROM (SELECT *, {", ".join(f"({new[k]})::double AS n{k}" for k in ks)}
          FROM (SELECT i, {", ".join(f"any_value(w{k}) AS w{k}, any_value(y{k}) AS y{k}" for k in ks)},
              {", ".join(f"sum((n / (1 + exp(-({dot}))) - hits) * x{k} / total) AS g{k}" for k in ks)}
            FROM (SELECT *, {", ".join(f"w{k} + {momentum} * (w{k} - p{k}) AS y{k}" for k in ks)} FROM fit WHERE moved > 1e-13 AND i < 5000), cells GROUP BY i))),
      w AS (SELECT * FROM fit ORDER BY i DESC LIMIT 1)
    SELECT panelist_id, exposed, {", ".join(names)}, 1 / (1 + exp(-({" + ".join(f"w{k} * x{k}" for k in ks)}))) AS s FROM z, w"""


FIT_SQL = _fit_sql()
query(
    "k03_fit_and_score",
    lambda v: _fitted(v).select("panelist_id", "exposed", F.round("propensity_score", 5).alias("propensity_score")),
    f"SELECT panelist_id, exposed, round(s, 5) AS propensity_score FROM ({FIT_SQL})",
)
query(
    "k04_score_profile_of_fit",
    lambda v: matching.score_profile(_fitted(v)).withColumns({c: F.round(c, 5) for c in ("mean", "stddev", "min", "max")}),
    f"""SELECT '{CAMPAIGN}' AS campaign_id, exposed, count(s) AS n, round(avg(s), 5) AS mean, round(stddev_samp(s), 5) AS stddev,
    round(min(s), 5) AS min, round(max(s), 5) AS max FROM ({FIT_SQL}) GROUP BY exposed""",
)
query(
    "k05_match",
    lambda v: matching.match(v.scored, CALIPER).select(
        "campaign_id", "exposed_id", "control_id", "exposed_score", "control_score", "ps_diff"),
    "SELECT campaign_id, exposed_id, control_id, exposed_score, control_score, ps_diff FROM pairs", rounded="ps_diff",
)
query(
    "k06_cohort_rows",
    lambda v: _cohort_rows(v).select("panelist_id", "campaign_id", "match_id", "cohort_type", "matched_control_flag", "processing_batch_id"),
    f"""SELECT unnest([exposed_id, control_id]) AS panelist_id, campaign_id, {MATCH_ID_SQL} AS match_id, unnest(['exposed', 'control']) AS cohort_type,
    true AS matched_control_flag, 'psm_' || campaign_id || '_20240125_120000' AS processing_batch_id FROM pairs""",
)


def _measure(v, score):
    panelists = v.panelists
    return measure_campaign(
        v.impressions, panelists, v.metrics, CAMPAIGN, v.now, caliper=CALIPER if score is not None else 0.1, score=score)


def _measure_sql(panel: str, caliper: float) -> str:
    """CTEs from a panel with scores `s` to the lift rows `y` of the matched arms; `pr` are the pairs."""
    return f"""panel AS ({panel}),
      c AS (SELECT e.panelist_id AS eid, c.panelist_id AS cid, abs(e.s - c.s) AS d FROM panel e JOIN panel c ON e.exposed = 1 AND c.exposed = 0 AND abs(e.s - c.s) <= {caliper}),
      pr AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY eid ORDER BY d, cid) = 1),
      arms AS (SELECT eid AS panelist_id, 'exposed' AS cohort_type FROM pr UNION SELECT cid, 'control' FROM pr),
      mm AS (SELECT m.campaign_id, m.metric_name,
        avg(metric_value) FILTER (cohort_type = 'exposed') AS exposed_value, stddev_samp(metric_value) FILTER (cohort_type = 'exposed') AS exposed_std_dev,
        count(metric_value) FILTER (cohort_type = 'exposed') AS exposed_sample_size, avg(metric_value) FILTER (cohort_type = 'control') AS control_value,
        stddev_samp(metric_value) FILTER (cohort_type = 'control') AS control_std_dev, count(metric_value) FILTER (cohort_type = 'control') AS control_sample_size
        FROM arms JOIN metrics m ON m.panelist_id = arms.panelist_id AND m.campaign_id = '{CAMPAIGN}' GROUP BY 1, 2),
      x AS (SELECT *, exposed_value - control_value AS lift_absolute, CASE WHEN control_value > 0 THEN (exposed_value - control_value) / control_value * 100 ELSE 0 END AS lift_relative_pct,
        (exposed_value - control_value) / nullif(sqrt(((exposed_sample_size - 1) * exposed_std_dev ** 2 + (control_sample_size - 1) * control_std_dev ** 2)
          / nullif(exposed_sample_size + control_sample_size - 2, 0) * (1.0 / nullif(exposed_sample_size, 0) + 1.0 / nullif(control_sample_size, 0))), 0) AS t_statistic,
        exposed_sample_size + control_sample_size - 2 AS degrees_of_freedom,
        1.96 * sqrt(exposed_std_dev ** 2 / nullif(exposed_sample_size, 0) + control_std_dev ** 2 / nullif(control_sample_size, 0)) AS margin FROM mm),
      y AS (SELECT *, {P_EXACT} AS p_value, lift_absolute - margin AS confidence_interval_lower, lift_absolute + margin AS confidence_interval_upper FROM x)"""


query(
    "measure_campaign_closed_score",
    lambda v: _measure(v, F.expr(SCORE)).results.select(*LIFT_COLS),
    f"""WITH {_measure_sql(PANEL_SQL.format(cols=SCORE + ' AS s'), CALIPER)}
    SELECT {', '.join(c if c != 'is_significant' else 'coalesce(p_value < 0.05, false) AS is_significant' for c in LIFT_COLS)} FROM y""",
    rounded=LIFT_ROUNDED,
)
BALANCED_SQL = " + ".join(
    f"""coalesce(abs(CASE WHEN var_samp({n}) FILTER (exposed = 1) + var_samp({n}) FILTER (exposed = 0) > 0
      THEN (avg({n}) FILTER (exposed = 1) - avg({n}) FILTER (exposed = 0)) / sqrt((var_samp({n}) FILTER (exposed = 1) + var_samp({n}) FILTER (exposed = 0)) / 2)
      WHEN var_samp({n}) FILTER (exposed = 1) + var_samp({n}) FILTER (exposed = 0) = 0 AND avg({n}) FILTER (exposed = 1) = avg({n}) FILTER (exposed = 0) THEN 0 END) < 0.1, false)::int"""
    for n in FEATURE_SQL
)
query(
    "measure_campaign_fitted",
    lambda v: _measure(v, None).results.select("campaign_id", "metric_name", "exposed_sample_size", "control_sample_size", "lift_absolute", "p_value", "balance_score"),
    f"""WITH {_measure_sql(FIT_SQL, 0.1)},
      sample AS (SELECT * FROM panel WHERE panelist_id IN (SELECT eid FROM pr UNION SELECT cid FROM pr))
    SELECT campaign_id, metric_name, exposed_sample_size, control_sample_size, lift_absolute, p_value,
      (SELECT ({BALANCED_SQL}) / {len(FEATURE_SQL)} FROM sample) AS balance_score FROM y""",
    rounded="lift_absolute p_value balance_score",
)
