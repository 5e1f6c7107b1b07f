"""The library's inputs derived from the test tables, for Spark and for the SQL oracle.

Source columns are portable SQL expressions used by both engines. What the library computes
(classification, hashing, ages, lift ...) is computed by the library on the Spark side and written
out a second time in SQL on the oracle side.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adgauge import schemas
from adgauge.functions import survey as survey_rules
from adgauge.functions.text import split_list
from adgauge.operators import changes, events, impressions, lift, surveys
from adgauge.session import cut
from adgauge.sources.readers import event_body

NOW = "2024-01-25 12:00:00"
CAMPAIGN = "camp_0"

_K = "cast(regexp_extract(props, '([0-9]+)', 1) as int)"

# campaign camp_0 holds more than a third of all events.
EVENTS = {
    "event_id": "concat('imp_', event_id)",
    "timestamp": "cast(ts as timestamp)",
    "campaign_id": f"concat('camp_', CASE WHEN {_K} % 3 = 0 THEN 0 ELSE {_K} % 20 END)",
    "creative_id": "concat('cr_', event_id % 3)",
    "panelist_token": "cast(user_id as string)",
    "user_agent": """CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Unknown'
        WHEN 3 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1)' WHEN 4 THEN 'curl/7.64.1'
        WHEN 5 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 16_0 like Mac OS X) Version/16.0 Mobile Safari/604.1'
        WHEN 6 THEN 'Mozilla/5.0 (iPad; CPU OS 16_0 like Mac OS X) Version/16.0 Safari/604.1'
        WHEN 7 THEN 'Mozilla/5.0 (Linux; Android 13; Tablet) Chrome/120.0 Safari/537.36'
        WHEN 8 THEN 'Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0'
        ELSE 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) Chrome/120.0 Safari/537.36 Edg/120.0' END""",
    "ip": "concat(1 + user_id % 250, '.0.113.', user_id % 200)",
    "referrer": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('https://site', event_id % 7, '.example/') END",
    "ad_server": "CASE WHEN event_id % 2 = 0 THEN 'gam' ELSE 'dv360' END",
    "s2s_flag": "event_type IN ('purchase', 'signup')",
    "seq": "event_id",
    "user_id": "user_id",
    "event_value": "value",
    # Header names and values as text: name=value pairs, ';' between them.
    "headers_text": """CASE event_id % 6
        WHEN 0 THEN 'Accept=text/html;Accept-Language=en;Accept-Encoding=gzip;X-Real-IP=10.1.2.3'
        WHEN 1 THEN 'accept=*/*;X-Forwarded-For= 51.0.0.9 , 10.0.0.1;User-Agent=curl/8.0'
        WHEN 2 THEN 'ACCEPT=text/html;X-Bot=1;X-S2S=TRUE'
        WHEN 3 THEN 'X-Forwarded-For=   ;X-REAL-IP=192.168.0.7;User-Agent=Mozilla/5.0 Chrome/120'
        WHEN 4 THEN 'X-Automated=yes;Accept-Language=de;User-Agent=   ;X-S2S=no'
        ELSE 'Accept=text/html;Accept-Language=fr;Accept-Encoding=br;User-Agent=MyServer/1.0' END""",
}

REGISTRATIONS = {
    "panelist_id": "cast(c_custkey as string)",
    "email": "CASE WHEN c_custkey % 29 = 0 THEN '  ' ELSE concat('  User', c_custkey, '@Example.COM ') END",
    "phone": "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE concat('+1 (555) 01', c_custkey % 10, '-', 1000 + c_custkey % 9000) END",
    "first_name": "concat('First', c_custkey % 97)",
    "last_name": "c_name",
    "age": "CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE cast(12 + c_custkey % 66 as int) END",
    "age_range": "CASE WHEN c_custkey % 31 = 0 THEN '25-34' ELSE NULL END",
    "gender": "CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'Other' END",
    "hh_income_bucket": """CASE WHEN c_acctbal < 0 THEN '< 25k' WHEN c_acctbal < 2500 THEN '25K-50K'
        WHEN c_acctbal < 5000 THEN '50K-75K' WHEN c_acctbal < 7500 THEN '75K-100K'
        WHEN c_acctbal < 9000 THEN '100K-150K' ELSE '150K+' END""",
    "interests": "concat(lower(c_mktsegment), ', news,, sport', c_custkey % 4, ' ')",
    "country": "CASE c_nationkey % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'UK' WHEN 2 THEN 'DE' WHEN 3 THEN 'FR' ELSE 'XX' END",
    "postal_code": "cast(10000 + c_custkey % 90000 as string)",
    "device_type": "CASE c_custkey % 4 WHEN 0 THEN 'Desktop' WHEN 1 THEN 'Mobile' WHEN 2 THEN 'Tablet' ELSE NULL END",
    "browser": "CASE c_custkey % 3 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Safari' ELSE NULL END",
    "consent_given": "c_custkey % 5 <> 0",
    "consent_gdpr": "c_custkey % 10 = 0",
    "consent_ccpa": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 45 = 0 END",
    "stored_active": "c_custkey % 17 <> 0",
    "stored_points": "cast(CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE c_custkey % 501 END as int)",
    "stored_created": "cast(date '2023-01-01' + cast(c_custkey % 365 as int) as timestamp)",
    "custkey": "c_custkey",
}

CAMPAIGNS = {
    "campaign_id": "concat('camp_', p_partkey)",
    "campaign_name": "concat(p_name, ' ', p_partkey)",
    "advertiser": "p_brand",
    "industry": "p_type",
    "start_date": "cast(date '2024-01-01' + cast(p_partkey % 60 as int) as timestamp)",
    "end_date": "cast(date '2024-01-01' + cast(p_partkey % 60 + p_size as int) as timestamp)",
    "budget": "cast(p_retailprice * 100 as decimal(18,2))",
    "ages": "CASE p_partkey % 3 WHEN 0 THEN '18-24,25-34' WHEN 1 THEN '' ELSE '35-44,45-54,65+' END",
    "genders": "CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'M' ELSE 'F,Other' END",
    "wanted_interests": "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Sport1,building' ELSE 'Sport2,machinery' END",
    "countries": "CASE p_partkey % 2 WHEN 0 THEN 'US,UK' ELSE 'DE,FR,XX' END",
    "target_impressions": "cast(CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_size * 20 END as bigint)",
    "target_reach": "cast(p_size * 4 as bigint)",
    "target_lift": "cast(p_size as double) / 10",
    "created_at": "cast(date '2023-10-01' + cast(p_partkey % 90 as int) as timestamp)",
    "client_id": "concat('client_', p_partkey % 13)",
    "agency_id": "concat('agency_', p_partkey % 4)",
    "partkey": "p_partkey",
}

SURVEYS = {
    "survey_id": "concat('survey_', p_partkey)",
    "campaign_id": "concat('camp_', p_partkey)",
    "survey_name": "concat('Survey of ', p_name)",
    "status": "CASE p_partkey % 4 WHEN 1 THEN 'Draft' WHEN 2 THEN 'Completed' ELSE 'Active' END",
    "created_at": "cast(date '2023-11-01' + cast(p_partkey % 50 as int) as timestamp)",
    "partkey": "p_partkey",
}

_DIGIT = "cast(substring(o_orderpriority, 1, 1) as int)"
RESPONSES = {
    "response_id": "concat('resp_', o_orderkey)",
    "survey_id": "concat('survey_', o_orderkey % 20)",
    "panelist_id": "cast(o_custkey as string)",
    "cohort_type": """CASE o_custkey % 3 WHEN 0 THEN 'exposed' WHEN 1 THEN 'control'
        ELSE CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'control' END END""",
    "status": "CASE WHEN o_orderstatus = 'P' THEN 'Pending' ELSE 'Completed' END",
    "completed_at": "cast(o_orderdate as timestamp)",
    "response_time": "cast(30 + o_orderkey % 300 as int)",
    "device_type": "CASE WHEN o_orderkey % 2 = 0 THEN 'Mobile' ELSE 'Desktop' END",
    "digit": _DIGIT,
    "yes": "CASE WHEN o_totalprice > 250000 THEN 'Yes' WHEN o_totalprice > 20000 THEN 'No' ELSE NULL END",
    "orderkey": "o_orderkey",
}

# Fixed values of the views: Likert options, best answer last, and the questions of a survey.
LIKERT = ["Very low", "Low", "Neutral", "High", "Very high"]
QUESTIONS = [
    ("q1", "How aware are you of the brand?", "LikertScale", "brand_awareness"),
    ("q2", "Would you buy it?", "YesNo", "purchase_intent"),
    ("q3", "How do you like it?", "Rating", "brand_favorability"),
    ("q4", "What do you remember?", "OpenEnded", "message_recall"),
]


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS {name}" for name, expr in columns.items()])


class Views:
    """Lazily built DataFrames over one test-data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder
        self.now = F.lit(NOW).cast("timestamp")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return _select(self.table("events"), EVENTS)

    @cached_property
    def headers(self) -> DataFrame:
        text = F.expr("str_to_map(headers_text, ';', '=')")
        return self.events.withColumn("headers", text)

    @cached_property
    def bodies(self) -> DataFrame:
        """Raw stream records: JSON body and envelope; some bodies are broken."""
        return self.bodies_with({})

    def bodies_with(self, more: dict[str, Column]) -> DataFrame:
        """The same with more fields in the body."""
        columns = {c: F.col(c) for c in EVENTS if c in schemas.TRACKING_EVENT.fieldNames()} | more
        columns["timestamp"] = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        columns["campaign_id"] = F.when(F.col("seq") % 101 == 5, "  ").otherwise(F.col("campaign_id"))
        columns["tracking_hash"] = F.concat(F.lit("h"), (F.col("seq") - F.col("seq") % 4).cast("string"))
        body = F.when(F.col("seq") % 103 == 7, "{broken").when(
            F.col("seq") % 107 == 9, "null"
        ).otherwise(event_body(columns))
        return self.events.select(
            body.alias("body"), F.col("timestamp").alias("enqueuedTime"),
            F.col("seq").cast("string").alias("offset"), F.col("seq").alias("sequenceNumber"),
            F.lit("pub").alias("publisher"), (F.col("seq") % 4).cast("string").alias("partitionKey"),
            F.when(F.col("seq") % 109 == 0, (F.col("seq") % 5).cast("int")).alias("retry_count"),
        )

    @cached_property
    def impressions(self) -> DataFrame:
        return events.normalize_impressions(self.events)

    @cached_property
    def registrations(self) -> DataFrame:
        return _select(self.table("customer"), REGISTRATIONS)

    @cached_property
    def panelists(self) -> DataFrame:
        made = changes.create_panelists(
            self.registrations, self.now, carry=("stored_active", "stored_points", "stored_created", "custkey")
        )
        return made.withColumns({
            "is_active": F.col("stored_active"), "points_balance": F.col("stored_points"),
            "created_at": F.col("stored_created"),
        }).drop("stored_active", "stored_points", "stored_created")

    @cached_property
    def flat_campaigns(self) -> DataFrame:
        return _select(self.table("part"), CAMPAIGNS)

    @cached_property
    def campaigns(self) -> DataFrame:
        flat = self.flat_campaigns
        creative = F.struct(
            F.concat(F.lit("cr_"), (F.col("partkey") % 3).cast("string")).alias("creative_id"),
            F.lit("banner").alias("format"), F.lit("300x250").alias("size"),
            F.lit("Buy").alias("message"), F.lit("A").alias("variant_name"),
        )
        return flat.select(
            "campaign_id", "campaign_name", "advertiser", "industry", "start_date", "end_date",
            "budget",
            changes.campaign_status(self.now).alias("status"),
            F.struct(
                split_list("ages").alias("age_range"), split_list("genders").alias("gender"),
                split_list("wanted_interests").alias("interests"),
                split_list("countries").alias("countries"),
            ).alias("target_audience"),
            F.array(creative).alias("creatives"),
            F.struct("target_impressions", "target_reach", "target_lift").alias("kpis"),
            F.lit(None).cast(schemas.ACTUAL_METRICS).alias("actual_metrics"),
            "created_at", F.col("created_at").alias("updated_at"), "client_id", "agency_id",
        )

    @cached_property
    def surveys(self) -> DataFrame:
        questions = F.array(*[
            F.struct(
                F.lit(qid).alias("question_id"), F.lit(text).alias("question_text"),
                F.lit(kind).alias("question_type"), F.lit(metric).alias("metric"),
                (F.array(*map(F.lit, LIKERT)) if kind == "LikertScale" else F.array().cast("array<string>")).alias("options"),
                F.lit(10).alias("scale"), F.lit(True).alias("required"), F.lit(i + 1).alias("order"),
            )
            for i, (qid, text, kind, metric) in enumerate(QUESTIONS)
        ])
        return _select(self.table("part"), SURVEYS).withColumns({
            "questions": questions, "updated_at": F.col("created_at"),
        })

    @cached_property
    def responses(self) -> DataFrame:
        flat = _select(self.table("orders"), RESPONSES)
        likert = F.array(*map(F.lit, LIKERT))
        texts = {
            "q1": likert[F.col("digit") - 1], "q2": F.col("yes"),
            "q3": (F.col("digit") * 2).cast("string"), "q4": F.lit("an ad"),
        }
        answers = F.array(*[
            F.struct(
                F.lit(qid).alias("question_id"), texts[qid].alias("answer"),
                survey_rules.answer_value(F.lit(kind), likert, texts[qid]).alias("numeric_value"),
            )
            for qid, _, kind, _ in QUESTIONS
        ])
        return flat.select(
            "response_id", "survey_id", F.lit(None).cast("string").alias("campaign_id"),
            "panelist_id", "cohort_type",
            F.when(F.col("status") == "Completed", answers).otherwise(
                F.array().cast(schemas.ANSWERS)
            ).alias("answers"),
            F.when(F.col("status") == "Completed", F.col("completed_at")).alias("completed_at"),
            "response_time", "device_type", F.lit(None).cast("int").alias("impression_count"),
            "status", F.col("completed_at").alias("created_at"), "orderkey",
        )

    @cached_property
    def answers(self) -> DataFrame:
        return surveys.answers_long(self.surveys, self.responses)

    @cached_property
    def metrics(self) -> DataFrame:
        return surveys.survey_metrics(self.answers)

    @cached_property
    def exposure_counts(self) -> DataFrame:
        return impressions.panelist_exposure(self.impressions)

    @cached_property
    def joined(self) -> DataFrame:
        """Metric rows of consented, active panelists, exposed or control in the campaign.

        Pool and exposures grow with the panel, so they are met in shuffled partitions and not sent whole to every machine;
        the metric rows stream past them and are not sorted."""
        pool = self.panelists.filter(F.col("consent_given") & F.col("is_active"))
        seen = self.exposure_counts.select("campaign_id", "panelist_id", F.lit(True).alias("hit"))
        return (
            self.metrics.join(pool.select("panelist_id").hint("shuffle_hash"), "panelist_id", "left_semi")
            .join(seen.hint("shuffle_hash"), ["campaign_id", "panelist_id"], "left")
            .withColumn("cohort_type", F.when(F.col("hit"), "exposed").otherwise("control"))
            .drop("hit")
        )

    @cached_property
    def lift(self) -> DataFrame:
        """Lift table of every campaign and metric, p by the step table."""
        moments = lift.cohort_moments(self.joined, ["campaign_id", "metric_name"])
        batch = survey_rules.batch_id("psm", "campaign_id", self.now)
        return lift.lift_results(lift.lift_statistics(moments, "step"), batch, self.now)

    @cached_property
    def scored(self) -> DataFrame:
        """Study panels of the campaigns a panelist was asked about, with a closed-form score.

        Matching reads its panel several times, so it is materialised once."""
        asked = self.answers.select("campaign_id", "panelist_id").distinct()
        pool = self.panelists.filter(F.col("consent_given") & F.col("is_active"))
        seen = self.exposure_counts.select("campaign_id", "panelist_id", F.lit(1).alias("exposed"))
        return cut(
            asked.join(pool, "panelist_id")
            .join(seen, ["campaign_id", "panelist_id"], "left")
            .withColumn("exposed", F.coalesce("exposed", F.lit(0)))
            .withColumn("propensity_score", F.expr(SCORE))
        )


# Thousandths, so both engines hold the same doubles and ties are real ties.
SCORE = "cast((custkey * 37) % 613 + 100 * (custkey % 3) as double) / 1000"


def stamp(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# ---- the same views in DuckDB SQL -------------------------------------------------------------

def _sql_select(columns: dict[str, str], table: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {table}"


STREAM_PATTERN = (
    "bot|crawler|spider|scraper|curl|wget|python-requests|java/|go-http-client|okhttp|httpclient|"
    "headless|phantom|selenium|webdriver|slurp|bingbot|googlebot|baiduspider|yandex|duckduckbot|"
    "facebookexternalhit"
)
CONSUMER_PATTERN = "bot|crawl|spider|slurp|scraper|headless|phantom|selenium|webdriver|puppeteer"
DEVICE_TRACKER = """CASE WHEN user_agent IS NULL OR trim(user_agent) = '' THEN 'Unknown'
  WHEN regexp_matches(lower(user_agent), 'tablet|ipad') THEN 'Tablet'
  WHEN regexp_matches(lower(user_agent), 'mobile|android|iphone|ipod|blackberry|windows phone') THEN 'Mobile'
  WHEN regexp_matches(lower(user_agent), 'smart-tv|smarttv|googletv') THEN 'SmartTV' ELSE 'Desktop' END"""
DEVICE_CONSUMER = """CASE WHEN user_agent IS NULL OR trim(user_agent) = '' THEN 'Unknown'
  WHEN regexp_matches(lower(user_agent), 'mobile|android|iphone') THEN 'Mobile'
  WHEN regexp_matches(lower(user_agent), 'tablet|ipad') THEN 'Tablet' ELSE 'Desktop' END"""
COUNTRY = """CASE WHEN cast(split_part(ip, '.', 1) AS int) BETWEEN 1 AND 50 THEN 'US'
  WHEN cast(split_part(ip, '.', 1) AS int) BETWEEN 51 AND 100 THEN 'UK'
  WHEN cast(split_part(ip, '.', 1) AS int) BETWEEN 101 AND 150 THEN 'DE'
  WHEN cast(split_part(ip, '.', 1) AS int) BETWEEN 151 AND 200 THEN 'FR' ELSE 'XX' END"""
BOT_REASON = f"""CASE WHEN regexp_matches(lower(user_agent), '{STREAM_PATTERN}') THEN 'user_agent_blacklist'
  WHEN user_agent IS NULL THEN 'missing_user_agent'
  WHEN user_agent = 'Unknown' THEN 'unknown_user_agent' END"""
AGE_RANGE = """CASE WHEN age IS NULL THEN NULL WHEN age < 18 THEN '<18' WHEN age <= 24 THEN '18-24'
  WHEN age <= 34 THEN '25-34' WHEN age <= 44 THEN '35-44' WHEN age <= 54 THEN '45-54'
  WHEN age <= 64 THEN '55-64' ELSE '65+' END"""

SQL_VIEWS = {
    "raw_events": _sql_select(EVENTS, "events"),
    "impressions": f"""SELECT event_id AS impression_id, timestamp AS timestamp_utc, campaign_id,
      creative_id, panelist_token AS panelist_id, {DEVICE_TRACKER} AS device_type,
      {COUNTRY} AS country, ({BOT_REASON}) IS NOT NULL AS is_bot, {BOT_REASON} AS bot_reason,
      CASE WHEN s2s_flag THEN 'S2S' ELSE 'Pixel' END AS ingest_source, ip, seq FROM raw_events""",
    "registrations": _sql_select(REGISTRATIONS, "customer"),
    "panelists": f"""SELECT panelist_id, custkey,
      CASE WHEN trim(email) = '' THEN '' ELSE sha256(lower(trim(email))) END AS hashed_email,
      sha256(regexp_replace(phone, '[^0-9]', '', 'g')) AS hashed_phone,
      email, first_name, last_name, coalesce(age_range, {AGE_RANGE}) AS age_range, age, gender,
      hh_income_bucket, interests, country, postal_code, device_type, browser,
      coalesce(consent_gdpr, false) AS consent_gdpr, coalesce(consent_ccpa, false) AS consent_ccpa,
      coalesce(consent_given, false) OR coalesce(consent_gdpr, false) OR coalesce(consent_ccpa, false) AS consent_given,
      stored_points AS points_balance, stored_active AS is_active, stored_created AS created_at
      FROM registrations""",
    "campaigns": "SELECT *, CASE WHEN timestamp '" + NOW + "' < start_date THEN 'Scheduled' "
                 "WHEN timestamp '" + NOW + "' <= end_date THEN 'Active' ELSE 'Completed' END AS status "
                 f"FROM ({_sql_select(CAMPAIGNS, 'part')})",
    "surveys": _sql_select(SURVEYS, "part"),
    "responses": _sql_select(RESPONSES, "orders"),
    "answers": """SELECT r.response_id, r.survey_id, s.campaign_id, r.panelist_id, r.cohort_type,
      r.completed_at, q.question_id, q.metric_name, q.answer, q.numeric_value
      FROM (SELECT response_id, 'q1' AS question_id, 'brand_awareness' AS metric_name,
              list_extract(['Very low','Low','Neutral','High','Very high'], digit) AS answer,
              cast(digit AS double) AS numeric_value FROM responses WHERE status = 'Completed'
            UNION ALL SELECT response_id, 'q2', 'purchase_intent', yes,
              CASE yes WHEN 'Yes' THEN 1.0 WHEN 'No' THEN 0.0 END FROM responses WHERE status = 'Completed'
            UNION ALL SELECT response_id, 'q3', 'brand_favorability', cast(digit * 2 AS varchar),
              cast(digit * 2 AS double) FROM responses WHERE status = 'Completed'
            UNION ALL SELECT response_id, 'q4', 'message_recall', 'an ad', NULL
              FROM responses WHERE status = 'Completed') q
      JOIN responses r USING (response_id) JOIN surveys s ON s.survey_id = r.survey_id""",
    "metrics": """SELECT panelist_id, campaign_id, metric_name, numeric_value AS metric_value,
      completed_at AS survey_date FROM answers WHERE numeric_value IS NOT NULL""",
    "exposure_counts": """SELECT campaign_id, panelist_id, count(*) AS impression_count
      FROM impressions WHERE NOT is_bot GROUP BY ALL""",
    "joined": """SELECT m.*, CASE WHEN e.panelist_id IS NULL THEN 'control' ELSE 'exposed' END AS cohort_type
      FROM metrics m JOIN panelists p ON p.panelist_id = m.panelist_id AND p.consent_given AND p.is_active
      LEFT JOIN exposure_counts e ON e.campaign_id = m.campaign_id AND e.panelist_id = m.panelist_id""",
    "moments": """SELECT campaign_id, metric_name,
      avg(metric_value) FILTER (cohort_type = 'exposed') AS exposed_value,
      stddev_samp(metric_value) FILTER (cohort_type = 'exposed') AS exposed_std_dev,
      count(metric_value) FILTER (cohort_type = 'exposed') AS exposed_sample_size,
      avg(metric_value) FILTER (cohort_type = 'control') AS control_value,
      stddev_samp(metric_value) FILTER (cohort_type = 'control') AS control_std_dev,
      count(metric_value) FILTER (cohort_type = 'control') AS control_sample_size
      FROM joined GROUP BY ALL""",
    "lift": f"""WITH a AS (SELECT *, exposed_value - control_value AS lift_absolute,
        CASE WHEN control_value > 0 THEN (exposed_value - control_value) / control_value * 100 ELSE 0 END AS lift_relative_pct,
        (exposed_value - control_value) / nullif(sqrt(((exposed_sample_size - 1) * exposed_std_dev ** 2
          + (control_sample_size - 1) * control_std_dev ** 2) / nullif(exposed_sample_size + control_sample_size - 2, 0)
          * (1.0 / nullif(exposed_sample_size, 0) + 1.0 / nullif(control_sample_size, 0))), 0) AS t_statistic,
        exposed_sample_size + control_sample_size - 2 AS degrees_of_freedom,
        1.96 * sqrt(exposed_std_dev ** 2 / nullif(exposed_sample_size, 0) + control_std_dev ** 2 / nullif(control_sample_size, 0)) AS margin
        FROM moments),
      b AS (SELECT *, CASE WHEN t_statistic IS NULL THEN NULL WHEN abs(t_statistic) > 2.576 THEN 0.001
        WHEN abs(t_statistic) > 1.96 THEN 0.01 WHEN abs(t_statistic) > 1.645 THEN 0.05 ELSE 0.10 END::double AS p_value FROM a)
      SELECT *, coalesce(p_value < 0.05, false) AS is_significant, lift_absolute - margin AS confidence_interval_lower,
        lift_absolute + margin AS confidence_interval_upper, exposed_sample_size AS cohort_size_exposed,
        control_sample_size AS cohort_size_control, timestamp '{NOW}' AS run_ts FROM b""",
    "scored": f"""SELECT a.campaign_id, p.*, CASE WHEN e.panelist_id IS NULL THEN 0 ELSE 1 END AS exposed,
      {SCORE} AS propensity_score
      FROM (SELECT DISTINCT campaign_id, panelist_id FROM answers) a
      JOIN panelists p ON p.panelist_id = a.panelist_id AND p.consent_given AND p.is_active
      LEFT JOIN exposure_counts e ON e.campaign_id = a.campaign_id AND e.panelist_id = a.panelist_id""",
    "pairs": """WITH c AS (SELECT e.campaign_id, e.panelist_id AS exposed_id, e.propensity_score AS exposed_score,
        c.panelist_id AS control_id, c.propensity_score AS control_score,
        abs(e.propensity_score - c.propensity_score) AS ps_diff
        FROM scored e JOIN scored c ON e.campaign_id = c.campaign_id AND e.exposed = 1 AND c.exposed = 0
        AND abs(e.propensity_score - c.propensity_score) <= 0.0105),
      r AS (SELECT *, row_number() OVER (PARTITION BY campaign_id, exposed_id ORDER BY ps_diff, control_id) AS match_rank FROM c)
      SELECT * FROM r WHERE match_rank <= 1""",
    "features": """SELECT *, coalesce(age, 0) / 100.0 AS age_normalized,
      (coalesce(gender, '') = 'M')::int AS gender_m, (coalesce(gender, '') = 'F')::int AS gender_f,
      (coalesce(device_type, '') = 'Mobile')::int AS device_mobile, (coalesce(device_type, '') = 'Tablet')::int AS device_tablet,
      (coalesce(country, '') = 'US')::int AS country_us, (coalesce(country, '') = 'UK')::int AS country_uk,
      (lower(replace(hh_income_bucket, ' ', '')) IN ('<25k', '25k-50k'))::int AS income_low,
      (lower(replace(hh_income_bucket, ' ', '')) IN ('100k-150k', '150k+', '>150k'))::int AS income_high
      FROM scored""",
}


def sql(body: str) -> str:
    """Prefixes a query with the views it uses, directly or through other views."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in SQL_VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(SQL_VIEWS[name])

    visit(body)
    ctes = [f"{name} AS ({text})" for name, text in SQL_VIEWS.items() if name in needed]
    if not ctes:
        return body
    if body.lstrip().upper().startswith("WITH"):
        body = f"SELECT * FROM ({body})"
    return "WITH " + ",\n".join(ctes) + "\n" + body
