"""Catalogue: sources and sinks, event rules, scalar functions, rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from adgauge import schemas
from adgauge.functions import agents, bots, geo, identity, stats, survey, text
from adgauge.operators import addresses, events, matching, rates, tables
from adgauge.plans import views
from adgauge.plans.registry import query
from adgauge.plans.views import CAMPAIGN, NOW, stamp
from adgauge.session import cut, scratch_path
from adgauge.sources import keyed, readers, sinks

TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def ts(column: str) -> str:
    return TS.format(column)


# ---- A: scans, sources, sinks -----------------------------------------------------------------

def _mapping(v):
    cohorts = v.scored.filter(F.col("exposed") == 1).select(
        "campaign_id", "panelist_id", F.lit("exposed").alias("cohort_type"),
        F.concat(F.lit("m_"), "panelist_id").alias("match_id"), "propensity_score",
        F.lit(0.0).alias("match_quality_score"), F.lit("b1").alias("processing_batch_id"),
    )
    return tables.build_exposure_mapping(v.impressions, cohorts)


query(
    "a01_exposure_scan",
    lambda v: readers.exposures(_mapping(v), CAMPAIGN).withColumn("impression_ts", stamp("impression_ts")),
    f"""SELECT panelist_id, impression_id, campaign_id, creative_id, {ts('timestamp_utc')} AS impression_ts,
    device_type, country AS country_code, is_bot, 1 AS exposed FROM impressions
    WHERE campaign_id = '{CAMPAIGN}' AND NOT is_bot""",
)
query(
    "a02_panelist_feature_scan",
    lambda v: tables.panelist_features(v.panelists, v.impressions, CAMPAIGN),
    f"""SELECT DISTINCT panelist_id, age, gender, country, hh_income_bucket, device_type, browser FROM panelists
    WHERE panelist_id IN (SELECT panelist_id FROM impressions WHERE campaign_id = '{CAMPAIGN}')""",
)


def _cohort_scan(v):
    path = scratch_path(v.spark, "cohorts")
    pairs = cut(matching.match(v.scored, caliper=0.0105))
    scores = pairs.select("campaign_id").distinct().withColumn("balance_score", F.lit(1.0))
    sinks.append(matching.cohort_rows(pairs, scores, v.now), path)
    table = readers.read_table(v.spark, path)
    return readers.cohorts(table, CAMPAIGN, f"psm_{CAMPAIGN}_20240125_120000").drop("match_id")


query(
    "a03_matched_cohort_scan", _cohort_scan,
    f"""SELECT exposed_id AS panelist_id, campaign_id, 'exposed' AS cohort_type, exposed_score AS propensity_score,
      1.0::double AS balance_score FROM pairs WHERE campaign_id = '{CAMPAIGN}'
    UNION ALL SELECT control_id, campaign_id, 'control', control_score, 1.0::double FROM pairs WHERE campaign_id = '{CAMPAIGN}'""",
)
query(
    "a04_survey_metric_scan",
    lambda v: readers.survey_metrics(v.metrics, CAMPAIGN).withColumn("survey_date", stamp("survey_date")),
    f"SELECT * REPLACE ({ts('survey_date')} AS survey_date) FROM metrics WHERE campaign_id = '{CAMPAIGN}'",
)
query(
    "a06_parse_events",
    lambda v: events.parse_events(v.bodies, v.now).select(
        "event_id", stamp("timestamp").alias("timestamp"), "campaign_id", "creative_id",
        "panelist_token", "user_agent", "ip", "referrer", "ad_server", "s2s_flag", "tracking_hash",
        "eventhub_offset", "eventhub_sequence_number", "eventhub_partition_key",
        stamp("eventhub_enqueued_time").alias("enqueued"), stamp("processed_at").alias("processed_at"),
    ),
    f"""SELECT CASE WHEN ok THEN event_id END AS event_id, CASE WHEN ok THEN {ts('timestamp')} END AS timestamp,
      CASE WHEN ok THEN CASE WHEN seq % 101 = 5 THEN '  ' ELSE campaign_id END END AS campaign_id,
      CASE WHEN ok THEN creative_id END AS creative_id, CASE WHEN ok THEN panelist_token END AS panelist_token,
      CASE WHEN ok THEN user_agent END AS user_agent, CASE WHEN ok THEN ip END AS ip,
      CASE WHEN ok THEN referrer END AS referrer, CASE WHEN ok THEN ad_server END AS ad_server,
      CASE WHEN ok THEN s2s_flag END AS s2s_flag,
      CASE WHEN ok THEN concat('h', seq - seq % 4) END AS tracking_hash,
      seq::varchar AS eventhub_offset, seq AS eventhub_sequence_number, (seq % 4)::varchar AS eventhub_partition_key,
      {ts('timestamp')} AS enqueued, '{NOW}.000000' AS processed_at
    FROM (SELECT *, NOT (seq % 103 = 7 OR seq % 107 = 9) AS ok FROM raw_events)""",
)


def _documents(v):
    path = scratch_path(v.spark, "surveys")
    sinks.export_json(v.surveys.drop("partkey"), path)
    lines = readers.read_json_lines(v.spark, path, schemas.SURVEY)
    # the same documents as files that hold one JSON array each
    arrays = scratch_path(v.spark, "arrays")
    sinks.export_arrays(v.spark.read.text(path), arrays)
    back = readers.read_documents(v.spark, f"{arrays}/part-*", schemas.SURVEY).unionByName(lines.limit(0))
    return back.select(
        "survey_id", "campaign_id", "status", F.size("questions").cast("bigint").alias("questions"),
        F.array_join(F.transform("questions", lambda x: x["metric"]), ",").alias("metrics"),
        stamp("created_at").alias("created_at"),
    )


query(
    "a07_read_documents", _documents,
    f"""SELECT survey_id, campaign_id, status, 4::bigint AS questions,
    'brand_awareness,purchase_intent,brand_favorability,message_recall' AS metrics, {ts('created_at')} AS created_at FROM surveys""",
)


def _staging(v):
    path = scratch_path(v.spark, "staging")
    sinks.write_staging(events.add_date_parts(v.events.drop("headers_text")), path)
    return readers.read_table(v.spark, path).select("event_id", "campaign_id", "ip", "seq", "year", "month", "day")


query(
    "a08_partitioned_staging", _staging,
    """SELECT event_id, campaign_id, ip, seq, year(timestamp)::int AS year, month(timestamp)::int AS month, day(timestamp)::int AS day FROM raw_events""",
)


def _evolved(v):
    path = scratch_path(v.spark, "evolved")
    dated = events.add_date_parts(v.events).select("event_id", "campaign_id", "year", "month", "day", "seq")
    old, new = dated.filter("seq % 2 = 0").drop("seq"), dated.filter("seq % 2 = 1").withColumn("extra", F.col("seq") * 2).drop("seq")
    sinks.write_staging(old, path)
    sinks.write_staging(new, path)
    return v.spark.read.option("mergeSchema", True).parquet(path).select("event_id", "campaign_id", "extra")


query(
    "a09_schema_evolution", _evolved,
    "SELECT event_id, campaign_id, CASE WHEN seq % 2 = 1 THEN seq * 2 END AS extra FROM raw_events",
)


def _upserted(v):
    """Three batches into one table, all events: keys move to other dates, some rows have no date or no key.

    The changes of the first two are folded before the third comes; the table is read before and after its compaction.
    """
    target = scratch_path(v.spark, "target")
    base = v.events.select(
        "event_id", F.when(F.expr("seq % 11 > 0"), F.concat(F.lit("h"), F.expr("cast(seq - seq % 4 AS string)"))).alias("tracking_hash"),
        "campaign_id", F.col("timestamp").alias("processed_at"),
        F.when(F.expr("seq % 7 > 0"), F.date_add(F.to_date("timestamp"), F.when(F.expr("seq % 4 = 3"), (F.col("seq") % 5).cast("int")).otherwise(0))).alias("date"),
        F.expr("CASE seq % 4 WHEN 3 THEN 1 WHEN 2 THEN 2 ELSE 0 END").alias("part"),
    )
    rows = base.drop("part").schema
    for part in range(3):
        keyed.upsert_batch(base.filter(F.col("part") == part).drop("part"), part, target)
        if part == 1:
            keyed.fold_changes(v.spark, target, rows)
    before = keyed.version(v.spark, target)
    keyed.compact(v.spark, target, rows)
    versions = (("changes", before), ("compacted", keyed.version(v.spark, target)))
    reads = [keyed.read_keyed(v.spark, target, rows, version=n).withColumn("state", F.lit(state)) for state, n in versions]
    return reads[0].unionByName(reads[1]).select(
        "state", "tracking_hash", "event_id", "campaign_id", F.col("date").cast("string").alias("date"))


query(
    "a10_upsert_sink", _upserted,
    """WITH base AS (SELECT event_id, CASE WHEN seq % 11 > 0 THEN concat('h', seq - seq % 4) END AS tracking_hash, campaign_id, timestamp AS processed_at,
        CASE WHEN seq % 7 > 0 THEN timestamp::date + (CASE WHEN seq % 4 = 3 THEN seq % 5 ELSE 0 END)::int END AS date,
        CASE seq % 4 WHEN 3 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS part FROM raw_events)
    SELECT state, tracking_hash, event_id, campaign_id, date::varchar AS date FROM (SELECT * FROM base
    QUALIFY tracking_hash IS NULL OR row_number() OVER (PARTITION BY tracking_hash ORDER BY part DESC, processed_at DESC, event_id DESC) = 1), (VALUES ('changes'), ('compacted')) t(state)""",
)


def _appended(v):
    path = scratch_path(v.spark, "lift")
    sinks.append(v.lift, path, ("campaign_id",))
    sinks.append(v.lift, path, ("campaign_id",))
    return readers.read_table(v.spark, path).select("campaign_id", "metric_name", "cohort_size_exposed", "processing_job_id")


query(
    "a11_append_results", _appended,
    """SELECT campaign_id, metric_name, cohort_size_exposed, 'lift_' || campaign_id || '_20240125_120000' AS processing_job_id FROM lift, range(2)""",
)


def _dead_letters(v):
    path = scratch_path(v.spark, "dlq")
    _, rejected = events.split_valid(v.bodies)
    sinks.write_dead_letters(rejected, path, v.now)
    return v.spark.read.json(path).select(
        "original_event", "error_reason", F.col("sequence_number").cast("bigint").alias("sequence_number"),
        F.col("dlq_date").cast("string").alias("dlq_date"),
    ).withColumn("original_event", F.coalesce(F.get_json_object("original_event", "$.event_id"), "original_event"))


REASON_SQL = """CASE WHEN seq % 103 = 7 THEN 'JSON error: body does not decode' WHEN seq % 107 = 9 THEN 'Deserialization failed'
  WHEN seq % 101 = 5 THEN 'Missing required fields' END"""
query(
    "a12_dead_letters", _dead_letters,
    f"""SELECT CASE WHEN seq % 103 = 7 THEN '{{broken' WHEN seq % 107 = 9 THEN 'null' ELSE event_id END AS original_event, {REASON_SQL} AS error_reason, seq AS sequence_number,
    '{NOW[:10]}' AS dlq_date FROM raw_events WHERE {REASON_SQL} IS NOT NULL""",
)


def _csv(v):
    path = scratch_path(v.spark, "csv")
    sinks.export_csv(v.impressions.select("impression_id", "campaign_id", "device_type", "is_bot"), path)
    return v.spark.read.option("header", True).schema(
        "impression_id string, campaign_id string, device_type string, is_bot boolean"
    ).csv(path)


query(
    "a13_csv_export", _csv,
    "SELECT impression_id, campaign_id, device_type, is_bot FROM impressions",
)


def _json(v):
    path = scratch_path(v.spark, "json")
    sinks.export_json(v.lift.select("campaign_id", "metric_name", "lift_absolute", "is_significant"), path)
    return readers.read_json_lines(v.spark, path, v.lift.select(
        "campaign_id", "metric_name", "lift_absolute", "is_significant").schema)


query(
    "a14_json_export", _json,
    "SELECT campaign_id, metric_name, lift_absolute, is_significant FROM lift", rounded="lift_absolute",
)
query(
    "a15_lookup_by_id",
    lambda v: tables.by_id(v.panelists, "panelist_id", "42").select("panelist_id", "hashed_email", "age_range"),
    "SELECT panelist_id, hashed_email, age_range FROM panelists WHERE panelist_id = '42'",
)

# ---- B: event projections ---------------------------------------------------------------------

query(
    "b01_validate_events",
    lambda v: events.validity(v.bodies).groupBy("error_reason").agg(F.count("*").alias("n")),
    f"SELECT {REASON_SQL} AS error_reason, count(*) AS n FROM raw_events GROUP BY 1",
)
query(
    "b02_validation_errors",
    lambda v: v.events.select(
        "event_id",
        F.array_join(events.validation_errors({
            "user_agent": "user_agent is required", "referrer": "referrer is required",
            "campaign_id": "campaign_id is required",
        }), "; ").alias("errors"),
    ),
    """SELECT event_id, concat_ws('; ', CASE WHEN user_agent IS NULL OR trim(user_agent) = '' THEN 'user_agent is required' END,
    CASE WHEN referrer IS NULL THEN 'referrer is required' END) AS errors FROM raw_events""",
)
query(
    "b03_parse_pixel_requests",
    lambda v: events.parse_pixel_requests(v.events.select("event_id", F.concat(
        F.lit("https://t.example/pixel?cid="), F.col("campaign_id"), F.lit("&crid=a%20b%2F"),
        F.col("creative_id"), F.when(F.col("seq") % 2 == 0, F.concat(F.lit("&uid="), "panelist_token")).otherwise(""),
        F.lit("&adserver="), "ad_server",
    ).alias("url"))).drop("url"),
    """SELECT event_id, campaign_id, concat('a b/', creative_id) AS creative_id,
    CASE WHEN seq % 2 = 0 THEN panelist_token END AS panelist_token, ad_server FROM raw_events""",
)
query(
    "b04_client_ip",
    lambda v: v.headers.select("event_id", events.client_ip("headers").alias("client_ip")),
    """SELECT event_id, CASE seq % 6 WHEN 0 THEN '10.1.2.3' WHEN 1 THEN '51.0.0.9' WHEN 3 THEN '192.168.0.7'
    ELSE 'Unknown' END AS client_ip FROM raw_events""",
)
query(
    "b05_s2s_flag",
    lambda v: v.headers.select("event_id", events.is_s2s("headers").alias("s2s")),
    """SELECT event_id, CASE WHEN regexp_matches(headers_text, '(^|;)X-S2S=') THEN regexp_matches(headers_text, 'X-S2S=TRUE')
    WHEN regexp_matches(headers_text, '(^|;)User-Agent=') THEN regexp_matches(lower(headers_text), 'user-agent=[^;]*(server|bot|curl|wget)')
    ELSE false END AS s2s FROM raw_events""",
)
query(
    "b06_flatten_headers",
    lambda v: v.events.select("event_id", events.flatten_headers(F.create_map(
        F.lit("Via"), F.array(F.lit("a"), F.col("ip")), F.lit("Host"), F.array("ad_server"),
    )).alias("h")).select("event_id", F.col("h")["Via"].alias("via"), F.col("h")["Host"].alias("host")),
    "SELECT event_id, concat('a, ', ip) AS via, ad_server AS host FROM raw_events",
)


def _s2s(v):
    request = F.struct(
        "campaign_id", "creative_id", "panelist_token", "ad_server",
        F.lit("ignored").alias("user_agent"),
        F.when(F.col("seq") % 3 == 0, F.lit(None).cast("timestamp")).otherwise(F.col("timestamp")).alias("timestamp"),
        F.when(F.col("seq") % 5 == 0, F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("k"), (F.col("seq") % 700).cast("string"))).alias("idempotency_key"),
    )
    return events.normalize_s2s(v.headers.select(request.alias("request"), "headers", "seq"), v.now)


query(
    "b07_normalize_s2s",
    lambda v: _s2s(v).select(
        stamp("timestamp").alias("timestamp"), "campaign_id", "creative_id", "panelist_token",
        "user_agent", "device_type", "ip", "ad_server", "s2s_flag", "idempotency_key",
    ),
    f"""WITH h AS (SELECT * REPLACE (CASE seq % 6 WHEN 1 THEN 'curl/8.0' WHEN 3 THEN 'Mozilla/5.0 Chrome/120' WHEN 4 THEN '   '
        WHEN 5 THEN 'MyServer/1.0' ELSE 'Unknown' END AS user_agent,
        CASE seq % 6 WHEN 0 THEN '10.1.2.3' WHEN 1 THEN '51.0.0.9' WHEN 3 THEN '192.168.0.7' ELSE 'Unknown' END AS ip) FROM raw_events)
    SELECT CASE WHEN seq % 3 = 0 THEN '{NOW}.000000' ELSE {ts('timestamp')} END AS timestamp, campaign_id, creative_id,
      panelist_token, user_agent, {views.DEVICE_TRACKER} AS device_type, ip, ad_server, true AS s2s_flag,
      CASE WHEN seq % 5 = 0 THEN NULL ELSE concat('k', seq % 700) END AS idempotency_key FROM h""",
)
query(
    "b08_normalize_consumer",
    lambda v: events.normalize_impressions(v.events, "consumer").withColumn("timestamp_utc", stamp("timestamp_utc")),
    f"""SELECT event_id AS impression_id, {ts('timestamp')} AS timestamp_utc, campaign_id, creative_id,
    panelist_token AS panelist_id, {views.DEVICE_CONSUMER} AS device_type,
    CASE WHEN ip IN ('127.0.0.1', '::1') OR starts_with(ip, '192.168.') OR starts_with(ip, '10.') THEN 'US' ELSE 'Unknown' END AS country,
    user_agent IS NULL OR trim(user_agent) = '' OR regexp_matches(lower(user_agent), '{views.CONSUMER_PATTERN}') AS is_bot,
    CASE WHEN user_agent IS NULL OR trim(user_agent) = '' THEN 'Empty user agent'
      WHEN regexp_matches(lower(user_agent), '{views.CONSUMER_PATTERN}') THEN 'Bot pattern in user agent' END AS bot_reason,
    CASE WHEN s2s_flag THEN 'S2S' ELSE 'Pixel' END AS ingest_source FROM raw_events""",
)


def _classified(v):
    from adgauge.streaming.ingest import classify

    valid, _ = events.split_valid(v.bodies)
    return classify(events.flatten_events(valid, v.now))


query(
    "b09_staging_columns",
    lambda v: events.staging_columns(_classified(v)).select(
        "event_id", "campaign_id", "is_bot", "bot_detection_reason", "country_code", "country_name",
        "city", "region", "latitude", "longitude", "tracking_hash", F.col("date").cast("string").alias("date"),
    ),
    f"""SELECT event_id, campaign_id, ({views.BOT_REASON}) IS NOT NULL AS is_bot, {views.BOT_REASON} AS bot_detection_reason,
    {views.COUNTRY} AS country_code, CASE {views.COUNTRY} WHEN 'US' THEN 'United States' WHEN 'UK' THEN 'United Kingdom'
      WHEN 'DE' THEN 'Germany' WHEN 'FR' THEN 'France' ELSE 'Unknown' END AS country_name,
    CASE {views.COUNTRY} WHEN 'US' THEN 'New York' WHEN 'UK' THEN 'London' WHEN 'DE' THEN 'Berlin' WHEN 'FR' THEN 'Paris' ELSE 'Unknown' END AS city,
    CASE {views.COUNTRY} WHEN 'US' THEN 'NY' WHEN 'UK' THEN 'ENG' WHEN 'DE' THEN 'BE' WHEN 'FR' THEN 'IDF' ELSE 'XX' END AS region,
    CASE {views.COUNTRY} WHEN 'US' THEN 40.7128 WHEN 'UK' THEN 51.5074 WHEN 'DE' THEN 52.52 WHEN 'FR' THEN 48.8566 ELSE 0 END::double AS latitude,
    CASE {views.COUNTRY} WHEN 'US' THEN -74.006 WHEN 'UK' THEN -0.1278 WHEN 'DE' THEN 13.405 WHEN 'FR' THEN 2.3522 ELSE 0 END::double AS longitude,
    concat('h', seq - seq % 4) AS tracking_hash, timestamp::date::varchar AS date
    FROM raw_events WHERE {REASON_SQL} IS NULL""",
)
query(
    "b10_date_parts",
    lambda v: events.add_date_parts(v.events).select(
        "event_id", "year", "month", "day", F.col("date").cast("string").alias("date")),
    """SELECT event_id, year(timestamp)::int AS year, month(timestamp)::int AS month, day(timestamp)::int AS day,
    timestamp::date::varchar AS date FROM raw_events""",
)
FEATURES_SQL = ", ".join(matching.FEATURES)
query(
    "b11_fill_features",
    lambda v: matching.fill_features(v.panelists).select(
        "panelist_id", "age", "gender", "country", "hh_income_bucket", "device_type", "browser"),
    """SELECT panelist_id, coalesce(age, 0) AS age, coalesce(gender, 'Unknown') AS gender, coalesce(country, 'XX') AS country,
    coalesce(hh_income_bucket, 'Unknown') AS hh_income_bucket, coalesce(device_type, 'Unknown') AS device_type,
    coalesce(browser, 'Other') AS browser FROM panelists""",
)
query(
    "b12_encode_features",
    lambda v: matching.encode_features(matching.fill_features(v.scored)).select(
        "campaign_id", "panelist_id", *matching.FEATURES),
    f"SELECT campaign_id, panelist_id, {FEATURES_SQL} FROM features", rounded="age_normalized",
)
query(
    "b13_build_normalized",
    lambda v: events.build_normalized(v.events).select(
        "impression_id", "campaign_id", "device_type", "country", "is_bot", "bot_reason", "ingest_source",
        F.col("processed_date").cast("string").alias("processed_date")),
    """SELECT impression_id, campaign_id, device_type, country, is_bot, bot_reason, ingest_source,
    timestamp_utc::date::varchar AS processed_date FROM impressions""",
)
query(
    "b14_build_exposure_mapping",
    lambda v: _mapping(v).select(
        "impression_id", "panelist_id", "campaign_id", F.col("exposure_date").cast("string").alias("exposure_date"),
        "cohort_type", "matched_control_flag", "propensity_score", "match_id", "country_code", "is_bot"),
    """SELECT i.impression_id, i.panelist_id, i.campaign_id, i.timestamp_utc::date::varchar AS exposure_date,
    CASE WHEN s.panelist_id IS NULL THEN 'unmatched' ELSE 'exposed' END AS cohort_type, s.panelist_id IS NOT NULL AS matched_control_flag,
    s.propensity_score, 'm_' || s.panelist_id AS match_id, i.country AS country_code, i.is_bot
    FROM impressions i LEFT JOIN (SELECT * FROM scored WHERE exposed = 1) s
      ON s.campaign_id = i.campaign_id AND s.panelist_id = i.panelist_id""",
)
query(
    "b30_tagged_impressions",
    lambda v: events.tagged(v.impressions, ["imp_1", "imp_77"]).select("impression_id"),
    "SELECT impression_id FROM impressions WHERE starts_with(impression_id, 'imp_1') OR starts_with(impression_id, 'imp_77')",
)

# ---- H: scalar functions ----------------------------------------------------------------------

query(
    "h01_device_tracker",
    lambda v: v.events.select("event_id", agents.device_tracker("user_agent").alias("device")),
    f"SELECT event_id, {views.DEVICE_TRACKER} AS device FROM raw_events",
)
query(
    "h02_device_consumer",
    lambda v: v.events.select("event_id", agents.device_consumer("user_agent").alias("device")),
    f"SELECT event_id, {views.DEVICE_CONSUMER} AS device FROM raw_events",
)
query(
    "h03_browser",
    lambda v: v.events.select("event_id", agents.browser("user_agent").alias("browser")),
    """SELECT event_id, CASE WHEN user_agent IS NULL OR trim(user_agent) = '' THEN 'Unknown'
    WHEN regexp_matches(lower(user_agent), 'edg/|edge') THEN 'Edge' WHEN regexp_matches(lower(user_agent), 'opr/|opera') THEN 'Opera'
    WHEN contains(lower(user_agent), 'chrome') THEN 'Chrome' WHEN contains(lower(user_agent), 'safari') THEN 'Safari'
    WHEN contains(lower(user_agent), 'firefox') THEN 'Firefox' WHEN regexp_matches(lower(user_agent), 'msie|trident') THEN 'IE'
    ELSE 'Other' END AS browser FROM raw_events""",
)
query(
    "h04_os_name",
    lambda v: v.events.select("event_id", agents.os_name("user_agent").alias("os")),
    """SELECT event_id, CASE WHEN user_agent IS NULL OR trim(user_agent) = '' THEN 'Unknown'
    WHEN regexp_matches(lower(user_agent), 'iphone|ipad|ipod') THEN 'iOS' WHEN contains(lower(user_agent), 'android') THEN 'Android'
    WHEN contains(lower(user_agent), 'windows nt') THEN 'Windows' WHEN regexp_matches(lower(user_agent), 'mac os|macos') THEN 'MacOS'
    WHEN contains(lower(user_agent), 'linux') THEN 'Linux' ELSE 'Other' END AS os FROM raw_events""",
)
query(
    "h05_bot_stream",
    lambda v: v.events.select("event_id", *[c.alias(n) for c, n in zip(
        bots.bot_stream("user_agent"), ("is_bot", "reason"))]),
    f"SELECT event_id, ({views.BOT_REASON}) IS NOT NULL AS is_bot, {views.BOT_REASON} AS reason FROM raw_events",
)

ELIGIBLE_SQL = f"NOT (user_agent IS NULL OR trim(user_agent) = '' OR regexp_matches(lower(user_agent), '{views.CONSUMER_PATTERN}'))"


def _agent_rows(v):
    return v.impressions.join(
        v.events.select(F.col("event_id").alias("impression_id"), "ip", "user_agent", "seq"), "impression_id"
    )


def _raw_rows(v):
    return v.events.select(
        F.col("event_id").alias("impression_id"), F.col("timestamp").alias("timestamp_utc"),
        "ip", "user_agent", "seq", "campaign_id",
    )


# The anchored windows of each address, walked one by one.
ANCHOR_SQL = """WITH RECURSIVE e AS (SELECT ip, epoch_us(timestamp) AS t, event_id FROM raw_events WHERE {where}),
  a AS (SELECT ip, min(t) AS t FROM e GROUP BY ip
    UNION ALL SELECT a.ip, (SELECT min(e.t) FROM e WHERE e.ip = a.ip AND e.t >= a.t + {w}) FROM a
    WHERE EXISTS (SELECT 1 FROM e WHERE e.ip = a.ip AND e.t >= a.t + {w})),
  m AS (SELECT e.*, (SELECT max(a.t) FROM a WHERE a.ip = e.ip AND a.t <= e.t) AS anchor FROM e),
  c AS (SELECT *, row_number() OVER (PARTITION BY ip, anchor ORDER BY t, event_id) AS window_count FROM m)"""


def anchor_sql(where: str, seconds: int, tail: str) -> str:
    return f"SELECT * FROM ({ANCHOR_SQL.format(where=where, w=seconds * 1_000_000)} {tail})"


def _consumer_rated(v):
    eligible = _raw_rows(v).filter(bots.passes_agent_checks("user_agent"))
    rated = rates.anchored_rate(eligible, limit=2, window_seconds=3600)
    flags = rated.select("impression_id", "rate_exceeded")
    rows = _raw_rows(v).join(flags, "impression_id", "left")
    flag, reason = bots.bot_consumer("user_agent", "rate_exceeded")
    return rows.select("impression_id", flag.alias("is_bot"), reason.alias("reason"))


query(
    "h06_bot_consumer", _consumer_rated,
    f"""SELECT r.event_id AS impression_id, b.reason IS NOT NULL AS is_bot, b.reason FROM raw_events r
    JOIN (SELECT x.event_id, CASE WHEN user_agent IS NULL OR trim(user_agent) = '' THEN 'Empty user agent'
      WHEN regexp_matches(lower(user_agent), '{views.CONSUMER_PATTERN}') THEN 'Bot pattern in user agent'
      WHEN w.window_count > 2 THEN 'Rate limit exceeded' END AS reason FROM raw_events x
      LEFT JOIN ({anchor_sql(ELIGIBLE_SQL, 3600, 'SELECT event_id, window_count FROM c')}) w ON w.event_id = x.event_id) b
    ON b.event_id = r.event_id""",
)
UA_SQL = """CASE WHEN user_agent IS NULL OR trim(user_agent) = '' THEN 1.0 WHEN lower(user_agent) = 'unknown' THEN 0.8 ELSE
  (CASE WHEN regexp_matches(lower(user_agent), '{p}|whatsapp|telegram|slack|discord') THEN 1.0 ELSE 0 END)
  + (CASE WHEN regexp_matches(lower(user_agent), 'test|check|monitor|scan|security|penetration|vulnerability') THEN 0.5 ELSE 0 END)
  + (CASE WHEN length(user_agent) < 20 THEN 0.3 ELSE 0 END)
  + (CASE WHEN regexp_matches(lower(user_agent), 'chrome|firefox|safari|edge') THEN 0 ELSE 0.2 END) END::double""".format(p=views.STREAM_PATTERN)
UA_REASONS_SQL = """CASE WHEN user_agent IS NULL OR trim(user_agent) = '' THEN 'missing_user_agent' WHEN lower(user_agent) = 'unknown' THEN 'unknown_user_agent' ELSE
  concat_ws(',', CASE WHEN regexp_matches(lower(user_agent), '{p}|whatsapp|telegram|slack|discord') THEN 'bot_pattern_in_ua' END,
  CASE WHEN regexp_matches(lower(user_agent), 'test|check|monitor|scan|security|penetration|vulnerability') THEN 'suspicious_ua_pattern' END,
  CASE WHEN length(user_agent) < 20 THEN 'suspiciously_short_ua' END,
  CASE WHEN regexp_matches(lower(user_agent), 'chrome|firefox|safari|edge') THEN NULL ELSE 'no_common_browser_in_ua' END) END""".format(p=views.STREAM_PATTERN)


def _scored_cols(part):
    score, reasons = part
    return score.alias("score"), F.array_join(reasons, ",").alias("reasons")


query(
    "h07_ua_score",
    lambda v: v.events.select("event_id", *_scored_cols(bots.ua_score("user_agent"))),
    f"SELECT event_id, {UA_SQL} AS score, {UA_REASONS_SQL} AS reasons FROM raw_events", rounded="score",
)
RATE_CTE = """SELECT event_id, ip, user_agent, headers_text, seq,
  count(*) OVER (PARTITION BY ip ORDER BY epoch_us(timestamp) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS n_minute,
  count(*) OVER (PARTITION BY ip ORDER BY epoch_us(timestamp) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n_hour,
  epoch_us(timestamp) AS t FROM raw_events"""
RAPID_CTE = """SELECT event_id, ip, t, lag(t) OVER (PARTITION BY ip ORDER BY t, event_id) AS lt FROM
  (SELECT event_id, ip, epoch_us(timestamp) AS t FROM raw_events)"""
# A pair counts when both its members lie in the strict trailing window of the event.
RAPID_SQL = f"""SELECT a.event_id, EXISTS (SELECT 1 FROM ({RAPID_CTE}) p WHERE p.ip = a.ip AND p.t <= a.t AND p.lt > a.t - {{w}}
  AND p.t - p.lt < {{gap}}) AS rapid FROM (SELECT event_id, ip, epoch_us(timestamp) AS t FROM raw_events) a"""


def _rate_rows(v):
    return rates.address_rates(_raw_rows(v), gap_ms=20_000)


RATE_PARTS = """(CASE WHEN n_minute > 1 THEN 1.0 ELSE 0 END + CASE WHEN n_hour > 2 THEN 0.8 ELSE 0 END + CASE WHEN rapid THEN 0.6 ELSE 0 END)::double"""
RATE_REASONS = """concat_ws(',', CASE WHEN n_minute > 1 THEN 'rate_limit_exceeded_per_minute:' || n_minute END,
  CASE WHEN n_hour > 2 THEN 'rate_limit_exceeded_per_hour:' || n_hour END, CASE WHEN rapid THEN 'requests_too_rapid' END)"""
RAPID_20S = RAPID_SQL.format(w=60_000_000, gap=20_000_000)
query(
    "h08_rate_score",
    lambda v: _rate_rows(v).select("impression_id", *_scored_cols(
        bots.rate_score("ip", "n_minute", "n_hour", "rapid", 1, 2))),
    f"""SELECT r.event_id AS impression_id, {RATE_PARTS} AS score, {RATE_REASONS} AS reasons
    FROM ({RATE_CTE}) r JOIN ({RAPID_20S}) x ON x.event_id = r.event_id""", rounded="score",
)
_NAMES = "[lower(split_part(h, '=', 1)) for h in string_split(headers_text, ';')]"
_MISSING = f"[c for c in ['accept', 'accept-language', 'accept-encoding'] if NOT list_contains({_NAMES}, c)]"
_ACCEPT = "coalesce(split_part([h for h in string_split(headers_text, ';') if lower(split_part(h, '=', 1)) = 'accept'][1], '=', 2), '')"
_AUTOMATED = f"list_contains({_NAMES}, 'x-automated') OR list_contains({_NAMES}, 'x-bot')"
_PROXIED = f"list_contains({_NAMES}, 'x-forwarded-for') AND NOT list_contains({_NAMES}, 'x-real-ip')"
HEADER_SCORE = f"""(CASE WHEN len({_MISSING}) >= 2 THEN 0.4 ELSE 0 END + CASE WHEN {_AUTOMATED} THEN 1.0 ELSE 0 END
  + CASE WHEN {_ACCEPT} IN ('*/*', '') THEN 0.2 ELSE 0 END + CASE WHEN {_PROXIED} THEN 0.1 ELSE 0 END)::double"""
HEADER_REASONS = f"""concat_ws(',', CASE WHEN len({_MISSING}) >= 2 THEN 'missing_common_headers:' || array_to_string({_MISSING}, ',') END,
  CASE WHEN {_AUTOMATED} THEN 'automation_header_present' END, CASE WHEN {_ACCEPT} IN ('*/*', '') THEN 'suspicious_accept_header' END,
  CASE WHEN {_PROXIED} THEN 'proxy_without_real_ip' END)"""
query(
    "h09_header_score",
    lambda v: v.headers.select("event_id", *_scored_cols(bots.header_score("headers"))),
    f"SELECT event_id, {HEADER_SCORE} AS score, {HEADER_REASONS} AS reasons FROM raw_events", rounded="score",
)


def _fingerprints(v):
    return _raw_rows(v).withColumn("fingerprint", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("fp"), "ip")).otherwise(
        identity.device_fingerprint("user_agent", F.lit("1920x1080"), F.lit(0), F.array(F.lit("pdf")))))


FP_SQL = """SELECT event_id, timestamp, CASE WHEN seq % 3 = 0 THEN 'fp' || ip
  ELSE sha256(coalesce(user_agent, '') || '|1920x1080||pdf') END AS fingerprint FROM raw_events"""
FP_DAY = f"""SELECT event_id, fingerprint, count(*) OVER (PARTITION BY fingerprint ORDER BY epoch_us(timestamp)
  RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS n_day FROM ({FP_SQL})"""
FP_SCORE = "(CASE WHEN n_day > 20 THEN 1.0 WHEN n_day > 5 THEN 0.5 ELSE 0 END + CASE WHEN length(fingerprint) < 16 THEN 0.3 ELSE 0 END)::double"
FP_REASONS = """concat_ws(',', CASE WHEN n_day > 20 THEN 'fingerprint_overused:' || n_day WHEN n_day > 5 THEN 'fingerprint_suspicious_usage:' || n_day END,
  CASE WHEN length(fingerprint) < 16 THEN 'weak_fingerprint' END)"""
query(
    "h10_fingerprint_score",
    lambda v: rates.fingerprint_rate(_fingerprints(v)).select("impression_id", *_scored_cols(
        bots.fingerprint_score("fingerprint", "n_day", 20, 5))),
    f"SELECT event_id AS impression_id, {FP_SCORE} AS score, {FP_REASONS} AS reasons FROM ({FP_DAY})", rounded="score",
)


def _combined(v):
    # The rates of address and fingerprint are independent; both are attached to the same rows.
    rows = _fingerprints(v).join(
        v.headers.select(F.col("event_id").alias("impression_id"), "headers"), "impression_id")
    rated = rates.address_rates(rows, gap_ms=20_000)
    full = rates.fingerprint_rate(rated)
    confidence, is_bot, reasons = bots.combine_scores(
        bots.ua_score("user_agent"), bots.rate_score("ip", "n_minute", "n_hour", "rapid", 1, 2),
        bots.header_score("headers"), bots.fingerprint_score("fingerprint", "n_day", 20, 5),
        threshold=0.66,
    )
    return full.select("impression_id", confidence.alias("confidence"), is_bot.alias("is_bot"),
                       F.array_join(reasons, ",").alias("reasons"))


COMBINED_SQL = f"""SELECT r.event_id AS impression_id, least(({UA_SQL} + {RATE_PARTS} + {HEADER_SCORE} + {FP_SCORE}) / 4, 1.0) AS confidence,
      concat_ws(',', nullif({UA_REASONS_SQL}, ''), nullif({RATE_REASONS}, ''), nullif({HEADER_REASONS}, ''), nullif({FP_REASONS}, '')) AS reasons
      FROM ({RATE_CTE}) r JOIN ({RAPID_20S}) x ON x.event_id = r.event_id JOIN ({FP_DAY}) f ON f.event_id = r.event_id"""
query(
    "h11_combined_score", _combined,
    f"SELECT impression_id, confidence, confidence >= 0.66 AS is_bot, reasons FROM ({COMBINED_SQL})", rounded="confidence",
)
query(
    "h12_device_fingerprint",
    lambda v: v.events.select("event_id", identity.device_fingerprint(
        "user_agent", F.when(F.col("seq") % 2 == 0, "1920x1080"), (F.col("seq") % 3 * 60).cast("int"),
        F.when(F.col("seq") % 4 < 2, F.array(F.lit("pdf"), F.lit("js")))).alias("fingerprint")),
    """SELECT event_id, sha256(coalesce(user_agent, '') || '|' || CASE WHEN seq % 2 = 0 THEN '1920x1080' ELSE '' END || '|'
    || CASE WHEN seq % 3 = 0 THEN '' ELSE (seq % 3 * 60)::varchar END || '|' || CASE WHEN seq % 4 < 2 THEN 'pdf,js' ELSE '' END) AS fingerprint
    FROM raw_events""",
)
query(
    "h13_tracking_hash",
    lambda v: v.events.select("event_id", identity.tracking_hash(
        "campaign_id", F.when(F.col("seq") % 5 > 0, F.col("creative_id")), "panelist_token", "timestamp").alias("hash")),
    """SELECT event_id, substring(to_base64(unhex(sha256(campaign_id || '|' || CASE WHEN seq % 5 > 0 THEN creative_id ELSE '' END || '|'
    || panelist_token || '|' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') || '0Z'))), 1, 16) AS hash FROM raw_events""",
)
query(
    "h14_hash_email",
    lambda v: v.registrations.select("panelist_id", identity.hash_email("email").alias("hash")),
    "SELECT panelist_id, CASE WHEN trim(email) = '' THEN '' ELSE sha256(lower(trim(email))) END AS hash FROM registrations",
)
query(
    "h15_hash_phone",
    lambda v: v.registrations.select("panelist_id", identity.hash_phone("phone").alias("hash")),
    "SELECT panelist_id, coalesce(sha256(regexp_replace(phone, '[^0-9]', '', 'g')), '') AS hash FROM registrations",
)
query(
    "h16_age_range",
    lambda v: v.registrations.select("panelist_id", identity.age_range("age").alias("age_range")),
    f"SELECT panelist_id, {views.AGE_RANGE} AS age_range FROM registrations",
)
query(
    "h17_country_by_octet",
    lambda v: v.events.select("event_id", geo.country_by_octet("ip").alias("country")),
    f"SELECT event_id, {views.COUNTRY} AS country FROM raw_events",
)
# ranges of three widths that lie in each other, from the suppliers and their nations
RANGES = {
    "low": "concat(1 + s_suppkey % 250, CASE s_suppkey % 3 WHEN 0 THEN '.0.0.0' WHEN 1 THEN '.0.64.0' ELSE '.0.113.17' END)",
    "high": "concat(1 + s_suppkey % 250, CASE s_suppkey % 3 WHEN 0 THEN '.255.255.255' WHEN 1 THEN '.0.113.99' ELSE concat('.0.113.', 20 + s_suppkey % 170) END)",
    "country": "concat('N', s_nationkey)",
}
_NUMBER = "list_reduce(list_transform(string_split({0}, '.'), lambda x: x::bigint), lambda a, b: a * 256 + b)"
query(
    "h17_country_by_ranges",
    lambda v: addresses.by_ranges(v.events.select("event_id", "ip"), v.table("supplier").selectExpr(*[f"{e} AS {n}" for n, e in RANGES.items()])).select("event_id", "country"),
    f"""WITH r AS (SELECT {_NUMBER.format('low')} AS low, {_NUMBER.format('high')} AS high, country FROM (SELECT {', '.join(f'{e} AS {n}' for n, e in RANGES.items())} FROM supplier)),
      e AS (SELECT event_id, {_NUMBER.format('ip')} AS n FROM raw_events)
    SELECT event_id, coalesce(min({{'w': high - low, 'low': low, 'c': country}}).c, 'XX') AS country FROM e LEFT JOIN r ON n BETWEEN low AND high GROUP BY event_id""",
)
query(
    "h18_country_attributes",
    lambda v: events.enrich_geo(v.events).groupBy(
        "country_code", "country_name", "city", "region", "latitude", "longitude").agg(F.count("*").alias("n")),
    f"""SELECT country AS country_code, a.country_name, a.city, a.region, a.latitude::double AS latitude, a.longitude::double AS longitude, count(*) AS n
    FROM impressions JOIN (VALUES ('US','United States','New York','NY',40.7128,-74.0060), ('UK','United Kingdom','London','ENG',51.5074,-0.1278),
     ('DE','Germany','Berlin','BE',52.52,13.405), ('FR','France','Paris','IDF',48.8566,2.3522), ('XX','Unknown','Unknown','XX',0,0))
     a(code, country_name, city, region, latitude, longitude) ON a.code = country GROUP BY ALL""",
)
query(
    "h19_country_consumer",
    lambda v: v.events.select("event_id", geo.country_consumer("ip").alias("country")),
    "SELECT event_id, CASE WHEN starts_with(ip, '10.') OR starts_with(ip, '192.168.') THEN 'US' ELSE 'Unknown' END AS country FROM raw_events",
)


def _consent(v):
    given, at = identity.derive_consent("consent_given", "consent_gdpr", "consent_ccpa", v.now)
    return v.registrations.select("panelist_id", given.alias("given"), stamp(at).alias("consented_at"))


query(
    "h20_derive_consent", _consent,
    f"SELECT panelist_id, consent_given AS given, CASE WHEN consent_given THEN '{NOW}.000000' END AS consented_at FROM panelists",
)


def _coded(v):
    likert = F.array(*map(F.lit, views.LIKERT))
    joined = v.responses.select("response_id", F.explode("answers").alias("a")).select("response_id", "a.*")
    kind = F.create_map(*[F.lit(x) for q in views.QUESTIONS for x in (q[0], q[2])])[F.col("question_id")]
    return joined.select("response_id", "question_id",
                         survey.answer_index(kind, likert, "answer").alias("form_value"),
                         survey.answer_value(kind, likert, "answer").alias("value"))


query(
    "h21_answer_coding", _coded,
    """SELECT response_id, question_id, CASE question_id WHEN 'q2' THEN 2 - numeric_value ELSE numeric_value END AS form_value,
    numeric_value AS value FROM answers""",
)
query(
    "h22_metric_label",
    lambda v: v.metrics.groupBy(text.metric_label("metric_name").alias("label")).agg(F.count("*").alias("n")),
    """SELECT CASE metric_name WHEN 'brand_awareness' THEN 'Brand Awareness' WHEN 'purchase_intent' THEN 'Purchase Intent'
    WHEN 'brand_favorability' THEN 'Brand Favorability' END AS label, count(*) AS n FROM metrics GROUP BY 1""",
)
query(
    "h23_stars_and_step_p",
    lambda v: v.events.select("event_id", F.round((F.col("event_value") - 50) / 15, 4).alias("t")).select(
        "event_id", stats.step_p("t").alias("p"), stats.stars(stats.step_p("t")).alias("stars")),
    """SELECT event_id, p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM (
    SELECT event_id, CASE WHEN abs(t) > 2.576 THEN 0.001 WHEN abs(t) > 1.96 THEN 0.01 WHEN abs(t) > 1.645 THEN 0.05 ELSE 0.1 END::double AS p
    FROM (SELECT event_id, round((event_value - 50) / 15, 4) AS t FROM raw_events))""",
)

# Two-sided p of the t distribution for whole degrees of freedom, as the finite trigonometric series.
T_P_SQL = """CASE WHEN {t} IS NULL THEN NULL WHEN {t} = 0 THEN 1.0 ELSE 1 - (CASE WHEN {v} % 2 = 0 THEN
    sin(atan(abs({t}) / sqrt({v}))) * list_sum(list_transform(range(0, ({v} // 2)::bigint),
      lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1.0) + 2 * j * ln(cos(atan(abs({t}) / sqrt({v})))))) ) / sqrt(pi())
  WHEN {v} = 1 THEN 2 / pi() * atan(abs({t}))
  ELSE 2 / pi() * (atan(abs({t}) / sqrt({v})) + sin(atan(abs({t}) / sqrt({v}))) * cos(atan(abs({t}) / sqrt({v})))
    * list_sum(list_transform(range(0, (({v} - 1) // 2)::bigint), lambda j: sqrt(pi()) / 2 * exp(lgamma(j + 1.0) - lgamma(j + 1.5)
      + 2 * j * ln(cos(atan(abs({t}) / sqrt({v})))))))) END) END"""


def t_p_sql(t: str, v: str) -> str:
    return T_P_SQL.format(t=t, v=v)


query(
    "h24_t_pvalue",
    lambda v: v.lift.select("campaign_id", "metric_name", "t_statistic", "degrees_of_freedom",
                            stats.t_pvalue("t_statistic", F.col("degrees_of_freedom").cast("double")).alias("p")),
    f"SELECT campaign_id, metric_name, t_statistic, degrees_of_freedom, {t_p_sql('t_statistic', 'degrees_of_freedom')} AS p FROM lift",
    rounded="t_statistic p",
)


def _ci(v):
    # the same values again as means of a sample of one, and of none
    sized = v.lift.withColumn("n", F.explode(F.array(F.col("exposed_sample_size"), F.lit(1), F.lit(0))))
    low, high = stats.mean_ci("exposed_value", "exposed_std_dev", "n")
    low99, high99 = stats.mean_ci("exposed_value", "exposed_std_dev", "n", 0.99)
    return sized.select(
        "campaign_id", "metric_name", low.alias("low"), high.alias("high"),
        low99.alias("low99"), high99.alias("high99"))


query(
    "h25_mean_ci", _ci,
    """SELECT campaign_id, metric_name, CASE WHEN n < 2 THEN exposed_value ELSE round_even(exposed_value - 1.96 * m, 2) END AS low,
    CASE WHEN n < 2 THEN exposed_value ELSE round_even(exposed_value + 1.96 * m, 2) END AS high,
    CASE WHEN n < 2 THEN exposed_value ELSE round_even(exposed_value - 2.576 * m, 2) END AS low99,
    CASE WHEN n < 2 THEN exposed_value ELSE round_even(exposed_value + 2.576 * m, 2) END AS high99
    FROM (SELECT *, CASE WHEN n > 0 THEN exposed_std_dev / sqrt(n) END AS m FROM (SELECT *, unnest([exposed_sample_size, 1, 0]) AS n FROM lift))""",
    rounded="low high low99 high99",
)


def _windows(v):
    start, end = survey.window_dates("timestamp")
    return v.events.select("event_id", start.cast("string").alias("start"), end.cast("string").alias("finish"),
                           stamp(survey.to_utc("timestamp", "+02:00")).alias("utc"))


query(
    "h26_utc_and_window", _windows,
    f"""SELECT event_id, (timestamp::date - 30)::varchar AS start, timestamp::date::varchar AS finish,
    {ts("timestamp - INTERVAL 2 HOUR")} AS utc FROM raw_events""",
)
query(
    "h27_batch_id",
    lambda v: v.events.select("event_id", survey.batch_id("psm", "campaign_id", "timestamp").alias("batch_id")),
    "SELECT event_id, 'psm_' || campaign_id || '_' || strftime(timestamp, '%Y%m%d_%H%M%S') AS batch_id FROM raw_events",
)
query(
    "h28_cohort_definition",
    lambda v: v.flat_campaigns.select("campaign_id", survey.cohort_definition(
        F.concat(F.lit("b_"), "campaign_id")).alias("definition")),
    """SELECT campaign_id, '{"batch_id":"b_' || campaign_id || '","matching_method":"propensity_score_matching","caliper":0.1}' AS definition FROM campaigns""",
)
query(
    "h29_split_interests",
    lambda v: v.registrations.select("panelist_id", F.explode(text.split_list("interests")).alias("interest")),
    """SELECT panelist_id, interest FROM (SELECT panelist_id, trim(unnest(string_split(interests, ','))) AS interest FROM registrations)
    WHERE interest <> ''""",
)
query(
    "h30_labels",
    lambda v: v.registrations.select("panelist_id", agents.or_unknown("device_type").alias("device"),
                                     agents.source_label("consent_given").alias("source")),
    """SELECT panelist_id, coalesce(device_type, 'Unknown') AS device, CASE WHEN consent_given THEN 'S2S' ELSE 'Pixel' END AS source FROM registrations""",
)

# ---- F: rates ---------------------------------------------------------------------------------

query(
    "f02_trailing_counts",
    lambda v: rates.ip_rate(_raw_rows(v), per_minute=1, per_hour=2).select(
        "impression_id", "n_minute", "n_hour", "minute_exceeded", "hour_exceeded"),
    f"""SELECT event_id AS impression_id, n_minute, n_hour, n_minute > 1 AS minute_exceeded, n_hour > 2 AS hour_exceeded FROM ({RATE_CTE})""",
)
query(
    "f03_rapid_succession",
    lambda v: rates.rapid(_raw_rows(v), gap_ms=20_000).select("impression_id", "rapid"),
    f"SELECT event_id AS impression_id, rapid FROM ({RAPID_20S})",
)
query(
    "f04_fingerprint_rate",
    lambda v: rates.fingerprint_rate(_fingerprints(v), overused=20, suspicious=5).select(
        "impression_id", "n_day", "fingerprint_usage"),
    f"""SELECT event_id AS impression_id, n_day, CASE WHEN n_day > 20 THEN 'overused' WHEN n_day > 5 THEN 'suspicious' ELSE 'normal' END AS fingerprint_usage
    FROM ({FP_DAY})""",
)
query(
    "f05_anchored_rate",
    lambda v: rates.anchored_rate(_raw_rows(v).filter(bots.passes_agent_checks("user_agent")), limit=2, window_seconds=3600).select(
        "impression_id", "window_count", "rate_exceeded"),
    anchor_sql(ELIGIBLE_SQL, 3600, "SELECT event_id AS impression_id, window_count, window_count > 2 AS rate_exceeded FROM c"),
)
ADMITTED_SQL = """WITH RECURSIVE o AS (SELECT ip, event_id, epoch_us(timestamp) AS t, row_number() OVER (PARTITION BY ip ORDER BY timestamp, event_id) AS r FROM raw_events),
      f AS (SELECT ip, event_id, r, [t] AS kept, true AS allowed FROM o WHERE r = 1
        UNION ALL SELECT ip, event_id, r, CASE WHEN len(live) < 2 THEN list_append(live, t) ELSE live END, len(live) < 2
        FROM (SELECT o.ip, o.event_id, o.r, o.t, list_filter(f.kept, lambda x: x >= o.t - 43200000000) AS live FROM f JOIN o ON o.ip = f.ip AND o.r = f.r + 1))
    SELECT event_id AS impression_id, allowed FROM f"""
query(
    "f06_sliding_admission",
    lambda v: rates.admitted(_raw_rows(v), limit=2, window_seconds=43200).select("impression_id", "allowed"),
    ADMITTED_SQL,
)
query(
    "f07_quota",
    lambda v: rates.quota(
        rates.admitted_instants(rates.points(_raw_rows(v), "ip", "timestamp_utc"), 2, 259200),
        v.now, 2, 259200),
    f"""WITH RECURSIVE o AS (SELECT ip, epoch_us(timestamp) AS t, row_number() OVER (PARTITION BY ip ORDER BY timestamp, event_id) AS r
        FROM raw_events WHERE timestamp <= timestamp '{NOW}'),
      f AS (SELECT ip, r, [t] AS kept FROM o WHERE r = 1
        UNION ALL SELECT ip, r, CASE WHEN len(live) < 2 THEN list_append(live, t) ELSE live END
        FROM (SELECT o.ip, o.r, o.t, list_filter(f.kept, lambda x: x >= o.t - 259200000000) AS live FROM f JOIN o ON o.ip = f.ip AND o.r = f.r + 1)),
      k AS (SELECT ip, list_filter(arg_max(kept, r), lambda x: x >= epoch_us(timestamp '{NOW}') - 259200000000) AS kept FROM f GROUP BY ip)
    SELECT ip AS key, greatest(0, 2 - len(kept))::bigint AS remaining,
    greatest(0.0, coalesce((list_min(kept) + 259200000000 - epoch_us(timestamp '{NOW}')) / 1000000.0, 0.0))::double AS reset_seconds FROM k""",
    rounded="reset_seconds",
)
