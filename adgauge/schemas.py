"""Wire and table schemas. All instants are UTC. Built without a session."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructType,
    TimestampType,
)

TEXT, FLAG, INT, LONG = StringType(), BooleanType(), IntegerType(), LongType()
DOUBLE, INSTANT, DAY, MONEY = DoubleType(), TimestampType(), DateType(), DecimalType(18, 2)
TEXTS, TEXT_MAP = ArrayType(TEXT), MapType(TEXT, TEXT)


def fields(*columns: tuple[str, DataType]) -> StructType:
    """Struct of (names, type) groups; names are separated by blanks."""
    struct = StructType()
    for names, kind in columns:
        for name in names.split():
            struct = struct.add(name, kind)
    return struct


TRACKING_EVENT = fields(
    ("event_id timestamp campaign_id creative_id panelist_token user_agent device_type ip referrer "
     "ad_server", TEXT),
    ("s2s_flag", FLAG), ("raw_headers", TEXT_MAP), ("tracking_hash", TEXT),
)

ENVELOPE = {
    "enqueuedTime": "eventhub_enqueued_time",
    "offset": "eventhub_offset",
    "sequenceNumber": "eventhub_sequence_number",
    "publisher": "eventhub_publisher",
    "partitionKey": "eventhub_partition_key",
}

RAW_EVENT = fields(
    ("body", TEXT), ("enqueuedTime", INSTANT), ("offset", TEXT), ("sequenceNumber", LONG),
    ("publisher partitionKey", TEXT), ("retry_count", INT),
)

S2S_REQUEST = fields(
    ("campaign_id creative_id panelist_token ad_server user_agent ip_address referrer", TEXT),
    ("custom_data", TEXT_MAP), ("idempotency_key", TEXT), ("timestamp", INSTANT),
)

NORMALIZED_IMPRESSION = fields(
    ("impression_id", TEXT), ("timestamp_utc", INSTANT),
    ("campaign_id creative_id panelist_id device_type country", TEXT), ("is_bot", FLAG),
    ("bot_reason ingest_source", TEXT), ("processed_date", DAY),
)

CREATIVES = ArrayType(fields(("creative_id format size message variant_name", TEXT)))
ACTUAL_METRICS = fields(("impressions reach", LONG), ("average_lift", DOUBLE))
CAMPAIGN = fields(
    ("campaign_id campaign_name advertiser industry", TEXT), ("start_date end_date", INSTANT),
    ("budget", MONEY), ("status", TEXT),
    ("target_audience", fields(("age_range gender interests countries", TEXTS))),
    ("creatives", CREATIVES),
    ("kpis", fields(("target_impressions target_reach", LONG), ("target_lift", DOUBLE))),
    ("actual_metrics", ACTUAL_METRICS), ("created_at updated_at", INSTANT),
)

PANELIST = fields(
    ("id panelist_id hashed_email hashed_phone email first_name last_name age_range", TEXT),
    ("age", INT),
    ("gender hh_income_bucket interests country postal_code device_type browser", TEXT),
    ("consent_gdpr consent_ccpa consent_given", FLAG), ("consent_timestamp last_active", INSTANT),
    ("points_balance", INT), ("is_active", FLAG), ("created_at updated_at", INSTANT),
)

QUESTION = fields(
    ("question_id question_text question_type metric", TEXT), ("options", TEXTS), ("scale", INT),
    ("required", FLAG), ("order", INT),
)
SURVEY = fields(
    ("survey_id campaign_id survey_name description survey_type status", TEXT),
    ("questions", ArrayType(QUESTION)), ("target_audience", TEXT),
    ("distribution_start_date distribution_end_date created_at updated_at", INSTANT),
)

ANSWERS = ArrayType(fields(("question_id answer", TEXT), ("numeric_value", DOUBLE)))
SURVEY_RESPONSE = fields(
    ("response_id survey_id campaign_id panelist_id cohort_type", TEXT), ("answers", ANSWERS),
    ("completed_at", INSTANT), ("response_time", INT), ("device_type", TEXT),
    ("impression_count", INT), ("status", TEXT), ("created_at", INSTANT),
)

EXPOSURE_MAPPING = fields(
    ("exposure_id panelist_id impression_id campaign_id creative_id", TEXT),
    ("impression_ts", INSTANT), ("exposure_date", DAY), ("matched_control_flag", FLAG),
    ("cohort_type", TEXT), ("propensity_score", DOUBLE), ("match_id", TEXT),
    ("match_quality_score", DOUBLE), ("device_type country_code", TEXT), ("is_bot", FLAG),
    ("bot_reason", TEXT), ("created_at updated_at", INSTANT), ("processing_batch_id", TEXT),
)

MATCHED_COHORTS = fields(
    ("panelist_id campaign_id impression_id match_id", TEXT),
    ("propensity_score match_quality_score", DOUBLE), ("cohort_type", TEXT),
    ("matched_control_flag", FLAG), ("balance_score", DOUBLE), ("processing_ts", INSTANT),
    ("processing_batch_id", TEXT),
)

SURVEY_METRICS = fields(
    ("panelist_id campaign_id metric_name", TEXT), ("metric_value", DOUBLE),
    ("survey_date", INSTANT), ("demographic_segment", TEXT),
)

# The columns kept in the staging table, in order.
STAGING_COLUMNS = [
    "event_id", "timestamp", "campaign_id", "creative_id", "panelist_token", "user_agent",
    "device_type", "ip", "referrer", "ad_server", "s2s_flag", "is_bot", "bot_detection_reason",
    "country_code", "country_name", "city", "region", "latitude", "longitude",
    "tracking_hash", "processed_at", "date",
]
