"""Raw events: decode, validate, classify and normalise. The same code serves batch and stream."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from adgauge import schemas
from adgauge.functions import agents, bots, geo, identity
from adgauge.functions.text import any_token, as_col, is_blank, stable_id


def decode_body(df: DataFrame, schema: StructType = schemas.TRACKING_EVENT) -> DataFrame:
    """Adds `data` (decoded body) and `malformed` (the body is no JSON object of the schema).

    The decoded struct comes out of a one-row generator. Filters on its fields cannot be moved
    below a generator, so each body is decoded once however many fields are tested and read.
    """
    with_corrupt = StructType(schema.fields[:]).add("_corrupt_record", "string")
    body = F.col("body").cast("string")
    decoded = F.from_json(body, with_corrupt, {"columnNameOfCorruptRecord": "_corrupt_record"})
    return df.select("*", F.explode(F.array(decoded)).alias("_decoded")).select(
        *df.columns,
        F.col("_decoded._corrupt_record").isNotNull().alias("malformed"),
        F.struct(*[F.col(f"_decoded.{f.name}") for f in schema.fields]).alias("data"),
    )


def flatten_events(decoded: DataFrame, processed_at: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """Decoded rows as event columns, the envelope renamed, the event time cast; `carry` names more columns to keep."""
    envelope = [
        F.col(source).alias(name)
        for source, name in schemas.ENVELOPE.items()
        if source in decoded.columns
    ]
    return decoded.select("data.*", *envelope, *carry).withColumns({
        "timestamp": F.try_to_timestamp("timestamp"), "processed_at": processed_at,
    })


def parse_events(df: DataFrame, processed_at: Column) -> DataFrame:
    """Raw bodies as event columns; a body that does not decode gives null fields."""
    return flatten_events(decode_body(df), processed_at)


def validity(df: DataFrame) -> DataFrame:
    """Adds `error_reason`: null for an event that may go on, else why it is a dead letter."""
    decoded = decode_body(df)
    body = F.col("body").cast("string")
    reason = (
        F.when(is_blank(body) | (F.trim(body) == "null"), "Deserialization failed")
        .when(F.col("malformed"), "JSON error: body does not decode")
        .when(is_blank("data.event_id") | is_blank("data.campaign_id"), "Missing required fields")
    )
    return decoded.withColumn("error_reason", reason).drop("malformed")


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, dead letters): two filters over the decoded rows."""
    return split_judged(validity(df))


def split_judged(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, dead letters) of rows that `validity` has judged."""
    return (
        judged.filter(F.col("error_reason").isNull()).drop("error_reason"),
        judged.filter(F.col("error_reason").isNotNull()).drop("data"),
    )


def route_failures(df: DataFrame, max_retries: int = 3) -> DataFrame:
    """Adds `route`: ok, retry or dead_letter, from `error_reason`, `failure` and the feed's `retry_count`.

    Data errors are dead letters at once; a failure (why processing failed, or null) is tried again until the
    event has been retried `max_retries` times.
    """
    data_error = F.col("error_reason").isNotNull()
    spent = F.coalesce(F.col("retry_count"), F.lit(0)) >= max_retries
    failed = F.col("failure").isNotNull()
    return df.withColumn(
        "route",
        F.when(data_error | (failed & spent), "dead_letter").when(failed, "retry").otherwise("ok"),
    )


def split_routed(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events to go on, dead letters with their reason) of rows that `route_failures` has routed."""
    spent = F.concat(F.lit("Max retries exceeded: "), F.col("failure"))
    dead = routed.filter("route = 'dead_letter'").withColumn("error_reason", F.coalesce("error_reason", spent))
    return routed.filter("route = 'ok'").drop("error_reason"), dead.drop("data")


def validation_errors(required: dict[str, str]) -> Column:
    """All missing fields at once: field -> message; an empty list when the row is good."""
    return F.array_compact(F.array(*[F.when(is_blank(c), m) for c, m in required.items()]))


def parse_pixel_requests(df: DataFrame, url: str = "url") -> DataFrame:
    """Query parameters of pixel requests, decoded."""
    names = {
        "cid": "campaign_id", "crid": "creative_id", "uid": "panelist_token", "adserver": "ad_server",
    }
    return df.select(
        "*",
        *[
            F.try_url_decode(F.try_parse_url(F.col(url), F.lit("QUERY"), F.lit(key))).alias(name)
            for key, name in names.items()
        ],
    )


def header(headers, name: str) -> Column:
    """Header value by name, any case; null when absent."""
    return bots.header_value(headers, name)


def client_ip(headers) -> Column:
    forwarded = F.trim(F.split(header(headers, "X-Forwarded-For"), ",")[0])
    real = header(headers, "X-Real-IP")
    return (
        F.when(~is_blank(forwarded), forwarded).when(~is_blank(real), real).otherwise("Unknown")
    )


# Agent tokens that mark a server call.
SERVER_TOKENS = ("server", "bot", "curl", "wget")


def is_s2s(headers) -> Column:
    flag, agent = header(headers, "X-S2S"), header(headers, "User-Agent")
    return (
        F.when(flag.isNotNull(), F.lower(flag) == "true")
        .when(agent.isNotNull(), is_blank(agent) | any_token(agent, SERVER_TOKENS))
        .otherwise(False)
    )


def flatten_headers(headers) -> Column:
    """map<string,array<string>> to map<string,string>."""
    return F.transform_values(as_col(headers), lambda _, values: F.array_join(values, ", "))


def normalize_s2s(df: DataFrame, now: Column) -> DataFrame:
    """S2S requests (`request` struct and `headers` map) in the tracker's event schema."""
    r, h = F.col("request"), F.col("headers")
    agent = F.coalesce(header(h, "User-Agent"), F.lit("Unknown"))
    stamp = F.coalesce(r["timestamp"], now)
    base = df.select(
        "*", agent.alias("user_agent"), stamp.alias("timestamp"), client_ip(h).alias("ip"),
    )
    return base.select(
        stable_id("evt_", r["idempotency_key"], r["campaign_id"], r["creative_id"],
                  r["panelist_token"], F.col("timestamp")).alias("event_id"),
        "timestamp",
        r["campaign_id"].alias("campaign_id"),
        r["creative_id"].alias("creative_id"),
        r["panelist_token"].alias("panelist_token"),
        "user_agent",
        agents.device_tracker("user_agent").alias("device_type"),
        "ip",
        header(h, "Referer").alias("referrer"),
        r["ad_server"].alias("ad_server"),
        F.lit(True).alias("s2s_flag"),
        h.alias("raw_headers"),
        identity.tracking_hash(
            r["campaign_id"], r["creative_id"], r["panelist_token"], F.col("timestamp")
        ).alias("tracking_hash"),
        r["idempotency_key"].alias("idempotency_key"),
    )


def apply_bot_rules(
    df: DataFrame, rules: str = "stream", rate_exceeded: str | None = None, limits: dict | None = None
) -> DataFrame:
    """Adds is_bot and bot_detection_reason by the named rule set; `scored` needs the counts of `bot_scored`."""
    if rules == "stream":
        flag, reason = bots.bot_stream("user_agent")
    elif rules == "consumer":
        flag, reason = bots.bot_consumer("user_agent", rate_exceeded)
    elif rules == "scored":
        flag, reason = bots.bot_scored(limits=limits)
    else:
        raise ValueError(f"unknown bot rules: {rules}")
    return df.withColumns({"is_bot": flag, "bot_detection_reason": reason})


def enrich_geo(df: DataFrame, rules: str = "octet") -> DataFrame:
    """Adds country_code and its attributes."""
    country = {"octet": geo.country_by_octet, "consumer": geo.country_consumer}[rules]("ip")
    coded = df.withColumn("country_code", country)
    return coded.withColumns(geo.country_attributes("country_code"))


def add_date_parts(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.withColumns({
        "year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "date": F.to_date(ts),
    })


def staging_columns(df: DataFrame) -> DataFrame:
    return df.select(*schemas.STAGING_COLUMNS)


# Rule sets by name -> (bot rules, geo rules, device rule).
RULE_SETS = {
    "stream": (bots.bot_stream, geo.country_by_octet, agents.device_tracker),
    "consumer": (bots.bot_consumer, geo.country_consumer, agents.device_consumer),
}


def normalize_impressions(df: DataFrame, rules: str = "stream", rate_exceeded: str | None = None) -> DataFrame:
    """Tracking events as normalized impressions; `rate_exceeded` names the rate flag of the consumer rules."""
    bot_rule, country_rule, device_rule = RULE_SETS[rules]
    flag, reason = bot_rule("user_agent", rate_exceeded) if rate_exceeded else bot_rule("user_agent")
    return df.select(
        F.col("event_id").alias("impression_id"),
        F.col("timestamp").alias("timestamp_utc"),
        "campaign_id",
        "creative_id",
        F.col("panelist_token").alias("panelist_id"),
        device_rule("user_agent").alias("device_type"),
        country_rule("ip").alias("country"),
        flag.alias("is_bot"),
        reason.alias("bot_reason"),
        agents.source_label("s2s_flag").alias("ingest_source"),
    )


def build_normalized(df: DataFrame, rules: str = "stream") -> DataFrame:
    """The normalized-impressions feed, ready to be written by `processed_date`."""
    return normalize_impressions(df, rules).withColumn("processed_date", F.to_date("timestamp_utc"))


def tagged(df: DataFrame, prefixes: Iterable[str], column: str = "impression_id") -> DataFrame:
    condition = F.lit(False)
    for prefix in prefixes:
        condition = condition | F.col(column).startswith(prefix)
    return df.filter(condition)
