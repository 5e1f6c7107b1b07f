"""Change feeds applied to tables: insert-only, upsert, patch, delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adgauge.functions.identity import age_range, derive_consent, hash_email, hash_phone


def last_per_key(feed: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the greatest in `order`. Partial aggregation keeps a hot key small."""
    row = F.struct(*[F.col(c) for c in feed.columns])
    place = F.struct(*[F.col(c) for c in order])
    return feed.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, place).alias("r")).select("r.*")


def first_per_key(feed: DataFrame, key: str, order: list[str]) -> DataFrame:
    row = F.struct(*[F.col(c) for c in feed.columns])
    place = F.struct(*[F.col(c) for c in order])
    return feed.groupBy(F.col(key).alias("_key")).agg(F.min_by(row, place).alias("r")).select("r.*")


def _by_key(feed: DataFrame, key: str, order: list[str], reduce) -> DataFrame:
    """One row per key by `reduce`, and every row without a key: those are different rows."""
    keyed = reduce(feed.filter(F.col(key).isNotNull()), key, order)
    return keyed.unionByName(feed.filter(F.col(key).isNull()).select(*keyed.columns))


def last_of_each(feed: DataFrame, key: str, order: list[str]) -> DataFrame:
    return _by_key(feed, key, order, last_per_key)


def insert_new(target: DataFrame, feed: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Target plus the feed rows with new keys; an existing id wins, the first new one wins.

    Rows without a key are all added.
    """
    fresh = _by_key(feed, key, order, first_per_key).join(target.select(key), key, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def upsert_latest(target: DataFrame, feed: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Target with the feed's last row of each key replacing or joining it; rows without a key join."""
    latest = last_of_each(feed, key, order)
    return target.join(latest.select(key), key, "left_anti").unionByName(
        latest.select(*target.columns)
    )


def _patched(target: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    """Target rows with the change of their key as struct `c` (null without a change)."""
    change = feed.select(F.col(key), F.struct(*[F.col(c) for c in feed.columns]).alias("c"))
    return target.join(change, key, "left")


def _changed() -> Column:
    return F.col("c").isNotNull()


def _keep(name: str) -> Column:
    """Null in the change keeps the stored value."""
    return F.coalesce(F.col(f"c.{name}"), F.col(name))


def create_panelists(feed: DataFrame, now: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """New panelist rows from registration requests: hashes, age range, consent, defaults.

    `carry` names further feed columns to keep as they are.
    """
    consent, stamp = derive_consent("consent_given", "consent_gdpr", "consent_ccpa", now)
    hashed_phone = hash_phone("phone")
    return feed.select(
        F.col("panelist_id").alias("id"),
        "panelist_id",
        hash_email("email").alias("hashed_email"),
        F.when(hashed_phone != "", hashed_phone).alias("hashed_phone"),
        "email", "first_name", "last_name",
        F.coalesce("age_range", age_range("age")).alias("age_range"),
        "age", "gender", "hh_income_bucket", "interests", "country", "postal_code",
        "device_type", "browser",
        F.coalesce("consent_gdpr", F.lit(False)).alias("consent_gdpr"),
        F.coalesce("consent_ccpa", F.lit(False)).alias("consent_ccpa"),
        consent.alias("consent_given"),
        stamp.alias("consent_timestamp"),
        now.alias("last_active"),
        F.lit(0).alias("points_balance"),
        F.lit(True).alias("is_active"),
        now.alias("created_at"),
        now.alias("updated_at"),
        *carry,
    )


# Panelist columns a patch replaces as they are.
PANELIST_PLAIN = [
    "first_name", "last_name", "age", "gender", "hh_income_bucket", "interests", "country",
    "postal_code", "device_type", "browser", "consent_gdpr", "consent_ccpa", "consent_given",
    "points_balance", "is_active",
]


def update_panelists(
    target: DataFrame, feed: DataFrame, now: Column, order: list[str] = ["change_seq"]
) -> DataFrame:
    """Panelists after the last patch of each id. Null keeps; a hash follows its source; an
    explicit age range beats the one from age; the consent stamp moves when a flag turns true."""
    patched = _patched(target, last_per_key(feed, "panelist_id", order), "panelist_id")
    consented = F.lit(False)
    for flag in ("consent_gdpr", "consent_ccpa", "consent_given"):
        consented = consented | F.coalesce(F.col(f"c.{flag}"), F.lit(False))
    values = {name: _keep(name) for name in PANELIST_PLAIN if name in target.columns}
    values |= {
        "email": _keep("email"),
        "hashed_email": F.when(F.col("c.email").isNotNull(), hash_email("c.email"))
        .otherwise(F.col("hashed_email")),
        "hashed_phone": F.when(F.col("c.phone").isNotNull(), hash_phone("c.phone"))
        .otherwise(F.col("hashed_phone")),
        "age_range": F.coalesce("c.age_range", age_range("c.age"), "age_range"),
        "consent_timestamp": F.when(consented, now).otherwise(F.col("consent_timestamp")),
        "last_active": F.when(_changed(), now).otherwise(F.col("last_active")),
        "updated_at": F.when(_changed(), now).otherwise(F.col("updated_at")),
    }
    return patched.select(*[
        values.get(name, F.col(name)).alias(name) for name in target.columns
    ])


def soft_delete(target: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Panelists with the listed ids set inactive."""
    gone = ids.select("panelist_id").distinct().withColumn("gone", F.lit(True))
    joined = target.join(gone, "panelist_id", "left")
    hit = F.coalesce(F.col("gone"), F.lit(False))
    changed = {
        "is_active": F.when(hit, F.lit(False)).otherwise(F.col("is_active")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in target.columns])


def campaign_status(now: Column, start="start_date", end="end_date") -> Column:
    return (
        F.when(now < F.col(start), "Scheduled").when(now <= F.col(end), "Active")
        .otherwise("Completed")
    )


def create_campaigns(feed: DataFrame, now: Column) -> DataFrame:
    """New campaigns: status from the dates, stamps set."""
    return feed.withColumns({
        "status": campaign_status(now), "created_at": now, "updated_at": now,
    })


def apply_campaign_changes(
    target: DataFrame, feed: DataFrame, now: Column, order: list[str] = ["change_seq"]
) -> DataFrame:
    """Campaigns after the last patch of each id: blank text, null and an empty creative list
    keep the stored value."""
    patched = _patched(target, last_per_key(feed, "campaign_id", order), "campaign_id")

    def text(name: str) -> Column:
        return F.when(F.col(f"c.{name}") != "", F.col(f"c.{name}")).otherwise(F.col(name))

    values = {
        "campaign_name": text("campaign_name"),
        "status": text("status"),
        "budget": _keep("budget"),
        "end_date": _keep("end_date"),
        "target_audience": _keep("target_audience"),
        "kpis": _keep("kpis"),
        "creatives": F.when(F.size("c.creatives") > 0, F.col("c.creatives"))
        .otherwise(F.col("creatives")),
        "updated_at": F.when(_changed(), now).otherwise(F.col("updated_at")),
    }
    return patched.select(*[
        (values[name] if name in values and (name == "updated_at" or name in feed.columns)
         else F.col(name)).alias(name)
        for name in target.columns
    ])


def delete_rows(target: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return target.join(ids.select(key), key, "left_anti")


def set_status(
    target: DataFrame, changes: DataFrame, key: str, now: Column, order: list[str] = ["change_seq"]
) -> DataFrame:
    """New status of the listed ids, update stamp moved."""
    patched = _patched(target, last_per_key(changes, key, order), key)
    values = {
        "status": _keep("status"),
        "updated_at": F.when(_changed(), now).otherwise(F.col("updated_at")),
    }
    return patched.select(*[values.get(c, F.col(c)).alias(c) for c in target.columns])


def write_actuals(campaigns: DataFrame, actuals: DataFrame, now: Column) -> DataFrame:
    """Campaigns with measured impressions, reach and lift put into actual_metrics."""
    patched = _patched(
        campaigns, actuals.select("campaign_id", "impressions", "reach", "average_lift"), "campaign_id"
    )
    values = {
        "actual_metrics": F.when(
            _changed(), F.struct("c.impressions", "c.reach", "c.average_lift")
        ).otherwise(F.col("actual_metrics")),
        "updated_at": F.when(_changed(), now).otherwise(F.col("updated_at")),
    }
    return patched.select(*[values.get(c, F.col(c)).alias(c) for c in campaigns.columns])
