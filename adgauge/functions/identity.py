"""Pseudonymous ids, hashes, age ranges and consent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adgauge.functions.text import as_col, is_blank, strip

# Upper age bound (inclusive) of each range; older is "65+".
AGE_RANGES = {17: "<18", 24: "18-24", 34: "25-34", 44: "35-44", 54: "45-54", 64: "55-64"}


def hash_email(value) -> Column:
    digest = F.sha2(F.lower(strip(value)), 256)
    return F.when(is_blank(value), "").otherwise(digest)


def hash_phone(value) -> Column:
    digits = F.regexp_replace(as_col(value), r"\P{Nd}", "")
    return F.when(is_blank(value), "").otherwise(F.sha2(digits, 256))


def round_trip_instant(ts) -> Column:
    """UTC instant with seven fraction digits; Spark keeps six, the seventh is 0."""
    return F.concat(F.date_format(as_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z"))


def tracking_hash(campaign, creative, user, ts) -> Column:
    """16 characters identifying one (campaign, creative, user, instant)."""
    keys = [F.coalesce(as_col(c), F.lit("")) for c in (campaign, creative, user)]
    digest = F.sha2(F.concat_ws("|", *keys, round_trip_instant(ts)), 256)
    return F.substring(F.base64(F.unhex(digest)), 1, 16)


def device_fingerprint(ua, resolution, tz_offset, plugins) -> Column:
    """sha256 of the four parts joined by "|". A missing part and offset 0 are empty text."""
    offset = as_col(tz_offset)
    offset_text = F.when(offset.isNull() | (offset == 0), "").otherwise(offset.cast("string"))
    return F.sha2(
        F.concat_ws(
            "|",
            F.coalesce(as_col(ua), F.lit("")),
            F.coalesce(as_col(resolution), F.lit("")),
            offset_text,
            F.coalesce(F.array_join(as_col(plugins), ","), F.lit("")),
        ),
        256,
    )


def age_range(age) -> Column:
    c = as_col(age)
    ladder = F.when(c.isNull(), F.lit(None).cast("string"))
    for bound, label in AGE_RANGES.items():
        ladder = ladder.when(c <= bound, label)
    return ladder.otherwise("65+")


def derive_consent(given, gdpr, ccpa, now) -> tuple[Column, Column]:
    """(consent_given, consent_timestamp) of a new panelist."""
    flags = [F.coalesce(as_col(f), F.lit(False)) for f in (given, gdpr, ccpa)]
    consent = flags[0] | flags[1] | flags[2]
    return consent, F.when(consent, as_col(now))
