"""Feeds, dimensions, filters and look-ups over the documents."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adgauge.functions.identity import age_range
from adgauge.functions.text import split_list, stable_id
from adgauge.session import cut


def by_id(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.filter(F.col(key) == value)


def build_exposure_mapping(impressions: DataFrame, cohorts: DataFrame) -> DataFrame:
    """One row per impression with the cohort of its panelist in its campaign, else unmatched."""
    state = cohorts.filter(F.col("cohort_type") == "exposed").groupBy(
        "campaign_id", "panelist_id"
    ).agg(F.min(F.struct(
        "match_id", "propensity_score", "match_quality_score", "processing_batch_id"
    )).alias("m"))
    # An impression id is stored once; of repeats the earliest is kept. Only the ids are counted, and only rows whose
    # id repeats are grouped; all others pass as they are.
    repeated = cut(impressions.groupBy(F.col("impression_id").alias("_id")).agg(F.count("*").alias("n")).filter("n > 1").select("_id"))
    same = impressions["impression_id"].eqNullSafe(repeated["_id"])
    row = F.struct(*[F.col(c) for c in impressions.columns])
    first = impressions.join(repeated, same, "left_semi").groupBy(F.col("impression_id").alias("_id")).agg(
        F.min_by(row, "timestamp_utc").alias("r")
    ).select("r.*")
    unique = impressions.join(repeated, same, "left_anti").unionByName(first)
    matched = F.col("m").isNotNull()
    return unique.join(state, ["campaign_id", "panelist_id"], "left").select(
        stable_id("exp_", "impression_id").alias("exposure_id"),
        "panelist_id", "impression_id", "campaign_id", "creative_id",
        F.col("timestamp_utc").alias("impression_ts"),
        F.to_date("timestamp_utc").alias("exposure_date"),
        matched.alias("matched_control_flag"),
        F.when(matched, "exposed").otherwise("unmatched").alias("cohort_type"),
        F.col("m.propensity_score").alias("propensity_score"),
        F.col("m.match_id").alias("match_id"),
        F.col("m.match_quality_score").alias("match_quality_score"),
        "device_type", F.col("country").alias("country_code"), "is_bot", "bot_reason",
        F.col("m.processing_batch_id").alias("processing_batch_id"),
    )


def build_dim_panelist(panelists: DataFrame) -> DataFrame:
    return panelists.select(
        "panelist_id",
        F.coalesce("age_range", age_range("age")).alias("age_range"),
        "gender",
        F.col("hh_income_bucket").alias("income_bucket"),
        "country", "device_type", "browser",
        split_list("interests").alias("interests"),
        "consent_gdpr", "consent_ccpa", "points_balance", "is_active", "created_at",
    )


def build_dim_campaign(campaigns: DataFrame) -> DataFrame:
    return campaigns.select(
        "campaign_id", "campaign_name", "advertiser", "industry",
        F.to_date("start_date").alias("start_date"), F.to_date("end_date").alias("end_date"),
        F.col("budget").cast("decimal(18,2)").alias("budget"),
        F.col("kpis.target_impressions").alias("target_impressions"),
        F.col("kpis.target_reach").alias("target_reach"),
        F.col("kpis.target_lift").alias("target_lift"),
        "status", "created_at",
    )


def build_dim_time(dates: DataFrame, column: str = "date") -> DataFrame:
    """Calendar over the range of dates in `dates`."""
    span = dates.agg(F.min(column).alias("first"), F.max(column).alias("last"))
    days = span.select(F.explode(F.sequence("first", "last")).alias("date"))
    return days.select(
        "date", F.year("date").alias("year"), F.quarter("date").alias("quarter"),
        F.month("date").alias("month"), F.weekofyear("date").alias("week"),
        F.dayofweek("date").alias("day_of_week"),
    )


def equals(**wanted) -> Column:
    """Conjunction of the given equalities; absent (None or empty) options do not filter."""
    condition = F.lit(True)
    for column, value in wanted.items():
        if value not in (None, ""):
            condition = condition & (F.col(column) == value)
    return condition


def list_documents(df: DataFrame, tie: str, created: str = "created_at", **wanted) -> DataFrame:
    """Documents that meet all given options, newest first."""
    return df.filter(equals(**wanted)).orderBy(F.desc(created), tie)


def active_campaigns(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") == "Active")


def active_panelists(df: DataFrame) -> DataFrame:
    return df.filter("is_active")


def contains_text(value: Column, text: str) -> Column:
    return F.lower(value).contains(text.lower())


def filter_impressions(
    df: DataFrame, campaign: str | None = None, source: str | None = None,
    device: str | None = None, bots: bool | None = None, panelist: str | None = None,
) -> DataFrame:
    condition = equals(campaign_id=campaign, ingest_source=source, device_type=device)
    if bots is not None:
        condition = condition & (F.col("is_bot") == bots)
    if panelist:
        condition = condition & contains_text(F.col("panelist_id"), panelist)
    return df.filter(condition)


def search_panelists(df: DataFrame, text: str) -> DataFrame:
    """Case-insensitive search over id, names, e-mail and country; each field on its own."""
    hit = F.lit(False)
    for name in ("panelist_id", "first_name", "last_name", "email", "country"):
        hit = hit | contains_text(F.coalesce(F.col(name), F.lit("")), text)
    return df.filter(hit)


def audience(
    df: DataFrame, age: str | None = None, gender: str | None = None, country: str | None = None
) -> DataFrame:
    return df.filter(equals(age_range=age, gender=gender, country=country))


_ANY = "*"
_PROFILE = ["age_range", "gender", "country", "interests"]


def _profiles(panelists: DataFrame) -> DataFrame:
    """Panelists reduced to what an audience can ask for."""
    own = F.array_sort(F.array_distinct(F.transform(split_list("interests"), F.lower)))
    return panelists.select(
        "panelist_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("age_range", "gender", "country")],
        F.coalesce(own, F.array().cast("array<string>")).alias("interests"),
    )


def _audiences(campaigns: DataFrame) -> DataFrame:
    """(campaign_id, wanted lists): sorted, an empty list as the wildcard."""

    def wanted(name: str) -> Column:
        values = F.col(f"target_audience.{name}")
        return F.when(F.size(values) > 0, F.array_sort(F.array_distinct(values))).otherwise(
            F.array(F.lit(_ANY)))

    return campaigns.select(
        "campaign_id", wanted("age_range").alias("ages"), wanted("gender").alias("genders"),
        wanted("countries").alias("places"),
        F.transform(wanted("interests"), F.lower).alias("wishes"),
    )


_AUDIENCE = ["ages", "genders", "places", "wishes"]
_CELL = ["age_range", "gender", "country"]


def _asked(profiles: DataFrame, audiences: DataFrame) -> DataFrame:
    """Distinct (age, gender, country) cells x distinct audiences that fit, by equi-join on the three values."""
    asked = audiences.select(*_AUDIENCE).distinct()
    cells = profiles.select(*_CELL).distinct()
    keys = {"c_age": ("ages", "age_range"), "c_gender": ("genders", "gender"), "c_place": ("places", "country")}
    for key, (lists, value) in keys.items():
        asked = asked.withColumn(key, F.explode(lists))
        cells = cells.withColumn(key, F.explode(F.array(F.col(value), F.lit(_ANY))))
    fitting = cells.join(asked, list(keys)).select(*_CELL, *_AUDIENCE)
    return fitting.withColumn("all_interests", F.array_contains("wishes", _ANY))


def _wished(profiles: DataFrame, asked: DataFrame) -> DataFrame:
    """(profile, audience) for audiences that wish for interests: both sides by interest, each pair once."""
    wishes = asked.filter(~F.col("all_interests")).select(*_CELL, *_AUDIENCE, F.explode("wishes").alias("interest"))
    own = profiles.select(*_PROFILE).distinct().withColumn("interest", F.explode("interests"))
    return own.join(wishes, [*_CELL, "interest"]).select(*_PROFILE, *_AUDIENCE).distinct()


def eligible_panelists(
    panelists: DataFrame, campaigns: DataFrame, campaign_id: str | None = None, per_panelist: bool = False,
) -> DataFrame:
    """(campaign, panelist) pairs that meet the campaign's audience; an empty list admits all.

    The result of all campaigns has as many rows as there are invitations to make; name a campaign to get
    its own. Audiences without wishes never look at interests. `per_panelist` gives one row per panelist who is
    eligible for any, with the number of campaigns and the first id: campaigns are counted per cell and per profile,
    so that the pairs are never built.
    """
    if campaign_id is not None:
        campaigns = campaigns.filter(F.col("campaign_id") == campaign_id)
    profiles, audiences = _profiles(panelists), _audiences(campaigns)
    asked = _asked(profiles, audiences)
    if per_panelist:
        audiences = audiences.groupBy(*_AUDIENCE).agg(F.count("*").alias("campaigns"), F.min("campaign_id").alias("first_campaign"))
    by_cell = asked.filter("all_interests").join(audiences, _AUDIENCE)
    by_profile = _wished(profiles, asked).join(audiences, _AUDIENCE)
    if per_panelist:
        told = [F.sum("campaigns").alias("campaigns"), F.min("first_campaign").alias("first_campaign")]
        reached = [
            profiles.join(by.groupBy(*keys).agg(*told), keys).select("panelist_id", "campaigns", "first_campaign")
            for by, keys in ((by_cell, _CELL), (by_profile, _PROFILE))]
        return reached[0].unionByName(reached[1]).groupBy("panelist_id").agg(*told)
    by_cell, by_profile = by_cell.select("campaign_id", *_CELL), by_profile.select("campaign_id", *_PROFILE)
    return profiles.join(by_cell, _CELL).select("campaign_id", "panelist_id").unionByName(
        profiles.join(by_profile, _PROFILE).select("campaign_id", "panelist_id"))


def eligible_counts(panelists: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Eligible panelists per campaign, without building the pairs."""
    profiles, audiences = _profiles(panelists), _audiences(campaigns)
    sizes = profiles.groupBy(*_PROFILE).agg(F.count("*").alias("n"))
    cells = profiles.groupBy(*_CELL).agg(F.count("*").alias("n"))
    asked = _asked(profiles, audiences)
    reached = asked.filter("all_interests").join(cells, _CELL).select(*_AUDIENCE, "n").unionByName(
        _wished(profiles, asked).join(sizes, _PROFILE).select(*_AUDIENCE, "n"))
    reach = reached.groupBy(*_AUDIENCE).agg(F.sum("n").alias("eligible"))
    return audiences.join(reach, _AUDIENCE, "left").select(
        "campaign_id", F.coalesce("eligible", F.lit(0)).alias("eligible"))


def consented(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce("consent_given", F.lit(False)))


def check_consent(ids: DataFrame, panelists: DataFrame) -> DataFrame:
    """Consent flag per asked id, false when the panelist is unknown."""
    flags = panelists.select("panelist_id", "consent_given")
    return ids.join(flags, "panelist_id", "left").withColumn(
        "consent_given", F.coalesce("consent_given", F.lit(False))
    )


def with_campaign_name(df: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Adds campaign_name, the id itself when the campaign is unknown."""
    names = campaigns.select("campaign_id", "campaign_name")
    return df.join(names, "campaign_id", "left").withColumn(
        "campaign_name", F.coalesce("campaign_name", "campaign_id")
    )


def responses_with_demographics(responses: DataFrame, panelists: DataFrame) -> DataFrame:
    people = panelists.select("panelist_id", "age_range", "gender", "country")
    return responses.join(people, "panelist_id", "left")


def panelist_features(panelists: DataFrame, exposure: DataFrame, campaign_id: str) -> DataFrame:
    """Distinct features of the panelists seen in a campaign."""
    seen = exposure.filter(F.col("campaign_id") == campaign_id).select("panelist_id")
    columns = ["panelist_id", "age", "gender", "country", "hh_income_bucket", "device_type", "browser"]
    return panelists.join(seen, "panelist_id", "left_semi").select(*columns).distinct()


def join_features(exposure: DataFrame, features: DataFrame) -> DataFrame:
    """Exposure rows with panelist features, null where the panelist is unknown."""
    clash = [c for c in features.columns if c in exposure.columns and c != "panelist_id"]
    renamed = features.withColumnsRenamed({c: f"panelist_{c}" for c in clash})
    return exposure.join(renamed, "panelist_id", "left")


def panelist_journey(
    panelist_id: str, panelists: DataFrame, impressions: DataFrame, responses: DataFrame
) -> DataFrame:
    """Profile, impressions and responses of one panelist in time order."""
    profile = panelists.filter(F.col("panelist_id") == panelist_id).select(
        "panelist_id", F.lit("profile").alias("kind"), F.col("created_at").alias("at"),
        F.col("panelist_id").alias("item_id"), "country",
    )
    seen = impressions.filter(F.col("panelist_id") == panelist_id).select(
        "panelist_id", F.lit("impression").alias("kind"), F.col("timestamp_utc").alias("at"),
        F.col("impression_id").alias("item_id"), "campaign_id", "is_bot",
    )
    told = responses.filter(F.col("panelist_id") == panelist_id).select(
        "panelist_id", F.lit("response").alias("kind"), F.col("completed_at").alias("at"),
        F.col("response_id").alias("item_id"), "campaign_id", "status",
    )
    return (
        profile.unionByName(seen, allowMissingColumns=True)
        .unionByName(told, allowMissingColumns=True)
        .orderBy("at", "item_id")
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def filter_values(panelists: DataFrame) -> DataFrame:
    """Vocabularies of the audience filters as rows: (name, value), blanks and nulls left out."""
    names = ("age_range", "gender", "country")
    pair = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names]))
    return panelists.select(pair.alias("v")).select("v.*").filter(F.col("value") != "").distinct()


# -- order, pages, heads ------------------------------------------------------------------------

def newest_impressions(
    df: DataFrame, campaign_id: str | None = None, n: int | None = None
) -> DataFrame:
    """The newest impressions: 100 of one campaign or 500 of all unless `n` is given."""
    rows = df.filter(equals(campaign_id=campaign_id))
    size = n or (100 if campaign_id else 500)
    return rows.orderBy(F.desc("timestamp_utc"), "impression_id").limit(size)


def head_n(df: DataFrame, order: Iterable[Column | str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def first_page(df: DataFrame, order: str, size: int = 100) -> DataFrame:
    return df.orderBy(order).limit(size)


def page(df: DataFrame, number: int, size: int, order: list[Column | str]) -> DataFrame:
    """Page `number` (clamped to 1 .. last) of the ordered rows, with page and page_count.

    The sort deals the rows by ranges of the order; the written ranges are counted (a row per task of the
    sort), and only those that the page lies in are read again, so the last page costs what the first does.
    """
    ranged = cut(df.orderBy(*order).withColumn("_range", F.spark_partition_id()))
    counts = sorted(tuple(r) for r in ranged.groupBy("_range").agg(F.count("*")).collect())
    rows = sum(n for _, n in counts)
    pages = max(1, -(-rows // size))
    current = min(max(1, number), pages)
    first, before, skipped, inside = (current - 1) * size, 0, 0, []
    for place, n in counts:
        if before + n <= first:
            skipped += n
        elif before < first + size:
            inside.append(place)
        before += n
    near = ranged.filter(F.col("_range").isin(inside)).drop("_range")
    return near.orderBy(*order).offset(first - skipped).limit(size).withColumns({
        "page": F.lit(current), "page_count": F.lit(pages),
    })


def newest_first(df: DataFrame, tie: str, ts: str = "created_at") -> DataFrame:
    return df.orderBy(F.desc(ts), tie)


def ordered_hours(summaries: DataFrame) -> DataFrame:
    """Hour maps as lists in calendar order."""
    return summaries.select(
        "campaign_id", F.sort_array(F.map_entries("by_hour")).alias("hours")
    )
