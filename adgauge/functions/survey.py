"""Answer coding, run ids and the cohort definition document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adgauge.functions.text import as_col


def answer_index(question_type, options, answer) -> Column:
    """Value as the live form sends it: 1-based option, the rating itself, null for open text."""
    kind = F.lower(F.coalesce(as_col(question_type), F.lit("")))
    a = as_col(answer)
    place = F.array_position(as_col(options), a)
    yes_no = F.array_position(F.array(F.lit("Yes"), F.lit("No")), a)
    return (
        F.when(kind == "yesno", F.nullif(yes_no, F.lit(0)).cast("double"))
        .when(kind == "rating", a.try_cast("double"))
        .when(kind == "openended", F.lit(None).cast("double"))
        .otherwise(F.nullif(place, F.lit(0)).cast("double"))
    )


def answer_value(question_type, options, answer) -> Column:
    """Analysis value: as the form, but Yes = 1 and No = 0."""
    kind = F.lower(F.coalesce(as_col(question_type), F.lit("")))
    a = as_col(answer)
    return F.when(
        kind == "yesno", F.when(a == "Yes", 1.0).when(a == "No", 0.0)
    ).otherwise(answer_index(question_type, options, answer))


def batch_id(prefix: str, campaign, run_ts) -> Column:
    """`psm_<campaign>_yyyyMMdd_HHmmss`."""
    stamp = F.date_format(as_col(run_ts), "yyyyMMdd_HHmmss")
    return F.concat_ws("_", F.lit(prefix), as_col(campaign), stamp)


def cohort_definition(batch, method: str = "propensity_score_matching", caliper: float = 0.1) -> Column:
    return F.to_json(
        F.struct(
            as_col(batch).alias("batch_id"),
            F.lit(method).alias("matching_method"),
            F.lit(caliper).alias("caliper"),
        )
    )


def window_dates(run_ts, days: int = 30) -> tuple[Column, Column]:
    """(first, last) date of the analysis window ending at the run."""
    end = F.to_date(as_col(run_ts))
    return F.date_sub(end, days), end


def to_utc(ts, zone: str) -> Column:
    """Local wall-clock text or timestamp of `zone` as a UTC instant."""
    return F.to_utc_timestamp(as_col(ts), zone)
