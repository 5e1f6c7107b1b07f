"""Survey answers, results per question, invitations and completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adgauge.functions.text import stable_id

def answers_long(surveys: DataFrame, responses: DataFrame) -> DataFrame:
    """One row per answer to a question of its survey.

    A response meets its survey by hash in shuffled partitions, the surveys built and the responses streamed past them: no
    machine holds all surveys, whatever their files' compressed size, and a survey with most of the responses is not sorted.
    Answers and questions then meet inside the row.
    """
    asked = surveys.select(
        "survey_id", "campaign_id", F.transform("questions", lambda q: F.struct(
            q["question_id"].alias("question_id"), q["question_text"].alias("question_text"),
            q["question_type"].alias("question_type"), q["metric"].alias("metric_name"),
        )).alias("questions"),
    )
    rows = responses.select("response_id", "survey_id", "panelist_id", "cohort_type", "status", "completed_at", "answers")
    answers = rows.join(asked.hint("shuffle_hash"), "survey_id").withColumn("a", F.explode("answers")).withColumn(
        "q", F.explode(F.filter("questions", lambda q: q["question_id"] == F.col("a")["question_id"])))
    return answers.select(
        "survey_id", F.col("a.question_id").alias("question_id"), "response_id", "panelist_id", "cohort_type", "status", "completed_at",
        F.col("a.answer").alias("answer"), F.col("a.numeric_value").alias("numeric_value"),
        "campaign_id", "q.question_text", "q.question_type", "q.metric_name",
    )


def survey_metrics(long_answers: DataFrame) -> DataFrame:
    """The long metric table lift reads: numeric answers only."""
    return long_answers.filter(F.col("numeric_value").isNotNull()).select(
        "panelist_id", "campaign_id", "metric_name",
        F.col("numeric_value").alias("metric_value"),
        F.col("completed_at").alias("survey_date"),
    )


def question_results(surveys: DataFrame, responses: DataFrame) -> DataFrame:
    """Exposed and control mean and lift % per question; null unless both arms have a number,
    lift null at a control mean of 0 or less."""
    numeric = F.col("numeric_value")
    stats = answers_long(surveys, responses).groupBy("survey_id", "question_id").agg(
        F.avg(F.when(F.col("cohort_type") == "exposed", numeric)).alias("e"),
        F.avg(F.when(F.col("cohort_type") == "control", numeric)).alias("c"),
    )
    both = F.col("e").isNotNull() & F.col("c").isNotNull()
    questions = surveys.select("survey_id", "campaign_id", F.explode("questions").alias("q")).select(
        "survey_id", "campaign_id", F.col("q.question_id").alias("question_id"),
        F.col("q.question_text").alias("question_text"), F.col("q.metric").alias("metric_name"),
    )
    return questions.join(stats, ["survey_id", "question_id"], "left").select(
        "survey_id", "campaign_id", "question_id", "question_text", "metric_name",
        F.when(both, F.col("e")).alias("exposed_mean"),
        F.when(both, F.col("c")).alias("control_mean"),
        F.when(both & (F.col("c") > 0), (F.col("e") - F.col("c")) / F.col("c") * 100)
        .alias("lift_percent"),
    )


def response_totals(responses: DataFrame) -> DataFrame:
    """Responses per survey in any status, by cohort, plus the completed ones."""
    return responses.groupBy("survey_id").agg(
        F.count("*").alias("total_responses"),
        F.count_if(F.col("cohort_type") == "exposed").alias("exposed_responses"),
        F.count_if(F.col("cohort_type") == "control").alias("control_responses"),
        F.count_if(F.col("status") == "Completed").alias("completed_responses"),
    )


def answer_counts(surveys: DataFrame, responses: DataFrame) -> DataFrame:
    """Distribution of the exposed arm's answers per question, null as empty text."""
    exposed = answers_long(surveys, responses).filter(F.col("cohort_type") == "exposed")
    return exposed.groupBy(
        "survey_id", "question_id", F.coalesce("answer", F.lit("")).alias("answer")
    ).agg(F.count("*").alias("n"))


def survey_results(surveys: DataFrame, responses: DataFrame) -> DataFrame:
    """One document per survey: totals and the list of question results, with the answer counts of every question.

    A document holds the distinct answers of its survey, open ones too; `answer_counts` has them as rows.
    """
    told = answer_counts(surveys, responses)
    counts = told.groupBy("survey_id", "question_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("answer", "n")))).alias("response_counts")
    )
    questions = question_results(surveys, responses).join(
        counts, ["survey_id", "question_id"], "left"
    )
    listed = questions.groupBy("survey_id").agg(
        F.sort_array(F.collect_list(F.struct(
            "question_id", "question_text", "metric_name", "exposed_mean", "control_mean",
            "lift_percent",
            F.map_entries("response_counts").alias("response_counts"),
        ))).alias("question_results")
    )
    zero = {c: 0 for c in (
        "total_responses", "exposed_responses", "control_responses", "completed_responses"
    )}
    return (
        surveys.select("survey_id", "campaign_id")
        .join(response_totals(responses), "survey_id", "left")
        .join(listed, "survey_id", "left")
        .fillna(zero)
    )


def enrich_response(responses: DataFrame, surveys: DataFrame) -> DataFrame:
    """A response takes its campaign from its survey; without a survey it is dropped."""
    return responses.drop("campaign_id").join(
        surveys.select("survey_id", "campaign_id"), "survey_id"
    )


def split_already_invited(
    requests: DataFrame, responses: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(open, already invited): any stored response of the pair counts, pending ones too."""
    keys = ["survey_id", "panelist_id"]
    known = responses.select(*keys)
    return requests.join(known, keys, "left_anti"), requests.join(known, keys, "left_semi")


def with_impression_count(invitations: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds the campaign's impression count per panelist, null when unknown."""
    return invitations.drop("impression_count").join(
        counts.select("campaign_id", "panelist_id", "impression_count"),
        ["campaign_id", "panelist_id"], "left",
    )


def invite(
    surveys: DataFrame, requests: DataFrame, responses: DataFrame, counts: DataFrame, now: Column
) -> DataFrame:
    """Outcome of every requested (survey, panelist, cohort_type): one row with `outcome`.

    Triggered rows are the pending responses to be stored. A survey must exist and be active. A
    pair requested twice in one batch is triggered once.
    """
    unique = requests.groupBy("survey_id", "panelist_id").agg(
        F.min("cohort_type").alias("cohort_type")
    )
    state = unique.join(
        surveys.select("survey_id", "campaign_id", F.col("status").alias("survey_status")),
        "survey_id", "left",
    )
    seen = responses.select("survey_id", "panelist_id").distinct().withColumn("seen", F.lit(True))
    judged = state.join(seen, ["survey_id", "panelist_id"], "left").withColumn(
        "outcome",
        F.when(F.col("survey_status").isNull(), "SurveyNotFound")
        .when(F.col("survey_status") != "Active", "SurveyNotActive")
        .when(F.col("seen"), "AlreadyResponded")
        .otherwise("Triggered"),
    )
    triggered = F.col("outcome") == "Triggered"
    return with_impression_count(judged, counts).select(
        F.when(triggered, stable_id("pending_", "survey_id", "panelist_id")).alias("response_id"),
        "survey_id", "campaign_id", "panelist_id",
        F.coalesce("cohort_type", F.lit("exposed")).alias("cohort_type"),
        F.when(triggered, F.lit("Pending")).alias("status"),
        F.when(triggered, F.col("impression_count")).cast("int").alias("impression_count"),
        "outcome",
        F.when(triggered, now).alias("created_at"),
    )


def invite_totals(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("survey_id").agg(
        F.count_if(F.col("outcome") == "Triggered").alias("total_triggered"),
        F.count_if(F.col("outcome") != "Triggered").alias("total_skipped"),
    )


def invite_targets(picked: DataFrame, typed: DataFrame) -> DataFrame:
    """Picked and typed panelist ids, each once."""
    return picked.select("panelist_id").union(typed.select("panelist_id")).distinct()


SUBMITTED = ["answers", "response_time", "device_type"]


def complete_responses(
    responses: DataFrame, submissions: DataFrame, surveys: DataFrame, now: Column
) -> DataFrame:
    """Applies submissions to the stored responses; returns the changed rows and the rejects.

    `outcome` is completed (pending row filled in), created (direct submit, or an unknown pending
    id: no cohort), already_completed or survey_not_found. A pending id submitted twice in one
    batch is completed by the smaller submission id, the others are already_completed.
    """
    stored = responses.select(
        F.col("response_id").alias("pending_response_id"),
        F.col("status").alias("stored_status"), F.col("cohort_type").alias("stored_cohort"),
        F.col("panelist_id").alias("stored_panelist"), F.col("survey_id").alias("stored_survey"),
        F.col("campaign_id").alias("stored_campaign"),
        F.col("impression_count").alias("stored_impressions"),
        F.col("created_at").alias("stored_created"),
    )
    first = submissions.filter(F.col("pending_response_id").isNotNull()).groupBy(
        "pending_response_id"
    ).agg(F.min("submission_id").alias("first_submission"))
    known = surveys.select("survey_id", F.col("campaign_id").alias("survey_campaign"))
    sent = submissions.join(known, "survey_id", "left")
    # direct submissions have no pending id: they meet nothing, and would all meet in one task
    direct = sent.filter(F.col("pending_response_id").isNull())
    state = (
        sent.filter(F.col("pending_response_id").isNotNull())
        .join(stored, "pending_response_id", "left")
        .join(first, "pending_response_id", "left")
        .unionByName(direct, allowMissingColumns=True)
    )
    found = F.col("stored_status").isNotNull()
    late = found & (
        (F.col("stored_status") == "Completed")
        | (F.col("submission_id") != F.col("first_submission"))
    )
    outcome = (
        F.when(F.col("survey_campaign").isNull(), "survey_not_found")
        .when(late, "already_completed")
        .when(found, "completed")
        .otherwise("created")
    )
    filled = F.col("outcome") == "completed"
    return state.withColumn("outcome", outcome).select(
        "submission_id",
        "outcome",
        F.when(filled, F.col("pending_response_id"))
        .otherwise(stable_id("response_", "submission_id")).alias("response_id"),
        F.when(filled, F.col("stored_survey")).otherwise(F.col("survey_id")).alias("survey_id"),
        F.when(filled, F.col("stored_campaign")).otherwise(F.col("survey_campaign")).alias("campaign_id"),
        F.when(filled, F.col("stored_panelist")).otherwise(F.col("panelist_id")).alias("panelist_id"),
        F.when(filled, F.col("stored_cohort")).alias("cohort_type"),
        *SUBMITTED,
        F.when(filled, F.col("stored_impressions")).alias("impression_count"),
        F.when(F.col("outcome").isin("completed", "created"), F.lit("Completed")).alias("status"),
        F.when(F.col("outcome").isin("completed", "created"), now).alias("completed_at"),
        F.when(filled, F.col("stored_created")).otherwise(now).alias("created_at"),
    )
