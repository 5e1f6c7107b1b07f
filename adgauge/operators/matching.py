"""Propensity features, scores, nearest-neighbour matching and balance diagnostics."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adgauge.functions.survey import batch_id
from adgauge.functions.text import stable_id
from adgauge.operators.rates import running
from adgauge.session import cut

# Feature defaults, feature names, income bands of the two income dummies.
FEATURE_DEFAULTS = {
    "age": 0, "gender": "Unknown", "country": "XX", "hh_income_bucket": "Unknown",
    "device_type": "Unknown", "browser": "Other",
}
FEATURES = [
    "age_normalized", "gender_m", "gender_f", "device_mobile", "device_tablet",
    "country_us", "country_uk", "income_low", "income_high",
]
LOW_INCOME = ("<25k", "25k-50k")
HIGH_INCOME = ("100k-150k", "150k+", ">150k")


def fill_features(df: DataFrame) -> DataFrame:
    return df.fillna({k: v for k, v in FEATURE_DEFAULTS.items() if k in df.columns})


def encode_features(df: DataFrame) -> DataFrame:
    """Adds the nine model features; income bands are compared without case and blanks."""
    income = F.lower(F.regexp_replace("hh_income_bucket", r"\s", ""))

    def flag(condition: Column) -> Column:
        return F.when(condition, 1).otherwise(0)

    return df.withColumns({
        "age_normalized": F.col("age") / 100.0,
        "gender_m": flag(F.col("gender") == "M"),
        "gender_f": flag(F.col("gender") == "F"),
        "device_mobile": flag(F.col("device_type") == "Mobile"),
        "device_tablet": flag(F.col("device_type") == "Tablet"),
        "country_us": flag(F.col("country") == "US"),
        "country_uk": flag(F.col("country") == "UK"),
        "income_low": flag(income.isin(*LOW_INCOME)),
        "income_high": flag(income.isin(*HIGH_INCOME)),
    })


def campaign_panel(panelists: DataFrame, exposure: DataFrame, campaign_id: str) -> DataFrame:
    """One row per panelist of one campaign's study.

    exposed = 1 with enough valid impressions (`exposure`: campaign_id, panelist_id), else 0. The
    control pool is every consented, active panelist without exposure.
    """
    pool = panelists.filter(F.col("consent_given") & F.col("is_active"))
    seen = exposure.filter(F.col("campaign_id") == campaign_id).select(
        "panelist_id", F.lit(1).alias("exposed")
    )
    return pool.join(seen, "panelist_id", "left").select(
        F.lit(campaign_id).alias("campaign_id"), *pool.columns,
        F.coalesce("exposed", F.lit(0)).alias("exposed"),
    )


def assemble(df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features_raw").transform(df)


def scale(df: DataFrame) -> DataFrame:
    scaler = StandardScaler(
        inputCol="features_raw", outputCol="features", withMean=True, withStd=True
    )
    return scaler.fit(df).transform(df)


def fit_propensity(
    df: DataFrame, features: list[str] = FEATURES, max_iter: int = 100,
    reg: float = 0.01, elastic: float = 0.5, tol: float = 1e-12,
) -> PipelineModel:
    """Assemble, standardise and fit P(exposed). Needs rows of both arms.

    `tol` is far below Spark's default, so that scores are those of the optimum and not of an early stop.
    """
    arms = [row[0] for row in df.select("exposed").distinct().take(3)]
    if len(arms) < 2:
        raise ValueError("propensity fit needs both exposed and control rows")
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="features_raw"),
        StandardScaler(inputCol="features_raw", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(
            featuresCol="features", labelCol="exposed", maxIter=max_iter, regParam=reg,
            elasticNetParam=elastic, tol=tol,
        ),
    ]).fit(df)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds propensity_score = P(exposed)."""
    scored = model.transform(df)
    return scored.withColumn("propensity_score", vector_to_array("probability")[1]).drop(
        "features_raw", "features", "rawPrediction", "probability", "prediction"
    )


def score_profile(df: DataFrame) -> DataFrame:
    """Count, mean, deviation and range of the scores per arm."""
    return df.groupBy("campaign_id", "exposed").agg(
        F.count("propensity_score").alias("n"),
        F.avg("propensity_score").alias("mean"),
        F.stddev_samp("propensity_score").alias("stddev"),
        F.min("propensity_score").alias("min"),
        F.max("propensity_score").alias("max"),
    )


def common_support(scored: DataFrame) -> DataFrame:
    """Share of panelists whose score lies in the range both arms cover."""
    arm = F.col("exposed") == 1
    s = F.col("propensity_score")
    bounds = scored.groupBy("campaign_id").agg(
        F.greatest(F.min(F.when(arm, s)), F.min(F.when(~arm, s))).alias("low"),
        F.least(F.max(F.when(arm, s)), F.max(F.when(~arm, s))).alias("high"),
    )
    return scored.join(bounds, "campaign_id").groupBy("campaign_id").agg(
        F.count("*").alias("panelists"),
        F.count_if(s.between(F.col("low"), F.col("high"))).alias("in_support"),
        (F.count_if(s.between(F.col("low"), F.col("high"))) / F.count("*") * 100)
        .alias("common_support_pct"),
    )


def _score_ranks(scored: DataFrame, cells: int) -> DataFrame:
    """Distinct (campaign, arm, score) with `below`: distinct control scores <= the score."""
    distinct = scored.select("campaign_id", "exposed", "propensity_score").distinct()
    one = F.when(F.col("exposed") == 0, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return running(
        distinct, ["campaign_id"], "propensity_score",
        F.floor(F.col("propensity_score") * cells), {"below": ("sum", one)},
    )


def nearest_scores(
    scored: DataFrame, caliper: float = 0.1, ratio: int = 1, cells: int = 4096
) -> DataFrame:
    """Candidate pairs of distinct scores: for every exposed score the `ratio` nearest control
    scores on each side, cut at the caliper.

    Control scores are numbered in order and looked up by number: an equi-join on (campaign,
    number), 2 x ratio rows per exposed score. No pair of the two arms is built beyond that, and a
    hot campaign spreads over its score cells and numbers.
    """
    ranked = cut(_score_ranks(scored, cells))
    control = ranked.filter(F.col("exposed") == 0).select(
        "campaign_id", F.col("below").alias("number"),
        F.col("propensity_score").alias("control_score"),
    )
    reach = F.sequence(F.col("below") - ratio + 1, F.col("below") + ratio)
    wanted = ranked.filter(F.col("exposed") == 1).select(
        "campaign_id", F.col("propensity_score").alias("exposed_score"),
        F.explode(reach).alias("number"),
    )
    return (
        wanted.join(control, ["campaign_id", "number"])
        .withColumn("ps_diff", F.abs(F.col("exposed_score") - F.col("control_score")))
        .filter(F.col("ps_diff") <= caliper)
        .drop("number")
    )


def caliper_counts(scored: DataFrame, caliper: float = 0.1, cells: int = 4096) -> DataFrame:
    """Controls within the caliper of each exposed panelist: the size of the candidate set.

    A difference of two cumulative counts over the score order; the pairs are never built.
    """
    exposed = scored.filter(F.col("exposed") == 1)
    weights = scored.filter(F.col("exposed") == 0).groupBy(
        "campaign_id", F.col("propensity_score").alias("s")
    ).agg(F.count("*").alias("n"))
    scores = exposed.select("campaign_id", F.col("propensity_score").alias("origin")).distinct()

    def probe(name: str, at: Column) -> DataFrame:
        return scores.select(
            "campaign_id", at.alias("s"), F.lit(0).cast("bigint").alias("n"),
            F.lit(name).alias("probe"), "origin",
        )

    both = (
        weights.withColumns({"probe": F.lit("control"), "origin": F.lit(None).cast("double")})
        .unionByName(probe("low", F.col("origin") - caliper))
        .unionByName(probe("high", F.col("origin") + caliper))
    )
    summed = running(
        both, ["campaign_id"], "s", F.floor(F.col("s") * cells), {"upto": ("sum", F.col("n"))}
    )
    # Both ends are inclusive: controls that sit exactly on the lower end are added back.
    at_low = F.col("probe") == "low"
    tied = weights.withColumnRenamed("n", "tied")
    ends = summed.filter(F.col("probe") != "control").join(
        tied, ["campaign_id", "s"], "left"
    ).groupBy("campaign_id", F.col("origin").alias("propensity_score")).agg(
        (
            F.max(F.when(~at_low, F.col("upto")))
            - F.max(F.when(at_low, F.col("upto") - F.coalesce("tied", F.lit(0))))
        ).alias("candidates")
    )
    return exposed.select("campaign_id", "panelist_id", "propensity_score").join(
        ends, ["campaign_id", "propensity_score"]
    )


def match(
    scored: DataFrame, caliper: float = 0.1, ratio: int = 1, cells: int = 4096
) -> DataFrame:
    """`ratio` nearest controls of every exposed panelist within the caliper, with replacement.

    Ties go to the smaller control id. Works score to score: a score needs at most its `ratio`
    smallest control ids, and all exposed panelists of one score share their match.
    """
    candidates = nearest_scores(scored, caliper, ratio, cells)
    by_id = Window.partitionBy("campaign_id", "propensity_score").orderBy("panelist_id")
    control = (
        scored.filter(F.col("exposed") == 0)
        .select("campaign_id", "propensity_score", "panelist_id")
        # Spark applies the rank limit before the shuffle too, so a hot score stays small.
        .withColumn("_n", F.row_number().over(by_id))
        .filter(F.col("_n") <= ratio)
        .select(
            "campaign_id", F.col("propensity_score").alias("control_score"),
            F.col("panelist_id").alias("control_id"),
        )
    )
    nearest = Window.partitionBy("campaign_id", "exposed_score").orderBy("ps_diff", "control_id")
    chosen = (
        candidates.join(control, ["campaign_id", "control_score"])
        .withColumn("match_rank", F.row_number().over(nearest))
        .filter(F.col("match_rank") <= ratio)
    )
    exposed = scored.filter(F.col("exposed") == 1).select(
        "campaign_id", F.col("panelist_id").alias("exposed_id"),
        F.col("propensity_score").alias("exposed_score"),
    )
    return with_match_id(exposed.join(chosen, ["campaign_id", "exposed_score"]))


def with_match_id(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("match_id", stable_id("match_", "campaign_id", "exposed_id", "control_id"))


def matched_sample(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Panel rows that take part in a match, each once, however often a control is reused."""
    ids = pairs.select("campaign_id", F.col("exposed_id").alias("panelist_id"), F.lit(1).alias("exposed")).unionByName(
        pairs.select("campaign_id", F.col("control_id").alias("panelist_id"), F.lit(0).alias("exposed")).distinct()
    )
    return df.join(ids, ["campaign_id", "panelist_id", "exposed"], "left_semi")


def _smd(df: DataFrame, features: list[str], name: str) -> DataFrame:
    """Standardised mean difference of every feature in one aggregate, then turned to rows.

    Without any variance it is 0 when the means agree, else undefined.
    """
    arm = F.col("exposed") == 1
    stats = df.groupBy("campaign_id").agg(*[
        aggregate(F.when(arm if side == "e" else ~arm, F.col(f).cast("double"))).alias(f"{f}__{side}{m}")
        for f in features for side in "ec" for m, aggregate in (("m", F.avg), ("v", F.var_samp))
    ])

    def smd(f: str) -> Column:
        gap = F.col(f"{f}__em") - F.col(f"{f}__cm")
        pooled = F.sqrt((F.col(f"{f}__ev") + F.col(f"{f}__cv")) / 2)
        return F.when(pooled > 0, gap / pooled).when((pooled == 0) & (gap == 0), 0.0)

    rows = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), smd(f).alias(name)) for f in features
    ]))
    return stats.select("campaign_id", rows.alias("r")).select("campaign_id", "r.feature", f"r.{name}")


def balance(
    df: DataFrame, pairs: DataFrame, features: list[str] = FEATURES, threshold: float = 0.1
) -> DataFrame:
    """SMD per feature before and after matching."""
    before = _smd(df, features, "smd_before")
    after = _smd(matched_sample(df, pairs), features, "smd_after")
    return before.join(after, ["campaign_id", "feature"], "left").withColumns({
        "improvement": F.abs("smd_before") - F.abs("smd_after"),
        "balanced": F.coalesce(F.abs("smd_after") < threshold, F.lit(False)),
    })


def balance_report(table: DataFrame) -> DataFrame:
    return table.orderBy("campaign_id", F.desc(F.abs("smd_after")), "feature")


def balance_score(table: DataFrame) -> DataFrame:
    return table.groupBy("campaign_id").agg(
        F.count_if("balanced").alias("balanced_features"),
        F.count("*").alias("features"),
        (F.count_if("balanced") / F.count("*")).alias("balance_score"),
    )


def psm_summary(scored: DataFrame, pairs: DataFrame, scores: DataFrame, caliper: float, run_ts: Column) -> DataFrame:
    """One row per campaign: arm sizes, pairs, match rate, caliper and balance score."""
    arms = scored.groupBy("campaign_id").agg(
        F.count_if(F.col("exposed") == 1).alias("total_exposed"),
        F.count_if(F.col("exposed") == 0).alias("total_control"),
    )
    matched = pairs.groupBy("campaign_id").agg(F.count("*").alias("matched_pairs"))
    return (
        arms.join(matched, "campaign_id", "left")
        .join(scores.select("campaign_id", "balance_score"), "campaign_id", "left")
        .select(
            "campaign_id",
            batch_id("psm", "campaign_id", run_ts).alias("batch_id"),
            "total_exposed", "total_control",
            F.coalesce("matched_pairs", F.lit(0)).alias("matched_pairs"),
            F.coalesce(
                F.try_divide(F.col("matched_pairs"), F.col("total_exposed")), F.lit(0.0)
            ).alias("match_rate"),
            "balance_score",
            F.lit(caliper).alias("caliper_width"),
            run_ts.alias("run_timestamp"),
        )
    )


def cohort_rows(
    pairs: DataFrame, scores: DataFrame, run_ts: Column, first_impressions: DataFrame | None = None
) -> DataFrame:
    """Both arms of every pair as matched-cohort rows; `first_impressions` (campaign_id,
    panelist_id, impression_id) names the exposure of the exposed side."""
    enriched = pairs.join(scores.select("campaign_id", "balance_score"), "campaign_id", "left")

    def arm(side: str, cohort: str) -> DataFrame:
        return enriched.select(
            F.col(f"{side}_id").alias("panelist_id"),
            "campaign_id",
            "match_id",
            F.col(f"{side}_score").alias("propensity_score"),
            F.col("ps_diff").alias("match_quality_score"),
            F.lit(cohort).alias("cohort_type"),
            F.lit(True).alias("matched_control_flag"),
            "balance_score",
            run_ts.alias("processing_ts"),
            batch_id("psm", "campaign_id", run_ts).alias("processing_batch_id"),
        )

    exposed = arm("exposed", "exposed")
    if first_impressions is None:
        exposed = exposed.withColumn("impression_id", F.lit(None).cast("string"))
    else:
        exposed = exposed.join(
            first_impressions.select("campaign_id", "panelist_id", "impression_id"),
            ["campaign_id", "panelist_id"], "left",
        )
    control = arm("control", "control").withColumn("impression_id", F.lit(None).cast("string"))
    return union_cohorts(exposed, control)


def union_cohorts(exposed: DataFrame, control: DataFrame) -> DataFrame:
    return exposed.unionByName(control, allowMissingColumns=True)


def distinct_cohort(cohorts: DataFrame) -> DataFrame:
    """(campaign, panelist, cohort_type) once each; a reused control counts once in lift."""
    return cohorts.select("campaign_id", "panelist_id", "cohort_type", "balance_score").distinct()
