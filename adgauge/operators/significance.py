"""Tests of lift besides the t test: chi-square of Yes/No metrics, and Mann-Whitney by global midranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adgauge.functions import stats
from adgauge.operators.lift import COHORTS
from adgauge.operators.rates import running
from adgauge.session import cut

# Names of the tests in the lift table.
T_TEST, CHI_SQUARE, MANN_WHITNEY = "t-test", "chi-square", "mann-whitney"


def _of(arm: str, condition: Column) -> Column:
    return F.count_if((F.col("cohort_type") == arm) & condition)


def chi_square(df: DataFrame, keys: list[str], value: str = "metric_value", alpha: float = 0.05) -> DataFrame:
    """Pearson's test, one degree of freedom and no correction, of answers 1 and 0 in both arms.

    Keys with other values, those of scales and ratings, have no table and are left out. A table with an empty
    margin has no statistic and no p. All tables are counted in one pass that combines before the shuffle.
    """
    v = F.col(value)
    counted = df.filter(v.isNotNull() & F.col("cohort_type").isin(*COHORTS)).groupBy(*keys).agg(
        F.count_if(~v.isin(0.0, 1.0)).alias("others"),
        *[_of(arm, v == answer).alias(f"{arm}_{name}") for arm in COHORTS for name, answer in (("yes", 1.0), ("no", 0.0))],
    ).filter("others = 0").drop("others")
    a, b, c, d = (F.col(f"{arm}_{name}").cast("double") for arm in COHORTS for name in ("yes", "no"))
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    statistic = F.try_divide((a + b + c + d) * (a * d - b * c) ** 2, F.when(margins > 0, margins))
    return _judged(counted.withColumn("chi_square", statistic), stats.normal_pvalue(F.sqrt("chi_square")), CHI_SQUARE, alpha)


def midranks(df: DataFrame, keys: list[str], value: str = "metric_value") -> DataFrame:
    """One row per key and value: exposed, control (how many have it), before (how many have less), midrank.

    Values are dealt by ranges of (key, value) to tasks; a prefix over one row per range joins them, so that a key
    with most of the values is no single window.
    """
    told = df.filter(F.col(value).isNotNull() & F.col("cohort_type").isin(*COHORTS))
    values = told.groupBy(*keys, F.col(value).alias("value")).agg(*[_of(arm, F.lit(True)).alias(arm) for arm in COHORTS])
    ranged = cut(values.repartitionByRange(*keys, "value").withColumn("range", F.spark_partition_id()))
    ties = F.col("exposed") + F.col("control")
    summed = running(ranged, keys, "value", F.col("range"), {"upto": ("sum", ties)})
    before = F.col("upto") - ties
    return summed.select(*keys, "value", *COHORTS, before.alias("before"), (before + (ties + 1) / 2).alias("midrank"))


def mann_whitney(df: DataFrame, keys: list[str], value: str = "metric_value", alpha: float = 0.05) -> DataFrame:
    """U of the exposed arm, its tie-corrected z without continuity correction, and the two-sided normal p.

    z and p are null for an empty arm and where all values are equal.
    """
    e, c = (F.col(arm).cast("double") for arm in COHORTS)
    t = e + c
    sums = midranks(df, keys, value).groupBy(*keys).agg(
        F.sum("exposed").alias("exposed_sample_size"), F.sum("control").alias("control_sample_size"),
        F.sum(e * F.col("midrank")).alias("ranks"), F.sum(t * (t * t - 1)).alias("ties"),
    )
    n1, n2 = (F.col(f"{arm}_sample_size").cast("double") for arm in COHORTS)
    n = n1 + n2
    u = F.col("ranks") - n1 * (n1 + 1) / 2
    variance = n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1)))
    z = F.try_divide(u - n1 * n2 / 2, F.sqrt(F.when(variance > 0, variance)))
    tested = sums.withColumns({"u_statistic": u, "z_statistic": z}).drop("ranks", "ties")
    return _judged(tested, stats.normal_pvalue("z_statistic"), MANN_WHITNEY, alpha)


def _judged(df: DataFrame, p: Column, name: str, alpha: float) -> DataFrame:
    return df.withColumn("p_value", p).withColumns(
        {"is_significant": F.coalesce(F.col("p_value") < alpha, F.lit(False)), "statistical_test": F.lit(name)})


def with_test(statistics: DataFrame, tested: DataFrame, keys: list[str]) -> DataFrame:
    """Lift statistics with p, significance and name of another test, for the keys that it tells of."""
    own = tested.select(*keys, "p_value", "is_significant", "statistical_test")
    return statistics.drop("p_value", "is_significant", "statistical_test").join(own, keys)
