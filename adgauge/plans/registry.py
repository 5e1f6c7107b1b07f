"""Registration of catalogue queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adgauge.plans.views import Views, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(
    name: str, build: Callable[[Views], DataFrame], twin: str | None = None, rounded: str = ""
) -> None:
    """Registers `build` over the views of a folder; `twin` is the same result in SQL.

    The columns in `rounded` are computed doubles, rounded to 6 places on both sides.
    """
    columns = rounded.split()

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = build(Views(spark, folder))
        return df.withColumns({c: F.round(c, 6) for c in columns}) if columns else df

    QUERIES[name] = run
    if twin is not None:
        if columns:
            replaced = ", ".join(f"round({c}, 6) + 0.0::double AS {c}" for c in columns)
            twin = f"SELECT * REPLACE ({replaced}) FROM ({twin})"
        ORACLES[name] = sql(twin)
