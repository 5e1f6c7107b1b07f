"""Catalogue queries against their SQL twins in DuckDB over the small test tables.

A part of the catalogue by default; CATALOG=all runs every query.
"""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
PART = [
    "a06_parse_events", "a10_upsert_sink", "b01_validate_events", "b08_normalize_consumer", "b12_encode_features",
    "c06_already_invited", "c11_star_join", "e01_impression_totals", "e02_unique_panelists", "e09_all_summaries",
    "e11_global_totals", "e17_survey_results", "e20_lift_statistics", "e22_lift_by_question", "e28_time_drill",
    "e29_lift_histogram", "e32_segment_lift", "e33_balance", "f02_trailing_counts", "f06_sliding_admission",
    "f10_latest_runs", "h11_combined_score", "h13_tracking_hash", "h24_t_pvalue", "i03_checkpoint_resume",
    "i07_stream_rate", "j04_update_panelists", "j08_invite", "k02_standardize", "k03_fit_and_score", "measure_campaign_closed_score",
    "measure_campaign_fitted", "i01_ingest_scored", "i02_triggers", "i06_route_failures", "i09_split_late", "f06_stream_limiter",
    "e02_live_reach", "a05_capped_batches", "i10_compacted_staging", "h17_country_by_ranges", "m_chi_square", "m_mann_whitney",
    "e21_lift_results_by_test", "e17_survey_result_documents",
]
NAMES = sorted(contract.oracle_sql()) if os.environ.get("CATALOG") == "all" else PART


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_twin(spark, duck, name):
    df = contract.queries()[name](spark, SMALL)
    cursor = duck.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.collect(), df.columns) == canonical(cursor.fetchall(), columns)


def test_every_inventory_section_has_queries():
    ids = {name.split("_")[0] for name in contract.queries()}
    wanted = {
        "a": set(range(1, 16)), "b": set(range(1, 31)), "c": set(range(1, 15)) - {2}, "d": set(range(1, 5)),
        "e": set(range(1, 41)), "f": set(range(1, 12)), "g": set(range(1, 8)), "h": set(range(1, 31)),
        "i": set(range(1, 11)), "j": set(range(1, 12)), "k": set(range(1, 7)),
    }
    missing = [f"{s}{n:02d}" for s, numbers in wanted.items() for n in numbers if f"{s}{n:02d}" not in ids]
    assert missing == []


def test_twins_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 3
