"""Registered queries against their SQL twins on the smallest tables.

``TIDEMARK_QUERIES=all`` runs every query; the default is one or two per family.
"""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from tidemark import catalog

SF = os.environ.get("TIDEMARK_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SAMPLE = (
    "n1_duplicate_texts", "n3_markdown_summaries", "n5_date_formats", "j1_match_term_table", "d2_merge_duplicates", "r8_rationale", "t1_select_records",
    "a6_funnel", "a3_category_trends", "a12_build_graph", "a20_ledger", "l3_leaderboard_by_mean", "l11_validate_submission",
    "g4_neighbour_docs", "s1_rss_records", "s9_markdown_records", "s10_s11_snapshot_round_trip", "x3_daily_counts", "backfill_reports",
)
ALL = os.environ.get("TIDEMARK_QUERIES") == "all"
NAMES = [n for n in catalog.ORACLES if ALL or n in SAMPLE]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return None if math.isnan(value) else float(f"{float(value):.9g}")
    return value


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=key)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, tables, name):
    got = contract.queries()[name](spark, SF)
    want = tables.sql(contract.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_every_query_of_the_library_has_a_sql_twin():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_runs(spark):
    ranked = [(r["band"] == "Pinned", r["total_score"]) for r in contract.entry(spark).collect()]
    assert ranked and ranked == sorted(ranked, reverse=True)
