"""Registered queries: SQL twins on the smallest tables, and the shape of the plans."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry
from tools.verify import canon

# one or two of every family; tools/verify.py runs them all
SAMPLE = [
    "A01_aggregate_metrics", "A06_year_over_year", "A16_coverage", "A18_outlet_affinity", "J02_wide_view_joins", "J04_alias_lookup",
    "J13_claims_with_evidence", "K14_enrich_static", "H02_page_links", "H06_grid_to_metrics", "M01_upsert", "M08_check_constraints",
    "N04_arg_max_entity", "N09_share_outside_group", "P12_validate_url", "P14_non_article", "S06_stage_sheets", "V04_search_vector",
    "V05_search_keyword", "V06_search_hybrid", "W01_dedup_kept", "W09_stop_reason", "X03_period_function",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(canon(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(canon(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


STREAMS = {n for n in entry.queries() if n.startswith("R0")}


@pytest.mark.parametrize("name", sorted(set(SAMPLE) - STREAMS))
def test_plan_has_no_pairwise_join(spark, name):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = entry.queries()["P20_etl_scope"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "EqualTo(o_orderpriority,2-HIGH)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string>" in plan


@pytest.mark.parametrize("name", ["P04_filter_metrics", "J14_period_comparison", "N01_point_lookup", "N03_period_total"])
def test_year_lists_reach_the_scan(spark, name):
    name = next(n for n in entry.queries() if n.startswith(name[:4]))
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_top_k_is_limited_before_the_shuffle(spark):
    plan = entry.queries()["T05_top_evidence"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
