import pathlib

import duckdb
import pytest

import __spark_entry__ as registry
from tools.compare import plain

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(TABLES).exists(), reason="no test tables here")

QUICK = """u01_normalize_urls u03_dedupe_urls u06_extract_links u08_robots_filter u12_pages_per_host t12_page_title_name t16_extract_terms
f12_competitors f15_coerce_fields f17_validate_fields c05_overlap_tail e07_best_org_match e10_parse_model_json r06_top_paragraphs
j04_overlay j06_stage_membership a07_top_keywords a11_key_availability a16_merge_facts w05_phase_durations w11_progress s11_merge_append
s14_export_json d09_dedupe_basic m01_expand_queries""".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for path in pathlib.Path(TABLES).glob("*.parquet"):
        c.execute(f"create view {path.stem} as select * from '{path}'")
    return c


def test_entry(spark):
    assert registry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("key", QUICK)
def test_query_agrees_with_sql(spark, con, key):
    got, want = registry.queries()[key](spark, TABLES).toPandas(), con.execute(registry.oracle_sql()[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_columns_reach_the_scan(spark):
    plan = registry.queries()["u12_pages_per_host"](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<url:string>" in plan
