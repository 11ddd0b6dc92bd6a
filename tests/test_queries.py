"""Registered queries against their SQL on the smallest tables, and plan shapes."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from check_oracles import TABLES, normal

SMALL = "/root/testdata/sf0.001"
CHECKED = [
    "align_subtitles", "interval_overlap_join_hourly", "time_range_join", "ordinal_range_join", "mention_join", "nearest_interval_join", "preceding_group_join",
    "normalize_segments", "normalize_shots", "read_srt", "resolve_subtitle_source", "keyword_rank", "repair_json", "contract_check", "explode_tags", "explode_ocr",
    "dedupe_boxes", "sheet_bounds", "balanced_chunks", "normalize_chapters", "cross_title_similarity", "orphan_refs", "call_health", "stale_partitions",
    "dedupe_gallery", "markdown_blocks", "expand_shot_refs",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, con, name):
    got = entry_module.queries()[name](spark, SMALL).toPandas()
    want = con.execute(entry_module.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", ["interval_overlap_join", "time_range_join", "ordinal_range_join", "cross_title_similarity", "mention_join", "orphan_refs"])
def test_no_cross_products(spark, name):
    plan = entry_module.queries()[name](spark, SMALL)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filter_and_columns_reach_the_scan(spark):
    plan = entry_module.queries()["interval_overlap_join"](spark, SMALL)._jdf.queryExecution().toString()
    assert "EqualTo(event_type,view)" in plan and "props" not in plan.split("ReadSchema")[1].split("\n")[0]
