"""Cases of the review of round 3."""

import datetime

import duckdb
import pytest

import __spark_entry__ as entry_module
from check_oracles import normal
from shotloom.operators import bodies as bd


def both(spark, folder, name, tables):
    """Rows of a query and of its SQL on tables written for the case."""
    con = duckdb.connect()
    for table, pdf in tables.items():
        con.execute(f"COPY (SELECT * FROM pdf) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got = entry_module.queries()[name](spark, str(folder)).toPandas()
    want = con.execute(entry_module.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    return normal(got), normal(want)


@pytest.mark.parametrize("name", ["interval_overlap_join", "interval_overlap_join_hourly", "align_subtitles", "build_shot_packages"])
def test_a_segment_without_length_is_met_inside_a_shot(spark, tmp_path, name):
    con = duckdb.connect()
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [("view", 0, 0.0), ("view", 7200, 0.0), ("view", 20000, 0.0), ("click", 3600, 0.0), ("click", 7200, 0.0), ("click", 100, 2.5), ("click", 15000, -1.5)]
    values = ", ".join(f"({i}, TIMESTAMP '{at(s)}', 7, '{kind}', {value}::DOUBLE)" for i, (kind, s, value) in enumerate(rows))
    events = con.execute(f"SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value, '{{}}' AS props FROM (VALUES {values}) t(event_id, ts, user_id, event_type, value)").df()
    part = con.execute("SELECT p::BIGINT AS p_partkey, p::INT * 9 AS p_size FROM range(4) t(p)").df()
    got, want = both(spark, tmp_path, name, {"events": events, "part": part})
    assert got and got == want


def test_first_existing_with_large_supplier_keys(spark, tmp_path):
    con = duckdb.connect()
    lines = con.execute("""SELECT (i // 4)::BIGINT AS l_orderkey, (1 + i % 3)::INT AS l_linenumber, (1 + i * 7919 % 6000)::BIGINT AS l_suppkey, (1 + i * 31 % 900)::BIGINT AS l_partkey
      FROM range(2000) t(i)""").df()
    parts = con.execute("SELECT p::BIGINT AS p_partkey, (p % 50)::INT AS p_size FROM range(1, 901) t(p)").df()
    got, want = both(spark, tmp_path, "first_existing", {"lineitem": lines, "part": parts})
    assert got and got == want


def test_difference_takes_every_order(spark, tmp_path):
    con = duckdb.connect()
    customer = con.execute("SELECT i::BIGINT AS c_custkey FROM range(5) t(i)").df()
    orders = con.execute("SELECT * FROM (VALUES (1::BIGINT, 'F'), (2::BIGINT, 'O'), (3::BIGINT, 'P')) t(o_custkey, o_orderstatus)").df()
    got, want = both(spark, tmp_path, "difference", {"customer": customer, "orders": orders})
    assert got == want == [(0.0,), (4.0,)]


def test_a_body_with_a_blank_at_the_limit_is_cut(spark):
    texts = ["x" * 20 + " " + "y" * 9, "x" * 19 + " " + "y" * 9, "x" * 21 + " y", "x" * 18 + " y z", "x" * 20]
    d = spark.createDataFrame([(str(i), 1, t, None) for i, t in enumerate(texts)] + [("many", k, "a", None) for k in range(40)], "k string, ord int, merged_summary string, frame string")
    for limit in (20, 21):
        cut = lambda t: t if len(t) <= limit else t[: limit - 1].rstrip(" ") + "..."
        got = {r.k: r.body_markdown for r in bd.draft_bodies(d, ["k"], limit).collect()}
        assert got == {str(i): cut(t) for i, t in enumerate(texts)} | {"many": cut(" ".join("a" * 40))}
