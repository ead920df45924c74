"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from siftwork.plans import registry


#: A second size and number of partitions, for what depends on how rows are dealt.
SECOND = "/root/testdata/sf0.01"


def tables_of(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.fixture(scope="module")
def duck(sf):
    return {d: tables_of(d) for d in (sf, SECOND)}


def compare(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    cursor = con.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted(str(tuple(r[c] for c in names)) for r in df.collect())
    assert got == sorted(map(str, cursor.fetchall()))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, sf, duck, name):
    compare(spark, sf, duck[sf], name)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql_on_a_second_size(spark, duck, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        compare(spark, SECOND, duck[SECOND], name)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_issues_in_order_match_sql_where_a_join_may_become_a_broadcast(spark):
    """At this size the planner once broadcast where slots begin, and a slot's rows came apart."""
    sf = "/root/testdata/sf0.1"
    compare(spark, sf, tables_of(sf), "reset_issues_in_order")


@pytest.mark.parametrize("name", ["docs_gate_ipv4", "docs_gate_ipv6"])
def test_gates_match_sql_for_users_of_large_numbers(spark, tmp_path, name):
    """Numbers that fit into no part of an IPv4 and no group of an IPv6 address."""
    users = (7, 255, 256, 1499, 65_533, 65_534, 65_535, 89_999, 2**31, 2**40 + 5)
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS event_id, u AS user_id, TIMESTAMP '2024-01-01' AS ts, 'click' AS event_type, '{{}}' AS props FROM (SELECT unnest({list(users)}) AS u), range(0, 210) r(i)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    con.execute("CREATE VIEW customer AS SELECT 1 AS c_custkey, '' AS c_name")
    con.execute("CREATE VIEW orders AS SELECT 1 AS o_orderkey, 1 AS o_custkey, TIMESTAMP '2000-01-01' AS o_orderdate, 'F' AS o_orderstatus")
    cursor = con.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    got = sorted(str(tuple(r[c] for c in names)) for r in registry.QUERIES[name](spark, str(tmp_path)).collect())
    assert got == sorted(map(str, cursor.fetchall()))


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert df.columns == ["token_id", "purpose", "token_user", "state"]


def test_every_query_has_sql_or_is_an_operator():
    names = set(__spark_entry__.queries())
    assert {n for n in names - set(__spark_entry__.oracle_sql()) if not n.startswith("op") and n != "pipeline"} == set()
