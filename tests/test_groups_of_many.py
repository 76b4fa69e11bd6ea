"""Groups of more suppliers than their numbers have places, against the query's SQL."""

import duckdb

from casequarry.registry import ORACLE_SQL, QUERIES


def test_numbers_of_more_than_four_places(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE supplier AS SELECT unnest([3, 12, 1000, 1001, 10000, 10001, 10002, 10010, 123456])::BIGINT AS s_suppkey")
    con.execute(f"COPY supplier TO '{tmp_path}/supplier.parquet'")
    name = "q33_group_discovery"
    con.execute(ORACLE_SQL[name])
    names = [c[0] for c in con.description]
    wanted = con.fetchall()
    key = repr
    assert sorted((tuple(r[c] for c in names) for r in QUERIES[name](spark, str(tmp_path)).collect()), key=key) == sorted(wanted, key=key)
    assert len([r for r in wanted if r[0] == "P1000"]) == 4
