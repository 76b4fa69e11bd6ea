"""Every query against its SQL in DuckDB, and against its own rows dealt out differently."""

import math

import duckdb
import pytest

from casequarry.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", list(QUERIES))
def test_against_sql(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLE_SQL:
        assert got
        return
    duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in duck.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in duck.fetchall()), key=repr)
    assert got == want


def test_only_sequential_logic_lacks_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"q28_nms"}
