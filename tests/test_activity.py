"""Hours of events against the queries' SQL, where a second is rounded into the next hour."""

import datetime as dt

import duckdb
import pytest

from casequarry.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ["q25_gaps_islands", "q25b_bounds"])
def test_times_go_to_the_nearest_second(spark, tmp_path, name):
    start = dt.datetime(1969, 12, 31, 20)
    times = [start + dt.timedelta(hours=h, minutes=m) for h in (0, 1, 2, 3, 4, 5, 9, 10) for m in (1, 7)]
    times += [dt.datetime(1970, 1, 1, 9, 59, 59, us) for us in (499_999, 500_000, 500_001)] + [dt.datetime(1969, 12, 31, 22, 59, 59, 700_000)]
    con, path = duckdb.connect(), f"{tmp_path}/events.parquet"
    con.execute("CREATE TABLE events AS SELECT unnest($1)::TIMESTAMP AS ts, 'a' AS event_type UNION ALL SELECT TIMESTAMP '2024-01-01 00:59:59.5', 'b'", [times])
    con.execute(f"COPY events TO '{path}'")
    df = QUERIES[name](spark, str(tmp_path))
    con.execute(ORACLE_SQL[name])
    names = [c[0] for c in con.description]
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(con.fetchall())
