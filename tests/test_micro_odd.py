"""Closes of zero, missing and constant ones: the rows of the SQL, and of the operator's own rule."""

import math

import pytest
from tidemark.operators import micro
from tidemark.queries import ORACLES, QUERIES

CLOSES = """CASE WHEN u = 1 THEN 5.0 WHEN u = 2 AND i = 0 THEN 0.0 WHEN u = 3 THEN 3.0 + i % 7 WHEN u = 4 AND i % 2 = 0 THEN NULL WHEN u = 5 AND i = 20 THEN 'nan'::DOUBLE
WHEN u = 6 AND i = 13 THEN 'inf'::DOUBLE WHEN u = 7 AND i IN (5, 6) THEN 0.0 WHEN u = 8 AND i = 9 THEN -1.0 ELSE 1.0 + (i * 7) % 11 END::DOUBLE"""


def test_odd_closes_as_in_the_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT i AS event_id, make_timestamp(2024, 1, 1, 0, i // 60, i % 60) AS ts, u AS user_id, {CLOSES} AS value FROM range(40) t(i), range(1, 10) s(u)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    df = QUERIES["micro_daily"](spark, str(tmp_path))
    found = con.execute(ORACLES["micro_daily"])
    place = [[c[0] for c in found.description].index(c) for c in df.columns]
    want = sorted([r[k] for k in place] for r in found.fetchall())
    same = lambda a, b: a == b or (isinstance(a, float) and math.isnan(a) and math.isnan(b))
    got = sorted(map(list, df.collect()))
    assert len(got) == len(want) == 8 and any(math.inf in r for r in want)
    assert all(same(a, b) for x, y in zip(got, want) for a, b in zip(x, y)), (got, want)


def test_the_operator_leaves_them_out(spark):
    rows = [(k, float(0 if k == 20 else 1 + k % 5), 1.0) for k in range(40)]
    r = micro.daily(spark.createDataFrame([("a", *x) for x in rows], "g string, k int, c double, v double"), "g", "k", "c", "v").first()
    assert r.n_bars == 40 and math.isfinite(r.realized_vol) and math.isfinite(r.kyle_lambda)
