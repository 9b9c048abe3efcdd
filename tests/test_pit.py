import datetime as dt

import pytest
from tidemark.operators import asof as A
from tidemark.operators import frames as R
from tidemark.operators import pit

D = dt.date


@pytest.mark.parametrize(
    "filings,want",
    [
        ([("A", D(2024, 5, 1), None, None)], D(2024, 5, 1)),
        ([("A", D(2024, 4, 4), None, None)], D(2024, 5, 15)),  # four days after: too early
        ([("A", D(2024, 4, 5), None, None)], D(2024, 4, 5)),
        ([("A", D(2024, 7, 4), None, None)], D(2024, 7, 4)),  # day 95
        ([("A", D(2024, 7, 5), None, None)], D(2024, 5, 15)),
        ([("A", D(2024, 9, 1), D(2024, 3, 31), None)], D(2024, 9, 1)),  # filed late, but for this period
        ([("A", D(2024, 9, 1), D(2024, 3, 31), None), ("A", D(2024, 8, 1), D(2024, 3, 31), None)], D(2024, 8, 1)),
        ([("A", D(2024, 5, 1), D(2024, 3, 31), "2024-05-01T16:00:00Z")], D(2024, 5, 2)),
        ([("A", D(2024, 5, 1), None, "2024-05-01 15:59:59")], D(2024, 5, 1)),
        ([("A", D(2024, 5, 1), None, "not a time")], D(2024, 5, 1)),
        ([("B", D(2024, 5, 1), None, None)], D(2024, 5, 15)),
        ([], D(2024, 5, 15)),
    ],
)
def test_knowable_dates(spark, filings, want):
    periods = spark.createDataFrame([("A", D(2024, 3, 31), 7)], "ticker string, date date, x int")
    f = spark.createDataFrame(filings, "ticker string, filing_date date, period_end date, acceptance_datetime string")
    got = pit.knowable_dates(periods, f).collect()
    assert [(r.ticker, r.date, r.x, r["asof"]) for r in got] == [("A", D(2024, 3, 31), 7, want)]


def test_fundamentals_asof(spark):
    rows = spark.createDataFrame([("A", D(2023, 12, 31), 1), ("A", D(2024, 3, 31), 2), ("B", D(2023, 12, 31), 3), ("B", D(2024, 6, 30), 4)], "ticker string, date date, x int")
    filings = spark.createDataFrame([("A", D(2024, 2, 10)), ("A", D(2024, 3, 1)), ("A", None)], "ticker string, filing_date date")
    see = lambda day, **k: sorted(r.x for r in pit.fundamentals_asof(rows, filings, day, **k).collect())
    assert see("2024-02-09") == [1, 3]  # no filing yet: every past period
    assert see("2024-02-10") == [1, 3] and see("2024-04-30", ticker="A") == [1]
    assert see("2024-04-30", distinct=False) == [1, 1, 3] and see("2024-07-01", ticker="B") == [3, 4]
    assert pit.calendar(filings, "A").count() == 2


def test_asof_join(spark):
    left = spark.createDataFrame([("a", 5, "x"), ("a", 1, "y"), ("b", 9, "z"), (None, 5, "n"), ("a", None, "t")], "k string, t int, v string")
    right = spark.createDataFrame([("a", 5, 50, "r"), ("a", 3, 30, "s"), ("a", 5, 51, "q"), ("b", 10, 100, "u"), (None, 1, 1, "w")], "k string, t int, w int, v string")
    get = lambda **k: {r["v"]: r["w"] for r in A.asof_join(left, right, "k", "t", columns=["w"], **k).collect()}
    assert get() == {"x": 51, "y": None, "z": None, "n": None, "t": None}
    assert get(strict=True)["x"] == 30 and get(direction="forward") == {"x": 51, "y": 30, "z": 100, "n": None, "t": None}
    assert get(tolerance=0)["x"] == 51 and get(strict=True, tolerance=1)["x"] is None
    for bucket in (1, 2, 100):
        assert get(bucket=bucket) == get() and get(bucket=bucket, strict=True) == get(strict=True) and get(bucket=bucket, direction="forward") == get(direction="forward")
    both = A.asof_join(left, right, "k", "t", how="inner")
    assert both.columns == ["k", "t", "v", "t_right", "w", "v_right"] and both.count() == 1


def test_two_kinds_of_carrying(spark):
    days = spark.createDataFrame([(D(2024, 1, d),) for d in (2, 3, 5)], "date date")
    values = spark.createDataFrame([(D(2024, 1, 2), 1.0, None), (D(2024, 1, 4), 2.0, 9.0)], "date date, a double, b double")
    exact = [tuple(r) for r in A.exact_then_ffill(days, values, "date", ["a"]).orderBy("date").select("a").collect()]
    union = [tuple(r) for r in A.union_ffill(days, values, "date", ["a", "b"]).orderBy("date").select("a", "b").collect()]
    assert exact == [(1.0,), (1.0,), (1.0,)] and union == [(1.0, None), (1.0, None), (2.0, 9.0)]


def test_sector_eras(spark):
    history = spark.createDataFrame([("OLD", D(2010, 3, 1), "financials"), ("OLD", D(2020, 3, 1), "industrials"), ("NEW", D(2024, 3, 1), "tech"), ("GAP", D(2012, 1, 1), "")], "ticker string, filed date, sector string")
    current = spark.createDataFrame([("OLD", "tech"), ("NEW", "tech"), ("FUND", "fund"), ("GAP", "adr")], "ticker string, sector string")
    at = lambda day: {r.ticker: r.sector for r in R.sector_at(current, history, current, day, ("fund", "adr")).collect()}
    assert at("2015-01-01") == {"OLD": "financials", "NEW": None, "FUND": "fund", "GAP": "adr"}
    assert at("2024-06-01")["OLD"] == "industrials" and at("2024-06-01")["NEW"] == "tech"


def test_frames(spark):
    df = spark.createDataFrame([("A", D(2024, 1, 1), 1.0), ("A", D(2024, 1, 3), None), ("AB", D(2024, 1, 2), 3.0)], "ticker string, date date, close double")
    assert R.get(df, "A").count() == 2 and R.get(df, ["A", "AB"], "2024-01-02").count() == 2 and R.get(df, limit=1).count() == 1
    with pytest.raises(ValueError):
        R.get(df.drop("ticker"), "A")
    assert R.sample_rows(df, 2).collect() == R.sample_rows(df.repartition(3), 2).collect()
    assert sorted((r.ticker, r.date.day) for r in R.grid(df, "ticker", "date").collect()) == [("A", 1), ("A", 2), ("A", 3), ("AB", 2)]
    assert [r.close for r in R.latest(df, "ticker", "date").orderBy("ticker").collect()] == [None, 3.0]
    z = {r.close for r in R.cross_z(df, ["close"], fill=0.0).collect()}
    assert len(z) == 3 and 0.0 in z
