import datetime as dt
import json
import os

import pytest
from tidemark.plans.checks import at_path, check_metrics, check_weights, json_contains, score
from tidemark.plans.service import BadRequest, Service
from tidemark.sources import catalog as C
from tidemark.sources.accessors import Dataset
from tidemark.sources.panels import EMPTY, SPECS

D = dt.date


PUT = ("news", "futures_minute", "corporate_actions", "sector_history", "futures_products", "futures_contracts", "futures_labels", "short_volume")


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("data")

    def put(path, rows, schema):
        spark.createDataFrame(rows, schema).toPandas().pipe(lambda p: ((top / path).parent.mkdir(parents=True, exist_ok=True), p.to_parquet(top / path, index=False, coerce_timestamps="us")))

    days = [D(2024, 1, 2) + dt.timedelta(days=k) for k in range(6)]
    for k, d in enumerate(days):
        kind = "double" if k % 2 else "long"
        put(f"data/raw/massive/stocks_daily/{d}.parquet", [(t, d, 100.0 + k + i, (10 if kind == "long" else 10.0)) for i, t in enumerate(("AAPL", "MSFT"))], f"ticker string, date date, close double, volume {kind}")
    put("data/canonical/fundamentals_actuals.parquet", [("AAPL", D(2023, 12, 31), 5.0)], "ticker string, date date, revenue double")
    put("data/structural/report_calendar_us.parquet", [("AAPL", D(2024, 2, 10))], "ticker string, filing_date date")
    put("data/structural/news.parquet", [("a1", dt.datetime(2024, 1, 5, 23, 30), "AAPL", None), ("a1", dt.datetime(2024, 1, 6, 0, 30), "MSFT", "positive")], "id string, published_utc timestamp_ntz, ticker string, sentiment string")
    put("data/structural/futures_minute.parquet", [("ESH4", "ES", 1704499200000000000, "2024-01-06", True), ("ESH4", "ES", 1704585600000000000, "2024-01-07", False)], "ticker string, product_code string, window_start long, session_end_date string, is_front_day boolean")
    put("data/structural/corporate_actions.parquet", [("A", D(2024, 1, 3), "split", 2.0), ("AAPL", D(2024, 1, 4), "split", 4.0), ("P", D(2024, 1, 3), "dividend:cash", 0.5)], "ticker string, ex_date date, kind string, value double")
    put("data/raw/massive/crypto_minute/X_BTCUSD/a.parquet", [(1704067200000, 1.0, 2.0, 5.0)], "t long, o double, c double, vw double")
    put("data/raw/massive/crypto_minute/X_ETHUSD/a.parquet", [(1704067200000, 3.0, 4.0)], "t long, o double, c double")
    put("data/raw/massive/reference_tickers.parquet", [("AAPL", "Apple")], "ticker string, name string")
    put("data/structural/ticker_details.parquet", [("AAPL", "tech")], "ticker string, sector string")
    (top / "data/structural/universe_us.txt").write_text("AAPL\n\n MSFT \n")
    (top / "data/reports").mkdir()
    (top / "data/reports/dq.md").write_text("# fine\n")
    put("data/structural/sector_history.parquet", [("AAPL", D(2010, 1, 1), "it"), ("AAPL", D(2020, 1, 1), "tech")], "ticker string, filed date, sector string")
    put("data/structural/futures_products.parquet", [("ES", "2024-01-01", 1), ("ES", "2024-02-01", 2), ("NQ", "2024-01-15", 3)], "product_code string, date string, v int")
    put("data/structural/futures_contracts.parquet", [("ESH4", "ES", "2024-01-01"), ("ESH4-ESM4", "ES", "2024-01-01")], "ticker string, product_code string, date string")
    put("data/structural/futures_labels.parquet", [("ESH4", "2024-01-01", 0.1), ("ESH4", "2024-01-02", None)], "ticker string, session_end_date string, y_cc double")
    put("data/structural/short_volume.parquet", [("2024-01-02", "AAPL", 5.0), ("2024-01-03", "AAPL", 6.0)], "date string, ticker string, total_volume double")
    put("data/raw/massive/options_daily/2024-01-02.parquet", [("O:AAPL240621C00100000", D(2024, 1, 2), 5.0), ("O:AA240621C00100000", D(2024, 1, 2), 5.0)], "ticker string, date date, close double")
    return top


@pytest.fixture(scope="module")
def cat(spark, root):
    return C.Catalog(spark, str(root))


@pytest.mark.parametrize(
    "name,start,end,keep",
    [("a/2024-01-05.parquet", "2024-01-05", "2024-01-05", True), ("2024-01-05.parquet", "2024-01-06", None, False), ("2024-01-05.parquet", None, "2024-01-04", False), ("2024-01-05.parquet?key=x", "2024-01-01", None, True), ("2023.parquet", "2024-01-01", None, False), ("2023.parquet", "2023-12-31", "2023-12-31", True), ("2025.parquet", None, "2024-06-01", False), ("part-0.parquet", "2030-01-01", None, True), ("2024-01-05.parquet", None, None, True)],
)
def test_pruning(name, start, end, keep):
    assert C.wanted(name, start, end) is keep


def test_resolution(cat):
    assert len(cat.resolve("stocks_daily").paths) == 6 and cat.resolve("crypto_minute").nested
    with pytest.raises(KeyError, match="stocks_daily"):
        cat.resolve("nothing")
    os.makedirs(f"{cat.root}/data/canonical/bare", exist_ok=True)
    with pytest.raises(KeyError, match="holds no files"):
        cat.resolve("bare")
    os.rmdir(f"{cat.root}/data/canonical/bare")
    assert cat.last_day() == "2024-01-07" and cat.holdout_cutoff() == "2023-12-08"


def test_scans(cat):
    assert cat.get("stocks_daily", "AAPL", "2024-01-03", "2024-01-04").count() == 2
    assert cat.scan("stocks_daily").schema["volume"].dataType.simpleString() == "double" and cat.scan("stocks_daily").count() == 12
    assert cat.counts()["stocks_daily"] == 12 and cat.trading_days().count() == 6
    rows = {r.ticker: r for r in cat.scan("crypto_minute").collect()}
    assert set(rows) == {"X:BTCUSD", "X:ETHUSD"} and rows["X:BTCUSD"].vwap == 5.0 and rows["X:ETHUSD"].vwap is None and rows["X:ETHUSD"].close == 4.0
    assert cat.crypto("btcusd", "minute", "2024-01-01", "2024-01-01").count() == 1
    for bounds, n in (((1704067200000, 1704067200000), 1), ((1704067200001, None), 0), (("2024-01-01T00:00:00+00:00", None), 1), (("2024-01-01T00:00:01", None), 0), (("2024-01-01T01:00:00+02:00", "2024-01-01T02:00:00+02:00"), 1)):
        assert cat.crypto("X:BTCUSD", "minute", *bounds).count() == n
    with pytest.raises(ValueError, match="day, hour, minute"):
        cat.crypto("btcusd", "daily")
    assert [str(r.date)[:10] for r in cat.trading_days("2024-01-03", "2024-01-04").collect()] == ["2024-01-03", "2024-01-04"]
    assert [r.ticker for r in cat.universe().orderBy("ticker").collect()] == ["AAPL", "MSFT"]
    assert cat.sectors().first().sector == "tech" and cat.report("dq") == "# fine\n"


def test_access(cat):
    assert cat.access("news", "2024-01-06", ticker="MSFT").count() == 1 and cat.access("news", end="2024-01-05").count() == 1
    assert cat.access("futures_minute", "2024-01-07", "2024-01-07").count() == 1 and cat.access("futures_minute", is_front_day=True).count() == 1
    assert cat.access("corporate_actions", ticker="AAPL").count() == 1 and cat.access("corporate_actions", "2024-01-04", kind="split").first().value == 4.0
    for name in SPECS:
        if name not in PUT:
            assert cat.access(name).count() == 0 and cat.access(name).columns == [c.strip().split()[0] for c in EMPTY[name].split(",")]


def test_named_readers(spark, root):
    d = Dataset(spark, str(root))
    assert [r.ret_1d for r in d.prices("AAPL", "2024-01-03", "2024-01-04").collect()] == [None, pytest.approx(102 / 101 - 1)]
    assert [r.adv_3 is None for r in d.adv("AAPL", 3).collect()] == [True, True, False, False, False, False]
    assert d.fundamentals("AAPL").count() == 1 and d.asof("AAPL", "2024-03-01").count() == 1 and d.calendar().count() == 1
    assert d.sector_map("2015-06-01").first().sector == "it" and d.sector_map().first().sector == "tech"
    assert d.splits("AAPL").first().factor == 4.0 and d.splits(["A", "AAPL"], end="2024-01-03").count() == 1 and d.dividends().first().value == 0.5
    assert {r.product_code: r.v for r in d.futures_products(asof="2024-01-20").collect()} == {"ES": 1, "NQ": 3}
    assert d.futures_contracts().count() == 1 and d.futures_contracts(roots="ES", singles_only=False).count() == 2
    assert d.futures_labels(labeled_only=True).count() == 1 and d.futures_minute(front_only=True).count() == 1
    assert d.short_volume("AAPL", knowable_by="2024-01-03").count() == 1 and d.options_chain("AAPL", "2024-01-02").count() == 1
    for name in ("benchmark", "guidance", "holidays", "smile", "microstructure", "state_vector", "options_snapshots", "futures_schedules", "futures_sessions", "futures_meta", "futures_roll", "anchor_daily", "futures_anchor_map", "futures_anchors", "futures_vol", "futures_macro", "futures_news", "futures_ticks", "futures_micro", "etf_flows", "etf_constituents", "etf_profiles", "apex_constraints", "futures_state_vector", "short_interest"):
        assert getattr(d, name)().count() == 0, name
    assert d.options_greeks("AAPL", "2024-01-02").count() == 0 and d.state_vector(pca=True).count() == 0


def test_manifest(spark, root):
    files = [f"data/raw/massive/stocks_daily/2024-01-0{k}.parquet" for k in (2, 3)]
    (root / "index.json").write_text(json.dumps({"panels": {"stocks_daily": {"kind": "partitioned", "files": files}}}))
    cat = C.Catalog(spark, str(root), f"{root}/index.json")
    assert cat.names() == ["stocks_daily"] and cat.scan("stocks_daily", end="2024-01-02").count() == 2


def test_sinks(spark, tmp_path):
    C.write_json(spark, {"a": [1, 2.5]}, f"{tmp_path}/fit")
    assert C.read_json(spark, f"{tmp_path}/fit") == {"a": [1, 2.5]}
    C.write_panel(spark.createDataFrame([(D(2023, 1, 1), 1), (D(2024, 1, 1), 2)], "date date, x int"), f"{tmp_path}/panel")
    assert spark.read.parquet(f"{tmp_path}/panel").filter("year = 2024").first().x == 2


def test_service(spark, cat):
    s = Service(cat)
    assert s.health()["last_day"] == "2024-01-07" and s.rows("stocks_daily", "AAPL").count() == 6 and s.sample("stocks_daily", 3).count() == 3
    assert s.asof("AAPL", "2024-03-01").count() == 1 and s.calendar("AAPL").count() == 1
    for bad in (lambda: s.rows("stocks_daily", limit=0), lambda: s.sample("stocks_daily", 5000), lambda: s.backtest({"AAPL": 0.5}, "2024-01-02", "2024-01-07"), lambda: s.backtest({"AAPL": 1.0}, "2024-01-02", "2024-01-07", "hourly")):
        with pytest.raises(BadRequest):
            bad()
    m = s.backtest({"AAPL": 0.6, "MSFT": 0.4}, "2024-01-02", "2024-01-07")
    assert m["n_days"] == 6 and m["sharpe"] is None and m["total_return"] > 0
    assert [r.ticker for r in s.most_traded(1).collect()] == ["MSFT"] and s.screen("TECH").count() == 1
    with pytest.raises(BadRequest, match="schema_version"):
        s.decide(json.dumps([{"schema_version": "9"}]), "2024-01-02", "2024-01-07")


def test_scoring():
    body = {"holdings": [{"ticker": "A", "weight": 0.6}, {"ticker": "B", "weight": 0.4}], "n": 3}
    assert at_path(body, "holdings.1.weight") == 0.4 and at_path(body, "holdings.9") is None
    assert json_contains(body, {"holdings": [{"ticker": "B"}]}) and not json_contains(body, {"n": 4})
    assert check_weights(body["holdings"]) == [] and check_weights(body["holdings"], cap=0.5) == ["weight 0.6 over 0.5"] and check_weights([]) == ["no holdings"]
    assert check_metrics({"a": 1.0, "b": None}, {"a": 1.001, "b": None}, 0.01) == (1.0, []) and check_metrics({"a": 2}, {"a": 1, "b": 1}, 0.1)[0] == 0
    rules = [{"name": k, "points": 10, "kind": k, "endpoint": "e", **x} for k, x in (("status", {}), ("contains", {"want": {"n": 3}}), ("keys", {"keys": ["n"]}), ("list", {"path": "holdings", "least": 2}), ("at_most", {"path": "n", "value": 2}), ("weights", {}), ("latency", {"seconds_at_most": 1}), ("metrics", {"reference": {"n": 3, "m": 1}, "relative": 0.1}))]
    got = {r["name"]: r["points"] for r in score(rules, {"e": {"status": 200, "body": body, "seconds": [0.1, 0.2, 5]}})}
    assert got == {"status": 10, "contains": 10, "keys": 10, "list": 10, "at_most": 0, "weights": 10, "latency": 10, "metrics": 5}
    assert score(rules[:1], {})[0]["why"] == "no answer"
