import datetime as dt
import json

import numpy as np
import pytest
from tidemark.plans import backtest as B

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(5)]


def long(spark, legs):
    return spark.createDataFrame([(t, d, float(r)) for t, rs in legs.items() for d, r in zip(DAYS, rs)], "ticker string, date date, ret double")


def book(spark, weights, name="b"):
    return spark.createDataFrame([(name, t, float(w)) for t, w in weights.items()], "book string, ticker string, weight double")


def metrics(paths):
    return B.performance(paths).first()


def test_cash_halves_costs(spark):
    r = long(spark, {"AAPL": [0.0] * 5})
    full, half = (metrics(B.static_paths(book(spark, w), r)) for w in ({"AAPL": 1.0}, {"AAPL": 0.5, B.CASH: 0.5}))
    assert half.cost_total == pytest.approx(full.cost_total / 2, rel=1e-2) and half.turnover == pytest.approx(full.turnover) == pytest.approx(2.0)


def test_series_moves_between_books(spark):
    r = long(spark, {"A": [0.1] * 5, "B": [0.0] * 5})
    moves = spark.createDataFrame([("b", DAYS[0], {"A": 1.0}), ("b", DAYS[2], {"B": 1.0})], "book string, date date, weights map<string,double>")
    m = metrics(B.series_paths(moves, r))
    assert m.turnover == pytest.approx(4.0) and m.total_return == pytest.approx(1.099 * 1.10 * 1.098 * 1 * 0.999 - 1)


def test_one_decision_is_buy_and_hold(spark):
    rng = np.random.default_rng(0)
    r = long(spark, {t: rng.normal(0, 0.02, 5) for t in "ABC"})
    w = {"A": 0.5, "B": 0.3, "C": 0.2}
    hold = B.static_paths(book(spark, w), r).orderBy("date").collect()
    one = B.series_paths(spark.createDataFrame([("b", DAYS[0], w)], "book string, date date, weights map<string,double>"), r).orderBy("date").collect()
    for a, b in zip(hold, one):
        assert (a.ret, a.gross, a.turnover, a.invested) == pytest.approx((b.ret, b.gross, b.turnover, b.invested), abs=1e-12)
    closed = {x.date: x.ret for x in B.buy_and_hold(book(spark, w), r).collect()}
    assert all(closed[a.date] == pytest.approx(a.gross, abs=1e-12) for a in hold)


def test_decision_off_the_calendar_waits(spark):
    r = long(spark, {"A": [0.1] * 5})
    moves = [("b", DAYS[0] - dt.timedelta(days=3), {"A": 1.0}), ("b", DAYS[4] + dt.timedelta(days=9), {"A": 0.0}), ("b", DAYS[1], None)]
    out = B.series_paths(spark.createDataFrame(moves, "book string, date date, weights map<string,double>"), r).orderBy("date").collect()
    assert out[0].gross == pytest.approx(0.1) and out[0].ret == pytest.approx(0.099) and out[1].turnover == 0


def test_rebalancing_weekly(spark):
    days = [dt.date(2024, 1, 4), dt.date(2024, 1, 5), dt.date(2024, 1, 8), dt.date(2024, 1, 9)]
    out = B.walk_static(days, np.array([[0.1, 0.0]] * 4), np.array([0.5, 0.5]), np.array([0.001, 0.001]), "weekly", exit_cost=False)
    assert out["turnover"].tolist()[0] == 1.0 and out["turnover"].tolist()[1] == 0 and out["turnover"].tolist()[2] > 0 and out["turnover"].tolist()[3] == 0


def test_splits_and_dividends(spark):
    r = long(spark, {"A": [0.0, -0.742, 0.0, 0.0, 0.0]})
    out = {x.date: x.ret for x in B.split_adjust(r, spark.createDataFrame([("A", DAYS[1], 4.0), ("A", dt.date(2030, 1, 1), 2.0)], "ticker string, date date, factor double")).collect()}
    assert out[DAYS[1]] == pytest.approx(0.032) and out[DAYS[0]] == 0
    prices = spark.createDataFrame([("A", DAYS[0], 100.0), ("A", DAYS[2], 110.0), ("B", DAYS[0], 10.0), ("B", DAYS[1], 11.0), ("B", DAYS[2], 11.0)], "ticker string, date date, close double")
    paid = spark.createDataFrame([("B", DAYS[1], 0.5), ("B", DAYS[1], 0.5)], "ticker string, date date, value double")
    got = {(x.ticker, x.date): x.ret for x in B.leg_returns(prices, paid).collect()}
    assert got["A", DAYS[1]] == 0 and got["A", DAYS[2]] == 0  # a gap loses its return
    assert got["B", DAYS[1]] == pytest.approx(0.2)


def test_annual_figures_need_63_days(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(63)]
    make = lambda n: metrics(spark.createDataFrame([("b", d, 0.01 if k % 2 else -0.005, 0.01 if k % 2 else -0.005, 0.0, 1.0) for k, d in enumerate(days[:n])], "book string, date date, ret double, gross double, turnover double, invested double"))
    short, full = make(62), make(63)
    assert short.sharpe is None and not short.annualized
    ret = np.array([0.01 if k % 2 else -0.005 for k in range(63)])
    total = np.prod(1 + ret) - 1
    assert full.total_return == pytest.approx(total) and full.ann_return == pytest.approx((1 + total) ** (252 / 63) - 1)
    assert full.sharpe == pytest.approx(ret.mean() / ret.std() * 252**0.5) and full.sortino == pytest.approx(ret.mean() / np.sqrt((np.minimum(ret, 0) ** 2).mean()) * 252**0.5)
    assert full.var_95 == pytest.approx(abs(np.percentile(ret, 5))) and full.cvar_95 == pytest.approx(0.005) and full.hit_rate == pytest.approx((ret > 0).mean())
    assert full.skew == pytest.approx(((ret - ret.mean()) ** 3).mean() / ret.std() ** 3)


def test_total_loss(spark):
    m = metrics(spark.createDataFrame([("b", dt.date(2024, 1, 1) + dt.timedelta(days=k), -1.0 if k == 5 else 0.0, 0.0, 0.0, 1.0) for k in range(70)], "book string, date date, ret double, gross double, turnover double, invested double"))
    assert m.total_return == -1 and m.ann_return == -1 and m.max_drawdown == pytest.approx(1.0)


def test_attribution(spark):
    r = long(spark, {"A": [0.1] * 2 + [0] * 3, "B": [0.0] * 5})
    sectors = spark.createDataFrame([("A", "tech"), ("B", "")], "ticker string, sector string")
    out = {x.sector: x for x in B.attribution(book(spark, {"A": 0.5, "B": 0.3, "C": 0.2}), r, sectors).collect()}
    assert out["tech"].contribution == pytest.approx(0.105) and out["unmapped"].exposure == pytest.approx(0.5) and out["unmapped"].n == 2


GOOD = {"schema_version": "1.0", "decision_id": 1, "information_cutoff": "2024-01-01T00:00:00Z", "decision_time": "2024-01-01T01:00:00+00:00", "execution_time": "2024-01-02T14:30:00", "action": "rebalance", "target_holdings": [{"ticker": t, "weight": 0.2} for t in "ABCDE"]}


@pytest.mark.parametrize(
    "change,error",
    [
        ({}, None), ({"schema_version": "2.0"}, "schema_version must be 1.0"), ({"decision_id": 0}, "decision_id must rise"), ({"decision_time": "soon"}, "unreadable timestamps"),
        ({"execution_time": "2023-01-01T00:00:00Z"}, "information_cutoff <= decision_time < execution_time"), ({"action": "sell"}, "unknown action"), ({"target_holdings": None}, "target_holdings must be a list"),
        ({"target_holdings": [{"ticker": "A", "weight": 0.5}]}, "weight over the cap"), ({"target_holdings": [{"ticker": "A", "weight": 0.1}]}, "weights must sum to 1"), ({"target_holdings": [{"ticker": "", "weight": 0.1}]}, "leg without ticker"), ({"target_holdings": [{"ticker": "A", "weight": -0.1}]}, "bad weight"),
    ],
)
def test_decisions(spark, change, error):
    good, errors = B.decisions(spark.createDataFrame([("b", json.dumps([GOOD | change]))], "book string, records string"))
    found = {r.error for r in errors.collect()}
    if error:
        assert error in found and good.count() == 0
    else:
        row = good.first()
        assert not found and row.date == dt.date(2024, 1, 2) and row.weights == {t: 0.2 for t in "ABCDE"}


def test_decision_lists(spark):
    second = GOOD | {"decision_id": 2}
    rows = [("dup", json.dumps([GOOD, second])), ("none", "[]"), ("bad", "not json"), ("hold", json.dumps([GOOD, second | {"action": "hold", "target_holdings": [], "execution_time": "2024-01-05T00:00:00Z"}]))]
    good, errors = B.decisions(spark.createDataFrame(rows, "book string, records string"))
    found = {(r.book, r.error) for r in errors.collect()}
    assert ("dup", "duplicate execution date") in found and ("none", "series missing or empty") in found and ("bad", "series missing or empty") in found
    assert [(r.book, r.weights is None) for r in good.orderBy("date").collect()] == [("hold", False), ("hold", True)]


def test_caps():
    w = B.cap_weights({"A": 10, "B": 1, "C": 1, "D": 1, "E": 1, "F": 1, "G": 1, "H": 1}, {"A": "x", "B": "x", "C": "y"})
    assert sum(w.values()) == pytest.approx(1) and w["A"] == pytest.approx(0.15) and w["B"] == pytest.approx(w["H"]) == pytest.approx(0.85 / 7)
    assert B.cap_weights({"A": 1, "B": 3}, {}) == pytest.approx({"A": 0.5, "B": 0.5}) and B.cap_weights({}, {}) == {}
    assert B.cap_weights({"A": 0, "B": 0}, {}) == pytest.approx({"A": 0.5, "B": 0.5})


def test_caps_hold_in_any_book():
    rng = np.random.default_rng(8)
    for _ in range(200):
        n = int(rng.integers(2, 25))
        raw = {f"t{k}": float(x) for k, x in enumerate(rng.gamma(0.5, size=n) + 1e-6)}
        sector = {t: f"s{rng.integers(0, 6)}" for t in raw if rng.random() < 0.8}
        group = {t: sector.get(t, t) for t in raw}
        room = sum(min(0.30, 0.15 * list(group.values()).count(g)) for g in set(group.values()))
        w = B.cap_weights(raw, sector)
        by = {g: sum(w[t] for t in raw if group[t] == g) for g in set(group.values())}
        assert sum(w.values()) == pytest.approx(1)
        if room < 1:  # the caps can't hold: all full, scaled up
            assert by == pytest.approx({g: min(0.30, 0.15 * list(group.values()).count(g)) / room for g in by})
            continue
        assert max(w.values()) <= 0.15 + 1e-9 and max(by.values()) <= 0.30 + 1e-9
        # Names that no cap holds keep their proportions, in a full sector among themselves, else in the whole book.
        for g in [None, *by]:
            free = [t for t in raw if w[t] < 0.15 - 1e-9 and ((by[group[t]] < 0.30 - 1e-9) if g is None else group[t] == g)]
            assert np.ptp([w[t] / raw[t] for t in free] or [0.0]) < 1e-6 * max([w[t] / raw[t] for t in free] or [1.0])


def test_replay_grid(spark):
    days = spark.createDataFrame([(d,) for d in DAYS], "date date")
    got = [(r.decision.day, r.execution.day) for r in B.replay_grid(days, "2024-01-02", 2).orderBy("decision").collect()]
    assert got == [(1, 2), (3, 4)]


def test_screen(spark):
    d0 = dt.date(2024, 6, 1)
    rows = [(t, d0 + dt.timedelta(days=k), 100.0 + k * g, s, 0.2, 40, 0) for t, g, s in (("A", 1, 1.0), ("B", 0.5, 3.0), ("C", 0.1, 2.0), ("LATE", 1, 9.0)) for k in range(12)]
    vector = spark.createDataFrame([r for r in rows if r[0] != "LATE"] + [(t, d + dt.timedelta(days=40), *x) for t, d, *x in rows if t == "LATE"], "ticker string, date date, spot double, score_a double, minute_realized_diffusion double, days_to_next_report int, staleness_quarterly int")
    money = vector.selectExpr("ticker", "date", "1e6 as dollar_vol")
    c = B.screen(vector, money, "2024-06-20", {"score_a": 1.0, "spot_mom": 0.1})
    assert [r.ticker for r in c.collect()] == ["B", "C", "A"]  # rows after the cut never count
    w = B.screened_book(c, spark.createDataFrame([("A", "x")], "ticker string, sector string")).collect()
    assert sum(r.weight for r in w) == pytest.approx(1)
