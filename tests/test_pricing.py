import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.functions import occ, pricing
from tidemark.functions import scalar as S


def test_price_and_greeks():
    assert float(pricing.price(100, 100, 0.25, 0.05, 0, 0.2, True)) == pytest.approx(4.614997129602855, abs=1e-9)
    assert float(pricing.price(100, 100, 0.25, 0.05, 0, 0.2, False)) == pytest.approx(3.372777178991008, abs=1e-9)
    g = pricing.greeks(100, 100, 0.25, 0.05, 0, 0.2, True)
    for name, want in {"delta": 0.569460, "gamma": 0.039288, "vega": 0.196440, "theta": -0.050224, "rho": 0.130828}.items():
        assert float(g[name]) == pytest.approx(want, abs=1e-6)


def test_dead_options():
    assert float(pricing.price(110, 100, 0, 0.05, 0, 0.2, True)) == 10 and float(pricing.price(110, 100, 0.5, 0.05, 0, 0, False)) == 0
    assert all(np.isnan(v) for v in pricing.greeks(100, 100, 0, 0.05, 0, 0.2, True).values())


def test_implied_volatility_round_trip():
    rng = np.random.default_rng(7)
    k, t, vol, call = rng.uniform(80, 220, 200), rng.uniform(0.02, 1, 200), rng.uniform(0.1, 0.8, 200), rng.random(200) < 0.5
    value = pricing.price(150, k, t, 0.03, 0, vol, call)
    good = value > 1e-4
    iv = pricing.implied_vol(value[good], 150, k[good], t[good], 0.03, 0, call[good])
    assert np.isfinite(iv).all() and np.abs(pricing.price(150, k[good], t[good], 0.03, 0, iv, call[good]) - value[good]).max() < 1e-5
    assert float(pricing.implied_vol(pricing.price(100, 95, 0.5, 0.03, 0, 0.35, False), 100, 95, 0.5, 0.03, 0, False)[0]) == pytest.approx(0.35, abs=1e-4)


def test_implied_volatility_ignores_the_batch():
    value = pricing.price(100, np.array([90.0, 100, 140]), 0.3, 0.02, 0, np.array([0.2, 0.5, 0.9]), True)
    whole = pricing.implied_vol(value, 100, np.array([90.0, 100, 140]), 0.3, 0.02, 0, True)
    alone = [pricing.implied_vol(v, 100, k, 0.3, 0.02, 0, True)[0] for v, k in zip(value, (90.0, 100, 140))]
    assert whole.tolist() == alone
    assert np.isnan(pricing.implied_vol(1.0, 100, 50, 0.5, 0.03, 0, True)[0])


def test_parity_and_tails():
    c, p = (pricing.price(100, 120, 0.7, 0.04, 0.01, 0.3, x) for x in (True, False))
    assert float(c - p) == pytest.approx(100 * math.exp(-0.007) - 120 * math.exp(-0.028), abs=1e-9)
    for t, df, want in ((0.0, 5, 0.5), (2.0, 10, 0.036694017), (0.5, 5, 0.319149436), (12.0, 3, 0.000622)):
        assert pricing.student_tail(t, df) == pytest.approx(want, abs=1e-6)
        assert pricing.student_tail(-t, df) == pytest.approx(1 - want, abs=1e-6)


def test_symbols(spark):
    rows = [("O:AAPL200221P00315000",), ("O:MSFT261218C00500000",), ("AAPL200221P00315000",), ("O:AAPL20022P00315000",), ("O:AAPL201340P00315000",), (None,)]
    df = spark.createDataFrame(rows, "s string").withColumn("o", occ.parse("s"))
    got = [r["o"] for r in df.collect()]
    assert (got[0].root, str(got[0].expiry), got[0].cp, got[0].strike) == ("AAPL", "2020-02-21", "P", 315.0)
    assert got[2:] == [None] * 4
    back = df.filter("o is not null").select("s", occ.symbol("o.root", "o.expiry", "o.cp", "o.strike").alias("b"), occ.side("s").alias("side")).collect()
    assert all(r.s == r.b for r in back) and [r.side for r in back] == ["put", "call"]
    old = spark.createDataFrame([("O:X950120C00010000",)], "s string").select(occ.parse("s", pivot=80)["expiry"].alias("e"), occ.root_of("s").alias("r")).first()
    assert str(old.e) == "1995-01-20" and old.r == "X"


def test_scalars(spark):
    df = spark.createDataFrame([(1, 0.0, float("nan"), "2024-06-21T01:02:03Z", "2024-06-22"), (2, 4.0, float("inf"), "not a time", "2024-06-01")], "k int, x double, y double, t string, d string")
    r = df.select(S.clean("y").alias("y"), S.div(F.lit(1.0), "x").alias("d"), S.ln("x").alias("l"), S.epoch_seconds("t").alias("t"), S.next_opex(S.as_date("d")).alias("o"), S.half_even(F.lit(90.5)).alias("h"), S.any_of("k", 1).alias("a"), S.matches("d", "06-0").alias("m"), S.row_mean(F.col("x"), F.lit(None).cast("double")).alias("rm")).orderBy("d").collect()
    assert r[0].y is None and r[1].y is None
    assert {x.d for x in r} == {None, 0.25} and {x.t for x in r} == {1718931723.0, None}
    assert {str(x.o) for x in r} == {"2024-07-19", "2024-06-21"} and r[0].h == 90 and {x.a for x in r} == {True, False} and {x.rm for x in r} == {0.0, 4.0}
