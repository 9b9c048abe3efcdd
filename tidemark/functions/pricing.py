"""Option pricing: the normal distribution, Black-Scholes-Merton price and Greeks, implied volatility.

Spark has no error function, so these are Arrow UDFs over whole batches; all
other option work stays in Column expressions.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_erfc = np.vectorize(math.erfc, otypes=[float])
GREEKS = ("delta", "gamma", "vega", "theta", "rho")
VOL_LO, VOL_HI = 1e-4, 10.0


def cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(-np.asarray(x, dtype=float) / math.sqrt(2))


def density(x: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * np.square(x)) / math.sqrt(2 * math.pi)


def _sides(s, k, t, r, q, vol):
    spread = vol * np.sqrt(t)
    up = (np.log(s / k) + (r - q + 0.5 * vol * vol) * t) / spread
    return up, up - spread, np.exp(-q * t), np.exp(-r * t)


def price(s, k, t, r, q, vol, call) -> np.ndarray:
    """Value of a European option; with no time, volatility, spot or strike left, its intrinsic value undiscounted."""
    s, k, t, r, q, vol = np.broadcast_arrays(*(np.asarray(x, dtype=float) for x in (s, k, t, r, q, vol)))
    sign = np.where(np.asarray(call), 1.0, -1.0)
    live = (t > 0) & (vol > 0) & (s > 0) & (k > 0)
    safe = [np.where(live, x, 1.0) for x in (s, k, t)] + [r, q, np.where(live, vol, 1.0)]
    a, b, dq, dr = _sides(*safe)
    value = sign * (safe[0] * dq * cdf(sign * a) - safe[1] * dr * cdf(sign * b))
    return np.where(live, value, np.maximum(sign * (s - k), 0.0))


def greeks(s, k, t, r, q, vol, call) -> dict[str, np.ndarray]:
    """Delta, gamma, vega and rho per point of a percent, theta per calendar day; NaN where the option is dead."""
    s, k, t, r, q, vol = np.broadcast_arrays(*(np.asarray(x, dtype=float) for x in (s, k, t, r, q, vol)))
    sign = np.where(np.asarray(call), 1.0, -1.0)
    live = (t > 0) & (vol > 0) & (s > 0) & (k > 0)
    s, k, t, vol = (np.where(live, x, 1.0) for x in (s, k, t, vol))
    a, b, dq, dr = _sides(s, k, t, r, q, vol)
    bell, root = density(a), np.sqrt(t)
    # Decay is spread over 2 * t: the convention that published values of theta here follow.
    decay = -s * dq * bell * vol / (2 * t) - sign * r * k * dr * cdf(sign * b) + sign * q * s * dq * cdf(sign * a)
    out = {"delta": sign * dq * cdf(sign * a), "gamma": dq * bell / (s * vol * root), "vega": s * dq * bell * root / 100, "theta": decay / 365, "rho": sign * k * t * dr * cdf(sign * b) / 100}
    return {name: np.where(live, v, np.nan) for name, v in out.items()}


def implied_vol(value, s, k, t, r, q, call) -> np.ndarray:
    """Volatility that reprices each option: Newton steps from 0.25, then bisection of what hasn't settled.

    Every row stops by itself, so a result doesn't depend on the rows of its
    batch. NaN below 99.9 % of discounted intrinsic value and where no
    volatility between 0.0001 and 10 fits.
    """
    value, s, k, t, r, q = (np.atleast_1d(np.array(x)) for x in np.broadcast_arrays(*(np.asarray(x, dtype=float) for x in (value, s, k, t, r, q))))
    call = np.broadcast_to(np.asarray(call), value.shape)
    sign = np.where(call, 1.0, -1.0)
    with np.errstate(all="ignore"):
        floor = np.maximum(sign * (s * np.exp(-q * t) - k * np.exp(-r * t)), 0.0)
        usable = (t > 0) & (s > 0) & (k > 0) & (value > 0) & (value >= 0.999 * floor)
    out = np.full(value.shape, np.nan)
    vol = np.full(value.shape, 0.25)
    open_rows = np.flatnonzero(usable)
    for _ in range(60):
        if not len(open_rows):
            break
        i = open_rows
        miss = price(s[i], k[i], t[i], r[i], q[i], vol[i], call[i]) - value[i]
        settled = np.abs(miss) < 1e-8
        out[i[settled]] = vol[i[settled]]
        slope = greeks(s[i], k[i], t[i], r[i], q[i], vol[i], call[i])["vega"] * 100
        going = ~settled & (slope > 1e-10)
        i, miss, slope = i[going], miss[going], slope[going]
        vol[i] = np.clip(vol[i] - miss / slope, VOL_LO, VOL_HI)
        open_rows = i
    i = np.flatnonzero(usable & np.isnan(out))
    if len(i):
        args = [x[i] for x in (s, k, t, r, q)]
        lo, hi = np.full(len(i), VOL_LO), np.full(len(i), VOL_HI)
        bracketed = (price(*args, lo, call[i]) <= value[i] + 1e-9) & (price(*args, hi, call[i]) >= value[i])
        for _ in range(100):
            middle = 0.5 * (lo + hi)
            high = price(*args, middle, call[i]) > value[i]
            lo, hi = np.where(high, lo, middle), np.where(high, middle, hi)
        middle = 0.5 * (lo + hi)
        good = bracketed & (np.abs(price(*args, middle, call[i]) - value[i]) < 1e-6)
        out[i[good]] = middle[good]
    return out


def student_tail(t: float, df: int) -> float:
    """P(T > t) of Student's distribution, by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0

    def fraction(a: float, b: float, x: float) -> float:
        """Evaluated from the far end: 300 terms are more than enough."""
        f = 0.0
        for m in range(300, 0, -1):
            odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            f = odd / (1 + even / (1 + f))
        return 1 / (1 + f)

    if x >= 1:
        half = 1.0
    elif x < (a + 1) / (a + b + 2):
        half = front * fraction(a, b, x) / a
    else:
        half = 1 - front * fraction(b, a, 1 - x) / b
    return half / 2 if t >= 0 else 1 - half / 2


@lru_cache(maxsize=1)
def udfs() -> dict:
    """The kernels as Arrow UDFs: cdf, bs_price, bs_greeks (struct), bs_iv. ``cp`` is C or P."""

    @F.pandas_udf(T.DoubleType())
    def norm_cdf(x: pd.Series) -> pd.Series:
        return pd.Series(cdf(x)).where(x.notna())

    @F.pandas_udf(T.DoubleType())
    def bs_price(s: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series, q: pd.Series, vol: pd.Series, cp: pd.Series) -> pd.Series:
        return pd.Series(price(s, k, t, r, q, vol, cp == "C"))

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in GREEKS]))
    def bs_greeks(s: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series, q: pd.Series, vol: pd.Series, cp: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(greeks(s, k, t, r, q, vol, cp == "C")).astype(object).where(lambda x: x.notna(), None)

    @F.pandas_udf(T.DoubleType())
    def bs_iv(value: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series, q: pd.Series, cp: pd.Series) -> pd.Series:
        return pd.Series(implied_vol(value, s, k, t, r, q, cp == "C"))

    return {"norm_cdf": norm_cdf, "bs_price": bs_price, "bs_greeks": bs_greeks, "bs_iv": bs_iv}


def register(spark) -> None:
    """All kernels for use in SQL."""
    for name, f in udfs().items():
        spark.udf.register(name, f)
