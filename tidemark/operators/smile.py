"""Option chains to one row of smile statistics per root and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import occ, pricing
from ..functions import scalar as S

MONTH, QUARTER, NEAR = 30 / occ.YEAR_DAYS, 90 / occ.YEAR_DAYS, 20 / occ.YEAR_DAYS
DEFAULT_RATE = 0.04


def quadratic_term(x: Column, y: Column) -> Column:
    """Leading coefficient of the least-squares parabola, from power sums of one aggregation (Cramer's rule)."""
    both = x.isNotNull() & y.isNotNull()
    m = [F.sum(F.when(both, F.pow(x, F.lit(k)))) for k in range(5)]
    b = [F.sum(F.when(both, F.pow(x, F.lit(k)) * y)) for k in range(3)]
    det = lambda p, q, r: p[0] * (q[1] * r[2] - q[2] * r[1]) - p[1] * (q[0] * r[2] - q[2] * r[0]) + p[2] * (q[0] * r[1] - q[1] * r[0])
    rows = [[m[i + j] for j in range(3)] for i in range(3)]
    return S.div(det(*[[*rows[i][:2], b[i]] for i in range(3)]), det(*rows))


def statistics(chain: DataFrame, by=("root", "date")) -> DataFrame:
    """From rows with mny (log moneyness), T (years), cp and iv: ATM volatility at 30 and 90 days, skew, risk-neutral kurtosis, term slope.

    Volatilities outside (0.005, 5) are left out; groups of fewer than three give no
    row. Ties of the nearest contract go to the smallest volatility.
    """
    by = [by] if isinstance(by, str) else list(by)
    good = chain.withColumn("iv", S.clean("iv")).filter((F.col("iv") > 0.005) & (F.col("iv") < 5))
    iv, mny, t = F.col("iv"), F.col("mny"), F.col("T")

    def atm(bucket: float) -> Column:
        near = (F.abs(t - bucket) < bucket * 0.6) & (F.abs(mny) < 0.15)
        return F.min_by(iv, F.when(near, F.struct(F.abs(mny) * 10 + F.abs(t - bucket), iv)))

    month = F.abs(t - MONTH) < NEAR
    put = F.avg(F.when(month & (F.col("cp") == "P") & (mny > -0.12) & (mny < -0.03), iv))
    call = F.avg(F.when(month & (F.col("cp") == "C") & (mny > 0.03) & (mny < 0.12), iv))
    x = F.when(month, mny)
    curve = quadratic_term(x, iv)
    fitted = (F.count(x) >= 6) & (F.max(x) - F.min(x) > 0.05)
    out = good.groupBy(*by).agg(atm(MONTH).alias("atm_iv_30d"), atm(QUARTER).alias("atm_iv_90d"), (put - call).alias("_wing"), F.when(fitted, curve).alias("_curve"), F.count(F.lit(1)).alias("n_contracts"))
    out = out.filter("n_contracts >= 3")
    return out.select(*by, "atm_iv_30d", "atm_iv_90d", F.when(F.col("atm_iv_30d") > 0, S.div("_wing", "atm_iv_30d")).alias("skew_25d"), F.when(F.col("_curve") > 0, 6 * F.col("_curve") * MONTH).alias("rn_kurtosis"), (F.col("atm_iv_90d") - F.col("atm_iv_30d")).alias("term_slope"), "n_contracts")


def contracts(options: DataFrame, spots: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Tradeable contracts with spot, moneyness and rate; ``spots`` has (root, date, spot), ``rates`` (date, rate)."""
    rows = options.filter(occ.tradeable("ticker", "date", "close", "volume")).withColumn("_o", occ.parse("ticker"))
    rows = rows.select(F.col("ticker").alias("contract"), F.col("_o.root").alias("root"), "date", F.col("_o.strike").alias("strike"), F.col("_o.expiry").alias("expiry"), F.col("_o.cp").alias("cp"), occ.years_to("_o.expiry", "date").alias("T"), "close", "volume")
    rows = rows.join(spots.filter("spot > 0"), ["root", "date"])
    rate = F.lit(DEFAULT_RATE)
    if rates is not None:
        rows = rows.join(rates.select("date", F.col("rate").alias("_rate")), "date", "left")
        rate = F.coalesce("_rate", F.lit(DEFAULT_RATE))
    return rows.withColumns({"mny": S.ln(S.div("strike", "spot")), "rate": rate}).drop("_rate")


def solved(rows: DataFrame) -> DataFrame:
    iv = pricing.udfs()["bs_iv"](F.col("close").cast("double"), "spot", "strike", "T", "rate", F.lit(0.0), "cp")
    return rows.withColumn("iv", S.clean(iv))


def smile_daily(options: DataFrame, spots: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Rows (ticker, date, spot, smile statistics) of all days at once; contracts within half a log unit of the spot."""
    chain = solved(contracts(options, spots, rates).filter(F.abs("mny") <= 0.5))
    return statistics(chain).join(spots, ["root", "date"]).withColumnRenamed("root", "ticker")


def greeks_daily(options: DataFrame, spots: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Every tradeable contract whose volatility can be solved, with its Greeks."""
    rows = solved(contracts(options, spots, rates)).filter("iv is not null")
    g = pricing.udfs()["bs_greeks"]("spot", "strike", "T", "rate", F.lit(0.0), "iv", "cp")
    return rows.withColumn("_g", g).select("contract", "root", "date", "spot", "strike", "expiry", "cp", "T", "close", "volume", "iv", "_g.*")


def parity_violations(greeks: DataFrame, rate: float = 0.03, share: float = 0.1) -> DataFrame:
    """Put-call pairs that miss parity by more than a share of the spot."""
    side = lambda cp: greeks.filter(F.col("cp") == cp).select("root", "date", "expiry", "strike", "spot", "T", F.col("close").alias(f"_{cp}"))
    pairs = side("C").join(side("P").drop("spot", "T"), ["root", "date", "expiry", "strike"])
    miss = (F.col("_C") - F.col("_P")) - (F.col("spot") - F.col("strike") * F.exp(-rate * F.col("T")))
    return pairs.withColumn("miss", miss).filter(F.abs("miss") > share * F.col("spot"))
