"""The daily state vector: one row per entity and day, every value knowable that day.

Each block adds its columns to the (ticker, date) base. All windows partition by
ticker and order by date, and joins are by ticker and day, so that nothing moves
between machines once every panel lies by ticker.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import asof as A
from ..operators import frames as R
from ..operators import kernels as K
from ..operators import pit
from ..operators.rolling import Series

# Fixed column sets of the vector.
NUMERIC = (
    "fwd_fcf_fair_value", "fundamental_surprise", "kl_surprise_bits", "measured_half_life", "growth_kalman_update", "fundamental_confidence", "log_fv_gap", "guidance_range_velocity",
    "composite_valuation_gap", "valuation_kurtosis", "cornish_fisher_gap", "mean_reversion_speed",
    "minute_realized_diffusion", "amihud_illiq", "kyle_lambda", "fdt_deviation", "liquidity_roc",
    "atm_iv", "variance_risk_premium", "skew_25d", "rn_kurtosis", "oi_divergence", "term_slope",
    "treasury_funding_interact", "inflation_expectation", "funding_stress", "mktcap_duration_interact",
)
CLOCKS = ("days_to_next_report", "days_to_opex")
FLAGS = ("snapshot_track_used", "guidance_absent", "options_thin_chain", "spread_filtered", "half_life_imputed", "staleness_quarterly", "regime_calib_error_quantile")
RATIOS = ("pe_ratio", "ev_to_ebitda", "ev_to_sales", "px_to_book_ratio")
KEY = ["ticker", "date"]
DAILY = Series.of("ticker", "date")
DEFAULT_GAP, HALF_LIFE, CONFIDENCE, YIELD_ANCHOR, STALE_DAYS = 91, 21.0, 0.25, 0.05, 100


def base(stocks: DataFrame, tickers=None, start="2014-01-01", end=None) -> DataFrame:
    rows = stocks.withColumn("date", S.day(stocks)).filter(F.col("date") >= F.lit(start).cast("date"))
    rows = rows if tickers is None else rows.filter(S.any_of("ticker", tickers))
    rows = rows if end is None else rows.filter(F.col("date") <= F.lit(end).cast("date"))
    return rows.select("ticker", "date", S.clean("close").alias("spot"))


WEEKLY = ("cur_mkt_cap", *RATIOS)


def _weekly(weekly: DataFrame) -> DataFrame:
    return weekly.filter(S.clean("cur_mkt_cap").isNotNull()).withColumn("date", S.day(weekly)).select(*KEY, *[S.clean(c).alias(c) for c in WEEKLY])


def _gaps(*logs):
    """Of a group's logarithms of ratios: their mean distance from their own history, its tails, and its lag-one correlation."""
    gap = K.row_mean(*[K.z(x) for x in logs])
    skew, kurt = K.shape(gap)
    return gap, kurt, skew, K.corr(gap, K.lag(gap))


GAPS = ["composite_valuation_gap", "valuation_kurtosis", "_skew", "_rho"]


def _expansion():
    gap = F.col("composite_valuation_gap")
    return gap + F.col("_skew") / 6 * (gap * gap - 1) + F.col("valuation_kurtosis") / 24 * (gap * gap * gap - 3 * gap)


def _reversion():
    return -F.ln(S.clip("_rho", 1e-4, 0.9999)) * (252 / 21)


def valuation(days: DataFrame, weekly: DataFrame) -> DataFrame:
    """Gap of four valuation ratios from their own history, its tails, and its speed of reversion; and market cap."""
    rows = A.union_ffill(days, _weekly(weekly), "date", list(WEEKLY), "ticker")
    rows = rows.withColumns({f"_l_{c}": S.ln(c) for c in RATIOS})
    rows = K.by_group(rows, "ticker", "date", [f"_l_{c}" for c in RATIOS], GAPS, _gaps)
    return rows.select(*KEY, "composite_valuation_gap", "valuation_kurtosis", _expansion().alias("cornish_fisher_gap"), _reversion().alias("mean_reversion_speed"), F.col("cur_mkt_cap").alias("mcap"))


def actuals_known(actuals: DataFrame, filings: DataFrame) -> DataFrame:
    """Reported periods with the day their figures were knowable, and the sum of the last four known sales."""
    rows = pit.knowable_dates(actuals.withColumn("date", S.day(actuals)), filings)
    w = Series.of("ticker", ("asof", "date"))
    sales = S.clean("sales_rev_turn")
    return rows.select("ticker", "date", "asof", S.clean("cf_free_cash_flow").alias("fcf"), sales.alias("sales"), F.coalesce(F.sum(sales).over(w.last(4)), F.lit(0.0)).alias("ttm"))


def kalman(rows: DataFrame, value: str, name: str, by: str = "ticker", order: str = "date") -> DataFrame:
    """Standardised innovations of a one-dimensional level filter on the logarithm of a value.

    A state of three numbers is carried along each group's rows, in order, in one
    pass of a group; the first value sets the level and gives none.
    """
    keep = rows.select(by, order, value)
    schema = f"{by} {keep.schema[by].dataType.simpleString()}, {order} {keep.schema[order].dataType.simpleString()}, {name} double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out, level, spread = [], None, 1.0
        for x in pdf[value].tolist():
            if x is None or not x > 0:
                out.append(None)
                continue
            x = math.log(x)
            if level is None:
                level = x
                out.append(None)
                continue
            spread += 1e-4
            total = spread + 1e-2
            step = x - level
            out.append(step / math.sqrt(total))
            level += spread / total * step
            spread *= 1 - spread / total
        return pd.DataFrame({by: pdf[by], order: pdf[order], name: pd.array(out, dtype="Float64")})

    return keep.groupBy(by).applyInPandas(run, schema)


def with_fundamentals(rows: DataFrame) -> DataFrame:
    """Fair value from free cash flow at a 5 % yield, its gap to the price, staleness; ``_known`` is what was reported.

    Cash flow is in millions.
    """
    shares = S.div("cur_mkt_cap", "spot")
    rows = rows.withColumn("fwd_fcf_fair_value", S.div(F.col("_known.fcf") * 1e6, shares) / YIELD_ANCHOR)
    stale = F.coalesce((F.datediff("date", F.col("_known.asof")) > STALE_DAYS).cast("int"), F.lit(0))
    return rows.withColumns({"log_fv_gap": S.ln(S.div("spot", "fwd_fcf_fair_value")), "staleness_quarterly": stale, "_sales": F.col("_known.sales"), "actuals_date": F.col("_known.asof")})


def snapshot_events(known: DataFrame, estimates: DataFrame) -> DataFrame:
    """Surprises of reported sales against estimates of the same period, on the day they became known."""
    e = estimates.select("ticker", S.day(estimates).alias("date"), S.clean("sales_rev_turn").alias("est")).filter("est is not null")
    miss = F.col("sales") - F.col("est")
    size = F.when(F.col("est") != 0, F.abs("est"))
    sigma = F.greatest(size * 0.10, F.lit(1e-9))
    rows = known.filter("sales is not null").join(e, KEY)
    return rows.select("ticker", "asof", F.col("date").alias("period"), S.div(miss, size).alias("surprise"), (0.5 * miss * miss / (sigma * sigma) / math.log(2)).alias("kl"))


def guidance_events(guidance: DataFrame, known: DataFrame) -> DataFrame:
    """Revenue guidance in millions: middle, confidence, drift since the same period's last event, surprise against what was known."""
    lo, hi = S.clean("min_revenue_guidance") / 1e6, S.clean("max_revenue_guidance") / 1e6
    rows = guidance.select("ticker", S.day(guidance).alias("date"), F.upper(F.col("fiscal_period").cast("string")).alias("period"), ((lo + hi) / 2).alias("mid"), F.abs(hi - lo).alias("width"))
    rows = rows.filter("mid is not null and mid <> 0")
    same = Series.of(("ticker", "period"), ("date", "mid"))
    gap = F.greatest(F.datediff("date", same.lag("date")), F.lit(1))
    rows = rows.withColumn("velocity", S.div(same.change("mid"), gap))
    rows = A.asof_join(rows, known.select("ticker", "asof", F.col("date").alias("period_end"), "sales", "ttm"), "ticker", "date", right_on="asof", columns=["period_end", "asof", "sales", "ttm"])
    actual = F.when(F.col("period") == "FY", F.col("ttm")).otherwise(F.col("sales"))
    actual = F.when(F.col("asof").isNotNull() & (actual > 0), actual)
    miss, size = actual - F.col("mid"), F.abs("mid")
    sigma = F.greatest(F.col("width") / 4, size * 0.01, F.lit(1e-9))
    return rows.select("ticker", "date", "mid", S.div(F.lit(1.0), 1 + S.div("width", size + 1e-9)).alias("confidence"), "velocity", S.div(miss, size).alias("surprise"), (0.5 * miss * miss / (sigma * sigma) / math.log(2)).alias("kl"))


def with_information(rows: DataFrame, guidance: DataFrame, events: DataFrame) -> DataFrame:
    """Guidance track (``_event``) with the snapshot track (``_snap``) before a ticker's first event."""
    used = F.col("_event.event").isNull()
    rows = rows.withColumns({"_raw": F.when(used, F.col("_snap._ss")).otherwise(F.col("_event.surprise")), "_rawk": F.when(used, F.col("_snap._sk")).otherwise(F.col("_event.kl")), "snapshot_track_used": used.cast("int")})
    any_row = guidance.groupBy("ticker").agg(F.lit(0).alias("_any"))
    guided = events.groupBy("ticker").agg(F.lit(1).alias("_guided"))
    rows = rows.join(guided, "ticker", "left").join(any_row, "ticker", "left")
    return rows.withColumns({"fundamental_confidence": F.coalesce("_event.confidence", F.lit(CONFIDENCE)), "guidance_range_velocity": F.col("_event.velocity"), "guidance_absent": F.coalesce("_any", F.lit(1))})


def with_daily(rows: DataFrame, micro: DataFrame, smile: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Microstructure, smile values, variance premium and the two sides of the open-interest divergence, all of the day itself."""
    m = micro.withColumn("date", S.day(micro))
    m = m.withColumn("liquidity_roc", S.div("dollar_vol", DAILY.mean("dollar_vol", 20)) - 1)
    named = {"minute_realized_diffusion": "realized_vol", "amihud_illiq": "amihud_illiq", "kyle_lambda": "kyle_lambda", "fdt_deviation": "fdt_deviation", "liquidity_roc": "liquidity_roc"}
    s = smile.select("ticker", S.day(smile).alias("date"), *[S.clean(c).alias(c) for c in ("atm_iv_30d", "skew_25d", "rn_kurtosis", "term_slope")], "n_contracts")
    a = aggregates.select("ticker", S.day(aggregates).alias("date"), S.clean("implied_volatility").alias("_agg"), (S.clean("open_int_total_put") - S.clean("open_int_total_call")).alias("_oi"))
    a = a.withColumn("_doi", DAILY.change("_oi"))
    a = a.select(*KEY, "_agg", S.div("_doi", DAILY.std("_doi", 20) + 1e-9).alias("_push"))
    rows = rows.join(m.select(*KEY, *[S.clean(v).alias(k) for k, v in named.items()]), KEY, "left").join(s, KEY, "left").join(a, KEY, "left")
    iv, rv = F.col("atm_iv_30d"), F.col("minute_realized_diffusion")
    return rows.withColumns({"_err": F.abs(iv - F.col("_agg")), "atm_iv": iv, "variance_risk_premium": iv * iv - rv * rv, "options_thin_chain": (F.col("n_contracts") < 10).cast("int")})


def with_macro(rows: DataFrame, treasury: DataFrame, inflation: DataFrame, funding: DataFrame) -> DataFrame:
    """Macro series on each ticker's own days; the one row per day goes to every executor."""
    day = lambda df, **cols: df.select(S.day(df).alias("date"), *[c.alias(n) for n, c in cols.items()])
    t = day(treasury, _y10=S.clean("yield_10_year"))
    i = day(inflation, _infl=S.clean("forward_years_5_to_10"))
    f = day(funding, _fund=S.clean("financial_commercial_paper_90d_rate") - S.clean("effective_fed_funds_rate")).filter("_fund is not null")
    series = t.join(i, "date", "full").join(f, "date", "full")
    return rows.join(F.broadcast(series), "date", "left").withColumn("_cap", S.ln("cur_mkt_cap"))


def expected_reports(filings: DataFrame) -> DataFrame:
    """Of each filing day, when the next report is expected: after the median gap so far (91 days until three filings)."""
    f = filings.filter("filing_date is not null").select("ticker", S.day(filings, "filing_date").alias("filed"))
    w = Series.of("ticker", ("filed", "_n"))
    f = f.withColumn("_n", F.row_number().over(Series.of("ticker", "filed").window))
    f = f.withColumn("_gap", F.datediff("filed", w.lag("filed")).cast("double"))
    gap = F.when(F.col("_n") >= 3, w.expanding_median("_gap")).otherwise(F.lit(float(DEFAULT_GAP)))
    f = f.withColumn("_next", F.date_add("filed", S.half_even(gap).cast("int")))
    return f.groupBy("ticker", "filed").agg(F.max_by("_next", "_n").alias("_next"))


def report_clock(days: DataFrame, filings: DataFrame) -> DataFrame:
    """Days to the expected next report, by the last filing seen."""
    rows = A.asof_join(days.select(*KEY), expected_reports(filings), "ticker", "date", right_on="filed", columns=["_next"])
    return rows.select(*KEY, F.datediff("_next", "date").alias("days_to_next_report"), F.datediff(S.next_opex("date"), F.col("date")).alias("days_to_opex"))


#: What the one pass over a ticker's rows takes, and gives.
TAKEN = [*(f"_l_{c}" for c in RATIOS), "_sales", "_push", "spot", "_err", "_cap", "_raw", "_rawk", "_y10", "_infl", "_fund"]
GIVEN = [*GAPS, "growth_kalman_update", "oi_divergence", "regime_calib_error_quantile", "fundamental_surprise", "kl_surprise_bits", "_rho_size", "funding_stress", "inflation_expectation", "treasury_funding_interact", "mktcap_duration_interact"]


def _passed(pit_only: bool):
    """All that hangs on a ticker's earlier rows.

    The half-life's lag-one correlation of absolute surprises and the rank of the
    calibration error are over all days of a ticker, which looks ahead;
    ``pit_only`` uses the days so far only.
    """

    def f(*taken):
        *logs, sales, push, spot, err, cap, raw, rawk, y10, infl, fund = taken
        filled = K.ffill(spot)
        before = K.lag(filled)
        way = np.sign(np.where(before != 0, filled / before - 1, np.nan))
        y10, infl, fund = K.ffill(y10), K.ffill(infl), K.ffill(fund)
        rank = K.rank_pct_so_far(err) if pit_only else K.rank_pct(err)
        rho = K.persistence(np.abs(raw), pit_only)
        return *_gaps(*logs), K.innovations(sales), K.z(push - way), rank, K.ffill(raw), K.ffill(rawk), rho, fund, infl, y10 * fund, K.z(cap) * (y10 - K.lag(y10))

    return f


def build(panel, tickers=None, start="2014-01-01", end=None, audit: bool = False, pit_only: bool = False, statistics: bool = True) -> DataFrame:
    """The whole vector; ``panel`` maps a panel's name to its DataFrame.

    ``pit_only`` replaces the two columns that look ahead by their safe variants.
    Rows stay with their ticker from the first panel to the last: what was known
    is one union and one window, panels of the day are joined to it in place, and
    all long windows are one pass. Without ``statistics`` the columns of that pass
    are left out.
    """
    days = base(panel("stocks_daily"), tickers, start, end)
    # A join by ticker and day may use rows that lie by ticker; else each shuffles all rows anew.
    days.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    filings = panel("report_calendar_us")
    known = actuals_known(panel("fundamentals_actuals"), filings)
    estimates = R.union_by_name(panel("fundamentals_estimates_hist"), panel("fundamentals_estimates_recent"))
    guidance = panel("guidance_all")
    events = guidance_events(guidance, known).withColumnRenamed("date", "event")
    snaps = snapshot_events(known, estimates).select("ticker", "asof", F.col("period").alias("_sp"), F.col("surprise").alias("_ss"), F.col("kl").alias("_sk"))
    past = {
        "_week": (_weekly(panel("valuation_weekly")), "date", list(WEEKLY)),
        "_known": (known.withColumnRenamed("date", "period_end"), "asof", ["period_end", "asof", "fcf", "sales"]),
        "_event": (events, "event", ["event", "mid", "confidence", "velocity", "surprise", "kl"]),
        "_snap": (snaps, "asof", ["_sp", "asof", "_ss", "_sk"]),
        "_clock": (expected_reports(filings), "filed", ["_next"]),
    }
    rows = A.asof_many(days, past, "ticker", "date", apart=["_week"])
    rows = rows.withColumns({c: F.col(f"_week.{c}") for c in WEEKLY})
    rows = with_fundamentals(rows)
    rows = with_information(rows, guidance, events)
    rows = with_daily(rows, panel("microstructure_daily"), panel("options_smile_daily"), panel("options_agg_daily"))
    rows = with_macro(rows, panel("macro_treasury_yields"), panel("macro_inflation_expectations"), panel("macro_funding_conditions"))
    rows = rows.withColumns({"days_to_next_report": F.datediff("_clock._next", "date"), "days_to_opex": F.datediff(S.next_opex("date"), F.col("date"))})
    names = [*NUMERIC, *CLOCKS, *FLAGS, *(["actuals_date"] if audit else [])]
    if statistics:
        rows = rows.withColumns({f"_l_{c}": S.ln(c) for c in RATIOS})
        rows = rows.select(*dict.fromkeys([*KEY, "spot", "_guided", *[c for c in names if c in rows.columns], *TAKEN]))
        rows = K.by_group(rows, "ticker", "date", TAKEN, GIVEN, _passed(pit_only))
        rho = F.when(F.col("_guided").isNotNull(), F.col("_rho_size"))
        usable = (rho > 0) & (rho < 1)
        rows = rows.withColumns({"measured_half_life": F.when(usable, math.log(2) / -F.ln(F.when(usable, rho))).otherwise(HALF_LIFE), "half_life_imputed": F.coalesce(F.when(usable, 0), F.lit(1))})
        rows = rows.withColumns({"cornish_fisher_gap": _expansion(), "mean_reversion_speed": _reversion()})
    rows = rows.withColumn("spread_filtered", F.lit(1))
    # Rows without a ticker belong to no panel.
    known_ticker = lambda c: F.col(c) if c == "spread_filtered" else F.when(F.col("ticker").isNotNull(), F.col(c)).alias(c)
    return rows.select(*KEY, "spot", *[known_ticker(c) for c in names if c in rows.columns])


def leaks(vector: DataFrame) -> DataFrame:
    """Rows of an audited vector whose fundamentals weren't knowable yet; there must be none."""
    return vector.filter(F.col("actuals_date") > F.col("date"))
