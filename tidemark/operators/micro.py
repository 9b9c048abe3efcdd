"""Minute bars to daily microstructure, one exchange for all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .rolling import Series

MIN_BARS, MIN_RETURNS, DAYS = 30, 10, 252
MEASURES = ("realized_vol", "amihud_illiq", "kyle_lambda", "fdt_deviation", "dollar_vol", "vwap_day", "n_bars")


def daily(bars: DataFrame, by=("ticker", "date"), order: str = "window_start", close: str = "close", volume: str = "volume", min_bars: int = MIN_BARS, min_returns: int = MIN_RETURNS, ieee: bool = False) -> DataFrame:
    """One row per group of at least ``min_bars`` bars and ``min_returns`` log returns whose first close is positive.

    realized_vol: root of 252 sums of squared returns. amihud_illiq: mean absolute
    return per unit of money traded, in millionths. kyle_lambda: sample covariance
    of return and signed volume over its population variance, in billionths.
    fdt_deviation: mean distance of cumulative variance from a straight line. Bars
    whose return can't be formed are left out of all of these.

    ``ieee`` leaves nothing out, whatever the first close, and reckons as SQL does:
    a close of zero makes infinite returns, and measures over them are infinite or NaN.
    """
    by = [by] if isinstance(by, str) else list(by)
    s = Series.of(by, order)
    ln, div = (S.ln_ieee, S.div_ieee) if ieee else (S.ln, S.div)
    c, v = (S.col(x).cast("double") if ieee else S.clean(x) for x in (close, volume))
    rows = bars.select(*by, order, c.alias("_c"), v.alias("_v"))
    rows = rows.withColumns({"_prev": s.lag("_c"), "_first": F.first("_c").over(s.so_far)})
    rows = rows.withColumns({"_lr": ln("_c") - ln("_prev"), "_step": F.col("_c") - F.col("_prev")})
    rows = rows.withColumn("_signed", F.when(F.col("_lr").isNotNull(), s.carried_sign("_step") * F.col("_v")))
    rows = rows.withColumns({"_cum": s.running_sum(F.col("_lr") * F.col("_lr")), "_i": F.count("_lr").over(s.so_far)})
    rows = rows.withColumns({"_rv": F.sum(F.col("_lr") * F.col("_lr")).over(s.whole), "_n": F.count("_lr").over(s.whole)})
    share = div("_cum", "_rv") if ieee else F.when(F.col("_rv") > 0, S.div("_cum", "_rv")).otherwise(S.div(F.col("_i") - 1, F.col("_n") - 1))
    rows = rows.withColumn("_gap", F.when(F.col("_lr").isNotNull(), F.abs(share - S.div("_i", "_n"))))
    x = F.when(F.col("_signed").isNotNull(), F.col("_lr"))
    traded = F.greatest(F.col("_c") * F.col("_v"), F.lit(1e-9))
    out = rows.groupBy(*by).agg(
        F.sqrt(DAYS * F.sum(F.col("_lr") * F.col("_lr"))).alias("realized_vol"),
        (F.avg(F.when(F.col("_lr").isNotNull(), F.abs("_lr") / traded)) * 1e6).alias("amihud_illiq"),
        (div(F.covar_samp(x, F.col("_signed")), F.var_pop("_signed")) * 1e9).alias("kyle_lambda"),
        F.avg("_gap").alias("fdt_deviation"),
        F.sum(F.col("_c") * F.col("_v")).alias("dollar_vol"),
        div(F.sum(F.col("_c") * F.col("_v")), F.sum("_v")).alias("vwap_day"),
        F.count(F.lit(1)).alias("n_bars"),
        F.count("_lr").alias("_n"),
        F.max("_first").alias("_first"),
    )
    enough = (F.col("n_bars") >= min_bars) & (F.col("_n") >= min_returns)
    return out.filter(enough if ieee else enough & (F.col("_first") > 0)).select(*by, *MEASURES)
