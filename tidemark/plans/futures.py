"""Futures and fund panels from their sources: roll, labels, anchors, volatility, macro, news, ticks, holdings.

Constants that the panels' definitions leave open: 252 sessions a year; the
average true range is a plain mean of 14; sessions before an index's first day
have no regime value.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import asof as A
from ..operators import frames as R
from ..operators.rolling import Series

SESSIONS = 252
NEAR_EXPIRY_DAYS = 5


def singles(contracts: DataFrame) -> DataFrame:
    return contracts.filter(~F.contains("ticker", F.lit("-")))


def roll(contracts: DataFrame) -> DataFrame:
    """Per root and day: the active single of fewest days to maturity, the next one, and whether the front changed."""
    live = singles(contracts).filter(F.col("active") & (F.col("type") == "single") & (F.col("days_to_maturity") >= 0))
    one = live.groupBy("product_code", "date").agg(F.slice(F.sort_array(F.collect_list(F.struct("days_to_maturity", "ticker"))), 1, 2).alias("_c"))
    s = Series.of("product_code", "date")
    rows = one.select("product_code", "date", F.get("_c", F.lit(0))["ticker"].alias("front_ticker"), F.get("_c", F.lit(0))["days_to_maturity"].alias("front_dtm"), F.get("_c", F.lit(1))["ticker"].alias("next_ticker"))
    before = s.lag("front_ticker")
    return rows.withColumns({"is_roll_day": before.isNotNull() & (before != F.col("front_ticker")), "front_near_expiry": F.col("front_dtm") <= NEAR_EXPIRY_DAYS})


def labels(sessions: DataFrame, contracts: DataFrame | None = None, rolls: DataFrame | None = None) -> DataFrame:
    """Next-session labels of each contract: close to close, settlement to settlement, next open to close, and flags."""
    s = Series.of("ticker", "session_end_date")
    rows = sessions.withColumns({"y_cc": S.div(s.lead("close"), "close") - 1, "y_settle": S.div(s.lead("settlement_price"), "settlement_price") - 1, "y_oc": S.div(s.lead("close"), s.lead("open")) - 1, "horizon_hours": (s.lead("window_start") - F.col("window_start")) / 3.6e12, "_next": s.lead("session_end_date")})
    rows = rows.withColumn("is_last_session", F.col("_next").isNull())
    if contracts is not None:
        ends = contracts.groupBy("ticker").agg(F.max("last_trade_date").alias("_last"))
        rows = rows.join(ends, "ticker", "left").withColumn("expires_next", F.coalesce(F.col("_next") >= F.col("_last"), F.lit(False)))
    if rolls is not None:
        turn = rolls.filter("is_roll_day").select("product_code", F.col("date").alias("_next"), F.lit(True).alias("is_roll_boundary"))
        rows = rows.join(turn, ["product_code", "_next"], "left").withColumn("is_roll_boundary", F.coalesce("is_roll_boundary", F.lit(False)))
    return rows.select("ticker", "product_code", "session_end_date", "y_cc", "y_oc", "y_settle", "horizon_hours", "is_last_session", *(["expires_next"] if contracts is not None else []), *(["is_roll_boundary"] if rolls is not None else []))


def fronts(sessions: DataFrame, rolls: DataFrame | None = None) -> DataFrame:
    """Per root and session the front contract: from the roll calendar where it has the day, else the one of most volume."""
    most = sessions.groupBy("product_code", "session_end_date").agg(F.max_by("ticker", F.struct("volume", "ticker")).alias("_v"))
    if rolls is None:
        return most.select("product_code", "session_end_date", F.col("_v").alias("front_ticker"), F.lit("volume").alias("front_rule"), F.lit(False).alias("is_roll_day"))
    own = rolls.select("product_code", F.col("date").alias("session_end_date"), F.col("front_ticker").alias("_r"), "is_roll_day")
    return most.join(own, ["product_code", "session_end_date"], "left").select("product_code", "session_end_date", F.coalesce("_r", "_v").alias("front_ticker"), F.when(F.col("_r").isNotNull(), "min_dtm").otherwise("volume").alias("front_rule"), F.coalesce("is_roll_day", F.lit(False)).alias("is_roll_day"))


def anchors(sessions: DataFrame, anchor_daily: DataFrame, anchor_map: DataFrame, rolls: DataFrame | None = None) -> DataFrame:
    """The front contract beside its cash market, inverted where quoted the other way, and the basis in basis points."""
    bars = sessions.select(F.col("ticker").alias("front_ticker"), "session_end_date", F.col("close").alias("fut_close"), F.col("settlement_price").alias("fut_settle"), "volume")
    rows = fronts(sessions, rolls).join(bars, ["front_ticker", "session_end_date"], "left").join(anchor_map, "product_code")
    cash = anchor_daily.select(F.col("ticker").alias("anchor_ticker"), F.col("date").alias("session_end_date"), F.col("close").alias("_c"), F.col("open").alias("_o"))
    rows = rows.join(cash, ["anchor_ticker", "session_end_date"], "left")
    turned = lambda c: F.when(F.col("direction") == "invert", S.div(F.lit(1.0), c)).otherwise(F.col(c))
    rows = rows.withColumns({"anchor_close": turned("_c"), "anchor_open": turned("_o")})
    return rows.withColumn("basis_bps", (S.div("fut_close", "anchor_close") - 1) * 1e4).drop("_c", "_o")


def volatility(sessions: DataFrame, rolls: DataFrame | None = None, vix: DataFrame | None = None) -> DataFrame:
    """Realised, range and true-range volatility of the front, the slope to the second deferred, and breadth across a root's contracts."""
    by = Series.of("ticker", "session_end_date")
    bars = singles(sessions).withColumns({"ret_1d": S.div("close", by.lag("close")) - 1, "_pc": by.lag("close")})
    front = fronts(singles(sessions), rolls).select("product_code", "session_end_date", "front_ticker")
    f = bars.join(front, ["product_code", "session_end_date"]).filter(F.col("ticker") == F.col("front_ticker"))
    s = Series.of("product_code", "session_end_date")
    hl = S.ln("high") - S.ln("low")
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_pc")), F.abs(F.col("low") - F.col("_pc")))
    f = f.withColumns({"_hl2": hl * hl, "_tr": true_range})
    year = math.sqrt(SESSIONS)
    f = f.select("product_code", "session_end_date", "front_ticker", "ret_1d", *[(s.std("ret_1d", n) * year).alias(f"rv_{n}d") for n in (5, 21, 63)], (F.sqrt(s.mean("_hl2", 21) / (4 * math.log(2))) * year).alias("park_21d"), S.div(s.mean("_tr", 14), "close").alias("atr14_pct"), F.col("close").alias("_front_close"), F.col("volume").alias("_front_volume"))
    ranked = bars.withColumn("_rank", F.row_number().over(Series.of(("product_code", "session_end_date"), "ticker").window) if "days_to_maturity" not in bars.columns else F.row_number().over(Series.of(("product_code", "session_end_date"), ("days_to_maturity", "ticker")).window))
    wide = ranked.groupBy("product_code", "session_end_date").agg(F.countDistinct("ticker").alias("n_contracts"), F.avg(F.when(F.col("ret_1d").isNotNull(), (F.col("ret_1d") > 0).cast("double"))).alias("adv_share"), F.stddev_samp("ret_1d").alias("ret_disp"), F.sum("volume").alias("_all"), F.max(F.when(F.col("_rank") == 3, F.col("close"))).alias("_deferred"))
    out = f.join(wide, ["product_code", "session_end_date"]).withColumns({"slope_bps": (S.div("_deferred", "_front_close") - 1) * 1e4, "front_vol_share": S.div("_front_volume", "_all")})
    if vix is not None:
        v = vix.select(F.col("date").alias("session_end_date"), F.col("close").alias("vix_close"))
        v = v.withColumn("_all", F.lit(0)).withColumn("vix_chg_1d", Series.of("_all", "session_end_date").returns("vix_close")).drop("_all")
        out = out.join(v, "session_end_date", "left")
    return out.drop("_front_close", "_front_volume", "_all", "_deferred")


def macro(sessions: DataFrame, series: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """Per session and tag: the last published value, its period, the day it was knowable (period plus lag) and its age.

    ``series`` maps a tag to rows (date, value) and its publication lag in days.
    """
    out = sessions.select(S.as_date("session_end_date").alias("session_end_date")).distinct().withColumn("_k", F.lit(1))
    for tag, (rows, lag) in series.items():
        own = rows.filter("value is not null").select(F.lit(1).alias("_k"), S.as_date("date").alias(f"{tag}__period"), F.date_add(S.as_date("date"), lag).alias(f"{tag}__knowable"), F.col("value").alias(tag))
        out = A.asof_join(out, own, "_k", "session_end_date", right_on=f"{tag}__knowable", columns=[tag, f"{tag}__period", f"{tag}__knowable"])
        out = out.withColumn(f"{tag}_age_days", F.datediff("session_end_date", f"{tag}__period"))
    return out.drop("_k")


def news(sessions: DataFrame, articles: DataFrame, proxies: DataFrame) -> DataFrame:
    """Trailing article counts (1, 3, 7 days) and mean sentiment of each root's proxy; no labelled article, no sentiment.

    Articles are summed per proxy and day first; a session then looks at no more than seven of those rows.
    """
    score = F.when(F.col("sentiment") == "positive", 1.0).when(F.col("sentiment") == "negative", -1.0).when(F.col("sentiment") == "neutral", 0.0)
    daily = articles.groupBy(F.col("ticker").alias("news_ticker"), F.to_date("published_utc").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(score).alias("s"), F.count(score).alias("m"))
    rows = sessions.select("product_code", S.as_date("session_end_date").alias("session_end_date")).distinct().join(proxies.select("product_code", "news_ticker"), "product_code")
    reach = rows.withColumn("day", F.explode(F.sequence(F.date_sub("session_end_date", 6), F.col("session_end_date"))))
    met = reach.join(daily, ["news_ticker", "day"], "left").withColumn("_back", F.datediff("session_end_date", "day"))
    count = lambda n: F.coalesce(F.sum(F.when(F.col("_back") < n, F.col("n"))), F.lit(0)).alias(f"news_n_{n}d")
    mean = lambda n: S.div(F.sum(F.when(F.col("_back") < n, F.col("s"))), F.sum(F.when(F.col("_back") < n, F.col("m")))).alias(f"news_sent_mean_{n}d")
    return met.groupBy("product_code", "session_end_date", "news_ticker").agg(count(1), count(3), count(7), mean(1), mean(7))


def micro(ticks: DataFrame, tick_size: DataFrame) -> DataFrame:
    """Per root and session from raw ticks: impact, spread, depth, imbalance and quote age."""
    by = ["product_code", "session_end_date"]
    s = Series.of((*by, "ticker"), "timestamp")
    trades = ticks.filter("kind = 'trade'").withColumn("_step", s.change("price"))
    trades = trades.withColumn("_signed", s.carried_sign("_step") * F.col("size"))
    t = trades.groupBy(*by).agg(S.div(F.covar_samp("_step", "_signed"), F.var_pop("_signed")).alias("kyle_lambda"), S.div(F.sum("size"), (F.max("timestamp") - F.min("timestamp")) / 1e9).alias("liq_velocity"))
    quotes = ticks.filter("kind = 'quote'").join(tick_size.select("product_code", "trade_tick_size"), "product_code", "left")
    middle, spread = (F.col("bid") + F.col("ask")) / 2, F.col("ask") - F.col("bid")
    depth = F.col("bid_size") + F.col("ask_size")
    quotes = quotes.withColumn("_age", (s.lead("timestamp") - F.col("timestamp")) / 1e6)
    q = quotes.groupBy(*by).agg(F.percentile(S.div(spread, "trade_tick_size"), F.lit(0.5)).alias("spread_med_ticks"), F.avg(S.div(spread, middle) * 1e4).alias("spread_mean_bps"), F.avg(depth).alias("depth_mean"), F.avg(S.div(F.col("bid_size") - F.col("ask_size"), depth)).alias("imb_mean"), F.percentile("_age", F.lit(0.5)).alias("quote_age_med_ms"))
    return t.join(q, by, "full").withColumn("has_ticks", F.lit(True))


def constituents(holdings: DataFrame) -> DataFrame:
    """Per fund and day: number of holdings, weight of the largest 1, 5 and 10, and concentration."""
    rank = F.row_number().over(Series.of(("ticker", "processed_date"), ()).whole.orderBy(F.col("weight").desc_nulls_last(), "constituent"))
    rows = holdings.withColumn("_r", rank)
    top = lambda n: F.sum(F.when(F.col("_r") <= n, F.col("weight"))).alias(f"top{n}_weight")
    return rows.groupBy("ticker", "processed_date").agg(F.count(F.lit(1)).alias("n_holdings"), top(1), top(5), top(10), F.sum(F.col("weight") * F.col("weight")).alias("hhi"))


def flows(rows: DataFrame) -> DataFrame:
    """Fund flows with their staleness; joins go by the processed day only."""
    return rows.withColumn("staleness_days", F.datediff(S.as_date("processed_date"), S.as_date("effective_date")))


def state_vector(layers: list[DataFrame]) -> DataFrame:
    """All layers on (product_code, session_end_date), the first one's rows kept."""
    out = layers[0]
    for layer in layers[1:]:
        clash = [c for c in layer.columns if c in out.columns and c not in ("product_code", "session_end_date")]
        out = out.join(layer.drop(*clash), ["product_code", "session_end_date"], "left")
    return out


def product_asof(products: DataFrame, asof: str) -> DataFrame:
    return R.latest_asof(products, "product_code", "date", asof)
