"""What each panel is keyed by, how its time column is filtered, and its columns when absent."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S


@dataclass(frozen=True)
class Spec:
    """``kind`` of the time column: date, text (ISO days, compared as text), stamp (by its day) or ns (epoch)."""

    time: str | None = None
    kind: str = "date"

    def between(self, df: DataFrame, start=None, end=None) -> DataFrame:
        c = F.col(self.time)
        day = lambda x: F.lit(str(x)[:10]).cast("date")
        low, high = {
            "date": lambda: (lambda x: c >= day(x), lambda x: c <= day(x)),
            "text": lambda: (lambda x: c >= str(x)[:10], lambda x: c <= str(x)[:10]),
            "stamp": lambda: (lambda x: F.to_date(c) >= day(x), lambda x: F.to_date(c) <= day(x)),
            "ns": lambda: (lambda x: c >= S.day_ns(day(x)), lambda x: c < S.day_ns(day(x), 1)),
        }[self.kind]()
        if start is not None:
            df = df.filter(low(start))
        return df if end is None else df.filter(high(end))


# Time columns of the panels.
SPECS: dict[str, Spec] = {
    "sector_history": Spec("filed"), "short_interest": Spec("settlement_date"), "news": Spec("published_utc", "stamp"), "short_volume": Spec("date", "text"),
    "futures_products": Spec("date", "text"), "futures_contracts": Spec("date", "text"), "futures_schedules": Spec("session_end_date", "text"), "futures_sessions": Spec("session_end_date", "text"),
    "futures_minute": Spec("window_start", "ns"), "futures_meta": Spec(), "futures_roll": Spec("date", "text"), "futures_labels": Spec("session_end_date", "text"),
    "anchor_daily": Spec("date", "text"), "futures_anchor_map": Spec(), "futures_anchors": Spec("session_end_date", "text"), "futures_vol": Spec("session_end_date", "text"),
    "futures_macro": Spec("session_end_date", "text"), "futures_news": Spec("session_end_date", "text"), "futures_ticks": Spec("session_end_date", "text"), "futures_micro": Spec("session_end_date", "text"),
    "etf_flows": Spec("processed_date", "text"), "etf_constituents": Spec("processed_date", "text"), "etf_profiles": Spec(), "options_snapshots": Spec("captured_date", "text"),
    "apex_constraints": Spec(), "futures_state_vector": Spec("session_end_date", "text"), "corporate_actions": Spec("ex_date"), "guidance_all": Spec("date"), "market_holidays": Spec(), "index_daily": Spec("date"),
    "options_greeks_daily": Spec("date"), "options_smile_daily": Spec("date"), "microstructure_daily": Spec("date"), "state_vector": Spec("date"), "state_vector_pca": Spec("date"),
}

# Declared columns of absent panels.
EMPTY: dict[str, str] = {
    "sector_history": "ticker string, cik string, filed date, sic_code string, sector string, form string",
    "short_interest": "ticker string, settlement_date date, short_interest double, avg_daily_volume double, days_to_cover double",
    "news": "id string, published_utc timestamp_ntz, ticker string, sentiment string, sentiment_reasoning string, title string, description string, publisher string, article_url string",
    "short_volume": "date string, ticker string, total_volume double, short_volume double, exempt_volume double, non_exempt_volume double, short_volume_ratio double",
    "futures_products": "product_code string, date string",
    "futures_contracts": "ticker string, product_code string, date string",
    "futures_schedules": "product_code string, session_end_date string, event string, timestamp string",
    "futures_sessions": "ticker string, product_code string, session_end_date string, window_start long, open double, high double, low double, close double, volume double, settlement_price double",
    "futures_minute": "ticker string, product_code string, window_start long, session_end_date string, open double, high double, low double, close double, volume double, is_front_day boolean",
    "futures_meta": "product_code string, parent_code string, is_micro boolean",
    "futures_roll": "product_code string, date string, front_ticker string, is_roll_day boolean",
    "futures_labels": "ticker string, product_code string, session_end_date string, y_cc double, y_oc double, y_settle double, horizon_hours double",
    "anchor_daily": "ticker string, date string, close double",
    "futures_anchor_map": "product_code string, anchor_ticker string, anchor_kind string, direction string, is_proxy boolean",
    "futures_anchors": "product_code string, session_end_date string, front_ticker string, front_rule string, fut_close double, anchor_close double, basis_bps double",
    "futures_vol": "product_code string, session_end_date string, front_ticker string, rv_21d double, adv_share double, vix_close double",
    "futures_macro": "session_end_date string, conditions__effr double, yields__ust10y double, curve_2s10 double, inflation__cpi_yoy double, market__unemp double",
    "futures_news": "product_code string, session_end_date string, news_n_1d long, news_sent_mean_7d double",
    "futures_ticks": "ticker string, product_code string, session_end_date string, kind string, timestamp long",
    "futures_micro": "product_code string, session_end_date string, has_ticks boolean",
    "etf_flows": "ticker string, processed_date string, fund_flow double",
    "etf_constituents": "ticker string, processed_date string, n_holdings long",
    "etf_profiles": "ticker string",
    "options_snapshots": "captured_date string, underlying string, contract string",
    "apex_constraints": "scope string, product_code string, rule string, value double, unit string",
    "futures_state_vector": "product_code string, session_end_date string",
    "corporate_actions": "ticker string, ex_date date, kind string, value double, raw string",
    "guidance_all": "ticker string, date date, fiscal_period string, min_revenue_guidance double, max_revenue_guidance double",
    "market_holidays": "date string, name string, status string",
    "index_daily": "index string, date date, close double",
    "options_greeks_daily": "contract string, root string, date date, iv double",
    "options_smile_daily": "ticker string, date date, spot double, atm_iv_30d double, atm_iv_90d double, skew_25d double, rn_kurtosis double, term_slope double, n_contracts long",
    "microstructure_daily": "ticker string, date date, realized_vol double, amihud_illiq double, kyle_lambda double, fdt_deviation double, dollar_vol double, vwap_day double, n_bars long",
    "state_vector": "ticker string, date date, spot double",
    "state_vector_pca": "ticker string, date date",
}
