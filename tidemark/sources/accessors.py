"""Named readers over a catalog: each is a panel, its key filters, an inclusive range and its own rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import occ
from ..operators import frames as R
from ..operators import pit
from ..operators.rolling import Series
from .catalog import DEFAULT_LIMIT, Catalog
from .panels import EMPTY

CHAIN_LIMIT = 5_000
# Sectors that never change, as they name a kind of instrument.
IMMUTABLE_SECTORS = ("fund", "preferred", "adr", "unit", "spac", "rights", "warrant")
DAILY = Series.of("ticker", "date")


class Dataset(Catalog):
    """The catalog with a method for every question it is commonly asked."""

    # Equities

    def prices(self, ticker, start=None, end=None) -> DataFrame:
        """Daily bars with the one-day return."""
        rows = R.get(self.scan("stocks_daily", start, end), ticker, start, end)
        return rows.withColumn("ret_1d", DAILY.returns("close")).orderBy("ticker", "date")

    def adv(self, ticker, days: int = 20) -> DataFrame:
        """Daily bars with the mean dollar volume of some days, none before there are that many."""
        rows = self.get("stocks_daily", ticker).withColumn("_money", F.col("close") * F.col("volume"))
        return rows.withColumn(f"adv_{days}", DAILY.mean("_money", days)).drop("_money").orderBy("ticker", "date")

    def benchmark(self, index: str = "SPX") -> DataFrame:
        return self.access("index_daily", index=index).orderBy("date")

    def structural(self, name: str) -> DataFrame:
        return self.scan(name)

    def fundamentals(self, ticker, asof=None) -> DataFrame:
        rows = self.scan("fundamentals_actuals")
        if asof is None:
            return R.get(rows, ticker)
        return pit.fundamentals_asof(rows, self.scan("report_calendar_us"), asof, ticker=ticker).orderBy("date")

    def asof(self, ticker, on) -> DataFrame:
        return self.fundamentals(ticker, on)

    def calendar(self, ticker=None) -> DataFrame:
        return pit.calendar(self.scan("report_calendar_us"), ticker)

    def sector_history(self, tickers=None, start=None, end=None) -> DataFrame:
        return self.access("sector_history", start, end, ticker=tickers)

    def sector_map(self, asof=None) -> DataFrame:
        """Rows (ticker, sector): today's labels, or those knowable at a date."""
        current = self.sectors()
        current = current if "sector" in current.columns else current.withColumn("sector", F.lit(None).cast("string"))
        if asof is None:
            return current.select("ticker", F.nullif("sector", F.lit("")).alias("sector"))
        return R.sector_at(current, self.access("sector_history"), current, str(asof)[:10], IMMUTABLE_SECTORS)

    def splits(self, tickers=None, start=None, end=None) -> DataFrame:
        rows = self.access("corporate_actions", start, end, ticker=tickers, kind="split")
        return rows.select("ticker", F.col("ex_date").alias("date"), F.col("value").cast("double").alias("factor"))

    def dividends(self, tickers=None, start=None, end=None) -> DataFrame:
        rows = self.access("corporate_actions", start, end, ticker=tickers).filter(F.col("kind").startswith("dividend"))
        return rows.groupBy("ticker", F.col("ex_date").alias("date")).agg(F.sum("value").alias("value"))

    def guidance(self, ticker=None) -> DataFrame:
        return self.access("guidance_all", ticker=ticker)

    def holidays(self) -> DataFrame:
        return self.access("market_holidays")

    def short_interest(self, tickers=None, start=None, end=None, knowable_by=None) -> DataFrame:
        """Positions by settlement date; ``knowable_by`` keeps those settled two weeks before a date."""
        rows = self.access("short_interest", start, end, ticker=tickers)
        return rows if knowable_by is None else rows.filter(F.date_add("settlement_date", 14) <= F.lit(str(knowable_by)[:10]).cast("date"))

    def short_volume(self, tickers=None, start=None, end=None, knowable_by=None) -> DataFrame:
        """Daily flows; a day's row is knowable on the next."""
        rows = self.access("short_volume", start, end, ticker=tickers)
        return rows if knowable_by is None else rows.filter(F.col("date") < str(knowable_by)[:10])

    def news(self, tickers=None, start=None, end=None) -> DataFrame:
        return self.access("news", start, end, ticker=tickers)

    # Options and derived panels

    def options_chain(self, root: str, on=None, limit: int = CHAIN_LIMIT) -> DataFrame:
        rows = self.scan("options_daily", on, on).filter(occ.root_of("ticker") == root)
        return rows.limit(limit)

    def options_greeks(self, root: str, on=None, limit: int = CHAIN_LIMIT) -> DataFrame:
        return self.access("options_greeks_daily", on, on, root=root, limit=limit)

    def smile(self, ticker=None, start=None, end=None) -> DataFrame:
        return self.access("options_smile_daily", start, end, ticker=ticker, limit=DEFAULT_LIMIT)

    def microstructure(self, ticker=None, start=None, end=None) -> DataFrame:
        return self.access("microstructure_daily", start, end, ticker=ticker, limit=DEFAULT_LIMIT)

    def state_vector(self, ticker=None, start=None, end=None, pca: bool = False) -> DataFrame:
        return self.access("state_vector_pca" if pca else "state_vector", start, end, ticker=ticker)

    def options_snapshots(self, underlying=None, captured_date=None) -> DataFrame:
        return self.access("options_snapshots", captured_date, captured_date, underlying=underlying)

    # Futures and funds

    def futures_products(self, roots=None, asof=None) -> DataFrame:
        rows = self.access("futures_products", product_code=roots)
        return rows if asof is None else R.latest_asof(rows, "product_code", "date", str(asof)[:10])

    def futures_contracts(self, tickers=None, roots=None, start=None, end=None, singles_only: bool = True) -> DataFrame:
        rows = self.access("futures_contracts", start, end, ticker=tickers, product_code=roots)
        return rows.filter(~F.contains("ticker", F.lit("-"))) if singles_only else rows

    def futures_schedules(self, roots=None, start=None, end=None) -> DataFrame:
        return self.access("futures_schedules", start, end, product_code=roots)

    def futures_sessions(self, tickers=None, roots=None, start=None, end=None) -> DataFrame:
        return self.access("futures_sessions", start, end, ticker=tickers, product_code=roots)

    def futures_minute(self, tickers=None, roots=None, start=None, end=None, front_only: bool = False) -> DataFrame:
        rows = self.access("futures_minute", start, end, ticker=tickers, product_code=roots)
        return rows.filter("is_front_day") if front_only else rows

    def futures_meta(self) -> DataFrame:
        return self.access("futures_meta")

    def futures_roll(self, roots=None, start=None, end=None) -> DataFrame:
        return self.access("futures_roll", start, end, product_code=roots)

    def futures_labels(self, tickers=None, roots=None, start=None, end=None, labeled_only: bool = False) -> DataFrame:
        keys = {"ticker": tickers} | ({"product_code": roots} if roots is not None else {})
        rows = self.access("futures_labels", start, end, **keys)
        return rows.filter("y_cc is not null") if labeled_only else rows

    def anchor_daily(self, tickers=None, start=None, end=None) -> DataFrame:
        return self.access("anchor_daily", start, end, ticker=tickers)

    def futures_anchor_map(self) -> DataFrame:
        return self.access("futures_anchor_map")

    def futures_anchors(self, roots=None, start=None, end=None) -> DataFrame:
        return self.access("futures_anchors", start, end, product_code=roots)

    def futures_vol(self, roots=None, start=None, end=None) -> DataFrame:
        return self.access("futures_vol", start, end, product_code=roots)

    def futures_macro(self, start=None, end=None) -> DataFrame:
        return self.access("futures_macro", start, end)

    def futures_news(self, product_code=None, start=None, end=None) -> DataFrame:
        return self.access("futures_news", start, end, product_code=product_code)

    def futures_ticks(self, product_code=None, ticker=None, session=None, kind=None, limit: int | None = None) -> DataFrame:
        return self.access("futures_ticks", session, session, product_code=product_code, ticker=ticker, kind=kind, limit=limit)

    def futures_micro(self, product_code=None, start=None, end=None) -> DataFrame:
        return self.access("futures_micro", start, end, product_code=product_code)

    def etf_flows(self, ticker=None, start=None, end=None) -> DataFrame:
        return self.access("etf_flows", start, end, ticker=ticker)

    def etf_constituents(self, ticker=None, start=None, end=None) -> DataFrame:
        return self.access("etf_constituents", start, end, ticker=ticker)

    def etf_profiles(self, ticker=None) -> DataFrame:
        return self.access("etf_profiles", ticker=ticker)

    def apex_constraints(self, scope=None, product_code=None) -> DataFrame:
        return self.access("apex_constraints", scope=scope, product_code=product_code)

    def futures_state_vector(self, roots=None, start=None, end=None) -> DataFrame:
        return self.access("futures_state_vector", start, end, product_code=roots)

    def declared(self, name: str) -> list[str]:
        """The columns that a panel has at least."""
        return [c.split()[0] for c in EMPTY[name].split(", ")]
