"""What the serving edge answers, as functions over a catalog; a web framework would only route to these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import frames as R
from ..operators import pit
from ..sources.catalog import Catalog
from . import backtest as B

MOST_ROWS, DEFAULT_ROWS, MOST_SAMPLE = 10_000, 500, 1_000
FREQUENCIES = ("none", "daily", "weekly", "monthly")


class BadRequest(ValueError):
    """A request that can't be answered, with the reason."""


class Service:
    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    def health(self) -> dict:
        return {"status": "ok", "panels": len(self.catalog.names()), "last_day": self.catalog.last_day() if "stocks_daily" in self.catalog.names() else None}

    def universe(self) -> DataFrame:
        return self.catalog.universe()

    def panels(self) -> dict[str, int]:
        return self.catalog.counts()

    def rows(self, name: str, ticker=None, start=None, end=None, limit: int = DEFAULT_ROWS) -> DataFrame:
        if not 0 < limit <= MOST_ROWS:
            raise BadRequest(f"limit must be 1 to {MOST_ROWS}")
        return self.catalog.get(name, ticker, start, end, limit)

    def sample(self, name: str, n: int = 10, seed: int = 42) -> DataFrame:
        if not 0 < n <= MOST_SAMPLE:
            raise BadRequest(f"n must be 1 to {MOST_SAMPLE}")
        return R.sample_rows(self.catalog.scan(name), n, seed)

    def asof(self, ticker: str, day) -> DataFrame:
        return pit.fundamentals_asof(self.catalog.scan("fundamentals_actuals"), self.catalog.scan("report_calendar_us"), day, ticker=ticker)

    def calendar(self, ticker=None) -> DataFrame:
        return pit.calendar(self.catalog.scan("report_calendar_us"), ticker)

    def most_traded(self, k: int = 10, days: int = 45) -> DataFrame:
        """Tickers by mean dollar volume of their last 20 bars within the last days."""
        rows = self.catalog.scan("stocks_daily", start=str(self.catalog.spark.sql(f"select date_sub(date'{self.catalog.last_day()}', {int(days)})").first()[0]))
        traded = rows.withColumn("_money", F.col("close") * F.col("volume"))
        return R.top_k(R.tail_mean(traded, "ticker", "date", "_money", 20, "adv20"), "adv20", k, "ticker")

    def screen(self, sector: str | None = None, k: int = 10) -> DataFrame:
        rows = self.most_traded(10_000 if sector else k)
        if sector:
            rows = rows.join(self.catalog.sectors().filter(S.matches("sector", sector)).select("ticker"), "ticker", "left_semi")
        return R.top_k(rows, "adv20", k, "ticker")

    def returns(self, tickers: list[str], start, end, dividends: bool = False) -> DataFrame:
        stocks = [t for t in tickers if not t.startswith("O:") and t != B.CASH]
        options = [t for t in tickers if t.startswith("O:")]
        parts = [self.catalog.get(name, own, start, end) for name, own in (("stocks_daily", stocks), ("options_daily", options)) if own]
        prices = R.union_by_name(*[p.select("ticker", S.as_date("date").alias("date"), "close") for p in parts])
        actions = self.catalog.access("corporate_actions", start, end, ticker=tickers)
        events = actions.select("ticker", F.col("ex_date").alias("date"), "kind", "value")
        paid = events.filter(F.col("kind").startswith("dividend")) if dividends else None
        return B.leg_returns(prices, paid, events.filter("kind = 'split'").withColumnRenamed("value", "factor"))

    def backtest(self, holdings: dict[str, float], start, end, rebalance: str = "none", cost_bps: float | None = None, dividends: bool = False) -> dict:
        """Metrics of a book; weights must be positive and sum to about 1."""
        if not holdings or any(w < 0 for w in holdings.values()) or abs(sum(holdings.values()) - 1) > 0.01:
            raise BadRequest("weights must be at least 0 and sum to 1")
        if rebalance not in FREQUENCIES:
            raise BadRequest(f"rebalance must be one of {FREQUENCIES}")
        book = self.catalog.spark.createDataFrame([("book", t, float(w)) for t, w in sorted(holdings.items())], "book string, ticker string, weight double")
        paths = B.static_paths(book, self.returns(list(holdings), start, end, dividends), rebalance, cost_bps)
        row = B.performance(paths).first()
        return {} if row is None else {k: v for k, v in row.asDict().items() if k != "book"}

    def decide(self, records: str, start, end, cost_bps: float | None = None) -> dict:
        """Metrics of a decision series, or its errors."""
        source = self.catalog.spark.createDataFrame([("book", records)], "book string, records string")
        good, errors = B.decisions(source)
        found = [f"record {r['record']}: {r['error']}" for r in errors.orderBy("record").collect()]
        if found:
            raise BadRequest("; ".join(found))
        tickers = sorted({r[0] for r in good.select(F.explode(F.map_keys("weights"))).distinct().collect()})
        row = B.performance(B.series_paths(good, self.returns(tickers, start, end), cost_bps)).first()
        return {} if row is None else {k: v for k, v in row.asDict().items() if k != "book"}
