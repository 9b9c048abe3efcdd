"""Point-in-time rules: what was knowable when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S

HOLDOUT_DAYS = 30
# Fixed windows of the rules, in days after the period's end.
FILED_AFTER, FILED_WITHIN = 5, 120
KNOWN_AFTER, KNOWN_WITHIN, KNOWN_DEFAULT = 4, 95, 45
LATE_HOUR = 16


def holdout_mask(on: str = "date", days: int = HOLDOUT_DAYS, end=None) -> Column:
    """Rows inside the sealed trailing holdout."""
    return F.col(on) >= F.date_sub(F.current_date() if end is None else F.lit(end).cast("date"), days)


def holdout_cutoff(df: DataFrame, on: str = "date", days: int = HOLDOUT_DAYS) -> DataFrame:
    """One row: the first day of the holdout, counted from the last day there is."""
    return df.agg(F.date_sub(F.max(F.to_date(on)), days).alias("cutoff"))


def calendar(filings: DataFrame, ticker=None) -> DataFrame:
    out = filings.filter(F.col("filing_date").isNotNull())
    return (out if ticker is None else out.filter(S.any_of("ticker", ticker))).orderBy("filing_date")


def fundamentals_asof(rows: DataFrame, filings: DataFrame, asof, *, ticker=None, distinct: bool = True) -> DataFrame:
    """Rows whose period had been filed by a date: a filing 5 to 120 days after the period's end.

    For tickers without any filing by then all periods up to the date count (not
    safe, but better than none). ``distinct=False`` repeats a row for each filing.
    """
    day = F.lit(str(asof)[:10]).cast("date")
    if ticker is not None:
        rows = rows.filter(S.any_of("ticker", ticker))
    rows = rows.filter(S.as_date("date") <= day)
    seen = filings.filter(S.as_date("filing_date") <= day).select("ticker", S.as_date("filing_date").alias("_filed"))
    period = S.as_date(rows["date"])
    window = (F.col("_filed") > F.date_add(period, FILED_AFTER)) & (F.col("_filed") <= F.date_add(period, FILED_WITHIN))
    on = (rows["ticker"] == seen["ticker"]) & window
    visible = rows.join(seen, on, "left_semi") if distinct else rows.join(seen, on).select(*[rows[c] for c in rows.columns])
    return visible.unionByName(rows.join(seen.select("ticker").distinct(), "ticker", "left_anti").select(*rows.columns))


def knowable_dates(periods: DataFrame, filings: DataFrame) -> DataFrame:
    """To rows (ticker, date = period end) adds ``asof``: when the period's figures could be known.

    The earliest filing made for exactly that period, else the first filing later
    than 4 and within 95 days, else 45 days after the end. A filing accepted at or
    after 16 h counts from the next day.
    """
    late = F.lit(0)
    if "acceptance_datetime" in filings.columns:
        accepted = F.try_to_timestamp(F.regexp_replace(F.col("acceptance_datetime").cast("string"), r"(Z|[+-]\d\d:?\d\d)$", ""))
        late = F.coalesce((F.hour(accepted) >= LATE_HOUR).cast("int"), F.lit(0))
    exact = S.as_date("period_end") if "period_end" in filings.columns else F.lit(None).cast("date")
    f = filings.filter("filing_date is not null").select(F.col("ticker").alias("_t"), F.date_add(S.as_date("filing_date"), late).alias("_known"), exact.alias("_period"))
    keys = periods.select(F.col("ticker").alias("_pt"), S.as_date("date").alias("_end")).distinct()
    own = f.filter("_period is not null").groupBy("_t", "_period").agg(F.min("_known").alias("_own"))
    near = keys.join(f, (F.col("_pt") == F.col("_t")) & (F.col("_known") > F.date_add("_end", KNOWN_AFTER)) & (F.col("_known") <= F.date_add("_end", KNOWN_WITHIN))).groupBy("_pt", "_end").agg(F.min("_known").alias("_near"))
    known = keys.join(own, (F.col("_pt") == F.col("_t")) & (F.col("_end") == F.col("_period")), "left").drop("_t", "_period").join(near, ["_pt", "_end"], "left")
    known = known.select("_pt", "_end", F.coalesce("_own", "_near", F.date_add("_end", KNOWN_DEFAULT)).alias("asof"))
    return periods.join(known, (periods["ticker"] == F.col("_pt")) & (S.as_date(periods["date"]) == F.col("_end")), "left").drop("_pt", "_end")
