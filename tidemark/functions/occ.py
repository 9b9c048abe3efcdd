"""OCC option symbols as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import col

# Fixed format: prefix, root, YYMMDD, C or P, strike in thousandths on eight digits.
PATTERN = r"^O:([A-Z]+)(\d{2})(\d{2})(\d{2})([CP])(\d{8})$"
LOOSE = r"^O:([A-Z0-9.]+?)(\d{2})(\d{2})(\d{2})([CP])(\d{8})$"
YEAR_DAYS = 365.25
#: Tradeable contracts: years to expiry between a week and a year, as the same division.
MIN_YEARS, MAX_YEARS = 7 / YEAR_DAYS, 370 / YEAR_DAYS


def parse(symbol: Column | str, pivot: int | None = None, loose: bool = False) -> Column:
    """Struct (root, expiry, cp, strike), NULL for anything else.

    Years are 20YY; with ``pivot`` those from it on are 19YY.
    """
    s, pattern = col(symbol), LOOSE if loose else PATTERN
    part = lambda k: F.regexp_extract(s, pattern, k)
    yy = part(2).try_cast("int")
    year = yy + (F.when(yy < pivot, 2000).otherwise(1900) if pivot is not None else F.lit(2000))
    expiry = F.try_to_timestamp(F.when(s.rlike(pattern), F.concat_ws("-", year.cast("string"), part(3), part(4))), F.lit("yyyy-MM-dd")).cast("date")
    strike = part(6).try_cast("double") / 1000
    return F.when(s.rlike(pattern) & expiry.isNotNull(), F.struct(part(1).alias("root"), expiry.alias("expiry"), part(5).alias("cp"), strike.alias("strike")))


def symbol(root: Column | str, expiry: Column | str, cp: Column | str, strike: Column | str) -> Column:
    return F.concat(F.lit("O:"), col(root), F.date_format(col(expiry), "yyMMdd"), col(cp), F.lpad(F.round(col(strike) * 1000).cast("long").cast("string"), 8, "0"))


def side(symbol_column: Column | str) -> Column:
    """``call`` or ``put``."""
    return F.when(parse(symbol_column)["cp"] == "C", "call").when(parse(symbol_column)["cp"] == "P", "put")


def is_option(ticker: Column | str) -> Column:
    return F.startswith(col(ticker), F.lit("O:"))


def root_of(symbol_column: Column | str) -> Column:
    """The letters after the prefix, empty text read as NULL."""
    return F.nullif(F.regexp_extract(col(symbol_column), r"^O:([A-Z]+)", 1), F.lit(""))


def years_to(expiry: Column | str, on: Column | str) -> Column:
    return F.datediff(col(expiry), col(on)) / F.lit(YEAR_DAYS)


def tradeable(symbol_column: Column | str, on: Column | str, close: Column | str, volume: Column | str) -> Column:
    """Priced and traded contracts between a week and a year from expiry."""
    t = years_to(parse(symbol_column)["expiry"], on)
    return (col(close) > 0) & (col(volume) > 0) & t.between(MIN_YEARS, MAX_YEARS)
