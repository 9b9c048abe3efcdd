"""Null-safe scalar columns: one missing value (NULL), and no arithmetic that can raise under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """NaN and the infinities as NULL."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def clean_doubles(df: DataFrame) -> DataFrame:
    """Every float column of a frame through ``clean``; used on ingest."""
    found = {f.name: clean(F.col(f"`{f.name}`")) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(found) if found else df


def div(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is zero or NULL."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def div_ieee(a: Column | str, b: Column | str) -> Column:
    """a / b as floating point has it: infinite or NaN where b is zero."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(F.try_divide(a, b))


def ln_ieee(c: Column | str) -> Column:
    """Natural logarithm as floating point has it: minus infinity at zero, NaN below."""
    c = col(c).cast("double")
    return F.when(c > 0, F.ln(c)).when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(float("nan")))


def ln(c: Column | str) -> Column:
    """Natural logarithm, NULL at or below zero."""
    c = col(c).cast("double")
    return F.when(c > 0, F.ln(c))


def sqrt(c: Column | str) -> Column:
    c = col(c).cast("double")
    return F.when(c >= 0, F.sqrt(c))


def clip(c: Column | str, lo: float, hi: float) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def row_mean(*columns: Column | str) -> Column:
    """Mean of the values that are there."""
    cs = [col(c) for c in columns]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cs[1:]), F.coalesce(cs[0], F.lit(0.0)))
    n = sum((c.isNotNull().cast("int") for c in cs[1:]), cs[0].isNotNull().cast("int"))
    return div(total, n)


def half_even(c: Column | str, scale: int = 0) -> Column:
    """Round half to even, as Python's round does."""
    return F.bround(col(c), scale)


def rounded(c: Column | str, digits: int) -> Column:
    """Round as SQL engines on floating point do: scaled, half away from zero, scaled back.

    Spark's own rounds the shortest decimal that reads as the value, which differs
    where the scaled value is just beside a half.
    """
    scale = F.lit(10.0**digits)
    y = col(c) * scale
    even = F.rint(y)
    away = F.when((y > 0) & (y - even == 0.5), even + 1).when((y < 0) & (y - even == -0.5), even - 1).otherwise(even)
    return (away + F.lit(0.0)) / scale


def any_of(c: Column | str, values) -> Column:
    """IN list; a bare string is one value, not its letters."""
    values = [values] if isinstance(values, str) or not hasattr(values, "__iter__") else list(values)
    return col(c).isin(values)


def matches(c: Column | str, pattern: str) -> Column:
    """Case-insensitive regular expression search; NULL counts as no match."""
    return F.coalesce(col(c).rlike(f"(?i){pattern}"), F.lit(False))


def null_or(c: Column | str, condition: Column) -> Column:
    return col(c).isNull() | condition


def as_date(c: Column | str) -> Column:
    """A date from a date, a timestamp or the first ten characters of a string."""
    return F.to_date(F.substring(col(c).cast("string"), 1, 10))


def day(df: DataFrame, c: str = "date") -> Column:
    """``as_date`` of a frame's column; one that is a date is taken as it is, without text."""
    return F.col(c) if df.schema[c].dataType == T.DateType() else as_date(c)


def opex(c: Column | str) -> Column:
    """The third Friday of the date's month."""
    return F.date_add(F.next_day(F.date_sub(F.trunc(col(c), "month"), 1), "FRI"), 14)


def next_opex(c: Column | str) -> Column:
    """The first third Friday on or after the date."""
    d = col(c)
    return F.when(opex(d) >= d, opex(d)).otherwise(opex(F.add_months(F.trunc(d, "month"), 1)))


def epoch_seconds(c: Column | str) -> Column:
    """ISO-8601 text with Z, an offset or none (UTC) as seconds; NULL if it can't be read."""
    return F.try_to_timestamp(col(c)).cast("double")


def day_ns(c: Column | str, add: int = 0) -> Column:
    """Nanoseconds since the epoch at the start of a date, ``add`` days later."""
    return (F.unix_date(col(c)).cast("long") + add) * F.lit(86_400_000_000_000)


def day_ms(c: Column | str, add: int = 0) -> Column:
    return (F.unix_date(col(c)).cast("long") + add) * F.lit(86_400_000)
