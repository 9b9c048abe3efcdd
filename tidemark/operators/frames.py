"""Relational building blocks: selection, top-k, grouping to one row, reshaping, exact joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S


def ticker_column(df: DataFrame) -> str | None:
    """``ticker``, else ``ticker_bbg``, else none."""
    return next((c for c in ("ticker", "ticker_bbg") if c in df.columns), None)


def get(df: DataFrame, ticker=None, start=None, end=None, limit: int | None = None, date: str = "date") -> DataFrame:
    """Rows of some tickers in an inclusive range of dates.

    A ticker on a panel that has none raises; a range on a panel without dates is
    ignored. ``limit`` keeps any rows: give an order first to fix which.
    """
    if ticker is not None:
        name = ticker_column(df)
        if name is None:
            raise ValueError("this panel has no ticker column")
        df = df.filter(S.any_of(name, ticker))
    if date in df.columns:
        kind = df.schema[date].dataType.simpleString()
        own = F.col(date) if kind in ("date", "string") else F.to_date(date)
        for bound, keep in ((start, lambda b: own >= b), (end, lambda b: own <= b)):
            if bound is not None:
                df = df.filter(keep(F.lit(str(bound)[:10]).cast(kind if kind == "string" else "date")))
    return df if limit is None else df.limit(int(limit))


def union_by_name(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; columns by name, missing ones null, types widened."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same on every run: smallest seeded hashes of the whole row."""
    row = F.to_json(F.struct(*df.columns))
    return df.orderBy(F.xxhash64(F.lit(seed), row), row).limit(n)


def top_k(df: DataFrame, by: Column | str, k: int, *ties: str) -> DataFrame:
    return df.orderBy(S.col(by).desc_nulls_last(), *ties).limit(k)


def tail_n(df: DataFrame, by, order, n: int) -> DataFrame:
    """The last ``n`` rows of each group in the order given."""
    order = [order] if isinstance(order, str) else list(order)
    rank = F.row_number().over(Window.partitionBy(*_list(by)).orderBy(*[F.col(o).desc() for o in order]))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def tail_mean(df: DataFrame, by, order, value: str, n: int, name: str) -> DataFrame:
    """Mean of a value over each group's last ``n`` rows."""
    return tail_n(df, by, order, n).groupBy(*_list(by)).agg(F.avg(value).alias(name))


def latest(df: DataFrame, by, order: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """The row of the greatest ``order`` in each group, all columns; no sort, one partial aggregate."""
    by = _list(by)
    rest = [c for c in df.columns if c not in by]
    one = F.max_by(F.struct(*rest), F.struct(order, *ties)) if rest else F.count(F.lit(1))
    return df.groupBy(*by).agg(one.alias("_one")).select(*by, "_one.*").select(*df.columns)


def latest_asof(df: DataFrame, by, order: str, asof, ties: tuple[str, ...] = ()) -> DataFrame:
    """The last row of each group at or before a date."""
    return latest(df.filter(F.col(order) <= F.lit(asof)), by, order, ties)


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def duplicates(df: DataFrame, *by: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def pivot_wide(df: DataFrame, index: str, key: str, value: str, keys: list) -> DataFrame:
    """One row per index, one column per key; the keys are given, so no extra pass finds them."""
    return df.groupBy(index).pivot(key, keys).agg(F.first(value, ignorenulls=True))


def unpivot_long(df: DataFrame, index, columns: list[str], key: str = "key", value: str = "value", keep_nulls: bool = True) -> DataFrame:
    out = df.unpivot(_list(index), columns, key, value)
    return out if keep_nulls else out.filter(F.col(value).isNotNull())


def grid(df: DataFrame, by: str, on: str) -> DataFrame:
    """Every (group, day) between a group's first and last day, on the days that any group has.

    One row a group and day, from ranges of the calendar's positions: no cross join.
    """
    days = df.select(on).distinct().withColumn("_n", F.row_number().over(Window.orderBy(on)))
    placed = df.select(by, on).join(days, on)
    spans = placed.groupBy(by).agg(F.min("_n").alias("_a"), F.max("_n").alias("_b"))
    return spans.select(by, F.explode(F.sequence("_a", "_b")).alias("_n")).join(days, "_n").select(by, on)


def semi(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Rows without a partner; unlike NOT IN, a null on the right excludes nothing."""
    return left.join(right, on, "left_anti")


def sector_at(tickers: DataFrame, history: DataFrame, current: DataFrame, asof, immutable: tuple[str, ...]) -> DataFrame:
    """Rows (ticker, sector) as knowable at a date: the last filed sector, else the current label if it can't change."""
    filed = history.filter((F.col("filed") <= F.lit(asof)) & (F.coalesce(F.col("sector"), F.lit("")) != "")).groupBy("ticker").agg(F.max_by("sector", F.struct("filed", "sector")).alias("_then"))
    now = current.select("ticker", F.col("sector").alias("_now"))
    joined = tickers.select("ticker").distinct().join(filed, "ticker", "left").join(now, "ticker", "left")
    return joined.select("ticker", F.coalesce("_then", F.when(F.col("_now").isin(*immutable), F.col("_now"))).alias("sector"))


def range_join(left: DataFrame, right: DataFrame, by, condition: Column, distinct: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Equal keys and any further condition; ``distinct`` keeps each left row once (a semi join)."""
    by = _list(by)
    on = reduce(lambda a, b: a & b, [left[k] == right[k] for k in by]) & condition
    if distinct:
        return left.join(right, on, "left_semi")
    out = left.join(right, on)
    return out.select(*[left[c] for c in left.columns], *[right[c] for c in keep or []])


def cross_z(df: DataFrame, columns: list[str], fill: float | None = None) -> DataFrame:
    """z-scores over all rows: one row of means and deviations, joined to every row as a constant."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    out = df.crossJoin(F.broadcast(stats))
    for c in columns:
        z = S.div(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}"))
        out = out.withColumn(c, z if fill is None else F.coalesce(z, F.lit(fill)))
    return out.drop(*stats.columns)


def _list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)
