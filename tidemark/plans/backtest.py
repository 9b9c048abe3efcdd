"""Portfolio backtests: costs, drift, rebalancing, decision series, attribution.

A book's path is sequential, so one fold per book streams over its days in order
with the book's weights as state; it reads the returns that aren't 0 and holds no
more than a day of them. Books are groups: many run in parallel. All that isn't
sequential (returns, splits, metrics) is plain aggregation.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from datetime import date

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import occ
from ..functions import scalar as S
from ..operators import frames as R
from ..operators.rolling import Series

# Fixed schedule: basis points by kind of leg, and the days of a year.
CASH, OPTION_BPS, STOCK_BPS = "CASHHOLDING", 50.0, 10.0
YEAR, MIN_ANNUAL = 252, 63
MAX_WEIGHT, SUM_SLACK = 0.20, 0.01
PERFORMANCE = ("n_days", "total_return", "hit_rate", "skew", "var_95", "cvar_95", "exposure", "max_drawdown", "turnover", "cost_total", "annualized", "ann_return", "ann_vol", "sharpe", "sortino", "calmar")


def cost_bps(ticker: Column | str, override: float | None = None) -> Column:
    if override is not None:
        return F.lit(float(override))
    return F.when(S.col(ticker) == CASH, 0.0).when(occ.is_option(ticker), OPTION_BPS).otherwise(STOCK_BPS)


def leg_returns(prices: DataFrame, dividends: DataFrame | None = None, splits: DataFrame | None = None) -> DataFrame:
    """Rows (ticker, date, ret) on the grid of all days: close over the day before, 0 where either is missing.

    ``dividends`` (ticker, date, value) add their yield on the previous close;
    ``splits`` (ticker, date, factor) multiply the raw return back; days off the
    calendar don't count, several of one day multiply.
    """
    days = prices.select("date").distinct()
    # All tickers on all days: ranges of the calendar per ticker, then the ends filled up.
    calendar = days.agg(F.sort_array(F.collect_set("date")).alias("_days"))
    rows = prices.select("ticker").distinct().crossJoin(F.broadcast(calendar)).select("ticker", F.explode("_days").alias("date"))
    rows = rows.join(prices.select("ticker", "date", S.clean("close").alias("close")), ["ticker", "date"], "left")
    s = Series.of("ticker", "date")
    rows = rows.withColumn("_before", s.lag("close")).withColumn("ret", F.coalesce(S.div("close", "_before") - 1, F.lit(0.0)))
    if splits is not None:
        factor = splits.groupBy("ticker", "date").agg(F.aggregate(F.collect_list(F.col("factor").cast("double")), F.lit(1.0), lambda a, x: a * x).alias("_factor"))
        rows = rows.join(factor, ["ticker", "date"], "left").withColumn("ret", F.when(F.col("_factor").isNotNull(), (1 + F.col("ret")) * F.col("_factor") - 1).otherwise(F.col("ret")))
    if dividends is not None:
        paid = dividends.groupBy("ticker", "date").agg(F.sum("value").alias("_paid"))
        rows = rows.join(paid, ["ticker", "date"], "left").withColumn("ret", F.col("ret") + F.coalesce(S.div("_paid", "_before"), F.lit(0.0)))
    return rows.select("ticker", "date", "ret")


def sparse_returns(prices: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """The rows of ``leg_returns`` that aren't 0, and each ticker's first: the calendar (``days``, else the prices' own) has the others.

    One row a ticker and day in ``prices``; nothing is put on the grid of all days.
    """
    days = (prices if days is None else days).select("date").distinct().filter("date is not null")
    calendar = days.select("date", F.lag("date").over(Window.partitionBy(F.lit(0)).orderBy("date")).alias("_day_before"))
    s = Series.of("ticker", "date")
    rows = prices.select("ticker", "date", S.clean("close").alias("close")).withColumns({"_before": s.lag("close"), "_last": s.lag("date")})
    rows = rows.join(F.broadcast(calendar), "date", "left")
    ret = F.when(F.col("_last") == F.col("_day_before"), S.div("close", "_before") - 1)
    return rows.select("ticker", "date", F.coalesce(ret, F.lit(0.0)).alias("ret"), "_last").filter("ret <> 0 or _last is null").drop("_last")


def split_adjust(returns: DataFrame, splits: DataFrame) -> DataFrame:
    """Returns with the split days of their own calendar multiplied back."""
    factor = splits.groupBy("ticker", "date").agg(F.aggregate(F.collect_list(F.col("factor").cast("double")), F.lit(1.0), lambda a, x: a * x).alias("_f"))
    out = returns.join(factor, ["ticker", "date"], "left")
    return out.select("ticker", "date", F.when(F.col("_f").isNotNull(), (1 + F.col("ret")) * F.col("_f") - 1).otherwise(F.col("ret")).alias("ret"))


PATH = T.StructType([T.StructField("book", T.StringType()), T.StructField("date", T.DateType()), *[T.StructField(c, T.DoubleType()) for c in ("ret", "gross", "turnover", "invested")]])


class Walk:
    """One book's state: weights that drift, and what trading them cost."""

    def __init__(self, bps: np.ndarray):
        self.weights, self.bps = np.zeros(len(bps)), bps
        self.cost = self.traded = 0.0

    def start_day(self) -> None:
        self.cost = self.traded = 0.0

    def trade(self, target: np.ndarray, charged_on: np.ndarray | None = None) -> None:
        moved = np.abs(target - self.weights) if charged_on is None else charged_on
        self.cost += float(moved @ self.bps)
        self.traded += float(moved.sum())
        self.weights = target.copy()

    def earn(self, returns: np.ndarray) -> float:
        gain = float(self.weights @ returns)
        grown = self.weights * (1 + returns)
        total = grown.sum()
        self.weights = grown / total if total > 0 else grown
        return gain

    def liquidate(self, held: np.ndarray) -> None:
        self.cost += float(held @ self.bps)
        self.traded += float(held.sum())


def _period(d: date, frequency: str):
    return {"daily": d, "weekly": d.isocalendar()[:2], "monthly": (d.year, d.month)}.get(frequency)


def _static_steps(days, target: np.ndarray, bps: np.ndarray, frequency: str, exit_cost: bool):
    """Rows of a path from (date, returns, decisions, whether it is the last day): a fixed target."""
    net, gross = Walk(bps), Walk(bps * 0)
    net.weights = gross.weights = target.copy()
    before = None
    for d, returns, _, last in days:
        net.start_day()
        if before is None:
            net.trade(target, target)
        gain, plain = net.earn(returns), gross.earn(returns)
        drifted = net.weights
        if before is not None and _period(d, frequency) != _period(before, frequency):
            net.trade(target)
            gross.trade(target)
        if exit_cost and last:
            net.liquidate(drifted)
        before = d
        yield d, gain - net.cost, plain, net.traded, float(np.abs(net.weights).sum())


def _series_steps(days, bps: np.ndarray, exit_cost: bool):
    """The same for decisions: those of the first day open the book before its return, later ones follow the day's return."""
    net, gross = Walk(bps), Walk(bps * 0)
    first = True
    for d, returns, decisions, last in days:
        net.start_day()
        if first:
            for m in decisions:
                net.trade(m)
                gross.trade(m)
        gain, plain = net.earn(returns), gross.earn(returns)
        if not first:
            for m in decisions:
                net.trade(m)
                gross.trade(m)
        if exit_cost and last:
            net.liquidate(net.weights)
        first = False
        yield d, gain - net.cost, plain, net.traded, float(np.abs(net.weights).sum())


def walk_static(days: list[date], returns: np.ndarray, target: np.ndarray, bps: np.ndarray, frequency: str, exit_cost: bool = True) -> pd.DataFrame:
    """A fixed target: bought on the first day, drifting, brought back at the first day of each period."""
    stream = ((d, returns[t], [], t == len(days) - 1) for t, d in enumerate(days))
    return pd.DataFrame(list(_static_steps(stream, target, bps, frequency, exit_cost)), columns=["date", "ret", "gross", "turnover", "invested"])


# What a book's fold reads, in this order: its legs, then day by day the returns that aren't 0 and the decisions.
_LEG, _RETURN, _DECISION = 0, 1, 2
_STREAM = ("book", "date", "kind", "seq", "k", "x", "y")


def _priced(held: DataFrame, returns: DataFrame, days: DataFrame | None, override: float | None) -> DataFrame:
    """The legs (book, ticker, weight, bps, k) of (book, ticker, weight) that have a price, numbered within their book; cash always has one."""
    known = returns.select("ticker").distinct().unionByName((returns if days is None else days).limit(1).select(F.lit(CASH).alias("ticker"))).distinct()
    legs = held.groupBy("book", "ticker").agg(F.max(F.col("weight").cast("double")).alias("weight")).join(known, "ticker", "left_semi")
    return legs.withColumns({"bps": cost_bps("ticker", override), "k": F.row_number().over(Series.of("book", "ticker").window) - 1})


def _stream(legs: DataFrame, returns: DataFrame, days: DataFrame | None, moves: DataFrame | None = None) -> DataFrame:
    """All rows of ``_STREAM``, a book's in one partition and in order. Without ``days`` a book's days are those on which any of its legs has a return."""
    row = lambda df, kind, date="date", seq=0, k=None, x=None, y=None: df.select("book", F.col(date).alias("date") if date else F.lit(None).cast("date").alias("date"), F.lit(kind).alias("kind"), (F.col(seq) if isinstance(seq, str) else F.lit(seq)).cast("long").alias("seq"), *[(F.col(c) if c else F.lit(None)).cast(t).alias(n) for n, c, t in (("k", k, "int"), ("x", x, "double"), ("y", y, "double"))])
    ret = F.coalesce(S.clean("ret"), F.lit(0.0))
    earned = returns.filter("date is not null").select("ticker", "date", ret.alias("ret"))
    if days is None:
        marked = legs.filter(F.col("ticker") == CASH).select("book").distinct().crossJoin(returns.filter("date is not null").select("date").distinct())
    else:
        earned = earned.filter("ret <> 0")
        marked = legs.select("book").distinct().crossJoin(F.broadcast(days.filter("date is not null").select("date").distinct()))
    out = row(legs, _LEG, date=None, k="k", x="weight", y="bps").unionByName(row(marked, _RETURN)).unionByName(row(earned.join(legs.select("book", "ticker", "k"), "ticker"), _RETURN, k="k", x="ret"))
    if moves is not None:
        targets = moves.select("book", "date", "seq", F.explode("weights").alias("ticker", "weight")).withColumnRenamed("book", "_book")
        known = legs.select("book", "ticker", "k")
        targets = targets.join(known, (targets["_book"].eqNullSafe(known["book"])) & (targets["ticker"] == known["ticker"])).select("book", "date", "seq", "k", "weight")
        out = out.unionByName(row(moves, _DECISION, seq="seq")).unionByName(row(targets, _DECISION, seq="seq", k="k", x="weight"))
    # Of several returns of a leg and day the greatest comes last, and counts.
    return out.repartition("book").sortWithinPartitions(*_STREAM[:4], "x")


def _folded(steps):
    """Streams over rows of ``_STREAM``: of each book no more is held than its legs, a day of them, and the decisions that wait.

    ``steps`` takes the days, the target weights and the costs of a book's legs.
    """

    def runs(batches: Iterator[pa.RecordBatch]):
        """(book, date, kind, seq, k, x, y) of consecutive rows that share the first four."""
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, dtype=bool)
            new[0] = True
            heads = [batch.column(j) for j in range(4)]
            for c in heads:
                code = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            k, x, y = batch.column(4).fill_null(-1).to_numpy(zero_copy_only=False), *(batch.column(j).to_numpy(zero_copy_only=False) for j in (5, 6))
            cuts = np.append(np.flatnonzero(new), n)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield (*(c[lo].as_py() for c in heads), k[lo:hi], x[lo:hi], y[lo:hi])

    def days(rows, size: int):
        """(date, returns, decisions, whether it is the last day) of one book."""
        waiting, seq, pending = [], None, None
        for _, d, kind, number, k, x, _ in rows:
            here = k >= 0
            if kind == _RETURN:
                if pending is None or pending[0] != d:
                    if pending is not None:
                        # Only now is it known that the day before wasn't the last, and which decisions it had.
                        yield (*pending, False)
                    pending, waiting = (d, np.zeros(size), waiting), []
                pending[1][k[here]] = x[here]
            else:
                if seq != (d, number):
                    seq = (d, number)
                    mine = np.zeros(size)
                    (pending[2] if pending is not None and pending[0] == d else waiting).append(mine)
                mine[k[here]] = x[here]
        if pending is not None:
            yield (*pending, True)

    def books(batches: Iterator[pa.RecordBatch]):
        for book, rows in itertools.groupby(runs(batches), key=lambda r: r[0]):
            legs = []
            for r in rows:
                if r[2] != _LEG:
                    break
                legs.append(r)
            else:
                continue
            if not legs:
                continue
            k, x, y = (np.concatenate([leg[j] for leg in legs]) for j in (4, 5, 6))
            target, bps = np.zeros(len(k)), np.zeros(len(k))
            target[k], bps[k] = x, y / 1e4
            yield book, steps(days(itertools.chain([r], rows), len(k)), target, bps)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for book, path in books(batches):
            out = pd.DataFrame(list(path), columns=PATH.names[1:])
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array([book] * len(out), type=pa.string()), pa.array(out["date"], type=pa.date32()), *(pa.array(out[c], type=pa.float64()) for c in PATH.names[2:])], PATH.names)

    return scan


def static_paths(books: DataFrame, returns: DataFrame, frequency: str = "none", override: float | None = None, exit_cost: bool = True, days: DataFrame | None = None) -> DataFrame:
    """Daily path of every book (book, ticker, weight) over long returns (ticker, date, ret).

    Legs without a price never trade; after the first day the others are scaled up
    to 1. With ``days`` (date), ``returns`` are those of ``sparse_returns``: every
    priced leg has a return on each of these days, 0 where there is no row.
    """
    legs = _priced(books.withColumn("book", F.col("book").cast("string")), returns, days, override)
    return _stream(legs, returns, days).mapInArrow(_folded(lambda rows, target, bps: _static_steps(rows, target, bps, frequency, exit_cost)), PATH)


def series_paths(decisions: DataFrame, returns: DataFrame, override: float | None = None, exit_cost: bool = True, days: DataFrame | None = None) -> DataFrame:
    """Daily path of decision series (book, date, weights map or null to hold); ``days`` as in ``static_paths``.

    A decision on a day without trading moves to the next one; beyond the last it is ignored.
    """
    moves = decisions.filter("weights is not null and date is not null").select(F.col("book").cast("string").alias("book"), "date", F.monotonically_increasing_id().alias("seq"), "weights")
    legs = _priced(moves.select("book", F.explode("weights").alias("ticker", "weight")), returns, days, override)
    return _stream(legs, returns, days, moves).mapInArrow(_folded(lambda rows, _, bps: _series_steps(rows, bps, exit_cost)), PATH)


def performance(paths: DataFrame, by: str = "book", order: str = "date") -> DataFrame:
    """One row of metrics per book. Annual figures only from 63 days on; a ratio without a denominator is 0."""
    s = Series.of(by, order)
    # All by windows, so that the paths are walked once.
    rows = paths.withColumns({"_curve": s.running_product("ret"), "_gcurve": s.running_product("gross"), "_n": F.row_number().over(s.window), "_p5": F.percentile("ret", F.lit(0.05)).over(s.whole)})
    rows = rows.withColumn("_dd", s.drawdown("_curve"))
    ret = F.col("ret")
    out = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_days"), (F.max_by("_curve", "_n") - 1).alias("total_return"), (F.max_by("_gcurve", "_n") - 1).alias("_gross"), F.avg((ret > 0).cast("double")).alias("hit_rate"),
        F.coalesce(F.skewness(ret), F.lit(0.0)).alias("skew"), F.abs(F.max("_p5")).alias("var_95"), F.abs(F.avg(F.when(ret <= F.col("_p5"), ret))).alias("cvar_95"), F.avg("invested").alias("exposure"),
        F.abs(F.min("_dd")).alias("max_drawdown"), F.sum("turnover").alias("turnover"), F.avg(ret).alias("_mean"), F.coalesce(F.stddev_pop(ret), F.lit(0.0)).alias("_std"), F.sqrt(F.avg(F.pow(F.least(ret, F.lit(0.0)), F.lit(2)))).alias("_down"),
    )
    enough = F.col("n_days") >= MIN_ANNUAL
    growth = F.when(F.col("total_return") > -1, F.pow(1 + F.col("total_return"), F.lit(float(YEAR)) / F.col("n_days")) - 1).otherwise(-1.0)
    ratio = lambda a, b: F.when(enough, F.coalesce(S.div(a, b), F.lit(0.0)))
    out = out.withColumns({"cost_total": F.col("_gross") - F.col("total_return"), "annualized": enough, "ann_return": F.when(enough, growth), "ann_vol": F.when(enough, F.col("_std") * math.sqrt(YEAR))})
    out = out.withColumns({"sharpe": ratio(F.col("_mean") * math.sqrt(YEAR), F.col("_std")), "sortino": ratio(F.col("_mean") * math.sqrt(YEAR), F.col("_down")), "calmar": ratio(F.col("ann_return"), F.col("max_drawdown"))})
    return out.select(by, *PERFORMANCE)


def buy_and_hold(books: DataFrame, returns: DataFrame) -> DataFrame:
    """Gross daily path of books never rebalanced, in closed form: a leg's value is its weight times its own growth.

    Holds while the book's value stays positive; cash in the book counts as a leg.
    """
    s = Series.of(("book", "ticker"), "date")
    rows = returns.join(books, "ticker").withColumn("_after", F.col("weight") * s.running_product("ret"))
    rows = rows.withColumn("_before", F.coalesce(s.lag("_after"), F.col("weight")))
    return rows.groupBy("book", "date").agg((S.div(F.sum("_after"), F.sum("_before")) - 1).alias("ret"))


def attribution(books: DataFrame, returns: DataFrame, sectors: DataFrame, unmapped: str = "unmapped") -> DataFrame:
    """Exposure and buy-and-hold contribution by sector; tickers without one share a bucket, legs without returns earn 0."""
    s = Series.of("ticker", "date")
    grown = returns.withColumn("_g", s.running_product("ret")).groupBy("ticker").agg((F.max_by("_g", "date") - 1).alias("_total"))
    mapped = sectors.select("ticker", F.nullif("sector", F.lit("")).alias("_sector"))
    rows = books.join(mapped, "ticker", "left").join(grown, "ticker", "left")
    out = rows.groupBy("book", F.coalesce("_sector", F.lit(unmapped)).alias("sector")).agg(S.rounded(F.sum("weight"), 6).alias("exposure"), S.rounded(F.sum(F.col("weight") * F.coalesce("_total", F.lit(0.0))), 6).alias("contribution"), F.count(F.lit(1)).alias("n"))
    return out.orderBy("book", F.col("exposure").desc(), "sector")


# Decision series

DECISION = "array<struct<schema_version:string,decision_id:long,information_cutoff:string,decision_time:string,execution_time:string,action:string,target_holdings:array<struct<ticker:string,weight:double>>>>"


def decisions(records: DataFrame, column: str = "records", book: str = "book", record: str | None = None) -> tuple[DataFrame, DataFrame]:
    """From rows (book, JSON list of records): the decisions (book, date, weights) and the errors (book, record, error).

    With ``record``, a row is one record and that column its place in the list, so
    that a long series of large books is never one text. A book with any error has
    no decisions. Windows see a record's few own columns, never its holdings.
    """
    if record is None:
        parsed = records.select(F.col(book).cast("string").alias("book"), F.from_json(column, DECISION).alias("_r"))
        rows = parsed.select("book", F.posexplode("_r").alias("record", "r")).select("book", "record", "r.*")
    else:
        one = records.select(F.col(book).cast("string").alias("book"), F.col(record).cast("int").alias("record"), F.from_json(column, DECISION[len("array<") : -1]).alias("r"))
        rows = one.select("book", "record", "r.*")
    s = Series.of("book", "record")
    action = F.coalesce("action", F.lit("rebalance"))
    rows = rows.withColumn("action", action)
    rows = rows.withColumns({c: S.epoch_seconds(F.col(t)) for c, t in (("_ic", "information_cutoff"), ("_dt", "decision_time"), ("_et", "execution_time"))})
    total = F.aggregate(F.transform(F.filter("target_holdings", lambda x: x["ticker"].isNotNull() & (x["ticker"] != "") & (x["weight"] >= 0)), lambda x: x["weight"]), F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumns({"_sum": total, "_date": F.to_date(F.timestamp_seconds("_et"))})
    same_day = F.count(F.lit(1)).over(Series.of(("book", "_date"), "record").whole)
    bad_leg = lambda test: F.exists("target_holdings", test)
    alone = {
        "not an object": F.col("schema_version").isNull() & F.col("decision_id").isNull() & F.col("target_holdings").isNull(),
        "schema_version must be 1.0": F.coalesce(F.col("schema_version"), F.lit("")) != "1.0",
        "unreadable timestamps": F.col("_ic").isNull() | F.col("_dt").isNull() | F.col("_et").isNull(),
        "information_cutoff <= decision_time < execution_time": (F.col("_ic") > F.col("_dt")) | (F.col("_dt") >= F.col("_et")),
        "unknown action": ~F.col("action").isin("rebalance", "hold"),
        "target_holdings must be a list": F.col("target_holdings").isNull(),
        "leg without ticker": bad_leg(lambda x: x["ticker"].isNull() | (x["ticker"] == "")),
        "bad weight": bad_leg(lambda x: x["weight"].isNull() | (x["weight"] < 0)),
        "weight over the cap": bad_leg(lambda x: x["weight"] > MAX_WEIGHT + 1e-9),
        "weights must sum to 1": (F.col("action") == "rebalance") & (F.abs(F.col("_sum") - 1) > SUM_SLACK),
    }
    among = {
        "decision_id must rise": F.col("decision_id").isNull() | (F.col("decision_id") <= F.col("_prior")),
        "duplicate execution date": F.col("_date").isNotNull() & (F.col("_same") > 1),
    }
    named = lambda checks: F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks.items()]))
    prior = F.coalesce(F.max("decision_id").over(s.window.rowsBetween(-(2**31) + 1, -1)), F.lit(0))
    slim = rows.select("book", "record", "decision_id", "_date", named(alone).alias("_own")).withColumns({"_prior": prior, "_same": same_day})
    errors = slim.select("book", "record", F.explode(F.concat("_own", named(among))).alias("error"))
    if record is None:
        errors = errors.unionByName(parsed.filter(F.col("_r").isNull() | (F.size("_r") == 0)).select("book", F.lit(None).cast("int").alias("record"), F.lit("series missing or empty").alias("error")))
    weights = F.when(F.col("action") == "rebalance", F.map_from_entries(F.transform("target_holdings", lambda x: F.struct(x["ticker"], x["weight"]))))
    good = rows.join(errors.select("book").distinct(), "book", "left_anti").select("book", F.col("_date").alias("date"), weights.alias("weights"))
    return good, errors


# Book construction

# Fixed weights and limits of the screen.
NAME_CAP, SECTOR_CAP = 0.15, 0.30


def cap_weights(weights: dict[str, float], sectors: dict[str, str], name_cap: float = NAME_CAP, sector_cap: float = SECTOR_CAP) -> dict[str, float]:
    """Weights in proportion under caps on names and sectors, summing to 1; a name without a sector is one by itself.

    Two nested water levels: a name holds its weight times its sector's level, at
    most ``name_cap``; a sector's level is the book's, or the lower one at which
    its names fill ``sector_cap``. The book's level is where all sums to 1. If the
    caps leave less room than that, everything is full and scaled up. A book has a
    handful of names, so this runs in one place.
    """
    names = sorted(weights)
    raw = np.array([max(float(weights[n]), 0.0) for n in names])
    if not raw.any():
        raw = np.ones(len(names))
    _, sector = np.unique([str(sectors.get(n) or n) for n in names], return_inverse=True)
    held = np.zeros(len(names))
    fill = lambda level, who: np.minimum(level * raw[who], name_cap)

    def rise(total, target: float) -> float:
        """The level at which a growing total meets its target, between none and all names full."""
        low, high = 0.0, name_cap / raw[raw > 0].min()
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if total(middle) < target else (low, middle)
        return high

    inside = [np.flatnonzero(sector == k) for k in range(sector.max() + 1)] if names else []
    whole = lambda level: sum(min(fill(level, who).sum(), sector_cap) for who in inside)
    top = rise(whole, 1.0) if names else 0.0
    for who in inside:
        level = top if fill(top, who).sum() <= sector_cap else rise(lambda x, who=who: fill(x, who).sum(), sector_cap)
        held[who] = fill(level, who)
    return dict(zip(names, (held / held.sum()).tolist())) if names else {}


def screen(vector: DataFrame, liquidity: DataFrame, cut, terms: dict[str, float], universe: DataFrame | None = None, excluded: DataFrame | None = None, *, lookback: int = 60, rows: int = 10, adv_min: float = 0.0, blackout: int = 0, momentum_floor: float = -1.0, size: int = 18) -> DataFrame:
    """Candidates of a composite score, strictly before the cut: means of each ticker's last rows, filters, z-scores, top ``size``."""
    day = F.lit(str(cut)[:10]).cast("date")
    inside = lambda df, n: df.filter((F.col("date") >= F.date_sub(day, n)) & (F.col("date") < day))
    tail = R.tail_n(inside(vector, lookback), "ticker", "date", rows)
    own = [c for c in terms if c != "spot_mom"]
    last = tail.groupBy("ticker").agg(*[F.avg(c).alias(c) for c in own], F.min("days_to_next_report").alias("days_to_next_report"), F.max("staleness_quarterly").alias("staleness_quarterly"), F.max_by("spot", "date").alias("_b"), F.min_by("spot", "date").alias("_a"), F.avg("minute_realized_diffusion").alias("_vol"))
    last = last.withColumn("spot_mom", S.div("_b", "_a") - 1)
    last = last.join(R.tail_mean(inside(liquidity, 30), "ticker", "date", "dollar_vol", 20, "adv20"), "ticker", "left")
    if universe is not None:
        last = last.join(universe.select("ticker").distinct(), "ticker", "left_semi")
    if excluded is not None:
        last = last.join(excluded.select("ticker").distinct(), "ticker", "left_anti")
    last = last.filter((F.col("adv20") >= adv_min) & S.null_or("staleness_quarterly", F.col("staleness_quarterly") == 0) & S.null_or("days_to_next_report", F.col("days_to_next_report") > blackout) & S.null_or("spot_mom", F.col("spot_mom") > momentum_floor))
    scored = R.cross_z(last, list(terms), fill=0.0)
    score = sum((F.col(c) * w for c, w in terms.items()), F.lit(0.0))
    return scored.withColumn("score", score).withColumn("vol", F.when(F.col("_vol") > 0, F.col("_vol")).otherwise(0.5)).orderBy(F.col("score").desc(), "ticker").limit(size).select("ticker", "score", "vol", "adv20")


def screened_book(candidates: DataFrame, sectors: DataFrame) -> DataFrame:
    """Inverse-volatility weights of the screen's few candidates, capped."""
    rows = candidates.join(sectors.select("ticker", "sector"), "ticker", "left").select("ticker", F.coalesce(S.div(F.lit(1.0), F.col("vol")), F.lit(2.0)).alias("raw"), "sector").withColumn("_all", F.lit(1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        capped = cap_weights(dict(zip(pdf["ticker"], pdf["raw"])), {t: s for t, s in zip(pdf["ticker"], pdf["sector"]) if isinstance(s, str)})
        return pd.DataFrame({"ticker": list(capped), "weight": [round(v, 8) for v in capped.values()]})

    return rows.groupBy("_all").applyInPandas(run, "ticker string, weight double")


def replay_grid(days: DataFrame, start, every: int) -> DataFrame:
    """Decision and execution days: the last close before the start, then every ``every``-th day; executed a trading day later."""
    day = F.lit(str(start)[:10]).cast("date")
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    rows = days.select("date").distinct().withColumns({"execution": F.lead("date").over(w), "_after": F.sum((F.col("date") >= day).cast("int")).over(w)})
    opener = (F.col("_after") == 0) & (F.col("execution") >= day)
    return rows.filter((opener | ((F.col("_after") > 0) & (F.pmod(F.col("_after"), F.lit(every)) == 0))) & F.col("execution").isNotNull()).select(F.col("date").alias("decision"), "execution")
