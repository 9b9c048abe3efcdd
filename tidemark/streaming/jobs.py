"""Streaming forms: tumbling and sliding aggregates under a watermark, sessions, and keyed state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_bars(stream: DataFrame, by: str, time: str, price: str, volume: str, late: str = "1 day") -> DataFrame:
    """Tumbling days: bars, money, and volume-weighted price; rows later than the watermark are left out."""
    rows = stream.withWatermark(time, late)
    money = F.col(price) * F.col(volume)
    out = rows.groupBy(F.window(time, "1 day").alias("_w"), by).agg(F.count(F.lit(1)).alias("n_bars"), F.sum(money).alias("dollar_vol"), F.sum(volume).alias("_v"))
    return out.select(by, F.to_date("_w.start").alias("date"), "n_bars", "dollar_vol", F.try_divide("dollar_vol", "_v").alias("vwap_day"))


def trailing_counts(stream: DataFrame, by: str, time: str, days: int = 7, late: str = "1 day") -> DataFrame:
    """Sliding windows of some days, one a day, dated by their last day."""
    rows = stream.withWatermark(time, late)
    out = rows.groupBy(F.window(time, f"{days} days", "1 day").alias("_w"), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(by, F.date_sub(F.to_date("_w.end"), 1).alias("date"), "n")


def sessions(stream: DataFrame, by: str, time: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    rows = stream.withWatermark(time, late)
    out = rows.groupBy(F.session_window(time, gap).alias("_w"), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(by, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")


def kalman(stream: DataFrame, by: str, time: str, value: str) -> DataFrame:
    """The level filter as keyed state: level and spread stay between batches, rows of a batch in order of time."""
    kind = stream.schema[by].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, spread = state.get if state.exists else (None, 1.0)
        pdf = pd.concat(list(frames)).sort_values(time)
        out = []
        for x in pdf[value].tolist():
            if x is None or not x > 0:
                out.append(None)
                continue
            x = math.log(x)
            if level is None:
                level = x
                out.append(None)
                continue
            spread += 1e-4
            total = spread + 1e-2
            out.append((x - level) / math.sqrt(total))
            level += spread / total * (x - level)
            spread *= 1 - spread / total
        state.update((level, spread))
        yield pd.DataFrame({by: key[0], time: pdf[time], "innovation": pd.array(out, dtype="Float64")})

    timed = stream.select(by, F.col(time).cast("timestamp").alias(time), value)
    return timed.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, {time} timestamp, innovation double", "level double, spread double", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All input there is, once, into Parquet files of a folder; then the rows."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
