"""As-of joins: one union, one window, no pairs.

Both sides are brought together by key and time, and every left row carries the
last right row that its order has passed. Where a key may hold a large share of
all rows, ``bucket`` cuts its time line: the last right row of each bucket goes
ahead to the next ones (a small window over buckets), and every bucket is a
partition of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(left: DataFrame, right: DataFrame, by, on: str, *, right_on: str | None = None, columns: list[str] | None = None, direction: str = "backward", strict: bool = False, tolerance=None, bucket: int | None = None, suffix: str = "_right", how: str = "left") -> DataFrame:
    """To each left row the nearest right row of equal key at or before it (``forward``: at or after).

    ``strict`` excludes equal times. ``tolerance`` is the largest distance allowed
    (days for dates, seconds for timestamps, else a number). Of right rows of one
    time the greatest wins. Right columns that clash get ``suffix``; null keys and
    times match nothing. ``bucket`` (same unit as ``tolerance``) splits hot keys.
    """
    by = [by] if isinstance(by, str) else list(by)
    right_on = right_on or on
    columns = columns if columns is not None else [c for c in right.columns if c not in by]
    forward = direction == "forward"
    kind = left.schema[on].dataType.simpleString()
    place = {"date": lambda c: F.unix_date(c).cast("long"), "timestamp": lambda c: F.unix_micros(c), "timestamp_ntz": lambda c: F.unix_micros(c.cast("timestamp"))}.get(kind, lambda c: c)
    unit = 1_000_000 if kind.startswith("timestamp") else 1

    own = F.struct(*[F.col(c).alias(f"_l{i}") for i, c in enumerate(left.columns)])
    payload = F.struct(F.col(right_on).alias("_at"), *[F.col(c).alias(f"_r{i}") for i, c in enumerate(columns)])
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    a = left.select(*keys, place(F.col(on)).alias("_t"), own.alias("_left"))
    b = right.filter(F.col(right_on).isNotNull()).select(*keys, place(F.col(right_on)).alias("_t"), payload.alias("_right"))
    # Order among equal times: right rows first, unless equal times don't count.
    rows = a.withColumn("_side", F.lit(0 if strict else 2)).unionByName(b.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    sign = -1 if forward else 1
    rows = rows.withColumn("_o", F.col("_t") * sign)
    parts = list(names)
    if bucket is not None:
        rows = rows.withColumn("_b", F.floor(F.col("_o") / F.lit(bucket * unit)))
        ahead = rows.groupBy(*names, "_b").agg(F.max_by("_right", F.when(F.col("_right").isNotNull(), F.struct("_o", "_right"))).alias("_last"))
        over = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        ahead = ahead.withColumn("_right", F.last("_last", ignorenulls=True).over(over)).filter("_right is not null")
        seeds = ahead.select(*names, "_b", "_right", F.lit(-1).alias("_side"), (F.col("_b") * bucket * unit).cast(rows.schema["_o"].dataType).alias("_o"))
        rows = rows.unionByName(seeds, allowMissingColumns=True)
        parts.append("_b")
    window = Window.partitionBy(*parts).orderBy("_o", "_side", "_right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = None
    for n in names:
        known = F.col(n).isNotNull() if known is None else known & F.col(n).isNotNull()
    hit = F.when(known & F.col("_t").isNotNull(), F.last("_right", ignorenulls=True).over(window))
    out = rows.withColumn("_hit", hit).filter("_left is not null")
    if tolerance is not None:
        near = F.abs(F.col("_t") - place(F.col("_hit._at"))) <= F.lit(tolerance * unit)
        out = out.withColumn("_hit", F.when(near, F.col("_hit")))
    if how == "inner":
        out = out.filter("_hit is not null")
    taken = set(left.columns)
    # Keys from where they lie, so that Spark knows that the rows still lie by them.
    own = {k: F.col(n).cast(left.schema[k].dataType) if rows.schema[n].dataType != left.schema[k].dataType else F.col(n) for k, n in zip(by, names)}
    return out.select(*[own.get(c, F.col(f"_left._l{i}")).alias(c) for i, c in enumerate(left.columns)], *[F.col(f"_hit._r{i}").alias(c + suffix if c in taken else c) for i, c in enumerate(columns)])


def asof_many(left: DataFrame, rights: dict[str, tuple[DataFrame, str, list[str]]], by: str, on: str, apart=()) -> DataFrame:
    """``left`` with a struct of each of ``rights`` (rows, their time, columns): the last at or before it; one union and one window for all.

    Of right rows of one time the greatest wins, by time and columns in order. For
    names in ``apart`` every column is carried by itself, past missing values. Null
    keys and times match nothing.
    """
    rows = left.withColumn("_side", F.lit(1))
    fields = {}
    for name, (right, at, columns) in rights.items():
        right = right.filter(F.col(by).isNotNull() & F.col(at).isNotNull())
        payload = F.struct(F.col(at).alias("_at"), *[F.col(c).alias(c) for c in columns])
        rows = rows.unionByName(right.select(F.col(by), F.col(at).alias(on), F.lit(0).alias("_side"), payload.alias(name)), allowMissingColumns=True)
        fields[name] = columns
    w = Window.partitionBy(by).orderBy(on, "_side", *rights).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    hits = {f"_h_{name}": F.struct(*[last(f"{name}.{c}").alias(c) for c in fields[name]]) if name in apart else last(name) for name in rights}
    hit = rows.select(*left.columns, "_side", *[c.alias(k) for k, c in hits.items()]).filter("_side = 1")
    return hit.select(*left.columns, *[F.col(f"_h_{name}").alias(name) for name in rights])


def exact_then_ffill(calendar: DataFrame, values: DataFrame, on: str, columns: list[str], by=()) -> DataFrame:
    """Values on the calendar's own days, carried forward; a value on any other day is lost."""
    by = [by] if isinstance(by, str) else list(by)
    joined = calendar.join(values.select(*by, on, *columns), [*by, on], "left")
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(on).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def union_ffill(calendar: DataFrame, values: DataFrame, on: str, columns: list[str], by=()) -> DataFrame:
    """Values of any day carried forward to the calendar's days, every column by itself."""
    by = [by] if isinstance(by, str) else list(by)
    rows = calendar.select(*by, on, F.lit(1).alias("_mine")).unionByName(values.select(*by, on, *columns, F.lit(0).alias("_mine")), allowMissingColumns=True)
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(on, "_mine").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.withColumns({f"_f_{c}": F.last(c, ignorenulls=True).over(w) for c in columns})
    return filled.filter("_mine = 1").select(*by, on, *[F.col(f"_f_{c}").alias(c) for c in columns])
