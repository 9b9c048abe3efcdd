"""The catalog of Parquet panels: resolution, file pruning by name, tolerant reading."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import frames as R
from .panels import EMPTY, SPECS

# Fixed layout of a dataset: folders in the order of lookup.
CANONICAL, STRUCTURAL, RAW, REPORTS = "data/canonical", "data/structural", "data/raw/massive", "data/reports"
CRYPTO = {"T": "ticker", "t": "ts", "o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "vw": "vwap", "n": "trades"}
NESTED = ("crypto_hourly", "crypto_minute")
SPANS = {"day": "crypto_daily", "hour": "crypto_hourly", "minute": "crypto_minute"}
PARTITIONED = ("stocks_daily", "options_daily", "stocks_minute", "crypto_daily")
DEFAULT_LIMIT = 10_000

_DAY, _YEAR = re.compile(r"^\d{4}-\d\d-\d\d$"), re.compile(r"^\d{4}$")


def stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].split("?", 1)[0].removesuffix(".parquet")


def wanted(path: str, start=None, end=None) -> bool:
    """Whether a file can hold rows of an inclusive range, by its name: a day, a year, or anything (kept)."""
    name = stem(path)
    cut = 10 if _DAY.match(name) else 4 if _YEAR.match(name) else 0
    return not cut or ((start is None or name >= str(start)[:cut]) and (end is None or name <= str(end)[:cut]))


@dataclass(frozen=True)
class Found:
    """Files of a panel, and whether they lie in folders of their own ticker."""

    paths: tuple[str, ...]
    nested: bool = False


class Catalog:
    """A dataset's folder on any store that Spark reads, or the manifest of one."""

    def __init__(self, spark: SparkSession, root: str, manifest: str | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        # Timestamps in nanoseconds are kept as they are, as long integers; the reader refuses them otherwise.
        spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
        self.index = json.loads(self._text(manifest))["panels"] if manifest else None

    def _text(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()[0]

    def _list(self, folder: str) -> list[tuple[str, bool]]:
        """(path, is a folder) of a folder's entries; none if it isn't there."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
            return []
        return sorted((s.getPath().toString(), s.isDirectory()) for s in fs.listStatus(path))

    def resolve(self, name: str) -> Found:
        """Files of a panel: canonical, structural, then raw; an unknown or empty panel is a KeyError that names the others."""
        if self.index is not None:
            if name in self.index:
                entry = self.index[name]
                return Found(tuple(f if "://" in f else f"{self.root}/{f}" for f in entry["files"]), entry.get("kind") == "nested")
        else:
            for folder in (CANONICAL, STRUCTURAL, RAW):
                at = dict(self._list(folder))
                own = next((p for p in at if p.endswith(f"/{name}.parquet")), None)
                if own is not None:
                    return Found((own,))
                if folder != STRUCTURAL and any(p.endswith(f"/{name}") and d for p, d in at.items()):
                    inside = self._list(f"{folder}/{name}")
                    files = tuple(p for p, d in inside if not d and p.endswith(".parquet"))
                    if files:
                        return Found(files)
                    deeper = tuple(p for f, d in inside if d for p, _ in self._list(f"{folder}/{name}/{f.rsplit('/', 1)[-1]}") if p.endswith(".parquet"))
                    if deeper:
                        return Found(deeper, True)
                    if folder == CANONICAL:
                        raise KeyError(f"panel {name!r} is there but holds no files")
        raise KeyError(f"no panel {name!r}; there are {self.names()}")

    def names(self) -> list[str]:
        if self.index is not None:
            return sorted(self.index)
        found = {stem(p) for folder in (CANONICAL, STRUCTURAL, RAW) for p, d in self._list(folder) if d or p.endswith(".parquet")}
        return sorted(found)

    def scan(self, name: str, start=None, end=None) -> DataFrame:
        """A panel's rows. Names of files outside a range save reading them; the rows are filtered as well."""
        found = self.resolve(name)
        paths = [p for p in found.paths if wanted(p, start, end)] or list(found.paths[:1])
        df = read_tolerant(self.spark, paths)
        if "volume" in df.columns:
            df = df.withColumn("volume", F.col("volume").cast("double"))
        if found.nested:
            df = df.withColumn("ticker", F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1), r"^([^_]*)_", "$1:"))
        if name in NESTED or name.startswith("crypto_"):
            df = df.withColumnsRenamed({k: v for k, v in CRYPTO.items() if k in df.columns and v not in df.columns})
        return R.get(df, None, start, end)

    def panel(self, name: str) -> DataFrame:
        return self.scan(name)

    def get(self, name: str, ticker=None, start=None, end=None, limit: int | None = None) -> DataFrame:
        """``scan`` of some tickers; without any, a panel of one file a day gives at most 10,000 rows."""
        if limit is None and ticker is None and name in PARTITIONED:
            limit = DEFAULT_LIMIT
        return R.get(self.scan(name, start, end), ticker, start, end, limit)

    def access(self, name: str, start=None, end=None, order: str | None = None, limit: int | None = None, **wanted_values) -> DataFrame:
        """A panel as its specification has it: filters by key columns, an inclusive range on its time column.

        An absent panel is an empty frame of the declared columns.
        """
        spec = SPECS[name]
        try:
            df = self.scan(name)
        except KeyError:
            df = self.spark.createDataFrame([], EMPTY[name])
        for column, value in wanted_values.items():
            if value is not None:
                df = df.filter(S.any_of(column, value))
        if spec.time and (start is not None or end is not None):
            df = spec.between(df, start, end)
        if order:
            df = df.orderBy(order)
        return df if limit is None else df.limit(limit)

    def counts(self) -> dict[str, int]:
        """Rows of every panel that can be read."""
        out = {}
        for name in self.names():
            try:
                out[name] = self.scan(name).count()
            except Exception:  # noqa: BLE001 - a broken panel is left out of the listing
                continue
        return out

    def universe(self, us_only: bool | str = True) -> DataFrame:
        """Tickers: the list file, else the ticker map (all, or those in the US)."""
        if us_only != "fundamentals" and us_only:
            path = f"{self.root}/{STRUCTURAL}/universe_us.txt"
            if any(p.endswith("/universe_us.txt") for p, _ in self._list(STRUCTURAL)):
                return read_lines(self.spark, path).withColumnRenamed("value", "ticker")
        rows = self.scan("ticker_map")
        return (rows.filter("is_us") if us_only is True and "is_us" in rows.columns else rows).select("ticker").distinct()

    def report(self, name: str) -> str:
        return self._text(f"{self.root}/{REPORTS}/{name}.md")

    def last_day(self, name: str = "stocks_daily") -> str | None:
        """The last day with a file, from names alone; else the greatest date in the rows."""
        days = [stem(p) for p in self.resolve(name).paths if _DAY.match(stem(p))]
        if days:
            return max(days)
        last = self.scan(name).agg(F.max(S.as_date("date"))).first()[0]
        return None if last is None else str(last)

    def holdout_cutoff(self, days: int = 30) -> str | None:
        last = self.last_day()
        return None if last is None else str(self.spark.sql(f"select date_sub(date'{last}', {int(days)})").first()[0])

    def trading_days(self, start=None, end=None) -> DataFrame:
        """Days that any bar has, in an inclusive range."""
        return R.distinct_sorted(self.scan("stocks_daily", start, end), "date")

    def crypto(self, pair: str, timespan: str = "day", start=None, end=None) -> DataFrame:
        """One pair's bars in order of their time in milliseconds, between inclusive bounds.

        ``timespan`` is day, hour or minute. A bound is milliseconds since the epoch or
        ISO-8601 text, with or without a time; without a zone it is UTC.
        """
        if timespan not in SPANS:
            raise ValueError(f"timespan {timespan!r} is none of {', '.join(SPANS)}")
        name = pair.upper()
        name = name if name.startswith("X:") else f"X:{name}"
        df = self.scan(SPANS[timespan]).filter(F.col("ticker") == name)
        at = lambda x: F.lit(int(x)) if isinstance(x, int) else F.lit(_millis(str(x)))
        df = df if start is None else df.filter(F.col("ts") >= at(start))
        return (df if end is None else df.filter(F.col("ts") <= at(end))).orderBy("ts")

    def sectors(self) -> DataFrame:
        """Reference rows with what the details know of them, whichever columns there are."""
        out = self.scan("reference_tickers")
        try:
            details = self.scan("ticker_details")
        except KeyError:
            return out
        own = [c for c in ("sic_code", "sic_description", "sector", "market_cap") if c in details.columns and c not in out.columns]
        return out.join(details.select("ticker", *own), "ticker", "left")


def _millis(iso: str) -> int:
    when = datetime.fromisoformat(iso)
    return round((when if when.tzinfo else when.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def read_tolerant(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of differing schemas as one frame: merged by the reader where types agree, else a union by name that widens them."""
    df = spark.read.option("mergeSchema", "true").parquet(*paths) if len(paths) == 1 else None
    if df is not None:
        return S.clean_doubles(df)
    by_schema: dict[str, list[str]] = {}
    try:
        return S.clean_doubles(spark.read.option("mergeSchema", "true").parquet(*paths))
    except Exception:  # noqa: BLE001 - types differ between files
        for p in paths:
            by_schema.setdefault(spark.read.parquet(p).schema.json(), []).append(p)
    return S.clean_doubles(R.union_by_name(*[spark.read.parquet(*ps) for ps in by_schema.values()]))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A text file's lines, trimmed, without blank ones."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''")


def write_panel(df: DataFrame, path: str, by: str = "year", on: str = "date") -> None:
    """A derived panel, a folder a year."""
    df.withColumn(by, F.year(on)).repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small document such as a fit, one file."""
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r[0] for r in spark.read.text(path).collect()))
