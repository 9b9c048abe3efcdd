"""Command line: panels, head, tickers, asof, calendar, doctor."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .plans.service import Service
from .sources.catalog import Catalog


def doctor(catalog: Catalog, expected: dict[str, int]) -> list[dict]:
    """Each expected panel: rows found, rows expected, and whether they agree."""
    have = catalog.counts()
    return [{"panel": p, "rows": have.get(p), "expected": n, "ok": have.get(p) == n} for p, n in sorted(expected.items())]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    parser.add_argument("--root", required=True)
    sub = parser.add_subparsers(dest="what", required=True)
    sub.add_parser("panels")
    head = sub.add_parser("head")
    head.add_argument("panel")
    head.add_argument("-n", type=int, default=10)
    head.add_argument("--ticker")
    sub.add_parser("tickers")
    asof = sub.add_parser("asof")
    asof.add_argument("ticker")
    asof.add_argument("date")
    calendar = sub.add_parser("calendar")
    calendar.add_argument("ticker", nargs="?")
    check = sub.add_parser("doctor")
    check.add_argument("expected", help="JSON object of panel and rows")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    service = Service(Catalog(spark, a.root))
    if a.what == "panels":
        print(json.dumps(service.panels(), indent=1))
    elif a.what == "head":
        service.rows(a.panel, a.ticker, limit=a.n).show(a.n, truncate=False)
    elif a.what == "tickers":
        service.universe().orderBy("ticker").show(10_000, truncate=False)
    elif a.what == "asof":
        service.asof(a.ticker, a.date).show(100, truncate=False)
    elif a.what == "calendar":
        service.calendar(a.ticker).show(100, truncate=False)
    else:
        found = doctor(service.catalog, json.loads(a.expected))
        print(json.dumps(found, indent=1))
        return int(not all(f["ok"] for f in found))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
