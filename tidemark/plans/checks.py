"""Assertions over frames: data-quality gates and the checks of a scoring sheet, each as rows."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import occ
from ..functions import scalar as S
from ..operators.rolling import Series

CAP_JUMP = 10.0


def ohlc_violations(bars: DataFrame) -> DataFrame:
    """Bars whose high isn't the highest or low the lowest, or with a price at or below zero."""
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    bad = (F.col("high") < F.greatest(*prices)) | (F.col("low") > F.least(*prices)) | (F.least(*prices) <= 0)
    return bars.filter(bad)


def cap_jumps(weekly: DataFrame, factor: float = CAP_JUMP) -> DataFrame:
    """Ticker-weeks whose market cap moved by more than a factor since the last one."""
    s = Series.of("ticker", "date")
    change = S.div("cur_mkt_cap", s.lag("cur_mkt_cap"))
    return weekly.withColumn("change", change).filter((F.col("change") > factor) | (F.col("change") < 1 / factor))


def gate(name: str, bad: DataFrame, total: DataFrame, allowed: float = 0.0) -> DataFrame:
    """One row: how many rows fail, their share, and whether that is allowed."""
    rows = bad.agg(F.count(F.lit(1)).alias("failed")).crossJoin(total.agg(F.count(F.lit(1)).alias("total")))
    share = F.coalesce(S.div("failed", "total"), F.lit(0.0))
    return rows.select(F.lit(name).alias("gate"), "failed", "total", share.alias("share"), (share <= allowed).alias("passed"))


def all_gates(*gates: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), gates)


# Checks of a scoring sheet: a rule and what an endpoint answered, as a verdict


def at_path(value, path: str):
    """A value inside nested JSON by dotted keys and positions; None where there is none."""
    for key in path.split("."):
        if isinstance(value, list) and key.lstrip("-").isdigit() and -len(value) <= int(key) < len(value):
            value = value[int(key)]
        elif isinstance(value, dict) and key in value:
            value = value[key]
        else:
            return None
    return value


def json_contains(have, want) -> bool:
    """Whether all of ``want`` is in ``have``: keys of objects, items of lists, equal scalars."""
    if isinstance(want, dict):
        return isinstance(have, dict) and all(k in have and json_contains(have[k], v) for k, v in want.items())
    if isinstance(want, list):
        return isinstance(have, list) and all(any(json_contains(h, w) for h in have) for w in want)
    return have == want


def check_weights(holdings: list[dict], tolerance: float = 0.01, cap: float | None = None) -> list[str]:
    """What is wrong with a book: no legs, weights below zero or over the cap, a sum far from 1."""
    weights = [h.get("weight") for h in holdings]
    if not weights:
        return ["no holdings"]
    found = [f"bad weight {w!r}" for w in weights if not isinstance(w, (int, float)) or isinstance(w, bool) or w < 0]
    numbers = [w for w in weights if isinstance(w, (int, float)) and not isinstance(w, bool)]
    if cap is not None:
        found += [f"weight {w} over {cap}" for w in numbers if w > cap + 1e-9]
    if abs(sum(numbers) - 1) > tolerance:
        found.append(f"weights sum to {sum(numbers):.4f}")
    return found


def check_metrics(have: dict, reference: dict, relative: float, keys: list[str] | None = None) -> tuple[float, list[str]]:
    """Share of metrics within a relative tolerance of the reference, and those that aren't; two missing values agree."""
    keys = keys or sorted(reference)
    close = lambda a, b: a == b or (a is not None and b is not None and abs(a - b) <= relative * max(abs(b), 1e-9))
    off = [k for k in keys if not close(have.get(k), reference.get(k))]
    return (1 - len(off) / len(keys) if keys else 1.0), off


def outside_universe(holdings: DataFrame, universe: DataFrame) -> DataFrame:
    """Legs whose ticker, or whose option's root, isn't in the universe."""
    own = F.when(occ.is_option("ticker"), occ.root_of("ticker")).otherwise(F.col("ticker"))
    return holdings.withColumn("_t", own).join(universe.select(F.col("ticker").alias("_t")).distinct(), "_t", "left_anti").drop("_t")


def score(rules: list[dict], answers: dict[str, dict]) -> list[dict]:
    """Points of each rule. A rule has name, points, kind, endpoint and its own settings; an answer has status, body, seconds."""
    out = []
    for rule in rules:
        got = answers.get(rule["endpoint"])
        share, why = 0.0, ""
        if got is None:
            why = "no answer"
        elif rule["kind"] == "status":
            share = float(got["status"] == rule.get("status", 200))
        elif rule["kind"] == "contains":
            share = float(json_contains(got["body"], rule["want"]))
        elif rule["kind"] == "keys":
            share = float(isinstance(got["body"], dict) and all(k in got["body"] for k in rule["keys"]))
        elif rule["kind"] == "list":
            value = at_path(got["body"], rule["path"]) if rule.get("path") else got["body"]
            share = float(isinstance(value, list) and len(value) >= rule.get("least", 1))
        elif rule["kind"] == "at_most":
            value = at_path(got["body"], rule["path"])
            share = float(isinstance(value, (int, float)) and value <= rule["value"])
        elif rule["kind"] == "at_least":
            value = at_path(got["body"], rule["path"])
            share = float(isinstance(value, (int, float)) and value >= rule["value"])
        elif rule["kind"] == "weights":
            wrong = check_weights(at_path(got["body"], rule.get("path", "holdings")) or [], rule.get("tolerance", 0.01), rule.get("cap"))
            share, why = float(not wrong), "; ".join(wrong)
        elif rule["kind"] == "metrics":
            share, off = check_metrics(got["body"], rule["reference"], rule["relative"], rule.get("keys"))
            why = ", ".join(off)
        elif rule["kind"] == "latency":
            # The upper median of the measured times.
            times = sorted(got["seconds"])
            share = float(bool(times) and times[len(times) // 2] <= rule["seconds_at_most"])
        else:
            why = f"unknown kind {rule['kind']}"
        out.append({"name": rule["name"], "points": rule["points"] * share, "of": rule["points"], "why": why})
    return out


def as_json(rows: list) -> str:
    """Rows as JSON text: NaN and the infinities as null, dates as ISO."""
    clean = lambda v: None if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))) else v
    return json.dumps([{k: clean(v) for k, v in r.asDict(recursive=True).items()} for r in rows], default=str)
