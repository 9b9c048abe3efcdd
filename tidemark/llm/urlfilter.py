"""URL filter: host and path rules, then gradient-boosted trees on lexical features.

The trees are fitted to URLs with known verdicts; here those that a rule
decides, at most ``SAMPLE`` different ones (smallest hashes first). Features: lengths,
path depth, digit ratio, entropy, parameter counts, host shape, which of SEGMENTS
hash classes the path's segments fall into, and how often other labelled URLs of the
same top-level suffix are blocked.

Edge cases: a null URL, or one without ``://``, has an empty host and path, fits
no rule and is scored as an empty URL; no labelled URL, or of one verdict only,
gives that verdict (allow if there is none); URLs are taken whole, whatever their
length; equal URLs get equal rows, each row its own, and are trained on once; a
score of exactly one half blocks; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import few_keys

SAMPLE = 4000
#: Fixed values of the contract: verdict, host and path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
SEGMENTS = 32
FEATURES = 14 + SEGMENTS
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str | None) -> tuple[str, str, str]:
    """Host, path and what follows the path."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", "", ""
    ends = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    host, rest = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    ends = [i for i in (rest.find(c) for c in "?#") if i >= 0]
    path, tail = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    return host.translate(_LOWER), path, tail


def rule_of(host: str, path: str, rules=RULES) -> tuple[str | None, str | None]:
    """The longest rule that fits, and its verdict."""
    best: tuple[int, str, str] | None = None
    for verdict, suffix, prefix in rules:
        if (host == suffix or host.endswith("." + suffix)) and path.startswith(prefix):
            one = (len(suffix + prefix), suffix + prefix, verdict)
            best = max(best or one, one)
    return (best[1], best[2]) if best else (None, None)


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def lexical(url: str | None) -> list[float]:
    host, path, tail = parts(url)
    s = url or ""
    n = max(1, len(s))
    digits = sum(c.isdigit() for c in s)
    labels = host.split(".")
    classes = [0.0] * SEGMENTS
    for segment in path.split("/"):
        if segment:
            classes[zlib.crc32(segment.encode("utf-8", "surrogatepass")) % SEGMENTS] = 1.0
    return [len(s), len(host), len(path), path.count("/"), digits / n, sum(c.isdigit() for c in path), _entropy(host), _entropy(path), tail.count("=") + tail.count("&"), "#" in tail, host.count("-"), len(labels), max(map(len, labels)), s.startswith("https:"), *classes]


def suffix_of(url: str | None) -> str:
    return parts(url)[0].rpartition(".")[2]


class Model:
    def __init__(self, rows: list[tuple[list[float], str, int]]):
        """Rows of features, suffix and 1 for block."""
        self.prior = (sum(r[2] for r in rows) + 0.5) / (len(rows) + 1) if rows else 0.0
        self.suffixes = self._rates(rows)
        # Each half is trained with the rates of the other, so that no row sees its own label.
        halves = [self._rates(rows[1::2]), self._rates(rows[::2])]
        others = [halves[k % 2].get(r[1], self.prior) for k, r in enumerate(rows)]
        x = np.array([[*r[0], rate] for r, rate in zip(rows, others)], dtype=float).reshape(len(rows), FEATURES + 1)
        self.trees = gbt.fit(x, np.array([r[2] for r in rows]), trees=40, depth=4)

    def _rates(self, rows: list[tuple[list[float], str, int]]) -> dict[str, float]:
        """How often the URLs of each suffix are blocked, drawn to the prior by ten URLs."""
        seen: dict[str, list[int]] = {}
        for _, suffix, y in rows:
            seen.setdefault(suffix, []).append(y)
        return {s: (sum(v) + 10 * self.prior) / (len(v) + 10) for s, v in seen.items()}

    def blocked(self, urls: list[str | None]) -> np.ndarray:
        """The probability that each URL is to be blocked."""
        if not urls:
            return np.zeros(0)
        if not len(self.trees.roots):
            return np.full(len(urls), self.prior)
        return self.trees.probability(np.array([[*lexical(u), self.suffixes.get(suffix_of(u), self.prior)] for u in urls], dtype=float))


def _decided(url: str, rules) -> Column:
    """Whether a rule fits the URL of a column."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    fits = F.lit(False)
    for _, suffix, prefix in rules:
        fits = fits | (((host == suffix) | F.endswith(host, F.lit("." + suffix))) & F.startswith(path, F.lit(prefix)))
    return F.coalesce(fits, F.lit(False))


def _labelled(rules):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, lexical(u), suffix_of(u), int(v == "block")) for k, u in zip(batch.column("_k").to_pylist(), batch.column("_url").to_pylist()) for v in [rule_of(*parts(u)[:2], rules)[1]] if v]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], type=pa.int64()), pa.array([[float(f) for f in r[1]] for r in rows], type=pa.list_(pa.float64())), pa.array([r[2] for r in rows], type=pa.string()), pa.array([r[3] for r in rows], type=pa.int32())], ["_k", "x", "suffix", "y"])

    return scan


def fit_urls(pages: DataFrame, *, url: str = "url", rules=RULES, sample: int = SAMPLE) -> Model:
    known = pages.select(F.col(url).alias("_url")).filter(_decided("_url", rules))
    known = few_keys(known, "_url", sample).distinct().select(F.xxhash64("_url").alias("_k"), "_url")
    rows = known.mapInArrow(_labelled(rules), "_k long, x array<double>, suffix string, y int").orderBy("_k", "suffix", "y").limit(sample).collect()
    return Model([(list(r["x"]), r["suffix"], r["y"]) for r in rows])


def url_verdicts(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """One row per page: id, host, path, the rule that decides (null if none), verdict, and the trees' probability of block."""
    model = pages.sparkSession.sparkContext.broadcast(fit_urls(pages, url=url, rules=rules, sample=sample))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column("_url").to_pylist()
            cut = [parts(u) for u in urls]
            found = [rule_of(h, p, rules) for h, p, _ in cut]
            blocked = model.value.blocked(urls)
            verdict = [v or ("block" if b >= 0.5 else "allow") for (_, v), b in zip(found, blocked)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array(x, type=pa.string()) for x in ([c[0] for c in cut], [c[1] for c in cut], [r for r, _ in found], verdict)), pa.array(blocked, type=pa.float64())], ["_id", "host", "path", "rule", "verdict", "score"])

    rows = pages.select(F.col(page_id).alias("_id"), F.col(url).alias("_url"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"_id {kind}, host string, path string, rule string, verdict string, score double").withColumnRenamed("_id", page_id)
