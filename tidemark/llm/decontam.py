"""Benchmark decontamination by winnowing.

Every window of ``window`` words is stood for by the smallest hash among its
``window - gram + 1`` runs of ``gram`` words. A window of an item and an equal
window of a document have the same fingerprint, so joining fingerprints finds
every shared span of at least ``window`` words; each hit is then extended by
comparing two independent hashes of the whole window.

The fingerprints of the benchmark travel to the documents, never the reverse.
Their size is measured first: beyond ``block_bytes`` the benchmark is dealt into
blocks, every block scans all documents, and the hit spans of a document are
merged afterwards. No row of documents is shuffled for one block.

Edge cases: null and empty texts have no words and are never contaminated; an
empty benchmark hits nothing; items of equal text or equal id are all reported
(ids once); an item without words is never found; null ids count as ``""``;
columns other than the named ones are ignored by ``contamination`` and kept by
``decontaminate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import blocks_for, small_batches, text_keys

WINDOW = 13
GRAM = 6
#: Bytes of benchmark text that one block may hold.
BLOCK_BYTES = 8 << 20
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Index:
    """What the documents are compared with: the windows of one block of items."""

    def __init__(self, ids: list[str], texts: list[str], window: int, gram: int):
        self.window, self.gram = window, gram
        self.ids = ids
        long: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        prints: list[np.ndarray] = []
        short: dict[int, list[tuple[int, int, int]]] = {}
        for g in tk.groups(pa.array(texts, type=pa.large_string())):
            w = tk.words(g, tk.ALNUM, lower=True)
            h = [tk.word_hashes(w, k) for k in (0, 1)]
            inside = tk.gram_mask(w.doc, window)
            a, b = (tk.grams(h[k], window, k)[inside] for k in (0, 1))
            long.append((a, b, w.doc[: len(inside)][inside] + g.first))
            prints.append(tk.sliding_min(tk.grams(h[0], gram), window - gram + 1)[: len(inside)][inside])
            for d in np.flatnonzero((w.counts() > 0) & (w.counts() < window)):
                n, at = int(w.counts()[d]), int(w.bounds[d])
                own = [tk.grams(h[k][at : at + n], n, k)[0] for k in (0, 1)]
                short.setdefault(n, []).append((int(own[0]), int(own[1]), g.first + int(d)))
        empty = np.zeros(0, dtype=np.uint64)
        self.prints = tk.Lookup(np.concatenate(prints) if prints else empty)
        self.by_length = {n: self._windows(*(np.array(x, dtype=t) for x, t in zip(zip(*rows), (np.uint64, np.uint64, np.int64)))) for n, rows in short.items()}
        if long and sum(len(x[0]) for x in long):
            self.by_length[window] = self._windows(*(np.concatenate(x) for x in zip(*long)))

    @staticmethod
    def _windows(a: np.ndarray, b: np.ndarray, item: np.ndarray) -> tuple[tk.Lookup, np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((item, b, a))
        a, b, item = a[order], b[order], item[order]
        keep = np.ones(len(a), dtype=bool)
        keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (item[1:] != item[:-1])
        a, b, item = a[keep], b[keep], item[keep]
        look = tk.Lookup(a)
        return look, np.append(np.searchsorted(a, look.keys), len(a)), b, item

    def hits(self, w: tk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a group's words: which are hit, and the (document, item) pairs; and starts and lengths of hit windows."""
        h = [tk.word_hashes(w, 0), None]
        marks = np.zeros(len(w) + 1, dtype=np.int64)
        docs, items, starts, lengths = [], [], [], []
        for n, (look, lists, second, item) in self.by_length.items():
            inside = tk.gram_mask(w.doc, n)
            if n == self.window:
                low = tk.sliding_min(tk.grams(h[0], self.gram), n - self.gram + 1)[: len(inside)]
                runs = np.flatnonzero(np.append(True, low[1:] != low[:-1])) if len(low) else np.zeros(0, dtype=np.int64)
                found, _ = self.prints.find(low[runs])
                at = tk_ranges(runs[found], np.append(runs, len(low))[found + 1])
                at = at[inside[at]]
                mine = window_hashes(h[0], at, n, 0)
            else:
                at = np.flatnonzero(inside)
                mine = tk.grams(h[0], n)[inside]
            got, place = look.find(mine)
            if not len(got):
                continue
            if h[1] is None:
                h[1] = tk.word_hashes(w, 1)
            at = at[got]
            other = window_hashes(h[1], at, n, 1)
            sizes = lists[place + 1] - lists[place]
            each = tk_ranges(lists[place], lists[place + 1])
            own = np.repeat(np.arange(len(at)), sizes)
            same = second[each] == other[own]
            each, own = each[same], own[same]
            hit = at[np.unique(own)]
            np.add.at(marks, hit, 1)
            np.add.at(marks, hit + n, -1)
            docs.append(w.doc[at[own]])
            items.append(item[each])
            starts.append(hit)
            lengths.append(np.full(len(hit), n))
        none = np.zeros(0, dtype=np.int64)
        pairs = np.unique(np.stack([np.concatenate(docs), np.concatenate(items)]), axis=1) if docs else np.zeros((2, 0), dtype=np.int64)
        return np.cumsum(marks)[:-1] > 0, pairs, np.concatenate(starts) if starts else none, np.concatenate(lengths) if lengths else none


def tk_ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All integers of the ranges [lo, hi), one range after the other."""
    sizes = hi - lo
    if not len(sizes) or not sizes.sum():
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(lo, sizes)


def window_hashes(hashes: np.ndarray, at: np.ndarray, n: int, which: int) -> np.ndarray:
    """Hashes of the windows of ``n`` words that begin at ``at`` only."""
    total = hashes[at] * tk.GRAM_FACTORS[which][0]
    for j in range(1, n):
        total += hashes[at + j] * tk.GRAM_FACTORS[which][j]
    return tk.mix(total + np.uint64(n))


def _digest(ids: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def _counted(column: pa.Array, index: Index) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")}
    for g in tk.groups(column):
        w = tk.words(g, tk.ALNUM, lower=True)
        hit, pairs, _, _ = index.hits(w)
        n_hit = np.bincount(w.doc[hit], minlength=len(g))
        found: dict[int, set[str]] = {}
        for d, i in pairs.T.tolist():
            found.setdefault(d, set()).add(index.ids[i])
        out["n_words"].append(w.counts())
        out["n_hit"].append(n_hit)
        out["n_items"].append(np.array([len(found.get(d, ())) for d in range(len(g))]))
        out["items_sha256"] += [_digest(found.get(d, set())) for d in range(len(g))]
        out["contaminated"].append((n_hit > 0) & (20 * n_hit >= w.counts()))
    return out


def _columns(counted: dict[str, list]) -> list[pa.Array]:
    cat = lambda k: np.concatenate(counted[k]) if counted[k] else np.zeros(0)
    return [*(pa.array(cat(k).astype(np.int64)) for k in ("n_words", "n_hit", "n_items")), pa.array(counted["items_sha256"], type=pa.string()), pa.array(cat("contaminated").astype(bool))]


def _indexes(benchmark: DataFrame, item: str, text: str, window: int, gram: int, block_bytes: int) -> list:
    """The blocks of the benchmark, each broadcast; each holds about ``block_bytes`` at most."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    n = items.agg(blocks_for(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), block_bytes)).first()[0]
    out = []
    for k in range(n):
        block = items if n == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        rows = block.collect()
        out.append(spark.sparkContext.broadcast(Index([r["id"] for r in rows], [r["text"] for r in rows], window, gram)))
    return out


def _merged(docs: DataFrame, text: str, indexes: list) -> DataFrame:
    """More than one block: spans of each text by block, brought together; the result by text key."""

    def spans(index):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for g in tk.groups(tk.text_column(batch, "_text")):
                    w = tk.words(g, tk.ALNUM, lower=True)
                    _, pairs, starts, lengths = index.value.hits(w)
                    rows: dict[int, tuple[list, set]] = {}
                    for d, i in pairs.T.tolist():
                        rows.setdefault(d, ([], set()))[1].add(index.value.ids[i])
                    for s, n in zip(starts.tolist(), lengths.tolist()):
                        d = int(w.doc[s])
                        s -= int(w.bounds[d])
                        rows[d][0].extend((s, s + n))
                    at = [g.first + d for d in rows]
                    keys = [batch.column(k).take(pa.array(at, type=pa.int64())) for k in ("_k1", "_k2")]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array([x[0] for x in rows.values()], type=pa.list_(pa.int64())), pa.array([sorted(x[1]) for x in rows.values()], type=pa.list_(pa.string()))], ["_k1", "_k2", "spans", "ids"])

        return scan

    keyed = docs.select(F.col(text).alias("_text"), *text_keys(F.col(text))).dropDuplicates(["_k1", "_k2"])
    parts = [keyed.mapInArrow(spans(x), "_k1 long, _k2 long, spans array<long>, ids array<string>") for x in indexes]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    whole = whole.groupBy("_k1", "_k2").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for x in batch.column("spans").to_pylist():
                done = total = 0
                for lo, hi in sorted(zip(x[::2], x[1::2])):
                    total += max(0, hi - max(lo, done))
                    done = max(done, hi)
                n.append(total)
            ids = [set(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_k1"), batch.column("_k2"), pa.array(n, type=pa.int64()), pa.array([len(x) for x in ids], type=pa.int64()), pa.array([_digest(x) for x in ids], type=pa.string())], ["_k1", "_k2", "_n_hit", "_n_items", "_sha"])

    return whole.mapInArrow(count, "_k1 long, _k2 long, _n_hit long, _n_items long, _sha string")


def _word_count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [tk.words(g, tk.ALNUM, lower=True).counts() for g in tk.groups(tk.text_column(batch, "_text"))]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_k1"), batch.column("_k2"), pa.array(np.concatenate(n) if n else np.zeros(0), type=pa.int64())], ["_id", "_k1", "_k2", "_n"])


def contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: the id, word count, hit words, items found and the verdict (5 % of words hit)."""
    indexes = _indexes(benchmark, item_id, item_text, window, gram, block_bytes)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    if len(indexes) == 1:
        index = indexes[0]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("_id"), *_columns(_counted(tk.text_column(batch, "_text"), index.value))], ["_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

        return rows.mapInArrow(scan, f"_id {kind}, {RESULT}").withColumnRenamed("_id", doc_id)
    hits = _merged(docs, text, indexes)
    counted = rows.select("_id", "_text", *text_keys(F.col("_text"))).mapInArrow(_word_count, f"_id {kind}, _k1 long, _k2 long, _n long")
    n_hit = F.coalesce("_n_hit", F.lit(0))
    return counted.join(hits, ["_k1", "_k2"], "left").select(
        F.col("_id").alias(doc_id), F.col("_n").alias("n_words"), n_hit.cast("long").alias("n_hit"), F.coalesce("_n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("_sha", F.lit(_digest(set()))).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("_n"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that aren't contaminated, with all their columns as they were."""
    small_batches(docs.sparkSession)
    indexes = _indexes(benchmark, item_id, item_text, window, gram, block_bytes)
    if len(indexes) == 1:
        index = indexes[0]

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = _columns(_counted(tk.text_column(batch, text), index.value))[-1]
                yield batch.filter(pa.compute.invert(bad))

        return docs.mapInArrow(keep, docs.schema)
    mark = docs.select(text).withColumn("_id", F.struct(*text_keys(F.col(text))))
    bad = contamination(mark, benchmark, doc_id="_id", text=text, item_id=item_id, item_text=item_text, window=window, gram=gram, block_bytes=block_bytes).filter("contaminated").select("_id").distinct()
    k1, k2 = text_keys(F.col(text))
    return docs.join(bad, F.struct(k1, k2) == bad["_id"], "left_anti")
