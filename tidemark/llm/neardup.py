"""N-gram Jaccard join by MinHash banding.

Texts are compared as sets of runs of ``n`` words (white-space separated, as
written; a text of fewer words is one run of all). A text has BANDS * ROWS
minimum hashes; two texts of similarity s share a band with probability
1 - (1 - s**ROWS)**BANDS, which for 0.8, 6 rows and 32 bands is 0.99994 and for
0.2 is 0.002: ``plan_bands`` chooses these numbers for a target recall.

Texts that share a band are connected (through the band's smallest text, its hub, so that a
band of m texts makes m edges, not m * m pairs). Links exist only inside the
resulting groups, and a group of up to ``block_rows`` texts and ``block_bytes`` is verified as a
whole on full n-gram sets. A larger group may be a chain of chance collisions: its
texts are first verified hub by hub (every two texts of a band meet at its hub), and only the
groups that verified links make are then verified as wholes, which counts all their links. Whatever is
larger than a block is dealt into salted blocks and every pair of blocks is one
task, which reports counts of links and a spanning forest rather than pairs; no
text or pair is left out.

Equal texts are one class from the start, so copies cost a row each, no more.
All bookkeeping is by two 64-bit hashes of the text, never by the id.

Edge cases: null, empty and blank texts have no n-grams and are linked to
nothing, not even to each other (class: their own id); ids may repeat or be null
(a null id's class is the smallest id of the class, null if all are); ids are numbers or
strings of them, others are an error; a similarity of exactly the threshold is a
link; an empty table gives no rows; extra columns are ignored by ``jaccard_join`` and kept by ``one_of_each``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import blocks_for, checkpoint, discard, small_batches, text_keys
from .graph import components, forest

N = 5
#: Similarity as a fraction, so that the comparison is in whole numbers.
THRESHOLD = (4, 5)
RECALL = 0.9999
BLOCK_ROWS = 2048
BLOCK_BYTES = 16 << 20


def plan_bands(threshold: float, recall: float, most: int = 192) -> tuple[int, int]:
    """The most rows a band (the fewest needless candidates) that reach the recall with ``most`` hashes."""
    for rows in range(most, 0, -1):
        bands = most // rows
        if bands and 1 - (1 - threshold**rows) ** bands >= recall:
            return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows
    return most, 1


def shingles(group: tk.Group, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of a group's documents, and where each document's begin."""
    w = tk.words(group)
    h = tk.word_hashes(w)
    inside = tk.gram_mask(w.doc, n)
    grams, doc = tk.grams(h, n)[inside], w.doc[: len(inside)][inside]
    few = np.flatnonzero((w.counts() > 0) & (w.counts() < n))
    if len(few):
        whole = np.array([tk.grams(h[w.bounds[d] : w.bounds[d + 1]], int(w.counts()[d]))[0] for d in few], dtype=np.uint64)
        grams, doc = np.concatenate([grams, whole]), np.concatenate([doc, few])
        order = np.argsort(doc, kind="stable")
        grams, doc = grams[order], doc[order]
    # Document by document, which is much faster than one sort by both.
    at = np.searchsorted(doc, np.arange(len(group) + 1))
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        grams[lo:hi].sort()
    keep = np.ones(len(doc), dtype=bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[keep], doc[keep]
    return grams, np.searchsorted(doc, np.arange(len(group) + 1))


#: Hashes of 32 bits: they only choose candidates, and take half the time of 64.
_multipliers = np.random.default_rng(5).integers(1, 2**31, size=4096, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_STEP = 512
_scratch: dict[int, np.ndarray] = {}


def _folded(grams: np.ndarray) -> np.ndarray:
    return (tk.mix(grams) >> np.uint64(32)).astype(np.uint32)


def least_hashes(grams: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each of ``n`` hashes over a set."""
    return _least(_folded(grams), n)


def _least(x: np.ndarray, n: int) -> np.ndarray:
    low = np.full(n, np.iinfo(np.uint32).max, dtype=np.uint32)
    m = _multipliers[:n, None]
    if n not in _scratch:
        _scratch[n] = np.empty((n, _STEP), dtype=np.uint32)
    room = _scratch[n]
    for at in range(0, len(x), _STEP):
        part = x[None, at : at + _STEP]
        np.minimum(low, np.multiply(m, part, out=room[:, : part.shape[1]]).min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band of each text: a hash of the band's number and its minimum hashes (``low``: a row a text)."""
    low = tk.mix(low.astype(np.uint64)).reshape(-1, bands, rows)
    return tk.mix((low * tk.GRAM_FACTORS[0][:rows]).sum(axis=2, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _signed(n: int, bands: int, rows: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, have = [], []
            for g in tk.groups(tk.text_column(batch, "_text"), tk.SMALL_GROUP):
                grams, at = shingles(g, n)
                folded = _folded(grams)
                have.append(np.diff(at) > 0)
                some = np.flatnonzero(have[-1])
                for lo in range(0, len(some), 256):
                    low = np.stack([_least(folded[at[d] : at[d + 1]], bands * rows) for d in some[lo : lo + 256].tolist()])
                    keys.append(band_keys(low, bands, rows).ravel())
            have = np.concatenate(have) if have else np.zeros(0, dtype=bool)
            flat = tk.signed(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "_k1", "_k2")), pa.array(have), tk.list_column(have * bands, pa.array(flat, type=pa.int64()))], ["_id", "_k1", "_k2", "_any", "_bands"])

    return scan


def _counted(code: np.ndarray, count: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes with their counts, and more occurrences added to them."""
    if not more:
        return code, count
    new, n = np.unique(np.concatenate(more), return_counts=True)
    both, back = np.unique(np.concatenate([code, new]), return_inverse=True)
    return both, np.bincount(back, weights=np.concatenate([count, n])).astype(np.int64)


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, threshold: tuple[int, int]):
    """Pairs (i, j) of sets whose similarity reaches the threshold: inside ``left``, or between it and ``right``.

    N-grams in many sets are counted by a matrix product in slices, the others by
    the pairs of sets that hold them; either way counts are exact.
    """
    over, under = threshold
    rows = left if right is None else np.concatenate([left, right])
    n, nl = len(rows), len(left)
    sizes = np.array([len(sets[r]) for r in rows])
    grams = np.concatenate([sets[r] for r in rows]) if n else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, dtype=np.int64)
    df = np.diff(np.append(first, len(grams)))
    heavy = df > max(16, n // 64)
    column = np.full(len(df), -1)
    column[heavy] = np.arange(heavy.sum())
    at = np.repeat(column, df)
    wide = int(heavy.sum())
    other = np.arange(n) if right is None else np.arange(nl, n)
    light = np.flatnonzero((df > 1) & ~heavy)
    code, count = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    codes: list[np.ndarray] = []
    for size in np.unique(df[light]):
        holders = owner[first[light[df[light] == size], None] + np.arange(size)]
        for i in range(size):
            for j in range(i + 1, size):
                codes.append(holders[:, i] * n + holders[:, j])
                if len(codes) >= 64 and sum(map(len, codes)) > 2_000_000:
                    code, count = _counted(code, count, codes)
                    codes = []
    code, count = _counted(code, count, codes)
    for lo in range(0, nl, 256):
        mine = np.arange(lo, min(lo + 256, nl))
        shared = np.zeros((len(mine), n), dtype=np.int64)
        for c in range(0, wide, 2048):
            sel = (at >= c) & (at < c + 2048)
            have = np.zeros((n, min(2048, wide - c)), dtype=np.float32)
            have[owner[sel], at[sel] - c] = 1
            shared += (have[mine] @ have.T).astype(np.int64)
        part = slice(*np.searchsorted(code, [lo * n, (mine[-1] + 1) * n]))
        shared[code[part] // n - lo, code[part] % n] += count[part]
        i, j = np.nonzero((under + over) * shared[:, other] >= over * (sizes[mine][:, None] + sizes[other][None, :]))
        i, j = mine[i], other[j]
        keep = i < j
        yield rows[i[keep]], rows[j[keep]]


def _verified(n: int, threshold: tuple[int, int]):
    """Streams over rows sorted by (comp, bi, bj): links of each text and its root, a task's block pair at a time."""

    def close(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = pa.Table.from_batches(rows).combine_chunks()
        node, block, copies = (b.column(c).to_numpy() for c in ("node", "block", "copies"))
        bi, bj = b.column("bi")[0].as_py(), b.column("bj")[0].as_py()
        sets: list[np.ndarray] = []
        for g in tk.groups(b.column("_text").cast(pa.large_string()).combine_chunks()):
            grams, at = shingles(g, n)
            sets += [grams[at[d] : at[d + 1]].copy() for d in range(len(g))]
        order = np.argsort(node, kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        links = np.zeros(len(node), dtype=np.int64)
        pairs = []
        left, right = (np.flatnonzero(block == x) for x in (bi, bj))
        for i, j in _links(sets, left, None if bi == bj else right, threshold):
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            pairs.append((back[i], back[j]))
        i, j = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, dtype=np.int64),) * 2
        root = node[order][forest(len(node), i, j)[back]]
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(root)], ["node", "links", "root"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("comp", "bi", "bj")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1 if len(keys) else np.zeros(0, dtype=np.int64)
            for lo, hi in zip(np.append(0, cuts).tolist(), np.append(cuts, len(keys)).tolist()):
                if lo == hi:
                    continue
                if held and tuple(keys[lo]) != last:
                    yield close(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = tuple(keys[lo])
        if held:
            yield close(held)

    return scan


def _blocks(rows: DataFrame, block_rows: int, block_bytes: int) -> DataFrame:
    """Rows (comp, nb): how many blocks a group needs, by rows and by bytes; sizes are sums, so no group is gathered to be measured."""
    return rows.groupBy("comp").agg(F.greatest(blocks_for(F.count(F.lit(1)), block_rows), blocks_for(F.sum(F.octet_length("_text")), block_bytes)).alias("nb"))


def _compared(rows: DataFrame, n: int, threshold: tuple[int, int], block_rows: int, block_bytes: int) -> DataFrame:
    """Rows (node, links, root) of all pairs inside each ``comp`` of rows (comp, node, copies, _text), a pair of blocks at a time."""
    dealt = rows.join(_blocks(rows, block_rows, block_bytes), "comp").withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "node"), "nb").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.select("comp", F.least("block", "other").cast("int").alias("bi"), F.greatest("block", "other").cast("int").alias("bj"), "block", "node", "copies", "_text")
    return dealt.repartition("comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj").mapInArrow(_verified(n, threshold), "node long, links long, root long")


def jaccard_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = N, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rows of documents (_id, _k1, _k2, _any), and of distinct texts (_k1, _k2, copies, links, low: its smallest id, root: its class, class_low: that one's smallest id)."""
    small_batches(docs.sparkSession)
    bands, per = plan_bands(threshold[0] / threshold[1], recall)
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), *text_keys(F.col(text)), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    signed = checkpoint(rows.mapInArrow(_signed(n, bands, per), "_id long, _k1 long, _k2 long, _any boolean, _bands array<long>"))
    texts = signed.filter("_any").groupBy("_k1", "_k2").agg(F.min("_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("_bands").alias("_bands"))
    texts = checkpoint(texts.withColumn("node", F.xxhash64("_k1", "_k2")))
    bucket = texts.select("node", F.explode("_bands").alias("band"))
    hub = checkpoint(bucket.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m"))
    groups = checkpoint(components(bucket.join(hub, "band").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))))
    # The text comes from the row of the class's smallest id, so that copies of one text don't meet in one task.
    chosen = texts.join(groups, "node").select("node", "copies", F.col("root").alias("comp"), F.coalesce("low", F.lit(-1)).alias("_low"))
    source = rows.select(F.xxhash64("_k1", "_k2").alias("node"), F.coalesce("_id", F.lit(-1)).alias("_low"), "_text")
    sized = checkpoint(source.join(chosen, ["node", "_low"]).dropDuplicates(["node", "_low"]).select("node", "comp", "copies", "_text"))
    compare = lambda r: checkpoint(_compared(r, n, threshold, block_rows, block_bytes))
    large = checkpoint(_blocks(sized, block_rows, block_bytes).filter("nb > 1"))
    if not large.isEmpty():
        inside = sized.join(large, "comp", "left_semi").select("node", "copies", "_text")
        met = bucket.join(hub, "band").select("node", F.col("hub").alias("comp")).distinct()
        near = compare(inside.join(met, "node"))
        verified = components(near.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("root", "comp")
        again = checkpoint(sized.join(large, "comp", "left_anti").unionByName(inside.join(verified, "node").select("node", "comp", "copies", "_text")))
        discard(near, sized)
        sized = again
    checked = compare(sized)
    discard(groups, sized, hub, large)
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(checked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = texts.drop("_bands").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("links", F.coalesce("links", F.lit(0)))
    classes = checkpoint(classes)
    discard(texts, checked)
    low = classes.groupBy("root").agg(F.min("low").alias("class_low"))
    return signed.drop("_bands"), classes.join(low, "root").select("_k1", "_k2", "copies", "links", "low", "root", "class_low")


def jaccard_join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: id, ``class_id`` (the smallest id it is linked to, directly or not) and ``n_links`` (documents of similarity at or over the threshold)."""
    rows, classes = jaccard_classes(docs, doc_id=doc_id, text=text, **options)
    out = rows.join(classes, ["_k1", "_k2"], "left")
    return out.select(F.col("_id").alias(doc_id), F.coalesce("class_low", "_id").alias("class_id"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with one of each class, the one of the smallest id, all columns as they were; those without words stay."""
    rows, classes = jaccard_classes(docs, doc_id=doc_id, text=text, **options)
    first = classes.filter(F.col("low").eqNullSafe(F.col("class_low"))).groupBy("root").agg(F.min(F.struct("_k1", "_k2", "class_low")).alias("k")).select("k._k1", "k._k2", F.col("k.class_low").alias("_low"))
    # The whole row travels as one struct, so that no column of it can clash with the keys.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *text_keys(F.col(text)), F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("_any"))
    wanted = first.select("_k1", "_k2", F.col("_low").alias("_id"), F.lit(True).alias("_first"))
    same = [rows[c].eqNullSafe(wanted[c]) for c in ("_k1", "_k2", "_id")]
    kept = rows.filter("_any").join(wanted, same, "left_semi").dropDuplicates(["_k1", "_k2", "_id"])
    return kept.unionByName(rows.filter("not _any")).select("_row.*")
