"""Line dedup by a log-template tree: lines that recur across documents, variable fields aside, are dropped.

A line goes down a tree of fixed depth: its token count, then its first ``LEAD``
tokens, with tokens that hold a digit read as variable. Below, the other tokens
form SEGMENTS runs by position, and a line belongs to the templates of all its
tokens and of all but one run (the variable field). Lines of up to ``LEAD`` tokens
end on a shorter path and have the template of all their tokens only.

A template recurs when enough texts have it: ``min_docs``, or fewer, down to two,
where so many already repeat ``evidence`` of its fixed words (those without a digit,
outside the variable run) between them. Documents are counted first; then those
that hold such a template get their near-duplicate class (five-word runs, 0.8), and
a class counts once, so that copies don't make each other boilerplate: those are
left to near-duplicate removal. Every line of a template that still recurs goes, from every
document, copies included.

Leaves with fewer lines than a template of theirs needs are set aside first, by counts alone. All
counts are summed before the shuffle, so a line that a third of the documents
share is as cheap as any; lines meet their verdict in joins whose one side has a
row per template.

Edge cases: null and empty texts and empty tables have no lines; blank lines are kept; a
document whose lines all go has the empty text and stays as a row; rows of equal
id and text get one verdict, and count as two documents but as one class; ids may
be null, repeat or be of any type; a count equal to the required one is enough; extra columns are ignored by
``line_dedup`` and kept by ``without_boilerplate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neardup
from . import textkit as tk
from .common import checkpoint, discard, small_batches, text_keys

LEAD = 3
SEGMENTS = 4
MIN_DOCS = 10
#: Fixed words over all texts that show a template to recur: three words in MIN_DOCS documents, fifteen in two.
EVIDENCE = LEAD * MIN_DOCS

_DIGIT = tk.byte_class("30-39")
_VARIABLE = np.uint64(0x5DEECE66D1CE4E5B)
_MARKS = np.random.default_rng(6).integers(1, 2**64, size=SEGMENTS + 1, dtype=np.uint64)


class Lines:
    """The lines of a group: document, byte range, tokens, leaf, and template keys (0: none); ``whole``: of keys only the one of all tokens."""

    def __init__(self, group: tk.Group, whole: bool = False):
        breaks = np.flatnonzero(group.data == 10)
        starts, ends = (np.sort(np.concatenate(x)) for x in ((group.offsets[:-1], breaks + 1), (breaks, group.offsets[1:])))
        some = starts < ends
        self.starts, self.ends = starts[some], ends[some]
        self.doc = np.searchsorted(group.offsets, self.starts, side="right") - 1
        w = tk.words(group)
        h = tk.word_hashes(w)
        variable = np.zeros(len(h), dtype=bool)
        variable[np.searchsorted(w.starts, np.flatnonzero(_DIGIT[group.data]), side="right") - 1] = True
        h[variable] = _VARIABLE
        first = np.searchsorted(w.starts, self.starts)
        self.tokens = np.searchsorted(w.starts, self.ends) - first
        n = len(self.doc)
        line = np.repeat(np.arange(n), self.tokens)
        place = np.arange(len(h)) - np.repeat(first, self.tokens)
        each = tk.mix(h + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        self.usable = self.tokens > 0
        if whole:
            total = np.zeros(n, dtype=np.uint64)
            if len(each):
                total[self.usable] = np.add.reduceat(each, first[self.usable])
            self.keys = tk.mix(total + self.tokens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + _MARKS[0])[:, None]
            return
        rest = np.maximum(self.tokens[line] - LEAD, 1)
        part = np.where(place < LEAD, 0, 1 + (place - LEAD) * SEGMENTS // rest)
        sums = np.zeros((n, SEGMENTS + 1), dtype=np.uint64)
        sizes = np.zeros((n, SEGMENTS + 1), dtype=np.int64)
        fixed = np.zeros((n, SEGMENTS + 1), dtype=np.int64)
        if len(h):
            code = line * (SEGMENTS + 1) + part
            cut = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            sums.reshape(-1)[code[cut]] = np.add.reduceat(each, cut)
            sizes.reshape(-1)[code[cut]] = np.diff(np.append(cut, len(code)))
            fixed.reshape(-1)[code[cut]] = np.add.reduceat((~variable).astype(np.int64), cut)
        # The words that a template fixes, by key.
        whole = fixed.sum(axis=1)
        self.fixed = np.stack([whole, *(whole - fixed[:, j] for j in range(1, SEGMENTS + 1))], axis=1)
        count = self.tokens.astype(np.uint64)
        self.leaf = tk.mix(sums[:, 0] + count * np.uint64(0xC2B2AE3D27D4EB4F))
        whole = sums.sum(axis=1, dtype=np.uint64) + count * np.uint64(0xD6E8FEB86659FD93)
        self.keys = np.stack([tk.mix(whole + _MARKS[0]), *(tk.mix(whole - sums[:, j] + _MARKS[j]) for j in range(1, SEGMENTS + 1))], axis=1)
        # A run may vary only if it has tokens and at least four others stay.
        self.keys[:, 1:][(sizes[:, 1:] == 0) | (self.tokens[:, None] - sizes[:, 1:] <= LEAD)] = 0


KEY = ["_k", "_j"]
#: Flat columns: nested ones take several times as long to write and read.
PLACES = range(SEGMENTS + 1)
ROWS = ", ".join(["_k long, _j int, lo int, leaf long", *(f"key{j} long" for j in PLACES), *(f"fixed{j} int" for j in PLACES), "once int"])


def _first_of(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which places are the first of their (owner, value)."""
    order = np.lexsort((np.arange(len(value)), value, owner))
    first = np.zeros(len(value), dtype=bool)
    first[order] = np.append(True, (owner[order][1:] != owner[order][:-1]) | (value[order][1:] != value[order][:-1]))[: len(value)]
    return first


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each line with a word: where it begins in its text's bytes, and all its keys (0: none); bit j of ``once`` is set on key j's first line in the document."""
    names = ROWS.replace(" long", "").replace(" int", "").split(", ")
    for batch in batches:
        for g in tk.groups(tk.text_column(batch, "_text"), tk.SMALL_GROUP):
            x = Lines(g)
            at = np.flatnonzero(x.usable)
            if not len(at):
                continue
            doc, keys, fixed = x.doc[at], x.keys[at], x.fixed[at].astype(np.int32)
            there = keys != 0
            once = np.zeros(keys.shape, dtype=np.int32)
            once[there] = _first_of(np.repeat(doc, there.sum(axis=1)), keys[there])
            bits = (once << np.arange(keys.shape[1], dtype=np.int32)).sum(axis=1, dtype=np.int32)
            row = [batch.column(k).take(pa.array(doc + g.first)) for k in KEY]
            columns = [(x.starts[at] - g.offsets[doc]).astype(np.int32), tk.signed(x.leaf[at]), *(tk.signed(keys[:, j].copy()) for j in PLACES), *(fixed[:, j].copy() for j in PLACES), bits]
            yield pa.RecordBatch.from_arrays([*row, *map(pa.array, columns)], names)


def _row_key(doc_id, text) -> list:
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(doc_id, text).alias("_k"), F.hash(text, doc_id).alias("_j")]


def _classes(docs: DataFrame, met: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (_k, _j, class): the near-duplicate class of each row that holds recurring lines."""
    rows = docs.select(F.col(text).alias("_text"), *_row_key(F.col(doc_id), F.col(text))).filter("_text is not null")
    # Ids of their own, as those of documents may be missing or no numbers.
    rows = checkpoint(rows.join(met.select(*KEY).distinct(), KEY, "left_semi").select(*KEY, "_text", *text_keys(F.col("_text")), F.monotonically_increasing_id().alias("_id")))
    _, classes = neardup.jaccard_classes(rows.select("_id", "_text"), doc_id="_id", text="_text")
    return rows.select(*KEY, "_k1", "_k2").distinct().join(classes.select("_k1", "_k2", F.col("root").alias("class")), ["_k1", "_k2"]).select(*KEY, "class")


def dropped_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, evidence: int = EVIDENCE) -> DataFrame:
    """Rows (_k, _j, lines): where the lines that each row loses begin, in bytes of its text."""
    small_batches(docs.sparkSession)
    rows = docs.select(*_row_key(F.col(doc_id), F.col(text)), F.col(text).alias("_text")).filter("_text is not null")
    needed = F.least(F.lit(min_docs), F.greatest(F.lit(2), F.coalesce(F.ceil(F.try_divide(F.lit(evidence), F.col("fixed"))), F.lit(min_docs))))
    parsed = checkpoint(rows.mapInArrow(_parsed, ROWS))
    # The template of all tokens fixes the most words.
    leaves = checkpoint(parsed.groupBy("leaf").agg(F.sum(F.getbit("once", F.lit(0))).alias("n"), F.max("fixed0").alias("fixed")).filter(F.col("n") >= needed).select("leaf"))
    each = F.array(*[F.struct(F.col(f"key{j}").alias("key"), F.col(f"fixed{j}").alias("fixed"), F.getbit("once", F.lit(j)).alias("once")) for j in PLACES])
    # Written by line: a row for each key, as read from there, would be five times as much to write.
    kept = checkpoint(parsed.join(leaves, "leaf").drop("leaf"))
    discard(parsed, leaves)
    lines = kept.select(*KEY, "lo", F.inline(each)).filter("key <> 0")
    # Written before they are joined, so that a key with very many rows can be split in the join.
    hot = checkpoint(lines.groupBy("key").agg(F.sum("once").alias("n"), F.max("fixed").alias("fixed")).filter(F.col("n") >= needed).select("key"))
    met = checkpoint(lines.join(hot, "key").select(*KEY, "lo", "key", "fixed"))
    discard(kept, hot)
    votes = met.select(*KEY, "key", "fixed").join(_classes(docs, met, doc_id, text), KEY)
    final = checkpoint(votes.groupBy("key").agg(F.countDistinct("class").alias("n"), F.max("fixed").alias("fixed")).filter(F.col("n") >= needed).select("key"))
    return met.join(final, "key").groupBy(*KEY).agg(F.collect_set("lo").alias("lines"))


def _without(text: bytes, lost: list[int]) -> bytes:
    """A text without the lines that begin at these places."""
    kept, at, end = [], 0, 0
    for start in sorted(lost):
        kept.append(text[at:start])
        end = text.find(b"\n", start)
        if end < 0:
            # The last line takes the break before it along.
            return b"".join(kept)[:-1]
        at = end + 1
    kept.append(text[at:])
    return b"".join(kept)


def _cleaned(column: pa.Array, lost: pa.Array) -> tuple[list[bytes | None], list[int], list[int]]:
    """Of each text: what remains of it in UTF-8, its lines before, and lines dropped."""
    out = column.cast(pa.large_binary()).to_pylist()
    n_lines = [x.count(b"\n") + 1 if x else 0 for x in out]
    n_dropped = [0] * len(out)
    for row in np.flatnonzero(lost.is_valid().to_numpy(zero_copy_only=False)).tolist():
        gone = lost[row].as_py()
        out[row] = _without(out[row], gone)
        n_dropped[row] = len(gone)
    return out, n_lines, n_dropped


def line_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", digest: bool = False, **options) -> DataFrame:
    """One row per document: id, n_lines, n_dropped, and the remaining text (or, as ``digest``, its SHA-256; null texts as empty)."""
    lost = dropped_lines(docs, doc_id=doc_id, text=text, **options)
    rows = docs.select(F.col(doc_id).alias("_id"), *_row_key(F.col(doc_id), F.col(text)), F.col(text).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    last = "kept_sha256" if digest else "text"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n, gone = _cleaned(batch.column("_text"), batch.column("_lines"))
            if digest:
                out = [hashlib.sha256(x or b"").hexdigest() for x in out]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(n, type=pa.int64()), pa.array(gone, type=pa.int64()), pa.array(out, type=pa.string())], ["_id", "n_lines", "n_dropped", last])

    return rows.join(lost, KEY, "left").select("_id", "_text", F.col("lines").alias("_lines")).mapInArrow(scan, f"_id {kind}, n_lines long, n_dropped long, {last} string").withColumnRenamed("_id", doc_id)


def without_boilerplate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", **options) -> DataFrame:
    """The documents with recurring lines taken out of the text (and ``n_chars``, if there, counted anew); all rows and columns stay."""
    lost = dropped_lines(docs, doc_id=doc_id, text=text, **options)
    names = docs.columns
    # The whole row travels as one struct, so that no column of it can clash with the keys.
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), *_row_key(F.col(doc_id), F.col(text)))
    wide = wide.join(lost, KEY, "left").select("_row", F.col("lines").alias("_lines"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column("_row").flatten()
            own = columns[names.index(text)]
            columns[names.index(text)] = pa.array(_cleaned(own, batch.column("_lines"))[0], type=own.type)
            yield pa.RecordBatch.from_arrays(columns, names)

    out = wide.mapInArrow(scan, docs.schema)
    if n_chars in names:
        out = out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return out
