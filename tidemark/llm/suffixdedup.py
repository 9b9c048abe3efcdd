"""Repeated-substring removal by a depth-limited radix sort of suffixes.

Suffixes are told apart by their first ``depth`` bytes only, by passes over ever
deeper digits, the most significant first; a suffix that is alone in its group
leaves at once, and after the last pass equal groups are exactly the windows of
``depth`` bytes that occur more than once.

A digit here is a hash of some of the window's bytes, the same ones in equal
windows, and not its leading byte: the passes refine the same groups as a sort
would, from one row for some 80 suffixes instead of one each, but the groups come
in the order of the hashes. No lexicographic order of suffixes results, and none
is needed to find what repeats.

* The first digit is the smallest hash among the window's runs of ``GRAM`` bytes
  (the leftmost of equals). Equal windows choose the same run at the same
  distance, so the digit is a function of the window, and neighbouring windows
  share it: one row stands for up to ``depth - GRAM + 1`` windows, about 80
  bytes of text. A digit found once takes all its windows out; rows of one digit
  whose whole stretch of text is equal are repeated as they are.
* One row of each different stretch of text in the groups that remain is split into pieces of ``PIECE`` windows with the bytes
  that all windows of the piece share (depth ``depth - PIECE + 1``) as digit.
* What is still undecided is split into single windows, of full depth.

Every pass is counts by digit (summed before the shuffle) joined back to the
rows, so a passage that a third of the documents share makes no large group.
Passes after the first read only the texts of undecided rows. Rows are known by
96 bits of hashes of id and text, windows by two independent 64-bit hashes.

Edge cases: null texts count as empty; texts shorter than ``depth`` have no
window; rows of equal text repeat each other, whatever their ids (null, repeated, of
any type); of equal smallest hashes in a window the leftmost is its digit; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import checkpoint, discard

DEPTH = 200
GRAM = 40
PIECE = 16
#: Bytes worked on at once; positions inside such a stretch take this many bits.
STRETCH_BITS = 17


KEY = ("_k", "_j")
#: First window; last window and anchor, both counted from it.
PLACE = ("lo", "more", "gap")
ROWS = "_k long, _j int, lo int, more short, gap short, digit long, content long"


class Prefix:
    """Prefix sums of a stretch of bytes, from which any substring's hash is read off."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.which = which
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(tk.BYTE_VALUES[which][data] * tk.powers(len(data) + 1, which)[: len(data)], out=self.sums[1:])
        self.inverse = tk.powers(len(data) + 1, which, inverse=True)

    def every(self, length: int) -> np.ndarray:
        """Of the substring of this length at each position."""
        n = len(self.sums) - length
        return tk.mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, dtype=np.uint64)

    def at(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return tk.mix((self.sums[hi] - self.sums[lo]) * self.inverse[lo] + (hi - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def anchors(column: pa.Array, depth: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each stretch of a text column: document, first window, last window, anchor, digit, hash of the whole stretch of text."""
    width = depth - gram + 1
    for g in tk.groups(column, 1 << 22):
        n = len(g.data)
        step = (1 << STRETCH_BITS) - depth
        for lo in range(0, max(1, n - depth + 1), step):
            data = g.data[lo : lo + step + depth - 1]
            if len(data) < depth:
                break
            prefix = Prefix(data)
            hashes = prefix.every(gram)
            low = np.uint64((1 << STRETCH_BITS) - 1)
            packed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
            at = (tk.sliding_min(packed, width) & low).astype(np.int64)
            window = np.arange(lo, lo + len(at))
            doc = np.searchsorted(g.offsets, window, side="right") - 1
            whole = window + depth <= g.offsets[doc + 1]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | ~whole[:-1]
            starts = np.flatnonzero(new & whole)
            if not len(starts):
                continue
            ending = np.ones(len(at), dtype=bool)
            ending[:-1] = new[1:] | ~whole[1:]
            ends = np.flatnonzero(ending & whole)
            own, base = doc[starts], g.offsets[doc[starts]]
            content = Prefix(data, 1).at(starts, ends + depth) ^ tk.mix((at[starts] - starts).astype(np.uint64))
            yield own + g.first, starts + lo - base, ends + lo - base, at[starts] + lo - base, hashes[at[starts]], content


def _anchored(depth: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, lo, hi, at, digit, content in anchors(tk.text_column(batch, "_text"), depth, gram):
                yield _rows([batch.column(k).take(pa.array(doc)) for k in KEY], lo, hi, at, digit, content)

    return scan


def _rows(keys: list[pa.Array], lo: np.ndarray, hi: np.ndarray, at: np.ndarray, digit: np.ndarray, content: np.ndarray) -> pa.RecordBatch:
    arrays = [*keys, pa.array(lo.astype(np.int32)), *(pa.array((x - lo).astype(np.int16)) for x in (hi, at)), *(pa.array(tk.signed(x)) for x in (digit, content))]
    return pa.RecordBatch.from_arrays(arrays, [*KEY, *PLACE, "digit", "content"])


def _split(depth: int, piece: int):
    """Undecided rows of each text into pieces of ``piece`` windows, cut at multiples of it counted from the anchor.

    The digit of a piece covers the bytes that its windows share as if the piece
    were whole, so that cut pieces meet whole ones.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tk.text_column(batch, "_text")
            rows = batch.column("rows").to_pylist()
            for g in tk.groups(column):
                for d in range(len(g)):
                    data = g.data[g.offsets[d] : g.offsets[d + 1]]
                    first, second = Prefix(data, 0), Prefix(data, 1)
                    lo, hi, at = (np.array([r[k] for r in rows[g.first + d]], dtype=np.int64) for k in PLACE)
                    hi, at = lo + hi, lo + at
                    far, near = (at - lo) // piece, (at - hi) // piece
                    counts = far - near + 1
                    own = np.repeat(np.arange(len(lo)), counts)
                    j = near[own] + np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
                    a = at[own]
                    plo, phi = np.maximum(lo[own], a - piece * j - piece + 1), np.minimum(hi[own], a - piece * j)
                    core_lo, core_hi = a - piece * j, a - piece * j - piece + 1 + depth
                    place = tk.mix(j.astype(np.uint64) + np.uint64(1))
                    digit = first.at(core_lo, core_hi) ^ place
                    if piece == 1:
                        content = second.at(core_lo, core_hi)
                    else:
                        content = second.at(plo, phi + depth) ^ tk.mix((a - plo).astype(np.uint64))
                    yield _rows([batch.column(k).take(pa.array(np.full(len(a), g.first + d))) for k in KEY], plo, phi, a, digit, content)

    return scan


def _pass(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One digit: the rows found repeated as they are, and one of each stretch of text that needs a deeper digit.

    ``rows`` is a table of its own and is removed.
    """
    # Written before it is joined, so that a digit with very many rows can be split in the join.
    shared = checkpoint(rows.groupBy("digit").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("c0"), F.max("content").alias("c1")).filter("n > 1").select("digit", (F.col("c0") == F.col("c1")).alias("same")))
    met = checkpoint(rows.join(shared, "digit"))
    discard(rows, shared)
    mixed = met.filter("not same")
    contents = checkpoint(mixed.groupBy("digit", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEY, *PLACE)).alias("one")))
    again = mixed.join(contents.filter("n > 1").select("digit", "content"), ["digit", "content"], "left_semi")
    return met.filter("same").unionByName(again).select(*KEY, "lo", "more"), contents.select("one.*")


def repeated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, gram: int = GRAM, piece: int = PIECE) -> DataFrame:
    """Rows (_k, _j, lo, more): in rows of these keys every window of ``depth`` bytes that begins in [lo, lo + more] occurs again somewhere."""
    keyed = docs.select(*row_key(F.col(doc_id), F.col(text)), F.coalesce(F.col(text), F.lit("")).alias("_text")).filter(F.octet_length("_text") >= depth)
    done, undecided = _pass(checkpoint(keyed.mapInArrow(_anchored(depth, gram), ROWS)))
    for size in (piece, 1):
        wanted = undecided.groupBy(*KEY).agg(F.collect_set(F.struct(*PLACE)).alias("rows"))
        more, undecided = _pass(checkpoint(keyed.join(wanted, [*KEY]).mapInArrow(_split(depth, size), ROWS)))
        done = done.unionByName(more)
    return done


def row_key(doc_id, text) -> list:
    """96 bits that stand for a row: rows that share them have equal id and text."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(doc_id, text).alias("_k"), F.hash(text, doc_id).alias("_j")]


def _spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching ranges joined into maximal ones."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    first = np.append(True, lo[1:] > hi[:-1]) if len(lo) else np.zeros(0, dtype=bool)
    return lo[first], hi[np.append(np.flatnonzero(first)[1:] - 1, len(lo) - 1)] if len(lo) else hi


def _removed(depth: int, whole: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tk.text_column(batch, "_text")
            lo, hi = (batch.column(k) for k in ("los", "his"))
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept", "spans")}
            for d in range(len(column)):
                data = column[d].as_buffer().to_pybytes()
                a, b = (np.array(x[d].as_py() or (), dtype=np.int64) for x in (lo, hi))
                a, b = _spans(a, b + depth)
                kept, at = [], 0
                for x, y in zip(a.tolist(), b.tolist()):
                    kept.append(data[at:x])
                    at = y
                kept.append(data[at:])
                rest = b"".join(kept)
                out["n_bytes"].append(len(data))
                out["n_removed"].append(len(data) - len(rest))
                out["n_spans"].append(len(a))
                out["kept"].append(rest if whole else hashlib.sha256(rest).hexdigest())
                out["spans"].append(np.stack([a, b], axis=1).ravel().tolist() if whole else None)
            arrays = [batch.column("_id"), *(pa.array(out[k], type=pa.int64()) for k in ("n_bytes", "n_removed", "n_spans"))]
            if whole:
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(out["kept"], type=pa.binary()), pa.array(out["spans"], type=pa.list_(pa.int64()))], ["_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])
            else:
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(out["kept"], type=pa.string())], ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return scan


def suffix_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, gram: int = GRAM, piece: int = PIECE, digest: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, and the remaining bytes with the removed spans (or, as ``digest``, their SHA-256)."""
    found = repeated(docs, doc_id=doc_id, text=text, depth=depth, gram=gram, piece=piece)
    found = found.groupBy(*KEY).agg(F.collect_set(F.struct("lo", (F.col("lo") + F.col("more")).alias("hi"))).alias("found"))
    found = found.select(*KEY, F.col("found.lo").alias("los"), F.col("found.hi").alias("his"))
    rows = docs.select(F.col(doc_id).alias("_id"), *row_key(F.col(doc_id), F.col(text)), F.col(text).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    last = "kept_sha256 string" if digest else "kept binary, spans array<long>"
    out = rows.join(found, [*KEY], "left").select("_id", "_text", "los", "his")
    return out.mapInArrow(_removed(depth, not digest), f"_id {kind}, n_bytes long, n_removed long, n_spans long, {last}").withColumnRenamed("_id", doc_id)
