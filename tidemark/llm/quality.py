"""Quality rules: base rules on document statistics, then gradient-boosted trees trained on labelled documents.

Statistics are counted for whole texts, a batch at a time, in numpy. The trees
are fitted on the driver to at most ``SAMPLE`` labelled documents (chosen by a
hash of the id, so that reruns agree) and travel to the executors as node
arrays. More symbols, duplicate lines or repeated words can only lower the
score (monotonic constraints).

Edge cases: null and empty texts have no words and fail the base rules; without
labels of both kinds the base rules alone decide; a document that is labelled
twice takes the lower label; rows of equal id are scored each by its own text, and
the one of the smallest features is trained on; ids of equal hash are taken in the
order of the id; a score of exactly ``threshold`` is kept; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from . import textkit as tk
from .common import few_keys

SAMPLE = 20_000
KEPT = 0.5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("chars", "letters", "upper", "digits", "stops", "n_lines", "distinct")
FEATURES = ("symbols_per_word", "dup_lines_per_line", "repeats_per_word", "n_words", "word_length", "letters", "upper", "digits", "stops_per_word", "words_per_line", "distinct_per_word")
MONOTONE = {0: -1, 1: -1, 2: -1}

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = tk.byte_class("41-5A 61-7A C0-FF")
_UPPER = tk.byte_class("41-5A")
_DIGIT = tk.byte_class("30-39")
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?")] = True
_NOT_TAIL = ~tk.byte_class("80-BF")
_LINE = ~tk.byte_class("0A")


def statistics(group: tk.Group) -> dict[str, np.ndarray]:
    """Counts of each document of a group."""
    n = len(group)
    w = tk.words(group)

    def total(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(mask))[group.offsets])

    out = {"n_words": w.counts(), "word_chars": total(w.inside & _NOT_TAIL[w.data]), "n_symbols": total(_SYMBOL[w.data])}
    out |= {"chars": total(_NOT_TAIL[w.data]), "letters": total(_LETTER[w.data]), "upper": total(_UPPER[w.data]), "digits": total(_DIGIT[w.data]), "stops": total(_STOP[w.data])}
    lines = tk.words(group, _LINE)
    worded = np.searchsorted(w.starts, lines.ends) > np.searchsorted(w.starts, lines.starts)
    doc, key = lines.doc[worded], tk.word_hashes(lines)[worded]
    out["n_lines"] = np.bincount(doc, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - _distinct(doc, key, n)
    h = tk.word_hashes(w)
    out["distinct"] = _distinct(w.doc, h, n)
    inside = np.flatnonzero(tk.gram_mask(w.doc, 3))
    marks = np.zeros(len(w) + 1, dtype=np.int64)
    if len(inside):
        key = tk.mix(tk.grams(h, 3)[inside] ^ tk.mix(w.doc[inside].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(inside), dtype=bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        np.add.at(marks, inside[again], 1)
        np.add.at(marks, inside[again] + 3, -1)
    out["n_repeat_words"] = np.bincount(w.doc[np.cumsum(marks)[:-1] > 0], minlength=n)
    return out


def _distinct(doc: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    return np.bincount(doc[new], minlength=n)


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    words, chars, lines = (np.maximum(s[k], 1) for k in ("n_words", "chars", "n_lines"))
    return np.stack([s["n_symbols"] / words, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["n_words"], s["word_chars"] / words, s["letters"] / chars, s["upper"] / chars, s["digits"] / chars, s["stops"] / words, s["n_words"] / lines, s["distinct"] / words], axis=1).astype(float)


def _batch_statistics(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    parts = [statistics(g) for g in tk.groups(tk.text_column(batch, "_text"))]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for k in (*COUNTS, *MORE)}


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(_batch_statistics(batch))
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("label"), tk.list_column(np.full(len(x), x.shape[1]), pa.array(x.ravel()))], ["_id", "label", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> gbt.Trees:
    """Trees fitted to at most ``sample`` labelled documents."""
    own = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("label")).filter("label is not null")
    own = few_keys(own, "_id", sample).groupBy("_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(own), "_id").select("_id", "label", "_text")
    # Ids can repeat in documents: one row of each, so that the bound holds for rows too.
    measured = rows.mapInArrow(_measure, f"_id {docs.schema[doc_id].dataType.simpleString()}, label int, x array<double>").groupBy("_id").agg(F.first("label").alias("label"), F.min("x").alias("x")).select("label", "x").toArrow()
    x = np.array(measured.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, measured.column("label").to_numpy()))
    return gbt.fit(x[order], measured.column("label").to_numpy()[order], trees=40, depth=3, monotone=MONOTONE)


def quality(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, threshold: float = KEPT) -> DataFrame:
    """One row per document: id, the base counts, base_failed, kept, and the trees' score (0 to 1)."""
    model = fit_quality(docs, labels, doc_id=doc_id, text=text, label=label, sample=sample)
    sure = not len(model.roots)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _batch_statistics(batch)
            p = np.ones(len(s["n_words"])) if sure else model.probability(features(s))
            failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array(s[k].astype(np.int64)) for k in COUNTS), pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)], ["_id", *COUNTS, "base_failed", "kept", "score"])

    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"_id {kind}, {', '.join(f'{k} long' for k in COUNTS)}, base_failed boolean, kept boolean, score double").withColumnRenamed("_id", doc_id)
