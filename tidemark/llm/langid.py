"""Language identification by error-correcting output codes.

Every language has a codeword; a column of the code splits the languages into
two sides, and one binary classifier over hashed byte trigrams learns the side
(smoothed log-odds of each trigram). A text's margins are means over all its
trigrams; loss-weighted decoding sums a logistic loss of margin times codeword
bit over the columns and takes the language of the smallest sum, and the gap to
the second tells how sure it is. Up to EXHAUSTIVE languages have the exhaustive
code, more have seeded random columns spread as far apart as tries allow.

Training takes at most ``PER_LANGUAGE`` labelled documents a language, chosen by
a hash of the id, whole texts. Documents whose crc32 of the id leaves 0 modulo 5
are never trained on, and a prediction looks at nothing but the text.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; with
no labels everything is ``und``; with one language that is predicted; a null id
counts as the empty string and is never trained on; of equally near codewords the
first language in order is taken; rows may repeat (of an id and language the
smallest text is trained on) and are judged each by its text; an empty table gives
no rows; extra columns are ignored or, by ``known_language``, kept.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkit as tk
from .common import small_batches

PER_LANGUAGE = 1500
#: Training documents of all languages together; each language gets its share first.
SAMPLE = 60_000
BUCKETS = 1 << 13
EXHAUSTIVE = 7
SHARPNESS = 8.0
#: A prediction under this score is ambiguous.
SURE = 0.4
HELD_OUT = 5

_FOLD = tk.LOWER.copy()
_FOLD[~tk.byte_class("41-5A 61-7A 80-FF")] = 0x20
_LATIN = tk.byte_class("41-5A 61-7A")


def trigrams(group: tk.Group) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram whose middle is a letter, and where each document's begin.

    Letters are lower-cased (ASCII and Latin-1), everything else in ASCII is a blank.
    """
    data = _FOLD[group.data]
    if len(data) > 1:
        upper = np.flatnonzero((group.data[:-1] == 0xC3) & (group.data[1:] >= 0x80) & (group.data[1:] <= 0x9E)) + 1
        data[upper] += 0x20
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(len(group) + 1, dtype=np.int64)
    wide = data.astype(np.uint32)
    code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
    good = data[1:-1] != 0x20
    for edge in (group.offsets[1:-1] - 2, group.offsets[1:-1] - 1):
        good[edge[(edge >= 0) & (edge < len(good))]] = False
    at = np.flatnonzero(good)
    return bucket[at].astype(np.int64), np.searchsorted(at, group.offsets)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """A row of +1 and -1 for each of ``n`` languages."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= EXHAUSTIVE:
        columns = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, dtype=float).T
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    tries = [rng.choice([-1.0, 1.0], size=(n, width)) for _ in range(50)]
    return max(tries, key=lambda m: -(m @ m.T - 2 * width * np.eye(n)).max())


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.code = codewords(len(languages))
        rates = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1]) if len(languages) else counts
        sides = [(rates[c > 0].mean(axis=0), rates[c < 0].mean(axis=0)) for c in self.code.T]
        self.weights = np.stack([np.log(a) - np.log(b) for a, b in sides], axis=1) if sides else np.zeros((BUCKETS, 0))

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; the score is the share of the best language's decoded likelihood."""
        languages: list[str] = []
        scores: list[np.ndarray] = []
        for g in tk.groups(column):
            bucket, at = trigrams(g)
            margins = np.zeros((len(g), self.code.shape[1]))
            for d in range(len(g)):
                if at[d] < at[d + 1]:
                    margins[d] = np.bincount(bucket[at[d] : at[d + 1]], minlength=BUCKETS) @ self.weights / (at[d + 1] - at[d])
            letters = np.diff(np.append(0, np.cumsum(_LATIN[g.data]))[g.offsets]) > 0
            for d in np.flatnonzero(~letters):
                letters[d] = any(c.isalpha() for c in column[g.first + int(d)].as_py())
            if not self.languages:
                letters[:] = False
                scores.append(np.zeros(len(g)))
                languages += ["und"] * len(g)
                continue
            loss = np.logaddexp(0, -margins[:, None, :] * self.code[None, :, :] * SHARPNESS).sum(axis=2)
            best = loss.argmin(axis=1)
            score = 1 / np.exp(loss.min(axis=1, keepdims=True) - loss).sum(axis=1)
            scores.append(np.where(letters, score, 0.0))
            languages += [self.languages[b] if x else "und" for b, x in zip(best, letters)]
        return languages, np.concatenate(scores) if scores else np.zeros(0)


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts by language, one row for each batch, language and bucket that occurs."""
    for batch in batches:
        names = batch.column("lang").to_pylist()
        total: dict[str, np.ndarray] = {}
        for g in tk.groups(tk.text_column(batch, "_text")):
            bucket, at = trigrams(g)
            for d in range(len(g)):
                own = np.bincount(bucket[at[d] : at[d + 1]], minlength=BUCKETS)
                # Every document weighs the same, whatever its length.
                total[names[g.first + d]] = total.get(names[g.first + d], 0) + own / max(1, own.sum())
        for name, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), type=pa.string()), pa.array(at.astype(np.int32)), pa.array(np.round(c[at] * 1e9).astype(np.int64))], ["lang", "bucket", "n"])


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD_OUT == 0


def fit_language(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    ids = docs.select(F.col(doc_id).alias("_id"), F.col(lang).alias("lang")).filter(F.col("lang").isNotNull() & ~held_out(F.col("_id")) & F.col("_id").isNotNull())
    # Twice the wanted share of each language by hash first, so that no task ranks a whole language.
    sizes = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(SAMPLE).collect()
    shares = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 2 * per_language / r["n"]))]) if sizes else F.create_map(F.lit(""), F.lit(0.0))
    ids = ids.filter(F.shiftrightunsigned(F.xxhash64("_id"), 1) / F.lit(2.0**63) <= shares[F.col("lang")])
    ranked = ids.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned(F.xxhash64("_id"), 1), "_id"))).filter(F.col("_n") <= per_language)
    chosen = ranked.orderBy("_n", "lang").limit(SAMPLE).select("_id", "lang").distinct()
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(lang).alias("lang"), F.col(text).alias("_text")).join(F.broadcast(chosen), ["_id", "lang"])
    # One row of an id and language, the smallest text, so that the bound holds where ids repeat.
    rows = rows.filter("_text is not null").groupBy("_id", "lang").agg(F.min("_text").alias("_text"))
    counts = rows.select("lang", "_text").mapInArrow(_tallied, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    # A language whose texts hold no trigram is still a language that was learnt.
    languages = sorted({r["lang"] for r in chosen.select("lang").distinct().collect()})
    table = np.zeros((len(languages), BUCKETS))
    for r in counts:
        table[languages.index(r["lang"]), r["bucket"]] = r["n"] / 1e6
    return Model(languages, table)


def language(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score (0 to 1), ambiguous."""
    model = docs.sparkSession.sparkContext.broadcast(fit_language(docs, doc_id=doc_id, text=text, lang=lang, per_language=per_language))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = model.value.predict(tk.text_column(batch, "_text"))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("held_out"), pa.array(names, type=pa.string()), pa.array(score), pa.array(score < SURE)], ["_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col(doc_id).alias("_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean").withColumnRenamed("_id", doc_id)


def known_language(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """The documents whose language is recognised without ambiguity, all columns as they were."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit_language(docs, doc_id=doc_id, text=text, lang=lang, per_language=per_language))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = model.value.predict(tk.text_column(batch, text))
            yield batch.filter(pa.array([n != "und" and s >= SURE for n, s in zip(names, score)], type=pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
