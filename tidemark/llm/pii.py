"""Personal data: base patterns, then a skip-chain conditional random field over the tokens that could hold any.

Only tokens with a digit or ``@`` can be personal data; all others are certainly
not and cut the chain, so the field has a node for each such token, chain edges
between neighbours in the text and skip edges from each token to the next one of
the document that is like it: equal, of the same last seven digits, or of the same
part before an ``@``. Loopy sum-product message passing over all documents of a
batch at once makes labels agree along both. A token that the field labels with at
least ``SURE`` and that touches no base span becomes a span of its own
(neighbouring phone tokens: one span).

All weights, those of token shapes and the two edge potentials, are fitted
together by composite likelihood: the probability of each node's label given its shape
and the labels of its neighbours in the field, given its shape and what it is like, and
(where there is any) given only what it is like. The patterns' labels hang on the
shape and the chain alone, and the latter two teach what a skip edge tells where
these fall silent. A card or phone match of several tokens that fails its check says nothing
of each of them, so these have no label. Labels are the base spans of at most ``SAMPLE`` documents
(smallest hashes of the id), summed on the executors to counts by shape and
neighbourhood; base spans are observed when the field is applied.

Edge cases: null and empty texts have no spans; texts and tokens are taken whole,
in time in proportion to their length; where no sample has personal data nothing
is added; rows of equal id are judged each by its own text, and all of a chosen id
are trained on; null ids aren't trained on; of equally probable labels the first
kind is taken, a probability of exactly ``sure`` is enough; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import few_keys

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
SAMPLE = 4000
SURE = 0.9
ROUNDS = 8
#: A node has at most so many skip edges each way, one for each kind of likeness.
SKIPS = 3
NOBODY = len(KINDS) + 1
STEPS = 600
HOLD = 1e-4

# Fixed patterns of the contract, cut so that each scan moves on only: the part of an email
# before its @ is found backwards, and an ip's numbers are taken from a whole dotted run.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_HINT = re.compile(r"[0-9@]+")
_GAP = re.compile(r"\s")
_TRIM = ".,;:!?\"'*#$%&|<>[]{}"
FEATURES = ("bias", "at", "at_then_dot", "letters", "d1", "d4", "d7", "d9", "d13", "d20", "dots3", "ip_shape", "luhn", "plus", "paren", "dash", "equals", "slash", "only_digits", "before_plus", "local_part")


def luhn(digits: str) -> bool:
    """The check sum of card numbers: every second digit from the right doubled, digits of products added."""
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if place % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def tokens(text: str) -> list[tuple[int, int]]:
    """Spans between white space that hold a digit or ``@``."""
    out: list[tuple[int, int]] = []
    end = 0
    for m in _HINT.finditer(text):
        if m.start() < end:
            continue
        lo = m.start()
        while lo > end and not text[lo - 1].isspace():
            lo -= 1
        gap = _GAP.search(text, m.end())
        end = gap.start() if gap else len(text)
        out.append((lo, end))
    return out


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost emails: from each @ back to where its own run begins, but not into an earlier match."""
    free = 0
    at = text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost runs of four dotted numbers, those over 255 left out."""
    for run in DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        numbers = run[0].split(".")
        start = run.start()
        for k in range(0, len(numbers) - 3, 4):
            four = numbers[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield start, end
            start = end + 1


def base_spans(text: str, own: list[tuple[int, int]], lost: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start; ``lost`` takes the card and phone matches that are dropped."""
    out: list[tuple[int, int, int]] = []
    if not own:
        return out
    lost = [] if lost is None else lost
    out += [(0, *span) for span in emails(text)]
    out += [(1, *span) for span in addresses(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
            else:
                lost.append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
            else:
                lost.append(m.span())
    return out


def shape(text: str, lo: int, hi: int, before: str) -> int:
    """Feature bits of a token; ``before`` is the token before it."""
    s = text[lo:hi].strip(_TRIM)
    d = _digits(s)
    n = len(d)
    at = s.find("@")
    pieces = s.split(".")
    bits = [True, at >= 0, at >= 0 and "." in s[at:], any(c.isalpha() for c in s), 1 <= n < 4, 4 <= n < 7, 7 <= n < 9, 9 <= n < 13, 13 <= n < 20, n >= 20, s.count(".") == 3, len(pieces) == 4 and all(p.isdecimal() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in pieces), 13 <= n < 20 and luhn(d), s.startswith("+"), "(" in s or ")" in s, "-" in s, "=" in s, "/" in s, n > 0 and n == len(s), before.startswith("+"), at > 0]
    return sum(1 << k for k, b in enumerate(bits) if b)


def likeness(token: str) -> list[str]:
    """What tokens have in common that are like each other: the text, the last seven digits, the part before an ``@``."""
    s = token.strip(_TRIM).lower()
    d = _digits(s)
    at = s.find("@")
    out = [s] if len(s) >= 3 else []
    out += [f"#{d[-7:]}"] if len(d) >= 7 else []
    return out + ([s[: at + 1]] if at >= 3 else [])


class Field:
    """The graph of some documents: shapes, base labels, chain and skip edges."""

    def __init__(self):
        self.shapes: list[int] = []
        self.labels: list[int] = []
        self.unsure: list[bool] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        self.place: list[tuple[int, int, int]] = []

    def add(self, doc: int, text: str, own: list[tuple[int, int]], base: list[tuple[int, int, int]], lost: list[tuple[int, int]] | None = None) -> None:
        """One document's tokens; those that a dropped match of several tokens begins or ends in, or holds, are unsure."""
        first = len(self.shapes)
        seen: dict[str, int] = {}
        by_start = sorted((s, e, k) for k, s, e in base)
        b, reach = 0, []
        lost, gone = lost or [], 0
        last = -1
        before = ""
        for lo, hi in own:
            near = last >= 0 and hi > lo and text[last:lo].isspace() and lo - last <= 2
            k = len(self.shapes)
            self.shapes.append(shape(text, lo, hi, before if near else ""))
            while b < len(by_start) and by_start[b][0] < hi:
                reach.append(by_start[b])
                b += 1
            reach = [x for x in reach if x[1] > lo]
            self.labels.append(reach[0][2] if reach else OUTSIDE)
            while gone < len(lost) and lost[gone][1] <= lo:
                gone += 1
            self.unsure.append(gone < len(lost) and not reach and lost[gone][0] < hi and (lost[gone][0] < lo or lost[gone][1] > hi))
            self.place.append((doc, lo, hi))
            if near and k > first:
                self.chain.append((k - 1, k))
            alike = likeness(text[lo:hi])
            self.skip += sorted({(seen[key], k) for key in alike if key in seen})
            seen |= dict.fromkeys(alike, k)
            last, before = hi, text[lo:hi]


class Crf:
    """Weights of the field, and inference."""

    def __init__(self, counts: dict[tuple[int, ...], int]):
        """``counts`` by (label, shape, earlier and later neighbour in the chain, then SKIPS each along skip edges; NOBODY if none)."""
        self.weights = np.zeros((len(FEATURES), OUTSIDE + 1))
        self.weights[0, OUTSIDE] = 2.0
        self.chain, self.skip = np.zeros((2, OUTSIDE + 1, OUTSIDE + 1))
        if counts:
            self._fit(np.array(list(counts), dtype=np.int64), np.array(list(counts.values()), dtype=float))

    def _fit(self, rows: np.ndarray, n: np.ndarray) -> None:
        """Ascends the pseudo-likelihood with momentum, all weights held small."""
        x = self.vectors(rows[:, 1])
        # How many neighbours of each label there are, by edge: chain and skip, earlier and later.
        near = np.zeros((4, len(rows), OUTSIDE + 1))
        for kind, columns in enumerate(([2], [3], range(4, 4 + SKIPS), range(4 + SKIPS, 4 + 2 * SKIPS))):
            for c in columns:
                have = np.flatnonzero(rows[:, c] != NOBODY)
                near[kind, have, rows[have, c]] += 1
        wanted = np.eye(OUTSIDE + 1)[rows[:, 0]]
        # Each node three times: all is known, the chain is not, and only what it is like is.
        liked = near[2:].sum(axis=(0, 2)) > 0
        blind = np.zeros_like(x[liked])
        blind[:, 0] = 1
        x, wanted, n = np.concatenate([x, x, blind]), np.concatenate([wanted, wanted, wanted[liked]]), np.concatenate([n, n, n[liked]])
        near = np.concatenate([near, np.concatenate([near[:2] * 0, near[2:]]), np.concatenate([near[:2, liked] * 0, near[2:, liked]])], axis=1)
        parts = [self.weights, self.chain, self.skip]
        speed = [np.zeros_like(p) for p in parts]
        for _ in range(STEPS):
            w, chain, skip = parts
            p = self._softmax(x @ w + near[0] @ chain + near[1] @ chain.T + near[2] @ skip + near[3] @ skip.T)
            miss = (p - wanted) * n[:, None] / n.sum()
            slopes = (x.T @ miss, near[0].T @ miss + miss.T @ near[1], near[2].T @ miss + miss.T @ near[3])
            for k, slope in enumerate(slopes):
                speed[k] = 0.9 * speed[k] - 0.5 * (slope + HOLD * parts[k])
                parts[k] = parts[k] + speed[k]
        self.weights, self.chain, self.skip = parts

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    @staticmethod
    def vectors(masks: np.ndarray) -> np.ndarray:
        return (masks[:, None] >> np.arange(len(FEATURES)) & 1).astype(float)

    def beliefs(self, field: Field, fixed: bool = True) -> np.ndarray:
        """Label probabilities of each node after ROUNDS of messages; base spans are observed."""
        labels = np.array(field.labels)
        node = self.vectors(np.array(field.shapes, dtype=np.int64)) @ self.weights
        if fixed:
            node[np.arange(len(labels))[labels < OUTSIDE], labels[labels < OUTSIDE]] += 6.0
        edges = np.array(field.chain + field.skip, dtype=np.int64).reshape(-1, 2)
        if not len(edges):
            return self._softmax(node)
        pair = np.concatenate([np.broadcast_to(self.chain, (len(field.chain), *self.chain.shape)), np.broadcast_to(self.skip, (len(field.skip), *self.skip.shape))])
        # A message each way: source, target, potential indexed by (source label, target label).
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(source), node.shape[1]))
        for _ in range(ROUNDS):
            total = node.copy()
            np.add.at(total, target, message)
            z = (total[source] - message[back])[:, :, None] + pair
            top = z.max(axis=1, keepdims=True)
            new = np.log(np.exp(z - top).sum(axis=1)) + top[:, 0]
            message = 0.5 * message + 0.5 * (new - new.max(axis=1, keepdims=True))
        np.add.at(node, target, message)
        return self._softmax(node)


def _neighbourhoods(field: Field) -> np.ndarray:
    """A row for each node of sure label: label, shape, and the labels of its neighbours as ``Crf`` counts them."""
    labels = np.array(field.labels, dtype=np.int64)
    sure = ~np.array(field.unsure, dtype=bool)
    labels = np.where(sure, labels, NOBODY)
    out = np.full((len(labels), 4 + 2 * SKIPS), NOBODY, dtype=np.int64)
    out[:, 0], out[:, 1] = labels, field.shapes
    a, b = np.array(field.chain, dtype=np.int64).reshape(-1, 2).T
    out[b, 2], out[a, 3] = labels[a], labels[b]
    for earlier, later in field.skip:
        for node, other, column in ((later, earlier, 4), (earlier, later, 4 + SKIPS)):
            free = np.flatnonzero(out[node, column : column + SKIPS] == NOBODY)
            out[node, column + free[0]] = labels[other]
    for column in (4, 4 + SKIPS):
        out[:, column : column + SKIPS].sort(axis=1)
    return out[sure]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        field = Field()
        for d, t in enumerate(batch.column("_text").to_pylist()):
            own, lost = tokens(t or ""), []
            base = base_spans(t or "", own, lost)
            field.add(d, t or "", own, base, sorted(lost))
        if field.shapes:
            rows, n = np.unique(_neighbourhoods(field), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([tk.list_column(np.full(len(rows), rows.shape[1]), pa.array(rows.ravel())), pa.array(n.astype(np.int64))], ["node", "n"])


def fit_crf(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Crf:
    ids = few_keys(docs.select(F.col(doc_id).alias("_id")), "_id", sample).distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(ids), "_id").select("_text")
    sums = rows.mapInArrow(_tally, "node array<long>, n long").groupBy("node").agg(F.sum("n").alias("n")).orderBy("node").collect()
    return Crf({tuple(r["node"]): r["n"] for r in sums})


def _added(text: str, found: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the field's tokens (kind, start, end) that touch no base span; neighbouring phone tokens are one."""
    out: list[tuple[int, int, int]] = []
    for kind, lo, hi in found:
        while lo < hi and text[lo] in _TRIM:
            lo += 1
        while hi > lo and text[hi - 1] in _TRIM:
            hi -= 1
        if lo == hi or any(s < hi and lo < e for _, s, e in base):
            continue
        if kind == 3 and out and out[-1][0] == 3 and text[out[-1][2] : lo].isspace() and lo - out[-1][2] <= 2:
            out[-1] = (3, out[-1][1], hi)
        else:
            out.append((kind, lo, hi))
    return out


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def personal_data(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, sure: float = SURE) -> DataFrame:
    """One row per document: id, base counts by kind, base_sha256, all spans, and how many the field added."""
    model = docs.sparkSession.sparkContext.broadcast(fit_crf(docs, doc_id=doc_id, text=text, sample=sample))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            field, bases = Field(), []
            for d, t in enumerate(texts):
                own = tokens(t) if t else []
                base = base_spans(t, own) if own else []
                bases.append(base)
                if own:
                    field.add(d, t, own, base)
            found: dict[int, list[tuple[int, int, int]]] = {}
            if field.shapes:
                p = model.value.beliefs(field)
                best = p.argmax(axis=1)
                for k in np.flatnonzero((best < OUTSIDE) & (p.max(axis=1) >= sure) & (np.array(field.labels) == OUTSIDE)).tolist():
                    d, lo, hi = field.place[k]
                    found.setdefault(d, []).append((int(best[k]), lo, hi))
            added = [_added(t or "", found.get(d, []), bases[d]) for d, t in enumerate(texts)]
            counts = [[sum(x[0] == k for x in b) for b in bases] for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), *(pa.array(c, type=pa.int64()) for c in counts), pa.array([hashlib.sha256(_written(b).encode()).hexdigest() for b in bases], type=pa.string()), pa.array([_written(b + a) for a, b in zip(added, bases)], type=pa.string()), pa.array([len(a) for a in added], type=pa.int64())],
                ["_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long").withColumnRenamed("_id", doc_id)
