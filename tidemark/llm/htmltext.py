"""Main text of HTML pages: a tolerant parser, boosted trees over DOM nodes, hierarchical decoding.

A page becomes arrays of nodes; every element is described by its tag, by hints
among its attribute tokens, its depth, the size and link density of its
subtree, and its standing among its siblings. Trees give each element the
probability of being main text. Decoding is hierarchical: an element is kept,
dropped with everything below it, or left to its children, whichever gives the
best total, so that no choice contradicts one above or below it.

The trees are trained on pages that this module generates with known main text
(a fixed seed: layouts, tag and class vocabularies and noise are varied), never
on the pages to be extracted.

Edge cases: a null or empty page, and one without text, gives the empty text;
unclosed or misnested tags, truncated pages and stray ``<`` are tolerated, in time
in proportion to the page; script, style, template and comment content is never
text; ``br`` and ``hr`` end a block; equal pages give equal rows, each row its own;
null ids and urls stay null; of equally good choices the one that keeps more is
taken; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt

# Fixed values of HTML: elements without content, with raw content, and those that flow inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
HIDDEN = frozenset("script style noscript template iframe head title textarea select option button svg math object noembed noframes".split())
# Elements that don't end a line of text though they hold or show something else.
UNSEEN = frozenset("area audio button canvas embed iframe img input map math noscript object param picture script select source style svg template textarea track video wbr".split())
# What an opening tag closes when it meets it open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
GOOD = re.compile(r"article|content|main|post|entry|body|story|text|prose|page")
BAD = re.compile(r"\bad\b|ads|advert|banner|promo|sponsor|nav|menu|foot|head|side|aside|widget|related|share|social|comment|reply|respond|cookie|consent|notice|popup|modal|login|sign|form|search|breadcrumb|tags|meta|copyright|legal|subscribe|newsletter|disqus|toolbar|pager")
GROUPS = (("article", "main"), ("section", "div", "td", "table", "tbody", "tr"), ("p", "blockquote", "pre"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "li", "dl", "dt", "dd"), ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "fieldset", "label"), ("figure", "figcaption"))
_GROUP = {tag: k for k, tags in enumerate(GROUPS) for tag in tags}
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
TOGETHER = 64


class Page:
    """Elements in page order: tag, parent, end of the subtree, hints; and pieces of text with their element and line.

    One pass over the source: every search starts where the last one ended, and
    open elements are found by name, so a page costs time in proportion to its
    length however its tags are nested or broken.
    """

    def __init__(self, source: str):
        self.tags, self.parents, self.hints, self.ends = ["html"], [-1], [""], [0]
        #: (element, text, number of line-ending elements begun before it)
        self.pieces: list[tuple[int, str, int]] = []
        self._open, self._walls, self._named = [0], [0], {}
        self._lines = 0
        self._gone: dict[str, bool] = {}
        at = text = 0
        n = len(source)
        while at < n:
            at = source.find("<", at)
            if at < 0:
                break
            after = self._markup(source, at, text)
            if after is None:
                at += 1
            else:
                at = text = after
        self._piece(source, text, n)
        self._pop(1)
        self.ends[0] = len(self.tags)

    def _piece(self, source: str, start: int, end: int) -> None:
        if end > start:
            self.pieces.append((self._open[-1], source[start:end], self._lines))

    def _markup(self, source: str, at: int, text: int) -> int | None:
        """Reads what begins at a ``<``, after the text before it; where it ends, or None if it is text itself."""
        n = len(source)
        past = lambda mark, start: (k + len(mark)) if (k := source.find(mark, start)) >= 0 else n
        if source.startswith(("<!", "<?"), at):
            self._piece(source, text, at)
            return past("-->", at + 4) if source.startswith("<!--", at) else past("]]>", at) if source.startswith("<![CDATA[", at) else past(">", at)
        m = _NAME.match(source, at)
        if not m:
            return None
        self._piece(source, text, at)
        tag = m[2].lower()
        if m[1]:
            self._close(tag)
            return past(">", m.end())
        end = self._tag_end(source, m.end())
        inside = source[m.end() : end]
        inside = inside.removesuffix(">")
        if tag in ("html", "body"):
            return end
        self._imply(tag)
        own = len(self.tags)
        self.tags.append(tag)
        self.parents.append(self._open[-1])
        self.ends.append(own + 1)
        self.hints.append(" ".join(a or b or c for _, a, b, c in _ATTRIBUTE.findall(inside)).lower() if inside else "")
        if tag not in INLINE and tag not in UNSEEN:
            self._lines += 1
        if inside.endswith("/") or tag in VOID:
            return end
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, end)
            if tag not in HIDDEN:
                self.pieces.append((own, source[end : close.start() if close else n], self._lines))
            return close.end() if close else n
        if tag not in INLINE:
            self._walls.append(len(self._open))
        self._named.setdefault(tag, []).append(len(self._open))
        self._open.append(own)
        return end

    def _tag_end(self, source: str, at: int) -> int:
        """Behind the ``>`` that isn't quoted; a quote without a second one is an ordinary character."""
        n = len(source)
        while True:
            m = _STOP.search(source, at)
            if m is None:
                return n
            if m[0] == ">":
                return m.end()
            second = -1 if self._gone.get(m[0]) else source.find(m[0], m.end())
            if second < 0:
                self._gone[m[0]] = True
            at = second + 1 if second >= 0 else m.end()

    def _pop(self, place: int) -> None:
        """Ends the open elements from a place of the stack on."""
        while len(self._open) > place:
            k = self._open.pop()
            self.ends[k] = len(self.tags)
            self._named[self.tags[k]].pop()
            if self._walls[-1] == len(self._open):
                self._walls.pop()

    def _wall(self, back: int = 1) -> str:
        """The tag of an open element that isn't inline, counted from the top."""
        return self.tags[self._open[self._walls[-back]]] if back <= len(self._walls) else "html"

    def _imply(self, tag: str) -> None:
        if tag in ENDS_P and self._wall() == "p":
            self._pop(self._walls[-1])
        closes = CLOSES.get(tag, ())
        while closes:
            # a paragraph inside doesn't hold a list item or a cell open
            back = 2 if self._wall() == "p" else 1
            if self._wall(back) not in closes:
                break
            self._pop(self._walls[-back])
            if tag != "tr":
                break

    def _close(self, tag: str) -> None:
        named = self._named.get(tag)
        if named and (tag not in INLINE or named[-1] > self._walls[-1]):
            self._pop(named[-1])

    def measure(self) -> np.ndarray:
        """Features of every element; a subtree is a range of elements, so its sums are differences of running sums."""
        n = len(self.tags)
        parents, ends, at = np.array(self.parents), np.array(self.ends), np.arange(n)

        def inside(flags: np.ndarray) -> np.ndarray:
            """How many of the flagged elements each element is or lies in."""
            steps = np.zeros(n + 1, dtype=np.int64)
            np.add.at(steps, at[flags], 1)
            np.add.at(steps, ends[flags], -1)
            return np.cumsum(steps[:n])

        def below(values: np.ndarray) -> np.ndarray:
            sums = np.append(0.0, np.cumsum(values))
            return sums[ends] - sums[at]

        tagged = lambda names: np.array([t in names for t in self.tags], dtype=bool)
        self.hidden = hidden = inside(tagged(HIDDEN)) > 0
        link = inside(tagged(("a",))) > 0
        depth = (inside(np.ones(n, dtype=bool)) - 1).astype(float)
        children = np.bincount(parents[1:], minlength=n).astype(float)
        order = np.zeros(n)
        by_parent = np.argsort(parents, kind="stable")
        first = np.searchsorted(parents[by_parent], parents[by_parent])
        order[by_parent] = at - first
        own = {key: np.zeros(n) for key in ("chars", "linked", "words", "stops", "blocks", "links", "controls")}
        counts = []
        for k, text, _ in self.pieces:
            if not hidden[k]:
                size = len(text.strip())
                counts.append((k, size, text.count(" ") + 1 if size else 0, text.count(". ") + text.count(".") * 0.25 + text.count(",") * 0.25))
        if counts:
            k, size, words, stops = (np.array(c) for c in zip(*counts))
            for name, value in (("chars", size), ("linked", size * link[k]), ("words", words), ("stops", stops)):
                np.add.at(own[name], k, value)
        own["blocks"] += tagged(("p", "blockquote", "pre"))
        own["links"] += tagged(("a",))
        own["controls"] += tagged(("input", "button", "select", "textarea"))
        self.own_chars = own["chars"]
        own = {name: below(v) for name, v in own.items()}
        size = (ends - at).astype(float)
        self.chars = own["chars"]
        total = max(1.0, own["chars"][0])
        up = np.maximum(parents, 0)
        good = np.array([_hinted(h)[0] for h in self.hints])
        bad = np.array([_hinted(h)[1] for h in self.hints])
        group = np.array([_GROUP.get(t, -1) for t in self.tags])
        aside = (group >= 5) & (group <= 9)
        above = [(inside(f) > 0).astype(float) for f in (good > 0, bad > 0, group == 0, aside)]
        for column in above:
            column[0] = 0.0
        chars = np.maximum(own["chars"], 1)
        columns = [own["chars"] / total, own["linked"] / chars, np.log1p(own["chars"]), own["stops"] / chars * 100, chars / np.maximum(own["words"], 1), np.log1p(size), chars / size, own["blocks"], own["links"] / np.maximum(own["words"], 1), own["controls"], depth, order / np.maximum(children[up], 1), own["chars"] / np.maximum(own["chars"][up], 1), children, good, bad, *above]
        flagged = aside | (bad > 0)
        under = below(flagged.astype(float))
        held, set_aside, whole = np.where(flagged, own["chars"], 0.0).tolist(), flagged.tolist(), own["chars"].tolist()
        for k in range(n - 1, 0, -1):
            p = self.parents[k]
            held[p] = max(held[p], whole[p]) if set_aside[p] else held[p] + held[k]
        held = np.where(flagged, 0.0, held)
        columns += [under - flagged, np.log1p(held), held / chars]
        columns += [(group == g).astype(float) for g in range(len(GROUPS))]
        return np.stack(columns, axis=1)

    def decode(self, main: np.ndarray) -> np.ndarray:
        """Which elements are kept: the best choice of whole subtrees to keep or drop, by log-odds weighted with own text."""
        n = len(self.tags)
        odds = np.log(np.clip(main, 1e-4, 1 - 1e-4)) - np.log(np.clip(1 - main, 1e-4, 1))
        # An element speaks for the text it holds itself, and a little for all below it.
        keep = np.where(self.hidden, 0.0, odds * (self.own_chars + 0.5 * self.chars)).tolist()
        mixed = np.where(self.hidden, 0.0, np.minimum(odds, 0) * self.own_chars).tolist()
        best = [0.0] * n
        for k in range(n - 1, -1, -1):
            # keep[k] now sums the subtree; mixed[k] sums the best of each child
            best[k] = max(keep[k], 0.0, mixed[k] - 1.0)
            if k:
                p = self.parents[k]
                keep[p] += keep[k]
                mixed[p] += best[k]
        state = [0] * n  # 0 open, 1 kept, 2 dropped
        for k in range(n):
            p = self.parents[k]
            state[k] = state[p] if p >= 0 and state[p] else (1 if keep[k] >= best[k] and keep[k] > 0 else 2 if best[k] == 0 else 0)
        return (np.array(state) == 1) & ~self.hidden

    def text(self, kept: np.ndarray) -> str:
        """Kept pieces; a new block begins wherever an element that ends a line begins or ends, br and hr among them."""
        block = list(range(len(self.tags)))
        for k in range(1, len(self.tags)):
            if self.tags[k] in INLINE or self.tags[k] in UNSEEN:
                block[k] = block[self.parents[k]]
        out: list[str] = []
        last = None
        held: list[str] = []
        for k, raw, line in self.pieces:
            if (block[k], line) != last:
                out.append("".join(held))
                held, last = [], (block[k], line)
            if kept[k]:
                held.append(entities.unescape(raw))
        out.append("".join(held))
        return " ".join(x for x in (" ".join(p.split()) for p in out) if x)


@lru_cache(maxsize=4096)
def _hinted(hint: str) -> tuple[float, float]:
    return float(bool(GOOD.search(hint))), float(bool(BAD.search(hint)))


def _sample(rng: random.Random) -> str:
    """A page with known main text: its words end in ``q``, all other words don't."""
    vocabulary = ["".join(rng.choice("bdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(60)]

    def words(lo: int, hi: int, mark: str = "") -> str:
        body = [rng.choice(vocabulary) + mark for _ in range(rng.randint(lo, hi))]
        return " ".join(w + rng.choice(["", "", "", "", ",", "."]) for w in body).capitalize() + "."

    def links(lo: int, hi: int) -> str:
        return "".join(f'<li><a href="/{rng.choice(vocabulary)}">{words(1, 2)[:-1]}</a></li>' for _ in range(rng.randint(lo, hi)))

    def classes(*names: str) -> str:
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}"' if names and rng.random() < 0.85 else ""

    def noise(kind: str) -> str:
        if kind == "nav":
            tag = rng.choice(["nav", "nav", "div", "ul"])
            return f"<{tag}{classes('nav', 'menu', 'navbar', 'top-menu', 'breadcrumb')}><ul>{links(2, 9)}</ul></{tag}>"
        if kind == "header":
            return f"<header{classes('header', 'masthead')}><a href='/'>{words(1, 3)}</a><p>{words(2, 8)}</p></header>"
        if kind == "footer":
            tag = rng.choice(["footer", "footer", "div"])
            own = classes("footer", "legal", "copyright") if tag == "footer" else ' class="footer"'
            return f"<{tag}{own}>&copy; {words(1, 6)} &middot; {words(2, 9)}</{tag}>"
        if kind == "side":
            tag = rng.choice(["aside", "div"])
            own = classes("sidebar", "widget", "related") if tag == "aside" else f' class="{rng.choice(["sidebar", "widget", "related", "side"])}"'
            return f"<{tag}{own}><h3>{words(1, 3)}</h3><ul>{links(2, 6)}</ul><p>{words(3, 20)}</p></{tag}>"
        if kind == "ad":
            return f'<div class="{rng.choice(["ad", "ads", "advert", "banner", "promo", "sponsored"])}">{words(2, 25)}</div>'
        if kind == "notice":
            return f'<div class="{rng.choice(["cookie", "notice", "consent", "popup", "newsletter"])}"><p>{words(5, 25)}</p><button>{words(1, 1)}</button></div>'
        if kind == "form":
            return f"<form{classes('search', 'login', 'subscribe')}><label>{words(1, 3)}</label><input name='q'><button>{words(1, 2)}</button></form>"
        return f'<{(tag := rng.choice(["section", "div", "div"]))} {rng.choice(["class", "id"])}="{rng.choice(["comments", "comment-list", "disqus", "replies"])}"><h3>{words(1, 2)}</h3>' + "".join(f"<div class='comment'><b>{words(1, 2)}</b><p>{words(4, 40)}</p></div>" for _ in range(rng.randint(1, 5))) + f"</{tag}>"

    def main() -> str:
        out = []
        if rng.random() < 0.8:
            out.append(f"<h1>{words(2, 9, 'q')}</h1>")
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            body = words(3, 90, "q")
            if kind < 0.1:
                out.append(f"<h2>{words(1, 6, 'q')}</h2>")
            elif kind < 0.16:
                out.append("<ul>" + "".join(f"<li>{words(2, 15, 'q')}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.2:
                out.append(f"<blockquote><p>{body}</p></blockquote>")
            elif kind < 0.3:
                out.append(f'<p>{words(2, 20, "q")} <a href="/x">{words(1, 3, "q")}</a> {body}</p>')
            elif kind < 0.38:
                out.append(f"<p><b>{body}<br>")
            elif kind < 0.42:
                out.append(f"<table><tr><td>{words(1, 5, 'q')}</td><td>{words(1, 5, 'q')}</td></tr></table>")
            elif kind < 0.46:
                out.append(noise(rng.choice(["ad", "side", "notice"])))
            else:
                out.append(f"<p>{body}</p>" if rng.random() < 0.9 else f"<p>{body}")
        tag = rng.choice(["article", "article", "main", "div", "div", "section"])
        own = classes("content", "post", "entry", "story", "article-body", "main") if tag != "div" else f' {rng.choice(["class", "id"])}="{rng.choice(["content", "post", "entry", "main-text", "article"])}"' if rng.random() < 0.8 else ""
        inner = f"<{tag}{own}>{''.join(out)}</{tag}>"
        return f"<main>{inner}</main>" if tag == "article" and rng.random() < 0.3 else f'<div class="{rng.choice(["wrapper", "container", "page"])}">{inner}</div>' if rng.random() < 0.3 else inner

    before = [noise(k) for k in ("nav", "header", "notice", "ad", "form", "side") if rng.random() < 0.45]
    after = [noise(k) for k in ("comments", "side", "ad", "form", "footer") if rng.random() < 0.5]
    rng.shuffle(before)
    tail = "</body></html>" if rng.random() < 0.85 else ""
    return f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{margin:0}}</style></head><body>{''.join(before)}{main()}{''.join(after)}{tail}"


@lru_cache(maxsize=2)
def fit_pages(pages: int = 500, seed: int = 77) -> gbt.Trees:
    """Trees fitted to ``pages`` generated pages: an element is main text if all of its text is."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        page = Page(_sample(rng))
        x = page.measure()
        marked = np.zeros((len(page.tags), 2))
        for k, text, _ in page.pieces:
            if not page.hidden[k]:
                found = re.findall(r"[a-z]+", text.lower())
                marked[k] += (sum(w.endswith("q") for w in found), len(found))
        for k in range(len(page.tags) - 1, 0, -1):
            marked[page.parents[k]] += marked[k]
        use = np.flatnonzero((marked[:, 1] > 0) & ~page.hidden)
        xs.append(x[use])
        ys.append(marked[use, 0] == marked[use, 1])
    return gbt.fit(np.concatenate(xs), np.concatenate(ys), trees=60, depth=4, rate=0.25, bins=32)


def main_texts(sources: list[str | None], model: gbt.Trees) -> Iterator[str]:
    """The main text of each page; the elements of some pages at a time are scored together."""
    for lo in range(0, len(sources), TOGETHER):
        pages = [Page(s or "") for s in sources[lo : lo + TOGETHER]]
        x = [p.measure() for p in pages]
        main = np.split(model.probability(np.concatenate(x)), np.cumsum([len(f) for f in x])[:-1])
        for page, own in zip(pages, main):
            yield page.text(page.decode(own))


def main_text(source: str | None, model: gbt.Trees) -> str:
    return next(main_texts([source], model))


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    model = pages.sparkSession.sparkContext.broadcast(fit_pages())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(main_texts(batch.column("_html").to_pylist(), model.value))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("url"), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], ["_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).alias("_id"), F.col(url).alias("url"), F.col(html).alias("_html"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"_id {kind}, url string, text string, n_chars long").withColumnRenamed("_id", page_id)
