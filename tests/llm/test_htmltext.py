import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from labelled_pages import PAGES as LABELLED
from labelled_pages import split
from tidemark.llm import htmltext as H


@pytest.fixture(scope="module")
def model():
    return H.fit_pages()


PAGES = [
    ("<html><body><nav><ul><li><a href='/a'>Menu</a></li></ul></nav><article><h1>T&amp;t</h1><p>One  two\n three.</p><p>Four <b>fi</b>ve &lt;six&gt;.</p></article><footer>&copy; foot</footer></body></html>", "T&t One two three. Four five <six>."),
    ("<div class='sidebar'><p>side text here</p></div><div class='content'><p>Main text, quite long and with some stops. It goes on.</p><p>More of it, and even more.</p></div><div id='comments'><p>I think so</p></div>", "Main text, quite long and with some stops. It goes on. More of it, and even more."),
    ("<article><p>unclosed <b>bold<br><p>next & more</article><script>var a = '<p>no</p>';</script><style>p{}</style>", "unclosed bold next & more"),
    ("<body><article><p>cut off in the midd", "cut off in the midd"),
    ("<article><p>First line one<br>second line two</p><p>third<hr>fourth<wbr>th <img src=x>pic<!-- c -->ture</p></article>", "First line one second line two third fourthth picture"),
    ("", ""), (None, ""), ("<nav><a href='/'>x</a></nav>", ""), ("<!-- <article>no</article> -->", ""),
]


def test_known_pages(spark, model):
    got = {r.page_id: r for r in H.extract(spark.createDataFrame([(k, f"u{k}", p[0], "clash") for k, p in enumerate(PAGES)], "page_id long, url string, html string, text string")).collect()}
    for k, (_, want) in enumerate(PAGES):
        assert got[k].text == want and got[k].n_chars == len(want) and got[k].url == f"u{k}"


def test_held_out_generated_pages(model):
    rng = random.Random(99)
    exact = found = wrong = total = 0
    for _ in range(150):
        source = H._sample(rng)
        words = re.findall(r"[a-z]+", H.main_text(source, model).lower())
        want = [w for w in re.findall(r"[a-z]+", " ".join(p for _, p, _ in H.Page(source).pieces).lower()) if w.endswith("q")]
        hits = sum(w.endswith("q") for w in words)
        found, wrong, total, exact = found + hits, wrong + len(words) - hits, total + len(want), exact + (words == want)
    assert found / total > 0.99 and wrong / total < 0.01 and exact > 140


def test_no_choice_contradicts_one_above(model):
    rng = random.Random(5)
    for _ in range(40):
        page = H.Page(H._sample(rng))
        kept = page.decode(model.probability(page.measure()))
        for k in range(1, len(page.tags)):
            if kept[page.parents[k]]:
                assert kept[k] or page.hidden[k]


def test_odd_markup(model):
    for source in ("<" * 500, "<p" * 300, "</div></p></b>", "<a href='x>text</a>", "<article>" + "<div>" * 3000 + "deep words here" + "</article>", "a < b and c > d", "<article><p>" + "long words " * 50_000 + "</p></article>"):
        assert isinstance(H.main_text(source, model), str)


def test_pages_of_other_layouts(model):
    """Precision and recall of words on pages written by hand, in layouts the training pages don't have."""
    hits = got = wanted = 0
    for page in LABELLED.values():
        source, main = split(page)
        part = H.Page(main)
        want = Counter(re.findall(r"\w+", part.text(~np.array([t in H.HIDDEN for t in part.tags]))))
        found = Counter(re.findall(r"\w+", H.main_text(source, model)))
        hits, got, wanted = hits + sum((found & want).values()), got + sum(found.values()), wanted + sum(want.values())
    print(f"precision {hits / got:.3f}, recall {hits / wanted:.3f}")
    assert hits / got > 0.95 and hits / wanted > 0.97


def test_long_broken_pages_take_time_in_proportion(model):
    makers = [lambda n: "<b>" * n + "</q>" * n, lambda n: '<a href="' * n, lambda n: "<a href='x\">" * n, lambda n: "<q><div>" + "<b>" * n + "</q>" * n, lambda n: "<!" * n, lambda n: "</a" * n, lambda n: "<" * 4 * n, lambda n: "<tr><td><p>" * n, lambda n: "<ul><li>" * n + "</ol>" * n, lambda n: "<script>" * n, lambda n: "<p class=" * n]
    for make in makers:
        began = time.process_time()
        H.main_text(make(100_000), model)
        assert time.process_time() - began < 30


def test_repeated_rows_nulls_and_clashing_columns(spark):
    page = PAGES[0][0]
    rows = [(1, "u", page, "clash"), (1, "u", page, "clash"), (None, None, page, None), (2, None, None, None), (3, "v", "<article><p>" + "word " * 400_000 + "</p></article>", "x")]
    got = [(r.page_id, r.url, r.n_chars) for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")).collect()]
    n = len(PAGES[0][1])
    assert Counter(got) == Counter([(1, "u", n), (1, "u", n), (None, None, n), (2, None, 0), (3, "v", 1_999_999)])


def test_empty(spark):
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
