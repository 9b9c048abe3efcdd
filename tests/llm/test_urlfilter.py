import os
from collections import Counter

import numpy as np
import pytest
from tidemark.llm import urlfilter as U

DATA = "/root/testdata/sf0.1/pages.parquet"

CASES = [
    ("http://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("https://www.example.org/en/2", "www.example.org", "/en/2", "org/", "allow"),
    ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("https://x.com/fr/a", "x.com", "/fr/a", "com/fr/", "allow"),
    ("https://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    ("https://org", "org", "", None, None),
    ("https://x.org?a=/b", "x.org", "", None, None),
    ("no scheme.org/", "", "", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
    (None, "", "", None, None),
    ("", "", "", None, None),
]


def test_rules(spark):
    df = spark.createDataFrame([(k, c[0], "clash") for k, c in enumerate(CASES)], "page_id long, url string, host string")
    got = {r.page_id: r for r in U.url_verdicts(df).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(CASES):
        r = got[k]
        assert (r.host, r.path, r.rule) == (host, path, rule), k
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_learns_held_out_urls(spark):
    rows = [(k, f"https://s{k % 50}.net/{'buy' * (k % 2)}{'123456789' * (k % 2)}/page{k % 30}{'?a=1&b=2&c=3' * (k % 2)}") for k in range(800)]
    rules = tuple(("block" if k % 2 else "allow", f"s{k}.net", "/") for k in range(0, 40))
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = [r for r in U.url_verdicts(df, rules=rules).collect() if r.rule is None]
    assert len(got) == 160 and sum((r.verdict == "block") == (r.page_id % 2 == 1) for r in got) > 152


@pytest.mark.parametrize("urls,verdict", [([None, "x"], "allow"), (["http://a.net/", "http://b.com/de/x"], "block"), (["http://a.net/", "http://b.org/x"], "allow")])
def test_few_labels(spark, urls, verdict):
    got = U.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert {r.verdict for r in got} == {verdict}


def test_empty(spark):
    assert U.url_verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_long_and_repeated_urls(spark):
    long = "https://x.com/de/" + "a/" * 300_000 + "?" + "b=1&" * 100_000
    rows = [(1, "https://x.com/fr/a"), (1, "https://x.com/fr/a"), (None, "https://x.com/fr/a"), (2, long), (3, None), (3, None)]
    got = [tuple(r)[:2] + (len(r.path), r.rule, r.verdict) for r in U.url_verdicts(spark.createDataFrame(rows, "page_id long, url string")).collect()]
    one = ("x.com", 5, "com/fr/", "allow")
    assert Counter(g[:4] for g in got) == Counter([(1, *one[:3]), (1, *one[:3]), (None, *one[:3]), (2, "x.com", 600_004, "com/de/"), (3, "", 0, None), (3, "", 0, None)])


def test_rules_in_columns_are_the_same(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES] + [("a://x.com/\nfr/",), ("a://x.com\n/fr/",), ("://ORG/",)], "url string")
    for r in df.select("url", U._decided("url", U.RULES).alias("d")).collect():
        assert r.d == (U.rule_of(*U.parts(r.url)[:2])[0] is not None), r.url


def test_sample_is_bounded(spark):
    pages = spark.createDataFrame([(k, f"https://h{k}.org/{k}") for k in range(3000)] + [(9, "https://same.com/de/x")] * 3000, "page_id long, url string")
    model = U.fit_urls(pages, sample=100)
    assert set(model.suffixes) <= {"org", "com"} and 0 < model.prior < 0.2


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
def test_held_out_urls_against_the_majority():
    import duckdb

    urls = sorted(u for (u,) in duckdb.sql(f"select distinct url from '{DATA}' where url is not null").fetchall())
    rows = [(u, int(v == "block")) for u in urls for v in [U.rule_of(*U.parts(u)[:2])[1]] if v]
    train, test = rows[::2], rows[1::2]
    model = U.Model([(U.lexical(u), U.suffix_of(u), y) for u, y in train])
    y = np.array([y for _, y in test])
    right = ((model.blocked([u for u, _ in test]) >= 0.5) == y).mean()
    most = max(y.mean(), 1 - y.mean())
    print(f"held-out accuracy {right:.3f}, majority {most:.3f}, {len(test)} URLs")
    assert right > 0.9 and right > most
