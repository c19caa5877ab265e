import os

import oracle
import pytest

from faintline.llm import url_filter as uf

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
URLS = [
    None, "", "no scheme", "http://", "://", "https://Example.ORG/es/x?y#z", "http://a.b.example.org/es/", "http://example.org/es",
    "http://notexample.org/es/", "http://example.org/en/12", "http://example.org?x=/en/1", "http://example.org#/", "HTTP://COM/fr/",
    "http://x.com/de/a:b://c/fr/", "http://com/de/" + "p/" * 20_000, "http://" + "a." * 3000 + "org/", "http://..org/", "http://É.com/fr/é", "http://org:8080/",
]


def plain(url, rules, default="allow"):
    """host, path, rule, verdict by the rule as stated, every rule tried."""
    rest = url[url.index("://") + 3 :] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")


def rules_of(spark, rules):
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def test_by_hand(spark):
    urls = [*URLS, *URLS, "http://example.org/en/12"]
    more = [*RULES, ("example.org", "/en/1", "allow"), ("é.com", "", "block"), ("a.com", "/fr/", "block")]
    for rules in (RULES, more):
        out = uf.judge_urls(pages(spark, urls), rules_of(spark, rules))
        assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
        assert got == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_no_rules_and_no_pages(spark):
    none = rules_of(spark, RULES).limit(0)
    assert {r.verdict for r in uf.judge_urls(pages(spark, URLS), none, default="block").collect()} == {"block"}
    assert uf.judge_urls(pages(spark, []), rules_of(spark, RULES)).count() == 0
    odd = rules_of(spark, [(None, "/", "block"), ("org", None, "block"), ("org", "/", None)])
    got = {r.url: r.verdict for r in uf.judge_urls(pages(spark, ["http://org/", "http://com/"]), odd).collect()}
    assert got == {"http://org/": "block", "http://com/": "allow"}


def test_short_prefixes_are_confirmed(spark, monkeypatch):
    monkeypatch.setattr(uf, "DIGITS", 1)  # nearly every probe meets some rule's prefix
    urls = [f"http://h{i % 50}.example.com/p{i}/q" for i in range(300)]
    rules = [(f"h{i}.example.com", f"/p{i}", "block") for i in range(40)]
    got = {r.page_id: r.rule for r in uf.judge_urls(pages(spark, urls), rules_of(spark, rules)).collect()}
    assert got == {i: plain(u, rules)[2] for i, u in enumerate(urls)}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_whole_table(spark, sf):
    assert os.path.isdir(sf) and oracle.differences(uf.query(spark, sf), oracle.connect(sf), uf.SQL) == []
