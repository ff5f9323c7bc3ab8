import random

import pytest

from dataprobe.llm.queries import URL_RULES
from dataprobe.llm.urls import Rule, RuleTrie, filter_urls, split_url


def brute(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        for k, c in enumerate(rest):
            if c in "?#":
                rest = rest[:k]
                break
        host, _, tail = rest.partition("/")
        path = "/" + tail if "/" in rest else ""
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (r.host.count("."), len(r.path), r.verdict == "block"), default=None)
    return host, path, best.name if best else None, best.verdict if best else "allow"


URLS = [None, "", "no scheme", "http://", "://a.org", "http://EXAMPLE.org/es/1", "http://x.example.org/en/12?a=/es/", "http://example.org/en/2",
        "http://badexample.org/es/", "https://a.com/fr/", "https://a.com/fr", "https://a.com/de/x#y", "http://org/", "http://a.org?x", "http://a.org#/",
        "http://É.org/", "a://b://c.org/", "http://a.org./x", "http:///de/", "http://example.org:80/es/", "http://a.com//de/"]


def test_contract_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, URL_RULES).collect()}
    assert got == {i: brute(u, URL_RULES) for i, u in enumerate(URLS)}


@pytest.mark.parametrize("per_trie", [1, 3, 1000])
def test_random_rules(spark, per_trie):
    r = random.Random(per_trie)
    host = lambda: ".".join(r.choices(["a", "b", "com"], k=r.randint(1, 3)))
    path = lambda: "/" + "/".join(r.choices(["x", "xy", "", "z"], k=r.randint(0, 3)))
    rules = [Rule(host(), path(), r.choice(["allow", "block"])) for _ in range(12)]
    urls = [f"http://{host()}{r.choice([path(), ''])}" for _ in range(200)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in filter_urls(df, rules, rules_per_trie=per_trie).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_trie_alone():
    trie = RuleTrie([Rule("a.b", "/x", "block"), Rule("b", "/xyz", "allow")])
    assert trie.match(*split_url("http://c.a.b/xyz"))[1].host == "a.b"
    assert trie.match("c", "/x") is None


def test_no_rules_no_rows_and_clashing_names(spark):
    df = spark.createDataFrame([("http://a/b", "old", "old", 1)], "url string, Host string, rule string, row int")
    out = filter_urls(df, [])
    assert out.columns == ["url", "row", "host", "path", "rule", "verdict"]
    assert tuple(out.first()) == ("http://a/b", 1, "a", "/b", None, "allow")
    assert filter_urls(df.limit(0), URL_RULES).count() == 0
