"""URL verdicts against every rule tried on every URL."""

import random

from muster.llm import urls


def slow(url, rules):
    rest = (url or "").partition("://")
    rest = rest[2] if rest[1] else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), v == "allow", h + p, v) for h, p, v in rules
            if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def test_equals_trying_every_rule(spark):
    rng = random.Random(5)
    rules = [("net", "/", "block"), ("a.net", "/x", "allow"), ("org", "", "block"), ("b.org", "/x/", "allow"),
             ("a.net", "/x/y/", "block"), ("c", "/xy", "block"), ("c", "/xy", "allow"), ("", "/", "block")]
    found = [None, "", "no scheme", "http://", "://", "HTTP://A.NET/x", "http://b.org", "http://b.org?x=/x/", "s://a.net/x\ny#://c/xy"]
    for _ in range(400):
        host = ".".join(rng.choice(["a", "b", "net", "ORG", "c", "é", ""]) for _ in range(rng.randint(1, 5)))
        tail = "".join(rng.choice(["/", "x", "y", "?", "#", "://"]) for _ in range(rng.randint(0, 8)))
        found.append(f"{rng.choice(['http', 'x', ''])}://{host}{tail}")
    rows = [(k, u, "old", "html") for k, u in enumerate(found + found[:30])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, u string").repartition(3)
    got = urls.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert got.columns == ["page_id", "url", "u", "host", "path", "rule", "verdict"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert got == {k: slow(u, rules) for k, u, *_ in rows}


def test_no_rules_and_no_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert tuple(urls.judge(pages, none).first()) == (1, "http://a.b/c", "a.b", "/c", None, "allow")
    assert urls.judge(pages.limit(0), none).count() == 0
