"""URL rules against a loop over rules."""

import re

from corpusspark.llm import url_rules as op

URLS = [
    "https://www.Example.com/en/1?x", "http://example.com/en/", "https://m.example.com/en/x#y", "https://a.net/es/", "https://net/fr/q", "ftp://x.org/en/", "nothing", None, "", "://", "https://example.com", "https://example.com?/en/",
    "https://xexample.com/en/1", "https://example.com//en/", "https://example.com/enx", "https://com/", "https://a.net/es/", "http://[::1]/", "https://a.b.c.d.e.example.com/en/" + "p" * 5000,
]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), v == "block", h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], "allow" if not best or not best[1] else "block"


def judged(spark, rules, **more):
    pages = spark.createDataFrame([(k, u, "r") for k, u in enumerate(URLS)] * 2, "page_id long, url string, rule string")
    table = op.rule_table(spark, rules) if rules else spark.createDataFrame([], "host string, path string, verdict string")
    return sorted((tuple(r) for r in op.judge(pages, table, **more).collect()), key=repr)


def test_rules(spark):
    odd = [("example.com", "/e", "block"), ("example.com", "", "allow"), ("example.com", "/en/", "allow")]
    many = [("com", "/" + "p" * k, "block") for k in range(400)] + [("x." * k + "org", "/en/", "block") for k in range(30)]
    for rules in (op.RULES, op.RULES + odd, [], op.RULES + many):
        want = sorted(((k, *brute(u, rules)) for k, u in enumerate(URLS) for _ in range(2)), key=repr)
        assert judged(spark, rules) == want
        assert judged(spark, rules, broadcast_rules=-1) == want


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert op.judge(pages, op.rule_table(spark, op.RULES)).count() == 0
