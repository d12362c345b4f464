"""Verdicts against brute force over random urls and nested rules."""

import random

from scholarch.llm import url_rules


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    after = rest[cut:]
    return host, after[: min([after.find(c) for c in "?#" if c in after], default=len(after))]


def brute(url, rules, default):
    host, path = parse(url)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")


def test_random_rules(spark):
    rng = random.Random(4)
    hosts = ["com", "org", "a.com", "b.a.com", "x.b.a.com", "aa.com", "é.org", "a.org", "com.org", "-a.com"]
    paths = ["/", "/x", "/x/", "/x/y", "/xy", "/x/y/z", "/é", ""]
    rules = {(rng.choice(hosts), rng.choice(paths)): rng.choice(["allow", "block"]) for _ in range(30)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [f"{rng.choice(['http', 'https', 'HTTP'])}://{rng.choice(hosts).upper() if rng.random() < 0.2 else rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?a=/x', '#top', '1'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "http://", "http:///x", "http://com?x", "http://a.com/" + "x" * 20000, "a://b://com/x", "http://a..com/x", "http://.com/x", "http://com./x"] + ["http://a.com/x/y"] * 50
    for default in ("allow", "block"):
        got = {r.page_id: tuple(r)[1:] for r in url_rules.judge(frame(spark, urls), spark.createDataFrame(rules, "host string, path string, verdict string"), default).collect()}
        assert got == {i: brute(u, rules, default) for i, u in enumerate(urls)}


def test_edges(spark):
    schema = "host string, path string, verdict string"
    pages = frame(spark, ["http://a.com/x", None])
    empty = spark.createDataFrame([], schema)
    assert {r.verdict for r in url_rules.judge(pages, empty).collect()} == {"allow"}
    assert url_rules.judge(pages.limit(0), empty).count() == 0
    twice = spark.createDataFrame([("a.com", "/", "allow"), ("A.com", "/", "block"), (None, "/", "block"), ("a.com", None, "block")], schema)
    again = pages.union(pages).withColumn("page_id", (pages.page_id * 0).cast("long"))
    got = url_rules.judge(again, twice).collect()
    assert sorted((r.rule or "", r.verdict) for r in got) == [("", "allow"), ("", "allow"), ("a.com/", "block"), ("a.com/", "block")]
