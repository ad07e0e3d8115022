import random

import pytest

from seqloom.llm import url_filter as U

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("a.b.c", "", "block"), ("org", "/", "block")]
PAGES = "page_id long, url string, host string, rule string"


def brute(url):
    url = url or ""
    head, sep, rest = url.partition("://")
    if not sep:
        return "", "", None, "allow"
    host = "".join(c.lower() if c.isascii() else c for c in rest[: min([i for i in (rest.find(x) for x in "/?#") if i >= 0], default=len(rest))])
    tail = rest[len(host) :]
    path = tail[: min([i for i in (tail.find(x) for x in "?#") if i >= 0], default=len(tail))]
    fits = [(len(h + p), v == "block", h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    best = max(fits)
    return host, path, best[2], best[3]


def urls():
    rng = random.Random(1)
    found = [None, "", "no scheme.com/en/", "http://", "://", "http://COM/en/", "http://com", "http://com/EN/", "x://a://b.com/en/1", "http://.com/en/x", "http://example.com./en/7",
             "http://exämple.ÉCOM/en/", "http://a.b.c", "http://x.a.b.c?q", "http://xa.b.c", "http://user@w.com:80/en/", "http://w.com/en/?x=/de/", "http://w.com#/en/", "http://w.com/\nen/", "http://e.com/en/" + "y" * 100_000]
    for _ in range(300):
        host = ".".join(rng.choices(["example", "www", "com", "net", "org", "a", "b", "c"], k=rng.randrange(1, 5)))
        found.append(f"https://{host}{rng.choice(['', '/', '/en/', '/en/7', '/en/71', '/de/', '/de/8x', '/d'])}{rng.choice(['', '?q', '#f'])}")
    return found


@pytest.mark.parametrize("broadcast", [True, False])
def test_against_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(U, "BROADCAST_RULES", 0)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    rows = [(i, u, "clash", "clash") for i, u in enumerate(urls())]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge_urls(spark.createDataFrame(rows, PAGES), rules).collect()}
    for i, u, *_ in rows:
        assert got[i] == brute(u), u


def test_short_prefixes_are_confirmed(spark, monkeypatch):
    monkeypatch.setattr(U, "PREFIX_HEX", 1)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    rows = [(i, u, "", "") for i, u in enumerate(urls())]
    got = {r["page_id"]: r["rule"] for r in U.judge_urls(spark.createDataFrame(rows, PAGES), rules).collect()}
    assert all(got[i] == brute(u)[2] for i, u, *_ in rows)


def test_repeated_null_and_empty(spark):
    rules = spark.createDataFrame([*RULES, RULES[0], ("com", "/en/", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/en/", "", "")] * 3 + [(None, None, "", "")], PAGES)
    rows = U.judge_urls(pages, rules).collect()
    assert len(rows) == 4 and sum(r["verdict"] == "block" for r in rows) == 3
    assert U.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in U.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
