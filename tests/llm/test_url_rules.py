from __future__ import annotations

import random
import re

import pytest

from marisma.llm.url_rules import judge_urls


def parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = m.groups() if m else ("", "")
    return re.sub("[A-Z]", lambda c: c[0].lower(), host), path


def brute(pages, rules, default="allow"):
    out = []
    for page, url in pages:
        host, path = parts(url)
        fits = []
        for h, p, v in rules:
            h, p = h or "", p or ""
            if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p):
                fits.append((len(h) + len(p), len(h), h + p, v))
        best = max(fits, default=None)
        out.append((page, host, path, best and best[2], best[3] if best else default))
    return sorted(out, key=str)


def run(spark, pages, rules):
    p = spark.createDataFrame([(i, u, "x") for i, u in pages], "page_id long, url string, verdict string").repartition(6)
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    return sorted((tuple(x) for x in judge_urls(p, r).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    label = lambda: rng.choice(["a", "b", "ab", "com", "net", "www", "é"])
    host = lambda: ".".join(label() for _ in range(rng.randrange(1, 5)))
    path = lambda: rng.choice(["", "/"]) + "/".join(rng.choice(["en", "fr", "e", "", "ü"]) for _ in range(rng.randrange(0, 4)))
    rules = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(30)]
    pages = [(i, f"http://{host().upper()}{path()}{rng.choice(['', '?q=/en', '#x'])}") for i in range(300)]
    assert run(spark, pages, rules) == brute(pages, rules)


def test_odd_rows(spark):
    pages = [
        (1, None), (2, ""), (3, "no scheme"), (None, "http://a.com/en/x"), (None, "http://a.com/en/x"), (4, "http://A.COM"), (5, "x://y://a.com/en/"),
        (6, "http://com/"), (7, "http://xa.com/en/"), (8, "http://a.com./en/"), (9, "http://" + "b." * 40 + "a.com/" + "z" * 20_000),
        (10, "http://a.com\n/en/"), (11, "http://a.com:80/en/"), (12, "http://a.com?/en/"),
    ]
    rules = [("a.com", "/en/", "block"), ("a.com", "/en/", "allow"), ("com", "", "allow"), ("a.com", None, "block")]
    assert run(spark, pages, rules) == brute(pages, rules)


def test_a_rule_for_every_host(spark):
    pages = [(1, "http://a/x"), (2, "http://b/y"), (3, None)]
    rules = [(None, "/x", "block"), ("", "", "block"), ("b", "", "allow")]
    assert run(spark, pages, rules) == brute(pages, rules)


def test_empty_tables(spark):
    assert run(spark, [], [("a", "", "block")]) == []
    assert run(spark, [(1, "http://a/")], []) == [(1, "a", "/", None, "allow")]
