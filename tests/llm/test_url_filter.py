import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loanlens.llm import url_filter


def judge(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, default))
    return host, path, best[3], best[4]


def run(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in urls], "page_id long, url string, host string")
    rows = url_filter.judge_urls(pages, url_filter.rule_table(spark, rules)).collect()
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows), key=str)


def test_against_every_rule(spark):
    rng = random.Random(3)
    labels = ["net", "org", "example", "a", "b", "shop", "networks"]
    rules = {(".".join(rng.choices(labels, k=rng.randint(1, 3))), "/" + "".join(rng.choices("ab/", k=rng.randint(0, 3)))):
             rng.choice(["block", "allow"]) for _ in range(120)}
    rules = [(h, p, v) for (h, p), v in rules.items()] + [("org", "", "block")]
    urls = [(i, "http://" + ".".join(rng.choices(labels, k=rng.randint(1, 4))) + rng.choice(["", "/", "?q", "#f"])
             + "".join(rng.choices("ab/", k=rng.randint(0, 6)))) for i in range(1500)]
    urls += [(5000 + i, "https://hot.example.org/a/" + str(i % 3)) for i in range(800)]  # a third on one host
    want = sorted(((i, *judge(u, rules)) for i, u in urls), key=str)
    assert run(spark, urls, rules) == want


def test_odd_addresses(spark):
    urls = [(1, None), (2, ""), (3, "no scheme/x"), (4, "HTTP://EXAMPLE.Net/EN/x"), (5, "http://example.net/en/"), (5, "http://example.net/en/"),
            (None, "http://a.net/"), (6, "http://example.net"), (7, "http://a.b://c/de/"), (8, "x" * 50_000 + "://q.net/" + "y" * 50_000),
            (9, "http://example.net.:80/en/"), (10, "://"), (11, "http:///x"), (12, "a\nb://net/\n?c"), (13, "http://notexample.net/en/")]
    assert run(spark, urls, url_filter.RULES) == sorted(((i, *judge(u, url_filter.RULES)) for i, u in urls), key=str)


@pytest.mark.parametrize("rules", [[], [(None, "/", "block"), ("", "/", "block"), ("net", None, "block"), ("net", None, "block")]])
def test_rules_that_are_none(spark, rules):
    got = run(spark, [(1, "http://a.net/x"), (2, "http://b.org")], rules)
    assert [r[3] for r in got] == [("net" if rules else None), None]


def test_no_pages(spark):
    assert run(spark, [], url_filter.RULES) == []


def test_hosts_do_not_pay_for_every_rule():
    """Hosts under a rule table ten times as long take about as long."""

    def seconds(n_rules):
        rules = sorted(f"/{k:06d}" for k in range(n_rules))
        rows = [(0, "net.", 0, p, None, "net", 3 + len(p), "net" + p, "block") for p in rules]
        rows += [(0, f"net.h{k:05d}.", 1, "/999", str(k), f"h{k:05d}.net", 0, None, None) for k in range(3000)]
        events = pd.DataFrame(rows, columns=[f.split()[0] for f in url_filter.EVENT.split(", ")])
        start = time.process_time()
        assert sum(len(b) for b in url_filter._sweep(iter([events]), "allow")) == 3000
        return time.process_time() - start

    assert seconds(10_000) < 5 * seconds(1000) + 0.2  # 3,000 hosts x 10,000 rules took seconds


def test_path_rules_nest():
    rng = random.Random(5)
    for _ in range(200):
        paths = sorted("".join(rng.choices("ab/", k=rng.randint(0, 5))) for _ in range(rng.randint(0, 30)))
        rules, given = url_filter.PathRules(), [(p, (len(p), rng.random())) for p in paths]
        for p, rule in given:
            rules.add(p, rule)
        for _ in range(30):
            path = "".join(rng.choices("ab/", k=rng.randint(0, 7)))
            assert rules.find(path) == max((r for p, r in given if path.startswith(p)), default=None)


def test_keys_nest(spark):
    row = spark.range(1).select(url_filter.host_key(F.lit("a.example.net")).alias("k")).first()
    assert row.k == "net.example.a."
