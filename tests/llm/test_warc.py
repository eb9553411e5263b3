import random

import pytest
from pyspark.sql import functions as F

from loanlens.llm import warc

RECORD = ("record_id long, url string, warc_date long, warc_type string, status int, headers map<string,string>, payload string, "
          "canonical string, verdict string")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], RECORD)


def tag(x):
    return None if x is None else x.strip().removeprefix("W/")


def plain(rows, key):
    fulls = [r for r in rows if r[3] == "response" and r[4] == 200 and r[6] is not None]
    out = {}
    for i, url, date, kind, status, heads, payload in rows:
        own = {k.lower(): v for k, v in (heads or {}).items()}
        if (i, url, date, kind, status, heads, payload) in fulls:
            out[i] = ("full", None, own, payload)
        elif kind != "revisit":
            out[i] = ("other", None, own, payload)
        else:
            before = [f for f in fulls if None not in (date, f[2], url, f[1]) and key(f[1]) == key(url) and f[2] < date]
            if not before:
                out[i] = ("missing", None, own, payload)
                continue
            base = max(before, key=lambda f: (f[2], f[0]))
            theirs = {k.lower(): v for k, v in (base[5] or {}).items()}
            a, b = tag(own.get("etag")), tag(theirs.get("etag"))
            c, d = own.get("last-modified"), theirs.get("last-modified")
            agree = a == b if None not in (a, b) else c == d if None not in (c, d) else a is None and c is None
            if agree:
                out[i] = ("resolved", base[0], theirs | {k: v for k, v in own.items() if k in warc.PERMITTED}, base[6])
            else:
                out[i] = ("changed", base[0], own, payload)
    return out


def run(spark, rows):
    return {r.record_id: (r.verdict, r.refers_to, r.headers, r.payload) for r in warc.resolve_revisits(frame(spark, rows)).collect()}


def test_against_a_plain_search(spark):
    rng = random.Random(4)
    rows = []
    for i in range(2000):
        url = rng.choice(["http://hot.net/", "https://www.hot.net", "http://hot.net/?utm_source=z"]) if i % 3 else f"http://site{rng.randint(0, 20)}.org/p"
        heads = {}
        if rng.random() < 0.7:
            heads["ETag"] = rng.choice(["", "W/"]) + rng.choice(['"a"', '"b"'])
        if rng.random() < 0.5:
            heads["Last-Modified"] = rng.choice(["mon", "tue"])
        heads["X-Own"], heads["Date"] = str(i), f"d{i}"
        kind = rng.choice(["response", "revisit", "revisit", "revisit", "request"])
        rows.append((i, url, rng.randint(0, 300), kind, 304 if kind == "revisit" else rng.choice([200, 200, 404]), heads,
                     f"body {i}" if kind != "revisit" and rng.random() < 0.9 else None))
    key = lambda u: u.split("://")[1].removeprefix("www.").split("?")[0].rstrip("/")
    assert run(spark, rows) == plain(rows, key)


def test_odd_records(spark):
    rows = [
        (1, "http://a.net/x", 1, "response", 200, {"ETag": "1", "Content-Length": "9"}, "one"),
        (2, "http://a.net/x", 1, "revisit", 304, None, None),  # at the same time, so not later
        (3, "HTTP://WWW.A.NET:80/x/#top", 2, "revisit", 304, {"etag": "W/1", "content-length": "0", "Expires": "soon"}, None),
        (4, None, 3, "revisit", 304, None, None), (5, "http://a.net/x", None, "revisit", 304, None, None),
        (6, "", 3, "response", 200, None, ""), (7, "", 4, "revisit", None, {}, None), (8, None, None, None, None, None, None),
        (9, "http://a.net/x", 5, "response", 200, {"ETag": "2"}, None), (10, "http://a.net/x", 9, "revisit", 304, {"ETag": "2"}, None),
    ]
    got = run(spark, rows)
    assert {i: r[:2] for i, r in got.items()} == {
        1: ("full", None), 2: ("missing", None), 3: ("resolved", 1), 4: ("missing", None), 5: ("missing", None), 6: ("full", None),
        7: ("resolved", 6), 8: ("other", None), 9: ("other", None), 10: ("changed", 1)}
    assert got[3][2:] == ({"etag": "W/1", "content-length": "9", "expires": "soon"}, "one")
    assert run(spark, []) == {}


@pytest.mark.parametrize("url, want", [
    ("http://www.Example.net:80/a/?b=2&a=1&utm_source=x#f", "example.net/a/?a=1&b=2"), ("https://u:p@h.org", "h.org/"),
    ("h.org/?", "h.org/"), ("http://h.org?q=1", "h.org/?q=1"), ("", "/"), ("  http://h.org//  ", "h.org/"), (None, None),
])
def test_canonical(spark, url, want):
    assert spark.range(1).select(warc.canonical(F.lit(url).cast("string")).alias("c")).first().c == want


def test_repeated_rows(spark):
    full = (1, "http://a.net/", 1, "response", 200, {"ETag": "1"}, "one")
    revisit = (2, "http://a.net/", 2, "revisit", 304, {"ETag": "1"}, None)
    other = (3, "http://a.net/", 3, "request", 200, None, "ask")
    lost = (4, None, 3, "revisit", 304, None, None)
    rows = [full] * 7 + [revisit] * 40 + [other] * 3 + [lost] * 5
    got = sorted((r.record_id, r.verdict, r.refers_to, r.payload) for r in warc.resolve_revisits(frame(spark, rows)).collect())
    assert got == [(1, "full", None, "one")] * 7 + [(2, "resolved", 1, "one")] * 40 + [(3, "other", None, "ask")] * 3 + [(4, "missing", None, None)] * 5


def test_repeated_ids_of_different_rows(spark):
    rows = [
        (1, "http://a.net/", 1, "response", 200, {"ETag": "1"}, "two"), (1, "http://a.net/", 1, "response", 200, {"ETag": "1"}, "one"),
        (1, "http://b.net/", 1, "response", 200, {"ETag": "5"}, "other site"),
        (2, "http://a.net/", 2, "revisit", 304, {"ETag": "1"}, None), (2, "http://a.net/", 2, "revisit", 304, {"ETag": "9"}, None),
        (2, "http://b.net/", 2, "revisit", 304, {"ETag": "5"}, None), (2, "http://c.net/", 2, "revisit", 304, None, None),
    ]
    got = [(r.canonical, r.verdict, r.refers_to, r.payload) for r in warc.resolve_revisits(frame(spark, rows)).collect() if r.record_id == 2]
    assert sorted(got, key=str) == [
        ("a.net/", "changed", 1, None), ("a.net/", "resolved", 1, "one"), ("b.net/", "resolved", 1, "other site"), ("c.net/", "missing", None, None)]
