"""URL rules by a sort-merge range join.

A host is read from its last label (`a.example.net` becomes `net.example.a.`), so that a rule for a
host and its subdomains is one interval of keys.  Addresses and rules are cut into the same key
ranges and every range is swept once in key order: a stack holds the host rules that are open at
the current key, nested as their intervals are.  A host's path rules come sorted, too; a second stack
tells which of them lie around each other, so a path finds its rules from the last one it sorts after,
and a host under many rules costs its addresses, not its rules.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.common import partitions

SAMPLES_PER_RANGE = 100  # addresses looked at per range to place its borders; they decide no result
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
EVENT = "part int, hkey string, kind int, path string, page_id string, host string, n int, rule string, verdict string"  # ids as texts: pandas makes floats of longs among nulls


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), *LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def host_key(host: Column) -> Column:
    """The labels from last to first, each closed by a full stop."""
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("."))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The verdict on every address: page_id, host, path, rule, verdict.

    `pages` needs page_id and url; `rules` has host, path and verdict.  A rule fits its host and all
    subdomains where the address's path starts with the rule's path.  The longest rule (host and
    path together) wins, among equally long ones that of the longer host, then `block`.  No fitting
    rule: rule is null and the verdict is `default`.

    Null addresses and those without `://` have an empty host and path; null ids are kept; repeated
    rows are judged one by one; repeated rules count once; rules with a null or empty host are
    left out and a null path is read as empty.  Other columns of `pages` are not looked at.
    """
    spark = pages.sparkSession
    n = partitions(spark)
    urls = pages.select(F.col("page_id").cast("string").alias("page_id"), host_of(F.col("url")).alias("host"),
                        path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("hkey", host_key(F.col("host"))).withColumn("tie", F.xxhash64("page_id"))
    borders = _borders(urls, n)
    given = (
        rules.where("host is not null and host != ''")
        .select(F.translate("host", *LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .distinct().withColumn("hkey", host_key(F.col("host")))
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = zip(b["hkey"], b["path"], b["tie"], strict=True)
            yield pd.DataFrame({
                "part": [bisect_right(borders, k) for k in keys], "hkey": b["hkey"], "kind": 1, "path": b["path"],
                "page_id": b["page_id"], "host": b["host"], "n": 0, "rule": None, "verdict": None,
            })

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.reset_index(drop=True)
            rows = [
                (part, k)
                for k, key in enumerate(b["hkey"])
                # keys of the interval [key, key with its last full stop raised to the next character)
                for part in range(bisect_left(borders, (key,)), bisect_left(borders, (key[:-1] + "/",)) + 1)
            ]
            at = b.iloc[[k for _, k in rows]].reset_index(drop=True)
            yield pd.DataFrame({
                "part": [p for p, _ in rows], "hkey": at["hkey"], "kind": 0, "path": at["path"],
                "page_id": None, "host": at["host"],
                "n": at["host"].str.len() + at["path"].str.len(), "rule": at["host"] + at["path"],
                "verdict": at["verdict"],
            })

    events = urls.mapInPandas(place, EVENT).unionByName(given.mapInPandas(spread, EVENT))
    dealt = events.repartitionById(n, F.col("part")).sortWithinPartitions("part", "hkey", "kind", "path")
    swept = dealt.mapInPandas(lambda batches: _sweep(batches, default),
                              "page_id string, host string, path string, rule string, verdict string")
    return swept.withColumn("page_id", F.col("page_id").cast("long"))


def _borders(urls: DataFrame, n: int) -> list[tuple]:
    """At most n - 1 keys that cut the addresses into about equal ranges."""
    rows = urls.count()
    if not rows or n < 2:
        return []
    share = min(1.0, n * SAMPLES_PER_RANGE / rows)
    keys = sorted((r.hkey, r.path, r.tie) for r in urls.select("hkey", "path", "tie").sample(share, 7).collect())
    return sorted({keys[len(keys) * k // n] for k in range(1, n)}) if keys else []


class PathRules:
    """The path rules of one host, added in the order of their paths; each knows the rule around it."""

    def __init__(self):
        self.paths: list[str] = []
        self.around: list[int] = []
        self.best: list[tuple] = []  # of a rule and all rules around it
        self.nested: list[int] = []  # the rules that hold the last one

    def add(self, path: str, rule: tuple) -> None:
        if self.paths and self.paths[-1] == path:
            self.best[-1] = max(self.best[-1], rule)
            return
        while self.nested and not path.startswith(self.paths[self.nested[-1]]):
            self.nested.pop()
        outer = self.nested[-1] if self.nested else -1
        self.nested.append(len(self.paths))
        self.paths.append(path)
        self.around.append(outer)
        self.best.append(rule if outer < 0 else max(rule, self.best[outer]))

    def find(self, path: str) -> tuple | None:
        """The best rule that the path starts with: the last one that sorts up to it, or one around that."""
        k = bisect_right(self.paths, path) - 1
        while k >= 0 and not path.startswith(self.paths[k]):
            k = self.around[k]
        return self.best[k] if k >= 0 else None


def _sweep(batches: Iterator[pd.DataFrame], default: str) -> Iterator[pd.DataFrame]:
    part, hosts = None, []
    for b in batches:
        out = []
        for p, hkey, kind, path, page_id, name, length, rule, verdict in b.itertuples(index=False, name=None):
            if p != part:
                part, hosts = p, []
            while hosts and not hkey.startswith(hosts[-1][0]):
                hosts.pop()
            if kind == 0:
                if not hosts or hosts[-1][0] != hkey:
                    hosts.append((hkey, PathRules()))
                hosts[-1][1].add(path, (length, len(hkey), verdict == "block", rule, verdict))
                continue
            fitting = [r for _, rules in hosts if (r := rules.find(path))]
            found = max(fitting) if fitting else (None, None, None, None, default)
            out.append((page_id, name, path, found[3], found[4]))
        if out:
            page_ids, names, paths, rules, verdicts = zip(*out, strict=True)
            yield pd.DataFrame({"page_id": pd.Series(page_ids, dtype=object), "host": names, "path": paths,
                                "rule": pd.Series(rules, dtype=object), "verdict": verdicts})


#: The rules of the registered query (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")
