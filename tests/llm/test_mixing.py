import math
from collections import defaultdict

import pytest
from helpers import ODD, documents
from pyspark.sql import functions as F

from loanlens.llm import mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, limit=2):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, fixed = set(names), {}
    while True:
        level = (sum(sizes.values()) * share - sum(fixed.values())) / max(1, sum(w[s] for s in left))
        over = {s for s in left if w[s] * level > limit * sizes[s]}
        if not over:
            return {s: fixed[s] if s in fixed else w[s] * level for s in names}
        fixed |= {s: limit * sizes[s] for s in over}
        left -= over


def check(rows, n):
    assert len(rows) == n
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source]
    for s, t in want.items():
        assert math.isclose(target[s], t, rel_tol=1e-12, abs_tol=1e-9)
    return taken, target


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix(docs).collect()
    taken, target = check(rows, docs.count())
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    # within a source the documents that get one more epoch come first in key order
    keyed = mixing.mix(docs).join(docs.select("doc_id", mixing.mix_key(11).alias("k")), "doc_id").where("size > 0").collect()
    by = defaultdict(list)
    for r in keyed:
        by[r.source].append((r.k, r.taken / r.size))
    for pairs in by.values():
        shares = [s for _, s in sorted(pairs)]
        assert shares == sorted(shares, reverse=True) and len({s for s in shares if s != int(s)}) <= 1


def test_hot_and_tiny_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 3)
    docs = spark.range(900).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 5).cast("string")).alias("source"))
    taken, target = check(mixing.mix(docs).collect(), 900)
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)


def test_odd_rows(spark):
    docs = documents(spark, [(i, t, "en", s) for k, (i, t) in enumerate(ODD) for s in (("a", None, "b")[k % 3],)])
    rows = mixing.mix(docs).collect()
    check(rows, len(ODD))
    assert {r.size for r in rows if r.doc_id in (1, 2, 3)} == {0}


def test_repeated_rows_share_the_cut(spark):
    docs = documents(spark, [(1, "a b c d e", "en", "s")] * 40 + [(2, "x y z", "en", "t")])
    taken, target = check(mixing.mix(docs).collect(), 41)
    assert all(abs(taken[s] - target[s]) <= 40 for s in target)


def test_mix_as_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mixing.mix(docs, keep_text=True)
    rows = mixing.repeat(mixed).select(*docs.columns)
    words = {r.source: r.n for r in rows.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert words == {r.source: r.n for r in mixed.groupBy("source").agg(F.sum("taken").alias("n")).collect() if r.n}
    whole = {r.doc_id: r.text for r in docs.collect()}
    assert all(whole[r.doc_id].startswith(r.text.rstrip()) and r.n_chars == len(r.text) for r in rows.collect())


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (2, " ")]])
def test_nothing_to_mix(spark, rows):
    assert [(r.size, r.target, r.taken) for r in mixing.mix(documents(spark, rows)).collect()] == [(0, 0.0, 0)] * len(rows)


def test_no_python_in_the_plan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
