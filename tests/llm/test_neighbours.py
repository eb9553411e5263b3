import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlens.llm import neighbours

NAN, INF = float("nan"), float("inf")


def run(spark, rows, query, **options):
    frame = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows], "vec_id long, embedding array<float>, score double, leaf int")
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(frame, query, **options).collect())


def plain(rows, ask, k):
    out = []
    for q, v in rows:
        if ask(q):
            a = np.float32(v).astype(float)
            near = sorted((float(np.sqrt(((np.float32(w).astype(float) - a) ** 2).sum())), i) for i, w in rows if i != q and len(w) == len(v))
            out += [(q, n, i, d) for n, (d, i) in enumerate(near[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 100])
def test_recall(spark, block):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(24)
    vectors = [centre + 0.05 * rng.standard_normal(24) if i % 3 == 0 else rng.standard_normal(24) for i in range(1500)]  # a crowded third
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vectors)]
    got, want = run(spark, rows, F.col("vec_id") % 25 == 0, block=block), plain(rows, lambda i: i % 25 == 0, 10)
    assert len(got) == len(want)
    found = {(q, i) for q, _, i, _ in got}
    assert len(found & {(q, i) for q, _, i, _ in want}) >= 0.95 * len(want)
    exact = {(q, i): float(np.sqrt(((np.float32(rows[q][1]).astype(float) - np.float32(rows[i][1]).astype(float)) ** 2).sum())) for q, i in found}
    assert all(d == exact[q, i] for q, _, i, d in got)


def test_ties_and_odd_vectors(spark):
    same = [(i, [1.0, 1.0]) for i in range(1, 40)]
    odd = [(100, None), (101, []), (102, [0.0, 0.0]), (103, [NAN, 1.0]), (104, [INF, 1.0]), (105, [None, 1.0]), (106, [1.0, 2.0, 3.0]),
           (None, [1.0, 1.0]), (0, [1.0, 1.0]), (0, [5.0, 5.0]), (200, [1.0, 1.5])]
    got = run(spark, same + odd, F.col("vec_id") % 100 == 0)
    assert [g for g in got if g[0] == 0] == [(0, n, n, 0.0) for n in range(1, 11)]
    assert [g[:3] for g in got if g[0] == 200] == [(200, n, n - 1) for n in range(1, 11)]
    assert {g[0] for g in got} == {0, 200}


def test_few_and_none(spark):
    rows = [(0, [1.0]), (1, [3.0]), (2, [2.0])]
    assert run(spark, rows, F.col("vec_id") == 0) == [(0, 1, 2, 1.0), (0, 2, 1, 2.0)]
    assert run(spark, [(0, [1.0])], F.col("vec_id") == 0) == []
    assert run(spark, [], F.col("vec_id") == 0) == []


@pytest.mark.parametrize("m, p, want", [(2, 0.95, 5.991), (8, 0.98, 18.168), (10, 0.5, 9.342)])
def test_chi_square(m, p, want):
    assert abs(neighbours.chi_square_quantile(m, p) - want) < 0.002


@pytest.mark.parametrize("block", [8192, 60])
def test_a_third_of_equal_vectors(spark, block):
    rng = np.random.default_rng(4)
    same = rng.standard_normal(64).astype(np.float32).tolist()
    rows = [(i, same if i % 3 == 0 else rng.standard_normal(64).astype(np.float32).tolist()) for i in range(6000)]
    got = run(spark, rows, (F.col("vec_id") % 3 == 0) & (F.col("vec_id") % 50 == 0), block=block)
    least = [3 * n for n in range(11)]
    assert got == [(q, n, i, 0.0) for q in range(0, 6000, 150) for n, i in enumerate([i for i in least if i != q][:10], 1)]


def test_equal_vectors_inside_a_block():
    rng = np.random.default_rng(4)
    vectors = np.where(np.arange(3000)[:, None] % 3 == 0, rng.standard_normal(64), rng.standard_normal((3000, 64)))
    directions = np.random.default_rng(5).standard_normal((64, 8))
    index = neighbours.Index(np.arange(3000), vectors, directions)
    for own in range(0, 300, 3):
        ids, best = index.search(own, vectors[own], vectors[own] @ directions, 10, 18.2, 0.0)
        assert len(ids) == 10 and not best.any()
