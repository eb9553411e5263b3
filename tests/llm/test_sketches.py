import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import ODD, documents

from loanlens.llm import sketches


def dice(a, b):
    a, b = Counter(a.hashes.tolist()), Counter(b.hashes.tolist())
    n = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / n if n else 1.0


def pieces(hashes):
    """Pieces with given hashes before the mixing."""
    return sketches.Pieces(np.array(hashes, np.uint64), np.arange(len(hashes)))


def check(rows, docs):
    docs = sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        cut = len(text) // 4
        other = text[: len(text) - cut] + after[:cut]
        own, new, theirs = map(sketches.digests, (text, other, after))
        want.append((i, len(text), hashlib.sha256(other.encode()).hexdigest(), sketches.Table(own).text(), sketches.Table(new).text(),
                     round(dice(own, new), 9), round(dice(own, theirs), 9)))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    rows = sketches.compare_versions(docs).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r.near_edited > r.near_next for r in rows) >= 0.95 * len(rows)


@pytest.mark.parametrize("docs", [ODD, [], [(1, "one. two. three.")], [(7, "a")] * 5, [(None, "x. y. z. w")] * 3 + [(0, "b")]])
def test_odd_rows(spark, docs):
    check(sketches.compare_versions(documents(spark, docs)).collect(), docs)


@pytest.mark.parametrize("size, only", [(0, 0), (5, 0), (1000, 1), (1000, 40), (3000, 3000)])
def test_peeling_recovers_the_difference(size, only):
    rng = random.Random(size + only)
    both = [rng.getrandbits(64) for _ in range(size)]
    a, b = [[rng.getrandbits(64) for _ in range(only)] for _ in range(2)]
    got = sketches.difference(pieces(both + a), pieces(both + b))
    assert sorted(got[0]) == sorted(pieces(a).hashes) and sorted(got[1]) == sorted(pieces(b).hashes)


def test_too_small_a_table_is_noticed():
    rng = random.Random(9)
    a, b = (pieces([rng.getrandbits(64) for _ in range(200)]) for _ in range(2))
    assert sketches.peel(sketches.Table(a, 24), sketches.Table(b, 24)) is None


def test_order_and_copies_of_pieces_count():
    a, b = sketches.digests("one. two. two. "), sketches.digests("two. one. ")
    assert len(a) == 3 and len(b) == 2 and sketches.likeness(a, b) == pytest.approx(0.8)
    assert sketches.Table(sketches.digests("x. y.")).text() == sketches.Table(sketches.digests("x. y.")).text()


def test_three_million_differences_peel():
    """Places must spread over large tables, or a larger one never helps."""
    rng = np.random.default_rng(1)
    plain = rng.integers(0, 1 << 63, 3_000_000, np.uint64)
    pieces = lambda h: sketches.Pieces(h, np.arange(len(h), dtype=np.int64))
    a, b = pieces(plain), pieces(plain[:5])
    only_a, only_b = sketches.difference(a, b)
    assert len(only_a) == len(np.unique(plain)) - 5 and not len(only_b)
