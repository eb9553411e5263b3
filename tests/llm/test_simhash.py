import random
import re

import numpy as np
import pytest
import xxhash
from helpers import ODD, documents

from loanlens.llm import common, simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance):
    kin = {k: k for k in fps}

    def root(x):
        while kin[x] != x:
            x = kin[x]
        return x

    order = sorted(fps)
    for i, a in enumerate(order):
        for b in order[:i]:
            if (a ^ b).bit_count() <= distance:
                kin[max(root(a), root(b))] = min(root(a), root(b))
    return {k: root(k) for k in fps}


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    odd = [(-k, t) for k, (_, t) in enumerate(ODD, 1)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents(spark, texts + odd)).collect()}
    fp = {i: plain_fingerprint(t) for i, t in texts + odd}
    label = plain_components(set(fp.values()), 3)
    least = {}
    for i, f in fp.items():
        least[label[f]] = min(i, least.get(label[f], i))
    assert got == {i: (f"{f:016x}", least[label[f]]) for i, f in fp.items()}


def clustered(rng, n):
    """Fingerprints around a few centres, so that some buckets are crowded."""
    centres = [rng.getrandbits(64) for _ in range(4)]
    out = {rng.getrandbits(64) for _ in range(n // 3)}
    while len(out) < n:
        f = rng.choice(centres)
        for b in rng.sample(range(64), rng.randint(0, 6)):
            f ^= 1 << b
        out.add(f)
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 64])  # 64: crowded buckets are cut into blocks
def test_links(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    fps = clustered(random.Random(block), 1200)
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    edges = simhash.link(frame, 3)
    rows = edges.collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 12 for r in rows)
    got = {r.node & (2**64 - 1): r.label for r in common.components(edges).collect()}
    want = plain_components(set(fps), 3)
    groups, same = {}, {}
    for f in fps:
        groups.setdefault(got.get(f, f"alone {f}"), set()).add(f)
        same.setdefault(want[f], set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, same.values()))


@pytest.mark.parametrize("m", [2, 3, 4])
def test_every_choice_of_groups_finds_all_pairs(m):
    rng = random.Random(m)
    fps = np.array(clustered(rng, 400), np.uint64)
    groups = simhash.bit_groups(np.random.default_rng(m).random((64, 64)), m)
    assert sorted(b for g in groups for b in g) == list(range(64))
    counts = [[np.bincount(simhash.extract(fps, bits), minlength=1 << len(bits)) for bits in simhash.blocks_of(g)] for g in groups]
    plan = simhash.Plan(groups, counts, 3)
    thresholds, cost = plan.thresholds(fps)
    assert (thresholds.sum(axis=1) == 3 - m + 1).all() and (thresholds >= -1).all() and np.isfinite(cost).all()
    keys, owner, kind = plan.entries(fps)
    filed, asked = {}, {}
    for k, f, c in zip(keys.tolist(), owner.tolist(), kind.tolist()):
        if c & 1:
            filed.setdefault(k, set()).add(f)
        if c & 2:
            asked.setdefault(f, set()).add(k)
    values = fps.tolist()
    for i, a in enumerate(values):
        near = set().union(*(filed.get(k, set()) for k in asked[a]))
        assert {b for b in values if (a ^ b).bit_count() <= 3} <= near


def test_odd_rows(spark):
    got = simhash.near_duplicates(documents(spark, ODD)).collect()
    assert len(got) == len(ODD)
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {1, 2, 3} and {r.component_id for r in zero} == {1}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert [r.component_id for r in got if r.doc_id == 4] == [4, 4]


def test_one_of_each_group_stays(spark):
    docs = documents(spark, ODD)
    kept = simhash.keep_first(docs)
    assert kept.columns and set(kept.columns) == set(docs.columns)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 4, 5, 6, 7, 8, 9, 10, 2**60 + 1]
    assert [r.text for r in kept.collect() if r.doc_id is None] == ["no id here"]


def test_copies_without_an_id_are_told_apart(spark):
    docs = documents(spark, [(None, "same words as these"), (None, "same words as these"), (3, "other words than those"), (None, "other words than those")])
    assert sorted((str(r.doc_id), r.text) for r in simhash.keep_first(docs).collect()) == [("3", "other words than those"), ("None", "same words as these")]


def test_no_documents(spark):
    assert simhash.near_duplicates(documents(spark, [])).collect() == []


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(1, 60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    got = {r.node: r.label for r in common.components(spark.createDataFrame(path + star + [(5, 5)], "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 1000 for i in range(1000, 1200)}}
