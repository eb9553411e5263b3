"""The quality classifier: held-out accuracy, and its parts against plain versions."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import ODD, documents

from loanlens.llm import quality, queries


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int")


def test_held_out_accuracy(spark, sf_dir):
    large = sf_dir.replace("sf0.001", "sf0.01")
    found = queries.QUERIES["op12_quality"](spark, large).collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{large}/labels.parquet").collect()}
    assert len(found) == spark.read.parquet(f"{large}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == held_out(r.doc_id) for r in found)
    held = [r for r in found if r.held_out and r.doc_id in label]
    clean, junk = ([r.predicted for r in held if label[r.doc_id] == q] for q in (1, 0))
    assert len(clean) > 50 and len(junk) > 5
    assert sum(clean) >= 0.97 * len(clean) and sum(junk) <= 0.1 * len(junk)


def test_held_out_labels_teach_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    lied = [(i, 1 - q if held_out(i) else q) for i, q in given]
    a, b = (quality.learn(docs, labelled(spark, rows)) for rows in (given, lied))
    assert (a == b).all() and np.count_nonzero(a) > 20


def test_one_row_at_a_time_gives_the_same_weights(spark, sf_dir):
    """The distributed fit against a plain loop over dictionaries, by the published update."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    given = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    rows = sorted(((zlib.crc32(str(i).encode()), i, q) for i, q in given if not held_out(i) and i in docs))
    alpha, beta, l1, l2 = 1.0, 1.0, 0.2, 0.1
    z, n = Counter(), Counter()

    def weight(k):
        if abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for _ in range(2):
        for _, i, label in rows:
            x = plain_features(docs[i])
            p = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - label) * v
                w = weight(k)
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w
                n[k] += g * g
    got = quality.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"), labelled(spark, given), epochs=2)
    want = np.zeros(quality.SIZE)
    for k in z:
        want[k] = weight(k)
    assert np.abs(got - want).max() < 1e-4 and np.count_nonzero(want) > 20


def plain_features(text):
    def place(h):
        return (h * 0x9E3779B1 & 0xFFFFFFFF) >> (33 - quality.BITS)

    words = (text or "").split()
    own = Counter(place(zlib.crc32(w.lower().encode())) for w in words)
    kinds = [zlib.crc32(quality.shape(w).encode()) for w in words]
    runs = Counter(place(k) for k in kinds)
    for n in (2, 3):
        for k in range(len(kinds) - n + 1):
            h = kinds[k]
            for m in range(1, n):  # a run of three builds on that of two
                h = (h * 0x01000193 + kinds[k + m]) & 0xFFFFFFFF
            runs[place((h + n) & 0xFFFFFFFF)] += 1
    half = 1 << (quality.BITS - 1)
    out = {p: math.sqrt(c / max(1, sum(own.values()))) for p, c in own.items()}
    out |= {p + half: math.sqrt(c / max(1, sum(runs.values()))) for p, c in runs.items()}
    return out | {quality.SIZE - 1: 1.0}


def test_features_match_a_plain_count(monkeypatch):
    texts = [None, "", "one", "Two words", "A b. C!! d$$$ 12 a B ÉTÉ…", "x y z " * 40, "\n\t "]
    for piece in (quality.PIECE, 5):
        monkeypatch.setattr(quality, "PIECE", piece)
        for text in texts:
            places, values = quality.features(text, quality.Hashes())
            want = plain_features(text)
            assert len(places) == len(want)
            assert all(abs(want[int(p)] - v) < 1e-6 for p, v in zip(places, values, strict=True))


@pytest.mark.parametrize(("word", "want"), [("Ab12!!!!", "Aa0!!!"), ("THE", "AA"), ("x", "a"), ("$$$", "$$$"), ("|", "|"), ("don't", "a'a"), ("_", "_")])
def test_shapes(word, want):
    assert quality.shape(word) == want


def test_rare_labels_keep_their_share(spark):
    docs = documents(spark, [(k, "good words here." if k % 10 else "BAD!! WORDS!!") for k in range(600)])
    labels = labelled(spark, [(k, int(k % 10 > 0)) for k in range(600)])
    weights = quality.learn(docs, labels, sample=80)
    got = {r.doc_id: r.score for r in quality.score(docs, weights).collect()}
    assert got[1] > 0.9 and got[10] < 0.4


def test_odd_rows(spark):
    docs = documents(spark, ODD)
    labels = labelled(spark, [(1, 0), (2, 1), (4, 1), (5, 0), (6, 1), (7, None), (8, 3), (9, 1), (9, 0), (None, 1), (10, 1), (10, 1)])
    got = quality.score(docs, quality.learn(docs, labels)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in ODD)
    assert all(0 <= r.score <= 1 and r.held_out == held_out(r.doc_id) for r in got)
    blank = {r.score for r in got if r.doc_id in (1, 2, 3)}
    assert len(blank) == 1
    none = labelled(spark, [])
    assert {r.score for r in quality.score(docs, quality.learn(docs, none)).collect()} == {0.5}
    assert quality.score(documents(spark, []), quality.learn(documents(spark, []), none)).count() == 0
    assert not quality.learn(documents(spark, []), labels).any()
