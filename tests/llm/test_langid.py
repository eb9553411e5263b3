import zlib

import numpy as np
from helpers import ODD, documents

from loanlens.llm import langid


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    found = langid.identify(docs, langid.learn(docs)).collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 200
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_held_out_rows_teach_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    lied = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, s) for i, t, lang, s in rows]
    a = langid.identify(documents(spark, rows), langid.learn(documents(spark, rows))).collect()
    b = langid.identify(documents(spark, lied), langid.learn(documents(spark, lied))).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in a) == sorted((r.doc_id, r.lang_pred) for r in b)


def test_grams_match_a_plain_count():
    def plain(text):
        c = [ord(x) if x.isalpha() else 32 for x in text.lower()]
        seen = set()
        for n in (1, 2, 3):
            for k in range(len(c) - n + 1):
                g = c[k]
                for x in c[k + 1 : k + n]:
                    g = (g * 0x01000193 + x) & 0xFFFFFFFF
                seen.add((g * 0x9E3779B1 & 0xFFFFFFFF) >> 16)
        return seen

    for text in ("", "a", "ab", "Grüße, Ωmega 12!", "𝔘nicode 𐐀 é", "x" * 50):
        assert set(np.flatnonzero(langid.grams(text)).tolist()) == plain(text)


def test_long_texts_are_read_to_the_end(monkeypatch):
    text = "abc def ghi " * 50 + "zyx"
    whole = langid.grams(text)
    monkeypatch.setattr(langid, "PIECE", 16)
    assert (langid.grams(text) == whole).all()


def test_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.learn(docs)
    odd = documents(spark, ODD)
    rows = langid.identify(odd, model).collect()
    assert len(rows) == len(ODD) and set(rows[0].asDict()) == {*odd.columns, "lang_pred"}
    for r in rows:
        no_letter = r.text is None or not any(map(str.isalpha, r.text))
        assert (r.lang_pred == "und") == no_letter and (r.score == 0) >= no_letter
    assert langid.identify(documents(spark, []), model).collect() == []


def test_nothing_to_learn(spark):
    docs = documents(spark, [(1, "some text"), (2, None, "en"), (3, "")])
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, langid.learn(docs)).collect()} == {("und", 0.0)}


def test_scores_match_a_plain_kernel_machine(spark, sf_dir):
    """Kernel, whitening of the landmarks, ridge regression and scores, each written out, against the folded matrix."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null and text is not null").collect()
    rows = [(r.text, r.lang, (r.doc_id * 7919) % 1_000_003) for r in docs]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string, order long"), landmarks=40)
    sets = [set(np.flatnonzero(langid.grams(t)).tolist()) for t, _, _ in rows]
    langs = sorted({lang for _, lang, _ in rows})
    marks = []
    for lang in langs:
        own = sorted((order, k) for k, (_, x, order) in enumerate(rows) if x == lang)
        marks += [k for _, k in own[: max(2, 40 // len(langs))]]
    kernel = lambda a, b: len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b)))
    among = np.array([[kernel(sets[i], sets[j]) for j in marks] for i in marks])
    to_marks = np.array([[kernel(s, sets[j]) for j in marks] for s in sets])
    value, vector = np.linalg.eigh(among)
    keep = value > 1e-6 * value.max()
    phi = np.hstack([to_marks @ vector[:, keep] / np.sqrt(value[keep]), np.ones((len(rows), 1))])
    want = np.array([[1.0 if lang == x else -1.0 for x in langs] for _, lang, _ in rows])
    share = np.array([len(rows) / len(langs) / sum(x == lang for _, x, _ in rows) for _, lang, _ in rows])[:, None]
    penalty = 1e-2 * np.eye(phi.shape[1])
    penalty[-1, -1] = 0
    beta = np.linalg.solve(phi.T @ (phi * share) + penalty, phi.T @ (want * share))
    got = model.scores(np.stack([langid.grams(t) for t, _, _ in rows]))
    assert model.langs == langs and np.abs(got - phi @ beta).max() < 1e-4
