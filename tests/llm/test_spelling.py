"""Spelling variants against a comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from helpers import ODD, documents

from loanlens.llm import queries, spelling


def plain_words(docs, least_length=5, least_count=3, damage=97):
    total = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % damage == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= least_length and n >= least_count}


def plain_near(words):
    """word -> near words, by wildcards at every place (words that share one) and by leaving one letter out."""
    out = {w: set() for w in words}
    holes = {}
    for w in words:
        for k in range(len(w)):
            holes.setdefault((w[:k], w[k + 1 :]), set()).add(w)
            shorter = w[:k] + w[k + 1 :]
            if shorter in out:
                out[w].add(shorter)
                out[shorter].add(w)
    for group in holes.values():
        for w in group:
            out[w] |= group - {w}
    return out


def plain_forms(docs):
    words = plain_words(docs)
    near = plain_near(words)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best
    rows = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(rows)


def forms(found):
    return sorted(tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_query_on_the_table(spark, sf_dir):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = forms(queries.QUERIES["op11_spelling"](spark, sf_dir))
    assert got == plain_forms(given)
    assert len(got) > 2000 and sum(r[1] is not None for r in got) > 100


def test_small_blocks_and_groups_lose_nothing(spark, monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 7))) for _ in range(500)] + ["x" * 80, "x" * 81, "x" * 79 + "y", "a" * 63, "a" * 64 + "b"]
    docs = [(k, " ".join(rng.choices(words, k=200)) + " " + " ".join(words)) for k in range(12)]
    want = plain_forms(docs)
    assert any(r[4] > 5 for r in want)
    monkeypatch.setattr(spelling, "BLOCK", 7)
    monkeypatch.setattr(spelling, "BLOCK_LETTERS", 100)
    for groups in (range(3, 4), range(5, 6)):
        monkeypatch.setattr(spelling, "GROUPS", groups)
        assert forms(spelling.variant_forms(documents(spark, docs))) == want


def test_chains_and_ties(spark):
    text = " ".join(["aaaaa"] * 3 + ["aaaab"] * 6 + ["aaaac"] * 6 + ["aaabb"] * 12 + ["zzzzz"] * 3 + ["zzzzy"] * 5)
    got = {r[0]: r[1:] for r in forms(spelling.variant_forms(documents(spark, [(1, text)]), damage=1 << 40))}
    assert got["aaaaa"] == ("aaaab", "aaabb", 3, 2, 6)  # two near words with n = 6: the smaller one
    assert got["aaaac"] == (None, "aaaac", 6, 2, None)
    assert got["zzzzz"] == (None, "zzzzz", 3, 1, None)


def test_runs_of_long_texts(monkeypatch):
    text = "Ärger, ABC déjàvu×x " * 30 + "y" * 300
    want = [r for r in spelling.runs(text, 3)]
    monkeypatch.setattr(spelling, "PIECE", 17)
    assert [w for part in spelling.runs(text, 3) for w in part] == [w for part in want for w in part]
    assert want[0][:3] == ["Ärger", "abc", "déjàvu×x"]


def test_one_edit_is_exact():
    rng = random.Random(4)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(120)] + ["a" * n for n in (63, 64, 65, 66)]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    got = spelling.one_edit(words, words, i, j)

    def edits(w):
        cs = "ab"
        yield from (w[:k] + w[k + 1 :] for k in range(len(w)))
        yield from (w[:k] + c + w[k:] for k in range(len(w) + 1) for c in cs)
        yield from (w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in cs)

    near = {w: set(edits(w)) - {w} for w in words}
    assert got.tolist() == [words[b] in near[words[a]] for a, b in zip(i, j, strict=True)]


def test_odd_rows(spark):
    rows = [*ODD, (20, "letter lettre letters " * 4), (21, "LETTER")]
    assert forms(spelling.variant_forms(documents(spark, rows))) == plain_forms(rows)
    assert forms(spelling.variant_forms(documents(spark, []))) == []
    assert forms(spelling.variant_forms(documents(spark, [(1, None), (2, "")]))) == []
