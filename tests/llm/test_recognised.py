"""The language stage: what is of no learnt language goes, all else stays."""

import random

import pytest
from helpers import documents

import corpus_pipeline
from loanlens.llm import langid

ITALIAN = "la biblioteca comunale apre ogni mattina alle nove e chiude quando il sole tramonta dietro le colline della campagna toscana"
POLISH = "biblioteka miejska otwiera się codziennie rano o dziewiątej i zamyka się gdy słońce zachodzi za wzgórzami nad szeroką rzeką"
RUSSIAN = "городская библиотека открывается каждое утро в девять часов и закрывается когда солнце садится за холмами"
CHINESE = "图书馆每天早上九点开门太阳下山时关门" * 3


def gibberish(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_strange_texts_go_and_clean_ones_stay(spark, sf_dir, size):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', size)}/documents.parquet").select("doc_id", "text", "lang", "source")
    clean = [tuple(r) for r in docs.collect()]
    rng = random.Random(6)
    strange = [ITALIAN, ITALIAN * 9, POLISH, RUSSIAN, CHINESE, *(gibberish(rng, n) for n in (8, 20, 200, 20_000))]
    mixed = documents(spark, clean + [(10**9 + k, t) for k, t in enumerate(strange)])
    got = corpus_pipeline.language(spark, mixed, "")
    assert got.schema == mixed.schema
    assert sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in clean)


def test_strangers_match_a_plain_count(monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 16)
    known = langid.grams("some words that were learnt")
    text = "Some odd words, 12! Grüße that weren't learnt yet " * 3
    plain = "".join(c if c.isalpha() else " " for c in text.lower())
    threes = [plain[k : k + 3] for k in range(len(plain) - 2) if plain[k : k + 3].strip()]
    held = lambda g: known[sum(ord(c) * 0x01000193 ** (2 - i) for i, c in enumerate(g)) % 2**32 * 0x9E3779B1 % 2**32 >> 16]
    assert langid.strangers(text, known) == (sum(not held(g) for g in threes), len(threes))
    assert langid.strangers("", known) == langid.strangers("ab", known) == (0, 0)
