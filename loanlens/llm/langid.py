"""Language identification by string kernels.

Two texts are as alike as the n-grams of one to three letters that both hold (a blended spectrum,
presence only), divided by the roots of how many each holds.  Landmark texts span the kernel space
(Nystroem); a ridge regression per language, one against the rest, is solved there.  The landmark
matrix, its whitening and the regression weights fold into one matrix of n-grams by languages, so
batches of texts are scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.llm.common import stage

GRAM_BITS = 16  # n-grams are hashed into this many bits
PIECE = 1 << 20  # characters looked at at once; pieces overlap, so no n-gram is missed
BATCH = 256
STRANGE = 0.15  # share of unknown trigrams that a text of a learnt language may always have
SLACK = 8  # and so many besides: a short text with an odd word
UNKNOWN = "und"

_LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(text: str) -> np.ndarray:
    """Which hashed n-grams the whole text holds: a vector of 2^GRAM_BITS truth values."""
    seen = np.zeros(1 << GRAM_BITS, dtype=bool)
    text = text.lower()
    for start in range(0, max(len(text), 1), PIECE):
        piece = text[start : start + PIECE + 2]
        code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _LETTER[np.minimum(code, 0xFFFF)] | (code > 0xFFFF)
        code = np.where(letter, code, np.uint32(32))
        gram = code
        for n in (1, 2, 3):
            if n > 1:
                if len(code) < n:
                    break
                gram = gram[:-1] * np.uint32(0x01000193) + code[n - 1 :]
            seen[(gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)] = True
    return seen


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def strangers(text: str, known: np.ndarray) -> tuple[int, int]:
    """How many trigrams with a letter of the whole text are not known, and how many there are."""
    unknown = total = 0
    text = text.lower()
    for start in range(0, max(len(text) - 2, 0), PIECE):
        code = np.frombuffer(text[start : start + PIECE + 2].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _LETTER[np.minimum(code, 0xFFFF)] | (code > 0xFFFF)
        code = np.where(letter, code, np.uint32(32))
        gram = (code[:-2] * np.uint32(0x01000193) + code[1:-1]) * np.uint32(0x01000193) + code[2:]
        gram = gram[letter[:-2] | letter[1:-1] | letter[2:]]
        unknown += int((~known[(gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)]).sum())
        total += len(gram)
    return unknown, total


class Model:
    """Languages, the n-grams that landmarks hold, and one column of weights per language."""

    def __init__(self, langs: list[str], active: np.ndarray, weights: np.ndarray, base: np.ndarray, strange: np.ndarray | None = None):
        self.langs, self.active, self.weights, self.base = langs, active, weights, base
        self.strange = np.ones(len(langs)) if strange is None else strange  # share of unknown trigrams allowed, by language

    def scores(self, seen: np.ndarray) -> np.ndarray:
        """One row per text, one column per language; about 1 for its own language and -1 for others."""
        size = np.sqrt(np.maximum(seen.sum(axis=1), 1))[:, None]
        return seen[:, self.active].astype(np.float32) @ self.weights / size + self.base

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t is not None and has_letter(t)] if self.langs else []
        for k in range(0, len(known), BATCH):
            rows = known[k : k + BATCH]
            found = self.scores(np.stack([grams(texts[i]) for i in rows]))
            best = found.argmax(axis=1)
            for i, j, v in zip(rows, best, found[np.arange(len(rows)), best], strict=True):
                langs[i], scores[i] = self.langs[j], float(np.clip((v + 1) / 2, 0, 1))
        return langs, scores

    def familiar(self, text: str, lang: str) -> bool:
        """Whether the text's trigrams, counted as often as they occur, are those of learnt texts."""
        known = np.zeros(1 << GRAM_BITS, dtype=bool)
        known[self.active] = True
        unknown, total = strangers(text, known)
        return unknown <= self.strange[self.langs.index(lang)] * total + SLACK


def fit(labelled: DataFrame, sample: int = 6000, landmarks: int = 160, ridge: float = 1e-2) -> Model:
    """Learn from `labelled` (text, lang, order: a random long).

    The fit uses at most about `sample` rows, dealt evenly to the languages and chosen by the
    random order, and about `landmarks` of them as landmarks (at least 2 per language).
    """
    counts = {r.lang: r["count"] for r in labelled.where("lang is not null and text is not null").groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros(0, int), np.zeros((0, 0), np.float32), np.zeros(0))
    each, marks = max(50, sample // len(langs)), max(2, landmarks // len(langs))
    # one literal per language: a join would shuffle the texts
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, each / counts[lang]))])
    unit = F.shiftrightunsigned("order", 11) / float(1 << 53)
    chosen = labelled.where("lang is not null and text is not null").where(unit < F.element_at(share, F.col("lang")))

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bits = [np.packbits(grams(t)).tobytes() for t in b["text"]]
            yield pd.DataFrame({"lang": b["lang"], "order": b["order"], "bits": bits})

    sampled = stage(chosen.select("text", "lang", "order").mapInPandas(featurise, "lang string, order long, bits binary"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("order", "bits"))
    rows = sampled.withColumn("nth", nth).where(F.col("nth") <= marks).select("lang", "bits").collect()
    mark = np.stack([_unpack(r.bits) for r in rows]).astype(np.float32)
    strange = allowed_strange(mark, np.array([r.lang for r in rows]), langs)
    active = np.flatnonzero(mark.any(axis=0))
    mark = mark / np.sqrt(np.maximum(mark.sum(axis=1), 1))[:, None]
    mark = np.ascontiguousarray(mark[:, active])

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), BATCH):
                part = b.iloc[k : k + BATCH]
                seen = np.stack([_unpack(x) for x in part["bits"]])
                like = seen[:, active].astype(np.float32) @ mark.T / np.sqrt(np.maximum(seen.sum(axis=1), 1))[:, None]
                yield pd.DataFrame({"lang": part["lang"], "order": part["order"], "like": list(like.astype(float))})

    like = sampled.mapInPandas(kernel, "lang string, order long, like array<double>").orderBy("order", "lang").toPandas()
    near = np.stack(like["like"].to_numpy())
    value, vector = np.linalg.eigh((mark @ mark.T).astype(float))
    keep = value > 1e-6 * value.max()
    white = vector[:, keep] / np.sqrt(value[keep])
    phi = np.hstack([near @ white, np.ones((len(near), 1))])
    want = np.where(like["lang"].to_numpy()[:, None] == np.array(langs, dtype=object)[None, :], 1.0, -1.0)
    # every language weighs the same, however many rows it has
    weight = np.array([1.0 / (like["lang"] == lang).sum() for lang in like["lang"]])[:, None] * len(like) / len(langs)
    penalty = ridge * np.eye(phi.shape[1])
    penalty[-1, -1] = 0
    beta = np.linalg.solve(phi.T @ (phi * weight) / len(phi) + penalty / len(phi), phi.T @ (want * weight) / len(phi))
    return Model(langs, active, (mark.T.astype(float) @ (white @ beta[:-1])).astype(np.float32), beta[-1], strange)


def allowed_strange(mark: np.ndarray, lang: np.ndarray, langs: list[str]) -> np.ndarray:
    """The share of unknown trigrams that texts of each language may have: twice the share of n-grams
    that no other landmark holds, as nine in ten of its landmarks have it at most; STRANGE at least."""
    alone = (mark * (mark.sum(axis=0) == 1)).sum(axis=1) / np.maximum(mark.sum(axis=1), 1)
    return np.array([max(STRANGE, 2 * np.quantile(alone[lang == x], 0.9)) if (lang == x).any() else 1.0 for x in langs])


def _unpack(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)


def learn(docs: DataFrame, **options) -> Model:
    """The model of `docs`: learnt from text and lang of the rows that are not held out."""
    chosen = docs.where("lang is not null and doc_id is not null").where(~is_held_out(F.col("doc_id")))
    return fit(chosen.select("text", "lang", F.xxhash64(F.col("doc_id").cast("string"), F.lit("fit")).alias("order")), **options)


def recognised(docs: DataFrame, model: Model, least: float = 0.0) -> DataFrame:
    """The documents, unchanged, that are made of the trigrams of the language they score best for, with
    `least` or more; null texts and texts without a letter are not among them.

    Scores alone tell no stranger: the votes of K languages sum to 2 - K for any text, so the best
    score is 1/K at least, and texts in an unlearned script score as high as clean ones.
    """

    @F.pandas_udf("boolean")
    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:  # only the texts are sent, and only the answers come back
            texts = b.tolist()
            rows = zip(texts, *model.predict(texts), strict=True)
            yield pd.Series([x != UNKNOWN and s >= least and model.familiar(t, x) for t, x, s in rows], dtype=bool)

    return docs.where(known("text"))


def identify(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of `docs` and the language and its score, under the given names; a column of theirs
    with such a name is replaced.

    Null texts and texts without a letter, empty ones included, are `und` with score 0, as is every
    text where no language was learnt.  Equal scores go to the first language by code point.
    """
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c not in (lang, score)])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = model.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*b.schema.names, lang, score])

    return kept.mapInArrow(predict, T.StructType([*kept.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]))
