"""A quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A text is its words and the runs of one to three of its words' shapes, hashed.  A shape keeps a word's
marks and replaces its letters by their case and its digits by a zero, so that rare words say something
too.  Each update moves the weights of one row's n-grams to the minimum of all gradients so far plus the
regularisers (FTRL-proximal), which leaves a weight at zero until its gradients outweigh the first one.
A text's score is one sparse dot product.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import stage, with_id

BITS = 18  # words take the lower half of the hashed places, shapes the upper one; the place after them is the constant
SIZE = (1 << BITS) + 1
PIECE = 1 << 22  # characters that are cut into words at once
HELD = 200_000  # words whose hashes a task keeps
PARTS = re.compile(r"[^\W\d_]+|\d+|(.)\1*", re.DOTALL)


def shape(word: str) -> str:
    """`Ab12!!!!` is `Aa0!!!`: letters by case, digits as one zero, marks as they are, three of a kind at most."""
    out = []
    for m in PARTS.finditer(word):
        part = m[0]
        if part[0].isdigit():
            out.append("0")
        elif not part[0].isalpha():
            out.append(part[:3])
        elif len(part) > 1 and part.isupper():
            out.append("AA")
        else:
            out.append("Aa" if part[0].isupper() else "a")
    return "".join(out)


class Hashes(dict):
    """A word's own hash and that of its shape, in one number."""

    def __missing__(self, word: str) -> int:
        if len(self) > HELD:
            self.clear()
        own = zlib.crc32(word.lower().encode("utf-8", "surrogatepass"))
        found = self[word] = own << 32 | zlib.crc32(shape(word).encode("utf-8", "surrogatepass"))
        return found


def _words(text: str) -> Iterator[list[str]]:
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not text[end - 1].isspace():
            end += 1
        yield text[at:end].split()
        at = end


def features(text: str | None, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a whole text.  Either half's squares add up to 1, if it has any; the constant is last."""
    found = [np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)) for words in _words(text or "")]
    both = np.concatenate(found) if found else np.zeros(0, np.uint64)
    own, kind = (both >> np.uint64(32)).astype(np.uint32), both.astype(np.uint32)
    runs, last = [kind], kind
    for n in (2, 3):
        last = last[:-1] * np.uint32(0x01000193) + kind[n - 1 :] if len(kind) >= n else last[:0]
        runs.append(last + np.uint32(n))
    places, values = [], []
    for half, grams in enumerate((own, np.concatenate(runs))):
        place, count = np.unique((grams * np.uint32(0x9E3779B1)) >> np.uint32(33 - BITS), return_counts=True)
        places.append(place.astype(np.int32) + half * (1 << (BITS - 1)))
        values.append(np.sqrt(count / max(1, len(grams))).astype(np.float32))
    return np.concatenate([*places, [SIZE - 1]]).astype(np.int32), np.concatenate([*values, [1]]).astype(np.float32)


@dataclass
class Leader:
    """FTRL-proximal: z holds the gradients less what the weights have moved for them, n their squares."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.2
    l2: float = 0.1

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros(SIZE), np.zeros(SIZE)

    def weights(self, places: np.ndarray | slice) -> np.ndarray:
        z = self.z[places]
        short = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -short / ((self.beta + np.sqrt(self.n[places])) / self.alpha + self.l2)

    def update(self, places: np.ndarray, values: np.ndarray, label: int, weight: float) -> None:
        w = self.weights(places)
        g = weight * (sigmoid(float(w @ values)) - label) * values
        n = self.n[places]
        self.z[places] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[places] = n + g * g


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-x))) if x >= 0 else float(np.exp(x) / (1 + np.exp(x)))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = 12_000, epochs: int = 4, **options: float) -> np.ndarray:
    """The weights, learnt from documents that are not held out and whose label in `labels` (doc_id, quality) is 0 or 1.

    The fit uses at most about `sample` rows, half of either label (all, if fewer), chosen by a hash of
    the id; a row weighs as much as it takes to keep the labels' shares.  Ids with contradicting labels
    are left out, of documents that repeat an id one text is taken.  Without labels all weights are 0.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")) & F.col("quality").isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"), F.max("quality").alias("most"))
        .where("label = most").select("doc_id", "label")
    )
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts:
        return np.zeros(SIZE)
    share = {label: min(1.0, sample / 2 / n) for label, n in counts.items()}
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(12)), 11) / float(1 << 53)
    chosen = known.where(unit < F.element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), F.col("label")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for b in batches:
            found = [features(t, hashes) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "places": [p.tobytes() for p, _ in found], "values": [v.tobytes() for _, v in found]})

    # about `sample` rows of two numbers are sent to the texts
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    one = F.min(F.struct("places", "values")).alias("x")
    rows = stage(texts.mapInPandas(read, "doc_id long, label int, places binary, values binary").groupBy("doc_id", "label").agg(one)
                 .select("doc_id", "label", "x.places", "x.values"))
    weight = {label: 1 / share[label] for label in counts}
    scale = sum(counts.values()) / sum(n * share[label] for label, n in counts.items())

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(zlib.crc32(str(i).encode()), i, label, np.frombuffer(p, np.int32), np.frombuffer(v, np.float32))
                for b in batches for i, label, p, v in zip(b["doc_id"], b["label"], b["places"], b["values"], strict=True)]
        held.sort(key=lambda r: r[:2])
        leader = Leader(**options)
        for _ in range(epochs):
            for _, _, label, places, values in held:
                leader.update(places, values, label, weight[label] / scale)
        w = leader.weights(slice(None))
        at = np.flatnonzero(w)
        yield pd.DataFrame({"place": at, "weight": w[at]})

    out = np.zeros(SIZE)
    # one task: the sample is bounded
    for r in rows.coalesce(1).mapInPandas(fit, "place long, weight double").collect():
        out[r.place] = r.weight
    return out


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null and empty texts are scored by the constant alone; null ids are kept and count as not held out;
    repeated rows are returned each, no rows give none; only doc_id and text are looked at.
    """
    weights = weights.astype(np.float64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for b in batches:
            out = []
            for text in b["text"]:
                places, values = features(text, hashes)
                out.append(sigmoid(float(weights[places] @ values)))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": np.array(out, float)})

    found = with_id(docs, "doc_id", "text").mapInPandas(run, "doc_id string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
