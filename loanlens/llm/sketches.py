"""Document fingerprints as invertible Bloom lookup tables.

A text is cut into paragraph pieces, each piece is hashed, and each hash is added to three cells of
a small table: a count, a sum of hashes, a sum of check hashes.  Two versions' tables subtract; what
both hold cancels out, and the rest is recovered by peeling: a cell that holds one hash only gives
it away, and taking it out of its other cells leaves further such cells.  Where peeling gets stuck
the tables are made larger and the comparison is repeated.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import partitions, with_id

CELLS = 24  # of the fingerprint; comparisons that need more make larger tables
ROOM = 2  # cells per hash of both texts in the first larger table, and how much it grows from there
LONG = 240  # characters from which a piece is cut at words

# A piece ends where a line or a clause does, so edits change the pieces they touch and no others.
PIECE = re.compile(r"[^\n]*?(?:[.!?,;:|]\s|\n|\Z)")
WORDS = re.compile(r".*?(?:[aenst]\s+|\Z)", re.DOTALL)


class Pieces:
    """The hashes of a text's pieces; the n-th copy of a piece has a hash of its own."""

    def __init__(self, plain: np.ndarray, ends: np.ndarray):
        self.plain, self.ends = plain, ends  # hashes in text order, and where the pieces end
        order = np.argsort(plain, kind="stable")
        ordered = plain[order]
        first = np.ones(len(ordered), bool)
        first[1:] = ordered[1:] != ordered[:-1]
        at = np.arange(len(ordered))
        copy = np.zeros(len(ordered), np.uint64)
        copy[order] = at - np.maximum.accumulate(np.where(first, at, 0))
        self.hashes = _mix(plain + copy * np.uint64(0xA0761D6478BD642F))
        self.places, self.check = _places(self.hashes), _check(self.hashes)

    def __len__(self) -> int:
        return len(self.plain)


def read(text: str, start: int = 0) -> tuple[list[int], list[int]]:
    """Hashes and ends of the pieces from `start`, where a piece begins."""
    plain, ends, end = [], [], start
    digest = xxhash.xxh64_intdigest
    for p in PIECE.findall(text, start):
        end += len(p)
        for part in WORDS.findall(p) if len(p) > LONG else (p,):
            part = part.strip()
            if part:
                plain.append(digest(part.encode("utf-8", "surrogatepass")))
                ends.append(end)  # parts of a long piece stand or fall together
    return plain, ends


def digests(text: str) -> Pieces:
    plain, ends = read(text)
    return Pieces(np.array(plain, np.uint64), np.array(ends, np.int64))


def digests_of_edit(own: Pieces, text: str, same: int) -> Pieces:
    """The pieces of a text whose first `same` characters are those of `own`: only the others are read anew."""
    kept = int(np.searchsorted(own.ends, same, side="right"))
    start = int(own.ends[kept - 1]) if kept else 0
    plain, ends = read(text, start)
    return Pieces(np.concatenate([own.plain[:kept], np.array(plain, np.uint64)]), np.concatenate([own.ends[:kept], np.array(ends, np.int64)]))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _check(h: np.ndarray) -> np.ndarray:
    return _mix(h + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFF)


def _places(h: np.ndarray) -> np.ndarray:
    """Where each hash goes in each third of a table, as a share of 2^32, which no table outgrows."""
    return np.stack([h & np.uint64(0xFFFFFFFF), h >> np.uint64(32), _mix(h ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)]).astype(np.int64)


def _cells(places: np.ndarray, size: int) -> np.ndarray:
    third = size // 3
    return (places * third >> 32) + np.array([[0], [third], [2 * third]])


class Table:
    def __init__(self, pieces: Pieces, size: int = CELLS):
        at = _cells(pieces.places, size)
        self.size, self.count = size, np.bincount(at.ravel(), minlength=size)
        self.sum, self.check = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        np.add.at(self.sum, at, pieces.hashes[None, :])
        np.add.at(self.check, at, pieces.check[None, :])

    def text(self) -> str:
        parts = (self.count.astype("<u2"), self.sum.astype("<u8"), self.check.astype("<u4"))
        return base64.b64encode(b"".join(p.tobytes() for p in parts)).decode()


def peel(a: Table, b: Table) -> tuple[np.ndarray, np.ndarray] | None:
    """The hashes that only `a` and only `b` hold; None if peeling gets stuck."""
    count, total, check = a.count - b.count, a.sum - b.sum, a.check - b.check
    found = []
    while True:
        one = np.flatnonzero((count == 1) | (count == -1))
        sign = count[one]
        h = np.where(sign == 1, total[one], np.uint64(0) - total[one])
        g = _check(h)
        pure = check[one] == np.where(sign == 1, g, np.uint64(0) - g)
        h, first = np.unique(h[pure], return_index=True)
        if not len(h):
            break
        sign, g = sign[pure][first], g[pure][first]
        found.append((h, sign))
        at, unsigned = _cells(_places(h), a.size), sign.astype(np.uint64)  # -1 is 2^64 - 1, which subtracts
        np.subtract.at(count, at, sign[None, :])
        np.subtract.at(total, at, (h * unsigned)[None, :])
        np.subtract.at(check, at, (g * unsigned)[None, :])
    if count.any() or total.any() or check.any():
        return None
    h, sign = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0))
    return h[sign == 1], h[sign == -1]


def difference(a: Pieces, b: Pieces, tables: tuple[Table, Table] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that only `a` and only `b` hold, by larger tables where the small ones don't suffice."""
    tables, size = tables or (Table(a), Table(b)), CELLS
    while (found := peel(*tables)) is None:
        size = max(ROOM * size, 3 * math.ceil(ROOM * (len(a) + len(b)) / 3))
        tables = (Table(a, size), Table(b, size))
    return found


def likeness(a: Pieces, b: Pieces, tables: tuple[Table, Table] | None = None) -> float:
    """Twice the pieces in common over the pieces of both; 1 for two texts without any."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    only_a, only_b = difference(a, b, tables)
    return 1 - (len(only_a) + len(only_b)) / (len(a) + len(b))


def edited(text: str, after: str) -> str:
    """The last quarter replaced by the first as many characters of `after`, or all of it."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def compare_versions(docs: DataFrame) -> DataFrame:
    """Each document against its edited version and the next document.

    Returns doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, pieces.  The next document is that with the next higher doc_id, after
    the last the first; repeated ids follow each other in the order of their texts, null ids come
    first.  Null texts are empty; a single document is its own next.  Other columns are ignored.

    Documents are cut into ranges of doc_id, one task each, that read their rows in order; a copy
    of each range's first document goes to the range before.
    """
    n = partitions(docs.sparkSession)
    rows = with_id(docs, "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("ord", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    borders = [int(x) for x in rows.where("doc_id is not null").approxQuantile("ord", [k / n for k in range(1, n)], 0.1 / n)] if n > 1 else []
    borders = sorted(set(borders))
    array = F.array(*[F.lit(x).cast("long") for x in borders])
    part = F.size(F.filter(array, lambda x: x <= F.col("ord"))) if borders else F.lit(0)
    rows = rows.withColumn("part", part)
    firsts = sorted((r.part, r.ord) for r in rows.groupBy("part").agg(F.min("ord").alias("ord")).collect())
    before = {o: firsts[k - 1][0] for k, (_, o) in enumerate(firsts)}  # range before the one that starts with o
    ahead = F.lit(None).cast("int")
    if before:
        table = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        ahead = F.element_at(table, F.col("ord"))
    places = F.array(F.struct(F.col("part").alias("to"), F.lit(0).alias("ahead")),
                     F.struct(ahead.cast("int").alias("to"), F.lit(1).alias("ahead")))
    dealt = (
        rows.select("doc_id", "ord", "text", F.explode(F.filter(places, lambda p: p["to"].isNotNull())).alias("p"))
        .select("p.to", "p.ahead", "ord", "doc_id", "text")
        .repartitionById(n, F.col("to")).sortWithinPartitions("to", "ahead", "ord", "text")
    )
    done = dealt.mapInPandas(_follow, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                      "near_edited double, near_next double, pieces long")
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))


def _follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "pieces"]
    last, done = None, False
    for b in batches:
        out = []
        for ahead, doc, text in zip(b["ahead"], b["doc_id"], b["text"], strict=True):
            if done:
                break
            own = digests(text)
            now = (doc, text, own, Table(own))
            if last is not None:
                out.append(_row(*last, *now[1:]))
            last, done = now, bool(ahead)
        if out:
            yield pd.DataFrame(out, columns=names)


def _row(doc, text: str, own: Pieces, table: Table, after: str, after_own: Pieces, after_table: Table) -> tuple:
    other = edited(text, after)
    new = digests_of_edit(own, other, len(text) - len(text) // 4)
    changed = Table(new)
    return (doc, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), table.text(), changed.text(),
            likeness(own, new, (table, changed)), likeness(own, after_own, (table, after_table)), len(own))
