"""Grouping of spelling variants by blocked Gram matrices of letter counts.

A word is the vector of how often it holds each letter.  One edit moves that vector by a squared
distance of 1 (a letter more or less) or 2 (one letter for another), so words further apart are never
near, and a product of two blocks of vectors gives all their distances at once.  Words that may be
near are looked for in cells: letters are dealt into groups, and a cell is the count of letters of
each group, so its sum is the length.  An edit leads into the same cell or one that differs by one in
at most two groups.  Pairs within distance 2 are verified letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import partitions, stage, with_id

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
MOST = 62  # letters of a group that are told apart; more are one cell, which loses no pair
BITS = 6
BLOCK = 2048  # words of a cell that meet others in a task; larger cells are cut into blocks
BLOCK_LETTERS = 1 << 19
SHORT = 64  # longer words are verified one by one
HELD = 400_000  # words a task counts before it passes them on
PIECE = 1 << 22  # characters of a text that are cut into words at once
GROUPS = range(3, 11)
ROW_COST = 400  # a row that is dealt costs as much as so many distances

_LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}
_CODE = np.full(256, 0, np.int64)
_CODE[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))


def runs(text: str, least: int) -> Iterator[list[str]]:
    """The maximal runs of letters of a whole text, of `least` letters or more, A-Z in lower case."""
    # a run is matched whole, so the shorter ones can be left out here
    find = re.compile("[a-zÀ-ÿ]{%d,}" % least).findall
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and _is_letter(text[end - 1]) and _is_letter(text[end]):
            end += 1
        yield find(text[at:end].translate(_LOWER))
        at = end


def _is_letter(c: str) -> bool:
    return "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ"


def word_counts(docs: DataFrame, least_length: int = 5, least_count: int = 3, damage: int = 97) -> DataFrame:
    """id, word, n of the words of all texts; ids count up in code-point order.

    A run loses its letter h % length where `damage` divides h, the crc32 of `doc_id:run`.  Words are
    counted in the tasks before they are shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                if not text:
                    continue
                head = zlib.crc32(f"{doc or ''}:".encode())
                for found in runs(text, least_length):
                    for word, n in Counter(found).items():
                        h = zlib.crc32(word.encode(), head)
                        if h % damage == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1 :]
                            if len(word) < least_length:
                                continue
                        total[word] += n
                    if len(total) > HELD:
                        yield _counted(total)
                        total.clear()
        if total:
            yield _counted(total)

    found = with_id(docs, "doc_id", "text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    found = stage(found)
    ranges = found.repartitionByRange(partitions(docs.sparkSession), "word").sortWithinPartitions("word")
    return stage(ranges.select(F.monotonically_increasing_id().alias("id"), "word", "n"))


def _counted(total: Counter) -> pd.DataFrame:
    return pd.DataFrame({"word": list(total.keys()), "n": list(total.values())}, columns=["word", "n"]).astype({"n": "int64"})


def letter_counts(words: list[str]) -> np.ndarray:
    """One row per word, one column per letter."""
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(row * len(LETTERS) + _CODE[flat], minlength=len(words) * len(LETTERS)).reshape(-1, len(LETTERS))


def deal_letters(mass: np.ndarray, groups: int) -> np.ndarray:
    """The group of each letter: the most frequent letter left joins the lightest group."""
    of, load = np.zeros(len(mass), np.int64), np.zeros(groups)
    for letter in np.argsort(-mass, kind="stable"):
        g = int(load.argmin())
        of[letter], load[g] = g, load[g] + mass[letter]
    return of


def cells(words: list[str], of: np.ndarray) -> np.ndarray:
    """One row per word, one column per group of letters."""
    member = np.zeros((len(LETTERS), int(of.max()) + 1), np.int64)
    member[np.arange(len(LETTERS)), of] = 1
    return np.minimum(letter_counts(words) @ member, MOST)


def cell_key(cell: np.ndarray) -> np.ndarray:
    return cell @ (np.int64(1) << (BITS * np.arange(cell.shape[1], dtype=np.int64)))


def visits(cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and keys of the cells they visit: of two cells that near words may hold, one visits the other.

    One letter more in a group, or a letter of a later group in place of one of an earlier.
    """
    key, groups = cell_key(cell), cell.shape[1]
    for g in range(groups):
        rows = np.flatnonzero(cell[:, g] < MOST)
        yield rows, key[rows] + (1 << (BITS * g))
    for g, h in combinations(range(groups), 2):
        rows = np.flatnonzero((cell[:, g] > 0) & (cell[:, h] < MOST))
        yield rows, key[rows] - (1 << (BITS * g)) + (1 << (BITS * h))


def make_groups(words: DataFrame) -> np.ndarray:
    """Deal the letters into as many groups as cost least: rows dealt and distances taken, over all words."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mass = np.zeros(len(LETTERS), np.int64)
        for b in batches:
            mass += letter_counts(b["word"].tolist()).sum(axis=0)
        yield pd.DataFrame({"letter": np.arange(len(LETTERS)), "n": mass})

    mass = np.zeros(len(LETTERS))
    for r in words.select("word").mapInPandas(add, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect():
        mass[r.letter] = r.n
    choices = [deal_letters(mass, g) for g in GROUPS]

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held = b["word"].tolist()
            for of in choices:
                key, n = np.unique(cell_key(cells(held, of)), return_counts=True)
                yield pd.DataFrame({"g": int(of.max()) + 1, "key": key, "n": n})

    sums = words.select("word").mapInPandas(tally, "g int, key long, n long").groupBy("g", "key").agg(F.sum("n").alias("n"))
    cost = {}
    for r in sums.groupBy("g").agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares")).collect():
        cost[r.g] = (1 + r.g + r.g * (r.g - 1) / 2) * (ROW_COST * r.n + r.squares)
    return min(choices, key=lambda of: cost.get(int(of.max()) + 1, 0))


def near_words(words: DataFrame) -> DataFrame:
    """id, n_near, form_n, form_id: how many near words each word has, and the most frequent of them.

    Only words with a near word are returned.  A cell is cut into blocks where it holds over BLOCK
    words or BLOCK_LETTERS letters; each pair of blocks meets in a task of its own, and visitors pass
    by each block, so a task holds two blocks at most and no pair is lost.
    """
    of = make_groups(words)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell = cells(b["word"].tolist(), of) if len(b) else np.zeros((0, len(GROUPS)), np.int64)
            yield b.assign(cell=cell_key(cell), kind=0)
            for rows, key in visits(cell):
                if len(rows):
                    yield b.iloc[rows].assign(cell=key, kind=1)

    given = words.select("id", "n", "word")
    entries = given.mapInPandas(spread, "id long, n long, word string, cell long, kind int")
    home = given.mapInPandas(lambda batches: (b[["id", "word"]].assign(cell=cell_key(cells(b["word"].tolist(), of))) for b in batches if len(b)),
                             "id long, word string, cell long")
    size = home.groupBy("cell").agg(F.count("*").alias("rows"), F.sum(F.length("word")).alias("letters"))
    cuts = F.greatest(F.ceil(F.col("rows") / BLOCK), F.ceil(F.col("letters") / BLOCK_LETTERS)).cast("int")
    # cells without words of their own have no one to visit
    size = stage(size.select("cell", cuts.alias("cuts")))
    # home rows of block o: kind 0 in (o, y) for y >= o, kind 1 in (x, o) for x < o; visitors: kind 1 in (x, x)
    own = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")
    place = F.when(F.col("kind") == 0, F.transform(
        F.sequence(F.lit(0), F.col("cuts") - 1),
        lambda i: F.struct(F.least(i, own).alias("x"), F.greatest(i, own).alias("y"), (i < own).cast("int").alias("kind")),
    )).otherwise(F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda i: F.struct(i.alias("x"), i.alias("y"), F.lit(1).alias("kind"))))
    dealt = (
        entries.join(size, "cell").select("cell", "id", "n", "word", F.explode(place).alias("p"))
        .select("cell", "p.x", "p.y", "p.kind", "id", "n", "word")
        .repartition("cell", "x", "y").sortWithinPartitions("cell", "x", "y", "kind")
    )
    partial = dealt.mapInPandas(_meet, "id long, n_near long, form_n long, form_id long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form_id"))
    return (partial.groupBy("id").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
            .select("id", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form_id").alias("form_id")))


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by block, the words that stay first; those that pass by are compared as they come."""
    at, stay = None, []
    for b in batches:
        if not len(b):
            continue
        place = b[["cell", "x", "y"]].to_numpy()
        kind, ids, ns = (b[c].to_numpy() for c in ("kind", "id", "n"))
        word = b["word"].tolist()
        starts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(axis=1) | (kind[1:] != kind[:-1])])
        for a, z in zip(starts, [*starts[1:], len(b)], strict=True):
            now = (ids[a:z], ns[a:z], word[a:z])
            if at != tuple(place[a]):
                at, stay = tuple(place[a]), []
            if kind[a] == 0:
                # of block pairs only the second block's words are new to the first; a block meets itself once
                if at[1] == at[2]:
                    for held in stay:
                        yield from _pairs(held, now)
                    yield from _pairs(now, now, same=True)
                stay.append(now)
            else:
                for held in stay:
                    yield from _pairs(held, now)


def _pairs(held: tuple, passing: tuple, same: bool = False) -> Iterator[pd.DataFrame]:
    """For each word of two lists that has a near word in the other: how many, and the most frequent."""
    x, found = letter_counts(held[2]), []
    step = max(1, (1 << 22) // len(x))
    exact = np.float32 if max(map(len, held[2])) <= 4096 and max(map(len, passing[2])) <= 4096 else np.float64
    xs, x2 = x.astype(exact), (x * x).sum(axis=1)
    for k in range(0, len(passing[2]), step):
        y = letter_counts(passing[2][k : k + step])
        apart = (x2[:, None] + (y * y).sum(axis=1)[None, :]).astype(exact) - 2 * (xs @ y.astype(exact).T)
        i, j = np.nonzero(apart <= 2)
        if same:
            i, j = i[i < j + k], j[i < j + k]
        if len(i):
            near = one_edit(held[2], passing[2], i, j + k)
            found.append((i[near], j[near] + k))
    if not found:
        return
    i, j = (np.concatenate(c) for c in zip(*found, strict=True))
    if not len(i):
        return
    whose = np.concatenate([held[0][i], passing[0][j]])
    other = np.concatenate([passing[0][j], held[0][i]])
    other_n = np.concatenate([passing[1][j], held[1][i]])
    order = np.lexsort((other, -other_n, whose))
    ids, first, n = np.unique(whose[order], return_index=True, return_counts=True)
    yield pd.DataFrame({"id": ids, "n_near": n, "form_n": other_n[order][first], "form_id": other[order][first]})


def one_edit(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether a[i] and b[j] differ by exactly one inserted, deleted or replaced letter, pair by pair."""
    na, nb = np.array([len(w) for w in a]), np.array([len(w) for w in b])
    out = np.zeros(len(i), bool)
    short = (na[i] <= SHORT) & (nb[j] <= SHORT)
    for k in np.flatnonzero(~short):
        out[k] = differ_by_one(a[i[k]], b[j[k]])
    rows = np.flatnonzero(short & (np.abs(na[i] - nb[j]) <= 1))
    if not len(rows):
        return out
    wide = SHORT + 1
    ma, mb = (np.array([w.encode("latin-1") if len(w) <= SHORT else b"" for w in words], f"S{wide}").view(np.uint8).reshape(-1, wide) for words in (a, b))
    for k in range(0, len(rows), 1 << 16):
        r = rows[k : k + (1 << 16)]
        u, v = ma[i[r]], mb[j[r]]
        swap = na[i[r]] > nb[j[r]]
        u[swap], v[swap] = v[swap], u[swap]  # u is the shorter one
        differs = u != v
        first = differs.argmax(axis=1)  # the first letter that differs, the end included
        moved = (u[:, :-1] != v[:, 1:]) & (np.arange(wide - 1)[None, :] >= first[:, None])
        equal = na[i[r]] == nb[j[r]]
        out[r] = np.where(equal, differs.sum(axis=1) == 1, ~moved.any(axis=1))
    return out


def differ_by_one(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]


def variant_forms(docs: DataFrame, least_length: int = 5, least_count: int = 3, damage: int = 97, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of `docs` (doc_id, text).

    Two words are near if they differ by one inserted, deleted or replaced code point.  A word's form is
    its near word with the largest n (ties: the smallest in code-point order) if that n is `ratio` (2 at
    least) times its own or more; root is where forms lead to.  Null and empty texts have no words;
    a null id counts as an empty one, repeated rows count one by one, other columns are not looked at;
    no words give no rows.
    """
    if ratio < 2:
        raise ValueError("forms must grow, or they may lead in circles")
    words = word_counts(docs, least_length, least_count, damage)
    near = stage(near_words(words))
    told = stage(words.join(near, "id", "left").withColumn("known", _known(ratio)))
    ups = told.where("known").select("id", F.col("form_id").alias("root_id"))
    roots = _follow(ups)
    names = words.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    forms = words.select(F.col("id").alias("form_id"), F.col("word").alias("form"))
    found = (told.where("known").join(roots, "id").join(names, "root_id").join(forms, "form_id")
             .select("word", "form", "root", "n", "n_near", "form_n"))
    alone = told.where(~F.col("known")).select(
        "word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"))
    return found.unionByName(alone)


def _known(ratio: int) -> Column:
    return F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False))


def _follow(ups: DataFrame) -> DataFrame:
    """id, root_id where each id's way up ends.  Every round doubles the steps taken, and n doubles with
    every step, so there are few rounds."""
    now = stage(ups)
    while True:
        further = now.select(F.col("id").alias("root_id"), F.col("root_id").alias("next"))
        step = stage(now.join(further, "root_id", "left").select("id", F.coalesce("next", "root_id").alias("root_id"), F.col("next").isNotNull().alias("moved")))
        if not step.where("moved").head(1):
            return step.select("id", "root_id")
        now = step.select("id", "root_id")
