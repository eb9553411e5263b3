"""Best-fit packing with certified bin counts.

Documents become token pieces; a full piece is a sequence of its own.  The others are dealt at
random into partitions of bounded size and packed there by best-fit decreasing.  Dual feasible
functions give each partition a number of bins that no packing of its pieces can go below.  Where
a partition uses more, its worst filled bins are opened, their pieces exchanged with those of the
other such partitions, and best-fit decreasing runs again; a round counts only if it saves a bin.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import stage, with_id

GROUP_ROWS = 20_000  # pieces that are packed together
CACHED = 100_000  # parts of words whose tokens a worker keeps, in each of two generations
BATCH_CHARS = 1 << 20
TOKENS = "doc_id string, piece int, start long, length long, ids_crc32 long"


class Kept:
    """Tokens of parts of words, in two generations: when the younger is full it becomes the older, and
    what was not asked for since then is forgotten."""

    def __init__(self, encode: Callable[[list[str]], dict[str, bytes]]):
        self.encode = encode
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def tokens(self, parts: list[str]) -> list[bytes]:
        """The tokens of different parts; those not kept are encoded."""
        if len(self.young) > CACHED:
            self.young, self.old = {}, self.young
        found = list(map(self.young.get, parts))
        asked = [p for p, f in zip(parts, found, strict=True) if f is None]
        if not asked:
            return found
        new = {p: self.old[p] for p in asked if p in self.old}
        new |= self.encode([p for p in asked if p not in new])
        self.young.update(new)
        return [new[p] if f is None else f for p, f in zip(parts, found, strict=True)]


def _tokenizer(path: str):
    """The tokenizer, and the tokens of parts met before, once per worker.

    They are kept on the library's module, as this one is shipped anew with every task.
    """
    import tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    held = tokenizers.__dict__.setdefault("_loanlens_held", {})
    if path not in held:
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        known = [rules[k] for k in ("normalizer", "pre_tokenizer")] == [NORMALIZER, CUTTER] and all(t["content"].startswith("<|") for t in rules["added_tokens"])
        del rules
        parts = PartTokenizer(path) if known else None
        held[path] = (None, Kept(parts)) if known and len(parts.border) == 1 else (tokenizers.Tokenizer.from_file(path), None)
    return held[path]


def token_bytes(texts: list[str], path: str, end: int = 0) -> list[bytes]:
    """Each text's ids as little-endian 32-bit numbers, `end` last.

    A tokenizer with the rules NORMALIZER and CUTTER cuts a text into parts that it encodes one by
    one, so a text's ids are those of its parts, one after the other, and parts met before are looked
    up.  Any other tokenizer encodes whole texts.
    """
    tokenizer, kept = _tokenizer(path)
    last = int(end).to_bytes(4, "little")
    if kept is None:
        return [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() + last for t in texts]
    plain = [PLAIN.fullmatch(t) is not None and "<|" not in t for t in texts]
    order = sorted(range(len(texts)), key=lambda i: not plain[i])  # the plain texts, then the others
    parts, sizes = plain_parts([texts[i] for i in order if plain[i]])
    others = [_parts(texts[i]) for i in order if not plain[i]]
    if others:
        parts = pa.concat_arrays([parts, pa.array(chain.from_iterable(others), pa.large_string())])
        sizes = np.concatenate([sizes, [len(o) for o in others]])
    coded = parts.dictionary_encode()
    part = coded.indices.to_numpy()
    tokens = kept.tokens(coded.dictionary.to_pylist())
    # every part's ids stand in `ids` from `first` on; `at` lists where those of all texts are found
    ids = np.frombuffer(b"".join(tokens), "<u4")
    count = np.fromiter(map(len, tokens), np.int64, len(tokens)) // 4
    first, n = np.cumsum(count) - count, count[part]
    ends = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(first[part] - ends[:-1], n) + np.arange(ends[-1])
    found = ids[at].tobytes()
    edges = (4 * ends[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]).tolist()
    out = [b""] * len(texts)
    for i, (a, b) in zip(order, pairwise(edges), strict=True):
        out[i] = found[a:b] + last
    return out


def plain_parts(texts: list[str]) -> tuple[pa.LargeStringArray, np.ndarray]:
    """What PART finds in plain texts in lower case, one after the other, and each text's number of parts.

    All texts are cut at once: a part starts where the kind of character changes, at every digit, and
    after an apostrophe with its ending.  Beyond ASCII, plain texts have letters only.
    """
    raw = [t.lower().encode() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b"\n\n"]), np.uint8)
    kind = KIND[data]
    starts = (kind != np.concatenate([[0], kind[:-1]])) & (kind != SPACE)
    starts |= kind == DIGIT
    marks = np.flatnonzero((data == ord("'")) & starts)
    one, two = data[marks + 1], data[marks + 1].astype(np.int64) << 8 | data[marks + 2]
    size = np.where(np.isin(one, ENDINGS[0]), 1, np.where(np.isin(two, ENDINGS[1]), 2, 0))
    marks, size = marks[size > 0], size[size > 0]
    starts[marks + 1] = False
    after = marks + 1 + size
    starts[after[kind[after] == LETTER]] = True
    kept = kind != SPACE
    body, first = data[kept], np.flatnonzero(starts[kept])
    offsets = np.append(first, len(body)).astype(np.int64)
    parts = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(body))
    ends = np.cumsum([0, *[len(r) + 1 for r in raw]])
    return parts, np.diff(np.searchsorted(np.flatnonzero(starts), ends))


def _parts(text: str) -> list[str]:
    """Of texts that are not plain the words between white space, which the tokenizer drops; those of
    plain characters are cut into parts in lower case, others are left as they are."""
    out = []
    for word in WORD.findall(text):
        if PLAIN.fullmatch(word) and "<|" not in word:  # which may be a special token
            out += PART.findall(word.lower())
        else:
            out.append(word)
    return out


class PartTokenizer:
    """Encodes many parts in one call.  Parts in lower case need no normaliser, and white space cuts them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path, self.whole, self.lean = path, None, Tokenizer.from_file(path)
        self.lean.normalizer = normalizers.Sequence([])
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.border = self.lean.encode(BORDER, add_special_tokens=False).ids

    def other(self, part: str) -> list[int]:
        """The ids of a part that needs all the rules; the tokenizer is loaded when one is met."""
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return self.whole.encode(part, add_special_tokens=False).ids

    def __call__(self, parts: list[str]) -> dict[str, bytes]:
        out, many = {}, []
        for p in parts:
            if p == BORDER:
                out[p] = np.array(self.border, "<u4").tobytes()
            elif PART.fullmatch(p):
                many.append(p)
            else:
                out[p] = np.array(self.other(p), "<u4").tobytes()
        for k in range(0, len(many), 512):
            block = many[k : k + 512]
            ids = np.array(self.lean.encode_batch_fast([f" {BORDER} ".join(block)], add_special_tokens=False)[0].ids, "<u4")
            raw, ends = ids.tobytes(), (4 * np.flatnonzero(ids == self.border[0])).tolist()
            out.update(zip(block, [raw[a + 4 : b] for a, b in pairwise([-4, *ends, len(raw)])], strict=True))
        return out


BORDER = "0"  # a part of one token that stands between others; no other part holds this character
# The rules of a tokenizer file by which its words can be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUTTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
# Characters that nothing but lower case changes before a text is cut into parts.
PLAIN = re.compile("[\x20-\x7e\x09-\x0dÀ-ÖØ-öø-įı-ſ]*")
# Fixed value: the parts of a plain text in lower case.
PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-įı-ſ]+|[0-9]|[!-/:-@\[-`{-~]+")
WORD = re.compile(r"[^\x20\x09-\x0d]+")
SPACE, DIGIT, SIGN, LETTER = range(4)
KIND = np.array([SPACE if b in b" \t\n\x0b\x0c\r" else DIGIT if chr(b) in "0123456789" else LETTER if b > 127 or chr(b).isalpha() else SIGN for b in range(256)], np.uint8)
# Fixed value: the endings after an apostrophe, of one letter and of two.
ENDINGS = [ord(c) for c in "stmd"], [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")]


def cut_pieces(docs: DataFrame, tokenizer: str, size: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document; null texts are empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, texts, held = [], [], 0
            pairs = list(zip(b["doc_id"], b["text"], strict=True))
            for k, (_, text) in enumerate(pairs):
                texts.append(text or "")
                held += len(texts[-1])
                if held < BATCH_CHARS and k + 1 < len(pairs):
                    continue
                for (doc, _), ids in zip(pairs[k + 1 - len(texts) : k + 1], token_bytes(texts, tokenizer), strict=True):
                    for piece, at in enumerate(range(0, len(ids), 4 * size)):
                        cut = ids[at : at + 4 * size]
                        rows.append((doc, piece, at // 4, len(cut) // 4, zlib.crc32(cut)))
                texts, held = [], 0
            names = [f.split()[0] for f in TOKENS.split(", ")]
            yield pd.DataFrame(rows, columns=names)

    return with_id(docs, "doc_id", "text").mapInPandas(run, TOKENS).withColumn("doc_id", F.col("doc_id").cast("long"))


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin of each length, and its offset there."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(size + 1)]  # bins by the room they have left
    levels, opened = 0, 0  # levels: a bit for every room that some bin has
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = levels >> n
        if fits:
            left = n + ((fits & -fits).bit_length() - 1)
            b = room[left].pop()
            if not room[left]:
                levels &= ~(1 << left)
        else:
            left, b, opened = size, opened, opened + 1
        bins[i], offsets[i] = b, size - left
        if left > n:
            room[left - n].append(b)
            levels |= 1 << (left - n)
    return bins, offsets


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """The most bins that a dual feasible function proves to be needed.

    Such a function maps lengths so that what fits into one bin never sums to more than one.  Tried
    are the identity, the family that for a threshold k drops lengths up to k and rounds those over
    size - k up to a whole bin, and the one that rounds multiples of size / (k + 1) down.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    values = np.arange(size + 1, dtype=np.int64)
    best = -(-int((count * values).sum()) // size)
    mass, rows = np.cumsum(count * values), np.cumsum(count)
    k = np.arange(0, size // 2 + 1)
    large = rows[size] - rows[size - k]  # longer than size - k
    middle = mass[size - k] - np.where(k > 0, mass[np.maximum(k - 1, 0)], 0)
    best = max(best, int((large + -(-middle // size)).max()))
    for k in range(1, 40):
        scaled = (k + 1) * values
        u = np.where(scaled % size == 0, values * k, (scaled // size) * size)  # in units of 1 / (k * size)
        best = max(best, -(-int((count * u).sum()) // (k * size)))
    return best


def pack(pieces: DataFrame, size: int, rounds: int = 4, group_rows: int = GROUP_ROWS) -> DataFrame:
    """`pieces` (with a column length of at most `size`) and sequence_id, offset: bins without gaps.

    Every row is placed, repeated ones each by itself.  sequence_id has no meaning but equality.
    """
    spark = pieces.sparkSession
    rows = stage(pieces.withColumn("row", F.monotonically_increasing_id()))
    loose = rows.where(F.col("length") < size).select("row", "length")
    n = loose.count()
    placed = _pack_groups(loose, max(1, -(-n // group_rows)), size, 0) if n else None
    for turn in range(1, rounds + 1):
        if placed is None:
            break
        # a partition over its bound opens its emptiest bins, four times as many with every round
        is_open = F.col("reach") <= 2.0 * 4 ** (turn - 1)
        free = placed.where(is_open).agg(F.count("*"), F.countDistinct("sequence_id")).first()
        if not free[0]:
            break
        again = _pack_groups(placed.where(is_open).select("row", "length"), max(1, -(-free[0] // group_rows)), size, turn)
        if again.agg(F.countDistinct("sequence_id")).first()[0] < free[1]:
            placed = stage(placed.where(~is_open).union(again))
    full = rows.where(F.col("length") == size).select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    where = full if placed is None else placed.select("row", "sequence_id", "offset").union(full)
    return rows.join(where, "row").drop("row")


def _pack_groups(loose: DataFrame, groups: int, size: int, turn: int) -> DataFrame:
    fields = "row long, length long, sequence_id long, offset long, n_bins long, bound long, reach double"

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["length", "row"], ascending=[False, True]).reset_index(drop=True)
        lengths = b["length"].to_numpy()
        bins, offsets = best_fit(lengths, size)
        opened, bound = int(bins.max()) + 1, lower_bound(lengths, size)
        filled = np.bincount(bins, weights=lengths, minlength=opened).astype(np.int64)
        # how much room is wasted up to a bin, the emptiest first, as a multiple of the surplus bins' room
        order = np.argsort(filled, kind="stable")
        reach = np.full(opened, np.inf)
        if opened > bound:
            waste = (size - filled)[order]
            reach[order] = (np.cumsum(waste) - waste) / (size * (opened - bound))
        first = (turn << 52) | (int(key[0]) << 22)  # a partition holds fewer than 2^22 pieces
        return pd.DataFrame({"row": b["row"], "length": lengths, "sequence_id": first + bins, "offset": offsets,
                             "n_bins": opened, "bound": bound, "reach": reach[bins]})

    dealt = loose.withColumn("part", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(groups)).cast("int"))
    return stage(dealt.groupBy("part").applyInPandas(run, fields))


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, **options) -> DataFrame:
    """Cut and pack `docs` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and an id 0; a null or empty text is the id 0 alone.  Only documents longer
    than `size` are cut.  Null ids are kept, repeated rows packed one by one, other columns ignored;
    no rows give no rows.
    """
    return pack(cut_pieces(docs, tokenizer, size), size, **options)
