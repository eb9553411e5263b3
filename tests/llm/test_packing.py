import random
import zlib

import numpy as np
import pytest
from helpers import ODD, documents

from loanlens.llm import packing
from loanlens.llm.queries import tokenizer_path


def plain_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, docs, size):
    bins, pieces = {}, []
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.append((r.doc_id, r.piece, r.start, r.length, r.ids_crc32))
    for own in bins.values():
        end = 0
        for at, n in sorted(own):
            assert at == end
            end += n
        assert end <= size
    want = []
    for i, text in docs:
        ids = plain_ids(text)
        for k in range(0, len(ids), size):
            cut = ids[k : k + size]
            want.append((i, k // size, k, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    assert sorted(pieces, key=str) == sorted(want, key=str)
    return len(bins), sum(p[3] for p in pieces)


def test_tokenizers_with_other_rules():
    from tokenizers import Tokenizer

    texts = ["Two Words,  don't\n12 ", "", "Größe <|endoftext|> x", "ab" * 40]
    for name, looked_up in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = tokenizer_path(name)
        own = Tokenizer.from_file(path)
        want = [[*own.encode(t, add_special_tokens=False).ids, 0] for t in texts]
        assert [np.frombuffer(b, "<u4").tolist() for b in packing.token_bytes(texts, path)] == want
        assert (packing._tokenizer(path)[1] is not None) == looked_up


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack_documents(docs, tokenizer_path()).collect()
    n, tokens = check(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert n <= 1.02 * tokens / 2048 + 1


def test_groups_exchange_what_they_waste(spark):
    rng = random.Random(1)
    lengths = [rng.randint(200, 1199) for _ in range(3000)]
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id long, length long")
    rows = packing.pack(pieces, 2048, rounds=0, group_rows=150).collect()
    better = packing.pack(pieces, 2048, rounds=6, group_rows=150).collect()
    a, b = len({r.sequence_id for r in rows}), len({r.sequence_id for r in better})
    assert packing.lower_bound(np.array(lengths), 2048) <= b < a
    assert sorted(r.id for r in better) == list(range(3000))


def test_odd_rows(spark):
    docs = [*ODD, (11, "it's\x1cA\x85b\u2003C 'S <|endoftext|> é\u0301 İ")]
    check(packing.pack_documents(documents(spark, docs), tokenizer_path(), 128).collect(), docs, 128)
    assert packing.pack_documents(documents(spark, []), tokenizer_path()).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_bounds_hold(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 30, rng.integers(1, 9))
    size = 30
    fewest = len(lengths)

    def place(k, rooms):
        nonlocal fewest
        if len(rooms) >= fewest:
            return
        if k == len(lengths):
            fewest = len(rooms)
            return
        for i, room in enumerate(rooms):
            if room >= lengths[k]:
                place(k + 1, [*rooms[:i], room - lengths[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, size - lengths[k]])

    place(0, [])
    bins, offsets = packing.best_fit(lengths, size)
    assert packing.lower_bound(lengths, size) <= fewest <= bins.max() + 1
    for b in set(bins.tolist()):
        order = np.argsort(offsets[bins == b])
        n = lengths[bins == b][order]
        assert (offsets[bins == b][order] == np.cumsum(n) - n).all() and n.sum() <= size


def test_plain_texts_are_cut_at_once_like_one_by_one():
    rng = random.Random(4)
    pieces = ["'", "''", "'s", "'re", "'ll", "'ve", "don't", "rest", "s", "re", "l", "v", "e", "m", "d", "t", "7", "42", "É", "ñu", "Ø", " ", "\n", "\t", "-", "!", "a", "Z"]
    texts = ["", "'", "'s", "x'", "it's's 're-'rest ''s 9's", *["".join(rng.choices(pieces, k=rng.randint(1, 30))) for _ in range(3000)]]
    assert all(packing.PLAIN.fullmatch(t) for t in texts)
    parts, sizes = packing.plain_parts(texts)
    want = [packing.PART.findall(t.lower()) for t in texts]
    assert parts.to_pylist() == [p for w in want for p in w] and sizes.tolist() == [len(w) for w in want]
    assert packing.plain_parts([])[0].to_pylist() == [] and packing.plain_parts(["", " "])[1].tolist() == [0, 0]
