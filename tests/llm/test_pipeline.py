"""The pipeline against the same decisions made one document at a time."""

import zlib
from collections import defaultdict

import numpy as np
import xxhash
from helpers import ODD, documents
from test_mixing import plain_targets
from test_packing import plain_ids
from test_simhash import plain_components, plain_fingerprint

import corpus_pipeline
from loanlens.llm import langid, pii


def mix_key(doc_id, text):
    h = xxhash.xxh64_intdigest((11).to_bytes(4, "little"), 42)
    for part in (str(doc_id).encode(), text.encode()):
        h = xxhash.xxh64_intdigest(part, h)
    return h - (1 << 64) * (h >> 63)


def plain_run(docs, model, classifier_of):
    langs, scores = model.predict([t for _, t, _ in docs])
    docs = [d for d, lang, s in zip(docs, langs, scores, strict=True)
            if lang != "und" and s >= corpus_pipeline.MIN_LANGUAGE_SCORE and model.familiar(d[1], lang)]
    fp = {i: plain_fingerprint(t) for i, t, _ in docs}
    label = plain_components(set(fp.values()), 3)
    least = {}
    for i in sorted(fp):
        least.setdefault(label[fp[i]], i)
    docs = [d for d in docs if least[label[fp[d[0]]]] == d[0]]
    classifier, out = classifier_of(docs), []
    names = ("kind", "start", "end", "base", "votes", "shape")
    for i, text, source in docs:
        spans = classifier.chosen([dict(zip(names, s, strict=True)) for s in pii.propose(text)])
        clean, at = "", 0
        for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], s[0])):
            if a >= at:
                clean += text[at:a] + f"<{pii.KINDS[kind]}>"
            at = max(at, b)
        out.append((i, clean + text[at:], source))
    words = {i: [w for w in t.replace("\n", " ").replace("\t", " ").split(" ") if w] for i, t, _ in out}
    sizes = defaultdict(int)
    for i, _, s in out:
        sizes[s] += len(words[i])
    left = {s: round(t) for s, t in plain_targets(sizes).items()}
    pieces, copies = [], {s: 0 for s in sizes}
    while any(left[s] > 0 for s in sizes):
        for i, t, s in sorted(out, key=lambda d: mix_key(d[0], d[1])):
            n = min(len(words[i]), left[s])
            left[s] -= n
            if n:
                pieces.append((i, t if n == len(words[i]) else " ".join(words[i][:n])))
    rows = []
    for i, t in pieces:
        ids = plain_ids(t)
        rows += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    return sorted(rows)


def test_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    given = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    fitted = lambda kept: pii.learn(pii.proposals(documents(spark, [(i, t) for i, t, _ in kept])))
    want = plain_run(given, langid.learn(docs), fitted)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    ends = defaultdict(list)
    for r in rows:
        ends[r.sequence_id].append((r.offset, r.offset + r.length))
    for own in ends.values():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] <= 2048 and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))


def test_stages_bear_odd_rows(spark):
    docs = documents(spark, [(i, t, ("en", "de")[k % 2], "s") for k, (i, t) in enumerate(ODD * 2)])
    assert [len(corpus_pipeline.STAGES)] == [5]
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "")
        assert now.schema == docs.schema
        assert {(r.size, r.fp, r.score) for r in now.collect()} == {(-1, "x", "y")}
        now = spark.createDataFrame(now.collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, now, "").count() > 0


def test_stages_bear_empty_tables(spark):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
