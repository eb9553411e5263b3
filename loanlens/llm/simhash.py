"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are dealt into m groups of bits that go together.  If thresholds t_1..t_m (-1 allowed)
sum up to distance - m + 1, any two fingerprints within the distance differ by at most t_i bits in
some group i.  So each fingerprint may choose its own thresholds: a group where it has much company
gets a small one or is passed over.  A dynamic program makes the cheapest choice from estimated
candidate counts.  Fingerprints are then looked up in every group within the threshold and verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import components, stage, with_id

BLOCK = 8192  # fingerprints of one bucket that meet in a task; larger buckets are cut into blocks
CHUNK = 65_536  # shingle hashes whose bits are counted at once
PROBE_COST = 20  # one looked-up key costs as much as verifying so many candidates
PLANNED = 2000  # fingerprints on which the number of groups is tried out; it decides no result
SMALL = 48  # rows of a bucket up to which all its rows are compared in one sweep


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The SimHash of a whole text, as an unsigned number.

    A-Z become lower case; shingles are `words` words long, repeats count, and are joined by a space
    (the whole sequence where there are fewer words).  A bit is 1 if over half of the shingles' XXH64
    have it.  No word, or a null text: 0.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(size)
    n = max(1, len(tokens) - words + 1)
    starts, stops = (ends - size)[:n].tolist(), (ends[min(words, len(tokens)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[k : k + CHUNK], stops[k : k + CHUNK], strict=True)], np.uint64)
        votes += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp})

    return with_id(docs, "doc_id", "text").mapInPandas(run, "doc_id string, fp long").withColumn("doc_id", F.col("doc_id").cast("long"))


def bit_groups(like: np.ndarray, m: int) -> list[list[int]]:
    """Deal the bits into m groups of about equal size: the strongest pair left opens a group, and
    the bit with the largest sum of correlations to the group joins it until it is full."""
    like = np.abs(like - np.diag(np.diag(like)))
    left, groups = list(range(len(like))), []
    for k in range(m):
        size = -(-len(left) // (m - k))
        part = like[np.ix_(left, left)]
        i, j = np.unravel_index(int(part.argmax()), part.shape)
        group = sorted({left[i], left[j]}) if size > 1 else [left[i]]
        while len(group) < size:
            rest = [b for b in left if b not in group]
            group.append(rest[int(like[np.ix_(rest, group)].sum(axis=1).argmax())])
        while len(group) > size:
            group.pop()
        groups.append(sorted(group))
        left = [b for b in left if b not in group]
    return groups


def extract(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The value that the given bits spell, the first one lowest."""
    out = np.zeros(len(fp), np.int64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


class Plan:
    """The groups of bits, and for any fingerprint the thresholds with the fewest estimated candidates."""

    def __init__(self, groups: list[list[int]], counts: list[list[np.ndarray]], distance: int):
        self.groups, self.distance, self.m = groups, distance, len(groups)
        self.blocks = [blocks_of(g) for g in groups]
        self.rows = int(counts[0][0].sum())
        # near[i][k][v, e]: the share of fingerprints whose k-th block of group i is e bits from v
        self.near = [[_spectrum(c, distance) for c in group] for group in counts]
        self.masks = [[_ball(len(g), t) for t in range(distance + 1)] for g in groups]

    def thresholds(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One row of thresholds per fingerprint, -1 for a group that is passed over, and its cost."""
        budget = self.distance + 1  # of t_i + 1 over all groups
        best, picks = np.zeros((len(fp), budget + 1)), []
        best[:, 1:] = np.inf
        for i in range(self.m):
            share = np.zeros((len(fp), self.distance + 1))
            share[:, 0] = 1
            for bits, near in zip(self.blocks[i], self.near[i], strict=True):
                step = near[extract(fp, bits)]
                share = np.stack([sum(share[:, a] * step[:, e - a] for a in range(e + 1)) for e in range(self.distance + 1)], axis=1)
            within = np.cumsum(share, axis=1) * self.rows
            cost = np.zeros((len(fp), budget + 1))  # column t + 1
            for t in range(self.distance + 1):
                cost[:, t + 1] = within[:, t] + PROBE_COST * len(self.masks[i][t])
            total = np.full((len(fp), budget + 1), np.inf)
            pick = np.zeros((len(fp), budget + 1), np.int64)
            for s in range(budget + 1):
                for use in range(s + 1):
                    c = best[:, s - use] + cost[:, use]
                    better = c < total[:, s]
                    total[better, s], pick[better, s] = c[better], use
            best = total
            picks.append(pick)
        out, s, rows = np.zeros((len(fp), self.m), np.int64), np.full(len(fp), budget), np.arange(len(fp))
        for i in reversed(range(self.m)):
            use = picks[i][rows, s]
            out[:, i], s = use - 1, s - use
        return out, best[:, budget]

    def entries(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """key, fingerprint, kind: where each one is filed (1), looked up (2), or both (3)."""
        thresholds, _ = self.thresholds(fp)
        keys, fps, kinds = [], [], []
        for i, bits in enumerate(self.groups):
            value, t = extract(fp, bits), thresholds[:, i]
            head = np.int64(i) << 40
            keys.append(head | value)
            fps.append(fp)
            kinds.append(np.where(t >= 0, 3, 1))
            for most in range(1, self.distance + 1):
                own = t == most
                if own.any():
                    masks = self.masks[i][most][1:]
                    keys.append((head | (value[own][:, None] ^ masks[None, :])).ravel())
                    fps.append(np.repeat(fp[own], len(masks)))
                    kinds.append(np.full(int(own.sum()) * len(masks), 2))
        return np.concatenate(keys), np.concatenate(fps), np.concatenate(kinds)


def blocks_of(group: list[int]) -> list[list[int]]:
    return [group[k : k + 8] for k in range(0, len(group), 8)]


def _spectrum(counts: np.ndarray, distance: int) -> np.ndarray:
    n = len(counts)
    apart = np.bitwise_count((np.arange(n)[:, None] ^ np.arange(n)[None, :]).astype(np.uint64))
    return np.stack([(apart == e) @ counts for e in range(distance + 1)], axis=1) / max(1, counts.sum())


def _ball(width: int, t: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for k in range(t + 1) for c in combinations(range(width), k)], np.int64)


def make_plan(fps: DataFrame, distance: int) -> Plan:
    """Choose 2, 3 or 4 groups; all statistics are taken over all fingerprints."""

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = np.zeros((64, 64))
        for b in batches:
            bits = np.unpackbits(b["fp"].to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
        yield pd.DataFrame({"i": np.repeat(np.arange(64), 64), "j": np.tile(np.arange(64), 64), "n": both.ravel()})

    got = fps.select("fp").mapInPandas(gram, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, rows = np.zeros((64, 64)), fps.count()
    for r in got:
        both[r.i, r.j] = r.n
    p = np.diag(both) / max(rows, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    like = (both / max(rows, 1) - np.outer(p, p)) / np.outer(spread, spread)
    choices = [bit_groups(like, m) for m in range(2, 5)]
    blocks = [bits for groups in choices for g in groups for bits in blocks_of(g)]

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [np.zeros(1 << len(bits), np.int64) for bits in blocks]
        for b in batches:
            fp = b["fp"].to_numpy().view(np.uint64)
            for s, bits in zip(sums, blocks, strict=True):
                s += np.bincount(extract(fp, bits), minlength=len(s))
        for k, s in enumerate(sums):
            v = np.flatnonzero(s)
            yield pd.DataFrame({"k": k, "v": v, "n": s[v]})

    counts = [np.zeros(1 << len(bits), np.int64) for bits in blocks]
    for r in fps.select("fp").mapInPandas(tally, "k int, v int, n long").groupBy("k", "v").agg(F.sum("n").alias("n")).collect():
        counts[r.k][r.v] = r.n
    share = min(1.0, PLANNED / max(rows, 1))
    some = np.array([r.fp for r in fps.select("fp").where(F.abs(F.xxhash64("fp") / float(1 << 63)) <= share).collect()] or [0], np.int64).view(np.uint64)
    plans, at = [], 0
    for groups in choices:
        own = []
        for g in groups:
            n = len(blocks_of(g))
            own.append(counts[at : at + n])
            at += n
        plans.append(Plan(groups, own, distance))
    return min(plans, key=lambda plan: plan.thresholds(some)[1].mean())


def link(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Edges (a, b) between fingerprints that span the same components as all links do.

    Within a bucket the rows that were filed meet the rows that look them up; what is within the
    distance is joined, and every joined row is returned once, with one row of its kin.  A bucket
    larger than BLOCK is cut into blocks and every pair of blocks meets in a task of its own, so
    neither a task nor the result holds all pairs of a group, and no link is lost.
    """
    plan = make_plan(fps, distance)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 4096):
                keys, fp, kind = plan.entries(b["fp"].to_numpy()[k : k + 4096].view(np.uint64))
                yield pd.DataFrame({"key": keys, "fp": fp.view(np.int64), "kind": kind.astype(np.int32)})

    entries = fps.select("fp").mapInPandas(spread, "key long, fp long, kind int")
    filed, asked = F.col("kind").bitwiseAND(1) == 1, F.col("kind").bitwiseAND(2) == 2
    hot = stage(
        entries.groupBy("key").agg(F.sum(filed.cast("long")).alias("n1"), F.sum(asked.cast("long")).alias("n2"))
        .where(f"n1 > {BLOCK} or n2 > {BLOCK}")
        .selectExpr("key", f"cast(ceil(n1 / {BLOCK}) as int) as b1", f"cast(ceil(n2 / {BLOCK}) as int) as b2")
    )
    place = F.expr("""
        case when b1 is null then array(named_struct('x', 0, 'y', 0, 'k', kind))
        else concat(
            if(kind & 1 = 1, transform(sequence(0, greatest(b2, 1) - 1), i -> named_struct('x', cast(pmod(xxhash64(fp), b1) as int), 'y', i, 'k', 1)), array()),
            if(kind & 2 = 2, transform(sequence(0, greatest(b1, 1) - 1), i -> named_struct('x', i, 'y', cast(pmod(xxhash64(fp, 1), b2) as int), 'k', 2)), array()))
        end""")
    dealt = (
        entries.join(hot, "key", "left").select("key", "fp", F.explode(place).alias("p"))
        .select("key", F.col("p.x").alias("x"), F.col("p.y").alias("y"), "fp", F.col("p.k").alias("kind"))
        .repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    )
    return dealt.mapInPandas(lambda batches: _join_buckets(batches, distance), "a long, b long")


def _join_buckets(batches: Iterator[pd.DataFrame], distance: int) -> Iterator[pd.DataFrame]:
    """Rows come sorted by bucket; the last bucket of a batch waits for the next batch."""
    rest = None
    for b in batches:
        now = (b["key"].to_numpy(), b["x"].to_numpy(), b["y"].to_numpy(), b["fp"].to_numpy().view(np.uint64), b["kind"].to_numpy())
        if rest is not None:
            now = tuple(np.concatenate(pair) for pair in zip(rest, now, strict=True))
        if not len(now[0]):
            continue
        new = np.zeros(len(now[0]), bool)
        new[0] = True
        for c in now[:3]:
            new[1:] |= c[1:] != c[:-1]
        cut = int(np.flatnonzero(new)[-1])
        rest = tuple(c[cut:] for c in now)
        yield from _join_rows(now[3][:cut], now[4][:cut], np.cumsum(new[:cut]), distance)
    if rest is not None:
        yield from _join_rows(rest[3], rest[4], np.ones(len(rest[3]), np.int64), distance)


def _join_rows(fp: np.ndarray, kind: np.ndarray, bucket: np.ndarray, distance: int) -> Iterator[pd.DataFrame]:
    if not len(fp):
        return
    _, first, size = np.unique(bucket, return_index=True, return_counts=True)
    small = np.repeat(size <= SMALL, size)
    a, k, g = fp[small], kind[small], bucket[small]
    for d in range(1, min(SMALL, int(size[size <= SMALL].max(initial=0)))):
        near = np.flatnonzero((g[:-d] == g[d:]) & ((k[:-d] | k[d:]) == 3) & (np.bitwise_count(a[:-d] ^ a[d:]) <= distance))
        if len(near):
            yield _edges(a[:-d][near], a[d:][near])
    for at, n in zip(first[size > SMALL], size[size > SMALL], strict=True):
        own, what = fp[at : at + n], kind[at : at + n]
        yield _span(own[what & 1 == 1], own[what & 2 == 2], distance)


def _edges(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def _span(filed: np.ndarray, asked: np.ndarray, distance: int) -> pd.DataFrame:
    """Join every asked row with the filed rows near it, as a forest instead of pairs."""
    if not len(filed) or not len(asked):
        return _edges(filed[:0], filed[:0])
    label, own = np.arange(len(filed)), np.full(len(asked), -1)
    step = max(1, (1 << 21) // len(filed))
    for k in range(0, len(asked), step):
        near = np.bitwise_count(asked[k : k + step, None] ^ filed[None, :]) <= distance
        hit = near.any(axis=1)
        own[k : k + step][hit] = near[hit].argmax(axis=1)
        low = np.where(near, label[None, :], len(filed)).min(axis=1)
        high = np.where(near, label[None, :], -1).max(axis=1)
        for r in np.flatnonzero(hit & (low < high)):
            found = np.unique(label[near[r]])
            if len(found) > 1:
                label[np.isin(label, found)] = found[0]
    kin = np.flatnonzero(label != np.arange(len(filed)))
    met = np.flatnonzero(own >= 0)
    met = met[asked[met] != filed[own[met]]]
    return _edges(np.concatenate([filed[kin], asked[met]]), np.concatenate([filed[label[kin]], filed[own[met]]]))


def near_duplicates(docs: DataFrame, distance: int = 3) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits), component_id of every document.

    Fingerprints link at `distance` or fewer differing bits; component_id is the smallest doc_id
    that can be reached over links.  Null ids are kept but name no component: where a component has
    no other, component_id is null.  Null and empty texts have the fingerprint 0 and link like any
    other; repeated rows are returned each; columns besides doc_id and text are not looked at.
    """
    rows = stage(fingerprints(docs))
    fps = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(link(fps.select("fp"), distance))
    known = fps.join(labels, fps["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    known = stage(known)
    named = known.groupBy("label").agg(F.min("least").alias("component_id"))
    of = stage(known.join(named, "label").select("fp", "component_id"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(of, "fp").select("doc_id", "fp", digits, "component_id")


def keep_first(docs: DataFrame, distance: int = 3) -> DataFrame:
    """One document of each component stays, unchanged.

    The row with the smallest doc_id stays; rows without an id come last, and equal ids are told apart
    by a hash of the text, then by their place in the staged table.  So repeated rows and copies
    without an id count like any others.  Null texts link like empty ones; no rows give no rows.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    whole = stage(docs.withColumn(row, F.monotonically_increasing_id()))
    found = near_duplicates(whole.select(F.col(row).alias("doc_id"), "text"), distance)
    found = found.select(F.col("doc_id").alias(row), F.col("component_id").alias("group"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text"), F.col(row).alias("row"))
    ranked = stage(whole.select(row, order.alias("order")).join(found, row))
    best = ranked.groupBy("group").agg(F.min("order").alias("order")).select(F.col("order.row").alias(row))
    # the rows that go are fewer than those that stay, so they are what may be broadcast
    gone = stage(ranked.select(row).join(best, row, "left_anti"))
    return whole.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
