"""Approximate nearest neighbours by low-dimensional stable projections.

A projection on m Gaussian directions turns a distance d into d times the root of a chi-square
variable with m degrees of freedom.  So neighbours in the projection, taken nearest first from a
kd-tree, are verified on the original vectors until the next one's projected distance says, by a
chi-square test against the k-th best distance found, that few nearer vectors can be left.

Every vector is indexed.  The top of the kd-tree is fitted on a bounded sample; its leaves, cut
further by a hash where they are too full, are the blocks, and every block is indexed and searched
in one task.  A query goes to all blocks that the same test can't rule out from their boxes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.llm.common import partitions, stage

BLOCK = 8192  # vectors per block, about
SAMPLE = 4096  # vectors that place the blocks and give each query its first bound
LEAF = 256


def chi_square_quantile(m: int, p: float) -> float:
    """The value that a chi-square variable with m (even) degrees of freedom exceeds with chance 1 - p."""
    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def usable(vector: Column) -> Column:
    """Not null, of finite numbers only, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Tree:
    """A kd-tree over projected vectors, as the boxes and rows of its leaves."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.rows: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            part = points[rows]
            spread = part.max(axis=0) - part.min(axis=0)
            if len(rows) <= leaf or not spread.any():
                self.rows.append(rows)
                continue
            order = np.argsort(part[:, int(spread.argmax())], kind="stable")
            todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
        self.low = np.stack([points[r].min(axis=0) for r in self.rows])
        self.high = np.stack([points[r].max(axis=0) for r in self.rows])


def box_gap(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """The square of a point's distance from each box."""
    return ((np.maximum(low - point, 0) + np.maximum(point - high, 0)) ** 2).sum(axis=-1)


def noise(vector: np.ndarray, directions: np.ndarray) -> float:
    """The square of a distance within which projections of equal vectors lie: sums differ in their
    last digits with the routine that makes them, which depends on how many vectors meet."""
    return float((len(vector) * 2.0**-49 * np.linalg.norm(vector) * np.linalg.norm(directions, axis=0).max()) ** 2)


class Index:
    """One block: its vectors, their projections, and the kd-tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, directions: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.points, self.directions = vectors @ directions, directions
        self.tree = Tree(self.points, LEAF)

    def search(self, own: int, vector: np.ndarray, point: np.ndarray, k: int, factor: float, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and squared distances of the k nearest found, other than the row `own`.

        `bound` is a squared distance within which k candidates are known to be.
        """
        lead, near = box_gap(self.tree.low, self.tree.high, point), noise(vector, self.directions)
        order = np.argsort(lead, kind="stable")
        ids, best, worst = np.zeros(0, np.int64), np.zeros(0), bound
        pool_row, pool = np.zeros(0, np.int64), np.zeros(0)
        for n, leaf in enumerate(order):
            if lead[leaf] > factor * worst + near:
                break
            rows = self.tree.rows[leaf]
            pool_row = np.concatenate([pool_row, rows])
            pool = np.concatenate([pool, ((self.points[rows] - point) ** 2).sum(axis=1)])
            horizon = lead[order[n + 1]] if n + 1 < len(order) else np.inf
            out = pool <= min(horizon, factor * worst + near)  # no unopened leaf holds a nearer one
            rows, pool_row, pool = pool_row[out], pool_row[~out], pool[~out]
            rows = rows[self.ids[rows] != own]
            if len(rows):
                ids = np.concatenate([ids, self.ids[rows]])
                best = np.concatenate([best, ((self.vectors[rows] - vector) ** 2).sum(axis=1)])
                keep = np.lexsort((ids, best))[:k]
                ids, best = ids[keep], best[keep]
                if len(best) == k:
                    worst = min(worst, best[-1])
        return ids, best


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, m: int = 8, chance: float = 0.98, seed: int = 5, block: int = BLOCK) -> DataFrame:
    """The k nearest found of each query by Euclidean distance: query_id, rank (from 1), vec_id, score.

    `vectors` has vec_id and embedding; rows for which `is_query` holds are asked against all other
    rows.  Each true neighbour is found with a chance of at least `chance`; scores are the exact
    distances, ties go to the smaller vec_id, and fewer candidates than k are returned all.

    Vectors that are null, zero, or hold a null or non-finite number take no part, nor do rows
    without an id.  Vectors are near only to vectors of their own length.  Where a vec_id repeats,
    the least of its vectors counts.  Other columns are not looked at; no rows give no rows.
    """
    spark = vectors.sparkSession
    number = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where("vec_id is not null").where(is_query.isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), number.alias("v"), is_query.alias("q")
    )
    rows = stage(rows.where(usable(F.col("v"))).groupBy("vec_id").agg(F.min("v").alias("v"), F.max("q").alias("q")))
    found = [_of_length(rows.where(F.size("v") == r.n), r.n, r["count"], k, m, chance, seed, block)
             for r in rows.groupBy(F.size("v").alias("n")).count().orderBy("n").collect()]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    return every


def _of_length(rows: DataFrame, length: int, n: int, k: int, m: int, chance: float, seed: int, block: int) -> DataFrame:
    spark = rows.sparkSession
    directions = np.random.default_rng(seed).standard_normal((length, m))
    factor = chi_square_quantile(m, chance)
    share = min(1.0, SAMPLE / n)
    picked = rows.where(F.xxhash64("vec_id", F.lit(seed)) / float(1 << 63) <= 2 * share - 1).select("vec_id", "v").collect()
    some_ids = np.array([r.vec_id for r in picked], np.int64)
    some = np.array([r.v for r in picked], float).reshape(len(picked), length)
    # The sample's kd-tree: a vector belongs to the leaf whose box in the projection is nearest.
    top = Tree(some @ directions, max(1, math.ceil(len(some) * block / n))) if len(some) else None

    def leaf_of(points: np.ndarray) -> np.ndarray:
        if top is None:
            return np.zeros(len(points), int)
        return np.concatenate([box_gap(top.low, top.high, points[a : a + 1024, None, :]).argmin(axis=1) for a in range(0, len(points), 1024)])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(leaf=leaf_of(np.stack(b["v"].to_numpy()) @ directions).astype(np.int32))

    placed = stage(rows.mapInPandas(place, "vec_id long, v array<double>, q boolean, leaf int"))

    def boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, list] = {}
        for b in batches:
            if not len(b):
                continue
            points = np.stack(b["v"].to_numpy()) @ directions
            for leaf, at in b.groupby("leaf").indices.items():
                low, high, count = seen.get(leaf, (np.inf, -np.inf, 0))
                seen[leaf] = (np.minimum(low, points[at].min(axis=0)), np.maximum(high, points[at].max(axis=0)), count + len(at))
        for leaf, (low, high, count) in seen.items():
            yield pd.DataFrame({"leaf": leaf, "i": np.arange(m), "low": low, "high": high, "n": count})

    box = placed.mapInPandas(boxes, "leaf int, i int, low double, high double, n long").groupBy("leaf", "i").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).toPandas().sort_values(["leaf", "i"])
    leaves = box["leaf"].unique()
    low, high = box["low"].to_numpy().reshape(-1, m), box["high"].to_numpy().reshape(-1, m)
    cuts = [max(1, math.ceil(c / block)) for c in box["n"].to_numpy().reshape(-1, m)[:, 0]]
    first = dict(zip(leaves.tolist(), np.cumsum([0, *cuts[:-1]]).tolist(), strict=True))
    many = dict(zip(leaves.tolist(), cuts, strict=True))
    fields = "block long, asks int, vec_id long, v array<double>, bound double"

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            where = [first[x] + (i * 0x9E3779B97F4A7C15 >> 20) % many[x] for x, i in zip(b["leaf"], b["vec_id"], strict=True)]
            yield pd.DataFrame({"block": where, "asks": 0, "vec_id": b["vec_id"], "v": b["v"], "bound": 0.0})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for own, v in zip(b["vec_id"], b["v"], strict=True):
                near = np.sort(((some - v) ** 2).sum(axis=1)[some_ids != own])
                bound = near[k - 1] if len(near) >= k else np.inf
                open_ = np.flatnonzero(box_gap(low, high, v @ directions) <= factor * bound + noise(v, directions))
                blocks = [first[leaves[x]] + c for x in open_ for c in range(cuts[x])]
                yield pd.DataFrame({"block": blocks, "asks": 1, "vec_id": own, "v": [v] * len(blocks), "bound": bound})

    both = placed.mapInPandas(file, fields).union(placed.where("q").select("vec_id", "v").mapInPandas(ask, fields))
    # blocks are dealt by number: hashing would put several of them into one task and none into others
    tasks = max(1, min(partitions(spark), sum(cuts)))
    dealt = both.repartitionById(tasks, F.pmod("block", F.lit(tasks)).cast("int")).sortWithinPartitions("block", "asks", "vec_id")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block_id, ids, parts, index = None, [], [], None
        for b in batches:
            out = []
            for (bl, asks), g in b.groupby(["block", "asks"], sort=True):
                if bl != block_id:
                    block_id, ids, parts, index = bl, [], [], None
                stack = np.stack(g["v"].to_numpy())
                if not asks:
                    ids.append(g["vec_id"].to_numpy())
                    parts.append(stack)
                    continue
                if not ids:
                    continue
                if index is None:
                    index = Index(np.concatenate(ids), np.concatenate(parts), directions)
                for own, v, p, bound in zip(g["vec_id"], stack, stack @ directions, g["bound"], strict=True):
                    near, d = index.search(own, v, p, k, factor, bound)
                    out.append(pd.DataFrame({"query_id": own, "vec_id": near, "score": np.sqrt(d)}))
            if out:
                yield pd.concat(out)

    met = dealt.mapInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
