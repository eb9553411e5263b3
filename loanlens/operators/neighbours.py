"""Exact nearest neighbours among the rows of one class.

Comparing all pairs would be quadratic, so the search is pruned by geometry, which never changes
the answer: vectors are assigned to the nearest of a few pivot vectors, every vector searches its
own cell first, and then visits only those other cells that the triangle inequality cannot rule
out at the distance found so far (Lu et al., "Efficient Processing of k Nearest Neighbor Joins
using MapReduce", VLDB 2012).  Neighbouring cells travel together as parts of bounded size, a large
cell as several, so a vector is sent once for each part it meets and a task holds two parts at most;
each pair returns only its k best.  Copies of a vector are collapsed to one row with a count before
any of this.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanlens.sources.tables import stage

# workers run these kernels without having the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 2048
PART_BYTES = 32 << 20  # vectors that a task holds of either side
MOST_PIVOTS = 8192
MOST_PAIRS = 1_000_000  # of parts, that are broadcast
CHUNK = 512
BATCH = 65_536


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b, up to rounding."""
    return np.maximum((a * a).sum(1)[:, None] - 2.0 * a @ b.T + (b * b).sum(1)[None, :], 0.0)


def _slack(a: np.ndarray, b: np.ndarray) -> float:
    """A bound on the rounding error of `_squares`."""
    return 1e-12 * a.shape[1] * (1.0 + (a * a).sum(1).max(initial=0.0) + (b * b).sum(1).max(initial=0.0))


@dataclass
class Cells:
    """The cells that hold vectors: their numbers, pivots, and the least and largest distance of a vector to its pivot."""

    used: np.ndarray
    centres: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def least(self, x: np.ndarray, home: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How near each row of x may come to a vector of each cell of `which`, and a bound on the rounding error."""
        slack = np.sqrt(_slack(x, self.centres))
        d = np.sqrt(_squares(x, self.centres[which]))
        apart = np.sqrt(_squares(self.centres[home], self.centres[which]))
        mine = ((x - self.centres[home]) ** 2).sum(1)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > slack, (d * d - mine) / (2.0 * apart), 0.0)
        return np.maximum(np.maximum(d - self.high[which], self.low[which] - d), plane), 4 * slack


def _close_pairs(q: np.ndarray, p: np.ndarray, near: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and points that may be among a row's k nearest and within its limit, with exact distances."""
    bounds = limit * limit + _slack(q, p)
    close = near <= bounds[:, None]
    crowded = np.flatnonzero(close.sum(1) > 4 * k)
    if len(crowded):
        kth = np.partition(near[crowded], k - 1, axis=1)[:, k - 1] + _slack(q, p)
        close[crowded] = near[crowded] <= np.minimum(bounds[crowded], kth)[:, None]
    row, place = np.nonzero(close & np.isfinite(near))
    exact = [np.sqrt(((p[place[i:i + BATCH]] - q[row[i:i + BATCH]]) ** 2).sum(1)) for i in range(0, len(row), BATCH)]
    return row, place, np.concatenate(exact) if exact else np.zeros(0)


def _part_best(queries: pd.DataFrame, points: pd.DataFrame, k: int, cells: Cells, home: bool) -> pd.DataFrame:
    """The k nearest points of each query in one part, the query itself left out: in its own cell, or in the others."""
    out = []
    if len(queries) and len(points):
        queries, points = (d.sort_values(["cell", "vid"]) for d in (queries, points))
        p, ids, copies = _matrix(points["features"]), points["vid"].to_numpy(), points["n"].to_numpy()
        own, starts = np.unique(np.searchsorted(cells.used, points["cell"].to_numpy()), return_index=True)
        blocks = [(j, i, min(i + BLOCK_ROWS, end)) for j, (start, end) in enumerate(zip(starts, [*starts[1:], len(p)])) for i in range(start, end, BLOCK_ROWS)]
        for start in range(0, len(queries), CHUNK):
            part = queries.iloc[start:start + CHUNK]
            x, mine, limit = _matrix(part["features"]), part["vid"].to_numpy(), part["limit"].to_numpy().copy()
            at = np.searchsorted(cells.used, part["cell"].to_numpy())
            if not home:
                least, slack = cells.least(x, at, own)
            best = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))  # row, place and distance
            for j, first, end in blocks:
                rows = np.flatnonzero(at == own[j]) if home else np.flatnonzero((at != own[j]) & (least[:, j] <= limit + slack))
                if not len(rows):
                    continue
                near = _squares(x[rows], p[first:end])
                if home:
                    near[mine[rows][:, None] == ids[first:end][None, :]] = np.inf
                row, place, far = _close_pairs(x[rows], p[first:end], near, limit[rows], k)
                row, place, far = (np.concatenate(both) for both in zip(best, (rows[row], first + place, far)))
                order = np.lexsort((ids[place], far, row))
                rank = np.arange(len(row)) - np.searchsorted(row[order], row[order])
                last = order[rank == k - 1]
                limit[row[last]] = np.minimum(limit[row[last]], far[last])
                order = order[rank < k]
                best = (row[order], place[order], far[order])
            out.append((mine[best[0]], ids[best[1]], copies[best[1]], best[2]))
    if not out:
        return pd.DataFrame({"vid": [], "other": [], "copies": [], "distance": []})
    return pd.DataFrame({name: np.concatenate([o[i] for o in out]) for i, name in enumerate(("vid", "other", "copies", "distance"))})


def _parts(centres: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Cells near each other share a part of up to `most` rows, a larger cell has several: for each cell
    its first part and their number, and the number of all parts."""
    first, slices = np.zeros(len(sizes), int), np.ones(len(sizes), int)
    todo, count = [np.arange(len(sizes))], 0
    while todo:
        own = todo.pop()
        total = int(sizes[own].sum())
        if len(own) > 1 and total > most:
            own = own[np.argsort(centres[own, centres[own].var(0).argmax()], kind="stable")]
            cut = min(max(1, int(np.searchsorted(np.cumsum(sizes[own]), total / 2))), len(own) - 1)
            todo += [own[:cut], own[cut:]]
        else:
            first[own], slices[own] = count, max(1, -(-total // most))
            count += int(slices[own[0]])
    return first, slices, count


def _search(queries: DataFrame, points: DataFrame, k: int, cells: Cells, parts: int, home: bool) -> DataFrame:
    """Best candidates of each query in each of the parts it names in `others`.

    A pair of parts meets in one group: a vector travels once for each part it meets, not for each cell.
    """
    pairs = queries.select("part", F.explode("others").alias("other")).distinct()
    if parts * parts <= MOST_PAIRS:
        pairs = F.broadcast(pairs)
    # both sides may come from one frame: renaming gives the left side columns of its own
    left = queries.select(*[F.col(c).alias(c) for c in ("vid", "features", "cell", "limit", "part")], F.explode("others").alias("other"))
    right = points.select("vid", "features", "n", "cell", F.col("part").alias("other")).join(pairs, "other")

    def best(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        return _part_best(q, p, k, cells, home)

    keys = ["part", "other"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        best, "vid long, other long, copies long, distance double")


def _k_best(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("vid").orderBy("distance", "other")
    return candidates.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def distinct_vectors(rows: DataFrame, features: str) -> DataFrame:
    """Distinct vectors with an identifier and the number of rows that have them, stored.

    Identifiers rise with the vectors, so ties that go by them do not depend on the partitioning.
    """
    counted = rows.groupBy(F.col(features).alias("features")).agg(F.count(F.lit(1)).alias("n"))
    return stage(counted.orderBy("features").withColumn("vid", F.monotonically_increasing_id()))


def nearest_vectors(vectors: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """The k nearest other vectors of each vector: (vid, other, copies, distance, place).

    There are as many pivots as the root of the number of vectors, so cells grow no faster than
    their number, and MOST_PIVOTS at most; the pivots' matrix and one row per cell are all that
    reaches the driver and is broadcast.  With more than MOST_PIVOTS ** 2 vectors cells grow, and are
    cut into more parts.  Rows meet the pivots in tasks of BLOCK_ROWS on average, one per core at
    least: by bytes they would fit into few tasks, but each costs a distance to every pivot.
    """
    total = vectors.count()
    tasks = max(vectors.sparkSession.sparkContext.defaultParallelism, -(-total // BLOCK_ROWS))
    wanted = min(max(1, int(total ** 0.5)), MOST_PIVOTS)
    picked = vectors.orderBy(F.xxhash64(F.lit(seed), "features"), "vid").limit(wanted).select("features").collect()
    pivots = np.array([r["features"] for r in picked], dtype="float64").reshape(len(picked), -1)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch["features"])
                near = np.concatenate([_squares(x[i:i + CHUNK], pivots) for i in range(0, len(x), CHUNK)])
                cell = near.argmin(1)
                yield batch.assign(cell=cell.astype("int32"), reach=np.sqrt(((x - pivots[cell]) ** 2).sum(1)))

    fields = "features array<double>, n long, vid long"
    points = stage(vectors.select("features", "n", "vid").repartition(tasks, "vid").mapInPandas(assign, f"{fields}, cell int, reach double"))
    shapes = sorted(points.groupBy("cell").agg(
        F.count(F.lit(1)), F.min("reach"), F.max("reach")).collect())  # one row per pivot
    used, sizes, low, high = (np.array(x) for x in zip(*shapes)) if shapes else (np.zeros(0, int),) * 4
    cells = Cells(used, pivots[used], low, high)
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    most = max(BLOCK_ROWS, min(PART_BYTES // (8 * max(1, pivots.shape[1])), int(total / (4 * cores) ** 0.5)))
    first_part, slices, parts = _parts(cells.centres, sizes, most)
    places = vectors.sparkSession.createDataFrame(
        list(zip(used.tolist(), first_part.tolist(), slices.tolist())), "cell int, first_part int, slices int")
    spot = F.col("first_part") + F.pmod(F.xxhash64("vid"), F.col("slices")).cast("int")
    placed = points.join(F.broadcast(places), "cell").withColumn("part", spot)  # one row per pivot, MOST_PIVOTS at most
    own = placed.filter(F.col("n") <= k)  # a vector with k copies besides itself needs no others
    columns = ["vid", "other", "copies", "distance", "place"]
    inside = own.withColumns({"limit": F.lit(float("inf")), "others": F.sequence("first_part", F.col("first_part") + F.col("slices") - 1)})
    first = stage(_k_best(_search(inside, placed, k, cells, parts, home=True), k).select(*columns))

    def other_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), CHUNK):
                part = batch.iloc[start:start + CHUNK]
                x, home = _matrix(part["features"]), np.searchsorted(used, part["cell"].to_numpy())
                least, slack = cells.least(x, home, np.arange(len(used)))
                visit = least <= part["limit"].to_numpy()[:, None] + slack
                visit[np.arange(len(part)), home] = False
                met = [np.unique(np.concatenate([np.arange(first_part[c], first_part[c] + slices[c]) for c in np.flatnonzero(v)] or [[]])) for v in visit]
                yield part.assign(others=[m.astype("int32") for m in met])

    limits = first.groupBy("vid").agg(
        F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("limit"))
    reach = own.join(limits, "vid", "left").fillna(float("inf"), subset=["limit"])
    visits = stage(reach.select("vid", "features", "cell", "limit", "part").repartition(tasks, "vid").mapInPandas(
        other_parts, "vid long, features array<double>, cell int, limit double, part int, others array<int>"))
    second = _search(visits, placed, k, cells, parts, home=False)
    found = first.drop("place").unionByName(second.select(*columns[:-1]))
    return _k_best(found, k).select(*columns)


def neighbour_slots(vectors: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """For each distinct vector the vectors of its k nearest other rows: (features, slots).

    Copies of the vector come first, then other vectors, each as often as it has rows.
    """
    near = nearest_vectors(vectors, k, seed)
    repeated = near.withColumn("times", F.least(F.col("copies"), F.lit(k)).cast("int"))
    listed = repeated.groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("place", "other", "times"))).alias("near"))
    copies = F.array_repeat(F.col("vid"), F.least(F.col("n") - 1, F.lit(k)).cast("int"))
    others = F.flatten(F.transform(
        F.coalesce("near", F.expr("cast(array() as array<struct<place:int,other:bigint,times:int>>)")),
        lambda x: F.array_repeat(x["other"], x["times"])))
    return vectors.join(listed, "vid", "left").select(
        "features", F.slice(F.concat(copies, others), 1, k).alias("slots"))
