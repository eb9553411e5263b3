"""Many second-order fits on the same rows, grown side by side: one pass serves a level of all their trees.

Slots are cut into bins once, and rows are stored as bin numbers.  A task adds up gradient, curvature
and rows by (fit, leaf, slot, bin); the sums of a fit meet in the shuffle, where the best split of each
leaf is found.  The driver sees one row per leaf, so the number of jobs does not grow with the fits.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.operators.evaluation import roc_auc_by
from loanlens.sources.tables import stage

# workers run these kernels without having the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STRETCH = 10  # rounds after which margins are written, so that a pass walks few trees
SUMS_MB = 64  # sums that a task holds; more fits take more passes
FEW_ROWS = 2048
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def unit(rows: np.ndarray, *numbers: int) -> np.ndarray:
    """A number in [0, 1) per row: the upper 53 bits of Spark's `xxhash64(row, *numbers)`."""
    with np.errstate(over="ignore"):
        h = np.uint64(42) + P5 + np.uint64(8) ^ _turn(rows.astype(np.int64).view(np.uint64) * P2, 31) * P1
        h = _mixed(_turn(h, 27) * P1 + P4)
        for n in numbers:
            h = h + P5 + np.uint64(4) ^ np.uint64(n & 0xFFFFFFFF) * P1
            h = _mixed(_turn(h, 23) * P2 + P3)
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def slot_borders(df: DataFrame, bins: int) -> list[np.ndarray | int]:
    """Per slot the values that may divide it, rising; of a nominal slot the number of its categories.

    Up to `bins` different values are all told apart, halfway between neighbours; more are cut at quantiles.
    """
    attributes = df.schema["features"].metadata.get("ml_attr", {}).get("attrs", {}).get("nominal", [])
    nominal = {a["idx"]: len(a["vals"]) for a in attributes if a.get("vals")}

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, np.ndarray | None] = {}
        for b in batches:
            if b.num_rows:
                x = _wide(b.column(0))
                for s in range(x.shape[1]):
                    old = met.get(s, np.zeros(0))
                    if old is not None:
                        now = np.union1d(old, x[:, s])
                        met[s] = now if len(now) <= bins else None
        rows = [(s, float(v), False) for s, own in met.items() if own is not None for v in own]
        rows += [(s, 0.0, True) for s, own in met.items() if own is None]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.bool_()))], names=["slot", "value", "many"])

    arrays = df.select(vector_to_array("features").alias("x"))
    own: dict[int, set[float] | None] = {}
    for r in arrays.mapInArrow(few, "slot int, value double, many boolean").distinct().collect():  # up to `bins` for each slot and task
        known = own.setdefault(r["slot"], set())
        if r["many"] or (known is not None and len(known | {r["value"]}) > bins):
            own[r["slot"]] = None
        elif known is not None:
            known.add(r["value"])
    many = [s for s in sorted(own) if own[s] is None and s not in nominal]
    cuts = arrays.agg(*[F.percentile_approx(F.get("x", F.lit(s)), [i / bins for i in range(1, bins)], 100 * bins) for s in many]).first() if many else []
    quantile = dict(zip(many, cuts))
    out: list[np.ndarray | int] = []
    for s in sorted(own):
        if s in nominal:
            out.append(nominal[s])
        else:
            values = np.array(sorted(own[s] or ()))
            out.append(np.unique(quantile[s]) if s in quantile else (values[1:] + values[:-1]) / 2)
    return out


def _wide(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def coded(df: DataFrame, borders: list[np.ndarray | int], base: float, fits: int) -> DataFrame:
    """Stored rows: bin numbers, label, weight, row and a margin per fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _wide(b.column(0)) if b.num_rows else np.zeros((0, len(borders)))
            codes = np.column_stack([x[:, s] if isinstance(c, int) else np.searchsorted(c, x[:, s]) for s, c in enumerate(borders)]).astype("<u2")
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in codes], pa.binary()), *b.columns[1:]], names=["codes", "label", "weight", "row"])

    parts = df.select(vector_to_array("features").alias("x"), F.col("__label").alias("label"), F.col("__weight").alias("weight"), F.col("__row").alias("row"))
    out = parts.mapInArrow(run, "codes binary, label double, weight double, row long")
    return stage(out.withColumn("margins", F.array_repeat(F.lit(base), fits)))


@dataclass
class Fit:
    """One fit's trees, by node number; those since margins were written are walked again."""

    params: object
    seed: int
    place: int  # in the margins
    trained: int = 0
    kept: int = 0
    losses: list[float] = field(default_factory=list)
    recent: list[dict] = field(default_factory=list)
    nodes: list[list[dict]] = field(default_factory=list)  # of all trees, as rows of `trees.NODES`


def _leaves(tree: dict[int, tuple], codes: np.ndarray) -> np.ndarray:
    """The node each row ends in; a tree has (slot, lows, low child, high child) by node, lows being a mask of bins."""
    at = np.zeros(len(codes), np.int64)
    for k in sorted(tree):
        slot, lows, low, high = tree[k]
        rows = np.flatnonzero(at == k)
        if len(rows):
            at[rows] = np.where(lows[codes[rows, slot]], low, high)
    return at


def _margin(start: np.ndarray, recent: list[tuple], codes: np.ndarray) -> np.ndarray:
    out = start.copy()
    for tree, values in recent:
        out += values[_leaves(tree, codes)]
    return out


def _count(sums: np.ndarray, leaf: np.ndarray, codes: np.ndarray, parts: tuple) -> None:
    """Add gradient, curvature and rows to the sums by (leaf, slot, bin): few rows at once for all slots, many slot by slot."""
    _, asked, slots, bins = sums.shape
    if len(codes) <= FEW_ROWS:
        cell = ((leaf[:, None] * slots + np.arange(slots)) * bins + codes).ravel()
        for m, each in enumerate(parts):
            sums[m] += np.bincount(cell, None if each is None else np.repeat(each, slots), asked * slots * bins).reshape(asked, slots, bins)
        return
    for i, column in enumerate(codes.T):
        for m, each in enumerate(parts):
            sums[m, :, i] += np.bincount(leaf * bins + column, each, asked * bins).reshape(-1, bins)


def _batches(batches: Iterator[pa.RecordBatch], width: int):
    for b in batches:
        if b.num_rows:
            texts = b.column("codes")  # all of one length, end to end
            first = np.frombuffer(texts.buffers()[1], "<i4")[texts.offset]
            codes = np.frombuffer(texts.buffers()[2], "<u2", len(texts) * width, first).reshape(-1, width)
            yield b, codes, _wide(b.column("margins"))


class Together:
    """Fits on the rows of `train`, judged on those of `held` (see `boosting.Rows`), which go on in step.

    Without `held` no round is better than the last.
    """

    def __init__(self, train, held, params: list, seeds: list[int], bins: int, patience: int):
        share = min(max(train.share, 1e-9), 1 - 1e-9)
        self.base = base = math.log(share / (1 - share))
        self.borders = slot_borders(train.frame, bins)
        self.sizes = [c if isinstance(c, int) else len(c) + 1 for c in self.borders]
        self.frames = [None if r is None else coded(r.frame, self.borders, base, len(params)) for r in (train, held)]
        self.fits = [Fit(p, s, i) for i, (p, s) in enumerate(zip(params, seeds, strict=True))]
        self.patience, self.bins = patience, max(self.sizes, default=1)

    def keep(self, chosen: list[Fit]) -> None:
        self.fits = chosen

    def train(self, target: int) -> None:
        """Every fit goes on up to `target` rounds in all, or until its patience ends."""
        while True:
            active = [f for f in self.fits if f.trained < target and f.trained - f.kept < self.patience]
            if not active:
                return
            self._round(active)

    def _round(self, active: list[Fit]) -> None:
        from loanlens.operators.boosting import settled

        width, grown = len(self.borders), {}
        for f in active:
            columns = max(1, round(f.params.colsample_bytree * width))
            slots = np.sort(np.random.default_rng([f.seed, f.trained]).permutation(width)[:columns])
            grown[f.place] = {"slots": slots, "tree": {}, "sums": {}, "open": {0: 0}, "next": 1}  # open: depth by node
        while True:
            todo = [f for f in active if grown[f.place]["open"]]
            if not todo:
                break
            for part in self._parts(todo, grown):
                for r in self._best(part, grown):
                    g = grown[r["fit"]]
                    depth, params = g["open"].pop(r["node"]), self._fit(r["fit"]).params
                    g["sums"][r["node"]] = (r["g"], r["h"], r["n"])
                    if r["slot"] >= 0:
                        lows = np.zeros(self.bins, bool)
                        lows[r["lows"]] = True
                        low, high = g["next"], g["next"] + 1
                        g["next"] += 2
                        g["tree"][r["node"]] = (r["slot"], lows, low, high)
                        g["sums"][low] = (r["gl"], r["hl"], r["nl"])
                        g["sums"][high] = (r["g"] - r["gl"], r["h"] - r["hl"], r["n"] - r["nl"])
                        if depth + 1 < params.max_depth:
                            g["open"] |= {low: depth + 1, high: depth + 1}
                for f in part:  # leaves without a sampled row
                    grown[f.place]["open"] = {k: d for k, d in grown[f.place]["open"].items() if k not in grown[f.place]["asked"]}
        for f in active:
            g = grown[f.place]
            nodes, values = self._values(g, f.params, settled)
            f.recent.append((g["tree"], values))
            f.nodes.append([{"tree": f.trained, **{k: v for k, v in n.items() if k != "leaf"}} for _, n in sorted(nodes.items())])
            f.trained += 1
        losses = self._losses(active) if self.frames[1] is not None else {}
        for f in active:
            if not losses:
                f.kept = f.trained
                continue
            f.losses.append(losses[f.place])
            if min(f.losses) == f.losses[-1] and f.losses.index(f.losses[-1]) == f.trained - 1:
                f.kept = f.trained
        if max(len(f.recent) for f in self.fits) >= STRETCH:
            self._write()

    def _fit(self, place: int) -> Fit:
        return next(f for f in self.fits if f.place == place)

    def _values(self, g: dict, params, settled) -> tuple:
        """The tree's nodes after its splits are judged, and the value at every number of a grown leaf."""
        nodes, order = {}, {}
        leaf = {"slot": -1, "threshold": None, "low_categories": None, "categories": -1}

        def visit(k: int) -> int:
            at = len(order)
            order[at] = k
            own = nodes[at] = {"node": at, "low_child": -1, "high_child": -1, "leaf": None, **leaf}
            if k in g["tree"]:
                slot, lows, *_ = g["tree"][k]
                own["slot"], border = int(slot), self.borders[slot]
                if isinstance(border, int):
                    own["low_categories"], own["categories"] = np.flatnonzero(lows).astype(float).tolist(), border
                else:
                    own["threshold"] = float(border[np.flatnonzero(lows)[-1]])
                own["low_child"], own["high_child"] = visit(g["tree"][k][2]), visit(g["tree"][k][3])
            else:
                own["leaf"] = k
            return at

        visit(0)
        nodes, values = settled(nodes, {k: g["sums"].get(k, (0.0, 0.0, 0.0)) for k in order.values()}, params)
        out = np.zeros(g["next"])
        for k, v in values.items():
            out[k] = v
        return nodes, out

    def _parts(self, todo: list[Fit], grown: dict) -> Iterator[list[Fit]]:
        """Fits whose sums a task can hold at once; `asked` are the leaves each looks at in this pass."""
        part, held = [], 0
        for f in todo:
            g = grown[f.place]
            each = len(g["slots"]) * self.bins * 24
            most = max(1, (SUMS_MB << 20) // each)
            g["asked"] = sorted(g["open"])[:most]
            if part and held + each * len(g["asked"]) > SUMS_MB << 20:
                yield part
                part, held = [], 0
            part.append(f)
            held += each * len(g["asked"])
        yield part

    def _best(self, part: list[Fit], grown: dict) -> list:
        """For each asked leaf its sums and its best split: one row per leaf."""
        width, bins = len(self.borders), self.bins
        nominal = [isinstance(c, int) for c in self.borders]
        jobs = [(f.place, f.seed, f.trained, f.params.subsample, f.recent, grown[f.place]["tree"], grown[f.place]["asked"], grown[f.place]["slots"]) for f in part]
        least = {f.place: f.params.min_data_in_leaf for f in part}
        slots_of = {f.place: grown[f.place]["slots"] for f in part}

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b, codes, margins in _batches(batches, width):
                y, w, rows = (b.column(c).to_numpy() for c in ("label", "weight", "row"))
                for place, seed, number, subsample, recent, tree, asked, slots in jobs:
                    keep = np.flatnonzero(unit(rows, seed, number) < subsample) if subsample < 1 else np.arange(len(rows))
                    own = codes[keep]
                    ends = _leaves(tree, own)
                    leaf = np.searchsorted(asked, ends)
                    leaf[leaf == len(asked)] = 0
                    here = np.asarray(asked)[leaf] == ends
                    keep, own, leaf = keep[here], own[here], leaf[here]
                    p = 1 / (1 + np.exp(-_margin(margins[keep, place], recent, own)))
                    g, h = w[keep] * (p - y[keep]), np.maximum(w[keep] * p * (1 - p), 1e-16)
                    sums = total.setdefault(place, np.zeros((3, len(asked), len(slots), bins)))
                    _count(sums, leaf, own[:, slots], (g, h, None))
            fits, found = list(total), [total[k].tobytes() for k in total]
            yield pa.RecordBatch.from_arrays([pa.array(fits, pa.int32()), pa.array(found, pa.binary())], names=["fit", "sums"])

        def choose(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
            place = int(key[0])
            slots, asked = slots_of[place], next(j[6] for j in jobs if j[0] == place)
            named = np.flatnonzero([nominal[s] for s in slots])
            sums = sum(np.frombuffer(s) for s in b["sums"]).reshape(3, len(asked), len(slots), bins)
            out = []
            for k, node in enumerate(asked):
                g, h, n = (float(x) for x in sums[:, k, 0].sum(axis=1))
                if not n:
                    continue
                own, order = sums[:, k], np.tile(np.arange(bins), (len(slots), 1))
                if len(named):  # categories by their mean step, those without rows last
                    met = own[2, named] > 0
                    order[named] = np.argsort(np.where(met, -own[0, named] / np.where(met, own[1, named], 1.0), np.inf), axis=1, kind="stable")
                gl, hl, nl = np.cumsum(np.take_along_axis(own, order[None], axis=2), axis=2)[:, :, :-1]
                fits = (nl >= max(1, least[place])) & (n - nl >= max(1, least[place]))
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(fits, gl**2 / hl + (g - gl) ** 2 / (h - hl) - g * g / h, 0.0)
                gain[np.isnan(gain)] = 0.0
                best = (-1, [], 0.0, 0.0, 0.0)
                if gain.size and gain.max() > 0:
                    i, j = np.unravel_index(gain.argmax(), gain.shape)  # ties: the first slot, the first cut
                    best = (int(slots[i]), order[i, : j + 1].tolist(), float(gl[i, j]), float(hl[i, j]), float(nl[i, j]))
                out.append((place, node, g, h, n, *best))
            return pd.DataFrame(out, columns=["fit", "node", "g", "h", "n", "slot", "lows", "gl", "hl", "nl"])

        sums = self.frames[0].mapInArrow(add, "fit int, sums binary")
        found = sums.groupBy("fit").applyInPandas(
            choose, "fit int, node int, g double, h double, n double, slot int, lows array<int>, gl double, hl double, nl double").collect()
        return sorted(found, key=lambda r: (r["fit"], r["node"]))

    def _losses(self, active: list[Fit]) -> dict[int, float]:
        """Weighted mean log loss of each fit on the held-out rows."""
        width, jobs = len(self.borders), [(f.place, f.recent) for f in active]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
            total, weight = np.zeros(len(jobs)), 0.0
            for b, codes, margins in _batches(batches, width):
                y, w = b.column("label").to_numpy(), b.column("weight").to_numpy()
                weight += w.sum()
                for i, (place, recent) in enumerate(jobs):
                    m = _margin(margins[:, place], recent, codes)
                    total[i] += (w * (np.maximum(m, 0) - m * y + np.log1p(np.exp(-np.abs(m))))).sum()
            yield pa.RecordBatch.from_arrays([pa.array([j[0] for j in jobs], pa.int32()), pa.array(total), pa.array(np.full(len(jobs), weight))], names=["fit", "loss", "weight"])

        rows = self.frames[1].mapInArrow(run, "fit int, loss double, weight double").groupBy("fit").agg(F.sum("loss") / F.sum("weight")).collect()
        return {r[0]: r[1] for r in rows}

    def areas(self) -> dict[int, float]:
        """Exact ROC area of each fit on the held-out rows, by its place; all from one ranking."""
        width, jobs = len(self.borders), [(f.place, f.recent) for f in self.fits]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, codes, margins in _batches(batches, width):
                for place, recent in jobs:
                    m = _margin(margins[:, place], recent, codes)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), place, np.int32)), b.column("label"), pa.array(m)], names=["fit", "label", "margin"])

        scores = self.frames[1].mapInArrow(run, "fit int, label double, margin double")
        return {r["fit"]: float(r["roc_auc"]) for r in roc_auc_by(scores, "fit", "label", "margin").collect()}

    def _write(self) -> None:
        """Write the margins of the fits that go on; their trees need not be walked any more."""
        width, jobs = len(self.borders), [(f.place, f.recent) for f in self.fits]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, codes, margins in _batches(batches, width):
                now = np.column_stack([_margin(margins[:, place], recent, codes) for place, recent in jobs])
                ends = pa.array(np.arange(0, now.size + 1, now.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("codes", "label", "weight", "row")], pa.ListArray.from_arrays(ends, pa.array(now.ravel()))],
                                                 names=["codes", "label", "weight", "row", "margins"])

        self.frames = [None if f is None else stage(f.mapInArrow(run, "codes binary, label double, weight double, row long, margins array<double>")) for f in self.frames]
        for i, f in enumerate(self.fits):
            f.place, f.recent = i, []
