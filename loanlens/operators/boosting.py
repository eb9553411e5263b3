"""Boosting by second-order steps: MLlib grows each round's tree, its leaves are set by gradients and curvatures.

A round's tree is fitted to each row's Newton step.  Sums of gradient and curvature per leaf, one row per
leaf and task in the shuffle, then decide which splits stay and what the leaves are worth.  Margins go on
from round to round, so a fit ends `patience` rounds after its best one and nothing is trained twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.operators import trees
from loanlens.operators.models import draw_trials
from loanlens.operators.sampling import stratified_folds
from loanlens.operators.together import Together
from loanlens.sources.tables import stage

STRETCH = 10  # rounds after which margins are written, which cuts their lineage
MEMORY_MB = 1024


@dataclass(frozen=True)
class Params:
    """What a round may do.  `reg_lambda` and `reg_alpha` shrink leaf values, `min_split_gain` is the least
    gain of a split, `num_leaves` the most leaves; shares of rows and columns are drawn for every tree."""

    learning_rate: float = 0.1
    max_depth: int = 3
    num_leaves: int = 31
    min_data_in_leaf: int = 20
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    reg_lambda: float = 0.0
    reg_alpha: float = 0.0
    min_split_gain: float = 0.0

    def leaf_value(self, g: float, h: float) -> float:
        return -math.copysign(max(abs(g) - self.reg_alpha, 0.0), g) / (h + self.reg_lambda) if h + self.reg_lambda > 0 else 0.0

    def leaf_score(self, g: float, h: float) -> float:
        return max(abs(g) - self.reg_alpha, 0.0) ** 2 / (h + self.reg_lambda) if h + self.reg_lambda > 0 else 0.0


@dataclass
class SecondOrderModel:
    """Trees as rows of `trees.NODES`, whose values add up to the log odds less `base`."""

    base: float
    nodes: list[list[dict]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    kept: int = 0  # rounds up to the best one; `nodes` has as many trees

    def paths(self) -> list[trees.Leaf]:
        """The leaf paths, for `trees.tree_attribution`; shares and mean add up to the log odds less `base`."""
        return trees.leaf_paths(n for tree in self.nodes for n in tree)

    def node_table(self, spark: SparkSession) -> DataFrame:
        rows = [tuple(n[c.split()[0]] for c in trees.NODES.split(", ")) for tree in self.nodes for n in tree]
        return spark.createDataFrame(rows, trees.NODES)

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Add `margin` (log odds) and `DefaultProbability`; rows stay where they are."""
        own, base = [_compact(t) for t in self.nodes], self.base

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                x = np.array([np.asarray(v, dtype=float) for v in b]) if len(b) else np.zeros((0, 0))
                yield pd.Series(base + sum((_walk(t, x) for t in own), np.zeros(len(x))))

        out = df.withColumn("margin", score(vector_to_array(features)))
        return out.withColumn("DefaultProbability", 1 / (1 + F.exp(-F.col("margin"))))


def load_second_order(nodes: DataFrame, base: float) -> SecondOrderModel:
    """A model from its stored node table; as many rows as the model has nodes."""
    by_tree: dict[int, list[dict]] = {}
    for r in nodes.orderBy("tree", "node").collect():
        by_tree.setdefault(r["tree"], []).append(r.asDict())
    return SecondOrderModel(base, [by_tree[t] for t in sorted(by_tree)], kept=len(by_tree))


def _compact(tree: list[dict]) -> dict[int, dict]:
    return {n["node"]: n for n in tree}


def _walk(tree: dict[int, dict], x: np.ndarray) -> np.ndarray:
    """Each row's value in one tree."""
    out = np.zeros(len(x))
    todo = [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        n = tree[at]
        if n["low_child"] < 0:
            out[rows] = n["value"]
        elif len(rows):
            v = x[rows, n["slot"]]
            low = v <= n["threshold"] if n["threshold"] is not None else np.isin(v, n["low_categories"])
            todo += [(n["low_child"], rows[low]), (n["high_child"], rows[~low])]
    return out


def grown_nodes(model: DecisionTreeRegressionModel, slots: list[int]) -> dict[int, dict]:
    """The nodes of a grown tree in preorder, which is also the order of MLlib's leaf numbers (`leaf`)."""
    out: dict[int, dict] = {}
    leaves = 0

    def visit(node) -> int:
        nonlocal leaves
        at = len(out)
        own = out[at] = {"node": at, "low_child": -1, "high_child": -1, "slot": -1, "threshold": None, "low_categories": None, "categories": -1, "leaf": None}
        if node.subtreeDepth() == 0:
            own["leaf"], leaves = leaves, leaves + 1
            return at
        split = node.split()
        own["slot"] = slots[split.featureIndex()]
        if "Continuous" in split.getClass().getName():
            own["threshold"] = split.threshold()
        else:
            own["low_categories"], own["categories"] = sorted(split.leftCategories()), split.numCategories()
        own["low_child"] = visit(node.leftChild())
        own["high_child"] = visit(node.rightChild())
        return at

    visit(model._java_obj.rootNode())
    return out


def settled(nodes: dict[int, dict], sums: dict[int, tuple[float, float, float]], params: Params) -> tuple[dict[int, dict], dict[int, float]]:
    """The tree after its splits are judged, and the value for each number of a grown leaf.

    `sums` has gradient, curvature and rows of each grown leaf.  A split above two leaves goes if its
    gain is under the floor, the least one first; then, while there are too many leaves, the split
    that gains least goes.  A leaf without a row is worth nothing.
    """
    nodes = {k: dict(n) for k, n in nodes.items()}
    under = {k: [n["leaf"]] if n["leaf"] is not None else [] for k, n in nodes.items()}
    for k in sorted(nodes, reverse=True):
        n = nodes[k]
        if n["low_child"] >= 0:
            under[k] = under[n["low_child"]] + under[n["high_child"]]
    total = {k: tuple(sum(sums.get(leaf, (0.0, 0.0, 0.0))[i] for leaf in own) for i in range(3)) for k, own in under.items()}

    def gain(k: int) -> float:
        n = nodes[k]
        return sum(params.leaf_score(*total[c][:2]) for c in (n["low_child"], n["high_child"])) - params.leaf_score(*total[k][:2])

    while True:
        last = [k for k, n in nodes.items() if n["low_child"] >= 0 and all(nodes[c]["low_child"] < 0 for c in (n["low_child"], n["high_child"]))]
        if not last:
            break
        weakest = min(last, key=lambda k: (gain(k), k))
        leaves = sum(n["low_child"] < 0 for n in nodes.values())
        if gain(weakest) >= params.min_split_gain and leaves <= params.num_leaves:
            break
        n = nodes[weakest]
        del nodes[n["low_child"]], nodes[n["high_child"]]
        n.update(low_child=-1, high_child=-1, slot=-1, threshold=None, low_categories=None, categories=-1)
    values = {}
    for k, n in nodes.items():
        n["cover"], n["value"] = total[k][2], 0.0
        if n["low_child"] < 0:
            n["value"] = params.learning_rate * params.leaf_value(*total[k][:2])
            values |= {leaf: n["value"] for leaf in under[k]}
    return nodes, values


def _step(margin: Column, label: Column, weight: Column) -> tuple[Column, Column]:
    """Gradient and curvature of the log loss."""
    p = 1 / (1 + F.exp(-margin))
    return weight * (p - label), F.greatest(weight * p * (1 - p), F.lit(1e-16))


def _loss(df: DataFrame) -> float:
    """Weighted mean log loss; log1p of the smaller exponential, so that no margin overflows."""
    m, y = F.col("__margin"), F.col("__label")
    each = F.greatest(m, F.lit(0.0)) - m * y + F.log1p(F.exp(-F.abs(m)))
    return df.agg(F.sum(F.col("__weight") * each) / F.sum("__weight")).first()[0]


@dataclass
class Rows:
    """Stored rows to fit on or to judge by: any number of fits reads them."""

    frame: DataFrame
    share: float  # of the weight that positive rows have
    width: int


def store_rows(df: DataFrame, label: str, weight: str | None = None, ids: list[str] | None = None) -> Rows:
    """With `ids` a row's part in the samples depends on them alone; without, on its place in the stored table."""
    row = F.xxhash64(*ids) if ids else F.monotonically_increasing_id()
    frame = stage(df.select("features", F.col(label).cast("double").alias("__label"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("__weight"),
                            row.alias("__row")))
    found = frame.agg(F.sum(F.col("__weight") * F.col("__label")), F.sum("__weight"), F.max(F.size(vector_to_array("features")))).first()
    return Rows(frame, (found[0] or 0.0) / (found[1] or 1.0), found[2] or 0)


class SecondOrderFit:
    """A fit that goes on from where it stands: `train(n)` adds up to n rounds.

    `train` and `validation` have a `features` vector and a 0/1 label; a row's part in a tree's sample
    depends on its `ids` (see `store_rows`), the seed and the round.  Without validation rows no round
    is better than the last.
    """

    def __init__(self, train: DataFrame | Rows, validation: DataFrame | Rows | None, label: str, weight: str | None = None,
                 params: Params | None = None, bins: int = 32, seed: int = 0, patience: int = 100, ids: list[str] | None = None):
        self.params, self.bins, self.seed, self.patience = params or Params(), bins, seed, patience
        self.trained = 0
        own = train if isinstance(train, Rows) else store_rows(train, label, weight, ids)
        held = validation if validation is None or isinstance(validation, Rows) else store_rows(validation, label)
        share = min(max(own.share, 1e-9), 1 - 1e-9)
        self.model = SecondOrderModel(math.log(share / (1 - share)))
        self.frames = [None if r is None else r.frame.withColumn("__margin", F.lit(self.model.base)) for r in (own, held)]
        self.width = own.width

    @property
    def finished(self) -> bool:
        return self.trained - self.model.kept >= self.patience

    def held_out_auc(self) -> float:
        """Exact ROC area of the margins so far on the validation rows."""
        return float(BinaryClassificationEvaluator(rawPredictionCol="__margin", labelCol="__label", numBins=0).evaluate(self.frames[1]))

    def train(self, rounds: int) -> SecondOrderModel:
        """Go on for up to `rounds` rounds, or until the patience ends; the trees up to the best round."""
        for _ in range(rounds):
            if self.finished:
                break
            self._round()
        return replace(self.model, nodes=self.model.nodes[: self.model.kept])

    def _round(self) -> None:
        p, number = self.params, self.trained
        g, h = _step(F.col("__margin"), F.col("__label"), F.col("__weight"))
        rows = self.frames[0].withColumns({"__g": g, "__h": h})
        if p.subsample < 1:
            unit = F.shiftrightunsigned(F.xxhash64("__row", F.lit(self.seed), F.lit(number)), 11) / float(1 << 53)
            rows = rows.where(unit < p.subsample)
        columns = max(1, round(p.colsample_bytree * self.width))
        slots = sorted(np.random.default_rng([self.seed, number]).permutation(self.width)[:columns].tolist())
        slicer = VectorSlicer(inputCol="features", outputCol="__features", indices=slots)
        grower = DecisionTreeRegressor(featuresCol="__features", labelCol="__target", weightCol="__h", maxDepth=p.max_depth, maxBins=self.bins,
                                       minInstancesPerNode=p.min_data_in_leaf, maxMemoryInMB=MEMORY_MB, seed=self.seed)
        grown = grower.fit(slicer.transform(rows).withColumn("__target", -F.col("__g") / F.col("__h")))
        grown.setLeafCol("__leaf").setPredictionCol("")
        found = grown.transform(slicer.transform(rows)).groupBy("__leaf").agg(F.sum("__g").alias("g"), F.sum("__h").alias("h"), F.count(F.lit(1)).alias("n"))
        sums = {int(r["__leaf"]): (r["g"], r["h"], float(r["n"])) for r in found.collect()}  # one row per leaf
        nodes, values = settled(grown_nodes(grown, slots), sums, p)
        self.model.nodes.append([{"tree": number, **{k: v for k, v in n.items() if k != "leaf"}} for _, n in sorted(nodes.items())])
        value = F.element_at(F.array(*[F.lit(values[k]) for k in sorted(values)]), F.col("__leaf").cast("int") + 1)
        for i, frame in enumerate(self.frames):
            if frame is not None:
                after = grown.transform(slicer.transform(frame)).withColumn("__margin", F.col("__margin") + value).select(*frame.columns)
                self.frames[i] = stage(after) if (number + 1) % STRETCH == 0 else after
        self.trained += 1
        if self.frames[1] is None:
            self.model.kept = self.trained
            return
        self.model.losses.append(_loss(self.frames[1]))
        if self.model.losses[-1] == min(self.model.losses) and self.model.losses.index(self.model.losses[-1]) == number:
            self.model.kept = self.trained


def fit_second_order(
    train: DataFrame | Rows, validation: DataFrame | Rows | None, label: str, rounds: int = 2000, weight: str | None = None,
    params: Params | None = None, bins: int = 32, seed: int = 0, patience: int = 100, ids: list[str] | None = None
) -> SecondOrderModel:
    """Train until `patience` rounds bring no lower loss on the validation rows, or for `rounds`.

    Rows are stored as bin numbers once and every level of a tree is one pass over them (see `together`);
    `SecondOrderFit` reads the vectors again for every level, and walks the trees since margins were written.
    """
    own = train if isinstance(train, Rows) else store_rows(train, label, weight, ids)
    held = validation if validation is None or isinstance(validation, Rows) else store_rows(validation, label)
    together = Together(own, held, [params or Params()], [seed], bins, patience)
    together.train(rounds)
    fit = together.fits[0]
    return SecondOrderModel(together.base, fit.nodes[: fit.kept], fit.losses, fit.kept)


# Ranges of the hyper-parameter search (kind, low, high).
SEARCH_SPACE = {
    "learning_rate": ("log", 0.00001, 0.05),
    "num_leaves": ("int", 16, 60),
    "max_depth": ("int", 1, 3),
    "min_data_in_leaf": ("int", 300, 1000),
    "subsample": ("float", 0.4, 1.0),
    "colsample_bytree": ("float", 0.4, 1.0),
    "reg_lambda": ("float", 50, 300),
    "min_split_gain": ("float", 0, 15),
    "reg_alpha": ("float", 50, 300),
}
SPACE_ROWS = 60_000  # training rows that the ranges are meant for: two folds of 30 % of 300,000


def scaled_space(rows: int, space: dict | None = None) -> dict:
    """The space for a table of another size: what is compared with sums over rows grows with them."""
    out = dict(space or SEARCH_SPACE)
    for name in ("min_data_in_leaf", "reg_lambda", "min_split_gain", "reg_alpha"):
        kind, low, high = out[name]
        out[name] = (kind, max(1, round(low * rows / SPACE_ROWS)), max(1, round(high * rows / SPACE_ROWS))) if kind == "int" else (
            kind, low * rows / SPACE_ROWS, high * rows / SPACE_ROWS)
    return out


def halving_search(
    df: DataFrame, label: str, ids: list[str], trials: int = 200, k: int = 3, rounds: int = 50, growth: int = 2, finalists: int = 2, bins: int = 32,
    weight: str | None = None, seed: int = 0, parallelism: int = 4, space: dict | None = None, patience: int = 50
) -> DataFrame:
    """Random search points, of which ever fewer are trained ever longer: one row per trial and rung.

    All trials train for `rounds` rounds on the rows outside the first of `k` stratified folds.  The best
    third, by the fold's ROC area (ties: the earlier trial), goes on where it stands for `growth` times
    as many rounds in all, and so on, until `finalists` or fewer are left; those are trained anew on
    every fold.  All trials of a rung grow side by side (see `together`).  Columns: rung (from 0; the last is the cross-validation), trial, rounds, folds,
    roc_auc, promoted, and the point.  A fold's rows are stored once for all trials; besides its
    margins a trial keeps nothing, and bad trials end after the first rung.  Bins are cut once per fold.
    """
    folded = stage(stratified_folds(df, label, ids, k, seed))
    parts = [(store_rows(folded.where(F.col("fold") != i), label, weight, ids), store_rows(folded.where(F.col("fold") == i), label)) for i in range(k)]
    points = draw_trials(trials, seed, space or SEARCH_SPACE)
    params = [Params(**p) for p in points]
    spark = df.sparkSession

    def fits(fold: int, own: list[int]) -> Together:
        return Together(*parts[fold], [params[t] for t in own], [seed + t for t in own], bins, patience)

    running, rows, rung, target = list(range(trials)), [], 0, rounds
    first = fits(0, running) if trials > finalists else None
    while len(running) > finalists:
        first.train(target)
        found = first.areas()
        scores = {t: found[f.place] for t, f in zip(running, first.fits, strict=True)}
        best = sorted(running, key=lambda t: (-scores[t], t))[: max(1, -(-len(running) // 3))]
        rows += [(rung, t, f.trained, 1, scores[t], t in best) for t, f in zip(running, first.fits, strict=True)]
        pairs = [(t, f) for t, f in zip(running, first.fits, strict=True) if t in best]
        running = [t for t, _ in pairs]
        first.keep([f for _, f in pairs])
        rung, target = rung + 1, target * growth

    def whole(fold: int) -> dict[tuple[int, int], float]:
        own = fits(fold, running)
        own.train(target)
        found = own.areas()
        return {(t, fold): found[f.place] for t, f in zip(running, own.fits, strict=True)}

    last, areas = running, {}
    if last:
        with ThreadPool(min(parallelism, k)) as pool:
            for found in pool.map(inheritable_thread_target(spark)(whole), range(k)):
                areas |= found
    means = {t: sum(areas[t, fold] for fold in range(k)) / k for t in last}
    winner = min(last, key=lambda t: (-means[t], t)) if last else None
    rows += [(rung, t, target, k, means[t], t == winner) for t in last]
    names = list(asdict(Params()))
    full = [(*r, *[float(asdict(params[r[1]])[c]) for c in names]) for r in rows]
    schema = "rung int, trial int, rounds int, folds int, roc_auc double, promoted boolean, " + ", ".join(f"{c} double" for c in names)
    return spark.createDataFrame(full, schema).orderBy("rung", F.desc("roc_auc"), "trial")
