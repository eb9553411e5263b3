"""Fitted trees as tables of their nodes and leaf paths, and the exact share of every feature in every score.

An ensemble's size depends on its parameters alone, so its leaf paths travel to the rows and no row is
shuffled or collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.sources.tables import scratch_folder

LOOKED_UP = 8  # features of a path up to which all its outcomes are tabled
NODES = "tree int, node int, value double, cover double, low_child int, high_child int, slot int, threshold double, low_categories array<double>, categories int"


@dataclass
class Leaf:
    """A leaf's value times its tree's weight, and what its path asks of each feature it tests.

    absent[k] is the share of training rows that follow the path through all splits on slots[k].
    """

    tree: int
    node: int
    value: float
    slots: list[int] = field(default_factory=list)
    above: list[float] = field(default_factory=list)
    upto: list[float] = field(default_factory=list)
    among: list[list[tuple[list[float], bool]]] = field(default_factory=list)
    absent: list[float] = field(default_factory=list)

    def met(self, x: np.ndarray) -> np.ndarray:
        """Which rows of a matrix meet each feature's conditions; a missing value goes to the high child."""
        out = np.ones((len(x), len(self.slots)), bool)
        for k, slot in enumerate(self.slots):
            v = x[:, slot]
            if self.above[k] > -math.inf:
                out[:, k] &= ~(v <= self.above[k])
            if self.upto[k] < math.inf:
                out[:, k] &= v <= self.upto[k]
            for categories, inside in self.among[k]:
                out[:, k] &= np.isin(v, categories) == inside
        return out


def tree_nodes(model: Model) -> DataFrame:
    """The nodes of a fitted tree, forest or boosted ensemble, as it stores them (see NODES)."""
    booster = model.stages[-1] if isinstance(model, PipelineModel) else model
    spark = SparkSession.getActiveSession()
    path = f"{scratch_folder(spark)}/model"
    booster.write().save(path)
    stored = spark.read.parquet(f"{path}/data")
    node = F.col("nodeData") if "nodeData" in stored.columns else F.struct("*")
    rows = stored.select(F.col("treeID").alias("tree") if "treeID" in stored.columns else F.lit(0).alias("tree"), node.alias("n"))
    split = F.col("n.split.leftCategoriesOrThreshold")
    continuous = F.col("n.split.numCategories") == -1
    return rows.select(
        "tree", F.col("n.id").alias("node"), F.col("n.prediction").alias("value"), F.get("n.impurityStats", F.lit(0)).alias("cover"),
        F.col("n.leftChild").alias("low_child"), F.col("n.rightChild").alias("high_child"), F.col("n.split.featureIndex").alias("slot"),
        F.when(continuous, F.get(split, F.lit(0))).alias("threshold"), F.when(~continuous, split).alias("low_categories"),
        F.col("n.split.numCategories").alias("categories"))


def leaf_paths(nodes: Iterable, weights: list[float] | None = None) -> list[Leaf]:
    """The paths from the roots (node 0) to all leaves; `nodes` are rows of NODES."""
    trees: dict[int, dict] = {}
    for n in nodes:
        trees.setdefault(n["tree"], {})[n["node"]] = n
    out = []
    for tree, own in sorted(trees.items()):
        weight = 1.0 if weights is None else weights[tree]
        open_paths = [(0, Leaf(tree, 0, 0.0))]
        while open_paths:
            at, path = open_paths.pop()
            n = own[at]
            if n["low_child"] < 0:
                path.node, path.value = at, weight * n["value"]
                out.append(path)
                continue
            for child, low in ((n["low_child"], True), (n["high_child"], False)):
                share = own[child]["cover"] / n["cover"] if n["cover"] else 0.5
                open_paths.append((child, _extended(path, n, low, share)))
    return sorted(out, key=lambda leaf: (leaf.tree, leaf.node))


def _extended(path: Leaf, n, low: bool, share: float) -> Leaf:
    """The path one split further; splits on one feature are one condition."""
    new = Leaf(path.tree, 0, 0.0, [*path.slots], [*path.above], [*path.upto], [[*a] for a in path.among], [*path.absent])
    if n["slot"] not in new.slots:
        new.slots.append(n["slot"])
        new.above.append(-math.inf)
        new.upto.append(math.inf)
        new.among.append([])
        new.absent.append(1.0)
    k = new.slots.index(n["slot"])
    new.absent[k] *= share
    if n["threshold"] is not None:
        if low:
            new.upto[k] = min(new.upto[k], n["threshold"])
        else:
            new.above[k] = max(new.above[k], n["threshold"])
    else:
        # a value that is no category goes with the side that has more of them
        left = set(n["low_categories"])
        if 2 * len(left) <= n["categories"]:
            new.among[k].append((sorted(left), low))
        else:
            new.among[k].append((sorted(set(map(float, range(n["categories"]))) - left), not low))
    return new


def model_paths(model: Model) -> list[Leaf]:
    """The leaf paths of a fitted regression tree, forest or boosted model, by which its raw score adds up."""
    booster = model.stages[-1] if isinstance(model, PipelineModel) else model
    weights = list(getattr(booster, "treeWeights", [1.0]))
    if "RandomForest" in type(booster).__name__:
        weights = [1 / len(weights)] * len(weights)
    return leaf_paths(tree_nodes(model).collect(), weights)  # as large as the model


def path_table(spark: SparkSession, leaves: list[Leaf]) -> DataFrame:
    """tree, leaf, value, slot, above, upto, absent_share: one row per leaf and feature tested on its path."""
    rows = [(p.tree, p.node, p.value, s, a, u, z) for p in leaves for s, a, u, z in zip(p.slots, p.above, p.upto, p.absent, strict=True)]
    return spark.createDataFrame(rows, "tree int, leaf int, value double, slot int, above double, upto double, absent_share double")


def shapley(present: np.ndarray, absent: np.ndarray) -> np.ndarray:
    """For a path's value of 1: each feature's mean share over all orders in which features become known.

    A known feature multiplies by whether the row meets its conditions (`present`), an unknown one by
    the share of rows that do (`absent`).  Orders are summed by how many of the others are known.
    """
    n, m = present.shape
    weight = np.array([math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)])
    out = np.empty((n, m))
    for i in range(m):
        known = np.zeros((n, m))  # column k: sum over the sets of k known others
        known[:, 0] = 1
        for j in range(m):
            if j != i:
                known[:, 1:] = known[:, 1:] * absent[j] + known[:, :-1] * present[:, [j]]
                known[:, 0] *= absent[j]
        out[:, i] = (present[:, i] - absent[i]) * (known @ weight)
    return out


def _outcomes(leaf: Leaf) -> np.ndarray | None:
    """The shares for each outcome of the path's tests, by the outcome's bits."""
    m = len(leaf.slots)
    if m > LOOKED_UP:
        return None
    bits = (np.arange(1 << m)[:, None] >> np.arange(m)[None, :]) & 1
    return leaf.value * shapley(bits.astype(float), np.array(leaf.absent))


def attributions(x: np.ndarray, leaves: list[Leaf], tables: list[np.ndarray | None]) -> np.ndarray:
    """Each row's shares, one column per feature."""
    out = np.zeros(x.shape)
    for leaf, known in zip(leaves, tables, strict=True):
        if not leaf.slots:
            continue
        met = leaf.met(x)
        if known is not None:
            out[:, leaf.slots] += known[met @ (1 << np.arange(len(leaf.slots)))]
        else:  # rows fall into few of the many outcomes
            kinds, of = np.unique(met, axis=0, return_inverse=True)
            out[:, leaf.slots] += (leaf.value * shapley(kinds.astype(float), np.array(leaf.absent)))[of.reshape(-1)]
    return out


def base_score(leaves: list[Leaf]) -> float:
    """The mean raw score over the training rows: what is left when no feature is known."""
    return float(sum(leaf.value * math.prod(leaf.absent) for leaf in leaves))


def tree_attribution(df: DataFrame, leaves: list[Leaf], features: str = "features", attribution: str = "attribution", base: str = "base") -> DataFrame:
    """Add each row's share of every feature in its raw score (an array by slot) and the score's mean.

    The shares are the exact Shapley values of the trees when a feature that is not known leaves rows
    to both sides of its splits as in training.  They and `base` add up to the raw score.  `features` is
    a vector or an array of numbers; a null feature is missing.  Rows stay where they are.
    """
    tables = [_outcomes(leaf) for leaf in leaves]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def explain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            x = np.array([np.asarray(v, dtype=float) for v in b]) if len(b) else np.zeros((0, 0))
            yield pd.Series(list(attributions(x, leaves, tables)), dtype=object)

    values = F.col(features)
    if not isinstance(df.schema[features].dataType, T.ArrayType):
        values = vector_to_array(values)
    return df.withColumn(attribution, explain(values)).withColumn(base, F.lit(base_score(leaves)))


def mean_attribution(explained: DataFrame, names: list[str], attribution: str = "attribution") -> DataFrame:
    """feature, importance, mean_share: the mean size and the mean of each feature's share, largest first.

    One row per feature and task is shuffled.
    """
    cells = explained.select(F.posexplode(attribution).alias("slot", "share"))
    label = F.array(*[F.lit(n) for n in names])
    return cells.groupBy("slot").agg(F.avg(F.abs("share")).alias("importance"), F.avg("share").alias("mean_share")).select(
        F.get(label, "slot").alias("feature"), "importance", "mean_share").orderBy(F.desc("importance"), "feature")
