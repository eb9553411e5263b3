"""Tree attribution against the enumeration of all feature subsets, and leaf values against plain sums."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from loanlens.operators import trees

COLUMNS = ["a", "b", "c", "d", "e"]


def numbers(spark, n=600):
    """Repeated splits on a column, a categorical one (kind), a constant one and missing values."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(n):
        a, b, c = rng.random(3).round(2)
        kind = float(rng.integers(0, 6))
        y = a * 2 + (kind in (1, 4)) * b - (c > 0.5) * (a > 0.3) + rng.random() * 0.3
        rows.append((k, float(a), float(b), float(c), kind, 1.0, float(y), int(y > 1.1)))
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double, y double, label int")
    return df.withColumn("d", F.col("d").alias("d", metadata={"ml_attr": {"type": "nominal", "vals": list("uvwxyz"), "name": "d"}}))


def assembled(df):
    return VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(df)


def expected(own, x, known, at=0):
    """A tree's value where only the known features decide; all sides count by their share elsewhere."""
    n = own[at]
    if n["low_child"] < 0:
        return n["value"]
    low, high = own[n["low_child"]], own[n["high_child"]]
    if n["slot"] in known:
        goes_low = x[n["slot"]] <= n["threshold"] if n["threshold"] is not None else x[n["slot"]] in n["low_categories"]
        return expected(own, x, known, n["low_child"] if goes_low else n["high_child"])
    return sum(child["cover"] / n["cover"] * expected(own, x, known, child["node"]) for child in (low, high))


def by_subsets(nodes, weights, x):
    """Shapley values from their definition."""
    own = {}
    for n in nodes:
        own.setdefault(n["tree"], {})[n["node"]] = n
    value = {s: sum(weights[t] * expected(tree, x, s) for t, tree in own.items())
             for k in range(len(x) + 1) for s in combinations(range(len(x)), k)}
    out = []
    for i in range(len(x)):
        others = [j for j in range(len(x)) if j != i]
        total = 0.0
        for k in range(len(x)):
            weight = math.factorial(k) * math.factorial(len(x) - 1 - k) / math.factorial(len(x))
            total += weight * sum(value[tuple(sorted((*s, i)))] - value[s] for s in combinations(others, k))
        out.append(total)
    return out


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_boosted_trees_by_definition(spark, depth):
    df = assembled(numbers(spark))
    model = GBTClassifier(labelCol="label", maxIter=4, maxDepth=depth, seed=1).fit(df)
    leaves = trees.model_paths(model)
    got = trees.tree_attribution(model.transform(df), leaves)
    rows = got.select("features", "attribution", "base", vector_to_array("rawPrediction")[1].alias("raw")).collect()
    assert all(abs(sum(r.attribution) + r.base - r.raw) < 1e-9 for r in rows)
    nodes = trees.tree_nodes(model).collect()
    for r in rows[:25]:
        assert np.allclose(r.attribution, by_subsets(nodes, model.treeWeights, r.features.toArray()), atol=1e-9)
    assert all(abs(r.attribution[4]) < 1e-12 for r in rows)  # the constant column


def test_single_trees_and_forests(spark):
    df = assembled(numbers(spark))
    for model in (DecisionTreeRegressor(labelCol="y", maxDepth=4).fit(df), RandomForestRegressor(labelCol="y", numTrees=3, maxDepth=4, seed=2).fit(df)):
        rows = trees.tree_attribution(model.transform(df), trees.model_paths(model)).select("attribution", "base", "prediction").collect()
        assert all(abs(sum(r.attribution) + r.base - r.prediction) < 1e-9 for r in rows)


def test_long_paths_are_summed_like_short_ones(monkeypatch, spark):
    df = assembled(numbers(spark))
    leaves = trees.model_paths(DecisionTreeRegressor(labelCol="y", maxDepth=7).fit(df))
    x = np.array([r.features.toArray() for r in df.limit(80).collect()])
    short = trees.attributions(x, leaves, [trees._outcomes(p) for p in leaves])
    assert np.allclose(short, trees.attributions(x, leaves, [None] * len(leaves)), atol=1e-12)


def test_missing_values_and_arrays(spark):
    nodes = [dict(tree=0, node=0, value=0.0, cover=4.0, low_child=1, high_child=2, slot=0, threshold=0.5, low_categories=None, categories=-1),
             dict(tree=0, node=1, value=-1.0, cover=1.0, low_child=-1, high_child=-1, slot=-1, threshold=None, low_categories=None, categories=-1),
             dict(tree=0, node=2, value=3.0, cover=3.0, low_child=-1, high_child=-1, slot=-1, threshold=None, low_categories=None, categories=-1)]
    df = spark.createDataFrame([(1, [0.2, 9.0]), (2, [None, 9.0]), (3, [0.7, None])], "id int, features array<double>")
    got = {r.id: (r.attribution, r.base) for r in trees.tree_attribution(df, trees.leaf_paths(nodes)).collect()}
    assert got == {1: ([-3.0, 0.0], 2.0), 2: ([1.0, 0.0], 2.0), 3: ([1.0, 0.0], 2.0)}
    assert trees.tree_attribution(df.limit(0), trees.leaf_paths(nodes)).collect() == []
    assert trees.path_table(spark, trees.leaf_paths(nodes)).orderBy("leaf").collect()[0]["upto"] == 0.5


def test_means(spark):
    df = spark.createDataFrame([([1.0, -2.0],), ([-3.0, 0.0],)], "attribution array<double>")
    assert [tuple(r) for r in trees.mean_attribution(df, ["p", "q"]).collect()] == [("p", 2.0, -1.0), ("q", 1.0, -1.0)]
