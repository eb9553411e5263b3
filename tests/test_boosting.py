"""Second-order boosting against plain sums, its early stop, and its stored form."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from loanlens.operators import boosting, trees
from loanlens.operators.boosting import Params


def frames(spark, n=800, noise=0.4, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        a, b, c = rng.normal(size=3)
        kind = float(rng.integers(0, 5))
        rows.append((k, float(a), float(b), float(c), kind, int(a + (kind in (1, 3)) * b + noise * rng.normal() > 0.3)))
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double, label int")
    df = df.withColumn("d", F.col("d").alias("d", metadata={"ml_attr": {"type": "nominal", "vals": list("uvwxy"), "name": "d"}}))
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df)


def alike(one, two):
    """The same splits, and values that differ by the order of sums at most."""
    pairs = [(n, m) for a, b in zip(one.nodes, two.nodes, strict=True) for n, m in zip(a, b, strict=True)]
    return all([n[c] for c in ("node", "slot", "threshold", "low_categories", "cover")] == [m[c] for c in ("node", "slot", "threshold", "low_categories", "cover")]
               and n["value"] == pytest.approx(m["value"], abs=1e-9) for n, m in pairs)


def test_leaf_values_are_newton_steps(spark):
    """Each leaf's value from all its rows' gradients and curvatures, round after round, by hand."""
    df = frames(spark)
    params = Params(learning_rate=0.3, reg_lambda=2.0, reg_alpha=0.5, max_depth=3, min_data_in_leaf=10)
    model = boosting.fit_second_order(df, None, "label", rounds=4, params=params)
    rows = df.select("features", "label").collect()
    x, y = np.array([r.features.toArray() for r in rows]), np.array([r.label for r in rows], float)
    margin = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    assert model.base == pytest.approx(margin[0]) and len(model.nodes) == 4
    for tree in model.nodes:
        p = 1 / (1 + np.exp(-margin))
        leaf = boosting._walk({n["node"]: {**n, "value": float(n["node"])} for n in tree}, x)
        for n in tree:
            if n["low_child"] < 0:
                g, h = (p - y)[leaf == n["node"]].sum(), (p * (1 - p))[leaf == n["node"]].sum()
                want = -0.3 * np.sign(g) * max(abs(g) - 0.5, 0) / (h + 2)
                assert n["value"] == pytest.approx(want, abs=1e-9) and n["cover"] == (leaf == n["node"]).sum()
        margin += boosting._walk({n["node"]: n for n in tree}, x)
    got = [r.margin for r in model.transform(df).select("margin").collect()]
    assert np.allclose(got, margin, atol=1e-9)


def test_a_round_is_a_pass_for_each_level(spark):
    """Few jobs a round, none for the splits' samples; a table of few values gives the trees that are grown one by one."""
    from test_together import coarse

    train, held = coarse(spark, 400, 3), coarse(spark, 200, 4)

    def jobs(rounds: int) -> int:
        spark.sparkContext.setJobGroup(f"second order {rounds}", "")
        boosting.fit_second_order(train, held, "label", rounds=rounds, params=Params(max_depth=2, min_data_in_leaf=5))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"second order {rounds}"))

    assert jobs(5) - jobs(2) <= 3 * (3 * 2 + 1)  # two levels and the loss, each with one shuffle
    params = Params(learning_rate=0.4, max_depth=3, min_data_in_leaf=5, reg_lambda=1.0)
    model = boosting.fit_second_order(train, held, "label", rounds=4, params=params)
    one = boosting.SecondOrderFit(train, held, "label", params=params)
    one.train(4)
    assert model.losses == pytest.approx(one.model.losses, abs=1e-9)
    x = np.array([r.features.toArray() for r in held.select("features").collect()])
    for a, b in zip(model.nodes, one.model.nodes, strict=False):
        assert np.allclose(boosting._walk({n["node"]: n for n in a}, x), boosting._walk({n["node"]: n for n in b}, x), atol=1e-9)


def test_gain_floor_and_leaf_limit():
    """A tree of four leaves: the weak split goes by the floor, the next weakest by the limit."""
    leaf = lambda node, number: {"node": node, "low_child": -1, "high_child": -1, "slot": -1, "threshold": None, "low_categories": None, "categories": -1, "leaf": number}
    split = lambda node, low, high: {**leaf(node, None), "low_child": low, "high_child": high, "slot": 0, "threshold": 0.0}
    nodes = {0: split(0, 1, 4), 1: split(1, 2, 3), 2: leaf(2, 0), 3: leaf(3, 1), 4: split(4, 5, 6), 5: leaf(5, 2), 6: leaf(6, 3)}
    sums = {0: (-4.0, 2.0, 9.0), 1: (-4.2, 2.0, 9.0), 2: (3.0, 2.0, 9.0), 3: (6.0, 2.0, 9.0)}
    gain = lambda a, b: a[0] ** 2 / a[1] + b[0] ** 2 / b[1] - (a[0] + b[0]) ** 2 / (a[1] + b[1])
    assert gain(sums[0], sums[1]) < 0.1 < gain(sums[2], sums[3]) < 5
    full, _ = boosting.settled(nodes, sums, Params(learning_rate=1.0))
    assert len(full) == 7
    floor, values = boosting.settled(nodes, sums, Params(learning_rate=1.0, min_split_gain=0.1))
    assert sorted(floor) == [0, 1, 4, 5, 6] and values[0] == values[1] == pytest.approx(8.2 / 4)
    limit, values = boosting.settled(nodes, sums, Params(learning_rate=1.0, num_leaves=2))
    assert sorted(limit) == [0, 1, 4] and values[2] == values[3] == pytest.approx(-9 / 4)
    stump, values = boosting.settled(nodes, sums, Params(learning_rate=1.0, min_split_gain=1e9))
    assert sorted(stump) == [0] and all(v == pytest.approx(-0.8 / 8) for v in values.values())


def test_early_stop_goes_on_instead_of_starting_anew(spark):
    """Noise is soon learnt by heart: the fit ends `patience` rounds after the best one."""
    train, held_out = frames(spark, 300, noise=3.0), frames(spark, 300, noise=3.0, seed=4)
    options = {"params": Params(learning_rate=0.8, max_depth=4, min_data_in_leaf=2), "patience": 3}
    fit = boosting.SecondOrderFit(train, held_out, "label", **options)
    model = fit.train(40)
    assert fit.finished and fit.trained == model.kept + 3 == len(model.losses) and len(model.nodes) == model.kept
    assert model.losses[model.kept - 1] == min(model.losses)
    assert fit.train(5).losses == model.losses  # nothing more is trained
    parts = boosting.SecondOrderFit(train, held_out, "label", **options)
    parts.train(2)
    again = parts.train(38)
    assert np.allclose(again.losses, model.losses) and alike(again, model)


def test_shares_of_rows_and_columns(spark):
    df = frames(spark)
    params = Params(subsample=0.5, colsample_bytree=0.5, learning_rate=0.3)
    one, two = (boosting.fit_second_order(df, None, "label", rounds=3, params=params, seed=s) for s in (1, 1))
    assert alike(one, two)
    assert all(len({n["slot"] for n in tree} - {-1}) <= 2 for tree in one.nodes)
    assert all(300 < tree[0]["cover"] < 500 for tree in one.nodes)


def test_weights_store_and_attribution(spark, tmp_path):
    df = frames(spark).withColumn("w", F.when(F.col("label") == 1, 3.0).otherwise(1.0))
    model = boosting.fit_second_order(df, None, "label", rounds=3, weight="w")
    plain = boosting.fit_second_order(df, None, "label", rounds=3)
    assert model.base > plain.base
    path = str(tmp_path / "nodes")
    model.node_table(spark).write.parquet(path)
    loaded = boosting.load_second_order(spark.read.parquet(path), model.base)
    scored = [m.transform(df).select("id", "margin").orderBy("id").collect() for m in (model, loaded)]
    assert scored[0] == scored[1]
    explained = trees.tree_attribution(model.transform(df), model.paths()).collect()
    assert all(abs(sum(r.attribution) + r.base + model.base - r.margin) < 1e-9 for r in explained)


def test_halving_promotes_the_best_third(spark):
    df = frames(spark, 240)
    space = {**boosting.scaled_space(160), "learning_rate": ("log", 0.01, 0.5)}
    options = dict(trials=7, k=2, rounds=1, finalists=1, space=space, seed=5)
    rows = boosting.halving_search(df, "label", ["id"], **options).collect()
    by_rung = {}
    for r in rows:
        by_rung.setdefault(r.rung, []).append(r)
    assert [len(by_rung[k]) for k in sorted(by_rung)] == [7, 3, 1]
    assert [{r.rounds for r in by_rung[k]} for k in sorted(by_rung)] == [{1}, {2}, {4}]
    assert {r.folds for r in by_rung[2]} == {2}
    for k in (0, 1):
        best = sorted(by_rung[k], key=lambda r: (-r.roc_auc, r.trial))[: len(by_rung[k + 1])]
        assert {r.trial for r in best} == {r.trial for r in by_rung[k + 1]} == {r.trial for r in by_rung[k] if r.promoted}
    again = boosting.halving_search(df, "label", ["id"], **options).collect()
    assert [(r.rung, r.trial, r.promoted) for r in again] == [(r.rung, r.trial, r.promoted) for r in rows]
    assert [r.roc_auc for r in again] == pytest.approx([r.roc_auc for r in rows])
    assert all(0.4 <= r.subsample <= 1 and 16 <= r.num_leaves <= 60 for r in rows)


def test_space_grows_with_the_table():
    assert boosting.scaled_space(boosting.SPACE_ROWS) == boosting.SEARCH_SPACE
    assert boosting.scaled_space(600)["reg_alpha"] == ("float", 0.5, 3.0) and boosting.scaled_space(600)["min_data_in_leaf"] == ("int", 3, 10)
    assert len(boosting.SEARCH_SPACE) == 9
