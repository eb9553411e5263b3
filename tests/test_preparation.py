import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loanlens.operators import neighbours, preprocess, sampling, smote
from loanlens.operators.preprocess import Blocks
from loanlens.sources import tables


def test_zero_spread_divides_by_one(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 1.0), (None, 1.0)], "a double, b double")
    blocks = Blocks(order=["std", "log_robust"], std=["a"], log_robust=["b"])
    out = preprocess.fit_preprocessor(df, blocks).transform(df)
    assert [list(r.features) for r in out.collect()] == [[0.0, 0.0]] * 3


def test_unseen_category_is_an_error(spark):
    train = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    for block in ("one_hot", "ordinal_mean"):
        model = preprocess.fit_preprocessor(train, Blocks(order=[block], **{block: ["c"]}))
        model.transform(train).collect()
        with pytest.raises(Exception):
            model.transform(spark.createDataFrame([("new",)], "c string")).select(vector_to_array("features")).collect()


def test_fit_on_train_only_and_names(spark, tmp_path):
    train = spark.createDataFrame([(1.0, "it's"), (3.0, None), (None, "b\\c")], "x double, c string")
    model = preprocess.fit_preprocessor(train, Blocks(order=["mean", "one_hot", "passthrough"], mean=["x"], one_hot=["c"], passthrough=["x"]))
    tables.save_model(model, str(tmp_path / "m"))
    out = tables.load_model(str(tmp_path / "m")).transform(spark.createDataFrame([(9.0, None)], "x double, c string"))
    assert preprocess.feature_names(out) == ["x", "c_UNKNOWN", "c_b\\c", "c_it's", "x"]
    assert list(out.first().features.toArray()) == [9.0, 1.0, 0.0, 0.0, 9.0]


def test_any_number_of_categories(spark):
    df = spark.range(12_000).select(F.concat(F.lit("c"), "id").alias("c"))
    assert len(preprocess.level_counts(df, ["c"])["c"]) == 12_000
    model = preprocess.fit_preprocessor(df, Blocks(order=["ordinal_mean"], ordinal_mean=["c"]))
    codes = {r.c: r.features[0] for r in model.transform(df.limit(50)).collect()}
    names = sorted(f"c{i}" for i in range(12_000))
    assert all(names[int(v)] == c for c, v in codes.items())


def test_rows_without_a_label_are_an_error(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(50)], "id long, y int")
    for f in (lambda: sampling.stratified_split(df, "y", ["id"]), lambda: sampling.stratified_folds(df, "y", ["id"]),
              lambda: sampling.undersample(df, "y", ["id"]), lambda: sampling.balanced_weights(df, "y")):
        with pytest.raises(ValueError, match="10 rows have no y"):
            f()


def test_narrow_types(spark):
    df = spark.createDataFrame([(1, 300, 2 ** 40, 0.5, 1e9 + 0.3, "a"), (-128, None, 0, None, 0.0, None)],
                               "a long, b long, c long, d double, e double, f string")
    out = preprocess.narrow_types(df)
    assert dict(out.dtypes) == {"a": "tinyint", "b": "smallint", "c": "bigint", "d": "float", "e": "double", "f": "string"}
    assert tuple(preprocess.narrow_report(df).first()) == (80, 2 * (1 + 2 + 8 + 4 + 8))
    tree = preprocess.categorical_dataset(df, ["a"])
    assert "a" not in tree.columns and {r.f for r in tree.collect()} == {"a", "UNKNOWN"}


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame(pd.DataFrame({"id": range(1003), "y": [int(i % 12 == 0) for i in range(1003)]}))


def test_split_is_exact_disjoint_and_repeatable(labelled):
    train, test = sampling.stratified_split(labelled, "y", ["id"], 0.2, seed=4)
    a, b = ({r.id: r.y for r in d.collect()} for d in (train, test))
    assert len(b) == math.ceil(0.2 * 1003) and not set(a) & set(b) and len(a) + len(b) == 1003
    sizes = Counter(a.values())
    assert abs(sizes[1] - 84 * 802 / 1003) < 1
    again, _ = sampling.stratified_split(labelled.repartition(9), "y", ["id"], 0.2, seed=4)
    assert {r.id for r in again.collect()} == set(a)
    other, _ = sampling.stratified_split(labelled, "y", ["id"], 0.2, seed=5)
    assert {r.id for r in other.collect()} != set(a)


def test_folds_cover_and_balance(labelled):
    got = sampling.stratified_folds(labelled, "y", ["id"], 3).toPandas()
    assert got.id.is_unique and len(got) == 1003
    assert got.groupby("fold").size().max() - got.groupby("fold").size().min() <= 1
    per_class = got.groupby(["y", "fold"]).size().unstack()
    assert (per_class.max(axis=1) - per_class.min(axis=1)).max() <= 1


def test_undersample_and_weights(labelled):
    got = sampling.undersample(labelled, "y", ["id"], 0.5).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in got} == {1: 84, 0: 168}
    with pytest.raises(ValueError):
        sampling.undersample(labelled, "y", ["id"], 0.05)
    assert sampling.positive_weight(labelled, "y") == 919 / 84
    assert labelled.filter(sampling.hash_split(labelled, ["id"], 0.2)).count() == pytest.approx(802, abs=60)


def brute_slots(x, k):
    """Multiset of neighbour vectors of each row by plain pairwise distances."""
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    np.fill_diagonal(d, -1.0)
    return np.sort(d, axis=1)[:, 1:k + 1]


@pytest.mark.parametrize("kind", ["clusters", "copies", "line"])
def test_neighbours_against_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)  # many blocks on little data
    rng = np.random.default_rng(3)
    if kind == "clusters":
        x = rng.normal(size=(220, 4)) + rng.integers(0, 5, (220, 1)) * 50.0
    elif kind == "copies":
        x = np.concatenate([np.tile([1.0, 2.0], (70, 1)), np.repeat(rng.integers(0, 9, (40, 2)).astype(float), 3, axis=0)])
    else:
        x = np.arange(150.0)[:, None] ** 1.5 * np.ones((1, 3))
    k = 5
    df = spark.createDataFrame(pd.DataFrame({"features": x.tolist()}))
    vectors = neighbours.distinct_vectors(df, "features")
    by_id = {r.vid: np.array(r.features) for r in vectors.collect()}
    want = {tuple(v): d for v, d in zip(x, brute_slots(x, k))}
    rows = neighbours.neighbour_slots(vectors, k).collect()
    assert len(rows) == len(by_id)
    for r in rows:
        me = np.array(r.features)
        got = sorted(np.sqrt(((by_id[v] - me) ** 2).sum()) for v in r.slots)
        assert np.allclose(got, want[tuple(me)]), kind


@pytest.mark.parametrize("parts", [1, 9])
def test_ties_go_by_the_vector(spark, parts):
    x = [[0.0, 0.0], [1.0, 0.0], [-1.0, 0.0], [0.0, 1.0], [0.0, -1.0]]
    vectors = neighbours.distinct_vectors(spark.createDataFrame([(v,) for v in x], "features array<double>").repartition(parts), "features")
    names = {r.vid: tuple(r.features) for r in vectors.collect()}
    near = neighbours.nearest_vectors(vectors, 2).collect()
    assert sorted(names[r.other] for r in near if names[r.vid] == (0.0, 0.0)) == [(-1.0, 0.0), (0.0, -1.0)]


def test_synthetic_rows_lie_on_segments(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"id": range(400), "y": [int(i < 40) for i in range(400)], "features": rng.normal(size=(400, 3)).tolist()})
    df = spark.createDataFrame(pdf)
    made = smote.synthetic_rows(df, "y", "features", ["id"], ratio=0.5).collect()
    assert len(made) == int(0.5 * 360 - 40)
    minority = {tuple(v) for v in pdf.features[:40].map(tuple)}
    x = np.array([list(v) for v in minority])
    for r in made:
        a, b, p = np.array(r.base), np.array(r.neighbour), np.array(r.features)
        assert tuple(a) in minority and tuple(b) in minority and r.y == 1
        assert np.linalg.norm(p - a) + np.linalg.norm(p - b) == pytest.approx(np.linalg.norm(a - b))
        nearest = np.sort(np.linalg.norm(x - a, axis=1))[1:6]
        assert np.linalg.norm(a - b) <= nearest[-1] + 1e-9
    again = smote.synthetic_rows(df.repartition(6), "y", "features", ["id"], ratio=0.5).collect()
    assert sorted((r.draw, tuple(r.features)) for r in again) == sorted((r.draw, tuple(r.features)) for r in made)
    both = smote.over_under_sample(df, "y", "features", ["id"], 0.2, 0.5).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in both} == {1: 72, 0: 144}


def test_too_few_minority_rows(spark):
    df = spark.createDataFrame([(i, int(i < 4), [float(i)]) for i in range(100)], "id long, y int, features array<double>")
    with pytest.raises(ValueError):
        smote.synthetic_rows(df, "y", "features", ["id"])
