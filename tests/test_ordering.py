import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loanlens.functions import ordering


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(7)
    hot = np.where(rng.random(3000) < 0.4, 0.0, rng.normal(size=3000) * 10.0 ** rng.integers(-3, 6, 3000))
    return pd.DataFrame({"id": range(3000), "a": hot, "b": rng.integers(0, 9, 3000).astype(float), "g": rng.integers(0, 3, 3000)})


def test_value_ranks_give_average_ranks(spark, values):
    ranked = ordering.value_ranks(spark.createDataFrame(values), ["a", "b"], ranges=16).toPandas()
    for c in ("a", "b"):
        part = ranked[ranked.column == c].sort_values("value")
        expected = values[c].rank().groupby(values[c]).first().sort_index()
        assert np.allclose(part.before_n + (part.n + 1) / 2, expected.to_numpy())


def test_quantiles_interpolate(spark, values):
    probabilities = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p99": 0.99}
    df = spark.createDataFrame(values)
    got = ordering.quantiles(df, ["a", "b"], probabilities, by=["g"], ranges=16).toPandas().set_index(["g", "column"])
    for g, part in values.groupby("g"):
        for c in ("a", "b"):
            for name, p in probabilities.items():
                assert got.loc[(g, c), name] == pytest.approx(np.quantile(part[c], p))


def test_quantiles_ignore_missing_and_single(spark):
    df = spark.createDataFrame([(None,), (5.0,), (float("nan"),)], "x double")
    assert ordering.quantiles(df, ["x"], {"m": 0.5}).first()["m"] == 5.0
    four = spark.createDataFrame([(float(i),) for i in range(1, 5)], "x double")
    assert ordering.quantiles(four, ["x"], {"q": 0.25}).first()["q"] == 1.75
    assert ordering.quantiles(four, ["x"], {"q": 0.25}, exact=False).first()["q"] == 1.0


def test_first_at_latest_tie_and_missing_month(spark):
    df = spark.createDataFrame(
        [(1, -1, 10.0, 2), (1, -1, 20.0, 1), (1, -5, 30.0, 0), (2, None, 7.0, 0), (3, -2, None, 0), (3, -9, 1.0, 1)],
        "k int, m int, v double, t long")
    got = dict(df.groupBy("k").agg(ordering.first_at_latest(F.col("v"), F.col("m"), F.col("t"))).collect())
    assert got == {1: 20.0, 2: None, 3: None}


def test_hash_order_is_a_permutation_independent_of_partitioning(spark, values):
    df = spark.createDataFrame(values[["id", "g"]])
    one = ordering.hash_order(df, "g", ["id"], 3).toPandas().sort_values("id")
    two = ordering.hash_order(df.repartition(7).orderBy(F.desc("id")), "g", ["id"], 3).toPandas().sort_values("id")
    assert one.position.tolist() == two.position.tolist()
    for _, part in one.groupby("g"):
        assert sorted(part.position) == list(range(len(part)))


def test_first_of_class_takes_exactly_the_quota(spark, values):
    df = spark.createDataFrame(values[["id", "g"]])
    quotas = {0: 17, 1: 0, 2: int((values.g == 2).sum())}
    got = ordering.first_of_class(df, "g", ["id"], 5, quotas).toPandas()
    assert got[got.taken].groupby("g").size().to_dict() == {0: 17, 2: quotas[2]}
    both = ordering.hash_order(df, "g", ["id"], 5).toPandas().merge(got[["id", "taken"]], on="id")
    assert ((both.position < both.g.map(quotas)) == both.taken).all()
