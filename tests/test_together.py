"""Fits grown side by side against fits grown one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_boosting import frames

from loanlens.operators import boosting
from loanlens.operators.boosting import Params
from loanlens.operators.together import Together, unit


def coarse(spark, n, seed):
    """Few different values, so that the same bins are cut by weight or without."""
    df = frames(spark, n, seed=seed).select("id", "label", *[(F.round(F.col(c) * 2) / 2).alias(c) for c in "abc"], "d")
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df)


def test_units_are_sparks_hashes(spark):
    df = spark.range(-50, 50).select("id", (F.shiftrightunsigned(F.xxhash64("id", F.lit(7), F.lit(3)), 11) / float(1 << 53)).alias("u"))
    rows = df.collect()
    assert unit(np.array([r.id for r in rows]), 7, 3).tolist() == [r.u for r in rows]


def test_same_losses_and_areas_as_one_by_one(spark, monkeypatch):
    monkeypatch.setattr("loanlens.operators.together.STRETCH", 2)  # margins are written on the way
    monkeypatch.setattr("loanlens.operators.together.SUMS_MB", 0)  # a pass for each fit
    train, held = coarse(spark, 600, 3), coarse(spark, 300, 4)
    params = [Params(learning_rate=0.3, reg_lambda=1.0, min_data_in_leaf=5), Params(learning_rate=0.5, max_depth=2, subsample=0.6, colsample_bytree=0.5),
              Params(learning_rate=0.4, reg_alpha=0.5, min_split_gain=0.5, num_leaves=5)]
    parts = boosting.store_rows(train, "label", None, ["id"]), boosting.store_rows(held, "label")
    many = Together(*parts, params, [5, 6, 7], 32, 50)
    many.train(2)
    many.keep(many.fits[1:])
    many.train(4)
    areas = many.areas()
    for fit, p, seed in zip(many.fits, params[1:], (6, 7), strict=True):
        one = boosting.SecondOrderFit(*parts, "label", params=p, seed=seed)
        one.train(4)
        assert fit.losses == pytest.approx(one.model.losses, abs=1e-9) and fit.trained == 4
        assert areas[fit.place] == pytest.approx(one.held_out_auc(), abs=1e-9)
    early = Together(*parts, params[:1], [5], 32, 50)
    early.train(2)
    one = boosting.SecondOrderFit(*parts, "label", params=params[0], seed=5)
    one.train(2)
    assert early.fits[0].losses == pytest.approx(one.model.losses, abs=1e-9)


def test_jobs_do_not_grow_with_the_trials(spark):
    parts = boosting.store_rows(coarse(spark, 200, 3), "label", None, ["id"]), boosting.store_rows(coarse(spark, 100, 4), "label")

    def jobs(trials: int) -> int:
        many = Together(*parts, [Params(min_data_in_leaf=5)] * trials, list(range(trials)), 32, 50)
        group = f"together-{trials}"
        spark.sparkContext.setJobGroup(group, group)
        many.train(1)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(12) <= jobs(2) + 2


def test_many_values_are_cut_at_quantiles(spark):
    df = frames(spark, 800)
    many = Together(boosting.store_rows(df, "label", None, ["id"]), boosting.store_rows(df, "label"), [Params(learning_rate=0.3)], [1], 32, 50)
    assert many.sizes[:3] == [32, 32, 32] and many.sizes[3] == 5
    many.train(4)
    one = boosting.SecondOrderFit(df, df, "label", params=Params(learning_rate=0.3), seed=1)
    one.train(4)
    assert many.fits[0].losses == pytest.approx(one.model.losses, rel=0.03)
