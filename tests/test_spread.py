"""Rows of a small file are dealt to all tasks before they become wide."""

import numpy as np
from pyspark.sql import functions as F

from loanlens.operators import neighbours
from loanlens.registry import scoring
from loanlens.registry.common import Lending
from loanlens.sources import tables


def one_file(spark, tmp_path, sf_dir):
    for name in ("customer", "orders", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_spread_keeps_rows_and_fills_tasks(spark, tmp_path, monkeypatch):
    spark.range(1000).withColumn("x", F.col("id") % 7).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(tables, "TASK_ROWS", 50)
    out = tables.spread(df, "id")
    assert tasks(df) == 1 < tasks(out)
    assert len(out.inputFiles()) >= 20
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))


def test_requests_and_clients_of_one_file_are_spread(spark, tmp_path, sf_dir):
    folder = one_file(spark, tmp_path, sf_dir)
    assert tasks(scoring.requests(spark, folder)) > 1
    good = scoring._labelled(spark, folder)
    assert tasks(good) > 1 and len(good.inputFiles()) > 1


def test_matrix_is_the_same_from_one_file(spark, tmp_path, sf_dir):
    one, many = (Lending(spark, d).matrix().select("SK_ID_CURR", "APPLICATION_COUNT_PREV") for d in (one_file(spark, tmp_path, sf_dir), sf_dir))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_vectors_of_one_file_meet_the_pivots_in_many_tasks(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(400, 6))
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "features array<double>").coalesce(1)
    vectors = neighbours.distinct_vectors(rows, "features").coalesce(1)
    stored = []

    def stage(df):
        stored.append(tables.stage(df))
        return stored[-1]

    monkeypatch.setattr(neighbours, "stage", stage)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 20)
    found = neighbours.nearest_vectors(vectors, 3).collect()
    points, _, visits = stored
    assert len(points.inputFiles()) >= 15 and len(visits.inputFiles()) >= 15
    at = {r.vid: np.array(r.features) for r in vectors.collect()}
    ids, all_rows = np.array(list(at)), np.array(list(at.values()))
    for vid, own in at.items():
        far = np.sqrt(((all_rows - own) ** 2).sum(1))
        best = [int(i) for i in ids[np.lexsort((ids, far))] if i != vid][:3]
        assert [r.other for r in sorted((r for r in found if r.vid == vid), key=lambda r: r.place)] == best
