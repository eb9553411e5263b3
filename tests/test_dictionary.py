"""Category dictionaries against numbering by hand, small and large."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from loanlens.operators import dictionary, preprocess
from loanlens.operators.preprocess import Blocks

SCHEMA = "id int, c string, d string"
ROWS = [(1, "b", "x"), (2, None, "x"), (3, "a", None), (4, "é", "y"), (5, "b", "x"), (6, "", "z"), (7, "B", "x")]


def plain_codes(values):
    return {v: k for k, v in enumerate(sorted({v for v in values if v is not None}, key=lambda v: v.encode()))}


@pytest.mark.parametrize("broadcast_rows", [100, 0])
def test_codes(spark, broadcast_rows):
    df = spark.createDataFrame(ROWS, SCHEMA)
    listed = dictionary.build_dictionary(df, ["c", "d"])
    c, d = plain_codes([r[1] for r in ROWS]), plain_codes([r[2] for r in ROWS])
    assert {(r["column"], r["value"]): r["code"] for r in listed.collect()} == {**{("c", v): k for v, k in c.items()}, **{("d", v): k for v, k in d.items()}}
    got = dictionary.encode(df, listed, ["c", "d"], ["id"], broadcast_rows=broadcast_rows).collect()
    assert sorted((r.id, r.c, r.c_code, r.d_code) for r in got) == [(i, x, c.get(x), d.get(y)) for i, x, y in ROWS]


@pytest.mark.parametrize("broadcast_rows", [100, 0])
def test_one_hot(spark, broadcast_rows):
    df = spark.createDataFrame(ROWS, SCHEMA)
    listed = dictionary.build_dictionary(df, ["c", "d"], missing="UNKNOWN")
    c, d = plain_codes([r[1] or ("UNKNOWN" if r[1] is None else "") for r in ROWS]), plain_codes([r[2] or "UNKNOWN" for r in ROWS])
    got = dictionary.one_hot(df, listed, ["c", "d"], ["id"], missing="UNKNOWN", vector="v", broadcast_rows=broadcast_rows).collect()
    for r in got:
        x, y = "UNKNOWN" if r.c is None else r.c, "UNKNOWN" if r.d is None else r.d
        assert r.slots == [c[x], len(c) + d[y]]
        assert r.v.size == len(c) + len(d) and r.v.indices.tolist() == r.slots
    names = {r.slot: (r["column"], r["value"]) for r in dictionary.with_slots(listed, ["c", "d"]).collect()}
    assert len(names) == len(c) + len(d) and names[len(c)] == ("d", "UNKNOWN")


@pytest.mark.parametrize("broadcast_rows", [100, 0])
def test_unlisted_categories_are_an_error(spark, broadcast_rows):
    df = spark.createDataFrame(ROWS, SCHEMA)
    listed = dictionary.build_dictionary(df.where("id < 4"), ["c"])
    with pytest.raises(Exception, match="unknown category in c: "):
        dictionary.encode(df, listed, ["c"], ["id"], broadcast_rows=broadcast_rows).collect()


def test_many_categories_with_a_hot_one(spark):
    """200,000 categories and one that fills a third of the rows, over many ranges."""
    df = spark.range(300_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.format_string("%09d", F.col("id") * 7919 % 999_983))).alias("c"))
    listed = dictionary.build_dictionary(df, ["c"])
    checks = listed.agg(F.count("*"), F.min("code"), F.max("code"), F.countDistinct("code")).first()
    assert tuple(checks) == (200_001, 0, 200_000, 200_001)
    assert [r.value for r in listed.where("hot").collect()] == ["hot"]
    got = dictionary.encode(df, listed, ["c"], ["id"], broadcast_rows=0)
    pairs = got.join(listed.select("code", "value"), F.col("c_code") == F.col("code"))
    assert pairs.where("c = value").count() == 300_000
    order = got.orderBy("c").select("c_code").where("c <> 'hot'").limit(5).collect()
    assert [r.c_code for r in order] == [1, 2, 3, 4, 5]


def test_preprocessor_with_a_dictionary_table(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).fillna("q", ["c"])
    blocks = Blocks(order=["ordinal", "ordinal_mean"], ordinal=["c"], ordinal_mean=["d"])
    plain = preprocess.fit_preprocessor(df, blocks, keep_columns=True).transform(df)
    fitted = preprocess.fit_preprocessor(df, blocks, keep_columns=True, dictionary=str(tmp_path / "levels"))
    fitted.write().overwrite().save(str(tmp_path / "model"))
    joined = PipelineModel.load(str(tmp_path / "model")).transform(df)
    assert joined.columns == plain.columns
    kept = ["id", "ordinal__c", "ordinal_mean__d"]
    assert sorted(map(tuple, joined.select(*kept).collect())) == sorted(map(tuple, plain.select(*kept).collect()))
    assert fitted.transform(df.where("id = 1")).first()["features"].toArray().tolist() == plain.where("id = 1").first()["features"].toArray().tolist()


def test_too_many_literals_are_an_error(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError, match="dictionary"):
        preprocess.level_counts(df, ["c"], most=49)
    assert len(preprocess.level_counts(df, ["c"], most=50)["c"]) == 50


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    listed = dictionary.build_dictionary(df, ["c", "d"])
    assert listed.collect() == [] and dictionary.one_hot(df, listed, ["c", "d"], ["id"], vector="v").collect() == []
