"""One test per rule on missing values."""

import pytest
from pyspark.sql import functions as F

from loanlens.functions import nulls
from loanlens.sources import schemas, tables


def one(df, expr):
    return df.agg(expr.alias("x")).first()["x"]


@pytest.fixture
def frame(spark):
    return spark.createDataFrame([(None, 1.0), (0.0, None), (0.0, 2.0)], "a double, b double")


def test_missing_differs_from_any_value(frame):
    assert one(frame, nulls.any_ne("a", 0)) == "YES"
    assert one(frame.filter("a is not null"), nulls.any_ne("a", 0)) == "NO"


def test_missing_never_equals_or_exceeds(frame):
    assert one(frame.filter("a is null"), nulls.any_eq("a", 0)) == "NO"
    assert one(frame.filter("a is null"), nulls.any_gt("b", "a")) == "NO"
    assert one(frame, nulls.any_gt("b", "a")) == "YES"
    assert one(frame, nulls.any_in("a", [5, 6])) == "NO"


def test_keep_unless_keeps_missing(frame):
    assert nulls.keep_unless(frame, F.col("a") < F.col("b")).count() == 2


def test_sum_of_nothing_is_zero(frame):
    assert one(frame.filter("a is null"), nulls.nsum("a")) == 0


@pytest.mark.parametrize("values, expected", [
    ([1.0, 1.0], "NO"), ([1.0, 2.0], "YES"), ([1.0, None], "YES"), ([None, None], "NO"), ([None, 1.0, 1.0], "YES")])
def test_varied_counts_missing_as_a_value(spark, values, expected):
    assert one(spark.createDataFrame([(v,) for v in values], "a double"), nulls.varied("a")) == expected


def test_cap_keeps_missing(spark):
    df = spark.createDataFrame([(None,), (2.0,), (3.0,), (9.0,)], "a double")
    assert [r[0] for r in df.select(nulls.cap_above("a", 3)).collect()] == [None, 2.0, 3.0, 3.0]
    assert [r[0] for r in df.select(nulls.raise_to("a", 3)).collect()] == [None, 3.0, 3.0, 9.0]


def test_flags_of_missing_are_zero(frame):
    assert [r[0] for r in frame.select(nulls.true_or_zero(F.col("b") > 1)).collect()] == [0, 0, 1]


def test_division_by_zero_is_missing(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0), (None, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(nulls.ratio("a", "b")).collect()] == [None, 0.5, None]


def test_nan_becomes_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "a double")
    assert one(nulls.nan_to_null(df), F.avg("a")) == 1.0


def test_row_mean_and_sum(spark):
    df = spark.createDataFrame([(None, None), (1.0, None), (1.0, 2.0)], "a double, b double")
    assert [tuple(r) for r in df.select(nulls.row_mean(["a", "b"]), nulls.row_sum(["a", "b"])).collect()] == [
        (None, 0.0), (1.0, 1.0), (1.5, 3.0)]


def test_masked_update_ignores_missing_masks(spark):
    df = spark.createDataFrame([(None, 1), (1, 1), (2, 1)], "a int, b int")
    assert [r.b for r in nulls.set_where(df, F.col("a") == 1, {"b": None, "zzz": 1}).collect()] == [1, None, 1]


def test_csv_reader_types_and_missing_texts(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text(",SK_ID_BUREAU,MONTHS_BALANCE,STATUS,EXTRA\n0,1,-3,C,x\n1,2.0,NA,nan,y\n2,3,,N/A,z\n3,4,-1.0,null,z\n")
    out = tables.read_csv(spark, str(path), schemas.BUREAU_BALANCE, index_column=True)
    assert out.schema == schemas.BUREAU_BALANCE
    assert [tuple(r) for r in out.orderBy("SK_ID_BUREAU").collect()] == [(1, -3, "C"), (2, None, None), (3, None, None), (4, -1, None)]
    kept = tables.read_csv(spark, str(path), schemas._schema(long=["SK_ID_CURR"], string=["STATUS"]), True, "SK_ID_CURR")
    assert kept.columns == ["SK_ID_CURR", "STATUS"] and kept.count() == 4


def test_parquet_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    tables.write_table(df, str(tmp_path / "t"))
    assert sorted(map(tuple, tables.read_table(spark, str(tmp_path / "t")).collect())) == [(1, "a"), (2, None)]


def test_bucketed_tables_join_without_shuffle(spark, tmp_path):
    for name in ("left_b", "right_b"):
        df = spark.range(100).select(F.col("id").alias("SK_ID_CURR"), F.lit(1).alias(name))
        df.write.mode("overwrite").option("path", str(tmp_path / name)).bucketBy(4, "SK_ID_CURR").sortBy("SK_ID_CURR").saveAsTable(name)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = spark.table("left_b").join(spark.table("right_b"), "SK_ID_CURR", "left")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("drop table left_b")
        spark.sql("drop table right_b")
