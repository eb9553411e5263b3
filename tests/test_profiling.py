import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loanlens.operators import profiling


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": range(800), "x": rng.gamma(2, 100, 800).round(2), "y": rng.integers(0, 4, 800).astype(float),
                        "c": rng.choice(["a", "b", "z"], 800, p=[0.8, 0.15, 0.05]), "t": rng.integers(0, 2, 800)})
    return pdf, spark.createDataFrame(pdf)


def test_histogram_matches_numpy(frame):
    pdf, df = frame
    counts, edges = np.histogram(pdf.x, bins="auto")
    got = profiling.histogram(df, "x", empty=True).orderBy("bin").toPandas()
    present = profiling.histogram(df, "x").orderBy("bin").toPandas()
    assert present.equals(got[got.n > 0].reset_index(drop=True))
    assert got.n.tolist() == counts.tolist()
    assert np.allclose(got.left_edge, edges[:-1]) and np.allclose(got.right_edge, edges[1:])


def test_histogram_of_one_value_and_of_none(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (None,)], "x double")
    assert [tuple(r) for r in profiling.histogram(df, "x").collect()] == [(0, 2.5, 3.5, 2)]
    assert profiling.histogram(df.filter("x is null"), "x", empty=True).first()["n"] == 0


def test_outlier_makes_no_empty_bins(spark):
    df = spark.range(1000).select((F.col("id") / 1000.0).alias("x")).union(spark.sql("select cast(1e9 as double)"))
    assert profiling.histogram(df, "x").count() < 1000


def test_box_stats(frame):
    pdf, df = frame
    got = profiling.box_stats(df, ["x"], hue="t").toPandas().set_index("t")
    for t, part in pdf.groupby("t"):
        q1, q2, q3 = np.quantile(part.x, [0.25, 0.5, 0.75])
        inside = part.x[(part.x >= q1 - 1.5 * (q3 - q1)) & (part.x <= q3 + 1.5 * (q3 - q1))]
        r = got.loc[t]
        assert (r.q1, r["median"], r.q3) == pytest.approx((q1, q2, q3))
        assert (r.whisker_low, r.whisker_high, r.outliers) == (inside.min(), inside.max(), len(part) - len(inside))


def test_describe_matches_pandas(frame):
    pdf, df = frame
    got = profiling.describe(df, ["x", "y"]).toPandas().set_index("column")
    want = pdf[["x", "y"]].describe().T
    assert np.allclose(got.loc[["x", "y"], ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]].astype(float), want)


def test_pearson_uses_pairs_that_are_present(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, None, 4, 5], "b": [2.0, None, 1, 3, 9], "c": [5.0, 4, 3, 2, 0]})
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)]
    got = profiling.pearson_pairs(spark.createDataFrame(rows, "a double, b double, c double"), list("abc")).toPandas()
    want = pdf.corr()
    assert len(got) == 9
    for r in got.itertuples():
        assert r.corr == pytest.approx(want.loc[r.left, r.right])


def test_spearman_with_hot_values(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": range(1500), "a": np.where(rng.random(1500) < 0.5, 0.0, rng.normal(size=1500))})
    pdf["b"] = (pdf.a * 2 + rng.normal(size=1500)).round(1)
    pdf["c"] = pdf.a ** 3
    ranks = pdf[["a", "b", "c"]].rank()
    df = spark.createDataFrame(pdf)
    got = profiling.average_ranks(df, ["a", "b", "c"], ["id"], hot_share=0.01).orderBy("id").toPandas()
    assert np.allclose(got[["a", "b", "c"]], ranks)
    strong = profiling.strong_pairs(profiling.spearman_pairs(df, ["a", "b", "c"], ["id"]), 0.95)
    assert {(r.left, r.right) for r in strong.collect()} == {("a", "c"), ("c", "a")}


def test_crosstab_has_empty_cells(spark):
    df = spark.createDataFrame([("x", "p"), ("x", "p"), ("x", "q"), ("y", "q"), (None, "q")], "r string, c string")
    got = {(r.r, r.c): r.share for r in profiling.crosstab_share(df, "r", "c").collect()}
    assert got == {("x", "p"): 2 / 3, ("x", "q"): 1 / 3, ("y", "p"): 0.0, ("y", "q"): 1.0}


def test_missing_profiles(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, None, "b"), (2, 3, None)], "a int, b int, c string")
    assert {r.column: round(r.missing, 3) for r in profiling.missing_share(df, over=0.5).collect()} == {"b": 0.667}
    assert [tuple(r) for r in profiling.missing_by_row(df).collect()] == [(1, 2), (2, 1)]
    assert {tuple(r) for r in profiling.missing_pattern(df, ["a", "b"]).collect()} == {(0, 1, 1, 1), (1, 1, 1, 2), (0, 0, 1, 0)}
    assert profiling.distinct_values(df).filter(F.col("value").isNull()).count() == 1


def test_many_categories(spark):
    df = spark.range(12_000).select(F.col("id").cast("string").alias("c"), (F.col("id") % 2).alias("r"))
    got = profiling.crosstab_share(df, "r", "c")  # more than a pivot takes
    assert got.count() == 24_000 and got.agg(F.sum("share")).first()[0] == pytest.approx(2.0)


def test_wide_correlations_with_gaps(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(rng.normal(size=(90, 5)) + 1e6, columns=list("abcde"))
    pdf["f"] = 3.0
    pdf.loc[pdf.index % 7 == 0, "b"] = np.nan
    pdf.loc[pdf.index % 5 == 1, "d"] = np.nan
    pdf["id"] = range(90)
    df = spark.createDataFrame(pdf)
    pearson = profiling.pearson_pairs(df, list("abcdef")).toPandas()
    spearman = profiling.spearman_pairs(df, list("abcdef"), ["id"]).toPandas()
    for got, want in ((pearson, pdf[list("abcdef")].corr()), (spearman, pdf[list("abcdef")].corr(method="spearman"))):
        assert len(got) == 36
        for r in got.itertuples():
            expected = want.loc[r.left, r.right]
            assert np.isnan(r.corr) == np.isnan(expected) and (np.isnan(expected) or r.corr == pytest.approx(expected))


def test_rank_correlations_of_many_columns_with_gaps_are_one_plan(spark):
    """60 columns, each with gaps of its own, ties and infinite values: equal to ranking each pair's rows anew."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(150, 4))
    columns = [f"c{k}" for k in range(60)]
    pdf = pd.DataFrame({c: (base[:, k % 4] + rng.normal(size=150)).round(k % 3) for k, c in enumerate(columns)})
    for k, c in enumerate(columns):
        pdf.loc[rng.random(150) < 0.02 * (k % 7 + 1), c] = np.nan
    pdf.loc[3, "c0"], pdf.loc[4, "c1"] = np.inf, -np.inf
    df = spark.createDataFrame(pdf.assign(id=range(150)))
    calls = []
    original = profiling.value_ranks
    profiling.value_ranks = lambda *a, **b: calls.append(1) or original(*a, **b)
    try:
        found = profiling.spearman_pairs(df, columns, ["id"])
    finally:
        profiling.value_ranks = original
    assert len(calls) == 1
    got = found.toPandas().pivot(index="left", columns="right", values="corr")
    want = pdf.replace([np.inf, -np.inf], [1e9, -1e9]).corr(method="spearman")
    assert np.allclose(got.loc[columns, columns].to_numpy(float), want.to_numpy(), atol=1e-9)


def test_rank_correlations_of_odd_tables(spark):
    schema = "id int, a double, b double, c double"
    df = spark.createDataFrame([(1, 1.0, None, 7.0), (2, 2.0, None, 7.0), (3, None, 3.0, 7.0), (4, 4.0, 1.0, None)], schema)
    got = {(r.left, r.right): r.corr for r in profiling.spearman_pairs(df, ["a", "b", "c"], ["id"]).collect()}
    assert len(got) == 9 and got["a", "a"] == 1.0 and got["b", "b"] == 1.0
    assert [got[k] for k in (("a", "b"), ("b", "a"), ("c", "c"), ("a", "c"))] == [None] * 4
    empty = profiling.spearman_pairs(df.limit(0), ["a", "b"], ["id"]).collect()
    assert all(r.corr is None for r in empty)


def test_sparse_crosstab_of_very_many_categories(spark):
    """100,000 x 100,000 categories and few pairs: as many rows as pairs occur."""
    df = spark.range(150_000).select((F.col("id") % 100_000).alias("r"), F.concat(F.lit("c"), (F.col("id") * 7 % 100_003).cast("string")).alias("c"))
    got = profiling.crosstab_pairs(df, "r", "c")
    assert got.count() == 150_000 and got.agg(F.sum("share")).first()[0] == pytest.approx(100_000)
    few = profiling.crosstab_pairs(spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), ("y", None), (None, 2)], "r string, c int"), "r", "c")
    assert {(r.r, r.c): (r.n, r.share) for r in few.collect()} == {("x", 1): (2, 2 / 3), ("x", 2): (1, 1 / 3)}


def test_absent_pairs_keep_the_categories_type(spark):
    df = spark.createDataFrame([(1, 2.5), (1, 7.0), (3, 7.0)], "r int, c double")
    assert {(r.r, r.c): r.share for r in profiling.crosstab_share(df, "r", "c").collect()} == {(1, 2.5): 0.5, (1, 7.0): 0.5, (3, 2.5): 0.0, (3, 7.0): 1.0}
    assert profiling.crosstab_share(df.limit(0), "r", "c").collect() == []
