"""Queries on synthetic minority rows, over the embedding table (one class against the rest)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.operators import neighbours, smote
from loanlens.registry.common import Lending, rounded


def _one_against_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = Lending(spark, sf_dir).raw("embeddings")
    return vectors.select("vec_id", (F.col("label") == 0).cast("int").alias("minority"),
                          F.transform("embedding", lambda x: x.cast("double")).alias("features"))


def smote_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class sizes after adding synthetic rows."""
    out = smote.oversample(_one_against_rest(spark, sf_dir), "minority", "features", ["vec_id"], ratio=0.5)
    return out.groupBy("minority").agg(F.count(F.lit(1)).alias("n"), F.count("synthetic").alias("made"))


def over_under_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class sizes after adding synthetic rows and dropping majority rows."""
    out = smote.over_under_sample(_one_against_rest(spark, sf_dir), "minority", "features", ["vec_id"], over=0.2, under=0.5)
    return out.groupBy("minority").agg(F.count(F.lit(1)).alias("n"))


def smote_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = smote.synthetic_rows(_one_against_rest(spark, sf_dir), "minority", "features", ["vec_id"], ratio=0.5)
    return out.select("draw", "minority", "features")


def minority_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of the same class, for every distinct vector of class 0."""
    rows = _one_against_rest(spark, sf_dir).filter("minority = 1")
    vectors = neighbours.distinct_vectors(rows, "features")
    named = vectors.join(rows.groupBy("features").agg(F.min("vec_id").alias("vec_id")), "features")
    near = neighbours.nearest_vectors(vectors, 5)
    left, right = named.select("vid", "vec_id"), named.select(F.col("vid").alias("other"), F.col("vec_id").alias("neighbour"))
    return rounded(near.join(left, "vid").join(right, "other").select("vec_id", "neighbour", "place", "distance"))


QUERIES = {f.__name__: f for f in (smote_counts, over_under_counts, smote_rows, minority_neighbours)}

SIZES = """s as (select count(*) filter (where label = 0) as small, count(*) filter (where label <> 0) as large from embeddings)"""

SQL = {
    "smote_counts": f"""with {SIZES}
select 0 as minority, large as n, cast(0 as bigint) as made from s
union all select 1, cast(floor(0.5e0 * large - small) as bigint) + small, cast(floor(0.5e0 * large - small) as bigint) from s""",
    "over_under_counts": f"""with {SIZES}, o as (select small + cast(floor(0.2e0 * large - small) as bigint) as small, large from s)
select 0 as minority, cast(floor(small / 0.5e0) as bigint) as n from o union all select 1, small from o""",
    "minority_neighbours": """with m as (select embedding::double[] as v, min(vec_id) as vec_id from embeddings where label = 0 group by 1),
d as (select a.vec_id, b.vec_id as neighbour, sqrt(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: power(a.v[i] - b.v[i], 2)))) as distance
 from m a join m b on a.vec_id <> b.vec_id),
r as (select *, cast(row_number() over (partition by vec_id order by distance, neighbour) as int) as place from d)
select vec_id, neighbour, place, round(distance + 1e-10, 6) as distance from r where place <= 5""",
}
