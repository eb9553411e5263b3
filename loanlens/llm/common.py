"""What the operators of this subpackage share."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.sources.tables import stage

WORD = r"[^\x20\x09-\x0D]+"  # a word: anything but ASCII white space


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def with_id(df: DataFrame, name: str, *others: str) -> DataFrame:
    """The id column as text, for pandas, which makes floats of longs that stand among nulls; and others."""
    return df.select(F.col(name).cast("long").cast("string").alias(name), *others)


def word_count(text):
    """Words of a text; 0 where it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """Label every node of an undirected graph with the least node it can reach.

    `edges` has two long columns a, b; the result has node, label.  Large-star and small-star steps
    alternate until no edge changes: a node is joined with one row (the least neighbour), never
    with its neighbourhood, so a star that holds a third of all edges costs its edges and no more.
    Every step is written to the shared folder, which cuts the lineage and survives lost executors.
    """
    now = stage(_directed(edges))
    before = None
    while True:
        least = _least(now.select(F.col("a").alias("u"), F.col("b").alias("v"))
                       .union(now.select(F.col("b").alias("u"), F.col("a").alias("v"))))
        # Large star: every greater neighbour of u moves to u's least neighbour.  Of the edges (a > b)
        # a is greater for u = b.
        large = now.join(least.withColumnRenamed("u", "b"), "b").select("a", F.col("m").alias("b"))
        large = _directed(large)
        # Small star: every smaller neighbour of u, and u itself, moves to the least of them.
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stage(_directed(moved.union(small.select("a", F.col("m").alias("b")))))
        state = now.agg(
            F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))
        ).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)


def _directed(edges: DataFrame) -> DataFrame:
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
