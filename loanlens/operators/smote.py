"""Synthetic minority rows between neighbouring minority rows (Chawla et al., JAIR 2002)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.functions.ordering import hash_order
from loanlens.operators.neighbours import distinct_vectors, neighbour_slots
from loanlens.operators.sampling import class_sizes, minority_majority, undersample
from loanlens.sources.tables import stage


def _uniform(seed: int, part: str) -> Column:
    """A number in [0, 1) per synthetic row, the same on every attempt."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(part), F.col("draw")), 11) / F.lit(float(2 ** 53))


def synthetic_rows(
    df: DataFrame, label: str, features: str, ids: list[str], ratio: float = 0.2, k: int = 5, seed: int = 0
) -> DataFrame:
    """The synthetic rows alone: (draw, label, base, neighbour, features), features as array<double>.

    int(ratio * n_majority - n_minority) rows are made.  Each takes a random minority row, one of
    its k nearest minority rows and a random point on the segment between them.
    """
    sizes = class_sizes(df, label)
    small, large = minority_majority(sizes)
    wanted = int(ratio * sizes[large] - sizes[small])
    if wanted < 0:
        raise ValueError(f"ratio {ratio} would need fewer minority rows than there are")
    if sizes[small] <= k:
        raise ValueError(f"{sizes[small]} minority rows cannot have {k} neighbours each")
    minority = df.filter(F.col(label) == F.lit(small)).select(label, *ids, F.col(features).alias("features"))
    vectors = distinct_vectors(minority, "features")
    slots = stage(neighbour_slots(vectors, k, seed))

    rows = hash_order(minority, label, ids, seed, "position", rows=sizes[small])
    draws = df.sparkSession.range(wanted).select(F.col("id").alias("draw")).select(
        "draw",
        F.floor(_uniform(seed, "row") * F.lit(float(sizes[small]))).cast("long").alias("position"),
        F.floor(_uniform(seed, "slot") * F.lit(float(k))).cast("int").alias("slot"),
        _uniform(seed, "step").alias("step"),
    )
    # Hot vectors make hot join keys below; the left sides are plain shuffles, which AQE splits.
    based = draws.join(rows.select("position", F.col("features").alias("base")), "position")
    paired = based.join(slots.withColumnRenamed("features", "base"), "base").withColumn(
        "vid", F.get("slots", "slot"))
    ends = paired.join(vectors.select("vid", F.col("features").alias("neighbour")), "vid")
    made = F.zip_with("base", "neighbour", lambda a, b: a + (b - a) * F.col("step"))
    return ends.select("draw", F.lit(small).alias(label), "base", "neighbour", made.alias("features"))


def oversample(
    df: DataFrame, label: str, features: str, ids: list[str], ratio: float = 0.2, k: int = 5, seed: int = 0
) -> DataFrame:
    """All rows plus the synthetic ones, which have no identifier: (label, ids, features, synthetic)."""
    made = synthetic_rows(df, label, features, ids, ratio, k, seed)
    types = {f.name: f.dataType for f in df.schema.fields}
    empty = [F.lit(None).cast(types[c]).alias(c) for c in ids]
    new = made.select(F.col(label).cast(types[label]).alias(label), *empty, F.col("features").alias(features),
                      F.col("draw").alias("synthetic"))
    old = df.select(label, *ids, features, F.lit(None).cast("long").alias("synthetic"))
    return old.unionByName(new)


def over_under_sample(
    df: DataFrame, label: str, features: str, ids: list[str], over: float = 0.2, under: float = 0.5, k: int = 5, seed: int = 0
) -> DataFrame:
    """Synthetic rows up to the first ratio, then majority rows down to the second."""
    more = stage(oversample(df, label, features, ids, over, k, seed))
    return undersample(more, label, [*ids, "synthetic"], under, seed)
