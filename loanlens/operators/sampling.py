"""Stratified splits and folds, class weights, undersampling.

Random choices come from a hash of the row identifier and a seed, so a retried task, a different
partitioning and a rerun all choose the same rows.  Class quotas are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.functions.ordering import count_cuts, first_of_class


def class_sizes(df: DataFrame, label: str) -> dict:
    """Rows per class in label order; rows without a label are an error, as no class could take them."""
    rows = df.groupBy(label).count().collect()  # one row per class
    missing = sum(r[1] for r in rows if r[0] is None)
    if missing:
        raise ValueError(f"{missing} rows have no {label}; filter them out first")
    return dict(sorted((r[0], r[1]) for r in rows))


def share_out(sizes: dict, draws: int) -> dict:
    """Distribute draws over classes in proportion to their size, largest remainder first."""
    total = sum(sizes.values())
    exact = {k: n * draws / total for k, n in sizes.items()}
    quota = {k: math.floor(x) for k, x in exact.items()}
    spare = draws - sum(quota.values())
    for k in sorted(sizes, key=lambda k: -(exact[k] - quota[k]))[:spare]:
        quota[k] += 1
    return quota


def stratified_split(
    df: DataFrame, label: str, ids: list[str], test_size: float = 0.2, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(train, test) with exact class quotas: ceil(test_size * n) test rows, classes in proportion."""
    marked = mark_train(df, label, ids, test_size, seed)
    return marked.filter("taken").drop("taken"), marked.filter(~F.col("taken")).drop("taken")


def mark_train(df: DataFrame, label: str, ids: list[str], test_size: float = 0.2, seed: int = 0) -> DataFrame:
    """The split as a flag: `taken` is true for training rows."""
    sizes = class_sizes(df, label)
    n = sum(sizes.values())
    return first_of_class(df, label, ids, seed, share_out(sizes, n - math.ceil(test_size * n)))


def hash_split(df: DataFrame, ids: list[str], test_size: float = 0.2, seed: int = 0) -> Column:
    """Row-local alternative with an expected quota: true for training rows, no pass over the data."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *ids), 11) >= F.lit(int(test_size * 2 ** 53))


def stratified_folds(df: DataFrame, label: str, ids: list[str], k: int = 3, seed: int = 0, name: str = "fold") -> DataFrame:
    """Add a fold number 0..k-1; fold sizes differ by at most one, overall and per class.

    A fold is a range of each class's hash order.  Dealt in turn, class after class, the rows give
    the sizes; the k - 1 keys where folds end are located, and rows are compared with those.
    """
    places, start = {}, 0
    for value, n in class_sizes(df, label).items():
        sizes = [len(range((f - start) % k, n, k)) for f in range(k)]
        places[value] = [sum(sizes[:f]) for f in range(1, k)]
        start += n
    return count_cuts(df, label, ids, seed, places, name)


def minority_majority(sizes: dict) -> tuple:
    if len(sizes) != 2:
        raise ValueError(f"two classes expected, found {sorted(sizes)}")
    small, large = sorted(sizes, key=lambda k: (sizes[k], k))
    return small, large


def undersample(df: DataFrame, label: str, ids: list[str], ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """Keep all minority rows and int(n_minority / ratio) majority rows, without replacement."""
    sizes = class_sizes(df, label)
    small, large = minority_majority(sizes)
    wanted = int(sizes[small] / ratio)
    if wanted > sizes[large]:
        raise ValueError(f"ratio {ratio} needs {wanted} majority rows, there are {sizes[large]}")
    marked = first_of_class(df, label, ids, seed, {small: sizes[small], large: wanted})
    return marked.filter("taken").drop("taken")


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Weight n / (classes * n_class), so that every class weighs the same in total."""
    sizes = class_sizes(df, label)
    n = sum(sizes.values())
    kind = df.schema[label].dataType.simpleString()
    rows = [(value, n / (len(sizes) * size)) for value, size in sizes.items()]
    weights = df.sparkSession.createDataFrame(rows, f"__label {kind}, `{name}` double")
    return df.join(F.broadcast(weights), F.col(label) == F.col("__label"), "left").drop("__label")  # one row per class


def positive_weight(df: DataFrame, label: str) -> float:
    """Weight of a positive row that balances it against the negatives."""
    sizes = class_sizes(df, label)
    return sizes[0] / sizes[1]
