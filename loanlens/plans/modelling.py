"""From the client matrix to trained, compared and stored models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.operators import models, preprocess, profiling, sampling, smote
from loanlens.sources.tables import stage


@dataclass
class Prepared:
    """Vectors of the training and validation rows, and the preprocessor learned on the former."""

    train: DataFrame
    validation: DataFrame
    preprocessor: PipelineModel


def prepare(df: DataFrame, label: str, ids: list[str], blocks: preprocess.Blocks, test_size: float = 0.2, seed: int = 0) -> Prepared:
    """Split first, learn the preprocessing on the training rows only, then store both vector frames.

    The training rows are stored before fitting, which reads them several times.
    """
    train, validation = sampling.stratified_split(df, label, ids, test_size, seed)
    train = stage(train)
    fitted = preprocess.fit_preprocessor(train, blocks)
    ready = [stage(fitted.transform(part).select(*ids, label, "features")) for part in (train, validation)]
    return Prepared(ready[0], ready[1], fitted)


def balanced_datasets(train: DataFrame, label: str, ids: list[str], over: float = 0.2, under: float = 0.5) -> dict[str, DataFrame]:
    """Three ways to balance: synthetic plus dropped rows, dropped rows, and weights; all with `weight`."""
    arrays = train.withColumn("features", vector_to_array("features"))
    mixed = smote.over_under_sample(arrays, label, "features", ids, over, under)
    one = F.lit(1.0).alias("weight")
    return {
        "Over_under": stage(mixed.select(label, array_to_vector("features").alias("features"), one)),
        "Under": stage(sampling.undersample(train, label, ids).select(label, "features", one)),
        "Balanced": sampling.balanced_weights(train, label).select(label, "features", "weight"),
    }


def redundant_pairs(matrix: DataFrame, one_hot: list[str], ids: list[str], threshold: float = 0.95) -> DataFrame:
    """Strongly rank-correlated pairs of encoded columns."""
    encoded = stage(preprocess.encode_for_correlation(matrix, one_hot, ids=ids))
    columns = [c for c in encoded.columns if c not in ids]
    return profiling.strong_pairs(profiling.spearman_pairs(encoded, columns, ids), threshold)


def linear_scorer(df: DataFrame, label: str, ids: list[str], blocks: preprocess.Blocks, max_iter: int = 700) -> PipelineModel:
    """Preprocessing and linear model on all undersampled rows, as one model to store and score with."""
    under = stage(sampling.undersample(df, label, ids))
    fitted = preprocess.fit_preprocessor(under, blocks)
    ready = stage(fitted.transform(under).select(label, "features"))  # read in every pass of the fit
    return PipelineModel([*fitted.stages, models.linear_estimator(ready, label, max_iter=max_iter).fit(ready)])


def tree_scorer(df: DataFrame, label: str, ids: list[str], columns: list[str], rounds: int = models.ROUNDS, weight: str | None = None) -> PipelineModel:
    """Boosted trees: rounds chosen on held-out rows, then trained on all rows."""
    train, validation = (stage(part) for part in sampling.stratified_split(df, label, ids))
    chosen = models.fit_boosting(train, validation, label, columns, rounds, weight)
    return models.refit_boosting(df, chosen, label, columns, weight)
