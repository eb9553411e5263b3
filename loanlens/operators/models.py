"""Training, comparison, cross-validation and search of default models with Spark ML.

Inputs are frames with a `features` vector and a 0/1 label, or raw columns for the tree models.
Loops run over models, folds and trials, never over rows.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.functions.nulls import UNKNOWN, numeric_columns, string_columns
from loanlens.operators.sampling import stratified_folds
from loanlens.sources.tables import stage

TREE_MEMORY_MB = 1024
ROUNDS = 2000
PATIENCE = 100

Fit = Callable[[DataFrame], Model]


def auc_evaluator(label: str) -> BinaryClassificationEvaluator:
    """Exact ROC area: with 0 bins the curve is not thinned out."""
    return BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol=label, metricName="areaUnderROC", numBins=0)


def linear_estimator(
    df: DataFrame, label: str, c: float = 1.0, weight: str | None = None, max_iter: int = 100
) -> LogisticRegression:
    """Logistic regression with penalty |w|^2 / 2 + C * (sum of weighted losses).

    Spark minimises the mean loss plus the penalty, hence the strength 1 / (C * total weight).
    """
    total = df.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0]
    estimator = LogisticRegression(
        featuresCol="features", labelCol=label, maxIter=max_iter, regParam=1.0 / (c * total), elasticNetParam=0.0,
        standardization=False)
    return estimator.setWeightCol(weight) if weight else estimator


def tree_estimator(label: str, depth: int = 30, weight: str | None = None, seed: int = 0) -> DecisionTreeClassifier:
    estimator = DecisionTreeClassifier(labelCol=label, maxDepth=depth, seed=seed, maxMemoryInMB=TREE_MEMORY_MB)
    return estimator.setWeightCol(weight) if weight else estimator


def forest_estimator(
    label: str, trees: int = 100, depth: int = 30, weight: str | None = None, seed: int = 0
) -> RandomForestClassifier:
    estimator = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=TREE_MEMORY_MB)
    return estimator.setWeightCol(weight) if weight else estimator


def tree_inputs(df: DataFrame, columns: list[str]) -> tuple[PipelineModel, int]:
    """Pipeline from raw columns to a vector the tree models split on, and the bins it needs.

    One slot per column: texts become category indices (unseen ones an extra category), a missing
    number becomes a value below all others, so that a split can separate it.
    """
    texts = [c for c in string_columns(df) if c in columns]
    numbers = [c for c in numeric_columns(df) if c in columns]
    lows = df.agg(*[F.min(F.col(c).cast("double")).alias(c) for c in numbers]).first().asDict() if numbers else {}
    filled = [f"coalesce(cast(`{c}` as double), cast('{float((lows[c] or 0.0) - 1.0)!r}' as double)) as `number__{c}`"
              for c in numbers]
    filled += [f"coalesce(`{c}`, '{UNKNOWN}') as `text__{c}`" for c in texts]
    stages: list[Transformer] = [SQLTransformer(statement=f"select *, {', '.join(filled)} from __THIS__")]
    bins = 32
    if texts:
        indexer = StringIndexer(inputCols=[f"text__{c}" for c in texts], outputCols=[f"index__{c}" for c in texts],
                                stringOrderType="alphabetAsc", handleInvalid="keep").fit(stages[0].transform(df))
        sizes = [len(labels) for labels in indexer.labelsArray]
        bins = max(bins, max(sizes) + 1)
        stages.append(indexer)
    slots = [f"number__{c}" if c in lows else f"index__{c}" for c in columns]
    stages.append(VectorAssembler(inputCols=slots, outputCol="features"))
    spare = [f"number__{c}" for c in numbers] + [f"{k}__{c}" for k in ("text", "index") for c in texts]
    stages.append(SQLTransformer(statement=f"select * except ({', '.join(f'`{c}`' for c in spare)}) from __THIS__"))
    return PipelineModel(stages), bins


def input_slots(model: Model) -> dict[str, int]:
    """The vector slot of each raw column, for a pipeline that begins with `tree_inputs`; else nothing."""
    assemblers = [s for s in getattr(model, "stages", []) if isinstance(s, VectorAssembler)]
    names = [c.partition("__") for a in assemblers for c in a.getInputCols()]
    if len(assemblers) != 1 or any(kind not in ("number", "index") or not c for kind, _, c in names):
        return {}
    return {c: i for i, (_, _, c) in enumerate(names)}


def boosting_estimator(
    label: str, rounds: int = ROUNDS, bins: int = 32, weight: str | None = None, params: dict | None = None, seed: int = 0
) -> GBTClassifier:
    """Gradient-boosted trees of a given number of rounds."""
    estimator = GBTClassifier(labelCol=label, maxIter=rounds, maxBins=bins, seed=seed, maxMemoryInMB=TREE_MEMORY_MB,
                              **(params or {}))
    return estimator.setWeightCol(weight) if weight else estimator


def best_round(losses: list[float], patience: int) -> int:
    """The round with the least held-out loss, among those up to the first stretch of `patience`
    rounds without a new least."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def fit_boosting(
    train: DataFrame, validation: DataFrame, label: str, columns: list[str], rounds: int = ROUNDS, weight: str | None = None,
    params: dict | None = None, seed: int = 0, patience: int = PATIENCE, first: int | None = None
) -> PipelineModel:
    """Inputs and boosted trees fitted on the training rows, kept up to the best round on the validation rows.

    Spark's own early stop ends at the first round without a gain, so the rounds are trained in
    stretches of `patience`, each time from the start, as Spark can't go on with a fitted model;
    rounds depend on the seed alone, so a longer fit begins with the shorter one.  Stretches double,
    so the rounds trained in all are at most four times those of the last fit.  `first` is the length
    of the first stretch, where an earlier fit tells; it changes the work, not the model.
    """
    inputs, bins = tree_inputs(train, columns)
    weights = [weight] if weight else []
    ready = stage(inputs.transform(train).select("features", label, *weights))  # read in every round
    held_out = stage(inputs.transform(validation).select("features", label, *[F.lit(1.0).alias(w) for w in weights]))
    budget = min(rounds, first or 2 * patience)
    while True:
        model = boosting_estimator(label, budget, bins, weight, params, seed).fit(ready)
        losses = model.evaluateEachIteration(held_out)
        best = best_round(losses, patience)
        if budget == rounds or best + patience <= budget:
            break
        budget = min(rounds, 2 * budget)
    if best < budget:
        model = boosting_estimator(label, best, bins, weight, params, seed).fit(ready)
    return PipelineModel([*inputs.stages, model])


def boosting_rounds(model: PipelineModel) -> int:
    """Number of rounds kept."""
    booster = model.stages[-1]
    assert isinstance(booster, GBTClassificationModel)
    return booster.getNumTrees


def refit_boosting(
    df: DataFrame, model: PipelineModel, label: str, columns: list[str], weight: str | None = None,
    params: dict | None = None, seed: int = 0
) -> PipelineModel:
    """Train on all rows for the number of rounds an earlier fit settled on."""
    inputs, bins = tree_inputs(df, columns)
    ready = stage(inputs.transform(df).select("features", label, *([weight] if weight else [])))
    estimator = boosting_estimator(label, boosting_rounds(model), bins, weight, params, seed)
    return PipelineModel([*inputs.stages, estimator.fit(ready)])


def auc(model: Model, df: DataFrame, label: str) -> float:
    return auc_evaluator(label).evaluate(model.transform(df))


def auc_grid(spark: SparkSession, fits: dict[str, Fit], datasets: dict[str, DataFrame], validation: DataFrame, label: str) -> DataFrame:
    """Validation area of every model trained on every dataset: (model, dataset, roc_auc)."""
    rows = [(name, data, float(auc(fit(train), validation, label))) for data, train in datasets.items() for name, fit in fits.items()]
    return spark.createDataFrame(rows, "model string, dataset string, roc_auc double")


def cross_val_scores(
    estimators: dict[str, Estimator], df: DataFrame, label: str, ids: list[str], k: int = 3, seed: int = 0, parallelism: int = 2
) -> DataFrame:
    """Held-out area per model and fold: (model, fold, roc_auc); folds are stratified."""
    folded = stage(stratified_folds(df, label, ids, k, seed))  # a lost executor costs no preprocessing

    def one(task: tuple[str, int]) -> tuple[str, int, float]:
        name, fold = task
        model = estimators[name].fit(folded.filter(F.col("fold") != fold))
        return name, fold, float(auc(model, folded.filter(F.col("fold") == fold), label))

    tasks = [(name, fold) for name in estimators for fold in range(k)]
    with ThreadPool(parallelism) as pool:
        rows = pool.map(inheritable_thread_target(df.sparkSession)(one), tasks)
    return df.sparkSession.createDataFrame(rows, "model string, fold int, roc_auc double")


def mean_scores(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Comparison table: mean score per model, best first."""
    return scores.groupBy(*(by or ["model"])).agg(F.avg("roc_auc").alias("roc_auc")).orderBy(F.desc("roc_auc"))


# Ranges of the hyper-parameter search (kind, low, high).  Only what Spark's trees know
# is drawn: a leaf limit above 8 never binds at depth 3, and leaf penalties and a floor on the gain in
# units of another loss have no counterpart.
SEARCH_SPACE = {
    "learning_rate": ("log", 0.00001, 0.05),
    "max_depth": ("int", 1, 3),
    "min_data_in_leaf": ("int", 300, 1000),
    "subsample": ("float", 0.4, 1.0),
    "colsample_bytree": ("float", 0.4, 1.0),
}


def draw_trials(trials: int, seed: int = 0, space: dict | None = None) -> list[dict]:
    """Seeded random points of the search space."""
    rng = random.Random(seed)
    out = []
    for _ in range(trials):
        point = {}
        for name, (kind, low, high) in (space or SEARCH_SPACE).items():
            if kind == "log":
                point[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
            else:
                point[name] = rng.randint(low, high) if kind == "int" else rng.uniform(low, high)
        out.append(point)
    return out


def boosting_params(point: dict) -> dict:
    """A search point in the names of Spark's boosted trees."""
    return {
        "stepSize": point["learning_rate"], "maxDepth": point["max_depth"],
        "minInstancesPerNode": point["min_data_in_leaf"], "subsamplingRate": point["subsample"],
        "featureSubsetStrategy": f"{min(point['colsample_bytree'], 0.999999):.6f}",
    }


def random_search(
    df: DataFrame, label: str, ids: list[str], trials: int = 200, k: int = 3, rounds: int = 100, bins: int = 32,
    weight: str | None = None, seed: int = 0, parallelism: int = 2, space: dict | None = None
) -> DataFrame:
    """Mean cross-validated area of random search points, best first: (trial, parameters, roc_auc)."""
    points = draw_trials(trials, seed, space)
    estimator = boosting_estimator(label, rounds, bins, weight, seed=seed)
    maps = [{estimator.getParam(n): v for n, v in boosting_params(p).items()} for p in points]
    folded = stratified_folds(df, label, ids, k, seed)
    search = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=auc_evaluator(label), numFolds=k,
                            foldCol="fold", parallelism=parallelism, seed=seed)
    scores = search.fit(folded).avgMetrics
    rows = [(i, {n: float(v) for n, v in p.items()}, float(s)) for i, (p, s) in enumerate(zip(points, scores))]
    out = df.sparkSession.createDataFrame(rows, "trial int, parameters map<string,double>, roc_auc double")
    return out.orderBy(F.desc("roc_auc"), "trial")


def default_probability(scored: DataFrame) -> DataFrame:
    """Add the probability of the positive class as a plain number."""
    return scored.withColumn("DefaultProbability", vector_to_array("probability")[1])
