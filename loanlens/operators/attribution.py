"""Which features drive a model: linear attribution, permutation importance, elimination."""

from __future__ import annotations

from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.functions.ordering import hash_order
from loanlens.operators.evaluation import roc_auc_by
from loanlens.operators.models import PATIENCE, ROUNDS, auc, boosting_rounds, fit_boosting, input_slots
from loanlens.sources.tables import stage


def column_means(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Background means for the attribution; one pass, one number per column."""
    return df.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()


def linear_attribution(df: DataFrame, weights: dict[str, float], means: dict[str, float]) -> DataFrame:
    """Replace each feature by its share of a linear score, weight * (value - mean).

    This is the exact Shapley value when features are treated as independent.  Row-local.
    """
    return df.withColumns({c: F.lit(w) * (F.col(c) - F.lit(means[c])) for c, w in weights.items()})


def mean_abs(phi: DataFrame, columns: list[str]) -> DataFrame:
    """Mean size of the attribution per feature, largest first."""
    wide = phi.agg(*[F.avg(F.abs(c)).alias(c) for c in columns])
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in columns]
    return wide.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*").orderBy(F.desc("importance"), "feature")


def vector_attribution(
    df: DataFrame, background: DataFrame, weights: list[float], names: list[str], column: str = "features"
) -> DataFrame:
    """Mean attribution size per feature of an assembled vector, largest first.

    Vectors are unfolded to (slot, value) and combined map-side: one row per slot and task is
    shuffled, however many rows or features there are.
    """
    slots = background.select(F.posexplode(vector_to_array(column)).alias("slot", "value"))
    means = [r["mean"] for r in slots.groupBy("slot").agg(F.avg("value").alias("mean")).orderBy("slot").collect()]
    w, m, label = (F.array(*[F.lit(x) for x in xs]) for xs in (weights, means, names))
    values = df.select(F.posexplode(vector_to_array(column)).alias("slot", "value"))
    size = F.abs(F.get(w, "slot") * (F.col("value") - F.get(m, "slot")))
    return values.groupBy("slot").agg(F.avg(size).alias("importance")).select(
        F.get(label, "slot").alias("feature"), "importance").orderBy(F.desc("importance"), "feature")


def permutation_importance(
    model: Model, df: DataFrame, label: str, ids: list[str], columns: list[str], seed: int = 0
) -> DataFrame:
    """Loss of ROC area when one column's values are dealt out anew: (feature, importance), largest first.

    Row number p of one hash order receives the values of row number p of another, so every value is
    used once and any rerun deals the same way.  Each row is scored as it is and once per column, in
    one pass, and the areas of all columns come from one ranking, so the number of jobs does not grow
    with the columns.  Where every column has a vector slot of its own, rows become vectors once and
    a variant replaces a slot; other models get whole rows.
    """
    slots = input_slots(model)
    ranked = _slot_scores(model, df, label, ids, [slots[c] for c in columns], seed) if set(columns) <= set(slots) else _row_scores(model, df, label, ids, columns, seed)
    areas = {r["__variant"]: r["roc_auc"] for r in roc_auc_by(stage(ranked), "__variant", label, "__score").collect()}  # one per column
    rows = [(c, float(areas[-1] - areas[i])) for i, c in enumerate(columns)]
    out = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return out.orderBy(F.desc("importance"), "feature")


def _variants(count: int) -> Column:
    return F.explode(F.sequence(F.lit(-1), F.lit(count - 1))).alias("__variant")  # -1: as it is


def _slot_scores(model: PipelineModel, df: DataFrame, label: str, ids: list[str], slots: list[int], seed: int) -> DataFrame:
    """__variant, label, __score of every row and variant, where variant i has slot `slots[i]` dealt anew."""
    vectors = PipelineModel(model.stages[:-1]).transform(df).withColumn("__own", vector_to_array("features"))
    whole = stage(vectors.select(*ids, label, "__own", F.lit(1).alias("__all")))
    seats = hash_order(whole, "__all", ids, seed, "__seat").select("__seat", label, "__own")
    dealt = hash_order(whole.drop(label), "__all", ids, seed + 1, "__seat").select("__seat", F.col("__own").alias("__dealt"))
    both = stage(seats.join(dealt, "__seat").drop("__seat"))
    slot = F.get(F.array(*[F.lit(s) for s in slots]), F.col("__variant"))
    replaced = F.concat(F.slice("__own", F.lit(1), slot), F.array(F.get("__dealt", slot)), F.slice("__own", slot + 2, F.size("__own")))
    permuted = both.select("*", _variants(len(slots))).withColumn("__features", F.when(F.col("__variant") < 0, F.col("__own")).otherwise(replaced))
    ready = permuted.select("__variant", label, array_to_vector("__features").alias("features"))
    return model.stages[-1].transform(ready).select("__variant", label, vector_to_array("probability")[1].alias("__score"))


def _row_scores(model: Model, df: DataFrame, label: str, ids: list[str], columns: list[str], seed: int) -> DataFrame:
    """The same for any model, by rows of raw columns."""
    whole = stage(df.withColumn("__all", F.lit(1)))
    seats = hash_order(whole, "__all", ids, seed, "__seat").drop("__all")
    dealt = hash_order(whole.select("__all", *ids, *columns), "__all", ids, seed + 1, "__seat").select(
        "__seat", *[F.col(c).alias(f"__dealt_{i}") for i, c in enumerate(columns)])
    both = stage(seats.join(dealt, "__seat").drop("__seat"))
    place = {c: i for i, c in enumerate(columns)}
    permuted = both.select("*", _variants(len(columns))).select("__variant", *[
        F.when(F.col("__variant") == place[c], F.col(f"__dealt_{place[c]}")).otherwise(F.col(c)).alias(c) if c in place else F.col(c) for c in df.columns])
    return model.transform(permuted).select("__variant", label, vector_to_array("probability")[1].alias("__score"))


def zero_importance(importances: DataFrame) -> list[str]:
    """Features that do not matter at all."""
    return [r["feature"] for r in importances.filter("importance = 0").orderBy("feature").collect()]


def tree_importances(model: PipelineModel, columns: list[str]) -> dict[str, float]:
    """Split importance per input column of a boosted pipeline (one vector slot per column)."""
    return dict(zip(columns, model.stages[-1].featureImportances.toArray().tolist()))


def refit_without(
    train: DataFrame, validation: DataFrame, label: str, columns: list[str], unwanted: list[str], rounds: int = ROUNDS,
    weight: str | None = None, params: dict | None = None
) -> tuple[PipelineModel, list[str]]:
    """Retrain on the remaining columns; returns the model and those columns."""
    kept = [c for c in columns if c not in unwanted]
    return fit_boosting(train, validation, label, kept, rounds, weight, params), kept


def recursive_elimination(
    train: DataFrame, validation: DataFrame, label: str, columns: list[str], drop_each: int = 10, max_iter: int = 10,
    rounds: int = ROUNDS, params: dict | None = None
) -> DataFrame:
    """Fit, note the validation area, drop the least important columns, repeat.

    Returns (n_features, roc_auc, dropped).  Stops early when no column would be left.  Both frames are
    read once per round and level, so pass stored ones.
    """
    kept, rows, first = list(columns), [], None
    for _ in range(max_iter):
        model = fit_boosting(train, validation, label, kept, rounds, params=params, first=first)
        first = boosting_rounds(model) + PATIENCE  # fewer columns are likely to need about as many rounds
        weakest = sorted(tree_importances(model, kept).items(), key=lambda x: x[1])[:drop_each]
        dropped = [c for c, _ in weakest]
        rows.append((len(kept), float(auc(model, validation, label)), dropped))
        kept = [c for c in kept if c not in dropped]
        if not kept:
            break
    return train.sparkSession.createDataFrame(rows, "n_features int, roc_auc double, dropped array<string>")
