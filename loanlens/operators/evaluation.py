"""Quality of predictions: confusion counts, threshold scores, exact ROC curve and area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.functions.ordering import value_ranks


def predicted_class(probability: str) -> Column:
    """Class of a probability, rounding one half to the even class 0."""
    return F.bround(F.col(probability)).cast("int")


def confusion_matrix(df: DataFrame, label: str, probability: str) -> DataFrame:
    """Row counts per actual and predicted class, all four cells present."""
    y, p = F.col(label).cast("int"), predicted_class(probability)
    counts = df.agg(*[F.count_if((y == a) & (p == b)).alias(f"n_{a}_{b}") for a in (0, 1) for b in (0, 1)])
    cells = [F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(f"n_{a}_{b}").alias("n"))
             for a in (0, 1) for b in (0, 1)]
    return counts.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def threshold_scores(df: DataFrame, label: str, probability: str) -> DataFrame:
    """Accuracy, recall, precision and F1 of the positive class; 0 where a denominator is 0."""
    y, p = F.col(label).cast("int"), predicted_class(probability)
    counts = df.agg(
        F.count_if((y == 1) & (p == 1)).cast("double").alias("tp"), F.count_if((y == 0) & (p == 1)).cast("double").alias("fp"),
        F.count_if((y == 1) & (p == 0)).cast("double").alias("fn"), F.count_if((y == 0) & (p == 0)).cast("double").alias("tn"))

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        share(tp + tn, tp + tn + fp + fn).alias("accuracy"), share(tp, tp + fn).alias("recall"),
        share(tp, tp + fp).alias("precision"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def _ranked_scores(df: DataFrame, label: str, score: str, previous: bool = False, by: list[str] | None = None) -> DataFrame:
    """Distinct scores with their positive rows and the rows and positives below them."""
    return value_ranks(df, [score], by=by, sums={"pos": F.col(label).cast("long")}, previous=previous)


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under the ROC curve; equal scores count half.  Null when a class is empty.

    The area is read from average ranks of the distinct scores (the Mann-Whitney statistic).
    """
    return _area(_ranked_scores(df, label, score).groupBy())


def roc_auc_by(df: DataFrame, group: str, label: str, score: str) -> DataFrame:
    """The area of each group's rows, all from one ranking: (group, roc_auc)."""
    return _area(_ranked_scores(df, label, score, by=[group]).groupBy(group), group)


def _area(ranked: GroupedData, *keys: str) -> DataFrame:
    rank = F.col("before_n") + (F.col("n") + 1) / 2.0
    sums = ranked.agg(
        F.sum(F.col("pos") * rank).alias("ranks"), F.max("total_pos").cast("double").alias("p"),
        (F.max("total_n") - F.max("total_pos")).cast("double").alias("q"))
    return sums.select(*keys, F.try_divide(
        F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2.0, F.col("p") * F.col("q")).alias("roc_auc"))


def evaluate(df: DataFrame, label: str, probability: str) -> DataFrame:
    """Threshold scores and ROC area in one row."""
    return threshold_scores(df, label, probability).withColumn("__one", F.lit(1)).join(
        roc_auc(df, label, probability).withColumn("__one", F.lit(1)), "__one").drop("__one")


def roc_curve(df: DataFrame, label: str, score: str, drop_collinear: bool = True) -> DataFrame:
    """Points (fpr, tpr, threshold) by falling threshold, starting at (0, 0) with an infinite one.

    A point whose two neighbours continue its line is dropped on request: it is one whose next
    lower score adds the same numbers of rows of both classes.  The points of the highest and the
    lowest score always stay.
    """
    ranked = _ranked_scores(df, label, score, previous=drop_collinear)
    if drop_collinear:
        same = (F.col("previous_n") == F.col("n")) & (F.col("previous_pos") == F.col("pos"))
        highest = F.col("before_n") + F.col("n") == F.col("total_n")
        ranked = ranked.filter(highest | ~F.coalesce(same, F.lit(False)))
    neg, before_neg, total_neg = (F.col(f"{k}n") - F.col(f"{k}pos") for k in ("", "before_", "total_"))
    points = ranked.select(
        F.try_divide((total_neg - before_neg).cast("double"), total_neg.cast("double")).alias("fpr"),
        F.try_divide((F.col("total_pos") - F.col("before_pos")).cast("double"), F.col("total_pos").cast("double")).alias("tpr"),
        F.col("value").alias("threshold"))
    start = df.sparkSession.range(1).select(
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold"))
    return start.unionByName(points).orderBy(F.desc("threshold"))
