"""Derived columns of the client table and the merge of the history features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.functions.nulls import cap_above, ratio, row_any, row_mean, row_sum, true_or_zero

EXT_SOURCES = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
ENQUIRIES = [f"AMT_REQ_CREDIT_BUREAU_{p}" for p in ("HOUR", "DAY", "WEEK", "MON", "QRT", "YEAR")]
SURROUNDINGS = ["OBS_30_CNT_SOCIAL_CIRCLE", "DEF_30_CNT_SOCIAL_CIRCLE",
                "OBS_60_CNT_SOCIAL_CIRCLE", "DEF_60_CNT_SOCIAL_CIRCLE"]


def client_features(clients: DataFrame, ext_sources: list[str] | None = None) -> DataFrame:
    """Ratios, flags, external-score summaries and capped family counts; narrow, no shuffle."""
    scores = ext_sources or EXT_SOURCES
    positive = {c: F.col(c) > 0 for c in ENQUIRIES + SURROUNDINGS}
    return clients.withColumns({
        "DEBT_TO_INCOME": ratio("AMT_CREDIT", "AMT_INCOME_TOTAL"),
        "CREDIT_TERM": ratio("AMT_CREDIT", "AMT_ANNUITY"),
        "INCOME_PER_ANNUITY_UNIT": ratio("AMT_INCOME_TOTAL", "AMT_ANNUITY"),
        "DAYS_EMPLOYED_PERCENT": ratio("DAYS_EMPLOYED", "DAYS_BIRTH"),
        "LIVES_IN_POPULATED_AREA": true_or_zero(F.col("REGION_POPULATION_RELATIVE") > 0.04),
        "FRIEND_DEFAULTED": row_any([positive[c] for c in SURROUNDINGS if c.startswith("DEF")]).cast("int"),
        "FRIEND_HAD_DPD": row_any([positive[c] for c in SURROUNDINGS if c.startswith("OBS")]).cast("int"),
        "MISSING_BUREAU": F.col("AMT_REQ_CREDIT_BUREAU_WEEK").isNull().cast("int"),
        "HAD_ENQUIRIES": row_any([positive[c] for c in ENQUIRIES]).cast("int"),
        "AVG_EXT_SOURCE": row_mean(scores),
        "SUM_EXT_SOURCE": row_sum(scores),
        "CNT_CHILDREN": cap_above("CNT_CHILDREN", 3),
        "CNT_FAM_MEMBERS": cap_above("CNT_FAM_MEMBERS", 4),
    })


def merge_history(clients: DataFrame, prev_features: DataFrame, bureau_features: DataFrame) -> DataFrame:
    """Attach both history tables; only the two application counts become 0 where absent."""
    merged = clients.join(prev_features, "SK_ID_CURR", "left").join(bureau_features, "SK_ID_CURR", "left")
    counts = ["APPLICATION_COUNT_PREV", "APPLICATION_COUNT_BUREAU"]
    return merged.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})


def history_default_rate(
    clients: DataFrame, features: DataFrame, count_column: str, target: str = "TARGET"
) -> DataFrame:
    """Default rate of clients with and without history in a feature table."""
    known = clients.select("SK_ID_CURR", target).join(features.select("SK_ID_CURR", count_column), "SK_ID_CURR", "left")
    return known.groupBy(F.col(count_column).isNotNull().cast("int").alias("HAS_HISTORY")).agg(
        F.count(F.lit(1)).alias("clients"), F.avg(target).alias("default_rate"))


def key_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Number of distinct keys on the left, and how many of them occur on the right.

    Distinct keys are combined map-side, so a repeated key costs one row per task.
    """
    ours = left.select(key).where(F.col(key).isNotNull()).distinct()
    theirs = right.select(key).distinct().withColumn("__seen", F.lit(1))
    return ours.join(theirs, key, "left").agg(F.count(F.lit(1)).alias("keys"), F.count("__seen").alias("shared"))
