"""Features of credits reported by other lenders: monthly status -> credit -> client."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.functions.nulls import any_eq, any_ne, cap_above, keep_unless, nsum, raise_to, set_where
from loanlens.functions.ordering import first_at_latest, pack_text, stable_tie, unpack_text
from loanlens.operators.previous import DAYS_PER_MONTH

DPD_LEVELS = range(1, 6)

# Monthly statuses. Digits are lateness classes, C is closed, X is unknown.
LATENESS = ["0", "1", "2", "3", "4", "5"]


def credit_status_features(bureau_balance: DataFrame, tie: str | None = None) -> DataFrame:
    """One row per credit: latest month, status in it, and which lateness classes occurred.

    A status travels through the aggregation as a number that spells it, as a text in the
    aggregation state would rule out hash aggregation on the largest table of all.  A status of more
    than seven bytes is an error.
    """
    order = F.col(tie) if tie else stable_tie("SK_ID_BUREAU", "MONTHS_BALANCE", "STATUS")
    return bureau_balance.filter(F.col("SK_ID_BUREAU").isNotNull()).groupBy("SK_ID_BUREAU").agg(
        F.max("MONTHS_BALANCE").alias("LAST_SNAPSHOT"),
        *[any_eq("STATUS", str(k)).alias(f"HAD_{k}_DPD") for k in DPD_LEVELS],
        unpack_text(first_at_latest(pack_text(F.col("STATUS")), F.col("MONTHS_BALANCE"), order)).alias("CURRENT_STATUS"),
    )


def add_credit_status(bureau: DataFrame, bureau_balance: DataFrame, tie: str | None = None) -> DataFrame:
    return bureau.join(credit_status_features(bureau_balance, tie), "SK_ID_BUREAU", "left")


def drop_impossible_credits(bureau: DataFrame) -> DataFrame:
    """Drop credits that end before they start or were updated at an impossible time."""
    start, update = F.col("DAYS_CREDIT"), F.col("DAYS_CREDIT_UPDATE")
    return keep_unless(
        bureau,
        start > F.col("DAYS_CREDIT_ENDDATE"),
        start > F.col("DAYS_ENDDATE_FACT"),
        update < -5000,
        update > 0,
        start > update,
    )


def clamp_credits(bureau: DataFrame) -> DataFrame:
    """Negative debts and limits become 0."""
    return bureau.withColumns({c: raise_to(c, 0.0) for c in ("AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_LIMIT")})


def cap_end_date(bureau: DataFrame) -> DataFrame:
    return bureau.withColumn("DAYS_CREDIT_ENDDATE", cap_above("DAYS_CREDIT_ENDDATE", 10000.0))


def reconcile_status(bureau: DataFrame) -> DataFrame:
    """Make the credit's state and its latest monthly status agree; the later report wins.

    Five masked updates, each seeing the effect of the ones before; runs after missing texts
    became 'UNKNOWN'.  All are row-local and fold into one projection.
    """
    update_month = F.col("DAYS_CREDIT_UPDATE") / F.lit(DAYS_PER_MONTH)
    state, status = F.col("CREDIT_ACTIVE"), F.col("CURRENT_STATUS")
    active, closed, late = state == "Active", state == "Closed", status.isin(LATENESS)
    older: Column = update_month < F.col("LAST_SNAPSHOT")
    newer: Column = update_month > F.col("LAST_SNAPSHOT")
    rules = [
        (active & F.col("DAYS_ENDDATE_FACT").isNotNull(), {"CREDIT_ACTIVE": "Closed", "CURRENT_STATUS": "C"}),
        (active & (status == "C") & older, {"CREDIT_ACTIVE": "Closed"}),
        (active & status.isin("C", "X", "UNKNOWN") & newer, {"CURRENT_STATUS": "0"}),
        (closed & late & older, {"CREDIT_ACTIVE": "Active"}),
        (closed & late & newer, {"CURRENT_STATUS": "C"}),
    ]
    out = bureau
    for condition, values in rules:
        out = set_where(out, condition, values)
    return out


def add_credit_length(bureau: DataFrame) -> DataFrame:
    return bureau.withColumn("LOAN_LENGTH", F.col("DAYS_ENDDATE_FACT") - F.col("DAYS_CREDIT"))


def client_bureau_features(bureau: DataFrame) -> DataFrame:
    """One row per client.  A missing debt or overdue amount counts as having one."""
    return bureau.filter(F.col("SK_ID_CURR").isNotNull()).groupBy("SK_ID_CURR").agg(
        F.count(F.lit(1)).alias("APPLICATION_COUNT_BUREAU"),
        any_eq("CREDIT_TYPE", "Consumer credit").alias("HAD_CONSUMER_LOAN_BUREAU"),
        any_eq("CREDIT_TYPE", "Credit card").alias("HAD_REVOLVING_LOAN_BUREAU"),
        any_eq("CREDIT_ACTIVE", "Active").alias("HAS_ONGOING_LOAN_BUREAU"),
        any_ne("CNT_CREDIT_PROLONG", 0).alias("HAD_PROLONGATION_BUREAU"),
        any_ne("CREDIT_DAY_OVERDUE", 0).alias("HAD_DPD_BUREAU"),
        nsum("CREDIT_DAY_OVERDUE").alias("DPD_SUM_BUREAU"),
        *[any_eq(f"HAD_{k}_DPD", "YES").alias(f"HAD_{k}DPD_BUREAU") for k in DPD_LEVELS],
        any_ne("AMT_CREDIT_SUM_DEBT", 0).alias("HAD_DEBT_BUREAU"),
        nsum("AMT_CREDIT_SUM_DEBT").alias("SUM_AMT_DEBT_BUREAU"),
        nsum("AMT_CREDIT_SUM_OVERDUE").alias("SUM_AMT_OVERDUE_BUREAU"),
        any_ne("AMT_CREDIT_SUM_OVERDUE", 0).alias("HAD_AMT_OVERDUE_BUREAU"),
        F.avg("AMT_CREDIT_SUM").alias("AVG_AMT_CREDIT_SUM_BUREAU"),
        F.max("AMT_CREDIT_SUM").alias("MAX_AMT_CREDIT_SUM_BUREAU"),
        F.max("AMT_CREDIT_MAX_OVERDUE").alias("MAX_AMT_CREDIT_MAX_OVERDUE_BUREAU"),
        F.max("LAST_SNAPSHOT").alias("LAST_SNAPSHOT_MAX_BUREAU"),
        F.avg("LAST_SNAPSHOT").alias("LAST_SNAPSHOT_MEAN_BUREAU"),
        F.avg("DAYS_CREDIT").alias("AVG_DAYS_CREDIT_BUREAU"),
        F.max("DAYS_CREDIT").alias("MAX_DAYS_CREDIT_BUREAU"),
        F.avg("DAYS_ENDDATE_FACT").alias("AVG_DAYS_ENDDATE_FACT_BUREAU"),
        F.max("DAYS_ENDDATE_FACT").alias("MAX_DAYS_ENDDATE_FACT_BUREAU"),
        F.avg("LOAN_LENGTH").alias("AVG_LOAN_LENGTH_BUREAU"),
    )
