"""Features of previous loans: monthly history -> loan -> client.

Each monthly table is aggregated once per key, with hash aggregation and a map-side combine, before
it joins anything: no monthly row is ever joined, and a loan or client that owns a third of the
table reaches the shuffle as one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.functions.nulls import any_eq, any_gt, any_in, any_ne, nsum, set_where, varied
from loanlens.functions.ordering import first_at_latest, stable_tie

# Contract statuses that end a loan.
FINISHED_POS = ["Canceled", "Returned to the store", "Completed"]
FINISHED_CARD = ["Refused", "Completed"]

# Fixed value: days of a month.
DAYS_PER_MONTH = 30.44


def _tie(df: DataFrame, tie: str | None, *read: str) -> Column:
    return F.col(tie) if tie else stable_tie(*read)


def loan_pos_features(pos_cash: DataFrame, tie: str | None = None) -> DataFrame:
    """One row per loan from the monthly point-of-sale and cash balances.

    LOAN_LENGTH is the span of months, plus the instalments still due in the latest month when the
    loan never reached 'Completed' (unknown if that month does not say).  Where a month repeats,
    the row with the lowest `tie` counts as the first; without one, a hash of the row decides.
    """
    months = F.col("MONTHS_BALANCE")
    future = F.col("CNT_INSTALMENT_FUTURE")
    grouped = pos_cash.filter(F.col("SK_ID_PREV").isNotNull()).groupBy("SK_ID_PREV").agg(
        (F.max(months) - F.min(months) + 1).cast("double").alias("__span"),
        F.bool_or(F.col("NAME_CONTRACT_STATUS") == "Completed").alias("__completed"),
        F.count(future).alias("__known"),
        first_at_latest(future, months, _tie(pos_cash, tie, "SK_ID_PREV", "MONTHS_BALANCE", "CNT_INSTALMENT_FUTURE")).alias("__due"),
        any_in("NAME_CONTRACT_STATUS", FINISHED_POS).alias("IS_COMPLETED"),
        F.max(months).alias("LAST_SNAPSHOT"),
        F.avg(months).alias("AVERAGE_SNAPSHOT"),
        varied("CNT_INSTALMENT").alias("INSTALLMENT_CHANGED"),
        any_ne("SK_DPD", 0).alias("HAD_DPD"),
    )
    length = F.when(F.coalesce(F.col("__completed"), F.lit(False)) | (F.col("__known") == 0), F.col("__span")).otherwise(
        F.col("__span") + F.col("__due"))
    return grouped.select(
        "SK_ID_PREV", length.alias("LOAN_LENGTH"), "IS_COMPLETED", "LAST_SNAPSHOT", "AVERAGE_SNAPSHOT",
        "INSTALLMENT_CHANGED", "HAD_DPD")


def loan_installment_features(installments: DataFrame) -> DataFrame:
    """One row per loan from its payments."""
    return installments.filter(F.col("SK_ID_PREV").isNotNull()).groupBy("SK_ID_PREV").agg(
        varied("NUM_INSTALMENT_VERSION").alias("VERSION_CHANGED"),
        F.avg("AMT_INSTALMENT").alias("AVERAGE_INSTALLMENT"),
        any_gt("DAYS_ENTRY_PAYMENT", "DAYS_INSTALMENT").alias("HAD_DPD"),
        any_gt("AMT_INSTALMENT", "AMT_PAYMENT").alias("UNDERPAID"),
        F.count(F.lit(1)).alias("INSTALLMENT_COUNT"),
    )


def loan_card_features(credit_card: DataFrame) -> DataFrame:
    """One row per loan from monthly card balances; months with negative or unknown drawings are left out."""
    return credit_card.filter((F.col("AMT_DRAWINGS_CURRENT") >= 0) & F.col("SK_ID_PREV").isNotNull()).groupBy(
        "SK_ID_PREV").agg(
        any_in("NAME_CONTRACT_STATUS", FINISHED_CARD).alias("IS_COMPLETED"),
        F.max("MONTHS_BALANCE").alias("LAST_SNAPSHOT"),
        F.avg("MONTHS_BALANCE").alias("AVERAGE_SNAPSHOT"),
        any_ne("SK_DPD", 0).alias("HAD_DPD"),
        F.avg("AMT_DRAWINGS_CURRENT").alias("AVG_DRAWINGS"),
        any_gt("AMT_DRAWINGS_CURRENT", "AMT_CREDIT_LIMIT_ACTUAL").alias("EXCEEDED_LIMIT"),
        any_gt("AMT_INST_MIN_REGULARITY", "AMT_PAYMENT_CURRENT").alias("UNDERPAID"),
    )


LOANS_PER_TASK = 50_000


def _join_tasks(prev_apps: DataFrame) -> int:
    """LOANS_PER_TASK loans in a task on average: the joins sort all their sides at once, so what a task
    holds must not grow with the table."""
    return max(prev_apps.sparkSession.sparkContext.defaultParallelism, -(-prev_apps.count() // LOANS_PER_TASK))


# Which histories report each shared feature, most trusted first.
SOURCES_BY_TRUST = {
    "UNDERPAID": ["inst", "card"],
    "IS_COMPLETED": ["pos", "card"],
    "LAST_SNAPSHOT": ["pos", "card"],
    "AVERAGE_SNAPSHOT": ["pos", "card"],
    "HAD_DPD": ["inst", "pos", "card"],
}


def loan_features(
    prev_apps: DataFrame,
    pos_cash: DataFrame,
    installments: DataFrame,
    credit_card: DataFrame,
    tie: str | None = None,
) -> DataFrame:
    """Previous applications with the features of their three histories.

    The right sides hold one row per loan, so the left count never changes.  A feature reported by
    several histories is taken from the first that knows the loan.
    """
    sides = {
        "inst": loan_installment_features(installments),
        "pos": loan_pos_features(pos_cash, tie),
        "card": loan_card_features(credit_card),
    }
    tasks = _join_tasks(prev_apps)
    joined = prev_apps.repartition(tasks, "SK_ID_PREV")
    for name, side in sides.items():
        shared = {c: f"__{name}_{c}" for c in side.columns if c in SOURCES_BY_TRUST}
        joined = joined.join(side.withColumnsRenamed(shared).repartition(tasks, "SK_ID_PREV"), "SK_ID_PREV", "left")
    combined = {c: F.coalesce(*[F.col(f"__{s}_{c}") for s in order]) for c, order in SOURCES_BY_TRUST.items()}
    spare = [f"__{s}_{c}" for c, order in SOURCES_BY_TRUST.items() for s in order]
    return joined.withColumns(combined).drop(*spare)


def fill_unapproved(loans: DataFrame) -> DataFrame:
    """Fill what an application that was never granted cannot have, then the remaining loan lengths.

    Runs after missing texts became 'UNKNOWN'.
    """
    refused = ~F.col("NAME_CONTRACT_STATUS").eqNullSafe("Approved")
    out = set_where(loans, refused & (F.col("IS_COMPLETED") == "UNKNOWN"), {"IS_COMPLETED": "YES"})
    for c in ("INSTALLMENT_COUNT", "CNT_PAYMENT", "LOAN_LENGTH"):
        out = set_where(out, refused & F.col(c).isNull(), {c: 0})
    elapsed = F.ceil((F.col("DAYS_TERMINATION") - F.col("DAYS_DECISION")) / F.lit(DAYS_PER_MONTH)).cast("double")
    return out.withColumn("LOAN_LENGTH", F.coalesce(F.col("LOAN_LENGTH").cast("double"), elapsed))


def client_loan_features(loans: DataFrame) -> DataFrame:
    """One row per client from previous applications.

    HAS_ONGOING_LOAN_PREV keeps its established meaning, which is "some loan is completed or of
    unknown state"; HAS_ONGOING_LOAN_PREV_FIXED says what the name promises.
    """
    return loans.filter(F.col("SK_ID_CURR").isNotNull()).groupBy("SK_ID_CURR").agg(
        F.count(F.lit(1)).alias("APPLICATION_COUNT_PREV"),
        any_ne("NAME_CONTRACT_STATUS", "Approved").alias("HAD_NON_APPROVED_PREV"),
        any_eq("NAME_CONTRACT_TYPE", "Consumer loans").alias("HAD_CONSUMER_LOAN_PREV"),
        any_eq("NAME_CONTRACT_TYPE", "Revolving loans").alias("HAD_REVOLVING_LOAN_PREV"),
        any_eq("NAME_CONTRACT_TYPE", "Cash loans").alias("HAD_CASH_LOAN_PREV"),
        any_eq("NAME_PRODUCT_TYPE", "x-sell").alias("HAD_X_SELL_PREV"),
        any_ne("IS_COMPLETED", "NO").alias("HAS_ONGOING_LOAN_PREV"),
        any_eq("IS_COMPLETED", "NO").alias("HAS_ONGOING_LOAN_PREV_FIXED"),
        *[any_eq(c, "YES").alias(out) for c, out in (
            ("HAD_DPD", "HAD_DPD_PREV"),
            ("VERSION_CHANGED", "VERSION_CHANGED_PREV"),
            ("EXCEEDED_LIMIT", "LIMIT_EXCEEDED_PREV"),
            ("UNDERPAID", "UNDERPAID_PREV"),
        )],
        any_gt("INSTALLMENT_COUNT", "CNT_PAYMENT").alias("INSTALLMENTS_OVER_CNT_PAYMENT_PREV"),
        F.avg("NAME_YIELD_GROUP").alias("AVERAGE_YIELD_GROUP_PREV"),
        F.avg("LOAN_LENGTH").alias("AVERAGE_LOAN_LENGTH_PREV"),
        F.avg("CNT_PAYMENT").alias("AVERAGE_CNT_PAYMENT_PREV"),
        F.max("LAST_SNAPSHOT").alias("LAST_SNAPSHOT_MAX_PREV"),
        F.avg("LAST_SNAPSHOT").alias("LAST_SNAPSHOT_MEAN_PREV"),
        F.avg("DAYS_DECISION").alias("DAYS_DECISION_MEAN_PREV"),
        F.max("DAYS_DECISION").alias("DAYS_DECISION_MAX_PREV"),
        F.avg("INSTALLMENT_COUNT").alias("INSTALLMENT_COUNT_MEAN_PREV"),
        F.avg("AMT_CREDIT").alias("AVERAGE_AMT_CREDIT_PREV"),
        F.avg("RATE_DOWN_PAYMENT").alias("AVERAGE_RATE_DOWN_PAYMENT_PREV"),
    )


def client_history_features(
    pos_cash: DataFrame, credit_card: DataFrame, installments: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Means and sums over all monthly rows of a client, one frame per history.

    These are means over rows, not over loans, and include months and loans the loan-level
    features leave out, so they are taken from the monthly tables again: two or three narrow
    columns, combined map-side to one row per client and task.
    """
    pos = pos_cash.groupBy("SK_ID_CURR").agg(
        nsum("SK_DPD").alias("DPD_COUNT"), F.avg("MONTHS_BALANCE").alias("__pos_month"))
    card = credit_card.groupBy("SK_ID_CURR").agg(
        F.avg("AMT_DRAWINGS_CURRENT").alias("AVERAGE_DRAWINGS_PREV"), F.avg("MONTHS_BALANCE").alias("__card_month"))
    inst = installments.groupBy("SK_ID_CURR").agg(F.avg("AMT_INSTALMENT").alias("AVERAGE_INSTALLMENT_PREV"))
    return pos, card, inst


def client_previous_features(
    loans: DataFrame, pos_cash: DataFrame, credit_card: DataFrame, installments: DataFrame
) -> DataFrame:
    """All client-level features of the previous-loan tables."""
    out = client_loan_features(loans)
    for side in client_history_features(pos_cash, credit_card, installments):
        out = out.join(side, "SK_ID_CURR", "left")
    return out.withColumn("AVG_MONTHS_BALANCE", F.coalesce("__pos_month", "__card_month")).drop(
        "__pos_month", "__card_month")
