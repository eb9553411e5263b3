"""Cleaning rules: sentinels, constant fills, recodes, rare-category grouping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.functions.nulls import UNKNOWN, set_where, string_columns

# Texts and numbers that stand for "missing" in the previous-application table.
MISSING_TEXTS = ["XAP", "XNA"]
MISSING_DAY = 365243
DAY_COLUMNS = ["DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION", "DAYS_LAST_DUE", "DAYS_TERMINATION", "DAYS_FIRST_DRAWING"]
SPARSE_COLUMNS = ["RATE_INTEREST_PRIMARY", "RATE_INTEREST_PRIVILEGED", "NAME_CASH_LOAN_PURPOSE", "DAYS_FIRST_DRAWING"]
DUE_DAY_COLUMNS = ["DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION", "DAYS_LAST_DUE"]

# Numeric code of each interest-rate group.
YIELD_CODES = {"low_action": 1, "low_normal": 2, "middle": 3, "high": 4}

# Columns whose sign is flipped so that a logarithm can be taken.
PREV_NEGATIVE = ["DAYS_DECISION_MAX_PREV", "DAYS_DECISION_MEAN_PREV", "LAST_SNAPSHOT_MAX_PREV",
                 "LAST_SNAPSHOT_MEAN_PREV", "AVG_MONTHS_BALANCE"]
BUREAU_NEGATIVE = ["AVG_DAYS_CREDIT_BUREAU", "AVG_DAYS_ENDDATE_FACT_BUREAU", "MAX_DAYS_ENDDATE_FACT_BUREAU",
                   "MAX_DAYS_CREDIT_BUREAU", "LAST_SNAPSHOT_MEAN_BUREAU", "LAST_SNAPSHOT_MAX_BUREAU"]

# Rare categories of the client table, by column.
RARE_CATEGORIES = {
    "NAME_INCOME_TYPE": ["Businessman", "Student", "Maternity leave", "Unemployed", "Pensioner"],
    "OCCUPATION_TYPE": ["Private service staff", "IT staff", "HR staff", "Realty agents", "Secretaries",
                        "Waiters/barmen staff", "Low-skill Laborers"],
    "ORGANIZATION_TYPE": ["Religion", "Cleaning", "Legal Services", "Mobile", "Culture", "Realtor", "Advertising",
                          "Emergency", "Telecom", "Insurance", "Electricity", "Hotel", "Military", "Bank",
                          "Agriculture", "Police", "Postal", "Security Ministries", "Restaurant", "University",
                          "Services", "Housing"],
    "NAME_TYPE_SUITE": ["Group of people", "Other_A", "UNKNOWN", "Other_B"],
    "NAME_HOUSING_TYPE": ["Co-op apartment", "Office apartment"],
}
ORGANIZATION_GROUPS = ["Industry", "Business Entity", "Trade", "Transport"]
UNKNOWN_REPLACEMENT = {"CODE_GENDER": "F", "NAME_FAMILY_STATUS": "Married"}


def last_application_per_contract(prev_apps: DataFrame) -> DataFrame:
    return prev_apps.filter(F.col("FLAG_LAST_APPL_PER_CONTRACT") == "Y")


def sentinels_to_null(prev_apps: DataFrame) -> DataFrame:
    """Placeholders become null: -1 seller area, 365243 days, XAP and XNA in any text column.

    A negative down payment clears its rate as well.
    """
    out = set_where(prev_apps, F.col("SELLERPLACE_AREA") == -1, {"SELLERPLACE_AREA": None})
    out = set_where(out, F.col("AMT_DOWN_PAYMENT") < 0, {"AMT_DOWN_PAYMENT": None, "RATE_DOWN_PAYMENT": None})
    for c in DAY_COLUMNS:
        if c in out.columns:
            out = set_where(out, F.col(c) == MISSING_DAY, {c: None})
    return texts_to_null(out, MISSING_TEXTS, string_columns(out))


def texts_to_null(df: DataFrame, texts: list[str], columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).isin(texts), F.lit(None)).otherwise(F.col(c)) for c in columns})


def unknown_texts(df: DataFrame) -> DataFrame:
    """Missing texts become 'UNKNOWN' in every text column."""
    return df.fillna(UNKNOWN, subset=string_columns(df))


def yield_group_to_code(prev_apps: DataFrame) -> DataFrame:
    """Interest-rate group as a number; an unknown group is missing, an unlisted one is an error."""
    c = F.col("NAME_YIELD_GROUP")
    code = F.when(c.isNull() | (c == UNKNOWN), F.lit(None).cast("double"))
    for text, number in YIELD_CODES.items():
        code = code.when(c == text, F.lit(float(number)))
    return prev_apps.withColumn("NAME_YIELD_GROUP", code.otherwise(c.cast("double")))


def fill_amounts(prev_apps: DataFrame) -> DataFrame:
    """Missing annuity and credit become 0, then missing down payments that must be 0.

    A missing down-payment rate means 0 (for the amount too) when the credit is 0 or the
    application was not approved.  The masks are taken before the down payment is written.
    """
    out = prev_apps.fillna(0, subset=["AMT_ANNUITY", "AMT_CREDIT"])
    no_loan = (F.col("AMT_CREDIT") == 0) | ~F.col("NAME_CONTRACT_STATUS").eqNullSafe("Approved")
    return set_where(out, F.col("RATE_DOWN_PAYMENT").isNull() & no_loan, {"RATE_DOWN_PAYMENT": 0, "AMT_DOWN_PAYMENT": 0})


def flip_signs(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: -F.col(c) for c in columns})


def group_rare_categories(clients: DataFrame) -> DataFrame:
    """Collapse organisation families to their prefix, then listed rare categories to 'Other'.

    The prefix step comes first, so 'Trade: type 2' survives as 'Trade'.
    """
    out = clients
    if "ORGANIZATION_TYPE" in out.columns:
        name = F.col("ORGANIZATION_TYPE")
        family = reduce(
            lambda chain, g: chain.when(name.startswith(g), F.lit(g)),
            ORGANIZATION_GROUPS[1:],
            F.when(name.startswith(ORGANIZATION_GROUPS[0]), F.lit(ORGANIZATION_GROUPS[0])),
        )
        out = out.withColumn("ORGANIZATION_TYPE", family.otherwise(name))
    recodes: dict[str, Column] = {}
    for c, rare in RARE_CATEGORIES.items():
        recodes[c] = F.when(F.col(c).isin(rare), F.lit("Other")).otherwise(F.col(c))
    for c, text in UNKNOWN_REPLACEMENT.items():
        recodes[c] = F.when(F.col(c) == UNKNOWN, F.lit(text)).otherwise(F.col(c))
    return out.withColumns({c: e for c, e in recodes.items() if c in out.columns})


def drop_columns(df: DataFrame, columns: list[str], null_unemployed: list[str] | None = None) -> DataFrame:
    """Drop chosen columns and clear 'Unemployed' in the listed text columns.

    Called for the training table and the table to be scored with the same arguments.
    """
    return texts_to_null(df.drop(*columns), ["Unemployed"], null_unemployed or [])
