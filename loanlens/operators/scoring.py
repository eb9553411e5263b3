"""Batch scoring: check requests against the input contract, score the valid ones, keep the rest with reasons."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.operators.models import default_probability

# The fields of a scoring request in order, each with its type or its allowed texts.
CONTRACT: dict[str, str | list[str]] = {
    "NAME_CONTRACT_TYPE": ["Cash loans", "Revolving loans"],
    "CODE_GENDER": ["M", "F"],
    "FLAG_OWN_CAR": "int",
    "FLAG_OWN_REALTY": "int",
    "CNT_CHILDREN": "int",
    "AMT_INCOME_TOTAL": "float",
    "AMT_CREDIT": "float",
    "AMT_ANNUITY": "float",
    "NAME_TYPE_SUITE": ["Unaccompanied", "Family", "Spouse, partner", "Children", "Other"],
    "NAME_INCOME_TYPE": ["Working", "State servant", "Commercial associate", "Other"],
    "NAME_EDUCATION_TYPE": ["Secondary / secondary special", "Higher education", "Incomplete higher", "Lower secondary", "Academic degree"],
    "NAME_FAMILY_STATUS": ["Single / not married", "Married", "Civil marriage", "Widow", "Separated"],
    "NAME_HOUSING_TYPE": ["House / apartment", "Rented apartment", "With parents", "Municipal apartment", "Other"],
    "REGION_POPULATION_RELATIVE": "float",
    "DAYS_BIRTH": "int",
    "DAYS_EMPLOYED": "float",
    "DAYS_REGISTRATION": "float",
    "DAYS_ID_PUBLISH": "float",
    "FLAG_WORK_PHONE": "int",
    "FLAG_CONT_MOBILE": "int",
    "FLAG_PHONE": "int",
    "FLAG_EMAIL": "int",
    "OCCUPATION_TYPE": [
        "Laborers", "Core staff", "Accountants", "Managers", "Drivers", "Sales staff", "Cleaning staff",
        "Cooking staff", "UNKNOWN", "Other", "Medicine staff", "Security staff", "High skill tech staff",
    ],
    "CNT_FAM_MEMBERS": "float",
    "REGION_RATING_CLIENT_W_CITY": "int",
    "WEEKDAY_APPR_PROCESS_START": ["WEDNESDAY", "MONDAY", "THURSDAY", "SUNDAY", "SATURDAY", "FRIDAY", "TUESDAY"],
    "HOUR_APPR_PROCESS_START": "int",
    "REG_REGION_NOT_LIVE_REGION": "int",
    "REG_REGION_NOT_WORK_REGION": "int",
    "LIVE_REGION_NOT_WORK_REGION": "int",
    "REG_CITY_NOT_LIVE_CITY": "int",
    "REG_CITY_NOT_WORK_CITY": "int",
    "LIVE_CITY_NOT_WORK_CITY": "int",
    "ORGANIZATION_TYPE": [
        "Business Entity", "School", "Government", "Other", "Medicine", "Self-employed", "Transport", "Construction",
        "Kindergarten", "Trade", "Industry", "Security",
    ],
    "EXT_SOURCE_1": "float",
    "EXT_SOURCE_2": "float",
    "EXT_SOURCE_3": "float",
    "DAYS_LAST_PHONE_CHANGE": "float",
    "FLAG_DOCUMENT_3": "int",
    "FLAG_DOCUMENT_5": "int",
    "FLAG_DOCUMENT_6": "int",
    "FLAG_DOCUMENT_8": "int",
    "FLAG_DOCUMENT_9": "int",
    "FLAG_DOCUMENT_11": "int",
    "FLAG_DOCUMENT_13": "int",
    "FLAG_DOCUMENT_14": "int",
    "FLAG_DOCUMENT_15": "int",
    "FLAG_DOCUMENT_16": "int",
    "FLAG_DOCUMENT_17": "int",
    "FLAG_DOCUMENT_18": "int",
    "FLAG_DOCUMENT_19": "int",
    "FLAG_DOCUMENT_20": "int",
    "FLAG_DOCUMENT_21": "int",
    "INDICATOR_SUM": "int",
    "DOCUMENT_SUM": "int",
    "DEBT_TO_INCOME": "float",
    "CREDIT_TERM": "float",
    "INCOME_PER_ANNUITY_UNIT": "float",
    "LIVES_IN_POPULATED_AREA": "int",
    "FRIEND_DEFAULTED": "int",
    "FRIEND_HAD_DPD": "int",
    "MISSING_BUREAU": "int",
    "HAD_ENQUIRIES": "int",
    "AVG_EXT_SOURCE": "float",
    "SUM_EXT_SOURCE": "float",
    "APPLICATION_COUNT_PREV": "float",
    "HAD_NON_APPROVED_PREV": ["NO", "YES"],
    "HAD_CONSUMER_LOAN_PREV": ["YES", "NO"],
    "HAD_REVOLVING_LOAN_PREV": ["NO", "YES"],
    "HAD_CASH_LOAN_PREV": ["NO", "YES"],
    "HAD_X_SELL_PREV": ["NO", "YES"],
    "HAS_ONGOING_LOAN_PREV": ["NO", "YES"],
    "HAD_DPD_PREV": ["NO", "YES"],
    "VERSION_CHANGED_PREV": ["YES", "NO"],
    "LIMIT_EXCEEDED_PREV": ["NO", "YES"],
    "UNDERPAID_PREV": ["NO", "YES"],
    "INSTALLMENTS_OVER_CNT_PAYMENT_PREV": ["NO", "YES"],
    "AVERAGE_YIELD_GROUP_PREV": "float",
    "AVERAGE_LOAN_LENGTH_PREV": "float",
    "AVERAGE_CNT_PAYMENT_PREV": "float",
    "LAST_SNAPSHOT_MAX_PREV": "float",
    "LAST_SNAPSHOT_MEAN_PREV": "float",
    "DAYS_DECISION_MEAN_PREV": "float",
    "DAYS_DECISION_MAX_PREV": "float",
    "INSTALLMENT_COUNT_MEAN_PREV": "float",
    "AVERAGE_AMT_CREDIT_PREV": "float",
    "AVERAGE_RATE_DOWN_PAYMENT_PREV": "float",
    "DPD_COUNT": "float",
    "AVERAGE_DRAWINGS_PREV": "float",
    "AVERAGE_INSTALLMENT_PREV": "float",
    "AVG_MONTHS_BALANCE": "float",
    "APPLICATION_COUNT_BUREAU": "float",
    "HAD_CONSUMER_LOAN_BUREAU": ["YES", "NO"],
    "HAD_REVOLVING_LOAN_BUREAU": ["YES", "NO"],
    "HAS_ONGOING_LOAN_BUREAU": ["YES", "NO"],
    "HAD_PROLONGATION_BUREAU": ["NO", "YES"],
    "HAD_DPD_BUREAU": ["NO", "YES"],
    "HAD_1DPD_BUREAU": ["YES", "NO"],
    "HAD_2DPD_BUREAU": ["NO", "YES"],
    "HAD_3DPD_BUREAU": ["NO", "YES"],
    "HAD_4DPD_BUREAU": ["NO", "YES"],
    "HAD_5DPD_BUREAU": ["NO", "YES"],
    "HAD_DEBT_BUREAU": ["YES", "NO"],
    "SUM_AMT_DEBT_BUREAU": "float",
    "AVG_AMT_CREDIT_SUM_BUREAU": "float",
    "MAX_AMT_CREDIT_SUM_BUREAU": "float",
    "MAX_AMT_CREDIT_MAX_OVERDUE_BUREAU": "float",
    "LAST_SNAPSHOT_MAX_BUREAU": "float",
    "LAST_SNAPSHOT_MEAN_BUREAU": "float",
    "AVG_DAYS_CREDIT_BUREAU": "float",
    "MAX_DAYS_CREDIT_BUREAU": "float",
    "AVG_DAYS_ENDDATE_FACT_BUREAU": "float",
    "MAX_DAYS_ENDDATE_FACT_BUREAU": "float",
    "AVG_LOAN_LENGTH_BUREAU": "float",
}

# Fields the tree model does not use.
ZERO_IMPORTANCE = [
    "HAD_2DPD_BUREAU", "HAD_REVOLVING_LOAN_BUREAU", "LIVES_IN_POPULATED_AREA", "HAD_3DPD_BUREAU", "HAD_4DPD_BUREAU",
    "HAD_5DPD_BUREAU", "HAD_DEBT_BUREAU", "FLAG_DOCUMENT_20", "FLAG_CONT_MOBILE", "FLAG_DOCUMENT_21",
    "HAD_CONSUMER_LOAN_BUREAU", "REG_REGION_NOT_WORK_REGION", "FLAG_EMAIL", "REG_REGION_NOT_LIVE_REGION",
    "HAD_ENQUIRIES", "FLAG_DOCUMENT_19", "FLAG_DOCUMENT_18", "FLAG_DOCUMENT_17", "HAD_CONSUMER_LOAN_PREV",
    "FLAG_DOCUMENT_16", "HAD_CASH_LOAN_PREV", "HAS_ONGOING_LOAN_PREV", "FLAG_DOCUMENT_15", "FLAG_DOCUMENT_14",
    "INSTALLMENTS_OVER_CNT_PAYMENT_PREV", "FLAG_DOCUMENT_13", "FLAG_DOCUMENT_11", "FLAG_DOCUMENT_9", "FLAG_DOCUMENT_6",
    "FLAG_DOCUMENT_5", "REG_CITY_NOT_WORK_CITY", "LIVE_REGION_NOT_WORK_REGION", "MISSING_BUREAU",
    "LIVE_CITY_NOT_WORK_CITY",
]


def contract_schema() -> T.StructType:
    """The request as a table schema, for readers."""
    kinds = {"int": T.LongType(), "float": T.DoubleType()}
    return T.StructType([
        T.StructField(n, kinds[r] if isinstance(r, str) else T.StringType()) for n, r in CONTRACT.items()])


def _converted(df: DataFrame, name: str, rule: str | list[str]) -> Column:
    """The field in its contract type, null where it can't be converted: what is checked is what is used."""
    x = F.col(name)
    if isinstance(rule, list):
        return x.cast("string")
    number = x.try_cast("double") if isinstance(df.schema[name].dataType, (T.StringType, T.NumericType)) else F.lit(None).cast("double")
    number = F.when(~F.isnan(number), number)
    if rule == "float":
        return number
    whole = x.try_cast("long") if isinstance(df.schema[name].dataType, T.IntegralType) else F.when(
        number == F.floor(number), number).try_cast("long")
    return whole


def _problem(df: DataFrame, name: str, rule: str | list[str]) -> Column:
    """Why a field is not acceptable, or null."""
    if name not in df.columns:
        return F.lit(f"{name}: field required")
    value = _converted(df, name, rule)
    reason = F.when(F.col(name).isNull(), F.lit(f"{name}: missing"))
    if isinstance(rule, list):
        return reason.when(~value.isin(rule), F.lit(f"{name}: not allowed"))
    return reason.when(value.isNull(), F.lit(f"{name}: not a number" if rule == "float" else f"{name}: not an integer"))


def check_requests(df: DataFrame) -> DataFrame:
    """Add `violations`: one text per field that breaks the contract; row-local, also for streams."""
    problems = F.array(*[_problem(df, n, r) for n, r in CONTRACT.items()])
    return df.withColumn("violations", F.array_compact(problems))


def typed_requests(df: DataFrame) -> DataFrame:
    """The contract fields in their types; a cell that can't be converted becomes null."""
    return df.select(*[_converted(df, c, CONTRACT[c]).alias(c) if c in CONTRACT else F.col(c) for c in df.columns])


def split_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows in contract types, quarantined rows with their violations); row-local."""
    checked = check_requests(df)
    good = checked.filter(F.size("violations") == 0).drop("violations")
    return typed_requests(good), checked.filter(F.size("violations") > 0)


def score(df: DataFrame, model: PipelineModel, ids: list[str], drop: list[str] | None = None) -> DataFrame:
    """Probability of default per row: (ids, DefaultProbability).

    `drop` removes fields the model was trained without; the model's own first stages prepare the
    rest.  Works on batch and streaming frames.
    """
    return default_probability(model.transform(df.drop(*(drop or [])))).select(*ids, "DefaultProbability")
