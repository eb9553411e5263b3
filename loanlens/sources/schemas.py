"""Schemas of the source tables, so that nothing is inferred from the data.

Only the columns that some operator reads are listed; a CSV file with more columns is read by
header name (see `tables.read_csv`), and the rest is dropped before any work is done.
"""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}


def _schema(**columns: list[str]) -> T.StructType:
    fields = [(name, kind) for kind, names in columns.items() for name in names]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


# Names of the document flags of an application.
DOCUMENT_FLAGS = [f"FLAG_DOCUMENT_{i}" for i in range(2, 22)]

# Column names of the source tables.

CLIENTS = _schema(
    long=["SK_ID_CURR"],
    int=[
        "TARGET", "DAYS_BIRTH", "REGION_RATING_CLIENT", "REGION_RATING_CLIENT_W_CITY", "HOUR_APPR_PROCESS_START",
        "FLAG_MOBIL", "FLAG_EMP_PHONE", "FLAG_WORK_PHONE", "FLAG_CONT_MOBILE", "FLAG_PHONE", "FLAG_EMAIL",
        "REG_REGION_NOT_LIVE_REGION", "REG_REGION_NOT_WORK_REGION", "LIVE_REGION_NOT_WORK_REGION",
        "REG_CITY_NOT_LIVE_CITY", "REG_CITY_NOT_WORK_CITY", "LIVE_CITY_NOT_WORK_CITY", "FLAG_OWN_CAR",
        "FLAG_OWN_REALTY",
    ] + DOCUMENT_FLAGS,
    double=[
        "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "DAYS_EMPLOYED", "DAYS_REGISTRATION",
        "DAYS_ID_PUBLISH", "DAYS_LAST_PHONE_CHANGE", "REGION_POPULATION_RELATIVE", "OBS_30_CNT_SOCIAL_CIRCLE",
        "OBS_60_CNT_SOCIAL_CIRCLE", "DEF_30_CNT_SOCIAL_CIRCLE", "DEF_60_CNT_SOCIAL_CIRCLE",
        "AMT_REQ_CREDIT_BUREAU_HOUR", "AMT_REQ_CREDIT_BUREAU_DAY", "AMT_REQ_CREDIT_BUREAU_WEEK",
        "AMT_REQ_CREDIT_BUREAU_MON", "AMT_REQ_CREDIT_BUREAU_QRT", "AMT_REQ_CREDIT_BUREAU_YEAR", "EXT_SOURCE_1",
        "EXT_SOURCE_2", "EXT_SOURCE_3", "CNT_CHILDREN", "CNT_FAM_MEMBERS", "INDICATOR_SUM", "DOCUMENT_SUM", "CHI2_SUM",
    ],
    string=[
        "CODE_GENDER", "NAME_CONTRACT_TYPE", "NAME_TYPE_SUITE", "NAME_INCOME_TYPE", "NAME_EDUCATION_TYPE",
        "NAME_FAMILY_STATUS", "NAME_HOUSING_TYPE", "OCCUPATION_TYPE", "ORGANIZATION_TYPE",
        "WEEKDAY_APPR_PROCESS_START",
    ],
)

PREV_APPS = _schema(
    long=["SK_ID_PREV", "SK_ID_CURR"],
    int=["DAYS_DECISION", "NFLAG_LAST_APPL_IN_DAY"],
    double=[
        "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "AMT_APPLICATION", "AMT_DOWN_PAYMENT", "RATE_DOWN_PAYMENT",
        "RATE_INTEREST_PRIMARY", "RATE_INTEREST_PRIVILEGED", "CNT_PAYMENT", "SELLERPLACE_AREA", "DAYS_FIRST_DRAWING",
        "DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION", "DAYS_LAST_DUE", "DAYS_TERMINATION",
    ],
    string=[
        "FLAG_LAST_APPL_PER_CONTRACT", "NAME_CONTRACT_TYPE", "NAME_CONTRACT_STATUS", "NAME_PRODUCT_TYPE",
        "NAME_YIELD_GROUP", "NAME_PAYMENT_TYPE", "NAME_CLIENT_TYPE", "NAME_PORTFOLIO", "CODE_REJECT_REASON",
        "NAME_CASH_LOAN_PURPOSE",
    ],
)

POS_CASH = _schema(
    long=["SK_ID_PREV", "SK_ID_CURR"],
    int=["MONTHS_BALANCE", "SK_DPD"],
    double=["CNT_INSTALMENT", "CNT_INSTALMENT_FUTURE"],
    string=["NAME_CONTRACT_STATUS"],
)

INSTALLMENTS = _schema(
    long=["SK_ID_PREV", "SK_ID_CURR"],
    double=["NUM_INSTALMENT_VERSION", "DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT", "AMT_INSTALMENT", "AMT_PAYMENT"],
)

CREDIT_CARD = _schema(
    long=["SK_ID_PREV", "SK_ID_CURR"],
    int=["MONTHS_BALANCE", "SK_DPD"],
    double=["AMT_DRAWINGS_CURRENT", "AMT_CREDIT_LIMIT_ACTUAL", "AMT_INST_MIN_REGULARITY", "AMT_PAYMENT_CURRENT"],
    string=["NAME_CONTRACT_STATUS"],
)

BUREAU = _schema(
    long=["SK_ID_BUREAU", "SK_ID_CURR"],
    int=["DAYS_CREDIT", "DAYS_CREDIT_UPDATE", "CREDIT_DAY_OVERDUE", "CNT_CREDIT_PROLONG"],
    double=[
        "DAYS_CREDIT_ENDDATE", "DAYS_ENDDATE_FACT", "AMT_CREDIT_MAX_OVERDUE", "AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT",
        "AMT_CREDIT_SUM_LIMIT", "AMT_CREDIT_SUM_OVERDUE", "AMT_ANNUITY",
    ],
    string=["CREDIT_ACTIVE", "CREDIT_CURRENCY", "CREDIT_TYPE"],
)

BUREAU_BALANCE = _schema(
    long=["SK_ID_BUREAU"],
    int=["MONTHS_BALANCE"],
    string=["STATUS"],
)

TABLES = {
    "clients": CLIENTS,
    "prev_apps": PREV_APPS,
    "pos_cash": POS_CASH,
    "installments": INSTALLMENTS,
    "credit_card": CREDIT_CARD,
    "bureau": BUREAU,
    "bureau_balance": BUREAU_BALANCE,
}
