"""The seven lending tables expressed over the order-entry test tables.

The texts run unchanged on Spark and on the SQL engine used as an oracle.  They carry the cases the
rules are about: missing cells in every column a null rule reads, repeated months, sentinels, loans
without history and clients without loans.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "clients": """
select c_custkey as SK_ID_CURR, case when c_acctbal < 0 then 1 else 0 end as TARGET,
 cast(case when c_custkey % 50 = 0 then 0 else 20000 + (c_custkey * 7919) % 180000 end as double) as AMT_INCOME_TOTAL,
 cast(50000 + (c_custkey * 104729) % 900000 as double) as AMT_CREDIT,
 cast(nullif(3000 + (c_custkey * 31) % 40000, 3000) as double) as AMT_ANNUITY,
 -cast(7000 + (c_custkey * 13) % 18000 as int) as DAYS_BIRTH, -cast(nullif((c_custkey * 17) % 9000, 0) as double) as DAYS_EMPLOYED,
 ((c_custkey * 11) % 70) / 1e3 as REGION_POPULATION_RELATIVE,
 cast(nullif(c_custkey % 7, 6) as double) as CNT_CHILDREN, cast(nullif(c_custkey % 8, 7) as double) as CNT_FAM_MEMBERS,
 case when c_custkey % 2 = 0 then null else ((c_custkey * 37) % 100) / 1e2 end as EXT_SOURCE_1,
 case when c_custkey % 10 = 0 then null else ((c_custkey * 53) % 100) / 1e2 end as EXT_SOURCE_2,
 case when c_custkey % 5 = 0 then null else ((c_custkey * 71) % 100) / 1e2 end as EXT_SOURCE_3,
 cast(nullif(c_custkey % 4, 3) as double) as AMT_REQ_CREDIT_BUREAU_WEEK,
 cast(nullif(c_custkey % 3, 2) as double) as AMT_REQ_CREDIT_BUREAU_HOUR, 0e0 as AMT_REQ_CREDIT_BUREAU_DAY, 0e0 as AMT_REQ_CREDIT_BUREAU_MON, 0e0 as AMT_REQ_CREDIT_BUREAU_QRT, cast(c_custkey % 5 - 3 as double) as AMT_REQ_CREDIT_BUREAU_YEAR,
 cast(nullif(c_custkey % 9, 8) as double) as OBS_30_CNT_SOCIAL_CIRCLE, cast(nullif(c_custkey % 6, 5) as double) as OBS_60_CNT_SOCIAL_CIRCLE,
 cast(case when c_custkey % 11 = 0 then 1 when c_custkey % 11 = 1 then null else 0 end as double) as DEF_30_CNT_SOCIAL_CIRCLE, cast(case when c_custkey % 12 = 0 then 1 else 0 end as double) as DEF_60_CNT_SOCIAL_CIRCLE,
 case c_custkey % 3 when 0 then 'F' when 1 then 'M' else 'UNKNOWN' end as CODE_GENDER,
 case c_custkey % 5 when 0 then 'Lower secondary' when 1 then 'Secondary / secondary special' when 2 then 'Incomplete higher' when 3 then 'Higher education' else 'Academic degree' end as NAME_EDUCATION_TYPE,
 case c_custkey % 7 when 0 then 'MONDAY' when 1 then 'TUESDAY' when 2 then 'WEDNESDAY' when 3 then 'THURSDAY' when 4 then 'FRIDAY' when 5 then 'SATURDAY' else 'SUNDAY' end as WEEKDAY_APPR_PROCESS_START,
 case c_custkey % 4 when 0 then 'Working' when 1 then 'Businessman' when 2 then 'State servant' else 'Pensioner' end as NAME_INCOME_TYPE,
 case c_custkey % 4 when 0 then 'Family' when 1 then 'Other_A' when 2 then 'Unaccompanied' else 'UNKNOWN' end as NAME_TYPE_SUITE,
 case c_custkey % 3 when 0 then 'House / apartment' when 1 then 'Co-op apartment' else 'With parents' end as NAME_HOUSING_TYPE,
 case c_custkey % 3 when 0 then 'Married' when 1 then 'Widow' else 'UNKNOWN' end as NAME_FAMILY_STATUS,
 case when c_custkey % 10 = 3 then 'Revolving loans' else 'Cash loans' end as NAME_CONTRACT_TYPE,
 case c_mktsegment when 'AUTOMOBILE' then 'Drivers' when 'MACHINERY' then 'IT staff' when 'BUILDING' then 'Laborers' when 'FURNITURE' then 'Unemployed' else null end as OCCUPATION_TYPE, case c_nationkey % 5 when 0 then 'Industry: type 1' when 1 then 'Trade: type 2' when 2 then 'Bank' when 3 then 'Unemployed' else 'School' end as ORGANIZATION_TYPE
 from {customer}
""",
    "prev_apps": """
select o_orderkey as SK_ID_PREV, o_custkey as SK_ID_CURR,
 case o_orderkey % 4 when 0 then 'Consumer loans' when 1 then 'Cash loans' when 2 then 'Revolving loans' else 'XNA' end as NAME_CONTRACT_TYPE,
 case o_orderstatus when 'F' then 'Approved' when 'O' then 'Refused' else 'Canceled' end as NAME_CONTRACT_STATUS,
 case o_orderkey % 3 when 0 then 'XNA' when 1 then 'x-sell' else 'walk-in' end as NAME_PRODUCT_TYPE,
 case o_orderpriority when '1-URGENT' then 'high' when '2-HIGH' then 'middle' when '3-MEDIUM' then 'low_normal' when '5-LOW' then 'low_action' else 'XNA' end as NAME_YIELD_GROUP,
 case when o_orderkey % 9 = 0 then 'N' else 'Y' end as FLAG_LAST_APPL_PER_CONTRACT,
 case when o_orderkey % 7 = 0 then 0e0 else o_totalprice end as AMT_CREDIT,
 cast(nullif(o_orderkey % 6, 0) as double) as CNT_PAYMENT,
 cast(o_orderkey % 13 - 1 as double) as AMT_DOWN_PAYMENT, case when o_orderkey % 13 = 5 then null else (o_orderkey % 13) / 2e1 end as RATE_DOWN_PAYMENT,
 cast(nullif((o_orderkey * 7) % 20000, 0) as double) as AMT_ANNUITY, cast(case when o_orderkey % 3 = 0 then -1 else o_orderkey % 500 end as double) as SELLERPLACE_AREA,
 -cast(1 + (o_orderkey * 19) % 2900 as int) as DAYS_DECISION,
 cast(case when o_orderkey % 5 = 0 then 365243 else 400 - 1 - (o_orderkey * 19) % 2900 end as double) as DAYS_TERMINATION
 from {orders} where o_custkey % 10 <> 9
""",
    "installments": """
select l_orderkey as SK_ID_PREV, o_custkey as SK_ID_CURR, cast(nullif(l_linenumber % 3, 2) as double) as NUM_INSTALMENT_VERSION,
 -cast((l_partkey * 3) % 2900 as int) as DAYS_INSTALMENT, cast(case when l_discount > 95e-3 then null else -((l_partkey * 3) % 2900) + cast(l_quantity as int) % 4 - 2 end as double) as DAYS_ENTRY_PAYMENT,
 l_extendedprice as AMT_INSTALMENT, case when l_tax > 75e-3 then null when l_quantity > 45 then l_extendedprice * 5e-1 else l_extendedprice end as AMT_PAYMENT
 from {lineitem} join {orders} on l_orderkey = o_orderkey
""",
    "pos_cash": """
select l_orderkey as SK_ID_PREV, o_custkey as SK_ID_CURR, -cast((l_linenumber - l_linenumber % 2) * 4 + l_partkey % 4 as int) as MONTHS_BALANCE,
 cast(nullif(l_suppkey % 3, 0) as double) as CNT_INSTALMENT, cast(nullif(cast(l_quantity as int) % 12, 0) as double) as CNT_INSTALMENT_FUTURE,
 case when l_suppkey % 11 = 0 then 'Completed' when l_suppkey % 11 = 1 then 'Returned to the store' else 'Active' end as NAME_CONTRACT_STATUS,
 cast(case when l_tax > 75e-3 then null when l_quantity > 48 then 3 else 0 end as int) as SK_DPD, (l_partkey * 100000000 + l_suppkey) * 10 + l_linenumber as ROW_TIEBREAK
 from {lineitem} join {orders} on l_orderkey = o_orderkey where l_returnflag = 'A'
""",
    "credit_card": """
select l_orderkey as SK_ID_PREV, o_custkey as SK_ID_CURR, -cast(l_linenumber as int) as MONTHS_BALANCE,
 case when l_discount > 95e-3 then null when l_quantity < 3 then -1e0 else l_extendedprice end as AMT_DRAWINGS_CURRENT,
 6e4 as AMT_CREDIT_LIMIT_ACTUAL, l_quantity * 10 as AMT_INST_MIN_REGULARITY, cast(nullif(l_suppkey * 5, 0) as double) as AMT_PAYMENT_CURRENT,
 case when l_suppkey % 9 = 0 then 'Completed' when l_suppkey % 9 = 1 then 'Refused' else 'Active' end as NAME_CONTRACT_STATUS,
 cast(case when l_quantity > 47 then 2 else 0 end as int) as SK_DPD
 from {lineitem} join {orders} on l_orderkey = o_orderkey where l_returnflag = 'R'
""",
    "bureau": """
select o_orderkey as SK_ID_BUREAU, o_custkey as SK_ID_CURR, case o_orderstatus when 'F' then 'Closed' when 'O' then 'Active' else 'Sold' end as CREDIT_ACTIVE,
 case o_orderkey % 3 when 0 then 'Consumer credit' when 1 then 'Credit card' else 'Mortgage' end as CREDIT_TYPE,
 -cast(30 + (o_orderkey * 23) % 2900 as int) as DAYS_CREDIT, cast(case when o_orderkey % 8 = 0 then null when o_orderkey % 31 = 1 then 31000 else (o_orderkey * 29) % 3000 - 1500 end as double) as DAYS_CREDIT_ENDDATE,
 cast(case when o_orderkey % 4 = 0 then null else -((o_orderkey * 23) % 2900) + o_orderkey % 60 end as double) as DAYS_ENDDATE_FACT,
 case when o_orderkey % 97 = 96 then 5 when o_orderkey % 101 = 7 then -40000 else -cast((o_orderkey * 41) % 900 as int) end as DAYS_CREDIT_UPDATE,
 cast(case when o_orderkey % 40 = 0 then 9 else 0 end as int) as CREDIT_DAY_OVERDUE, cast(case when o_orderkey % 50 = 0 then 1 else 0 end as int) as CNT_CREDIT_PROLONG,
 cast(case when o_orderkey % 6 = 0 then null when o_orderkey % 6 < 4 then 0 else o_totalprice / 4 - 2000 end as double) as AMT_CREDIT_SUM_DEBT, cast(nullif(o_orderkey % 9 - 2, 6) as double) as AMT_CREDIT_SUM_LIMIT,
 case when o_orderkey % 45 = 0 then 1e2 else 0e0 end as AMT_CREDIT_SUM_OVERDUE, o_totalprice as AMT_CREDIT_SUM, cast(nullif(o_orderkey % 5, 0) as double) as AMT_CREDIT_MAX_OVERDUE
 from {orders} where o_custkey % 7 <> 3
""",
    "bureau_balance": """
select l_orderkey as SK_ID_BUREAU, -cast((l_linenumber - l_linenumber % 2) * 3 + l_partkey % 3 as int) as MONTHS_BALANCE,
 case when l_partkey % 41 = 7 then 'Closed' when l_partkey % 41 = 9 then '' when l_suppkey % 8 < 6 then cast(l_suppkey % 8 as varchar(1)) when l_suppkey % 8 = 6 then 'C' else 'X' end as STATUS, (l_partkey * 100000000 + l_suppkey) * 10 + l_linenumber as ROW_TIEBREAK
 from {lineitem} where l_linestatus = 'O'
""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def view(read: Callable[[str], DataFrame], name: str) -> DataFrame:
    """One lending table as a DataFrame; `read` returns a test table by name."""
    text = VIEWS[name]
    used = {t: read(t) for t in ("customer", "orders", "lineitem") if "{" + t + "}" in text}
    return next(iter(used.values())).sparkSession.sql(text, **used)


def view_sql(name: str) -> str:
    """The same table as plain SQL over registered views."""
    return VIEWS[name].format(customer="customer", orders="orders", lineitem="lineitem").strip()


def with_views(query: str, *names: str) -> str:
    """Prefix a query with the lending tables it reads, as common table expressions."""
    parts = [f"{name} as (\n{view_sql(name)}\n)" for name in names]
    query = query.strip()
    if query.lower().startswith("with "):
        return "with " + ",\n".join(parts) + ",\n" + query[5:]
    return "with " + ",\n".join(parts) + "\n" + query
