"""Queries on the client table and its merge with the history features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.operators import cleaning, clients, profiling
from loanlens.registry import bureau as bureau_registry
from loanlens.registry import previous as previous_registry
from loanlens.registry.common import Lending, rounded, rsql
from loanlens.sources.views import with_views


def client_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clients.client_features(Lending(spark, sf_dir).clients)
    return rounded(out.select("SK_ID_CURR", "DEBT_TO_INCOME", "CREDIT_TERM", "INCOME_PER_ANNUITY_UNIT", "DAYS_EMPLOYED_PERCENT"))


def client_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clients.client_features(Lending(spark, sf_dir).clients)
    return out.select("SK_ID_CURR", "LIVES_IN_POPULATED_AREA", "FRIEND_DEFAULTED", "FRIEND_HAD_DPD", "MISSING_BUREAU", "HAD_ENQUIRIES")


def ext_source_row_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clients.client_features(Lending(spark, sf_dir).clients)
    return rounded(out.select("SK_ID_CURR", "AVG_EXT_SOURCE", "SUM_EXT_SOURCE"))


def count_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clients.client_features(Lending(spark, sf_dir).clients).select("SK_ID_CURR", "CNT_CHILDREN", "CNT_FAM_MEMBERS")


RECODED = ["NAME_INCOME_TYPE", "OCCUPATION_TYPE", "ORGANIZATION_TYPE", "NAME_TYPE_SUITE", "NAME_HOUSING_TYPE",
           "CODE_GENDER", "NAME_FAMILY_STATUS"]


def rare_category_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.group_rare_categories(Lending(spark, sf_dir).clients).select("SK_ID_CURR", *RECODED)


def drop_correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns found redundant are gone; 'Unemployed' is missing in occupation and organisation."""
    out = clients.client_features(Lending(spark, sf_dir).clients)
    out = cleaning.drop_columns(out, ["DAYS_EMPLOYED_PERCENT", "AMT_GOODS_PRICE"], ["OCCUPATION_TYPE", "ORGANIZATION_TYPE"])
    return rounded(out.select(*[c for c in out.columns if c in (
        "SK_ID_CURR", "OCCUPATION_TYPE", "ORGANIZATION_TYPE", "DAYS_EMPLOYED_PERCENT", "DEBT_TO_INCOME")]))


MERGED = ["SK_ID_CURR", "TARGET", "DEBT_TO_INCOME", "HAD_ENQUIRIES", "APPLICATION_COUNT_PREV", "APPLICATION_COUNT_BUREAU",
          "HAD_DPD_PREV", "HAD_NON_APPROVED_PREV", "HAD_DEBT_BUREAU", "AVERAGE_LOAN_LENGTH_PREV", "DPD_COUNT",
          "SUM_AMT_DEBT_BUREAU", "AVG_DAYS_CREDIT_BUREAU"]


def merge_client_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Lending(spark, sf_dir).matrix().select(*MERGED))


def history_default_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Lending(spark, sf_dir)
    parts = [
        clients.history_default_rate(t.clients, t.previous_features(), "APPLICATION_COUNT_PREV").withColumn("HISTORY", F.lit("PREV")),
        clients.history_default_rate(t.clients, t.bureau_features(), "APPLICATION_COUNT_BUREAU").withColumn("HISTORY", F.lit("BUREAU")),
    ]
    return rounded(parts[0].unionByName(parts[1]))


def history_flag_default_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default rate by every yes/no history feature."""
    t = Lending(spark, sf_dir)
    known = t.clients.select("SK_ID_CURR", "TARGET").join(t.previous_features(), "SK_ID_CURR", "left").join(
        t.bureau_features(), "SK_ID_CURR", "left")
    known = cleaning.unknown_texts(known)
    return rounded(profiling.target_rate(known, previous_registry.FLAGS + bureau_registry.FLAGS, "TARGET"))


QUERIES = {f.__name__: f for f in (
    client_ratios, client_flags, ext_source_row_stats, count_caps, rare_category_group, drop_correlated,
    merge_client_features, history_default_rate, history_flag_default_rate)}


# ---- the same results in SQL ----

POSITIVE = "case when {} then 1 else 0 end"
HISTORY_TABLES = ("clients", *previous_registry.TABLES, *bureau_registry.TABLES)


def _history_sql(query: str) -> str:
    parts = [previous_registry.loans_sql(previous_registry.CLEAN, previous_registry.CLIENT, previous_registry.HIST),
             bureau_registry.STATUS, bureau_registry.KEPT, bureau_registry.RULES, bureau_registry.CLIENT]
    return with_views("with " + ",\n".join(parts) + "\n" + query, *HISTORY_TABLES)


ORG = """case when ORGANIZATION_TYPE like 'Industry%' then 'Industry' when ORGANIZATION_TYPE like 'Business Entity%' then 'Business Entity'
  when ORGANIZATION_TYPE like 'Trade%' then 'Trade' when ORGANIZATION_TYPE like 'Transport%' then 'Transport'
  when ORGANIZATION_TYPE in ('Religion', 'Cleaning', 'Legal Services', 'Mobile', 'Culture', 'Realtor', 'Advertising', 'Emergency',
   'Telecom', 'Insurance', 'Electricity', 'Hotel', 'Military', 'Bank', 'Agriculture', 'Police', 'Postal', 'Security Ministries',
   'Restaurant', 'University', 'Services', 'Housing') then 'Other' else ORGANIZATION_TYPE end"""

SQL = {
    "client_ratios": with_views(f"""select SK_ID_CURR, {rsql(
        DEBT_TO_INCOME="AMT_CREDIT / nullif(AMT_INCOME_TOTAL, 0)", CREDIT_TERM="AMT_CREDIT / nullif(AMT_ANNUITY, 0)",
        INCOME_PER_ANNUITY_UNIT="AMT_INCOME_TOTAL / nullif(AMT_ANNUITY, 0)",
        DAYS_EMPLOYED_PERCENT="DAYS_EMPLOYED / nullif(cast(DAYS_BIRTH as double), 0)")} from clients""", "clients"),
    "client_flags": with_views("""select SK_ID_CURR,
 case when REGION_POPULATION_RELATIVE > 4e-2 then 1 else 0 end as LIVES_IN_POPULATED_AREA,
 case when DEF_60_CNT_SOCIAL_CIRCLE > 0 then 1 when DEF_30_CNT_SOCIAL_CIRCLE > 0 then 1 else 0 end as FRIEND_DEFAULTED,
 case when OBS_60_CNT_SOCIAL_CIRCLE > 0 then 1 when OBS_30_CNT_SOCIAL_CIRCLE > 0 then 1 else 0 end as FRIEND_HAD_DPD,
 case when AMT_REQ_CREDIT_BUREAU_WEEK is null then 1 else 0 end as MISSING_BUREAU,
 case when greatest(coalesce(AMT_REQ_CREDIT_BUREAU_HOUR, 0), coalesce(AMT_REQ_CREDIT_BUREAU_DAY, 0), coalesce(AMT_REQ_CREDIT_BUREAU_WEEK, 0),
  coalesce(AMT_REQ_CREDIT_BUREAU_MON, 0), coalesce(AMT_REQ_CREDIT_BUREAU_QRT, 0), coalesce(AMT_REQ_CREDIT_BUREAU_YEAR, 0)) > 0
  then 1 else 0 end as HAD_ENQUIRIES
from clients""", "clients"),
    "ext_source_row_stats": with_views(f"""select SK_ID_CURR, {rsql(
        AVG_EXT_SOURCE="(select avg(x) from unnest([EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3]) as u(x))",
        SUM_EXT_SOURCE="(select coalesce(sum(x), 0) from unnest([EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3]) as u(x))")} from clients""", "clients"),
    "count_caps": with_views("""select SK_ID_CURR, case when CNT_CHILDREN >= 3 then 3e0 else CNT_CHILDREN end as CNT_CHILDREN,
 case when CNT_FAM_MEMBERS >= 4 then 4e0 else CNT_FAM_MEMBERS end as CNT_FAM_MEMBERS from clients""", "clients"),
    "rare_category_group": with_views(f"""select SK_ID_CURR,
 case when NAME_INCOME_TYPE in ('Businessman', 'Student', 'Maternity leave', 'Unemployed', 'Pensioner') then 'Other' else NAME_INCOME_TYPE end as NAME_INCOME_TYPE,
 case when OCCUPATION_TYPE in ('Private service staff', 'IT staff', 'HR staff', 'Realty agents', 'Secretaries', 'Waiters/barmen staff',
  'Low-skill Laborers') then 'Other' else OCCUPATION_TYPE end as OCCUPATION_TYPE,
 {ORG} as ORGANIZATION_TYPE,
 case when NAME_TYPE_SUITE in ('Group of people', 'Other_A', 'UNKNOWN', 'Other_B') then 'Other' else NAME_TYPE_SUITE end as NAME_TYPE_SUITE,
 case when NAME_HOUSING_TYPE in ('Co-op apartment', 'Office apartment') then 'Other' else NAME_HOUSING_TYPE end as NAME_HOUSING_TYPE,
 case when CODE_GENDER = 'UNKNOWN' then 'F' else CODE_GENDER end as CODE_GENDER,
 case when NAME_FAMILY_STATUS = 'UNKNOWN' then 'Married' else NAME_FAMILY_STATUS end as NAME_FAMILY_STATUS
from clients""", "clients"),
    "drop_correlated": with_views(f"""select SK_ID_CURR, nullif(OCCUPATION_TYPE, 'Unemployed') as OCCUPATION_TYPE,
 nullif(ORGANIZATION_TYPE, 'Unemployed') as ORGANIZATION_TYPE, {rsql(DEBT_TO_INCOME="AMT_CREDIT / nullif(AMT_INCOME_TOTAL, 0)")}
from clients""", "clients"),
    "merge_client_features": _history_sql(f"""select c.SK_ID_CURR, c.TARGET, {rsql(
        DEBT_TO_INCOME="c.AMT_CREDIT / nullif(c.AMT_INCOME_TOTAL, 0)", AVERAGE_LOAN_LENGTH_PREV="p.AVERAGE_LOAN_LENGTH_PREV",
        SUM_AMT_DEBT_BUREAU="b.SUM_AMT_DEBT_BUREAU", AVG_DAYS_CREDIT_BUREAU="-b.AVG_DAYS_CREDIT_BUREAU")},
 case when AMT_REQ_CREDIT_BUREAU_HOUR > 0 or AMT_REQ_CREDIT_BUREAU_DAY > 0 or AMT_REQ_CREDIT_BUREAU_WEEK > 0 or AMT_REQ_CREDIT_BUREAU_MON > 0
  or AMT_REQ_CREDIT_BUREAU_QRT > 0 or AMT_REQ_CREDIT_BUREAU_YEAR > 0 then 1 else 0 end as HAD_ENQUIRIES,
 coalesce(p.APPLICATION_COUNT_PREV, 0) as APPLICATION_COUNT_PREV, coalesce(b.APPLICATION_COUNT_BUREAU, 0) as APPLICATION_COUNT_BUREAU,
 p.HAD_DPD_PREV, p.HAD_NON_APPROVED_PREV, b.HAD_DEBT_BUREAU, h.DPD_COUNT
from clients c left join client_prev p on p.SK_ID_CURR = c.SK_ID_CURR left join history h on h.SK_ID_CURR = c.SK_ID_CURR
 left join client_bureau b on b.SK_ID_CURR = c.SK_ID_CURR"""),
    "history_default_rate": with_views(f"""with {bureau_registry.KEPT},
f as (select 'PREV' as HISTORY, TARGET, case when SK_ID_CURR in (select SK_ID_CURR from prev_apps where FLAG_LAST_APPL_PER_CONTRACT = 'Y') then 1 else 0 end as HAS_HISTORY from clients
 union all select 'BUREAU', TARGET, case when SK_ID_CURR in (select SK_ID_CURR from kept) then 1 else 0 end from clients)
select HISTORY, HAS_HISTORY, count(*) as clients, round(avg(TARGET) + 1e-10, 6) as default_rate from f group by 1, 2""", "clients", "prev_apps", "bureau"),
    "history_flag_default_rate": _history_sql("with_flags as (\n select c.TARGET, " + ", ".join(
        f"coalesce({c}, 'UNKNOWN') as {c}" for c in previous_registry.FLAGS + bureau_registry.FLAGS) + """
 from clients c left join client_prev p on p.SK_ID_CURR = c.SK_ID_CURR left join client_bureau b on b.SK_ID_CURR = c.SK_ID_CURR)
""" + "\nunion all ".join(
        f"select '{c}' as \"column\", {c} as value, count(*) as n, round(avg(TARGET) + 1e-10, 6) as target_rate from with_flags group by {c}"
        for c in previous_registry.FLAGS + bureau_registry.FLAGS)).replace("\nwith_flags as", ",\nwith_flags as", 1),
}
