"""Queries on credits reported by other lenders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loanlens.operators import bureau, cleaning
from loanlens.plans import features
from loanlens.registry.common import TIE, Lending, rounded, rsql
from loanlens.sources.views import with_views


def bureau_current_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bureau.credit_status_features(Lending(spark, sf_dir).bureau_balance, TIE)
    return out.select("SK_ID_BUREAU", "CURRENT_STATUS", "LAST_SNAPSHOT")


def bureau_balance_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bureau.credit_status_features(Lending(spark, sf_dir).bureau_balance, TIE)
    return out.select("SK_ID_BUREAU", *[f"HAD_{k}_DPD" for k in bureau.DPD_LEVELS])


def bureau_clean_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bureau.clamp_credits(bureau.drop_impossible_credits(Lending(spark, sf_dir).bureau))
    out = bureau.cap_end_date(out)
    return rounded(out.select("SK_ID_BUREAU", "DAYS_CREDIT", "DAYS_CREDIT_ENDDATE", "AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_LIMIT"))


def bureau_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Lending(spark, sf_dir).credits()
    return rounded(out.select("SK_ID_BUREAU", "SK_ID_CURR", "CREDIT_ACTIVE", "CURRENT_STATUS", "LOAN_LENGTH"))


FLAGS = ["HAD_CONSUMER_LOAN_BUREAU", "HAD_REVOLVING_LOAN_BUREAU", "HAS_ONGOING_LOAN_BUREAU", "HAD_PROLONGATION_BUREAU",
         "HAD_DPD_BUREAU", "HAD_1DPD_BUREAU", "HAD_2DPD_BUREAU", "HAD_3DPD_BUREAU", "HAD_4DPD_BUREAU",
         "HAD_5DPD_BUREAU", "HAD_DEBT_BUREAU", "HAD_AMT_OVERDUE_BUREAU"]
NUMBERS = ["SUM_AMT_DEBT_BUREAU", "SUM_AMT_OVERDUE_BUREAU", "AVG_AMT_CREDIT_SUM_BUREAU", "MAX_AMT_CREDIT_SUM_BUREAU",
           "MAX_AMT_CREDIT_MAX_OVERDUE_BUREAU", "LAST_SNAPSHOT_MEAN_BUREAU", "AVG_DAYS_CREDIT_BUREAU",
           "AVG_DAYS_ENDDATE_FACT_BUREAU", "MAX_DAYS_ENDDATE_FACT_BUREAU", "AVG_LOAN_LENGTH_BUREAU"]
WHOLE = ["DPD_SUM_BUREAU", "LAST_SNAPSHOT_MAX_BUREAU", "MAX_DAYS_CREDIT_BUREAU"]


def client_bureau_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Lending(spark, sf_dir).bureau_features().select("SK_ID_CURR", "APPLICATION_COUNT_BUREAU", *FLAGS)


def client_bureau_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Lending(spark, sf_dir).bureau_features().select("SK_ID_CURR", *WHOLE, *NUMBERS))


def bureau_sign_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.bureau_feature_table(Lending(spark, sf_dir).bureau_features())
    return rounded(out.select("SK_ID_CURR", *cleaning.BUREAU_NEGATIVE))


QUERIES = {f.__name__: f for f in (
    bureau_current_status, bureau_balance_flags, bureau_clean_filter, bureau_reconcile, client_bureau_flags,
    client_bureau_numeric, bureau_sign_flip)}


# ---- the same results in SQL ----

def _yes(condition: str) -> str:
    return f"case when count(*) filter (where {condition}) > 0 then 'YES' else 'NO' end"


STATUS = f"""status as (
 select f.SK_ID_BUREAU, l.STATUS as CURRENT_STATUS, f.LAST_SNAPSHOT, {", ".join(f"f.HAD_{k}_DPD" for k in range(1, 6))}
 from (select SK_ID_BUREAU, max(MONTHS_BALANCE) as LAST_SNAPSHOT,
   {", ".join(f"{_yes(f"STATUS = '{k}'")} as HAD_{k}_DPD" for k in range(1, 6))} from bureau_balance group by 1) f
 join (select SK_ID_BUREAU, STATUS, row_number() over (partition by SK_ID_BUREAU order by MONTHS_BALANCE desc, {TIE}) as rn
   from bureau_balance) l on l.SK_ID_BUREAU = f.SK_ID_BUREAU and l.rn = 1)"""

KEPT = """kept as (
 select * from bureau where coalesce(DAYS_CREDIT <= DAYS_CREDIT_ENDDATE, true) and coalesce(DAYS_CREDIT <= DAYS_ENDDATE_FACT, true)
  and coalesce(DAYS_CREDIT_UPDATE between -5000 and 0, true) and coalesce(DAYS_CREDIT <= DAYS_CREDIT_UPDATE, true))"""

# One step per rule, each reading the step before.
RULES = """r0 as (
 select k.*, coalesce(s.CURRENT_STATUS, 'UNKNOWN') as st, s.LAST_SNAPSHOT, k.CREDIT_ACTIVE as act, k.DAYS_CREDIT_UPDATE / 30.44e0 as mcu,
  s.HAD_1_DPD, s.HAD_2_DPD, s.HAD_3_DPD, s.HAD_4_DPD, s.HAD_5_DPD
 from kept k left join status s on s.SK_ID_BUREAU = k.SK_ID_BUREAU),
r1 as (select * replace (case when act = 'Active' and DAYS_ENDDATE_FACT is not null then 'Closed' else act end as act,
  case when act = 'Active' and DAYS_ENDDATE_FACT is not null then 'C' else st end as st) from r0),
r2 as (select * replace (case when act = 'Active' and st = 'C' and mcu < LAST_SNAPSHOT then 'Closed' else act end as act) from r1),
r3 as (select * replace (case when act = 'Active' and st in ('C', 'X', 'UNKNOWN') and mcu > LAST_SNAPSHOT then '0' else st end as st) from r2),
r4 as (select * replace (case when act = 'Closed' and st between '0' and '5' and mcu < LAST_SNAPSHOT then 'Active' else act end as act) from r3),
r5 as (select * replace (case when act = 'Closed' and st between '0' and '5' and mcu > LAST_SNAPSHOT then 'C' else st end as st) from r4)"""

CLIENT = f"""client_bureau as (
 select SK_ID_CURR, count(*) as APPLICATION_COUNT_BUREAU,
  {_yes("CREDIT_TYPE = 'Consumer credit'")} as HAD_CONSUMER_LOAN_BUREAU, {_yes("CREDIT_TYPE = 'Credit card'")} as HAD_REVOLVING_LOAN_BUREAU,
  {_yes("act = 'Active'")} as HAS_ONGOING_LOAN_BUREAU, {_yes("CNT_CREDIT_PROLONG is null or CNT_CREDIT_PROLONG <> 0")} as HAD_PROLONGATION_BUREAU,
  {_yes("CREDIT_DAY_OVERDUE is null or CREDIT_DAY_OVERDUE <> 0")} as HAD_DPD_BUREAU,
  cast(coalesce(sum(CREDIT_DAY_OVERDUE), 0) as bigint) as DPD_SUM_BUREAU,
  {", ".join(f"{_yes(f"HAD_{k}_DPD = 'YES'")} as HAD_{k}DPD_BUREAU" for k in range(1, 6))},
  {_yes("AMT_CREDIT_SUM_DEBT is null or AMT_CREDIT_SUM_DEBT > 0")} as HAD_DEBT_BUREAU,
  coalesce(sum(greatest(AMT_CREDIT_SUM_DEBT, 0)), 0) as SUM_AMT_DEBT_BUREAU,
  coalesce(sum(AMT_CREDIT_SUM_OVERDUE), 0) as SUM_AMT_OVERDUE_BUREAU,
  {_yes("AMT_CREDIT_SUM_OVERDUE is null or AMT_CREDIT_SUM_OVERDUE <> 0")} as HAD_AMT_OVERDUE_BUREAU,
  avg(AMT_CREDIT_SUM) as AVG_AMT_CREDIT_SUM_BUREAU, max(AMT_CREDIT_SUM) as MAX_AMT_CREDIT_SUM_BUREAU,
  max(AMT_CREDIT_MAX_OVERDUE) as MAX_AMT_CREDIT_MAX_OVERDUE_BUREAU, max(LAST_SNAPSHOT) as LAST_SNAPSHOT_MAX_BUREAU,
  avg(LAST_SNAPSHOT) as LAST_SNAPSHOT_MEAN_BUREAU, avg(DAYS_CREDIT) as AVG_DAYS_CREDIT_BUREAU,
  max(DAYS_CREDIT) as MAX_DAYS_CREDIT_BUREAU, avg(DAYS_ENDDATE_FACT) as AVG_DAYS_ENDDATE_FACT_BUREAU,
  max(DAYS_ENDDATE_FACT) as MAX_DAYS_ENDDATE_FACT_BUREAU, avg(DAYS_ENDDATE_FACT - DAYS_CREDIT) as AVG_LOAN_LENGTH_BUREAU
 from r5 group by SK_ID_CURR)"""

TABLES = ("bureau", "bureau_balance")


def bureau_sql(query: str, *tail: str) -> str:
    return with_views("with " + ",\n".join([STATUS, KEPT, RULES, *tail]) + "\n" + query, *TABLES)


SQL = {
    "bureau_current_status": with_views(f"with {STATUS}\nselect SK_ID_BUREAU, CURRENT_STATUS, LAST_SNAPSHOT from status", "bureau_balance"),
    "bureau_balance_flags": with_views(f"with {STATUS}\nselect SK_ID_BUREAU, {', '.join(f'HAD_{k}_DPD' for k in range(1, 6))} from status", "bureau_balance"),
    "bureau_clean_filter": with_views(f"""with {KEPT}
select SK_ID_BUREAU, DAYS_CREDIT, {rsql(
        DAYS_CREDIT_ENDDATE="case when DAYS_CREDIT_ENDDATE > 10000 then 10000 else DAYS_CREDIT_ENDDATE end",
        AMT_CREDIT_SUM_DEBT="case when AMT_CREDIT_SUM_DEBT < 0 then 0 else AMT_CREDIT_SUM_DEBT end",
        AMT_CREDIT_SUM_LIMIT="case when AMT_CREDIT_SUM_LIMIT < 0 then 0 else AMT_CREDIT_SUM_LIMIT end")}
from kept""", "bureau"),
    "bureau_reconcile": bureau_sql(f"""select SK_ID_BUREAU, SK_ID_CURR, act as CREDIT_ACTIVE, st as CURRENT_STATUS,
 {rsql(LOAN_LENGTH="DAYS_ENDDATE_FACT - DAYS_CREDIT")} from r5"""),
    "client_bureau_flags": bureau_sql(f"select SK_ID_CURR, APPLICATION_COUNT_BUREAU, {', '.join(FLAGS)} from client_bureau", CLIENT),
    "client_bureau_numeric": bureau_sql(f"select SK_ID_CURR, {', '.join(WHOLE)}, {rsql(**{c: c for c in NUMBERS})} from client_bureau", CLIENT),
    "bureau_sign_flip": bureau_sql(f"""select SK_ID_CURR, -MAX_DAYS_CREDIT_BUREAU as MAX_DAYS_CREDIT_BUREAU,
 -LAST_SNAPSHOT_MAX_BUREAU as LAST_SNAPSHOT_MAX_BUREAU, {rsql(
        AVG_DAYS_CREDIT_BUREAU="-AVG_DAYS_CREDIT_BUREAU", AVG_DAYS_ENDDATE_FACT_BUREAU="-AVG_DAYS_ENDDATE_FACT_BUREAU",
        MAX_DAYS_ENDDATE_FACT_BUREAU="-MAX_DAYS_ENDDATE_FACT_BUREAU", LAST_SNAPSHOT_MEAN_BUREAU="-LAST_SNAPSHOT_MEAN_BUREAU")}
from client_bureau""", CLIENT),
}
