"""Queries on previous loans, from monthly rows to client features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.operators import cleaning, clients, previous, profiling
from loanlens.plans import features
from loanlens.registry.common import TIE, Lending, rounded, rsql
from loanlens.sources.views import with_views


def late_payer_default_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do clients who paid late before default more often?"""
    t = Lending(spark, sf_dir)
    history = previous.loan_installment_features(t.installments)
    loans = cleaning.last_application_per_contract(t.prev_apps).join(history, "SK_ID_PREV", "left")
    by_client = loans.groupBy("SK_ID_CURR").agg(
        F.count(F.lit(1)).alias("APPLICATION_COUNT_PREV"),
        *[previous.any_eq(c, "YES").alias(f"{c}_PREV") for c in ("HAD_DPD", "VERSION_CHANGED", "UNDERPAID")])
    merged = t.clients.select("SK_ID_CURR", "TARGET").join(by_client, "SK_ID_CURR", "left").fillna(
        {"APPLICATION_COUNT_PREV": 0})
    rates = profiling.target_rate(merged, ["HAD_DPD_PREV", "VERSION_CHANGED_PREV", "UNDERPAID_PREV"], "TARGET")
    return rounded(rates)


def pos_loan_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(previous.loan_pos_features(Lending(spark, sf_dir).pos_cash, TIE))


def installment_loan_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(previous.loan_installment_features(Lending(spark, sf_dir).installments))


def card_loan_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(previous.loan_card_features(Lending(spark, sf_dir).credit_card))


def loan_feature_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Lending(spark, sf_dir)
    loans = previous.loan_features(t.prev_apps, t.pos_cash, t.installments, t.credit_card, TIE)
    return rounded(loans.select(
        "SK_ID_PREV", "SK_ID_CURR", "UNDERPAID", "IS_COMPLETED", "LAST_SNAPSHOT", "AVERAGE_SNAPSHOT", "HAD_DPD",
        "VERSION_CHANGED", "EXCEEDED_LIMIT", "INSTALLMENT_CHANGED", "INSTALLMENT_COUNT", "LOAN_LENGTH"))


def sentinel_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Lending(spark, sf_dir)
    out = cleaning.sentinels_to_null(cleaning.last_application_per_contract(t.prev_apps))
    return out.select(
        "SK_ID_PREV", "NAME_CONTRACT_TYPE", "NAME_PRODUCT_TYPE", "NAME_YIELD_GROUP", "SELLERPLACE_AREA",
        "AMT_DOWN_PAYMENT", "RATE_DOWN_PAYMENT", "DAYS_TERMINATION")


def yield_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Lending(spark, sf_dir)
    out = cleaning.yield_group_to_code(cleaning.unknown_texts(cleaning.sentinels_to_null(t.prev_apps)))
    return out.select("SK_ID_PREV", "NAME_CONTRACT_TYPE", "NAME_YIELD_GROUP")


def amount_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Lending(spark, sf_dir)
    out = cleaning.fill_amounts(cleaning.unknown_texts(cleaning.sentinels_to_null(t.prev_apps)))
    return rounded(out.select("SK_ID_PREV", "AMT_ANNUITY", "AMT_CREDIT", "AMT_DOWN_PAYMENT", "RATE_DOWN_PAYMENT"))


def unapproved_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    loans = Lending(spark, sf_dir).loans()
    return rounded(loans.select("SK_ID_PREV", "IS_COMPLETED", "INSTALLMENT_COUNT", "CNT_PAYMENT", "LOAN_LENGTH"))


FLAGS = ["HAD_NON_APPROVED_PREV", "HAD_CONSUMER_LOAN_PREV", "HAD_REVOLVING_LOAN_PREV", "HAD_CASH_LOAN_PREV",
         "HAD_X_SELL_PREV", "HAS_ONGOING_LOAN_PREV", "HAS_ONGOING_LOAN_PREV_FIXED", "HAD_DPD_PREV",
         "VERSION_CHANGED_PREV", "LIMIT_EXCEEDED_PREV", "UNDERPAID_PREV", "INSTALLMENTS_OVER_CNT_PAYMENT_PREV"]
NUMBERS = ["AVERAGE_YIELD_GROUP_PREV", "AVERAGE_LOAN_LENGTH_PREV", "AVERAGE_CNT_PAYMENT_PREV",
           "LAST_SNAPSHOT_MAX_PREV", "LAST_SNAPSHOT_MEAN_PREV", "DAYS_DECISION_MEAN_PREV", "DAYS_DECISION_MAX_PREV",
           "INSTALLMENT_COUNT_MEAN_PREV", "AVERAGE_AMT_CREDIT_PREV", "AVERAGE_RATE_DOWN_PAYMENT_PREV"]
HISTORY = ["DPD_COUNT", "AVERAGE_DRAWINGS_PREV", "AVERAGE_INSTALLMENT_PREV", "AVG_MONTHS_BALANCE"]


def client_prev_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    loans = Lending(spark, sf_dir).loans()
    return previous.client_loan_features(loans).select("SK_ID_CURR", "APPLICATION_COUNT_PREV", *FLAGS)


def client_prev_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    loans = Lending(spark, sf_dir).loans()
    return rounded(previous.client_loan_features(loans).select("SK_ID_CURR", *NUMBERS))


def client_monthly_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Lending(spark, sf_dir).previous_features().select("SK_ID_CURR", *HISTORY))


def sign_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.previous_feature_table(Lending(spark, sf_dir).previous_features())
    return rounded(out.select("SK_ID_CURR", *cleaning.PREV_NEGATIVE))


def key_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many previous (and revolving) loans occur in each history table."""
    t = Lending(spark, sf_dir)
    revolving = t.prev_apps.filter(F.col("NAME_CONTRACT_TYPE") == "Revolving loans")
    pairs = {"installments": (t.prev_apps, t.installments), "pos_cash": (t.prev_apps, t.pos_cash),
             "credit_card": (revolving, t.credit_card)}
    parts = [clients.key_coverage(a, b, "SK_ID_PREV").select(F.lit(name).alias("history"), "keys", "shared")
             for name, (a, b) in pairs.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES = {f.__name__: f for f in (
    late_payer_default_rate, pos_loan_features, installment_loan_features, card_loan_features, loan_feature_coalesce,
    sentinel_to_null, yield_recode, amount_fill, unapproved_fill, client_prev_flags, client_prev_numeric,
    client_monthly_fallback, sign_flip, key_coverage)}


# ---- the same results in SQL ----

POS = f"""pos_loans as (
 select p.SK_ID_PREV,
  case when p.done or p.known = 0 then p.span else p.span + l.CNT_INSTALMENT_FUTURE end as LOAN_LENGTH,
  p.IS_COMPLETED, p.LAST_SNAPSHOT, p.AVERAGE_SNAPSHOT, p.INSTALLMENT_CHANGED, p.HAD_DPD
 from (
  select SK_ID_PREV, max(MONTHS_BALANCE) - min(MONTHS_BALANCE) + 1 as span,
   count(*) filter (where NAME_CONTRACT_STATUS = 'Completed') > 0 as done, count(CNT_INSTALMENT_FUTURE) as known,
   case when count(*) filter (where NAME_CONTRACT_STATUS in ('Canceled', 'Returned to the store', 'Completed')) > 0
    then 'YES' else 'NO' end as IS_COMPLETED,
   max(MONTHS_BALANCE) as LAST_SNAPSHOT, avg(MONTHS_BALANCE) as AVERAGE_SNAPSHOT,
   case when count(distinct CNT_INSTALMENT) + max(case when CNT_INSTALMENT is null then 1 else 0 end) > 1
    then 'YES' else 'NO' end as INSTALLMENT_CHANGED,
   case when count(*) filter (where SK_DPD is null or SK_DPD <> 0) > 0 then 'YES' else 'NO' end as HAD_DPD
  from pos_cash group by SK_ID_PREV) p
 join (
  select SK_ID_PREV, CNT_INSTALMENT_FUTURE,
   row_number() over (partition by SK_ID_PREV order by MONTHS_BALANCE desc, {TIE}) as rn
  from pos_cash) l on l.SK_ID_PREV = p.SK_ID_PREV and l.rn = 1)"""

INST = """inst_loans as (
 select SK_ID_PREV,
  case when count(distinct NUM_INSTALMENT_VERSION) + max(case when NUM_INSTALMENT_VERSION is null then 1 else 0 end) <> 1
   then 'YES' else 'NO' end as VERSION_CHANGED,
  avg(AMT_INSTALMENT) as AVERAGE_INSTALLMENT,
  case when count(*) filter (where DAYS_ENTRY_PAYMENT > DAYS_INSTALMENT) > 0 then 'YES' else 'NO' end as HAD_DPD,
  case when count(*) filter (where AMT_PAYMENT < AMT_INSTALMENT) > 0 then 'YES' else 'NO' end as UNDERPAID,
  count(*) as INSTALLMENT_COUNT
 from installments group by SK_ID_PREV)"""

CARD = """card_loans as (
 select SK_ID_PREV,
  case when count(*) filter (where NAME_CONTRACT_STATUS in ('Refused', 'Completed')) > 0 then 'YES' else 'NO' end as IS_COMPLETED,
  max(MONTHS_BALANCE) as LAST_SNAPSHOT, avg(MONTHS_BALANCE) as AVERAGE_SNAPSHOT,
  case when count(*) filter (where SK_DPD is null or SK_DPD <> 0) > 0 then 'YES' else 'NO' end as HAD_DPD,
  avg(AMT_DRAWINGS_CURRENT) as AVG_DRAWINGS,
  case when count(*) filter (where AMT_DRAWINGS_CURRENT > AMT_CREDIT_LIMIT_ACTUAL) > 0 then 'YES' else 'NO' end as EXCEEDED_LIMIT,
  case when count(*) filter (where AMT_INST_MIN_REGULARITY > AMT_PAYMENT_CURRENT) > 0 then 'YES' else 'NO' end as UNDERPAID
 from credit_card where AMT_DRAWINGS_CURRENT >= 0 group by SK_ID_PREV)"""

# Loans with their histories; {where} chooses which applications take part.
JOINED = """joined as (
 select a.*, i.VERSION_CHANGED, i.AVERAGE_INSTALLMENT, i.INSTALLMENT_COUNT, p.LOAN_LENGTH, p.INSTALLMENT_CHANGED,
  c.AVG_DRAWINGS, c.EXCEEDED_LIMIT, coalesce(i.UNDERPAID, c.UNDERPAID) as UNDERPAID,
  coalesce(p.IS_COMPLETED, c.IS_COMPLETED) as IS_COMPLETED, coalesce(p.LAST_SNAPSHOT, c.LAST_SNAPSHOT) as LAST_SNAPSHOT,
  coalesce(p.AVERAGE_SNAPSHOT, c.AVERAGE_SNAPSHOT) as AVERAGE_SNAPSHOT, coalesce(i.HAD_DPD, p.HAD_DPD, c.HAD_DPD) as HAD_DPD
 from prev_apps a
 left join inst_loans i on i.SK_ID_PREV = a.SK_ID_PREV
 left join pos_loans p on p.SK_ID_PREV = a.SK_ID_PREV
 left join card_loans c on c.SK_ID_PREV = a.SK_ID_PREV
 {where})"""

LAST_ONLY = "where a.FLAG_LAST_APPL_PER_CONTRACT = 'Y'"

CLEAN = """cleaned as (
 select SK_ID_PREV, SK_ID_CURR, NAME_CONTRACT_STATUS,
  coalesce(nullif(NAME_CONTRACT_TYPE, 'XNA'), 'UNKNOWN') as NAME_CONTRACT_TYPE,
  coalesce(nullif(NAME_PRODUCT_TYPE, 'XNA'), 'UNKNOWN') as NAME_PRODUCT_TYPE,
  cast(case NAME_YIELD_GROUP when 'low_action' then 1 when 'low_normal' then 2 when 'middle' then 3 when 'high' then 4 end as double) as NAME_YIELD_GROUP,
  coalesce(AMT_CREDIT, 0) as AMT_CREDIT, DAYS_DECISION,
  case when nullif(DAYS_TERMINATION, 365243) is null then null else DAYS_TERMINATION end as DAYS_TERMINATION,
  case when RATE_DOWN_PAYMENT is null or AMT_DOWN_PAYMENT < 0 then
    case when coalesce(AMT_CREDIT, 0) = 0 or NAME_CONTRACT_STATUS <> 'Approved' then 0e0 end
   else RATE_DOWN_PAYMENT end as RATE_DOWN_PAYMENT,
  case when IS_COMPLETED is null then case when NAME_CONTRACT_STATUS <> 'Approved' then 'YES' else 'UNKNOWN' end
   else IS_COMPLETED end as IS_COMPLETED,
  case when NAME_CONTRACT_STATUS <> 'Approved' then coalesce(INSTALLMENT_COUNT, 0) else INSTALLMENT_COUNT end as INSTALLMENT_COUNT,
  case when NAME_CONTRACT_STATUS <> 'Approved' then coalesce(CNT_PAYMENT, 0) else CNT_PAYMENT end as CNT_PAYMENT,
  coalesce(LOAN_LENGTH, case when NAME_CONTRACT_STATUS <> 'Approved' then 0
   else ceil((nullif(DAYS_TERMINATION, 365243) - DAYS_DECISION) / 30.44e0) end) as LOAN_LENGTH,
  coalesce(HAD_DPD, 'UNKNOWN') as HAD_DPD, coalesce(VERSION_CHANGED, 'UNKNOWN') as VERSION_CHANGED,
  coalesce(EXCEEDED_LIMIT, 'UNKNOWN') as EXCEEDED_LIMIT, coalesce(UNDERPAID, 'UNKNOWN') as UNDERPAID, LAST_SNAPSHOT
 from joined)"""

HIST = """history as (
 select c.SK_ID_CURR, p.DPD_COUNT, k.AVERAGE_DRAWINGS_PREV, i.AVERAGE_INSTALLMENT_PREV,
  coalesce(p.m, k.m) as AVG_MONTHS_BALANCE
 from (select distinct SK_ID_CURR from cleaned) c
 left join (select SK_ID_CURR, cast(coalesce(sum(SK_DPD), 0) as bigint) as DPD_COUNT, avg(MONTHS_BALANCE) as m from pos_cash group by 1) p
  on p.SK_ID_CURR = c.SK_ID_CURR
 left join (select SK_ID_CURR, avg(AMT_DRAWINGS_CURRENT) as AVERAGE_DRAWINGS_PREV, avg(MONTHS_BALANCE) as m from credit_card group by 1) k
  on k.SK_ID_CURR = c.SK_ID_CURR
 left join (select SK_ID_CURR, avg(AMT_INSTALMENT) as AVERAGE_INSTALLMENT_PREV from installments group by 1) i
  on i.SK_ID_CURR = c.SK_ID_CURR)"""


def _yes(condition: str) -> str:
    return f"case when count(*) filter (where {condition}) > 0 then 'YES' else 'NO' end"


CLIENT = f"""client_prev as (
 select SK_ID_CURR, count(*) as APPLICATION_COUNT_PREV,
  {_yes("NAME_CONTRACT_STATUS <> 'Approved'")} as HAD_NON_APPROVED_PREV,
  {_yes("NAME_CONTRACT_TYPE = 'Consumer loans'")} as HAD_CONSUMER_LOAN_PREV,
  {_yes("NAME_CONTRACT_TYPE = 'Revolving loans'")} as HAD_REVOLVING_LOAN_PREV,
  {_yes("NAME_CONTRACT_TYPE = 'Cash loans'")} as HAD_CASH_LOAN_PREV,
  {_yes("NAME_PRODUCT_TYPE = 'x-sell'")} as HAD_X_SELL_PREV,
  {_yes("IS_COMPLETED in ('YES', 'UNKNOWN')")} as HAS_ONGOING_LOAN_PREV,
  {_yes("IS_COMPLETED = 'NO'")} as HAS_ONGOING_LOAN_PREV_FIXED,
  {_yes("HAD_DPD = 'YES'")} as HAD_DPD_PREV,
  {_yes("VERSION_CHANGED = 'YES'")} as VERSION_CHANGED_PREV,
  {_yes("EXCEEDED_LIMIT = 'YES'")} as LIMIT_EXCEEDED_PREV,
  {_yes("UNDERPAID = 'YES'")} as UNDERPAID_PREV,
  {_yes("INSTALLMENT_COUNT > CNT_PAYMENT")} as INSTALLMENTS_OVER_CNT_PAYMENT_PREV,
  avg(NAME_YIELD_GROUP) as AVERAGE_YIELD_GROUP_PREV, avg(LOAN_LENGTH) as AVERAGE_LOAN_LENGTH_PREV,
  avg(CNT_PAYMENT) as AVERAGE_CNT_PAYMENT_PREV, max(LAST_SNAPSHOT) as LAST_SNAPSHOT_MAX_PREV,
  avg(LAST_SNAPSHOT) as LAST_SNAPSHOT_MEAN_PREV, avg(DAYS_DECISION) as DAYS_DECISION_MEAN_PREV,
  max(DAYS_DECISION) as DAYS_DECISION_MAX_PREV, avg(INSTALLMENT_COUNT) as INSTALLMENT_COUNT_MEAN_PREV,
  avg(AMT_CREDIT) as AVERAGE_AMT_CREDIT_PREV, avg(RATE_DOWN_PAYMENT) as AVERAGE_RATE_DOWN_PAYMENT_PREV
 from cleaned group by SK_ID_CURR)"""

TABLES = ("prev_apps", "installments", "pos_cash", "credit_card")


def loans_sql(*tail: str, where: str = LAST_ONLY) -> str:
    return ",\n".join([POS, INST, CARD, JOINED.replace("{where}", where), *tail])


def prev_sql(query: str) -> str:
    return with_views(f"with {loans_sql(CLEAN, CLIENT, HIST)}\n{query}", *TABLES)


SQL = {
    "late_payer_default_rate": with_views(f"""with {INST},
per_client as (
 select SK_ID_CURR, {_yes("HAD_DPD = 'YES'")} as HAD_DPD_PREV, {_yes("VERSION_CHANGED = 'YES'")} as VERSION_CHANGED_PREV,
  {_yes("UNDERPAID = 'YES'")} as UNDERPAID_PREV
 from prev_apps a left join inst_loans i on i.SK_ID_PREV = a.SK_ID_PREV
 where FLAG_LAST_APPL_PER_CONTRACT = 'Y' group by SK_ID_CURR),
m as (select c.TARGET, p.HAD_DPD_PREV, p.VERSION_CHANGED_PREV, p.UNDERPAID_PREV from clients c left join per_client p on p.SK_ID_CURR = c.SK_ID_CURR)
select 'HAD_DPD_PREV' as "column", HAD_DPD_PREV as value, count(*) as n, round(avg(TARGET) + 1e-10, 6) as target_rate from m group by 2
union all select 'VERSION_CHANGED_PREV', VERSION_CHANGED_PREV, count(*), round(avg(TARGET) + 1e-10, 6) from m group by 2
union all select 'UNDERPAID_PREV', UNDERPAID_PREV, count(*), round(avg(TARGET) + 1e-10, 6) from m group by 2
""", "clients", "prev_apps", "installments"),
    "pos_loan_features": with_views(f"""with {POS}
select SK_ID_PREV, {rsql(LOAN_LENGTH="LOAN_LENGTH", AVERAGE_SNAPSHOT="AVERAGE_SNAPSHOT")},
 IS_COMPLETED, LAST_SNAPSHOT, INSTALLMENT_CHANGED, HAD_DPD from pos_loans""", "pos_cash"),
    "installment_loan_features": with_views(f"""with {INST}
select SK_ID_PREV, VERSION_CHANGED, {rsql(AVERAGE_INSTALLMENT="AVERAGE_INSTALLMENT")}, HAD_DPD, UNDERPAID, INSTALLMENT_COUNT
from inst_loans""", "installments"),
    "card_loan_features": with_views(f"""with {CARD}
select SK_ID_PREV, IS_COMPLETED, LAST_SNAPSHOT, {rsql(AVERAGE_SNAPSHOT="AVERAGE_SNAPSHOT", AVG_DRAWINGS="AVG_DRAWINGS")},
 HAD_DPD, EXCEEDED_LIMIT, UNDERPAID from card_loans""", "credit_card"),
    "loan_feature_coalesce": with_views(f"""with {loans_sql(where="")}
select SK_ID_PREV, SK_ID_CURR, UNDERPAID, IS_COMPLETED, LAST_SNAPSHOT,
 {rsql(AVERAGE_SNAPSHOT="AVERAGE_SNAPSHOT", LOAN_LENGTH="LOAN_LENGTH")}, HAD_DPD, VERSION_CHANGED, EXCEEDED_LIMIT,
 INSTALLMENT_CHANGED, INSTALLMENT_COUNT from joined""", *TABLES),
    "sentinel_to_null": with_views("""select SK_ID_PREV, nullif(NAME_CONTRACT_TYPE, 'XNA') as NAME_CONTRACT_TYPE,
 nullif(NAME_PRODUCT_TYPE, 'XNA') as NAME_PRODUCT_TYPE, nullif(NAME_YIELD_GROUP, 'XNA') as NAME_YIELD_GROUP,
 nullif(SELLERPLACE_AREA, -1) as SELLERPLACE_AREA,
 case when AMT_DOWN_PAYMENT >= 0 then AMT_DOWN_PAYMENT end as AMT_DOWN_PAYMENT,
 case when AMT_DOWN_PAYMENT < 0 then null else RATE_DOWN_PAYMENT end as RATE_DOWN_PAYMENT,
 nullif(DAYS_TERMINATION, 365243) as DAYS_TERMINATION
from prev_apps where FLAG_LAST_APPL_PER_CONTRACT = 'Y'""", "prev_apps"),
    "yield_recode": with_views("""select SK_ID_PREV, coalesce(nullif(NAME_CONTRACT_TYPE, 'XNA'), 'UNKNOWN') as NAME_CONTRACT_TYPE,
 case NAME_YIELD_GROUP when 'low_action' then 1e0 when 'low_normal' then 2e0 when 'middle' then 3e0 when 'high' then 4e0 end as NAME_YIELD_GROUP
from prev_apps""", "prev_apps"),
    "amount_fill": with_views(f"""with d as (
 select *, coalesce(AMT_CREDIT, 0e0) as credit, RATE_DOWN_PAYMENT is null or AMT_DOWN_PAYMENT < 0 as norate from prev_apps)
select SK_ID_PREV, {rsql(
        AMT_ANNUITY="coalesce(AMT_ANNUITY, 0)", AMT_CREDIT="credit",
        AMT_DOWN_PAYMENT="case when norate and (credit = 0 or NAME_CONTRACT_STATUS <> 'Approved') then 0e0 "
                         "when AMT_DOWN_PAYMENT < 0 then null else AMT_DOWN_PAYMENT end",
        RATE_DOWN_PAYMENT="case when norate then case when credit = 0 or NAME_CONTRACT_STATUS <> 'Approved' then 0e0 end "
                          "else RATE_DOWN_PAYMENT end")}
from d""", "prev_apps"),
    "unapproved_fill": prev_sql(f"""select SK_ID_PREV, IS_COMPLETED, INSTALLMENT_COUNT,
 {rsql(CNT_PAYMENT="CNT_PAYMENT", LOAN_LENGTH="LOAN_LENGTH")} from cleaned"""),
    "client_prev_flags": prev_sql(f"select SK_ID_CURR, APPLICATION_COUNT_PREV, {', '.join(FLAGS)} from client_prev"),
    "client_prev_numeric": prev_sql(f"""select SK_ID_CURR, LAST_SNAPSHOT_MAX_PREV, DAYS_DECISION_MAX_PREV,
 {rsql(**{c: c for c in NUMBERS if c not in ("LAST_SNAPSHOT_MAX_PREV", "DAYS_DECISION_MAX_PREV")})} from client_prev"""),
    "client_monthly_fallback": prev_sql(f"""select SK_ID_CURR, DPD_COUNT,
 {rsql(**{c: c for c in HISTORY if c != "DPD_COUNT"})} from history"""),
    "sign_flip": prev_sql(f"""select p.SK_ID_CURR, -DAYS_DECISION_MAX_PREV as DAYS_DECISION_MAX_PREV,
 -LAST_SNAPSHOT_MAX_PREV as LAST_SNAPSHOT_MAX_PREV, {rsql(DAYS_DECISION_MEAN_PREV="-DAYS_DECISION_MEAN_PREV",
        LAST_SNAPSHOT_MEAN_PREV="-LAST_SNAPSHOT_MEAN_PREV", AVG_MONTHS_BALANCE="-AVG_MONTHS_BALANCE")}
from client_prev p join history h on h.SK_ID_CURR = p.SK_ID_CURR"""),
    "key_coverage": with_views("""select 'installments' as history, count(*) as keys,
 count(*) filter (where SK_ID_PREV in (select SK_ID_PREV from installments)) as shared from (select distinct SK_ID_PREV from prev_apps)
union all select 'pos_cash', count(*), count(*) filter (where SK_ID_PREV in (select SK_ID_PREV from pos_cash))
 from (select distinct SK_ID_PREV from prev_apps)
union all select 'credit_card', count(*), count(*) filter (where SK_ID_PREV in (select SK_ID_PREV from credit_card))
 from (select distinct SK_ID_PREV from prev_apps where NAME_CONTRACT_TYPE = 'Revolving loans')""", *TABLES),
}
