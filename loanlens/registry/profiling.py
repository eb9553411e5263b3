"""Profiling queries on the lending tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.operators import profiling
from loanlens.registry.common import Lending, rounded, rsql
from loanlens.sources.views import with_views

NUMERIC = ["AMT_CREDIT", "AMT_ANNUITY", "AMT_DOWN_PAYMENT", "RATE_DOWN_PAYMENT", "DAYS_DECISION"]
CATEGORIES = ["NAME_INCOME_TYPE", "OCCUPATION_TYPE", "CODE_GENDER", "NAME_EDUCATION_TYPE"]
ANNUITIES = ["DAYS_ENTRY_PAYMENT", "AMT_PAYMENT", "NUM_INSTALMENT_VERSION"]


def missing_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiling.missing_share(Lending(spark, sf_dir).clients))


def missing_share_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiling.missing_share(Lending(spark, sf_dir).clients, over=0.2))


def missing_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.missing_by_row(Lending(spark, sf_dir).bureau)


def missing_by_row_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.missing_by_row(Lending(spark, sf_dir).installments, ANNUITIES)


def missing_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.missing_pattern(Lending(spark, sf_dir).installments, ANNUITIES)


def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.distinct_values(Lending(spark, sf_dir).clients)


def describe_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiling.describe(Lending(spark, sf_dir).prev_apps, NUMERIC))


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiling.category_counts(Lending(spark, sf_dir).clients, CATEGORIES, share=True))


def default_rate_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiling.target_rate(Lending(spark, sf_dir).clients, CATEGORIES, "TARGET"))


def histogram_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiling.histogram(Lending(spark, sf_dir).prev_apps, "DAYS_DECISION", empty=True))


def histogram_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiling.histogram(Lending(spark, sf_dir).clients, "DAYS_BIRTH", bins=20, hue="TARGET", empty=True))


def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Lending(spark, sf_dir)
    return rounded(profiling.box_stats(t.prev_apps, ["AMT_CREDIT", "AMT_ANNUITY"], hue="NAME_CONTRACT_STATUS"))


def group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiling.group_means(Lending(spark, sf_dir).clients, ["AMT_CREDIT", "AMT_ANNUITY", "DAYS_BIRTH"], "TARGET"))


def crosstab_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiling.crosstab_share(Lending(spark, sf_dir).prev_apps, "NAME_YIELD_GROUP", "NAME_CONTRACT_STATUS"))


def crosstab_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the pairs that occur, for a column with hundreds of categories."""
    return rounded(profiling.crosstab_pairs(Lending(spark, sf_dir).prev_apps, "SELLERPLACE_AREA", "NAME_CONTRACT_STATUS"))


def pearson_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiling.pearson_pairs(Lending(spark, sf_dir).bureau, [
        "DAYS_CREDIT", "DAYS_CREDIT_ENDDATE", "DAYS_ENDDATE_FACT", "DAYS_CREDIT_UPDATE"]))


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = Lending(spark, sf_dir).clients
    return clients.select("SK_ID_CURR", "AMT_CREDIT", "DAYS_BIRTH", F.coalesce("CNT_CHILDREN", F.lit(0.0)).alias("CNT_CHILDREN"),
                          F.coalesce("CNT_FAM_MEMBERS", F.lit(0.0)).alias("CNT_FAM_MEMBERS"),
                          (F.col("AMT_CREDIT") * F.col("AMT_CREDIT")).alias("CREDIT_SQUARED"))


RANKED = ["AMT_CREDIT", "DAYS_BIRTH", "CNT_CHILDREN", "CNT_FAM_MEMBERS", "CREDIT_SQUARED"]


def spearman_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiling.spearman_pairs(_filled(spark, sf_dir), RANKED, ["SK_ID_CURR"]))


GAPPED = ["AMT_ANNUITY", "DAYS_EMPLOYED", "CNT_CHILDREN", "CNT_FAM_MEMBERS", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3",
          "AMT_REQ_CREDIT_BUREAU_WEEK", "OBS_30_CNT_SOCIAL_CIRCLE", "DEF_30_CNT_SOCIAL_CIRCLE", "AMT_CREDIT", "DAYS_BIRTH"]


def spearman_gap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlations of columns with gaps, each pair ranked among the clients who have both."""
    return rounded(profiling.spearman_pairs(Lending(spark, sf_dir).clients, GAPPED, ["SK_ID_CURR"]))


def strong_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiling.strong_pairs(profiling.spearman_pairs(_filled(spark, sf_dir), RANKED, ["SK_ID_CURR"]), 0.95))


QUERIES = {f.__name__: f for f in (
    missing_share, missing_share_over, missing_by_row, missing_by_row_subset, missing_pattern, distinct_values,
    describe_numeric, category_counts, default_rate_by_category, histogram_auto, histogram_by_target, box_stats,
    group_means, crosstab_share, crosstab_pairs, pearson_pairs, spearman_pairs, spearman_gap_pairs, strong_pairs)}


# ---- the same results in SQL ----

CLIENT_COLUMNS = [
    "SK_ID_CURR", "TARGET", "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "DAYS_BIRTH", "DAYS_EMPLOYED",
    "REGION_POPULATION_RELATIVE", "CNT_CHILDREN", "CNT_FAM_MEMBERS", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3",
    "AMT_REQ_CREDIT_BUREAU_WEEK", "AMT_REQ_CREDIT_BUREAU_HOUR", "AMT_REQ_CREDIT_BUREAU_DAY",
    "AMT_REQ_CREDIT_BUREAU_MON", "AMT_REQ_CREDIT_BUREAU_QRT", "AMT_REQ_CREDIT_BUREAU_YEAR", "OBS_30_CNT_SOCIAL_CIRCLE",
    "OBS_60_CNT_SOCIAL_CIRCLE", "DEF_30_CNT_SOCIAL_CIRCLE", "DEF_60_CNT_SOCIAL_CIRCLE", "CODE_GENDER",
    "NAME_EDUCATION_TYPE", "WEEKDAY_APPR_PROCESS_START", "NAME_INCOME_TYPE", "NAME_TYPE_SUITE", "NAME_HOUSING_TYPE",
    "NAME_FAMILY_STATUS", "NAME_CONTRACT_TYPE", "OCCUPATION_TYPE", "ORGANIZATION_TYPE",
]
CLIENT_TEXTS = CLIENT_COLUMNS[CLIENT_COLUMNS.index("CODE_GENDER"):]
BUREAU_COLUMNS = [
    "SK_ID_BUREAU", "SK_ID_CURR", "CREDIT_ACTIVE", "CREDIT_TYPE", "DAYS_CREDIT", "DAYS_CREDIT_ENDDATE",
    "DAYS_ENDDATE_FACT", "DAYS_CREDIT_UPDATE", "CREDIT_DAY_OVERDUE", "CNT_CREDIT_PROLONG", "AMT_CREDIT_SUM_DEBT",
    "AMT_CREDIT_SUM_LIMIT", "AMT_CREDIT_SUM_OVERDUE", "AMT_CREDIT_SUM", "AMT_CREDIT_MAX_OVERDUE",
]


def _each(columns: list[str], text: str) -> str:
    return "\nunion all ".join(text.replace("@", c) for c in columns)


def _nulls(columns: list[str]) -> str:
    return " + ".join(f"case when {c} is null then 1 else 0 end" for c in columns)


def _corr_sql(columns: list[str], source: str) -> str:
    return "\nunion all ".join(
        f"""select '{a}' as "left", '{b}' as "right", round(corr({a}, {b}) + 1e-10, 6) + 0e0 as corr from {source}"""
        for a in columns for b in columns)


FILLED = """filled as (select SK_ID_CURR, AMT_CREDIT, DAYS_BIRTH, coalesce(CNT_CHILDREN, 0e0) as CNT_CHILDREN,
 coalesce(CNT_FAM_MEMBERS, 0e0) as CNT_FAM_MEMBERS, AMT_CREDIT * AMT_CREDIT as CREDIT_SQUARED from clients),
ranks as (select """ + ", ".join(
    f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2e0 as {c}" for c in RANKED) + " from filled)"

SQL = {
    "missing_share": with_views(_each(CLIENT_COLUMNS, """select '@' as "column", round(avg(case when @ is null then 1 else 0 end) + 1e-10, 6) as missing from clients"""), "clients"),
    "missing_share_over": with_views("with m as (" + _each(CLIENT_COLUMNS, """select '@' as "column", avg(case when @ is null then 1 else 0 end) as missing from clients""")
                                     + ')\nselect "column", round(missing + 1e-10, 6) as missing from m where missing > 0.2', "clients"),
    "missing_by_row": with_views(f"select cast({_nulls(BUREAU_COLUMNS)} as int) as missing, count(*) as rows from bureau group by 1", "bureau"),
    "missing_by_row_subset": with_views(f"select cast({_nulls(ANNUITIES)} as int) as missing, count(*) as rows from installments group by 1", "installments"),
    "missing_pattern": with_views("select " + ", ".join(f"case when {c} is null then 1 else 0 end as {c}_missing" for c in ANNUITIES)
                                  + f", count(*) as rows, cast({_nulls(ANNUITIES)} as int) as missing from installments group by all", "installments"),
    "distinct_values": with_views(_each(CLIENT_TEXTS, """select distinct '@' as "column", @ as value from clients"""), "clients"),
    "describe_numeric": with_views(_each(NUMERIC, """select '@' as "column", count(@) as count, round(avg(@) + 1e-10, 6) + 0e0 as mean, round(stddev_samp(@) + 1e-10, 6) as std,
 cast(min(@) as double) as min, cast(max(@) as double) as max, round(quantile_cont(cast(@ as double), 0.25) + 1e-10, 6) as q25,
 round(quantile_cont(cast(@ as double), 0.5) + 1e-10, 6) as q50, round(quantile_cont(cast(@ as double), 0.75) + 1e-10, 6) as q75 from prev_apps"""), "prev_apps"),
    "category_counts": with_views(_each(CATEGORIES, """select '@' as "column", @ as value, count(*) as n,
 case when @ is not null then round(count(*) / cast((select count(@) from clients) as double) + 1e-10, 6) end as share from clients group by @"""), "clients"),
    "default_rate_by_category": with_views(_each(CATEGORIES, """select '@' as "column", @ as value, count(*) as n, round(avg(TARGET) + 1e-10, 6) as target_rate from clients group by @"""), "clients"),
    "histogram_auto": with_views("""with s as (select min(x) as lo, max(x) as hi, count(*) as n, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) as iqr
  from (select cast(DAYS_DECISION as double) as x from prev_apps)),
w as (select lo, hi, cast(ceil((hi - lo) / case when iqr > 0 then least(2 * iqr / pow(n, 1e0 / 3), (hi - lo) / (log2(n) + 1))
  else (hi - lo) / (log2(n) + 1) end) as int) as k from s),
b as (select least(cast(floor((DAYS_DECISION - lo) / ((hi - lo) / k)) as int), k - 1) as bin, count(*) as n from prev_apps, w group by 1)
select cast(g.i as bigint) as bin, round(lo + g.i * ((hi - lo) / k) + 1e-10, 6) as left_edge, round(lo + (g.i + 1) * ((hi - lo) / k) + 1e-10, 6) as right_edge,
 coalesce(b.n, 0) as n
from w, unnest(range(k)) as g(i) left join b on b.bin = g.i""", "prev_apps"),
    "histogram_by_target": with_views("""with w as (select cast(min(DAYS_BIRTH) as double) as lo, (max(DAYS_BIRTH) - min(DAYS_BIRTH)) / 20e0 as width from clients),
b as (select TARGET, least(cast(floor((DAYS_BIRTH - lo) / width) as int), 19) as bin, count(*) as n from clients, w group by 1, 2)
select t.TARGET, cast(g.i as bigint) as bin, round(lo + g.i * width + 1e-10, 6) as left_edge, round(lo + (g.i + 1) * width + 1e-10, 6) as right_edge, coalesce(b.n, 0) as n
from w, (select distinct TARGET from clients) t, unnest(range(20)) as g(i) left join b on b.bin = g.i and b.TARGET = t.TARGET""", "clients"),
    "box_stats": with_views("with " + ",\n".join(f"""f_{c} as (select NAME_CONTRACT_STATUS as s, quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.5) as median,
 quantile_cont({c}, 0.75) as q3 from prev_apps group by 1)""" for c in ("AMT_CREDIT", "AMT_ANNUITY")) + "\n" + _each(["AMT_CREDIT", "AMT_ANNUITY"],
 """select s as NAME_CONTRACT_STATUS, '@' as "column", round(q1 + 1e-10, 6) as q1, round(median + 1e-10, 6) as median, round(q3 + 1e-10, 6) as q3,
 round(min(@) filter (where @ >= q1 - 1.5e0 * (q3 - q1)) + 1e-10, 6) as whisker_low, round(max(@) filter (where @ <= q3 + 1.5e0 * (q3 - q1)) + 1e-10, 6) as whisker_high,
 count(@) filter (where @ < q1 - 1.5e0 * (q3 - q1) or @ > q3 + 1.5e0 * (q3 - q1)) as outliers
 from prev_apps join f_@ on s = NAME_CONTRACT_STATUS group by s, q1, median, q3"""), "prev_apps"),
    "group_means": with_views(f"select TARGET, {rsql(AMT_CREDIT='avg(AMT_CREDIT)', AMT_ANNUITY='avg(AMT_ANNUITY)', DAYS_BIRTH='avg(DAYS_BIRTH)')} from clients group by 1", "clients"),
    "crosstab_share": with_views("""select y.NAME_YIELD_GROUP, x.NAME_CONTRACT_STATUS, round(count(p.SK_ID_PREV) / cast(y.n as double) + 1e-10, 6) as share
from (select NAME_YIELD_GROUP, count(*) as n from prev_apps group by 1) y cross join (select distinct NAME_CONTRACT_STATUS from prev_apps) x
left join prev_apps p on p.NAME_YIELD_GROUP = y.NAME_YIELD_GROUP and p.NAME_CONTRACT_STATUS = x.NAME_CONTRACT_STATUS
group by y.NAME_YIELD_GROUP, x.NAME_CONTRACT_STATUS, y.n""", "prev_apps"),
    "crosstab_pairs": with_views("""select SELLERPLACE_AREA, NAME_CONTRACT_STATUS, count(*) as n,
 round(count(*) / cast(sum(count(*)) over (partition by SELLERPLACE_AREA) as double) + 1e-10, 6) + 0e0 as share
from prev_apps where SELLERPLACE_AREA is not null and NAME_CONTRACT_STATUS is not null group by 1, 2""", "prev_apps"),
    "pearson_pairs": with_views(_corr_sql(["DAYS_CREDIT", "DAYS_CREDIT_ENDDATE", "DAYS_ENDDATE_FACT", "DAYS_CREDIT_UPDATE"], "bureau"), "bureau"),
    "spearman_pairs": with_views("with " + FILLED + "\n" + _corr_sql(RANKED, "ranks"), "clients"),
    "spearman_gap_pairs": with_views("with " + ",\n".join(
        f"""p_{i}_{j} as (select rank() over (order by {a}) + (count(*) over (partition by {a}) - 1) / 2e0 as x,
 rank() over (order by {b}) + (count(*) over (partition by {b}) - 1) / 2e0 as y from clients where {a} is not null and {b} is not null)"""
        for i, a in enumerate(GAPPED) for j, b in enumerate(GAPPED) if i <= j) + "\n" + "\nunion all ".join(
        f"""select '{a}' as "left", '{b}' as "right", round(corr(x, y) + 1e-10, 6) + 0e0 as corr from p_{min(i, j)}_{max(i, j)}"""
        for i, a in enumerate(GAPPED) for j, b in enumerate(GAPPED)), "clients"),
    "strong_pairs": with_views("with " + FILLED + ",\npairs as (" + _corr_sql(RANKED, "ranks")
                               + """)\nselect * from pairs where abs(corr) > 0.95 and "left" <> "right" """, "clients"),
}
