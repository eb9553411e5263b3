"""Queries on model inputs: imputation, scaling, encoding, splits and resampling counts."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.functions.nulls import UNKNOWN
from loanlens.operators import dictionary, preprocess, sampling
from loanlens.operators.preprocess import Blocks
from loanlens.operators.previous import any_eq, loan_installment_features
from loanlens.registry.common import Lending, rounded, rsql
from loanlens.sources.tables import read_csv_checked, scratch_folder
from loanlens.sources.views import table, with_views

EXT = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
SCALED = ["DAYS_BIRTH", "AMT_ANNUITY", "EXT_SOURCE_1"]
LOGGED = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY"]
ENCODED = ["OCCUPATION_TYPE", "NAME_INCOME_TYPE"]
LEARNED = ["CODE_GENDER", "OCCUPATION_TYPE"]


def _treated(spark: SparkSession, sf_dir: str, **blocks: list[str]) -> DataFrame:
    """Client ids with the treated columns, under their original names."""
    clients = Lending(spark, sf_dir).clients
    fitted = preprocess.fit_preprocessor(clients, Blocks(order=list(blocks), **blocks), keep_columns=True)
    out = fitted.transform(clients)
    return rounded(out.select("SK_ID_CURR", *[F.col(f"{b}__{c}").alias(c) for b, cs in blocks.items() for c in cs]))


def mean_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _treated(spark, sf_dir, mean=EXT)


def mode_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preprocess.mode_impute(Lending(spark, sf_dir).clients, ["OCCUPATION_TYPE", "CNT_CHILDREN"])
    return out.select("SK_ID_CURR", "OCCUPATION_TYPE", "CNT_CHILDREN")


def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _treated(spark, sf_dir, std=SCALED)


def log_robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _treated(spark, sf_dir, log_robust=LOGGED)


def log_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _treated(spark, sf_dir, log=LOGGED)


def ordinal_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _treated(spark, sf_dir, weekday_ord=["WEEKDAY_APPR_PROCESS_START"], edu_ord=["NAME_EDUCATION_TYPE"])


def ordinal_learned_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _treated(spark, sf_dir, ordinal_mean=LEARNED)


def one_hot_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category slot that is set for each client and column."""
    clients = Lending(spark, sf_dir).clients
    out = preprocess.fit_preprocessor(clients, Blocks(order=["one_hot"], one_hot=ENCODED)).transform(clients)
    names = F.array(*[F.lit(n) for n in preprocess.feature_names(out)])
    slots = out.select("SK_ID_CURR", F.posexplode(vector_to_array("features")).alias("slot", "value"))
    return slots.filter("value = 1").select("SK_ID_CURR", F.get(names, "slot").alias("feature"))


def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole baseline block layout, one row per client and non-zero feature."""
    clients = Lending(spark, sf_dir).clients
    blocks = preprocess.baseline_blocks(
        log_robust=["AMT_CREDIT"], std=["DAYS_BIRTH"], one_hot=["NAME_INCOME_TYPE"], ext_sources=["EXT_SOURCE_2"],
        passthrough=["REGION_POPULATION_RELATIVE"])
    out = preprocess.fit_preprocessor(clients, blocks).transform(clients)
    names = F.array(*[F.lit(n) for n in preprocess.feature_names(out)])
    slots = out.select("SK_ID_CURR", F.posexplode(vector_to_array("features")).alias("slot", "value"))
    return rounded(slots.filter("value <> 0").select("SK_ID_CURR", "slot", F.get(names, "slot").alias("feature"), "value"))


def encode_for_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Lending(spark, sf_dir)
    flags = t.prev_apps.join(loan_installment_features(t.installments), "SK_ID_PREV", "left").groupBy("SK_ID_CURR").agg(
        any_eq("HAD_DPD", "YES").alias("HAD_DPD_PREV"))
    frame = t.clients.select(
        "SK_ID_CURR", "AMT_ANNUITY", "EXT_SOURCE_1", "CODE_GENDER", "NAME_EDUCATION_TYPE", "WEEKDAY_APPR_PROCESS_START",
        "NAME_CONTRACT_TYPE", "OCCUPATION_TYPE").join(flags, "SK_ID_CURR", "left")
    out = preprocess.encode_for_correlation(frame, ["NAME_CONTRACT_TYPE", "OCCUPATION_TYPE"], ids=["SK_ID_CURR"])
    return rounded(out.select(*[F.col(f"`{c}`").alias(c.replace(" ", "_")) for c in out.columns]))


CODED = ["c_name", "c_mktsegment"]


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column with a category per row, one with five, where a tenth is missing."""
    segment = F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).alias("c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", segment)


def dictionary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of a column in which every row has its own category, numbered and joined without sending the dictionary."""
    rows = _customers(spark, sf_dir)
    return dictionary.encode(rows, dictionary.build_dictionary(rows, CODED), CODED, ["c_custkey"], broadcast_rows=0)


def dictionary_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-hot slots set for each row, and their names; a missing category is one of its own."""
    rows = _customers(spark, sf_dir)
    listed = dictionary.build_dictionary(rows, CODED, missing=UNKNOWN)
    long = dictionary.one_hot(rows, listed, CODED, ["c_custkey"], missing=UNKNOWN).select("c_custkey", F.explode("slots").alias("slot"))
    names = dictionary.with_slots(listed, CODED).select("slot", F.concat("column", F.lit("_"), "value").alias("feature"))
    return long.join(names, "slot")


def csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as delimited text, with cells spoilt by a rule, and read back: cells rejected by column and reason, and cells read."""
    key = F.col("c_custkey")
    spoilt = table(spark, sf_dir, "customer").select(
        F.when(key % 17 == 3, F.concat(F.lit("no. "), key.cast("string"))).otherwise(key.cast("string")).alias("c_custkey"),
        F.when(key % 13 == 5, F.concat("c_nationkey", F.lit(".5"))).when(key % 13 == 6, F.lit("NA")).otherwise(F.col("c_nationkey").cast("string")).alias("c_nationkey"),
        F.when(key % 11 == 4, F.lit("-")).otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"),
        F.when(key % 7 == 1, F.lit("70000")).otherwise(F.lit("7")).alias("small"), "c_mktsegment")
    path = f"{scratch_folder(spark)}/customers"
    spoilt.write.option("header", True).csv(path)
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_nationkey", T.IntegerType()), T.StructField("c_acctbal", T.DoubleType()),
                           T.StructField("small", T.ShortType()), T.StructField("c_mktsegment", T.StringType())])
    read = read_csv_checked(spark, path, schema, most_rejected=0.2)
    counts = read.rejects.groupBy("column", "reason").agg(F.count(F.lit(1)).alias("n"))
    cells = read.rows.agg(*[F.count(f.name).alias(f.name) for f in schema.fields])
    present = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit("read").alias("reason"), F.col(f.name).alias("n")) for f in schema.fields])
    return counts.unionByName(cells.select(F.explode(present).alias("x")).select("x.*"))


NARROWED = ["DAYS_BIRTH", "AMT_CREDIT", "CNT_CHILDREN", "EXT_SOURCE_1", "OCCUPATION_TYPE", "CODE_GENDER"]


def categorical_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = Lending(spark, sf_dir).clients.select("SK_ID_CURR", "TARGET", *NARROWED)
    out = preprocess.categorical_dataset(clients, ["TARGET"])
    return rounded(out.select(F.col("SK_ID_CURR").cast("long"), F.col("DAYS_BIRTH").cast("long"), *[
        F.col(c).cast("double") for c in ("AMT_CREDIT", "CNT_CHILDREN", "EXT_SOURCE_1")], "OCCUPATION_TYPE", "CODE_GENDER"), 3)


PLANNED = {"pos_cash": ["SK_ID_PREV", "MONTHS_BALANCE", "SK_DPD", "CNT_INSTALMENT"], "installments": ["AMT_INSTALMENT"]}


def narrow_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type each numeric column of the balance table can be stored in."""
    return preprocess.narrow_plan(Lending(spark, sf_dir).pos_cash.select(*PLANNED["pos_cash"]))


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = Lending(spark, sf_dir).clients.select("SK_ID_CURR", "TARGET")
    out = sampling.balanced_weights(clients, "TARGET")
    return rounded(out.groupBy("TARGET").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total_weight")))


def stratified_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = Lending(spark, sf_dir).clients.select("SK_ID_CURR", "TARGET")
    marked = sampling.mark_train(clients, "TARGET", ["SK_ID_CURR"], 0.2, seed=0)
    return marked.groupBy("TARGET", F.col("taken").cast("int").alias("train")).agg(F.count(F.lit(1)).alias("n"))


def fold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = Lending(spark, sf_dir).clients.select("SK_ID_CURR", "TARGET")
    return sampling.stratified_folds(clients, "TARGET", ["SK_ID_CURR"], 3).groupBy("TARGET", "fold").agg(
        F.count(F.lit(1)).alias("n"))


def undersample_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = Lending(spark, sf_dir).clients.select("SK_ID_CURR", "TARGET")
    return sampling.undersample(clients, "TARGET", ["SK_ID_CURR"], ratio=0.5).groupBy("TARGET").agg(
        F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    mean_impute, mode_impute, standard_scale, log_robust_scale, log_impute, ordinal_fixed, ordinal_learned_impute,
    one_hot_levels, feature_vector, dictionary_codes, dictionary_slots, csv_rejects, encode_for_correlation, categorical_dataset, narrow_types, class_weights,
    stratified_split_counts, fold_counts, undersample_counts)}


# ---- the same results in SQL ----

WEEKDAYS = "['MONDAY', 'TUESDAY', 'WEDNESDAY', 'THURSDAY', 'FRIDAY', 'SATURDAY', 'SUNDAY']"
EDUCATION = "['Lower secondary', 'Secondary / secondary special', 'Incomplete higher', 'Higher education', 'Academic degree']"


def _filled(columns: list[str]) -> str:
    parts = ", ".join(f"coalesce({c}, (select avg({c}) from clients)) as {c}" for c in columns)
    return f"filled as (select SK_ID_CURR, {parts} from clients)"


CODES = """codes as (select c.SK_ID_CURR, case when c.{0} is not null then d.k end as {0}
 from clients c left join (select {0}, row_number() over (order by {0}) - 1 as k from (select distinct {0} from clients where {0} is not null)) d on d.{0} = c.{0})"""


def _codes(c: str, name: str) -> str:
    return CODES.format(c).replace("codes as", f"{name} as", 1)


def _type_sql(c: str, kind: str) -> str:
    if kind == "double":
        to = f"case when max(abs({c} - cast(cast({c} as float) as double))) <= 5e-4 then 'float' else 'double' end"
    else:
        to = (f"case when min({c}) >= -128 and max({c}) <= 127 then 'tinyint' when min({c}) >= -32768 and max({c}) <= 32767 then 'smallint' "
              f"when min({c}) >= -2147483648 and max({c}) <= 2147483647 then 'int' else 'bigint' end")
    return f"""select '{c}' as "column", '{kind}' as from_type, {to} as to_type from pos_cash"""


SQL = {
    "mean_impute": with_views(f"with {_filled(EXT)}\nselect SK_ID_CURR, {rsql(**{c: c for c in EXT})} from filled", "clients"),
    "mode_impute": with_views("""select SK_ID_CURR,
 coalesce(OCCUPATION_TYPE, (select OCCUPATION_TYPE from clients where OCCUPATION_TYPE is not null group by 1 order by count(*) desc, 1 limit 1)) as OCCUPATION_TYPE,
 coalesce(CNT_CHILDREN, (select CNT_CHILDREN from clients where CNT_CHILDREN is not null group by 1 order by count(*) desc, 1 limit 1)) as CNT_CHILDREN
from clients""", "clients"),
    "standard_scale": with_views(f"with {_filled(SCALED)}\nselect SK_ID_CURR, " + rsql(**{
        c: f"({c} - (select avg({c}) from filled)) / (select stddev_pop({c}) from filled)" for c in SCALED}) + " from filled", "clients"),
    "log_robust_scale": with_views(f"with {_filled(LOGGED)},\nlogged as (select SK_ID_CURR, {', '.join(f'ln(1 + {c}) as {c}' for c in LOGGED)} from filled)\nselect SK_ID_CURR, " + rsql(**{
        c: f"({c} - (select median({c}) from logged)) / (select quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) from logged)" for c in LOGGED}) + " from logged", "clients"),
    "log_impute": with_views(f"with {_filled(LOGGED)}\nselect SK_ID_CURR, {rsql(**{c: f'ln(1 + {c})' for c in LOGGED})} from filled", "clients"),
    "ordinal_fixed": with_views(f"""select SK_ID_CURR, list_position({WEEKDAYS}, WEEKDAY_APPR_PROCESS_START) - 1e0 as WEEKDAY_APPR_PROCESS_START,
 list_position({EDUCATION}, NAME_EDUCATION_TYPE) - 1e0 as NAME_EDUCATION_TYPE from clients""", "clients"),
    "ordinal_learned_impute": with_views(f"with {_codes('CODE_GENDER', 'a')},\n{_codes('OCCUPATION_TYPE', 'b')}\n" + "select a.SK_ID_CURR, " + rsql(
        CODE_GENDER="coalesce(a.CODE_GENDER, (select avg(CODE_GENDER) from a))",
        OCCUPATION_TYPE="coalesce(b.OCCUPATION_TYPE, (select avg(OCCUPATION_TYPE) from b))") + " from a join b on a.SK_ID_CURR = b.SK_ID_CURR", "clients"),
    "one_hot_levels": with_views("\nunion all ".join(
        f"select SK_ID_CURR, '{c}_' || coalesce({c}, 'UNKNOWN') as feature from clients" for c in ENCODED), "clients"),
    "feature_vector": with_views(f"""with {_codes('CODE_GENDER', 'g')}, {_codes('NAME_CONTRACT_TYPE', 't')},
levels as (select coalesce(NAME_INCOME_TYPE, 'UNKNOWN') as v, row_number() over (order by coalesce(NAME_INCOME_TYPE, 'UNKNOWN')) - 1 as k
 from (select distinct NAME_INCOME_TYPE from clients)),
s as (select avg(DAYS_BIRTH) as m, stddev_pop(DAYS_BIRTH) as sd, median(ln(1 + AMT_CREDIT)) as q2,
 quantile_cont(ln(1 + AMT_CREDIT), 0.75) - quantile_cont(ln(1 + AMT_CREDIT), 0.25) as iqr, avg(EXT_SOURCE_2) as e, (select count(*) from levels) as w from clients),
f as (
 select SK_ID_CURR, 0 as slot, 'DAYS_BIRTH' as feature, (DAYS_BIRTH - m) / sd as value from clients, s
 union all select SK_ID_CURR, 1, 'AMT_CREDIT', (ln(1 + AMT_CREDIT) - q2) / iqr from clients, s
 union all select SK_ID_CURR, 2 + k, 'NAME_INCOME_TYPE_' || v, 1 from clients join levels on v = coalesce(NAME_INCOME_TYPE, 'UNKNOWN')
 union all select SK_ID_CURR, 2 + w, 'WEEKDAY_APPR_PROCESS_START', list_position({WEEKDAYS}, WEEKDAY_APPR_PROCESS_START) - 1 from clients, s
 union all select SK_ID_CURR, 3 + w, 'NAME_EDUCATION_TYPE', list_position({EDUCATION}, NAME_EDUCATION_TYPE) - 1 from clients, s
 union all select SK_ID_CURR, 4 + w, 'CODE_GENDER', CODE_GENDER from g, s
 union all select SK_ID_CURR, 5 + w, 'NAME_CONTRACT_TYPE', NAME_CONTRACT_TYPE from t, s
 union all select SK_ID_CURR, 6 + w, 'EXT_SOURCE_2', coalesce(EXT_SOURCE_2, e) from clients, s
 union all select SK_ID_CURR, 7 + w, 'REGION_POPULATION_RELATIVE', REGION_POPULATION_RELATIVE from clients, s)
select SK_ID_CURR, cast(slot as int) as slot, feature, round(value + 1e-10, 6) + 0e0 as value from f where value <> 0""", "clients"),
    "dictionary_codes": """with c as (select c_custkey, c_name, case when c_custkey % 10 <> 0 then c_mktsegment end as c_mktsegment from customer)
select *, dense_rank() over (order by c_name) - 1 as c_name_code,
 case when c_mktsegment is not null then dense_rank() over (order by c_mktsegment nulls last) - 1 end as c_mktsegment_code from c""",
    "dictionary_slots": """with c as (select c_custkey, c_name, case when c_custkey % 10 <> 0 then c_mktsegment else 'UNKNOWN' end as c_mktsegment from customer)
select c_custkey, dense_rank() over (order by c_name) - 1 as slot, 'c_name_' || c_name as feature from c
union all select c_custkey, (select count(distinct c_name) from c) + dense_rank() over (order by c_mktsegment) - 1, 'c_mktsegment_' || c_mktsegment from c""",
    "csv_rejects": """with c as (select *, c_custkey % 17 = 3 as k, c_custkey % 13 = 5 as f, c_custkey % 13 = 6 as m, c_custkey % 11 = 4 as b, c_custkey % 7 = 1 as s from customer)
select * from (select 'c_custkey' as "column", 'not a number' as reason, count(*) as n from c where k
union all select 'c_nationkey', 'a fraction in an integer column', count(*) from c where f
union all select 'c_acctbal', 'not a number', count(*) from c where b
union all select 'small', 'out of range', count(*) from c where s) where n > 0
union all select 'c_custkey', 'read', count(*) from c where not k
union all select 'c_nationkey', 'read', count(*) from c where not f and not m
union all select 'c_acctbal', 'read', count(c_acctbal) from c where not b
union all select 'small', 'read', count(*) from c where not s
union all select 'c_mktsegment', 'read', count(c_mktsegment) from c""",
    "encode_for_correlation": with_views(f"""with late as (
 select a.SK_ID_CURR, max(case when DAYS_ENTRY_PAYMENT > DAYS_INSTALMENT then 1e0 else 0e0 end) as flag
 from prev_apps a left join installments i on i.SK_ID_PREV = a.SK_ID_PREV group by 1),
{_filled(["AMT_ANNUITY", "EXT_SOURCE_1"])}, {_codes('CODE_GENDER', 'g')},
h as (select c.SK_ID_CURR, l.flag from clients c left join late l on l.SK_ID_CURR = c.SK_ID_CURR)
select c.SK_ID_CURR, {rsql(
        AMT_ANNUITY="f.AMT_ANNUITY", EXT_SOURCE_1="f.EXT_SOURCE_1", CODE_GENDER="g.CODE_GENDER",
        NAME_EDUCATION_TYPE=f"list_position({EDUCATION}, c.NAME_EDUCATION_TYPE) - 1",
        WEEKDAY_APPR_PROCESS_START=f"list_position({WEEKDAYS}, c.WEEKDAY_APPR_PROCESS_START) - 1",
        HAD_DPD_PREV="coalesce(h.flag, (select avg(flag) from h))")},
 {", ".join(f"case when {c} = '{v}' then 1 else 0 end as {c}_{v.replace(' ', '_')}" for c, v in (
            ("NAME_CONTRACT_TYPE", "Cash loans"), ("NAME_CONTRACT_TYPE", "Revolving loans"), ("OCCUPATION_TYPE", "Drivers"),
            ("OCCUPATION_TYPE", "IT staff"), ("OCCUPATION_TYPE", "Laborers"), ("OCCUPATION_TYPE", "Unemployed")))}
from clients c join filled f on f.SK_ID_CURR = c.SK_ID_CURR join g on g.SK_ID_CURR = c.SK_ID_CURR join h on h.SK_ID_CURR = c.SK_ID_CURR""",
                                         "clients", "prev_apps", "installments"),
    "categorical_dataset": with_views("""select SK_ID_CURR, cast(DAYS_BIRTH as bigint) as DAYS_BIRTH, AMT_CREDIT, CNT_CHILDREN,
 round(EXT_SOURCE_1, 3) as EXT_SOURCE_1, coalesce(OCCUPATION_TYPE, 'UNKNOWN') as OCCUPATION_TYPE, coalesce(CODE_GENDER, 'UNKNOWN') as CODE_GENDER
from clients""", "clients"),
    "narrow_types": with_views("\nunion all ".join(_type_sql(c, k) for c, k in zip(
        PLANNED["pos_cash"], ("bigint", "int", "int", "double"))), "pos_cash"),
    "class_weights": with_views("""select TARGET, count(*) as n, round((select count(*) from clients) / 2e0 + 1e-10, 6) as total_weight from clients group by 1""", "clients"),
    "stratified_split_counts": with_views("""with c as (select TARGET, count(*) as n from clients group by 1),
q as (select TARGET, n, n * k / cast(t as double) as exact, k, floor(n * k / cast(t as double)) as low
 from c, (select sum(n) as t, sum(n) - ceil(0.2e0 * sum(n)) as k from c)),
r as (select *, row_number() over (order by exact - low desc, TARGET) as place, k - sum(low) over () as spare from q),
f as (select TARGET, n, low + case when place <= spare then 1 else 0 end as train from r)
select TARGET, 1 as train, cast(train as bigint) as n from f union all select TARGET, 0, cast(n - train as bigint) from f""", "clients"),
    "fold_counts": with_views("""select TARGET, cast(place % 3 as int) as fold, count(*) as n
from (select TARGET, row_number() over (order by TARGET) - 1 as place from clients) group by 1, 2""", "clients"),
    "undersample_counts": with_views("""with c as (select TARGET, count(*) as n from clients group by 1)
select TARGET, case when n = (select max(n) from c) then cast(floor((select min(n) from c) / 0.5e0) as bigint) else n end as n from c""", "clients"),
}
