"""Queries on scoring requests: contract checks and batch scores.

The requests hold all contract fields, derived from the customer table by rule; some rows break the
contract with missing cells, unlisted texts or fractions where integers are due.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.operators import preprocess, scoring
from loanlens.operators.scoring import CONTRACT, ZERO_IMPORTANCE
from loanlens.plans import modelling as plan
from loanlens.registry.common import Lending
from loanlens.sources.tables import spread, stage
from loanlens.sources.views import table


def _field(i: int, name: str, rule: str | list[str]) -> str:
    missing = f"case when c_custkey % 997 = {i} then null"
    if isinstance(rule, list):
        cases = " ".join(f"when {k} then '{v}'" for k, v in enumerate(rule))
        return f"{missing} when c_custkey % 499 = {i} then 'BAD' else case (c_custkey + {i}) % {len(rule)} {cases} end end as {name}"
    if rule == "int":
        return f"{missing} when c_custkey % 499 = {i} then 5e-1 else cast((c_custkey * {i + 3}) % 11 as double) end as {name}"
    return f"{missing} else ((c_custkey * {2 * i + 7}) % 1000) / 1e2 end as {name}"


REQUESTS = "select c_custkey as SK_ID_CURR,\n " + ",\n ".join(
    _field(i, n, r) for i, (n, r) in enumerate(CONTRACT.items())) + "\nfrom {customer}"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REQUESTS, customer=spread(table(spark, sf_dir, "customer"), "c_custkey"))


def score_contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = scoring.check_requests(requests(spark, sf_dir))
    return checked.select("SK_ID_CURR", F.size("violations").alias("n"), F.concat_ws("; ", "violations").alias("violations"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = scoring.split_requests(stage(requests(spark, sf_dir)))  # the checks read each field several times
    return stage(good.withColumn("label", (F.col("EXT_SOURCE_2") + F.col("EXT_SOURCE_3") < 8.0).cast("int")))


def tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of default from boosted trees that do without the unused fields, of as many rounds as held-out rows ask for."""
    df = _labelled(spark, sf_dir)
    columns = [c for c in CONTRACT if c not in ZERO_IMPORTANCE]
    model = plan.tree_scorer(df, "label", ["SK_ID_CURR"], columns)
    return scoring.score(df, model, ["SK_ID_CURR"], drop=ZERO_IMPORTANCE)


def linear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of default from the linear model and its preprocessing."""
    df = _labelled(spark, sf_dir)
    numbers = [c for c, r in CONTRACT.items() if r == "float"]
    texts = [c for c, r in CONTRACT.items() if isinstance(r, list)]
    flags = [c for c in texts if CONTRACT[c] in (["NO", "YES"], ["YES", "NO"])]
    fixed = list(preprocess.FIXED_ORDERS)
    blocks = preprocess.updated_blocks(
        log_robust=numbers[:10], std=numbers[10:], log=[], one_hot=[c for c in texts if c not in flags and c not in fixed],
        ordinal=flags, ext_sources=[], passthrough=[c for c, r in CONTRACT.items() if r == "int"])
    model = plan.linear_scorer(df, "label", ["SK_ID_CURR"], blocks, max_iter=50)
    return scoring.score(df, model, ["SK_ID_CURR"])


QUERIES = {f.__name__: f for f in (score_contract_violations, tree_scores, linear_scores)}


def _problem_sql(name: str, rule: str | list[str]) -> str:
    if isinstance(rule, list):
        allowed = ", ".join(f"'{v}'" for v in rule)
        return f"case when {name} is null then '{name}: missing' when {name} not in ({allowed}) then '{name}: not allowed' end"
    if rule == "int":
        return f"case when {name} is null then '{name}: missing' when {name} <> floor({name}) then '{name}: not an integer' end"
    return f"case when {name} is null then '{name}: missing' end"


_PROBLEMS = [_problem_sql(n, r) for n, r in CONTRACT.items()]

SQL = {
    "score_contract_violations": "with requests as (" + REQUESTS.format(customer="customer") + ")\nselect SK_ID_CURR, cast("
    + " + ".join(f"case when {p} is null then 0 else 1 end" for p in _PROBLEMS)
    + " as int) as n, concat_ws('; ', " + ", ".join(_PROBLEMS) + ") as violations from requests",
}
