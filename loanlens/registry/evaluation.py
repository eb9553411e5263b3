"""Queries on prediction quality and attribution, with a score that has many ties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.operators import attribution, evaluation, models
from loanlens.registry.common import Lending, rounded, rsql
from loanlens.sources.views import with_views


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = Lending(spark, sf_dir).clients
    return clients.select("SK_ID_CURR", F.col("TARGET").alias("label"), F.coalesce("EXT_SOURCE_2", F.lit(0.5)).alias("score"))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion_matrix(_scored(spark, sf_dir), "label", "score")


def threshold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.threshold_scores(_scored(spark, sf_dir), "label", "score"))


def roc_auc_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.roc_auc(_scored(spark, sf_dir), "label", "score"))


SCORES = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]


def score_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean area over three folds of each external score as a model of its own, best first; a missing score counts as 0.5."""
    clients = Lending(spark, sf_dir).clients
    cells = F.array(*[F.struct(F.lit(c).alias("model"), F.coalesce(c, F.lit(0.5)).alias("score")) for c in SCORES])
    long = clients.select((F.col("SK_ID_CURR") % 3).alias("fold"), F.col("TARGET").alias("label"), F.explode(cells).alias("x"))
    long = long.select(F.struct("x.model", "fold").alias("part"), "label", "x.score")
    areas = evaluation.roc_auc_by(long, "part", "label", "score").select("part.model", "part.fold", "roc_auc")
    return rounded(models.mean_scores(areas))


def roc_curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve from its starting point on, whose threshold is infinite."""
    return rounded(evaluation.roc_curve(_scored(spark, sf_dir), "label", "score"))


WEIGHTS = {"AMT_CREDIT": 2e-6, "DAYS_BIRTH": -1e-4, "REGION_POPULATION_RELATIVE": 3.0}


def linear_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = Lending(spark, sf_dir).clients.select("SK_ID_CURR", *WEIGHTS)
    return rounded(attribution.linear_attribution(clients, WEIGHTS, attribution.column_means(clients, list(WEIGHTS))))


def mean_abs_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = Lending(spark, sf_dir).clients.select("SK_ID_CURR", *WEIGHTS)
    phi = attribution.linear_attribution(clients, WEIGHTS, attribution.column_means(clients, list(WEIGHTS)))
    return rounded(attribution.mean_abs(phi, list(WEIGHTS)))


QUERIES = {f.__name__: f for f in (
    score_comparison, confusion_matrix, threshold_scores, roc_auc_exact, roc_curve_points, linear_attribution, mean_abs_attribution)}


# ---- the same results in SQL ----

SCORED = "scored as (select TARGET as label, coalesce(EXT_SOURCE_2, 5e-1) as score, coalesce(EXT_SOURCE_2, 5e-1) > 5e-1 as hit from clients)"
PHI = {c: f"{w!r} * ({c} - (select avg({c}) from clients))" for c, w in WEIGHTS.items()}

SQL = {
    "confusion_matrix": with_views(f"""with {SCORED}
select a.x as actual, p.x as predicted, count(s.label) as n from (values (0), (1)) a(x) cross join (values (0), (1)) p(x)
left join scored s on s.label = a.x and cast(s.hit as int) = p.x group by 1, 2""", "clients"),
    "threshold_scores": with_views(f"""with {SCORED},
c as (select count(*) filter (where label = 1 and hit) as tp, count(*) filter (where label = 0 and hit) as fp,
 count(*) filter (where label = 1 and not hit) as fn, count(*) as n from scored)
select {rsql(accuracy="(n - fp - fn) / cast(n as double)", recall="coalesce(tp / nullif(cast(tp + fn as double), 0), 0)",
             precision="coalesce(tp / nullif(cast(tp + fp as double), 0), 0)", f1="coalesce(2 * tp / nullif(cast(2 * tp + fp + fn as double), 0), 0)")} from c""", "clients"),
    "roc_auc_exact": with_views(f"""with {SCORED}
select round(sum(case when p.score > q.score then 1e0 when p.score = q.score then 5e-1 else 0e0 end * p.n * q.n)
 / (select count(*) filter (where label = 1) * cast(count(*) filter (where label = 0) as double) from scored) + 1e-10, 6) as roc_auc
from (select score, count(*) as n from scored where label = 1 group by 1) p cross join (select score, count(*) as n from scored where label = 0 group by 1) q""", "clients"),
    "roc_curve_points": with_views(f"""with {SCORED},
d as (select score, count(*) filter (where label = 1) as p, count(*) filter (where label = 0) as q from scored group by 1),
c as (select score, sum(p) over w as tp, sum(q) over w as fp, sum(p) over () as np, sum(q) over () as nq, row_number() over w as nth, count(*) over () as points
 from d window w as (order by score desc)),
b as (select *, tp - 2 * lag(tp) over v + lag(tp, 2) over v as bend_tp, fp - 2 * lag(fp) over v + lag(fp, 2) over v as bend_fp from c window v as (order by nth)),
k as (select *, lead(bend_tp) over v <> 0 or lead(bend_fp) over v <> 0 as bends from b window v as (order by nth))
select 0e0 as fpr, 0e0 as tpr, cast('inf' as double) as threshold
union all select {rsql(fpr="fp / cast(nq as double)", tpr="tp / cast(np as double)", threshold="score")} from k
where nth = 1 or nth = points or bends""", "clients"),
    "score_comparison": with_views("with long as (" + "\nunion all ".join(
        f"select '{c}' as model, SK_ID_CURR % 3 as fold, TARGET as label, coalesce({c}, 0.5) as score from clients" for c in SCORES) + """),
r as (select model, fold, label, rank() over (partition by model, fold order by score) + (count(*) over (partition by model, fold, score) - 1) / 2e0 as place from long),
a as (select model, fold, (sum(place) filter (where label = 1) - count(*) filter (where label = 1) * (count(*) filter (where label = 1) + 1) / 2e0)
 / (count(*) filter (where label = 1) * cast(count(*) filter (where label = 0) as double)) as roc_auc from r group by 1, 2)
select model, round(avg(roc_auc) + 1e-10, 6) + 0e0 as roc_auc from a group by 1""", "clients"),
    "linear_attribution": with_views(f"select SK_ID_CURR, {rsql(**PHI)} from clients", "clients"),
    "mean_abs_attribution": with_views("\nunion all ".join(
        f"select '{c}' as feature, round(avg(abs({e})) + 1e-10, 6) as importance from clients" for c, e in PHI.items()), "clients"),
}
