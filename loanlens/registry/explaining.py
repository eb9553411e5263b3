"""Queries that say which columns drive a score, row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.operators import models, trees
from loanlens.registry.common import Lending, rounded
from loanlens.registry.modelling import _split, _tree_columns, labelled
from loanlens.sources.views import with_views

COLUMNS = ["EXT_SOURCE_2", "AMT_CREDIT", "DAYS_BIRTH", "CNT_CHILDREN"]
# A small ensemble: tree, node, column, threshold, low child, high child, value, share of rows below it.
ENSEMBLE = [
    (0, 0, 0, 0.45, 1, 2, None, 100), (0, 1, 1, 400000, 3, 4, None, 45), (0, 2, 0, 0.8, 5, 6, None, 55),
    (0, 3, None, None, -1, -1, 0.8, 20), (0, 4, 2, -15000, 7, 8, None, 25), (0, 5, None, None, -1, -1, -0.2, 35),
    (0, 6, None, None, -1, -1, -0.7, 20), (0, 7, None, None, -1, -1, 0.1, 10), (0, 8, None, None, -1, -1, 0.5, 15),
    (1, 0, 2, -16000, 1, 2, None, 80), (1, 1, 3, 1.5, 3, 4, None, 30), (1, 2, 1, 700000, 5, 6, None, 50),
    (1, 3, None, None, -1, -1, -0.3, 18), (1, 4, None, None, -1, -1, 0.2, 12), (1, 5, 0, 0.3, 7, 8, None, 35),
    (1, 6, None, None, -1, -1, -0.1, 15), (1, 7, None, None, -1, -1, 0.6, 5), (1, 8, None, None, -1, -1, 0.05, 30),
    (2, 0, 3, 0.5, 1, 2, None, 60), (2, 1, None, None, -1, -1, -0.15, 24), (2, 2, None, None, -1, -1, 0.25, 36),
]
WEIGHTS = [1.0, 0.5, 0.25]


def _paths() -> list[trees.Leaf]:
    nodes = [{"tree": t, "node": n, "value": v or 0.0, "cover": float(c), "low_child": lo, "high_child": hi, "slot": -1 if s is None else s,
              "threshold": None if x is None else float(x), "low_categories": None, "categories": -1} for t, n, s, x, lo, hi, v, c in ENSEMBLE]
    return trees.leaf_paths(nodes, WEIGHTS)


def tree_path_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each client's exact share of four columns in the score of a fixed ensemble; a missing cell counts as -1."""
    cells = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in COLUMNS])
    scored = trees.tree_attribution(Lending(spark, sf_dir).clients.select("SK_ID_CURR", cells.alias("features")), _paths())
    names = F.array(*[F.lit(c) for c in COLUMNS])
    long = scored.select("SK_ID_CURR", "base", F.posexplode("attribution").alias("slot", "share"))
    return rounded(long.select("SK_ID_CURR", F.get(names, "slot").alias("feature"), "share", "base"))


def boosting_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean size and mean of every column's share in the raw scores of the validation rows; all columns."""
    df = labelled(spark, sf_dir)
    columns = _tree_columns(df)
    train, validation = _split(df)
    model = models.fit_boosting(train, validation, "label", columns, rounds=20)
    explained = trees.tree_attribution(model.transform(validation), trees.model_paths(model))
    return trees.mean_attribution(explained, columns)


QUERIES = {f.__name__: f for f in (tree_path_attribution, boosting_attribution)}

# From the definition: the ensemble's value for every set of known columns, each tree walked down to its
# leaves, both ways where the column is not known.
_NODES = ", ".join(f"({t}, {n}, {'null' if s is None else s}, {'null' if x is None else x}, {lo}, {hi}, {'null' if v is None else v}, {c})"
                   for t, n, s, x, lo, hi, v, c in ENSEMBLE)
SQL = {
    "tree_path_attribution": "with recursive " + with_views(f"""with nodes(tree, node, slot, threshold, low, high, value, cover) as (values {_NODES}),
weights(tree, weight) as (values {', '.join(f'({t}, {w})' for t, w in enumerate(WEIGHTS))}),
cells as (select SK_ID_CURR, [{', '.join(f'coalesce(cast({c} as double), -1)' for c in COLUMNS)}] as x from clients),
subsets as (select s from range({1 << len(COLUMNS)}) t(s)),
walk(SK_ID_CURR, s, tree, node, share) as (
 select SK_ID_CURR, s, tree, 0, cast(weight as double) from cells, subsets, weights
 union all
 select w.SK_ID_CURR, w.s, w.tree, c.node,
  w.share * case when (w.s >> n.slot) & 1 = 0 then cast(c.cover as double) / n.cover when (x.x[n.slot + 1] <= n.threshold) = (c.node = n.low) then 1 else 0 end
 from walk w join nodes n on n.tree = w.tree and n.node = w.node and n.slot is not null
 join nodes c on c.tree = n.tree and c.node in (n.low, n.high) join cells x on x.SK_ID_CURR = w.SK_ID_CURR),
score as (select SK_ID_CURR, s, sum(w.share * n.value) as v from walk w join nodes n on n.tree = w.tree and n.node = w.node where n.slot is null group by 1, 2),
names(i, feature) as (values {', '.join(f"({i}, '{c}')" for i, c in enumerate(COLUMNS))}),
gains as (select a.SK_ID_CURR, i, feature, b.v - a.v as gain, bit_count(a.s) as k from score a, names join score b on true
 where b.SK_ID_CURR = a.SK_ID_CURR and (a.s >> i) & 1 = 0 and b.s = a.s + (1 << i))
select g.SK_ID_CURR, feature, round(sum(gain * case k when 0 then 1 / 4e0 when 1 then 1 / 12e0 when 2 then 1 / 12e0 else 1 / 4e0 end) + 1e-10, 6) + 0e0 as share,
 round(any_value(z.v) + 1e-10, 6) + 0e0 as base
from gains g join score z on z.SK_ID_CURR = g.SK_ID_CURR and z.s = 0 group by 1, 2""", "clients").removeprefix("with "),
}
