"""Profiles of a table: missing cells, categories, distributions, default rates, correlations.

Each profile reads the table once for all requested columns: cells are unpivoted to (column, value)
and combined map-side, so the shuffle carries distinct values, not rows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.functions.nulls import numeric_columns, string_columns
from loanlens.functions.ordering import quantiles, value_ranks
from loanlens.operators.dictionary import counted_up, numbered
from loanlens.sources.tables import stage

# workers run the kernel below without having the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def unpivot(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Wide to long: one (column, value) row per cell, values as text, missing cells kept."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    keep = keep or []
    return df.select(*keep, F.explode(F.array(*cells)).alias("cell")).select(*keep, "cell.*")


def missing_share(df: DataFrame, over: float | None = None) -> DataFrame:
    """Share of missing cells per column; with `over`, only columns above that share."""
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns])
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in df.columns]
    out = wide.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
    out = out if over is None else out.filter(F.col("missing") > over)
    return out.orderBy("missing", "column")


def missing_by_row(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Number of rows for each number of missing cells."""
    cells = reduce(add, [F.col(c).isNull().cast("int") for c in columns or df.columns])
    return df.groupBy(cells.alias("missing")).agg(F.count(F.lit(1)).alias("rows")).orderBy("missing")


def missing_pattern(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of rows for each combination of missing columns, and how many are missing in it."""
    flags = [F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in columns]
    names = [f"{c}_missing" for c in columns]
    out = df.select(*flags).groupBy(*names).agg(F.count(F.lit(1)).alias("rows"))
    return out.withColumn("missing", reduce(add, [F.col(n) for n in names]))


def distinct_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct values of the text columns, a missing value included."""
    return unpivot(df, columns or string_columns(df)).distinct()


def category_counts(df: DataFrame, columns: list[str], share: bool = False) -> DataFrame:
    """Rows per category, optionally with the share of the column's present values."""
    counts = unpivot(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    if not share:
        return counts
    totals = counts.filter(F.col("value").isNotNull()).groupBy("column").agg(F.sum("n").alias("__total"))
    joined = counts.join(totals, "column", "left")
    return joined.select("column", "value", "n", F.when(
        F.col("value").isNotNull(), F.try_divide(F.col("n").cast("double"), F.col("__total"))).alias("share"))


def target_rate(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Mean of the target per category of each column (the default rate for a 0/1 target)."""
    return unpivot(df, columns, [target]).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"), F.avg(target).alias("target_rate"))


def describe(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles per numeric column."""
    columns = columns or numeric_columns(df)
    parts: list[Column] = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        parts += [F.count(x).alias(f"count_{i}"), F.avg(x).alias(f"mean_{i}"), F.stddev_samp(x).alias(f"std_{i}"),
                  F.min(x).alias(f"min_{i}"), F.max(x).alias(f"max_{i}")]
    names = ["count", "mean", "std", "min", "max"]
    cells = [F.struct(F.lit(c).alias("column"), *[F.col(f"{m}_{i}").alias(m) for m in names])
             for i, c in enumerate(columns)]
    moments = df.agg(*parts).select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
    quartiles = quantiles(df, columns, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, exact=exact)
    return moments.join(quartiles, "column", "left")


def histogram(df: DataFrame, column: str, bins: str | int = "auto", hue: str | None = None, empty: bool = False) -> DataFrame:
    """Row counts in equal-width bins; the last bin includes its right edge.

    Bins without rows are returned only with `empty`: one outlier can make any number of them.  `auto` takes the narrower of the Freedman-Diaconis and the Sturges width.  The bin count
    follows from one-row statistics, so the data itself is only counted, never moved.
    """
    x = F.col(column).cast("double")
    present = df.filter(x.isNotNull() & ~F.isnan(x))
    lo, hi, n = present.agg(F.min(x), F.max(x), F.count(x)).first()
    iqr = None
    if bins == "auto" and n:
        q1, q3 = quantiles(present, [column], {"q1": 0.25, "q3": 0.75}).select("q1", "q3").first()
        iqr = q3 - q1
    count, lo, hi = _bin_count(lo, hi, n, iqr, bins)
    width = (hi - lo) / count
    place = F.floor((x - F.lit(lo)) / F.lit(width)).cast("long")
    place = F.least(F.greatest(place, F.lit(0)), F.lit(count - 1).cast("long"))
    group = [hue] if hue else []
    if hue:
        present = present.filter(F.col(hue).isNotNull())
    counts = present.groupBy(*group, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    if empty:
        grid = df.sparkSession.range(count).select(F.col("id").alias("bin"))
        if hue:  # every hue counts up its bins
            grid = counted_up(present.select(hue).distinct(), count, "bin")
        counts = grid.join(counts, [*group, "bin"], "left")
    return counts.select(
        *group, "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("left_edge"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("right_edge"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def _bin_count(lo: float | None, hi: float | None, n: int, iqr: float | None, bins: str | int) -> tuple[int, float, float]:
    """Number of bins and the range they cover; a single-valued column gets a unit range around it."""
    if lo is None:
        return 1, 0.0, 1.0
    span = hi - lo
    if span == 0:
        return (1 if bins == "auto" else int(bins)), lo - 0.5, hi + 0.5
    if bins != "auto":
        return int(bins), lo, hi
    sturges = span / (math.log2(n) + 1.0)
    fd = 2.0 * (iqr or 0.0) / n ** (1.0 / 3.0)
    width = min(fd, sturges) if fd else sturges
    return math.ceil(span / width), lo, hi


def box_stats(df: DataFrame, columns: list[str], hue: str | None = None, exact: bool = True) -> DataFrame:
    """Quartiles, whisker ends (furthest values within 1.5 IQR) and outlier counts per column and group.

    The distinct values are counted first, so a hot value or group costs one row per task; the counts
    then meet the fences.
    """
    by = [hue] if hue else []
    box = quantiles(df, columns, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=by, exact=exact)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    box = box.withColumns({"__low": F.col("q1") - reach, "__high": F.col("q3") + reach})
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    values = df.select(*by, F.explode(F.array(*cells)).alias("cell")).select(*by, "cell.*").filter(
        F.col("value").isNotNull())
    values = values.groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n"))
    inside = (F.col("value") >= F.col("__low")) & (F.col("value") <= F.col("__high"))
    return values.join(box, [*by, "column"]).groupBy(*by, "column").agg(
        *[F.max(c).alias(c) for c in ("q1", "median", "q3")],
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("outliers"),
    )


def group_means(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Mean of each column per group (a bar per target class)."""
    return df.filter(F.col(by).isNotNull()).groupBy(by).agg(*[F.avg(c).alias(c) for c in columns])


def crosstab_wide(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Share of each column category within each row category, one output column per category.

    Pairs are counted before they are pivoted; empty cells are 0.  Spark refuses a pivot over more
    than `spark.sql.pivotMaxValues` categories.
    """
    pairs = df.filter(F.col(rows).isNotNull() & F.col(columns).isNotNull()).groupBy(rows, columns).agg(
        F.count(F.lit(1)).alias("__n"))
    wide = pairs.groupBy(rows).pivot(columns).agg(F.sum("__n")).fillna(0)
    names = [c for c in wide.columns if c != rows]
    total = reduce(add, [F.col(f"`{c}`") for c in names])
    return wide.select(rows, *[(F.col(f"`{c}`").cast("double") / total).alias(c) for c in names])


def crosstab_pairs(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """rows, columns, n, share: the pairs that occur, with their share of the row category.

    As large as the pairs that occur, whatever the numbers of categories; a row category's total meets
    its pairs by a join on the category.  Rows without one of the two are left out.
    """
    pairs = df.filter(F.col(rows).isNotNull() & F.col(columns).isNotNull()).groupBy(rows, columns).agg(F.count(F.lit(1)).alias("n"))
    totals = pairs.groupBy(rows).agg(F.sum("n").alias("__total"))
    return pairs.join(totals, rows).select(rows, columns, "n", (F.col("n").cast("double") / F.col("__total")).alias("share"))


def crosstab_share(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """The same table with the pairs that do not occur, whose share is 0: rows x columns of them.

    Column categories are numbered by ranges, and every row category counts up to their number; no
    task holds the categories of a column.
    """
    pairs = stage(crosstab_pairs(df, rows, columns).select(rows, columns, "share"))
    coded = stage(numbered(pairs.select(columns).distinct(), [columns], "__code"))
    count = coded.count()
    grid = counted_up(pairs.select(rows).distinct(), count, "__code")
    known = pairs.join(coded, columns).select(rows, "__code", "share")
    found = grid.join(known, [rows, "__code"], "left").join(coded, "__code")
    return found.select(rows, columns, F.coalesce("share", F.lit(0.0)).alias("share"))


def pearson_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of every ordered pair over the rows where both are present; null without spread.

    One pass, however many columns: each task multiplies its rows' matrix with itself, masked where
    cells are missing, and the tasks' sums of each pair meet in the shuffle.  Values are shifted
    towards zero by an early estimate of their mean, which keeps the sums of squares precise.
    """
    values = df.select([F.col(c).cast("double").alias(str(i)) for i, c in enumerate(columns)])
    early = values.limit(1000).agg(*[F.avg(F.when(~F.isnan(c), F.col(c))) for c in values.columns]).first()
    shift = np.array([m or 0.0 for m in early])
    sums = values.mapInPandas(_pair_sums(shift), "a int, b int, n double, x double, y double, xx double, yy double, xy double")
    total = sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])

    def spread(square: str, plain: str) -> Column:
        left = F.col(square) - F.col(plain) * F.col(plain) / F.col("n")
        return F.when(left > 1e-12 * F.col(square), left)  # rounding leaves a constant column about this much

    cov = F.col("xy") - F.col("x") * F.col("y") / F.col("n")
    corr = F.try_divide(cov, F.sqrt(spread("xx", "x")) * F.sqrt(spread("yy", "y")))
    corr = F.when(F.col("a") == F.col("b"), F.when(spread("xx", "x").isNotNull(), F.lit(1.0))).otherwise(corr)
    names = F.array(*[F.lit(c) for c in columns])
    return total.select(F.get(names, "a").alias("left"), F.get(names, "b").alias("right"),
                        F.when(corr.isNotNull(), F.greatest(F.least(corr, F.lit(1.0)), F.lit(-1.0))).alias("corr"))


def _pair_sums(shift: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = len(shift)
        total = np.zeros((6, p, p))
        for batch in batches:
            x = batch.to_numpy(dtype="float64", na_value=np.nan) - shift
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype("float64")
            square = x * x
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, square.T @ m, m.T @ square, x.T @ x])
        a, b = np.divmod(np.arange(p * p), p)
        yield pd.DataFrame({"a": a, "b": b, **dict(zip(("n", "x", "y", "xx", "yy", "xy"), total.reshape(6, -1)))})

    return run


def average_ranks(df: DataFrame, columns: list[str], ids: list[str], hot_share: float = 0.001) -> DataFrame:
    """Replace each column by its average rank (ties share the mean of their places); nulls stay null.

    Ranks come from the distinct values.  Values that fill at least `hot_share` of the rows are
    few by definition (at most 1/hot_share per column), so their ranks are broadcast, and cells
    that hold one travel no further; only the other cells are joined by shuffle, where no value
    can make a partition heavy.
    """
    ranks = value_ranks(df, columns, coded=True).select(
        "column", "value", (F.col("before_n") + (F.col("n") + 1) / 2.0).alias("rank"),
        (F.col("n") >= F.col("total_n") * hot_share).alias("hot"))
    return _ranked_cells(df, columns, ids, ranks).groupBy(*ids).agg(
        *[F.max(F.when(F.col("column") == i, F.col("rank"))).alias(c) for i, c in enumerate(columns)])


def _ranked_cells(df: DataFrame, columns: list[str], ids: list[str], ranks: DataFrame) -> DataFrame:
    """ids, column, rank of every cell that has a value; `ranks` has column, value, rank, hot."""
    ranks = stage(ranks)
    cells = [F.struct(F.lit(i).alias("column"), (F.col(c).cast("double") + 0.0).alias("value")) for i, c in enumerate(columns)]
    long = df.select(*ids, F.explode(F.array(*cells)).alias("cell")).select(*ids, "cell.*")
    long = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    hot = F.broadcast(ranks.filter("hot").select("column", "value", "rank"))
    rest = ranks.filter(~F.col("hot")).select("column", "value", "rank")
    cold = long.join(hot, ["column", "value"], "left_anti").join(rest, ["column", "value"])
    names = [*ids, "column", "rank"]
    return long.join(hot, ["column", "value"]).select(*names).unionByName(cold.select(*names))


def spearman_pairs(df: DataFrame, columns: list[str], ids: list[str], hot_share: float = 0.001) -> DataFrame:
    """Rank correlation of every ordered pair over the rows where both are present; null without spread.

    Ranks are taken among those rows.  One plan serves all pairs: next to how many rows have a value,
    it is counted in how many of them each column with gaps is present, and running sums over the
    values give the value's rank among the rows of any other column.  So a cell has as many ranks as
    there are columns with gaps, and one without.  `ids` identify a row.
    """
    there = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in columns]
    counts = df.agg(F.count(F.lit(1)), *[F.count_if(t) for t in there]).first()
    gaps = [i for i, n in enumerate(counts[1:]) if n < counts[0]]
    ranked = value_ranks(df, columns, coded=True, sums={f"with_{i}": there[i].cast("long") for i in gaps})
    # the mean rank is half of all rows and one: centred ranks sum to 0
    centred = [F.col(f"before_{m}") + F.col(m) / 2.0 - F.col(f"total_{m}") / 2.0 for m in ["n", *[f"with_{i}" for i in gaps]]]
    ranks = ranked.select("column", "value", F.array(*centred).alias("rank"), (F.col("n") >= F.col("total_n") * hot_share).alias("hot"))
    rows = _ranked_cells(df, columns, ids, ranks).groupBy(*ids).agg(F.collect_list(F.struct("column", "rank")).alias("cells"))
    among = np.zeros(len(columns), int)  # which of a cell's ranks counts the rows of a column
    among[gaps] = np.arange(1, len(gaps) + 1)
    sums = rows.select("cells").mapInArrow(_rank_sums(among), "a int, b int, n long, xx double, yy double, xy double")
    total = sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "xx", "yy", "xy")])
    corr = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(F.try_divide("xy", F.sqrt("xx") * F.sqrt("yy"))))
    names = F.array(*[F.lit(c) for c in columns])
    return total.select(F.get(names, "a").alias("left"), F.get(names, "b").alias("right"),
                        F.when(corr.isNotNull(), F.greatest(F.least(corr, F.lit(1.0)), F.lit(-1.0))).alias("corr"))


def _rank_sums(among: np.ndarray):
    """Sums over the rows of each pair (a, b): of a's rank among b's rows, of b's among a's, squared and multiplied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, width = len(among), int(among.max(initial=0)) + 1
        total, count = np.zeros((3, p, p)), np.zeros((p, p), np.int64)
        step = max(1, (1 << 21) // max(1, p * p))
        for batch in batches:
            for k in range(0, batch.num_rows, step):
                cells = batch.column("cells").slice(k, step)
                size = np.diff(cells.offsets.to_numpy())
                flat = cells.flatten()
                row, column = np.repeat(np.arange(len(size)), size), flat.field("column").to_numpy()
                rank, there = np.zeros((len(size), p, width)), np.zeros((len(size), p))
                rank[row, column] = flat.field("rank").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                there[row, column] = 1
                x = rank[:, :, among] * there[:, None, :]
                y = x.transpose(0, 2, 1)
                total += np.stack([(x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)])
                count += np.rint(there.T @ there).astype(np.int64)
        a, b = np.divmod(np.arange(p * p), p)
        xx, yy, xy = total.reshape(3, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(count.ravel()), pa.array(xx), pa.array(yy), pa.array(xy)],
            names=["a", "b", "n", "xx", "yy", "xy"])

    return run


def strong_pairs(pairs: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Pairs of different columns whose correlation exceeds the threshold in size, both directions."""
    return pairs.filter((F.abs("corr") > threshold) & (F.col("left") != F.col("right")))
