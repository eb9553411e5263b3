"""Categories as numbers, however many there are: no category reaches the driver.

A dictionary is a table.  Its categories are ordered by ranges, and a category's number is how many
stand before it in its range, plus how many the ranges before hold.  Cells are numbered by joins.
"""

from __future__ import annotations

from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanlens.sources.tables import stage

BROADCAST_ROWS = 100_000  # a larger dictionary is not sent to the tasks
HOT_SHARE = 0.001  # at most 1,000 categories of a column have this share of its cells


def build_dictionary(df: DataFrame, columns: list[str], missing: str | None = None) -> DataFrame:
    """column, value, code, n, hot: the categories of each text column, numbered from 0 in lexical order.

    A null counts as the category `missing`, or as none.  `hot` marks the categories that fill at least
    HOT_SHARE of a column's cells.  The result is stored.
    """
    cell = lambda c: F.col(f"`{c}`").cast("string") if missing is None else F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(missing))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), cell(c).alias("value")) for c in columns])
    counts = df.select(F.explode(cells).alias("cell")).select("cell.*").where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    numbers = numbered(counts, ["value"], "code", "column", {"cells": "n"})
    return stage(numbers.select("column", "value", "code", "n", (F.col("n") >= HOT_SHARE * F.col("cells")).alias("hot")))


def numbered(df: DataFrame, order: list[str], name: str, within: str | None = None, sums: dict[str, str] | None = None) -> DataFrame:
    """`df` with the place of each row (a long from 0) in the given order, within each value of a column.

    Rows are ordered by ranges; one row per range, and per value that starts in it, is summed up.
    `sums` adds the total of a column within that value, under a name.  Rows that are equal in the
    order get different places.
    """
    group, sums = within or "__all", sums or {}
    rows = df if within else df.withColumn(group, F.lit(0))
    keys = [*([within] if within else []), *order]
    ranges = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = stage(ranges.withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    parts = rows.groupBy("__part", group).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__size"), *[F.sum(c).alias(t) for t, c in sums.items()])
    whole = Window.partitionBy(group)
    up = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__part", group, "__first", F.coalesce(F.sum("__size").over(up), F.lit(0)).alias("__before"), *[F.sum(t).over(whole).alias(t) for t in sums])
    # as many rows as there are ranges and values to number within: the latter are columns' names
    found = rows.join(F.broadcast(parts), ["__part", group])
    return found.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__before") + F.col("__at") - F.col("__first")).alias(name), *sums)


def counted_up(df: DataFrame, count: int, name: str, block: int = 4096) -> DataFrame:
    """Every row once for each number below `count`; no array is longer than `block` or count / block."""
    blocks = df.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(max(0, (count - 1) // block)))))
    end = F.least(F.col("__block") * block + block - 1, F.lit(count - 1))
    out = blocks.withColumn(name, F.explode(F.sequence((F.col("__block") * block).cast("long"), end.cast("long")))).drop("__block")
    return out if count else out.limit(0)


def dictionary_sizes(dictionary: DataFrame, columns: list[str]) -> dict[str, int]:
    """Categories per column: one number each."""
    found = {r["column"]: r["count"] for r in dictionary.groupBy("column").count().collect()}
    return {c: found.get(c, 0) for c in columns}


def encode(
    df: DataFrame, dictionary: DataFrame, columns: list[str], ids: list[str], missing: str | None = None, suffix: str = "_code",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add each column's code (a long) under its name and `suffix`; a category that is not listed is an error.

    A null is `missing`, as in the dictionary, or stays null.  Up to `broadcast_rows` categories are
    sent to the rows.  Beyond that only the hot ones are, at most 1 / HOT_SHARE per column; the other
    cells travel to their part of the dictionary and back to their row, which `ids` identify.
    """
    total = sum(dictionary_sizes(dictionary, columns).values())
    value = {c: F.col(f"`{c}`").cast("string") if missing is None else F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(missing)) for c in columns}
    if total <= broadcast_rows:
        out = df
        for i, c in enumerate(columns):
            own = dictionary.where(F.col("column") == c).select(F.col("value").alias(f"__value_{i}"), F.col("code").alias(f"__code_{i}"))
            out = out.join(F.broadcast(own), value[c] == F.col(f"__value_{i}"), "left").drop(f"__value_{i}")
        codes = {f"{c}{suffix}": F.when(value[c].isNotNull(), _listed(F.col(f"__code_{i}"), c, value[c])) for i, c in enumerate(columns)}
        return out.withColumns(codes).drop(*[f"__code_{i}" for i in range(len(columns))])
    cells = [F.struct(F.lit(c).alias("column"), value[c].alias("value")) for c in columns]
    long = df.select(*ids, F.explode(F.array(*cells)).alias("cell")).select(*ids, "cell.*").where("value is not null")
    hot = F.broadcast(dictionary.where("hot").select("column", "value", "code"))
    rest = dictionary.where("not hot").select("column", "value", "code")
    near = long.join(hot, ["column", "value"]).select(*ids, "column", "code")
    far = long.join(hot, ["column", "value"], "left_anti").join(rest, ["column", "value"], "left")
    far = far.select(*ids, "column", _listed(F.col("code"), F.col("column"), F.col("value")).alias("code"))
    wide = near.unionByName(far).groupBy(*ids).agg(*[F.max(F.when(F.col("column") == c, F.col("code"))).alias(f"{c}{suffix}") for c in columns])
    return df.join(wide, ids, "left")


def _listed(code, column, value):
    name = column if not isinstance(column, str) else F.lit(column)
    return F.when(code.isNull(), F.raise_error(F.concat(F.lit("unknown category in "), name, F.lit(": "), value)).cast("long")).otherwise(code)


def with_slots(dictionary: DataFrame, columns: list[str]) -> DataFrame:
    """The dictionary with `slot`, a category's place in one-hot vectors: column after column, by code."""
    starts, at = {}, 0
    for c, n in dictionary_sizes(dictionary, columns).items():
        starts[c], at = at, at + n
    start = F.element_at(F.create_map(*[F.lit(x) for c in columns for x in (c, starts[c])]), F.col("column"))
    return dictionary.where(F.col("column").isin(columns)).withColumn("slot", (start + F.col("code")).cast("long"))


def one_hot(
    df: DataFrame, dictionary: DataFrame, columns: list[str], ids: list[str], missing: str | None = None, slots: str = "slots",
    vector: str | None = None, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add the slots (see `with_slots`) that are 1 in each row, and with `vector` the sparse vector of them.

    The names of the slots are in the dictionary; the vector carries none, so its size costs nothing.
    A null without a `missing` category is 0 everywhere.
    """
    sizes = dictionary_sizes(dictionary, columns)
    suffix = "__one_hot"
    coded = encode(df, dictionary, columns, ids, missing, suffix, broadcast_rows)
    places, at = [], 0
    for c in columns:
        places.append(F.col(f"`{c}{suffix}`") + F.lit(at))
        at += sizes[c]
    out = coded.withColumn(slots, F.array_compact(F.array(*places))).drop(*[f"{c}{suffix}" for c in columns])
    if vector is None:
        return out
    build = F.udf(lambda own: SparseVector(at, own, [1.0] * len(own)), VectorUDT(), useArrow=True)
    return out.withColumn(vector, build(slots))
