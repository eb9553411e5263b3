"""Order statistics and ordered selections without a window over the whole table.

`value_ranks` gives, for every distinct value, how many rows lie below it.  Quantiles, average
ranks, the ROC curve and its area are all read from that one table.  Rows are first collapsed to
(value, count), so a value that fills a third of the table costs one row; the ordered running
sums then work inside value ranges, and only one subtotal per range is ordered globally.

`hash_order` does the same for "the first q rows of a class in random order": rows are ordered by
a hash of their identifier, which is the same on every attempt and under every partitioning.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Any long tie-break stays under one step of the month in the order key of `first_at_latest`.
TIE_STEP = Decimal(10 ** 20)
RANGE_ROWS = 65_536
RANGES = 256
MOST_RANGES = 4096


def first_at_latest(value: Column, month: Column, tie: Column) -> Column:
    """Aggregate: the value in the row with the latest month, lowest tie-break first.

    Month and tie-break share one decimal, so the state stays of fixed width and Spark keeps hash
    aggregation; a struct key would force a sort of the whole monthly table.  Rows without a month
    or tie-break have a null key and never win.  Any long is a tie-break.
    """
    key = -month.cast("decimal(11,0)") * F.lit(TIE_STEP) + tie.cast("decimal(20,0)")
    return F.min_by(value, key)


def pack_text(text: Column) -> Column:
    """A text of up to seven bytes as a number, for aggregation states; longer ones are an error."""
    number = F.conv(F.hex(F.concat(F.lit("\x01"), text)), 16, 10).cast("long")
    long = F.raise_error(F.concat(F.lit("text of more than seven bytes: "), text)).cast("long")
    return F.when(F.octet_length(text) > 7, long).otherwise(number)


def unpack_text(number: Column) -> Column:
    return F.substr(F.decode(F.unhex(F.concat(F.lit("0"), F.hex(number))), "UTF-8"), F.lit(2))


def stable_tie(*cols: str) -> Column:
    """Tie-break for tables without a row number: a hash of the columns read from the row."""
    return F.xxhash64(*cols)


def range_splits(df: DataFrame, columns: list[str], ranges: int | None = None) -> dict[str, list[float]]:
    """Value boundaries that cut each column into ranges of similar row counts.

    One pass for all columns finds the row count and up to RANGES boundaries each; tables with more
    than RANGES * RANGE_ROWS rows take a second pass for as many as their rows ask for, up to
    MOST_RANGES, so that what the driver holds does not grow with the rows.  Beyond, ranges get
    longer, and tasks order them by spilling.  The boundaries are approximate, which only affects
    balance: results are exact for any boundaries.
    """
    values = [F.col(c).cast("double") for c in columns]

    def probabilities(n: int) -> list[float]:
        return [i / n for i in range(1, n)]

    found = df.agg(F.count(F.lit(1)), *[F.percentile_approx(v, probabilities(RANGES), 4 * RANGES) for v in values]).first()
    wanted = min(ranges or max(2, found[0] // RANGE_ROWS + 1), MOST_RANGES)
    cuts = [c or [] for c in found[1:]]
    if wanted <= RANGES:
        cuts = [[c[(len(c) + 1) * i // wanted - 1] for i in range(1, wanted)] if c else [] for c in cuts]
    else:
        cuts = [c or [] for c in df.agg(*[F.percentile_approx(v, probabilities(wanted), 4 * wanted) for v in values]).first()]
    inf = float("inf")
    splits = {}
    for name, own in zip(columns, cuts):
        inner = sorted({c + 0.0 for c in own if -inf < c < inf})
        splits[name] = [-inf, *(inner or [0.0]), inf]
    return splits


def value_ranks(
    df: DataFrame,
    columns: list[str],
    by: list[str] | None = None,
    sums: dict[str, Column] | None = None,
    previous: bool = False,
    ranges: int | None = None,
    coded: bool = False,
) -> DataFrame:
    """Distinct values of each column with the number of rows below them.

    Columns are shuffled as their position in `columns`; `coded` leaves it that way.
    Returns `by` columns, `column`, `value`, `n`, `before_n`, `total_n` and, for each entry of
    `sums`, the same three for that sum; with `previous` also `previous_*`, the numbers of the next
    lower value.  Rows with a missing value or a missing `by` are left out.
    """
    by = by or []
    sums = sums or {}
    splits = range_splits(df, columns, ranges)
    source = df.select(
        *by,
        *[(F.col(c).cast("double") + 0.0).alias(f"v_{i}") for i, c in enumerate(columns)],  # no -0.0: it sorts apart
        *[s.alias(f"s_{name}") for name, s in sums.items()],
    )
    marked = Bucketizer(
        splitsArray=[splits[c] for c in columns],
        inputCols=[f"v_{i}" for i in range(len(columns))],
        outputCols=[f"r_{i}" for i in range(len(columns))],
        handleInvalid="keep",
    ).transform(source)
    cells = [
        F.struct(F.lit(i).alias("column"), F.col(f"r_{i}").cast("int").alias("range"), F.col(f"v_{i}").alias("value"))
        for i, c in enumerate(columns)
    ]
    added = [f"s_{name}" for name in sums]
    long = marked.select(*by, *added, F.explode(F.array(*cells)).alias("cell")).select(*by, *added, "cell.*")
    # The null test on `range` says nothing new, but the joins below would add it on one side only,
    # and the counts would be computed twice instead of being shared.
    long = long.filter(F.col("value").isNotNull() & ~F.isnan("value") & F.col("range").isNotNull())
    for key in by:
        long = long.filter(F.col(key).isNotNull())

    measures = ["n", *sums]
    group = [*by, "column"]
    counts = long.groupBy(*group, "range", "value").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"s_{name}").alias(name) for name in sums])
    # one row per range of a group is ordered here
    ordered = Window.partitionBy(*group).orderBy("range")
    below = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    tops = [F.max_by(m, "value").alias(f"top_{m}") for m in measures] if previous else []
    bases = counts.groupBy(*group, "range").agg(*[F.sum(m).alias(m) for m in measures], *tops).select(
        *group, "range",
        *[F.coalesce(F.sum(m).over(below), F.lit(0)).alias(f"base_{m}") for m in measures],
        *[F.sum(m).over(whole).alias(f"total_{m}") for m in measures],
        *[F.lag(f"top_{m}").over(ordered).alias(f"top_{m}") for m in measures if previous],
    )
    inside = Window.partitionBy(*group, "range").orderBy("value")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.select(
        *group, "range", "value", *measures,
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"inner_{m}") for m in measures],
        *[F.lag(m).over(inside).alias(f"near_{m}") for m in measures if previous],
    ).join(bases, [*group, "range"])
    names = F.col("column") if coded else F.get(F.array(*[F.lit(c) for c in columns]), "column")
    return ranked.select(
        *by, names.alias("column"), "value", *measures,
        *[(F.col(f"base_{m}") + F.col(f"inner_{m}")).alias(f"before_{m}") for m in measures],
        *[f"total_{m}" for m in measures],
        *[F.coalesce(f"near_{m}", f"top_{m}").alias(f"previous_{m}") for m in measures if previous],
    )


def quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: dict[str, float],
    by: list[str] | None = None,
    exact: bool = True,
    ranges: int | None = None,
) -> DataFrame:
    """Quantiles per column (and group) in long form, one output column per named probability.

    Exact quantiles interpolate linearly between neighbouring rows.  With `exact=False` the
    sketch-based `percentile_approx` is used instead: one aggregation, an existing row's value.
    """
    by = by or []
    if not exact:
        parts = [F.percentile_approx(F.col(c).cast("double"), p, 10000).alias(f"{i}_{name}")
                 for i, c in enumerate(columns) for name, p in probabilities.items()]
        source = df
        for key in by:
            source = source.filter(F.col(key).isNotNull())
        wide = source.groupBy(*by).agg(*parts)
        rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{name}").alias(name) for name in probabilities])
                for i, c in enumerate(columns)]
        return wide.select(*by, F.explode(F.array(*rows)).alias("cell")).select(*by, "cell.*")

    ranked = value_ranks(df, columns, by, ranges=ranges, coded=True)

    def value_at(position: Column) -> Column:
        return F.max(F.when((F.col("before_n") <= position) & (position < F.col("before_n") + F.col("n")), F.col("value")))

    aggregates = []
    for name, p in probabilities.items():
        place = (F.col("total_n") - 1) * F.lit(float(p))
        aggregates += [
            value_at(F.floor(place)).alias(f"lo_{name}"),
            value_at(F.ceil(place)).alias(f"hi_{name}"),
            F.max(place - F.floor(place)).alias(f"part_{name}"),
        ]
    found = ranked.groupBy(*by, "column").agg(*aggregates)
    return found.select(*by, F.get(F.array(*[F.lit(c) for c in columns]), "column").alias("column"), *[
        (F.col(f"lo_{name}") + (F.col(f"hi_{name}") - F.col(f"lo_{name}")) * F.col(f"part_{name}")).alias(name)
        for name in probabilities
    ])


def hash_key(ids: list[str], seed: int) -> Column:
    """Random but repeatable order of rows; the identifiers settle equal hashes."""
    return F.struct(F.xxhash64(F.lit(seed), *ids).alias("hash"), *[F.col(c) for c in ids])


def slice_bits(rows: int) -> int:
    """Bits of the hash that name a slice, so that a slice has about RANGE_ROWS / 16 rows."""
    return max(1, min(40, (16 * rows // RANGE_ROWS).bit_length()))


def hash_order(df: DataFrame, label: str, ids: list[str], seed: int, name: str = "position", rows: int | None = None) -> DataFrame:
    """Add each row's 0-based position inside its class in hash order.

    Positions are counted inside slices of the hash space; only the slice sizes are ordered across
    slices.  `ids` must identify a row; `rows` is the number of rows, where it is known.
    """
    bits = slice_bits(df.count() if rows is None else rows)
    keyed = df.withColumn("__key", hash_key(ids, seed)).withColumn("__slice", F.shiftright(F.col("__key.hash"), 64 - bits))
    sizes = keyed.groupBy(label, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    below = Window.partitionBy(label).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(label, "__slice", F.coalesce(F.sum("__n").over(below), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(label, "__slice").orderBy("__key")
    ordered = keyed.withColumn("__inner", F.row_number().over(inside) - 1).join(bases, [label, "__slice"])
    return ordered.withColumn(name, F.col("__base") + F.col("__inner")).select(*df.columns, name)


def class_cuts(df: DataFrame, label: str, ids: list[str], seed: int, places: dict) -> DataFrame:
    """Keys at given places of the hash order of each class: (__label, __none, __cuts).

    `places` has a rising list of places per class, from 1; a place of 0 lies before all rows and is
    counted in `__none`.  Only slice sizes and the slices that hold a place are ordered.
    """
    bits = slice_bits(df.count())
    narrow = df.select(F.col(label).alias("__label"), hash_key(ids, seed).alias("__key")).withColumn(
        "__slice", F.shiftright(F.col("__key.hash"), 64 - bits))
    kind = df.schema[label].dataType.simpleString()
    rows = [(value, int(p)) for value, own in places.items() for p in own]
    wanted = df.sparkSession.createDataFrame(rows, f"__label {kind}, __place long")
    upto = Window.partitionBy("__label").orderBy("__slice").rowsBetween(Window.unboundedPreceding, 0)
    ends = narrow.groupBy("__label", "__slice").agg(F.count(F.lit(1)).alias("__n")).withColumn("__end", F.sum("__n").over(upto))
    held = ends.join(wanted, "__label").filter("__end >= __place and __end - __n < __place").select(
        "__label", "__slice", (F.col("__place") - F.col("__end") + F.col("__n")).alias("__inner"))
    inside = Window.partitionBy("__label", "__slice").orderBy("__key")
    ordered = narrow.join(held.select("__label", "__slice").distinct(), ["__label", "__slice"]).withColumn(
        "__inner", F.row_number().over(inside).cast("long"))
    keys = ordered.join(held, ["__label", "__slice", "__inner"]).groupBy("__label").agg(
        F.array_sort(F.collect_list("__key")).alias("__cuts"))
    none = wanted.groupBy("__label").agg(F.count_if(F.col("__place") == 0).alias("__none"))
    return none.join(keys, "__label", "left")  # one row per class


def count_cuts(df: DataFrame, label: str, ids: list[str], seed: int, places: dict, name: str) -> DataFrame:
    """Add how many of its class's places lie before each row; no wide row is sorted."""
    cuts = class_cuts(df, label, ids, seed, places)
    joined = df.withColumn("__key", hash_key(ids, seed)).join(F.broadcast(cuts), F.col(label) == F.col("__label"), "left")
    passed = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("__key"))), F.lit(0))
    passed = F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(passed) + F.coalesce("__none", F.lit(0))
    return joined.withColumn(name, passed.cast("int")).select(*df.columns, name)


def first_of_class(df: DataFrame, label: str, ids: list[str], seed: int, quotas: dict) -> DataFrame:
    """Add `taken`: is the row among the first `quotas[class]` rows of its class in hash order?

    The last row to take is located first; marking the rows is then a comparison with that one row
    per class, so the wide rows are neither sorted nor shuffled.  `ids` must identify a row.
    """
    marked = count_cuts(df, label, ids, seed, {value: [q] for value, q in quotas.items()}, "__passed")
    listed = F.col(label).isin(list(quotas)) if quotas else F.lit(False)
    return marked.withColumn("taken", F.coalesce(listed & (F.col("__passed") == 0), F.lit(False))).drop("__passed")
