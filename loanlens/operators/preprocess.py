"""Fit / transform of model inputs.

Fitting takes at most three narrow passes (moments, category counts, quantiles) and only fitted
numbers reach the driver.  The result is an ordinary `PipelineModel`: one SQL projection with the
fitted numbers as literals, the indexer and one-hot stages, and the assembler.  It can be saved,
loaded and applied to batch or streaming frames.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.functions.nulls import UNKNOWN, numeric_columns, string_columns
from loanlens.functions.ordering import quantiles
from loanlens.operators.dictionary import build_dictionary
from loanlens.operators.profiling import unpivot
from loanlens.sources.tables import scratch_folder, stage

# Categories with a natural order.
WEEKDAYS = ["MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY"]
EDUCATION = ["Lower secondary", "Secondary / secondary special", "Incomplete higher", "Higher education", "Academic degree"]
LITERALS = 1_000  # ordinal categories that a fitted model carries as literals; more are a table that it joins
LABELS = 100_000  # categories that may become labels of a fitted model at all
FIXED_ORDERS = {"WEEKDAY_APPR_PROCESS_START": WEEKDAYS, "NAME_EDUCATION_TYPE": EDUCATION}


@dataclass
class Blocks:
    """Columns of each treatment; the blocks are assembled in `order`."""

    order: list[str]
    std: list[str] = field(default_factory=list)
    log_robust: list[str] = field(default_factory=list)
    log: list[str] = field(default_factory=list)
    one_hot: list[str] = field(default_factory=list)
    weekday_ord: list[str] = field(default_factory=list)
    edu_ord: list[str] = field(default_factory=list)
    ordinal: list[str] = field(default_factory=list)
    ordinal_mean: list[str] = field(default_factory=list)
    mean: list[str] = field(default_factory=list)
    passthrough: list[str] = field(default_factory=list)


def baseline_blocks(
    log_robust: list[str], std: list[str], one_hot: list[str], ext_sources: list[str], passthrough: list[str],
    ordinal: list[str] | None = None,
) -> Blocks:
    """Treatment of the original application columns."""
    return Blocks(
        order=["std", "log_robust", "one_hot", "weekday_ord", "edu_ord", "ordinal", "mean", "passthrough"],
        std=std, log_robust=log_robust, one_hot=one_hot, weekday_ord=["WEEKDAY_APPR_PROCESS_START"],
        edu_ord=["NAME_EDUCATION_TYPE"], ordinal=["CODE_GENDER", "NAME_CONTRACT_TYPE"] if ordinal is None else ordinal,
        mean=ext_sources, passthrough=passthrough)


def updated_blocks(
    log_robust: list[str], std: list[str], log: list[str], one_hot: list[str], ordinal: list[str],
    ext_sources: list[str], passthrough: list[str],
) -> Blocks:
    """Treatment of the client matrix with history features."""
    return Blocks(
        order=["std", "log_robust", "log", "one_hot", "weekday_ord", "edu_ord", "ordinal_mean", "mean", "passthrough"],
        std=std, log_robust=log_robust, log=log, one_hot=one_hot, weekday_ord=["WEEKDAY_APPR_PROCESS_START"],
        edu_ord=["NAME_EDUCATION_TYPE"], ordinal_mean=ordinal, mean=ext_sources, passthrough=passthrough)


def _number(x: float | None) -> str:
    return "cast(null as double)" if x is None else f"cast('{float(x)!r}' as double)"


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _double(c: str) -> str:
    return f"cast(`{c}` as double)"


def moments(df: DataFrame, columns: list[str]) -> dict[str, dict[str, float]]:
    """Mean, present count and population deviation of each column, and the row count; one pass.

    `std` is the deviation after missing cells were replaced by the mean, which shrinks the
    variance by the share of present cells.
    """
    parts = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        parts += [F.avg(x).alias(f"mean_{i}"), F.count(x).alias(f"n_{i}"), F.var_pop(x).alias(f"var_{i}")]
    row = df.agg(*parts).first()
    out = {}
    for i, c in enumerate(columns):
        n, rows = row[f"n_{i}"], row["rows"]
        var = (row[f"var_{i}"] or 0.0) * n / rows if rows else 0.0
        out[c] = {"mean": row[f"mean_{i}"], "n": n, "std": var ** 0.5}
    return out


def level_counts(df: DataFrame, columns: list[str], most: int = LABELS) -> dict[str, dict[str | None, int]]:
    """Rows per category of each text column, in lexical order.

    The categories become part of the fitted model, as an indexer's labels are, so they must be `most`
    or fewer in all; more are an error, and columns with more are numbered by `dictionary.encode`.
    """
    found = _few_levels(df, columns, most)
    if found is None:
        raise ValueError(f"over {most} categories in {columns}: number them with a dictionary table")
    return found


def _few_levels(df: DataFrame, columns: list[str], most: int) -> dict[str, dict[str | None, int]] | None:
    if not columns:
        return {}
    found = unpivot(df, columns).groupBy("column", "value").count().limit(most + 1).collect()
    if len(found) > most:
        return None
    out: dict[str, dict[str | None, int]] = {c: {} for c in columns}
    for column, value, n in sorted(found, key=lambda r: (r[0], r[1] is None, r[1] or "")):
        out[column][value] = n
    return out


def mean_impute_sql(c: str, mean: float | None) -> str:
    return f"coalesce({_double(c)}, {_number(mean)})"


def ordinal_sql(c: str, levels: list[str], missing: str) -> str:
    """Category position as a double; `missing` is the text for a null, an unlisted one is an error.

    Positions come from the array of levels, which are sorted or few.
    """
    listed = ", ".join(_text(v) for v in levels)
    place = f"array_position(array({listed}), `{c}`)" if levels else "0"
    unknown = f"cast(raise_error(concat({_text(f'unknown category in {c}: ')}, `{c}`)) as double)"
    return f"case when `{c}` is null then {missing} when {place} = 0 then {unknown} else cast({place} - 1 as double) end"


def fit_preprocessor(df: DataFrame, blocks: Blocks, keep_columns: bool = False, dictionary: str | None = None) -> PipelineModel:
    """Learn all blocks from one frame and return the pipeline that applies them.

    The output has the input columns and `features`; `keep_columns` also keeps the treated columns,
    which are named `<block>__<column>`.  With `dictionary`, a path, the categories of `ordinal` and
    `ordinal_mean` are written there as a table that the pipeline joins, any number of them.  Without,
    up to LITERALS are part of the pipeline; for more the table lives as long as the program, so a
    pipeline that is to be saved needs a path of its own.
    """
    stats = moments(df, [*blocks.std, *blocks.log_robust, *blocks.log, *blocks.mean])
    ordinals = [*blocks.ordinal, *blocks.ordinal_mean]
    levels = level_counts(df, blocks.one_hot)
    if ordinals and not dictionary:
        few = _few_levels(df, ordinals, LITERALS)
        if few is None:
            dictionary = f"{scratch_folder(df.sparkSession)}/dictionary"
        else:
            levels |= few
    listed = _write_dictionary(df, ordinals, dictionary) if dictionary and ordinals else {}

    def imputed(c: str) -> str:
        return mean_impute_sql(c, stats[c]["mean"])

    logged = {c: f"log1p({imputed(c)})" for c in [*blocks.log_robust, *blocks.log]}
    spread: dict[str, tuple[float, float]] = {}
    if blocks.log_robust:
        prepared = df.select(*[F.expr(logged[c]).alias(c) for c in blocks.log_robust])
        for r in quantiles(prepared, blocks.log_robust, {"q1": 0.25, "q2": 0.5, "q3": 0.75}).collect():
            spread[r["column"]] = (r["q2"], (r["q3"] - r["q1"]) or 1.0)

    made: dict[str, dict[str, str]] = {
        "std": {c: f"({imputed(c)} - {_number(stats[c]['mean'])}) / {_number(stats[c]['std'] or 1.0)}" for c in blocks.std},
        "log_robust": {c: f"({logged[c]} - {_number(spread[c][0])}) / {_number(spread[c][1])}" for c in blocks.log_robust},
        "log": {c: logged[c] for c in blocks.log},
        "weekday_ord": {c: _fixed_order_sql(c, WEEKDAYS) for c in blocks.weekday_ord},
        "edu_ord": {c: _fixed_order_sql(c, EDUCATION) for c in blocks.edu_ord},
        "ordinal": {c: _joined_sql(c, "cast(null as double)") if listed else ordinal_sql(c, _present(levels[c]), "cast(null as double)")
                    for c in blocks.ordinal},
        "ordinal_mean": {c: _joined_sql(c, _number(listed[c])) if listed else ordinal_sql(c, _present(levels[c]), _number(_mean_code(levels[c])))
                         for c in blocks.ordinal_mean},
        "mean": {c: imputed(c) for c in blocks.mean},
        "passthrough": {c: _double(c) for c in blocks.passthrough},
    }
    selected = [f"{e} as `{block}__{c}`" for block, columns in made.items() for c, e in columns.items()]
    selected += [f"coalesce(`{c}`, {_text(UNKNOWN)}) as `text__{c}`" for c in blocks.one_hot]
    stages: list[Transformer] = [SQLTransformer(statement=f"select *, {', '.join(selected)} from __THIS__")]
    if listed:
        stages.insert(0, SQLTransformer(statement=_join_sql(ordinals, dictionary)))
    spare = [f"text__{c}" for c in blocks.one_hot] + [f"index__{c}" for c in blocks.one_hot] + [f"code__{c}" for c in listed]
    if blocks.one_hot:
        indexers = [
            StringIndexerModel.from_labels(
                sorted({UNKNOWN if v is None else v for v in levels[c]}), inputCol=f"text__{c}", outputCol=f"index__{c}",
                handleInvalid="error")
            for c in blocks.one_hot
        ]
        encoder = OneHotEncoder(inputCols=[f"index__{c}" for c in blocks.one_hot],
                                outputCols=[f"one_hot__{c}" for c in blocks.one_hot], dropLast=False)
        shaped = PipelineModel([*stages, *indexers]).transform(df.limit(0))  # the encoder reads only the schema
        stages += [*indexers, encoder.fit(shaped)]
    names = [f"{block}__{c}" for block in blocks.order for c in getattr(blocks, block)]
    stages.append(VectorAssembler(inputCols=names, outputCol="features"))
    if keep_columns:
        unwanted = spare
    else:
        unwanted = spare + names
    if unwanted:
        stages.append(SQLTransformer(statement=f"select * except ({', '.join(f'`{n}`' for n in unwanted)}) from __THIS__"))
    return PipelineModel(stages)


def _write_dictionary(df: DataFrame, columns: list[str], path: str) -> dict[str, float | None]:
    """Write the columns' categories and codes; the mean code of each column's rows."""
    build_dictionary(df, columns).select("column", "value", F.col("code").cast("double").alias("code"), "n").write.mode("overwrite").partitionBy("column").parquet(path)
    stored = df.sparkSession.read.parquet(path)
    means = {r["column"]: r["mean"] for r in stored.groupBy("column").agg((F.sum(F.col("code") * F.col("n")) / F.sum("n")).alias("mean")).collect()}
    return {c: means.get(c) for c in columns}


def _join_sql(columns: list[str], path: str) -> str:
    """Spark broadcasts a column's part of the dictionary where it is small, and splits frequent categories where not."""
    joins = [f"left join (select value, code from parquet.`{path}` where column = {_text(c)}) d{i} on t.`{c}` = d{i}.value" for i, c in enumerate(columns)]
    return f"select t.*, {', '.join(f'd{i}.code as `code__{c}`' for i, c in enumerate(columns))} from __THIS__ t {' '.join(joins)}"


def _joined_sql(c: str, missing: str) -> str:
    unknown = f"cast(raise_error(concat({_text(f'unknown category in {c}: ')}, `{c}`)) as double)"
    return f"case when `{c}` is null then {missing} when `code__{c}` is null then {unknown} else `code__{c}` end"


def _present(counts: dict[str | None, int]) -> list[str]:
    return [v for v in counts if v is not None]


def _mean_code(counts: dict[str | None, int]) -> float | None:
    present = _present(counts)
    n = sum(counts[v] for v in present)
    return sum(i * counts[v] for i, v in enumerate(present)) / n if n else None


def _fixed_order_sql(c: str, order: list[str]) -> str:
    return ordinal_sql(c, order, f"cast(raise_error({_text(f'missing category in {c}')}) as double)")


def feature_names(df: DataFrame, column: str = "features") -> list[str]:
    """Names of the assembled features without their block prefix, in vector order."""
    attributes = df.schema[column].metadata["ml_attr"]["attrs"]
    listed = sorted((a for kind in attributes.values() for a in kind), key=lambda a: a["idx"])
    return [a["name"].split("__", 1)[1] for a in listed]


def mode_impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fill missing cells with the most frequent value, the smallest one on a tie.

    Values are counted first, so no task holds a column's values; one value per column is fetched.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    numbers = [c for c in columns if not isinstance(types[c], T.StringType)]
    counts = unpivot(df, columns).filter(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("column").agg(F.max("n").alias("n"))
    number = F.when(F.col("column").isin(numbers), F.col("value").cast("double"))
    tied = counts.join(F.broadcast(most), ["column", "n"]).groupBy("column").agg(  # one row per column
        F.min(number).alias("number"), F.min("value").alias("text"))
    best = {r["column"]: r["number"] if r["column"] in numbers else r["text"] for r in tied.collect()}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(best.get(c)).cast(types[c])) for c in columns})


def dummies(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """One 0/1 column per category; a missing category is 0 in all of them.

    Dots in a category become underscores, as they would name a nested field.
    """
    levels = level_counts(df, columns)
    return {f"{c}_{v}".replace(".", "_"): F.coalesce(F.col(c) == F.lit(v), F.lit(False)).cast("int")
            for c in columns for v in _present(levels[c])}


def encode_for_correlation(
    df: DataFrame, one_hot: list[str], ordinal: list[str] | None = None, ids: list[str] | None = None
) -> DataFrame:
    """All columns as numbers: dummies, ordered categories, YES/NO as 1/0, missing numbers as the mean.

    `ordinal` columns without a fixed order get their lexical position, null staying null.  Other
    text columns must hold YES, NO or numbers.  `ids` pass through untouched.  The rows are stored
    first: categories and means are learned in passes of their own, which must not compute them again.
    """
    ids = ids or []
    df = stage(df)
    ordinal = ["CODE_GENDER", "NAME_EDUCATION_TYPE", "WEEKDAY_APPR_PROCESS_START"] if ordinal is None else ordinal
    texts = [c for c in string_columns(df) if c not in one_hot and c not in ordinal and c not in ids]
    numbers = [c for c in numeric_columns(df) if c not in ids]
    learned = level_counts(df, [c for c in ordinal if c not in FIXED_ORDERS])
    extra = dummies(df, one_hot)

    def as_number(c: str) -> Column:
        x = F.col(c)
        return F.when(x == "YES", 1.0).when(x == "NO", 0.0).otherwise(x.cast("double"))

    numeric: dict[str, Column] = {c: F.col(c).cast("double") for c in numbers}
    numeric.update({c: as_number(c) for c in texts})
    means = df.agg(*[F.avg(e).alias(c) for c, e in numeric.items()]).first().asDict() if numeric else {}
    out: dict[str, Column] = {}
    for c in df.columns:
        if c in numeric:
            out[c] = F.coalesce(numeric[c], F.lit(means[c]).cast("double"))
        elif c in ordinal:
            sql = _fixed_order_sql(c, FIXED_ORDERS[c]) if c in FIXED_ORDERS else ordinal_sql(
                c, _present(learned[c]), "cast(null as double)")
            out[c] = F.expr(sql)
        elif c in ids:
            out[c] = F.col(c)
    out.update(extra)
    return df.select(*[e.alias(c) for c, e in out.items()])


INTEGER_RANGES = [("tinyint", 2 ** 7), ("smallint", 2 ** 15), ("int", 2 ** 31)]
FLOAT_TOLERANCE = 5e-4
WIDTHS = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8}


def narrow_plan(df: DataFrame) -> DataFrame:
    """The narrowest type that holds each numeric column: (column, from_type, to_type); one pass.

    Integers go by their range; doubles become float when no value moves by more than 0.0005.
    """
    parts, cells = [], []
    for i, f in enumerate(f for f in df.schema.fields if isinstance(f.dataType, (T.IntegralType, T.DoubleType, T.FloatType))):
        x, kind = F.col(f.name), f.dataType.simpleString()
        if isinstance(f.dataType, T.IntegralType):
            parts += [F.min(x).cast("long").alias(f"lo_{i}"), F.max(x).cast("long").alias(f"hi_{i}")]
            to = F.lit("bigint")
            for name, bound in reversed(INTEGER_RANGES):
                fits = (F.col(f"lo_{i}") >= -bound) & (F.col(f"hi_{i}") <= bound - 1)
                to = F.when(F.coalesce(fits, F.lit(False)), F.lit(name)).otherwise(to)
        else:
            parts.append(F.max(F.abs(x - x.cast("float").cast("double"))).alias(f"off_{i}"))
            to = F.when(F.coalesce(F.col(f"off_{i}") <= FLOAT_TOLERANCE, F.lit(True)), F.lit("float")).otherwise(F.lit("double"))
        cells.append(F.struct(F.lit(f.name).alias("column"), F.lit(kind).alias("from_type"), to.alias("to_type")))
    return df.agg(*parts).select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def narrow_types(df: DataFrame) -> DataFrame:
    """Cast every numeric column to the narrowest type that holds it.

    Texts need nothing: Parquet stores repeated texts as a dictionary.
    """
    plan = {r["column"]: r["to_type"] for r in narrow_plan(df).collect()}  # one row per column
    return df.select(*[F.col(c).cast(plan[c]).alias(c) if c in plan else F.col(c) for c in df.columns])


def narrow_report(df: DataFrame) -> DataFrame:
    """Bytes of the numeric cells before and after narrowing."""
    width = F.create_map(*[F.lit(x) for pair in WIDTHS.items() for x in pair])
    sums = narrow_plan(df).agg(F.sum(width[F.col("from_type")]).alias("before"), F.sum(width[F.col("to_type")]).alias("after"))
    before, after = sums.first()
    return df.agg((F.count(F.lit(1)) * before).alias("bytes_before"), (F.count(F.lit(1)) * after).alias("bytes_after"))


def categorical_dataset(df: DataFrame, drop: list[str]) -> DataFrame:
    """Input of the tree models: columns dropped, texts never missing, numbers narrowed."""
    kept = df.drop(*drop)
    texts = string_columns(kept)
    return narrow_types(kept.fillna(UNKNOWN, subset=texts) if texts else kept)


def yes_no_to_number(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) == "YES", 1.0).when(F.col(c) == "NO", 0.0) for c in columns})

