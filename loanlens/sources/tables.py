"""Readers and writers: delimited files, Parquet feature tables, fitted models, shared staging."""

from __future__ import annotations

import atexit
import re
import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.functions.nulls import MISSING_TOKENS, nan_to_null


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    index_column: bool = False,
    index_name: str | None = None,
) -> DataFrame:
    """Read a delimited file with a header into typed columns.

    Every cell arrives as text, the whole list of missing-value texts becomes null, and the rest
    is cast; a reader option could name only one such text.  Integers written as `3.0` (a column
    that once held missing values) are accepted.  `index_column` treats the first, possibly
    unnamed column as a row index: it is dropped, or kept under `index_name`.
    Schema columns absent from the file are left out rather than made up.
    """
    raw = spark.read.option("header", True).csv(path)
    if index_column:
        first, rest = raw.columns[0], raw.columns[1:]
        head = [F.col(f"`{first}`").alias(index_name)] if index_name else []
        raw = raw.select(*head, *[F.col(f"`{c}`") for c in rest])
    present = [f for f in schema.fields if f.name in raw.columns]
    return nan_to_null(raw.select(*[_typed(f).alias(f.name) for f in present]))


def _typed(field: T.StructField):
    text = F.trim(F.col(field.name))
    cell = F.when(~text.isin(MISSING_TOKENS), F.col(field.name))
    if isinstance(field.dataType, T.StringType):
        return cell
    number = F.trim(cell).try_cast("double")
    if isinstance(field.dataType, T.IntegralType):
        direct = F.trim(cell).try_cast(field.dataType)
        whole = F.when(number == F.floor(number), number).try_cast(field.dataType)
        return F.coalesce(direct, whole)
    return number.cast(field.dataType)


@dataclass
class CheckedRead:
    """Typed rows; the cells that could not be read (file, row, column, text, reason); and how many cells there are of each."""

    rows: DataFrame
    rejects: DataFrame
    cells_given: int
    cells_rejected: int


def read_csv_checked(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    most_rejected: float = 0.01,
    index_column: bool = False,
    index_name: str | None = None,
    row_name: str | None = None,
) -> CheckedRead:
    """Read like `read_csv`, and keep what does not fit instead of making it null unseen.

    A cell is rejected if it is no number in a number column, a fraction in an integer column, or out
    of the column's range; a record that ends early rejects its missing cells (text null), a longer one
    the cells beyond the last column (column `#n`, from 1).  Rejected cells are null in the rows.  Given
    are one cell for each record and column of the file, and those beyond.  Where more than
    `most_rejected` of them are rejected, the read fails and says where.  The file is read once and
    stored; `row_name` keeps the number by which rejects name a row.
    """
    header = spark.read.option("header", True).csv(path).columns
    spare = [f"__{i}" for i in range(len(header))]  # headers may be empty or repeat
    text = T.StructType([T.StructField(c, T.StringType()) for c in [*spare, "__record"]])
    raw = spark.read.option("header", True).option("columnNameOfCorruptRecord", "__record").schema(text).csv(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__row"))
    # only records of another length have a text here; commas inside quotes don't count
    parts = F.split("__record", r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    raw = raw.withColumn("__parts", F.when(F.col("__record").isNotNull(), parts))
    raw = raw.withColumn("__length", F.when(F.col("__parts").isNull(), len(header)).otherwise(F.size("__parts")))
    place = {name: i for i, name in reversed(list(enumerate(header)))}
    if index_column:
        place.pop(header[0], None)
        if index_name:
            place[index_name] = 0
    known = [f for f in schema.fields if f.name in place]
    bad, typed = [], []
    for f in known:
        cell = T.StructField(spare[place[f.name]], f.dataType)
        value = _typed(cell)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value), value)
        typed.append(value.alias(f.name))
        reason = F.when(F.lit(place[f.name]) >= F.col("__length"), "missing from a short record").otherwise(_reason(cell))
        bad.append(F.struct(F.lit(f.name).alias("column"), F.col(cell.name).alias("text"), reason.alias("reason")))
    beyond = F.when(F.col("__length") > len(header), F.transform(
        F.slice("__parts", len(header) + 1, F.greatest(F.col("__length") - len(header), F.lit(0))),
        lambda x, i: F.struct(F.concat(F.lit("#"), (i + len(header) + 1).cast("string")).alias("column"), x.alias("text"), F.lit("beyond the last column").alias("reason"))))
    none = F.array().cast("array<struct<column:string,text:string,reason:string>>")
    found = F.concat(F.filter(F.array(*bad), lambda x: x["reason"].isNotNull()) if bad else none, F.coalesce(beyond, none))
    stored = stage(raw.select(*typed, "__file", "__row", found.alias("__rejects"), F.greatest(F.col("__length") - len(header), F.lit(0)).alias("__beyond")))
    rejects = stored.select(F.col("__file").alias("file"), F.col("__row").alias("row"), F.explode("__rejects").alias("x")).select("file", "row", "x.*")
    n, extra, rejected = stored.agg(F.count(F.lit(1)), F.sum("__beyond"), F.sum(F.size("__rejects"))).first()
    given, rejected = n * len(known) + (extra or 0), rejected or 0
    if rejected > most_rejected * given:
        worst = rejects.groupBy("column", "reason").count().orderBy(F.desc("count"), "column", "reason").limit(10).collect()
        told = "; ".join(f"{r['column']}: {r['count']} x {r['reason']}" for r in worst)
        raise ValueError(f"{rejected} of {given} cells of {path} can't be read ({told})")
    kept = [c for c in stored.columns if not c.startswith("__")]
    rows = stored.select(*[F.col(f"`{c}`") for c in kept], *([F.col("__row").alias(row_name)] if row_name else []))
    return CheckedRead(rows, rejects, given, rejected)


def _reason(field: T.StructField):
    """Why a cell is not of its type; null if it is, or is missing."""
    cell = F.when(~F.trim(F.col(field.name)).isin(MISSING_TOKENS), F.trim(F.col(field.name)))
    if isinstance(field.dataType, T.StringType):
        return F.lit(None).cast("string")
    number = cell.try_cast("double")
    wrong = F.when(cell.isNull(), None).when(number.isNull(), "not a number")
    if isinstance(field.dataType, T.IntegralType):
        wrong = wrong.when(cell.try_cast("decimal(38,10)").isNotNull() & (number != F.floor(number)), "a fraction in an integer column")
        wrong = wrong.when(_typed(field).isNull(), "out of range")
    return wrong.cast("string")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """Store a table clustered by a join key, so that later joins and aggregations on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: the application's checkpoint directory.

    That is what the application set itself, else what `spark.checkpoint.dir` names.  Where neither
    is set, a folder in the warehouse is used, which is shared like the tables in it.  A warehouse on
    one machine's disk serves only where all tasks run there; on several machines it is an error.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if is_local_path(spark.conf.get("spark.sql.warehouse.dir")) and not runs_on_one_machine(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_stages"
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def is_local_path(path: str) -> bool:
    return path.startswith("file:") or "://" not in path


def runs_on_one_machine(master: str) -> bool:
    return re.fullmatch(r"local(\[.*\])?", master) is not None


_staged: list[tuple[SparkSession, str]] = []


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name in the shared folder; it is removed when the program ends, or by `release`."""
    path = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


TASK_ROWS = 20_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """Store rows in files of similar size, dealt by a key that identifies them: one per core, of TASK_ROWS rows at most.

    Used before rows become wide: a small file is read by few tasks, which would then do all that
    follows.  Stored, as filters on the wide columns would move below a shuffle.
    """
    files = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return stage(df.repartition(files, key))


def stage(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Used before iterative work: the result is read many times and must not be recomputed, nor be
    lost with an executor.  The folder is removed when the program ends, or by `release`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def release() -> None:
    """Remove the staged folders; frames read from them are of no use afterwards."""
    while _staged:
        spark, path = _staged.pop()
        context = spark.sparkContext
        if context._jsc is None:  # stopped
            continue
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
