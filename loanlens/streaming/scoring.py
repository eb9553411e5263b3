"""Score requests as they arrive in a folder.

Checking and scoring are row-local, so the stream keeps no state.  Each micro-batch is checked
once, then written to two tables; the batch number names the output folder, so a batch that is
retried after a failure replaces its own files instead of adding to them.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loanlens.operators.scoring import check_requests, contract_schema, score, typed_requests


def request_stream(spark: SparkSession, folder: str, ids: T.StructType) -> DataFrame:
    """Parquet requests: identifier columns plus the contract fields."""
    return spark.readStream.schema(T.StructType([*ids.fields, *contract_schema().fields])).parquet(folder)


def score_stream(
    requests: DataFrame, model: PipelineModel, ids: list[str], scores: str, quarantine: str, checkpoint: str,
    drop: list[str] | None = None, available_now: bool = True
) -> StreamingQuery:
    """Start the query; with `available_now` it ends when the present files are done."""

    def write(batch: DataFrame, number: int) -> None:
        checked = check_requests(batch).persist()
        good = typed_requests(checked.filter(F.size("violations") == 0).drop("violations"))
        score(good, model, ids, drop).write.mode("overwrite").parquet(f"{scores}/batch={number}")
        bad = checked.filter(F.size("violations") > 0)
        bad.select(*ids, "violations").write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        checked.unpersist()

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
