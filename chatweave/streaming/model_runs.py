"""Model runs that go on where a lost job stopped.

The work list is written once, in small files. A stream takes some of them at a time, runs the model
and commits what it said, so a job that is started again repeats at most the batch it was in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatweave.operators.model import MakeModel, apply_model
from chatweave.plans.session import folder_names

ITEMS_PER_FILE = 64
FILES_PER_BATCH = 64


def apply_model_resumably(
    items: DataFrame,
    make_model: MakeModel,
    keys: Sequence[str],
    folder: str,
    quality_retry: bool = False,
    tasks: int | None = None,
    supports_retry: bool = False,
    items_per_file: int = ITEMS_PER_FILE,
    files_per_batch: int = FILES_PER_BATCH,
) -> DataFrame:
    """What ``apply_model`` gives (with its seconds), kept in ``folder``, which belongs to this one run.

    The work list of the first start counts; ``items`` of a later start are not looked at. A batch is
    ``files_per_batch`` files of about ``items_per_file`` items. After the last batch nothing is left to do: another start calls no model.
    """
    spark, folder = items.sparkSession, folder.rstrip("/")
    work = f"{folder}/work"
    if "_SUCCESS" not in folder_names(spark, work):
        n = items.count()
        spread = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
        items.repartition(max(1, -(-n // items_per_file)), spread).write.mode("overwrite").parquet(work)
    stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", files_per_batch).parquet(work)
    said = apply_model(stream, make_model, keys, quality_retry, tasks, supports_retry, timed=True)
    query = (
        said.writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{folder}/said")
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()
    if "_spark_metadata" not in folder_names(spark, f"{folder}/said"):  # no item, no batch
        return spark.createDataFrame([], said.schema)
    return spark.read.schema(said.schema).parquet(f"{folder}/said")
