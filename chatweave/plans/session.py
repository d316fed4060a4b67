"""Session settings for local runs (tests, bench) and the checkpoint folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "chatweave") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: what the session has or names, else a new one on a local master.

    On a cluster the folder must be shared, so without ``spark.checkpoint.dir`` this fails
    instead of using a folder of one machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if sc.master.split("[")[0] != "local":  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="chatweave-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def store(df: DataFrame) -> DataFrame:
    """Write a table to the checkpoint folder and read it back.

    For results that several later steps read: they are computed once, survive the loss of
    executors, keep column pruning, and their real size is known when joins are planned.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/chatweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._chatweave_path = path
    return stored


def release(df: DataFrame) -> None:
    """Delete the files of a table that ``store`` wrote, once no later step reads it."""
    path = getattr(df, "_chatweave_path", None)
    if path:
        delete_folder(df.sparkSession, path)


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder with all in it, in whatever store it is; none is no error."""
    system, target = _hadoop(spark, path)
    system.delete(target, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder; none if there is no such folder."""
    system, target = _hadoop(spark, path)
    return [f.getPath().getName() for f in system.listStatus(target)] if system.exists(target) else []


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per session (what ``--py-files`` does for a job)."""
    sc = spark.sparkContext
    if getattr(sc, "_chatweave_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = shutil.make_archive(
        f"{tempfile.mkdtemp(prefix='chatweave-package-')}/chatweave", "zip", package.parent, package.name
    )
    sc.addPyFile(archive)
    sc._chatweave_shipped = True
