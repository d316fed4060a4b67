"""Keyed tables kept as appended changes: a version writes only its own rows, the newest row of a key wins.

    folder/change=<version>/bucket=<hash of the key>/part-*.parquet

A version that is written again replaces itself. ``compact`` merges the changes of a bucket into one
and then deletes what it merged; rows keep their version, so a reader that still sees both, or a
compaction that was cut off, gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatweave.plans.session import delete_folder, folder_names

BUCKETS = 16
#: Changes kept beside one another before ``compact_if_long`` merges them.
LONGEST_HISTORY = 32


class ChangeTable:
    """``columns`` is the schema text of the rows without ``keys``; ``keys`` that of the key columns."""

    def __init__(self, spark: SparkSession, folder: str, keys: str, columns: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self._schema = f"{keys}, {columns}, version bigint, change string, bucket int"
        self.keys, self.columns = _names(keys), _names(columns)

    def exists(self) -> bool:
        return bool(self._changes())

    def append(self, rows: DataFrame, version: int) -> None:
        """Adds ``rows`` as ``version``; of several rows of a key the greatest is taken. Other columns are left out."""
        newest = rows.groupBy(*self.keys).agg(F.max(F.struct(*self.columns)).alias("_row")).select(*self.keys, "_row.*")
        self._write(newest.withColumn("version", F.lit(version).cast("long")), f"{version:012d}")

    def read(self, below: int | None = None) -> DataFrame:
        """The newest row of each key, of the versions less than ``below`` (None: all)."""
        rows = self._rows()
        if below is not None:
            rows = rows.where(F.col("version") < below)
        return self._newest(rows).select(*self.keys, *self.columns)

    def compact(self, upto: int, buckets: Sequence[int] | None = None) -> None:
        """Merges the changes up to version ``upto`` in the given buckets (None: all), bucket by bucket in parallel."""
        merged = [name for name in self._changes() if int(name[:12]) <= upto]
        if len(merged) < 2:
            return
        rows = self._rows().where(F.col("change").isin(merged))
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(list(buckets)))
        target = f"{upto:012d}c"
        while target in merged:
            target += "c"
        self._write(self._newest(rows), target)
        for name in merged:
            if buckets is None:
                delete_folder(self.spark, f"{self.folder}/change={name}")
            else:
                for bucket in buckets:
                    delete_folder(self.spark, f"{self.folder}/change={name}/bucket={bucket}")

    def compact_if_long(self, upto: int) -> None:
        if len(self._changes()) > LONGEST_HISTORY:
            self.compact(upto)

    def _changes(self) -> list[str]:
        names = folder_names(self.spark, self.folder)
        return sorted(n.removeprefix("change=") for n in names if n.startswith("change="))

    def _rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(self._schema).parquet(self.folder)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], self._schema)
            raise

    def _newest(self, rows: DataFrame) -> DataFrame:
        last = F.max_by(F.struct(*self.columns, "version"), "version").alias("_row")
        return rows.groupBy(*self.keys).agg(last).select(*self.keys, "_row.*")

    def _write(self, rows: DataFrame, change: str) -> None:
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        (
            rows.withColumn("bucket", bucket).repartition("bucket")
            .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/change={change}")
        )


def _names(columns: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in columns.split(",")]
