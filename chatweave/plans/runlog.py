"""The log of a job, written while it runs: start, stages with their times, events, counters and end.

Counters are observed: Spark counts the rows of an event table in the same pass that writes it, so
nothing is read a second time. A job that fails keeps its log open (``operators.runs.open_runs``).
"""

from __future__ import annotations

import datetime
import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chatweave.functions import fixed_values as fv
from chatweave.operators.blocks import ranked
from chatweave.operators.runs import stamp


def observed(df: DataFrame, **measures: Column) -> tuple[DataFrame, Observation]:
    """``df`` and what the next action on it will have measured: read it with ``measured``."""
    observation = Observation(f"chatweave-{uuid.uuid4().hex}")
    return df.observe(observation, *[c.alias(name) for name, c in measures.items()]), observation


def measured(observation: Observation) -> dict[str, float | int]:
    """Values of an observation whose action has ended; sums over no rows are 0."""
    return {name: value or 0 for name, value in observation.get.items()}


class RunLog:
    """Appends the events of one run to the log in ``folder`` and keeps its counters and seconds.

    Use it as a context: it logs ``run_start`` at once and, if no exception passes,
    ``stage_timing_summary`` and ``run_end`` at the end. ``counters`` and ``seconds`` start with every
    fixed name at 0. Rows of one ``append`` are numbered by what they say, so a repeated task gives
    the same numbers.
    """

    def __init__(self, spark: SparkSession, folder: str, run_id: str, **settings: object) -> None:
        self.spark, self.folder, self.run_id = spark, folder.rstrip("/"), run_id
        self.counters: dict[str, int] = {name: 0 for name in (*fv.COUNTER_EVENTS, fv.RETRY_ATTEMPTED)}
        self.seconds: dict[str, float] = {name: 0.0 for name in fv.TIMING_KEYS}
        self._settings = settings
        self._waiting: list[dict] = []
        self._next = 0
        self._appended: list[DataFrame] = []
        self._started = 0.0

    def __enter__(self) -> RunLog:
        self._started = time.perf_counter()
        self.event("run_start", **self._settings)
        self.flush()
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, _trace: object) -> None:
        if kind is not None:
            self.event("worker_exception", error=f"{kind.__name__}: {str(error)[:1000]}")
            self.flush()
            return
        self.total()
        self.event("stage_timing_summary", timings_seconds=self.timings())
        self.event("run_end", elapsed_seconds=self.seconds[fv.TOTAL_SECONDS], stats=self.stats())
        self.flush()

    def total(self) -> None:
        """Takes the seconds since the start as the total, for a report written before the end."""
        self.seconds[fv.TOTAL_SECONDS] = time.perf_counter() - self._started

    def chat_counters(self) -> DataFrame:
        """(chat_id, every counter) of the events appended by this run, from the stored rows."""
        counts = [F.count_if(F.col("type") == kind).alias(name) for name, kind in fv.COUNTER_EVENTS.items()]
        said = self.spark.createDataFrame([], "chat_id string, type string")
        for rows in self._appended:
            said = said.unionByName(rows)
        retries = F.col("audio_transcript_retry_succeeded") + F.col("audio_transcript_retry_failed")
        return said.groupBy("chat_id").agg(*counts).withColumn(fv.RETRY_ATTEMPTED, retries)

    def timings(self) -> dict[str, float]:
        return {name: round(s, 3) for name, s in self.seconds.items()}

    def stats(self) -> dict[str, float | int]:
        return {**self.counters, **self.timings()}

    def event(self, kind: str, **details: object) -> None:
        """One event of the job itself; it is written with the next ``flush`` or ``append``."""
        now = datetime.datetime.now(datetime.UTC).isoformat()
        self._waiting.append({"run_id": self.run_id, "seq": self._next, "type": kind, "event_ts": now, **details})
        self._next += 1

    def flush(self) -> None:
        if self._waiting:
            lines = [(json.dumps(e, ensure_ascii=False, default=str),) for e in self._waiting]
            self.spark.createDataFrame(lines, "value string").coalesce(1).write.mode("append").text(self.folder)
            self._waiting.clear()

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        """Times a stage, logs ``stage_timing`` and adds to the seconds that belong to it."""
        started = time.perf_counter()
        yield
        elapsed = time.perf_counter() - started
        if name in fv.STAGE_SECONDS:
            self.seconds[fv.STAGE_SECONDS[name]] += elapsed
        self.event("stage_timing", stage=name, elapsed_seconds=elapsed)
        self.flush()

    def add_seconds(self, name: str, seconds: float) -> None:
        self.seconds[name] += seconds

    def append(self, events: DataFrame) -> None:
        """Writes ``events`` (type, any more columns; best a stored table) with their run and number, counting them meanwhile."""
        self.flush()
        if "chat_id" in events.columns:
            self._appended.append(events.select(F.col("chat_id").cast("string").alias("chat_id"), "type"))
        said = F.to_json(F.struct(*[F.col(c) for c in events.columns]))
        numbered = ranked(events.withColumn("_said", said), [], "_said", "_place").drop("_said")
        rows = stamp(
            numbered.select(
                F.lit(self.run_id).alias("run_id"), (F.col("_place") - 1 + self._next).alias("seq"), *[F.col(c) for c in events.columns]
            )
        )
        counts = {name: F.count_if(F.col("type") == kind) for name, kind in fv.COUNTER_EVENTS.items()}
        rows, observation = observed(rows, rows=F.count(F.lit(1)), **counts)
        rows.write.mode("append").json(self.folder)
        found = measured(observation)
        self._next += found.pop("rows")
        for name, n in found.items():
            self.counters[name] += n
        self.counters[fv.RETRY_ATTEMPTED] = (
            self.counters["audio_transcript_retry_succeeded"] + self.counters["audio_transcript_retry_failed"]
        )
