"""User models (speech, OCR) applied to rows, with one quality retry.

The model is the only plug-in point. ``make_model()`` runs once per task and returns a
function ``(row: dict) -> str`` or ``(row: dict, quality_retry: bool) -> str``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatweave.functions import fixed_values as fv
from chatweave.functions.naming import artifact_stem
from chatweave.functions.text import strip
from chatweave.operators.media import cap_per_chat, likely_text
from chatweave.operators.quality import assess_quality, normalize_text
from chatweave.operators.retry import decide_retry, retry_candidates
from chatweave.plans.runlog import RunLog, measured, observed
from chatweave.plans.session import ship_package, store

MakeModel = Callable[[], Callable[..., str]]

#: Start of the error of rows whose model could not be made.
UNAVAILABLE = "model unavailable: "


def apply_model(
    items: DataFrame,
    make_model: MakeModel,
    keys: Sequence[str],
    quality_retry: bool = False,
    tasks: int | None = None,
    supports_retry: bool = False,
    timed: bool = False,
) -> DataFrame:
    """(keys, text, error): what the model says about each row.

    ``timed`` adds ``seconds`` of the call and, on the first row of a task, ``init_seconds`` of making its model.

    A row on which the model raises gives an ``error`` instead of a text and the job goes on; so do all
    rows of a task that cannot make its model (``UNAVAILABLE``).
    ``tasks`` sets how many model copies run; rows are dealt out evenly, whatever their keys.
    A model that can try harder takes ``quality_retry``; the caller says so by ``supports_retry``.
    """
    keys = list(keys)
    ship_package(items.sparkSession)
    if tasks:
        items = items.repartition(tasks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            init = 0.0
            if model is None:
                started = time.perf_counter()
                model = _started(make_model)
                init = time.perf_counter() - started
                options = {"quality_retry": quality_retry} if supports_retry else {}
            texts, errors, seconds = [], [], []
            for row in batch.to_dict("records"):
                started = time.perf_counter()
                try:
                    texts.append(model(row, **options))
                    errors.append(None)
                except Exception as e:  # one bad item must not end the run
                    texts.append(None)
                    errors.append(str(e))
                seconds.append(time.perf_counter() - started)
            said = batch[keys].assign(text=texts, error=errors)
            if timed:
                said = said.assign(seconds=seconds, init_seconds=[init] * (len(batch) > 0) + [0.0] * (len(batch) - 1))
            yield said

    key_types = ", ".join(f"`{k}` {items.schema[k].dataType.simpleString()}" for k in keys)
    times = ", seconds double, init_seconds double" if timed else ""
    return items.mapInPandas(run, f"{key_types}, text string, error string{times}")


def _said(items: DataFrame, make_model: MakeModel, keys: Sequence[str], log: RunLog | None, kind: str, folder: str | None, **options) -> DataFrame:
    """What models say of ``items``, stored; the seconds they take are observed while it is written.

    With a ``folder`` a lost job goes on where it stopped (``streaming.model_runs``).
    """
    if folder is not None:
        from chatweave.streaming.model_runs import apply_model_resumably  # it imports this module

        said = apply_model_resumably(items, make_model, keys, folder, **options)
    else:
        said = apply_model(items, make_model, keys, timed=True, **options)
    said, observation = observed(said, seconds=F.sum("seconds"), init=F.sum("init_seconds"))
    out = store(said)
    if log is not None:
        took = measured(observation)
        log.add_seconds(kind, took["seconds"])
        if kind != "image_ocr_seconds":
            log.add_seconds("transcriber_init_seconds", took["init"])
    return out


def _started(make_model: MakeModel) -> Callable[..., str]:
    try:
        return make_model()
    except Exception as e:
        reason = f"{UNAVAILABLE}{e}"

    def unavailable(*_, **__):
        raise RuntimeError(reason)

    return unavailable


def transcribe(
    items: DataFrame,
    make_model: MakeModel,
    keys: Sequence[str],
    existing: DataFrame | None = None,
    tasks: int | None = None,
    supports_retry: bool = True,
    log: RunLog | None = None,
    folder: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Run a model over ``items``, check the results, retry the flagged ones once.

    ``existing``: (item columns, text) already there from an earlier run; flagged ones are retried
    as well. Returns ``(artifacts, events)``: artifacts are (keys, text) to write, new or replaced;
    events are (keys, type, reason, issues, token_count). ``log`` gets the start and end of the retries
    and the seconds that the model took. In a ``folder`` of its own a lost run goes on where it stopped.

    Model results are stored before use: a model need not give the same text twice, and a lost
    executor must not make the retry decision differ from the text that is kept.
    """
    keys = list(keys)
    options = {"tasks": tasks, "supports_retry": supports_retry}
    first = _said(items, make_model, keys, log, "audio_transcribe_seconds", folder and f"{folder}/first", **options)
    made = first.where(F.col("error").isNull()).select(*keys, normalize_text(F.col("text")).alias("text"))
    checked = assess_quality(made, normalized=True).withColumn("source", F.lit("new"))
    if existing is not None:
        old = existing.select(*keys, normalize_text(F.col("text")).alias("text"))
        checked = checked.unionByName(assess_quality(old, normalized=True).withColumn("source", F.lit("existing")))
    # The first texts are not needed any more: no sort or shuffle of the candidates carries them.
    found, counted = observed(retry_candidates(checked.drop("text"), keys, "source"), n=F.count(F.lit(1)))
    flagged = store(found)
    n_flagged = measured(counted)["n"]
    if log is not None and n_flagged:
        log.event("audio_transcript_retry_start", count=n_flagged)
    inputs = items if existing is None else items.unionByName(existing.drop("text"))
    again = _said(
        inputs.join(flagged.select(*keys), keys, "left_semi"), make_model, keys, log, "audio_transcript_retry_seconds",
        folder and f"{folder}/again", quality_retry=True, **options,
    )
    retried = assess_quality(again.select(*keys, normalize_text(F.col("text")).alias("retry_text"), "error"), "retry_text", normalized=True)
    if log is not None and n_flagged:
        log.event("audio_transcript_retry_done", count=n_flagged)
    # Stored: events of five kinds read it, and a filter moved down into it would assess the texts again, several times.
    decided = store(
        decide_retry(flagged, retried, keys).select(
            *keys, "replaced", "reason", "still_flagged", "quality", F.when(F.col("replaced"), F.col("retry_text")).alias("retry_text")
        )
    )
    better = decided.where("replaced").select(*keys, F.col("retry_text").alias("text"))
    artifacts = made.join(better, keys, "left_anti").unionByName(better)

    def event(df: DataFrame, kind: str, reason=None, issues=None, tokens=None) -> DataFrame:
        return df.select(
            *keys,
            F.lit(kind).alias("type"),
            (F.lit(None) if reason is None else reason).cast("string").alias("reason"),
            (F.lit(None) if issues is None else issues).cast("array<string>").alias("issues"),
            (F.lit(None) if tokens is None else tokens).cast("int").alias("token_count"),
        )

    after = F.col("quality")
    unavailable = F.coalesce(F.startswith("error", F.lit(UNAVAILABLE)), F.lit(False))
    events = [
        event(made, "audio_transcript_created"),
        event(first.where(F.col("error").isNotNull() & ~unavailable), "audio_transcript_failed", F.col("error")),
        event(first.where(unavailable), "transcriber_unavailable", F.col("error")),
        event(flagged, "audio_transcript_quality_flagged", None, F.col("before_issues"), F.col("before_tokens")),
        event(decided.where("replaced"), "audio_transcript_retried", None, after["issues"], after["metrics"]["token_count"]),
        event(decided.where("not replaced"), "audio_transcript_retry_failed", F.col("reason")),
        event(decided.where("still_flagged"), "audio_transcript_quality_still_flagged", None, after["issues"], after["metrics"]["token_count"]),
    ]
    if existing is not None:
        events.append(event(existing, "audio_transcript_skipped"))
    said = events[0]
    for e in events[1:]:
        said = said.unionByName(e)
    return artifacts, said


def read_images(
    images: DataFrame,
    make_model: MakeModel,
    cap: int = 0,
    mode: str = "likely-text",
    edge_threshold: float = fv.OCR_EDGE_THRESHOLD,
    tasks: int | None = None,
    log: RunLog | None = None,
    folder: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """OCR of ``images`` (chat_id, file, edge_hist, any more columns): those present and without a text.

    Images that the gate keeps count towards the cap of their chat, by name; the model reads the
    first ``cap`` of them. Returns ``(artifacts, events)``: artifacts are (chat_id, kind, stem,
    rel_path, text), events (chat_id, file, type, reason), one per image. In a ``folder`` of its own a lost
    run goes on where it stopped.
    """
    keys = ["chat_id", "file"]
    gated = store(likely_text(images, mode, edge_threshold))
    dealt = store(cap_per_chat(gated.where("keep").drop("keep"), cap))
    said = _said(dealt.where("ocr_action = 'create'").drop("ocr_action"), make_model, keys, log, "image_ocr_seconds", folder, tasks=tasks)
    stem = artifact_stem(F.col("file"))
    artifacts = said.where("error IS NULL").select(
        "chat_id", F.lit("ocr").alias("kind"), stem.alias("stem"), F.concat(F.lit("ocr/"), stem, F.lit(".txt")).alias("rel_path"),
        strip(F.col("text")).alias("text"),
    )
    none = F.lit(None).cast("string").alias("reason")
    outcome = F.when(F.col("error").isNull(), "image_ocr_created").otherwise("image_ocr_failed")
    events = (
        gated.where("NOT keep").select(*keys, F.lit("image_ocr_filtered").alias("type"), none)
        .unionByName(dealt.where("ocr_action = 'deferred'").select(*keys, F.lit("image_ocr_deferred").alias("type"), none))
        .unionByName(said.select(*keys, outcome.alias("type"), F.col("error").alias("reason")))
    )
    return artifacts, events
