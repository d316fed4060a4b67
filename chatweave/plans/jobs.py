"""Whole jobs: exports in, enriched messages and published datasets out."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatweave.functions import fixed_values as fv
from chatweave.functions.times import resolve_offset
from chatweave.operators import media, model
from chatweave.operators.enrich import enrich_messages
from chatweave.operators.parse import parse_messages
from chatweave.operators.parts import json_rows, markdown_rows, parse_parts
from chatweave.operators.report import chat_summary, participants, report_rows
from chatweave.functions.naming import artifact_stem
from chatweave.plans.runlog import RunLog, measured, observed
from chatweave.plans.session import store
from chatweave.sources.changes import ChangeTable
from chatweave.sources.chatfiles import write_chat_files
from chatweave.sources.chats import read_chat_lines
from chatweave.streaming.incremental import append_months

JSON_COLUMNS = ("ts", "sender", "type", "text", "media", "enrichment", "source_line", "sender_id")


@dataclass(frozen=True)
class JobOptions:
    tz_offset: str = "auto"
    style: str = "auto"
    date_order: str = "auto"
    mode: str = "PERMISSIVE"
    me: list[str] = field(default_factory=list)
    them: list[str] = field(default_factory=list)
    markdown_chars: int = fv.MARKDOWN_CLIP_CHARS
    #: First lines of a chat that decide its style and date order; None: all lines.
    sample_lines: int | None = fv.DETECTION_SAMPLE_LINES
    #: (chat_id, style, date_order) of chats that differ from the two settings above.
    overrides: DataFrame | None = None


def read_messages(spark: SparkSession, folder: str, options: JobOptions = JobOptions()) -> DataFrame:
    """Messages of every export below ``folder``."""
    return parse_messages(
        read_chat_lines(spark, folder),
        tz_offset=options.tz_offset,
        style=options.style,
        date_order=options.date_order,
        me=options.me,
        them=options.them,
        mode=options.mode,
        sample_lines=options.sample_lines,
        overrides=options.overrides,
    )


def write_conversations(messages: DataFrame, folder: str) -> None:
    """JSON lines, replaced as a whole; nulls are kept. Read in file order, rows are in chat order.

    Range partitioning by (chat, message) also splits a chat that is too large for one file.
    """
    (
        messages.select("chat_id", "msg_idx", *JSON_COLUMNS)
        .repartitionByRange("chat_id", "msg_idx")
        .sortWithinPartitions("chat_id", "msg_idx")
        .write.mode("overwrite")
        .option("ignoreNullFields", "false")
        .json(folder)
    )


def write_transcripts(messages: DataFrame, folder: str, max_chars: int = fv.MARKDOWN_CLIP_CHARS) -> None:
    """Markdown of many chats in each file, with an index (``sources.chatfiles``). Takes messages or their parts."""
    write_chat_files(markdown_rows(messages, max_chars), folder, "markdown")


def write_conversation_parts(parts: DataFrame, folder: str) -> None:
    """JSON lines as ``write_conversations`` writes them, from parts: messages of any length, in files with an index."""
    write_chat_files(json_rows(parts), folder, "json")


def publish_parts(spark: SparkSession, folder: str, out_dir: str, options: JobOptions = JobOptions()) -> DataFrame:
    """Parses the exports below ``folder`` and writes their JSON and Markdown without putting any message together.

    Returns the stored parts. For exports whose messages may not fit into a row; media work and
    monthly output take whole messages.
    """
    out_dir = out_dir.rstrip("/")
    parts = parse_parts(
        read_chat_lines(spark, folder), tz_offset=options.tz_offset, style=options.style, date_order=options.date_order,
        me=options.me, them=options.them, sample_lines=options.sample_lines, overrides=options.overrides,
    )
    parts.write.mode("overwrite").parquet(f"{out_dir}/message-parts")
    stored = spark.read.schema(parts.schema).parquet(f"{out_dir}/message-parts")
    write_conversation_parts(stored, f"{out_dir}/conversation")
    write_transcripts(stored, f"{out_dir}/transcript", options.markdown_chars)
    return stored


def write_reports(rows: DataFrame, folder: str) -> None:
    """Reports (``operators.report.report_rows``) of many chats in each file, with an index, replaced as a whole."""
    write_chat_files(rows, folder, "plain")


def publish(
    messages: DataFrame, out_dir: str, batch: int, options: JobOptions = JobOptions(), log: RunLog | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Write all outputs; returns (report per chat, missing-marker events or None).

    The messages are stored first, and every output is made from the stored rows, so parsing and
    enrichment run once. With a ``log`` the reports are left to ``write_run_reports``.
    """
    out_dir = out_dir.rstrip("/")
    stored_at = f"{out_dir}/messages"
    messages.write.mode("overwrite").parquet(stored_at)
    stored = messages.sparkSession.read.schema(messages.schema).parquet(stored_at)
    write_conversations(stored, f"{out_dir}/conversation")
    write_transcripts(stored, f"{out_dir}/transcript", options.markdown_chars)
    if log is not None:
        log.event("md_written", out="transcript")
    events = append_months(stored, out_dir, batch, options.markdown_chars)
    report = chat_summary(stored)
    if log is None:
        rows = report_rows(report, participants(stored), counters=["n_messages"], **_report_header(options, out_dir))
        write_reports(rows, f"{out_dir}/report")
    return report, events


def _report_header(options: JobOptions, out_dir: str, resume: bool = True) -> dict:
    return {
        "chat_file": F.col("chat_id"),
        "export_folder": F.col("chat_id"),
        "out_dir": out_dir,
        "resume": resume,
        "tz": resolve_offset(options.tz_offset),
        "outputs": {n: f"{out_dir}/{n}" for n in ("messages", "conversation", "transcript", "by-month")},
        "me": options.me,
        "them": options.them,
    }


def write_run_reports(report: DataFrame, log: RunLog, out_dir: str, options: JobOptions, workers: int, resume: bool = True) -> None:
    """Reports with the counters of each chat and the seconds of the run, from what the log has counted."""
    names = list(log.counters)
    counted = report.join(log.chat_counters(), "chat_id", "left")
    counted = counted.withColumns({n: F.coalesce(n, F.lit(0)) for n in names})
    counted = counted.withColumns({n: F.lit(f"{s:.3f}") for n, s in log.seconds.items()})
    header = _report_header(options, out_dir, resume)
    header["outputs"]["manifest"] = log.folder
    people = participants(report.sparkSession.read.parquet(f"{out_dir}/messages"))
    rows = report_rows(
        counted, people, counters=["n_messages", *names, *log.seconds], workers={"audio_workers": workers, "ocr_workers": workers}, **header
    )
    write_reports(rows, f"{out_dir}/report")


def artifact_table(spark: SparkSession, out_dir: str) -> ChangeTable:
    """Artifacts of all versions, one row per (chat, kind, stem)."""
    return ChangeTable(
        spark, f"{out_dir.rstrip('/')}/artifacts", "chat_id string, kind string, stem string", "rel_path string, text string"
    )


def upsert_artifacts(artifacts: DataFrame, out_dir: str, version: int) -> DataFrame:
    """Store new artifacts (chat_id, kind, stem, rel_path, text) over those of earlier versions.

    Only the new rows are written. Rows are replaced by the stem they were found under, one row per
    (chat, kind, stem); a version written again replaces itself.
    """
    table = artifact_table(artifacts.sparkSession, out_dir)
    table.append(artifacts, version)
    table.compact_if_long(version - 1)
    return table.read()


ARTIFACT_SCHEMA = "chat_id string, kind string, stem string, rel_path string, text string"


def media_job(
    messages: DataFrame,
    listing: DataFrame,
    converted: DataFrame,
    out_dir: str,
    version: int,
    speech: model.MakeModel | None = None,
    ocr: model.MakeModel | None = None,
    edge_hists: DataFrame | None = None,
    ocr_cap: int = 0,
    resume: bool = True,
    tasks: int | None = None,
    log: RunLog | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Plan the media work of ``messages``, run the models on what is left to do, store the texts, enrich.

    ``listing``: (chat_id, file) there are; ``edge_hists``: (chat_id, file, edge_hist), without which no
    image is filtered. A model left out turns its flow off. Returns (enriched messages, events
    (chat_id, file, type, reason)). A second run with the next ``version`` does only what the first left.
    ``log`` gets these events and ``media_meta`` of the files worked on: of images where ``listing`` has
    ``size_bytes``, of audio too where it has ``sha256``.
    """
    spark = messages.sparkSession
    known = store(artifact_table(spark, out_dir).read(below=version))
    runs = f"{out_dir.rstrip('/')}/model-runs/{version:06d}"  # the same version again goes on with its calls
    options = media.MediaOptions(transcribe=speech is not None, ocr=ocr is not None, resume=resume)
    plan = store(media.media_plan(store(media.work_list(messages)), listing, known, converted, options))
    none = F.lit(None).cast("string").alias("reason")
    keys = ["chat_id", "file"]
    # Transcripts found again are reported by the speech flow, which checks them.
    events = media.plan_events(plan).where("type <> 'audio_transcript_skipped'").select(*keys, "type", none)
    new = spark.createDataFrame([], ARTIFACT_SCHEMA)
    if speech is not None:
        audio = plan.where("kind = 'audio'")
        old = known.where("kind = 'transcript'").select("chat_id", "stem", "text")
        existing = audio.where("text_action = 'recheck'").join(old, ["chat_id", "stem"]).select(*keys, "stem", F.coalesce("text", F.lit("")).alias("text"))
        stem = F.coalesce("stem", artifact_stem(F.col("file"))).alias("stem")
        todo = audio.where("text_action = 'create'").select(*keys, stem)
        made, said = model.transcribe(todo, speech, [*keys, "stem"], existing=existing, tasks=tasks, log=log, folder=f"{runs}/speech")
        path = F.concat(F.lit("transcripts/"), "stem", F.lit(".txt")).alias("rel_path")
        new = new.unionByName(made.select("chat_id", F.lit("transcript").alias("kind"), "stem", path, "text"))
        events = events.unionByName(said.select(*keys, "type", "reason"))
    if ocr is not None:
        images = plan.where("kind = 'image' AND text_action = 'create'").select(*keys)
        if edge_hists is None:
            images = images.withColumn("edge_hist", F.lit(None).cast("array<long>"))
        else:
            images = images.join(edge_hists.select(*keys, "edge_hist"), keys, "left")
        read, said = model.read_images(images, ocr, ocr_cap, tasks=tasks, log=log, folder=f"{runs}/ocr")
        new = new.unionByName(read)
        events = events.unionByName(said)
    if log is not None:
        events = store(events)
        log.append(events)
        _log_media_meta(plan, events, listing, log)
    return enrich_messages(messages, upsert_artifacts(new, out_dir, version), converted), events


def _log_media_meta(plan: DataFrame, events: DataFrame, listing: DataFrame, log: RunLog) -> None:
    """``media_meta`` events of the images that were read and, where contents were hashed, of the audio there is."""
    if "size_bytes" not in listing.columns:
        return
    keys = ["chat_id", "file"]
    sha256 = F.col("sha256") if "sha256" in listing.columns else F.lit(None).cast("string")
    facts = listing.groupBy(*keys).agg(F.max(F.struct(F.col("size_bytes"), sha256.alias("sha256"))).alias("meta"))
    read = events.where("type IN ('image_ocr_created', 'image_ocr_failed')").select(*keys).distinct()
    kinds = {"image": read}
    if "sha256" in listing.columns:
        kinds["audio"] = plan.where("kind = 'audio' AND present").select(*keys)
    for kind, files in kinds.items():
        started = time.perf_counter()
        rows = files.join(facts, keys).select(*keys, F.lit("media_meta").alias("type"), F.lit(kind).alias("kind"), "meta")
        log.append(rows)
        log.add_seconds(f"{kind}_meta_seconds", time.perf_counter() - started)


@dataclass(frozen=True)
class MediaInputs:
    """What the caller brings for the media work of a run."""

    listing: DataFrame
    converted: DataFrame
    edge_hists: DataFrame | None = None
    speech: model.MakeModel | None = None
    ocr: model.MakeModel | None = None
    ocr_cap: int = 0
    tasks: int | None = None
    resume: bool = True


def run_job(
    spark: SparkSession,
    folder: str,
    out_dir: str,
    run_id: str,
    batch: int,
    options: JobOptions = JobOptions(),
    media_inputs: MediaInputs | None = None,
) -> RunLog:
    """A whole run over the exports below ``folder``: parse, media work, outputs, reports, and its log in ``out_dir/manifest``.

    ``batch`` numbers the run (1, 2, ...); it is also the version of the artifacts.
    """
    out_dir = out_dir.rstrip("/")
    resume = media_inputs is None or media_inputs.resume
    workers = (media_inputs and media_inputs.tasks) or spark.sparkContext.defaultParallelism
    settings = {
        "export_folder": folder, "out_dir": out_dir, "resume": resume, "format": options.style, "date_order": options.date_order,
        "audio_workers": workers, "ocr_workers": workers, "tz": resolve_offset(options.tz_offset), "batch": batch,
        "transcribe": bool(media_inputs and media_inputs.speech), "ocr": bool(media_inputs and media_inputs.ocr),
        "ocr_max": media_inputs.ocr_cap if media_inputs else 0,
    }
    with RunLog(spark, f"{out_dir}/manifest", run_id, **settings) as log:
        with log.stage("parse_messages"):
            parsed, counted = observed(
                read_messages(spark, folder, options), messages=F.count(F.lit(1)), unreadable_dates=F.count("_parse_error")
            )
            messages = store(parsed)
        log.event("messages_parsed", **measured(counted))
        if media_inputs is not None:
            started = time.perf_counter()
            m = media_inputs
            messages, _ = media_job(
                messages, m.listing, m.converted, out_dir, batch, m.speech, m.ocr, m.edge_hists, m.ocr_cap, m.resume, m.tasks, log
            )
            elapsed = time.perf_counter() - started
            log.add_seconds("stage_media_preprocess_seconds", elapsed)
            log.event("media_preprocess_done", elapsed_seconds=elapsed)
        with log.stage("output_write"):
            report, missing = publish(messages, out_dir, batch, options, log)
        if missing is not None:
            log.append(missing)
        log.total()
        write_run_reports(report, log, out_dir, options, workers, resume)
    return log
