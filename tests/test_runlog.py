from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from chatweave.functions import fixed_values as fv
from chatweave.operators import runs
from chatweave.plans.jobs import JobOptions, MediaInputs, artifact_table, run_job, upsert_artifacts
from chatweave.plans.runlog import RunLog, measured, observed
from chatweave.plans.session import folder_names
from chatweave.sources.changes import ChangeTable
from chatweave.sources.chatfiles import chat_index, read_chat_files
from chatweave.sources.manifest import read_events

GOOD = "A calm text of more than eight words, and every one of them is new here."
LOOP = "ora et labora " * 60


def said(folder) -> list[dict]:
    lines = []
    for name in os.listdir(folder):
        if name.startswith("part-"):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                lines += [json.loads(x) for x in f]
    return sorted(lines, key=lambda e: e["seq"])


@pytest.fixture
def exports(tmp_path):
    for chat, names in {"north": ["a.jpg", "b.jpg", "gone.jpg", "x.opus"], "south": ["c.jpg", "y.opus", "z.opus"]}.items():
        os.makedirs(tmp_path / "in" / chat)
        lines = [f"[17/04/2024, 10:{i:02d}:07] Mara: <attached: {n}>" for i, n in enumerate(names)] + ["[31/02/2024, 10:00] Bo: no such day"]
        (tmp_path / "in" / chat / "_chat.txt").write_text("preamble\n" + "\n".join(lines), encoding="utf-8")
    return tmp_path


def job(spark, root, run_id, batch, calls, resume=True):
    names = [("north", "a.jpg"), ("north", "b.jpg"), ("north", "x.opus"), ("south", "c.jpg"), ("south", "y.opus"), ("south", "z.opus")]
    listing = spark.createDataFrame([(*n, 10 * i) for i, n in enumerate(names)], "chat_id string, file string, size_bytes long")
    converted = spark.createDataFrame([], "chat_id string, stem string, ext string, rel_path string")
    good, loop, path = GOOD, LOOP, str(calls)

    def note(what):
        with open(os.path.join(path, "calls"), "a", encoding="utf-8") as f:
            f.write(what + "\n")

    def speech():
        def run(row, quality_retry=False):
            note(row["file"])
            if row["file"] == "z.opus":
                raise ValueError("silence")
            return good if quality_retry or row["file"] == "x.opus" else loop

        return run

    def ocr():
        def run(row):
            note(row["file"])
            return f"words of {row['file']}"

        return run

    inputs = MediaInputs(listing, converted, None, speech, ocr, ocr_cap=1, tasks=2, resume=resume)
    return run_job(spark, str(root / "in"), str(root / "out"), run_id, batch, JobOptions(tz_offset="+00:00"), inputs)


def test_run_job_logs_itself(spark, exports):
    log = job(spark, exports, "r1", 1, exports)
    events = said(exports / "out" / "manifest")
    kinds = [e["type"] for e in events]
    assert kinds[0] == "run_start" and kinds[-2:] == ["stage_timing_summary", "run_end"]
    assert [e["seq"] for e in events] == list(range(len(events))) and {e["run_id"] for e in events} == {"r1"}
    assert all(e["event_ts"] for e in events)
    assert {"messages_parsed", "media_preprocess_done", "md_written", "audio_transcript_retry_start", "audio_transcript_retry_done"} <= set(kinds)
    assert [e["stage"] for e in events if e["type"] == "stage_timing"] == ["parse_messages", "output_write"]
    assert next(e for e in events if e["type"] == "messages_parsed")["unreadable_dates"] == 2
    assert {(e["file"], e["meta"]["size_bytes"]) for e in events if e["type"] == "media_meta"} == {("a.jpg", 0), ("c.jpg", 30)}

    timings = next(e for e in events if e["type"] == "stage_timing_summary")["timings_seconds"]
    assert tuple(timings) == fv.TIMING_KEYS and len(timings) == 11
    for key in ("stage_parse_seconds", "stage_media_preprocess_seconds", "stage_output_write_seconds"):
        assert 0 < timings[key] < timings["stage_total_seconds"]
    assert log.seconds["audio_transcribe_seconds"] > 0 and log.seconds["audio_transcript_retry_seconds"] > 0 and log.seconds["image_ocr_seconds"] > 0

    stats = events[-1]["stats"]
    want = dict.fromkeys((*fv.COUNTER_EVENTS, fv.RETRY_ATTEMPTED), 0) | {
        "missing_files": 1, "audio_transcripts_created": 2, "audio_transcripts_failed": 1, "audio_transcript_quality_flagged": 1,
        "audio_transcript_retry_attempted": 1, "audio_transcript_retry_succeeded": 1, "image_ocr_created": 2, "image_ocr_deferred": 1,
    }
    assert len(want) == 20 and {k: stats[k] for k in want} == want and log.counters == want
    (row,) = runs.run_counters(read_events(spark, str(exports / "out" / "manifest"))).collect()
    assert {k: row[k] for k in want} == want
    assert runs.open_runs(read_events(spark, str(exports / "out" / "manifest"))).count() == 0

    # Every item is read by a model once, and once more where it is retried: nothing is computed twice.
    calls = (exports / "calls").read_text().split()
    assert sorted(calls) == ["a.jpg", "c.jpg", "x.opus", "y.opus", "y.opus", "z.opus"]


def test_reports_hold_the_run(spark, exports):
    job(spark, exports, "r1", 1, exports)
    texts: dict[str, list[str]] = {}
    for r in read_chat_files(chat_index(spark, str(exports / "out" / "report"))).orderBy("path", "line_no").collect():
        texts.setdefault(r.chat_id, []).append(r.line)
    assert "- Workers: `{'audio_workers': 2, 'ocr_workers': 2}`" in texts["north"]
    assert {"- n_messages: 5", "- missing_files: 1", "- image_ocr_created: 1", "- image_ocr_deferred: 1"} <= set(texts["north"])
    assert {"- n_messages: 4", "- missing_files: 0", "- audio_transcript_retry_attempted: 1"} <= set(texts["south"])
    summary = [x.split(":")[0][2:] for x in texts["south"][texts["south"].index("## Summary") + 2 :]]
    assert summary == sorted(summary) and len(summary) == 1 + 20 + 11


def test_second_run_writes_only_its_own(spark, exports):
    job(spark, exports, "r1", 1, exports)
    log = job(spark, exports, "r2", 2, exports)
    assert log.counters["image_ocr_created"] == 1 and log.counters["image_ocr_skipped"] == 2
    assert log.counters["audio_transcripts_skipped"] == 2 and log.counters["audio_transcripts_failed"] == 1
    events = said(exports / "out" / "manifest")
    assert {e["run_id"] for e in events} == {"r1", "r2"}
    new = spark.read.parquet(str(exports / "out" / "artifacts" / "change=000000000002"))
    assert [r.rel_path.split("__")[0] for r in new.collect()] == ["ocr/b"]
    assert artifact_table(spark, str(exports / "out")).read().count() == 5
    assert sum(r.n for r in spark.read.json(str(exports / "out" / "by-month")).groupBy("batch").agg(F.count("*").alias("n")).collect()) == 9


def test_failed_run_stays_open(spark, tmp_path):
    with pytest.raises(ValueError), RunLog(spark, str(tmp_path), "bad", out="x"):
        raise ValueError("disk gone")
    events = said(tmp_path)
    assert [e["type"] for e in events] == ["run_start", "worker_exception"] and "disk gone" in events[1]["error"]
    closing = runs.closing_events(read_events(spark, str(tmp_path)), "killed").collect()
    assert [(r.seq, r.type) for r in closing] == [(2, "run_stopped"), (3, "run_end")]


def test_observed_counts_need_no_pass_of_their_own(spark, tmp_path):
    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passes.add(len(batch))
            yield batch

    events = spark.range(100).select(F.when(F.col("id") % 4 == 0, "missing_file").otherwise("image_ocr_created").alias("type"), F.lit("c").alias("chat_id"))
    with RunLog(spark, str(tmp_path), "r") as log:
        rows, watch = observed(events.mapInPandas(counted, events.schema), n=F.count(F.lit(1)), none=F.sum(F.lit(None).cast("long")))
        rows.write.mode("overwrite").parquet(str(tmp_path / "kept"))
        assert measured(watch) == {"n": 100, "none": 0} and passes.value == 100
        log.append(spark.read.parquet(str(tmp_path / "kept")))
        log.append(events.limit(0))
    assert log.counters["missing_files"] == 25 and log.counters["image_ocr_created"] == 75
    assert [e["seq"] for e in said(tmp_path)] == list(range(103))


def sizes(folder) -> dict[str, int]:
    return {d: sum(os.path.getsize(os.path.join(p, n)) for p, _, ns in os.walk(os.path.join(folder, d)) for n in ns) for d in os.listdir(folder)}


def test_change_table(spark, tmp_path):
    table = ChangeTable(spark, str(tmp_path / "t"), "k string, part int", "text string", buckets=4)
    assert not table.exists() and table.read().count() == 0
    table.append(spark.createDataFrame([(f"k{i}", 0, "old" * 200 + str(i)) for i in range(400)], "k string, part int, text string"), 1)
    for version in (2, 3):
        table.append(spark.createDataFrame([("k7", 0, f"new {version}"), (None, None, None)], "k string, part int, text string"), version)
        table.append(spark.createDataFrame([("k7", 0, f"new {version}"), (None, None, None)], "k string, part int, text string"), version)
    bytes_of = sizes(tmp_path / "t")
    assert bytes_of["change=000000000002"] < bytes_of["change=000000000001"] / 3
    assert {(r.k, r.text) for r in table.read(below=3).where("k = 'k7' OR k IS NULL").collect()} == {("k7", "new 2"), (None, None)}
    before = {tuple(r) for r in table.read().collect()}
    assert len(before) == 401 and ("k7", 0, "new 3") in before
    table.compact(3, buckets=[0])
    assert {tuple(r) for r in table.read().collect()} == before
    for change in (1, 2, 3):
        assert "bucket=0" not in folder_names(spark, str(tmp_path / "t" / f"change={change:012d}"))
    table.compact(2)
    assert {tuple(r) for r in table.read().collect()} == before and {tuple(r) for r in table.read(below=3).collect()} != before
    table.compact(3)
    assert {tuple(r) for r in table.read().collect()} == before
    assert len([n for n in folder_names(spark, str(tmp_path / "t")) if n.startswith("change=")]) == 1


def test_artifact_versions(spark, tmp_path):
    schema = "chat_id string, kind string, stem string, rel_path string, text string"
    upsert_artifacts(spark.createDataFrame([("c", "ocr", "a", "ocr/a.txt", "1"), ("c", "ocr", "a", "ocr/a.txt", "0")], schema), str(tmp_path), 1)
    got = upsert_artifacts(spark.createDataFrame([], schema), str(tmp_path), 2)
    assert [r.text for r in got.collect()] == ["1"]
