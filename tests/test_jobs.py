from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from chatweave.operators import audio, model, report, retry, runs
from chatweave.operators.markdown import bullet, transcript_lines, with_month_headings
from chatweave.operators.parse import parse_messages
from chatweave.operators.quality import assess_quality
from chatweave.plans.jobs import media_job, publish, upsert_artifacts, write_conversations
from chatweave.plans.session import ensure_checkpoint_dir
from chatweave.sources.chatfiles import chat_index, read_chat_files, write_chat_files
from chatweave.streaming.incremental import append_months, month_markdown

GOOD = "This is a good text with more than eight words in it, all of them different."
LOOP = "mud, rain, wind and " * 60


def chat(lines_of, text, **options):
    return parse_messages(lines_of({"c": text}), tz_offset="+00:00", **options)


THREE = "[11/03/2024, 08:15] A: bread\n[12/03/2024, 08:20] B: salt\n[02/04/2024, 19:30] A: plums"


def month_rows(folder):
    out: dict[str, list] = {}
    for d, _, names in os.walk(f"{folder}/by-month"):
        for n in names:
            if n.startswith("part-"):
                with open(os.path.join(d, n), encoding="utf-8") as f:
                    month, batch = (part.split("=")[1] for part in d.split(os.sep)[-2:])
                    out.setdefault(month, []).extend({**json.loads(x), "batch": int(batch)} for x in f)
    return {k: sorted(v, key=lambda r: (r["batch"], r["msg_idx"])) for k, v in out.items()}


def test_append_twice_adds_nothing(lines_of, tmp_path, spark):
    messages = chat(lines_of, THREE)
    assert append_months(messages, str(tmp_path), 1) is None
    events = append_months(messages, str(tmp_path), 2)
    got = month_rows(tmp_path)
    assert {k: len(v) for k, v in got.items()} == {"2024-03": 2, "2024-04": 1}
    assert events.count() == 0
    more = chat(lines_of, THREE + "\n[03/04/2024, 10:00] A: later\n[03/05/2024, 10:00] A: may")
    append_months(more, str(tmp_path), 3)
    got = month_rows(tmp_path)
    assert [r["text"] for r in got["2024-04"]] == ["plums", "later"] and len(got["2024-05"]) == 1
    assert got["2024-03"][0]["enrichment"] is None and "enrichment" in got["2024-03"][0]
    md = [r.md for r in month_markdown(spark, str(tmp_path)).where("month = '2024-04'").orderBy("batch", "msg_idx").collect()]
    assert md == ["# 2024-04\n\n- **2024-04-02 19:30** — **A**: plums", "- **2024-04-03 10:00** — **A**: later"]


def test_lost_marker_appends_the_month_again(lines_of, tmp_path):
    append_months(chat(lines_of, THREE), str(tmp_path), 1)
    edited = chat(lines_of, THREE.replace("salt", "Salt!"))
    events = append_months(edited, str(tmp_path), 2)
    assert [(r.type, r.month) for r in events.collect()] == [("by_month_marker_missing", "2024-03")]
    got = month_rows(tmp_path)
    assert [r["text"] for r in got["2024-03"]] == ["bread", "salt", "bread", "Salt!"]
    assert len(got["2024-04"]) == 1


def test_equal_messages_and_unreadable_dates(lines_of, tmp_path):
    """The last of equal messages is the marker; messages without a date are not repeated either."""
    text = "[05/01/2025, 10:00] A: same\n[05/01/2025, 10:00] A: same\n[30/02/2025, 10:00] A: bad"
    for batch in (1, 2):
        append_months(chat(lines_of, text), str(tmp_path), batch)
    assert {k: len(v) for k, v in month_rows(tmp_path).items()} == {"2025-01": 2, "unknown": 1}


def test_month_headings_repeat(lines_of):
    text = "[05/01/2025, 10:00] A: 1\n[01/02/2025, 10:00] A: 2\n[06/01/2025, 10:00] A: 3\n[07/01/2025, 10:00] A: 4"
    rows = with_month_headings(chat(lines_of, text), block_rows=2).orderBy("msg_idx").collect()
    assert [r.new_month for r in rows] == [True, True, True, False]


def test_markdown(lines_of):
    text = "[05/01/2025, 10:00] Ana:  hi \nthere\n[05/01/2025, 10:01] just so\n[05/01/2025, 10:02] Bo: p.jpg (file attached)\ncaption"
    rows = transcript_lines(chat(lines_of, text, me=["ana"])).orderBy("msg_idx").collect()
    assert [r.md for r in rows] == [
        "# WhatsApp Transcript\n\n\n## 2025-01\n\n- **2025-01-05 10:00** — **ME (Ana)**: hi \nthere",
        "- **2025-01-05 10:01** — *(system)*: just so",
        "- **2025-01-05 10:02** — **Bo**: *image* (p.jpg)",
    ]
    enriched = chat(lines_of, text).where("msg_idx = 2").withColumn(
        "enrichment", F.struct(
            F.lit("o").alias("ocr_text_file"), F.lit("  " + "x" * 50).alias("ocr_text"),
            F.lit("t").alias("transcript_file"), F.lit(" ").alias("transcript_text"),
        ),
    )
    assert enriched.select(bullet(10).alias("md")).first().md.split("\n")[1:] == ["  - OCR: " + "x" * 9 + "…"]


def test_publish(lines_of, tmp_path, spark):
    messages = parse_messages(lines_of({"c": THREE, "d": "noise\n[05/01/2025, 10:00] ç: ã\nb"}), tz_offset="+00:00")
    rows, events = publish(messages, str(tmp_path), batch=1)
    assert {r.chat_id: r.n_messages for r in rows.collect()} == {"c": 3, "d": 1} and events is None
    raw = []
    for n in sorted(os.listdir(tmp_path / "conversation")):
        if n.startswith("part-"):
            with open(tmp_path / "conversation" / n, encoding="utf-8") as f:
                raw += f.read().splitlines()
    first = json.loads(raw[0])
    assert [json.loads(x)["chat_id"] for x in raw] == ["c", "c", "c", "d"]
    assert first["ts"] == "2024-03-11T08:15:00+00:00" and first["media"] == [] and first["enrichment"] is None
    assert '"sender":"ç","type":"text","text":"ã\\nb"' in raw[3]
    found = read_chat_files(chat_index(spark, str(tmp_path / "transcript")).where("chat_id = 'c'")).orderBy("path", "line_no")
    text = "\n".join(r.line for r in found.collect())
    assert text.startswith("# WhatsApp Transcript\n\n\n## 2024-03\n\n- **2024-03-11 08:15** — **A**: bread\n- **2024-03-12")
    assert "\n\n## 2024-04\n\n- " in text
    found = read_chat_files(chat_index(spark, str(tmp_path / "report")).where("chat_id = 'd'")).orderBy("path", "line_no")
    lines = [r.line for r in found.collect()]
    assert "- Participants detected: ç" in lines and "- n_messages: 1" in lines
    write_conversations(spark.read.parquet(str(tmp_path / "messages")).limit(1), str(tmp_path / "conversation"))
    assert spark.read.text(str(tmp_path / "conversation")).count() == 1


def test_upsert_artifacts(spark, tmp_path):
    schema = "chat_id string, kind string, stem string, rel_path string, text string"
    one = spark.createDataFrame([("c", "ocr", "a", "ocr/a.txt", "1"), ("c", "ocr", "b", "ocr/b.txt", "2")], schema)
    two = spark.createDataFrame([("c", "ocr", "b", "ocr/b.txt", "new"), ("c", "transcript", "b", "t/b.txt", "3")], schema)
    upsert_artifacts(one, str(tmp_path), 1)
    got = upsert_artifacts(two, str(tmp_path), 2)
    assert {(r.kind, r.stem, r.text) for r in got.collect()} == {("ocr", "a", "1"), ("ocr", "b", "new"), ("transcript", "b", "3")}


def test_report(lines_of):
    text = "[05/01/2025, 10:00] Zoe: a\n[04/01/2025, 10:00] just so\n[06/01/2025, 10:00] Ana: b\n[30/02/2025, 10:00] Ana: c"
    messages = chat(lines_of, text)
    (r,) = report.chat_report(messages).collect()
    assert (r.n_messages, r.first_ts, r.last_ts, r.participants) == (
        4, "2025-01-04T10:00:00+00:00", "2025-01-06T10:00:00+00:00", ["Ana", "Zoe"],
    )
    assert {(r.sender, r.n_messages) for r in report.participants(messages).collect()} == {("Ana", 2), ("Zoe", 1)}
    assert {r.month: r.n_messages for r in report.months(messages).collect()} == {"2025-01": 3, "unknown": 1}


def test_audio(spark):
    rows = [("a", 1, 16000, 2, 40000), ("b", 2, 16000, 2, 1), ("c", 1, 8000, 2, 1), ("d", 1, 16000, 1, 0)]
    df = spark.createDataFrame(rows, "stem string, channels int, rate int, sampwidth int, nframes bigint")
    assert [r.reject_reason for r in audio.check_audio(df).orderBy("stem").collect()] == [
        None, "not mono", "wrong sample rate", "not 16-bit",
    ]
    plan = audio.chunk_plan(df, chunk_seconds=1).where("stem = 'a'").orderBy("chunk_idx").collect()
    assert [(r.start, r.length) for r in plan] == [(0, 16000), (16000, 16000), (32000, 8000)]
    assert {(r.stem, r.length) for r in audio.chunk_plan(df, chunk_seconds=0).collect()} == {("a", 40000), ("b", 1), ("c", 1)}
    texts = spark.createDataFrame([("a", 10, " z "), ("a", 2, "y"), ("a", 3, " "), ("b", 0, " ")], "stem string, chunk_idx int, text string")
    assert {r.stem: r.text for r in audio.join_chunks(texts, ["stem"]).collect()} == {"a": "y z", "b": ""}


def test_long_lists_are_rows_until_they_are_written(spark, lines_of, tmp_path, capsys):
    """Reports and clips written from rows are those composed in a row; no plan gathers a list."""
    text = "\n".join(f"[05/01/2025, 10:00] Name{i % 50}: a" for i in range(120))
    messages = parse_messages(lines_of({"c": text, "d": "[05/01/2025, 10:00] just so"}), tz_offset="+00:00")
    header = dict(
        chat_file=F.col("chat_id"), export_folder=F.lit("x"), out_dir="o", resume=False, tz="+00:00", outputs={"a": "b"},
        counters=["n_messages"], workers={"audio_workers": 2}, me=["Name1"],
    )
    want = {r.chat_id: r.report for r in report.report_text(report.chat_report(messages), **header).collect()}
    rows = report.report_rows(report.chat_summary(messages), report.participants(messages), **header)
    chunks = spark.createDataFrame([("a", 10, " z "), ("a", 2, "y"), ("a", 3, " "), ("b", 0, " ")], "stem string, chunk_idx int, text string")
    clips = audio.clip_rows(chunks, "stem")
    for df, folder in ((rows, "report"), (clips, "clips")):
        df.explain()
        assert "collect_list" not in capsys.readouterr().out
        write_chat_files(df, str(tmp_path / folder), "plain")
    got: dict[str, list[str]] = {}
    for r in read_chat_files(chat_index(spark, str(tmp_path / "report"))).orderBy("path", "line_no").collect():
        got.setdefault(r.chat_id, []).append(r.line)
    assert {c: "\n".join(x) for c, x in got.items()} == want and ", ".join(sorted({f"Name{i}" for i in range(50)})) in want["c"]
    assert {r.chat_id: r.line for r in read_chat_files(chat_index(spark, str(tmp_path / "clips"))).collect()} == {"a": "y z", "b": ""}


def decide(spark, before, after, error=None):
    first = assess_quality(spark.createDataFrame([("f", 1, before)], "k string, seq int, text string"))
    again = assess_quality(
        spark.createDataFrame([("f", after, error)], "k string, retry_text string, error string"), "retry_text"
    )
    rows = retry.decide_retry(retry.retry_candidates(first, ["k"], "seq"), again, ["k"]).collect()
    return [(r.replaced, r.reason, r.still_flagged) for r in rows]


def test_retry_decisions(spark):
    assert decide(spark, LOOP, GOOD) == [(True, None, False)]
    assert decide(spark, LOOP, "only three words \ufffd\ufffd") == [(False, "quality_improved_but_too_short", True)]
    assert decide(spark, LOOP, LOOP) == [(False, "quality_not_improved", True)]
    assert decide(spark, LOOP, GOOD + " \ufffd") == [(True, None, True)]
    assert decide(spark, LOOP, None, "boom") == [(False, "boom", False)]
    assert decide(spark, GOOD, GOOD) == []


def test_first_candidate_wins(spark):
    rows = [("f", 3, LOOP), ("f", 1, GOOD), ("f", 2, ""), ("g", 1, GOOD)]
    df = assess_quality(spark.createDataFrame(rows, "k string, seq int, text string"))
    got = retry.retry_candidates(df, ["k"], "seq").collect()
    assert [(r.k, r.seq, r.before_issues, r.before_tokens) for r in got] == [("f", 2, ["empty_transcript"], 0)]


def make_model():
    def start():
        def run(row, quality_retry=False):
            if row["name"] == "broken":
                raise ValueError("no sound")
            if quality_retry:
                return good if row["name"].startswith("better") else "three words here \ufffd"
            return loop if row["name"] != "fine" else good

        return run

    # Test modules cannot be imported by workers, so the model holds its texts itself.
    good, loop = GOOD, LOOP
    return start


def test_transcribe(spark):
    items = spark.createDataFrame([("fine",), ("better",), ("short",), ("broken",)], "name string")
    existing = spark.createDataFrame([("better old", LOOP), ("good old", GOOD)], "name string, text string")
    artifacts, events = model.transcribe(items, make_model(), ["name"], existing=existing, tasks=3)
    assert {r.name: r.text[:8] for r in artifacts.collect()} == {
        "fine": GOOD[:8], "better": GOOD[:8], "short": LOOP[:8], "better old": GOOD[:8],
    }
    log = {}
    for r in events.collect():
        log.setdefault(r.type, set()).add((r.name, r.reason))
    assert log == {
        "audio_transcript_created": {("fine", None), ("better", None), ("short", None)},
        "audio_transcript_failed": {("broken", "no sound")},
        "audio_transcript_skipped": {("better old", None), ("good old", None)},
        "audio_transcript_quality_flagged": {("better", None), ("short", None), ("better old", None)},
        "audio_transcript_retried": {("better", None), ("better old", None)},
        "audio_transcript_retry_failed": {("short", "quality_improved_but_too_short")},
        "audio_transcript_quality_still_flagged": {("short", None)},
    }


def test_model_that_cannot_start(spark):
    def broken():
        raise OSError("no weights")

    items = spark.createDataFrame([("a",), ("b",)], "name string")
    made, events = model.transcribe(items, broken, ["name"])
    assert made.count() == 0
    assert {(r.name, r.type, r.reason) for r in events.collect()} == {(n, "transcriber_unavailable", "model unavailable: no weights") for n in "ab"}


def test_media_job_twice(lines_of, spark, tmp_path):
    """The second run does what the first left: the deferred image and the one that failed."""
    names = ["a.jpg", "b.jpg", "c.jpg", "d.jpg", "gone.jpg", "tide.opus"]
    text = "\n".join(f"[17/04/2024, 10:{i:02d}] Mara: <attached: {n}>" for i, n in enumerate(names))
    messages = chat(lines_of, text)
    listing = spark.createDataFrame([("c", n) for n in names if n != "gone.jpg"], "chat_id string, file string")
    converted = spark.createDataFrame([], "chat_id string, stem string, ext string, rel_path string")
    hists = spark.createDataFrame([("c", "b.jpg", [9, 0])], "chat_id string, file string, edge_hist array<bigint>")
    good = GOOD

    def reader(broken):
        def start():
            def run(row):
                if row["file"] == broken:
                    raise ValueError("blurred")
                return f" text of {row['file']}\n"

            return run

        return start

    def speech():
        return lambda row, quality_retry=False: good

    def job(version, broken):
        out, log = media_job(messages, listing, converted, str(tmp_path), version, speech, reader(broken), hists, ocr_cap=2)
        texts = {r.media[0].file: r.enrichment.ocr_text or r.enrichment.transcript_text for r in out.collect() if r.enrichment}
        return texts, {(r.file, r.type, r.reason) for r in log.collect()}

    texts, log = job(1, "a.jpg")
    assert texts == {"c.jpg": "text of c.jpg", "tide.opus": GOOD}
    always = {("gone.jpg", "missing_file", None), ("b.jpg", "image_ocr_filtered", None)}
    assert {e for e in log if not e[1].startswith("audio_wav")} == always | {
        ("a.jpg", "image_ocr_failed", "blurred"), ("c.jpg", "image_ocr_created", None), ("d.jpg", "image_ocr_deferred", None),
        ("tide.opus", "audio_transcript_created", None),
    }
    texts, log = job(2, None)
    assert set(texts) == {"a.jpg", "c.jpg", "d.jpg", "tide.opus"}
    assert {e for e in log if not e[1].startswith("audio_wav")} == always | {
        ("a.jpg", "image_ocr_created", None), ("d.jpg", "image_ocr_created", None), ("c.jpg", "image_ocr_skipped", None),
        ("tide.opus", "audio_transcript_skipped", None),
    }


def test_model_without_retry_argument(spark):
    items = spark.createDataFrame([("a",)], "name string")
    out = model.apply_model(items, lambda: lambda row: row["name"] * 2, ["name"], quality_retry=True)
    assert [tuple(r) for r in out.collect()] == [("a", "aa", None)]


def log(spark, rows):
    return spark.createDataFrame(rows, "run_id string, seq bigint, type string, stage string, elapsed_seconds double")


def test_runs(spark):
    rows = [
        ("a", 0, "run_start", None, None), ("a", 1, "run_end", None, 1.0), ("a", 2, "run_start", None, None),
        ("a", 3, "audio_transcript_retried", None, None), ("a", 4, "audio_transcript_retry_failed", None, None),
        ("a", 5, "stage_timing", "parse", 0.1), ("a", 6, "stage_timing", "parse", 0.2004),
        ("b", 0, "run_start", None, None), ("b", 1, "run_end", None, None), ("c", 0, "missing_file", None, None),
    ]
    df = log(spark, rows)
    (a,) = runs.run_counters(df).where("run_id = 'a'").collect()
    assert (a.audio_transcript_retry_attempted, a.audio_transcript_retry_succeeded, a.missing_files) == (2, 1, 0)
    assert len(a) == 21
    assert [tuple(r) for r in runs.stage_seconds(df).collect()] == [("a", "parse", 0.3)]
    closing = runs.closing_events(df, "stopped by user").collect()
    assert [(r.run_id, r.type, r.reason, r.status, r.elapsed_seconds) for r in closing] == [
        ("a", "run_stopped", "stopped by user", None, None), ("a", "run_end", None, "stopped", 0.0),
    ]


@pytest.mark.parametrize(
    "total, media_done, remaining, want",
    [(1204, 1204, 702, (502, 502 / 1204 * 100)), (1204, 1000, 200, (800, 800 / 1204 * 100)), (0, 0, 0, (0, 100.0)), (10, -5, 100, (0, 0.0)), (10, 20, -3, (10, 100.0))],
)
def test_progress(spark, total, media_done, remaining, want):
    done, percent = runs.effective_progress(F.lit(total), F.lit(media_done), F.lit(remaining))
    got = spark.range(1).select(done.alias("d"), percent.alias("p")).first()
    assert (got.d, pytest.approx(got.p)) == want


def test_checkpoint_dir_comes_from_the_session(spark):
    assert ensure_checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()
