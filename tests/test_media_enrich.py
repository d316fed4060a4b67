from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chatweave.functions.naming import artifact_stem
from chatweave.operators import media
from chatweave.operators.enrich import enrich_messages, find_converted, find_text_artifacts, referenced_files
from chatweave.operators.parse import parse_messages

ARTIFACTS = "chat_id string, kind string, stem string, rel_path string, text string"
CONVERTED = "chat_id string, stem string, ext string, rel_path string"


@pytest.fixture(scope="module")
def stem(spark):
    def of(name: str) -> str:
        return spark.range(1).select(artifact_stem(F.lit(name)).alias("s")).first().s

    return of


@pytest.fixture(scope="module")
def messages(lines_of):
    names = ["clip.opus", "clip.ogg", "pic.jpg", "pic2.jpg", "film.mp4", "clip.opus", "old.opus", "Sub\\x.opus"]
    lines = [f"03/04/2025, 09:0{i} - A: {n} (file attached)" for i, n in enumerate(names)]
    return parse_messages(lines_of({"c": "\n".join([*lines, "03/04/2025, 09:59 - A: text"])}), tz_offset="+00:00")


@pytest.fixture(scope="module")
def artifacts(spark, stem):
    rows = [
        ("c", "transcript", stem("clip.opus"), f"transcripts/{stem('clip.opus')}.txt", "hello"),
        ("c", "transcript", "clip", "transcripts/clip.txt", "legacy"),
        ("c", "transcript", "old", "transcripts/old.txt", None),
        ("c", "ocr", stem("pic.jpg"), f"ocr/{stem('pic.jpg')}.txt", "seen"),
        ("c", "ocr", "clip", "ocr/clip.txt", "not for audio"),
        ("other", "transcript", "film", "transcripts/film.txt", "wrong chat"),
    ]
    return spark.createDataFrame(rows, ARTIFACTS)


@pytest.fixture(scope="module")
def converted(spark, stem):
    rows = [
        ("c", stem("clip.opus"), "wav", "converted/p.wav"),
        ("c", "clip", "mp3", "converted/clip.mp3"),
        ("c", "old", "wav", "converted/old.wav"),
        ("c", "pic", "mp3", "converted/pic.mp3"),
    ]
    return spark.createDataFrame(rows, CONVERTED)


def test_enrich(messages, artifacts, converted):
    rows = sorted(enrich_messages(messages, artifacts, converted).collect(), key=lambda r: r.msg_idx)
    assert [c for c in rows[0].asDict()] == messages.columns and len(rows) == 9
    first, ogg, pic, pic2, film, again, old, sub, plain = rows
    assert (first.enrichment.transcript_text, first.media[0].converted_file) == ("hello", "converted/clip.mp3")
    assert first.enrichment.ocr_text is None
    assert (ogg.enrichment.transcript_text, ogg.enrichment.transcript_file) == ("legacy", "transcripts/clip.txt")
    assert (pic.enrichment.ocr_text, pic.media[0].converted_file) == ("seen", None)
    assert pic2.enrichment is None and film.enrichment is None and sub.enrichment is None
    assert again.enrichment == first.enrichment and again.media == first.media
    assert (old.enrichment.transcript_file, old.enrichment.transcript_text) == ("transcripts/old.txt", None)
    assert old.media[0].converted_file == "converted/old.wav"
    assert (plain.media, plain.text) == ([], "text")


def test_several_files_in_a_message(spark, messages, artifacts, converted):
    two = messages.where("msg_idx = 0").withColumn(
        "media", F.concat("media", F.transform("media", lambda m: m.withField("file", F.lit("clip.ogg"))))
    )
    both = two.unionByName(messages.where("msg_idx > 6"))
    rows = sorted(enrich_messages(both, artifacts, converted, many_files=True).collect(), key=lambda r: r.msg_idx)
    assert [m.file for m in rows[0].media] == ["clip.opus", "clip.ogg"]
    assert [m.converted_file for m in rows[0].media] == ["converted/clip.mp3", "converted/clip.mp3"]
    assert rows[0].enrichment.transcript_text == "legacy"
    assert [(r.msg_idx, len(r.media), r.enrichment) for r in rows[1:]] == [(7, 1, None), (8, 0, None)]


def test_lookups(messages, artifacts, converted):
    files = referenced_files(messages)
    assert {(r.file, r.kind, r.n) for r in files.collect()} == {
        ("clip.opus", "audio", 2), ("clip.ogg", "audio", 1), ("pic.jpg", "image", 1), ("pic2.jpg", "image", 1),
        ("old.opus", "audio", 1), ("Sub\\x.opus", "audio", 1),
    }
    assert {r.file for r in find_text_artifacts(files, artifacts).collect()} == {"clip.opus", "clip.ogg", "old.opus", "pic.jpg"}
    assert {(r.file, r.converted_file) for r in find_converted(files, converted).collect()} == {
        ("clip.opus", "converted/clip.mp3"), ("clip.ogg", "converted/clip.mp3"), ("old.opus", "converted/old.wav"),
    }


def plan(spark, messages, artifacts, converted, **options):
    names = ["clip.opus", "clip.ogg", "pic.jpg", "pic2.jpg", "old.opus", "Sub/x.opus"]
    listing = spark.createDataFrame([("c", n) for n in names], "chat_id string, file string")
    df = media.media_plan(media.work_list(messages), listing, artifacts, converted, media.MediaOptions(**options))
    return {r.file: (r.text_action, r.wav_action, r.mp3_action) for r in df.collect()}, df


def test_plan(spark, messages, artifacts, converted):
    got, df = plan(spark, messages, artifacts, converted, convert_audio="mp3")
    assert got == {
        "clip.opus": ("recheck", None, "skip"),
        "clip.ogg": ("recheck", "create_if_flagged", "skip"),
        "old.opus": ("recheck", None, "create"),
        "Sub\\x.opus": ("missing", None, None),
        "pic.jpg": ("skip", None, None),
        "pic2.jpg": ("create", None, None),
    }
    events = sorted((r.type, r.file) for r in media.plan_events(df).collect())
    assert ("missing_file", "Sub\\x.opus") in events and ("audio_mp3_skipped", "clip.ogg") in events
    assert len(events) == 7


def test_plan_options(spark, messages, artifacts, converted):
    fresh, _ = plan(spark, messages, artifacts, converted, resume=False, convert_audio="wav")
    assert fresh["clip.opus"] == ("create", "skip", None)
    assert fresh["clip.ogg"] == ("create", "create", None)
    assert fresh["pic.jpg"] == ("create", None, None)
    off, _ = plan(spark, messages, artifacts, converted, transcribe=False, ocr=False, convert_audio="mp3")
    assert off["clip.opus"] == (None, None, None) and off["pic.jpg"] == (None, None, None)
    assert off["Sub\\x.opus"] == ("missing", None, None)


def test_ocr_gate(spark):
    rows = [(0, [0] * 18 + [4]), (1, [9, 0, 1]), (2, None), (3, [0, 0]), (4, [1] + [0] * 35 + [1])]
    df = spark.createDataFrame(rows, "i int, edge_hist array<bigint>")
    got = {r.i: r.keep for r in media.likely_text(df).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True}
    assert all(r.keep for r in media.likely_text(df, mode="all").collect())


@pytest.mark.parametrize("cap", [0, 1, 3, 99, 2000])
def test_cap(spark, cap):
    """A null name comes first and takes a place; files without a chat are one chat's."""
    rows = [(c, None if c != "b" and not i else f"f{i:02d}") for c, n in (("a", 7), ("b", 2), (None, 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "chat_id string, file string").repartition(5)
    got = {(r.chat_id, r.file): r.ocr_action for r in media.cap_per_chat(df, cap).collect()}
    assert got == {(c, f): "create" if not cap or int((f or "f0")[1:]) < cap else "deferred" for c, f in rows}
