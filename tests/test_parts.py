from __future__ import annotations

import json
import os
import tracemalloc

import pytest
from pyspark.sql import functions as F

from chatweave.functions import fixed_values as fv
from chatweave.operators.markdown import transcript_lines
from chatweave.operators.parse import MESSAGE_COLUMNS, parse_messages
from chatweave.operators.parts import WRITER_COLUMNS, json_rows, markdown_rows, parse_parts, whole_messages
from chatweave.plans.jobs import JobOptions, publish_parts, write_conversation_parts, write_transcripts
from chatweave.sources import chatfiles
from chatweave.sources.chatfiles import chat_index, pieces, read_chat_files, write_chat_files

CHAT = "\n".join([
    "before", "[05/01/2025, 10:00] Ana: first", *[f"line {i}" for i in range(23)], "", "  ", "[05/01/2025, 10:01] Bo: <attached: p.jpg>", "caption",
    "more", "[06/02/2025, 10:02] Bo: <attached: q.jpg>", '[07/02/2025, 10:03] system "note" \\ here', "[07/02/2025, 10:04] Cy: ", "[07/02/2025, 10:05] Cy:  last\t",
])


def written(spark, folder) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for r in read_chat_files(chat_index(spark, str(folder))).orderBy("path", "line_no").collect():
        out.setdefault(r.chat_id, []).append(r.line)
    return out


@pytest.mark.parametrize("block_rows, part_lines", [(8, 3), (5, 100), (1 << 16, 4)])
def test_parts_are_the_messages(spark, lines_of, block_rows, part_lines):
    """The first message runs over three blocks and more."""
    lines = lines_of({"c": CHAT, "d": "[05/01/2025, 10:00] Z: only"})
    parts = parse_parts(lines, tz_offset="+00:00", block_rows=block_rows, part_lines=part_lines)
    want = {tuple(r) for r in map(str, parse_messages(lines, tz_offset="+00:00").collect())}
    assert {tuple(r) for r in map(str, whole_messages(parts).collect())} == want
    longest = parts.where("chat_id = 'c' AND msg_idx = 0").orderBy("part").collect()
    assert len(longest) >= 25 // part_lines and longest[0].sender == "Ana" and longest[1].sender is None
    assert max(r.text.count("\n") for r in longest) < part_lines


def test_written_parts_equal_whole_messages(spark, lines_of, tmp_path):
    lines = lines_of({"c": CHAT, "d": "[05/01/2025, 10:00] Z: only\n x"})
    parts = parse_parts(lines, tz_offset="+00:00", block_rows=8, part_lines=3, me=["ana"])
    messages = parse_messages(lines, tz_offset="+00:00", me=["ana"])
    for name, df in (("parts", parts), ("whole", messages)):
        write_conversation_parts(df, str(tmp_path / name / "json"))
        write_transcripts(df, str(tmp_path / name / "md"))
    assert written(spark, tmp_path / "parts" / "md") == written(spark, tmp_path / "whole" / "md")
    md = transcript_lines(messages).where("chat_id = 'c'").orderBy("msg_idx").collect()
    assert "\n".join(written(spark, tmp_path / "parts" / "md")["c"]) == "\n".join(r.md for r in md)
    got = [json.loads(x) for x in written(spark, tmp_path / "parts" / "json")["c"]]
    assert got == [json.loads(x) for x in written(spark, tmp_path / "whole" / "json")["c"]]
    texts = [r.text for r in messages.where("chat_id = 'c'").orderBy("msg_idx").collect()]
    assert [r["text"] for r in got] == texts and texts[2] is None and texts[1] == "caption\nmore"
    assert list(got[0]) == ["chat_id", "msg_idx", "ts", "sender", "type", "text", "media", "enrichment", "source_line", "sender_id"]


@pytest.mark.parametrize("style", ["json", "markdown"])
def test_a_message_of_any_length_takes_the_memory_of_a_row(style):
    """160 MB of text in rows of 64 kB stream through the writer."""
    line = "some text \n" * 6000

    def rows():
        yield {"chat_id": "c", "open": "{", "close": "}\n", "takes_text": True, "text": "head"}
        for _ in range(2500):
            yield {"chat_id": "c", "open": None, "close": None, "takes_text": None, "text": line}

    tracemalloc.start()
    size = sum(len(p) for _, p in pieces(rows(), style))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size > 150_000_000 and peak < 3_000_000


def test_publish_parts_of_exports(spark, tmp_path):
    for chat in ("a", "b"):
        os.makedirs(tmp_path / "in" / chat)
        (tmp_path / "in" / chat / "_chat.txt").write_text(CHAT, encoding="utf-8")
    parts = publish_parts(spark, str(tmp_path / "in"), str(tmp_path / "out"), JobOptions(tz_offset="+00:00"))
    assert parts.where("source_line IS NOT NULL").count() == 12
    got = written(spark, tmp_path / "out" / "transcript")
    assert got["a"] == got["b"] and got["a"][0] == fv.TRANSCRIPT_TITLE
    assert len(written(spark, tmp_path / "out" / "conversation")["b"]) == 6


def many(spark, n):
    row = [F.format_string("chat%05d", "id").alias("chat_id"), F.lit(0).cast("long").alias("msg_idx"), F.lit(0).cast("long").alias("part")]
    rest = [F.concat(F.lit("<"), "id").alias("open"), F.lit(">\n").alias("close"), F.lit(True).alias("takes_text"), F.lit("é").alias("text")]
    return spark.range(n).select(*row, *rest).select(*WRITER_COLUMNS)


def test_many_chats_make_few_files(spark, tmp_path):
    write_chat_files(many(spark, 10_000), str(tmp_path / "f"), "markdown")
    names = os.listdir(tmp_path / "f")
    assert len(names) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) + 1
    index = chat_index(spark, str(tmp_path / "f"))
    assert index.select("chat_id").distinct().count() == 10_000
    one = read_chat_files(index.where("chat_id = 'chat04321'")).collect()
    assert [r.line for r in one] == ["<4321é>"]
    write_chat_files(many(spark, 3), str(tmp_path / "f"), "markdown")  # replaces all of it
    assert {k: v for k, v in written(spark, tmp_path / "f").items()} == {f"chat0000{i}": [f"<{i}é>"] for i in range(3)}
    assert len([n for n in os.listdir(tmp_path / "f") if n.startswith("_committed-")]) == 1


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    write_chat_files(many(spark, 3), str(tmp_path / "f"), "markdown")
    before = sorted(os.listdir(tmp_path / "f"))

    rows = many(spark, 100).coalesce(4)
    bad = rows.withColumn("text", F.when(F.col("chat_id") == "chat00077", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("text")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with pytest.raises(Exception):
            bad.write.format("chat_files").mode("append").option("style", "markdown").save(str(tmp_path / "f"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(os.listdir(tmp_path / "f")) == before
    assert set(written(spark, tmp_path / "f")) == {f"chat0000{i}" for i in range(3)}


def test_an_aborted_job_deletes_files_of_killed_tasks(tmp_path, monkeypatch):
    """Also those that nothing told of, and those that come while it looks; other jobs' files stay."""
    writer = chatfiles.ChatFilesWriter(str(tmp_path), "markdown", False)
    names = [f"{writer.job}-00000{i}-7.md" for i in range(3)]
    for name in (*names[:2], "other-000000-7.md"):
        (tmp_path / name).write_text("x")
        (tmp_path / f"{name}.index").write_text("{}")
    (tmp_path / f"{names[1]}.index").unlink()
    late = iter([lambda: (tmp_path / names[2]).write_text("late")])
    monkeypatch.setattr(chatfiles.time, "sleep", lambda _: next(late, lambda: None)())
    writer.abort([chatfiles.Written(names[:1]), None, None])
    assert sorted(os.listdir(tmp_path)) == ["other-000000-7.md", "other-000000-7.md.index"]
    chatfiles.ChatFilesWriter(str(tmp_path / "none"), "markdown", False).abort([])


def test_writer_rows_of_messages(spark, lines_of):
    messages = parse_messages(lines_of({"c": CHAT}), tz_offset="+00:00")
    assert set(MESSAGE_COLUMNS) == set(messages.columns)
    for rows in (json_rows(messages), markdown_rows(messages)):
        assert tuple(rows.columns) == WRITER_COLUMNS and rows.where("open IS NULL").count() == 0
