from __future__ import annotations

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from chatweave.operators.parse import parse_messages
from chatweave.sources import archives, artifacts, exports
from chatweave.sources.chats import choose_chats, list_exports, read_chat_lines
from chatweave.operators import runs
from chatweave.sources.lines import read_lines, split_lines
from chatweave.sources.manifest import append_events, parse_manifest, read_events, read_manifest


def put(root, path, content=b""):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode())


CASES = {
    "unix.txt": b"a\nb\n",
    "no end.txt": b"a\nb",
    "dos+mac.txt": b"a\r\nb\rc\n\nd\r\n",
    "empty.txt": b"",
    "blank.txt": b"\n",
    "bad.txt": b"x\xffy\xe2\x82\nz\xc3",
    "odd.txt": "one\u2028two\u0085three\u000bfour\n".encode(),
}


def python_lines(content: bytes) -> list[str]:
    text = content.decode("utf-8", errors="replace").replace("\r\n", "\n").replace("\r", "\n")
    parts = text.split("\n")
    return parts[:-1] if parts[-1] == "" else parts


@pytest.mark.parametrize("split_bytes", [1 << 20, 1, 2, 3, 5])
def test_lines(spark, tmp_path, split_bytes):
    """Lines are numbered and decoded alike wherever files are cut."""
    for name, content in CASES.items():
        put(tmp_path, f"d/{name}", content)
    got: dict[str, list] = {}
    for r in read_lines(spark, str(tmp_path), "*.txt", split_bytes).collect():
        got.setdefault(os.path.basename(r.path), []).append((r.line_no, r.line))
    want = {n: list(enumerate(python_lines(c))) for n, c in CASES.items() if python_lines(c)}
    assert {n: sorted(v) for n, v in got.items()} == want


def test_large_file_in_many_splits(spark, tmp_path):
    lines = [f"{i} " + "x" * (i % 50) for i in range(20_000)]
    put(tmp_path, "big.txt", "\n".join(lines))
    df = read_lines(spark, str(tmp_path), "*.txt", 40_000)
    assert [r.line for r in df.orderBy("line_no").collect()] == lines
    assert df.agg(F.max("line_no")).first()[0] == 19_999


@pytest.mark.parametrize("content", [b"a\r\nb\rc\n\r\n\r\rd", b"\r\n" * 4, b"\r" * 5 + b"x", b"x" * 9 + b"\r\n", b""])
def test_split_lines_anywhere(tmp_path, content):
    put(tmp_path, "f", content)
    whole = [x.decode() for x in split_lines(str(tmp_path / "f"), 0, 1 << 30)]
    assert whole == (python_lines(content) if content else [])
    for size in range(1, len(content) + 1):
        cuts = range(0, len(content), size)
        assert [x.decode() for s in cuts for x in split_lines(str(tmp_path / "f"), s, s + size)] == whole


@pytest.mark.parametrize("split_bytes", [1 << 20, 16])
def test_byte_order_mark_is_kept(spark, tmp_path, split_bytes):
    put(tmp_path, "a.txt", "\ufeff[20/09/2025, 21:41] A: lost\n[20/09/2025, 21:42] A: kept".encode())
    lines = read_lines(spark, str(tmp_path), split_bytes=split_bytes).withColumnRenamed("path", "chat_id")
    assert [m.text for m in parse_messages(lines, tz_offset="+00:00").collect()] == ["kept"]


def test_hidden_names(spark, tmp_path):
    """Names that start with '_' or '.' are files like others."""
    put(tmp_path, "in/ana/_chat.txt", "[17/04/2024, 7:41:30 PM] Mara: note\n[17/04/2024, 7:42:30 PM] Mara: more\n")
    put(tmp_path, "in/ana/.pier.jpg", b"1")
    put(tmp_path, "in/_bo/deep/chat.txt", "[17/04/2024, 7:41:30 AM] Bo: x")
    got = {(r.chat_id, r.text, r.ts[11:16]) for r in parse_messages(read_chat_lines(spark, str(tmp_path / "in")), tz_offset="+00:00").collect()}
    assert got == {("ana", "note", "19:41"), ("ana", "more", "19:42"), ("_bo", "x", "07:41")}
    roots = exports.export_roots(list_exports(spark, str(tmp_path / "in")))
    assert ("ana", ".pier.jpg") in {(r.chat_id, r.file) for r in artifacts.media_listing(spark, str(tmp_path / "in"), roots).collect()}
    put(tmp_path, "out/ana/ocr/_pier.txt", b"a\r\nb\n")
    assert [(r.stem, r.text) for r in artifacts.read_text_artifacts(spark, str(tmp_path / "out")).collect()] == [("_pier", "a\nb")]
    assert {os.path.basename(r.path) for r in artifacts.media_meta(spark, str(tmp_path / "out"), with_hash=True).collect()} == {"_pier.txt"}


def test_no_text_is_shuffled(spark, export_folder):
    plan = read_chat_lines(spark, export_folder)._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "Exchange" in x]
    assert exchanges and not any("line" in x.replace("line_no", "") for x in exchanges)


def files(spark, rows):
    return spark.createDataFrame(rows, "export string, path string, length bigint")


def test_export_roots(spark):
    df = files(
        spark,
        [
            ("top", "a.txt", 1), ("top", "x/WhatsApp Chat.txt", 99),
            ("below", "box/WhatsApp Chat.txt", 1), ("below", "other/long.txt", 500),
            ("weak", "p/conversa.txt", 1), ("weak", "q/note.txt", 9), ("weak", "r/chat.txt", 2),
            ("size", "a/1.txt", 5), ("size", "b/2.txt", 6), ("size", "c/3.txt", 6),
            ("none", "pics/a.jpg", 1), ("both", "m/whatsapp.txt", 9), ("both", "n/whatsapp chat.txt", 1),
        ],
    )
    roots = {r.export: r.root for r in exports.export_roots(df).collect()}
    assert roots == {"top": "", "below": "box", "weak": "r", "size": "b", "none": "", "both": "n"}


def test_chat_files(spark):
    df = files(
        spark,
        [
            ("one", "zzz.txt", 1), ("many", "a.txt", 1), ("many", "My Chat with whatsapp.txt", 1), ("many", "b.txt", 1),
            ("plain", "b.txt", 1), ("plain", "a.txt", 2), ("none", "x.jpg", 1),
        ],
    )
    chosen = exports.chat_files(df, exports.export_roots(df))
    assert {r.export: r.chat_path for r in chosen.collect()} == {
        "one": "zzz.txt", "many": "My Chat with whatsapp.txt", "plain": "a.txt", "none": None,
    }
    assert [r.export for r in exports.exports_without_chat(chosen).collect()] == ["none"]


@pytest.fixture()
def export_folder(tmp_path):
    root = tmp_path / "exports in"
    put(root, "ana/WhatsApp Chat.txt", "[20/09/2025, 21:41] A: hi\r\nthere\r\n[20/09/2025, 21:42] A: <attached: p+q 1.jpg>\n")
    put(root, "ana/p+q 1.jpg", b"12345")
    put(root, "ana/notes.txt", "[20/09/2025, 21:41] A: not this\n")
    put(root, "bob/in/chat.txt", "9/20/2025, 9:41 AM - B: yo")
    put(root, "bob/in/a.opus", b"1")
    put(root, "nochat/x.jpg", b"1")
    return str(root)


def test_read_chat_lines(spark, export_folder):
    assert list_exports(spark, export_folder).count() == 6
    assert {(r.export, r.root, r.chat_path) for r in choose_chats(spark, export_folder).collect()} == {
        ("ana", "", "WhatsApp Chat.txt"), ("bob", "in", "in/chat.txt"),
    }
    messages = parse_messages(read_chat_lines(spark, export_folder), tz_offset="+00:00")
    got = {(r.chat_id, r.msg_idx, r.text, r.type) for r in messages.collect()}
    assert got == {("ana", 0, "hi\nthere", "text"), ("ana", 1, None, "image"), ("bob", 0, "yo", "text")}


def test_media_listing_and_meta(spark, export_folder):
    roots = exports.export_roots(list_exports(spark, export_folder))
    got = {(r.chat_id, r.file, r.size_bytes) for r in artifacts.media_listing(spark, export_folder, roots).collect()}
    assert ("ana", "p+q 1.jpg", 5) in got and ("bob", "a.opus", 1) in got
    meta = {os.path.basename(r.path): r for r in artifacts.media_meta(spark, export_folder, with_hash=True).collect()}
    assert meta["p+q 1.jpg"].sha256.startswith("5994471a") and meta["p+q 1.jpg"].size_bytes == 5
    plain = artifacts.media_meta(spark, export_folder)
    assert plain.where("sha256 is not null").count() == 0
    assert "content" not in plain._jdf.queryExecution().executedPlan().toString()


def test_artifact_folders(spark, tmp_path):
    put(tmp_path, "ana/transcripts/clip.v1.txt", b" hello\xff\n\n")
    put(tmp_path, "ana/ocr/pic.txt", b"seen\n")
    put(tmp_path, "ana/converted/clip.mp3", b"1")
    put(tmp_path, "ana/converted/clip.wav", b"1")
    put(tmp_path, "ana/converted/clip.tmp", b"1")
    texts = {tuple(r) for r in artifacts.read_text_artifacts(spark, str(tmp_path)).collect()}
    assert texts == {
        ("ana", "transcript", "clip.v1", "transcripts/clip.v1.txt", "hello\ufffd"),
        ("ana", "ocr", "pic", "ocr/pic.txt", "seen"),
    }
    assert {tuple(r) for r in artifacts.read_converted(spark, str(tmp_path)).collect()} == {
        ("ana", "clip", "mp3", "converted/clip.mp3"), ("ana", "clip", "wav", "converted/clip.wav"),
    }


def make_zip(path, entries):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in entries.items():
            z.writestr(name, content)


def test_archives(spark, tmp_path, monkeypatch):
    make_zip(tmp_path / "good one.zip", {
        "x/": b"", "x/WhatsApp Chat.txt": "[20/09/2025, 21:41] A: h\u00e9\r\nmore\xff\n".encode(),
        "x/../y/p.jpg": b"123", "x/big.bin": b"ab" * 10,
    })
    make_zip(tmp_path / "evil.zip", {"ok.txt": b"a", "../evil.txt": b"b"})
    make_zip(tmp_path / "absolute.zip", {"/etc/evil.txt": b"b"})
    make_zip(tmp_path / "nochat.zip", {"a.jpg": b"1"})
    put(tmp_path, "broken.zip", b"not a zip")
    entries, rejects = archives.split_entries(archives.list_entries(archives.list_archives(spark, str(tmp_path))))
    reasons = {os.path.basename(r.archive): r.reason for r in rejects.collect()}
    assert set(reasons) == {"evil.zip", "absolute.zip", "broken.zip"}
    assert reasons["evil.zip"] == "unsafe entry path: ../evil.txt"
    assert {(os.path.basename(r.archive), r.path, r.length) for r in entries.collect()} == {
        ("good one.zip", "x/WhatsApp Chat.txt", 35), ("good one.zip", "x/y/p.jpg", 3),
        ("good one.zip", "x/big.bin", 20), ("nochat.zip", "a.jpg", 1),
    }
    content: dict[str, bytes] = {}
    for r in archives.extract(entries).orderBy("archive", "path", "chunk_no").collect():
        content[r.path] = content.get(r.path, b"") + bytes(r.content)
    assert content["x/y/p.jpg"] == b"123" and content["x/big.bin"] == b"ab" * 10
    lines, rejected = archives.read_archive_lines(spark, str(tmp_path))
    assert [(r.line_no, r.line) for r in lines.orderBy("line_no").collect()] == [
        (0, "[20/09/2025, 21:41] A: h\u00e9"), (1, "more\u00ff"),
    ]
    assert {os.path.basename(r.archive) for r in rejected.collect()} == {*reasons, "nochat.zip"}


@pytest.mark.parametrize("name", ["_hidden.zip", ".hidden.zip", "sub/_x y.zip"])
def test_archives_of_any_name_are_opened_once(spark, tmp_path, name, capsys):
    (tmp_path / "sub").mkdir()
    make_zip(tmp_path / name, {"_chat.txt": b"[20/09/2025, 21:41] A: hi\nyou"})
    lines, rejects = archives.read_archive_lines(spark, str(tmp_path))
    assert [(r.chat_id, r.line_no) for r in lines.orderBy("line_no").collect()] == [(str(tmp_path / name), 0), (str(tmp_path / name), 1)]
    assert rejects.count() == 0
    lines.explain()  # what is read again is stored: no task unpacks anything any more
    assert "MapInPandas" not in capsys.readouterr().out


@pytest.mark.parametrize("entry, unsafe", [("a/../b", False), ("a/../../b", True), ("/x", True), ("..", True), ("a/..b", False)])
def test_unsafe_entries(entry, unsafe):
    assert archives.leaves_root(entry) is unsafe


def test_manifest(spark, tmp_path):
    put(tmp_path, "r1/manifest.jsonl", '{"type":"run_start","event_ts":"2025-01-01T00:00:00+00:00"}\nnot json\n{"type":"x","elapsed_seconds":1.5,"more":[1]}\n')
    rows = sorted(read_manifest(spark, str(tmp_path)).collect(), key=lambda r: r.seq)
    assert [(r.run_id, r.seq, r.type, r.elapsed_seconds) for r in rows] == [
        ("r1/manifest.jsonl", 0, "run_start", None), ("r1/manifest.jsonl", 2, "x", 1.5),
    ]
    assert rows[0].event_ts is not None and '"more"' in rows[1].payload
    events = spark.createDataFrame([("a", 1, "run_start", None)], "run_id string, seq bigint, type string, event_ts timestamp")
    append_events(events, str(tmp_path / "log"))
    append_events(events.withColumn("event_ts", F.lit("2020-01-01").cast("timestamp")), str(tmp_path / "log"))
    stored = spark.read.schema("type string, event_ts timestamp, run_id string").json(str(tmp_path / "log")).collect()
    assert len(stored) == 2 and all(r.event_ts for r in stored)
    assert min(r.event_ts for r in stored).year in (2019, 2020)


def test_appended_events_are_one_run(spark, tmp_path):
    folder = str(tmp_path / "log")
    for rows in ([("a", 0, "run_start"), ("b", 0, "run_start")], [("a", 1, "run_end")]):
        append_events(spark.createDataFrame(rows, "run_id string, seq bigint, type string"), folder)
    log = read_events(spark, folder)
    assert [(r.run_id, r.last_start, r.last_end, r.last_seq) for r in runs.open_runs(log).collect()] == [("b", 0, -1, 0)]
    append_events(spark.createDataFrame(runs.closing_events(log, "stopped").collect()), folder)
    log = read_events(spark, folder)
    assert sorted((r.run_id, r.seq, r.type) for r in log.collect())[2:] == [("b", 0, "run_start"), ("b", 1, "run_stopped"), ("b", 2, "run_end")]
    assert runs.open_runs(log).count() == 0
    with pytest.raises(ValueError, match="seq"):
        append_events(log.drop("seq"), folder)


def test_double_and_corrupt_entries(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "double.zip", "w") as z:
        with pytest.warns(UserWarning):
            z.writestr("chat.txt", "[17/04/2024, 19:26] Mara: old")
            z.writestr("chat.txt", "[17/04/2024, 19:26] Mara: new")
    make_zip(tmp_path / "sound.zip", {"chat.txt": "one"})
    with zipfile.ZipFile(tmp_path / "corrupt.zip", "w") as z:
        z.writestr("chat.txt", "here is a chat")
    data = (tmp_path / "corrupt.zip").read_bytes()
    (tmp_path / "corrupt.zip").write_bytes(data.replace(b"here is", b"hero is", 1))
    lines, rejects = archives.read_archive_lines(spark, str(tmp_path))
    assert {(os.path.basename(r.chat_id), r.line_no, r.line) for r in lines.collect()} == {
        ("double.zip", 0, "[17/04/2024, 19:26] Mara: new"), ("sound.zip", 0, "one"),
    }
    (r,) = rejects.collect()
    assert r.archive.endswith("corrupt.zip") and "chat.txt" in r.reason


def test_parse_manifest_keeps_free_keys(spark):
    df = spark.createDataFrame([("r", 0, '{"type": 5, "file": null}')], "run_id string, line_no bigint, line string")
    (r,) = parse_manifest(df).collect()
    assert (r.type, r.file) == ("5", None)


@pytest.mark.parametrize("split_bytes", [1 << 20, 7])
def test_chats_are_chosen_before_reading(spark, export_folder, split_bytes):
    lines = read_chat_lines(spark, export_folder, split_bytes)
    assert {r.chat_id: r.n for r in lines.groupBy("chat_id").agg(F.count("*").alias("n")).collect()} == {"ana": 3, "bob": 1}
