"""Output files of many chats each, with an index: a Python data source with its own commit.

Tasks write one file each, ``<job>-<partition>-<attempt>.<suffix>``, and beside it its index: where each
chat begins and how long it is there. What a job wrote counts once its commit record is there; the
newest record of a folder says which files are read. A failed task deletes what it wrote. The
number of files follows the number of tasks, whatever the number of chats.

Rows of a message stream through the writer, so a message of any length takes the memory of one row.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from chatweave.functions import fixed_values as fv
from chatweave.plans.session import ship_package
from chatweave.sources.lines import open_system, plain_folder, split_lines, spread

SUFFIXES = {"json": "jsonl", "markdown": "md", "plain": "txt"}
COMMIT = "_committed-"
INDEX_END = ".index"
#: After a job failed: looks that must find nothing more of it, seconds between them, and seconds in all.
ABORT_LOOKS, ABORT_PAUSE, ABORT_SECONDS = 4, 0.25, 30.0


class MessageText:
    """The text of one message, part by part, as it is written."""

    def __init__(self, style: str) -> None:
        self.style, self.n, self.begun, self.held = style, 0, False, ""

    def add(self, text: str) -> Iterator[str]:
        """What can be written of the next part: plain text as it is; in Markdown white space waits until more text follows."""
        if self.style == "json":
            yield "\\n" if self.n else '"'
            yield json.dumps(text, ensure_ascii=False)[1:-1]
        elif self.style == "plain":
            yield text
        else:
            said = ("\n" if self.n else "") + text
            if not self.begun:
                said = said.lstrip(fv.SPACES)
            body = said.rstrip(fv.SPACES)
            if body:
                self.begun = True
                yield self.held + body
                self.held = ""
            self.held += said[len(body) :]
        self.n += 1

    def end(self) -> str:
        return "" if self.style != "json" else '"' if self.n else "null"


def pieces(rows: Iterable[Row], style: str) -> Iterator[tuple[str | None, str]]:
    """(chat_id, text to write) of ordered writer rows (``operators.parts.WRITER_COLUMNS``)."""
    chat, close, takes, text = None, None, False, MessageText(style)
    for row in rows:
        if row["open"] is not None:
            if close is not None:
                yield chat, text.end() + close
            chat, close, takes, text = row["chat_id"], row["close"], row["takes_text"], MessageText(style)
            yield chat, row["open"]
        if takes and row["text"] is not None:
            for piece in text.add(row["text"]):
                yield chat, piece
    if close is not None:
        yield chat, text.end() + close


@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)


class ChatFilesWriter(DataSourceWriter):
    def __init__(self, folder: str, style: str, overwrite: bool) -> None:
        self.folder, self.style, self.overwrite = plain_folder(folder), style, overwrite
        self.job = uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{self.job}-{task.partitionId():06d}-{task.taskAttemptId()}.{SUFFIXES[self.style]}"
        system, inner = open_system(self.folder)
        first = next(iterator, None)
        if first is None:
            return Written()
        system.create_dir(inner, recursive=True)
        try:
            with system.open_output_stream(f"{inner}/{name}") as out, system.open_output_stream(f"{inner}/{name}{INDEX_END}") as index:
                at, began, now, some = 0, 0, first["chat_id"], False

                def entry() -> bytes:
                    return (json.dumps({"chat_id": now, "offset": began, "length": at - began}, ensure_ascii=False) + "\n").encode()

                for chat, piece in pieces(_again(first, iterator), self.style):
                    if some and chat != now:
                        index.write(entry())
                        began = at
                    now, some = chat, True
                    data = piece.encode()
                    out.write(data)
                    at += len(data)
                index.write(entry())
        except BaseException:
            _delete(self.folder, [name])
            raise
        return Written([name])

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = open_system(self.folder)
        system.create_dir(inner, recursive=True)
        before = _records(self.folder)
        files = sorted(name for m in messages if m is not None for name in m.files)
        old = before[-1][1]["files"] if before and not self.overwrite else []
        number = before[-1][1]["number"] + 1 if before else 1
        with system.open_output_stream(f"{inner}/{COMMIT}{number:012d}-{self.job}.json") as out:
            out.write(json.dumps({"number": number, "style": self.style, "files": old + files}).encode())
        if self.overwrite:
            _delete(self.folder, [name for _, record in before for name in record["files"]])
        for name, _ in before:
            system.delete_file(f"{inner}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        """Deletes what the job's tasks wrote. ``messages`` tell nothing of tasks that Spark kills: these may have
        written and may still write, so the folder is looked at until nothing new has come for a while."""
        quiet, until = 0, time.monotonic() + ABORT_SECONDS
        while quiet < ABORT_LOOKS and time.monotonic() < until:
            found = _of_job(self.folder, self.job)
            _delete(self.folder, found)
            quiet = 0 if found else quiet + 1
            time.sleep(ABORT_PAUSE)


class ChatFiles(DataSource):
    """``df.write.format("chat_files").mode(...).option("style", "json", "markdown" or "plain").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "chat_files"

    def writer(self, schema, overwrite: bool) -> ChatFilesWriter:  # noqa: ANN001
        return ChatFilesWriter(self.options["path"], self.options.get("style", "json"), overwrite)


def _again(first: Row, rest: Iterator[Row]) -> Iterator[Row]:
    yield first
    yield from rest


def _delete(folder: str, names: list[str]) -> None:
    from pyarrow import fs

    system, inner = open_system(folder)
    for name in names:
        for path in (f"{inner}/{name}", f"{inner}/{name}{INDEX_END}"):
            if system.get_file_info(path).type == fs.FileType.File:
                try:
                    system.delete_file(path)
                except FileNotFoundError:  # the task that wrote it was faster
                    pass


def _of_job(folder: str, job: str) -> list[str]:
    """Files that tasks of a job wrote into a folder, indexes aside."""
    from pyarrow import fs

    system, inner = open_system(folder)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return []
    names = {i.base_name for i in system.get_file_info(fs.FileSelector(inner)) if i.base_name.startswith(f"{job}-")}
    return sorted({name.removesuffix(INDEX_END) for name in names})


def _records(folder: str) -> list[tuple[str, dict]]:
    """Commit records of a folder, oldest first."""
    from pyarrow import fs

    system, inner = open_system(folder)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return []
    names = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(inner)) if i.base_name.startswith(COMMIT))
    out = []
    for name in names:
        with system.open_input_file(f"{inner}/{name}") as f:
            out.append((name, json.loads(f.read())))
    return out


def write_chat_files(rows: DataFrame, folder: str, style: str) -> None:
    """Writes writer rows (``operators.parts.WRITER_COLUMNS``), replacing what is in ``folder``.

    Messages are dealt to tasks in ranges, so a chat may lie in several files; a message lies in one.
    """
    ship_package(rows.sparkSession)
    rows.sparkSession.dataSource.register(ChatFiles)
    (
        rows.repartitionByRange("chat_id", "msg_idx")
        .sortWithinPartitions("chat_id", "msg_idx", "part")
        .write.format("chat_files").mode("overwrite").option("style", style).save(folder)
    )


INDEX_SCHEMA = "path string, chat_id string, offset long, length long"


def chat_index(spark: SparkSession, folder: str) -> DataFrame:
    """``INDEX_SCHEMA``: where each chat lies in the committed files of a folder; tasks read the index files."""
    ship_package(spark)
    folder = plain_folder(folder)
    records = _records(folder)
    names = [(f"{folder}/{name}",) for name in (records[-1][1]["files"] if records else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                system, inner = open_system(path)
                with system.open_input_file(inner + INDEX_END) as f:
                    found = [json.loads(line) for line in f.read().splitlines()]
                yield pd.DataFrame([(path, e["chat_id"], e["offset"], e["length"]) for e in found], columns=["path", "chat_id", "offset", "length"])

    files = spark.createDataFrame(names, "path string")
    return (spread(files, "path") if names else files).mapInPandas(run, INDEX_SCHEMA)


def read_chat_files(index: DataFrame) -> DataFrame:
    """(chat_id, path, line_no, line) of the chats in ``index``, lines numbered from 0 in each file's stretch.

    Files in name order and their lines in order are a chat's output. Only the chats asked for are read.
    """
    ship_package(index.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chat, path, offset, length in zip(batch["chat_id"], batch["path"], batch["offset"], batch["length"], strict=True):
                rows, at, size = [], 0, 0
                for line in split_lines(path, offset, offset + length):
                    rows.append((chat, path, at, line.decode("utf-8", "replace")))
                    at, size = at + 1, size + len(line)
                    if size > 1 << 20:
                        yield pd.DataFrame(rows, columns=["chat_id", "path", "line_no", "line"])
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=["chat_id", "path", "line_no", "line"])

    places = index.select("chat_id", "path", "offset", "length")
    return spread(places, "path", "offset").mapInPandas(run, "chat_id string, path string, line_no long, line string")
