"""Zip archives of exports.

An archive is opened where it lies, by random access, so neither listing nor unpacking passes a
whole archive through memory, and the entries of one archive are unpacked by many tasks.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatweave.plans.session import store
from chatweave.sources.lines import list_files, open_system, spread

CHUNK_BYTES = 8 << 20
LINE_BATCH = 20_000


def _open_zip(location: str) -> zipfile.ZipFile:
    system, path = open_system(location)
    return zipfile.ZipFile(system.open_input_file(path))


def leaves_root(entry: str) -> bool:
    """Whether an entry name points outside the folder it is unpacked to."""
    inner = posixpath.normpath(posixpath.join("/root", entry))
    return not (inner + "/").startswith("/root/")


def entry_path(entry: str) -> str:
    """Path an entry is unpacked to: empty, '.' and '..' parts are left out."""
    return "/".join(p for p in entry.split("/") if p not in ("", ".", ".."))


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive): locations of all .zip files below a folder, whatever their names start with; their bytes are not read."""
    return list_files(spark, path, "*.zip").select(F.col("path").alias("archive"))


def list_entries(archives: DataFrame) -> DataFrame:
    """(archive, entry, path, length, problem): files in each archive, from its directory only. Of entries
    that unpack to one path, the last one counts.

    ``problem`` is set on a row for an archive that cannot be read, and on unsafe entries.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["archive"]:
                try:
                    with _open_zip(uri) as z:
                        infos = z.infolist()
                except Exception as e:
                    yield pd.DataFrame(
                        [(uri, None, None, None, f"unreadable archive: {e}")],
                        columns=["archive", "entry", "path", "length", "problem"],
                    )
                    continue
                unsafe = [i for i in infos if leaves_root(i.filename)]
                last = {entry_path(i.filename): i for i in infos if not i.is_dir() and not leaves_root(i.filename)}
                rows = [(uri, i.filename, entry_path(i.filename), i.file_size, f"unsafe entry path: {i.filename}") for i in unsafe]
                rows += [(uri, i.filename, path, i.file_size, None) for path, i in last.items()]
                yield pd.DataFrame(rows, columns=["archive", "entry", "path", "length", "problem"]).astype(
                    {"length": "Int64"}
                )

    return archives.mapInPandas(
        run, "archive string, entry string, path string, length bigint, problem string"
    )


def split_entries(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries of sound archives, one reject row per other archive).

    One unsafe entry rejects its whole archive.
    """
    rejects = (
        entries.where(F.col("problem").isNotNull()).groupBy("archive").agg(F.min("problem").alias("reason"))
    )
    return entries.join(rejects, "archive", "left_anti").drop("problem"), rejects


def sound_entries(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries of archives in which every given entry can be unpacked, one reject row per other archive).

    Every given entry is read to its end once, which checks its sum; nothing of it is kept.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            problems = [_entry_problem(row.archive, row.entry) for row in batch.itertuples()]
            yield batch.assign(problem=problems).dropna(subset=["problem"])[["archive", "problem"]]

    broken = spread(entries.select("archive", "entry"), "archive", "entry").mapInPandas(run, "archive string, problem string")
    rejects = store(broken.groupBy("archive").agg(F.min("problem").alias("reason")))
    return entries.join(rejects, "archive", "left_anti"), rejects


def _entry_problem(archive: str, entry: str) -> str | None:
    try:
        with _open_zip(archive) as z, z.open(entry) as f:
            while f.read(CHUNK_BYTES):
                pass
    except Exception as e:  # a bad sum, bad compressed data, a password
        return f"unreadable entry: {entry}: {e}"
    return None


def extract(entries: DataFrame, tasks: int | None = None) -> DataFrame:
    """(archive, path, chunk_no, content): entries unpacked, in pieces of CHUNK_BYTES. Bad entries end the job:
    give it ``sound_entries``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                with _open_zip(row.archive) as z, z.open(row.entry) as f:
                    n = 0
                    while (part := f.read(CHUNK_BYTES)) or n == 0:
                        yield pd.DataFrame(
                            {"archive": [row.archive], "path": [row.path], "chunk_no": [n], "content": [part]}
                        )
                        n += 1

    dealt = entries.repartition(tasks) if tasks else spread(entries, "archive", "entry")
    return dealt.select("archive", "entry", "path").mapInPandas(
        run, "archive string, path string, chunk_no bigint, content binary"
    )


def entry_lines(entries: DataFrame) -> DataFrame:
    """(archive, path, line_no, line, problem) of the given text entries, streamed line by line.

    Each entry is opened once. Its last row has no line: ``problem`` there says why it could not be
    read to its end (a bad sum, bad compressed data, a password), or is null. Lines of an entry with
    a problem are to be dropped, as ``sound_lines`` does.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                problem = None
                try:
                    with _open_zip(row.archive) as z, z.open(row.entry) as raw:
                        text = io.TextIOWrapper(raw, encoding="utf-8", errors="replace", newline=None)
                        start, held = 0, []
                        for line in text:
                            held.append(line[:-1] if line.endswith("\n") else line)
                            if len(held) == LINE_BATCH:
                                yield _line_frame(row, range(start, start + len(held)), held, None)
                                start, held = start + len(held), []
                        if held:
                            yield _line_frame(row, range(start, start + len(held)), held, None)
                except Exception as e:
                    problem = f"unreadable entry: {row.entry}: {e}"
                yield _line_frame(row, [-1], [None], problem)

    return spread(entries.select("archive", "entry", "path"), "archive", "entry").mapInPandas(
        run, "archive string, path string, line_no bigint, line string, problem string"
    )


def _line_frame(row, numbers: Iterable[int], lines: list[str | None], problem: str | None) -> pd.DataFrame:
    return pd.DataFrame({"archive": row.archive, "path": row.path, "line_no": numbers, "line": lines, "problem": problem})


def sound_lines(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines of archives in which every given entry can be read, one reject row per other archive).

    The lines are stored as they are unpacked; what a broken entry gave until it broke goes again.
    """
    read = store(entry_lines(entries))
    rejects = read.where("problem IS NOT NULL").groupBy("archive").agg(F.min("problem").alias("reason"))
    return read.where("line IS NOT NULL").drop("problem").join(rejects, "archive", "left_anti"), rejects


def read_archive_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(chat_lines, rejects) of all .zip exports below a folder; chat_id is the archive location.

    An archive whose chat cannot be unpacked is a reject, the others are read."""
    from chatweave.sources.exports import chat_files, export_roots

    entries, rejects = split_entries(store(list_entries(list_archives(spark, path))))
    files = entries.select(F.col("archive").alias("export"), "path", "length")
    chosen = chat_files(files, export_roots(files))
    none = chosen.where(F.col("chat_path").isNull()).select(
        F.col("export").alias("archive"), F.lit("no .txt chat export found").alias("reason")
    )
    wanted = chosen.where(F.col("chat_path").isNotNull()).select(
        F.col("export").alias("archive"), F.col("chat_path").alias("path")
    )
    lines, broken = sound_lines(entries.join(wanted, ["archive", "path"], "left_semi"))
    return (
        lines.select(F.col("archive").alias("chat_id"), "path", "line_no", "line"),
        rejects.unionByName(none).unionByName(broken),
    )
