"""Files below a folder, and the numbered lines of text files.

Tasks list folders and open files through the file system API. Spark's own file sources leave out
names that start with '_' or '.', and the chat of an export is often called ``_chat.txt``.

Lines are UTF-8 with bad bytes replaced; '\\n', '\\r\\n' or '\\r' ends a line, and a byte-order mark
stays part of the first one. Every file is read in splits of ``SPLIT_BYTES``: a line belongs to the
split it starts in, and line numbers come from line counts per split. So results do not depend on
where files are cut, no task reads a whole large file, and no text is shuffled.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from fnmatch import fnmatchcase
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatweave.plans.session import ship_package

SPLIT_BYTES = 64 << 20
#: Bytes read at once, and about the size of a batch of lines. They do not change results.
_READ_BYTES = 1 << 20
_LINE_END = re.compile(rb"\r\n?|\n")


def plain_folder(path: str) -> str:
    """A folder as ``list_files`` names it: absolute, without 'file:' and without a slash at the end."""
    path = re.sub(r"^file:/+", "/", path)
    return path.rstrip("/") if "://" in path else os.path.abspath(path)


def open_system(path: str) -> tuple:
    """(file system, path within it) of an absolute path or of a location with a scheme."""
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(quote(path, safe="/:@"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows that stand for work, dealt to tasks. A given number keeps adaptive execution from joining small rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _entries(folder: str, deep: bool) -> pd.DataFrame:
    from pyarrow import fs

    system, inner = open_system(folder)
    outer = folder.removesuffix(inner)
    infos = system.get_file_info(fs.FileSelector(inner, recursive=deep))
    rows = [(outer + i.path, i.size, i.type == fs.FileType.Directory) for i in infos]
    return pd.DataFrame(rows, columns=["path", "length", "folder"]).astype({"length": "Int64", "folder": bool})


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length) of all files below a folder, whatever their names start with. Each sub-folder is
    listed by a task of its own; file contents are not read."""
    ship_package(spark)

    def first_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["path"]:
                yield _entries(folder, deep=False)

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _matching(batch[~batch["folder"]], glob)
            for folder in batch.loc[batch["folder"], "path"]:
                found = _entries(folder, deep=True)
                yield _matching(found[~found["folder"]], glob)

    top = spark.createDataFrame([(plain_folder(path),)], "path string")
    top = top.mapInPandas(first_level, "path string, length long, folder boolean")
    return spread(top, "path").mapInPandas(below, "path string, length long")


def _matching(files: pd.DataFrame, glob: str) -> pd.DataFrame:
    named = [fnmatchcase(p.rsplit("/", 1)[-1], glob) for p in files["path"]]
    return files.loc[pd.Series(named, index=files.index, dtype=bool), ["path", "length"]]


def split_lines(path: str, start: int, end: int) -> Iterator[bytes]:
    """Lines, without their ends, that start at bytes ``start`` to ``end`` (exclusive) of a file."""
    system, inner = open_system(path)
    with system.open_input_file(inner) as f:
        # From one byte earlier on, everything up to the first line end belongs to the split before.
        skipping, at = start > 0, max(start - 1, 0)
        f.seek(at)
        held: list[bytes] = []
        while part := f.read(_READ_BYTES):
            while part.endswith(b"\r") and (more := f.read(1)):
                part += more
            last = 0
            for m in _LINE_END.finditer(part):
                if not skipping:
                    yield b"".join([*held, part[last : m.start()]])
                skipping, held, last = False, [], m.end()
                if at + last >= end:
                    return
            if last < len(part) and not skipping:
                held.append(part[last:])
            at += len(part)
        if held:
            yield b"".join(held)


def read_lines(
    spark: SparkSession,
    path: str,
    glob: str = "*.txt",
    split_bytes: int = SPLIT_BYTES,
    chosen: DataFrame | None = None,
) -> DataFrame:
    """(path, line_no, line) of all matching files below a folder, or of those in ``chosen(path)``."""
    files = list_files(spark, path, glob).where("length > 0")
    if chosen is not None:
        files = files.join(chosen.select("path"), "path", "left_semi")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = [sum(1 for _ in split_lines(p, s * split_bytes, (s + 1) * split_bytes)) for p, s in zip(batch["path"], batch["split"], strict=True)]
            yield batch[["path", "split"]].assign(n=n)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                number, size, held = row.first_line, 0, []
                for line in split_lines(row.path, row.split * split_bytes, (row.split + 1) * split_bytes):
                    held.append(line.decode("utf-8", "replace"))
                    size += len(line) + 64
                    if size >= _READ_BYTES:
                        yield _line_frame(row.path, number, held)
                        number, size, held = number + len(held), 0, []
                if held:
                    yield _line_frame(row.path, number, held)

    splits = files.select(
        "path", "length", F.explode(F.expr(f"sequence(0L, (length - 1) div {split_bytes})")).alias("split")
    )
    # The last split of a file has nothing after it, so files of one split are not counted.
    followed = splits.where((F.col("split") + 1) * split_bytes < F.col("length")).select("path", "split")
    counted = spread(followed, "path", "split").mapInPandas(count, "path string, split long, n long")
    upto = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    firsts = counted.select("path", (F.col("split") + 1).alias("split"), F.sum("n").over(upto).alias("first_line"))
    located = splits.select("path", "split").join(firsts, ["path", "split"], "left").fillna(0, ["first_line"])
    return spread(located, "path", "split").mapInPandas(read, "path string, line_no long, line string")


def _line_frame(path: str, start: int, lines: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"path": path, "line_no": range(start, start + len(lines)), "line": lines})


def whole_texts(files: DataFrame) -> DataFrame:
    """(path, text) of ``files(path)``, one row per file: for small files, as artifacts are. Lines end in
    '\\n'; ``text`` is null where a file cannot be read."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                yield pd.DataFrame({"path": [path], "text": [_whole_text(path)]})

    return spread(files.select("path"), "path").mapInPandas(run, "path string, text string")


def _whole_text(path: str) -> str | None:
    system, inner = open_system(path)
    try:
        with system.open_input_file(inner) as f:
            text = f.read().decode("utf-8", "replace")
            return text.replace("\r\n", "\n").replace("\r", "\n")
    except OSError:
        return None
