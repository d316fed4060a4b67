"""Token-ID files (operator 12): patched frame-of-reference blocks.

Documents become token ids, each closed by an end id, and go in ascending id order into binary
files. A file is a stream of blocks, an index and a tail; all numbers are little-endian:

    block   u32 minimum, u8 width, u16 count, u16 exceptions,
            the low ``width`` bits of (id - minimum), lowest bit first, padded to whole bytes,
            u16 places of the exceptions, u32 bits of theirs above the width
    index   i64 starts of the blocks, i64 ids of the documents, u8 1 where that id is null,
            i64 token counts of the documents
    tail    u64 number of the file, u64 documents, u64 blocks, u64 start of the index, "PFR1"

A line break follows each chunk of blocks and the tail (the block starts account for it). The width
is chosen so that ``PERCENTILE`` of a block's ids fit, larger ones are exceptions. Spark's text
writer stores the bytes, so files are committed like any other output and reach any store.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatweave.llm.common import ship_package, store
from chatweave.llm.packing import ByteTokenizer
from chatweave.plans.session import ensure_checkpoint_dir

END_ID = 2
BLOCK_IDS = 1024
PERCENTILE = 95
#: Text that goes into one file, about; ids encoded at once; ids decoded at once.
FILE_TEXT_BYTES = 32 << 20
CHUNK_IDS = 1 << 18
WINDOW_BLOCKS = 512
MAGIC = b"PFR1"
_HEAD = struct.Struct("<IBHH")
_TAIL = struct.Struct("<QQQQ4s")
_END = b"\n"

# --- blocks -----------------------------------------------------------------------------------


def encode_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> list[bytes]:
    """Blocks of at most ``BLOCK_IDS`` ids (unsigned 32-bit); no ids give no block."""
    n = len(ids)
    if not n:
        return []
    count = -(-n // BLOCK_IDS)
    table = np.full(count * BLOCK_IDS, ids[-1], "<u4")
    table[:n] = ids
    table = table.reshape(count, BLOCK_IDS)
    low = table.min(axis=1)
    above = np.ascontiguousarray(table - low[:, None])
    bits = np.frexp(above.astype(np.float64))[1]  # the number of bits of each
    at = -(-percentile * BLOCK_IDS // 100) - 1
    widths = np.partition(bits, at, axis=1)[:, at]
    packed: list[bytes] = [b""] * count
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        flat = np.unpackbits(above[rows].view(np.uint8).reshape(len(rows), BLOCK_IDS, 4), axis=2, bitorder="little")
        for row, line in zip(rows, np.packbits(flat[:, :, :width].reshape(len(rows), -1), axis=1, bitorder="little"), strict=True):
            packed[row] = line.tobytes()
    out = []
    for i in range(count):
        size, width = min(BLOCK_IDS, n - i * BLOCK_IDS), int(widths[i])
        over = np.flatnonzero(bits[i, :size] > width)
        high = (above[i, over].astype(np.uint64) >> np.uint64(width)).astype("<u4")
        out.append(
            _HEAD.pack(int(low[i]), width, size, len(over)) + packed[i][: -(-size * width // 8)] + over.astype("<u2").tobytes() + high.tobytes()
        )
    return out


def decode_block(data: memoryview, start: int) -> np.ndarray:
    """Ids of the block at ``start``."""
    low, width, size, over = _HEAD.unpack_from(data, start)
    at = start + _HEAD.size
    length = -(-size * width // 8)
    wide = np.zeros((size, 32), np.uint8)
    if width:
        wide[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, length, at), count=size * width, bitorder="little").reshape(size, width)
    ids = np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()
    if over:
        places = np.frombuffer(data, "<u2", over, at + length)
        high = np.frombuffer(data, "<u4", over, at + length + 2 * over)
        ids[places] |= (high.astype(np.uint64) << np.uint64(width)).astype("<u4")
    return ids + np.uint32(low)


# --- files ------------------------------------------------------------------------------------


class FileWriter:
    """Gathers the ids of one file and gives its bytes chunk by chunk."""

    def __init__(self, number: int) -> None:
        self.number, self.at = number, 0
        self.docs: list[int | None] = []
        self.counts: list[int] = []
        self.starts: list[int] = []
        self._waiting: list[bytes] = []
        self._n = 0

    def add(self, doc: int | None, ids: bytes) -> Iterator[bytes]:
        """Adds a document (ids as little-endian bytes); gives the chunks that are full."""
        self.docs.append(doc)
        self.counts.append(len(ids) // 4)
        self._waiting.append(ids)
        self._n += len(ids) // 4
        if self._n >= CHUNK_IDS:
            yield self._flush(self._n // BLOCK_IDS * BLOCK_IDS)

    def finish(self) -> Iterator[bytes]:
        if self._n:
            yield self._flush(self._n)
        null = np.array([d is None for d in self.docs], np.uint8)
        index = np.array(self.starts, "<i8").tobytes() + np.array([d or 0 for d in self.docs], "<i8").tobytes()
        index += null.tobytes() + np.array(self.counts, "<i8").tobytes()
        yield index + _TAIL.pack(self.number, len(self.docs), len(self.starts), self.at, MAGIC)

    def _flush(self, n: int) -> bytes:
        ids = np.frombuffer(b"".join(self._waiting), "<u4")
        self._waiting, self._n = [ids[n:].tobytes()], len(ids) - n
        blocks = encode_blocks(ids[:n])
        for block in blocks:
            self.starts.append(self.at)
            self.at += len(block)
        self.at += len(_END)
        return b"".join(blocks)


class FileReader:
    """Index and ids of one file."""

    def __init__(self, data: bytes) -> None:
        self.data = memoryview(data)
        tail = len(data) - len(_END) - _TAIL.size
        self.number, n, blocks, at, magic = _TAIL.unpack_from(data, tail) if tail >= 0 else (0, 0, 0, 0, b"")
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.starts = np.frombuffer(data, "<i8", blocks, at)
        ids, at = np.frombuffer(data, "<i8", n, at + 8 * blocks), at + 8 * (blocks + n)
        null = np.frombuffer(data, np.uint8, n, at)
        self.docs = [None if gone else int(d) for d, gone in zip(ids, null, strict=True)]
        self.counts = np.frombuffer(data, "<i8", n, at + n)

    def checksums(self) -> list[int]:
        """crc32 of the ids of each document; some blocks at a time are unpacked."""
        ends = 4 * np.cumsum(self.counts)
        crcs = [0] * len(ends)
        doc, base = 0, 0
        for i in range(0, len(self.starts), WINDOW_BLOCKS):
            ids = memoryview(np.concatenate([decode_block(self.data, int(s)) for s in self.starts[i : i + WINDOW_BLOCKS]]).tobytes())
            at = 0
            while at < len(ids):
                to = min(int(ends[doc]) - base, len(ids))
                crcs[doc] = zlib.crc32(ids[at:to], crcs[doc])
                doc += to == int(ends[doc]) - base
                at = to
            base += len(ids)
        return crcs

    def ids_of(self, first: int, count: int) -> np.ndarray:
        """``count`` ids from number ``first`` of this file on: only their blocks are unpacked.

        Blocks but the last of a chunk are full; the index gives where each begins.
        """
        sizes = np.array([_HEAD.unpack_from(self.data, int(s))[2] for s in self.starts], np.int64)
        before = np.concatenate(([0], np.cumsum(sizes)))
        a, b = np.searchsorted(before, first, side="right") - 1, np.searchsorted(before, first + count, side="left")
        if count <= 0:
            return np.zeros(0, "<u4")
        ids = np.concatenate([decode_block(self.data, int(s)) for s in self.starts[a:b]])
        return ids[first - before[a] :][:count]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str) -> None:
    """Writes ``docs`` (doc_id, text) to ``path`` in ascending doc_id order, file by file.

    A null id comes first; rows of one id are in the order of a hash of their text, equal rows side
    by side. Null text is empty: its document is the end id alone. Extra columns are ignored. An
    empty table writes no file. The number of files follows the bytes of text.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    files = max(1, -(-size // FILE_TEXT_BYTES))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, end, writer = ByteTokenizer.load(tokenizer_path), np.array([END_ID], "<u4").tobytes(), None
        for batch in batches:
            if not len(batch):
                continue
            if writer is None:
                from pyspark import TaskContext

                writer = FileWriter(TaskContext.get().partitionId())
            for doc, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                for chunk in writer.add(None if doc is pd.NA else int(doc), tokenizer.encode(text) + end):
                    yield pd.DataFrame({"bytes": [chunk]})
        if writer is not None:
            for chunk in writer.finish():
                yield pd.DataFrame({"bytes": [chunk]})

    tie = F.md5("text")
    (
        rows.repartitionByRange(files, "doc_id", tie)
        .sortWithinPartitions("doc_id", tie)
        .mapInPandas(run, "bytes binary")
        .select(F.col("bytes").cast("string").alias("value"))  # the same bytes
        .write.option("lineSep", _END.decode()).text(path)
    )


READ_SCHEMA = "file long, place long, doc_id long, first long, n_tokens long, ids_crc32 long"


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, place in it, doc_id, first id in it, n_tokens, ids_crc32) of every document, from the files alone."""
    ship_package(spark)
    names = [c.split(" ")[0] for c in READ_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                if not len(data):
                    continue
                reader = FileReader(data)
                before = np.concatenate(([0], np.cumsum(reader.counts)))[:-1]
                columns = (reader.number, np.arange(len(before)), pd.array(reader.docs, "Int64"), before, reader.counts, reader.checksums())
                yield pd.DataFrame(dict(zip(names, columns, strict=True)))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    return files.select("content").mapInPandas(run, READ_SCHEMA)


def token_files(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files written of ``docs``.

    ``start`` counts the ids of all documents before it. Files go to the checkpoint folder.
    """
    path = f"{ensure_checkpoint_dir(docs.sparkSession).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer_path)
    read = store(read_token_files(docs.sparkSession, path))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    totals = read.groupBy("file").agg(F.sum("n_tokens").alias("n")).select(
        F.col("file").alias("of"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    return read.join(totals, F.col("file") == F.col("of")).select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
