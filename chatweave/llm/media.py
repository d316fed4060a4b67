"""Media columns (operator 5): Netpbm and BMP images to numpy arrays, tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatweave.llm.common import ship_package

WIDTH = 64
TILE = (32, 32)

# --- formats ----------------------------------------------------------------------------------


def encode_pgm(image: np.ndarray) -> bytes:
    """8-bit grey Netpbm (P5)."""
    height, width = image.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """8-bit BMP with a grey palette, rows bottom up, each padded to four bytes."""
    height, width = image.shape
    pitch = (width + 3) // 4 * 4
    rows = np.zeros((height, pitch), np.uint8)
    rows[:, :width] = image[::-1]
    grey = np.arange(256, dtype=np.uint8)
    palette = np.stack([grey, grey, grey, np.zeros(256, np.uint8)], 1).tobytes()
    offset = 14 + 40 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", offset + rows.size, 0, 0, offset)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + info + palette + rows.tobytes()


_FIELD = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([0-9]+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array of (height, width) or (height, width, 3); P1 and P4 give 0 (black) or 255."""
    kind, at, fields = int(data[1:2]), 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        found = _FIELD.match(data, at)
        if not found:
            raise ValueError("Netpbm header is cut off")
        fields.append(int(found[1]))
        at = found.end()
    width, height, top = [*fields, 1][:3]
    depth = 3 if kind in (3, 6) else 1
    count = width * height * depth
    if kind == 4:
        pitch = (width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, pitch * height, at + 1).reshape(height, pitch), axis=1)
        return ((1 - bits[:, :width]) * 255).astype(np.uint8)
    if kind == 1:
        bits = re.sub(rb"#[^\n\r]*[\n\r]|\s", b"", data[at:])[:count]
        return ((1 - (np.frombuffer(bits, np.uint8, count) - 48)) * 255).astype(np.uint8).reshape(height, width)
    if kind in (2, 3):
        plain = re.sub(rb"#[^\n\r]*[\n\r]", b" ", data[at:]).split()[:count]
        values = np.array([int(x) for x in plain], np.uint16)
    else:
        values = np.frombuffer(data, np.uint8 if top < 256 else ">u2", count, at + 1)
    image = values.astype(np.uint8 if top < 256 else np.uint16)
    return image.reshape((height, width, 3) if depth == 3 else (height, width))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 bits with a palette, or 24 or 32 bits; grey palettes give one channel."""
    offset, = struct.unpack_from("<I", data, 10)
    size, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError(f"BMP of {bits} bits, compression {packed}, is not supported")
    rows, pitch = abs(height), (width * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, rows * pitch, offset).reshape(rows, pitch)
    if height > 0:
        raw = raw[::-1]
    if bits > 8:
        return raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1].copy()
    colours, = struct.unpack_from("<I", data, 46)
    palette = np.frombuffer(data, np.uint8, 4 * (colours or 256), 14 + size).reshape(-1, 4)[:, 2::-1]
    if (palette == palette[:, :1]).all():
        return palette[:, 0][raw[:, :width]]
    return palette[raw[:, :width]]


def decode(data: bytes) -> np.ndarray:
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return decode_netpbm(data)
    if data[:2] == b"BM":
        return decode_bmp(data)
    raise ValueError("neither Netpbm nor BMP")


# --- features ---------------------------------------------------------------------------------


def grey(image: np.ndarray) -> np.ndarray:
    """One channel as float64; colours by the usual luma weights."""
    if image.ndim == 3:
        return image[:, :, :3] @ np.array([0.299, 0.587, 0.114])
    return image.astype(np.float64)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the area of each target cell, edges weighted by their share.

    The integral image is bilinear inside a pixel, so reading it between pixels is exact.
    """
    summed = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    np.cumsum(image, axis=0, out=summed[1:, 1:])
    np.cumsum(summed[1:, 1:], axis=1, out=summed[1:, 1:])

    def between(table: np.ndarray, n: int) -> np.ndarray:
        at = np.linspace(0, len(table) - 1, n + 1)
        low = np.minimum(at.astype(int), len(table) - 2)
        share = (at - low)[:, None]
        return table[low] * (1 - share) + table[low + 1] * share

    corners = between(between(summed, height).T, width).T
    cells = np.diff(np.diff(corners, axis=0), axis=1)
    return cells * (height * width / (image.shape[0] * image.shape[1]))


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: does brightness rise from cell to cell in a grid of 8 by 9."""
    cells = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def npy_tile(image: np.ndarray, shape: tuple[int, int] = TILE) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, *shape)), 0, 255).astype(np.uint8))
    return out.getvalue()


# --- operators --------------------------------------------------------------------------------

MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"


def texts_to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as grey samples, 64 to a row, zeros up to a full row.

    Texts with an even number of rows become PGM, others BMP: equal texts give equal bytes. The
    empty (or null) text is one row of zeros. ``docs`` holds (doc_id, text); repeated rows stay.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            media, sizes = [], []
            for text in batch["text"]:
                data = (text or "").encode()
                sizes.append(len(data))
                rows = max(1, -(-len(data) // WIDTH))
                image = np.frombuffer(data.ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH)
                media.append(encode_bmp(image) if rows % 2 else encode_pgm(image))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_bytes": sizes, "media": media})

    return docs.select("doc_id", "text").mapInPandas(run, MEDIA_SCHEMA)


FEATURE_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, tile binary, problem string"
)


def media_features(media: DataFrame) -> DataFrame:
    """Decoded facts of every row of ``media`` (``MEDIA_SCHEMA``); the tile is an NPY file of 32 by 32.

    Bytes that cannot be decoded, or null, give null facts and the reason in ``problem``.
    """
    ship_package(media.sparkSession)
    names = [c.split(" ")[0] for c in FEATURE_SCHEMA.split(", ")]

    def facts(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 7 + ("no media",)
        try:
            image = decode(data)
            if not image.size:
                raise ValueError("image without pixels")
        except (ValueError, OverflowError, struct.error, IndexError) as e:
            return (None, None, None, len(data), hashlib.sha256(data).hexdigest(), None, None, str(e))
        payload, light = image.tobytes(), grey(image)
        return (
            len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data),
            hashlib.sha256(data).hexdigest(), difference_hash(light), npy_tile(light), None,
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, n, *facts(m)) for i, n, m in zip(batch["doc_id"], batch["n_bytes"], batch["media"], strict=True)]
            out = pd.DataFrame(rows, columns=names)
            whole = ["doc_id", "n_bytes", "payload_bytes", "tail_crc32", "media_bytes"]
            out[whole] = out[whole].astype("Int64")
            yield out

    return media.select("doc_id", "n_bytes", "media").mapInPandas(run, FEATURE_SCHEMA)


def feature_digest(features: DataFrame) -> DataFrame:
    """The columns of ``media_features`` with the tile as size and digest."""
    return features.select(
        *[c for c in features.columns if c != "tile"],
        F.length("tile").cast("long").alias("tile_bytes"),
        F.sha2("tile", 256).alias("tile_sha256"),
    )
