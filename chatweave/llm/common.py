"""Helpers that several operators share: folds, stored tables, word hashing, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatweave.plans import session
from chatweave.plans.session import release, store

__all__ = ["components", "fold", "frugal", "give_back", "hash_block", "may_be_among", "mix", "release", "ship_package", "shingles", "store", "table", "texts_of", "word_hashes"]

#: Multiplier of the polynomial hash over the bytes of a word: any odd number will do.
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed at once; a longer text is hashed in parts, cut at white space.
_CHUNK = 1 << 18


#: Bytes that a batch of rows may have on its way to Python, unless the session says otherwise.
_BATCH_BYTES = 4 << 20
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, and texts to them in batches of a few megabytes."""
    session.ship_package(spark)
    if spark.conf.get(_BATCH_SETTING).rstrip("b") == str(_BATCH_DEFAULT):
        spark.conf.set(_BATCH_SETTING, str(_BATCH_BYTES))


def give_back() -> None:
    """Return memory that this process has freed to the system; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim is not None:
        trim(0)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInPandas``; a worker that waits for its next task, maybe of another stage, keeps nothing of this one."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) and nothing else, null text as the empty one: no other column can clash."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is the empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(folds)).cast("int")


# --- hashing ----------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd_inverse(n: int) -> int:
    return pow(n, -1, 1 << 64)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SIGNS = (b"\n", b" ", b"\t", b"\r", b"\x0b", b"\x0c")
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, _CHUNK + 1)
        for name, factor in (("up", int(_BASE)), ("down", _odd_inverse(int(_BASE)))):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def hash_block(block: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, 64-bit hash, last two bytes as one number) of every word of some texts."""
    data = np.frombuffer(b"\n".join(block) + b"\n", np.uint8)
    space = _SPACE[data]
    word = ~space
    starts = np.flatnonzero(word & np.concatenate(([True], space[:-1])))
    ends = np.flatnonzero(space & np.concatenate(([False], word[:-1])))
    up, down = _powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    limits = np.cumsum([len(b) + 1 for b in block])
    last = data[ends - 1].astype(np.int64) * 256 + np.where(ends - starts > 1, data[ends - 2], 0)
    return np.searchsorted(limits, starts, side="right"), hashes, last


def _parts(text: bytes) -> Iterator[bytes]:
    """Parts of a long text, cut where words are; only a longer word makes a part longer than ``_CHUNK``."""
    at = 0
    while at < len(text):
        to = min(at + _CHUNK, len(text))
        if to < len(text):
            cut = max(text.rfind(sign, at, to) for sign in _SIGNS)
            if cut <= at:
                after = [i for sign in _SIGNS if (i := text.find(sign, to)) >= 0]
                cut = min(after, default=len(text))
            to = cut
        yield text[at:to]
        at = to


def word_hashes(texts: Iterable[bytes]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(index of the first text, 64-bit hashes of the words of each text) block by block.

    Words are what white space (bytes 9 to 13 and 32) separates. Texts are taken one by one as they
    are hashed, so a generator need not hold them together.
    """
    at, block, size = 0, [], 0

    def hashed() -> tuple[int, list[np.ndarray]]:
        owner, hashes, _ = hash_block(block)
        return at, np.split(hashes, np.searchsorted(owner, np.arange(1, len(block))))

    for text in texts:
        if block and size + len(text) >= _CHUNK:
            yield hashed()
            at, block, size = at + len(block), [], 0
        if len(text) >= _CHUNK:
            yield at, [np.concatenate([hash_block([part])[1] for part in _parts(text)])]
            at += 1
        else:
            block.append(text)
            size += len(text) + 1
    if block:
        yield hashed()


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; a shorter text has one run of all its words, an empty one none."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix(out * _BASE + words[i : i + n])
    return out


# --- few rows among many ----------------------------------------------------------------------

#: Bits of the filter per key, and most bits (16 MB): beyond, more rows pass that need not.
_BITS_PER_KEY = 16
_MOST_BITS = 1 << 27


def may_be_among(key: Column, keys: DataFrame) -> Column:
    """Whether a row's ``key`` (a long) may be one of the only column of ``keys``, by two bits of a filter that tasks hold.

    True for every key there is. Rows that it leaves out need no shuffle to find out that they have
    no partner.
    """
    spark = keys.sparkSession
    number = F.col(keys.columns[0])
    n = keys.count()
    bits = 1 << max(10, min(_MOST_BITS, _BITS_PER_KEY * max(n, 1)).bit_length() - 1)
    place = F.explode(F.array(F.pmod(F.xxhash64(number), F.lit(bits)), F.pmod(F.xxhash64(number, F.lit(1)), F.lit(bits))))
    words = keys.select(place.alias("p")).groupBy(F.expr("p div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 AS int))")).alias("set"))
    table = np.zeros(bits // 64, np.uint64)
    found = words.toPandas()  # at most _MOST_BITS / 64 numbers
    table[found["word"].to_numpy(np.int64)] = found["set"].to_numpy(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def seen(first: pd.Series, second: pd.Series) -> pd.Series:
        found = np.ones(len(first), bool)
        for p in (first.to_numpy(), second.to_numpy()):
            found &= (shared.value[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return pd.Series(found)

    return seen(F.pmod(F.xxhash64(key), F.lit(bits)), F.pmod(F.xxhash64(key, F.lit(1)), F.lit(bits)))


# --- connected components ---------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable, for every node of ``edges`` (a, b).

    Alternates large-star and small-star steps. Each step is a minimum per node, which Spark
    reduces before it shuffles, and a join; nothing per node is ever collected. Every round is
    written to the shared folder, so a lost executor costs one round.
    """
    a, b = F.col("a"), F.col("b")
    links = store(edges.where(a != b).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct())
    seen = None
    while True:
        both = links.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(
            links.select(F.col("u").alias("x"), F.col("v").alias("y"))
        )
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u"))
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array(
            F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u"))
        )).alias("e")).select("e.v", "e.u").where("v <> u").distinct()
        after = store(small)
        release(links)
        links = after
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = links.groupBy("v").agg(F.min("u").alias("component")).select(F.col("v").alias("node"), "component")
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())
