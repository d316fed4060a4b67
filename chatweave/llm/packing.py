"""Best-fit packing (operator 6): a configuration linear program over the length histogram.

Documents become token ids and then pieces of at most ``capacity`` tokens. Only the histogram of
piece lengths (at most ``capacity`` numbers) reaches the driver. There multiplicative weights solve
the configuration program: prices per length, a knapsack over the capacity finds the dearest
pattern, lengths it serves get cheaper. The rounded patterns and a best-fit rest make a plan of
intervals "pieces number i to j of length L go to these sequences at this offset". Tasks place
their pieces by looking up length and number.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatweave.llm.common import frugal, give_back, ship_package, store

CAPACITY = 2048
END_ID = 0
ROUNDS = 400
#: Rounds that a length takes to be served wholly, at least.
STEPS = 4
#: How far a length's price can rise above its share of a sequence while it lags behind.
WEIGHT = 0.5
#: Pieces numbered by one task; more pieces of one length are numbered by more tasks.
NUMBERED_AT_ONCE = 200_000

# --- tokens -----------------------------------------------------------------------------------

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


class ByteTokenizer:
    """Token ids of texts as little-endian bytes, loaded once per worker process.

    The vocabulary is the named ``tokenizers`` file. Where the same vocabulary lies beside it as
    ranks (``.tiktoken``), that library encodes with it, four times faster and with equal ids;
    texts that hold an added token (``<|endoftext|>``) or runs of white space too long for it, and
    vocabularies without ranks, go through ``tokenizers`` as the file sets it up. That one is not
    kept until such a text comes: a worker holds one form of the vocabulary, not two.
    """

    _loaded: dict[str, ByteTokenizer] = {}
    #: White space that is given to the faster library in one run, at most.
    LONGEST_RUN = re.compile(r"\s{2000}")

    @classmethod
    def load(cls, path: str) -> ByteTokenizer:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str) -> None:
        self._path, self._fast = path, None
        self._added = [token.content for token in self._plain.get_added_tokens_decoder().values()]
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            del self._plain
            give_back()
            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    @cached_property
    def _plain(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self._path)

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` with no special tokens put around it, four bytes each."""
        if self._fast is None or any(token in text for token in self._added) or self.LONGEST_RUN.search(text):
            return np.array(self._plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self._fast.encode_ordinary(text), "<u4").tobytes()


def cut_pieces(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: whole ones, the first takes what is over."""
    first = length - (length - 1) // capacity * capacity
    return [(0, first), *[(s, capacity) for s in range(first, length, capacity)]]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (``PIECE_SCHEMA``) of ``docs`` (doc_id, text): token ids and one end id, cut where too long.

    Null text is empty: its document is the end id alone. Repeated rows give repeated pieces.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = ByteTokenizer.load(tokenizer_path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                ids = tokenizer.encode(text or "") + end
                for i, (start, length) in enumerate(cut_pieces(len(ids) // 4, capacity)):
                    rows.append((doc, i, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(frugal(run), PIECE_SCHEMA)


# --- plan -------------------------------------------------------------------------------------


def dearest_pattern(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """How often each length is in the pattern of the highest price (knapsack by dynamic programming)."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    ends = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        k = ends[c]
        if k:
            values = best[c - lengths[:k]] + prices[:k]
            top = int(values.argmax())
            if values[top] > best[c] + 1e-15:
                best[c], choice[c] = values[top], top
    counts = np.zeros(len(lengths), np.int64)
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= lengths[choice[c]]
    return counts


def fractional_patterns(
    lengths: np.ndarray, need: np.ndarray, capacity: int, steps: int, rounds: int
) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used, serving every length as often as needed.

    Multiplicative weights for the covering program: the price of a length falls exponentially
    with the share of its need that is met. Each round buys the dearest pattern, one step (a share
    of 1/steps) of the need of the length it serves best. A length that is wholly met is not sold
    any more, so nothing is served too often. Buying ends when even the dearest pattern leaves
    room: what is left then packs better one by one.
    """
    left = need.astype(float)
    rate = 2.0 * np.log(len(lengths) + 2)
    bought: dict[bytes, list] = {}
    base = lengths / capacity
    for _ in range(rounds):
        open_ = np.flatnonzero(left > 1e-9)
        if not len(open_):
            break
        lag = left[open_] / need[open_]
        prices = base[open_] * (1 + WEIGHT * (np.exp(rate * (lag - lag.max())) - 0.5))
        counts = dearest_pattern(lengths[open_], prices, capacity)
        used = counts > 0
        at, times = open_[used], counts[used]
        if lengths[at] @ times < capacity:
            break
        amount = min((need[at] / times).min() / steps, (left[at] / times).min())
        amount = max(amount, min(1.0, (left[at] / times).min()))
        left[at] -= amount * times
        left[left < 1e-9] = 0
        pattern = np.zeros(len(lengths), np.int64)
        pattern[at] = times
        entry = bought.setdefault(pattern.tobytes(), [pattern, 0.0])
        entry[1] += amount
    return [(p, a) for p, a in bought.values()]


def best_fit(lengths: np.ndarray, need: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns of best fit, longest first: bins are told apart by the room left in them only."""
    rooms: dict[int, dict[tuple, int]] = {}
    for i in np.argsort(-lengths):
        size, todo = int(lengths[i]), int(need[i])
        while todo:
            room = next((r for r in sorted(rooms) if r >= size), None)
            if room is None:
                content, bins, room = (), todo, capacity
                fit = max(1, min(capacity // size, todo))
                whole, rest = divmod(todo, fit)
                for n, k in ((fit, whole), (rest, 1 if rest else 0)):
                    if k:
                        shelf = rooms.setdefault(capacity - n * size, {})
                        key = ((int(i), n),)
                        shelf[key] = shelf.get(key, 0) + k
                break
            content, bins = rooms[room].popitem()
            if not rooms[room]:
                del rooms[room]
            taken = min(bins, todo)
            todo -= taken
            if taken < bins:
                rooms.setdefault(room, {})[content] = bins - taken
            key = (*content, (int(i), 1))
            shelf = rooms.setdefault(room - size, {})
            shelf[key] = shelf.get(key, 0) + taken
    out = []
    for shelf in rooms.values():
        for content, bins in shelf.items():
            pattern = np.zeros(len(lengths), np.int64)
            for i, n in content:
                pattern[i] += n
            out.append((pattern, bins))
    return out


def whole_patterns(lengths: np.ndarray, need: np.ndarray, capacity: int, steps: int = STEPS, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """Patterns that hold every piece exactly once: the program's, rounded down, then best fit for the rest."""
    kept = [(p, int(a)) for p, a in fractional_patterns(lengths, need, capacity, steps, rounds) if a >= 1]
    rest = need - sum((p * a for p, a in kept), np.zeros(len(lengths), np.int64))
    return kept + best_fit(lengths, rest, capacity)


# --- placing ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Plan:
    """Intervals in order of (length, first): pieces number ``first`` and on of a length lie
    ``each`` to a sequence, from sequence ``sequence`` on, the first of them at ``offset``."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by their length and number (from 0) within it."""
        most = int(max(self.first.max(initial=0), number.max(initial=0))) + 1
        i = np.searchsorted(self.length * most + self.first, length * most + number, side="right") - 1
        at = number - self.first[i]
        return self.sequence[i] + at // self.each[i], self.offset[i] + at % self.each[i] * length


def make_plan(lengths: np.ndarray, need: np.ndarray, capacity: int) -> Plan:
    """Plan for ``need`` pieces of each length; whole sequences first, they take no searching."""
    order = np.argsort(lengths)
    lengths, need = lengths[order].astype(np.int64), need[order].astype(np.int64)
    rows, sequence = [], 0
    served = np.zeros(len(lengths), np.int64)
    part = lengths < capacity
    for i in np.flatnonzero(~part):
        rows.append((lengths[i], 0, 1, sequence, 0))
        sequence += need[i]
    small = np.flatnonzero(part)
    for pattern, times in whole_patterns(lengths[small], need[small], capacity) if len(small) else ():
        offset = 0
        for i in np.flatnonzero(pattern):
            k = small[i]
            rows.append((lengths[k], served[k], pattern[i], sequence, offset))
            served[k] += pattern[i] * times
            offset += pattern[i] * lengths[k]
        sequence += times
    rows.sort()
    return Plan(*(np.array(c, np.int64) for c in zip(*rows, strict=True))) if rows else Plan(*[np.zeros(0, np.int64)] * 5)


def numbered(pieces: DataFrame, n_pieces: int) -> DataFrame:
    """``pieces`` with ``number``, from 0 within each length.

    A length may belong to a third of all pieces, so each is dealt over ``parts`` tasks by a hash
    of the piece and numbered there; sums over the small table of counts per (length, part) give
    the number each part begins with.
    """
    parts = -(-n_pieces // NUMBERED_AT_ONCE)
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    counts = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    return (
        dealt.withColumn("_n", F.row_number().over(within) - 1)
        .join(begins, ["length", "part"])
        .withColumn("number", F.col("_n") + F.col("begin"))
        .drop("_n", "begin", "part")
    )


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of ``docs`` (doc_id, text) with its sequence and offset.

    Columns of ``PIECE_SCHEMA`` and ``sequence_id``, ``offset``. Every sequence is filled from 0
    without gaps and holds at most ``capacity`` tokens. No document: no row.
    """
    pieces = store(token_pieces(docs, tokenizer_path, capacity))
    histogram = pieces.groupBy("length").agg(F.count("*").alias("n")).toPandas()  # at most ``capacity`` rows
    plan = make_plan(histogram["length"].to_numpy(), histogram["n"].to_numpy(), capacity)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = plan.place(batch["length"].to_numpy(), batch["number"].to_numpy())
            yield batch[names].assign(doc_id=batch["doc_id"].astype("Int64"), sequence_id=sequence, offset=offset)

    return numbered(pieces, max(1, int(histogram["n"].sum()))).select(*names, "number").mapInPandas(
        frugal(run), f"{PIECE_SCHEMA}, sequence_id long, offset long"
    )
