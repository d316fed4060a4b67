"""Phrase collocation mining (operator 11): weighted acyclic automata over word n-grams.

Shards of text give sorted windows of five words, and from each a minimal acyclic automaton is
built whose paths carry counts (a count transducer). It is cut by prefix ranges. The transducers of
one range are united: their paths are merged and the weights summed, so that the sum below a prefix
is the count of that prefix. What is frequent is kept. Scores need the counts of the parts of a
phrase: parts are composed with the count transducer of their range.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatweave.llm.common import mix, release, ship_package, store

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
#: Words of one transducer; bytes of text gathered before they are built; words of one range, about.
SHARD_WORDS = 1 << 19
SHARD_BYTES = 4 << 20
RANGE_WORDS = 2 << 20
#: One window in so many is in the sample that only places the borders of ranges.
SAMPLE_STRIDE, SAMPLE_SHARE = 1600, 20
#: Most borders that tasks are given (about 60 bytes each); larger corpora get larger ranges.
MOST_RANGES = 1 << 20
#: Windows merged at once while a range is united, n-grams of one transducer when parts are looked up.
MERGE_AT = 1 << 20
LOOKUP_BLOCK = 1 << 16
#: Parts that the phrases of a language are dealt to.
SHARES = 64

#: What parts pieces becomes a full stop, which no word can hold.
_TABLE = bytes(
    ord(".") if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words of a text; ``b"."`` follows each piece."""
    words = (text or "").encode().translate(_TABLE).replace(b".", b" . ").split(b" ")
    return [w for w in words if w] + [b"."]


# --- transducers over windows -----------------------------------------------------------------


def _bounds(keys: list[np.ndarray]) -> np.ndarray:
    """Where a row differs from the one before it in any of ``keys``; the first row does."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def summed(columns: list[np.ndarray], counts: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Windows in order, each once, with the sum of their counts (None: one each)."""
    if len(columns[0]) and max(int(c.max()) for c in columns) < 1 << 21:
        keys = [np.zeros(len(columns[0]), np.int64), np.zeros(len(columns[0]), np.int64)]
        for key, part in zip(keys, (columns[:3], columns[3:]), strict=True):
            for c in part:
                key <<= 21
                key |= c
    else:
        keys = columns
    order = np.lexsort(keys[::-1])
    starts = np.flatnonzero(_bounds([k[order] for k in keys])) if len(order) else np.zeros(0, np.int64)
    del keys
    first = order[starts]
    sums = np.diff(np.append(starts, len(order))) if counts is None else np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]
    return [c[first] for c in columns], sums


def _share_states(starts: np.ndarray, labels: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each state after equal ones are made one, the states kept); a state is its arcs from ``starts`` on."""
    ends = np.append(starts[1:], len(labels))
    sizes = ends - starts
    place = np.arange(len(labels)) - np.repeat(starts, sizes)
    with np.errstate(over="ignore"):
        arcs = mix(mix(labels.astype(np.uint64) + np.uint64(1)) + values.astype(np.uint64) * np.uint64(3) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        sign = np.add.reduceat(arcs, starts) + sizes.astype(np.uint64)
    _, first, which = np.unique(sign, return_index=True, return_inverse=True)
    like = first[which]
    # Equal signs may lie: a state that is not equal to its model arc by arc stays its own.
    same = sizes[like] == sizes
    sure = np.repeat(same, sizes)
    at = np.where(sure, np.repeat(starts[like], sizes) + place, 0)
    equal = sure & (labels[at] == labels) & (values[at] == values)
    like = np.where(np.logical_and.reduceat(equal, starts), like, np.arange(len(starts)))
    kept = np.flatnonzero(like == np.arange(len(starts)))
    number = np.zeros(len(starts), np.int64)
    number[kept] = np.arange(len(kept))
    return number[like], kept


def _small(values: np.ndarray) -> np.ndarray:
    top = int(values.max()) if len(values) else 0
    return values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def build(columns: list[np.ndarray], counts: np.ndarray, dictionary: pa.Array) -> bytes:
    """Minimal acyclic automaton of sorted distinct windows, the count on the last arc.

    A new state begins where the common prefix with the window before ends; a state is complete
    once the next prefix differs, and equal complete states are one. All states of a depth are
    completed together, the deepest first. Label 0 ends a window early; ``dictionary[i - 1]`` is
    the word of label i.
    """
    used = np.unique(np.concatenate([np.unique(c) for c in columns]))
    used = used[used > 0]
    columns = [np.searchsorted(used, c, side="right") for c in columns]
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    labels, values, nodes = columns[-1], counts, np.arange(len(counts))
    for depth in range(LONGEST - 1, 0, -1):
        heads = np.flatnonzero(_bounds([c[nodes] for c in columns[:depth]]))
        number, kept = _share_states(heads, labels, values)
        sizes = np.diff(np.append(heads, len(labels)))
        take = np.repeat(heads[kept] - np.concatenate(([0], np.cumsum(sizes[kept])[:-1])), sizes[kept]) + np.arange(sizes[kept].sum())
        levels.append((labels[take], values[take], sizes[kept]))
        nodes = nodes[heads]
        labels, values = columns[depth - 1][nodes], number
    levels.append((labels, values, np.array([len(labels)])))
    words = b" ".join(dictionary.take(pa.array(used - 1)).to_pylist())
    parts = [_small(a) for level in levels[::-1] for a in level]
    head = b"".join(struct.pack("<cI", str(a.itemsize).encode(), len(a)) for a in parts)
    return struct.pack("<I", len(words)) + words + head + b"".join(a.tobytes() for a in parts)


def paths(data: bytes) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    """(words, label columns, counts) of all windows of a transducer."""
    (size,) = struct.unpack_from("<I", data)
    words = data[4 : 4 + size].split(b" ") if size else []
    at, arrays, heads = 4 + size, [], []
    for i in range(3 * LONGEST):
        kind, n = struct.unpack_from("<cI", data, at + 5 * i)
        heads.append((f"<u{int(kind)}", n))
    at += 5 * len(heads)
    for kind, n in heads:
        arrays.append(np.frombuffer(data, kind, n, at))
        at += arrays[-1].nbytes
    columns, state = [arrays[0].astype(np.uint32)], arrays[1].astype(np.int64)
    for depth in range(1, LONGEST):
        labels, values, sizes = arrays[3 * depth : 3 * depth + 3]
        sizes = sizes.astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        n = sizes[state]
        arc = np.repeat(starts[state] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        columns = [np.repeat(c, n) for c in columns] + [labels[arc].astype(np.uint32)]
        state = values[arc].astype(np.int64)
    return words, columns, state


def windows_of(words: list[bytes]) -> Iterator[tuple[list[np.ndarray], np.ndarray, pa.Array]]:
    """(sorted distinct windows, counts, sorted dictionary) for each ``SHARD_WORDS`` words."""
    for i in range(0, len(words), SHARD_WORDS):
        # The windows of the last words reach into the next shard.
        coded = pa.array(words[i : i + SHARD_WORDS + LONGEST - 1], pa.binary()).dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary).to_numpy()
        order = order[np.array(coded.dictionary.take(pa.array(order)).to_numpy(zero_copy_only=False) != b".", bool)]
        rank = np.zeros(len(coded.dictionary), np.uint32)
        rank[order] = np.arange(1, len(order) + 1, dtype=np.uint32)
        line = np.concatenate((rank[coded.indices.to_numpy()], np.zeros(LONGEST - 1, np.uint32)))
        at = np.flatnonzero(line[: min(SHARD_WORDS, len(words) - i)])
        if not len(at):
            continue
        columns = [line[at]]
        for k in range(1, LONGEST):
            columns.append(np.where(columns[-1] > 0, line[at + k], np.uint32(0)))
        columns, counts = summed(columns, None)
        yield columns, counts, coded.dictionary.take(pa.array(order))


Border = tuple[bytes, ...]


def _cut(columns: list[np.ndarray], dictionary: list[bytes], border: Border) -> int:
    """How many of the sorted windows come before ``border``."""
    at: list[int] = []
    for word in border:
        place = bisect_left(dictionary, word)
        known = place < len(dictionary) and dictionary[place] == word
        at.append(0 if word == b"" else 2 * place + (2 if known else 1))
    want = tuple(at)
    low, high = 0, len(columns[0])
    while low < high:
        middle = (low + high) // 2
        if tuple(2 * int(c[middle]) for c in columns) < want:
            low = middle + 1
        else:
            high = middle
    return low


def shard_pieces(words: list[bytes], borders: list[Border]) -> Iterator[tuple[int, bytes]]:
    """(range, transducer) of the words of one language; range i lies between border i - 1 and border i."""
    for columns, counts, dictionary in windows_of(words):
        listed = dictionary.to_pylist()
        limits = [0, *[_cut(columns, listed, b) for b in borders], len(counts)]
        for i, (a, b) in enumerate(zip(limits, limits[1:])):
            if a < b:
                yield i, build([c[a:b] for c in columns], counts[a:b], dictionary)


class Union:
    """Sum of the transducers of one range, merged little by little."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}
        self._waiting: list[tuple[list[np.ndarray], np.ndarray]] = []
        self._n = self._merged = 0

    def add(self, data: bytes) -> None:
        words, columns, counts = paths(data)
        ids = self.ids
        number = np.array([0, *[ids.setdefault(w, len(ids) + 1) for w in words]], np.uint32)
        self._waiting.append(([number[c] for c in columns], counts))
        self._n += len(counts)
        if self._n - self._merged > max(MERGE_AT, self._merged):
            self._merge()

    def _merge(self) -> None:
        if len(self._waiting) > 1:
            columns = [np.concatenate([w[0][k] for w in self._waiting]) for k in range(LONGEST)]
            counts = np.concatenate([w[1] for w in self._waiting])
            self._waiting.clear()
            self._waiting = [summed(columns, counts)]
        else:
            self._waiting = [summed(*w) for w in self._waiting]
        self._n = self._merged = sum(len(w[1]) for w in self._waiting)

    def frequent(self, least: int, borders: list[Border]) -> Iterator[tuple[str, int, int]]:
        """(phrase, words, count): the empty phrase with the count of all words, prefixes with at least
        ``least``, and those of a border whatever their count: other ranges may have more of them."""
        self._merge()
        if not self._waiting:
            return
        columns, counts = self._waiting[0]
        yield "", 0, int(counts.sum())
        names = [b"", *self.ids]
        cut = [[self.ids.get(w, 0) for w in b] for b in borders]
        for depth in range(1, LONGEST + 1):
            heads = np.flatnonzero(_bounds(columns[:depth]))
            sums = np.add.reduceat(counts, heads)
            wanted = sums >= least
            for ids in cut:
                if all(ids[:depth]):
                    wanted |= np.logical_and.reduce([columns[k][heads] == ids[k] for k in range(depth)])
            wanted &= columns[depth - 1][heads] > 0
            for head, f in zip(heads[wanted], sums[wanted], strict=True):
                yield b" ".join(names[int(columns[k][head])] for k in range(depth)).decode(), depth, int(f)


# --- transducers over n-grams -----------------------------------------------------------------


class State:
    __slots__ = ("arcs", "weight")

    def __init__(self) -> None:
        self.arcs: dict[str, State] = {}
        self.weight: int | None = None


class Transducer:
    """Minimal acyclic automaton with final weights, built incrementally from sorted n-grams."""

    def __init__(self) -> None:
        self.start = State()
        self._register: dict[tuple, State] = {}
        self._open: list[tuple[State, str, State]] = []
        self._last: list[str] = []

    def add(self, words: list[str], weight: int) -> None:
        common = 0
        while common < min(len(words), len(self._last)) and words[common] == self._last[common]:
            common += 1
        self._close(common)
        state = self._open[-1][2] if self._open else self.start
        for word in words[common:]:
            state.arcs[word] = to = State()
            self._open.append((state, word, to))
            state = to
        state.weight = weight
        self._last = words

    def finish(self) -> Transducer:
        self._close(0)
        return self

    def _close(self, depth: int) -> None:
        """States below ``depth`` of the last n-gram are complete: equal ones become one."""
        while len(self._open) > depth:
            state, word, to = self._open.pop()
            sign = (to.weight, tuple((w, id(s)) for w, s in to.arcs.items()))
            state.arcs[word] = self._register.setdefault(sign, to)


def compose(asked: Transducer, counts: Transducer) -> Iterator[tuple[str, int]]:
    """(n-gram, its weight in ``counts``) of all n-grams in both: a walk over pairs of states."""
    waiting = [("", asked.start, counts.start)]
    while waiting:
        path, a, b = waiting.pop()
        if a.weight is not None and b.weight is not None:
            yield path, b.weight
        for word, to in a.arcs.items():
            if word in b.arcs:
                waiting.append((f"{path} {word}" if path else word, to, b.arcs[word]))


# --- jobs -------------------------------------------------------------------------------------


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def range_borders(docs: DataFrame) -> dict[str, list[Border]]:
    """Borders of the prefix ranges of each language: Spark's range partitions of a sample of windows.

    They set how work is dealt out and nothing else. At most ``MOST_RANGES`` borders reach the driver.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = min(MOST_RANGES, -(-size // (6 * RANGE_WORDS)))
    if ranges <= 1:
        return {}

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for lang, text, place in zip(batch["lang"], batch["text"], batch["place"], strict=True):
                words = words_of(text)
                for i in range(int(place), len(words), SAMPLE_STRIDE // SAMPLE_SHARE):
                    window = words[i : i + LONGEST]
                    window = window[: window.index(b".")] if b"." in window else window
                    if window:
                        found.append((lang, [w.decode() for w in window]))
            yield pd.DataFrame(found, columns=["lang", "words"])

    place = F.xxhash64("text")
    some = store(
        docs.where(F.pmod(place, F.lit(SAMPLE_SHARE)) == 0)
        .select("lang", "text", F.pmod(F.xxhash64(place), F.lit(SAMPLE_STRIDE // SAMPLE_SHARE)).alias("place"))
        .mapInPandas(sample, "lang string, words array<string>")
    )
    parts = some.repartitionByRange(ranges, "lang", "words").groupBy(F.spark_partition_id().alias("part"))
    firsts = parts.agg(F.min(F.struct("lang", "words")).alias("first")).select("first.*").collect()
    release(some)
    borders: dict[str, list[Border]] = {}
    for lang, words in sorted(firsts, key=lambda r: (r.lang, [w.encode() for w in r.words]))[1:]:
        borders.setdefault(lang, []).append(tuple(w.encode() for w in words) + (b"",) * (LONGEST - len(words)))
    return borders


def phrase_counts(docs: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """(lang, phrase, words, f) of all phrases of 1 to 5 words with at least ``least`` occurrences, and for each
    language the empty phrase with its number of words; ``docs`` (lang, text) as ``collocations`` takes them."""
    ship_package(docs.sparkSession)
    texts = _texts(docs)
    borders = range_borders(texts)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[str]] = {}
        size = 0

        def built() -> Iterator[pa.RecordBatch]:
            while waiting:
                lang, lines = waiting.popitem()
                words = [w for line in lines for w in words_of(line)]
                del lines
                for i, data in shard_pieces(words, borders.get(lang, [])):
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([i], pa.int32()), pa.array([data])], ["lang", "part", "data"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang, text = lang.as_py(), text.as_py()  # one by one: a batch may hold long texts
                waiting.setdefault(lang, []).append(text)
                size += len(text)
                if size >= SHARD_BYTES:
                    yield from built()
                    size = 0
        yield from built()

    def united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, union = None, Union()

        def done() -> pd.DataFrame:
            limits = borders.get(now[0], [])[max(0, now[1] - 1) : now[1] + 1]
            rows = [(now[0], *row) for row in union.frequent(least, limits)]
            return pd.DataFrame(rows, columns=["lang", "phrase", "words", "f"])

        for batch in batches:
            for lang, part, data in zip(batch["lang"], batch["part"], batch["data"], strict=True):
                if now != (lang, part):
                    if now is not None:
                        yield done()
                    now, union = (lang, part), Union()
                union.add(data)
        if now is not None:
            yield done()

    n = max(1, sum(map(len, borders.values())) + 1)
    pieces = texts.mapInArrow(shards, "lang string, part int, data binary")
    return (
        pieces.repartition(n, "lang", "part").sortWithinPartitions("lang", "part")
        .mapInPandas(united, "lang string, phrase string, words int, f long")
        .groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
        .where((F.col("f") >= least) | (F.col("words") == 0))
    )


def part_counts(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, phrase, f) of the phrases of ``parts`` (lang, phrase; distinct) that ``counts`` has.

    Both are sorted by range; a block of sorted phrases becomes two automata, which are composed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last, n = None, None, 0
        asked, known = Transducer(), Transducer()

        def found() -> pd.DataFrame:
            rows = [(now, *row) for row in compose(asked.finish(), known.finish())]
            return pd.DataFrame(rows, columns=["lang", "phrase", "f"])

        for batch in batches:
            for lang, phrase, f in zip(batch["lang"], batch["phrase"], batch["f"], strict=True):
                if lang != now or (n >= LOOKUP_BLOCK and phrase != last):
                    if n:
                        yield found()
                    asked, known, n = Transducer(), Transducer(), 0
                now, last, n = lang, phrase, n + 1
                (asked if f < 0 else known).add(phrase.split(" "), int(f))
        if n:
            yield found()

    both = counts.select("lang", "phrase", "f").unionByName(parts.select("lang", "phrase", F.lit(-1).cast("long").alias("f")))
    return both.repartitionByRange("lang", "phrase").sortWithinPartitions("lang", "phrase", "f").mapInPandas(run, "lang string, phrase string, f long")


def collocations(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language of ``docs`` (lang, text).

    Null lang is ``und``, null text empty; neither empty texts nor pieces give words. Repeated rows
    count each time. Extra columns are ignored. An empty table, or one without frequent phrases, gives none.
    Scores are exact (decimal arithmetic of 38 digits).
    """
    counts = store(phrase_counts(docs, least))
    known = counts.where("words > 0")
    candidates = known.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    split = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", "a", split.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("right"),
    )
    asked = cuts.select("lang", F.explode(F.array("left", "right")).alias("phrase")).distinct()
    found = store(part_counts(asked, known))
    side = {s: found.select(F.col("lang"), F.col("phrase").alias(s), F.col("f").alias(f)) for s, f in (("left", "l"), ("right", "r"))}
    # A language may have most phrases, so its number of words is repeated for shares of them.
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES)).alias("share")
    n = counts.where("words = 0").select("lang", F.col("f").alias("n"), F.explode(F.expr(f"sequence(0L, {SHARES - 1}L)")).alias("share"))
    product = F.col("a").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)") * F.lit(1000)
    parts = F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(19,0)")
    scored = (
        cuts.join(side["left"], ["lang", "left"]).join(side["right"], ["lang", "right"])
        .withColumn("share", share).join(n, ["lang", "share"])
        .withColumn("product", product).withColumn("parts", parts)
        .select("lang", "phrase", "a", F.struct(F.expr("product div parts").alias("score"), "k", "l", "r", "n").alias("cut"))
        .groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.n", "cut.score")
    )
    # A longer candidate with the same count has one of one word more between, which has that count too.
    shorter = candidates.where("words > 2").select(
        "lang", "a", F.explode(F.array(
            F.array_join(F.slice(split, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(split, F.lit(2), F.col("words") - 1), " ")
        )).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(shorter, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a").drop("longer")
    order = F.desc("score"), F.desc("a"), "phrase"
    some = Window.partitionBy("lang", "share").orderBy(*order)
    first = kept.withColumn("share", share).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    ranked = first.drop("rank").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_sql(least: int = MIN_COUNT, top: int = TOP) -> str:
    """The same rows in SQL, with phrases as joined words."""
    return f"""
WITH pieces AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM (
    SELECT coalesce(lang, 'und') AS lang,
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, len, array_to_string(w[i : i + len - 1], ' ') AS phrase FROM (
    SELECT lang, w, i, unnest(range(1, least({LONGEST}, len(w) - i + 1) + 1)) AS len FROM (
      SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists WHERE len(w) > 0))
), totals AS (
  SELECT lang, count(*) AS n FROM grams WHERE len = 1 GROUP BY lang
), f AS (
  SELECT lang, phrase, len, count(*) AS f FROM grams GROUP BY lang, phrase, len HAVING count(*) >= {least}
), cuts AS (
  SELECT lang, phrase, f AS a, w, unnest(range(1, len)) AS k FROM (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE len > 1)
), scores AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, t.n,
    (1000 * c.a::HUGEINT * t.n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score
  FROM cuts c JOIN totals t USING (lang)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1 :], ' ')
), lowest AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT DISTINCT lang, phrase, f FROM (
    SELECT lang, f, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM (
      SELECT lang, f, len, w, m, unnest(range(1, len - m + 2)) AS i FROM (
        SELECT lang, f, len, string_split(phrase, ' ') AS w, unnest(range(2, len)) AS m FROM f WHERE len > 2)))
), kept AS (
  SELECT s.* FROM lowest s WHERE NOT EXISTS (
    SELECT 1 FROM inside i WHERE i.lang = s.lang AND i.phrase = s.phrase AND 100 * i.f >= 100 * s.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= {top}"""
