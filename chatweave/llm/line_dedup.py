"""Line dedup (operator 1): repeated runs of lines, found with a suffix array of line ids.

The corpus is one sequence of lines per document (blank lines do not count). Prefix doubling ranks
all suffixes by their first 1, 2, 4, ... lines: a round joins each suffix to the one a power of two
further on, sorts the distinct pairs of ranks and numbers them in order, which is the suffix array
of that depth. Suffixes with a unique rank drop out. Every line starts a window, the fewest lines
that hold ``min_words`` words; suffixes that share a window are an interval of the suffix array whose
longest common prefix is at least the window. Its first position stays, later ones are copies, and
the common prefix is extended line by line to the maximal run. Copies are deleted.

No run of ``min_words`` words has more lines than words, so log2(min_words) rounds are enough for
documents of any length. What is shuffled is narrow: ids, numbers and hashes, except for the texts
that may lose lines: a filter finds these before the last join. A document is a doc_id with the
hash ``t`` of its text, so rows of one id with different texts are documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatweave.llm.common import frugal, may_be_among, release, ship_package, store

#: Words of the shortest run that counts as a passage.
MIN_WORDS = 50

LINE_SCHEMA = "doc_id long, t long, seq int, line_no int, h1 long, h2 long, window int, tails array<long>"
_ROWS_AT_ONCE = 4096
_EDGES = b" \t\n\r\x0b\x0c"


def _lines(text: str) -> list[tuple[int, bytes]]:
    """(line number, line without white space around it) of lines that are not blank."""
    stripped = ((i, line.strip(_EDGES)) for i, line in enumerate(text.encode().split(b"\n")))
    return [(i, line) for i, line in stripped if line]


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def numbered_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``LINE_SCHEMA``: hash (128 bits) of each line, lines in its window (0: too few words follow), and for
    the lines after the window, as far as they have fewer than ``min_words`` words, a hash of all up to each."""
    ship_package(docs.sparkSession)
    names = [c.split(" ")[0] for c in LINE_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, t, text in zip(batch["doc_id"], batch["t"], batch["text"], strict=True):
                lines = _lines(text or "")
                digests = [hashlib.blake2b(line, digest_size=16).digest() for _, line in lines]
                upto = np.cumsum([0, *[len(line.split()) for _, line in lines]])
                ends = np.searchsorted(upto, upto[:-1] + min_words)  # first line after the window
                lasts = np.searchsorted(upto, upto[np.minimum(ends, len(lines))] + min_words) - 1
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                for s, (line_no, _) in enumerate(lines):
                    tails, end = [], int(ends[s])
                    if end > len(lines):
                        window = 0
                    else:
                        window, seen = end - s, hashlib.blake2b(digest_size=8)
                        for digest in digests[end : min(int(lasts[s]), len(lines))]:
                            seen.update(digest)
                            tails.append(int.from_bytes(seen.digest(), "little", signed=True))
                    rows.append((doc, t, s, line_no, halves[s, 0], halves[s, 1], window, tails))
                    if len(rows) == _ROWS_AT_ONCE:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            yield pd.DataFrame(rows, columns=names)

    return docs.where("doc_id IS NOT NULL").select("doc_id", _text_hash().alias("t"), "text").mapInPandas(frugal(run), LINE_SCHEMA)


def _ranked(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rank): distinct keys that occur more than once, numbered in their order.

    The sort deals keys to ranges, so no group of equal first keys meets in one task, and numbers
    rise from range to range.
    """
    repeated = keyed.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    return store(repeated.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()))


def shared_windows(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, t, seq, depth, a, b) of windows of ``lines`` whose lines are all repeated; equal
    (depth, a, b) mean equal windows. ``depth`` is the number of lines."""
    ranks = _ranked(lines, ["h1", "h2"])
    level = store(lines.join(ranks, ["h1", "h2"]).select("doc_id", "t", "seq", "window", F.col("rank").alias("a")))
    longest = lines.agg(F.max("window")).first()[0] or 0
    found, step = None, 1
    while step <= longest:
        ends = level.select("doc_id", "t", F.col("seq").alias("end_seq"), F.col("a").alias("b"))
        at_level = level.where((F.col("window") >= step) & (F.col("window") < 2 * step))
        alone = at_level.where(F.col("window") == step).select("doc_id", "t", "seq", F.col("window").alias("depth"), "a", F.col("a").alias("b"))
        if step > 1:
            paired = (
                at_level.where(F.col("window") > step)
                .withColumn("end_seq", F.col("seq") + F.col("window") - step)
                .join(ends, ["doc_id", "t", "end_seq"])
                .select("doc_id", "t", "seq", F.col("window").alias("depth"), "a", "b")
            )
            alone = alone.unionByName(paired)
        found = alone if found is None else found.unionByName(alone)
        step *= 2
        if step > longest:
            break
        pairs = level.withColumn("end_seq", F.col("seq") + step // 2).join(ends, ["doc_id", "t", "end_seq"])
        pairs = pairs.select("doc_id", "t", "seq", "window", "a", "b")
        ranks = _ranked(pairs, ["a", "b"])
        level = store(pairs.join(ranks, ["a", "b"]).select("doc_id", "t", "seq", "window", F.col("rank").alias("a")))
    return found if found is not None else level.select("doc_id", "t", "seq", F.col("window").alias("depth"), "a", F.col("a").alias("b"))


def later_copies(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, t, seq, n_lines): maximal runs of ``lines`` that occurred before, in order of id, text hash and line."""
    windows = store(shared_windows(lines, min_words))
    place = F.struct("doc_id", "t", "seq")
    keys = ["depth", "a", "b"]
    intervals = store(
        windows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    )
    members = windows.join(intervals, keys).select("doc_id", "t", "seq", "depth", "first")
    members = store(members.join(lines.select("doc_id", "t", "seq", "tails"), ["doc_id", "t", "seq"]))
    tails = members.select("first", "doc_id", "t", "seq", F.posexplode("tails").alias("k", "tail"))
    first_tails = tails.groupBy("first", "k", "tail").agg(F.min(place).alias("first_tail"))
    longer = (
        tails.join(first_tails, ["first", "k", "tail"]).where(F.col("first_tail") < place)
        .groupBy("doc_id", "t", "seq").agg(F.max(F.col("k") + 1).alias("more"))
    )
    copies = members.where(F.col("first") < place).select("doc_id", "t", "seq", "depth")
    return copies.join(longer, ["doc_id", "t", "seq"], "left").select(
        "doc_id", "t", "seq", (F.col("depth") + F.coalesce("more", F.lit(0))).alias("n_lines")
    )


def without_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, any more columns) with ``text`` rid of later copies, ``n_lines`` and ``n_deleted``.

    Lines count as equal if they are so without white space around them. The first copy in order
    of doc_id and line stays, also within one document. Blank lines stay where a line is left;
    texts that lose nothing stay as they are, null included. Equal rows of an id count once and get
    the same text; rows of an id with different texts are ordered by a hash of the text, and what
    only one of them says stays. Rows without an id stay as they are. An empty table gives no rows.
    Incoming columns ``n_lines`` and ``n_deleted`` are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    raw = numbered_lines(texts, min_words)
    once = raw.groupBy("doc_id", "t", "seq").agg(F.min(F.struct("h1", "h2", "window", "tails")).alias("l"))
    lines = store(once.select("doc_id", "t", "seq", "l.*"))
    copies = later_copies(lines, min_words)
    runs = store(copies.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set(F.struct("seq", "n_lines"))).alias("runs")))
    release(lines)
    # The rows travel as one struct, so no column of theirs can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("id"), _text_hash().alias("t"))
    key = F.xxhash64("doc_id", "t")
    maybe = F.col("id").isNotNull() & may_be_among(F.xxhash64("id", "t"), runs.select(key.alias("key")))
    marked = rows.withColumn("maybe", maybe)
    cut = marked.where("maybe").join(runs, (F.col("id") == F.col("doc_id")) & (rows["t"] == runs["t"]), "left").select("row", "runs")
    whole = marked.where("NOT maybe").select(
        "row", F.struct(F.col("row.text").alias("text"), _n_lines(F.col("row.text")).alias("n_lines"), F.lit(0).cast("long").alias("n_deleted")).alias("cut")
    )
    result = cut.select("row", _cut(F.col("row.text"), F.col("runs")).alias("cut")).unionByName(whole)
    return result.select(
        *[F.col("cut.text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names], "cut.n_lines", "cut.n_deleted"
    )


def _n_lines(text: Column) -> Column:
    """Lines that are not blank: places where a line begins and, after white space, something is there."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?:^|\n)[ \t\r\x0b\x0c]*+[^ \t\r\x0b\x0c\n]")).cast("long")


def _cut(text, runs):
    @F.pandas_udf("text string, n_lines long, n_deleted long")
    def cut(texts: pd.Series, deleted: pd.Series) -> pd.DataFrame:
        rows = []
        for t, d in zip(texts, deleted, strict=True):
            lines = _lines(t or "")
            if d is None or not len(d):
                rows.append((t, len(lines), 0))
                continue
            gone = np.zeros(len(lines), bool)
            for r in d:
                gone[r["seq"] : r["seq"] + r["n_lines"]] = True
            numbers = {lines[k][0] for k in np.flatnonzero(gone)}
            left = "" if gone.all() else "\n".join(line for i, line in enumerate(t.split("\n")) if i not in numbers)
            rows.append((left, len(lines), int(gone.sum())))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_deleted"])

    return cut(text, runs)


def line_dedup_sql(min_words: int = MIN_WORDS) -> str:
    """DuckDB SQL for ``without_copies`` of ``documents``: all pairs of equal lines, runs along their diagonals."""
    edges = "chr(32) || chr(9) || chr(13) || chr(11) || chr(12)"
    return f"""
    WITH split AS (
      SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no
      FROM documents),
    lines AS (
      SELECT doc_id, line_no, trim(raw, {edges}) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS seq,
             len(regexp_extract_all(raw, '[^\\x09-\\x0D\\x20]+')) AS words
      FROM split WHERE trim(raw, {edges}) <> ''),
    pairs AS (
      SELECT s.doc_id, s.seq, s.words, t.doc_id AS t_doc, s.seq - t.seq AS diagonal,
             s.seq - row_number() OVER (PARTITION BY s.doc_id, t.doc_id, s.seq - t.seq ORDER BY s.seq) AS island
      FROM lines s JOIN lines t ON s.line = t.line AND (t.doc_id < s.doc_id OR (t.doc_id = s.doc_id AND t.seq < s.seq))),
    runs AS (
      SELECT doc_id, min(seq) AS lo, max(seq) AS hi FROM pairs
      GROUP BY doc_id, t_doc, diagonal, island HAVING sum(words) >= {min_words}),
    gone AS (SELECT DISTINCT l.doc_id, l.line_no FROM lines l JOIN runs r ON l.doc_id = r.doc_id AND l.seq BETWEEN r.lo AND r.hi),
    facts AS (
      SELECT l.doc_id, count(*) AS n_lines, count(g.line_no) AS n_deleted
      FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line_no = g.line_no GROUP BY l.doc_id),
    kept AS (
      SELECT s.doc_id, string_agg(s.raw, chr(10) ORDER BY s.line_no) AS text
      FROM split s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.line_no = g.line_no WHERE g.line_no IS NULL GROUP BY s.doc_id)
    SELECT d.doc_id, coalesce(f.n_lines, 0) AS n_lines, coalesce(f.n_deleted, 0) AS n_deleted,
           CASE WHEN coalesce(f.n_deleted, 0) = 0 THEN d.text WHEN f.n_deleted = f.n_lines THEN '' ELSE k.text END AS text
    FROM documents d LEFT JOIN facts f ON d.doc_id = f.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id"""
