"""MinHash near-dedup (operator 4): BagMinHash signatures, bands, verified multiset overlap.

A document is the multiset of its runs of five words. Each element has a Poisson process of points
over the plane of weight and time; a document with the element at weight w sees the points below w.
Weights are discretised to whole numbers and the processes are hierarchical: one for the weights 0
to 1, one each for 1 to 2, 2 to 4, 4 to 8, ..., all drawn from hashes of the element. Every point
belongs to one of the components of the signature, whose value is its earliest point. Two documents
agree in a component with the probability of their weighted Jaccard similarity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatweave.llm.common import components, frugal, may_be_among, mix, shingles, ship_package, store, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 5
#: Texts of one bucket that one task compares at once.
BLOCK = 1024

_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNIT = 2.0**-53


def bag(words: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(elements, counts) of the runs of ``k`` words, elements ascending."""
    return np.unique(shingles(words, k), return_counts=True)


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(11)).astype(float) + 0.5) * _UNIT


def bag_minhash(elements: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Signature of ``size`` values of a multiset with at least one element."""
    # Strips of weight: (0, 1), (1, 2), (2, 4), ... as far as the largest count reaches.
    top = int(counts.max())
    edges = [0, *[1 << j for j in range(max(1, top).bit_length() + 1)]]
    seeds, low, width, count = [], [], [], []
    for j in range(len(edges) - 1):
        inside = counts > edges[j]
        if not inside.any():
            break
        seeds.append(mix(elements[inside] + np.uint64((j + 1) * int(_STEP) % (1 << 64))))
        n = len(seeds[-1])
        low.append(np.full(n, edges[j]))
        width.append(np.full(n, edges[j + 1] - edges[j]))
        count.append(counts[inside])
    seed, low, width, count = (np.concatenate(x) for x in (seeds, low, width, count))
    # Up to this time a component stays without a point in one of e**3 / size documents; then longer.
    until = (np.log(size) + 3) / counts.sum()
    while True:
        value = np.zeros(size, np.uint64)
        filled = np.zeros(size, bool)
        times, parts, points = [], [], []
        left, at, drawn = np.arange(len(seed)), np.zeros(len(seed)), 0
        while len(left):
            ahead = int(min(64, np.ceil(size * until * width[left].max()) + 1))
            number = np.arange(drawn + 1, drawn + ahead + 1, dtype=np.uint64) * _STEP
            bits = mix(seed[left][:, None] + number)
            gaps = -np.log(_uniform(bits)) / (size * width[left][:, None])
            gaps[:, 0] += at
            time = np.cumsum(gaps, axis=1)
            row, col = np.nonzero(time <= until)
            point = mix(bits[row, col] ^ _STEP)
            height = low[left[row]] + np.floor(_uniform(mix(point ^ _STEP)) * width[left[row]])
            seen = height < count[left[row]]
            times.append(time[row, col][seen])
            points.append(point[seen])
            parts.append(((point[seen] >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32))
            more = time[:, -1] <= until
            left, at, drawn = left[more], time[more, -1], drawn + ahead
        time, part, point = np.concatenate(times), np.concatenate(parts).astype(np.int64), np.concatenate(points)
        order = np.argsort(-time, kind="stable")
        value[part[order]] = point[order]  # the earliest is written last
        filled[part] = True
        if filled.all():
            return value
        until *= 2


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    (x, n), (y, m) = a, b
    total = n.sum() + m.sum()
    if not total:
        return 0.0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    same = y[at] == x if len(y) else np.zeros(len(x), bool)
    both = np.minimum(n[same], m[at[same]]).sum()
    return float(both / (total - both))


def _prepared(text: str | None) -> bytes:
    return (text or "").lower().encode()


SIGNATURE_SCHEMA = "doc_id long, text_md5 string, h1 long, h2 long, bands array<long>, sketch binary"


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE) -> DataFrame:
    """``SIGNATURE_SCHEMA``: hash of a text's words (128 bits) and of each band, and a byte of every value; nulls for texts without words."""
    ship_package(docs.sparkSession)
    number = np.arange(1, bands + 1, dtype=np.uint64) * _STEP

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids, out = batch["text"].to_numpy(), batch["doc_id"].to_numpy(), []
            for start, blocks in word_hashes(_prepared(t) for t in texts):
                for i, words in enumerate(blocks, start):
                    md5 = hashlib.md5((texts[i] or "").encode()).hexdigest()
                    if not len(words):
                        out.append((ids[i], md5, None, None, [], None))
                        continue
                    digest = hashlib.blake2b(b" ".join(_prepared(texts[i]).split()), digest_size=16).digest()
                    value = bag_minhash(*bag(words, k), bands * rows).reshape(bands, rows)
                    key = number.copy()
                    for r in range(rows):
                        key = mix(key * _STEP + value[:, r])
                    h1, h2 = np.frombuffer(digest, np.int64)
                    out.append((ids[i], md5, h1, h2, key.view(np.int64), (value & np.uint64(255)).astype(np.uint8).tobytes()))
            frame = pd.DataFrame(out, columns=["doc_id", "text_md5", "h1", "h2", "bands", "sketch"])
            yield frame.astype({"h1": "Int64", "h2": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(frugal(run), SIGNATURE_SCHEMA)


def verified(pairs: DataFrame, texts: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``pairs`` (a, b) with ``similarity``, from the whole texts (doc_id, text)."""

    @F.pandas_udf("double")
    def overlap(a: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        bags: dict = {}
        out = []
        for key, left, right in zip(a, x, y, strict=True):
            if key not in bags:
                bags = {key: _bag_of(left, k)}  # pairs come sorted by a
            out.append(weighted_jaccard(bags[key], _bag_of(right, k)))
        return pd.Series(out, dtype=float)

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    joined = pairs.join(right, "b").join(left, "a")
    return joined.select("a", "b", overlap("a", "x", "y").alias("similarity"))


def _bag_of(text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    (_, (words,)), = list(word_hashes([_prepared(text)]))
    return bag(words, k)


def links_across(
    buckets: DataFrame, groups: DataFrame, texts: DataFrame, agree: int, similarity: float, k: int = SHINGLE
) -> DataFrame:
    """(a, b): similar pairs of ``buckets`` (key, doc_id) in different ``groups`` (doc_id, component, bands, sketch).

    Pairs whose sketches agree in ``agree`` places are verified where they meet, each in the first
    band they share. Buckets of more than ``BLOCK`` texts are dealt into blocks and compared
    as pairs of blocks, so a task holds two blocks at most.
    """
    rows = buckets.join(groups, "doc_id")
    sizes = rows.groupBy("key").agg(
        F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")
    ).where("low <> high")
    parts = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    met = rows.join(sizes.select("key", parts.alias("parts")), "key").join(texts, "doc_id")
    met = met.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["key", "lo", "hi"]
    dealt = met.select(
        "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "doc_id", "component", "bands", "sketch", "text"
    )

    def compare(rows: pd.DataFrame) -> list[tuple[int, int]]:
        ids, comp, own = (rows[c].to_numpy() for c in ("doc_id", "component", "own"))
        key, lo, hi = (rows[c].iloc[0] for c in keys)
        x, y = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        table = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(ids), -1)
        same = np.zeros((len(x), len(y)), np.int16)
        for i in range(table.shape[1]):
            same += table[x, i][:, None] == table[y, i][None, :]
        wanted = (same >= agree) & (comp[x][:, None] != comp[y][None, :])
        if lo == hi:
            wanted = np.triu(wanted, 1)
        bands = np.stack(rows["bands"].to_numpy())
        for i in range(int(np.flatnonzero(bands[0] == key)[0])):
            wanted &= bands[x, i][:, None] != bands[y, i][None, :]
        bags: dict[int, tuple] = {}
        out = []
        for i, j in zip(*np.nonzero(wanted), strict=True):
            pair = (int(x[i]), int(y[j]))
            for r in pair:
                if r not in bags:
                    bags[r] = _bag_of(rows["text"].iloc[r], k)
            if weighted_jaccard(bags[pair[0]], bags[pair[1]]) >= similarity:
                out.append((min(ids[pair[0]], ids[pair[1]]), max(ids[pair[0]], ids[pair[1]])))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def emit(rows: pd.DataFrame, ends: np.ndarray) -> pd.DataFrame:
            found = [p for s, e in zip(np.append(0, ends[:-1]), ends, strict=True) if e - s > 1 for p in compare(rows.iloc[s:e])]
            return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

        left = None
        for batch in batches:
            rows = batch if left is None else pd.concat([left, batch], ignore_index=True)
            key = rows[keys].to_numpy()
            ends = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            if len(ends):
                yield emit(rows, ends)
                rows = rows.iloc[ends[-1] :].reset_index(drop=True)
            left = rows
        if left is not None and len(left):
            yield emit(left, np.array([len(left)]))

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(frugal(run), "a long, b long")


def links(buckets: DataFrame, sketches: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Verified pairs (a, b) that connect all texts which meet in a bucket and are similar.

    First every text is compared with one text of each of its buckets, chosen by a hash of both: that
    connects groups of copies in a few comparisons for each member. Texts of a bucket that are still apart are compared
    by their sketches, all with all, in blocks; those that agree enough are verified. A pair of the
    wanted similarity agrees in ``size * similarity`` places of a sketch on average; pairs are let
    through from four standard deviations below.
    """
    pivots = buckets.groupBy("key").agg(F.min_by("doc_id", F.xxhash64("key", "doc_id")).alias("pivot"))
    a, b = F.least("pivot", "doc_id").alias("a"), F.greatest("pivot", "doc_id").alias("b")
    star = buckets.join(pivots, "key").where("doc_id <> pivot").select(a, b).distinct()
    near = store(verified(star, texts).where(F.col("similarity") >= similarity).select("a", "b"))
    grouped = components(near).select(F.col("node").alias("doc_id"), "component")
    groups = sketches.join(grouped, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    size = BANDS * ROWS
    agree = int(size * similarity - 4 * np.sqrt(size * similarity * (1 - similarity)))
    return near.unionByName(store(links_across(buckets, groups, texts, agree, similarity)))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, component_id, kept) of ``judged``: one row per id."""
    return judged(docs, similarity).drop("text_md5")


def judged(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_md5, class_id, component_id, kept): one row per id of ``docs`` (doc_id, text).

    A class holds the texts with the same words (lower case, white space aside) and is named by its
    smallest id. A component holds the classes that links of ``similarity`` or more connect, and
    is named likewise; its first document is kept. Shorter texts than five words have one run,
    all their words. Null and empty texts stand alone and are kept. Of repeated rows of an id that
    with the smallest md5 of its text is judged, and ``text_md5`` says which. Rows without an id come back with null ids and are kept.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    raw = signatures(texts.where("doc_id IS NOT NULL"))
    once = store(raw.groupBy("doc_id").agg(F.min(F.struct("text_md5", "h1", "h2", "bands", "sketch")).alias("s")).select("doc_id", "s.*"))
    known = once.where("h1 IS NOT NULL")
    classes = store(
        known.groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("class_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    )
    buckets = classes.select(F.explode("bands").alias("key"), F.col("class_id").alias("doc_id"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = store(buckets.join(shared, "key"))
    wanted = buckets.select("doc_id").distinct()
    md5 = F.md5(F.coalesce("text", F.lit("")))
    chosen = texts.where(may_be_among(F.col("doc_id"), wanted)).join(once.select("doc_id", "text_md5").join(wanted, "doc_id"), "doc_id")
    some = store(chosen.where(md5 == F.col("text_md5")).select("doc_id", "text").dropDuplicates(["doc_id"]).repartition("doc_id"))
    sketches = classes.select(F.col("class_id").alias("doc_id"), "bands", "sketch").join(wanted, "doc_id", "left_semi")
    grouped = components(links(buckets, sketches, some, similarity))
    member = classes.join(grouped, F.col("class_id") == F.col("node"), "left").select(
        "h1", "h2", "class_id", F.coalesce("component", "class_id").alias("component_id")
    )
    placed = known.select("doc_id", "text_md5", "h1", "h2").join(member, ["h1", "h2"]).select("doc_id", "text_md5", "class_id", "component_id")
    alone = once.where("h1 IS NULL").select("doc_id", "text_md5", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    nameless = texts.where("doc_id IS NULL").select("doc_id", F.lit(None).cast("string").alias("text_md5"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    every = placed.unionByName(alone).unionByName(nameless)
    return every.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates_sql(similarity: float = SIMILARITY, k: int = SHINGLE) -> str:
    """DuckDB SQL for ``near_duplicates`` of ``documents``: exact overlap of all pairs that share a run."""
    return f"""
    WITH RECURSIVE worded AS (
      SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x09-\\x0D\\x20]+') AS words FROM documents),
    named AS (SELECT doc_id, words, min(doc_id) OVER (PARTITION BY words) AS named FROM worded),
    classes AS (SELECT doc_id, words, CASE WHEN len(words) = 0 THEN doc_id ELSE named END AS class_id FROM named),
    reps AS (SELECT doc_id, words, least({k}, len(words)) AS k FROM classes WHERE doc_id = class_id AND len(words) > 0),
    runs AS (SELECT doc_id, k, words, unnest(range(1, len(words) - k + 2)) AS i FROM reps),
    bags AS (SELECT doc_id, list_slice(words, i, i + k - 1) AS run, count(*) AS n FROM runs GROUP BY ALL),
    totals AS (SELECT doc_id, sum(n) AS total FROM bags GROUP BY doc_id),
    shared AS (
      SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS common
      FROM bags x JOIN bags y ON x.run = y.run AND x.doc_id < y.doc_id GROUP BY ALL),
    links AS (
      SELECT a, b FROM shared JOIN totals t ON t.doc_id = a JOIN totals u ON u.doc_id = b
      WHERE common >= {similarity} * (t.total + u.total - common)),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (
      SELECT doc_id AS node, doc_id AS root FROM reps
      UNION
      SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node WHERE r.root < e.b),
    roots AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
    SELECT c.doc_id, c.class_id, coalesce(r.component_id, c.class_id) AS component_id,
           c.doc_id = coalesce(r.component_id, c.class_id) AS kept
    FROM classes c LEFT JOIN roots r ON r.node = c.class_id"""
