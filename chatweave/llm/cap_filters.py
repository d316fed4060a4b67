"""Embedding near-dedup (operator 2): spherical-cap filters from structured random product codes.

A filter is a direction, made of one code word per half of the (rotated) vector, so M code words per
half give M * M directions. List decoding finds all directions whose product with a vector exceeds a
threshold without trying them all: code words of one half are sorted, and for each code word of the
other half a binary search gives those that reach the threshold together. Vectors meet where they
share a direction; sketches of 256 signs thin out the meetings; the rest is verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatweave.llm.common import components, ship_package, store

COSINE = 0.95
#: Directions per vector: on average, and at least for each tenfold of the table.
LIST = 24
LEAST = 8
#: Vectors per direction, on average: the number of directions grows with the table.
MEETING = 32
SKETCH_BITS = 256
#: A pair of cosine 0.95 differs in 26 of 256 signs, give or take 5; of 0.5 in 85. Scaled for other cosines.
SKETCH_SLACK = 36
#: Vectors of one direction that one task compares at once; larger meetings are compared block by block.
BLOCK = 512


class ProductCode:
    """Directions for vectors of one length; the same in every task."""

    def __init__(self, dim: int, words: int) -> None:
        rng = np.random.default_rng([dim, words, 11])
        self.words, self.half = words, dim // 2
        self.least = least_directions(words)
        self.turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.signs = rng.normal(size=(dim, SKETCH_BITS))
        self.codes = []
        for size in (self.half, dim - self.half):
            code = rng.normal(size=(words, size))
            self.codes.append(code / np.maximum(np.linalg.norm(code, axis=1, keepdims=True), 1e-12))
        share = min(0.5, LIST / words**2)
        self.threshold = NormalDist().inv_cdf(1 - share) / np.sqrt(max(1.0, dim / 2))

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Ascending numbers of the directions of each unit vector."""
        turned = unit @ self.turn
        first, second = turned[:, : self.half] @ self.codes[0].T, turned[:, self.half :] @ self.codes[1].T
        order = np.argsort(second, axis=1)
        out = []
        for s, t, o in zip(first, second, order, strict=True):
            begin = np.searchsorted(t[o], self.threshold - s)
            n = self.words - begin
            if n.sum() < self.least:
                out.append(self._largest(s, t))
                continue
            i = np.repeat(np.arange(self.words), n)
            place = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
            out.append(np.sort(i * self.words + o[place]))
        return out

    def _largest(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The ``least`` directions of the largest sums. The i-th and the j-th largest of the halves have i * j
        sums that are no smaller, so few code words of each half come into question."""
        a, b = np.argsort(-s, kind="stable")[: self.least], np.argsort(-t, kind="stable")[: self.least]
        i, j = np.nonzero(np.outer(np.arange(1, len(a) + 1), np.arange(1, len(b) + 1)) <= self.least)
        best = np.argsort(-(s[a[i]] + t[b[j]]), kind="stable")[: self.least]
        return np.sort(a[i[best]] * self.words + b[j[best]])

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        return np.packbits(unit @ self.signs > 0, axis=1).view(np.uint64).view(np.int64)


_CODES: dict[tuple[int, int], ProductCode] = {}


def product_code(dim: int, words: int) -> ProductCode:
    if (dim, words) not in _CODES:
        _CODES[dim, words] = ProductCode(dim, words)
    return _CODES[dim, words]


def code_words(n_vectors: int) -> int:
    """Code words per half, so that a direction is met by ``MEETING`` vectors on average."""
    return max(16, int(np.ceil(np.sqrt(n_vectors * LIST / MEETING))))


def least_directions(words: int) -> int:
    """Fewest directions of a vector, growing with the logarithm of the table that has so many code words: near
    pairs share one of few directions less often, the more directions there are."""
    return int(np.ceil(LEAST * np.log10(words**2 * MEETING / LIST)))


FILTER_SCHEMA = "vec_id long, dim int, filters array<int>, sketch array<long>"


def decoded(vectors: DataFrame, words: int) -> DataFrame:
    """``FILTER_SCHEMA`` of ``vectors`` (vec_id, v array<double>, all usable)."""
    ship_package(vectors.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            dims = batch["v"].map(len)
            for dim, some in batch.groupby(dims):
                values = np.stack(some["v"].to_numpy()).astype(float)
                values /= np.abs(values).max(1, keepdims=True)
                unit = values / np.linalg.norm(values, axis=1, keepdims=True)
                code = product_code(int(dim), words)
                yield pd.DataFrame({
                    "vec_id": some["vec_id"].to_numpy(), "dim": int(dim),
                    "filters": [f.astype(np.int32) for f in code.decode(unit)], "sketch": list(code.sketch(unit)),
                })

    return vectors.select("vec_id", "v").mapInPandas(run, FILTER_SCHEMA)


def most_differing(cosine: float) -> int:
    return int(SKETCH_BITS * np.arccos(np.clip(cosine, -1, 1)) / np.pi) + SKETCH_SLACK


def meetings(filters: DataFrame, cosine: float) -> DataFrame:
    """(a, b), a < b: pairs that share a direction and whose sketches agree enough, each once.

    A pair comes from the smallest direction it shares. Meetings of more than ``BLOCK`` vectors are
    dealt into blocks and compared as pairs of blocks, so no task holds more than two blocks at once.
    """
    rows = filters.select("vec_id", "dim", "filters", "sketch", F.explode("filters").alias("f"))
    sizes = store(rows.groupBy("dim", "f").agg(F.count("*").alias("n")).where("n > 1"))
    parts = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    met = rows.join(sizes, ["dim", "f"]).withColumn("parts", parts)
    own = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["dim", "f", "lo", "hi"]
    dealt = met.select(
        "vec_id", "dim", "f", "filters", "sketch", "own",
        F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
    )
    limit = most_differing(cosine)

    def pairs(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        ids, f = group["vec_id"].to_numpy(), int(group["f"].iloc[0])
        lo, hi = group["lo"].iloc[0], group["hi"].iloc[0]
        own = group["own"].to_numpy()
        x = np.flatnonzero(own == lo)
        y = np.flatnonzero(own == hi)
        sketch = np.stack(group["sketch"].to_numpy()).view(np.uint64)
        apart = np.zeros((len(x), len(y)), np.int64)
        for k in range(sketch.shape[1]):
            apart += np.bitwise_count(sketch[x, k][:, None] ^ sketch[y, k][None, :])
        i, j = np.nonzero(apart <= limit)
        i, j = x[i], y[j]
        once = ids[i] < ids[j] if lo == hi else ids[i] != ids[j]
        i, j = i[once], j[once]
        if not len(i):
            return ids[:0], ids[:0]
        # A pair that shares a smaller direction comes from there.
        used, spot = np.unique(np.concatenate([i, j]), return_inverse=True)
        earlier = [a[a < f] for a in group["filters"].to_numpy()[used]]
        names, at = np.unique(np.concatenate(earlier), return_inverse=True)
        if len(names):
            has = np.zeros((len(used), len(names)), np.float32)
            has[np.repeat(np.arange(len(used)), [len(e) for e in earlier]), at] = 1
            shared = (has @ has.T)[spot[: len(i)], spot[len(i) :]] > 0
            i, j = i[~shared], j[~shared]
        return np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def emit(rows: pd.DataFrame, ends: np.ndarray) -> pd.DataFrame:
            found = [pairs(rows.iloc[s:e]) for s, e in zip(np.append(0, ends[:-1]), ends, strict=True) if e - s > 1]
            a = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
            b = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
            return pd.DataFrame({"a": a, "b": b})

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

    return dealt.repartition(*keys).sortWithinPartitions(*keys, "vec_id").mapInPandas(run, "a long, b long")


def _cosine(x: Column, y: Column) -> Column:
    def dot(u: Column, v: Column) -> Column:
        return F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)

    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def _in_range(v: Column) -> Column:
    """The vector, times a power of two where its squares would leave the range of doubles: no cosine changes."""
    largest = F.array_max(F.transform(v, F.abs))
    factor = F.when(largest > 1e150, 2.0**-600).when((largest > 0) & (largest < 1e-150), 2.0**600)
    return F.when(factor.isNull(), v).otherwise(F.transform(v, lambda x: x * factor))


def linked(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every id of ``vectors`` (vec_id, embedding).

    Links join vectors whose cosine, in double precision, is at least ``cosine``. Vectors that are null or
    zero or hold null or non-finite values link with nothing; vectors of other lengths do not link with
    each other. Equal vectors are searched once, and their number counts. Repeated rows of an
    id count once. Rows without an id link with nothing and come back with null ids, kept.
    """
    value = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    usable = F.coalesce(
        (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0),
        F.lit(False),
    )
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("v"))
    once = store(
        every.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("usable", usable)
        .withColumn("v", _in_range(F.col("v")))
    )
    classes = once.where("usable").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    reps = store(classes.select(F.col("rep").alias("vec_id"), "v", "copies"))
    filters = store(decoded(reps, code_words(reps.count())))
    met = store(meetings(filters, cosine))
    left = reps.select(F.col("vec_id").alias("a"), F.col("v").alias("x"), F.col("copies").alias("a_copies"))
    right = reps.select(F.col("vec_id").alias("b"), F.col("v").alias("y"), F.col("copies").alias("b_copies"))
    links = store(
        met.join(left, "a").join(right, "b").where(_cosine(F.col("x"), F.col("y")) >= cosine).select("a", "b", "a_copies", "b_copies")
    )
    ways = F.explode(F.array(
        F.struct(F.col("a").alias("vec_id"), F.col("b_copies").alias("n")), F.struct(F.col("b").alias("vec_id"), F.col("a_copies").alias("n"))
    ))
    counts = links.select(ways.alias("w")).groupBy("w.vec_id").agg(F.sum("w.n").alias("n"))
    grouped = components(links.select("a", "b")).withColumnRenamed("node", "vec_id")
    facts = reps.join(counts, "vec_id", "left").join(grouped, "vec_id", "left").select(
        F.col("vec_id").alias("rep"), "v",
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
    )
    with_links = once.where("usable").join(facts, "v").select("vec_id", "n_links", "component_id")
    alone = once.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    nameless = every.where("vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = with_links.unionByName(alone).unionByName(nameless)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def linked_sql(cosine: float = COSINE) -> str:
    """DuckDB SQL for ``linked`` of ``embeddings``: all pairs."""
    return f"""
    WITH RECURSIVE vectors AS (
      SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    usable AS (
      SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS norm FROM vectors
      WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        AND len(list_filter(v, lambda x: x <> 0)) > 0),
    ways AS (
      SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.vec_id <> y.vec_id
      WHERE list_inner_product(x.v, y.v) / (x.norm * y.norm) >= {cosine}),
    reach AS (
      SELECT vec_id AS node, vec_id AS root FROM usable
      UNION
      SELECT w.b, r.root FROM reach r JOIN ways w ON w.a = r.node WHERE r.root < w.b),
    roots AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
    counts AS (SELECT a, count(*) AS n FROM ways GROUP BY a)
    SELECT e.vec_id, coalesce(c.n, 0) AS n_links, coalesce(r.component_id, e.vec_id) AS component_id,
           e.vec_id = coalesce(r.component_id, e.vec_id) AS kept
    FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN roots r ON r.node = e.vec_id"""
