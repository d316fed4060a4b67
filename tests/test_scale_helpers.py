"""Blocks change how work is spread, never the result."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from chatweave.operators.blocks import BLOCK, densely, previous_value, running_total, with_block


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for key, n in (("hot", 300), ("b", 7), ("c", 1)):
        out += [(key, o, rng.randrange(4)) for o in sorted(rng.sample(range(5000), n))]
    return out


@pytest.mark.parametrize("block_rows", [1, 10, 999, 1 << 16])
def test_running_total_and_previous_value(spark, rows, block_rows):
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint").repartition(6)
    total = running_total(df, ["k"], "o", F.col("v"), "t", block_rows)
    both = previous_value(total, ["k"], "o", "v", "p", block_rows)
    want, before, last = [], {}, {}
    for k, o, v in rows:
        want.append((k, o, v, before.get(k, 0), last.get(k)))
        before[k] = before.get(k, 0) + v
        last[k] = v
    assert sorted(map(tuple, both.select("k", "o", "v", "t", "p").collect()), key=str) == sorted(want, key=str)


def test_dense_numbers_of_sparse_and_text_keys(spark):
    """Numbers without gaps, whatever the order's type; blocks made by them are full."""
    rows = [(k, f"name {i * 7919 % 1000:04d}", i * 1_000_003) for k in ("a", None) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, name string, o bigint").repartition(5)
    everywhere = {(r.k, r.name): r.n for r in densely(df, [], "name", "n").collect()}
    assert sorted(everywhere.values()) == list(range(1000))
    assert [k[1] for k, _ in sorted(everywhere.items(), key=lambda x: x[1])] == sorted(r[1] for r in rows)
    by_key = densely(df, ["k"], "o", "n")
    assert {(r.k, r.o): r.n for r in by_key.collect()} == {(k, o): o // 1_000_003 for k, _, o in rows}
    sizes = [r["count"] for r in with_block(by_key, "n", 100).groupBy("k", BLOCK).count().collect()]
    assert sizes == [100] * 10
