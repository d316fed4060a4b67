"""Running values over ordered groups of any size.

A plain ``Window.partitionBy(key)`` puts a whole group in one task. Here each group is
cut into blocks of consecutive order values, the window runs inside a block, and one
summary row per block carries the running value across. With the default block size a
group of 10^11 rows has about 1.5 million summary rows, and only those meet in one task.

``order`` must be a non-negative integer column, unique within the key. Blocks are even if its values
are dense; ``densely`` makes them so for sparse numbers and for keys of any sortable type.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatweave.plans.session import store

BLOCK_ROWS = 1 << 16
BLOCK = "_block"


def with_block(df: DataFrame, order: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return df.withColumn(BLOCK, F.expr(f"`{order}` div {int(block_rows)}"))


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    out: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the group (this row not included)."""
    blocked = with_block(df.withColumn("_value", value), order, block_rows)
    per_block = blocked.groupBy(*keys, BLOCK).agg(F.sum("_value").alias("_sum"))
    earlier_blocks = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(
        *keys, BLOCK, F.coalesce(F.sum("_sum").over(earlier_blocks), F.lit(0)).alias("_carry")
    )
    earlier_rows = (
        Window.partitionBy(*keys, BLOCK).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        blocked.join(carried, [*keys, BLOCK])
        .withColumn(out, F.col("_carry") + F.coalesce(F.sum("_value").over(earlier_rows), F.lit(0)))
        .drop("_value", "_carry", BLOCK)
    )


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    out: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``value`` of the row just before this one in the group; null for the first row."""
    blocked = with_block(df, order, block_rows)
    tails = blocked.groupBy(*keys, BLOCK).agg(F.max_by(value, order).alias("_tail"))
    by_block = Window.partitionBy(*keys).orderBy(BLOCK)
    carried = tails.select(*keys, BLOCK, F.lag("_tail").over(by_block).alias("_carry"))
    in_block = Window.partitionBy(*keys, BLOCK).orderBy(order)
    return (
        blocked.join(carried, [*keys, BLOCK])
        .withColumn(
            out,
            F.when(F.row_number().over(in_block) == 1, F.col("_carry")).otherwise(
                F.lag(value).over(in_block)
            ),
        )
        .drop("_carry", BLOCK)
    )


def ranked(df: DataFrame, keys: Sequence[str], order: str, out: str) -> DataFrame:
    """1-based rank by ``order`` (any sortable type, nulls first) in groups of any size, or in the whole table.

    Rows are cut into ranges of (keys, order); a range takes the place of a block. The ranges are
    sampled anew each time they are made, so rows are stored with the range they fell in. Null keys
    are a group like any other; equal rows get neighbouring ranks.
    """
    pieces = store(
        df.repartitionByRange(*keys, order).withColumn(BLOCK, F.spark_partition_id())
    )
    sizes = pieces.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = sizes.select(
        *[F.col(k).alias(f"_of_{k}") for k in keys], F.col(BLOCK).alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_carry")
    )
    same = F.col(BLOCK) == F.col("_of")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    in_piece = Window.partitionBy(*keys, BLOCK).orderBy(order)
    return (
        pieces.join(carried, same)
        .withColumn(out, F.col("_carry") + F.row_number().over(in_piece))
        .drop("_carry", "_of", BLOCK, *[f"_of_{k}" for k in keys])
    )


def densely(df: DataFrame, keys: Sequence[str], order: str, out: str) -> DataFrame:
    """``out``: 0, 1, 2, ... by ``order`` in each group (no keys: in the whole table), a good ``order`` for blocks."""
    return ranked(df, keys, order, out).withColumn(out, F.col(out) - 1)
