"""Running sums over groups of any size: a group is cut into range blocks, and no task holds more than a block.

A window over (keys) puts a whole group into one task. Here rows are dealt by range over (keys, order)
first and written down with the number of their block; sums of blocks run over (keys, block), which
are as many rows as blocks, and a window within each block adds what came before it.

Defined cases: null keys form a group of their own, nulls in a summed column count as 0, rows that tie
in the order get sums in an unspecified order among themselves, an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import materialise

BLOCK = "_block"


def in_blocks(df: DataFrame, keys: list[str], order: list[Column], blocks: int | None = None) -> DataFrame:
    """The rows with ``_block``, ascending along (keys, order). Written once: the cuts come from a sample and must not be drawn again."""
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(n, *keys, *order).withColumn(BLOCK, F.spark_partition_id()), "blocks")


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    out = F.lit(True)
    for k in names:
        out = out & left[k].eqNullSafe(right[f"_k_{k}"])
    return out


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], blocks: int | None = None) -> DataFrame:
    """df with one more column a sum: the total of all rows of the group up to and with this one, along the order."""
    return running_over(in_blocks(df, keys, order, blocks), keys, order, sums)


#: Rows of a group that one task may go through.
ONE_TASK = 1 << 22


def cumulative(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], most: int = ONE_TASK) -> DataFrame:
    """``running``, by a plain window while no group has more than ``most`` rows: that needs no shuffle where the rows are dealt by the keys already. The largest group is counted first."""
    groups = df.groupBy(*keys).count() if keys else df.groupBy().count()
    largest = groups.agg(F.max("count")).first()[0] or 0
    if largest > most:
        return running(df, keys, order, sums)
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({k: F.sum(F.coalesce(c, F.lit(0))).over(upto) for k, c in sums.items()})


def running_over(cut: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``running`` over a table that ``in_blocks`` made for the same keys and order."""
    sums = {k: F.coalesce(c, F.lit(0)) for k, c in sums.items()}
    by = [*keys, BLOCK]
    totals = cut.groupBy(*by).agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_k_{k}") for k in by], *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums])
    within = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = cut.join(offsets, _same(cut, offsets, by)).drop(*[f"_k_{k}" for k in by])
    out = joined.withColumns({k: F.sum(c).over(within) + F.col(f"_o_{k}") for k, c in sums.items()})
    return out.drop(BLOCK, *[f"_o_{k}" for k in sums])
