"""Running values along recordings of any length, by blocks.

A window over a whole recording is one task, however long the recording. Here its rows are cut into
blocks by range (recording, order); a block is summarised, the summaries run along the small table of
blocks, and each block gets what the blocks before it (or behind it) amount to. Windows over rows go
by (recording, block). So a recording with a large part of all rows spreads over as many tasks as its
share, and only the block table, one row for each block that a recording touches, is walked by
recording.

Blocks are cut by sampled quantiles, so they are written (a checkpoint) before anything is made of
them: all steps see the same cuts. Rows equal in recording and order stay in one block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .graph import checkpoint

BLOCK = "_block"


def in_blocks(df: DataFrame, by: list[str], order: list[str], blocks: int | None = None) -> DataFrame:
    """df with _block. blocks: how many over all, as many as shuffle partitions if not given."""
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpoint(df.repartitionByRange(n, *by, *order).withColumn(BLOCK, F.spark_partition_id()))


def local(by: list[str], order: list[str | Column]):
    """The window over a recording's rows in one block."""
    return Window.partitionBy(*by, BLOCK).orderBy(*order)


def _along(by: list[str], ahead: bool):
    w = Window.partitionBy(*by).orderBy(BLOCK)
    return w.rowsBetween(1, Window.unboundedFollowing) if ahead else w.rowsBetween(Window.unboundedPreceding, -1)


def with_others(rows: DataFrame, by: list[str], own: Column, merge, name: str, *, ahead: bool = False) -> DataFrame:
    """rows with `name`: `own` of each block, aggregated by merge over a recording's earlier blocks (ahead: later ones)."""
    each = rows.groupBy(*by, BLOCK).agg(own.alias("_own"))
    keys = [*by, BLOCK]
    table = each.select(*[F.col(c).alias(f"_at{k}") for k, c in enumerate(keys)], merge("_own").over(_along(by, ahead)).alias(name))
    same = reduce(lambda a, b: a & b, (rows[c].eqNullSafe(table[f"_at{k}"]) for k, c in enumerate(keys)))
    return rows.join(table, same, "left").select(*rows.columns, name)


def running_max(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """rows (in blocks) with the largest value of all rows before each."""
    out = with_others(rows, by, F.max(value), F.max, "_carried")
    before = F.max(value).over(local(by, order).rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn(name, F.greatest("_carried", before)).drop("_carried")


def running_sum(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """rows (in blocks) with the sum of value up to and with each row."""
    out = with_others(rows, by, F.sum(value), F.sum, "_carried")
    upto = F.sum(value).over(local(by, order).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn(name, F.coalesce("_carried", F.lit(0)) + upto).drop("_carried")


def row_numbers(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """rows (in blocks) with their place in the recording, from 1."""
    out = with_others(rows, by, F.count(F.lit(1)), F.sum, "_carried")
    return out.withColumn(name, F.coalesce("_carried", F.lit(0)) + F.row_number().over(local(by, order))).drop("_carried")


def neighbour(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str, *, ahead: bool = True, only: Column | None = None) -> DataFrame:
    """rows (in blocks) with the value of the next row (else the one before) of the recording, or of the next for which `only` holds.

    order must tell a recording's rows apart.
    """
    key = F.struct(*order, value.alias("_value"))
    wanted = key if only is None else F.when(only, key)
    out = with_others(rows, by, F.min(wanted) if ahead else F.max(wanted), F.min if ahead else F.max, "_far", ahead=ahead)
    w = local(by, order)
    near = F.first(wanted, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)) if ahead else F.last(wanted, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn(name, F.coalesce(near, F.col("_far"))["_value"]).drop("_far")
