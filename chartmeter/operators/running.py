"""Running totals along an ordered key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartmeter.operators.groups import measure_column
from chartmeter.shared import SMALL_ROWS, broadcast_if_small, is_small, stage

_SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def running_total(
    staged: DataFrame, keys: list[str], order: str, value: str, one_task_rows: int = SMALL_ROWS
) -> DataFrame:
    """Add ``running``: the total of ``value`` up to each row, per ``keys``, along ``order``.

    ``staged`` must be stored, with one row per (keys, order). A small table is
    ordered by a plain window. A larger one is range-partitioned into blocks;
    each block is summed within itself and gets the total of the blocks before
    it, so that no group has to pass through one task.
    """
    if is_small(staged, one_task_rows):
        ordered = Window.partitionBy(*keys).orderBy(order).rowsBetween(*_SO_FAR)
        return staged.withColumn("running", F.sum(value).over(ordered))
    # a row's block must be the same in both uses below, so it is written down
    blocks = stage(
        staged.repartitionByRange(*keys, order).withColumn("block", F.spark_partition_id()),
        "blocks",
    )
    # one row per group and block, from here on
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocks.groupBy(*keys, "block")
        .agg(F.sum(value).alias("total"))
        .select(
            F.col("block").alias("of_block"),
            *[F.col(c).alias(f"of_{c}") for c in keys],
            F.sum("total").over(earlier).alias("offset"),
        )
    )
    same = F.col("block") == F.col("of_block")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    in_block = Window.partitionBy(*keys, "block").orderBy(order).rowsBetween(*_SO_FAR)
    within, offset = F.sum(value).over(in_block), F.col("offset")
    # nulls add nothing, but a total of nulls only stays null
    total = F.when(within.isNotNull() & offset.isNotNull(), within + offset).otherwise(
        F.coalesce(within, offset)
    )
    return blocks.join(broadcast_if_small(offsets), same).select(
        *staged.columns, total.alias("running")
    )


def cumulative(
    df: DataFrame,
    order_key: str | Column,
    fn: str = "sum",
    measure: str | Column | None = None,
    one_task_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Running sum or count per value of ``order_key``. Columns: period, value, running.

    The rows are first reduced to one per key.
    """
    if fn not in ("sum", "count"):
        raise ValueError("a running total needs sum or count")
    key = F.col(order_key) if isinstance(order_key, str) else order_key
    per_key = df.groupBy(key.alias("period")).agg(measure_column(fn, measure).alias("value"))
    return running_total(stage(per_key, "per-key"), [], "period", "value", one_task_rows)
