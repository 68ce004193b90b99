"""Grouped chart data: counts, aggregates, rates, shares and trends.

All of these aggregate before they shuffle, so one key holding most of the rows
costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keys = str | list[str]


def as_list(keys: Keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def measure_column(fn: str, measure: str | Column | None) -> Column:
    """Aggregate named by ``fn``: count, sum, avg, min or max.

    ``avg`` divides the sum by the count, so that a decimal measure gives the
    same double in whatever order its rows are added.
    """
    if fn == "count":
        return F.count(F.lit(1) if measure is None else measure)
    col = F.col(measure) if isinstance(measure, str) else measure
    if fn == "avg":
        return F.try_divide(F.sum(col).cast("double"), F.count(col).cast("double"))
    simple = {"sum": F.sum, "min": F.min, "max": F.max}
    if fn not in simple:
        raise ValueError(f"unknown aggregate {fn!r}")
    return simple[fn](col)


def count_by(df: DataFrame, keys: Keys, name: str = "n") -> DataFrame:
    """Rows per category; null is a category of its own."""
    return df.groupBy(*as_list(keys)).agg(F.count(F.lit(1)).alias(name))


def agg_by(
    df: DataFrame, keys: Keys, measure: str | Column | None, fn: str = "avg", name: str = "value"
) -> DataFrame:
    """One aggregate of a measure per category."""
    return df.groupBy(*as_list(keys)).agg(measure_column(fn, measure).alias(name))


def rate_by(df: DataFrame, keys: Keys, flag: str | Column, name: str = "rate") -> DataFrame:
    """Share of rows per category for which ``flag`` holds; null flags are left out."""
    col = F.col(flag) if isinstance(flag, str) else flag
    return df.groupBy(*as_list(keys)).agg(F.avg(col.cast("boolean").cast("int")).alias(name))


def count_where(df: DataFrame, keys: Keys, predicate: Column, name: str = "n") -> DataFrame:
    """Rows per category for which the predicate holds; categories without any stay, at 0."""
    return df.groupBy(*as_list(keys)).agg(F.count_if(predicate).alias(name))


def share(
    df: DataFrame, keys: Keys, weight: str | Column | None = None, name: str = "share"
) -> DataFrame:
    """Each category's part of the total count, or of the total weight.

    The total is a scalar subquery over the grouped rows, whose shuffle it reuses.
    """
    fn = "count" if weight is None else "sum"
    grouped = df.groupBy(*as_list(keys)).agg(measure_column(fn, weight).alias("amount"))
    total = grouped.agg(F.sum("amount").alias("total")).scalar()
    part = F.try_divide(F.col("amount").cast("double"), total.cast("double"))
    return grouped.withColumn(name, part)


def trend(
    df: DataFrame,
    period: str | Column,
    fn: str = "count",
    measure: str | Column | None = None,
    name: str = "value",
) -> DataFrame:
    """One value per period, in order of the periods."""
    key = F.col(period) if isinstance(period, str) else period
    return (
        df.groupBy(key.alias("period"))
        .agg(measure_column(fn, measure).alias(name))
        .orderBy("period")
    )
