"""Equal-width bins in one and two dimensions.

Bin edges come from a scalar subquery over the column's minimum and maximum;
pass ``bounds`` to save that scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartmeter.functions.keys import bin_index

Bounds = tuple[float, float]


def numbers(df: DataFrame, *cols: str) -> DataFrame:
    """Rows whose binned columns are all present (neither null nor NaN)."""
    for c in cols:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return df


def edges(df: DataFrame, **bounds: Bounds | None) -> dict[str, tuple[Column, Column]]:
    """Lowest and highest value of each column: as given, or all from one scan."""
    found = {c: (F.lit(float(b[0])), F.lit(float(b[1]))) for c, b in bounds.items() if b is not None}
    open_ended = [c for c in bounds if c not in found]
    if open_ended:
        number = {c: F.col(c).cast("double") for c in open_ended}
        ends = [F.min(number[c]).alias(f"lo_{c}") for c in open_ended] + [F.max(number[c]).alias(f"hi_{c}") for c in open_ended]
        row = df.agg(F.struct(*ends).alias("ends")).scalar()
        found |= {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in open_ended}
    return found


def histogram(
    df: DataFrame,
    col: str,
    bins: int,
    by: str | None = None,
    bounds: Bounds | None = None,
) -> DataFrame:
    """Rows per equal-width bin, over all rows or per ``by``, empty bins included, also all
    bins of a group without any row inside.

    Bins share their edges across groups. Columns: [by], bin, bin_lo, bin_hi, n.
    """
    keys = [by] if by else []
    lo, hi = edges(numbers(df, col), **{col: bounds})[col]
    value = F.col(col).cast("double")
    index = F.when(~F.isnan(value), bin_index(value, lo, hi, bins))
    counted = df.select(*keys, index.alias("bin")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    # a group's counts, one entry per bin it met, then spread over all its bins
    entry = F.when(F.col("bin").isNotNull(), F.struct("bin", "n"))
    met = F.map_from_entries(F.collect_list(entry))
    every_bin = F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))
    filled = (
        counted.groupBy(*keys)
        .agg(met.alias("met"))
        .select(*keys, "met", F.explode(every_bin).alias("bin"))
        .select(*keys, "bin", F.coalesce(F.try_element_at("met", F.col("bin")), F.lit(0)).alias("n"))
    )
    width = (hi - lo) / F.lit(float(bins))
    return filled.select(
        *keys,
        "bin",
        (lo + F.col("bin") * width).alias("bin_lo"),
        (lo + (F.col("bin") + 1) * width).alias("bin_hi"),
        "n",
    )


def density_1d(
    df: DataFrame,
    col: str,
    bins: int,
    by: str | None = None,
    bounds: Bounds | None = None,
) -> DataFrame:
    """Histogram scaled so that each group's bars have area 1."""
    counted = histogram(df, col, bins, by, bounds)
    if by:
        # at most ``bins`` rows per group reach this window
        total = F.sum("n").over(Window.partitionBy(by))
    else:
        total = counted.agg(F.sum("n").alias("total")).scalar()
    width = F.col("bin_hi") - F.col("bin_lo")
    return counted.withColumn("density", F.try_divide(F.col("n").cast("double"), total * width))


def grid_2d(
    df: DataFrame,
    x: str,
    y: str,
    nx: int,
    ny: int,
    x_bounds: Bounds | None = None,
    y_bounds: Bounds | None = None,
) -> DataFrame:
    """Rows per cell of an nx by ny grid; only cells that hold rows are returned."""
    rows = numbers(df, x, y)
    ends = edges(rows, **{x: x_bounds, y: y_bounds})
    (x_lo, x_hi), (y_lo, y_hi) = ends[x], ends[y]
    cells = rows.select(
        bin_index(F.col(x).cast("double"), x_lo, x_hi, nx).alias("x_bin"),
        bin_index(F.col(y).cast("double"), y_lo, y_hi, ny).alias("y_bin"),
    )
    return (
        cells.where(F.col("x_bin").isNotNull() & F.col("y_bin").isNotNull())
        .groupBy("x_bin", "y_bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
