"""Row-level chart data: filters, pairs, labelled values, unpivoted measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmeter.operators.groups import Keys, as_list
from chartmeter.operators.ranking import topk_rows


def row_filter(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows that meet every condition; plain predicates reach the scan."""
    for condition in conditions:
        df = df.where(condition)
    return df


def between(col: str, low, high) -> Column:
    """Closed range."""
    return F.col(col).between(low, high)


def one_of(col: str, values: list) -> Column:
    return F.col(col).isin(*values)


def in_year(col: str, year: int) -> Column:
    """Dates of one year, as a range on the raw column so that it is pushed down."""
    return (F.col(col) >= F.lit(f"{year}-01-01").cast("timestamp_ntz")) & before_year(col, year + 1)


def before_year(col: str, year: int) -> Column:
    return F.col(col) < F.lit(f"{year}-01-01").cast("timestamp_ntz")


def after_year(col: str, year: int) -> Column:
    return F.col(col) >= F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")


def pairs(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """(x, y) rows for a scatter, duplicates kept, with an optional color column."""
    extra = [F.col(color).alias("color")] if color else []
    return df.select(F.col(x).alias("x"), F.col(y).alias("y"), *extra)


def category_values(df: DataFrame, label: str, value: str) -> DataFrame:
    """Label and value of each row as they stand."""
    return df.select(F.col(label).alias("label"), F.col(value).alias("value"))


def density_points(
    df: DataFrame,
    lat: str,
    lon: str,
    z: str,
    k: int | None = None,
    tie: Keys | None = None,
    asc: bool = False,
) -> DataFrame:
    """(lat, lon, z) rows for a density map, or only the k highest (lowest) by z."""
    rows = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(z).isNotNull())
    if k is not None:
        rows = topk_rows(rows, z, k, as_list(tie) if tie else [lat, lon], asc)
    return rows.select(F.col(lat).alias("lat"), F.col(lon).alias("lon"), F.col(z).alias("z"))


def compare_to_row(df: DataFrame, key: str, value, measure: str, op: str = ">") -> DataFrame:
    """Rows whose measure exceeds (``>``, ``>=``) or undercuts (``<``, ``<=``) that of the
    row named by ``key = value``; no such row, no result."""
    named = df.where(F.col(key) == F.lit(value))
    edge = named.agg(F.max(measure) if op in (">", ">=") else F.min(measure)).scalar()
    tests = {
        ">": F.col(measure) > edge,
        ">=": F.col(measure) >= edge,
        "<": F.col(measure) < edge,
        "<=": F.col(measure) <= edge,
    }
    return df.where(tests[op])


def unpivot_measures(
    df: DataFrame,
    ids: Keys,
    measures: list[str],
    component: str = "component",
    value: str = "value",
) -> DataFrame:
    """One (component, value) row per measure column."""
    return df.unpivot(as_list(ids), measures, component, value)
