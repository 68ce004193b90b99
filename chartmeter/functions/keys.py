"""Derived keys: case ids, date parts, number bands and bin positions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def case_id(dataset: Column, description: Column) -> Column:
    """Hex md5 of the dataset followed by the description."""
    return F.md5(F.concat(dataset, description))


def date_part(ts: Column, part: str) -> Column:
    """Group key from a date: ``year``, ``month`` (of the year), ``day``, or a
    truncation such as ``month_start`` that keeps the year."""
    if part.endswith("_start"):
        return F.to_date(F.date_trunc(part.removesuffix("_start"), ts))
    return F.date_part(F.lit(part), ts).cast("int")


def number_bands(col: Column, width: float) -> Column:
    """Lower edge of the fixed-width band that holds ``col``.

    A fractional width counts as the decimal it is written as: the edges are its multiples,
    and a value written like one lies on it.
    """
    if float(width).is_integer():
        return F.floor(col / F.lit(width)) * F.lit(width)
    exact = Decimal(str(width))
    scale = max(-exact.as_tuple().exponent, 0)
    parts = int(exact.scaleb(scale))
    # The quotient may be off by one in its last bit; edges are compared to correct that.
    k = F.floor(col / F.lit(float(width)))

    def edge(n: Column) -> Column:
        return (n * F.lit(parts)).cast("double") / F.lit(float(10**scale))

    return F.when(edge(k + 1) <= col, edge(k + 1)).when(edge(k) > col, edge(k - 1)).otherwise(edge(k))


def bin_index(col: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin of ``col`` in [lo, hi]; the last bin is closed, a single
    distinct value is all in bin 0. Values outside [lo, hi] give NULL."""
    width = (hi - lo) / F.lit(float(bins))
    inside = (col >= lo) & (col <= hi)
    index = F.least(F.floor((col - lo) / width), F.lit(bins - 1).cast("bigint"))
    return F.when(inside & (hi > lo), index).when(inside, F.lit(0).cast("bigint"))
