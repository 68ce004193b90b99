"""Top-k shapes. Ties always break on the key, ascending, so a rank is repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartmeter.operators.groups import Keys, as_list, measure_column


def _present(df: DataFrame, measure: str) -> DataFrame:
    """Rows whose measure can be ranked: neither null nor NaN."""
    kept = df.where(F.col(measure).isNotNull())
    if dict(df.dtypes)[measure] in ("double", "float"):
        kept = kept.where(~F.isnan(measure))
    return kept


def topk_groups(
    df: DataFrame,
    keys: Keys,
    k: int,
    fn: str = "count",
    measure: str | Column | None = None,
    asc: bool = False,
    name: str = "value",
) -> DataFrame:
    """The k categories with the highest (or lowest) aggregate."""
    keys = as_list(keys)
    grouped = df.groupBy(*keys).agg(measure_column(fn, measure).alias(name))
    return topk_rows(grouped, name, k, keys, asc)


def topk_rows(df: DataFrame, measure: str, k: int, tie: Keys, asc: bool = False) -> DataFrame:
    """The k rows with the highest (or lowest) measure; ``tie`` names the row key."""
    order = F.col(measure).asc() if asc else F.col(measure).desc()
    ties = [F.col(c).asc() for c in as_list(tie)]
    return _present(df, measure).orderBy(order, *ties).limit(k)


def topk_filter(
    df: DataFrame,
    entity: Keys,
    rank_by: str | Column,
    k: int,
    fn: str = "sum",
    asc: bool = False,
) -> DataFrame:
    """All rows of the k entities that rank highest by one measure, to show another.

    Whether the ranked side is broadcast is settled by its size in bytes, when it is
    known; null entities rank like any other.
    """
    keys = as_list(entity)
    ranked = topk_groups(df, keys, k, fn, rank_by, asc, name="rank_value")
    return df.join(ranked.select(*_named(keys, "top")), _same(keys, "top"), "left_semi")


def topk_show(
    df: DataFrame,
    entity: Keys,
    rank_by: str | Column,
    k: int,
    show: dict[str, tuple[str, str | Column]],
    fn: str = "sum",
    asc: bool = False,
) -> DataFrame:
    """Other aggregates of the k entities that rank highest by one measure, in one pass.

    ``show`` names each shown column and gives its aggregate and measure.
    """
    keys = as_list(entity)
    shown = [measure_column(how, measure).alias(name) for name, (how, measure) in show.items()]
    grouped = df.groupBy(*keys).agg(measure_column(fn, rank_by).alias("rank_value"), *shown)
    return topk_rows(grouped, "rank_value", k, keys, asc).select(*keys, *show)


def argmax_per_group(
    df: DataFrame,
    keys: Keys,
    measure: str,
    tie: str,
    show: Keys = (),
    top_groups: int | None = None,
    groups_by: str = "count",
    group_measure: str | Column | None = None,
) -> DataFrame:
    """The row with the highest measure in each group, ties by ``tie`` and then the shown
    columns, ascending.

    With ``top_groups`` only the groups with most rows are kept, or with the highest
    ``groups_by`` (sum, avg, ...) of ``group_measure``. The highest measures are a hash
    aggregate, and only rows that have them are put in order, one a group and task before
    they move: no group is gathered in one task.
    """
    keys, shown = as_list(keys), as_list(show)
    rows = _present(df, measure).select(*dict.fromkeys([*keys, tie, measure, *shown]))
    highest = rows.groupBy(*keys).agg(F.max(measure).alias("best_measure"))
    # groups rank by all their rows, whether or not the measure is present
    if top_groups is not None:
        top = topk_groups(df, keys, top_groups, groups_by, group_measure)
        highest = highest.join(top.select(*_named(keys, "top")), _same(keys, "top"), "left_semi")
    highest = highest.select(*_named(keys, "best"), "best_measure")
    tied = rows.join(highest, _same(keys, "best") & (F.col(measure) == F.col("best_measure")), "left_semi")
    order = Window.partitionBy(*keys).orderBy(*dict.fromkeys([tie, *shown]))
    first = tied.withColumn("place", F.row_number().over(order)).where("place = 1")
    return first.select(*keys, tie, measure, *shown)


def _named(keys: list[str], side: str) -> list[Column]:
    return [F.col(c).alias(f"{side}_{c}") for c in keys]


def _same(keys: list[str], side: str) -> Column:
    """Whether two sides have the same keys, nulls included."""
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"{side}_{c}"))
    return same
