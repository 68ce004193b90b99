from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(name: str) -> Column:
    """A two-decimal measure as a decimal, so that sums do not depend on their order."""
    return F.col(name).cast("decimal(18,2)")


def money_sql(name: str) -> str:
    return f"CAST({name} AS DECIMAL(18,2))"


def avg_sql(name: str) -> str:
    return f"CAST(SUM({money_sql(name)}) AS DOUBLE) / CAST(COUNT({name}) AS DOUBLE)"


def to_double(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.col(name).cast("double") for name in names})


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Six decimals, for results that interpolate and may differ in the last bit."""
    return df.withColumns({name: F.round(name, 6) for name in names})


def cents_sql(x: str) -> str:
    """``round_cents`` in SQL: two decimals of the exact binary value, half to even."""
    x = f"({x})"
    scaled = f"({x} * 100.0::DOUBLE)"
    below = f"floor({scaled})"
    high = f"({x} * 134217729.0::DOUBLE - ({x} * 134217729.0::DOUBLE - {x}))"
    error = f"(({high} * 100.0::DOUBLE - {scaled}) + ({x} - {high}) * 100.0::DOUBLE)"
    tie_up = f"({error} > 0 OR ({error} = 0 AND abs({below}) % 2 = 1))"
    rest = f"({scaled} - {below})"
    up = f"CASE WHEN {rest} > 0.5 OR ({rest} = 0.5 AND {tie_up}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    return (
        f"(CASE WHEN abs({x}) >= 70368744177664.0 THEN {x} "
        f"ELSE ({below} + {up}) / 100.0::DOUBLE + 0.0::DOUBLE END)"
    )
