"""Box-plot statistics, exact or approximate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartmeter.shared import broadcast_if_small, stage

_QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
_OUTPUT = [
    "n", "min", "q1", "median", "q3", "max",
    "fence_lo", "fence_hi", "whisker_lo", "whisker_hi", "n_outliers",
]


def _attach(rows: DataFrame, keys: list[str], per_group: DataFrame, name: str) -> DataFrame:
    """Add a group's one row of ``per_group`` to its rows, as struct ``name``."""
    facts = F.struct(*[F.col(c) for c in per_group.columns if c not in keys])
    if not keys:
        return rows.withColumn(name, per_group.select(facts.alias(name)).scalar())
    key = keys[0]
    side = per_group.select(F.col(key).alias("of_key"), facts.alias(name))
    same = F.col(key).eqNullSafe(F.col("of_key"))
    return rows.join(broadcast_if_small(side), same).drop("of_key")


def _with_fences(quartiles: DataFrame) -> DataFrame:
    same = F.col("q1") == F.col("q3")  # infinities, too, have no distance then
    reach = F.when(same, 0.0).otherwise((F.col("q3") - F.col("q1")) * F.lit(1.5))
    return quartiles.withColumn("fence_lo", F.col("q1") - reach).withColumn(
        "fence_hi", F.col("q3") + reach
    )


def box_stats(df: DataFrame, measure: str, by: str | None = None, method: str = "exact", accuracy: int = 10_000) -> DataFrame:
    """Minimum, quartiles, maximum, 1.5 IQR fences, whisker ends and outlier count.

    Quartiles interpolate between neighbours, unless these are equal. Null and NaN measures
    are left out; infinities count like other values.

    ``exact`` selects the quartiles' neighbours by radix: a histogram of the first 16 bits
    of all values, then one of the next 16 bits of the values that share them with a
    neighbour, and so on. No group's values are ever held or sorted, and a histogram has at
    most 2^16 entries. ``approx`` takes the quartiles from a quantile sketch of the given
    ``accuracy``.
    """
    if method not in ("exact", "approx"):
        raise ValueError(f"unknown method {method!r}")
    keys = [by] if by else []
    value = F.col(measure).cast("double")
    rows = df.select(*keys, value.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    if method == "approx":
        sketch = rows.groupBy(*keys).agg(F.percentile_approx("v", list(_QUARTILES.values()), accuracy).alias("q"))
        quartiles = sketch.select(*keys, *[F.col("q")[i].alias(name) for i, name in enumerate(_QUARTILES)])
    else:
        quartiles = _quartiles(rows, keys)
    return _summary(rows, stage(_with_fences(quartiles), "quartiles"), keys)


def radix_key(value: Column) -> Column:
    """A long that orders as the double does: its exponent, then its fraction, negated for a
    negative one. Made of exact steps only."""
    size = F.abs(value)
    guess = F.greatest(F.floor(F.log2(size)), F.lit(-1022)).cast("double")
    # the logarithm may be off by one next to a power of two
    exponent = F.when(F.pow(F.lit(2.0), guess) > size, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= size, guess + 1).otherwise(guess)
    exponent = F.least(F.greatest(exponent, F.lit(-1022.0)), F.lit(1023.0))
    fraction = (size / F.pow(F.lit(2.0), exponent) * F.lit(2.0**52)).cast("bigint")
    finite = (exponent + 1022).cast("bigint") * F.lit(1 << 52) + fraction
    key = F.when(size == 0, F.lit(0).cast("bigint")).when(size == float("inf"), F.lit(2047 << 52)).otherwise(finite)
    return F.when(value < 0, -key).otherwise(key)


def _same(keys: list[str], other: str) -> Column:
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"{other}{c}"))
    return same


def _quartiles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles per group, from the values at the ranks next to each."""
    keyed = rows.select(*keys, "v", radix_key(F.col("v")).alias("key"))
    targets, before_that, shift = None, 64, 48
    while True:
        digits = keyed.withColumn("prefix", F.shiftright("key", shift))
        counted = digits.groupBy(*keys, "prefix").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        counted = stage(counted.withColumn("above", F.shiftright("prefix", before_that - shift) if targets else F.lit(0).cast("bigint")), "digits")
        if targets is None:
            totals = counted.groupBy(*keys).agg(F.sum("n").alias("total"))
            spots = [F.lit(q) * (F.col("total") - 1) for q in _QUARTILES.values()]
            ranks = F.array(*[F.struct(F.lit(2 * i + k).alias("spot"), side(s).alias("rank")) for i, s in enumerate(spots) for k, side in enumerate((F.floor, F.ceil))])
            targets = totals.select(*keys, F.lit(0).cast("bigint").alias("of"), F.inline(ranks).alias("spot", "rank"))
        # at most 2^16 entries below one prefix
        so_far = Window.partitionBy(*keys, "above").orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = counted.withColumn("after", F.sum("n").over(so_far)).withColumn("before", F.col("after") - F.col("n"))
        asked = targets.select(*[F.col(c).alias(f"t_{c}") for c in keys], "of", "spot", "rank")
        held = running.join(asked, _same(keys, "t_") & (F.col("above") == F.col("of")))
        held = held.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("after")))
        found = stage(held.select(*keys, F.col("prefix").alias("of"), "spot", (F.col("rank") - F.col("before")).alias("rank"), "n", "lo", "hi"), "found")
        most = found.where("lo <> hi").agg(F.max("n")).first()[0]
        if most is None:
            break
        targets = found.select(*keys, "of", "spot", "rank")
        # six prefixes a group at most; all else is settled
        left = targets.select(*[F.col(c).alias(f"t_{c}") for c in keys], "of").distinct()
        near = keyed.join(broadcast_if_small(left), _same(keys, "t_") & (F.shiftright("key", shift) == F.col("of")), "left_semi")
        keyed = stage(near, "candidates")
        # prefixes of no more values than a histogram has entries are told apart by all the rest
        before_that, shift = shift, 0 if most <= 1 << 16 else shift - 16
    at = [F.max(F.when(F.col("spot") == i, F.col("lo"))).alias(f"at{i}") for i in range(6)]
    ends = found.groupBy(*keys).agg(*at)
    if keys:
        ends = ends.join(totals.withColumnRenamed(keys[0], f"t_{keys[0]}"), _same(keys, "t_"))
    else:
        ends = ends.withColumn("total", totals.scalar())
    picked = []
    for i, (name, q) in enumerate(_QUARTILES.items()):
        spot = (F.col("total") - 1) * F.lit(q)
        lo, hi = F.col(f"at{2 * i}"), F.col(f"at{2 * i + 1}")
        picked.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (spot - F.floor(spot))).alias(name))
    return ends.select(*keys, *picked)


def _summary(rows: DataFrame, quartiles: DataFrame, keys: list[str]) -> DataFrame:
    """One pass over the values with known quartiles."""
    v = F.col("v")
    inside = (v >= F.col("q.fence_lo")) & (v <= F.col("q.fence_hi"))
    facts = ("q1", "median", "q3", "fence_lo", "fence_hi")
    return (
        _attach(rows, keys, quartiles, "q")
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("v").alias("min"),
            F.max("v").alias("max"),
            F.min(F.when(inside, v)).alias("whisker_lo"),
            F.max(F.when(inside, v)).alias("whisker_hi"),
            F.count_if(~inside).alias("n_outliers"),
            *[F.max(f"q.{c}").alias(c) for c in facts],
        )
        .select(*keys, *_OUTPUT)
    )
