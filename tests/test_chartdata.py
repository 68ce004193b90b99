import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartmeter.functions import date_part, number_bands
from chartmeter.operators import (
    agg_by,
    argmax_per_group,
    box_stats,
    category_values,
    compare_to_row,
    count_by,
    count_where,
    cumulative,
    density_1d,
    density_points,
    grid_2d,
    hex_bins,
    histogram,
    kernel_density,
    kernel_density_2d,
    pairs,
    rate_by,
    row_filter,
    share,
    topk_filter,
    topk_groups,
    topk_rows,
    topk_show,
    trend,
    unpivot_measures,
)
from chartmeter.operators import rows as row_tests
from chartmeter.operators.boxes import radix_key


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.fixture(scope="module")
def cities(spark):
    rows = [
        ("CA", "Los Angeles", 39, 34.1, True),
        ("CA", "San Diego", 13, 32.7, False),
        ("CA", "San Jose", 10, 37.3, None),
        ("NY", "New York", 84, 40.7, True),
        ("NY", "Buffalo", 2, 42.9, True),
        ("TX", "Houston", 22, 29.8, False),
        ("TX", "Dallas", 13, 32.8, None),
        (None, "Nowhere", None, float("nan"), None),
    ]
    return spark.createDataFrame(rows, "state string, city string, pop int, lat double, coast boolean")


def test_counts_keep_null_as_a_group(cities):
    assert got(count_by(cities, "state"), "state", "n") == [
        ("CA", 3), ("NY", 2), ("TX", 2), (None, 1),
    ]


def test_aggregates(cities):
    assert got(agg_by(cities, "state", "pop", "avg"), "state", "value") == [
        ("CA", 62 / 3), ("NY", 43.0), ("TX", 17.5), (None, None),
    ]
    assert got(agg_by(cities, "state", "pop", "sum"), "value") == [(35,), (62,), (86,), (None,)]
    with pytest.raises(ValueError):
        agg_by(cities, "state", "pop", "mode")


def test_rates_leave_null_flags_out(cities):
    assert got(rate_by(cities, "state", "coast"), "state", "rate") == [
        ("CA", 0.5), ("NY", 1.0), ("TX", 0.0), (None, None),
    ]


def test_count_where_keeps_empty_groups(cities):
    assert got(count_where(cities, "state", F.col("pop") > 20), "state", "n") == [
        ("CA", 1), ("NY", 1), ("TX", 1), (None, 0),
    ]


def test_shares(cities):
    assert got(share(cities, "state"), "state", "share") == [
        ("CA", 0.375), ("NY", 0.25), ("TX", 0.25), (None, 0.125),
    ]
    assert got(share(cities, "state", "pop"), "share")[0] == (35 / 183,)
    assert share(cities.where("pop < 0"), "state", "pop").collect() == []


def test_top_groups_break_ties_by_key(cities):
    top = topk_groups(cities, "state", 2)
    assert [tuple(r) for r in top.collect()] == [("CA", 3), ("NY", 2)]


def test_top_rows_skip_nulls_and_nans(cities):
    assert [r.city for r in topk_rows(cities, "pop", 4, "city").collect()] == [
        "New York", "Los Angeles", "Houston", "Dallas",
    ]
    assert [r.city for r in topk_rows(cities, "lat", 2, "city").collect()] == ["Buffalo", "New York"]
    assert [r.city for r in topk_rows(cities, "pop", 1, "city", asc=True).collect()] == ["Buffalo"]


def test_top_filter_shows_another_measure(cities):
    rows = topk_filter(cities, "state", "pop", 2)
    assert got(rows, "city") == [
        ("Buffalo",), ("Los Angeles",), ("New York",), ("San Diego",), ("San Jose",),
    ]
    shown = topk_show(cities, "state", "pop", 2, {"north": ("max", "lat")})
    assert got(shown, "state", "north") == [("CA", 37.3), ("NY", 42.9)]


def test_best_row_per_group(cities, spark):
    best = argmax_per_group(cities, "state", "pop", "city", ["lat"])
    assert got(best, "state", "city", "lat") == [
        ("CA", "Los Angeles", 34.1), ("NY", "New York", 40.7), ("TX", "Houston", 29.8),
    ]
    assert got(argmax_per_group(cities, "state", "pop", "city", top_groups=1), "state") == [("CA",)]
    tied = spark.createDataFrame([("a", "y", 1), ("a", "x", 1)], "g string, k string, v int")
    assert got(argmax_per_group(tied, "g", "v", "k"), "k") == [("x",)]
    rows = [(None, 2, "2020-01-02", "p"), (None, 1, "2020-01-02", "q"), (None, 1, "2020-01-02", "o"), ("a", 1, None, "p"), ("b", 3, "2019-01-01", "r")]
    dates = spark.createDataFrame(rows, "g string, k int, d string, s string").withColumn("d", F.to_date("d"))
    best = {r.g: (r.k, str(r.d), r.s) for r in argmax_per_group(dates, "g", "d", "k", "s").collect()}
    assert best == {None: (1, "2020-01-02", "o"), "b": (3, "2019-01-01", "r")}


def test_histogram(spark):
    df = spark.createDataFrame(
        [("a", x) for x in (0.0, 1.0, 9.9, 10.0)] + [("b", 5.0), ("b", None), ("b", float("nan"))],
        "g string, x double",
    )
    assert got(histogram(df, "x", 5), "bin", "n") == [(0, 2), (1, 0), (2, 1), (3, 0), (4, 2)]
    by = histogram(df, "x", 2, by="g")
    assert got(by, "g", "bin", "n") == [("a", 0, 2), ("a", 1, 2), ("b", 0, 0), ("b", 1, 1)]
    assert got(by.where("g = 'a'"), "bin_lo", "bin_hi") == [(0.0, 5.0), (5.0, 10.0)]
    assert got(histogram(df, "x", 2, bounds=(0, 2)), "bin", "n") == [(0, 1), (1, 1)]


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert got(histogram(df, "x", 3), "bin", "n") == [(0, 2), (1, 0), (2, 0)]


def test_density_has_area_one(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.sqrt("id").alias("x"))
    area = F.sum(F.col("density") * (F.col("bin_hi") - F.col("bin_lo")))
    for by in (None, "g"):
        bars = density_1d(df, "x", 7, by)
        sums = bars.groupBy(*([by] if by else [])).agg(area.alias("area")).collect()
        assert all(math.isclose(r.area, 1.0) for r in sums)


def boxes(values):
    v = np.array(values)
    q1, q2, q3 = np.quantile(v, [0.25, 0.5, 0.75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = v[(v >= lo) & (v <= hi)]
    return (len(v), v.min(), q1, q2, q3, v.max(), lo, hi, inside.min(), inside.max(), len(v) - len(inside))


def test_radix_keys_order_as_doubles(spark):
    rng = random.Random(8)
    values = [0.0, -0.0, 5e-324, 1e-310, 2.0**-1022, math.nextafter(1, 0), 1.0, math.nextafter(1, 2), 1.7976931348623157e308, math.inf]
    values += [math.nextafter(2.0**k, d) for k in range(-1073, 1024, 7) for d in (-math.inf, math.inf)] + [2.0**k for k in range(-1074, 1024, 5)]
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(3000)]
    values += [-v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", radix_key(F.col("x")).alias("k"))
    found = sorted((r.x, r.k) for r in df.collect())
    for (a, j), (b, k) in zip(found, found[1:]):
        assert (a < b) == (j < k) and (a == b) == (j == k), (a, b)


def test_boxes_with_infinities(spark):
    inf = math.inf
    groups = {
        "above": [1.0, 2.0, 3.0, inf, inf], "below": [-inf, -inf, 0.0, 1.0, 1.5], "all": [inf] * 4,
        "upper quarter": [float(i) for i in range(50)] + [inf] * 30, "both": [-inf, 0.0, inf],
    }
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g string, x double")
    found = {r[0]: r for r in box_stats(df, "x", "g").collect()}
    assert found["upper quarter"][2:6] == (0.0, 19.75, 39.5, inf) and found["upper quarter"].n_outliers == 0
    assert found["all"][2:] == (inf,) * 9 + (0,)
    assert found["above"][2:6] == (1.0, 2.0, 3.0, inf) and found["above"].fence_hi == inf
    assert found["below"][2:6] == (-inf, -inf, 0.0, 1.0) and found["below"].whisker_lo == -inf
    assert found["both"].median == 0.0


def test_boxes_are_exact(spark):
    rng = random.Random(4)
    groups = {
        "one": [4.0],
        "two": [1.0, 2.0],
        "equal": [7.0] * 900,
        "normal": [rng.gauss(0, 1) for _ in range(3000)],
        "heavy": [rng.paretovariate(1.1) for _ in range(2500)],
        "steps": [float(rng.randint(0, 4)) for _ in range(2000)],
        "edge": [rng.random() for _ in range(51)],
        "close": [1 + rng.randint(0, 900) * 2.0**-52 for _ in range(700)],
        "many close": [1 + rng.randint(0, 1 << 20) * 2.0**-52 for _ in range(70_000)],
        "signs": [rng.choice((-1, 1)) * 10.0 ** rng.randint(-300, 300) for _ in range(700)],
        None: [rng.random() for _ in range(70)],
    }
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g string, x double")
    found = {
        row[0]: tuple(row)[1:]
        for row in box_stats(df, "x", "g").collect()
    }
    assert found.keys() == groups.keys()
    for group, values in groups.items():
        assert found[group] == pytest.approx(boxes(values)), group
    everything = [x for xs in groups.values() for x in xs]
    total = box_stats(df, "x").first()
    assert tuple(total) == pytest.approx(boxes(everything))


def test_boxes_leave_nulls_out_and_approximate(spark):
    rows = [(float(i),) for i in range(1001)] + [(None,), (float("nan"),), (9000.0,)]
    df = spark.createDataFrame(rows, "x double")
    row = box_stats(df, "x", method="approx").first()
    assert (row.n, row.max, row.n_outliers) == (1002, 9000.0, 1)
    assert abs(row.median - 500) <= 1
    with pytest.raises(ValueError):
        box_stats(df, "x", method="guess")


def test_grid(spark):
    df = spark.createDataFrame([(0.0, 0.0), (10.0, 1.0), (9.0, 0.9), (None, 1.0)], "x double, y double")
    assert got(grid_2d(df, "x", "y", 2, 2), "x_bin", "y_bin", "n") == [(0, 0, 1), (1, 1, 2)]


def test_hexagons_by_all_centres(spark):
    rng = random.Random(6)
    table = [(rng.uniform(-3, 9), rng.gauss(0, 2), rng.randint(1, 5)) for _ in range(400)]
    odd = [(None, 1.0, 1), (math.nan, 1.0, 1), (1.0, math.inf, 1)]
    df = spark.createDataFrame(table + odd, "x double, y double, z int")
    found = hex_bins(df, "x", "y", 7, ny=4, fn="sum", measure="z").collect()
    (xs, ys, _) = zip(*table)
    w, h = (max(xs) - min(xs)) / 7, (max(ys) - min(ys)) / 4
    centres = [(i, j) for i in range(-1, 17) for j in range(-1, 11) if (i + j) % 2 == 0 and i % 2 == j % 2]
    expected = {}
    for x, y, z in table:
        u, v = (x - min(xs)) / w, (y - min(ys)) / h
        at = min(centres, key=lambda c: (u - c[0] / 2) ** 2 + 3 * (v - c[1] / 2) ** 2)
        n, total = expected.get(at, (0, 0))
        expected[at] = (n + 1, total + z)
    assert {(r.hex_column, r.hex_row): (r.n, r.value) for r in found} == expected
    for r in found:
        assert (r.x, r.y) == pytest.approx((min(xs) + r.hex_column / 2 * w, min(ys) + r.hex_row / 2 * h))
    one = spark.createDataFrame([(2.0, 3.0)] * 5, "x double, y double")
    assert [tuple(r) for r in hex_bins(one, "x", "y", 3).collect()] == [(0, 0, 2.0, 3.0, 5)]
    assert hex_bins(one.limit(0), "x", "y", 3).count() == 0
    assert hex_bins(df, "x", "y", 5, x_bounds=(100, 200)).count() == 0


def _kernel(at, values, width):
    return np.exp(-0.5 * ((at[:, None] - values[None]) / width) ** 2).sum(1) / (len(values) * width * math.sqrt(2 * math.pi))


def test_kernel_density_is_near_the_direct_sum(spark):
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(0, 1, 500), "b": rng.exponential(2, 300), None: rng.uniform(-1, 4, 200)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("a", math.nan), ("a", math.inf)]
    rows += [("alone", 1.0), ("same", 2.0), ("same", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    found = {}
    for r in kernel_density(df, "x", 400, by="g").orderBy("point").collect():
        found.setdefault(r.g, []).append((r.x, r.density))
    assert found.keys() == {*groups, "alone", "same"} and all(len(v) == 400 for v in found.values())
    for g, values in groups.items():
        at, density = map(np.array, zip(*found[g]))
        expected = _kernel(at, values, values.std(ddof=1) * len(values) ** -0.2)
        assert np.abs(density - expected).max() < 0.002 * expected.max()
    assert {d for g in ("alone", "same") for _, d in found[g]} == {None}
    given = kernel_density(df.where("g = 'a'"), "x", 200, bounds=(-2, 2), bandwidth=0.5).orderBy("point").collect()
    inside = groups["a"][np.abs(groups["a"]) <= 2]
    expected = _kernel(np.linspace(-2, 2, 200), inside, 0.5)
    assert np.abs(np.array([r.density for r in given]) - expected).max() < 0.002 * expected.max()
    assert kernel_density(df.limit(0), "x").count() == 0


def test_kernel_surface_is_near_the_direct_sum(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(0, 1, 400), rng.uniform(0, 9, 400)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (0.0, math.inf)], "x double, y double")
    found = {(r.x_point, r.y_point): r for r in kernel_density_2d(df, "x", "y", 60, 50).collect()}
    assert len(found) == 3000
    wide, high = x.std(ddof=1) * 400 ** (-1 / 6), y.std(ddof=1) * 400 ** (-1 / 6)
    expected = {
        k: float(np.exp(-0.5 * (((r.x - x) / wide) ** 2 + ((r.y - y) / high) ** 2)).sum() / (400 * wide * high * 2 * math.pi))
        for k, r in found.items()
    }
    assert max(abs(found[k].density - e) for k, e in expected.items()) < 0.01 * max(expected.values())
    assert kernel_density_2d(df.limit(0), "x", "y").count() == 0
    flat = kernel_density_2d(df.withColumn("y", F.lit(1.0)), "x", "y", 3, 3).collect()
    assert flat and {r.density for r in flat} == {None}


def test_density_points(cities):
    top = density_points(cities, "lat", "pop", "pop", k=2, tie="city")
    assert got(top, "lat", "z") == [(34.1, 39), (40.7, 84)]


def test_trend_is_ordered(cities):
    assert [tuple(r) for r in trend(cities.where("state is not null"), "state").collect()] == [
        ("CA", 3), ("NY", 2), ("TX", 2),
    ]


@pytest.mark.parametrize("one_task_rows", [100_000, 3])
def test_running_totals(spark, one_task_rows):
    rng = random.Random(1)
    rows = [(rng.randint(0, 40), rng.choice([None, rng.randint(-5, 5)])) for _ in range(400)]
    rows += [(None, 2), (50, None)]
    df = spark.createDataFrame(rows, "k int, v int")
    found = cumulative(df, "k", "sum", "v", one_task_rows).collect()
    total, expected = None, {}
    for key in sorted({k for k, _ in rows}, key=lambda k: -1 if k is None else k):
        values = [v for k, v in rows if k == key and v is not None]
        if values:
            total = (total or 0) + sum(values)
        expected[key] = total
    assert {r.period: r.running for r in found} == expected
    counts = cumulative(df, "k", "count", one_task_rows=one_task_rows).orderBy("period").collect()
    assert counts[-1].running == len(rows)


def test_row_shapes(cities):
    assert got(pairs(cities.where("state = 'NY'"), "pop", "lat", "state"), "x", "y", "color") == [
        (2, 42.9, "NY"), (84, 40.7, "NY"),
    ]
    assert got(category_values(cities.where("pop > 80"), "city", "pop"), "label", "value") == [
        ("New York", 84),
    ]
    kept = row_filter(cities, row_tests.between("pop", 10, 22), row_tests.one_of("state", ["CA", "TX"]))
    assert got(kept, "city") == [("Dallas",), ("Houston",), ("San Diego",), ("San Jose",)]


def test_years(spark):
    df = spark.sql(
        "select * from values (timestamp_ntz'1999-12-31 23:59:59'), (timestamp_ntz'2000-01-01'),"
        " (timestamp_ntz'2001-06-01') t(d)"
    )
    counts = [df.where(f("d", 2000)).count() for f in (row_tests.before_year, row_tests.in_year, row_tests.after_year)]
    assert counts == [1, 1, 1]
    assert got(df.select(date_part(F.col("d"), "month").alias("m")), "m") == [(1,), (12,), (6,)]
    starts = df.select(date_part(F.col("d"), "month_start").cast("string").alias("m"))
    assert got(starts, "m") == [("1999-12-01",), ("2000-01-01",), ("2001-06-01",)]


def test_compare_to_row(cities):
    assert got(compare_to_row(cities, "city", "Houston", "pop"), "city") == [("Los Angeles",), ("New York",)]
    assert got(compare_to_row(cities, "city", "Buffalo", "pop", "<="), "city") == [("Buffalo",)]
    assert compare_to_row(cities, "city", "Paris", "pop").collect() == []


def test_unpivot_and_bands(cities):
    long = unpivot_measures(cities.where("city = 'Dallas'"), "city", ["pop", "lat"])
    assert got(long, "component", "value") == [("lat", 32.8), ("pop", 13.0)]
    bands = cities.select(number_bands(F.col("pop"), 10).alias("b"))
    assert got(count_by(bands, "b"), "b", "n") == [(0, 1), (10, 3), (20, 1), (30, 1), (80, 1), (None, 1)]
