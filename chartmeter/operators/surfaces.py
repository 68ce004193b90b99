"""Hexagonal bins and kernel densities.

Both reduce the rows to cells before any shuffle, so what moves depends on the number of
cells and groups only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmeter.operators.bins import Bounds, edges, numbers
from chartmeter.operators.groups import measure_column
from chartmeter.shared import stage


def _finite(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.where(F.abs(F.col(c).cast("double")) < float("inf"))
    return df


def hex_bins(
    df: DataFrame,
    x: str,
    y: str,
    nx: int,
    ny: int | None = None,
    fn: str = "count",
    measure: str | Column | None = None,
    x_bounds: Bounds | None = None,
    y_bounds: Bounds | None = None,
    name: str = "value",
) -> DataFrame:
    """One aggregate per hexagon that holds rows: ``hex_column, hex_row, x, y, n`` and the value.

    Hexagons are ``nx`` across and about as high as wide on a square chart (``ny`` rows of
    them, nx / sqrt(3) if not given). Their centres are those of two rectangular lattices,
    the second half a step off in both directions; columns and rows count half steps, so
    both are even or both odd. A row belongs to the nearer of the two centres next to it, to
    the first lattice if they are equally near. Null, NaN and infinite values are left out,
    and so are values outside bounds. Equal values in a direction are all in its first step.
    """
    ny = ny or max(1, int(nx / math.sqrt(3)))
    rows = _finite(numbers(df, x, y), x, y)
    ends = edges(rows, **{x: x_bounds, y: y_bounds})

    def steps(col: str, n: int) -> tuple[Column, Column, Column]:
        lo, hi = ends[col]
        width = F.when(hi > lo, (hi - lo) / F.lit(float(n))).otherwise(F.lit(1.0))
        return lo, width, (F.col(col).cast("double") - lo) / width

    (x_lo, x_width, u), (y_lo, y_width, v) = steps(x, nx), steps(y, ny)
    inside = F.lit(True)
    for c in (x, y):
        value = F.col(c).cast("double")
        inside = inside & (value >= ends[c][0]) & (value <= ends[c][1])
    placed = rows.where(inside).withColumns({"_u": u, "_v": v})
    u, v = F.col("_u"), F.col("_v")
    near = {"i": F.floor(u + 0.5), "j": F.floor(v + 0.5)}
    far = {"i": F.floor(u), "j": F.floor(v)}
    # in units of a step, a hexagon is sqrt(3) times as high as it is wide
    first = (u - near["i"]) * (u - near["i"]) + F.lit(3.0) * (v - near["j"]) * (v - near["j"])
    du, dv = u - far["i"] - 0.5, v - far["j"] - 0.5
    second = du * du + F.lit(3.0) * dv * dv
    column = F.when(first <= second, 2 * near["i"]).otherwise(2 * far["i"] + 1)
    row = F.when(first <= second, 2 * near["j"]).otherwise(2 * far["j"] + 1)
    shown = [] if fn == "count" and measure is None else [measure_column(fn, measure).alias(name)]
    cells = placed.groupBy(column.alias("hex_column"), row.alias("hex_row")).agg(F.count(F.lit(1)).alias("n"), *shown)
    return cells.select(
        "hex_column",
        "hex_row",
        (x_lo + F.col("hex_column") / F.lit(2.0) * x_width).alias("x"),
        (y_lo + F.col("hex_row") / F.lit(2.0) * y_width).alias("y"),
        "n",
        *(name for _ in shown),
    )


def _step(lo: Column, hi: Column, points: int) -> Column:
    return (hi - lo) / F.lit(float(points - 1))


def _cell(value: Column, lo: Column, step: Column, points: int) -> tuple[Column, Column]:
    """The grid point before a value, and how far it is on the way to the next one."""
    u = F.when(step > 0, (value - lo) / step).otherwise(F.lit(0.0))
    i = F.least(F.floor(u), F.lit(points - 2).cast("bigint"))
    return i, u - i


def _bandwidth(n: Column, total: Column, squares: Column, given: Column | None, dimensions: int) -> Column:
    """In grid steps: as given, or Scott's rule from the sums over all positions and squares."""
    if given is not None:
        return given
    spread = F.sqrt(F.greatest((squares - total * total / n) / (n - 1), F.lit(0.0)))
    return F.when(n > 1, spread * F.pow(n.cast("double"), F.lit(-1.0 / (dimensions + 4))))


def _spread_out(weights: DataFrame, keep: list[str], at: str, width: str, points: int) -> DataFrame:
    """Convolution with a Gaussian along one axis: every point's weight, over all points."""
    target = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(points - 1).cast("bigint"))).alias("_to")
    far = (F.col("_to") - F.col(at)) / F.col(width)
    share = F.col("weight") * F.exp(F.lit(-0.5) * far * far) / (F.lit(math.sqrt(2 * math.pi)) * F.col(width))
    others = [c for c in weights.columns if c not in (at, "weight")]
    out = weights.select(*others, at, "weight", target).select(*others, F.col("_to").alias(at), share.alias("weight"))
    return out.groupBy(*keep, at).agg(F.sum("weight").alias("weight"), *[F.max(c).alias(c) for c in others if c not in keep])


def kernel_density(
    df: DataFrame,
    col: str,
    points: int = 128,
    by: str | None = None,
    bounds: Bounds | None = None,
    bandwidth: float | None = None,
) -> DataFrame:
    """Gaussian kernel density at ``points`` evenly spaced values, over all rows or per ``by``.

    Rows are shared out between the two grid points next to them (linear binning), and the
    grid points' weights are convolved. The bandwidth is Scott's rule per group unless given.
    Columns: [by], point, x, density. Null, NaN and infinite values and those outside bounds
    are left out; a group whose values are all equal, or that has one, has no bandwidth of
    its own, and then a null density at every point.
    """
    if points < 2:
        raise ValueError("a curve needs two points")
    keys = [by] if by else []
    rows = _finite(numbers(df, col), col)
    lo, hi = edges(rows, **{col: bounds})[col]
    step = _step(lo, hi, points)
    value = F.col(col).cast("double")
    i, f = _cell(value, lo, step, points)
    placed = rows.where((value >= lo) & (value <= hi)).select(*keys, i.alias("point"), f.alias("f"))
    cells = placed.groupBy(*keys, "point").agg(
        F.count(F.lit(1)).alias("n"), F.sum("f").alias("f"), F.sum(F.col("f") * F.col("f")).alias("ff")
    )
    at, n = F.col("point"), F.col("n")
    facts = cells.groupBy(*keys).agg(
        F.sum("n").alias("rows"),
        F.sum(at * n + F.col("f")).alias("total"),
        F.sum(at * at * n + 2 * at * F.col("f") + F.col("ff")).alias("squares"),
        F.collect_list(F.struct("point", (n - F.col("f")).alias("weight"))).alias("here"),
        F.collect_list(F.struct((at + 1).alias("point"), F.col("f").alias("weight"))).alias("next"),
    )
    given = None if bandwidth is None else F.when(step > 0, F.lit(float(bandwidth)) / step)
    width = _bandwidth(F.col("rows"), F.col("total"), F.col("squares"), given, 1)
    # a group's cells are at most ``points``
    weights = facts.select(
        *keys, "rows", width.alias("width"), F.inline(F.concat("here", "next")).alias("point", "weight")
    )
    usable = F.when(F.col("width") > 0, F.col("width")).alias("width")
    weights = weights.select(*keys, "rows", usable, "point", "weight")
    curve = _spread_out(weights, keys, "point", "width", points)
    return curve.select(
        *keys,
        "point",
        (lo + F.col("point") * step).alias("x"),
        (F.col("weight") / (F.col("rows") * step)).alias("density"),
    )


def kernel_density_2d(
    df: DataFrame,
    x: str,
    y: str,
    nx: int = 32,
    ny: int = 32,
    x_bounds: Bounds | None = None,
    y_bounds: Bounds | None = None,
) -> DataFrame:
    """Gaussian kernel density on an ``nx`` by ``ny`` grid: ``x_point, y_point, x, y, density``.

    Rows are shared out between the four grid points around them, and weights are convolved
    along one axis and then the other, as the kernel is the product of the two. Bandwidths
    are Scott's rule per axis. What is left out, and when densities are null, is as for
    ``kernel_density``.
    """
    if min(nx, ny) < 2:
        raise ValueError("a surface needs two points each way")
    rows = _finite(numbers(df, x, y), x, y)
    # Edges and moments are single rows, and the result names them often: fetched once each.
    seen = rows.agg(*(end(F.col(c).cast("double")) for c in (x, y) for end in (F.min, F.max))).first()
    ends = [float(b) for given, found in ((x_bounds, seen[:2]), (y_bounds, seen[2:])) for b in given or (v or 0.0 for v in found)]
    x_lo, x_hi, y_lo, y_hi = map(F.lit, ends)
    steps = {"x": _step(x_lo, x_hi, nx), "y": _step(y_lo, y_hi, ny)}
    u, v = F.col(x).cast("double"), F.col(y).cast("double")
    (i, f), (j, g) = _cell(u, x_lo, steps["x"], nx), _cell(v, y_lo, steps["y"], ny)
    inside = (u >= x_lo) & (u <= x_hi) & (v >= y_lo) & (v <= y_hi)
    placed = rows.where(inside).select(i.alias("x_point"), j.alias("y_point"), f.alias("f"), g.alias("g"))
    f, g, n = F.col("f"), F.col("g"), F.col("n")
    sums = {"f": f, "g": g, "ff": f * f, "gg": g * g, "fg": f * g}
    cells = placed.groupBy("x_point", "y_point").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(k) for k, c in sums.items()))
    cells = stage(cells, "cells")
    i, j = F.col("x_point"), F.col("y_point")
    facts = cells.agg(
        F.sum("n").alias("rows"),
        F.sum(i * n + f).alias("x"),
        F.sum(i * i * n + 2 * i * f + F.col("ff")).alias("xx"),
        F.sum(j * n + g).alias("y"),
        F.sum(j * j * n + 2 * j * g + F.col("gg")).alias("yy"),
    )
    facts = {c: F.lit(v).cast("double") for c, v in facts.first().asDict().items()}
    corner = F.col("fg")
    corners = F.array(
        F.struct(i.alias("x_point"), j.alias("y_point"), (n - f - g + corner).alias("weight")),
        F.struct((i + 1).alias("x_point"), j.alias("y_point"), (f - corner).alias("weight")),
        F.struct(i.alias("x_point"), (j + 1).alias("y_point"), (g - corner).alias("weight")),
        F.struct((i + 1).alias("x_point"), (j + 1).alias("y_point"), corner.alias("weight")),
    )
    weights = cells.select(F.inline(corners)).groupBy("x_point", "y_point").agg(F.sum("weight").alias("weight"))
    widths = {
        axis: _bandwidth(facts["rows"], facts[axis], facts[axis * 2], None, 2) for axis in ("x", "y")
    }
    weights = weights.withColumns({f"{axis}_width": F.when(w > 0, w) for axis, w in widths.items()})
    along = _spread_out(weights, ["y_point", "y_width"], "x_point", "x_width", nx)
    surface = _spread_out(along.drop("x_width"), ["x_point"], "y_point", "y_width", ny)
    return surface.select(
        "x_point",
        "y_point",
        (x_lo + F.col("x_point") * steps["x"]).alias("x"),
        (y_lo + F.col("y_point") * steps["y"]).alias("y"),
        (F.col("weight") / (facts["rows"] * steps["x"] * steps["y"])).alias("density"),
    )
