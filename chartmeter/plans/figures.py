"""Figure JSON to chart records and on to tagged points.

A record is ``map<string, variant>``: the keys of a figure's only trace, or the
joined x and y of several. Zipping and joining happen inside a figure's row, so
getting from JSON to points needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmeter.functions.values import tag_variant
from chartmeter.shared import dealt_out

# The trace keys a golden record keeps. ``subplot`` is added here,
# since the comparison of density maps asks for it.
FIGURE_KEYS = [
    "x", "y", "xaxis", "yaxis", "type",
    "lat", "lon", "z",
    "domain", "labels", "values",
    "xbingroup", "ybingroup",
    "subplot",
]

# Which two arrays of a record are compared as keys and values.
PAIRS = {"xy": ("x", "y"), "latlon": ("lat", "lon"), "labelsvalues": ("labels", "values")}


def _get(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def _is_nothing(v: Column) -> Column:
    """Missing or JSON null."""
    return v.isNull() | F.is_variant_null(v)


def elements(v: Column) -> Column:
    """What iterating over a value gives: an array's elements, a string's characters,
    NULL for anything else."""
    text = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    letters = F.when(text == "", F.array().cast("array<variant>")).otherwise(
        F.transform(F.split(text, ""), lambda c: c.cast("variant"))
    )
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), letters)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once per row.

    A filter on them would otherwise be pushed below, with a copy of what they
    are made of, parsing included; it cannot be pushed below a generator.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    added = df.withColumn("_row", F.explode(F.array(row)))
    return added.select(*df.columns, *[f"_row.{name}" for name in columns])


#: Bytes of JSON from which a text that does not become a VARIANT may just be too large for one.
LARGE_BYTES = 64 << 20


#: A quoted text, and a spelling of a number that is none but that the lenient reader takes.
_QUOTED = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_NO_NUMBER = r"INF|\+ *(Infinity|NaN)|- *NaN"


def _figure(text: Column) -> Column:
    """JSON text as VARIANT; NaN, Infinity and -Infinity are numbers in it. Texts without
    these tokens are read by the strict reader only."""
    bare = F.regexp_replace(text, _QUOTED, "")
    lenient = F.octet_length(text) < LARGE_BYTES
    lenient = lenient & text.rlike("NaN|Infinity") & bare.rlike("NaN|Infinity") & ~bare.rlike(_NO_NUMBER)
    loose = F.from_json(text, "variant", {"allowSingleQuotes": "false"})
    return F.coalesce(F.try_parse_json(text), F.when(lenient, loose))


def parse_figures(df: DataFrame, json_col: str) -> DataFrame:
    """Add ``status`` and ``traces array<variant>``. NaN and Infinity count as numbers.

    status: ``ok``, ``bad_json`` (not JSON, or none), ``too_large`` (no VARIANT can be made
    of so long a text), ``no_data`` (no data key) or ``bad_data`` (data is no array).
    """
    figure, data, traces = F.col("_figure"), F.col("_data"), F.col("_traces")
    large = F.octet_length(F.col(json_col)) >= LARGE_BYTES
    status = (
        F.when(figure.isNull() & large, "too_large")
        .when(figure.isNull(), "bad_json")
        .when(data.isNull(), "no_data")
        .when(traces.isNull(), "bad_data")
        .otherwise("ok")
    )
    parsed = (
        dealt_out(df)
        .withColumn("_figure", _figure(F.col(json_col)))
        .withColumn("_data", _get(figure, "data"))
        .withColumn("_traces", F.try_variant_get(data, "$", "array<variant>"))
    )
    return _once(parsed, status=status, traces=traces).drop("_figure", "_data", "_traces")


def _projected(traces: Column, keys: list[str] | None) -> Column:
    record = F.try_variant_get(F.get(traces, 0), "$", "map<string,variant>")
    if keys is None:
        return record
    return F.map_filter(record, lambda key, _: key.isin(*keys))


def _joined(traces: Column, key: str) -> Column:
    """Elements of one key over all traces that have it; NULL if one of them has none."""
    holders = F.filter(traces, lambda t: _get(t, key).isNotNull())
    return F.flatten(F.transform(holders, lambda t: elements(_get(t, key))))


def _first(traces: Column, key: str) -> Column:
    found = F.filter(F.transform(traces, lambda t: _get(t, key)), lambda v: ~_is_nothing(v))
    return F.coalesce(F.get(found, 0), F.parse_json(F.lit("null")))


def _flattened(traces: Column) -> Column:
    x, y = _joined(traces, "x"), _joined(traces, "y")
    record = F.create_map(
        F.lit("x"), x.cast("variant"),
        F.lit("y"), y.cast("variant"),
        F.lit("type"), _first(traces, "type"),
        F.lit("xaxis"), _first(traces, "xaxis"),
        F.lit("yaxis"), _first(traces, "yaxis"),
    )
    return F.when(F.forall(traces, _is_object) & x.isNotNull() & y.isNotNull(), record)


def project_trace(figures: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``record`` of figures with exactly one trace: all its keys, or those of ``keys``
    it has. A trace that is no object gives NULL."""
    one = figures.where((F.col("status") == "ok") & (F.size("traces") == 1))
    return one.withColumn("record", _projected(F.col("traces"), keys)).drop("traces")


def flatten_traces(figures: DataFrame) -> DataFrame:
    """``record`` of figures with any other number of traces: x and y joined in trace
    order, type and axes from the first trace that has them. NULL if a trace is no
    object, or its x or y cannot be joined."""
    many = figures.where((F.col("status") == "ok") & (F.size("traces") != 1))
    return many.withColumn("record", _flattened(F.col("traces"))).drop("traces")


def figure_records(df: DataFrame, json_col: str, keys: list[str] | None = None) -> DataFrame:
    """Replace figure JSON by ``status`` and ``record``, whatever its number of traces;
    status ``bad_trace`` marks traces without a record."""
    traces, status, record = F.col("traces"), F.col("_status"), F.col("_record")
    made = F.when(F.size(traces) == 1, _projected(traces, keys)).otherwise(_flattened(traces))
    parsed = (
        parse_figures(df, json_col)
        .withColumnRenamed("status", "_status")
        .withColumn("_record", F.when(status == "ok", made))
    )
    bad_trace = F.when((status == "ok") & record.isNull(), "bad_trace")
    done = _once(parsed, status=F.coalesce(bad_trace, status), record=record)
    return done.drop("_status", "_record", "traces", json_col)


def field(record: Column, key: str) -> Column:
    return F.try_element_at(record, F.lit(key))


def _with_arrays(records: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """case_id and the arrays of the given keys; NULL where a record has none."""
    arrays = [elements(field(F.col("record"), key)).alias(key) for key in keys]
    return records.select(F.col(id_col).alias("case_id"), *arrays)


def zipped(*keys: str, names: list[str]) -> Column:
    """Arrays side by side, as long as the shortest one; NULL unless all are there."""
    n = F.least(*[F.size(key) for key in keys])
    together = F.arrays_zip(*[F.slice(key, 1, n) for key in keys])
    rows = F.transform(
        together, lambda row: F.struct(*[row[str(i)].alias(name) for i, name in enumerate(names)])
    )
    all_there = F.lit(True)
    for key in keys:
        all_there = all_there & F.col(key).isNotNull()
    return F.when(all_there, rows)


def _tag_points(points: DataFrame, names: list[str]) -> DataFrame:
    """Replace struct ``point`` by its tagged fields."""
    kept = [c for c in points.columns if c != "point"]
    values = [F.col(f"point.{name}").alias(name) for name in names]
    shapes = [F.schema_of_variant(f"point.{name}").alias(f"{name}_shape") for name in names]
    tags = [tag_variant(F.col(name), F.col(f"{name}_shape")).alias(name) for name in names]
    return points.select(*kept, *values, *shapes).select(*kept, *tags)


def explode_points(
    records: DataFrame, id_col: str = "case_id", pairs: list[str] | None = None
) -> DataFrame:
    """One row per position of each pair of arrays: case_id, pair, pos, k, v (tagged)."""
    pairs = list(pairs or PAIRS)
    arrays = _with_arrays(records, id_col, [key for pair in pairs for key in PAIRS[pair]])
    zips = [
        F.struct(F.lit(pair).alias("pair"), zipped(*PAIRS[pair], names=["k", "v"]).alias("points"))
        for pair in pairs
    ]
    return (
        arrays.select("case_id", F.explode(F.array(*zips)).alias("p"))
        .where(F.col("p.points").isNotNull())
        .select("case_id", "p.pair", F.posexplode("p.points").alias("pos", "point"))
        .transform(_tag_points, ["k", "v"])
    )


def explode_triples(records: DataFrame, id_col: str = "case_id") -> DataFrame:
    """One row per position of lat, lon and z: case_id, pos, k1, k2, v (tagged)."""
    names = ["k1", "k2", "v"]
    together = zipped("lat", "lon", "z", names=names)
    return (
        _with_arrays(records, id_col, ["lat", "lon", "z"])
        .select("case_id", F.posexplode(together).alias("pos", "point"))
        .transform(_tag_points, names)
    )


def last_values(points: DataFrame, keys: list[str]) -> DataFrame:
    """Collapse repeated keys of a case: the value at the highest position stays."""
    return points.groupBy(*keys).agg(F.max_by("v", "pos").alias("v"))
