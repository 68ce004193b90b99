"""Case corpus, chart records and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import table
from chartmeter.plans import (
    FIGURE_KEYS,
    explode_points,
    explode_triples,
    figure_records,
    flatten_traces,
    last_values,
    parse_figures,
    project_trace,
)
from chartmeter.shared import new_path
from chartmeter.sources import (
    build_cases,
    corpus_summary,
    filter_cases,
    read_cases,
    read_goldens,
    count_misfits,
    read_source,
    write_cases,
    write_goldens,
)


def _cases(spark, sf):
    """A case per document: its source is the dataset, its whole text the question."""
    documents = table(spark, sf, "documents")
    level = F.when(F.col("n_chars") % 4 == 0, "WithoutPlotType").otherwise("WithPlotType")
    return build_cases(
        documents.select(
            F.col("source").alias("dataset"),
            level.alias("complexity"),
            F.col("text").alias("description"),
        )
    )


def case_ids(spark, sf):
    cases = _cases(spark, sf)
    return cases.withColumn("description", F.length("description"))


def filtered_cases(spark, sf):
    cases = filter_cases(_cases(spark, sf), dataset="src1", complexity="WithPlotType", uuid="")
    return cases.select("uuid", "dataset", "complexity")


def cases_per_dataset(spark, sf):
    return corpus_summary(_cases(spark, sf))


def cases_through_files(spark, sf):
    path = new_path(spark, "cases")
    write_cases(_cases(spark, sf), path, "train")
    return read_cases(spark, path, lines=True).select(
        "uuid", "dataset", "language", "complexity", F.md5("description").alias("description")
    )


def _trace(**keys):
    """A trace from constants, columns, and lists of columns of any types."""
    values = []
    for key, value in keys.items():
        if isinstance(value, list):
            value = F.array(*[v.cast("variant") for v in value])
        values.append((F.lit(value) if isinstance(value, str) else value).alias(key))
    return F.struct(*values)


def _figure(*traces):
    """Figure JSON; keys that are NULL are left out. Several traces are turned into
    VARIANT so that they may differ in their keys."""
    if len(traces) > 1:
        traces = [F.to_variant_object(trace) for trace in traces]
    return F.to_json(F.struct(F.array(*traces).alias("data")))


def _bar():
    return _trace(
        type="bar",
        name=F.col("o_orderstatus"),
        x=[F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderstatus")],
        y=[F.col("o_custkey"), F.col("o_orderkey"), F.col("o_totalprice"), F.lit(7)],
        xaxis="x",
    )


def _second():
    return _trace(
        x=[F.col("o_totalprice")], y=[F.col("o_orderpriority")], type="scatter", xaxis="x2", yaxis="y2"
    )


def _figures(spark, sf):
    """One figure per order, in five shapes: two good ones and three broken ones."""
    shape = F.col("o_orderkey") % 5
    figure = (
        F.when(shape == 0, _figure(_bar()))
        .when(shape == 1, F.to_json(F.struct(F.col("o_orderkey").alias("layout"))))
        .when(shape == 2, F.concat(F.lit("figure of "), F.col("o_orderkey")))
        .when(shape == 3, F.to_json(F.struct(F.col("o_totalprice").alias("data"))))
        .otherwise(_figure(_bar(), _second()))
    )
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"), figure.alias("figure_json")
    )


def figure_status(spark, sf):
    parsed = parse_figures(_figures(spark, sf), "figure_json")
    return parsed.select("case_id", "status", F.size("traces").alias("n_traces")).withColumn(
        "n_traces", F.when(F.col("status") == "ok", F.col("n_traces"))
    )


def _shown(records):
    def text(key):
        return F.try_variant_get(F.try_element_at("record", F.lit(key)), "$", "string")

    return records.select(
        "case_id",
        F.array_join(F.array_sort(F.map_keys("record")), ",").alias("keys"),
        text("type").alias("type"),
        text("xaxis").alias("xaxis"),
        text("yaxis").alias("yaxis"),
    )


def single_trace_records(spark, sf):
    parsed = parse_figures(_figures(spark, sf), "figure_json")
    return _shown(project_trace(parsed, FIGURE_KEYS))


def single_trace_records_all_keys(spark, sf):
    return _shown(project_trace(parse_figures(_figures(spark, sf), "figure_json")))


def flattened_records(spark, sf):
    return _shown(flatten_traces(parse_figures(_figures(spark, sf), "figure_json")))


def _flat(points, *tagged):
    fields = [
        F.col(f"{name}.{part}").alias(f"{name}_{part}")
        for name in tagged
        for part in ("kind", "num", "str")
    ]
    kept = [c for c in points.columns if c not in tagged]
    return points.select(*kept, *fields)


def figure_points(spark, sf):
    records = figure_records(_figures(spark, sf), "figure_json", FIGURE_KEYS)
    return _flat(explode_points(records), "k", "v")


def last_figure_values(spark, sf):
    records = figure_records(_figures(spark, sf), "figure_json", FIGURE_KEYS)
    return _flat(last_values(explode_points(records), ["case_id", "pair", "k"]), "k", "v")


def figures_without_numbers(spark, sf):
    """Arrays that hold NaN and infinities, as numbers or quoted, and spellings of neither."""
    key = F.col("o_orderkey")
    values = F.array(*map(F.lit, ("NaN", "Infinity", "-Infinity", '"NaN"', "INF", "nan", "-NaN")))
    y = F.concat(F.lit("["), F.get(values, (key % 7).cast("int")), F.lit(", 2]"))
    text = F.concat(F.lit('{"data": [{"type": "bar", "x": [1, '), key.cast("string"), F.lit('], "y": '), y, F.lit("}]}"))
    figures = table(spark, sf, "orders").select(key.alias("case_id"), text.alias("figure_json"))
    parsed = figure_records(figures, "figure_json")
    points = explode_points(parsed, "case_id", ["xy"]).select("case_id", "pos", "v")
    first = points.where("pos = 0").select("case_id", F.col("v.kind").alias("kind"), F.coalesce(F.col("v.num").cast("string"), "v.str").alias("value"))
    return parsed.select("case_id", "status").join(first, "case_id", "left")


def map_points(spark, sf):
    """Suppliers as one density map each, with one more latitude than longitudes."""
    trace = _trace(
        type="densitymapbox",
        lat=[F.col("s_suppkey"), F.col("s_nationkey"), F.lit(0)],
        lon=[F.col("s_nationkey"), F.col("s_suppkey")],
        z=[F.col("s_acctbal"), F.col("s_name"), F.lit(1)],
        subplot="mapbox",
    )
    figures = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("case_id"), _figure(trace).alias("figure_json")
    )
    return _flat(explode_triples(figure_records(figures, "figure_json")), "k1", "k2", "v")


def goldens_through_files(spark, sf):
    """Records of the good figures, written and read back."""
    orders = _figures(spark, sf).join(
        table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), "o_custkey"), "case_id"
    )
    records = figure_records(orders, "figure_json", FIGURE_KEYS).where("status = 'ok'")
    path = new_path(spark, "goldens")
    write_goldens(
        records.select(
            F.col("case_id").cast("string").alias("uuid"),
            F.concat(F.lit("set "), F.col("o_custkey") % 3).alias("dataset"),
            "record",
        ),
        path,
        "train",
    )
    return _shown(read_goldens(spark, path, lines=True).withColumnRenamed("uuid", "case_id"))


def cases_default_reader(spark, sf):
    """What is written is read back without saying how it was written."""
    path = new_path(spark, "cases")
    write_cases(_cases(spark, sf), path, "train")
    return read_cases(spark, path).select("uuid", "dataset", "complexity", F.md5("description").alias("description"))


def cases_of_a_split(spark, sf):
    """Two splits written side by side; one of them picked."""
    path = new_path(spark, "splits")
    cases = _cases(spark, sf)
    write_cases(cases, path, "train")
    write_cases(cases.where("complexity = 'WithPlotType'"), path, "test")
    return filter_cases(read_cases(spark, path), split="test").select("uuid", "complexity", "split")


def goldens_default_reader(spark, sf):
    """Records of every golden come back, their arrays included."""
    path = new_path(spark, "goldens")
    records = figure_records(_figures(spark, sf), "figure_json", FIGURE_KEYS).where("status = 'ok'")
    named = records.select(F.col("case_id").cast("string").alias("uuid"), F.lit("orders").alias("dataset"), "record")
    write_goldens(named, path, "test")
    return _arrays(read_goldens(spark, path).withColumnRenamed("uuid", "case_id"))


def _arrays(records):
    """x as joined text and y in cents, so that whole arrays are compared."""
    x = F.try_variant_get(F.try_element_at("record", F.lit("x")), "$", "array<string>")
    y = F.try_variant_get(F.try_element_at("record", F.lit("y")), "$", "array<variant>")

    def shown(v):
        number = F.try_variant_get(v, "$", "double")
        cents = F.round(number * 100).cast("bigint").cast("string")
        return F.coalesce(F.when(F.schema_of_variant(v) != "STRING", cents), F.try_variant_get(v, "$", "string"))

    return records.select("case_id", F.array_join(x, "|").alias("x"), F.array_join(F.transform(y, shown), "|").alias("y"))


def flattened_arrays(spark, sf):
    """x and y of several traces, joined in their order."""
    bar, second = _bar(), _trace(x=[F.col("o_orderpriority")], y=[F.col("o_orderstatus"), F.col("o_custkey")], type="scatter")
    figures = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), _figure(bar, second).alias("figure_json"))
    return _arrays(flatten_traces(parse_figures(figures, "figure_json")))


def large_integer_points(spark, sf):
    """Keys one apart beyond 2**53 stay two keys; of a repeated one the last value counts."""
    big = F.col("o_orderkey") + F.lit(9007199254740992)
    trace = _trace(type="bar", x=[big, big + 1, big], y=[F.col("o_custkey"), big + 1, big])
    figures = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), _figure(trace).alias("figure_json"))
    points = explode_points(figure_records(figures, "figure_json"))
    last = last_values(points, ["case_id", "pair", "k"])
    return last.select("case_id", F.col("k.str").alias("k"), F.col("v.str").alias("v"))


def csv_with_missing_values(spark, sf):
    """Numbers with several spellings of a missing one stay numbers."""
    path = new_path(spark, "missing")
    key = F.col("s_suppkey")
    spelling = F.when(key % 5 == 0, "NA").when(key % 5 == 1, "null").when(key % 5 == 2, "N/A")
    balance = F.coalesce(spelling, F.round(F.col("s_acctbal") * 100).cast("bigint").cast("string"))
    table(spark, sf, "supplier").select("s_suppkey", balance.alias("cents")).write.option("header", True).csv(path)
    return read_source(spark, path).select("s_suppkey", F.col("cents").cast("bigint").alias("cents"), F.typeof("cents").alias("kind"))


def _seats(spark, sf):
    path = new_path(spark, "seats")
    key = F.col("o_orderkey")
    table(spark, sf, "orders").select(
        key,
        F.concat(F.col("o_custkey") % 40, F.when(key % 2 == 0, "D").otherwise("f")).alias("seat"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        (key.cast("decimal(38,0)") + F.lit(9223372036854775807).cast("decimal(38,0)")).alias("far"),
    ).write.option("header", True).csv(path)
    return path


def seats_through_csv(spark, sf):
    """Codes that look like numbers, months that look like days, and large whole numbers."""
    read = read_source(spark, _seats(spark, sf))
    kinds = F.concat_ws(",", *(F.typeof(c) for c in ("seat", "month", "day", "far")))
    return read.select("o_orderkey", "seat", "month", F.col("day").cast("string").alias("day"), F.col("far").cast("string").alias("far"), kinds.alias("kinds"))


def seat_misfits(spark, sf):
    """What a schema of numbers and days would lose of the same file."""
    schema = "o_orderkey bigint, seat double, month date, day date, far bigint"
    return count_misfits(spark, _seats(spark, sf), schema)


def suppliers_through_csv(spark, sf):
    """Suppliers with an accented name, through ISO-8859-1 CSV with inferred types."""
    path = new_path(spark, "suppliers")
    suppliers = table(spark, sf, "supplier").withColumn(
        "s_name", F.concat(F.col("s_name"), F.lit(", \"Île-d'Été\""))
    )
    suppliers.write.option("header", True).option("encoding", "ISO-8859-1").option(
        "escape", '"'
    ).csv(path)
    return read_source(spark, path, encoding="ISO-8859-1")


QUERIES = {
    f.__name__: f
    for f in (
        case_ids,
        filtered_cases,
        cases_per_dataset,
        cases_through_files,
        figure_status,
        single_trace_records,
        single_trace_records_all_keys,
        flattened_records,
        figure_points,
        last_figure_values,
        map_points,
        goldens_through_files,
        suppliers_through_csv,
        cases_default_reader,
        cases_of_a_split,
        goldens_default_reader,
        flattened_arrays,
        large_integer_points,
        csv_with_missing_values,
        seats_through_csv,
        seat_misfits,
        figures_without_numbers,
    )
}

_CASES = """
    cases AS (
        SELECT md5(source || text) AS uuid, source AS dataset, 'English' AS language,
               CASE WHEN n_chars % 4 = 0 THEN 'WithoutPlotType' ELSE 'WithPlotType' END AS complexity,
               text AS description
        FROM documents)"""

_POINTS = """
    points AS (
        SELECT o_orderkey AS case_id, 0 AS pos, o_orderstatus AS k, NULL::DOUBLE AS kn,
               o_custkey::DOUBLE AS v, NULL::VARCHAR AS vs FROM orders WHERE o_orderkey % 5 IN (0, 4)
        UNION ALL
        SELECT o_orderkey, 1, o_orderpriority, NULL, o_orderkey::DOUBLE, NULL
        FROM orders WHERE o_orderkey % 5 IN (0, 4)
        UNION ALL
        SELECT o_orderkey, 2, o_orderstatus, NULL, o_totalprice, NULL
        FROM orders WHERE o_orderkey % 5 IN (0, 4)
        UNION ALL
        SELECT o_orderkey, 3, NULL, o_totalprice, 7, NULL FROM orders WHERE o_orderkey % 5 = 4)"""

_POINT_COLUMNS = """
    CASE WHEN k IS NULL THEN 'num' ELSE 'str' END AS k_kind, kn AS k_num, k AS k_str,
    'num' AS v_kind, v AS v_num, vs AS v_str"""

ORACLES = {
    "case_ids": f"""
        WITH {_CASES}
        SELECT uuid, dataset, language, complexity,
               CAST(length(description) AS INTEGER) AS description FROM cases""",
    "filtered_cases": f"""
        WITH {_CASES}
        SELECT uuid, dataset, complexity FROM cases
        WHERE dataset = 'src1' AND complexity = 'WithPlotType'""",
    "cases_per_dataset": f"""
        WITH {_CASES}
        SELECT dataset, GROUPING(dataset) = 1 AS is_total, COUNT(*) AS cases,
               COUNT(CASE WHEN complexity = 'WithPlotType' THEN 1 END) AS with_plot_type,
               COUNT(CASE WHEN complexity = 'WithoutPlotType' THEN 1 END) AS without_plot_type
        FROM cases GROUP BY ROLLUP (dataset)""",
    "cases_through_files": f"""
        WITH {_CASES}
        SELECT uuid, dataset, language, complexity, md5(description) AS description FROM cases""",
    "figure_status": """
        SELECT o_orderkey AS case_id,
               CASE o_orderkey % 5 WHEN 1 THEN 'no_data' WHEN 2 THEN 'bad_json'
                    WHEN 3 THEN 'bad_data' ELSE 'ok' END AS status,
               CAST(CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 4 THEN 2 END AS INTEGER) AS n_traces
        FROM orders""",
    "single_trace_records": """
        SELECT o_orderkey AS case_id, 'type,x,xaxis,y' AS keys, 'bar' AS type, 'x' AS xaxis,
               CAST(NULL AS VARCHAR) AS yaxis
        FROM orders WHERE o_orderkey % 5 = 0""",
    "single_trace_records_all_keys": """
        SELECT o_orderkey AS case_id, 'name,type,x,xaxis,y' AS keys, 'bar' AS type, 'x' AS xaxis,
               CAST(NULL AS VARCHAR) AS yaxis
        FROM orders WHERE o_orderkey % 5 = 0""",
    "flattened_records": """
        SELECT o_orderkey AS case_id, 'type,x,xaxis,y,yaxis' AS keys, 'bar' AS type, 'x' AS xaxis,
               'y2' AS yaxis
        FROM orders WHERE o_orderkey % 5 = 4""",
    "figure_points": f"""
        WITH {_POINTS}
        SELECT case_id, 'xy' AS pair, pos, {_POINT_COLUMNS} FROM points""",
    "last_figure_values": f"""
        WITH {_POINTS}
        SELECT case_id, 'xy' AS pair, {_POINT_COLUMNS} FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY case_id, k, kn ORDER BY pos DESC) AS place
            FROM points)
        WHERE place = 1""",
    "map_points": """
        SELECT s_suppkey AS case_id, 0 AS pos, 'num' AS k1_kind, s_suppkey::DOUBLE AS k1_num,
               NULL::VARCHAR AS k1_str, 'num' AS k2_kind, s_nationkey::DOUBLE AS k2_num,
               NULL::VARCHAR AS k2_str, 'num' AS v_kind, s_acctbal AS v_num, NULL::VARCHAR AS v_str
        FROM supplier
        UNION ALL
        SELECT s_suppkey, 1, 'num', s_nationkey, NULL, 'num', s_suppkey, NULL, 'str', NULL, s_name
        FROM supplier""",
    "goldens_through_files": """
        SELECT CAST(o_orderkey AS VARCHAR) AS case_id,
               CASE o_orderkey % 5 WHEN 0 THEN 'type,x,xaxis,y' ELSE 'type,x,xaxis,y,yaxis' END AS keys,
               'bar' AS type, 'x' AS xaxis, CASE o_orderkey % 5 WHEN 4 THEN 'y2' END AS yaxis
        FROM orders WHERE o_orderkey % 5 IN (0, 4)""",
    "suppliers_through_csv": """
        SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, s_name || ', "Île-d''Été"' AS s_name,
               s_nationkey, s_acctbal
        FROM supplier""",
    "cases_default_reader": f"""
        WITH {_CASES} SELECT uuid, dataset, complexity, md5(description) AS description FROM cases""",
    "cases_of_a_split": f"""
        WITH {_CASES} SELECT uuid, complexity, 'test' AS split FROM cases WHERE complexity = 'WithPlotType'""",
    "goldens_default_reader": """
        SELECT CAST(o_orderkey AS VARCHAR) AS case_id,
               concat_ws('|', o_orderstatus, o_orderpriority, o_orderstatus,
                   CASE WHEN o_orderkey % 5 = 4 THEN regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '') END) AS x,
               concat_ws('|', o_custkey * 100, o_orderkey * 100, CAST(round(o_totalprice * 100) AS BIGINT), 700,
                   CASE WHEN o_orderkey % 5 = 4 THEN o_orderpriority END) AS y
        FROM orders WHERE o_orderkey % 5 IN (0, 4)""",
    "flattened_arrays": """
        SELECT o_orderkey AS case_id,
               concat_ws('|', o_orderstatus, o_orderpriority, o_orderstatus, o_orderpriority) AS x,
               concat_ws('|', o_custkey * 100, o_orderkey * 100, CAST(round(o_totalprice * 100) AS BIGINT), 700,
                   o_orderstatus, o_custkey * 100) AS y
        FROM orders""",
    "large_integer_points": """
        WITH o AS (SELECT o_orderkey, CAST(o_orderkey AS HUGEINT) + 9007199254740992 AS big FROM orders)
        SELECT o_orderkey AS case_id, CAST(big AS VARCHAR) AS k, CAST(big AS VARCHAR) AS v FROM o
        UNION ALL SELECT o_orderkey, CAST(big + 1 AS VARCHAR), CAST(big + 1 AS VARCHAR) FROM o""",
    "figures_without_numbers": """
        SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 7 < 4 THEN 'ok' ELSE 'bad_json' END AS status,
               CASE WHEN o_orderkey % 7 < 3 THEN 'num' WHEN o_orderkey % 7 = 3 THEN 'str' END AS kind,
               CASE o_orderkey % 7 WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' WHEN 2 THEN '-Infinity' WHEN 3 THEN 'NaN' END AS value
        FROM orders""",
    "seats_through_csv": """
        SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey,
               (o_custkey % 40) || CASE WHEN o_orderkey % 2 = 0 THEN 'D' ELSE 'f' END AS seat,
               strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y-%m-%d') AS day,
               CAST(CAST(o_orderkey AS HUGEINT) + 9223372036854775807 AS VARCHAR) AS far,
               'string,string,date,decimal(38,0)' AS kinds
        FROM orders""",
    "seat_misfits": """
        WITH s AS (
            SELECT (o_custkey % 40) || CASE WHEN o_orderkey % 2 = 0 THEN 'D' ELSE 'f' END AS seat,
                   strftime(o_orderdate, '%Y-%m') AS month, o_orderkey > 0 AS beyond,
                   CAST(CAST(o_orderkey AS HUGEINT) + 9223372036854775807 AS VARCHAR) AS far FROM orders)
        SELECT 'o_orderkey' AS "column", 0 AS n, NULL AS example
        UNION ALL SELECT 'seat', COUNT(*), MIN(seat) FROM s
        UNION ALL SELECT 'month', COUNT(*), MIN(month) FROM s
        UNION ALL SELECT 'day', 0, NULL
        UNION ALL SELECT 'far', COUNT(*), MIN(far) FROM s WHERE beyond""",
    "csv_with_missing_values": """
        SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey,
               CASE WHEN s_suppkey % 5 > 2 THEN CAST(round(s_acctbal * 100) AS BIGINT) END AS cents, 'int' AS kind
        FROM supplier""",
}
