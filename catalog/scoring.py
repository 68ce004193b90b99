"""Comparison of predicted with golden chart data, verdicts and pass rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import cents_sql, table
from catalog.corpus import _figure, _trace
from chartmeter.functions import round_cents, tag_column, values_match
from chartmeter.plans import (
    failure_report,
    figure_records,
    pairs_match,
    pairs_match_swapped,
    pass_rate,
    records_match,
    score_cases,
    triples_match,
)
from chartmeter.plans.scoring import (
    CHART_TYPES,
    describe,
    extra_fields_match,
    fields_match,
    standard_fields_match,
    type_match,
    with_source,
)


def rounded_prices(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.select("o_orderkey", round_cents(F.col("o_totalprice") / 8).alias("price"))


def price_values_match(spark, sf):
    orders = table(spark, sf, "orders").withColumn(
        "predicted", F.col("o_totalprice") + (F.col("o_orderkey") % 4) * 0.004
    )
    match = values_match(tag_column(orders, "o_totalprice"), tag_column(orders, "predicted"))
    return orders.select("o_orderkey", match.alias("matched"))


def text_values_match(spark, sf):
    kind = F.col("doc_id") % 4
    documents = table(spark, sf, "documents").withColumn(
        "predicted",
        F.when(kind == 0, F.concat(F.lit("> "), F.lower("text"), F.lit(" <")))
        .when(kind == 1, F.expr("substring(text, 2)"))
        .when(kind == 2, F.col("lang"))
        .otherwise(F.col("text")),
    )
    match = values_match(tag_column(documents, "text"), tag_column(documents, "predicted"))
    back = values_match(tag_column(documents, "predicted"), tag_column(documents, "text"))
    return documents.select("doc_id", match.alias("matched"), back.alias("matched_back"))


def _points(df, case, pos, k, v, pair="xy"):
    named = df.select(
        F.col(case).alias("case_id"), F.col(pos).alias("pos"), F.col(k).alias("k"), F.col(v).alias("v")
    )
    return named.select(
        "case_id",
        F.lit(pair).alias("pair"),
        "pos",
        tag_column(named, "k").alias("k"),
        tag_column(named, "v").alias("v"),
    )


def _order_points(spark, sf):
    """Golden points of each customer, and six ways of getting them nearly right."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    how, key, price = F.col("o_custkey") % 6, F.col("o_orderkey"), F.col("o_totalprice")
    altered = orders.where(~((how == 1) & (key % 5 == 0))).select(
        "o_custkey",
        "o_orderkey",
        (key + F.when(how == 4, 0.004).otherwise(0.0)).alias("k"),
        (
            price
            + F.when(how == 2, 0.001).when((how == 3) & (key % 7 == 0), 1.0).otherwise(0.0)
        ).alias("v"),
    )
    extra = orders.where(how == 5).select("o_custkey", "o_orderkey", (-key).cast("double").alias("k"), price.alias("v"))
    golden = _points(orders, "o_custkey", "o_orderkey", "o_orderkey", "o_totalprice")
    return golden, _points(altered.unionByName(extra), "o_custkey", "o_orderkey", "k", "v")


def customer_pairs_match(spark, sf):
    matches = pairs_match(*_order_points(spark, sf))
    return matches.select("case_id", "n_golden", "bad_keys", "matched")


def customer_pairs_match_swapped(spark, sf):
    """Predicted points with their axes exchanged, except for every ninth customer."""
    golden, predicted = _order_points(spark, sf)
    turned = F.col("case_id") % 9 != 0
    exchanged = predicted.select(
        "case_id",
        "pair",
        "pos",
        F.when(turned, F.col("v")).otherwise(F.col("k")).alias("k"),
        F.when(turned, F.col("k")).otherwise(F.col("v")).alias("v"),
    )
    return pairs_match_swapped(golden, exchanged).select("case_id", "matched")


def segment_names_match(spark, sf):
    """A few large cases of string pairs that match by containment only."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    lost = (F.col("c_mktsegment") == "MACHINERY") & (F.col("c_custkey") % 7 == 0)
    predicted = customers.select(
        "c_custkey",
        "c_mktsegment",
        F.concat(F.lit("the "), F.lower("c_name"), F.when(lost, "").otherwise("!")).alias("k"),
        F.when(lost, "none").otherwise(F.concat(F.lit("in "), "c_mktsegment")).alias("v"),
    )
    golden = customers.withColumn("v", F.col("c_mktsegment"))
    return pairs_match(
        _points(golden, "c_mktsegment", "c_custkey", "c_name", "v"),
        _points(predicted, "c_mktsegment", "c_custkey", "k", "v"),
    ).select("case_id", "n_golden", "matched")


def document_pairs_match(spark, sf):
    """One case per language: text keys, and whole documents as values."""
    documents = table(spark, sf, "documents").select("doc_id", "lang", "text")
    named = documents.withColumn("k", F.concat(F.lit("item "), "doc_id"))
    cut = (F.col("lang") == "de") & (F.col("doc_id") % 3 == 0)
    longer = named.select(
        "doc_id",
        "lang",
        F.concat(F.lit("The "), "k", F.lit(".")).alias("k"),
        F.when(cut, F.expr("substring(text, 2)")).otherwise(F.concat(F.lit("> "), F.lower("text"))).alias("text"),
    )
    return pairs_match(
        _points(named, "lang", "doc_id", "k", "text"), _points(longer, "lang", "doc_id", "k", "text")
    ).select("case_id", "n_golden", "matched")


def source_texts_match(spark, sf):
    """Whole texts of each source, looked for in longer ones."""
    documents = table(spark, sf, "documents").select("doc_id", "source", "text")
    longer = documents.withColumn(
        "text",
        F.when(F.col("doc_id") % 97 == 0, F.expr("substring(text, 2)")).otherwise(
            F.concat(F.lit("> "), F.lower("text"), F.lit(" <"))
        ),
    )
    return pairs_match(
        _points(documents, "source", "doc_id", "doc_id", "text"),
        _points(longer, "source", "doc_id", "doc_id", "text"),
    ).select("case_id", "n_golden", "matched")


def conversation_turns_match(spark, sf):
    """The last text of each role in a conversation; roles repeat as keys."""
    turns = table(spark, sf, "conversations")
    said = turns.select(
        "conv_id",
        "turn",
        F.concat(F.lit("the "), "role").alias("role"),
        F.when(F.col("conv_id") % 3 == 0, F.expr("substring(text, 2)"))
        .otherwise(F.concat(F.lower("text"), F.lit(" (end)")))
        .alias("text"),
    )
    return pairs_match(
        _points(turns, "conv_id", "turn", "role", "text"), _points(said, "conv_id", "turn", "role", "text")
    ).select("case_id", "n_golden", "matched")


def customer_records_match(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    how, key = F.col("o_custkey") % 4, F.col("o_orderkey")
    altered = orders.where(~((how == 1) & (key % 5 == 0))).select(
        "o_custkey",
        "o_orderkey",
        F.when((how == 2) & (key % 7 == 0), "none")
        .otherwise(F.concat(F.lower("o_orderpriority"), F.lit("!")))
        .alias("o_orderpriority"),
    )
    extra = orders.where(how == 3).where(key % 6 == 0).withColumn("o_orderkey", -key)

    def keyed(df):
        points = _points(df, "o_custkey", "o_orderkey", "o_orderkey", "o_orderpriority")
        return points.select("case_id", "k", "v")

    return records_match(keyed(orders), keyed(altered.unionByName(extra))).select("case_id", "matched")


def supplier_triples_match(spark, sf):
    """Lines of a supplier by order and line number; the last of several counts."""
    lines = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"
    )
    how = F.col("l_suppkey") % 4
    odd = F.col("l_orderkey") % 50 == 0
    altered = lines.where(~((how == 1) & odd)).withColumn(
        "l_extendedprice",
        F.col("l_extendedprice") + F.when(how == 2, 0.001).when((how == 3) & odd, 1.0).otherwise(0.0),
    )

    def triples(df):
        return df.select(
            F.col("l_suppkey").alias("case_id"),
            F.struct("l_partkey", "l_extendedprice").alias("pos"),
            tag_column(df, "l_orderkey").alias("k1"),
            tag_column(df, "l_linenumber").alias("k2"),
            tag_column(df, "l_extendedprice").alias("v"),
        )

    return triples_match(triples(lines), triples(altered)).select("case_id", "matched")


def _array(*values):
    """An array of any types, as VARIANT."""
    return F.array(*[value.cast("variant") for value in values])


def _sides(orders, golden, predicted):
    """Orders with what their golden (g) and predicted (p) figures hold."""
    sides = orders.select("o_orderkey", golden.alias("golden"), predicted.alias("predicted"))
    for name, side in (("golden", "g"), ("predicted", "p")):
        sides = describe(figure_records(sides, name).drop("status"), side)
    return with_source(sides)


def presence_outcomes(spark, sf):
    """Which arrays are there decides a pair before its data does."""
    key = F.col("o_orderkey")

    def figure(has_x, has_y):
        x = F.when(F.floor(key / has_x) % 2 == 0, _array(key))
        y = F.when(F.floor(key / has_y) % 2 == 0, _array(F.col("o_totalprice")))
        return _figure(_trace(type="bar", xaxis="x", yaxis="y", x=x, y=y))

    sides = _sides(table(spark, sf, "orders"), figure(1, 2), figure(4, 8))
    outcomes = {
        "xy": fields_match("xy", F.lit("F"), F.lit("F")),
        "latlon": fields_match("latlon", F.lit("F")),
        "labelsvalues": fields_match("labelsvalues", F.lit("F")),
    }
    return sides.select(
        "o_orderkey",
        *[outcome.alias(name) for name, outcome in outcomes.items()],
        standard_fields_match(list(outcomes.values())).alias("standard"),
    )


def type_and_extra_outcomes(spark, sf):
    """Pies and bars with a changed or missing type, axis or domain."""
    key = F.col("o_orderkey")
    how, pie = key % 6, key % 6 >= 4

    def figure(kind, xaxis, yaxis, low):
        ends = F.struct(F.array(low, F.lit(1.0)).alias("x"), F.array(F.lit(0.0), F.lit(1.0)).alias("y"))
        trace = F.struct(
            kind.alias("type"),
            xaxis.alias("xaxis"),
            yaxis.alias("yaxis"),
            F.when(pie, ends).alias("domain"),
            F.array(key).alias("labels"),
        )
        return _figure(trace)

    kind = F.when(pie, "pie").otherwise("bar")
    axis = F.when(~pie, "x"), F.when(~pie, "y")
    golden = figure(kind, *axis, F.lit(0.0))
    predicted = figure(
        F.when(how == 1, "box").when(how != 3, kind),
        F.when(how != 2, axis[0]),
        F.when(how == 3, "y2").otherwise(axis[1]),
        F.when(how == 5, 0.5).otherwise(0.0),
    )
    sides = _sides(table(spark, sf, "orders"), golden, predicted)
    return sides.select("o_orderkey", type_match().alias("type"), extra_fields_match().alias("extra"))


def _scoring_inputs(spark, sf):
    """A case per order, answered in eight ways; every eleventh has no golden record."""
    orders = table(spark, sf, "orders")
    key, how = F.col("o_orderkey"), F.col("o_orderkey") % 8
    names = [F.col("o_orderstatus"), F.col("o_orderpriority"), F.lit("total")]
    values = [F.col("o_custkey"), key, F.col("o_totalprice")]
    x, y = _array(*names), _array(*values)
    golden = _figure(_trace(type="bar", x=x, y=y, xaxis="x", yaxis="y"))

    wrapped = _array(*[F.concat(F.lit("<"), F.lower(name), F.lit(">")) for name in names])
    off_by = F.when(how == 2, 0.001).when(how == 3, 1.0).otherwise(0.0)
    moved = _array(*[value + off_by for value in values])
    predicted = F.when(how == 6, F.concat(F.lit("figure of "), key)).otherwise(
        _figure(
            _trace(
                type=F.when(how == 1, "scatter").otherwise("bar"),
                name="a",
                x=F.when(how == 0, wrapped).when(how == 4, y).otherwise(x),
                y=F.when(how == 4, wrapped).otherwise(moved),
                xaxis=F.when(how != 5, "x"),
                yaxis="y",
            )
        )
    )
    level = F.when(F.col("o_custkey") % 4 == 0, "WithoutPlotType").otherwise("WithPlotType")
    uuid = key.cast("string").alias("uuid")
    cases = orders.select(uuid, level.alias("complexity"), "o_orderpriority")
    goldens = figure_records(
        orders.where(key % 11 != 0).select(uuid, golden.alias("figure_json")), "figure_json"
    ).select("uuid", "record")
    predictions = orders.where(how != 7).select(uuid, predicted.alias("figure_json"))
    return cases, goldens, predictions


def scored_orders(spark, sf):
    return score_cases(*_scoring_inputs(spark, sf)).select(
        "uuid", "complexity", "pass", "reason", "vacuous"
    )


def pass_rate_by_complexity(spark, sf):
    return pass_rate(score_cases(*_scoring_inputs(spark, sf)), ["complexity"])


def pass_rate_by_priority(spark, sf):
    return pass_rate(score_cases(*_scoring_inputs(spark, sf)), ["o_orderpriority"], totals=True)


def failed_orders(spark, sf):
    cases, goldens, predictions = _scoring_inputs(spark, sf)
    report = failure_report(score_cases(cases, goldens, predictions), goldens, predictions)
    return report.select(
        "uuid",
        "reason",
        F.when(F.col("reason") == "bad_json", F.col("predicted")).alias("predicted"),
        F.col("golden").isNotNull().alias("has_golden"),
    )


def failure_records(spark, sf):
    """Whole arrays of the golden record and of the normalised predicted one."""
    cases, goldens, predictions = _scoring_inputs(spark, sf)
    report = failure_report(score_cases(cases, goldens, predictions), goldens, predictions)

    def part(side, key):
        values = F.try_variant_get(F.try_parse_json(side), f"$.{key}", "array<variant>")

        def shown(v):
            cents = F.round(F.try_variant_get(v, "$", "double") * 100).cast("bigint").cast("string")
            return F.coalesce(F.when(F.schema_of_variant(v) != "STRING", cents), F.try_variant_get(v, "$", "string"))

        return F.array_join(F.transform(values, shown), "|").alias(f"{side}_{key}")

    return report.select("uuid", "reason", *(part(s, k) for s in ("golden", "predicted") for k in ("x", "y")))


def scores_per_run(spark, sf):
    """Two runs over all cases; the second one answers every third case wrongly."""
    cases, goldens, predictions = _scoring_inputs(spark, sf)
    key = F.col("uuid").cast("bigint")
    wrong = _figure(_trace(type="bar", x=_array(key), y=_array(key), xaxis="x", yaxis="y"))
    first = predictions.withColumn("run_id", F.lit(1))
    second = first.withColumn("figure_json", F.when(key % 3 == 0, wrong).otherwise(F.col("figure_json")))
    both = first.unionByName(second.withColumn("run_id", F.lit(2)))
    scored = score_cases(cases, goldens, both)
    return pass_rate(scored, ["run_id"])


def domain_outcomes(spark, sf):
    """A domain is compared whole: further keys, texts for numbers and nulls make it another."""
    key, how = F.col("o_orderkey"), F.col("o_orderkey") % 6
    head = F.concat(F.lit('{"data": [{"type": "pie", "labels": ["a"], "domain": '), F.lit('{"x": [0, 1.0], "name": '), key)
    golden = F.concat(head, F.lit("}}]}"))
    predicted = (
        F.when(how == 1, F.concat(head, F.lit(', "row": null}}]}')))
        .when(how == 2, F.concat(head, F.lit(', "more": 1}}]}')))
        .when(how == 3, F.replace(golden, F.lit("[0, 1.0]"), F.lit('["0", "1"]')))
        .when(how == 4, F.concat(F.lit('{"data": [{"type": "pie", "domain": {"name": '), key, F.lit('.0, "x": [0.0, true]}}]}')))
        .otherwise(golden)
    )
    sides = _sides(table(spark, sf, "orders"), golden, predicted)
    return sides.select("o_orderkey", extra_fields_match().alias("extra"))


def _typed_inputs(spark, sf):
    """A case per order over all chart types, answered in seven ways; arrays are the type's own."""
    orders = table(spark, sf, "orders")
    key, how = F.col("o_orderkey"), F.col("o_orderkey") % 7
    types = F.array(*map(F.lit, CHART_TYPES))
    at = (F.floor(key / 7) % len(CHART_TYPES)).cast("int")
    kind = F.get(types, at)
    source = F.get(F.array(*[F.lit(pair) for pair, _ in CHART_TYPES.values()]), at)
    dense = kind == "densitymapbox"
    k, v = _array(key, key + 1), _array(F.col("o_totalprice"), F.col("o_custkey"))
    low = _array(key, key + 2)
    vague = how == 6  # golden holds none of its arrays

    def figure(kind, first, second, third, axes, arrays):
        def of(pair, values):
            return F.when(arrays & (source == pair), values)

        return _figure(
            _trace(
                type=kind,
                x=of("xy", first), y=of("xy", second), lat=of("latlon", first), lon=of("latlon", second),
                z=F.when(dense & arrays, third), labels=of("labelsvalues", first), values=of("labelsvalues", second),
                xaxis=F.when(source == "xy", axes), yaxis=F.when(source == "xy", F.lit("y")),
                xbingroup=F.when(kind == "histogram2d", F.lit("g")), ybingroup=F.when(kind == "histogram2d", F.lit("h")),
                subplot=F.when(dense, F.lit("m")),
                domain=F.when(kind == "pie", F.struct(F.lit(1).alias("row"))),
            )
        )

    golden = figure(kind, k, v, _array(F.col("o_custkey"), key), F.lit("x"), ~vague)
    turned = how == 2
    predicted = figure(
        F.when(how == 3, "other").otherwise(kind),
        F.when(turned, v).when(how == 1, low).otherwise(k),
        F.when(turned, k).otherwise(v),
        _array(F.col("o_custkey") + F.when(how == 5, 1).otherwise(0), key),
        F.when(how == 4, "x9").otherwise("x"),
        ~vague,
    )
    uuid = key.cast("string").alias("uuid")
    level = F.when(F.col("o_custkey") % 3 == 0, "WithoutPlotType").otherwise("WithPlotType").alias("complexity")
    goldens = figure_records(orders.select(uuid, golden.alias("figure_json")), "figure_json").select("uuid", "record")
    return orders.select(uuid, level), goldens, orders.select(uuid, predicted.alias("figure_json"))


def scored_chart_types(spark, sf):
    return score_cases(*_typed_inputs(spark, sf)).select("uuid", "pass", "reason", "vacuous")


def strict_scores(spark, sf):
    return score_cases(*_typed_inputs(spark, sf), strict=True).select("uuid", "pass", "reason", "vacuous")


QUERIES = {
    f.__name__: f
    for f in (
        rounded_prices,
        price_values_match,
        text_values_match,
        customer_pairs_match,
        customer_pairs_match_swapped,
        segment_names_match,
        document_pairs_match,
        source_texts_match,
        conversation_turns_match,
        customer_records_match,
        supplier_triples_match,
        presence_outcomes,
        type_and_extra_outcomes,
        scored_orders,
        pass_rate_by_complexity,
        pass_rate_by_priority,
        failed_orders,
        failure_records,
        scores_per_run,
        domain_outcomes,
        scored_chart_types,
        strict_scores,
    )
}


def _pairs_sql(golden: str, predicted: str, matched: str, shown: str = "n_golden, matched") -> str:
    """SQL that tries all predicted points of a case on each golden one."""
    return f"""
        WITH g AS ({golden}), p AS ({predicted}),
        met AS (
            SELECT g.case_id, g.k, bool_or(COALESCE({matched}, FALSE)) AS ok
            FROM g LEFT JOIN p ON g.case_id = p.case_id GROUP BY 1, 2),
        verdicts AS (
            SELECT case_id, COUNT(*) AS n_golden, FALSE AS bad_keys, bool_and(ok) AS matched
            FROM met GROUP BY 1)
        SELECT case_id, {shown} FROM verdicts"""


_GOLDEN_ORDERS = "SELECT o_custkey AS case_id, CAST(o_orderkey AS DOUBLE) AS k, o_totalprice AS v FROM orders"
_PREDICTED_ORDERS = """
    SELECT o_custkey AS case_id,
           o_orderkey + CASE WHEN o_custkey % 6 = 4 THEN 0.004::DOUBLE ELSE 0 END AS k,
           o_totalprice + CASE WHEN o_custkey % 6 = 2 THEN 0.001::DOUBLE
               WHEN o_custkey % 6 = 3 AND o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS v
    FROM orders WHERE NOT (o_custkey % 6 = 1 AND o_orderkey % 5 = 0)
    UNION ALL
    SELECT o_custkey, CAST(-o_orderkey AS DOUBLE), o_totalprice FROM orders WHERE o_custkey % 6 = 5"""
_NUMBERS = f"{cents_sql('g.k')} = {cents_sql('p.k')} AND {cents_sql('g.v')} = {cents_sql('p.v')}"
_TURNED = f"""
    SELECT case_id, CASE WHEN case_id % 9 <> 0 THEN v ELSE k END AS k,
           CASE WHEN case_id % 9 <> 0 THEN k ELSE v END AS v FROM ({_PREDICTED_ORDERS})"""


def _holds(outer: str, inner: str) -> str:
    return f"contains(lower({outer}), lower({inner}))"


def _last(keys: str, order: str, source: str) -> str:
    return f"""
        SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY {order}) AS place
                       FROM {source}) WHERE place = 1"""


_ALTERED_LINES = """
    SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey,
           l_extendedprice + CASE WHEN l_suppkey % 4 = 2 THEN 0.001::DOUBLE
               WHEN l_suppkey % 4 = 3 AND l_orderkey % 50 = 0 THEN 1 ELSE 0 END AS l_extendedprice
    FROM lineitem WHERE NOT (l_suppkey % 4 = 1 AND l_orderkey % 50 = 0)"""
_LINE_KEY = "l_suppkey, l_orderkey, l_linenumber"
_LAST_LINE = "l_partkey DESC, l_extendedprice DESC"

_REASON = """
    CASE WHEN o_orderkey % 11 = 0 THEN 'missing_golden'
         WHEN o_orderkey % 8 = 7 THEN 'missing_prediction'
         WHEN o_orderkey % 8 = 6 THEN 'bad_json'
         WHEN o_orderkey % 8 = 1 AND o_custkey % 4 <> 0 THEN 'type_mismatch'
         WHEN o_orderkey % 8 = 3 THEN 'data_mismatch'
         WHEN o_orderkey % 8 = 5 AND o_custkey % 4 <> 0 THEN 'extra_mismatch' END"""
_SCORED = f"""
    scored AS (
        SELECT CAST(o_orderkey AS VARCHAR) AS uuid, o_orderpriority, {_REASON} AS reason,
               CASE WHEN o_custkey % 4 = 0 THEN 'WithoutPlotType' ELSE 'WithPlotType' END AS complexity
        FROM orders)"""
_RATE = f"""
    COUNT(reason) AS errors, COUNT(*) AS total,
    {cents_sql("CAST(COUNT(*) - COUNT(reason) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 100.0::DOUBLE")}
        AS pass_rate"""

_FAILED = f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS uuid, {_REASON} AS reason, * FROM orders"""

# What the kinds of answer come to, for a case of each chart type; ``m`` marks a map whose
# golden type is asked for, ``w`` a case that asks for the type.
_TYPED = """
    typed AS (
        SELECT o_orderkey, o_orderkey % 7 AS how, o_custkey % 3 <> 0 AS w,
            (['scatter', 'bar', 'histogram', 'box', 'histogram2d', 'histogram2dcontour', 'scattergl',
              'scattergeo', 'pie', 'densitymapbox'])[1 + o_orderkey // 7 % 10] AS kind
        FROM orders),
    placed AS (SELECT *, kind NOT IN ('scattergeo', 'pie', 'densitymapbox') AS xy, kind = 'densitymapbox' AND w AS m FROM typed),
    -- Without x and y on either side the xy test holds for every other type, so only a map
    -- that is compared as one, or an xy chart, can fail on its data.
    judged AS (
        SELECT *, CASE
            WHEN w AND how = 3 THEN 'type_mismatch'
            WHEN m AND how = 6 THEN 'error'
            WHEN m AND how IN (1, 2, 5) THEN 'data_mismatch'
            WHEN xy AND how = 1 THEN 'data_mismatch'
            WHEN w AND xy AND how = 4 THEN 'extra_mismatch' END AS reason,
            CASE WHEN m THEN FALSE WHEN how = 6 THEN TRUE WHEN xy THEN FALSE ELSE how IN (1, 2) END AS unproven
        FROM placed)"""

ORACLES = {
    "rounded_prices": f"""
        SELECT o_orderkey, {cents_sql("o_totalprice / 8.0::DOUBLE")} AS price FROM orders""",
    "price_values_match": f"""
        SELECT o_orderkey, {cents_sql("o_totalprice")}
               = {cents_sql("o_totalprice + (o_orderkey % 4) * 0.004::DOUBLE")} AS matched
        FROM orders""",
    "text_values_match": f"""
        WITH d AS (
            SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN '> ' || lower(text) || ' <'
                   WHEN 1 THEN substring(text, 2) WHEN 2 THEN lang ELSE text END AS predicted
            FROM documents)
        SELECT doc_id, {_holds("predicted", "text")} AS matched,
               {_holds("text", "predicted")} AS matched_back FROM d""",
    "customer_pairs_match": _pairs_sql(
        _GOLDEN_ORDERS, _PREDICTED_ORDERS, _NUMBERS, "n_golden, bad_keys, matched"
    ),
    "customer_pairs_match_swapped": _pairs_sql(
        _GOLDEN_ORDERS,
        _TURNED,
        f"{cents_sql('g.k')} = {cents_sql('p.v')} AND {cents_sql('g.v')} = {cents_sql('p.k')}",
        "matched",
    ),
    "segment_names_match": _pairs_sql(
        "SELECT c_mktsegment AS case_id, c_name AS k, c_mktsegment AS v FROM customer",
        """SELECT c_mktsegment AS case_id,
                  'the ' || lower(c_name) || CASE WHEN lost THEN '' ELSE '!' END AS k,
                  CASE WHEN lost THEN 'none' ELSE 'in ' || c_mktsegment END AS v
           FROM (SELECT *, c_mktsegment = 'MACHINERY' AND c_custkey % 7 = 0 AS lost FROM customer)""",
        f"{_holds('p.k', 'g.k')} AND {_holds('p.v', 'g.v')}",
    ),
    "document_pairs_match": _pairs_sql(
        "SELECT lang AS case_id, 'item ' || doc_id AS k, text AS v FROM documents",
        """SELECT lang AS case_id, 'The item ' || doc_id || '.' AS k,
                  CASE WHEN lang = 'de' AND doc_id % 3 = 0 THEN substring(text, 2) ELSE '> ' || lower(text) END AS v
           FROM documents""",
        f"{_holds('p.k', 'g.k')} AND {_holds('p.v', 'g.v')}",
    ),
    "source_texts_match": _pairs_sql(
        "SELECT source AS case_id, doc_id AS k, text AS v FROM documents",
        """SELECT source AS case_id, doc_id AS k, CASE WHEN doc_id % 97 = 0 THEN substring(text, 2)
                  ELSE '> ' || lower(text) || ' <' END AS v FROM documents""",
        f"g.k = p.k AND {_holds('p.v', 'g.v')}",
    ),
    "conversation_turns_match": _pairs_sql(
        "SELECT conv_id AS case_id, role AS k, text AS v FROM ("
        + _last("conv_id, role", "turn DESC", "conversations")
        + ")",
        "SELECT conv_id AS case_id, 'the ' || role AS k, CASE WHEN conv_id % 3 = 0"
        " THEN substring(text, 2) ELSE lower(text) || ' (end)' END AS v FROM ("
        + _last("conv_id, role", "turn DESC", "conversations")
        + ")",
        f"{_holds('p.k', 'g.k')} AND {_holds('p.v', 'g.v')}",
    ),
    "customer_records_match": f"""
        WITH p AS (
            SELECT o_custkey, o_orderkey, CASE WHEN o_custkey % 4 = 2 AND o_orderkey % 7 = 0
                   THEN 'none' ELSE lower(o_orderpriority) || '!' END AS v
            FROM orders WHERE NOT (o_custkey % 4 = 1 AND o_orderkey % 5 = 0)
            UNION ALL
            SELECT o_custkey, -o_orderkey, o_orderpriority
            FROM orders WHERE o_custkey % 4 = 3 AND o_orderkey % 6 = 0 AND o_orderkey <> 0)
        SELECT COALESCE(g.o_custkey, p.o_custkey) AS case_id,
               bool_and(COALESCE({_holds("p.v", "g.o_orderpriority")}, FALSE)) AS matched
        FROM orders g FULL JOIN p ON g.o_custkey = p.o_custkey AND g.o_orderkey = p.o_orderkey
        GROUP BY 1""",
    "supplier_triples_match": f"""
        WITH g AS ({_last(_LINE_KEY, _LAST_LINE, "lineitem")}),
        p AS ({_last(_LINE_KEY, _LAST_LINE, f"({_ALTERED_LINES})")})
        SELECT COALESCE(g.l_suppkey, p.l_suppkey) AS case_id,
               bool_and(COALESCE({cents_sql("g.l_extendedprice")} = {cents_sql("p.l_extendedprice")},
                                 FALSE)) AS matched
        FROM g FULL JOIN p ON g.l_suppkey = p.l_suppkey AND g.l_orderkey = p.l_orderkey
            AND g.l_linenumber = p.l_linenumber
        GROUP BY 1""",
    "presence_outcomes": """
        WITH s AS (
            SELECT o_orderkey, o_orderkey % 2 = 0 AS gx, o_orderkey // 2 % 2 = 0 AS gy,
                   o_orderkey // 4 % 2 = 0 AS px, o_orderkey // 8 % 2 = 0 AS py FROM orders),
        d AS (
            SELECT *, CASE WHEN NOT gx AND px THEN 'F' WHEN NOT gy AND py THEN 'F'
                WHEN NOT gx OR NOT gy THEN 'V' WHEN px AND py THEN 'F' ELSE 'E' END AS direct,
                CASE WHEN NOT gx AND py THEN 'F' WHEN NOT gy AND px THEN 'F'
                WHEN NOT gx OR NOT gy THEN 'V' WHEN px AND py THEN 'F' ELSE 'E' END AS swapped FROM s),
        o AS (SELECT *, CASE WHEN direct = 'F' THEN swapped ELSE direct END AS xy FROM d)
        SELECT o_orderkey, xy, 'F' AS latlon, 'F' AS labelsvalues, xy AS standard FROM o""",
    "type_and_extra_outcomes": """
        SELECT o_orderkey,
               CASE o_orderkey % 6 WHEN 1 THEN 'F' WHEN 3 THEN 'E' ELSE 'T' END AS type,
               CASE WHEN o_orderkey % 6 IN (0, 4) THEN 'T' ELSE 'F' END AS extra FROM orders""",
    "scored_orders": f"""
        WITH {_SCORED}
        SELECT uuid, complexity, reason IS NULL AS pass, reason, FALSE AS vacuous FROM scored""",
    "pass_rate_by_complexity": f"""
        WITH {_SCORED} SELECT complexity, {_RATE} FROM scored GROUP BY 1""",
    "pass_rate_by_priority": f"""
        WITH {_SCORED} SELECT o_orderpriority, {_RATE} FROM scored GROUP BY ROLLUP (o_orderpriority)""",
    "failed_orders": f"""
        WITH {_SCORED}
        SELECT uuid, reason, CASE WHEN reason = 'bad_json' THEN 'figure of ' || uuid END AS predicted,
               reason <> 'missing_golden' AS has_golden
        FROM scored WHERE reason IS NOT NULL""",
    "failure_records": f"""
        WITH f AS ({_FAILED}),
        r AS (
            SELECT uuid, reason, o_orderkey % 8 AS how, o_orderkey % 11 = 0 AS none,
                concat_ws('|', o_orderstatus, o_orderpriority, 'total') AS names,
                concat_ws('|', o_custkey * 100, o_orderkey * 100, CAST(round(o_totalprice * 100) AS BIGINT)) AS nums,
                concat_ws('|', o_custkey * 100 + 100, o_orderkey * 100 + 100,
                    CAST(round((o_totalprice + 1) * 100) AS BIGINT)) AS moved,
                concat_ws('|', '<' || lower(o_orderstatus) || '>', '<' || lower(o_orderpriority) || '>', '<total>') AS wrapped
            FROM f WHERE reason IS NOT NULL)
        SELECT uuid, reason, CASE WHEN NOT none THEN names END AS golden_x, CASE WHEN NOT none THEN nums END AS golden_y,
            CASE WHEN how = 0 THEN wrapped WHEN how = 4 THEN nums WHEN how < 6 THEN names END AS predicted_x,
            CASE WHEN how = 4 THEN wrapped WHEN how = 3 THEN moved WHEN how < 6 THEN nums END AS predicted_y
        FROM r""",
    "scores_per_run": f"""
        WITH runs AS (
            SELECT run_id, {_REASON} AS old, o_orderkey, o_orderkey % 11 = 0 AS none FROM orders, (VALUES (1), (2)) AS t(run_id)),
        scored AS (
            SELECT run_id, CASE WHEN old IN ('missing_golden', 'missing_prediction') THEN old
                WHEN run_id = 2 AND o_orderkey % 3 = 0 THEN 'wrong' ELSE old END AS reason FROM runs)
        SELECT run_id, {_RATE} FROM scored GROUP BY 1""",
    "domain_outcomes": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (1, 2, 3) THEN 'F' ELSE 'T' END AS extra FROM orders""",
    "scored_chart_types": f"""
        WITH {_TYPED}
        SELECT CAST(o_orderkey AS VARCHAR) AS uuid, reason IS NULL AS pass, reason,
               reason IS NULL AND unproven AS vacuous FROM judged""",
    "strict_scores": f"""
        WITH {_TYPED},
        strict AS (SELECT *, CASE WHEN reason IS NULL AND unproven THEN 'not_compared' ELSE reason END AS why FROM judged)
        SELECT CAST(o_orderkey AS VARCHAR) AS uuid, why IS NULL AS pass, why AS reason,
               reason IS NULL AND unproven AS vacuous FROM strict""",
}
