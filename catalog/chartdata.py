"""Chart-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import avg_sql, money, money_sql, rounded, table, to_double
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
from chartmeter.operators.rows import after_year, before_year, between, in_year, one_of


def count_by_priority(spark, sf):
    return count_by(table(spark, sf, "orders"), "o_orderpriority")


def count_by_flag_and_status(spark, sf):
    return count_by(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


def avg_price_by_type(spark, sf):
    return agg_by(table(spark, sf, "part"), "p_type", money("p_retailprice"), "avg", "avg_price")


def quantity_by_flag(spark, sf):
    df = agg_by(table(spark, sf, "lineitem"), "l_returnflag", money("l_quantity"), "sum", "sum_qty")
    return to_double(df, "sum_qty")


def quality_rate_by_lang(spark, sf):
    labelled = table(spark, sf, "labels").join(
        table(spark, sf, "documents").select("doc_id", "lang"), "doc_id"
    )
    return rate_by(labelled, "lang", F.col("quality") == 1)


def high_values_by_event_type(spark, sf):
    return count_where(table(spark, sf, "events"), "event_type", F.col("value") > 100)


def top_brands_by_count(spark, sf):
    return topk_groups(table(spark, sf, "part"), "p_brand", 5)


def top_customers_by_spend(spark, sf):
    orders = table(spark, sf, "orders")
    top = topk_groups(orders, "o_custkey", 10, "sum", money("o_totalprice"), name="spend")
    return to_double(top, "spend")


def top_orders_by_price(spark, sf):
    orders = table(spark, sf, "orders")
    return topk_rows(orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 10, "o_orderkey")


def lowest_balances(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return topk_rows(customers, "c_acctbal", 8, "c_custkey", asc=True)


def _lines_with_brand(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice")
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))


def quantity_of_top_brands(spark, sf):
    show = {"sum_qty": ("sum", money("l_quantity"))}
    top = topk_show(_lines_with_brand(spark, sf), "p_brand", money("l_extendedprice"), 8, show)
    return to_double(top, "sum_qty")


def lines_of_top_parts(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_partkey", "l_orderkey", "l_quantity", "l_extendedprice"
    )
    return topk_filter(lines, "l_partkey", money("l_extendedprice"), 5).drop("l_extendedprice")


def best_part_of_top_types(spark, sf):
    parts = table(spark, sf, "part")
    return argmax_per_group(parts, "p_type", "p_retailprice", "p_partkey", "p_name", top_groups=3)


def best_order_per_customer(spark, sf):
    return argmax_per_group(table(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderkey")


def share_of_flags(spark, sf):
    return share(table(spark, sf, "lineitem"), "l_returnflag")


def quantity_share_of_suppliers(spark, sf):
    df = share(table(spark, sf, "lineitem"), "l_suppkey", money("l_quantity"))
    return to_double(df, "amount")


def price_histogram(spark, sf):
    return rounded(histogram(table(spark, sf, "orders"), "o_totalprice", 20), "bin_lo", "bin_hi")


def price_histogram_by_status(spark, sf):
    df = histogram(table(spark, sf, "orders"), "o_totalprice", 20, by="o_orderstatus")
    return rounded(df, "bin_lo", "bin_hi")


def value_histogram_in_bounds(spark, sf):
    events = table(spark, sf, "events")
    return histogram(events, "value", 16, by="event_type", bounds=(0.0, 64.0))


def price_histogram_of_all_customers(spark, sf):
    """Bounds that leave out all orders of many customers."""
    return histogram(table(spark, sf, "orders"), "o_totalprice", 4, by="o_custkey", bounds=(1000.0, 9000.0))


def best_part_of_top_types_by_price(spark, sf):
    parts = table(spark, sf, "part")
    return argmax_per_group(
        parts, "p_type", "p_size", "p_partkey", top_groups=5, groups_by="max", group_measure="p_retailprice"
    )


def lines_by_discount_band(spark, sf):
    """Bands of a fractional width; every discount lies on an edge."""
    band = number_bands(F.col("l_discount"), 0.02).alias("band")
    return table(spark, sf, "lineitem").groupBy(band).agg(F.count(F.lit(1)).alias("n"))


def price_density(spark, sf):
    df = density_1d(table(spark, sf, "orders"), "o_totalprice", 12)
    return df.select("bin", F.round(F.col("density") * 1e6, 6).alias("density"))


def price_density_by_status(spark, sf):
    df = density_1d(table(spark, sf, "orders"), "o_totalprice", 12, by="o_orderstatus")
    return df.select("o_orderstatus", "bin", F.round(F.col("density") * 1e6, 6).alias("density"))


_BOX = ["min", "q1", "median", "q3", "max", "fence_lo", "fence_hi", "whisker_lo", "whisker_hi"]


def price_box_by_flag(spark, sf):
    return rounded(box_stats(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag"), *_BOX)


def price_box(spark, sf):
    return rounded(box_stats(table(spark, sf, "lineitem"), "l_extendedprice"), *_BOX)


def value_box_by_event_type(spark, sf):
    return rounded(box_stats(table(spark, sf, "events"), "value", "event_type"), *_BOX)


def size_price_grid(spark, sf):
    return grid_2d(table(spark, sf, "part"), "p_size", "p_retailprice", 10, 8)


def price_hexbins(spark, sf):
    """Line items in hexagons of price and quantity, with their mean discount."""
    lines = table(spark, sf, "lineitem")
    df = hex_bins(lines, "l_extendedprice", "l_quantity", 12, fn="avg", measure=money("l_discount"))
    return rounded(df, "x", "y", "value")


def price_kernel_density(spark, sf):
    df = kernel_density(table(spark, sf, "orders"), "o_totalprice", 100, by="o_orderstatus")
    return df.select("o_orderstatus", "point", F.round("x", 4).alias("x"), F.round(F.col("density") * 1e6, 7).alias("density"))


def size_kernel_density(spark, sf):
    """At the sizes themselves, where nothing is lost by binning."""
    df = kernel_density(table(spark, sf, "part"), "p_size", 50, by="p_brand", bounds=(1.0, 50.0))
    return df.select("p_brand", "point", "x", F.round("density", 9).alias("density"))


def balance_density_surface(spark, sf):
    df = kernel_density_2d(table(spark, sf, "customer"), "c_nationkey", "c_acctbal", 25, 20)
    return df.select("x_point", "y_point", rounded_x("x"), rounded_x("y"), F.round(F.col("density") * 1e6, 7).alias("density"))


def value_box_with_infinities(spark, sf):
    """Values of events, those of every fifth user without bounds."""
    v = F.col("value")
    far = F.when(F.col("user_id") % 10 == 0, F.lit(float("inf"))).when(F.col("user_id") % 10 == 5, F.lit(float("-inf")))
    df = table(spark, sf, "events").select("event_type", F.coalesce(far, v).alias("value"))
    return rounded(box_stats(df, "value", "event_type"), *_BOX)


def rounded_x(name):
    return F.round(name, 4).alias(name)


def supplier_density_points(spark, sf):
    return density_points(table(spark, sf, "supplier"), "s_suppkey", "s_nationkey", "s_acctbal")


def lowest_supplier_density_points(spark, sf):
    suppliers = table(spark, sf, "supplier")
    return density_points(
        suppliers, "s_suppkey", "s_nationkey", "s_acctbal", k=20, tie="s_suppkey", asc=True
    )


def _month(name):
    return date_part(F.col(name), "month_start").cast("string")


def orders_per_month(spark, sf):
    return trend(table(spark, sf, "orders"), _month("o_orderdate"))


def avg_price_per_year(spark, sf):
    orders = table(spark, sf, "orders")
    return trend(orders, date_part(F.col("o_orderdate"), "year"), "avg", money("o_totalprice"))


def running_price_by_month(spark, sf):
    df = cumulative(table(spark, sf, "orders"), _month("o_orderdate"), "sum", money("o_totalprice"))
    return to_double(df, "value", "running")


def running_orders_by_customer(spark, sf):
    """A key too fine for one task: blocks of it are summed apart."""
    return cumulative(table(spark, sf, "orders"), "o_custkey", "count", one_task_rows=100)


def quantity_price_pairs(spark, sf):
    lines = row_filter(table(spark, sf, "lineitem"), between("l_quantity", 10, 12))
    return pairs(lines, "l_quantity", "l_extendedprice", color="l_returnflag")


def filtered_orders(spark, sf):
    orders = row_filter(
        table(spark, sf, "orders"),
        one_of("o_orderpriority", ["1-URGENT", "2-HIGH"]),
        F.col("o_orderstatus") != "P",
        F.col("o_totalprice") > 1000,
        F.col("o_custkey").isNotNull(),
        after_year("o_orderdate", 1996),
        before_year("o_orderdate", 2000),
    )
    return orders.select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")


def orders_of_1998_per_month(spark, sf):
    orders = row_filter(table(spark, sf, "orders"), in_year("o_orderdate", 1998))
    return trend(orders, date_part(F.col("o_orderdate"), "month"))


def machinery_balances(spark, sf):
    customers = row_filter(table(spark, sf, "customer"), F.col("c_mktsegment") == "MACHINERY")
    return category_values(customers, "c_name", "c_acctbal")


def suppliers_above_first(spark, sf):
    return compare_to_row(table(spark, sf, "supplier"), "s_suppkey", 0, "s_acctbal")


def discount_and_tax_by_flag(spark, sf):
    long = unpivot_measures(table(spark, sf, "lineitem"), "l_returnflag", ["l_discount", "l_tax"])
    df = agg_by(long, ["l_returnflag", "component"], money("value"), "sum", "total")
    return to_double(df, "total")


def discount_and_tax_share(spark, sf):
    long = unpivot_measures(table(spark, sf, "lineitem"), [], ["l_discount", "l_tax"])
    return to_double(share(long, "component", money("value")), "amount")


def orders_by_month_of_year(spark, sf):
    orders = table(spark, sf, "orders")
    return count_by(orders.withColumn("month", date_part(F.col("o_orderdate"), "month")), "month")


def parts_by_size_band(spark, sf):
    return count_by(table(spark, sf, "part").withColumn("band", number_bands(F.col("p_size"), 10)), "band")


def avg_price_by_size_band(spark, sf):
    parts = table(spark, sf, "part").withColumn("band", number_bands(F.col("p_size"), 10))
    return trend(parts, "band", "avg", money("p_retailprice"))


QUERIES = {
    f.__name__: f
    for f in (
        count_by_priority,
        count_by_flag_and_status,
        avg_price_by_type,
        quantity_by_flag,
        quality_rate_by_lang,
        high_values_by_event_type,
        top_brands_by_count,
        top_customers_by_spend,
        top_orders_by_price,
        lowest_balances,
        quantity_of_top_brands,
        lines_of_top_parts,
        best_part_of_top_types,
        best_order_per_customer,
        share_of_flags,
        quantity_share_of_suppliers,
        price_histogram,
        price_histogram_by_status,
        value_histogram_in_bounds,
        price_histogram_of_all_customers,
        best_part_of_top_types_by_price,
        lines_by_discount_band,
        price_density,
        price_density_by_status,
        price_box_by_flag,
        price_box,
        value_box_by_event_type,
        size_price_grid,
        price_hexbins,
        price_kernel_density,
        size_kernel_density,
        balance_density_surface,
        value_box_with_infinities,
        supplier_density_points,
        lowest_supplier_density_points,
        orders_per_month,
        avg_price_per_year,
        running_price_by_month,
        running_orders_by_customer,
        quantity_price_pairs,
        filtered_orders,
        orders_of_1998_per_month,
        machinery_balances,
        suppliers_above_first,
        discount_and_tax_by_flag,
        discount_and_tax_share,
        orders_by_month_of_year,
        parts_by_size_band,
        avg_price_by_size_band,
    )
}


def _binned(name: str, source: str, bins: int, by: str = "") -> str:
    """SQL for counts per bin, empty bins included."""
    key, comma = (by, f"{by}, ") if by else ("", "")
    groups = f"(SELECT DISTINCT {by} FROM {source})" if by else "(SELECT 1 AS one)"
    same = f"AND c.{key} = g.{key}" if by else ""
    shown = f"g.{key}, " if by else ""
    return f"""
        WITH ends AS (SELECT MIN({name}) AS lo, MAX({name}) AS hi FROM {source}),
        edges AS (SELECT lo, hi, (hi - lo) / CAST({bins} AS DOUBLE) AS width FROM ends),
        counted AS (
            SELECT {comma}LEAST(CAST(FLOOR(({name} - lo) / width) AS BIGINT), {bins - 1}) AS bin,
                   COUNT(*) AS n
            FROM {source}, edges GROUP BY ALL),
        filled AS (
            SELECT {shown}CAST(b.bin AS BIGINT) AS bin, lo + b.bin * width AS bin_lo,
                   lo + (b.bin + 1) * width AS bin_hi, COALESCE(c.n, 0) AS n
            FROM edges, range({bins}) b(bin), {groups} g
            LEFT JOIN counted c ON c.bin = b.bin {same})"""


def _box(name: str, source: str, by: str = "") -> str:
    comma = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = f"JOIN f USING ({by})" if by else ", f"
    return f"""
        WITH q AS (
            SELECT {comma}quantile_cont({name}, 0.25) AS q1, quantile_cont({name}, 0.5) AS median,
                   quantile_cont({name}, 0.75) AS q3 FROM {source} {group}),
        f AS (SELECT *, q1 - (q3 - q1) * 1.5 AS fence_lo, q3 + (q3 - q1) * 1.5 AS fence_hi FROM q)
        SELECT {comma}COUNT(*) AS n, ROUND(MIN({name}), 6) AS min, ROUND(ANY_VALUE(q1), 6) AS q1,
               ROUND(ANY_VALUE(median), 6) AS median, ROUND(ANY_VALUE(q3), 6) AS q3,
               ROUND(MAX({name}), 6) AS max, ROUND(ANY_VALUE(fence_lo), 6) AS fence_lo,
               ROUND(ANY_VALUE(fence_hi), 6) AS fence_hi,
               ROUND(MIN(CASE WHEN {name} >= fence_lo THEN {name} END), 6) AS whisker_lo,
               ROUND(MAX(CASE WHEN {name} <= fence_hi THEN {name} END), 6) AS whisker_hi,
               COUNT(CASE WHEN {name} < fence_lo OR {name} > fence_hi THEN 1 END) AS n_outliers
        FROM {source} {join} {group}"""


def _density_sql(name: str, source: str, points: int, by: str) -> str:
    """Linear binning, then every grid point's weight at every other."""
    return f"""
        WITH ends AS (SELECT MIN({name}) AS lo, (MAX({name}) - MIN({name})) / {points - 1}.0::DOUBLE AS step FROM {source}),
        u AS (SELECT {by}, ({name} - lo) / step AS u, LEAST(FLOOR(({name} - lo) / step), {points - 2}) AS i FROM {source}, ends),
        w AS (
            SELECT {by}, i, SUM(w) AS w FROM (
                SELECT {by}, i, 1 - (u - i) AS w FROM u UNION ALL SELECT {by}, i + 1, u - i FROM u) GROUP BY 1, 2),
        h AS (SELECT {by}, COUNT(*) AS n, stddev_samp(u) * pow(COUNT(*), -0.2) AS h FROM u GROUP BY 1)
        SELECT {by}, CAST(j AS BIGINT) AS point, lo + j * step AS x,
               SUM(w * exp(-0.5 * pow((j - i) / h, 2))) / (sqrt(2 * pi()) * ANY_VALUE(h) * ANY_VALUE(n) * ANY_VALUE(step)) AS density
        FROM w JOIN h USING ({by}), range({points}) t(j), ends GROUP BY {by}, j, lo, step"""


_SURFACE = """
        WITH ends AS (
            SELECT MIN(c_nationkey) AS xl, (MAX(c_nationkey) - MIN(c_nationkey)) / 24.0::DOUBLE AS xs,
                   MIN(c_acctbal) AS yl, (MAX(c_acctbal) - MIN(c_acctbal)) / 19.0::DOUBLE AS ys FROM customer),
        p AS (SELECT (c_nationkey - xl) / xs AS u, (c_acctbal - yl) / ys AS v FROM customer, ends),
        c AS (SELECT u, v, LEAST(FLOOR(u), 23) AS i, LEAST(FLOOR(v), 18) AS j FROM p),
        w AS (
            SELECT i + a AS i, j + b AS j,
                   SUM(CASE WHEN a = 1 THEN u - i ELSE 1 - (u - i) END * CASE WHEN b = 1 THEN v - j ELSE 1 - (v - j) END) AS w
            FROM c, range(2) s(a), range(2) t(b) GROUP BY 1, 2),
        h AS (
            SELECT COUNT(*) AS n, stddev_samp(u) * pow(COUNT(*), -1.0::DOUBLE / 6) AS hx,
                   stddev_samp(v) * pow(COUNT(*), -1.0::DOUBLE / 6) AS hy FROM p)
        SELECT CAST(a AS BIGINT) AS x_point, CAST(b AS BIGINT) AS y_point, ROUND(xl + a * xs, 4) AS x, ROUND(yl + b * ys, 4) AS y,
               ROUND(SUM(w * exp(-0.5 * (pow((a - i) / hx, 2) + pow((b - j) / hy, 2))))
                   / (2 * pi() * hx * hy * n * xs * ys) * 1e6, 7) AS density
        FROM w, h, ends, range(25) s(a), range(20) t(b) GROUP BY a, b, xl, xs, yl, ys, hx, hy, n"""

# Quartiles from the sorted values themselves, as a library's may not take infinities.
_INFINITE_BOX = """
        WITH v AS (
            SELECT event_type, CASE user_id % 10 WHEN 0 THEN 'Infinity'::DOUBLE WHEN 5 THEN '-Infinity'::DOUBLE ELSE value END AS value
            FROM events),
        r AS (
            SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
                   COUNT(*) OVER (PARTITION BY event_type) - 1 AS m FROM v),
        e AS (
            SELECT event_type, q, MAX(m * q) - FLOOR(MAX(m * q)) AS f,
                   MAX(CASE WHEN i = FLOOR(m * q) THEN value END) AS lo, MAX(CASE WHEN i = CEIL(m * q) THEN value END) AS hi
            FROM r, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) t(q) GROUP BY 1, 2),
        q AS (
            SELECT event_type, MAX(CASE WHEN q = 0.25 THEN x END) AS q1, MAX(CASE WHEN q = 0.5 THEN x END) AS median,
                   MAX(CASE WHEN q = 0.75 THEN x END) AS q3
            FROM (SELECT event_type, q, CASE WHEN lo = hi OR f = 0 THEN lo ELSE lo + (hi - lo) * f END AS x FROM e) GROUP BY 1),
        f AS (
            SELECT *, q1 - reach AS fence_lo, q3 + reach AS fence_hi
            FROM (SELECT *, CASE WHEN q1 = q3 THEN 0 ELSE (q3 - q1) * 1.5 END AS reach FROM q))
        SELECT event_type, COUNT(*) AS n, ROUND(MIN(value), 6) AS min, ROUND(ANY_VALUE(q1), 6) AS q1,
               ROUND(ANY_VALUE(median), 6) AS median, ROUND(ANY_VALUE(q3), 6) AS q3, ROUND(MAX(value), 6) AS max,
               ROUND(ANY_VALUE(fence_lo), 6) AS fence_lo, ROUND(ANY_VALUE(fence_hi), 6) AS fence_hi,
               ROUND(MIN(CASE WHEN value >= fence_lo THEN value END), 6) AS whisker_lo,
               ROUND(MAX(CASE WHEN value <= fence_hi THEN value END), 6) AS whisker_hi,
               COUNT(CASE WHEN value < fence_lo OR value > fence_hi THEN 1 END) AS n_outliers
        FROM v JOIN f USING (event_type) GROUP BY 1"""

_MONTH = "CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR)"

ORACLES = {
    "count_by_priority": "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1",
    "count_by_flag_and_status": """
        SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY 1, 2""",
    "avg_price_by_type": f"""
        SELECT p_type, {avg_sql("p_retailprice")} AS avg_price FROM part GROUP BY 1""",
    "quantity_by_flag": f"""
        SELECT l_returnflag, CAST(SUM({money_sql("l_quantity")}) AS DOUBLE) AS sum_qty
        FROM lineitem GROUP BY 1""",
    "quality_rate_by_lang": """
        SELECT lang, AVG(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS rate
        FROM labels JOIN documents USING (doc_id) GROUP BY 1""",
    "high_values_by_event_type": """
        SELECT event_type, COUNT(CASE WHEN value > 100 THEN 1 END) AS n FROM events GROUP BY 1""",
    "top_brands_by_count": """
        SELECT p_brand, COUNT(*) AS value FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
    "top_customers_by_spend": f"""
        SELECT o_custkey, CAST(SUM({money_sql("o_totalprice")}) AS DOUBLE) AS spend
        FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "top_orders_by_price": """
        SELECT o_orderkey, o_totalprice FROM orders ORDER BY 2 DESC, 1 LIMIT 10""",
    "lowest_balances": """
        SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 8""",
    "quantity_of_top_brands": f"""
        SELECT p_brand, sum_qty FROM (
            SELECT p_brand, SUM({money_sql("l_extendedprice")}) AS revenue,
                   CAST(SUM({money_sql("l_quantity")}) AS DOUBLE) AS sum_qty
            FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
            ORDER BY 2 DESC, 1 LIMIT 8)""",
    "lines_of_top_parts": f"""
        SELECT l_partkey, l_orderkey, l_quantity FROM lineitem WHERE l_partkey IN (
            SELECT l_partkey FROM lineitem GROUP BY 1
            ORDER BY SUM({money_sql("l_extendedprice")}) DESC, 1 LIMIT 5)""",
    "best_part_of_top_types": """
        SELECT p_type, p_partkey, p_retailprice, p_name FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY p_type
                ORDER BY p_retailprice DESC, p_partkey) AS place FROM part)
        WHERE place = 1 AND p_type IN (
            SELECT p_type FROM part GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 3)""",
    "best_order_per_customer": """
        SELECT o_custkey, o_orderkey, o_totalprice FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey
                ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders)
        WHERE place = 1""",
    "share_of_flags": """
        SELECT l_returnflag, COUNT(*) AS amount,
               CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM lineitem) AS share
        FROM lineitem GROUP BY 1""",
    "quantity_share_of_suppliers": f"""
        SELECT l_suppkey, CAST(SUM({money_sql("l_quantity")}) AS DOUBLE) AS amount,
               CAST(SUM({money_sql("l_quantity")}) AS DOUBLE)
                   / (SELECT CAST(SUM({money_sql("l_quantity")}) AS DOUBLE) FROM lineitem) AS share
        FROM lineitem GROUP BY 1""",
    "price_histogram": _binned("o_totalprice", "orders", 20)
    + "SELECT bin, ROUND(bin_lo, 6) AS bin_lo, ROUND(bin_hi, 6) AS bin_hi, n FROM filled",
    "price_histogram_by_status": _binned("o_totalprice", "orders", 20, "o_orderstatus")
    + """SELECT o_orderstatus, bin, ROUND(bin_lo, 6) AS bin_lo, ROUND(bin_hi, 6) AS bin_hi, n
         FROM filled""",
    "value_histogram_in_bounds": """
        WITH counted AS (
            SELECT event_type, LEAST(CAST(FLOOR(value / 4.0::DOUBLE) AS BIGINT), 15) AS bin, COUNT(*) AS n
            FROM events WHERE value BETWEEN 0 AND 64 GROUP BY ALL),
        kinds AS (SELECT DISTINCT event_type FROM events)
        SELECT k.event_type, CAST(b.bin AS BIGINT) AS bin, b.bin * 4.0::DOUBLE AS bin_lo,
               (b.bin + 1) * 4.0::DOUBLE AS bin_hi, COALESCE(c.n, 0) AS n
        FROM range(16) b(bin), kinds k
        LEFT JOIN counted c ON c.bin = b.bin AND c.event_type = k.event_type""",
    "price_histogram_of_all_customers": """
        WITH counted AS (
            SELECT o_custkey, LEAST(CAST(FLOOR((o_totalprice - 1000) / 2000.0::DOUBLE) AS BIGINT), 3) AS bin, COUNT(*) AS n
            FROM orders WHERE o_totalprice BETWEEN 1000 AND 9000 GROUP BY ALL),
        kinds AS (SELECT DISTINCT o_custkey FROM orders)
        SELECT k.o_custkey, CAST(b.bin AS BIGINT) AS bin, 1000 + b.bin * 2000.0::DOUBLE AS bin_lo,
               1000 + (b.bin + 1) * 2000.0::DOUBLE AS bin_hi, COALESCE(c.n, 0) AS n
        FROM range(4) b(bin), kinds k
        LEFT JOIN counted c ON c.bin = b.bin AND c.o_custkey IS NOT DISTINCT FROM k.o_custkey""",
    "best_part_of_top_types_by_price": """
        SELECT p_type, p_partkey, p_size FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) AS place FROM part)
        WHERE place = 1 AND p_type IN (
            SELECT p_type FROM part GROUP BY 1 ORDER BY MAX(p_retailprice) DESC, 1 LIMIT 5)""",
    "lines_by_discount_band": """
        SELECT (CAST(round(l_discount * 100) AS BIGINT) // 2 * 2) / 100.0::DOUBLE AS band, COUNT(*) AS n
        FROM lineitem GROUP BY 1""",
    "price_density": _binned("o_totalprice", "orders", 12)
    + """SELECT bin, ROUND(CAST(n AS DOUBLE) / ((SELECT COUNT(*) FROM orders) * (bin_hi - bin_lo))
                * 1e6, 6) AS density FROM filled""",
    "price_density_by_status": _binned("o_totalprice", "orders", 12, "o_orderstatus")
    + """SELECT o_orderstatus, bin,
                ROUND(CAST(n AS DOUBLE) / (SUM(n) OVER (PARTITION BY o_orderstatus)
                      * (bin_hi - bin_lo)) * 1e6, 6) AS density FROM filled""",
    "price_box_by_flag": _box("l_extendedprice", "lineitem", "l_returnflag"),
    "price_box": _box("l_extendedprice", "lineitem"),
    "value_box_by_event_type": _box("value", "events", "event_type"),
    "size_price_grid": """
        WITH e AS (
            SELECT MIN(p_size) AS xl, (MAX(p_size) - MIN(p_size)) / 10.0::DOUBLE AS xw,
                   MIN(p_retailprice) AS yl, (MAX(p_retailprice) - MIN(p_retailprice)) / 8.0::DOUBLE AS yw
            FROM part)
        SELECT LEAST(CAST(FLOOR((p_size - xl) / xw) AS BIGINT), 9) AS x_bin,
               LEAST(CAST(FLOOR((p_retailprice - yl) / yw) AS BIGINT), 7) AS y_bin, COUNT(*) AS n
        FROM part, e GROUP BY 1, 2""",
    "price_hexbins": f"""
        WITH e AS (
            SELECT MIN(l_extendedprice) AS xl, (MAX(l_extendedprice) - MIN(l_extendedprice)) / 12.0::DOUBLE AS xw,
                   MIN(l_quantity) AS yl, (MAX(l_quantity) - MIN(l_quantity)) / 6.0::DOUBLE AS yw FROM lineitem),
        p AS (SELECT l_discount, xl, xw, yl, yw, (l_extendedprice - xl) / xw AS u, (l_quantity - yl) / yw AS v FROM lineitem, e),
        d AS (
            SELECT *, (u - FLOOR(u + 0.5)) * (u - FLOOR(u + 0.5)) + 3.0 * (v - FLOOR(v + 0.5)) * (v - FLOOR(v + 0.5))
                <= (u - FLOOR(u) - 0.5) * (u - FLOOR(u) - 0.5) + 3.0 * (v - FLOOR(v) - 0.5) * (v - FLOOR(v) - 0.5) AS first FROM p),
        c AS (
            SELECT *, CAST(CASE WHEN first THEN 2 * FLOOR(u + 0.5) ELSE 2 * FLOOR(u) + 1 END AS BIGINT) AS hex_column,
                   CAST(CASE WHEN first THEN 2 * FLOOR(v + 0.5) ELSE 2 * FLOOR(v) + 1 END AS BIGINT) AS hex_row FROM d)
        SELECT hex_column, hex_row, ROUND(ANY_VALUE(xl) + hex_column / 2.0::DOUBLE * ANY_VALUE(xw), 6) AS x,
               ROUND(ANY_VALUE(yl) + hex_row / 2.0::DOUBLE * ANY_VALUE(yw), 6) AS y, COUNT(*) AS n,
               ROUND({avg_sql("l_discount")}, 6) AS value
        FROM c GROUP BY 1, 2""",
    "price_kernel_density": "SELECT o_orderstatus, point, ROUND(x, 4) AS x, ROUND(density * 1e6, 7) AS density FROM ("
    + _density_sql("o_totalprice", "orders", 100, "o_orderstatus")
    + ")",
    "size_kernel_density": """
        WITH h AS (SELECT p_brand, COUNT(*) AS n, stddev_samp(p_size) * pow(COUNT(*), -0.2) AS h FROM part GROUP BY 1)
        SELECT p_brand, CAST(j AS BIGINT) AS point, 1.0::DOUBLE + j AS x,
               ROUND(SUM(exp(-0.5 * pow((1 + j - p_size) / h, 2))) / (sqrt(2 * pi()) * ANY_VALUE(h) * ANY_VALUE(n)), 9) AS density
        FROM part JOIN h USING (p_brand), range(50) t(j) GROUP BY p_brand, j""",
    "balance_density_surface": _SURFACE,
    "value_box_with_infinities": _INFINITE_BOX,
    "supplier_density_points": """
        SELECT s_suppkey AS lat, s_nationkey AS lon, s_acctbal AS z FROM supplier""",
    "lowest_supplier_density_points": """
        SELECT s_suppkey AS lat, s_nationkey AS lon, s_acctbal AS z FROM supplier
        ORDER BY s_acctbal, s_suppkey LIMIT 20""",
    "orders_per_month": f"SELECT {_MONTH} AS period, COUNT(*) AS value FROM orders GROUP BY 1",
    "avg_price_per_year": f"""
        SELECT CAST(year(o_orderdate) AS INTEGER) AS period, {avg_sql("o_totalprice")} AS value
        FROM orders GROUP BY 1""",
    "running_price_by_month": f"""
        SELECT period, CAST(value AS DOUBLE) AS value,
               CAST(SUM(value) OVER (ORDER BY period) AS DOUBLE) AS running
        FROM (SELECT {_MONTH} AS period, SUM({money_sql("o_totalprice")}) AS value
              FROM orders GROUP BY 1)""",
    "running_orders_by_customer": """
        SELECT period, value, CAST(SUM(value) OVER (ORDER BY period) AS BIGINT) AS running
        FROM (SELECT o_custkey AS period, COUNT(*) AS value FROM orders GROUP BY 1)""",
    "quantity_price_pairs": """
        SELECT l_quantity AS x, l_extendedprice AS y, l_returnflag AS color
        FROM lineitem WHERE l_quantity BETWEEN 10 AND 12""",
    "filtered_orders": """
        SELECT o_orderkey, o_orderpriority, o_orderstatus, o_totalprice FROM orders
        WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'P'
          AND o_totalprice > 1000 AND o_custkey IS NOT NULL AND year(o_orderdate) BETWEEN 1997 AND 1999""",
    "orders_of_1998_per_month": """
        SELECT CAST(month(o_orderdate) AS INTEGER) AS period, COUNT(*) AS value
        FROM orders WHERE year(o_orderdate) = 1998 GROUP BY 1""",
    "machinery_balances": """
        SELECT c_name AS label, c_acctbal AS value FROM customer WHERE c_mktsegment = 'MACHINERY'""",
    "suppliers_above_first": """
        SELECT * FROM supplier
        WHERE s_acctbal > (SELECT s_acctbal FROM supplier WHERE s_suppkey = 0)""",
    "discount_and_tax_by_flag": f"""
        SELECT l_returnflag, 'l_discount' AS component,
               CAST(SUM({money_sql("l_discount")}) AS DOUBLE) AS total FROM lineitem GROUP BY 1
        UNION ALL
        SELECT l_returnflag, 'l_tax', CAST(SUM({money_sql("l_tax")}) AS DOUBLE)
        FROM lineitem GROUP BY 1""",
    "discount_and_tax_share": f"""
        WITH s AS (
            SELECT CAST(SUM({money_sql("l_discount")}) AS DOUBLE) AS d,
                   CAST(SUM({money_sql("l_tax")}) AS DOUBLE) AS t,
                   CAST(SUM({money_sql("l_discount")}) + SUM({money_sql("l_tax")}) AS DOUBLE) AS a
            FROM lineitem)
        SELECT 'l_discount' AS component, d AS amount, d / a AS share FROM s
        UNION ALL SELECT 'l_tax', t, t / a FROM s""",
    "orders_by_month_of_year": """
        SELECT CAST(month(o_orderdate) AS INTEGER) AS month, COUNT(*) AS n FROM orders GROUP BY 1""",
    "parts_by_size_band": """
        SELECT CAST(FLOOR(p_size / 10.0::DOUBLE) * 10 AS BIGINT) AS band, COUNT(*) AS n
        FROM part GROUP BY 1""",
    "avg_price_by_size_band": f"""
        SELECT CAST(FLOOR(p_size / 10.0::DOUBLE) * 10 AS BIGINT) AS period,
               {avg_sql("p_retailprice")} AS value FROM part GROUP BY 1""",
}
