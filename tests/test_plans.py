"""What the plans must and must not hold."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import catalog
from chartmeter.shared import run_scope, stage

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(catalog.queries()["filtered_orders"](spark, SF_DIR))
    for pushed in ("In(o_orderpriority", "GreaterThan(o_totalprice,1000.0)", "LessThan(o_orderdate", "IsNotNull(o_custkey)"):
        assert pushed in text
    text = plan(catalog.queries()["count_by_priority"](spark, SF_DIR))
    assert "ReadSchema: struct<o_orderpriority:string>" in text


def test_topk_does_not_sort_everything(spark):
    for name in ("top_orders_by_price", "top_brands_by_count", "quantity_of_top_brands"):
        text = plan(catalog.queries()[name](spark, SF_DIR))
        assert "TakeOrderedAndProject" in text


def test_groups_are_reduced_before_the_shuffle(spark):
    for name in ("count_by_priority", "avg_price_by_type", "best_order_per_customer"):
        text = plan(catalog.queries()[name](spark, SF_DIR))
        assert "partial_" in text.split("Exchange")[-1]


def test_best_rows_are_found_without_sorting_all(spark):
    for name in ("best_order_per_customer", "best_part_of_top_types", "best_part_of_top_types_by_price"):
        text = plan(catalog.queries()[name](spark, SF_DIR))
        assert "SortAggregate" not in text and "HashAggregate" in text
        assert "WindowGroupLimit" in text and "Partial" in text


def test_the_total_of_shares_reuses_the_shuffle(spark):
    df = catalog.queries()["share_of_flags"](spark, SF_DIR)
    df.collect()
    assert "ReusedExchange" in plan(df)


def test_a_scope_leaves_nothing_behind(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    with run_scope(spark):
        assert catalog.queries()["scored_orders"](spark, SF_DIR).count() > 0
        assert set(folder.iterdir()) != before
    assert set(folder.iterdir()) == before
    with pytest.raises(ZeroDivisionError), run_scope(spark):
        stage(spark.range(3), "kept")
        raise ZeroDivisionError
    assert set(folder.iterdir()) == before


def test_pieces_do_not_carry_texts(spark):
    from chartmeter.plans import matching

    text = "struct<kind:string,num:double,str:string>"
    row = ("c", "xy", "k", (None, None, None), ("str", None, "a" * 300), ("num", 1.0, None), 5, "k", "a" * 300, False)
    names = f"case_id string, pair string, texts string, fixed {text}, k {text}, v {text}, pid long, side string, text string, dense boolean"
    offered = spark.createDataFrame([row], names)
    asked = matching._asked_pieces(offered.withColumnsRenamed({"pid": "gid", "dense": "short"}))
    pieces = matching._offered_pieces(offered, asked)
    assert pieces.columns == ["pid", "h"] and pieces.count() == 1  # all its pieces are alike
    assert {r["size"] for r in asked.collect()} == {matching.PIECE}
    changed = offered.withColumn("text", F.concat("text", F.sha2("text", 512), F.sha2(F.upper("text"), 512)))
    assert 1 < matching._offered_pieces(changed, asked).count() <= (300 + 256) / 8
