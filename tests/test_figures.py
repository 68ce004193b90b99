import json

import pytest
from pyspark.sql import functions as F

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

FIGURES = [
    '{"data":[{"x":"abc","y":[1,2],"type":"bar","foo":1}],"layout":{}}',
    '{"data":[{"x":[1,"a",2.5,null,true],"y":[1,2,3,[4],{"b":5},6]}]}',
    '{"data":[{"x":[1,"a"],"y":[1,2],"xaxis":null},{"y":[7]},{"x":[3],"xaxis":"x2","type":"bar"}]}',
    '{"data":[]}',
    '{"data":[3]}',
    '{"data":[{"x":[1]},{"x":5}]}',
    '{"data":5}',
    '{"data":null}',
    "[1]",
    "nope",
    None,
    '{"data":[{"lat":[1,2.0,1],"lon":[3,null,3],"z":[1,2,3,4],"type":"densitymapbox"}]}',
]


@pytest.fixture(scope="module")
def figures(spark):
    return spark.createDataFrame(list(enumerate(FIGURES)), "case_id int, j string")


def records(df):
    return {r.case_id: json.loads(r.j) if r.j else None for r in df.select("case_id", F.to_json("record").alias("j")).collect()}


def test_status(figures):
    rows = figure_records(figures, "j").select("case_id", "status").collect()
    assert [r.status for r in sorted(rows)] == [
        "ok", "ok", "ok", "ok", "bad_trace", "bad_trace",
        "bad_data", "bad_data", "no_data", "bad_json", "bad_json", "ok",
    ]


def test_one_trace(figures):
    parsed = parse_figures(figures, "j")
    assert records(project_trace(parsed))[0] == {"x": "abc", "y": [1, 2], "type": "bar", "foo": 1}
    kept = records(project_trace(parsed, FIGURE_KEYS))
    assert kept[0] == {"x": "abc", "y": [1, 2], "type": "bar"} and kept[4] is None
    assert kept.keys() == {0, 1, 4, 11}


def test_many_traces(figures):
    joined = records(flatten_traces(parse_figures(figures, "j")))
    assert joined == {
        2: {"x": [1, "a", 3], "y": [1, 2, 7], "type": "bar", "xaxis": "x2", "yaxis": None},
        3: {"x": [], "y": [], "type": None, "xaxis": None, "yaxis": None},
        5: None,
    }


def test_points(figures):
    points = explode_points(figure_records(figures, "j"))
    found = {}
    for r in points.orderBy("case_id", "pos").collect():
        k, v = (value.num if value.kind == "num" else value.str for value in (r.k, r.v))
        found.setdefault((r.case_id, r.pair), []).append((r.k.kind, k, r.v.kind, v))
    assert found[0, "xy"] == [("str", "a", "num", 1.0), ("str", "b", "num", 2.0)]
    assert found[1, "xy"] == [
        ("num", 1.0, "num", 1.0),
        ("str", "a", "num", 2.0),
        ("num", 2.5, "num", 3.0),
        ("null", None, "other", "[4]"),
        ("num", 1.0, "other", '{"b":5}'),
    ]
    assert found[2, "xy"][2] == ("num", 3.0, "num", 7.0)
    assert found[11, "latlon"] == [("num", 1.0, "num", 3.0), ("num", 2.0, "null", None), ("num", 1.0, "num", 3.0)]


def test_last_value_of_a_key_stays(figures):
    points = explode_points(figure_records(figures, "j"))
    last = last_values(points.where("case_id = 1"), ["case_id", "pair", "k"]).where("k.num = 1")
    assert [r.v.str for r in last.collect()] == ['{"b":5}']


def test_triples(figures):
    rows = explode_triples(figure_records(figures, "j")).orderBy("pos").collect()
    assert [(r.k1.num, r.k2.num, r.v.num) for r in rows] == [(1, 3, 1), (2, None, 2), (1, 3, 3)]


# JSON text, and whether it is taken as JSON: that is what Python's reader takes, too.
NUMBERS = [
    '{"data": [{"x": [NaN, Infinity, -Infinity], "y": [1, 2, 3]}]}', '{"data": [NaN]}', '{"data": ["NaN, INF"], "a": NaN}', '{"data": ["\\"", NaN]}',
    '{"data": [nan]}', '{"data": [INF]}', '{"data": [+Infinity]}', '{"data": [-NaN]}', "{'data': [NaN]}", '{"data": [NaN}', "{data: [NaN]}",
]


def test_numbers_that_are_none(spark):
    def taken(text):
        try:
            return json.loads(text) is not None
        except ValueError:
            return False

    df = parse_figures(spark.createDataFrame([(t,) for t in NUMBERS], "j string"), "j")
    assert {r.j: r.status != "bad_json" for r in df.collect()} == {t: taken(t) for t in NUMBERS}
    points = explode_points(figure_records(spark.createDataFrame([(1, NUMBERS[0])], "case_id int, j string"), "j"))
    assert sorted(str(r.k.num) for r in points.collect()) == ["-inf", "inf", "nan"]
