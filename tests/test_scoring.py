import json

import pytest
from pyspark.sql import functions as F

from chartmeter.plans import failure_report, figure_records, pass_rate, score_cases, score_records
from chartmeter.shared import stage

BAR = {"type": "bar", "x": ["a", "b"], "y": [1, 2.5], "xaxis": "x", "yaxis": "y"}
PIE = {
    "type": "pie", "labels": ["a", "b"], "values": [1, 2],
    "domain": {"x": [0.0, 1.0], "y": [0.0, 1.0]},
}
MAP = {"type": "densitymapbox", "lat": [1, 2], "lon": [3, 4], "z": [5, 6], "subplot": "mapbox"}
GEO = {"type": "scattergeo", "lat": [1, 2], "lon": [3, 4]}


def but(record, **changes):
    """A record with some keys changed; ``...`` removes one."""
    changed = {**record, **changes}
    return {key: value for key, value in changed.items() if value is not ...}


WITH, WITHOUT = "WithPlotType", "WithoutPlotType"

# name: (golden, predicted, level, reason of failure or None, vacuous)
CASES = {
    "same": (BAR, BAR, WITH, None, False),
    "further keys": (BAR, but(BAR, name="n", marker={"size": 1}), WITH, None, False),
    "other type": (BAR, but(BAR, type="box"), WITH, "type_mismatch", False),
    "other type allowed": (BAR, but(BAR, type="box"), WITHOUT, None, False),
    "no type": (BAR, but(BAR, type=...), WITH, "error", False),
    "null type": (BAR, but(BAR, type=None), WITH, "type_mismatch", False),
    "no type needed": (BAR, but(BAR, type=...), WITHOUT, None, False),
    "other y": (BAR, but(BAR, y=[1, 3]), WITH, "data_mismatch", False),
    "near y": (BAR, but(BAR, y=[1.001, 2.501]), WITH, None, False),
    "more points": (BAR, but(BAR, x=["c", "b", "a"], y=[9, 2.5, 1]), WITH, None, False),
    "longer names": (BAR, but(BAR, x=["A1", "xB"]), WITH, None, False),
    "shorter names": (but(BAR, x=["a1", "b"]), BAR, WITH, "data_mismatch", False),
    "shorter y": (but(BAR, x=["a", "b", "c"]), BAR, WITH, None, False),
    "swapped": (BAR, but(BAR, x=BAR["y"], y=BAR["x"]), WITH, None, False),
    "swapped and wrong": (BAR, but(BAR, x=[1, 3], y=BAR["x"]), WITH, "data_mismatch", False),
    "no x": (BAR, but(BAR, x=...), WITH, "error", False),
    "null x": (BAR, but(BAR, x=None), WITH, "error", False),
    "number as x": (BAR, but(BAR, x=5), WITH, "error", False),
    "text as x": (but(BAR, x="ab"), BAR, WITH, None, False),
    "list in x": (BAR, but(BAR, x=["a", "b", ["c"]], y=[1, 2.5, 3]), WITH, "error", False),
    "list beyond the zip": (BAR, but(BAR, x=["a", "b", ["c"]]), WITH, None, False),
    "list in y": (but(BAR, y=[[1], 2.5]), but(BAR, y=[[1], 2.5]), WITH, None, False),
    "list in y as key": (but(BAR, y=[[1], 2.5]), but(BAR, y=[[1], 3]), WITH, "error", False),
    "list in golden y": (but(BAR, y=[[1]]), but(BAR, y=[[1]]), WITH, None, False),
    "empty golden": (but(BAR, x=[], y=[]), BAR, WITH, None, False),
    "other axis": (BAR, but(BAR, xaxis="x2"), WITH, "extra_mismatch", False),
    "no axis": (BAR, but(BAR, xaxis=...), WITH, "extra_mismatch", False),
    "null axis": (BAR, but(BAR, xaxis=None), WITH, "extra_mismatch", False),
    "axis in neither": (but(BAR, xaxis=...), but(BAR, xaxis=...), WITH, "extra_mismatch", False),
    "axis not in golden": (but(BAR, xaxis=...), BAR, WITH, "error", False),
    "null axes": (but(BAR, xaxis=None), but(BAR, xaxis=None), WITH, None, False),
    "axis unasked": (BAR, but(BAR, xaxis="x2"), WITHOUT, None, False),
    "only x": (but(BAR, y=...), but(BAR, y=..., x=["q"]), WITH, None, True),
    "only x, y answered": (but(BAR, y=...), but(BAR, x=...), WITH, None, True),
    "only x, both answered": (but(BAR, y=...), BAR, WITH, "data_mismatch", False),
    "histogram2d": (
        but(BAR, type="histogram2d", xbingroup="x", ybingroup="y"),
        but(BAR, type="histogram2d", xbingroup="x", ybingroup="z"),
        WITH, "extra_mismatch", False,
    ),
    "pie": (PIE, PIE, WITH, None, False),
    "pie passes whatever its data": (PIE, but(PIE, values=[7, 8]), WITH, None, True),
    "pie without labels": (PIE, but(PIE, labels=...), WITH, "error", False),
    "pie with x": (PIE, but(PIE, x=[1], values=[1, 3]), WITH, "data_mismatch", False),
    "pie with x and right": (PIE, but(PIE, x=[1]), WITH, None, False),
    "pie as bar": (PIE, BAR, WITHOUT, "error", False),
    "domain as integers": (PIE, but(PIE, domain={"y": [0, 1], "x": [0, 1]}), WITH, None, False),
    "other domain": (PIE, but(PIE, domain={"x": [0, 0.5], "y": [0, 1]}), WITH, "extra_mismatch", False),
    "geo": (GEO, GEO, WITH, None, False),
    "geo vacuous": (GEO, but(GEO, lon=[9, 9]), WITH, None, True),
    "map": (MAP, MAP, WITH, None, False),
    "map z near": (MAP, but(MAP, z=[5.001, 6]), WITH, None, False),
    "map z": (MAP, but(MAP, z=[5, 7]), WITH, "data_mismatch", False),
    "map lat near": (MAP, but(MAP, lat=[1.001, 2]), WITH, "data_mismatch", False),
    "map with more": (MAP, but(MAP, lat=[1, 2, 3], lon=[3, 4, 5], z=[5, 6, 7]), WITH, "data_mismatch", False),
    "map without z": (MAP, but(MAP, z=...), WITH, "error", False),
    "map subplot": (MAP, but(MAP, subplot=...), WITH, "extra_mismatch", False),
    "map golden without subplot": (but(MAP, subplot=...), MAP, WITH, "error", False),
    "map by places": (MAP, but(MAP, z=[0, 0]), WITHOUT, None, False),
    "unknown golden type": (but(BAR, type="sunburst"), BAR, WITHOUT, "unsupported_type", False),
    "golden without type": (but(BAR, type=...), BAR, WITHOUT, "unsupported_type", False),
    "no golden": (None, BAR, WITH, "missing_golden", False),
    "no answer": (BAR, None, WITH, "missing_prediction", False),
    "not JSON": (BAR, "nope", WITH, "bad_json", False),
    "no data": (BAR, '{"layout": {}}', WITH, "no_data", False),
    "NaN": (BAR, '{"data": [{"x": [NaN]}]}', WITH, "error", False),
    "no traces": (BAR, '{"data": []}', WITHOUT, "data_mismatch", False),
    "two traces": (
        BAR,
        json.dumps({"data": [but(BAR, x=["a"], y=[1]), but(BAR, x=["b"], y=[2.5], xaxis="x2")]}),
        WITH, None, False,
    ),
    "two traces, one null": (BAR, json.dumps({"data": [BAR, but(BAR, x=None)]}), WITH, "bad_trace", False),
    "two pies": (PIE, json.dumps({"data": [PIE, PIE]}), WITHOUT, "error", False),
}


@pytest.fixture(scope="module")
def inputs(spark):
    def text(record):
        return record if isinstance(record, str) else json.dumps({"data": [record]})

    cases = spark.createDataFrame(
        [(name, case[2], "kept") for name, case in CASES.items()], "uuid string, complexity string, type string"
    )
    goldens = spark.createDataFrame(
        [(name, text(case[0])) for name, case in CASES.items() if case[0] is not None],
        "uuid string, figure_json string",
    )
    predictions = spark.createDataFrame(
        [(name, text(case[1])) for name, case in CASES.items() if case[1] is not None],
        "uuid string, figure_json string",
    )
    return cases, figure_records(goldens, "figure_json").select("uuid", "record"), predictions


@pytest.fixture(scope="module")
def scored(inputs):
    return score_cases(*inputs)


def test_every_rule(scored):
    found = {r.uuid: (r.reason, r["pass"], r.vacuous) for r in scored.collect()}
    expected = {name: (case[3], case[3] is None, case[4]) for name, case in CASES.items()}
    assert {n: v for n, v in found.items() if v != expected[n]} == {}
    assert found.keys() == expected.keys()
    assert scored.columns == ["uuid", "complexity", "type", "pass", "reason", "vacuous"]


def test_strict_fails_what_was_not_compared(inputs):
    strict = {r.uuid: r.reason for r in score_cases(*inputs, strict=True).collect()}
    expected = {name: "not_compared" if case[4] else case[3] for name, case in CASES.items()}
    assert strict == expected


def test_pass_rates(scored, spark):
    rates = {r.complexity: tuple(r)[1:] for r in pass_rate(scored, ["complexity"], totals=True).collect()}
    for level in (WITH, WITHOUT, None):
        mine = [case for case in CASES.values() if level in (None, case[2])]
        errors = sum(case[3] is not None for case in mine)
        assert rates[level] == (errors, len(mine), round((len(mine) - errors) / len(mine) * 100, 2))
    none = pass_rate(scored.where("uuid = 'nothing'")).first()
    assert tuple(none) == (0, 0, None)


def test_failure_report(inputs, scored):
    cases, goldens, predictions = inputs
    report = {r.uuid: r for r in failure_report(scored, goldens, predictions).collect()}
    assert report.keys() == {name for name, case in CASES.items() if case[3] is not None}
    assert report["not JSON"].predicted == "nope" and report["no answer"].predicted is None
    assert report["no golden"].golden is None
    assert json.loads(report["other y"].golden) == BAR


def test_repeated_cases_count_each_time(inputs):
    cases, goldens, predictions = inputs
    twice = cases.where("uuid = 'same'").union(cases.where("uuid = 'same'"))
    assert [r["pass"] for r in score_cases(twice, goldens, predictions).collect()] == [True, True]


@pytest.mark.parametrize("short", [32, 0])
def test_many_cases_at_once(inputs, monkeypatch, short):
    """The same verdicts with nothing counted as small, and with all arrays counted as long."""
    from chartmeter.plans import matching, scoring

    monkeypatch.setattr(scoring, "SHORT", short)
    for module in (matching, scoring):
        monkeypatch.setattr(module, "broadcast_if_small", lambda df: df)
    found = {r.uuid: r.reason for r in score_cases(*inputs).collect()}
    assert found == {name: case[3] for name, case in CASES.items()}


def test_runs_and_repeated_answers(spark, inputs):
    cases, goldens, predictions = inputs
    twice = predictions.withColumn("run_id", F.lit("a")).unionByName(predictions.limit(0).withColumn("run_id", F.lit("b")))
    one = spark.createDataFrame([("same", "nope", "b")], "uuid string, figure_json string, run_id string")
    both = twice.unionByName(one.select(twice.columns))
    scored = score_cases(cases, goldens, both)
    found = {(r.run_id, r.uuid): r.reason for r in scored.collect()}
    assert {u: reason for (run, u), reason in found.items() if run == "a"} == {n: c[3] for n, c in CASES.items()}
    assert found["b", "same"] == "bad_json" and len(found) == 2 * len(CASES)
    report = failure_report(scored, goldens, both)
    assert report.where("run_id = 'b' and uuid = 'same'").first().predicted == "nope"
    with pytest.raises(ValueError, match="2 predictions"):
        score_cases(cases, goldens, predictions.unionByName(predictions))
    with pytest.raises(ValueError, match="goldens"):
        score_cases(cases, goldens.unionByName(goldens), predictions)


def test_fifty_runs_share_goldens_and_answers(spark, inputs, monkeypatch):
    """Goldens are read once for all runs, and equal answers to a case are compared once."""
    from chartmeter.plans import scoring

    cases, goldens, predictions = inputs
    sizes = {}

    def counted(df, name, *args):
        kept = stage(df, name, *args)
        sizes[name] = kept.count()
        return kept

    monkeypatch.setattr(scoring, "stage", counted)
    runs = predictions.withColumn("run_id", F.explode(F.sequence(F.lit(1), F.lit(50))))
    wrong = (F.col("uuid") == "same") & (F.col("run_id") % 2 == 0)
    runs = runs.withColumn("figure_json", F.when(wrong, "nope").otherwise(F.col("figure_json")))
    nameless = runs.where("run_id = 1").withColumn("run_id", F.lit(None).cast("int"))
    scored = score_cases(cases, goldens, runs.unionByName(nameless))
    found = {(r.run_id, r.uuid): r.reason for r in scored.collect()}
    assert len(found) == 51 * len(CASES)
    for (run, name), reason in found.items():
        assert reason == ("bad_json" if name == "same" and run and run % 2 == 0 else CASES[name][3]), (run, name)
    assert sizes["goldens"] == goldens.count() and sizes["facts"] == len(CASES) + 1
    assert sizes["answers"] == predictions.count() + 1


def test_runs_of_records_and_repeated_cases(spark, inputs):
    cases, goldens, predictions = inputs
    figures = figure_records(predictions, "figure_json")
    runs = figures.withColumn("run_id", F.explode(F.array(F.lit("a"), F.lit("b"))))
    twice = cases.unionByName(cases.where("uuid = 'same'"))
    scored = score_records(twice, goldens, runs)
    found = sorted((r.run_id, r.uuid, r.reason or "") for r in scored.collect())
    names = [*CASES, "same"]
    assert found == sorted((run, name, CASES[name][3] or "") for run in "ab" for name in names)
    assert score_records(cases, goldens, runs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="2 predictions for same"):
        score_records(cases, goldens, runs.unionByName(runs.where("uuid = 'same' and run_id = 'b'")))


def test_plain_arrays_are_compared_without_points(spark, monkeypatch):
    """Described and put in the form of comparison as they are stored; odd arrays have the
    verdicts of long ones."""
    from chartmeter.plans import scoring

    x = ['["a", "B", "a"]', '[0.0, -0.0e0, 1]', "[NaN, 1, 2]", "[9007199254740993, 1, 2]", '["a", null, 3]',
         "[null, true, 2.675]", '["ab", "b", ""]', "[]", '"abc"', "[1e3, 2, 3.001]", '[[1], 2, 3]', "[3, 1, 2]"]
    rows = [
        (f"{i} {j}", *['{"data": [{"type": "bar", "x": %s, "y": %s, "xaxis": "x", "yaxis": "y"}]}' % side for side in sides])
        for i, a in enumerate(x)
        for j, b in enumerate(x)
        for sides in [((a, x[-1]), (b, x[-1])), ((a, x[(i + 4) % 12]), (x[(i + 4) % 12], b))][(i + j) % 2 :][:1]
    ]
    df = spark.createDataFrame(rows, "uuid string, golden string, figure_json string").repartition(2)
    cases = df.select("uuid", F.lit(WITH).alias("complexity"))
    goldens = figure_records(df.select("uuid", "golden"), "golden").select("uuid", "record")
    kept = {}

    def seen(df, name, *args):
        kept[name] = stage(df, name, *args)
        return kept[name]

    def verdicts(short):
        monkeypatch.setattr(scoring, "SHORT", short)
        return {r.uuid: (r.reason, r.vacuous) for r in score_cases(cases, goldens, df.select("uuid", "figure_json")).collect()}

    monkeypatch.setattr(scoring, "stage", seen)
    found = verdicts(32)
    points = kept["goldens"].where("uuid = '11 11'").first()["g_points"]
    assert points["flat"]["x"]["n"] == [3.0, 1.0, 2.0] and points["pairs"]["xy"] is None
    assert found == verdicts(0) and len(set(found.values())) > 2


def test_shapes_are_found_by_compiled_code(spark):
    # functions of arrays are interpreted: a value's shape must not be looked up inside of one
    from chartmeter.plans.scoring import describe

    figures = spark.createDataFrame([("a", '{"data": [{"type": "bar", "x": [1]}]}')], "uuid string, figure_json string")
    described = describe(figure_records(figures, "figure_json"), "g")
    assert described.columns == ["uuid", "status", "g"]
    assert "schema_of_variant(" in str(described._jdf.queryExecution().analyzed())
    assert "schema_of_variant(lambda" not in str(described._jdf.queryExecution().analyzed())


def test_plain_arrays_settled_as_wholes(spark):
    said = [
        ('{"x": [1, 2], "y": [3.25, 4]}', '{"x": [1, 2], "y": [3.25, 4]}', None),
        ('{"x": [1, 2], "y": [3.25, 4]}', '{"x": [2, 1], "y": [4, 3.25]}', None),
        ('{"x": [1, 2], "y": [3.25, 4]}', '{"x": [1, 2], "y": [3.251, 4.004]}', None),
        ('{"x": [1, 2], "y": [3.25, 4]}', '{"x": [1, 2], "y": [3.26, 4]}', "data_mismatch"),
        ('{"x": [-0.0, 2], "y": [0, 4]}', '{"x": [0, 2], "y": [-0.0, 4]}', None),
        ('{"x": ["a", "b"], "y": [1, 2]}', '{"x": ["A", "xbx"], "y": [1, 2]}', None),
        ('{"x": ["a", "b"], "y": [1, 2]}', '{"x": [1, 2], "y": ["a", "b"]}', None),
        ('{"x": ["a", "b"], "y": [1, 2]}', '{"x": [1, 2], "y": [1, 2]}', "data_mismatch"),
        ('{"x": [], "y": [1]}', '{"x": ["a"], "y": ["b"]}', None),
        ('{"x": ["a"], "y": [1]}', '{"x": [], "y": []}', "data_mismatch"),
        ('{"x": ["a", 1], "y": [1, 2]}', '{"x": [1, "a"], "y": [2, 1]}', None),
        ('{"x": ["a", "a"], "y": [1, 2]}', '{"x": ["a"], "y": [2]}', None),
    ]

    def figures(side):
        head = '{"data": [{"type": "bar", "xaxis": "x", "yaxis": "y", '
        rows = [(str(i), head + one[side][1:] + "]}") for i, one in enumerate(said)]
        return spark.createDataFrame(rows, "uuid string, figure_json string")

    cases = figures(0).select("uuid", F.lit("WithPlotType").alias("complexity"))
    goldens = figure_records(figures(0), "figure_json").select("uuid", "record")
    found = {row.uuid: row.reason for row in score_cases(cases, goldens, figures(1)).collect()}
    assert found == {str(i): reason for i, (_, _, reason) in enumerate(said)}
