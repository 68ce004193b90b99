import hashlib
import json

import pytest
from pyspark.sql import functions as F

from chartmeter.plans import FIGURE_KEYS, figure_records
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

ROWS = [
    ("http://x/autos.csv", "WithPlotType", "Box plot of é"),
    ("http://x/autos.csv", "WithoutPlotType", "Trend"),
    ("http://x/bikes.csv", "WithPlotType", "Bars"),
]


@pytest.fixture
def cases(spark):
    return build_cases(spark.createDataFrame(ROWS, "dataset string, complexity string, description string"))


def test_case_rows(cases):
    rows = cases.collect()
    assert [r.uuid for r in rows] == [hashlib.md5((d + t).encode()).hexdigest() for d, _, t in ROWS]
    assert {r.language for r in rows} == {"English"}


def test_unknown_datasets_and_levels_are_errors(spark):
    df = spark.createDataFrame(ROWS, "dataset string, complexity string, description string")
    assert build_cases(df, ["autos.csv", "bikes.csv"]).count() == 3
    with pytest.raises(Exception, match="bikes.csv"):
        build_cases(df, ["autos.csv"]).collect()
    with pytest.raises(Exception, match="Sometimes"):
        build_cases(df.withColumn("complexity", F.lit("Sometimes"))).collect()


def test_filters(cases):
    assert filter_cases(cases).count() == 3
    assert filter_cases(cases, dataset="", complexity="WithPlotType").count() == 2
    assert filter_cases(cases, dataset="http://x/autos.csv", complexity="WithPlotType").count() == 1
    assert filter_cases(cases, uuid="none").count() == 0


def test_summary(cases):
    rows = {(r.dataset, r.is_total): tuple(r)[2:] for r in corpus_summary(cases).collect()}
    assert rows == {
        ("http://x/autos.csv", False): (2, 1, 1),
        ("http://x/bikes.csv", False): (1, 1, 0),
        (None, True): (3, 2, 1),
    }


def test_case_files_keep_other_datasets(spark, cases, tmp_path):
    path = str(tmp_path / "cases")
    write_cases(cases, path, "train")
    write_cases(cases.where("description = 'Trend'"), path, "train")
    write_cases(cases.where("description = 'Bars'"), path, "test")
    back = read_cases(spark, path, lines=True)
    assert sorted(r.description for r in back.collect()) == ["Bars", "Bars", "Trend"]
    assert {r.dataset for r in back.collect()} == {"http://x/autos.csv", "http://x/bikes.csv"}


def test_array_files(spark, tmp_path):
    file = tmp_path / "cases.json"
    record = dict(uuid="u", dataset="d", language="English", complexity="WithPlotType", description="t")
    file.write_text(json.dumps([record, {**record, "uuid": "v"}], indent=4))
    assert [r.uuid for r in read_cases(spark, str(file)).collect()] == ["u", "v"]


def test_readers_tell_the_layout_and_lose_nothing(spark, cases, tmp_path):
    write_cases(cases, str(tmp_path / "written"), "train")
    assert read_cases(spark, str(tmp_path / "written")).count() == 3
    record = dict(uuid="u", dataset="d", language="English", complexity="WithPlotType", description="t")
    files = {
        "one array a line": f"[{json.dumps(record)}, {json.dumps(record)}]\n[{json.dumps(record)}]\n",
        "objects": f"\n  {json.dumps(record)}\n\n{json.dumps(record)}\n{json.dumps(record)}",
        "array": json.dumps([record] * 3, indent=2),
    }
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
        assert read_cases(spark, str(tmp_path / f"{name}.json")).count() == 3, name
    (tmp_path / "broken.json").write_text(json.dumps(record) + "\n{'uuid': 1\n")
    with pytest.raises(Exception, match="no JSON record"):
        read_cases(spark, str(tmp_path / "broken.json")).collect()
    with pytest.raises(ValueError, match="read them apart"):
        read_cases(spark, [str(tmp_path / "array.json"), str(tmp_path / "objects.json")])


def test_last_golden_wins(spark, tmp_path):
    def record(uuid, kind, **more):
        return {"uuid": uuid, "plot_json": {"data": {"type": kind, **more}}}

    many = [record("a", f"v{i}") for i in range(200)]
    array = [record("a", "bar"), record("b", "pie", x=None), *many, record("c", "box"), {"uuid": "c"}]
    file = tmp_path / "goldens.json"
    file.write_text(json.dumps(array, indent=4))
    kind = F.try_variant_get(F.try_element_at("record", F.lit("type")), "$", "string")
    expected = {"a": "v199", "b": "pie", "c": None}
    rows = read_goldens(spark, str(file)).select("uuid", kind.alias("kind")).collect()
    assert {r.uuid: r.kind for r in rows} == expected
    lines = tmp_path / "goldens.jsonl"
    lines.write_text("\n".join(json.dumps(r) for r in array))
    rows = read_goldens(spark, str(lines), lines=True).select("uuid", kind.alias("kind")).collect()
    assert {r.uuid: r.kind for r in rows} == expected


def test_goldens_round_trip(spark, tmp_path):
    figure = '{"data":[{"type":"pie","labels":["a",1,null],"values":[1.5,2,true],"name":"x","domain":{"x":[0,1]}}]}'
    df = spark.createDataFrame([("u", "d", figure)], "uuid string, dataset string, figure string")
    records = figure_records(df, "figure", FIGURE_KEYS).select("uuid", "dataset", "record")
    path = str(tmp_path / "goldens")
    write_goldens(records, path, "train")
    back = read_goldens(spark, path, lines=True).select(F.to_json("record").alias("r")).first().r
    assert json.loads(back) == {
        "type": "pie", "labels": ["a", 1, None], "values": [1.5, 2, True], "domain": {"x": [0, 1]},
    }


def test_csv(spark, tmp_path):
    file = tmp_path / "peaks.csv"
    file.write_bytes('name,elev,note\nÉtna,3350,"a ""b"", c"\nNone,,\n'.encode("iso-8859-1"))
    rows = read_source(spark, str(file), encoding="ISO-8859-1").collect()
    assert [tuple(r) for r in rows] == [("Étna", 3350, 'a "b", c'), (None, None, None)]
    kept = read_source(spark, str(file), encoding="ISO-8859-1", null_values=("",)).collect()
    assert kept[1].name == "None"
    typed = read_source(spark, str(file), "ISO-8859-1", "name string, elev double, note string")
    assert typed.first().elev == 3350.0


# A column's values, and the type it gets.
COLUMNS = [
    (["1", "-2", "+3", " 4 "], "int"), (["1", "3000000000"], "bigint"), (["1", "9" * 30], "decimal(38,0)"), (["1", "9" * 50], "string"),
    (["1", "2.5", ".5", "1e3", "-inf"], "double"), (["2.5", "9007199254740993"], "string"), (["2.5", "9007199254740992"], "double"),
    (["12D", "14F"], "string"), (["1f", "2d"], "string"), (["0x1F", "1"], "string"), (["1_000", "2"], "string"),
    (["2020-01-31", "2020-02-01"], "date"), (["2020-01", "2020-02"], "string"), (["2020", "2021"], "int"), (["2020-02-30"], "string"),
    (["2020-01-31 10:00", "2020-01-31T10:00:01.5Z", "2020-01-31"], "string"), (["2020-01-31 10:00", "2020-01-31T10:00:01.5Z"], "timestamp"),
    (["true", "False"], "boolean"), (["yes", "no"], "string"), (["NA", "7", ""], "int"), (["NA", ""], "string"),
]


def test_csv_types_are_those_all_values_are_spelled_in(spark, tmp_path):
    most = max(len(values) for values, _ in COLUMNS)
    lines = [",".join(f"c{i}" for i in range(len(COLUMNS)))]
    lines += [",".join(v[k] if k < len(v) else "" for v, _ in COLUMNS) for k in range(most)]
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    read = read_source(spark, str(tmp_path / "t.csv"))
    assert [t for _, t in read.dtypes] == [t for _, t in COLUMNS]
    rows = read.collect()
    for i, (values, kind) in enumerate(COLUMNS):
        if kind == "string":
            assert [r[i] for r in rows][: len(values)] == [None if v in ("NA", "") else v for v in values]


def test_csv_misfits_are_told(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,2.5\nx2,7\n3,9D\n,\n")
    path, schema = str(tmp_path / "t.csv"), "a int, b double"
    assert [tuple(r) for r in count_misfits(spark, path, schema).collect()] == [("a", 1, "x2"), ("b", 1, "9D")]
    with pytest.raises(Exception, match="no int in column a: x2"):
        read_source(spark, path, schema=schema).collect()
    kept = read_source(spark, path, schema=schema, misfits="null").collect()
    assert [tuple(r) for r in kept] == [(1, 2.5), (None, 7.0), (3, None), (None, None)]
    with pytest.raises(ValueError):
        read_source(spark, path, misfits="drop")
