"""Matching rules as tables of what is asked, what is offered and the outcome, and random
points against the same rules in DuckDB."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from catalog.common import cents_sql
from chartmeter.functions import round_cents, tag_variant, values_match
from chartmeter.plans import matching, pairs_match, pairs_match_swapped, records_match, triples_match

VALUE = "struct<kind:string,num:double,str:string>"


def tag(value):
    """A tagged value; a list or an object is given as ("other", JSON)."""
    if isinstance(value, tuple):
        return (value[0], None, value[1])
    if value is None:
        return ("null", None, None)
    if isinstance(value, str):
        return ("str", None, value)
    exact = str(int(value)) if math.isfinite(value) and 2**53 <= abs(value) < 2**95 else None
    return ("num", float(value), exact)


def points(spark, cases, pair="xy"):
    rows = [
        (case, pair, pos, tag(k), tag(v))
        for case, listed in cases.items()
        for pos, (k, v) in enumerate(listed)
    ]
    return spark.createDataFrame(rows, f"case_id string, pair string, pos int, k {VALUE}, v {VALUE}")


def outcomes(df):
    return {row["case_id"]: row["matched"] for row in df.collect()}


# What JSON golden and predicted hold, and whether the second is accepted for the first.
RULES = {
    "numbers: equal to two decimals": [
        ("81.25", "81.25000001", True), ("7", "7.0", True), ("7", "8", False), ("0.555", "0.549", False),
        ("4.115", "4.12", True), ("-0.004", "0", True), ("1e300", "1e300", True), ("2e15", "2000000000000001", False),
    ],
    "numbers: ties follow the binary value, half to even": [
        ("0.625", "0.62", True), ("0.625", "0.63", False), ("0.875", "0.88", True), ("1.115", "1.11", True), ("1.115", "1.12", False),
        ("-8.345", "-8.35", True), ("-8.345", "-8.34", False),
    ],
    "numbers: integers are exact beyond doubles": [
        ("9007199254740993", "9007199254740992", False), ("9007199254740993", "9007199254740993", True),
        ("9007199254740992", "9007199254740992.0", True), ("1152921504606846976", "1.152921504606846976e18", True),
        ("36893488147419103232", "36893488147419103233", False), ("-9007199254740993", "-9007199254740992", False),
    ],
    "booleans: numbers": [("true", "1", True), ("0", "false", True), ("true", "2", False), ("true", '"true"', False)],
    "texts: the golden one occurs in the predicted one, in any case": [
        ('"kiwi"', '"Ripe KIWI fruit"', True), ('"Ripe kiwi"', '"kiwi"', False), ('""', '"plum"', True),
        ('"ÄPFEL"', '"äpfel"', True), ('"plum"', '""', False),
    ],
    "kinds: no text is a number, nothing is only nothing": [
        ('"7"', "7", False), ("7", '"7"', False), ("null", "null", True), ("null", "0", False), ('""', "null", False),
    ],
    "lists and objects: by value": [
        ("[1, true]", "[1.0, 1]", True), ("[1]", "[2]", False), ('{"a": 1, "b": [2e0]}', '{"b": [2], "a": 1}', True),
        ('["1"]', "[1]", False), ('{"a": null}', "{}", False), ('["x, 1.0"]', '["x, 1"]', False), ("[-0.0]", "[0]", True),
        ('["a\\"1.0"]', '["a\\"1"]', False), ("[9007199254740993]", "[9007199254740992]", False),
    ],
}


def test_rules(spark):
    rows = [(rule, *case) for rule, cases in RULES.items() for case in cases]
    df = spark.createDataFrame(rows, "rule string, g string, p string, expected boolean")
    match = values_match(tag_variant(F.parse_json("g")), tag_variant(F.parse_json("p")))
    assert [tuple(r) for r in df.where(~match.eqNullSafe(F.col("expected"))).collect()] == []


def test_rounding_follows_the_binary_value(spark):
    rng = random.Random(5)
    ties = [n / 1000 for n in range(-20005, 20006, 10)]
    wild = [rng.uniform(-1, 1) * 10 ** rng.randint(-4, 17) for _ in range(4000)]
    eighths = [n / 8 for n in range(-999, 1000)]
    near = [x for t in ties[::7] for x in (t * (1 + 2**-52), t * (1 - 2**-53))]
    large = [2.0**45 + n * 2.0**-7 for n in range(200)]
    values = ties + wild + eighths + near + large
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(round_cents(F.col("x"))).collect()]
    assert [v for v, g in zip(values, got) if g != round(v, 2)] == []


# Name of a case: golden points, predicted points, outcome.
PAIRS = {
    "every golden point is met, extra ones do not matter": ([("jan", 4), ("feb", 5)], [("feb", 5), ("mar", 1), ("jan", 4)], True),
    "one golden point is not met": ([("jan", 4), ("feb", 5)], [("jan", 4)], False),
    "the right value at the wrong key": ([("jan", 4), ("feb", 5)], [("jan", 5), ("feb", 4)], False),
    "one predicted point serves two golden ones": ([("a", 2), ("b", 2)], [("a or b", 2)], True),
    "key and value by containment": ([("lo", "hi")], [("LOW", "high")], True),
    "containment the wrong way round": ([("low", "hi")], [("lo", "high")], False),
    "a repeated golden key: the last one counts": ([("k", 1), ("k", 2)], [("k", 2)], True),
    "a repeated predicted key: the last one counts": ([("k", 1)], [("k", 1), ("k", 2)], False),
    "nothing asked": ([], [(1, 1)], True),
    "nothing offered": ([(1, 1)], [], False),
    "empty texts are in all texts": ([("", "")], [(5, 5), ("x", "y")], True),
    "empty texts are in no number": ([("", 1)], [(5, 1)], False),
    "nulls meet nulls": ([(None, 1), ("a", None)], [(None, 1), ("A", None)], True),
    "a null meets no text": ([(None, 1)], [("None", 1)], False),
    "rounded keys": ([(0.501, 1)], [(0.499, 1)], True),
    "neighbouring large keys stay two points": ([(2**53, 1), (2**53 + 1, 2)], [(2**53, 1), (2**53 + 1, 2)], True),
    "and both are needed": ([(2**53, 1), (2**53 + 1, 2)], [(2**53 + 1, 2)], False),
    "NaN meets nothing": ([(math.nan, 1)], [(math.nan, 1)], False),
    "NaN as a value": ([("a", math.nan)], [("a", math.nan)], False),
    "a predicted NaN under a used key": ([(1, "a")], [(1, "a"), (1, math.nan)], False),
}


@pytest.mark.parametrize("few", [64, 0])
def test_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(matching, "FEW", few)
    found = outcomes(
        pairs_match(points(spark, {n: c[0] for n, c in PAIRS.items()}), points(spark, {n: c[1] for n, c in PAIRS.items()}))
    )
    assert {name: found.get(name, True) for name in PAIRS} == {name: c[2] for name, c in PAIRS.items()}


def in_duckdb(golden, predicted):
    """Whether each case matches, trying all pairs of points in SQL."""
    db = duckdb.connect()
    for name, cases in (("g", golden), ("p", predicted)):
        db.execute(f"CREATE TABLE {name} (c VARCHAR, pos INT, kk VARCHAR, kn DOUBLE, ks VARCHAR, vk VARCHAR, vn DOUBLE, vs VARCHAR)")
        rows = [(c, i, *tag(k), *tag(v)) for c, listed in cases.items() for i, (k, v) in enumerate(listed)]
        db.executemany(f"INSERT INTO {name} VALUES (?, ?, ?, ?, ?, ?, ?, ?)", rows)
        db.execute(
            f"""CREATE TABLE {name}_last AS SELECT * FROM {name}
            QUALIFY row_number() OVER (PARTITION BY c, kk, kn + 0.0::DOUBLE, ks ORDER BY pos DESC) = 1"""
        )

    def met(x):
        number = f"{cents_sql(f'g.{x}n')} = {cents_sql(f'p.{x}n')}"
        text = f"contains(lower(p.{x}s), lower(g.{x}s))"
        return f"(g.{x}k = p.{x}k AND CASE g.{x}k WHEN 'num' THEN {number} WHEN 'str' THEN {text} ELSE TRUE END)"

    rows = db.execute(
        f"""SELECT c, bool_and(EXISTS (SELECT 1 FROM p_last p WHERE p.c = g.c AND {met("k")} AND {met("v")}))
        FROM g_last g GROUP BY c"""
    ).fetchall()
    return {c: True for c in golden} | dict(rows)


def check_cases(spark, golden, predicted):
    found = outcomes(pairs_match(points(spark, golden), points(spark, predicted)))
    expected = in_duckdb(golden, predicted)
    assert 0.1 < sum(expected.values()) / len(expected) < 0.9
    assert {case: found.get(case, True) for case in golden} == expected


def random_cases(seed, n_cases, n_points, longest):
    """Predicted points, and golden ones cut out of these or made up."""
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("xyÖ") for _ in range(n))

    def value():
        return rng.choice([text(rng.randint(0, longest)), text(rng.randint(1, longest)).upper(), rng.choice([3, 3.004, 4, -0.0, 0, 0.5]), None])

    def cut(v):
        if not isinstance(v, str) or not v:
            return v
        a = rng.randrange(len(v))
        return v[a : a + rng.randint(1, longest)]

    golden, predicted = {}, {}
    for case in map(str, range(n_cases)):
        predicted[case] = [(value(), value()) for _ in range(rng.randint(1, n_points))]
        last = list({k: v for k, v in predicted[case]}.items())
        golden[case] = [
            tuple(map(cut, rng.choice(last))) if rng.random() < 0.85 else (value(), value()) for _ in range(rng.randint(0, 4))
        ]
    return golden, predicted


@pytest.mark.parametrize("few", [64, 1, 0])
def test_random_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(matching, "FEW", few)
    check_cases(spark, *random_cases(few, 500, 8, 6))


@pytest.mark.parametrize("dense", [128, 5])
def test_random_long_strings_with_nothing_counted_as_small(spark, monkeypatch, dense):
    monkeypatch.setattr(matching, "FEW", 0)
    monkeypatch.setattr(matching, "DENSE", dense)
    monkeypatch.setattr(matching, "PIECE", 4)
    monkeypatch.setattr(matching, "CROWD", 2)
    monkeypatch.setattr(matching, "broadcast_if_small", lambda df: df)
    check_cases(spark, *random_cases(30, 300, 8, 14))


def test_one_case_with_most_points(spark):
    """One case holding nearly all points, all its strings alike but for their ends."""
    n = 20_000
    big = spark.range(n).select(
        F.lit(0).alias("case_id"), F.lit("xy").alias("pair"), F.col("id").cast("int").alias("pos"),
        F.struct(F.lit("str").alias("kind"), F.lit(None).cast("double").alias("num"),
                 F.concat(F.lit("a common start of every key "), F.col("id")).alias("str")).alias("k"),
        F.struct(F.lit("num").alias("kind"), F.lit(1.0).alias("num"), F.lit(None).cast("string").alias("str")).alias("v"),
    )
    longer = big.withColumn("k", F.col("k").withField("str", F.concat("k.str", F.lit("!"))))
    assert outcomes(pairs_match(big, longer)) == {0: True}
    assert outcomes(pairs_match(longer, big)) == {0: False}


@pytest.mark.parametrize("dense", [128, 0])
def test_a_block_is_shared_wherever_a_text_lies(spark, monkeypatch, dense):
    """Golden texts of many lengths at every place of longer predicted ones, with no other way
    to be found."""
    monkeypatch.setattr(matching, "FEW", 0)
    monkeypatch.setattr(matching, "DENSE", dense)
    rng = random.Random(7)
    golden, predicted = {}, {}
    for length in (1, 2, 3, 6, 7, 14, 15, 30, 31, 62, 63, 64, 130):
        letters = "".join(rng.choice("abcdefgh𝄞é\n") for _ in range(length))
        for i in range(66):
            golden[f"{length} at {i}"] = [(letters, 1)]
            predicted[f"{length} at {i}"] = [("-" * i + letters + "+" * rng.randint(0, 99), 1)]
    assert set(outcomes(pairs_match(points(spark, golden), points(spark, predicted))).values()) == {True}


def test_golden_and_predicted_texts_of_one_template_meet_in_cells(spark, monkeypatch):
    """Texts of a hundred kinds that differ outside all windows: every one has the common hash."""
    monkeypatch.setattr(matching, "CROWD", 16)
    monkeypatch.setattr(matching, "DENSE", 0)
    golden = {"c": [("s" * 300 + f"{i:03}" + "e" * 17, 1) for i in range(100)]}
    predicted = {"c": [("<" + k + ">", 1) for k, _ in golden["c"]]}
    seen = []
    cells = matching._met_in_cells

    def looked_at(golden, predicted, chosen, hits):
        seen.append(chosen.groupBy("h").count().agg(F.max("count")).first()[0])
        return cells(golden, predicted, chosen, hits)

    monkeypatch.setattr(matching, "_met_in_cells", looked_at)
    assert outcomes(pairs_match(points(spark, golden), points(spark, predicted))) == {"c": True}
    assert seen[0] > 16
    predicted["c"][5] = ("other", 1)
    assert outcomes(pairs_match(points(spark, golden), points(spark, predicted))) == {"c": False}


def test_exchanged_axes(spark):
    golden = {"turned": [("low", 1), ("high", 2)], "not turned": [("low", 1)]}
    predicted = {"turned": [(2, "highest"), (1, "lowest")], "not turned": [("low", 1)]}
    found = pairs_match_swapped(points(spark, golden), points(spark, predicted))
    assert outcomes(found) == {"turned": True, "not turned": False}


def test_a_list_is_no_key(spark):
    df = points(spark, {"as key": [(("other", "[5]"), 1)], "as value": [(1, ("other", "[5]"))]})
    found = {r["case_id"]: (r["bad_keys"], r["matched"]) for r in pairs_match(df, df).collect()}
    assert found == {"as key": (True, False), "as value": (False, True)}


# Name of a case: golden record, predicted record, outcome.
RECORDS = {
    "same keys, accepted values": ({"size": 2.004, "name": "fir"}, {"name": "Silver FIR", "size": 2}, True),
    "a value too many": ({"size": 2}, {"size": 2, "name": "fir"}, False),
    "a value too few": ({"size": 2, "name": "fir"}, {"size": 2}, False),
    "another key": ({"size": 2}, {"Size": 2}, False),
    "a value not accepted": ({"size": 2, "name": "silver fir"}, {"size": 2, "name": "fir"}, False),
    "null for null": ({"size": None}, {"size": None}, True),
}


def test_records(spark):
    def keyed(side):
        rows = [(name, tag(k), tag(v)) for name, case in RECORDS.items() for k, v in case[side].items()]
        return spark.createDataFrame(rows, f"case_id string, k {VALUE}, v {VALUE}")

    assert outcomes(records_match(keyed(0), keyed(1))) == {name: case[2] for name, case in RECORDS.items()}


# Name of a case: golden (key, key, value) points, predicted ones, outcome.
TRIPLES = {
    "in any order": ([(10, 20, 1), (11, 21, "sea")], [(11, 21, "North Sea"), (10, 20, 1.001)], True),
    "keys are not rounded": ([(10.001, 20, 1)], [(10.002, 20, 1)], False),
    "key texts are exact": ([("n", "e", 1)], [("N", "e", 1)], False),
    "a point too many": ([(10, 20, 1)], [(10, 20, 1), (10, 21, 1)], False),
    "a null in a key": ([(10, None, 1)], [(10, None, 1)], True),
    "the last of a repeated key": ([(10, 20, 1), (10, 20, 2)], [(10, 20, 2)], True),
    "large keys are exact": ([(2**53 + 1, 0, 1)], [(2**53, 0, 1)], False),
    "NaN meets nothing": ([(math.nan, 0, 1)], [(math.nan, 0, 1)], False),
}


def test_triples(spark):
    def placed(side):
        rows = [(name, i, *map(tag, t)) for name, case in TRIPLES.items() for i, t in enumerate(case[side])]
        return spark.createDataFrame(rows, f"case_id string, pos int, k1 {VALUE}, k2 {VALUE}, v {VALUE}")

    assert outcomes(triples_match(placed(0), placed(1))) == {name: case[2] for name, case in TRIPLES.items()}


@pytest.mark.parametrize(("hits", "dense", "slack"), [(0, 128, 1024), (0, 5, 1024), (16, 5, 2), (16, 0, 1024)])
def test_random_strings_by_pairs_and_in_cells(spark, monkeypatch, hits, dense, slack):
    """Long strings as digests, as texts that come to the pairs, and in cells."""
    monkeypatch.setattr(matching, "FEW", 0 if hits == 0 else 2)
    monkeypatch.setattr(matching, "HITS", hits)
    monkeypatch.setattr(matching, "PAIRS", 0)
    monkeypatch.setattr(matching, "DENSE", dense)
    monkeypatch.setattr(matching, "SLACK", slack)
    monkeypatch.setattr(matching, "PIECE", 4)
    check_cases(spark, *random_cases(31, 200, 8, 14))


def test_points_are_told_apart_without_their_texts(spark):
    """What is stored of a point, and of the pairs to be tried, holds no long text."""
    rng = random.Random(3)
    golden = {"c": [(f"item {i}", "".join(rng.choice("abcdefgh ") for _ in range(3000))) for i in range(100)]}
    predicted = {"c": [(f"the {k}.", "> " + v) for k, v in golden["c"]]}
    stored = []
    stage = matching.stage

    def weighed(df, name, *args):
        kept = stage(df, name, *args)
        stored.append((name, kept.select(F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)) / 200).first()[0]))
        return kept

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(matching, "stage", weighed)
        assert outcomes(pairs_match(points(spark, golden), points(spark, predicted))) == {"c": True}
    # blocks of long texts are not asked for where the short keys tell the points apart
    assert [name for name, size in stored if size > 1000] == []
    predicted["c"][7] = ("the item 7.", "> " + golden["c"][7][1][1:])
    assert outcomes(pairs_match(points(spark, golden), points(spark, predicted))) == {"c": False}
