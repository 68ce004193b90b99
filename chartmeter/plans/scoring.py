"""Verdicts on predicted chart records, pass rates and failure reports.

Intermediate outcomes are one of ``T`` (true), ``V`` (true, but no data was
compared), ``F`` (false) and ``E`` (an error, which fails the case whatever else
holds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmeter.functions.values import canonical_json, flat_elements, let, plain_elements, round_cents, tagged_elements
from chartmeter.plans.figures import (
    PAIRS,
    elements,
    explode_points,
    explode_triples,
    field,
    figure_records,
)
from chartmeter.plans.matching import (
    flat_match_in_row,
    flat_points,
    pairs_match,
    pairs_match_in_row,
    pairs_match_swapped,
    points_in_row,
    triples_match,
    triples_match_in_row,
)
from chartmeter.shared import broadcast_if_small, stage
from chartmeter.sources.corpus import WITHOUT_TYPE

# Chart types, the pair of arrays each is drawn from, and the
# further keys that have to be equal.
CHART_TYPES = {
    "scatter": ("xy", ["xaxis", "yaxis", "type"]),
    "bar": ("xy", ["xaxis", "yaxis", "type"]),
    "histogram": ("xy", ["xaxis", "yaxis", "type"]),
    "box": ("xy", ["xaxis", "yaxis", "type"]),
    "histogram2d": ("xy", ["xbingroup", "ybingroup", "xaxis", "yaxis", "type"]),
    "histogram2dcontour": ("xy", ["xaxis", "yaxis", "type"]),
    "scattergl": ("xy", ["xaxis", "yaxis", "type"]),
    "scattergeo": ("latlon", ["type"]),
    "pie": ("labelsvalues", ["domain", "type"]),
    "densitymapbox": ("latlon", ["subplot", "type"]),
}

_ARRAYS = ["x", "y", "lat", "lon", "z", "labels", "values"]
_ATTRIBUTES = ["type", "xaxis", "yaxis", "xbingroup", "ybingroup", "subplot", "domain"]
_FIGURES_PER_FILE = 20_000
#: Arrays up to this length are compared inside their case's row.
SHORT = 32


def _has(side: str, key: str) -> Column:
    """State of an array of the golden (``g``) or predicted (``p``) record of a row."""
    return F.col(f"{side}.has.{key}")


def _is(side: str, key: str) -> Column:
    """Attribute of the golden (``g``) or predicted (``p``) record of a row."""
    return F.col(f"{side}.is.{key}")


def with_source(facts: DataFrame) -> DataFrame:
    """Add ``source``: the pair of arrays that the golden type is drawn from, NULL for an
    unknown type."""
    kinds = " ".join(f"WHEN '\"{name}\"' THEN '{pair}'" for name, (pair, _) in CHART_TYPES.items())
    return facts.withColumn("source", F.expr(f"CASE g.is.type {kinds} END"))


def _all_of(conditions: list[Column]) -> Column:
    met = F.lit(True)
    for condition in conditions:
        met = met & condition
    return met


def _listed(*keys: str) -> Column:
    """Whether both records hold all these arrays."""
    listed = F.lit(True)
    for key in keys:
        listed = listed & (_has("g", key) == "list") & (_has("p", key) == "list")
    return listed


def _state(value: Column, shape: Column) -> Column:
    """``none`` (missing or null), ``list`` (can be iterated over) or ``bad``."""
    return (
        F.when(value.isNull() | (shape == "VOID"), "none")
        .when(shape.rlike("^(ARRAY|STRING)"), "list")
        .otherwise("bad")
    )


def _attribute(value: Column, shape: Column) -> Column:
    """Text that is equal for equal values, whatever they hold; NULL only where the key is
    missing."""
    # a string is equal to no other value's JSON, which needs to have its tokens looked at
    text = F.concat(F.lit('"'), F.try_variant_get(value, "$", "string"), F.lit('"'))
    other = canonical_json(F.to_json(value))
    return F.when(value.isNotNull(), F.when(shape == "STRING", text).otherwise(other))


def _value(key: str) -> Column:
    """Value of a key of a row's record, once ``_laid_out`` has been called."""
    return F.col(f"_value_{key}")


def _shape(key: str) -> Column:
    return F.col(f"_shape_{key}")


def _laid_out(records: DataFrame) -> DataFrame:
    """Add the values of ``record`` that a verdict needs and their shapes, in columns of their
    own: each is worked out once, and by compiled code, which what is inside the functions of
    arrays is not."""
    keys = [*_ARRAYS, *_ATTRIBUTES]
    records = records.withColumns({f"_value_{key}": field(F.col("record"), key) for key in keys})
    return records.withColumns({f"_shape_{key}": F.schema_of_variant(_value(key)) for key in keys})


def _without(records: DataFrame) -> DataFrame:
    """Drop the columns that were added on the way."""
    return records.select(*[c for c in records.columns if not c.startswith(("_value_", "_shape_", "_plain_", "_flat_", "_points_"))])


def describe(records: DataFrame, name: str) -> DataFrame:
    """Replace ``record`` by struct ``name``: what a verdict needs besides its points."""
    return _without(_laid_out(records).withColumn(name, _described())).drop("record")


def _described() -> Column:
    """``has``, the states of the arrays, and ``is``, the attributes, of a record."""
    has = F.struct(*[_state(_value(key), _shape(key)).alias(key) for key in _ARRAYS])
    attributes = F.struct(*[_attribute(_value(key), _shape(key)).alias(key) for key in _ATTRIBUTES])
    return F.struct(has.alias("has"), attributes.alias("is"))


def _short_points(records: DataFrame, name: str, turned: bool) -> DataFrame:
    """Add struct ``name``: what the data of ``record`` (``_laid_out``) is compared by inside a
    row. ``flat`` has its plain arrays (``flat_elements``), by key; pairs of arrays that are not
    both plain, or whose keys repeat, have points, also with axes exchanged if that is asked for
    (``turned``). NULL where an array is longer than SHORT; ``size`` is the longest's."""

    def of(key: str) -> Column:
        return F.col(f"_flat_{key}")

    def asked(k: str, v: str) -> Column:
        plain = of(k)["flat"].isNotNull() & of(v)["flat"].isNotNull() & of(k)["alone"]
        return ~F.coalesce(plain, F.lit(False)) & short(k, v)

    def short(*keys: str) -> Column:
        return _all_of([of(key)["size"] <= SHORT for key in keys])

    def values(wanted: Column, *keys: str) -> Column:
        return F.when(wanted, F.array(*map(_value, keys)))

    def points(n: int, wanted: list[Column]) -> Column:
        """Spelled out once, as it is a large expression; NULL for those not wanted."""

        def tagged(arrays: Column) -> Column:
            all = F.transform(arrays, lambda v: tagged_elements(elements(v)))
            return F.when(arrays.isNotNull(), let(all, lambda t: points_in_row(*[t[i] for i in range(n)])))

        return F.transform(F.array(*wanted), tagged)

    sides = [*PAIRS.values(), *([("y", "x")] if turned else [])]
    names = [*PAIRS, "yx"][: len(sides)]
    triple = "lat", "lon", "z"
    records = records.withColumns({f"_plain_{key}": plain_elements(_value(key), _shape(key)) for key in _ARRAYS})
    records = records.withColumns(
        {f"_flat_{key}": flat_elements(F.col(f"_plain_{key}"), _value(key), _shape(key), elements(_value(key)), SHORT) for key in _ARRAYS}
    )
    straight, maps = F.col("_points_straight"), F.col("_points_map")
    return records.withColumns(
        {
            "_points_straight": points(2, [values(asked(k, v), k, v) for k, v in sides]),
            "_points_map": points(3, [values(short(*triple), *triple)]),
        }
    ).withColumn(
        name,
        F.struct(
            F.greatest(*[of(key)["size"] for key in _ARRAYS]).alias("size"),
            F.struct(*[of(key)["flat"].alias(key) for key in _ARRAYS]).alias("flat"),
            F.struct(*[straight[i].alias(pair) for i, pair in enumerate(names)]).alias("pairs"),
            maps[0].alias("map"),
        ),
    )


def type_match() -> Column:
    """Predicted type against golden type; an error where there is none."""
    golden, predicted = _is("g", "type"), _is("p", "type")
    return F.when(golden.isNull() | predicted.isNull(), "E").when(golden == predicted, "T").otherwise("F")


def _same(golden: tuple[str, str], predicted: tuple[str, str], data: Column) -> Column:
    gk, gv = (_has("g", key) for key in golden)
    pk, pv = (_has("p", key) for key in predicted)
    all_lists = (gk == "list") & (gv == "list") & (pk == "list") & (pv == "list")
    return (
        F.when((gk == "none") & (pk != "none"), "F")
        .when((gv == "none") & (pv != "none"), "F")
        .when((gk == "none") | (gv == "none"), "V")
        .when(all_lists, F.coalesce(data, F.lit("T")))
        .otherwise("E")
    )


def fields_match(pair: str, data: Column, swapped: Column | None = None) -> Column:
    """Outcome for one pair of arrays, given the outcome of comparing their data.

    The pair is compared if the golden type is drawn from it. x and y are tried
    the other way round as well, then whatever the type.
    """
    direct = F.when(F.col("source") == pair, _same(PAIRS[pair], PAIRS[pair], data)).otherwise("F")
    if pair != "xy":
        return direct
    other = _same(("x", "y"), ("y", "x"), F.lit("T") if swapped is None else swapped)
    return F.coalesce(F.nullif(direct, F.lit("F")), other)


def standard_fields_match(outcomes: list[Column]) -> Column:
    """Any pair will do, but an error in one outweighs a match in another."""
    unknown = F.col("source").isNull()

    def any_is(outcome: str) -> Column:
        return F.greatest(*[o == outcome for o in outcomes])

    return (
        F.when(unknown | any_is("E"), "E").when(any_is("T"), "T").when(any_is("V"), "V").otherwise("F")
    )


def extra_fields_match() -> Column:
    """Further keys of the golden type: in the predicted record, and equal."""
    by_keys: dict[tuple[str, ...], list[str]] = {}
    for name, (_, keys) in CHART_TYPES.items():
        by_keys.setdefault(tuple(keys), []).append(name)
    result = F.lit("T")
    for keys, names in by_keys.items():
        failures = []
        for key in keys:
            g, p = _is("g", key), _is("p", key)
            failures.append(F.when(p.isNull(), "F").when(g.isNull(), "E").when(g != p, "F"))
        of_type = _is("g", "type").isin(*[f'"{name}"' for name in names])
        result = F.when(of_type, F.coalesce(*failures, F.lit("T"))).otherwise(result)
    return result


def score_records(
    cases: DataFrame, goldens: DataFrame, predictions: DataFrame, strict: bool = False
) -> DataFrame:
    """Add ``pass``, ``reason`` (of a failure) and ``vacuous`` to each case.

    cases: uuid, complexity and any more; goldens: uuid, record; predictions: uuid, status,
    record and, if there are several runs, run_id: then each case has a row per run, with
    the run's id. Two goldens for a uuid, or two predictions for one in a run, are an error.
    ``vacuous`` marks a pass for which no data was compared; ``strict`` fails it.
    """
    if "run_id" in predictions.columns:
        kept = predictions.select("run_id", "uuid", "status", "record", F.lit(None).cast("string").alias("told"))
        each, answers = _by_answer(cases, kept)
        return _score_runs(each, goldens, answers, strict)
    return _score(cases.select("uuid", F.struct("*").alias("case")), goldens, predictions, strict)


def _score_runs(each: DataFrame, goldens: DataFrame, answers: DataFrame, strict: bool) -> DataFrame:
    """``_score`` of cases of many runs: what a case asks of an answer is settled once."""
    asked = F.to_json(F.array("golden", "uuid", F.col("case.complexity").cast("string"))).alias("asked")
    each = stage(each.select("*", asked), "each")
    once = each.select("uuid", "golden", F.struct("asked", "case.complexity").alias("case")).distinct()
    scored = _score(once, goldens, answers, strict).select("asked", "pass", "reason", "vacuous")
    return stage(each.select("asked", "case").join(scored, "asked").select("case.*", "pass", "reason", "vacuous"), "runs")


def _score(cases: DataFrame, goldens: DataFrame, answers: DataFrame, strict: bool) -> DataFrame:
    """Scores of cases (uuid, case): ``uuid`` is that among ``answers`` (uuid, status, record), of
    which each is compared once, and that among ``goldens`` unless a column ``golden`` names it."""
    # read, parsed and put in the form of comparison once; what follows goes over the stored rows
    # several times. The arrays themselves are read again where they are long only.
    name = "golden" if "golden" in cases.columns else "uuid"
    def prepared(records: DataFrame, side: str) -> DataFrame:
        arrays = F.map_filter("record", lambda key, _: key.isin(*_ARRAYS))
        points = _short_points(_laid_out(records).withColumn(side, _described()), f"{side}_points", side == "p")
        return _without(points.withColumn("record", arrays))

    known = goldens.select(F.col("uuid").alias(name), F.col("record").isNotNull().alias("golden_ok"), "record")
    given = answers.select("uuid", "status", "record")
    goldens = stage(prepared(known, "g"), "goldens", _FIGURES_PER_FILE)
    answers = stage(prepared(given, "p"), "answers", _FIGURES_PER_FILE)
    _one_each(goldens, [name], "golden")
    _one_each(answers, ["uuid"], "prediction")
    facts = cases.join(goldens.drop("record"), name, "left").join(answers.drop("record"), "uuid", "left")
    facts = facts if name == "golden" else facts.withColumn("golden", F.col("uuid"))
    facts = stage(_in_rows(with_source(facts)), "facts")
    long = stage(_usable(facts).where("not short").select("uuid", "golden", "source", "g", "p").distinct(), "long")
    if not long.isEmpty():
        goldens = goldens.select(F.col(name).alias("golden"), "record")
        for outcomes, pairs in _by_points(long, goldens, answers.select("uuid", "record")):
            facts = _with_outcomes(facts, outcomes, pairs)
    return stage(_verdicts(facts, strict), "scored")


def _usable(facts: DataFrame) -> DataFrame:
    """Cases with a golden record and one to compare with it."""
    return facts.where((F.col("status") == "ok") & F.col("golden_ok"))


def _in_rows(facts: DataFrame) -> DataFrame:
    """Replace ``g_points`` and ``p_points`` by the outcomes of all comparisons of data for
    answers where all arrays are short. ``short`` tells these answers."""
    g, p = F.col("g_points"), F.col("p_points")
    facts = facts.withColumn("short", F.greatest(g["size"], p["size"]) <= SHORT)

    def arrays(golden: tuple[str, str], predicted: tuple[str, str]) -> list[Column]:
        return [g["flat"][golden[0]], g["flat"][golden[1]], p["flat"][predicted[0]], p["flat"][predicted[1]]]

    def points(pair: str) -> tuple[Column, Column]:
        return g["pairs"]["xy" if pair == "yx" else pair], p["pairs"][pair]

    def plain(pair: str, *sides: tuple[str, str]) -> Column:
        """Outcome of arrays that are all plain; NULL for others."""
        mine, theirs = points(pair)
        found = [array.isNotNull() for array in arrays(*sides)]
        return F.when(_all_of([*found, mine.isNull(), theirs.isNull()]), flat_match_in_row(*arrays(*sides)))

    def asked(pair: str, *sides: tuple[str, str]) -> Column:
        """What arrays with others among them are compared by; NULL where a side has none."""
        mine, theirs = points(pair)
        gk, gv, pk, pv = arrays(*sides)
        there = (mine.isNotNull() | (gk.isNotNull() & gv.isNotNull())) & (theirs.isNotNull() | (pk.isNotNull() & pv.isNotNull()))
        columns = {"gk": gk, "gv": gv, "pk": pk, "pv": pv, "g": mine, "p": theirs}
        wanted = F.col("short") & there & F.col(f"plain_{pair}").isNull()
        return F.when(wanted, F.struct(*[column.alias(name) for name, column in columns.items()]))

    def outcomes(compared: list[Column]) -> Column:
        """The comparison is spelled out once, for all pairs: it is a large expression."""

        def one(c: Column) -> Column:
            golden = F.coalesce(c["g"], flat_points(c["gk"], c["gv"]))
            predicted = F.coalesce(c["p"], flat_points(c["pk"], c["pv"]))
            general = let(F.struct(golden.alias("g"), predicted.alias("p")), lambda x: pairs_match_in_row(x["g"], x["p"]))
            return F.when(c.isNotNull(), general)

        return F.transform(F.array(*compared), one)

    turned = "yx", ("x", "y"), ("y", "x")
    facts = facts.withColumns({f"plain_{pair}": plain(pair, keys, keys) for pair, keys in PAIRS.items()})
    facts = facts.withColumn("general", outcomes([asked(pair, keys, keys) for pair, keys in PAIRS.items()]))
    found = {pair: F.coalesce(f"plain_{pair}", F.col("general")[i]) for i, pair in enumerate(PAIRS)}
    data = {f"data_{pair}": F.when(F.col("short"), outcome) for pair, outcome in found.items()}
    facts = facts.withColumns(data)
    again = F.col("short") & ~F.col("data_xy").eqNullSafe(F.lit("T"))
    facts = facts.withColumn("plain_yx", F.when(again, plain(*turned)))
    data = {"data_yx": F.when(again, F.coalesce("plain_yx", outcomes([F.when(again, asked(*turned))])[0]))}
    both = F.col("short") & g["map"].isNotNull() & p["map"].isNotNull()
    data["data_map"] = F.when(both, triples_match_in_row(g["map"], p["map"]))
    facts = facts.withColumns(data).drop("g_points", "p_points", "general", "plain_yx")
    return facts.drop(*[f"plain_{pair}" for pair in PAIRS])


def _by_points(long: DataFrame, goldens: DataFrame, answers: DataFrame):
    """Outcomes of answers with long arrays, by joins of their points, and their pairs."""

    def sides(chosen: DataFrame, explode, *args) -> tuple[DataFrame, DataFrame]:
        side = broadcast_if_small(chosen)
        mine = goldens.join(side, "golden").select("uuid", "record")
        theirs = answers.join(side.select("uuid"), "uuid", "left_semi")
        return explode(mine, "uuid", *args), explode(theirs, "uuid", *args)

    direct = pairs_match(*sides(long.select("uuid", "golden"), explode_points))
    direct = stage(_outcomes(direct), "direct")
    yield direct, list(PAIRS)

    # exchanged axes, for the answers that x and y as they are did not settle
    settled = direct.where("pair = 'xy' and outcome <> 'F'").select("uuid")
    again = long.where(_listed("x", "y")).select("uuid", "golden").join(settled, "uuid", "left_anti")
    again = stage(again, "again")
    if not again.isEmpty():
        swapped = pairs_match_swapped(*sides(again, explode_points, ["xy"]))
        yield _outcomes(swapped).withColumn("pair", F.lit("yx")), ["yx"]

    maps = long.where((_is("g", "type") == '"densitymapbox"') & _listed("lat", "lon", "z"))
    maps = stage(maps.select("uuid", "golden"), "maps")
    if not maps.isEmpty():
        triples = triples_match(*sides(maps, explode_triples))
        yield _outcomes(triples.withColumn("pair", F.lit("map"))), ["map"]


def _one_each(records: DataFrame, keys: list[str], what: str) -> None:
    *_, uuid = keys
    again = records.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1).where(F.col(uuid).isNotNull())
    again = again.first()
    if again:
        raise ValueError(f"{again.n} {what}s for {again[uuid]}")


def _by_answer(cases: DataFrame, predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases per run, as ``_score`` takes them, and the different answers of all runs.

    predictions: run_id, uuid, told and any more. Those of one uuid with the same ``told``
    are one answer, however many runs give it; one without is an answer of its own.
    """
    run = F.to_json(F.array(F.col("run_id").cast("string"))).alias("run")
    # the row numbers are written, so they stay what they are
    read = stage(predictions.withColumns({"run": run, "row": F.monotonically_increasing_id()}), "read", _FIGURES_PER_FILE)
    _one_each(read, ["run", "uuid"], "prediction")
    told = F.coalesce("told", F.col("row").cast("string")).alias("told")
    first = stage(read.groupBy("uuid", told).agg(F.min("row").alias("row")), "first")
    index = read.select("run", "uuid", told).join(first, ["uuid", "told"])
    index = index.select("run", F.col("uuid").alias("golden"), F.col("row").cast("string").alias("uuid"))
    answers = read.join(first.select("row"), "row", "left_semi").withColumn("golden", F.col("uuid"))
    answers = answers.withColumn("uuid", F.col("row").cast("string")).drop("run_id", "run", "row", "told")
    runs = read.agg(F.collect_set(F.struct("run_id"))).scalar()
    each = cases.drop("run_id").withColumn("_of", F.explode(runs)).withColumn("run_id", F.col("_of.run_id")).drop("_of")
    each = each.select(F.col("uuid").alias("golden"), run, F.struct("*").alias("case"))
    return each.join(index, ["run", "golden"], "left").select("uuid", "golden", "case"), answers


def score_cases(
    cases: DataFrame, goldens: DataFrame, predictions: DataFrame, strict: bool = False
) -> DataFrame:
    """``score_records`` of predictions that are figure JSON: uuid, figure_json and, if
    there are several runs, run_id. An answer that several runs give to a case is parsed and
    compared once."""
    if "run_id" not in predictions.columns:
        figures = figure_records(predictions.select("uuid", "figure_json"), "figure_json")
        return score_records(cases, goldens, figures, strict)
    told = F.coalesce(F.sha2("figure_json", 256), F.lit("")).alias("told")
    each, answers = _by_answer(cases, predictions.select("run_id", "uuid", "figure_json", told))
    return _score_runs(each, goldens, figure_records(answers, "figure_json"), strict)


def _outcomes(matches: DataFrame) -> DataFrame:
    outcome = F.when(F.col("bad_keys"), "E").when(F.col("matched"), "T").otherwise("F")
    return matches.select(F.col("case_id").alias("uuid"), "pair", outcome.alias("outcome"))


def _with_outcomes(facts: DataFrame, outcomes: DataFrame, pairs) -> DataFrame:
    """Fill in the data_<pair> columns of cases that have none yet."""
    wide = outcomes.groupBy("uuid").agg(
        *[F.max(F.when(F.col("pair") == pair, F.col("outcome"))).alias(f"new_{pair}") for pair in pairs]
    )
    filled = {f"data_{pair}": F.coalesce(f"data_{pair}", f"new_{pair}") for pair in pairs}
    return facts.join(wide, "uuid", "left").withColumns(filled).drop(*[f"new_{pair}" for pair in pairs])


def with_outcomes(facts: DataFrame) -> DataFrame:
    """Add a case's outcomes, each in a column of its own: pairs (xy, latlon,
    labelsvalues), own (the pair its type is drawn from), standard, density, type, extra.

    Needs g, p and the outcomes of comparing data: data_xy, data_yx, data_latlon,
    data_labelsvalues and data_map.
    """
    facts = facts.withColumns(
        {
            "xy": fields_match("xy", F.col("data_xy"), F.col("data_yx")),
            "latlon": fields_match("latlon", F.col("data_latlon")),
            "labelsvalues": fields_match("labelsvalues", F.col("data_labelsvalues")),
            "type": type_match(),
            "extra": extra_fields_match(),
            "density": F.when(
                _listed("lat", "lon", "z"), F.coalesce("data_map", F.lit("T"))
            ).otherwise("E"),
        }
    )
    own = F.lit("F")
    for pair in PAIRS:
        own = F.when(F.col("source") == pair, F.col(pair)).otherwise(own)
    standard = standard_fields_match([F.col(pair) for pair in PAIRS])
    return facts.withColumns({"own": own, "standard": standard})


def _verdicts(facts: DataFrame, strict: bool) -> DataFrame:
    without = F.coalesce(F.col("case.complexity") == WITHOUT_TYPE, F.lit(False))
    judged = (
        with_outcomes(facts)
        .withColumn("with_type", ~without)
        .withColumn("as_map", (_is("g", "type") == '"densitymapbox"') & F.col("with_type"))
        .withColumn("data", F.when(F.col("as_map"), F.col("density")).otherwise(F.col("standard")))
    )
    reason = (
        F.when(F.col("golden_ok").isNull(), "missing_golden")
        .when(~F.col("golden_ok"), "bad_golden")
        .when(F.col("status").isNull(), "missing_prediction")
        .when(F.col("status") != "ok", F.col("status"))
        .when(F.col("source").isNull(), "unsupported_type")
        .when(F.col("with_type") & (F.col("type") == "E"), "error")
        .when(F.col("with_type") & (F.col("type") == "F"), "type_mismatch")
        .when(F.col("data") == "E", "error")
        .when(F.col("data") == "F", "data_mismatch")
        .when(F.col("with_type") & (F.col("extra") == "E"), "error")
        .when(F.col("with_type") & (F.col("extra") == "F"), "extra_mismatch")
    )
    unproven = ~F.col("as_map") & ((F.col("data") == "V") | (F.col("own") != "T"))
    scored = judged.withColumn("reason", reason).withColumn(
        "vacuous", F.col("reason").isNull() & unproven
    )
    if strict:
        not_compared = F.when(F.col("vacuous"), "not_compared")
        scored = scored.withColumn("reason", F.coalesce("reason", not_compared))
    return scored.select("case.*", F.col("reason").isNull().alias("pass"), "reason", "vacuous")


def pass_rate(scored: DataFrame, by: list[str] | None = None, totals: bool = False) -> DataFrame:
    """Errors, cases and pass rate in percent to two decimals, NULL without cases."""
    by = by or []
    grouped = scored.rollup(*by) if totals and by else scored.groupBy(*by)
    counted = grouped.agg(F.count_if(~F.col("pass")).alias("errors"), F.count("*").alias("total"))
    part = F.try_divide((F.col("total") - F.col("errors")).cast("double"), F.col("total").cast("double"))
    return counted.withColumn("pass_rate", round_cents(part * F.lit(100.0)))


def failure_report(scored: DataFrame, goldens: DataFrame, predictions: DataFrame) -> DataFrame:
    """Failed cases with their records as JSON: uuid (and run_id), reason, predicted, golden.

    predictions: uuid and record, or uuid and figure_json; of the latter the record that was
    compared is shown, or the text itself where it holds none. With run_id where there are
    several runs.
    """
    keys = [c for c in ("run_id", "uuid") if c in scored.columns and c in predictions.columns]
    failed = scored.where(~F.col("pass")).select(*keys, "reason")
    side = broadcast_if_small(failed.select(*keys).distinct())
    theirs = predictions.join(side, keys, "left_semi")
    if "record" in predictions.columns:
        answers = theirs.select(*keys, F.to_json("record").alias("predicted"))
    else:
        text = theirs.select(*keys, "figure_json", F.col("figure_json").alias("text"))
        shown = F.coalesce(F.to_json("record"), F.col("text")).alias("predicted")
        answers = figure_records(text, "figure_json").select(*keys, shown)
    mine = goldens.join(side.select("uuid"), "uuid", "left_semi").select("uuid", F.to_json("record").alias("golden"))
    return failed.join(answers, keys, "left").join(mine, "uuid", "left")
