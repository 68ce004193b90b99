"""Tagged values and their tolerant comparison.

A tagged value is ``struct<kind string, num double, str string>`` with kind one
of ``num`` (numbers and booleans), ``str``, ``null`` and ``other`` (arrays and
objects, held as canonical JSON text in ``str``). Numbers from 2**53 to 2**95 are held as
exact integers in ``str`` besides, as doubles do not tell all integers there apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Doubles at or above 2**46 are more than 0.01 apart, so two decimals leave them as they are.
_NO_CENTS = float(2**46)
# 2**27 + 1 splits a double's 53 bits into two halves that multiply without error.
_SPLITTER = float(2**27 + 1)
# From here on doubles skip integers; up to there an exact integer goes with them.
_EXACT_FROM, _EXACT_TO = float(2**53), float(2**95)
# A JSON text's strings, numbers, words and signs.
_TOKENS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][-+0-9.eE]*|[a-z]+|[\[\]{},:]'


def _tagged(kind: Column, num: Column, text: Column) -> Column:
    return F.struct(kind.alias("kind"), num.alias("num"), text.alias("str"))


def _needs_exact(num: Column) -> Column:
    return (F.abs(num) >= _EXACT_FROM) & (F.abs(num) < _EXACT_TO)


def _whole_text(num: Column) -> Column:
    """Digits of a double that is an integer and under 2**95, taken apart without loss."""
    high = F.floor(num / F.lit(float(2**32)))
    low = (num - high * F.lit(float(2**32))).cast("bigint")
    scaled = high.cast("decimal(20,0)") * F.lit(2**32).cast("decimal(10,0)")
    return (scaled + low.cast("decimal(10,0)")).cast("string")


def canonical_json(text: Column) -> Column:
    """JSON text without blanks that is equal for equal values: booleans as 0 and 1, every
    number in one spelling. Keys keep their order, which VARIANT has sorted."""

    def one(token: Column) -> Column:
        num = token.try_cast("double")
        whole = (num == F.floor(num)) & (F.abs(num) < _EXACT_TO)
        number = F.when(whole, _whole_text(num)).otherwise(num.cast("string"))
        return (
            F.when(token == "true", "1")
            .when(token == "false", "0")
            .when(token == "-0", "0")
            .when(token.rlike("^-?[0-9].*[.eE]"), number)
            .otherwise(token)
        )

    tokens = F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0))
    return F.array_join(F.transform(tokens, one), "")


def tag_variant(v: Column, shape: Column | None = None) -> Column:
    """Tag a VARIANT by the JSON type it holds. ``shape`` is its ``schema_of_variant``,
    for callers that have it in a column."""
    shape = F.schema_of_variant(v) if shape is None else shape
    kind = (
        F.when(v.isNull() | (shape == "VOID"), "null")
        .when(shape == "STRING", "str")
        .when(is_number(shape), "num")
        .otherwise("other")
    )
    num = F.when(is_number(shape), F.try_variant_get(v, "$", "double"))
    written = F.try_variant_get(v, "$", "decimal(38,0)").cast("string")
    exact = F.when(shape.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))"), written).otherwise(_whole_text(num))
    text = (
        F.when(shape == "STRING", F.try_variant_get(v, "$", "string"))
        .when(shape.rlike("^(ARRAY|OBJECT)"), canonical_json(F.to_json(v)))
        .when(_needs_exact(num), exact)
    )
    return _tagged(kind, num, text)


def is_number(shape: Column) -> Column:
    """Whether ``schema_of_variant`` names a number; booleans count as 0 and 1."""
    return shape.rlike("^(BIGINT|BOOLEAN|DOUBLE|FLOAT|DECIMAL)")


def tag_column(df: DataFrame, name: str) -> Column:
    """Tag a table column by its type; dates become the strings JSON would hold."""
    dtype = df.schema[name].dataType
    col = F.col(name)
    none_num, none_str = F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(dtype, T.VariantType):
        return tag_variant(col)
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        number = (col.cast("int") if isinstance(dtype, T.BooleanType) else col).cast("double")
        integral = isinstance(dtype, T.IntegralType) or (isinstance(dtype, T.DecimalType) and not dtype.scale)
        exact = col.cast("decimal(38,0)").cast("string") if integral else _whole_text(number)
        text = none_str if isinstance(dtype, T.BooleanType) else F.when(_needs_exact(number), exact)
        return _tagged(F.when(col.isNull(), "null").otherwise("num"), number, text)
    if isinstance(dtype, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return _tagged(F.when(col.isNull(), "null").otherwise("str"), none_num, col.cast("string"))
    return _tagged(F.when(col.isNull(), "null").otherwise("other"), none_num, canonical_json(F.to_json(col)))


def round_cents(x: Column) -> Column:
    """``x`` to two decimals, rounding its exact binary value half to even.

    ``bround`` rounds the shortest decimal spelling instead, and so moves values
    like 2.675 (really 2.67499…) up. Here ``x * 100`` is taken as a product and
    its exact rounding error, and the error breaks ties the product alone shows.
    """
    scaled = x * F.lit(100.0)
    spread = x * F.lit(_SPLITTER)
    high = spread - (spread - x)
    error = (high * F.lit(100.0) - scaled) + (x - high) * F.lit(100.0)
    tie = scaled - F.floor(scaled) == 0.5
    nudge = F.when(tie, F.signum(error) * F.lit(0.5)).otherwise(F.lit(0.0))
    # adding 0.0 turns -0.0 into 0.0
    cents = F.rint(scaled + nudge) / F.lit(100.0) + F.lit(0.0)
    return F.when(F.abs(x) < _NO_CENTS, cents).otherwise(x)


def comparison_form(value: Column) -> Column:
    """Tagged value in the form two values are compared in: rounded or lower-cased."""
    kind = value["kind"]
    return _tagged(
        kind,
        F.when(kind == "num", round_cents(value["num"])),
        F.when(kind == "str", F.lower(value["str"])).otherwise(value["str"]),
    )


def values_match(golden: Column, predicted: Column) -> Column:
    """Whether a predicted tagged value is accepted for a golden one.

    Numbers agree to two decimals; a golden string only has to occur in the
    predicted one, ignoring case; anything else has to be equal.
    """
    return forms_match(comparison_form(golden), comparison_form(predicted))


def forms_match(g: Column, p: Column) -> Column:
    """``values_match`` of values that are in their ``comparison_form`` already."""
    same_kind = g["kind"] == p["kind"]
    return (
        F.when(~same_kind, F.lit(False))
        .when(
            g["kind"] == "num",
            (g["num"] == p["num"]) & ~F.isnan(g["num"]) & g["str"].eqNullSafe(p["str"]),
        )
        .when(g["kind"] == "str", F.contains(p["str"], g["str"]))
        .when(g["kind"] == "null", F.lit(True))
        .otherwise(g["str"] == p["str"])
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def with_form(tag: Column) -> Column:
    """A tagged value, computed once, and its ``comparison_form``: ``tag`` and ``form``."""
    return let(tag, lambda t: F.struct(t.alias("tag"), comparison_form(t).alias("form")))


def tagged_elements(others: Column) -> Column:
    """``with_form`` of each of these VARIANTs."""

    def one(x: Column) -> Column:
        return with_form(let(F.schema_of_variant(x), lambda s: tag_variant(x, s)))

    return F.transform(others, one)


def plain_elements(v: Column, shape: Column) -> Column:
    """Elements of a VARIANT of this ``shape`` that is an array of texts (``s``) or of numbers
    (``n``) only; NULL for any other."""
    texts = F.when(shape == "ARRAY<STRING>", F.try_variant_get(v, "$", "array<string>"))
    numbers = F.when(_all_numbers(shape), F.try_variant_get(v, "$", "array<double>"))
    # adding 0.0 turns -0.0 into 0.0, which it equals
    both = F.struct(texts.alias("s"), F.transform(numbers, lambda d: d + F.lit(0.0)).alias("n"))
    return F.when((shape == "ARRAY<STRING>") | _all_numbers(shape), both)


def _all_numbers(shape: Column) -> Column:
    return shape.isin("ARRAY<BIGINT>", "ARRAY<DOUBLE>") | shape.startswith("ARRAY<DECIMAL(")


def flat_elements(plain: Column, v: Column, shape: Column, others: Column, longest: int) -> Column:
    """What iterating over a VARIANT gives: ``size``, and ``flat`` if it is a plain array
    (``plain_elements``), that is up to ``longest`` strings (``s``) or numbers that doubles hold
    exactly (``n``), in the form values are compared in. ``alone`` tells whether they differ as
    they are written. ``others`` are the elements of what is no such array; NULL if there are none."""

    def made(array: Column, ok: Column, texts: Column, numbers: Column) -> Column:
        size = F.size(array)
        flat = F.when((size <= longest) & ok, F.struct(texts.alias("s"), numbers.alias("n")))
        return F.struct(size.alias("size"), flat.alias("flat"), (F.size(F.array_distinct(array)) == size).alias("alone"))

    texts, numbers, none = plain["s"], plain["n"], F.lit(None)
    small = F.forall(numbers, lambda d: F.coalesce(F.abs(d) < _EXACT_FROM, F.lit(False)))
    # whole numbers, and decimals of up to two places, are what they would be rounded to
    cents = (shape == "ARRAY<BIGINT>") | shape.endswith(",0)>") | shape.endswith(",1)>") | shape.endswith(",2)>")
    rounded = F.when(cents, numbers).otherwise(F.transform(numbers, round_cents))
    other = F.struct(
        F.size(others).alias("size"), none.cast("struct<s:array<string>,n:array<double>>").alias("flat"), F.lit(False).alias("alone")
    )
    all_there = F.forall(texts, lambda s: s.isNotNull())
    return F.when(
        v.isNotNull(),
        F.when(shape == "ARRAY<STRING>", made(texts, all_there, F.transform(texts, F.lower), none.cast("array<double>")))
        .when(_all_numbers(shape), made(numbers, small, none.cast("array<string>"), rounded))
        .otherwise(other),
    )
