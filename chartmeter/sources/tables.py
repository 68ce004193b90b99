"""CSV tables that chart questions are asked of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

# The spellings of a missing value that data frames read from CSV know.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


#: How values of a type are spelled. A cast takes more than that: `12D` and `1f` as numbers,
#: `2020-01` as a day.
_WHOLE = r"[+-]?[0-9]+"
_DECIMAL = r"[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)"
_DAY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
_SPELLED = {
    "int": _WHOLE,
    "bigint": _WHOLE,
    "decimal": _DECIMAL,
    "double": rf"({_DECIMAL}([eE][+-]?[0-9]+)?|[+-]?(?i:inf|infinity))",
    "date": _DAY,
    "timestamp": _DAY + r"[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?( ?(Z|[+-][0-9]{2}:?[0-9]{2}))?",
    "boolean": r"(?i:true|false)",
}
#: The types of a column, narrowest first; what none of them holds stays text. The decimal
#: is for whole numbers that a double would change.
_KINDS = {
    "int": T.IntegerType(), "bigint": T.LongType(), "decimal(38,0)": T.DecimalType(38, 0), "double": T.DoubleType(),
    "date": T.DateType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType(),
}


def _typed(text: Column, kind: T.DataType) -> Column:
    """The value that ``text`` spells, null if it does not spell one of this type."""
    name = kind.typeName()
    spelled = _SPELLED.get({"integer": "int", "long": "bigint", "short": "int", "byte": "int", "float": "double", "timestamp_ntz": "timestamp"}.get(name, name))
    if spelled is None:
        return text.try_cast(kind)
    return F.when(text.rlike(rf"^\s*{spelled}\s*$"), F.trim(text).try_cast(kind))


def read_source(
    spark: SparkSession,
    path: str | list[str],
    encoding: str = "UTF-8",
    schema: StructType | str | None = None,
    null_values: tuple[str, ...] = MISSING,
    multi_line: bool = False,
    misfits: str = "error",
) -> DataFrame:
    """Read CSV files with a header row and quotes doubled inside quoted fields.

    Without a schema the types are inferred, which reads the data once more: give one for
    anything large. A column gets a type only if all its values are spelled as values of it
    are, and text otherwise, so nothing is read as what it is not. With a schema, a value
    that its type does not hold is an error when the row is read, or null with
    ``misfits="null"`` (``count_misfits`` tells how many). Each of ``null_values`` is a
    missing value in any column. ``multi_line`` is for quoted line breaks and keeps a file
    from being split over tasks.
    """
    if misfits not in ("error", "null"):
        raise ValueError(f"unknown way with misfits {misfits!r}")
    clean = _as_text(spark, path, encoding, null_values, multi_line)
    schema = _inferred(clean) if schema is None else _schema(schema)

    def value(name: str, field: T.StructField) -> Column:
        text = F.col(f"`{name}`")
        typed = _typed(text, field.dataType)
        if misfits == "error":
            told = F.concat(F.lit(f"no {field.dataType.simpleString()} in column {field.name}: "), text)
            typed = F.when(text.isNotNull() & typed.isNull(), F.raise_error(told).cast(field.dataType)).otherwise(typed)
        return typed.alias(field.name)

    return clean.select(*(value(name, f) for f, name in zip(schema.fields, clean.columns)))


def count_misfits(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | str,
    encoding: str = "UTF-8",
    null_values: tuple[str, ...] = MISSING,
    multi_line: bool = False,
) -> DataFrame:
    """``column, n, example`` for each column of the schema: how many values its type does not
    hold, and the first of them in order, in one pass."""
    clean = _as_text(spark, path, encoding, null_values, multi_line)
    fields = _schema(schema).fields

    def seen(name: str, field: T.StructField) -> Column:
        text = F.col(f"`{name}`")
        bad = text.isNotNull() & _typed(text, field.dataType).isNull()
        return F.struct(
            F.lit(field.name).alias("column"), F.count_if(bad).alias("n"), F.min(F.when(bad, text)).alias("example")
        )

    counts = clean.agg(F.array(*(seen(name, f) for f, name in zip(fields, clean.columns))).alias("seen"))
    return counts.select(F.inline("seen"))


def _schema(schema: StructType | str) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _as_text(spark: SparkSession, path: str | list[str], encoding: str, null_values: tuple[str, ...], multi_line: bool) -> DataFrame:
    """All columns as text, missing values as nulls."""
    reader = (
        spark.read.option("header", True)
        .option("encoding", encoding)
        .option("escape", '"')
        .option("multiLine", multi_line)
    )
    # As text first: the reader itself knows a single spelling of a missing value, and
    # another one would turn a column of numbers into text.
    raw = reader.csv(path)
    missing = {c: F.when(~F.col(f"`{c}`").isin(*null_values), F.col(f"`{c}`")) for c in raw.columns}
    return raw.withColumns(missing)


def _inferred(clean: DataFrame) -> StructType:
    """For each column the narrowest type that holds all its values: every value has a bit
    for each type that holds it, and one aggregate takes what they have in common."""

    bit = {name: F.lit(1 << i) for i, name in enumerate(_KINDS)}
    none = F.lit(0)

    def spelled(text: Column, kind: str) -> Column:
        return text.rlike(rf"^\s*{_SPELLED[kind]}\s*$")

    def fits(text: Column, kind: str) -> Column:
        return F.when(F.trim(text).try_cast(_KINDS[kind]).isNotNull(), bit[kind]).otherwise(none)

    def whole(text: Column) -> Column:
        exact = F.trim(text).try_cast(T.DecimalType(38, 0))
        as_double = F.trim(text).try_cast("double").try_cast(T.DecimalType(38, 0))
        # not a double if that is only the one next to it
        double = F.when(exact == as_double, bit["double"]).otherwise(none)
        return fits(text, "int") + fits(text, "bigint") + fits(text, "decimal(38,0)") + double

    def held(text: Column) -> Column:
        numbers = bit["int"] + bit["bigint"] + bit["decimal(38,0)"] + bit["double"]
        return (
            F.when(text.isNull(), None)
            .when(spelled(text, "int"), F.when(F.length(text) < 10, numbers).otherwise(whole(text)))
            .when(spelled(text, "double"), bit["double"])
            .when(spelled(text, "date"), fits(text, "date"))
            .when(spelled(text, "timestamp"), fits(text, "timestamp"))
            .when(spelled(text, "boolean"), bit["boolean"])
            .otherwise(none)
        )

    found = clean.agg(*(F.bit_and(held(F.col(f"`{c}`"))).alias(str(i)) for i, c in enumerate(clean.columns))).first()
    out = StructType()
    for i, c in enumerate(clean.columns):
        fitting = (kind for k, kind in enumerate(_KINDS.values()) if (found[i] or 0) >> k & 1)
        out = out.add(c, next(fitting, T.StringType()))
    return out
