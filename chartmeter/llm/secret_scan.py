"""Secrets in texts: three fixed patterns and strings of high entropy, built-in functions only.

Spans are positions in code points, end exclusive. The entropy of a candidate string is
the highest Shannon entropy of any window of ``WINDOW`` characters; the window slides by
one, and the counts of its characters and their sum of ``c * log2 c`` are carried along.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmeter.llm.common import let

KINDS = ("assign", "access", "hex", "entropy")

ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_VALUE = 12  # least characters of the value
# Runs are matched whole, so a least length in the pattern drops the same matches as after it.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Characters of a candidate; their places in this text are the indices of the counts.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Class of characters, what a string of that class looks like, least bits per character
#: of its best window. The first class that fits counts.
CLASSES = (
    ("digits", r"^[0-9]+$", math.inf),
    ("letters", r"^([A-Z]+|[A-Z]?[a-z]+)$", math.inf),
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", 3.05),
    ("upper", r"^[A-Z0-9]+$", 3.35),
    ("mixed", r"", 3.65),
)
#: Strings that are no secrets however varied they are: identifiers with dashes of a
#: uuid, dates and versions, words joined by dashes, slashes or underscores, and rulers.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-([0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$",
    r"^[A-Za-z]+([-_/+=]+[A-Za-z]*)+$",
    r"^([A-Za-z]+|[0-9]{1,4})([-_/]+([A-Za-z]+|[0-9]{1,4}))+$",
    r"^(.)\1+$",
)

_SPAN = "array<struct<start:int,kind_no:int,kind:string,end:int,value:string>>"

#: Elements of a block of ``_running``, and code points of a block of ``redact``.
BLOCK, CHARACTERS = 128, 1024


def _running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """What ``merge`` gives from the first of some whole numbers, 0 or more, up to each one.

    Goes by blocks, then over the blocks, as each step of an aggregate copies its array.
    """

    def last(array: Column) -> Column:
        return F.coalesce(F.get(array, F.size(array) - 1), F.lit(0))

    none = F.array().cast("array<int>")
    starts = F.filter(F.sequence(F.lit(0), F.size(values)), lambda i: (i % BLOCK == 0) & (i < F.size(values)))
    blocks = F.transform(
        starts,
        lambda i: F.aggregate(
            F.slice(values, i + 1, BLOCK), none, lambda done, x: F.array_append(done, merge(last(done), x))
        ),
    )

    def joined(inner: Column) -> Column:
        carried = F.aggregate(
            inner, none, lambda done, block: F.array_append(done, merge(last(done), last(block)))
        )
        return let(
            carried,
            lambda after: F.flatten(
                F.transform(
                    inner,
                    lambda block, b: let(
                        F.coalesce(F.get(after, b - 1), F.lit(0)),
                        lambda before: F.transform(block, lambda x: merge(before, x)),
                    ),
                )
            ),
        )

    return let(blocks, joined)


def _found(text: Column, pattern: str, kind: str) -> Column:
    """Spans of the leftmost non-overlapping matches; what lies between them is ``parts``."""

    def spans(s: Column) -> Column:
        widths = F.transform(s["hits"], lambda hit, i: F.char_length(s["parts"][i]) + F.char_length(hit))

        def span(ends: Column) -> Column:
            return F.transform(
                s["hits"],
                lambda hit, i: F.struct(
                    (ends[i] - F.char_length(hit)).alias("start"),
                    F.lit(KINDS.index(kind)).alias("kind_no"),
                    F.lit(kind).alias("kind"),
                    ends[i].alias("end"),
                    hit.alias("value"),
                ),
            )

        ends = let(widths, lambda w: _running(w, lambda before, x: before + x))
        return let(ends, span).cast(_SPAN)

    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
        F.split(text, pattern, -1).alias("parts"),
    )
    return F.when(text.rlike(pattern), let(parts, spans)).otherwise(F.array().cast(_SPAN))


def best_entropy(value: Column) -> Column:
    """Most bits per character of any ``WINDOW`` characters of ``value`` (-1 if shorter)."""
    terms = F.array(*(F.lit(k * math.log2(k) if k else 0.0) for k in range(WINDOW + 2)))
    zero = F.array_repeat(F.lit(0), len(ALPHABET) + 1)
    start = F.struct(zero.alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1.0).alias("best"))

    def slide(x: Column) -> Column:
        codes, term = x["codes"], x["terms"]

        def step(at: Column, i: Column) -> Column:
            new, old = codes[i], F.when(i >= WINDOW, codes[F.greatest(i - WINDOW, F.lit(0))]).otherwise(-1)
            n, m = at["counts"][new], at["counts"][F.greatest(old, F.lit(0))]
            gained = term[n + 1] - term[n]
            lost = F.when(old < 0, F.lit(0.0)).otherwise(term[F.greatest(m - 1, F.lit(0))] - term[m])
            same = old == new
            total = at["sum"] + F.when(same, F.lit(0.0)).otherwise(gained + lost)
            counts = F.transform(
                at["counts"],
                lambda c, k: c + F.when(k == new, 1).otherwise(0) - F.when(k == old, 1).otherwise(0),
            )
            bits = F.lit(math.log2(WINDOW)) - total / F.lit(float(WINDOW))
            best = F.when(i >= WINDOW - 1, F.greatest(at["best"], bits)).otherwise(at["best"])
            return F.struct(
                F.when(same, at["counts"]).otherwise(counts).alias("counts"), total.alias("sum"), best.alias("best")
            )

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda at: at["best"])

    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.when(F.char_length(value) < WINDOW, F.lit(-1.0)).otherwise(
        let(F.struct(codes.alias("codes"), terms.alias("terms")), slide)
    )


def _entropic(value: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | value.rlike(pattern)
    least = F.when(allowed, F.lit(math.inf))
    for _, pattern, bits in CLASSES:
        least = least.when(value.rlike(pattern), F.lit(bits))
    return let(least, lambda bits: F.when(bits == math.inf, F.lit(False)).otherwise(best_entropy(value) >= bits))


def _touches(span: Column, others: Column) -> Column:
    """Whether ``span`` overlaps one of ``others``, which are in order and apart: the last of
    those that start before its end, found by halving."""
    steps = F.ceil(F.log2((F.size(others) + 1).cast("double"))).cast("int")
    start = F.struct(F.lit(0).alias("low"), F.size(others).alias("high"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["low"] + at["high"], 1)
        open_ = at["low"] < at["high"]
        before = open_ & F.coalesce(F.get(others, middle)["start"] < span["end"], F.lit(False))
        return F.struct(
            F.when(before, middle + 1).otherwise(at["low"]).alias("low"),
            F.when(open_ & ~before, middle).otherwise(at["high"]).alias("high"),
        )

    started = F.aggregate(F.sequence(F.lit(0), steps), start, halve, lambda at: at["low"])
    return F.coalesce(F.get(others, started - 1)["end"] > span["start"], F.lit(False))


def secrets_of(text: Column) -> Column:
    """``base`` and ``all``: the spans of the fixed patterns, and these with those of high
    entropy that overlap none of them, each sorted by start, then kind. Null is empty."""
    text = F.coalesce(text, F.lit(""))
    assigned = F.filter(
        _found(text, ASSIGN, "assign"),
        lambda s: F.char_length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_VALUE,
    )
    kinds = F.struct(
        assigned.alias("assign"),
        _found(text, ACCESS, "access").alias("access"),
        _found(text, HEX, "hex").alias("hex"),
        _found(text, CANDIDATE, "entropy").alias("found"),
    )

    def together(s: Column) -> Column:
        def free(e: Column) -> Column:
            touched = _touches(e, s["assign"]) | _touches(e, s["access"]) | _touches(e, s["hex"])
            return F.when(touched, F.lit(False)).otherwise(_entropic(e["value"]))

        base = F.concat(s["assign"], s["access"], s["hex"])
        added = F.filter(s["found"], free)
        return F.struct(F.sort_array(base).alias("base"), F.sort_array(F.concat(base, added)).alias("all"))

    return let(kinds, together)


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``base_spans`` and ``spans`` of every whole text (see ``secrets_of``).

    Columns of these names are replaced, all others and all rows are kept as they are.
    """
    return (
        df.withColumn("spans", secrets_of(F.col(text)))
        .withColumn("base_spans", F.col("spans.base"))
        .withColumn("spans", F.col("spans.all"))
    )


def mask(df: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``df`` with every secret in ``text`` replaced; ``length``, if there, counts anew where
    that changed a text. A null text stays null; all columns and rows are kept."""

    def masked(spans: Column) -> Column:
        new = redact(F.col(text), spans)
        return F.struct(new.alias("text"), (F.size(spans) > 0).alias("changed"))

    found = let(secrets_of(F.col(text))["all"], masked)
    out = {text: F.col("_masked.text")}
    if length in df.columns:
        counted = F.char_length(F.col("_masked.text")).cast(df.schema[length].dataType)
        out[length] = F.when(F.col("_masked.changed"), counted).otherwise(F.col(length))
    return df.withColumn("_masked", found).withColumns(out).drop("_masked")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    )


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span, overlapping ones as one, replaced by ``mark``.

    ``spans`` are in the order of their starts. What lies between them is cut from blocks
    of the text, as a cut from the whole of it would count from its first character.
    """

    def pieces(s: Column) -> Column:
        def cut(start: Column, end: Column) -> Column:
            first = F.floor(start / CHARACTERS).cast("int")
            blocks = F.slice(s["blocks"], first + 1, F.floor(end / CHARACTERS).cast("int") - first + 1)
            return F.substring(F.array_join(blocks, ""), start - first * CHARACTERS + 1, end - start)

        def one(span: Column, i: Column) -> Column:
            before = F.coalesce(F.get(s["ends"], i - 1), F.lit(0))
            return F.when(span["start"] >= before, F.concat(cut(before, span["start"]), F.lit(mark))).otherwise("")

        rest = cut(F.get(s["ends"], F.size(spans) - 1), s["length"])
        return F.concat(F.array_join(F.transform(spans, one), ""), rest)

    parts = F.struct(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHARACTERS}}}"), F.lit(0)).alias("blocks"),
        _running(F.transform(spans, lambda s: s["end"]), F.greatest).alias("ends"),
        F.char_length(text).alias("length"),
    )
    return F.when(F.size(spans) == 0, text).otherwise(let(parts, pieces))
