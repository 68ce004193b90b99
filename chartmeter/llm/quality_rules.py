"""Quality rules as a ledger: every rule is evaluated once, policies are bit masks.

``measure`` adds what the rules look at, ``ledger`` turns it into one integer with a bit
for each failed rule. A policy is a version name and the rules it enforces, so applying
another version, or asking what a single rule costs, needs the stored integers only and
never the texts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmeter.llm.common import SPACE, let

#: Counted as symbols.
SYMBOLS = "#*$%&|<>"

#: Bit of a rule and when it fails, over the measured columns. Bits are never reused.
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 50"),
    "repeated_windows": (1, "100 * n_repeat_words > 50 * n_words"),
    "symbols": (2, "100 * n_symbols > 10 * n_words"),
    # One repeated line is no fault in a text of two or three.
    "duplicate_lines": (3, "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),
    "short_words": (4, "10 * word_chars < 22 * n_words"),
    "long_words": (5, "10 * word_chars > 140 * n_words"),
    "shouting": (6, "100 * n_upper > 40 * word_chars"),
    "repeated_words": (7, "100 * n_distinct_words < 12 * least(n_words, 400)"),
}

#: Rules that each version of the policy enforces.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(RULES),
}

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_distinct_words",
)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more; each word counts once."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(
            F.concat_ws(" ", words[i], words[i + 1], words[i + 2]).alias("g"), i.alias("i")
        ),
    )

    def starts(w: Column) -> Column:
        """Sorted starts of the windows that have an equal one: neighbours after a sort."""
        last = F.size(w) - 1
        marked = F.transform(
            F.sequence(F.lit(0), last),
            lambda k: F.when(
                ((k > 0) & (w[F.greatest(k - 1, F.lit(0))]["g"] == w[k]["g"]))
                | ((k < last) & (w[F.least(k + 1, last)]["g"] == w[k]["g"])),
                w[k]["i"],
            ),
        )
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    def covered(r: Column) -> Column:
        last = F.size(r) - 1
        gaps = F.transform(
            F.sequence(F.lit(0), last),
            lambda k: F.when(k < last, F.least(r[F.least(k + 1, last)] - r[k], F.lit(3))).otherwise(3),
        )
        return F.when(F.size(r) == 0, F.lit(0)).otherwise(
            F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)
        )

    def count(w: Column) -> Column:
        distinct = F.size(F.array_distinct(F.transform(w, lambda x: x["g"])))
        return F.when(distinct == F.size(w), F.lit(0)).otherwise(
            let(let(F.sort_array(w), starts), covered)
        )

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(windows, count))


def measure(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the measures of every whole text; a null text has no words.

    Other columns of ``df`` are left out, so their names cannot clash; repeated rows give
    repeated rows, a null id stays null.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(content, SPACE + "+", -1), lambda w: w != "")
    lines = F.filter(F.split(content, "\n", -1), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
        ),
    )
    of_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )

    def without(chars: str) -> Column:
        return F.char_length(F.translate(content, chars, "")).cast("long")

    whole = F.char_length(content).cast("long")
    measured = df.select(
        F.col(doc_id).alias("doc_id"),
        of_words.alias("w"),
        of_lines.alias("l"),
        without(" \t\n\x0b\x0c\r").alias("word_chars"),
        (whole - without(SYMBOLS)).alias("n_symbols"),
        (whole - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_upper"),
    )
    return measured.select("doc_id", "w.*", "l.*", "word_chars", "n_symbols", "n_upper").select(
        "doc_id", *MEASURES
    )


def ledger(measured: DataFrame) -> DataFrame:
    """Adds ``failures``: bit ``b`` is set if the rule with that bit fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, rule in RULES.values()]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measured.withColumn("failures", total.cast("long"))


def policy_mask(version: str) -> int:
    return sum(1 << RULES[name][0] for name in POLICIES[version])


def passes(version: str, failures: str = "failures") -> Column:
    """Whether a ledger row passes a version of the policy."""
    return F.col(failures).bitwiseAND(F.lit(policy_mask(version))) == 0


def ablation(rows: DataFrame, version: str) -> DataFrame:
    """Per rule of a policy: rows that fail it, and rows that only this rule rejects.

    Rows meet as distinct bit masks (256 at most for eight rules) before any is looked at.
    """
    mask = policy_mask(version)
    masks = rows.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("f")).agg(F.count("*").alias("n"))
    each = F.explode(
        F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << RULES[name][0]).cast("long").alias("bit")) for name in POLICIES[version]))
    )
    failed = F.col("f").bitwiseAND(F.col("bit")) != 0
    return (
        masks.select("f", "n", each.alias("r"))
        .select("f", "n", "r.*")
        .groupBy("rule")
        .agg(
            F.coalesce(F.sum(F.when(failed, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("f") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only_this"),
        )
    )


def quality_rules(df: DataFrame, version: str = "v1", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` by the given version of the policy."""
    rows = ledger(measure(df, doc_id, text))
    base = ~passes("base")
    return rows.withColumn("base_failed", base).withColumn("kept", ~base & passes(version))
