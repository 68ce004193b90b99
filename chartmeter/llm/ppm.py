"""Language-model scores by prediction by partial matching, trained on the corpus.

A text is its lower-cased words, each ended by a mark, and an end mark. A byte is predicted
from the up to ``ORDER`` bytes before it: in its word (the word's start counts as one), or with
``across`` in the text, over the ends of earlier words. The
trie of byte contexts is a table: a row for every context and symbol seen after it. Where a
context has not seen the symbol, the model escapes to the context one byte shorter, with
probability U / (T + U) for U different symbols among T (method C), and all symbols of the
longer context are excluded there. Below the empty context all symbols are equally likely.

A symbol's code length depends on its context alone, and within words a word's on the word
alone; across words a text's is the sum over its different grams. So lengths
are worked out once for every different run of context and symbol, summed once for every
different word, and then summed over documents. Both sums look up frequent keys where they
are needed and join the others; frequent means more than a fixed fraction of all, of which
there can only be so many, so what is sent to every task has a bound that does not depend
on the corpus, and what is shuffled has no hot key.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmeter.llm.common import held_out, let, map_arrow, per_task, slices, texts
from chartmeter.shared import stage

ORDER = 5
START, WORD_END, TEXT_END = b" ", b"\n", b"\r"  # none of them occurs in a word
#: Bytes that a word may hold, and the two marks.
SYMBOLS = 256 - 6 + 2
#: A key is frequent if it makes up more than 1 / FREQUENT of all; so many can be.
FREQUENT = 1 << 18
#: Of the grams of whole texts the most frequent are, which are held as arrays: so many at
#: most, with 40 bytes each.
FREQUENT_GRAMS = 1 << 20
#: Different keys that a task counts before it hands the counts on.
_FLUSH = 200_000


def grams(word: bytes, order: int = ORDER) -> list[bytes]:
    """Every symbol of the word and its end mark, each after its context."""
    s = START + word + WORD_END
    return [s[max(0, j - order) : j + 1] for j in range(1, len(s))]


def text_grams(words: list[bytes], order: int = ORDER) -> np.ndarray:
    """Every symbol of a text's words and marks after the ``order`` bytes before it, which may
    lie in earlier words (before the text, starts), as big-endian numbers."""
    if order > 6:
        raise ValueError("an order of 6 at most")
    s = START * order + WORD_END.join([*words, TEXT_END])
    a = np.frombuffer(s, dtype=np.uint8).astype(np.int64)
    n = len(a) - order
    out = a[:n].copy()
    for k in range(1, order + 1):
        out <<= 8
        out |= a[k : k + n]
    return out


def split_words(text: bytes) -> list[bytes]:
    return text.lower().split()


def _summed_runs(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, ascending, each with the sum of its counts."""
    at = np.argsort(keys)
    keys = keys[at]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts[at], first)


def count_texts(df: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """Words (``word, n, c``) and grams (``key, uses, c``) of whole texts (``text, held_out``),
    from one pass over them and one shuffle.

    ``n`` and ``uses`` count a word or gram in all texts, ``c`` in training ones.
    """

    def run(batches):
        import pyarrow.compute  # noqa: F401

        raw, size, held, words = [], 0, None, (Counter(), Counter())
        for piece in slices(batches, "text"):
            for text, out in zip(texts(piece, "text"), piece.column("held_out").to_pylist()):
                own = split_words(text)
                words[out].update(own)
                raw.append((text_grams(own, order) << 1) | out)
                size += len(raw[-1])
                if size > 16 * _FLUSH:
                    held = compacted(raw, held)
                    raw, size = [], 0
                    if len(held[0]) > 8 * _FLUSH:
                        yield gram_rows(*held)
                        held = None
            if max(map(len, words)) > _FLUSH:
                yield word_rows(*words)
        if raw or held is not None:
            yield gram_rows(*compacted(raw, held))
        if any(words):
            yield word_rows(*words)

    def compacted(raw, held):
        if not raw:
            return held
        codes, counts = np.unique(np.concatenate(raw), return_counts=True)
        if held is None:
            return codes, counts
        return _summed_runs(np.concatenate((held[0], codes)), np.concatenate((held[1], counts)))

    def gram_rows(codes, counts):
        learnt = pa.array(np.where(codes & 1, 0, counts))
        return pa.record_batch([pa.array(codes >> 1), pa.nulls(len(codes), pa.binary()), pa.array(counts), learnt], names)

    def word_rows(learnt, others):
        own = list(learnt.keys() | others.keys())
        c = [learnt[w] for w in own]
        n = [x + others[w] for x, w in zip(c, own)]
        learnt.clear()
        others.clear()
        columns = [pa.nulls(len(own), pa.int64()), pa.array(own, pa.binary()), pa.array(n, pa.int64()), pa.array(c, pa.int64())]
        return pa.record_batch(columns, names)

    names = ["key", "word", "n", "c"]
    found = df.select("text", "held_out").mapInArrow(run, "key long, word binary, n long, c long")
    counted = stage(found.groupBy("key", "word").agg(F.sum("n").alias("n"), F.sum("c").alias("c")), "counts")
    grams_of = counted.where("key IS NOT NULL").select("key", F.col("n").alias("uses"), "c")
    return counted.where("word IS NOT NULL").select("word", "n", "c"), grams_of


#: An odd number whose multiples are spread evenly.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def gram_table(keys: np.ndarray, values: np.ndarray) -> tuple:
    """Grams with a number each, for ``find_grams``: in the order of their spread keys, behind a
    directory of the first bits of these, so that a look-up reads one entry or a few."""
    spread = keys.astype(np.uint64) * _SPREAD
    at = np.argsort(spread)
    bits = len(keys).bit_length() + 1
    spread, shift = spread[at], 64 - bits
    sizes = np.bincount((spread >> np.uint64(shift)).astype(np.int64), minlength=1 << bits)
    return spread, values[at], shift, np.append(0, np.cumsum(sizes)).astype(np.int32)


def find_grams(table: tuple, keys: np.ndarray) -> np.ndarray:
    """Where in the table's values the grams' numbers stand; -1 for grams that are not there."""
    entries, _, shift, first = table
    spread = keys.astype(np.uint64) * _SPREAD
    slot = (spread >> np.uint64(shift)).astype(np.int64)
    at, end = first[slot], first[slot + 1]
    place = np.full(len(keys), -1, dtype=np.int32)
    left = np.flatnonzero(at < end)
    while len(left):
        now = at[left]
        hit = entries[now] == spread[left]
        place[left[hit]] = now[hit]
        at[left] += 1
        left = left[~hit & (at[left] < end[left])]
    return place


def _counted(df: DataFrame, count, names: tuple[str, ...], key: str, text: str = "text") -> DataFrame:
    """``key`` and the sums of ``names``, over what ``count(batch)`` adds to its counters."""

    def run(batches):
        import pyarrow.compute  # noqa: F401

        totals = tuple(Counter() for _ in names)
        for piece in slices(batches, text):
            count(piece, totals)
            if max(map(len, totals)) > _FLUSH:
                yield from out(totals)
        yield from out(totals)

    def out(totals):
        keys = list(set().union(*totals))
        if keys:
            columns = [pa.array([t[k] for k in keys], pa.int64()) for t in totals]
            yield pa.record_batch([pa.array(keys, pa.binary()), *columns], [key, *names])
        for t in totals:
            t.clear()

    schema = ", ".join([f"{key} binary", *(f"{n} long" for n in names)])
    return df.mapInArrow(run, schema).groupBy(key).agg(*(F.sum(n).alias(n) for n in names))


def count_words(df: DataFrame) -> DataFrame:
    """``word, n, c``: occurrences in all documents (``text, held_out``), and in training ones."""

    def count(batch, totals):
        for text, out in zip(texts(batch, "text"), batch.column("held_out").to_pylist()):
            totals[0 if out else 1].update(split_words(text))

    return _counted(df, count, ("h", "c"), "word").select("word", (F.col("h") + F.col("c")).alias("n"), "c")


def count_grams(words: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram, uses, c``: different words that hold the gram (repeats count), and how often
    training words did."""

    def count(batch, totals):
        for word, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist()):
            own = grams(word, order)
            totals[0].update(own)
            if c:
                sums = totals[1]
                for gram in own:
                    sums[gram] += c

    return _counted(words, count, ("uses", "c"), "gram", "word")


def trie(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The symbols seen (``context, symbol, n``) and the contexts (``context, t, u, d, e``).

    A context is seen wherever one it ends is. ``t`` and ``u`` are its symbols, all and
    different ones; ``d`` and ``e`` are what is left of the next shorter context (all and
    different symbols, the latter standing for its own escape) once this one's are excluded.
    """
    length = F.length("gram")
    context, symbol = F.substring("gram", F.lit(1), length - 1), F.substring("gram", length, F.lit(1))
    seen = counted.where("c > 0").select(context.alias("whole"), symbol.alias("symbol"), "c")
    # A gram's whole context ends no other gram's, as it is of full length or begins with the
    # only start: its counts are there already.
    cut = F.explode(F.sequence(F.lit(1), F.length("whole")))
    symbols = stage(
        seen.where(F.length("whole") > 0)
        .select("symbol", "c", "whole", cut.alias("k"))
        .select(F.substring("whole", F.col("k") + 1, F.length("whole")).alias("context"), "symbol", "c")
        .groupBy("context", "symbol")
        .agg(F.sum("c").alias("n"))
        .unionByName(seen.select(F.col("whole").alias("context"), "symbol", F.col("c").alias("n"))),
        "trie",
    )
    shorter = F.substring("context", F.lit(2), F.length("context"))
    longer = symbols.where(F.length("context") > 0).select("context", "symbol", "n", shorter.alias("up"))
    above = symbols.select(F.col("context").alias("up"), "symbol", F.col("n").alias("n_up"))
    both = longer.join(above, ["up", "symbol"])
    own = both.groupBy("context", "up").agg(F.sum("n").alias("t"), F.count("*").alias("u"), F.sum("n_up").alias("x"))
    sums = symbols.groupBy(F.col("context").alias("up")).agg(F.sum("n").alias("t_up"), F.count("*").alias("u_up"))
    linked = own.join(sums, "up").select(
        "context", "t", "u", (F.col("t_up") - F.col("x") + F.col("u_up") - F.col("u")).alias("d"), (F.col("u_up") - F.col("u")).alias("e")
    )
    root = sums.where(F.length("up") == 0).select(
        F.col("up").alias("context"), F.col("t_up").alias("t"), F.col("u_up").alias("u"), F.lit(None).cast("long").alias("d"), F.lit(None).cast("long").alias("e")
    )
    return symbols, stage(linked.unionByName(root), "contexts")


def _log_probability(steps: Column) -> Column:
    """log10 of the probability from the contexts of a gram, shortest first (``k, n, t, u, d, e``;
    ``n`` null where the context has not seen the symbol, ``t`` null where it is unseen)."""

    def walk(s: Column) -> Column:
        top = F.aggregate(s, F.lit(-1), lambda a, x: F.when(x["t"].isNotNull(), F.greatest(a, x["k"])).otherwise(a))
        hit = F.aggregate(s, F.lit(-1), lambda a, x: F.when(x["n"].isNotNull(), F.greatest(a, x["k"])).otherwise(a))
        return let(F.struct(s.alias("s"), top.alias("top"), hit.alias("hit")), found)

    def found(w: Column) -> Column:
        s, top, hit = w["s"], w["top"], w["hit"]
        first = s[F.greatest(top, F.lit(0))]
        escape = F.log10(first["u"] / (first["t"] + first["u"]))
        # Left contexts between the longest seen one and that of the hit; an excluded-away
        # context (d = 0) has nothing to offer and is passed at no cost.
        passed = F.aggregate(
            F.filter(s, lambda x: (x["k"] <= top) & (x["k"] > hit + 1) & (x["k"] > 0) & (x["d"] > 0)),
            F.lit(0.0),
            lambda a, x: a + F.log10(x["e"] / x["d"]),
        )
        below = s[F.least(hit + 1, F.size(s) - 1)]
        here = s[F.greatest(hit, F.lit(0))]["n"]
        rest = F.log10(F.lit(1.0) / F.greatest(SYMBOLS - s[0]["u"], F.lit(1)))
        return (
            F.when(top < 0, F.lit(-math.log10(SYMBOLS)))
            .when(hit == top, F.log10(here / (first["t"] + first["u"])))
            .when(hit >= 0, escape + passed + F.log10(here / below["d"]))
            .otherwise(escape + passed + rest)
        )

    return let(F.sort_array(steps), walk)


def gram_lengths(counted: DataFrame, symbols: DataFrame, contexts: DataFrame) -> DataFrame:
    """``gram, uses, p``: log10 of the probability of the symbol in its context, for every
    counted gram (``gram, uses, c``).

    A gram of the training texts is coded in its whole context, so one look-up is enough; the
    others go down their contexts.
    """
    length = F.length("gram")
    whole, symbol = F.substring("gram", F.lit(1), length - 1), F.substring("gram", length, F.lit(1))
    learnt = counted.where("c > 0").select("gram", "uses", "c", whole.alias("context")).join(contexts, "context")
    direct = learnt.select("gram", "uses", F.log10(F.col("c") / (F.col("t") + F.col("u"))).alias("p"))
    steps = counted.where("c = 0").select("gram", "uses", whole.alias("whole"), symbol.alias("symbol")).select(
        "gram", "uses", "symbol", "whole", F.explode(F.sequence(F.lit(0), F.length("whole"))).alias("k")
    )
    steps = steps.select("gram", "uses", "symbol", "k", F.substring("whole", F.length("whole") - F.col("k") + 1, F.length("whole")).alias("context"))

    def looked_up(rows: DataFrame, which: Column, hint) -> DataFrame:
        by_symbol, by_context = symbols.where(which), contexts.where(which)
        return rows.join(hint(by_context), "context", "left").join(hint(by_symbol), ["context", "symbol"], "left")

    # Contexts of a byte or none are few (257, with 252 symbols each) and asked for by all.
    short = F.length("context") <= 1
    found = looked_up(steps.where("k <= 1"), short, F.broadcast).unionByName(
        looked_up(steps.where("k > 1"), ~short, lambda x: x)
    )
    step = F.struct("k", "n", "t", "u", "d", "e")
    walked = found.groupBy("gram").agg(F.max("uses").alias("uses"), F.collect_list(step).alias("steps"))
    return direct.unionByName(walked.select("gram", "uses", _log_probability(F.col("steps")).alias("p")))


def least_uses(far: DataFrame) -> int:
    """Uses from which grams are frequent: the fewest that at most ``FREQUENT_GRAMS`` reach.

    Found from a histogram with steps of an eighth of a power of two above 8.
    """
    uses = F.col("uses")
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2("uses")) - 3, F.lit(0)))
    lower = (F.floor(uses / step) * step).cast("long")
    sizes = far.groupBy(lower.alias("lower")).agg(F.count("*").alias("n")).orderBy(F.desc("lower")).collect()
    least, n = (sizes[0]["lower"] + (1 << 60) if sizes else 1), 0
    for row in sizes:
        n += row["n"]
        if n > FREQUENT_GRAMS:
            break
        least = row["lower"]
    return least


def summed(df: DataFrame, split, text: str, carried: list[str], table: DataFrame, key: str, uses: str, values: list[str], far: DataFrame | None = None, order: int = ORDER) -> DataFrame:
    """``carried`` columns of every row of ``df``, with the sums of the table's ``values``
    over the keys that ``split(text)`` lists (each occurrence adds), and as ``p`` those over
    the grams of these words in ``far`` (``key, uses, p``) if there is one.

    Frequent keys, at most ``FREQUENT``, are sent to all tasks; the others are joined. A row
    is known by its task and place, which the written table holds on to.
    """
    total = table.agg(F.sum(uses)).first()[0] or 0
    often = table.where(F.col(uses) * FREQUENT > total).select(key, *values).toArrow()
    numbers = np.array([often[v].to_numpy() for v in values], dtype=np.float64).reshape(len(values), -1).T
    sent = df.sparkSession.sparkContext.broadcast(({k: n for n, k in enumerate(often[key].to_pylist())}, numbers))
    grams_sent = None
    if far is not None:
        least = least_uses(far)
        some = far.where(F.col("uses") >= least).select("key", "p").toArrow()
        grams_sent = df.sparkSession.sparkContext.broadcast(gram_table(some["key"].to_numpy(), some["p"].to_numpy()))

    def of_grams(words):
        """The sum over the frequent grams, and the others with their times."""
        keys, times = np.unique(text_grams(words, order), return_counts=True)
        at = find_grams(grams_sent.value, keys)
        known = at >= 0
        return float(times[known] @ grams_sent.value[1][at[known]]), (keys[~known], times[~known])

    def task():
        (frequent, numbers), at = sent.value, [TaskContext.get().partitionId() << 36]

        def listed(parts: list, key_type: pa.DataType) -> pa.ListArray:
            ends = np.cumsum([0] + [len(keys) for keys, _ in parts], dtype=np.int32)
            keys = pa.concat_arrays([pa.array(keys, key_type) for keys, _ in parts] or [pa.array([], key_type)])
            times = pa.concat_arrays([pa.array(times, pa.int64()) for _, times in parts] or [pa.array([], pa.int64())])
            return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([keys, times], ["key", "times"]))

        def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
            sums, rare, far_sums, far_rare = [], [], [], []
            for data in texts(batch, text):
                items = split(data)
                counts = Counter(items)
                known = np.fromiter(map(frequent.get, counts, repeat(-1)), np.int64, len(counts))
                times = np.fromiter(counts.values(), np.int64, len(counts))
                hit = known >= 0
                sums.append(times[hit] @ numbers[known[hit]])
                rare.append((list(compress(counts, ~hit)), times[~hit]))
                if grams_sent is not None:
                    total, others = of_grams(items)
                    far_sums.append(total)
                    far_rare.append(others)
            ids = np.arange(at[0], at[0] + len(sums))
            at[0] += len(sums)
            more, more_names = [], []
            if grams_sent is not None:
                more, more_names = [pa.array(far_sums, pa.float64()), listed(far_rare, pa.int64())], ["p", "_grams"]
            columns = np.array(sums, dtype=np.float64).reshape(-1, len(values)).T
            return pa.record_batch(
                [*(batch.column(c) for c in carried), pa.array(ids), *map(pa.array, columns), listed(rare, pa.binary()), *more],
                [*carried, "_row", *values, "_rare", *more_names],
            )

        return rows

    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carried]
    schema = ", ".join([*fields, "_row long", *(f"{v} double" for v in values), "_rare array<struct<key:binary,times:bigint>>", *(["p double", "_grams array<struct<key:bigint,times:bigint>>"] if far is not None else [])])
    known = stage(map_arrow(df, per_task(task), schema, text), "sums")
    rare = known.select("_row", F.explode("_rare").alias("x")).select("_row", F.col("x.key").alias(key), "x.times")
    others = table.where(F.col(uses) * FREQUENT <= total).select(key, *values)
    more = rare.join(others, key).groupBy("_row").agg(*(F.sum(F.col("times") * F.col(v)).alias(f"_{v}") for v in values))
    joined = known.drop("_rare").join(more, "_row", "left")
    if far is not None:
        asked = known.select("_row", F.explode("_grams").alias("x")).select("_row", "x.key", "x.times")
        rest = far.where(F.col("uses") < least).select("key", F.col("p").alias("q"))
        rest = asked.join(rest, "key").groupBy("_row").agg(F.sum(F.col("times") * F.col("q")).alias("_q"))
        joined = joined.drop("_grams").join(rest, "_row", "left").withColumn("p", F.col("p") + F.coalesce("_q", F.lit(0.0)))
        return joined.select(*carried, "p", *((F.col(v) + F.coalesce(f"_{v}", F.lit(0.0))).alias(v) for v in values))
    return joined.select(*carried, *((F.col(v) + F.coalesce(f"_{v}", F.lit(0.0))).alias(v) for v in values))


def word_lengths(words: DataFrame, order: int = ORDER, documents: int = 0) -> tuple[DataFrame, float]:
    """``word, n, c, p`` with the words' log10 probabilities, and that of the end mark."""
    end = START + TEXT_END
    spark = words.sparkSession
    counted = stage(
        count_grams(words, order).unionByName(spark.createDataFrame([(bytearray(end), 0, documents)], "gram binary, uses long, c long")),
        "grams",
    )
    symbols, contexts = trie(counted)
    known = stage(gram_lengths(counted, symbols, contexts), "lengths")
    p_end = known.where(F.col("gram") == F.lit(end)).select("p").first()[0]
    scored = summed(words, lambda w: grams(w, order), "word", ["word", "n", "c"], known, "gram", "uses", ["p"])
    return stage(scored, "words"), p_end


def text_gram_lengths(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """``key, uses, p`` of all counted grams (``key, uses, c``) of whole texts."""
    gram = F.unhex(F.lpad(F.hex("key"), 2 * (order + 1), "0")).alias("gram")
    named = counted.select(gram, "uses", "c")
    symbols, contexts = trie(named)
    key = F.conv(F.hex("gram"), 16, 10).cast("long").alias("key")
    return stage(gram_lengths(named, symbols, contexts).select(key, "uses", "p"), "lengths")


def language_scores(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    modulus: int = 7,
    remainder: int = 2,
    order: int = ORDER,
    across: bool = False,
) -> DataFrame:
    """For every row ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from all rows outside the held-out fold, repeated ones as often as they
    come; rows without an id are not held out. ``score`` is the model's log10 probability of
    the text, ``base_score`` that of single words with one added to every count. A null text
    is empty and has the end mark alone. With ``across`` contexts run over the words' starts.
    """
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), held_out(doc_id, modulus, remainder).alias("held_out"))
    if across:
        words, counted = count_texts(docs, order)
    else:
        words = stage(count_words(docs), "word-counts")
    n_docs = docs.where("NOT held_out").count()
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    n, v = sums[0] + n_docs, sums[1] + (n_docs > 0)
    if across:
        lengths, p_end, far = words, 0.0, text_gram_lengths(counted, order)
    else:
        (lengths, p_end), far = word_lengths(words, order, n_docs), None

    def base(count: Column) -> Column:
        return F.log10((count + 1) / F.lit(float(n + v + 1)))

    table = lengths.select("word", "n", F.lit(1.0).alias("tokens"), (F.col("c") > 0).cast("double").alias("known"), base(F.col("c")).alias("base"), *([] if across else ["p"]))
    found = summed(docs, split_words, "text", ["doc_id", "held_out"], table, "word", "n", ["tokens", "known", "base", *([] if across else ["p"])], far, order)
    return found.select(
        "doc_id",
        "held_out",
        (F.col("tokens") + 1).cast("long").alias("n_tokens"),
        (F.col("known") + int(n_docs > 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + base(F.lit(n_docs))).alias("base_score"),
        (F.col("p") + p_end).alias("score"),
    )
