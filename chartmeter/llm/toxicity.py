"""Toxic passages by maximum-scoring segments over token log-odds.

Training counts, for every hashed token and every hashed beginning of one (a stem takes many
endings), the toxic and the other documents that hold it. A token's score is the highest
of its and its beginnings' log-odds with a Dirichlet prior in proportion to its overall
frequency, drawn towards zero by two standard errors and less a drift, so that a text of
neutral tokens falls and only passages of toxic ones rise. One scan over a text finds all
its maximal segments (Ruzzo and Tompa, 1999). How surprising a segment is follows the
extreme-value law of Karlin and Altschul: a text of m tokens has K m exp(-lambda S) segments
of score S or more by chance. A text's evidence is the sum, over its significant segments,
of how far lambda S exceeds ln(K m), and a logistic curve turns that into a probability.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartmeter.llm.common import held_out, map_arrow, per_task, texts

#: About how many labelled documents a model learns from (by hash of the id).
SAMPLE = 40_000
#: Tokens share this many counters, so a model has a fixed size whatever the corpus.
BUCKETS = 1 << 20
#: Prior documents for each real one, standard errors, cost of a neutral token.
PRIOR, ERRORS, DRIFT = 0.01, 2.0, 0.2
#: Bytes of the beginnings that count besides the whole token.
STEMS = (4, 5, 6)
#: Most chance segments of as high a score for a segment to be significant.
EXPECT = 0.05
#: Scores of known tokens that a task remembers at most.
_MEMO = 200_000

_CLEAR = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return text.translate(_CLEAR).lower().split()


def buckets(token: bytes) -> list[int]:
    """Counters of a token: its own first, then those of its beginnings."""
    return [zlib.crc32(token) % BUCKETS] + [
        zlib.crc32(b"^" + token[:n]) % BUCKETS for n in STEMS if len(token) > n
    ]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) of ``scores``, in linear time."""
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    stack: list[list[float]] = []  # first, end, sum before, sum after, segment below
    for i in np.flatnonzero(scores > 0).tolist():
        new = [i, i + 1, sums[i], sums[i + 1], -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]  # those between begin no lower and are passed over for good
            if j < 0 or stack[j][3] >= new[3]:
                new[4] = j
                stack.append(new)
                break
            new[0], new[2] = stack[j][0], stack[j][2]
            del stack[j:]
    return [(int(a), int(b), float(after - before)) for a, b, before, after, _ in stack]


@dataclass
class Model:
    """Scores by bucket (others cost the drift), the law's lambda and K, and the curve."""

    scores: dict[int, float] = field(default_factory=dict)
    decay: float = 1.0
    scale: float = 1.0
    bias: float = -10.0
    slope: float = 0.0


class Scorer:
    def __init__(self, model: Model):
        self.model, self.memo = model, {}

    def token_scores(self, found: list[bytes]) -> np.ndarray:
        memo, scores = self.memo, self.model.scores
        if len(memo) > _MEMO:
            memo.clear()
        try:
            return np.array([memo[t] for t in found], dtype=np.float64)
        except KeyError:
            for t in set(found).difference(memo):
                own = [scores.get(b, -DRIFT) for b in buckets(t)]
                memo[t] = max(own) if max(own) > 0 else own[0]
            return np.array([memo[t] for t in found], dtype=np.float64)

    def passages(self, text: bytes) -> tuple[list[tuple[int, int, float]], int]:
        found = tokens(text)
        values = self.token_scores(found)
        return (segments(values) if (values > 0).any() else []), len(found)

    def evidence(self, text: bytes) -> tuple[float, list[tuple[int, int, float]]]:
        """Summed evidence and the significant passages (first token, end, score)."""
        all_segments, n = self.passages(text)
        m = self.model
        chance = math.log(max(m.scale * max(n, 1), 1e-12))
        strong = [s for s in all_segments if m.decay * s[2] - chance > -math.log(EXPECT)]
        return sum(m.decay * s[2] - chance for s in strong), strong

    def probability(self, evidence: float) -> float:
        x = self.model.bias + self.model.slope * math.log1p(evidence)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def training_rows(df: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, sample: int) -> DataFrame:
    """``text, y`` of about ``sample`` labelled documents at most, none of the held-out fold.

    The labelled ids are cut before they are joined, so what is broadcast is bounded. Ids
    labelled twice take the higher label; rows without a label or an id teach nothing.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .where(~held_out("doc_id", modulus, remainder))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    n = known.count()
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(max(n, 1))) < sample)
    return df.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y")


def _bucket_counts(rows: DataFrame) -> np.ndarray:
    """Documents holding each bucket: one row for others, one for toxic ones."""

    def task():
        def count(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = np.zeros((2, BUCKETS), dtype=np.int32)
            for text, y in zip(texts(batch, "text"), batch.column("y").to_pylist()):
                own = {b for t in set(tokens(text)) for b in buckets(t)}
                counts[y, np.fromiter(own, dtype=np.int64, count=len(own))] += 1
            seen = np.flatnonzero(counts.any(0))
            return pa.record_batch(
                [pa.array(seen), pa.array(counts[0, seen].astype(np.int64)), pa.array(counts[1, seen].astype(np.int64))],
                ["bucket", "n0", "n1"],
            )

        return count

    counted = map_arrow(rows, per_task(task), "bucket long, n0 long, n1 long")
    summed = counted.groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    out = np.zeros((2, BUCKETS))
    at = summed["bucket"].to_numpy()
    out[0, at], out[1, at] = summed["n0"].to_numpy(), summed["n1"].to_numpy()
    return out


def token_model(counts: np.ndarray, n_docs: tuple[int, int]) -> Model:
    """Scores by bucket from document counts, and lambda by the tokens of other documents."""
    n0, n1 = max(n_docs[0], 1), max(n_docs[1], 1)
    total = counts.sum(0)
    seen = np.flatnonzero(total)
    prior = PRIOR * total[seen]
    y0, y1 = counts[0, seen] + prior, counts[1, seen] + prior
    odds = np.log(y1 / n1) - np.log(y0 / n0)
    error = ERRORS * np.sqrt(1 / y1 + 1 / y0)
    drawn = np.sign(odds) * np.maximum(0, np.abs(odds) - error)
    model = Model({int(b): float(s - DRIFT) for b, s in zip(seen, drawn) if s})
    values, weights = drawn - DRIFT, y0 / max(y0.sum(), 1e-12)
    if (values > 0).any():
        low, high = 0.0, 1.0
        while (weights * np.exp(high * values)).sum() < 1 and high < 64:
            high *= 2
        for _ in range(60):
            middle = (low + high) / 2
            below = (weights * np.exp(middle * values)).sum() < 1
            low, high = (middle, high) if below else (low, middle)
        model.decay = max(low, 1e-3)
    return model


def fit_curve(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Logistic bias and slope for ``n`` documents with evidence ``x`` of which ``y`` are toxic."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a + b * x)))
        w = n * p * (1 - p)
        g = np.array([(y - n * p).sum() - 1e-2 * a, ((y - n * p) * x).sum() - 1e-2 * b])
        h = np.array([[w.sum() + 1e-2, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -4, 4)), b + float(np.clip(step[1], -4, 4))
    return a, max(b, 0.0)


def train(
    df: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, remainder: int = 0, sample: int = SAMPLE
) -> Model:
    """A model from the labelled documents outside the held-out fold.

    Without toxic labels nothing is toxic: every score is about zero.
    """
    rows = training_rows(df, labels, label, modulus, remainder, sample)
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Model()
    model = token_model(_bucket_counts(rows), (n[0], n[1]))
    sent = rows.sparkSession.sparkContext.broadcast(vars(model))

    def chance():
        scorer = Scorer(Model(**sent.value))

        def count(batch: pa.RecordBatch) -> pa.RecordBatch:
            total = docs = 0.0
            for text, y in zip(texts(batch, "text"), batch.column("y").to_pylist()):
                found, m = scorer.passages(text)
                if y == 0 and found:
                    total += m * math.exp(-model_decay * max(s for *_, s in found))
                    docs += 1
                elif y == 0:
                    total += m
            return pa.record_batch([pa.array([docs]), pa.array([total])], ["docs", "total"])

        return count

    model_decay = model.decay
    sums = map_arrow(rows, per_task(chance), "docs double, total double").agg(F.sum("docs"), F.sum("total")).first()
    model.scale = max(sums[0], 1.0) / max(sums[1], 1.0)
    scored = rows.sparkSession.sparkContext.broadcast(vars(model))

    def binned():
        scorer = Scorer(Model(**scored.value))

        def count(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = [min(math.floor(50 * math.log1p(scorer.evidence(t)[0])), 1000) for t in texts(batch, "text")]
            return pa.record_batch([pa.array(x, pa.int64()), batch.column("y")], ["x", "y"])

        return count

    bins = map_arrow(rows, per_task(binned), "x long, y int").groupBy("x").agg(F.sum("y").alias("y"), F.count("*").alias("n")).toArrow()
    model.bias, model.slope = fit_curve(
        (bins["x"].to_numpy() + 0.5) / 50, bins["y"].to_numpy().astype(float), bins["n"].to_numpy().astype(float)
    )
    return model


def toxicity(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, passages`` of every row; null and empty texts have no passage.

    ``passages`` are the significant segments as first token, end (exclusive) and score,
    tokens being lower-cased words without punctuation. Repeated rows come out repeated.
    """
    sent = df.sparkSession.sparkContext.broadcast(vars(model))
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def task():
        scorer = Scorer(Model(**sent.value))

        def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [scorer.evidence(t) for t in texts(batch, "text")]
            return pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array([scorer.probability(e) for e, _ in found], pa.float64()),
                    pa.array([[dict(zip(("first", "end", "score"), s)) for s in p] for _, p in found], kind),
                ],
                ["doc_id", "score", "passages"],
            )

        return rows

    named = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    key = named.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, score double, passages array<struct<first:bigint,end:bigint,score:double>>"
    return map_arrow(named, per_task(task), schema)


def without_toxic(df: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``df`` whose ``text`` scores below ``least``; all columns are kept."""
    sent = df.sparkSession.sparkContext.broadcast(vars(model))

    def task():
        scorer = Scorer(Model(**sent.value))
        return lambda batch: batch.filter(
            pa.array([scorer.probability(scorer.evidence(t)[0]) < least for t in texts(batch, "text")], pa.bool_())
        )

    return map_arrow(df, per_task(task), df.schema)
