"""A quality classifier: gradient-boosted histogram trees over document statistics.

Statistics of every whole text are computed once and stored. Trees are grown on a bounded
sample of labelled rows, whose values are cut into quantile bins; a tree of depth d is a
heap of 2^d - 1 tests, so all trees are two flat arrays and scoring steps through all rows
and trees at once, a level at a time.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartmeter.llm.common import held_out, map_arrow, texts
from chartmeter.shared import stage

#: About how many labelled rows the trees are grown on (by hash of the id).
SAMPLE = 30_000
TREES, DEPTH, BINS, RATE, PENALTY, LEAST_WEIGHT = 60, 4, 64, 0.2, 1.0, 2.0

STATISTICS = (
    "words", "chars_per_word", "upper", "digits", "spaces", "punctuation", "symbols", "marks", "bars", "not_ascii",
    "lines", "words_per_line", "same_lines", "short_lines", "distinct_words", "top_word", "distinct_pairs",
    "packed", "long_words", "one_char_words", "control",
)


def _classes() -> np.ndarray:
    groups = [
        bytes(range(65, 91)),
        bytes(range(48, 58)),
        b" \t\n\x0b\x0c\r",
        b".,;:'\"()-",
        b"#*$%&<>@^~=+_/\\{}[]",
        b"!?",
        b"|",
        bytes(range(128, 256)),
        bytes(set(range(32)) - set(b"\t\n\x0b\x0c\r")) + b"\x7f",
    ]
    out = np.zeros((256, len(groups)))
    for k, group in enumerate(groups):
        out[list(group), k] = 1
    return out


_CLASSES = _classes()


def statistics(text: bytes) -> list[float]:
    """The document statistics, in the order of ``STATISTICS``; zeros for an empty text."""
    n = len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    shares = (np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256) @ _CLASSES / n).tolist()
    upper, digits, spaces, punctuation, symbols, marks, bars, not_ascii, control = shares
    words = text.lower().split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    w, pairs = max(len(words), 1), max(len(words) - 1, 1)
    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return [
        np.log1p(len(words)),
        float(sizes.sum()) / w,
        upper, digits, spaces, punctuation, symbols, marks, bars, not_ascii,
        np.log1p(len(lines)),
        len(words) / max(len(lines), 1),
        1 - len(set(lines)) / max(len(lines), 1),
        sum(len(x) < 30 for x in lines) / max(len(lines), 1),
        len(counts) / w,
        max(counts.values(), default=0) / w,
        len(set(zip(words, words[1:]))) / pairs,
        len(zlib.compress(text, 1)) / n,
        float((sizes > 20).sum()) / w,
        float((sizes == 1).sum()) / w,
        control,
    ]


def with_statistics(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, x``: the statistics (array of double) of every row; null texts are empty."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [statistics(t) for t in texts(batch, "text")]
        return pa.record_batch([batch.column("doc_id"), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "x"])

    named = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(named, rows, "doc_id long, x array<double>")


@dataclass
class Trees:
    """``feature``, ``cut``: trees x (2^depth - 1) tests; ``leaf``: trees x 2^depth values."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row of ``x``."""
        n, trees = len(x), len(self.feature)
        if not trees:
            return np.full(n, 1 / (1 + np.exp(-self.base)))
        at = np.zeros((n, trees), dtype=np.int64)
        tree, row = np.arange(trees)[None, :], np.arange(n)[:, None]
        tests = self.feature.shape[1]
        while tests:
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.cut[tree, at])
            tests //= 2
        total = self.base + self.leaf[tree, at - self.feature.shape[1]].sum(1)
        return 1 / (1 + np.exp(-total))


def grow(
    x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE
) -> Trees:
    """Boosted trees for the log-loss of ``y`` (0, 1), by histograms of quantile bins."""
    n, features = x.shape
    p = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    nodes = 2**depth - 1
    feature, cut, leaf = (
        np.zeros((trees, nodes), dtype=np.int64),
        np.full((trees, nodes), np.inf),
        np.zeros((trees, nodes + 1)),
    )
    if not n or y.min() == y.max():
        return Trees(base, feature[:0], cut[:0], leaf[:0])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(features)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    total = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = at - first
            best = np.zeros(width)
            whole_g, whole_h = np.bincount(slot, g, width), np.bincount(slot, h, width)
            parent = whole_g**2 / (whole_h + PENALTY)
            for f in range(features):
                if not len(edges[f]):
                    continue
                key = slot * bins + binned[:, f]
                lg = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(1)[:, : len(edges[f])]
                lh = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(1)[:, : len(edges[f])]
                rg, rh = whole_g[:, None] - lg, whole_h[:, None] - lh
                gain = lg**2 / (lh + PENALTY) + rg**2 / (rh + PENALTY) - parent[:, None]
                gain[(lh < LEAST_WEIGHT) | (rh < LEAST_WEIGHT)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                better = top > best + 1e-9
                best[better] = top[better]
                feature[t, first : first + width][better] = f
                cut[t, first : first + width][better] = edges[f][k[better]]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > cut[t, at])
        slot = at - nodes
        leaf[t] = -rate * np.bincount(slot, g, nodes + 1) / (np.bincount(slot, h, nodes + 1) + PENALTY)
        total += leaf[t, slot]
    return Trees(base, feature, cut, leaf)


def train(
    stored: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, remainder: int = 0, sample: int = SAMPLE
) -> Trees:
    """Trees from about ``sample`` labelled rows at most, none of the held-out fold.

    Ids labelled twice take the higher label; rows without a label or an id teach nothing.
    Without both labels the score is the share of label 1 (one half if there are none).
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .where(~held_out("doc_id", modulus, remainder))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    n = known.count()
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(max(n, 1))) < sample)
    # Copies of a labelled row are one example.
    rows = stored.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("x").alias("x"), F.first("y").alias("y"))
    got = rows.orderBy("doc_id").select("x", "y").toArrow()
    x = np.array(got["x"].to_pylist(), dtype=float).reshape(-1, len(STATISTICS))
    return grow(x, got["y"].to_numpy().astype(float))


def quality_scores(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``doc_id, score``: the probability of label 1 for every row of ``df``.

    Empty and null texts get a score like any other; repeated rows come out repeated.
    """
    stored = stage(with_statistics(df, doc_id, text), "statistics")
    model = train(stored, labels, **options)
    sent = df.sparkSession.sparkContext.broadcast((model.base, model.feature, model.cut, model.leaf))

    def task(batches):
        trees = Trees(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = np.array(part.column("x").to_pylist(), dtype=float).reshape(-1, len(STATISTICS))
                yield pa.record_batch([part.column("doc_id"), pa.array(trees.score(x))], ["doc_id", "score"])

    return stored.mapInArrow(task, "doc_id long, score double")
