"""Short codes for vectors: eight parts, each named by the nearest of sixteen entries.

Components become integers, and distances are compared in the Walsh-Hadamard domain. The
transform of a part padded with zeros to n components keeps squared distances up to the
factor n, and its first coefficients in sequency order (slowest sign changes first) mostly
hold the greater share. So differences are accumulated coefficient by coefficient, and an
entry is out once its sum passes the whole distance of the entry that led after the first
coefficients. Sums of squares only grow, and all of them are integers: what is left at the
end are exactly the nearest entries, ties included.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmeter.shared import stage

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors whose distances are worked out at once.
_ROWS = 4096


def sequency_order(n: int) -> np.ndarray:
    """Rows of the natural Hadamard matrix of order ``n`` by their number of sign changes."""
    signs = transform(np.eye(n, dtype=np.int64))
    return np.argsort((np.diff(signs, axis=1) != 0).sum(1), kind="stable")


def transform(values: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the last axis, whose length is a power of two; integers
    stay integers."""
    out, n, half = values.astype(np.int64), values.shape[-1], 1
    while half < n:
        pairs = out.reshape(*out.shape[:-1], n // (2 * half), 2, half)
        a, b = pairs[..., 0, :], pairs[..., 1, :]
        out = np.stack([a + b, a - b], axis=-2).reshape(out.shape)
        half *= 2
    return out


def padded(parts: np.ndarray) -> np.ndarray:
    """Parts with zeros behind them, up to a power of two, transformed and in sequency order."""
    width = parts.shape[-1]
    n = 1 << max(0, width - 1).bit_length()
    wide = np.zeros((*parts.shape[:-1], n), dtype=np.int64)
    wide[..., :width] = parts
    return transform(wide)[..., sequency_order(n)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest of ``entries`` (transformed, k x n) and the squared distance, for
    every one of ``parts`` (transformed, m x n). The lower index wins a tie."""
    m, n = parts.shape
    lead = max(1, n // 4)
    sums = np.zeros((m, len(entries)), dtype=np.int64)
    for c in range(lead):
        d = parts[:, c, None] - entries[None, :, c]
        sums += d * d
    first = sums.argmin(1)
    rest = parts[:, lead:] - entries[first, lead:]
    bound = sums[np.arange(m), first] + (rest * rest).sum(1)
    row, entry = np.nonzero(sums <= bound[:, None])
    left = sums[row, entry]
    for c in range(lead, n):
        d = parts[row, c] - entries[entry, c]
        left += d * d
        in_play = left <= bound[row]
        if not in_play.all():
            row, entry, left = row[in_play], entry[in_play], left[in_play]
    # Rows ascend and keep their leader at least; so do the entries of a row.
    starts = np.searchsorted(row, np.arange(m))
    least = np.minimum.reduceat(left, starts) if m else left
    best = np.flatnonzero(left == least[row])
    best = best[np.searchsorted(row[best], np.arange(m))]
    return entry[best], least // n


def integers(vector: Column) -> Column:
    """``floor(4096 * x)`` of every component, exactly."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _parts(column: pa.Array, width: int) -> np.ndarray:
    """The rows of an Arrow list column as rows x parts x components, zeros behind short ones."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), PARTS * width), dtype=np.int64)
    out[np.arange(PARTS * width)[None, :] < lengths[:, None]] = values
    return out.reshape(len(column), PARTS, width)


def _batches(batches, width: int):
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            piece = batch.slice(at, _ROWS)
            yield piece, _parts(piece.column("v"), width)


def refined(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (parts x entries x components) after one round over ``vectors``: each
    entry becomes the floored mean of the parts nearest to it, and stays if there are none."""
    n_parts, k, width = books.shape
    coded = padded(books)

    def rows(batches):
        sums = np.zeros((n_parts * k, width + 1), dtype=np.int64)
        for _, parts in _batches(batches, width):
            wide = padded(parts)
            for p in range(n_parts):
                code, _ = nearest(wide[:, p], coded[p])
                np.add.at(sums[p * k : (p + 1) * k, width], code, 1)
                np.add.at(sums[p * k : (p + 1) * k, :width], code, parts[:, p])
        used = np.flatnonzero(sums[:, width])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * (width + 1), pa.int32()), pa.array(sums[used].ravel()))
        yield pa.record_batch([pa.array(used), lists], ["slot", "sums"])

    partial = vectors.select("v").mapInArrow(rows, "slot long, sums array<long>")
    totals = partial.groupBy("slot").agg(F.array(*(F.sum(F.col("sums")[i]) for i in range(width + 1))).alias("sums"))
    new = books.reshape(n_parts * k, width).copy()
    for slot, sums in totals.collect():  # one row an entry at most
        new[slot] = np.array(sums[:-1], dtype=np.int64) // sums[-1]
    return new.reshape(books.shape)


def vector_codes(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS
) -> DataFrame:
    """``vec_id, label, codes, error, label_error, codebooks_sha256`` of every usable row.

    Rows whose vector is null or holds a null or non-finite component go. ``codes`` is the
    index of the nearest entry per part, ``error`` the sum of their squared distances.
    Codebooks begin with the 16 rows of the smallest ids (equal ids by their vectors; null
    ids last); fewer rows make fewer entries. Vectors are as long as the longest one, or the
    next multiple of 8, with zeros behind shorter ones. Repeated rows come out repeated, no
    rows give no rows, and other columns are not looked at. Components so large that a
    distance might not fit a long are an error.
    """
    v = F.col(vector)
    kept = df.where(_usable(v)).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), integers(v).alias("v"))
    kept = stage(kept, "integer-vectors")
    widest, largest = kept.agg(
        F.max(F.size("v")), F.max(F.greatest(F.array_max("v"), -F.array_min("v")))
    ).first()
    if widest is None:
        return kept.select(
            "vec_id", "label", F.array().cast("array<int>").alias("codes"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")),
            F.lit(hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"),
        )
    width = max(1, -(-widest // PARTS))
    if PARTS * 2 * width * (2 * (largest or 0)) ** 2 >= 1 << 63:
        raise ValueError("components too large: squared distances may not fit a long")

    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    start = np.zeros((len(first), PARTS * width), dtype=np.int64)
    for i, (values,) in enumerate(first):
        start[i, : len(values)] = values
    books = start.reshape(len(first), PARTS, width).transpose(1, 0, 2)
    for _ in range(rounds):
        books = refined(kept, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = padded(books)

    def rows(batches):
        for piece, parts in _batches(batches, width):
            wide, codes, error = padded(parts), [], 0
            for p in range(PARTS):
                code, distance = nearest(wide[:, p], coded[p])
                codes.append(code)
                error = error + distance
            flat = pa.array(np.stack(codes, axis=1).ravel().astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(piece.num_rows + 1) * PARTS, pa.int32()), flat)
            yield pa.record_batch([piece.column("vec_id"), piece.column("label"), lists, pa.array(error)], ["vec_id", "label", "codes", "error"])

    types = {f.name: f.dataType.simpleString() for f in kept.schema}
    schema = f"vec_id {types['vec_id']}, label {types['label']}, codes array<int>, error long"
    scored = stage(kept.mapInArrow(rows, schema), "vector-codes")
    # A hot label is one partial sum per task, and its rows are not moved while the sums are few.
    sums = scored.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return scored.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label").withColumn("codebooks_sha256", F.lit(digest))


def code_text(codes: Column) -> Column:
    """Indexes in part order, two lowercase hex digits each."""
    return F.concat_ws("", F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
