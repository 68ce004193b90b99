"""What the operators share: words, folds and passes over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but these: space, tab, newline, vertical tab, form feed,
#: carriage return. ``bytes.split()`` splits at the same six.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a batch taken at once in Python, and the text bytes that end a slice early.
ROWS, BYTES = 2000, 16 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body (or a lambda
    in it) names it."""
    return F.transform(F.array(value), body)[0]


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(modulus))


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether a row is in the held-out fold. A row without an id never is."""
    return F.coalesce(fold(doc_id, modulus) == remainder, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], text: str, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds few rows and, unless one row alone is longer, few
    bytes of text; rows stay whole and in order."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(text)).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if i > start and (i - start >= rows or held + (n or 0) > BYTES):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The column as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def map_arrow(df: DataFrame, rows: Callable, schema: str, text: str = "text") -> DataFrame:
    """``rows(slice)`` for bounded slices of every batch. ``rows`` may be a factory with an
    attribute ``per_task``: then it is called once in each task and gives the function."""

    def run(batches):
        import pyarrow.compute  # noqa: F401

        one = rows() if getattr(rows, "per_task", False) else rows
        for piece in slices(batches, text):
            out = one(piece)
            if out is not None and out.num_rows:
                yield out
        pa.default_memory_pool().release_unused()  # the worker lives on for other stages

    return df.mapInArrow(run, schema)


def per_task(factory: Callable) -> Callable:
    factory.per_task = True
    return factory


def worker_cache(key: tuple, make: Callable):
    """What ``make`` gives, kept for the life of the Python worker (tasks come and go).

    Functions reach a worker as new copies with each task, so their own module cannot
    hold it.
    """
    import sys
    import types

    held = sys.modules.setdefault("_worker_cache", types.ModuleType("_worker_cache")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]
