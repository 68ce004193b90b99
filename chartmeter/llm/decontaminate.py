"""Benchmark items contained in documents: size-partitioned MinHash search, exact check.

An item of n different shingles counts as contained if at least ``THRESHOLD`` of them are
in the document. Then at most n - ceil(0.8 n) are missing, so any of its shingles that
are one more than that include one the document has. The item's sketch is that many
of its smallest hashes (bottom-k MinHash, k by size), hence no contained item is missed.
Items are partitioned by size, powers of two: a partition has one bound that all its
sketch hashes lie below, and a document's shingles are looked up there only if they do
too. Candidates are settled on the words themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartmeter.llm.common import map_arrow, per_task, texts

SHINGLE = 5
#: Least share of an item's shingles, as a fraction of whole numbers.
THRESHOLD = (4, 5)
#: Bytes of item text that are held at once, here and in every task.
BLOCK_BYTES = 8 << 20

_FACTORS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def shingles(tokens: list[bytes], width: int) -> list[bytes]:
    return [b" ".join(tokens[i : i + width]) for i in range(len(tokens) - width + 1)]


def hashes(tokens: list[bytes], width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; equal runs have equal hashes."""
    n = len(tokens) - width + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    each = np.fromiter(map(zlib.crc32, tokens), dtype=np.uint64, count=len(tokens))
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total += each[k : k + n] * _FACTORS[k]
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(29))


def needed(n: int) -> int:
    """Shingles of ``n`` that have to be there."""
    return -(-n * THRESHOLD[0] // THRESHOLD[1])


class Index:
    """Sketches of a block of items by shingle width and size."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items: list[tuple[int, frozenset[bytes]]] = []
        parts: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for item_id, text in items:
            tokens = words(text)
            if not tokens:
                continue
            width = min(SHINGLE, len(tokens))
            own = frozenset(shingles(tokens, width))
            # By string, as two shingles may share a hash: each must count for itself.
            ranked = sorted(int(hashes(s.split(), width)[0]) for s in own)
            size = len(own).bit_length()
            sketch = ranked[: len(own) - needed(len(own)) + 1]
            parts.setdefault((width, size), []).extend((h, len(self.items)) for h in sketch)
            self.items.append((item_id, own))
        self.parts = []
        for (width, _), pairs in sorted(parts.items()):
            pairs.sort()
            keys = np.array([h for h, _ in pairs], dtype=np.uint64)
            self.parts.append((width, keys, np.array([i for _, i in pairs], dtype=np.int64)))

    def contained(self, tokens: list[bytes]) -> list[tuple[int, int, int]]:
        """``item_id``, its shingles and those found, for every item the words contain."""
        found, by_width, candidates = [], {}, set()
        for width, keys, owners in self.parts:
            if width not in by_width:
                by_width[width] = hashes(tokens, width)
            low = by_width[width]
            low = low[low <= keys[-1]]
            first = np.searchsorted(keys, low)
            hit = keys[first] == low
            for a, b in zip(first[hit], np.searchsorted(keys, low[hit], side="right")):
                candidates.update(owners[a:b].tolist())
        have: dict[int, set[bytes]] = {}
        for i in sorted(candidates):
            item_id, own = self.items[i]
            width = len(next(iter(own)).split())
            if width not in have:
                have[width] = set(shingles(tokens, width))
            n = len(own & have[width])
            if n >= needed(len(own)):
                found.append((item_id, len(own), n))
        return found


def blocks(items: DataFrame, item_id: str, text: str, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """Items in blocks of at most ``limit`` bytes (or one longer item); null texts are left out."""
    block, size = [], 0
    for row in items.select(item_id, text).where(F.col(text).isNotNull()).toLocalIterator():
        data = row[1].encode()
        if block and size + len(data) > limit:
            yield block
            block, size = [], 0
        block.append((row[0], data))
        size += len(data) + 64
    if block:
        yield block


def _searcher(df: DataFrame, block: list[tuple[int, bytes]]):
    sent = df.sparkSession.sparkContext.broadcast(block)
    return lambda: Index(sent.value)


def contained_items(
    df: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    limit: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_found`` for every document and item it contains.

    Words are lower-cased (A-Z) runs without white space, shingles have five of them; an
    item of fewer words is one shingle of all its words. Items without words, null texts
    and empty tables give no rows. Rows repeated in either table give repeated pairs; ids
    may be null. Items are searched for in blocks, each in a pass over the documents.
    """
    schema = "doc_id long, item_id long, n_shingles long, n_found long"
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = df.sparkSession.createDataFrame([], schema)
    source = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    for k, block in enumerate(blocks(source, "i", "t", limit)):
        make = _searcher(df, block)

        def task(make=make):
            index = make()

            def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
                ids = batch.column("doc_id").to_pylist()
                hits = [(d, *hit) for d, t in zip(ids, texts(batch, "text")) for hit in index.contained(words(t))]
                columns = [list(c) for c in zip(*hits)] or [[], [], [], []]
                return pa.record_batch(
                    [pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "n_shingles", "n_found"]
                )

            return rows

        found = map_arrow(docs, per_task(task), schema)
        out = found if k == 0 else out.unionByName(found)
    return out


def without_items(df: DataFrame, items: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``df`` whose ``text`` contains no item; all columns are kept as they are."""
    out = df
    source = items.select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t"))
    for block in blocks(source, "i", "t", limit):
        make = _searcher(df, block)

        def task(make=make):
            index = make()
            return lambda batch: batch.filter(
                pa.array([not index.contained(words(t)) for t in texts(batch, "text")], pa.bool_())
            )

        out = map_arrow(out, per_task(task), df.schema)
    return out
