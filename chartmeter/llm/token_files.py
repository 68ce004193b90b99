"""Token ids of documents in compressed files, in ascending order of the documents.

Documents are dealt by ranges of their id, encoded, and written as segments of whole
documents: a table of their ids and lengths, and all token ids as one stream of
independent blocks (``id_coder``). Segments are rows of a Parquet table in the shared
folder, so any store that Spark writes to will do, and a lost task writes its own again.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartmeter.llm.common import slices, texts, worker_cache
from chartmeter.llm.id_coder import pack, unpack
from chartmeter.llm.word_ids import WordIds, fits

#: Ids of a segment; only a longer document makes a longer one.
SEGMENT = 4 << 20
#: Rows whose texts are encoded at once, if these are short.
ROWS = 5000
#: Words whose ids a worker remembers, and the longest of these in bytes.
MEMO, MEMO_BYTES = 400_000, 64


class WordTokenizer:
    """The tokenizers library on words between white space, each different one once.

    That equals encoding the whole text for tokenizers that drop white space and never join
    what it separates, as this one's normalizer and splitting do.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library, self.memo = Tokenizer.from_file(path), {}

    def encode(self, text: bytes) -> np.ndarray:
        words = text.split()
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        new = list(set(words).difference(memo))
        extra = {}
        if new:
            found = self.library.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
            for word, ids in zip(new, found):
                own = np.array(ids.ids, dtype="<u4").tobytes()
                (memo if len(word) <= MEMO_BYTES else extra)[word] = own
        if extra:
            data = b"".join(memo[w] if w in memo else extra[w] for w in words)
        else:
            data = b"".join(map(memo.__getitem__, words))
        return np.frombuffer(data, dtype="<u4")

    def encode_all(self, batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the end of each text's ids, as ``WordIds`` gives them."""
        found = [self.encode(x) for x in texts(batch, name)]
        return np.concatenate([np.zeros(0, "<u4"), *found]), np.cumsum([len(x) for x in found], dtype=np.int64)


def _encoder(path: str):
    """Gives the ids of a batch's texts, and where each ends, in the fastest way that is exact."""
    if fits(path):
        words = WordIds(path)
        return lambda batch, name: words.encode(batch.column(name))
    return WordTokenizer(path).encode_all


def write(df: DataFrame, path: str, tokenizer: str, end: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of every row's whole text (null: empty), ``end`` after each document.

    Rows come in ascending order of ``doc_id``, null first; rows that repeat an id follow
    one another. Other columns are left out.
    """
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # The text's hash only spreads the rows of an id that a great many share.
    ordered = docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def segments(batches):
        import pyarrow.compute  # noqa: F401

        encode = worker_cache(("words", tokenizer), lambda: _encoder(tokenizer))
        part, number = TaskContext.get().partitionId(), 0
        ids, lengths, arrays, size = [], [], [], 0

        def out():
            return pa.record_batch(
                [
                    pa.array([part], pa.int64()),
                    pa.array([number], pa.int64()),
                    pa.array([size], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([pack(np.concatenate(arrays))], pa.binary()),
                ],
                ["part", "number", "n_ids", "doc_ids", "lengths", "data"],
            )

        for piece in slices(batches, "text", ROWS):
            found, ends = encode(piece, "text")
            own = np.insert(found.astype(np.uint32, copy=False), ends, np.uint32(end))
            ends = ends + np.arange(1, len(ends) + 1)
            sizes = np.diff(ends, prepend=0).tolist()
            for key, n, stop in zip(piece.column("doc_id").to_pylist(), sizes, ends.tolist()):
                if ids and size + n > SEGMENT:
                    yield out()
                    ids, lengths, arrays, size, number = [], [], [], 0, number + 1
                ids.append(key)
                lengths.append(n)
                arrays.append(own[stop - n : stop])
                size += n
        if ids:
            yield out()

    schema = "part long, number long, n_ids long, doc_ids array<long>, lengths array<long>, data binary"
    ordered.mapInArrow(segments, schema).write.parquet(path)


def placed(spark: SparkSession, path: str) -> DataFrame:
    """The segments at ``path``, each with ``start``: the ids in all segments before it."""
    stored = spark.read.parquet(path)
    # One row per task that wrote, then one per segment: no document is gathered.
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("all"))
    before = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("of_parts"))
    sizes = stored.select("part", "number", "n_ids").join(before, "part")
    earlier = F.sum("n_ids").over(Window.partitionBy("part").orderBy("number")) - F.col("n_ids")
    starts = sizes.select("part", "number", (F.col("of_parts") + earlier).alias("start"))
    return stored.join(starts, ["part", "number"])


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, if wanted, ``ids`` of every document.

    ``start`` counts the ids of all documents before it. Blocks are decoded one segment at a
    time and checked; damage is an error, never a wrong row.
    """

    def rows(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in ("start", "doc_ids", "lengths", "data")}
                found = unpack(row["data"].as_py())
                lengths = np.array(row["lengths"].as_py(), dtype=np.int64)
                ends = np.cumsum(lengths)
                first = ends - lengths
                own = [found[a:b] for a, b in zip(first.tolist(), ends.tolist())]
                columns = [
                    pa.array(row["doc_ids"].as_py(), pa.int64()),
                    pa.array(first + row["start"].as_py()),
                    pa.array(lengths),
                    pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(found.astype(np.int32))))
                    names.append("ids")
                yield pa.record_batch(columns, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    return placed(spark, path).select("start", "doc_ids", "lengths", "data").mapInArrow(rows, schema)
