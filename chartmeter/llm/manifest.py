"""Merkle manifest of a dataset: a tree of hashes per group, and a tree over the groups' roots.

A leaf's place in its group's ascending order of ids comes from bitmaps, without sorting
leaves. Every task ORs its ids into 64-bit words, keyed by group and id / 64, so that only
words with a member exist; the words of all tasks are merged; and directories of popcounts
(per 2^16, 2^32 and 2^48 ids, so that none has more than 2^16 entries below one of the next)
say how many leaves lie before each word. A leaf's rank is that start and the bits below its
own. Ranks are coordinates: 4,096 leaves that follow one another are put into the slots of
an array by key, which one task folds up four levels, and the arrays' digests are the
leaves of the next round.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartmeter.llm.common import map_arrow, per_task, texts
from chartmeter.shared import stage

#: Children of a node, levels that one array of slots is folded by, and its slots.
FAN, DEPTH = 8, 4
SLOTS = FAN**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: bytes) -> bytes:
    """Lowercase hex of the SHA-256 of the parts, one after another."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def field(value: bytes | None) -> bytes:
    return b"-" if value is None else b"%d:%b" % (len(value), value)


def leaf(doc_id: int | None, source: bytes | None, lang: bytes | None, n_chars: int | None, text: bytes | None) -> bytes:
    numbers = [None if n is None else b"%d" % n for n in (doc_id, n_chars)]
    return digest(field(numbers[0]), field(source), field(lang), field(numbers[1]), field(text))


def levels(nodes: list[bytes], depth: int) -> list[list[bytes]]:
    """``nodes`` and the ``depth`` levels above them: every run of eight becomes its digest."""
    found = [nodes]
    for _ in range(depth):
        nodes = [digest(*nodes[at : at + FAN]) for at in range(0, len(nodes), FAN)]
        found.append(nodes)
    return found


def height(total: int) -> int:
    """Levels above the leaves of a tree with ``total`` of them."""
    found = 0
    while total > 1:
        total, found = -(-total // FAN), found + 1
    return found


def path_within(found: list[list[bytes]], slot: int) -> list[tuple[int, bytes]]:
    """Per level, the place of the node over ``slot`` in its run, and the run's others."""
    path = []
    for nodes in found[:-1]:
        at = slot - slot % FAN
        path.append((slot - at, b"".join(nodes[at:slot]) + b"".join(nodes[slot + 1 : at + FAN])))
        slot //= FAN
    return path


def folded(node: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The digest at the end of ``path`` that follows from ``node`` and the others on it."""
    for at, others in path:
        node = digest(others[: len(node) * at], node, others[len(node) * at :])
    return node


# -- Leaves and their places -----------------------------------------------------------------


def leaves(df: DataFrame) -> DataFrame:
    """``tree, doc_id, row, leaf, tampered`` of every row; ``tampered`` is the leaf of the text
    with A-Z in lower case where 3 divides the crc32 of the id, and null elsewhere. ``tree``
    is empty for a null group and starts with + for others; ``row`` differs for all rows."""

    def factory():
        part, seen = TaskContext.get().partitionId() << 40, 0

        def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal seen
            ids, n_chars = (batch.column(c).to_pylist() for c in ("doc_id", "n_chars"))
            strings = [[None if v is None else v.encode() for v in batch.column(c).to_pylist()] for c in ("source", "lang")]
            null = batch.column("text").is_null().to_pylist()
            own, other = [], []
            for i, source, lang, n, text, no in zip(ids, *strings, n_chars, texts(batch, "text"), null):
                own.append(bytes.fromhex(leaf(i, source, lang, n, None if no else text).decode()))
                changed = i is not None and zlib.crc32(b"%d" % i) % 3 == 0
                other.append(bytes.fromhex(leaf(i, source, lang, n, None if no else text.lower()).decode()) if changed else None)
            numbers = range(part + seen, part + seen + len(ids))
            seen += len(ids)
            columns = [batch.column("tree"), batch.column("doc_id"), pa.array(numbers, pa.int64())]
            return pa.record_batch(
                [*columns, pa.array(own, pa.binary()), pa.array(other, pa.binary())],
                ["tree", "doc_id", "row", "leaf", "tampered"],
            )

        return rows

    types = {"doc_id": "long", "n_chars": "long"}
    named = df.select(
        F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        *(F.col(c).cast(types.get(c, "string")).alias(c) for c in FIELDS),
    )
    return map_arrow(named, per_task(factory), "tree string, doc_id long, row long, leaf binary, tampered binary")


def _word(doc_id: str = "doc_id") -> Column:
    return F.shiftright(F.col(doc_id), 6)


def _bit(doc_id: str = "doc_id") -> Column:
    return F.col(doc_id).bitwiseAND(F.lit(63).cast("long")).cast("int")


def _shifted(value: int, by: Column) -> Column:
    return F.call_function("shiftleft", F.lit(value).cast("long"), by)


def rank_words(found: DataFrame) -> DataFrame:
    """``tree, word, bits, n, start, total`` for the words of all ids of ``found``.

    ``n`` counts the word's rows, of which there are more than bits if an id is repeated;
    ``start`` the rows of the tree with smaller ids, null ones among them.
    """
    words = (
        found.where("doc_id IS NOT NULL")
        .groupBy("tree", _word().alias("word"))
        .agg(F.bit_or(_shifted(1, _bit())).alias("bits"), F.count("*").alias("n"))
    )
    words = stage(words, "bitmaps")
    trees = found.groupBy("tree").agg(F.count("*").alias("total"), F.count_if(F.isnull("doc_id")).alias("start"))

    # Counts of the words, of 2^16 ids, of 2^32 and of 2^48: each level's own key, and by how
    # many bits that of the level above is shorter.
    tables = [words]
    for shift in (10, 16, 16):
        above = F.shiftright("word", shift).alias("word")
        tables.append(tables[-1].groupBy("tree", above).agg(F.sum("n").alias("n")))
    up = trees.select("tree", F.lit(None).cast("long").alias("above"), "start", "total")
    for table, shift in zip(reversed(tables), (0, 16, 16, 10)):
        above = F.shiftright("word", shift) if shift else F.lit(None).cast("long")
        earlier = Window.partitionBy("tree", "above").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
        inside = table.withColumn("above", above).withColumn("inside", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        up = up.withColumnsRenamed({"tree": "_tree", "above": "_above"})
        met = (F.col("tree") == F.col("_tree")) & F.col("above").eqNullSafe(F.col("_above"))
        placed = inside.join(up, met).withColumn("start", F.col("start") + F.col("inside"))
        up = placed.select("tree", F.col("word").alias("above"), "start", "total", *(c for c in ("bits", "n") if table is words))
    return stage(up.withColumnRenamed("above", "word"), "rank-directory")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``at``, its rows' numbers from 0 in the order of some columns. Ranges are
    sorted by themselves; only their sizes, one row a task, are added up in one place."""
    columns = [*df.columns, "part", "at"]

    def rows(batches):
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.record_batch([*batch.columns, pa.array([part] * n, pa.int64()), pa.array(range(seen, seen + n), pa.int64())], columns)
            seen += n

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", part long, at long"
    ranged = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(rows, schema), "ranges")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return ranged.join(F.broadcast(before), "part").withColumn("at", F.col("at") + F.col("before")).select(columns[:-2] + ["at"])


def ranked(found: DataFrame) -> DataFrame:
    """``tree, total, at, doc_id, leaf, tampered``: every leaf with its place among the
    ``total`` of its tree. Null ids come first; equal ids are ordered by their leaves."""
    words = rank_words(found)
    below = F.col("bits").bitwiseAND(F.bitwise_not(_shifted(-1, _bit())))
    names = ["tree", "total", "at", "doc_id", "leaf", "tampered"]
    crowded = F.col("n") > F.bit_count("bits")
    keyed = found.withColumn("word", _word())
    plain = keyed.join(words.where(~crowded), ["tree", "word"])
    plain = plain.withColumn("at", F.col("start") + F.bit_count(below)).select(names)
    # Words in which an id is repeated, and null ids: their rows are numbered in order.
    ties = words.where(crowded).select("tree", "word", "start", "total")
    nameless = found.where("doc_id IS NULL").select("tree").distinct()
    if ties.isEmpty() and nameless.isEmpty():
        return plain
    totals = found.groupBy("tree").agg(F.count("*").alias("total"))
    nulls = nameless.join(totals, "tree").select("tree", F.lit(None).cast("long").alias("word"), F.lit(0).cast("long").alias("start"), "total")
    groups = ties.unionByName(nulls).withColumnsRenamed({"tree": "_tree", "word": "_word"})
    met = (F.col("tree") == F.col("_tree")) & F.col("word").eqNullSafe(F.col("_word"))
    rows = numbered(keyed.join(groups, met).drop("_tree", "_word"), "tree", "doc_id", "leaf", "row")
    first = rows.groupBy(F.col("tree").alias("_tree"), F.col("word").alias("_word")).agg(F.min("at").alias("first"))
    tied = rows.join(first, met).withColumn("at", F.col("start") + F.col("at") - F.col("first"))
    return plain.unionByName(tied.select(names))


# -- Trees -----------------------------------------------------------------------------------


def slotted(nodes: DataFrame, *more: str) -> DataFrame:
    """One row ``tree, chunk, total, slots`` per 4,096 places; the slots carry ``leaf`` and more."""
    slot = F.struct(F.col("at").bitwiseAND(F.lit(SLOTS - 1).cast("long")).cast("int").alias("slot"), "leaf", *more)
    chunk = F.shiftright("at", SLOTS.bit_length() - 1).alias("chunk")
    return stage(nodes.groupBy("tree", chunk, "total").agg(F.collect_list(slot).alias("slots")), "slots")


def _folded(slots: list[dict], total: int) -> list[list[bytes]]:
    nodes: list = [b""] * len(slots)
    for s in slots:
        nodes[s["slot"]] = s["leaf"].hex().encode()
    return levels(nodes, min(DEPTH, height(total)))


def tops(chunks: DataFrame) -> DataFrame:
    """The arrays' digests as nodes of the next round: ``tree, at, total, leaf``."""

    def rows(batches):
        for batch in batches:
            tree, chunk, total = (batch.column(c).to_pylist() for c in ("tree", "chunk", "total"))
            leaf = [bytes.fromhex(_folded(batch.column("slots")[i].as_py(), n)[-1][0].decode()) for i, n in enumerate(total)]
            totals = [-(-n // SLOTS) for n in total]
            columns = [tree, pa.array(chunk, pa.int64()), pa.array(totals, pa.int64()), pa.array(leaf, pa.binary())]
            yield pa.record_batch(columns, ["tree", "at", "total", "leaf"])

    plain = chunks.withColumn("slots", F.transform("slots", lambda s: F.struct(s["slot"].alias("slot"), s["leaf"].alias("leaf"))))
    return stage(plain.mapInArrow(rows, "tree string, at long, total long, leaf binary"), "nodes")


PATH = "array<struct<at: int, others: binary>>"


def paths(chunks: DataFrame, above: DataFrame) -> DataFrame:
    """``tree, at, path, subroot, root`` of every slot, from the paths ``above`` of the arrays."""

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                found, n = _folded(r["slots"], r["total"]), len(r["slots"])
                own = [[{"at": a, "others": o} for a, o in path_within(found, s)] + r["path"] for s in range(n)]
                at = range(r["chunk"] * SLOTS, r["chunk"] * SLOTS + n)
                path = pa.array(own, pa.list_(pa.struct([("at", pa.int32()), ("others", pa.binary())])))
                columns = [[r["tree"]] * n, pa.array(at, pa.int64()), path]
                columns += [pa.array([r[c]] * n, pa.binary()) for c in ("subroot", "root")]
                yield pa.record_batch(columns, ["tree", "at", "path", "subroot", "root"])

    schema = f"tree string, at long, path {PATH}, subroot binary, root binary"
    return stage(_under(chunks, above).mapInArrow(rows, schema), "paths")


def _under(chunks: DataFrame, above: DataFrame) -> DataFrame:
    up = above.withColumnsRenamed({"tree": "_tree", "at": "_at"})
    return chunks.join(up, (F.col("tree") == F.col("_tree")) & (F.col("chunk") == F.col("_at"))).drop("_tree", "_at")


def grown(nodes: DataFrame, *more: str) -> tuple[list[DataFrame], DataFrame]:
    """The arrays of every round, lowest first, and the one node that is left of each tree."""
    chunks, rounds = slotted(nodes, *more), 1
    found = [chunks]
    largest = chunks.agg(F.max("total")).first()[0] or 0
    nodes = tops(chunks)
    while largest > SLOTS**rounds:
        chunks = slotted(nodes)
        found.append(chunks)
        nodes, rounds = tops(chunks), rounds + 1
    return found, nodes


def manifest(df: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    ``df`` has the columns ``doc_id, source, lang, n_chars, text``; others are not looked at.
    A leaf is the digest of all five. Trees are grown per ``lang`` over ascending ids, and one
    over their roots, null first. ``folded_root`` is what follows from the row's siblings and
    its leaf, tampered with where 3 divides the id's crc32; a row is verified if that is the
    root. Null ids come before others and are not tampered with; rows that share an id are
    ordered by their leaves, and repeated rows are leaves of their own. No rows give no rows.
    """
    found = stage(leaves(df), "leaves")
    trees, subroots = grown(ranked(found), "doc_id", "tampered")
    over = numbered(subroots.select("tree", "leaf"), "tree").withColumn("total", F.lit(subroots.count()).cast("long"))
    over = stage(over, "subroots")
    roof, root = grown(over.select(F.lit("").alias("tree"), "at", "total", "leaf"))
    above = root.select("tree", "at", F.array().cast(PATH).alias("path"), F.col("leaf").alias("subroot"), F.col("leaf").alias("root"))
    for chunks in reversed(roof):
        above = paths(chunks, above)
    above = above.drop("tree", "subroot").join(over.select("tree", "at", F.col("leaf").alias("subroot")), "at")
    above = above.withColumn("at", F.lit(0).cast("long")).select("tree", "at", "path", "subroot", "root")
    for chunks in reversed(trees[1:]):
        above = paths(chunks, above)

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield proofs({c: batch.column(c)[i].as_py() for c in batch.schema.names})

    names = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _under(trees[0], above).mapInArrow(rows, names)


def proofs(row: dict) -> pa.RecordBatch:
    """The result rows of one array of leaves: its slots, and the path above it."""
    found, slots = _folded(row["slots"], row["total"]), sorted(row["slots"], key=lambda s: s["slot"])
    above = [(p["at"], p["others"]) for p in row["path"]]
    rest, ends = b"".join(o for _, o in above), {}
    subroot, root = row["subroot"].hex(), row["root"].hex()
    out: dict[str, list] = {c: [] for c in ("doc_id", "leaf", "proof_sha256", "folded_root", "verified")}
    for s in slots:
        own = path_within(found, s["slot"])
        top = folded((s["tampered"] or s["leaf"]).hex().encode(), own)
        if top not in ends:  # the way from there on is the same for all slots
            ends[top] = folded(top, above).decode()
        out["doc_id"].append(s["doc_id"])
        out["leaf"].append(s["leaf"].hex())
        out["proof_sha256"].append(digest(*(o for _, o in own), rest).decode())
        out["folded_root"].append(ends[top])
        out["verified"].append(ends[top] == root)
    n = len(slots)
    out |= {"subroot": [subroot] * n, "root": [root] * n}
    types = {"doc_id": pa.int64(), "verified": pa.bool_()}
    order = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return pa.record_batch([pa.array(out[c], types.get(c, pa.string())) for c in order], order)
