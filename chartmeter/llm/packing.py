"""Documents packed into as few sequences of a fixed length as a local search finds.

Texts become token ids, longer documents pieces of a whole sequence and a rest. Pieces are
dealt at random into groups of a bounded size, so that each group has the mix of all. A
group begins with best fit, the longest piece first, and then exchanges pieces between its
underfull sequences: one moves, one goes for a shorter one, two for one or one for two,
whatever makes the sum of squared fills grow most, with the emptiest sequences as givers.
The sum only grows, so a giver ends empty or with nothing left to gain. What stays clearly
underfull is dealt anew, until one group holds it or a round no longer pays.
"""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartmeter.llm.common import slices, worker_cache
from chartmeter.llm.word_ids import WordIds
from chartmeter.shared import stage

LENGTH = 4096
#: Pieces of a group, on average; sequences with more room than 1 in ``ROOM`` are dealt anew.
GROUP, ROOM = 8192, 64
#: Givers and exchanges that the search tries in a group. More takes longer and finds more.
EFFORT = 1000
_COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(df: DataFrame, tokenizer: str, end: int, length: int = LENGTH) -> DataFrame:
    """``number, doc_id, piece, start, length, ids_crc32`` of the pieces of every text with
    ``end`` behind it; no two pieces have the same ``number``."""

    def rows(batches):
        words = worker_cache(("word ids", tokenizer), lambda: WordIds(tokenizer))
        number = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text", rows=10_000):
            ids, ends = words.encode(batch.column("text"))
            out: dict[str, list] = {c: [] for c in ("number", "doc_id", "piece", "start", "length", "ids_crc32")}
            begin = 0
            for key, stop in zip(batch.column("doc_id").to_pylist(), ends.tolist()):
                own = np.append(ids[begin:stop], np.uint32(end)).astype("<u4")
                begin = stop
                for k, at in enumerate(range(0, len(own), length)):
                    part = own[at : at + length]
                    for c, v in zip(out, (number, key, k, at, len(part), zlib.crc32(part.tobytes()))):
                        out[c].append(v)
                    number += 1
            arrays = [pa.array(v, pa.int32() if c == "piece" else pa.int64()) for c, v in out.items()]
            yield pa.record_batch(arrays, list(out))

    named = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(rows, "number long, " + _COLUMNS)


# -- One group -------------------------------------------------------------------------------


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Sequences of the numbers of the pieces, the longest placed first and each where least
    room is left over."""
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    found: list[list[int]] = []
    rooms = 0  # bit r: some sequence has just r left
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            found[own].append(i)
        else:
            room, own = length, len(found)
            found.append([i])
        if room > size:
            by_room[room - size].append(own)
            rooms |= 1 << (room - size)
    return found


class _Search:
    """Exchanges between underfull sequences. What a sequence can give up for something
    longer, nothing, one piece or two, stands in flat arrays: its sum, its sequence, and
    which edition of it was meant, as two sequences change with every exchange."""

    def __init__(self, sizes: np.ndarray, bins: list[list[int]], length: int):
        self.sizes, self.bins, self.length = sizes, bins, length
        self.fill = np.array([int(sizes[b].sum()) for b in bins], dtype=np.int64)
        self.edition = np.zeros(len(bins), dtype=np.int64)
        self.sums = self.owners = self.editions = self.counts = np.zeros(0, np.int64)
        self.members: list[tuple[int, ...]] = []
        self._offer([b for b in range(len(bins)) if self.fill[b] < length])

    def options(self, b: int) -> list[tuple[int, tuple[int, ...]]]:
        """One piece or two of every different length, and their sum."""
        kinds = {int(self.sizes[i]): i for i in self.bins[b]}
        twins = {}
        for i in self.bins[b]:
            if kinds[int(self.sizes[i])] != i:
                twins[int(self.sizes[i])] = i
        found = [(s, (i,)) for s, i in kinds.items()]
        found += [(s + t, (kinds[s], kinds[t])) for s, t in combinations(kinds, 2)]
        return found + [(2 * s, (kinds[s], i)) for s, i in twins.items()]

    def _offer(self, bins: list[int]) -> None:
        live = self.editions == self.edition[self.owners]
        if len(live) > 64 and live.mean() < 0.5:
            self.sums, self.owners, self.editions, self.counts = (x[live] for x in (self.sums, self.owners, self.editions, self.counts))
            self.members = [m for m, keep in zip(self.members, live.tolist()) if keep]
        new = [(s, b, m) for b in bins if self.bins[b] for s, m in [(0, ()), *self.options(b)]]
        self.members += [m for _, _, m in new]
        sums, owners = (np.array([x[k] for x in new], dtype=np.int64) for k in (0, 1))
        self.sums, self.owners = np.append(self.sums, sums), np.append(self.owners, owners)
        self.editions = np.append(self.editions, self.edition[owners])
        self.counts = np.append(self.counts, np.array([len(m) for _, _, m in new], dtype=np.int64))

    def give(self, giver: int) -> bool:
        """Makes the giver's best exchange, if any makes the sum of squared fills grow."""
        room = np.where(self.editions == self.edition[self.owners], self.length - self.fill[self.owners], 0)
        room[self.owners == giver] = 0
        taken = np.flatnonzero(room)
        sums, counts, room, fill = self.sums[taken], self.counts[taken], room[taken], self.fill[self.owners[taken]]
        best = (0, 0, ())
        for total, given in self.options(giver):
            more = total - sums
            gain = more * (fill - self.fill[giver] + more)
            gain[(more <= 0) | (more > room) | (counts != 1 if len(given) == 2 else False)] = 0
            at = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[at] > best[0]:
                best = (int(gain[at]), int(taken[at]), given)
        if not best[0]:
            return False
        _, option, given = best
        taker, back = int(self.owners[option]), self.members[option]
        more = int(self.sizes[list(given)].sum() - self.sums[option])
        self.bins[giver] = [i for i in self.bins[giver] if i not in given] + list(back)
        self.bins[taker] = [i for i in self.bins[taker] if i not in back] + list(given)
        for b, change in ((giver, -more), (taker, more)):
            self.fill[b] += change
            self.edition[b] += 1
        self._offer([b for b in (giver, taker) if 0 < self.fill[b] < self.length])
        return True


def packed(sizes: np.ndarray, length: int = LENGTH, effort: int = EFFORT) -> list[list[int]]:
    """Numbers of the pieces (none longer than ``length``) of every sequence."""
    bins = best_fit(sizes, length)
    least = -(-int(sizes.sum()) // length)
    if len(bins) <= least:
        return bins
    search, tried = _Search(sizes, bins, length), 0
    used = len(bins)
    gained = True
    while gained and used > least and tried < effort:
        gained = False
        for giver in np.argsort(search.fill, kind="stable").tolist():
            while 0 < search.fill[giver] < length and tried < effort:
                tried += 1
                if not search.give(giver):
                    break
                gained = True
            if search.fill[giver] == 0 and bins[giver] == []:
                used = int((search.fill > 0).sum())
            if used <= least or tried >= effort:
                break
    return [b for b in bins if b]


# -- All groups ------------------------------------------------------------------------------


def pack(df: DataFrame, tokenizer: str, end: int, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    ``df`` has ``doc_id`` and ``text`` (null: empty, so just the end id); other columns are
    not looked at, and repeated rows are documents of their own. ``start`` counts the
    document's ids before the piece, ``offset`` those before it in its sequence.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    cut = stage(pieces(df, tokenizer, end, length), "pieces")
    full = cut.where(F.col("length") == length)
    done = [full.select(*names[:5], (-1 - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left, round_ = cut.where(F.col("length") < length), 0
    n = left.count()
    while n:
        groups, round_ = -(-n // group), round_ + 1
        out = stage(_dealt(left, groups, round_, length), "packed")
        room = length - F.col("fill")
        again = out.where(room * ROOM > length)
        before, n = n, 0 if groups == 1 else again.count()
        if 2 * n > before:  # most of them fill sequences as well as they will
            n = 0
        done.append((out.where(room * ROOM <= length) if n else out).select(names))
        left = again.select(cut.columns)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def _dealt(left: DataFrame, groups: int, round_: int, length: int) -> DataFrame:
    """The pieces with their sequences, every group's by itself."""

    def one(key, table):
        sizes = table.column("length").to_numpy().astype(np.int64)
        bins = packed(sizes, length)
        number, offset, fill = (np.zeros(len(sizes), dtype=np.int64) for _ in range(3))
        for k, own in enumerate(bins):
            ends = np.cumsum(sizes[own])
            number[own], offset[own], fill[own] = k, ends - sizes[own], ends[-1]
        number += (round_ << 56) + (key[0].as_py() << 24)
        table = table.drop_columns(["dealt"])
        for name, values in (("sequence_id", number), ("offset", offset), ("fill", fill)):
            table = table.append_column(name, pa.array(values))
        return table

    dealt = left.withColumn("dealt", F.pmod(F.xxhash64(F.lit(round_), "number"), F.lit(groups)).cast("long"))
    schema = f"number long, {_COLUMNS}, sequence_id long, offset long, fill long"
    return dealt.groupBy("dealt").applyInArrow(one, schema)
