"""A range coder for token ids whose predictions of order 0 to 2 are mixed adaptively.

Ids are cut into blocks of ``BLOCK``. Each block starts from an untrained model and has its own
checksum; the blocks of a segment share only a table of how often each id is in it, so that they
are read one by one. Here many blocks are coded in step, one array element (lane) each. For
every id

- order 2 (by the two ids before) and order 1 (by the one before) each name the id that last
  followed there, with a count of how often that held;
- the chance that order 2's id is right is a logistic mix of adaptive log-odds by the counts of
  both orders and of the log-odds by order 0, with weights that learn from every outcome, and so
  is the chance of order 1's id if the former is wrong;
- what is left is shared out by order 0, the frequencies of the ids in the segment.

All three are parts of one interval, so an id is one step of the coder. That keeps 63 bits;
carries are added to the words behind when a block ends. Everything is integer arithmetic but
for one division of a reader, whose result is checked.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

BLOCK = 512
#: Blocks coded in step.
LANES = 8192
MAGIC = b"IDS2"
#: Contexts of a block: groups of one place for order 1 and three for order 2 behind the same id.
_GROUPS = 1 << 7
_COUNTS = 4  # counts are 0 (nothing named) to 3
_PART, _WHOLE = 13, 18  # bits of a chance, and of the frequencies of order 0
_ONE, _MASK = 1 << _PART, (1 << 31) - 1
_REACH = 2047  # log-odds are in 1/256
_FASTER, _LEARN = 3, 12  # shifts of what an error adds to log-odds (in 1/4096) and to weights

_STRETCH = np.array(
    [max(-_REACH, min(_REACH, round(256 * math.log((x + 0.5) / (4095.5 - x))))) for x in range(4096)], dtype=np.int32
)
_SQUASH = np.array(
    [max(4, min(_ONE - 4, round(_ONE / (1 + math.exp(-x / 256))))) for x in range(-_REACH, _REACH + 1)], dtype=np.int32
)
#: The next count by the one before, if the named id was wrong, then if it was right.
_NEXT = np.array([1, 1, 1, 1, 1, 2, 3, 3], dtype=np.int32)
#: First log-odds by the count: chances of 0.3, 0.3, 0.42 and 0.6, and 0.6 times these after a miss.
_HOLDS = np.array([-3471, -3471, -1322, 1661], dtype=np.int32)
_HOLDS_THEN = np.array([-6211, -6211, -4456, -2357], dtype=np.int32)
#: First weights, in 1/16384: by the own count, by both counts, by order 0; then of order 1's id.
_FIRST, _SECOND = (8000, 4000, 3000), (8000, 3000)


class _Order0:
    """Shares of ``1 << _WHOLE`` by the counts of all 65,536 ids; an id that is there has at least one."""

    def __init__(self, counts: np.ndarray):
        present = counts > 0
        free = (1 << _WHOLE) - int(present.sum())
        self.size = np.where(present, 1 + counts * free // max(int(counts.sum()), 1), 0)
        self.size[np.argmax(self.size)] += (1 << _WHOLE) - int(self.size.sum())
        #: Where an id's share begins, and its size in the lower bits.
        self.places = (np.cumsum(self.size) - self.size) << 20 | self.size
        self.odds = _STRETCH[np.minimum(self.size >> (_WHOLE - 12), 4095)]

    def ids(self) -> np.ndarray:
        """The id at every place."""
        return np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)


class _Writer:
    def __init__(self, lanes: int, steps: int):
        self.low = np.zeros(lanes, dtype=np.uint64)
        self.range = np.full(lanes, (1 << 63) - 1, dtype=np.int64)
        # A word for every step at most, each with room for a carry.
        self.words = np.zeros((steps + 1) * lanes, dtype=np.uint64)
        self.at, self.lanes = np.arange(lanes), lanes

    def narrow(self, first, size, unit):
        g = len(size)
        low = self.low[:g]
        first *= unit
        low += first.view(np.uint64)
        size *= unit
        due = np.flatnonzero(size <= _MASK)
        if len(due):
            own, at = low[due], self.at[due]
            self.words[at] = own >> np.uint64(31)
            self.at[due] = at + self.lanes
            low[due] = (own & np.uint64(_MASK)) << np.uint64(32)
            size[due] <<= 32
        self.range[:g] = size

    def finish(self) -> list[bytes]:
        self.words[self.at] = (self.low + np.uint64(_MASK)) >> np.uint64(31)
        sizes = self.at // self.lanes + 1
        words = self.words.reshape(-1, self.lanes)[: int(sizes.max())]
        carry = np.zeros(self.lanes, dtype=np.uint64)
        for row in words[::-1]:
            row += carry
            np.right_shift(row, np.uint64(32), out=carry)
        words = np.ascontiguousarray(words.astype("<u4").T)
        return [words[k, :n].tobytes() for k, n in enumerate(sizes.tolist())]


class _Reader:
    def __init__(self, words: list[np.ndarray]):
        lanes = len(words)
        held = np.zeros((max(map(len, words)) + 3, lanes), dtype=np.int64)
        for k, w in enumerate(words):
            held[: len(w), k] = w
        # The interval has 63 bits: shifted by one, whole words follow the first 31 bits.
        held[1:] = (held[:-1] & 1) << 31 | held[1:] >> 1
        held[0] >>= 1
        self.code = held[0] << 32 | held[1]
        self.words, self.lanes = held.reshape(-1), lanes
        self.at = np.arange(lanes) + 2 * lanes
        self.range = np.full(lanes, (1 << 63) - 1, dtype=np.int64)

    def narrow(self, first, size, unit):
        g = len(size)
        code = self.code[:g]
        first *= unit
        code -= first
        size *= unit
        due = np.flatnonzero(size <= _MASK)
        if len(due):
            at = self.at[due]
            code[due] = code[due] << 32 | self.words.take(at, mode="clip")
            self.at[due] = at + self.lanes
            size[due] <<= 32
        self.range[:g] = size


def _scaled(chance: np.ndarray, unit: np.ndarray) -> np.ndarray:
    out = chance.astype(np.int64)
    out <<= _WHOLE
    out *= unit
    return out


def _run(coder: _Writer | _Reader, order0: _Order0, last: int, ids: np.ndarray) -> None:
    """Codes ``ids`` (blocks in columns, ``last`` ids in the last one), or fills them in when reading."""
    steps, lanes = ids.shape
    reading = isinstance(coder, _Reader)
    symbols = order0.ids() if reading else None
    table = np.zeros(lanes * _GROUPS * 4, dtype=np.int32)  # id * _COUNTS + count
    shape = (_COUNTS, _COUNTS, lanes)
    by_own = np.broadcast_to(np.tile(_HOLDS, 2)[:, None], (2 * _COUNTS, lanes)).flatten()
    by_both = np.broadcast_to(_HOLDS[:, None, None], shape).flatten()
    by_both_then = np.broadcast_to(_HOLDS_THEN[None, :, None], shape).flatten()
    weights = [np.full(lanes, w, dtype=np.int32) for w in _FIRST + _SECOND]
    lane, base = np.arange(lanes), np.arange(lanes) * (_GROUPS * 4)
    before, found = np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int32)
    wide, one, counts = np.int64(lanes), np.int32(_ONE), np.int32(_COUNTS)
    for t in range(steps):
        if t == last:
            lane, base, before, found, *weights = (x[:-1] for x in (lane, base, before, found, *weights))
        g = len(lane)
        earlier, before = before, found * np.int64(40503)
        at1 = before >> 2
        at1 &= (_GROUPS - 1) * 4
        at1 += base
        at2 = earlier >> 7
        at2 &= 255
        at2 *= 3
        at2 >>= 8
        at2 += 1
        at2 += at1
        e1, e2 = table.take(at1), table.take(at2)
        c1, c2, n1, n2 = e1 >> 2, e2 >> 2, e1 & 3, e2 & 3
        same = c1 == c2
        named2, named1 = n2 > 0, n1 > 0
        named1 &= ~(same & named2)

        own = same * counts
        own += n2
        own = own * wide
        own += lane
        both = n2 * counts
        both += n1
        both = both * wide
        both += lane
        x, y, z = by_own.take(own), by_both.take(both), by_both_then.take(both)
        a, b, c = x >> 4, y >> 4, order0.odds.take(c2)
        p = a * weights[0]
        p += b * weights[1]
        p += c * weights[2]
        p >>= 14
        p += _REACH
        f2 = _SQUASH.take(p, mode="clip")
        f2 *= named2
        d, e = z >> 4, order0.odds.take(c1)
        p = d * weights[3]
        p += e * weights[4]
        p >>= 14
        p += _REACH
        q = _SQUASH.take(p, mode="clip")
        rest = one - f2
        f1 = rest - 2
        f1 *= q
        f1 >>= _PART
        f1 += 1  # neither 0 nor all of the rest
        f1 *= named1
        rest -= f1
        rest = rest.astype(np.int64)

        unit = coder.range[:g] >> 31
        if reading:
            code = coder.code[:g]
            hit2 = code < _scaled(f2, unit)
            over = code - _scaled(f2 + f1, unit)
            new = over >= 0
            hit1 = ~(hit2 | new)
            part = unit * rest
            place = (over / part).astype(np.int64)
            off = place * part
            np.subtract(over, off, out=off)
            wrong = off.view(np.uint64) >= part.view(np.uint64)
            wrong &= new
            if wrong.any():  # rounded to the next number
                due = np.flatnonzero(wrong)
                place[due] = over[due] // part[due]
            found = c2 - c1
            found *= hit2
            found += c1
            symbol = symbols.take(place, mode="clip")
            symbol -= c1
            symbol *= new
            found += symbol
            ids[t, :g] = found
        else:
            found = ids[t, :g]
            hit2 = c2 == found
            hit2 &= named2
            hit1 = c1 == found
            hit1 &= named1
            hit1 &= ~hit2
            new = ~(hit2 | hit1)
        missed = ~hit2
        first, size = f2 * missed, f2 * hit2
        first += f1 * new
        size += f1 * hit1
        first, size = first.astype(np.int64), size.astype(np.int64)
        first <<= _WHOLE
        size <<= _WHOLE
        rest *= new
        place = order0.places.take(found)
        share = place & ((1 << 20) - 1)
        share *= rest
        size += share
        place >>= 20
        place *= rest
        first += place
        coder.narrow(first, size, unit)

        off = hit2 * one
        off -= f2
        for k, part in enumerate((a, b, c)):
            part *= off
            part >>= _LEARN
            weights[k] += part
        off >>= _FASTER
        x += off
        by_own[own] = x
        y += off
        by_both[both] = y
        off = hit1 * one
        off -= q
        off *= named1
        off *= missed
        for k, part in enumerate((d, e)):
            part *= off
            part >>= _LEARN
            weights[3 + k] += part
        off >>= _FASTER
        z += off
        by_both_then[both] = z
        entry = found << 2
        n2 += hit2 * counts
        table[at2] = _NEXT.take(n2) + entry
        n1 += (c1 == found) * counts
        table[at1] = _NEXT.take(n1) + entry


def _planes(values: np.ndarray) -> bytes:
    """The lower bytes of all values, then the next ones, and so on."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _from_planes(data: bytes, dtype: str) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def _pack_counts(counts: np.ndarray) -> bytes:
    ids = np.flatnonzero(counts)
    return zlib.compress(_planes(np.diff(ids, prepend=0).astype("<u2")) + _planes(counts[ids].astype("<u4")))


def _unpack_counts(data: bytes) -> np.ndarray:
    data = zlib.decompress(data)
    n = len(data) // 6
    counts = np.zeros(1 << 16, dtype=np.int64)
    counts[np.cumsum(_from_planes(data[: 2 * n], "<u2").astype(np.int64))] = _from_planes(data[2 * n :], "<u4")
    return counts


def _lasts(lanes: int, n: int) -> list[tuple[int, int, int]]:
    """First block, end and ids of the last block of each run of blocks that are coded in step."""
    ends = [min(a + LANES, lanes) for a in range(0, lanes, LANES)]
    return [(a, b, min(BLOCK, n - (b - 1) * BLOCK)) for a, b in zip(range(0, lanes, LANES), ends)]


def pack(ids: np.ndarray) -> bytes:
    """A segment: its header, how often it has which id, and every block's length, checksum, size and words."""
    ids = np.asarray(ids, dtype=np.uint32)
    if len(ids) and int(ids.max()) >= 1 << 16:
        raise ValueError("ids of more than 16 bits")
    lanes = -(-len(ids) // BLOCK)
    counts = np.bincount(ids, minlength=1 << 16)
    table = _pack_counts(counts)
    out = [MAGIC, struct.pack("<III", lanes, len(table), zlib.crc32(table)), table]
    order0 = _Order0(counts)
    for a, b, last in _lasts(lanes, len(ids)):
        rows = np.zeros((b - a, BLOCK), dtype=np.int32)
        own = ids[a * BLOCK : b * BLOCK].astype("<u4")
        rows.reshape(-1)[: len(own)] = own
        steps = last if b - a == 1 else BLOCK
        coder = _Writer(b - a, steps)
        _run(coder, order0, last, np.ascontiguousarray(rows[:, :steps].T))
        for k, data in enumerate(coder.finish()):
            block = own[k * BLOCK : (k + 1) * BLOCK]
            out += [struct.pack("<III", len(block), zlib.crc32(block.tobytes()), len(data) // 4), data]
    return b"".join(out)


def unpack(data: bytes) -> np.ndarray:
    """The ids of a segment; a block that does not have its checksum is an error."""
    if data[:4] != MAGIC:
        raise ValueError("no id segment")
    lanes, size, crc = struct.unpack_from("<III", data, 4)
    table, at = data[16 : 16 + size], 16 + size
    if zlib.crc32(table) != crc:
        raise ValueError("the table of ids is damaged")
    order0 = _Order0(_unpack_counts(table))
    lengths, sums, words = [], [], []
    for _ in range(lanes):
        n, crc, size = struct.unpack_from("<III", data, at)
        words.append(np.frombuffer(data, dtype="<u4", count=size, offset=at + 12))
        lengths.append(n)
        sums.append(crc)
        at += 12 + 4 * size
    if any(n != BLOCK for n in lengths[:-1]) or not all(0 < n <= BLOCK for n in lengths):
        raise ValueError("lengths of blocks are damaged")
    ids = np.zeros(sum(lengths), dtype="<u4")
    for a, b, last in _lasts(lanes, len(ids)):
        rows = np.zeros((last if b - a == 1 else BLOCK, b - a), dtype=np.int32)
        _run(_Reader(words[a:b]), order0, last, rows)
        own = ids[a * BLOCK : b * BLOCK]
        own[:] = rows.T.reshape(-1)[: len(own)]
    for k, crc in enumerate(sums):
        if zlib.crc32(ids[k * BLOCK : k * BLOCK + lengths[k]].tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
    return ids
