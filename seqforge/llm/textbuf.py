"""Vectorised work on whole Arrow batches of text: spans, hashes and sliding minima.

Every function takes the UTF-8 bytes of a batch as one numpy buffer, so cost per byte is a few
array passes whatever the number of documents, and no Python object is made per word.
Null texts count as empty texts. All hashes depend on content alone, never on position,
batch or machine, so they can be joined across tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
#: White space that separates words: tab, line feed, vertical tab, form feed, return, space.
SPACE_BYTES = bytes(range(9, 14)) + b" "


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply), applied elementwise."""
    with np.errstate(over="ignore"):
        x = x.astype(U64) + U64(seed * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF) + _ODD
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def arrow_text(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has length 0. Offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(members, np.uint8)] = True
    return table


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """Maximal runs of bytes that ``inside`` holds of, never across documents.

    Returns (start, end, first): byte positions of each run, and for each document the index of
    its first run, with one entry more for the end.
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    member = inside[data]
    start = member.copy()
    start[1:] &= ~member[:-1]
    end = member.copy()
    end[:-1] &= ~member[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    start[edges] = member[edges]
    end[edges - 1] = member[edges - 1]
    s = np.flatnonzero(start)
    e = np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offsets)


class SpanHasher:
    """64-bit polynomial hashes of byte spans, from one running sum over the buffer.

    sum(table[byte] * M**i) modulo 2**64 over a span, times M**-start, is the same wherever the span
    stands; M is odd, so its powers have inverses. Powers are kept up to ``block`` bytes and sums
    are started anew at each block, spans across a border being put together from both sides.
    """

    def __init__(self, seed: int = 1, block: int = 1 << 20):
        self.table = mix64(np.arange(256, dtype=U64), seed)
        self.m = int(mix64(np.array([seed], U64), 77)[0]) | 1
        self.inverse = pow(self.m, -1, 1 << 64)
        self.seed, self.power, self.back = seed, np.ones(1, U64), np.ones(1, U64)

    @staticmethod
    def _powers(m: int, n: int) -> np.ndarray:
        out = np.ones(n, U64)
        done = 1
        with np.errstate(over="ignore"):
            while done < n:
                step = min(done, n - done)
                out[done : done + step] = out[:step] * U64(pow(m, done, 1 << 64))
                done += step
        return out

    def _prefix(self, values: np.ndarray) -> np.ndarray:
        if len(self.power) < len(values) + 1:
            size = max(len(values) + 1, 2 * len(self.power))
            self.power, self.back = self._powers(self.m, size), self._powers(self.inverse, size)
        sums = np.zeros(len(values) + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(values * self.power[: len(values)], out=sums[1:])
        return sums

    def bytes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash for each span of bytes; the length is part of it."""
        return self._of(self._prefix(self.table[data]), start, end)

    def runs(self, values: np.ndarray, start: np.ndarray, length) -> np.ndarray:
        """A hash for each run of ``length`` 64-bit values from ``start`` on."""
        return self._of(self._prefix(values), start, start + length)

    def _of(self, sums, start, end):
        with np.errstate(over="ignore"):
            return mix64((sums[end] - sums[start]) * self.back[start] + (end - start).astype(U64) * _ODD, self.seed)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours: out[i] = min(x[i : i + width])."""
    return _sliding(x, width, np.minimum)


def sliding_max(x: np.ndarray, width: int) -> np.ndarray:
    return _sliding(x, width, np.maximum)


def _sliding(x, width, pick):
    if len(x) < width:
        return x[:0]
    out, have = x, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    if have < width:
        rest = width - have
        out = pick(out[:-rest], out[rest:])
    return out


def windows(first: np.ndarray, width: int) -> np.ndarray:
    """Indices of the runs at which ``width`` consecutive runs of one document begin."""
    count = np.diff(first)
    room = np.maximum(count - width + 1, 0)
    total = int(room.sum())
    if not total:
        return np.zeros(0, np.int64)
    base = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(room)[:-1])), room)
    return base + np.arange(total)


def covered(n: int, start: np.ndarray, width) -> np.ndarray:
    """Which of n positions lie in some [start, start + width)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + width, -1)
    return np.cumsum(step[:-1]) > 0
