"""Byte-level BPE by a file of ranks: encoding with a hierarchical-bitmap rank queue, and decoding (operator 11).

A text is split by ``public_tokenizers.PATTERN``; each piece that is not itself a token starts as its bytes,
and of all neighbours that join to a token those of the least rank, the leftmost of them first, are joined
until none are left. The neighbours wait in a queue:

    buckets   for each rank the positions at which a pair of that rank began when it was found
    bitmap    a bit for each bucket that is not empty, a bit for each word of those, and so on up to one word

The next rank is found by the lowest bit of one word on each level, so a step costs the same however long
the piece is; a piece of n bytes takes about n steps, with no rescans. The parts of a piece are a linked list
of positions. A pair that has changed since it was queued is left in its bucket and skipped when it is taken:
its bytes are no longer the token of that rank. A bucket gives its leftmost position first.

Pieces of up to SHORT bytes are encoded BLOCK at a time, each with its own queue, all of which push and pop
together in array operations (RankQueues, merged_each); longer ones, and files without all 256 bytes, go one by one.

Texts of characters below U+0240 are split by array operations that follow the pattern, others by the
pattern itself. Each distinct piece is encoded once by a worker, which remembers a bounded number of them by
64-bit hashes. Decoding joins the tokens' bytes, which are the text again.

Null texts are empty; an empty text has no ids. Null doc_ids stay null, repeated rows each have their row, an
empty table gives an empty result, other columns are ignored. Strings such as <|endoftext|> are ordinary
text. Texts are encoded where they are read, without a shuffle; a task needs about thirty times the bytes of
its longest text, and about a hundred for a text that is one single piece.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, texts, tokenizer_path
from .textbuf import U64, SpanHasher, mix64
from .tokenizing import REMEMBER, BatchTokenizer, Cutter, _Table, slices

WORD = 64  # bits of a word of the bitmap
SHORT, BLOCK = 64, 2048  # bytes of a piece that is encoded with others, and pieces at once
_BLANK = r"\p{White_Space}"


class RankQueue:
    """Positions by rank: ``push`` in any order, ``pop`` the least rank's leftmost position."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.levels: list[list[int]] = []
        while True:
            ranks = -(-ranks // WORD)
            self.levels.append([0] * ranks)
            if ranks <= 1:
                break

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        for words in self.levels:
            at, bit = divmod(rank, WORD)
            held = words[at]
            words[at] = held | 1 << bit
            if held:
                return
            rank = at

    def pop(self) -> tuple[int, int] | None:
        if not self.levels[-1] or not self.levels[-1][0]:
            return None
        rank = 0
        for words in reversed(self.levels):
            held = words[rank]
            rank = rank * WORD + (held & -held).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            at = rank
            for words in self.levels:
                at, bit = divmod(at, WORD)
                words[at] &= ~(1 << bit)
                if words[at]:
                    break
        return rank, position


def merged(piece: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """The ids of one piece. ``queue`` is empty before and after."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n, known = len(piece), ranks.get
    end, before = list(range(1, n + 1)), list(range(-1, n))  # of the part at a position: where it ends, the part before
    push, pop = queue.push, queue.pop
    for at in range(n - 1):
        if (rank := known(piece[at : at + 2])) is not None:
            push(rank, at)
    while (least := pop()) is not None:
        rank, at = least
        middle = end[at]
        if not middle or middle == n or known(piece[at : (stop := end[middle])]) != rank:
            continue  # stale
        end[at], end[middle] = stop, 0
        if stop < n:
            before[stop] = at
            if (rank := known(piece[at : end[stop]])) is not None:
                push(rank, at)
        if at and (rank := known(piece[before[at] : stop])) is not None:
            push(rank, before[at])
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : end[at]]])
        at = end[at]
    return ids


class RankQueues:
    """Queues of ranks, one a row, that push and pop together; a rank that is pushed twice is held once."""

    def __init__(self, ranks: int, rows: int):
        self.levels: list[np.ndarray] = []
        while True:
            ranks = -(-ranks // WORD)
            self.levels.append(np.zeros((rows, ranks), U64))
            if ranks <= 1:
                break

    def push(self, rows: np.ndarray, ranks: np.ndarray) -> None:
        """A rank for each of the rows, which are distinct."""
        for words in self.levels:
            at = ranks >> 6
            words[rows, at] |= U64(1) << (ranks & 63).astype(U64)
            ranks = at

    def filled(self, rows: np.ndarray) -> np.ndarray:
        return rows[self.levels[-1][rows, 0] != 0]

    def least(self, rows: np.ndarray) -> np.ndarray:
        """The least rank of each of the rows, none of which is empty."""
        rank = np.zeros(len(rows), np.int64)
        for words in reversed(self.levels):
            held = words[rows, rank]
            rank = rank * WORD + np.bitwise_count(~held & (held - U64(1)))
        return rank

    def drop(self, rows: np.ndarray, ranks: np.ndarray) -> None:
        """Takes each of the rows' ranks, which it holds, out of it."""
        for words in self.levels:
            at = ranks >> 6
            words[rows, at] = held = words[rows, at] & ~(U64(1) << (ranks & 63).astype(U64))
            empty = held == 0
            rows, ranks = rows[empty], at[empty]
            if not len(rows):
                return


class Joins:
    """The rank of the token that two neighbouring tokens join to, for arrays of them: -1 where there is none."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, joined = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    keys.append(a << 32 | b)
                    joined.append(rank)
        self.table = _Table()
        self.table.add(mix64(np.array(keys, U64)), np.array(joined, np.uint32), np.ones(len(keys), np.int64))

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at = self.table.find(mix64(left.astype(U64) << U64(32) | right.astype(U64)))
        return np.where(at < 0, -1, self.table.pool[at >> 32].astype(np.int64))


def merged_each(data: np.ndarray, start: np.ndarray, end: np.ndarray, single: np.ndarray, joins: Joins, queues: RankQueues) -> tuple[np.ndarray, np.ndarray]:
    """The ids of pieces of 2 bytes or more, one after another, and how many each has; as merged gives them for pieces that are
    no token. ``single``: the rank of each byte. ``queues``: as many rows as pieces at least, empty before and after."""
    n = end - start
    rows, width = np.arange(len(n)), int(n.max())
    place = np.arange(width)
    part = single[data[np.minimum(start[:, None] + place, len(data) - 1)]]  # the token that begins at a position, -1 for none
    part[place >= n[:, None]] = -1
    after = np.repeat(place[None, :] + 1, len(n), 0)  # where the next part begins
    before = np.repeat(place[None, :] - 1, len(n), 0)
    pair = np.full((len(n), width), -1)  # the rank of a part and the next one joined
    for k in range(width - 1):
        own = rows[n > k + 1]
        rank = joins.of(part[own, k], part[own, k + 1])
        own, rank = own[rank >= 0], rank[rank >= 0]
        pair[own, k] = rank
        queues.push(own, rank)
    live = queues.filled(rows)
    while len(live):
        rank = queues.least(live)
        there = pair[live] == rank[:, None]
        count = there.sum(1)
        gone = count < 2  # nothing of that rank is left in the row but what is taken now
        queues.drop(live[gone], rank[gone])
        own, at, rank = live[count > 0], there.argmax(1)[count > 0], rank[count > 0]
        middle = after[own, at]
        stop = after[own, middle]
        part[own, at], part[own, middle] = rank, -1
        after[own, at] = stop
        pair[own, at] = pair[own, middle] = -1
        for side in ("right", "left"):
            if side == "right":
                k = np.flatnonzero(stop < n[own])
                before[own[k], stop[k]] = at[k]
                row, left, right = own[k], at[k], stop[k]
            else:
                k = np.flatnonzero(at > 0)
                row, left, right = own[k], before[own[k], at[k]], at[k]
            found = joins.of(part[row, left], part[row, right])
            pair[row, left] = found
            row, found = row[found >= 0], found[found >= 0]
            queues.push(row, found)
        live = queues.filled(live)
    return part[part >= 0], (part >= 0).sum(1)


class PatternCutter(Cutter):
    """Byte spans of the pattern's matches, of any texts."""

    def __init__(self):
        import public_tokenizers
        import regex

        super().__init__(words=False)
        # \s in the rank files' pattern is Unicode's White_Space, whatever else a pattern library takes it for
        self.pattern = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", f"[^{_BLANK}").replace(r"\S", rf"\P{{White_Space}}").replace(r"\s", _BLANK))

    def plain(self, data, offsets):
        return np.ones(len(offsets) - 1, bool)

    def cut(self, data, offsets):
        simple = super().plain(data, offsets)
        if simple.all():
            return super().cut(data, offsets)
        starts, ends, first = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [0]
        turns = np.flatnonzero(np.append(True, simple[1:] != simple[:-1]))
        for a, b in zip(turns.tolist(), [*turns[1:].tolist(), len(simple)]):
            lo, hi = int(offsets[a]), int(offsets[b])
            if simple[a] and lo == hi:
                first += [first[-1]] * (b - a)
                continue
            if simple[a]:
                _, s, e, own = super().cut(data[lo:hi], offsets[a : b + 1] - lo)
                starts.append(s + lo)
                ends.append(e + lo)
                first += (first[-1] + own[1:]).tolist()
                continue
            for k in range(a, b):
                at = int(offsets[k])
                text = data[at : offsets[k + 1]].tobytes().decode()
                sizes = [len(x.encode()) for x in self.pattern.findall(text)]
                e = at + np.cumsum(np.array(sizes, np.int64))
                ends.append(e)
                starts.append(e - np.array(sizes, np.int64))
                first.append(first[-1] + len(sizes))
        return data, np.concatenate(starts), np.concatenate(ends), np.array(first, np.int64)


class RankEncoder(BatchTokenizer):
    """Ids of whole batches by a file of ranks, and texts of ids."""

    def __init__(self, path: str, remember: int = REMEMBER):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        self.cutter, self.hasher, self.added = PatternCutter(), SpanHasher(13), []
        self.remember, self.table = remember, _Table()
        top = max(self.ranks.values(), default=-1) + 1
        self.queue = RankQueue(top)
        tokens = [b""] * top
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.bytes, self.decimals = _joined(tokens), _joined([b"%d," % i for i in range(top)])
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.single >= 0).all():
            self.joins, self.queues = Joins(self.ranks), RankQueues(top, BLOCK)

    def _learn(self, data, start, end, keys) -> None:
        raw, whole = data.tobytes(), self.ranks.get
        known = np.array([whole(raw[a:b], -1) for a, b in zip(start.tolist(), end.tolist())], np.int64)
        together = (known < 0) & (end - start <= SHORT) & (self.single >= 0).all()
        self.table.add(keys[known >= 0], known[known >= 0].astype(np.uint32), np.ones(int((known >= 0).sum()), np.int64))
        short = np.flatnonzero(together)
        short = short[np.argsort((end - start)[short], kind="stable")]
        for own in (short[lo : lo + BLOCK] for lo in range(0, len(short), BLOCK)):
            ids, lengths = merged_each(data, start[own], end[own], self.single, self.joins, self.queues)
            self.table.add(keys[own], ids.astype(np.uint32), lengths)
        single = np.flatnonzero((known < 0) & ~together)
        ids, lengths = [], []
        for a, b in zip(start[single].tolist(), end[single].tolist()):
            found = merged(raw[a:b], self.ranks, self.queue)
            ids += found
            lengths.append(len(found))
        self.table.add(keys[single], np.array(ids, np.uint32), np.array(lengths, np.int64))


def _joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(strings), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in strings], dtype=np.int64)))


def spelled(ids: np.ndarray, strings: tuple[np.ndarray, np.ndarray]) -> bytes:
    """The strings of the ids, one after another."""
    data, at = strings
    size = at[1:][ids] - at[:-1][ids]
    stops = np.cumsum(size)
    if not len(stops):
        return b""
    return data[np.repeat(at[:-1][ids] - stops + size, size) + np.arange(int(stops[-1]))].tobytes()


_made: dict[str, RankEncoder] = {}


def encoder(path: str) -> RankEncoder:
    """One encoder a worker process and file."""
    if path not in _made:
        _made[path] = RankEncoder(path)
    return _made[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) of every text."""

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, at = coder.ids(part["text"])
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """doc_id, text (binary) of every row of (doc_id, ids); null ids are no ids."""

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            for doc, x in zip(batch["doc_id"], batch["ids"]):
                own = np.zeros(0, np.int64) if x.values is None else x.values.to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()], pa.int64()), pa.array([spelled(own, coder.bytes)], pa.binary())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the ids' bytes) of every text."""

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, at = coder.ids(part["text"])
                counts, shown, back = np.diff(at), [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    shown.append(hashlib.sha256(spelled(ids[a:b], coder.decimals)[:-1]).hexdigest())
                    back.append(hashlib.sha256(spelled(ids[a:b], coder.bytes)).hexdigest())
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(counts, pa.int64()), pa.array(shown), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"))
