"""Whole-batch tokenisation with the tokenizers library, paying for each distinct word once.

BPE never merges across pre-tokens, so a text's ids are those of its pre-tokens one after another.
Texts whose characters all lie below U+0240 are cut into pre-tokens by array operations that follow
the tokenizer file's own split pattern; the distinct ones that a worker has not met yet go to the
library, and a bounded table keeps their ids. Any other text, and any that may hold one of the file's
added tokens (<|endoftext|>), goes to the library as it is. Both ways give the library's ids
(tests/llm/test_tokens.py compares them on random texts).
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from .textbuf import U64, SpanHasher, arrow_text

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
_TOP = 0x240  # characters below this are two UTF-8 bytes at most and need no normalisation
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
_SINGLE, _DOUBLE = b"stmd", (b"re", b"ve", b"ll")
#: Distinct pre-tokens that one worker remembers before it starts anew.
REMEMBER = 1 << 21
#: Ids that it remembers before it starts anew, so that offsets fit 31 bits; a length fits 32.
REMEMBER_IDS = 1 << 25
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 21


def _classes() -> np.ndarray:
    out = np.full(_TOP, _OTHER, np.uint8)
    for c in range(_TOP):
        kind = unicodedata.category(chr(c))[0]
        out[c] = _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
    out[[*range(9, 14), 32, 0x85, 0xA0]] = _SPACE
    return out


def _lower() -> np.ndarray:
    """The lower-case code point, or 0 where that is not one character of two bytes at most."""
    out = np.zeros(_TOP, np.int64)
    for c in range(_TOP):
        low = chr(c).lower()
        out[c] = ord(low) if len(low) == 1 and ord(low) < 0x800 and (c < 128) == (ord(low) < 128) else 0
    return out


_CLASS, _LOWER = _classes(), _lower()


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is a printable
    Latin-1 character, else the next one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


class Cutter:
    """Byte spans of the pre-tokens of plain texts. ``words``: the lower-casing, space-dropping kind."""

    def __init__(self, words: bool):
        self.words = words

    def plain(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text whether it can be cut here."""
        odd = data >= 0xC0 + (_TOP >> 6)
        if self.words and (lead := np.flatnonzero((data >= 0xC2) & ~odd)).size:
            low = _LOWER[((data[lead].astype(np.int64) & 0x1F) << 6) | (data[np.minimum(lead + 1, len(data) - 1)] & 0x3F)]
            odd[lead[low == 0]] = True
        bad = np.concatenate(([0], np.cumsum(odd)))
        return bad[offsets[1:]] == bad[offsets[:-1]]

    def cut(self, data: np.ndarray, offsets: np.ndarray):
        """(bytes, start, end, first) with the bytes lower-cased if need be; first as in spans()."""
        n = len(data)
        lead = np.flatnonzero(data >= 0xC2)
        cls = _CLASS[np.minimum(data, 127)]
        if lead.size:
            cp = ((data[lead].astype(np.int64) & 0x1F) << 6) | (data[lead + 1] & 0x3F)
            cls[lead] = cls[lead + 1] = _CLASS[cp]
        if self.words:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
            if lead.size:
                low = _LOWER[cp]
                data[lead], data[lead + 1] = 0xC0 | (low >> 6), 0x80 | (low & 0x3F)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        start = edge[:n].copy()
        start[1:] |= cls[1:] != cls[:-1]
        if self.words:
            start |= (cls == _NUMBER) & ((data < 0x80) | (data >= 0xC0))
        else:
            self._attach_spaces(data, cls, edge, start)
        self._contractions(data, cls, edge, start)
        s = np.flatnonzero(start)
        e = np.append(s[1:], n)
        if self.words:
            keep = cls[s] != _SPACE
            s, e = s[keep], e[keep]
        return data, s, e, np.searchsorted(s, offsets)

    @staticmethod
    def _attach_spaces(data, cls, edge, start):
        """The last space of a run goes to what follows it; another last blank stands alone."""
        n = len(data)
        follows = np.flatnonzero((cls[:-1] == _SPACE) & (cls[1:] != _SPACE) & ~edge[1:n])
        blank = data[follows] == 32
        start[follows[blank]] = True
        start[follows[blank] + 1] = False
        other = follows[~blank]
        start[np.where(data[other] >= 0x80, other - 1, other)] = True

    @staticmethod
    def _contractions(data, cls, edge, start):
        n = len(data)
        q = np.flatnonzero((data[: max(n - 1, 0)] == 39))
        q = q[start[q] & ~edge[q + 1] & (cls[q + 1] == _LETTER)]
        if not q.size:
            return
        after = data[q + 1]
        width = np.isin(after, np.frombuffer(_SINGLE, np.uint8)).astype(np.int64)
        two = q + 2
        room = (two < n) & ~edge[np.minimum(two, n)]
        second = data[np.minimum(two, n - 1)]
        for pair in _DOUBLE:
            width[(after == pair[0]) & room & (second == pair[1])] = 2
        q, width = q[width > 0], width[width > 0]
        start[q + 1] = False
        stop = q + 1 + width
        stop = stop[(stop < n) & ~edge[np.minimum(stop, n)]]
        start[stop[cls[stop] == _LETTER]] = True


class _Table:
    """Open-addressing map of 64-bit keys to runs of ids in a pool."""

    def __init__(self, bits: int = 16):
        self.count = 0
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self._make(bits)

    def _make(self, bits):
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, U64)
        self.at = np.zeros(1 << bits, np.int64)  # offset << 32 | length

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The packed place of each key, -1 where it is missing."""
        slot = (keys & U64(self.mask)).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == keys, self.at[slot], -1)
        todo = np.flatnonzero((held != keys) & (held != 0))
        while todo.size:
            slot[todo] = (slot[todo] + 1) & self.mask
            held = self.keys[slot[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.at[slot[todo[hit]]]
            todo = todo[~hit & (held != 0)]
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Distinct keys that are not in the table yet."""
        if 2 * (self.count + len(keys)) > self.mask:
            old, at = self.keys, self.at
            live = old != 0
            self._make(int(np.ceil(np.log2(3 * (self.count + len(keys)) + 16))))
            self._put(old[live], at[live])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(ids)] = ids
        offsets = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self._put(keys, (offsets << 32) | lengths)
        self.count += len(keys)

    def _put(self, keys, at):
        todo, slot = np.arange(len(keys)), (keys & U64(self.mask)).astype(np.int64)
        while todo.size:
            free = self.keys[slot[todo]] == 0
            self.keys[slot[todo[free]]] = keys[todo[free]]  # of several keys one stays
            done = free & (self.keys[slot[todo]] == keys[todo])
            self.at[slot[todo[done]]] = at[todo[done]]
            todo = todo[~done]
            slot[todo] = (slot[todo] + 1) & self.mask


class BatchTokenizer:
    """Ids of whole batches. ``path``: a tokenizer file of byte-level or word-end BPE."""

    def __init__(self, path: str, remember: int = REMEMBER):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words = self.library.normalizer is not None
        self.cutter, self.hasher = Cutter(self.words), SpanHasher(11)
        self.remember, self.table = remember, _Table()
        self.added = sorted({x.content.encode().lower() for x in self.library.get_added_tokens_decoder().values()})

    def _holds_added(self, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """For each text whether it holds an added token's content, in capitals or not."""
        low, found = raw.lower(), []
        for token in self.added:
            at = low.find(token)
            while at >= 0:
                found.append(at)
                at = low.find(token, at + 1)
        out = np.zeros(len(offsets) - 1, bool)
        out[np.searchsorted(offsets, found, side="right") - 1] = True
        return out

    def _library_ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, data, start, end, keys) -> None:
        """Tokenises the spans (whose keys are distinct and new) and keeps their ids."""
        size = end - start
        stops = np.cumsum(size)
        at = np.repeat(start - stops + size, size) + np.arange(int(stops[-1]))
        text = data[at].tobytes().decode("latin-1").translate(_BYTE_LETTERS)
        merge, ids, lengths, a = self.library.model.tokenize, [], [], 0
        for b in stops.tolist():
            found = [x.id for x in merge(text[a:b])]
            ids += found
            lengths.append(len(found))
            a = b
        self.table.add(keys, np.array(ids, np.uint32), np.array(lengths, np.int64))

    def _plain_ids(self, data, offsets):
        data, s, e, first = self.cutter.cut(data, offsets)
        keys = self.hasher.bytes(data, s, e)
        keys[keys == 0] = 1
        if self.table.count > self.remember or self.table.used > REMEMBER_IDS:
            self.table = _Table()
        at = self.table.find(keys)
        missing = np.flatnonzero(at < 0)
        if missing.size:
            _, one = np.unique(keys[missing], return_index=True)
            one = missing[one]
            self._learn(data, s[one], e[one], keys[one])
            at[missing] = self.table.find(keys[missing])
        length = at & 0xFFFFFFFF
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.table.pool[np.repeat((at >> 32) - ends + length, length) + np.arange(total)]
        return ids, np.concatenate(([0], ends))[first]

    def ids(self, column):
        """(ids, offsets): the ids of all texts, and where each text's begin."""
        data, offsets = arrow_text(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        raw, parts = data.tobytes(), []
        plain = self.cutter.plain(data, offsets) & ~self._holds_added(raw, offsets)
        if plain.all():
            return self._plain_ids(data, offsets)
        odd = np.flatnonzero(~plain)
        library = dict(zip(odd.tolist(), self._library_ids([raw[offsets[i] : offsets[i + 1]].decode() for i in odd])))
        for i in range(len(plain)):
            a, b = int(offsets[i]), int(offsets[i + 1])
            if i in library:
                parts.append(np.array(library[i], np.uint32))
            else:
                parts.append(self._plain_ids(data[a:b], np.array([0, b - a]))[0] if b > a else np.zeros(0, np.uint32))
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


_made: dict[str, BatchTokenizer] = {}


def tokenizer(path: str) -> BatchTokenizer:
    """One tokenizer a worker process and file, so that what it has learnt serves later tasks."""
    if path not in _made:
        _made[path] = BatchTokenizer(path)
    return _made[path]


def slices(batch, column: str, limit: int = CHUNK_BYTES):
    """Parts of an Arrow batch with about ``limit`` bytes of text each; a longer text comes alone."""
    n = batch.num_rows
    if not n:
        return
    lengths = np.diff(arrow_text(batch[column])[1])
    lo, size = 0, 0
    for i, x in enumerate(lengths.tolist()):
        if i > lo and size + x > limit:
            yield batch.slice(lo, i - lo)
            lo, size = i, 0
        size += x
    yield batch.slice(lo, n - lo)
