"""Repeated-phrase automata for substring deduplication (operator 9).

A window is ``width`` consecutive words of one document. Words of every window whose words also begin
somewhere else in the corpus, the same document included, are removed.

Documents are dealt to blocks of a few megabytes; blocks and shards exchange packed arrays.

1. anchors   each window has an anchor, the ``phrase`` words in it with the least hash, so that equal windows
             have equal anchors. Blocks send their distinct anchors to shards by hash and are told which recur;
2. confirm   blocks send the distinct windows over recurring anchors (95-bit identities, and where they
             begin). Of each window that recurs a shard names one owner among the blocks that have it, and
             tells the owner, and only it, which blocks need it. Owners are drawn by hashes of the blocks and
             of the region that a window stands in, so that they share the work whatever recurs where, and
             neighbouring windows mostly have one owner;
3. passages  an owner cuts its recurring windows out as passages, runs of windows up to PIECE, and sends each
             to the blocks that need it;
4. locate    a block compiles an Aho-Corasick automaton of phrases of the passages it was sent, by every
             owner, and streams all its documents through it. Round each hit document and passage are
             compared word by word, and what agrees over ``width`` words or more is removed.

Blocks learn of repetitions by passages alone: what no automaton finds is not removed. A passage has a
phrase at every (width - phrase + 1)-th word, so each of its windows holds one. Automata are sharded by the
blocks that need their phrases, so that together they grow as the repeated text does, and one of more than
VOCABULARY words is split. However often a passage recurs, a block names it once; shards see SPAN blocks at
a time, and beyond that the spans' owners meet in a second round, so no task gathers a hot passage.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and return. Null texts
have no words. Repeated rows remove each other's windows as any copies do. Null doc_ids stay null. An
empty table gives an empty result; other columns are ignored. A text is never split between tasks, so a
task needs memory for the longest one, about thirty times its bytes.
"""

from __future__ import annotations

import hashlib
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions, table, texts
from .textbuf import SPACE_BYTES, U64, SpanHasher, arrow_text, byte_table, mix64, sliding_min, spans, windows
from .tokenizing import slices

WIDTH, PHRASE = 35, 10
BLOCK_BYTES = 4 << 20  # of the input's files, for each block
SLICE_BYTES = 1 << 18  # of text, hashed at once
SPAN = 1 << 16  # blocks whose records meet in one shard
PIECE = 128  # windows of a passage at most
REGION = 128  # phrases of which the least names a region: passages of one owner are about half as long
VOCABULARY = 1 << 18  # words of an automaton at most: three digits of 64
CROWD = 8  # places of a phrase that are tried one by one
_NOT_SPACE = ~byte_table(SPACE_BYTES)
_PACKED = "shard int, span int, block long, packed binary"
_ANCHOR = np.dtype([("key", "<u8"), ("own", "u1")])
_WINDOW = np.dtype([("key", "<u8"), ("more", "<u4"), ("at", "<u4"), ("region", "<u2")])  # the lowest bit of more: twice in the block
_NEED = np.dtype([("at", "<u4"), ("to", "<u4")])


class Words:
    """The words of some texts as hashes, and hashes of their runs."""

    def __init__(self, texts, width: int, phrase: int):
        self.width, self.phrase = width, phrase
        data, offsets = arrow_text(texts)
        start, end, self.first = spans(data, offsets, _NOT_SPACE)
        self.words = SpanHasher(3).bytes(data, start, end)
        self.starts = windows(self.first, width)
        self.phrases = SpanHasher(5).runs(self.words, np.arange(max(0, len(self.words) - phrase + 1)), phrase)
        least = sliding_min(self.phrases, width - phrase + 1)
        self.anchors = least[self.starts] if len(self.starts) else np.zeros(0, U64)

    def regions(self, starts: np.ndarray) -> np.ndarray:
        """A digest of the region round each window, alike for neighbours and where the texts round them agree."""
        least = sliding_min(self.phrases, min(REGION, max(1, len(self.phrases))))
        at = np.clip(starts - REGION // 2, 0, max(0, len(least) - 1))
        return (mix64(least[at], 21) >> U64(48)).astype(np.uint16) if len(starts) else np.zeros(0, np.uint16)

    def identities(self, starts: np.ndarray):
        return SpanHasher(7).runs(self.words, starts, self.width), SpanHasher(9).runs(self.words, starts, self.width)


def _ordered(group: pa.Table) -> pa.RecordBatch:
    """A block's rows in an order of their own; rows of one hash are alike."""
    order = np.lexsort((group["doc_id"].fill_null(0).to_numpy(), group["h"].to_numpy()))
    return group.take(pa.array(order)).combine_chunks().to_batches()[0]


def _words(group: pa.Table, width: int, phrase: int):
    """(words before, Words) of a block, a slice at a time."""
    before = 0
    for part in slices(_ordered(group), "text", SLICE_BYTES):
        w = Words(part["text"], width, phrase)
        yield before, w
        before += len(w.words)


def _within(x: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array of members."""
    if not len(members):
        return np.zeros(len(x), bool)
    return members[np.minimum(np.searchsorted(members, x), len(members) - 1)] == x


def _split(of: np.ndarray, packed: np.ndarray):
    """(value, its records) for each distinct value of ``of``."""
    order = np.argsort(of, kind="stable")
    of, packed = of[order], packed[order]
    values, at = np.unique(of, return_index=True)
    return zip(values.tolist(), np.split(packed, at[1:])) if len(values) else ()


def _deal(block: int, records: np.ndarray, shards: int, span: int) -> pa.Table:
    """A row for each shard that has records, by the keys' remainders."""
    rows = [(k, block // span, block, r.tobytes()) for k, r in _split((records["key"] % U64(shards)).astype(np.int64), records)]
    return _table(rows, {"shard": pa.int32(), "span": pa.int32(), "block": pa.int64(), "packed": pa.binary()})


def _table(rows: list[tuple], kinds: dict) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))


def _records(packed: pa.ChunkedArray, kind: np.dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in packed.combine_chunks()] if len(packed) else []


def _told(replies: pa.Table, kind) -> np.ndarray:
    cells = _records(replies["packed"], np.dtype(kind))
    return np.concatenate(cells) if cells else np.zeros(0, kind)


def _meet(kind: np.dtype, last: bool, up: bool):
    """For the records of a shard: what blocks are told of the keys that recur, as rows of (block, packed).

    Of anchors every block that has one is told its key. Of windows the owner is told where it begins there,
    for each block that needs it, itself included. With ``up`` each key goes on, as its owner's record (any block's,
    of anchors), marked if it has been settled here; such marks are what ``last`` reads."""

    def run(group: pa.Table) -> pa.Table:
        cells = _records(group["packed"], kind)
        records = np.concatenate(cells)
        block = np.repeat(group["block"].to_numpy(), [len(c) for c in cells])
        window = "at" in kind.names
        mark = (records["more"] & 1 if window else records["own"]).astype(bool)
        identity = [records["more"] >> 1, records["key"]] if window else [records["key"]]
        order = np.lexsort([block, *identity])
        records, block, mark = records[order], block[order], mark[order]
        new = np.ones(len(records), bool)
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in identity], axis=0)
        first = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        if window:  # the owner first
            region = np.minimum.reduceat(records["region"], first)[of]
            order = np.lexsort([mix64(block.astype(U64) * U64(1 << 16) + region, 23), of])
            records, block, mark = records[order], block[order], mark[order]
            records["region"] = region
        several = np.diff(np.append(first, len(records))) > 1
        recurs = several if last else several | np.logical_or.reduceat(mark, first)
        hit = recurs[of] & ~mark if last else recurs[of]
        if window:
            owner = first[of[hit]]
            told = np.zeros(len(owner), _NEED)
            told["at"], told["to"] = records["at"][owner], block[hit]
            rows = list(_split(block[owner], told))
        else:
            rows = list(_split(block[hit], records["key"][hit]))
        rows = [(False, None, k, x.tobytes()) for k, x in rows]
        if up:
            on = records[first]
            on["more" if window else "own"] = on["more"] & ~np.uint32(1) | recurs if window else recurs
            rows += [(True, group["shard"][0].as_py(), k, x.tobytes()) for k, x in _split(block[first], on)]
        return _table(rows, {"up": pa.bool_(), "shard": pa.int32(), "block": pa.int64(), "packed": pa.binary()})

    return run


class Finder:
    """An automaton of phrases of passages, and what of a document is in a passage over ``width`` words or more.

    Words of passages are numbered and written as three digits with letters of their own each, so that
    phrases match at words only; any other word is three zeros, which no passage holds."""

    def __init__(self, passages: list[list[bytes]], width: int, phrase: int):
        import ahocorasick

        self.width, self.phrase, self.half = width, phrase, (width - phrase + 1) // 2
        self.code: dict[bytes, str] = {}
        for words in passages:
            for w in words:
                if w not in self.code:
                    n = len(self.code)
                    self.code[w] = chr(1 + n % 64) + chr(65 + n // 64 % 64) + chr(129 + n // 4096)
        self.passages = [self.text(words) for words in passages]
        numbers: dict[str, int] = {}
        self.places: list[list[tuple[int, int]]] = []  # of each phrase: passage, first word
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, x in enumerate(self.passages):
            for at in range(0, len(x) // 3 - phrase + 1, width - phrase + 1):
                key = x[3 * at : 3 * (at + phrase)]
                number = numbers.setdefault(key, len(numbers))
                if number == len(self.places):
                    self.places.append([])
                    self.automaton.add_word(key, number)
                self.places[number].append((k, at))
        self.sides: dict[int, tuple[dict, dict]] = {}
        if self.places:
            self.automaton.make_automaton()

    def text(self, words: list[bytes]) -> str:
        return "".join(map(self.code.get, words, repeat("\0\0\0")))

    def _near(self, number: int, text: str, at: int):
        """Places of a phrase that may agree with the text far enough: of a crowd, those that agree over half
        of the words that a window has besides the phrase, after it or before it."""
        places = self.places[number]
        if len(places) <= CROWD or not self.half:
            return places
        if number not in self.sides:
            after, before = {}, {}
            for k, p in places:
                x, a, b = self.passages[k], 3 * (p + self.phrase), 3 * p
                after.setdefault(x[a : a + 3 * self.half], []).append((k, p))
                if p >= self.half:
                    before.setdefault(x[b - 3 * self.half : b], []).append((k, p))
            self.sides[number] = after, before
        after, before = self.sides[number]
        a, b = 3 * (at + self.phrase), 3 * at
        found = after.get(text[a : a + 3 * self.half], [])
        return found + before.get(text[b - 3 * self.half : b], []) if at >= self.half else found

    def covered(self, words: list[bytes]) -> bytearray | None:
        """A mark for each word that lies in a passage's window, None if there is none."""
        if not self.places or len(words) < self.width:
            return None
        text, n, out = self.text(words), len(words), None
        done: dict[int, tuple[int, int]] = {}  # of each passage the last shift and where that agreement ended
        for end, number in self.automaton.iter(text):
            at = (end + 1) // 3 - self.phrase
            for k, p in self._near(number, text, at):
                if (last := done.get(k)) is not None and last[0] == at - p and at < last[1]:
                    continue
                x = self.passages[k]
                right = at + self.phrase + _agree(text, 3 * (at + self.phrase), x, 3 * (p + self.phrase)) // 3
                left = at - _agree_back(text, 3 * at, x, 3 * p) // 3
                done[k] = at - p, right
                if right - left >= self.width:
                    if out is None:
                        out = bytearray(n)
                    out[left:right] = b"\1" * (right - left)
        return out


def _agree(a: str, i: int, b: str, j: int) -> int:
    """How many letters, in threes, a from i on and b from j on have in common."""
    low, high = 0, min(len(a) - i, len(b) - j) // 3
    if a[i : i + 3 * high] == b[j : j + 3 * high]:
        return 3 * high
    while high - low > 1:  # low agree, high do not
        mid = (low + high) // 2
        if a[i + 3 * low : i + 3 * mid] == b[j + 3 * low : j + 3 * mid]:
            low = mid
        else:
            high = mid
    return 3 * low


def _agree_back(a: str, i: int, b: str, j: int) -> int:
    """How many letters, in threes, a before i and b before j have in common."""
    low, high = 0, min(i, j) // 3
    if a[i - 3 * high : i] == b[j - 3 * high : j]:
        return 3 * high
    while high - low > 1:
        mid = (low + high) // 2
        if a[i - 3 * mid : i - 3 * low] == b[j - 3 * mid : j - 3 * low]:
            low = mid
        else:
            high = mid
    return 3 * low


def finders(passages: list[bytes], width: int = WIDTH, phrase: int = PHRASE, vocabulary: int = VOCABULARY) -> list[Finder]:
    """Automata of the passages (words joined by a space), as few as their words allow."""
    out, own, seen = [], [], set()
    for x in sorted(set(passages)):
        words = x.split(b" ")
        seen.update(words)
        if len(seen) > vocabulary and own:
            out.append(Finder(own, width, phrase))
            own, seen = [], set(words)
        own.append(words)
    return [*out, Finder(own, width, phrase)] if own else out


def removed(words: list[bytes], automata: list[Finder]) -> bytearray | None:
    """A mark for each word of a document to be removed, None if there is none: what the automata find."""
    out = None
    for finder in automata:
        found = finder.covered(words)
        if found is not None:
            out = found if out is None else bytearray(a | b for a, b in zip(out, found))
    return out


def _passages(batch: pa.RecordBatch, need: np.ndarray, width: int):
    """(passage, blocks that need it) of the windows that a block owns."""
    need = need[np.argsort(need["at"], kind="stable")]
    starts, at = np.unique(need["at"], return_index=True)
    at = np.append(at, len(need))
    run = np.cumsum(np.append(0, np.diff(starts.astype(np.int64)) > 1)) if len(starts) else np.zeros(0, np.int64)
    _, begin = np.unique(run, return_index=True)
    place = (np.arange(len(starts)) - begin[run]) // PIECE if len(starts) else run
    cuts = np.flatnonzero(np.append(True, (run[1:] != run[:-1]) | (place[1:] != place[:-1]))) if len(starts) else []
    before, k = 0, 0
    for part in slices(batch, "text", SLICE_BYTES):
        data, offsets = arrow_text(part["text"])
        first = before + spans(data, offsets, _NOT_SPACE)[2]
        before, held = int(first[-1]), -1
        while k < len(cuts) and starts[cuts[k]] < before:
            a, b = int(cuts[k]), int(cuts[k + 1]) if k + 1 < len(cuts) else len(starts)
            doc = int(np.searchsorted(first, starts[a], "right")) - 1
            if doc != held:
                held, words = doc, data[offsets[doc] : offsets[doc + 1]].tobytes().split()
            lo, hi = int(starts[a] - first[doc]), int(starts[b - 1] - first[doc]) + width
            yield b" ".join(words[lo:hi]), np.unique(need["to"][at[a] : at[b]]).tolist()
            k += 1


def repeated(docs: DataFrame, width: int = WIDTH, phrase: int = PHRASE, texts_too: bool = True, span: int = SPAN) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept: a row for each document."""
    deal = partitions(docs)
    blocks, shards = max(partitions(docs, BLOCK_BYTES), 2 * deal), deal
    dealt = texts(docs).withColumn("h", F.xxhash64("doc_id", "text")).withColumn("block", F.pmod(F.col("h"), F.lit(blocks))).repartition(deal, "block")
    number = lambda group: group["block"][0].as_py()

    def anchors(group: pa.Table) -> pa.Table:
        keys, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for _, w in _words(group, width, phrase):
            own = np.unique(w.anchors)
            found, count = np.unique(w.phrases[_within(w.phrases, own)], return_counts=True)
            keys.append(found)
            counts.append(count)
        keys, of = np.unique(np.concatenate(keys), return_inverse=True)
        records = np.zeros(len(keys), _ANCHOR)
        records["key"], records["own"] = keys, np.bincount(of, np.concatenate(counts), len(keys)) > 1
        return _deal(number(group), records, shards, span)

    def candidates(group: pa.Table, replies: pa.Table) -> pa.Table:
        if not group.num_rows:
            return _deal(0, np.zeros(0, _WINDOW), shards, span)
        recurring, found = np.sort(_told(replies, "<u8")), [np.zeros(0, _WINDOW)]
        for before, w in _words(group, width, phrase):
            starts = w.starts[_within(w.anchors, recurring)]
            a, b = w.identities(starts)
            own = np.zeros(len(a), _WINDOW)
            own["key"], own["more"], own["at"], own["region"] = a, (b >> U64(33)).astype(np.uint32) << 1, before + starts, w.regions(starts)
            found.append(own)
        own = np.concatenate(found)
        own = own[np.lexsort((own["at"], own["more"], own["key"]))]
        new = np.ones(len(own), bool)
        new[1:] = (own["key"][1:] != own["key"][:-1]) | (own["more"][1:] != own["more"][:-1])
        count = np.diff(np.append(np.flatnonzero(new), len(own)))
        own = own[new]
        own["more"] |= (count > 1).astype(np.uint32)
        return _deal(number(group), own, shards, span)

    def passages(group: pa.Table, replies: pa.Table) -> pa.Table:
        rows = list(_passages(_ordered(group), _told(replies, _NEED), width)) if group.num_rows and replies.num_rows else []
        return _table(rows, {"passage": pa.binary(), "blocks": pa.list_(pa.int64())})

    def cut_out(group: pa.Table, sent: pa.Table) -> pa.Table:
        kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()} | ({"kept": pa.string()} if texts_too else {})
        automata, rows = finders(sent["passage"].to_pylist(), width, phrase) if group.num_rows else [], []
        for doc, text in zip(group["doc_id"].to_pylist(), group["text"]):
            words = text.as_buffer().to_pybytes().split()
            gone = removed(words, automata)
            kept = b" ".join(words if gone is None else compress(words, gone.translate(_FLIP)))
            rows.append((doc, len(words), 0 if gone is None else sum(gone), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if texts_too else [])))
        return _table(rows, kinds)

    def meet(sent: DataFrame, kind: np.dtype) -> DataFrame:
        """What the shards tell the blocks, grouped by block."""
        out = "up boolean, shard int, block long, packed binary"
        several = blocks > span
        told = sent.repartition(deal, "shard", "span").groupBy("shard", "span").applyInArrow(_meet(kind, False, several), out)
        if several:
            told = cut(told, "told")
            settled = told.where("up").repartition(deal, "shard").groupBy("shard").applyInArrow(_meet(kind, True, False), out)
            told = told.where("NOT up").unionByName(settled)
        return told.select("block", "packed").repartition(deal, "block").groupBy("block")

    by_block = dealt.groupBy("block")
    recurring = meet(by_block.applyInArrow(anchors, _PACKED), _ANCHOR)
    needed = meet(by_block.cogroup(recurring).applyInArrow(candidates, _PACKED), _WINDOW)
    sent = by_block.cogroup(needed).applyInArrow(passages, "passage binary, blocks array<long>").select(F.explode("blocks").alias("block"), "passage")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts_too
    return by_block.cogroup(sent.repartition(deal, "block").groupBy("block")).applyInArrow(cut_out, schema)


_FLIP = bytes([1, 0, *range(2, 256)])


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(table(spark, sf_dir, "documents"), texts_too=False)
