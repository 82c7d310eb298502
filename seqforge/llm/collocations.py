"""Phrase collocation mining by contiguous pattern growth (operator 12).

Texts have A-Z lowered and are split at marks and line ends into pieces, and those at spaces and tabs into
words. Phrases of 2 to ``most`` words that occur ``least`` times or more within pieces are candidates, each
language by itself; the weakest cut of a candidate in two gives its score.

1. encode   documents become blocks of one language, of a few megabytes, where they are read: a vocabulary and
            a sequence of its numbers. Everything after this works on the blocks;
2. meet     blocks send counts of their distinct words and pairs of neighbours to shards by hash, and are told
            which pairs are frequent. A phrase has none but frequent pairs, so the rest of the text is done with;
3. project  from each frequent pair on, a block follows the words to the right while pairs stay frequent, up to
            ``most``: the occurrences of a prefix are projected to what follows it. Equal ones are counted once
            with their number, and go to the task of their prefix;
4. grow     a task has all that follows a prefix, sorted: it extends the prefix by one word, depth first, as
            long as ``least`` occurrences remain. Each frequent phrase is counted in the task of its first two
            words and nowhere else. A prefix of more than ``hot`` occurrences is dealt to tasks by its first four
            words instead; its counts of two and three words are sums over these tasks.

Shards see SPAN blocks at a time; beyond that their sums meet in a second round, so that a word in every
block costs a shard no more than SPAN records. Words are known by 64-bit hashes, checked by 32 more: if two
frequent words of the corpus share the former, all is done again with others. Counts are exact.

Null texts are empty, a null language is ``und``. Rows that repeat count each. Empty tables give no rows;
other columns are ignored. A task needs about thirty times the bytes of its longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, partitions, table, texts
from .phrases import _split, _table, _within
from .textbuf import U64, SpanHasher, arrow_text, byte_table, mix64, spans
from .tokenizing import slices

LEAST, MOST, TOP, SHARE = 100, 5, 2000, 100
BLOCK_BYTES = 4 << 20
SLICE_BYTES = 1 << 18  # of text, hashed at once
SPAN = 1 << 16  # blocks whose records meet in one shard
SHARDS = 4  # for each task, so that tasks are even
HOT = 1 << 16  # occurrences of a prefix beyond which it is dealt to several tasks
PARTS = 32  # in which a language's phrases are ranked first
SEEDS = 4
_MARKS = byte_table(b".,;:!?\n\x0b\x0c\r")
_WORD = ~(_MARKS | byte_table(b" \t"))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_COUNT = np.dtype([("key", "<u8"), ("n", "<u4")])  # up to _ENOUGH
_ENOUGH = (1 << 32) - 1
_NAMED = np.dtype([("key", "<u8"), ("n", "<u8"), ("check", "<u4")])
_BLOCK = {"block": pa.int64(), "lang": pa.string(), "n": pa.int64(), "vocabulary": pa.binary(), "keys": pa.binary(), "checks": pa.binary(), "width": pa.int32(), "sequence": pa.binary()}
_SENT = {"shard": pa.int32(), "span": pa.int32(), "block": pa.int64(), "lang": pa.string(), "words": pa.binary(), "pairs": pa.binary()}
_MET = {"shard": pa.int32(), "block": pa.int64(), "packed": pa.binary(), "hot": pa.binary(), "lang": pa.string(), "word": pa.int64(), "n": pa.int64(), "clash": pa.bool_()}
_CELL = {"shard": pa.int32(), "span": pa.int32(), "lang": pa.string(), "hot": pa.bool_(), "packed": pa.binary(), "keys": pa.binary(), "spelled": pa.binary()}
_GROWN = {"words": pa.list_(pa.int64()), "n": pa.int64(), "lang": pa.string(), "word": pa.string()}


def _schema(kinds: dict) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{c} {names[t]}" for c, t in kinds.items())


def _followed(most: int) -> np.dtype:
    return np.dtype([("w", "<u8", (most,)), ("n", "<u8")])


def _tongue(lang: str, seed: int) -> np.uint64:
    raw = np.frombuffer(b"\0" + lang.encode(), np.uint8)
    return SpanHasher(seed + 400).bytes(raw, np.array([0]), np.array([len(raw)]))[0]


class Encoder:
    """Blocks of texts of one language: numbers of words, 0 between pieces."""

    def __init__(self, seed: int):
        self.seed, self.hasher, self.checker = seed, SpanHasher(seed + 100), SpanHasher(seed + 200)

    def _words(self, column: pa.Array):
        """(hash of each word, whether a piece begins with it, its bytes as slices give them) of some texts at a time."""
        for part in slices(pa.RecordBatch.from_arrays([column], ["text"]), "text", SLICE_BYTES):
            data, offsets = arrow_text(part["text"])
            data = _LOWER[data]
            start, end, first = spans(data, offsets, _WORD)
            marks = np.cumsum(_MARKS[data], dtype=np.int64)
            apart = np.zeros(len(start), bool)
            apart[1:] = marks[start[1:] - 1] > marks[end[:-1] - 1]
            apart[first[:-1][first[:-1] < len(start)]] = True
            yield self.hasher.bytes(data, start, end), apart, data, start, end

    def row(self, block: int, lang: str, column: pa.Array) -> tuple:
        keys, apart, spelled = [np.zeros(0, U64)], [np.zeros(0, bool)], {}
        for own, breaks, data, start, end in self._words(column):
            keys.append(own)
            apart.append(breaks)
            raw, (found, at) = data.tobytes(), np.unique(own, return_index=True)
            for k, a, b in zip(found.tolist(), start[at].tolist(), end[at].tolist()):
                if k not in spelled:
                    spelled[k] = raw[a:b]
        keys, number = np.unique(np.concatenate(keys), return_inverse=True)
        n, width = len(number), 2 if len(keys) < 1 << 16 else 4
        sequence = np.insert(number.astype(f"<u{width}") + np.array(1, f"<u{width}"), np.flatnonzero(np.concatenate(apart)), 0)
        words = [spelled[k] for k in keys.tolist()]
        vocabulary, size = b" ".join(words), np.array([len(w) for w in words], np.int64)
        start = np.cumsum(size + 1) - size - 1
        checks = (self.checker.bytes(np.frombuffer(vocabulary, np.uint8), start, start + size) >> U64(32)).astype("<u4")
        keys = mix64(keys ^ _tongue(lang, self.seed))
        keys[keys == 0] = 1
        return block, lang, n, vocabulary, keys.astype("<u8").tobytes(), checks.tobytes(), width, sequence.tobytes()


def encoded(docs: DataFrame, seed: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        coder, block = Encoder(seed), TaskContext.get().partitionId() << 32
        held: dict[str, list] = {}
        size: dict[str, int] = {}

        def give(lang):
            nonlocal block
            block += 1
            del size[lang]
            return _table([coder.row(block, lang, pa.concat_arrays(held.pop(lang)))], _BLOCK).to_batches()[0]

        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), object)
            lengths = np.diff(arrow_text(batch["text"])[1])
            for lang in sorted(set(langs)):
                rows = np.flatnonzero((langs == lang) & (lengths > 0))
                turn = (np.cumsum(lengths[rows]) // block_bytes).astype(np.int64)
                for part in np.split(rows, np.flatnonzero(np.diff(turn)) + 1) if len(rows) else ():
                    held.setdefault(lang, []).append(batch["text"].take(pa.array(part)).cast(pa.large_string()))
                    size[lang] = size.get(lang, 0) + int(lengths[part].sum())
                    if size[lang] >= block_bytes:
                        yield give(lang)
                    elif sum(size.values()) >= 4 * block_bytes:
                        yield give(max(size, key=size.get))
        for lang in list(held):
            yield give(lang)

    docs = texts(docs, F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).select("lang", "text")
    return cut(docs.mapInArrow(run, _schema(_BLOCK)), "blocks")


class Block:
    """A block's words, and its distinct pairs of neighbours."""

    def __init__(self, row: dict):
        self.number, self.lang = row["block"], row["lang"]
        self.keys = np.frombuffer(row["keys"], "<u8")
        self.checks = np.frombuffer(row["checks"], "<u4")
        self.sequence = np.frombuffer(row["sequence"], f"<u{row['width']}").astype(np.int64)
        self.vocabulary = row["vocabulary"]
        a, b = self.sequence[:-1], self.sequence[1:]
        self.places = np.flatnonzero((a > 0) & (b > 0))
        pairs, self.of = np.unique(a[self.places] << 32 | b[self.places], return_inverse=True)
        self.pairs = mix64(self.keys[(pairs >> 32) - 1] + mix64(self.keys[(pairs & 0xFFFFFFFF) - 1], 7), 5) if len(pairs) else np.zeros(0, U64)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        words, pairs = np.zeros(len(self.keys), _NAMED), np.zeros(len(self.pairs), _COUNT)
        words["key"], words["n"], words["check"] = self.keys, np.bincount(self.sequence, minlength=len(self.keys) + 1)[1:], self.checks
        pairs["key"], pairs["n"] = self.pairs, np.bincount(self.of, minlength=len(self.pairs))
        return words, pairs

    def projected(self, frequent: np.ndarray, hot: np.ndarray, most: int):
        """(numbers of words, number of occurrences, prefix is hot) of what follows frequent pairs, the pair included."""
        good = np.zeros(len(self.sequence) + most, bool)
        good[self.places] = _within(self.pairs, frequent)[self.of]
        warm = np.zeros(len(good), bool)
        warm[self.places] = _within(self.pairs, hot)[self.of]
        at = np.flatnonzero(good)
        rows, on = np.zeros((len(at), most), np.int64), np.ones(len(at), bool)
        padded = np.append(self.sequence, np.zeros(most, np.int64))
        rows[:, 0] = padded[at]
        for k in range(1, most):
            on &= good[at + k - 1]
            rows[:, k] = np.where(on, padded[at + k], 0)
        turn = np.lexsort(rows.T[::-1])
        rows, warm = rows[turn], warm[at][turn]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        return rows[first], np.diff(np.append(first, len(rows))), warm[first]


def _block(group: pa.Table) -> Block:
    return Block(group.slice(0, 1).to_pylist()[0])


def _joined(column: pa.ChunkedArray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(records of all cells, the cell of each)."""
    cells = [np.frombuffer(x, kind) for x in column.to_pylist()]
    return (np.concatenate(cells) if cells else np.zeros(0, kind)), np.repeat(np.arange(len(cells)), [len(c) for c in cells])


def _summed(records: np.ndarray, of: np.ndarray, *by: str):
    """(records in order, cells likewise, first of each key, its sum, each record's key) by "key" and what else is named."""
    turn = np.lexsort([records[c] for c in (*by[::-1], "key")]) if by else np.argsort(records["key"], kind="stable")
    records, of = records[turn], of[turn]
    new = np.ones(len(records), bool)
    new[1:] = np.any([records[c][1:] != records[c][:-1] for c in ("key", *by)], axis=0)
    first = np.flatnonzero(new)
    return records, of, first, np.add.reduceat(records["n"].astype(U64), first) if len(first) else np.zeros(0, U64), np.cumsum(new) - 1


def _gather(group: pa.Table) -> pa.Table:
    """One span's cells of a shard, its counts summed: a cell for each language's words, one for pairs; ``block`` is the span."""
    words, of, first, n, _ = _summed(*_joined(group["words"], _NAMED), "check")
    own = words[first].copy()
    own["n"] = n
    pairs, _, at, sums, _ = _summed(*_joined(group["pairs"], _COUNT))
    total = np.zeros(len(at), _COUNT)
    total["key"], total["n"] = pairs["key"][at], np.minimum(sums, _ENOUGH)
    langs, head = group["lang"].to_pylist(), (group["shard"][0].as_py(), 0, group["span"][0].as_py())
    tongues = np.array([langs[k] for k in of[first]], object)
    rows = [(*head, lang, own[tongues == lang].tobytes(), b"") for lang in sorted(set(tongues))]
    return _table([*rows, (*head, None, b"", total.tobytes())], _SENT)


def _settle(least: int, hot: int):
    """For all cells of a shard: which pairs are frequent, for each sender that has them, and the frequent words."""

    def run(group: pa.Table) -> pa.Table:
        shard, senders = group["shard"][0].as_py(), group["block"].to_numpy()
        pairs, of, _, n, number = _summed(*_joined(group["pairs"], _COUNT))
        often = n[number] >= least
        told, of = pairs[often], of[often]
        told["n"] = (n[number] > hot)[often]
        rows = []
        for sender, own in _split(senders[of], told):
            rows.append((shard, sender, own["key"].tobytes(), own["key"][own["n"] > 0].tobytes(), None, None, None, False))
        words, of, first, n, number = _summed(*_joined(group["words"], _NAMED))
        langs = group["lang"].to_pylist()
        clash = len(first) > 0 and np.maximum.reduceat(words["check"], first) != np.minimum.reduceat(words["check"], first)
        for k in np.flatnonzero(n >= least).tolist():
            at = first[k]
            rows.append((shard, None, None, None, langs[of[at]], int(words["key"][at].astype(np.int64)), int(n[k]), bool(clash[k])))
        return _table(rows, _MET)

    return run


def _hand_on(cells: pa.Table, told: pa.Table) -> pa.Table:
    """What a span was told, for each of its blocks."""
    rows = []
    often, hot = (np.sort(_joined(told[c], np.dtype("<u8"))[0]) for c in ("packed", "hot"))
    for shard, block, pairs in zip(cells["shard"].to_pylist(), cells["block"].to_pylist(), cells["pairs"].to_pylist()):
        keys = np.frombuffer(pairs, _COUNT)["key"]
        mine = keys[_within(keys, often)]
        if len(mine):
            rows.append((shard, block, mine.tobytes(), mine[_within(mine, hot)].tobytes(), None, None, None, False))
    return _table(rows, _MET)


def _merged(most: int):
    """One span's cells of a shard as one, equal rows counted together, each word spelled once."""

    def run(group: pa.Table) -> pa.Table:
        shard, span, rows = group["shard"][0].as_py(), group["span"][0].as_py(), []
        for hot in (False, True):
            rows.append((shard, span, None, hot, _followers(group, hot, most).tobytes(), b"", b""))
        for lang, spelt in _spelled(group).items():
            rows.append((shard, span, lang, None, b"", np.array(list(spelt), "<u8").tobytes(), b" ".join(spelt.values())))
        return _table(rows, _CELL)

    return run


def _followers(group: pa.Table, hot: bool, most: int) -> np.ndarray:
    """The rows of a shard's cells in order, equal ones counted together."""
    import pyarrow.compute as pc

    records, _ = _joined(group.filter(pc.equal(group["hot"], hot))["packed"], _followed(most))
    records = records[np.lexsort(records["w"].T[::-1])]
    if not len(records):
        return records
    first = np.flatnonzero(np.append(True, (records["w"][1:] != records["w"][:-1]).any(axis=1)))
    out = records[first].copy()
    out["n"] = np.add.reduceat(records["n"], first)
    return out


def _spelled(group: pa.Table) -> dict[str, dict[int, bytes]]:
    out: dict[str, dict[int, bytes]] = {}
    for lang, keys, spelled in zip(group["lang"].to_pylist(), group["keys"].to_pylist(), group["spelled"].to_pylist()):
        if keys:
            out.setdefault(lang, {}).update(zip(np.frombuffer(keys, "<u8").tolist(), spelled.split(b" ")))
    return out


def extended(rows: np.ndarray, least: int, shared: int = 0):
    """(words, n) of each frequent phrase that begins a row, depth first. rows: sorted, distinct.

    Phrases of fewer than ``shared`` words, two at least, are given with whatever number of them is here."""
    words, n, most = rows["w"], rows["n"], rows["w"].shape[1]

    def extend(lo: int, hi: int, prefix: tuple):
        column = words[lo:hi, len(prefix)]
        cuts = np.flatnonzero(column[1:] != column[:-1]) + 1
        bounds = [lo, *(lo + cuts).tolist(), hi]
        sums = np.add.reduceat(n[lo:hi], [x - lo for x in bounds[:-1]]).tolist()
        for a, b, count in zip(bounds, bounds[1:], sums):
            word = int(column[a - lo])
            if not word:
                continue
            longer = (*prefix, word)
            if len(longer) > 1 and (count >= least or len(longer) < shared):
                yield longer, count
            if len(longer) < most and count >= least:
                yield from extend(a, b, longer)
            elif len(longer) + 1 < shared:
                yield from extend(a, b, longer)

    if len(rows):
        yield from extend(0, len(rows), ())


def _grow(least: int, most: int):
    def run(group: pa.Table) -> pa.Table:
        signed = lambda words: np.array(words, U64).view(np.int64).tolist()
        rows = [(signed(w), n, None, None) for w, n in extended(_followers(group, False, most), least)]
        rows += [(signed(w), n, None, None) for w, n in extended(_followers(group, True, most), least, 4)]
        rows += [(signed([key]), None, lang, word.decode()) for lang, spelt in _spelled(group).items() for key, word in spelt.items()]
        return _table(rows, _GROWN)

    return run


def _mined(docs: DataFrame, seed: int, least: int, most: int, block_bytes: int, span: int, hot: int):
    """(totals by language, frequent words, phrases and spellings), None if words clash under this seed."""
    deal = partitions(docs)
    shards = SHARDS * deal
    blocks = encoded(docs, seed, block_bytes)
    spans_ = blocks.count() // span + 1
    placed = blocks.withColumn("span", F.pmod(F.xxhash64("block"), F.lit(spans_)).cast("int"))

    def counts(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                group = pa.Table.from_batches([batch.slice(row, 1)])
                block, own = _block(group), group["span"][0].as_py()
                words, pairs = ({k: x.tobytes() for k, x in _split((r["key"] % U64(shards)).astype(np.int64), r)} for r in block.counts())
                cells = [(k, own, block.number, block.lang, words.get(k, b""), pairs.get(k, b"")) for k in sorted({*words, *pairs})]
                yield from _table(cells, _SENT).to_batches()

    sent = placed.mapInArrow(counts, _schema(_SENT))
    if spans_ == 1:
        met = sent.repartition(deal, "shard").groupBy("shard").applyInArrow(_settle(least, hot), _schema(_MET))
    else:
        sent = cut(sent, "sent").repartition(deal, "shard", "span").groupBy("shard", "span")
        met = cut(sent.applyInArrow(_gather, _schema(_SENT)).repartition(deal, "shard").groupBy("shard").applyInArrow(_settle(least, hot), _schema(_MET)), "settled")
        told = met.where("packed IS NOT NULL").withColumn("span", F.col("block").cast("int")).repartition(deal, "shard", "span").groupBy("shard", "span")
        met = met.where("packed IS NULL").unionByName(sent.cogroup(told).applyInArrow(_hand_on, _schema(_MET)))
    met = cut(met, "met")
    if not met.where("clash").isEmpty():
        discard(blocks, met)
        return None

    def project(group: pa.Table, told: pa.Table) -> pa.Table:
        if not group.num_rows or not told.num_rows:
            return _table([], _CELL)
        block, row = _block(group), group["span"][0].as_py()
        often, warm = (np.sort(_joined(told[c], np.dtype("<u8"))[0]) for c in ("packed", "hot"))
        numbers, n, is_hot = block.projected(often, warm, most)
        records = np.zeros(len(numbers), _followed(most))
        records["w"], records["n"] = np.append(U64(0), block.keys)[numbers], n
        route = mix64(records["w"][:, 0] + mix64(records["w"][:, 1], 3))
        route[is_hot] = mix64(route[is_hot] + mix64(records["w"][is_hot, min(2, most - 1)], 11) + mix64(records["w"][is_hot, min(3, most - 1)], 12))
        shard, rows = (route % U64(shards)).astype(np.int64), []
        for kind in (False, True):
            here = is_hot == kind
            rows += [(k, row, None, kind, x.tobytes(), b"", b"") for k, x in _split(shard[here], records[here])]
        used = np.unique(numbers)
        used, spelled = used[used > 0] - 1, block.vocabulary.split(b" ")
        for k, x in _split((block.keys[used] % U64(shards)).astype(np.int64), used):
            rows.append((k, row, block.lang, None, b"", block.keys[x].tobytes(), b" ".join([spelled[i] for i in x.tolist()])))
        return _table(rows, _CELL)

    replies = met.where("packed IS NOT NULL").select("block", "packed", "hot").repartition(deal, "block").groupBy("block")
    cells = placed.repartition(deal, "block").groupBy("block").cogroup(replies).applyInArrow(project, _schema(_CELL))
    if spans_ > 1:
        cells = cells.repartition(deal, "shard", "span").groupBy("shard", "span").applyInArrow(_merged(most), _schema(_CELL))
    grown = cut(cells.repartition(deal, "shard").groupBy("shard").applyInArrow(_grow(least, most), _schema(_GROWN)), "grown")
    return blocks.groupBy("lang").agg(F.sum("n").alias("total")), met.where("word IS NOT NULL").select(F.array("word").alias("words"), "n"), grown


def candidates(docs: DataFrame, least: int = LEAST, most: int = MOST, block_bytes: int = BLOCK_BYTES, span: int = SPAN, hot: int = HOT, seeds=range(SEEDS)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, total), (words, n) and (words, n, lang, word) as _mined gives them, with the first seed that works."""
    for seed in seeds:
        found = _mined(docs, seed, least, most, block_bytes, span, hot)
        if found is not None:
            return found
    raise ValueError("words share their hashes under every seed")


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST, top: int = TOP, share: int = SHARE, **dealing) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases by the score of their weakest cut.

    A candidate is dropped if a longer one that holds it has ``share`` percent of its occurrences or more: one
    longer by a word then has too, as occurrences only fall with length."""
    totals, words, grown = candidates(docs, least, most, **dealing)
    phrases = cut(grown.where("n IS NOT NULL").groupBy("words").agg(F.sum("n").alias("a")).where(F.col("a") >= least), "phrases")
    spelled = grown.where("word IS NOT NULL").select(F.col("words")[0].alias("key"), "lang", "word").distinct()
    known = words.unionByName(phrases.select("words", F.col("a").alias("n")))
    cuts = phrases.select("words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("words", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("left"), F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    cuts = cuts.join(known.select(F.col("words").alias("left"), F.col("n").alias("l")), "left").join(known.select(F.col("words").alias("right"), F.col("n").alias("r")), "right")
    tongue = phrases.select("words", F.col("words")[0].alias("key")).join(spelled.select("key", "lang"), "key").join(totals, "lang").select("words", "lang", F.col("total").alias("n"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    scored = cuts.join(tongue, "words").withColumns({"above": F.lit(1000).cast("decimal(20,0)") * wide("a") * wide("n"), "below": wide("l") * wide("r")})
    scored = scored.withColumn("score", F.expr("above div below"))
    best = scored.groupBy("words", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    size = F.size("words")
    longer = phrases.where(size > 2).select("a", F.explode(F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))).alias("words"))
    held = longer.groupBy("words").agg(F.max("a").alias("longest"))
    kept = best.join(held, "words", "left").where(F.col("longest").isNull() | (100 * F.col("longest") < share * F.col("a")))
    each = kept.select("words", F.posexplode("words").alias("at", "key")).join(spelled.select("key", "word"), "key")
    spelt = each.groupBy("words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = kept.join(spelt, "words").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*by))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)
  GROUP BY lang, m, phrase),
c AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS s, f AS a FROM g WHERE m > 1 AND f >= 100),
k AS (SELECT lang, phrase, a, k, array_to_string(s[1:k], ' ') AS x, array_to_string(s[k + 1:m], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
v AS (
  SELECT k.lang, k.phrase, a, k, gx.f AS l, gy.f AS r, n, CAST((1000::HUGEINT * a * n) // (gx.f::HUGEINT * gy.f) AS BIGINT) AS score
  FROM k JOIN g AS gx ON gx.lang = k.lang AND gx.phrase = x JOIN g AS gy ON gy.lang = k.lang AND gy.phrase = y JOIN t ON t.lang = k.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS turn FROM v),
u AS (
  SELECT lang, a, array_to_string(s[i:i + z - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, m - z + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS z FROM c WHERE m > 2))),
o AS (SELECT lang, phrase, max(a) AS longest FROM u GROUP BY lang, phrase),
r AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank
  FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE turn = 1 AND (longest IS NULL OR 100 * longest < 100 * b.a))
SELECT lang, rank, phrase, a, l, r, n, score FROM r WHERE rank <= 2000
"""
