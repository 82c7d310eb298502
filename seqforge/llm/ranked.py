"""Ranked lexical search over dual-sorted wavelet trees (operator 13).

Documents are cut into shards where they are read, without a shuffle: as many documents, in the order of
their doc_ids, as hold SHARD_BYTES of text, one at least. A shard holds the posting lists of all its terms,
one after another, each in the order of falling impact (what a term adds to a document's score, but for the
term's weight), as one sequence of document numbers; and over it a wavelet tree of the documents' bits. A
range of the sequence, a list or several, can so be followed down to any range of doc_ids, and the order of
impact stays on the way: the first entry of a list's range at a node has the greatest impact of the list in
that subtree. The sum of weight times that, over the terms of a query, bounds the scores below the node, and
is the score itself at a leaf.

    search    nodes are expanded by falling bound, those of least doc_id first, BATCH at a time; a node goes when
              its bound is below the k-th best score so far (or equals it, with no lesser doc_id below the node)
    shards    a task keeps each query's k best documents over all shards that it reads, so that later shards
              are cut off early; it gives k rows a query, which meet in two rounds of ranking

Scores are exact, and so are the k best. Document frequencies are summed over all shards first. Queries are
handled in blocks of about BLOCK_BYTES of text, whose terms go to all tasks; nothing else is sent round, and
what reaches the driver is the terms of a block and their frequencies.

Terms are runs of letters, digits and characters beyond ASCII, with A-Z lowered, and known by 64-bit hashes.
Null texts have no terms: such documents never score, such queries have no rows. Queries that repeat, by id or
text, are ranked on their own; documents that repeat each have a rank, null doc_ids before others. An empty
table gives no rows; other columns are ignored. A task needs about fifty times SHARD_BYTES or the bytes of its
longest text, whichever is more.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, texts
from .textbuf import U64, SpanHasher, arrow_text, byte_table, spans
from .tokenizing import slices

TOP = 10
SHARD_BYTES, SHARD_DOCUMENTS = 4 << 20, 1 << 16
BLOCK_BYTES = 1 << 20  # of queries' text handled at once
BATCH, CELLS = 32, 1 << 17  # nodes expanded at once; at most so many (node, term) pairs
SALTS = 64  # parts in which a query's rows of all tasks are ranked first
#: Fixed values of the score.
SCALE, LENGTH_PART, LENGTH_WHOLE = 1_000_000_000, 90, 100
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = byte_table(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))
_INDEX = "n int, ids binary, held binary, keys binary, starts binary, bits binary, impacts binary"


def terms(column, hasher: SpanHasher) -> tuple[np.ndarray, np.ndarray]:
    """(a hash for each term, the first term of each text) of an Arrow column."""
    data, offsets = arrow_text(column)
    data = _LOWER[data]
    start, end, first = spans(data, offsets, _TERM)
    return hasher.bytes(data, start, end), first


def totals(docs: DataFrame) -> tuple[int, int]:
    """(documents that have a term, terms of all documents)."""

    def run(batches):
        n = length = 0
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = arrow_text(part["text"])
                count = np.diff(spans(data, offsets, _TERM)[2])
                n, length = n + int((count > 0).sum()), length + int(count.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([length], pa.int64())], ["n", "length"])

    row = texts(docs).select("text").mapInArrow(run, "n long, length long").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).first()
    return int(row.n or 0), int(row.length or 0)


def impacts(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term adds to a document's score for each unit of its weight."""
    fits = LENGTH_PART * n * int(length.max(initial=0)) < 1 << 63
    share = LENGTH_PART * length * n // total if fits else np.array([LENGTH_PART * x * n // total for x in length.tolist()], np.int64)
    return SCALE * tf // (1000 * tf + 8 * (LENGTH_WHOLE - LENGTH_PART + share))


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def levels(bits: np.ndarray, values: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(zeros before each place, zeros, values) of each level, from a level's bits and the values of the top one."""
    m = len(values)
    zeros, whole, held = np.zeros((depth, m + 1), np.int32), np.zeros(depth, np.int64), np.empty((depth + 1, m), values.dtype)
    held[0] = values
    for k in range(depth):
        one = bits[k].astype(bool)
        np.cumsum(~one, out=zeros[k, 1:])
        whole[k] = zeros[k, -1]
        held[k + 1, : whole[k]] = held[k][~one]
        held[k + 1, whole[k] :] = held[k][one]
    return zeros, whole, held


class Tree:
    """A shard: posting lists by impact, navigable by document number."""

    def __init__(self, n: int, ids: np.ndarray, held: np.ndarray, keys: np.ndarray, starts: np.ndarray, bits: np.ndarray, top: np.ndarray):
        self.n, self.ids, self.held, self.keys, self.starts = n, ids, held, keys, starts
        self.depth = max(0, n - 1).bit_length()
        self.zeros, self.whole, self.impacts = levels(np.unpackbits(bits).reshape(self.depth, -1)[:, : len(top)] if self.depth else bits, top, self.depth)

    @classmethod
    def of(cls, row: dict) -> Tree:
        as_ = lambda name, kind: np.frombuffer(row[name], kind)
        return cls(row["n"], as_("ids", "<i8"), as_("held", "u1"), as_("keys", "<u8"), as_("starts", "<u4"), as_("bits", "u1"), as_("impacts", "<u4"))

    def lists(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) of the list of each sorted or unsorted key; equal where there is none."""
        at = np.searchsorted(self.keys, wanted)
        there = at < len(self.keys)
        there[there] = self.keys[at[there]] == wanted[there]
        at = np.where(there, at, 0)
        return np.where(there, self.starts[at], 0).astype(np.int64), np.where(there, self.starts[np.minimum(at + 1, len(self.starts) - 1)], 0).astype(np.int64)

    def order(self, document: int) -> tuple:
        """What documents of equal score are ordered by."""
        return bool(self.held[document]), int(self.ids[document])

    def best(self, left: np.ndarray, right: np.ndarray, weights: np.ndarray, k: int, found: list) -> list:
        """The k best of ``found`` and of this shard's documents, as (-score, (has an id, id)), in order.

        left, right: the lists of the query's terms, none of them empty."""
        worst = found[-1] if len(found) == k else (0,)  # what is not before it is of no use
        bound = np.array([(weights * self.impacts[0][left]).sum()])
        level, code, left, right = np.zeros(1, np.int64), np.zeros(1, np.int64), left[None, :], right[None, :]
        batch = max(1, min(BATCH, CELLS // len(weights)))
        while len(bound):
            useful = bound >= max(1, -worst[0])
            if len(worst) > 1 and (ties := np.flatnonzero(bound == -worst[0])).size:
                useful[ties] = [self.order(c) < worst[1] for c in (code[ties] << (self.depth - level[ties])).tolist()]
            if not useful.all():
                bound, level, code, left, right = bound[useful], level[useful], code[useful], left[useful], right[useful]
            if not len(bound):
                break
            turn = np.lexsort((code << (self.depth - level), -bound))
            now, later = turn[:batch], turn[batch:]
            leaf = now[level[now] == self.depth]
            if leaf.size:
                found = sorted(found + [(-s, self.order(c)) for s, c in zip(bound[leaf].tolist(), code[leaf].tolist())])[:k]
                worst = found[-1] if len(found) == k else (0,)
            grown = [(bound[later], level[later], code[later], left[later], right[later])]
            inner = now[level[now] < self.depth]
            if inner.size:
                at = level[inner]
                l0, r0 = self.zeros[at[:, None], left[inner]].astype(np.int64), self.zeros[at[:, None], right[inner]].astype(np.int64)
                past = self.whole[at][:, None]
                for bit, l, r in ((0, l0, r0), (1, past + left[inner] - l0, past + right[inner] - r0)):
                    there = r > l
                    gain = np.where(there, self.impacts[at[:, None] + 1, np.where(there, l, 0)], 0)
                    limit = gain @ weights
                    some = limit > 0
                    grown.append((limit[some], at[some] + 1, 2 * code[inner][some] + bit, l[some], r[some]))
            bound, level, code, left, right = (np.concatenate(x) for x in zip(*grown))
        return found


def _shard(parts: list[pa.RecordBatch], hasher: SpanHasher, n: int, total: int) -> pa.RecordBatch:
    ids = pa.concat_arrays([p["doc_id"] for p in parts])
    held, ids = np.asarray(ids.is_valid()), ids.fill_null(0).to_numpy()
    keys, counts = [], []
    for p in parts:
        own, first = terms(p["text"], hasher)
        keys.append(own)
        counts.append(np.diff(first))
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.lexsort((ids, held))
    number = np.empty(len(ids), np.int64)
    number[order] = np.arange(len(ids))
    document = np.repeat(number, counts)
    turn = np.lexsort((document, keys))
    keys, document = keys[turn], document[turn]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (document[1:] != document[:-1])
    at = np.flatnonzero(new)
    keys, document, tf = keys[at], document[at], np.diff(np.append(at, len(new)))
    length = counts[order][document]
    impact = impacts(tf, length, n, total) if len(tf) else tf
    turn = np.lexsort((document, -impact, keys))
    keys, document, impact = keys[turn], document[turn], impact[turn]
    keys, starts = np.unique(keys, return_index=True)
    depth = max(0, len(ids) - 1).bit_length()
    bits = []
    for k in range(depth):
        one = (document >> (depth - 1 - k) & 1).astype(bool)
        bits.append(np.packbits(one))
        document = np.concatenate((document[~one], document[one]))
    columns = [ids[order].astype("<i8"), held[order].astype("u1"), keys.astype("<u8"), np.append(starts, len(impact)).astype("<u4"), np.concatenate(bits) if bits else np.zeros(0, np.uint8), impact.astype("<u4")]
    return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], names=[c.split()[0] for c in _INDEX.split(", ")])


def index(docs: DataFrame, n: int, total: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row for each shard: all terms of all documents. n, total: of ``totals``."""

    def run(batches):
        hasher, parts, size = SpanHasher(17), [], 0
        rows = 0
        for batch in batches:
            for part in slices(batch, "text", min(shard_bytes, 2 << 20)):
                while part.num_rows:
                    take = min(part.num_rows, SHARD_DOCUMENTS - rows)
                    parts.append(part.slice(0, take))
                    part, rows = part.slice(take), rows + take
                    size += int(arrow_text(parts[-1]["text"])[1][-1])
                    if size >= shard_bytes or rows >= SHARD_DOCUMENTS:
                        yield _shard(parts, hasher, n, total)
                        parts, size, rows = [], 0, 0
        if parts:
            yield _shard(parts, hasher, n, total)

    return cut(texts(docs).mapInArrow(run, _INDEX), "index")


def _queries(items: DataFrame) -> DataFrame:
    """uid, item_id, block, keys (the distinct terms' hashes) of each query, cut."""

    def run(batches):
        hasher = SpanHasher(17)
        for batch in batches:
            keys, first = terms(batch["text"], hasher)
            own = [np.unique(keys[a:b]).astype("<u8").tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch["uid"], pa.array(own, pa.binary()), pa.array([len(x) for x in own], pa.int64())], ["uid", "keys", "size"])

    numbered = cut(items.select(F.monotonically_increasing_id().alias("uid"), "item_id", F.coalesce("text", F.lit("")).alias("text")), "items")
    found = numbered.select("uid", "text").mapInArrow(run, "uid long, keys binary, size long")
    return numbered.select("uid", "item_id"), cut(found.where("size > 0"), "queries")


def _frequencies(shards: DataFrame, wanted: np.ndarray) -> dict[int, int]:
    """In how many documents each wanted key is."""

    def run(batches):
        found = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for keys, starts in zip(batch["keys"], batch["starts"]):
                own, at = np.frombuffer(keys.as_buffer(), "<u8"), np.frombuffer(starts.as_buffer(), "<u4").astype(np.int64)
                place = np.searchsorted(wanted, own)
                hit = np.flatnonzero(place < len(wanted))
                hit = hit[wanted[place[hit]] == own[hit]]
                found[place[hit]] += at[hit + 1] - at[hit]
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(found[some], pa.int64())], ["term", "df"])

    rows = shards.select("keys", "starts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {r.term: r.df for r in rows}


def _searched(shards: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], wanted: np.ndarray, k: int) -> DataFrame:
    """uid, doc_id, score: the k best of each query in what a task reads. queries: uid, places in ``wanted``, weights."""

    def run(batches):
        found: list[list] = [[] for _ in queries]
        for batch in batches:
            for row in range(batch.num_rows):
                tree = Tree.of({c: batch[c][row].as_py() if c == "n" else batch[c][row].as_buffer() for c in batch.schema.names})
                if not len(tree.keys):
                    continue
                begin, end = tree.lists(wanted)
                there = end > begin
                for q, (_, places, weights) in enumerate(queries):
                    own = there[places]
                    if own.any():
                        at = places[own]
                        found[q] = tree.best(begin[at], end[at], weights[own], k, found[q])
        rows = [(queries[q][0], doc if has else None, -score) for q, own in enumerate(found) for score, (has, doc) in own]
        columns = list(zip(*rows)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["uid", "doc_id", "score"])

    return shards.mapInArrow(run, "uid long, doc_id long, score long")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, with their rank: ranked in parts first, so that no task has all rows of a query."""
    by = [F.desc("score"), F.asc_nulls_first("doc_id")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("uid", "salt").orderBy(*by))).where(F.col("rank") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("uid").orderBy(*by))).where(F.col("rank") <= k).drop("salt")


def search(shards: DataFrame, n: int, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item (item_id, text) that score above 0."""
    names, queries = _queries(items)
    size = queries.agg(F.sum("size")).first()[0] or 0
    blocks = size // block_bytes + 1
    found = None
    for b in range(blocks if size and n else 0):
        held = queries.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == b).select("uid", "keys").collect()
        if not held:
            continue
        own = [(r.uid, np.frombuffer(bytes(r["keys"]), "<u8")) for r in held]
        wanted = np.unique(np.concatenate([x for _, x in own]))
        df = _frequencies(shards, wanted)
        weights = np.array([weight(n, df.get(i, 0)) for i in range(len(wanted))], np.int64)
        asked = []
        for uid, keys in own:
            places = np.searchsorted(wanted, keys)
            places = places[weights[places] > 0]
            asked.append((uid, places, weights[places]))
        rows = _ranked(_searched(shards, asked, wanted, k), k)
        rows = cut(rows, "best") if blocks > 1 else rows
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return names.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    return found.join(names, "uid").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    n, total = totals(docs)
    return search(index(docs, n, total, shard_bytes), n, items, k, block_bytes)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {_SPLIT} AS t FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
p AS (SELECT uid, term, count(*) AS tf FROM (SELECT uid, unnest(t) AS term FROM d) GROUP BY uid, term),
q AS (SELECT iid, item_id, unnest(list_distinct(t)) AS term FROM (SELECT row_number() OVER () AS iid, item_id, {_SPLIT} AS t FROM benchmark)),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
x AS (
  SELECT iid, item_id, doc_id, d.uid, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(t) * n) // l)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (uid), s GROUP BY iid, item_id, doc_id, d.uid),
r AS (SELECT item_id, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS FIRST) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""
