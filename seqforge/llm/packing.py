"""Best-fit packing by large-item matching (operator 2).

Documents become token pieces of at most ``capacity`` ids; pieces above a third of the capacity are
matched greedily, two to a sequence at most, and smaller ones, largest first, go to the sequence
whose gap fits best. Lengths are whole numbers up to the capacity, so the whole packing is decided
on the counts of the lengths: at most ``capacity`` numbers reach the driver whatever the corpus, and
the plan that it makes of them is as bounded. Rows then find their place by their rank among the
pieces of their length, without any sort of the corpus or task that sees a whole length.

Null texts are empty texts; an empty text is one piece of the end id alone. Rows that repeat, doc_ids
included, are packed each on its own; a null doc_id stays null. Further columns are ignored. An empty
table gives an empty result. A text of any length is cut into pieces by one task, which needs about
thirty times the bytes of its longest text.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, texts, tokenizer_path
from .tokenizing import slices, tokenizer

CAPACITY = 4096
END_ID = 1


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece, with its rank among the task's pieces of the same length."""

    def run(batches):
        from pyspark import TaskContext

        tok, block, seen = tokenizer(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = tok.ids(part["text"])
                rows = []
                for doc, a, b in zip(part["doc_id"].to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(own), capacity)):
                        x = own[at : at + capacity]
                        rows.append((doc, k, at, len(x), zlib.crc32(x.tobytes()), block, seen[len(x)]))
                        seen[len(x)] += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "block", "nth"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    return texts(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, block int, nth long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, ...]], int]:
    """Where the pieces of each length go: (entries, number of sequences).

    An entry (length, rank, number, sequence, each, offset) places ``number`` pieces from ``rank``
    on, ``each`` of them side by side from ``offset`` in every sequence from ``sequence`` on.
    """
    left = {n: c for n, c in counts.items() if c}
    used, entries, made = Counter(), [], 0
    gaps: dict[int, list[list[int]]] = {}  # gap -> [first sequence, how many]
    order: list[int] = []  # the gaps there are, ascending

    def place(n, number, first, each, offset):
        entries.append((n, used[n], number, first, each, offset))
        used[n] += number
        left[n] -= number

    def hold(gap, first, number):
        if gap and number:
            if gap not in gaps:
                insort(order, gap)
                gaps[gap] = []
            gaps[gap].append([first, number])

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        at = bisect_right(large, capacity - n) - 1
        if at >= 0 and large[at] == n and left[n] == 1:
            at -= 1
        if at < 0:
            number = left[n]
            place(n, number, made, 1, 0)
            hold(capacity - n, made, number)
        elif (m := large[at]) == n:
            number = left[n] // 2
            place(n, 2 * number, made, 2, 0)
            hold(capacity - 2 * n, made, number)
        else:
            number = min(left[n], left[m])
            place(n, number, made, 1, 0)
            place(m, number, made, 1, n)
            hold(capacity - n - m, made, number)
            if not left[m]:
                del large[at]
        made += number
        if not left[n]:
            large.pop()
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(order, n)
            if at == len(order):
                number = -(-left[n] // (capacity // n))
                hold(capacity, made, number)
                made += number
                continue
            gap = order[at]
            first, number = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            each = gap // n
            full, rest = min(number, left[n] // each), left[n] % each
            if full:
                place(n, full * each, first, each, capacity - gap)
                hold(gap - each * n, first, full)
            if full < number and rest and left[n] == rest:
                place(n, rest, first + full, rest, capacity - gap)
                hold(gap - rest * n, first + full, 1)
                full += 1
            hold(gap, first + full, number - full)
    return entries, made


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece."""
    held = cut(pieces(docs, path, capacity, end_id), "pieces")
    blocks = held.groupBy("block", "length").agg(F.count("*").alias("number"))
    counts = {r.length: r.number for r in held.groupBy("length").agg(F.count("*").alias("number")).collect()}
    entries, _ = plan(counts, capacity)
    entries = np.array(sorted(entries), np.int64).reshape(-1, 6)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranks = blocks.select(F.col("block"), F.col("length"), F.coalesce(F.sum("number").over(before), F.lit(0)).alias("before"))
    ranked = held.join(ranks, ["block", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(lambda batches: _places(batches, entries), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _places(batches, entries):
    span = {n: (entries[:, 0].searchsorted(n), entries[:, 0].searchsorted(n, "right")) for n in set(entries[:, 0].tolist())}
    for batch in batches:
        if not batch.num_rows:
            continue
        n, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
        at = np.empty(len(n), np.int64)
        for x in np.unique(n).tolist():
            lo, hi = span[x]
            own = np.flatnonzero(n == x)
            at[own] = lo + np.searchsorted(entries[lo:hi, 1], rank[own], "right") - 1
        e = entries[at]
        k = rank - e[:, 1]
        yield pa.RecordBatch.from_arrays([batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(e[:, 3] + k // e[:, 4]), pa.array(e[:, 5] + k % e[:, 4] * n)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
