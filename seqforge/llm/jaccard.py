"""N-gram Jaccard join by MinHash banding (operator 3).

The n-grams of a document are its runs of ``n`` words (all its words, if they are fewer). Documents of
equal n-gram sets form a class, found by a 128-bit digest; one of each class goes on.

1. bands    MinHash bands; their number and rows are the widest that reach ``recall`` at the threshold;
2. buckets  a shuffle on band hashes; each bucket links its members to its least, so that its edges grow
            with its members, not with their pairs, and connected buckets form candidate groups;
3. verify   the n-gram sets of a group meet in one tile if they are few, else in the tiles of its parts or
            those of its buckets, whichever are cheaper (tiles.py); pairs are compared on their full sets.
            A tile returns one row a set: its number of links, and the least that it is linked to.

The result has a row for each document: class_id, the least doc_id among the documents connected with it
by links; n_links, the number of other documents whose n-gram set has a Jaccard similarity of
``threshold`` or more with its own, copies included; rep_id, the least doc_id with the same n-gram set.
No link is given up: recall is bounded only by the bands, groups of any size are compared whole.

Words are runs of bytes other than white space, unchanged. Null and empty texts have no n-grams, no links
and each is a class of its own. Repeated rows are copies like others and have a row each. A null doc_id
stays null and is no class_id while any other is there. An empty table gives an empty result. Other
columns are ignored. Texts of any length are taken whole; a task needs about thirty times the bytes of
its longest one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions, table, texts
from .components import components
from .tiles import TILE, belong, deal, spread
from .textbuf import SPACE_BYTES, U64, SpanHasher, arrow_text, byte_table, mix64, spans
from .tokenizing import slices

N, THRESHOLD, RECALL, HASHES = 5, 0.8, 0.999, 128
#: Sets in a tile of a group that is not split.
TILE_SETS = 128


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands reach the recall at the threshold within the hashes."""
    for rows in range(hashes, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError("no bands reach this recall with so few hashes")


def gram_sets(column, n: int = N):
    """(grams, offsets): the sorted distinct n-gram hashes of each text."""
    data, offsets = arrow_text(column)
    s, e, first = spans(data, offsets, ~byte_table(SPACE_BYTES))
    words = SpanHasher(13).bytes(data, s, e)
    count = np.diff(first)
    grams = np.where(count == 0, 0, np.maximum(count - n + 1, 1))
    ends = np.cumsum(grams)
    doc = np.repeat(np.arange(len(count)), grams)
    start = first[:-1][doc] + np.arange(len(doc)) - (ends - grams)[doc]
    keys = SpanHasher(17).runs(words, start, np.minimum(count, n)[doc])
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    keys, doc = keys[new], doc[new]
    return keys, np.searchsorted(doc, np.arange(len(count) + 1))


def _signatures(keys, offsets, bands, rows):
    """Band hashes of the texts that have n-grams, as one array of rows x bands."""
    starts = offsets[:-1]
    low = mix64(keys, 5).astype(np.uint32)
    factors = mix64(np.arange(bands * rows, dtype=U64), 29)
    out = np.empty((len(starts), bands), U64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            seen = np.full(len(starts), U64(b))
            for k in range(b * rows, (b + 1) * rows):
                f = int(factors[k])
                hashed = (low ^ np.uint32(f >> 32)) * np.uint32(f & 0xFFFFFFFF | 1)
                seen = mix64(seen ^ np.minimum.reduceat(hashed, starts).astype(U64), b)
            out[:, b] = seen
    return out


SIGNED = "doc_id long, th long, d1 long, d2 long, n int, bands array<long>"


def sign(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """For each document its set's digest and size and its band hashes (none without n-grams)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                keys, offsets = gram_sets(part["text"], n)
                size = np.diff(offsets)
                some = np.flatnonzero(size)
                digests = np.zeros((2, len(size)), U64)
                lists = pa.nulls(len(size), pa.list_(pa.int64()))
                if len(some):
                    compact = np.append(offsets[:-1][some], offsets[-1])
                    with np.errstate(over="ignore"):
                        for d in range(2):
                            digests[d, some] = mix64(np.add.reduceat(mix64(keys, 31 + d), compact[:-1]), d)
                    signed = _signatures(keys, compact, bands, rows)
                    at = np.concatenate(([0], np.cumsum(np.where(size > 0, bands, 0)))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(at), pa.array(signed.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["th"], pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)), pa.array(size, pa.int32()), lists], names=[x.split()[0] for x in SIGNED.split(", ")])

    return texts(docs).withColumn("th", F.xxhash64("text")).mapInArrow(run, SIGNED)


def _intersections(keys, offsets, dense_from: int = 16) -> np.ndarray:
    """The number of shared n-grams of all pairs of texts, as a matrix."""
    m = len(offsets) - 1
    doc = np.repeat(np.arange(m), np.diff(offsets))
    order = np.argsort(keys, kind="stable")
    keys, doc = keys[order], doc[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.append(at, len(keys)))
    out = np.zeros((m, m), np.float32)
    many = np.flatnonzero(count >= dense_from)
    for lo in range(0, len(many), 2048):
        x = np.zeros((min(2048, len(many) - lo), m), np.float32)
        for row, k in enumerate(many[lo : lo + 2048]):
            x[row, doc[at[k] : at[k] + count[k]]] = 1
        out += x.T @ x
    for c in range(2, dense_from):
        own = at[count == c]
        if len(own):
            members = doc[own[:, None] + np.arange(c)]
            for i in range(c):
                for j in range(c):
                    if i != j:
                        np.add.at(out, (members[:, i], members[:, j]), 1)
    return out


def _once(df: DataFrame, n: int) -> DataFrame:
    """The n-gram sets of candidate texts as packed hashes. Rows of one text and doc_id stand for the same
    set; a task lets through the first."""

    def run(batches):
        seen = set()
        for batch in batches:
            for part in slices(batch, "text"):
                each = list(zip(part["d1"].to_pylist(), part["d2"].to_pylist()))
                keep = [i for i, x in enumerate(each) if x not in seen and not seen.add(x)]
                part = part.take(pa.array(keep, pa.int64()))
                keys, offsets = gram_sets(part["text"], n)
                sets = [keys[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                columns = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in columns), pa.array(sets, pa.binary())], names=[*columns, "grams"])

    kept = df.drop("text")
    return df.mapInArrow(run, kept.withColumn("grams", F.lit(b"")).schema)


def compare(group: pa.Table, threshold: float) -> pa.Table:
    """One tile: for each set the weight of the others that it is linked to in the pairs of this tile."""
    d1, d2 = group["d1"].to_numpy(), group["d2"].to_numpy()
    _, one = np.unique(np.stack([d1, d2]), axis=1, return_index=True)
    group = group.take(pa.array(one))
    d1, d2, weight = d1[one], d2[one], group["copies"].to_numpy().astype(np.float64)
    sets = [np.frombuffer(x.as_buffer(), U64) for x in group["grams"].combine_chunks()]
    size = np.array([len(x) for x in sets])
    shared = _intersections(np.concatenate(sets), np.concatenate(([0], np.cumsum(size)))).astype(np.float64)
    linked = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9
    mode, tile, a, b = (group[c][0].as_py() for c in TILE)
    linked &= belong(mode, tile, a, b, group["part"].to_numpy(), group["bands"].to_pylist() if mode else [])
    label = np.argsort(np.argsort(d1, kind="stable"), kind="stable")
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1))
        if (low == label).all():
            break
        label = low
    return pa.table({"d1": d1, "d2": d2, "links": (linked @ weight).astype(np.int64), "other": np.sort(d1)[label]})


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES, tile: int = TILE_SETS) -> DataFrame:
    """doc_id, th (a hash of the text), class_id, n_links, rep_id and first: a row for each document.

    first: whether the row is the one, or a repetition of the one, that stands for its class."""
    bands, rows = choose_bands(threshold, recall, hashes)
    signed = cut(sign(docs, n, bands, rows), "signed")
    reps = cut(signed.where("n > 0").groupBy("d1", "d2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "bands")).alias("r"), F.count("*").alias("copies"), F.max("n").alias("n")).select("d1", "d2", "copies", "n", "r.doc_id", "r.th", "r.bands"), "reps")
    dealt = deal(reps.select(F.col("d1").alias("node"), (F.col("n") * 8).cast("long").alias("size"), F.col("bands").alias("keys")), tile // 2)
    candidates = reps.join(dealt, reps.d1 == dealt.node).select("node", "d1", "d2", "copies", "bands", "deals", F.col("doc_id").alias("cid"), F.col("th").alias("cth"))
    full = texts(docs).withColumn("th", F.xxhash64("text"))
    found = full.join(candidates.hint("shuffle_hash"), (full.th == candidates.cth) & full.doc_id.eqNullSafe(candidates.cid))
    sets = _once(found.select("node", "d1", "d2", "copies", "bands", "deals", "text"), n)
    tiles = spread(sets, "d1", "d2", "copies", "bands", "grams").repartition(partitions(docs), *TILE)
    linked = cut(tiles.groupBy(*TILE).applyInArrow(lambda g: compare(g, threshold), "d1 long, d2 long, links long, other long"), "linked")
    links = linked.groupBy("d1", "d2").agg(F.sum("links").alias("links"))
    roots = components(linked.where("other <> d1").select(F.col("d1").alias("a"), F.col("other").alias("b")))
    named = reps.join(roots, reps.d1 == roots.node, "left").join(links, ["d1", "d2"], "left").select("d1", "d2", "copies", F.col("doc_id").alias("rep_id"), F.col("th").alias("rep_th"), F.coalesce("root", "d1").alias("root"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    order = F.struct(F.col("rep_id").isNull().alias("none"), "rep_id", "rep_th", "d1", "d2")
    first = named.groupBy("root").agg(F.min(order).alias("least")).select("root", F.col("least.rep_id").alias("class_id"), F.struct("least.d1", "least.d2").alias("first"))
    known = named.join(first, "root").select("d1", "d2", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "rep_id", "rep_th", (F.struct("d1", "d2") == F.col("first")).alias("first"))
    known = cut(known, "known")
    members = signed.where("n > 0").select("doc_id", "th", "d1", "d2").join(known, ["d1", "d2"])
    members = members.select("doc_id", "th", "class_id", "n_links", "rep_id", (F.col("first") & F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("th") == F.col("rep_th"))).alias("first"))
    alone = signed.where("n = 0").select("doc_id", "th", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("rep_id"), F.lit(True).alias("first"))
    return members.union(alone)


def one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """The documents that stand for their classes, with all their columns; of repeated rows one stays."""
    stay = classes(docs, **parameters).where("first").select(F.col("doc_id").alias("own_id"), F.col("th").alias("own_th")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    kept = keyed.join(stay.hint("shuffle_hash"), keyed.key.eqNullSafe(stay.own_id) & (keyed.th == stay.own_th), "left_semi")
    return kept.dropDuplicates(["key", "th"]).select("row.*")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "rep_id")
