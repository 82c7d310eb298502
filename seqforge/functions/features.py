"""Features of sequences: k-mer frequencies, the echo pseudo-model, hashes of corpora."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CODES = np.full(256, -1, np.int64)
_CODES[[ord(c) for c in "ACGT"]] = range(4)
#: Multiplier, mask and scale of the echo score of a byte.
ECHO = (2654435761, 0xFFFF, 65535.0)


def kmer_index(seq: bytes, k: int) -> np.ndarray:
    """Base-4 numbers of the k-mers of A, C, G and T; a window with another letter has none."""
    codes = _CODES[np.frombuffer(seq, np.uint8)]
    if len(codes) < k:
        return np.zeros(0, np.int64)
    w = np.lib.stride_tricks.sliding_window_view(codes, k)
    return (w @ (4 ** np.arange(k - 1, -1, -1)))[(w >= 0).all(1)]


def kmer_counts(df: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """key, kmer (its number), n: sparse counts, made batch by batch without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, kmers, counts = [], [], []
            for i, s in enumerate(batch[1].to_pylist()):
                found, n = np.unique(kmer_index((s or "").encode(), k), return_counts=True)
                keys.append(np.full(len(found), i))
                kmers.append(found)
                counts.append(n)
            if keys:
                yield pa.RecordBatch.from_arrays([batch[0].take(pa.array(np.concatenate(keys).astype(np.int64))), pa.array(np.concatenate(kmers).astype(np.int32)), pa.array(np.concatenate(counts).astype(np.int64))], names=["key", "kmer", "n"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, seq).mapInArrow(run, f"key {kind}, kmer int, n bigint").withColumnRenamed("key", key)


def kmer_name(kmer: Column, k: int) -> Column:
    digit = lambda i: F.substring(F.lit("ACGT"), (F.shiftright(kmer, 2 * (k - 1 - i)).bitwiseAND(3) + 1).cast("int"), F.lit(1))
    return F.concat(*[digit(i) for i in range(k)])


def kmer_vectors(df: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """key and the dense frequency vector of 4**k numbers; zeros if nothing can be counted."""

    def run(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, 4**k))
            for i, s in enumerate(batch[1].to_pylist()):
                counts = np.bincount(kmer_index((s or "").encode(), k), minlength=4**k)
                out[i] = counts / max(1, counts.sum())
            at = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * 4**k)
            yield pa.RecordBatch.from_arrays([batch[0], pa.ListArray.from_arrays(at, pa.array(out.ravel()))], names=["key", "vec"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, seq).mapInArrow(run, f"key {kind}, vec array<double>").withColumnRenamed("key", key)


def echo_value(code: int) -> float:
    return -((code * ECHO[0]) & ECHO[1]) / ECHO[2]


def echo_sum(seq: Column, alphabet: str = "ACGTN") -> Column:
    """The echo score of sequences over a known alphabet: letters counted, each with its value, so that
    it stays in generated code; to 12 places, so that equal compositions give equal scores."""
    count = lambda c: F.length(seq) - F.length(F.replace(seq, F.lit(c), F.lit("")))
    total = sum((count(c).cast("double") * F.lit(echo_value(ord(c))) for c in alphabet), F.lit(0.0))
    return F.round(total, 12)


def echo_mean(seq: Column, alphabet: str = "ACGTN") -> Column:
    return F.round(F.coalesce(F.try_divide(echo_sum(seq, alphabet), F.length(seq)), F.lit(0.0)), 12)


def fnv1a(data: bytes) -> int:
    value = 0xCBF29CE484222325
    for b in data:
        value = (value ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return value


def echo_logit(reference: str, pos0: int, base: str) -> float:
    """The echo logit of a base at a masked place."""
    return (fnv1a(f"{reference}|{pos0}|{base.lower()}".encode()) & 0xFFFF) / 0xFFFF


def echo_embedding(seq: str, layers: int, width: int = 8) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(fnv1a(seq.encode()))).standard_normal((layers, width))


def corpus_key(sequences: list[str]) -> str:
    """24 hexadecimal digits of the number of sequences and the sequences, in order."""
    import hashlib

    return hashlib.sha256("\0".join([str(len(sequences)), *sequences]).encode()).hexdigest()[:24]


def corpus_keys(df: DataFrame, group: str, order: str, seq: str) -> DataFrame:
    """group, corpus_key: the key of each group's sequences in order, hashed as the sorted rows stream by.

    A group's number comes as a row before its sequences. Rows are dealt by a hash of the group: a partitioning by the
    group itself may be taken over from below, and adaptive execution can give that one up."""
    counted = df.select(F.col(group).alias("g"), F.lit(None).cast("long").alias("n"), F.col(order).alias("o"), F.col(seq).alias("s")).where(F.col("s").isNotNull())
    sizes = counted.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    both = counted.unionByName(sizes, allowMissingColumns=True)
    rows = both.repartition(F.xxhash64("g")).sortWithinPartitions("g", F.col("n").isNull(), "o", "s").select("g", "n", "s")

    def run(batches):
        import hashlib

        now, digest, done = None, None, []
        for b in batches:
            for g, n, s in zip(*(c.to_pylist() for c in b.columns)):
                if n is not None:
                    if digest is not None:
                        done.append((now, digest.hexdigest()[:24]))
                    now, digest = g, hashlib.sha256(str(n).encode())
                else:
                    digest.update(b"\0" + s.encode())
            yield _keyed(done)
            done = []
        if digest is not None:
            yield _keyed([(now, digest.hexdigest()[:24])])

    def _keyed(done):
        return pa.RecordBatch.from_arrays([pa.array([g for g, _ in done], pa.string()), pa.array([k for _, k in done], pa.string())], names=["g", "corpus_key"])

    return rows.mapInArrow(run, "g string, corpus_key string").withColumnRenamed("g", group)


def corpus_key_column(sequences: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", F.size(sequences).cast("string"), sequences), 256), 1, 24)
