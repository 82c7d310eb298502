"""Token-id files with a shared compression dictionary (operator 10).

Documents are range-partitioned by doc_id and each partition becomes one file: little-endian ids of
every document, compressed on its own with a zstandard dictionary that all files share, then an index
of fixed-width entries and a footer. Any document is reached by one read of its index entry and one of
its bytes. A file names the dictionary by its SHA-256, so that a wrong one is refused.

    file   = b"TIDS0001" | frames | index | footer
    index  = for each document: doc_id i64, has_id u8, place u64, bytes u32, tokens u64
    footer = documents u64, index place u64, width u8 (bytes of an id, 2 or 4), dictionary SHA-256, b"TIDSEND1"

Files are written under a name of their own for each task attempt and count only if the task's result
does, so attempts that fail or run twice leave nothing that is read. The dictionary is trained on
``sample`` documents at most, picked by a hash of doc_id; it changes sizes only, never what is read.
Null texts are empty texts and give the end id alone; null doc_ids sort first; documents that share a
doc_id each have their row, in any order among themselves; an empty table gives no rows; other columns
are ignored. A text of any length is one document and is compressed whole: a task needs about thirty
times the bytes of its longest one. Ids are kept in two bytes where the tokenizer has no more, else in four.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, partitions, shared_folder, table, texts, tokenizer_path
from .tokenizing import slices, tokenizer

END_ID = 2
HEAD, TAIL = b"TIDS0001", b"TIDSEND1"
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("place", "<u8"), ("bytes", "<u4"), ("tokens", "<u8")])
FOOTER = "<QQB32s8s"
DICTIONARY_BYTES = 64 << 10
SAMPLE, SAMPLE_BYTES = 1000, 8 << 10


def id_width(path: str, end_id: int = END_ID) -> int:
    """Bytes that an id of this tokenizer needs: 2 or 4."""
    return 2 if max(tokenizer(path).library.get_vocab(True).values(), default=0) < 1 << 16 and end_id < 1 << 16 else 4


def _ids(part, tok, end_id, width):
    ids, offsets = tok.ids(part["text"])
    ids = ids.astype(f"<u{width}")
    end = np.array([end_id], f"<u{width}").tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield ids[a:b].tobytes() + end, b - a + 1


def train(docs: DataFrame, path: str, end_id: int = END_ID, sample: int = SAMPLE, width: int | None = None) -> bytes:
    """A dictionary from about ``sample`` documents, at most twice as many; b"" if they are too few."""
    import zstandard

    width, every = width or id_width(path, end_id), max(1, docs.count() // sample)

    def run(batches):
        tok = tokenizer(path)
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array([x[:SAMPLE_BYTES] for x, _ in _ids(part, tok, end_id, width)], pa.binary())], names=["ids"])

    some = texts(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).limit(2 * sample)
    rows = sorted(bytes(r.ids) for r in some.mapInArrow(run, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, rows).as_bytes() if len(rows) >= 16 else b""
    except zstandard.ZstdError:
        return b""


class Reader:
    """Documents of one file, by position or doc_id."""

    def __init__(self, url: str, dictionary: bytes):
        import zstandard

        system, path = file_system(url)
        self.file = system.open_input_file(path)
        size = self.file.size()
        count, place, self.width, digest, tail = struct.unpack(FOOTER, self.file.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
        if tail != TAIL or self.file.read_at(len(HEAD), 0) != HEAD:
            raise ValueError(f"{url}: not a token-id file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{url}: made with another dictionary")
        self.index = np.frombuffer(self.file.read_at(count * INDEX.itemsize, place), INDEX)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.plain = zstandard.ZstdDecompressor(dict_data=shared)

    def __len__(self):
        return len(self.index)

    def ids(self, k: int) -> np.ndarray:
        e = self.index[k]
        raw = self.plain.decompress(self.file.read_at(int(e["bytes"]), int(e["place"])), max_output_size=int(e["tokens"]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}")

    def find(self, doc_id: int) -> np.ndarray | None:
        own = np.flatnonzero(self.index["has_id"])
        at = bisect_left(self.index["doc_id"][own], doc_id)
        return self.ids(int(own[at])) if at < len(own) and self.index["doc_id"][own[at]] == doc_id else None


def write(docs: DataFrame, path: str, folder: str, dictionary: bytes, end_id: int = END_ID, width: int | None = None) -> list[dict]:
    """Writes the files; their url, documents and tokens, in ascending order of doc_id.

    One row for each file reaches the driver, as for any sink that commits its files."""
    digest, width = hashlib.sha256(dictionary).digest(), width or id_width(path, end_id)

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        tok, name = tokenizer(path), f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tids"
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=True)
        system, local = file_system(name)
        out, entries, place, total = None, [], len(HEAD), 0
        for batch in batches:
            for part in slices(batch, "text"):
                if out is None:
                    out = system.open_output_stream(local)
                    out.write(HEAD)
                frames = []
                for doc, (raw, n) in zip(part["doc_id"].to_pylist(), _ids(part, tok, end_id, width)):
                    frame = pack.compress(raw)
                    entries.append((doc or 0, doc is not None, place, len(frame), n))
                    frames.append(frame)
                    place, total = place + len(frame), total + n
                out.write(b"".join(frames))
        if out is not None:
            out.write(np.array(entries, INDEX).tobytes())
            out.write(struct.pack(FOOTER, len(entries), place, width, digest, TAIL))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, TaskContext.get().partitionId(), len(entries), total)], names=["url", "nth", "documents", "tokens"])

    system, local = file_system(folder)
    system.create_dir(local, recursive=True)
    dealt = texts(docs).repartitionByRange(partitions(docs), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    rows = dealt.mapInArrow(run, "url string, nth long, documents long, tokens long").collect()
    return [r.asDict() for r in sorted(rows, key=lambda r: r.nth)]


def read(spark: SparkSession, files: list[dict], dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, file: a row for each document, from the files."""
    start, rows = 0, []
    for f in files:
        rows.append((f["url"], start))
        start += f["tokens"]

    def run(batches):
        for batch in batches:
            for url, base in zip(batch["url"].to_pylist(), batch["base"].to_pylist()):
                file = Reader(url, dictionary)
                n = file.index["tokens"].astype(np.int64)
                crc = [zlib.crc32(file.ids(k).astype("<u4").tobytes()) for k in range(len(file))]
                yield pa.RecordBatch.from_arrays([pa.array(file.index["doc_id"], pa.int64(), mask=file.index["has_id"] == 0), pa.array(base + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64()), pa.array([url.rsplit("/", 1)[-1]] * len(n), pa.string())], names=["doc_id", "start", "n_tokens", "ids_crc32", "file"])

    listed = spark.createDataFrame(rows, "url string, base long").repartition(max(1, len(rows)))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def op10_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")
    folder = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    dictionary = train(docs, path)
    return read(spark, write(docs, path, folder, dictionary), dictionary)
