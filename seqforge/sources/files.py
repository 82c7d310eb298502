"""Files that tasks read and write themselves: streamed digests, members of archives, arrays in .npz files.

Paths are of the file system that driver and executors share. The driver lists names and reads headers;
contents are read by tasks, a piece at a time.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import posixpath
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

CHUNK = 1 << 20
ROWS = 8192  # rows of a batch at most
BATCH_BYTES = 4 << 20
PARTITION_BYTES = 32 << 20
#: Names that the arrays of a dense file go by.
DENSE, LAYERS = ("arrays", "vectors"), ("layer_ids", "layers")


class ContractError(ValueError):
    """A file or table is missing, broken or not as its contract says."""


def file_system(url: str):
    """(pyarrow file system, path) of an address."""
    from pyarrow import fs

    if url.startswith("file:"):
        url = "/" + url[5:].lstrip("/")
    return (fs.LocalFileSystem(), os.path.abspath(url)) if "://" not in url else fs.FileSystem.from_uri(url)


def listed(url: str) -> list[str]:
    """The files at an address: itself, or those of a folder and below, by name."""
    from pyarrow import fs

    files, path = file_system(url)
    found = files.get_file_info(path)
    if found.type == fs.FileType.File:
        return [url]
    if found.type == fs.FileType.NotFound:
        raise ContractError(f"{url} is missing")
    inner = [x.path for x in files.get_file_info(fs.FileSelector(path, recursive=True)) if x.type == fs.FileType.File]
    return sorted(posixpath.join(url, os.path.relpath(x, path)) for x in inner)


# -- digests -----------------------------------------------------------------------------------------
def _stamp(info) -> dict:
    return {"size": info.size, "mtime_ns": info.mtime_ns}


def _digest(url: str, sidecar: bool) -> tuple[str | None, int | None, bool]:
    """(SHA-256, bytes, whether it was in the sidecar) of a file read as a stream; nulls if it is missing."""
    files, path = file_system(url)
    info = files.get_file_info(path)
    if not info.is_file:
        return None, None, False
    kept = f"{path}.sha256"
    if sidecar and files.get_file_info(kept).is_file:
        try:
            held = json.loads(files.open_input_stream(kept).read())
            if {k: held[k] for k in ("size", "mtime_ns")} == _stamp(info):
                return held["sha256"], info.size, True
        except (ValueError, KeyError, TypeError):
            pass  # a broken sidecar is none
    digest = hashlib.sha256()
    with files.open_input_stream(path) as f:
        while part := f.read(CHUNK):
            digest.update(part)
    if _stamp(files.get_file_info(path)) != _stamp(info):
        raise ContractError(f"{url} changed while it was read")
    if sidecar:  # whole or not at all: attempts of a task write files of their own, and the last rename stands
        own = f"{kept}.{uuid.uuid4().hex}"
        with files.open_output_stream(own) as f:
            f.write(json.dumps(_stamp(info) | {"sha256": digest.hexdigest()}).encode())
        files.move(own, kept)
    return digest.hexdigest(), info.size, False


def digests(spark: SparkSession, urls: list[str], sidecar: bool = False) -> DataFrame:
    """path, sha256, length, cached: each file hashed as a stream by a task, whatever its size; nulls for a missing one.

    With ``sidecar`` the digest is kept beside the file and read again while its size and time stand."""

    def run(batches):
        for b in batches:
            for url in b["path"].to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((url, *_digest(url, sidecar)), (pa.string(), pa.string(), pa.int64(), pa.bool_()))], ["path", "sha256", "length", "cached"])

    schema = "path string, sha256 string, length long, cached boolean"
    if not urls:
        return spark.createDataFrame([], schema)
    each = spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "path string, i int").repartitionByRange(min(len(urls), 10_000), "i")
    return each.select("path").mapInArrow(run, schema)


def check_files(spark: SparkSession, entries: DataFrame, needed: bool = False) -> None:
    """Raises if a file of (path, wanted) is missing or is not what its digest says; a null digest is let
    pass unless it is ``needed``."""
    paths = [r.path for r in entries.select("path").collect()]  # a row a file
    found = digests(spark, paths)
    wrong = F.when(F.col("sha256").isNull(), F.lit("is missing")).when(F.col("wanted").isNull() & F.lit(needed), F.lit("has no sha256 in the manifest")).when(F.col("sha256") != F.col("wanted"), F.lit("has changed: its sha256 is not the manifest's"))
    bad = entries.join(found, "path", "left").select("path", wrong.alias("wrong")).where("wrong IS NOT NULL").orderBy("path").first()
    if bad is not None:
        raise ContractError(f"{bad.path} {bad.wrong}")


def tree_digest(spark: SparkSession, url: str, sidecar: bool = False) -> str:
    """Of a file its SHA-256; of a folder that of its files' sorted names and digests. Sidecars do not count."""
    names = listed(url)
    if names == [url]:
        return digests(spark, names, sidecar).first().sha256
    names = [n for n in names if not (n.endswith(".sha256") and n.removesuffix(".sha256") in names)]
    if not names:
        raise ContractError(f"{url}: no files")
    found = {r.path: r.sha256 for r in digests(spark, names, sidecar).collect()}  # a row a file
    lines = sorted((posixpath.relpath(n, url), found[n]) for n in names)
    return hashlib.sha256("".join(f"{n}:{d}\n" for n, d in lines).encode()).hexdigest()


# -- archives ----------------------------------------------------------------------------------------
def _opened(url: str):
    files, path = file_system(url)
    try:
        return zipfile.ZipFile(files.open_input_file(path))
    except FileNotFoundError as e:
        raise ContractError(f"{url} is missing") from e
    except zipfile.BadZipFile as e:
        raise ContractError(f"{url} is no archive: {e}") from e


def members(spark: SparkSession, urls: list[str], suffixes: tuple[str, ...] = (".csv", ".parquet")) -> DataFrame:
    """archive, member, size of the tables in zip archives, listed by tasks from the archives' directories."""

    def run(batches):
        for b in batches:
            for url in b["archive"].to_pylist():
                with _opened(url) as z:
                    held = sorted((i.filename, i.file_size) for i in z.infolist() if i.filename.endswith(suffixes) and not i.is_dir())
                yield pa.RecordBatch.from_arrays([pa.array([url] * len(held), pa.string()), pa.array([n for n, _ in held], pa.string()), pa.array([s for _, s in held], pa.int64())], ["archive", "member", "size"])

    each = spark.createDataFrame([(u,) for u in urls], "archive string").repartition(max(1, min(len(urls), 1000)))
    return each.mapInArrow(run, "archive string, member string, size long")


def _member_rows(url: str, member: str) -> Iterator[pa.RecordBatch]:
    """The rows of a member as strings, a batch at a time. CSV streams; a Parquet member is held whole, as its
    directory is at its end."""
    import pyarrow.csv as pc
    import pyarrow.parquet as pq

    with _opened(url) as z:
        try:
            with z.open(member) as f:
                if member.endswith(".parquet"):
                    for b in pq.ParquetFile(io.BytesIO(f.read())).iter_batches(ROWS):
                        yield pa.RecordBatch.from_arrays([c.cast(pa.string()) for c in b.columns], b.schema.names)
                    return
                with io.TextIOWrapper(f, "utf-8-sig", newline="") as text:
                    import csv

                    header = next(csv.reader(text), [])
                f = z.open(member)
                options = pc.ConvertOptions(column_types={c: pa.string() for c in header}, strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=False)
                yield from pc.open_csv(f, convert_options=options, read_options=pc.ReadOptions(block_size=BATCH_BYTES), parse_options=pc.ParseOptions(newlines_in_values=True))
        except (zipfile.BadZipFile, pa.ArrowInvalid, EOFError) as e:
            raise ContractError(f"{url}, {member}: {e}") from e


def archived(spark: SparkSession, urls: list[str], columns: list[str], suffixes: tuple[str, ...] = (".csv", ".parquet")) -> DataFrame:
    """archive, member, row, and the columns named (as strings, whatever the case of their names) of all tables in
    zip archives: a task a member. A broken archive or a lacking column raises."""

    def run(batches):
        for b in batches:
            for url, member in zip(b["archive"].to_pylist(), b["member"].to_pylist()):
                row = 0
                for part in _member_rows(url, member):
                    lower = {c.strip().lower(): c for c in part.schema.names}
                    if lacking := [c for c in columns if c.lower() not in lower]:
                        raise ContractError(f"{url}, {member}: no column {', '.join(lacking)}")
                    n = part.num_rows
                    own = [part[lower[c.lower()]] for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array([url] * n, pa.string()), pa.array([member] * n, pa.string()), pa.array(range(row, row + n), pa.int64()), *own], ["archive", "member", "row", *columns])
                    row += n

    held = members(spark, urls, suffixes)
    dealt = held.repartition(max(1, min(10_000, held.count())), "archive", "member").select("archive", "member")  # a row a member
    return dealt.mapInArrow(run, ", ".join(["archive string, member string, row long", *(f"`{c}` string" for c in columns)]))


def header(spark: SparkSession, url: str, member: str) -> list[str]:
    """The names of a member's columns, read by a task."""

    def run(batches):
        for _ in batches:
            names = next(iter(_member_rows(url, member)), pa.RecordBatch.from_arrays([], [])).schema.names
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    return [r.name for r in spark.range(1).coalesce(1).mapInArrow(run, "name string").collect()]


# -- arrays ------------------------------------------------------------------------------------------
class _Member:
    """An array in an .npz file: its shape, and its rows by seeking (stored) or by reading on (compressed)."""

    def __init__(self, url: str, *names: str):
        self.z = _opened(url)
        there = [n for n in names if f"{n}.npy" in self.z.namelist()]
        if not there:
            raise ContractError(f"{url}: no array {' or '.join(names)}")
        self.name = there[0]
        self.f = self.z.open(f"{self.name}.npy")
        version = np.lib.format.read_magic(self.f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        self.shape, fortran, self.dtype = read(self.f)
        if fortran and len(self.shape) > 1:
            raise ContractError(f"{url}: {name} is stored by columns")
        self.start = self.f.tell()
        self.width = self.dtype.itemsize * int(np.prod(self.shape[1:], dtype=np.int64))

    def rows(self, a: int, b: int, each: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, rows) from a to b, ``each`` at a time."""
        self.f.seek(self.start + a * self.width)
        while a < b:
            n = min(each, b - a)
            raw = self.f.read(n * self.width)
            if len(raw) < n * self.width:
                raise ContractError(f"{self.f.name} ends early")
            yield a, np.frombuffer(raw, self.dtype).reshape(n, *self.shape[1:])
            a += n

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.f.close()
        self.z.close()


def _names(url: str) -> list[str]:
    with _opened(url) as z:
        return [n.removesuffix(".npy") for n in z.namelist()]


class Rows(InputPartition):
    def __init__(self, url: str, a: int, b: int):
        self.url, self.a, self.b = url, a, b


class _ArrayReader(DataSourceReader):
    """Files of one kind, each by ranges of rows of about PARTITION_BYTES."""

    def __init__(self, options):
        self.kind, self.url = options.get("kind", "dense"), options["path"]
        self.array = options.get("array") or {"ragged": "values", "listed": "arr_"}.get(self.kind)
        self.rows = int(options.get("rows", 0))
        if self.kind not in ("dense", "ragged", "listed"):
            raise ContractError(f"unknown kind {self.kind!r}: it is dense, ragged or listed")

    def partitions(self):
        out = []
        for url in [u for u in listed(self.url) if u.endswith(".npz")]:
            n, width = self._size(url)
            each = self.rows or max(1, PARTITION_BYTES // max(1, width))
            out += [Rows(url, a, min(n, a + each)) for a in range(0, n, each)]
        return out or [Rows("", 0, 0)]

    def _size(self, url: str) -> tuple[int, int]:
        """(items, bytes of one, about): from headers only."""
        if self.kind == "dense":
            with _Member(url, *([self.array] if self.array else DENSE)) as m:
                if len(m.shape) != 3:
                    raise ContractError(f"{url}: {m.name} must be items x layers x width")
                return m.shape[0], m.width
        if self.kind == "ragged":
            with _Member(url, "offsets") as m, _Member(url, self.array) as v:
                if not m.shape[0]:
                    raise ContractError(f"{url}: offsets do not fit the values")
                return m.shape[0] - 1, 8 * v.shape[0] // max(1, m.shape[0] - 1)
        with _Member(url, "n") as m:
            n = int(np.frombuffer(m.f.read(m.dtype.itemsize), m.dtype)[0])
        there = set(_names(url))
        if (lacking := next((i for i in range(n) if f"{self.array}{i}" not in there), None)) is not None:
            raise ContractError(f"{url}: no array {self.array}{lacking}, of {n}")
        return n, PARTITION_BYTES // 1000

    def read(self, partition: Rows):
        if partition.b > partition.a:
            yield from {"dense": self._dense, "ragged": self._ragged, "listed": self._listed}[self.kind](partition)

    def _dense(self, p: Rows):
        with _Member(p.url, *([self.array] if self.array else DENSE)) as m:
            _, layers, width = m.shape
            ids = np.arange(layers)
            if set(LAYERS) & set(_names(p.url)):
                with _Member(p.url, *LAYERS) as own:
                    ids = np.frombuffer(own.f.read(), own.dtype)
            if len(ids) != layers:
                raise ContractError(f"{p.url}: {len(ids)} layers are named, there are {layers}")
            for a, x in m.rows(p.a, p.b, max(1, BATCH_BYTES // max(1, m.width))):
                n = len(x)
                at = pa.array(np.arange(n * layers + 1, dtype=np.int32) * width)
                yield pa.RecordBatch.from_arrays([pa.array([p.url] * (n * layers)), pa.array(np.repeat(np.arange(a, a + n), layers)), pa.array(np.tile(ids, n).astype(np.int32)), pa.ListArray.from_arrays(at, pa.array(x.astype(np.float64).ravel()))], ["file", "item", "layer_id", "vec"])

    def _ragged(self, p: Rows):
        with _Member(p.url, "offsets") as m, _Member(p.url, self.array) as v:
            at = np.concatenate([x for _, x in m.rows(p.a, p.b + 1, CHUNK)]).astype(np.int64)
            first, last = m.shape[0] - 1 == p.b, p.a == 0
            if (np.diff(at) < 0).any() or at[0] < 0 or at[-1] > v.shape[0] or (last and at[0] != 0) or (first and at[-1] != v.shape[0]):
                raise ContractError(f"{p.url}: offsets do not fit the values")
            k = 0
            while k < len(at) - 1:
                stop = max(k + 1, int(np.searchsorted(at, at[k] + BATCH_BYTES // 8, "right")) - 1)
                values = [x for _, x in v.rows(int(at[k]), int(at[stop]), CHUNK)]
                flat = np.concatenate(values).astype(np.float64) if values else np.zeros(0)
                yield _listed_rows(p.url, p.a + k, np.diff(at[k : stop + 1]), flat)
                k = stop

    def _listed(self, p: Rows):
        for i in range(p.a, p.b):
            with _Member(p.url, f"{self.array}{i}") as m:
                flat = np.concatenate([x for _, x in m.rows(0, m.shape[0], CHUNK)] or [np.zeros(0)]).astype(np.float64).ravel()
            yield _listed_rows(p.url, i, np.array([len(flat)]), flat)


def _listed_rows(url: str, first: int, sizes: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
    at = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array([url] * len(sizes)), pa.array(np.arange(first, first + len(sizes))), pa.ListArray.from_arrays(at, pa.array(flat))], ["file", "item", "values"])


class _Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class _ArrayWriter(DataSourceArrowWriter):
    """Files of up to PARTITION_BYTES by each task; those of attempts that do not count are removed."""

    def __init__(self, options, schema, overwrite):
        self.kind, self.url = options.get("kind", "dense"), options["path"]
        self.limit = int(options.get("file_bytes", PARTITION_BYTES))
        wanted = {"dense": {"item", "layer_id", "vec"}, "ragged": {"item", "values"}}.get(self.kind)
        if wanted is None or not wanted <= set(schema.names):
            raise ContractError(f"a {self.kind} sink takes {', '.join(sorted(wanted or ()))}")
        files, path = file_system(self.url)
        if overwrite and files.get_file_info(path).type.name != "NotFound":
            files.delete_dir_contents(path)
        files.create_dir(path, recursive=True)

    def write(self, iterator):
        from pyspark import TaskContext

        names: list[str] = []
        context = TaskContext.get()
        task = f"{context.partitionId():05d}-{uuid.uuid4().hex}" if context else uuid.uuid4().hex

        def put(t: pa.Table):
            names.append(f"part-{task}-{len(names):05d}.npz")
            self._put(names[-1], t)

        left = None
        for batch in iterator:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch])
            left = own if left is None else pa.concat_tables([left, own])
            while left.nbytes >= self.limit:
                item = left["item"].to_numpy()
                ends = np.flatnonzero(item[1:] != item[:-1]) + 1  # an item's rows stay together
                each = max(1, left.nbytes // left.num_rows)
                fit = np.searchsorted(ends, self.limit // each, "right")
                if not len(ends):
                    break
                cut = int(ends[max(0, fit - 1)])
                put(left.slice(0, cut))
                left = left.slice(cut)
        if left is not None and left.num_rows:
            put(left)
        return _Written(names)

    def _put(self, name: str, t: pa.Table) -> None:
        item = t["item"].to_numpy()
        if self.kind == "ragged":
            lists = t["values"].combine_chunks()
            arrays = {"items": item, "values": lists.flatten().to_numpy(zero_copy_only=False), "offsets": np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))}
        else:
            layer = t["layer_id"].to_numpy()
            order = np.lexsort((layer, item))
            layers, items = np.unique(layer), np.unique(item)
            if len(order) != len(layers) * len(items) or (np.tile(layers, len(items)) != layer[order]).any():
                raise ContractError("a dense file needs each item's layers together, all of them, in one task")
            x = t["vec"].combine_chunks().take(pa.array(order))
            flat = x.flatten().to_numpy(zero_copy_only=False)
            if len(flat) % max(1, len(order)):
                raise ContractError("vectors are not all of one width")
            arrays = {"items": items, "layer_ids": layers, "arrays": flat.reshape(len(items), len(layers), -1)}
        files, path = file_system(f"{self.url}/{name}")
        with files.open_output_stream(path) as f:
            buffer = io.BytesIO()
            np.savez(buffer, **arrays)
            f.write(buffer.getvalue())

    def commit(self, messages):
        files, path = file_system(self.url)
        kept = {n for m in messages if m for n in m.files}
        for x in listed(self.url):
            if x.rsplit("/", 1)[-1].startswith("part-") and x.rsplit("/", 1)[-1] not in kept and x.endswith(".npz") and not self._older(x):
                files.delete_file(file_system(x)[1])
        with files.open_output_stream(f"{path}/_SUCCESS") as f:
            f.write(b"")

    def _older(self, url: str) -> bool:
        """Whether a file was there before: an append leaves it."""
        return url in self.before

    def abort(self, messages):
        for n in (n for m in messages if m for n in m.files):
            files, path = file_system(f"{self.url}/{n}")
            if files.get_file_info(path).is_file:
                files.delete_file(path)


class NpzSource(DataSource):
    """format("npz"): options path, kind and rows (of a partition). Reading gives file, item and, by kind,

    dense    layer_id, vec     of ``arrays`` (items x layers x width) and, maybe, ``layer_ids``
    ragged   values            of ``values``, all items' numbers in a row, and ``offsets``
    listed   values            of ``n`` and arr_0, arr_1, ...

    ``array`` names another array (dense ones may be ``vectors`` too, with ``layers``). Only the rows of a partition are read. Writing takes item, layer_id and vec, or
    item and values, and makes files of the first two kinds, with ``items``; a task's files are its own."""

    @classmethod
    def name(cls):
        return "npz"

    def schema(self):
        return "file string, item long, " + ("layer_id int, vec array<double>" if self.options.get("kind", "dense") == "dense" else "values array<double>")

    def reader(self, schema):
        return _ArrayReader(self.options)

    def writer(self, schema, overwrite):
        made = _ArrayWriter(self.options, schema, overwrite)
        made.before = set() if overwrite else set(listed(self.options["path"]))
        return made


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpzSource)


def read_dense(spark: SparkSession, path: str, rows: int = 0, array: str = "") -> DataFrame:
    """file, item, layer_id, vec of .npz files (a file or a folder)."""
    register(spark)
    return spark.read.format("npz").options(kind="dense", array=array, rows=str(rows)).load(path)


def read_ragged(spark: SparkSession, path: str, kind: str = "ragged", rows: int = 0) -> DataFrame:
    """file, item, values of .npz files; ``listed`` for arr_0, arr_1, ..."""
    register(spark)
    return spark.read.format("npz").options(kind=kind, rows=str(rows)).load(path)


def write_dense(df: DataFrame, path: str, file_bytes: int = PARTITION_BYTES) -> None:
    """Files of item, layer_id and vec, an item's layers together."""
    register(df.sparkSession)
    dealt = df.select("item", "layer_id", "vec").repartition("item").sortWithinPartitions("item", "layer_id")
    dealt.write.format("npz").options(kind="dense", file_bytes=str(file_bytes)).mode("overwrite").save(path)


def write_ragged(df: DataFrame, path: str, file_bytes: int = PARTITION_BYTES) -> None:
    register(df.sparkSession)
    df.select("item", "values").write.format("npz").options(kind="ragged", file_bytes=str(file_bytes)).mode("overwrite").save(path)
