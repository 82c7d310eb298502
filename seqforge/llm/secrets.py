"""Secret scan with corpus-wide ownership of candidates (operator 7).

Each text is scanned once for assignments, access keys and hexadecimal runs. The hash of every candidate
value is then counted over the distinct repositories and owners that hold it anywhere in the corpus: a
value of more than ``max_owners`` owners, or of more than ``max_repositories`` repositories of whichever
owners, is a copied example; one that is of fewer, and that looks like a credential, is marked again as a
span of kind ``live``. Counts are of distinct (value, owner, repository), formed before each shuffle, so a
value that a third of all documents hold costs its reducers one row for each repository and task; its
occurrences meet the count in a join whose large partitions are split.

Spans are code points, end exclusive. Null texts are empty and give no span; a null owner or repository
is the owner or repository "". Rows that repeat have a row each, null doc_ids included. Empty tables give
empty results; other columns are ignored. Any length of text is scanned whole, in time that follows it; a
task needs about ten times the bytes of its longest one.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .textbuf import arrow_text, byte_table, spans
from .tokenizing import slices

KINDS = ("assign", "access", "hex", "live")
ASSIGN = rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = rb"AKIA[A-Z0-9]+"
#: What an assignment must hold, in lower case; texts without any are not searched for one.
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
#: Values with one of these parts stand for a credential and are none.
PLACEHOLDERS = (b"example", b"changeme", b"placeholder", b"your", b"dummy", b"sample", b"xxxx", b"0000000000", b"1234567890")
LEAST_BITS = 2.5  # of entropy a character
MAX_OWNERS, MAX_REPOSITORIES = 2, 4


def live_looking(value: bytes) -> bool:
    """Whether the characters could be a credential's: varied, with a digit, no placeholder."""
    low, n = value.lower(), len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return bits >= LEAST_BITS and any(48 <= c <= 57 for c in value) and not any(p in low for p in PLACEHOLDERS)


def candidates(text: bytes, hexes: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) in bytes, by start, then kind."""
    found = [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in re.finditer(ASSIGN, text, re.IGNORECASE) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end(), m.start(), m.end()) for m in re.finditer(ACCESS, text) if m.end() - m.start() >= LEAST_ACCESS]
    return sorted(found + [(a, 2, b, a, b) for a, b in hexes])


def _documents_with(data: bytes, parts, offsets: np.ndarray) -> set[int]:
    at = []
    for part in parts:
        i = data.find(part)
        while i >= 0:
            at.append(i)
            i = data.find(part, i + 1)
    return set((np.searchsorted(offsets, at, "right") - 1).tolist())


SCANNED = "uid long, doc_id long, th long, owner string, repo string, kind array<int>, start array<int>, end array<int>, from array<int>, to array<int>, key array<string>, live array<boolean>"


def scan(docs: DataFrame, owner: Column, repo: Column) -> DataFrame:
    """A row for each document with its candidates in order, as arrays."""

    def run(batches):
        from pyspark import TaskContext

        hexadecimal, uid = byte_table(b"0123456789abcdef"), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = arrow_text(part["text"])
                raw = data.tobytes()
                s, e, first = spans(data, offsets, hexadecimal)
                long = np.flatnonzero(e - s >= LEAST_HEX)
                of = np.searchsorted(first, long, "right") - 1
                hexes = np.searchsorted(of, np.arange(part.num_rows + 1))
                chosen = _documents_with(raw.lower(), NAMES, offsets) | _documents_with(raw, (b"AKIA",), offsets) | set(of.tolist())
                columns = [[] for _ in range(7)]
                for i in range(part.num_rows):
                    if i not in chosen:
                        for c in columns:
                            c.append([])
                        continue
                    a = int(offsets[i])
                    text = raw[a : int(offsets[i + 1])]
                    found = candidates(text, [(int(s[j]) - a, int(e[j]) - a) for j in long[hexes[i] : hexes[i + 1]]])
                    before = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
                    chars = lambda k, before=before: int(before[k])
                    values = [text[v:w] for *_, v, w in found]
                    for c, x in zip(columns, ([f[1] for f in found], *([chars(f[k]) for f in found] for k in (0, 2, 3, 4)), [hashlib.sha256(v).hexdigest()[:32] for v in values], [live_looking(v) for v in values])):
                        c.append(x)
                ints = pa.list_(pa.int32())
                kinds = [ints] * 5 + [pa.list_(pa.string()), pa.list_(pa.bool_())]
                ids = pa.array(np.arange(uid, uid + part.num_rows))
                uid += part.num_rows
                yield pa.RecordBatch.from_arrays([ids, part["doc_id"], part["th"], part["owner"], part["repo"], *map(pa.array, columns, kinds)], names=[x.split()[0] for x in SCANNED.split(", ")])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce(owner, F.lit("")).alias("owner"), F.coalesce(repo, F.lit("")).alias("repo"))
    return base.mapInArrow(run, SCANNED)


def ownership(scanned: DataFrame) -> DataFrame:
    """key, owners, repos: how many distinct owners and repositories hold a candidate value."""
    each = scanned.where(F.size("key") > 0).select(F.explode(F.array_distinct("key")).alias("key"), "owner", "repo").distinct()
    return each.groupBy("key", "owner").agg(F.count("*").alias("repos")).groupBy("key").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def secrets(docs: DataFrame, owner: Column | None = None, repo: Column | None = None, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """uid, doc_id, th (a hash of the text), base and spans: arrays of (start, kind, end) in order; n_copied and n_live candidates."""
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", "source", "lang") if repo is None else repo
    held = cut(scan(docs, owner, repo), "secrets")
    one = held.where(F.size("key") > 0).select("uid", F.explode(F.arrays_zip("key", "live", "from", "to")).alias("c")).select("uid", F.col("c.key").alias("key"), F.col("c.live").alias("live"), F.col("c.from").alias("from"), F.col("c.to").alias("to"))
    known = one.join(cut(ownership(held), "owners"), "key")
    copied = (F.col("owners") > max_owners) | (F.col("repos") > max_repositories)
    specific = F.col("live") & ~copied
    added = known.groupBy("uid").agg(
        F.collect_set(F.when(specific, F.struct(F.col("from").alias("start"), F.lit(3).alias("kind"), F.col("to").alias("end")))).alias("added"),
        F.count_if(copied).alias("n_copied"),
    )
    base = F.expr("transform(arrays_zip(start, kind, end), x -> struct(x.start AS start, x.kind AS kind, x.end AS end))")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return held.select("uid", "doc_id", "th", base.alias("base")).join(added, "uid", "left").select("uid", "doc_id", "th", "base", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans"), F.coalesce("n_copied", F.lit(0).cast("long")).alias("n_copied"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_live"))


MARK = "[REDACTED]"


def _without(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    """Each text with ``MARK`` for its spans, which come in order; those that touch or overlap are one. Code points
    are sliced once, whatever the number of spans; a null text stays null."""
    out = []
    for t, froms, tos in zip(text, start, end):
        if t is None:
            out.append(None)
            continue
        pieces, at, last = [], 0, -1
        for a, b in zip(froms, tos):
            if a > last:
                pieces += (t[at:a], MARK)
            at = last = max(last, b)
        out.append("".join((*pieces, t[at:])))
    return pd.Series(out, dtype=object)


def redacted(docs: DataFrame, **parameters) -> DataFrame:
    """The documents with ``MARK`` in place of every live credential; n_chars, if there, follows.

    Only texts that are hit go to Python. Time follows the length of a text and the number of its spans."""
    found = secrets(docs, **parameters).where("n_live > 0")
    live = found.withColumn("hits", F.expr("array_sort(filter(spans, x -> x.kind = 3))"))
    found = live.select(F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th"), F.col("hits.start").alias("froms"), F.col("hits.end").alias("tos")).dropDuplicates(["hit_id", "hit_th"])
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own_th"))
    joined = keyed.join(found, keyed.key.eqNullSafe(found.hit_id) & (keyed.own_th == found.hit_th), "left")
    text, hit = F.col("row")["text"], F.col("froms").isNotNull()
    joined = joined.withColumn("changed", F.pandas_udf(_without, "string")(F.when(hit, text), F.col("froms"), F.col("tos")))
    put = {"text": F.when(hit, F.col("changed")).otherwise(text)}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(hit, F.length("changed")).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return joined.select([put.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def _shown(column: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({column}, x -> concat_ws(':', array({names})[x.kind], x.start, x.end)), ',')")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.expr(f"CAST(size(filter(base, x -> x.kind = {k})) AS bigint)")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_shown("base"), 256).alias("base_sha256"), _shown("spans").alias("spans"), "n_copied", "n_live")
