"""Benchmark decontamination with a hash set of test n-grams (operator 6), DataFrame functions only.

A window is ``n`` consecutive words of a benchmark item; an item of fewer words is one window. Of any
``m`` consecutive words, one run of g = ceil(m/2) words begins at a multiple of m - g + 1 in the
document, so a document is scanned at every sixth word only: the hashes of its aligned runs are looked
up in the set of all such runs of the items. Round each hit the windows that hold it are verified on the
words themselves; documents carry the items and the words that they cover.

The set travels with the plan as an IN-set while it has ``set_limit`` hashes at most (checked); a larger
benchmark is joined on the hashes instead, by shuffle, with the same result.

A text of any length is scanned whole, in one task; its hits are verified as rows of some fifteen words,
so that a task needs about twenty times the bytes of its longest text, however much of it is hit.

Null texts and texts without words have no words, no hits and are not contaminated. Items without words
have no window; a null item_id counts as the id "". Repeated rows each have their row, null doc_ids too;
items that repeat count once for each item_id. Empty tables give empty results (documents) or no hits
(benchmark). Other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

WINDOW = 10
SET_LIMIT = 50_000
#: Benchmark windows, as text, that are broadcast for verification at most; beyond it the join shuffles.
BROADCAST_WINDOWS = 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _runs(size: Column, length: int, step: int, make) -> Column:
    """make(i) at i = 1, 1 + step, ... while ``length`` words remain."""
    last = size - F.lit(length - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last, F.lit(step)), make)).otherwise(F.array().cast("array<bigint>"))


def _aligned(m: int) -> tuple[int, int]:
    g = (m + 1) // 2
    return g, m - g + 1


def _hash(g: int):
    return lambda i: F.xxhash64(F.lit(g), *[F.element_at("words", i + F.lit(k)) for k in range(g)])


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """item, m, window (words joined by a space): the distinct windows of each item."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("m", F.least(F.size("words"), F.lit(n)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("m") + 1)
    each = F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.col("m")), " "))
    return items.select("item", "m", F.explode(each).alias("window")).distinct()


def _grams(windows: DataFrame, sizes: list[int]) -> DataFrame:
    """The hashes of all runs that a document's aligned runs are compared with."""
    split = windows.select("m", F.split("window", " ").alias("words")).distinct()
    parts = []
    for m in sizes:
        g, _ = _aligned(m)
        parts.append(split.where(F.col("m") == m).select(F.explode(_runs(F.size("words"), g, 1, _hash(g))).alias("gram")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def _key(doc_id: str = "doc_id") -> list[Column]:
    """What names a document's text in joins, besides its hash: the id, and whether there is none."""
    return [F.coalesce(doc_id, F.lit(0).cast("long")).alias("did"), F.col(doc_id).isNull().alias("none")]


def _found_by(known: str, m: int) -> Column:
    """The aligned runs of a document that are in the set: at, m."""
    g, s = _aligned(m)
    run = ", ".join(f"element_at(words, i + {k})" for k in range(g))
    return F.expr(f"CASE WHEN size(words) >= {g} THEN transform(filter(sequence(1, size(words) - {g - 1}, {s}), i -> xxhash64({g}, {run}) IN ({known})), i -> struct(i AS at, {m} AS m)) ELSE CAST(array() AS array<struct<at:int,m:int>>) END")


def _named_runs(m: int) -> Column:
    """All aligned runs of a document: at, m, gram."""
    g, s = _aligned(m)
    return F.transform(_runs(F.size("words"), g, s, lambda i: i.cast("long")), lambda i: F.struct(i.cast("int").alias("at"), F.lit(m).alias("m"), _hash(g)(i.cast("int")).alias("gram")))


def scan(docs: DataFrame, windows: DataFrame, set_limit: int = SET_LIMIT) -> DataFrame:
    """uid, doc_id, th (a hash of the text), n_words, and of those documents that may hold a window the words
    and ``runs``, the aligned runs (at, m) that are in the set."""
    sizes = sorted(r.m for r in windows.select("m").distinct().collect())
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), words(F.col("text")).alias("words"))
    uid, n_words = F.monotonically_increasing_id().alias("uid"), F.size("words").cast("long").alias("n_words")
    if not sizes:
        return base.select(uid, "doc_id", "th", n_words, F.lit(None).cast("array<string>").alias("words"), F.lit(None).cast("array<struct<at:int,m:int>>").alias("runs"))
    grams = _grams(windows, sizes)
    held = [r.gram for r in grams.limit(set_limit + 1).collect()]
    if len(held) <= set_limit:
        known = ",".join(f"{x}L" if x != -(1 << 63) else "(-9223372036854775807L - 1L)" for x in held)
        hashes = F.concat(*[_runs(F.size("words"), g, s, _hash(g)) for g, s in map(_aligned, sizes)])
        some = base.withColumn("hashes", hashes).select(uid, "doc_id", "th", n_words, F.when(F.expr(f"exists(hashes, x -> x IN ({known}))"), F.col("words")).alias("words"))
        some = cut(some, "marked")
        return some.withColumn("runs", F.when(F.col("words").isNotNull(), F.concat(*[_found_by(known, m) for m in sizes])))
    each = F.concat(*map(_named_runs, sizes))
    hits = base.select(*_key(), "th", F.explode(each).alias("r")).select("did", "none", "th", "r.*").join(grams, "gram", "left_semi")
    hits = hits.groupBy("did", "none", "th").agg(F.array_sort(F.collect_set(F.struct("at", "m"))).alias("runs"))
    joined = base.select("*", *_key()).join(hits, ["did", "none", "th"], "left")
    return joined.select(uid, "doc_id", "th", n_words, F.when(F.col("runs").isNotNull(), F.col("words")).alias("words"), "runs")


def _around(x: Column) -> Column:
    """A run's place in each window that may hold it: the first word's number and the words near it."""
    back = x["m"] - F.floor((x["m"] + 1) / 2).cast("int")
    first = F.greatest(F.lit(1), x["at"] - back)
    return F.struct(first.alias("first"), x["m"].alias("m"), F.slice("words", first, F.least(F.size("words"), x["at"] + x["m"] - 1) - first + 1).alias("near"))


def _windows() -> Column:
    """The windows of m words among those near a run: at, window."""
    room = F.size("near") - F.col("m")
    each = F.transform(F.sequence(F.lit(0), room), lambda k: F.struct((F.col("first") + k).alias("at"), F.array_join(F.slice("near", k + 1, F.col("m")), " ").alias("window")))
    return F.when(room >= 0, each).otherwise(F.array().cast("array<struct<at:int,window:string>>"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, set_limit: int = SET_LIMIT, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """uid, doc_id, th, n_words, n_hit, items, hits (first word and words of each window found), by row."""
    windows = cut(benchmark_windows(benchmark, n), "windows")
    sizes = sorted(r.m for r in windows.select("m").distinct().collect())
    held = cut(scan(docs, windows, set_limit), "scanned")
    if not sizes:
        return held.select("uid", "doc_id", "th", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<at:int,m:int>>").alias("hits"))
    near = held.where(F.col("words").isNotNull()).select("uid", F.explode(F.transform("runs", _around)).alias("r")).select("uid", "r.*")
    found = near.select("uid", "m", F.explode(_windows()).alias("w")).select("uid", "m", "w.at", "w.window")
    small = windows.limit(broadcast_windows + 1).count() <= broadcast_windows
    found = found.join(F.broadcast(windows) if small else windows, ["m", "window"])
    hits = found.groupBy("uid").agg(F.array_sort(F.collect_set("item")).alias("items"), F.array_sort(F.collect_set(F.struct("at", "m"))).alias("hits"))
    ends = lambda h: h["at"] + h["m"]
    cover = F.aggregate("hits", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")), lambda a, h: F.struct((a["n"] + F.greatest(F.lit(0), ends(h) - F.greatest(a["to"], h["at"]))).alias("n"), F.greatest(a["to"], ends(h)).alias("to")), lambda a: a["n"])
    return (
        held.drop("words", "runs")
        .join(hits, "uid", "left")
        .select("uid", "doc_id", "th", "n_words", F.coalesce(F.when(F.col("hits").isNotNull(), cover), F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("hits", F.array().cast("array<struct<at:int,m:int>>")).alias("hits"))
    )


def clean(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The documents that hold no window of the benchmark, with all their columns."""
    hit = decontaminate(docs, benchmark, **parameters).where("n_hit > 0").select(F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th"))
    own = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(hit, docs["doc_id"].cast("long").eqNullSafe(hit.hit_id) & (own == hit.hit_th), "left_anti")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT uid, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT uid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
h AS (SELECT uid, i, dw.m, item FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win),
p AS (SELECT uid, count(DISTINCT q) AS n_hit FROM (SELECT uid, unnest(range(i, i + m)) AS q FROM h) GROUP BY uid),
s AS (SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT uid, item FROM h) GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (uid) LEFT JOIN s USING (uid)
"""
