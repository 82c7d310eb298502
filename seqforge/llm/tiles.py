"""Nodes that share keys, dealt to tiles of bounded size, so that all pairs with a key in common meet.

Keys link nodes to groups. A group of up to ``2 * least`` nodes is one tile. A larger one is split either
as a whole, into parts whose pairs are its tiles, or by its buckets (the nodes of one key), each split in
the same way if it is large; whichever ships fewer rows. Nodes that are all alike go the first way, long
chains of loose links the second. Buckets of equal members count once, and a pair that meets in more
than one bucket belongs to that of its least key. No pair is given up either way, and no task holds more
than two parts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

#: Parts that a group is split into at first, and bytes that a part holds at most.
PARTS, PART_BYTES = 24, 4 << 20
TILE = ["mode", "tile", "a", "b"]


def _parts(n: str, size: str, least: int, most: int, parts: int) -> Column:
    side = F.least(F.greatest(F.ceil(F.col(n) / parts), F.lit(least)), F.lit(most))
    split = F.greatest(F.ceil(F.col(n) / side), F.ceil(F.col(size) / PART_BYTES))
    return F.when((F.col(n) <= 2 * least) & (F.col(size) <= 2 * PART_BYTES), 1).otherwise(split).cast("int")


def deal(members: DataFrame, least: int = 64, most: int = 1000, parts: int = PARTS) -> DataFrame:
    """node, deals: for each node that shares a key its places, an array of (mode, tile, parts).

    members: node long (a row each), size long (bytes), keys array<long> (distinct). mode 0: the tile is of
    all nodes of a group, its root; mode 1: of those of a key. A node's places are as many as its keys at most."""
    split = lambda n, size: _parts(n, size, least, most, parts)
    rows = members.select("node", "size", F.explode("keys").alias("key"))
    buckets = cut(rows.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n"), F.sum("size").alias("bytes"), F.bit_xor(F.xxhash64("node")).alias("mark")).where("n > 1"), "buckets")
    groups = components(rows.join(buckets.select("key", "least"), "key").select(F.col("node").alias("a"), F.col("least").alias("b")))
    sized = groups.join(members.select("node", "size"), "node")
    totals = cut(sized.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).withColumn("parts", split("n", "bytes")), "groups")
    whole = groups.join(totals.select("root", "parts"), "root")
    place = F.struct(F.lit(0).alias("mode"), F.col("root").alias("tile"), "parts")
    large = totals.where("parts > 1")
    if large.isEmpty():
        return whole.select("node", F.array(place).alias("deals"))
    own = buckets.join(groups.withColumnRenamed("node", "least"), "least").join(large.select("root"), "root")
    own = own.groupBy("root", "least", "n", "mark").agg(F.min("key").alias("key"), F.max("bytes").alias("bytes")).withColumn("parts", split("n", "bytes"))
    own = cut(own.select("root", "key", "n", "parts"), "own")
    cheaper = own.groupBy("root").agg(F.sum(F.col("n") * F.col("parts")).alias("cost")).join(large.select("root", (F.col("n") * F.col("parts")).alias("whole")), "root").where("cost < whole").select("root")
    cheaper = cut(cheaper, "cheaper")
    by_key = rows.join(own.join(cheaper, "root", "left_semi").select("key", "parts"), "key")
    places = whole.join(cheaper, "root", "left_anti").select("node", place.alias("deal"))
    places = places.unionByName(by_key.select("node", F.struct(F.lit(1).alias("mode"), F.col("key").alias("tile"), "parts").alias("deal")))
    return places.groupBy("node").agg(F.collect_list("deal").alias("deals"))


def spread(df: DataFrame, *payload: str) -> DataFrame:
    """mode, tile, a, b, part and the payload: a row for each tile that a row's deals put it in."""
    dealt = df.select(*payload, "node", F.explode("deals").alias("d"))
    part = F.pmod(F.xxhash64("node", "d.tile"), F.col("d.parts")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("d.parts") - 1), lambda k: F.struct(F.least(k, F.col("part")).alias("a"), F.greatest(k, F.col("part")).alias("b")))
    dealt = dealt.withColumn("part", part)
    return dealt.select(*payload, "node", "d.mode", "d.tile", "part", F.explode(tiles).alias("t")).select("mode", "tile", "t.a", "t.b", "part", "node", *payload)


def meeting(keys: list[np.ndarray], below: int | None = None) -> np.ndarray:
    """Whether each two nodes have a key in common (one under ``below``, if given): a symmetric matrix."""
    m = len(keys)
    own = np.repeat(np.arange(m), [len(k) for k in keys])
    flat = np.concatenate([np.asarray(k, np.int64) for k in keys]) if m else np.zeros(0, np.int64)
    if below is not None:
        own, flat = own[flat < below], flat[flat < below]
    order = np.argsort(flat, kind="stable")
    flat, own = flat[order], own[order]
    at = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
    count = np.diff(np.append(at, len(flat)))
    out = np.zeros((m, m), bool)
    for c in np.unique(count[count > 1]).tolist():
        members = own[at[count == c][:, None] + np.arange(c)]
        if c < 16:
            for i in range(c):
                for j in range(i + 1, c):
                    out[members[:, i], members[:, j]] = True
        else:
            for x in members:
                out[x[:, None], x] = True
    return out | out.T


def belong(mode: int, tile: int, a: int, b: int, part: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Which pairs of a tile's nodes are to be compared in it and nowhere else."""
    out = ~np.eye(len(part), dtype=bool)
    if a != b:
        out &= part[:, None] != part[None, :]
    if mode:
        out &= ~meeting(keys, tile)
    return out
