"""Vectors in long form: pooling, standardising, layer diagnostics, guarded choice of a layer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Unit round-off by number type, for the verdict that a layer adds nothing.
ROUND_OFF = {"float64": 2.0**-53, "float32": 2.0**-24, "float16": 2.0**-11, "bfloat16": 2.0**-8}
SAMPLE_ROWS = 4096
#: A vector of which only the numbers that are not 0 are held: its width, their ascending places, their values.
SPARSE = "struct<size:int,at:array<int>,x:array<double>>"


def is_sparse(df: DataFrame, vec: str = "vec") -> bool:
    return df.schema[vec].dataType.simpleString() == SPARSE


def sparse_array(width: int, rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """Places and values of each row as a column of ``SPARSE``."""
    ends = pa.array(np.cumsum([0, *(len(at) for at, _ in rows)]).astype(np.int32))
    at, x = (np.concatenate([r[i] for r in rows]) if rows else np.zeros(0) for i in (0, 1))
    lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(t))) for v, t in ((at, np.int32), (x, np.float64))]
    return pa.StructArray.from_arrays([pa.array(np.full(len(rows), width, np.int32)), *lists], ["size", "at", "x"])


def long_form(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    return df.select(*keys, F.posexplode(F.transform(vec, lambda x: x.cast("double"))).alias("dim", "x"))


def pool(df: DataFrame, keys: list[str], order: str, how: str = "mean", vec: str = "vec", special: str | None = None, include_special: bool = False) -> DataFrame:
    """One vector an item from those of its tokens or windows: mean, max, first (bos) or last (eos).

    Tokens that the column ``special`` marks are left out of all but bos, unless they are asked for or an item
    has no others. "none" gives the real tokens as they are."""
    masked = special is not None and not include_special
    if how == "none":
        return (df if special is None else df.where(~F.col(special))).select(*keys, order, vec)
    if how in ("first", "bos", "cls", "marker"):
        return df.groupBy(*keys).agg(F.min_by(vec, order).alias("vec"))
    if how in ("last", "eos"):
        return df.groupBy(*keys).agg(F.max_by(vec, F.struct(~F.col(special), order) if masked else order).alias("vec"))
    if how not in ("mean", "max"):
        raise ValueError(f"unknown pooling {how!r}")
    if not masked:
        return _summary(df, keys, how, vec)
    return _summary(df, [*keys, special], how, vec).groupBy(*keys).agg(F.min_by("vec", special).alias("vec"))


def _summary(df: DataFrame, keys: list[str], how: str, vec: str = "vec") -> DataFrame:
    """Element-wise mean, max and the like of vectors, by MLlib's one-pass summariser: a row a vector, not a number."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    made = df.withColumn("v", array_to_vector(F.col(vec).cast("array<double>")))
    return made.groupBy(*keys).agg(vector_to_array(getattr(Summarizer, how)(F.col("v"))).alias("vec"))


def window_mean(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """Element-wise mean over an instance's windows."""
    if is_sparse(df, vec):
        return _sparse_mean(df, keys, vec)
    return _summary(df, keys, "mean", vec)


def _sparse_mean(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    each = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(f"{vec}.size").alias("size"), F.collect_list(vec).alias("l"))  # an item's own windows
    each = each.select(*keys, "n", "size", *[F.flatten(f"l.{c}").alias(c) for c in ("at", "x")])
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            rows, width = [], b["size"][0].as_py()
            for n, at, x in zip(b["n"].to_pylist(), b["at"], b["x"]):
                at, x = at.values.to_numpy(), x.values.to_numpy()
                if n > 1:
                    at, place = np.unique(at, return_inverse=True)
                    x = np.bincount(place, x, len(at)) / n
                rows.append((at, x))
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keys), sparse_array(width, rows)], [*keys, "vec"])

    return each.mapInArrow(run, f"{kinds}, vec {SPARSE}")


def _moments(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """keys, mean and var (population) of vectors, element by element."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    made = df.select(*keys, array_to_vector(F.col(vec).cast("array<double>")).alias("v"))
    found = made.groupBy(*keys).agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("m"))
    n = F.col("m.count").cast("double")
    return found.select(*keys, vector_to_array("m.mean").alias("mean"), F.transform(vector_to_array("m.variance"), lambda x: x * (n - 1) / n).alias("var"))


def check_one_to_one(made: DataFrame, wanted: DataFrame, key: str, vec: str = "vec") -> None:
    """Raises unless every wanted key has one row and no vector holds NaN."""
    bad = made.where(F.exists(vec, lambda x: F.isnan(x))).limit(1).count()
    twice = made.groupBy(key).count().where("count > 1").limit(1).count()
    missing = wanted.select(key).join(made.select(key), key, "left_anti").limit(1).count()
    extra = made.select(key).join(wanted.select(key), key, "left_anti").limit(1).count()
    if bad or twice or missing or extra:
        raise ValueError("vectors are NaN, repeated, missing or of no item")


def check_layers(df: DataFrame, items: DataFrame, key: str, vec: str = "vec") -> list[int]:
    """The layers of (key, layer_id, vec); raises unless each item has one vector without NaN in each. One job."""
    nan = F.exists(f"{vec}.x" if is_sparse(df, vec) else vec, lambda x: F.isnan(x)) | F.col(vec).isNull()
    made = df.groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_set("layer_id")).alias("_layers"), F.count(F.lit(1)).alias("_n"), F.max(nan).alias("_nan"))
    known = items.groupBy(key).agg(F.count(F.lit(1)).alias("_items"))
    both = known.join(made, F.col(key).eqNullSafe(F.col("_key")), "full")
    bad = F.col("_n").isNull() | F.col("_items").isNull() | (F.col("_items") > 1) | (F.col("_n") != F.size("_layers")) | F.col("_nan")
    found = both.agg(F.count_if(bad).alias("bad"), F.min("_layers").alias("least"), F.max("_layers").alias("most")).first()
    if found.bad or found.least != found.most:
        raise ValueError("vectors are NaN, repeated, missing or of no item")
    return list(found.least or [])


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x))


def standardise(df: DataFrame, keys: list[str], train: Column, vec: str = "vec") -> DataFrame:
    """keys, dim, z: by mean and population deviation of the training rows; a constant is divided by 1."""
    fitted = _moments(df.where(train), [], vec)  # one row of as many numbers as a vector has
    moved = F.zip_with(F.transform(vec, lambda x: x.cast("double")), F.col("mean"), lambda x, m: x - m)
    z = F.zip_with(moved, F.col("var"), lambda x, v: x / F.when(v > 0, F.sqrt(v)).otherwise(1.0))
    return df.crossJoin(F.broadcast(fitted)).select(*keys, F.posexplode(z).alias("dim", "z"))


def sample_rows(df: DataFrame, key: str, limit: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``limit`` rows, evenly spaced in the order of the key, always the first and the last."""
    n = df.count()
    if n <= limit:
        return df
    wanted = df.sparkSession.range(limit).select(F.expr(f"(id * {n - 1}L) div {limit - 1}L").alias("row")).distinct()
    parts = df.select(key).repartitionByRange(key).sortWithinPartitions(key)
    ranked = parts.select(key, F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("k"))
    before = ranked.groupBy("p").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    keys = ranked.join(F.broadcast(before.select("p", "before")), "p").withColumn("row", F.col("before") + F.col("k")).join(F.broadcast(wanted), "row", "left_semi").select(key)
    return df.join(keys, key, "left_semi")


def depth_health(emb: DataFrame, item: str = "item", layer: str = "layer_id", vec: str = "vec", dtype: str = "bfloat16", floor: float = 1e-12) -> DataFrame:
    """A row for each layer: rms, rel_std, cos and delta to the layer before, frozen, degenerate."""
    own = emb.select(item, layer, F.transform(vec, lambda x: x.cast("double")).alias("v"))
    before = F.lag("v").over(Window.partitionBy(item).orderBy(layer))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rows = own.withColumn("u", before)
    rows = rows.select(layer, F.size("v").alias("dim"), dot(F.col("v"), F.col("v")).alias("vv"), dot(F.col("u"), F.col("u")).alias("uu"), dot(F.col("v"), F.col("u")).alias("vu"))
    change = F.greatest(F.lit(0.0), F.col("vv") + F.col("uu") - 2 * F.col("vu"))
    per = rows.groupBy(layer).agg(
        F.sqrt(F.sum("vv") / F.sum("dim")).alias("rms"),
        F.avg(F.try_divide(F.col("vu"), F.sqrt(F.col("vv")) * F.sqrt(F.col("uu")))).alias("cos"),
        F.when(F.count("uu") > 0, F.sqrt(F.sum(F.when(F.col("uu").isNotNull(), change)) / F.sum(F.when(F.col("uu").isNotNull(), F.col("dim"))))).alias("moved"),
    )
    mean_of = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + F.greatest(x, F.lit(0.0))) / F.size(a)
    spread = _moments(own, [layer], "v").select(layer, F.sqrt(mean_of(F.col("var"))).alias("spread"))
    out = per.join(spread, layer)
    delta = F.try_divide(F.col("moved"), F.when(F.col("rms") > 0, F.col("rms")))
    return out.select(layer, "rms", F.coalesce(F.try_divide("spread", F.when(F.col("rms") > 0, F.col("rms"))), F.lit(0.0)).alias("rel_std"), "cos", delta.alias("delta"), F.coalesce(delta <= ROUND_OFF[dtype], F.lit(False)).alias("frozen"), (F.col("rms") <= floor).alias("degenerate"))


def least_update(health: DataFrame, layer: str = "layer_id") -> DataFrame:
    """The layer with the least delta, the first of equals."""
    return health.where("delta IS NOT NULL").orderBy("delta", layer).limit(1).select(F.col("delta").alias("ratio_min"), F.col(layer).alias("ratio_min_layer"))


def layer_gaps(layers: DataFrame, layer: str = "layer_id") -> DataFrame:
    """Neighbouring layers that are not one apart. Layers are few: one window holds them."""
    before = F.lag(layer).over(Window.orderBy(layer))
    return layers.select(layer).distinct().select(before.alias("after_layer"), F.col(layer).alias("next_layer")).where(F.col("next_layer") - F.col("after_layer") != 1)


def usable_layers(health: DataFrame, layer: str = "layer_id") -> DataFrame:
    """The layers that are not degenerate, or all of them if all are."""
    alive = F.sum((~F.col("degenerate")).cast("int")).over(Window.partitionBy())
    return health.withColumn("alive", alive).where(~F.col("degenerate") | (F.col("alive") == 0)).select(layer)


def best_layer(scores: DataFrame, health: DataFrame, layer: str = "layer_id", score: str = "score") -> DataFrame:
    """The best usable layer, the first of equals, and what an unguarded choice would have been."""
    known = F.when(~F.isnan(score), F.col(score))
    rank = lambda: Window.orderBy(F.col("s").desc_nulls_last(), layer)
    all_ = scores.withColumn("s", known)
    naive = all_.withColumn("r", F.row_number().over(rank())).where("r = 1").select(F.col(layer).alias("would_have_picked"))
    usable = usable_layers(health, layer)
    guarded = all_.join(usable, layer).withColumn("r", F.row_number().over(rank())).where("r = 1").select(F.col(layer).alias("best_layer"), F.col("s").alias("best_score"))
    count = all_.join(usable.withColumn("u", F.lit(1)), layer, "left").agg(F.count("u").alias("considered"), F.count_if(F.col("u").isNull()).alias("excluded"))
    return guarded.crossJoin(naive).crossJoin(count)


def padding_efficiency(batches: DataFrame) -> DataFrame:
    """The share of real tokens in padded batches (batch, length): 1 if there are none."""
    each = batches.groupBy("batch").agg(F.sum("length").alias("tokens"), (F.max("length") * F.count(F.lit(1))).alias("slots"))
    return each.agg(F.coalesce(F.try_divide(F.sum("tokens"), F.sum("slots")), F.lit(1.0)).alias("efficiency"))


def overflow_counts(windows: DataFrame, by: str, item: str, over: Column) -> DataFrame:
    """Windows, items and items over the context of each split."""
    return windows.groupBy(by).agg(F.count(F.lit(1)).alias("n_windows"), F.countDistinct(item).alias("n_items"), F.countDistinct(F.when(over, F.col(item))).alias("n_overflow"))
