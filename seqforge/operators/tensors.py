"""Arithmetic around a network's outputs: log-probabilities, spans of other token layouts, readouts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Expected numbers of readable layers by family of model: layers and the input embedding, unless it says.
SWEEP_WITHOUT_INPUT = ("no-input",)


def exact_sum(z: Column) -> Column:
    """The sum of an array's numbers with what rounding drops added at the end, so that it does not grow with their number."""

    def step(a, x):
        t, s = a["s"] + x, a["s"]
        lost = F.when(F.abs(s) >= F.abs(x), (s - t) + x).otherwise((x - t) + s)
        return F.struct(t.alias("s"), (a["lost"] + lost).alias("lost"))

    return F.aggregate(z, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("lost")), step, lambda a: a["s"] + a["lost"])


def reduce_logprobs(z: Column, how: str = "mean") -> Column:
    """Score of a sequence from its tokens' log-probabilities; 0 for none."""
    if how not in ("mean", "sum"):
        raise ValueError(f"unknown reduction {how!r}")
    total = F.aggregate(z, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(z) > 0, total / F.size(z) if how == "mean" else total).otherwise(0.0)


def masked_logprobs(z: Column, special: Column) -> Column:
    """The log-probabilities of real tokens: those that ``special`` does not mark."""
    kept = F.filter(F.zip_with(z, special, lambda x, s: F.struct(x.alias("x"), s.alias("s"))), lambda p: ~p["s"])
    return F.transform(kept, lambda p: p["x"])


def check_per_base(df: DataFrame, seq: str, z: str) -> None:
    """Raises unless there is one log-probability for each base."""
    if df.where(F.size(z) != F.length(seq)).limit(1).count():
        raise ValueError("log-probabilities are not as many as bases")


def coarse_spans(length: Column, factor: int, padded_to: int = 128) -> Column:
    """Half-open spans of tokens ``factor`` bases wide, over the real bases of a padded sequence."""
    n = F.ceil(length / F.lit(float(factor))).cast("int")
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct((j * factor).alias("start"), F.least((j + 1) * factor, length).alias("end")))
    return F.when(n > 0, each).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def padded_length(length: Column, multiple: int = 128) -> Column:
    return F.ceil(length / F.lit(float(multiple))).cast("int") * multiple


def piece_spans(df: DataFrame, key: str, pieces: str, special: str | None = None) -> DataFrame:
    """key, spans: half-open spans of tokens of any width, each from where the letters of those before it end. A
    token that ``special`` marks has no letters and stands at (0, 0). Prefix sums over the tokens of a whole batch."""

    def run(batches):
        for b in batches:
            lists = b[1]
            count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            size = pc.fill_null(pc.utf8_length(lists.flatten()), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            mark = np.zeros(len(size), bool) if special is None else pc.fill_null(b[2].flatten(), False).to_numpy(zero_copy_only=False)
            if len(mark) != len(size):
                raise ValueError("marks are not as many as tokens")
            size[mark] = 0
            end = np.cumsum(size)
            at = np.concatenate(([0], np.cumsum(count)))
            before = np.concatenate(([0], end))[at[:-1]]
            end -= np.repeat(before, count)
            start = np.where(mark, 0, end - size)
            spans = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(np.where(mark, 0, end).astype(np.int32))], ["start", "end"])
            yield pa.RecordBatch.from_arrays([b[0], pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans)], names=["key", "spans"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, pieces, *([special] if special else [])).mapInArrow(run, f"key {kind}, spans array<struct<start:int,end:int>>").withColumnRenamed("key", key)


def spread(df: DataFrame, keys: list[str], spans: str, values: str) -> DataFrame:
    """keys, pos, value: a token's value at each letter that it covers. Tokens without letters give none."""
    each = df.select(*keys, F.explode(F.arrays_zip(F.col(spans).alias("s"), F.col(values).alias("v"))).alias("t")).select(*keys, "t.s.start", "t.s.end", F.col("t.v").alias("value"))
    return each.where("end > start").select(*keys, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"), "value")


def real_places(n: Column, padded: Column, states: Column) -> Column:
    """How many of a layer's places hold letters, if ``states`` of them stand for ``padded`` letters; one at least."""
    factor = F.floor(padded / states)
    return F.least(F.greatest(F.ceil(n / factor), F.lit(1)), states).cast("int")


def pool_places(states: Column, n: Column, padded: Column, how: str = "mean", include_special: bool = False) -> Column:
    """One vector of a layer's places (array<array<double>>), over the real ones, or all if asked for."""
    kept = states if include_special else F.slice(states, F.lit(1), real_places(n, padded, F.size(states)))
    if how == "last":
        return F.element_at(kept, -1)
    if how not in ("mean", "max"):
        raise ValueError(f"unknown pooling {how!r}")
    join = (lambda x, y: x + y) if how == "mean" else (lambda x, y: F.greatest(x, y))
    total = F.aggregate(F.slice(kept, F.lit(2), F.greatest(F.size(kept) - 1, F.lit(0))), kept[0], lambda a, v: F.zip_with(a, v, join))
    return F.transform(total, lambda x: x / F.size(kept)) if how == "mean" else total


def readout_kind(tap: Column) -> Column:
    """Of a named tap: inside a block's branch, or the residual stream, which alone can be compared."""
    return F.when(tap.rlike(r"\.(mlp|attn|mixer|filter|norm)"), "branch").when(tap.rlike(r"^(blocks|layers)\.\d+$|^embedding"), "residual").otherwise("unknown")


def mixed_readouts(taps: DataFrame, model: str = "model", tap: str = "tap") -> DataFrame:
    """Models whose taps are of more than one kind."""
    kinds = taps.groupBy(model).agg(F.countDistinct(readout_kind(F.col(tap))).alias("kinds"))
    return kinds.where("kinds > 1").select(model)


def last_block_check(a: Column, b: Column, tolerance: float = 1e-5) -> Column:
    """(rel_delta, cosine, same) of two readings of one layer: largest difference over the rms of a."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    most = F.array_max(F.zip_with(a, b, lambda p, q: F.abs(p - q)))
    rel = F.try_divide(most, F.sqrt(dot(a, a) / F.size(a)))
    return F.struct(rel.alias("rel_delta"), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))).alias("cosine"), F.coalesce(rel <= tolerance, F.lit(False)).alias("same"))


def sweep_coverage(models: DataFrame, swept: DataFrame) -> DataFrame:
    """model, expected, swept, coverage. models: model, family, n_layers, n_taps (as a spec names them,
    null if it does not); swept: model, layer_id. Unknown numbers give a null coverage."""
    usual = F.when(F.col("family").isin(*SWEEP_WITHOUT_INPUT), F.col("n_layers")).otherwise(F.col("n_layers") + 1)
    n = swept.groupBy("model").agg(F.countDistinct("layer_id").alias("swept"))
    out = models.join(n, "model", "left").select("model", F.coalesce("n_taps", usual).alias("expected"), F.coalesce("swept", F.lit(0)).alias("swept"))
    return out.withColumn("coverage", F.try_divide("swept", "expected"))
