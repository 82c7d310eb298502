"""Models whose tokens are not letters: pooling with special tokens, spans, masked token sets, mixed resolutions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import sequences as S
from .models import BASES, SequenceModel, Unsupported, exploded, padded_lengths, runs
from .sources.shared import written

POOLS = ("mean", "max", "last", "bos", "none")
#: Numbers of states that a batch of token vectors holds, a sequence's own being together.
STATES = 1 << 20


@dataclass
class Tokens:
    """What a network gives of one sequence: tokens x layers x width, which tokens are special, and where each
    stands in the letters (start, end), special ones at (0, 0)."""

    states: np.ndarray
    special: np.ndarray
    spans: np.ndarray


def spans_of(pieces: list[str], special: np.ndarray) -> np.ndarray:
    """Spans of consecutive pieces; a special token has no letters."""
    size = np.where(special, 0, [len(p) for p in pieces])
    end = np.cumsum(size)
    return np.where(np.asarray(special)[:, None], 0, np.stack([end - size, end], axis=1)) if len(pieces) else np.zeros((0, 2), np.int64)


def pooled(t: Tokens, pool: str, include_special: bool = False) -> np.ndarray:
    """layers x width: over the real tokens, or all of them if asked for or if none is real; bos is the first of all."""
    if pool == "bos":
        return t.states[0]
    kept = t.states if include_special or t.special.all() else t.states[~t.special]
    return {"mean": lambda: kept.mean(axis=0), "max": lambda: kept.max(axis=0), "last": lambda: kept[-1]}[pool]()


class TokenModel(SequenceModel):
    """A model that gives its tokens' states; poolings and spans follow from them."""

    pools = ("mean", "max", "last", "bos")
    capabilities = frozenset({"embed"})
    include_special = False

    def run_tokens(self, seqs: list[str], layers: str) -> list[Tokens]:
        raise Unsupported("run_tokens")

    def embed(self, seqs, layers="last", pool="mean"):
        return np.stack([pooled(t, pool, self.include_special) for t in self.run_tokens(seqs, layers)])

    def token_vectors(self, df: DataFrame, key: str, seq: str, layers: str = "last") -> DataFrame:
        """key, layer_id, token, start, end, vec: pooling "none", of the real tokens with the letters that they cover."""
        kind = df.schema[key].dataType.simpleString()

        first = 0 if layers == "all" else (self.n_layers or 1) - 1

        def made(b, parts):
            n, m = np.array([len(x) for _, x, _ in parts]), parts[0][1].shape[1]
            states, spans = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
            token = np.arange(len(states)) - np.repeat(np.cumsum(n) - n, n)
            columns = [np.tile(np.arange(m) + first, len(states)), *(np.repeat(c, m) for c in (token, spans[:, 0], spans[:, 1]))]
            ends = np.arange(len(states) * m + 1, dtype=np.int32) * states.shape[2]
            vec = pa.ListArray.from_arrays(pa.array(ends), pa.array(states.astype(np.float64).ravel()))
            rows = pa.array(np.repeat([k for k, *_ in parts], n * m))
            return pa.RecordBatch.from_arrays([b[0].take(rows), *(pa.array(c.astype(np.int32)) for c in columns), vec], names=["key", "layer_id", "token", "start", "end", "vec"])

        def run(batches):
            for b in runs(batches, 1, self.run_bytes):
                parts, held = [], 0
                for k, t in enumerate(self.run_tokens([s or "" for s in b[1].to_pylist()], layers)):
                    real = ~t.special
                    if not real.any():
                        continue
                    parts.append((k, t.states[real], t.spans[real]))
                    held += parts[-1][1].size
                    if held >= STATES:
                        yield made(b, parts)
                        parts, held = [], 0
                if parts:
                    yield made(b, parts)

        return df.select(key, seq).mapInArrow(run, f"key {kind}, layer_id int, token int, start int, end int, vec array<double>").withColumnRenamed("key", key)


class KmerTokenModel(SequenceModel):
    """A masked model over overlapping k-mers, one at each ``shift`` letters. ``set_logits`` is its network."""

    capabilities = frozenset({"variant_llr"})
    k, shift = 6, 1

    def number(self, kmer: str) -> int | None:
        """The vocabulary's number of a k-mer, None if it is unknown."""
        value = 0
        for c in kmer:
            if c not in BASES:
                return None
            value = 4 * value + BASES.index(c)
        return value

    def set_logits(self, reference: str, tokens: list[int], wanted: list[list[int]]) -> list[list[float]]:
        """Logits with all of ``tokens`` masked together: for each token those of its wanted numbers."""
        raise Unsupported("variant_llr")

    def token_set_llrs(self, df: DataFrame, key: str) -> DataFrame:
        """key, llr, n_unknown: over a variant's mutations and all tokens that cover each, the logit of the mutant's
        k-mer less that of the reference's; tokens of which either is unknown count in n_unknown alone.

        df: key, reference, mutations. The network runs once for each distinct (reference, set of tokens), whatever
        the letters, and gives of each token the four k-mers that the place can make; the reference's own is read there. References travel to it once a
        set; all else is joined by their hashes. A place that no token covers raises. To 12 places, as sums of
        one multiset should tie whatever their order."""
        self.require("variant_llr")
        n, k, shift = F.length("reference"), self.k, self.shift
        sites = exploded(df, key).select(key, "ref", "reference", "m.pos0", F.substring("reference", F.col("m.pos0") + 1, F.lit(1)).alias("wt"), "m.mut")
        tokens = S.affected_tokens(F.col("pos0"), n, k, shift)
        none = F.raise_error(F.concat(F.lit("no token covers place "), F.col("pos0").cast("string"), F.lit(" of a reference of "), n.cast("string"), F.lit(" letters")))
        sets = sites.select("ref", "pos0", "reference").distinct()
        sets = sets.withColumn("tokens", tokens).withColumn("tokens", F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(none))

        def run(batches):
            for b in batches:
                out = []
                for reference, pos0, own in zip(b["reference"].to_pylist(), b["pos0"].to_pylist(), b["tokens"].to_pylist()):
                    numbers = [[self.number(reference[j * shift : pos0] + c + reference[pos0 + 1 : j * shift + k]) for c in BASES] for j in own]
                    logits = self.set_logits(reference, own, [[x or 0 for x in row] for row in numbers])
                    if not np.isfinite(logits).all():
                        raise ValueError(f"{self.name}: logits must be finite")
                    out.append([[None if x is None else float(v) for x, v in zip(row, got)] for row, got in zip(numbers, logits)])
                yield pa.RecordBatch.from_arrays([b["ref"], b["pos0"], pa.array(out, pa.list_(pa.list_(pa.float64())))], names=["ref", "pos0", "logits"])

        scored = written(sets.mapInArrow(run, "ref string, pos0 int, logits array<array<double>>"), "sets")
        at = lambda base: f"get(x, instr('{BASES}', {base}) - 1)"
        gains = F.expr(f"transform(logits, x -> {at('mut')} - {at('wt')})")
        known = sites.drop("reference").join(scored, ["ref", "pos0"]).withColumn("gains", gains)
        each = known.select(key, F.aggregate("gains", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))).alias("llr"), F.size(F.filter("gains", lambda x: x.isNull())).alias("unknown"))
        return each.groupBy(key).agg(F.round(F.sum("llr"), 12).alias("llr"), F.sum("unknown").alias("n_unknown"))


class MixedModel(SequenceModel):
    """A network that pads to a multiple and halves its sequence on the way, so that layers differ in length.

    ``run_padded`` gives of sequences of one padded length each layer's states, (batch, places, width). Layers
    are pooled over their own real places, ceil(n / f) of them where f letters make one."""

    pools = ("mean", "max", "last")
    capabilities = frozenset({"embed"})
    multiple, include_special = 128, False

    def run_padded(self, seqs: list[str], padded: int) -> list[np.ndarray]:
        raise Unsupported("run_padded")

    def _chosen(self, states: list[np.ndarray], layers: str) -> list[np.ndarray]:
        return states if layers == "all" else states[-1:]

    def _by_length(self, seqs: list[str]):
        """(padded length, positions of its sequences): never two lengths together."""
        padded = padded_lengths([len(s) for s in seqs], self.multiple)
        for width in np.unique(padded).tolist():
            yield width, np.flatnonzero(padded == width).tolist()

    @staticmethod
    def places(n: int, padded: int, states: int) -> int:
        """How many of a layer's places hold letters, one at least."""
        return min(max(math.ceil(n / (padded // states)), 1), states)

    def embed(self, seqs, layers="last", pool="mean"):
        return self.embed_pools(seqs, layers, (pool,))[0]

    def embed_pools(self, seqs: list[str], layers: str, pools: tuple[str, ...]) -> np.ndarray:
        """pools x items x layers x width of one run of the network."""
        out: list = [[None] * len(seqs) for _ in pools]
        of = {"mean": lambda v: v.mean(axis=0), "max": lambda v: v.max(axis=0), "last": lambda v: v[-1]}
        for padded, own in self._by_length(seqs):
            chosen = self._chosen(self.run_padded([seqs[i] for i in own], padded), layers)
            for row, i in enumerate(own):
                real = [x[row] if self.include_special else x[row, : self.places(len(seqs[i]), padded, x.shape[1])] for x in chosen]
                for made, pool in zip(out, pools):
                    made[i] = [of[pool](v) for v in real]
        return np.array(out, np.float64)

    def pooled(self, df: DataFrame, key: str, seq: str, layers: str = "last", pools: tuple[str, ...] = ("mean", "max", "last")) -> DataFrame:
        """key, layer_id and a vector named by each pooling, of one run of the network."""
        self.require("embed")
        if absent := [p for p in pools if p not in self.pools]:
            raise Unsupported(f"{self.name} does not pool by {', '.join(absent)}; it does by {', '.join(self.pools)}")
        first = 0 if layers == "all" else (self.n_layers or 1) - 1

        def run(batches):
            for b in runs(batches, 1, self.run_bytes):
                x = self.embed_pools([s or "" for s in b[1].to_pylist()], layers, pools)
                if np.isnan(x).any():
                    raise ValueError(f"{self.name}: embeddings must hold no NaN")
                _, n, m, w = x.shape
                ends = pa.array(np.arange(n * m + 1, dtype=np.int32) * w)
                vecs = [pa.ListArray.from_arrays(ends, pa.array(own.ravel())) for own in x]
                yield pa.RecordBatch.from_arrays([b[0].take(pa.array(np.repeat(np.arange(n), m))), pa.array((np.tile(np.arange(m), n) + first).astype(np.int32)), *vecs], names=["key", "layer_id", *pools])

        kinds = ", ".join(f"`{p}` array<double>" for p in pools)
        return df.select(key, seq).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, layer_id int, {kinds}").withColumnRenamed("key", key)

    def token_vectors(self, df: DataFrame, key: str, seq: str, layers: str = "last") -> DataFrame:
        """key, layer_id, token, start, end, vec: every real place, f letters wide; layers of several lengths raise."""
        kind = df.schema[key].dataType.simpleString()

        def run(batches):
            for b in runs(batches, 1, self.run_bytes):
                seqs, rows = [s or "" for s in b[1].to_pylist()], []
                for padded, own in self._by_length(seqs):
                    chosen = self._chosen(self.run_padded([seqs[i] for i in own], padded), layers)
                    if len({x.shape[1] for x in chosen}) > 1:
                        raise ValueError(f"{self.name}: layers of {sorted({x.shape[1] for x in chosen})} places have no common tokens")
                    first = 0 if layers == "all" else (self.n_layers or 1) - 1
                    f = padded // chosen[0].shape[1]
                    for row, i in enumerate(own):
                        n = len(seqs[i])
                        for j in range(self.places(n, padded, chosen[0].shape[1])):
                            rows += [(i, first + k, j, j * f, min((j + 1) * f, n), x[row, j].astype(float).tolist()) for k, x in enumerate(chosen)]
                i, *columns = zip(*rows) if rows else [[]] * 6
                kinds = [pa.int32()] * 4 + [pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([b[0].take(pa.array(i, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["key", "layer_id", "token", "start", "end", "vec"])

        return df.select(key, seq).mapInArrow(run, f"key {kind}, layer_id int, token int, start int, end int, vec array<double>").withColumnRenamed("key", key)
