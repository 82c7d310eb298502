"""Sequence models as plug-ins: what they declare, and Arrow-batched columns of what they compute."""

from __future__ import annotations

from abc import ABC
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import features
from .operators.vectors import SPARSE, sparse_array
from .sources.shared import written

BASES = "ACGT"
CAPABILITIES = ("tokenize", "score", "per_token", "variant_llr", "embed")


class Unsupported(NotImplementedError):
    """A capability was used that the model does not declare."""


def code_points(seqs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all letters of the sequences, one after another, and where each sequence ends in them."""
    codes = np.frombuffer("".join(seqs).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.cumsum([len(s) for s in seqs], dtype=np.int64)


def exploded(df: DataFrame, key: str) -> DataFrame:
    """key, ref (the reference's hash), reference, m: a row a mutation. The outer form is made without a filter on the
    array's size, which the optimiser would parse every mutant for again."""
    each = df.select(key, "reference", F.explode_outer("mutations").alias("m")).where("m IS NOT NULL")
    return each.select(key, F.sha2("reference", 256).alias("ref"), "reference", "m")


def runs(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows in order, in slices whose strings of a column have so many bytes together; a longer one is alone."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b[column]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, end - at)
            at = end


class SequenceModel(ABC):
    """A model works on lists of sequences; its columns run it on Arrow batches of a DataFrame."""

    name, version = "model", "1"
    capabilities: frozenset[str] = frozenset()
    max_context: int | None = None
    n_layers: int | None = None
    pools: tuple[str, ...] = ("mean",)  # what ``embed`` can make of a sequence's tokens
    sparse = False  # whether ``embed_sparse`` gives what ``embed`` gives of the last layer
    run_bytes = 1 << 18  # of the sequences that one run is given together; what a task holds grows with it, not with a batch

    def tokenize(self, seqs: list[str]) -> list[list[int]]:
        raise Unsupported("tokenize")

    def score(self, seqs: list[str], reduction: str = "mean") -> list[float]:
        raise Unsupported("score")

    def per_token(self, seqs: list[str]) -> list[list[float]]:
        raise Unsupported("per_token")

    def site_logits(self, reference: str, pos0: int) -> list[float]:
        """Of A, C, G and T at a masked place."""
        raise Unsupported("variant_llr")

    def site_llr(self, reference: str, pos0: int, wt: str, mut: str) -> float:
        logits = self.site_logits(reference, pos0)
        return logits[BASES.index(mut)] - logits[BASES.index(wt)]

    def embed(self, seqs: list[str], layers: str = "last") -> np.ndarray:
        """items x layers x width; models of more than one pooling take ``pool`` too. "last" is a slice of "all"."""
        raise Unsupported("embed")

    def embed_sparse(self, seqs: list[str]) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
        """The width, and of each sequence the ascending places and values of its numbers that are not 0."""
        raise Unsupported("embed_sparse")

    def embed_with_logprobs(self, seqs: list[str], layers: str = "last", pool: str = "mean") -> tuple[np.ndarray, list[list[float]]]:
        """What ``embed`` and ``per_token`` return, of one run of the network. Only for models that can."""
        raise Unsupported("embed_with_logprobs")

    @property
    def fuses(self) -> bool:
        """Whether both heads come from one run."""
        return type(self).embed_with_logprobs is not SequenceModel.embed_with_logprobs and {"embed", "per_token"} <= self.capabilities

    def require(self, capability: str) -> None:
        if capability not in self.capabilities:
            raise Unsupported(f"{self.name} does not declare {capability}")

    # -- columns -----------------------------------------------------------------------------------
    def scores(self, df: DataFrame, key: str | list[str], seq: str, reduction: str = "mean") -> DataFrame:
        """key and score. With several columns for a key all of them pass through, so that nothing need be joined back;
        a sequence that a batch repeats is scored once."""
        self.require("score")
        keys = [key] if isinstance(key, str) else key

        def run(batches: Iterator[pa.RecordBatch]):
            for b in batches:
                own = b[len(keys)].fill_null("").dictionary_encode()
                each = runs([pa.RecordBatch.from_arrays([own.dictionary], ["s"])], 0, self.run_bytes)
                made = pa.array([x for part in each for x in self.score(part[0].to_pylist(), reduction)], pa.float64())
                yield pa.RecordBatch.from_arrays([*(b[i] for i in range(len(keys))), made.take(own.indices)], names=[*keys, "score"])

        kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
        return df.select(*keys, seq).mapInArrow(run, f"{kinds}, score double")

    def _vectors(self, seqs: list[str], layers: str, pool: str) -> np.ndarray:
        if pool not in self.pools:
            raise Unsupported(f"{self.name} does not pool by {pool}; it does by {', '.join(self.pools)}")
        return self.embed(seqs, layers) if pool == "mean" else self.embed(seqs, layers, pool)

    def outputs(self, df: DataFrame, keys: list[str], seq: str, layers: str = "last", pool: str = "mean", heads: tuple[str, ...] = ("vectors",)) -> DataFrame:
        """keys, head, layer_id, vec of runs of the model over slices of each Arrow batch: a row "vectors" for each layer,
        a row "logprobs" with a number for each letter. Both heads together take a model that ``fuses``."""
        both = len(heads) == 2
        for head in heads:
            self.require({"vectors": "embed", "logprobs": "per_token"}[head])
        if both and not self.fuses:
            raise Unsupported(f"{self.name} has no pass of both heads")
        if pool not in self.pools:
            raise Unsupported(f"{self.name} does not pool by {pool}; it does by {', '.join(self.pools)}")
        own = [df.schema[k] for k in keys]

        def run(batches):
            for b in runs(batches, len(keys), self.run_bytes):
                seqs = [s or "" for s in b[len(keys)].to_pylist()]
                x, z = self.embed_with_logprobs(seqs, layers, pool) if both else (self._vectors(seqs, layers, pool), None) if "vectors" in heads else (None, self.per_token(seqs))
                if x is not None:
                    x = np.asarray(x, np.float64)
                    if len(x) != b.num_rows or np.isnan(x).any():
                        raise ValueError(f"{self.name}: embeddings must be as many as sequences and hold no NaN")
                    n, m, w = x.shape
                    first = 0 if layers == "all" else (self.n_layers or 1) - 1
                    rows = pa.array(np.repeat(np.arange(n), m))
                    yield _batch(b, keys, rows, "vectors", np.tile(np.arange(m) + first, n), pa.ListArray.from_arrays(pa.array(np.arange(n * m + 1, dtype=np.int32) * w), pa.array(x.ravel())))
                if z is not None:
                    sizes, flat = [len(a) for a in z], np.concatenate([np.asarray(a, np.float64) for a in z])
                    if sizes != [len(s) for s in seqs] or not np.isfinite(flat).all():
                        raise ValueError(f"{self.name}: log-probabilities must be one finite number for each letter")
                    yield _batch(b, keys, pa.array(range(b.num_rows)), "logprobs", None, pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), pa.array(flat)))

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own)
        return df.select(*keys, seq).mapInArrow(run, f"{schema}, head string, layer_id int, vec array<double>")

    def sparse_outputs(self, df: DataFrame, keys: list[str], seq: str) -> DataFrame:
        """keys, head, layer_id, vec of the last layer, vec as ``vectors.SPARSE``: its bytes follow the numbers that are not 0."""
        self.require("embed")
        own, last = [df.schema[k] for k in keys], (self.n_layers or 1) - 1

        def run(batches):
            for b in runs(batches, len(keys), self.run_bytes):
                width, rows = self.embed_sparse([s or "" for s in b[len(keys)].to_pylist()])
                if any(np.isnan(x).any() for _, x in rows):
                    raise ValueError(f"{self.name}: embeddings must hold no NaN")
                yield _batch(b, keys, pa.array(range(b.num_rows)), "vectors", np.full(b.num_rows, last), sparse_array(width, rows))

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own)
        return df.select(*keys, seq).mapInArrow(run, f"{schema}, head string, layer_id int, vec {SPARSE}")

    def embeddings(self, df: DataFrame, key: str, seq: str, layers: str = "last", pool: str = "mean") -> DataFrame:
        """key, layer_id, vec: one row for each item and layer."""
        return self.outputs(df, [key], seq, layers, pool).select(key, "layer_id", "vec")

    def variant_llrs(self, df: DataFrame, key: str) -> DataFrame:
        """key and the sum over a variant's mutations of the log-odds of its sites; the model sees each
        distinct (reference, place) once, then its logits are joined back. To 12 places, so that equal sums tie
        whatever their order."""
        self.require("variant_llr")
        sites = exploded(df, key).select(key, "ref", "reference", "m.pos0", "m.wt", "m.mut")

        def run(batches):
            for b in batches:
                own = [self.site_logits(*row) for row in zip(b["reference"].to_pylist(), b["pos0"].to_pylist())]
                yield pa.RecordBatch.from_arrays([b["ref"], b["pos0"], pa.array(own, pa.list_(pa.float64()))], names=["ref", "pos0", "logits"])

        # a site is known by its reference's hash: whole references travel once a reference and place, to the model
        each = sites.select("ref", "pos0", "reference").distinct()
        # written once, so that the join knows its size: few sites are sent to all tasks, many are dealt by site
        scored = written(each.mapInArrow(run, "ref string, pos0 int, logits array<double>"), "sites")
        joined = sites.drop("reference").join(scored, ["ref", "pos0"]).withColumn("wt_logit", F.expr(f"element_at(logits, instr('{BASES}', wt))")).withColumn("mut_logit", F.expr(f"element_at(logits, instr('{BASES}', mut))"))
        return joined.groupBy(key).agg(F.round(F.sum(F.col("mut_logit") - F.col("wt_logit")), 12).alias("llr"))

    def tokens(self, df: DataFrame, key: str, seq: str) -> DataFrame:
        """key, tokens: the numbers of each sequence's tokens."""
        self.require("tokenize")
        return self._lists(df, key, seq, self.tokenize, "tokens", pa.int32(), "int")

    def logprobs(self, df: DataFrame, key: str, seq: str, one_a_letter: bool = False) -> DataFrame:
        """key, logprobs: of each token; with ``one_a_letter`` another number of them than letters raises."""
        self.require("per_token")

        def checked(seqs):
            out = self.per_token(seqs)
            if one_a_letter and [len(z) for z in out] != [len(s) for s in seqs]:
                raise ValueError(f"{self.name}: log-probabilities must be one for each letter")
            return out

        return self._lists(df, key, seq, checked, "logprobs", pa.float64(), "double")

    def _lists(self, df, key, seq, make, name, arrow, kind):
        def run(batches):
            for b in runs(batches, 1, self.run_bytes):
                yield pa.RecordBatch.from_arrays([b[0], pa.array(make([s or "" for s in b[1].to_pylist()]), pa.list_(arrow))], names=["key", name])

        return df.select(key, seq).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, {name} array<{kind}>").withColumnRenamed("key", key)


def _batch(b: pa.RecordBatch, keys: list[str], rows: pa.Array, head: str, layers, vec: pa.Array) -> pa.RecordBatch:
    layer = pa.nulls(len(rows), pa.int32()) if layers is None else pa.array(layers.astype(np.int32))
    return pa.RecordBatch.from_arrays([*(b[i].take(rows) for i in range(len(keys))), pa.array([head] * len(rows)), layer, vec], names=[*keys, "head", "layer_id", "vec"])


class EchoModel(SequenceModel):
    """A deterministic stand-in: all it returns follows from the bytes of its input."""

    name = "echo"
    capabilities = frozenset(CAPABILITIES)
    n_layers = 2

    def tokenize(self, seqs):
        return [list(s.encode()) for s in seqs]

    def per_token(self, seqs):
        return [[features.echo_value(b) for b in s.encode()] for s in seqs]

    def score(self, seqs, reduction="mean"):
        sums = [(sum(z), len(z)) for z in self.per_token(seqs)]
        return [round(t / n if reduction == "mean" and n else t, 12) for t, n in sums]

    def site_logits(self, reference, pos0):
        return [features.echo_logit(reference, pos0, base) for base in BASES]

    def embed(self, seqs, layers="last"):
        n = self.n_layers if layers == "all" else 1
        return np.stack([features.echo_embedding(s, n) for s in seqs])

    def embed_with_logprobs(self, seqs, layers="last", pool="mean"):
        return self.embed(seqs, layers), self.per_token(seqs)


class KmerModel(SequenceModel):
    """Composition only: every layer has the frequencies of k-mers."""

    capabilities = frozenset({"embed"})

    def __init__(self, k: int = 3, n_layers: int = 0):
        self.k, self.n_layers, self.name = k, n_layers + 1, f"kmer{k}"
        self.sparse = k > 3  # a sequence has as many k-mers as letters at most

    def embed(self, seqs, layers="last"):
        rows = [np.bincount(features.kmer_index(s.encode(), self.k), minlength=4**self.k) for s in seqs]
        vec = np.stack([c / max(1, c.sum()) for c in rows])
        return np.repeat(vec[:, None, :], self.n_layers if layers == "all" else 1, axis=1)

    def embed_sparse(self, seqs):
        found = [np.unique(features.kmer_index(s.encode(), self.k), return_counts=True) for s in seqs]
        return 4**self.k, [(at, n / max(1, n.sum())) for at, n in found]


class Registry:
    """Named things of a few kinds; a name twice or unknown raises."""

    def __init__(self):
        self._held: dict[tuple[str, str], object] = {}

    def add(self, kind: str, name: str, thing: object) -> object:
        if (kind, name) in self._held:
            raise ValueError(f"{kind} {name!r} is registered already")
        self._held[kind, name] = thing
        return thing

    def get(self, kind: str, name: str):
        if (kind, name) not in self._held:
            raise KeyError(f"no {kind} {name!r}; there are {', '.join(self.names(kind)) or 'none'}")
        return self._held[kind, name]

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self._held if k == kind)


registry = Registry()
registry.add("model", "echo", EchoModel)
registry.add("model", "kmer", KmerModel)


def _numbered(widths, token_budget: int | None, batch_size: int | None, held: int = 0) -> tuple[np.ndarray, int, int]:
    """Numbers of the batches of ascending widths, the last number, and how many rows that batch holds.

    ``held``: rows that batch 0 has already. Rows times the widest must stay within the budget; as both
    only grow along a batch, its end is found by bisection."""
    numbers, number, at = np.zeros(len(widths), np.int64), 0, 0
    while at < len(widths):
        most = len(widths) - at if batch_size is None else min(len(widths) - at, batch_size - held)
        fit = most if token_budget is None else bisect_right(range(1, most + 1), token_budget, key=lambda r, at=at, held=held: (held + r) * int(widths[at + r - 1]))
        fit = max(fit, 0 if held else 1)  # what is over the budget is alone
        numbers[at : at + fit] = number
        at, held = at + fit, held + fit
        if at < len(widths):
            number, held = number + 1, 0
    return numbers, number, held


def padded_lengths(lengths: np.ndarray, multiple: int) -> np.ndarray:
    """The next multiple that holds each length, one at least."""
    return np.maximum(1, -(-np.asarray(lengths, np.int64) // multiple)) * multiple


def length_batches(lengths: list[int], token_budget: int | None = None, batch_size: int | None = None, padded=lambda n: n) -> list[list[int]]:
    """Batches of positions, short sequences first, each within the budget of padded tokens and the size;
    a sequence over the budget is alone."""
    if token_budget is None and batch_size is None:
        raise ValueError("a token budget or a batch size is needed")
    order = np.argsort(np.asarray(lengths, np.int64), kind="stable")
    numbers, *_ = _numbered([padded(lengths[i]) for i in order], token_budget, batch_size)
    return [part.tolist() for part in np.split(order, np.flatnonzero(np.diff(numbers)) + 1)] if len(order) else []


def batched(df: DataFrame, key: str, seq: str, token_budget: int | None, groups: int | None = None, batch_size: int | None = None, multiple: int | None = None) -> DataFrame:
    """key, length, batch: rows dealt to tasks by length and sorted there, then batched as they stream by;
    as many tasks as the session shuffles to, unless ``groups`` says otherwise.

    With ``multiple`` a batch holds sequences of one padded length only, so that a network without a mask gives
    each the same whatever its company."""

    def run(batches):
        from pyspark import TaskContext

        number, held, width = TaskContext.get().partitionId() << 32, 0, -1
        for b in batches:
            lengths = b[1].to_numpy()
            if multiple is None:
                numbers, last, held = _numbered(lengths, token_budget, batch_size, held)
            else:
                padded = padded_lengths(lengths, multiple)
                parts, last = [], 0
                for own in np.split(padded, np.flatnonzero(np.diff(padded)) + 1) if len(padded) else []:
                    if held and own[0] != width:
                        last, held = last + 1, 0
                    width = own[0]
                    part, more, held = _numbered(own, token_budget, batch_size, held)
                    parts.append(part + last)
                    last += more
                numbers = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b[0], b[1], pa.array(number + numbers)], names=["key", "length", "batch"])
            number += last

    kind = df.schema[key].dataType.simpleString()
    groups = groups or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = df.select(key, F.coalesce(F.length(seq), F.lit(0)).cast("long").alias("length")).repartitionByRange(groups, "length").sortWithinPartitions("length")
    return sized.mapInArrow(run, f"key {kind}, length long, batch long").withColumnRenamed("key", key)
