"""Model outputs by the content that they were made of, shared by the tasks of a run.

A pass runs a model over the windows of a corpus. What a pass gives is known by a hash of the windows
themselves, with their items and places, and by the pooling, never by the corpus' name: two tasks that cut one
corpus differently get outputs of their own, two that cut it alike share one pass.

The plan says what the pending tasks of a corpus will ask for: the last layer or all, log-probabilities or
not. The first pass makes the widest of it, both heads at once if the model has them in one pass; where a
wider reader comes that nobody had planned, the pass is made again in its width and replaces the narrower one.
Outputs are written tables, so that readers share them and a lost executor costs no pass; they go after the
corpus' last reader, unless they are kept in a folder, where a later run finds them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dropped, written
from . import vectors


@dataclass
class Demand:
    """What the pending tasks of one corpus ask for."""

    vectors: int = 0
    logprobs: int = 0
    all_layers: bool = False


def plan(tasks: list) -> dict[str, Demand]:
    """The demand of each corpus; tasks without a corpus share nothing."""
    out: dict[str, Demand] = {}
    for t in tasks:
        if getattr(t, "corpus", None) is None:
            continue
        own = out.setdefault(t.corpus, Demand())
        if getattr(t, "head", "vectors") == "logprobs":
            own.logprobs += 1
        else:
            own.vectors += 1
            own.all_layers |= getattr(t, "layers", "last") == "all"
    return out


def content_key(windows: DataFrame, key: str) -> str:
    """A hash of all (item, place, window), whatever their order: their number and two sums of 64-bit hashes."""
    row = F.coalesce("window", F.lit("")), F.col("window").isNull()
    sums = [F.sum(F.xxhash64(*c).cast("decimal(20,0)")).alias(n) for n, c in (("a", (key, "at", *row)), ("b", (*row, "at", F.lit(1), key)))]
    found = windows.agg(F.count(F.lit(1)).alias("n"), *sums)
    return found.select(F.substring(F.sha2(F.concat_ws("|", "n", "a", "b"), 256), 1, 24).alias("k")).first().k


def pick_layers(there: list[int], layers: str | int | list[int] | None) -> list[int]:
    """Which of the layers are meant by all, last, a number or a list; one that is not there raises."""
    if layers in (None, "all"):
        return list(there)
    wanted = [-1] if layers == "last" else [layers] if isinstance(layers, int) else [int(x) for x in (layers.split(",") if isinstance(layers, str) else layers)]
    found = [there[k] if k < 0 and -k <= len(there) else k for k in wanted]
    if absent := [k for k in found if k not in there]:
        raise KeyError(f"no layer {', '.join(map(str, absent))}; there are {', '.join(map(str, there))}")
    return found


class Reuse:
    """Outputs of one model. ``passes`` counts what was run: (content, heads, layers) of each."""

    def __init__(self, demands: dict[str, Demand], identity: str = "model", keep: str | None = None):
        self.demands, self.identity, self.keep = demands, identity.replace(":", "_").replace("/", "_"), keep
        self.left = {c: d.vectors + d.logprobs for c, d in demands.items()}
        self.vectors_of: dict[tuple[str, str], tuple[DataFrame, list[int], bool]] = {}
        self.logprobs_of: dict[str, DataFrame] = {}
        self.used: dict[str, set[str]] = {}
        self.keys: dict[str, list[tuple[DataFrame, str]]] = {}
        self.passes: list[tuple[str, tuple[str, ...], str]] = []

    def vectors(self, corpus: str, model, windows: DataFrame, items: DataFrame, key: str, layers: str | int | list[int] = "last", pool: str = "mean") -> DataFrame:
        """key, layer_id, vec: each item's mean over its windows, one for each item and layer, without NaN.

        windows: key, at, window; items: a row for each key."""
        content, demand = self._content(corpus, windows, key), self.demands.get(corpus, Demand())
        held = self.vectors_of.get((content, pool))
        if held is None or (layers != "last" and not held[2]):
            wide = layers != "last" or demand.all_layers
            both = demand.logprobs > 0 and content not in self.logprobs_of and model.fuses
            self._run(content, model, windows, items, key, wide, pool, ("vectors", "logprobs") if both else ("vectors",))
            held = self.vectors_of[content, pool]
        table, there, _ = held
        return table.where(F.col("layer_id").isin(pick_layers(there, layers)))

    def logprobs(self, corpus: str, model, windows: DataFrame, items: DataFrame, key: str) -> DataFrame:
        """key, at, vec: the log-probabilities of each window's letters."""
        content, demand = self._content(corpus, windows, key), self.demands.get(corpus, Demand())
        if content not in self.logprobs_of:
            both = demand.vectors > 0 and (content, "mean") not in self.vectors_of and model.fuses
            self._run(content, model, windows, items, key, demand.all_layers, "mean", ("vectors", "logprobs") if both else ("logprobs",))
        return self.logprobs_of[content]

    def release(self, corpus: str) -> None:
        """A reader of the corpus is done; after the last one its outputs go, but for those that another still reads."""
        self.left[corpus] = self.left.get(corpus, 1) - 1
        if self.left[corpus] > 0:
            return
        self.keys.pop(corpus, None)
        gone = self.used.pop(corpus, set()) - set().union(*self.used.values())
        for own in [k for k in self.vectors_of if k[0] in gone]:
            self._drop(self.vectors_of.pop(own)[0])
        for own in [k for k in self.logprobs_of if k in gone]:
            self._drop(self.logprobs_of.pop(own))

    def _content(self, corpus: str, windows: DataFrame, key: str) -> str:
        held = self.keys.setdefault(corpus, [])
        own = windows.select(key, "at", "window")
        # one plan over one corpus has one content: it is not read again for its hash
        content = next((c for df, c in held if df.sameSemantics(own)), None)
        if content is None:
            content = content_key(own, key)
            held.append((own, content))
        self.used.setdefault(corpus, set()).add(content)
        return content

    def _drop(self, table: DataFrame) -> None:
        if self.keep is None:
            dropped(table)

    def _table(self, df: DataFrame, *name: str, by: list[str] | None = None) -> DataFrame:
        own = "-".join((self.identity, *name))
        return written(df, own, by, self.keep and f"{self.keep}/{own}")

    def _run(self, content: str, model, windows: DataFrame, items: DataFrame, key: str, wide: bool, pool: str, heads: tuple[str, ...]) -> None:
        width = "all" if wide else "last"
        self.passes.append((content, heads, width))
        sparse = model.sparse and not wide and pool == "mean" and heads == ("vectors",)
        cut = windows.select(key, "at", "window")
        out = model.sparse_outputs(cut, [key, "at"], "window") if sparse else model.outputs(cut, [key, "at"], "window", width, pool, heads)
        if "logprobs" in heads:
            out = self._table(out, content, pool, width, *heads, by=["head"])
            z = out.where("head = 'logprobs'").select(key, "at", "vec")
            z.table_path = out.table_path
            self.logprobs_of[content] = z
        if "vectors" not in heads:
            return
        pooled = vectors.window_mean(out.where("head = 'vectors'"), [key, "layer_id"])
        pooled = self._table(pooled, content, pool, width, *["sparse"] * sparse, "pooled", by=["layer_id"])
        layers = vectors.check_layers(pooled, items, key)
        older = self.vectors_of.get((content, pool))
        self.vectors_of[content, pool] = pooled, layers, wide
        if older is not None:
            self._drop(older[0])
