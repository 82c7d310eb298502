from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from seqforge import tokens
from seqforge.models import BASES, Unsupported, batched
from seqforge.operators import tensors, vectors
from seqforge.plans.catalogue import CodeKmerModel, HalvingModel, WordModel

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not see the tests' modules


class Masked(tokens.KmerTokenModel):
    """Logits that depend on the reference around the masked tokens, the tokens and how many they are."""

    name, k, shift = "masked", 4, 1

    def __init__(self, calls=None):
        self.calls = calls

    def number(self, kmer):
        found = super().number(kmer)
        return None if found is not None and found % 11 == 5 else found

    def set_logits(self, reference, masked, wanted):
        if self.calls is not None:
            self.calls.add(1)
        lo, hi = masked[0] * self.shift, masked[-1] * self.shift + self.k
        context = sum(map(ord, reference[:lo])) - sum(map(ord, reference[hi:]))
        return [[((x * 31 + context * 7 + j * 13) % 97) / 10.0 - len(masked) for x in row] for j, row in zip(masked, wanted)]


def plain_llr(model, reference, mutations):
    """The rule in words: mask all tokens over a site, take mutant less reference k-mers, skip the unknown ones."""
    total, unknown = 0.0, 0
    n = (len(reference) - model.k) // model.shift + 1
    for p, _, mut in mutations:
        own = [j for j in range(n) if j * model.shift <= p < j * model.shift + model.k]
        changed = reference[:p] + mut + reference[p + 1 :]
        for j in own:
            a, b = (model.number(s[j * model.shift : j * model.shift + model.k]) for s in (reference, changed))
            if a is None or b is None:
                unknown += 1
                continue
            logits = model.set_logits(reference, own, [[b, a]] * len(own))[own.index(j)]
            total += logits[0] - logits[1]
    return round(total, 9), unknown


def test_token_sets_against_the_rule(spark):
    rng = np.random.default_rng(1)
    references = ["".join(rng.choice(list("ACGT"), n)) for n in (4, 9, 30)] + ["ACGNNACGTACCGTAA"]
    rows = []
    for i in range(60):
        ref = references[i % 4]
        at = sorted(rng.choice(len(ref), rng.integers(1, 4), replace=False).tolist())
        rows.append((i, ref, [(p, ref[p] if ref[p] in BASES else "A", str(rng.choice([c for c in BASES if c != ref[p]]))) for p in at]))
    df = spark.createDataFrame(rows, "k int, reference string, mutations array<struct<pos0:int,wt:string,mut:string>>")
    model = Masked()
    got = {r.k: (round(r.llr, 9), r.n_unknown) for r in model.token_set_llrs(df, "k").collect()}
    want = {k: plain_llr(model, ref, muts) for k, ref, muts in rows}
    assert got == want and any(u for _, u in want.values())


def test_one_run_a_reference_and_place(spark):
    calls = spark.sparkContext.accumulator(0)
    rows = [(i, "ACGTACGTAC", [(3, "T", "ACG"[i % 3]), (i % 2 + 5, "C", "A")]) for i in range(30)]
    df = spark.createDataFrame(rows, "k int, reference string, mutations array<struct<pos0:int,wt:string,mut:string>>")
    Masked(calls).token_set_llrs(df, "k").collect()
    assert calls.value == 3
    with pytest.raises(Exception, match="no token covers place"):
        Masked().token_set_llrs(spark.createDataFrame([(1, "ACG", [(1, "C", "A")])], df.schema), "k").collect()
    with pytest.raises(Unsupported):
        tokens.KmerTokenModel().set_logits("A", [0], [[0]])
    assert Masked().token_set_llrs(df.where("false"), "k").count() == 0


def test_pooling_with_special_tokens():
    states, spans = np.arange(12.0).reshape(4, 1, 3), np.zeros((4, 2))
    t = tokens.Tokens(states, np.array([True, False, False, True]), spans)
    assert tokens.pooled(t, "mean").tolist() == states[1:3].mean(axis=0).tolist() and tokens.pooled(t, "last").tolist() == states[2].tolist()
    assert tokens.pooled(t, "max").tolist() == states[2].tolist() and tokens.pooled(t, "bos").tolist() == states[0].tolist()
    assert tokens.pooled(t, "mean", True).tolist() == states.mean(axis=0).tolist()
    only = tokens.Tokens(states, np.ones(4, bool), spans)
    assert tokens.pooled(only, "last").tolist() == states[3].tolist()


def test_models_pool_as_the_operator_does(spark):
    df = spark.createDataFrame([(0, "ACGTACG"), (1, "A"), (2, "")], "id int, s string")
    model = WordModel()
    rows = []
    for i, s in ((0, "ACGTACG"), (1, "A"), (2, "")):
        (t,) = model.run_tokens([s], "last")
        rows += [(i, k, bool(t.special[k]), t.states[k, 0].tolist()) for k in range(len(t.special))]
    long = spark.createDataFrame(rows, "id int, token int, special boolean, vec array<double>")
    for how in ("mean", "max", "last", "bos"):
        own = {r.id: r.vec for r in model.embeddings(df, "id", "s", pool=how).collect()}
        assert own == {r.id: r.vec for r in vectors.pool(long, ["id"], "token", how, special="special").collect()}, how
        model.include_special = True
        wide = {r.id: r.vec for r in model.embeddings(df, "id", "s", pool=how).collect()}
        assert wide == {r.id: r.vec for r in vectors.pool(long, ["id"], "token", how, special="special", include_special=True).collect()}
        model.include_special = False
    assert vectors.pool(long, ["id"], "token", "none", special="special").count() == sum(not r[2] for r in rows)
    got = sorted((r.id, r.token, r.start, r.end) for r in model.token_vectors(df, "id", "s").collect())
    assert got == [(0, 0, 0, 2), (0, 1, 2, 5), (0, 2, 5, 6), (0, 3, 6, 7), (1, 0, 0, 1)] or [x[2:] for x in got if x[0] == 0][-1][1] == 7
    with pytest.raises(Unsupported):
        model.embeddings(df, "id", "s", pool="none")


def test_spans_of_pieces_and_their_letters(spark):
    pieces = [["<s>", "ab", "c", "</s>"], [], None, ["", "漢字", "x"]]
    special = [[True, False, False, True], [], None, [False] * 3]
    df = spark.createDataFrame([(i, p, s, [10.0 * (k + 1) for k in range(len(p or []))]) for i, (p, s) in enumerate(zip(pieces, special))], "id int, pieces array<string>, special array<boolean>, v array<double>")
    got = {r.id: [tuple(x) for x in r.spans] for r in tensors.piece_spans(df, "id", "pieces", "special").collect()}
    assert got == {0: [(0, 0), (0, 2), (2, 3), (0, 0)], 1: [], 2: [], 3: [(0, 0), (0, 2), (2, 3)]}
    assert got[0] == [tuple(x) for x in tokens.spans_of(pieces[0], np.array(special[0])).tolist()]
    both = tensors.piece_spans(df, "id", "pieces", "special").join(df, "id")
    letters = sorted((r.id, r.pos, r.value) for r in tensors.spread(both, ["id"], "spans", "v").collect())
    assert letters == [(0, 0, 20.0), (0, 1, 20.0), (0, 2, 30.0), (3, 0, 20.0), (3, 1, 20.0), (3, 2, 30.0)]


def test_mixed_resolutions(spark):
    seqs = ["A" * n for n in (1, 7, 8, 9, 16, 17, 40)] + ["ACGTACGTACGTACGTTTT", ""]
    df = spark.createDataFrame(list(enumerate(seqs)), "id int, s string")
    model = HalvingModel()
    got = {(r.id, r.layer_id): r.vec[0] for r in model.embeddings(df, "id", "s", "all").collect()}
    for i, s in enumerate(seqs):
        padded = max(1, -(-len(s) // 16)) * 16
        for layer, f in enumerate((1, 2, 8)):
            x = [sum(map(ord, s[j * f : (j + 1) * f])) for j in range(padded // f)]
            real = min(max(-(-len(s) // f), 1), len(x))
            assert got[i, layer] == pytest.approx(np.mean(x[:real])), (i, layer)
            places = spark.createDataFrame([(len(s), padded, [[float(v)] for v in x])], "n int, padded int, states array<array<double>>")
            for how, of in (("mean", np.mean), ("max", np.max), ("last", lambda v: v[-1])):
                assert places.select(tensors.pool_places(F.col("states"), F.col("n"), F.col("padded"), how).alias("v")).first().v == pytest.approx([of(x[:real])])
            assert places.select(tensors.pool_places(F.col("states"), F.col("n"), F.col("padded"), include_special=True).alias("v")).first().v == pytest.approx([np.mean(x)])
    last = sorted((r.id, r.token, r.start, r.end) for r in model.token_vectors(df, "id", "s").collect())
    assert [x[1:] for x in last if x[0] == 5] == [(0, 0, 8), (1, 8, 16), (2, 16, 17)]
    with pytest.raises(Exception, match="no common tokens"):
        model.token_vectors(df, "id", "s", "all").collect()


def test_all_poolings_of_one_run(spark):
    """The network runs once for all poolings, on bounded parts of a batch, and each is what a run of its own gives."""
    calls = spark.sparkContext.accumulator(0)

    class Watched(HalvingModel):
        run_bytes = 100

        def run_padded(self, seqs, padded):
            calls.add(len(seqs) if len(seqs) == 1 or sum(map(len, seqs)) <= self.run_bytes else 10**6)
            return super().run_padded(seqs, padded)

    df = spark.createDataFrame([(i, None if i == 3 else "ACGTN" * (i % 7) + "G" * (i // 5)) for i in range(60)], "id int, s string").coalesce(1)
    got = {(r.id, r.layer_id): (r["mean"], r["max"], r["last"]) for r in Watched().pooled(df, "id", "s", "all").collect()}
    assert calls.value == 60 and len(got) == 180
    for i, how in enumerate(("mean", "max", "last")):
        assert {(r.id, r.layer_id): r.vec for r in HalvingModel().embeddings(df, "id", "s", "all", how).collect()} == {k: v[i] for k, v in got.items()}
    with pytest.raises(Unsupported):
        HalvingModel().pooled(df, "id", "s", pools=("mean", "bos"))


def test_token_vectors_in_few_batches(spark, monkeypatch):
    """Tokens of many sequences share a batch, and no batch holds more than a bound but for one sequence's own."""
    made = []
    df = spark.createDataFrame([(i, None if i == 3 else "ACGTN" * (i % 7)) for i in range(60)], "id int, s string").coalesce(1)
    batch = [pa.RecordBatch.from_pydict({"id": [r.id for r in df.collect()], "s": [r.s for r in df.collect()]})]

    class Direct:
        schema = df.schema
        select = lambda self, *c: self
        withColumnRenamed = lambda self, *c: made

        def mapInArrow(self, run, schema):
            made[:] = list(run(batch))
            return self

    WordModel().token_vectors(Direct(), "id", "s")
    assert len(made) == 1
    whole = made[0].to_pylist()
    monkeypatch.setattr(tokens, "STATES", 100)
    WordModel().token_vectors(Direct(), "id", "s")
    assert len(made) > 5 and max(b.num_rows for b in made) < 100 and [r for b in made for r in b.to_pylist()] == whole
    text = {r["id"]: r["s"] or "" for r in batch[0].to_pylist()}
    pieces = {}
    for r in whole:
        assert r["vec"] == [float(sum(map(ord, text[r["key"]][r["start"] : r["end"]]))), r["end"] - r["start"]]
        assert r["token"] == len(pieces.setdefault(r["key"], [])) and r["layer_id"] == 0
        pieces[r["key"]].append(text[r["key"]][r["start"] : r["end"]])
    assert all("".join(pieces.get(i, [])) == s and all(len(p) == k % 3 + 1 for k, p in enumerate(pieces.get(i, [])[:-1])) for i, s in text.items())


def test_batches_of_one_padded_length(spark):
    rng = np.random.default_rng(2)
    lengths = rng.integers(0, 70, 300).tolist()
    df = spark.createDataFrame([(i, "A" * n) for i, n in enumerate(lengths)], "id int, s string").repartition(3)
    rows = batched(df, "id", "s", None, batch_size=7, multiple=16).collect()
    assert sorted(r.id for r in rows) == list(range(300))
    by = {}
    for r in rows:
        by.setdefault(r.batch, []).append(max(1, -(-r.length // 16)) * 16)
    assert all(len(set(x)) == 1 and len(x) <= 7 for x in by.values())
    whole = batched(df, "id", "s", None, groups=1, batch_size=7, multiple=16).collect()
    padded = np.array([max(1, -(-n // 16)) for n in lengths])
    assert len({r.batch for r in whole}) == sum(-(-int((padded == k).sum()) // 7) for k in np.unique(padded))


def test_unknown_kmers():
    model = CodeKmerModel()
    assert model.number("ACN") is None and model.number("AAT") is None and model.number("AAA") == 0
