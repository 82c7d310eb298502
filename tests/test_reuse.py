from __future__ import annotations

import os
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from seqforge.functions.sequences import affected_tokens, normalize
from seqforge.models import EchoModel, KmerModel, SequenceModel, Unsupported
from seqforge.operators import control, reuse, vectors
from seqforge.plans import stand_ins, tasks
from seqforge.plans.catalogue import CountedModel
from seqforge.sources.shared import complete

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not see the tests' modules


class Counted(SequenceModel):
    """Counts the sequences of each run of its heads."""

    name, n_layers = "counted", 2
    capabilities = frozenset({"embed", "per_token"})

    def __init__(self, spark):
        self.embedded, self.scored, self.both = (spark.sparkContext.accumulator(0) for _ in range(3))

    def _embed(self, seqs, layers):
        x = np.array([[[len(s)], [s.count("A")]] for s in seqs], float)
        return x if layers == "all" else x[:, 1:]

    def embed(self, seqs, layers="last"):
        self.embedded.add(len(seqs))
        return self._embed(seqs, layers)

    def per_token(self, seqs):
        self.scored.add(len(seqs))
        return [[-1.0 - (c == "A") for c in s] for s in seqs]


class Fused(Counted):
    def embed_with_logprobs(self, seqs, layers="last", pool="mean"):
        self.both.add(len(seqs))
        return self._embed(seqs, layers), [[-1.0 - (c == "A") for c in s] for s in seqs]


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(i, "ACGT" * (i % 5 + 1) + "A" * (i % 3)) for i in range(20)], "item int, seq string")


def windows(items, width=None):
    return items.select("item", F.posexplode(F.array("seq") if width is None else F.array(F.substring("seq", 1, width))).alias("at", "window"))


def pairs(df):
    return sorted((r.item, r.layer_id, tuple(r.vec)) for r in df.collect())


def test_one_pass_of_both_heads(spark, items):
    model = Fused(spark)
    held = reuse.Reuse({"c": reuse.Demand(vectors=2, logprobs=1, all_layers=True)})
    last = pairs(held.vectors("c", model, windows(items), items, "item"))
    every = pairs(held.vectors("c", model, windows(items), items, "item", "all"))
    z = {r.item: r.vec for r in held.logprobs("c", model, windows(items), items, "item").collect()}
    rows = {r.item: r.seq for r in items.collect()}
    assert [p for p in every if p[1] == 1] == last and len(every) == 40
    assert all(z[i] == [-1.0 - (c == "A") for c in s] for i, s in rows.items())
    assert (model.both.value, model.embedded.value, model.scored.value) == (20, 0, 0)
    assert [(h, w) for _, h, w in held.passes] == [(("vectors", "logprobs"), "all")]


def test_a_run_is_given_a_bounded_part_of_a_batch(spark):
    """What a task holds follows the slice, not the batch; the outputs are those of one run."""
    most = spark.sparkContext.accumulator(0)

    class Watched(Fused):
        run_bytes = 1000

        def embed_with_logprobs(self, seqs, layers="last", pool="mean"):
            if len(seqs) > 1 and sum(map(len, seqs)) > self.run_bytes:
                most.add(1)
            return super().embed_with_logprobs(seqs, layers, pool)

    rows = [(i, None if i == 5 else "ACGT" * (i % 7) + "A" * (2500 if i == 9 else 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "item int, seq string").coalesce(1)
    model = Watched(spark)
    out = model.outputs(df, ["item"], "seq", "all", heads=("vectors", "logprobs")).collect()
    assert most.value == 0 and model.both.value == 400 and len(out) == 1200
    z = {r.item: r.vec for r in out if r.head == "logprobs"}
    assert all(z[i] == [-1.0 - (c == "A") for c in s or ""] for i, s in rows)
    assert {(r.item, r.layer_id): r.vec for r in out if r.head == "vectors"} == {(i, k): [float(len(s or "") if k == 0 else (s or "").count("A"))] for i, s in rows for k in (0, 1)}


def test_equal_means_tie(spark):
    """Sequences of one composition have one mean log-probability, whatever their order and number of letters."""
    seqs = ["ACGTN" * 200, "NTGCA" * 200, "A" * 500 + "C" * 500 + "G" * 500 + "T" * 500 + "N" * 500, "ACGTN"]
    rows = [(i, seqs[i % 4], f"g{i % 2}", i // 2 % 2, "test") for i in range(16)]
    genes = spark.createDataFrame(rows, "doc_id int, seq string, genome string, essential int, split string")
    (task,) = control.run_tasks(CountedModel(spark.sparkContext.accumulator(0)), [tasks.LikelihoodTask("z", lambda s: genes)], spark)["tasks"]
    assert task["status"] == "ok" and task["metrics"]["mean_auroc"] == 0.5, task


def test_logprobs_first_serve_vectors_too(spark, items):
    model = Fused(spark)
    held = reuse.Reuse({"c": reuse.Demand(vectors=1, logprobs=1)})
    held.logprobs("c", model, windows(items), items, "item").count()
    assert len(pairs(held.vectors("c", model, windows(items), items, "item"))) == 20 and model.both.value == 20


def test_a_model_of_one_head_at_a_time_runs_twice(spark, items):
    model = Counted(spark)
    held = reuse.Reuse({"c": reuse.Demand(vectors=1, logprobs=1)})
    held.vectors("c", model, windows(items), items, "item").count()
    held.logprobs("c", model, windows(items), items, "item").count()
    assert (model.both.value, model.embedded.value, model.scored.value) == (0, 20, 20) and not model.fuses
    with pytest.raises(Unsupported):
        model.outputs(windows(items), ["item"], "window", heads=("vectors", "logprobs"))


def test_a_pass_is_known_by_its_windows_not_by_its_name(spark, items):
    model = Counted(spark)
    held = reuse.Reuse({"c": reuse.Demand(vectors=3), "other": reuse.Demand(vectors=1)})
    whole = pairs(held.vectors("c", model, windows(items), items, "item"))
    short = pairs(held.vectors("c", model, windows(items, 3), items, "item"))
    again = pairs(held.vectors("other", model, windows(items.repartition(5)), items, "item"))
    assert whole != short and whole == again and model.embedded.value == 40 and len(held.passes) == 2


def test_one_plan_of_a_corpus_is_hashed_once(spark, items, monkeypatch):
    hashed = []
    monkeypatch.setattr(reuse, "content_key", lambda w, key, of=reuse.content_key: hashed.append(of(w, key)) or hashed[-1])
    held = reuse.Reuse({"c": reuse.Demand(vectors=3)})
    for width in (None, 3, None, 3):
        held.vectors("c", Counted(spark), windows(items, width), items, "item")
    assert len(hashed) == len(set(hashed)) == 2
    held.vectors("c", Counted(spark), windows(items, 3).where("item < 99"), items, "item")  # another plan of the same rows
    assert len(hashed) == 3 and hashed[1] == hashed[2] and len(held.passes) == 2


def test_a_probe_holds_no_sequences(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(tasks.probes, "probe_all", lambda rows, *a, of=tasks.probes.probe_all, **k: seen.append(rows.columns) or of(rows, *a, **k))
    rows = [(i, ("ACAAC" if i % 2 else "TGTTG") * 4, f"g{i % 3}", i % 2, "test" if i % 4 > 1 else "train") for i in range(48)]
    genes = spark.createDataFrame(rows, "doc_id int, seq string, genome string, essential int, split string")
    control.run_tasks(KmerModel(1), [tasks.GeneTask("genes", lambda s: genes)], spark)
    assert seen and not {"seq", "sequence", "window"} & set(seen[0])


def test_letters_of_documents(spark, tmp_path):
    """The stand-ins' sequences are the normalised text's letters."""
    texts = [" acgu\tn", "U", None, "", "\u00a0a\u2003 xyz TTU\n", "straße ÅçĠ ŉ N", "u" * 5000 + " " * 3000 + "Nn"]
    spark.createDataFrame([(i, t, "en", "web") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    want = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", F.regexp_replace(normalize(F.col("text")), "[^ACGTN]", ""))
    assert sorted(map(tuple, stand_ins.seqs(spark, str(tmp_path)).select("doc_id", "seq").collect())) == sorted(map(tuple, want.collect()))


def test_a_wider_reader_promotes(spark, items):
    model = Counted(spark)
    held = reuse.Reuse({"c": reuse.Demand(vectors=2)})
    held.vectors("c", model, windows(items), items, "item").count()
    (narrow,) = [t[0].table_path for t in held.vectors_of.values()]
    assert len(pairs(held.vectors("c", model, windows(items), items, "item", "all"))) == 40
    assert len(pairs(held.vectors("c", model, windows(items), items, "item", [-1]))) == 20
    assert [w for *_, w in held.passes] == ["last", "all"] and not complete(spark, narrow)
    assert {r.layer_id for r in held.vectors("c", model, windows(items), items, "item", "0,-1").collect()} == {0, 1} and len(held.passes) == 2
    with pytest.raises(KeyError):
        held.vectors("c", model, windows(items), items, "item", 7)


def test_outputs_go_after_the_last_reader(spark, items):
    model = Counted(spark)
    held = reuse.Reuse({"a": reuse.Demand(vectors=2), "b": reuse.Demand(vectors=1)})
    for c in ("a", "b"):
        held.vectors(c, model, windows(items), items, "item").count()
    (table, *_) = held.vectors_of.values()
    held.release("a")
    held.release("a")
    assert complete(spark, table[0].table_path)  # b reads it still
    held.release("b")
    assert not complete(spark, table[0].table_path) and not held.vectors_of


def test_kept_outputs_serve_a_later_run(spark, items, tmp_path):
    model = Fused(spark)
    for _ in range(2):
        held = reuse.Reuse({"c": reuse.Demand(vectors=1, logprobs=1)}, "run:1", str(tmp_path))
        first = pairs(held.vectors("c", model, windows(items), items, "item"))
        held.logprobs("c", model, windows(items), items, "item").count()
        held.release("c")
        held.release("c")
        assert len(first) == 20 and model.both.value == 20
    assert len(os.listdir(tmp_path)) == 2


def test_the_loop_plans_by_pending_tasks(spark, tmp_path):
    rows = [(i, ("ACAAC" if i % 2 else "TGTTG") * 4, f"g{i % 3}", i % 2, "test" if i % 4 > 1 else "train") for i in range(48)]
    genes = spark.createDataFrame(rows, "doc_id int, seq string, genome string, essential int, split string")
    load = lambda s: genes
    own = [tasks.GeneTask("last", load, "genes"), tasks.LikelihoodTask("z", load, "genes"), tasks.GeneTask("sweep", load, "genes", sweep=True)]
    model = Fused(spark)
    record = control.run_tasks(model, own, spark, tmp_path)
    assert [t["status"] for t in record["tasks"]] == ["ok"] * 3, record["tasks"]
    assert model.both.value == 48 and model.embedded.value == model.scored.value == 0
    assert [p[1:] for p in record["passes"]] == [[("vectors", "logprobs"), "all"]]
    control.run_tasks(model, own, spark, tmp_path)
    assert model.both.value == 48
    alone = Fused(spark)
    control.run_tasks(alone, own[:1], spark)
    assert (alone.both.value, alone.embedded.value) == (0, 48)
    assert control.run_tasks(KmerModel(1), own[1:2], spark)["tasks"][0]["status"] == "na"


def test_two_policies_of_one_corpus(spark):
    """What one task reads is never served to another that cuts the corpus otherwise."""
    rows = [(i, "ACCA" * 20 + "AAAA" * 10 if i % 2 else "GTTG" * 20 + "GGGA" * 10, f"c{i % 2}", "test" if i % 4 > 1 else "train") for i in range(24)]
    enzymes = spark.createDataFrame(rows, "row_idx int, sequence string, label string, split string")

    class Lengths(SequenceModel):
        name, capabilities, n_layers, max_context = "lengths", frozenset({"embed"}), 1, 40

        def embed(self, seqs, layers="last"):
            return np.array([[[float(s.count("A")), float(len(s))]] for s in seqs])

    seen = {}

    class Watched(tasks.EnzymeTask):
        def measure(self, rows):
            seen[self.name] = sorted(tuple(r.vec) for r in rows.select("vec").collect())
            return super().measure(rows)

    own = [Watched(p, lambda s: enzymes, policy=p, corpus="enzymes") for p in ("window", "truncate")]
    alone = {}
    for p in ("window", "truncate"):
        control.run_tasks(Lengths(), [Watched(p, lambda s: enzymes, policy=p)], spark)
        alone[p] = seen[p]
    together = control.run_tasks(Lengths(), own, spark)
    assert [t["status"] for t in together["tasks"]] == ["ok", "ok"] and len(together["passes"]) == 2
    assert seen == alone and seen["window"] != seen["truncate"]


def test_content_keys(spark):
    rows = [(1, 0, "AC"), (1, 1, "GT"), (2, 0, "AC"), (2, 1, None)]
    key = lambda r: reuse.content_key(spark.createDataFrame(r, "item int, at int, window string"), "item")
    assert key(rows) == key(rows[::-1]) and len(key(rows)) == 24
    changed = [rows[:3], [*rows[:3], (2, 1, "")], [(1, 0, "GT"), (1, 1, "AC"), *rows[2:]], [*rows, rows[0]], [*rows, rows[0], rows[0]], [(2, 0, "AC"), (1, 1, "GT"), (1, 0, "AC"), (2, 2, None)]]
    assert len({key(rows), *map(key, changed)}) == 7 and key([]) == key([])


def test_checks_of_all_layers(spark, items):
    good = spark.createDataFrame([(i, k, [1.0]) for i in range(20) for k in (0, 1)], "item int, layer_id int, vec array<double>")
    assert vectors.check_layers(good, items, "item") == [0, 1]
    bad = [good.where("item <> 3"), good.where("item <> 3 OR layer_id = 0"), good.union(good.limit(1)), good.union(good.limit(2).withColumn("item", F.lit(99))), good.withColumn("vec", F.array(F.when(F.col("item") == 5, float("nan")).otherwise(1.0)))]
    for df in bad:
        with pytest.raises(ValueError):
            vectors.check_layers(df, items, "item")
    with pytest.raises(Unsupported):
        EchoModel().embeddings(items, "item", "seq", pool="max")


def test_affected_tokens_are_those_that_cover(spark):
    df = spark.range(30).select(F.col("id").cast("int").alias("p"))
    for n, k, shift in ((30, 6, 1), (30, 6, 2), (29, 3, 3), (5, 6, 1)):
        got = {r.p: r.t for r in df.select("p", affected_tokens(F.col("p"), F.lit(n), k, shift).alias("t")).collect()}
        tokens = range(max(0, (n - k) // shift + 1)) if n >= k else []
        assert all(got[p] == [j for j in tokens if j * shift <= p < j * shift + k] for p in range(30)), (n, k, shift)
