from __future__ import annotations

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqforge.functions import features
from seqforge.functions import sequences as S
from seqforge.models import EchoModel, KmerModel, SequenceModel, batched, length_batches
from seqforge.operators import control, metrics, probes, vectors
from seqforge.plans import tasks
from seqforge.sources import tables

GENES = "genome_name,genus,essential,sequence\n"


def content_model():
    class Content(SequenceModel):
        """Share of G and C, and in layer 1 of A; layer 2 says nothing."""

        name, capabilities, n_layers = "content", frozenset({"embed"}), 3

        def embed(self, seqs, layers="last"):
            x = np.array([[[sum(c in "GC" for c in s) / len(s)], [s.count("A") / len(s)], [0.0]] for s in seqs])
            return x if layers == "all" else x[:, -1:]

    return Content()


def split_files(tmp_path):
    rng = np.random.default_rng(1)
    rows = {}
    for split, n in (("train", 60), ("test", 40)):
        rows[split] = []
        for k in range(n):
            y = int(rng.random() < 0.5)
            rows[split].append((f"g{k % 3}", y, "".join(rng.choice(list("ACGT"), 50, p=[0.2, 0.3 + 0.1 * y, 0.3 - 0.1 * y, 0.2] if k % 2 else [0.25 + 0.1 * y, 0.25, 0.25, 0.25 - 0.1 * y]))))
        (tmp_path / f"{split}.csv").write_text(GENES + "".join(f"{g},x,{y},{s}\n" for g, y, s in rows[split]))
    (tmp_path / "m.yaml").write_text(json.dumps({"splits": {s: {"file": f"{s}.csv", "sha256": control.file_digest(tmp_path / f"{s}.csv")} for s in rows}}))
    return str(tmp_path / "m.yaml"), rows


def plain_auroc(pairs):
    p, n = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    return np.mean([(a > b) + (a == b) / 2 for a in p for b in n])


def test_genes_of_two_splits_against_a_loop(spark, tmp_path):
    manifest, rows = split_files(tmp_path)
    load = lambda s: tables.load_splits(s, manifest).withColumnsRenamed({"id": "doc_id", "sequence": "seq", "genome_name": "genome"})
    assert load(spark).select("doc_id").distinct().count() == 100
    plain = tasks.GeneTask("genes", load, "genes", manifest=manifest)
    swept = tasks.GeneTask("genes-layer-sweep", load, "genes", sweep=True)
    record = control.run_tasks(content_model(), [plain, swept], spark, told=lambda line: None)
    got = {t["task"]: t for t in record["tasks"]}
    assert all(t["status"] == "ok" for t in got.values()), got
    assert got["genes"]["metadata"]["manifest_sha256"] == control.file_digest(manifest)
    want = {}
    for layer, letters in ((0, "GC"), (1, "A")):
        share = lambda s, letters=letters: sum(c in letters for c in s) / len(s)
        means = [np.mean([share(s) for _, y, s in rows["train"] if y == k]) for k in (0, 1)]
        up = 1 if means[1] >= means[0] else -1
        want[layer] = np.mean([plain_auroc([(y, up * share(s)) for g, y, s in rows["test"] if g == name]) for name in ("g0", "g1", "g2")])
    sweep = got["genes-layer-sweep"]
    for layer, value in want.items():
        assert sweep["metrics"][f"layer_{layer}_mean_auroc"] == pytest.approx(value)
    assert sweep["metrics"]["layer_2_mean_auroc"] == pytest.approx(0.5) == got["genes"]["metrics"]["mean_auroc"]
    best = max(want, key=want.get)
    assert sweep["metadata"]["best_layer"] == best and sweep["metrics"]["mean_auroc"] == pytest.approx(want[best])
    assert sweep["metadata"]["depth_health_measured"] and (sweep["metadata"]["considered"], sweep["metadata"]["excluded"]) == (2, 1)
    one = tasks.GeneTask("one", load, sweep=True)
    assert not control.run_tasks(KmerModel(1), [one], spark)["tasks"][0]["metadata"]["depth_health_measured"]


def test_variants_of_two_assays_against_a_loop(spark, tmp_path):
    rng = np.random.default_rng(2)
    reference, entries, rows = "ACGTTGCAACGTAGCT", [], []
    for name in ("b1", "b2"):
        lines, own = "mutant,sequence,DMS_score\n,ACGT,1\n", []
        for _ in range(20):
            at = sorted(rng.choice(16, rng.integers(1, 3), replace=False).tolist())
            muts = [(p, reference[p], rng.choice([c for c in "ACGT" if c != reference[p]])) for p in at]
            seq = "".join(dict((p, m) for p, _, m in muts).get(k, c) for k, c in enumerate(reference))
            score = round(float(rng.normal()), 3)
            own.append((muts, score))
            lines += f'"{":".join(f"{w}{p + 1}{m}" for p, w, m in muts)}",{seq},{score}\n'
        (tmp_path / f"{name}.csv").write_text(lines)
        entries.append({"file": f"{name}.csv", "dms_id": name, "rna_type": "t", "sha256": control.file_digest(tmp_path / f"{name}.csv")})
        rows.append(own)
    (tmp_path / "a.yaml").write_text(json.dumps({"assays": entries}))
    load = lambda s: tables.load_assays(s, str(tmp_path / "a.yaml"))
    task = control.run_tasks(EchoModel(), [tasks.VariantTask("variants", load)], spark)["tasks"][0]
    assert task["status"] == "ok" and task["metadata"]["scoring_method"] == "variant_llr" and task["metadata"]["n_variants"] == 40
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    for name, own in zip(("b1", "b2"), rows):
        llr = np.array([sum(EchoModel().site_llr(reference, p, w, m) for p, w, m in muts) for muts, _ in own])
        assert task["metrics"][f"{name}_spearman"] == pytest.approx(abs(np.corrcoef(rank(llr.round(12)), rank(np.array([s for _, s in own])))[0, 1]), abs=1e-6)
    short = EchoModel()
    short.max_context = 10
    assert control.run_tasks(short, [tasks.VariantTask("variants", load)], spark)["tasks"][0]["status"] == "error"
    twice = control.run_tasks(EchoModel(), [tasks.VariantTask("v", lambda s: load(s).withColumn("variant_idx", F.lit(1)))], spark)["tasks"][0]
    assert twice["status"] == "error" and "repeats" in twice["metadata"]["error"]
    entries[0].pop("sha256")
    (tmp_path / "a.yaml").write_text(json.dumps({"assays": entries}))
    with pytest.raises(tables.ContractError, match="no sha256"):
        load(spark)


def test_enzymes_from_files(spark, tmp_path):
    motifs = {"1.1.1.1": "ACCA", "2.2.2.2": "GTTG", "3.3.3.3": "AGGA"}
    for split in ("train", "test"):
        (tmp_path / f"{split}.csv").write_text("entry,sequence,label\n" + "".join(f"E{k}{c},{m * (10 + k)},{c}\n" for c, m in motifs.items() for k in range(4)))
    (tmp_path / "m.yaml").write_text("splits: {train: train.csv, test: test.csv}\n")
    load = lambda s: tables.load_enzymes(s, str(tmp_path / "m.yaml")).withColumn("row_idx", F.col("id"))
    record = control.run_tasks(KmerModel(2), [tasks.EnzymeTask("enzymes", load)], spark)
    assert record["tasks"][0]["metrics"] == {"macro_f1": 1.0, "accuracy": 1.0, "n_classes": 3.0}
    (tmp_path / "train.csv").write_text("entry,sequence,label\n,ACGT,1\nE,,1\n")
    with pytest.raises(tables.ContractError, match="empty entry .1.; empty sequence .1."):
        load(spark)


def test_multinomial_probe_against_newton(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(160, 2)) + 1.5 * np.repeat(np.eye(3, 2), [60, 50, 50], axis=0)
    y = np.repeat([0, 1, 2], [60, 50, 50])
    order = rng.permutation(160)
    x, y = x[order], y[order]
    df = spark.createDataFrame([(i, f"c{y[i]}", x[i].tolist()) for i in range(160)], "i int, label string, vec array<double>")
    got = {r.i: r.predicted for r in probes.probe(df, "label", F.col("i") < 120, scale=False, multiclass=True, tol=1e-9).collect()}
    b, t = np.column_stack((x[:120], np.ones(120))), np.eye(3)[y[:120]]
    w = np.zeros((3, 3))
    for _ in range(20000):  # gradient steps on the penalised log-likelihood
        z = np.exp(b @ w)
        w -= 0.01 * (b.T @ (z / z.sum(1, keepdims=True) - t) + np.diag([1, 1, 0.0]) @ w)
    want = (np.column_stack((x[120:], np.ones(40))) @ w).argmax(1)
    assert np.mean([got[120 + k] == f"c{want[k]}" for k in range(40)]) >= 0.95


def test_a_probe_reads_its_source_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(i, i % 2, [float(i % 7), float(i % 2)]) for i in range(100)], "i int, y int, vec array<double>").mapInArrow(counted, "i int, y int, vec array<double>")
    out = probes.probe(rows, "y", F.col("i") < 70)
    assert out.count() == 30 and len(out.collect()) == 30 and seen.value == 100
    assert "vec" not in out.columns
    out.unpersist()


def test_nan_scores_raise(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 0, float("nan"))], "g string, y int, s double")
    for made in (metrics.auroc(df, ["g"], "y", "s"), metrics.average_precision(df, ["g"], "y", "s"), metrics.confusion(df, "y", "s"), metrics.score_summary(df, "s"), metrics.score_summary(df.limit(0), "s")):
        with pytest.raises(Exception, match="NaN|no scores"):
            made.collect()


def test_strands_by_sign_or_number(spark):
    df = spark.createDataFrame([("+",), ("-",), ("1",), ("-1",), (None,), (".",)], "s string").withColumn("d", F.lit("ACGTACGTAC"))
    got = [r[0] for r in df.select(S.gene_extract(F.col("d"), F.lit(4), F.lit(5), F.col("s"), 2)).collect()]
    assert got == ["CGTA", "TACG", "CGTA", "TACG", "CGTACG", "CGTACG"]


def test_layers_by_name_number_and_list(spark):
    assert [control.pick_layers([0, 2, 5], x) for x in ("all", "last", 2, [-1, 0], "0,-2", None)] == [[0, 2, 5], [5], [2], [5, 0], [0, 2], [0, 2, 5]]
    with pytest.raises(KeyError, match="no layer 3"):
        control.pick_layers([0, 2], [3])


def plain_batches(lengths, budget, size):
    out = []
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        fits = out and (budget is None or (len(out[-1]) + 1) * lengths[i] <= budget) and (size is None or len(out[-1]) < size)
        out[-1].append(i) if fits else out.append([i])
    return out


def test_length_batches_against_a_loop(spark):
    rng = np.random.default_rng(4)
    for _ in range(200):
        lengths = rng.integers(0, 30, rng.integers(0, 40)).tolist()
        budget, size = [(50, None), (None, 4), (40, 3)][rng.integers(3)]
        assert length_batches(lengths, budget, size) == plain_batches(lengths, budget, size)
    df = spark.createDataFrame([(i, "A" * int(n)) for i, n in enumerate(rng.integers(0, 40, 300))], "id int, s string")
    whole = batched(df, "id", "s", 200, groups=1).collect()
    batches = {}
    for r in whole:
        batches.setdefault(r.batch, []).append(r.length)
    lengths = sorted(r.length for r in whole)
    assert sorted(map(len, batches.values())) == sorted(map(len, plain_batches(lengths, 200, None)))
    assert batched(df, "id", "s", 200).count() == 300


def test_columns_of_models(spark):
    df = spark.createDataFrame([(0, "AC"), (1, ""), (2, None)], "id int, s string")
    echo = EchoModel()
    assert {r.id: r.tokens for r in echo.tokens(df, "id", "s").collect()} == {0: [65, 67], 1: [], 2: []}
    assert {r.id: len(r.logprobs) for r in echo.logprobs(df, "id", "s", True).collect()} == {0: 2, 1: 0, 2: 0}
    echo.per_token = lambda seqs: [[0.0] for _ in seqs]
    with pytest.raises(Exception, match="one for each letter"):
        echo.logprobs(df, "id", "s", True).collect()


def test_echo_embeddings_are_the_seeded_numbers(spark):
    df = spark.createDataFrame([(0, "ACGT"), (1, "GG")], "id int, s string")
    for row in EchoModel().embeddings(df, "id", "s", "all").collect():
        seed = 0xCBF29CE484222325
        for b in ("ACGT", "GG")[row.id].encode():
            seed = (seed ^ b) * 0x100000001B3 % 2**64
        assert row.vec == np.random.Generator(np.random.PCG64(seed)).standard_normal((2, 8))[row.layer_id].tolist()


def test_corpus_keys_stream(spark):
    rows = [(i, f"g{i % 3}", s) for i, s in enumerate(["AC", "", "GT", "T", "AAA", "C", "G"])] + [(9, "g0", None)]
    got = {r.g: r.corpus_key for r in features.corpus_keys(spark.createDataFrame(rows, "i int, g string, s string").repartition(3), "g", "i", "s").collect()}
    for g in ("g0", "g1", "g2"):
        own = [s for _, h, s in rows if h == g and s is not None]
        assert got[g] == hashlib.sha256("\0".join([str(len(own)), *own]).encode()).hexdigest()[:24]


def test_corpus_keys_of_more_rows_than_sizes(spark):
    """Adaptive execution broadcasts the sizes when the rows are dealt: a group must still meet in one task."""
    rows = [(i, f"g{i % 5}", "ACGT"[i % 4] * (i % 7)) for i in range(2000)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 6), "i int, g string, s string")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "8KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():  # the sizes are known to be few in the run only, and small rows stay in several tasks
        spark.conf.set(k, v)
    try:
        got = [(r.g, r.corpus_key) for r in features.corpus_keys(df, "g", "i", "s").collect()]
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert sorted(got) == [(g, features.corpus_key([s for _, h, s in rows if h == g])) for g in sorted({g for _, g, _ in rows})]


def test_wire_formats(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"sequence": "AC"}\n\n{"id": "x", "sequence": "G"}\n{"sequence": "T"}\n')
    assert {(r.id, r.sequence) for r in tables.read_jsonl(spark, str(tmp_path / "s.jsonl")).collect()} == {("0", "AC"), ("x", "G"), ("2", "T")}
    with pytest.raises(tables.ContractError, match="lacks"):
        tables.read_jsonl(spark, str(tmp_path / "s.jsonl"), ("reference",))
    items = spark.createDataFrame([("a", "ACGT", [(0, "A", "C"), (3, "T", "G")]), ("b", "GG", [])], "id string, reference string, mutations array<struct<pos0:int,wt:string,mut:string>>")
    tables.write_variant_items(items, str(tmp_path / "v"))
    assert sorted(map(str, tables.read_variant_items(spark, str(tmp_path / "v")).collect())) == sorted(map(str, items.collect()))
    x = np.arange(12, dtype=np.float32).reshape(2, 3, 2)
    np.savez(tmp_path / "d.npz", vectors=x, layers=np.array([0, 4, 9]))
    assert {(r.item, r.layer_id): r.vec for r in tables.read_dense(spark, str(tmp_path / "d.npz")).collect()}[1, 4] == [8.0, 9.0]
    np.savez(tmp_path / "r.npz", values=np.arange(5.0), offsets=np.array([0, 2, 2, 5]))
    assert [r["values"] for r in tables.read_ragged(spark, str(tmp_path / "r.npz")).orderBy("item").collect()] == [[0.0, 1.0], [], [2.0, 3.0, 4.0]]
    np.savez(tmp_path / "r.npz", values=np.arange(5.0), offsets=np.array([0, 6]))
    with pytest.raises(Exception, match="offsets do not fit"):
        tables.read_ragged(spark, str(tmp_path / "r.npz")).collect()


def test_sources_of_other_kinds(spark, tmp_path):
    import zipfile

    text = "\ufeffMutant,sequence,dms_score\nA1C,CC,0.5\n"
    (tmp_path / "a.csv").write_text(text.lstrip("\ufeff"))
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.write(tmp_path / "a.csv", "a.csv")
    for name in ("a.csv", "a.zip"):
        assert tables.canonical_variants(tables.read_any(spark, str(tmp_path / name))).first().asDict() == {"mutant": "A1C", "sequence": "CC", "DMS_score": "0.5"}
    sheet = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, k string").toDF("\ufeffid", "k")
    assert [r.id for r in tables.select_assays(sheet, k="y").collect()] == ["b"]
    with pytest.raises(tables.ContractError, match="no column"):
        tables.canonical_variants(sheet)


def test_vectors_as_they_are(spark):
    df = spark.createDataFrame([(0, 0, [1.0]), (0, 1, [3.0])], "i int, t int, vec array<double>")
    assert vectors.pool(df, ["i"], "t", "none").count() == 2
    with pytest.raises(ValueError):
        vectors.pool(df, ["i"], "t", "other")
    assert vectors.padding_efficiency(spark.createDataFrame([], "batch int, length int")).first().efficiency == 1.0
    assert {r.dim: r.z for r in vectors.standardise(df, ["t"], F.lit(True)).where("t = 1").collect()} == {0: 1.0}


def test_scores_pass_columns_through_and_run_once_a_sequence(spark):
    class Told(EchoModel):
        def score(self, seqs, reduction="mean"):
            assert len(seqs) == len(set(seqs))
            return super().score(seqs, reduction)

    rows = [(i % 2, f"a{i}", "ACGT"[: 1 + i % 3]) for i in range(12)]
    got = Told().scores(spark.createDataFrame(rows, "g int, k string, s string").coalesce(1), ["g", "k"], "s")
    assert got.columns == ["g", "k", "score"]
    assert {(r.g, r.k): r.score for r in got.collect()} == {(g, k): EchoModel().score([s])[0] for g, k, s in rows}
