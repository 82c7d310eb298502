from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from seqforge.models import EchoModel, KmerModel, Registry, Unsupported, length_batches
from seqforge.operators import control, results
from seqforge.plans import tasks
from seqforge.sources import tables


class Fixed:
    alternatives = [["variant_llr"], ["score"]]

    def __init__(self, name, fail=False):
        self.name, self.fail, self.runs = name, fail, 0

    def prepare(self, spark):
        return None

    def run(self, model, chosen, prepared):
        self.runs += 1
        if self.fail:
            raise RuntimeError("no")
        return control.TaskResult(self.name, "ok", "m", {"m": 1.0})


def test_negotiation():
    assert control.choose([["a", "b"], ["c"]], {"c"}) == (["c"], [["a", "b"], []])
    assert control.choose([["a"], ["b"]], set()) == (None, [["a"], ["b"]])


def test_run_resumes_only_what_is_not_ok(tmp_path):
    good, bad = Fixed("good"), Fixed("bad", True)
    first = control.run_tasks(EchoModel(), [good, bad], None, tmp_path)
    assert [t["status"] for t in first["tasks"]] == ["ok", "error"]
    bad.fail = False
    again = control.run_tasks(EchoModel(), [good, bad], None, tmp_path)
    assert [t["status"] for t in again["tasks"]] == ["ok", "ok"] and (good.runs, bad.runs) == (1, 2)
    next(tmp_path.glob("*.json")).write_text("{broken")
    control.run_tasks(EchoModel(), [good], None, tmp_path)
    assert good.runs == 2
    assert control.run_tasks(KmerModel(2), [good], None)["tasks"][0]["status"] == "na"


def test_records_are_read_and_broken_ones_left_out(spark, tmp_path):
    control.run_tasks(EchoModel(), [Fixed("a")], None, tmp_path)
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "other.json").write_text(json.dumps({"x": 1}))
    rows = results.explode_records(tables.read_records(spark, str(tmp_path))).collect()
    assert [(r.task, r.status, r.metric, r.value) for r in rows] == [("a", "ok", "m", 1.0)]


def test_contracts(spark, tmp_path):
    good = "genome_name,genus,essential,sequence\nA,x,1, acgu \nB,y,0,GGTT\n"
    (tmp_path / "g.csv").write_text(good)
    (tmp_path / "m.yaml").write_text(f"splits:\n  train: {{file: g.csv, sha256: {control.file_digest(tmp_path / 'g.csv')}}}\n  validation: {{file: absent.csv}}\n")
    rows = tables.load_splits(spark, str(tmp_path / "m.yaml"), ("train",)).collect()
    assert sorted(r.sequence for r in rows) == ["ACGT", "GGTT"]
    with pytest.raises(tables.ContractError, match="no split"):
        tables.load_splits(spark, str(tmp_path / "m.yaml"), ("test",))
    (tmp_path / "g.csv").write_text(good + "C,z,1,AA\n")
    with pytest.raises(tables.ContractError, match="has changed"):
        tables.load_splits(spark, str(tmp_path / "m.yaml"), ("train",))
    for text, problem in (("genome_name,genus,essential\nA,x,1\n", "no column sequence"), (good + "A,q,1,AC\n", "genus differs"), (good + ",x,1,AC\n", "empty genome"), (good + "A,x,2,AC\n", "label"), (good + "A,x,1,\n", "empty sequence")):
        (tmp_path / "b.csv").write_text(text)
        with pytest.raises(tables.ContractError, match=problem):
            tables.read_genes(spark, str(tmp_path / "b.csv"), "train")


def test_variants_drop_wild_types(spark, tmp_path):
    (tmp_path / "v.csv").write_text("mutant,sequence,DMS_score\n,ACGT,1\nnan,ACGT,2\nA1C,CCGT,0.5\nA1G,GCGT,x\nA1T,TCGT,NaN\n")
    assert [r.mutant for r in tables.read_variants(spark, str(tmp_path / "v.csv"), "a").collect()] == ["A1C"]


def test_models(spark):
    df = spark.createDataFrame([(0, "ACGT"), (1, "GG")], "id int, s string")
    echo = EchoModel()
    rows = {(r.id, r.layer_id): r.vec for r in echo.embeddings(df, "id", "s", "all").collect()}
    assert len(rows) == 4 and len(rows[0, 0]) == 8
    with pytest.raises(Unsupported):
        KmerModel(2).scores(df, "id", "s")
    v = spark.createDataFrame([(0, "ACGT", [(0, "A", "C"), (1, "C", "G")]), (1, "ACGT", [(0, "A", "C")])], "k int, reference string, mutations array<struct<pos0:int,wt:string,mut:string>>")
    got = {r.k: r.llr for r in echo.variant_llrs(v, "k").collect()}
    assert got[0] == pytest.approx(echo.site_llr("ACGT", 0, "A", "C") + echo.site_llr("ACGT", 1, "C", "G")) and got[1] == pytest.approx(echo.site_llr("ACGT", 0, "A", "C"))
    held = Registry()
    held.add("model", "a", 1)
    with pytest.raises(ValueError):
        held.add("model", "a", 2)
    with pytest.raises(KeyError):
        held.get("model", "b")


def test_length_batches():
    lengths = [5, 1, 9, 3, 30, 2, 2]
    out = length_batches(lengths, token_budget=12, batch_size=3)
    assert sorted(i for b in out for i in b) == list(range(7)) and [4] in out
    assert all(len(b) == 1 or (len(b) * max(lengths[i] for i in b) <= 12 and len(b) <= 3) for b in out)
    with pytest.raises(ValueError):
        length_batches(lengths)


def test_env():
    assert control.expand_env({"a": ["${X}/${Y:-z}", "$X"]}, {"X": "1"}) == {"a": ["1/z", "$X"]}
    with pytest.raises(KeyError, match="A, B"):
        control.expand_env("${A}${B}", {})


def test_tasks_end_to_end(spark):
    rows = [(i, ("ACAAC" if i % 2 else "TGTTG") * 20, f"g{i % 3}", i % 2, "test" if i % 4 > 1 else "train") for i in range(48)]
    genes = spark.createDataFrame(rows, "doc_id int, seq string, genome string, essential int, split string")
    assert {r.auroc for r in tasks.essentiality(genes, k=2, width=40).collect()} == {1.0}
    got = control.run_tasks(KmerModel(2), [tasks.GeneTask("genes", lambda s: genes)], spark)
    assert got["tasks"][0]["status"] == "ok" and got["tasks"][0]["metrics"]["mean_auroc"] == 1.0


def test_streamed_scores_are_the_batch_scores(spark, tmp_path):
    from seqforge.streaming import scoring

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": "a", "sequence": "acgu"}\n{"id": "b", "sequence": "GGGG"}\n')
    scoring.start(scoring.read_sequences(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    want = {r.id: r.score for r in scoring.scored(spark.createDataFrame([("a", "acgu"), ("b", "GGGG")], "id string, sequence string")).collect()}
    assert {r.id: r.score for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_queries_and_oracles_have_the_same_columns(spark):
    import __spark_entry__ as entry

    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found) and len(found) >= 70
    for name in ("auroc", "tidy", "negotiate"):
        assert found[name](spark, "/root/testdata/sf0.001").columns
    assert entry.entry(spark).count() > 0


def test_model_labels(spark):
    rows = [("x:0123456789abc", "A"), ("x:0123456789abc", ""), ("0123:45:6789abcdef", None), ("abc", "B"), (None, "C")]
    df = spark.createDataFrame(rows, "model string, name string")
    got = df.select(results.model_label(F.lit("kmer"), F.lit("1"), F.col("model"), F.col("name")).alias("l")).collect()
    assert [r.l for r in got] == ["A \u00b7 kmer@1 (0123456789)", "kmer@1 (0123456789)", "kmer@1 (45:6789abc)", "B \u00b7 kmer@1 (abc)", None]


def test_mutants_are_parsed_once_and_sites_meet_by_hash(spark):
    """No filter on the parsed array's size beside the parse, no sort of all sites, and rows without mutations give none."""
    from seqforge.functions import sequences as S
    from seqforge.models import exploded

    rows = [(i, m, "ACGTACGT") for i, m in enumerate(["A1C", "A1C:C2G", "C2G", None, "A1C"])]
    df = spark.createDataFrame(rows, "k int, mutant string, reference string").withColumn("mutations", S.parse_mutant(F.col("mutant")))
    plan = exploded(df, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan and plan.count("regexp_extract_all") == 1
    llrs = EchoModel().variant_llrs(df, "k")
    assert "Sort" not in llrs._jdf.queryExecution().executedPlan().toString().replace("SortOrder", "")
    got = {r.k: r.llr for r in llrs.collect()}
    assert set(got) == {0, 1, 2, 4} and got[0] == got[4] and got[1] == round(got[0] + got[2], 12)
    assert EchoModel().variant_llrs(df.where("mutant IS NULL"), "k").count() == 0
