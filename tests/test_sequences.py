from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqforge.functions import features
from seqforge.functions import sequences as S


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_normalize(spark):
    assert values(spark, S.normalize(F.col("s")), [(" acgu\n",), ("\tAcNt ",), ("",), (None,)], "s string") == ["ACGT", "ACNT", "", None]


def test_gene_extract(spark):
    rng = random.Random(1)
    dna = "".join(rng.choice("acgt") for _ in range(1000))
    rows = [(dna, 200, 260, 1), (dna, 200, 260, -1), (dna, 200, 260, None), (dna, 10, 60, 1)]
    got = values(spark, S.gene_extract(F.col("d"), F.col("a"), F.col("b"), F.col("s")), rows, "d string, a int, b int, s int")
    assert got == [x.upper() for x in (dna[71:260], dna[199:388], dna[71:388], dna[0:60])]


def plain_windows(s, width, overlap):
    out, i = [], 0
    while i < len(s):
        out.append(s[i : i + width])
        if i + width >= len(s):
            break
        i += max(1, width - overlap)
    return out


def test_windows_against_a_loop(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choice("ACGT") for _ in range(n)),) for n in [0, 1, 31, 32, 33, 99, 100, 101, 168, 169, 250, 500]]
    assert [len(w) for w in values(spark, S.windows(F.col("s"), 100), [("A" * 250,)], "s string")[0]] == [100, 100, 100, 46]
    for width, overlap in ((100, 32), (40, 32), (32, 32), (50, 0)):
        assert values(spark, S.windows(F.col("s"), width, overlap), rows, "s string") == [plain_windows(s, width, overlap) for (s,) in rows]


def test_window_policies_differ_when_no_window_is_long_enough(spark):
    s = "ACGT" * 10
    assert values(spark, S.gene_windows(F.col("s"), 20, 4), [(s,)], "s string") == [[s]]
    assert values(spark, S.enzyme_windows(F.col("s"), 20, overlap=4), [(s,)], "s string") == [[s[10:30]]]
    assert values(spark, S.enzyme_windows(F.col("s"), 0), [(s,)], "s string") == [[s]]
    assert values(spark, S.enzyme_windows(F.col("s"), 20, "truncate"), [(s,)], "s string") == [[s[10:30]]]
    with pytest.raises(ValueError):
        S.enzyme_windows(F.col("s"), 20, "other")


@pytest.mark.parametrize(
    ("mutant", "want"),
    [("C70T", [(69, "C", "T")]), ("A1C:T4G", [(0, "A", "C"), (3, "T", "G")]), ("a3u", [(2, "A", "T")]), ("A1C, T4G", [(0, "A", "C"), (3, "T", "G")])]
    + [(x, None) for x in ("", " ", None, "A0C")],
)
def test_parse_mutant(spark, mutant, want):
    got = values(spark, S.parse_mutant(F.col("m")), [(mutant,)], "m string")[0]
    assert (None if got is None else [tuple(x) for x in got]) == want


def test_mutants_with_one_thing_wrong(spark):
    rng = random.Random(9)
    base = lambda: rng.choice("ACGTUacgtu")
    spoil = [lambda w, p, m: f"{p}{m}", lambda w, p, m: f"{w}{p}", lambda w, p, m: f"{w}{m}", lambda w, p, m: f"{w}{base()}{p}{m}", lambda w, p, m: f"{w}{p}{m}{base()}", lambda w, p, m: f"{rng.choice('XZN-*1')}{p}{m}", lambda w, p, m: f"{w}{p}{rng.choice('XZN-*')}", lambda w, p, m: f"{w}-{p}{m}", lambda w, p, m: f"{w}0{m}"]
    good = [f"{base()}{rng.randint(1, 999)}{base()}" for _ in range(20)]
    bad = [f(base(), rng.randint(1, 999), base()) for f in spoil for _ in range(4)]
    rows = [(g, True) for g in good] + [(b, False) for b in bad] + [(f"{rng.choice(good)}{rng.choice(',:')}{b}", False) for b in bad] + [(f"{a}:{b}", True) for a, b in zip(good, good[1:])]
    got = spark.createDataFrame(rows, "m string, ok boolean").select("m", "ok", S.parse_mutant(F.col("m")).isNotNull().alias("parsed")).collect()
    assert [(r.m, r.parsed) for r in got] == rows


def test_reference_is_rebuilt_and_errors_are_counted(spark):
    rows = [("a", "A1C", "CCGT"), ("a", "G3T", "ACTT"), ("b", "A1C", "CCGT"), ("b", "A9C", "CCGT"), ("c", "A1C", "TCGT"), ("d", "A1C:C1G", "ACGT")]
    parsed = spark.createDataFrame(rows, "dms_id string, mutant string, sequence string").withColumn("mutations", S.parse_mutant(F.col("mutant")))
    got = {r.dms_id: (r.n_bad, r.n_references) for r in S.assay_check(parsed).collect()}
    assert got["a"] == (0, 1) and got["b"][0] == 1 and got["c"][0] == 1 and got["d"][0] == 1


def test_layer_lists(spark):
    assert S.parse_layers("0,4-6,12") == [0, 4, 5, 6, 12] and S.parse_layers("-1,-2") == [-1, -2] and S.parse_layers("all") is None
    with pytest.raises(ValueError):
        S.parse_layers("one")
    assert values(spark, S.layer_list(F.col("s")), [("0,4-6,12",), ("-1, -2",), ("*",), (None,)], "s string") == [[0, 4, 5, 6, 12], [-1, -2], None, None]


def test_affected_tokens_against_a_scan(spark):
    rows = [(p, n) for n in (5, 6, 7, 20) for p in range(n)]
    got = values(spark, S.affected_tokens(F.col("p"), F.col("n"), 6, 2), rows, "p int, n int")
    for (p, n), own in zip(rows, got):
        assert own == [j for j in range(max(0, (n - 6) // 2 + 1)) if j * 2 <= p < j * 2 + 6]


def test_kmers(spark):
    assert features.kmer_index(b"AAAC", 2).tolist() == [0, 0, 1]
    rows = [(0, "AAAC"), (1, "ACGTNNACGT"), (2, ""), (3, None), (4, "acgt")]
    df = spark.createDataFrame(rows, "id int, s string")
    vec = {r.id: r.vec for r in features.kmer_vectors(df, "id", "s", 2).collect()}
    assert vec[0][0] == pytest.approx(2 / 3) and vec[0][1] == pytest.approx(1 / 3)
    assert [vec[1][i] for i in (1, 6, 11)] == [pytest.approx(1 / 3)] * 3 and vec[1][12] == 0
    assert all(sum(vec[i]) == 0 for i in (2, 3, 4))
    counts = {(r.id, r.k): r.n for r in features.kmer_counts(df, "id", "s", 2).select("id", features.kmer_name(F.col("kmer"), 2).alias("k"), "n").collect()}
    assert counts == {(0, "AA"): 2, (0, "AC"): 1, (1, "AC"): 2, (1, "CG"): 2, (1, "GT"): 2}


def test_echo(spark):
    toys = ["ACGTACGT", "TTTTAAAA", "GGGGCCCC", "ACACACAC", "TGCATGCA"]
    got = values(spark, features.echo_mean(F.col("s")), [(t,) for t in toys], "s string")
    assert np.mean(got) == pytest.approx(-0.860221255818, abs=1e-11) and min(got) == pytest.approx(-0.914114595254, abs=1e-11)
    assert max(got) == pytest.approx(-0.799649042496, abs=1e-11) and got[0] == pytest.approx(-0.856881818875, abs=1e-11)


def test_corpus_key(spark):
    assert features.corpus_key(["AC", "GT"]) == "794ea29c9ea5689b3b205ce6"
    assert values(spark, features.corpus_key_column(F.col("s")), [(["AC", "GT"],)], "s array<string>") == ["794ea29c9ea5689b3b205ce6"]
