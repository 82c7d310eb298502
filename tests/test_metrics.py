from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqforge.operators import metrics, probes, vectors


def test_curve_areas(spark):
    rows = [("a", y, s) for y, s in zip((0, 0, 1, 1), (0.1, 0.4, 0.35, 0.8))] + [("b", 0, 0.1), ("b", 0, 0.2)]
    got = {r.g: r for r in metrics.group_report(spark.createDataFrame(rows, "g string, y int, s double"), ["g"], "y", "s").collect()}
    assert got["a"].auroc == pytest.approx(0.75) and got["a"].auprc == pytest.approx(0.8333333)
    assert got["b"].auroc is None and got["b"].auprc is None and not got["b"].scored


@pytest.fixture(params=["one task a group", "blocks"])
def dealing(request, monkeypatch):
    if request.param == "blocks":
        monkeypatch.setattr(metrics, "SMALL_BYTES", -1)
    return request.param


def test_areas_against_pairs(spark, dealing):
    rng = np.random.default_rng(3)
    rows = [(int(g), int(y), float(s)) for g, y, s in zip(rng.integers(0, 3, 400), rng.integers(0, 2, 400), rng.integers(0, 25, 400) / 25)]
    got = {r.g: r for r in metrics.group_report(spark.createDataFrame(rows, "g int, y int, s double"), ["g"], "y", "s").collect()}
    for g in range(3):
        p, n = [s for h, y, s in rows if h == g and y], [s for h, y, s in rows if h == g and not y]
        assert got[g].auroc == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in p for b in n]))
        area, before = 0.0, 0.0
        for t in sorted(set(p + n), reverse=True):
            tp, seen = sum(x >= t for x in p), sum(x >= t for x in p + n)
            area += (tp / len(p) - before) * tp / seen
            before = tp / len(p)
        assert got[g].auprc == pytest.approx(area)


def test_rank_metrics_against_numpy(spark, dealing):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 9, 60).astype(float), rng.integers(0, 9, 60).astype(float)
    df = spark.createDataFrame([("a", "t", float(a), float(b)) for a, b in zip(x, y)] + [("c", "u", 1.0, float(b)) for b in range(4)], "d string, k string, x double, y double")
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    got = {r.d: r.spearman for r in metrics.spearman(df, ["d"], "x", "y").collect()}
    assert got["a"] == pytest.approx(abs(np.corrcoef(rank(x), rank(y))[0, 1])) and got["c"] is None
    t, s = x >= np.median(x), y >= np.median(y)
    assert {r.d: r.mcc for r in metrics.median_mcc(df, ["d"], "x", "y").collect()}["a"] == pytest.approx(abs(np.corrcoef(t, s)[0, 1]))


def test_ranks_of_odd_values_do_not_depend_on_blocks(spark, dealing):
    rng = np.random.default_rng(8)
    inf, huge, tiny = float("inf"), 1.7e308, 5e-324
    groups = {
        "odd": [None, -inf, -huge, -1.0, -tiny, 0.0, -0.0, tiny, 1.0, 1.0, huge, inf, float("nan")],
        "wide": [-huge, huge, 0.0, 3.0, 3.0], "one": [2.5, 2.5], None: [2.0, 1.0, None, 1.0],
        "narrow": (1 + rng.integers(0, 300, 500) * 1e-9).tolist(), "outlier": [*rng.normal(size=300).tolist(), 1e30, -1e25],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {(r.g, "nan" if r.v != r.v else r.v): r.rank for r in metrics.average_rank(df, ["g"], "v", "rank").collect()}
    place = lambda v: (0, 0.0) if v is None else (2, 0.0) if v != v else (1, v)
    for g, vs in groups.items():
        for v in vs:
            want = sum(place(u) < place(v) for u in vs) + (sum(place(u) == place(v) for u in vs) + 1) / 2
            assert got[g, "nan" if v is not None and v != v else v] == want
    blocks = metrics._blocks(df.where("g IN ('narrow', 'outlier')"), ["g"], "v").groupBy("g", "_block").count().groupBy("g").agg(F.max("count").alias("m"))
    assert all(r.m <= 30 for r in blocks.collect())


def test_medians_without_a_median(spark, dealing):
    rng = np.random.default_rng(9)
    groups = {"even": rng.normal(size=40), "odd": rng.integers(0, 5, 31) * 1.0, "spike": np.r_[np.full(300, 2.0), rng.normal(size=20)], "outlier": np.r_[rng.normal(size=25), 1e300], "one": np.array([3.5])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None), ("one", None)], "g string, v double")
    got = {r.g: r.median for r in metrics.group_median(df, ["g"], "v").collect()}
    assert got == {g: pytest.approx(np.median(v)) for g, v in groups.items()}


def test_blocks_of_a_spike_and_an_outlier_are_even(spark, monkeypatch):
    """However skewed the values, no block holds many times the distinct values of another."""
    monkeypatch.setattr(metrics, "SMALL_BYTES", -1)
    rng = np.random.default_rng(10)
    close = 1 + rng.permutation(4000) * 1e-13  # within 1/1024 of the range and 1/256 of the value
    values = [*close.tolist(), 1e12, -1e12]
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    sizes = [r["count"] for r in metrics._blocks(df.distinct(), ["g"], "v").groupBy("_block").count().collect()]
    assert len(sizes) > 200 and max(sizes) <= 4 * np.median(sizes)


def test_rank_plans(spark):
    """Two shuffles of the data for ranks of small tables; no aggregate that holds a group's values anywhere."""
    from pyspark.sql.types import DoubleType

    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_returnflag", F.col("l_quantity").cast(DoubleType()).alias("x"), F.col("l_extendedprice").alias("y"), (F.col("l_linenumber") % 2).alias("t"))
    plan = lambda out: out._jdf.queryExecution().executedPlan().toString()
    assert plan(metrics.spearman(df, ["l_returnflag"], "x", "y")).count("Exchange") <= 2
    assert plan(metrics.auroc(df, ["l_returnflag"], "t", "x")).count("Exchange") <= 2
    for out in (metrics.median_auc(df, ["l_returnflag"], "y", "x"), metrics.median_mcc(df, ["l_returnflag"], "y", "x"), metrics.variant_report(df, ["l_returnflag"], "y", "x")):
        assert "median(" not in plan(out) and "percentile(" not in plan(out)


def test_type_mean_is_not_the_plain_mean_and_keeps_gaps(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("a", 0.5), ("b", 0.0)], "t string, m double")
    assert metrics.type_mean(df, "t", ["m"]).first().m == pytest.approx(0.25)
    gap = df.union(spark.createDataFrame([("c", None)], "t string, m double"))
    assert metrics.type_mean(gap, "t", ["m"]).first().m is None


def test_macro_f1(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "d")], "t string, p string")
    r = metrics.macro_f1(df, "t", "p").first()
    assert r.n_classes == 4 and r.macro_f1 == pytest.approx((2 / 3 + 2 / 3) / 4) and r.accuracy == pytest.approx(0.5)


def test_confusion_divides_by_nothing(spark):
    r = metrics.confusion(spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, p double"), "y", "p").first()
    assert (r.tn, r.tp) == (2, 0) and r.precision is None and r.accuracy == 1.0


def test_probe_against_newton(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 4)) * [1, 2, 3, 0] + 1
    y = (x[:, 0] + rng.normal(size=200) > 1).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(200)], "i int, y int, vec array<double>")
    out = {r.i: r.prob for r in probes.probe(df, "y", F.col("i") < 150).collect()}
    a = x[:150]
    sd = a.std(0)
    z = (x - a.mean(0)) / np.where(sd > 1e-9, sd, 1)
    b, w = np.column_stack((z[:150], np.ones(150))), np.zeros(5)
    reg = np.diag([1, 1, 1, 1, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-b @ w))
        w -= np.linalg.solve(b.T @ (b * (p * (1 - p))[:, None]) + reg + 1e-12 * np.eye(5), b.T @ (p - y[:150]) + reg @ w)
    want = 1 / (1 + np.exp(-np.column_stack((z[150:], np.ones(50))) @ w))
    assert max(abs(out[150 + k] - want[k]) for k in range(50)) < 1e-5
    with pytest.raises(ValueError, match="one class"):
        probes.probe(df.withColumn("y", F.lit(1)), "y", F.col("i") < 150)


def test_depth_health(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20, 8))
    layers = [x, x, x + 0.5 * rng.normal(size=x.shape), np.zeros_like(x)]
    df = spark.createDataFrame([(i, k, v[i].tolist()) for k, v in enumerate(layers) for i in range(20)], "item int, layer_id int, vec array<double>")
    got = {r.layer_id: r for r in vectors.depth_health(df).collect()}
    assert got[1].frozen and not got[2].frozen and got[3].degenerate and not got[2].degenerate and got[0].delta is None
    assert got[2].rms == pytest.approx(np.sqrt((layers[2] ** 2).mean())) and got[2].delta == pytest.approx(np.sqrt(((layers[2] - x) ** 2).mean()) / got[2].rms)
    assert got[2].rel_std == pytest.approx(np.sqrt(((layers[2] - layers[2].mean(0)) ** 2).mean()) / got[2].rms)
    scores = spark.createDataFrame([(0, 0.1), (1, 0.5), (2, 0.5), (3, 0.9)], "layer_id int, score double")
    r = vectors.best_layer(scores, vectors.depth_health(df)).first()
    assert (r.best_layer, r.would_have_picked, r.considered, r.excluded) == (1, 3, 3, 1)


def test_pooling_and_sampling(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 4.0]), (0, 1, [3.0, 2.0])], "i int, t int, vec array<double>")
    for how, want in (("mean", [2.0, 3.0]), ("max", [3.0, 4.0]), ("last", [3.0, 2.0]), ("bos", [1.0, 4.0])):
        assert vectors.pool(df, ["i"], "t", how).first().vec == want
    got = sorted(r.id for r in vectors.sample_rows(spark.range(1000), "id", 64).collect())
    assert got == sorted({i * 999 // 63 for i in range(64)})


def test_metrics_work_on_counted_pairs(spark, monkeypatch):
    """Rows of one pair count as one row from the first step on, with a table's size known from its files or not."""
    rows = [("a", float(i % 7), float(i * i % 5)) for i in range(300)] + [("b", 1.0, None), ("b", 2.0, 3.0), ("b", 3.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, t double, s double")
    seen = []
    counted = metrics._counted
    monkeypatch.setattr(metrics, "_counted", lambda *a: seen.append(counted(*a)) or seen[-1])
    small = sorted(map(str, metrics.variant_report(df, ["g"], "t", "s").collect()))
    assert [x.count() for x in seen] == [24]
    monkeypatch.setattr(metrics, "SMALL_BYTES", 0)
    assert sorted(map(str, metrics.variant_report(df, ["g"], "t", "s").collect())) == small
    assert len(seen) == 2 and hasattr(seen[1], "table_path")
