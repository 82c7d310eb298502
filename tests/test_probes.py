from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqforge.operators import probes, results


def rows_of(layers, n=120, width=4, classes=2, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(layers):
        x = rng.normal(size=(n, width + k)) * (k + 1) + 1
        y = np.digitize(x[:, 0] - 1 + rng.normal(size=n) * (k + 1) * 0.7, [-0.4 * (k + 1), 0.6 * (k + 1)] if classes == 3 else [0.0])
        out += [(i, 2 * k, int(y[i]), f"c{y[i]}", x[i].tolist()) for i in range(n)]
    return out


SCHEMA = "i int, layer_id int, y int, label string, vec array<double>"


def newton(x, y, scale):
    """The least of sum(loss) + |w|^2 / 2 on the first 90 rows, and what it says of the others."""
    a = x[:90]
    mean, sd = (a.mean(0), a.std(0)) if scale else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.column_stack(((x - mean) / sd, np.ones(len(x))))
    b, w, reg = z[:90], np.zeros(z.shape[1]), np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-b @ w))
        w -= np.linalg.solve(b.T @ (b * (p * (1 - p))[:, None]) + reg + 1e-12 * np.eye(len(w)), b.T @ (p - y[:90]) + reg @ w)
    return 1 / (1 + np.exp(-z[90:] @ w))


def steepest(x, y, kinds):
    """The same of several classes, by many small steps."""
    z, w = np.column_stack((x, np.ones(len(x)))), np.zeros((kinds, x.shape[1] + 1))
    b, hot = z[:90], np.eye(kinds)[y[:90]]
    for _ in range(60_000):
        m = b @ w.T
        p = np.exp(m - m.max(1, keepdims=True))
        w -= 2e-3 * ((p / p.sum(1, keepdims=True) - hot).T @ b + np.c_[w[:, :-1], np.zeros(kinds)])
    return (z[90:] @ w.T).argmax(1)


@pytest.mark.parametrize("scale", [True, False])
def test_all_layers_at_once_are_the_probes_of_each(spark, scale):
    rows = rows_of(3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r.layer_id, r.i): r.prob for r in probes.probe_all(df, "y", F.col("i") < 90, scale=scale, tol=1e-7).collect()}
    assert len(got) == 90
    for k in (0, 2, 4):
        own = [r for r in rows if r[1] == k]
        want = newton(np.array([r[4] for r in own]), np.array([r[2] for r in own]), scale)
        assert [got[k, 90 + i] for i in range(30)] == pytest.approx(want.tolist(), abs=1e-5)


def test_all_layers_of_several_classes(spark):
    rows = rows_of(2, classes=3)
    got = {(r.layer_id, r.i): r.predicted for r in probes.probe_all(spark.createDataFrame(rows, SCHEMA), "label", F.col("i") < 90, scale=False, multiclass=True, tol=1e-7).collect()}
    for k in (0, 2):
        own = [r for r in rows if r[1] == k]
        assert [got[k, 90 + i] for i in range(30)] == [f"c{c}" for c in steepest(np.array([r[4] for r in own]), np.array([r[2] for r in own]), 3)]
    lacking = spark.createDataFrame([(i, k, 0, f"c{i % (3 if k else 2)}", [float(i % (3 if k else 2)), 1.0]) for i in range(60) for k in (0, 2)], SCHEMA)
    out = probes.probe_all(lacking, "label", F.col("i") < 40, scale=False, multiclass=True, tol=1e-8)
    assert {(r.layer_id, r.label, r.predicted) for r in out.collect()} == {(0, "c0", "c0"), (0, "c1", "c1"), *((2, f"c{j}", f"c{j}") for j in range(3))}


def test_jobs_do_not_grow_with_the_layers(spark):
    def jobs(layers):
        one = rows_of(1)
        df = spark.createDataFrame([(i, k, y, label, v) for k in range(layers) for i, _, y, label, v in one], SCHEMA).coalesce(2)
        spark.sparkContext.setJobGroup(f"layers-{layers}", "")
        probes.probe_all(df, "y", F.col("i") < 90, tol=1e-6).unpersist()
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"layers-{layers}"))
        spark.sparkContext.setJobGroup("other", "")
        return found

    few, many = jobs(1), jobs(12)
    assert few == many < 120


def test_what_cannot_be_fitted(spark):
    df = spark.createDataFrame(rows_of(1), SCHEMA)
    for bad, train, what in ((df, F.lit(False), "no training rows"), (df.withColumn("y", F.lit(1)), F.lit(True), "one class"), (df.withColumn("y", F.col("y") + 1), F.lit(True), "0 and 1")):
        with pytest.raises(ValueError, match=what):
            probes.probe_all(bad, "y", train)


def test_a_search_finds_the_least_of_a_quadratic():
    a, b = np.diag([1.0, 30.0, 500.0]), np.array([1.0, -2.0, 3.0])
    search = probes.minimise(np.zeros(3), 1e-10, 200)
    w = next(search)
    try:
        while True:
            w = search.send((w @ a @ w / 2 - b @ w, a @ w - b))
    except StopIteration as end:
        assert end.value == pytest.approx(b / np.diag(a), abs=1e-8)


def judged(spark, reference, candidate, exact=False, tol=0.1):
    ref = spark.createDataFrame([("t", *r) for r in reference], "task string, metric string, layer int, value double, is_primary boolean")
    own = spark.createDataFrame([("t", *r) for r in candidate], "task string, metric string, layer int, value double")
    return results.compare_taps(ref, own, spark.createDataFrame([("t", tol)], "task string, tolerance double"), exact, assays=("t",)).first()


def test_best_taps(spark):
    ref = [("s", 0, 0.5, True), ("s", 1, 0.58, True), ("s", 2, 0.6, True), ("s", None, 0.6, True), ("best_layer", None, 2.0, False), ("n", None, 7.0, False), ("a_spearman", None, None, False)]
    plain = [r[:3] for r in ref]
    same = judged(spark, ref, plain)
    assert (same.passes, same.n_shared, same.n_equal, same.n_missing, same.worst) == (True, 7, 7, 0, 0.0) and judged(spark, ref, plain, exact=True).passes
    change = lambda **new: [(m, k, new.get(f"{m}_{k}", v)) for m, k, v in plain]
    near = change(s_1=0.65, best_layer_None=1.0)
    r = judged(spark, ref, near)
    assert r.passes and r.tap_ok and (r.reference_tap, r.tap) == (2, 1) and not judged(spark, ref, near, exact=True).passes
    far = judged(spark, ref, change(s_1=0.65, s_2=0.54, best_layer_None=1.0))
    assert not far.tap_ok and not far.passes and far.worst <= 0.1
    assert not judged(spark, ref, change(s_0=0.7)).passes
    other = judged(spark, ref, change(n_None=9.0))
    assert other.passes and not judged(spark, ref, change(n_None=9.0), exact=True).passes
    assert not judged(spark, ref, change(a_spearman_None=0.1)).passes
    lacking = judged(spark, ref, [r for r in plain if r[:2] != ("s", 1)])
    assert lacking.n_missing == 1 and not lacking.passes
    assert not judged(spark, ref, [r for r in plain if r[0] != "best_layer"]).tap_ok
    assert not judged(spark, ref, []).passes
    flat = [("s", None, 0.6, True), ("n", None, 1.0, False)]
    assert judged(spark, flat, [r[:3] for r in flat]).tap_ok


def test_vectors_of_many_kmers_are_held_by_what_is_not_zero(spark):
    """Windows averaged, standardised and probed as dense vectors would be, by both kinds of probe."""
    from seqforge.models import KmerModel
    from seqforge.operators import vectors

    letters = np.random.default_rng(5).choice(list("ACGT"), (40, 2, 30), p=[0.4, 0.3, 0.2, 0.1])
    rows = [(i, i % 2, w, "".join(letters[i, w]) if (i, w) != (3, 0) else "AC" if i % 2 else "N") for i in range(40) for w in range(1 + i % 3 % 2)]
    cut = spark.createDataFrame(rows, "id int, y int, at int, window string")
    model = KmerModel(4)
    sparse = vectors.window_mean(model.sparse_outputs(cut, ["id", "at"], "window"), ["id", "layer_id"])
    dense = vectors.window_mean(model.outputs(cut, ["id", "at"], "window"), ["id", "layer_id"])
    assert model.sparse and vectors.is_sparse(sparse) and not vectors.is_sparse(dense)
    want = {r.id: np.array(r.vec) for r in dense.collect()}
    for r in sparse.collect():
        assert r.vec.size == 256 and len(r.vec.at) <= 60
        full = np.zeros(256)
        full[r.vec.at] = r.vec.x
        assert np.allclose(full, want[r.id], atol=1e-15)
    labels = cut.select("id", "y").distinct()
    for more, column in ((dict(), "prob"), (dict(multiclass=True, scale=False), "predicted")):
        got, exact = ({r.id: r[column] for r in probes.probe_all(labels.join(v, "id"), "y", F.col("id") % 4 != 0, tol=1e-9, **more).collect()} for v in (sparse, dense))
        assert got.keys() == exact.keys() and len(got) == 10
        assert got == exact if column == "predicted" else all(abs(got[k] - exact[k]) < 1e-5 for k in got)


def test_a_search_ends_where_values_differ_by_round_off(spark):
    """Separable rows, many of each kind: it took 30,581 evaluations, each of them a job."""
    from seqforge.models import KmerModel

    kinds = [(a, b) for a in (0, 1) for b in range(5)]
    n, y = np.full(10, 3000.0), np.array([a for a, _ in kinds], float)
    x = KmerModel(1).embed([("ACAAC" if a else "TGTTG") * (b + 10) for a, b in kinds])[:, 0]
    z = np.c_[(x - n @ x / n.sum()) / np.where(x.std(axis=0) > 1e-12, x.std(axis=0), 1.0), np.ones(10)]
    search = probes.minimise(np.zeros(5), 1e-8, 1000)
    w, calls = next(search), 0
    with pytest.raises(StopIteration):
        while calls < 200:
            m = z @ w
            value, slope = (n * (np.logaddexp(0, m) - y * m)).sum() + (w[:-1] ** 2).sum() / 2, z.T @ (n * (1 / (1 + np.exp(-m)) - y)) + np.r_[w[:-1], 0]
            calls += 1
            w = search.send((value, slope))
    assert calls < 60
