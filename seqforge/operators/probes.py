"""Linear probes on dense features, by MLlib, with the objective C * sum(loss) + |w|^2 / 2."""

from __future__ import annotations

from collections.abc import Generator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors

MAX_ITER, TOL, C = 1000, 1e-9, 1.0
#: Bytes of training features that one task of a fit takes.
FIT_BYTES = 32 << 20


def _scaled(made: DataFrame, scale: bool) -> tuple[DataFrame, int]:
    """The rows with features standardised by their training rows, if asked for; how many those are."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    fit = made.where("_train").agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("features")).alias("m")).select(vector_to_array("m.mean").alias("mean"), vector_to_array("m.variance").alias("var"), F.col("m.count").alias("n")).first()
    if fit is None or not fit.n:
        raise ValueError("there are no training rows")
    if scale:
        n = fit.n
        sd = [(v * (n - 1) / n) ** 0.5 or 1.0 for v in fit["var"]]
        mean, by = F.array(*map(F.lit, fit["mean"])), F.array(*map(F.lit, sd))
        if len(sd) <= 256:
            z = F.zip_with(F.zip_with(vector_to_array("features"), mean, lambda x, m: x - m), by, lambda x, s: x / s)
            made = made.withColumn("features", array_to_vector(z))
        else:
            stats = made.sparkSession.createDataFrame([(fit["mean"], sd)], "mean array<double>, sd array<double>")
            made = made.crossJoin(F.broadcast(stats))  # one row of as many numbers as there are features
            z = F.zip_with(F.zip_with(vector_to_array("features"), F.col("mean"), lambda x, m: x - m), F.col("sd"), lambda x, s: x / s)
            made = made.withColumn("features", array_to_vector(z)).drop("mean", "sd")
    return made, fit.n


def probe(df: DataFrame, label: str, train: F.Column, vec: str = "vec", c: float = C, scale: bool = True, multiclass: bool = False, max_iter: int = MAX_ITER, tol: float = TOL) -> DataFrame:
    """The rows that are not for training, without ``vec``, with prob (of label 1) or predicted (the class).

    The source is read once: features are cached while the probe is fitted and applied, and the result, a few
    columns of the test rows, is cached until the caller unpersists it."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    held = df.withColumn("features", array_to_vector(F.col(vec).cast("array<double>"))).withColumn("_train", train).cache()  # read by the statistics, the fit and the result
    try:
        made, n = _scaled(held, scale)
        width = made.select(F.size(vec)).first()[0]
        fit_on = made.where("_train").coalesce(n * width * 8 // FIT_BYTES + 1)  # each step is a job: no more tasks than the numbers fill
        kinds = fit_on.select(label).distinct().limit(2).count()
        if kinds < 2:
            raise ValueError("the training rows are of one class")
        common = dict(featuresCol="features", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol)
        if not multiclass:
            model = LogisticRegression(labelCol="_y", family="binomial", **common).fit(fit_on.withColumn("_y", F.col(label).cast("double")))
            out = model.transform(made.where("NOT _train")).withColumn("prob", vector_to_array("probability")[1])
        else:
            index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="skip").fit(fit_on.withColumn(label, F.col(label).cast("string")))
            model = LogisticRegression(labelCol="_y", family="multinomial", **common).fit(index.transform(fit_on.withColumn(label, F.col(label).cast("string"))))
            names = F.array(*map(F.lit, index.labels))
            out = model.transform(made.where("NOT _train")).withColumn("predicted", names[F.col("prediction").cast("int")])
        out = out.drop(vec, "features", "_train", "_y", "rawPrediction", "probability", "prediction").persist()
        out.count()
        return out
    finally:
        held.unpersist()


def probe_layers(emb: DataFrame, layers: list[int], evaluate, threads: int = 4) -> list[tuple[int, float]]:
    """(layer, evaluate(rows of the layer)) for each, a few fits at a time on one cached table."""
    emb = emb.cache()
    try:
        with ThreadPoolExecutor(threads) as pool:
            return list(zip(layers, pool.map(lambda k: evaluate(emb.where(F.col("layer_id") == k)), layers)))
    finally:
        emb.unpersist()


#: Steps that a direction remembers, and halvings of a step before the search ends.
MEMORY, HALVINGS = 10, 40
#: What a sum of losses may be off by, as a part of it.
ROUND_OFF = 1e-12


def minimise(w: np.ndarray, tol: float, max_iter: int) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """A limited-memory quasi-Newton search as a coroutine: yields points, is sent (value, gradient), returns the least.

    Near the least, values differ by less than their round-off and cannot judge a step: there one is good if the slope
    along it is less, and a step that promises less than can be seen of the value ends the search."""
    f, g = yield w
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        if np.abs(g).max(initial=0.0) <= tol * max(1.0, abs(f)):
            break
        d, held = -g, []
        for s, y in reversed(steps):
            a = (s @ d) / (s @ y)
            d = d - a * y
            held.append(a)
        if steps:
            s, y = steps[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(steps, reversed(held)):
            d = d + s * (a - (y @ d) / (s @ y))
        if not d @ g < 0:
            d, steps = -g, []
        near = ROUND_OFF * max(1.0, abs(f))
        if -(d @ g) <= np.finfo(float).eps * near:
            break
        size = 1.0 if steps else 1.0 / max(1.0, np.abs(g).max())
        for _ in range(HALVINGS):
            at = w + size * d
            value, slope = yield at
            if value <= f + 1e-4 * size * (d @ g) or (value <= f + near and abs(slope @ d) <= 0.9 * abs(g @ d)):
                break
            size /= 2
        else:
            break  # no step is better: the numbers allow no less
        s, y = at - w, slope - g
        if s @ y > 1e-12 * (y @ y):
            steps = [*steps, (s, y)][-MEMORY:]
        w, f, g = at, value, slope
    return w


class Sparse:
    """Rows of which only the numbers that are not 0 are held."""

    def __init__(self, column: pa.StructArray):
        parts = dict(zip((f.name for f in column.type), column.flatten()))
        sizes = np.diff(parts["at"].offsets.to_numpy())
        self.rows, self.at = np.repeat(np.arange(len(column)), sizes), parts["at"].flatten().to_numpy()
        self.x, self.shape = parts["x"].flatten().to_numpy(), (len(column), parts["size"][0].as_py())

    def times(self, by: np.ndarray) -> np.ndarray:
        """rows x outputs of outputs x width."""
        return np.stack([np.bincount(self.rows, self.x * w[self.at], self.shape[0]) for w in by], axis=1)

    def onto(self, slope: np.ndarray) -> np.ndarray:
        """outputs x width of rows x outputs."""
        return np.stack([np.bincount(self.at, self.x * s[self.rows], self.shape[1]) for s in slope.T])


def _times(x, by: np.ndarray) -> np.ndarray:
    return x.times(by) if isinstance(x, Sparse) else x @ by.T


def _onto(slope: np.ndarray, x) -> np.ndarray:
    return x.onto(slope) if isinstance(x, Sparse) else slope.T @ x


def _by_layer(batch: pa.RecordBatch, names: list[str]):
    """(layer, its rows, their vectors as a matrix) for each layer of a batch."""
    layer = batch[names[0]].to_numpy()
    for k in np.unique(layer).tolist():
        at = np.flatnonzero(layer == k)
        own = batch[names[1]].take(pa.array(at))
        if pa.types.is_struct(own.type):
            yield k, at, Sparse(own)
            continue
        yield k, at, own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)


def _margins(x: np.ndarray, w: np.ndarray, mean: np.ndarray, sd: np.ndarray, outputs: int) -> np.ndarray:
    """rows x outputs; w: outputs x (width + 1), of standardised features and a constant."""
    w = w.reshape(outputs, -1)
    by = w[:, :-1] / sd
    return _times(x, by) + (w[:, -1] - by @ mean)


def _sparse_moments(fit: DataFrame, layer: str, vec: str) -> list[dict]:
    """layer, n, kinds, mean and variance of each layer's sparse rows, the variance about the mean in a pass of its own.
    What differs by round-off alone has none."""
    sizes = fit.groupBy(layer).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("_y")).alias("kinds")).collect()  # a row a layer

    def summed(of):
        def run(batches):
            out: dict[int, np.ndarray] = {}
            for b in batches:
                for k, _, x in _by_layer(b, [layer, vec]):
                    out[k] = out.get(k, 0.0) + of(k, x)
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.list_(pa.float64()))], ["k", "v"])

        return _sums_by_layer(fit.select(layer, vec).mapInArrow(run, "k long, v array<double>"))

    n = {r[layer]: r.n for r in sizes}
    mean = {k: v / n[k] for k, v in summed(lambda k, x: np.bincount(x.at, x.x, x.shape[1])).items()}
    count = lambda x: np.bincount(x.at, minlength=x.shape[1])
    about = summed(lambda k, x: np.bincount(x.at, (x.x - mean[k][x.at]) ** 2, x.shape[1]) + (x.shape[0] - count(x)) * mean[k] ** 2)
    sound = {k: np.where(v / n[k] > (n[k] * np.finfo(float).eps * mean[k]) ** 2, v, 0.0) for k, v in about.items()}
    return [{layer: r[layer], "n": r.n, "kinds": r.kinds, "mean": mean[r[layer]], "var": sound[r[layer]] / max(1, r.n - 1)} for r in sizes]


def _sums_by_layer(parts: DataFrame) -> dict[int, np.ndarray]:
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = parts.groupBy("k").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).collect()  # a vector a layer
    return {r.k: np.array(r.v) for r in rows}


def probe_all(df: DataFrame, label: str, train: F.Column, layer: str = "layer_id", vec: str = "vec", c: float = C, scale: bool = True, multiclass: bool = False, max_iter: int = MAX_ITER, tol: float = TOL) -> DataFrame:
    """What ``probe`` gives of each layer's rows alone, for all layers of a table at once.

    Every layer is searched on its own, but one job evaluates the points that all of them ask for: tasks sum each
    layer's loss and slope over their rows, the sums meet by layer, and a vector for each layer reaches the driver.
    So there are as many jobs as the slowest layer takes steps, however many layers there are."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    held = df.withColumn("_train", train).withColumn("_y", (F.col(label) if multiclass else F.col(label).cast("int")).cast("string")).cache()
    try:
        fit = held.where("_train")
        sparse = vectors.is_sparse(df, vec)
        each = None if sparse else fit.groupBy(layer).agg(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(vec).cast("array<double>"))).alias("m"), F.sort_array(F.collect_set("_y")).alias("kinds"))
        found = _sparse_moments(fit, layer, vec) if sparse else [r.asDict() for r in each.select(layer, vector_to_array("m.mean").alias("mean"), vector_to_array("m.variance").alias("var"), F.col("m.count").alias("n"), "kinds").collect()]  # a row a layer
        if not found:
            raise ValueError("there are no training rows")
        if any(len(r["kinds"]) < 2 for r in found):
            raise ValueError("the training rows are of one class")
        kinds = sorted({k for r in found for k in r["kinds"]})
        if not multiclass and not set(kinds) <= {"0", "1"}:
            raise ValueError("labels of a binary probe are 0 and 1")
        outputs, code = (len(kinds), {k: i for i, k in enumerate(kinds)}) if multiclass else (1, {"0": 0, "1": 1})
        n = {r[layer]: r["n"] for r in found}
        mean = {r[layer]: np.array(r["mean"]) if scale else np.zeros(len(r["mean"])) for r in found}
        sd = {r[layer]: np.array([(v * (r["n"] - 1) / r["n"]) ** 0.5 or 1.0 for v in r["var"]]) if scale else np.ones(len(r["mean"])) for r in found}
        seen = {r[layer]: np.isin(kinds, r["kinds"]) for r in found}  # a class that a layer's rows lack is none of its own

        def sums(points: dict[int, np.ndarray]):
            def run(batches):
                out: dict[int, np.ndarray] = {}
                for b in batches:
                    y = np.array([code[v] for v in b["_y"].to_pylist()], np.int64)
                    for k, at, x in _by_layer(b, [layer, vec]):
                        if k not in points:
                            continue
                        own, m = y[at], _margins(x, points[k], mean[k], sd[k], outputs)
                        if multiclass:
                            m = np.where(seen[k], m, -np.inf)
                            top = m.max(axis=1, keepdims=True)
                            p = np.exp(m - top)
                            total = p.sum(axis=1, keepdims=True)
                            # no difference of near numbers, whose round-off would grow with the rows
                            i, rest, others = np.arange(len(own)), p.copy(), p.copy()
                            rest[i, m.argmax(axis=1)] = 0
                            others[i, own] = 0
                            loss = (np.log1p(rest.sum(axis=1)) + top[:, 0] - m[i, own]).sum()
                            slope = p / total
                            slope[i, own] = -others.sum(axis=1) / total[:, 0]
                        else:
                            way = np.where(own == 1, -1.0, 1.0)
                            z = way * m[:, 0]
                            loss = np.logaddexp(0, z).sum()
                            slope = (way / (1 + np.exp(-np.clip(z, -700, 700))))[:, None]
                        all_ = slope.sum(axis=0)
                        grad = np.concatenate(((_onto(slope, x) - np.outer(all_, mean[k])) / sd[k], all_[:, None]), axis=1)
                        out[k] = out.get(k, 0.0) + np.concatenate(([loss], grad.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.list_(pa.float64()))], ["k", "v"])

            parts = fit.select(layer, vec, "_y").mapInArrow(run, "k long, v array<double>")
            return _sums_by_layer(parts)

        def judged(k: int, w: np.ndarray, v: np.ndarray) -> tuple[float, np.ndarray]:
            free = w.reshape(outputs, -1).copy()
            free[:, -1] = 0
            return c * v[0] + (free**2).sum() / 2, c * v[1:] + free.ravel()

        searches = {k: minimise(np.zeros(outputs * (len(mean[k]) + 1)), tol, max_iter) for k in n}
        points, least = {k: next(s) for k, s in searches.items()}, {}
        while points:
            values = sums(points)
            for k in list(points):
                try:
                    points[k] = searches[k].send(judged(k, points[k], values[k]))
                except StopIteration as end:
                    least[k] = end.value
                    del points[k]

        names = [f for f in held.schema if f.name not in (vec, "_train", "_y")]

        def apply(batches):
            for b in batches:
                out = np.zeros(b.num_rows)
                known = np.zeros(b.num_rows, bool)
                for k, at, x in _by_layer(b, [layer, vec]):
                    if k not in least:
                        continue
                    m = _margins(x, least[k], mean[k], sd[k], outputs)
                    out[at] = np.where(seen[k], m, -np.inf).argmax(axis=1) if multiclass else 1 / (1 + np.exp(-np.clip(m[:, 0], -700, 700)))
                    known[at] = True
                made = pa.array([kinds[int(i)] if ok else None for i, ok in zip(out, known)], pa.string()) if multiclass else pa.array(out, mask=~known)
                yield pa.RecordBatch.from_arrays([*(b[f.name] for f in names), made], [*(f.name for f in names), "predicted" if multiclass else "prob"])

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in names), "predicted string" if multiclass else "prob double"])
        test = held.where("NOT _train").select(*[f"`{f.name}`" for f in names], vec)
        out = test.mapInArrow(apply, schema).persist()
        out.count()
        return out
    finally:
        held.unpersist()
