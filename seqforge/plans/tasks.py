"""The three evaluation tasks as lineages: genes (binary probe), enzymes (classes), variants (ranks)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features
from ..functions.sequences import assay_check, enzyme_windows, gene_windows, parse_mutant, scoreable
from ..operators import metrics, probes, tensors, vectors
from ..operators.control import TaskResult, run_tasks
from ..operators.reuse import Reuse, plan
from ..sources.shared import dropped, written


def gene_vectors(genes: DataFrame, key: str, seq: str, k: int, width: int | None) -> DataFrame:
    """key, vec: mean of the k-mer frequencies of a gene's windows. Windows are cut and counted in one
    pass and averaged without a pair of rows ever meeting but those of one gene."""
    cut = genes.select(key, F.explode(gene_windows(F.col(seq), width)).alias("window"))
    return vectors.window_mean(features.kmer_vectors(cut, key, "window", k), [key])


def essentiality(genes: DataFrame, k: int = 3, width: int | None = 1000, key: str = "doc_id", seq: str = "seq", group: str = "genome", label: str = "essential") -> DataFrame:
    """group, n_genes, n_essential, scored, auroc, auprc of the test rows, probed on the training rows."""
    vec = gene_vectors(genes, key, seq, k, width)
    joined = genes.select(key, group, label, "split").join(vec, key)
    out = probes.probe(joined, label, F.col("split") == "train", tol=1e-6)
    return metrics.group_report(out, [group], label, "prob")


def enzyme_classes(rows: DataFrame, k: int = 3, width: int | None = None, policy: str = "window", key: str = "row_idx") -> DataFrame:
    """macro_f1, accuracy, n_classes of the test rows."""
    cut = rows.select(key, F.explode(enzyme_windows(F.col("sequence"), width, policy)).alias("window"))
    vec = vectors.window_mean(features.kmer_vectors(cut, key, "window", k), [key])
    out = probes.probe(rows.select(key, "label", "split").join(vec, key), "label", F.col("split") == "train", scale=False, multiclass=True, tol=1e-6)
    return metrics.macro_f1(out, "label", "predicted")


def variant_effects(variants: DataFrame, score: F.Column, max_context: int | None = None) -> DataFrame:
    """Per-assay metrics of a score column over variants, those over the context left without a score."""
    kept = F.when(F.lit(True) if max_context is None else F.length("sequence") <= max_context, score)
    return metrics.variant_report(variants.withColumn("_score", kept), ["dms_id", "rna_type"], "dms_score", "_score")


def variant_items(variants: DataFrame) -> DataFrame:
    """Scoreable variants with their assay's reference, rebuilt from the variants themselves."""
    parsed = variants.where(scoreable(F.col("mutant"))).withColumn("mutations", parse_mutant(F.col("mutant")))
    refs = assay_check(parsed)
    bad = refs.where("n_bad > 0 OR n_references <> 1").limit(1).collect()
    if bad:
        raise ValueError(f"assay {bad[0].dms_id}: its variants do not lead back to one reference")
    return parsed.join(F.broadcast(refs.select("dms_id", "reference")), "dms_id")  # one row an assay


class _Probed:
    """A task that probes the vectors of its rows. ``sweep``: every layer is probed, and the best of those that
    carry something is the result. Tasks of one ``corpus`` that cut it into the same windows share a pass."""

    alternatives = [["embed"]]
    head, score = "vectors", "score"

    def __init__(self, name: str, load, corpus: str | None = None, sweep: bool = False, key: str = "doc_id", manifest: str | None = None):
        self.name, self.load, self.corpus, self.sweep, self.key, self.manifest = name, load, corpus or name, sweep, key, manifest
        self.layers = "all" if sweep else "last"

    def prepare(self, spark):
        return self.load(spark)

    def windows(self, model):
        raise NotImplementedError

    def measure(self, rows: DataFrame) -> dict[int, dict[str, float]]:
        """Metrics of each layer of the rows with their vectors, whose jobs do not grow with the layers."""
        raise NotImplementedError

    def cut(self, model, rows: DataFrame) -> DataFrame:
        """key, at, window"""
        return rows.select(self.key, F.posexplode(self.windows(model)).alias("at", "window"))

    def run(self, model, chosen, rows, reuse=None) -> TaskResult:
        reuse = reuse or Reuse(plan([self]))
        vec = reuse.vectors(self.corpus, model, self.cut(model, rows), rows, self.key, self.layers)
        if not self.sweep:
            (found,) = self.measure(rows.join(vec, self.key)).values()
            return TaskResult(self.name, "ok", self.score, found, {"embedding_dim": vec.select("vec.size" if vectors.is_sparse(vec) else F.size("vec")).first()[0]})
        found, health = sweep(rows, vec, self.key, self.measure)
        best, more = choose_layer(rows.sparkSession, found, health, self.score)
        return TaskResult(self.name, "ok", self.score, more, {"best_layer": best["best_layer"], "considered": best["considered"], "excluded": best["excluded"], "would_have_picked": best["would_have_picked"], "depth_health_measured": health is not None})


def sweep(rows: DataFrame, vec: DataFrame, key: str, measure) -> tuple[dict[int, dict[str, float]], DataFrame | None]:
    """Metrics of each layer, and the layers' health: None where it cannot be measured, as of one layer alone."""
    found = measure(rows.join(vec, key))
    if len(found) < 2 or vec.select(F.size("vec").alias("n")).distinct().count() > 1:
        return found, None
    return found, vectors.depth_health(vec, key)


def _of_layers(df: DataFrame) -> dict[int, dict]:
    """The rows of a table of metrics, which has a row a layer."""
    return {r.layer_id: {k: v for k, v in r.asDict().items() if k != "layer_id"} for r in df.collect()}


def choose_layer(spark, found: dict[int, dict[str, float]], health: DataFrame | None, score: str) -> tuple[dict, dict[str, float]]:
    """The guarded best layer, and its metrics beside those of every layer."""
    scores = spark.createDataFrame([(k, None if m.get(score) is None else float(m[score])) for k, m in found.items()], "layer_id int, score double")
    best = vectors.best_layer(scores, health if health is not None else scores.select("layer_id", F.lit(False).alias("degenerate"))).first().asDict()
    wide = {f"layer_{k}_{n}": v for k, m in found.items() for n, v in m.items()}
    return best, wide | found[best["best_layer"]] | {"best_layer": float(best["best_layer"])}


class GeneTask(_Probed):
    """Essentiality as a task of the run loop: genes from prepare, any model that embeds."""

    score = "mean_auroc"

    def windows(self, model):
        return gene_windows(F.col("seq"), model.max_context)

    def measure(self, rows):
        out = probes.probe_all(rows.select("layer_id", "vec", "genome", "essential", "split"), "essential", F.col("split") == "train", tol=1e-8)
        by = ("layer_id",)
        report = _of_layers(metrics.macro(metrics.group_report(out, ["layer_id", "genome"], "essential", "prob"), ["auroc", "auprc"], by))
        pooled = _of_layers(metrics.confusion(out, "essential", "prob", by=by))
        out.unpersist()
        if not report or not all(r["n_scored"] for r in report.values()):
            raise ValueError("no genome has both classes")
        return {k: {n: float(v) for n, v in (report[k] | pooled[k]).items() if v is not None} for k in sorted(report)}


class LikelihoodTask(GeneTask):
    """Essentiality without a probe: genes ranked by the mean log-probability of their letters over all windows, to 12
    places, so that equal means tie."""

    alternatives = [["per_token"]]
    head = "logprobs"

    def run(self, model, chosen, rows, reuse=None) -> TaskResult:
        reuse = reuse or Reuse(plan([self]))
        z = reuse.logprobs(self.corpus, model, self.cut(model, rows), rows, self.key)
        total = z.groupBy(self.key).agg(F.sum(tensors.exact_sum(F.col("vec"))).alias("total"), F.sum(F.size("vec")).alias("n"))
        out = rows.select(self.key, "genome", "essential", "split").join(total.select(self.key, F.round(F.try_divide("total", "n"), 12).alias("mean")), self.key).where(F.col("split") == "test")
        report = metrics.macro(metrics.group_report(out, ["genome"], "essential", "mean"), ["auroc", "auprc"]).first().asDict()
        if not report["n_scored"]:
            raise ValueError("no genome has both classes")
        return TaskResult(self.name, "ok", self.score, {k: float(v) for k, v in report.items() if v is not None})


class EnzymeTask(_Probed):
    """Enzyme classes: a multinomial probe, scored by macro F1 over the test rows."""

    score = "macro_f1"

    def __init__(self, name: str, load, policy: str = "window", scale: bool = False, **more):
        super().__init__(name, load, **{"key": "row_idx"} | more)
        self.policy, self.scale = policy, scale

    def windows(self, model):
        return enzyme_windows(F.col("sequence"), model.max_context, self.policy)

    def measure(self, rows):
        out = probes.probe_all(rows.select("layer_id", "vec", "label", "split"), "label", F.col("split") == "train", scale=self.scale, multiclass=True, tol=1e-8)
        found = _of_layers(metrics.macro_f1(out, "label", "predicted", ("layer_id",)))
        out.unpersist()
        if not found:
            raise ValueError("there are no test rows")
        return {k: {n: float(v) for n, v in found[k].items()} for k in sorted(found)}


class VariantTask:
    """Variant effects: log-odds of masked sites if the model has them, else sequence scores. A variant is
    known by its assay and its number there; those over the model's context have no score."""

    alternatives = [["variant_llr"], ["score"]]

    def __init__(self, name: str, load, manifest: str | None = None):
        self.name, self.load, self.manifest = name, load, manifest

    def prepare(self, spark):
        return self.load(spark)

    def run(self, model, chosen, variants) -> TaskResult:
        known = variants.withColumn("_id", F.struct("dms_id", "variant_idx"))
        many = lambda *by: not known.groupBy(*by).count().where("count > 1").isEmpty()
        if many(F.xxhash64("dms_id", "variant_idx")) and many("dms_id", "variant_idx"):  # exact where hashes meet
            raise ValueError("a variant's number repeats within its assay")
        if chosen == ["variant_llr"]:
            items, limited = variant_items(known), F.col("reference")
            fits = F.lit(True) if model.max_context is None else F.length(limited) <= model.max_context
            scored = known.join(model.variant_llrs(items.where(fits), "_id").withColumnRenamed("llr", "s"), "_id", "left")
        else:
            fits = F.lit(True) if model.max_context is None else F.length("sequence") <= model.max_context
            scored = model.scores(known.where(fits), ["dms_id", "rna_type", "dms_score"], "sequence").withColumnRenamed("score", "s")
            if model.max_context is not None:
                scored = scored.unionByName(known.where(~F.coalesce(fits, F.lit(False))), allowMissingColumns=True)
        # written once: the metrics read the scores several times, the model runs once
        table = written(scored.select("dms_id", "rna_type", "dms_score", "s"), f"scores-{self.name}")
        report = metrics.variant_report(table, ["dms_id", "rna_type"], "dms_score", "s").persist()
        row = metrics.type_mean(report, "rna_type", ["spearman", "auc", "mcc"]).first().asDict()
        each = {f"{r.dms_id}_spearman": r.spearman for r in report.collect() if r.spearman is not None}  # a row an assay
        report.unpersist()
        dropped(table)
        if not each:
            raise ValueError("no assay could be scored")
        n = known.agg(F.count_if(~scoreable(F.col("mutant"))).alias("unscoreable"), F.count(F.lit(1)).alias("n")).first()
        return TaskResult(self.name, "ok", "spearman", {k: v for k, v in row.items() if v is not None} | each, {"n_variants": n.n, "n_unscoreable": n.unscoreable})


def kmer_floors(spark, tasks: list, ks=range(1, 7)) -> DataFrame:
    """task, k, value, status of tasks run on k-mer composition alone, for each k."""
    from ..models import KmerModel

    rows = []
    for k in ks:
        for t in run_tasks(KmerModel(k), tasks, spark)["tasks"]:
            rows.append((t["task"], k, t["metrics"].get(t["primary_metric"] or ""), t["status"]))
    return spark.createDataFrame(rows, "task string, k int, value double, status string")
