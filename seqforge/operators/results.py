"""Queries over run records in long form: boards, reference tables, comparisons, floors.

records: model, task, status, metric, value (one row for each metric), primary (the task's main metric).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAYER_METRIC = r"^layer_(\d+)_(.+)$"
SWEEP = "-layer-sweep"


def split_layer(metric: Column) -> tuple[Column, Column]:
    """(layer, metric) of a name such as layer_3_auroc; any other name has a null layer."""
    layer = F.when(metric.rlike(LAYER_METRIC), F.regexp_extract(metric, LAYER_METRIC, 1).cast("int"))
    return layer, F.when(layer.isNotNull(), F.regexp_extract(metric, LAYER_METRIC, 2)).otherwise(metric)


def shown(value: Column) -> Column:
    """Four decimals, or N/A."""
    return F.coalesce(F.format_string("%.4f", F.round(value, 4)), F.lit("N/A"))


def params_shown(n: Column) -> Column:
    return F.when(n >= 1e9, F.format_string("%.2fB", F.round(n / 1e9, 2))).otherwise(F.format_string("%.1fM", F.round(n / 1e6, 1)))


def short_hash(model: Column) -> Column:
    """Ten characters of a model's hash, without what precedes its first colon."""
    return F.substring(F.regexp_replace(model, r"^[^:]*:", ""), 1, 10)


def model_label(adapter: Column, version: Column, model: Column, name: Column) -> Column:
    """adapter@version (short hash), after the model's display name if it has one: never the same for two hashes
    that differ in those characters. Null if the adapter, version or hash is."""
    base = F.concat(adapter, F.lit("@"), version, F.lit(" ("), short_hash(model), F.lit(")"))
    return F.when(F.coalesce(name, F.lit("")) == "", base).otherwise(F.concat(name, F.lit(" \u00b7 "), base))


def explode_records(records: DataFrame) -> DataFrame:
    """Nested records to long form."""
    task = records.select(F.col("model_hash").alias("model"), F.explode("tasks").alias("t"))
    return task.select("model", "t.task", "t.status", F.col("t.primary_metric").alias("primary"), F.explode_outer("t.metrics").alias("metric", "value"))


def tidy(records: DataFrame, metrics: list[str]) -> DataFrame:
    """A row for each model and task, a column metric.<name> for each metric."""
    return records.groupBy("model", "task", "status").pivot("metric", metrics).agg(F.first("value")).select("model", "task", "status", *[F.col(m).alias(f"metric.{m}") for m in metrics])


def headline(records: DataFrame, tasks: DataFrame) -> DataFrame:
    """Mean of the primary metrics of the tasks that are ok, and coverage; null without any."""
    main = records.where("status = 'ok' AND metric = primary").select("model", "task", "value")
    return records.select("model").distinct().crossJoin(F.broadcast(tasks)).join(main, ["model", "task"], "left").groupBy("model").agg(F.avg("value").alias("headline"), F.count("value").alias("n_ok"), F.count(F.lit(1)).alias("n_tasks"))


def overall_board(records: DataFrame, tasks: DataFrame) -> DataFrame:
    """Models by headline, best first, those without last, equals by name."""
    w = Window.orderBy(F.col("headline").desc_nulls_last(), "model")
    return headline(records, tasks).withColumn("place", F.row_number().over(w))


def task_board(records: DataFrame, task: str, metrics: list[str], primary: str) -> DataFrame:
    own = records.where(F.col("task") == task)
    wide = own.groupBy("model", "status").pivot("metric", metrics).agg(F.first("value"))
    cell = lambda m: F.when(F.col("status") == "ok", shown(F.col(m))).when(F.col("status") == "na", "N/A").otherwise("ERROR").alias(f"shown_{m}")
    key = F.when(F.col("status") == "ok", F.col(primary))
    return wide.select("model", "status", *map(cell, [primary, *sorted(m for m in metrics if m != primary)]), F.row_number().over(Window.orderBy(key.desc_nulls_last(), "model")).alias("place"))


def long_reference(records: DataFrame, models: DataFrame) -> DataFrame:
    """model_id, task, metric, layer, is_primary, value of ok tasks, for known models."""
    layer, metric = split_layer(F.col("metric"))
    rows = records.where("status = 'ok'").select("model", "task", metric.alias("name"), layer.alias("layer"), ((F.col("metric") == F.col("primary"))).alias("is_primary"), "value")
    return rows.join(F.broadcast(models), "model").select("model_id", "task", F.col("name").alias("metric"), "layer", "is_primary", "value")


def last_and_best(reference: DataFrame) -> DataFrame:
    """For each model and task with a sweep: the last layer's score, the best and its tap."""
    w = Window.partitionBy("model_id", "base")
    layers = reference.where("layer IS NOT NULL").withColumn("base", F.regexp_replace("task", SWEEP + "$", "")).withColumn("top", F.max("layer").over(w))
    ranked = layers.withColumn("r", F.row_number().over(w.orderBy(F.col("value").desc_nulls_last(), "layer")))
    return ranked.groupBy("model_id", F.col("base").alias("task")).agg(F.max(F.when(F.col("layer") == F.col("top"), F.col("value"))).alias("last"), F.max(F.when(F.col("r") == 1, F.col("value"))).alias("best"), F.max(F.when(F.col("r") == 1, F.col("layer"))).alias("tap"), F.max(F.when(F.col("r") == 1, F.col("layer") / F.col("top"))).alias("relative_depth"))


def compare(ours: DataFrame, theirs: DataFrame, tolerance: Column, checked: Column) -> DataFrame:
    """For each task: shared, equal and missing values, worst difference, and whether it passes.

    Both sides: task, metric, layer, value. A checked metric that one side lacks fails its task."""
    key = ["task", "metric", "layer"]
    a = ours.select(*key, F.col("value").alias("x"))
    b = theirs.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("value").alias("y"))
    same = (F.col("task") == F.col("_task")) & (F.col("metric") == F.col("_metric")) & F.col("layer").eqNullSafe(F.col("_layer"))
    both = a.join(b, same, "full_outer").select(F.coalesce("task", "_task").alias("task"), F.coalesce("metric", "_metric").alias("metric"), "x", "y")
    gap = F.abs(F.col("x") - F.col("y"))
    good = ~checked | F.coalesce(gap <= tolerance, F.lit(False))
    return both.groupBy("task").agg(F.count(gap).alias("n_shared"), F.count_if(F.col("x") == F.col("y")).alias("n_equal"), F.count_if(gap.isNull()).alias("n_missing"), F.max(gap).alias("worst"), F.bool_and(good).alias("passes"))


def compare_taps(reference: DataFrame, candidate: DataFrame, tolerances: DataFrame, exact: bool = False, assays: tuple[str, ...] = ()) -> DataFrame:
    """task, n_shared, n_equal, n_missing, worst, reference_tap, tap, tap_ok, passes: each task of a reference
    against a candidate's.

    reference: task, metric, layer (null if of no layer), value, is_primary; candidate: the same but is_primary;
    tolerances: task, tolerance, 0 where there is none. Checked are the primary metric, of every layer too, and of
    ``assays`` each *_spearman: they must be there and within the tolerance, nulls only beside nulls. Where the
    reference has layers of the primary metric, both sides' ``best_layer`` must be one; another passes if the
    candidate's own score there is better than its score at the reference's by the tolerance at most. ``exact``
    allows no difference at all, of any metric. A task that the candidate lacks fails."""
    named = reference.groupBy("task").agg(F.max(F.when(F.col("is_primary"), F.col("metric"))).alias("_primary"))
    a = reference.select("task", "metric", "layer", F.col("value").alias("x"), F.lit(True).alias("_in_a"))
    b = candidate.select(F.col("task").alias("_task"), F.col("metric").alias("_metric"), F.col("layer").alias("_layer"), F.col("value").alias("y"), F.lit(True).alias("_in_b"))
    same = (F.col("task") == F.col("_task")) & (F.col("metric") == F.col("_metric")) & F.col("layer").eqNullSafe(F.col("_layer"))
    both = a.join(b, same, "full_outer").select(F.coalesce("task", "_task").alias("task"), F.coalesce("metric", "_metric").alias("metric"), F.coalesce("layer", "_layer").alias("layer"), "x", "y", F.coalesce("_in_a", F.lit(False)).alias("_in_a"), F.coalesce("_in_b", F.lit(False)).alias("_in_b"))
    rows = both.join(named, "task").join(tolerances, "task", "left").withColumn("_tol", F.lit(0.0) if exact else F.coalesce("tolerance", F.lit(0.0)))
    checked = (F.col("metric") == F.col("_primary")) | (F.col("task").isin(*assays) & F.col("metric").endswith("_spearman") & F.col("layer").isNull())
    shared, gap = F.col("_in_a") & F.col("_in_b"), F.abs(F.col("x") - F.col("y"))
    lacking = F.col("_in_a") & ~F.col("_in_b") & checked
    off = shared & F.when(F.col("x").isNull() | F.col("y").isNull(), ~F.col("x").eqNullSafe(F.col("y"))).otherwise(F.when(checked, gap > F.col("_tol")).otherwise(F.lit(exact) & (gap > 0)))
    best = (F.col("metric") == "best_layer") & F.col("layer").isNull()
    own = (F.col("metric") == F.col("_primary")) & F.col("layer").isNotNull()
    each = rows.groupBy("task").agg(
        F.count_if(shared).alias("n_shared"), F.count_if(shared & F.col("x").eqNullSafe(F.col("y"))).alias("n_equal"), F.count_if(lacking).alias("n_missing"),
        F.coalesce(F.max(F.when(shared & checked, gap)), F.lit(0.0)).alias("worst"), F.max(F.when(best, F.col("x"))).cast("int").alias("reference_tap"), F.max(F.when(best, F.col("y"))).cast("int").alias("tap"),
        F.count_if(own & F.col("_in_a")).alias("_layers"), F.count_if(off).alias("_off"), F.max("_tol").alias("_tol"), F.bool_or("_in_b").alias("_there"),
        F.map_from_entries(F.collect_list(F.when(own & F.col("_in_b"), F.struct("layer", "y")))).alias("_scores"),  # a number a layer
    )
    near = F.lit(False) if exact else F.coalesce(F.try_element_at("_scores", F.col("tap")) - F.try_element_at("_scores", F.col("reference_tap")) <= F.col("_tol"), F.lit(False))
    tap_ok = (F.col("_layers") == 0) | F.coalesce(F.col("reference_tap") == F.col("tap"), F.lit(False)) | (F.col("reference_tap").isNotNull() & F.col("tap").isNotNull() & near)
    judged = each.withColumn("tap_ok", tap_ok)
    return judged.select("task", "n_shared", "n_equal", "n_missing", "worst", "reference_tap", "tap", "tap_ok", (F.col("tap_ok") & (F.col("_off") == 0) & (F.col("n_missing") == 0) & F.col("_there")).alias("passes"))


def identify(records: DataFrame, models: DataFrame) -> DataFrame:
    """model_id of each record: by either hash, else by its display name."""
    by = lambda c, n: models.where(F.col(c).isNotNull()).select(F.col(c).alias(f"_{n}"), F.col("model_id").alias(f"id_{n}"))
    joined = records
    for n, (theirs, ours) in enumerate((("hash", "model"), ("other_hash", "model"), ("display_name", "name"))):
        joined = joined.join(by(theirs, n), joined[ours] == F.col(f"_{n}"), "left")
    return joined.select(*records.columns, F.coalesce("id_0", "id_1", "id_2").alias("model_id"))


def floor(scores: DataFrame, direction: int = 1) -> DataFrame:
    """The best k of each task among ok and finite values, the least k of equals."""
    fine = scores.where((F.col("status") == "ok") & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    w = Window.partitionBy("task").orderBy((F.col("value") * direction).desc(), "k")
    return fine.withColumn("r", F.row_number().over(w)).where("r = 1").select("task", "k", F.col("value").alias("floor"))


def inherit(floors: DataFrame, twins: DataFrame, measured: DataFrame | None = None, tolerance: float = 1e-12) -> DataFrame:
    """Floors with those of sweeps taken from their twins; a measured value must be the same."""
    taken = floors.join(F.broadcast(twins), floors.task == twins.twin).select(twins.task.alias("task"), "k", "floor")
    if measured is not None:
        off = taken.join(measured, "task").where(F.abs(F.col("floor") - F.col("value")) >= tolerance).limit(1).count()
        if off:
            raise ValueError("a sweep's own floor differs from its twin's")
    return floors.select("task", "k", "floor").unionByName(taken)


def merge_floors(held: DataFrame, new: DataFrame) -> DataFrame:
    """New floors replace those held of the same task."""
    return held.join(new.select("task").distinct(), "task", "left_anti").unionByName(new)


def headroom(scores: DataFrame, floors: DataFrame) -> DataFrame:
    return scores.join(F.broadcast(floors), "task", "left").withColumn("headroom", F.col("value") - F.col("floor"))


def markdown(rows: list[dict], columns: list[str]) -> str:
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *(line("N/A" if r[c] is None else f"{r[c]:.4f}" if isinstance(r[c], float) else r[c] for c in columns) for r in rows)]) + "\n"


def mixed_methods(scoring: DataFrame) -> DataFrame:
    """Tasks whose ok rows were scored in different ways, for a board's footnote.

    scoring: task, status, scoring_method."""
    ways = scoring.where("status = 'ok'").groupBy("task").agg(F.array_join(F.sort_array(F.collect_set("scoring_method")), ", ").alias("methods"), F.countDistinct("scoring_method").alias("n"))
    return ways.where("n > 1").select("task", "methods")


def assay_keys(report: DataFrame, prefix: str = "BLAT_ECOLX") -> DataFrame:
    """metric, value: each assay's correlation by name, and that of the first assay with the prefix."""
    named = report.where("spearman IS NOT NULL").select(F.concat("dms_id", F.lit("_spearman")).alias("metric"), F.col("spearman").alias("value"))
    first = report.where(F.col("dms_id").startswith(prefix)).agg(F.min_by("spearman", "dms_id").alias("value")).where("value IS NOT NULL").select(F.lit("breakout_spearman").alias("metric"), "value")
    return named.unionByName(first)
