"""Grouped ranking and classification metrics. Undefined values are null, never NaN."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Values that the optimiser takes to be of no more bytes than this are ranked with a group in one task.
SMALL_BYTES = 64 << 20
FAN = 16  # quantiles looked at in each of two steps: a group has up to FAN * FAN blocks


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join by keys that may be null."""
    named = right.withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(keys)})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    return left.join(named, same, "left").drop(*[f"_key{i}" for i in range(len(keys))])


def _small(df: DataFrame) -> bool:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES


def _counted(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by, columns and _n: how many rows each combination of them has. All ranks, medians and areas follow from these.

    Of a large table they are written once, for several readers, and the optimiser knows their size from the files."""
    each = df.groupBy(*by, *columns).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    return each if _small(df.select(*by, *columns)) else written(each, "counted")


def _blocks(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds ``_block``, which never falls as the value rises within its group, -1 for null.

    Blocks end at quantiles of the group's own distinct values, as one aggregate estimates them, so that neither
    outliers nor spikes fill one; which estimates they are changes the work alone, not what comes of it.
    """
    x, n = F.col(value).cast("double"), FAN * FAN
    sound = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    ends = rows.groupBy(*by).agg(F.percentile_approx(sound, [k / n for k in range(1, n)], 10 * n).alias("_q"))
    below = lambda part: F.size(F.filter(part, lambda q: q < x))
    coarse = below(F.array(*[F.get("_q", F.lit(FAN * k - 1)) for k in range(1, FAN)]))
    block = F.when(x.isNull(), -1).when(F.col("_q").isNull(), F.when(F.isnan(x) | (x > 0), 1).otherwise(0))
    out = _beside(rows, ends, by).withColumn("_c", coarse)
    return out.withColumn("_block", block.otherwise(F.col("_c") * FAN + below(F.slice("_q", F.col("_c") * FAN + 1, F.lit(FAN))))).drop("_q", "_c")


def _running(rows: DataFrame, by: list[str], value: str, sums: list[str], down: bool = False) -> DataFrame:
    """Adds before_<c> for each c of ``sums``: its sum over the group's rows of lower (higher if ``down``) values.

    Values are distinct within a group. A task holds a block of a group, or one number for each block of it; a
    small table needs no blocks, and has the same sums without."""
    order = F.desc if down else F.asc
    until = lambda keys, column: Window.partitionBy(*keys).orderBy(order(column)).rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c, keys, column: F.coalesce(F.sum(c).over(until(keys, column)), F.lit(0.0))
    if _small(rows):
        return rows.select("*", *[earlier(c, by, value).alias(f"before_{c}") for c in sums])
    rows = _blocks(rows, by, value)
    totals = rows.groupBy(*by, "_block").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    totals = totals.select(*by, "_block", *[earlier(f"_{c}", by, "_block").alias(f"_{c}") for c in sums])
    inside = rows.select("*", *[earlier(c, [*by, "_block"], value).alias(f"before_{c}") for c in sums])
    out = _beside(inside, totals, [*by, "_block"])
    return out.withColumns({f"before_{c}": F.col(f"before_{c}") + F.col(f"_{c}") for c in sums}).drop("_block", *[f"_{c}" for c in sums])


def group_median(df: DataFrame, by: list[str], column: str, name: str = "median", n: Column | None = None) -> DataFrame:
    """by and the exact median of each group's values, the mean of the middle two; nulls do not count. A row
    stands for ``n`` rows, one if there is no such column.

    The middle is found among running counts of distinct values, which blocks share between tasks."""
    each = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("_v")).agg(F.sum(F.lit(1.0) if n is None else n).alias("n"))
    ran = _running(each, by, "_v", ["n"])
    if _small(each):
        whole = ran.withColumn("_all", F.sum("n").over(Window.partitionBy(*by)))
    else:
        whole = _beside(ran, each.groupBy(*by).agg(F.sum("n").alias("_all")), by)
    at = lambda place: F.max(F.when((F.col("before_n") <= place) & (place < F.col("before_n") + F.col("n")), F.col("_v")))
    lower, upper = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    return whole.groupBy(*by).agg(((at(lower) + at(upper)) / 2).alias(name))


def average_rank(df: DataFrame, by: list[str], value: str, rank: str, n: Column | None = None) -> DataFrame:
    """by, value and its rank within the group, ties sharing the mean of theirs: a row a distinct value."""
    each = df.groupBy(*by, value).agg(F.sum(F.lit(1.0) if n is None else n).alias("n"))
    return _running(each, by, value, ["n"]).select(*by, value, (F.col("before_n") + (F.col("n") + 1) / 2).alias(rank))


def finite(column: str | Column, what: str) -> Column:
    """The column, raising where it is NaN."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(F.isnan(column.cast("double")), F.raise_error(F.lit(f"a {what} is NaN"))).otherwise(column)


def _distinct_scores(df: DataFrame, by: list[str], label: str, score: str, n: Column | None = None) -> DataFrame:
    """Positives and rows of each distinct score: what the windows below see, whatever the ties."""
    n = F.lit(1.0) if n is None else n
    return df.withColumn(score, finite(score, "score")).groupBy(*by, score).agg(F.sum(F.col(label).cast("double") * n).alias("pos"), F.sum(n).alias("n"))


def auroc(df: DataFrame, by: list[str], label: str, score: str, n: Column | None = None) -> DataFrame:
    """Area under the ROC curve by ranks; null with one class only. A row stands for ``n`` rows."""
    ranked = _running(_distinct_scores(df, by, label, score, n).withColumn("neg", F.col("n") - F.col("pos")), by, score, ["neg"])
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    return ranked.groupBy(*by).agg(F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("auroc"))


def average_precision(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """Precision summed over steps of recall, ties being one threshold; null with one class only."""
    ranked = _running(_distinct_scores(df, by, label, score), by, score, ["pos", "n"], down=True)
    ranked = ranked.withColumn("tp", F.col("before_pos") + F.col("pos")).withColumn("seen", F.col("before_n") + F.col("n"))
    both = (F.sum("pos") > 0) & (F.sum("pos") < F.sum("n"))
    return ranked.groupBy(*by).agg(F.when(both, F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("seen")), F.sum("pos"))).alias("auprc"))


def group_report(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """Sizes and both curve areas of each group; groups of one class are not scored."""
    size = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_genes"), F.sum(F.col(label).cast("long")).alias("n_essential"))
    out = size.join(auroc(df, by, label, score), by).join(average_precision(df, by, label, score), by)
    return out.select(*by, "n_genes", "n_essential", F.col("auroc").isNotNull().alias("scored"), "auroc", "auprc")


def macro(df: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Mean and median of each column over the groups that have it, and how many have none."""
    return df.groupBy(*by).agg(*[f(c).alias(f"{name}_{c}") for c in columns for name, f in (("mean", F.avg), ("median", F.median))], F.count_if(F.col(columns[0]).isNull()).alias("n_excluded"), F.count(columns[0]).alias("n_scored"))


def confusion(df: DataFrame, label: str, prob: str, threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    said, is_ = finite(prob, "probability") >= threshold, F.col(label) == 1
    counts = df.groupBy(*by).agg(F.count_if(said & is_).alias("tp"), F.count_if(said & ~is_).alias("fp"), F.count_if(~said & ~is_).alias("tn"), F.count_if(~said & is_).alias("fn"))
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    ratio = F.try_divide
    return counts.select(*by, "tp", "fp", "tn", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tn, tn + fp).alias("specificity"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"))


def macro_f1(df: DataFrame, truth: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean F1 over all classes that are true or predicted anywhere (0 where undefined), and accuracy."""
    cells = df.groupBy(*by, F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    sides = cells.select(*by, F.explode(F.array(F.struct(F.col("t").alias("c"), F.col("n").alias("true"), F.lit(0.0).alias("said")), F.struct(F.col("p").alias("c"), F.lit(0.0).alias("true"), F.col("n").alias("said")))).alias("s"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0.0).alias("hit"))
    classes = sides.groupBy(*by, "s.c").agg(F.sum("s.true").alias("true"), F.sum("s.said").alias("said"), (F.sum("hit") / 2).alias("tp"))
    return classes.groupBy(*by).agg(F.avg(F.coalesce(F.try_divide(2 * F.col("tp"), F.col("true") + F.col("said")), F.lit(0.0))).alias("macro_f1"), F.try_divide(F.sum("tp"), F.sum("true")).alias("accuracy"), F.count(F.lit(1)).alias("n_classes"))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Absolute rank correlation, ties sharing ranks; null if either side is constant."""
    return _spearman(_counted(df, by, [x, y]), by, x, y)


def _spearman(pairs: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Of counted pairs. Ranks are taken from their mean, (rows + 1) / 2, so that sums of products are the covariances."""
    n = F.col("_n")
    if _small(pairs):
        rank = lambda c: F.sum(n).over(Window.partitionBy(*by).orderBy(c)) - (F.sum(n).over(Window.partitionBy(*by, c)) - 1) / 2
        ranked = pairs.select(*by, "_n", rank(x).alias("rx"), rank(y).alias("ry"), F.sum(n).over(Window.partitionBy(*by)).alias("_all"))
    else:
        ranked = _beside(_beside(pairs, average_rank(pairs, by, x, "rx", n), [*by, x]), average_rank(pairs, by, y, "ry", n), [*by, y])
        ranked = _beside(ranked, pairs.groupBy(*by).agg(F.sum(n).alias("_all")), by)
    dx, dy = (F.col(c) - (F.col("_all") + 1) / 2 for c in ("rx", "ry"))
    varied = (F.max("rx") > F.min("rx")) & (F.max("ry") > F.min("ry"))
    corr = F.try_divide(F.sum(n * dx * dy), F.sqrt(F.sum(n * dx * dx)) * F.sqrt(F.sum(n * dy * dy)))
    return ranked.groupBy(*by).agg(F.when(varied, F.abs(corr)).alias("spearman"), F.sum(n).cast("long").alias("n_variants"))


def _split(df: DataFrame, by: list[str], column: str, inclusive: bool) -> DataFrame:
    middle = group_median(df, by, column, f"{column}_median", F.col("_n"))
    high = F.col(column) >= F.col(f"{column}_median") if inclusive else F.col(column) > F.col(f"{column}_median")
    return df.join(middle, by).withColumn(f"{column}_high", high.cast("int"))


def median_auc(df: DataFrame, by: list[str], truth: str, score: str, inclusive: bool = True) -> DataFrame:
    """AUROC against the truth split at its median, whichever way round is larger."""
    return _median_auc(_counted(df, by, [truth, score]), by, truth, score, inclusive)


def _median_auc(pairs: DataFrame, by: list[str], truth: str, score: str, inclusive: bool = True) -> DataFrame:
    out = auroc(_split(pairs, by, truth, inclusive), by, f"{truth}_high", score, F.col("_n"))
    return out.select(*by, F.greatest("auroc", 1 - F.col("auroc")).alias("auc"))


def median_mcc(df: DataFrame, by: list[str], truth: str, score: str, inclusive: bool = True) -> DataFrame:
    """Absolute Matthews correlation of both sides split at their medians; null with an empty side."""
    return _median_mcc(_counted(df, by, [truth, score]), by, truth, score, inclusive)


def _median_mcc(pairs: DataFrame, by: list[str], truth: str, score: str, inclusive: bool = True) -> DataFrame:
    both = _split(_split(pairs, by, truth, inclusive), by, score, inclusive)
    t, s = F.col(f"{truth}_high") == 1, F.col(f"{score}_high") == 1
    counts = both.groupBy(*by).agg(*[F.sum(F.when(c, F.col("_n")).otherwise(0.0)).alias(n) for n, c in (("tp", t & s), ("fp", ~t & s), ("tn", ~t & ~s), ("fn", t & ~s))])
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.select(*by, F.abs(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))).alias("mcc"))


def type_mean(df: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """The mean over kinds of the means within a kind; a kind without any value makes it null."""
    within = df.groupBy(kind).agg(*[F.avg(c).alias(c) for c in columns])
    return within.agg(*[F.when(F.count(c) == F.count(F.lit(1)), F.avg(c)).alias(c) for c in columns])


def variant_report(df: DataFrame, by: list[str], truth: str, score: str) -> DataFrame:
    """All metrics of each assay, over the variants that have a score."""
    pairs, lacks = _counted(df, by, [truth, score]), F.col(score).isNull()
    scored = pairs.where(~lacks)
    rows = lambda c: F.sum(F.when(c, F.col("_n")).otherwise(0.0)).cast("long")
    size = pairs.groupBy(*by).agg(rows(~lacks).alias("n_variants"), rows(lacks).alias("n_missing"))
    return size.join(_spearman(scored, by, truth, score).drop("n_variants"), by, "left").join(_median_auc(scored, by, truth, score), by, "left").join(_median_mcc(scored, by, truth, score), by, "left")


def score_summary(df: DataFrame, score: str) -> DataFrame:
    """mean, least, most of a score; no rows or a NaN raise."""
    x = finite(score, "score")
    none = F.raise_error(F.lit("there are no scores"))
    return df.agg(F.when(F.count(F.lit(1)) > 0, F.avg(x)).otherwise(none).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most"))
