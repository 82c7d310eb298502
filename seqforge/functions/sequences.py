"""Sequence transforms as Column expressions: normalising, cutting, windowing, mutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROMOTER = 128
MIN_WINDOW, OVERLAP = 32, 32


def normalize(seq: Column) -> Column:
    """Without white space around it, in upper case, U read as T."""
    return F.translate(F.upper(F.regexp_replace(seq, r"^\s+|\s+$", "")), "U", "T")


def gene_extract(dna: Column, start: Column, end: Column, strand: Column, promoter: int = PROMOTER) -> Column:
    """The gene at 1-based inclusive start..end with its promoter: before it on the plus strand ("+" or a
    number > 0), after it on the minus strand, on both sides if the strand is unknown; clamped to the contig."""
    sign = strand.cast("string")
    strand = F.when(sign == "+", F.lit(1.0)).when(sign == "-", F.lit(-1.0)).otherwise(sign.try_cast("double"))
    before = F.when(strand.isNull() | (strand > 0), F.lit(promoter)).otherwise(F.lit(0))
    after = F.when(strand.isNull() | (strand <= 0), F.lit(promoter)).otherwise(F.lit(0))
    first = F.greatest(F.lit(1), start - before)
    last = F.least(F.length(dna), end + after)
    return F.upper(F.substring(dna, first, F.greatest(F.lit(0), last - first + 1)))


def window_count(length: Column, width: int, overlap: int = OVERLAP) -> Column:
    """How many windows of ``width`` with that overlap reach the end; 1 if it fits, 0 if it is empty."""
    step = max(1, width - overlap)
    return F.when(length <= 0, F.lit(0)).when(length <= width, F.lit(1)).otherwise(F.ceil((length - width) / F.lit(float(step))).cast("int") + 1)


def windows(seq: Column, width: int, overlap: int = OVERLAP) -> Column:
    """The windows as an array, in order."""
    step, n = max(1, width - overlap), window_count(F.length(seq), width, overlap)
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(seq, i * step + 1, F.lit(width)))
    return F.when(n > 0, each).otherwise(F.array().cast("array<string>"))


def central_window(seq: Column, width: int) -> Column:
    return F.when(F.length(seq) > width, F.substring(seq, F.floor((F.length(seq) - width) / 2).cast("int") + 1, F.lit(width))).otherwise(seq)


def _long_enough(seq: Column, width: int, overlap: int, least: int) -> Column:
    return F.filter(windows(seq, width, overlap), lambda w: F.length(w) >= least)


def gene_windows(seq: Column, width: int | None, overlap: int = OVERLAP, least: int = MIN_WINDOW) -> Column:
    """Windows long enough to embed; the whole gene if there is none or no width."""
    if width is None:
        return F.array(seq)
    kept = _long_enough(seq, width, overlap, least)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(seq))


def enzyme_windows(seq: Column, width: int | None, policy: str = "window", overlap: int = OVERLAP, least: int = MIN_WINDOW) -> Column:
    """Within the width the whole sequence; else its centre (truncate), or its long enough windows
    (window), or its centre if there is none. A width of 0 or none means that no limit is known."""
    if policy not in ("window", "truncate"):
        raise ValueError(f"unknown policy {policy!r}")
    if not width:
        return F.array(seq)
    centre = F.array(central_window(seq, width))
    if policy == "truncate":
        return centre
    kept = _long_enough(seq, width, overlap, least)
    return F.when(F.length(seq) <= width, F.array(seq)).when(F.size(kept) > 0, kept).otherwise(centre)


_SITE = "[ACGTUacgtu]0*+[1-9][0-9]{0,8}[ACGTUacgtu]"
_MUTANT = rf"^[,: ]*+{_SITE}(?:[ ]*+[,:][,: ]*+{_SITE})*+[,: ]*+$"


def scoreable(mutant: Column) -> Column:
    """Whether all of a mutant's sites can be scored; never null."""
    return F.coalesce(mutant.rlike(_MUTANT), F.lit(False))


def parse_mutant(mutant: Column) -> Column:
    """Mutations such as A1C:T4G as an array of (pos0, wt, mut); null unless all of it can be scored."""
    base = lambda x: F.translate(F.upper(x), "U", "T")
    site = lambda x: F.struct((F.substring(x, F.lit(2), F.length(x) - 2).cast("int") - 1).alias("pos0"), base(F.substring(x, 1, 1)).alias("wt"), base(F.substring(x, -1, 1)).alias("mut"))
    return F.when(scoreable(mutant), F.transform(F.regexp_extract_all(mutant, F.lit("[A-Za-z][0-9]+[A-Za-z]"), F.lit(0)), site))


def revert(seq: Column, mutations: Column) -> Column:
    """The sequence with its mutations undone, one after another."""
    return F.aggregate(mutations, seq, lambda s, x: F.overlay(s, x["wt"], x["pos0"] + 1, F.lit(1)))


def undo(seq: Column, mutations: Column) -> Column:
    """(s, ok): the sequence with its mutations undone in turn, and whether each was within and there."""
    state = F.struct(seq.alias("s"), F.lit(True).alias("ok"))
    step = lambda a, x: F.struct(F.overlay(a["s"], x["wt"], x["pos0"] + 1, F.lit(1)).alias("s"), (a["ok"] & (x["pos0"] < F.length(a["s"])) & (F.substring(a["s"], x["pos0"] + 1, F.lit(1)) == x["mut"])).alias("ok"))
    return F.aggregate(mutations, state, step)


def mutations_fit(seq: Column, mutations: Column) -> Column:
    """Whether every mutation is within the sequence and is there, mutations at one place in turn."""
    return undo(seq, mutations)["ok"]


def mutate(seq: Column, mutations: Column) -> Column:
    return F.aggregate(mutations, seq, lambda s, x: F.overlay(s, x["mut"], x["pos0"] + 1, F.lit(1)))


def layer_list(spec: Column) -> Column:
    """"0,4-6,12" or "-1,-2" as an array of numbers; null, "", "*" and "all" as null."""
    part = lambda x: F.when(x.rlike(r"^\d+-\d+$"), F.sequence(F.split(x, "-")[0].try_cast("int"), F.split(x, "-")[1].try_cast("int"))).otherwise(F.array(x.try_cast("int")))
    tokens = F.filter(F.transform(F.split(spec, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.lower(F.trim(spec)).isin("all", "*", "") | spec.isNull(), F.lit(None).cast("array<int>")).otherwise(F.flatten(F.transform(tokens, part)))


def parse_layers(spec: str | None) -> list[int] | None:
    """The same on the driver; a part that is no number or range raises."""
    if spec is None or spec.strip().lower() in ("", "*", "all"):
        return None
    out: list[int] = []
    for part in filter(None, map(str.strip, spec.split(","))):
        low, dash, high = part.partition("-") if not part.startswith("-") else (part, "", "")
        out += range(int(low), int(high) + 1) if dash else [int(low)]
    return out


def affected_tokens(pos0: Column, length: Column, k: int, shift: int) -> Column:
    """Numbers of the k-mer tokens (one each ``shift``) that cover a position."""
    last = F.floor((length - k) / shift).cast("int")
    low = F.greatest(F.lit(0), (F.floor((pos0 - k) / shift) + 1).cast("int"))
    high = F.least(last, F.floor(pos0 / shift).cast("int"))
    return F.when((last >= 0) & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def token_spans(length: Column, k: int, shift: int) -> Column:
    """Half-open nucleotide spans of k-mer tokens."""
    n = F.when(length >= k, F.floor((length - k) / shift).cast("int") + 1).otherwise(0)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct((j * shift).alias("start"), (j * shift + k).alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def context_report(variants: DataFrame, limit: int) -> DataFrame:
    """For each assay: unscoreable variants first, then those over the context, then what is left."""
    scored = scoreable(F.col("mutant"))
    over = F.length("sequence") > limit
    return variants.groupBy("dms_id").agg(F.count_if(~scored).alias("n_unscoreable"), F.count_if(scored & over).alias("n_over_context"), F.count_if(scored & ~over).alias("n_kept"))


def assay_check(parsed: DataFrame) -> DataFrame:
    """For each assay: mutations that are not in their sequence, distinct references, the reference."""
    each = parsed.select("dms_id", undo(F.col("sequence"), F.col("mutations")).alias("u")).select("dms_id", F.col("u.ok").alias("fits"), F.col("u.s").alias("reference"))
    return each.groupBy("dms_id").agg(F.count_if(~F.col("fits")).alias("n_bad"), F.countDistinct("reference").alias("n_references"), F.min("reference").alias("reference"), F.count(F.lit(1)).alias("n_scoreable"))
