"""Contract-checked scans of sequence tables, manifests, records; every one reads strings and says
what is wrong with them rather than turning them into nulls."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequences import normalize
from . import files
from .files import ContractError, read_dense, read_ragged  # noqa: F401

GENES, ENZYMES = ("genome_name", "genus", "essential", "sequence"), ("entry", "sequence", "label")
RECORD = "model_hash string, model string, benchmark string, tasks array<struct<task:string,status:string,primary_metric:string,metrics:map<string,double>>>, _broken string"


def read_strings(spark: SparkSession, path: str, needed: tuple[str, ...]) -> DataFrame:
    """A CSV file with all columns as trimmed strings; a needed column that is absent raises."""
    df = spark.read.option("header", True).option("multiLine", False).option("escape", '"').csv(path)
    lacking = [c for c in needed if c not in df.columns]
    if lacking:
        raise ContractError(f"{path}: no column {', '.join(lacking)}")
    return df.select(*[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in df.columns])


def gene_violations(rows: DataFrame) -> DataFrame:
    """problem, n: what breaks the contract of genes, with how many rows or genomes do."""
    checks = {"empty genome": F.col("genome_name") == "", "label not 0 or 1": ~F.col("essential").isin("0", "1"), "empty sequence": F.trim("sequence") == ""}
    counts = rows.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in checks.items()])
    each = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("problem"), F.col(f"`{n}`").alias("n")) for n in checks])).alias("x")).select("x.*")
    genus = rows.groupBy("genome_name").agg(F.min("genus").alias("a"), F.max("genus").alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("n")).select(F.lit("genus differs within a genome").alias("problem"), "n")
    none = rows.agg((F.count(F.lit(1)) == 0).cast("long").alias("n")).select(F.lit("no rows").alias("problem"), "n")
    return each.unionByName(genus).unionByName(none).where("n > 0")


def enzyme_violations(rows: DataFrame) -> DataFrame:
    counts = rows.agg(*[F.count_if(F.trim(c) == "").alias(c) for c in ENZYMES], (F.count(F.lit(1)) == 0).cast("long").alias("rows"))
    named = [*[(f"empty {c}", c) for c in ENZYMES], ("no rows", "rows")]
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("problem"), F.col(c).alias("n")) for n, c in named])).alias("x")).select("x.*").where("n > 0")


def _require(violations: DataFrame, what: str) -> None:
    found = violations.collect()  # a handful of problems, each with its count
    if found:
        raise ContractError(f"{what}: " + "; ".join(f"{r.problem} ({r.n})" for r in found))


def read_genes(spark: SparkSession, path: str, split: str) -> DataFrame:
    rows = read_strings(spark, path, GENES)
    _require(gene_violations(rows), path)
    return rows.select(F.lit(split).alias("split"), "genome_name", "genus", F.monotonically_increasing_id().alias("gene_idx"), F.col("essential").cast("int").alias("essential"), normalize(F.col("sequence")).alias("sequence"))


def read_enzymes(spark: SparkSession, path: str, split: str) -> DataFrame:
    rows = read_strings(spark, path, ENZYMES)
    _require(enzyme_violations(rows), path)
    return rows.select(F.lit(split).alias("split"), F.monotonically_increasing_id().alias("row_idx"), "entry", "label", normalize(F.col("sequence")).alias("sequence"))


def drop_wild_types(rows: DataFrame, score: str = "dms_score") -> DataFrame:
    """Variants with a mutation and a score that parses; the score as a double."""
    value = F.col(score).cast("string").try_cast("double")
    return rows.where((F.trim("mutant") != "") & (F.lower(F.trim("mutant")) != "nan") & value.isNotNull() & ~F.isnan(value)).withColumn(score, value)


def read_variants(spark: SparkSession, path: str, dms_id: str, rna_type: str = "mRNA-coding") -> DataFrame:
    rows = read_strings(spark, path, ("mutant", "sequence"))
    score = next((c for c in ("DMS_score", "dms_score") if c in rows.columns), None)
    if score is None:
        raise ContractError(f"{path}: no column DMS_score or dms_score")
    kept = drop_wild_types(rows.withColumnRenamed(score, "dms_score"))
    if kept.isEmpty():
        raise ContractError(f"{path}: no scored variant")
    return kept.select(F.lit(dms_id).alias("dms_id"), F.lit(rna_type).alias("rna_type"), F.monotonically_increasing_id().alias("variant_idx"), "mutant", normalize(F.col("sequence")).alias("sequence"), "dms_score")


def read_manifest(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text())


def check_files(spark: SparkSession, folder: str, entries: list[dict], digest_needed: bool = False) -> None:
    """Raises if a listed file is absent, or is not what its SHA-256 says; one without is skipped,
    unless all must have one. Tasks hash the files."""
    rows = spark.createDataFrame([(f"{folder}/{e['file']}", e.get("sha256")) for e in entries], "path string, wanted string")
    files.check_files(spark, rows, digest_needed)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, length of a file, or of all in a folder, hashed as streams where they are read."""
    return files.digests(spark, files.listed(path)).drop("cached")


def load_splits(spark: SparkSession, manifest: str, splits: tuple[str, ...] = ("train", "test"), reader=read_genes) -> DataFrame:
    """The splits asked for, checked, with ``id``, distinct over all of them; files of other splits are not opened."""
    held = read_manifest(manifest)["splits"]
    entries = [e if isinstance(e, dict) else {"file": e} for e in held.values()] if isinstance(held, dict) else held
    names = list(held) if isinstance(held, dict) else [e["split"] for e in held]
    wanted = [(n, e) for n, e in zip(names, entries) if n in splits]
    if missing := [s for s in splits if s not in names]:
        raise ContractError(f"{manifest}: no split {', '.join(missing)}")
    folder = str(Path(manifest).parent)
    check_files(spark, folder, [e for _, e in wanted])
    parts = [reader(spark, f"{folder}/{e['file']}", n) for n, e in wanted]
    number = next(c for c in parts[0].columns if c.endswith("_idx"))  # of a row in its own file
    return reduce(DataFrame.unionByName, parts).withColumn("id", F.concat_ws(":", "split", number))


def load_enzymes(spark: SparkSession, manifest: str, splits: tuple[str, ...] = ("train", "test")) -> DataFrame:
    return load_splits(spark, manifest, splits, read_enzymes)


def load_assays(spark: SparkSession, manifest: str) -> DataFrame:
    """The variants of all assays that a manifest lists, checked (each must have a SHA-256); a variant is
    known by (dms_id, variant_idx)."""
    entries = read_manifest(manifest)["assays"]
    if not entries:
        raise ContractError(f"{manifest}: no assays")
    folder = str(Path(manifest).parent)
    check_files(spark, folder, entries, digest_needed=True)
    parts = [read_variants(spark, f"{folder}/{e['file']}", e["dms_id"], e.get("rna_type", "mRNA-coding")) for e in entries]
    return reduce(DataFrame.unionByName, parts)


def select_assays(sheet: DataFrame, **wanted: str) -> DataFrame:
    """The rows of a reference sheet whose columns have the values asked for; a byte order mark before the
    first column's name does no harm."""
    named = sheet.toDF(*[c.lstrip("\ufeff") for c in sheet.columns])
    return named.where(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in wanted.items()], F.lit(True)))


def canonical_variants(rows: DataFrame) -> DataFrame:
    """mutant, sequence and DMS_score of a table of any source, whatever the case of its columns' names."""
    lower = {c.lower(): c for c in rows.columns}
    if lacking := [c for c in ("mutant", "sequence", "dms_score") if c not in lower]:
        raise ContractError(f"no column {', '.join(lacking)}")
    return rows.select(F.col(lower["mutant"]).alias("mutant"), F.col(lower["sequence"]).alias("sequence"), F.col(lower["dms_score"]).alias("DMS_score"))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet or CSV file, or the one file of those kinds in a zip archive, which tasks read where it is."""
    if path.endswith(".zip"):
        inner = files.members(spark, [path]).limit(2).collect()
        if len(inner) != 1:
            raise ContractError(f"{path}: {'no table' if not inner else 'several tables'} in the archive")
        names = files.header(spark, path, inner[0].member)
        return files.archived(spark, [path], names).select(*[F.col(f"`{n}`") for n in names])
    return spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).csv(path)


def archived_variants(spark: SparkSession, paths: list[str]) -> DataFrame:
    """dms_id (the member's name without its folder and kind), mutant, sequence, DMS_score of all tables in zip archives."""
    rows = files.archived(spark, paths, ["mutant", "sequence", "DMS_score"])
    return rows.select(F.regexp_extract("member", r"([^/]+)\.[^./]+$", 1).alias("dms_id"), "row", "mutant", "sequence", "DMS_score")


def source_stats(variants: DataFrame, by: str = "dms_id") -> DataFrame:
    """Rows and longest sequence of each assay."""
    return variants.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.length("sequence")).alias("cds_len"))


def manifest_summary(genes: DataFrame, genome: str = "genome_name") -> DataFrame:
    """Genomes, genes, essential genes and their share of each split."""
    g = genes.groupBy("split").agg(F.countDistinct(genome).alias("genomes"), F.count(F.lit(1)).alias("genes"), F.sum(F.col("essential").cast("long")).alias("essential"))
    return g.withColumn("percent", F.lit(100.0) * F.col("essential") / F.col("genes"))


def extrapolation_ratio(rows: DataFrame, part: DataFrame) -> DataFrame:
    """How many times a subset's rows the whole has."""
    return rows.agg(F.count(F.lit(1)).alias("whole")).crossJoin(part.agg(F.count(F.lit(1)).cast("double").alias("part"))).select(F.try_divide("whole", "part").alias("ratio"))


def sequence_digests(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.select(key, F.sha2(text, 256).alias("sha256"))


def flatten_genomes(genomes: DataFrame) -> DataFrame:
    """Genomes with an array of contigs, and for each contig arrays of its genes, as a row a gene."""
    contig = genomes.select("genome_name", "genus", F.explode(F.arrays_zip("dna_sequence", "start", "end", "strand", "essential")).alias("c"))
    gene = contig.select("genome_name", "genus", F.col("c.dna_sequence").alias("dna"), F.explode(F.arrays_zip("c.start", "c.end", "c.strand", "c.essential")).alias("g"))
    return gene.select("genome_name", "genus", "dna", F.col("g.start").alias("start"), F.col("g.end").alias("end"), F.col("g.strand").alias("strand"), F.col("g.essential").alias("essential"))


def split_stats(genes: DataFrame) -> DataFrame:
    n = F.length("sequence")
    return genes.groupBy("split").agg(F.countDistinct("genome_name").alias("n_genomes"), F.count(F.lit(1)).alias("n_genes"), F.sum(F.col("essential").cast("long")).alias("n_essential"), F.sum(n).cast("long").alias("total_nt"), F.min(n).alias("min_nt"), F.max(n).alias("max_nt"), F.avg(n).alias("avg_nt"), F.array_join(F.sort_array(F.collect_set("genus")), ",").alias("genera"))


def first_groups(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """All rows of the first n groups by their first row."""
    first = rows.groupBy(group).agg(F.min(order).alias("_first")).orderBy("_first", group).limit(n)
    return rows.join(F.broadcast(first.select(group)), group, "left_semi")  # n names at most


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records that are whole, by file name; broken ones and other JSON are left out."""
    raw = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").schema(RECORD).json(folder)
    return raw.withColumn("file", F.col("_metadata.file_name")).where("_broken IS NULL AND model_hash IS NOT NULL AND tasks IS NOT NULL").drop("_broken").orderBy("file")


def read_jsonl(spark: SparkSession, path: str, needed: tuple[str, ...] = ("sequence",)) -> DataFrame:
    """Sequences or variants, a JSON object a line; an id that is absent is the line's number (blank lines
    do not count), by file and place in it."""
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select("value", place.alias("place")).where("trim(value) <> ''")
    keys = ("id", *needed)
    rows = lines.select("place", *[F.get_json_object("value", f"$.{k}").alias(k) for k in keys])
    if rows.where(" OR ".join(f"{k} IS NULL" for k in needed)).limit(1).count():
        raise ContractError(f"{path}: a line lacks {' or '.join(needed)}")
    if not rows.where("id IS NULL").limit(1).count():
        return rows.drop("place")
    parts = rows.select("place.file", "place.block").groupBy("file", "block").count()  # a row a file's split
    before = parts.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("place.file", "place.block").orderBy("place.row")) - 1
    numbered = rows.withColumn("k", within).withColumn("file", F.col("place.file")).withColumn("block", F.col("place.block")).join(F.broadcast(before.drop("count")), ["file", "block"])
    return numbered.withColumn("id", F.coalesce("id", (F.col("before") + F.col("k")).cast("string"))).select(*keys)


def read_variant_items(spark: SparkSession, path: str) -> DataFrame:
    """id, reference and mutations (pos0, wt, mut) of lines such as {"id":, "reference":, "mutations": [[0, "A", "C"]]}."""
    lines = read_jsonl(spark, path, ("reference", "mutations"))
    each = F.transform(F.from_json("mutations", "array<array<string>>"), lambda m: F.struct(m[0].cast("int").alias("pos0"), m[1].alias("wt"), m[2].alias("mut")))
    return lines.select("id", "reference", each.alias("mutations"))


def write_variant_items(items: DataFrame, path: str) -> None:
    each = F.transform("mutations", lambda m: F.array(m["pos0"].cast("string"), m["wt"], m["mut"]))
    items.select(F.col("id").cast("string").alias("id"), "reference", each.alias("mutations")).write.mode("overwrite").json(path)


def write_board(df: DataFrame, path: str) -> None:
    """A board, which has a row a model, as CSV and Markdown files."""
    from ..operators.results import markdown

    rows = [r.asDict() for r in df.collect()]
    Path(path).with_suffix(".md").write_text(markdown(rows, df.columns))
    with open(Path(path).with_suffix(".csv"), "w", newline="") as f:
        import csv

        w = csv.DictWriter(f, df.columns)
        w.writeheader()
        w.writerows(rows)


def read_json_config(path: str) -> dict:
    return json.loads(Path(path).read_text())
