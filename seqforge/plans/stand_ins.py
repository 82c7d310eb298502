"""Logical tables of sequences, variants, predictions and records over the tables at hand, in Spark
and, as common table expressions of the same names, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seqs(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", F.col("quality").alias("essential"))
    # what normalising gives of these letters: white space is none of them, and U is read as T where little is left
    seq = F.replace(F.regexp_replace(F.upper("text"), "[^ACGTUN]+", ""), F.lit("U"), F.lit("T"))
    own = docs.select("doc_id", seq.alias("seq"), F.concat("lang", F.lit("/"), "source").alias("genome"), F.col("lang").alias("genus"))
    return own.join(labels, "doc_id", "left").withColumn("split", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train"))


def labelled(spark, d):
    """The sequences with a label."""
    return seqs(spark, d).where("essential IS NOT NULL")


_SEQ = r"regexp_replace(translate(upper(regexp_replace(text, '^\s+|\s+$', '', 'g')), 'U', 'T'), '[^ACGTN]', '', 'g')"
SEQS = rf"""seqs AS (SELECT doc_id, {_SEQ} AS seq, concat(lang, '/', source) AS genome, lang AS genus, quality AS essential,
  CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents LEFT JOIN labels USING (doc_id))"""
LABELLED = SEQS.replace("LEFT JOIN labels USING (doc_id)", "JOIN labels USING (doc_id) WHERE quality IS NOT NULL")


def variants(spark, d):
    n = F.col("l_linenumber")
    base = lambda k: F.substring(F.lit("ACGT"), (n + k) % 4 + 1, F.lit(1))
    mutant = F.when(n == 1, "").when(n == 2, "NaN").when(n == 3, F.concat(base(0), n.cast("string"), base(1), F.lit(":"), base(2), (n + 4).cast("string"), base(3))).otherwise(F.concat(base(0), n.cast("string"), base(1)))
    seq = F.repeat(F.substring(F.lit("ACGTTGCAACGGT"), (F.col("l_partkey") % 5 + 1).cast("int"), F.lit(8)), (F.col("l_suppkey") % 4 + 1).cast("int"))
    li = table(spark, d, "lineitem")
    return li.select(F.concat("l_returnflag", "l_linestatus").alias("dms_id"), F.col("l_returnflag").alias("rna_type"), "l_orderkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("variant_idx"), mutant.alias("mutant"), seq.alias("sequence"), F.col("l_extendedprice").alias("dms_score"), F.col("l_quantity").alias("model_score"))


VARIANTS = """variants AS (SELECT concat(l_returnflag, l_linestatus) AS dms_id, l_returnflag AS rna_type, l_orderkey, l_orderkey * 8 + l_linenumber AS variant_idx,
  CASE WHEN l_linenumber = 1 THEN '' WHEN l_linenumber = 2 THEN 'NaN'
       WHEN l_linenumber = 3 THEN concat(substr('ACGT', l_linenumber % 4 + 1, 1), l_linenumber, substr('ACGT', (l_linenumber + 1) % 4 + 1, 1), ':', substr('ACGT', (l_linenumber + 2) % 4 + 1, 1), l_linenumber + 4, substr('ACGT', (l_linenumber + 3) % 4 + 1, 1))
       ELSE concat(substr('ACGT', l_linenumber % 4 + 1, 1), l_linenumber, substr('ACGT', (l_linenumber + 1) % 4 + 1, 1)) END AS mutant,
  repeat(substr('ACGTTGCAACGGT', CAST(l_partkey % 5 + 1 AS INTEGER), 8), CAST(l_suppkey % 4 + 1 AS INTEGER)) AS sequence,
  l_extendedprice AS dms_score, l_quantity AS model_score FROM lineitem)"""


def numbered_variants(spark, d):
    """The variants with a number of each row in place of their own, which repeats."""
    return variants(spark, d).withColumn("variant_idx", F.monotonically_increasing_id())


def preds(spark, d):
    return table(spark, d, "events").select("event_id", (F.col("user_id") % 5).alias("genome"), (F.col("event_type") == "error").cast("int").alias("y"), F.col("value").alias("score"), (F.col("value") / 100 - F.floor(F.col("value") / 100)).alias("prob"))


PREDS = "preds AS (SELECT event_id, user_id % 5 AS genome, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y, value AS score, value / 100 - floor(value / 100) AS prob FROM events)"


def emb(spark, d):
    each = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(k.alias("layer_id"), F.slice("embedding", k * 16 + 1, F.lit(16)).alias("vec")))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), "label", F.explode(each).alias("e")).select("item", "label", "e.layer_id", F.transform("e.vec", lambda x: x.cast("double")).alias("vec"))


EMB = """emb AS (SELECT vec_id AS item, label, layer_id, unnest(range(16)) AS dim, CAST(unnest(embedding[layer_id * 16 + 1 : layer_id * 16 + 16]) AS DOUBLE) AS x
  FROM embeddings, (SELECT unnest(range(4)) AS layer_id))"""


def records(spark, d):
    by = table(spark, d, "events").groupBy(F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("model"), F.col("event_type").alias("task"), (F.col("user_id") % 7).alias("g"))
    rows = by.agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("top"), F.count(F.lit(1)).cast("double").alias("size"))
    code = (F.col("g") + F.length("task")) % 6
    status = F.when(code == 0, "na").when(code == 1, "error").otherwise("ok")
    metrics = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("mean", "top", "size")])
    return rows.select("model", "task", status.alias("status"), F.lit("mean").alias("primary"), F.explode(metrics).alias("x")).select("model", "task", "status", "primary", "x.metric", "x.value")


RECORDS = """recs AS (SELECT concat('m', user_id % 7) AS model, user_id % 7 AS g, event_type AS task, round(avg(value), 6) AS mean, max(value) AS top, CAST(count(*) AS DOUBLE) AS size FROM events GROUP BY ALL),
  records AS (SELECT model, task, CASE (g + length(task)) % 6 WHEN 0 THEN 'na' WHEN 1 THEN 'error' ELSE 'ok' END AS status, 'mean' AS "primary", metric, value
    FROM (SELECT model, g, task, 'mean' AS metric, mean AS value FROM recs UNION ALL SELECT model, g, task, 'top', top FROM recs UNION ALL SELECT model, g, task, 'size', size FROM recs))"""


def sweeps(spark, d):
    """Records of layer sweeps: layer_<i>_score for each task, and the plain tasks' own."""
    ev = table(spark, d, "events")
    by = ev.groupBy(F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("model"), F.concat("event_type", F.lit("-layer-sweep")).alias("task"), (F.col("event_id") % 12).alias("layer"))
    layered = by.agg(F.round(F.avg("value"), 6).alias("value")).select("model", "task", F.lit("ok").alias("status"), F.lit("score").alias("primary"), F.concat(F.lit("layer_"), F.col("layer").cast("string"), F.lit("_score")).alias("metric"), "value")
    return records(spark, d).unionByName(layered)


SWEEPS = RECORDS + """, sweeps AS (SELECT model, task, status, "primary", metric, value FROM records UNION ALL
  SELECT concat('m', user_id % 7), concat(event_type, '-layer-sweep'), 'ok', 'score', concat('layer_', event_id % 12, '_score'), round(avg(value), 6) FROM events GROUP BY ALL)"""


def models(spark, d):
    n = table(spark, d, "nation").where("n_nationkey < 6")
    return n.select(F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("model"), F.col("n_name").alias("model_id"))


MODELS = "models AS (SELECT concat('m', n_nationkey) AS model, n_name AS model_id FROM nation WHERE n_nationkey < 6)"


def enzymes(spark, d):
    """A sequence for each supplier, of one of three motifs by its class."""
    key = F.col("s_suppkey")
    motif = F.when(key % 3 == 0, "ACCA").when(key % 3 == 1, "GTTG").otherwise("AGGA")
    return table(spark, d, "supplier").select(key.alias("row_idx"), F.col("s_name").alias("entry"), F.concat(F.lit("1.1.1."), (key % 3).cast("string")).alias("label"), F.repeat(motif, (key % 7 + 9).cast("int")).alias("sequence"), F.when(key % 4 == 0, "test").otherwise("train").alias("split"))


ENZYMES = """enzymes AS (SELECT s_suppkey AS row_idx, s_name AS entry, concat('1.1.1.', s_suppkey % 3) AS label, repeat(CASE s_suppkey % 3 WHEN 0 THEN 'ACCA' WHEN 1 THEN 'GTTG' ELSE 'AGGA' END, CAST(s_suppkey % 7 + 9 AS INTEGER)) AS sequence, CASE WHEN s_suppkey % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM supplier)"""


def rich_genes(spark, d):
    """A gene for each supplier, of A and C if it is essential, else of T and G."""
    key = F.col("s_suppkey")
    seq = F.repeat(F.when(key % 2 == 1, "ACAAC").otherwise("TGTTG"), (key % 5 + 10).cast("int"))
    return table(spark, d, "supplier").select(key.alias("doc_id"), seq.alias("seq"), F.concat(F.lit("g"), (key % 3).cast("string")).alias("genome"), (key % 2).cast("int").alias("essential"), F.when(key % 4 > 1, "test").otherwise("train").alias("split"))
