"""A training corpus from the documents: quality, near duplicates, benchmark, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it has kept. A rejected
document goes; of near duplicates the one with the least doc_id stays; a document with a benchmark
window goes; live credentials are replaced in the text; what is left is packed into sequences. Stages
defer to the operators for null, empty, repeated and very long rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqforge.llm import decontaminate, jaccard, packing, quality, secrets
from seqforge.llm.common import cut, table, tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, *quality.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]
#: SQL has neither the classifier nor the tokenizer; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"stage-{k}")
    return docs
