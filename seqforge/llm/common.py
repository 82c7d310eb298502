"""What the operators of this subpackage share: tables, cut lineage, column hygiene."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, text with null as empty, and the columns named; others are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, as the session has it.

    Where none is set, a temporary folder is made if all runs in this one process; on a cluster that raises."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="shared-"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again.

    What follows starts from the files: nothing above is computed twice, and a lost executor costs
    no more than its running tasks."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``cut`` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(df: DataFrame, bytes_each: int = 32 << 20) -> int:
    """How many partitions to deal df's texts to: as many as the session asks for, and more if its
    files are large for that. The estimate is the optimiser's, from file sizes; nothing is read."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    want = size // bytes_each + 1 if size < 1 << 60 else 1  # beyond that nothing is known
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), want)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def local_path(url: str) -> str | None:
    """The path of a file: address, None for any other file system."""
    if url.startswith("file:"):
        return "/" + url[5:].lstrip("/")
    return url if url.startswith("/") else None


def file_system(url: str):
    """(pyarrow file system, path) of an address in the shared folder."""
    from pyarrow import fs

    local = local_path(url)
    return (fs.LocalFileSystem(), os.path.normpath(local)) if local else fs.FileSystem.from_uri(url)
