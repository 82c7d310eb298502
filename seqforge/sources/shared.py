"""Tables between the steps of a run, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; where none is set a temporary one, if all runs in this process."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="shared-"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to path has ended well."""
    files, where = _at(spark, f"{path}/_SUCCESS")
    return files.exists(where)


def written(df: DataFrame, name: str, by: list[str] | None = None, path: str | None = None) -> DataFrame:
    """df as a table of its own, read again: what follows starts from the files, so that a lost executor
    repeats its running tasks and nothing above them. A finished table at ``path`` is read as it is."""
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not complete(spark, path):
        df.write.mode("overwrite").partitionBy(*by or []).parquet(path)
    out = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    out.table_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing reads any more."""
    files, where = _at(df.sparkSession, df.table_path)
    files.delete(where, True)
