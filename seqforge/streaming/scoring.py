"""Stateless scoring of streams of sequences: the batch expressions on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.features import echo_mean
from ..functions.sequences import normalize


def read_sequences(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    """id, sequence from JSON-lines files as they arrive."""
    return spark.readStream.schema("id string, sequence string").option("maxFilesPerTrigger", files_a_trigger).json(folder)


def scored(stream: DataFrame) -> DataFrame:
    return stream.select("id", normalize(F.col("sequence")).alias("sequence")).withColumn("score", echo_mean(F.col("sequence")))


def start(stream: DataFrame, output: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    writer = scored(stream).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
