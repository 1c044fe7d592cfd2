"""Streams of files: the same tables over a folder that files arrive in. Every file is read once; no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import scan

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, path: str, glob: str = "*.pdf", per_trigger: int = 1000) -> DataFrame:
    read = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).load(path)
    return read.select(F.col("path").alias("file_id"), "content")


def stream_table(spark: SparkSession, path: str, table: str = "page_text", **options) -> DataFrame:
    return scan(stream_files(spark, path), table, **options)
