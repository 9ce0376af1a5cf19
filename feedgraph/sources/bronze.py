"""Raw tables that some other process has landed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedgraph.schemas import RAW_CHANNEL, RAW_MESSAGE, RECOMMENDATION

SCHEMAS = {"raw_channels": RAW_CHANNEL, "raw_messages": RAW_MESSAGE, "recommendations": RECOMMENDATION}


def read_raw(spark: SparkSession, table: str, path: str, kind: str = "parquet") -> DataFrame:
    """One of raw_channels, raw_messages and recommendations, as Parquet or JSON lines, by its declared schema."""
    return spark.read.schema(SCHEMAS[table]).format(kind).load(path)


def stream_raw(spark: SparkSession, table: str, path: str, kind: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(SCHEMAS[table]).format(kind)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)
