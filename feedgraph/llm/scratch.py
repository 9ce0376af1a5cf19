"""Intermediate tables in the folder that driver and executors share.

A written Parquet table cuts lineage, is computed once, and survives lost executors. The folder is the session's
checkpoint directory (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedgraph.sources.store import checkpoint_folder


def unused(taken: list[str], *names: str) -> dict[str, str]:
    """Each name, or a longer one where a column of the table has it already (names differ in more than case)."""
    low, out = {t.lower() for t in taken}, {}
    for name in names:
        free = name
        while free.lower() in low:
            free += "_"
        out[name] = free
        low.add(free.lower())
    return out


def text_digest(column: str) -> tuple[Column, Column]:
    """Two numbers of 60 bits each from a text's MD5 (null: as the empty text)."""
    md5 = F.md5(F.coalesce(column, F.lit("")).cast("binary"))
    first, second = (F.conv(F.substring(md5, at, 15), 16, 10).cast("long") for at in (1, 16))
    return first, second


class Scratch:
    """Named tables of one run of an operator. ``keep`` writes a frame and returns it as read back; ``drop`` frees one
    that later tables no longer need. What a returned frame still reads stays until its owner clears the folder."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def keep(self, frame: DataFrame, table: str) -> DataFrame:
        frame.write.option("compression", "zstd").parquet(self.path(table))
        return self.read(table, frame)

    def read(self, table: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.path(table))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
