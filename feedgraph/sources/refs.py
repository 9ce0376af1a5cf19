"""Channel references from text."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedgraph.functions.columns import canonical_ref, stripped


def read_refs(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0), value of a reference list, in order; a missing file is an empty list. Files of any size are read in splits:
    lines are numbered within a split, and splits, in the order of files and bytes, by the lines before them."""
    try:
        read = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "line long, value string")
    split = ["file", "start"]
    rows = read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    splits = rows.groupBy(*split).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a split
    placed = rows.join(splits.select(*split, "first", before.alias("before")), split)
    return placed.select((F.col("before") + F.col("id") - F.col("first")).alias("line"), "value").orderBy("line")


def channel_refs(spark: SparkSession, inline: str | None, path: str) -> DataFrame:
    """A non-empty inline list stands for the file."""
    return spark.createDataFrame([(0, inline)], "line long, value string") if inline else read_refs(spark, path)


def tokens(refs: DataFrame) -> DataFrame:
    """line, pos, token: split at commas and line ends, stripped, empty ones dropped."""
    split = refs.select("line", F.posexplode(F.split("value", "[,\r\n]")).alias("pos", "token"))
    return split.select("line", "pos", stripped(F.col("token")).alias("token")).where("token <> ''")


def canonical(refs: DataFrame) -> DataFrame:
    return tokens(refs).select("line", "pos", canonical_ref(F.col("token")).alias("ref"))


def distinct_refs(refs: DataFrame, limit: int | None = None) -> DataFrame:
    """Each reference at its first place, in order; at most limit of them (none if it is negative)."""
    first = canonical(refs).groupBy("ref").agg(F.min(F.struct("line", "pos")).alias("at")).select("ref", "at.line", "at.pos")
    return first if limit is None else first.orderBy("line", "pos").limit(max(0, limit))
