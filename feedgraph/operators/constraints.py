"""What a storage engine would enforce, as operators that split rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedgraph.sources.store import Store, shared_folder


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def split_by_parent(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a parent, orphans)."""
    known = parents.select(F.col(parent_key).alias(key))
    return rows.join(known, key, "left_semi"), rows.join(known, key, "left_anti")


def cascade_delete(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return rows.join(deleted, key, "left_anti")


def delete_channels(ids: DataFrame, channels: Store, posts: Store, vectors: Store) -> None:
    """Delete channels (id) from their table, and with them their posts and the posts' points.

    Children go first, so a deletion that breaks off is made good by running it again. Each table gets one row a deleted
    key, and hides those rows until a compaction drops them."""
    gone = posts.read().join(ids.select(F.col("id").alias("channel_id")).distinct(), "channel_id", "left_semi")
    path = shared_folder(posts.spark, "deleted-posts")
    gone.select("id", *posts.keys).write.parquet(path)
    keys = posts.spark.read.parquet(path)
    vectors.delete(keys.select(F.col("id").alias("post_id")))
    posts.delete(keys)
    channels.delete(ids)


def with_violations(rows: DataFrame, required: Sequence[str] = (), max_lengths: Mapping[str, int] | None = None) -> DataFrame:
    """Adds reasons, an array: empty for a good row."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in required]
    long = [F.when(F.char_length(F.col(c)) > n, F.lit(f"{c} is longer than {n}")) for c, n in (max_lengths or {}).items()]
    return rows.withColumn("reasons", F.array_compact(F.array(*missing, *long)))


def split_by_violations(rows: DataFrame, required: Sequence[str] = (), max_lengths: Mapping[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined with reasons)."""
    checked = with_violations(rows, required, max_lengths)
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)
