"""Raw records to table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedgraph.functions.columns import as_utc, comments_count, normal_username, reactions_total


def channel_entities(raw: DataFrame, broadcast_only: bool = False) -> DataFrame:
    """Channel records; where sources are resolved, broadcast channels only."""
    kept = raw.where("kind = 'channel'")
    return kept.where("broadcast") if broadcast_only else kept


def channel_rows(raw: DataFrame) -> DataFrame:
    """Full info counts only where there is an access hash."""
    full = lambda field: F.when(F.col("access_hash").isNotNull(), F.col(f"full_chat.{field}"))
    return raw.select(
        "id", normal_username(F.col("username")).alias("username"), F.coalesce("title", F.lit("")).alias("title"), full("about").alias("description"),
        full("participants_count").cast("int").alias("subscribers_count"), "avatar_url",
    )


def real_messages(raw: DataFrame) -> DataFrame:
    return raw.where("kind = 'message' and id is not null and date is not null")


def post_rows(raw: DataFrame, *more: str) -> DataFrame:
    """One row per message, with more of its columns; content may be null and is kept."""
    return raw.select(
        "channel_id", F.col("id").alias("message_id"), F.col("message").alias("content"), as_utc(F.col("date")).alias("published_at"), "views",
        comments_count(F.col("replies")).alias("comments_count"), F.col("forwards").alias("shares_count"), reactions_total(F.col("reactions")).alias("reactions_count"), *more,
    )


def discovered_rows(candidates: DataFrame, author_flag: Column) -> DataFrame:
    """Rows of newly found channels; the user name is kept as it came."""
    return candidates.select(
        "id", "username", F.coalesce("title", F.lit("")).alias("title"), "description", "subscribers_count", F.lit(None).cast("string").alias("avatar_url"),
        F.lit("pending").alias("status"), author_flag.alias("is_author_blog"),
    )
