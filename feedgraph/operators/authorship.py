"""Is a channel an author's blog?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedgraph.functions.columns import lexicon_count
from feedgraph.operators.topk import newest_inspected
from feedgraph.schemas import FIRST_PERSON, MESSAGES_INSPECTED, PRONOUNS_NEEDED


def author_flags(channels: DataFrame, messages: DataFrame, lexicon: Sequence[str] = FIRST_PERSON, needed: int = PRONOUNS_NEEDED, k: int = MESSAGES_INSPECTED) -> DataFrame:
    """id, is_author_blog: a video note, or enough first-person words, among a channel's newest messages."""
    seen = newest_inspected(messages.select("channel_id", "id", "message", "video_note"), k)
    found = seen.groupBy(F.col("channel_id").alias("id")).agg(
        F.bool_or(F.coalesce("video_note", F.lit(False))).alias("video"), F.sum(lexicon_count(F.col("message"), lexicon)).alias("words")
    )
    flag = F.coalesce(F.col("video") | (F.col("words") >= needed), F.lit(False))
    return channels.select("id").join(found, "id", "left").select("id", flag.alias("is_author_blog"))
