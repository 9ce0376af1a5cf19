"""Newest rows of each channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedgraph.operators.normalize import real_messages
from feedgraph.schemas import MESSAGES_INSPECTED, POSTS_PER_CHANNEL


def newest(messages: DataFrame, n: int) -> DataFrame:
    """The n newest messages of a channel, service messages included. The rank is limited before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy("channel_id").orderBy(F.desc("id")))
    return messages.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def newest_posts(messages: DataFrame, n: int = POSTS_PER_CHANNEL) -> DataFrame:
    """Real messages among the n newest: service messages use up the limit."""
    return real_messages(newest(messages, n))


def newest_inspected(messages: DataFrame, k: int = MESSAGES_INSPECTED) -> DataFrame:
    return newest(messages, k)
