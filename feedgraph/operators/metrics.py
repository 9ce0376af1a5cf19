"""Run counters as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from feedgraph.functions.columns import has_text


def post_counters() -> dict[str, Column]:
    """Counters of a run of post rows (content): written, saved (with content) and with text to embed."""
    return {"n_rows": F.count(F.lit(1)), "n_saved": F.count_if(F.col("content") != ""), "n_valid": F.count_if(has_text(F.col("content")))}


def message_counters() -> dict[str, Column]:
    """Counters of raw messages as they arrive: all, those that become posts, and those with text to embed."""
    real = F.col("kind") == "message"
    return {"n_messages": F.count(F.lit(1)), "n_real": F.count_if(real), "n_valid": F.count_if(real & has_text(F.col("message")))}


def observed(rows: DataFrame, name: str, counters: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """Rows that count themselves while they are written: after that the observation's get has the counters."""
    seen = Observation(name)
    return rows.observe(seen, *[c.alias(n) for n, c in counters.items()]), seen


def posts_saved(posts: DataFrame) -> DataFrame:
    """Posts with content for each channel; white space counts."""
    return posts.groupBy("channel_id").agg(F.count_if(F.col("content") != "").alias("n_saved"))


def new_per_source(sources: DataFrame, finds: DataFrame) -> DataFrame:
    """src_id, n_new: channels that each expanded source brought (zero where none)."""
    counted = finds.groupBy("src_id").agg(F.count("*").alias("n_new"))
    return sources.select("src_id").join(counted, "src_id", "left").select("src_id", F.coalesce("n_new", F.lit(0)).alias("n_new"))


def embed_batch_stats(texts: DataFrame, batch: str, text: str) -> DataFrame:
    return texts.groupBy(batch).agg(F.count("*").alias("n_requested"), F.count_if(has_text(F.col(text))).alias("n_valid"))
