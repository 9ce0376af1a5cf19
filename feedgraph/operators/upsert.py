"""Insert-or-overwrite by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_arrival(rows: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """The latest row of each key; of equally late ones the greatest. Aggregated before the shuffle, so that a key with
    very many arrivals is no burden."""
    rest = [c for c in rows.columns if c not in keys and c != seq]
    latest = rows.groupBy(*keys).agg(F.max(F.struct(seq, *rest)).alias("_row"))
    return latest.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def upsert(
    base: DataFrame, incoming: DataFrame, keys: Sequence[str], update: Sequence[str], keep: Sequence[str] = (), preserve: Sequence[str] = (), newer_by: str | None = None
) -> DataFrame:
    """Base with incoming rows put in: one full outer join on the keys.

    On conflict the update columns take the incoming value, null included, and the keep and preserve columns stay; new
    keys take all from the incoming row. incoming must have one row a key. With newer_by an incoming row that is older
    than the base row changes nothing, so replays and late batches are harmless."""
    wins: Column = F.col("i._in").isNotNull()
    if newer_by:
        wins = wins & (F.col("b._in").isNull() | (F.col(f"i.{newer_by}") >= F.col(f"b.{newer_by}")))
    joined = base.withColumn("_in", F.lit(1)).alias("b").join(incoming.withColumn("_in", F.lit(1)).alias("i"), list(keys), "full_outer")
    stay = {*keep, *preserve}
    columns = [F.col(k) for k in keys]
    for c in base.columns:
        if c in stay:
            columns.append(F.when(F.col("b._in").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"i.{c}")).alias(c))
        elif c in update:
            columns.append(F.when(wins, F.col(f"i.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
        elif c not in keys:
            raise ValueError(f"{c} is neither a key nor to update nor to keep")
    return joined.select(*columns).select(*base.columns)


CHANNEL_UPDATE = ("username", "title", "description", "subscribers_count", "avatar_url", "status", "is_author_blog", "updated_at")
POST_UPDATE = ("content", "published_at", "views", "comments_count", "shares_count", "reactions_count", "updated_at")


def with_channel_defaults(incoming: DataFrame) -> DataFrame:
    """Columns that incoming lacks take insert defaults: pending, and an unknown author flag."""
    defaults = {"status": F.lit("pending"), "is_author_blog": F.lit(None).cast("boolean"), "created_at": F.col("updated_at")}
    return incoming.withColumns({c: v for c, v in defaults.items() if c not in incoming.columns})


def upsert_channels(base: DataFrame, incoming: DataFrame, preserve: Sequence[str] = ()) -> DataFrame:
    """By id; created_at stays."""
    incoming = with_channel_defaults(incoming)
    return upsert(base, incoming, ["id"], [c for c in CHANNEL_UPDATE if c not in preserve], ["created_at"], preserve)


def upsert_posts(base: DataFrame, incoming: DataFrame, newer_by: str | None = None) -> DataFrame:
    """By (channel_id, message_id); the surrogate id and created_at stay."""
    update = [*POST_UPDATE, *([newer_by] if newer_by else [])]
    return upsert(base, incoming, ["channel_id", "message_id"], update, ["id", "created_at"] if "id" in base.columns else ["created_at"], newer_by=newer_by)


def upsert_vectors(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """By post_id; the whole point is replaced."""
    return upsert(base, incoming, ["post_id"], [c for c in base.columns if c != "post_id"])
