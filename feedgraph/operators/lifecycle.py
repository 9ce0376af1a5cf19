"""Channel states: lookups, claims and transitions."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedgraph.schemas import PENDING, PROCESSING, READY, REJECTED
from feedgraph.sources.store import Store, shared_folder

CLAIM = "claim"  # the tag of claims


def ready_author_channels(channels: DataFrame) -> DataFrame:
    """Ready for parsing, and known to be an author's (an unknown flag does not count)."""
    return channels.where((F.col("status") == READY) & F.col("is_author_blog"))


def rows_by_keys(rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def claim(channels: DataFrame, n: int | None, seed: str, eligible: Column | None = None) -> DataFrame:
    """The ids of n eligible channels (all, if None) in a seeded random order (claim_order); pending ones by default."""
    chosen = channels.where(F.col("status") == PENDING if eligible is None else eligible)
    draw = F.md5(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string")))
    drawn = chosen.select("id", draw.alias("draw"))
    top = drawn if n is None else drawn.orderBy("draw", "id").limit(n)
    return top.select("id", F.struct("draw", "id").alias("claim_order"))


def claim_for_parsing(channels: DataFrame, n: int, seed: str) -> DataFrame:
    return claim(channels, n, seed, (F.col("status") == READY) & F.col("is_author_blog"))


def claim_exclusively(
    store: Store, n: int | None, seed: str, now: Column, eligible: Column | None = None, patience: float = 600.0, pause: float = 0.2
) -> DataFrame:
    """Claim n channels of a stored table for one worker and set them processing; ids and claim_order, as written.

    Claims are numbered. Whoever creates the marker file of the next number claims; the others wait until that claim can
    be read and draw again among what is left, so no two workers get the same channel."""
    until = time.monotonic() + patience
    while True:
        number = store.applied(CLAIM) + 1
        if store.exclusive(f"claims/{number:012d}"):
            break
        if time.monotonic() > until:
            raise TimeoutError(f"claim {number} has a marker, but has not been written: delete claims/{number:012d} if its worker is dead")
        time.sleep(pause)
    path = shared_folder(store.spark, "claim")
    claim(store.read(), n, f"{seed}-{number}", eligible).write.parquet(path)
    drawn = store.spark.read.schema("id long, claim_order struct<draw: string, id: long>").parquet(path)
    store.append(patches=drawn.select("id", F.lit(PROCESSING).alias("status"), now.alias("updated_at")), tag=(CLAIM, number))
    return drawn


def transition(channels: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Set statuses by (id, new_status), whatever the state before; unknown ids change nothing."""
    moved = channels.join(changes.select("id", "new_status"), "id", "left")
    return moved.withColumns({
        "status": F.coalesce("new_status", "status"),
        "updated_at": F.when(F.col("new_status").isNotNull(), now).otherwise(F.col("updated_at")),
    }).select(*channels.columns)


def mark(channels: DataFrame, ids: DataFrame, status: str, now: Column) -> DataFrame:
    return transition(channels, ids.select("id").distinct().withColumn("new_status", F.lit(status)), now)


def claimed(channels: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    return mark(channels, ids, PROCESSING, now)


def unresolved(ids: DataFrame, raw_channels: DataFrame) -> DataFrame:
    """Claimed ids without a broadcast channel record; they are to be rejected."""
    resolved = raw_channels.where("kind = 'channel' and broadcast").select("id")
    return ids.select("id").join(resolved, "id", "left_anti")


def reject_unresolved(channels: DataFrame, ids: DataFrame, raw_channels: DataFrame, now: Column) -> DataFrame:
    return mark(channels, unresolved(ids, raw_channels), REJECTED, now)
