"""Growing the channel table along recommendations."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedgraph.operators import lifecycle
from feedgraph.operators.authorship import author_flags
from feedgraph.operators.normalize import discovered_rows
from feedgraph.operators.upsert import upsert_channels
from feedgraph.schemas import FIRST_PERSON, MIN_SUBSCRIBERS, PRONOUNS_NEEDED, READY, REJECTED
from feedgraph.sources.store import Store, shared_folder


def candidates(edges: DataFrame) -> DataFrame:
    """Recommended broadcast channels with a user name: src_id, pos and the candidate's fields."""
    return edges.select("src_id", "pos", "cand.*").where("kind = 'channel' and broadcast and username <> ''")


def new_candidates(found: DataFrame, channels: DataFrame) -> DataFrame:
    return found.join(channels.select("id"), "id", "left_anti")


def with_full_info(found: DataFrame, info: DataFrame) -> DataFrame:
    """info: id, access_hash, full_chat; without access hash or record there are no subscribers and no description."""
    known = info.where("access_hash is not null").select("id", F.col("full_chat.participants_count").alias("subscribers_count"), F.col("full_chat.about").alias("description"))
    return found.join(known, "id", "left")


def subscriber_gate(found: DataFrame, least: int = MIN_SUBSCRIBERS) -> DataFrame:
    """Hidden counts do not pass."""
    return found.where(F.col("subscribers_count") >= least)


def first_finds(found: DataFrame) -> DataFrame:
    """Of a channel that several sources recommend, the first find by claim order and position."""
    rest = [c for c in found.columns if c not in ("id", "claim_order", "pos")]
    first = found.groupBy("id").agg(F.min(F.struct("claim_order", "pos", *rest)).alias("_row"))
    return first.select("id", *[F.col(f"_row.{c}").alias(c) for c in ("claim_order", "pos", *rest)])


def round_changes(
    channels: DataFrame, raw_channels: DataFrame, edges: DataFrame, messages: DataFrame, ids: DataFrame, now: Column,
    least: int = MIN_SUBSCRIBERS, lexicon: Sequence[str] = FIRST_PERSON, needed: int = PRONOUNS_NEEDED, more: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """What one expansion of the claimed ids (id, claim_order) finds: rows of new channels, and the new states (id,
    new_status) of the claimed ones. more: edges of channels that have been expanded before, with their claim_order.

    Cheap filters come first: the gate and the anti join cut the candidates before any message is read. The candidates
    that pass are written, as both the judging and the saving read them."""
    rejected = lifecycle.unresolved(ids, raw_channels)
    sources = ids.join(rejected, "id", "left_anti").withColumnRenamed("id", "src_id")
    reached = candidates(edges).join(sources, "src_id")
    if more is not None:
        reached = reached.unionByName(candidates(more).join(more.select("src_id", "claim_order").distinct(), "src_id"))
    found = first_finds(subscriber_gate(with_full_info(new_candidates(reached, channels), raw_channels), least))
    path = shared_folder(channels.sparkSession, "found")
    found.write.parquet(path)
    found = channels.sparkSession.read.schema(found.schema).parquet(path)
    flags = author_flags(found, messages.join(found.select(F.col("id").alias("channel_id")), "channel_id", "left_semi"), lexicon, needed)
    rows = discovered_rows(found.join(flags, "id"), F.col("is_author_blog")).withColumns({"created_at": now, "updated_at": now})
    return rows, rejected.withColumn("new_status", F.lit(REJECTED)).union(sources.select("src_id", F.lit(READY)))


def expand_round(
    channels: DataFrame, raw_channels: DataFrame, edges: DataFrame, messages: DataFrame, ids: DataFrame, now: Column,
    least: int = MIN_SUBSCRIBERS, lexicon: Sequence[str] = FIRST_PERSON, needed: int = PRONOUNS_NEEDED,
) -> DataFrame:
    """The channel table after the claimed ids (id, claim_order) have been expanded once."""
    rows, ends = round_changes(channels, raw_channels, edges, messages, ids, now, least, lexicon, needed)
    return lifecycle.transition(upsert_channels(channels, rows), ends, now)


@contextmanager
def by_source(edges: DataFrame, folder: str, buckets: int | None = None) -> Iterator[DataFrame]:
    """Edges bucketed by src_id (as many buckets as shuffles have partitions), written once under the folder: a join on
    src_id shuffles the other side alone."""
    name, buckets = f"edges_{uuid.uuid4().hex}", buckets or int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = edges.repartition(buckets, "src_id").write.bucketBy(buckets, "src_id").sortBy("src_id")
    dealt.option("path", folder).saveAsTable(name)
    try:
        yield edges.sparkSession.table(name)
    finally:
        edges.sparkSession.sql(f"drop table {name}")  # what is external keeps its files


def expand_all(
    channels: Store, raw_channels: DataFrame, edges: DataFrame, messages: DataFrame, now: Column, seed: str,
    least: int = MIN_SUBSCRIBERS, lexicon: Sequence[str] = FIRST_PERSON, needed: int = PRONOUNS_NEEDED,
) -> DataFrame:
    """Expand every pending channel of the table, then what that finds, until no channel is pending; id and round of the
    channels found (claimed channels of the table are round 0's work, and what they find is of round 1).

    Each round is one write to the table, new channels and new states together, so that a run that breaks off goes on where
    it was. edges are dealt to their sources once: a round's join shuffles its frontier alone."""
    spark, home = channels.spark, shared_folder(channels.spark, "expand-all")
    spark.createDataFrame([], "id long").write.parquet(f"{home}/rounds/round=0")
    with by_source(edges, f"{home}/edges") as dealt:
        for k in count(1):
            known = channels.read()
            lifecycle.claim(known, None, seed).write.parquet(f"{home}/claimed-{k}")
            ids = spark.read.schema("id long, claim_order struct<draw: string, id: long>").parquet(f"{home}/claimed-{k}")
            if ids.isEmpty():
                break
            rows, ends = round_changes(known, raw_channels, dealt, messages, ids, now, least, lexicon, needed)
            rows.write.parquet(f"{home}/rounds/round={k}")
            rows = spark.read.schema(rows.schema).parquet(f"{home}/rounds/round={k}")
            channels.append(rows, ends.select("id", F.col("new_status").alias("status"), now.alias("updated_at")))
            if rows.isEmpty():
                break
    return spark.read.schema("id long, round int").option("basePath", f"{home}/rounds").parquet(f"{home}/rounds")


def expand(seeds: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """id, depth of all that seeds (id) reach along edges (src_id, id), until a round finds nothing new (or, as a guard,
    after so many rounds).

    Each round meets the whole visited set by an anti join, and is written before the next begins, which cuts lineage. Edges
    are dealt to their sources once; a round shuffles its frontier."""
    spark, folder = seeds.sparkSession, shared_folder(seeds.sparkSession, "expand")
    schema = "id long, depth int"
    seeds.select("id", F.lit(0).alias("depth")).distinct().write.parquet(f"{folder}/depth=0")
    with by_source(edges.select("src_id", "id"), f"{folder}-edges") as dealt:
        for depth in count(1) if max_rounds is None else range(1, max_rounds + 1):
            visited = spark.read.schema(schema).option("basePath", folder).parquet(folder)
            frontier = visited.where(F.col("depth") == depth - 1).select(F.col("id").alias("src_id"))
            reached = dealt.join(frontier, "src_id", "left_semi").select("id").distinct()
            fresh = reached.join(visited.select("id"), "id", "left_anti")
            fresh.write.parquet(f"{folder}/depth={depth}")
            if spark.read.schema("id long").parquet(f"{folder}/depth={depth}").isEmpty():
                break
    return spark.read.schema(schema).option("basePath", folder).parquet(folder)
