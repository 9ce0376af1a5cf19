"""Micro-batch ingest, embedding and expansion.

All write to stores by appends that carry the micro-batch's number, so a batch that is run again after a failure takes up
where it broke off and changes nothing twice. Late rows lose by their arrival number; no watermark is needed."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedgraph.functions.columns import post_key
from feedgraph.operators import discovery, lifecycle
from feedgraph.operators.embed import Encoder, embed_posts, encode_posts
from feedgraph.operators.metrics import message_counters
from feedgraph.operators.normalize import post_rows, real_messages
from feedgraph.operators.upsert import last_arrival
from feedgraph.schemas import CHANNELS, FAILED_POSTS, FIRST_PERSON, MIN_SUBSCRIBERS, POST_VECTORS, POSTS_WITH_SEQ, PRONOUNS_NEEDED, VECTOR_BATCH
from feedgraph.sources.store import Store, shared_folder

LANDED = "src_id long, pos int, cand struct<id: long, kind: string, broadcast: boolean, username: string, title: string>"
COMPACT_AFTER = 32  # writes


def channel_store(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    return Store(spark, path, CHANNELS, ["id"], ["created_at"], ["status", "updated_at"], buckets=buckets).create()


def post_store(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    return Store(spark, path, POSTS_WITH_SEQ, ["channel_id", "message_id"], ["id", "created_at"], newer_by="seq", buckets=buckets).create()


def vector_store(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    return Store(spark, path, POST_VECTORS, ["post_id"], buckets=buckets).create()


def failure_store(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    return Store(spark, path, FAILED_POSTS, ["post_id"], buckets=buckets).create()


def edge_store(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    return Store(spark, path, LANDED, ["src_id", "pos"], buckets=buckets, bucket_by=["src_id"]).create()


def id_store(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    return Store(spark, path, "id long, since long", ["id"], buckets=buckets).create()


def tidy(*stores: Store) -> None:
    """Compact what has many writes."""
    for store in stores:
        if len(store.folders()) > COMPACT_AFTER:
            store.compact()


def embed_into(
    posts: DataFrame, vectors: Store, failures: Store | None = None, encoder: Callable[[], Encoder] | None = None, dimension: int = 384, batch: int = VECTOR_BATCH, tag: tuple[str, int] | None = None
) -> None:
    """Encode posts (post_id, channel_id, content) with text once and write the points, and what failed to failures. A post
    that is encoded again leaves the failures. Without an encoder words are hashed, which never fails."""
    if encoder is None:
        vectors.append(embed_posts(posts, dimension), tag=tag)
        return
    path = shared_folder(vectors.spark, "encoded")
    done = encode_posts(posts, encoder, dimension, batch)
    done.withColumn("failed", F.col("error").isNotNull()).write.partitionBy("failed").parquet(path)
    done = vectors.spark.read.schema(f"{POST_VECTORS}, error string, failed boolean").parquet(path)
    if failures is not None:
        failures.delete(done.where("not failed"), tag=tag and (f"{tag[0]}-mended", tag[1]))
        failures.append(done.where("failed"), tag=tag)
    vectors.append(done.where("not failed"), tag=tag)


def ingest_batch(
    messages: DataFrame, posts: Store, vectors: Store | None, now: str, dimension: int, number: int, encoder: Callable[[], Encoder] | None = None, failures: Store | None = None
) -> None:
    """Put one micro-batch of raw messages into the posts, and points of those with text into the vectors."""
    tag = ("ingest", number)
    raw = last_arrival(real_messages(messages), ["channel_id", "id"])
    clock = F.lit(now).cast("timestamp")
    rows = post_rows(raw, "seq").select(post_key(F.col("channel_id"), F.col("message_id")).alias("id"), "*", clock.alias("created_at"), clock.alias("updated_at"))
    posts.append(rows, tag=tag)
    if vectors is not None and vectors.applied(tag[0]) < number:
        # Only rows that are the posts' latest are embedded; the lookup reads the buckets of the batch's keys.
        latest = posts.lookup(rows).select("channel_id", "message_id", F.col("id").alias("post_id"), F.col("seq").alias("latest"))
        fresh = rows.drop("id").join(latest, ["channel_id", "message_id"]).where("seq = latest")
        embed_into(fresh, vectors, failures, encoder, dimension, tag=tag)
    tidy(posts, *[s for s in (vectors, failures) if s is not None])


def start(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool) -> StreamingQuery:
    def kept(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            run(batch, number)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(kept).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def start_ingest(
    messages: DataFrame, posts: Store, vectors: Store | None, checkpoint: str, now: str, dimension: int, available_now: bool = True,
    encoder: Callable[[], Encoder] | None = None, failures: Store | None = None,
) -> StreamingQuery:
    """Each micro-batch's counters are in the query's progress, as observedMetrics["messages"]."""
    counted = messages.observe("messages", *[c.alias(n) for n, c in message_counters().items()])
    return start(counted, lambda batch, number: ingest_batch(batch, posts, vectors, now, dimension, number, encoder, failures), checkpoint, available_now)


def expand_batch(
    edges: DataFrame, channels: Store, landed: Store, expanded: Store, raw_channels: DataFrame, messages: DataFrame, now: Column, seed: str, number: int, least: int = MIN_SUBSCRIBERS,
    lexicon: Sequence[str] = FIRST_PERSON, needed: int = PRONOUNS_NEEDED,
) -> None:
    """Take new edges (src_id, pos, cand) in and expand to the end: after it no pending channel has landed edges.

    The first round expands the pending channels that the new edges come from, and follows those of channels that have
    been expanded already; a next one expands the channels that the last one has found and whose edges had landed before.
    So only the new edges and the frontier meet the tables, in their keys' buckets. A batch that is run again can't know
    which channels it had found, and begins with all pending ones that have edges. Each round is one write to channels.

    Which of several candidates' names is kept depends on the order of arrival; all else is the same however edges are
    split into batches."""
    again = not landed.append(edges, tag=("edges", number))
    came = edges.select(F.col("src_id").alias("id")).distinct()
    pending = landed.read().select(F.col("src_id").alias("id")).distinct() if again else came
    spark, home = channels.spark, shared_folder(channels.spark, "expansion")
    for k in count():
        known = channels.read() if again and k == 0 else channels.lookup(pending)
        lifecycle.claim(known.join(pending, "id", "left_semi"), None, seed).write.parquet(f"{home}/claimed-{k}")
        ids = spark.read.schema("id long, claim_order struct<draw: string, id: long>").parquet(f"{home}/claimed-{k}")
        own = landed.lookup(ids.select(F.col("id").alias("src_id")))
        late = edges.join(expanded.lookup(came).select(F.col("id").alias("src_id"), F.struct(F.lit("").alias("draw"), "id").alias("claim_order")), "src_id") if k == 0 else None
        if ids.isEmpty() and (late is None or late.isEmpty()):
            break
        reached = own.select("cand.id") if late is None else own.select("cand.id").union(late.select("cand.id"))
        rows, ends = discovery.round_changes(channels.lookup(reached), raw_channels, own, messages, ids, now, least, lexicon, needed, late)
        rows.write.parquet(f"{home}/found-{k}")
        rows = spark.read.schema(rows.schema).parquet(f"{home}/found-{k}")
        expanded.append(ends.where(F.col("new_status") == lifecycle.READY).select("id", F.lit(number).alias("since")))
        channels.append(rows, ends.select("id", F.col("new_status").alias("status"), now.alias("updated_at")))
        if rows.isEmpty():
            break
        pending = landed.lookup(rows.select(F.col("id").alias("src_id"))).select(F.col("src_id").alias("id")).distinct()
    tidy(channels, landed, expanded)


def start_expansion(
    edges: DataFrame, channels: Store, landed: Store, expanded: Store, raw_channels: DataFrame, messages: DataFrame, checkpoint: str, now: str, seed: str, least: int = MIN_SUBSCRIBERS,
    lexicon: Sequence[str] = FIRST_PERSON, needed: int = PRONOUNS_NEEDED, available_now: bool = True,
) -> StreamingQuery:
    """Newly arrived edges expand the channels that they come from, and all that is found on the way."""
    clock = F.lit(now).cast("timestamp")
    return start(edges, lambda batch, number: expand_batch(batch, channels, landed, expanded, raw_channels, messages, clock, seed, number, least, lexicon, needed), checkpoint, available_now)
