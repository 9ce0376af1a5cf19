"""Windows, upserts, constraints, lifecycle, discovery, embedding and the store."""

from __future__ import annotations

import datetime as dt
import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from feedgraph.operators import authorship, constraints, discovery, embed, lifecycle, metrics, normalize, search, topk, upsert
from feedgraph.schemas import CHANNELS, POST_VECTORS, POSTS_WITH_SEQ, RAW_MESSAGE
from feedgraph.sources import bronze
from feedgraph.sources.store import Store
from feedgraph.streaming import jobs

DAY = dt.datetime(2024, 1, 1)


def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def messages(spark, rows):
    full = [(*r, *[None] * (11 - len(r))) for r in rows]
    return spark.createDataFrame(full, RAW_MESSAGE)


def message(channel, number, kind="message", text=None, video=None, seq=None, views=None):
    return (channel, number, kind, DAY, text, views, None, None, None, video, seq)


def test_service_messages_use_up_the_limit(spark):
    frame = messages(spark, [message(1, k, "service" if k > 9 else "message") for k in range(1, 13)])
    assert topk.newest_posts(frame, 10).count() == 7


def test_message_filter(spark):
    rows = [message(1, 1), message(1, None), (1, 2, "message", None, *[None] * 7), message(1, 3, "service")]
    assert [r.id for r in normalize.real_messages(messages(spark, rows)).collect()] == [1]


@pytest.mark.parametrize(
    ("rows", "flag"),
    [
        ([message(1, 1, text="я думаю"), message(1, 2, text="мне")], True),
        ([message(1, 1, text="я я я"), *[message(1, k, text="-") for k in range(2, 17)]], False),
        ([message(1, 1, text="-", video=True)], True),
        ([], False),
    ],
)
def test_author_flag(spark, rows, flag):
    channels = spark.createDataFrame([(1,)], "id long")
    assert authorship.author_flags(channels, messages(spark, rows)).first().is_author_blog is flag


def test_subscriber_gate(spark):
    frame = spark.createDataFrame([(1, None), (2, 2999), (3, 3000)], "id long, subscribers_count int")
    assert [r.id for r in discovery.subscriber_gate(frame).collect()] == [3]


def channel(spark, *rows):
    return spark.createDataFrame([(i, "u", "t", None, s, None, status, flag, DAY, DAY) for i, s, status, flag in rows], CHANNELS)


@pytest.mark.parametrize(("preserve", "status", "flag"), [((), "pending", None), (("status", "is_author_blog"), "parsed", True)])
def test_channel_upsert(spark, preserve, status, flag):
    base = channel(spark, (1, 5, "parsed", True))
    later = F.lit("2024-06-01 00:00:00").cast("timestamp")
    fresh = channel(spark, (1, None, "x", None), (2, 9, "x", None)).drop("status", "is_author_blog", "created_at").withColumn("updated_at", later)
    rows = {r.id: r for r in upsert.upsert_channels(base, fresh, preserve).collect()}
    assert (rows[1].status, rows[1].is_author_blog, rows[1].created_at, rows[1].subscribers_count) == (status, flag, DAY, None)
    assert rows[1].updated_at == dt.datetime(2024, 6, 1)
    assert (rows[2].status, rows[2].is_author_blog) == ("pending", None)


def test_null_overwrites_and_last_arrival(spark):
    base = spark.createDataFrame([(1, 5)], "k long, v int")
    incoming = spark.createDataFrame([(1, None)], "k long, v int")
    assert upsert.upsert(base, incoming, ["k"], ["v"]).first().v is None
    arrivals = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (2, 3, 3), (2, 3, 4)], "k long, seq long, v int")
    assert {r.k: r.v for r in upsert.last_arrival(arrivals, ["k"]).collect()} == {1: 20, 2: 4}
    with pytest.raises(ValueError, match="neither"):
        upsert.upsert(base, incoming, ["k"], [])


def test_constraints(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (3, "x" * 5)], "id long, title string")
    assert [tuple(r) for r in constraints.duplicate_keys(rows, ["id"]).collect()] == [(1, 2)]
    good, bad = constraints.split_by_violations(rows, ["title"], {"title": 4})
    assert good.count() == 2
    assert {r.id: r.reasons for r in bad.collect()} == {2: ["title is null"], 3: ["title is longer than 4"]}
    parents = spark.createDataFrame([(1,)], "pid long")
    kept, orphans = constraints.split_by_parent(rows, parents, "id", "pid")
    assert (kept.count(), orphans.count()) == (2, 2)
    assert constraints.cascade_delete(rows, spark.createDataFrame([(1,)], "id long"), "id").count() == 2


def test_lifecycle(spark):
    base = channel(spark, (1, 5, "pending", None), (2, 5, "ready_for_parsing", None), (3, 5, "ready_for_parsing", True), (4, 1, "pending", None))
    assert [r.id for r in lifecycle.ready_author_channels(base).collect()] == [3]
    ids = lifecycle.claim(base, 1, "s")
    moved = lifecycle.claimed(base, ids, now())
    assert moved.where("status = 'processing'").count() == 1
    assert lifecycle.claim(moved, 5, "s").join(ids, "id").count() == 0
    unknown = spark.createDataFrame([(99, "parsed")], "id long, new_status string")
    assert sorted(lifecycle.transition(base, unknown, now()).collect()) == sorted(base.collect())


def test_expansion_saves_a_channel_once(spark):
    known = channel(spark, (1, 5000, "pending", None), (2, 5000, "pending", None), (3, 1, "pending", None))
    cand = "src_id long, pos int, cand struct<id: long, kind: string, broadcast: boolean, username: string, title: string>"
    edges = spark.createDataFrame([(s, p, (c, "channel", True, u, "t")) for s, p, c, u in ((1, 0, 10, "a"), (2, 0, 10, "a"), (2, 1, 11, ""), (1, 1, 2, "b"), (1, 2, 12, "c"))], cand)
    raw_kind = "id long, kind string, access_hash long, broadcast boolean, full_chat struct<participants_count: int, about: string>"
    raw = spark.createDataFrame([(1, "channel", 1, True, (1, "")), (2, "channel", 1, True, (1, "")), (10, "channel", 1, True, (4000, "about")), (12, "channel", None, True, (9000, ""))], raw_kind)
    ids = lifecycle.claim(known, 3, "s")
    grown = discovery.expand_round(known, raw, edges, messages(spark, []), ids, now())
    assert {r.id: r.status for r in grown.collect()} == {1: "ready_for_parsing", 2: "ready_for_parsing", 3: "rejected", 10: "pending"}
    assert grown.where("id = 10 and not is_author_blog and subscribers_count = 4000").count() == 1


def test_frontier_on_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src_id long, id long")
    seeds = spark.createDataFrame([(1,)], "id long")
    assert {r.id: r.depth for r in discovery.expand(seeds, edges, 9).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    assert discovery.expand(seeds, edges, 1).count() == 2


def test_rounds_shuffle_their_frontier_only(spark, tmp_path):
    edges = spark.range(1000).selectExpr("id % 100 as src_id", "id")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        with discovery.by_source(edges, str(tmp_path / "edges"), 4) as dealt:
            joined = dealt.join(spark.range(5).withColumnRenamed("id", "src_id").repartition(3), "src_id", "left_semi")
            assert joined.count() == 50 and joined._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0].count("hashpartitioning(src_id") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_embedding_stays_on_its_post(spark):
    posts = spark.createDataFrame([(1, 7, "A a b"), (2, 7, "  "), (3, 7, "B"), (4, 7, None), (5, 7, "..")], "post_id long, channel_id long, content string")
    found = {r.post_id: np.array(r.vector) for r in embed.embed_posts(posts, 16).collect()}
    assert sorted(found) == [1, 3, 5]
    assert np.linalg.norm(found[1]) == pytest.approx(1)
    assert sorted(found[1][found[1] > 0]) == pytest.approx([1 / 5**0.5, 2 / 5**0.5])
    assert not found[5].any()


def test_embedding_sends_words_alone_and_counts_few_at_once(spark, monkeypatch):
    posts = spark.createDataFrame([(1, 7, "A a b")], "post_id long, channel_id long, content string")
    shown = embed.embed_posts(posts, 16).select("post_id", F.posexplode("vector"), "text").where("col <> 0")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in shown and shown.count("ArrowEvalPython") == 1  # the text stays, and vectors are computed once
    lists = [["a", "b", "a"], None, [], [""], ["c"] * 7, ["b", ""], ["d", "a", "c", "b"]]
    whole = embed._hashed(pa.array(lists, type=pa.list_(pa.string())), 8).to_pylist()
    counted = []
    monkeypatch.setattr(np, "bincount", lambda a, f=np.bincount, **more: counted.append(len(a)) or f(a, **more))
    monkeypatch.setattr(embed, "WORDS", 4)
    assert embed._hashed(pa.array([["x"], *lists], type=pa.list_(pa.string())).slice(1), 8).to_pylist() == whole
    assert [v is None for v in whole] == [False, True, True, True, False, False, False]
    assert len(counted) > 2 and sum(counted) == 15 and max(counted) == 7  # one row alone may be longer


def test_one_failing_row_does_not_take_its_batch(spark):
    def failing():
        def run(texts):
            if "bad" in texts:
                raise ValueError("no")
            return np.array([[len(t), 1.0] for t in texts])

        return run

    frame = spark.createDataFrame([("a",), ("bad",), ("ccc",)], "text string").coalesce(1)
    found = {r.text: (r.vector, r.error) for r in embed.encode(frame, failing, 2).collect()}
    assert found == {"a": ([1.0, 1.0], None), "bad": (None, "no"), "ccc": ([3.0, 1.0], None)}


def test_batches_are_chunks_of_the_job_with_a_flush(spark):
    sizes = spark.sparkContext.accumulator(0)

    def counting():
        def run(texts):
            assert len(texts) in (7, 3)
            sizes.add(1)
            return np.ones((len(texts), 1))

        return run

    frame = spark.range(0, 52, 1, 1).selectExpr("cast(id as string) as text")
    assert embed.encode(frame, counting, 1, batch=7).count() == 52 and embed.encode(frame, counting, 1, batch=7).where("vector is not null").count() == 52


def test_search(spark):
    rows = [(1, [1.0, 0.0], 1, ""), (2, [0.0, 0.0], 1, ""), (3, [1.0, 1.0], 2, ""), (4, [2.0, 0.0], 2, "")]
    points = spark.createDataFrame(rows, POST_VECTORS)
    queries = spark.createDataFrame([(9, [1.0, 0.0]), (8, [0.0, 0.0])], "query_id long, vector array<float>")
    assert [(r.query_id, r.post_id) for r in search.cosine_topk(points, queries, 5).orderBy("rank").collect()] == [(9, 1), (9, 4), (9, 3)]
    assert [r.post_id for r in search.cosine_topk(points, queries, 5, channel_id=2, block=1).orderBy("rank").collect()] == [4, 3]
    assert search.cosine_topk(points.limit(0), queries, 5).count() == 0 and search.cosine_topk(points.where("post_id = 2"), queries, 5).count() == 0


def test_search_skips_tiles_and_loses_nothing(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 8)) * 5
    vectors = (centres[rng.integers(0, 12, 900)] + rng.standard_normal((900, 8)) * 0.3).astype(np.float32)
    vectors[100:140] = vectors[100]  # ties
    points = spark.createDataFrame([(k, v.tolist(), 0, "") for k, v in enumerate(vectors)], POST_VECTORS).repartition(3)
    queries = points.where("post_id % 9 = 0").select(F.col("post_id").alias("query_id"), "vector")
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    found = search.cosine_topk(points, queries, 6, block=16, point_block=32)
    assert not any(word in found._jdf.queryExecution().toString() for word in ("CartesianProduct", "BroadcastNestedLoopJoin"))
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.post_id, r.score))
    assert sorted(got) == list(range(0, 900, 9))
    for q, hits in got.items():
        scores = unit @ unit[q]
        best = np.sort(scores)[::-1][:6]
        assert np.allclose([s for _, _, s in sorted(hits)], best, atol=1e-12)
        assert all(abs(scores[p] - s) < 1e-12 for _, p, s in hits)
    index = search.Index(points.select(F.col("post_id").alias("id"), "vector"), 32)
    visits = search.search(index, queries, 6, 16)[1]
    assert search.tiles_visited(index, visits, 100) < 0.5


def test_search_sends_a_query_once_to_a_shard(spark, monkeypatch):
    monkeypatch.setattr(search, "HELD", 8 * 16 * 100)  # shards of at most 100 points, shares of 100 queries
    vectors = np.random.default_rng(2).standard_normal((1500, 16)).astype(np.float32)
    vectors[200:600] = vectors[200]  # one ring of several shards
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "id long, vector array<float>").repartition(3)
    queries = points.where("id % 5 = 1").select(F.col("id").alias("query_id"), "vector")
    index = search.Index(points, 64)
    hits, visits = search.search(index, queries, 4, 32)
    sizes = [r["count"] for r in index.points.groupBy("shard").count().collect()]
    assert len(sizes) == index.shards < len(index.rings) and max(sizes) < 150
    sent = list(search._routed(iter(queries.withColumn("least", F.lit(search.NOTHING)).toArrow().to_batches()), index.table, 4, True, True))
    assert sum(b.num_rows for b in sent) == 300 * index.shards  # all rings are visited, but a vector travels by shards
    assert visits.where("pass = 2").count() > 300 * index.shards
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    got = {}
    for r in search._ranked(hits, 4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.post_id))
    assert sorted(got) == list(range(1, 1500, 5))
    for q, found in got.items():
        scores = unit @ unit[q]
        assert np.allclose([scores[p] for _, p in sorted(found)], np.sort(scores)[::-1][:4], atol=1e-12)
    assert sorted(got[201]) == [(1, 200), (2, 201), (3, 202), (4, 203)]


def test_edges_are_dealt_to_as_many_tasks_as_lines_ask_for(spark, tmp_path):
    from feedgraph.plans import bindings

    rng = np.random.default_rng(3)
    lines = list(zip(rng.integers(0, 60, 300).tolist(), rng.integers(0, 15, 300).tolist(), strict=True))
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"p{k}", 1000.0, 1) for k in range(15)], "p_partkey long, p_name string, p_retailprice double, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = bindings.edges(spark, str(tmp_path), 20)
    assert "hashpartitioning(one" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 15), REPARTITION_BY_NUM" in plan  # four by default
    orders = [{p for o, p in lines if o == k} for k in range(60)]
    often = {(a, b) for a in range(15) for b in range(15) if a != b and sum(a in o and b in o for o in orders) >= 2}
    got = [(r.src_id, r.id) for r in found.select("src_id", "cand.id").collect()]
    assert len(got) == len(often) and set(got) == often


def rows_of(spark, pairs):
    return spark.createDataFrame(pairs, "k long, v int")


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), "k long, v int, made int", ["k"], ["made"], buckets=4)
    assert not store.exists() and store.create().create().read().count() == 0 and store.exists()
    put = lambda pairs, made, **more: store.append(rows_of(spark, pairs).withColumn("made", F.lit(made)), **more)
    put([(k, k) for k in range(20)], 1)
    put([(k, -1) for k in range(3)], 2)
    put([], 3)
    state = {k: (-1 if k < 3 else k, 1) for k in range(20)}
    assert {r.k: (r.v, r.made) for r in store.read().collect()} == state
    store.compact()
    assert [f[0] for f in store.folders()] == ["base"] and {r.k: (r.v, r.made) for r in store.read().collect()} == state
    put([(5, None), (99, 9)], 4)
    assert {r.k: (r.v, r.made) for r in store.read().collect()} == state | {5: (None, 1), 99: (9, 4)}
    store.delete(rows_of(spark, [(5, 0), (6, 0), (1000, 0)]))
    put([(6, 66)], 5)
    final = {k: v for k, v in (state | {99: (9, 4), 6: (66, 5)}).items() if k != 5}
    for _ in range(3):
        assert {r.k: (r.v, r.made) for r in store.read().collect()} == final
        assert {r.k: r.v for r in store.lookup(rows_of(spark, [(5, 0), (6, 0), (7, 0)])).collect()} == {6: 66, 7: 7}
        store.compact()


def test_a_write_is_as_many_rows_as_it_puts_in_and_happens_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), "k long, v int", ["k"], newer_by="v", buckets=16).create()
    store.append(rows_of(spark, [(k, k) for k in range(5000)]), tag=("in", 0))
    assert store.append(rows_of(spark, [(1, 50), (2, 0)]), tag=("in", 1)) and not store.append(rows_of(spark, [(1, 70)]), tag=("in", 1))
    assert spark.read.parquet(str(tmp_path / "t" / store.folders()[-1][2])).count() == 2
    assert {r.k: r.v for r in store.lookup(rows_of(spark, [(1, 0), (2, 0)])).collect()} == {1: 50, 2: 2}  # the older row loses
    store.compact()
    assert store.applied("in") == 1 and not store.append(rows_of(spark, [(1, 70)]), tag=("in", 1)) and store.applied("other") == -1
    plan = store.lookup(rows_of(spark, [(1, 0)]))._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan and "bucket" in plan[plan.index("PartitionFilters") : plan.index("PartitionFilters") + 200]


def test_compaction_stops_before_a_write_that_is_under_way(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), "k long, v int", ["k"]).create()
    store.append(rows_of(spark, [(1, 1)]))
    slow = store._reserve()
    store.append(rows_of(spark, [(1, 3)]))
    store.compact()
    assert [f[:2] for f in store.folders()] == [("base", 0), ("delta", 2)]
    store._write(store._full(rows_of(spark, [(1, 2), (2, 2)]), 0), slow, f"write=delta-{slow:012d}")
    assert {r.k: r.v for r in store.read().collect()} == {1: 3, 2: 2}
    store._reserve()
    store.compact(patience=-1)  # whoever reserved it is dead
    assert [f[:2] for f in store.folders()] == [("base", 2)] and {r.k: r.v for r in store.read().collect()} == {1: 3, 2: 2}


def test_claims_of_two_workers_share_nothing(spark, tmp_path):
    store = jobs.channel_store(spark, str(tmp_path / "channels"), 2)
    store.append(channel(spark, *[(k, 5, "pending" if k % 4 else "parsed", None) for k in range(40)]))
    with ThreadPoolExecutor(2) as pool:
        took = list(pool.map(lambda w: [r.id for _ in range(3) for r in lifecycle.claim_exclusively(store, 4, f"worker {w}", now()).collect()], range(2)))
    assert len(set(took[0]) | set(took[1])) == 24
    state = {r.id: r.status for r in store.read().collect()}
    assert {k for k, v in state.items() if v == "processing"} == {*took[0], *took[1]} and sum(v == "parsed" for v in state.values()) == 10
    assert lifecycle.claim_exclusively(store, None, "rest", now()).count() == 6 and lifecycle.claim_exclusively(store, 5, "none", now()).count() == 0
    store.exclusive("claims/000000000008")
    with pytest.raises(TimeoutError):
        lifecycle.claim_exclusively(store, 1, "x", now(), patience=0.1)


def test_patches_change_rows_that_are_there_only(spark, tmp_path):
    store = jobs.channel_store(spark, str(tmp_path / "channels"), 2)
    store.append(channel(spark, (1, 5, "pending", None)))
    store.append(patches=spark.createDataFrame([(1, "parsed"), (2, "parsed")], "id long, status string").withColumn("updated_at", now()))
    assert [(r.id, r.status, r.subscribers_count) for r in store.read().collect()] == [(1, "parsed", 5)]
    store.append(channel(spark, (1, 7, "rejected", True)))
    assert [(r.status, r.subscribers_count) for r in store.read().collect()] == [("rejected", 7)]


def test_rows_count_themselves_as_they_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, ""), (3, " "), (4, None)], "k long, content string")
    store = Store(spark, str(tmp_path / "t"), "k long, content string", ["k"]).create()
    counted, seen = metrics.observed(rows, "posts", metrics.post_counters())
    store.append(counted)
    assert seen.get == {"n_rows": 4, "n_saved": 2, "n_valid": 1}


def landed_messages(spark, path, seed=3):
    rng = random.Random(seed)
    rows = [message(rng.randrange(4), rng.randrange(6), text=f"text {k}" if k % 5 else "bad", seq=k, views=k) for k in range(60)]
    for part in (rows[40:], rows[:20], rows[20:40], rows[:5]):
        messages(spark, part).coalesce(1).write.mode("append").parquet(path)
    return {(r[0], r[1]): r for r in rows}


def test_stream_ends_as_one_batch(spark, tmp_path):
    latest = landed_messages(spark, str(tmp_path / "landed"))
    posts, points = jobs.post_store(spark, str(tmp_path / "posts"), 2), jobs.vector_store(spark, str(tmp_path / "points"), 2)
    feed = bronze.stream_raw(spark, "raw_messages", str(tmp_path / "landed"), files_per_batch=1)
    query = jobs.start_ingest(feed, posts, points, str(tmp_path / "check"), "2024-01-01 00:00:00", 8)
    query.awaitTermination()
    counted = [p.observedMetrics["messages"] for p in query.recentProgress if p.observedMetrics]
    assert [(c.n_messages, c.n_real, c.n_valid) for c in counted] == [(20, 20, 20)] * 3 + [(5, 5, 5)]
    assert {(r.channel_id, r.message_id): r.seq for r in posts.read().collect()} == {k: r[10] for k, r in latest.items()}
    assert points.read().count() == len(latest)


def test_stream_goes_on_after_it_was_killed_between_two_writes(spark, tmp_path):
    latest = landed_messages(spark, str(tmp_path / "landed"))

    def encoder():
        def run(texts):
            if "bad" in texts:
                raise ValueError("unreadable")
            return np.array([[len(t), 1.0] for t in texts])

        return run

    posts, points, failures = jobs.post_store(spark, str(tmp_path / "posts"), 2), jobs.vector_store(spark, str(tmp_path / "points"), 2), jobs.failure_store(spark, str(tmp_path / "failures"), 2)
    feed = bronze.stream_raw(spark, "raw_messages", str(tmp_path / "landed"), files_per_batch=2)
    run = lambda vectors: jobs.start_ingest(feed, posts, vectors, str(tmp_path / "check"), "2024-01-01 00:00:00", 2, encoder=encoder, failures=failures).awaitTermination()
    broken = jobs.vector_store(spark, str(tmp_path / "points"), 2)
    broken.append = lambda *_, **__: 1 / 0
    with pytest.raises(StreamingQueryException):
        run(broken)
    assert posts.applied("ingest") == 0 and points.applied("ingest") == -1
    run(points)
    assert {(r.channel_id, r.message_id): r.seq for r in posts.read().collect()} == {k: r[10] for k, r in latest.items()}
    texts = {r.post_id: r.text for r in points.read().collect()}
    bad = {r.post_id for r in failures.read().collect()}
    keys = {(r.channel_id, r.message_id): r.id for r in posts.read().collect()}
    assert bad >= {keys[k] for k, r in latest.items() if r[4] == "bad"}
    assert {k: texts.get(keys[k]) for k, r in latest.items() if r[4] != "bad"} == {k: r[4] for k, r in latest.items() if r[4] != "bad"}
    assert all(keys[k] not in bad for k, r in latest.items() if r[4] != "bad")


def world(spark):
    """A chain of channels, one of which cannot be resolved, and edges; (known, raw, edges)."""
    known = channel(spark, (1, 5000, "pending", None), (2, 5000, "pending", None), (3, 5000, "parsed", None), (4, 1, "pending", None))
    raw_kind = "id long, kind string, access_hash long, broadcast boolean, full_chat struct<participants_count: int, about: string>"
    raw = spark.createDataFrame([(k, "channel", 1, True, (4000 if k != 13 else 9, "")) for k in (1, 3, 4, *range(10, 20))], raw_kind)
    pairs = [(1, 10), (10, 11), (11, 12), (12, 1), (11, 13), (13, 14), (3, 15), (2, 16), (12, 17), (17, 3), (1, 18)]
    cand = "src_id long, pos int, cand struct<id: long, kind: string, broadcast: boolean, username: string, title: string>"
    return known, raw, [spark.createDataFrame([(s, t, (t, "channel", True, f"u{t}", f"t{t}"))], cand) for s, t in pairs], cand


WHOLE = {1: "ready_for_parsing", 2: "rejected", 3: "parsed", 4: "pending", 10: "ready_for_parsing", 11: "ready_for_parsing", 12: "ready_for_parsing", 17: "ready_for_parsing", 18: "pending"}


@pytest.mark.parametrize("split", [[range(11)], [[2, 6, 8], [1, 9, 5], [0, 7], [3, 4, 10]], [[0], [10, 1, 4], [2, 3, 5, 6, 7, 8, 9]]])
def test_expansion_reaches_all_that_landed_edges_reach(spark, tmp_path, split):
    known, raw, edges, _ = world(spark)
    stores = jobs.channel_store(spark, str(tmp_path / "c"), 2), jobs.edge_store(spark, str(tmp_path / "e"), 2), jobs.id_store(spark, str(tmp_path / "x"), 2)
    stores[0].append(known)
    for k, part in enumerate(split):
        batch = edges[part[0]]
        for e in part[1:]:
            batch = batch.union(edges[e])
        for _ in range(1 + (k == 1)):  # one batch comes twice
            jobs.expand_batch(batch, *stores, raw, messages(spark, []), now(), "s", k)
    assert {r.id: r.status for r in stores[0].read().collect()} == WHOLE


def test_expansion_goes_on_after_a_failure_within_a_batch(spark, tmp_path):
    known, raw, edges, _ = world(spark)
    stores = jobs.channel_store(spark, str(tmp_path / "c"), 2), jobs.edge_store(spark, str(tmp_path / "e"), 2), jobs.id_store(spark, str(tmp_path / "x"), 2)
    stores[0].append(known)
    batch = edges[0]
    for e in edges[1:]:
        batch = batch.union(e)
    broken, wrote = jobs.channel_store(spark, str(tmp_path / "c"), 2), []

    def append(*parts, **more):
        wrote.append(1)
        if len(wrote) > 2:
            raise OSError("killed")
        return stores[0].append(*parts, **more)

    broken.append = append
    with pytest.raises(OSError):
        jobs.expand_batch(batch, broken, *stores[1:], raw, messages(spark, []), now(), "s", 0)
    assert {r.id: r.status for r in stores[0].read().collect()} != WHOLE
    jobs.expand_batch(batch, *stores, raw, messages(spark, []), now(), "s", 0)
    assert {r.id: r.status for r in stores[0].read().collect()} == WHOLE


def test_whole_rounds_until_nothing_is_pending(spark, tmp_path):
    known, raw, edges, _ = world(spark)
    store = jobs.channel_store(spark, str(tmp_path / "c"), 2)
    store.append(known)
    batch = edges[0]
    for e in edges[1:]:
        batch = batch.union(e)
    found = discovery.expand_all(store, raw, batch, messages(spark, []), now(), "s")
    assert {r.id: r.round for r in found.collect()} == {10: 1, 18: 1, 11: 2, 12: 3, 17: 4}
    assert {r.id: r.status for r in store.read().collect()} == WHOLE | {4: "ready_for_parsing", 18: "ready_for_parsing"}


def test_deletion_takes_posts_and_points_along(spark, tmp_path):
    channels, posts, vectors = jobs.channel_store(spark, str(tmp_path / "c"), 2), jobs.post_store(spark, str(tmp_path / "p"), 2), jobs.vector_store(spark, str(tmp_path / "v"), 2)
    channels.append(channel(spark, (1, 5, "parsed", None), (2, 5, "parsed", None), (3, 5, "parsed", None)))
    rows = [(10 * c + m, c, m, "x", DAY, 1, None, None, None, DAY, DAY, 1) for c in (1, 2) for m in (1, 2)]
    posts.append(spark.createDataFrame(rows, POSTS_WITH_SEQ))
    vectors.append(spark.createDataFrame([(r[0], [1.0], r[1], "x") for r in rows], POST_VECTORS))
    ids = spark.createDataFrame([(1,), (3,), (77,)], "id long")
    for _ in range(2):
        constraints.delete_channels(ids, channels, posts, vectors)
        assert [r.id for r in channels.read().collect()] == [2]
        assert sorted(r.id for r in posts.read().collect()) == sorted(r.post_id for r in vectors.read().collect()) == [21, 22]
        for store in (channels, posts, vectors):
            store.compact()
    channels.append(channel(spark, (1, 6, "pending", None)))
    assert sorted((r.id, r.subscribers_count) for r in channels.read().collect()) == [(1, 6), (2, 5)]
