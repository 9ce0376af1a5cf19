"""Exact cosine search by pivots.

Points are grouped around pivots, a bounded sample of them, by the smallest angle, and within a group by rings of that
angle. For angles the triangle inequality holds: a point of a ring whose angles to the pivot are between a and b is at
least max(t - b, a - t) from a query whose angle to the pivot is t. A query first visits the nearest pivots that hold k
points, which bounds its k-th angle; then it visits the rings that may hold a nearer point, and no others.

Rings are put together to shards of bounded size (a ring of many points is dealt to several), and a query is sent to
each shard with a ring to visit once, not to each ring. A task meets one shard and one bounded share of the queries, which
come to Python once each and are scored ring by ring. Every point that is skipped is skipped by proof.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedgraph.sources.store import shared_folder

HITS = "query_id long, post_id long, score double"
PIVOTS, RINGS = 128, 64  # rings from an angle of zero to half a turn
SLACK = 1e-6  # radians; angles near zero are known to about 1e-8 only
ROUNDING = 1e-9  # of scores
NOTHING = -2.0  # below all scores
SHARDS = 32  # at least, where each gets an eighth of a block of points
HELD = 1 << 24  # bytes of a task's unit vectors, of points and of queries
SCORES = 1 << 20  # held at once
ROUTED = 256  # queries whose rings are looked through at once


def unit(vectors: pa.Array, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and which rows have one (zero vectors do not)."""
    matrix = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
    norms = np.linalg.norm(matrix, axis=1)
    good = norms > 0
    return matrix[good] / norms[good, None], good


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _placed(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds to each point that has a direction its pivot and the angle to it."""
    for batch in batches:
        if batch.num_rows:
            own, good = unit(batch.column("vector"), batch.num_rows)
            theta = angles(own, pivots)
            nearest = theta.argmin(axis=1) if len(own) else np.zeros(0, dtype=np.int64)
            kept = batch.filter(pa.array(good))
            angle = theta[np.arange(len(own)), nearest]
            yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("vector"), pa.array(nearest.astype(np.int32)), pa.array(angle)], names=["id", "vector", "pivot", "angle"])


@dataclass
class Rings:
    """Rings by pivot and number, with their counts and bounds, and the shards of each: at most PIVOTS times RINGS + 1."""

    pivots: np.ndarray
    pivot: np.ndarray
    ring: np.ndarray
    count: np.ndarray
    low: np.ndarray
    high: np.ndarray
    shard: np.ndarray
    parts: np.ndarray

    def visited(self, own: np.ndarray, least: np.ndarray, k: int, second: bool, chosen: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Which of the (chosen) rings each query visits: at first those of the nearest pivots that hold k points, then all
        that may hold a point whose score is not below the least one."""
        theta = angles(own, self.pivots)
        of_pivot = self.pivot[chosen]
        if second:
            to, bound = theta[:, of_pivot], np.arccos(np.clip(least, -1.0, 1.0))
            return np.maximum(to - self.high[chosen], self.low[chosen] - to) <= bound[:, None] + SLACK
        per_pivot = np.bincount(self.pivot, self.count, minlength=len(self.pivots))
        order = np.argsort(theta, axis=1)
        before = np.cumsum(per_pivot[order], axis=1) - per_pivot[order]
        near = np.zeros(theta.shape, dtype=bool)
        np.put_along_axis(near, order, before < k, axis=1)
        return near[:, of_pivot]


def _shards(rings: list[tuple], size: int) -> list[tuple[int, int]]:
    """The first shard of each ring and how many it has; small rings that follow one another share one."""
    out, shard, room = [], -1, 0
    for _, _, n, _, _ in rings:
        parts = -(-n // size)
        if parts > 1 or n > room:
            shard, room = shard + 1, size
        out.append((shard, parts))
        shard, room = (shard + parts - 1, 0) if parts > 1 else (shard, room - n)
    return out


class Index:
    """Points (id, vector) with their pivot and angle, written as a table, and the rings' counts and bounds, at most PIVOTS
    times RINGS + 1 rows, on the driver."""

    def __init__(self, points: DataFrame, rows: int, pivots: int = PIVOTS) -> None:
        spark = points.sparkSession
        self.spark, home = spark, shared_folder(spark, "pivots")
        good = points.where("id is not null and vector is not null and size(vector) > 0")
        drawn = good.orderBy(F.md5(F.col("id").cast("string")), "id").limit(pivots).toArrow()
        if drawn.num_rows == 0:
            self.rings = []
            return
        own = unit(drawn.column("vector").combine_chunks(), drawn.num_rows)[0]
        if len(own) == 0:
            own = np.eye(1, len(drawn.column("vector")[0]))
        kind = points.schema["vector"].dataType.simpleString()
        good.select("id", "vector").mapInArrow(lambda it: _placed(it, own), f"id long, vector {kind}, pivot int, angle double").write.parquet(f"{home}/placed")
        ringed = spark.read.parquet(f"{home}/placed").withColumn("ring", F.floor(F.col("angle") / (np.pi / RINGS)).cast("int"))
        counted = ringed.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
        self.rings = sorted((r["pivot"], r["ring"], r["n"], r["low"], r["high"]) for r in counted.collect())
        if not self.rings:
            return
        self.held = max(1, HELD // (8 * own.shape[1]))
        total = sum(n for _, _, n, _, _ in self.rings)
        shards = _shards(self.rings, max(1, min(4 * rows, self.held, max(rows // 8, total // SHARDS))))
        self.shards = shards[-1][0] + shards[-1][1]
        columns = [np.array(c) for c in zip(*self.rings, strict=True)]
        self.table = Rings(own, *columns, *[np.array(c) for c in zip(*shards, strict=True)])
        places = spark.createDataFrame([(p, r, s, n) for (p, r, _, _, _), (s, n) in zip(self.rings, shards, strict=True)], "pivot int, ring int, first long, parts long")
        shard = F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))
        self.points = ringed.join(F.broadcast(places), ["pivot", "ring"]).select(shard.alias("shard"), "pivot", "ring", "id", "vector")


def _routed(batches: Iterator[pa.RecordBatch], rings: Rings, k: int, second: bool, by_shard: bool) -> Iterator[pa.RecordBatch]:
    """A row for each query and shard that it is sent to, or else for each query and ring that it visits."""
    of_ring = np.repeat(np.arange(len(rings.ring)), rings.parts)
    of_shard = rings.shard[of_ring] + np.arange(len(of_ring)) - np.repeat(np.cumsum(rings.parts) - rings.parts, rings.parts)
    starts = np.flatnonzero(np.diff(of_shard, prepend=-1))
    for whole in batches:
        for at in range(0, whole.num_rows, ROUTED):
            batch = whole.slice(at, ROUTED)
            own, good = unit(batch.column("vector"), batch.num_rows)
            kept = batch.filter(pa.array(good))
            if not len(own):
                continue
            visited = rings.visited(own, kept.column("least").to_numpy(), k, second)
            if by_shard:
                q, shard = np.nonzero(np.logical_or.reduceat(visited[:, of_ring], starts, axis=1))
                yield pa.RecordBatch.from_pydict({c: kept.column(c).take(pa.array(q)) for c in ("query_id", "vector", "least")} | {"shard": pa.array(shard)})
            else:
                q, r = np.nonzero(visited)
                yield pa.RecordBatch.from_pydict({"query_id": kept.column("query_id").take(pa.array(q)), "pivot": pa.array(rings.pivot[r].astype(np.int32)), "ring": pa.array(rings.ring[r].astype(np.int32))})


def _first(queries: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties by the smaller id."""
    order = np.lexsort((ids, -score, queries))
    q = queries[order]
    kept = order[np.arange(len(q)) - np.searchsorted(q, q) < k]
    return queries[kept], ids[kept], score[kept]


def _best(own: np.ndarray, least: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best points of each query that are not below its least score: number of the query, id and score."""
    score = own @ points.T
    kept = score >= least[:, None]
    if len(ids) > k and np.count_nonzero(kept) > k * len(own):  # the k-th best score, then ties at it
        kept &= score >= np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k, None]
    q, p = np.nonzero(kept)
    return _first(q, ids[p], score[q, p], k)


def _met(asked: pa.Table, points: pa.Table, rings: Rings, k: int, second: bool, block: int) -> pa.Table:
    """A shard's best points for queries that were sent to it."""
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
    if asked.num_rows and points.num_rows:
        own, least, names = unit(asked.column("vector").combine_chunks(), asked.num_rows)[0], asked.column("least").to_numpy(), asked.column("query_id").to_numpy()
        code = points.column("pivot").to_numpy().astype(np.int64) * (RINGS + 1) + points.column("ring").to_numpy()
        order = np.argsort(code, kind="stable")
        there, ids = unit(points.column("vector").combine_chunks(), points.num_rows)[0][order], points.column("id").to_numpy()[order]
        codes, starts = np.unique(code[order], return_index=True)
        chosen = np.searchsorted(rings.pivot * (RINGS + 1) + rings.ring, codes)
        ends = [*starts[1:].tolist(), len(ids)]
        for at in range(0, len(own), block):
            mine, low = own[at : at + block], least[at : at + block]
            visited, hits = rings.visited(mine, low, k, second, chosen), []
            for r, (start, end) in enumerate(zip(starts.tolist(), ends, strict=True)):
                q = np.flatnonzero(visited[:, r])
                step = max(1, SCORES // max(1, len(q)))
                for a in range(start, end if len(q) else start, step):
                    which, hit, score = _best(mine[q], low[q], there[a : min(a + step, end)], ids[a : min(a + step, end)], k)
                    hits.append((q[which], hit, score))
            if hits:
                which, hit, score = _first(*(np.concatenate(c) for c in zip(*hits, strict=True)), k)
                found.append((names[at + which], hit, score))
    return pa.table(dict(zip(("query_id", "post_id", "score"), (np.concatenate(c) for c in zip(*found, strict=True)), strict=True)))


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "post_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(hits, visits): the best points of each query, and the (query, ring) visits that were made (with pivot, ring, pass).

    The first pass finds a bound alone; the second one visits all rings within it, those of the first pass included."""
    spark, home, rings = index.spark, shared_folder(index.spark, "search"), index.table
    kind = queries.schema["vector"].dataType.simpleString()
    asked = queries.where("query_id is not null and vector is not null and size(vector) > 0").select("query_id", "vector")
    shares = max(1, -(-asked.count() // index.held))
    tasks = index.shards * shares
    dealt = index.points.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartition(tasks, "shard", "share")

    def visits(asked: DataFrame, number: int) -> DataFrame:
        return asked.mapInArrow(lambda it: _routed(it, rings, k, number == 2, False), "query_id long, pivot int, ring int").withColumn("pass", F.lit(number))

    def met(asked: DataFrame, second: bool) -> DataFrame:
        sent = asked.mapInArrow(lambda it: _routed(it, rings, k, second, True), f"query_id long, vector {kind}, least double, shard long")
        sent = sent.withColumn("share", F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int")).repartition(tasks, "shard", "share")
        pairs = sent.groupBy("shard", "share").cogroup(dealt.groupBy("shard", "share"))
        return pairs.applyInArrow(lambda q, p: _met(q, p, rings, k, second, block), HITS)

    asked = asked.withColumn("least", F.lit(NOTHING))
    _ranked(met(asked, False), k).drop("rank").write.parquet(f"{home}/near")
    worst = spark.read.parquet(f"{home}/near").groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score") - ROUNDING).alias("worst"))
    again = asked.join(worst, "query_id", "left").select("query_id", "vector", F.coalesce("worst", "least").alias("least"))
    return met(again, True), visits(asked, 1).union(visits(again, 2))


def cosine_topk(points: DataFrame, queries: DataFrame, k: int, channel_id: int | None = None, block: int = 1024, point_block: int = 8192) -> DataFrame:
    """query_id, post_id, score, rank of the k most similar points (post_id, vector, channel_id) of each query
    (query_id, vector). Zero vectors are never ranked. A channel filter is applied before points are grouped, so bounds
    are those of the channel's points."""
    chosen = points if channel_id is None else points.where(F.col("channel_id") == channel_id)
    index = Index(chosen.select(F.col("post_id").alias("id"), "vector"), point_block)
    if not index.rings:
        return points.sparkSession.createDataFrame([], f"{HITS}, rank int")
    return _ranked(search(index, queries, k, block)[0], k)


def tiles_visited(index: Index, visits: DataFrame, n_queries: int) -> float:
    """The share of all pairs of query and point that the visits compared."""
    sizes = index.spark.createDataFrame([(p, r, n) for p, r, n, _, _ in index.rings], "pivot int, ring int, n long")
    compared = visits.join(F.broadcast(sizes), ["pivot", "ring"]).agg(F.sum("n")).first()[0] or 0
    return compared / max(1, n_queries * sum(n for _, _, n, _, _ in index.rings))
