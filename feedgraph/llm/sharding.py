"""Sharding by minimax contiguous partition: shards of near equal bytes that never part equal texts.

Equal texts are an atomic group; groups are ordered by a digest of their text. The smallest feasible capacity is found
by binary search: a capacity is checked greedily, each shard taking the longest run of groups that fits, and the cuts
are made at the smallest one that needs no more shards than there are.

A check only asks for the largest prefix sum up to some value. The driver keeps a grid over the byte axis with the
smallest and largest prefix sum in each cell, which settles most questions and brackets the others; then only the
stretches where cuts may fall are read again on a finer grid. The grid has a fixed number of cells, so the driver never
holds the groups, however many there are. A group larger than an equal share gets a shard of its own (there are fewer
of them than shards).

Defined results. Null text is empty: 16 bytes, and equal to other empty texts. Repeated rows are rows of their own in
one group. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedgraph.llm.scratch import Scratch

SHARDS, HEAD_BYTES, CELLS = 40, 16, 20_000


class PrefixGrid:
    """Answers 'largest prefix sum up to x' from cells; low and high bracket it where a cell does not settle it."""

    def __init__(self, firsts: np.ndarray, lasts: np.ndarray) -> None:
        self.firsts, self.lasts = firsts, lasts

    def find(self, x: int, high: bool) -> int:
        k = int(np.searchsorted(self.firsts, x, side="right")) - 1
        if k < 0:
            return 0
        if self.lasts[k] <= x:
            return int(self.lasts[k])
        return x if high else int(self.firsts[k])

    def cuts(self, capacity: int, shards: int, high: bool) -> list[int]:
        out = [0]
        for _ in range(shards):
            out.append(self.find(out[-1] + capacity, high))
        return out

    def smallest(self, total: int, shards: int, high: bool, low: int, top: int) -> int:
        """The smallest capacity above low, at most top, that is enough. Between them the grid must be complete."""
        while top - low > 1:
            middle = (low + top) // 2
            if self.cuts(middle, shards, high)[-1] >= total:
                top = middle
            else:
                low = middle
        return top


def _cells(groups: DataFrame, windows: list[tuple[int, int]], cells: int) -> PrefixGrid:
    """The grid over the windows of the byte axis; whole-axis edges outside are single known sums."""
    step = max(1, sum(b - a + 1 for a, b in windows) // cells)
    inside = F.lit(False)
    for a, b in windows:
        inside = inside | F.col("upto").between(a, b)
    rows = groups.where(inside).groupBy(F.floor(F.col("upto") / step).alias("cell")).agg(F.min("upto").alias("first"), F.max("upto").alias("last")).collect()
    rows = sorted((r["first"], r["last"]) for r in rows)
    return PrefixGrid(np.array([a for a, _ in rows], dtype=np.int64), np.array([b for _, b in rows], dtype=np.int64))


def minimax_cuts(groups: DataFrame, total: int, shards: int, cells: int = CELLS) -> list[int]:
    """Prefix sums at which the shards end, of a frame of prefix sums (upto)."""
    if not total:
        return [0] * shards
    cells = max(cells, 4 * shards * shards)  # brackets add up from cut to cut; so many cells make them shrink
    windows, below, enough = [(1, total)], -(-total // shards) - 1, total
    while True:
        grid = _cells(groups, windows, cells)
        least, enough = (grid.smallest(total, shards, high, below, enough) for high in (True, False))
        below = least - 1
        low, high = grid.cuts(least, shards, False), grid.cuts(enough, shards, True)
        if least == enough and low == high:
            return low[1:]
        # Prefix sums below a bracket's low end matter only as its lower neighbour, which low itself is.
        windows = _merged([(a, b) for a, b in zip(low, high, strict=True) if b])


def _merged(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(windows):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def numbered(frame: DataFrame, order: list[str], sums: dict[str, str], scratch: Scratch, name: str) -> DataFrame:
    """The frame range-sorted by order, with running sums (inclusive) of the given expressions over the whole of it.

    Sorted ranges are written once and numbered by file order, so a retried task sees the same rows; one row of totals
    for each range is all that is summed up centrally."""
    kept = scratch.keep(frame.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), name)
    totals = kept.groupBy("range").agg(*[F.sum(F.expr(e)).alias(f"all_{c}") for c, e in sums.items()])
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("range", *[F.coalesce(F.sum(f"all_{c}").over(before), F.lit(0)).alias(f"all_{c}") for c in sums])
    own = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return kept.join(totals, "range").select(*frame.columns, *[(F.sum(F.expr(e)).over(own) + F.col(f"all_{c}")).alias(c) for c, e in sums.items()])


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document with its shard and its place there."""
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = scratch.keep(docs.select("doc_id", (F.length(text).cast("long") + HEAD_BYTES).alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("digest")), "rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    alone: list[str] = []
    for row in groups.orderBy(F.desc("bytes"), "digest").limit(shards - 1).collect():
        if row["bytes"] * (shards - len(alone)) <= total:
            break
        alone.append(row["digest"])
        total -= row["bytes"]
    ordered = numbered(groups.where(~F.col("digest").isin(alone)) if alone else groups, ["digest"], {"upto": "bytes"}, scratch, "groups")
    ordered = scratch.keep(ordered, "prefix_sums")
    ends = minimax_cuts(ordered, total, shards - len(alone))
    last = {r["upto"]: r["digest"] for r in ordered.where(F.col("upto").isin(sorted(set(ends)))).collect()}  # at most a row for each shard

    shard = F.lit(0)
    for end in sorted(set(ends) - {0, total}):
        shard = shard + (F.col("digest") > last[end]).cast("int")
    for k, digest in enumerate(alone):
        shard = F.when(F.col("digest") == digest, shards - 1 - k).otherwise(shard)
    placed = rows.withColumn("shard", shard.cast("int"))
    ranked = numbered(placed, ["shard", "digest", "doc_id"], {"place": "1"}, scratch, "ranked")
    sizes = placed.groupBy("shard").count()
    before = sizes.select("shard", (F.sum("count").over(Window.orderBy("shard")) - F.col("count")).alias("before"))
    return ranked.join(F.broadcast(before), "shard").select(  # one row for each shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - 1 - F.col("before")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
