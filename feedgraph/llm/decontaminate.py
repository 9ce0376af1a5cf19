"""Benchmark decontamination over a distributed positional inverted index.

The index is a table of postings, (term, block, places): for every term of the training texts its sorted places in a
block of some megabytes of documents, with a gap between documents so that no match crosses them. A hot term has one
row for each block, so no group grows with it. It is written once and searched by joins; tasks make it and nothing of
it, nor of the test set, passes through the driver.

A search keys the test set's windows once, however many items share them. A window goes to the blocks that have its
term with the fewest postings; there its lists are intersected, offset-adjusted, from the rarest on: what is left are
exact phrase matches. With a tolerance instead of an offset the same lists give proximity matches: all terms near the
one that the test set has least often (of equals the first), in any order.

Defined results. Null text has no words. An item without words or without an id matches nothing. Items that share an
id count once. Repeated document rows get one result row each. Extra columns, whatever their names, are left out of
the results and kept with the clean documents; empty tables work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedgraph.llm import kernel
from feedgraph.llm.scratch import Scratch, text_digest, unused

WINDOW, SLOP, BLOCK_BYTES, STEP = 10, 15, 4 << 20, 1 << 18
INDEX = "block long, term binary, places binary, k1 array<long>, k2 array<long>, n_words array<long>"
MATCHES = "block long, doc long, win long, exact boolean, n_hit long"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Lower-cases A-Z and turns every other ASCII byte but letters and digits into a space.
FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)], dtype=np.uint8)
SPACE = np.arange(256) == 0x20


def postings(data: np.ndarray, offsets: np.ndarray, gap: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: its distinct terms, where each one's places begin, all places by term, where documents begin, and
    their numbers of words."""
    data = FOLD[data]
    n = len(offsets) - 1
    starts, ends, owner = kernel.word_spans(data, offsets, SPACE)
    hashes = kernel.span_hashes(data, starts, ends)
    order = np.argsort(hashes, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], hashes[order][1:] != hashes[order][:-1]))) if len(order) else order
    raw = data.tobytes()
    terms = [raw[a:b] for a, b in zip(starts[order[first]].tolist(), ends[order[first]].tolist(), strict=True)]
    n_words = np.bincount(owner, minlength=n)
    begins = np.cumsum(n_words) - n_words + gap * np.arange(n)
    return terms, np.append(first, len(order)), (order + gap * owner[order]).astype(np.int32), begins.astype(np.int32), n_words


def _index(batches: Iterator[pa.RecordBatch], gap: int) -> Iterator[pa.RecordBatch]:
    """A row for each term of a block, after one without term that lists its documents."""
    from pyspark import TaskContext

    schema = kernel.arrow_schema(INDEX)
    block = TaskContext.get().partitionId() << 40
    for batch in batches:
        for first, data, offsets in kernel.byte_chunks(batch.column("text"), BLOCK_BYTES):
            terms, bounds, places, begins, n_words = postings(data, offsets, gap)
            keys = {k: [batch.column(k).slice(first, len(n_words)).to_pylist()] for k in ("k1", "k2")}
            yield from kernel.batches(schema, [{"block": [block], "term": [None], "places": [begins.tobytes()], "n_words": [n_words]} | keys])
            lists = pa.Array.from_buffers(pa.binary(), len(terms), [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(places)])
            none = {k: pa.nulls(len(terms), schema.field(k).type) for k in ("k1", "k2", "n_words")}
            yield from kernel.batches(schema, [{"block": np.full(len(terms), block), "term": terms, "places": lists} | none])
            block += 1
    kernel.release()


@dataclass
class Block:
    """The postings of a block's test terms: keys are term and place in one number."""

    keys: np.ndarray
    first: dict[int, tuple[int, int]]
    length: int

    @staticmethod
    def of(terms: list[int], places: list[np.ndarray]) -> Block:
        length = 1 + max((int(p[-1]) for p in places), default=0)
        bounds = np.cumsum([0, *map(len, places)]).tolist()
        keys = np.concatenate([np.zeros(0, dtype=np.int64), *[t * length + p.astype(np.int64) for t, p in zip(range(len(terms)), places, strict=True)], [np.iinfo(np.int64).max]])
        return Block(keys, {t: (k, bounds[k]) for k, t in enumerate(terms)}, length)

    def within(self, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Has the term a place from low to high?"""
        low, high = np.maximum(low, 0), np.minimum(high, self.length - 1)
        return (low <= high) & (self.keys[np.searchsorted(self.keys, terms * self.length + low)] <= terms * self.length + high)

    def matches(self, windows: np.ndarray, anchors: np.ndarray, slop: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, place), by steps of bounded size: without slop of an exact match's first word, else of the anchor
        with all other terms near. windows: rows of test terms; anchors: the offset of the term to begin with."""
        known = np.array([[self.first.get(t, (-1, 0))[0] for t in w] for w in windows.tolist()], dtype=np.int64).reshape(windows.shape)
        starts = np.append(np.searchsorted(self.keys, np.arange(len(self.first)) * self.length), len(self.keys) - 1)
        counts = np.diff(starts)
        whole = np.flatnonzero((known >= 0).all(axis=1))
        cost = counts[known[whole, anchors[whole]]] if len(whole) else np.zeros(0, dtype=np.int64)
        cuts = np.searchsorted(np.cumsum(cost), np.arange(STEP, cost.sum() + STEP, STEP), side="right") if len(whole) else []
        for part in np.split(whole, np.unique(cuts)[:-1] if len(cuts) else []):
            if not len(part):
                continue
            rows, n = known[part], counts[known[part, anchors[part]]]
            order = np.argsort(counts[rows], axis=1, kind="stable")
            window = np.repeat(np.arange(len(part)), n)
            begin = starts[rows[np.arange(len(part)), anchors[part]]]
            at = self.keys[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())] - rows[window, anchors[part][window]] * self.length
            at = at - anchors[part][window] if slop is None else at
            for k in range(windows.shape[1]):
                offset = order[window, k]
                shift = at + offset if slop is None else at
                keep = self.within(rows[window, offset], shift, shift) if slop is None else self.within(rows[window, offset], at - slop, at + slop)
                window, at = window[keep], at[keep]
            yield part[window], at


def covered(begins: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each document the number of words inside [start, end) runs of places."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    own = np.maximum(reach - np.maximum(starts, np.concatenate(([0], reach[:-1]))), 0)
    return np.bincount(np.searchsorted(begins, starts, side="right") - 1, weights=own, minlength=len(begins)).astype(np.int64)


def search(terms: list[int], places: list[np.ndarray], begins: np.ndarray, windows: list[tuple[int, list[int], int, bool]], slop: int) -> dict[str, np.ndarray]:
    """Matches in a block of (win, terms, anchor, exact) windows: (doc, win, exact), once each, and n_hit by document."""
    block = Block.of(terms, places)
    rows = [np.zeros((0, 3), dtype=np.int64)]
    starts, ends = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for exact in (True, False):
        for n in {len(w[1]) for w in windows if w[3] == exact}:
            own = [w for w in windows if w[3] == exact and len(w[1]) == n]
            wins = np.array([w[0] for w in own], dtype=np.int64)
            for window, at in block.matches(np.array([w[1] for w in own], dtype=np.int64), np.array([w[2] for w in own], dtype=np.int64), None if exact else slop):
                doc = np.searchsorted(begins, at, side="right") - 1
                rows.append(np.unique(np.stack((doc, wins[window], np.full(len(at), exact)), axis=1), axis=0))
                if exact:
                    starts.append(at)
                    ends.append(at + n)
    found = np.unique(np.concatenate(rows), axis=0)
    return {"doc": found[:, 0], "win": found[:, 1], "exact": found[:, 2] > 0, "n_hit": covered(begins, np.concatenate(starts), np.concatenate(ends))}


def _search(listed: pa.Table, windows: pa.Table, slop: int) -> pa.Table:
    schema = kernel.arrow_schema(MATCHES)
    if not len(windows) or not len(listed):
        return schema.empty_table()
    terms, places = listed.column("id").to_pylist(), [np.frombuffer(p.as_buffer(), dtype=np.int32) for p in listed.column("places")]
    head = terms.index(None)
    begins = places.pop(head)
    terms.pop(head)
    todo = list(zip(*[windows.column(c).to_pylist() for c in ("win", "terms", "anchor", "exact")], strict=True))
    found = search(terms, places, begins.astype(np.int64), todo, slop)
    hit = np.flatnonzero(found["n_hit"])
    block, n = listed.column("block")[0].as_py(), len(found["doc"])
    columns = {
        "block": [block] * (n + len(hit)), "doc": np.concatenate((found["doc"], hit)), "win": pa.concat_arrays([pa.array(found["win"]), pa.nulls(len(hit), pa.int64())]),
        "exact": np.concatenate((found["exact"], np.ones(len(hit), dtype=bool))), "n_hit": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(found["n_hit"][hit])]),
    }
    return pa.Table.from_batches(kernel.batches(schema, [columns]), schema=schema)


def words(text: str) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))


def index(docs: DataFrame, scratch: Scratch, gap: int) -> DataFrame:
    """Write the postings of docs (text, and k1 and k2 that name a document)."""
    return scratch.keep(docs.select("text", "k1", "k2").mapInArrow(lambda it: _index(it, gap), INDEX), "postings")


def matched(postings: DataFrame, benchmark: DataFrame, scratch: Scratch, window: int, slop: int) -> tuple[DataFrame, DataFrame]:
    """(matches by block and document, and the items of each window)."""
    items = scratch.keep(benchmark.where("item_id is not null").select("item_id", words("text").alias("ws")).where("size(ws) > 0"), "items")
    n = F.least(F.lit(window), F.size("ws"))
    spans = items.select("item_id", "ws", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("ws") - n + 1)).alias("at")).select("item_id", F.slice("ws", F.col("at"), F.col("n")).alias("ws"))
    wins = scratch.keep(spans.select("ws").distinct().withColumn("win", F.monotonically_increasing_id()), "windows")
    members = scratch.keep(spans.join(wins, "ws").select("win", "item_id").distinct(), "members")
    uses = items.select(F.explode("ws").alias("word")).groupBy("word").agg(F.count("*").alias("uses"))
    terms = scratch.keep(uses.select("word", F.encode("word", "utf-8").alias("term"), "uses", F.monotonically_increasing_id().alias("id")), "terms")

    known = postings.where("term is not null").join(terms.select("term", "id"), "term").select("block", "id", "places")
    known = scratch.keep(known, "listed")
    counts = known.groupBy("id").agg(F.sum(F.length("places") / 4).cast("long").alias("n"))
    each = wins.select("win", F.posexplode("ws").alias("offset", "word")).join(terms.select("word", "id", "uses"), "word").join(counts, "id", "left")
    each = each.groupBy("win").agg(
        F.array_sort(F.collect_list(F.struct("offset", "id"))).alias("o"), F.bool_and(F.col("n").isNotNull()).alias("there"), F.min(F.struct("n", "offset")).alias("rarest"), F.min(F.struct("uses", "offset")).alias("least"),
    ).where("there")
    plans = F.array(*[F.struct(F.lit(e).alias("exact"), F.col(f"{c}.offset").alias("anchor")) for e, c in ((True, "rarest"), (False, "least"))])
    plans = each.select("win", F.col("o.id").alias("terms"), F.explode(plans).alias("p")).select("win", "terms", "p.*")
    plans = scratch.keep(plans.withColumn("id", F.element_at("terms", F.col("anchor") + 1)), "plans")
    wanted = plans.join(known.select(F.col("block").alias("at"), "id"), "id").select(F.col("at").alias("block"), "win", "terms", "anchor", "exact")
    heads = postings.where("term is null").select("block", F.lit(None).cast("long").alias("id"), "places")
    found = known.unionAll(heads).groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(lambda a, b: _search(a, b, slop), MATCHES)
    return scratch.keep(found, "matches"), members


def documents(postings: DataFrame) -> DataFrame:
    """block, doc (number in the block), k1, k2, n_words of every document."""
    zipped = F.arrays_zip("k1", "k2", "n_words")
    return postings.where("term is null").select("block", F.posexplode(zipped).alias("doc", "o")).select("block", F.col("doc").cast("long").alias("doc"), "o.*")


def contamination_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """doc_id, item_id, exact: every document and test item with an exact phrase match (or, if not exact, a proximity
    match), once each."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    rows = index(docs.select("text", F.col("doc_id").alias("k1"), F.lit(0).cast("long").alias("k2")), scratch, max(window, slop) + 1)
    found, members = matched(rows, benchmark, scratch, window, slop)
    named = found.where("win is not null").join(members, "win").join(documents(rows), ["block", "doc"])
    return named.select(F.col("k1").alias("doc_id"), "item_id", "exact").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """One row per document: its words, those inside exact matches, and its items with exact and proximity matches."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    rows = index(docs.select("text", F.col("doc_id").alias("k1"), F.lit(0).cast("long").alias("k2")), scratch, max(window, slop) + 1)
    found, members = matched(rows, benchmark, scratch, window, slop)
    named = found.where("win is not null").join(members, "win").select("block", "doc", "item_id", "exact").distinct()
    listed = named.groupBy("block", "doc").agg(F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item_id").cast("string")))).alias("items"), F.count(F.when(~F.col("exact"), True)).alias("n_near_items"))
    hits = found.where("win is null").select("block", "doc", "n_hit")
    every = documents(rows).join(hits, ["block", "doc"], "left").join(listed, ["block", "doc"], "left")
    items, n_hit = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0).cast("long"))
    return every.select(
        F.col("k1").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), F.coalesce("n_near_items", F.lit(0).cast("long")).alias("n_near_items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """The documents, with all their columns, that hold no window of any test item. Equal texts are judged once."""
    scratch, own = Scratch(docs.sparkSession, "decontaminate"), unused(docs.columns, "d1", "d2")
    d1, d2 = text_digest("text")
    rows = index(docs.select(F.col("text"), d1.alias("k1"), d2.alias("k2")), scratch, max(window, slop) + 1)
    found, _ = matched(rows, benchmark, scratch, window, slop)
    bad = found.where("n_hit > 0").join(documents(rows), ["block", "doc"]).select(F.col("k1").alias(own["d1"]), F.col("k2").alias(own["d2"])).distinct()
    bad = scratch.keep(bad, "bad")
    return docs.withColumns({own["d1"]: d1, own["d2"]: d2}).join(bad, list(own.values()), "left_anti").select(*docs.columns)
