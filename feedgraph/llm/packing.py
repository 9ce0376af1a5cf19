"""Best-fit packing of tokenised documents by bin completion.

Documents become token ids plus an end id; only a piece longer than a sequence is cut. Pieces of equal length are
interchangeable, so what has to be packed is a histogram with one count for each length: it is bounded by the sequence
length however many documents there are, and it alone reaches the driver. The plan names, for each length, runs of
equally filled sequences. Tasks then number the pieces of a length and look their places up.

Planning: best-fit decreasing gives the incumbent. Where it misses the lower bound, a branch and bound goes on: it takes
the largest open length, enumerates undominated fillings of the room beside it, prunes by the waste that the bound
leaves, and keeps the better plan. Its nodes and the steps of an enumeration are limited, whatever the number of lengths;
the incumbent is a whole plan at any time.

Defined results. Null text is empty and is one piece of one (end) id. Repeated rows are packed each on its own. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedgraph.llm import kernel
from feedgraph.llm.scratch import Scratch

CAPACITY, END_ID = 4096, 1
CACHE_BYTES = 48 << 20
FILLING_STEPS = 500
PIECES = "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, row long"


#: 1 for ASCII letters and digits, 2 for ASCII punctuation but the apostrophe: the tokenizer always splits where they meet.
KIND = np.zeros(256, dtype=np.uint8)
KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
KIND[[b for b in range(0x21, 0x7F) if not KIND[b] and b != 0x27]] = 2


class Encoder:
    """Token ids as little-endian bytes. The tokenizer splits at white space and wherever letters meet punctuation, so
    a text's ids are those of such parts one after another; parts are looked up in a bounded cache. Lower-casing is the
    tokenizer's own rule; texts with a special token's opening go to it as they are, by words."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[bytes, bytes] = {}
        self.held = 0  # bytes of the cache, with a dictionary's cost for each entry
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def learn(self, parts: set[bytes]) -> None:
        """Put new parts into the cache."""
        if self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
        self.held += sum(map(len, parts)) + 200 * len(parts)
        fresh = [p.decode() for p in parts]
        # A run of letters is one pretoken, whose last id alone carries the word end: many go through in one text.
        plain = [p for p in fresh if p.isalpha()]
        rest = [p for p in fresh if not p.isalpha()]
        for at in range(0, len(plain), 100):
            some = plain[at : at + 100]
            ids = np.array(self._ids([" ".join(some)])[0], dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):
                rest += some
                continue
            for p, start, end in zip(some, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
                self.cache[p.encode()] = ids[start:end].tobytes()
        for p, own in zip(rest, self._ids(rest), strict=True):
            self.cache[p.encode()] = np.array(own, dtype="<u4").tobytes()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_chunk(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        kinds = KIND[data]
        seams = np.flatnonzero(kinds[1:] + kinds[:-1] == 3) + 1
        spaced = np.insert(kernel.LOWER[data], seams, 0x20).tobytes()
        at = offsets + np.searchsorted(seams, offsets, side="right")
        raw = data.tobytes()
        parts = []
        for k in range(len(offsets) - 1):
            own = raw[offsets[k] : offsets[k + 1]]
            parts.append((own if b"<|" in own else spaced[at[k] : at[k + 1]]).split())
        while new := set(chain.from_iterable(parts)).difference(self.cache):  # twice where the cache was cleared
            self.learn(new)
        return [b"".join(map(self.cache.__getitem__, p)) for p in parts]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    encoder, schema = Encoder(path), kernel.arrow_schema(PIECES)
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        for first, data, offsets in kernel.byte_chunks(batch.column("text")):
            n = len(offsets) - 1
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc_id, ids in zip(batch.column("doc_id").slice(first, n).to_pylist(), encoder.encode_chunk(data, offsets), strict=True):
                ids += END_ID.to_bytes(4, "little")
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for name, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, part, zlib.crc32(part), row), strict=True):
                        out[name].append(value)
                row += 1
            yield from kernel.batches(schema, [out])
    encoder.cache.clear()
    kernel.release()


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: by volume, and with lengths over a half that nothing of k or more fits beside."""
    padded = np.zeros(max(len(counts), capacity + 1) + 1, dtype=np.int64)
    padded[: len(counts)] = counts
    n_from = np.cumsum(padded[::-1])[::-1]
    sum_from = np.cumsum((padded * np.arange(len(padded)))[::-1])[::-1]
    k, half = np.arange(1, capacity // 2 + 1), capacity // 2 + 1
    full = n_from[capacity - k + 1]
    large = n_from[half] - full
    large_sum = sum_from[half] - sum_from[capacity - k + 1]
    needed = full + large + np.maximum(0, -(-(sum_from[k] - sum_from[half] - (large * capacity - large_sum)) // capacity))
    return max(-(-int(sum_from[0]) // capacity), int(needed.max(initial=0)))


Plan = list[tuple[tuple[int, ...], int]]


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> Plan:
    """Fill the room beside each largest length with the largest lengths that fit, many equal sequences at a time."""
    left, plan = counts.copy(), []
    for largest in range(len(left) - 1, 0, -1):
        while left[largest]:
            filling, need, room = [], {}, capacity
            size = largest
            while size:
                n = int(min(room // size, left[size] - need.get(size, 0)))
                if n:
                    filling += [size] * n
                    need[size] = need.get(size, 0) + n
                    room -= n * size
                open_sizes = np.flatnonzero(left[: min(room, size - 1) + 1])
                size = int(open_sizes[-1]) if len(open_sizes) and room else 0
            times = min(int(left[s]) // n for s, n in need.items())
            for s, n in need.items():
                left[s] -= n * times
            plan.append((tuple(filling), times))
    return plan


def fillings(left: np.ndarray, room: int, waste: int, steps: int = FILLING_STEPS) -> list[tuple[int, ...]]:
    """Undominated fillings of a room that waste at most so much, the fullest first, as far as so many steps lead. A
    filling is dominated where one longer open length could take the place of an item, or of nothing."""
    sizes = np.flatnonzero(left[: room + 1])[::-1]
    volume = np.append(np.cumsum((left[sizes] * sizes)[::-1])[::-1], 0).tolist()
    upward, sizes = sizes[::-1].tolist(), sizes.tolist()
    out: list[tuple[int, tuple[int, ...]]] = []
    stack: list[tuple[int, int, tuple[tuple[int, int], ...], int]] = [(0, room, (), -1)]
    while stack and steps:
        steps -= 1
        at, free, chosen, n = stack.pop()
        if n < 0:  # the next length that fits
            at = max(at, len(sizes) - bisect.bisect_right(upward, free))
            if free - volume[at] > waste:
                continue
            if at == len(sizes):
                used = dict(chosen)
                longer = (s for c in (0, *used) for s in upward[bisect.bisect_right(upward, c) : bisect.bisect_right(upward, c + free)])
                if not any(left[s] > used.get(s, 0) for s in longer):
                    out.append((free, tuple(s for s, k in chosen for _ in range(k))))
                continue
            n = int(min(left[sizes[at]], free // sizes[at]))
        if n:
            stack.append((at, free, chosen, n - 1))
        stack.append((at + 1, free - n * sizes[at], (*chosen, (sizes[at], n)) if n else chosen, -1))
    return [chosen for _, chosen in sorted(out, key=lambda x: (x[0], len(x[1])))]


def plan_size(plan: Plan) -> int:
    return sum(n for _, n in plan)


def complete(counts: np.ndarray, capacity: int, plan: Plan, nodes: int) -> Plan:
    """Branch and bound from a whole plan, for as many nodes beyond one for each length (enough to reach a first leaf).
    A node fills one sequence, or as many alike as there can be; what is put off waits in an explicit stack."""
    bound, best = lower_bound(counts, capacity), plan_size(plan)
    volume = int((counts * np.arange(len(counts))).sum())
    nodes += len(np.flatnonzero(counts))

    def options(left: np.ndarray, wasted: int) -> Iterator[tuple[tuple[int, ...], int]]:
        largest = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[largest] -= 1
        for chosen in fillings(rest, capacity - largest, (best - 1) * capacity - volume - wasted):
            filling = (largest, *chosen)
            times = min(int(left[s]) // filling.count(s) for s in set(filling))
            yield filling, times
            if times > 1:
                yield filling, 1

    # left, the way here, sequences used, room wasted, what is still to be tried
    stack: list[tuple] = [(counts, None, 0, 0, options(counts, 0))] if counts.any() else []
    while stack and best > bound and nodes > 0:
        left, way, used, wasted, tries = stack[-1]
        filling, times = next(tries, (None, 0))
        if filling is None:
            stack.pop()
            continue
        nodes -= 1
        rest = left.copy()
        for s in set(filling):
            rest[s] -= filling.count(s) * times
        way, used, wasted = (way, filling, times), used + times, wasted + times * (capacity - sum(filling))
        if used + lower_bound(rest, capacity) >= best or wasted > (best - 1) * capacity - volume:
            continue
        if rest.any():
            stack.append((rest, way, used, wasted, options(rest, wasted)))
            continue
        plan, best = [], used
        while way:
            way, filling, times = way
            plan.append((filling, times))
        plan.reverse()
    return plan


def bin_completion(counts: np.ndarray, capacity: int, nodes: int = 4000) -> Plan:
    """The best plan found: the incumbent where it meets the bound, else completed by branch and bound, and then its
    wasteful tail again and again beside the sequences that waste nothing, until a pass gains nothing. Each search has so
    many nodes; how many lengths there are switches nothing off."""
    bound, plan = lower_bound(counts, capacity), best_fit_decreasing(counts, capacity)
    if plan_size(plan) > bound:
        plan = complete(counts, capacity, plan, nodes)
    while plan_size(plan) > bound:
        full = [x for x in plan if sum(x[0]) == capacity]
        tail = [x for x in plan if sum(x[0]) < capacity]
        own = np.zeros_like(counts)
        for filling, times in tail:
            for size in filling:
                own[size] += times
        again = min(complete(own, capacity, tail, nodes), best_fit_decreasing(own, capacity), key=plan_size)
        if plan_size(again) >= plan_size(tail):
            break
        plan = full + again
    return plan


def places(plan: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first sequence, items of that length in each, offset of the first)."""
    out, taken, sequence = [], {}, 0
    for filling, times in plan:
        offset = 0
        for size in dict.fromkeys(filling):
            n = filling.count(size)
            first = taken.get(size, 0)
            taken[size] = first + n * times
            out.append((size, first, taken[size], sequence, n, offset))
            offset += n * size
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """One row per piece with its ids (little-endian, four bytes each; or without), their checksum, its sequence and its
    offset. tokenizer: path of a tokenizer file that all executors have. Places are found without the ids, which meet them
    once at the end."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.keep(docs.select("doc_id", "text").mapInArrow(lambda it: _pieces(it, tokenizer, capacity), PIECES), "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most one row for each length
        counts[row["length"]] = row["count"]
    placed = place(pieces.drop("ids"), places(bin_completion(counts, capacity)), scratch)
    whole = placed.join(pieces.select("row", "piece", "ids"), ["row", "piece"]) if ids else placed
    return whole.select("doc_id", "piece", "start", "length", *(["ids"] if ids else []), "ids_crc32", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids (little-endian) and spans (doc_id, piece, offset, length) of the packed sequences: what a
    training job reads. A sequence is bounded by the capacity."""
    piece = F.struct("offset", "doc_id", "piece", "length", "ids")
    whole = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("o"), F.sum("length").alias("length"))
    ids = F.aggregate("o", F.lit(b""), lambda so_far, o: F.concat(so_far, o["ids"]))
    return whole.select("sequence_id", "length", ids.alias("ids"), F.transform("o", lambda o: F.struct(o["doc_id"], o["piece"], o["offset"], o["length"])).alias("spans"))


def place(pieces: DataFrame, plan: list[tuple[int, int, int, int, int, int]], scratch: Scratch) -> DataFrame:
    """Ranks are dealt in two steps, so that a common length is never in one task: groups of a length's pieces are
    ranked by their counts, then the pieces in their group."""
    spark = pieces.sparkSession
    grouped = pieces.withColumn("deal", F.pmod(F.xxhash64("row", "piece"), F.lit(4096)))
    before = grouped.groupBy("length", "deal").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("deal")) - F.col("count")).drop("count")
    ranked = (
        grouped.join(before, ["length", "deal"])
        .withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "deal").orderBy("doc_id", "row", "piece")) - 1)
    )
    # A run of ranks is found by the last one that starts at or before the rank: a sorted merge, no range join.
    starts = spark.createDataFrame(plan or [(0, 0, 0, 0, 1, 0)], "length long, first long, last long, sequence long, n long, at long")
    runs = starts.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "sequence", "n", "at"))).alias("runs"))
    run = F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("rank")), -1)
    nth = F.col("rank") - F.col("run.first")
    return (
        ranked.join(runs, "length").withColumn("run", run)
        .select(
            "row", "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("run.sequence") + F.floor(nth / F.col("run.n")).cast("long")).alias("sequence_id"),
            (F.col("run.at") + F.pmod(nth, F.col("run.n")) * F.col("length")).cast("long").alias("offset"),
        )
    )
