"""N-gram Jaccard join by PartEnum signatures, and the groups that its links form.

Two sets of sizes r and s with Jaccard similarity of at least 0.8 differ in at most (r + s) / 9 elements. Within a size
band the feature domain is partitioned by hash on two levels: into half as many first-level parts as the largest such
difference, and each of them into three second-level parts. Similar sets have a first-level part where they differ in
at most one element, so two of its second-level parts agree wholly: every pair of second-level parts is enumerated,
and its signature is a hash of all that a set has in both. A set of its own size needs fewer signatures to be sure of a
shared one: it keeps the fullest ones only, by a level that depends on the signature alone, so of two similar sets the
one with the higher level always finds a shared signature.

Equal sets are one from there on: signature rows name sets by a hash, so copies meet as one row, and the names are
resolved to documents before anything is decided. Rows are sorted by Spark and read as a stream, so a bucket of any
size needs no memory. Pairs are compared by odd sketches: parity bits whose Hamming distance never exceeds the true
difference, so a rejected pair surely is no link. What passes is verified on the whole texts.

A family of thousands of near copies must not yield all its pairs. In a first round every document is tied to two at
most of those that come first in its buckets; the verified links are united. A second round takes all pairs of small
buckets, and all ties to first members of large ones, that are still apart. A third one takes a spanning forest of
passing pairs of each large bucket that still holds several groups, and the last one every passing pair across the
groups of such a bucket, by pairs of blocks, so no link between different groups is lost.

Defined results. Null and wordless texts have an empty set and link with nothing. Rows without doc_id link with
nothing; rows that share a doc_id are one document for links. Repeated rows get one result row each. Extra columns,
whatever their names, are left out of the results and kept with the remaining documents; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedgraph.llm import kernel
from feedgraph.llm.components import components
from feedgraph.llm.scratch import Scratch, text_digest, unused

WORDS, BLOCK, SMALL = 5, 1024, 24
SECOND = 3  # second-level parts in a first-level one
FEATURES = "doc_id long, n long, d1 long, d2 long, band int, main boolean, sketch binary"
SIGNED = "signature long, id long, n int, band int"
COUNTERS, FAN_IN = 1 << 18, 16
COUNTED = "slot long, counters binary"
BUCKETS = "signature long, a long, b long, band int, block long, star boolean"


def most_different(n: np.ndarray | int) -> np.ndarray | int:
    """The largest difference that a set of n elements can have to a similar one."""
    return (n + (5 * n) // 4) // 9


def bands(n: int) -> list[int]:
    """Bands (named by their least size, powers of 4) in which a set of n may be, or meet, the smaller of a pair."""
    least, out, band = -(-4 * n // 5), [], 1
    while band <= n:
        if 4 * band > least:
            out.append(band)
        band *= 4
    return out


def signatures(elements: np.ndarray, band: int) -> np.ndarray:
    """The fullest signatures of a sorted set, enough to share one with every similar set of the band.

    Of each first-level part the sums of its elements without those of one second-level part. A differing element
    spoils two of a part's three signatures, a second one there the third."""
    most = int(most_different(5 * band - 1))
    first = most // 2 + 1
    part = (((elements >> np.uint64(32)) * np.uint64(SECOND * first)) >> np.uint64(32)).astype(np.int64)
    counts = np.bincount(part, minlength=SECOND * first)
    ends = np.cumsum(counts)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(kernel.mix(elements))))
    own = (sums[ends] - sums[ends - counts]).reshape(first, SECOND)
    values = own.sum(axis=1, dtype=np.uint64, keepdims=True) - own
    held = (counts.reshape(first, SECOND).sum(axis=1, keepdims=True) - counts.reshape(first, SECOND)).ravel()
    values = kernel.mix(values.ravel() + np.arange(SECOND * first, dtype=np.uint64) * np.uint64(kernel.BASE) + np.uint64(band))
    level = np.minimum(held, 31) * 64 + (values >> np.uint64(58)).astype(np.int64)
    different = int(most_different(len(elements)))
    spoilt = min(different, first) + different  # at most, of two in each part, then of the third
    kept = np.cumsum(np.bincount(level, minlength=2048)[::-1])
    chosen = values[level >= 2047 - np.searchsorted(kept, min(spoilt + 1, SECOND * first))]
    return chosen >> np.uint64(16)  # collisions only add candidates, and shorter rows are shuffled


def odd_sketch(elements: np.ndarray, band: int) -> np.ndarray:
    """Parity bits of the set's elements over cells, 4 for each element of the band's least size and 512 at least."""
    cells = max(512, 4 * band)
    at = ((kernel.mix(elements) >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=cells) & 1).astype(np.uint8))


def _features(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    schema = kernel.arrow_schema(FEATURES)
    for batch in batches:
        for first, data, offsets in kernel.byte_chunks(batch.column("text")):
            ids = batch.column("doc_id").slice(first, len(offsets) - 1).to_pylist()
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc_id, elements in zip(ids, kernel.shingle_sets(data, offsets, words), strict=True):
                n = len(elements)
                d1, d2 = set_names(elements)
                for k, band in enumerate(bands(n) or [0]):
                    sketch = odd_sketch(elements, band).tobytes() if band else b""
                    for name, value in zip(out, (doc_id, n, d1, d2, band, k == 0, sketch), strict=True):
                        out[name].append(value)
            yield from kernel.batches(schema, [out])
    kernel.release()


def set_names(elements: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set."""
    mixed = kernel.mix(elements + np.uint64(1))
    return tuple(int(np.sum(m, dtype=np.uint64).view(np.int64)) if len(m) else 0 for m in (mixed, kernel.mix(mixed + np.uint64(2))))


def _sign(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    schema = kernel.arrow_schema(SIGNED)
    for batch in batches:
        for _, data, offsets in kernel.byte_chunks(batch.column("text")):
            found = [(set_names(e)[0], len(e), band, signatures(e, band)) for e in kernel.shingle_sets(data, offsets, words) for band in bands(len(e))]
            if found:
                lengths = [len(f[3]) for f in found]
                name, n, band = (np.repeat(np.array([f[c] for f in found], dtype=np.int64), lengths) for c in range(3))
                yield from kernel.batches(schema, [{"signature": np.concatenate([f[3] for f in found]).view(np.int64), "id": name, "n": n.astype(np.int32), "band": band.astype(np.int32)}])
    kernel.release()


def fits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 5 * np.minimum(x, y) >= 4 * np.maximum(x, y)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by signature, size and set -> pairs (a, b) of sets: those of each bucket's first with the others
    (star), and of small buckets the rest; and the rows of large ones (a) with their block.

    Only the open bucket is held, and no more than SMALL rows of it: a longer one passes through row by row."""
    schema = kernel.arrow_schema(BUCKETS)
    names = ("signature", "id", "n", "band")
    held, passed, pivot = [np.zeros(0, dtype=np.int64)] * 4, 0, (0, 0)
    before = None  # the last row's signature and set

    def paired(a: np.ndarray, b: np.ndarray, band: np.ndarray, star: np.ndarray) -> dict[str, np.ndarray]:
        both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b), band, star), axis=1), axis=0)
        none = pa.nulls(len(both), pa.int64())
        return {"signature": none, "a": both[:, 0], "b": both[:, 1], "band": both[:, 2], "block": none, "star": both[:, 3] > 0}

    def pairs(columns: list[np.ndarray], bucket: np.ndarray, number: np.ndarray, small: np.ndarray) -> dict[str, np.ndarray]:
        _, sets, n, band = columns
        first, second = [], []
        for step in range(1, SMALL):
            i = np.flatnonzero(small[:-step] & (bucket[:-step] == bucket[step:])) if len(sets) > step else []
            if not len(i):
                break
            i = i[fits(n[i], n[i + step])]
            first.append(i)
            second.append(i + step)
        i, j = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (first, second))
        return paired(sets[i], sets[j], band[i], number[i] == 0)

    def large(columns: list[np.ndarray], rows: np.ndarray, number: np.ndarray) -> dict[str, object]:
        nothing = pa.nulls(len(rows), pa.int64())
        return {"signature": columns[0][rows], "a": columns[1][rows], "b": nothing, "band": columns[3][rows], "block": number // BLOCK, "star": pa.nulls(len(rows), pa.bool_())}

    def close(columns: list[np.ndarray], passed: int, pivot: tuple[int, int], last: bool) -> tuple[list[dict[str, object]], list[np.ndarray], int, tuple[int, int]]:
        """What can go on, the rows still held, how many rows of the open bucket have passed, and its first one."""
        signature, sets, n, band = columns
        starts = np.concatenate(([0], np.flatnonzero(signature[1:] != signature[:-1]) + 1)).astype(np.int64)
        counts = np.diff(np.concatenate((starts, [len(signature)])))
        bucket = np.repeat(np.arange(len(starts)), counts)
        number = np.arange(len(signature)) - starts[bucket]
        number[bucket == 0] += passed
        total = counts + np.where(np.arange(len(starts)) == 0, passed, 0)
        is_large = (total > SMALL)[bucket]
        open_ = (bucket == len(starts) - 1) & ~is_large if not last else np.zeros(len(signature), dtype=bool)
        firsts, sizes = sets[starts], n[starts]
        if passed:
            firsts[0], sizes[0] = pivot
        tied = np.flatnonzero(is_large & (number > 0))
        tied = tied[fits(sizes[bucket[tied]], n[tied])]
        out = [
            pairs(columns, bucket, number, ~is_large & ~open_), large(columns, np.flatnonzero(is_large), number[is_large]),
            paired(firsts[bucket[tied]], sets[tied], band[tied], np.ones(len(tied), dtype=np.int64)),
        ]
        after = int(total[-1]) if total[-1] > SMALL and not last else 0
        return out, [c[open_] for c in columns], after, (int(firsts[-1]), int(sizes[-1]))

    for batch in batches:
        new = [batch.column(c).to_numpy().astype(np.int64) for c in names]
        if not len(new[0]):
            continue
        fresh = np.concatenate(([before != (new[0][0], new[1][0])], (new[0][1:] != new[0][:-1]) | (new[1][1:] != new[1][:-1])))
        if passed and new[0][0] != before[0]:
            passed = 0
        before = int(new[0][-1]), int(new[1][-1])
        columns = [np.concatenate((x, y[fresh])) for x, y in zip(held, new, strict=True)]
        if len(columns[0]):
            out, held, passed, pivot = close(columns, passed, pivot, False)
            yield from kernel.batches(schema, out)
    if len(held[0]):
        yield from kernel.batches(schema, close(held, 0, pivot, True)[0])
    kernel.release()


class Forest:
    """Groups that pairs unite."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.parent.setdefault(x, x)) != x:
            self.parent[x] = self.parent[up]
            x = up
        return x

    def unite(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def rarest(elements: np.ndarray, counters: np.ndarray) -> bytes:
    """The prefix of a set in the order from rare to frequent elements that every similar set must meet, as 32-bit hashes
    in that order. Any one order of all elements is right; equal hashes of different elements only add candidates."""
    n = len(elements)
    order = np.lexsort((elements, counters[(elements % np.uint64(len(counters))).astype(np.int64)]))
    return (elements[order[: n - least_common(n, -(-4 * n // 5)) + 1]] >> np.uint64(32)).astype(np.uint32).tobytes()


def least_common(x: np.ndarray | int, y: np.ndarray | int) -> np.ndarray | int:
    """What sets of two sizes have in common at least, if they are similar."""
    return -(-4 * (x + y) // 9)


def bucket_pairs(docs: np.ndarray, groups: np.ndarray, blocks: np.ndarray | None, sizes: np.ndarray, sketches: np.ndarray, prefixes: list[np.ndarray], forest: bool) -> Iterator[tuple[int, int]]:
    """Pairs of a bucket across groups that sizes, prefixes and sketches allow: a spanning forest of the groups, or all.

    Documents meet by the elements of their prefixes. If two are similar, the first element of the common order that both
    have leaves room behind it, in both, for all that they must have in common. Documents of one body with endings of their
    own meet nobody, as their rare elements fill their prefixes."""
    by_size = np.argsort(sizes, kind="stable")
    docs, groups, sizes, sketches = docs[by_size], groups[by_size], sizes[by_size], sketches[by_size]
    prefixes = [prefixes[k] for k in by_size.tolist()]
    blocks = blocks[by_size] if blocks is not None else None
    lengths = np.array([len(p) for p in prefixes], dtype=np.int64)
    flat, row = np.concatenate(prefixes), np.repeat(np.arange(len(docs)), lengths)
    left = sizes[row] - (np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths))  # elements from here on

    # Only what documents of several groups have in their prefixes matters; most have nothing of that kind.
    order = np.argsort(flat, kind="stable")
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(flat)), dtype=bool), flat[order][1:] != flat[order][:-1])))
    if not len(starts):
        return
    own = groups[row[order]]
    several = np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts)
    shared = np.zeros(len(flat), dtype=bool)
    shared[order] = np.repeat(several, np.diff(np.append(starts, len(flat))))
    flat, row, left = flat[shared], row[shared], left[shared]
    at = np.searchsorted(row, np.arange(len(docs) + 1))
    alive = np.flatnonzero(np.diff(at))
    upto = np.searchsorted(sizes, (5 * sizes) // 4, side="right")
    trees = Forest()
    for i in alive.tolist():
        j = alive[np.searchsorted(alive, i) + 1 : np.searchsorted(alive, upto[i])]
        j = j[groups[j] != groups[i]]
        if blocks is not None:
            j = j[blocks[j] != blocks[i]]
        if len(j):
            apart = np.bitwise_count(sketches[j] ^ sketches[i]).sum(axis=1, dtype=np.int64)
            j = j[9 * apart <= sizes[j] + sizes[i]]
        if len(j):
            mine = np.argsort(flat[at[i] : at[i + 1]], kind="stable") + at[i]
            n = at[j + 1] - at[j]
            theirs = np.repeat(at[j] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            place = np.minimum(np.searchsorted(flat[mine], flat[theirs]), len(mine) - 1)
            meets = (flat[mine[place]] == flat[theirs]) & (np.minimum(left[mine[place]], left[theirs]) >= least_common(sizes[i], sizes[row[theirs]]))
            for k in np.unique(row[theirs[meets]]).tolist():
                if not forest or trees.unite(int(groups[i]), int(groups[k])):
                    yield min(docs[i], docs[k]), max(docs[i], docs[k])


def _propose(batches: Iterator[pa.RecordBatch], forest: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket (signature and blocks) -> pairs, each once for a task."""
    schema = kernel.arrow_schema("a long, b long")
    held: list[pa.RecordBatch] = []
    seen: set[tuple[int, int]] = set()

    def close(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = np.stack([table.column(c).to_numpy() for c in ("signature", "low", "high")], axis=1)
        cuts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]))
        docs, groups, sizes, block = (table.column(c).to_numpy() for c in ("doc_id", "group", "n", "block"))
        sketches, rare = (table.column(c).combine_chunks() for c in ("sketch", "rare"))
        pairs = []
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if end - start > 1 and (groups[start:end] != groups[start]).any():
                bits = np.stack([np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in sketches.slice(start, end - start)])
                across = block[start:end] if keys[start, 1] != keys[start, 2] else None
                prefixes = [np.frombuffer(r.as_buffer(), dtype=np.uint32) for r in rare.slice(start, end - start)]
                pairs += [p for p in bucket_pairs(docs[start:end], groups[start:end], across, sizes[start:end], bits, prefixes, forest) if p not in seen]
                seen.update(pairs[-BLOCK:])
                if len(seen) > 200_000:
                    seen.clear()
        pairs = list(dict.fromkeys(pairs))
        if pairs:
            yield from kernel.batches(schema, [{"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}])

    for batch in batches:
        if batch.num_rows:
            last = [batch.column(c)[batch.num_rows - 1].as_py() for c in ("signature", "low", "high")]
            keys = np.stack([batch.column(c).to_numpy() for c in ("signature", "low", "high")], axis=1)
            same = (keys == np.array(last)).all(axis=1)
            first = int(np.argmax(same))
            if first:
                yield from close(pa.Table.from_batches([*held, batch.slice(0, first)]))
                held = [batch.slice(first)]
            elif held and [held[-1].column(c)[0].as_py() for c in ("signature", "low", "high")] != last:
                yield from close(pa.Table.from_batches(held))
                held = [batch]
            else:
                held.append(batch)
    if held:
        yield from close(pa.Table.from_batches(held))


def _verify(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    schema = kernel.arrow_schema("a long, b long")
    for batch in batches:
        for first, data, offsets in kernel.byte_chunks(batch.column("text_a")):
            own = batch.slice(first, len(offsets) - 1)
            left = kernel.shingle_sets(data, offsets, words)
            right = [s for _, d, o in kernel.byte_chunks(own.column("text_b")) for s in kernel.shingle_sets(d, o, words)]
            linked = []
            for x, y in zip(left, right, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(both > 0 and 100 * both >= 80 * (len(x) + len(y) - both))
            good = own.filter(pa.array(linked, type=pa.bool_()))
            yield from kernel.batches(schema, [{"a": good.column("a"), "b": good.column("b")}])
    kernel.release()


def _counted(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """How many sets of a task hold an element, in COUNTERS counters by hash; a row a task."""
    from pyspark import TaskContext

    total = None
    for batch in batches:
        for _, data, offsets in kernel.byte_chunks(batch.column("text")):
            for elements in kernel.shingle_sets(data, offsets, words):
                total = np.zeros(COUNTERS, dtype=np.int64) if total is None else total
                np.add.at(total, (elements % np.uint64(COUNTERS)).astype(np.int64), 1)
    if total is not None:
        yield from kernel.batches(kernel.arrow_schema(COUNTED), [{"slot": [TaskContext.get().partitionId()], "counters": [total.tobytes()]}])
    kernel.release()


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c.as_buffer(), dtype=np.int64) for c in table.column("counters"))
    return pa.table({"slot": table.column("slot").slice(0, 1), "counters": pa.array([total.tobytes()], type=pa.binary())})


def counters_of(texts: DataFrame, scratch: Scratch, name: str, words: int) -> np.ndarray:
    """How often elements occur in the texts' sets, by hash: COUNTERS numbers, whatever the texts."""
    level = scratch.keep(texts.mapInArrow(lambda it: _counted(it, words), COUNTED), f"{name}-counters")
    width, k = level.agg(F.max("slot")).first()[0], 0
    while width:
        width, k = width // FAN_IN, k + 1
        level = scratch.keep(level.withColumn("slot", F.floor(F.col("slot") / FAN_IN).cast("long")).groupBy("slot").applyInArrow(_added, COUNTED), f"{name}-counters-{k}")
    found = level.toArrow()
    return np.frombuffer(found.column("counters")[0].as_buffer(), dtype=np.int64) if found.num_rows else np.zeros(COUNTERS, dtype=np.int64)


def _rare(batches: Iterator[pa.RecordBatch], words: int, counters: object) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in kernel.byte_chunks(batch.column("text")):
            sets = kernel.shingle_sets(data, offsets, words)
            ids, found = pa.array([set_names(e)[0] for e in sets], type=pa.int64()), pa.array([rarest(e, counters.value) if len(e) else b"" for e in sets], type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(sets)), ids, found], names=["doc_id", "id", "rare"])
    kernel.release()


def mixed_members(members: DataFrame, names: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """The rows of large buckets (signature, id, band, block) that still hold several groups, with doc_id, group and the
    bucket's last block."""
    rows = members.join(names, "id")
    mixed = rows.groupBy("signature").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.max("block").alias("last")).where("low < high").select("signature", "last")
    return scratch.keep(rows.join(mixed, "signature").select("signature", "id", "doc_id", "band", "block", "last", "group"), f"mixed-{k}")


def told_apart(rows: DataFrame, texts: DataFrame, features: DataFrame, scratch: Scratch, words: int) -> DataFrame:
    """n, sketch and rare elements of the documents of mixed buckets. What is joined to texts is a table of ids only."""
    ids = scratch.keep(rows.select("doc_id").distinct(), "mixed-ids")
    own = scratch.keep(texts.join(ids, "doc_id", "left_semi"), "mixed-texts")
    counters = texts.sparkSession.sparkContext.broadcast(counters_of(own, scratch, "mixed", words))
    rare = own.mapInArrow(lambda it: _rare(it, words, counters), "doc_id long, id long, rare binary")
    sketches = features.join(ids, "doc_id", "left_semi").select("doc_id", F.col("d1").alias("id"), "band", "n", "sketch")
    told = scratch.keep(sketches.join(rare, ["doc_id", "id"]).dropDuplicates(["doc_id", "id", "band"]), "told")
    scratch.drop("mixed-texts")
    return told


def propose(rows: DataFrame, forest: bool) -> DataFrame:
    """Pairs (a, b) of mixed members."""
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    rows = rows.select("signature", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "doc_id", "group", "n", "sketch", "rare")
    dealt = rows.repartition("signature", "low", "high").sortWithinPartitions("signature", "low", "high", "doc_id")
    return dealt.mapInArrow(lambda it: _propose(it, forest), "a long, b long").distinct()


def verify(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    a, b = (texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _verify(it, words), "a long, b long")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = kernel.arrow_schema("a long, b long")
    for batch in batches:
        bits = [[np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in batch.column(c)] for c in ("sketch_a", "sketch_b")]
        apart = np.array([int(np.bitwise_count(x ^ y).sum()) for x, y in zip(*bits, strict=True)], dtype=np.int64)
        good = batch.filter(pa.array(9 * apart <= batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()))
        yield from kernel.batches(schema, [{"a": good.column("a"), "b": good.column("b")}])


def passing(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """The pairs (a, b, band) of documents whose sketches allow a link."""
    a, b = (features.select(F.col("doc_id").alias(k), "band", F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}")) for k in "ab")
    return pairs.join(a, ["a", "band"]).join(b, ["b", "band"]).select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_compare, "a long, b long").distinct()


def named(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of sets (a, b) as pairs of documents of different groups; names: id, doc_id, group. A hash that several
    sets share stands for all of them."""
    a, b = (names.select(F.col("id").alias(k), F.col("doc_id").alias(f"doc_{k}"), F.col("group").alias(f"group_{k}")) for k in "ab")
    rows = pairs.join(a, "a").join(b, "b").where("group_a <> group_b")
    return rows.select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b"), "band").distinct()


def grouped(names: DataFrame, united: DataFrame) -> DataFrame:
    """id, doc_id and group of every set."""
    found = names.select("id", "doc_id").join(united.withColumnsRenamed({"node": "doc_id", "root": "group"}), "doc_id", "left")
    return found.withColumn("group", F.coalesce("group", "doc_id"))


def jaccard_join(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id and n_verified (links that were verified on the way to the groups; a family of
    near copies has more, which its group implies and nothing counts)."""
    scratch = Scratch(docs.sparkSession, "jaccard-join")
    texts = docs.select("doc_id", "text")
    features = scratch.keep(texts.mapInArrow(lambda it: _features(it, words), FEATURES), "features")
    key = ["n", "d1", "d2"]
    usable = features.where("n > 0 and doc_id is not null")
    sets = scratch.keep(usable.where("main").groupBy(*key).agg(F.min("doc_id").alias("first")), "sets")

    signed = texts.mapInArrow(lambda it: _sign(it, words), SIGNED)
    buckets = signed.repartition("signature").sortWithinPartitions("signature", "n", "id").mapInArrow(_buckets, BUCKETS)
    buckets = scratch.keep(buckets, "buckets")
    pairs = scratch.keep(buckets.where("b is not null").groupBy("a", "b", "band").agg(F.max("star").alias("star")), "pairs")
    members = buckets.where("b is null").select("signature", F.col("a").alias("id"), "band", "block")
    names = sets.select(F.col("d1").alias("id"), F.col("first").alias("doc_id"))

    stars = named(pairs.where("star").drop("star"), names.withColumn("group", F.col("doc_id"))).groupBy("b").agg(*[f(F.struct("a", "band")).alias(k) for k, f in (("low", F.min), ("high", F.max))])
    stars = stars.select("b", F.explode(F.array_distinct(F.array("low", "high"))).alias("s")).select("s.a", "b", "s.band")
    tried = [scratch.keep(passing(stars, usable), "tried-0")]
    links = scratch.keep(verify(tried[0], texts_of(texts, tried[0], scratch, "texts-0"), words), "links-0")
    groups, told = components(links, scratch, "united-0"), None
    for k, forest in ((1, None), (2, True), (3, False)):
        names = scratch.keep(grouped(names, groups), f"names-{k}")
        if forest is None:
            found = passing(named(pairs.drop("star"), names), usable)
        else:
            rows = mixed_members(members, names, scratch, k)
            if rows.isEmpty():
                break
            told = told if told is not None else told_apart(rows, texts, usable, scratch, words)  # later mixed buckets are some of these
            found = propose(rows.join(told, ["doc_id", "id", "band"]), forest)
        for before in tried:
            found = found.join(before, ["a", "b"], "left_anti")
        tried.append(scratch.keep(found, f"tried-{k}"))
        if not tried[k].isEmpty():
            links = scratch.keep(links.union(verify(tried[k], texts_of(texts, tried[k], scratch, f"texts-{k}"), words)), f"links-{k}")
            groups = components(links, scratch, f"united-{k}")
            scratch.drop(f"texts-{k}")
    scratch.drop("buckets", "pairs", "texts-0", "told", *[f"{t}-{k}" for t in ("names", "tried", "mixed") for k in range(4)])
    degree = links.select(F.explode(F.array("a", "b")).alias("first")).groupBy("first").agg(F.count("*").alias("n_verified"))
    classes = sets.join(groups.withColumnRenamed("node", "first"), "first", "left").join(degree, "first", "left")
    found = features.where("main").select("doc_id", *key).join(classes, key, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "first", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce("n_verified", F.lit(0)).alias("n_verified"))


def texts_of(texts: DataFrame, pairs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The texts of pairs. Their ids are written first, so that Spark knows how few they are."""
    ids = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{name}-ids")
    return scratch.keep(texts.join(ids, "doc_id", "left_semi"), name)


def drop_near_copies(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The documents, with all their columns, less all but the first of each linked group. Rows that share a doc_id are
    one document and stay together, each different text once; rows without doc_id stay."""
    names, own = docs.columns, unused(docs.columns, "d1", "d2", "kept")
    first = jaccard_join(docs, words).where("doc_id = component_id").select(F.col("doc_id").alias(own["kept"])).distinct()
    d1, d2 = text_digest("text")
    with_id = docs.where("doc_id is not null").withColumns({own["d1"]: d1, own["d2"]: d2})
    kept = with_id.join(first, with_id["doc_id"] == F.col(own["kept"]), "left_semi").dropDuplicates(["doc_id", own["d1"], own["d2"]])
    return kept.select(*names).union(docs.where("doc_id is null"))
