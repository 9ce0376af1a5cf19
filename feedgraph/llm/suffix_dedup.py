"""Removal of repeated 200-byte strings by suffix arrays over content-routed shards.

Every window of ``window`` bytes is owned by its smallest k-gram (its *anchor*), which depends on the window's bytes
alone, so equal windows have equal anchors, at the same place of the window. The windows with one anchor place are a
segment; two of its own windows are never equal. Segments are known by their anchor and a 96-bit digest: equal ones
(*kinds*) are merged with their number before they meet, so copies, however many, are one. A kind that is alone with
its anchor is repeated wholly or not at all. Of anchors with several kinds one segment of each kind is cut out of the
texts, and they meet in one shard.

A shard sorts the suffixes of its segments by Larsson-Sadakane refinement, doubling the compared length, touching
unsorted groups only, and dropping in the last rounds the suffixes that start no window; Kasai's common prefixes then
show the windows that occur elsewhere.

An anchor with very many kinds (a passage in very many contexts) is spread over several shards. Of their suffix arrays
the windows that are still single, and one of each repeated kind, go on to the cross-shard merge: those that one shard
alone has are left out by a hash of the window, the others are compared as bytes, each shard's sorted suffixes being
searched for in the others' by binary search. The hash only tells which windows meet; bytes decide.

Results go back as covered runs; a document's runs are united and its remaining bytes hashed.

Defined results. Null text is empty. Matches never cross documents; repeated rows are documents of their own (a row's
number tells them apart), so both copies are removed. Texts shorter than a window stay whole. Extra columns, whatever
their names, are left out of the results and kept in the rewritten documents; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedgraph.llm import kernel
from feedgraph.llm.scratch import Scratch, text_digest, unused

WINDOW, GRAM = 200, 40
SEGMENTS_PER_SHARD = 2048
SHARD_BYTES = 1 << 19
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
KIND = ("anchor", "k1", "k2")


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of width values, in two passes over blocks of that width."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first window's start within the text, bytes, anchor) of every segment of a chunk."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < window:
        return none, none, none, none
    up, down = kernel.POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    grams = kernel.mix((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])
    # The smallest by its upper 32 bits, the leftmost of equal ones: its place is the lower half.
    placed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    owner = sliding_minimum(placed, window - gram + 1) & np.uint64(0xFFFFFFFF)
    valid = np.zeros(len(owner) + 1, dtype=np.int8)
    lengths = np.diff(offsets)
    whole = np.flatnonzero(lengths >= window)
    valid[offsets[whole]] += 1
    valid[offsets[whole] + lengths[whole] - window + 1] -= 1
    valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
    change = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])))) if len(owner) else none
    ends = np.concatenate((change[1:], [len(owner)]))
    keep = valid[change]
    starts, ends = change[keep], ends[keep]
    text = np.searchsorted(offsets, starts, side="right") - 1
    return text, starts - offsets[text], ends - starts + window - 1, grams[owner[starts].astype(np.int64)].view(np.int64)


def places_type(n: int) -> type:
    """The least type that holds places and ranks of so many bytes."""
    return np.int32 if n < 1 << 30 else np.int64


def suffix_order(data: np.ndarray, last: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by their first depth bytes (less where their text, whose end is last, ends sooner), and ranks. wanted:
    which suffixes are to be ordered; others are followed only as far as those need their ranks.

    Larsson-Sadakane: groups of equal ranks are refined by the rank h further on, h doubling; sorted groups rest."""
    n, small = len(data), places_type(len(data))
    h = 7
    room = last.astype(small) - np.arange(n, dtype=small)
    padded = np.concatenate((data.astype(np.int16) + np.int16(1), np.zeros(h, dtype=np.int16)))
    key = np.zeros(n, dtype=np.int64)
    for k in range(h):
        key <<= 9
        key += np.where(room > k, padded[k : k + n], np.int16(0))
    steps = [h]
    while steps[-1] < depth:
        steps.append(2 * steps[-1])
    needed = [np.ones(n, dtype=bool) if wanted is None else wanted]
    for step in reversed(steps[:-1]):  # a suffix's rank and that of the one so much further on make its next rank
        more = needed[0].copy()
        more[step:] |= needed[0][:-step]
        needed.insert(0, more)
    order = np.argsort(key, kind="stable").astype(small)
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    del key, padded
    rank = np.zeros(n, dtype=small)
    rank[order] = np.cumsum(new, dtype=small)
    for h, need in zip(steps[:-1], needed[1:], strict=True):
        if not need.all():
            order = order[need[order]]
            own = rank[order]
            new = np.concatenate(([True], own[1:] != own[:-1])) if len(order) else np.zeros(0, dtype=bool)
        single = new & np.concatenate((new[1:], [True]))
        where = np.flatnonzero(~single)
        if not len(where):
            break
        suffix = order[where]
        composite = np.cumsum(new)[where] * np.int64(n + 1)
        composite += np.where(room[suffix] > h, rank[np.minimum(suffix.astype(np.int64) + h, n - 1)], 0)
        if n < 1 << 21:  # with the place in the list it still fits one number
            packed = composite * len(where) + np.arange(len(where))
            packed.sort()
            refined = packed % len(where)
        else:
            refined = np.argsort(composite, kind="stable")
        order[where] = suffix[refined]
        composite = composite[refined]
        new[where] = np.concatenate(([True], composite[1:] != composite[:-1]))
        rank[order] = np.cumsum(new, dtype=small)
    return order, rank


def common_prefixes(data: np.ndarray, last: np.ndarray, order: np.ndarray, most: int | None = None) -> np.ndarray:
    """Kasai's common prefixes: of each suffix, by place in the text, with the suffix before it in order (at most so
    many bytes). order may leave suffixes out.

    A prefix loses at most one byte from a suffix to the next. Places are taken by halving strides, so each starts from
    the bound of one already known; what is missing is compared eight bytes at a time, for all places of a stride."""
    n, small = len(data), places_type(len(data))
    last = last.astype(small)
    before, place = np.full(n, -1, dtype=small), np.full(n, n, dtype=small)
    before[order[1:]] = order[:-1]
    place[order] = np.arange(len(order), dtype=small)
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    eight = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        eight |= padded[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    prefix = np.zeros(n, dtype=small)
    listed = np.flatnonzero(before >= 0).astype(small)
    stride = 256
    while True:
        a = listed[listed % (2 * stride) == stride] if stride < 256 else listed[listed % 256 == 0]
        b = before[a]
        room = np.minimum(last[a] - a, last[b] - b)
        if most is not None:
            room = np.minimum(room, most)
        known = np.zeros(len(a), dtype=small)
        if stride < 256:
            # The bound holds where the earlier pair, moved on by the stride, is in the order in that order, in its texts.
            earlier = a - stride
            other = before[earlier]
            moved = np.minimum(other + stride, n - 1)
            good = (other >= 0) & (last[earlier] == last[a]) & (place[moved] < place[a]) & (last[np.maximum(other, 0)] == last[moved])
            known = np.minimum(np.where(good, np.maximum(prefix[earlier] - stride, 0), 0), room)
        open_ = np.flatnonzero(known < room)
        while len(open_):
            at = known[open_]
            differ = eight[a[open_] + at] ^ eight[b[open_] + at]
            low = (differ & (~differ + np.uint64(1))).astype(np.float64)
            same = np.where(differ == 0, 8, (np.log2(np.maximum(low, 1.0)) / 8).astype(np.int64))
            known[open_] = np.minimum(at + same, room[open_])
            open_ = open_[(same == 8) & (known[open_] < room[open_])]
        prefix[a] = known
        if stride == 1:
            return prefix
        stride //= 2


def repeated_windows(texts: list[bytes], copies: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's distinct texts: their bytes, which places start a repeated window, and which a whole one."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    small = places_type(len(data))
    last = np.repeat(np.cumsum(lengths, dtype=small), lengths)
    whole = last - np.arange(len(data), dtype=small) >= window
    order, _ = suffix_order(data, last, window, whole)
    reach = common_prefixes(data, last, order, window)[order] >= window
    repeated = np.zeros(len(data), dtype=bool)
    repeated[order] = reach | np.concatenate((reach[1:], [False]))
    return data, (repeated | (np.repeat(copies, lengths) > 1)) & whole, whole


def runs_of(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The union of [start, end) spans as sorted maximal runs, one in each row."""
    if not len(starts):
        return np.zeros((0, 2), dtype=np.int64)
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    return np.stack((starts[new], reach[np.concatenate((new[1:], [True]))]), axis=1)


TEXTS = "d1 long, d2 long, anchors array<long>, k1 array<long>, k2 array<int>, starts array<int>, sizes array<int>"


def _segment_all(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    schema = kernel.arrow_schema(TEXTS)
    for batch in batches:
        for first, data, offsets in kernel.byte_chunks(batch.column("text")):
            n = len(offsets) - 1
            text, starts, sizes, anchors = segments(data, offsets, window, gram)
            raw, at = data.tobytes(), offsets[text] + starts
            names = b"".join([hashlib.blake2b(raw[a:b], digest_size=12).digest() for a, b in zip(at.tolist(), (at + sizes).tolist(), strict=True)])
            names = np.frombuffer(names, dtype=[("k1", "<i8"), ("k2", "<i4")])
            own = pa.array(np.searchsorted(text, np.arange(n + 1)), type=pa.int32())
            values = {"anchors": anchors, "k1": names["k1"].copy(), "k2": names["k2"].copy(), "starts": starts.astype(np.int32), "sizes": sizes.astype(np.int32)}
            lists = {k: pa.ListArray.from_arrays(own, pa.array(v)) for k, v in values.items()}
            yield from kernel.batches(schema, [lists | {k: batch.column(k).slice(first, n) for k in ("d1", "d2")}])
    kernel.release()


SLICES = "anchor long, k1 long, k2 int, copies long, n long, content binary"


def _slice_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = kernel.arrow_schema(SLICES)
    for batch in batches:
        own = batch.column("own")
        parts = own.flatten()
        columns = {k: parts.field(k) for k in ("anchor", "k1", "k2", "copies", "n")}
        starts, ends = parts.field("start").to_numpy(), parts.field("start").to_numpy() + parts.field("size").to_numpy()
        at = own.offsets.to_numpy() - own.offsets[0].as_py()
        first, contents, size = 0, [], 0
        for k, text in enumerate(kernel.text_array(batch.column("text"))):
            raw = text.as_buffer()
            for a, b in zip(starts[at[k] : at[k + 1]].tolist(), ends[at[k] : at[k + 1]].tolist(), strict=True):
                contents.append(raw[a:b].to_pybytes())
                size += b - a
            if size > kernel.CHUNK_BYTES or k == batch.num_rows - 1:
                yield from kernel.batches(schema, [{c: v.slice(first, len(contents)) for c, v in columns.items()} | {"content": contents}])
                first, contents, size = first + len(contents), [], 0
    kernel.release()


FOUND = "anchor long, k1 long, k2 int, a int, b int, shard long, hash long"


def _shard(table: pa.Table, window: int) -> pa.Table:
    """Repeated runs [a, b) of a shard's segments. Where an anchor is spread over shards, its windows that are single
    here, and one of each repeated kind, are listed for the merge with their hashes (b: 0 if single, else -1)."""
    schema = kernel.arrow_schema(FOUND)
    names = np.stack([table.column(c).to_numpy() for c in KIND], axis=1)
    _, distinct = np.unique(names, axis=0, return_index=True)  # rows that share doc_id and text are cut out twice
    table = table.take(pa.array(np.sort(distinct)))
    texts = table.column("content").to_pylist()
    data, repeated, whole = repeated_windows(texts, table.column("copies").to_numpy(), window)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    starts = np.flatnonzero(repeated)
    owner = np.searchsorted(bounds, starts, side="right") - 1
    new = np.flatnonzero(np.concatenate(([True], (np.diff(starts) > window) | (owner[1:] != owner[:-1])))) if len(starts) else starts
    ends = np.concatenate((new[1:] - 1, [len(starts) - 1])).astype(np.int64) if len(starts) else starts
    rows, a, b = owner[new], starts[new] - bounds[owner[new]], starts[ends] + window - bounds[owner[new]]
    shard = table.column("shard").to_numpy()
    hashes = np.zeros(0, dtype=np.int64)
    spread = table.column("spread").to_numpy()
    if spread.any():
        where = np.flatnonzero(whole & np.repeat(spread, np.diff(bounds)))
        hashed = kernel.span_hashes(data, where, where + window)
        known = repeated[where]
        one = np.flatnonzero(known)[np.unique(hashed[known], return_index=True)[1]]
        sent = np.sort(np.concatenate((np.flatnonzero(~known), one)))
        owner = np.searchsorted(bounds, where[sent], side="right") - 1
        rows, a, b = np.concatenate((rows, owner)), np.concatenate((a, where[sent] - bounds[owner])), np.concatenate((b, np.where(known[sent], -1, 0)))
        hashes = hashed[sent].view(np.int64)
    columns = {c: table.column(c).to_numpy()[rows] for c in KIND} | {"a": a, "b": b, "shard": shard[rows]}
    columns["hash"] = pa.concat_arrays([pa.nulls(len(rows) - len(hashes), pa.int64()), pa.array(hashes)])
    out = pa.Table.from_batches(kernel.batches(schema, [columns]), schema=schema)
    kernel.release()
    return out


def _merge(table: pa.Table, window: int) -> pa.Table:
    """The sorted windows of each shard are searched in every other's, as bytes. Only windows that are single in their
    own shard are found anew."""
    shard, single = table.column("shard").to_numpy(), table.column("b").to_numpy() == 0
    windows = np.array(table.column("content").to_pylist(), dtype=object)
    order = sorted(range(len(windows)), key=windows.__getitem__)
    number = np.zeros(len(windows), dtype=np.int64)  # of distinct windows, in their order
    number[order] = np.cumsum([k > 0 and windows[i] != windows[order[k - 1]] for k, i in enumerate(order)])
    runs = {s: np.sort(number[shard == s]) for s in np.unique(shard)}
    hit = np.zeros(len(number), dtype=bool)
    for s in runs:
        own = np.flatnonzero((shard == s) & single)
        for other, run in runs.items():
            if other != s:
                hit[own] |= run[np.minimum(np.searchsorted(run, number[own]), len(run) - 1)] == number[own]
    found = table.filter(pa.array(hit))
    a = found.column("a").to_numpy()
    return pa.table({c: found.column(c) for c in KIND} | {"a": pa.array(a), "b": pa.array((a + window).astype(np.int32))})


def covered(batch: pa.RecordBatch, texts: pa.Array, copied: str, spans: str, window: int) -> list[np.ndarray]:
    """Of each text the maximal runs that go: all of it if it has a copy, else the union of its spans."""
    lengths = np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1])
    whole = batch.column(copied).fill_null(False).to_numpy(zero_copy_only=False) & (lengths >= window)
    listed = batch.column(spans)
    flat = listed.flatten()
    counts = np.array([len(v) if v.is_valid else 0 for v in listed], dtype=np.int64)
    row = np.repeat(np.arange(len(texts)), counts)
    base = np.concatenate(([0], np.cumsum(lengths + 1)))  # a byte between texts keeps their runs apart
    a, b = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) + base[row] for k in ("a", "b"))
    keep = ~whole[row]
    a, b = np.concatenate((a[keep], base[:-1][whole])), np.concatenate((b[keep], (base[:-1] + lengths)[whole]))
    runs = runs_of(a, b)
    cuts = np.searchsorted(runs[:, 0], base)
    return [runs[cuts[k] : cuts[k + 1]] - base[k] for k in range(len(texts))]


def without(text: bytes, runs: np.ndarray) -> bytes:
    edges = [0, *runs.ravel().tolist(), len(text)]
    return b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])


def _finish(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    schema = kernel.arrow_schema(RESULT)
    for batch in batches:
        texts = kernel.text_array(batch.column("text"))
        out: dict[str, list] = {name: [] for name in schema.names if name != "doc_id"}
        for text, runs in zip(texts, covered(batch, texts, "copied", "spans", window), strict=True):
            raw = text.as_py()
            kept = without(raw, runs) if len(runs) else raw
            for column, value in zip(out.values(), (len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()), strict=True):
                column.append(value)
        yield from kernel.batches(schema, [out | {"doc_id": batch.column("doc_id")}])
    kernel.release()


def _rewrite(batches: Iterator[pa.RecordBatch], names: list[str], text_name: str, copied: str, spans: str, window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(text_name)
        raw = kernel.text_array(column)
        texts, keep = [], []
        for k, runs in enumerate(covered(batch, raw, copied, spans, window)):
            kept = without(raw[k].as_py(), runs).decode(errors="ignore") if len(runs) else column[k].as_py()
            texts.append(kept)
            keep.append(not len(runs) or bool(kept))
        columns = [pa.array(texts, type=column.type) if n == text_name else batch.column(n) for n in names]
        yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, type=pa.bool_()))
    kernel.release()


def repeated_runs(docs: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """d1, d2 (the digest of a text), copied, spans ([a, b) of repeated bytes); docs: d1, d2, number, text."""
    digest = ["d1", "d2"]
    found = docs.select(*digest, "text").mapInArrow(lambda it: _segment_all(it, window, gram), TEXTS)
    # Equal texts become one, with their number and one of their own (t).
    names = ("anchors", "k1", "k2", "starts", "sizes")
    found = found.groupBy(*digest).agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in names])
    texts = scratch.keep(found.withColumn("t", F.monotonically_increasing_id()), "texts")
    zipped = F.arrays_zip(*[F.col(a).alias(b) for a, b in zip(names, (*KIND, "start", "size"), strict=True)])
    own = texts.select("t", "copies", F.explode(zipped).alias("s")).select("t", "copies", "s.*")
    # A kind keeps one of its places, whichever comes first.
    kinds = scratch.keep(own.groupBy(*KIND).agg(F.sum("copies").alias("copies"), *[F.first(c).alias(c) for c in ("t", "start", "size")]), "kinds")
    anchors = kinds.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("copies").alias("total"), F.sum("size").alias("bytes"))
    anchors = scratch.keep(anchors.where("total > 1"), "anchors")
    alone = kinds.where("copies > 1").join(anchors.where("n = 1").select("anchor"), "anchor", "left_semi")
    runs = alone.select(*KIND, F.lit(0).alias("a"), F.col("size").alias("b"))

    several = anchors.where("n > 1").select("anchor", "n")
    several = kinds.join(several, "anchor").groupBy("t").agg(F.collect_list(F.struct(*KIND, "copies", "n", "start", "size")).alias("own"))
    one = docs.groupBy(*digest).agg(F.min("number").alias("number"))
    chosen = several.join(texts.select("t", *digest), "t").drop("t").join(one, digest)
    cut = docs.select(*digest, "number", "text").join(chosen, [*digest, "number"]).select("text", "own").mapInArrow(_slice_all, SLICES)
    sizes = anchors.where("n > 1").agg(F.sum("bytes")).first()[0] or 0
    n_shards = max(1, -(-sizes // SHARD_BYTES))
    is_spread = F.col("n") > SEGMENTS_PER_SHARD
    part = F.when(is_spread, F.pmod("k1", F.ceil(F.col("n") / SEGMENTS_PER_SHARD)))
    dealt = cut.withColumns({"spread": is_spread, "shard": F.pmod(F.xxhash64("anchor", part), F.lit(n_shards)).cast("long")})
    large = not anchors.where(is_spread).isEmpty()
    if large:
        dealt = scratch.keep(dealt, "slices")
    found = dealt.drop("n").groupBy("shard").applyInArrow(lambda t: _shard(t, window), FOUND)
    found = scratch.keep(found, "found")
    runs = runs.unionAll(found.where("hash is null").select(*KIND, "a", "b"))
    if large:
        windows = found.where("hash is not null")
        shared = windows.groupBy("hash").agg(F.min("shard").alias("low"), F.max("shard").alias("high"), F.max("b").alias("b")).where("low < high and b = 0").select("hash")
        windows = windows.join(shared, "hash", "left_semi").join(dealt.where("spread").select(*KIND, "content").dropDuplicates(KIND), list(KIND))
        windows = windows.withColumns({"content": F.substring("content", F.col("a") + 1, F.lit(window)), "part": F.pmod(F.xxhash64("hash"), F.lit(16 * n_shards))})
        runs = runs.unionAll(windows.groupBy("part").applyInArrow(lambda t: _merge(t, window), "anchor long, k1 long, k2 int, a int, b int"))
    runs = scratch.keep(runs, "runs")
    scratch.drop("kinds", "found", "slices")
    # Copied texts go whole; spans are for the others.
    spans = own.where("copies = 1").select("t", *KIND, "start").join(runs, list(KIND))
    spans = spans.groupBy("t").agg(F.collect_list(F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))).alias("spans"))
    copied = texts.select("t", *digest, (F.col("copies") > 1).alias("copied"))
    spans = scratch.keep(copied.join(spans, "t", "left").drop("t").where("copied or spans is not null"), "spans")
    scratch.drop("texts", "anchors", "runs")
    return spans


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), its digest (d1, d2) and number (doc_id, or the least number for null)."""
    d1, d2 = text_digest("text")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(2**63))).alias("number"), d1.alias("d1"), d2.alias("d2"))


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document with what was removed from it."""
    rows = digested(docs)
    spans = repeated_runs(rows, Scratch(docs.sparkSession, "suffix-dedup"), window, gram)
    return rows.join(spans, ["d1", "d2"], "left").select("doc_id", "text", "copied", "spans").mapInArrow(lambda it: _finish(it, window), RESULT)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The documents, with all their columns, with repeated bytes cut out of their texts; a character that a cut parts
    goes whole. A document of which nothing is left goes."""
    names, text_name = docs.columns, next(c for c in docs.columns if c.lower() == "text")
    spans = repeated_runs(digested(docs), Scratch(docs.sparkSession, "suffix-dedup"), window, gram)
    own = unused(names, "d1", "d2", "copied", "spans")
    spans = spans.select(*[F.col(c).alias(own[c]) for c in ("d1", "d2", "copied", "spans")])
    d1, d2 = text_digest("text")
    rows = docs.withColumns({own["d1"]: d1, own["d2"]: d2}).join(spans, [own["d1"], own["d2"]], "left").drop(own["d1"], own["d2"])
    copied, listed = own["copied"], own["spans"]
    return rows.mapInArrow(lambda it: _rewrite(it, names, text_name, copied, listed, window), docs.schema)
