"""Language-model scoring by a Brown class-based bigram model.

Exchange clustering assigns words to classes so that class bigrams are as telling as they can be. Each round counts, for
every word of the training texts, the classes to its left and right; words then move, in tasks, to the class whose
neighbours fit their own best. The neighbours' classes and the class bigrams are those from before the round, so a word's
choice depends on no other word's, and all that goes to the driver or to all tasks is the table of class bigrams and the
classes of listed words. All words move at once, until a round would make the training text less likely: it is taken back, and from there
on the words take turns by shares (of their checksums), twice as many each time. So the likelihood never falls; rounds
end when it stops rising, or after ``rounds``.

Texts are read twice: for the counts of their words, and to be written as numbers. The most frequent words ("listed")
have the first numbers; their classes are sent to the tasks, which count pairs of them by themselves. All others
("rare") have 64-bit hashes for numbers (another seed is taken should two of them share one) and are dealt by them into
buckets: of each its words, the listed and rare words beside them with their counts, and their classes. Rare words that
stand beside each other tell their buckets their classes in every round. A bucket is a few arrays in one row, and there
are as many as keep each small. Which words are listed changes no result.

A word's probability is that of its class after the class before it, times its own share in its class, both smoothed:
P(c | c') = (N(c', c) + a u(c)) / (N(c') + a) and P(w | c) = (c(w) + 1/2) / (N(c) + (V(c) + 1) / 2), u being the smoothed
frequencies of classes. A word that training lacks may be of any class and has the share that is left for one unseen
word of it; the probability of a run of such words is the sum over all their classes.

Word counts cover the whole training corpus and stay a table; the most frequent, at most ``known_words``, of at most 64
bytes are sent to the tasks (a bound of some 15 MB). To score, every part of the corpus asks the buckets once for each
of its rare words.

Defined results. Null text is empty: one (end) token. Null doc_id counts as training. Repeated rows are texts of their
own. Without training tokens the base score is zero a token and the model is uniform over classes. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedgraph.llm import kernel
from feedgraph.llm.scratch import Scratch

FOLDS, HELD_OUT = 5, 1
CLASSES, KNOWN_WORDS, WORD_BYTES, ROUNDS, PRIOR = 64, 131_072, 64, 3, 10.0
LEAST_GAIN, MOST_SHARES = 5e-3, 8  # of the log-likelihood of a token, for another round; of words that take turns
END_CLASS, STATS_BLOCK = 0, 256
RARE, BUCKET_TOKENS, BATCH_TOKENS = 1 << 62, 250_000, 1 << 20  # the least number of a rare word
STATS = "block long, cells binary, counts binary"
TOKENS = "part long, doc_ids array<long>, held binary, lengths binary, ids binary, rare binary"
ENTRIES = "bucket long, ids binary, codes binary, ns binary, pair_ids binary, sides binary, others binary, pair_ns binary"
STATE = "bucket long, ids binary, counts binary, at binary, codes binary, ns binary, pair_at binary, sides binary, others binary, pair_ns binary, n_words long"
NEAR = "bucket long, classes binary, ids binary, offsets binary, near binary, near_ns binary, block long, cells binary, counts binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, score double, logs double"


def words(text: bytes) -> list[bytes]:
    """Lower-cases A-Z and splits at ASCII white space."""
    return text.lower().split()


class Vocabulary:
    """The listed words, most frequent first, with their counts. A word's place is its number; the end has the next
    one, and rare words' numbers begin at a block of their own."""

    def __init__(self, listed: list[bytes], counts: np.ndarray) -> None:
        self.listed, self.counts, self.end = listed, counts, len(listed)
        self.first_rare = -(-(self.end + 1) // STATS_BLOCK) * STATS_BLOCK

    def index(self) -> dict[bytes, int]:
        return {w: k for k, w in enumerate(self.listed)}

    def hashes(self, seed: int) -> np.ndarray:
        out = np.zeros(self.first_rare, dtype=np.int64)
        out[: self.end] = [rare_number(w, seed) for w in self.listed]
        return out


def rare_number(word: bytes, seed: int) -> int:
    return RARE | xxhash.xxh64_intdigest(word, seed) >> 2


def array(value: object, dtype: type) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=dtype)


def packed(values: np.ndarray, dtype: type) -> bytes:
    return zstandard.compress(values.astype(dtype).tobytes(), 1)


def unpacked(value: object, dtype: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(value.as_buffer()), dtype=dtype)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([pa.field("word", pa.binary()), pa.field("n", pa.int64())])
    counts: Counter[bytes] = Counter()
    for batch in batches:
        for text in kernel.text_array(batch.column("text")):
            counts.update(words(text.as_py()))
            if len(counts) > 400_000:
                yield from kernel.batches(schema, [{"word": list(counts), "n": list(counts.values())}])
                counts.clear()
    yield from kernel.batches(schema, [{"word": list(counts), "n": list(counts.values())}])
    kernel.release()


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, seed: int) -> Iterator[pa.RecordBatch]:
    """Texts as numbers (-1: rare), and the numbers of the rare words, by parts of some hundred texts."""
    from pyspark import TaskContext

    schema, index = kernel.arrow_schema(TOKENS), vocabulary.index()
    part = TaskContext.get().partitionId() << 40
    for batch in batches:
        texts = kernel.text_array(batch.column("text"))
        for first, _, offsets in kernel.byte_chunks(texts):
            own = batch.slice(first, len(offsets) - 1)
            tokens = [words(t.as_py()) for t in texts.slice(first, own.num_rows)]
            flat = [w for t in tokens for w in t]
            ids = np.fromiter(map(index.get, flat, repeat(-1)), dtype=np.int32, count=len(flat))
            rare = np.array([rare_number(flat[k], seed) for k in np.flatnonzero(ids < 0).tolist()], dtype=np.int64)
            columns = {"part": [part], "doc_ids": [own.column("doc_id").to_pylist()], "held": [own.column("held_out").to_numpy(zero_copy_only=False).tobytes()]}
            yield from kernel.batches(schema, [columns | {"lengths": [np.array(list(map(len, tokens)), dtype=np.int32).tobytes()], "ids": [ids.tobytes()], "rare": [rare.tobytes()]}])
            part += 1
    kernel.release()


def whole_numbers(ids: np.ndarray, rare: np.ndarray) -> np.ndarray:
    out = ids.astype(np.int64)
    out[ids < 0] = rare
    return out


def bordered(numbers: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another with an end before, between and after them; and where their words are."""
    out = np.full(len(numbers) + len(lengths) + 1, end, dtype=np.int64)
    at = np.arange(len(numbers)) + np.repeat(np.arange(1, len(lengths) + 1), lengths)
    out[at] = numbers
    return out, at


def _training(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[np.ndarray]:
    """The training texts of each part as one list of numbers, bordered by ends."""
    for batch in batches:
        for row in range(batch.num_rows):
            held, lengths = array(batch.column("held")[row], np.bool_), array(batch.column("lengths")[row], np.int32)
            numbers = whole_numbers(array(batch.column("ids")[row], np.int32), array(batch.column("rare")[row], np.int64))
            yield bordered(numbers[np.repeat(~held, lengths)], lengths[~held], end)[0]


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (ids >> 8) % buckets


def merged(*keys: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Rows with equal keys as one, sorted, with the sum of n."""
    order = np.lexsort(keys[::-1])
    keys, n = [k[order] for k in keys], n[order]
    new = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0)))) if len(n) else np.zeros(0, dtype=np.int64)
    return [*[k[new] for k in keys], np.add.reduceat(n, new) if len(n) else n]


def _entries(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, buckets: int) -> Iterator[pa.RecordBatch]:
    """What stands beside rare words, by buckets: listed neighbours as side and number in one, rare ones apart."""
    schema, held, size = kernel.arrow_schema(ENTRIES), [], 0

    def given(sequences: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not sequences:
            return
        numbers = np.concatenate(sequences)
        at = np.flatnonzero(numbers >= RARE)
        own, right, left = numbers[at], numbers[at + 1], numbers[at - 1]
        r, l = right < RARE, left < RARE
        ids, codes, ns = merged(np.concatenate((own[r], own[l])), np.concatenate((right[r], vocabulary.first_rare + left[l])), n=np.ones(r.sum() + l.sum(), dtype=np.int64))
        pair_ids, sides, others, pair_ns = merged(
            np.concatenate((own[~r], own[~l])), np.repeat(np.array([0, 1], dtype=np.int8), [(~r).sum(), (~l).sum()]), np.concatenate((right[~r], left[~l])), n=np.ones((~r).sum() + (~l).sum(), dtype=np.int64)
        )
        one, two = bucket_of(ids, buckets), bucket_of(pair_ids, buckets)
        first, second = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
        there = np.unique(np.concatenate((one, two)))
        cuts = [np.searchsorted(b[o], there, side=s) for b, o in ((one, first), (two, second)) for s in ("left", "right")]
        rows = [(first[a:b], second[c:d]) for a, b, c, d in zip(*[c.tolist() for c in cuts], strict=True)]
        columns = {k: [packed(v[x], t) for x, _ in rows] for k, v, t in (("ids", ids, np.int64), ("codes", codes, np.int32), ("ns", ns, np.int32))}
        columns |= {k: [packed(v[x], t) for _, x in rows] for k, v, t in (("pair_ids", pair_ids, np.int64), ("sides", sides, np.int8), ("others", others, np.int64), ("pair_ns", pair_ns, np.int32))}
        yield from kernel.batches(schema, [columns | {"bucket": there}])

    for sequence in _training(batches, vocabulary.end):
        held.append(sequence)
        size += len(sequence)
        if size > BATCH_TOKENS:
            yield from given(held)
            held, size = [], 0
    yield from given(held)
    kernel.release()


def _bucket(table: pa.Table, first_rare: int) -> pa.Table:
    """A bucket's rare words with all that stands beside them: at and pair_at point to the word."""
    whole = lambda name, dtype: np.concatenate([unpacked(v, dtype) for v in table.column(name)])
    ids, codes, ns = merged(whole("ids", np.int64), whole("codes", np.int32), n=whole("ns", np.int32).astype(np.int64))
    pair_ids, sides, others, pair_ns = merged(whole("pair_ids", np.int64), whole("sides", np.int8), whole("others", np.int64), n=whole("pair_ns", np.int32).astype(np.int64))
    own = np.unique(np.concatenate((ids, pair_ids)))
    at, pair_at = np.searchsorted(own, ids), np.searchsorted(own, pair_ids)
    counts = np.zeros(len(own), dtype=np.int64)  # every occurrence has one right neighbour
    np.add.at(counts, at[codes < first_rare], ns[codes < first_rare])
    np.add.at(counts, pair_at[sides == 0], pair_ns[sides == 0])
    values = ((own, np.int64), (counts, np.int64), (at, np.int32), (codes, np.int32), (ns, np.int64), (pair_at, np.int32), (sides, np.int8), (others, np.int64), (pair_ns, np.int64))
    columns = {f.name: [packed(*v)] for f, v in zip(list(kernel.arrow_schema(STATE))[1:-1], values, strict=True)} | {"n_words": [len(own)]}
    kernel.release()
    return pa.Table.from_batches(kernel.batches(kernel.arrow_schema(STATE), [columns | {"bucket": [table.column("bucket")[0].as_py()]}]))


class Cells:
    """Counts of (word, side, class) of listed words: right neighbours are side 0. Given out by blocks of words."""

    def __init__(self, n_words: int, n_classes: int) -> None:
        self.n_classes, self.total = n_classes, np.zeros(n_words * 2 * n_classes, dtype=np.int32)

    def add(self, word: np.ndarray, side: int, classes: np.ndarray, n: np.ndarray | int = 1) -> None:
        np.add.at(self.total, (word.astype(np.int64) * 2 + side) * self.n_classes + classes, np.asarray(n, dtype=np.int32))  # of one type: else slow

    def blocks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        size = STATS_BLOCK * 2 * self.n_classes
        for block in range(len(self.total) // size):
            own = self.total[block * size : (block + 1) * size]
            cells = np.flatnonzero(own)
            if len(cells):
                yield {"block": [block], "cells": [packed(cells, np.int32)], "counts": [packed(own[cells], np.int32)]}


def _neighbours(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, classes: np.ndarray, n_classes: int) -> Iterator[pa.RecordBatch]:
    """How often each class of listed words stands beside each listed word."""
    cells = Cells(vocabulary.first_rare, n_classes)
    for found in _training(batches, vocabulary.end):
        both = np.flatnonzero((found[:-1] < RARE) & (found[1:] < RARE))
        cells.add(found[both], 0, classes[found[both + 1]])
        cells.add(found[both + 1], 1, classes[found[both]])
    yield from kernel.batches(kernel.arrow_schema(STATS), cells.blocks())
    del cells
    kernel.release()


def _messages(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The classes of rare words, to the buckets of the rare words beside them."""
    schema = kernel.arrow_schema("bucket long, told binary, told_classes binary")
    for batch in batches:
        for row in range(batch.num_rows):
            ids, classes, others = unpacked(batch.column("ids")[row], np.int64), array(batch.column("classes")[row], np.int8), unpacked(batch.column("others")[row], np.int64)
            of, own = np.divmod(np.unique(bucket_of(others, buckets) * len(ids) + unpacked(batch.column("pair_at")[row], np.int32)), max(1, len(ids)))
            to = np.stack((of, own), axis=1)
            cuts = np.flatnonzero(np.concatenate(([True], to[1:, 0] != to[:-1, 0]))) if len(to) else []
            parts = np.split(to[:, 1], cuts[1:]) if len(to) else []
            yield from kernel.batches(schema, [{"bucket": to[cuts, 0] if len(to) else [], "told": [ids[p].tobytes() for p in parts], "told_classes": [classes[p].tobytes() for p in parts]}])


def _rare(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, listed: np.ndarray, n_classes: int) -> Iterator[pa.RecordBatch]:
    """Of each rare word the classes beside it (side and class in one); and what rare words' classes give the listed
    words beside them."""
    schema, cells, first_rare = kernel.arrow_schema(NEAR), Cells(vocabulary.first_rare, n_classes), vocabulary.first_rare
    for batch in batches:
        for row in range(batch.num_rows):
            get = lambda name, dtype, row=row, batch=batch: unpacked(batch.column(name)[row], dtype)
            ids, classes, at, codes, ns = get("ids", np.int64), array(batch.column("classes")[row], np.int8), get("at", np.int32), get("codes", np.int32), get("ns", np.int64)
            own = np.zeros((len(ids), 2 * n_classes), dtype=np.int32)
            side, word = codes // first_rare, codes % first_rare
            np.add.at(own.reshape(-1), at.astype(np.int64) * 2 * n_classes + side * n_classes + listed[word], ns.astype(np.int32))
            for k in (0, 1):
                of = np.flatnonzero(side == k)
                cells.add(word[of], 1 - k, classes[at[of]], ns[of])
            told = batch.column("told")[row]
            if told.is_valid:
                known = np.concatenate([array(v, np.int64) for v in told.values])
                order = np.argsort(known)
                known, known_classes = known[order], np.concatenate([array(v, np.int8) for v in batch.column("told_classes")[row].values])[order]
                beside = known_classes[np.searchsorted(known, get("others", np.int64))]
                np.add.at(own.reshape(-1), (get("pair_at", np.int32).astype(np.int64) * 2 + get("sides", np.int8)) * n_classes + beside, get("pair_ns", np.int64).astype(np.int32))
            there, cell = np.nonzero(own)
            offsets = np.searchsorted(there, np.arange(len(ids) + 1)).astype(np.int32)
            columns = {"classes": [classes.tobytes()], "ids": [packed(ids, np.int64)], "offsets": [packed(offsets, np.int32)], "near": [packed(cell, np.int16)], "near_ns": [packed(own[there, cell], np.int32)]}
            yield from kernel.batches(schema, [columns | {"bucket": [batch.column("bucket")[row].as_py()], "block": [None], "cells": [None], "counts": [None]}])
    nothing = {f.name: [None] for f in schema}
    yield from kernel.batches(schema, (nothing | b for b in cells.blocks()))
    del cells
    kernel.release()


def _sum_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block -> one for each; only one block is held."""
    schema, total, block = kernel.arrow_schema(STATS), np.zeros(size, dtype=np.int64), None

    def done() -> Iterator[pa.RecordBatch]:
        cells = np.flatnonzero(total)
        yield from kernel.batches(schema, [{"block": [block], "cells": [packed(cells, np.int32)], "counts": [packed(total[cells], np.int64)]}])

    for batch in batches:
        for at, cells, counts in zip(batch.column("block").to_pylist(), batch.column("cells"), batch.column("counts"), strict=True):
            if at != block:
                if block is not None:
                    yield from done()
                block = at
                total[:] = 0
            total[unpacked(cells, np.int32)] += unpacked(counts, np.int32)
    if block is not None:
        yield from done()


def summed(parts: DataFrame, size: int) -> DataFrame:
    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(lambda it: _sum_blocks(it, size), STATS)


def smoothed(bigrams: np.ndarray) -> np.ndarray:
    """Of each class after the class before it: its probability."""
    tokens = bigrams.sum(axis=0)
    usual = (tokens + 0.5) / (tokens.sum() + 0.5 * len(tokens))
    return (bigrams + PRIOR * usual) / (bigrams.sum(axis=1, keepdims=True) + PRIOR)


def likelihood(bigrams: np.ndarray) -> float:
    """The log-likelihood of the training text by its classes, but for what no classes can change."""
    part = lambda n: float((n[n > 0] * np.log(n[n > 0])).sum())
    n = bigrams.astype(np.float64)
    return part(n) - part(n.sum(axis=0)) - part(n.sum(axis=1))


def class_bigrams(stats: np.ndarray, classes: np.ndarray) -> np.ndarray:
    of_class = (classes[:, None] == np.arange(stats.shape[2])).astype(np.float64)
    return np.rint(of_class.T @ stats[:, 0, :].astype(np.float64)).astype(np.int64)


def exchange(stats: np.ndarray, classes: np.ndarray, bigrams: np.ndarray | None = None) -> np.ndarray:
    """Every word moves to the class that makes the classes beside it likeliest, the end stays. bigrams: those of all
    words, where the stats are of some."""
    if bigrams is None:
        bigrams = class_bigrams(stats, classes)
    gain = stats[:, 0, :] @ np.log(smoothed(bigrams)).T + stats[:, 1, :] @ np.log(smoothed(bigrams.T)).T
    gain[:, END_CLASS] = -np.inf
    return np.where(classes == END_CLASS, END_CLASS, np.argmax(np.round(gain, 6), axis=1))


def _by_block(batches: Iterator[pa.RecordBatch], n_classes: int) -> Iterator[tuple[int, np.ndarray]]:
    """Summed blocks of listed words: word, side, class."""
    for batch in batches:
        for row in range(batch.num_rows):
            own = np.zeros(STATS_BLOCK * 2 * n_classes, dtype=np.int64)
            own[unpacked(batch.column("cells")[row], np.int32)] = unpacked(batch.column("counts")[row], np.int64)
            yield batch.column("block")[row].as_py(), own.reshape(STATS_BLOCK, 2, n_classes)


def _by_bucket(batches: Iterator[pa.RecordBatch], n_classes: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of rare words: number, words, classes, and word, side, class."""
    for batch in batches:
        for row in range(batch.num_rows):
            get = lambda name, dtype, row=row, batch=batch: unpacked(batch.column(name)[row], dtype)
            ids, offsets = get("ids", np.int64), get("offsets", np.int32)
            own = np.zeros((len(ids), 2 * n_classes), dtype=np.int64)
            own[np.repeat(np.arange(len(ids)), np.diff(offsets)), get("near", np.int16)] = get("near_ns", np.int32)
            yield batch.column("bucket")[row].as_py(), ids, array(batch.column("classes")[row], np.int8).astype(np.int64), own.reshape(-1, 2, n_classes)


def total_bigrams(stats: DataFrame, near: DataFrame, listed: np.ndarray, n_classes: int) -> np.ndarray:
    """Class bigrams of all words, from listed ones' blocks and rare ones' buckets; one row for each two classes comes."""

    def given(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = sum(parts, np.zeros((n_classes, n_classes), dtype=np.int64))
        cells = np.flatnonzero(total)
        yield from kernel.batches(kernel.arrow_schema("cell long, n long"), [{"cell": cells, "n": total.ravel()[cells]}])

    of_blocks = lambda it: given(class_bigrams(own, listed[b * STATS_BLOCK : (b + 1) * STATS_BLOCK]) for b, own in _by_block(it, n_classes))
    of_buckets = lambda it: given(class_bigrams(own, classes) for _, _, classes, own in _by_bucket(it, n_classes))
    both = stats.mapInArrow(of_blocks, "cell long, n long").unionAll(near.mapInArrow(of_buckets, "cell long, n long"))
    out = np.zeros(n_classes * n_classes, dtype=np.int64)
    for row in both.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[row["cell"]] = row["n"]
    return out.reshape(n_classes, n_classes)


def moving(hashes: np.ndarray, turn: int, shares: int) -> np.ndarray:
    """Is it a word's turn? One of so many shares moves at once."""
    return hashes % shares == turn % shares


def moved_listed(stats: DataFrame, listed: np.ndarray, hashes: np.ndarray, bigrams: np.ndarray, turn: int, shares: int) -> np.ndarray:
    n_classes = len(bigrams)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, own in _by_block(batches, n_classes):
            at = slice(block * STATS_BLOCK, (block + 1) * STATS_BLOCK)
            there = np.flatnonzero(own.any(axis=(1, 2)) & moving(hashes[at], turn, shares))
            new = exchange(own[there], listed[at][there], bigrams)
            yield from kernel.batches(kernel.arrow_schema("id long, class long"), [{"id": block * STATS_BLOCK + there, "class": new}])

    found = stats.mapInArrow(move, "id long, class long").toArrow()  # a row for each listed word at most
    out = listed.copy()
    out[found.column("id").to_numpy()] = found.column("class").to_numpy()
    return out


def moved_rare(near: DataFrame, bigrams: np.ndarray, turn: int, shares: int) -> DataFrame:
    n_classes = len(bigrams)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, ids, classes, own in _by_bucket(batches, n_classes):
            new = np.where(moving(ids, turn, shares), exchange(own, classes, bigrams), classes)
            yield from kernel.batches(kernel.arrow_schema("bucket long, classes binary"), [{"bucket": [bucket], "classes": [new.astype(np.int8).tobytes()]}])

    return near.mapInArrow(move, "bucket long, classes binary")


def unseen_runs(transition: np.ndarray, share: np.ndarray, lengths: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """log10 probabilities of runs of unseen words between two classes, with the step to the one after them."""
    step = 10.0**transition
    each = 0.5 * 10.0**share
    each[END_CLASS] = 0
    each = each[:, None] * step
    out, so_far, scale, done = np.zeros(len(lengths)), step, 0.0, 0
    for length in np.unique(lengths).tolist():
        for _ in range(length - done):
            so_far = so_far @ each
            most = so_far.max()
            so_far, scale = so_far / most, scale + np.log10(most)
        done = length
        at = np.flatnonzero(lengths == length)
        out[at] = np.log10(so_far[before[at], after[at]]) + scale
    return out


def _asked(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Each rare word of a part once, to its bucket."""
    schema = kernel.arrow_schema("bucket long, part long, wanted binary")
    for batch in batches:
        for part, rare in zip(batch.column("part").to_pylist(), batch.column("rare"), strict=True):
            rows = by_bucket(array(rare, np.int64), buckets)
            yield from kernel.batches(schema, [{"bucket": list(rows), "part": [part] * len(rows), "wanted": [v.tobytes() for v in rows.values()]}])


def by_bucket(rare: np.ndarray, buckets: int) -> dict[int, np.ndarray]:
    """The distinct numbers of each bucket."""
    ids = np.unique(rare)
    of = bucket_of(ids, buckets)
    return {b: ids[of == b] for b in np.unique(of).tolist()} if len(ids) else {}


def _answers(asked: pa.Table, known: pa.Table) -> pa.Table:
    """Counts and classes of the words asked for (unseen: 0 and -1)."""
    ids, counts = (unpacked(known.column(k)[0], np.int64) if len(known) else np.zeros(0, dtype=np.int64) for k in ("ids", "counts"))
    classes = array(known.column("classes")[0], np.int8) if len(known) else np.zeros(0, dtype=np.int8)
    ids, counts, classes = np.append(ids, 0), np.append(counts, 0), np.append(classes, -1)
    out: dict[str, list] = {"counts": [], "classes": []}
    for wanted in asked.column("wanted"):
        own = array(wanted, np.int64)
        at = np.searchsorted(ids[:-1], own)
        at[ids[at] != own] = len(ids) - 1
        out["counts"].append(counts[at].tobytes())
        out["classes"].append(classes[at].astype(np.int8).tobytes())
    return pa.table({"part": asked.column("part"), "bucket": asked.column("bucket"), **{k: pa.array(v, type=pa.binary()) for k, v in out.items()}})


def _score(tokens: pa.Table, answers: pa.Table, vocabulary: Vocabulary, buckets: int, listed: np.ndarray, transition: np.ndarray, share: np.ndarray, end_count: int) -> pa.Table:
    """Scores of the texts of one part."""
    schema = kernel.arrow_schema(SCORES)
    get = lambda name, dtype: array(tokens.column(name)[0], dtype)
    lengths, ids, rare = get("lengths", np.int32).astype(np.int64), get("ids", np.int32), get("rare", np.int64)
    given = {b: (array(n, np.int64), array(c, np.int8)) for b, n, c in zip(answers.column("bucket").to_pylist(), answers.column("counts"), answers.column("classes"), strict=True)}
    n, own = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
    n[ids >= 0], own[ids >= 0] = vocabulary.counts[ids[ids >= 0]], listed[ids[ids >= 0]]
    wanted = by_bucket(rare, buckets)
    if wanted:
        words_, counts, classes = np.concatenate(list(wanted.values())), *(np.concatenate([given[b][k] for b in wanted]) for k in (0, 1))
        order = np.argsort(words_)
        at = order[np.searchsorted(words_, rare, sorter=order)]
        n[ids < 0], own[ids < 0] = counts[at], classes[at]
    classes, at = bordered(own, lengths, END_CLASS)
    known = classes >= 0
    steps = np.zeros(len(classes))
    both = np.flatnonzero(known[:-1] & known[1:])
    steps[both + 1] = transition[classes[both], classes[both + 1]]
    starts, ends = np.flatnonzero(known[:-1] & ~known[1:]) + 1, np.flatnonzero(~known[:-1] & known[1:])
    steps[ends] = unseen_runs(transition, share, ends - starts + 1, classes[starts - 1], classes[ends + 1])
    shares = np.where(own >= 0, share[own], -np.log10(0.5))  # an unseen word's is in its run
    owner = np.repeat(np.arange(len(lengths)), lengths)
    add = lambda values: np.bincount(owner, weights=values, minlength=len(lengths))
    last = np.cumsum(lengths + 1)  # of each text's end
    logs = add(np.log10(n + 0.5)) + np.log10(end_count + 0.5)
    score = add(steps[at]) + steps[last] + add(shares) + share[END_CLASS] + logs
    columns = {"doc_id": tokens.column("doc_ids")[0].values, "held_out": get("held", np.bool_), "n_tokens": lengths + 1, "n_known": add(n > 0).astype(np.int64) + (end_count > 0), "score": score, "logs": logs}
    out = pa.Table.from_batches(kernel.batches(schema, [columns]), schema=schema)
    kernel.release()
    return out


def most_frequent(counts: DataFrame, most: int) -> list:
    """At most so many rows (word, n), the most frequent first. A histogram of the counts (some hundred steps) tells from
    which count on they are few enough, so neither a task nor the driver gets more than that; words of the step that
    would go beyond stay out together."""
    step = F.when(F.col("n") <= 64, F.col("n")).otherwise(64 + F.floor(8 * F.log2("n")))
    least, taken = None, 0
    for row in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("c"), F.min("n").alias("low")).collect(), key=lambda r: -r["step"]):
        taken += row["c"]
        if taken > most:
            break
        least = row["low"]
    rows = [] if least is None else counts.where(F.col("n") >= least).collect()
    return sorted(rows, key=lambda r: (-r["n"], r["word"]))


class Clustering:
    """The exchange: classes of listed words (an array) and of rare words (by buckets), round by round."""

    def __init__(self, scratch: Scratch, tokens: DataFrame, state: DataFrame, vocabulary: object, buckets: int, n_classes: int) -> None:
        self.scratch, self.tokens, self.state, self.vocabulary, self.buckets, self.n_classes = scratch, tokens, state, vocabulary, buckets, n_classes
        self.levels: list[float] = []

    def near(self, classes: DataFrame, listed: np.ndarray, name: str) -> DataFrame:
        """Rare words with the classes beside them, and (without bucket) their part of listed words' counts."""
        n_classes, buckets, vocabulary = self.n_classes, self.buckets, self.vocabulary
        rows = self.state.join(classes, "bucket")
        told = rows.select("ids", "classes", "pair_at", "others").mapInArrow(lambda it: _messages(it, buckets), "bucket long, told binary, told_classes binary")
        told = told.groupBy("bucket").agg(F.collect_list(F.struct("told", "told_classes")).alias("o")).select("bucket", F.col("o.told").alias("told"), F.col("o.told_classes").alias("told_classes"))
        rows = rows.join(told, "bucket", "left")
        return self.scratch.keep(rows.mapInArrow(lambda it: _rare(it, vocabulary.value, listed, n_classes), NEAR), name)

    def stats(self, near: DataFrame, listed: np.ndarray, name: str) -> DataFrame:
        vocabulary, n_classes = self.vocabulary, self.n_classes
        parts = self.tokens.select("held", "lengths", "ids", "rare").mapInArrow(lambda it: _neighbours(it, vocabulary.value, listed, n_classes), STATS)
        return self.scratch.keep(summed(parts.unionAll(near.where("bucket is null").select("block", "cells", "counts")), STATS_BLOCK * 2 * n_classes), name)

    def run(self, classes: DataFrame, listed: np.ndarray, hashes: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
        """(classes of rare words, classes of listed words, class bigrams) of the likeliest round."""
        best, shares, turn, idle = None, 1, 0, 0
        for k in range(rounds + 1):
            near = self.near(classes, listed, f"near-{k}")
            stats = self.stats(near, listed, f"stats-{k}")
            bigrams = total_bigrams(stats, near.where("bucket is not null"), listed, self.n_classes)
            level, gone = likelihood(bigrams), k
            if best is None or level >= best[0]:
                gain, gone = (level - best[0], best[6]) if best else (np.inf, None)
                best = (level, classes, listed, bigrams, near, stats, k)
                self.levels.append(level)
                idle = idle + 1 if gain < LEAST_GAIN * bigrams.sum() else 0
            else:
                shares, idle = 2 * shares, 0
            if gone is not None:
                self.scratch.drop(f"near-{gone}", f"stats-{gone}", f"classes-{gone}")
            if k == rounds or idle >= shares or shares > MOST_SHARES:
                break
            _, _, listed, bigrams, near, stats, _ = best
            classes = self.scratch.keep(moved_rare(near.where("bucket is not null"), bigrams, turn, shares), f"classes-{k + 1}")
            listed, turn = moved_listed(stats, listed, hashes, bigrams, turn, shares), turn + 1
        self.scratch.drop(f"near-{best[6]}", f"stats-{best[6]}")
        return best[1], best[2], best[3]


def first_classes(state: DataFrame, seeds: dict[int, int], n_classes: int) -> DataFrame:
    """The class of each rare word before the first round: its own if it is a seed, else the last."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = unpacked(batch.column("ids")[row], np.int64)
                classes = np.full(len(ids), n_classes - 1, dtype=np.int8)
                for word, k in seeds.items():
                    classes[ids == word] = k
                yield from kernel.batches(kernel.arrow_schema("bucket long, classes binary"), [{"bucket": [batch.column("bucket")[row].as_py()], "classes": [classes.tobytes()]}])

    return state.select("bucket", "ids").mapInArrow(start, "bucket long, classes binary")


def class_types(classes: DataFrame, listed: np.ndarray, n_classes: int) -> np.ndarray:
    """The number of words of each class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((np.bincount(array(c, np.int8), minlength=n_classes) for b in batches for c in b.column("classes")), np.zeros(n_classes, dtype=np.int64))
        yield from kernel.batches(kernel.arrow_schema("class long, n long"), [{"class": np.arange(n_classes), "n": total}])

    out = np.bincount(listed, minlength=n_classes)
    for row in classes.mapInArrow(count, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        out[row["class"]] += row["n"]
    out[END_CLASS] = 1
    return out


def class_lm_scores(docs: DataFrame, n_classes: int = CLASSES, known_words: int = KNOWN_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """Score every document by unigrams (base_score) and by the class model (score), as log10 probabilities. At most
    127 classes."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "class-lm")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    training = rows.where(~F.col("held_out")).select("text")

    counts = scratch.keep(training.mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    n_end = training.count()
    n_words, n_distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_tokens, n_types = n_words + n_end, n_distinct + (n_end > 0)
    top = most_frequent(counts.where(F.length("word") <= WORD_BYTES), known_words)
    vocabulary = spark.sparkContext.broadcast(Vocabulary([bytes(r["word"]) for r in top], np.array([r["n"] for r in top], dtype=np.int64)))
    end, first_rare = vocabulary.value.end, vocabulary.value.first_rare
    buckets = max(1, -(-int(n_words - vocabulary.value.counts.sum()) // BUCKET_TOKENS))
    del top

    for seed in range(8):
        tokens = scratch.keep(rows.mapInArrow(lambda it, s=seed: _encode(it, vocabulary.value, s), TOKENS), f"tokens-{seed}")
        entries = tokens.select("held", "lengths", "ids", "rare").mapInArrow(lambda it: _entries(it, vocabulary.value, buckets), ENTRIES)
        state = scratch.keep(entries.groupBy("bucket").applyInArrow(lambda t: _bucket(t, first_rare), STATE), f"state-{seed}")
        n_rare = state.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
        if n_rare == n_distinct - end:
            break
        scratch.drop(f"tokens-{seed}", f"state-{seed}")  # two rare words share a number
    else:
        raise RuntimeError("no seed tells all rare words apart")

    # The most frequent words begin in classes of their own, all others together; the end has its class for good.
    seeds = {bytes(r["word"]): k for k, r in enumerate(counts.orderBy(F.desc("n"), "word").limit(n_classes - 2).collect(), 1)}
    scratch.drop("counts")
    listed = np.full(first_rare, END_CLASS, dtype=np.int64)
    listed[:end] = [seeds.get(w, n_classes - 1) for w in vocabulary.value.listed]
    classes = scratch.keep(first_classes(state, {rare_number(w, seed): k for w, k in seeds.items()}, n_classes), "classes-0")
    clustering = Clustering(scratch, tokens, state, vocabulary, buckets, n_classes)
    classes, listed, bigrams = clustering.run(classes, listed, vocabulary.value.hashes(seed), rounds)

    transition = np.log10(smoothed(bigrams))
    share = -np.log10(bigrams.sum(axis=0) + 0.5 * (class_types(classes, listed[:end], n_classes) + 1))
    asked = tokens.select("part", "rare").mapInArrow(lambda it: _asked(it, buckets), "bucket long, part long, wanted binary")
    known = state.select("bucket", "ids", "counts").join(classes, "bucket")
    answers = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_answers, "part long, bucket long, counts binary, classes binary")
    scored = tokens.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(lambda t, a: _score(t, a, vocabulary.value, buckets, listed, transition, share, n_end), SCORES)
    base = F.col("logs") - F.col("n_tokens") * float(np.log10(n_tokens + 0.5 * (n_types + 1)))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
