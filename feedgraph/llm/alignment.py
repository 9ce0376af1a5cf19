"""Alignment of two tokenizers' tokens by diagonal run skipping, and counts of the id pairs that they link.

A text is encoded by a byte-level tokenizer (A) and by a sentence-piece tokenizer (B); the tokens' byte ends are two
rising arrays. From a place where both end together, the arrays are compared at the current index shift over windows
that double while they are equal, and the first difference is found by halving: a stretch of one-to-one groups costs a
logarithm of its length in comparisons. At a difference both arrays are walked until they meet again; the tokens walked
over are one irregular group, and its size changes the shift.

Both tokenizers split before a single space between characters that are no white space, so tokens of both end there and no
group crosses it. What lies between such places is encoded and aligned when it is new (thousands of parts end to end in one
pair of arrays) and then looked up in a bounded cache; a document is the sequence of its parts.

How many documents hold a pair is counted by Spark. The commonest pairs, 2^17 at most, are sent to all tasks; the others,
each of which is in few documents by comparison, meet their counts in a join, so no join key is hot. The number of
A ids bounds the table of each A id's highest count.

Defined results. Null and empty texts, and texts that one tokenizer doesn't give back byte by byte, have no tokens:
zeros and an empty digest. Each row is a document of its own, also where rows repeat or share a doc_id, or have none.
Extra columns are ignored. An empty table gives an empty result. Memory is bounded by the longest text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedgraph.llm import kernel
from feedgraph.llm.scratch import Scratch

CHUNK, CACHE_BYTES, KNOWN_PAIRS = 1 << 19, 160 << 20, 1 << 17
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"
MET = "row long, n_best long, count_sum long, pairs array<long>, times array<int>"

TOGETHER, UNBROKEN = 4000, 512  # parts at once; bytes of a part
BLOCK = "▁".encode()  # the sign that pieces have for a space

#: Where a byte-level tokenizer splits before it merges (a fixed value of its format).
SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes that can follow a splitting space: ASCII signs, and first bytes of letters of alphabets without white space.
FOLLOWS = np.zeros(256, dtype=bool)
FOLLOWS[[*range(0x21, 0x7F), *range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: a printable byte is its own character, the others
    are the characters from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Ragged:
    """Arrays of one type end to end, appended to by doubling."""

    def __init__(self) -> None:
        self.flat, self.ends = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
        self.n = 0

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Append arrays that lie end to end."""
        start = int(self.ends[self.n])
        while len(self.ends) < self.n + len(sizes) + 1:
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        while len(self.flat) < start + len(flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[start : start + len(flat)] = flat
        self.ends[self.n + 1 : self.n + 1 + len(sizes)] = start + np.cumsum(sizes)
        self.n += len(sizes)

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen arrays end to end, and their sizes."""
        starts = self.ends[which]
        sizes = self.ends[which + 1] - starts
        before = np.cumsum(sizes) - sizes
        return self.flat[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))], sizes


class Encoders:
    """Both tokenizers' ids of texts that begin with a space.

    A's ids come from an engine without the offsets that nobody asks for, made from A's own vocabulary; unbroken
    stretches, for which it would take long, go to A's own."""

    def __init__(self, path_a: str, path_b: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True  # their strings are plain text
        letters = byte_letters()
        plain = {bytes(letters[c] for c in token): i for token, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in letters for c in token)}
        self.fast = Encoding("a", pat_str=SPLITS, mergeable_ranks=plain, special_tokens={})
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = token.encode()
        for token, i in plain.items():
            self.bytes_a[i] = token
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.length_a, self.length_b = (np.fromiter(map(len, t), dtype=np.int64) for t in (self.bytes_a, self.bytes_b))

    def encode(self, text: str, unbroken: bool) -> tuple[list[int], list[int]]:
        ids = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids if unbroken else self.fast.encode_ordinary(text)
        return ids, self.b.encode(text[1:])

    def joined(self, ids_a: list[int], ids_b: list[int]) -> tuple[bytes, bytes]:
        return b"".join(map(self.bytes_a.__getitem__, ids_a)), b"".join(map(self.bytes_b.__getitem__, ids_b))


@lru_cache(1)
def loaded(path_a: str, path_b: str) -> Encoders:
    """A worker reads the vocabularies once."""
    return Encoders(path_a, path_b)


class Aligned:
    """Aligned parts of texts, in a bounded cache: what each has of tokens, groups, linked pairs, and its written form."""

    def __init__(self, encoders: Encoders) -> None:
        self.enc = encoders
        n_a, n_b = len(encoders.bytes_a), len(encoders.bytes_b)
        self.n_a, self.n_b, self.bits = n_a, n_b, n_b.bit_length()
        self.written = [f"{i}{end}" for n, ends in ((n_a, ",|"), (n_b, ",;\n")) for end in ends for i in range(n)]
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.forms: list[str] = []
        self.pairs, self.counts, self.broken, self.held = Ragged(), np.zeros((1024, 3), dtype=np.int64), [], 0

    def learn(self, parts: list[bytes]) -> None:
        """Parts that begin and end as splitting places ask for go to the tokenizers, and are aligned, many at once: laid end
        to end they are split where one begins. The others go one by one."""
        plain = [p for p in parts if 1 < len(p) <= UNBROKEN and FOLLOWS[p[1]] and p[-1] != 0x20 and BLOCK not in p]
        for at in range(0, len(plain), TOGETHER):
            self._learn(plain[at : at + TOGETHER])
        for p in parts:
            if p not in self.index and not self._learn([p]):
                self.broken.append(len(self.index))
                self._add([p], np.zeros((1, 3), dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64), [""])

    def _learn(self, parts: list[bytes]) -> bool:
        """False if the parts' bytes don't come back."""
        whole = b"".join(parts)
        ids = self.enc.encode(whole.decode("utf-8", "replace"), len(parts) == 1 and len(whole) > UNBROKEN)
        if self.enc.joined(*ids) != (whole, whole):
            return False
        ids_a, ids_b = (np.array(x, dtype=np.int64) for x in ids)
        ends_a, ends_b = np.cumsum(self.enc.length_a[ids_a]), np.cumsum(self.enc.length_b[ids_b])
        link_a, link_b, group_a, group_b = align(ends_a, ends_b)
        stops = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64))
        of_a, of_b, of_group = (np.diff(np.searchsorted(ends, stops, side="right"), prepend=0) for ends in (ends_a, ends_b, ends_a[group_a - 1]))

        # Each token's place in the written form: after the other side's tokens of earlier groups (A), of groups up to its own (B).
        codes = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        last_a, last_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
        last_a[group_a - 1], last_b[group_b - 1] = 1, 1
        last_b[np.cumsum(of_b) - 1] = 2
        earlier_b, upto_a = np.concatenate(([0], group_b)), group_a
        codes[np.arange(len(ids_a)) + earlier_b[np.cumsum(last_a) - last_a]] = ids_a + self.n_a * last_a
        codes[np.arange(len(ids_b)) + upto_a[np.cumsum(last_b > 0) - (last_b > 0)]] = ids_b + self.n_b * last_b + 2 * self.n_a
        forms = "".join(map(self.written.__getitem__, codes.tolist())).split("\n")[:-1]

        order = np.argsort(link_a, kind="stable")
        links = np.diff(np.searchsorted(link_a[order], np.cumsum(of_a)), prepend=0)
        self._add(parts, np.stack((of_a, of_b, of_group), axis=1), ((ids_a[link_a] << self.bits) | ids_b[link_b])[order], links, forms)
        return True

    def _add(self, parts: list[bytes], counts: np.ndarray, pairs: np.ndarray, links: np.ndarray, forms: list[str]) -> None:
        at = len(self.index)
        self.index.update(zip(parts, range(at, at + len(parts)), strict=True))
        while len(self.counts) < at + len(parts):
            self.counts = np.concatenate((self.counts, np.zeros_like(self.counts)))
        self.counts[at : at + len(parts)] = counts
        self.pairs.extend(pairs, links)
        self.forms += forms
        self.held += sum(map(len, parts)) + sum(map(len, forms)) + 8 * len(pairs) + 400 * len(parts)

    def align(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of texts end to end: tokens of A, of B and groups (a row a text), written forms, and all linked pairs with their
        text's number. Nothing of texts whose bytes don't come back."""
        split = np.zeros(len(data) + 1, dtype=bool)
        split[1 : len(data) - 1] = (data[1:-1] == 0x20) & (data[:-2] != 0x20) & FOLLOWS[data[2:]]
        split[offsets] = True
        cuts = np.flatnonzero(split)
        raw = data.tobytes()
        parts = [raw[s:e] for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        if self.held > CACHE_BYTES:
            self.clear()
        if fresh := [p for p in dict.fromkeys(parts) if p not in self.index]:
            self.learn(fresh)
        which = np.fromiter(map(self.index.__getitem__, parts), dtype=np.int64, count=len(parts))
        docs = len(offsets) - 1
        owner = np.searchsorted(offsets, cuts[:-1], side="right") - 1
        if self.broken:
            spoilt = np.isin(owner, owner[np.isin(which, self.broken)])
            which, owner = which[~spoilt], owner[~spoilt]
        counts = np.stack([np.bincount(owner, self.counts[which, c], minlength=docs) for c in range(3)], axis=1).astype(np.int64)
        at = np.searchsorted(owner, np.arange(docs + 1)).tolist()
        chosen = which.tolist()
        forms = [";".join(map(self.forms.__getitem__, chosen[s:e])) for s, e in zip(at[:-1], at[1:], strict=True)]
        pairs, links = self.pairs.gather(which)
        return counts, forms, pairs, np.repeat(owner, links)


def diagonal_runs(a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int], list[int], list[int], list[int], list[int]]:
    """Of two rising arrays of ends with the same last one: runs of one-to-one groups (first index in a, in b, length),
    the index pairs walked over in irregular groups, and where each of these groups stops in a and b."""
    run_a, run_b, run_n, walk_a, walk_b, stop_a, stop_b = [], [], [], [], [], [], []
    i = j = 0
    n = len(a)
    while i < n:
        if a[i] == b[j]:
            start, shift, width = i, j - i, 1
            i += 1
            while i < n and a[i : i + width] == b[i + shift : i + shift + width]:
                i += width
                width += width
            if i < n:
                while width > 1:  # the first difference is among the next width
                    width >>= 1
                    if a[i : i + width] == b[i + shift : i + shift + width]:
                        i += width
            else:
                i = n
            run_a.append(start)
            run_b.append(start + shift)
            run_n.append(i - start)
            j = i + shift
            continue
        x, y = a[i], b[j]
        while True:
            walk_a.append(i)
            walk_b.append(j)
            if x < y:
                i += 1
                x = a[i]
            elif y < x:
                j += 1
                y = b[j]
            else:
                break
        i += 1
        j += 1
        stop_a.append(i)
        stop_b.append(j)
    return run_a, run_b, run_n, walk_a, walk_b, stop_a, stop_b


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Linked index pairs (of A, of B), in no order, and how far the groups go in A and B, in order."""
    found = diagonal_runs(ends_a.tolist(), ends_b.tolist())
    run_a, run_b, run_n, walk_a, walk_b, stop_a, stop_b = (np.array(x, dtype=np.int64) for x in found)
    along = np.arange(int(run_n.sum())) - np.repeat(np.cumsum(run_n) - run_n, run_n)
    one_a, one_b = np.repeat(run_a, run_n) + along, np.repeat(run_b, run_n) + along
    group_a, group_b = np.sort(np.concatenate((one_a + 1, stop_a))), np.sort(np.concatenate((one_b + 1, stop_b)))
    return np.concatenate((one_a, walk_a)), np.concatenate((one_b, walk_b)), group_a, group_b


def _aligned(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    parts, schema = Aligned(loaded(path_a, path_b)), kernel.arrow_schema(ALIGNED)
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        for first, data, offsets in kernel.byte_chunks(batch.column("text"), CHUNK):
            docs = len(offsets) - 1
            some = np.flatnonzero(offsets[1:] > offsets[:-1])
            spaced, starts = np.insert(data, offsets[some], 0x20), np.append(offsets[some] + np.arange(len(some)), len(data) + len(some))
            counts, forms = np.zeros((docs, 3), dtype=np.int64), np.full(docs, "", dtype=object)
            pairs = owner = np.zeros(0, dtype=np.int64)
            if len(some):
                counts[some], forms[some], pairs, owner = parts.align(spaced, starts)
                owner = some[owner]
            keys, times = np.unique((owner << 40) | pairs, return_counts=True)
            at = pa.array(np.searchsorted(keys >> 40, np.arange(docs + 1)), type=pa.int32())
            yield from kernel.batches(schema, [{
                "row": row + np.arange(docs), "doc_id": batch.column("doc_id").slice(first, docs), "n_a": counts[:, 0], "n_b": counts[:, 1], "n_groups": counts[:, 2],
                "n_links": np.bincount(owner, minlength=docs), "groups": forms.tolist(), "pairs": pa.ListArray.from_arrays(at, pa.array(keys & ((1 << 40) - 1))),
                "times": pa.ListArray.from_arrays(at, pa.array(times.astype(np.int32))),
            }])
            row += docs
    kernel.release()


def align_tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Each document's alignment: row (its number), doc_id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`),
    and its distinct linked id pairs (as one number: A's id before B's, see pair_ids) with how often each is linked."""
    return docs.select("doc_id", "text").mapInArrow(lambda it: _aligned(it, path_a, path_b), ALIGNED)


def pair_bits(path_b: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path_b).get_piece_size().bit_length()


def pair_counts(aligned: DataFrame, bits: int) -> DataFrame:
    """pair, n (documents that hold it), and best: n is the highest among the pairs of its A id."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    return counts.withColumn("a", F.shiftright("pair", bits))


def _met(batches: Iterator[pa.RecordBatch], known: object) -> Iterator[pa.RecordBatch]:
    pairs, n, best = known.value
    schema = kernel.arrow_schema(MET)
    for batch in batches:
        lists = batch.column("pairs")
        own, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        at = np.searchsorted(pairs, own)
        found = np.zeros(len(own), dtype=bool)
        inside = at < len(pairs)
        found[inside] = pairs[at[inside]] == own[inside]
        sums = [np.zeros(batch.num_rows, dtype=np.int64) for _ in range(2)]
        for total, value in zip(sums, (best, n), strict=True):
            np.add.at(total, owner[found], times[found] * value[at[found]])
        rest = np.concatenate(([0], np.cumsum(np.bincount(owner[~found], minlength=batch.num_rows))))
        left = [pa.ListArray.from_arrays(pa.array(rest, type=pa.int32()), pa.array(x)) for x in (own[~found], times[~found].astype(np.int32))]
        yield from kernel.batches(schema, [{"row": batch.column("row"), "n_best": sums[0], "count_sum": sums[1], "pairs": left[0], "times": left[1]}])


def with_counts(aligned: DataFrame, scratch: Scratch, bits: int, known_pairs: int = KNOWN_PAIRS) -> DataFrame:
    """Adds n_best and count_sum to a kept table of alignments, and leaves out its pairs."""
    counts = scratch.keep(pair_counts(aligned, bits), "counts")
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    counts = scratch.keep(counts.join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "judged")  # as many rows as A has ids

    # The least count of the pairs that all tasks get, from a histogram of 16 steps an octave.
    step = F.floor(F.log2("n") * 16)
    steps = sorted(((r["step"], r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)
    total, least = 0, None
    for at, some in steps:
        total += some
        if total > known_pairs:
            break
        least = at
    common = counts.where(step >= F.lit(least)) if least is not None else counts.where("false")
    arrays = common.orderBy("pair").toArrow()
    known = aligned.sparkSession.sparkContext.broadcast((arrays.column("pair").to_numpy(), arrays.column("n").to_numpy(), arrays.column("best").to_numpy(zero_copy_only=False).astype(np.int64)))
    met = scratch.keep(aligned.select("row", "pairs", "times").mapInArrow(lambda it: _met(it, known), MET), "met")

    rest = met.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("times"))
    rare = counts if least is None else counts.where(step < F.lit(least))
    sums = rest.join(rare, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    met = met.select("row", "n_best", "count_sum").join(sums, "row", "left")
    total = met.select("row", *[(F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))])
    return aligned.drop("pairs", "times").join(total, "row")


def cross_alignment(docs: DataFrame, path_a: str, path_b: str, known_pairs: int = KNOWN_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    scratch = Scratch(docs.sparkSession, "alignment")
    digest = F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise("")
    aligned = scratch.keep(align_tokens(docs, path_a, path_b).withColumn("groups_sha256", digest).drop("groups"), "aligned")
    found = with_counts(aligned, scratch, pair_bits(path_b), known_pairs)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
