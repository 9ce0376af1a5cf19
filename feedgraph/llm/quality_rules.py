"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths mark the n-grams that occur twice or more in a text; the measure is the share
of word characters inside them (and inside repeated lines). One pass over the documents, no shuffle.

Defined results. Null text: no words, fails the base rule. Extra columns are ignored. Repeated rows are judged alike,
one result row each. An empty table gives an empty result. Null doc_id is kept as null. Texts of any length are
measured whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from feedgraph.llm import kernel

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: Largest share of word characters inside repeated n-grams, by n-gram length in words.
MAX_COVERAGE = {5: 0.20, 8: 0.20, 10: 0.20}
MAX_LINE_COVERAGE = 0.20
MAX_SYMBOLS_PER_WORD = 0.10
MIN_WORDS, MAX_REPEAT_PERCENT, BASE_WINDOW = 20, 30, 8

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "dup_line_chars long, " + ", ".join(f"rep{n}_chars long" for n in MAX_COVERAGE)
)


def occurrences(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each hash within its owner: does it occur twice or more, and is there an earlier one?"""
    key = kernel.mix(hashes + owner.astype(np.uint64) * np.uint64(kernel.BASE))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later = np.concatenate(([False], same)) if len(key) else np.zeros(0, dtype=bool)
    twice = later | np.concatenate((same, [False])) if len(key) else later
    out = np.zeros((2, len(key)), dtype=bool)
    out[0, order], out[1, order] = twice, later
    return out[0], out[1]


def covered_words(owner: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Marks the words inside n-word windows that occur twice or more in their text."""
    marks = np.zeros(len(words) + 1, dtype=np.int8)
    if len(words) >= n:
        inside = np.flatnonzero(owner[n - 1 :] == owner[: len(owner) - n + 1])
        twice, _ = occurrences(owner[inside], kernel.window_hashes(words, n)[inside])
        marks[inside[twice]] += 1
        marks[inside[twice] + n] -= 1
    return np.cumsum(marks, dtype=np.int64)[:-1] > 0


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The rule inputs of every text of a chunk."""
    n = len(offsets) - 1
    starts, ends, owner = kernel.word_spans(data, offsets)
    words = kernel.span_hashes(data, starts, ends)
    solid = np.concatenate(([0], np.cumsum(~kernel.WHITE[data] & ((data & 0xC0) != 0x80))))
    symbols = np.concatenate(([0], np.cumsum(SYMBOLS[data])))
    chars = solid[ends] - solid[starts]
    per_text = lambda marks, weights=None: np.bincount(owner[marks], weights=None if weights is None else weights[marks], minlength=n).astype(np.int64)

    breaks = np.flatnonzero(data == 0x0A)
    line_starts = np.concatenate((offsets[:-1], breaks + 1))
    line_owner = np.concatenate((np.arange(n), np.searchsorted(offsets, breaks, side="right") - 1))
    # The empty last line of a text that ends in a newline starts where the next text does, and comes before it.
    order = np.lexsort((line_starts, line_owner))
    line_starts, line_owner = line_starts[order], line_owner[order]
    line_ends = np.empty_like(line_starts)
    line_ends[:-1] = np.where(line_owner[1:] == line_owner[:-1], line_starts[1:] - 1, offsets[line_owner[:-1] + 1])
    line_ends[-1:] = offsets[-1]
    wordy = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_owner = line_starts[wordy], line_ends[wordy], line_owner[wordy]
    line_hash = kernel.span_hashes(data, line_starts, line_ends)
    line_twice, line_later = occurrences(line_owner, line_hash)

    covered = {k: covered_words(owner, words, k) for k in {BASE_WINDOW, *MAX_COVERAGE}}
    out = {
        "n_words": np.bincount(owner, minlength=n).astype(np.int64),
        "word_chars": per_text(slice(None), chars),
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": np.bincount(line_owner[line_later], minlength=n).astype(np.int64),
        "n_repeat_words": per_text(covered[BASE_WINDOW]),
        "dup_line_chars": np.bincount(line_owner[line_twice], weights=(solid[line_ends] - solid[line_starts])[line_twice], minlength=n).astype(np.int64),
    }
    return out | {f"rep{k}_chars": per_text(covered[k], chars) for k in MAX_COVERAGE}


def verdict(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    good = (m["dup_line_chars"] <= MAX_LINE_COVERAGE * m["word_chars"]) & (m["n_symbols"] <= MAX_SYMBOLS_PER_WORD * m["n_words"])
    for n, most in MAX_COVERAGE.items():
        good &= m[f"rep{n}_chars"] <= most * m["word_chars"]
    return m | {"base_failed": failed, "kept": ~failed & good}


def _score(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in kernel.byte_chunks(batch.column("text")):
            ids = batch.column("doc_id").slice(first, len(offsets) - 1)
            yield from kernel.batches(schema, [verdict(measure(data, offsets)) | {"doc_id": ids}])


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document with the measures, the base verdict and the verdict by repetition coverage."""
    schema = kernel.arrow_schema(SCHEMA)
    return docs.select("doc_id", "text").mapInArrow(lambda it: _score(it, schema), SCHEMA)
