"""Quality classifier: a generalised additive model with pairwise interactions.

Features come from one vectorised pass over whole texts. Cyclic boosting fits shallow trees on one feature at a time,
each added to that feature's lookup table over quantile bins; trees over pairs of coarse bins follow on what is left.
A score is the logistic of a sum of table entries.

Learning reads labels of rows outside the held-out fold, at most ``max_rows`` of them (chosen by a hash of doc_id, a
documented bound: 20,000 rows x 16 features reach the driver). Everything is scored.

Defined results. Null text is an empty text and gets a score. Null labels are not learnt from; of repeated labels of a
document the smallest counts, of different texts with one doc_id that with the smallest features. Repeated rows get one result row each. Without both label values to learn from, the
score is the mean label (0.5 if there is none). Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedgraph.llm import kernel
from feedgraph.llm.quality_rules import covered_words, occurrences

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3

UPPER, LOWERCASE, DIGIT, PUNCTUATION, SYMBOL, BANG, BAR = (np.zeros(256, dtype=bool) for _ in range(7))
UPPER[0x41:0x5B] = LOWERCASE[0x61:0x7B] = DIGIT[0x30:0x3A] = True
PUNCTUATION[list(b".,;:?'\"()-")] = True
SYMBOL[list(b"#*$%&<>@^~\\/_=+{}[]")] = True
BANG[list(b"!")] = BAR[list(b"|")] = True

FEATURES = ("log_words", "word_length", "upper", "digits", "punctuation", "symbols", "bangs", "bars", "wide_bytes", "distinct_words", "repeat_words", "repeat_lines", "line_length", "short_words", "long_words", "line_starts")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a chunk."""
    n = len(offsets) - 1
    starts, ends, owner = kernel.word_spans(data, offsets)
    words = kernel.span_hashes(data, starts, ends)
    count = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])
    n_words = np.bincount(owner, minlength=n)
    per_word, per_byte = 1 / np.maximum(n_words, 1), 1 / np.maximum(np.diff(offsets), 1)
    length = ends - starts
    _, later = occurrences(owner, words)
    newline = data == 0x0A
    n_lines = count(newline) + 1
    breaks = np.flatnonzero(newline)
    line_start, line_owner = np.concatenate((offsets[:-1], breaks + 1)), np.concatenate((np.arange(n), np.searchsorted(offsets, breaks, side="right") - 1))
    order = np.lexsort((line_start, line_owner))  # an empty last line starts where the next text does
    line_start, line_owner = line_start[order], line_owner[order]
    line_end = np.minimum(np.concatenate((line_start[1:], [len(data)])), offsets[line_owner + 1]) if n else line_start
    _, line_later = occurrences(line_owner, kernel.span_hashes(data, line_start, line_end))
    marked = lambda mask: np.bincount(owner[mask], minlength=n)
    out = np.empty((n, len(FEATURES)))
    for i, column in enumerate((
        np.log1p(n_words), np.bincount(owner, weights=length, minlength=n) * per_word, count(UPPER[data]) * per_byte, count(DIGIT[data]) * per_byte,
        count(PUNCTUATION[data]) * per_word, count(SYMBOL[data]) * per_word, count(BANG[data]) * per_word, count(BAR[data]) * per_word, count(data >= 0x80) * per_byte,
        1 - marked(later) * per_word, marked(covered_words(owner, words, 6)) * per_word, np.bincount(line_owner[line_later], minlength=n) / np.maximum(n_lines, 1),
        n_words / np.maximum(n_lines, 1), marked(length <= 2) * per_word, marked(length >= 12) * per_word, n_lines * per_word,
    )):
        out[:, i] = column
    return out


def leaves(grad: np.ndarray, hess: np.ndarray, ridge: float, depth: int = 2) -> np.ndarray:
    """The step of a shallow tree for each of some ordered bins, given sums of gradients and curvatures in them."""
    step = np.full(len(grad), grad.sum() / (hess.sum() + ridge))
    if depth and len(grad) > 1:
        left_g, left_h = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
        right_g, right_h = grad.sum() - left_g, hess.sum() - left_h
        gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge)
        cut = int(np.argmax(gain)) + 1
        if gain[cut - 1] > grad.sum() ** 2 / (hess.sum() + ridge):
            step = np.concatenate((leaves(grad[:cut], hess[:cut], ridge, depth - 1), leaves(grad[cut:], hess[cut:], ridge, depth - 1)))
    return step


@dataclass
class AdditiveModel:
    """Lookup tables over bins: one for each feature, and one for each chosen pair of features (coarse bins)."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def cuts(column: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(column, np.arange(1, bins) / bins))

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.15, bins: int = 48, n_pairs: int = 6, ridge: float = 5.0) -> AdditiveModel:
        if not len(y):
            return self
        rate_1 = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(rate_1 / (1 - rate_1)))
        if y.min() == y.max():
            return self
        logit = np.full(len(y), self.base)
        self.edges = [self.cuts(c, bins) for c in x.T]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        at = [np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)]
        for _ in range(rounds):
            for k, table in enumerate(self.tables):
                p = 1 / (1 + np.exp(-logit))
                step = rate * leaves(np.bincount(at[k], y - p, len(table)), np.bincount(at[k], p * (1 - p), len(table)), ridge)
                table += step
                logit += step[at[k]]
        self.coarse = [self.cuts(c, 8) for c in x.T]
        near = [np.searchsorted(e, c, side="right") for e, c in zip(self.coarse, x.T, strict=True)]
        p = 1 / (1 + np.exp(-logit))
        ranked = []
        for i in range(x.shape[1]):
            for j in range(i):
                cell = near[i] * 8 + near[j]
                g, h = np.bincount(cell, y - p, 64), np.bincount(cell, p * (1 - p), 64)
                ranked.append((float((g**2 / (h + ridge)).sum()), i, j))
        self.pairs = [(i, j) for _, i, j in sorted(ranked, reverse=True)[:n_pairs]]
        self.grids = [np.zeros((8, 8)) for _ in self.pairs]
        for _ in range(rounds // 3):
            for (i, j), grid in zip(self.pairs, self.grids, strict=True):
                p = 1 / (1 + np.exp(-logit))
                cell = near[i] * 8 + near[j]
                step = rate * self.quadrants(np.bincount(cell, y - p, 64).reshape(8, 8), np.bincount(cell, p * (1 - p), 64).reshape(8, 8), ridge)
                grid += step
                logit += step[near[i], near[j]]
        return self

    @staticmethod
    def quadrants(grad: np.ndarray, hess: np.ndarray, ridge: float) -> np.ndarray:
        """The step of a tree with one cut on either feature of a pair."""
        best, out = -1.0, np.zeros_like(grad)
        for a in range(1, 8):
            for b in range(1, 8):
                parts = [(slice(*r), slice(*c)) for r in ((0, a), (a, 8)) for c in ((0, b), (b, 8))]
                sums = [(grad[q].sum(), hess[q].sum() + ridge) for q in parts]
                if (gain := sum(g * g / h for g, h in sums)) > best:
                    best, out = gain, np.zeros_like(grad)
                    for q, (g, h) in zip(parts, sums, strict=True):
                        out[q] = g / h
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            logit += table[np.searchsorted(edges, x[:, k], side="right")]
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            logit += grid[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-logit))


def fold(column: str = "doc_id") -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = kernel.arrow_schema("doc_id long, quality int, " + ", ".join(f"{f} double" for f in FEATURES))
    for batch in batches:
        for first, data, offsets in kernel.byte_chunks(batch.column("text")):
            own = batch.slice(first, len(offsets) - 1)
            x = features(data, offsets)
            yield from kernel.batches(schema, [{"doc_id": own.column("doc_id"), "quality": own.column("quality")} | dict(zip(FEATURES, x.T, strict=True))])


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> AdditiveModel:
    """Fit on at most max_rows labelled documents outside the held-out fold."""
    sample = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold() != HELD_OUT))
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_rows)
    )
    learnt = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most max_rows small rows
    schema = "doc_id long, quality int, " + ", ".join(f"{f} double" for f in FEATURES)
    rows = learnt.select("doc_id", "quality", "text").mapInArrow(_features, schema)
    # One row a document before anything is collected, however often it is repeated.
    rows = rows.groupBy("doc_id", "quality").agg(F.min(F.struct(*FEATURES)).alias("x")).select("doc_id", "quality", "x.*").toPandas().sort_values("doc_id")
    return AdditiveModel().fit(rows[list(FEATURES)].to_numpy(), (rows["quality"].to_numpy() > 0).astype(float))


def quality_gam(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, threshold: float = THRESHOLD) -> DataFrame:
    """Score every document by a model learnt from the labels outside the held-out fold."""
    model = fit_quality(docs, labels, max_rows)
    schema = kernel.arrow_schema("doc_id long, held_out boolean, score double, predicted int")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in kernel.byte_chunks(batch.column("text")):
                own = batch.slice(first, len(offsets) - 1)
                s = model.scores(features(data, offsets))
                yield from kernel.batches(schema, [{"doc_id": own.column("doc_id"), "held_out": own.column("held_out"), "score": s, "predicted": (s >= threshold).astype(np.int32)}])

    return docs.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "text").mapInArrow(score, SCHEMA)


def drop_low_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that the model does not reject."""
    model = fit_quality(docs, labels, max_rows)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in kernel.byte_chunks(batch.column("text")):
                yield batch.slice(first, len(offsets) - 1).filter(pa.array(model.scores(features(data, offsets)) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
