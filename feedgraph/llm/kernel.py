"""Vectorised text kernels shared by the corpus operators.

Each kernel works on a *chunk*: the UTF-8 bytes of several whole texts laid end to end, with the offsets where each
text starts. A chunk is at most ``CHUNK_BYTES`` long unless a single text is longer, so memory is bounded by the
longest text and never by the Arrow batch or the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

#: Odd multipliers of the rolling hashes (fixed values).
BASE = 0x9E3779B97F4A7C15
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def text_array(column: pa.Array) -> pa.Array:
    """The column as large strings without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def byte_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts; offsets has one more entry than the run has texts."""
    texts = text_array(column)
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    values = values ^ (values >> np.uint64(30))
    values = values * MIX_1
    values ^= values >> np.uint64(27)
    values *= MIX_2
    values ^= values >> np.uint64(31)
    return values


class Powers:
    """Powers of BASE and of its inverse modulo 2^64, grown as longer chunks come."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            self.up = _powers(BASE, size)
            self.down = _powers(pow(BASE, -1, 1 << 64), size)
        return self.up, self.down


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


POWERS = Powers()


#: Prime modulus and bases of the rolling hash of spans (fixed values). A power of two as modulus would give equal
#: values to some strings of 2,048 bytes whatever the base.
PRIME, BASES = 2**31 - 1, (1_191_785_641, 748_932_582)
REDUCE_EVERY = 1 << 22


class PrimePowers:
    """Powers of a base and of its inverse modulo PRIME, grown as longer chunks come."""

    def __init__(self, base: int) -> None:
        self.bases = base, pow(base, -1, PRIME)
        self.tables = [np.ones(1, dtype=np.int64), np.ones(1, dtype=np.int64)]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.tables[0]) < n:
            self.tables = [_prime_powers(b, max(n, CHUNK_BYTES + 1)) for b in self.bases]
        return self.tables[0], self.tables[1]


def _prime_powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.int64)
    size = 1
    while size < n:
        more = min(size, n - size)
        out[size : size + more] = out[:more] * pow(base, size, PRIME) % PRIME
        size += more
    return out


PRIME_POWERS = tuple(PrimePowers(b) for b in BASES)


def _residues(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: PrimePowers, wide: bool = False) -> np.ndarray:
    """Of each span of values (bytes, or wide: below PRIME): its polynomial modulo PRIME. Sums are reduced before they
    can overflow."""
    up, down = powers.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.int64)
    carry = 0
    for at in range(0, len(values), REDUCE_EVERY):
        part = sums[at + 1 : at + 1 + REDUCE_EVERY]
        terms = values[at : at + REDUCE_EVERY] * up[at : at + len(part)]
        np.cumsum(terms % PRIME if wide else terms, out=part)
        part += carry
        if len(values) > REDUCE_EVERY:
            part %= PRIME
            carry = int(part[-1])
    return (sums[ends] - sums[starts]) % PRIME * down[starts] % PRIME


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rolling-hash value of symbols[start:end] for each span of bytes, by rising start; equal spans have equal values
    wherever they lie. More than a chunk is hashed piece by piece, so neither arrays nor kept powers grow with it."""
    out = np.zeros(len(starts), dtype=np.uint64)
    piece = CHUNK_BYTES // 2 if len(symbols) > CHUNK_BYTES else CHUNK_BYTES  # spans begin in a piece and may end behind it
    cuts = [0, *np.searchsorted(starts, np.arange(piece, len(symbols), piece)).tolist(), len(starts)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            low, high = int(starts[a:b].min()), int(ends[a:b].max())
            values = symbols[low:high].astype(np.int64)
            values += 1
            first, second = (_residues(values, starts[a:b] - low, ends[a:b] - low, p).astype(np.uint64) for p in PRIME_POWERS)
            out[a:b] = mix(((first << np.uint64(31)) | second) + (ends[a:b] - starts[a:b]).astype(np.uint64) * np.uint64(BASE))
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every maximal run of non-white bytes; runs end where their text ends."""
    inside = ~white[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data) + 1, dtype=bool)
    before[0] = False
    before[1:] = inside
    after = np.empty(len(data) + 1, dtype=bool)
    after[-1] = False
    after[:-1] = inside
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    owner = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, owner


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive word hashes (len(words) - n + 1 of them), blind to text borders."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    starts = np.arange(len(words) - n + 1)
    first, second = (
        _residues(((words >> np.uint64(shift)) % np.uint64(PRIME)).astype(np.int64), starts, starts + n, p, True).astype(np.uint64) for shift, p in zip((0, 31), PRIME_POWERS, strict=True)
    )
    return mix(((first << np.uint64(31)) | second) + np.uint64(n << 56))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct n-word shingle hashes after lower-casing A-Z; a shorter text that has words
    is one shingle, a text without words has none."""
    data = LOWER[data]
    starts, ends, owner = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    windows = window_hashes(words, n)
    first = np.searchsorted(owner, np.arange(len(offsets)), side="left")
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(windows[a : b - n + 1]))
        else:
            out.append(window_hashes(words[a:b], b - a) if b > a else np.zeros(0, dtype=np.uint64))
    return out


def batches(schema: pa.Schema, rows: Iterable[dict[str, object]]) -> Iterator[pa.RecordBatch]:
    """Record batches of the schema from dictionaries of equally long columns."""
    for columns in rows:
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def release() -> None:
    """Give freed memory back to the system, so that a worker that serves task after task stays small."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def _trimmer() -> Callable[[int], object]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # a C library without it
        return lambda _: None


_trim = _trimmer()


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a Spark DDL string of plain types."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])
