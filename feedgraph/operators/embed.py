"""Texts to vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType, StructField, StructType

from feedgraph.functions.columns import has_text
from feedgraph.schemas import DIMENSION, VECTOR_BATCH

Encoder = Callable[[Sequence[str]], np.ndarray]


WORDS = 1 << 18  # counted at once


@lru_cache(1 << 16)
def _hash(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16)


def _hashed(words: pa.Array, dimension: int) -> pa.Array:
    """Of each list of words a vector of counts by hash bucket, of length one; null without words. Rows are taken as many at
    a time as hold a bounded number of words."""
    counts = np.zeros((len(words), dimension))
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
    ends, at = np.cumsum(lengths), 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - lengths[at] + WORDS, side="right")))
        flat = words.slice(at, to - at).flatten().dictionary_encode()
        buckets = np.array([_hash(w) % dimension if w else -1 for w in flat.dictionary.to_pylist()], dtype=np.int64)
        row = np.repeat(np.arange(to - at), lengths[at:to])
        bucket = buckets[flat.indices.to_numpy()] if len(row) else np.zeros(0, dtype=np.int64)
        good = bucket >= 0
        counts[at:to] = np.bincount(row[good] * dimension + bucket[good], minlength=(to - at) * dimension).reshape(to - at, dimension)
        at = to
    norms = np.sqrt((counts * counts).sum(axis=1))
    counts /= np.maximum(norms, 1)[:, None]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * dimension, type=pa.int32()), pa.array(counts.ravel()), mask=pa.array(norms == 0))


def with_hash_vectors(texts: DataFrame, text: str, dimension: int = DIMENSION) -> DataFrame:
    """Adds vector (double), computed in the row: neither shuffle nor join. Null where a text has no words. Only words go to
    Python; the row's other columns stay behind. (Said to be non-deterministic, so that filters don't compute it twice.)"""

    def hashed(words: pa.Array) -> pa.Array:
        return _hashed(words, dimension)

    vector = F.arrow_udf(hashed, ArrayType(DoubleType())).asNondeterministic()
    return texts.withColumn("vector", vector(F.split(F.lower(text), r"[^\p{L}\p{N}]+")))


def hash_vectors(texts: DataFrame, key: str, text: str, dimension: int = DIMENSION) -> DataFrame:
    """key, vector (double) of every text that has words: L2-normalised bucket counts."""
    return with_hash_vectors(texts.select(key, text), text, dimension).select(key, "vector").where("vector is not null")


def encode(texts: DataFrame, encoder: Callable[[], Encoder], dimension: int, text: str = "text", batch: int = VECTOR_BATCH) -> DataFrame:
    """Adds vector and error. encoder() is called once for each task; it encodes batch rows at a time, whatever the Arrow
    batches are, and what is left at the end. Where a batch fails, its rows are tried one by one, and a failing row gets
    its error instead of a vector."""

    def encoded(own: pa.Table, model: Encoder) -> pa.Table:
        values = own.column(text).to_pylist()
        try:
            found = [(v, None) for v in np.asarray(model(values), dtype=np.float32).reshape(len(values), dimension)]
        except Exception:  # noqa: BLE001  any failure of a plug-in is a row's failure
            found = [_one(model, value, dimension) for value in values]
        vectors = pa.array([None if v is None else v.tolist() for v, _ in found], type=pa.list_(pa.float32()))
        return own.append_column("vector", vectors).append_column("error", pa.array([e for _, e in found], type=pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = encoder(), None
        for more in batches:
            held = pa.Table.from_batches([more]) if held is None else pa.concat_tables([held, pa.Table.from_batches([more])])
            while held.num_rows >= batch:
                yield from encoded(held.slice(0, batch), model).combine_chunks().to_batches()
                held = held.slice(batch)
        if held is not None and held.num_rows:
            yield from encoded(held, model).combine_chunks().to_batches()

    schema = StructType([*texts.schema.fields, StructField("vector", ArrayType(FloatType())), StructField("error", StringType())])
    return texts.mapInArrow(run, schema)


def encode_posts(posts: DataFrame, encoder: Callable[[], Encoder], dimension: int, batch: int = VECTOR_BATCH) -> DataFrame:
    """Posts (post_id, channel_id, content) with text, encoded in one pass: points where error is null, failures elsewhere."""
    texts = embeddable(posts).select("post_id", "channel_id", F.col("content").alias("text"))
    return encode(texts, encoder, dimension, batch=batch)


def _one(model: Encoder, value: str, dimension: int) -> tuple[np.ndarray | None, str | None]:
    try:
        return np.asarray(model([value]), dtype=np.float32).reshape(dimension), None
    except Exception as error:  # noqa: BLE001
        return None, str(error)


def embeddable(posts: DataFrame, text: str = "content") -> DataFrame:
    return posts.where(has_text(F.col(text)))


def vector_points(posts: DataFrame) -> DataFrame:
    """post_id, vector and the payload."""
    return posts.select("post_id", "vector", F.struct("channel_id", "text").alias("payload"))


def embed_posts(posts: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """Points of all posts with text, each encoded once: post_id, vector, channel_id, text. A text
    without words has a zero vector."""
    kept = with_hash_vectors(embeddable(posts).select("post_id", "channel_id", "content"), "content", dimension)
    vector = F.coalesce("vector", F.array_repeat(F.lit(0.0), dimension)).cast("array<float>")
    return kept.select("post_id", vector.alias("vector"), "channel_id", F.col("content").alias("text"))
