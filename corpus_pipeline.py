"""A training corpus from raw documents, stage by stage; each stage reads what its predecessor kept.

All stages but the last return the columns of ``documents``: low-quality documents go, one document of each near-copy
group stays, repeated passages are cut out (and ``n_chars`` follows), documents with benchmark passages go, and what is
left is packed into sequences: a row a piece, with its token ids, its sequence and its place there. Sorted by sequence_id
and offset the pieces are what training reads (``packing.sequences`` puts them together).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedgraph.llm.decontaminate import drop_contaminated
from feedgraph.llm.jaccard_join import drop_near_copies
from feedgraph.llm.packing import pack
from feedgraph.llm.quality_gam import drop_low_quality
from feedgraph.llm.queries import word_tokenizer
from feedgraph.llm.scratch import Scratch, table
from feedgraph.llm.suffix_dedup import remove_repeats

#: Stages of this kind have no SQL form (a fitted model, tokenizer ids, bin completion); tests use brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, word_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeats),
    ("benchmark decontamination", leaks),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Between stages the documents are written, so each stage is computed once."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "corpus")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, f"stage-{k}")
    return docs
