"""Edge rows of references and single values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from feedgraph.functions import columns as C
from feedgraph.schemas import FIRST_PERSON
from feedgraph.sources import refs

TEXT = "https://t.me/foo/, @bar\r\nfoo\n\n baz ,https://t.me/,@,@@q,Foo,https://t.me/@z"


def test_references_keep_first_places(spark):
    frame = spark.createDataFrame([(0, TEXT)], "line long, value string")
    found = [r.ref for r in refs.distinct_refs(frame).orderBy("line", "pos").collect()]
    assert found == ["foo", "bar", "baz", "", "@q", "Foo", "@z"]


@pytest.mark.parametrize(("limit", "expected"), [(-1, []), (0, []), (2, ["foo", "bar"])])
def test_reference_limit(spark, limit, expected):
    frame = spark.createDataFrame([(0, TEXT)], "line long, value string")
    assert [r.ref for r in refs.distinct_refs(frame, limit).orderBy("line", "pos").collect()] == expected


def test_reference_file(spark, tmp_path):
    assert refs.read_refs(spark, str(tmp_path / "none.txt")).count() == 0
    (tmp_path / "refs.txt").write_text("a\r\nb,c\rd", encoding="utf-8", newline="")
    assert [tuple(r) for r in refs.read_refs(spark, str(tmp_path / "refs.txt")).collect()] == [(0, "a"), (1, "b,c"), (2, "d")]
    assert [r.value for r in refs.channel_refs(spark, "x,y", str(tmp_path / "refs.txt")).collect()] == ["x,y"]
    assert refs.channel_refs(spark, "", str(tmp_path / "refs.txt")).count() == 3


def test_usernames(spark):
    rows = spark.createDataFrame([(None,), ("",), ("@",), ("@a",), ("@@a",), ("a",)], "u string")
    assert [r.n for r in rows.select(C.normal_username(F.col("u")).alias("n")).collect()] == [None, None, "", "a", "@a", "a"]


def test_reactions_and_comments(spark):
    kind = "reactions struct<results: array<struct<count: int>>>, replies struct<replies: int>"
    rows = spark.createDataFrame([(([(2,), (3,)],), (4,)), (([],), (None,)), (None, None), (([(None,)],), None)], kind)
    found = rows.select(C.reactions_total(F.col("reactions")).alias("r"), C.comments_count(F.col("replies")).alias("c")).collect()
    assert [tuple(r) for r in found] == [(5, 4), (None, None), (None, None), (0, None)]


@pytest.mark.parametrize(
    ("text", "n"),
    [("Я думаю, что мне", 3), ("я_ я1 яблоко", 0), ("моя-мой", 2), ("МОЙ Считаю", 2), ("мое моё", 1), ("xя я2 я", 1), ("я́ тут", 1), ("²я ½я я", 1), ("я‍я", 2), ("мой", 0), (None, 0), ("", 0)],
)
def test_lexicon(spark, text, n):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(C.lexicon_count(F.col("t"), FIRST_PERSON).alias("n")).first().n == n


def test_identifier_and_text(spark):
    frame = spark.createDataFrame([("", 7), (None, 8), ("a", 9)], "u string, id long")
    assert [r.i for r in frame.select(C.lookup_identifier(F.col("u"), F.col("id")).alias("i")).collect()] == ["7", "8", "a"]
    texts = spark.createDataFrame([("A",), ("  ",), (None,), ("  ",), ("\x1c",)], "t string")
    assert [r.h for r in texts.select(C.has_text(F.col("t")).alias("h")).collect()] == [True, False, False, False, False]


def test_cosine_of_zero_vector(spark):
    frame = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    found = [r.c for r in frame.select(C.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert found[0] == pytest.approx(0.5**0.5)
    assert found[1] is None
