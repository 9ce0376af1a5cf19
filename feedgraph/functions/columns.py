"""Normalisation and measures of single values, as built-in column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LINK = "https://t.me/"


def stripped(value: Column) -> Column:
    """White space off both ends, in the Unicode sense, with the four ASCII separators."""
    return F.regexp_replace(value, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def canonical_ref(token: Column) -> Column:
    """A link becomes its path without outer slashes, a handle loses one at sign; all else is kept."""
    path = F.regexp_replace(F.substring(token, len(LINK) + 1, 2**31 - 1), "^/+|/+$", "")
    return F.when(token.startswith(LINK), path).otherwise(without_at(token))


def without_at(value: Column) -> Column:
    return F.when(value.startswith("@"), F.substring(value, 2, 2**31 - 1)).otherwise(value)


def normal_username(value: Column) -> Column:
    """Null and empty are null; one leading at sign goes."""
    return F.when(value != "", without_at(value))


def reactions_total(reactions: Column) -> Column:
    """The sum of counts, those without a number being zero; null where there is no reaction at all."""
    results = reactions["results"]
    total = F.aggregate(results, F.lit(0).cast("long"), lambda acc, r: acc + F.coalesce(r["count"], F.lit(0)))
    return F.when(F.size(results) > 0, total).cast("int")


def comments_count(replies: Column) -> Column:
    return replies["replies"]


def as_utc(date: Column) -> Column:
    """A time without zone is UTC (the session's zone must be UTC)."""
    return date.cast("timestamp")


def lexicon_count(text: Column, lexicon: Sequence[str]) -> Column:
    """Whole words of the lexicon in the text, whatever their case; a word is made of letters, digits and low lines."""
    any_word = "|".join(re.escape(w) for w in lexicon)
    found = F.regexp_count(text, F.lit(rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{any_word})(?![\p{{L}}\p{{N}}_])"))
    return F.coalesce(found, F.lit(0))


def lookup_identifier(username: Column, id_: Column) -> Column:
    return F.coalesce(F.nullif(username, F.lit("")), id_.cast("string"))


def has_text(text: Column) -> Column:
    return F.coalesce(stripped(text) != "", F.lit(False))


def post_key(channel_id: Column, message_id: Column) -> Column:
    """A stable surrogate id of a post."""
    return F.xxhash64(channel_id, message_id)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)
