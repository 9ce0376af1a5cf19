"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

A logged conversation often is a snapshot of a longer one. Every turn gets a 128-bit prefix hash: the running exclusive
or of two hashes of (position, role, text), so that equal prefixes have equal hashes and nothing has to be compared
turn by turn. A conversation whose hash is a proper prefix hash of another is dropped by an anti-join; of equal
conversations the smallest conv_id stays. What is left is rendered.

Both sides of the anti-join are aggregated to distinct hashes before they meet, so a first turn that a third of all
conversations share is one row.

Defined results. Rows without conv_id belong to no conversation and are left out. Null turns come after all others;
turns with one number are ordered by role and text; a wholly repeated row counts once. Null text is empty, a null role
is ``unknown``; neither makes a turn vanish. Markers inside texts are broken up, so a text cannot forge a turn. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedgraph.llm.scratch import Scratch

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turns(conversations: DataFrame) -> DataFrame:
    """One row per turn with its position (from 1) and the hashes of the prefix that it ends."""
    rows = (
        conversations.where(F.col("conv_id").isNotNull())
        .select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("position", F.row_number().over(order))
    return (
        rows.withColumns({
            "h1": F.expr("bit_xor(xxhash64(position, role, text))").over(so_far),
            "h2": F.expr("bit_xor(xxhash64(text, role, position, 'second'))").over(so_far),
            "last": F.lead("position").over(order).isNull(),
        })
    )


def maximal(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of the conversations that are no proper prefix of another, one of each."""
    key = ["position", "h1", "h2"]
    whole = rows.where("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = rows.where("not last").select(*key).distinct()
    return whole.join(proper, key, "left_anti").select("conv_id", F.col("position").alias("n_turns"), "n_copies")


def rendered(role: Column, text: Column) -> Column:
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(OPEN), safe(role), F.lit("\n"), safe(text), F.lit(CLOSE + "\n"))


def chat_format(conversations: DataFrame) -> DataFrame:
    """Maximal conversations as prompts: conv_id, n_turns, n_copies, prompt."""
    rows = Scratch(conversations.sparkSession, "chat-format").keep(turns(conversations), "turns")  # read twice, hashes alone first
    prompts = (
        rows.join(maximal(rows), "conv_id").groupBy("conv_id", "n_turns", "n_copies")
        .agg(F.sort_array(F.collect_list(F.struct("position", rendered(F.col("role"), F.col("text")).alias("line")))).alias("lines"))
    )
    return prompts.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies", F.array_join("lines.line", "").alias("prompt"))


ORACLE = f"""
with rows as (select distinct conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations where conv_id is not null),
chats as (
  select conv_id, count(*) as n_turns, list(struct_pack(role := role, text := text) order by turn nulls last, role, text) as turns,
         string_agg('{OPEN}' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '{CLOSE}' || chr(10), '' order by turn nulls last, role, text) as prompt
  from rows group by conv_id),
prefixes as (select distinct n, turns[1:n] as turns from chats, range(1, n_turns) r(n))
select min(conv_id) as conv_id, n_turns, count(*) as n_copies, any_value(prompt) as prompt
from chats where not exists (select 1 from prefixes where prefixes.n = chats.n_turns and prefixes.turns = chats.turns)
group by turns, n_turns
"""
