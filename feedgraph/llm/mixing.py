"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Sources, by code point and null last, take the weights in turn and share ``share`` times all words; no target is above
``repeats`` times its source's size, and what is above goes to the other sources by weight. Each source's documents are
shuffled by a hash of doc_id and queue up, pass after pass. A document's virtual finish time is its source's words up to
and with it, divided by the source's target; all queues are sorted by finish time, and the mix ends before the first
document with which it would exceed its budget, the sum of the targets. So every source has come to its target at
time one, but for the document that is under way.

Running sums over a global order are made by range partitions: rows are range-sorted into parts of a bounded number of
rows, summed up within a part, and the parts' totals are added. A source of any size is many parts. Only narrow rows
(ids, sizes, times) are sorted, never texts.

Defined results. Null text has size 0; documents of size 0 are never taken. Null is a source of its own. Repeated rows,
and rows that share a doc_id or have none, queue up one by one. Extra columns are ignored. An empty table gives an empty
result. Ties of finish times go by the source's rank and the place in its queue.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedgraph.llm.scratch import Scratch

WEIGHTS, SHARE, REPEATS, SEED = (3, 1, 2), 1.5, 2, "mix"
WORD = r"[^\x20\x09-\x0D]+"
PART_ROWS = 200_000


def running(rows: DataFrame, scratch: Scratch, name: str, order: Sequence[Column], sums: Mapping[str, Column], part_rows: int = PART_ROWS) -> DataFrame:
    """The rows of a kept table with running sums (the row itself included) over the global order.

    The parts' totals are one row for part_rows rows; they are what the last window sees."""
    dealt = rows.repartitionByRange(max(1, -(-rows.count() // part_rows)), *order).withColumn("_part", F.spark_partition_id())
    dealt = scratch.keep(dealt, name)
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(*[F.sum(v).alias(f"_{c}") for c, v in sums.items()])
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums])
    found = dealt.select("*", *[F.sum(v).over(inside).alias(c) for c, v in sums.items()]).join(offsets, "_part")
    return found.select(*rows.columns, *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in sums])


def source_targets(sized: DataFrame, scratch: Scratch, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> tuple[DataFrame, float]:
    """(source, source_size, rank, before (words of the sources before it), target), and the whole budget."""
    sources = scratch.keep(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = running(sources, scratch, "sources-ranked", [F.col("source").asc_nulls_last()], {"rank": F.lit(1).cast("long"), "upto": F.col("source_size")})
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumns({"weight": weight, "most": F.col("source_size") * repeats, "before": F.col("upto") - F.col("source_size")})
    ranked = scratch.keep(ranked.withColumn("fills_at", F.col("most").cast("double") / F.col("weight")), "sources-weighed")
    total, all_weights = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    budget = share * total
    # Sources fill up in order of fills_at; the level of the water is found where the next one stays below its brim.
    filled = running(ranked, scratch, "sources-filled", [F.col("fills_at"), F.col("rank")], {"most_upto": F.col("most"), "weight_upto": F.col("weight")})
    left = (F.lit(budget) - (F.col("most_upto") - F.col("most")).cast("double")) / (F.lit(all_weights) - F.col("weight_upto") + F.col("weight"))
    level = filled.withColumn("level", left).where("level <= fills_at").agg(F.min_by("level", F.struct("fills_at", "rank"))).first()[0]
    most = F.col("most").cast("double")
    target = most if level is None else F.least(most, F.col("weight") * F.lit(level))
    kept = scratch.keep(ranked.select("source", "source_size", "rank", "before", target.alias("target")), "targets")
    return kept, min(budget, kept.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]) if level is None else budget


def weighted_mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = SEED, part_rows: int = PART_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(documents, sequence). documents: doc_id, size, source, source_size, target, taken (words that the mix takes) and
    copies, a row a document. sequence: doc_id, source, pass (from 0), size, finish and position (words of the mix before
    it), a row for each copy taken."""
    scratch = Scratch(docs.sparkSession, "mixing")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    sized = scratch.keep(docs.select("doc_id", "source", size.alias("size"), draw.alias("draw"), F.xxhash64("text").alias("tie")), "sized")
    targets, budget = source_targets(sized, scratch, weights, share, repeats)

    queue = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    queue = scratch.keep(queue, "queue")
    queue = running(queue, scratch, "queues", [F.col(c) for c in ("rank", "draw", "doc_id", "size", "tie")], {"upto": F.col("size")}, part_rows)
    queue = scratch.keep(queue.withColumn("upto", F.col("upto") - F.col("before")), "queued")
    scratch.drop("sized", "queue", "queues")

    at = lambda k: F.col("upto") + F.col("source_size") * k
    finish = lambda k: at(k).cast("double") / F.col("target")
    served = queue.where("size > 0 and target > 0")
    passes = F.explode(F.array(*[F.struct(F.lit(k).alias("pass"), at(k).alias("at"), finish(k).alias("finish")) for k in range(repeats)]))
    copies = scratch.keep(served.select("doc_id", "source", "rank", "size", passes.alias("c")).select("doc_id", "source", "rank", "size", "c.*"), "copies")
    order = ("finish", "rank", "at")
    lined = running(copies, scratch, "lined-up", [F.col(c) for c in order], {"mixed": F.col("size")}, part_rows)
    taken = lined.where(F.col("mixed") <= F.lit(budget))
    last = taken.orderBy(F.desc("mixed")).select(*order).first()
    scratch.drop("copies")

    if last is None:
        n_copies = F.lit(0).cast("long")
    else:
        end = F.struct(*[F.lit(last[c]).cast(copies.schema[c].dataType).alias(c) for c in order])
        inside = [(F.struct(finish(k).alias("finish"), F.col("rank").alias("rank"), at(k).alias("at")) <= end).cast("long") for k in range(repeats)]
        n_copies = F.when((F.col("size") > 0) & (F.col("target") > 0), sum(inside[1:], inside[0])).otherwise(0)
    documents = queue.select("doc_id", "size", "source", "source_size", "target", (F.col("size") * n_copies).alias("taken"), n_copies.alias("copies"))
    sequence = taken.select("doc_id", "source", "pass", "size", "finish", (F.col("mixed") - F.col("size")).alias("position"))
    return documents, sequence


ORACLE = f"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size, ('0x' || substr(md5('{SEED}-' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as draw from documents),
ranked as (select *, row_number() over (order by source nulls last) as rank from (select source, sum(size)::bigint as source_size from sized group by source)),
weighed as (select *, 2 * source_size as most, ([3, 1, 2])[(rank - 1) % 3 + 1] as weight, sum(source_size) over () as total from ranked),
filled as (select *, most::double / weight as fills_at, (1.5 * total::double - (sum(most) over w - most)::double) / (sum(weight) over () - sum(weight) over w + weight)::double as level
           from weighed window w as (order by most::double / weight, rank)),
level as (select arg_min(level, (fills_at, rank)) as level from filled where level <= fills_at),
targets as (select source, source_size, rank, least(most::double, weight * coalesce((select level from level), 1e300)) as target from filled),
queued as (select doc_id, size, draw, source_size, rank, target, sum(size) over (partition by rank order by draw, doc_id, size) as upto from sized join targets on sized.source is not distinct from targets.source),
copies as (select doc_id, size, rank, upto + k * source_size as done, (upto + k * source_size)::double / target as finish from queued, (values (0), (1)) t(k) where size > 0 and target > 0),
mixed as (select *, sum(size) over (order by finish, rank, done) as mixed from copies),
taken as (select doc_id, sum(size)::bigint as taken from mixed where mixed <= (select 1.5 * sum(size)::double from sized) group by doc_id)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken from queued left join taken using (doc_id)
"""
