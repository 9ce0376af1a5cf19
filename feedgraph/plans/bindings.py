"""The logical tables over the test tables: the same expressions for both engines.

Each binding is a dictionary of column expressions in SQL that Spark and DuckDB read alike; where nested values or JSON
differ by engine, the Spark side is built here and the DuckDB side says the same in plain columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW, LATER = "2024-01-01 00:00:00", "2024-06-01 00:00:00"
LEXICON = ("on", "ist", "une", "por", "by", "mit", "para", "dans")
WORDS_NEEDED = 40
MIN_PRICE = 950


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CHANNEL = {
    "id": "c_custkey",
    "username": "case c_custkey % 3 when 0 then '@' || c_name when 1 then c_name end",
    "title": "c_name",
    "description": "c_mktsegment",
    "subscribers_count": "case when c_acctbal >= 0 then cast(floor(c_acctbal) as int) end",
    "avatar_url": "case when c_custkey % 4 = 0 then 'avatars/' || c_name end",
    "status": "case c_custkey % 5 when 0 then 'pending' when 1 then 'processing' when 2 then 'ready_for_parsing' when 3 then 'parsed' else 'rejected' end",
    "is_author_blog": "case c_custkey % 3 when 0 then true when 1 then false end",
}
RAW = {
    "ref": "'@' || c_name",
    "kind": "case when c_custkey % 11 = 0 then 'user' else 'channel' end",
    "id": "c_custkey",
    "access_hash": "case when c_custkey % 13 <> 0 then c_custkey * 7 end",
    "username": CHANNEL["username"],
    "title": "case when c_custkey % 17 <> 0 then c_name end",
    "broadcast": "c_nationkey % 5 <> 0",
    "avatar_url": CHANNEL["avatar_url"],
}
EVENT = {
    "channel_id": "user_id",
    "id": "event_id",
    "kind": "case when event_type = 'error' then 'service' else 'message' end",
    "views": "cast(floor(value) as int)",
    "video_note": "event_type = 'signup'",
    "seq": "event_id",
}
DOCUMENT = {"channel_id": "cast(substr(source, 4) as bigint)", "id": "doc_id", "message": "text"}
TURN = {"channel_id": "conv_id", "id": "turn", "message": "text", "kind": "case when role = 'system' then 'service' else 'message' end"}
#: Both events and posts by (channel, kind of event): every key arrives many times.
REKEYED = {"channel_id": "user_id", "message_id": "length(event_type) * 1000 + ascii(event_type)", "views": "cast(floor(value) as int)", "seq": "event_id"}
REFS = {
    "line": "c_custkey",
    "value": "case c_custkey % 6 when 0 then 'https://t.me/' || c_name || '/, @' || c_name when 1 then '  ' || c_name || ' ,,' when 2 then '@@' || c_name "
    "when 3 then 'https://t.me/,@' when 4 then chr(160) || c_mktsegment || chr(160) else c_mktsegment || ',@' || c_mktsegment end",
}
PART = {
    "id": "p_partkey",
    "title": "p_name",
    "username": "case when p_partkey % 7 <> 0 then 'part' || cast(p_partkey as varchar(20)) end",
    "subscribers_count": "cast(floor(p_retailprice) as int)",
    "broadcast": "p_size % 4 <> 0",
    "status": "case p_partkey % 5 when 0 then 'pending' else 'parsed' end",
}


def sql(columns: dict[str, str], table: str) -> str:
    """The binding in DuckDB."""
    return f"select {', '.join(f'{e} as {c}' for c, e in columns.items())} from {table}"


def bound(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The binding in Spark."""
    return frame.selectExpr(*[f"{e} as {c}" for c, e in columns.items()])


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = F.lit(NOW).cast("timestamp")
    return bound(load(spark, sf_dir, "customer"), CHANNEL).withColumns({"created_at": clock, "updated_at": clock})


def raw_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = "named_struct('participants_count', case when c_acctbal >= 0 then cast(floor(c_acctbal) as int) end, 'about', c_mktsegment)"
    return bound(load(spark, sf_dir, "customer"), RAW | {"full_chat": full})


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").withColumn("k", F.expr("cast(get_json_object(props, '$.k') as int)"))
    nested = {
        "date": "ts",
        "message": "case when event_id % 4 = 0 then '' when event_id % 4 = 1 then ' ' when event_id % 4 = 2 then event_type end",
        "forwards": "k",
        "replies": "case when k % 2 = 0 then named_struct('replies', k) end",
        "reactions": "case k % 3 when 1 then null when 0 then named_struct('results', cast(array() as array<struct<count: int>>)) "
        "else named_struct('results', array(named_struct('count', k), named_struct('count', k + 1), named_struct('count', cast(null as int)))) end",
    }
    return bound(events, EVENT | nested)


#: The same columns, un-nested, in DuckDB.
EVENT_SQL = f"""
select {', '.join(f'{e} as {c}' for c, e in EVENT.items())}, ts as date,
  case when event_id % 4 = 0 then '' when event_id % 4 = 1 then ' ' when event_id % 4 = 2 then event_type end as message,
  k as forwards, case when k % 2 = 0 then k end as comments_count, case when k % 3 = 2 then k + k + 1 end as reactions_count
from (select *, cast(props::json ->> 'k' as int) as k from events)
"""


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(load(spark, sf_dir, "documents"), DOCUMENT).withColumns({"kind": F.lit("message"), "video_note": F.col("id") % 97 == 5})


DOCUMENT_SQL = f"select *, id % 97 = 5 as video_note from ({sql(DOCUMENT, 'documents')})"


def turn_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(load(spark, sf_dir, "conversations"), TURN).withColumn("date", F.lit(NOW).cast("timestamp_ntz"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(load(spark, sf_dir, "customer"), REFS)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = F.lit(NOW).cast("timestamp")
    nothing = {"description": F.lit(None).cast("string"), "avatar_url": F.lit(None).cast("string"), "is_author_blog": F.lit(None).cast("boolean")}
    return bound(load(spark, sf_dir, "part"), PART).withColumns(nothing | {"created_at": clock, "updated_at": clock})


def raw_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part channels as raw records; one in 23 cannot be resolved."""
    full = F.struct(F.col("subscribers_count").alias("participants_count"), F.col("title").alias("about"))
    return parts(spark, sf_dir).where("id % 23 <> 0").select("id", F.lit("channel").alias("kind"), (F.col("id") * 3).alias("access_hash"), "username", "title", "broadcast", full.alias("full_chat"))


LINES_A_TASK = 250_000


def edges(spark: SparkSession, sf_dir: str, lines_a_task: int = LINES_A_TASK) -> DataFrame:
    """Parts bought together in two orders or more: src_id, pos, cand.

    The orders' distinct parts meet on the order key; an order is a few lines, so the join grows with the lines. A pair is
    counted once for both directions. Lines and pairs are dealt to as many tasks as the lines ask for, so what one task
    sorts and counts doesn't grow with them (few bytes of lines are many pairs, so partitions are not put together by bytes)."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // lines_a_task))
    lines = lines.repartition(tasks, "l_orderkey").distinct()
    a, b = lines.withColumnRenamed("l_partkey", "one"), lines.withColumnRenamed("l_partkey", "other")
    met = a.join(b, "l_orderkey").where("one < other").select("one", "other").repartition(tasks, "one", "other")
    pairs = met.groupBy("one", "other").agg(F.count("*").alias("n")).where("n >= 2").selectExpr("inline(array(struct(one as src_id, other as id), struct(other as src_id, one as id)))")
    cand = F.struct("id", F.lit("channel").alias("kind"), "broadcast", "username", "title").alias("cand")
    return pairs.join(parts(spark, sf_dir).select("id", "broadcast", "username", "title"), "id").select("src_id", F.col("id").cast("int").alias("pos"), cand)


EDGE_SQL = f"""
select p.src_id, p.id, c.broadcast, c.username, c.title from (
  select a.l_partkey as src_id, b.l_partkey as id from (select distinct l_orderkey, l_partkey from lineitem) a
  join (select distinct l_orderkey, l_partkey from lineitem) b on a.l_orderkey = b.l_orderkey and a.l_partkey <> b.l_partkey
  group by 1, 2 having count(*) >= 2) p
join ({sql(PART, 'part')}) c on c.id = p.id
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("post_id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("channel_id"), F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("text"))
