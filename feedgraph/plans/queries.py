"""One query for each operator, over the bound test tables, with its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedgraph.functions import columns as C
from feedgraph.operators import authorship, constraints, discovery, embed, lifecycle, metrics, normalize, search, topk, upsert
from feedgraph.plans import bindings as B
from feedgraph.schemas import MAX_LENGTHS
from feedgraph.sources import bronze, refs
from feedgraph.sources.store import Store, shared_folder
from feedgraph.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CHANNEL, RAW = B.sql(B.CHANNEL, "customer"), B.sql(B.RAW, "customer")
STRIP = r"'^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g'"
WORDS = r"[^\p{L}\p{N}]+"
LEXICON = ", ".join(f"'{w}'" for w in B.LEXICON)
NOW, LATER = (f"timestamp '{t}'" for t in (B.NOW, B.LATER))
DIMENSION, SEED = 64, "feed"


def query(sql: str | None = None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    """Register a query under its function's name, with its DuckDB form where there is one."""

    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return register


def shown(frame: DataFrame) -> DataFrame:
    """Times without zone, as DuckDB has them."""
    return frame.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in frame.dtypes if kind == "timestamp"})


def clock(text: str = B.LATER) -> F.Column:
    return F.lit(text).cast("timestamp")


# --- sources -------------------------------------------------------------------------------------------------------


def written_refs(spark: SparkSession, sf_dir: str) -> str:
    """The bound references as text files, a line each in order."""
    path = shared_folder(spark, "refs")
    B.refs(spark, sf_dir).repartitionByRange(8, "line").sortWithinPartitions("line").select("value").write.text(path)
    return path


@query(f"select line - (select min(c_custkey) from customer) as line, value from ({B.sql(B.REFS, 'customer')})")
def ref_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.read_refs(spark, written_refs(spark, sf_dir)).where("value <> ''")


TOKENS = f"""
select line, pos, token from (
  select line, unnest(range(len(parts))) as pos, regexp_replace(unnest(parts), {STRIP}) as token
  from (select line, regexp_split_to_array(value, '[,\\r\\n]') as parts from ({B.sql(B.REFS, 'customer')})))
where token <> ''
"""
CANONICAL = f"""
select line, pos, case when starts_with(token, 'https://t.me/') then trim(substr(token, 14), '/') when starts_with(token, '@') then substr(token, 2) else token end as ref
from ({TOKENS})
"""


@query(TOKENS)
def ref_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.tokens(B.refs(spark, sf_dir))


@query(CANONICAL)
def ref_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.canonical(B.refs(spark, sf_dir))


@query(f"select ref, line, pos from (select *, row_number() over (partition by ref order by line, pos) as n from ({CANONICAL})) where n = 1 order by line, pos limit 100")
def ref_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.distinct_refs(B.refs(spark, sf_dir), 100)


@query(f"select *, case when c_acctbal >= 0 then cast(floor(c_acctbal) as int) end as participants_count, c_mktsegment as about from ({RAW}) join (select c_custkey as id, c_acctbal, c_mktsegment from customer) using (id)".replace("select *,", "select ref, kind, id, access_hash, username, title, broadcast, avatar_url,", 1))
def raw_channel_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "raw-channels")
    B.raw_channels(spark, sf_dir).write.json(path)
    raw = bronze.read_raw(spark, "raw_channels", path, "json")
    return raw.select(*[c for c in raw.columns if c != "full_chat"], "full_chat.participants_count", "full_chat.about")


@query(f"select channel_id, id, kind, date, message, views, forwards, comments_count, video_note, seq from ({B.EVENT_SQL})")
def raw_message_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "raw-messages")
    B.event_messages(spark, sf_dir).write.parquet(path)
    raw = bronze.read_raw(spark, "raw_messages", path)
    return raw.select("channel_id", "id", "kind", "date", "message", "views", "forwards", F.col("replies.replies").alias("comments_count"), "video_note", "seq")


@query(B.EDGE_SQL)
def rec_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.edges(spark, sf_dir).select("src_id", "cand.id", "cand.broadcast", "cand.username", "cand.title")


@query(f"select line, value, 'file' as source from (select line - (select min(c_custkey) from customer) as line, value from ({B.sql(B.REFS, 'customer')})) union all select 0, string_agg(n_name, ',' order by n_nationkey), 'inline' from nation")
def ref_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References from the file where there is no inline list, and from a list where there is one."""
    path = written_refs(spark, sf_dir)
    nations = B.load(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()  # 25 names
    named = ",".join(r["n_name"] for r in nations)
    listed = refs.channel_refs(spark, named, path).withColumn("source", F.lit("inline"))
    return refs.channel_refs(spark, None, path).where("value <> ''").withColumn("source", F.lit("file")).unionByName(listed)


@query(f"select id, username, title, status from ({CHANNEL})")
def create_if_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second creation leaves a filled table alone."""
    path = home(spark, "channels")
    filled(jobs.channel_store(spark, path, 8), B.channels(spark, sf_dir))
    return jobs.channel_store(spark, path, 8).read().select("id", "username", "title", "status")


# --- projections ---------------------------------------------------------------------------------------------------

NORMAL_NAME = "case when username = '' then null when starts_with(username, '@') then substr(username, 2) else username end"


@query(f"select id, {NORMAL_NAME} as username from ({CHANNEL})")
def username_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.channels(spark, sf_dir).select("id", C.normal_username(F.col("username")).alias("username"))


CHANNEL_ROWS = f"""
select r.id, {NORMAL_NAME} as username, coalesce(title, '') as title, case when access_hash is not null then c_mktsegment end as description,
  case when access_hash is not null and c_acctbal >= 0 then cast(floor(c_acctbal) as int) end as subscribers_count, avatar_url
from ({RAW}) r join (select c_custkey as id, c_acctbal, c_mktsegment from customer) c on c.id = r.id where kind = 'channel'
"""


@query(CHANNEL_ROWS)
def channel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.channel_rows(normalize.channel_entities(B.raw_channels(spark, sf_dir)))


@query(f"select id, username, title, description, subscribers_count, cast(null as varchar) as avatar_url, 'pending' as status, id % 2 = 0 as is_author_blog from ({CHANNEL})")
def discovered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.discovered_rows(B.channels(spark, sf_dir), F.col("id") % 2 == 0)


@query(f"select id, reactions_count as reactions_total from ({B.EVENT_SQL})")
def reactions_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.event_messages(spark, sf_dir).select("id", C.reactions_total(F.col("reactions")).alias("reactions_total"))


@query(f"select id, comments_count from ({B.EVENT_SQL})")
def comments_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.event_messages(spark, sf_dir).select("id", C.comments_count(F.col("replies")).alias("comments_count"))


@query("select event_id as id, strftime(ts, '%Y-%m-%d %H:%M:%S') as published_at, floor(epoch(ts))::bigint as epoch from events")
def published_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = C.as_utc(F.col("date"))
    return B.event_messages(spark, sf_dir).select("id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("published_at"), F.unix_seconds(at).alias("epoch"))


POST_ROWS = f"""
select channel_id, id as message_id, message as content, date as published_at, views, comments_count, forwards as shares_count, reactions_count
from ({B.EVENT_SQL}) where kind = 'message'
"""


@query(POST_ROWS)
def post_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(normalize.post_rows(normalize.real_messages(B.event_messages(spark, sf_dir))))


COUNT_WORDS = f"len(list_filter(regexp_split_to_array(lower(message), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w in ({LEXICON})))"


@query(f"select id, {COUNT_WORDS} as n_words from ({B.DOCUMENT_SQL})")
def lexicon_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.document_messages(spark, sf_dir).select("id", C.lexicon_count(F.col("message"), B.LEXICON).cast("long").alias("n_words"))


@query(f"select id, coalesce(nullif(username, ''), cast(id as varchar)) as identifier from ({CHANNEL})")
def channel_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.channels(spark, sf_dir).select("id", C.lookup_identifier(F.col("username"), F.col("id")).alias("identifier"))


@query("select vec_id as post_id, len(embedding) as dimension, round(list_sum(embedding::double[]), 4) as total, label::bigint as channel_id, 'text ' || vec_id as text from embeddings")
def vector_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = embed.vector_points(B.vectors(spark, sf_dir))
    total = F.aggregate("vector", F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    return points.select("post_id", F.size("vector").cast("long").alias("dimension"), F.round(total, 4).alias("total"), "payload.channel_id", "payload.text")


# --- filters -------------------------------------------------------------------------------------------------------


@query(f"select id, broadcast from ({RAW}) where kind = 'channel' and broadcast")
def channel_kind_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.channel_entities(B.raw_channels(spark, sf_dir), True).select("id", "broadcast")


CANDIDATES = f"select src_id, id, username, title from ({B.EDGE_SQL}) where broadcast and username <> ''"


@query(CANDIDATES)
def candidate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.candidates(B.edges(spark, sf_dir)).select("src_id", "id", "username", "title")


@query(f"select id, subscribers_count from ({CHANNEL}) where subscribers_count >= 3000")
def subscriber_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.subscriber_gate(B.channels(spark, sf_dir)).select("id", "subscribers_count")


@query(f"select channel_id, id, views from ({B.EVENT_SQL}) where kind = 'message' and date is not null")
def message_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.real_messages(B.event_messages(spark, sf_dir)).select("channel_id", "id", "views")


@query(f"select id, message from ({B.EVENT_SQL}) where trim(message) <> ''")
def embeddable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.embeddable(B.event_messages(spark, sf_dir), "message").select("id", "message")


@query(f"select id, status from ({CHANNEL}) where status = 'ready_for_parsing' and is_author_blog")
def ready_author_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.ready_author_channels(B.channels(spark, sf_dir)).select("id", "status")


# --- joins ---------------------------------------------------------------------------------------------------------


@query(f"select * from ({CANDIDATES}) where id % 3 <> 0")
def new_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = discovery.candidates(B.edges(spark, sf_dir))
    return discovery.new_candidates(found, B.parts(spark, sf_dir).where("id % 3 = 0")).select("src_id", "id", "username", "title")


@query(f"select id, title, status from ({CHANNEL}) where id in (select o_custkey from orders)")
def channels_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = B.load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    channels = filled(jobs.channel_store(spark, home(spark, "channels"), 8), B.channels(spark, sf_dir))
    return channels.lookup(wanted).select("id", "title", "status")


@query(f"select channel_id, message_id, views from ({POST_ROWS}) where (channel_id, message_id) in (select user_id, event_id from events)")
def posts_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = B.load(spark, sf_dir, "events").select(F.col("user_id").alias("channel_id"), F.col("event_id").alias("message_id"))
    return filled_posts(spark, sf_dir).lookup(wanted).select("channel_id", "message_id", "views")


@query(f"""
select c.src_id, c.id, c.username, case when c.id % 23 <> 0 then p.subscribers_count end as subscribers_count, case when c.id % 23 <> 0 then p.title end as description
from ({CANDIDATES}) c join ({B.sql(B.PART, 'part')}) p on p.id = c.id
""")
def candidate_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = discovery.with_full_info(discovery.candidates(B.edges(spark, sf_dir)), B.raw_parts(spark, sf_dir))
    return found.select("src_id", "id", "username", "subscribers_count", "description")


# --- aggregates ----------------------------------------------------------------------------------------------------

NEWEST = "(select *, row_number() over (partition by channel_id order by id desc) as n from ({}))"
AUTHORS = f"""
select channel_id as id, coalesce(bool_or(video_note), false) or sum({COUNT_WORDS}) >= {B.WORDS_NEEDED} as is_author_blog
from {NEWEST.format(B.DOCUMENT_SQL)} where n <= 15 group by channel_id
"""


@query(f"select c.id, coalesce(a.is_author_blog, false) as is_author_blog from ({CHANNEL}) c left join ({AUTHORS}) a on a.id = c.id")
def author_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authorship.author_flags(B.channels(spark, sf_dir), B.document_messages(spark, sf_dir), B.LEXICON, B.WORDS_NEEDED)


@query(f"select channel_id, count(*) filter (where content <> '') as n_saved from ({POST_ROWS}) group by channel_id")
def posts_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.posts_saved(normalize.post_rows(normalize.real_messages(B.event_messages(spark, sf_dir))))


@query(f"select p.p_partkey as src_id, count(c.id) as n_new from part p left join ({CANDIDATES}) c on c.src_id = p.p_partkey and c.id % 3 <> 0 group by 1")
def new_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = B.parts(spark, sf_dir)
    finds = discovery.new_candidates(discovery.candidates(B.edges(spark, sf_dir)), parts.where("id % 3 = 0"))
    return metrics.new_per_source(parts.select(F.col("id").alias("src_id")), finds)


@query(f"select id // 100 as batch, count(*) as n_requested, count(*) filter (where trim(message) <> '') as n_valid from ({B.EVENT_SQL}) group by 1")
def embed_batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = B.event_messages(spark, sf_dir).withColumn("batch", F.expr("id div 100"))
    return metrics.embed_batch_stats(messages, "batch", "message")


@query(f"select count(*) as n_rows, count(*) filter (where content <> '') as n_saved, count(*) filter (where trim(content) <> '') as n_valid from ({POST_ROWS})")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a run, taken while its posts are written: the table is not read again."""
    rows = normalize.post_rows(normalize.real_messages(B.event_messages(spark, sf_dir)), "seq")
    at = {"created_at": clock(B.NOW), "updated_at": clock(B.NOW), "id": C.post_key(F.col("channel_id"), F.col("message_id"))}
    counted, seen = metrics.observed(rows.withColumns(at), "posts", metrics.post_counters())
    jobs.post_store(spark, home(spark, "posts"), 8).append(counted)
    return spark.createDataFrame([seen.get], "n_rows long, n_saved long, n_valid long")


# --- upserts -------------------------------------------------------------------------------------------------------


def filled(store: Store, *batches: DataFrame) -> Store:
    """The table after the batches have been appended one by one."""
    for batch in batches:
        store.append(batch)
    return store


def home(spark: SparkSession, name: str) -> str:
    return shared_folder(spark, name)


def filled_posts(spark: SparkSession, sf_dir: str) -> Store:
    rows = normalize.post_rows(normalize.real_messages(B.event_messages(spark, sf_dir)), "seq")
    at = {"created_at": clock(B.NOW), "updated_at": clock(B.NOW)}
    return filled(jobs.post_store(spark, home(spark, "posts"), 8), rows.withColumns({"id": C.post_key(F.col("channel_id"), F.col("message_id"))} | at))


def parsed_again(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Known channels, and fresh rows without status and flag, of which some are new."""
    fresh = normalize.channel_rows(normalize.channel_entities(B.raw_channels(spark, sf_dir))).where("id % 2 = 0").withColumn("updated_at", clock())
    return B.channels(spark, sf_dir).where("id % 10 <> 4"), fresh


def channel_upsert_sql(status: str, flag: str) -> str:
    base = f"select *, {NOW} as created_at, {NOW} as updated_at from ({CHANNEL}) where id % 10 <> 4"
    taken = ", ".join(f"case when i.id is not null then i.{c} else b.{c} end as {c}" for c in ("username", "title", "description", "subscribers_count", "avatar_url"))
    return f"""
select coalesce(i.id, b.id) as id, {taken}, {status} as status, {flag} as is_author_blog, coalesce(b.created_at, {LATER}) as created_at,
  case when i.id is not null then {LATER} else b.updated_at end as updated_at
from ({base}) b full outer join (select * from ({CHANNEL_ROWS}) where id % 2 = 0) i on i.id = b.id
"""


@query(channel_upsert_sql("case when i.id is not null then 'pending' else b.status end", "case when i.id is null then b.is_author_blog end"))
def channel_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the table, which is compacted in between."""
    known, fresh = parsed_again(spark, sf_dir)
    table = filled(jobs.channel_store(spark, home(spark, "channels"), 8), known)
    table.compact()
    return shown(filled(table, upsert.with_channel_defaults(fresh)).read())


@query(channel_upsert_sql("case when b.id is not null then b.status else 'pending' end", "case when b.id is not null then b.is_author_blog end"))
def channel_upsert_preserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(upsert.upsert_channels(*parsed_again(spark, sf_dir), preserve=("status", "is_author_blog")))


REKEYED = B.sql(B.REKEYED, "events")
LATEST = "(select * from (select *, row_number() over (partition by channel_id, message_id order by seq desc, views desc) as n from ({})) where n = 1)"


@query(f"select channel_id, message_id, views, seq from {LATEST.format(REKEYED)}")
def last_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.last_arrival(B.bound(B.load(spark, sf_dir, "events"), B.REKEYED), ["channel_id", "message_id"])


@query(f"""
select channel_id, message_id, case when i.seq is not null then i.content else b.content end as content, case when i.seq is not null then i.views else b.views end as views,
  coalesce(b.created_at, i.updated_at) as created_at, coalesce(i.updated_at, b.updated_at) as updated_at
from (select *, 'old' as content, {NOW} as created_at, {NOW} as updated_at from {LATEST.format(f"select * from ({REKEYED}) where seq % 3 <> 0")}) b
full outer join (select *, case when seq % 2 = 0 then 'new' end as content, {LATER} as updated_at from {LATEST.format(f"select * from ({REKEYED}) where seq % 3 = 0")}) i
using (channel_id, message_id)
""")
def post_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, keys = B.bound(B.load(spark, sf_dir, "events"), B.REKEYED), ["channel_id", "message_id"]

    def posts(frame: DataFrame, content: F.Column, at: str) -> DataFrame:
        latest = upsert.last_arrival(frame, keys)
        nothing = {c: F.lit(None).cast("int") for c in ("comments_count", "shares_count", "reactions_count")}
        return latest.withColumns(nothing | {"content": content, "published_at": clock(B.NOW), "created_at": clock(at), "updated_at": clock(at)}).drop("seq")

    base = posts(rows.where("seq % 3 <> 0"), F.lit("old"), B.NOW)
    incoming = posts(rows.where("seq % 3 = 0"), F.when(F.col("seq") % 2 == 0, F.lit("new")), B.LATER)
    return shown(upsert.upsert_posts(base, incoming)).select("channel_id", "message_id", "content", "views", "created_at", "updated_at")


@query("""
select vec_id as post_id, case when vec_id % 4 = 0 then 'again' else 'text ' || vec_id end as text, case when vec_id % 4 = 0 then -1 else label::bigint end as channel_id,
  round(embedding[1]::double * case when vec_id % 4 = 0 then 2 else 1 end, 5) as first
from embeddings
""")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = B.vectors(spark, sf_dir)
    base = points.where("post_id % 8 <> 4")
    doubled = F.transform("vector", lambda v: (v * 2).cast("float"))
    incoming = points.where("post_id % 4 = 0").withColumns({"vector": doubled, "channel_id": F.lit(-1).cast("long"), "text": F.lit("again")})
    return filled(jobs.vector_store(spark, home(spark, "vectors"), 8), base, incoming).read().select("post_id", "text", "channel_id", F.round(F.element_at("vector", 1).cast("double"), 5).alias("first"))


# --- windows and claims --------------------------------------------------------------------------------------------


@query(f"select channel_id, id as message_id, views from {NEWEST.format(B.EVENT_SQL)} where n <= 10 and kind = 'message' and date is not null")
def newest_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.newest_posts(B.event_messages(spark, sf_dir)).select("channel_id", F.col("id").alias("message_id"), "views")


@query(f"select channel_id, id, kind from {NEWEST.format(B.EVENT_SQL)} where n <= 15")
def newest_for_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.newest_inspected(B.event_messages(spark, sf_dir)).select("channel_id", "id", "kind")


def claim_sql(where: str, n: int) -> str:
    chosen = f"select id from ({CHANNEL}) where {where} order by md5('{SEED}-' || id), id limit {n}"
    return f"select id, case when id in ({chosen}) then 'processing' else status end as status from ({CHANNEL})"


@query(f"""
with first as (select id from ({CHANNEL}) where status = 'pending' order by md5('{SEED}-0-' || id), id limit 25),
second as (select id from ({CHANNEL}) where status = 'pending' and id not in (select id from first) order by md5('{SEED}-1-' || id), id limit 25)
select id, case when id in (select id from first) or id in (select id from second) then 'processing' else status end as status from ({CHANNEL})
""")
def claim_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two workers' claims through the table."""
    channels = filled(jobs.channel_store(spark, home(spark, "channels"), 8), B.channels(spark, sf_dir))
    for _ in range(2):
        lifecycle.claim_exclusively(channels, 25, SEED, clock())
    return channels.read().select("id", "status")


@query(claim_sql("status = 'ready_for_parsing' and is_author_blog", 20))
def claim_for_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = B.channels(spark, sf_dir)
    return lifecycle.claimed(channels, lifecycle.claim_for_parsing(channels, 20, SEED), clock()).select("id", "status")


# --- constraints ---------------------------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, count(*) as n_rows from lineitem group by 1, 2 having count(*) > 1")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.duplicate_keys(B.load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select event_id, user_id from events where user_id not in (select c_custkey from customer where c_custkey % 3 <> 0)")
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, customers = B.load(spark, sf_dir, "events"), B.load(spark, sf_dir, "customer").where("c_custkey % 3 <> 0")
    return constraints.split_by_parent(events, customers, "user_id", "c_custkey")[1].select("event_id", "user_id")


@query(f"""
select 'channel' as kind, id, null as channel_id from ({CHANNEL}) where id % 4 <> 0
union all select 'post', id, channel_id from ({B.EVENT_SQL}) where kind = 'message' and channel_id % 4 <> 0
union all select 'vector', id, channel_id from ({B.EVENT_SQL}) where kind = 'message' and channel_id % 4 <> 0
""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth channel goes, and its posts and their points with it; what the three tables hold then."""
    channels, posts = filled(jobs.channel_store(spark, home(spark, "channels"), 8), B.channels(spark, sf_dir)), filled_posts(spark, sf_dir)
    points = posts.read().select(F.col("id").alias("post_id"), F.array(F.lit(1.0)).alias("vector"), "channel_id", F.lit("").alias("text"))
    vectors = filled(jobs.vector_store(spark, home(spark, "vectors"), 8), points)
    constraints.delete_channels(B.channels(spark, sf_dir).where("id % 4 = 0").select("id"), channels, posts, vectors)
    channels.compact()
    kept = B.event_messages(spark, sf_dir).select(F.col("id").alias("event_id"), C.post_key(F.col("channel_id"), F.col("id")).alias("post_id"))
    left = channels.read().select(F.lit("channel").alias("kind"), "id", F.lit(None).cast("long").alias("channel_id"))
    left = left.union(posts.read().select(F.lit("post"), "message_id", "channel_id"))
    return left.union(vectors.read().join(kept, "post_id").select(F.lit("vector"), "event_id", "channel_id"))


@query(f"""
select id, concat_ws('; ', case when title is null then 'title is null' end, case when username is null then 'username is null' end,
  case when length(title) > 255 then 'title is longer than 255' end) as reasons
from (select id, username, case when id % 19 = 0 then repeat(title, 20) else title end as title from ({RAW}))
where title is null or username is null or length(title) > 255
""")
def row_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = B.raw_channels(spark, sf_dir).withColumn("title", F.when(F.col("id") % 19 == 0, F.repeat("title", F.lit(20))).otherwise(F.col("title")))
    bad = constraints.split_by_violations(raw, ["title", "username"], {"title": MAX_LENGTHS["title"]})[1]
    return bad.select("id", F.array_join("reasons", "; ").alias("reasons"))


# --- lifecycle and graph -------------------------------------------------------------------------------------------


@query(f"""
select id, case when id % 6 = 0 then 'parsed' when id % 6 = 1 then 'rejected' else status end as status, case when id % 6 < 2 then {LATER} else {NOW} end as updated_at from ({CHANNEL})
""")
def status_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = B.channels(spark, sf_dir)
    known = channels.where("id % 6 < 2").select("id", F.when(F.col("id") % 6 == 0, "parsed").otherwise("rejected").alias("new_status"))
    unknown = channels.select((-F.col("id") - 1).alias("id"), F.lit("parsed").alias("new_status"))
    return shown(lifecycle.transition(channels, known.union(unknown), clock())).select("id", "status", "updated_at")


CLAIMED = f"select id, row_number() over (order by md5('{SEED}-' || id), id) as o from ({B.sql(B.PART, 'part')}) where id % 3 = 0 and status = 'pending' qualify o <= 200"
UNRESOLVED = f"select id from ({CLAIMED}) where id % 23 = 0 or id not in (select id from ({B.sql(B.PART, 'part')}) where broadcast)"


@query(UNRESOLVED)
def unresolved_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels, raw = B.parts(spark, sf_dir).where("id % 3 = 0"), B.raw_parts(spark, sf_dir)
    ids = lifecycle.claim(channels, 200, SEED)
    rejected = lifecycle.reject_unresolved(channels, ids, raw, clock())
    return rejected.join(ids.select("id"), "id", "left_semi").where("status = 'rejected'").select("id")


def known_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.parts(spark, sf_dir).where("id % 3 = 0").select("id", "username", "title", "description", "subscribers_count", "avatar_url", "status", "is_author_blog", "created_at", "updated_at")


def expansion_sql(claimed: str) -> str:
    """The known part channels after an expansion of the claimed ones, and what it finds."""
    unresolved = f"select id from ({claimed}) where id % 23 = 0 or id not in (select id from ({B.sql(B.PART, 'part')}) where broadcast)"
    return f"""
with part_channels as ({B.sql(B.PART, 'part')}), claimed as ({claimed}), unresolved as ({unresolved}),
sources as (select * from claimed where id not in (select id from unresolved)),
found as (
  select e.id, e.title, p.subscribers_count, row_number() over (partition by e.id order by s.o, e.id) as n
  from ({CANDIDATES}) e join sources s on s.id = e.src_id join part_channels p on p.id = e.id
  where e.id % 3 <> 0 and e.id % 23 <> 0 and p.subscribers_count >= {B.MIN_PRICE}),
authors as ({AUTHORS})
select id, title, case when id in (select id from unresolved) then 'rejected' when id in (select id from sources) then 'ready_for_parsing' else status end as status, cast(null as boolean) as is_author_blog
from part_channels where id % 3 = 0
union all
select f.id, f.title, 'pending', coalesce(a.is_author_blog, false) from found f left join authors a on a.id = f.id where n = 1
"""


@query(expansion_sql(CLAIMED))
def expand_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = known_parts(spark, sf_dir)
    ids = lifecycle.claim(channels, 200, SEED)
    grown = discovery.expand_round(channels, B.raw_parts(spark, sf_dir), B.edges(spark, sf_dir), B.document_messages(spark, sf_dir), ids, clock(), B.MIN_PRICE, B.LEXICON, B.WORDS_NEEDED)
    return grown.select("id", "title", "status", "is_author_blog")


@query(f"""
with recursive links as (select src_id, id from ({CANDIDATES})),
seeds as (select id from ({B.sql(B.PART, 'part')}) where status = 'pending' and username is null),
walk as (select id, 0 as depth from seeds
         union select l.id, w.depth + 1 from walk w join links l on l.src_id = w.id where w.depth < 60)
select id, min(depth) as depth from walk group by id
""")
def expand_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = B.parts(spark, sf_dir).where("status = 'pending' and username is null").select("id")
    return discovery.expand(seeds, discovery.candidates(B.edges(spark, sf_dir)))


#: All that pending part channels reach: with the table's other channels, the round of discovery and the author flag.
WALK = f"""
with recursive part_channels as ({B.sql(B.PART, 'part')}), all_edges as ({B.EDGE_SQL}),
links as (select e.src_id, e.id from all_edges e join part_channels p on p.id = e.id
          where e.broadcast and e.username <> '' and e.id % 3 <> 0 and e.id % 23 <> 0 and p.subscribers_count >= {B.MIN_PRICE}),
walk as (select id, 0 as round from part_channels where id % 3 = 0 and status = 'pending' and id % 23 <> 0 and broadcast
         union select l.id, w.round + 1 from walk w join links l on l.src_id = w.id where w.round < 60),
first as (select id, min(round) as round from walk group by id),
walked as (
  select id, title, status, cast(null as boolean) as is_author_blog, 0 as round, status = 'pending' as claimed, id % 23 = 0 or not broadcast as odd from part_channels where id % 3 = 0
  union all
  select p.id, p.title, 'pending', coalesce(a.is_author_blog, false), f.round, true, false
  from first f join part_channels p on p.id = f.id left join ({AUTHORS}) a on a.id = f.id where f.round > 0)
"""
WALK_STATUS = "case when claimed {0} then (case when odd then 'rejected' else 'ready_for_parsing' end) else status end"


@query(f"{WALK} select id, title, {WALK_STATUS.format('')} as status, is_author_blog, round from walked")
def expand_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rounds through the table until no channel is pending."""
    channels = filled(jobs.channel_store(spark, home(spark, "grown"), 8), known_parts(spark, sf_dir))
    raw, messages = B.raw_parts(spark, sf_dir), B.document_messages(spark, sf_dir)
    found = discovery.expand_all(channels, raw, B.edges(spark, sf_dir), messages, clock(), SEED, B.MIN_PRICE, B.LEXICON, B.WORDS_NEEDED)
    return channels.read().join(found, "id", "left").select("id", "title", "status", "is_author_blog", F.coalesce("round", F.lit(0)).alias("round"))


# --- embedding and search ------------------------------------------------------------------------------------------

WEIGHTS = f"""
select post_id, bucket, n / sqrt(sum(n * n) over (partition by post_id)) as weight from (
  select post_id, (('0x' || substr(md5(word), 1, 8))::bigint % {DIMENSION})::int as bucket, count(*) as n
  from (select doc_id as post_id, unnest(regexp_split_to_array(lower(text), '{WORDS}')) as word from documents) where word <> '' group by 1, 2)
"""


def entries(frame: DataFrame) -> DataFrame:
    """The non-zero entries of vectors, as rows."""
    listed = frame.select("post_id", F.posexplode("vector").alias("bucket", "weight")).where("weight <> 0")
    return listed.select("post_id", "bucket", F.round(F.col("weight").cast("double"), 6).alias("weight"))


def document_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.document_messages(spark, sf_dir).select(F.col("id").alias("post_id"), "channel_id", F.col("message").alias("content"))


@query(f"select post_id, bucket, round(weight, 6) as weight from ({WEIGHTS})")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(embed.hash_vectors(document_posts(spark, sf_dir), "post_id", "content", DIMENSION))


@query(f"select e.post_id, bucket, round(weight::float::double, 5) as weight, cast(substr(source, 4) as bigint) as channel_id, text from ({WEIGHTS}) e join documents d on d.doc_id = e.post_id where trim(text) <> ''")
def embed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = embed.embed_posts(document_posts(spark, sf_dir), DIMENSION)
    rows = points.select("post_id", F.posexplode("vector").alias("bucket", "weight"), "channel_id", "text").where("weight <> 0")
    return rows.withColumn("weight", F.round(F.col("weight").cast("double"), 5))


def letter_encoder() -> embed.Encoder:
    """Counts of letters; a text that holds symbols only an encoder without them could read fails."""
    import numpy as np

    def run(texts: list[str]) -> np.ndarray:
        if any("$$$" in t for t in texts):
            raise ValueError("unreadable text")
        return np.array([[t.lower().count(chr(97 + k)) for k in range(26)] for t in texts], dtype=np.float32)

    return run


FALLBACK = """
select doc_id as post_id, not contains(text, '$$$') as encoded, case when not contains(text, '$$$') then length(regexp_replace(lower(text), '[^a-z]', '', 'g'))::double end as letters,
  case when contains(text, '$$$') then 'unreadable text' end as error
from documents where trim(text) <> ''
"""


@query(FALLBACK)
def embed_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding job with a plugged-in encoder: points and failures come from two tables."""
    vectors, failures = jobs.vector_store(spark, home(spark, "vectors"), 8), jobs.failure_store(spark, home(spark, "failures"), 8)
    jobs.embed_into(document_posts(spark, sf_dir), vectors, failures, letter_encoder, 26)
    letters = F.aggregate("vector", F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    good = vectors.read().select("post_id", F.lit(True).alias("encoded"), letters.alias("letters"), F.lit(None).cast("string").alias("error"))
    return good.union(failures.read().select("post_id", F.lit(False), F.lit(None).cast("double"), "error"))


def topk_sql(where: str) -> str:
    score = "list_cosine_similarity(p.embedding::double[], q.embedding::double[])"
    return f"""
select query_id, post_id, round(score, 6) as score, rank from (
  select q.vec_id as query_id, p.vec_id as post_id, {score} as score, row_number() over (partition by q.vec_id order by {score} desc, p.vec_id)::int as rank
  from embeddings p, embeddings q where q.vec_id % 20 = 0 {where}) where rank <= 5
"""


def topk_of(spark: SparkSession, sf_dir: str, channel_id: int | None) -> DataFrame:
    points = B.vectors(spark, sf_dir)
    queries = points.where("post_id % 20 = 0").select(F.col("post_id").alias("query_id"), "vector")
    return search.cosine_topk(points, queries, 5, channel_id).withColumn("score", F.round("score", 6))


@query(topk_sql(""))
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_of(spark, sf_dir, None)


@query(topk_sql("and p.label = 3"))
def cosine_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_of(spark, sf_dir, 3)


# --- streaming -----------------------------------------------------------------------------------------------------


def ingested(spark: SparkSession, sf_dir: str, embed: bool) -> tuple[Store, Store | None]:
    """Posts and vectors after messages have arrived in files, some of them twice; the final state is that of one batch."""
    landed, own = home(spark, "landed"), home(spark, "posts")
    messages = B.event_messages(spark, sf_dir)
    for part in ("id % 2 = 0", "id % 2 = 1", "id % 10 = 0"):
        messages.where(part).write.mode("append").parquet(landed)
    posts = jobs.post_store(spark, f"{own}/posts", 8)
    vectors = jobs.vector_store(spark, f"{own}/vectors", 8) if embed else None
    jobs.start_ingest(bronze.stream_raw(spark, "raw_messages", landed), posts, vectors, f"{own}/checkpoint", B.NOW, DIMENSION).awaitTermination()
    return posts, vectors


@query(f"select channel_id, message_id, content, published_at, views, reactions_count, created_at, updated_at from (select *, {NOW} as created_at, {NOW} as updated_at from ({POST_ROWS}))")
def stream_post_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts, _ = ingested(spark, sf_dir, False)
    return shown(posts.read()).select("channel_id", "message_id", "content", "published_at", "views", "reactions_count", "created_at", "updated_at")


@query(f"""
select channel_id, message_id, bucket, round((n / sqrt(sum(n * n) over (partition by message_id)))::float::double, 5) as weight, content as text from (
  select channel_id, message_id, content, (('0x' || substr(md5(word), 1, 8))::bigint % {DIMENSION})::int as bucket, count(*) as n
  from (select channel_id, message_id, content, unnest(regexp_split_to_array(lower(content), '{WORDS}')) as word from ({POST_ROWS}) where trim(content) <> '') where word <> '' group by all)
""")
def stream_post_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding leg of the ingest: the points of posts with text."""
    posts, vectors = ingested(spark, sf_dir, True)
    keys = posts.read().select(F.col("id").alias("post_id"), "message_id")
    rows = vectors.read().join(keys, "post_id").select("channel_id", "message_id", F.posexplode("vector").alias("bucket", "weight"), "text").where("weight <> 0")
    return rows.withColumn("weight", F.round(F.col("weight").cast("double"), 5))


@query(f"{WALK} select id, title, {WALK_STATUS.format('and id in (select src_id from all_edges)')} as status, is_author_blog from walked")
def stream_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations arrive in files, a source's in several of them, and expand all that they reach."""
    landed, own = home(spark, "edges"), home(spark, "grown")
    B.edges(spark, sf_dir).repartition(3, F.col("cand.id")).write.parquet(landed)
    channels = filled(jobs.channel_store(spark, f"{own}/channels", 8), known_parts(spark, sf_dir))
    stores = channels, jobs.edge_store(spark, f"{own}/edges", 8), jobs.id_store(spark, f"{own}/expanded", 8)
    feed = bronze.stream_raw(spark, "recommendations", landed, files_per_batch=1)
    raw, messages = B.raw_parts(spark, sf_dir), B.document_messages(spark, sf_dir)
    jobs.start_expansion(feed, *stores, raw, messages, f"{own}/checkpoint", B.LATER, SEED, B.MIN_PRICE, B.LEXICON, B.WORDS_NEEDED).awaitTermination()
    return channels.read().select("id", "title", "status", "is_author_blog")
