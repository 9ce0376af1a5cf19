"""WARC archives and their external index.

Pages are written as gzipped WARC/1.1 files: a record is one line of Spark's text writer, whose line separator is the blank
lines that end a record, so the files are ordinary archives on any file system that Spark can write. Of equal payloads
the smallest page is a response and the others revisit it. A task closes an archive as soon as it has ``archive_bytes``,
so an archive is that long at most, and one record more. The archives are then read back, each file whole, and parsed by
Content-Length.

Each archive yields a capture run sorted by (URL key, time, page). A range of URL keys receives its stretch of every
run and merges them by a loser tree, which gives globally ordered capture histories. There are as many ranges as keep
each at about ``range_rows`` captures, however large the index is, and they are split by time and page too, so one host
or URL may fill many.

Defined results. Null html is an empty payload; null url is the empty URL. Payloads below ``min_revisit_bytes`` are all
responses. Repeated rows are records of their own; every record of the smallest page_id is a response. Rows without
page_id are archived without an id, as responses. Extra columns are ignored; an empty table works.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from feedgraph.llm import kernel
from feedgraph.llm.scratch import Scratch

ARCHIVE_BYTES, HEAD_BYTES, RANGE_ROWS = 32 << 20, 600, 50_000
CRLF, END = "\r\n", "\r\n\r\n"
RECORDS = "page_id long, url string, captured string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, place long"
HISTORY = RECORDS + ", url_key string, run string, history_pos long"


def base32(digest: Column) -> Column:
    """Bare upper-case base32 of a hexadecimal SHA-1, in built-in functions: five digits are four base32 digits."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = [F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 10).cast("int") for i in range(8)]
    letter = lambda g, by: F.substring(F.lit(alphabet), F.shiftright(g, by).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*[letter(g, by) for g in groups for by in (15, 10, 5, 0)])


def with_types(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Adds payload_bytes, payload_digest, record_type and refers_to. Which page comes first is found on digests alone;
    the pages move once, by page, so that a payload of very many pages is spread as any other."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), F.length(html).cast("long").alias("payload_bytes"),
        F.sha1(html).alias("digest"), F.coalesce("page_id", F.lit(-(2**63))).alias("key"),
    )
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first_page"))
    known = rows.select("key", "digest").distinct().join(first, "digest")
    revisit = (F.col("payload_bytes") >= min_revisit_bytes) & (F.col("page_id") > F.col("first_page"))
    return rows.join(known, ["key", "digest"]).select(
        "page_id", "url", "html", "payload_bytes", base32(F.col("digest")).alias("payload_digest"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_page")).alias("refers_to")
    )


def record(min_second: int = 1_700_000_000) -> Column:
    """The record as text, without the blank lines that end it. The capture time counts seconds by page_id."""
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.timestamp_seconds(F.lit(min_second) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.col("payload_bytes").cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(END), "html")


def _cut(batches: Iterator[pa.RecordBatch], archive_bytes: int) -> Iterator[pa.RecordBatch]:
    """Adds the archive that a page goes to: a new one as soon as the last has enough bytes."""
    from pyspark import TaskContext

    task, number, size = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        names = []
        for n in batch.column("payload_bytes").to_pylist():
            if size >= archive_bytes:
                number, size = number + 1, 0
            names.append(f"{task:06d}-{number:06d}")
            size += n + HEAD_BYTES
        yield batch.append_column("archive", pa.array(names, type=pa.string()))
    kernel.release()


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write typed pages as gzipped archives, each in a folder of its own."""
    schema = StructType([*pages.schema.fields, StructField("archive", StringType())])
    cut = pages.mapInArrow(lambda it: _cut(it, archive_bytes), schema)
    cut.select(record().alias("value"), "archive").write.option("lineSep", END).option("compression", "gzip").partitionBy("archive").text(path)


def parse(archive: str, data: bytes) -> Iterator[tuple]:
    """The records of an archive: its fields, then its place in the file; digests are taken of the payload as read."""
    at = 0
    while at < len(data):
        head_end = data.index(END.encode(), at)
        version, *lines = data[at:head_end].decode().split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at {at} of {archive}")
        head = dict(line.split(": ", 1) for line in lines)
        start, size = head_end + len(END), int(head["Content-Length"])
        payload = data[start : start + size]
        if len(payload) != size or data[start + size : start + size + len(END)] != END.encode():
            raise ValueError(f"the record at {at} of {archive} is cut off")
        page, refers = (head.get(k, "<urn:page:>")[10:-1] for k in ("WARC-Record-ID", "WARC-Refers-To"))
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if head["WARC-Payload-Digest"] != f"sha1:{digest}":
            raise ValueError(f"the payload at {at} of {archive} has another digest")
        yield int(page) if page else None, head["WARC-Target-URI"], head["WARC-Date"], size, digest, head["WARC-Type"], int(refers) if refers else None, archive, at
        at = start + size + len(END)


def _parse_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = kernel.arrow_schema(RECORDS)
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rows = list(parse(path.split("/archive=", 1)[-1].split("/", 1)[0], gzip.decompress(content.as_buffer())))
            yield from kernel.batches(schema, [{f.name: [r[i] for r in rows] for i, f in enumerate(schema)}])
    kernel.release()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_parse_all, RECORDS)


def url_key(url: Column) -> Column:
    """Host labels in reverse, then the path and query; scheme, www and fragment do not count."""
    bare = F.lower(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://|#.*$", ""))
    host = F.regexp_replace(F.regexp_extract(bare, r"^([^/?]*)", 1), r"^www\d*\.", "")
    rest = F.regexp_extract(bare, r"^[^/?]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


class LoserTree:
    """K-way merge of sorted lists: inner nodes hold the loser of their match, so a step replays one path only."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs = [iter(r) for r in runs]
        self.k = len(runs)
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [-1] * self.k
        for run in range(self.k - 1, -1, -1):
            self._play(run)

    def _beats(self, a: int, b: int) -> bool:
        if b == -1 or self.heads[a] is None:
            return b != -1 and self.heads[b] is None and a < b
        return self.heads[b] is None or (self.heads[a], a) < (self.heads[b], b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            rival = self.losers[node]
            if rival == -1:
                self.losers[node] = winner
                return
            if not self._beats(winner, rival):
                self.losers[node], winner = winner, rival
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.losers[0]] is not None:
            run = self.losers[0]
            yield self.heads[run]
            self.heads[run] = next(self.runs[run], None)
            self._play(run)


def _merge(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Merge the runs' stretches of one range. Within a run rows keep the order of their numbers."""
    table = pa.Table.from_batches(list(batches), schema=schema)
    keys = list(zip(*[table.column(c).to_pylist() for c in ("url_key", "captured", "page")], range(table.num_rows), strict=True))
    runs: dict[str, list[tuple[int, tuple]]] = {}
    for run, number, key in zip(table.column("run").to_pylist(), table.column("number").to_pylist(), keys, strict=True):
        runs.setdefault(run, []).append((number, key))
    merged = LoserTree([[key for _, key in sorted(rows)] for _, rows in sorted(runs.items())])
    order = [key[-1] for key in merged]
    ordered = table.take(pa.array(order, type=pa.int64()))
    yield from ordered.append_column("nth", pa.array(range(len(order)), type=pa.int64())).combine_chunks().to_batches()


def capture_histories(records: DataFrame, scratch: Scratch, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Records with url_key, the archive run they come from, and their place in the whole ordered index (from 0)."""
    from pyspark.sql import Window

    keyed = records.withColumns({"url_key": url_key(F.col("url")), "page": F.coalesce("page_id", F.lit(-1)), "run": F.col("archive")})
    in_run = Window.partitionBy("run").orderBy("url_key", "captured", "page", "place")
    runs = scratch.keep(keyed.withColumn("number", F.row_number().over(in_run)), "runs")
    ranges = runs.repartitionByRange(max(1, -(-runs.count() // range_rows)), "url_key", "captured", "page", "run", "number")
    schema = pa.schema([*kernel.arrow_schema(RECORDS + ", url_key string, page long, run string"), pa.field("number", pa.int32())])
    ddl = RECORDS + ", url_key string, page long, run string, number int"
    merged = ranges.select(*schema.names).mapInArrow(lambda it: _merge(it, schema), ddl + ", nth long")
    kept = scratch.keep(merged.withColumn("range", F.spark_partition_id()), "merged")
    scratch.drop("runs")
    counts = kept.groupBy("range").count()
    before = counts.select("range", (F.sum("count").over(Window.orderBy("range")) - F.col("count")).alias("before"))  # a row for each range
    return kept.join(before, "range").withColumn("history_pos", F.col("before") + F.col("nth")).select(*kernel.arrow_schema(HISTORY).names)


def archive_pages(pages: DataFrame, min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Write pages as archives, read them back, and return every record with its place in the merged index."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    write_archives(with_types(pages, min_revisit_bytes), scratch.path("archives"), archive_bytes)
    return capture_histories(read_archives(spark, scratch.path("archives")), scratch, range_rows)


ORACLE = r"""
with bytes as (select page_id, coalesce(url, '') as url, coalesce(html, '') as html from pages),
hashed as (select page_id, url, strlen(html) as payload_bytes, sha1(html) as hex from bytes),
digested as (
  select page_id, url, payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((('0x' || substr(hex, 1 + 5 * (i // 4)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31) + 1)::int, 1)), 'string_agg', '') as payload_digest
  from hashed),
typed as (select *, min(page_id) over (partition by payload_digest) as first_page from digested),
bare as (select *, lower(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://|#.*$', '', 'g')) as b from typed),
parts as (select *, regexp_replace(regexp_extract(b, '^([^/?]*)', 1), '^www[0-9]*\.', '') as host, regexp_extract(b, '^[^/?]*(.*)$', 1) as rest from bare),
keyed as (select *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || case when rest = '' then '/' else rest end as url_key from parts)
select page_id, payload_bytes, payload_digest, case when page_id > first_page then 'revisit' else 'response' end as record_type,
  case when page_id > first_page then first_page end as refers_to, url_key, row_number() over (order by url_key, page_id) - 1 as history_pos
from keyed
"""
