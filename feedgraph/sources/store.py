"""Keyed tables as append-only Parquet folders.

A write of k rows is a new folder of k rows, partitioned by a bucket of the key; nothing that is there is read or
rewritten. Reading resolves each key: the latest row gives the values, the first one the columns that stay, patches set
a few columns of rows that are there, and deletions hide what came before them. Spark groups by key for that, with
map-side combine, so no task depends on a bucket's size. Compaction writes the resolved rows as one folder that stands
for all before it; Spark splits large buckets among tasks and files by bytes.

Folders appear by one rename, when they are complete. Each write has a number of its own, reserved by an exclusively
created marker file. A write may carry a tag (name, number): a second one with the same name and no greater number
changes nothing, so a replayed micro-batch is harmless.
"""

from __future__ import annotations

import os
import re
import tempfile
import time
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUT, PATCH, DROP = 0, 1, 2
FOLDER = re.compile(r"write=(base|delta|drop)-(\d{12})(?:-(.+)-(\d+))?")


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint directory, which driver and executors share. Where none is set, a session on one machine
    gets a temporary one; on a cluster that could not be shared, so it is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the checkpoint directory."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


class Store:
    """A table under a path. keep: columns that stay as a key's first row has them; patch: columns that partial rows may
    set; newer_by: the column by which later rows win (else by the order of writes); bucket_by: columns of the key that
    choose the bucket (else all)."""

    def __init__(
        self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], keep: Sequence[str] = (), patch: Sequence[str] = (), newer_by: str | None = None, buckets: int = 64,
        bucket_by: Sequence[str] | None = None,
    ) -> None:
        self.spark, self.path, self.keys, self.keep, self.patched, self.newer_by, self.buckets = spark, path, list(keys), list(keep), list(patch), newer_by, buckets
        self.bucket_by = list(bucket_by or keys)
        self.schema = T.StructType.fromDDL(schema)
        self.rest = [f.name for f in self.schema.fields if f.name not in {*keys, *keep, *patch}]
        self.stored = T.StructType([*self.schema.fields, T.StructField("_op", T.IntegerType()), T.StructField("_at", T.LongType()), T.StructField("write", T.StringType()), T.StructField("bucket", T.IntegerType())])

    # --- folders -------------------------------------------------------------------------------------------------------

    def _hadoop(self, path: str) -> tuple[object, object]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        files, at = self._hadoop(folder)
        return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []

    def exists(self) -> bool:
        files, at = self._hadoop(self.path)
        return files.exists(at)

    def create(self) -> Store:
        """Make the table where there is none; an existing one is left alone."""
        files, at = self._hadoop(f"{self.path}/marks")
        files.mkdirs(at)
        return self

    def folders(self) -> list[tuple[str, int, str]]:
        """Kind, number and name of the folders that count: the newest base, and what was written after it."""
        found = sorted((m[1], int(m[2]), name) for name in self._names(self.path) if (m := FOLDER.fullmatch(name)))
        base = max((n for kind, n, _ in found if kind == "base"), default=-1)
        return [f for f in found if f[1] > base or (f[0] == "base" and f[1] == base)]

    def applied(self, name: str) -> int:
        """The greatest number of the writes with this tag, -1 without any."""
        numbers = [-1]
        for kind, _, folder in self.folders():
            if kind == "base":
                numbers += [int(m[2]) for n in self._names(f"{self.path}/{folder}/_tags") if (m := re.fullmatch(r"(.+)-(\d+)", n)) and m[1] == name]
            elif (m := FOLDER.fullmatch(folder))[3] == name:
                numbers.append(int(m[4]))
        return max(numbers)

    def exclusive(self, name: str) -> bool:
        """Create an empty file; False if it is there already. Of several callers exactly one gets True."""
        files, at = self._hadoop(f"{self.path}/{name}")
        files.mkdirs(at.getParent())
        if files.getUri().getScheme() == "file":
            try:
                os.close(os.open(at.toUri().getPath(), os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
            return True
        try:
            files.create(at, False).close()
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def _reserve(self) -> int:
        number = max([*map(int, self._names(f"{self.path}/marks")), *(n for _, n, _ in self.folders())], default=-1) + 1
        while not self.exclusive(f"marks/{number:012d}"):
            number += 1
        return number

    def _publish(self, staged: str, name: str) -> None:
        files, at = self._hadoop(staged)
        if not files.rename(at, self._hadoop(f"{self.path}/{name}")[1]):
            raise OSError(f"{name} could not be put in place")

    def _delete(self, folder: str) -> None:
        files, at = self._hadoop(folder)
        files.delete(at, True)

    # --- writing -------------------------------------------------------------------------------------------------------

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def _full(self, rows: DataFrame, op: int) -> DataFrame:
        have = [f.name for f in self.schema.fields if op == PUT or f.name in self.keys or (op == PATCH and f.name in self.patched)]
        columns = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        return rows.select(*columns, F.lit(op).alias("_op"))

    def _write(self, rows: DataFrame, number: int, name: str, tags: Sequence[str] = ()) -> None:
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        try:
            placed = rows.withColumns({"_at": F.lit(number).cast("long"), "bucket": self.bucket()})
            placed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(staged)
            for tag in tags:
                files, at = self._hadoop(f"{staged}/_tags/{tag}")
                files.create(at, True).close()
            self._publish(staged, name)
        finally:
            self._delete(staged)

    def append(self, rows: DataFrame | None = None, patches: DataFrame | None = None, tag: tuple[str, int] | None = None) -> bool:
        """Put whole rows in, and patches (keys and the columns to set) on rows that are there, in one step. A key has one
        row, or newer_by decides among them. False if the tag has been applied before."""
        parts = ([self._full(rows, PUT)] if rows is not None else []) + ([self._full(patches, PATCH)] if patches is not None else [])
        return self._add("delta", parts, tag)

    def delete(self, keys: DataFrame, tag: tuple[str, int] | None = None) -> bool:
        """Hide the keys' rows; later writes may bring them back."""
        return self._add("drop", [self._full(keys.select(*self.keys).distinct(), DROP)], tag)

    def _add(self, kind: str, parts: list[DataFrame], tag: tuple[str, int] | None) -> bool:
        if tag is not None and self.applied(tag[0]) >= tag[1]:
            return False
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        number = self._reserve()
        try:
            self._write(rows, number, f"write={kind}-{number:012d}" + (f"-{tag[0]}-{tag[1]}" if tag else ""))
        except BaseException:
            self._delete(f"{self.path}/marks/{number:012d}")
            raise
        return True

    def compact(self, patience: float = 86_400.0) -> None:
        """Write the resolved rows as the folder that stands for all complete writes up to the first one that is under way,
        and remove what the compaction before this one had replaced (readers of the last state may still be busy). A write
        that has not come after so many seconds is taken for dead."""
        names = [(m[1], int(m[2]), n) for n in self._names(self.path) if (m := FOLDER.fullmatch(n))]
        live = self.folders()
        base = max((n for kind, n, _ in live if kind == "base"), default=-1)
        files, marks = self._hadoop(f"{self.path}/marks")
        recent = {int(m.getPath().getName()) for m in files.listStatus(marks) if m.getModificationTime() / 1000 > time.time() - patience}
        waiting = recent - {n for _, n, _ in live}
        upto = max((n for _, n, _ in live if not waiting or n < min(waiting)), default=base)
        if upto == base:
            return
        chosen = [f for f in live if f[1] <= upto]
        last: dict[str, int] = {}
        for kind, _, folder in chosen:
            tags = self._names(f"{self.path}/{folder}/_tags") if kind == "base" else ["-".join(filter(None, FOLDER.fullmatch(folder).groups()[2:]))]
            for m in filter(None, (re.fullmatch(r"(.+)-(\d+)", t) for t in tags)):
                last[m[1]] = max(last.get(m[1], -1), int(m[2]))
        self._write(self._full(self._resolved(chosen), PUT), upto, f"write=base-{upto:012d}", [f"{k}-{v}" for k, v in last.items()])
        for n in map(int, self._names(f"{self.path}/marks")):
            if n < upto:
                self._delete(f"{self.path}/marks/{n:012d}")
        for _, n, folder in names:
            if n < base or (n == base and not folder.startswith("write=base")):
                self._delete(f"{self.path}/{folder}")

    # --- reading -------------------------------------------------------------------------------------------------------

    def rows(self, folders: Sequence[tuple[str, int, str]] | None = None) -> DataFrame:
        """All rows as they were written, with _op, _at, and the partitions write and bucket."""
        folders = self.folders() if folders is None else folders
        if not folders:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).option("basePath", self.path).parquet(*[f"{self.path}/{name}" for _, _, name in folders])

    def _resolved(self, folders: Sequence[tuple[str, int, str]], wanted: DataFrame | None = None) -> DataFrame:
        rows = self.rows(folders)
        if wanted is not None:
            rows = rows.join(wanted, wanted.columns, "left_semi")
        if any(kind == "drop" for kind, _, _ in folders):
            gone = rows.where(F.col("_op") == DROP).groupBy(*self.keys).agg(F.max("_at").alias("_gone"))
            rows = rows.where(F.col("_op") != DROP).join(gone, self.keys, "left").where("_gone is null or _at > _gone").drop("_gone")
        by = [self.newer_by, "_at"] if self.newer_by else ["_at"]
        put = F.col("_op") == PUT
        best = {"_put": F.max(F.when(put, F.struct(*by, *[c for c in self.rest if c not in by])))}
        if self.keep:
            best["_kept"] = F.min(F.when(put, F.struct("_at", *self.keep)))
        if self.patched:
            best["_set"] = F.max(F.struct("_at", *self.patched))
        found = rows.groupBy(*self.keys).agg(*[v.alias(c) for c, v in best.items()]).where("_put is not null")
        places = dict.fromkeys(self.rest, "_put") | dict.fromkeys(self.keep, "_kept") | dict.fromkeys(self.patched, "_set")
        return found.select(*[F.col(f"{places[f.name]}.{f.name}") if f.name in places else F.col(f.name) for f in self.schema.fields])

    def read(self) -> DataFrame:
        return self._resolved(self.folders())

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The rows of the wanted keys; with bucket_by, its columns are enough. The keys' buckets prune the folders'
        partitions at run time."""
        on = self.keys if set(self.keys) <= set(wanted.columns) else self.bucket_by
        return self._resolved(self.folders(), wanted.select(*on).distinct().withColumn("bucket", self.bucket()).where("bucket >= 0"))
