"""Tables of chunks and events on Parquet: keyed upserts, deletes, append-only logs.

A table is a folder of data and of numbered pointers, one for each version.  A pointer names the folder of each bucket; a version is there once
its pointer is, and of two writers that start from one version only one can make the next pointer.  Paths go through the Hadoop file system of the session.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators.state import upsert

CHUNK_COLUMNS = "chunk_id string, file_hash string, file_path string, filename string, doc_type string, chunk_index int, total_chunks int, text string, section_path string, embedding array<float>, collection string"


class LostRace(RuntimeError):
    """Another writer made the next version first; nothing of this write is visible."""


@dataclass(frozen=True)
class Snapshot:
    """A version of a table: its number (0: none yet), how many buckets it has, and the folder of each bucket that holds rows."""

    number: int
    buckets: int
    folders: dict[int, str]


class BucketedTable:
    """A Parquet table whose rows lie in buckets by the hash of one column; a write touches only the buckets it needs.

    `buckets` counts when the table is made; later the table's own number holds.  Choose it so that a bucket is what a batch may rewrite.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, bucket_by: str, buckets: int = 64, sort_by: tuple[str, ...] = ()):
        self.spark, self.path, self.schema, self.bucket_by, self.buckets, self.sort_by = spark, path.rstrip("/"), schema, bucket_by, buckets, sort_by
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._read_all = jvm.org.apache.commons.io.IOUtils.toByteArray

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._path(self.path)):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(self.path)))
        return sorted(int(n.removeprefix("current-")) for n in names if n.startswith("current-"))

    def _at(self, number: int) -> Snapshot | None:
        """The version of that number; None for a pointer that was not written to its end."""
        stream = self._fs.open(self._path(f"{self.path}/current-{number}"))
        try:
            own = json.loads(bytes(self._read_all(stream)).decode())
        except ValueError:
            return None
        finally:
            stream.close()
        return Snapshot(number, own["buckets"], {int(k): v for k, v in own["folders"].items()})

    def snapshot(self) -> Snapshot:
        for number in reversed(self._numbers()):
            if (found := self._at(number)) is not None:
                return found
        return Snapshot(0, self.buckets, {})

    def _load(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, at: Snapshot | None = None) -> DataFrame:
        return self._load(list((at or self.snapshot()).folders.values()))

    def _bucket(self, at: Snapshot) -> Column:
        return F.pmod(F.xxhash64(F.col(self.bucket_by)), F.lit(at.buckets)).cast("int")

    def _commit(self, rows: DataFrame, touched: list[int], base: Snapshot) -> None:
        """Write `rows` as the touched buckets and make the version after `base`."""
        folder = f"data/{uuid.uuid4().hex}"
        placed = rows.withColumn("_bucket", self._bucket(base)).hint("rebalance", "_bucket").sortWithinPartitions("_bucket", *self.sort_by)
        placed.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        made = {s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{folder}"))}
        folders = {k: v for k, v in base.folders.items() if k not in touched} | {k: f"{folder}/_bucket={k}" for k in touched if f"_bucket={k}" in made}
        number = max([base.number, *(n for n in self._numbers() if n > base.number and self._at(n) is None)]) + 1
        try:
            stream = self._fs.create(self._path(f"{self.path}/current-{number}"), False)
        except Py4JJavaError as error:
            self._fs.delete(self._path(f"{self.path}/{folder}"), True)
            raise LostRace(f"version {number} of {self.path} is there already") from error
        stream.write(json.dumps({"buckets": base.buckets, "folders": {str(k): v for k, v in folders.items()}}).encode())
        stream.close()
        self._clean({*folders.values(), *base.folders.values()}, number - 1)

    def _clean(self, live: set[str], oldest: int) -> None:
        """Drop pointers before `oldest` and what only they name: readers of the version before the last are not disturbed."""
        for number in self._numbers():
            if number < oldest:
                old = self._at(number)
                for folder in set(old.folders.values() if old else ()) - live:
                    self._fs.delete(self._path(f"{self.path}/{folder}"), True)
                self._fs.delete(self._path(f"{self.path}/current-{number}"), False)

    def upsert(self, incoming: DataFrame, keys: list[str], order: list[str], at: Snapshot | None = None) -> None:
        """Put rows in by key; of several incoming rows with one key the first in `order` counts.  Rows of one key must agree in the bucket column."""
        base = at or self.snapshot()
        once = incoming.persist()
        try:
            touched = [r[0] for r in once.select(self._bucket(base).alias("b")).distinct().collect()]  # at most `buckets` rows
            if touched:
                self._commit(upsert(self._load([base.folders[k] for k in touched if k in base.folders]), once, keys, order), touched, base)
        finally:
            once.unpersist()

    def delete_value(self, value, at: Snapshot | None = None) -> None:
        """Drop the rows whose bucket column equals `value`; one bucket is rewritten."""
        base = at or self.snapshot()
        kind = self._load([]).schema[self.bucket_by].dataType
        bucket = self.spark.range(1).select(F.lit(value).cast(kind).alias(self.bucket_by)).select(self._bucket(base)).first()[0]
        if bucket in base.folders:
            self._commit(self._load([base.folders[bucket]]).where(~F.col(self.bucket_by).eqNullSafe(F.lit(value))), [bucket], base)

    def delete(self, condition: Column, at: Snapshot | None = None) -> None:
        """Drop the rows for which the condition is true; only buckets that hold such rows are rewritten."""
        base = at or self.snapshot()
        gone = F.coalesce(condition, F.lit(False))
        touched = [r[0] for r in self.read(base).where(gone).select(self._bucket(base).alias("b")).distinct().collect()]  # at most `buckets` rows
        if touched:
            self._commit(self._load([base.folders[k] for k in touched]).where(~gone), touched, base)

    def drop(self) -> bool:
        """Remove the table; false if there was none."""
        return bool(self._fs.exists(self._path(self.path)) and self._fs.delete(self._path(self.path), True))


class EventLog:
    """An append-only Parquet log; each batch has a name and counts once, however often it is written."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def append(self, df: DataFrame, batch: str | int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def read(self) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.path)


def chunk_table(spark: SparkSession, path: str, buckets: int = 64) -> BucketedTable:
    """Chunks in buckets by file, sorted by collection; a chunk_id is made from its file's hash, so copies of one id share a bucket."""
    return BucketedTable(spark, path, CHUNK_COLUMNS, "file_hash", buckets, ("collection",))


def upsert_chunks(table: BucketedTable, chunks: DataFrame) -> None:
    """By chunk_id; of several incoming rows with one id the lowest chunk_index counts."""
    table.upsert(chunks, ["chunk_id"], ["chunk_index"])


def delete_file(table: BucketedTable, file_hash: str) -> None:
    table.delete_value(file_hash)


def without_files(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """`chunks` without those of the files (file_hash) named; a null hash names none."""
    return chunks.join(files.select("file_hash").distinct(), "file_hash", "left_anti")


def append_messages(sessions: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) after `new` messages came in: msg_count grows by their number and updated_at moves to the last of them.

    Messages of sessions that are not there, or of none, are added all the same; a null count counts as 0, and updated_at never moves back.
    """
    came = new.where("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"), F.max("created_at").alias("_at"))
    moved = sessions.join(came, "session_id", "left").withColumns({"msg_count": F.coalesce("msg_count", F.lit(0)) + F.coalesce("_n", F.lit(0)), "updated_at": F.greatest("updated_at", "_at")})
    return moved.select(*sessions.columns), messages.unionByName(new.select(*messages.columns))


def add_sessions(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Sessions of `new` whose id is not there yet, added; the first insert stands."""
    fresh = new.where("session_id is not null").dropDuplicates(["session_id"]).join(existing.select("session_id"), "session_id", "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def last_values(events: DataFrame, value: str) -> DataFrame:
    """The last title or summary of each session from events (session_id, value, at); an aggregate, ties to the larger value."""
    return events.where("session_id is not null").groupBy("session_id").agg(F.max_by(value, F.struct("at", value)).alias(value), F.max("at").alias("updated_at"))


def with_columns(df: DataFrame, defaults: dict) -> DataFrame:
    """Columns that are not there yet, added with a default; others stay."""
    return df.withColumns({k: F.lit(v) for k, v in defaults.items() if k not in df.columns})
