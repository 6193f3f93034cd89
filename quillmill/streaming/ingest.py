"""Continuous ingestion: new files to chunks, once for each content, with a state log and retries."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.chunking import chunk_documents
from quillmill.functions.cleaning import clean
from quillmill.functions.embedding import Embedder, embed_texts
from quillmill.operators.state import backoff_seconds, collection_counts, failed_for_retry, latest_state, not_ingested, status_counts
from quillmill.plans.lineage import cut
from quillmill.sources.files import PdfReader, collection_for, extract_documents, scan_folder, watch_folder
from quillmill.sources.sinks import EventLog, chunk_table, upsert_chunks

STATE_SCHEMA = "file_path string, file_hash string, status string, attempt_count int, last_attempt timestamp, error_msg string, chunk_count int"
MAX_RETRIES = 3


class Ingestor:
    """Takes batches of files into a chunk table and a state log under `store`.

    Each attempt writes `processing` before it begins and `done` or `failed` when it ends; chunks are written before the latter.  All writes are
    idempotent by chunk_id and by batch and attempt, so a batch that is run again after a crash gives the same tables.
    """

    def __init__(self, spark: SparkSession, root: str, store: str, embed: Embedder | None = None, pdf_reader: PdfReader | None = None, sleep: Callable[[float], None] = time.sleep):
        self.spark, self.root, self.embed, self.pdf_reader, self.sleep = spark, root, embed, pdf_reader, sleep
        self.chunks = chunk_table(spark, f"{store}/chunks")
        self.log = EventLog(spark, f"{store}/state", STATE_SCHEMA)

    def state(self) -> DataFrame:
        return latest_state(self.log.read())

    def pending(self, files: DataFrame) -> DataFrame:
        """One file for each content that is not done and has attempts left."""
        tries = self.state().where("status in ('failed', 'processing')").groupBy("file_hash").agg(F.max(F.when(F.col("status") == "failed", F.col("attempt_count")).otherwise(F.col("attempt_count") - 1)).alias("tries"))
        once = not_ingested(files, self.state()).dropDuplicates(["file_hash"]).join(tries, "file_hash", "left")
        return once.withColumn("attempt", F.coalesce("tries", F.lit(0)) + 1).where(F.col("attempt") <= MAX_RETRIES).drop("tries")

    def attempt(self, files: DataFrame, name: str) -> int:
        """One attempt at every pending file; how many failed and have attempts left."""
        files = cut(self.pending(files))
        begun = files.select("file_path", "file_hash", F.lit("processing").alias("status"), F.col("attempt").cast("int").alias("attempt_count"), F.current_timestamp().alias("last_attempt"), F.lit(None).cast("string").alias("error_msg"), F.lit(None).cast("int").alias("chunk_count"))
        self.log.append(begun, f"{name}-begun")
        docs = extract_documents(files, self.pdf_reader).join(files.select("file_hash", "attempt"), "file_hash").withColumn("text", clean(F.col("raw_text"))).persist()
        good = docs.where("error is null and text <> ''")
        pieces = embed_texts(chunk_documents(good), "text", "embedding", self.embed, batch_size=32)
        pieces = pieces.withColumn("collection", collection_for(F.col("file_path"), self.root)).persist()
        try:
            upsert_chunks(self.chunks, pieces)
            counts = pieces.groupBy("file_hash").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
            events = docs.join(counts, "file_hash", "left").select(
                "file_path", "file_hash", F.when(F.col("chunk_count") > 0, "done").otherwise("failed").alias("status"), F.col("attempt").cast("int").alias("attempt_count"), F.current_timestamp().alias("last_attempt"),
                F.when(F.coalesce("chunk_count", F.lit(0)) == 0, F.coalesce("error", F.lit("no text after cleaning"))).alias("error_msg"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
            )
            self.log.append(events, f"{name}-ended")
            return events.where((F.col("status") == "failed") & (F.col("attempt_count") < MAX_RETRIES)).count()
        finally:
            docs.unpersist()
            pieces.unpersist()

    def run_batch(self, files: DataFrame, batch: str | int) -> None:
        """All attempts at a batch of files; what fails is tried again after 2, 4, ... seconds until its attempts are used up."""
        for number in range(1, MAX_RETRIES + 1):
            if not self.attempt(files, f"{batch}-{number}"):
                break
            self.sleep(backoff_seconds(number))

    def stream(self, checkpoint: str, on_batch: Callable[[int], None] | None = None, interval: str | None = None):
        """Start a query that takes in all files there are and stops or, with an `interval` such as "5 seconds", goes on looking for new ones."""

        def each(files: DataFrame, batch: int) -> None:
            self.run_batch(files, f"stream-{batch}")
            if on_batch:
                on_batch(batch)

        writer = watch_folder(self.spark, self.root).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()

    def retry(self, files: DataFrame, batch: str) -> None:
        """Take failed files with attempts left up again."""
        again = failed_for_retry(self.state(), MAX_RETRIES).select("file_hash").distinct()
        self.attempt(files.join(again, "file_hash", "left_semi"), batch)

    def diagnostics(self) -> tuple[DataFrame, DataFrame]:
        """(status, n) and (collection, chunks) as they are now."""
        return status_counts(self.state()), collection_counts(self.chunks.read())

    def _every(self, interval: str, checkpoint: str, act: Callable[[int], None]):
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(lambda _, number: act(number)).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()

    def sweep(self, checkpoint: str, interval: str = "300 seconds"):
        """Start a query that takes failed files of the folder up again at each interval."""
        return self._every(interval, checkpoint, lambda number: self.retry(scan_folder(self.spark, self.root), f"sweep-{uuid.uuid4().hex}"))

    def rescan(self, checkpoint: str, interval: str = "60 seconds", quiet_seconds: float = 2.0):
        """Start a query that looks through the whole folder at each interval: files changed in place have a new hash and are taken in; those changed just now wait."""
        return self._every(interval, checkpoint, lambda number: self.run_batch(scan_folder(self.spark, self.root, quiet_seconds), f"rescan-{uuid.uuid4().hex}"))

    def watch_diagnostics(self, report: Callable[[DataFrame, DataFrame], None], checkpoint: str, interval: str = "60 seconds"):
        """Start a query that hands the diagnostics to `report` at each interval."""
        return self._every(interval, checkpoint, lambda number: report(*self.diagnostics()))
