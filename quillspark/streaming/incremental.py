"""Incremental operation: upserts of deliveries, windowed counts with late data, duplicates within a watermark.

The ledger's incremental refresh maps to micro-batches; windows and watermarks go beyond what it has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators import corpus


def read_deliveries(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, at: str, keys: list[str], window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts per window and keys; events later than the watermark are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(at, late).groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("n"))


def without_repeats(events: DataFrame, at: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first delivery of each key; state is kept for the watermark's length only."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def upsert_batches(deliveries: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Merge each micro-batch of (citekey, pdf_hash) into a ledger (citekey, pdf_hash, status).

    read gives the ledger, write replaces it; a repeated batch after a failure gives the same ledger.
    """

    def merge(batch: DataFrame, _: int) -> None:
        ledger = read()
        latest = batch.groupBy("citekey").agg(F.max("pdf_hash").alias("pdf_hash"))
        state = corpus.upsert(ledger, latest)
        hashes = ledger.select("citekey", F.col("pdf_hash").alias("old_hash")).join(latest.withColumnRenamed("pdf_hash", "new_hash"), "citekey", "full_outer")
        write(state.join(hashes, "citekey").select("citekey", F.coalesce("new_hash", "old_hash").alias("pdf_hash"), "status"))

    return deliveries.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
