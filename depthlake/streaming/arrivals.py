"""Incremental work as Structured Streaming: discovery, bounded batches, resumable processing, duplicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

BATCH_FILES = 24


def new_records(known: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Found records that are not known yet."""
    return found.join(known.select(key), key, "left_anti")


def merge_discovery(known: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Known records kept as they are, new ones appended."""
    return known.unionByName(new_records(known, found, key).select(*known.columns))


def file_stream(spark: SparkSession, path: str, schema: str, *, fmt: str = "parquet", files: int = BATCH_FILES) -> DataFrame:
    """Files as a stream in bounded batches."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(path)


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything that has arrived and stop; a rerun goes on where this one ended."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def status_batch(work: Callable[[DataFrame], DataFrame], target: str, key: str) -> Callable[[DataFrame, int], None]:
    """Batch writer that records an outcome per item.

    ``work`` returns the items with an ``error`` column (NULL when done).  A batch overwrites
    only its own partition, so replays after a failure do not double rows.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        done = work(batch).select(key, F.coalesce("error", F.lit("")).alias("error"), F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"))
        done.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return run


def latest_status(outcomes: DataFrame, key: str) -> DataFrame:
    """Latest outcome per item over all batches."""
    return outcomes.groupBy(key).agg(F.max_by(F.struct("status", "error"), "batch").alias("s")).select(key, "s.status", "s.error")


def drop_repeats(stream: DataFrame, digest: str, time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Suppress equal content across arrivals.

    Without ``time`` the state is one row per distinct content and has no end, so a repeat is dropped
    however late it comes, and a restart from the same checkpoint goes on with it; see
    :func:`keep_state_on_disk`.  With ``time`` only repeats within the watermark are known.
    """
    if time is None:
        return stream.dropDuplicates([digest])
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([digest])


def keep_state_on_disk(spark: SparkSession) -> None:
    """Streaming state in RocksDB with a change log: executors hold no state in their heap, and a batch
    writes what it changed, not all that was ever seen."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
