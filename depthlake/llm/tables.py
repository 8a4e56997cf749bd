"""Reading the given tables and keeping intermediate ones in the shared folder."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from depthlake.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder that all executors share."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


BATCH_BYTES = 8 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside pass Arrow batches of about ``BATCH_BYTES``, then the session is as before.

    A task holds a batch several times (in the JVM, in the stream, in Python), so with whole texts or
    sets in the rows the usual 64 MB are several hundred for an executor.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Let go of what nothing refers to any more, between the phases of a long operator.

    Spark's cleaner removes shuffle files, broadcasts and checkpoints only once the driver has
    collected the objects that stand for them, which it would else do when its heap is full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fold(doc_id, n: int):
    """crc32 of the id's decimal text, modulo n: the held-out rule of the classifiers."""
    return F.crc32(F.col(doc_id).cast("string")) % n


def bounded_sample(labelled: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows in an order that only depends on the key's hash (a top-k, no full sort)."""
    return labelled.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(limit)


def per_class_sample(labelled: DataFrame, key: str, label: str, total: int) -> tuple[DataFrame, dict]:
    """About ``total / classes`` rows of each class, chosen by the hash of the key, and the row count of each class.

    The class list is what a classifier predicts, so it is read by the driver; rows are not.
    """
    counts = {r[label]: r["n"] for r in labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return labelled.limit(0), {}
    quota = total / len(counts)
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, quota / n))).otherwise(share)
    place = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return labelled.filter(place < share), counts
