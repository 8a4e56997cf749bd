"""Chroma audio fingerprints of a media column (operator 4).

Recordings are 16-bit mono PCM in a binary column.  Overlapping frames are folded into twelve pitch
classes; filters over the integral image of that chromagram, each quantised to two Gray-coded bits,
give one packed 32-bit integer per frame.  Recordings with equal fingerprints are one class.  A
search takes the classes with a query row against all classes: they meet on seeds (the coarse bits
of two integers a few frames apart), a histogram of the offsets of coarsely equal integers aligns
them, and the share of wrong bits over the overlap decides.

The given tables hold no sound, so the query renders one recording of each embedding: every
component is a short tone whose pitch follows its value, and close vectors sound alike.

Defined cases: null, empty and too short recordings have an empty fingerprint, are one class each
by their id and match nothing; repeated rows are one class; a query's own class is not returned as
a match; of equal offsets the one with the most equal integers, then the least, is taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import durable, table

RATE, FRAME, HOP = 4096, 1024, 256
NOTE = 512               # samples of a rendered tone
LOWEST, HIGHEST = 220.0, 1760.0
SPAN = 16                # frames that a filter window covers
COARSE = np.uint32(0xAAAAAAAA)  # the high bit of each filter's two
SEED_GAP = 8
MOST_ERRORS = 0.2        # share of wrong bits of a match
LEAST_OVERLAP = 32       # integers that both recordings have in an alignment
QUERY_EVERY = 50


def filters() -> list[tuple[int, int, int, int]]:
    """Sixteen filters (kind, first class, classes, frames) by rule: six kinds over varied places and sizes."""
    made = []
    for i in range(16):
        height = 2 * (1 + i % 3) if i % 6 != 3 else 6
        made.append((i % 6, (5 * i) % (13 - height), height, 4 + 2 * (i % 7)))
    return made


FILTERS = filters()
STEPS = np.array([-0.35, 0.0, 0.35])  # limits of the four levels of a filter
GRAY = np.array([0, 1, 3, 2], np.uint32)


def chroma_weights() -> np.ndarray:
    """Spectrum bins to pitch classes; a bin between two classes is shared."""
    hertz = np.fft.rfftfreq(FRAME, 1 / RATE)
    use = (hertz >= LOWEST) & (hertz <= HIGHEST)
    pitch = 12 * np.log2(np.maximum(hertz, 1) / LOWEST)
    low = np.floor(pitch)
    weights = np.zeros((len(hertz), 12), np.float32)
    at = np.arange(len(hertz))
    np.add.at(weights, (at, (low % 12).astype(int)), (1 - (pitch - low)) * use)
    np.add.at(weights, (at, ((low + 1) % 12).astype(int)), (pitch - low) * use)
    return weights


def fingerprint(samples: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Packed integers of a recording, one for each window of ``SPAN`` frames."""
    if len(samples) < FRAME + HOP * (SPAN - 1):
        return np.zeros(0, np.uint32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * np.hanning(FRAME).astype(np.float32)
    power = np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32)
    chroma = power @ weights
    chroma /= np.linalg.norm(chroma, axis=1, keepdims=True) + 1e-6
    total = np.zeros((len(chroma) + 1, 13))
    total[1:, 1:] = chroma.cumsum(axis=0).cumsum(axis=1)
    n = len(chroma) - SPAN + 1
    at = np.arange(n)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return (total[at + t1, c1] - total[at + t0, c1] - total[at + t1, c0] + total[at + t0, c0]) / max(1, (t1 - t0) * (c1 - c0))

    packed = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        if kind == 0:
            a, b = area(0, w, y, y + h), area(0, w, 0, 12)
        elif kind == 1:
            a, b = area(0, w, y, y + h // 2), area(0, w, y + h // 2, y + h)
        elif kind == 2:
            a, b = area(0, w // 2, y, y + h), area(w // 2, w, y, y + h)
        elif kind == 3:
            a = (area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h)) / 2
            b = (area(0, w // 2, y + h // 2, y + h) + area(w // 2, w, y, y + h // 2)) / 2
        elif kind == 4:
            a, b = area(w // 4, w - w // 4, y, y + h), area(0, w, y, y + h)
        else:
            a, b = area(0, w, y, y + h), area(0, w, max(0, y - 1), min(12, y + h + 1))
        level = np.searchsorted(STEPS, np.log((a + 0.05) / (b + 0.05)))
        packed = (packed << np.uint32(2)) | GRAY[level]
    return packed


def seeds(packed: np.ndarray) -> np.ndarray:
    """The distinct coarse pairs of integers that stand ``SEED_GAP`` apart."""
    if len(packed) <= SEED_GAP:
        return np.zeros(0, np.int64)
    coarse = (packed & COARSE).astype(np.uint64)
    return np.unique((coarse[:-SEED_GAP] << np.uint64(31)) | (coarse[SEED_GAP:] >> np.uint64(1))).view(np.int64)


def align(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int, int]:
    """(offset of y against x, coarsely equal integers, wrong bits, overlap) of the best alignment."""
    near, far = x & COARSE, y & COARSE
    order = np.argsort(far, kind="stable")
    left = np.searchsorted(far[order], near, "left")
    many = np.searchsorted(far[order], near, "right") - left
    if not many.sum():
        return 0, 0, 0, 0
    i = np.repeat(np.arange(len(x)), many)
    j = order[np.repeat(left - np.cumsum(many) + many, many) + np.arange(many.sum())]
    offset, votes = np.unique(i - j, return_counts=True)
    best = offset[votes.argmax()]
    lo, hi = max(0, best), min(len(x), len(y) + best)
    wrong = int(np.bitwise_count(x[lo:hi] ^ y[lo - best:hi - best]).sum())
    return int(best), int(votes.max()), wrong, int(hi - lo)


def pcm_samples(raw: bytes | None) -> np.ndarray:
    return np.frombuffer(raw or b"", np.int16).astype(np.float32) / 32768


def tones(vector: list[float] | None) -> np.ndarray:
    """A tone per component, a semitone for each 1/24 of its value around the middle of an octave."""
    hertz = 2 * LOWEST * 2 ** (np.clip(6 + 24 * np.nan_to_num(np.array(vector or [], np.float64)), 0, 12) / 12)
    return (0.6 * np.sin(2 * np.pi * hertz[:, None] * (np.arange(NOTE) / RATE)[None, :])).reshape(-1).astype(np.float32)


def fingerprints(media: DataFrame, key: str, column: str, samples: Callable = pcm_samples) -> DataFrame:
    """(key, class hash, packed integers, seeds) of every recording; ``samples`` reads a value of the column."""
    kind = dict(media.dtypes)[key]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = chroma_weights()
        for batch in batches:
            made = [fingerprint(samples(x.as_py()), weights) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.view(np.int32) for x in made], pa.list_(pa.int32())), pa.array([seeds(x) for x in made], pa.list_(pa.int64()))], ["id", "packed", "seeds"])

    found = media.select(key, column).mapInArrow(apply, f"id {kind}, packed array<int>, seeds array<long>")
    return found.withColumn("alike", F.when(F.size("packed") > 0, F.xxhash64("packed", F.size("packed"))).otherwise(F.xxhash64("id", F.lit("empty"))))


def search(prints: DataFrame, is_query: F.Column, most_errors: float = MOST_ERRORS) -> tuple[DataFrame, DataFrame]:
    """(classes with their least id, matches): every class with a query row against all classes."""
    classes = durable(prints.groupBy("alike").agg(F.min("id").alias("class_id"), F.max(is_query).alias("asked"), F.count(F.lit(1)).alias("members"), F.first("packed").alias("packed"), F.first("seeds").alias("seeds")))
    posted = classes.select("class_id", F.explode("seeds").alias("seed"))
    asked = classes.filter("asked").select(F.col("class_id").alias("query_class"), F.explode("seeds").alias("seed"))
    met = durable(asked.join(posted, "seed").filter("query_class <> class_id").select("query_class", "class_id").distinct())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [align(np.array(x, np.int32).view(np.uint32), np.array(y, np.int32).view(np.uint32)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array([m[i] for m in made], pa.int64()) for i in range(4)]], ["query_class", "class_id", "offset", "votes", "wrong_bits", "overlap"])

    kind = dict(classes.dtypes)["class_id"]
    left = classes.select(F.col("class_id").alias("query_class"), F.col("packed").alias("x"))
    both = met.join(left, "query_class").join(classes.select("class_id", F.col("packed").alias("y")), "class_id").select("query_class", "class_id", "x", "y")
    aligned = both.mapInArrow(apply, f"query_class {kind}, class_id {kind}, offset long, votes long, wrong_bits long, overlap long")
    good = aligned.filter(F.col("overlap") >= LEAST_OVERLAP).withColumn("error", F.col("wrong_bits") / (32 * F.col("overlap"))).filter(F.col("error") <= most_errors)
    return classes, good


def rendered(vectors: DataFrame, key: str, vector: str, rows: int = 64) -> DataFrame:
    """(key, pcm): the tones of each vector as a media column, in batches of ``rows`` recordings."""
    kind = dict(vectors.dtypes)[key]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                made = [(32000 * tones(x.as_py())).astype(np.int16).tobytes() if x.is_valid else None for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], ["id", "pcm"])

    return vectors.select(key, vector).mapInArrow(apply, f"id {kind}, pcm binary").withColumnRenamed("id", key)


def op4_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per recording with its class, and a row per match between a query's class and another one."""
    # the sound of a vector is made where it is read: as a column it would be 250 times as large
    prints = durable(fingerprints(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", tones))
    classes, matches = search(prints, F.col("id") % QUERY_EVERY == 0)
    members = prints.join(classes.select("alike", "class_id"), "alike").select(
        F.lit("member").alias("kind"), F.col("id").alias("vec_id"), "class_id", F.lit(None).cast("long").alias("offset"), F.lit(None).cast("double").alias("error"), F.size("packed").cast("long").alias("length"))
    links = matches.select(F.lit("match").alias("kind"), F.col("query_class").alias("vec_id"), "class_id", "offset", "error", F.col("overlap").alias("length"))
    return members.unionByName(links)
