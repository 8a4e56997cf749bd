"""Quality classifier: a byte-level convolutional network over overlapping chunks (operator 8).

Learned filters run over overlapping chunks that cover the whole text.  Each chunk is max-pooled
to a logit; a small logistic layer over their mean, maximum and minimum gives the document's one
probability.  The network and that layer are fitted in numpy on a bounded sample of labelled rows.

Defined cases: null and empty texts have no chunk and get the prior of label 1; with no labelled
row the score is 0.5; several labels of one document all count; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bytecnn import ByteNet, Shape, windows_of
from .language import training_windows
from .tables import durable, fold, per_class_sample, table
from .textbytes import slices

SAMPLE_DOCS = 4000    # labelled documents that are learned from, at most about so many
SAMPLE_CHUNKS = 6
CHUNK, STEP = 512, 384
SHAPE = Shape(classes=2, widths=(4, 8), filters=16, dims=8, stride=4, length=CHUNK)
THRESHOLD = 0.3


def chunk_summary(docs: DataFrame, net: ByteNet, text: str, keep: tuple[str, ...], finish=None, names: str = "n double, mean double, top double, low double") -> DataFrame:
    """Per row: ``keep`` and the count, mean, maximum and minimum of its chunks' logits (or ``finish`` of them)."""
    kinds = dict(docs.dtypes)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            total, weight, count = np.zeros(n), np.zeros(n), np.zeros(n)
            top, low = np.full(n, -np.inf), np.full(n, np.inf)
            for part in slices(batch.column(0)):
                chunks, row, held = windows_of(part.buf, part.offsets, CHUNK, STEP)
                made = net.logits(chunks).astype(np.float64)
                logit = made[:, 1] - made[:, 0]
                at = part.lo + row
                np.add.at(total, at, logit * held)
                np.add.at(weight, at, held)
                np.add.at(count, at, 1)
                np.maximum.at(top, at, logit)
                np.minimum.at(low, at, logit)
            some = count > 0
            stats = np.stack([count, np.where(some, total / np.maximum(weight, 1), 0), np.where(some, top, 0), np.where(some, low, 0)])
            made = [pa.array(x) for x in (stats if finish is None else finish(stats))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], [*keep, *[x.split()[0] for x in names.split(", ")]])

    return docs.select(text, *keep).mapInArrow(apply, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", " + names)


def logistic(features: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last column of ``features`` is 1."""
    w = np.zeros(features.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        gradient = features.T @ (weight * (p - target)) + ridge * w
        curve = (features * (weight * p * (1 - p))[:, None]).T @ features + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", *, sample: int = SAMPLE_DOCS, epochs: int = 8):
    """(network, weights of the last layer, prior), or None without labelled rows of both classes."""
    rows = durable(labelled.select(key, text, label))
    windows, marks = training_windows(rows, key, text, label, CHUNK, SAMPLE_CHUNKS)
    if len(set(marks)) < 2:
        return None
    order = np.argsort([f"{a}\0{w.tobytes().hex()}" for a, w in zip(marks, windows, strict=True)], kind="stable")
    windows, target = windows[order], marks[order].astype(int)
    weight = (len(target) / 2 / np.bincount(target, minlength=2))[target].astype(np.float32)
    net = ByteNet.fresh(SHAPE)
    net.train(windows, target, weight, epochs=epochs)
    seen = chunk_summary(rows, net, text, (label,)).filter("n > 0").orderBy(label, "mean", "top", "low", "n").collect()
    stats, y = np.array([[r["mean"], r["top"], r["low"], 1.0] for r in seen]), np.array([r[label] for r in seen], float)
    return net, stats, y


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold("doc_id", 5) == 0)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter("quality in (0, 1)").filter(fold("doc_id", 5) != 0)
    return score(docs, train_on(docs, labels))


def train_on(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE_DOCS):
    """Sample labels by class, fetch their texts, fit, and weigh the last layer back to the share of the classes."""
    chosen, counts = per_class_sample(labels, key, label, sample)
    if not counts:
        return None
    total = sum(counts.values())
    prior = counts.get(1, 0) / total
    texts = docs.select(key, "text").filter(F.col("text").isNotNull())
    fitted = train(texts.join(F.broadcast(chosen), key), key, "text", label, sample=sample)  # chosen has about ``sample`` rows
    if fitted is None:
        return prior
    net, stats, y = fitted
    seen = np.bincount(y.astype(int), minlength=2)
    weight = np.where(y == 1, prior / max(1, seen[1]), (1 - prior) / max(1, seen[0])) * len(y)
    return net, logistic(stats, y, weight), prior


def score(docs: DataFrame, model, key: str = "doc_id", keep: tuple[str, ...] = ("held_out",), threshold: float = THRESHOLD) -> DataFrame:
    """Per row: key, ``keep``, score and predicted."""
    if model is None or isinstance(model, float):
        made = docs.select(key, *keep, F.lit(0.5 if model is None else model).alias("score"))
    else:
        net, w, prior = model

        def finish(stats: np.ndarray) -> list[np.ndarray]:
            logit = np.stack([stats[1], stats[2], stats[3], np.ones(stats.shape[1])], axis=1) @ w
            return [np.where(stats[0] > 0, 1 / (1 + np.exp(-np.clip(logit, -30, 30))), prior)]

        made = chunk_summary(docs, net, "text", (key, *keep), finish, "score double")
    return made.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
