"""Language identification by a byte convolutional network (operator 5).

A network with filters of three widths, max pooling and a softmax is trained in numpy on a
bounded, documented sample of labelled documents and applied to every fixed-length window of
every whole text.  A document's probabilities are the means over its windows, weighted by the
bytes they hold.

Defined cases: a null text, and a text without a letter, is ``und`` with score 0; with no
labelled row everything is ``und``; columns beside the named ones are ignored; repeated rows give
repeated results; of equal probabilities the first language by name wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bytecnn import ByteNet, Shape, windows_of
from .tables import fold, per_class_sample, table
from .textbytes import slices

UNKNOWN = "und"
SAMPLE_DOCS = 4000   # labelled documents that the network learns from, at most about so many
SAMPLE_WINDOWS = 6   # windows of each of them
SHAPE = Shape(classes=0, widths=(3, 4, 5), filters=16, dims=8, stride=2, length=256)


def training_windows(sample: DataFrame, key: str, text: str, label: str, length: int, each: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows at places spread over the whole of each sampled text, some cut short, and their labels."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column(0).to_pylist(), batch.column(2)
            for part in slices(batch.column(1)):
                row, window = [], []
                for i in range(len(part)):
                    raw = part.buf[part.offsets[i]:part.offsets[i + 1]]
                    rng = np.random.default_rng((ids[part.lo + i] or 0) & 0x7FFFFFFF)
                    for k in range(min(each, -(-len(raw) // (length // 4)))):
                        start = int(rng.integers(0, max(1, len(raw) - length + 1)))
                        size = length if k % 2 == 0 else int(rng.integers(8, length + 1))
                        window.append(raw[start:start + size].tobytes().ljust(length, b"\0"))
                        row.append(part.lo + i)
                if row:
                    yield pa.RecordBatch.from_arrays([labels.take(pa.array(row)), pa.array(window, pa.binary())], ["label", "window"])

    kind = dict(sample.dtypes)[label]
    found = sample.select(key, text, label).mapInArrow(cut, f"label {kind}, window binary").collect()
    windows = np.frombuffer(b"".join(r["window"] for r in found), np.uint8).reshape(-1, length)
    return windows, np.array([r["label"] for r in found], dtype=object)


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", *, sample: int = SAMPLE_DOCS, epochs: int = 6) -> tuple[list[str], ByteNet] | None:
    """Fit the network; None if no row has a language and a text."""
    rows, counts = per_class_sample(labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()), key, lang, sample)
    if not counts:
        return None
    windows, labels = training_windows(rows, key, text, lang, SHAPE.length, SAMPLE_WINDOWS)
    if not len(windows):
        return None
    order = np.argsort([f"{a}\0{w.tobytes().hex()}" for a, w in zip(labels, windows, strict=True)], kind="stable")  # rows arrive in any order
    windows, labels = windows[order], labels[order]
    classes = sorted(set(labels))
    target = np.searchsorted(classes, labels)
    weight = (len(target) / len(classes) / np.bincount(target, minlength=len(classes)))[target].astype(np.float32)
    net = ByteNet.fresh(Shape(**{**SHAPE.__dict__, "classes": len(classes)}))
    net.train(windows, target, weight, epochs=epochs)
    return classes, net


def predict(docs: DataFrame, model: tuple[list[str], ByteNet] | None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: key, ``keep`` columns, lang_pred and score."""
    kinds = dict(docs.dtypes)
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    out = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *keep)) + ", lang_pred string, score double"
    if model is None:
        return docs.select(key, *keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    classes, net = model

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*classes, UNKNOWN], pa.string())
        for batch in batches:
            known = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            total = np.zeros((batch.num_rows, len(classes)))
            for part in slices(batch.column(0)):
                windows, row, held = windows_of(part.buf, part.offsets, net.shape.length, net.shape.length)
                made = net.logits(windows).astype(np.float64)
                made = np.exp(made - made.max(axis=1, keepdims=True))
                made *= (held / made.sum(axis=1))[:, None]
                np.add.at(total, part.lo + row, made)
            share = total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)
            best = np.where(known, share.argmax(axis=1), len(classes))
            score = np.where(known, np.clip(share.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], names.take(pa.array(best)), pa.array(score)], [key, *keep, "lang_pred", "score"])

    return docs.select(F.col(text), lettered.alias("__lettered"), key, *keep).mapInArrow(apply, out)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold("doc_id", 3) == 1)
    model = train(docs.filter(~F.col("held_out")))
    return predict(docs, model, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")
