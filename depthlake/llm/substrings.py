"""Substring deduplication with suffix automata of reference shards (operator 3).

Every window of ``WINDOW`` words that starts anywhere else too is removed, at every place.

1. Each window has one anchor, its word gram with the least hash (the leftmost of equals).  Equal
   windows have equal anchors at the same place, so the windows of a document fall into segments,
   one per anchor occurrence, and only segments with the same anchor can share a window.
2. Anchors are counted.  A segment whose anchor occurs once is unique.  An anchor whose segments
   are all equal repeats whole.
3. Of the other anchors, the distinct segments with one anchor are a reference shard: a suffix
   automaton over them, with the number of occurrences of every state, is sent the same segments
   for matching statistics; a window is repeated when the state of its words occurs twice.
   Shards are dealt to tasks by anchor, so every segment meets the one shard that can match it.
4. An anchor with more than ``SHARD`` distinct segments (a passage quoted everywhere) would be a
   shard without bound.  Its windows are counted by their hash instead, which is exact as well
   and splits by window.

Defined cases: a null or empty text has no word, and the SHA-256 of an empty string; texts shorter
than a window lose nothing; windows may overlap themselves in one document; rows with the same id
and text are repeats of each other; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import durable, release, table
from .textbytes import _GRAMS, Slice, gram_hashes, mix, slices, word_bounds, word_hashes

WINDOW, GRAM = 35, 5
SHARD = 1500


def segments(part: Slice, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first word in the row, windows, anchor, content) of every segment of a slice."""
    start, end, row = word_bounds(part)
    words = word_hashes(part.buf, start, end, lower=False)
    n = len(words) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    grams = np.full(len(words), np.uint64(0xFFFFFFFFFFFFFFFF))
    value, first = gram_hashes(words, row, gram)
    grams[first] = value
    reach = window - gram + 1
    least = (grams & np.uint64(0xFFFFFFFFFF000000)) | (np.arange(len(words), dtype=np.uint64) & np.uint64(0xFFFFFF))
    size = 1
    while 2 * size <= reach:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if reach > size:
        least = np.minimum(least[:-(reach - size)], least[reach - size:])
    base = np.arange(n, dtype=np.uint64)
    place = (base + (((least[:n] & np.uint64(0xFFFFFF)) - base) & np.uint64(0xFFFFFF))).astype(np.int64)
    whole = row[:n] == row[window - 1:]
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | ~whole[:-1]
    head = np.flatnonzero(new & whole)
    run = np.flatnonzero((np.append(new[1:] | ~whole[1:], True)) & whole)
    up, down = _GRAMS.get(len(words) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(words * up[:len(words)])])
        content = mix((total[run + window] - total[head]) * down[head]) + mix((place[head] - head).astype(np.uint64) * np.uint64(64) + (run - head).astype(np.uint64))
    count = np.bincount(row, minlength=len(part))
    begin = np.cumsum(count) - count
    return row[head], head - begin[row[head]], run - head + 1, grams[place[head]], content


def occurrences(docs: DataFrame, text: str, window: int, gram: int) -> DataFrame:
    """(anchor, seg, dk, pos, n): every segment of every text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                row, pos, n, anchor, content = segments(part, window, gram)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), batch.column(0).take(pa.array(row + part.lo)), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int8))], ["anchor", "seg", "dk", "pos", "n"])

    return docs.select("dk", text).mapInArrow(apply, "anchor long, seg long, dk long, pos int, n byte")


class Automaton:
    """Suffix automaton of several sequences with weights; ``count`` is how often a state's words occur."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, sequence: list[int], weight: int) -> None:
        nexts, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for symbol in sequence:
            known = nexts[last].get(symbol)
            if known is not None and length[known] == length[last] + 1:
                last = known
                count[last] += weight
                continue
            if known is not None:
                last = self._split(last, known, symbol)
                count[last] += weight
                continue
            made = len(length)
            nexts.append({})
            length.append(length[last] + 1)
            count.append(weight)
            link.append(0)
            p = last
            while p != -1 and symbol not in nexts[p]:
                nexts[p][symbol] = made
                p = link[p]
            if p != -1:
                q = nexts[p][symbol]
                link[made] = q if length[q] == length[p] + 1 else self._split(p, q, symbol)
            last = made

    def _split(self, p: int, q: int, symbol: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        copy = len(length)
        nexts.append(dict(nexts[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.count.append(0)
        while p != -1 and nexts[p].get(symbol) == q:
            nexts[p][symbol] = copy
            p = link[p]
        link[q] = copy
        return copy

    def settle(self) -> None:
        """Pass occurrences on to the suffixes of each state, longest first."""
        count, link = self.count, self.link
        for state in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            count[link[state]] += count[state]

    def repeated(self, sequence: list[int], window: int) -> list[int]:
        """Starts of the windows of a sequence of the automaton that occur twice or more."""
        nexts, link, length, count = self.next, self.link, self.length, self.count
        state, held, found = 0, 0, []
        for i, symbol in enumerate(sequence):
            while state and symbol not in nexts[state]:
                state = link[state]
                held = length[state]
            if symbol in nexts[state]:
                state, held = nexts[state][symbol], held + 1
            while length[link[state]] >= window:
                state = link[state]
                held = length[state]
            if held >= window and count[state] >= 2:
                found.append(i - window + 1)
        return found


def shard_masks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, seg, c, words) sorted by anchor; yields (anchor, seg, mask) of repeated windows."""

    def solve(rows: list) -> pa.RecordBatch:
        automaton = Automaton()
        for _, _, c, words in rows:
            automaton.add(words, c)
        automaton.settle()
        masks = [sum(1 << i for i in automaton.repeated(words, window)) for *_, words in rows]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array(masks, pa.int64())], ["anchor", "seg", "mask"])

    held: list = []
    for batch in batches:
        for anchor, seg, c, words in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
            if held and held[0][0] != anchor:
                yield solve(held)
                held = []
            held.append((anchor, seg, c, np.frombuffer(words.as_buffer(), np.uint64).tolist()))
    if held:
        yield solve(held)


def packed(docs: DataFrame, text: str) -> DataFrame:
    """(dk, packed): texts in zstandard frames, which halves what a shuffle of whole texts writes."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch.column(1)):
                made = [press.compress(part.buf[part.offsets[i]:part.offsets[i + 1]].tobytes()) for i in range(len(part))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.lo, len(part)), pa.array(made, pa.binary()), *[c.slice(part.lo, len(part)) for c in batch.columns[2:]]], ["dk", "packed", *batch.schema.names[2:]])

    kinds = dict(docs.dtypes)
    others = [c for c in docs.columns if c not in ("dk", text)]
    return docs.select("dk", text, *others).mapInArrow(apply, ", ".join(["dk long, packed binary", *[f"`{c}` {kinds[c]}" for c in others]]))


def unpacked(column: pa.Array) -> Iterator[Slice]:
    """Slices of packed texts, a row each batch of about the usual size."""
    press = zstandard.ZstdDecompressor()
    texts, lo, size = [], 0, 0
    for i, x in enumerate(column):
        texts.append(press.decompress(x.as_py()))
        size += len(texts[-1])
        if size >= 1 << 20 or i == len(column) - 1:
            at = np.cumsum([0, *map(len, texts)])
            yield Slice(lo, i + 1, np.frombuffer(b"".join(texts), np.uint8), at)
            texts, lo, size = [], i + 1, 0


def segment_words(wanted: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """(anchor, seg, c, words) of segments named by (dk, pos, n): the whole hash of each word, 8 bytes."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            for part in unpacked(batch.column(0)):
                start, end, row = word_bounds(part)
                words = word_hashes(part.buf, start, end, lower=False)
                begin = np.searchsorted(row, np.arange(len(part) + 1))
                anchor, seg, c, cut = [], [], [], []
                for i in range(len(part)):
                    for x in lists[part.lo + i].as_py():
                        at = begin[i] + x["pos"]
                        anchor.append(x["anchor"])
                        seg.append(x["seg"])
                        c.append(x["c"])
                        cut.append(words[at:at + x["n"] + window - 1].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(seg, pa.int64()), pa.array(c, pa.int64()), pa.array(cut, pa.binary())], ["anchor", "seg", "c", "words"])

    named = wanted.groupBy("dk").agg(F.collect_list(F.struct("pos", "n", "anchor", "seg", "c")).alias("wanted"))  # segments of one text
    return texts.dropDuplicates(["dk"]).join(named, "dk").select("packed", "wanted").mapInArrow(apply, "anchor long, seg long, c long, words binary")


def counted_windows(words: DataFrame, window: int) -> DataFrame:
    """(anchor, seg, mask) of crowded anchors, by counting window hashes."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(3)]
            if not texts:
                continue
            row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
            value, first = gram_hashes(mix(np.concatenate(texts)), row, window)
            begin = np.searchsorted(row, np.arange(len(texts)))
            at = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array((first - begin[row[first]]).astype(np.int32)), pa.array(value.view(np.int64))], ["anchor", "seg", "c", "at", "window"])

    rows = durable(words.mapInArrow(apply, "anchor long, seg long, c long, at int, window long"))
    often = rows.groupBy("anchor", "window").agg(F.sum("c").alias("n")).filter("n > 1").select("anchor", "window")
    return rows.join(often, ["anchor", "window"]).groupBy("anchor", "seg").agg(F.expr("bit_or(shiftleft(1L, at))").alias("mask"))


def repeated_segments(docs: DataFrame, text: str, texts: DataFrame, window: int, gram: int, shard: int = SHARD) -> DataFrame:
    """(dk, pos, mask): segments with repeated windows; bit i is the window at ``pos + i``."""
    found = durable(occurrences(docs, text, window, gram))
    anchors = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("many"), F.min("seg").alias("lo"), F.max("seg").alias("hi")).filter("many > 1")
    anchors = durable(anchors.select("anchor", (F.col("lo") == F.col("hi")).alias("equal")))  # so the join is free to split a crowded anchor
    again = durable(found.join(anchors, "anchor"))
    del found, anchors
    release(docs.sparkSession)
    whole = F.expr("shiftleft(1L, cast(n AS int)) - 1")
    equal = again.filter("equal").select("dk", "pos", whole.alias("mask"))
    mixed = again.filter("not equal")
    distinct = durable(mixed.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("dk", "pos", "n")).alias("at")))
    crowd = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).withColumn("crowded", F.col("kinds") > shard).select("anchor", "crowded")
    placed = distinct.join(crowd, "anchor").select("anchor", "seg", "c", "crowded", "at.dk", "at.pos", "at.n")
    crowded = durable(placed)
    del distinct, crowd, placed
    release(docs.sparkSession)
    usual = segment_words(crowded.filter("not crowded"), texts, window).repartition("anchor").sortWithinPartitions("anchor", "seg")
    masks = usual.mapInArrow(lambda batches: shard_masks(batches, window), "anchor long, seg long, mask long")
    if not crowded.filter("crowded").isEmpty():
        masks = masks.unionByName(counted_windows(segment_words(crowded.filter("crowded"), texts, window), window))
    masks = masks.filter("mask <> 0")
    return equal.unionByName(mixed.join(masks, ["anchor", "seg"]).select("dk", "pos", "mask"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", *, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD, keep_text: bool = False) -> DataFrame:
    """Per row: key, n_words, n_removed, kept_sha256 (and the kept text)."""
    named = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("dk", F.xxhash64(F.col(key), "text"))
    texts = packed(named, "text")
    spans = repeated_segments(named, "text", texts.select("dk", "packed"), window, gram, shard).groupBy("dk").agg(F.collect_set(F.struct("pos", "mask")).alias("spans"))  # segments of one text

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans_of = batch.column(1)
            for part in unpacked(batch.column(0)):
                start, end, row = word_bounds(part)
                begin = np.searchsorted(row, np.arange(len(part) + 1))
                raw = part.buf.tobytes()
                removed, digest, kept_text = [], [], []
                for i in range(len(part)):
                    lo, n = begin[i], begin[i + 1] - begin[i]
                    keep = np.ones(n, bool)
                    held = spans_of[part.lo + i]
                    if held.is_valid:
                        at = np.array([x["pos"] + j for x in held.as_py() for j in range(x["mask"].bit_length()) if x["mask"] >> j & 1])
                        steps = np.zeros(n + 1, np.int64)
                        np.add.at(steps, at, 1)
                        np.add.at(steps, at + window, -1)
                        keep = np.cumsum(steps[:-1]) == 0
                    kept = b" ".join([raw[a:b] for a, b in zip(start[lo:lo + n][keep].tolist(), end[lo:lo + n][keep].tolist(), strict=True)])
                    removed.append(n - int(keep.sum()))
                    digest.append(hashlib.sha256(kept).hexdigest())
                    kept_text.append(kept.decode() if keep_text else None)
                made = [batch.column(2).slice(part.lo, len(part)), pa.array(np.diff(begin)), pa.array(removed, pa.int64()), pa.array(digest), *([pa.array(kept_text, pa.string())] if keep_text else [])]
                yield pa.RecordBatch.from_arrays(made, [key, "n_words", "n_removed", "kept_sha256", *(["kept"] if keep_text else [])])

    kind = dict(docs.dtypes)[key]
    return texts.join(spans, "dk", "left").select("packed", "spans", key).mapInArrow(apply, f"`{key}` {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
x AS MATERIALIZED (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
r AS MATERIALIZED (SELECT doc_id, i FROM x WHERE g IN (SELECT g FROM x GROUP BY g HAVING count(*) > 1)),
c AS MATERIALIZED (SELECT DISTINCT doc_id, i + j AS i FROM r, (SELECT unnest(range(0, 35)) AS j)),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM t ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
