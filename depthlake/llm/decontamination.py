"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment (operator 7).

Words are runs of letters, digits and multi-byte characters, without case.  All n-grams of each
test item are seeds.  A document passage that holds a seed is aligned with the item word by word;
the score is the local alignment's, over that of a perfect copy.  A document holds an item if the
score reaches the threshold, or if it holds a passage of ``PASSAGE_WORDS`` words, verbatim or with
few edits inside its own span, whatever the item's length (its score is then below the threshold).
Passages are aligned where they are read: only results are shuffled.

Test items are worked through in blocks of at most ``BLOCK_SEEDS`` seeds (one item may exceed it),
each block against all documents, so what a task holds of them is bounded.

Defined cases: null or empty documents and items match nothing; items with fewer words than a seed
match only texts of just those words; repeated rows count once per (document, item); of equal scores
the earliest place wins; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import durable, table
from .textbytes import Slice, gram_hashes, mix, slices, word_bounds, word_hashes

SEED_WORDS = 3
BLOCK_SEEDS = 400_000
MATCH, MISMATCH, GAP = 2, -1, 1
THRESHOLD = 0.5
PASSAGE_WORDS = 13                 # so many words of an item count as a passage of it, whatever its length
PASSAGE_SHARE = 0.8                # score of a passage with edits over that of a perfect copy of its own span
CELLS = 1 << 20                    # cells of one batch of alignments

NO_WORD = np.ones(256, bool)
NO_WORD[48:58] = NO_WORD[65:91] = NO_WORD[97:123] = NO_WORD[128:] = False


def seeds_of(words: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(seed, index of its first word); a row with one or two words has one seed of that length."""
    values, firsts = gram_hashes(words, row, SEED_WORDS)
    count = np.bincount(row, minlength=rows)
    begin = np.cumsum(count) - count
    for c in range(1, SEED_WORDS):
        few = begin[count == c]
        whole = np.full(len(few), np.uint64(c))
        for j in range(c):
            whole = mix(whole ^ words[few + j]) + np.uint64(j)
        values, firsts = np.concatenate([values, whole]), np.concatenate([firsts, few])
    return values, firsts


def words_of(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    start, end, row = word_bounds(part, NO_WORD)
    return word_hashes(part.buf, start, end, lower=False), row


def item_seeds(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, words as bytes, seeds, places) of every test item."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                words, row = words_of(part)
                seed, first = seeds_of(words, row, len(part))
                order = np.argsort(first, kind="stable")
                seed, first = seed[order], first[order]
                begin = np.searchsorted(row, np.arange(len(part) + 1))
                cut = np.searchsorted(row[first], np.arange(len(part) + 1))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(part.lo, len(part)), pa.array([words[begin[i]:begin[i + 1]].tobytes() for i in range(len(part))], pa.binary()),
                    pa.array([seed[cut[i]:cut[i + 1]].view(np.int64) for i in range(len(part))], pa.list_(pa.int64())),
                    pa.array([first[cut[i]:cut[i + 1]] - begin[i] for i in range(len(part))], pa.list_(pa.int64()))], ["item", "words", "seeds", "places"])

    kind = dict(items.dtypes)[key]
    return items.select(key, F.lower(text)).mapInArrow(apply, f"item {kind}, words binary, seeds array<long>, places array<long>")


def hits(found: np.ndarray, seeds: np.ndarray, door: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index in ``found``, index in the sorted ``seeds``) of what is a seed."""
    near = np.flatnonzero(door[(found & np.uint64(0xFFFFF)).astype(np.int64)])
    at = np.searchsorted(seeds, found[near])
    at[at == len(seeds)] = 0
    same = seeds[at] == found[near]
    return near[same], at[same]


def door_of(seeds: np.ndarray) -> np.ndarray:
    door = np.zeros(1 << 20, bool)
    door[(seeds & np.uint64(0xFFFFF)).astype(np.int64)] = True
    return door


def smith_waterman(passages: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best score, 1-based end in the passage) of the local alignment of each row of word hashes.

    Padding is 0 in passages and 1 in items, which match nothing.  One row of the matrix is done
    for all pairs at once; the gap along the row is a running maximum.
    """
    b, n = passages.shape
    ramp = (GAP * np.arange(n + 1, dtype=np.int32))[None, :]
    last = np.zeros((b, n + 1), np.int32)
    best, end = np.zeros(b, np.int32), np.zeros(b, np.int64)
    for i in range(items.shape[1]):
        step = np.where(passages == items[:, i:i + 1], MATCH, MISMATCH).astype(np.int32)
        now = np.maximum(last - GAP, 0)
        now[:, 1:] = np.maximum(now[:, 1:], last[:, :-1] + step)
        now = np.maximum.accumulate(now + ramp, axis=1) - ramp
        at = now.argmax(axis=1)
        top = now[np.arange(b), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
        last = now
    return best, end


def longest_run(passages: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Words of the longest verbatim run that each pair shares."""
    last, best = np.zeros(passages.shape, np.int32), np.zeros(len(passages), np.int32)
    for i in range(items.shape[1]):
        now = (passages == items[:, i:i + 1]).astype(np.int32)
        now[:, 1:] *= last[:, :-1] + 1
        best = np.maximum(best, now.max(axis=1, initial=0))
        last = now
    return best


@dataclass
class Block:
    """Seeds of a block of items: sorted seeds, and for each its (item, place) entries."""

    ids: list
    words: list[np.ndarray]
    seeds: np.ndarray
    limits: np.ndarray
    item: np.ndarray
    place: np.ndarray

    def passages(self, part: Slice) -> list[tuple[int, int, int, int]]:
        """(row, item, from, to): stretches of words around seeds, one per group of near diagonals."""
        words, row = words_of(part)
        found, first = seeds_of(words, row, len(part))
        at, which = hits(found, self.seeds, door_of(self.seeds))
        if not len(at):
            return words, []
        many = self.limits[which + 1] - self.limits[which]
        entry = np.repeat(self.limits[which] - np.cumsum(many) + many, many) + np.arange(many.sum())
        pos, item = np.repeat(first[at], many), self.item[entry]
        start = pos - self.place[entry]
        order = np.lexsort((start, item, row[pos]))
        start, item, place = start[order], item[order], row[pos][order]
        length = np.array([len(w) for w in self.words])[item]
        slack = np.maximum(6, length // 3)
        new = np.ones(len(start), bool)
        new[1:] = (place[1:] != place[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > slack[1:])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(start)) - 1
        begin = np.searchsorted(row, np.arange(len(part) + 1))
        lo = np.maximum(start[head] - slack[head], begin[place[head]])
        hi = np.minimum(start[tail] + length[tail] + slack[tail], begin[place[head] + 1])
        return words, list(zip(place[head].tolist(), item[head].tolist(), lo.tolist(), hi.tolist(), (lo - begin[place[head]]).tolist(), strict=True))

    def scored(self, part: Slice, threshold: float) -> list[tuple[int, int, float, int, int]]:
        """(row, item, score, first word, last word) of the passages that reach the threshold."""
        words, todo = self.passages(part)
        todo.sort(key=lambda x: (x[3] - x[2], len(self.words[x[1]])))
        out, i = [], 0
        while i < len(todo):
            j = i + 1
            while j < len(todo) and (j + 1 - i) * (todo[j][3] - todo[j][2]) <= CELLS // 16:
                j += 1
            group = todo[i:j]
            i = j
            wide, long = max(x[3] - x[2] for x in group), max(len(self.words[x[1]]) for x in group)
            text, item = np.zeros((len(group), wide), np.uint64), np.ones((len(group), long), np.uint64)
            for k, x in enumerate(group):
                text[k, :x[3] - x[2]] = words[x[2]:x[3]]
                item[k, :len(self.words[x[1]])] = self.words[x[1]]
            best, end = smith_waterman(text, item)
            share = best / (MATCH * np.array([len(self.words[x[1]]) for x in group]))
            good = np.flatnonzero((share >= threshold) | (best >= MATCH * PASSAGE_WORDS))
            if len(good):
                back, behind = smith_waterman(text[good][:, ::-1], item[good][:, ::-1])
                span = end[good] - (wide - behind)
                held = (share[good] >= threshold) | (best[good] >= PASSAGE_SHARE * MATCH * span) | (longest_run(text[good], item[good]) >= PASSAGE_WORDS)
                for k, rear in zip(good[held], behind[held], strict=True):
                    x = group[k]
                    out.append((x[0], x[1], float(share[k]), x[4] + wide - int(rear), x[4] + int(end[k]) - 1))
        return out


def block_of(ids: list, words: list[np.ndarray], seeds: list[np.ndarray], places: list[np.ndarray]) -> Block:
    seed, place = np.concatenate(seeds), np.concatenate(places)
    item = np.repeat(np.arange(len(seeds)), [len(x) for x in seeds])
    order = np.lexsort((place, item, seed))
    distinct, first = np.unique(seed[order], return_index=True)
    return Block(ids, words, distinct, np.append(first, len(seed)), item[order], place[order])


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, item key, score, first_word, last_word), one row per document and test item that it holds."""
    listed = durable(item_seeds(items, item_key, item_text).filter("size(seeds) > 0").dropDuplicates(["item", "words"]))
    total = listed.agg(F.sum(F.size("seeds")).alias("n")).first()["n"] or 0
    blocks = -(-total // BLOCK_SEEDS)
    kinds = dict(docs.dtypes), dict(items.dtypes)
    schema = f"`{key}` {kinds[0][key]}, `{item_key}` {kinds[1][item_key]}, score double, first_word long, last_word long"
    made = None
    for b in range(blocks):
        rows = listed.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("item", "words").collect()  # about BLOCK_SEEDS seeds
        if not rows:
            continue
        seeds = [np.array(r["seeds"], np.int64).view(np.uint64) for r in rows]
        block = block_of([r["item"] for r in rows], [np.frombuffer(r["words"], np.uint64) for r in rows], seeds, [np.array(r["places"], np.int64) for r in rows])

        def apply(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch.column(1)):
                    out = block.scored(part, threshold)
                    ids = batch.column(0).take(pa.array([part.lo + x[0] for x in out], pa.int64()))
                    items_of = pa.array([block.ids[x[1]] for x in out])
                    if out:
                        yield pa.RecordBatch.from_arrays([ids, items_of, pa.array([x[2] for x in out]), pa.array([x[3] for x in out]), pa.array([x[4] for x in out])], [key, item_key, "score", "first_word", "last_word"])

        found = docs.select(key, F.lower(text)).mapInArrow(apply, schema)
        made = found if made is None else made.unionByName(found)
    if made is None:
        return docs.sparkSession.createDataFrame([], schema)
    best = F.max(F.struct("score", (-F.col("first_word")).alias("f"), (-F.col("last_word")).alias("l"))).alias("x")
    return made.groupBy(key, item_key).agg(best).select(key, item_key, "x.score", (-F.col("x.f")).alias("first_word"), (-F.col("x.l")).alias("last_word"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
