"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier (operator 6).

1. Voters: lexicon groups (fixed words, and words or word beginnings that stand out in the
   labelled sample) and text patterns.  A voter says yes or abstains.
2. The label model estimates, by expectation maximisation, how often each voter fires on either
   class, and from the residuals how the voters go together; correlated voters share one say.
   A given label is one more voter whose error is estimated as well.
3. A linear classifier over the lexicon terms is trained on the posterior labels and scores every
   whole text.

The sample is bounded by ``SAMPLE_DOCS`` and the vocabulary by ``TERMS``; the scored texts are not.
Defined cases: null and empty texts have no term and get the score of the intercept; without
labelled rows of both classes only the fixed words speak; repeated words count once; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import durable, fold, per_class_sample, table
from .textbytes import NO_LETTER, Slice, latin_lower, slices, word_bounds, word_hashes

SAMPLE_DOCS = 6000
TERMS = 2048
LEAST_SUPPORT = 0.02   # share of the labelled toxic documents that hold a mined term
LEAST_EVIDENCE = 10.0  # nats by which a mined term's split over the labels differs from the split of all
MINED_VOTERS = 12
BEGINNINGS = (5, 7)  # bytes of a word's beginning that count as a term of their own
THRESHOLD = 0.5

# Insult words by voter.
LEXICONS = (
    ("idiot", "moron", "imbecile", "stupid", "dumb"),
    ("loser", "clown", "fool", "jerk"),
    ("trash", "scum", "garbage", "filth"),
    ("pathetic", "worthless", "useless"),
    ("disgusting", "disgrace", "vile", "repulsive"),
    ("idiota", "estúpido", "imbécil", "basura", "asqueroso"),
    ("idiote", "stupide", "imbécile", "ordure", "dégoûtant"),
    ("dummkopf", "abschaum", "widerlich", "erbärmlich", "wertlos"),
)
PATTERNS = ("shouting", "signs", "address")
ADDRESS = ("you", "your", "du", "dich", "tu", "toi", "tú", "usted")


def plain_hash(words: tuple[str, ...]) -> np.ndarray:
    raw = [w.encode() for w in words]
    at = np.cumsum([0, *map(len, raw)])
    return word_hashes(np.frombuffer(b"".join(raw), np.uint8), at[:-1], at[1:])


def terms(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word and of its beginnings; kinds never share a hash but by chance."""
    start, end, row = word_bounds(part, NO_LETTER)
    low = latin_lower(part.buf)
    found, rows = [word_hashes(low, start, end, lower=False)], [row]
    for k in BEGINNINGS:
        long = np.flatnonzero(end - start > k)
        found.append(word_hashes(low, start[long], start[long] + k, lower=False) ^ np.uint64(k << 56))
        rows.append(row[long])
    return np.concatenate(found), np.concatenate(rows)


def patterns(part: Slice, buf_terms: np.ndarray, row: np.ndarray, address: np.ndarray) -> np.ndarray:
    """Pattern votes of each row: mostly capitals, many signs, a word of address."""
    upper = latin_lower(part.buf) != part.buf
    sign = ((part.buf >= 33) & (part.buf <= 47)) | ((part.buf >= 58) & (part.buf <= 64))
    letter = ~NO_LETTER[part.buf]
    count = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[part.offsets])
    letters = np.maximum(count(letter), 1)
    votes = np.zeros((len(part), len(PATTERNS)), bool)
    votes[:, 0] = count(upper) > 0.6 * letters
    votes[:, 1] = count(sign) > 0.2 * letters
    votes[np.unique(row[np.isin(buf_terms, address)]), 2] = True
    return votes


def mined_terms(sample: DataFrame, text: str, label: str) -> list[int]:
    """Terms that stand out in labelled toxic documents: counted in Spark, the best ``TERMS`` returned."""

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mark = batch.column(1).to_numpy(zero_copy_only=False)
            for part in slices(batch.column(0)):
                found, row = terms(part)
                pairs = np.unique(np.stack([row.astype(np.uint64), found]), axis=1) if len(row) else np.zeros((2, 0), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[1].view(np.int64)), pa.array(mark[part.lo + pairs[0].astype(int)].astype(np.int32))], ["term", "y"])

    sizes = {r[label]: r["n"] for r in sample.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return []
    share, every = sizes[1] / (sizes[0] + sizes[1]), F.col("yes") + F.col("no")
    part = lambda n, usual: F.when(n > 0, n * F.log(n / every / usual)).otherwise(0.0)
    evidence = part(F.col("yes"), share) + part(F.col("no"), 1 - share)
    counted = sample.select(text, F.col(label).cast("int")).mapInArrow(unique, "term long, y int").groupBy("term").agg(F.sum("y").alias("yes"), F.sum(1 - F.col("y")).alias("no"))
    best = counted.filter((F.col("yes") > share * every) & (F.col("yes") >= LEAST_SUPPORT * sizes[1])).withColumn("evidence", evidence).filter(F.col("evidence") >= LEAST_EVIDENCE)
    return [r["term"] for r in best.orderBy(F.col("evidence").desc(), "term").limit(TERMS).collect()]


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 40, share: float = 0.3) -> tuple[np.ndarray, dict]:
    """Posterior of each row from its votes (rows x voters, bool) and its given label.

    Voters are Bernoulli in each class.  The correlation of two voters is what remains of their
    joint variation inside the classes; a voter's say is divided by one plus the correlations
    above ``share`` that it has with others.
    """
    v = np.concatenate([votes, given[:, None] == 1], axis=1).astype(float)
    p = np.clip(given.astype(float), 0.02, 0.98)
    say = np.ones(v.shape[1])
    for _ in range(rounds):
        prior = np.clip(p.mean(), 1e-3, 1 - 1e-3)
        fire1 = np.clip((p @ v + 0.5) / (p.sum() + 1), 1e-4, 1 - 1e-4)
        fire0 = np.clip(((1 - p) @ v + 0.5) / ((1 - p).sum() + 1), 1e-4, 1 - 1e-4)
        rest = v - p[:, None] * fire1 - (1 - p[:, None]) * fire0
        spread = np.sqrt((rest ** 2).mean(axis=0)) + 1e-9
        joint = (rest.T @ rest) / len(v) / spread[:, None] / spread[None, :]
        np.fill_diagonal(joint, 0)
        say = 1 / (1 + np.maximum(0, joint - share).sum(axis=1))
        odds = np.log(prior / (1 - prior)) + v @ (say * np.log(fire1 / fire0)) + (1 - v) @ (say * np.log((1 - fire1) / (1 - fire0)))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        moved, p = np.abs(new - p).max(), new
        if moved < 1e-6:
            break
    return p, {"fire1": fire1, "fire0": fire0, "correlation": joint, "say": say, "prior": prior}


@dataclass
class Linear:
    """Sorted term hashes, the weight of each, and the intercept."""

    terms: np.ndarray
    weights: np.ndarray
    bias: float
    model: dict

    def known(self, found: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, index of the term), each pair once."""
        door = np.zeros(1 << 16, bool)
        door[(self.terms & np.uint64(0xFFFF)).astype(int)] = True
        near = np.flatnonzero(door[(found & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(self.terms, found[near])
        at[at == len(self.terms)] = 0
        hit = self.terms[at] == found[near]
        pairs = np.unique(row[near][hit] * len(self.terms) + at[hit])
        return pairs // len(self.terms), pairs % len(self.terms)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE_DOCS) -> Linear:
    """Learn from the labelled rows given (the caller leaves held-out rows out)."""
    chosen, counts = per_class_sample(labels, key, label, sample)
    fixed = np.concatenate([plain_hash(x) for x in LEXICONS])
    groups = np.repeat(np.arange(len(LEXICONS)), [len(x) for x in LEXICONS])
    order = np.argsort(fixed)
    plain = Linear(fixed[order], np.full(len(fixed), 4.0), -2.0, {})
    if len(counts) < 2:
        return plain
    rows = durable(docs.select(key, text).filter(F.col(text).isNotNull()).join(F.broadcast(chosen), key))  # chosen has about ``sample`` rows
    # terms are mined in one half and weighed in the other, where chance finds hit clean documents too
    half = F.pmod(F.xxhash64(key, F.lit("half")), F.lit(2))
    mined = np.array([t for t in mined_terms(rows.filter(half == 0), text, label)], np.int64).view(np.uint64)
    rows = rows.filter(half == 1)
    mined = mined[~np.isin(mined, fixed)]
    voters = np.concatenate([groups, len(LEXICONS) + np.arange(len(mined)) % MINED_VOTERS])
    vocabulary = np.concatenate([fixed, mined])
    order = np.argsort(vocabulary)
    vocabulary, voters = vocabulary[order], voters[order]
    seeker, address = Linear(vocabulary, np.zeros(len(vocabulary)), 0.0, {}), plain_hash(ADDRESS)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0)):
                found, row = terms(part)
                at, which = seeker.known(found, row)
                signs = patterns(part, found, row, address)
                cut = np.searchsorted(at, np.arange(len(part) + 1))
                made = [which[cut[i]:cut[i + 1]].astype(np.int32).tobytes() for i in range(len(part))]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(part.lo, len(part)), batch.column(2).slice(part.lo, len(part)), pa.array(made, pa.binary()), pa.array([x.tobytes() for x in signs], pa.binary())], ["id", "y", "hits", "signs"])

    kind = dict(rows.dtypes)
    seen = rows.select(text, key, F.col(label).cast("int")).mapInArrow(hits, f"id {kind[key]}, y int, hits binary, signs binary").collect()
    if len({r["y"] for r in seen}) < 2:
        return plain
    seen.sort(key=lambda r: (r["id"], r["y"]))
    x = np.zeros((len(seen), len(vocabulary)), np.float32)
    for i, r in enumerate(seen):
        x[i, np.frombuffer(r["hits"], np.int32)] = 1
    y = np.array([r["y"] for r in seen])
    votes = np.zeros((len(seen), len(LEXICONS) + MINED_VOTERS + len(PATTERNS)), bool)
    for j in range(len(LEXICONS) + MINED_VOTERS):
        votes[:, j] = x[:, voters == j].any(axis=1)
    votes[:, len(LEXICONS) + MINED_VOTERS:] = [np.frombuffer(r["signs"], bool) for r in seen]
    posterior, model = label_model(votes, y)
    total = sum(counts.values())
    share = counts.get(1, 0) / total
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    weights, bias = regress(x, posterior, weight)
    return Linear(vocabulary, weights, bias, model)


def regress(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 3e-5, rounds: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch Adam; lexicon terms never speak against toxicity."""
    w, b = np.full(x.shape[1], 1.0, np.float32), -3.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    weight = (weight / weight.sum()).astype(np.float32)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        error = (weight * (p - target)).astype(np.float32)
        g, gb = x.T @ error + ridge * w, float(error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)
        b -= rate * (mb / (1 - 0.9 ** k)) / (vb / (1 - 0.999 ** k)) ** 0.5 if vb > 0 else 0
        w = np.maximum(w, 0)
    return w.astype(np.float64), float(b)


def score(docs: DataFrame, model: Linear, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, score and predicted for every row."""
    kinds = dict(docs.dtypes)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.full(batch.num_rows, model.bias)
            for part in slices(batch.column(0)):
                row, which = model.known(*terms(part))
                total[part.lo:part.hi] += np.bincount(row, model.weights[which], len(part))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], [*keep, "score"])

    made = docs.select(text, *keep).mapInArrow(apply, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score double")
    return made.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def learnt_from(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Linear:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter("toxic in (0, 1)").filter(fold("doc_id", 5) != 0)
    return fit(docs, labels)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold("doc_id", 5) == 0)
    return score(docs, learnt_from(spark, docs, sf_dir), keep=("doc_id", "held_out"))
