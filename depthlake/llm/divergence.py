"""How far the sources of a language diverge: triangular discrimination over run-length columns.

A source is a column of term counts over the vocabulary of its language.  The vocabulary is put in an
order that clusters equal counts (lexicographic over the smallest sources' counts, then by a hash of
all counts), each column is run-length encoded in blocks of ``BLOCK`` terms, and a pair of columns is
compared run by run: where the runs of both overlap the summand is computed once and multiplied by
the length of the overlap.  Tiles of ``TILE`` columns meet in one row of a join, so no task holds a
whole language, and the sums of the blocks are added up by Spark.  All arithmetic is in integers.

Defined cases: null text, language and source are empty strings; a group without terms, or a
language without kept terms, has divergence 0 from every other; a language with one source has no
pair; equal rows count each; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .tables import durable, table
from .textbytes import LOWER, NO_LETTER, Slice, slices, word_bounds

LEAST_DOCS = 10
SCALE = 1_000_000_000
BLOCK = 8192
TILE = 32
ORDERED_BY = 16
TOP = 10
SLICE_BYTES = 8 << 20


def _terms(part: Slice) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(row, distinct terms, code, count) of each distinct term of each row of a slice."""
    start, end, row = word_bounds(part, NO_LETTER)
    offsets = np.concatenate([[0], np.cumsum(end - start, dtype=np.int64)])
    data = LOWER[part.buf[~NO_LETTER[part.buf]]]
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
    size = max(1, len(words.dictionary))
    pairs, counts = np.unique(row * size + words.indices.to_numpy(), return_counts=True)
    return pairs // size, words.dictionary, pairs % size, counts


def _pieces(part: Slice) -> Iterator[Slice]:
    """A lone long row in parts that end between terms."""
    lo, n = 0, len(part.buf)
    while lo < n:
        hi = min(n, lo + SLICE_BYTES)
        while hi < n and not NO_LETTER[part.buf[hi]]:
            hi += 1
        yield Slice(part.lo, part.hi, part.buf[lo:hi], np.array([0, hi - lo]))
        lo = hi


def _count_slice(part: Slice, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, rows) of a slice; a term counts once a row for the last."""
    if len(part) == 1 and len(part.buf) > 2 * SLICE_BYTES:
        found = [pa.table({"t": terms.take(pa.array(code)), "n": pa.array(n)}) for _, terms, code, n in map(_terms, _pieces(part))]
        whole = pa.concat_tables(found).group_by("t").aggregate([("n", "sum")])
        return np.full(len(whole), group[0]), whole["t"].combine_chunks(), whole["n_sum"].to_numpy(), np.ones(len(whole), np.int64)
    row, terms, code, n = _terms(part)
    size = max(1, len(terms))
    keys = group[row] * size + code
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    if not len(first):
        return np.zeros(0, np.int64), terms, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return keys[first] // size, terms.take(pa.array(keys[first] % size)), np.add.reduceat(n, first), np.diff(np.append(first, len(keys)))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs); every occurring group also has one row with a null term."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "source", "term", "n", "docs"]
        for batch in batches:
            seen: dict[tuple[str, str], int] = {}
            of_row = np.array([seen.setdefault(k, len(seen)) for k in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())], np.int64)
            langs, sources = (pa.array([k[i] for k in seen], pa.string()) for i in (0, 1))
            none = pa.array(np.zeros(len(seen), np.int64))
            yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(seen), pa.string()), none, none], names)
            for part in slices(batch.column("text"), SLICE_BYTES):
                group, terms, n, docs_with = _count_slice(part, of_row[part.lo:part.hi])
                at = pa.array(group)
                yield pa.RecordBatch.from_arrays(
                    [langs.take(at), sources.take(at), terms.cast(pa.string())[:len(group)], pa.array(n, pa.int64()), pa.array(docs_with, pa.int64())], names)

    named = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = named.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    return durable(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def _probability(count: str, total: str) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * V)), in decimals of 38 digits."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + 2 AS DECIMAL(20, 0))) DIV CAST({total} + 2 * kept AS DECIMAL(20, 0))")


def _summand(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})")


def runs(cells: DataFrame) -> DataFrame:
    """(lang, source, block, starts, counts): the run-length columns of rows (.., size, ats, ns) with sorted places."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ats, ns = batch.column("ats"), batch.column("ns")
            starts, counts = [], []
            for i, size in enumerate(batch.column("size").to_pylist()):
                column = np.zeros(size, np.int64)
                column[ats[i].values.to_numpy()] = ns[i].values.to_numpy()
                first = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
                starts.append(first.astype("<i4").tobytes())
                counts.append(column[first].astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("lang", "source", "block")], pa.array(starts, pa.binary()), pa.array(counts, pa.binary())],
                ["lang", "source", "block", "starts", "counts"])

    return cells.mapInArrow(encoded, "lang string, source string, block long, starts binary, counts binary")


def _columns(members: list[dict], found: list[dict] | None) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(source, starts, p) of the columns of a tile in one block; a source without a term there is one run of zeros."""
    held = {x["source"]: x for x in found or ()}
    out = []
    for m in members:
        x = held.get(m["source"])
        starts = np.frombuffer(x["starts"], "<i4") if x else np.zeros(1, np.int32)
        counts = np.frombuffer(x["counts"], "<i8").tolist() if x else [0]
        out.append((m["source"], starts, np.array([1 + SCALE * (n + 2) // m["total"] if m["total"] else 1 for n in counts], np.int64)))
    return out


def overlap_sum(a: tuple, b: tuple, size: int) -> int:
    """The sum of the summand over a block: computed once for each overlap of a run of ``a`` and a run of ``b``."""
    edges = np.union1d(a[1], b[1])
    p = a[2][np.searchsorted(a[1], edges, "right") - 1]
    q = b[2][np.searchsorted(b[1], edges, "right") - 1]
    length = np.diff(np.append(edges, size))
    return int((((p - q) * (p - q)) // (p + q) * length).sum())


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of every pair of columns of two tiles in one block, in both directions."""
    for batch in batches:
        for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            left, right = _columns(row["a_members"], row["a_found"]), _columns(row["b_members"], row["b_found"])
            source, item, value = [], [], []
            for i, x in enumerate(left):
                for y in right[i + 1:] if row["a"] == row["b"] else right:
                    total = overlap_sum(x, y, row["size"]) if row["size"] else 0
                    source += [x[0], y[0]]
                    item += [y[0], x[0]]
                    value += [total, total]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["lang"]] * len(source), pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())],
                ["lang", "source", "item", "value"])


def divergence(docs: DataFrame, *, least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for other sources, ``term`` rows for what a source overuses."""
    counts = term_counts(docs)
    terms = (
        counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
        .filter(F.col("docs") >= least_docs).select("lang", "term", "total"))
    kept = durable(counts.join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "total"))
    vocabulary = kept.groupBy("lang", "term").agg(F.max("total").alias("total"))
    langs = vocabulary.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count(F.lit(1)).alias("kept"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "lang_total", "kept")])
    place = F.row_number().over(W.partitionBy("lang").orderBy("total", "source")) - 1
    groups = durable(groups.select("*", place.alias("col"), F.floor(place / tile).alias("tile")))

    of_term = (
        kept.withColumnRenamed("total", "in_lang")
        .join(groups.select("lang", "source", "total", "lang_total", "kept"), ["lang", "source"])
        .select("lang", "source", "term", _probability("n", "total").alias("p"), _probability("in_lang", "lang_total").alias("q"))
        .filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _summand("p", "q").alias("value")))
    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top_terms = of_term.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    of_pair = pairs(kept, groups, block).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(ranked))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return of_pair.select(*columns).unionByName(top_terms.select(*columns))


def pairs(kept: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, source, item, value): the summed divergence of every two sources of a language."""
    placed = kept.join(groups.select("lang", "source", "col"), ["lang", "source"])
    cell = F.struct("col", "n")
    profile = placed.groupBy("lang", "term").agg(
        F.sort_array(F.collect_list(F.when(F.col("col") < ORDERED_BY, cell))).alias("head"), F.bit_xor(F.xxhash64("col", "n")).alias("rest"))
    order = durable(
        profile.orderBy("lang", "head", "rest", "term").select("lang", "term", F.monotonically_increasing_id().alias("at"))
        .withColumn("block", F.floor(F.col("at") / block)))
    blocks = order.groupBy("lang", "block").agg(F.min("at").alias("lo"), F.count(F.lit(1)).cast("int").alias("size"))
    cells = (
        kept.join(order, ["lang", "term"]).groupBy("lang", "source", "block")
        .agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("cells")).join(blocks, ["lang", "block"])
        .select("lang", "source", "block", "size", F.transform("cells", lambda c: (c["at"] - F.col("lo")).cast("int")).alias("ats"), F.col("cells.n").alias("ns")))
    found = (
        runs(cells).join(groups.select("lang", "source", "tile"), ["lang", "source"]).groupBy("lang", "block", "tile")
        .agg(F.collect_list(F.struct("source", "starts", "counts")).alias("found")))
    tiles = groups.groupBy("lang", "tile").agg(
        F.sort_array(F.collect_list(F.struct("source", (F.col("total") + 2 * F.col("kept")).alias("total")))).alias("members"))
    count = groups.groupBy("lang").agg(F.max("tile").alias("last"), F.max("kept").alias("kept"))
    empty = count.filter("kept = 0").select("lang", F.lit(-1).cast("long").alias("block"), F.lit(0).alias("size"))
    units = blocks.select("lang", "block", "size").unionByName(empty)
    columns = durable(
        units.join(tiles, "lang").join(count.select("lang", "last"), "lang").join(found, ["lang", "block", "tile"], "left")
        .select("lang", "block", "size", "tile", "last", "members", "found"))
    left = columns.select("lang", "block", "size", F.col("tile").alias("a"), F.explode(F.sequence("tile", "last")).alias("b"),
                          F.col("members").alias("a_members"), F.col("found").alias("a_found"))
    right = columns.select("lang", "block", F.col("tile").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), "tile")).alias("a"),
                           F.col("members").alias("b_members"), F.col("found").alias("b_found"))
    compared = left.join(right, ["lang", "block", "a", "b"]).mapInArrow(_compared, "lang string, source string, item string, value long")
    return compared.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The divergence audit of all sources of ``documents``."""
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms,
    row_number() OVER () AS doc FROM documents),
found AS (SELECT lang, source, doc, term, count(*) AS n FROM (SELECT lang, source, doc, unnest(terms) AS term FROM docs) GROUP BY ALL),
vocabulary AS (SELECT lang, term, sum(n)::HUGEINT AS total FROM found GROUP BY lang, term HAVING count(*) >= 10),
kept AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM found JOIN vocabulary USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, sum(total)::HUGEINT AS total, count(*)::HUGEINT AS v FROM vocabulary GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM kept k WHERE k.lang = g.lang AND k.source = g.source), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g),
dense AS (
  SELECT g.lang, g.source, w.term, coalesce(k.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(k.n, 0) + 2)) // (g.total + 2 * l.v) AS p,
    1 + (1000000000::HUGEINT * (w.total + 2)) // (l.total + 2 * l.v) AS q
  FROM groups g JOIN vocabulary w ON w.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN kept k ON k.lang = g.lang AND k.source = g.source AND k.term = w.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM both_parts)
WHERE part = 'pair' OR rank <= 10
"""
