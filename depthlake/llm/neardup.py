"""MinHash near-duplicates by an LSH forest (operator 9).

A document's set holds the hashes of its distinct word shingles.  Its signature of
``TREES * DEPTH`` minima is read in ``TREES`` orders, each a rotation that starts ``DEPTH`` minima
further.  Documents that agree on the first ``DEPTH`` minima of an order are a region of that tree.

* Equal sets are one class first, so exact copies cost one row.
* Small regions offer all their pairs (at most ``SMALL - 1`` partners a document and tree).
* Larger regions are sorted by the rest of the order, and neighbours with the longest common
  prefix are the candidates: the depth adapts to how crowded the region is.
* Pairs whose signatures agree too little are dropped (five standard deviations below the
  threshold).  Of the others, each document's best partner is confirmed first on full sets;
  further pairs only where their ends are not yet connected.
* What a larger region leaves unconnected is compared exhaustively, block by block on signatures
  and then on full sets, so crowding loses no link: a region that is one component needs nothing.

A link at the threshold 0.85 shares no region of any tree with probability (1 - 0.85^4)^32 = 6e-11.

Defined cases: null or empty texts have an empty set, link with nothing and are kept; texts with
fewer words than a shingle are one shingle; rows with the same id are one node; empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .components import connect, merged
from .tables import durable, release, small_batches, table
from .textbytes import Slice, gram_hashes, mix, slices, word_bounds, word_hashes

TREES, DEPTH = 32, 4
SMALL = 12          # members of a region whose pairs are all listed
NEIGHBOURS = 2      # earlier neighbours of a document in the order of a larger region
BLOCK = 192         # signatures of a block in the exhaustive comparison
DEVIATIONS = 5.0

_rng = np.random.default_rng(912)
FLIPS = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
FACTORS = _rng.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(part: Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within the row, and the row limits."""
    start, end, row = word_bounds(part)
    words = word_hashes(part.buf, start, end)
    grams, first = gram_hashes(words, row, k)
    values, rows = [grams], [row[first]]
    count = np.bincount(row, minlength=len(part))
    begin = np.cumsum(count) - count
    for c in range(1, k):
        few = np.flatnonzero(count == c)
        whole = np.full(len(few), np.uint64(c))
        for j in range(c):
            whole = mix(whole ^ words[begin[few] + j]) + np.uint64(j)
        values.append(whole)
        rows.append(few)
    value, at = np.concatenate(values), np.concatenate(rows)
    order = np.lexsort((value, at))
    value, at = value[order], at[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1])
    value, at = value[new], at[new]
    return value, np.searchsorted(at, np.arange(len(part) + 1))


def signatures(value: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Minima of every row that has shingles (rows x TREES * DEPTH, uint32)."""
    some = limits[:-1][np.diff(limits) > 0]
    short = (value >> np.uint64(32)).astype(np.uint32)
    made = np.empty((len(some), TREES * DEPTH), np.uint32)
    for i in range(TREES * DEPTH) if len(some) else ():
        made[:, i] = np.minimum.reduceat((short ^ FLIPS[i]) * FACTORS[i], some)
    return made


def signed(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(id, n, s1, s2, keys, sig): set size, identity of the set, a key per tree, a byte per minimum."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                value, limits = shingle_sets(part, k)
                n = np.diff(limits)
                some = np.flatnonzero(n)
                sums = np.zeros((2, len(part)), np.int64)
                if len(some):
                    sums[0, some] = np.add.reduceat(mix(value ^ np.uint64(0x51)), limits[some]).view(np.int64)
                    sums[1, some] = np.add.reduceat(mix(value + np.uint64(0xA7C5)), limits[some]).view(np.int64)
                minima = signatures(value, limits)
                trees = minima.astype(np.uint64).reshape(len(some), TREES, DEPTH)
                keys = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), (len(some), TREES)) << np.uint64(50)
                for j in range(DEPTH):
                    keys = mix(keys ^ trees[:, :, j]) + np.uint64(j)
                at = np.zeros(len(part) + 1, np.int32)
                at[1:] = np.cumsum(n > 0) * TREES
                bytes_of = pa.array([x.tobytes() for x in (minima & np.uint32(0xFF)).astype(np.uint8)], pa.binary())
                place = np.full(len(part), -1)
                place[some] = np.arange(len(some))
                sig = bytes_of.take(pa.array(place, mask=place < 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.lo, len(part)), pa.array(n), pa.array(sums[0]), pa.array(sums[1]),
                     pa.ListArray.from_arrays(pa.array(at), pa.array(keys.reshape(-1).view(np.int64))), sig],
                    ["id", "n", "s1", "s2", "keys", "sig"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(apply, f"id {kind}, n long, s1 long, s2 long, keys array<long>, sig binary")


def least_agreement(share: float) -> int:
    m = TREES * DEPTH
    return int(np.floor(m * share - DEVIATIONS * np.sqrt(m * share * (1 - share))))


def bytes_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def agreeing(pairs: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """(a, b, agree) of the pairs whose signatures agree in ``least`` minima or more."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                agree = (bytes_matrix(batch.column(2)) == bytes_matrix(batch.column(3))).sum(axis=1)
                near = pa.array(agree >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near), pa.array(agree).filter(near)], ["a", "b", "agree"])

    kind = dict(pairs.dtypes)["a"]
    left = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa"))
    right = sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(apply, f"a {kind}, b {kind}, agree long")


def sorted_neighbours(members: DataFrame, least: int) -> DataFrame:
    """(a, b, agree): neighbours in the order of a larger region with the longest common prefix.

    A range sort deals even one region out over many tasks; a pair cut by a task's edge is left to
    the exhaustive comparison.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.RecordBatch | None = None
        for batch in batches:
            whole = batch if tail is None else pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
            skip, n = whole.num_rows - batch.num_rows, whole.num_rows
            key, sig = whole.column(0).to_numpy(), bytes_matrix(whole.column(1))
            for back in range(1, NEIGHBOURS + 1):
                i = np.arange(max(skip, back), n)
                i = i[key[i] == key[i - back]]
                agree = (sig[i] == sig[i - back]).sum(axis=1)
                i, agree = i[agree >= least], agree[agree >= least]
                yield pa.RecordBatch.from_arrays([whole.column(2).take(pa.array(i - back)), whole.column(2).take(pa.array(i)), pa.array(agree)], ["a", "b", "agree"])
            tail = whole.slice(max(0, n - NEIGHBOURS))

    kind = dict(members.dtypes)["id"]
    made = members.repartitionByRange("key", "order", "id").sortWithinPartitions("key", "order", "id").select("key", "order", "id").mapInArrow(apply, f"a {kind}, b {kind}, agree long")
    return made.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "agree")


def full_sets(docs: DataFrame, ids: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(id, held): the sorted shingle hashes of the documents named in ``ids``."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                value, limits = shingle_sets(part, k)
                made = [value[limits[i]:limits[i + 1]].tobytes() for i in range(len(part))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.lo, len(part)), pa.array(made, pa.binary())], ["id", "held"])

    kind = dict(ids.dtypes)["id"]
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(ids, "id", "left_semi").mapInArrow(apply, f"id {kind}, held binary")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted sets."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if 100 * len(small) < percent * len(large) or not len(small):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links on full sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array([linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["a", "b"])

    kind = dict(pairs.dtypes)["a"]
    held = full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), key, text, k)
    left = held.select(F.col("id").alias("a"), F.col("held").alias("ha"))
    right = held.select(F.col("id").alias("b"), F.col("held").alias("hb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ha", "hb").mapInArrow(compare, f"a {kind}, b {kind}")


def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    left = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    right = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return pairs.join(left, "a", "left").join(right, "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)


def block_links(members: DataFrame, labels: DataFrame, sigs: DataFrame, least: int, percent: int, docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """Links (a, b) between components of the larger regions, by comparing members block by block.

    Only regions with several components matter, and there only the members outside the largest
    one, against all members.  Regions of several trees with the same largest component are one
    crowd, so a pair is compared once.  Blocks hold about ``BLOCK`` members; a pair of blocks is a
    row of its own, and gives one link for each pair of components that it joins.
    """
    kind = dict(members.dtypes)["id"]
    named = members.select("key", "id").join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    named = durable(named)
    mixed = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("key")
    named = named.join(mixed, "key", "left_semi")
    main = named.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max(F.struct("m", "c"))["c"].alias("main"))
    crowd = durable(named.join(main, "key").groupBy("main", "id").agg(F.first("c").alias("c")))
    if crowd.isEmpty():
        return members.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    sizes = crowd.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    placed = durable(crowd.join(sizes, "main").select("main", "id", "c", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")))  # dealt by hash: no block is much larger
    ids = placed.select("id").distinct()
    held = full_sets(docs, ids, key, text, k).dropDuplicates(["id"]).join(sigs, "id")
    full = placed.join(held, "id").groupBy("main", "block").agg(F.collect_list(F.struct("id", "c", "sig", "held")).alias("rows"))
    full = durable(full)
    asking = placed.filter("c <> main").select("main", F.col("block").alias("bx")).distinct()
    pairs = asking.join(placed.select("main", F.col("block").alias("by")).distinct(), "main")
    left = full.select("main", F.col("block").alias("bx"), F.col("rows").alias("x"))
    right = full.select("main", F.col("block").alias("by"), F.col("rows").alias("y"))
    blocks = pairs.join(left, ["main", "bx"]).join(right, ["main", "by"]).select("main", "x", "y")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for main_of, x, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                x, y = x.values, y.values
                cx, cy = (side.field("c").to_numpy() for side in (x, y))
                sx, sy = (bytes_matrix(side.field("sig")) for side in (x, y))
                hx, hy = ([np.frombuffer(h.as_buffer(), np.uint64) for h in side.field("held")] for side in (x, y))
                seen, a, b = set(), [], []
                for i in np.flatnonzero(cx != main_of):
                    for j in np.flatnonzero(((sy == sx[i]).sum(axis=1) >= least) & (cy != cx[i])):
                        if (cx[i], cy[j]) not in seen and linked(hx[i], hy[j], percent):
                            seen.add((cx[i], cy[j]))
                            a.append(i)
                            b.append(j)
                yield pa.RecordBatch.from_arrays([x.field("id").take(pa.array(a, pa.int64())), y.field("id").take(pa.array(b, pa.int64()))], ["a", "b"])

    return blocks.mapInArrow(apply, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", *, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row: key, n_shingles and component_id (the least id reachable over links)."""
    with small_batches(docs.sparkSession):  # every job that passes texts or sets to Python runs in here
        return _components(docs, key, text, k, percent)


def _components(docs: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    rows = durable(signed(docs, key, text, k))
    least = least_agreement(percent / 100)
    classes = rows.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"))
    sets = rows.join(classes.select(F.col("rep").alias("id"), "s1", "s2", "n"), ["id", "s1", "s2", "n"]).dropDuplicates(["id", "s1", "s2"])
    sets = durable(sets.select("id", "keys", "sig"))
    release(docs.sparkSession)
    sigs = sets.select("id", "sig")
    places = sets.select("id", F.posexplode("keys").alias("tree", "key"))
    regions = durable(places.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("a"), F.max("id").alias("b")).filter("size > 1"))
    members = durable(places.join(regions.filter("size > 2").select("key", "size"), "key"))
    few, many = members.filter(F.col("size") <= SMALL), members.filter(F.col("size") > SMALL)
    other = few.select("key", F.col("id").alias("b"))
    listed = few.select("key", F.col("id").alias("a")).join(other, "key").filter("a < b").select("a", "b")
    offered = agreeing(regions.filter("size = 2 and a < b").select("a", "b").unionByName(listed).distinct(), sigs, least)
    order = F.expr(f"concat(substring(sig, tree * {DEPTH} + 1), substring(sig, 1, tree * {DEPTH}))")
    crowded = not many.isEmpty()
    if crowded:
        sortable = durable(many.join(sigs, "id").select("key", order.alias("order"), "id"))
        offered = offered.unionByName(sorted_neighbours(sortable, least))
    offered = durable(offered.filter("a <> b").groupBy("a", "b").agg(F.max("agree").alias("agree")))
    best = offered.groupBy("b").agg(F.max(F.struct(F.col("agree"), (-F.col("a")).alias("first")))["first"].alias("a")).select((-F.col("a")).alias("a"), "b")
    release(docs.sparkSession)
    labels = connect(confirmed(best, docs, key, text, k, percent))
    release(docs.sparkSession)
    rest = durable(across(offered.select("a", "b"), labels).join(best, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        labels = merged(labels, confirmed(rest, docs, key, text, k, percent))
    if crowded:
        release(docs.sparkSession)
        hidden = durable(block_links(many, labels, sigs, least, percent, docs, key, text, k))
        if not hidden.isEmpty():
            labels = merged(labels, hidden)
    release(docs.sparkSession)
    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component"))
    return rows.select("id", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs, k=3, percent=85)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


OP9_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON r.root = l.a),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id
"""
