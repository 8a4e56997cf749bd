"""The prefix trie of conversations by van Emde Boas recursion over depth.

Depths are halved again and again, and all parts of one height are worked on together:

1. *Content names*: a block of two turns is named by the digests of its turns, a block of four by
   two such names, and so on.  Every height has half the rows of the one below.
2. *Cuts*: the part [0, 2^k) of each conversation is cut in the middle.  Its upper part keeps the
   name of what comes before it; its lower part hangs below the cut prefix, which is named by the
   part's own name and the content name of the upper block.  At height one every depth of every
   conversation carries the name of its prefix: the nodes are the distinct names of a depth.
3. *Grafts*: totals start inside nodes and grow with the height.  The lower tries of a cut give
   their totals to the cut prefix and to its ancestors within the upper part.

Rows are (conversation, depth) throughout: no conversation is gathered, however long, and a first
turn that many conversations share is one partial aggregate.  The number of passes grows with the
logarithm of the longest conversation.  Names are SHA-256 digests.

Defined cases: rows without a conv_id belong to no conversation and take no part; null roles and
texts are empty; turns without a number come first; turns with equal numbers are ordered by the
digest of role and text, so equal rows are turns of their own; an empty table has no node, not even
a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from depthlake.operators.scan import numbered

from .tables import durable, table

WORD = r"[^\x20\x09-\x0D]+"
ENDS_SPAN = 4096
CUTS_BETWEEN_TABLES = 3


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos, sym, words) of each turn, numbered from 1 without one task per conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    framed = _digest(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "UTF-8"))
    slim = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), framed.alias("sym"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return numbered(slim, ["conv"], ["turn", "sym"], "pos", dense=True).select("conv", "pos", "sym", "words")


def rebuilt(numbered_turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv, pos from 0, sym, words) and lengths (conv, n) after heads are taken from the first of twenty ids."""
    lengths = numbered_turns.groupBy("conv").agg(F.max("pos").alias("own"))
    root, head = F.col("conv") - F.col("conv") % 20, F.crc32(F.col("conv").cast("string")) % 4
    firsts = lengths.select(F.col("conv").alias("root"), F.col("own").alias("root_own"))
    plan = durable(
        lengths.select("conv", "own", root.alias("root"), head.alias("h")).join(firsts, "root", "left")
        .select("conv", "own", "root", "h", F.least("h", F.coalesce("root_own", F.lit(0))).alias("taken")))
    from_root = (
        plan.select("conv", "root", "h").join(
            numbered_turns.filter((F.col("pos") <= 3) & (F.col("conv") % 20 == 0)).withColumnRenamed("conv", "root"), "root")
        .filter("pos <= h").select("conv", (F.col("pos") - 1).alias("pos"), "sym", "words"))
    own = (
        numbered_turns.join(plan.select("conv", "h", "taken"), "conv").filter("pos > h")
        .select("conv", (F.col("pos") - F.col("h") + F.col("taken") - 1).alias("pos"), "sym", "words"))
    n = F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return durable(from_root.unionByName(own)), plan.select("conv", n.alias("n"))


def _content_names(seq: DataFrame, levels: int) -> list[DataFrame]:
    """(conv, b, name) of the full blocks of 1, 2, 4.. turns; block b of height h begins at turn b * h."""
    found = [seq.select("conv", F.col("pos").alias("b"), F.col("sym").alias("name"))]
    for _ in range(1, levels):
        half = F.col("b") % 2
        pairs = found[-1].groupBy("conv", F.floor(F.col("b") / 2).alias("b")).agg(
            F.max(F.when(half == 0, F.col("name"))).alias("upper"), F.max(F.when(half == 1, F.col("name"))).alias("lower"))
        found.append(durable(pairs.filter("upper IS NOT NULL AND lower IS NOT NULL").select("conv", "b", _digest("upper", "lower").alias("name"))))
    return found


def prefixes(seq: DataFrame, lengths: DataFrame, levels: int) -> DataFrame:
    """(conv, d, name) for every depth d from 0 to the length of a conversation: equal names are equal prefixes."""
    names = _content_names(seq, levels)
    parts = lengths.select("conv", "n", F.lit(0).cast("long").alias("b"), F.lit(b"").alias("name"))
    for k in reversed(range(levels)):
        upper = names[k].filter("b % 2 = 0").select("conv", (F.col("b") / 2).cast("long").alias("b"), F.col("name").alias("cut"))
        cut = _digest("name", "cut")
        both = F.array(
            F.struct((F.col("b") * 2).alias("b"), F.col("name").alias("name")),
            F.when(F.col("n") >= (F.col("b") * 2 + 1) * (1 << k), F.struct((F.col("b") * 2 + 1).alias("b"), cut.alias("name"))))
        split = parts.join(upper, ["conv", "b"], "left").select("conv", "n", F.explode(F.array_compact(both)).alias("part"))
        parts = split.select("conv", "n", "part.b", "part.name")
        if k % CUTS_BETWEEN_TABLES == 0:
            parts = durable(parts)
    return parts.select("conv", F.col("b").alias("d"), "name", "n")


def grafted(nodes: DataFrame, places: DataFrame, levels: int, values: tuple[str, ...]) -> DataFrame:
    """``nodes`` (conv, d, name, parent, ..) with each value summed over the subtree of a node."""
    for k in range(levels):
        height = 1 << k
        roots = nodes.filter(F.col("d") % (2 * height) == height)
        cuts = roots.groupBy("parent").agg(F.min("conv").alias("conv"), (F.max("d") - 1).alias("d"), *[F.sum(v).alias(v) for v in values])
        if k:
            above = cuts.select("conv", F.explode(F.sequence(F.col("d") - (height - 1), F.col("d"))).alias("d"), *values)
            given = above.join(places.select("conv", "d", "name"), ["conv", "d"]).groupBy("name").agg(*[F.sum(v).alias(f"__{v}") for v in values])
        else:
            given = cuts.select(F.col("parent").alias("name"), *[F.col(v).alias(f"__{v}") for v in values])
        kept = [c for c in nodes.columns if c not in values]
        nodes = durable(nodes.join(given, "name", "left").select(
            *kept, *[(F.col(v) + F.coalesce(f"__{v}", F.lit(0))).alias(v) for v in values]))
    return nodes


def ends(places: DataFrame) -> DataFrame:
    """(name, ends_sha256): the digest of the ids that end at a node, ascending, joined by commas.

    Ids are joined in spans of 4,096 neighbouring ids, which no group can overfill; the spans of a
    node with several pass through one digest in order, batch by batch.
    """
    spans = (
        places.filter("d = n").groupBy("name", F.floor(F.col("conv") / ENDS_SPAN).alias("span"))
        .agg(F.array_join(F.transform(F.sort_array(F.collect_set("conv")), lambda c: c.cast("string")), ",").alias("ids")))
    spans = durable(spans)
    counted = spans.groupBy("name").agg(F.count(F.lit(1)).alias("spans"), F.min("ids").alias("ids"))
    single = counted.filter("spans = 1").select("name", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    several = spans.join(counted.filter("spans > 1").select("name"), "name", "left_semi")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            done = []
            for n, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist()):
                if n != name:
                    if state:
                        done.append((name, state.hexdigest()))
                    name, state = n, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.binary(), pa.string()))], ["name", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["name", "ends_sha256"])

    ordered = several.repartition("name").sortWithinPartitions("name", "span")
    return single.unionByName(ordered.mapInArrow(digests, "name binary, ends_sha256 string"))


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    seq, lengths = rebuilt(turns(conversations))
    deepest = lengths.agg(F.max("n")).first()[0] or 0
    levels = int(deepest).bit_length()
    places = durable(prefixes(seq, lengths, levels))
    distinct = places.groupBy("d", "name").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"))
    before = places.select("conv", (F.col("d") + 1).alias("d"), F.col("name").alias("parent"))
    last = seq.select("conv", (F.col("pos") + 1).alias("d"), "words")
    nodes = durable(distinct.join(before, ["conv", "d"], "left").join(last, ["conv", "d"], "left"))
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    valued = nodes.join(children, "name", "left").select(
        "conv", "d", "name", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.coalesce("words", F.lit(0))).alias("saved_tokens"))
    whole = grafted(valued, places, levels, ("n_leaves", "saved_tokens"))
    above = nodes.select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv_id"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return whole.join(above, "parent", "left").join(ends(places), "name", "left").select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return trie(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, count(*) AS own FROM t GROUP BY c),
bits(b, v, i) AS (
  SELECT b::BIGINT, b::BIGINT, 0 FROM range(256) AS s(b)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i + 1 FROM bits WHERE i < 8),
crc(c, v, i) AS (
  SELECT c, 4294967295::BIGINT, 0 FROM own
  UNION ALL SELECT crc.c, xor(crc.v >> 8, bits.v), crc.i + 1 FROM crc
  JOIN bits ON bits.i = 8 AND bits.b = xor(crc.v & 255, ascii(substr(crc.c::VARCHAR, crc.i + 1, 1)))
  WHERE crc.i < length(crc.c::VARCHAR)),
heads AS (SELECT c, c - c % 20 AS root, xor(v, 4294967295) % 4 AS h FROM crc WHERE i = length(c::VARCHAR)),
seq AS (
  SELECT heads.c, t.p, t.r, t.x FROM heads JOIN t ON t.c = heads.root AND t.p <= h
  UNION ALL SELECT heads.c, t.p - h + least(h, coalesce(f.own, 0)), t.r, t.x
  FROM heads JOIN t ON t.c = heads.c AND t.p > h LEFT JOIN own f ON f.c = heads.root),
m AS (
  SELECT c, 0::BIGINT AS d, [] :: STRUCT(r VARCHAR, x VARCHAR)[] AS k, 0 AS w FROM own
  UNION ALL SELECT c, p, list({'r': r, 'x': x}) OVER (PARTITION BY c ORDER BY p),
    len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) FROM seq),
member AS (SELECT c, d, w, min(c) OVER (PARTITION BY d, k) AS node, max(d) OVER (PARTITION BY c) AS n FROM m),
node AS (
  SELECT node, d, count(*) AS n_convs, max(w) AS w, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = n) AS ends
  FROM member GROUP BY node, d),
linked AS (SELECT node.*, up.node AS parent FROM node LEFT JOIN member up ON up.c = node.node AND up.d = node.d - 1),
kids AS (SELECT parent, d - 1 AS d, count(*) AS k FROM linked WHERE parent IS NOT NULL GROUP BY 1, 2),
valued AS (SELECT linked.*, coalesce(k, 0) AS k FROM linked LEFT JOIN kids ON kids.parent = linked.node AND kids.d = linked.d),
total AS (
  SELECT a.node, a.d, sum(CASE WHEN v.k = 0 THEN 1 ELSE 0 END) AS leaves, sum((v.n_convs - 1) * v.w) AS saved
  FROM valued v JOIN member a ON a.c = v.node AND a.d <= v.d GROUP BY a.node, a.d)
SELECT node AS conv_id, d::BIGINT AS depth, parent AS parent_conv_id, n_convs::BIGINT AS n_convs, k::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM valued JOIN total USING (node, d)
"""
