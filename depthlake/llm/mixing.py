"""Mixing sources to target weights by Pareto order sampling (operator 2), in DataFrame functions only.

Each source has a target of words.  Its documents all get ``floor(target / size)`` certain whole
copies; the rest is a sample of further whole copies.  Documents of a source are ranked by their
random odds over their inclusion odds, ``u / (1 - u) / (p / (1 - p) * tilt)`` with ``tilt`` the
bounded root of mean size over size (short documents are likelier, so the sample is an unequal
one), and taken in that order where their words fit: a document longer than the words still missing is
passed by, in rounds that sum up the rest anew, until no document left fits.  What is still missing is filled
by second and third whole copies in the same order, up to ``most`` copies of a document.  Then no
document with copies left fits; one more is taken where that brings the source nearer to its target.
If all copies that fit are used up and more than a document is missing, the shortest of the longer
ones comes in and what is then too much goes back from the end of the order, last copies first.
``u`` comes from the MD5 of the id, so reruns agree; query, pipeline and SQL state the same draw.

A source is never one task: ranks fall into buckets of about ``BUCKET_ROWS`` rows, a window adds up
the rows of a bucket, and another one the buckets of a source.

Defined cases: a null or empty text has size 0 and is taken 0 times; a null source is a source of
its own, last in order; equal ranks go by id; repeated rows count as rows of their own; an empty
table gives an empty one; extra columns are ignored by ``mix`` and kept by ``take``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .components import sized as few_tasks
from .tables import durable, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3.0           # copies of a document, and words of a source by its size
BUCKET_ROWS = 10_000
SMALL_SOURCES = 20_000  # source tables up to so many rows are broadcast


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """0-based position in a range sort: local positions plus one running count of the partitions."""
    placed = durable(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    block = F.shiftright("__at", 33)
    counts = placed.groupBy(block.alias("__block")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1))  # a row per partition
    counts = counts.select("__block", F.coalesce(before, F.lit(0)).alias("__before"))
    return (placed.withColumn("__block", block).join(counts, "__block")
            .withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__block", "__before"))


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> tuple[DataFrame, dict]:
    """Per source: words, rows and target; the excess over ``most`` times a source is reshared by weight."""
    sums = sized.groupBy("__source").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).alias("docs"), F.count(F.lit(1)).alias("rows"))
    weight = F.array(*[F.lit(float(w)) for w in weights])
    sums = durable(sums)
    listed = numbered(few_tasks(sums, sums.count()), [F.col("source").asc_nulls_last()], "place")
    listed = durable(listed.select("__source", "source_size", "docs", "rows", F.get(weight, (F.col("place") % len(weights)).cast("int")).alias("weight")))
    total = listed.agg(F.sum("source_size").alias("words"), F.sum("docs").alias("docs"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("sources"), F.sum("weight").alias("weight")).first()
    words, left, open_weight, level = total["words"] or 0, total["words"] or 0, total["weight"] or 0.0, 0.0
    capped = F.lit(False)
    while words and open_weight:
        now = left / open_weight
        if now == level:
            break
        level = now
        capped = F.col("weight") * F.lit(level) > most * F.col("source_size")
        closed = listed.filter(capped).agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
        left, open_weight = words - most * (closed["s"] or 0), total["weight"] - (closed["w"] or 0.0)
    target = F.when(capped, most * F.col("source_size")).otherwise(F.col("weight") * F.lit(float(level)))
    return listed.withColumn("target", F.when(F.lit(bool(words)), target).otherwise(F.lit(0.0))).drop("rows"), total.asDict()


def summed(drawn: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``columns`` and __sum, the running words of each source in the order of rank and key."""
    local = W.partitionBy("__source", "bucket").orderBy("rank", F.col(key).asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    per_bucket = drawn.groupBy("__source", "bucket").agg(F.sum("size").alias("__n"))
    before = F.sum("__n").over(W.partitionBy("__source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    per_bucket = per_bucket.select("__source", "bucket", F.coalesce(before, F.lit(0)).alias("__before"))
    run = drawn.withColumn("__sum", F.sum("size").over(local)).join(per_bucket, ["__source", "bucket"]).withColumn("__sum", F.col("__sum") + F.col("__before"))
    return durable(run.select(*columns, "__sum"))


def draw(drawn: DataFrame, n: int, key: str, names: Sequence[str], few: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Of ``n`` rows: those taken in the order of rank while they fit __lack, the words wanted of each source; and those passed by.

    Each round leaves out what is longer than the words still missing and goes on past it, so a
    source that has rows left takes one at least.  A round runs in as few tasks as its rows need.
    """
    taken, passed, left_rows = [], [], n
    while left_rows:
        run = summed(few_tasks(drawn, left_rows), key, names)
        fits = F.col("__sum") <= F.col("__lack")
        taken.append(run.filter(fits).select(*names))
        left = run.groupBy("__source").agg((F.max("__lack") - F.coalesce(F.max(F.when(fits, F.col("__sum"))), F.lit(0))).alias("__left"))
        over = durable(run.filter(~fits).join(few(left), "__source"))
        passed.append(over.filter("size > __left").select(*names))
        drawn = over.filter("size <= __left").select(*[F.col("__left").alias("__lack") if c == "__lack" else F.col(c) for c in names])
        left_rows = drawn.count()
    return few_tasks(reduce(DataFrame.unionByName, taken), n), few_tasks(reduce(DataFrame.unionByName, passed), n)


def copies(sized: DataFrame, key: str, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``sized`` has the key, source, size and __source; adds source_size, target and the whole copies to take."""
    aims, total = targets(sized, weights, most)
    docs = total["docs"] or 0
    buckets = max(1, -(-docs // BUCKET_ROWS))
    if total["sources"] <= SMALL_SOURCES:
        aims = F.broadcast(aims)
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    u = (F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    longer = F.try_divide(F.try_divide("source_size", "docs"), "size")
    tilt = F.sqrt(F.least(F.lit(4.0), F.greatest(F.lit(0.25), longer)))
    ranked = (
        sized.join(aims, "__source").withColumn("sure", F.least(F.floor(ratio), F.lit(int(most))))
        .withColumn("rest", F.col("target") - F.col("sure") * F.col("source_size"))
        .withColumn("u", F.coalesce(u, F.lit(0.5)))
        # the odds of the rest's share are the same for all of a source, so they move no rank inside it
        .withColumn("rank", F.when(F.col("size") > 0, F.col("u") / (1 - F.col("u")) / tilt))
        .withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * buckets))
    )
    ranked = durable(few_tasks(ranked.drop("u"), total["rows"] or 0))
    drawn = ranked.filter((F.col("size") > 0) & (F.col("rest") > 0))
    few = F.broadcast if total["sources"] <= SMALL_SOURCES else lambda x: x
    shown = [key, "source", "size", "source_size", "target"]
    names = ["__source", *shown, "sure", "rank", "bucket", "extra", "__lack"]
    rows = drawn.withColumns({"extra": F.lit(0), "__lack": F.col("rest")}).select(*names)
    for number in range(int(most)):
        can = (F.col("sure") + F.col("extra") < most) & (F.col("size") <= F.col("__lack")) & (F.col("extra") == number)
        n = rows.filter(can).count()
        if not n:
            break
        taken, passed = draw(rows.filter(can), n, key, names, few)
        used = taken.groupBy("__source").agg(F.sum("size").alias("__used"))
        whole = rows.filter(~can).unionByName(taken.withColumn("extra", F.col("extra") + 1)).unionByName(passed)
        lacks = rows.groupBy("__source").agg(F.max("__lack").alias("__had")).join(used, "__source", "left").select(
            "__source", (F.col("__had") - F.coalesce("__used", F.lit(0))).alias("__lack"))
        rows = durable(few_tasks(whole.drop("__lack").join(few(lacks), "__source").select(*names), docs))
    rows = rows.withColumn("__row", F.monotonically_increasing_id())  # of a written table: the same in both uses
    over = F.col("size") - F.col("__lack")
    able = (F.col("sure") + F.col("extra") < most) & (over > 0)
    ends = rows.groupBy("__source").agg(
        F.min("size").alias("__least"), F.max("__lack").alias("__miss"),
        F.min(F.when(able, F.struct(over.alias("over"), "extra", "rank", F.col(key).alias("key"), "__row"))).alias("__x"))
    held = rows.join(few(ends.select("__source", F.col("__x.over").alias("__over"))), "__source").filter("extra > 0 AND size <= __over")
    spare = held.groupBy("__source").agg(F.sum(F.col("extra") * F.col("size")).alias("__spare"))
    # all that fits is used up, yet more is missing than a document: a longer one comes in, and copies from the end of the order go
    swaps = (F.col("__miss") >= F.col("__least")) & (F.col("__x.over") - F.coalesce("__spare", F.lit(0)) < F.col("__miss"))
    last = durable(ends.join(spare, "__source", "left").filter((F.col("__x.over") < F.col("__miss")) | swaps).select(
        "__source", F.col("__x.__row").alias("__last"), F.when(F.col("__x.over") >= F.col("__miss"), F.col("__x.over")).alias("__back")))
    more = F.when(F.col("__row") == F.col("__last"), 1).otherwise(0)
    rows = durable(rows.join(few(last), "__source", "left").withColumn("extra", F.col("extra") + more).withColumn("__kept", more).withColumn("__lack", F.col("__back")).select(*names, "__kept"))
    for number in reversed(range(1, int(most) + 1)):
        can = F.col("__lack").isNotNull() & (F.col("extra") == number) & (F.col("__kept") == 0) & (F.col("size") <= F.col("__lack"))
        n = rows.filter(can).count()
        if not n:
            continue
        given, held = draw(rows.filter(can).withColumns({"rank": -F.col("rank"), "bucket": -F.col("bucket")}), n, key, [*names, "__kept"], few)
        used = given.groupBy("__source").agg(F.sum("size").alias("__used"))
        lacks = rows.groupBy("__source").agg(F.max("__lack").alias("__had")).join(used, "__source", "left").select(
            "__source", (F.col("__had") - F.coalesce("__used", F.lit(0))).alias("__lack"))
        turned = given.withColumn("extra", F.col("extra") - 1).unionByName(held).withColumns({"rank": -F.col("rank"), "bucket": -F.col("bucket")})
        rows = durable(few_tasks(rows.filter(~can | can.isNull()).unionByName(turned).drop("__lack").join(few(lacks), "__source").select(*names, "__kept"), docs))
    chosen = rows.select(*shown, (F.col("sure") + F.col("extra")).alias("copies"))
    others = ranked.filter(~((F.col("size") > 0) & (F.col("rest") > 0))).select(*shown, F.col("sure").alias("copies"))
    return chosen.unionByName(others)


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return durable(docs.select(F.col(key), F.col(source).alias("source"), size.alias("size"), F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("__source")))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Per row: key, source, size, source_size, target, copies."""
    return copies(sized(docs, key, text, source), key, weights, most)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mix(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


OP2_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) FILTER (size > 0) AS docs FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source COLLATE C ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
-- the sources that reach 3 times their size are the first in the order of size over weight
p AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS words,
  (sum(source_size) OVER ())::DOUBLE - 3.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS left_words,
  (sum(weight) OVER ()) - coalesce(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_weight FROM w),
l AS (SELECT left_words / open_weight AS level FROM p WHERE weight * (left_words / open_weight) <= 3.0 * source_size ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
t AS (SELECT p.source, source_size, docs, CASE WHEN words = 0 THEN 0.0 WHEN weight * level > 3.0 * source_size THEN 3.0 * source_size ELSE weight * level END::DOUBLE AS target FROM p LEFT JOIN l ON true),
r AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, least(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END), 3) AS sure,
  (('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u,
  CASE WHEN size > 0 THEN sqrt(least(4.0::DOUBLE, greatest(0.25::DOUBLE, (source_size::DOUBLE / docs::DOUBLE) / size::DOUBLE))) END AS tilt
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, target - sure * source_size AS rest, u / (1.0::DOUBLE - u) / tilt AS rank FROM r),
-- documents in the order of rank, then once more for second and once more for third copies: each is taken if it still fits
c AS (SELECT coalesce('=' || source, '') AS s, doc_id, size, sure, rank, rest FROM q WHERE size > 0 AND rest > 0),
i AS (SELECT s, doc_id, size, row_number() OVER (PARTITION BY s ORDER BY p, rank, doc_id) AS i FROM c, (VALUES (1), (2), (3)) v(p) WHERE sure + p <= 3),
f AS (SELECT s, 0::BIGINT AS i, max(rest) AS lack, NULL::BIGINT AS doc_id, false AS took FROM c GROUP BY s
  UNION ALL SELECT f.s, i.i, CASE WHEN i.size <= f.lack THEN f.lack - i.size ELSE f.lack END, i.doc_id, i.size <= f.lack FROM f JOIN i ON i.s = f.s AND i.i = f.i + 1),
e AS (SELECT doc_id, count(*) AS extra FROM f WHERE took GROUP BY doc_id),
k AS (SELECT s, min(lack) AS lack FROM f GROUP BY s),
g AS (SELECT c.*, k.lack, coalesce(extra, 0) AS extra FROM c JOIN k ON k.s = c.s LEFT JOIN e ON e.doc_id = c.doc_id),
-- one more where that is nearer; or, if all that fits is used up, a longer one in place of copies from the end of the order
x AS (SELECT s, max(lack) AS lack, min(size) AS least, min(struct_pack(o := size - lack, e := extra, r := rank, d := doc_id)) FILTER (WHERE sure + extra < 3 AND size > lack) AS x FROM g GROUP BY s),
y AS (SELECT x.s, x.x.d AS doc_id, x.x.o AS over, x.x.o >= x.lack AS swap FROM x
  WHERE x.x.o < x.lack OR (x.lack >= least AND x.x.o - coalesce((SELECT sum(extra * size) FROM g WHERE g.s = x.s AND extra > 0 AND size <= x.x.o), 0) < x.lack)),
b AS (SELECT g.s, g.doc_id, g.size, y.over, row_number() OVER (PARTITION BY g.s ORDER BY p DESC, rank DESC, g.doc_id) AS i
  FROM g JOIN y ON y.s = g.s AND swap AND y.doc_id <> g.doc_id, (VALUES (1), (2), (3)) v(p) WHERE p <= extra),
h AS (SELECT s, 0::BIGINT AS i, max(over) AS over, NULL::BIGINT AS doc_id, false AS gave FROM b GROUP BY s
  UNION ALL SELECT h.s, b.i, CASE WHEN b.size <= h.over THEN h.over - b.size ELSE h.over END, b.doc_id, b.size <= h.over FROM h JOIN b ON b.s = h.s AND b.i = h.i + 1),
z AS (SELECT doc_id, count(*) AS back FROM h WHERE gave GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * (q.sure + coalesce(e.extra, 0) + CASE WHEN y.doc_id IS NULL THEN 0 ELSE 1 END - coalesce(z.back, 0)))::BIGINT AS taken
FROM q LEFT JOIN e ON e.doc_id = q.doc_id LEFT JOIN y ON y.doc_id = q.doc_id LEFT JOIN z ON z.doc_id = q.doc_id
"""
