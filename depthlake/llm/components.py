"""Connected components of a link table by contraction, with durable rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .tables import durable


ROWS_A_TASK = 100_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of about ``rows`` rows in as few tasks as they need, so that late, small rounds stay small jobs."""
    return df.coalesce(max(1, -(-rows // ROWS_A_TASK)))


def connect(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every linked node; the component is its least node.

    A round gives every node its least neighbour (or itself), follows that pointer once more, and
    carries the links over to what the nodes point to.  Links inside one component vanish, so
    each round works on what is still open; rounds grow with the logarithm of a path.
    """
    open_links = durable(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct())
    left = first = open_links.count()
    open_links, labels = sized(open_links, left), None
    while left:
        ways = open_links.unionByName(open_links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p"))
        up = durable(sized(up.join(up.select(F.col("a").alias("p"), F.col("p").alias("q")), "p").select("a", F.col("q").alias("p")), 2 * left))
        if labels is None:
            labels = up.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            moved = up.select(F.col("a").alias("component"), "p")
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("p", "component").alias("component"))
        ends = up.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        over = open_links.join(up, "a").select("b", F.col("p").alias("pa")).join(ends, "b")
        open_links = durable(sized(over.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).filter("a < b").distinct(), left))
        left = open_links.count()
    if labels is None:
        return links.select(F.col(a).alias("node"), F.col(a).alias("component")).limit(0)
    return durable(sized(labels, 2 * first))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further links (a, b): only the components that these join are worked on."""
    left = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    right = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    ends = links.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = connect(ends)
    moved = labels.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    new = joined.join(labels, "node", "left_anti").select("node", "component")
    return durable(moved.select("node", F.coalesce("to", "component").alias("component")).unionByName(new))
