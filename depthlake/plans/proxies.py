"""Domain views over the driver tables, once as DataFrames and once as SQL.

``Tables.layers()`` and the SQL view ``layers`` describe the same rows; the SQL side is
prefixed to a query as common table expressions when the query mentions the view.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def day(column: str) -> Column:
    return F.datediff(F.col(column), F.lit("1995-01-01").cast("date"))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in NAMES:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        raise AttributeError(name)

    def layers(self) -> DataFrame:
        top = (F.lit(100).cast("bigint") * day("l_shipdate"))
        return self.lineitem.select(
            F.col("l_suppkey").alias("well"),
            top.alias("top_cm"),
            (top + F.lit(10) * F.col("l_quantity").cast("bigint")).alias("base_cm"),
            F.concat("l_returnflag", "l_linestatus").alias("label"),
            F.round((1 - F.col("l_discount")) * 100).cast("bigint").alias("conf"),
            F.concat_ws(
                "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day("l_shipdate"),
                F.round(F.col("l_extendedprice") * 100).cast("bigint"),
            ).alias("layer_id"),
        )

    def photos(self) -> DataFrame:
        wells = self.supplier.agg(F.count(F.lit(1)).alias("n"))
        top = F.lit(100).cast("bigint") * day("o_orderdate")
        return self.orders.select(
            F.col("o_orderkey").alias("photo"),
            F.pmod(F.col("o_custkey"), wells.scalar()).alias("well"),
            top.alias("top_cm"),
            (top + 100 * (1 + F.col("o_orderkey") % 5)).alias("base_cm"),
            (F.col("o_orderstatus") != "P").alias("confirmed"),
        )

    def detections(self) -> DataFrame:
        """Model detections: orders are photos, their line items are boxes."""
        return self.lineitem.select(
            F.col("l_orderkey").alias("photo"),
            F.concat_ws(
                "-", "l_linenumber", "l_partkey", "l_suppkey", day("l_shipdate"),
                F.round(F.col("l_extendedprice") * 100).cast("bigint"),
            ).alias("det"),
            (F.col("l_partkey") % 200).alias("left"),
            (F.col("l_suppkey") % 300).alias("top"),
            (F.col("l_partkey") % 200 + 20 + F.col("l_linenumber") * 5).cast("bigint").alias("right"),
            (F.col("l_suppkey") % 300 + F.col("l_quantity").cast("bigint")).alias("bottom"),
            F.concat("l_returnflag", "l_linestatus").alias("label"),
            F.round((1 - F.col("l_discount")) * 100).cast("bigint").alias("conf"),
            (F.col("l_tax") > 0.04).alias("reviewed"),
        )

    def samples(self) -> DataFrame:
        """Log samples: one row per (well, curve, depth second) with summed value in hundredths."""
        start = self.events.agg(F.min(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000))).scalar()
        return (
            self.events.select(
                (F.col("user_id") % 10).alias("well"), F.col("event_type").alias("curve"),
                (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000) - start).cast("bigint").alias("depth"),
                F.round(F.col("value") * 100).cast("bigint").alias("v"),
            ).groupBy("well", "curve", "depth").agg(F.max("v").alias("v"))
        )

    def records(self) -> DataFrame:
        """Labelled samples: documents with a content hash, a group and a review flag."""
        return self.documents.join(self.labels, "doc_id", "left").select(
            F.col("doc_id").alias("photo"), F.sha2("text", 256).alias("hash"),
            F.col("source").alias("well"), F.col("lang").alias("label"),
            F.coalesce(F.col("quality") == 1, F.lit(False)).alias("reviewed"),
            F.col("n_chars"),
        )

    def polygons(self) -> DataFrame:
        """Embedding pairs read as polygon vertices on a 100 x 100 grid of whole units."""
        scaled = F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 50).cast("bigint"))
        half = F.floor(F.size("embedding") / 2).cast("int")
        return self.embeddings.withColumn("s", scaled).select(
            F.col("vec_id"), F.col("label").cast("bigint").alias("label"),
            F.transform(
                F.sequence(F.lit(0), half - 1),
                lambda i: F.struct(F.get("s", i * 2).alias("x"), F.get("s", i * 2 + 1).alias("y")),
            ).alias("polygon"),
        )

    def lines(self) -> DataFrame:
        """Whole texts split to lines."""
        return self.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


DAY = "date_diff('day', DATE '1995-01-01', CAST({0} AS DATE))"

VIEWS: dict[str, str] = {
    "layers": f"""
      SELECT l_suppkey AS well,
        100 * {DAY.format('l_shipdate')} AS top_cm,
        100 * {DAY.format('l_shipdate')} + 10 * CAST(l_quantity AS BIGINT) AS base_cm,
        l_returnflag || l_linestatus AS label,
        CAST(round((1 - l_discount) * 100) AS BIGINT) AS conf,
        concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, {DAY.format('l_shipdate')},
                  CAST(round(l_extendedprice * 100) AS BIGINT)) AS layer_id
      FROM lineitem""",
    "photos": f"""
      SELECT o_orderkey AS photo, o_custkey % (SELECT count(*) FROM supplier) AS well,
        100 * {DAY.format('o_orderdate')} AS top_cm,
        100 * {DAY.format('o_orderdate')} + 100 * (1 + o_orderkey % 5) AS base_cm,
        o_orderstatus <> 'P' AS confirmed
      FROM orders""",
    "detections": f"""
      SELECT l_orderkey AS photo,
        concat_ws('-', l_linenumber, l_partkey, l_suppkey, {DAY.format('l_shipdate')},
                  CAST(round(l_extendedprice * 100) AS BIGINT)) AS det,
        l_partkey % 200 AS "left", l_suppkey % 300 AS top,
        l_partkey % 200 + 20 + l_linenumber * 5 AS "right",
        l_suppkey % 300 + CAST(l_quantity AS BIGINT) AS bottom,
        l_returnflag || l_linestatus AS label,
        CAST(round((1 - l_discount) * 100) AS BIGINT) AS conf, l_tax > 0.04 AS reviewed
      FROM lineitem""",
    "samples": """
      SELECT user_id % 10 AS well, event_type AS curve,
        CAST(epoch_us(ts) // 1000000 - (SELECT min(epoch_us(ts) // 1000000) FROM events) AS BIGINT) AS depth,
        max(CAST(round(value * 100) AS BIGINT)) AS v
      FROM events GROUP BY ALL""",
    "records": """
      SELECT d.doc_id AS photo, sha256(d.text) AS hash, d.source AS well, d.lang AS label,
        coalesce(l.quality = 1, false) AS reviewed, d.n_chars
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "polygons": """
      SELECT vec_id, CAST(label AS BIGINT) AS label,
        list_transform(range(0, len(embedding) // 2), lambda i: {
          'x': CAST(floor((CAST(embedding[2*i+1] AS DOUBLE) + 1) * 50) AS BIGINT),
          'y': CAST(floor((CAST(embedding[2*i+2] AS DOUBLE) + 1) * 50) AS BIGINT)}) AS polygon
      FROM embeddings""",
    "vertices": """
      SELECT vec_id, label, CAST(i AS BIGINT) AS i, polygon[i].x AS x, polygon[i].y AS y, len(polygon) AS n
      FROM (SELECT vec_id, label, polygon, unnest(range(1, len(polygon) + 1)) AS i FROM polygons)""",
    "lines": """
      SELECT doc_id, CAST(unnest(range(0, len(p))) AS INTEGER) AS line_no, unnest(p) AS line
      FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)""",
}


def expand(sql: str) -> str:
    """Prefix the common table expressions a query mentions."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in need and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in need:
                    need.append(name)

    sql = sql.strip()
    visit(sql)
    if not need:
        return sql
    head = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in need)
    if re.match(r"(?i)with\s+recursive\b", sql):
        return f"WITH RECURSIVE {head},\n" + re.sub(r"(?i)^with\s+recursive", "", sql)
    if re.match(r"(?i)with\b", sql):
        return f"WITH {head},\n" + re.sub(r"(?i)^with", "", sql)
    return f"WITH {head}\n{sql}"
