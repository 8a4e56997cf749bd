"""Well-log text files (sections ~W, ~C, ~A) to long samples, from numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from depthlake.operators.scan import running

# Curve names that are depth.
DEPTH_CURVES = ("DEPT", "DEPTH", "MD", "TVD", "TVDSS")


def _sections(lines: DataFrame) -> DataFrame:
    text = F.trim(F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))
    rows = lines.withColumn("line", text).filter(~F.col("line").startswith("#") & (F.col("line") != ""))
    name = F.upper(F.regexp_extract("line", r"^~\s*(\S*)", 1))
    rows = rows.withColumn("__name", F.when(F.col("line").startswith("~"), name))
    rows = running(rows, ["file"], ["line_no"], {"section": ("last", "__name")})
    body = rows.filter("__name IS NULL AND section IS NOT NULL").withColumn("letter", F.substring("section", 1, 1))
    first = rows.filter("__name IS NOT NULL").groupBy("file", F.substring("__name", 1, 1).alias("letter")).agg(
        F.min_by("__name", "line_no").alias("section"))
    return body.join(first, ["file", "letter", "section"], "left_semi").select("file", "letter", "line_no", "line")


def _items(lines: DataFrame) -> DataFrame:
    left = F.trim(F.substring_index("line", ":", 1))
    dotted = left.contains(".")
    mnemonic = F.when(dotted, F.substring_index(left, ".", 1)).otherwise(F.regexp_extract(left, r"^(\S+)", 1))
    tail = F.trim(F.when(dotted, F.regexp_extract(left, r"^[^.]*\.(.*)$", 1)).otherwise(F.regexp_extract(left, r"^\S+\s+(.*)$", 1)))
    parts = F.filter(F.split(tail, r"\s+"), lambda p: p != "")
    name = F.regexp_replace(F.regexp_replace(F.upper(mnemonic), r"(?U)[^\w]", "_"), "^_+|_+$", "")
    return lines.select(
        "file", "letter", "line_no", name.alias("mnemonic"), F.coalesce(F.get(parts, 0), F.lit("")).alias("unit"),
        F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), " ").alias("value"), F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("description"))


def parse_las(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, curves): samples are (file, well, row, depth, curve, value).

    Unreadable tokens are dropped before values are dealt out to curves and a trailing
    partial row is discarded, so a value's curve is its running position modulo the number
    of curves.
    """
    body = _sections(lines)
    items = _items(body.filter("letter IN ('W', 'C')")).filter("mnemonic <> ''")
    wells = items.filter("letter = 'W'").groupBy("file").agg(
        F.max_by(F.when(F.col("value") != "", F.col("value")).otherwise(F.col("description")), F.when(F.col("mnemonic") == "WELL", F.col("line_no"))).alias("well"),
        F.max_by(F.col("value").try_cast("double"), F.when(F.col("mnemonic") == "NULL", F.col("line_no"))).alias("null_value"))
    # Header sections hold one line per curve; their windows stay small.
    order = W.partitionBy("file").orderBy("line_no")
    again = F.row_number().over(W.partitionBy("file", "mnemonic").orderBy("line_no"))
    curves = items.filter("letter = 'C'").withColumns({"index": F.row_number().over(order) - 1, "__n": again}).select(
        "file", "index", F.when(F.col("__n") > 1, F.concat_ws("_", "mnemonic", "__n")).otherwise(F.col("mnemonic")).alias("curve"), "unit", "description")
    depth = curves.groupBy("file").agg(
        F.count(F.lit(1)).alias("curves"),
        F.coalesce(F.min(F.when(F.col("curve").isin(*DEPTH_CURVES), F.col("index"))), F.lit(0)).alias("depth_index"))
    tokens = F.filter(F.transform(F.split("line", r"[\s,]+"), lambda v: v.try_cast("double")), lambda v: v.isNotNull())
    data = body.filter("letter = 'A'").select("file", "line_no", tokens.alias("tokens")).withColumn("n", F.size("tokens").cast("bigint"))
    placed = running(data, ["file"], ["line_no"], {"before": ("sum", "n")})
    totals = data.groupBy("file").agg(F.sum("n").alias("total"))
    values = placed.join(totals, "file").join(depth, "file").select(
        "file", "total", "curves", "depth_index", F.posexplode("tokens").alias("pos", "raw"), "before")
    at = F.col("before") + F.col("pos")
    values = values.filter(at < F.col("total") - F.col("total") % F.col("curves")).withColumns(
        {"row": F.floor(at / F.col("curves")), "index": (at % F.col("curves")).cast("int")}).join(wells, "file", "left")
    value = F.when(F.abs(F.col("raw") - F.col("null_value")) < 1e-9, F.lit(None)).otherwise(F.col("raw"))
    axis = values.filter("index = depth_index").select("file", "row", value.alias("depth"))
    named = values.join(curves.select("file", "index", "curve"), ["file", "index"]).join(axis, ["file", "row"])
    fallback = F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"\.[^.]*$", "")
    samples = named.select(
        "file", F.coalesce(F.when(F.trim("well") != "", F.trim("well")), fallback).alias("well"), "row", "depth", "curve", value.alias("value"))
    return samples, curves
