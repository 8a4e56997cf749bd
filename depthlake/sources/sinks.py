"""Writers: delimited tables, JSON lines, label lines, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from depthlake.functions.geometry import yolo_line


def write_table(df: DataFrame, path: str, columns: Sequence[str], *, sep: str = ";", mode: str = "errorifexists") -> None:
    """Chosen columns in order as delimited text with a header (K1)."""
    df.select(*columns).write.mode(mode).option("sep", sep).option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str, *, split: str | None = "split", mode: str = "errorifexists") -> None:
    """JSON lines, one folder per split (K2)."""
    writer = df.write.mode(mode)
    (writer.partitionBy(split) if split else writer).json(path)


def label_lines(masks: DataFrame, *, image: str = "image", split: str = "split") -> DataFrame:
    """One row per image with its label lines (K3): class then vertices in image fractions."""
    line = yolo_line(F.col("class_id"), F.col("polygon"), F.col("width"), F.col("height"))
    return masks.groupBy(split, image).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("pos"), line.alias("line")))), lambda s: s["line"]), "\n").alias("lines"))


def write_label_lines(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Label text per split and image folder (K3)."""
    df.select("split", "image", F.col("lines").alias("value")).write.mode(mode).partitionBy("split", "image").text(path)


def manifest(counters: DataFrame) -> DataFrame:
    """One-row report as JSON text (K4)."""
    return counters.select(F.to_json(F.struct(*counters.columns)).alias("manifest"))


def write_manifest(counters: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    manifest(counters).write.mode(mode).text(path)
