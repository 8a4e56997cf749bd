"""File listings: discovery, filtering, grouping and name resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from depthlake.functions.text import casefold, file_name, folder_key
from depthlake.operators.joins import unique_or_null

# File kinds and generic photo folder names.
TABLES = (".xlsx", ".xlsm", ".xltx", ".xltm", ".xls", ".csv", ".tsv")
IMAGES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp")
PHOTO_FOLDERS = ("photo", "photos", "image", "images", "фото", "фотографии", "изображения", "кернфото")


def list_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, size, mtime) of a tree; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def discover(files: DataFrame, kinds: Sequence[str], *, exclude: Sequence[str] = ()) -> DataFrame:
    """Files of the wanted kinds outside excluded folders, once per folded path."""
    keep = extension(F.col("path")).isin(*kinds) & ~file_name(F.col("path")).startswith("~$")
    for prefix in exclude:
        keep = keep & ~F.col("path").contains(f"/{prefix}")
    return files.filter(keep).groupBy(casefold(F.col("path")).alias("key")).agg(F.max_by(F.struct(*files.columns), "path").alias("f")).select("key", "f.*")


def read_outcomes(files: DataFrame, rows: DataFrame, *, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Rows of readable files, and an issue per file that gave none."""
    good = rows.filter("value IS NOT NULL")
    silent = files.join(good.select(path).distinct(), path, "left_anti")
    return good, silent.select(F.col(path).alias("source"), F.lit("error").alias("severity"), F.lit("no readable rows").alias("message"))


def photo_groups(images: DataFrame, root: str, *, depth: int | None = None, generic: Sequence[str] = PHOTO_FOLDERS) -> DataFrame:
    """Group by the first folder under the root; a lone generic wrapper is opened, level by level.

    Whether a level is opened is one fact about the whole tree, found by an aggregate over
    folder names, so images themselves are never gathered; ``depth`` levels are looked at, or
    as many as the deepest path has.
    """
    parts = F.split(F.substring(F.col("path"), F.lit(len(root.rstrip("/")) + 2), F.length("path")), "/")
    rows = images.withColumn("__p", parts)
    depth = depth or max(1, rows.agg(F.max(F.size("__p"))).first()[0] or 1)
    facts = []
    for level in range(depth):
        own = F.when(F.size("__p") > level + 1, F.get("__p", level))
        facts += [F.min(own).alias(f"lo{level}"), F.max(own).alias(f"hi{level}"), F.count_if(own.isNull()).alias(f"bare{level}"), F.count_if(F.size("__p") > level + 2).alias(f"deep{level}")]
    # One row: may level k be opened, given all levels above it were?
    whole = rows.agg(*facts)
    opened = F.lit(0)
    for level in reversed(range(depth)):
        lone = (F.col(f"bare{level}") == 0) & (F.col(f"lo{level}") == F.col(f"hi{level}"))
        wrap = lone & folder_key(F.col(f"lo{level}")).isin(*generic) & (F.col(f"deep{level}") > 0)
        opened = F.when(wrap, 1 + opened).otherwise(0)
    skip = whole.select(opened.alias("n")).scalar()
    at = rows.withColumn("__n", skip)
    group = F.when(F.size("__p") > F.col("__n") + 1, F.array_join(F.slice("__p", F.lit(1), F.col("__n") + 1), "/")).otherwise(F.array_join(F.slice("__p", F.lit(1), F.col("__n")), "/"))
    return at.withColumn("group", group).drop("__p", "__n")


def resolve_images(wanted: DataFrame, members: DataFrame) -> DataFrame:
    """Archive member of an image name (I14): exact, images/..., suffix (shortest), unique base name.

    ``wanted``: archive, name; ``members``: archive, member.  Suffixes are matched by equality
    on every path tail of a member.
    """
    clean = lambda c: F.regexp_replace(F.translate(F.col(c), "\\", "/"), "^/+", "")
    asked = wanted.select("archive", "name", clean("name").alias("n"))
    path = F.translate(F.col("member"), "\\", "/")
    pieces = F.split(path, "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, i, F.size(pieces)), "/"))
    all_tails = members.select("archive", "member", path.alias("p"), F.explode(tails).alias("n"))
    hits = all_tails.join(asked, ["archive", "n"])
    exact = F.when(F.col("p") == F.col("n"), 1000000).when(F.col("p") == F.concat(F.lit("images/"), "n"), 900000).when(
        F.col("p") == F.concat(F.lit("images/default/"), "n"), 800000).otherwise(700000 - F.length("p"))
    ranked = hits.groupBy("archive", "name").agg(F.max_by("member", F.struct(exact.alias("s"), F.col("member"))).alias("by_path"))
    base = members.filter(extension(F.col("member")).isin(*IMAGES)).select("archive", "member", casefold(file_name(F.col("member"))).alias("b"))
    loose = unique_or_null(base.join(asked.select("archive", "name", casefold(file_name(F.col("n"))).alias("b")), ["archive", "b"]).withColumn("s", F.lit(1)), ["archive", "name"], "s", "member")
    return asked.select("archive", "name").join(ranked, ["archive", "name"], "left").join(loose.select("archive", "name", "member"), ["archive", "name"], "left").select(
        "archive", "name", F.coalesce("by_path", "member").alias("member"))
