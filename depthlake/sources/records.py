"""Typed readers of the record files: annotation payloads, photo maps, projects, captions, curves, registries.

Readers take the raw rows Spark's own sources give (``read.json``, ``read.csv``, ``read.text``)
and shape them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from depthlake.functions.numbers import as_number, to_cm
from depthlake.functions.text import column_order, truthy

UNKNOWN_CLASS = "Без класса"
PAYLOAD = (
    "images array<struct<id:bigint,file_name:string,width:int,height:int>>, categories array<struct<id:bigint,name:string>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,segmentation:string,bbox:array<double>>>")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """COCO payload files, one row per archive."""
    return spark.read.schema(PAYLOAD).option("multiLine", True).json(path).withColumn("archive", F.col("_metadata.file_path"))


def annotation_polygons(segmentation: Column, bbox: Column) -> Column:
    """Polygons of at least three points, else the box as a polygon, else empty."""
    parts = F.from_json(segmentation, "array<array<double>>")
    good = F.filter(parts, lambda p: (F.size(p) >= 6) & (F.size(p) % 2 == 0))
    points = F.transform(good, lambda p: F.transform(F.sequence(F.lit(0), F.floor(F.size(p) / 2).cast("int") - 1), lambda i: F.struct(F.get(p, i * 2).alias("x"), F.get(p, i * 2 + 1).alias("y"))))
    x, y, w, h = (F.get(bbox, i) for i in range(4))
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    box = F.when((w > 0) & (h > 0), F.array(F.array(corner(x, y), corner(x + w, y), corner(x + w, y + h), corner(x, y + h))))
    return F.when(F.size(F.coalesce(points, F.array())) > 0, points).otherwise(F.coalesce(box, F.expr("cast(array() as array<array<struct<x:double,y:double>>>)")))


def import_annotations(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contours with class names, and skip counters per archive."""
    named = annotations.join(images.select("archive", F.col("id").alias("image_id"), "file_name"), ["archive", "image_id"]).join(
        categories.select("archive", F.col("id").alias("category_id"), "name"), ["archive", "category_id"], "left")
    shaped = named.withColumn("polygons", annotation_polygons(F.col("segmentation"), F.col("bbox")))
    rows = shaped.select("archive", "image_id", "file_name", "id", F.coalesce("name", F.lit(UNKNOWN_CLASS)).alias("label"), F.explode("polygons").alias("polygon"))
    skipped = shaped.groupBy("archive").agg(F.count_if(F.size("polygons") == 0).alias("skipped"), F.sum(F.size("polygons")).alias("contours"))
    return rows, skipped


def merge_archives(images: DataFrame, *, digest: str = "hash") -> tuple[DataFrame, DataFrame]:
    """Images of many archives without exact copies: the first archive wins (I13); counters per archive."""
    first = images.groupBy(digest).agg(F.min(F.struct("archive", "pos")).alias("__f"))
    marked = images.join(first, digest).withColumn("kept", (F.col("archive") == F.col("__f.archive")) & (F.col("pos") == F.col("__f.pos"))).drop("__f")
    return marked.filter("kept").drop("kept"), marked.groupBy("archive").agg(F.count_if("kept").alias("images"), F.count_if(~F.col("kept")).alias("duplicate_images"))


def photo_map(rows: DataFrame) -> DataFrame:
    """Typed photo map from its text columns (I16)."""
    depths = F.from_json(F.coalesce("column_depths", F.lit("[]")), "array<array<double>>")
    triples = F.transform(F.coalesce(depths, F.expr("cast(array() as array<array<double>>)")), lambda d: F.struct(
        F.get(d, 0).alias("x"), to_cm(F.get(d, 1)).alias("top_cm"), to_cm(F.get(d, 2)).alias("base_cm")))
    word = lambda c, default: F.coalesce(F.when(F.trim(c) != "", F.trim(c)), F.lit(default))
    return rows.select(
        "photo", F.trim(F.coalesce("well", F.lit(""))).alias("well"), to_cm(as_number(F.col("top"))).alias("top_cm"), to_cm(as_number(F.col("base"))).alias("base_cm"),
        word("source", "manual").alias("source"), truthy(F.col("mapping_confirmed")).alias("confirmed"), column_order(F.coalesce("column_order", F.lit(""))).alias("column_order"),
        triples.alias("column_depths"), truthy(F.col("column_ocr_checked")).alias("column_ocr_checked"), word("depth_basis", "unknown").alias("depth_basis"))


def reference_classes(reference: DataFrame) -> DataFrame:
    """Reference rows grouped to (code, index) classes in first-appearance order with their variants."""
    grouped = reference.groupBy("code", "index").agg(
        F.min("pos").alias("__first"), F.min_by("name", "pos").alias("name"), F.count(F.lit(1)).alias("variants"))
    # Class lists are a bounded reference dimension; one window numbers them.
    ids = (F.row_number().over(W.orderBy("__first")) - 1).cast("bigint")
    return grouped.select(ids.alias("class_id"), F.concat_ws("@", "code", "index").alias("model_label"), "code", "index", "name", "variants")


def newest_manifest(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """Rectangles of the newest manifest that names an existing file.

    ``manifests``: folder, manifest, mtime, source_relative, box; ``files``: folder, relative.
    """
    clean = manifests.withColumn("relative", F.translate("source_relative", "\\", "/")).filter("left IS NOT NULL AND top IS NOT NULL AND right IS NOT NULL AND bottom IS NOT NULL AND relative <> ''")
    alive = clean.join(files.select("folder", "relative").distinct(), ["folder", "relative"], "left_semi").select("folder", "manifest", "mtime").distinct()
    best = alive.groupBy("folder").agg(F.max_by("manifest", F.struct("mtime", "manifest")).alias("manifest"))
    return clean.join(best, ["folder", "manifest"], "left_semi").select("folder", "manifest", "relative", "left", "top", "right", "bottom")


def best_epoch(curves: DataFrame) -> DataFrame:
    """Best epoch per run by mask mAP50-95, box where absent; bad numbers lose; completed epochs.

    ``curves``: run, epoch, mask_map, box_map, precision, recall, map50 as text.
    """
    score = lambda c: F.coalesce(F.nanvl(F.col(c).try_cast("double"), F.lit(float("-inf"))), F.lit(float("-inf")))
    has_mask = curves.groupBy("run").agg(F.max(F.col("mask_map").isNotNull()).alias("__mask"))
    rows = curves.join(has_mask, "run").withColumn("__s", F.when(F.col("__mask"), score("mask_map")).otherwise(score("box_map")))
    rows = rows.withColumn("__s", F.when(F.col("__s") == float("inf"), float("-inf")).otherwise(F.col("__s")))
    keep = lambda c: F.when(score(c) > float("-inf"), F.round(score(c), 4))
    best = rows.groupBy("run").agg(
        F.count(F.lit(1)).alias("epochs"), F.max_by(F.struct("epoch", F.when(F.col("__s") > float("-inf"), F.round("__s", 4)).alias("map"), keep("precision").alias("precision"), keep("recall").alias("recall")),
                                                  F.struct("__s", (-F.col("epoch")).alias("e"))).alias("b"))
    return best.select("run", "epochs", "b.epoch", "b.map", "b.precision", "b.recall")


def rescale_project(photos: DataFrame) -> DataFrame:
    """Nested project photos to detections on the current display size.

    ``photos``: photo, saved_width, saved_height, width, height, detections array<struct<label, polygon>>.
    """
    sx, sy = F.col("width") / F.greatest(F.lit(1), F.col("saved_width")), F.col("height") / F.greatest(F.lit(1), F.col("saved_height"))
    rows = photos.select("photo", sx.alias("sx"), sy.alias("sy"), F.posexplode("detections").alias("pos", "d"))
    return rows.select("photo", "pos", "d.label", F.transform("d.polygon", lambda p: F.struct((p["x"] * F.col("sx")).alias("x"), (p["y"] * F.col("sy")).alias("y"))).alias("polygon"))


def caption_rows(rows: DataFrame, crops: DataFrame) -> DataFrame:
    """Caption rows with a valid split, text and an existing crop."""
    ok = F.col("split").isin("train", "val") & (F.trim(F.coalesce("target_text", F.lit(""))) != "")
    return rows.filter(ok).join(crops.select("crop").distinct(), "crop", "left_semi")


def attach_context(predictions: DataFrame, sidecar: DataFrame, classes: DataFrame) -> DataFrame:
    """Reference context of a predicted label; a canonical label beats a stale sidecar index."""
    from depthlake.operators.joins import resolve_class

    asked = predictions.join(sidecar.select("label", F.col("index").alias("__side")), "label", "left").withColumn(
        "index", F.when(~F.col("label").contains("@"), F.col("__side"))).drop("__side")
    found = resolve_class(asked, classes, ["ident"])
    info = classes.select("class_id", "model_label", "name")
    return found.join(info, "class_id", "left").select(
        "ident", "label", F.coalesce("model_label", "label").alias("model_class"), "name",
        F.when(F.col("class_id").isNotNull(), "прогноз, требуется проверка").otherwise("не сопоставлена со справочником").alias("status"))
