"""Audit roll-ups: metres per label and well, photo coverage, inventories, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from depthlake.operators import intervals as iv


def description_gaps(hosts: DataFrame, rows: DataFrame, keys: Sequence[str], *, text: str) -> DataFrame:
    """Host ground not covered by rows that carry text."""
    told = rows.filter(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").select(*keys, "top_cm", "base_cm")
    return iv.gaps(hosts, told, keys)


def uncovered_ranges(
    cores: DataFrame, spans: DataFrame, keys: Sequence[str], *, bounds: tuple[str, str],
) -> DataFrame:
    """Distinct core ranges and the parts no span reaches."""
    hosts = cores.select(*keys, *bounds).filter(F.col(bounds[1]) > F.col(bounds[0])).distinct()
    return iv.gaps(hosts, spans, keys, host_bounds=bounds)


def mask_gaps(rows: DataFrame, masks: DataFrame, row_id: Sequence[str]) -> DataFrame:
    """Rows not fully covered by their own masks.

    Masks may live in another depth system, so their progress inside the source span is
    projected on the row's span before gaps are taken.
    """
    row_id = list(row_id)
    hosts = rows.select(*row_id, F.col("top_cm").alias("host_top_cm"), F.col("base_cm").alias("host_base_cm"))
    project = lambda at: iv.scaled_cm(
        F.col(at), F.col("source_top_cm"), F.col("source_base_cm"), F.col("host_top_cm"), F.col("host_base_cm"))
    spans = (
        masks.filter(F.col("source_base_cm") > F.col("source_top_cm")).join(hosts, row_id)
        .select(*row_id, project("mask_top_cm").alias("top_cm"), project("mask_base_cm").alias("base_cm"))
    )
    return iv.key_gaps(hosts, spans, row_id, hosted=True)


def permille(part, whole):
    ratio = F.round((part * 1000).cast("decimal(20,1)") / whole.cast("decimal(18,0)"), 0).cast("bigint")
    return F.when(whole > 0, ratio).otherwise(F.lit(0)).cast("bigint")


def audit_layers(layers: DataFrame, photos: DataFrame, *, well: str = "well") -> DataFrame:
    """Layers of wells that have photos, each with its photographed length."""
    return iv.covered_length(layers, photos, [well], ["layer_id"])


def label_audit(rows: DataFrame, *, label: str = "label", well: str = "well") -> DataFrame:
    """Metres, coverage and readiness per label, deepest first."""
    drilled, covered = F.col("drilled_cm"), F.col("covered_cm")
    return (
        rows.groupBy(label).agg(
            F.sum(F.col("base_cm") - F.col("top_cm")).alias("drilled_cm"),
            F.sum("covered_cm").alias("covered_cm"), F.count(F.lit(1)).alias("intervals"),
            F.countDistinct(well).alias("wells"))
        .withColumn("coverage_permille", permille(covered, drilled))
        .withColumn(
            "readiness",
            F.when((covered < 200) | (F.col("wells") < 2), "scarce")
            .when((covered < 1000) | (F.col("wells") < 3), "limited").otherwise("enough"))
        .orderBy(drilled.desc(), F.lower(label))
    )


def well_audit(rows: DataFrame, *, well: str = "well") -> DataFrame:
    """Rows, metres and coverage per well."""
    return rows.groupBy(well).agg(
        F.count(F.lit(1)).alias("layer_rows"),
        F.sum(F.col("base_cm") - F.col("top_cm")).alias("drilled_cm"),
        F.sum("covered_cm").alias("covered_cm"),
    ).withColumn("coverage_permille", permille(F.col("covered_cm"), F.col("drilled_cm")))


def audit_levels(rows: DataFrame, *, label: str = "label", well: str = "well") -> DataFrame:
    """Well, label and total levels in one pass with grouping sets."""
    return (
        rows.groupingSets([[F.col(well)], [F.col(label)], []], F.col(well), F.col(label))
        .agg(
            F.grouping(well).cast("bigint").alias("no_well"), F.grouping(label).cast("bigint").alias("no_label"),
            F.sum(F.col("base_cm") - F.col("top_cm")).alias("drilled_cm"),
            F.sum("covered_cm").alias("covered_cm"), F.count(F.lit(1)).alias("intervals"))
    )


def layers_of_photo_wells(layers: DataFrame, photos: DataFrame, *, well: str = "well") -> DataFrame:
    """Layers of wells that have photos; all layers when there are no photos at all."""
    have = photos.select(F.col(well).alias("__w")).distinct()
    any_photo = photos.agg(F.count(F.lit(1)) > 0).scalar()
    marked = layers.join(have, F.col(well) == F.col("__w"), "left")
    return marked.filter(F.col("__w").isNotNull() | ~any_photo).drop("__w")


def layer_inventory(layers: DataFrame, photos: DataFrame, matches: DataFrame, *, ident: str = "layer_id", photo: str = "photo", well: str = "well") -> DataFrame:
    """Five-state status of every layer against photos and matches."""
    matched = matches.groupBy(ident).agg(F.countDistinct(photo).alias("matched_photos"), F.max(F.col("basis") == "gis").alias("__gis"))
    spans = layers.select(ident, well, F.inline(F.array(
        F.struct(F.col("top_cm").alias("top_cm"), F.col("base_cm").alias("base_cm")), F.struct(F.col("gis_top_cm").alias("top_cm"), F.col("gis_base_cm").alias("base_cm")))))
    right = photos.select(photo, well, F.col("top_cm").alias("r_top_cm"), F.col("base_cm").alias("r_base_cm"))
    near = iv.overlap_join(spans, right, [well]).groupBy(ident).agg(F.countDistinct(photo).alias("overlapping_photos"))
    base = layers.groupBy(ident).agg(F.min("thickness_valid").alias("__valid"))
    n, o = F.coalesce("matched_photos", F.lit(0)), F.coalesce("overlapping_photos", F.lit(0))
    status = (
        F.when((n > 0) & F.col("__gis"), "MATCHED_GIS_FALLBACK").when(n > 0, "MATCHED").when(~F.col("__valid"), "INVALID_FACIES_THICKNESS")
        .when(o > 0, "PHOTO_OVERLAPS_BUT_ROW_NOT_MATCHED").otherwise("NO_PHOTO_OVERLAP"))
    return base.join(matched, ident, "left").join(near, ident, "left").select(ident, n.alias("matched_photos"), o.alias("overlapping_photos"), status.alias("status"))


def photo_inventory(photos: DataFrame, matches: DataFrame, masks: DataFrame, columns: DataFrame, *, photo: str = "photo", ident: str = "layer_id") -> DataFrame:
    """Five-state status of every photo."""
    parts = (
        (columns.groupBy(photo).agg(F.count(F.lit(1)).alias("core_columns"))), (matches.groupBy(photo).agg(F.countDistinct(ident).alias("matched_layers"))),
        (masks.groupBy(photo).agg(F.count(F.lit(1)).alias("mask_count"))))
    out = photos
    for part in parts:
        out = out.join(part, photo, "left")
    counts = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("core_columns", "matched_layers", "mask_count")}
    out = out.withColumns(counts)
    status = (
        F.when(~F.col("confirmed") | ~F.coalesce(F.col("base_cm") > F.col("top_cm"), F.lit(False)), "NO_CONFIRMED_INTERVAL")
        .when(F.col("core_columns") == 0, "NO_CORE_COLUMNS").when(F.col("matched_layers") == 0, "NO_FACIES_MATCH")
        .when(F.col("mask_count") == 0, "NO_MASKS").otherwise("READY_FOR_REVIEW"))
    return out.select(photo, *counts, status.alias("status"))
