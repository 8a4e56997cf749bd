"""Report frames: inventories, catalogs, exchange rows, rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def stacked(df: DataFrame, keys: Sequence[str], override: str, natural: str) -> DataFrame:
    """Place by explicit stack order, then natural order (W13); a photo's detections at a time."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(override).asc_nulls_last(), natural)).cast("bigint"))


def project_counters(photos: DataFrame, layers: DataFrame, matches: DataFrame, annotations: DataFrame, issues: DataFrame) -> DataFrame:
    """One row of project counters (N12): each source is reduced to one row before they meet."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    parts = [
        photos.agg(F.count(F.lit(1)).alias("photos"), F.count_if("confirmed").alias("confirmed_photos"), F.count_if(~F.col("confirmed")).alias("unconfirmed_photos"),
                   F.count_if(~F.col("confirmed") | ~(F.col("base_cm") > F.col("top_cm"))).alias("photos_without_intervals")),
        layers.agg(F.count(F.lit(1)).alias("layers"), F.count_if(~blank("target_text")).alias("text_targets"), F.count_if(blank("target_text")).alias("layers_without_description"),
                   F.count_if(~F.col("thickness_valid")).alias("invalid_thickness_rows")),
        matches.agg(F.count(F.lit(1)).alias("matches"), F.countDistinct("photo").alias("photos_with_layers"), F.count_if(F.col("basis") == "gis").alias("gis_matches")),
        annotations.agg(F.count(F.lit(1)).alias("annotations"), F.count_if("approved").alias("approved_annotations"), F.countDistinct("photo").alias("photos_with_masks")),
        issues.agg(F.count_if(F.col("severity") == "error").alias("blocking_errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))]
    out = parts[0].withColumn("__k", F.lit(1))
    for part in parts[1:]:
        out = out.join(part.withColumn("__k", F.lit(1)), "__k")
    return out.drop("__k")


def coverage_counters(
    photos: DataFrame, columns: DataFrame, layers: DataFrame, matches: DataFrame, annotations: DataFrame, *, sequenced: Sequence[str],
) -> DataFrame:
    """One row of what a project still lacks (N12): photos without columns, labels or masks, layers without a photo, open ground.

    ``photos``: photo, confirmed, top_cm, base_cm, source; ``columns``: photo, verified; ``layers``:
    layer_id; ``matches``: photo, layer_id, overlap_top_cm, overlap_base_cm, described (bool);
    ``annotations``: photo, label, target_text.  Open ground is counted in gaps of confirmed photos.
    Every source is reduced to one row per photo before it meets the photos.
    """
    from depthlake.operators.intervals import key_gaps

    boxes = columns.groupBy("photo").agg(F.bool_or(F.coalesce("verified", F.lit(False))).alias("__verified"))
    labelled = matches.select("photo").distinct().withColumn("__labelled", F.lit(True))
    masked = annotations.select("photo").distinct().withColumn("__masked", F.lit(True))
    flags = photos.join(boxes, "photo", "left").join(labelled, "photo", "left").join(masked, "photo", "left")
    hosts = photos.filter(F.col("confirmed") & (F.col("base_cm") > F.col("top_cm"))).select("photo", F.col("top_cm").alias("host_top_cm"), F.col("base_cm").alias("host_base_cm"))
    open_ground = lambda spans: key_gaps(hosts, spans.select("photo", F.col("overlap_top_cm").alias("top_cm"), F.col("overlap_base_cm").alias("base_cm")), ["photo"])
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [
        flags.agg(
            F.count_if(F.col("__verified").isNull()).alias("photos_without_core_columns"), F.count_if("__verified").alias("verified_column_photos"),
            F.count("__labelled").alias("photos_with_labels"), F.count_if(F.col("__labelled").isNull()).alias("photos_without_labels"),
            F.count_if(F.col("__masked").isNull()).alias("photos_without_masks"), F.count_if(F.col("source").isin(*sequenced)).alias("sequenced_photos")),
        count(layers.join(matches.select("layer_id").distinct(), "layer_id", "left_anti"), "layers_without_photo"),
        annotations.agg(
            F.count_if(F.trim(F.coalesce("target_text", F.lit(""))) != "").alias("annotation_text_targets"),
            F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(F.lower("label").alias("folded"), "label"))), lambda x: x["label"]), ",").alias("classes")),
        count(open_ground(matches), "open_label_gaps"), count(open_ground(matches.filter("described")), "open_description_gaps")]
    out = parts[0].withColumn("__k", F.lit(1))
    for part in parts[1:]:
        out = out.join(part.withColumn("__k", F.lit(1)), "__k")
    return out.drop("__k")


def import_summary(layers: DataFrame, core: tuple[str, str] = ("core_top_cm", "core_base_cm")) -> DataFrame:
    """Distinct wells, labels and core intervals of an import and its row counts."""
    return layers.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("well").alias("wells"), F.countDistinct("label").alias("labels"),
        F.countDistinct("well", *core).alias("core_intervals"), F.count_if(F.trim(F.coalesce("description", F.lit(""))) != "").alias("described"))


def core_ranges(layers: DataFrame, *, well: str = "well") -> DataFrame:
    """Core range per well, layer extent where no core is given."""
    return layers.groupBy(well).agg(
        F.coalesce(F.min("core_top_cm"), F.min("top_cm")).alias("top_cm"), F.coalesce(F.max("core_base_cm"), F.max("base_cm")).alias("base_cm"))


def catalog_overview(projects: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per project: photos, masks, approvals, distinct wells and classes."""
    per = annotations.groupBy("project").agg(
        F.count(F.lit(1)).alias("masks"), F.count_if("approved").alias("approved"), F.countDistinct("photo").alias("photos"),
        F.countDistinct(F.lower(F.col("label"))).alias("classes"), F.array_sort(F.collect_set(F.col("well").cast("string"))).alias("wells"))
    return projects.join(per, "project", "left")


def overview_totals(overview: DataFrame) -> DataFrame:
    return overview.agg(F.count(F.lit(1)).alias("projects"), F.sum("photos").alias("photos"), F.sum("masks").alias("masks"), F.sum("approved").alias("approved"))


def training_history(runs: DataFrame, *, score: str = "map") -> DataFrame:
    """Runs ranked by score, unscored last."""
    return runs.orderBy(F.col(score).desc_nulls_last(), "run")


def correlation_markers(markers: DataFrame, wells: DataFrame, *, label: str = "label", well: str = "well") -> DataFrame:
    """First marker per (label, well); labels of at least two wells reach every well, mean ratio where missing."""
    first = markers.groupBy(label, well).agg(F.min_by("ratio", "pos").alias("ratio"))
    active = first.groupBy(label).agg(F.count(F.lit(1)).alias("__n"), F.avg("ratio").alias("__mean")).filter("__n >= 2")
    # Labels and wells are both short reference lists; their grid is the answer itself.
    grid = active.select(label, "__mean", F.explode(wells.agg(F.collect_set(well)).scalar()).alias(well))
    return grid.join(first, [label, well], "left").select(
        label, well, F.coalesce("ratio", "__mean").alias("ratio"), F.col("ratio").isNotNull().alias("observed"))


def archive_stage(entries: DataFrame, confirmed: DataFrame, prepared: DataFrame) -> DataFrame:
    """Five-state stage of a queue entry."""
    mark = lambda df, name: df.select("project").distinct().withColumn(name, F.lit(True))
    j = entries.join(mark(confirmed, "__c"), "project", "left").join(mark(prepared, "__p"), "project", "left")
    named = F.coalesce(F.col("project") != "", F.lit(False))
    stage = (
        F.when(F.coalesce("photos", F.lit("")) == "", "needs photos").when(named & F.col("__c"), "confirmed").when(named & F.col("__p"), "review masks")
        .when(F.coalesce("error", F.lit("")) != "", "error").otherwise("new"))
    return j.withColumn("stage", stage).drop("__c", "__p")


def class_readiness(registry: DataFrame, masks: DataFrame, *, label: str = "label", least: int = 5) -> DataFrame:
    """Registry with reviewed counts, photos, mean filled attributes and status."""
    per = masks.filter("reviewed").groupBy(label).agg(
        F.count(F.lit(1)).alias("reviewed"), F.countDistinct("photo").alias("photos"), F.avg(F.size(F.map_filter("attributes", lambda k, v: v != ""))).alias("filled"))
    n = F.coalesce("reviewed", F.lit(0))
    return registry.join(per, label, "left").select(
        label, n.cast("bigint").alias("reviewed"), F.coalesce("photos", F.lit(0)).cast("bigint").alias("photos"), "filled",
        F.when(n == 0, "no examples").when(n < least, "few examples").otherwise("review the sample").alias("status"))


def layer_lines(layers: DataFrame) -> DataFrame:
    """Layer detail text for reports: span, class and filled attributes."""
    attrs = F.array_join(F.transform(F.array_sort(F.map_entries(F.map_filter("attributes", lambda k, v: v != ""))), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    from depthlake.functions.numbers import format_depth

    span = F.concat(format_depth(F.col("top_cm")), F.lit("–"), format_depth(F.col("base_cm")), F.lit(" м"))
    return layers.withColumn("detail", F.concat_ws("; ", span, "label", F.when(attrs != "", attrs)))


def catalog_union(observed: DataFrame, metadata: DataFrame, key: str = "label") -> DataFrame:
    """Metadata over observed rows, one entry per folded key, last wins."""
    both = observed.withColumn("__p", F.lit(0)).unionByName(metadata.withColumn("__p", F.lit(1)))
    values = [c for c in observed.columns if c != "pos"]
    return both.groupBy(F.lower(key).alias("__k")).agg(F.max_by(F.struct(*values), F.struct("__p", "pos")).alias("__v")).select("__v.*")


def caption_vocabulary(rows: DataFrame, text: str) -> DataFrame:
    """Distinct characters and their use."""
    return rows.select(F.explode(F.split(text, "")).alias("symbol")).filter("symbol <> ''").groupBy("symbol").agg(F.count(F.lit(1)).alias("uses"))


def caption_limits(rows: DataFrame, text: str, conditions: Sequence[str]) -> DataFrame:
    return rows.agg(F.max(F.length(text)).cast("bigint").alias("longest"), F.countDistinct(*conditions).alias("conditions"))


def official_rows(layers: DataFrame, *, well: str = "well") -> DataFrame:
    """18-column layer description rows (K5); layers are numbered per well by depth."""
    from depthlake.operators.scan import numbered

    n = numbered(layers, [well], ["top_cm", "base_cm", "layer_id"], "layer_no")
    core = layers.groupBy(well).agg(F.min("core_top_cm").alias("__ct"), F.max("core_base_cm").alias("__cb"))
    m = lambda c: (c.cast("decimal(18,0)") / 100).cast("decimal(18,3)")
    index = F.coalesce(F.when(F.col("facies_index") != "", F.col("facies_index")), F.when(F.col("label") != "", F.col("label")), F.lit("не указано"))
    return n.join(core, well).select(
        F.coalesce("field", F.lit("не указано")).alias("field"), well, F.lit("").alias("core_run"), m(F.col("__ct")).alias("core_top"), m(F.col("__cb")).alias("core_base"),
        m(F.abs(F.col("__cb") - F.col("__ct"))).alias("drilled"), F.lit("").alias("recovered"), F.lit("").alias("recovery_percent"), m(F.col("top_cm")).alias("top"), m(F.col("base_cm")).alias("base"),
        "layer_no", m(F.abs(F.col("base_cm") - F.col("top_cm"))).alias("thickness"), index.alias("facies_index"), F.coalesce(F.when(F.col("facies_name") != "", F.col("facies_name")), index).alias("facies_name"),
        F.coalesce("facies_code", F.lit("")).alias("facies_code"), F.coalesce(F.when(F.trim("description") != "", F.col("description")), F.lit("Описание не заполнено")).alias("description"),
        F.coalesce("note", F.lit("")).alias("note"), F.coalesce(F.when(F.trim("lithology") != "", F.col("lithology")), F.lit("Литологические параметры не заполнены")).alias("lithology"))


# Columns of the 23-column exchange table, in order.
EXCHANGE_COLUMNS = (
    "field_name", "well", "core_run", "core_top", "core_base", "stratigraphy", "gis_shift", "gis_core_top", "gis_core_base", "drilled", "recovered",
    "recovery_percent", "facies_top", "facies_base", "gis_facies_top", "gis_facies_base", "layer_no", "thickness", "facies_index", "facies_name",
    "association", "environment", "description",
)


def exchange_rows(rows: DataFrame) -> DataFrame:
    """23-column exchange rows; a missing thickness is base minus top (K6)."""
    have = set(rows.columns)
    cols = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in EXCHANGE_COLUMNS]
    out = rows.select(*cols)
    thick = F.round(F.col("facies_base").cast("double") - F.col("facies_top").cast("double"), 4)
    return out.withColumn("thickness", F.coalesce(F.col("thickness").cast("double"), thick))


def gis_columns(rows: DataFrame) -> DataFrame:
    """Depths of gis-based rows go to the gis columns."""
    gis = F.col("depth_basis") == "gis"
    moves = {}
    for main, spare in (("facies_top", "gis_facies_top"), ("facies_base", "gis_facies_base"), ("core_top", "gis_core_top"), ("core_base", "gis_core_base")):
        moves[spare] = F.when(gis, F.col(main))
        moves[main] = F.when(~gis, F.col(main))
    return rows.withColumns(moves)


def confirm_manual(rows: DataFrame, edits: DataFrame, key: str = "photo") -> DataFrame:
    """Manual well and bounds; what was read from the old span is reset only on a real change."""
    e = edits.select(key, F.trim(F.col("well").cast("string")).alias("e_well"), F.col("top_cm").alias("e_top"), F.col("base_cm").alias("e_base"))
    j = rows.join(e, key)
    changed = ~(F.trim(F.col("well").cast("string")).eqNullSafe(F.col("e_well")) & F.col("top_cm").eqNullSafe(F.col("e_top")) & F.col("base_cm").eqNullSafe(F.col("e_base")))
    return j.select(
        key, F.col("e_well").alias("well"), F.col("e_top").alias("top_cm"), F.col("e_base").alias("base_cm"), F.when(changed, "manual").otherwise(F.col("source")).alias("source"),
        F.lit(True).alias("confirmed"), F.when(~changed, F.col("column_depths")).alias("column_depths"), F.when(changed, "unknown").otherwise(F.col("depth_basis")).alias("depth_basis"))


def well_order(rows: DataFrame, explicit: DataFrame, *, well: str = "well", pos: str = "pos") -> DataFrame:
    """Wells in the explicit order, the rest by first appearance."""
    first = rows.groupBy(well).agg(F.min(pos).alias("__first"))
    return first.join(explicit.select(well, F.col("rank").alias("__r")), well, "left").orderBy(F.col("__r").asc_nulls_last(), "__first").select(well)


def search(rows: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Rows where any shown column contains the text."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(text.casefold()))
    return rows.filter(hit)


def interval_source(candidates: Sequence[tuple[str, Column, Column]]) -> Column:
    """First candidate span with both ends, and where it came from."""
    tries = [F.when(t.isNotNull() & b.isNotNull() & (b > t), F.struct(F.lit(name).alias("source"), t.alias("top_cm"), b.alias("base_cm"))) for name, t, b in candidates]
    return F.coalesce(*tries, F.struct(F.lit("unresolved").alias("source"), F.lit(None).cast("bigint").alias("top_cm"), F.lit(None).cast("bigint").alias("base_cm")))


def class_ids(rows: DataFrame, *, label: str = "label") -> DataFrame:
    """Class ids by folded name (O5); one row per class."""
    names = rows.select(label).distinct()
    return names.select(label, (F.row_number().over(W.orderBy(F.lower(label), label)) - 1).cast("bigint").alias("class_id"))


def photo_order(photos: DataFrame, *, name: str = "name") -> DataFrame:
    """Canonical photo order: well key, top, base, natural name (O1)."""
    from depthlake.functions.text import natural_key, well_key

    return photos.orderBy(well_key(F.col("well").cast("string")), F.col("top_cm").asc_nulls_last(), F.col("base_cm").asc_nulls_last(), natural_key(F.col(name)))


def layer_order(layers: DataFrame, *, ident: str = "layer_id") -> DataFrame:
    """Layer order: well key, top, base, source (O2)."""
    from depthlake.functions.text import well_key

    return layers.orderBy(well_key(F.col("well").cast("string")), "top_cm", "base_cm", ident)
