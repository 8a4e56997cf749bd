"""Queries for the interval core: overlap joins, unions, gaps, resolution, coalescing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from depthlake.operators import audit, intervals as iv
from depthlake.plans.proxies import Tables
from depthlake.plans.registry import query


def _right(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumnsRenamed({"top_cm": "r_top_cm", "base_cm": "r_base_cm"})


def shifted(t: Tables) -> DataFrame:
    """Layers with a second, shifted depth system."""
    shift = F.col("well") % 7
    return t.layers().withColumn("gis_top_cm", F.col("top_cm") - shift).withColumn(
        "gis_base_cm", F.col("base_cm") - shift)


MERGED = """
  {name}_run AS (SELECT *, max(base_cm) OVER (PARTITION BY {k} ORDER BY top_cm, base_cm
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM {src} WHERE base_cm > top_cm),
  {name}_isl AS (SELECT *, sum(CASE WHEN prev IS NULL OR top_cm > prev THEN 1 ELSE 0 END)
      OVER (PARTITION BY {k} ORDER BY top_cm, base_cm ROWS UNBOUNDED PRECEDING) AS isl FROM {name}_run),
  {name} AS (SELECT {k}, min(top_cm) AS top_cm, max(base_cm) AS base_cm FROM {name}_isl GROUP BY {k}, isl)"""


def merged(name: str, src: str, k: str = "well") -> str:
    return MERGED.format(name=name, src=src, k=k)


CONF = "conf_photos AS (SELECT well, top_cm, base_cm FROM photos WHERE confirmed)"
COVER = f"""{CONF}, {merged('cover', 'conf_photos')},
  cov AS (SELECT l.*, coalesce((SELECT sum(least(l.base_cm, c.base_cm) - greatest(l.top_cm, c.top_cm)) FROM cover c
     WHERE c.well = l.well AND c.base_cm > l.top_cm AND c.top_cm < l.base_cm), 0) AS covered_cm FROM layers l)"""


@query("J1_overlap_join", """
SELECT p.photo, l.layer_id, p.well, greatest(p.top_cm, l.top_cm) AS overlap_top_cm,
  least(p.base_cm, l.base_cm) AS overlap_base_cm
FROM photos p JOIN layers l ON p.well = l.well AND l.base_cm > p.top_cm AND l.top_cm < p.base_cm
WHERE p.confirmed""")
def overlap_join(t: Tables) -> DataFrame:
    left = t.photos().filter("confirmed").select("photo", "well", "top_cm", "base_cm")
    right = _right(t.layers().select("well", "layer_id", "top_cm", "base_cm"))
    return iv.overlap_join(left, right, ["well"]).select(
        "photo", "layer_id", "well", "overlap_top_cm", "overlap_base_cm")


@query("J3_salted_overlap_counts", """
SELECT p.well, count(*) AS pairs,
  CAST(sum(least(p.base_cm, l.base_cm) - greatest(p.top_cm, l.top_cm)) AS BIGINT) AS shared_cm
FROM photos p JOIN layers l ON p.well = l.well AND l.base_cm > p.top_cm AND l.top_cm < p.base_cm
GROUP BY p.well""")
def salted_overlap(t: Tables) -> DataFrame:
    left = t.photos().select("photo", "well", "top_cm", "base_cm")
    right = _right(t.layers().select("well", "top_cm", "base_cm"))
    pairs = iv.overlap_join(left, right, ["well"], salt=4, bin_cm=2048)
    return pairs.groupBy("well").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.sum(F.col("overlap_base_cm") - F.col("overlap_top_cm")).alias("shared_cm"))


@query("J4_layers_for_interval", """
SELECT layer_id, label, top_cm, base_cm FROM layers
WHERE well = 3 AND base_cm > 20000 AND top_cm < 60000 AND base_cm > top_cm""")
def layers_for_interval(t: Tables) -> DataFrame:
    hit = iv.overlap_bounds("top_cm", "base_cm", "q_top", "q_base")[2]
    return (
        t.layers().withColumn("q_top", F.lit(20000)).withColumn("q_base", F.lit(60000))
        .filter((F.col("well") == 3) & hit & (F.col("base_cm") > F.col("top_cm")))
        .select("layer_id", "label", "top_cm", "base_cm")
    )


@query("N1_union_intervals", f"WITH {merged('u', 'layers')} SELECT well, top_cm, base_cm FROM u")
def union_intervals(t: Tables) -> DataFrame:
    return iv.union_intervals(t.layers(), ["well"]).select("well", "top_cm", "base_cm")


@query("N2_union_length", f"""
WITH {merged('u', 'layers')},
 a AS (SELECT well, sum(base_cm - top_cm) AS union_cm FROM u GROUP BY well),
 b AS (SELECT well, sum(base_cm - top_cm) AS raw_cm FROM layers WHERE base_cm > top_cm GROUP BY well)
SELECT well, CAST(raw_cm AS BIGINT) AS raw_cm, CAST(union_cm AS BIGINT) AS union_cm,
  CAST(raw_cm - union_cm AS BIGINT) AS double_counted_cm FROM a JOIN b USING (well)""")
def union_length(t: Tables) -> DataFrame:
    return iv.union_length(t.layers(), ["well"])


def gap_sql(spans: str) -> str:
    return f"""
 clip AS (SELECT h.photo, greatest(h.top_cm, s.top_cm) AS a, least(h.base_cm, s.base_cm) AS b
   FROM hosts h JOIN ({spans}) s ON s.well = h.well AND s.base_cm > h.top_cm AND s.top_cm < h.base_cm
   UNION ALL SELECT photo, base_cm, base_cm FROM hosts),
 cur AS (SELECT c.photo, h.well, c.a, greatest(h.top_cm, coalesce(max(c.b) OVER (PARTITION BY c.photo ORDER BY c.a, c.b
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), h.top_cm)) AS cursor FROM clip c JOIN hosts h USING (photo))
 SELECT photo, well, cursor AS gap_top_cm, a AS gap_base_cm FROM cur WHERE a > cursor"""


def _hosts(t: Tables) -> DataFrame:
    return t.photos().filter("confirmed").select(
        "photo", "well", F.col("top_cm").alias("host_top_cm"), F.col("base_cm").alias("host_base_cm"))


@query("N3_gaps", f"""
WITH hosts AS (SELECT photo, well, top_cm, base_cm FROM photos WHERE confirmed),
{gap_sql('SELECT well, top_cm, base_cm FROM layers')}""")
def gaps(t: Tables) -> DataFrame:
    return iv.gaps(_hosts(t), t.layers().select("well", "top_cm", "base_cm"), ["well"]).select(
        "photo", "well", "gap_top_cm", "gap_base_cm")


@query("N4_gaps_of_described_rows", f"""
WITH hosts AS (SELECT photo, well, top_cm, base_cm FROM photos WHERE confirmed),
{gap_sql("SELECT well, top_cm, base_cm FROM layers WHERE trim(CASE WHEN label = 'RF' THEN ' ' ELSE label END) <> ''")}""")
def described_gaps(t: Tables) -> DataFrame:
    text = F.when(F.col("label") == "RF", " ").otherwise(F.col("label"))
    rows = t.layers().withColumn("target_text", text)
    return audit.description_gaps(_hosts(t), rows, ["well"], text="target_text").select(
        "photo", "well", "gap_top_cm", "gap_base_cm")


@query("N5_core_ranges_without_photos", f"""
WITH {CONF},
 hosts AS (SELECT DISTINCT well, 1000 * CAST(floor(top_cm / 1000) AS BIGINT) AS top_cm,
   1000 * CAST(floor(top_cm / 1000) AS BIGINT) + 1000 AS base_cm FROM layers),
 clip AS (SELECT h.well, h.top_cm AS ht, greatest(h.top_cm, s.top_cm) AS a, least(h.base_cm, s.base_cm) AS b
   FROM hosts h JOIN conf_photos s ON s.well = h.well AND s.base_cm > h.top_cm AND s.top_cm < h.base_cm
   UNION ALL SELECT well, top_cm, base_cm, base_cm FROM hosts),
 cur AS (SELECT well, ht, a, greatest(ht, coalesce(max(b) OVER (PARTITION BY well, ht ORDER BY a, b
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ht)) AS cursor FROM clip)
SELECT well, ht AS core_top_cm, ht + 1000 AS core_base_cm, cursor AS gap_top_cm, a AS gap_base_cm
FROM cur WHERE a > cursor""")
def uncovered_core(t: Tables) -> DataFrame:
    bucket = F.floor(F.col("top_cm") / 1000).cast("bigint") * 1000
    cores = t.layers().select("well", bucket.alias("core_top_cm"), (bucket + 1000).alias("core_base_cm"))
    photos = t.photos().filter("confirmed").select("well", "top_cm", "base_cm")
    return audit.uncovered_ranges(cores, photos, ["well"], bounds=("core_top_cm", "core_base_cm")).select(
        "well", "core_top_cm", "core_base_cm", "gap_top_cm", "gap_base_cm")


@query("N6_rows_not_covered_by_masks", """
WITH l AS (SELECT layer_id, min(top_cm) AS top_cm, max(base_cm) AS base_cm FROM layers GROUP BY layer_id),
 m AS (SELECT layer_id, top_cm, base_cm, top_cm + (base_cm - top_cm) * k // 4 AS a,
     top_cm + (base_cm - top_cm) * (k + 1) // 4 AS b
   FROM l, (VALUES (0), (1), (3)) v(k) WHERE base_cm > top_cm),
 s AS (SELECT layer_id, top_cm AS t, base_cm AS z, a, b FROM m UNION ALL SELECT layer_id, top_cm, base_cm, base_cm, base_cm FROM l),
 c AS (SELECT layer_id, a, greatest(t, coalesce(max(b) OVER (PARTITION BY layer_id ORDER BY a, b
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t)) AS cursor FROM s)
SELECT layer_id, cursor AS gap_top_cm, a AS gap_base_cm FROM c WHERE a > cursor""")
def mask_gaps(t: Tables) -> DataFrame:
    rows = t.layers().groupBy("layer_id").agg(F.min("top_cm").alias("top_cm"), F.max("base_cm").alias("base_cm"))
    part = F.explode(F.array(*[F.lit(k) for k in (0, 1, 3)]))
    span = F.col("base_cm") - F.col("top_cm")
    masks = rows.withColumn("k", part).select(
        "layer_id",
        F.col("top_cm").alias("source_top_cm"), F.col("base_cm").alias("source_base_cm"),
        (F.col("top_cm") + F.expr("((base_cm - top_cm) * k) div 4")).alias("mask_top_cm"),
        (F.col("top_cm") + F.expr("((base_cm - top_cm) * (k + 1)) div 4")).alias("mask_base_cm"))
    del span
    return audit.mask_gaps(rows, masks, ["layer_id"]).select("layer_id", "gap_top_cm", "gap_base_cm")


@query("N7_covered_length", f"WITH {COVER} SELECT layer_id, well, top_cm, base_cm, CAST(covered_cm AS BIGINT) AS covered_cm FROM cov")
def covered_length(t: Tables) -> DataFrame:
    photos = t.photos().filter("confirmed")
    rows = t.layers().select("layer_id", "well", "top_cm", "base_cm")
    return iv.covered_length(rows, photos, ["well"], ["layer_id"]).select(
        "layer_id", "well", "top_cm", "base_cm", "covered_cm")


def audit_rows(t: Tables) -> DataFrame:
    return audit.audit_layers(t.layers(), t.photos().filter("confirmed"), well="well")


@query("N8_label_audit", f"""
WITH {COVER}, g AS (SELECT label, CAST(sum(base_cm - top_cm) AS BIGINT) AS drilled_cm,
   CAST(sum(covered_cm) AS BIGINT) AS covered_cm, count(*) AS intervals, count(DISTINCT well) AS wells FROM cov GROUP BY label)
SELECT *, CASE WHEN drilled_cm > 0 THEN CAST(round(covered_cm * 1000.0::DECIMAL(20,1) / drilled_cm, 0) AS BIGINT) ELSE 0 END AS coverage_permille,
  CASE WHEN covered_cm < 200 OR wells < 2 THEN 'scarce' WHEN covered_cm < 1000 OR wells < 3 THEN 'limited' ELSE 'enough' END AS readiness
FROM g ORDER BY drilled_cm DESC, lower(label)""")
def label_audit(t: Tables) -> DataFrame:
    return audit.label_audit(audit_rows(t))


@query("N9_well_audit", f"""
WITH {COVER} SELECT well, count(*) AS layer_rows, CAST(sum(base_cm - top_cm) AS BIGINT) AS drilled_cm,
  CAST(sum(covered_cm) AS BIGINT) AS covered_cm,
  CASE WHEN sum(base_cm - top_cm) > 0 THEN CAST(round(sum(covered_cm) * 1000.0::DECIMAL(20,1) / sum(base_cm - top_cm), 0) AS BIGINT) ELSE 0 END AS coverage_permille
FROM cov GROUP BY well""")
def well_audit(t: Tables) -> DataFrame:
    return audit.well_audit(audit_rows(t))


@query("N8_N9_audit_levels", f"""
WITH {COVER} SELECT well, label, GROUPING(well) AS no_well, GROUPING(label) AS no_label,
  CAST(sum(base_cm - top_cm) AS BIGINT) AS drilled_cm, CAST(sum(covered_cm) AS BIGINT) AS covered_cm, count(*) AS intervals
FROM cov GROUP BY GROUPING SETS ((well), (label), ())""")
def audit_levels(t: Tables) -> DataFrame:
    return audit.audit_levels(audit_rows(t))


SEGS = """
 m AS (SELECT DISTINCT {k}, unnest([top_cm, base_cm]) AS d FROM {src} WHERE base_cm > top_cm),
 e AS (SELECT {k}, d AS s, lead(d) OVER (PARTITION BY {k} ORDER BY d) AS z FROM m)"""


@query("W3_resolve_overlaps", f"""
WITH {SEGS.format(k='well', src='layers')},
 w AS (SELECT e.well, e.s, e.z, max(struct_pack(conf := l.conf, neg := -l.top_cm, id := l.layer_id)) AS b
   FROM e JOIN layers l ON l.well = e.well AND l.top_cm <= e.s AND l.base_cm >= e.z WHERE e.z IS NOT NULL GROUP BY ALL),
 f AS (SELECT well, s, z, b.id AS layer_id, CASE WHEN lag(b.id) OVER (PARTITION BY well ORDER BY s) = b.id
   AND lag(z) OVER (PARTITION BY well ORDER BY s) = s THEN 0 ELSE 1 END AS n FROM w),
 r AS (SELECT *, sum(n) OVER (PARTITION BY well ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT well, layer_id, min(s) AS top_cm, max(z) AS base_cm FROM r GROUP BY well, run, layer_id""")
def resolve(t: Tables) -> DataFrame:
    return iv.resolve_overlaps(
        t.layers(), ["well"], rank=[F.col("conf"), -F.col("top_cm")], ident="layer_id",
    ).select("well", "layer_id", "top_cm", "base_cm")


@query("W4_partition_hosts", """
WITH hosts AS (SELECT well, min(top_cm) - 100 AS ht, max(base_cm) + 100 AS hb FROM layers GROUP BY well),
 m AS (SELECT DISTINCT well, unnest([top_cm, base_cm]) AS d FROM layers WHERE base_cm > top_cm
   UNION SELECT well, unnest([ht, hb]) FROM hosts),
 e AS (SELECT well, d AS s, lead(d) OVER (PARTITION BY well ORDER BY d) AS z FROM m),
 w AS (SELECT e.well, e.s, e.z, max(struct_pack(conf := l.conf, id := l.layer_id, label := l.label)) FILTER (WHERE l.well IS NOT NULL) AS b
   FROM e LEFT JOIN layers l ON l.well = e.well AND l.top_cm <= e.s AND l.base_cm >= e.z WHERE e.z IS NOT NULL GROUP BY ALL),
 g AS (SELECT well, s, z, b IS NULL AS gap_filled, CASE WHEN b IS NULL THEN 'Не определена' ELSE b.label END AS label,
   CASE WHEN b IS NULL THEN 0 ELSE b.conf END AS conf FROM w),
 f AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY well ORDER BY s) = label
   AND lag(gap_filled) OVER (PARTITION BY well ORDER BY s) = gap_filled THEN 0 ELSE 1 END AS n FROM g),
 r AS (SELECT *, sum(n) OVER (PARTITION BY well ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT well, label, gap_filled, min(s) AS top_cm, max(z) AS base_cm, min(conf) AS conf FROM r GROUP BY well, run, label, gap_filled""")
def partition(t: Tables) -> DataFrame:
    hosts = t.layers().groupBy("well").agg(
        (F.min("top_cm") - 100).alias("host_top_cm"), (F.max("base_cm") + 100).alias("host_base_cm"))
    return iv.partition_hosts(
        hosts, t.layers(), ["well"], rank=[F.col("conf"), F.col("layer_id")], identity=["label"],
        confidence="conf", gap_label="Не определена", label="label",
    ).select("well", "label", "gap_filled", "top_cm", "base_cm", "conf")


@query("W2_coalesce_adjacent", """
WITH o AS (SELECT *, CASE WHEN lag(label) OVER w = label THEN 0 ELSE 1 END AS n FROM layers
   WINDOW w AS (PARTITION BY well ORDER BY top_cm, base_cm, layer_id)),
 r AS (SELECT *, sum(n) OVER (PARTITION BY well ORDER BY top_cm, base_cm, layer_id ROWS UNBOUNDED PRECEDING) AS run FROM o),
 p AS (SELECT *, max(base_cm) OVER (PARTITION BY well, run ORDER BY top_cm, base_cm, layer_id
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM r),
 i AS (SELECT *, sum(CASE WHEN prev IS NULL OR top_cm > prev + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY well
   ORDER BY top_cm, base_cm, layer_id ROWS UNBOUNDED PRECEDING) AS isl FROM p)
SELECT well, label, min(top_cm) AS top_cm, max(base_cm) AS base_cm, count(*) AS merged_rows FROM i GROUP BY well, isl, label""")
def coalesce(t: Tables) -> DataFrame:
    return iv.coalesce_adjacent(t.layers(), ["well"], ["label"], ["layer_id"]).select(
        "well", "label", "top_cm", "base_cm", "merged_rows")


@query("W5_merge_fragments", """
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY top, det) AS rn FROM detections WHERE bottom - top >= 5 AND NOT reviewed),
 f AS (SELECT photo, rn, 1 AS band, label, top, bottom, "left", "right", conf, 1::BIGINT AS n FROM o WHERE rn = 1
  UNION ALL SELECT photo, rn, CASE WHEN j THEN band ELSE band + 1 END, label, CASE WHEN j THEN least(top, ft) ELSE top END, CASE WHEN j THEN greatest(bottom, fb) ELSE bottom END,
   CASE WHEN j THEN least("left", fl) ELSE "left" END, CASE WHEN j THEN greatest("right", fr) ELSE "right" END, CASE WHEN j THEN least(conf, fc) ELSE conf END, CASE WHEN j THEN n + 1 ELSE 1 END
  FROM (SELECT o.photo, o.rn, f.band, o.label, o.top, o.bottom, o."left", o."right", o.conf, f.n, f.top AS ft, f.bottom AS fb, f."left" AS fl, f."right" AS fr, f.conf AS fc,
    f.label = o.label AND o.top - f.bottom BETWEEN -2 AND 8 AND greatest(least(f."right", o."right") - greatest(f."left", o."left"), 0) >= 0.65 * least(f."right" - f."left", o."right" - o."left") AS j
    FROM f JOIN o ON o.photo = f.photo AND o.rn = f.rn + 1))
SELECT photo, label, top, bottom, "left", "right", conf, n AS merged_rows FROM (SELECT *, row_number() OVER (PARTITION BY photo, band ORDER BY rn DESC) AS last FROM f) WHERE last = 1
UNION ALL SELECT photo, label, top, bottom, "left", "right", conf, 1 FROM detections WHERE reviewed""")
def fragments(t: Tables) -> DataFrame:
    return iv.merge_fragments(
        t.detections(), ["photo"], ["label"], ["det"], min_height=F.lit(5), confidence="conf", reviewed=F.col("reviewed"),
    ).select("photo", "label", "top", "bottom", "left", "right", "conf", "merged_rows")


@query("J10_depth_tie_in", """
WITH g AS (SELECT layer_id, well, top_cm AS dt, base_cm + (base_cm - top_cm) // 10 AS db, top_cm - well % 7 AS gt, base_cm - well % 7 AS gb FROM layers)
SELECT p.photo, g.layer_id,
  CAST(dt + round(CAST((greatest(p.top_cm, gt) - gt) * (db - dt) AS DECIMAL(20,0)) * 1.000000::DECIMAL(7,6) / (gb - gt), 0) AS BIGINT) AS tied_top_cm,
  CAST(dt + round(CAST((least(p.base_cm, gb) - gt) * (db - dt) AS DECIMAL(20,0)) * 1.000000::DECIMAL(7,6) / (gb - gt), 0) AS BIGINT) AS tied_base_cm
FROM photos p JOIN g ON p.well = g.well AND gb > p.top_cm AND gt < p.base_cm AND gb > gt""")
def tie_in(t: Tables) -> DataFrame:
    pairs = shifted(t).select(
        "layer_id", "well", F.col("top_cm").alias("drill_top_cm"),
        (F.col("base_cm") + F.expr("(base_cm - top_cm) div 10")).alias("drill_base_cm"), "gis_top_cm", "gis_base_cm")
    spans = t.photos().select("photo", "well", "top_cm", "base_cm")
    return iv.tie_in(spans, pairs, ["well"]).select("photo", "layer_id", "tied_top_cm", "tied_base_cm")
