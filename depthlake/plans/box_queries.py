"""Queries for polygons, boxes and detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from depthlake.functions import geometry as G
from depthlake.operators import boxes as B
from depthlake.plans.proxies import Tables
from depthlake.plans.registry import query

SHOELACE = """
 sh AS (SELECT vec_id, sum(x * lead_y - lead_x * y) AS s FROM (SELECT vec_id, x, y,
   coalesce(lead(x) OVER w, first_value(x) OVER w) AS lead_x, coalesce(lead(y) OVER w, first_value(y) OVER w) AS lead_y
   FROM vertices WINDOW w AS (PARTITION BY vec_id ORDER BY i)) GROUP BY vec_id)"""


@query("A1_area_and_bounds", f"""
WITH {SHOELACE}, b AS (SELECT vec_id, min(x) AS "left", min(y) AS top, max(x) AS "right", max(y) AS bottom FROM vertices GROUP BY vec_id)
SELECT vec_id, CAST(abs(s) AS BIGINT) AS twice_area, "left", top, "right", bottom FROM sh JOIN b USING (vec_id)""")
def area(t: Tables) -> DataFrame:
    box = G.bounds(F.col("polygon"))
    return t.polygons().select("vec_id", F.abs(G.twice_area(F.col("polygon"))).alias("twice_area"), *[box[c].alias(c) for c in B.BOX])


RING = """ring AS (SELECT vec_id, i, x, y FROM vertices WHERE i <= 3 + vec_id % 4), rn AS (SELECT vec_id, count(*) AS n, count(DISTINCT (x, y)) AS d,
   max(x) - min(x) AS w, max(y) - min(y) AS h, max(greatest(x, y)) AS far FROM ring GROUP BY vec_id),
 closed AS (SELECT r.vec_id FROM ring r JOIN rn USING (vec_id) JOIN ring f ON f.vec_id = r.vec_id AND f.i = 1 WHERE r.i = rn.n AND r.x = f.x AND r.y = f.y)"""


def rings(t: Tables) -> DataFrame:
    """Rings of three to six vertices, depending on the row."""
    return t.polygons().withColumn("ring", F.slice("polygon", F.lit(1), (3 + F.col("vec_id") % 4).cast("int")))


@query("A2_polygon_validity", """
WITH g0 AS (SELECT vec_id, i, x, y FROM vertices WHERE i <= 3 + vec_id % 4),
 last AS (SELECT vec_id, max(i) AS n FROM g0 GROUP BY vec_id),
 shut AS (SELECT a.vec_id FROM g0 a JOIN last l ON a.vec_id = l.vec_id AND a.i = l.n JOIN g0 b ON b.vec_id = a.vec_id AND b.i = 1 AND a.x = b.x AND a.y = b.y WHERE l.n > 1),
 g AS (SELECT g0.* FROM g0 JOIN last USING (vec_id) WHERE NOT (i = n AND vec_id IN (SELECT vec_id FROM shut))),
 m AS (SELECT vec_id, count(*) AS n, count(DISTINCT (x, y)) AS d, max(x) - min(x) AS w, max(y) - min(y) AS h, max(greatest(x, y)) AS far FROM g GROUP BY vec_id),
 e AS (SELECT g.vec_id, g.i, m.n, g.x AS ax, g.y AS ay, k.x AS bx, k.y AS by_ FROM g JOIN m USING (vec_id) JOIN g k ON k.vec_id = g.vec_id AND k.i = g.i % m.n + 1),
 ar AS (SELECT vec_id, abs(sum(ax * by_ - bx * ay)) AS s FROM e GROUP BY vec_id),
 pr AS (SELECT a.vec_id, a.ax, a.ay, a.bx, a.by_, c.ax AS cx, c.ay AS cy, c.bx AS dx, c.by_ AS dy,
   (a.bx-a.ax)*(c.ay-a.ay)-(a.by_-a.ay)*(c.ax-a.ax) AS p, (a.bx-a.ax)*(c.by_-a.ay)-(a.by_-a.ay)*(c.bx-a.ax) AS q,
   (c.bx-c.ax)*(a.ay-c.ay)-(c.by_-c.ay)*(a.ax-c.ax) AS r, (c.bx-c.ax)*(a.by_-c.ay)-(c.by_-c.ay)*(a.bx-c.ax) AS s
   FROM e a JOIN e c ON c.vec_id = a.vec_id AND c.i >= a.i + 2 AND NOT (a.i = 1 AND c.i = a.n)),
 cr AS (SELECT DISTINCT vec_id FROM pr WHERE (p * q < 0 AND r * s < 0)
   OR (p = 0 AND cx BETWEEN least(ax,bx) AND greatest(ax,bx) AND cy BETWEEN least(ay,by_) AND greatest(ay,by_))
   OR (q = 0 AND dx BETWEEN least(ax,bx) AND greatest(ax,bx) AND dy BETWEEN least(ay,by_) AND greatest(ay,by_))
   OR (r = 0 AND ax BETWEEN least(cx,dx) AND greatest(cx,dx) AND ay BETWEEN least(cy,dy) AND greatest(cy,dy))
   OR (s = 0 AND bx BETWEEN least(cx,dx) AND greatest(cx,dx) AND by_ BETWEEN least(cy,dy) AND greatest(cy,dy)))
SELECT m.vec_id, CASE WHEN n < 3 THEN 'too few or non-finite vertices' WHEN d <> n THEN 'repeated vertices' WHEN far > 75 THEN 'outside the image'
  WHEN ar.s < 8 OR w < 4 OR h < 4 THEN 'too small' WHEN m.vec_id IN (SELECT vec_id FROM cr) THEN 'self-intersection' END AS problem FROM m JOIN ar USING (vec_id)""")
def validity(t: Tables) -> DataFrame:
    return rings(t).select("vec_id", G.geometry_problem(F.col("ring"), F.lit(75), F.lit(75)).alias("problem"))


@query("A3_annotation_validity", """
SELECT photo, det, list_filter([CASE WHEN label = 'AF' THEN 'no label' END, CASE WHEN conf % 7 = 0 THEN 'no text' END, CASE WHEN "right" > 200 OR bottom > 320 THEN 'outside the image' END,
  CASE WHEN conf % 5 = 0 THEN 'base not below top' END], lambda x: x IS NOT NULL) AS problems FROM detections""")
def annotation_validity(t: Tables) -> DataFrame:
    from depthlake.operators import governance as V

    d = t.detections()
    rows = d.select(
        "photo", "det", F.when(F.col("label") == "AF", " ").otherwise(F.col("label")).alias("label"),
        G.rectangle(*B.box()).alias("polygon"), F.lit(200).alias("image_width"), F.lit(320).alias("image_height"),
        F.when(F.col("conf") % 7 == 0, "").otherwise("text").alias("target_text"), F.lit(100).alias("top_cm"),
        F.when(F.col("conf") % 5 == 0, 100).otherwise(200).alias("base_cm"))
    return rows.select("photo", "det", V.annotation_problems().alias("problems"))


@query("A4_canonical_polygon", """
WITH f AS (SELECT vec_id, polygon FROM polygons)
SELECT vec_id, array_to_string(list_transform(least(
   list_min(list_transform(range(0, len(polygon)), lambda k: list_concat(polygon[k+1:], polygon[:k]))),
   list_min(list_transform(range(0, len(polygon)), lambda k: list_concat(list_reverse(polygon)[k+1:], list_reverse(polygon)[:k])))),
   lambda p: p.x || ',' || p.y), ';') AS ring FROM f WHERE NOT (polygon[1] = polygon[-1])""")
def canonical(t: Tables) -> DataFrame:
    open_only = t.polygons().filter(F.get("polygon", 0) != F.element_at("polygon", -1))
    # Each ring is turned, reversed and closed first; its canonical form must not change.  The closing vertex
    # is written out, as the turn may bring two equal neighbours to the ends, which are no closing vertex.
    turned = F.reverse(F.concat(F.slice("polygon", F.lit(7), F.size("polygon")), F.slice("polygon", 1, 7)))
    return open_only.select("vec_id", G.polygon_text(G.canonical_polygon(turned)).alias("ring"))


@query("A5_box_iou", """
SELECT a.photo, a.det AS det, b.det AS other, CAST(floor(i / (sa + sb - i) * 1000000 + 0.5) AS BIGINT) AS iou FROM (
 SELECT a.photo, a.det, b.det, CAST((least(a."right", b."right") - greatest(a."left", b."left")) * (least(a.bottom, b.bottom) - greatest(a.top, b.top)) AS DOUBLE) AS i,
  (a."right" - a."left") * (a.bottom - a.top) AS sa, (b."right" - b."left") * (b.bottom - b.top) AS sb, a, b
 FROM detections a JOIN detections b ON a.photo = b.photo AND a.det < b.det AND a."left" < b."right" AND b."left" < a."right" AND a.top < b.bottom AND b.top < a.bottom)""")
def iou(t: Tables) -> DataFrame:
    d = t.detections().select("photo", "det", *B.BOX)
    pairs = B.overlapping_boxes(d, d).filter("det < o_det")
    return pairs.select("photo", "det", F.col("o_det").alias("other"), F.floor(G.iou(B.box(), B.box("o_")) * 1000000 + 0.5).cast("bigint").alias("iou"))


@query("A6_clip_to_box", """
SELECT photo, det, CAST(2 * greatest(0, least("right", 150) - greatest("left", 60)) * greatest(0, least(bottom, 200) - greatest(top, 50)) AS BIGINT) AS twice_area
FROM detections WHERE least("right", 150) > greatest("left", 60) AND least(bottom, 200) > greatest(top, 50)""")
def clip(t: Tables) -> DataFrame:
    cut = G.clipped(G.rectangle(*B.box()), F.lit(60), F.lit(50), F.lit(150), F.lit(200))
    twice = t.detections().select("photo", "det", F.abs(cut["twice_area"]).cast("bigint").alias("twice_area"))
    # An array keeps the condition above the function, which would run once more for a filter below it.
    return twice.select("photo", "det", F.explode(F.when(F.col("twice_area") > 0, F.array("twice_area"))).alias("twice_area"))


LANES = "lanes(col, l, r) AS (VALUES (0, 0, 90), (1, 90, 180), (2, 180, 400))"


def lanes(t: Tables) -> DataFrame:
    """Three columns per photo."""
    cols = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(c) for c, v in zip(("col", *B.BOX), x)]) for x in ((0, 0, 0, 90, 400), (1, 90, 0, 180, 400), (2, 180, 0, 400, 400))])
    return t.detections().select("photo").distinct().select("photo", F.inline(cols))


@query("A7_polygon_depths", f"""
WITH {LANES}, x AS (SELECT photo, det, top, bottom, col, (least("right", r) - greatest("left", l)) * (bottom - top) AS a FROM detections JOIN lanes ON "left" < r AND "right" > l),
 b AS (SELECT photo, det, top, bottom, col, row_number() OVER (PARTITION BY photo, det ORDER BY a DESC, col) AS rn FROM x)
SELECT photo, det, CAST(col AS BIGINT) AS col, CAST(1000 + 100 * col + round_even(top * 100 / 400.0::DOUBLE, 0) AS BIGINT) AS top_cm,
  CASE WHEN round_even(bottom * 100 / 400.0::DOUBLE, 0) <= round_even(top * 100 / 400.0::DOUBLE, 0) THEN least(CAST(1100 + 100 * col AS BIGINT), CAST(1001 + 100 * col + round_even(top * 100 / 400.0::DOUBLE, 0) AS BIGINT))
   ELSE CAST(1000 + 100 * col + round_even(bottom * 100 / 400.0::DOUBLE, 0) AS BIGINT) END AS base_cm FROM b WHERE rn = 1""")
def polygon_depths(t: Tables) -> DataFrame:
    from depthlake.operators import calibrate as K

    cols = lanes(t).withColumns({"top_cm": 1000 + 100 * F.col("col"), "base_cm": 1100 + 100 * F.col("col")})
    polys = t.detections().select("photo", "det", *B.BOX, G.rectangle(*B.box()).alias("polygon"))
    return K.polygon_depths(polys, cols, "det").select("photo", "det", "col", "top_cm", "base_cm")


@query("A8_box_column", f"""
WITH {LANES}, x AS (SELECT photo, det, col, (least("right", r) - greatest("left", l)) * (bottom - top) AS a, ("right" - "left") * (bottom - top) AS s, ("left" + "right") / 2.0 AS c, l, r
   FROM detections JOIN lanes ON "left" < r AND "right" > l)
SELECT photo, det, CAST(arg_max(col, struct_pack(a := a, c := -col)) AS BIGINT) AS col FROM x WHERE a >= 0.55 * s OR (c >= l AND c <= r) GROUP BY ALL""")
def box_column(t: Tables) -> DataFrame:
    return B.best_column(t.detections().select("photo", "det", *B.BOX), lanes(t), "det", "col")


@query("A9_normalised_polygon", """
SELECT photo, det, printf('%.6f', greatest(0, least(1, "left" / 250.0))) || ' ' || printf('%.6f', greatest(0, least(1, top / 320.0))) || ' ' || printf('%.6f', greatest(0, least(1, "right" / 250.0))) AS head FROM detections""")
def normalised(t: Tables) -> DataFrame:
    unit = G.normalise_polygon(G.rectangle(*B.box()), F.lit(0), F.lit(0), F.lit(250), F.lit(320))
    six = lambda i, c: F.format_string("%.6f", F.get(unit, i)[c])
    return t.detections().select("photo", "det", F.concat_ws(" ", six(0, "x"), six(0, "y"), six(1, "x")).alias("head"))


@query("A10_thin_polygon", """
SELECT vec_id, array_to_string(list_transform(list_filter(range(0, len(polygon)), lambda k: k % 3 = 0)[:10], lambda k: polygon[k+1].x || ',' || polygon[k+1].y), ';') AS ring FROM polygons""")
def thin(t: Tables) -> DataFrame:
    return t.polygons().select("vec_id", G.polygon_text(G.thin_polygon(F.col("polygon"), 10)).alias("ring"))


@query("A11_minimum_span", """
SELECT photo, det, CASE WHEN h >= 20 THEN CAST(top AS DOUBLE) ELSE greatest(0.0, least(340.0, greatest(0.0, (top + bottom) / 2.0 - 10) + 20) - 20) END AS y0,
  CASE WHEN h >= 20 THEN CAST(bottom AS DOUBLE) ELSE least(340.0, greatest(0.0, (top + bottom) / 2.0 - 10) + 20) END AS y1 FROM (SELECT *, bottom - top AS h FROM detections)""")
def min_span(t: Tables) -> DataFrame:
    s = G.minimum_span(F.col("top"), F.col("bottom"), F.lit(0), F.lit(340), 20.0)
    return t.detections().select("photo", "det", s["y0"].alias("y0"), s["y1"].alias("y1"))


@query("A12_run_length_masks", """
SELECT photo, det, ("right" - "left") * (bottom - top) AS area, "left", top, "right", bottom FROM detections""")
def rle(t: Tables) -> DataFrame:
    """Rectangles written as column-major run lengths, decoded back."""
    h, w = F.lit(400).cast("bigint"), F.lit(400).cast("bigint")
    size = F.col("bottom") - F.col("top")
    first = F.col("left") * h + F.col("top")
    middle = F.flatten(F.array_repeat(F.array(h - size, size), (F.col("right") - F.col("left") - 1).cast("int")))
    rest = h * w - first - (F.col("right") - F.col("left") - 1) * h - size
    runs = F.concat(F.array(first, size), middle, F.array(rest)).cast("array<bigint>")
    s = G.rle_stats(runs, h, w)
    return t.detections().select("photo", "det", s["area"].alias("area"), *[s[c].alias(c) for c in B.BOX])


@query("A13_mask_size", """
SELECT photo, det, CASE WHEN "right" - "left" < 5 OR bottom - top < 5 OR ("right" - "left") * (bottom - top) / 10000.0 < 0.00025 THEN 'small'
  WHEN ("right" - "left") * (bottom - top) / 2400.0 > 0.9 AND false THEN 'large' WHEN ("right" - "left") * (bottom - top) > 0.9 * 2400 THEN 'large' END AS kind FROM detections""")
def mask_size(t: Tables) -> DataFrame:
    return t.detections().select("photo", "det", G.mask_size(G.rectangle(*B.box()), F.lit(60), F.lit(40)).alias("kind"))


@query("A15_region_at_point", """
WITH p AS (SELECT photo, min(("left" + "right") / 2.0) AS x, min((top + bottom) / 2.0) AS y FROM detections GROUP BY photo)
SELECT p.photo, arg_min(d.det, struct_pack(a := ("right" - "left") * (bottom - top), d := d.det)) AS det FROM p JOIN detections d ON d.photo = p.photo
 AND x >= "left" AND x < "right" AND y >= top AND y < bottom GROUP BY p.photo""")
def region_at_point(t: Tables) -> DataFrame:
    from depthlake.operators import calibrate as K

    d = t.detections()
    points = d.groupBy("photo").agg(F.min((F.col("left") + F.col("right")) / 2).alias("x"), F.min((F.col("top") + F.col("bottom")) / 2).alias("y"))
    regions = d.select("photo", "det", *B.BOX, G.rectangle(*B.box()).alias("polygon"))
    return K.region_at_point(points, regions, "det").select("photo", "det")


@query("S1_label_counts", """
SELECT photo, count(*) FILTER (WHERE reviewed AND label <> 'RF') AS verified, count(*) FILTER (WHERE NOT reviewed AND label <> 'RF') AS automatic,
  count(*) FILTER (WHERE reviewed AND label = 'RF') AS unlabeled FROM detections GROUP BY photo""")
def label_counts(t: Tables) -> DataFrame:
    from depthlake.operators import governance as V

    named = t.detections().withColumn("label", F.when(F.col("label") == "RF", "Новый контур").otherwise(F.col("label")))
    return V.sample_counts(named.withColumn("polygon", G.rectangle(*B.box())), ["photo"])


@query("S2_photos_with_intervals", "SELECT photo, top_cm, base_cm FROM photos WHERE confirmed AND top_cm < base_cm")
def with_intervals(t: Tables) -> DataFrame:
    return t.photos().filter("confirmed AND top_cm < base_cm").select("photo", "top_cm", "base_cm")


@query("S3_background_classes", "SELECT photo, det FROM detections WHERE lower(label) NOT IN ('af')")
def background(t: Tables) -> DataFrame:
    from depthlake.operators import governance as V

    d = t.detections().withColumn("label", F.when(F.col("label") == "AF", "ШЛАК").otherwise(F.col("label")))
    return d.filter(~V.is_background(F.col("label"))).select("photo", "det")


@query("S4_confidence_threshold", "SELECT photo, det, conf FROM detections WHERE conf / 100.0 >= 0.95")
def threshold(t: Tables) -> DataFrame:
    from depthlake.operators import governance as V

    return t.detections().filter(V.confident(F.col("conf") / 100, 0.95)).select("photo", "det", "conf")


@query("S13_column_box_filter", """
WITH b AS (SELECT photo, det, least(greatest("left", 10), 190) AS "left", least(greatest("right", 10), 190) AS "right", least(top, 320) AS top, least(bottom, 320) AS bottom FROM
   (SELECT photo, det, least("left", 190) AS "left", least("right", 190) AS "right", top, bottom FROM detections)),
 c AS (SELECT photo, det, greatest(0, least(l, 190)) AS "left", greatest(0, least(r, 190)) AS "right", top, bottom FROM (SELECT photo, det, "left" AS l, "right" AS r, top, bottom FROM detections)),
 k AS (SELECT *, "right" - "left" AS w FROM c WHERE "right" - "left" >= 3 AND bottom - top >= 3),
 m AS (SELECT photo, median(w) AS m, count(*) AS n FROM k GROUP BY photo),
 z AS (SELECT k.*, m.n, w >= 0.55 * m AND w <= 1.8 * m AS ok, count(*) FILTER (WHERE w >= 0.55 * m AND w <= 1.8 * m) OVER (PARTITION BY photo) AS kept FROM k JOIN m USING (photo))
SELECT photo, det, "left", "right" FROM z WHERE n < 3 OR kept < 2 OR ok""")
def column_filter(t: Tables) -> DataFrame:
    inside = B.columns_in_image(t.detections().select("photo", "det", *B.BOX), width=F.lit(190), height=F.lit(400))
    return B.drop_width_outliers(inside).select("photo", "det", "left", "right")


SUPPRESSED = """
WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY conf DESC, det) AS k, "right" - "left" AS w, bottom - top AS h FROM detections),
 f AS (SELECT photo, k, list_value(k) AS kept FROM d WHERE k = 1
  UNION ALL SELECT d.photo, d.k, CASE WHEN EXISTS (SELECT 1 FROM d e WHERE e.photo = d.photo AND list_contains(f.kept, e.k)
     AND greatest(0, least(d."right", e."right") - greatest(d."left", e."left")) * greatest(0, least(d.bottom, e.bottom) - greatest(d.top, e.top)) >= 0.12 * least(d.w * d.h, e.w * e.h))
     THEN f.kept ELSE list_append(f.kept, d.k) END FROM f JOIN d ON d.photo = f.photo AND d.k = f.k + 1),
 z AS (SELECT photo, arg_max(kept, k) AS kept FROM f GROUP BY photo)"""


@query("P14_suppressed_overlaps", f"{SUPPRESSED} SELECT d.photo, d.det FROM d JOIN z ON z.photo = d.photo AND list_contains(z.kept, d.k)")
def suppressed(t: Tables) -> DataFrame:
    kept, _ = B.suppress_overlaps(t.detections(), "det")
    return kept.select("photo", "det")


@query("P14_silenced_alternatives", f"""{SUPPRESSED},
 b AS (SELECT d.photo, d.det, any_value(d.label) AS label, any_value(d.conf) AS conf, min(e.k) AS k FROM d JOIN z ON z.photo = d.photo JOIN d e ON e.photo = d.photo AND e.k < d.k AND list_contains(z.kept, e.k)
   WHERE greatest(0, least(d."right", e."right") - greatest(d."left", e."left")) * greatest(0, least(d.bottom, e.bottom) - greatest(d.top, e.top)) >= 0.12 * least(d.w * d.h, e.w * e.h) GROUP BY d.photo, d.det)
SELECT b.photo, e.det, b.label AS alternative, max(b.conf) AS alternative_conf FROM b JOIN d e ON e.photo = b.photo AND e.k = b.k WHERE e.label <> b.label GROUP BY b.photo, e.det, b.label""")
def alternatives(t: Tables) -> DataFrame:
    return B.suppress_overlaps(t.detections(), "det")[1]


LANES_BY = """
WITH RECURSIVE d AS (SELECT photo, row_number() OVER (PARTITION BY photo ORDER BY {order}, top, det) AS k,
  struct_pack(l := "left"::BIGINT, t := top::BIGINT, r := "right"::BIGINT, b := bottom::BIGINT) AS x FROM detections),
 f AS (SELECT photo, k, [x] AS lanes FROM d WHERE k = 1
  UNION ALL SELECT photo, k, CASE WHEN coalesce(p, 0) = 0 THEN list_append(lanes, x)
    ELSE list_transform(lanes, lambda y, i: CASE WHEN i = p THEN struct_pack(l := least(y.l, x.l), t := least(y.t, x.t), r := greatest(y.r, x.r), b := greatest(y.b, x.b)) ELSE y END) END
  FROM (SELECT d.photo, d.k, d.x, f.lanes, list_position(list_transform(f.lanes, lambda y: least(d.x.r - d.x.l, y.r - y.l) > 0
      AND least(d.x.r, y.r) - greatest(d.x.l, y.l) >= least(d.x.r - d.x.l, y.r - y.l) * 0.55::DOUBLE
      AND abs((d.x.l + d.x.r) / 2.0::DOUBLE - (y.l + y.r) / 2.0::DOUBLE) <= greatest(5.0::DOUBLE, least(d.x.r - d.x.l, y.r - y.l) * 0.48::DOUBLE)), true) AS p
    FROM f JOIN d ON d.photo = f.photo AND d.k = f.k + 1)),
 z AS (SELECT photo, arg_max(lanes, k) AS lanes FROM f GROUP BY photo)
SELECT photo, u.l AS "left", u.t AS top, u.r AS "right", u.b AS bottom FROM (SELECT photo, unnest(lanes) AS u FROM z)"""


@query("P13_merged_lanes", LANES_BY.replace("{order}", '"left"'))
def merged_lanes(t: Tables) -> DataFrame:
    return B.merge_lanes(t.detections().select("photo", "det", *B.BOX), "det")


@query("P13_lanes_by_centre", LANES_BY.replace("{order}", '"left" + "right"'))
def lanes_by_centre(t: Tables) -> DataFrame:
    return B.merge_lanes(t.detections().select("photo", "det", *B.BOX), "det", by="centre")


@query("P13_outside_lanes", """
SELECT photo, det FROM detections d WHERE reviewed AND NOT EXISTS (SELECT 1 FROM detections l WHERE l.photo = d.photo AND NOT l.reviewed
  AND least(d."right", l."right") - greatest(d."left", l."left") >= least(d."right" - d."left", l."right" - l."left") * 0.58::DOUBLE)""")
def outside_lanes(t: Tables) -> DataFrame:
    d = t.detections()
    return B.outside_lanes(d.filter("reviewed"), d.filter("not reviewed")).select("photo", "det")


@query("P13_same_boxes", """
WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY "left", top, top - bottom, det) AS k, ("right" - "left") * (bottom - top) AS area FROM detections),
 f AS (SELECT photo, k, list_value(k) AS kept FROM d WHERE k = 1
  UNION ALL SELECT d.photo, d.k, CASE WHEN EXISTS (SELECT 1 FROM (SELECT e.area, greatest(0, least(d."right", e."right") - greatest(d."left", e."left")) * greatest(0, least(d.bottom, e.bottom) - greatest(d.top, e.top)) AS i
     FROM d e WHERE e.photo = d.photo AND list_contains(f.kept, e.k)) WHERE i > 0 AND CAST(i AS DOUBLE) / CAST(area + d.area - i AS DOUBLE) >= 0.68::DOUBLE)
    THEN f.kept ELSE list_append(f.kept, d.k) END FROM f JOIN d ON d.photo = f.photo AND d.k = f.k + 1),
 z AS (SELECT photo, arg_max(kept, k) AS kept FROM f GROUP BY photo)
SELECT d.photo, d.det FROM d JOIN z ON z.photo = d.photo AND list_contains(z.kept, d.k)""")
def same_boxes(t: Tables) -> DataFrame:
    return B.drop_same_boxes(t.detections().select("photo", "det", *B.BOX), "det").select("photo", "det")


@query("W4_column_coverage", """
WITH d AS (SELECT *, CASE WHEN reviewed THEN conf % 3 END AS structure, row_number() OVER (PARTITION BY photo ORDER BY det) AS place FROM detections),
 c AS (SELECT photo, k AS col, 80.0 * k AS l, 80.0 * k + 80 AS r, 40.0 AS t, 330.0 AS b FROM (SELECT DISTINCT photo FROM detections), (VALUES (0), (1), (2)) v(k)),
 a AS (SELECT *, greatest(t, top)::DOUBLE AS y0, least(b, bottom)::DOUBLE AS y1, (least("right", r) - greatest("left", l))::DOUBLE / greatest(1.0, least("right" - "left", r - l))::DOUBLE AS share
   FROM (SELECT c.*, d.* EXCLUDE (photo) FROM c JOIN d ON d.photo = c.photo)
   WHERE least("right", r) > greatest("left", l) AND least(b, bottom) - greatest(t, top) > 0.25),
 g AS (SELECT *, conf::DOUBLE / 100 AS q FROM a WHERE share >= 0.15),
 m AS (SELECT photo, col, unnest([y0, y1]) AS y FROM g UNION SELECT photo, col, unnest([t, b])::DOUBLE FROM c),
 e AS (SELECT photo, col, y AS s, lead(y) OVER (PARTITION BY photo, col ORDER BY y) AS z FROM m),
 h AS (SELECT e.photo, e.col, e.s, e.z, g.label, g.structure, g.q, row_number() OVER (PARTITION BY e.photo, e.col, e.s
     ORDER BY g.structure IS NOT NULL DESC, g.q * g.share DESC, g.share DESC, g.q DESC, g.place) AS best
   FROM e LEFT JOIN g ON g.photo = e.photo AND g.col = e.col AND g.y0 <= e.s AND g.y1 >= e.z WHERE e.z IS NOT NULL),
 w AS (SELECT photo, col, s, z, coalesce(label, 'Не определена') AS label, structure, coalesce(q, 0) AS q, label IS NULL AS gap_filled FROM h WHERE best = 1),
 f AS (SELECT *, CASE WHEN lag(label) OVER k = label AND lag(structure) OVER k IS NOT DISTINCT FROM structure AND lag(gap_filled) OVER k = gap_filled THEN 0 ELSE 1 END AS new
   FROM w WINDOW k AS (PARTITION BY photo, col ORDER BY s)),
 n AS (SELECT *, sum(new) OVER (PARTITION BY photo, col ORDER BY s ROWS UNBOUNDED PRECEDING) AS band FROM f)
SELECT photo, col::INT AS col, label, structure, gap_filled, min(s) AS top, max(z) AS bottom, min(q) AS conf,
  CASE WHEN col < 2 THEN round_even((photo % 1000)::DOUBLE + (min(s) - 40.0::DOUBLE) / 290.0::DOUBLE * 3.0::DOUBLE, 4) END AS depth_from,
  CASE WHEN col < 2 THEN round_even((photo % 1000)::DOUBLE + (max(z) - 40.0::DOUBLE) / 290.0::DOUBLE * 3.0::DOUBLE, 4) END AS depth_to
FROM n GROUP BY photo, col, band, label, structure, gap_filled""")
def column_coverage(t: Tables) -> DataFrame:
    d = t.detections().withColumns({"conf": F.col("conf") / 100, "structure": F.when(F.col("reviewed"), F.col("conf") % 3)})
    columns = d.select("photo").distinct().select("photo", F.explode(F.array(*map(F.lit, range(3)))).alias("col")).withColumns(
        {"left": F.col("col") * 80.0, "right": F.col("col") * 80.0 + 80, "top": F.lit(40.0), "bottom": F.lit(330.0)})
    depths = columns.filter("col < 2").select("photo", F.col("col").alias("order"), *B.BOX, (F.col("photo") % 1000).alias("depth_from"), (F.col("photo") % 1000 + 3).alias("depth_to"))
    bands = B.complete_columns(columns, d, column="col", depths=depths, gap_label="Не определена")
    return bands.select("photo", "col", "label", "structure", "gap_filled", "top", "bottom", "conf", "depth_from", "depth_to")


@query("N27_interval_class", """
WITH s AS (SELECT photo, label, conf / 100.0::DOUBLE AS c, conf / 100.0::DOUBLE * (0.55 + 0.45 * sqrt(least(1.0, CAST(("right" - "left") * (bottom - top) AS DOUBLE) / 4000.0))) AS s FROM detections),
 p AS (SELECT photo, label, max(struct_pack(s := s, c := c)) AS b, max(c) AS m FROM s GROUP BY ALL), w AS (SELECT photo, max(struct_pack(b := b, l := label)) AS w FROM p GROUP BY photo)
SELECT photo, w.l AS label, w.b.c AS confidence, (SELECT string_agg(label || '=' || CAST(round(m * 100) AS BIGINT), ',' ORDER BY label) FROM p WHERE p.photo = w.photo AND p.label <> w.w.l) AS others FROM w""")
def interval_class(t: Tables) -> DataFrame:
    d = t.detections().withColumn("confidence", F.col("conf") / 100)
    got = B.interval_class(d, ["photo"], F.lit(4000))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("alternatives"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 100).cast("bigint")))), ",")
    return got.select("photo", "label", "confidence", F.when(shown != "", shown).alias("others"))


@query("J18_inherited_class", """
WITH p AS (SELECT a.photo, a.det, b.conf, b.label, CAST((least(a."right", b."right") - greatest(a."left", b."left")) * (least(a.bottom, b.bottom) - greatest(a.top, b.top)) AS DOUBLE)
    / CAST((a."right" - a."left") * (a.bottom - a.top) AS DOUBLE) AS f
  FROM detections a JOIN detections b ON a.photo = b.photo AND NOT a.reviewed AND b.reviewed AND a."left" < b."right" AND b."left" < a."right" AND a.top < b.bottom AND b.top < a.bottom),
 m AS (SELECT photo, det, max(struct_pack(s := f * greatest(0.05, conf / 100.0::DOUBLE), c := conf / 100.0::DOUBLE, l := label)) AS b FROM p GROUP BY ALL)
SELECT photo, det, b.l AS label, CAST(round(b.c * 0.8 * 1000) AS BIGINT) AS confidence FROM m""")
def inherited(t: Tables) -> DataFrame:
    d = t.detections().withColumn("confidence", F.col("conf") / 100).select("photo", "det", *B.BOX, "label", "confidence", "reviewed")
    got = B.inherit_class(d.filter("NOT reviewed"), d.filter("reviewed"), "det")
    return got.select("photo", "det", "label", F.round(F.col("confidence") * 1000).cast("bigint").alias("confidence"))


@query("J26_depth_segment", f"""
WITH {LANES}, x AS (SELECT photo, det, col, ("left" + "right") / 2.0 >= l AND ("left" + "right") / 2.0 <= r AS inside, (least("right", r) - greatest("left", l)) * (bottom - top) AS a FROM detections JOIN lanes ON "left" < r AND "right" > l)
SELECT photo, det, CAST(arg_max(col, struct_pack(i := inside, a := a, c := -col)) AS BIGINT) AS col FROM x GROUP BY ALL""")
def depth_segment(t: Tables) -> DataFrame:
    return B.segment_for(t.detections().select("photo", "det", *B.BOX), lanes(t), "det", "col")


@query("N17_near_duplicates", """
SELECT photo, label, count(DISTINCT det) AS duplicates FROM (SELECT a.photo, a.label, a.det FROM detections a JOIN detections b ON a.photo = b.photo AND a.label = b.label AND b.det < a.det
  AND a."left" < b."right" AND b."left" < a."right" AND a.top < b.bottom AND b.top < a.bottom
 WHERE (least(a."right", b."right") - greatest(a."left", b."left")) * (least(a.bottom, b.bottom) - greatest(a.top, b.top)) >= 0.3 *
  ((a."right" - a."left") * (a.bottom - a.top) + (b."right" - b."left") * (b.bottom - b.top) - (least(a."right", b."right") - greatest(a."left", b."left")) * (least(a.bottom, b.bottom) - greatest(a.top, b.top)))) GROUP BY ALL""")
def near_duplicates(t: Tables) -> DataFrame:
    d = t.detections().select("photo", "det", *B.BOX, "label")
    return B.near_duplicates(d, "det", least=0.3).groupBy("photo", "label").agg(F.countDistinct("det").alias("duplicates"))


@query("N26_confidence_list", """
WITH e AS (SELECT layer_id, label AS candidate, conf / 100.0::DOUBLE AS score FROM layers UNION ALL SELECT layer_id, 'XX', 0.93::DOUBLE FROM layers UNION ALL SELECT layer_id, 'RO', 0.95::DOUBLE FROM layers),
 m AS (SELECT layer_id, candidate, max(score) AS score FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY layer_id ORDER BY score DESC, lower(candidate), candidate) - 1 AS place FROM m)
SELECT layer_id, CAST(place AS INTEGER) AS place, candidate, score FROM r WHERE place < 2""")
def confidences(t: Tables) -> DataFrame:
    d = t.layers().select("layer_id", "label", (F.col("conf") / 100).alias("confidence"), F.create_map(
        F.lit("XX"), F.lit(0.93), F.lit("RO"), F.lit(0.95)).alias("alternatives"))
    return B.confidence_list(d, ["layer_id"], limit=2)


@query("N31_label_samples", """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY photo, NOT reviewed, conf DESC, det) AS rn FROM detections WHERE "right" - "left" >= 4 AND bottom - top >= 4)
SELECT label, photo, det FROM o WHERE rn = 1""")
def label_samples(t: Tables) -> DataFrame:
    return B.label_samples(t.detections(), ["photo", "det"]).select("label", "photo", "det")


@query("O3_review_queue", """
WITH p AS (SELECT photo, det, (1.0::DOUBLE - conf / 100.0::DOUBLE) + greatest(0.0::DOUBLE, 0.9::DOUBLE - conf / 100.0::DOUBLE + 0.15::DOUBLE) + CASE WHEN bottom - top < 5 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS priority, conf FROM detections WHERE NOT reviewed)
SELECT photo, det FROM p ORDER BY priority DESC, lower(CAST(photo AS VARCHAR)), conf, det LIMIT 100""")
def queue(t: Tables) -> DataFrame:
    d = t.detections().filter("NOT reviewed").withColumn("confidence", F.col("conf") / 100)
    return B.review_queue(d, rival=F.lit(0.9), odd=F.col("bottom") - F.col("top") < 5, well="photo", tie=["det"]).select("photo", "det")


@query("W13_stack_order", """
SELECT photo, det, row_number() OVER (PARTITION BY photo ORDER BY CASE WHEN conf % 3 = 0 THEN conf END NULLS LAST, det) AS place FROM detections""")
def stack_order(t: Tables) -> DataFrame:
    from depthlake.operators import reports as R

    d = t.detections().withColumn("stack_order", F.when(F.col("conf") % 3 == 0, F.col("conf")))
    return R.stacked(d, ["photo"], "stack_order", "det").select("photo", "det", "place")


@query("W14_reading_order", """
WITH RECURSIVE s AS (SELECT photo, det, "left", top, ("left" + "right") / 2.0::DOUBLE AS cx, ("right" - "left")::DOUBLE AS w FROM detections),
 h AS (SELECT photo, greatest(12.0::DOUBLE, list_sort(list(greatest(1.0::DOUBLE, w)))[1 + count(*) // 2] * 0.65::DOUBLE) AS reach FROM s GROUP BY photo),
 d AS (SELECT s.*, reach, row_number() OVER (PARTITION BY s.photo ORDER BY cx, top, det, "left", w) AS k FROM s JOIN h ON h.photo = s.photo),
 f AS (SELECT photo, k, 1::BIGINT AS a, [struct_pack(s := cx, n := 1::BIGINT)] AS cols FROM d WHERE k = 1
  UNION ALL SELECT photo, k, CASE WHEN m.g > reach THEN len(cols) + 1 ELSE m.i END, CASE WHEN m.g > reach THEN list_append(cols, struct_pack(s := cx, n := 1::BIGINT))
    ELSE list_transform(cols, lambda c, i: CASE WHEN i = m.i THEN struct_pack(s := c.s + cx, n := c.n + 1) ELSE c END) END
  FROM (SELECT d.photo, d.k, d.cx, d.reach, f.cols, list_min(list_transform(f.cols, lambda c, i: struct_pack(g := abs(d.cx - c.s / c.n), i := i))) AS m FROM f JOIN d ON d.photo = f.photo AND d.k = f.k + 1)),
 z AS (SELECT photo, arg_max(cols, k) AS cols FROM f GROUP BY photo)
SELECT d.photo, d.det, row_number() OVER (PARTITION BY d.photo ORDER BY z.cols[f.a].s / z.cols[f.a].n, f.a, d.top, d."left", d.det) - 1 AS place
FROM d JOIN f ON f.photo = d.photo AND f.k = d.k JOIN z ON z.photo = d.photo""")
def reading(t: Tables) -> DataFrame:
    return B.reading_order(t.detections().select("photo", "det", *B.BOX), "det").select("photo", "det", "place")


@query("W15_token_rows", """
WITH RECURSIVE d AS (SELECT photo, det, top::DOUBLE AS y, row_number() OVER (PARTITION BY photo ORDER BY top, det) AS k FROM detections),
 f AS (SELECT photo, k, det, 0::BIGINT AS r, [y] AS held FROM d WHERE k = 1
  UNION ALL SELECT d.photo, d.k, d.det, CASE WHEN d.y - list_aggregate(f.held, 'median') > 12.0 THEN f.r + 1 ELSE f.r END, CASE WHEN d.y - list_aggregate(f.held, 'median') > 12.0 THEN [d.y] ELSE list_append(f.held, d.y) END
  FROM f JOIN d ON d.photo = f.photo AND d.k = f.k + 1)
SELECT photo, det AS token, r AS text_row FROM f""")
def tokens(t: Tables) -> DataFrame:
    d = t.detections().select("photo", F.col("det").alias("token"), F.col("top").cast("double").alias("y"))
    return B.token_rows(d, 12.0).select("photo", "token", "text_row")


@query("W25_column_traversal", """
WITH c AS (SELECT photo, det AS col, "left", top, "right", bottom, row_number() OVER (PARTITION BY photo ORDER BY "left", top, det) - 1 AS i, count(*) OVER (PARTITION BY photo) AS n FROM detections),
 m AS (SELECT photo, CASE WHEN photo % 3 = 0 THEN 'top' ELSE 'bottom' END AS kind, photo % 250 AS x, photo % 300 AS y FROM (SELECT DISTINCT photo FROM detections) WHERE photo % 4 < 3),
 j AS (SELECT c.*, kind, x, y, arg_min(i, struct_pack(g := abs(("left" + "right") / 2.0 - x), i := i)) OVER (PARTITION BY c.photo) AS near FROM c LEFT JOIN m ON m.photo = c.photo),
 v AS (SELECT *, CASE WHEN CASE WHEN kind IS NULL THEN true WHEN kind = 'top' THEN near <= (n - 1) / 2.0 ELSE near < n / 2.0 AND near <> 0 END THEN i ELSE n - 1 - i END AS visit FROM j),
 f AS (SELECT photo, (top + bottom) / 2.0 AS mid FROM v WHERE visit = 0)
SELECT v.photo, v.col, visit, CASE WHEN kind IS NULL THEN 'down' WHEN kind = 'top' THEN CASE WHEN y <= mid THEN 'down' ELSE 'up' END ELSE CASE WHEN y >= mid THEN 'up' ELSE 'down' END END AS direction FROM v JOIN f ON f.photo = v.photo""")
def traversal(t: Tables) -> DataFrame:
    cols = t.detections().select("photo", F.col("det").alias("col"), *B.BOX)
    marks = cols.select("photo").distinct().filter("photo % 4 < 3").select(
        "photo", F.when(F.col("photo") % 3 == 0, "top").otherwise("bottom").alias("kind"), (F.col("photo") % 250).alias("x"), (F.col("photo") % 300).alias("y"), F.lit(0.9).alias("confidence"))
    return B.column_traversal(cols, marks).select("photo", "col", F.col("visit").cast("bigint").alias("visit"), "direction")
