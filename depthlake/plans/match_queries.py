"""Queries for matching, calibration and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from depthlake.functions import text as T
from depthlake.operators import boxes as B, calibrate as K, joins as J, intervals as iv
from depthlake.operators.scan import numbered
from depthlake.session import settled, unsettle
from depthlake.plans.proxies import Tables
from depthlake.plans.registry import query

PAIRED = """
 lay AS MATERIALIZED (SELECT layer_id, well, top_cm AS t, base_cm AS b, top_cm - well % 7 AS gt, base_cm - well % 7 AS gb, conf % 5 = 0 AS primary_gis, conf % 3 <> 0 AS valid FROM layers),
 un AS MATERIALIZED (SELECT layer_id, well, CASE WHEN primary_gis THEN 'gis' ELSE 'drilling' END AS basis, t, b FROM lay WHERE valid AND b > t
   UNION ALL SELECT layer_id, well, 'gis', gt, gb FROM lay WHERE NOT primary_gis AND gb > gt),
 ph AS MATERIALIZED (SELECT *, CASE WHEN photo % 4 = 0 THEN 'gis' WHEN photo % 4 = 1 THEN 'drilling' ELSE 'unknown' END AS want FROM photos WHERE confirmed),
 pr AS MATERIALIZED (SELECT p.photo, p.well, u.layer_id, u.basis, greatest(p.top_cm, u.t) AS ot, least(p.base_cm, u.b) AS ob FROM ph p JOIN un u ON p.well = u.well AND u.b > p.top_cm AND u.t < p.base_cm
   WHERE p.want = 'unknown' OR p.want = u.basis),
 seen AS MATERIALIZED (SELECT *, max(ob) OVER (PARTITION BY photo, basis ORDER BY ot, ob, layer_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM pr),
 sc AS MATERIALIZED (SELECT photo, basis, sum(ob - ot) AS raw, sum(greatest(0, ob - greatest(ot, coalesce(prev, ot)))) AS uni FROM seen GROUP BY ALL),
 best AS MATERIALIZED (SELECT photo, arg_max(basis, struct_pack(s := uni - (raw - uni), c := uni - raw, d := basis = 'drilling')) AS basis FROM sc GROUP BY photo),
 matched AS MATERIALIZED (SELECT pr.* FROM pr JOIN best USING (photo, basis))"""


def two_systems(t: Tables) -> DataFrame:
    shift = F.col("well") % 7
    return t.layers().select(
        "layer_id", "well", "label", "top_cm", "base_cm", (F.col("top_cm") - shift).alias("gis_top_cm"), (F.col("base_cm") - shift).alias("gis_base_cm"),
        F.lit(None).cast("bigint").alias("thickness_cm"), (F.col("conf") % 3 != 0).alias("thickness_valid"), (F.col("conf") % 5 == 0).alias("primary_gis"))


def asked_photos(t: Tables) -> DataFrame:
    kind = F.col("photo") % 4
    return t.photos().filter("confirmed").withColumn("depth_basis", F.when(kind == 0, "gis").when(kind == 1, "drilling").otherwise("unknown"))


def matches(t: Tables) -> DataFrame:
    return J.match_photos(asked_photos(t), two_systems(t))


@query("J2_basis_choice", f"WITH {PAIRED} SELECT photo, layer_id, basis, ot AS overlap_top_cm, ob AS overlap_base_cm FROM matched")
def basis_choice(t: Tables) -> DataFrame:
    return matches(t).select("photo", "layer_id", "basis", "overlap_top_cm", "overlap_base_cm")


@query("J5_only_well", "SELECT photo, CASE WHEN photo % 3 = 0 THEN (SELECT CASE WHEN min(well) = max(well) THEN min(well) END FROM layers) ELSE well END AS well FROM photos")
def only_well(t: Tables) -> DataFrame:
    blank = t.photos().withColumn("well", F.when(F.col("photo") % 3 != 0, F.col("well")))
    return J.inherit_only_well(blank, t.layers()).select("photo", "well")


@query("J6_longest_key", """
WITH k AS (SELECT DISTINCT p_name AS key FROM part), x AS (SELECT p_partkey, lower(p_brand || ' ' || p_name || ' ' || p_type) AS text FROM part)
SELECT p_partkey, arg_max(key, struct_pack(l := length(key), k := key)) AS key FROM x JOIN k ON contains(text, key) GROUP BY p_partkey""")
def longest_key(t: Tables) -> DataFrame:
    texts = t.part.select("p_partkey", F.lower(F.concat_ws(" ", "p_brand", "p_name", "p_type")).alias("text"))
    return J.longest_key(texts, t.part.select(F.col("p_name").alias("key")), ident="p_partkey")


@query("J6_longest_passage", """
SELECT d.doc_id, arg_max(b.text, struct_pack(l := length(b.text), k := b.text)) AS passage
FROM documents d JOIN (SELECT DISTINCT text FROM benchmark WHERE text <> '') b ON contains(d.text, b.text) GROUP BY d.doc_id""")
def longest_passage(t: Tables) -> DataFrame:
    """The longest test item that a whole document holds."""
    keys = t.benchmark.select(F.col("text").alias("key"))
    return J.longest_key(t.documents.select("doc_id", "text"), keys, ident="doc_id").select("doc_id", F.col("key").alias("passage"))


@query("J6_only_well", "SELECT photo, '7' AS well FROM photos")
def only_well(t: Tables) -> DataFrame:
    """With one known well every photo is of that well, whatever its name says."""
    wells = t.layers().filter("well = 7").select(F.col("well").cast("string").alias("key"))
    photos = t.photos().select("photo", F.col("well").cast("string").alias("well"), F.concat(F.lit("p"), "well").alias("text"))
    return J.resolve_wells(photos, wells).select("photo", "well")


@query("J16_long_labels", """
WITH e AS (SELECT text AS name, row_number() OVER (ORDER BY text) AS pos FROM (SELECT DISTINCT text FROM benchmark WHERE text <> '')),
 t AS (SELECT d.doc_id, name, pos, CASE WHEN lower(trim(d.text)) = lower(name) THEN 1 ELSE 3 END AS k FROM documents d JOIN e ON contains(lower(trim(d.text)), lower(name)) OR (trim(d.text) <> '' AND contains(lower(name), lower(trim(d.text)))))
SELECT d.doc_id, (SELECT arg_min(name, struct_pack(k := k, p := pos)) FROM t WHERE t.doc_id = d.doc_id) AS entry FROM documents d""")
def long_labels(t: Tables) -> DataFrame:
    """Whole documents as labels, test items as the legend."""
    names = t.benchmark.select(F.col("text").alias("name")).filter("name <> ''").distinct()
    entries = numbered(names.withColumn("__z", F.lit(0)), ["__z"], ["__z", "name"], "pos").drop("__z")
    return J.legend_lookup(t.documents.select("doc_id", "text"), entries, ["doc_id"], {}, label="text").select("doc_id", "entry")


CORES = "cores AS (SELECT DISTINCT well, 600 * CAST(floor(top_cm / 600) AS BIGINT) AS ct, 600 * CAST(floor(top_cm / 600) AS BIGINT) + 300 AS cb FROM layers)"


def cores(t: Tables, top: str = "core_top_cm", base: str = "core_base_cm") -> DataFrame:
    start = F.floor(F.col("top_cm") / 600).cast("bigint") * 600
    return t.layers().select("well", start.alias(top), (start + 300).alias(base)).distinct()


@query("J7_aligned_core", f"""
WITH {CORES}, h AS (SELECT photo, ct, cb, abs(top_cm - ct) + abs(base_cm - cb) AS e FROM photos p JOIN cores c USING (well)
  WHERE abs(top_cm - ct) <= 100 AND abs(base_cm - cb) <= 100 AND (base_cm - top_cm) / 300.0 >= 0.65)
SELECT photo, m.ct AS core_top_cm, m.cb AS core_base_cm FROM (SELECT photo, min(struct_pack(e := e, ct := ct, cb := cb)) AS m FROM h GROUP BY photo)""")
def aligned(t: Tables) -> DataFrame:
    return K.aligned_core(t.photos(), cores(t))


@query("J11_layer_inventory", f"""
WITH {PAIRED}, m AS (SELECT layer_id, count(DISTINCT photo) AS matched, bool_or(basis = 'gis') AS gis FROM matched GROUP BY layer_id),
 anyp AS (SELECT l.layer_id, count(DISTINCT p.photo) AS photos FROM lay l JOIN ph p ON p.well = l.well AND ((l.b > p.top_cm AND l.t < p.base_cm) OR (l.gb > p.top_cm AND l.gt < p.base_cm)) WHERE l.b > l.t GROUP BY l.layer_id),
 ids AS (SELECT layer_id, bool_and(valid) AS valid FROM lay GROUP BY layer_id)
SELECT layer_id, coalesce(matched, 0) AS matched_photos, coalesce(photos, 0) AS overlapping_photos, CASE WHEN matched > 0 AND gis THEN 'MATCHED_GIS_FALLBACK' WHEN matched > 0 THEN 'MATCHED'
  WHEN NOT valid THEN 'INVALID_FACIES_THICKNESS' WHEN photos > 0 THEN 'PHOTO_OVERLAPS_BUT_ROW_NOT_MATCHED' ELSE 'NO_PHOTO_OVERLAP' END AS status
FROM ids LEFT JOIN m USING (layer_id) LEFT JOIN anyp USING (layer_id)""")
def layer_inventory(t: Tables) -> DataFrame:
    from depthlake.operators import audit

    return audit.layer_inventory(two_systems(t), asked_photos(t), matches(t)).select("layer_id", "matched_photos", "overlapping_photos", "status")


@query("J12_photo_inventory", f"""
WITH {PAIRED}, m AS (SELECT photo, count(DISTINCT layer_id) AS n FROM matched GROUP BY photo), k AS (SELECT l_orderkey AS photo, count(*) FILTER (WHERE l_tax > 0.04) AS masks, count(*) AS cols FROM lineitem GROUP BY l_orderkey)
SELECT p.photo, coalesce(cols, 0) AS core_columns, coalesce(n, 0) AS matched_layers, coalesce(masks, 0) AS mask_count, CASE WHEN NOT confirmed THEN 'NO_CONFIRMED_INTERVAL' WHEN coalesce(cols, 0) = 0 THEN 'NO_CORE_COLUMNS'
  WHEN coalesce(n, 0) = 0 THEN 'NO_FACIES_MATCH' WHEN coalesce(masks, 0) = 0 THEN 'NO_MASKS' ELSE 'READY_FOR_REVIEW' END AS status
FROM photos p LEFT JOIN m USING (photo) LEFT JOIN k USING (photo)""")
def photo_inventory(t: Tables) -> DataFrame:
    from depthlake.operators import audit

    d = t.detections()
    return audit.photo_inventory(t.photos(), matches(t), d.filter("reviewed").select("photo"), d.select("photo"))


@query("J13_workbook_folder_pairs", """
WITH w AS (SELECT p_partkey AS workbook, p_name || p_size % 5 AS key FROM part), f AS (SELECT 'F' || (p_size % 3) || '/' || p_name AS folder, p_name || p_size % 5 AS key, min(1 + (p_size % 7) // 6) AS wells FROM part GROUP BY ALL),
 fw AS (SELECT folder, max(wells) AS wells FROM f GROUP BY folder), h AS (SELECT DISTINCT workbook, folder FROM w JOIN f USING (key) JOIN fw USING (folder) WHERE fw.wells <= 1),
 p AS (SELECT workbook, count(*) AS n, min(folder) AS folder FROM h GROUP BY workbook), o AS (SELECT folder, count(*) AS owners FROM p WHERE n = 1 GROUP BY folder)
SELECT workbook, CASE WHEN n = 1 AND owners = 1 THEN folder END AS folder, CASE WHEN n IS NULL THEN 'no folder' WHEN n > 1 THEN 'several folders' WHEN owners > 1 THEN 'folder shared by workbooks' ELSE '' END AS reason
FROM w LEFT JOIN p USING (workbook) LEFT JOIN o USING (folder)""")
def pairs(t: Tables) -> DataFrame:
    key = F.concat("p_name", F.col("p_size") % 5)
    books = t.part.select(F.col("p_partkey").alias("workbook"), key.alias("key"))
    raw = t.part.select(F.concat(F.lit("F"), F.col("p_size") % 3, F.lit("/"), "p_name").alias("folder"), key.alias("key"), (1 + F.expr("(p_size % 7) div 6")).alias("w"))
    per = raw.groupBy("folder", "key").agg(F.min("w").alias("w"))
    folders = per.join(per.groupBy("folder").agg(F.max("w").alias("wells")), "folder")
    return J.pair_by_keys(books, folders)


@query("J14_unique_or_null", """
WITH s AS (SELECT l_orderkey, l_suppkey, max(CAST(l_quantity AS BIGINT) // 5) AS score FROM lineitem GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY score DESC) AS k FROM s)
SELECT l_orderkey, CASE WHEN count(*) = 1 THEN min(l_suppkey) END AS l_suppkey, count(*) AS candidates FROM r WHERE k = 1 GROUP BY l_orderkey""")
def unique_or_null(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_suppkey", F.expr("cast(l_quantity as bigint) div 5").alias("score"))
    return J.unique_or_null(rows, ["l_orderkey"], "score", "l_suppkey")


@query("J14_log_file_wells", """
WITH l AS (SELECT o_orderkey AS file, CASE o_orderkey % 3 WHEN 0 THEN 'w_' || o_custkey WHEN 1 THEN 'w_' || o_custkey || '_x' ELSE 'q_' || o_custkey END AS key FROM orders),
 n AS (SELECT s_suppkey AS well, 'w_' || s_suppkey AS key, true AS is_well FROM supplier UNION ALL SELECT s_suppkey, 'w_' || (s_suppkey + 1) || '_x', false FROM supplier),
 h AS (SELECT file, well, max(CASE WHEN is_well THEN CASE WHEN l.key = n.key THEN 95 END WHEN l.key = n.key THEN 100 ELSE 80 END) AS s FROM l JOIN n ON l.key = n.key OR starts_with(l.key, n.key || '_') OR starts_with(n.key, l.key || '_') GROUP BY ALL),
 r AS (SELECT *, rank() OVER (PARTITION BY file ORDER BY s DESC) AS k FROM h WHERE s IS NOT NULL)
SELECT file, CASE WHEN count(*) = 1 THEN min(well) END AS well, count(*) AS candidates FROM r WHERE k = 1 GROUP BY file""")
def log_wells(t: Tables) -> DataFrame:
    kind = F.pmod("o_orderkey", F.lit(3))
    key = F.concat(F.when(kind == 2, "q_").otherwise("w_"), "o_custkey", F.when(kind == 1, "_x").otherwise(""))
    logs = t.orders.select(F.col("o_orderkey").alias("file"), key.alias("key"))
    well = F.col("s_suppkey").alias("well")
    names = t.supplier.select(well, F.concat(F.lit("w_"), "s_suppkey").alias("key"), F.lit(True).alias("is_well")).unionByName(
        t.supplier.select(well, F.concat(F.lit("w_"), F.col("s_suppkey") + 1, F.lit("_x")).alias("key"), F.lit(False).alias("is_well")))
    return J.log_file_wells(logs, names)


@query("J15_strict_class", """
WITH c AS (SELECT DISTINCT p_type || '@' || p_brand AS model_label, p_type AS code, p_brand AS "index" FROM part), r AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_type WHEN 1 THEN p_type || '@' || p_brand ELSE lower(p_type) END AS label,
   CASE WHEN p_size % 2 = 0 THEN p_brand END AS ix FROM part), h AS (SELECT p_partkey, count(*) AS n, min(c.model_label) AS m FROM r JOIN c ON (r.label = c.model_label OR r.label = c.code) AND (ix IS NULL OR ix = c."index") GROUP BY p_partkey)
SELECT r.p_partkey, CASE WHEN n = 1 THEN m END AS class_id FROM r LEFT JOIN h ON h.p_partkey = r.p_partkey""")
def strict_class(t: Tables) -> DataFrame:
    label = F.concat_ws("@", "p_type", "p_brand")
    catalog = t.part.select(label.alias("class_id"), label.alias("model_label"), F.col("p_type").alias("code"), F.col("p_brand").alias("index")).distinct()
    kind = F.col("p_size") % 3
    rows = t.part.select("p_partkey", F.when(kind == 0, F.col("p_type")).when(kind == 1, label).otherwise(F.lower("p_type")).alias("label"),
                         F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("index"))
    return J.resolve_class(rows, catalog, ["p_partkey"]).select("p_partkey", "class_id")


@query("J16_legend_lookup", """
WITH r AS (SELECT p_partkey, lower(p_name) AS l FROM part), e AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS name FROM part WHERE split_part(p_name, ' ', 2) <> ''), g AS (SELECT name, row_number() OVER (ORDER BY name) AS pos FROM e),
 t AS (SELECT p_partkey, CASE WHEN l = g.name THEN 1 WHEN contains(l, 'red') AND g.name = 'bolt' THEN 2 WHEN contains(l, g.name) OR contains(g.name, l) THEN 3 END AS k, pos, name FROM r JOIN g ON true)
SELECT r.p_partkey, (SELECT arg_min(name, struct_pack(k := k, p := pos)) FROM t WHERE t.p_partkey = r.p_partkey AND k IS NOT NULL) AS entry FROM r""")
def legend(t: Tables) -> DataFrame:
    names = t.part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name")).filter("name <> ''").distinct()
    entries = numbered(names.withColumn("__z", F.lit(0)), ["__z"], ["__z", "name"], "pos").drop("__z")
    return J.legend_lookup(t.part.select("p_partkey", F.col("p_name").alias("label")), entries, ["p_partkey"], {"red": "bolt"}).select("p_partkey", "entry")


@query("J17_saved_over_default", """
SELECT coalesce(a.well, b.well) AS well, coalesce(b.color, a.color) AS color FROM (SELECT s_suppkey AS well, 'grey' AS color FROM supplier) a
FULL JOIN (SELECT s_suppkey * 2 AS well, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'red' || s_nationkey END AS color FROM supplier) b ON a.well = b.well""")
def overlay(t: Tables) -> DataFrame:
    base = t.supplier.select(F.col("s_suppkey").alias("well"), F.lit("grey").alias("color"))
    saved = t.supplier.select((F.col("s_suppkey") * 2).alias("well"), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("red"), "s_nationkey")).alias("color"))
    return J.overlay(base, saved, "well")


LANE_CTE = "lanes(col, l, r) AS (VALUES (0, 0, 90), (1, 100, 180), (2, 190, 300))"


def three_lanes(t: Tables, key: str = "photo") -> DataFrame:
    cols = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(c) for c, v in zip(("col", *B.BOX), x)]) for x in ((0, 0, 0, 90, 100), (1, 100, 0, 180, 100), (2, 190, 0, 300, 60))])
    return t.photos().select("photo").select("photo", F.inline(cols))


@query("J19_token_lanes", f"""
WITH {LANE_CTE}, k AS (SELECT l_orderkey AS photo, l_linenumber AS text_row, l_partkey % 400 AS x, l_suppkey AS value, CAST(round(l_discount * 100) AS BIGINT) AS conf FROM lineitem),
 n AS (SELECT k.*, arg_min(struct_pack(col := col, c := (l + r) / 2.0, w := r - l), struct_pack(d := abs(x - (l + r) / 2.0), col := col)) AS b FROM k, lanes GROUP BY ALL),
 ok AS (SELECT * FROM n WHERE abs(x - b.c) <= greatest(1.25 * b.w, 0.48 * (SELECT min(abs((l + r) / 2.0 - n.b.c)) FROM lanes WHERE col <> n.b.col)))
SELECT photo, text_row, CAST(b.col AS BIGINT) AS col, arg_max(value, struct_pack(c := conf, x := -x, v := value)) AS value FROM ok WHERE photo IN (SELECT o_orderkey FROM orders) GROUP BY ALL""")
def token_lanes(t: Tables) -> DataFrame:
    tokens = t.lineitem.select(F.col("l_orderkey").alias("photo"), F.col("l_linenumber").alias("text_row"), (F.col("l_partkey") % 400).alias("x"), F.col("l_suppkey").alias("value"),
                               F.struct(F.round(F.col("l_discount") * 100).cast("bigint").alias("c"), (-(F.col("l_partkey") % 400)).alias("x"), F.col("l_suppkey").alias("v")).alias("confidence"))
    return J.lane_of_token(tokens, three_lanes(t)).select("photo", "text_row", "col", "value")


@query("J20_depth_row_pairs", """
WITH p AS (SELECT photo, top_cm + 100000 AS t, photo % 3 AS kind FROM photos)
SELECT photo, CASE WHEN kind = 0 THEN 'gis' WHEN kind = 1 THEN 'drilling' ELSE 'unknown' END AS basis, CAST(c AS BIGINT) AS col, t + 100 * c AS top_cm, t + 100 * c + 100 AS base_cm FROM p, (VALUES (0), (1), (2)) v(c)
UNION ALL SELECT photo, 'drilling', CAST(c AS BIGINT), t + 5 + 100 * c, t + 105 + 100 * c FROM p, (VALUES (0), (1), (2)) v(c) WHERE kind = 0""")
def depth_row_pairs(t: Tables) -> DataFrame:
    return J.pair_depth_rows(label_rows(t), three_lanes(t)).select("photo", "basis", "col", "top_cm", "base_cm")


def label_rows(t: Tables) -> DataFrame:
    """Printed depth rows: kind 0 has two systems, kind 1 one, kind 2 rows without a name."""
    p = t.photos().select("photo", (F.col("top_cm") + 100000).alias("t"), (F.col("photo") % 3).alias("kind"))
    cell = lambda row, side, basis, shift: F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint")), lambda c: F.struct(
        F.lit(row).alias("text_row"), F.lit(side).alias("side"), basis.alias("basis"), c.alias("col"), (F.col("t") + shift + 100 * c).alias("value")))
    name = F.when(F.col("kind") == 0, "gis").when(F.col("kind") == 1, "drilling").otherwise("unknown")
    main = F.concat(cell(0, "header", name, 0), cell(8, "footer", name, 100))
    more = F.concat(cell(1, "header", F.lit("drilling"), 5), cell(9, "footer", F.lit("drilling"), 105))
    return p.select("photo", F.inline(F.when(F.col("kind") == 0, F.concat(main, more)).otherwise(main)))


@query("J21_coherent_labels", """
WITH p AS (SELECT photo, top_cm + 100000 AS t, photo % 3 AS kind FROM photos)
SELECT photo, CASE WHEN kind = 0 THEN 'drilling' WHEN kind = 1 THEN 'drilling' ELSE 'unknown' END AS basis, CAST(c AS BIGINT) AS col, t + CASE WHEN kind = 0 THEN 5 ELSE 0 END + 100 * c AS top_cm FROM p, (VALUES (0), (1), (2)) v(c)""")
def coherent(t: Tables) -> DataFrame:
    sets = J.pair_depth_rows(label_rows(t), three_lanes(t)).withColumn("set_id", F.col("top_row") * 100 + F.col("base_row"))
    expected = t.photos().select("photo", (F.col("top_cm") + 100003).alias("exp_top_cm"), (F.col("top_cm") + 100303).alias("exp_base_cm"))
    return J.coherent_labels(sets, three_lanes(t), expected).select("photo", "basis", "col", "top_cm")


@query("J22_zip_labels", """
SELECT photo, CAST(c AS BIGINT) AS col, top_cm + 100 * c AS top_cm, top_cm + 100 * c + 100 AS base_cm FROM photos, (VALUES (0), (1), (2)) v(c) WHERE photo % 3 <> 1""")
def zip_labels(t: Tables) -> DataFrame:
    labels = F.transform(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(x).alias("x")) for c, x in ((0, 0.15), (1, 0.45), (2, 0.80))]), lambda e: F.struct(
        e["x"].alias("x"), (F.col("top_cm") + 100 * F.when((F.col("photo") % 3 == 1) & (e["c"] == 2), 0).otherwise(e["c"])).alias("top_cm"),
        (F.col("top_cm") + 100 * F.when((F.col("photo") % 3 == 1) & (e["c"] == 2), 0).otherwise(e["c"]) + 100).alias("base_cm")))
    return J.zip_labels(three_lanes(t), t.photos().select("photo", F.inline(labels)), 300)


@query("J22_nearest_labels", """
SELECT photo, CAST(c AS BIGINT) AS col, top_cm + 100 * c AS top_cm, top_cm + 100 * c + 100 AS base_cm FROM photos, (VALUES (0), (2)) v(c) WHERE photo % 4 = 0
UNION ALL SELECT photo, 1, top_cm + 100, top_cm + 200 FROM photos WHERE photo % 4 = 3""")
def nearest_labels(t: Tables) -> DataFrame:
    """Two of three lanes labelled; by photo: both near, both at one lane, one too long, only one and that off its lane."""
    kind = F.col("photo") % 4
    label = lambda c, x, size: F.struct(F.lit(x).alias("x"), (F.col("top_cm") + 100 * c).alias("top_cm"), (F.col("top_cm") + 100 * c + size).alias("base_cm"))
    told = F.when(kind == 0, F.array(label(0, 0.15, 100), label(2, 0.80, 100))).when(kind == 1, F.array(label(0, 0.15, 100), label(2, 0.20, 100))).when(
        kind == 2, F.array(label(0, 0.15, 100), label(2, 0.80, 151))).otherwise(F.array(label(1, 0.52, 100)))
    return J.nearest_labels(three_lanes(t), t.photos().select("photo", F.inline(told)), 300)


UNPLACED = """op AS (SELECT photo, well, row_number() OVER (PARTITION BY well ORDER BY photo) AS n, count(*) OVER (PARTITION BY well) AS np FROM photos WHERE NOT confirmed AND photo % 10 = well % 10),
 av AS (SELECT well, ct, cb, row_number() OVER (PARTITION BY well ORDER BY ct) AS n, count(*) OVER (PARTITION BY well) AS na FROM (SELECT well, 0 AS ct, 1000 AS cb FROM (SELECT DISTINCT well FROM photos)
   UNION ALL SELECT DISTINCT well, 2000 * (1 + photo % 7) AS ct, 2000 * (1 + photo % 7) + 500 AS cb FROM photos WHERE NOT confirmed AND photo % 10 = well % 10 AND well % 2 = 0))"""


@query("J23_suggested_intervals", f"""
WITH {UNPLACED}, c AS (SELECT well, count(*) AS na, min(ct) AS t, max(cb) AS b FROM av GROUP BY well)
SELECT op.photo, op.well, CAST(av.ct AS DOUBLE) AS top_cm, CAST(av.cb AS DOUBLE) AS base_cm, 'one to one' AS how FROM op JOIN c USING (well) JOIN av ON av.well = op.well AND av.n = op.n WHERE op.np = c.na
UNION ALL SELECT photo, well, t + (n - 1) * (CAST(b - t AS DOUBLE) / np), CASE WHEN n = np THEN CAST(b AS DOUBLE) ELSE t + n * (CAST(b - t AS DOUBLE) / np) END, 'equal split' FROM op JOIN c USING (well) WHERE c.na = 1 AND np > 1""")
def suggested(t: Tables) -> DataFrame:
    p = t.photos()
    open_ = p.filter(~F.col("confirmed") & (F.col("photo") % 10 == F.col("well") % 10)).select("photo", "well", F.col("photo").alias("pos"))
    start = 2000 * (1 + F.col("photo") % 7)
    extra = open_.filter("well % 2 = 0").select("well", start.alias("top_cm"), (start + 500).alias("base_cm")).distinct()
    available = p.select("well", F.lit(0).cast("bigint").alias("top_cm"), F.lit(1000).cast("bigint").alias("base_cm")).distinct().unionByName(extra)
    return J.zip_suggestions(open_, available)


@query("J24_snapshot_changes", """
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'missing' ELSE 'changed' END AS change
FROM (SELECT o_orderkey AS path, o_custkey AS m FROM orders WHERE o_orderkey % 11 <> 0) a FULL JOIN (SELECT o_orderkey AS path, o_custkey + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS m FROM orders WHERE o_orderkey % 13 <> 0) b ON a.path = b.path
WHERE a.path IS NULL OR b.path IS NULL OR a.m <> b.m""")
def changes(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderkey").alias("path"), F.lit(1).alias("size"), F.col("o_custkey").alias("mtime"))
    now = o.filter("path % 13 <> 0").withColumn("mtime", F.col("mtime") + F.when(F.col("path") % 17 == 0, 1).otherwise(0))
    return J.snapshot_changes(o.filter("path % 11 <> 0"), now)


@query("J25_merged_queue", """
SELECT s_suppkey AS excel, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 5 <> 0 THEN 'm' || s_nationkey ELSE 'd' || s_nationkey END AS photos, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 5 <> 0 THEN '' ELSE 'check' END AS reason,
  s_suppkey % 2 = 0 AND s_suppkey % 5 <> 0 AS manual_pair, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 AND s_suppkey % 5 <> 0 THEN 'p' || s_suppkey ELSE '' END AS project FROM supplier""")
def queue(t: Tables) -> DataFrame:
    key, manual = F.col("s_suppkey"), F.concat(F.lit("m"), "s_nationkey")
    found = t.supplier.select(key.alias("excel"), F.concat(F.lit("d"), "s_nationkey").alias("photos"), F.lit("check").alias("reason"))
    previous = t.supplier.select(key.alias("excel"), F.when(key % 5 != 0, manual).otherwise("gone").alias("photos"), (key % 2 == 0).alias("manual_pair"), F.concat(F.lit("p"), "s_suppkey").alias("project"))
    projects = t.supplier.filter("s_suppkey % 3 = 0").select(F.concat(F.lit("p"), "s_suppkey").alias("project"), key.alias("excel"), manual.alias("photos"))
    return J.merge_queue(found, previous, projects, t.supplier.select(manual.alias("photos")))


@query("J27_wells_with_photos", "SELECT layer_id, well FROM layers WHERE well IN (SELECT well FROM photos WHERE confirmed)")
def wells_with_photos(t: Tables) -> DataFrame:
    from depthlake.operators import audit

    return audit.layers_of_photo_wells(t.layers(), t.photos().filter("confirmed")).select("layer_id", "well")


@query("J28_enriched_photos", """
SELECT photo, CASE WHEN photo % 3 = 0 THEN top_cm WHEN photo % 5 = 0 THEN top_cm ELSE top_cm - 1 END AS top_cm, CASE WHEN photo % 3 = 0 OR photo % 5 = 0 THEN base_cm ELSE top_cm + 199 END AS base_cm,
  CASE WHEN photo % 3 = 0 THEN 'manual' WHEN photo % 5 = 0 THEN 'ocr' ELSE 'ocr_verified' END AS source, photo % 5 <> 0 OR confirmed OR photo % 3 = 0 AS confirmed,
  photo % 5 <> 0 AND (photo % 3 <> 0 OR top_cm + 199 <= base_cm + 2) AS has_labels, CASE WHEN photo % 5 <> 0 THEN 'gis' ELSE 'unknown' END AS depth_basis FROM photos""")
def enriched(t: Tables) -> DataFrame:
    manual = F.col("photo") % 3 == 0
    p = t.photos().select("photo", "top_cm", "base_cm", F.when(manual, "manual").otherwise("ocr").alias("source"), (F.col("confirmed") | manual).alias("confirmed"), F.lit("unknown").alias("depth_basis"))
    labels = p.filter("photo % 5 <> 0").select("photo", F.explode(F.array(F.lit(0), F.lit(100))).alias("k"), "top_cm").select(
        "photo", (F.col("top_cm") + F.col("k") - 1).alias("top_cm"), (F.col("top_cm") + F.col("k") + 99).alias("base_cm"), F.lit("gis").alias("basis"))
    return J.enrich_labels(p, labels)


@query("J29_reviewed_boxes", """
SELECT photo AS path, det, CASE WHEN photo % 7 = 0 THEN 'file missing' WHEN photo % 5 = 0 THEN 'file changed' WHEN "right" > 220 OR bottom > 340 THEN 'box outside the image' END AS reason FROM detections""")
def reviewed_boxes(t: Tables) -> DataFrame:
    d = t.detections().select(F.col("photo").alias("path"), "det", *B.BOX, F.lit(1).alias("size"), F.lit(1).alias("mtime"))
    files = d.select("path").distinct().filter("path % 7 <> 0").select(
        "path", F.lit(1).alias("size"), F.when(F.col("path") % 5 == 0, 2).otherwise(1).alias("mtime"), F.lit(220).alias("width"), F.lit(340).alias("height"))
    good, bad = J.accept_reviewed(d, files)
    return good.select("path", "det", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("path", "det", "reason"))


HEIGHTS = 'h AS (SELECT photo, det, bottom - top AS height, top, "left" FROM detections)'


@query("P1_height_allocation", """
WITH h AS (SELECT photo, det, bottom - top AS height FROM detections), r AS (SELECT *, coalesce(sum(height) OVER (PARTITION BY photo ORDER BY det ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above, sum(height) OVER (PARTITION BY photo) AS total FROM h)
SELECT r.photo, det, p.top_cm + CAST(round_even(CAST((base_cm - top_cm) * above AS DOUBLE) / total, 0) AS BIGINT) AS top_cm, p.top_cm + CAST(round_even(CAST((base_cm - top_cm) * (above + height) AS DOUBLE) / total, 0) AS BIGINT) AS base_cm FROM r JOIN photos p ON p.photo = r.photo""")
def height_allocation(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    cols = t.detections().select("photo", "det", (F.col("bottom") - F.col("top")).alias("height"))
    cols = cols.withColumn("pos", F.row_number().over(W.partitionBy("photo").orderBy("det")).cast("bigint"))
    spans = t.photos().select("photo", F.col("top_cm").alias("span_top_cm"), F.col("base_cm").alias("span_base_cm"))
    return K.allocate_by_height(cols, spans, ["photo"], "pos").select("photo", "det", "top_cm", "base_cm")


@query("P2_column_capacity", """
WITH r AS (SELECT photo, det, greatest(1, bottom - top) AS h, row_number() OVER (PARTITION BY photo ORDER BY bottom - top, det) - 1 AS i, count(*) OVER (PARTITION BY photo) AS n FROM detections),
 m AS (SELECT photo, h AS ref FROM r WHERE i = n // 2)
SELECT photo, det, CAST(greatest(1, least(100, round_even(h * 100 / CAST(ref AS DOUBLE), 0))) AS BIGINT) AS capacity_cm FROM r JOIN m USING (photo)""")
def capacity(t: Tables) -> DataFrame:
    return K.column_capacities(t.detections().select("photo", "det", "top", "bottom")).select("photo", "det", "capacity_cm")


def calibrated(t: Tables) -> DataFrame:
    """Three columns of 100, 100 and 60 cm per photo; some photos carry labels or a ruler."""
    read = F.when(F.col("photo") % 4 == 0, True).when((F.col("photo") % 4 == 1) & (F.col("col") == 0), True).otherwise(False)
    cols = three_lanes(t).join(t.photos().select("photo", F.col("top_cm").alias("t")), "photo").select(
        "photo", "col", *B.BOX, F.when(F.col("col") == 2, 60).otherwise(100).cast("bigint").alias("capacity_cm"),
        F.when(read, F.col("t") + 100 * F.col("col")).alias("label_top_cm"), F.when(read, F.col("t") + 100 * F.col("col") + F.when(F.col("col") == 2, 60).otherwise(100)).alias("label_base_cm"),
        (F.col("photo") % 4 == 2).alias("has_scale"))
    photos = t.photos().select("photo", "top_cm", (F.col("top_cm") + F.when(F.col("photo") % 3 == 0, 260).otherwise(60 + 100 * (F.col("photo") % 5))).alias("base_cm"))
    return K.calibrate_columns(cols, photos)


@query("P3_capacity_allocation", """
WITH c AS (SELECT photo, col, top_cm AS t, top_cm + CASE WHEN photo % 3 = 0 THEN 260 ELSE 60 + 100 * (photo % 5) END AS b, CASE col WHEN 2 THEN 60 ELSE 100 END AS cap, photo % 4 AS kind FROM photos, (VALUES (0), (1), (2)) v(col)),
 f AS (SELECT *, t + 100 * col AS s, abs(b - t - 260) > 2 AS off FROM c),
 g AS (SELECT *, CASE WHEN col = 2 THEN b ELSE s + cap END AS pb FROM f)
SELECT photo, CAST(col AS BIGINT) AS col, s AS top_cm, CASE WHEN kind = 0 THEN s + cap WHEN kind = 1 THEN pb WHEN col = 2 AND b - t <= 262 THEN b ELSE least(b, s + cap) END AS base_cm
FROM g WHERE kind = 0 OR (kind = 1 AND NOT off) OR (kind >= 2 AND NOT (kind = 2 AND off) AND s < b)""")
def capacity_allocation(t: Tables) -> DataFrame:
    return calibrated(t)


PACK_SQL = """pk AS (SELECT photo, well, row_number() OVER (PARTITION BY well ORDER BY photo) AS pos, count(*) OVER (PARTITION BY well) AS n FROM photos)"""


def packing(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Photos of 100 cm; each well's cores hold two photos each, the last may hold one; every fifth well is one photo short."""
    photos = numbered(t.photos().select("photo", "well"), ["well"], ["photo"], "pos").withColumn("capacity_cm", F.lit(100).cast("bigint"))
    start = (F.expr("(pos - 1) div 2") * 1000)
    cores_ = photos.filter(~((F.col("well") % 5 == 0) & (F.col("pos") <= 2))).select("well", start.alias("top_cm"), "pos").groupBy("well", "top_cm").agg(
        (F.first("top_cm") + 100 * F.count(F.lit(1))).alias("base_cm"))
    return photos, cores_


@query("P4_full_well_packing", f"""
WITH {PACK_SQL} SELECT photo, well, 1000 * ((pos - 1) // 2) + 100 * ((pos - 1) % 2) AS top_cm, 1000 * ((pos - 1) // 2) + 100 * ((pos - 1) % 2) + 100 AS base_cm, (pos - 1) // 2 AS core_no FROM pk WHERE well % 5 <> 0""")
def pack(t: Tables) -> DataFrame:
    photos, cores_ = packing(t)
    return K.pack_wells(photos, cores_)


def captioned(t: Tables) -> DataFrame:
    p = t.photos()
    start = F.floor(F.col("top_cm") / 600).cast("bigint") * 600
    return p.select("photo", "well", start.alias("top_cm"), (start + 300).alias("base_cm"), F.col("photo").alias("pos"), (50 + 50 * (F.col("photo") % 4)).alias("capacity_cm"))


@query("P5_caption_group_split", f"""
WITH {CORES}, m AS (SELECT photo, p.well, ct, cb, 50 + 50 * (photo % 4) AS cap FROM photos p JOIN cores c ON c.well = p.well AND c.ct = 600 * CAST(floor(p.top_cm / 600) AS BIGINT)),
 g AS (SELECT *, sum(cap) OVER (PARTITION BY well, ct) AS s, ct + coalesce(sum(cap) OVER (PARTITION BY well, ct ORDER BY photo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM m)
SELECT photo, CAST(CASE WHEN s <= 302 THEN st END AS BIGINT) AS top_cm, CAST(CASE WHEN s <= 302 THEN least(cb, st + cap) END AS BIGINT) AS base_cm, CASE WHEN s <= 302 THEN 'ocr_sequenced' ELSE 'ocr_not_found' END AS source, abs(s - 300) <= 2 AS confirmed FROM g""")
def caption_split(t: Tables) -> DataFrame:
    return K.split_caption_groups(captioned(t), cores(t)).select("photo", "top_cm", "base_cm", "source", "confirmed")


@query("P6_P7_layer_projection", """
SELECT p.photo, l.layer_id, CAST(v.c AS BIGINT) AS col, CAST(floor((v.a + (greatest(l.top_cm, p.top_cm, p.top_cm + 100 * v.c) - p.top_cm - 100 * v.c) * CAST(v.z - v.a AS DOUBLE) / 100) * 1000 + 0.5) AS BIGINT) AS y0,
  CAST(floor((v.a + (least(l.base_cm, p.base_cm, p.top_cm + 100 * v.c + 100) - p.top_cm - 100 * v.c) * CAST(v.z - v.a AS DOUBLE) / 100) * 1000 + 0.5) AS BIGINT) AS y1
FROM photos p JOIN layers l ON l.well = p.well AND l.base_cm > p.top_cm AND l.top_cm < p.base_cm JOIN (VALUES (0, 0, 700), (1, 20, 720), (2, 0, 640)) v(c, a, z) ON p.top_cm + 100 * v.c < least(l.base_cm, p.base_cm) AND p.top_cm + 100 * v.c + 100 > greatest(l.top_cm, p.top_cm)
WHERE p.confirmed""")
def projection(t: Tables) -> DataFrame:
    p = t.photos().filter("confirmed").select("photo", "well", "top_cm", "base_cm")
    right = t.layers().select("well", "layer_id", F.col("top_cm").alias("r_top_cm"), F.col("base_cm").alias("r_base_cm"))
    hits = iv.overlap_join(p, right, ["well"]).select("photo", "layer_id", "overlap_top_cm", "overlap_base_cm")
    lanes = F.array(*[F.struct(F.lit(c).cast("bigint").alias("col"), F.lit(a).alias("top"), F.lit(z).alias("bottom")) for c, a, z in ((0, 0, 700), (1, 20, 720), (2, 0, 640))])
    cols = p.select("photo", "top_cm", F.inline(lanes)).select(
        "photo", "col", F.lit(0).alias("left"), F.col("top"), F.lit(50).alias("right"), F.col("bottom"), F.lit("down").alias("direction"), (F.col("top_cm") + 100 * F.col("col")).alias("top_cm"), (F.col("top_cm") + 100 * F.col("col") + 100).alias("base_cm"))
    got = K.project_layers(hits, cols)
    milli = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("bigint").alias(c)
    return got.select("photo", "layer_id", "col", milli("y0"), milli("y1"))


@query("P8_global_tape", """
WITH h AS (SELECT d.photo, det, bottom - top AS height, p.well, p.top_cm AS pt, p.base_cm AS pb FROM detections d JOIN photos p ON p.photo = d.photo), w AS (SELECT well, min(top_cm) AS wt, max(base_cm) AS wb FROM layers GROUP BY well),
 u AS (SELECT h.*, CASE WHEN h.well % 2 = 0 THEN 'w' || h.well ELSE 'p' || photo END AS unit, CASE WHEN h.well % 2 = 0 THEN wt ELSE pt END AS st, CASE WHEN h.well % 2 = 0 THEN wb ELSE pb END AS sb FROM h JOIN w ON w.well = h.well),
 r AS (SELECT *, coalesce(sum(height) OVER (PARTITION BY unit ORDER BY photo, det ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above, sum(height) OVER (PARTITION BY unit) AS total FROM u)
SELECT photo, det AS col, st + CAST(round_even(CAST((sb - st) * above AS DOUBLE) / total, 0) AS BIGINT) AS top_cm, st + CAST(round_even(CAST((sb - st) * (above + height) AS DOUBLE) / total, 0) AS BIGINT) AS base_cm FROM r""")
def tape(t: Tables) -> DataFrame:
    p = t.photos()
    gone = (F.col("well") % 2 == 0) & (F.col("photo") % 2 == 0) | (F.col("well") % 2 == 0)
    photos = p.select("photo", "well", F.when(~gone, F.col("top_cm")).alias("top_cm"), F.when(~gone, F.col("base_cm")).alias("base_cm"))
    cols = t.detections().select("photo", F.col("det").alias("col"), (F.col("bottom") - F.col("top")).alias("height"))
    wells = t.layers().groupBy("well").agg(F.min("top_cm").alias("top_cm"), F.max("base_cm").alias("base_cm"))
    return K.tape_calibration(cols, photos, wells, order=("photo", "col")).select("photo", "col", "top_cm", "base_cm")


@query("P9_free_ranges", f"""
WITH {CORES} SELECT well, ct AS top_cm, cb AS base_cm FROM cores c WHERE NOT EXISTS (SELECT 1 FROM photos p WHERE p.confirmed AND p.well = c.well AND p.base_cm > c.ct AND p.top_cm < c.cb)""")
def free(t: Tables) -> DataFrame:
    return K.free_ranges(cores(t, "top_cm", "base_cm"), t.photos().filter("confirmed"))


#: Photos of 150 a well: what each photo says of its depth depends on its well and place, so every stage has work and refusals.
INFER_SQL = """b AS (SELECT photo, well, row_number() OVER (PARTITION BY well ORDER BY photo) AS pos FROM photos),
 c AS (SELECT *, 1000 * ((pos - 1) // 2) + 100 * ((pos - 1) % 2) AS spot, CASE
   WHEN well % 30 = 0 THEN CASE WHEN pos IN (1, 3, 4) THEN 'none' ELSE 'old' END
   WHEN well % 6 = 1 AND pos % 9 = 4 THEN 'manual' WHEN well % 6 = 2 AND pos = 3 THEN 'manual off'
   WHEN well % 6 = 3 AND pos % 8 IN (1, 2) THEN 'caption' WHEN well % 6 = 3 AND pos = 6 THEN 'gis'
   WHEN well % 6 = 4 AND pos % 3 = 0 THEN 'figure' WHEN well % 6 = 4 AND pos % 3 = 1 THEN 'name'
   WHEN well % 6 = 5 AND pos = 2 THEN 'labels' WHEN well % 6 = 0 AND pos % 5 = 1 AND pos < 100 THEN 'whole' ELSE 'none' END AS says FROM b),
 raw AS (SELECT photo, CASE photo % 5 WHEN 0 THEN '' WHEN 1 THEN 'zz' ELSE CAST(well AS VARCHAR) END AS well, 'p' || well AS name, pos,
   CASE WHEN well % 30 = 0 AND pos = 3 THEN 200 ELSE 100 END AS cap,
   CASE says WHEN 'old' THEN spot WHEN 'manual' THEN spot + 1 WHEN 'manual off' THEN spot + 50 WHEN 'caption' THEN spot // 1000 * 1000 WHEN 'figure' THEN 90000000 WHEN 'name' THEN spot WHEN 'whole' THEN spot // 1000 * 1000 + 2 END AS top,
   CASE says WHEN 'old' THEN spot + 100 WHEN 'manual' THEN spot + 99 WHEN 'manual off' THEN spot + 150 WHEN 'caption' THEN spot // 1000 * 1000 + 200 WHEN 'figure' THEN 90000100 WHEN 'name' THEN spot + 100 WHEN 'whole' THEN spot // 1000 * 1000 + 199 END AS base,
   CASE says WHEN 'old' THEN 'legacy' WHEN 'manual' THEN 'manual' WHEN 'manual off' THEN 'manual' WHEN 'caption' THEN 'ocr' WHEN 'whole' THEN 'ocr_verified' WHEN 'figure' THEN 'filename' WHEN 'name' THEN 'filename' ELSE 'not_found' END AS source,
   says IN ('manual', 'manual off', 'name', 'whole', 'figure') AS confirmed, CASE says WHEN 'gis' THEN 'gis' ELSE 'unknown' END AS basis,
   CASE WHEN says = 'labels' THEN spot + CASE WHEN well % 12 = 5 THEN 10 ELSE 1 END END AS label_top, CASE WHEN says = 'labels' THEN spot + 100 END AS label_base FROM c),
 cr AS (SELECT CAST(well AS VARCHAR) AS well, spot // 1000 * 1000 AS ct, spot // 1000 * 1000 + 100 * count(*) AS cb FROM c
   WHERE NOT (well % 5 = 0 AND pos <= 2) AND well <> 0 GROUP BY well, spot // 1000),
 core AS (SELECT *, row_number() OVER (PARTITION BY well ORDER BY ct, cb) - 1 AS k, count(*) OVER (PARTITION BY well) AS cores FROM cr)"""


def inferred(t: Tables) -> tuple[DataFrame, DataFrame]:
    b = numbered(t.photos().select("photo", "well"), ["well"], ["photo"], "pos").withColumn("at", F.expr("1000 * ((pos - 1) div 2) + 100 * ((pos - 1) % 2)"))
    c = b.withColumn("says", F.expr("""CASE WHEN well % 30 = 0 THEN CASE WHEN pos IN (1, 3, 4) THEN 'none' ELSE 'old' END
      WHEN well % 6 = 1 AND pos % 9 = 4 THEN 'manual' WHEN well % 6 = 2 AND pos = 3 THEN 'manual off'
      WHEN well % 6 = 3 AND pos % 8 IN (1, 2) THEN 'caption' WHEN well % 6 = 3 AND pos = 6 THEN 'gis'
      WHEN well % 6 = 4 AND pos % 3 = 0 THEN 'figure' WHEN well % 6 = 4 AND pos % 3 = 1 THEN 'name'
      WHEN well % 6 = 5 AND pos = 2 THEN 'labels' WHEN well % 6 = 0 AND pos % 5 = 1 AND pos < 100 THEN 'whole' ELSE 'none' END""")).withColumn("core", F.expr("at div 1000 * 1000"))
    photos = c.select(
        "photo", F.expr("CASE photo % 5 WHEN 0 THEN '' WHEN 1 THEN 'zz' ELSE CAST(well AS STRING) END").alias("well"), F.concat(F.lit("p"), "well").alias("name"), "pos",
        F.expr("CASE WHEN well % 30 = 0 AND pos = 3 THEN 200L ELSE 100L END").alias("capacity_cm"),
        F.expr("CASE says WHEN 'old' THEN at WHEN 'manual' THEN at + 1 WHEN 'manual off' THEN at + 50 WHEN 'caption' THEN core WHEN 'figure' THEN 90000000 WHEN 'name' THEN at WHEN 'whole' THEN core + 2 END").alias("top_cm"),
        F.expr("CASE says WHEN 'old' THEN at + 100 WHEN 'manual' THEN at + 99 WHEN 'manual off' THEN at + 150 WHEN 'caption' THEN core + 200 WHEN 'figure' THEN 90000100 WHEN 'name' THEN at + 100 WHEN 'whole' THEN core + 199 END").alias("base_cm"),
        F.expr("CASE says WHEN 'old' THEN 'legacy' WHEN 'manual' THEN 'manual' WHEN 'manual off' THEN 'manual' WHEN 'caption' THEN 'ocr' WHEN 'whole' THEN 'ocr_verified' WHEN 'figure' THEN 'filename' WHEN 'name' THEN 'filename' ELSE 'not_found' END").alias("source"),
        F.col("says").isin("manual", "manual off", "name", "whole", "figure").alias("confirmed"), F.when(F.col("says") == "gis", "gis").otherwise("unknown").alias("depth_basis"),
        F.expr("CASE WHEN says = 'labels' THEN at + CASE WHEN well % 12 = 5 THEN 10 ELSE 1 END END").alias("col_top_cm"), F.expr("CASE WHEN says = 'labels' THEN at + 100 END").alias("col_base_cm"))
    photos = photos.withColumn("text", F.concat("well", "name"))
    held = c.filter("NOT (well % 5 = 0 AND pos <= 2) AND well <> 0").groupBy(F.col("well").cast("string").alias("well"), F.col("core").alias("core_top_cm")).agg(F.count(F.lit(1)).alias("n"))
    core = held.withColumn("core_base_cm", F.col("core_top_cm") + 100 * F.col("n"))
    rows = core.select("well", F.col("core_top_cm").alias("top_cm"), F.col("core_base_cm").alias("base_cm"), "core_top_cm", "core_base_cm",
                       (F.col("core_top_cm") + 500000).alias("gis_top_cm"), (F.col("core_base_cm") + 500000).alias("gis_base_cm"))
    return photos, rows


def packing_sql(name: str, photos: str, cores: str) -> str:
    """A fold over the photos ``photos`` (well, i, n, photo, cap) of a well along ``cores`` (well, k, cores, ct, cb)."""
    return f"""{name}(well, i, n, photo, reached, k, top, base, core, fits) AS (
  SELECT well, 0::BIGINT, n, NULL::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, true FROM {photos} WHERE i = 1
  UNION ALL SELECT p.well, p.i, p.n, p.photo, q.base, s.k + CASE WHEN q.base = r.cb THEN 1 ELSE 0 END, q.top, q.base, s.k,
    p.cap > 0 AND greatest(s.reached, r.ct) + p.cap <= r.cb + 2 AND q.base > q.top
  FROM {name} s JOIN {photos} p ON p.well = s.well AND p.i = s.i + 1 JOIN {cores} r ON r.well = s.well AND r.k = s.k,
  LATERAL (SELECT greatest(s.reached, r.ct) AS top, CASE WHEN r.cb - (greatest(s.reached, r.ct) + p.cap) <= 2 THEN r.cb ELSE greatest(s.reached, r.ct) + p.cap END AS base) q WHERE s.fits)"""


#: The stages one after another; ``s1`` has wells, ``s2`` lost its foreign file names, and so on.
STAGES_SQL = f"""WITH RECURSIVE {INFER_SQL},
 s1 AS (SELECT raw.* REPLACE (coalesce((SELECT arg_max(w, struct_pack(l := length(w), w := w)) FROM (SELECT DISTINCT well AS w FROM cr) WHERE contains(raw.well || raw.name, w)), raw.well) AS well) FROM raw),
 foreign_names AS (SELECT photo FROM s1 WHERE source = 'filename' AND top IS NOT NULL AND EXISTS (SELECT 1 FROM cr WHERE cr.well = s1.well)
   AND NOT EXISTS (SELECT 1 FROM cr WHERE cr.well = s1.well AND (least(s1.base, cb) > greatest(s1.top, ct) OR least(s1.base, cb + 500000) > greatest(s1.top, ct + 500000)))),
 s2 AS (SELECT s1.* REPLACE (CASE WHEN lost THEN NULL ELSE top END AS top, CASE WHEN lost THEN NULL ELSE base END AS base, CASE WHEN lost THEN 'not_found' ELSE source END AS source, confirmed AND NOT lost AS confirmed)
   FROM (SELECT s1.*, photo IN (SELECT photo FROM foreign_names) AS lost FROM s1) s1),
 able AS (SELECT well FROM s2 WHERE well <> '' GROUP BY well HAVING bool_and(basis <> 'gis' AND cap > 0 AND (source NOT IN ('legacy', 'manual') OR (source = 'manual' AND confirmed AND top IS NOT NULL)))),
 p3 AS (SELECT well, photo, cap, row_number() OVER (PARTITION BY well ORDER BY pos, photo) AS i, count(*) OVER (PARTITION BY well) AS n FROM s2 WHERE well IN (SELECT well FROM able) AND well IN (SELECT well FROM cr)),
 {packing_sql("pk3", "p3", "core")},
 full3 AS (SELECT pk3.well FROM pk3 JOIN (SELECT DISTINCT well, cores FROM core) x USING (well) WHERE i = n AND fits AND k = cores),
 canon AS (SELECT photo, arg_min(struct_pack(ct := ct, cb := cb), struct_pack(e := abs(top - ct) + abs(base - cb), ct := ct, cb := cb)) AS m FROM s2 JOIN cr USING (well)
   WHERE top IS NOT NULL AND abs(top - ct) <= 100 AND abs(base - cb) <= 100 AND (base - top) / (cb - ct)::DOUBLE >= 0.65 GROUP BY photo),
 judged AS (SELECT s2.well, s2.photo, pk3.top AS pt, pk3.base AS pb, s2.label_top, s2.source, coalesce(
   abs(label_top - pk3.top) > 2 OR abs(label_base - pk3.base) > 2, false) OR coalesce(source IN ('filename', 'manual') AND confirmed AND (abs(s2.top - pk3.top) > 2 OR abs(s2.base - pk3.base) > 2), false)
   OR coalesce(source IN ('ocr', 'ocr_verified') AND confirmed AND s2.top IS NOT NULL AND (coalesce(m.ct <> ct OR m.cb <> cb, false)
     OR (NOT coalesce(abs(s2.top - m.ct) <= 2 AND abs(s2.base - m.cb) <= 2, false) AND (abs(s2.top - pk3.top) > 2 OR abs(s2.base - pk3.base) > 2))), false) AS bad
   FROM pk3 JOIN s2 USING (photo) JOIN core ON core.well = pk3.well AND core.k = pk3.core LEFT JOIN canon USING (photo) WHERE pk3.well IN (SELECT well FROM full3)),
 put3 AS (SELECT photo, pt, pb FROM judged WHERE well NOT IN (SELECT well FROM judged WHERE bad) AND label_top IS NULL AND source <> 'manual'),
 s3 AS (SELECT s2.* REPLACE (coalesce(pt, top) AS top, coalesce(pb, base) AS base, CASE WHEN pt IS NULL THEN source ELSE 'excel_sequenced' END AS source, confirmed OR pt IS NOT NULL AS confirmed) FROM s2 LEFT JOIN put3 USING (photo)),
 g4 AS (SELECT photo, well, m.ct AS ct, m.cb AS cb, cap, sum(cap) OVER (PARTITION BY well, m.ct, m.cb) AS s, m.ct + coalesce(sum(cap) OVER (PARTITION BY well, m.ct, m.cb ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st
   FROM s3 JOIN canon USING (photo) WHERE source IN ('ocr', 'ocr_verified') AND top IS NOT NULL AND label_top IS NULL AND basis <> 'gis'),
 s4 AS (SELECT s3.* REPLACE (CASE WHEN ct IS NULL THEN top WHEN s > cb - ct + 2 THEN NULL WHEN st >= cb THEN top ELSE st END AS top, CASE WHEN ct IS NULL THEN base WHEN s > cb - ct + 2 THEN NULL WHEN st >= cb THEN base ELSE least(cb, st + g4.cap) END AS base,
   CASE WHEN ct IS NULL THEN source WHEN s > cb - ct + 2 THEN 'ocr_not_found' WHEN st >= cb THEN 'ocr_columns_not_found' ELSE 'ocr_sequenced' END AS source, CASE WHEN ct IS NULL THEN confirmed ELSE s <= cb - ct + 2 AND st < cb AND abs(s - (cb - ct)) <= 2 END AS confirmed)
   FROM s3 LEFT JOIN (SELECT photo, ct, cb, cap, s, st FROM g4) g4 USING (photo)),
 free AS (SELECT well, ct, cb FROM cr WHERE NOT EXISTS (SELECT 1 FROM s4 WHERE s4.well = cr.well AND s4.base > ct AND s4.top < cb)),
 cand AS (SELECT photo, pos, cap, count(*) AS n, min(free.well) AS w, min(ct) AS ct, min(cb) AS cb FROM s4 JOIN free ON contains(s4.name, free.well) WHERE s4.top IS NULL AND basis <> 'gis' GROUP BY photo, pos, cap),
 put5 AS (SELECT w, ct, cb, arg_min(photo, (pos, photo)) AS photo FROM cand WHERE n = 1 AND abs(cap - (cb - ct)) <= 2 GROUP BY w, ct, cb),
 s5 AS (SELECT s4.* REPLACE (coalesce(w, well) AS well, coalesce(ct, top) AS top, coalesce(cb, base) AS base, CASE WHEN w IS NULL THEN source ELSE 'excel_suggestion' END AS source) FROM s4 LEFT JOIN put5 USING (photo)),
 left6 AS (SELECT *, row_number() OVER (PARTITION BY well ORDER BY ct, cb) - 1 AS k, count(*) OVER (PARTITION BY well) AS cores FROM (SELECT well, ct, cb FROM free EXCEPT SELECT w, ct, cb FROM put5)),
 p6 AS (SELECT well, photo, cap, row_number() OVER (PARTITION BY well ORDER BY pos, photo) AS i, count(*) OVER (PARTITION BY well) AS n FROM s5 WHERE top IS NULL AND basis <> 'gis' AND well IN (SELECT well FROM left6)),
 {packing_sql("pk6", "p6", "left6")},
 full6 AS (SELECT pk6.well FROM pk6 JOIN (SELECT DISTINCT well, cores FROM left6) x USING (well) WHERE i = n AND fits AND k = cores),
 s6 AS (SELECT s5.* REPLACE (coalesce(q.top, s5.top) AS top, coalesce(q.base, s5.base) AS base, CASE WHEN q.photo IS NULL THEN source ELSE 'excel_sequenced' END AS source, confirmed OR q.photo IS NOT NULL AS confirmed)
   FROM s5 LEFT JOIN (SELECT photo, top, base FROM pk6 WHERE i > 0 AND well IN (SELECT well FROM full6)) q USING (photo))
"""


def _told(stage: str) -> str:
    return STAGES_SQL + f"SELECT photo, well, CAST(top AS BIGINT) AS top_cm, CAST(base AS BIGINT) AS base_cm, source, confirmed FROM {stage}"


INFERRED = ("photo", "well", "top_cm", "base_cm", "source", "confirmed")


def staged(photos: DataFrame, rows: DataFrame, upto: int) -> tuple[DataFrame, DataFrame]:
    """The input after the first ``upto`` stages, each as a table of its own."""
    rows = settled(rows)
    steps = [lambda p: J.resolve_wells(p, rows.select(F.col("well").alias("key"))), lambda p: K.drop_foreign_ranges(p, rows), lambda p: K.sequence_whole_wells(p, rows), lambda p: K.share_captions(p, rows)]
    photos = settled(photos)
    for step in steps[:upto]:
        before, photos = photos, settled(step(photos))
        unsettle(before)
    return photos, rows


@query("P9_resolved_wells", _told("s1"))
def stage_wells(t: Tables) -> DataFrame:
    photos, rows = inferred(t)
    rows = settled(rows)
    return J.resolve_wells(photos, rows.select(F.col("well").alias("key"))).select(*INFERRED)


@query("P9_foreign_file_names", _told("s2"))
def stage_names(t: Tables) -> DataFrame:
    photos, rows = inferred(t)
    return K.drop_foreign_ranges(*staged(photos, rows, 1)).select(*INFERRED)


@query("P4_anchored_wells", _told("s3"))
def stage_sequences(t: Tables) -> DataFrame:
    photos, rows = inferred(t)
    return K.sequence_whole_wells(*staged(photos, rows, 2)).select(*INFERRED)


@query("P5_shared_captions", _told("s4"))
def stage_captions(t: Tables) -> DataFrame:
    photos, rows = inferred(t)
    return K.share_captions(*staged(photos, rows, 3)).select(*INFERRED)


@query("P9_named_ranges", STAGES_SQL + "SELECT photo, w AS well, ct AS top_cm, cb AS base_cm FROM put5")
def stage_claims(t: Tables) -> DataFrame:
    photos, rows = inferred(t)
    placed, rows = staged(photos, rows, 4)
    return K.claim_named_ranges(placed.filter("top_cm IS NULL AND depth_basis <> 'gis'"), K.open_ranges(rows, placed))


@query("P9_inference_stages", _told("s6"))
def stages(t: Tables) -> DataFrame:
    photos, rows = inferred(t)
    return K.infer_intervals(photos, rows).select(*INFERRED)


@query("P10_projection_audit", """
WITH p AS (SELECT photo, top_cm AS t, 100 * (1 + photo % 5) AS span, photo % 7 AS bad FROM photos)
SELECT photo, problem FROM (SELECT photo, CASE WHEN bad = 1 THEN ['column without depth', 'columns leave gaps'] WHEN bad = 2 THEN ['mask outside its column', 'metres and pixels disagree'] WHEN bad = 3 THEN ['mask too narrow'] WHEN bad = 4 THEN ['metres and pixels disagree', 'column not fully described']
  WHEN bad = 5 THEN ['mask off the core', 'column not fully described'] WHEN bad = 6 THEN ['column outside the photo', 'column not fully described', 'metres and pixels disagree'] END AS ps, bad, span FROM p) z, unnest(ps) AS u(problem) WHERE NOT (bad = 1 AND false)""")
def projection_audit(t: Tables) -> DataFrame:
    """One column and one mask per photo, broken in a way that depends on the photo."""
    p = t.photos().select("photo", "top_cm", "base_cm", (F.col("photo") % 7).alias("bad"))
    bad = lambda n: F.col("bad") == n
    cols = p.select(
        "photo", F.lit(0).alias("col"), F.lit(10).alias("left"), F.lit(0).alias("top"), F.lit(110).alias("right"), F.lit(500).alias("bottom"),
        F.when(~bad(1), F.col("top_cm")).alias("top_cm"), F.when(~bad(1), F.col("base_cm") + F.when(bad(6), 50).otherwise(0)).alias("base_cm"))
    masks = p.filter("bad <> 1").select(
        "photo", F.lit("m").alias("mask"), F.when(bad(5), 300).otherwise(20).alias("m_left"), F.when(bad(5), 400).when(bad(3), 40).otherwise(100).alias("m_right"),
        F.lit(0).alias("m_top"), F.when(bad(2), 600).otherwise(500).alias("m_bottom"), "top_cm", (F.col("base_cm") - F.when(bad(4), 30).otherwise(0)).alias("base_cm"), F.lit(True).alias("told"))
    return K.projection_problems(p, cols, masks)


@query("P11_over_capacity", "SELECT photo, base_cm - top_cm AS span_cm FROM photos WHERE base_cm - top_cm > 50 * (photo % 8) + 2")
def over_capacity(t: Tables) -> DataFrame:
    caps = t.photos().select("photo", (50 * (F.col("photo") % 8)).alias("capacity_cm"))
    return K.over_capacity(t.photos(), caps).select("photo", (F.col("base_cm") - F.col("top_cm")).alias("span_cm"))


@query("P15_photo_capacity", """
SELECT photo, CAST(CASE WHEN count(CASE WHEN conf % 4 <> 0 THEN 1 END) = count(*) THEN sum(greatest(0, conf - 92)) ELSE sum(bottom - top) END AS BIGINT) AS capacity_cm FROM detections GROUP BY photo""")
def photo_capacity(t: Tables) -> DataFrame:
    read = F.col("conf") % 4 != 0
    cols = t.detections().select("photo", F.when(read, F.lit(92)).alias("label_top_cm"), F.when(read, F.col("conf")).alias("label_base_cm"), (F.col("bottom") - F.col("top")).alias("capacity_cm"))
    return K.photo_capacity(cols)


@query("A14_polygon_depth_sync", """
SELECT photo, det, CASE WHEN top >= 20 AND top <= 320 THEN round_even((100000 + (top - 20) * 600 / 300.0::DOUBLE) / 100.0::DOUBLE, 3) END AS depth_from,
  CASE WHEN bottom >= 20 AND bottom <= 320 THEN round_even((100000 + (bottom - 20) * 600 / 300.0::DOUBLE) / 100.0::DOUBLE, 3) END AS depth_to,
  CASE WHEN 100000 + conf BETWEEN 100000 AND 100600 THEN 20 + conf * 300 / 600.0::DOUBLE END AS row_from FROM detections""")
def depth_sync(t: Tables) -> DataFrame:
    d = t.detections().select("photo", "det", F.col("top").alias("y0"), F.col("bottom").alias("y1"), (100000 + F.col("conf")).alias("top_cm"), F.lit(100600).alias("base_cm"),
                              F.lit(20).alias("seg_top"), F.lit(320).alias("seg_bottom"), F.lit(100000).alias("seg_top_cm"), F.lit(100600).alias("seg_base_cm"))
    return K.sync_depths(d).select("photo", "det", "depth_from", "depth_to", "row_from")


@query("A17_texture_rows", """
SELECT photo, det, round_even((1000 * v.c + (top - 0) * 100 / 400.0::DOUBLE) / 100.0::DOUBLE, 3) AS depth_from, round_even((1000 * v.c + (bottom - 0) * 100 / 400.0::DOUBLE) / 100.0::DOUBLE, 3) AS depth_to
FROM detections JOIN (VALUES (0, 0, 90), (1, 90, 180), (2, 180, 400)) v(c, l, r) ON "left" >= l AND "left" < r""")
def texture(t: Tables) -> DataFrame:
    from depthlake.plans.box_queries import lanes

    seg = lanes(t).withColumns({"top_cm": 1000 * F.col("col"), "base_cm": 1000 * F.col("col") + 100})
    return K.texture_rows(t.detections().select("photo", "det", *B.BOX), seg).select("photo", "det", "depth_from", "depth_to")


@query("S9_discarded_filename_spans", """
WITH w AS (SELECT DISTINCT well FROM layers), p AS (SELECT *, photo % 2 = 0 AS named FROM photos), x AS (SELECT p.*, named AND p.well IN (SELECT well FROM w) AND NOT EXISTS (SELECT 1 FROM layers l WHERE l.well = p.well AND l.base_cm > p.top_cm AND l.top_cm < p.base_cm) AS lost FROM p)
SELECT photo, CASE WHEN NOT lost THEN top_cm END AS top_cm, CASE WHEN lost THEN 'not_found' WHEN named THEN 'filename' ELSE 'ocr' END AS source, confirmed AND NOT lost AS confirmed FROM x""")
def discarded(t: Tables) -> DataFrame:
    p = t.photos().withColumn("source", F.when(F.col("photo") % 2 == 0, "filename").otherwise("ocr"))
    return J.discard_outside(p, t.layers().select("well", "top_cm", "base_cm")).select("photo", "top_cm", "source", "confirmed")
