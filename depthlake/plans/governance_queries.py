"""Queries for labelled samples, splits, reports, catalogs and record files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from depthlake.functions import geometry as G
from depthlake.operators import boxes as B, governance as V, reports as R
from depthlake.operators.scan import numbered
from depthlake.plans.match_queries import PAIRED, asked_photos, matches, two_systems
from depthlake.plans.proxies import Tables
from depthlake.plans.registry import query
from depthlake.sources import listing as LS, records as RC, sinks as SK
from depthlake.streaming import arrivals as AR


@query("G1_components", """
WITH RECURSIVE e AS (SELECT a.photo AS x, b.photo AS y FROM records a JOIN (SELECT hash, min(photo) AS photo FROM records GROUP BY hash) b USING (hash)
   UNION SELECT a.photo, b.photo FROM records a JOIN (SELECT well, n_chars % 50 AS g, min(photo) AS photo FROM records GROUP BY ALL) b ON a.well = b.well AND a.n_chars % 50 = b.g),
 s AS (SELECT x, y FROM e UNION SELECT y, x FROM e), r AS (SELECT photo AS n, photo AS c FROM records UNION SELECT s.y, r.c FROM r JOIN s ON s.x = r.n)
SELECT n AS photo, min(c) AS component FROM r GROUP BY n""")
def components(t: Tables) -> DataFrame:
    rows = t.records().withColumn("group", F.concat_ws("/", "well", (F.col("n_chars") % 50).cast("string")))
    return V.components(rows, "photo", ["hash", "group"])


@query("L1_group_holdout")
def holdout(t: Tables) -> DataFrame:
    return V.greedy_holdout(t.records(), "well", "label")


@query("L1_hash_holdout")
def hash_holdout(t: Tables) -> DataFrame:
    return V.greedy_holdout(t.records(), "hash", "label")


@query("L2_split_strategy")
def strategy(t: Tables) -> DataFrame:
    marked, name = V.assign_splits(t.records())
    return marked.select("photo", "split", F.lit(name).alias("strategy"))


@query("L3_component_holdout", """
WITH RECURSIVE v AS (SELECT photo, concat_ws('/', well, n_chars % 3) AS place, hash, label FROM records),
 e AS (SELECT a.photo AS x, b.photo AS y FROM v a JOIN (SELECT hash, min(photo) AS photo FROM v GROUP BY hash) b USING (hash)
   UNION SELECT a.photo, b.photo FROM v a JOIN (SELECT place, min(photo) AS photo FROM v GROUP BY place) b USING (place)),
 s AS (SELECT x, y FROM e UNION SELECT y, x FROM e), r AS (SELECT photo AS n, photo AS c FROM v UNION SELECT s.y, r.c FROM r JOIN s ON s.x = r.n),
 parts AS (SELECT 'well' AS strategy, n AS photo, min(c) AS part FROM r GROUP BY n
   UNION ALL SELECT 'photo_fallback', v.photo, f.photo FROM v JOIN (SELECT hash, min(photo) AS photo FROM v GROUP BY hash) f USING (hash)),
 emptied AS (SELECT DISTINCT strategy, part FROM (SELECT strategy, part, label, count(*) AS n FROM parts JOIN v USING (photo) GROUP BY ALL) i JOIN (SELECT label, count(*) AS total FROM v GROUP BY label) USING (label) WHERE n >= total),
 goal AS (SELECT greatest(1, CAST(round_even(count(*) * 0.2, 0) AS BIGINT)) AS goal FROM v),
 sizes AS (SELECT strategy, part, count(*) AS size FROM parts GROUP BY ALL),
 fit AS (SELECT sizes.* FROM sizes ANTI JOIN emptied USING (strategy, part)),
 best AS (SELECT strategy, arg_min(part, struct_pack(d := abs(size - goal), s := size, c := part)) AS part FROM fit, goal GROUP BY strategy),
 chosen AS (SELECT max(strategy) AS strategy FROM best)
SELECT photo, CASE WHEN parts.part = best.part THEN 'val' ELSE 'train' END AS split, strategy FROM parts JOIN best USING (strategy) WHERE strategy = (SELECT strategy FROM chosen)""")
def component_holdout(t: Tables) -> DataFrame:
    split, name = V.component_holdout(t.records().withColumn("well", F.concat_ws("/", "well", (F.col("n_chars") % 3).cast("string"))))
    return split.withColumn("strategy", F.lit(name))


BALANCE = """
 tr AS (SELECT photo, label || CASE WHEN photo % 9 = 0 THEN 'r' ELSE '' END AS label FROM records WHERE photo % 5 <> 0), c AS (SELECT label, count(*) AS n FROM tr GROUP BY label),
 w AS (SELECT label, n, greatest(0, least(3 * n, CAST(ceil(sqrt((SELECT max(n) FROM c) * n)) AS BIGINT)) - n) AS want FROM c),
 a AS (SELECT label, n, greatest(0, least(want, (SELECT sum(n) FROM c) - coalesce(sum(want) OVER (ORDER BY n, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS adds FROM w)"""


@query("L4_bounded_balance", f"""
WITH {BALANCE}, i AS (SELECT photo, tr.label, n, adds, row_number() OVER (PARTITION BY tr.label ORDER BY photo) AS i FROM tr JOIN a ON a.label = tr.label)
SELECT photo, label, unnest(range(0, 1 + CAST(adds // n AS BIGINT) + CASE WHEN i <= adds % n THEN 1 ELSE 0 END)) AS copy FROM i""")
def balance(t: Tables) -> DataFrame:
    label = F.concat("label", F.when(F.col("photo") % 9 == 0, "r").otherwise(""))
    train = t.records().filter("photo % 5 <> 0").select("photo", label.alias("label"))
    return V.balance(train, ["photo"])


@query("L5_leaked_hashes", "SELECT hash FROM records GROUP BY hash HAVING bool_or(photo % 5 = 0) AND bool_or(photo % 5 <> 0)")
def leaked(t: Tables) -> DataFrame:
    return V.leaked(t.records().withColumn("split", F.when(F.col("photo") % 5 == 0, "val").otherwise("train")))


REG = "reg AS (SELECT DISTINCT p_type || '@' || p_brand AS label FROM part)"


def registry(t: Tables) -> DataFrame:
    return R.class_ids(t.part.select(F.concat_ws("@", "p_type", "p_brand").alias("label")))


@query("L6_registry_differences", f"""
WITH {REG}, i AS (SELECT row_number() OVER (ORDER BY lower(label), label) - 1 AS class_id, label FROM reg)
SELECT class_id, label, 'ours' AS side FROM i WHERE class_id % 10 = 3 UNION ALL SELECT class_id + 1000, label, 'theirs' FROM i WHERE class_id % 10 = 3""")
def registry_differences(t: Tables) -> DataFrame:
    ours = registry(t)
    theirs = ours.withColumn("class_id", F.col("class_id") + F.when(F.col("class_id") % 10 == 3, 1000).otherwise(0))
    return V.registry_differences(ours, theirs)


@query("L6_registry_digest", f"""
WITH {REG}, i AS (SELECT row_number() OVER (ORDER BY lower(label), label) - 1 AS class_id, label FROM reg)
SELECT sha256('[' || string_agg('{{"id":' || class_id || ',"label":"' || label || '"}}', ',' ORDER BY class_id) || ']') AS digest, count(*) AS classes FROM i""")
def registry_digest(t: Tables) -> DataFrame:
    return V.registry_digest(registry(t))


@query("L7_caption_rows", """
SELECT photo, det, CASE WHEN conf % 4 = 0 THEN CAST(top AS DOUBLE) ELSE top + 0.5 END AS interval_top, CAST(bottom AS DOUBLE) AS interval_base,
  greatest(0.0, bottom - CASE WHEN conf % 4 = 0 THEN CAST(top AS DOUBLE) ELSE top + 0.5 END) AS thickness FROM detections WHERE reviewed AND conf % 7 <> 0""")
def caption_rows(t: Tables) -> DataFrame:
    d = t.detections().select(
        "photo", "det", F.col("reviewed").alias("approved"), F.when(F.col("conf") % 7 != 0, "text").alias("target_text"), F.col("top").alias("depth_top"), F.col("bottom").alias("depth_base"),
        F.when(F.col("conf") % 4 == 0, "n/a").otherwise(F.concat(F.col("top"), F.lit(",5"))).alias("facies_top"), F.lit(None).cast("string").alias("facies_base"))
    return V.caption_rows(d).select("photo", "det", "interval_top", "interval_base", "thickness")


@query("N13_class_statistics", """
SELECT lower(p_type) AS class_key, count(*) AS mask_count, count(*) FILTER (WHERE p_size % 3 <> 0) AS description_count, count(DISTINCT lower(p_brand)) AS names, count(DISTINCT lower(p_brand)) > 1 AS conflict FROM part GROUP BY ALL""")
def class_statistics(t: Tables) -> DataFrame:
    rows = t.part.select(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_type")).alias("facies_index"), F.lower("p_type").alias("label"), F.col("p_brand").alias("facies_name"),
                         F.when(F.col("p_size") % 3 != 0, "text").alias("target_text"))
    return V.class_statistics(rows)


@query("N14_top_texts", """
WITH c AS (SELECT p_type AS label, p_name AS text, count(*) AS times, min(p_partkey) AS f FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY times DESC, f) AS place FROM c)
SELECT label, place, text, times FROM r WHERE place <= 5""")
def top_texts(t: Tables) -> DataFrame:
    return V.top_texts(t.part.select(F.col("p_type").alias("label"), F.col("p_name").alias("text"), "p_partkey"), "label", "text", "p_partkey")


SPLIT = "sp AS (SELECT *, CASE WHEN photo % 5 = 0 AND label <> 'en' THEN 'val' ELSE 'train' END AS split FROM records)"


def split_records(t: Tables) -> DataFrame:
    return t.records().withColumn("split", F.when((F.col("photo") % 5 == 0) & (F.col("label") != "en"), "val").otherwise("train"))


def langs(t: Tables) -> DataFrame:
    """Registry of the labels in the table and one more that has no samples."""
    names = t.records().select("label").distinct()
    return names.unionByName(names.select(F.concat("label", F.lit("-x")).alias("label")).agg(F.min("label").alias("label")))


@query("N15_preflight", f"""
WITH {SPLIT}, reg AS (SELECT DISTINCT label FROM records UNION SELECT min(label) || '-x' FROM records)
SELECT reg.label, count(sp.photo) AS samples, count(sp.photo) FILTER (WHERE split = 'train') AS train, count(sp.photo) FILTER (WHERE split = 'val') AS val, count(sp.photo) = 0 AS missing,
  count(sp.photo) FILTER (WHERE split = 'train') > 0 AND count(sp.photo) FILTER (WHERE split = 'val') = 0 AS unvalidated FROM reg LEFT JOIN sp ON sp.label = reg.label GROUP BY reg.label""")
def preflight(t: Tables) -> DataFrame:
    return V.preflight(split_records(t), langs(t))


@query("N15_preflight_findings", """
WITH c AS (SELECT label, count(*) AS n FROM records GROUP BY label)
SELECT 'warning' AS kind, 'class imbalance' AS finding FROM c HAVING max(n) > 5 * min(n) UNION ALL SELECT 'warning', 'classes without samples' UNION ALL SELECT 'warning', 'classes without validation'""")
def findings(t: Tables) -> DataFrame:
    return V.preflight_findings(V.preflight(split_records(t), langs(t)))


@query("N16_label_quality", """
WITH d AS (SELECT *, CASE WHEN label = 'RF' THEN '' ELSE label END AS name FROM detections WHERE reviewed), n AS (SELECT name, count(*) AS n FROM d WHERE name <> '' GROUP BY name),
 dup AS (SELECT DISTINCT a.photo, a.det FROM d a JOIN d b ON a.photo = b.photo AND a.label = b.label AND b.det < a.det AND a."left" < b."right" AND b."left" < a."right" AND a.top < b.bottom AND b.top < a.bottom
   AND (least(a."right", b."right") - greatest(a."left", b."left")) * (least(a.bottom, b.bottom) - greatest(a.top, b.top)) >= 0.9 * ((a."right" - a."left") * (a.bottom - a.top) + (b."right" - b."left") * (b.bottom - b.top)
   - (least(a."right", b."right") - greatest(a."left", b."left")) * (least(a.bottom, b.bottom) - greatest(a.top, b.top))))
SELECT count(*) FILTER (WHERE name <> '') AS verified, count(*) FILTER (WHERE name = '') AS unnamed, count(*) FILTER (WHERE name <> '' AND conf % 10 = 0) AS missing_depth, count(*) FILTER (WHERE name <> '' AND bottom - top < 5) AS too_small,
  0 AS too_large, (SELECT count(*) FROM n WHERE n < 5) AS underrepresented, (SELECT count(*) > 1 AND sum(n) >= 12 AND max(n) >= 4 * min(n) FROM n) AS severe_imbalance, (SELECT count(*) FROM dup) AS duplicates FROM d""")
def quality(t: Tables) -> DataFrame:
    d = t.detections().filter("reviewed")
    dup = B.near_duplicates(d.select("photo", "det", *B.BOX, "label"), "det")
    rows = d.select(F.when(F.col("label") == "RF", "").otherwise(F.col("label")).alias("label"), (F.col("conf") % 10 != 0).alias("has_depth"), F.when(F.col("bottom") - F.col("top") < 5, "small").alias("size_kind"))
    return V.quality_summary(rows, dup)


@query("N18_epoch_recommendation", """
WITH f AS (SELECT l_suppkey AS well, count(*) AS masks, count(DISTINCT l_orderkey) AS photos, count(DISTINCT l_returnflag || l_linestatus) AS classes FROM lineitem GROUP BY l_suppkey),
 g AS (SELECT *, CASE WHEN masks < 20 THEN 60 WHEN masks < 50 THEN 50 WHEN masks < 100 THEN 40 WHEN masks < 250 THEN 32 ELSE 24 END + least(15, greatest(0, classes - 2) * 2)
   + CASE WHEN photos <= 1 THEN -15 WHEN photos <= 3 THEN -8 WHEN photos >= 10 THEN 5 ELSE 0 END + CASE WHEN masks * 1.0 / photos >= 8 THEN -5 ELSE 0 END - CASE WHEN well % 7 IN (1, 2) THEN 5 ELSE 0 END + CASE WHEN well % 3 = 1 THEN 6 ELSE 0 END AS e FROM f),
 h AS (SELECT *, CAST(5 * round_even(greatest(15, least(100, e)) / 5.0::DOUBLE, 0) AS BIGINT) AS r FROM g),
 k AS (SELECT *, CASE WHEN photos < 4 OR well % 7 < 3 THEN 'low' WHEN photos < 10 OR well % 7 < 5 OR well % 3 = 2 THEN 'medium' ELSE 'high' END AS c FROM h)
SELECT well, r AS recommended_epochs, c AS confidence, CAST(least(150, r + CASE WHEN c = 'low' THEN 15 ELSE greatest(15, CAST(5 * round_even(r * 0.35::DOUBLE / 5.0::DOUBLE, 0) AS BIGINT)) END) AS BIGINT) AS max_epochs, CAST(greatest(8, least(20, round_even(r * 0.25::DOUBLE, 0))) AS BIGINT) AS patience FROM k""")
def epochs(t: Tables) -> DataFrame:
    per = t.lineitem.groupBy(F.col("l_suppkey").alias("well")).agg(
        F.count(F.lit(1)).alias("masks"), F.countDistinct("l_orderkey").alias("photos"), F.countDistinct(F.concat("l_returnflag", "l_linestatus")).alias("classes"))
    facts = per.select("*", F.lit(1).alias("wells"), (F.col("well") % 7).alias("min_class"), F.lit(2).alias("min_class_photos"), F.when(F.col("well") % 3 != 2, F.col("well") % 3).alias("new_classes"),
                       F.lit(0).alias("suspicious"), F.lit(False).alias("severe_imbalance"))
    return V.recommend_epochs(facts).select("well", "recommended_epochs", "confidence", "max_epochs", "patience")


@query("N19_dataset_warnings", """
WITH f AS (SELECT l_suppkey AS well, count(*) AS m, count(DISTINCT l_orderkey) AS p FROM lineitem GROUP BY l_suppkey)
SELECT well, w AS warning FROM f, unnest([CASE WHEN p < 20 THEN 'few photos' END, CASE WHEN m < greatest(40, well * 10) THEN 'few masks' END, CASE WHEN p - 5 < 10 THEN 'small split' END, CASE WHEN well < 10 THEN 'sparse classes' END,
  CASE WHEN well > 1 AND m >= 5 * well THEN 'class imbalance' END, CASE WHEN well % 2 = 0 THEN 'split not by well' END, CASE WHEN well % 3 = 0 THEN 'synthetic well names' END]) AS u(w) WHERE w IS NOT NULL""")
def warnings(t: Tables) -> DataFrame:
    per = t.lineitem.groupBy(F.col("l_suppkey").alias("well")).agg(F.count(F.lit(1)).alias("masks"), F.countDistinct("l_orderkey").alias("photos"))
    facts = per.select("*", F.col("well").alias("classes"), (F.col("photos") - 5).alias("train_photos"), F.lit(5).alias("val_photos"), F.col("well").alias("min_class"), F.col("masks").alias("max_class"),
                       F.when(F.col("well") % 2 == 0, "photo").otherwise("well").alias("split_strategy"), (F.col("well") % 3 == 0).alias("synthetic_wells"))
    return V.dataset_warnings(facts, keys=["well"])


@query("N20_report_blockers", """
WITH r AS (SELECT l_suppkey AS well, count(*) FILTER (WHERE l_discount > 0.09) AS projection_errors, count(*) FILTER (WHERE l_quantity < 2) AS photos_without_masks, count(*) AS annotations, count(*) FILTER (WHERE l_tax > 0) AS approved, count(*) FILTER (WHERE l_linenumber = 7) AS errs FROM lineitem GROUP BY l_suppkey),
 b AS (SELECT well, 'projection_errors' AS blocker, projection_errors AS amount FROM r WHERE projection_errors > 0 UNION ALL SELECT well, 'photos_without_masks', photos_without_masks FROM r WHERE photos_without_masks > 0 UNION ALL SELECT well, 'pending approvals', annotations - approved FROM r WHERE annotations > approved)
SELECT * FROM b UNION ALL SELECT well, 'other errors', errs FROM r WHERE errs > 0 AND well NOT IN (SELECT well FROM b)""")
def blockers(t: Tables) -> DataFrame:
    report = t.lineitem.groupBy(F.col("l_suppkey").alias("well")).agg(
        F.count_if(F.col("l_discount") > 0.09).alias("projection_errors"), F.count_if(F.col("l_quantity") < 2).alias("photos_without_masks"), F.count(F.lit(1)).alias("annotations"),
        F.count_if(F.col("l_tax") > 0).alias("approved_annotations"), F.count_if(F.col("l_linenumber") == 7).alias("blocking_errors"))
    return V.report_blockers(report, ["projection_errors", "photos_without_masks"], keys=["well"])


@query("N22_validation_report", """
WITH r AS (SELECT DISTINCT label FROM records UNION ALL SELECT 'absent'), m AS (SELECT label, avg(CASE WHEN reviewed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p, avg(CASE WHEN n_chars > 1000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS r FROM records GROUP BY label)
SELECT r.label, CASE WHEN p IS NULL THEN 'not_evaluated' ELSE 'evaluated' END AS status, CAST(floor(CASE WHEN p + m.r > 0 THEN 2 * p * m.r / (p + m.r) ELSE CASE WHEN p IS NOT NULL THEN 0 END END * 1000000 + 0.5) AS BIGINT) AS f1 FROM r LEFT JOIN m ON m.label = r.label""")
def validation(t: Tables) -> DataFrame:
    metrics = t.records().groupBy("label").agg(F.avg(F.when(F.col("reviewed"), 1.0).otherwise(0.0)).alias("precision"), F.avg(F.when(F.col("n_chars") > 1000, 1.0).otherwise(0.0)).alias("recall"))
    names = t.records().select("label").distinct()
    reg = names.unionByName(names.agg(F.max(F.lit("absent")).alias("label")))
    got = V.validation_report(reg, metrics)
    return got.select("label", "status", F.floor(F.col("f1") * 1000000 + 0.5).cast("bigint").alias("f1"))


@query("N24_duplicate_samples", """
WITH s AS (SELECT photo, hash, n_chars % 2 AS polygon, CASE WHEN photo % 7 = 0 THEN 'x' ELSE label END AS label, well FROM records),
 f AS (SELECT hash, polygon, min(photo) AS photo, arg_min(label, photo) AS label, arg_min(well, photo) AS w, count(*) AS copies, count(DISTINCT label) > 1 AS conflict FROM s GROUP BY ALL)
SELECT f.hash, f.polygon, f.photo, f.label, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.hash = f.hash AND s.polygon = f.polygon AND s.label = f.label AND s.well <> f.w) THEN '' ELSE f.w END AS well, copies, conflict FROM f""")
def duplicates(t: Tables) -> DataFrame:
    s = t.records().select("photo", "hash", (F.col("n_chars") % 2).alias("polygon"), F.when(F.col("photo") % 7 == 0, "x").otherwise(F.col("label")).alias("label"), "well")
    return V.unique_samples(s, "photo")


@query("N25_unique_annotations", """
WITH o AS (SELECT hash, label, photo, reviewed, row_number() OVER (PARTITION BY hash, label ORDER BY photo) AS rn FROM records) SELECT hash, label, photo, reviewed FROM o WHERE rn = 1""")
def unique_annotations(t: Tables) -> DataFrame:
    return V.unique_annotations(t.records().select("hash", "label", "photo", "reviewed"), ["hash", "label"], "photo")


@query("N28_tail_split", """
SELECT photo, CASE WHEN row_number() OVER (ORDER BY photo) <= count(*) OVER () - greatest(1, CAST(round_even(count(*) OVER () * 0.2, 0) AS BIGINT)) THEN 'train' ELSE 'val' END AS split FROM photos WHERE confirmed""")
def tail_split(t: Tables) -> DataFrame:
    return V.tail_split(t.photos().filter("confirmed").select("photo"), "photo")


@query("J8_restored_targets", """
WITH r AS (SELECT photo, label, count(*) OVER (PARTITION BY photo // 2) AS n FROM records)
SELECT d.photo, d.half, CASE WHEN n = 1 THEN lab END AS label, coalesce(n = 1, false) AS resolved FROM (SELECT photo, photo // 2 + photo % 3 * 1000000 AS half FROM records) d
LEFT JOIN (SELECT photo // 2 AS half, count(*) AS n, min(label) AS lab FROM records WHERE photo % 4 <> 1 GROUP BY ALL) s ON s.half = d.half""")
def restored(t: Tables) -> DataFrame:
    r = t.records()
    notes = r.select("photo", F.expr("photo div 2 + photo % 3 * 1000000").alias("half"), F.lit("stale").alias("label"))
    rows = r.filter("photo % 4 <> 1").select(F.expr("photo div 2").alias("half"), "label")
    return V.restore_targets(notes, rows, ["half"], ["label"])


@query("J9_carried_approvals", "SELECT photo, reviewed AND photo % 3 <> 0 AS approved FROM records")
def carried(t: Tables) -> DataFrame:
    r = t.records()
    cols = ["photo", "label", "well", "n_chars"]
    old = r.select("photo", F.when(F.col("photo") % 3 == 0, "changed").otherwise(F.col("label")).alias("label"), "well", "n_chars", F.col("reviewed").alias("approved"))
    return V.carry_approvals(r.select(*cols), old, cols).select("photo", "approved")


@query("T4_latest_snapshots", """
WITH e AS (SELECT o_custkey AS source, o_orderpriority AS signature, max(o_orderkey) AS stamp FROM orders GROUP BY ALL)
SELECT source, arg_max(signature, struct_pack(a := stamp, s := signature)) AS signature, max(stamp) AS confirmed_at FROM e WHERE source % 9 <> 0 GROUP BY source""")
def latest(t: Tables) -> DataFrame:
    e = entries(t)
    return V.latest_snapshots(e, e.filter("source % 9 = 0").select("source"))


def entries(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("source"), F.col("o_orderpriority").alias("signature"), F.col("o_orderkey").alias("confirmed_at"))


@query("T5_recovered_snapshots", """
WITH e AS (SELECT o_custkey AS source, o_orderpriority AS signature, max(o_orderkey) AS stamp FROM orders GROUP BY ALL)
SELECT source, arg_max(signature, struct_pack(a := stamp, s := signature)) AS signature, max(stamp) AS confirmed_at FROM e GROUP BY source""")
def recovered(t: Tables) -> DataFrame:
    e = entries(t).groupBy("source", "signature").agg(F.max("confirmed_at").alias("confirmed_at"))
    listed = e.filter("source % 2 = 0 OR signature < '3'")
    return V.recover_unlisted(listed, e, e.select("source").filter("source < 0"))


@query("T6_approved_snapshot", "SELECT photo, label, substr(hash, 1, 12) || '_' || photo AS stored_name FROM records WHERE reviewed")
def approved(t: Tables) -> DataFrame:
    r = t.records()
    notes, _ = V.approved_snapshot(r.select("photo", "label", F.col("reviewed").alias("approved")), r.select("photo", "hash"))
    return notes.select("photo", "label", "stored_name")


@query("T7_approval_updates", "SELECT photo, CASE WHEN photo % 4 = 0 THEN photo % 8 = 0 ELSE reviewed END AS approved FROM records")
def updates(t: Tables) -> DataFrame:
    r = t.records().select("photo", F.col("reviewed").alias("approved"))
    return V.apply_approvals(r, r.filter("photo % 4 = 0").select("photo", (F.col("photo") % 8 == 0).alias("approved")), "photo")


@query("T1_new_records", "SELECT photo, label FROM records WHERE photo % 6 = 0")
def new_records(t: Tables) -> DataFrame:
    r = t.records().select("photo", "label")
    return AR.new_records(r.filter("photo % 6 <> 0"), r, "photo")


@query("T8_stale_cache", "SELECT photo AS path, CASE WHEN photo % 5 = 0 THEN 'missing' ELSE 'changed' END AS change FROM records WHERE photo % 5 = 0 OR photo % 7 = 0")
def stale(t: Tables) -> DataFrame:
    from depthlake.operators.joins import snapshot_changes

    saved = t.records().select(F.col("photo").alias("path"), F.col("n_chars").alias("size"), F.lit(1).alias("mtime"))
    now = saved.filter("path % 5 <> 0").withColumn("mtime", F.when(F.col("path") % 7 == 0, 2).otherwise(1))
    return snapshot_changes(saved, now)


@query("T9_I13_merged_archives", """
WITH f AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY well, photo) = 1 AS kept FROM records) SELECT well AS archive, count(*) FILTER (WHERE kept) AS images, count(*) FILTER (WHERE NOT kept) AS duplicate_images FROM f GROUP BY well""")
def merged_archives(t: Tables) -> DataFrame:
    images = t.records().select(F.col("well").alias("archive"), F.col("photo").alias("pos"), "hash")
    return RC.merge_archives(images)[1]


@query("N10_import_summary", """
SELECT count(*) AS rows, count(DISTINCT well) AS wells, count(DISTINCT label) AS labels, (SELECT count(*) FROM (SELECT DISTINCT well, top_cm // 1000, top_cm // 1000 + 1 FROM layers)) AS core_intervals, count(*) FILTER (WHERE conf % 2 = 0) AS described FROM layers""")
def import_summary(t: Tables) -> DataFrame:
    core = F.expr("top_cm div 1000")
    return R.import_summary(t.layers().withColumns({"core_top_cm": core, "core_base_cm": core + 1, "description": F.when(F.col("conf") % 2 == 0, "text").otherwise(" ")}))


@query("N11_core_ranges", """
SELECT well, coalesce(min(CASE WHEN well % 2 = 0 THEN top_cm - 50 END), min(top_cm)) AS top_cm, coalesce(max(CASE WHEN well % 2 = 0 THEN base_cm + 50 END), max(base_cm)) AS base_cm FROM layers GROUP BY well""")
def core_ranges(t: Tables) -> DataFrame:
    even = F.col("well") % 2 == 0
    return R.core_ranges(t.layers().withColumns({"core_top_cm": F.when(even, F.col("top_cm") - 50), "core_base_cm": F.when(even, F.col("base_cm") + 50)}))


@query("N12_project_counters", f"""
WITH {PAIRED} SELECT (SELECT count(*) FROM photos) AS photos, (SELECT count(*) FROM photos WHERE confirmed) AS confirmed_photos, (SELECT count(*) FROM photos WHERE NOT confirmed) AS unconfirmed_photos, (SELECT count(*) FROM photos WHERE NOT confirmed) AS photos_without_intervals,
 (SELECT count(*) FROM layers) AS layers, (SELECT count(*) FROM layers WHERE conf % 4 <> 0) AS text_targets, (SELECT count(*) FROM layers WHERE conf % 4 = 0) AS layers_without_description, (SELECT count(*) FROM lay WHERE NOT valid) AS invalid_thickness_rows,
 (SELECT count(*) FROM matched) AS matches, (SELECT count(DISTINCT photo) FROM matched) AS photos_with_layers, (SELECT count(*) FROM matched WHERE basis = 'gis') AS gis_matches,
 (SELECT count(*) FROM detections) AS annotations, (SELECT count(*) FROM detections WHERE reviewed) AS approved_annotations, (SELECT count(DISTINCT photo) FROM detections) AS photos_with_masks,
 (SELECT count(*) FROM detections WHERE conf < 92) AS blocking_errors, (SELECT count(*) FROM detections WHERE conf >= 92) AS warnings""")
def counters(t: Tables) -> DataFrame:
    lay = two_systems(t).join(t.layers().select("layer_id", "conf").distinct(), "layer_id").withColumn("target_text", F.when(F.col("conf") % 4 != 0, "text").otherwise(""))
    d = t.detections()
    issues = d.select(F.when(F.col("conf") < 92, "error").otherwise("warning").alias("severity"))
    return R.project_counters(t.photos(), lay, matches(t), d.withColumn("approved", F.col("reviewed")), issues)


@query("N12_coverage_counters", """
WITH m AS (SELECT p.photo, l.layer_id, greatest(p.top_cm, l.top_cm) AS s, least(p.base_cm, l.base_cm) AS e, l.conf % 4 <> 0 AS described
   FROM photos p JOIN layers l ON p.well = l.well AND l.base_cm > p.top_cm AND l.top_cm < p.base_cm WHERE p.confirmed),
 h AS (SELECT photo, unnest([top_cm, base_cm]) AS y FROM photos WHERE confirmed AND base_cm > top_cm),
 a AS (SELECT photo, s, e FROM m UNION ALL SELECT photo, y, y FROM h), b AS (SELECT photo, s, e FROM m WHERE described UNION ALL SELECT photo, y, y FROM h),
 ga AS (SELECT s, max(e) OVER (PARTITION BY photo ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM a),
 gb AS (SELECT s, max(e) OVER (PARTITION BY photo ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM b),
 c AS (SELECT photo, bool_or(reviewed) AS verified FROM detections WHERE conf < 99 GROUP BY photo)
SELECT (SELECT count(*) FROM photos WHERE photo NOT IN (SELECT photo FROM c)) AS photos_without_core_columns, (SELECT count(*) FROM photos JOIN c USING (photo) WHERE verified) AS verified_column_photos,
 (SELECT count(*) FROM photos WHERE photo IN (SELECT photo FROM m)) AS photos_with_labels, (SELECT count(*) FROM photos WHERE photo NOT IN (SELECT photo FROM m)) AS photos_without_labels,
 (SELECT count(*) FROM photos WHERE photo NOT IN (SELECT photo FROM detections WHERE conf > 95)) AS photos_without_masks, (SELECT count(*) FROM photos WHERE photo % 3 < 2) AS sequenced_photos,
 (SELECT count(*) FROM layers WHERE layer_id NOT IN (SELECT layer_id FROM m)) AS layers_without_photo, (SELECT count(*) FROM detections WHERE conf > 95 AND reviewed) AS annotation_text_targets,
 (SELECT string_agg(label, ',' ORDER BY lower(label), label) FROM (SELECT DISTINCT label FROM detections WHERE conf > 95)) AS classes,
 (SELECT count(*) FROM ga WHERE s > prev) AS open_label_gaps, (SELECT count(*) FROM gb WHERE s > prev) AS open_description_gaps""")
def coverage_counters(t: Tables) -> DataFrame:
    from depthlake.operators import intervals as iv

    photos = t.photos().withColumn("source", F.element_at(F.array(*map(F.lit, ("verified", "ordered", "manual"))), (F.col("photo") % 3 + 1).cast("int")))
    right = t.layers().select("well", "layer_id", F.col("top_cm").alias("r_top_cm"), F.col("base_cm").alias("r_base_cm"), (F.col("conf") % 4 != 0).alias("described"))
    found = iv.overlap_join(photos.filter("confirmed").select("photo", "well", "top_cm", "base_cm"), right, ["well"])
    d = t.detections()
    masks = d.filter("conf > 95").withColumn("target_text", F.when(F.col("reviewed"), "text").otherwise(" "))
    return R.coverage_counters(photos, d.filter("conf < 99").select("photo", F.col("reviewed").alias("verified")), t.layers(), found, masks, sequenced=("verified", "ordered"))


@query("N21_catalog_overview", """
SELECT source AS project, count(*) AS masks, count(*) FILTER (WHERE quality = 1) AS approved, count(DISTINCT sha256(text)) AS photos, count(DISTINCT lang) AS classes, array_to_string(list_sort(list_distinct(list(lang))), ',') AS wells FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def overview(t: Tables) -> DataFrame:
    r = t.records().select(F.col("well").alias("project"), F.col("reviewed").alias("approved"), F.col("hash").alias("photo"), "label", F.col("label").alias("well"))
    got = R.catalog_overview(r.select("project").distinct(), r)
    return got.withColumn("wells", F.array_join("wells", ","))


@query("N23_training_history", "SELECT o_orderkey AS run, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS map FROM orders ORDER BY map DESC NULLS LAST, run")
def history(t: Tables) -> DataFrame:
    return R.training_history(t.orders.select(F.col("o_orderkey").alias("run"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("map")))


@query("N29_correlation_markers", """
WITH f AS (SELECT label || conf AS label, well, arg_min(conf + top_cm % 100, struct_pack(t := top_cm, i := layer_id)) AS ratio FROM layers WHERE conf % 3 = 0 AND well % 4 <> 1 GROUP BY ALL), a AS (SELECT label, avg(ratio) AS m FROM f GROUP BY label HAVING count(*) >= 2), w AS (SELECT DISTINCT well FROM layers)
SELECT a.label, w.well, CAST(floor(coalesce(ratio, m) * 1000 + 0.5) AS BIGINT) AS ratio, ratio IS NOT NULL AS observed FROM a CROSS JOIN w LEFT JOIN f ON f.label = a.label AND f.well = w.well""")
def markers(t: Tables) -> DataFrame:
    rows = t.layers().filter("conf % 3 = 0 AND well % 4 <> 1").select(
        F.concat("label", "conf").alias("label"), "well", (F.col("conf") + F.col("top_cm") % 100).alias("ratio"), F.struct("top_cm", "layer_id").alias("pos"))
    got = R.correlation_markers(rows, t.layers().select("well").distinct())
    return got.select("label", "well", F.floor(F.col("ratio") * 1000 + 0.5).cast("bigint").alias("ratio"), "observed")


@query("N30_archive_stage", """
SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'needs photos' WHEN s_suppkey % 2 = 0 AND s_nationkey % 2 = 0 THEN 'confirmed' WHEN s_suppkey % 2 = 0 AND s_nationkey % 3 = 0 THEN 'review masks' WHEN s_suppkey % 5 = 0 THEN 'error' ELSE 'new' END AS stage FROM supplier""")
def stage(t: Tables) -> DataFrame:
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    e = t.supplier.select("s_suppkey", F.when(key % 2 == 0, F.concat(F.lit("p"), nation)).otherwise("").alias("project"), F.when(key % 7 != 0, "dir").alias("photos"), F.when(key % 5 == 0, "bad").alias("error"))
    named = F.concat(F.lit("p"), nation).alias("project")
    return R.archive_stage(e, t.supplier.filter("s_nationkey % 2 = 0").select(named), t.supplier.filter("s_nationkey % 3 = 0").select(named)).select("s_suppkey", "stage")


@query("N32_class_readiness", """
WITH r AS (SELECT DISTINCT label FROM detections UNION ALL SELECT 'absent') SELECT r.label, count(d.photo) AS reviewed, count(DISTINCT d.photo) AS photos, CASE WHEN count(d.photo) > 0 THEN CAST(round(avg(CASE WHEN conf % 2 = 0 THEN 2 ELSE 1 END) * 1000) AS BIGINT) END AS filled,
 CASE WHEN count(d.photo) = 0 THEN 'no examples' WHEN count(d.photo) < 5 THEN 'few examples' ELSE 'review the sample' END AS status FROM r LEFT JOIN detections d ON d.label = r.label AND d.reviewed GROUP BY r.label""")
def readiness(t: Tables) -> DataFrame:
    d = t.detections()
    names = d.select("label").distinct()
    reg = names.unionByName(names.agg(F.max(F.lit("absent")).alias("label")))
    masks = d.withColumn("attributes", F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.when(F.col("conf") % 2 == 0, "y").otherwise("")))
    return R.class_readiness(reg, masks).withColumn("filled", F.round(F.col("filled") * 1000).cast("bigint"))


@query("N33_layer_lines", """
SELECT layer_id, rtrim(rtrim(printf('%.2f', top_cm / 100.0), '0'), '.') || '–' || rtrim(rtrim(printf('%.2f', base_cm / 100.0), '0'), '.') || ' м; ' || label || '; a: ' || conf || CASE WHEN conf % 2 = 0 THEN '; b: x' ELSE '' END AS detail FROM layers""")
def lines(t: Tables) -> DataFrame:
    attrs = F.create_map(F.lit("b"), F.when(F.col("conf") % 2 == 0, "x").otherwise(""), F.lit("a"), F.col("conf").cast("string"))
    return R.layer_lines(t.layers().withColumn("attributes", attrs)).select("layer_id", "detail")


@query("N34_catalog_union", """
WITH b AS (SELECT p_type AS label, p_name AS name, 0 AS p, p_partkey AS pos FROM part UNION ALL SELECT upper(p_type), 'meta ' || p_size, 1, p_partkey FROM part WHERE p_type < 'N')
SELECT arg_max(label, struct_pack(p := p, s := pos)) AS label, arg_max(name, struct_pack(p := p, s := pos)) AS name FROM b GROUP BY lower(label)""")
def catalog_union(t: Tables) -> DataFrame:
    seen = t.part.select(F.col("p_type").alias("label"), F.col("p_name").alias("name"), F.col("p_partkey").alias("pos"))
    meta = t.part.filter("p_type < 'N'").select(F.upper("p_type").alias("label"), F.concat(F.lit("meta "), "p_size").alias("name"), F.col("p_partkey").alias("pos"))
    return R.catalog_union(seen, meta)


@query("N35_caption_vocabulary", "SELECT symbol, count(*) AS uses FROM (SELECT unnest(string_split(text, '')) AS symbol FROM documents) WHERE symbol <> '' GROUP BY symbol")
def vocabulary(t: Tables) -> DataFrame:
    return R.caption_vocabulary(t.documents, "text")


@query("N35_caption_limits", "SELECT CAST(max(length(text)) AS BIGINT) AS longest, count(DISTINCT (lang, source)) AS conditions FROM documents")
def limits(t: Tables) -> DataFrame:
    return R.caption_limits(t.documents, "text", ["lang", "source"])


@query("K2_json_lines", """SELECT photo, '{"photo":' || photo || ',"label":"' || label || '","reviewed":' || CASE WHEN reviewed THEN 'true' ELSE 'false' END || '}' AS line FROM records""")
def json_lines(t: Tables) -> DataFrame:
    return t.records().select("photo", F.to_json(F.struct("photo", "label", "reviewed")).alias("line"))


@query("K3_label_lines", """
SELECT photo AS image, string_agg('1 ' || printf('%.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f', least(1, "left" / 320.0), least(1, top / 350.0), least(1, "right" / 320.0), least(1, top / 350.0), least(1, "right" / 320.0), least(1, bottom / 350.0), least(1, "left" / 320.0), least(1, bottom / 350.0)), chr(10) ORDER BY det) AS lines FROM detections GROUP BY photo""")
def label_lines(t: Tables) -> DataFrame:
    masks = t.detections().select(
        F.lit("train").alias("split"), F.col("photo").alias("image"), F.col("det").alias("pos"), F.lit(1).alias("class_id"), G.rectangle(*B.box()).alias("polygon"), F.lit(320).alias("width"), F.lit(350).alias("height"))
    return SK.label_lines(masks).select("image", "lines")


@query("K4_manifest", """SELECT '{"projects":' || count(DISTINCT source) || ',"photos":' || count(*) || '}' AS manifest FROM documents""")
def manifest(t: Tables) -> DataFrame:
    return SK.manifest(t.documents.agg(F.countDistinct("source").alias("projects"), F.count(F.lit(1)).alias("photos")))


def report_layers(t: Tables) -> DataFrame:
    return t.layers().select(
        "well", "layer_id", "label", "top_cm", "base_cm", (F.col("top_cm") - 100).alias("core_top_cm"), (F.col("base_cm") + 100).alias("core_base_cm"), F.lit(None).cast("string").alias("field"),
        F.when(F.col("conf") % 2 == 0, F.col("conf").cast("string")).alias("facies_index"), F.lit("").alias("facies_name"), F.lit(None).cast("string").alias("facies_code"),
        F.when(F.col("conf") % 3 == 0, "text").alias("description"), F.lit(None).cast("string").alias("note"), F.lit(" ").alias("lithology"))


@query("K5_official_rows", """
SELECT well, row_number() OVER (PARTITION BY well ORDER BY top_cm, base_cm, layer_id) AS layer_no, CAST(top_cm / 100.0 AS DOUBLE) AS top, CAST(abs(base_cm - top_cm) / 100.0 AS DOUBLE) AS thickness,
 CAST((max(base_cm + 100) OVER (PARTITION BY well) - min(top_cm - 100) OVER (PARTITION BY well)) / 100.0 AS DOUBLE) AS drilled, CASE WHEN conf % 2 = 0 THEN CAST(conf AS VARCHAR) ELSE label END AS facies_index, CASE WHEN conf % 2 = 0 THEN CAST(conf AS VARCHAR) ELSE label END AS facies_name,
 CASE WHEN conf % 3 = 0 THEN 'text' ELSE 'Описание не заполнено' END AS description FROM layers""")
def official(t: Tables) -> DataFrame:
    d = lambda c: F.col(c).cast("double").alias(c)
    return R.official_rows(report_layers(t)).select("well", "layer_no", d("top"), d("thickness"), d("drilled"), "facies_index", "facies_name", "description")


@query("K6_exchange_rows", """
SELECT CAST(layer_id AS VARCHAR) AS description, well, CASE WHEN conf % 2 = 0 THEN CAST(conf AS DOUBLE) ELSE CAST(round(CAST(base_cm / 100.0 AS DOUBLE) - CAST(top_cm / 100.0 AS DOUBLE), 4) AS DOUBLE) END AS thickness, CAST(NULL AS VARCHAR) AS stratigraphy FROM layers""")
def exchange(t: Tables) -> DataFrame:
    rows = t.layers().select(
        "well", F.col("layer_id").alias("description"), (F.col("top_cm") / 100).alias("facies_top"), (F.col("base_cm") / 100).alias("facies_base"), F.when(F.col("conf") % 2 == 0, F.col("conf")).alias("thickness"))
    return R.exchange_rows(rows).select("description", "well", "thickness", "stratigraphy")


@query("S8_manual_corrections", """
SELECT photo, CASE WHEN photo % 3 = 0 THEN top_cm + 5 ELSE top_cm END AS top_cm, CASE WHEN photo % 3 = 0 THEN 'manual' ELSE 'ocr' END AS source, CASE WHEN photo % 3 = 0 THEN NULL ELSE 'kept' END AS column_depths, CASE WHEN photo % 3 = 0 THEN 'unknown' ELSE 'gis' END AS depth_basis FROM photos""")
def manual(t: Tables) -> DataFrame:
    p = t.photos().select("photo", "well", "top_cm", "base_cm", F.lit("ocr").alias("source"), F.lit("kept").alias("column_depths"), F.lit("gis").alias("depth_basis"))
    edits = p.select("photo", "well", (F.col("top_cm") + F.when(F.col("photo") % 3 == 0, 5).otherwise(0)).alias("top_cm"), "base_cm")
    return R.confirm_manual(p, edits).select("photo", "top_cm", "source", "column_depths", "depth_basis")


@query("S10_gis_columns", "SELECT layer_id, CASE WHEN conf % 2 = 1 THEN top_cm END AS facies_top, CASE WHEN conf % 2 = 0 THEN top_cm END AS gis_facies_top FROM layers")
def gis(t: Tables) -> DataFrame:
    rows = t.layers().select("layer_id", F.when(F.col("conf") % 2 == 0, "gis").otherwise("drilling").alias("depth_basis"), F.col("top_cm").alias("facies_top"), F.col("base_cm").alias("facies_base"), F.col("top_cm").alias("core_top"), F.col("base_cm").alias("core_base"))
    return R.gis_columns(rows).select("layer_id", "facies_top", "gis_facies_top")


@query("S12_well_order", "SELECT well FROM (SELECT well, min(photo) AS f FROM photos GROUP BY well) LEFT JOIN (SELECT s_suppkey AS well, s_nationkey * 1000 + s_suppkey AS r FROM supplier WHERE s_suppkey % 3 = 0) USING (well) ORDER BY r NULLS LAST, f")
def well_order(t: Tables) -> DataFrame:
    explicit = t.supplier.filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("well"), (F.col("s_nationkey") * 1000 + F.col("s_suppkey")).alias("rank"))
    return R.well_order(t.photos(), explicit, pos="photo")


@query("S14_text_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red')")
def search(t: Tables) -> DataFrame:
    return R.search(t.part, "RED", ["p_name", "p_brand", "p_type"]).select("p_partkey")


@query("S15_interval_source", """
SELECT photo, CASE WHEN photo % 4 = 0 THEN 'filename' WHEN photo % 4 = 1 THEN 'caption' WHEN photo % 4 = 2 AND well % 2 = 0 THEN 'well' ELSE 'unresolved' END AS source, CASE WHEN photo % 4 < 2 OR (photo % 4 = 2 AND well % 2 = 0) THEN top_cm + photo % 4 END AS top_cm FROM photos""")
def source(t: Tables) -> DataFrame:
    kind = F.col("photo") % 4
    part = lambda cond, d: (F.when(cond, F.col("top_cm") + d), F.when(cond, F.col("base_cm") + d))
    got = R.interval_source([("filename", *part(kind == 0, 0)), ("caption", *part(kind <= 1, 1)), ("well", *part((kind <= 2) & (F.col("well") % 2 == 0), 2))])
    return t.photos().select("photo", got["source"].alias("source"), got["top_cm"].alias("top_cm"))


@query("O1_photo_order", "SELECT photo FROM photos ORDER BY CAST(well AS VARCHAR), top_cm, base_cm, photo")
def photo_order(t: Tables) -> DataFrame:
    return R.photo_order(t.photos().withColumn("name", F.concat(F.lit("p"), "photo"))).select("photo")


@query("O2_layer_order", "SELECT layer_id FROM layers ORDER BY CAST(well AS VARCHAR), top_cm, base_cm, layer_id")
def layer_order(t: Tables) -> DataFrame:
    return R.layer_order(t.layers()).select("layer_id")


@query("O5_class_ids", f"WITH {REG} SELECT label, row_number() OVER (ORDER BY lower(label), label) - 1 AS class_id FROM reg")
def class_ids(t: Tables) -> DataFrame:
    return registry(t)


@query("O6_catalog_order", "SELECT DISTINCT p_name, lower(p_name) AS folded FROM part ORDER BY folded, p_name")
def catalog_order(t: Tables) -> DataFrame:
    return t.part.select("p_name", F.lower("p_name").alias("folded")).distinct().orderBy("folded", "p_name")


@query("U1_union_of_issues", "SELECT layer_id AS source, 'warning' AS severity FROM layers WHERE conf < 93 UNION ALL SELECT CAST(photo AS VARCHAR), 'error' FROM photos WHERE NOT confirmed")
def all_issues(t: Tables) -> DataFrame:
    return t.layers().filter("conf < 93").select(F.col("layer_id").alias("source"), F.lit("warning").alias("severity")).unionByName(
        t.photos().filter("NOT confirmed").select(F.col("photo").cast("string").alias("source"), F.lit("error").alias("severity")))


@query("U2_distinct_keys", "SELECT well FROM layers UNION SELECT well FROM photos")
def distinct_keys(t: Tables) -> DataFrame:
    return t.layers().select("well").union(t.photos().select("well")).distinct()


@query("U3_unmatched_wells", "SELECT DISTINCT well FROM photos WHERE well NOT IN (SELECT well FROM layers WHERE conf = 100 AND top_cm < 20000)")
def unmatched(t: Tables) -> DataFrame:
    return t.photos().select("well").distinct().join(t.layers().filter("conf = 100 AND top_cm < 20000").select("well"), "well", "left_anti")


@query("U4_new_classes", "SELECT DISTINCT label FROM layers WHERE label NOT IN ('AF', 'RO')")
def new_classes(t: Tables) -> DataFrame:
    known = t.layers().select("label").filter(F.col("label").isin("AF", "RO")).distinct()
    return V.new_classes(t.layers(), known)


@query("U5_shared_hashes", "SELECT hash FROM records WHERE photo % 2 = 0 INTERSECT SELECT hash FROM records WHERE photo % 2 = 1")
def shared(t: Tables) -> DataFrame:
    r = t.records()
    return r.filter("photo % 2 = 0").select("hash").intersect(r.filter("photo % 2 = 1").select("hash"))


@query("U6_set_difference", "(SELECT hash, 'left' AS side FROM (SELECT hash FROM records WHERE photo % 3 <> 0 EXCEPT ALL SELECT hash FROM records WHERE photo % 3 <> 1)) UNION ALL (SELECT hash, 'right' FROM (SELECT hash FROM records WHERE photo % 3 <> 1 EXCEPT ALL SELECT hash FROM records WHERE photo % 3 <> 0))")
def difference(t: Tables) -> DataFrame:
    a, b = t.records().filter("photo % 3 <> 0").select("hash"), t.records().filter("photo % 3 <> 1").select("hash")
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def listing(t: Tables) -> DataFrame:
    ext = F.when(F.col("photo") % 4 == 0, ".JPG").when(F.col("photo") % 4 == 1, ".png").when(F.col("photo") % 4 == 2, ".csv").otherwise(".txt")
    gen = F.when(F.col("photo") % 10 == 0, "_review/").otherwise("")
    return t.photos().select(F.concat(F.lit("/root/Photos/w"), "well", F.lit("/"), gen, F.lit("p"), "photo", ext).alias("path"), F.col("photo").alias("size"), F.lit(1).alias("mtime"), "photo")


@query("I2_I15_discovered_files", "SELECT photo FROM photos WHERE photo % 4 < 2 AND photo % 10 <> 0")
def discovered(t: Tables) -> DataFrame:
    return LS.discover(listing(t), LS.IMAGES, exclude=["_review"]).select("photo")


@query("I2_unreadable_files", "SELECT '/f/' || photo AS source, 'error' AS severity, 'no readable rows' AS message FROM photos WHERE photo % 4 = 2")
def unreadable(t: Tables) -> DataFrame:
    files = t.photos().select(F.concat(F.lit("/f/"), "photo").alias("path"), "photo")
    rows = files.select("path", F.when(F.col("photo") % 4 != 2, "x").alias("value"))
    return LS.read_outcomes(files, rows)[1]


@query("I12_imported_contours", """
SELECT photo AS image_id, det AS id, CASE WHEN label = 'RF' THEN 'Без класса' ELSE label END AS label, CASE WHEN conf % 3 = 0 THEN 3 ELSE 4 END AS points FROM detections WHERE conf % 5 <> 0""")
def contours(t: Tables) -> DataFrame:
    d = t.detections().withColumn("archive", F.lit("a.zip"))
    x = lambda c: F.col(c).cast("double")
    seg = F.when(F.col("conf") % 3 == 0, F.to_json(F.array(F.array(x("left"), x("top"), x("right"), x("top"), x("right"), x("bottom")))))
    box = F.array(x("left"), x("top"), x("right") - x("left"), F.when(F.col("conf") % 5 == 0, 0.0).otherwise(x("bottom") - x("top")))
    notes = d.select("archive", F.col("photo").alias("image_id"), F.col("label").alias("category_id"), F.col("det").alias("id"), F.when(F.col("conf") % 5 != 0, seg).alias("segmentation"), box.alias("bbox"))
    images = d.select("archive", F.col("photo").alias("id"), F.concat("photo", F.lit(".jpg")).alias("file_name")).distinct()
    cats = d.filter("label <> 'RF'").select("archive", F.col("label").alias("id"), F.col("label").alias("name")).distinct()
    rows, _ = RC.import_annotations(images, notes, cats)
    return rows.select("image_id", "id", "label", F.size("polygon").alias("points"))


@query("I14_resolved_images", """
SELECT photo, CASE photo % 4 WHEN 0 THEN 'images/p' || photo || '.jpg' WHEN 1 THEN 'set/x/p' || photo || '.jpg' WHEN 2 THEN 'deep/P' || photo || '.JPG' END AS member FROM photos""")
def resolved(t: Tables) -> DataFrame:
    kind = F.col("photo") % 4
    p = t.photos().select("photo", F.lit("a").alias("archive"), F.concat(F.lit("p"), "photo", F.lit(".jpg")).alias("name"))
    member = F.when(kind == 0, F.concat(F.lit("images/"), "name")).when(kind == 1, F.concat(F.lit("set/x/"), "name")).when(kind == 2, F.concat(F.lit("deep/P"), "photo", F.lit(".JPG")))
    members = p.select("archive", member.alias("member")).filter("member IS NOT NULL")
    return p.join(LS.resolve_images(p.select("archive", "name"), members), ["archive", "name"]).select("photo", "member")


@query("I16_photo_map", """
SELECT photo, top_cm, base_cm, CASE WHEN photo % 3 = 0 THEN 'manual' ELSE 'ocr' END AS source, photo % 4 < 2 AS confirmed, CAST(CASE WHEN photo % 5 = 0 THEN 0 ELSE 1 END AS INTEGER) AS labels, 'left_to_right' AS column_order FROM photos""")
def photo_map(t: Tables) -> DataFrame:
    m = lambda c: F.replace((F.col(c) / 100).cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    flag = F.when(F.col("photo") % 4 == 0, "1").when(F.col("photo") % 4 == 1, " Да ").otherwise("0")
    depths = F.when(F.col("photo") % 5 == 0, "oops").otherwise(F.concat(F.lit("[[0.5, "), F.col("top_cm") / 100, F.lit(", "), F.col("base_cm") / 100, F.lit("]]")))
    raw = t.photos().select(
        "photo", F.col("well").cast("string").alias("well"), m("top_cm").alias("top"), m("base_cm").alias("base"), F.when(F.col("photo") % 3 == 0, " ").otherwise("ocr").alias("source"),
        flag.alias("mapping_confirmed"), F.lit("слева направо").alias("column_order"), depths.alias("column_depths"), F.lit("no").alias("column_ocr_checked"), F.lit("").alias("depth_basis"))
    return RC.photo_map(raw).select("photo", "top_cm", "base_cm", "source", "confirmed", F.size("column_depths").alias("labels"), "column_order")


@query("I17_reference_classes", """
WITH g AS (SELECT p_type AS code, p_brand AS "index", min(p_partkey) AS f, arg_min(p_name, p_partkey) AS name, count(*) AS variants FROM part GROUP BY ALL)
SELECT row_number() OVER (ORDER BY f) - 1 AS class_id, code || '@' || "index" AS model_label, name, variants FROM g""")
def reference(t: Tables) -> DataFrame:
    return classes(t).select("class_id", "model_label", "name", "variants")


def classes(t: Tables) -> DataFrame:
    return RC.reference_classes(t.part.select(F.col("p_type").alias("code"), F.col("p_brand").alias("index"), F.col("p_name").alias("name"), F.col("p_partkey").alias("pos")))


@query("I18_newest_manifest", """
WITH a AS (SELECT DISTINCT l_suppkey AS folder, l_linenumber AS manifest FROM lineitem WHERE l_orderkey % 5 = 0 AND l_linenumber <> 7), b AS (SELECT folder, max(manifest) AS manifest FROM a GROUP BY folder)
SELECT folder, manifest, count(*) AS boxes FROM lineitem JOIN b ON l_suppkey = folder AND l_linenumber = manifest GROUP BY ALL""")
def manifest_boxes(t: Tables) -> DataFrame:
    rel = F.concat(F.lit("a/"), "l_orderkey")
    rows = t.lineitem.select(F.col("l_suppkey").alias("folder"), F.col("l_linenumber").alias("manifest"), F.col("l_linenumber").alias("mtime"), F.replace(rel, F.lit("/"), F.lit("\\")).alias("source_relative"),
                             F.lit(0).alias("left"), F.lit(0).alias("top"), F.lit(1).alias("right"), F.lit(1).alias("bottom"))
    files = t.lineitem.filter("l_orderkey % 5 = 0 AND l_linenumber <> 7").select(F.col("l_suppkey").alias("folder"), F.concat(F.lit("a/"), "l_orderkey").alias("relative"))
    return RC.newest_manifest(rows.filter("manifest <> 7"), files).groupBy("folder", "manifest").agg(F.count(F.lit(1)).alias("boxes"))


@query("I19_best_epoch", """
WITH c AS (SELECT o_custkey AS run, o_orderkey AS epoch, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice / 1000000 END AS m FROM orders),
 r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY m DESC NULLS LAST, epoch) AS k, count(*) OVER (PARTITION BY run) AS epochs FROM c)
SELECT run, epochs, epoch, CAST(round(CAST(m AS DECIMAL(18,9)), 4) AS DOUBLE) AS map FROM r WHERE k = 1""")
def best_epoch(t: Tables) -> DataFrame:
    m = F.when(F.col("o_orderkey") % 9 == 0, "nan").otherwise((F.col("o_totalprice") / 1000000).cast("string"))
    curves = t.orders.select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("epoch"), F.lit(None).cast("string").alias("mask_map"), m.alias("box_map"), F.lit("0.5").alias("precision"), F.lit("0.5").alias("recall"))
    return RC.best_epoch(curves).select("run", "epochs", "epoch", "map")


@query("I20_rescaled_projects", """SELECT photo, CAST(row_number() OVER (PARTITION BY photo ORDER BY det) - 1 AS INTEGER) AS pos, label, "left" * 2.0 AS x, top * 0.5 AS y FROM detections""")
def rescaled(t: Tables) -> DataFrame:
    pos = F.array_sort(F.collect_list(F.struct("det", "label", G.rectangle(*B.box()).alias("polygon"))))
    photos = t.detections().groupBy("photo").agg(pos.alias("detections")).select("photo", "detections", F.lit(100).alias("saved_width"), F.lit(200).alias("saved_height"), F.lit(200).alias("width"), F.lit(100).alias("height"))
    first = F.get("polygon", 0)
    return RC.rescale_project(photos).select("photo", "pos", "label", first["x"].alias("x"), first["y"].alias("y"))


@query("I21_caption_dataset", "SELECT photo FROM records WHERE photo % 5 < 2 AND photo % 3 <> 0 AND photo % 7 <> 0")
def caption_dataset(t: Tables) -> DataFrame:
    r = t.records().select("photo", F.element_at(F.array(*[F.lit(s) for s in ("train", "val", "test", "", "x")]), (F.col("photo") % 5 + 1).cast("int")).alias("split"),
                           F.when(F.col("photo") % 3 != 0, "text").alias("target_text"), F.concat(F.lit("c"), "photo").alias("crop"))
    return RC.caption_rows(r, r.filter("photo % 7 <> 0")).select("photo")


@query("I22_photo_groups", "SELECT photo, 'Photos/w' || well AS \"group\" FROM photos")
def photo_groups(t: Tables) -> DataFrame:
    return LS.photo_groups(listing(t), "/root").select("photo", "group")


@query("I23_attached_context", """
WITH c AS (SELECT DISTINCT p_type AS code, p_brand AS ix, p_type || '@' || p_brand AS m FROM part), p AS (SELECT p_partkey AS ident, CASE WHEN p_size % 2 = 0 THEN p_type || '@' || p_brand ELSE p_type END AS label FROM part)
SELECT p.ident, CASE WHEN contains(p.label, '@') THEN p.label ELSE coalesce((SELECT m FROM c WHERE c.code = p.label AND c.ix = 'Brand#7'), p.label) END AS model_class,
 CASE WHEN contains(p.label, '@') OR EXISTS (SELECT 1 FROM c WHERE c.code = p.label AND c.ix = 'Brand#7') THEN 'прогноз, требуется проверка' ELSE 'не сопоставлена со справочником' END AS status FROM p""")
def context(t: Tables) -> DataFrame:
    label = F.when(F.col("p_size") % 2 == 0, F.concat_ws("@", "p_type", "p_brand")).otherwise(F.col("p_type"))
    preds = t.part.select(F.col("p_partkey").alias("ident"), label.alias("label"))
    sidecar = t.part.select(label.alias("label"), F.lit("Brand#7").alias("index")).distinct()
    return RC.attach_context(preds, sidecar, classes(t)).select("ident", "model_class", "status")


@query("N24_source_digest")
def digest(t: Tables) -> DataFrame:
    """Order-free digest of the sample table: partition digests of sorted buckets, then one digest."""
    return V.table_digest(t.records(), ["hash", "label", "well"])


@query("K1_delimited_rows", "SELECT layer_id, well || ';' || top_cm || ';' || base_cm || ';' || label AS line FROM layers")
def delimited_rows(t: Tables) -> DataFrame:
    return t.layers().select("layer_id", F.to_csv(F.struct("well", "top_cm", "base_cm", "label"), {"sep": ";"}).alias("line"))


def stream_folder(t: Tables) -> str:
    """A fresh folder next to the session's checkpoints."""
    import uuid

    from depthlake.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(t.spark)}/{uuid.uuid4().hex}"


@query("T2_T3_resumable_batches", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'done' END AS status, CASE WHEN o_orderstatus = 'P' THEN 'no interval' ELSE '' END AS error FROM orders""")
def resumable(t: Tables) -> DataFrame:
    """Orders as a file stream in bounded batches with an outcome per item."""
    out = stream_folder(t)
    stream = AR.file_stream(t.spark, f"{t.dir}/orders*.parquet", t.orders.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    work = AR.status_batch(lambda b: b.withColumn("error", F.when(F.col("o_orderstatus") == "P", "no interval")), f"{out}/status", "o_orderkey")
    AR.drain(stream, work, f"{out}/state")
    return AR.latest_status(t.spark.read.parquet(f"{out}/status"), "o_orderkey")


@query("T9_streamed_duplicates", "SELECT DISTINCT props FROM events")
def streamed_duplicates(t: Tables) -> DataFrame:
    """Events as a stream; a content that returns is dropped, however late."""
    out = stream_folder(t)
    schema = t.events.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    stream = AR.file_stream(t.spark, f"{t.dir}/events*.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    AR.keep_state_on_disk(t.spark)
    fresh = AR.drop_repeats(stream.select("props"), "props")
    AR.drain(fresh, lambda b, i: b.write.mode("overwrite").parquet(f"{out}/rows/batch={i}"), f"{out}/state")
    return t.spark.read.parquet(f"{out}/rows").select("props")
