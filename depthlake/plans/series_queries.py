"""Queries for depth series and well logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from depthlake.operators import joins as J, series as S
from depthlake.plans.proxies import Tables
from depthlake.plans.registry import query
from depthlake.sources import las

UNITS = "CAST(floor({0} * 10000 + 0.5) AS BIGINT)"


def units(c):
    return F.floor(c * 10000 + 0.5).cast("bigint")


RESAMPLED = """
 asks AS (SELECT DISTINCT well, (depth // 3600) * 3600 AS depth FROM samples),
 sc AS (SELECT DISTINCT well, curve FROM samples), tg AS (SELECT well, curve, depth FROM asks JOIN sc USING (well)),
 lo AS (SELECT t.well, t.curve, t.depth, max(struct_pack(d := s.depth, v := CAST(s.v AS DOUBLE))) FILTER (WHERE s.depth < t.depth) AS lo,
   min(struct_pack(d := s.depth, v := CAST(s.v AS DOUBLE))) FILTER (WHERE s.depth >= t.depth) AS hi
   FROM tg t JOIN samples s ON s.well = t.well AND s.curve = t.curve GROUP BY ALL),
 rs AS (SELECT well, curve, depth, CASE WHEN lo IS NULL THEN hi.v WHEN hi IS NULL THEN lo.v WHEN hi.d = depth THEN hi.v
   ELSE lo.v + (hi.v - lo.v) * (CAST(depth - lo.d AS DOUBLE) / CAST(hi.d - lo.d AS DOUBLE)) END AS x FROM lo)"""


def asks(t: Tables) -> DataFrame:
    s = t.samples()
    return s.select("well", "curve").distinct().join(s.select("well", F.expr("(depth div 3600) * 3600").alias("depth")).distinct(), "well")


@query("W6_resample", f"WITH {RESAMPLED} SELECT well, curve, depth, {UNITS.format('x')} AS v FROM rs")
def resample(t: Tables) -> DataFrame:
    got = S.resample(t.samples(), asks(t), ["well", "curve"])
    return got.select("well", "curve", "depth", units(F.col("v")).alias("v"))


@query("W7_merge_logs", """
WITH base AS (SELECT * FROM samples WHERE curve IN ('click', 'view')), inc AS (SELECT * FROM samples WHERE curve IN ('view', 'error')),
 tg AS (SELECT DISTINCT b.well, i.curve, b.depth FROM base b JOIN (SELECT DISTINCT well, curve FROM inc) i USING (well)),
 lo AS (SELECT t.well, t.curve, t.depth, max(struct_pack(d := s.depth, v := CAST(s.v AS DOUBLE))) FILTER (WHERE s.depth < t.depth) AS lo,
   min(struct_pack(d := s.depth, v := CAST(s.v AS DOUBLE))) FILTER (WHERE s.depth >= t.depth) AS hi
   FROM tg t JOIN inc s ON s.well = t.well AND s.curve = t.curve GROUP BY ALL)
SELECT well, curve, depth, CAST(v AS BIGINT) * 10000 AS v FROM base UNION ALL
SELECT well, CASE WHEN curve = 'view' THEN 'view_2' ELSE curve END, depth, CAST(floor((CASE WHEN lo IS NULL THEN hi.v WHEN hi IS NULL THEN lo.v WHEN hi.d = depth THEN hi.v
   ELSE lo.v + (hi.v - lo.v) * (CAST(depth - lo.d AS DOUBLE) / CAST(hi.d - lo.d AS DOUBLE)) END) * 10000 + 0.5) AS BIGINT) FROM lo""")
def merge_logs(t: Tables) -> DataFrame:
    s = t.samples()
    got = S.merge_logs(s.filter(F.col("curve").isin("click", "view")), s.filter(F.col("curve").isin("view", "error")), ["well"])
    return got.select("well", "curve", "depth", units(F.col("v")).alias("v"))


@query("W8_preview", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY well, curve ORDER BY depth) - 1 AS i, count(*) OVER (PARTITION BY well, curve) AS n,
  min(v) OVER (PARTITION BY well, curve) AS lo, max(v) OVER (PARTITION BY well, curve) AS hi FROM samples)
SELECT well, curve, depth, {UNITS.format('CASE WHEN hi = lo THEN 0.5 ELSE CAST(v - lo AS DOUBLE) / CAST(hi - lo AS DOUBLE) END')} AS scaled
FROM r WHERE i % greatest(1, n // 50) = 0""")
def preview(t: Tables) -> DataFrame:
    return S.preview(t.samples(), ["well", "curve"], points=50).select("well", "curve", "depth", units(F.col("scaled")).alias("scaled"))


@query("W9_switch_depth", """
WITH x AS (SELECT well, curve, depth // 600 AS depth, max(v) AS v FROM samples GROUP BY ALL),
 a AS (SELECT well, depth, v AS new_depth FROM x WHERE curve = 'view'), u AS (SELECT well FROM a GROUP BY well HAVING count(*) >= 2)
SELECT x.well, x.curve, x.depth, x.v, a.new_depth FROM x JOIN a USING (well, depth) WHERE x.well IN (SELECT well FROM u)""")
def switch(t: Tables) -> DataFrame:
    x = t.samples().groupBy("well", "curve", F.expr("depth div 600").alias("depth")).agg(F.max("v").alias("v"))
    return S.switch_depth(x, ["well"], "view").select("well", "curve", "depth", "v", "new_depth")


@query("W16_depth_position_map", f"""
WITH k AS (SELECT well, depth, sum(v)::DOUBLE / count(v) AS y FROM (SELECT well, (depth // 7200) * 7200 AS depth, v FROM samples) GROUP BY ALL),
 a AS (SELECT DISTINCT well, (depth // 5000) * 5000 AS depth FROM samples),
 lo AS (SELECT t.well, t.depth, max(struct_pack(d := s.depth, v := s.y)) FILTER (WHERE s.depth < t.depth) AS lo,
   min(struct_pack(d := s.depth, v := s.y)) FILTER (WHERE s.depth >= t.depth) AS hi FROM a t JOIN k s ON s.well = t.well GROUP BY ALL)
SELECT well, depth, {UNITS.format('(CASE WHEN lo IS NULL THEN hi.v WHEN hi IS NULL THEN lo.v WHEN hi.d = depth THEN hi.v ELSE lo.v + (hi.v - lo.v) * (CAST(depth - lo.d AS DOUBLE) / CAST(hi.d - lo.d AS DOUBLE)) END)')} AS y FROM lo""")
def position_map(t: Tables) -> DataFrame:
    s = t.samples()
    anchors = s.select("well", F.expr("(depth div 7200) * 7200").alias("depth"), F.col("v").alias("y"))
    wanted = s.select("well", F.expr("(depth div 5000) * 5000").alias("depth"))
    return S.piecewise_map(anchors, wanted, ["well"]).select("well", "depth", units(F.col("y")).alias("y"))


@query("W18_order_breaks", """
WITH p AS (SELECT well, layer_id, top_cm, base_cm, max(base_cm) OVER (PARTITION BY well ORDER BY top_cm, base_cm, layer_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_base_cm FROM layers)
SELECT * FROM p WHERE top_cm < previous_base_cm""")
def order_breaks(t: Tables) -> DataFrame:
    rows = t.layers().select("well", "layer_id", "top_cm", "base_cm")
    return S.order_breaks(rows, ["well"], tie=["layer_id"])


@query("W19_true_runs", """
WITH f AS (SELECT *, v > 2500 AS up, CASE WHEN lag(v > 2500) OVER w = (v > 2500) THEN 0 ELSE 1 END AS n FROM samples WINDOW w AS (PARTITION BY well, curve ORDER BY depth)),
 r AS (SELECT *, sum(n) OVER (PARTITION BY well, curve ORDER BY depth ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT well, curve, min(depth) AS run_start, max(depth) AS run_end, count(*) AS run_rows FROM r WHERE up GROUP BY well, curve, run""")
def true_runs(t: Tables) -> DataFrame:
    return S.true_runs(t.samples().withColumn("up", F.col("v") > 2500), ["well", "curve"], "up", "depth")


@query("W20_moving_average", f"""
WITH r AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY well, curve) AS n, first_value(v) OVER w AS a,
   last_value(v) OVER (PARTITION BY well, curve ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z,
   sum(v) OVER (PARTITION BY well, curve ORDER BY depth ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS s FROM samples WINDOW w AS (PARTITION BY well, curve ORDER BY depth))
SELECT well, curve, depth, {UNITS.format('CAST(s + greatest(0, 4 - i) * a + greatest(0, i + 3 - n) * z AS DOUBLE) / 7')} AS smooth, {UNITS.format('CAST(s AS DOUBLE) / 7')} AS zero_padded FROM r""")
def moving_average(t: Tables) -> DataFrame:
    edge = S.moving_average(t.samples(), ["well", "curve"], "depth", "v", 3)
    both = S.moving_average(edge, ["well", "curve"], "depth", "v", 3, pad="zero", out="zero_padded")
    return both.select("well", "curve", "depth", units(F.col("smooth")).alias("smooth"), units(F.col("zero_padded")).alias("zero_padded"))


@query("W21_robust_scale", f"""
WITH q AS (SELECT well, curve, quantile_cont(CAST(v AS DOUBLE), 0.05) AS lo, quantile_cont(CAST(v AS DOUBLE), 0.95) AS hi FROM samples GROUP BY ALL)
SELECT well, curve, depth, CAST(floor(greatest(0.0, least(1.0, (v - lo) / (hi - lo))) * 100000 + 0.3) AS BIGINT) AS scaled FROM samples JOIN q USING (well, curve)""")
def robust_scale(t: Tables) -> DataFrame:
    got = S.robust_scale(t.samples(), ["well", "curve"], "v")
    return got.select("well", "curve", "depth", F.floor(F.col("scaled") * 100000 + 0.3).cast("bigint").alias("scaled"))


@query("W22_change_points")
def change_points(t: Tables) -> DataFrame:
    s = t.samples().groupBy("well", "depth").agg(F.sum("v").alias("a"), F.max("v").alias("b"))
    return S.change_points(s, ["well"], "depth", "a", "b").select("well", "boundary", "change")


@query("W23_texture_evidence", """
SELECT well, depth // 36000 AS part, CASE WHEN avg(v) / 10000 >= 0.58 THEN 'high lamination density' WHEN max(v) / 10000.0 >= 0.64 THEN 'pale comparatively uniform texture'
  WHEN max(v) / 10000.0 <= 0.35 THEN 'dark comparatively uniform texture' ELSE 'persistent change of visual texture' END AS evidence FROM samples GROUP BY ALL""")
def evidence(t: Tables) -> DataFrame:
    s = t.samples().groupBy("well", F.expr("depth div 36000").alias("part")).agg((F.max("v") / 10000).alias("b"), (F.avg("v") / 10000).alias("l"))
    return s.select("well", "part", S.texture_evidence(F.col("b"), F.col("l")).alias("evidence"))


@query("I11_las_samples", """
WITH d AS (SELECT DISTINCT well, depth FROM samples), c(curve) AS (VALUES ('click'), ('view'), ('error'), ('signup'), ('purchase'))
SELECT 'Well ' || d.well AS well, CAST(d.depth AS DOUBLE) AS depth, upper(c.curve) AS curve, s.v / 100.0::DOUBLE AS value
FROM d CROSS JOIN c LEFT JOIN samples s ON s.well = d.well AND s.depth = d.depth AND s.curve = c.curve
UNION ALL SELECT 'Well ' || well, CAST(depth AS DOUBLE), 'DEPT', CAST(depth AS DOUBLE) FROM d""")
def las_samples(t: Tables) -> DataFrame:
    """Log files written from the events: one file per well, missing values as -999.25."""
    curves = ("click", "view", "error", "signup", "purchase")
    wide = t.samples().groupBy("well", "depth").pivot("curve", list(curves)).agg(F.max("v"))
    values = [F.coalesce((F.col(c) / 100).cast("string"), F.lit("-999.25")) for c in curves]
    data = wide.select("well", (F.col("depth") + 100).alias("line_no"), F.concat_ws(" ", F.col("depth").cast("string"), *values).alias("line"))
    head = ["~Version", "VERS. 2.0 : text", "~Well", "NULL. M -999.25 : null", "", "~Curve information", "DEPT.M : depth",
            *[f"{c}.API : {c}" for c in curves], "# note", "~ASCII"]
    lines = F.array(*[F.struct(F.lit(i).cast("bigint").alias("line_no"), F.lit(v).alias("line")) for i, v in enumerate(head)])
    wells = t.samples().select("well").distinct()
    heads = wells.select("well", F.inline(F.concat(lines, F.array(F.struct(
        F.lit(4).cast("bigint").alias("line_no"), F.concat(F.lit("WELL. NAME Well "), "well", F.lit(" : the well")).alias("line"))))))
    text = data.unionByName(heads).select(F.concat(F.lit("/logs/w"), "well", F.lit(".las")).alias("file"), "line_no", "line")
    samples, _ = las.parse_las(text)
    return samples.select("well", "depth", "curve", "value")


PREDICTED = """pred AS (SELECT well, top_cm AS top_cm, CASE WHEN conf % 3 = 0 THEN base_cm ELSE least(base_cm, coalesce(lead(top_cm) OVER w, base_cm)) END AS base_cm, label, layer_id,
  layer_id AS photo, conf AS prediction, CASE WHEN conf % 2 = 0 THEN 'text ' || conf ELSE ' ' END AS description FROM layers WINDOW w AS (PARTITION BY well ORDER BY top_cm, base_cm, layer_id))"""


@query("W11_continuation_groups", """
WITH p AS (SELECT *, 'name ' || label AS facies_name, CASE WHEN conf % 2 = 0 THEN 'text ' || conf ELSE '' END AS description FROM layers),
 f AS (SELECT *, CASE WHEN lag(label) OVER w = label AND lag(base_cm) OVER w = top_cm AND (lag(conf) OVER w <> conf OR lag(conf % 5) OVER w = conf % 5) THEN 0 ELSE 1 END AS n
   FROM p WINDOW w AS (PARTITION BY well ORDER BY top_cm, base_cm, layer_id)),
 g AS (SELECT *, sum(n) OVER (PARTITION BY well ORDER BY top_cm, base_cm, layer_id ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT well, label, min(top_cm) AS group_top_cm, max(base_cm) AS group_base_cm, count(*) AS rows, max(base_cm) - min(top_cm) AS thickness_cm,
  coalesce(arg_min(description, struct_pack(a := top_cm, b := base_cm, c := layer_id)) FILTER (WHERE description <> ''), min(facies_name)) AS description
FROM g GROUP BY well, run, label""")
def continuation(t: Tables) -> DataFrame:
    return S.continuation_groups(
        described(t), "well", ["top_cm", "base_cm", "layer_id"], index="label", photo="conf", prediction="kind",
    ).select("well", "label", "group_top_cm", "group_base_cm", "rows", "thickness_cm", "description")


def described(t: Tables) -> DataFrame:
    told = F.when(F.col("conf") % 2 == 0, F.concat(F.lit("text "), "conf")).otherwise(" ")
    return t.layers().withColumns({"description": told, "facies_name": F.concat(F.lit("name "), "label"), "kind": F.col("conf") % 5})


@query("X1_generated_text_gate", """
SELECT layer_id, CASE WHEN conf >= 95 THEN upper(label) ELSE label END AS description, conf >= 95 AS generated FROM layers""")
def gate(t: Tables) -> DataFrame:
    @pandas_udf("text string, confidence double")
    def shout(label: pd.Series, conf: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"text": label.str.upper(), "confidence": (conf - 94.9) / 5})

    rows = t.layers().select("layer_id", "conf", "label", F.col("label").alias("description"))
    return S.accept_generated(rows, shout, ["label", "conf"], least=0.01).select("layer_id", "description", "generated")


@query("X2_capacity_column", """
SELECT o_orderkey AS photo, CAST(sum(50 + l_quantity) AS BIGINT) AS capacity_cm FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def capacity_column(t: Tables) -> DataFrame:
    """Capacity comes as a joined column instead of a callback."""
    caps = t.lineitem.groupBy(F.col("l_orderkey").alias("photo")).agg(F.sum(50 + F.col("l_quantity")).cast("bigint").alias("capacity_cm"))
    return J.with_capacity(t.photos(), caps).select("photo", "capacity_cm")


@query("W10_layer_numbers", "SELECT layer_id, well, row_number() OVER (PARTITION BY well ORDER BY top_cm, base_cm, layer_id) AS layer_no FROM layers")
def layer_numbers(t: Tables) -> DataFrame:
    from depthlake.operators.scan import numbered

    return numbered(t.layers(), ["well"], ["top_cm", "base_cm", "layer_id"], "layer_no").select("layer_id", "well", "layer_no")


@query("W12_move_and_restack", """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY well ORDER BY top_cm, base_cm, layer_id) AS pos FROM layers),
 s AS (SELECT *, CASE pos WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE pos END AS p2 FROM o)
SELECT layer_id, well, p2 AS pos, min(top_cm) OVER (PARTITION BY well) + CAST(coalesce(sum(base_cm - top_cm) OVER (PARTITION BY well ORDER BY p2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS top_cm,
  min(top_cm) OVER (PARTITION BY well) + CAST(sum(base_cm - top_cm) OVER (PARTITION BY well ORDER BY p2 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS base_cm FROM s""")
def move_layer(t: Tables) -> DataFrame:
    from depthlake.operators.scan import numbered

    rows = numbered(t.layers(), ["well"], ["top_cm", "base_cm", "layer_id"], "pos").select("layer_id", "well", "pos", "top_cm", "base_cm")
    moves = t.supplier.select(F.col("s_suppkey").alias("well"), F.lit(2).cast("bigint").alias("pos"))
    return S.restack(S.swap_neighbours(rows, moves, "well", "pos"), "well", "pos")
