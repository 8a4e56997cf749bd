"""Boxes and detections on photos: columns, lanes, suppression, classes, reading order.

Work is keyed by photo.  The few exact sequential folds (``reading_order``, ``token_rows``,
``merge_lanes``) hand one photo's boxes to a small pandas helper; a detector emits at most
its configured maximum per photo (2,000 in the largest preset), which bounds the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from depthlake.functions import geometry as G
from depthlake.session import settled

BOX = ("left", "top", "right", "bottom")


def box(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(prefix + c) for c in BOX)


def columns_in_image(df: DataFrame, *, width: Column, height: Column, least: int = 3) -> DataFrame:
    """Clamp column boxes to the image and drop slivers."""
    clamp = lambda c, hi: F.greatest(F.lit(0), F.least(F.col(c), hi))
    inside = df.withColumns({"left": clamp("left", width), "right": clamp("right", width), "top": clamp("top", height), "bottom": clamp("bottom", height)})
    return inside.filter((F.col("right") - F.col("left") >= least) & (F.col("bottom") - F.col("top") >= least))


def drop_width_outliers(df: DataFrame, photo: str = "photo") -> DataFrame:
    """Keep boxes between 0.55 and 1.8 of the photo's median width when there are three."""
    width = F.col("right") - F.col("left")
    stats = df.groupBy(photo).agg(F.median(width).alias("__m"), F.count(F.lit(1)).alias("__n"))
    marked = df.join(stats, photo).withColumn("__ok", (width >= F.col("__m") * 0.55) & (width <= F.col("__m") * 1.8))
    kept = marked.filter("__ok").groupBy(photo).agg(F.count(F.lit(1)).alias("__k"))
    return marked.join(kept, photo, "left").filter(
        (F.col("__n") < 3) | (F.coalesce("__k", F.lit(0)) < 2) | F.col("__ok")).drop("__m", "__n", "__ok", "__k")


def overlapping_boxes(left: DataFrame, right: DataFrame, photo: str = "photo", *, cell: int = 256) -> DataFrame:
    """Pairs of boxes of one photo that share area, met through a pixel grid.

    Left columns keep their names, right columns carry the prefix ``o_``.
    """
    def cells(df, p):
        span = lambda a, b: F.sequence(F.floor(F.col(p + a) / cell), F.floor((F.col(p + b) - 1e-9) / cell))
        wide = df.filter((F.col(p + "right") > F.col(p + "left")) & (F.col(p + "bottom") > F.col(p + "top")))
        return wide.withColumn("__cx", F.explode(span("left", "right"))).withColumn("__cy", F.explode(span("top", "bottom")))

    rhs = right.select(*[F.col(c).alias(c if c == photo else f"o_{c}") for c in right.columns])
    joined = cells(left, "").join(cells(rhs, "o_").hint("merge"), [photo, "__cx", "__cy"])
    first = (F.col("__cx") == F.floor(F.greatest("left", "o_left") / cell)) & (F.col("__cy") == F.floor(F.greatest("top", "o_top") / cell))
    return joined.filter(first & (G.shared_area(box(), box("o_")) > 0)).drop("__cx", "__cy")


def greedy_losers(beats: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The nodes that lose when nodes are accepted best first, each unless an accepted better one beats it.

    ``beats`` holds (ids, w_ids): the better node ``w`` conflicts with the node.  Nodes that none beats
    are accepted from the start and take no part, so a round costs what its conflicts cost.  It accepts
    every node whose better rivals are all gone; the number of rounds is the longest chain of conflicts.
    """
    ids = list(ids)
    win = [f"w_{c}" for c in ids]
    as_win = lambda df: df.select(*[F.col(c).alias(f"w_{c}") for c in ids])
    beats = beats.select(*ids, *win)
    left = settled(beats.select(*ids).distinct())
    gone = lost = settled(beats.join(as_win(left), win, "left_anti").select(*ids).distinct())
    while not left.isEmpty():
        left = left.join(lost, ids, "left_anti")
        beats = settled(beats.join(left, ids, "left_semi").join(as_win(left), win, "left_semi"))
        losing = settled(beats.select(*ids).distinct())
        lost = settled(beats.join(as_win(losing), win, "left_anti").select(*ids).distinct())
        gone, left = gone.unionByName(lost), losing
    return gone


def without(df: DataFrame, gone: DataFrame, ids: Sequence[str]) -> DataFrame:
    """``df`` without the rows of ``gone`` and without rows that lack an id."""
    return df.dropna(subset=list(ids)).join(gone, list(ids), "left_anti")


def suppress_overlaps(
    df: DataFrame, ident: str, *, photo: str = "photo", confidence: str = "conf", label: str = "label", share: float = 0.12,
) -> tuple[DataFrame, DataFrame]:
    """Non-maximum suppression and the classes it silenced.

    Boxes go by confidence; one that shares ``share`` of the smaller area with an accepted
    box is dropped, and when its class differs it is an alternative of its first such box.
    """
    slim = df.select(photo, ident, *BOX, confidence, label)
    pairs = overlapping_boxes(slim, slim, photo)
    better = F.struct((-F.col(f"o_{confidence}")).alias("c"), F.col(f"o_{ident}").alias("i")) < F.struct((-F.col(confidence)).alias("c"), F.col(ident).alias("i"))
    big = G.shared_area(box(), box("o_")) >= F.least(G.box_area(box()), G.box_area(box("o_"))) * share
    beats = settled(pairs.filter(better & big).select(
        photo, ident, F.col(photo).alias(f"w_{photo}"), F.col(f"o_{ident}").alias(f"w_{ident}"), confidence, label,
        F.col(f"o_{label}").alias("w_label"), F.col(f"o_{confidence}").alias("w_conf")))
    gone = greedy_losers(beats, [photo, ident])
    lost = beats.join(gone.select(F.col(photo).alias(f"w_{photo}"), F.col(ident).alias(f"w_{ident}")), [f"w_{photo}", f"w_{ident}"], "left_anti")
    first = lost.groupBy(photo, ident, confidence, label).agg(
        F.min(F.struct((-F.col("w_conf")).alias("c"), F.col(f"w_{ident}").alias("i"), F.col("w_label").alias("l"))).alias("__f"))
    alternatives = first.filter(F.col("__f.l") != F.col(label)).groupBy(photo, F.col("__f.i").alias(ident), F.col(label).alias("alternative")).agg(
        F.max(confidence).alias("alternative_conf"))
    return without(df.filter(G.box_area(box()) > 0), gone, [photo, ident]), alternatives


def best_column(boxes: DataFrame, columns: DataFrame, ident: str, column: str, *, photo: str = "photo", least: float = 0.55) -> DataFrame:
    """Column holding most of a box; by at least ``least`` of its area, else by its centre."""
    pairs = overlapping_boxes(boxes, columns, photo)
    share = G.shared_area(box(), box("o_"))
    centre = (F.col("left") + F.col("right")) / 2
    ok = (share >= G.box_area(box()) * least) | ((centre >= F.col("o_left")) & (centre <= F.col("o_right")))
    return pairs.filter(ok).groupBy(photo, ident).agg(
        F.max_by(f"o_{column}", F.struct(share.alias("s"), (-F.col(f"o_{column}")).alias("c"))).alias(column))


def interval_class(df: DataFrame, keys: Sequence[str], crop_area: Column, *, label: str = "label", confidence: str = "confidence") -> DataFrame:
    """Class of a crop: best conf * (0.55 + 0.45 * sqrt(area share)); other classes as alternatives."""
    keys = list(keys)
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), G.box_area(box()).cast("double")) / F.greatest(F.lit(1.0), crop_area.cast("double")))
    scored = df.withColumn("__s", F.col(confidence) * (0.55 + 0.45 * F.sqrt(share)))
    per = scored.groupBy(*keys, label).agg(F.max(F.struct("__s", F.col(confidence).alias("c"))).alias("__b"), F.max(confidence).alias("__m"))
    whole = per.groupBy(*keys).agg(
        F.max(F.struct(F.col("__b"), F.col(label).alias("l"))).alias("__w"),
        F.map_from_entries(F.collect_list(F.struct(F.col(label), F.col("__m")))).alias("__all"))
    return whole.select(
        *keys, F.col("__w.l").alias(label), F.col("__w.__b.c").alias(confidence),
        F.map_filter("__all", lambda k, v: k != F.col("__w.l")).alias("alternatives"))


def inherit_class(targets: DataFrame, context: DataFrame, ident: str, *, photo: str = "photo", confidence: str = "confidence", label: str = "label") -> DataFrame:
    """Class of the best overlapping labelled box; confidence times 0.8."""
    pairs = overlapping_boxes(targets, context, photo)
    share = G.shared_area(box(), box("o_")) / F.greatest(F.lit(1.0), G.box_area(box()).cast("double"))
    score = share * F.greatest(F.lit(0.05), F.col(f"o_{confidence}"))
    best = pairs.groupBy(photo, ident).agg(F.max(F.struct(
        score.alias("s"), F.col(f"o_{confidence}").alias("c"), F.col(f"o_{label}").alias("l"))).alias("__b"))
    return best.select(photo, ident, F.col("__b.l").alias(label), (F.col("__b.c") * 0.8).alias(confidence))


def segment_for(boxes: DataFrame, segments: DataFrame, ident: str, segment: str, *, photo: str = "photo") -> DataFrame:
    """Depth segment of a polygon box: one containing its centre, then the larger overlap."""
    pairs = overlapping_boxes(boxes, segments, photo)
    cx, cy = (F.col("left") + F.col("right")) / 2, (F.col("top") + F.col("bottom")) / 2
    inside = (cx >= F.col("o_left")) & (cx <= F.col("o_right")) & (cy >= F.col("o_top")) & (cy <= F.col("o_bottom"))
    rank = F.struct(inside.alias("c"), G.shared_area(box(), box("o_")).alias("a"), (-F.col(f"o_{segment}")).alias("n"))
    return pairs.groupBy(photo, ident).agg(F.max_by(f"o_{segment}", rank).alias(segment))


def near_duplicates(df: DataFrame, order: str, *, photo: str = "photo", label: str = "label", least: float = 0.90) -> DataFrame:
    """Boxes with IoU of ``least`` to an earlier box of the same class."""
    pairs = overlapping_boxes(df, df, photo)
    return pairs.filter(
        (F.col(label) == F.col(f"o_{label}")) & (F.col(f"o_{order}") < F.col(order)) & (G.iou(box(), box("o_")) >= least)
    ).select(photo, label, order).distinct()


def confidence_list(df: DataFrame, keys: Sequence[str], *, label: str = "label", confidence: str = "confidence", alternatives: str = "alternatives", limit: int = 6) -> DataFrame:
    """Selected class and its competitors, best first."""
    keys = list(keys)
    own = F.array(F.struct(F.col(label).alias("l"), F.col(confidence).alias("c")))
    other = F.transform(F.map_entries(alternatives), lambda e: F.struct(e["key"].alias("l"), e["value"].alias("c")))
    best = df.select(*keys, F.explode(F.concat(own, other)).alias("e")).groupBy(*keys, F.col("e.l").alias("candidate")).agg(F.max("e.c").alias("score"))
    ranked = best.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct(
        (-F.col("score")).alias("s"), F.lower("candidate").alias("f"), F.col("candidate")))), 1, limit).alias("__t"))
    return ranked.select(*keys, F.posexplode("__t").alias("place", "t")).select(*keys, "place", "t.candidate", (-F.col("t.s")).alias("score"))


def label_samples(df: DataFrame, order: Sequence[str], *, label: str = "label", reviewed: str = "reviewed", confidence: str = "conf", blank: Sequence[str] = ("", "Новый контур")) -> DataFrame:
    """First photo's best example per label: reviewed first, then confidence."""
    ok = df.filter(~F.trim(label).isin(*blank) & (F.col("right") - F.col("left") >= 4) & (F.col("bottom") - F.col("top") >= 4))
    rank = F.struct(F.col(order[0]), (~F.col(reviewed)).alias("r"), (-F.col(confidence)).alias("c"), *[F.col(c) for c in order[1:]])
    return ok.groupBy(label).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns if c != label]), rank).alias("__s")).select(label, "__s.*")


def review_queue(df: DataFrame, *, limit: int = 100, confidence: str = "confidence", rival: Column | None = None, odd: Column | None = None,
                 well: str = "well", tie: Sequence[str] = ()) -> DataFrame:
    """Automatic masks most in need of review (O3): low confidence, close rivals, odd sizes."""
    rival = F.lit(0.0) if rival is None else F.coalesce(rival, F.lit(0.0))
    odd = F.lit(False) if odd is None else odd
    priority = (1.0 - F.col(confidence)) + F.greatest(F.lit(0.0), rival - F.col(confidence) + 0.15) + F.when(odd, 0.25).otherwise(0.0)
    return df.withColumn("priority", priority).orderBy(F.desc("priority"), F.lower(F.col(well).cast("string")), confidence, *tie).limit(limit)


def _per_photo(df: DataFrame, photo: str, fields: Sequence[str], helper, out: str) -> DataFrame:
    """Add ``out`` from a helper that turns one photo's sorted rows, an array of structs, into an array of values."""
    others = [c for c in df.columns if c != photo]
    rows = df.groupBy(photo).agg(F.sort_array(F.collect_list(F.struct(*fields, F.struct(*others).alias("__row")))).alias("__rows"))
    numbered = rows.withColumn("__v", helper(F.transform("__rows", lambda r: F.struct(*[r[f].alias(f) for f in fields]))))
    each = F.arrays_zip("__rows", "__v")
    return numbered.select(photo, F.explode(each).alias("__e")).select(
        photo, *[F.col(f"__e.__rows.__row.{c}").alias(c) for c in others], F.col("__e.__v").alias(out))


def _reading_places(rows: Column) -> Column:
    """Places of boxes sorted by (centre, top, ident, left, w): a fold that grows columns of near centres.

    The state is the columns so far, as sums and counts of centres, and the column of each box.
    """
    widths = F.sort_array(F.transform(rows, lambda b: F.greatest(F.lit(1.0), b["w"])))
    reach = F.greatest(F.lit(12.0), F.get(widths, F.floor(F.size(widths) / 2).cast("int")) * 0.65)

    def place(s, b):
        gaps = F.transform(s["columns"], lambda c, i: F.struct(F.abs(b["cx"] - c["total"] / c["n"]).alias("gap"), i.alias("i")))
        near = F.array_min(gaps)
        fresh = F.coalesce(near["gap"] > reach, F.lit(True))
        one = F.struct(b["cx"].cast("double").alias("total"), F.lit(1).alias("n"))
        grown = F.transform(s["columns"], lambda c, i: F.when(i == near["i"], F.struct((c["total"] + b["cx"]).alias("total"), (c["n"] + 1).alias("n"))).otherwise(c))
        return F.struct(F.when(fresh, F.concat(s["columns"], F.array(one))).otherwise(grown).alias("columns"),
                        F.concat(s["at"], F.array(F.when(fresh, F.size(s["columns"])).otherwise(near["i"]))).alias("at"))

    def ranked(s):
        keys = F.transform(rows, lambda b, i: F.struct((F.get(s["columns"], F.get(s["at"], i))["total"] / F.get(s["columns"], F.get(s["at"], i))["n"]).alias("c"), F.get(s["at"], i).alias("a"), b["top"], b["left"], b["ident"], i.alias("i")))
        order = F.transform(F.sort_array(keys), lambda k: k["i"])
        return F.transform(rows, lambda b, i: F.array_position(order, i) - 1)

    empty = F.struct(F.expr("cast(array() AS array<struct<total:double,n:int>>)").alias("columns"), F.expr("cast(array() AS array<int>)").alias("at"))
    return F.aggregate(rows, empty, place, ranked)


def _text_rows(rows: Column, tolerance: float) -> Column:
    """Row numbers of tokens in y order; the state is the open row's heights and the numbers so far."""
    def place(s, token):
        n = F.size(s["open"])
        middle = (F.get(s["open"], F.floor((n - 1) / 2).cast("int")) + F.get(s["open"], F.floor(n / 2).cast("int"))) / 2
        fresh = F.coalesce(token["y"] - middle > tolerance, F.lit(True))
        number = F.coalesce(F.get(s["numbers"], F.size(s["numbers"]) - 1), F.lit(-1).cast("bigint")) + F.when(fresh, 1).otherwise(0)
        return F.struct(F.when(fresh, F.array(token["y"])).otherwise(F.concat(s["open"], F.array(token["y"]))).alias("open"), F.concat(s["numbers"], F.array(number)).alias("numbers"))

    empty = F.struct(F.expr("cast(array() AS array<double>)").alias("open"), F.expr("cast(array() AS array<bigint>)").alias("numbers"))
    return F.aggregate(rows, empty, place, lambda s: s["numbers"])


def reading_order(df: DataFrame, order: str, *, photo: str = "photo") -> DataFrame:
    """Place of each box: columns of near centres left to right, then top to bottom."""
    shaped = df.withColumns({"cx": (F.col("left") + F.col("right")) / 2, "w": (F.col("right") - F.col("left")).cast("double"), "ident": F.col(order)})
    got = _per_photo(shaped, photo, ["cx", "top", "ident", "left", "w"], _reading_places, "place")
    return got.drop("cx", "w", "ident")


def token_rows(df: DataFrame, tolerance: float, *, photo: str = "photo", y: str = "y", tie: str = "token") -> DataFrame:
    """Text rows: a token opens a row when it lies below the open row's median by more than the tolerance."""
    shaped = df.withColumns({"__y": F.col(y).cast("double"), "__tie": F.col(tie)})
    named = shaped.withColumnsRenamed({y: "__keep"}).withColumnRenamed("__y", "y")
    return _per_photo(named, photo, ["y", "__tie"], lambda rows: _text_rows(rows, tolerance), "text_row").drop("y", "__tie").withColumnRenamed("__keep", y)


def merge_lanes(df: DataFrame, order: str, *, photo: str = "photo", share: float = 0.55, centre: float = 0.48, least: float = 5.0, by: str = "left") -> DataFrame:
    """Fuse column proposals of one lane into their envelope, first fit in order.

    Proposals come by their ``left`` side, or ``by="centre"`` (which fuses partial boxes of several
    strategies), then by their top and ``order``.

    A box fits a lane when they share ``share`` of the narrower width and their centres are within
    ``centre`` of it (``least`` pixels at least).  The fold's state is the photo's envelopes so far.
    """
    def fits(lane, b):
        narrow = F.least(b["right"] - b["left"], lane["right"] - lane["left"])
        shared = F.least(b["right"], lane["right"]) - F.greatest(b["left"], lane["left"])
        apart = F.abs((b["left"] + b["right"]) / 2 - (lane["left"] + lane["right"]) / 2)
        return (narrow > 0) & (shared >= narrow * share) & (apart <= F.greatest(F.lit(least), narrow * centre))

    def envelope(lane, b):
        return F.struct(*[(F.least if side in ("left", "top") else F.greatest)(lane[side], b[side]).alias(side) for side in BOX])

    def place(lanes, b):
        first = F.array_position(F.transform(lanes, lambda lane: fits(lane, b)), True)
        grown = F.transform(lanes, lambda lane, i: F.when(i + 1 == first, envelope(lane, b)).otherwise(lane))
        return F.when(first > 0, grown).otherwise(F.concat(lanes, F.array(F.struct(*[b[side].alias(side) for side in BOX]))))

    sides = df.select(photo, order, *[F.col(side).cast("bigint").alias(side) for side in BOX])
    first_by = ((F.col("left") + F.col("right")) / 2 if by == "centre" else F.col("left")).alias("by")
    rows = sides.groupBy(photo).agg(F.sort_array(F.collect_list(F.struct(first_by, "top", order, "left", "right", "bottom"))).alias("rows"))
    empty = F.expr("cast(array() AS array<struct<" + ",".join(f"`{side}`:bigint" for side in BOX) + ">>)")
    return rows.select(photo, F.explode(F.aggregate("rows", empty, place)).alias("b")).select(photo, *[F.col(f"b.{side}").alias(side) for side in BOX])


def outside_lanes(found: DataFrame, lanes: DataFrame, *, photo: str = "photo", share: float = 0.58) -> DataFrame:
    """Boxes that share less than ``share`` of the narrower width with every lane of their photo."""
    known = lanes.select(F.col(photo).alias("__photo"), F.col("left").alias("__left"), F.col("right").alias("__right"))
    met = F.least("right", "__right") - F.greatest("left", "__left")
    narrow = F.least(F.col("right") - F.col("left"), F.col("__right") - F.col("__left"))
    return found.join(known, (F.col(photo) == F.col("__photo")) & (met >= narrow * share), "left_anti")


def drop_same_boxes(df: DataFrame, ident: str, *, photo: str = "photo", least: float = 0.68) -> DataFrame:
    """Keep boxes in (left, top, taller first) order unless one kept is nearly the same."""
    slim = df.select(photo, ident, *BOX)
    pairs = overlapping_boxes(slim, slim, photo)
    rank = lambda p: F.struct(F.col(f"{p}left").alias("a"), F.col(f"{p}top").alias("b"), (F.col(f"{p}top") - F.col(f"{p}bottom")).alias("c"), F.col(f"{p}{ident}").alias("d"))
    beats = pairs.filter((rank("o_") < rank("")) & (G.iou(box(), box("o_")) >= least)).select(
        photo, ident, F.col(photo).alias(f"w_{photo}"), F.col(f"o_{ident}").alias(f"w_{ident}"))
    return without(df, greedy_losers(settled(beats), [photo, ident]), [photo, ident])


def column_traversal(columns: DataFrame, marks: DataFrame, *, photo: str = "photo") -> DataFrame:
    """Column visiting order and direction from the best top/bottom word.

    ``columns``: photo, col, box; ``marks``: photo, kind (top | bottom), x, y, confidence.
    """
    best = marks.filter(F.col("kind").isin("top", "bottom")).groupBy(photo).agg(F.max_by(
        F.struct("kind", "x", "y"), F.struct((F.col("kind") == "top").alias("t"), F.col("confidence"), (-F.col("x")).alias("x"))).alias("__m"))
    over = W.partitionBy(photo).orderBy("left", "top", "col")
    placed = columns.withColumn("__i", F.row_number().over(over) - 1)
    size = placed.groupBy(photo).agg(F.count(F.lit(1)).alias("__n"))
    joined = placed.join(size, photo).join(best, photo, "left")
    gap = F.abs((F.col("left") + F.col("right")) / 2 - F.col("__m.x"))
    near = joined.groupBy(photo).agg(F.min_by("__i", F.struct(gap.alias("g"), F.col("__i"))).alias("__near"))
    joined = joined.join(near, photo)
    top = F.col("__m.kind") == "top"
    # A traversal that does not start at an end of the row falls back to the whole row.
    forward = F.when(F.col("__m").isNull(), True).when(top, F.col("__near") <= (F.col("__n") - 1) / 2).otherwise(
        (F.col("__near") < F.col("__n") / 2) & (F.col("__near") != 0))
    ordered = joined.withColumn("visit", F.when(forward, F.col("__i")).otherwise(F.col("__n") - 1 - F.col("__i")))
    first = ordered.filter("visit = 0").select(photo, ((F.col("top") + F.col("bottom")) / 2).alias("__mid"))
    way = F.when(F.col("__m").isNull(), "down").when(top, F.when(F.col("__m.y") <= F.col("__mid"), "down").otherwise("up")).otherwise(
        F.when(F.col("__m.y") >= F.col("__mid"), "up").otherwise("down"))
    return ordered.join(first, photo).withColumn("direction", way).select(*columns.columns, "visit", "direction")


def column_candidates(
    columns: DataFrame, detections: DataFrame, *, photo: str = "photo", column: str = "column", order: str = "det", label: str = "label",
    least_share: float = 0.15, least_height: float = 0.25,
) -> DataFrame:
    """Core columns (box as ``c_left``, ...) with every detection that may own ground of them, cut to the column; or with NULLs.

    A detection needs a label, more than ``least_height`` pixels inside the column and a ``share`` of
    ``least_share`` of the narrower width, which it meets the column on; ``owns`` is true then.
    ``place`` numbers the detections of a photo in the given order.
    """
    named = detections.filter(F.trim(F.coalesce(label, F.lit(""))) != "").withColumn("place", F.row_number().over(W.partitionBy(photo).orderBy(order)))
    sound = columns.filter((F.col("right") > F.col("left")) & (F.col("bottom") > F.col("top"))).select(photo, column, *[F.col(c).alias(f"c_{c}") for c in BOX])
    met = F.least("right", "c_right") - F.greatest("left", "c_left")
    width = F.least(F.col("right") - F.col("left"), F.col("c_right") - F.col("c_left"))
    cut = sound.join(named.hint("merge"), photo, "left").withColumn("share", met / F.greatest(F.lit(1.0), width)).withColumns(
        {"cut_top": F.greatest("top", "c_top"), "cut_bottom": F.least("bottom", "c_bottom")})
    return cut.withColumn("owns", F.col("place").isNotNull() & (met > 0) & (F.col("cut_bottom") - F.col("cut_top") > least_height) & (F.col("share") >= least_share))


def complete_columns(
    columns: DataFrame, detections: DataFrame, *, photo: str = "photo", column: str = "column", order: str = "det", label: str = "label",
    confidence: str = "conf", structure: str = "structure", identity: Sequence[str] = (), depths: DataFrame | None = None,
    gap_label: str, least_share: float = 0.15, least_height: float = 0.25,
) -> DataFrame:
    """One gap-free partition of every core column by the detections on it (W4, in pixels).

    A piece between neighbouring contacts goes to a detection with a ``structure`` first, then by
    confidence times share, share, confidence and the photo's order.  Ground without a detection
    becomes ``gap_label`` with confidence 0, never a guess.  Neighbours of equal label, identity
    and structure are one band with the least confidence.  ``depths`` (photo, order, box,
    depth_from, depth_to) gives depths by the first of its boxes over the column's centre.

    All detections of a column meet as one array (a photo has a bounded number of boxes), so a photo
    is shuffled once and everything after that is found where it lies.
    """
    keys, same = [photo, column], [label, *identity, structure]
    cut = column_candidates(columns, detections, photo=photo, column=column, order=order, label=label, least_share=least_share, least_height=least_height)
    y = lambda c: F.col(c).cast("double")
    rank = [F.col(structure).isNotNull(), F.col(confidence) * F.col("share"), F.col("share"), F.col(confidence), -F.col("place")]
    best = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)], *same, confidence)
    held = F.struct(y("cut_top").alias("a"), y("cut_bottom").alias("z"), best.alias("best"))
    per = cut.groupBy(*keys, *[f"c_{c}" for c in BOX]).agg(F.collect_list(F.when(F.col("owns"), held)).alias("on"))
    if depths is not None:
        scale = F.struct("order", *[F.col(c).cast("double").alias(c) for c in ("top", "bottom", "depth_from", "depth_to")])
        of_photo = depths.groupBy(photo).agg(F.collect_list(F.struct(F.col("left").alias("l"), F.col("right").alias("r"), scale.alias("scale"))).alias("scales"))
        centre = (F.col("c_left") + F.col("c_right")) / 2
        over = F.filter("scales", lambda d: (centre >= d["l"]) & (centre <= d["r"]))
        per = per.join(of_photo.hint("merge"), photo, "left").withColumn("scale", F.array_min(F.transform(over, lambda d: d["scale"]))).drop("scales")
    kept = [F.col("c_left").alias("left"), F.col("c_right").alias("right"), *(["scale"] if depths is not None else [])]
    ends = F.array_sort(F.array_distinct(F.concat(F.transform("on", lambda h: h["a"]), F.transform("on", lambda h: h["z"]), F.array(y("c_top"), y("c_bottom")))))
    marked = per.select(*keys, *kept, "on", ends.alias("ends"))
    pieces = marked.select(*keys, "left", "right", *kept[2:], "on", F.inline(F.transform(
        F.slice("ends", F.lit(2), F.size("ends") - 1), lambda z, i: F.struct(F.get("ends", i).alias("y"), z.alias("next"))))).filter(F.col("next") - F.col("y") > 1e-6)
    won = pieces.withColumn("best", F.array_max(F.transform(F.filter("on", lambda h: (h["a"] <= F.col("y")) & (h["z"] >= F.col("next"))), lambda h: h["best"]))).drop("on")
    bands = won.withColumn("gap_filled", F.col("best").isNull()).withColumns({
        **{c: F.col("best")[c] for c in (*identity, structure)},
        label: F.when(F.col("gap_filled"), F.lit(gap_label)).otherwise(F.col("best")[label]),
        confidence: F.when(F.col("gap_filled"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(1), F.col("best")[confidence])))})
    down = W.partitionBy(*keys).orderBy("y")
    alike = F.lit(True)
    for c in (*same, "gap_filled"):
        alike = alike & F.lag(c).over(down).eqNullSafe(F.col(c))
    new = F.when((F.row_number().over(down) > 1) & alike, 0).otherwise(1)
    bands = bands.withColumn("new", new).withColumn("band", F.sum("new").over(down.rowsBetween(W.unboundedPreceding, 0)))
    held_to = [F.first(c).alias(c) for c in ("left", "right", *(["scale"] if depths is not None else []))]
    made = bands.groupBy(*keys, "band", *same, "gap_filled").agg(F.min("y").alias("top"), F.max("next").alias("bottom"), F.min(confidence).alias(confidence), *held_to)
    if depths is None:
        return made
    span = F.col("scale.bottom") - F.col("scale.top")
    depth = lambda c: F.when(span > 0, F.bround(F.col("scale.depth_from") + (F.col(c) - F.col("scale.top")) / span * (F.col("scale.depth_to") - F.col("scale.depth_from")), 4))
    return made.withColumns({"depth_from": F.least(depth("top"), depth("bottom")), "depth_to": F.greatest(depth("top"), depth("bottom"))}).drop("scale")
