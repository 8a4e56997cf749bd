"""Depth-series operators: resampling, merging, scaling, smoothing, change points, anchors.

A series is ``(keys, depth, value)``.  Nothing sorts a whole series in one task: ordered
work goes through block scans, quantiles through counts per distinct value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from depthlake.operators.scan import BLOCK, chains, numbered, running
from depthlake.session import ensure_checkpoint_dir

DEPTH_BLOCK = 1 << 16


def resample(
    source: DataFrame, target: DataFrame, keys: Sequence[str], *, depth: str = "depth", value: str = "v",
    width: int = DEPTH_BLOCK,
) -> DataFrame:
    """Linear values of ``source`` at the ``target`` depths, edge values held.

    A target depth that is also a source depth takes the source value.  Source depths are
    unique per key; samples without a depth or a value are no neighbours.
    """
    keys = list(keys)
    marks = source.filter(F.col(depth).isNotNull() & F.col(value).isNotNull()).select(*keys, depth, F.lit(1).alias("__src"), F.struct(F.col(depth).alias("d"), F.col(value).cast("double").alias("v")).alias("__p"))
    asks = target.select(*keys, depth).distinct().select(*keys, depth, F.lit(0).alias("__src"), F.lit(None).cast(marks.schema["__p"].dataType).alias("__p"))
    both = marks.unionByName(asks)
    left = running(both, keys, [depth, "__src"], {"__lo": ("last", "__p")}, width=width)
    full = running(left, keys, [depth, "__src"], {"__hi": ("last", "__p")}, width=width, reverse=True)
    lo, hi, at = F.col("__lo"), F.col("__hi"), F.col(depth)
    between = lo["v"] + (hi["v"] - lo["v"]) * ((at - lo["d"]) / (hi["d"] - lo["d"]))
    return full.filter("__src = 0").select(
        *keys, depth,
        F.when(lo.isNull(), hi["v"]).when(hi.isNull(), lo["v"]).when(hi["d"] == at, hi["v"]).otherwise(between).alias(value))


def merge_logs(
    base: DataFrame, incoming: DataFrame, well: Sequence[str], *, curve: str = "curve", depth: str = "depth", value: str = "v",
) -> DataFrame:
    """Add the curves of another log on the first log's grid.

    A name that is taken gets the first number from 2 that neither log uses with it.
    """
    well = list(well)
    grid = base.select(*well, depth).distinct()
    names = incoming.select(*well, curve).distinct()
    targets = names.join(grid, well)
    values = resample(incoming, targets, [*well, curve], depth=depth, value=value)
    taken = base.select(*well, curve).distinct().withColumn("__taken", F.lit(True))
    stem, number = (F.regexp_extract(curve, r"^(.*)_([1-9]\d{0,8})$", i) for i in (1, 2))
    used = taken.select(*well, curve).unionByName(names).select(*well, stem.alias(curve), number.try_cast("int").alias("__n")).filter("__n IS NOT NULL")
    used = used.groupBy(*well, curve).agg(F.collect_set("__n").alias("__used"))  # numbers of one name
    numbers = F.coalesce("__used", F.expr("cast(array() AS array<int>)"))
    free = F.array_min(F.array_except(F.sequence(F.lit(2), F.size(numbers) + 2), numbers))
    renamed = names.join(taken, [*well, curve], "left").join(used, [*well, curve], "left").select(
        *well, curve, F.when(F.col("__taken"), F.concat(curve, F.lit("_"), free.cast("string"))).otherwise(F.col(curve)).alias("__name"))
    added = values.join(renamed, [*well, curve]).select(*well, F.col("__name").alias(curve), depth, value)
    return base.select(*well, curve, depth, F.col(value).cast("double").alias(value)).unionByName(added)


def preview(df: DataFrame, keys: Sequence[str], *, depth: str = "depth", value: str = "v", points: int = 700, width: int = DEPTH_BLOCK) -> DataFrame:
    """Min-max normalised curve thinned by stride to about ``points`` rows."""
    keys = list(keys)
    stats = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.count(F.lit(1)).alias("__n"))
    rows = numbered(df, keys, [depth], "__i", width=width).join(stats, keys)
    step = F.greatest(F.lit(1), F.expr(f"__n div {points}"))
    flat = F.col("__hi") == F.col("__lo")
    scaled = F.when(flat, F.lit(0.5)).otherwise((F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))
    return rows.filter((F.col("__i") - 1) % step == 0).select(*keys, depth, scaled.alias("scaled"))


def switch_depth(df: DataFrame, well: Sequence[str], new_depth: str, *, curve: str = "curve", depth: str = "depth", value: str = "v") -> DataFrame:
    """Use another curve's values as depth where it has at least two values."""
    well = list(well)
    axis = df.filter((F.col(curve) == new_depth) & F.col(value).isNotNull()).select(*well, depth, F.col(value).alias("new_depth"))
    usable = axis.groupBy(*well).agg(F.count(F.lit(1)).alias("__n")).filter("__n >= 2").select(*well)
    return df.join(axis.join(usable, well, "left_semi"), [*well, depth])


def piecewise_map(anchors: DataFrame, asks: DataFrame, keys: Sequence[str], *, depth: str = "depth", position: str = "y", width: int = DEPTH_BLOCK) -> DataFrame:
    """Depth to position through averaged anchors, clamped outside."""
    knots = anchors.groupBy(*keys, depth).agg((F.sum(position) / F.count(position)).alias(position))
    return resample(knots, asks, keys, depth=depth, value=position, width=width)


def order_breaks(df: DataFrame, keys: Sequence[str], *, top: str = "top_cm", base: str = "base_cm", tie: Sequence[str] = ()) -> DataFrame:
    """Rows that start above the deepest base before them."""
    seen = running(df, keys, [top, base, *tie], {"__low": ("max", base)})
    return seen.filter(F.col(top) < F.col("__low")).withColumnRenamed("__low", "previous_base_cm")


def true_runs(df: DataFrame, keys: Sequence[str], flag: str, order: str, *, width: int = DEPTH_BLOCK) -> DataFrame:
    """Islands of consecutive true rows: first position, last position, length."""
    runs = chains(
        df.withColumn("__one", F.lit(1).cast("bigint")).withColumn("__flag", F.col(flag)), keys, [order],
        lambda prev, cur: prev["__flag"] == cur["__flag"],
        {"run_start": ("min", order), "run_end": ("max", order), "run_rows": ("sum", "__one")}, keep=["__flag"], width=width)
    return runs.filter("__flag").drop("__flag")


def moving_average(
    df: DataFrame, keys: Sequence[str], order: str, value: str, half: int, *, pad: str = "edge", out: str = "smooth", width: int = DEPTH_BLOCK,
) -> DataFrame:
    """Centred mean over ``2*half+1`` rows, ends padded by edge values or zeros.

    Rows are numbered, and each goes also to the neighbouring block it is a halo of, so
    windows stay inside blocks.
    """
    keys = list(keys)
    size = max(4 * half + 2, 8192)
    rows = numbered(df, keys, [order], "__pos", width=width)
    blocks = F.array_distinct(F.transform(F.array(F.lit(-half), F.lit(0), F.lit(half)), lambda d: F.floor((F.col("__pos") + d) / size)))
    spread = rows.withColumn("__own", F.floor(F.col("__pos") / size)).withColumn(BLOCK, F.explode(blocks))
    frame = W.partitionBy(*keys, BLOCK).orderBy("__pos").rowsBetween(-half, half)
    ends = df.groupBy(*keys).agg(F.min_by(value, order).alias("__first"), F.max_by(value, order).alias("__last"), F.count(F.lit(1)).alias("__n"))
    summed = spread.withColumn("__s", F.sum(value).over(frame)).filter(F.col(BLOCK) == F.col("__own")).join(ends, keys)
    before = F.greatest(F.lit(0), F.lit(half + 1) - F.col("__pos"))
    after = F.greatest(F.lit(0), F.col("__pos") + half - F.col("__n"))
    total = F.col("__s")
    if pad == "edge":
        total = total + before * F.col("__first") + after * F.col("__last")
    return summed.withColumn(out, total / F.lit(2 * half + 1)).select(*df.columns, out)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], *, width: int = DEPTH_BLOCK) -> DataFrame:
    """Exact linearly interpolated quantiles per key from counts of distinct values."""
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    before = running(counts, keys, [value], {"__b": ("sum", "__c")}, width=width)
    totals = counts.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    ranked = before.join(totals, keys)
    aggs = []
    for name, p in probs.items():
        pos = (F.col("__n") - 1) * F.lit(p)
        lo = F.floor(pos)
        hi = F.least(lo + 1, F.col("__n") - 1)
        holds = lambda r: (F.col("__b") <= r) & (r < F.col("__b") + F.col("__c"))
        low, high, part = F.max(F.when(holds(lo), F.col(value))), F.max(F.when(holds(hi), F.col(value))), F.max(pos - lo)
        aggs.append((low + (high - low) * part).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def robust_scale(df: DataFrame, keys: Sequence[str], value: str, *, out: str = "scaled", flat: float = 1e-6) -> DataFrame:
    """Scale to [0, 1] by the 5 % and 95 % quantiles, 0.5 where flat."""
    q = quantiles(df, keys, value, {"__q05": 0.05, "__q95": 0.95})
    span = F.col("__q95") - F.col("__q05")
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - F.col("__q05")) / span))
    return df.join(q, list(keys)).withColumn(out, F.when(span < flat, F.lit(0.5)).otherwise(scaled)).drop("__q05", "__q95")


def spaced_peaks(peaks: DataFrame, keys: Sequence[str], position: str, strength: str, distance: str) -> DataFrame:
    """Strongest first, then nothing nearer than ``distance``: greedy suppression by rounds.

    A round keeps every peak stronger than all remaining peaks within its distance and
    drops the peaks it shadows; equal strength goes to the smaller position.  Peaks meet
    only inside neighbouring bins of the distance.
    """
    keys = list(keys)
    spark = peaks.sparkSession
    ensure_checkpoint_dir(spark)
    left = peaks.select(*keys, F.col(position).alias("__p"), F.col(strength).alias("__s"), F.col(distance).alias("__d")).checkpoint()
    chosen = left.limit(0)
    while not left.isEmpty():
        here = left.withColumn("__bin", F.floor(F.col("__p") / F.col("__d")))
        near = here.select(*keys, F.col("__p").alias("__q"), F.col("__s").alias("__t"), F.explode(F.array(*[F.col("__bin") + d for d in (-1, 0, 1)])).alias("__bin"))
        rival = (F.abs(F.col("__p") - F.col("__q")) < F.col("__d")) & (
            (F.col("__t") > F.col("__s")) | ((F.col("__t") == F.col("__s")) & (F.col("__q") < F.col("__p"))))
        beaten = here.join(near, [*keys, "__bin"]).filter(rival).select(*keys, "__p").distinct()
        won = left.join(beaten, [*keys, "__p"], "left_anti").checkpoint()
        shade = won.withColumn("__bin", F.floor(F.col("__p") / F.col("__d"))).select(
            *keys, F.col("__p").alias("__q"), F.explode(F.array(*[F.col("__bin") + d for d in (-1, 0, 1)])).alias("__bin"))
        dark = here.join(shade, [*keys, "__bin"]).filter(F.abs(F.col("__p") - F.col("__q")) < F.col("__d")).select(*keys, "__p").distinct()
        chosen = chosen.unionByName(won)
        left = left.join(dark, [*keys, "__p"], "left_anti").checkpoint()
    return chosen.select(*keys, F.col("__p").alias(position), F.col("__s").alias(strength))


def change_points(
    df: DataFrame, keys: Sequence[str], order: str, first: str, second: str, *, half: int = 2, min_rows: int = 28, min_share: float = 0.075,
    width: int = DEPTH_BLOCK,
) -> DataFrame:
    """Sustained changes of two signals down a series (W22): (keys, boundary row, change).

    The change is the smoothed absolute step of the first scaled signal plus 0.65 of the
    second's; peaks reach max(94 % quantile, median + 1.85 MAD) and keep their distance.
    Changes are held in millionths so that quantiles count exact values.
    """
    keys = list(keys)
    scaled = robust_scale(robust_scale(df, keys, first, out="__a"), keys, second, out="__b")
    rows = numbered(scaled.select(*keys, order, "__a", "__b"), keys, [order], "__i", width=width).withColumn(
        "__ab", F.struct(F.col("__a").alias("a"), F.col("__b").alias("b")))
    step = running(rows, keys, ["__i"], {"__prev": ("last", "__ab")}, width=width)
    raw = F.abs(F.col("__a") - F.col("__prev.a")) + 0.65 * F.abs(F.col("__b") - F.col("__prev.b"))
    change = step.withColumn("__raw", F.floor(F.coalesce(raw, F.lit(0.0)) * 1e6 + 0.5).cast("bigint")).select(*keys, "__i", "__raw")
    smooth = moving_average(change, keys, "__i", "__raw", half, out="__m", width=width)
    smooth = smooth.select(*keys, "__i", F.floor(F.col("__m") + 0.5).cast("bigint").alias("change")).checkpoint()
    mid = quantiles(smooth, keys, "change", {"__q94": 0.94, "__med": 0.5})
    dev = smooth.join(mid, keys).withColumn("__dev", F.floor(F.abs(F.col("change") - F.col("__med")) * 2 + 0.5).cast("bigint"))
    mad = quantiles(dev, keys, "__dev", {"__mad": 0.5})
    size = smooth.groupBy(*keys).agg(F.max("__i").alias("__n"))
    neighbours = running(smooth.withColumn("__v", F.col("change")), keys, ["__i"], {"__up": ("last", "__v")}, width=width)
    neighbours = running(neighbours, keys, ["__i"], {"__down": ("last", "__v")}, width=width, reverse=True)
    limit = F.greatest(F.col("__q94"), F.col("__med") + 1.85 * F.col("__mad") / 2)
    gap = F.greatest(F.lit(min_rows), F.floor(F.col("__n") * F.lit(min_share))).cast("bigint")
    at = F.col("__i") - 1
    peaks = (
        neighbours.join(mid, keys).join(mad, keys).join(size, keys).withColumn("__gap", gap)
        .filter((F.col("change") >= limit) & (F.col("change") >= F.col("__up")) & (F.col("change") >= F.col("__down")))
        .filter((at >= 2) & (at < F.col("__n") - 2) & (at >= F.col("__gap")) & (F.col("__n") - at >= F.col("__gap")))
        .select(*keys, at.alias("boundary"), "change", "__gap"))
    return spaced_peaks(peaks, keys, "boundary", "change", "__gap")


def texture_evidence(brightness: Column, lamination: Column) -> Column:
    """Evidence class of a segment from its mean signals."""
    return (
        F.when(lamination >= 0.58, "high lamination density").when(brightness >= 0.64, "pale comparatively uniform texture")
        .when(brightness <= 0.35, "dark comparatively uniform texture").otherwise("persistent change of visual texture"))


def continuation_groups(
    df: DataFrame, well: str, order: Sequence[str], *, index: str, photo: str, prediction: str, top: str = "top_cm", base: str = "base_cm",
    text: str = "description", name: str = "facies_name",
) -> DataFrame:
    """Touching intervals of one class across photos: one text and the total span."""
    def linked(prev, cur):
        return (
            (F.lower(prev[index]) == F.lower(cur[index])) & (prev[base] == cur[top])
            & ((prev[photo] != cur[photo]) | (prev[prediction] == cur[prediction])))

    told = F.when(F.trim(F.coalesce(text, F.lit(""))) != "", F.struct(*[F.col(c) for c in order], F.trim(text).alias("t")))
    rows = df.withColumns({"__told": told, "__one": F.lit(1).cast("bigint")})
    groups = chains(
        rows, [well], order, linked,
        {"group_top_cm": ("min", top), "group_base_cm": ("max", base), "rows": ("sum", "__one"), "__text": ("min", "__told")}, keep=[index, name])
    return groups.withColumn(text, F.coalesce(F.col("__text.t"), F.trim(name))).withColumn(
        "thickness_cm", F.greatest(F.lit(0), F.col("group_base_cm") - F.col("group_top_cm"))).drop("__text")


def accept_generated(groups: DataFrame, generate, inputs: Sequence[str], *, fallback: str = "description", least: float = 0.10) -> DataFrame:
    """Run a user's pandas UDF (struct<text, confidence>) per group; weak answers fall back."""
    made = groups.withColumn("__g", generate(*[F.col(c) for c in inputs]))
    good = (F.trim(F.coalesce("__g.text", F.lit(""))) != "") & (F.coalesce("__g.confidence", F.lit(0.0)) >= least)
    return made.withColumns({
        fallback: F.when(good, F.trim("__g.text")).otherwise(F.col(fallback)), "generated": good}).drop("__g")


def restack(df: DataFrame, well: str, position: str, *, top: str = "top_cm", base: str = "base_cm") -> DataFrame:
    """Stack layers contiguously in ``position`` order with their own thicknesses."""
    spans = df.withColumn("__span", F.col(base) - F.col(top))
    above = running(spans, [well], [position], {"__above": ("sum", "__span")})
    start = df.groupBy(well).agg(F.min(top).alias("__from"))
    return above.join(start, well).withColumns({
        top: F.col("__from") + F.col("__above"), base: F.col("__from") + F.col("__above") + F.col("__span")}).select(*df.columns)


def swap_neighbours(df: DataFrame, moves: DataFrame, well: str, position: str) -> DataFrame:
    """Exchange each moved position (one per well) with the next one."""
    shifted = df.join(moves.select(well, F.col(position).alias("__m")), well, "left")
    at = F.col(position)
    return shifted.withColumn(
        position, F.when(at == F.col("__m"), at + 1).when(at == F.col("__m") + 1, at - 1).otherwise(at)).drop("__m")
