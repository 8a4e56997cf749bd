"""Polygon expressions on ``array<struct<x, y>>`` and box arithmetic."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from depthlake.functions.numbers import let


def _next(poly: Column, i: Column) -> Column:
    return F.get(poly, (i + 1) % F.size(poly))


def open_ring(poly: Column) -> Column:
    """Polygon without a repeated closing vertex."""
    return F.when((F.size(poly) > 1) & (F.get(poly, 0) == F.element_at(poly, -1)), F.slice(poly, F.lit(1), F.size(poly) - 1)).otherwise(poly)


def twice_area(poly: Column) -> Column:
    """Twice the signed shoelace area."""
    def total(ring):
        terms = F.transform(ring, lambda p, i: p["x"] * _next(ring, i)["y"] - _next(ring, i)["x"] * p["y"])
        return let(terms, lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.get(v, 0) * 0, lambda acc, x: acc + x)))

    return let(poly, total)


def area(poly: Column) -> Column:
    """Absolute polygon area (A1)."""
    return F.abs(twice_area(poly)) / 2


def bounds(poly: Column) -> Column:
    """Bounding box struct<left, top, right, bottom> (A1)."""
    def box(ring):
        xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
        return F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("top"), F.array_max(xs).alias("right"), F.array_max(ys).alias("bottom"))

    return let(poly, box)


def _turn(a, b, c):
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def _on(a, b, c):
    return (
        (F.least(a["x"], b["x"]) <= c["x"]) & (c["x"] <= F.greatest(a["x"], b["x"]))
        & (F.least(a["y"], b["y"]) <= c["y"]) & (c["y"] <= F.greatest(a["y"], b["y"])))


def edges(poly: Column) -> Column:
    return let(poly, lambda ring: F.transform(ring, lambda p, i: F.struct(i.alias("i"), p.alias("a"), _next(ring, i).alias("b"))))


def self_intersects(poly: Column, eps: float = 1e-9) -> Column:
    """Any two non-adjacent edges cross or touch (A2)."""
    def test(all_edges):
        n = F.size(all_edges)

        def hit(e, f):
            a, b, c, d = e["a"], e["b"], f["a"], f["b"]
            p, q, r, s = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
            touch = F.lit(False)
            for v, u, w, z in ((p, a, b, c), (q, a, b, d), (r, c, d, a), (s, c, d, b)):
                touch = touch | ((F.abs(v) < eps) & _on(u, w, z))
            return ((p * q < 0) & (r * s < 0)) | touch

        return F.exists(all_edges, lambda e: F.exists(all_edges, lambda f: (
            (f["i"] >= e["i"] + 2) & ~((e["i"] == 0) & (f["i"] == n - 1)) & hit(e, f))))

    return let(edges(poly), test)


def geometry_problem(poly: Column, width: Column, height: Column) -> Column:
    """First failed check of a drawn contour, NULL when valid (A2)."""
    def check(ring):
        finite = F.forall(ring, lambda p: F.coalesce((F.abs(p["x"].cast("double")) < 1e300) & (F.abs(p["y"].cast("double")) < 1e300), F.lit(False)))
        outside = F.exists(ring, lambda p: (p["x"] < 0) | (p["y"] < 0) | (p["x"] > width) | (p["y"] > height))
        box = bounds(ring)
        return (
            F.when((F.size(ring) < 3) | ~finite, "too few or non-finite vertices")
            .when(F.size(F.array_distinct(ring)) != F.size(ring), "repeated vertices")
            .when(outside, "outside the image")
            .when((area(ring) < 4) | (box["right"] - box["left"] < 4) | (box["bottom"] - box["top"] < 4), "too small")
            .when(self_intersects(ring), "self-intersection"))

    return let(open_ring(poly), check)


def canonical_polygon(poly: Column, digits: int | None = None) -> Column:
    """Smallest rotation of the ring read in either direction (A4)."""
    def best(ring):
        turns = lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 1), lambda i: F.concat(
            F.slice(r, i + 1, F.size(r)), F.slice(r, F.lit(1), i)))
        return F.when(F.size(ring) > 0, F.least(F.array_min(turns(ring)), F.array_min(turns(F.reverse(ring))))).otherwise(ring)

    rounded = poly if digits is None else F.transform(
        poly, lambda p: F.struct(F.bround(p["x"], digits).alias("x"), F.bround(p["y"], digits).alias("y")))
    return let(open_ring(rounded), best)


def polygon_text(poly: Column) -> Column:
    return F.array_join(F.transform(poly, lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), ";")


def shared_area(a: tuple, b: tuple) -> Column:
    """Intersection area of two boxes given as (left, top, right, bottom) columns."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def box_area(a: tuple) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def iou(a: tuple, b: tuple) -> Column:
    """Intersection over union of two boxes (A5)."""
    both = shared_area(a, b)
    return both / F.greatest(F.lit(1), box_area(a) + box_area(b) - both)


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a column and where there are none."""
    return pc.fill_null(column.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def _half_plane(points: list, owner: np.ndarray, axis: int, edge: np.ndarray, known: np.ndarray, least: bool) -> tuple[list, np.ndarray]:
    """Rings, one after another, cut at an edge each; ``points`` holds (values, missing) of x and y, ``owner`` the ring of a vertex."""
    if not len(owner):
        return points, owner
    (at, gone), (other, lost) = points[axis], points[1 - axis]
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    prev = np.arange(len(owner)) - 1
    prev[first] = np.r_[first[1:], len(owner)] - 1
    e, told = edge[owner], known[owner] & ~gone
    inside = (at >= e) | np.isnan(at) if least else (at <= e) | np.isnan(e)
    crossing = told & told[prev] & (inside != inside[prev])
    with np.errstate(all="ignore"):
        ratio = (e - at[prev]) / (at - at[prev])
        met = at[prev] + ratio * (at - at[prev]), other[prev] + ratio * (other - other[prev])
    taken = np.stack([crossing, told & inside], 1).ravel()
    both = lambda a, b: np.stack([a, b], 1).ravel()[taken]
    cut = [(both(met[0], at), both(np.zeros_like(gone), gone)), (both(met[1], other), both(lost | lost[prev], lost))]
    return cut if axis == 0 else cut[::-1], np.repeat(owner, 2)[taken]


POINT = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])


@arrow_udf(StructType([StructField("ring", ArrayType(POINT)), StructField("twice_area", DoubleType())]))
def clipped(poly: pa.Array, left: pa.Array, top: pa.Array, right: pa.Array, bottom: pa.Array) -> pa.Array:
    """Polygon cut to a box, one half-plane after the other, and twice its signed area, NULL without a vertex.

    Each side looks only at a vertex and the vertex before it, so a side is a few array operations
    over the vertices of all polygons of a batch.
    """
    size = pc.fill_null(pc.list_value_length(poly), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(poly)), size)
    vertices = poly.flatten()
    points = [_values(pc.struct_field(vertices, c)) for c in ("x", "y")]
    for axis, edge, least in ((0, left, True), (0, right, False), (1, top, True), (1, bottom, False)):
        value, missing = _values(edge)
        points, owner = _half_plane(points, owner, axis, value, ~missing, least)
    (x, no_x), (y, no_y) = points
    size = np.bincount(owner, minlength=len(poly))
    end = np.cumsum(size)
    following = np.arange(1, len(owner) + 1)
    following[end[size > 0] - 1] = (end - size)[size > 0]
    with np.errstate(all="ignore"):
        twice = np.bincount(owner, weights=x * y[following] - x[following] * y, minlength=len(poly))
    part = np.bincount(owner, weights=no_x | no_y, minlength=len(poly)) > 0
    ring = pa.ListArray.from_arrays(
        pa.array(np.r_[0, end].astype(np.int32)), pa.StructArray.from_arrays([pa.array(x, mask=no_x), pa.array(y, mask=no_y)], ["x", "y"]),
        mask=poly.is_null())
    return pa.StructArray.from_arrays([ring, pa.array(twice, mask=(size == 0) | part)], ["ring", "twice_area"])


def clip_polygon(poly: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Polygon cut to a box."""
    return clipped(poly, left, top, right, bottom)["ring"]


def normalise_polygon(poly: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Vertices in [0, 1] of a box, clamped."""
    unit = lambda v, a, b: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - a) / (b - a)))
    return F.transform(poly, lambda p: F.struct(unit(p["x"], left, right).alias("x"), unit(p["y"], top, bottom).alias("y")))


def thin_polygon(poly: Column, limit: int = 500) -> Column:
    """At most ``limit`` vertices by stride (A10)."""
    step = F.greatest(F.lit(1), F.rint(F.size(poly) / limit).cast("int"))
    return F.when(F.size(poly) <= limit, poly).otherwise(F.slice(F.filter(poly, lambda p, i: i % step == 0), 1, limit))


def minimum_span(y0: Column, y1: Column, top: Column, bottom: Column, least: float = 2.0) -> Column:
    """Widen a thin vertical span about its centre inside the column."""
    need = F.least(F.lit(least), F.greatest(F.lit(0.0), (bottom - top).cast("double")))
    first = F.greatest(top.cast("double"), (y0 + y1) / 2.0 - need / 2.0)
    last = F.least(bottom.cast("double"), first + need)
    wide = F.struct(F.greatest(top.cast("double"), last - need).alias("y0"), last.alias("y1"))
    return F.when(y1 - y0 >= need, F.struct(y0.cast("double").alias("y0"), y1.cast("double").alias("y1"))).otherwise(wide)


@arrow_udf(StructType([StructField(name, LongType()) for name in ("area", "left", "top", "right", "bottom")]))
def rle_stats(runs: pa.Array, height: pa.Array, width: pa.Array) -> pa.Array:
    """Foreground area and bounding box of column-major run lengths; NULL when they fall short."""
    n = len(runs)
    h, w = (pc.fill_null(c, 0).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in (height, width))
    size = pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False)
    owner, begin = np.repeat(np.arange(n), size), np.cumsum(size) - size
    values = runs.flatten()
    length = pc.fill_null(values, -1).cast(pa.int64()).to_numpy(zero_copy_only=False)
    total = np.where((h > 0) & (w > 0), h * w, 0)
    # A run beyond the end of its mask counts as one that reaches it, so sums stay small.
    sums = np.r_[0, np.cumsum(np.clip(length, 0, total[owner]))]
    ends = np.minimum(sums[1:] - sums[begin][owner], total[owner])
    starts = np.minimum(sums[:-1] - sums[begin][owner], total[owner])
    whole = (total > 0) & (sums[begin + size] - sums[begin] >= total) & (np.bincount(owner, weights=length < 0, minlength=n) == 0)
    ink = ((np.arange(len(owner)) - begin[owner]) % 2 == 1) & (ends > starts) & whole[owner]
    of, first, last = owner[ink], starts[ink], ends[ink] - 1
    high = h[of]
    tall = first // high != last // high
    area, low, far = np.zeros(n, np.int64), np.full((2, n), np.iinfo(np.int64).max), np.zeros((2, n), np.int64)
    np.add.at(area, of, last - first + 1)
    for i, (least, most) in enumerate(((first // high, last // high), (np.where(tall, 0, first % high), np.where(tall, high - 1, last % high)))):
        np.minimum.at(low[i], of, least)
        np.maximum.at(far[i], of, most + 1)
    bare = ~whole | (area == 0)
    return pa.StructArray.from_arrays(
        [pa.array(area, mask=~whole), *[pa.array(c, mask=bare) for c in (*low, *far)]], ["area", "left", "top", "right", "bottom"])


def _runs_of(text: str | None):
    """Run lengths of one compressed string; None when malformed."""
    if text is None:
        return None
    runs: list[int] = []
    value = shift = 0
    for ch in text:
        code = ord(ch) - 48
        value |= (code & 31) << shift
        shift += 5
        if shift > 65:
            return None
        if code & 32:
            continue
        if code & 16:
            value -= 1 << shift
        runs.append(value + (runs[-2] if len(runs) > 2 else 0))
        value = shift = 0
    return runs if shift == 0 else None


@pandas_udf(ArrayType(LongType()))
def rle_runs(counts: pd.Series) -> pd.Series:
    """Compressed run-length text to run lengths."""
    return counts.map(_runs_of)


def mask_size(poly: Column, width: Column, height: Column) -> Column:
    """'small' or 'large' mask, NULL otherwise."""
    def kind(box):
        w, h = box["right"] - box["left"], box["bottom"] - box["top"]
        share = (w * h) / F.greatest(F.lit(1.0), (width * height).cast("double"))
        return F.when((w < 5) | (h < 5) | (share < 0.00025), "small").when(share > 0.90, "large")

    return F.when(F.size(poly) >= 3, let(bounds(poly), kind))


def contains_point(poly: Column, x: Column, y: Column) -> Column:
    """Odd-even rule."""
    crosses = F.filter(edges(poly), lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (
        x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]))
    return F.size(crosses) % 2 == 1


def rectangle(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(point(left, top), point(right, top), point(right, bottom), point(left, bottom))


def depth_to_pixels(depth_cm: Column, seg_top: Column, seg_bottom: Column, top_cm: Column, base_cm: Column) -> Column:
    """Pixel row of a depth inside a calibrated segment."""
    return seg_top + (depth_cm - top_cm) * (seg_bottom - seg_top) / (base_cm - top_cm)


def pixels_to_cm(y: Column, seg_top: Column, seg_bottom: Column, top_cm: Column, base_cm: Column) -> Column:
    """Whole-centimetre depth of a pixel row, half to even."""
    return top_cm + F.rint((y - seg_top) * (base_cm - top_cm) / F.greatest(F.lit(1.0), (seg_bottom - seg_top).cast("double"))).cast("bigint")


def yolo_line(class_id: Column, poly: Column, width: Column, height: Column) -> Column:
    """``class x1 y1 ...`` in image fractions, six decimals, clamped (K3)."""
    unit = normalise_polygon(poly, F.lit(0), F.lit(0), width, height)
    return F.concat_ws(" ", class_id.cast("string"), F.array_join(F.transform(unit, lambda p: F.format_string("%.6f %.6f", p["x"], p["y"])), " "))
