"""The gap-free partition of core columns against a plain loop over contacts."""

import random

from depthlake.operators import boxes as B


def plain(columns, detections):
    """Per column: bands (label, structure, top, bottom, confidence), one contact after the other."""
    made = {}
    for photo, col, left, top, right, bottom in columns:
        if right <= left or bottom <= top:
            continue
        held = []
        for place, (_, _, label, conf, structure, l, t, r, b) in enumerate(sorted((d for d in detections if d[0] == photo), key=lambda d: d[1])):
            wide = min(r, right) - max(l, left)
            share = wide / max(1.0, min(r - l, right - left))
            t, b = max(t, top), min(b, bottom)
            if (label or "").strip() and wide > 0 and b - t > 0.25 and share >= 0.15:
                held.append((t, b, structure, label, conf, (structure is not None, conf * share, share, conf, -place)))
        contacts = sorted({top, bottom, *(h[0] for h in held), *(h[1] for h in held)})
        bands = []
        for t, b in zip(contacts, contacts[1:]):
            over = [h for h in held if h[0] <= (t + b) / 2 < h[1]]
            best = max(over, key=lambda h: h[5]) if over else None
            band = [best[3], best[2], t, b, min(1, best[4])] if best else ["none", None, t, b, 0]
            if bands and bands[-1][:2] == band[:2]:
                bands[-1][3], bands[-1][4] = b, min(bands[-1][4], band[4])
            else:
                bands.append(band)
        made[photo, col] = [tuple(x) for x in bands]
    return made


def test_columns_are_covered_as_by_a_plain_loop(spark):
    rng = random.Random(11)
    columns = [(p, c, 100.0 * c, 10.0, 100.0 * c + 90, 400.0) for p in range(6) for c in range(3)] + [(0, 7, 5.0, 5.0, 5.0, 50.0)]
    detections = []
    for i in range(300):
        left, top = rng.randrange(280), rng.randrange(-20, 400)
        label = rng.choice(["a", "b", "c", " ", None]) if i % 9 else "a"
        detections.append((rng.randrange(5), i, label, rng.choice([0.5, 0.75, 1.5]), rng.choice([None, None, "p", "q"]),
                           float(left), float(top), float(left + rng.choice([4, 30, 120])), top + rng.choice([0.25, 0.5, 20.0, 90.0])))
    given = spark.createDataFrame(columns, "photo long, column long, left double, top double, right double, bottom double")
    found = spark.createDataFrame(detections, "photo long, det long, label string, conf double, structure string, left double, top double, right double, bottom double")
    got = {}
    for r in B.complete_columns(given, found, gap_label="none").orderBy("top").collect():
        got.setdefault((r.photo, r.column), []).append((r.label, r.structure, r.top, r.bottom, r.conf))
        assert r.gap_filled == (r.label == "none")
    assert got == plain(columns, detections)
    assert got[5, 0] == [("none", None, 10.0, 400.0, 0.0)]


def test_columns_without_detections_or_scale(spark):
    given = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 100.0), (1, 1, 20.0, 0.0, 30.0, 100.0)], "photo long, column long, left double, top double, right double, bottom double")
    found = spark.createDataFrame([], "photo long, det long, label string, conf double, structure string, left double, top double, right double, bottom double")
    scale = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 50.0, 12.0, 11.0), (1, 1, 5.0, 0.0, 15.0, 50.0, 90.0, 91.0)], "photo long, order long, left double, top double, right double, bottom double, depth_from double, depth_to double")
    rows = B.complete_columns(given, found, gap_label="none", depths=scale).orderBy("column").collect()
    assert [(r.top, r.bottom, r.depth_from, r.depth_to) for r in rows] == [(0.0, 100.0, 10.0, 12.0), (0.0, 100.0, None, None)]
