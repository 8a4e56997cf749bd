"""Data past the limits that readers and scans once had, and folds against plain loops."""

import random

from pyspark.sql import functions as F

from depthlake.functions import text as T
from depthlake.operators import boxes, calibrate, scan, series
from depthlake.sources import cells, lines, listing


def test_wide_and_quoted_lines(spark):
    wide = ";".join(f"v{i}" for i in range(80))
    rows = spark.createDataFrame([("a.csv", 1, wide), ("a.csv", 2, 'x;"y;""z""";;"";w'), ("b.tsv", 1, "one, two, three\tfour")], "file string, line_no long, line string")
    got = {(r.file, r.row, r.col): r.value for r in lines.delimited_cells(rows, lines.sniff_separators(rows)).collect()}
    assert [got["a.csv", 1, c] for c in range(1, 81)] == [f"v{i}" for i in range(80)]
    assert {k[2]: v for k, v in got.items() if k[:2] == ("a.csv", 2)} == {1: "x", 2: 'y;"z"', 5: "w"}
    assert {k[2]: v for k, v in got.items() if k[0] == "b.tsv"} == {1: "one, two, three", 2: "four"}


def test_rows_without_a_position_stay(spark):
    rows = spark.createDataFrame([("w", 5, 1), ("w", None, 2), ("w", 2000, 3)], "well string, top_cm long, layer_id long")
    got = {r.layer_id: r.n for r in scan.numbered(rows, ["well"], ["top_cm", "layer_id"], "n").collect()}
    assert got == {2: 1, 1: 2, 3: 3}


def test_long_digit_runs_and_captions(spark):
    a, b = "p" + "1" * 30, "p" + "1" * 29 + "2"
    long = "x" * (1 << 20) + " 1500-1510"
    row = spark.range(1).select(
        (T.natural_key(F.lit(a)) < T.natural_key(F.lit(b))).alias("less"), (T.natural_key(F.lit("p2")) < T.natural_key(F.lit("p010"))).alias("by_value"),
        T.caption_interval(F.lit("Core interval\n" + "1500-1510")).alias("short"), T.caption_interval(F.lit("Core interval\n" + long)).alias("long")).first()
    assert row.less and row.by_value
    assert row.short == row.long and row.long.basis == "unknown"


def test_five_wrappers(spark):
    rows = spark.createDataFrame([(f"/r/photos/image/images/photo/photos/w{i}/p.jpg",) for i in range(3)], "path string")
    assert {r.group for r in listing.photo_groups(rows, "/r").collect()} == {f"photos/image/images/photo/photos/w{i}" for i in range(3)}


def test_resampling_skips_missing_samples(spark):
    source = spark.createDataFrame([("w", 0, 0.0), ("w", 10, None), ("w", 20, 20.0), ("w", None, 3.0)], "well string, depth long, v double")
    asks = spark.createDataFrame([("w", 5), ("w", 15)], "well string, depth long")
    assert {r.depth: r.v for r in series.resample(source, asks, ["well"]).collect()} == {5: 5.0, 15: 15.0}


def test_second_merge_takes_the_next_number(spark):
    base = spark.createDataFrame([("w", "gr", 0, 1.0), ("w", "gr", 10, 2.0)], "well string, curve string, depth long, v double")
    once = series.merge_logs(base, base, ["well"])
    twice = series.merge_logs(once, base, ["well"])
    assert sorted((r.curve, r.depth) for r in twice.collect()) == [(c, d) for c in ("gr", "gr_2", "gr_3") for d in (0, 10)]


def test_lane_fold_matches_a_loop(spark):
    rng = random.Random(4)
    rows = []
    for photo in range(6):
        for i in range(25):
            left, top = rng.randrange(0, 300), rng.randrange(0, 500)
            rows.append((photo, i, left, top, left + rng.randrange(0, 80), top + rng.randrange(1, 90)))
    df = spark.createDataFrame(rows, "photo long, i long, left long, top long, right long, bottom long")
    for by in ("left", "centre"):
        want = []
        for photo in range(6):
            lanes = []
            for _, _, l, t, r, b in sorted((x for x in rows if x[0] == photo), key=lambda x: (x[2] if by == "left" else x[2] + x[4], x[3], x[1])):  # noqa: E741
                for k, (a, c, d, e) in enumerate(lanes):
                    narrow = min(r - l, d - a)
                    if narrow > 0 and min(r, d) - max(l, a) >= 0.55 * narrow and abs(l + r - a - d) / 2 <= max(5.0, 0.48 * narrow):
                        lanes[k] = (min(a, l), min(c, t), max(d, r), max(e, b))
                        break
                else:
                    lanes.append((l, t, r, b))
            want += [(photo, *x) for x in lanes]
        assert sorted(tuple(r) for r in boxes.merge_lanes(df, "i", by=by).collect()) == sorted(want)
    lanes, found = [r for r in rows if r[1] < 3], [r for r in rows if r[1] >= 3]
    free = [f[:2] for f in found if not any(l[0] == f[0] and min(l[4], f[4]) - max(l[2], f[2]) >= 0.58 * min(l[4] - l[2], f[4] - f[2]) for l in lanes)]  # noqa: E741
    assert 0 < len(free) < len(found)
    assert sorted((r.photo, r.i) for r in boxes.outside_lanes(df.filter("i >= 3"), df.filter("i < 3")).collect()) == sorted(free)


def test_packing_is_all_or_nothing(spark):
    cores = spark.createDataFrame([("a", 0, 100), ("a", 150, 200), ("b", 0, 100), ("c", 0, 100)], "well string, top_cm long, base_cm long")
    photos = spark.createDataFrame(
        [("a", 1, 11, 60), ("a", 2, 12, 41), ("a", 3, 13, 50), ("b", 1, 21, 60), ("b", 2, 22, 50), ("c", 1, 31, 60)], "well string, pos long, photo long, capacity_cm long")
    got = sorted((r.photo, r.top_cm, r.base_cm, r.core_no) for r in calibrate.pack_wells(photos, cores).collect())
    assert got == [(11, 0, 60, 0), (12, 60, 100, 0), (13, 150, 200, 1)]


def test_import_rules(spark):
    texts = {"интервал фации кровля": {"facies_top": 120, "facies_interval": 90}, "отбор керна от": {"core_top": 100, "facies_top": 0}, "глубина до": {"facies_base": 65}, "литологическое описание 16 параметр": {"description": 0, "lithology_description": 140}}
    for text, wanted in texts.items():
        row = spark.range(1).select(*[cells.import_role_score(F.lit(text), role).alias(role) for role in wanted]).first()
        assert row.asDict() == wanted


def test_a_band_grows_before_the_next_fragment_is_compared(spark):
    from depthlake.operators import intervals

    rows = [(1, 1, "a", 0, 50, 0, 100, 9, False), (1, 2, "a", 52, 90, 60, 100, 7, False), (1, 3, "a", 92, 130, 0, 65, 8, False), (1, 4, "a", 131, 134, 0, 65, 1, False), (1, 5, "a", 10, 12, 0, 9, 5, True)]
    df = spark.createDataFrame(rows, "photo long, det long, label string, top long, bottom long, left long, right long, conf long, reviewed boolean")
    got = intervals.merge_fragments(df, ["photo"], ["label"], ["det"], min_height=F.lit(5), confidence="conf", reviewed=F.col("reviewed")).collect()
    assert sorted((r.top, r.bottom, r.left, r.right, r.conf, r.merged_rows) for r in got) == [(0, 130, 0, 100, 7, 3), (10, 12, 0, 9, 5, 1)]
