"""Matching and packing on the known small cases."""

import random
import tempfile

from pyspark.sql import functions as F

from depthlake.operators import calibrate as K, joins as J

LAYERS = "layer_id string, well string, top_cm long, base_cm long, gis_top_cm long, gis_base_cm long, thickness_cm long, thickness_valid boolean, primary_gis boolean"
PHOTOS = "photo string, well string, top_cm long, base_cm long, depth_basis string"


def matched(spark, layers, photos):
    got = J.match_photos(spark.createDataFrame(photos, PHOTOS), spark.createDataFrame(layers, LAYERS)).collect()
    return sorted((r["layer_id"], r["overlap_top_cm"], r["overlap_base_cm"], r["basis"]) for r in got)


def test_depth_systems_do_not_mix(spark):
    layers = [("A", "w", 10000, 10100, 9950, 10050, None, True, False), ("B", "w", 10100, 10200, 10050, 10150, None, True, False)]
    assert matched(spark, layers, [("p", "w", 10000, 10100, "unknown")]) == [("A", 10000, 10100, "drilling")]
    assert matched(spark, layers, [("p", "w", 10000, 10100, "gis")]) == [("A", 10000, 10050, "gis"), ("B", 10050, 10100, "gis")]
    far = [("A", "w", 10000, 10100, 20000, 20100, None, True, False)]
    assert matched(spark, far, [("p", "w", 20000, 20100, "unknown")]) == [("A", 20000, 20100, "gis")]
    off = [("A", "w", 10000, 10100, 20000, 20101, 100, True, False)]
    assert matched(spark, off, [("p", "w", 20000, 20100, "unknown")]) == []


def packed(spark, capacities, cores):
    photos = spark.createDataFrame([(f"p{i}", "w", i, c) for i, c in enumerate(capacities)], "photo string, well string, pos long, capacity_cm long")
    ranges = spark.createDataFrame([("w", a, b) for a, b in cores], "well string, top_cm long, base_cm long")
    return [(r["top_cm"], r["base_cm"]) for r in K.pack_wells(photos, ranges).orderBy("photo").collect()]


def test_packing(spark):
    assert packed(spark, [100] * 4, [(10000, 10200), (11000, 11200)]) == [(10000, 10100), (10100, 10200), (11000, 11100), (11100, 11200)]
    assert packed(spark, [300, 300], [(10000, 10303)]) == []
    assert packed(spark, [50, 50], [(414400, 414500)]) == [(414400, 414450), (414450, 414500)]
    assert packed(spark, [20], [(414400, 414500)]) == []
    assert packed(spark, [100] * 500, [(0, 100)]) == []  # more photos than centimetres can hold


def test_partial_caption_group(spark):
    photos = spark.createDataFrame([(f"p{i}", "w", i, 100, 10000, 11000) for i in range(2)], "photo string, well string, pos long, capacity_cm long, top_cm long, base_cm long")
    cores = spark.createDataFrame([("w", 10000, 11000)], "well string, core_top_cm long, core_base_cm long")
    got = K.split_caption_groups(photos, cores).orderBy("photo").collect()
    assert [(r["top_cm"], r["base_cm"], r["source"], r["confirmed"]) for r in got] == [
        (10000, 10100, "ocr_sequenced", False), (10100, 10200, "ocr_sequenced", False)]


def test_inference_stages_confirm_only_exact_fits(spark):
    photos = spark.createDataFrame(
        [("a", "w", 0, 100, None, None, "not_found", False, "unknown"), ("b", "w", 1, 100, None, None, "not_found", False, "unknown"),
         ("c", "v", 0, 70, None, None, "not_found", False, "unknown"), ("d", "w", 2, 100, None, None, "not_found", False, "gis")],
        "photo string, well string, pos long, capacity_cm long, top_cm long, base_cm long, source string, confirmed boolean, depth_basis string")
    cores = spark.createDataFrame([("w", 0, 200), ("v", 500, 571)], "well string, top_cm long, base_cm long")
    got = {r["photo"]: (r["top_cm"], r["base_cm"], r["source"], r["confirmed"]) for r in K.suggest_intervals(photos, cores).collect()}
    assert got["a"] == (0, 100, "excel_sequenced", True) and got["b"] == (100, 200, "excel_sequenced", True)
    assert got["c"] == (500, 571, "excel_suggestion", False) and got["d"][0] is None


def claims_in_turn(photos, free):
    """Photos one after another: the only free range whose well the name holds, if the size agrees."""
    left, out = set(free), set()
    for pos, (photo, name, size) in enumerate(photos):
        open_ = [r for r in left if r[0] in name]
        if len(open_) == 1 and abs(size - (open_[0][2] - open_[0][1])) <= 2:
            out.add((photo, *open_[0]))
            left.remove(open_[0])
    return out


def test_named_ranges_are_claimed_in_turn(spark):
    rng = random.Random(11)
    for _ in range(4):
        wells = ["1", "2", "12", "21", "121"]
        free = {(w, a, a + rng.choice([50, 100])) for w in wells for a in rng.sample(range(0, 1000, 200), rng.choice([0, 1, 1, 2]))}
        photos = [(i, "p" + rng.choice(["1", "2", "12", "21", "121", "x"]), rng.choice([50, 101, 100, 49])) for i in range(30)]
        df = spark.createDataFrame([(i, i, n, c) for i, n, c in photos], "photo long, pos long, name string, capacity_cm long")
        ranges = spark.createDataFrame(sorted(free), "well string, top_cm long, base_cm long")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        got = {(r["photo"], r["well"], r["top_cm"], r["base_cm"]) for r in K.claim_named_ranges(df, ranges).collect()}
        assert got == claims_in_turn(photos, free)


def test_anchors_refuse_a_plan(spark):
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    schema = "photo string, well string, text string, name string, pos long, capacity_cm long, top_cm long, base_cm long, source string, confirmed boolean, depth_basis string, col_top_cm long, col_base_cm long"
    rows = spark.createDataFrame([("w1", 0, 300, 0, 300, None, None), ("w2", 0, 300, 0, 300, None, None)],
                                 "well string, top_cm long, base_cm long, core_top_cm long, core_base_cm long, gis_top_cm long, gis_base_cm long")

    def placed(*middle):
        photos = [("a", "w1", "w1a", "a", 0, 100, None, None, "not_found", False, "unknown", None, None), ("b", "w1", "w1b", "b", 1, 100, *middle),
                  ("c", "w1", "w1c", "c", 2, 100, None, None, "not_found", False, "unknown", None, None)]
        return [(r["top_cm"], r["source"]) for r in K.infer_intervals(spark.createDataFrame(photos, schema), rows).orderBy("photo").collect()]

    whole = [(0, "excel_sequenced"), (100, "excel_sequenced"), (200, "excel_sequenced")]
    assert placed(None, None, "not_found", False, "unknown", None, None) == whole
    assert placed(102, 198, "manual", True, "unknown", None, None) == [whole[0], (102, "manual"), whole[2]]
    assert placed(110, 210, "manual", True, "unknown", None, None) == [(None, "not_found"), (110, "manual"), (None, "not_found")]
    assert placed(0, 300, "ocr", True, "unknown", None, None) == whole
    assert placed(None, None, "not_found", False, "unknown", 130, 200) == whole  # refused at first; the last stage packs what is left
    assert placed(9000, 9100, "filename", True, "unknown", None, None) == whole
    assert placed(None, None, "not_found", False, "gis", None, None)[0] == (None, "not_found")


def test_pairing_and_probe(spark):
    books = spark.createDataFrame([("b1", "671по"), ("b2", "a1"), ("b3", "x"), ("b4", "x"), ("b5", "zz")], "workbook string, key string")
    folders = spark.createDataFrame([("671", "671по", 1), ("fx", "x", 1), ("B2", "b2", 1), ("Q", "q9", 1)], "folder string, key string, wells long")
    pairs = J.pair_by_keys(books, folders)
    got = {r["workbook"]: (r["folder"], r["reason"]) for r in pairs.collect()}
    assert got["b1"] == ("671", "") and got["b2"] == (None, "no folder") and got["b3"][1] == "folder shared by workbooks"
    probes = spark.createDataFrame([("b5", "q9"), ("b5", "q9"), ("b2", "m1"), ("b2", "m2")], "workbook string, well_key string")
    again = {r["workbook"]: r["folder"] for r in J.probe_unpaired(pairs, probes, folders).collect()}
    assert again["b5"] == "Q" and again["b2"] is None and again["b1"] == "671"
