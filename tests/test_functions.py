"""Texts and numbers: known inputs and what they mean."""

from decimal import Decimal

from pyspark.sql import functions as F

from depthlake.functions import numbers as N, text as T


def apply(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["out"] for r in rows.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


def test_decimals(spark):
    got = apply(spark, N.parse_decimal, ["4105.25", "4105,25", "4.105,25", "4,105.25", "4 105,25 м", "−3,5", "нет", ".5", "1 234"])
    assert [None if g is None else Decimal(g).normalize() for g in got] == [
        Decimal("4105.25")] * 5 + [Decimal("-3.5"), None, Decimal("0.5"), Decimal("1234")]


def test_centimetres_round_half_up(spark):
    df = spark.createDataFrame([(1.005,), (2.675,), (100.0,)], "v double")
    assert [r[0] for r in df.select(N.to_cm(F.col("v"))).collect()] == [101, 268, 10000]
    assert [r[0] for r in spark.range(1).select(N.format_depth(F.lit(10050))).collect()] == ["100.5"]


def test_file_names(spark):
    got = apply(spark, T.parse_filename, [
        "/a/Р-31 3002,00–3004,96 (1).jpg", "/a/Рис. 15.1-20 вид, скв№ 67ПО-0001.jpg", "/a/photo_40Р 100-100.jpg"])
    assert (got[0]["well"], got[0]["top"], got[0]["base"]) == ("Р-31", Decimal("3002"), Decimal("3004.96"))
    assert (got[1]["well"], got[1]["top"]) == ("67ПО", None)
    assert got[2]["top"] is None
    strict = apply(spark, T.parse_strict_filename, ["/p/Р-31_3829,08-2829,33.jpg", "/p/Р-31_3002,00-3004,96.jpg", "/p/nothing.jpg"])
    assert (strict[0]["top"], strict[0]["base"]) == (3829.08, 3829.33)
    assert strict[1]["well"] == "Р-31" and strict[2]["well"] is None


def test_captions(spark):
    texts = ["Интервал отбора керна 4106.00-4116.55 м, после увязки 4106.00-4114.65 м.", "Шкала 40 50 60 70 80 90 100", "Интервал керна 4104.90 4116.55"]
    got = apply(spark, T.caption_interval, texts)
    assert (got[0]["top"], got[0]["base"], got[0]["basis"]) == (Decimal("4106.0000"), Decimal("4114.6500"), "gis")
    assert got[1] is None or got[1]["top"] is None
    assert (got[2]["top"], got[2]["base"], got[2]["basis"]) == (Decimal("4104.9000"), Decimal("4116.5500"), "drilling")


def test_keys_and_labels(spark):
    assert apply(spark, T.well_key, ["Скважина № 67-ПО", "well P-31", "скв. Ё1"]) == ["no67по", "p31", "е1"]
    assert apply(spark, T.pair_key, ["671ПО"]) == apply(spark, T.pair_key, ["671ПO"])
    assert apply(spark, T.file_match_key, ["/x/well-12-core-01.jpg", "/x/Скв_12.las"]) == ["well_12", "скв_12"]
    # Six bare digits of 100,000 or more are packed metres and centimetres.
    assert apply(spark, N.depth_label, ["[41O5,5 м]", "410525", "x98/7654", "abc"]) == [4105.5, 4105.25, 9876.54, None]
    names = ["p10.jpg", "p2.jpg", "p1.jpg", "p1a.jpg"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r["n"] for r in df.orderBy(T.natural_key(F.col("n"))).collect()] == sorted(names, key=lambda n: [(t.isdigit(), int(t) if t.isdigit() else t) for t in __import__("re").findall(r"\d+|\D+", n)])


def test_nfkc_helper(spark):
    assert apply(spark, T.nfkc, ["№ ﬁ"]) == ["No fi"]


def test_generated_text(spark):
    got = apply(spark, T.clean_generated, ["```text\nОписание:  серый  песчаник\n```", "x" * 700])
    assert got[0] == "серый песчаник" and len(got[1]) == 600
    assert apply(spark, T.valid_generated, ["песчаник", "аааааааааа", "12", "<unk> abc"]) == [True, False, False, False]
