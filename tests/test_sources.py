"""Files in, files out, streams."""

import csv
import random
import tempfile

from pyspark.sql import functions as F

from depthlake.sources import lines as L, listing as LS, sinks as SK
from depthlake.streaming import arrivals as AR


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_lines_are_numbered_across_splits(spark):
    base = folder()
    rows = [f"row {i};{i * 2}" for i in range(3000)]
    with open(f"{base}/a.csv", "w", encoding="utf-8-sig") as f:
        f.write("\n".join(rows))
    with open(f"{base}/b.csv", "w", encoding="utf-8") as f:
        f.write("x,1\ny,2\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = L.read_lines(spark, base).filter(F.col("file").endswith("a.csv")).orderBy("line_no").collect()
        assert [r["line"] for r in got] == rows and [r["line_no"] for r in got] == list(range(1, 3001))
        cells = L.read_delimited(spark, base).filter(F.col("file").endswith("b.csv")).orderBy("row", "col").collect()
        assert [(r["row"], r["col"], r["value"]) for r in cells] == [(1, 1, "x"), (1, 2, "1"), (2, 1, "y"), (2, 2, "2")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def csv_rows(path):
    with open(path, encoding="utf-8-sig", newline="") as f:
        return {(i + 1, j + 1, v) for i, row in enumerate(csv.reader(f, delimiter=";")) for j, v in enumerate(row) if v}


def test_quoted_line_breaks_across_splits(spark):
    base, rng = folder(), random.Random(3)
    bits = ['"', '""', ";", ";", "\n", "\r\n", "\r", "a", "bc", " ", 'x"y', '"q;q"', '"l\nl"', ";;"]
    for n in range(12):
        text = "h;h;h;h;h;h;h;h\n" * 3 + "".join(rng.choice(bits) for _ in range(rng.choice([5, 60, 900])))
        with open(f"{base}/f{n}.csv", "w", encoding="utf-8-sig" if n % 2 else "utf-8", newline="") as f:
            f.write(text)
    for size in ("512", "1000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            lines = L.read_broken_lines(spark, base)
            seps = lines.select("file", F.lit(";").alias("sep")).distinct()
            got = {}
            for r in L.delimited_cells(lines, seps).collect():
                got.setdefault(r["file"].rsplit("/", 1)[1], set()).add((r["row"], r["col"], r["value"]))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        for n in range(12):
            assert got.get(f"f{n}.csv", set()) == csv_rows(f"{base}/f{n}.csv"), (n, size)


def test_failing_files_are_issues(spark):
    base = folder()
    good = b"a;b\n\"c\nd\";e\n"
    files = {"good.csv": good, "latin.csv": b"a;b\n\xe9;c\n", "open.csv": b'a;b\n"' + b"x" * 70000 + b"\n" + b"y" * 70000 + b"\nz\n", "wide.csv": b"a;" + b"w" * 140000 + b"\n"}
    for name, data in files.items():
        with open(f"{base}/{name}", "wb") as f:
            f.write(data)
    cells, issues = L.read_many(spark, base)
    assert {(r["row"], r["col"], r["value"]) for r in cells.collect()} == {(1, 1, "a"), (1, 2, "b"), (2, 1, "c\nd"), (2, 2, "e")}
    found = {r["source"].rsplit("/", 1)[1]: r["message"] for r in issues.collect()}
    assert found == {"latin.csv": "not UTF-8", "open.csv": "field larger than field limit (131072)", "wide.csv": "field larger than field limit (131072)"}


def test_listing_and_sinks(spark):
    base = folder()
    df = spark.createDataFrame([(1, "a", "train"), (2, "b", "val")], "id long, name string, split string")
    SK.write_table(df, f"{base}/table", ["name", "id"])
    assert spark.read.option("sep", ";").option("header", True).csv(f"{base}/table").columns == ["name", "id"]
    SK.write_json_lines(df, f"{base}/json")
    assert spark.read.json(f"{base}/json").filter("split = 'val'").count() == 1
    SK.write_manifest(df.agg(F.count(F.lit(1)).alias("rows")), f"{base}/manifest")
    assert spark.read.text(f"{base}/manifest").first()[0] == '{"rows":2}'
    files = LS.discover(LS.list_files(spark, base), (".csv", ".json"))
    assert files.count() >= 3 and files.filter("size <= 0").count() == 0


def test_stream_resumes_without_doubling(spark):
    base = folder()
    for n in range(3):
        spark.range(n * 10, n * 10 + 10).write.mode("append").parquet(f"{base}/in")

    def once():
        stream = AR.file_stream(spark, f"{base}/in", "id long", files=1)
        AR.drain(stream, AR.status_batch(lambda b: b.withColumn("error", F.when(F.col("id") % 10 == 3, "bad")), f"{base}/out", "id"), f"{base}/state")

    once()
    once()
    spark.range(30, 40).write.mode("append").parquet(f"{base}/in")
    once()
    out = spark.read.parquet(f"{base}/out")
    assert out.count() == 40
    got = {r["id"]: r["status"] for r in AR.latest_status(out, "id").collect()}
    assert len(got) == 40 and sum(v == "failed" for v in got.values()) == 4


def test_a_repeat_after_a_year_is_dropped(spark):
    base = folder()

    def arrive(day, digests):
        spark.createDataFrame([(d, f"20{day}-01-01") for d in digests], "digest string, day string").write.mode("append").parquet(f"{base}/in")
        stream = AR.drop_repeats(AR.file_stream(spark, f"{base}/in", "digest string, day string", files=1), "digest")
        AR.drain(stream, lambda b, i: b.write.mode("overwrite").parquet(f"{base}/out/batch={i}"), f"{base}/state")

    AR.keep_state_on_disk(spark)
    arrive("20", ["a", "b", "a"])
    arrive("22", ["a", "c"])
    arrive("31", ["b", "c", "d"])
    got = sorted((r["digest"], r["day"]) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == [("a", "2020-01-01"), ("b", "2020-01-01"), ("c", "2022-01-01"), ("d", "2031-01-01")]
