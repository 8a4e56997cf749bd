"""Cases behind the findings of round 3."""

import csv
import datetime
import io
import random

import duckdb

from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from depthlake.operators import intervals
from depthlake.sources import cells as cells_module, lines


def against_sql(spark, folder, name, **tables):
    """Rows of a query over tables written to ``folder``, and those of its SQL."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = queries()[name](spark, str(folder))
    want = con.execute(oracle_sql()[name])
    names = [d[0] for d in want.description]
    return sorted((tuple(r[c] for c in names) for r in got.collect()), key=str), sorted(want.fetchall(), key=str)


DAY = datetime.datetime(1996, 3, 1)


def orders(spark, rows):
    """orders of (key, customer)."""
    return spark.createDataFrame(
        [(k, c, "O", 1.0, DAY, "5-LOW") for k, c in rows],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")


def suppliers(spark, n):
    return spark.range(n).selectExpr("id AS s_suppkey", "'s' AS s_name", "1 AS s_nationkey", "0D AS s_acctbal")


def test_equal_neighbours_are_no_closing_vertex(spark, tmp_path):
    vector = [((7 * i) % 19) / 10 - 0.9 for i in range(32)]
    vector[12:14] = vector[14:16] = [0.3, 0.5]  # vertices 6 and 7
    table = spark.createDataFrame([(1, vector, 0)], "vec_id long, embedding array<float>, label int")
    got, want = against_sql(spark, tmp_path, "A4_canonical_polygon", embeddings=table)
    assert got == want and got[0][1].count(";") == 15


def test_wells_of_three_digits_are_no_figure_number(spark, tmp_path):
    rows = [(1, 7), (4, 418), (7, 100), (3, 418), (5, 418)]
    got, want = against_sql(spark, tmp_path, "F16_extract_well", orders=orders(spark, rows), supplier=suppliers(spark, 1000))
    assert got == want and (4, "P-418") in got


def joins_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_depth_rows_of_exploded_frames_are_not_broadcast(spark, tmp_path):
    table = orders(spark, [(k, k % 7) for k in range(40)])
    for name in ("J20_depth_row_pairs", "J21_coherent_labels"):
        got, want = against_sql(spark, tmp_path, name, orders=table, supplier=suppliers(spark, 10))
        assert got == want
        assert "BroadcastHashJoin" not in joins_of(queries()[name](spark, str(tmp_path)))


def test_carried_totals_are_not_broadcast(spark):
    from depthlake.operators.scan import numbered

    rows = spark.range(50).selectExpr("id % 3 AS well", "5000 * id AS photo")
    got = numbered(rows, ["well"], ["photo"])
    assert sorted(r.rn for r in got.collect() if r.well == 0) == list(range(1, 18))
    assert "BroadcastHashJoin" not in joins_of(got)


def test_grams_meet_only_a_row_per_key_and_hold_no_text(spark):
    from depthlake.operators.joins import contained_keys

    texts = spark.createDataFrame([(1, "abcdef"), (2, "abxcde"), (3, "q"), (4, None), (5, "abcdef")], "id long, text string")
    keys = spark.createDataFrame([("abc",), ("cde",), ("q",), ("abcdefgh",), ("abd",), ("",), ("ab",)], "key string")
    got = contained_keys(texts, keys, ident="id")
    assert sorted(map(tuple, got.collect())) == [(1, "ab"), (1, "abc"), (1, "cde"), (2, "ab"), (2, "cde"), (3, "q"), (5, "ab"), (5, "abc"), (5, "cde")]
    sides = [line for line in joins_of(got).splitlines() if "BroadcastExchange" in line]
    assert sides and not any("__text" in line.split("Exchange")[0] for line in sides)
    assert "sha2" in joins_of(got)


def test_a_first_word_shared_by_all_keys_meets_only_itself(spark):
    from depthlake.operators.joins import log_file_wells

    logs = spark.range(3000).selectExpr("id AS file", "concat('w_', id) AS key").unionByName(
        spark.createDataFrame([(9001, "w"), (9002, "w_1_x_z"), (9003, "v_2")], "file long, key string"))
    names = spark.range(3000).selectExpr("id AS well", "concat('w_', id) AS key", "true AS is_well").unionByName(
        spark.createDataFrame([(5000, "w_1_x", False), (5001, "v", False)], "well long, key string, is_well boolean"))
    found = log_file_wells(logs, names)
    got = {r.file: (r.well, r.candidates) for r in found.collect()}
    assert got[7] == (7, 1) and got[9001] == (5000, 1) and got[9002] == (5000, 1) and got[9003] == (5001, 1)
    assert " OR (p#" not in joins_of(found)


def test_workbook_pairs_are_not_broadcast(spark, tmp_path):
    part = spark.range(60).selectExpr("id AS p_partkey", "concat('n', id % 11) AS p_name", "'b' AS p_brand", "'t' AS p_type", "cast(id % 13 AS int) AS p_size", "1D AS p_retailprice")
    got, want = against_sql(spark, tmp_path, "J13_workbook_folder_pairs", part=part)
    assert got == want
    assert "SortMergeJoin [workbook" in joins_of(queries()["J13_workbook_folder_pairs"](spark, str(tmp_path)))


def shuffled_rows(spark, df):
    """Rows that a run of ``df`` writes to shuffles."""
    jobs = spark.sparkContext._jsc.sc().statusStore()
    count = lambda: sum(s.shuffleWriteRecords() for s in stages(jobs.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)))
    stages = lambda found: [found.apply(i) for i in range(found.size())]
    before = count()
    rows = df.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return rows, count() - before


def test_a_segment_is_shuffled_once_to_find_its_span(spark):
    spans = [("w", t, t + 37 * (1 + t % 40), f"s{t}", t % 11) for t in range(0, 9000, 61)] + [("w", -700, -100, "low", 3)]
    marks = sorted({x for s in spans for x in s[1:3]})
    pieces = [("w", a, b) for a, b in zip(marks, marks[1:])]
    df = spark.createDataFrame(spans, "well string, top_cm long, base_cm long, id string, conf long")
    segments = spark.createDataFrame(pieces, "well string, seg_top long, seg_base long")
    got, moved = shuffled_rows(spark, intervals.segment_winners(df, segments, ["well"], [F.col("conf"), F.col("id")], ["id"]))
    want = {(a, b): max(((s[4], s[3]) for s in spans if s[1] <= a and s[2] >= b), default=(None, None))[1] for _, a, b in pieces}
    assert {(r.seg_top, r.seg_base): r.id for r in got} == want
    blocks = sum((s[2] - 1) // 256 - s[1] // 256 + 1 for s in spans)
    assert moved <= len(pieces) + 2 * blocks


def test_lines_are_shuffled_once_for_their_quotes(spark, monkeypatch):
    monkeypatch.setattr(lines, "LINES_WIDTH", 3)
    rng, texts = random.Random(5), {}
    for f in range(6):
        cells = ["a", "", 'x;"y', "p\nq", 'l\n"\n\n;m', "\n\n\n\n\n\n\n\nz", '"', '""\n']
        texts[f"f{f}.csv"] = [[rng.choice(cells) for _ in range(3)] for _ in range(25)]
    table = []
    for name, rows in texts.items():
        out = io.StringIO()
        csv.writer(out, delimiter=";", lineterminator="\n").writerows(rows)
        table += [(name, i + 1, line) for i, line in enumerate(out.getvalue().split("\n")[:-1])]
    df = spark.createDataFrame(table, "file string, line_no long, line string")
    separators = spark.createDataFrame([(name, ";") for name in texts], "file string, sep string")
    want = {(name, i + 1, c + 1): v for name, rows in texts.items() for i, row in enumerate(rows) for c, v in enumerate(row) if v}
    assert {(r.file, r.row, r.col): r.value for r in lines.delimited_cells(df, separators).collect()} == want
    _, moved = shuffled_rows(spark, lines.quoted_lines(df, F.broadcast(separators)))
    assert moved <= 3 * len(table)  # whole lines, their states, and a row per block twice


def test_header_rows_of_merged_sheets_read_the_cells_once(spark, tmp_path):
    rows = [("f", "s", r, c, f"{r}.{c}" if (r, c) not in ((4, 2), (5, 1)) else "") for r in range(1, 13) for c in (1, 2)]
    spark.createDataFrame([*rows, ("f", "t", 2, 1, "x"), ("f", "t", 9, 1, "y")], "file string, sheet string, row bigint, col int, value string").write.parquet(f"{tmp_path}/cells")
    cells = spark.read.parquet(f"{tmp_path}/cells")
    merged = spark.createDataFrame([("f", "s", 3, 6, 1, 3), ("f", "t", 2, 40, 1, 3), ("f", "t", 9, 10, 1, 2)], "file string, sheet string, r0 bigint, r1 bigint, c0 int, c1 int")
    whole = cells_module.expand_merged(cells, merged)
    got = {(r.sheet, r.row, r.col): r.value for r in whole.collect()}
    assert got["s", 4, 2] == got["s", 5, 1] == "3.1" and got["s", 4, 1] == "4.1"
    assert sorted(k[1:] for k in got if k[0] == "t") == [(r, c) for r in range(2, 10) for c in (1, 2)] and got["t", 9, 1] == "y" and got["t", 9, 2] == "x"
    head = cells_module.expand_merged(cells, merged, head=7)
    assert sorted(map(tuple, head.collect())) == sorted(tuple(r) for r in whole.collect() if r.row <= 7)
    single = cells_module.expand_merged(cells, merged.filter("r1 - r0 = 1"), head=7)
    scans = [x for x in single._jdf.queryExecution().optimizedPlan().toString().splitlines() if "parquet" in x]
    assert len(scans) <= 1  # the rows that bound tall ranges; the rest comes from the kept head


def test_rows_of_a_sheet_are_read_once_for_all_fills(spark, tmp_path):
    line = lambda row, *values: [("f", "s", row, i + 1, v) for i, v in enumerate(values) if v is not None]
    rows = [*line(1, "well", "top", "base", "label"), *line(2, "1", "2", "3", "4"), *line(3, "A-1", "10,5", "11", "x"), *line(4, None, "11", "12", "x"),
            *line(5, None, "1", "2", "3"), *line(6, None, "=B4", "13", "y"), ("f", "s", 4, 4, "w"), ("f", "s", 4, None, "z")]
    spark.createDataFrame(rows, "file string, sheet string, row bigint, col int, value string").write.parquet(f"{tmp_path}/cells")
    cells = spark.read.parquet(f"{tmp_path}/cells")
    roles = spark.createDataFrame(
        [("f", "s", 1, role, i + 1, role) for i, role in enumerate(("well", "top", "base", "label"))],
        "file string, sheet string, header_row bigint, role string, col bigint, header string")
    good, issues = cells_module.parse_rows(cells, roles)
    assert sorted((r.row, r.well, r.top_cm, r.base_cm, r.label) for r in good.collect()) == [
        (3, "A-1", 1050, 1100, "x"), (4, "A-1", 1100, 1200, "x"), (5, "A-1", 100, 200, "3")]
    assert {(r.source, r.message) for r in issues.collect()} >= {("s!6", "interval not readable"), ("s!6", "formula without a stored result")}
    assert "parquet" not in good._jdf.queryExecution().optimizedPlan().toString()


def boxes(spark, n):
    """lineitem of ``n`` boxes on a few photos."""
    return spark.range(n).selectExpr(
        "id DIV 4 AS l_orderkey", "(id * 37) % 20000 AS l_partkey", "(id * 53) % 1000 AS l_suppkey", "CAST(id % 4 AS INT) AS l_linenumber",
        "CAST(1 + id % 50 AS DOUBLE) AS l_quantity", "CAST(id AS DOUBLE) AS l_extendedprice", "(id % 11) / 100D AS l_discount", "(id % 9) / 100D AS l_tax",
        "CASE WHEN id % 3 = 0 THEN 'A' ELSE 'R' END AS l_returnflag", "'F' AS l_linestatus", "TIMESTAMP_NTZ'1996-03-01 00:00:00' AS l_shipdate")


def test_polygons_are_cut_once_a_batch_and_columns_are_not_broadcast(spark, tmp_path):
    for name in ("A6_clip_to_box", "A7_polygon_depths"):
        got, want = against_sql(spark, tmp_path, name, lineitem=boxes(spark, 400))
        assert got == want and got
        plan = joins_of(queries()[name](spark, str(tmp_path)))
        assert plan.count("ArrowEvalPython [") == 1 and "lambda" not in plan and "BroadcastHashJoin" not in plan


def test_cut_polygons_keep_vertices_in_order_and_miss_none(spark):
    from depthlake.functions import geometry

    rows = [(0, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)], 1.0), (1, None, 1.0), (2, [], 1.0), (3, [(0.0, 0.0), (0.5, 0.0), (0.5, 1.0)], 1.0), (4, [(None, 1.0), (2.0, 1.0), (3.0, None)], 1.0), (5, [(2.0, 2.0)], None)]
    table = spark.createDataFrame(rows, "i long, p array<struct<x: double, y: double>>, l double").coalesce(1)
    cut = geometry.clipped(F.col("p"), F.col("l"), F.lit(0), F.lit(9), F.lit(9))
    got = {r.i: (r.ring and [tuple(v) for v in r.ring], r.twice_area) for r in table.select("i", cut.alias("c")).select("i", "c.*").collect()}
    assert got == {0: ([(1.0, 1.0), (1.0, 0.0), (4.0, 0.0), (4.0, 4.0)], 15.0), 1: (None, None), 2: ([], None), 3: ([], None), 4: ([(2.0, 1.0)], 0.0), 5: ([], None)}


def test_run_lengths_are_read_without_a_loop_over_rows(spark, tmp_path):
    from depthlake.functions import geometry

    got, want = against_sql(spark, tmp_path, "A12_run_length_masks", lineitem=boxes(spark, 400))
    assert got == want
    assert "lambda" not in joins_of(queries()["A12_run_length_masks"](spark, str(tmp_path)))
    rows = [(0, [2, 3, 4]), (1, [2, 3, 3]), (2, None), (3, [9]), (4, [1, -1, 9]), (5, [0, 10**18]), (6, [])]
    table = spark.createDataFrame(rows, "i long, runs array<bigint>").coalesce(1)
    read = {r.i: tuple(r.s) for r in table.select("i", geometry.rle_stats("runs", F.lit(3), F.lit(3)).alias("s")).collect()}
    none = (None,) * 5
    assert read == {0: (3, 0, 0, 2, 3), 1: none, 2: none, 3: (0, None, None, None, None), 4: none, 5: (9, 0, 0, 3, 3), 6: none}


def test_depths_are_scaled_in_whole_numbers(spark):
    from fractions import Fraction
    from math import floor

    rnd = random.Random(3)
    spans = [(rnd.randint(-40, 40), a := rnd.randint(-40, 40), a + rnd.randint(1, 12), b := rnd.randint(-90, 90), b + rnd.randint(-9, 30)) for _ in range(600)]
    spans.append((7 * 10**8, 0, 10**9, 0, 3 * 10**9))
    df = spark.createDataFrame(spans, "v long, st long, sb long, dt long, db long")
    got = df.select("*", intervals.scaled_cm(*[F.col(c) for c in df.columns]).alias("cm"))
    assert "decimal" not in joins_of(got)
    for v, st, sb, dt, db, cm in got.collect():
        exact = Fraction((v - st) * (db - dt), sb - st)
        assert cm == dt + (1 if exact >= 0 else -1) * floor(abs(exact) + Fraction(1, 2))


def test_overlaps_and_inference_broadcast_no_rows_of_photos_or_wells(spark, tmp_path):
    from depthlake.operators import calibrate

    spans = spark.createDataFrame([("a", 0, 10), ("b", 5, 9)], "well string, top_cm long, base_cm long")
    other = spans.withColumnsRenamed({"top_cm": "r_top_cm", "base_cm": "r_base_cm"})
    photos = spark.createDataFrame([(1, "a", 1, 10)], "photo long, well string, pos long, capacity_cm long")
    for df in (intervals.overlap_join(spans, other, ["well"]), calibrate.free_ranges(spans, spans), calibrate.pack_wells(photos, spans)):
        df.collect()
        assert "BroadcastHashJoin" not in joins_of(df)
    assert [tuple(r) for r in calibrate.pack_wells(photos, spans).collect()] == [(1, "a", 0, 10, 0)]
