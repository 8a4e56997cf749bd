"""Cases behind the findings of round 4."""

import random
from types import SimpleNamespace

from pyspark.sql import functions as F

from __spark_entry__ import queries
from depthlake.operators import boxes as operators, intervals, joins
from depthlake.sources import cells as cells_module, lines
from tests.test_findings_r03 import against_sql, boxes, orders, shuffled_rows, suppliers


def test_numbers_meet_only_the_wells_they_hold(spark):
    photos = spark.range(40000).selectExpr("id AS photo", "'' AS well", "concat('p', 100000 + id % 4000) AS text").repartition(4)
    wells = spark.range(4000).selectExpr("CAST(100000 + id AS STRING) AS key")
    got, moved = shuffled_rows(spark, joins.resolve_wells(photos, wells))
    assert {(r.photo, r.well) for r in got} == {(i, str(100000 + i % 4000)) for i in range(40000)}
    assert moved <= 5 * 40000  # before, a photo met every well with its rarest three digits


def test_keys_of_any_length_are_found_with_any_gram(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab1") for _ in range(n))
    texts = [(i, word(rng.randint(0, 30))) for i in range(200)] + [(900, None)]
    keys = {word(rng.randint(0, 14)) for _ in range(300)} | {"b" * 40}
    want = {(i, k) for i, t in texts if t for k in keys if k and k in t}
    table, known = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(k,) for k in keys], "key string")
    for gram in (3, 8):
        got = [tuple(r) for r in joins.contained_keys(table, known, ident="id", gram=gram).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_boxes_without_rivals_take_no_part_in_rounds(spark, tmp_path):
    for name in ("P14_suppressed_overlaps", "P14_silenced_alternatives", "P13_same_boxes"):
        got, want = against_sql(spark, tmp_path, name, lineitem=boxes(spark, 1000))
        assert got == want
    apart = spark.range(3000).selectExpr("id DIV 10 AS photo", "CAST(id AS STRING) AS det", "id % 10 * 20 AS left", "0L AS top", "id % 10 * 20 + 9 AS right", "9L AS bottom")
    chain = [(999, str(i), 3 * i, 0, 3 * i + 9, 9) for i in range(12)] + [(999, "nothing", 5, 5, 5, 9)]
    df = apart.unionByName(spark.createDataFrame(chain, apart.schema)).repartition(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept, moved = shuffled_rows(spark, SimpleNamespace(collect=lambda: operators.drop_same_boxes(df, "det", least=0.4).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.det for r in kept if r.photo == 999} == {"0", "2", "4", "6", "8", "10", "nothing"} and len(kept) == 3007
    assert moved <= 6 * 3013, moved


def best_over(spans, low, high):
    """(from, to, winner) of the ground between two depths, for spans of (top, base, conf, ident)."""
    marks = sorted({low, high} | {x for s in spans for x in s[:2] if low < x < high})
    out = []
    for a, b in zip(marks, marks[1:]):
        won = max(((s[2], s[3]) for s in spans if s[0] <= a and s[1] >= b), default=(0, None))[1]
        if out and out[-1][2] == won:
            out[-1] = (out[-1][0], b, won)
        else:
            out.append((a, b, won))
    return out


def test_ground_is_settled_in_its_block(spark):
    rng = random.Random(8)
    spans = [(t := rng.randint(-9000, 9000), t + rng.choice([5, 90, 300, 4096, 7000]), rng.randint(0, 9), f"s{i}") for i in range(150)] + [(-8192, 8192, 1, "long"), (0, 4096, 9, "whole"), (10, 10, 9, "none")]
    rows = [("v", *s) for s in spans] + [("w", *s) for s in spans[:40]] + [(None, 0, 50, 1, "x")]
    df = spark.createDataFrame(rows, "well string, top_cm long, base_cm long, conf long, id string").repartition(3)
    want = lambda w, low, high: {(w, *x) for x in best_over([s[1:] for s in rows if s[0] == w], low, high)}
    got, moved = shuffled_rows(spark, intervals.resolve_overlaps(df, ["well"], rank=[F.col("conf"), F.col("id")], ident="id"))
    covered = {x for w in "vw" for x in want(w, -20000, 20000) if x[3]}
    assert {(r.well, r.top_cm, r.base_cm, r.id) for r in got} == covered and len(got) == len(covered)
    pieces = sum((b - 1) // 4096 - t // 4096 + 1 for w, t, b, _, _ in rows if w and b > t)
    assert moved <= 3 * pieces  # before, every piece of ground went through six shuffles
    hosts = spark.createDataFrame([("v", -700, 13000), ("u", 100, 9000), ("t", 5, 5)], "well string, host_top_cm long, host_base_cm long")
    parts = intervals.partition_hosts(hosts, df, ["well"], rank=[F.col("conf"), F.col("id")], identity=["id"], confidence="conf", gap_label="gap", label="id").collect()
    told = {(w, a, b, i or "gap", i is None) for w, a, b, i in want("v", -700, 13000) | want("u", 100, 9000)}
    assert {(r.well, r.top_cm, r.base_cm, r.id, r.gap_filled) for r in parts} == told and len(parts) == len(told)


def test_photos_are_shuffled_once_to_fill_their_columns(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "W4_column_coverage", lineitem=boxes(spark, 1200))
    assert got == want
    _, moved = shuffled_rows(spark, queries()["W4_column_coverage"](spark, str(tmp_path)))
    assert moved <= 3 * 1200, moved


def test_columns_meet_their_photo_and_their_tape_once(spark, tmp_path):
    tables = {"lineitem": boxes(spark, 1200), "orders": orders(spark, [(k, k % 17) for k in range(300)]), "supplier": suppliers(spark, 1000)}
    got, want = against_sql(spark, tmp_path, "P8_global_tape", **tables)
    assert got == want and got
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        _, moved = shuffled_rows(spark, queries()["P8_global_tape"](spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert moved <= 7 * 1200, moved


def test_records_are_put_together_in_their_block(spark):
    rows = [(f"f{i % 4}.csv", 3 * (i // 4) + j + 1, text) for i in range(200) for j, text in enumerate((f'a{i};"x', '"" y', 'z";b'))]
    rows += [("bad.csv", 1, '1;"p'), ("bad.csv", 2, 'q";2')]
    df = spark.createDataFrame(rows, "file string, line_no long, line string").withColumn("valid", F.expr("NOT (file = 'bad.csv' AND line_no = 2)")).repartition(4)
    separators = F.broadcast(spark.createDataFrame([(f, ";") for f in {r[0] for r in rows}], "file string, sep string"))
    got, moved = shuffled_rows(spark, lines.delimited_cells(df, separators))
    want = {(f"f{i % 4}.csv", i // 4 + 1, c, v) for i in range(200) for c, v in ((1, f"a{i}"), (2, 'x\n" y\nz'), (3, "b"))}
    assert {(r.file, r.row, r.col, r.value) for r in got if r.file != "bad.csv"} == want
    assert moved <= 3 * len(rows) + 60, moved  # lines and their states; before, records were shuffled once more
    cells, issues = lines.delimited_outcomes(df, separators)
    assert {(r.file, r.row, r.col, r.value) for r in cells.collect()} == want
    assert [tuple(r) for r in issues.collect()] == [("bad.csv", "error", "not UTF-8")]


def test_cells_of_a_row_are_shuffled_once(spark):
    rows = [("f", f"s{s}", r, c, v) for s in range(3) for r in range(1, 301) for c, v in enumerate(("well", "top", "base", "label") if r == 1 else ("A-1" if r % 50 == 2 else "", str(r), str(r + 1), "x" if r % 3 else ""), 1)]
    cells = spark.createDataFrame(rows, "file string, sheet string, row bigint, col int, value string").repartition(4)
    merged = spark.createDataFrame([("f", "s1", 2, 6, 4, 6), ("f", "s2", 299, 400, 2, 3)], "file string, sheet string, r0 bigint, r1 bigint, c0 int, c1 int")
    whole = cells_module.expand_merged(cells, merged)
    got = {(r.sheet, r.row, r.col): r.value for r in whole.collect()}
    assert got["s1", 3, 4] == "x" and got["s1", 5, 5] == "x" and got["s2", 300, 2] == "300" and got["s0", 3, 4] is None and len(got) == len(rows) + 4
    roles = spark.createDataFrame([("f", f"s{s}", 1, role, i, role) for s in range(3) for i, role in enumerate(("well", "top", "base", "label"), 1)],
                                  "file string, sheet string, header_row bigint, role string, col bigint, header string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        good, moved = shuffled_rows(spark, SimpleNamespace(collect=lambda: cells_module.parse_rows(whole, roles)[0].collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.well for r in good} == {"A-1"} and len(good) == 3 * 199 + 1  # every third row lacks its label; one of them is filled
    assert moved <= 22_400, moved  # 23,213 before
