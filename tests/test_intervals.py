"""Interval core against brute force on centimetre grids, with small blocks so that stitching is exercised."""

import random

from pyspark.sql import functions as F

from depthlake.operators import intervals as iv
from depthlake.operators.scan import numbered, running


def spans(seed, n=120, wells=3, depth=400, longest=60):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # Half of all rows sit in one well; some intervals are exact copies.
        well = 0 if rnd.random() < 0.5 else rnd.randrange(wells)
        top = rnd.randrange(-50, depth)
        rows.append((well, top, top + rnd.randrange(0, longest), rnd.choice("ABC"), rnd.randrange(5), i))
    return rows + [(*r[:5], 1000 + i) for i, r in enumerate(rows[:20])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "well long, top_cm long, base_cm long, label string, conf long, id long")


def cells(rows):
    out = {}
    for r in rows:
        for d in range(r[1], r[2]):
            out.setdefault((r[0], d), []).append(r)
    return out


def as_cells(rows):
    return {(r["well"], d) for r in rows for d in range(r["top_cm"], r["base_cm"])}


def test_union_and_length(spark):
    rows = spans(1)
    want = set(cells(rows))
    got = iv.union_intervals(frame(spark, rows), ["well"], width=32).collect()
    assert as_cells(got) == want
    ordered = sorted((r["well"], r["top_cm"], r["base_cm"]) for r in got)
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(ordered, ordered[1:]))
    lengths = {r["well"]: r for r in iv.union_length(frame(spark, rows), ["well"], width=32).collect()}
    for well in {r[0] for r in rows}:
        assert lengths[well]["union_cm"] == sum(1 for c in want if c[0] == well)
        assert lengths[well]["raw_cm"] == sum(max(0, r[2] - r[1]) for r in rows if r[0] == well)


def test_gaps_and_cover_make_the_host(spark):
    rows = spans(2)
    hosts = [(w, i, t, t + 90) for w in range(4) for i, t in enumerate(range(-60, 380, 70))]
    host_df = spark.createDataFrame(hosts, "well long, host long, host_top_cm long, host_base_cm long")
    got = iv.gaps(host_df, frame(spark, rows), ["well"], bin_cm=64).collect()
    covered = set(cells(rows))
    for well, host, top, base in hosts:
        free = {d for r in got if (r["well"], r["host"]) == (well, host) for d in range(r["gap_top_cm"], r["gap_base_cm"])}
        assert free == {d for d in range(top, base) if (well, d) not in covered}


def test_overlap_join_pairs_once(spark):
    a, b = spans(3, 60), spans(4, 60)
    left = frame(spark, a).select("well", "top_cm", "base_cm", "id")
    right = frame(spark, b).select("well", F.col("top_cm").alias("r_top_cm"), F.col("base_cm").alias("r_base_cm"), F.col("id").alias("rid"))
    want = sorted((x[5], y[5]) for x in a for y in b if x[0] == y[0] and min(x[2], y[2]) > max(x[1], y[1]))
    for salt in (1, 3):
        got = iv.overlap_join(left, right, ["well"], bin_cm=16, salt=salt).collect()
        assert sorted((r["id"], r["rid"]) for r in got) == want
    anti = iv.overlap_join(left, right.drop("rid"), ["well"], how="left_anti", bin_cm=16).collect()
    assert {r["id"] for r in anti} == {x[5] for x in a} - {w[0] for w in want}


def test_resolved_segments_are_disjoint_and_best(spark):
    rows = [r for r in spans(5, 80) if r[5] < 1000]
    got = iv.resolve_overlaps(frame(spark, rows), ["well"], rank=[F.col("conf"), -F.col("id")], ident="id").collect()
    best = {c: max(rs, key=lambda r: (r[4], -r[5]))[5] for c, rs in cells(rows).items()}
    seen = {}
    for r in got:
        for d in range(r["top_cm"], r["base_cm"]):
            assert (r["well"], d) not in seen
            seen[(r["well"], d)] = r["id"]
    assert seen == best


def test_partition_has_no_gaps(spark):
    rows = [r for r in spans(6, 60) if r[5] < 1000]
    hosts = spark.createDataFrame([(w, -80, 500) for w in range(3)], "well long, host_top_cm long, host_base_cm long")
    got = iv.partition_hosts(hosts, frame(spark, rows), ["well"], rank=[F.col("conf"), -F.col("id")], identity=["label"],
                             confidence="conf", gap_label="none", label="label").collect()
    inside = cells(rows)
    for well in range(3):
        mine = sorted((r["top_cm"], r["base_cm"], r["label"]) for r in got if r["well"] == well)
        assert mine[0][0] == -80 and mine[-1][1] == 500 and all(a[1] == b[0] and a[2] != b[2] for a, b in zip(mine, mine[1:]))
        for top, base, label in mine:
            for d in range(top, base):
                here = inside.get((well, d))
                assert label == (max(here, key=lambda r: (r[4], -r[5]))[3] if here else "none")


def sequential_merge(rows, tol):
    out = []
    for well in sorted({r[0] for r in rows}):
        open_ = None
        for r in sorted((r for r in rows if r[0] == well), key=lambda r: (r[1], r[2], r[5])):
            if open_ and open_[1] == r[3] and r[1] <= open_[3] + tol:
                open_[3] = max(open_[3], r[2])
                open_[4] += 1
            else:
                open_ = [well, r[3], r[1], r[2], 1]
                out.append(open_)
    return sorted(map(tuple, out))


def test_coalesce_matches_sequential_merge_and_is_idempotent(spark):
    rows = [(w, t, t + (i * 7) % 40, "AAB"[(i * i) % 3], 0, i) for i, (w, t) in enumerate((i % 2, (i * 13) % 500) for i in range(160))]
    got = iv.coalesce_adjacent(frame(spark, rows), ["well"], ["label"], ["id"], width=24)
    assert sorted((r["well"], r["label"], r["top_cm"], r["base_cm"], r["merged_rows"]) for r in got.collect()) == sequential_merge(rows, 2)
    apart = [(0, 0, 10, "A", 0, 1), (0, 10, 20, "A", 0, 2), (0, 21, 30, "B", 0, 3), (0, 35, 40, "B", 0, 4), (1, None, None, "A", 0, 5)]
    once = iv.coalesce_adjacent(frame(spark, apart), ["well"], ["label"], ["id"])
    assert {(r["top_cm"], r["base_cm"]) for r in once.collect()} == {(None, None), (0, 20), (21, 30), (35, 40)}


def test_one_centimetre_gap(spark):
    hosts = spark.createDataFrame([(1, 10000, 10300)], "photo long, host_top_cm long, host_base_cm long")
    rows = spark.createDataFrame([(1, 10000, 10150), (1, 10151, 10300)], "photo long, top_cm long, base_cm long")
    got = iv.key_gaps(hosts, rows, ["photo"]).collect()
    assert [(r["gap_top_cm"], r["gap_base_cm"]) for r in got] == [(10150, 10151)]


def test_scans_agree_with_plain_order(spark):
    rows = [(i % 2, (i * 37) % 300, i) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, at long, id long")
    want = {}
    for k in (0, 1):
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])), 1):
            want[r[2]] = n
    for dense in (False, True):
        got = {r["id"]: r["rn"] for r in numbered(df, ["k"], ["at", "id"], width=16, dense=dense).collect()}
        assert got == want
    odd = df.withColumn("v", F.when(F.col("id") % 7 == 0, F.col("id")))
    last = running(odd, ["k"], ["at", "id"], {"up": ("last", "v")}, width=16, reverse=True)
    for r in last.collect():
        after = sorted((x[1], x[2]) for x in rows if x[0] == r["k"] and (x[1], x[2]) > (r["at"], r["id"]) and x[2] % 7 == 0)
        assert r["up"] == (after[0][1] if after else None)
