"""Labelled-sample governance: validity, duplicates, leak-free splits, balancing, approvals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from depthlake.functions import geometry as G

# Placeholder and background class names.
PLACEHOLDERS = ("", "Новый контур")
BACKGROUND = ("shlak", "slag", "шлак")


def annotation_problems() -> Column:
    """Failed checks of an annotation row (A3): label, polygon, size, text, image bounds, area, span."""
    poly, w, h = F.col("polygon"), F.col("image_width"), F.col("image_height")
    outside = F.exists(poly, lambda p: ~p["x"].between(0, w) | ~p["y"].between(0, h))
    rules = (
        (F.trim(F.coalesce("label", F.lit(""))) == "", "no label"), (F.size(poly) < 3, "fewer than three points"), ((w < 2) | (h < 2), "image too small"),
        (F.trim(F.coalesce("target_text", F.lit(""))) == "", "no text"), (outside, "outside the image"),
        (F.coalesce(G.area(poly), F.lit(0.0)) < 0.5, "no area"), (~F.coalesce(F.col("base_cm") > F.col("top_cm"), F.lit(False)), "base not below top"))
    return F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in rules]))


def is_named(label: Column) -> Column:
    return ~F.trim(F.coalesce(label, F.lit(""))).isin(*PLACEHOLDERS)


def sample_counts(df: DataFrame, keys: Sequence[str], *, label: str = "label", reviewed: str = "reviewed", polygon: str = "polygon") -> DataFrame:
    """Verified, automatic and unlabeled contour counts."""
    solid, named = F.size(polygon) >= 3, is_named(F.col(label))
    return df.groupBy(*keys).agg(
        F.count_if(solid & named & F.col(reviewed)).alias("verified"), F.count_if(solid & named & ~F.col(reviewed)).alias("automatic"),
        F.count_if(solid & ~named & F.col(reviewed)).alias("unlabeled"))


def is_background(label: Column) -> Column:
    """Background class (S3)."""
    return F.lower(F.trim(label)).isin(*BACKGROUND)


def confident(value: Column, threshold: float) -> Column:
    """Threshold filter with the threshold held in [0.01, 0.99]."""
    return value >= max(0.01, min(0.99, threshold))


def components(members: DataFrame, node: str, groups: Sequence[str]) -> DataFrame:
    """Connected components over shared group values (G1): (node, component), the least node id.

    Nodes meet only through their groups: a round takes the least label per group (a
    partial aggregate) and per node, then follows the label of the label.  Lineage is cut
    by a checkpoint each round.
    """
    from functools import reduce

    from depthlake.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(members.sparkSession)
    links = reduce(DataFrame.unionByName, [
        members.filter(F.col(g).isNotNull() & (F.col(g).cast("string") != "")).select(F.col(node).alias("__n"), F.concat(F.lit(f"{i}:"), F.col(g).cast("string")).alias("__g"))
        for i, g in enumerate(groups)]).distinct().checkpoint()
    labels = members.select(F.col(node).alias("__n")).distinct().withColumn("__c", F.col("__n")).checkpoint()
    while True:
        least = links.join(labels, "__n").groupBy("__g").agg(F.min("__c").alias("__m"))
        offered = links.join(least, "__g").groupBy("__n").agg(F.min("__m").alias("__m"))
        nearer = labels.join(offered, "__n", "left").select("__n", F.col("__c").alias("__old"), F.least("__c", F.coalesce("__m", "__c")).alias("__c"))
        jump = nearer.select(F.col("__n").alias("__c"), F.col("__c").alias("__root"))
        step = nearer.join(jump, "__c", "left").select("__n", "__old", F.least("__c", F.coalesce("__root", "__c")).alias("__c")).checkpoint()
        moved = step.filter("__old <> __c").isEmpty()
        labels = step.select("__n", "__c")
        if moved:
            break
    return labels.select(F.col("__n").alias(node), F.col("__c").alias("component"))


def greedy_holdout(samples: DataFrame, group: str, label: str = "label", *, share: float = 0.2) -> DataFrame:
    """Groups held out for validation (L1), never a class's last training group.

    Works on the collapsed (group, label, count) table.  While a pick can still add an
    unseen class the best group is found by one aggregate per pick (at most one per class).
    After that scores are fixed, so groups are taken in score order in bulk up to the first
    one that would empty a class; groups that can no longer fit leave for good, and the
    rest goes on.
    """
    from depthlake.operators.scan import BALANCED, balanced_positions, running
    from depthlake.session import ensure_checkpoint_dir

    spark = samples.sparkSession
    ensure_checkpoint_dir(spark)
    counts = samples.groupBy(F.col(group).alias("g"), F.col(label).alias("l")).agg(F.count(F.lit(1)).alias("n")).checkpoint()
    totals = {r["l"]: r["n"] for r in counts.groupBy("l").agg(F.sum("n").alias("n")).collect()}  # one row per class
    sizes = counts.agg(F.countDistinct("g").alias("g"), F.sum("n").alias("n")).first()
    target = min(sizes["g"] - 1, max(1, _half_even(sizes["g"] * share)))
    if target <= 0:
        return counts.select(F.col("g").alias(group)).limit(0)
    total = F.create_map(*[F.lit(x) for item in totals.items() for x in item])
    even = sizes["n"] * share / max(1, target)
    scored = counts.groupBy("g").agg(
        F.round(F.sum(F.col("n") / F.element_at(total, F.col("l"))), 12).alias("rare"), (-F.abs(F.sum("n") - F.lit(float(even)))).alias("near"),
        F.map_from_entries(F.collect_list(F.struct("l", "n"))).alias("m")).checkpoint()
    left, taken, covered, remaining = scored, [], set(), dict(totals)
    fits = lambda: F.forall(F.map_entries("m"), lambda e: F.element_at(
        F.create_map(*[F.lit(x) for item in remaining.items() for x in item]), e["key"]) > e["value"])
    picks: list = []
    while len(picks) < target and covered < set(totals):
        fresh = F.size(F.array_except(F.map_keys("m"), F.array(*[F.lit(c) for c in sorted(covered)]).cast("array<string>")))
        best = left.filter(fits()).agg(F.max(F.struct(fresh.alias("f"), "rare", "near", "g", F.map_entries("m").alias("e"))).alias("b")).first()["b"]
        if best is None or best["f"] == 0:
            break
        picks.append(best["g"])
        for entry in best["e"]:
            remaining[entry["key"]] -= entry["value"]
            covered.add(entry["key"])
        left = left.filter(F.col("g") != best["g"])
    kind = scored.schema["g"].dataType
    taken.append(spark.createDataFrame([(p,) for p in picks], "g " + kind.simpleString()))
    room = target - len(picks)
    while room > 0:
        ordered = balanced_positions(left.filter(fits()), [], [F.desc("rare"), F.desc("near"), F.desc("g")], "at")
        if ordered.isEmpty():
            break
        placed = running(ordered.select("g", "at").withColumns({"one": F.lit(1).cast("bigint"), "k": F.lit(0)}), ["k"], ["at"], {"before": ("sum", "one")}, width=BALANCED)
        limit = F.create_map(*[F.lit(x) for item in remaining.items() for x in item])
        per = ordered.select("at", F.explode("m").alias("l", "n"))
        used = running(per, ["l"], ["at"], {"used": ("sum", "n")}, width=BALANCED)
        stop = used.filter(F.col("used") + F.col("n") >= F.element_at(limit, F.col("l"))).agg(F.min("at")).first()[0]
        ok = placed.filter(F.col("before") < room)
        ok = ok if stop is None else ok.filter(F.col("at") < stop)
        chosen = ordered.join(ok.select("at"), "at", "left_semi").checkpoint()
        got = chosen.count()
        for r in chosen.select(F.explode("m").alias("l", "n")).groupBy("l").agg(F.sum("n").alias("n")).collect():
            remaining[r["l"]] -= r["n"]
        taken.append(chosen.select("g"))
        room -= got
        left = ordered.drop("at").join(chosen.select("g"), "g", "left_anti")
        if stop is None:
            break
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return out.select(F.col("g").alias(group))


def _half_even(value: float) -> int:
    return int(round(value))


def assign_splits(samples: DataFrame, *, digest: str = "hash", well: str = "well", label: str = "label") -> tuple[DataFrame, str]:
    """Split by well when every photo hash has exactly one well, else by hash, else none (L2)."""
    wells = samples.groupBy(digest).agg(F.countDistinct(well).alias("n"), F.min(F.coalesce(F.trim(F.col(well).cast("string")), F.lit(""))).alias("w"))
    by_well = wells.filter("n <> 1 OR w = ''").isEmpty()
    for key, strategy in ((well, "well"), (digest, "photo")):
        if key == well and not by_well:
            continue
        chosen = greedy_holdout(samples, key, label).checkpoint()
        if not chosen.isEmpty():
            marked = samples.join(chosen.withColumn("__v", F.lit(True)), key, "left")
            return marked.withColumn("split", F.when(F.col("__v"), "val").otherwise("train")).drop("__v"), strategy
    return samples.withColumn("split", F.lit("train")), "unavailable"


def component_holdout(photos: DataFrame, *, photo: str = "photo", well: str = "well", digest: str = "hash", label: str = "label") -> tuple[DataFrame, str]:
    """One leak-free component nearest to 20 % of the photos that leaves every class in training (L3).

    ``photos`` holds one row per (photo, label occurrence).  Components join photos of a
    well and copies of an image; without a fitting one, wells are let go.
    """
    per_photo = photos.groupBy(photo).agg(F.min(well).alias(well), F.min(digest).alias(digest))
    n = per_photo.count()
    target = max(1, _half_even(n * 0.2))
    wells = per_photo.agg(F.countDistinct(well).alias("w"), F.count_if(F.coalesce(F.trim(F.col(well).cast("string")), F.lit("")) == "").alias("blank")).first()
    by_well = wells["w"] >= 2 and wells["blank"] == 0
    tries = ([([well, digest], "well")] if by_well else []) + [([digest], "photo_fallback" if by_well else "photo")]
    totals = photos.groupBy(label).agg(F.count(F.lit(1)).alias("__all"))
    for groups, strategy in tries:
        parts = components(per_photo, photo, groups).checkpoint()
        inside = photos.join(parts, photo).groupBy("component", label).agg(F.count(F.lit(1)).alias("__n"))
        emptied = inside.join(totals, label).filter("__n >= __all").select("component").distinct()
        sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("__size")).join(emptied, "component", "left_anti")
        best = sizes.agg(F.min(F.struct(F.abs(F.col("__size") - target).alias("d"), F.col("__size").alias("s"), F.col("component").alias("c"))).alias("b")).first()["b"]
        if best is not None:
            return parts.select(photo, F.when(F.col("component") == best["c"], "val").otherwise("train").alias("split")), strategy
    return per_photo.select(photo, F.lit("train").alias("split")), tries[-1][1]


def balance(train: DataFrame, order: Sequence[str], *, label: str = "label", width: int = 8192) -> DataFrame:
    """Bounded square-root repetition of rare classes (L4): originals plus repeats.

    A class of n grows to min(3n, ceil(sqrt(max n * n))), rarest first, while the total
    budget of one extra per original lasts; repeats walk the class in ``order``.
    """
    from depthlake.operators.scan import numbered

    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    top = counts.agg(F.max("__n")).scalar()
    budget = counts.agg(F.sum("__n")).scalar()
    want = F.greatest(F.lit(0), F.least(3 * F.col("__n"), F.ceil(F.sqrt(top * F.col("__n")))) - F.col("__n"))
    from pyspark.sql import Window as W

    rare = W.orderBy("__n", label).rowsBetween(W.unboundedPreceding, -1)  # one row per class
    adds = counts.withColumn("__want", want).withColumn("__spent", F.coalesce(F.sum("__want").over(rare), F.lit(0)))
    adds = adds.withColumn("__adds", F.greatest(F.lit(0), F.least(F.col("__want"), budget - F.col("__spent")))).select(label, "__n", "__adds")
    placed = numbered(train, [label], order, "__i", width=width).join(adds, label)
    times = F.expr("__adds div __n") + F.when(F.col("__i") <= F.col("__adds") % F.col("__n"), 1).otherwise(0)
    return placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), times.cast("bigint")))).drop("__i", "__n", "__adds")


def leaked(samples: DataFrame, *, digest: str = "hash", split: str = "split") -> DataFrame:
    """Hashes on both sides of the split (L5, U5); empty when the split is clean."""
    side = lambda s: samples.filter(F.col(split) == s).select(digest)
    return side("train").intersect(side("val"))


def registry_digest(classes: DataFrame, *, ident: str = "class_id", label: str = "label") -> DataFrame:
    """Order-sensitive digest of a class registry (L6); registries are bounded reference lists."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(ident).alias("id"), F.col(label).alias("label"))))
    return classes.agg(F.sha2(F.to_json(rows), 256).alias("digest"), F.count(F.lit(1)).alias("classes"))


def registry_differences(ours: DataFrame, theirs: DataFrame, *, ident: str = "class_id", label: str = "label") -> DataFrame:
    """Classes only one registry has."""
    a, b = ours.select(ident, label), theirs.select(ident, label)
    return a.exceptAll(b).withColumn("side", F.lit("ours")).unionByName(b.exceptAll(a).withColumn("side", F.lit("theirs")))


def caption_rows(masks: DataFrame) -> DataFrame:
    """Approved masks with text; class bounds fall back to mask bounds, thickness never negative."""
    number = lambda c, other: F.coalesce(F.translate(F.trim(c), ", ", ".").try_cast("double"), F.col(other).cast("double"))
    rows = masks.filter(F.col("approved") & (F.trim(F.coalesce("target_text", F.lit(""))) != ""))
    rows = rows.withColumns({"interval_top": number("facies_top", "depth_top"), "interval_base": number("facies_base", "depth_base")})
    return rows.withColumn("thickness", F.greatest(F.lit(0.0), F.col("interval_base") - F.col("interval_top")))


def class_statistics(rows: DataFrame, *, index: str = "facies_index", label: str = "label", name: str = "facies_name", text: str = "target_text") -> DataFrame:
    """Masks and descriptions per class index; a class with two names is a conflict."""
    squeeze = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))
    idx = F.coalesce(*[F.when(squeeze(c) != "", squeeze(c)) for c in (index, label, name)])
    full = rows.withColumn("__i", idx).withColumn("__n", F.coalesce(F.when(squeeze(name) != "", squeeze(name)), F.col("__i")))
    return full.groupBy(F.lower("__i").alias("class_key")).agg(
        F.count(F.lit(1)).alias("mask_count"), F.count_if(squeeze(text) != "").alias("description_count"),
        F.countDistinct(F.lower("__n")).alias("names")).withColumn("conflict", F.col("names") > 1)


def top_texts(rows: DataFrame, label: str, text: str, order: str, *, limit: int = 5) -> DataFrame:
    """Most common texts per class, first seen wins ties."""
    squeezed = F.trim(F.regexp_replace(text, r"\s+", " "))
    per = rows.filter(F.trim(F.coalesce(text, F.lit(""))) != "").groupBy(label, squeezed.alias("text")).agg(
        F.count(F.lit(1)).alias("times"), F.min(order).alias("__first"))
    best = per.groupBy(label).agg(F.max(F.struct("times", (-F.col("__first")).alias("f"), "text")).alias("__b"))
    if limit == 1:
        return best.select(label, F.lit(1).cast("bigint").alias("place"), "__b.text", "__b.times")
    return top_k(per, [label], [F.col("times").desc(), F.col("__first").asc()], limit).select(label, "place", "text", "times")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, *, salt: int = 16) -> DataFrame:
    """First k rows per key with their place; a salted first pass keeps hot keys spread out."""
    from pyspark.sql import Window as W

    keys = list(keys)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salt)))
    near = salted.withColumn("place", F.row_number().over(W.partitionBy(*keys, "__salt").orderBy(*order))).filter(F.col("place") <= k)
    return near.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint")).filter(F.col("place") <= k).drop("__salt")


def unique_samples(samples: DataFrame, order: str, *, digest: str = "hash", polygon: str = "polygon", label: str = "label", well: str = "well") -> DataFrame:
    """First sample per (hash, polygon); a second label is a conflict, a second well blanks the well."""
    first = F.min_by(F.struct(label, well, order), order)
    per = samples.groupBy(digest, polygon).agg(
        first.alias("f"), F.count(F.lit(1)).alias("copies"), F.countDistinct(label).alias("__labels"))
    # Only copies that agree with the first sample's label can blank its well.
    kinds = samples.select(digest, polygon, F.col(label).alias("__l"), F.col(well).alias("__w")).distinct()
    joined = kinds.join(per.select(digest, polygon, "f"), [digest, polygon])
    odd = joined.filter((F.col("__l") == F.col(f"f.{label}")) & (F.col("__w") != F.col(f"f.{well}"))).select(digest, polygon).distinct().withColumn("__odd", F.lit(True))
    return per.join(odd, [digest, polygon], "left").select(
        digest, polygon, F.col(f"f.{order}").alias(order), F.col(f"f.{label}").alias(label),
        F.when(F.col("__odd"), "").otherwise(F.col(f"f.{well}")).alias(well), "copies", (F.col("__labels") > 1).alias("conflict"))


def unique_annotations(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First row per annotation key."""
    keys = list(keys)
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("__r")).select(*keys, "__r.*")


def preflight(samples: DataFrame, registry: DataFrame, *, label: str = "label", split: str = "split") -> DataFrame:
    """Per class: totals per side, missing and unvalidated flags."""
    counts = samples.groupBy(label).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(F.col(split) == "train").alias("train"), F.count_if(F.col(split) == "val").alias("val"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return registry.select(label).join(counts, label, "left").select(label, zero("samples"), zero("train"), zero("val")).withColumns({
        "missing": F.col("samples") == 0, "unvalidated": (F.col("train") > 0) & (F.col("val") == 0)})


def preflight_findings(table: DataFrame, *, least: int = 5) -> DataFrame:
    """Blockers and warnings of a preflight table as rows."""
    present = F.when(F.col("samples") > 0, F.col("samples"))
    agg = table.agg(
        F.sum("samples").alias("n"), F.max(present).alias("hi"), F.min(present).alias("lo"), F.count_if("missing").alias("missing"), F.count_if("unvalidated").alias("unvalidated"))
    rules = [
        (F.col("n") < least, "blocker", "too few samples"), (F.col("hi") > F.col("lo") * 5, "warning", "class imbalance"),
        (F.col("missing") > 0, "warning", "classes without samples"), (F.col("unvalidated") > 0, "warning", "classes without validation")]
    return agg.select(F.inline(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("kind"), F.lit(m).alias("finding"))) for c, k, m in rules]))))


def quality_summary(masks: DataFrame, duplicates: DataFrame, *, label: str = "label", least: int = 5) -> DataFrame:
    """One row of label quality (N16): verified, underrepresented, unnamed, missing depth, sizes, duplicates, imbalance."""
    named = is_named(F.col(label))
    per = masks.filter(named).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    spread = per.agg(
        F.count_if(F.col("n") < least).alias("underrepresented"),
        ((F.count(F.lit(1)) > 1) & (F.sum("n") >= 12) & (F.max("n") >= 4 * F.min("n"))).alias("severe_imbalance")).withColumn("__k", F.lit(1))
    whole = masks.agg(
        F.count_if(named).alias("verified"), F.count_if(~named).alias("unnamed"), F.count_if(named & ~F.col("has_depth")).alias("missing_depth"),
        F.count_if(named & (F.col("size_kind") == "small")).alias("too_small"), F.count_if(named & (F.col("size_kind") == "large")).alias("too_large")).withColumn("__k", F.lit(1))
    dup = duplicates.agg(F.count(F.lit(1)).alias("duplicates")).withColumn("__k", F.lit(1))
    return whole.join(spread, "__k").join(dup, "__k").drop("__k")


def recommend_epochs(facts: DataFrame) -> DataFrame:
    """Epoch recommendation from one row of dataset facts.

    Facts: masks, photos, wells, classes, min_class, min_class_photos, new_classes (NULL when
    the catalog is unknown), suspicious, severe_imbalance.
    """
    c = F.col
    base = F.when(c("masks") < 20, 60).when(c("masks") < 50, 50).when(c("masks") < 100, 40).when(c("masks") < 250, 32).otherwise(24)
    some = c("masks") > 0
    shifts = [
        F.least(F.lit(15), F.greatest(F.lit(0), c("classes") - 2) * 2),
        F.when((c("photos") <= 1) & some, -15).when((c("photos") <= 3) & some, -8).when(c("photos") >= 10, 5).otherwise(0),
        F.when(c("wells") >= 2, 5).otherwise(0), F.when(c("masks") / F.greatest(F.lit(1), c("photos")) >= 8, -5).otherwise(0),
        F.when((c("min_class") > 0) & (c("min_class") <= 2), -5).otherwise(0), F.when((c("min_class_photos") == 1) & some, -5).otherwise(0),
        F.when(c("severe_imbalance"), -5).otherwise(0), F.when(c("new_classes") > 0, F.least(F.lit(20), 6 * c("new_classes"))).otherwise(0),
        F.when(c("suspicious") > 0, -5).otherwise(0)]
    five = lambda v: (5 * F.rint(v / 5.0)).cast("bigint")
    epochs = base
    for s in shifts:
        epochs = epochs + s
    low = (c("photos") < 4) | (c("min_class") < 3) | (c("min_class_photos") < 2) | (c("suspicious") > 0)
    mid = (c("photos") < 10) | (c("min_class") < 5) | c("severe_imbalance") | c("new_classes").isNull()
    out = facts.withColumn("recommended_epochs", five(F.greatest(F.lit(15), F.least(F.lit(100), epochs)))).withColumn(
        "confidence", F.when(low, "low").when(mid, "medium").otherwise("high"))
    margin = F.when(c("confidence") == "low", 15).otherwise(F.greatest(F.lit(15), five(c("recommended_epochs") * 0.35)))
    return out.withColumns({
        "max_epochs": F.least(F.lit(150), c("recommended_epochs") + margin).cast("bigint"),
        "patience": F.greatest(F.lit(8), F.least(F.lit(20), F.rint(c("recommended_epochs") * 0.25))).cast("bigint")})


def dataset_warnings(facts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Small or weakly independent dataset warnings as rows."""
    c = F.col
    rules = [
        (c("photos") < 20, "few photos"), (c("masks") < F.greatest(F.lit(40), c("classes") * 10), "few masks"),
        ((c("train_photos") < 10) | (c("val_photos") < 3), "small split"), (c("min_class") < 10, "sparse classes"),
        ((c("classes") > 1) & (c("max_class") >= 5 * c("min_class")), "class imbalance"), (c("split_strategy") != "well", "split not by well"),
        (c("synthetic_wells"), "synthetic well names")]
    return facts.select(*keys, F.explode(F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in rules]))).alias("warning"))


def report_blockers(report: DataFrame, counters: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Non-zero blocking counters, pending approvals and other errors of a report row."""
    rows = [F.when(F.coalesce(c, F.lit(0)) > 0, F.struct(F.lit(c).alias("blocker"), F.col(c).cast("bigint").alias("amount"))) for c in counters]
    pending = F.col("annotations") - F.col("approved_annotations")
    rows.append(F.when(pending > 0, F.struct(F.lit("pending approvals").alias("blocker"), pending.cast("bigint").alias("amount"))))
    found = F.array_compact(F.array(*rows))
    other = F.when((F.size(found) == 0) & (F.col("blocking_errors") > 0), F.array(F.struct(F.lit("other errors").alias("blocker"), F.col("blocking_errors").cast("bigint").alias("amount"))))
    return report.select(*keys, F.inline(F.coalesce(other, found)))


def validation_report(registry: DataFrame, metrics: DataFrame, *, label: str = "label") -> DataFrame:
    """Per-class precision, recall and F1 with absent classes marked."""
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.when(p.isNotNull() & r.isNotNull(), 0.0))
    j = registry.select(label).join(metrics, label, "left")
    return j.withColumns({"f1": f1, "status": F.when(p.isNull() & r.isNull(), "not_evaluated").when(p.isNull() | r.isNull(), "invalid_metrics").otherwise("evaluated")})


def macro_f1(report: DataFrame) -> DataFrame:
    return report.agg(F.round(F.avg(F.when(F.col("status") == "evaluated", F.col("f1"))), 6).alias("macro_f1"), F.count_if(F.col("status") == "evaluated").alias("evaluated"))


def metric_changes(current: DataFrame, baseline: DataFrame, *, label: str = "label") -> DataFrame:
    """Per-class metric differences against a baseline."""
    b = baseline.select(label, F.col("f1").alias("__b"))
    return current.join(b, label).select(label, (F.col("f1") - F.col("__b")).alias("f1_change"))


def tail_split(rows: DataFrame, order: str, *, share: float = 0.2, width: int = 8192) -> DataFrame:
    """Last 20 % by order is validation, at least one row."""
    from depthlake.operators.scan import numbered

    n = rows.count()
    val = max(1, _half_even(n * share))
    one = rows.withColumn("__k", F.lit(0))
    placed = numbered(one, ["__k"], [order], "__i", width=width)
    return placed.withColumn("split", F.when(F.col("__i") <= n - val, "train").otherwise("val")).drop("__i", "__k")


def restore_targets(annotations: DataFrame, rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Class targets re-read by (file, sheet, row); unresolved rows are marked, not guessed."""
    one = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[F.min(v).alias(f"__{v}") for v in values])
    j = annotations.join(one, list(keys), "left")
    good = F.col("__n") == 1
    return j.select(*[c for c in annotations.columns if c not in values], *[F.when(good, F.col(f"__{v}")).alias(v) for v in values], F.coalesce(good, F.lit(False)).alias("resolved"))


def revision(columns: Sequence[str]) -> Column:
    """Digest of everything a review looked at."""
    return F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])), 256)


def carry_approvals(current: DataFrame, previous: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Approval survives only where nothing that was reviewed has changed."""
    old = previous.select(revision(columns).alias("__r"), "approved").groupBy("__r").agg(F.max("approved").alias("__ok"))
    return current.withColumn("__r", revision(columns)).join(old, "__r", "left").withColumn("approved", F.coalesce("__ok", F.lit(False))).drop("__r", "__ok")


def apply_approvals(rows: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Approval changes by key."""
    u = updates.select(key, F.col("approved").alias("__u"))
    return rows.join(u, key, "left").withColumn("approved", F.coalesce("__u", "approved")).drop("__u")


def latest_snapshots(entries: DataFrame, invalid: DataFrame, *, source: str = "source") -> DataFrame:
    """Latest confirmed entry per source, without invalidated sources; repeats of a signature collapse (T4)."""
    per = entries.groupBy(source, "signature").agg(F.min("confirmed_at").alias("first_at"), F.max("confirmed_at").alias("confirmed_at"))
    best = per.groupBy(source).agg(F.max_by(F.struct("signature", "first_at", "confirmed_at"), F.struct("confirmed_at", "signature")).alias("b"))
    return best.join(invalid.select(source).distinct(), source, "left_anti").select(source, "b.signature", "b.confirmed_at")


def recover_unlisted(listed: DataFrame, found: DataFrame, invalid: DataFrame, *, source: str = "source") -> DataFrame:
    """Approved snapshots that the catalog has lost, merged back (T5)."""
    lost = found.join(listed.select(source, "signature"), [source, "signature"], "left_anti")
    return latest_snapshots(listed.unionByName(lost), invalid, source=source)


def approved_snapshot(annotations: DataFrame, photos: DataFrame, *, photo: str = "photo", digest: str = "hash") -> tuple[DataFrame, DataFrame]:
    """Approved annotations and the photos they use, photo names prefixed by content hash."""
    approved = annotations.filter("approved")
    used = photos.join(approved.select(photo).distinct(), photo, "left_semi")
    named = used.withColumn("stored_name", F.concat(F.substring(digest, 1, 12), F.lit("_"), F.col(photo).cast("string")))
    return approved.join(named.select(photo, "stored_name"), photo), named


def new_classes(rows: DataFrame, known: DataFrame | None, *, label: str = "label") -> DataFrame:
    """Classes the model has not seen (U4); without a catalog nothing can be called new."""
    names = rows.select(label).distinct()
    return names.limit(0) if known is None else names.join(known.select(label), label, "left_anti")


def table_digest(rows: DataFrame, columns: Sequence[str], *, buckets: int = 4096) -> DataFrame:
    """Order-free digest of a table (F33): row digests are summed per bucket, bucket sums are hashed in order."""
    row = F.sha2(F.to_json(F.struct(*columns)), 256)
    part = lambda i: F.conv(F.substring("__h", 1 + 8 * i, 8), 16, 10).cast("bigint")
    sums = rows.select(row.alias("__h")).withColumn("__b", F.pmod(F.xxhash64("__h"), F.lit(buckets))).groupBy("__b").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(part(i)).alias(f"s{i}") for i in range(4)])
    ordered = F.array_sort(F.collect_list(F.struct("__b", "n", *[f"s{i}" for i in range(4)])))
    return sums.agg(F.sha2(F.to_json(ordered), 256).alias("digest"), F.sum("n").alias("rows"))
