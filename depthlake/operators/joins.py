"""Ranked-candidate, unique-or-null and reconciliation joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def with_capacity(photos: DataFrame, capacities: DataFrame, *, key: str = "photo") -> DataFrame:
    """Measured capacity as a column; photos without one get NULL."""
    return photos.join(capacities.select(key, "capacity_cm"), key, "left")


def unpivot_bases(layers: DataFrame) -> DataFrame:
    """One row per usable depth system of a layer (J2): basis, r_top_cm, r_base_cm.

    ``layers``: top_cm, base_cm, gis_top_cm, gis_base_cm, thickness_cm (declared or NULL),
    thickness_valid, primary_gis.
    """
    main = F.struct(F.when(F.col("primary_gis"), "gis").otherwise("drilling").alias("basis"), F.col("top_cm").alias("t"), F.col("base_cm").alias("b"))
    spare_ok = ~F.col("primary_gis") & (F.col("gis_base_cm") > F.col("gis_top_cm")) & F.coalesce(
        F.col("thickness_cm") == F.col("gis_base_cm") - F.col("gis_top_cm"), F.lit(True))
    spare = F.struct(F.lit("gis").alias("basis"), F.col("gis_top_cm").alias("t"), F.col("gis_base_cm").alias("b"))
    both = F.array_compact(F.array(F.when(F.col("thickness_valid"), main), F.when(spare_ok, spare)))
    keep = [c for c in layers.columns if c not in ("top_cm", "base_cm", "gis_top_cm", "gis_base_cm", "thickness_cm", "thickness_valid", "primary_gis")]
    return layers.select(*keep, F.explode(both).alias("__b")).select(
        *keep, F.col("__b.basis").alias("basis"), F.col("__b.t").alias("r_top_cm"), F.col("__b.b").alias("r_base_cm"))


def match_photos(photos: DataFrame, layers: DataFrame, *, photo: str = "photo", well: str = "well") -> DataFrame:
    """Layer matches in one depth system per photo.

    A photo with a known ``depth_basis`` keeps it; otherwise the system that covers most
    without conflict wins, drilling on ties.
    """
    from depthlake.operators import intervals as iv

    rows = unpivot_bases(layers)
    asked = photos.select(photo, well, "top_cm", "base_cm", F.col("depth_basis").alias("__want"))
    pairs = iv.overlap_join(asked, rows, [well]).filter((F.col("__want") == F.col("basis")) | ~F.col("__want").isin("drilling", "gis"))
    score = iv.union_length(pairs.select(photo, "basis", "overlap_top_cm", "overlap_base_cm"), [photo, "basis"], top="overlap_top_cm", base="overlap_base_cm")
    best = score.groupBy(photo).agg(F.max_by("basis", F.struct(
        (F.col("union_cm") - F.col("double_counted_cm")).alias("s"), (-F.col("double_counted_cm")).alias("c"), (F.col("basis") == "drilling").alias("d"))).alias("basis"))
    return pairs.join(best, [photo, "basis"], "left_semi").drop("__want")


def inherit_only_well(photos: DataFrame, layers: DataFrame, *, well: str = "well") -> DataFrame:
    """A photo without a well takes the only well; with several it stays unresolved."""
    wells = layers.filter(F.col(well).isNotNull()).agg(F.min(well).alias("lo"), F.max(well).alias("hi"))
    only = wells.select(F.when(F.col("lo") == F.col("hi"), F.col("lo"))).scalar()
    return photos.withColumn(well, F.coalesce(F.col(well), only))


GRAM = 3
NAME_GRAM = 8  # of names, which are short: a key of a well is then nearly always a gram of its own
FEW_KEYS = 200_000  # keys up to which one row a key is sent to every task; more of them are shuffled


def _digest(c: Column) -> Column:
    """Short stand-in of a text of any length."""
    return F.unhex(F.sha2(c, 256))


def contained_keys(texts: DataFrame, keys: DataFrame, *, ident: str, text: str = "text", key: str = "key", gram: int = GRAM) -> DataFrame:
    """(ident, key): every known key that a text contains.

    A key of up to ``gram`` characters is looked up by equality among the pieces of its length that a
    text offers, so only what is contained is ever joined.  A longer key is looked up by the one of its
    grams that the fewest texts have, and only then is the whole key looked for in the text.  Work grows
    with the length of a text (times ``gram`` at most), not with its square, and no text meets all keys;
    but texts that share few grams, like numbers, meet many long keys, so a larger ``gram`` suits them.
    Rows of grams carry a digest of their key, never a text, and Spark's size check does not see how
    many rows an explode makes, so the joins of grams say themselves which side is small.
    """
    asked_texts = texts.select(ident, F.col(text).alias("__text"))
    longest = asked_texts.agg(F.max(F.length("__text"))).scalar()
    known = keys.select(F.col(key).alias("__key")).filter((F.col("__key") != "") & (F.length("__key") <= longest)).distinct()
    whole = known.filter(F.length("__key") <= gram)
    long = known.filter(F.length("__key") > gram).withColumn("__kid", _digest(F.col("__key")))
    sizes = whole.select(F.collect_set(F.length("__key"))).scalar()
    cuts = lambda c, n: F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))  # all overlapping cuts in one pass
    few = known.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    near = lambda df: F.broadcast(df) if few else df.hint("merge")

    asked_for = lambda n: F.when(F.array_contains("__sizes", n), cuts(F.col("__text"), n))
    pieces = F.array_distinct(F.flatten(F.array_compact(F.array(*[asked_for(n) for n in range(1, gram + 1)]))))
    cut = asked_texts.withColumn("__sizes", F.coalesce(sizes, F.array().cast("array<int>"))).select(ident, F.explode(pieces).alias("__key"))
    held = cut.join(near(whole), "__key").select(ident, F.col("__key").alias(key)).distinct()

    offered = asked_texts.filter(F.length("__text") > gram).select(ident, F.explode(F.array_distinct(cuts(F.col("__text"), gram))).alias("__gram"))
    own = long.select("__kid", F.explode(F.array_distinct(cuts(F.col("__key"), gram))).alias("__gram"))
    common = offered.groupBy("__gram").agg(F.count(F.lit(1)).alias("__texts"))
    anchors = own.join(common, "__gram", "left").groupBy("__kid").agg(
        F.min_by("__gram", F.struct("__texts", "__gram")).alias("__gram"), F.bool_and(F.col("__texts").isNotNull()).alias("__met")).filter("__met").drop("__met")
    asked = offered.join(near(anchors), "__gram").select(ident, "__kid").distinct()
    pairs = asked.join(long, "__kid").select(ident, "__key")
    found = pairs.join(asked_texts.hint("merge"), ident).filter(F.contains("__text", F.col("__key"))).select(ident, F.col("__key").alias(key)).distinct()
    return held.unionByName(found)


def longest_key(texts: DataFrame, keys: DataFrame, *, ident: str, text: str = "text", key: str = "key", gram: int = GRAM) -> DataFrame:
    """Longest known key contained in a text."""
    hits = contained_keys(texts, keys, ident=ident, text=text, key=key, gram=gram)
    return hits.groupBy(ident).agg(F.max_by(key, F.struct(F.length(key), F.col(key))).alias(key))


def resolve_wells(photos: DataFrame, wells: DataFrame, *, photo: str = "photo", well: str = "well", text: str = "text", key: str = "key") -> DataFrame:
    """``photos`` with ``well`` resolved: the only known key for all, else the longest key in the photo's text, else as it was.

    Photos of a well share their text, so each distinct text is looked up once and joined back.
    """
    known = wells.select(key).filter(F.col(key) != "").distinct()
    span = known.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    only = span.select(F.when(F.col("lo") == F.col("hi"), F.col("lo"))).scalar()
    asked = photos.select(F.col(text).alias("__asked")).distinct()
    found = longest_key(asked, known, ident="__asked", text="__asked", key=key, gram=NAME_GRAM).withColumnRenamed(key, "__found")
    joined = photos.join(found.hint("merge"), F.col(text) == F.col("__asked"), "left")
    return joined.withColumn(well, F.coalesce(only, F.col("__found"), F.col(well))).drop("__found", "__asked")


def unique_or_null(candidates: DataFrame, keys: Sequence[str], score: str, answer: str) -> DataFrame:
    """Best-scored answer per key, NULL unless exactly one answer has that score."""
    keys = list(keys)
    top = candidates.groupBy(*keys, answer).agg(F.max(score).alias("__s"))
    best = top.groupBy(*keys).agg(F.max(F.struct(F.col("__s"))).alias("__m"))
    ties = top.join(best, keys).filter(F.col("__s") == F.col("__m.__s"))
    return ties.groupBy(*keys).agg(F.when(F.count(F.lit(1)) == 1, F.min(answer)).alias(answer), F.count(F.lit(1)).alias("candidates"))


def log_file_wells(logs: DataFrame, names: DataFrame) -> DataFrame:
    """Well of a log file by file-name key: equal 100, well name 95, word prefix 80.

    ``logs``: file, key; ``names``: well, key, is_well.  The whole key of one side is looked up among
    the word prefixes of the other, so a first word that many keys share meets only itself.
    """
    prefixes = lambda k: F.transform(F.sequence(F.lit(1), F.size(F.split(k, "_"))), lambda n: F.array_join(F.slice(F.split(k, "_"), F.lit(1), n), "_"))
    left = logs.filter("key <> ''").select("file", F.col("key").alias("log_key"))
    right = names.filter("key <> ''").select("well", "is_well", F.col("key").alias("name_key"))
    begun = left.withColumn("p", F.explode(prefixes(F.col("log_key")))).join(right.withColumn("p", F.col("name_key")), "p")
    shorter = right.withColumn("p", F.explode(prefixes(F.col("name_key")))).filter("p <> name_key")
    hits = begun.unionByName(left.withColumn("p", F.col("log_key")).join(shorter.hint("merge"), "p"))
    same = F.col("log_key") == F.col("name_key")
    score = F.when(F.col("is_well"), F.when(same, 95)).when(same, 100).otherwise(80)
    return unique_or_null(hits.withColumn("score", score).filter("score IS NOT NULL"), ["file"], "score", "well")


def resolve_class(rows: DataFrame, catalog: DataFrame, ident: Sequence[str], *, label: str = "label", index: str = "index") -> DataFrame:
    """Strict, case-sensitive class lookup by model label or code, narrowed by index."""
    ident = list(ident)
    names = catalog.select("class_id", F.col("index").alias("c_index"), F.explode(F.array_distinct(F.array("model_label", "code"))).alias("__k"))
    asked = rows.select(*ident, F.trim(F.coalesce(label, F.lit(""))).alias("__k"), F.trim(F.coalesce(F.col(index).cast("string"), F.lit(""))).alias("__i"))
    hits = asked.join(names, "__k").filter((F.col("__i") == "") | (F.col("__i") == F.col("c_index")))
    one = hits.groupBy(*ident).agg(F.count(F.lit(1)).alias("__n"), F.min("class_id").alias("class_id")).filter("__n = 1").drop("__n")
    return rows.join(one, ident, "left")


def legend_lookup(rows: DataFrame, legend: DataFrame, ident: Sequence[str], aliases: dict[str, str], *, label: str = "label", name: str = "name") -> DataFrame:
    """Legend entry of a label by ranked rules: alias, name, alias word inside, containment.

    Aliases are a short fixed list, so they are tested in the row; containment, either way,
    is looked up by rare 3-grams of distinct labels and names.
    """
    ident = list(ident)
    text = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    exact_alias = F.lit(None).cast("string")
    word = F.lit(None).cast("string")
    for token, target in reversed(list(aliases.items())):
        exact_alias = F.when(text == token, target.lower()).otherwise(exact_alias)
        word = F.when(text.contains(token), target.lower()).otherwise(word)
    labels = rows.select(text.alias("__l"), exact_alias.alias("__a"), word.alias("__w")).distinct().withColumn("__lid", _digest(F.col("__l")))
    entries = legend.select(F.col(name).alias("__name"), F.lower(name).alias("__k"), F.col("pos").alias("__pos"))
    tries = labels.select("__lid", F.explode(F.array(
        F.struct(F.lit(0).alias("r"), F.col("__a").alias("k")),
        F.struct(F.when(F.col("__a").isNull(), 1).alias("r"), F.col("__l").alias("k")),
        F.struct(F.lit(2).alias("r"), F.col("__w").alias("k")))).alias("t")).select("__lid", F.col("t.r").alias("r"), F.col("t.k").alias("__k"))
    direct = tries.filter("r IS NOT NULL AND __k IS NOT NULL").join(entries, "__k").select("__lid", "r", "__name", "__pos")
    asking = labels.filter("__l <> ''").select("__lid", "__l")
    of_label = contained_keys(asking, entries, ident="__lid", text="__l", key="__k")
    of_entry = contained_keys(entries.select("__k").filter("__k <> ''").distinct(), asking, ident="__k", text="__k", key="__l")
    touching = of_label.select("__lid", "__k").unionByName(of_entry.select(_digest(F.col("__l")).alias("__lid"), "__k")).distinct()
    around = touching.join(entries, "__k").select("__lid", F.lit(3).alias("r"), "__name", "__pos")
    best = direct.unionByName(around).groupBy("__lid").agg(F.min(F.struct("r", "__pos", "__name")).alias("__b"))
    return rows.withColumn("__lid", _digest(text)).join(best.select("__lid", F.col("__b.__name").alias("entry")), "__lid", "left").select(*ident, label, "entry")


def overlay(defaults: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    """Saved values over defaults, saved-only rows appended."""
    values = [c for c in defaults.columns if c != key]
    s = saved.select(key, *[F.col(c).alias(f"s_{c}") for c in values])
    return defaults.join(s, key, "full").select(key, *[F.coalesce(f"s_{c}", c).alias(c) for c in values])


def pair_by_keys(workbooks: DataFrame, folders: DataFrame) -> DataFrame:
    """Workbook to photo-folder pairs by shared keys; every doubt is NULL with a reason.

    ``workbooks``: workbook, key; ``folders``: folder, key, wells (distinct explicit wells).
    """
    usable = folders.filter("wells <= 1").select("folder", "key").filter("key <> ''").distinct()
    hits = workbooks.filter("key <> ''").hint("merge").join(usable, "key").select("workbook", "folder").distinct()
    per = hits.groupBy("workbook").agg(F.count(F.lit(1)).alias("__n"), F.min("folder").alias("folder"))
    owners = per.filter("__n = 1").groupBy("folder").agg(F.count(F.lit(1)).alias("__owners"))
    # One row per workbook: as large as the workbooks, so merged and never broadcast.
    joined = workbooks.select("workbook").distinct().join(per.hint("merge"), "workbook", "left").join(owners, "folder", "left")
    reason = (
        F.when(F.col("__n").isNull(), "no folder").when(F.col("__n") > 1, "several folders")
        .when(F.col("__owners") > 1, "folder shared by workbooks").otherwise(""))
    return joined.withColumn("reason", reason).select("workbook", F.when(F.col("reason") == "", F.col("folder")).alias("folder"), "reason")


def probe_unpaired(pairs: DataFrame, probes: DataFrame, folders: DataFrame) -> DataFrame:
    """Second pass: unresolved workbooks by the only well written inside them."""
    open_ = pairs.filter("reason = 'no folder'").select("workbook")
    inside = probes.join(open_, "workbook", "left_semi").groupBy("workbook").agg(
        F.countDistinct("well_key").alias("__w"), F.min("well_key").alias("key")).filter("__w = 1").select("workbook", "key")
    again = pair_by_keys(inside, folders)
    return pairs.join(again, "workbook", "left_anti").unionByName(again)


def lane_of_token(tokens: DataFrame, columns: DataFrame, *, photo: str = "photo", row: str = "text_row") -> DataFrame:
    """Nearest column of a depth token inside its lane; the surest token per row and column.

    ``tokens``: photo, text_row, token, x, value, confidence; a photo has a few columns.
    """
    lanes = columns.groupBy(photo).agg(F.sort_array(F.collect_list(F.struct(
        "col", ((F.col("left") + F.col("right")) / 2).alias("c"), (F.col("right") - F.col("left")).alias("w")))).alias("cs"))
    near = tokens.join(lanes, photo).withColumn("__b", F.array_min(F.transform("cs", lambda s: F.struct(
        F.abs(F.col("x") - s["c"]).alias("d"), s["col"].alias("col"), s["c"].alias("c"), s["w"].alias("w")))))
    gap = F.array_min(F.transform(F.filter("cs", lambda s: s["col"] != F.col("__b.col")), lambda s: F.abs(s["c"] - F.col("__b.c"))))
    ok = F.col("__b.d") <= F.greatest(F.col("__b.w") * 1.25, F.coalesce(gap, F.col("__b.w")) * 0.48)
    best = near.filter(ok).groupBy(photo, row, F.col("__b.col").alias("col")).agg(
        F.max_by("value", F.struct("confidence", (-F.col("x")).alias("x"))).alias("value"))
    return best


def pair_depth_rows(rows: DataFrame, columns: DataFrame, *, photo: str = "photo") -> DataFrame:
    """Header x footer rows of one depth system (J20): photo, basis, pairing, col, top_cm, base_cm.

    ``rows``: photo, text_row, side (header | footer), basis, col, value (cm).  Spans are
    1 to 150 cm and at least 60 % of the columns must pair.
    """
    need = columns.groupBy(photo).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * F.lit(0.6).cast("decimal(3,1)"))).alias("__need"))
    spread = rows.groupBy(photo, "text_row", "side", "basis").agg(F.count(F.lit(1)).alias("__c")).join(need.hint("merge"), photo).filter("__c >= __need")
    order = W.partitionBy(photo, "side").orderBy("text_row")
    count = W.partitionBy(photo, "side")
    spread = spread.withColumns({"__i": F.row_number().over(order), "__n": F.count(F.lit(1)).over(count)})
    h = spread.filter("side = 'header'").select(photo, "__need", F.col("text_row").alias("top_row"), F.col("basis").alias("hb"), F.col("__i").alias("hi"), F.col("__n").alias("hn"))
    f = spread.filter("side = 'footer'").select(photo, F.col("text_row").alias("base_row"), F.col("basis").alias("fb"), F.col("__i").alias("fi"), F.col("__n").alias("fn"))
    known = (F.col("hb") != "unknown") & (F.col("fb") != "unknown")
    links = h.join(f.hint("merge"), photo).filter(F.when(known, F.col("hb") == F.col("fb")).otherwise((F.col("hn") == F.col("fn")) & (F.col("hi") == F.col("fi"))))
    tops = rows.select(photo, F.col("text_row").alias("top_row"), "col", F.col("value").alias("top_cm"))
    bases = rows.select(photo, F.col("text_row").alias("base_row"), "col", F.col("value").alias("base_cm"))
    # Rows may come from an explode, which Spark's size check takes for its input; so they are merged, never broadcast.
    spans = links.join(tops.hint("merge"), [photo, "top_row"]).join(bases.hint("merge"), [photo, "base_row", "col"]).filter((F.col("base_cm") - F.col("top_cm")).between(1, 150))
    enough = spans.groupBy(photo, "top_row", "base_row").agg(F.count(F.lit(1)).alias("__m"))
    return spans.join(enough.hint("merge"), [photo, "top_row", "base_row"]).filter("__m >= __need").select(
        photo, "top_row", "base_row", F.when(F.col("hb") != "unknown", F.col("hb")).otherwise(F.col("fb")).alias("basis"), "col", "top_cm", "base_cm")


def coherent_labels(sets: DataFrame, columns: DataFrame, expected: DataFrame, *, photo: str = "photo") -> DataFrame:
    """Best complete depth-label set per photo.

    ``sets``: photo, set_id, basis, col (left to right), top_cm, base_cm; ``expected``: photo,
    exp_top_cm, exp_base_cm.  A set labels every column, does not overlap, runs one way, has
    gaps up to 50 cm and stays near the expected span; least error, then drilling, then gaps.
    """
    n = columns.groupBy(photo).agg(F.count(F.lit(1)).alias("__n"))
    depth, space = W.partitionBy(photo, "set_id").orderBy("top_cm"), W.partitionBy(photo, "set_id").orderBy("col")
    steps = sets.withColumns({
        "__gap": F.col("top_cm") - F.lag("base_cm").over(depth), "__dir": F.signum((F.col("top_cm") - F.lag("top_cm").over(space)).cast("double"))})
    whole = steps.groupBy(photo, "set_id", "basis").agg(
        F.count(F.lit(1)).alias("__c"), F.min("__gap").alias("__lo"), F.max("__gap").alias("__hi"), F.sum(F.coalesce("__gap", F.lit(0))).alias("__sum"),
        F.min("__dir").alias("__d0"), F.max("__dir").alias("__d1"), F.min("top_cm").alias("__t"), F.max("base_cm").alias("__b"))
    ok = (
        (F.col("__c") == F.col("__n")) & (F.coalesce("__lo", F.lit(0)) >= 0) & (F.coalesce("__hi", F.lit(0)) <= 50)
        & (F.col("__d0").isNull() | ((F.col("__d0") == F.col("__d1")) & (F.col("__d0") != 0)))
        & (F.col("__t") >= F.col("exp_top_cm") - 50) & (F.col("__b") <= F.col("exp_base_cm") + 50))
    error = F.abs(F.col("__t") - F.col("exp_top_cm")) + F.abs(F.col("__b") - F.col("exp_base_cm"))
    taste = F.when(F.col("basis") == "drilling", 0).when(F.col("basis") == "gis", 1).otherwise(2)
    best = whole.join(n.hint("merge"), photo).join(expected.hint("merge"), photo).filter(ok).groupBy(photo).agg(
        F.min(F.struct(error.alias("e"), taste.alias("t"), F.col("__sum").alias("g"), F.col("set_id"))).alias("__b"))
    return sets.join(best.select(photo, F.col("__b.set_id").alias("set_id")).hint("merge"), [photo, "set_id"], "left_semi")


def zip_labels(columns: DataFrame, labels: DataFrame, image_width: int, *, photo: str = "photo") -> DataFrame:
    """One-to-one boxes and labels in x order, all or nothing per photo.

    ``labels``: photo, x (fraction of the image), top_cm, base_cm.
    """
    centre = (F.col("left") + F.col("right")) / 2 / image_width
    b = columns.withColumn("__n", F.row_number().over(W.partitionBy(photo).orderBy(centre, "col")))
    lab = labels.withColumn("__n", F.row_number().over(W.partitionBy(photo).orderBy("x", "top_cm", "base_cm")))
    sizes = columns.groupBy(photo).agg(F.count(F.lit(1)).alias("__nb")).join(
        labels.groupBy(photo).agg(F.count(F.lit(1)).alias("__nl"), F.countDistinct("x").alias("__nx")), photo)
    joined = b.join(lab, [photo, "__n"]).join(sizes, photo)
    good = (F.abs(F.col("x") - centre) <= F.greatest(F.lit(0.03), (F.col("right") - F.col("left")) / image_width)) & (F.col("base_cm") - F.col("top_cm")).between(1, 150)
    depth, space = W.partitionBy(photo).orderBy("top_cm", "base_cm"), W.partitionBy(photo).orderBy("__n")
    steps = joined.withColumns({
        "__ok": good, "__lap": F.col("top_cm") < F.lag("base_cm").over(depth), "__dir": F.signum((F.col("top_cm") - F.lag("top_cm").over(space)).cast("double"))})
    whole = steps.groupBy(photo).agg(
        (F.min("__ok") & (F.count(F.lit(1)) == F.max("__nb")) & (F.max("__nl") == F.max("__nb")) & (F.max("__nx") == F.max("__nl"))
         & ~F.coalesce(F.max("__lap"), F.lit(False)) & (F.min("__dir").isNull() | ((F.min("__dir") == F.max("__dir")) & (F.min("__dir") != 0)))).alias("__all"))
    return joined.join(whole.filter("__all").select(photo), photo, "left_semi").select(photo, "col", "top_cm", "base_cm")


def nearest_labels(columns: DataFrame, labels: DataFrame, image_width: int, *, photo: str = "photo") -> DataFrame:
    """Any coherent part of the labels to boxes of their own (J22, second form): photo, col, top_cm, base_cm.

    Each label takes the box with the nearest centre, within 1.25 box widths or 0.48 of the way to
    the next box, whichever is more.  A photo where a label is no 1 to 150 cm long, lies further
    off, or meets another label in one box gives nothing.
    """
    centre = (F.col("left") + F.col("right")) / 2
    order = W.partitionBy(photo).orderBy("__centre", "col")
    width = F.col("right") - F.col("left")
    lanes = columns.withColumn("__centre", centre).withColumns({"__before": F.lag("__centre").over(order), "__after": F.lead("__centre").over(order)}).select(
        photo, "col", "__centre", width.alias("__width"),
        F.coalesce(F.least(F.col("__centre") - F.col("__before"), F.col("__after") - F.col("__centre")), width).alias("__gap"))
    named = labels.withColumn("__label", F.struct("x", "top_cm", "base_cm"))
    off = F.abs(F.col("x") * image_width - F.col("__centre"))
    best = named.join(lanes, photo).groupBy(photo, "__label").agg(F.min(F.struct(off.alias("off"), "__centre", "col", "__width", "__gap")).alias("__b"))
    span = F.col("__label.base_cm") - F.col("__label.top_cm")
    good = span.between(1, 150) & (F.col("__b.off") <= F.greatest(F.col("__b.__width") * 1.25, F.col("__b.__gap") * 0.48))
    counted = labels.groupBy(photo).agg(F.count(F.lit(1)).alias("__labels"))
    whole = best.groupBy(photo).agg(F.bool_and(good).alias("__good"), F.countDistinct("__b.col").alias("__cols")).join(counted, photo)
    kept = whole.filter("__good AND __cols = __labels").select(photo)
    return best.join(kept, photo, "left_semi").select(photo, F.col("__b.col").alias("col"), F.col("__label.top_cm").alias("top_cm"), F.col("__label.base_cm").alias("base_cm"))


def enrich_labels(photos: DataFrame, labels: DataFrame, *, photo: str = "photo") -> DataFrame:
    """Photo span from its column labels; confirmed manual bounds win and stale labels go."""
    span = labels.groupBy(photo).agg(F.min("top_cm").alias("__t"), F.max("base_cm").alias("__b"), F.max("basis").alias("__basis"))
    manual = (F.col("source") == "manual") & F.col("confirmed") & F.col("top_cm").isNotNull()
    got = F.coalesce(F.col("__b") > F.col("__t"), F.lit(False))
    stale = manual & ((F.col("__t") < F.col("top_cm") - 2) | (F.col("__b") > F.col("base_cm") + 2))
    return photos.join(span, photo, "left").select(
        photo, F.when(got & ~manual, F.col("__t")).otherwise(F.col("top_cm")).alias("top_cm"),
        F.when(got & ~manual, F.col("__b")).otherwise(F.col("base_cm")).alias("base_cm"),
        F.when(got & ~manual, "ocr_verified").otherwise(F.col("source")).alias("source"),
        (got | F.col("confirmed")).alias("confirmed"), (got & ~stale).alias("has_labels"), F.when(got, F.col("__basis")).otherwise(F.col("depth_basis")).alias("depth_basis"))


def accept_reviewed(boxes: DataFrame, files: DataFrame, *, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Reviewed boxes whose file stamp is unchanged and that lie in the image; the rest as issues."""
    now = files.select(path, F.col("size").alias("__size"), F.col("mtime").alias("__mtime"), "width", "height")
    j = boxes.join(now, path, "left")
    fresh = F.coalesce((F.col("size") == F.col("__size")) & (F.col("mtime") == F.col("__mtime")), F.lit(False))
    inside = (F.col("left") >= 0) & (F.col("top") >= 0) & (F.col("right") <= F.col("width")) & (F.col("bottom") <= F.col("height")) & (F.col("right") > F.col("left")) & (F.col("bottom") > F.col("top"))
    why = F.when(F.col("__size").isNull(), "file missing").when(~fresh, "file changed").when(~inside, "box outside the image")
    marked = j.withColumn("reason", why)
    return marked.filter("reason IS NULL").select(*boxes.columns), marked.filter("reason IS NOT NULL").select(*boxes.columns, "reason")


def snapshot_changes(saved: DataFrame, current: DataFrame, *, path: str = "path") -> DataFrame:
    """Files that changed, vanished or appeared since a snapshot."""
    s = saved.select(path, F.col("size").alias("s"), F.col("mtime").alias("m"))
    c = current.select(path, F.col("size").alias("cs"), F.col("mtime").alias("cm"))
    kind = F.when(F.col("s").isNull(), "new").when(F.col("cs").isNull(), "missing").when((F.col("s") != F.col("cs")) | (F.col("m") != F.col("cm")), "changed")
    return s.join(c, path, "full").select(path, kind.alias("change")).filter("change IS NOT NULL")


def merge_queue(found: DataFrame, previous: DataFrame, projects: DataFrame, folders: DataFrame) -> DataFrame:
    """Re-scan over the previous queue: manual pairs and still valid projects survive.

    ``found``: excel, photos, reason; ``previous``: excel, photos, manual_pair, project;
    ``projects``: project, excel, photos; ``folders``: photos (existing).
    """
    alive = previous.join(folders.select("photos").distinct().withColumn("__alive", F.lit(True)), "photos", "left").select(
        "excel", F.when(F.col("manual_pair") & F.col("__alive"), F.col("photos")).alias("__manual"), F.col("project").alias("__old"))
    merged = found.join(alive, "excel", "left").withColumns({
        "photos": F.coalesce("__manual", "photos"), "manual_pair": F.col("__manual").isNotNull(), "reason": F.when(F.col("__manual").isNotNull(), "").otherwise(F.col("reason"))})
    valid = projects.select(F.col("project").alias("__old"), "excel", "photos", F.lit(True).alias("__valid"))
    return merged.join(valid, ["__old", "excel", "photos"], "left").select(
        "excel", "photos", "reason", "manual_pair", F.when(F.col("__valid"), F.col("__old")).otherwise("").alias("project"))


def zip_suggestions(unresolved: DataFrame, available: DataFrame, *, photo: str = "photo", well: str = "well") -> DataFrame:
    """Unplaced photos to free ranges by position when their counts agree; a lone range is split equally."""
    p = numbered_by(unresolved, well, "pos")
    a = numbered_by(available, well, "top_cm")
    sizes = unresolved.groupBy(well).agg(F.count(F.lit(1)).alias("__np")).join(
        available.groupBy(well).agg(F.count(F.lit(1)).alias("__na"), F.min("top_cm").alias("__t"), F.max("base_cm").alias("__b")), well)
    pairs = p.join(sizes, well)
    zipped = pairs.filter("__np = __na").join(a.select(well, "__n", "top_cm", "base_cm"), [well, "__n"]).select(
        photo, well, F.col("top_cm").cast("double").alias("top_cm"), F.col("base_cm").cast("double").alias("base_cm"), F.lit("one to one").alias("how"))
    step = (F.col("__b") - F.col("__t")) / F.col("__np")
    split = pairs.filter("__na = 1 AND __np > 1").select(
        photo, well, (F.col("__t") + (F.col("__n") - 1) * step).alias("top_cm"),
        F.when(F.col("__n") == F.col("__np"), F.col("__b").cast("double")).otherwise(F.col("__t") + F.col("__n") * step).alias("base_cm"), F.lit("equal split").alias("how"))
    return zipped.unionByName(split)


def numbered_by(df: DataFrame, key: str, order: str) -> DataFrame:
    from depthlake.operators.scan import numbered

    return numbered(df, [key], [order], "__n")


def discard_outside(photos: DataFrame, spans: DataFrame, *, photo: str = "photo", well: str = "well") -> DataFrame:
    """Reset file-name intervals that touch no span of their well (S9); wells without spans are left alone."""
    from depthlake.operators import intervals as iv

    named = photos.filter((F.col("source") == "filename") & (F.col("base_cm") > F.col("top_cm"))).select(photo, well, "top_cm", "base_cm")
    with_rows = named.join(spans.select(well).distinct(), well, "left_semi")
    right = spans.select(well, F.col("top_cm").alias("r_top_cm"), F.col("base_cm").alias("r_base_cm"))
    lost = iv.overlap_join(with_rows, right, [well], how="left_anti").select(photo, F.lit(True).alias("__lost"))
    j = photos.join(lost, photo, "left")
    gone = F.col("__lost").isNotNull()
    return j.select(*[
        F.when(gone, F.lit(None)).otherwise(F.col(c)).alias(c) if c in ("top_cm", "base_cm")
        else F.when(gone, "not_found").otherwise(F.col(c)).alias(c) if c == "source"
        else (F.col(c) & ~gone).alias(c) if c == "confirmed" else F.col(c) for c in photos.columns])
