"""Interval algebra on integer centimetres, half-open ``[top, base)``.

Every operator takes ``keys`` (the columns two intervals must share to interact) and
survives a key that holds a large part of the table: joins split a key into depth
bins, scans run per depth block (see :mod:`depthlake.operators.scan`), and equal
intervals are collapsed by a partial aggregate before anything is sorted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from depthlake.operators.scan import BLOCK, BLOCK_CM, running, with_block

BIN_CM = 1024
CUT_CM = 256  # width of the blocks in which segments look up their spans
WIDE_CM = 16 * CUT_CM  # width of the blocks that winners are found in; their edges are stitched
SENTINEL = 1 << 60


def _eq(names: Sequence[str], left: str = "l", right: str = "r") -> Column:
    cond = F.lit(True)
    for name in names:
        cond = cond & (F.col(f"{left}.{name}") == F.col(f"{right}.{name}"))
    return cond


def overlap_bounds(top: str, base: str, other_top: str, other_base: str) -> tuple[Column, Column, Column]:
    """Overlap top, overlap base and the strict-overlap predicate."""
    lo = F.greatest(F.col(top), F.col(other_top))
    hi = F.least(F.col(base), F.col(other_base))
    return lo, hi, hi > lo


def _binned(df: DataFrame, top: str, base: str, width: int, name: str) -> DataFrame:
    first = F.floor(F.col(top) / width).cast("bigint")
    last = F.floor((F.col(base) - 1) / width).cast("bigint")
    return (
        df.filter(F.col(base) > F.col(top))
        .withColumn(f"{name}_first", first)
        .withColumn("__bin", F.explode(F.sequence(first, last)))
    )


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    left_bounds: tuple[str, str] = ("top_cm", "base_cm"),
    right_bounds: tuple[str, str] = ("r_top_cm", "r_base_cm"),
    how: str = "inner",
    bin_cm: int = BIN_CM,
    salt: int = 1,
    out: tuple[str, str] = ("overlap_top_cm", "overlap_base_cm"),
) -> DataFrame:
    """All pairs with equal keys and a positive overlap.

    Both sides are expanded to depth bins and joined on ``(keys, bin)``; a pair is kept
    only in the first bin it shares, so long intervals give no duplicates.  A bin that is
    itself hot on the left can be split with ``salt`` (right rows are then repeated).
    ``how`` may also be ``left_semi`` or ``left_anti``; these return left rows.
    Apart from the keys the two sides must not share column names.
    """
    keys = list(keys)
    lt, lb = left_bounds
    rt, rb = right_bounds
    if how in ("left_semi", "left_anti"):
        marked = left.withColumn("__row", F.xxhash64(*left.columns))
        r = right.select(*keys, rt, rb).distinct()
        hits = overlap_join(
            marked.select(*keys, lt, lb).distinct(), r, keys,
            left_bounds=left_bounds, right_bounds=right_bounds, bin_cm=bin_cm,
        ).select(*keys, lt, lb).distinct()
        cond = _eq([*keys, lt, lb])
        return left.alias("l").join(hits.alias("r").hint("merge"), cond, how)
    lhs = _binned(left, lt, lb, bin_cm, "__l")
    rhs = _binned(right, rt, rb, bin_cm, "__r")
    on = [*keys, "__bin"]
    if salt > 1:
        lhs = lhs.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salt)).cast("int"))
        rhs = rhs.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        on = [*on, "__salt"]
    lo, hi, hit = overlap_bounds(lt, lb, rt, rb)
    joined = (
        lhs.join(rhs.hint("merge"), on)
        .filter(hit & (F.col("__bin") == F.greatest("__l_first", "__r_first")))
        .withColumn(out[0], lo).withColumn(out[1], hi)
    )
    return joined.drop("__bin", "__l_first", "__r_first", "__salt")


def spans_by_top(df: DataFrame, keys: Sequence[str], top: str, base: str) -> DataFrame:
    """One row per (keys, top) with the deepest base; copies vanish map-side."""
    return (
        df.filter(F.col(base) > F.col(top))
        .groupBy(*keys, top).agg(F.max(base).alias(base))
    )


def union_intervals(
    df: DataFrame, keys: Sequence[str], *, top: str = "top_cm", base: str = "base_cm",
    tol_cm: int = 0, width: int = BLOCK_CM,
) -> DataFrame:
    """Merge overlapping or touching intervals per key.

    Islands are built per depth block; a block's leading islands join the island still
    open above it, which one row per block is enough to tell.
    """
    keys = list(keys)
    spans = with_block(spans_by_top(df, keys, top, base), top, width, keys)
    local = W.partitionBy(*keys, BLOCK).orderBy(top)
    prev = F.max(base).over(local.rowsBetween(W.unboundedPreceding, -1))
    flagged = spans.withColumn("__new", F.when(prev.isNull() | (F.col(top) > prev + tol_cm), 1).otherwise(0))
    islands = flagged.withColumn("__island", F.sum("__new").over(local.rowsBetween(W.unboundedPreceding, 0)))
    pieces = islands.groupBy(*keys, BLOCK, "__island").agg(F.min(top).alias(top), F.max(base).alias(base))
    over = W.partitionBy(*keys).orderBy(BLOCK)
    above = over.rowsBetween(W.unboundedPreceding, -1)
    blocks = pieces.groupBy(*keys, BLOCK).agg(F.max(base).alias("__b"), F.max(top).alias("__t"))
    blocks = blocks.withColumn("__reach", F.max("__b").over(above))
    own = F.col("__reach").isNull() | (F.col("__t") > F.col("__reach") + tol_cm)
    blocks = blocks.withColumn("__open", F.when(own, F.col("__t"))).select(
        *keys, BLOCK, "__reach", F.last("__open", ignorenulls=True).over(above).alias("__entry"))
    joins = F.col(top) <= F.col("__reach") + tol_cm
    whole = pieces.join(blocks.hint("merge"), [*keys, BLOCK]).withColumn("__start", F.when(joins, F.col("__entry")).otherwise(F.col(top)))
    return whole.groupBy(*keys, F.col("__start").alias(top)).agg(F.max(base).alias(base))


def union_length(
    df: DataFrame, keys: Sequence[str], *, top: str = "top_cm", base: str = "base_cm",
    width: int = BLOCK_CM,
) -> DataFrame:
    """Raw length, union length and their difference per key.

    The union length is the new ground each span adds over the running maximum, so no
    islands need to be built.
    """
    keys = list(keys)
    raw = (
        df.filter(F.col(base) > F.col(top)).groupBy(*keys, top)
        .agg(F.max(base).alias(base), F.sum(F.col(base) - F.col(top)).alias("__raw"))
    )
    prev = running(raw, keys, [top], {"__prev": ("max", base)}, width=width, nulls=False)
    fresh = F.greatest(F.lit(0), F.col(base) - F.greatest(F.col(top), F.col("__prev")))
    return (
        prev.groupBy(*keys)
        .agg(F.sum("__raw").alias("raw_cm"), F.sum(fresh).cast("bigint").alias("union_cm"))
        .withColumn("double_counted_cm", F.col("raw_cm") - F.col("union_cm"))
    )


def key_gaps(
    hosts: DataFrame, spans: DataFrame, keys: Sequence[str], *,
    host_bounds: tuple[str, str] = ("host_top_cm", "host_base_cm"),
    span_bounds: tuple[str, str] = ("top_cm", "base_cm"),
    out: tuple[str, str] = ("gap_top_cm", "gap_base_cm"),
    width: int = BLOCK_CM, hosted: bool = False,
) -> DataFrame:
    """Ground between the least host top and the greatest host base not under any span.

    ``hosted`` says that every span has a host already, so none is looked for.
    """
    keys = list(keys)
    ht, hb = host_bounds
    st, sb = span_bounds
    extent = hosts.groupBy(*keys).agg(F.min(ht).alias("__lo"), F.max(hb).alias("__hi"))
    edges = extent.select(*keys, F.explode(F.array("__lo", "__hi")).alias(st)).withColumn(sb, F.col(st))
    inside = (spans if hosted else spans.join(extent, keys, "left_semi")).filter(F.col(sb) > F.col(st))
    marks = (
        inside.select(*keys, st, sb).unionByName(edges)
        .groupBy(*keys, st).agg(F.max(sb).alias(sb))
    )
    prev = running(marks, keys, [st], {"__prev": ("max", sb)}, width=width, nulls=False)
    return (
        prev.filter(F.col(st) > F.col("__prev"))
        .select(*keys, F.col("__prev").alias(out[0]), F.col(st).alias(out[1]))
    )


def gaps(
    hosts: DataFrame, spans: DataFrame, keys: Sequence[str], *,
    host_bounds: tuple[str, str] = ("host_top_cm", "host_base_cm"),
    span_bounds: tuple[str, str] = ("top_cm", "base_cm"),
    out: tuple[str, str] = ("gap_top_cm", "gap_base_cm"),
    bin_cm: int = BIN_CM,
) -> DataFrame:
    """Parts of every host interval that no span of the same key covers.

    The uncovered ground is found once per key by a running maximum and then cut to
    the hosts by an overlap join, so many hosts over one key stay cheap.
    """
    free = key_gaps(hosts, spans, keys, host_bounds=host_bounds, span_bounds=span_bounds,
                    out=("__g_top", "__g_base"))
    return overlap_join(
        hosts, free, keys, left_bounds=host_bounds, right_bounds=("__g_top", "__g_base"),
        out=out, bin_cm=bin_cm,
    ).drop("__g_top", "__g_base")


def covered_length(
    rows: DataFrame, cover: DataFrame, keys: Sequence[str], row_id: Sequence[str], *,
    row_bounds: tuple[str, str] = ("top_cm", "base_cm"),
    cover_bounds: tuple[str, str] = ("top_cm", "base_cm"),
    bin_cm: int = BIN_CM,
) -> DataFrame:
    """Add ``covered_cm``: length of each row under the union of ``cover``.

    Equal row intervals of a key are measured once.
    """
    keys = list(keys)
    rt, rb = row_bounds
    ct, cb = cover_bounds
    merged = union_intervals(cover.select(*keys, ct, cb), keys, top=ct, base=cb).select(
        *keys, F.col(ct).alias("__c_top"), F.col(cb).alias("__c_base"))
    distinct = rows.select(*keys, rt, rb).distinct()
    hits = overlap_join(
        distinct, merged, keys, left_bounds=row_bounds, right_bounds=("__c_top", "__c_base"),
        out=("__o_top", "__o_base"), bin_cm=bin_cm,
    )
    measured = hits.groupBy(*keys, rt, rb).agg(F.sum(F.col("__o_base") - F.col("__o_top")).alias("covered_cm"))
    return (
        rows.join(measured, [*keys, rt, rb], "left")
        .withColumn("covered_cm", F.coalesce("covered_cm", F.lit(0)).cast("bigint"))
    )


def _cut(value: Column) -> Column:
    return F.floor(value / F.lit(CUT_CM)).cast("bigint")


def segment_winners(
    spans: DataFrame, segments: DataFrame, keys: Sequence[str], rank: Sequence[Column],
    payload: Sequence[str], *, top: str = "top_cm", base: str = "base_cm",
) -> DataFrame:
    """Left-join the best covering span to every elementary segment.

    Spans are cut at blocks of ``CUT_CM`` and reduced to the best (rank, payload) per cut range, so
    copies vanish map-side and a block holds at most CUT_CM * (CUT_CM + 1) / 2 ranges.  A segment
    meets its block's ranges as one array and keeps the best that covers its first centimetre: no
    span x segment pairs are formed and a segment is shuffled once.
    """
    keys, payload = list(keys), [c for c in payload if c not in keys]
    best = F.struct(*[c.alias(f"__r{i}") for i, c in enumerate(rank)], *payload)
    cut = F.col("__cut")
    ranges = (
        spans.filter(F.col(base) > F.col(top))
        .select(*keys, top, base, best.alias("__best"), F.explode(F.sequence(_cut(F.col(top)), _cut(F.col(base) - 1))).alias("__cut"))
        .groupBy(*keys, "__cut", F.greatest(F.col(top) - cut * CUT_CM, F.lit(0)).cast("int").alias("__lo"),
                 F.least(F.col(base) - cut * CUT_CM, F.lit(CUT_CM)).cast("int").alias("__hi"))
        .agg(F.max("__best").alias("__best"))
        .groupBy(*keys, "__cut").agg(F.collect_list(F.struct("__lo", "__hi", "__best")).alias("__ranges"))
    )
    at = (F.col("seg_top") - cut * CUT_CM).cast("int")
    found = segments.select(*keys, "seg_top", "seg_base", _cut(F.col("seg_top")).alias("__cut")).join(ranges.hint("merge"), [*keys, "__cut"], "left")
    over = F.filter("__ranges", lambda r: (r["__lo"] <= at) & (r["__hi"] > at))
    won = found.select(*keys, "seg_top", "seg_base", F.array_max(F.transform(over, lambda r: r["__best"])).alias("__best"))
    return won.select(*keys, "seg_top", "seg_base", *[F.col("__best")[c].alias(c) for c in payload])


def _touching(before: Sequence[str], same: Sequence[str]) -> Column:
    """1 where a run begins: its ground does not touch that of the row before, or has another winner."""
    over = W.partitionBy(*before).orderBy("seg_top")
    alike = F.lag("seg_base").over(over) == F.col("seg_top")
    for c in same:
        alike = alike & F.lag(c).over(over).eqNullSafe(F.col(c))
    return F.when(F.coalesce(alike, F.lit(False)), 0).otherwise(1)


def _runs(segments: DataFrame, keys: Sequence[str], same: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    over = W.partitionBy(*keys).orderBy("seg_top").rowsBetween(W.unboundedPreceding, 0)
    marked = segments.withColumn("__new", _touching(keys, same)).withColumn("__run", F.sum("__new").over(over))
    found = marked.groupBy(*keys, "__run", *same).agg(F.min("seg_top").alias("seg_top"), F.max("seg_base").alias("seg_base"), *[c.alias(n) for n, c in aggs.items()])
    return found.drop("__run")


def winning_runs(
    spans: DataFrame, keys: Sequence[str], best: Column, shown: Mapping[str, Column], same: Sequence[str], *,
    top: str, base: str, blank: Column | None = None, aggs: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Longest runs of ground whose best covering span agrees in ``same``: keys, same, aggs, seg_top, seg_base.

    Spans are cut at blocks of ``WIDE_CM`` and reduced to the greatest ``best`` per cut range, so copies
    vanish map-side, and then meet in their block, where everything is found without another shuffle:
    ranges per ``CUT_CM`` as one array, the pieces between their ends, the best range over each, and
    the runs.  Only runs that reach the edge of a block are shuffled once more, to be stitched.
    ``shown`` makes columns from the winner ``__best``.  Rows where ``blank`` holds are hosts, one per
    key: all else is clipped to them, and their ground without a span has a NULL winner.
    """
    keys, aggs, hosted = list(keys), dict(aggs or {}), blank is not None
    blank = blank if hosted else F.lit(False)
    block = [*keys, "__wide"]
    at = lambda c, n: F.floor(c / F.lit(n)).cast("bigint")
    clip = lambda n, c: (F.greatest(F.col("__a"), F.col(c) * n).alias("__a"), F.least(F.col("__z"), (F.col(c) + 1) * n).alias("__z"))
    wide = spans.filter(F.col(base) > F.col(top)).dropna(subset=keys).select(
        *keys, F.col(top).cast("bigint").alias("__a"), F.col(base).cast("bigint").alias("__z"), F.when(~F.coalesce(blank, F.lit(False)), best).alias("__best"), blank.alias("__blank"),
        F.explode(F.sequence(at(F.col(top), WIDE_CM), at(F.col(base) - 1, WIDE_CM))).alias("__wide"))
    whole = wide.select(*block, *clip(WIDE_CM, "__wide"), "__best", "__blank").groupBy(*block, "__a", "__z").agg(
        F.max("__best").alias("__best"), F.bool_or("__blank").alias("__blank")).repartition(*block)
    over = W.partitionBy(*block)
    ends = whole.withColumns({"__from": F.min(F.when(F.col("__blank"), F.col("__a"))).over(over), "__to": F.max(F.when(F.col("__blank"), F.col("__z"))).over(over)})
    whole = ends.select(*block, F.greatest("__a", "__from").alias("__a"), F.least("__z", "__to").alias("__z"), "__best").filter("__from IS NOT NULL AND __z > __a") if hosted else whole
    cuts = whole.select(*block, "__a", "__z", "__best", F.explode(F.sequence(at(F.col("__a"), CUT_CM), at(F.col("__z") - 1, CUT_CM))).alias("__cut"))
    ranges = cuts.select(*block, "__cut", *clip(CUT_CM, "__cut"), "__best").groupBy(*block, "__cut", "__a", "__z").agg(F.max("__best").alias("__best"))
    arrays = ranges.groupBy(*block, "__cut").agg(
        F.collect_list(F.struct("__a", "__z", "__best")).alias("__ranges"), F.sort_array(F.array_union(F.collect_set("__a"), F.collect_set("__z"))).alias("__marks"))
    ends = F.transform(F.slice("__marks", F.lit(2), F.size("__marks") - 1), lambda z, i: F.struct(F.get("__marks", i).alias("seg_top"), z.alias("seg_base")))
    pieces = arrays.select(*block, "__ranges", F.inline(ends))
    held = F.filter("__ranges", lambda r: (r["__a"] <= F.col("seg_top")) & (r["__z"] >= F.col("seg_base")))
    won = pieces.select(*block, "seg_top", "seg_base", F.array_max(F.transform(held, lambda r: r["__best"])).alias("__best"))
    won = won if hosted else won.filter("__best IS NOT NULL")
    runs = _runs(won.select(*block, "seg_top", "seg_base", *[c.alias(n) for n, c in shown.items()]), block, same, aggs)
    edge = (F.col("seg_top") == F.col("__wide") * WIDE_CM) | (F.col("seg_base") == (F.col("__wide") + 1) * WIDE_CM)
    stitched = _runs(runs.filter(edge).drop("__wide"), keys, same, aggs)
    return runs.filter(~edge).drop("__wide").unionByName(stitched)


def resolve_overlaps(
    df: DataFrame, keys: Sequence[str], *, rank: Sequence[Column], ident: str,
    payload: Sequence[str] = (), top: str = "top_cm", base: str = "base_cm",
) -> DataFrame:
    """Give each centimetre to its best-ranked interval and merge equal neighbours."""
    same = list(dict.fromkeys([ident, *payload]))
    named = [c.alias(f"__r{i}") for i, c in enumerate(rank)]
    won = winning_runs(df, keys, F.struct(*named, *same), {c: F.col("__best")[c] for c in same}, same, top=top, base=base)
    return won.filter(F.col(ident).isNotNull()).select(*keys, *same, F.col("seg_top").alias(top), F.col("seg_base").alias(base))


def partition_hosts(
    hosts: DataFrame, candidates: DataFrame, keys: Sequence[str], *, rank: Sequence[Column],
    identity: Sequence[str], confidence: str, gap_label: str, label: str,
    host_bounds: tuple[str, str] = ("host_top_cm", "host_base_cm"),
    top: str = "top_cm", base: str = "base_cm",
) -> DataFrame:
    """Gap-free partition of each host (one per key) by its candidates.

    Uncovered ground becomes an explicit ``gap_label`` band with confidence 0; bands with
    equal identity merge and keep the least confidence.
    """
    keys = list(keys)
    payload = list(dict.fromkeys([label, confidence, *identity]))
    ranked = F.struct(*[c.alias(f"__r{i}") for i, c in enumerate(rank)], *payload)
    spans = candidates.select(*keys, top, base, ranked.alias("__ranked"), F.lit(None).cast("boolean").alias("__host")).unionByName(
        hosts.select(*keys, F.col(host_bounds[0]).alias(top), F.col(host_bounds[1]).alias(base), F.lit(True).alias("__host")), allowMissingColumns=True)
    gap = F.col("__best").isNull()
    shown = {c: F.col("__best")[c] for c in payload} | {
        "gap_filled": gap, label: F.when(gap, F.lit(gap_label)).otherwise(F.col("__best")[label]),
        confidence: F.when(gap, F.lit(0)).otherwise(F.col("__best")[confidence])}
    same = [c for c in dict.fromkeys([label, *identity, "gap_filled"]) if c != confidence]
    won = winning_runs(spans, keys, F.col("__ranked"), shown, same, top=top, base=base, blank=F.col("__host"), aggs={confidence: F.min(confidence)})
    return won.withColumnsRenamed({"seg_top": top, "seg_base": base})


def coalesce_adjacent(
    df: DataFrame, keys: Sequence[str], identity: Sequence[str], order: Sequence[str], *,
    top: str = "top_cm", base: str = "base_cm", tol_cm: int = 2,
    joined: Sequence[str] = (), width: int = BLOCK_CM,
) -> DataFrame:
    """Merge consecutive layers of one identity that touch within ``tol_cm``.

    Only neighbours in (top, base, order) merge, and a layer without both depths never
    does.  ``joined`` text columns are merged as distinct values in first-seen order.
    """
    keys, identity = list(keys), list(identity)
    known = F.col(top).isNotNull() & F.col(base).isNotNull()
    ranked = df.withColumns({
        "__known": known, "__from": F.coalesce(top, F.lit(SENTINEL)), "__to": F.coalesce(base, F.lit(-SENTINEL))})
    ranked = ranked.withColumn("__at", F.struct("__from", F.coalesce(base, F.lit(0)), *order))
    ranked = ranked.withColumn("__me", F.struct("__known", *identity))
    blocked = with_block(ranked, "__from", width, keys)
    local = W.partitionBy(*keys, BLOCK).orderBy("__at")
    upto = local.rowsBetween(W.unboundedPreceding, 0)
    alike = F.coalesce(F.col("__known") & F.lag("__known").over(local) & (F.lag("__me").over(local) == F.col("__me")), F.lit(False))
    runs = blocked.withColumn("__new", F.when(alike, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(upto))
    in_run = W.partitionBy(*keys, BLOCK, "__run").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    low = F.max("__to").over(in_run)
    islands = runs.withColumn("__new", F.when(low.isNull() | (F.col("__from") > low + tol_cm), 1).otherwise(0)).withColumn(
        "__island", F.sum("__new").over(upto))
    pieces = islands.groupBy(*keys, BLOCK, "__run", "__island", "__known", "__me").agg(
        F.min("__at").alias("__start"), F.min("__from").alias("__from"), F.max("__to").alias("__to"),
        F.min(top).alias(top), F.max(base).alias(base), F.count(F.lit(1)).alias("merged_rows"))
    # One row per block: its first run, its last run and where its last island starts.
    over = W.partitionBy(*keys).orderBy(BLOCK)
    above = over.rowsBetween(W.unboundedPreceding, -1)
    runs_of = pieces.groupBy(*keys, BLOCK, "__run", "__known", "__me").agg(
        F.max("__to").alias("__to"), F.max("__start").alias("__start"), F.max("__from").alias("__last"))
    pick = lambda f, c: f(c, "__run")
    blocks = runs_of.groupBy(*keys, BLOCK).agg(
        pick(F.min_by, "__me").alias("__first"), pick(F.max_by, "__me").alias("__final"), F.count(F.lit(1)).alias("__n"),
        pick(F.max_by, "__to").alias("__to"), pick(F.max_by, "__start").alias("__bs"), pick(F.max_by, "__last").alias("__last"))
    same = F.coalesce((F.lag("__final").over(over) == F.col("__first")) & F.col("__first.__known"), F.lit(False))
    blocks = blocks.withColumn("__joins", same).withColumn(
        "__g", F.sum(F.when((F.col("__n") > 1) | ~F.col("__joins"), 1).otherwise(0)).over(over.rowsBetween(W.unboundedPreceding, 0)))
    trail = W.partitionBy(*keys, "__g").orderBy(BLOCK).rowsBetween(W.unboundedPreceding, 0)
    blocks = blocks.withColumn("__exit", F.max("__to").over(trail))
    blocks = blocks.withColumn("__reach", F.when(F.col("__joins"), F.lag("__exit").over(over)))
    swallowed = (F.col("__n") == 1) & F.coalesce(F.col("__last") <= F.col("__reach") + tol_cm, F.lit(False))
    blocks = blocks.withColumn("__open", F.when(~swallowed, F.col("__bs")))
    blocks = blocks.select(*keys, BLOCK, "__reach", F.last("__open", ignorenulls=True).over(above).alias("__entry"))
    joins = (F.col("__run") == 1) & F.coalesce(F.col("__from") <= F.col("__reach") + tol_cm, F.lit(False))
    whole = pieces.join(blocks, [*keys, BLOCK]).withColumn("__start", F.when(joins, F.col("__entry")).otherwise(F.col("__start")))
    merged = whole.groupBy(*keys, "__start", "__me").agg(
        F.min(top).alias(top), F.max(base).alias(base), F.sum("merged_rows").alias("merged_rows"))
    shaped = merged.select(*keys, "__start", *[F.col(f"__me.{c}").alias(c) for c in identity], top, base, "merged_rows")
    if not joined:
        return shaped.drop("__start")
    member = islands.join(blocks, [*keys, BLOCK]).withColumn("__start", F.when(joins, F.col("__entry")))
    starts = pieces.select(*keys, BLOCK, "__run", "__island", F.col("__start").alias("__own"))
    member = member.join(starts, [*keys, BLOCK, "__run", "__island"]).withColumn("__start", F.coalesce("__start", "__own"))
    for c in joined:
        seen = member.filter(F.trim(F.coalesce(c, F.lit(""))) != "").groupBy(*keys, "__start", c).agg(F.min("__at").alias("__seen"))
        texts = seen.groupBy(*keys, "__start").agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("__seen", F.col(c).alias("v")))), lambda s: s["v"]), " | ").alias(c))
        shaped = shaped.join(texts, [*keys, "__start"], "left")
    return shaped.drop("__start")


def merge_fragments(
    boxes: DataFrame, keys: Sequence[str], identity: Sequence[str], order: Sequence[str], *,
    min_height: Column, top: str = "top", base: str = "bottom", left: str = "left", right: str = "right",
    confidence: str = "confidence", gap: tuple[int, int] = (-2, 8), share: float = 0.65, reviewed: Column | None = None,
) -> DataFrame:
    """Drop small fragments, then grow bands of one class down a column.

    A fragment joins the band above it when its gap to the band's lower edge is inside ``gap``
    and they share at least ``share`` of the narrower width; the band grows to their common
    box and keeps the least confidence.  Reviewed boxes come back untouched.  The fold's state is
    one column's bands, which its pixel height bounds.
    """
    told = F.lit(False) if reviewed is None else F.coalesce(reviewed, F.lit(False))
    kept = boxes.filter(~told & ((F.col(base) - F.col(top)) >= min_height))
    fields = [top, *order, base, left, right, confidence, *identity]

    def joins(band, b):
        shared = F.least(band[right], b[right]) - F.greatest(band[left], b[left])
        narrow = F.least(band[right] - band[left], b[right] - b[left])
        ok = (F.greatest(shared, F.lit(0)) >= narrow * share) & (b[top] - band[base]).between(*gap)
        for c in identity:
            ok = ok & band[c].eqNullSafe(b[c])
        return F.coalesce(ok, F.lit(False))

    def grown(band, b):
        edges = {top: F.least, base: F.greatest, left: F.least, right: F.greatest, confidence: F.least}
        return F.struct(*[(edges[c](band[c], b[c]) if c in edges else band[c]).alias(c) for c in fields], (band["merged_rows"] + 1).alias("merged_rows"))

    def place(bands, b):
        n = F.size(bands)
        last = F.get(bands, n - 1)
        joined = F.concat(F.slice(bands, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(grown(last, b)))
        return F.when((n > 0) & joins(last, b), joined).otherwise(F.concat(bands, F.array(b)))

    row = F.struct(*[F.col(c) for c in fields], F.lit(1).cast("bigint").alias("merged_rows"))
    lists = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("__rows"))
    bands = lists.select(*keys, F.explode(F.aggregate("__rows", F.slice("__rows", 1, 0), place)).alias("__b"))
    made = bands.select(*keys, *[F.col(f"__b.{c}").alias(c) for c in (*identity, top, base, left, right, confidence, "merged_rows")])
    if reviewed is None:
        return made
    return made.unionByName(boxes.filter(told).withColumn("merged_rows", F.lit(1).cast("bigint")).select(*made.columns))


def tie_in(
    spans: DataFrame, pairs: DataFrame, keys: Sequence[str], *,
    span_bounds: tuple[str, str] = ("top_cm", "base_cm"),
    source: tuple[str, str] = ("gis_top_cm", "gis_base_cm"),
    target: tuple[str, str] = ("drill_top_cm", "drill_base_cm"),
    out: tuple[str, str] = ("tied_top_cm", "tied_base_cm"),
) -> DataFrame:
    """Convert spans between depth systems through each pair row they overlap."""
    good = pairs.filter(F.col(source[1]) > F.col(source[0]))
    hits = overlap_join(spans, good, keys, left_bounds=span_bounds, right_bounds=source,
                        out=("__o_top", "__o_base"))
    return hits.withColumns({
        name: scaled_cm(F.col(at), F.col(source[0]), F.col(source[1]), F.col(target[0]), F.col(target[1]))
        for name, at in zip(out, ("__o_top", "__o_base"))
    }).drop("__o_top", "__o_base")


def scaled_cm(value: Column, src_top: Column, src_base: Column, dst_top: Column, dst_base: Column) -> Column:
    """Linear map between two spans, rounded half-up to whole centimetres (exact, in whole numbers).

    The remainder tells on which side of a half the quotient lies, so nothing is divided as a decimal.
    """
    num, den = (value - src_top) * (dst_base - dst_top), src_base - src_top
    whole, rest = F.call_function("div", num, den), F.abs(num % den)
    up = F.when(rest >= F.abs(den) - rest, F.when((num < 0) == (den < 0), 1).otherwise(-1)).otherwise(0)
    return (dst_top + whole + up).cast("bigint")
