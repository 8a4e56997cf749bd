"""Ordered prefix scans that never put a whole key into one task.

A window ``PARTITION BY key ORDER BY x`` sorts every row of a hot key in a single
task.  The scans here work in two levels instead:

1. rows are windowed per ``(key, block)``, a block being a fixed-width slice of the
   order axis (so a hot key is spread over its blocks);
2. one total per block is carried over the earlier blocks of the key;
3. the carried value is joined back on ``(key, block)`` and combined.

The second window sees one row per block, i.e. depth range / block width rows.
Callers first collapse rows that share a position, so a block never holds more rows
than positions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from depthlake.session import ensure_checkpoint_dir

BLOCK = "__block"
BALANCED = 1 << 33  # one block per sorted partition of ``balanced_positions``
BLOCK_CM = 1024
UNPLACED = -(1 << 60)  # block of the rows without a position


def with_block(df: DataFrame, position: str, width: int = BLOCK_CM, keys: Sequence[str] = (), nulls: bool = False) -> DataFrame:
    """Add the block of a row; rows without a position are the first block with ``nulls``, else they go.

    Rows without a key have no order to stand in and always go.  The explicit filter gives both
    users of a blocked frame the same plan below their shuffle, so Spark runs that shuffle once.
    """
    block = F.floor(F.col(position) / F.lit(width)).cast("bigint")
    blocked = df.withColumn(BLOCK, F.coalesce(block, F.lit(UNPLACED)) if nulls else block)
    known = F.col(BLOCK).isNotNull()
    for key in keys:
        known = known & F.col(key).isNotNull()
    return blocked.filter(known)


def _local(kind: str, value: Column, frame) -> Column:
    if kind == "last":
        return F.last(F.when(value.isNotNull(), F.struct(value.alias("v"))), ignorenulls=True).over(frame)
    return {"max": F.max, "min": F.min, "sum": F.sum}[kind](value).over(frame)


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind == "last":
        return F.coalesce(local, carry)["v"]
    if kind == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    return (F.greatest if kind == "max" else F.least)(local, carry)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, tuple[str, str]],
    *,
    width: int = BLOCK_CM,
    reverse: bool = False,
    inclusive: bool = False,
    nulls: bool = True,
    whole: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Add prefix aggregates over the rows before (or after, ``reverse``) each row.

    ``values`` maps an output name to ``(kind, column)``; kinds are max, min, sum and
    last (the nearest non-null value).  ``order[0]`` is the block axis; rows without it come
    first, unless ``nulls`` is off.  ``whole`` adds aggregates (max, min or sum) over all rows of the
    key, which come with the carried totals and so need no join of their own.  A frame that has its
    blocks (``with_block``) keeps them, so scans in a row need no new shuffle.
    """
    keys, order, whole = list(keys), list(order), dict(whole or {})
    blocked = df if BLOCK in df.columns else with_block(df, order[0], width, keys, nulls)
    direction = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    frame = (
        W.partitionBy(*keys, BLOCK).orderBy(*direction)
        .rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    )
    local = blocked.select(
        "*", *[_local(kind, F.col(col), frame).alias(f"__l_{name}") for name, (kind, col) in values.items()]
    )
    rank = F.struct(*[F.col(c) for c in order])
    pick = F.min_by if reverse else F.max_by
    totals = []
    for name, (kind, col) in values.items():
        value = F.col(col)
        if kind == "last":
            total = pick(F.struct(value.alias("v")), F.when(value.isNotNull(), rank))
            total = F.when(F.max(value.isNotNull()), total)
        else:
            total = {"max": F.max, "min": F.min, "sum": F.sum}[kind](value)
        totals.append(total.alias(f"__t_{name}"))
    totals += [REDUCERS[kind](col).alias(f"__t_{name}") for name, (kind, col) in whole.items()]
    block_order = F.col(BLOCK).desc() if reverse else F.col(BLOCK).asc()
    outer = W.partitionBy(*keys).orderBy(block_order).rowsBetween(W.unboundedPreceding, -1)
    carries = []
    for name, (kind, _) in values.items():
        total = F.col(f"__t_{name}")
        carry = (
            F.last(total, ignorenulls=True) if kind == "last"
            else {"max": F.max, "min": F.min, "sum": F.sum}[kind](total)
        )
        carries.append(carry.over(outer).alias(f"__c_{name}"))
    over_all = W.partitionBy(*keys)
    carries += [REDUCERS[kind](f"__t_{name}").over(over_all).alias(f"__c_{name}") for name, (kind, _) in whole.items()]
    carried = blocked.groupBy(*keys, BLOCK).agg(*totals).select(*keys, BLOCK, *carries)
    # A block may hold one row, so there can be as many blocks as rows: merged, never broadcast.
    joined = local.join(carried.hint("merge"), [*keys, BLOCK])
    return joined.select(
        *df.columns,
        *[
            _combine(kind, F.col(f"__l_{name}"), F.col(f"__c_{name}")).alias(name)
            for name, (kind, _) in values.items()
        ],
        *[F.col(f"__c_{name}").alias(name) for name in whole],
    )


def balanced_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "__at") -> DataFrame:
    """Global position in (keys, order) whose blocks are equally filled whatever the skew.

    A range sort splits hot keys and even equal positions (``order`` ends in a unique
    column); the position is made durable by a checkpoint before it is used as a block
    axis, with ``width=BALANCED``.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.orderBy(*keys, *order).withColumn(name, F.monotonically_increasing_id()).checkpoint()


REDUCERS = {"min": F.min, "max": F.max, "sum": F.sum}


def chains(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    linked,
    aggs: Mapping[str, tuple[str, str]],
    *,
    keep: Sequence[str] = (),
    width: int = BLOCK_CM,
    nulls: bool = True,
) -> DataFrame:
    """Reduce maximal chains of neighbours: a row joins the row before it when ``linked``.

    ``linked(prev, cur)`` gets two structs of the row's columns.  ``aggs`` maps an output
    to ``(min | max | sum, column)``; ``keep`` columns come from the first row of a chain.
    Chains are built and reduced inside each block first; only one row per block takes
    part in stitching them across blocks.
    """
    keys, order, keep = list(keys), list(order), list(keep)
    row = F.struct(*[F.col(c) for c in df.columns])
    at = F.struct(*[F.col(c) for c in order])
    # Shuffled before the structs are built, so no column is shuffled twice.
    blocked = with_block(df, order[0], width, keys, nulls).repartition(*keys, BLOCK).select("*", row.alias("__row"), at.alias("__at"))
    local = W.partitionBy(*keys, BLOCK).orderBy("__at")
    before = F.lag("__row").over(local)
    marked = blocked.withColumn("__before", before)
    fresh = F.when(F.col("__before").isNull() | ~F.coalesce(linked(F.col("__before"), F.col("__row")), F.lit(False)), 1).otherwise(0)
    runs = marked.withColumn("__new", fresh).withColumn(
        "__run", F.sum("__new").over(local.rowsBetween(W.unboundedPreceding, 0)))
    reduced = [REDUCERS[kind](col).alias(name) for name, (kind, col) in aggs.items()]
    pieces = runs.groupBy(*keys, BLOCK, "__run").agg(
        F.min("__at").alias("__start"), F.min_by("__row", "__at").alias("__first"), F.max_by("__row", "__at").alias("__last"), *reduced)
    blocks = pieces.groupBy(*keys, BLOCK).agg(
        F.min_by("__first", "__run").alias("__bf"), F.max_by("__last", "__run").alias("__bl"),
        F.max_by("__start", "__run").alias("__bs"), F.count(F.lit(1)).alias("__n"))
    over = W.partitionBy(*keys).orderBy(BLOCK)
    joined_on = F.coalesce(linked(F.lag("__bl").over(over), F.col("__bf")), F.lit(False))
    blocks = blocks.withColumn("__joins", joined_on)
    blocks = blocks.withColumn("__open", F.when((F.col("__n") > 1) | ~F.col("__joins"), F.col("__bs")))
    entry = F.last("__open", ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, -1))
    stitched = blocks.select(*keys, BLOCK, "__joins", entry.alias("__entry"))
    whole = pieces.join(stitched.hint("merge"), [*keys, BLOCK]).withColumn(
        "__start", F.when((F.col("__run") == 1) & F.col("__joins"), F.col("__entry")).otherwise(F.col("__start")))
    first = F.min_by("__first", F.struct(BLOCK, "__run"))
    return (
        whole.groupBy(*keys, "__start")
        .agg(first.alias("__first"), *[REDUCERS[kind](name).alias(name) for name, (kind, _) in aggs.items()])
        .select(*keys, *[F.col(f"__first.{c}").alias(c) for c in keep], *aggs)
    )


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn",
    *, width: int = BLOCK_CM, dense: bool = False,
) -> DataFrame:
    """``row_number`` per key in ``order`` without one task per key.

    ``dense`` is for tables where one stretch of ``width`` positions can hold more rows
    than a task should: blocks are then cut by row count instead of position.
    """
    one = df.withColumn("__one", F.lit(1).cast("bigint"))
    if dense:
        placed = balanced_positions(one, keys, order)
        return running(placed, keys, ["__at"], {name: ("sum", "__one")}, width=BALANCED, inclusive=True).drop("__one", "__at")
    return running(one, keys, order, {name: ("sum", "__one")}, width=width, inclusive=True).drop("__one")
