"""Ordered passes that never put a whole group into one task.

A plain ``Window.partitionBy(group)`` sorts the whole group in one task, which
fails when one group holds a third of the data.  Every pass here works on
blocks of a group instead: a column ``block`` that grows with the order (a time
grid, or an index divided by a block length).  Rows are windowed per
(group, block); one small row per block carries the state across blocks.

The rows are shuffled once per pass: the window, the block totals and the join
with the carried state all read the same exchange.  Chained passes share it too
when the block is a column made by ``blocked`` and given by name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.session import cut

BLOCK_MS = 600_000


def time_block(col: str, size: int = BLOCK_MS) -> Column:
    return F.floor(F.col(col) / F.lit(size))


def blocked(df: DataFrame, keys: Sequence[str], block: Column, name: str = "_b") -> DataFrame:
    """Add the block column and lay the rows out by (group, block) for several passes."""
    return df.withColumn(name, block).repartition(*keys, name)


def _laid_out(df: DataFrame, keys: list[str], block: Column | str) -> tuple[DataFrame, str]:
    if isinstance(block, str):
        return df, block
    return blocked(df, keys, block, "_blk"), "_blk"


def _local(kind: str, col: Column) -> Column:
    if kind == "last":
        return F.last(col, ignorenulls=True)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](col)


def _merge(kind: str, before: Column, here: Column) -> Column:
    if kind == "sum":
        both = before + here
        return F.coalesce(both, here, before)
    if kind == "max":
        return F.greatest(before, here)
    if kind == "min":
        return F.least(before, here)
    return F.coalesce(here, before)


PART = "_part"
FAN = 64  # blocks under one node of the tree of totals


def ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` as a written table, dealt to tasks by ranges of ``order``, with the number of the range (``PART``).

    The ranges are sampled, so they hold about equally many rows whatever the
    values look like; equal rows of ``order`` share a range.
    """
    return cut(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id().cast("long")))


def _tree(per_block: DataFrame, aggs: dict, reverse: bool) -> DataFrame:
    """What comes before each block of one sequence: block (a number) and ``_c_`` columns from its ``_t_`` columns.

    Totals are summed up a tree with ``FAN`` blocks to a node and carried down
    again, so no task sees more than ``FAN`` rows of a level.
    """
    flip = (lambda c: F.col(c).desc()) if reverse else (lambda c: F.col(c).asc())

    def whole(kind: str, col: Column) -> Column:
        if kind == "last":
            return (F.min_by if reverse else F.max_by)(col, F.when(col.isNotNull(), F.col("_n0")))
        return _local(kind, col)

    names = list(aggs)
    levels = [per_block.withColumnRenamed(PART, "_n0")]
    for _ in range(3):  # FAN ** 4 blocks under the root
        below = levels[-1]
        up = below.groupBy(F.floor(F.col("_n0") / FAN).alias("_up")).agg(*[whole(aggs[n][0], F.col(f"_t_{n}")).alias(f"_t_{n}") for n in names])
        levels.append(up.withColumnRenamed("_up", "_n0"))
    carried = None
    for level in reversed(levels):
        up = F.floor(F.col("_n0") / FAN)
        w = Window.partitionBy(up).orderBy(flip("_n0")).rowsBetween(Window.unboundedPreceding, -1)
        here = level.select("_n0", up.alias("_up"), *[_local(aggs[n][0], F.col(f"_t_{n}")).over(w).alias(f"_w_{n}") for n in names])
        if carried is None:
            carried = here.select("_n0", *[F.col(f"_w_{n}").alias(f"_c_{n}") for n in names])
        else:
            above = carried.withColumnRenamed("_n0", "_up")
            carried = here.join(above, "_up", "left").select(
                "_n0", *[_merge(aggs[n][0], F.col(f"_c_{n}"), F.col(f"_w_{n}")).alias(f"_c_{n}") for n in names])
    return carried.withColumnRenamed("_n0", PART)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column | str | None,
    aggs: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    reverse: bool = False,
) -> DataFrame:
    """Running ``sum``/``max``/``min``/``last`` (last non-null) per group in order.

    Without keys the whole table is one sequence: ``block`` is not used then,
    the blocks are ranges of ``order`` and what they carry goes up and down a tree.
    """
    keys, order = list(keys), list(order)
    if keys:
        src, blk = _laid_out(df, keys, block)
    else:
        src, blk = ranged(df, order), PART
    flip = (lambda c: F.col(c).desc()) if reverse else (lambda c: F.col(c).asc())
    rows = (
        Window.partitionBy(*keys, blk)
        .orderBy(*[flip(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    here = src.withColumns({f"_h_{n}": _local(k, c).over(rows) for n, (k, c) in aggs.items()})

    def total(kind: str, col: Column) -> Column:
        if kind == "last":
            tagged = F.when(col.isNotNull(), F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], col.alias("v")))
            return (F.min if reverse else F.max)(tagged)["v"]
        return _local(kind, col)

    per_block = src.groupBy(*keys, blk).agg(*[total(k, c).alias(f"_t_{n}") for n, (k, c) in aggs.items()])
    if keys:
        blocks = Window.partitionBy(*keys).orderBy(flip(blk)).rowsBetween(Window.unboundedPreceding, -1)
        carry = per_block.select(
            *keys, blk, *[_local(k, F.col(f"_t_{n}")).over(blocks).alias(f"_c_{n}") for n, (k, _) in aggs.items()]
        )
    else:
        carry = _tree(per_block, aggs, reverse)
    out = here.join(carry.hint("merge"), [*keys, blk], "left")  # both lie by group and block: no copy of it in the driver
    return out.select(
        *df.columns, *[_merge(k, F.col(f"_c_{n}"), F.col(f"_h_{n}")).alias(n) for n, (k, _) in aggs.items()]
    )


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column | str,
    prev: dict[str, Column] | None = None,
    nxt: dict[str, Column] | None = None,
) -> DataFrame:
    """Values of the previous / next row of the group, NULL at its ends."""
    keys, order = list(keys), list(order)
    src, blk = _laid_out(df, keys, block)
    rows = Window.partitionBy(*keys, blk).orderBy(*order)
    blocks = Window.partitionBy(*keys).orderBy(blk)
    at = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])
    here, edges, carried = src, [], []
    for tag, cols, shift, pick in (("p", prev, F.lag, F.max_by), ("n", nxt, F.lead, F.min_by)):
        if not cols:
            continue
        packed = F.struct(*[c.alias(n) for n, c in cols.items()])
        here = here.withColumn(f"_h{tag}", shift(packed).over(rows))
        edges.append(pick(packed, at).alias(f"_e{tag}"))
        carried.append(shift(F.col(f"_e{tag}")).over(blocks).alias(f"_c{tag}"))
    carry = src.groupBy(*keys, blk).agg(*edges).select(*keys, blk, *carried)
    out = here.join(carry.hint("merge"), [*keys, blk], "left")  # both lie by group and block: no copy of it in the driver
    picked = []
    for tag, cols in (("p", prev), ("n", nxt)):
        for n in cols or {}:
            picked.append(F.coalesce(F.col(f"_h{tag}"), F.col(f"_c{tag}"))[n].alias(n))
    return out.select(*df.columns, *picked)


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column | str | None, name: str = "idx") -> DataFrame:
    """Dense 1-based position of each row in its group; without ``block``, blocks are ranges of (keys, order)."""
    if keys and block is None:
        out = running(ranged(df, [*keys, *order]), keys, order, PART, {name: ("sum", F.lit(1).cast("long"))})
        return out.drop(PART)
    return running(df, keys, order, block, {name: ("sum", F.lit(1).cast("long"))})


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    prev: dict[str, Column],
    starts: Column,
    name: str = "island",
) -> DataFrame:
    """Number the runs of rows; ``starts`` may use the ``prev`` columns (NULL on the first row)."""
    near = neighbours(blocked(df, keys, block), keys, order, "_b", prev=prev)
    flagged = near.withColumn("_new", F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0).cast("long"))
    out = running(flagged, keys, order, "_b", {name: ("sum", F.col("_new"))})
    return out.drop("_new", "_b", *prev)


def with_halo(df: DataFrame, idx: str, back: int, ahead: int, size: int = 4096) -> DataFrame:
    """Copy rows near a block edge into the neighbour block.

    ``idx`` must be a dense position.  A window of at most ``back`` rows before
    and ``ahead`` rows after is then exact inside each ``_hb`` for the rows
    with ``_own``; only the few rows at the edges are copied.
    """
    own = F.floor(F.col(idx) / F.lit(size))
    first = F.floor((F.col(idx) - F.lit(ahead)) / F.lit(size))
    last = F.floor((F.col(idx) + F.lit(back)) / F.lit(size))
    return df.withColumn("_hb", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_hb") == own)


def band(df: DataFrame, keys: Sequence[str], idx: str, width: int, cols: Sequence[str]) -> DataFrame:
    """Pairs (i, j), ``0 < j - i <= width`` in a group, by an equi-join on position.

    (group, position) is unique, so a group of any size spreads over all tasks
    and the output grows linearly with the rows.  Columns get suffix 1 and 2.
    """
    keys, cols = list(keys), list(cols)
    left = df.select(*keys, F.col(idx).alias(f"{idx}1"), *[F.col(c).alias(f"{c}1") for c in cols]).withColumn(
        f"{idx}2", F.explode(F.sequence(F.col(f"{idx}1") + 1, F.col(f"{idx}1") + F.lit(width)))
    )
    right = df.select(*keys, F.col(idx).alias(f"{idx}2"), *[F.col(c).alias(f"{c}2") for c in cols])
    return left.join(right, [*keys, f"{idx}2"])


TILE = 256


def tiled(df: DataFrame, keys: Sequence[str], idx: str, ends: DataFrame, left: bool) -> DataFrame:
    """Rows repeated once per pair of tiles (``_ti``, ``_tj``) in which they are a left (right) partner."""
    own = F.floor(F.col(idx) / F.lit(TILE))
    t = df.join(ends, list(keys)).withColumn("_own", own)
    span = F.sequence(F.col("_own"), F.col("_last")) if left else F.sequence(F.col("_first"), F.col("_own"))
    t = t.withColumn("_tj" if left else "_ti", F.explode(span)).withColumnRenamed("_own", "_ti" if left else "_tj")
    return t.drop("_first", "_last")


def tile_ends(df: DataFrame, keys: Sequence[str], idx: str) -> DataFrame:
    tile = F.floor(F.col(idx) / F.lit(TILE))
    return df.groupBy(*keys).agg(F.min(tile).alias("_first"), F.max(tile).alias("_last"))


def pairs_within(df: DataFrame, keys: Sequence[str], idx: str, cols: Sequence[str]) -> DataFrame:
    """All pairs (i, j), i < j, of a group, spread over pairs of tiles of ``TILE`` positions.

    A task sees at most ``TILE`` squared pairs per key, whatever the size of a
    group.  Columns get suffix 1 and 2.
    """
    keys, cols = list(keys), list(cols)
    ends = tile_ends(df, keys, idx)
    side = lambda n: df.select(*keys, F.col(idx).alias(f"{idx}{n}"), *[F.col(c).alias(f"{c}{n}") for c in cols])
    a, b = tiled(side(1), keys, f"{idx}1", ends, True), tiled(side(2), keys, f"{idx}2", ends, False)
    return a.join(b, [*keys, "_ti", "_tj"]).where(F.col(f"{idx}1") < F.col(f"{idx}2")).drop("_ti", "_tj")
