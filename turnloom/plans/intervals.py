"""Interval joins as equi-joins on a time grid.

Catalyst has no range join, so a bare ``between`` would become a nested loop.
Here an interval is repeated once per grid cell it touches and the join runs on
(keys, cell); a wide key is spread over its cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.plans.ordered import running, time_block

GRID_MS = 600_000


def _cell(col: Column, grid: int) -> Column:
    return F.floor(col / F.lit(grid))


def contains(
    points: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    at: Column,
    start: str,
    end: str,
    closed: bool = False,
    how: str = "inner",
    grid: int = GRID_MS,
) -> DataFrame:
    """Spans holding each point; half-open unless ``closed``."""
    keys = list(keys)
    p = points.withColumn("_at", at).withColumn("_cell", _cell(F.col("_at"), grid))
    s = spans.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.col(c).alias(c) for c in spans.columns if c not in keys],
    ).withColumn("_scell", F.explode(F.sequence(_cell(F.col(start), grid), _cell(F.greatest(F.col(end), F.col(start)), grid))))
    cond = (F.col("_cell") == F.col("_scell")) & (F.col("_at") >= F.col(start))
    cond = cond & ((F.col("_at") <= F.col(end)) if closed else (F.col("_at") < F.col(end)))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    return p.join(s, cond, how).drop("_at", "_cell", "_scell", *[f"_k_{k}" for k in keys])


def overlaps(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    lspan: tuple[str, str],
    rspan: tuple[str, str],
    grid: int = GRID_MS,
) -> DataFrame:
    """Pairs with ``right.end > left.start and right.start < left.end``.

    A pair is kept only in the cell of its later start, so no de-duplication
    shuffle is needed.
    """
    keys = list(keys)
    (ls, le), (rs, re_) = lspan, rspan

    def spread(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.withColumn("_cell", F.explode(F.sequence(_cell(F.col(s), grid), _cell(F.greatest(F.col(e), F.col(s)), grid))))

    return (
        spread(left, ls, le)
        .join(spread(right, rs, re_), [*keys, "_cell"])
        .where((F.col(re_) > F.col(ls)) & (F.col(rs) < F.col(le)))
        .where(F.col("_cell") == _cell(F.greatest(F.col(ls), F.col(rs)), grid))
        .drop("_cell")
    )


def asof(
    points: DataFrame,
    segments: DataFrame,
    keys: Sequence[str],
    at: str,
    start: str,
    carry: Sequence[str],
    tie: Sequence[str] = (),
    block: int = GRID_MS,
) -> DataFrame:
    """Each point with the last segment whose ``start`` is not later.

    Segments and points are merged into one ordered pass (no nested loop); at
    equal times a segment comes before a point.
    """
    keys, carry, tie = list(keys), list(carry), list(tie)
    packed = F.struct(*[F.col(c) for c in carry])
    a = segments.select(
        *keys, F.col(start).alias("_t"), F.lit(0).alias("_kind"), packed.alias("_seg"),
        *([F.col(t).cast("string").alias(f"_tie{i}") for i, t in enumerate(tie)]),
        F.lit(None).cast(points.select(F.struct("*").alias("p")).schema["p"].dataType).alias("_pt"),
    )
    b = points.select(
        *keys, F.col(at).alias("_t"), F.lit(1).alias("_kind"),
        F.lit(None).cast(segments.select(packed.alias("s")).schema["s"].dataType).alias("_seg"),
        *([F.lit(None).cast("string").alias(f"_tie{i}") for i in range(len(tie))]),
        F.struct(*points.columns).alias("_pt"),
    )
    order = ["_t", "_kind", *[f"_tie{i}" for i in range(len(tie))]]
    got = running(a.unionByName(b), keys, order, time_block("_t", block), {"_hit": ("last", F.col("_seg"))})
    return got.where("_kind = 1").select("_pt.*", *[F.col("_hit")[c].alias(c) for c in carry])
