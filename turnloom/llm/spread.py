"""Joins with an index of groups in which a few groups may hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group with at least this share of all rows is hot, so at most ``HOT`` groups are.
HOT = 1000


def join_groups(rows: DataFrame, index: DataFrame, keys: Sequence[str], size: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``index``, which has one row per key and the group's ``size`` in rows.

    Rows of hot groups meet their index row by broadcast (``HOT`` rows at most,
    since sizes add up to ``total``); all others by a shuffled join.  Keys must
    not be null.  Rows without an index row fall out.
    """
    keys = list(keys)
    hot = F.broadcast(index.where(F.col(size) * HOT >= F.lit(total)))
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(index, keys))
