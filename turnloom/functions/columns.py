"""Column expressions shared by the operators; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def format_position(ms: Column | str) -> Column:
    """``mm:ss.zzz``, with hours once the position passes 3600 whole seconds."""
    ms = _c(ms).cast("long")
    sec = F.floor(ms / 1000)
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    tail = F.concat(two(F.floor(sec / 60) % 60), F.lit(":"), two(sec % 60), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))
    return F.when(sec > 3600, F.concat(two(F.floor(sec / 3600) % 60), F.lit(":"), tail)).otherwise(tail)


def clean_label(s: Column | str) -> Column:
    """Trim and squeeze blanks."""
    return F.trim(F.regexp_replace(_c(s), r"\s+", " "))


def abbreviate_label(s: Column | str) -> Column:
    """``First Last`` becomes ``F. Last``; a single word stays."""
    s = _c(s)
    pat = "^(.).+ (.+)$"
    return F.when(s.rlike(pat), F.concat(F.regexp_extract(s, pat, 1), F.lit(". "), F.regexp_extract(s, pat, 2))).otherwise(s)


def pair_low(a: Column | str, b: Column | str) -> Column:
    return F.least(_c(a), _c(b))


def pair_high(a: Column | str, b: Column | str) -> Column:
    return F.greatest(_c(a), _c(b))


def canonical_pair(a: Column | str, b: Column | str) -> Column:
    """Undirected key of a pair: smaller name first."""
    return F.struct(pair_low(a, b).alias("src"), pair_high(a, b).alias("dst"))


def scene_code(season: Column | str, episode: Column | str, scene: Column | str) -> Column:
    """``SxxEyy_zzz``; numbers wider than their field are kept whole."""
    def pad(c, n):
        s = _c(c).cast("string")
        return F.when(F.length(s) >= n, s).otherwise(F.lpad(s, n, "0"))

    return F.concat(F.lit("S"), pad(season, 2), F.lit("E"), pad(episode, 2), F.lit("_"), pad(scene, 3))


def add_interlocutor(arr: Column | str, s: Column | str) -> Column:
    """Append if absent, keep the list sorted."""
    return F.array_sort(F.array_distinct(F.array_append(_c(arr), _c(s))))


def sigmoid(x: Column, lam: float = 0.01) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-lam) * x))


def seconds(start: str = "start_ms", end: str = "end_ms") -> Column:
    return (F.col(end) - F.col(start)) / F.lit(1000.0)


def overlap_sizes(a: Column, b: Column) -> tuple[Column, Column]:
    """Cardinalities of the intersection and the union of two sets held as arrays."""
    return F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))


def precision_recall(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Precision, recall, F and accuracy; 0 where a ratio is undefined."""
    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f_score": ratio(2 * p * r, p + r), "accuracy": ratio(tp + tn, tp + fp + fn + tn)}
