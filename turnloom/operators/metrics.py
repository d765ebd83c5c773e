"""Evaluation of detected shots, cameras and scenes against manual annotation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions.columns import precision_recall
from turnloom.plans.ordered import blocked, neighbours, running

COUNTS = ("tp", "fp", "fn", "tn")


def with_scores(counts: DataFrame) -> DataFrame:
    return counts.withColumns(precision_recall(*[F.col(c).cast("double") for c in COUNTS]))


def _by_source() -> list:
    n = lambda s: F.count_if(F.col("source") == s)
    return [n("Both").alias("tp"), n("Automatic").alias("fp"), n("Manual").alias("fn")]


def evaluate_shots(shots: DataFrame, fps: float = 25.0, by: Sequence[str] = ("episode",)) -> DataFrame:
    """Found by both = hit; true negatives are the remaining video frames."""
    c = shots.groupBy(*by).agg(*_by_source(), F.max("end_ms").alias("_end"))
    frames = F.floor(F.col("_end") / F.lit(1000.0 / fps))
    return with_scores(c.withColumn("tn", frames - F.col("tp") - F.col("fp") - F.col("fn")).drop("_end"))


def evaluate_recurring(shots: DataFrame, by: Sequence[str] = ("episode",)) -> DataFrame:
    """Per shot: does a shot of the same manual camera exist, of the same detected camera, of both?

    Counts per label pair decide this for all shots carrying the pair, so no
    pair of shots is ever formed.
    """
    by = list(by)
    cell = shots.groupBy(*by, "cam_manual", "cam_auto").agg(F.count(F.lit(1)).alias("n"))
    man = cell.groupBy(*by, "cam_manual").agg(F.sum("n").alias("n_man"))
    aut = cell.groupBy(*by, "cam_auto").agg(F.sum("n").alias("n_aut"))
    c = cell.join(man, [*by, "cam_manual"]).join(aut, [*by, "cam_auto"])
    m, a, both = F.col("n_man") > 1, F.col("n_aut") > 1, F.col("n") > 1
    kind = F.when(~m & ~a, "tn").when(m & ~a, "fn").when(~m & a, "fp").when(both, "tp").otherwise("fp")
    k = c.withColumn("kind", kind)
    return with_scores(k.groupBy(*by).agg(*[F.sum(F.when(F.col("kind") == x, F.col("n")).otherwise(0)).alias(x) for x in COUNTS]))


def evaluate_scenes(scenes: DataFrame, by: Sequence[str] = ("episode",)) -> DataFrame:
    """Scene boundaries at shot level; the first boundary of a group is given and not counted.

    ``scenes``: scene_idx, source, n_shots.
    """
    by = list(by)
    first = scenes.groupBy(*by).agg(F.min("scene_idx").alias("_first"))
    s = scenes.join(first, by)
    late = F.col("scene_idx") > F.col("_first")
    n = lambda x: F.count_if(late & (F.col("source") == x))
    c = s.groupBy(*by).agg(n("Both").alias("tp"), n("Automatic").alias("fp"), n("Manual").alias("fn"), F.sum("n_shots").alias("_n"))
    return with_scores(c.withColumn("tn", F.col("_n") - 1 - F.col("tp") - F.col("fp") - F.col("fn")).drop("_n"))


def coverage_overflow(ref: DataFrame, hyp: DataFrame, sizes: DataFrame, by: Sequence[str] = ("episode",), block: int = 4096) -> DataFrame:
    """Coverage and overflow of hypothesised scenes, weighted by the size of each reference scene.

    ``ref`` and ``hyp`` list 0-based first shots (``pos``) per group, ``sizes``
    the number of shots ``n``.  All shot ranges are inclusive.
    """
    by = list(by)
    tag = lambda df, c: df.select(*by, "pos", F.lit(1).alias(c)).distinct()
    marks = tag(ref, "_r").join(tag(hyp, "_h"), [*by, "pos"], "full_outer")
    marks, blk = blocked(marks, by, F.floor(F.col("pos") / F.lit(block))), "_b"
    here = F.when(F.col("_h").isNotNull(), F.col("pos"))
    m = running(marks, by, ["pos"], blk, {"scene": ("sum", F.coalesce("_r", F.lit(0))), "hyp_before": ("last", here)})
    m = running(m, by, ["pos"], blk, {"hyp_after": ("last", here)}, reverse=True)
    m = neighbours(m, by, ["pos"], blk, nxt={"next_mark": F.col("pos")})
    m = m.join(sizes.select(*by, (F.col("n") - 1).alias("last_shot")), by)
    piece = m.withColumn("piece", F.coalesce("next_mark", F.col("last_shot") + 1) - F.col("pos"))
    widest = piece.groupBy(*by, "scene").agg(F.max("piece").alias("widest"))
    r = m.where("_r = 1").select(*by, "scene", "pos", "hyp_before", "hyp_after", "last_shot")
    r, sblk = blocked(r, by, F.floor(F.col("scene") / F.lit(block))), "_b"
    r = neighbours(r, by, ["scene"], sblk, prev={"prev_inf": F.col("pos")}, nxt={"next_inf": F.col("pos"), "next_hyp": F.col("hyp_after")})
    r = neighbours(r, by, ["scene"], sblk, nxt={"next2_inf": F.col("next_inf")})
    r = r.withColumns({
        "sup": F.coalesce(F.col("next_inf") - 1, "last_shot"),
        "next_sup": F.coalesce(F.col("next2_inf") - 1, "last_shot"),
        "prev_inf": F.coalesce("prev_inf", F.lit(0)),
    })
    r = r.join(widest, [*by, "scene"])
    size = F.col("sup") - F.col("pos") + 1
    left = F.col("pos") - F.greatest("hyp_before", "prev_inf")
    right = F.coalesce(F.least(F.col("next_hyp") - 1, F.col("next_sup")), "last_shot") - F.col("sup")
    around = (F.col("pos") - F.col("prev_inf")) + (F.col("next_sup") - F.col("sup"))
    over = F.when(around > 0, (left + right) / around)
    out = r.groupBy(*by).agg(
        (F.sum("widest") / F.max("last_shot")).alias("coverage"), (F.sum(over * size) / F.max("last_shot")).alias("overflow")
    )
    p = 1 - F.col("overflow")
    return out.withColumn("f_score", F.when(p + F.col("coverage") > 0, 2 * p * F.col("coverage") / (p + F.col("coverage"))).otherwise(0.0))
