"""Joins between speech, shots, scenes and story units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.plans.intervals import asof, contains, overlaps
from turnloom.plans.ordered import neighbours, running, time_block

EP = ("episode",)


def majority_join(shots: DataFrame, segs: DataFrame, keys: Sequence[str] = EP, how: str = "inner") -> DataFrame:
    """Each segment with the shot holding more than half of it: the shot around its midpoint.

    Shot columns ``start_ms``/``end_ms`` come back as ``shot_start``/``shot_end``.
    """
    sh = shots.withColumnsRenamed({"start_ms": "shot_start", "end_ms": "shot_end"})
    return contains(segs, sh, keys, F.expr("(start_ms + end_ms) div 2"), "shot_start", "shot_end", how=how)


def overlap_join(shots: DataFrame, segs: DataFrame, keys: Sequence[str] = EP) -> DataFrame:
    """All pairs of a shot and a segment sharing time."""
    sh = shots.withColumnsRenamed({"start_ms": "shot_start", "end_ms": "shot_end"})
    return overlaps(sh, segs, keys, ("shot_start", "shot_end"), ("start_ms", "end_ms"))


def overlap_duration(shots: DataFrame, segs: DataFrame, keys: Sequence[str] = EP) -> DataFrame:
    """Seconds shared by each overlapping pair."""
    shared = F.least("end_ms", "shot_end") - F.greatest("start_ms", "shot_start")
    return overlap_join(shots, segs, keys).withColumn("shared_s", shared / 1000.0)


def locate(points: DataFrame, spans: DataFrame, at: str, keys: Sequence[str] = EP, closed: bool = False) -> DataFrame:
    """Span holding each point: shots are half-open, speech and story units closed."""
    return contains(points, spans, keys, F.col(at), "start_ms", "end_ms", closed=closed)


def locate_exact(points: DataFrame, shots: DataFrame, at: str, fps: float = 25.0, keys: Sequence[str] = EP) -> DataFrame:
    """Round a point to the frame grid (``pos_ms``) and find the shot one of whose frames lies on that grid position.

    The frames of a shot follow its start at the frame rate, as many as fit.
    Rounded to the grid they are consecutive, so a shot is an interval of grid
    positions and no frame is formed.
    """
    step = 1000.0 / fps
    grid = lambda c: F.round(F.col(c) / step)
    count = F.floor((F.col("end_ms") - F.col("start_ms")) / step)
    held = shots.where(count > 0).withColumns({"_a": (grid("start_ms") * step).cast("long"), "_z": ((grid("start_ms") + count) * step).cast("long")})
    snapped = points.withColumn("pos_ms", (grid(at) * step).cast("long"))
    return contains(snapped, held.drop("start_ms", "end_ms"), keys, F.col("pos_ms"), "_a", "_z").drop("_a", "_z")


def asof_child(points: DataFrame, segments: DataFrame, at: str, carry: Sequence[str], tie: Sequence[str] = (), keys: Sequence[str] = EP) -> DataFrame:
    """Last segment starting at or before each point; NULL before the first."""
    return asof(points, segments, keys, at, "start_ms", carry, tie)


def same_label_pairs(items: DataFrame, keys: Sequence[str], label: str, order: Sequence[str], item: str, block: Column) -> DataFrame:
    """Each item with the next one of the same label: item1, item2.

    All pairs of equal label follow from these links, whose number does not
    exceed that of the items.  A label's items are linked block by block.
    """
    near = neighbours(items, [*keys, label], order, block, nxt={"item2": F.col(item)})
    return near.where("item2 is not null").select(*keys, label, F.col(item).alias("item1"), "item2")


def same_camera_pairs(shots: DataFrame, scene_bound: bool = False, camera: str = "cam_manual") -> DataFrame:
    """Links between shots of the same camera, optionally inside one scene; the label -1 never pairs."""
    keys = ["episode", "scene_idx"] if scene_bound else ["episode"]
    return same_label_pairs(shots.where(F.col(camera) != -1), keys, camera, ["shot_idx"], "shot_id", F.floor(F.col("shot_idx") / 4096))


def same_speaker_pairs(segs: DataFrame, keys: Sequence[str] = ("unit",)) -> DataFrame:
    """Links between segments of the same known speaker."""
    return same_label_pairs(segs.where("speaker <> 'S'"), keys, "speaker", ["start_ms", "seg_idx"], "seg_idx", time_block("start_ms"))


def unit_to_scene(unit_segments: DataFrame, scene_of: DataFrame, unit: str = "lsu_id") -> DataFrame:
    """A story unit belongs to the scene holding its first segment."""
    first = unit_segments.groupBy(unit).agg(F.min_by("seg_idx", F.struct("start_ms", "seg_idx")).alias("seg_idx"))
    return first.join(scene_of.select("seg_idx", "scene_idx"), "seg_idx").select(unit, "scene_idx")


def shot_contents(shots: DataFrame, segs: DataFrame, keys: Sequence[str] = EP) -> DataFrame:
    """Segments with the position of the shot that holds most of each: what a story unit holds, without a row per unit."""
    return majority_join(shots.select(*keys, "shot_idx", "start_ms", "end_ms"), segs, keys)


def lsu_contents(lsus: DataFrame, shots: DataFrame, segs: DataFrame, keys: Sequence[str] = EP) -> DataFrame:
    """Segments of each story unit, through the shot that holds most of each segment.

    The units' shots are far more rows than a plan expects of the units, so they are kept from being broadcast.
    """
    keys = list(keys)
    bridge = lsus.select(*keys, "lsu_id", F.explode(F.sequence("first_shot", "last_shot")).alias("shot_idx")).hint("merge")
    return bridge.join(shot_contents(shots, segs, keys), [*keys, "shot_idx"])


def lsu_speech_bounds(lsus: DataFrame, contents: DataFrame) -> DataFrame:
    """First and last segment position per story unit; (-1, -1) without speech."""
    b = contents.groupBy("lsu_id").agg(F.min("idx").alias("first_seg"), F.max("idx").alias("last_seg"))
    return lsus.select("lsu_id").join(b, "lsu_id", "left").na.fill(-1, ["first_seg", "last_seg"])


def scene_segments(shots: DataFrame, segs: DataFrame) -> DataFrame:
    """Known speech grouped by scene, with a dense scene ordinal over the corpus.

    Scenes without speech are dropped, except the last one of an episode.
    ``seg_idx`` is NULL for such a kept empty scene.
    """
    scenes = shots.groupBy("episode", "scene_idx").agg(F.min("start_ms").alias("scene_start"))
    last = scenes.groupBy("episode").agg(F.max("scene_idx").alias("scene_idx"))
    hit = majority_join(shots.select("episode", "scene_idx", "start_ms", "end_ms"), segs.where("speaker not in ('', 'S')"))
    spoken = hit.select("episode", "scene_idx").unionByName(last).distinct()
    kept = running(spoken, [], ["episode", "scene_idx"], None, {"scene_ord": ("sum", F.lit(1).cast("long"))})
    return kept.join(hit, ["episode", "scene_idx"], "left")


def symmetrise(edges: DataFrame) -> DataFrame:
    """Neighbour table with both directions."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(*rest, F.col("dst").alias("src"), F.col("src").alias("dst")))
