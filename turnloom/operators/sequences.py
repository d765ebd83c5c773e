"""Operators on ordered segments, shots and frames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.text import preprocess
from turnloom.functions.vectors import block_distance
from turnloom.plans.ordered import band, blocked, islands, neighbours, running, time_block, with_halo
from turnloom.plans.rounds import find_roots
from turnloom.session import cut

STEP_MS = 500  # fixed value: interval between two measurements of the speech rate
WINDOW_MS = 1500  # fixed value: length of the window around a measurement


def merge_close(segs: DataFrame, keys: Sequence[str] = ("episode",), gap: int = 3000) -> DataFrame:
    """Merge neighbours of the same speaker at most ``gap`` ms apart."""
    keys, order = list(keys), ["start_ms", "seg_idx"]
    new = (F.col("_ps") != F.col("speaker")) | (F.col("start_ms") - F.col("_pe") > gap)
    i = islands(segs, keys, order, time_block("start_ms"), {"_ps": F.col("speaker"), "_pe": F.col("end_ms")}, new)
    return i.groupBy(*keys, "island").agg(
        F.first("speaker").alias("speaker"), F.min("start_ms").alias("start_ms"),
        F.max_by("end_ms", F.struct(*order)).alias("end_ms"), F.count(F.lit(1)).alias("segments"),
    ).drop("island")


def character_ends(segs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Start, length, number of characters and time of the last character of each segment."""
    n = F.length(F.regexp_replace(preprocess("text"), " ", "")).cast("long")
    # unfolded from an array of one, the count is a column: as an expression the filter would normalise each text once more
    s = segs.select(*keys, "start_ms", (F.col("end_ms") - F.col("start_ms")).alias("dur"), F.explode(F.array(n)).alias("n")).where("n > 0 and dur >= 0")
    return s.withColumn("_last", F.expr("start_ms + (n - 1) * dur div n"))


def character_shares(segs: DataFrame, keys: Sequence[str], step: int = STEP_MS, width: int = WINDOW_MS) -> DataFrame:
    """Each segment's share of characters ``c`` at the few grid times ``t`` around it.

    Characters are spread evenly over their segment; how many fall in a window
    follows from integer division, so no row per character is made.
    """
    return _shares(character_ends(segs, keys), keys, step, width)


def _shares(s: DataFrame, keys: Sequence[str], step: int, width: int) -> DataFrame:
    half = width // 2
    lo = F.greatest(F.ceil((F.col("start_ms") - half) / F.lit(step)), F.lit(0))
    hi = F.floor((F.col("_last") + half) / F.lit(step))
    g = s.withColumn("grid", F.explode(F.sequence(lo, F.greatest(hi, lo)))).withColumn("t", F.col("grid") * step)
    g = g.withColumns({"a": F.greatest(F.col("t") - half, F.lit(0)) - F.col("start_ms"), "b": F.col("t") + half - F.col("start_ms")})
    # character i sits at i * dur div n: i >= ceil(a * n / dur), i < ceil((b + 1) * n / dur)
    first = F.when(F.col("a") <= 0, 0).otherwise(F.expr("(a * n + dur - 1) div nullif(dur, 0)"))
    stop = F.when(F.col("dur") == 0, F.when((F.col("a") <= 0) & (F.col("b") >= 0), F.col("n")).otherwise(0)).otherwise(
        F.expr("((b + 1) * n + dur - 1) div nullif(dur, 0)")
    )
    cnt = F.greatest(F.least(stop, F.col("n")) - F.when(F.col("dur") == 0, 0).otherwise(first), F.lit(0))
    return g.select(*keys, "t", cnt.alias("c"))


def speech_rate(segs: DataFrame, keys: Sequence[str] = ("episode",), step: int = STEP_MS, width: int = WINDOW_MS) -> DataFrame:
    """Characters per second around each grid time, divided by the group's maximum.

    The grid runs from 0 until the window has left the last character.
    """
    keys = list(keys)
    ends = cut(character_ends(segs, keys))  # a few numbers per segment: texts are read and normalised once
    near = _shares(ends, keys, step, width).select(*keys, "t", "c")
    end = ends.groupBy(*keys).agg(F.max("_last").alias("_last"))
    stop = F.floor((F.col("_last") + width // 2) / F.lit(step)) + 1
    grid = end.withColumn("_g", F.explode(F.sequence(F.lit(0).cast("long"), stop))).select(*keys, (F.col("_g") * step).alias("t"), F.lit(0).cast("long").alias("c"))
    rate = near.unionByName(grid).groupBy(*keys, "t").agg((F.sum("c") * 1000.0 / width).alias("rate"))
    top = rate.groupBy(*keys).agg(F.max("rate").alias("_max"))
    return rate.join(top, keys).select(*keys, "t", "rate", (F.col("rate") / F.col("_max")).alias("share"))


def frame_distances(frames: DataFrame, n_blocks: int, metric: str = "correl", size: int = 4096) -> DataFrame:
    """Distance of each frame from the one before it (``frame_idx`` dense per video), in one ordered pass."""
    w = Window.partitionBy("video", "_hb").orderBy("frame_idx")
    h = with_halo(frames, "frame_idx", back=3, ahead=0, size=size)
    d = h.withColumn("_prev", F.lag("hist").over(w)).withColumn("d2", block_distance(F.col("hist"), F.col("_prev"), n_blocks, metric))
    d = d.withColumn("d2", F.when(F.col("_prev").isNotNull(), F.col("d2"))).drop("_prev", "hist")
    return d.withColumns({"d1": F.lag("d2", 1).over(w), "d0": F.lag("d2", 2).over(w)}).where("_own").drop("_own", "_hb")


def detect_cuts(frames: DataFrame, n_blocks: int, high: float = 0.30, low: float = 0.20, metric: str = "correl") -> DataFrame:
    """Shots of each video: a cut opens where one large distance stands between two small ones."""
    d = frame_distances(frames, n_blocks, metric)
    hit = d.where((F.col("d0") <= low) & (F.col("d1") >= high) & (F.col("d2") <= low)).select("video", (F.col("frame_idx") - 1).alias("start_frame"))
    span = frames.groupBy("video").agg(F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("_end"))
    starts = span.select("video", "start_frame").unionByName(hit)
    n = neighbours(starts, ["video"], ["start_frame"], F.floor(F.col("start_frame") / F.lit(4096)), nxt={"_next": F.col("start_frame")})
    return n.join(span.select("video", "_end"), "video").select("video", "start_frame", F.coalesce("_next", F.col("_end") + 1).alias("end_frame"))


def label_recurring(shots: DataFrame, max_dist: float, width: int, n_blocks: int, metric: str = "correl") -> DataFrame:
    """Camera label of each shot: the one of the nearest of the ``width`` shots before it, else a new one.

    ``shots``: video, shot_idx (dense), first_hist, last_hist.  A label is the
    index of the shot that opened it; links are followed by pointer doubling.
    """
    p = band(shots, ["video"], "shot_idx", width, ["last_hist", "first_hist"])
    d = block_distance(F.col("first_hist2"), F.col("last_hist1"), n_blocks, metric)
    near = p.select("video", "shot_idx1", "shot_idx2", d.alias("d")).where(F.col("d") <= max_dist)
    best = near.groupBy("video", F.col("shot_idx2").alias("shot_idx")).agg(F.min_by("shot_idx1", F.struct("d", -F.col("shot_idx1"))).alias("like"))
    links = shots.select("video", "shot_idx").join(best, ["video", "shot_idx"], "left").withColumn("like", F.coalesce("like", "shot_idx"))
    return find_roots(links, ["video"], "shot_idx", "like").withColumnRenamed("root", "camera")


def _next_same_camera(shots: DataFrame, camera: str) -> DataFrame:
    """Position of the next shot of the same camera; -1 never recurs."""
    seen = shots.where(F.col(camera) != -1)
    n = neighbours(seen, ["episode", camera], ["shot_idx"], time_block("start_ms"), nxt={"nxt": F.col("shot_idx")})
    rest = shots.where(F.col(camera) == -1).withColumn("nxt", F.lit(None).cast(shots.schema["shot_idx"].dataType))
    return n.unionByName(rest)


def extract_lsus(shots: DataFrame, camera: str = "cam_manual") -> DataFrame:
    """Story units over a whole episode: maximal runs of shots spanned by a recurring camera, widened by one shot each side."""
    # A camera spans what lies between its first and its last shot; -1 never recurs.
    span = shots.where(F.col(camera) != -1).groupBy("episode", camera).agg(F.min("shot_idx").alias("a"), F.max("shot_idx").alias("b")).where("b - a >= 2")
    events = span.select("episode", F.explode(F.array(
        F.struct((F.col("a") + 1).alias("shot_idx"), F.lit(1).alias("e")), F.struct(F.col("b").alias("shot_idx"), F.lit(-1).alias("e"))
    )).alias("v")).groupBy("episode", F.col("v.shot_idx").alias("shot_idx")).agg(F.sum("v.e").cast("long").alias("e"))
    s = shots.join(events, ["episode", "shot_idx"], "left").na.fill(0, ["e"])
    s = running(s, ["episode"], ["shot_idx"], time_block("start_ms"), {"cover": ("sum", F.col("e"))})
    inside = s.where("cover > 0").select("episode", "shot_idx", "start_ms")
    runs = islands(inside, ["episode"], ["shot_idx"], time_block("start_ms"), {"_p": F.col("shot_idx")}, F.col("shot_idx") - F.col("_p") > 1)
    lsu = runs.groupBy("episode", "island").agg((F.min("shot_idx") - 1).alias("first_shot"), (F.max("shot_idx") + 1).alias("last_shot"))
    return _with_times(lsu.drop("island"), shots)


def _with_times(lsu: DataFrame, shots: DataFrame) -> DataFrame:
    a = shots.select("episode", F.col("shot_idx").alias("first_shot"), "start_ms")
    b = shots.select("episode", F.col("shot_idx").alias("last_shot"), "end_ms")
    return lsu.join(a, ["episode", "first_shot"]).join(b, ["episode", "last_shot"])


def _longest_units(nxt: np.ndarray, first: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the runs of spanned shots among the positions ``first`` to ``top``; ``nxt`` is the next shot of the same camera."""
    lim = nxt[first : top + 1]
    lim = np.where(lim <= top, lim, -1)
    here = np.arange(first + 1, top + 1)
    reach = np.maximum.accumulate(lim)[:-1]
    # a shot is open (not spanned) unless an earlier one recurs after it, or as it and again later
    free = np.concatenate(([first], here[(reach < here) | ((reach == here) & (lim[1:] == -1))]))
    long = np.diff(free) >= 2
    return free[:-1][long], free[1:][long]


UNITS = 1 << 18  # story units handed on at once


def _sweep(min_ms: int, max_ms: int, nested: bool):
    """Story units of one block of an episode and the shots that its windows reach into.

    First shots are taken from the last to the first.  ``need[k]`` is the first shot
    that has to be reached for shot k to be spanned from inside; a new first
    shot only adds its own link to the next recurrence, so ``need`` is kept and
    lowered along that link, and memory stays linear in the shots.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(batches).sort_values("shot_idx")
        start, end = pdf["start_ms"].to_numpy(np.int64), pdf["end_ms"].to_numpy(np.int64)
        episode, base, own, never = pdf["episode"].iloc[0], int(pdf["shot_idx"].iloc[0]), pdf["_own"].to_numpy(), np.int64(1 << 62)
        nxt = pdf["nxt"].to_numpy(np.int64)
        nxt = np.where(nxt < 0, never, nxt - base)
        top = np.searchsorted(end, start + max_ms, "right") - 1
        need = np.full(len(pdf), never)
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def units() -> pd.DataFrame:
            a, b = (np.concatenate([np.zeros(0, np.int64), *[x[k] for x in found]]) for k in (0, 1))
            out = pd.DataFrame({"first_shot": a + base, "last_shot": b + base, "start_ms": start[a], "end_ms": end[b]})
            out.insert(0, "episode", episode)
            return out if nested else out.drop_duplicates()

        size = 0
        for f in range(len(pdf) - 1, -1, -1):
            last = int(top[f])
            if nested:
                if (p := int(nxt[f])) < len(pdf):
                    np.minimum(need[f + 1 : p], p, out=need[f + 1 : p])
                    need[p] = min(need[p], nxt[p])
                if own[f] and last >= f + 2:
                    ends = np.arange(f + 2, last + 1)
                    ends = ends[np.maximum.accumulate(need[f + 1 : last]) <= ends]
                    new = np.full(len(ends), f), ends
                else:
                    continue
            elif own[f] and last >= f + 1:
                new = _longest_units(nxt, f, last)
            else:
                continue
            long = end[new[1]] - start[new[0]] >= min_ms
            found.append((new[0][long], new[1][long]))
            size += int(long.sum())
            if size >= UNITS:
                yield units()
                found.clear()
                size = 0
        yield units()

    return run


def extract_bounded_lsus(shots: DataFrame, min_ms: int, max_ms: int, nested: bool = False, camera: str = "cam_manual") -> DataFrame:
    """Story units no longer than ``max_ms`` and no shorter than ``min_ms``.

    For every first shot, the longest window that fits is searched.  With
    ``nested`` every unit inside a unit is returned as well, which is the set
    of shot ranges whose inner shots are all spanned by links inside the range;
    it needs no recursion.  Shots are numbered densely and follow each other.  A
    task sweeps the shots of a time block of ``max_ms`` and of the one after it,
    and hands units on as it finds them: their number may be square in the
    shots of a window, what a task holds is linear.  Nested units are found
    once each, with their first shot; others may follow from several windows.
    """
    nxt = F.coalesce("nxt", F.lit(-1)).cast("long").alias("nxt")
    linked = _next_same_camera(shots, camera).select("episode", F.col("shot_idx").cast("long").alias("shot_idx"), "start_ms", "end_ms", nxt)
    blk = F.floor(F.col("start_ms") / F.lit(max_ms))
    h = linked.withColumn("_hb", F.explode(F.array(blk - 1, blk))).withColumn("_own", F.col("_hb") == blk)
    kind = {f.name: f.dataType.simpleString() for f in shots.schema}
    schema = f"episode {kind['episode']}, first_shot long, last_shot long, start_ms long, end_ms long"
    out = h.groupBy("episode", "_hb").applyInPandas(_sweep(min_ms, max_ms, nested), schema)
    out = out if nested else out.distinct()
    return out.select("episode", *[F.col(c).cast(kind["shot_idx"]).alias(c) for c in ("first_shot", "last_shot")], "start_ms", "end_ms")


def merge_summary(segs: DataFrame, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """Merge selected segments that touch or overlap within an episode."""
    keys, order = list(keys), ["start_ms", "end_ms"]
    r = running(blocked(segs, keys, time_block("start_ms")), keys, order, "_b", {"_before": ("max", F.col("end_ms"))}, inclusive=False)
    r = r.withColumn("_new", F.when(F.col("_before").isNull() | (F.col("start_ms") > F.col("_before")), 1).otherwise(0).cast("long"))
    i = running(r, keys, order, "_b", {"island": ("sum", F.col("_new"))})
    return i.groupBy(*keys, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")


def fill_scene_refs(scenes: DataFrame, refs: Sequence[str] = ("season", "episode")) -> DataFrame:
    """A scene without speech takes the references of the scene before it (NULL = none)."""
    packed = F.when(F.col(refs[0]).isNotNull(), F.struct(*refs))
    keep = [c for c in scenes.columns if c not in refs]
    r = running(scenes, [], ["scene"], None, {"_ref": ("last", packed)})
    return r.select(*keep, *[F.col("_ref")[c].alias(c) for c in refs])


def occurrences(edges: DataFrame) -> DataFrame:
    """Scenes with summed weight per speaker (``b`` NULL) and per pair."""
    ends = edges.select("scene", F.explode(F.array("src", "dst")).alias("a"), F.lit(None).cast("string").alias("b"), "weight")
    pair = edges.select("scene", F.col("src").alias("a"), F.col("dst").alias("b"), "weight")
    return ends.unionByName(pair).groupBy("a", "b", "scene").agg(F.sum("weight").alias("weight"))
