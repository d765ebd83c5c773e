"""Corpus, speaker and unit statistics.

Distinct speakers are reduced per unit before anything else, so that a unit of
any size costs a partial aggregate and not a sorted group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.plans.ordered import row_index
from turnloom.session import cut

FRAME_MS = 40  # fixed value: one frame at 25 images per second


def _per_unit(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments, seconds and distinct speakers per unit in two partial steps."""
    per = segments.groupBy(*keys, "speaker").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    return per.groupBy(*keys).agg(F.sum("n").alias("segments"), F.sum("ms").alias("ms"), F.count(F.lit(1)).alias("speakers"))


def corpus_stats(segments: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """One row over all units; ``units`` adds the ones without speech."""
    per = _per_unit(segments, ["unit"])
    if units is not None:
        per = units.select("unit").distinct().join(per, "unit", "left").na.fill(0, ["segments", "ms", "speakers"])
    return per.agg(
        F.count(F.lit(1)).alias("units"),
        F.sum("segments").alias("segments"),
        F.sum("speakers").alias("speaker_occurrences"),
        (F.sum("ms") / 1000.0).alias("speech_s"),
        F.sum((F.col("segments") > 0).cast("long")).alias("spoken_units"),
        F.avg("speakers").alias("mean_speakers"),
        F.stddev_pop("speakers").alias("dev_speakers"),
    )


def speaker_ranking(speech: DataFrame, by: str | None = None) -> DataFrame:
    """Speech seconds per named speaker, descending.

    With ``by`` each group also gets ranks, ties sharing one; the overall list
    is only sorted, which Spark does by range and not in one task.
    """
    keys = [by] if by else []
    tot = speech.where("speaker not in ('', 'S')").groupBy(*keys, "speaker").agg((F.sum(F.col("end_ms") - F.col("start_ms")) / 1000.0).alias("seconds"))
    if by:
        tot = tot.withColumn("rank", F.rank().over(Window.partitionBy(by).orderBy(F.desc("seconds"))))
    return tot.orderBy(*keys, F.desc("seconds"), "speaker")


def _hist(segments: DataFrame, keys: list[str]) -> DataFrame:
    return _per_unit(segments, [*keys, "unit"]).groupBy(*keys, "speakers").agg(F.sum("segments").alias("n"))


def speakers_per_unit_hist(segments: DataFrame) -> DataFrame:
    """Share of the segments lying in units with k speakers."""
    h = _hist(segments, [])
    return h.crossJoin(h.agg(F.sum("n").alias("total"))).select(F.col("speakers").alias("k"), (F.col("n") / F.col("total")).alias("share"))


def _one_by_one(per: DataFrame, grid: DataFrame, size: DataFrame, k: int) -> float:
    """Distance of a set found by adding the best episode each time: an upper bound."""
    picked = None
    for step in range(1, k + 1):
        if picked is None:
            base, rest = grid.select("*", F.lit(0).alias("b_n"), F.lit(0).alias("b_size")), None
        else:
            chosen = picked.select("episode")
            b = per.join(chosen, "episode", "left_semi").groupBy("speakers").agg(F.sum("n").alias("b_n"))
            bs = size.join(chosen, "episode", "left_semi").agg(F.sum("ep_n").alias("b_size"))
            rest = grid.join(chosen, "episode", "left_anti")
            base = rest.join(b, "speakers", "left").na.fill(0, ["b_n"]).crossJoin(bs)
        gap = F.abs((F.col("n") + F.col("b_n")) / (F.col("ep_n") + F.col("b_size")) - F.col("goal"))
        d = base.groupBy("episode").agg(F.round(F.sum(gap), 9).alias("d"))
        best = d.agg(F.min_by(F.struct("episode", "d"), F.struct("d", -F.col("episode"))).alias("b")).select(
            F.lit(step).alias("step"), F.col("b.episode").alias("episode"), F.col("b.d").alias("distance")
        )
        picked = best if picked is None else picked.unionByName(best)
    return picked.agg(F.max_by("distance", "step")).first()[0]


EPISODE_TILE = 64


def representative_episodes(segments: DataFrame, k: int = 2) -> DataFrame:
    """The ``k`` episodes whose pooled histogram is nearest (L1) to that of the corpus.

    Branch and bound over sets: the distance of a set built greedily is the bound;
    a partial set is dropped where even the best episodes to come could not
    reach it.  They can move the pooled share of a bin only between the smallest
    and largest share any episode has there, and not outweigh their number times
    the largest episode.  Sets grow by joins on tiles of episodes.  Equal
    distances: the later episodes.  Fewer episodes than ``k``: all of them.

    Rows: step (place in the set), episode, distance (of the set).
    """
    per = _hist(segments, ["episode"]).select("episode", "speakers", "n")
    total = per.groupBy("speakers").agg(F.sum("n").alias("all_n"))
    total = total.crossJoin(total.agg(F.sum("all_n").alias("t"))).select("speakers", (F.col("all_n") / F.col("t")).alias("goal"))
    size = per.groupBy("episode").agg(F.sum("n").alias("ep_n"))
    # The corpus histogram is one row: a list with one entry per number of speakers.
    goal = total.agg(F.collect_list(F.struct("speakers", "goal")).alias("g"))
    bins = size.crossJoin(goal).select("episode", "ep_n", F.explode("g").alias("g")).select("episode", "ep_n", "g.speakers", "g.goal")
    grid = cut(bins.join(per, ["episode", "speakers"], "left").na.fill(0, ["n"]))
    count = size.count()
    k = min(k, count)
    if k == 0:
        return grid.select(F.lit(0).alias("step"), "episode", F.lit(0.0).alias("distance")).limit(0)
    bound = _one_by_one(per, grid, size, k)
    rows = F.sort_array(F.collect_list(F.struct("speakers", "n")))
    eps = grid.groupBy("episode", "ep_n").agg(rows.alias("c")).select("episode", F.col("ep_n").alias("t"), F.col("c.n").alias("c"))
    eps = cut(row_index(eps, [], ["episode"], None, "idx").withColumn("_tile", F.floor(F.col("idx") / EPISODE_TILE)))
    ends = grid.groupBy("speakers").agg(F.min(F.col("n") / F.col("ep_n")).alias("lo"), F.max(F.col("n") / F.col("ep_n")).alias("hi"), F.max("goal").alias("goal"))
    ends = F.broadcast(ends.agg(F.sort_array(F.collect_list(F.struct("speakers", "lo", "hi", "goal"))).alias("b")).crossJoin(
        size.agg(F.min("ep_n").alias("t_min"), F.max("ep_n").alias("t_max"))))  # one row
    last_tile = count // EPISODE_TILE

    def distance(left: int) -> Column:
        """Least distance of a set that still gets ``left`` episodes; exact for 0."""
        share = lambda c, w, end: w * c / F.col("t") + (1 - w) * end
        light, heavy = F.col("t") / (F.col("t") + left * F.col("t_max")), F.col("t") / (F.col("t") + left * F.col("t_min"))
        if left == 0:
            gap = lambda c, b: F.abs(c / F.col("t") - b["goal"])
        else:
            gap = lambda c, b: F.greatest(
                F.lit(0.0), F.least(share(c, light, b["lo"]), share(c, heavy, b["lo"])) - b["goal"],
                b["goal"] - F.greatest(share(c, light, b["hi"]), share(c, heavy, b["hi"])))
        return F.round(F.aggregate(F.zip_with("c", "b", gap), F.lit(0.0), lambda x, y: x + y), 9)

    sets = eps.select(F.array("episode").alias("members"), F.col("idx").alias("last"), "t", "c")
    for step in range(1, k + 1):
        if step > 1:
            more = eps.select("_tile", "idx", "episode", F.col("t").alias("t2"), F.col("c").alias("c2"))
            first = F.floor(F.col("last") / EPISODE_TILE)
            grown = sets.withColumn("_tile", F.explode(F.sequence(first, F.lit(last_tile).cast("long")))).join(more, "_tile").where("idx > last")
            sets = grown.select(F.concat("members", F.array("episode")).alias("members"), F.col("idx").alias("last"), (F.col("t") + F.col("t2")).alias("t"),
                                F.zip_with("c", "c2", lambda x, y: x + y).alias("c"))
        kept = sets.crossJoin(ends).withColumn("d", distance(k - step))
        sets = cut(kept.where(F.col("d") <= bound + 1e-9).select("members", "last", "t", "c", "d"))
    best = sets.agg(F.max_by(F.struct("members", "d"), F.struct(-F.col("d"), "members")).alias("b"))
    return best.select(F.posexplode("b.members").alias("step", "episode"), F.col("b.d").alias("distance")).withColumn("step", F.col("step") + 1)


def total_duration(segments: DataFrame, speaker: str | None = None) -> DataFrame:
    """Sum over units of last end minus first start, in seconds."""
    s = segments if speaker is None else segments.where(F.col("speaker") == speaker)
    per = s.groupBy("unit").agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("b"))
    return per.agg((F.sum(F.col("b") - F.col("a")) / 1000.0).alias("seconds"))


def label_counts(frames: DataFrame) -> DataFrame:
    """Frames per speaker label in each shot."""
    return frames.groupBy("shot_id", "label").agg(F.count(F.lit(1)).alias("frames"))


def cluster_counts(items: DataFrame, unit: str, label: str) -> DataFrame:
    """Distinct labels (cameras or speakers) per unit."""
    return items.select(unit, label).distinct().groupBy(unit).agg(F.count(F.lit(1)).alias("clusters"))


def unit_bounds(shot_spans: DataFrame, speech_spans: DataFrame, unit: str = "lsu_id") -> DataFrame:
    """Start and end of a unit from its shots and speech.

    The end loses one frame when the shot ends last.  Input spans carry
    ``start_ms`` and ``end_ms`` per unit member.
    """
    a = shot_spans.groupBy(unit).agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("b"))
    s = speech_spans.groupBy(unit).agg(F.min("start_ms").alias("sa"), F.max_by("end_ms", "start_ms").alias("sb"))
    j = a.join(s.hint("merge"), unit, "left")  # both lie by unit: no copy of it in the driver
    start = F.least("a", F.coalesce("sa", "a"))
    end = F.when(F.col("b") >= F.coalesce("sb", "b"), F.col("b") - FRAME_MS).otherwise(F.col("sb"))
    return j.select(unit, start.alias("start_ms"), end.alias("end_ms"), ((end - start) / 1000.0).alias("seconds"))


def shot_size(faces: DataFrame, video_height: float, keys: tuple[str, ...] = ("shot_id",)) -> DataFrame:
    """Upper median over frames of the tallest face, as a share of the video height.

    Heights are counted per shot first: the ordered pass runs over distinct
    heights, never more than the video has rows, not over frames.
    """
    keys = list(keys)
    tall = faces.groupBy(*keys, "frame_ms").agg(F.max("h").alias("h"))
    counts = tall.groupBy(*keys, "h").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy(*keys).orderBy("h")
    whole = Window.partitionBy(*keys)
    c = counts.select(*keys, "h", F.sum("n").over(up).alias("upto"), F.sum("n").over(whole).alias("all_n"))
    return c.where(F.col("upto") > F.floor(F.col("all_n") / 2)).groupBy(*keys).agg((F.min("h") / F.lit(float(video_height))).alias("size"))


def _mean_or_change(df: DataFrame, unit: str, value: str, order: list[str], diff: bool, name: str, rows: str | None = None) -> DataFrame:
    """Mean of a value, or the sum of its successive differences (last minus first).

    ``rows``: column with how many rows a row stands for; its value is their sum then.
    """
    if rows is not None and not diff:
        return df.groupBy(unit).agg(F.sum(value).alias("_sum"), F.sum(rows).alias("_n")).select(unit, F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n")).alias(name))
    if not diff:
        return df.groupBy(unit).agg(F.avg(value).alias(name))
    at = F.struct(*order)
    return df.groupBy(unit).agg((F.max_by(value, at) - F.min_by(value, at)).alias(name))


def unit_shot_size(members: DataFrame, unit: str = "lsu_id", diff: bool = False, rows: str | None = None) -> DataFrame:
    """``members``: unit, shot_idx, size (0 for shots without faces); with ``rows`` (their number) a size is the sum of several."""
    return _mean_or_change(members, unit, "size", ["shot_idx"], diff, "shot_size", rows)


def unit_music_rate(rates: DataFrame, unit: str = "lsu_id", diff: bool = False, rows: str | None = None) -> DataFrame:
    """``rates``: unit, pos_ms, music_id, rate; units without music give NULL through an outer join.  ``rows`` as for ``unit_shot_size``."""
    return _mean_or_change(rates, unit, "rate", ["pos_ms", "music_id"], diff, "music_rate", rows)


def compression_rate(full: DataFrame, summary: DataFrame) -> DataFrame:
    """Full duration over summary duration; both tables carry start_ms and end_ms."""
    a = full.agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("a"))
    b = summary.agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("b"))
    return a.crossJoin(b).select((F.col("a") / F.col("b")).alias("rate"))


def avg_duration(units: DataFrame) -> DataFrame:
    return units.agg((F.avg(F.col("end_ms") - F.col("start_ms")) / 1000.0).alias("seconds"))
