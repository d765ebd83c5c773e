"""Queries for the streaming forms, each run over its whole input."""

from pyspark.sql import functions as F

from turnloom.catalog.ctes import FRAMES, LINES, SPEECH, sql
from turnloom.catalog.interactions import GAP, rules_cte
from turnloom.catalog.networks import GRID, SE, scene_edges
from turnloom.catalog.registry import query
from turnloom.catalog.sequences import PRE, block_sql, timed_lines
from turnloom.sources import adapters as A
from turnloom.streaming import operators as X
from turnloom.streaming.run import drain, replay

FAR_MS = 10 * 365 * 86_400_000  # a closing row far behind all others ends every open unit


@query("x01_stream_cuts", sql(FRAMES, then="""
, pr as (select video, frame_idx, hist as a, lag(hist) over (partition by video order by frame_idx) as b from frames),
pq as (select * from pr where b is not null),""" + block_sql("video, frame_idx", "pq", "bd") + """,
w as (select video, frame_idx, d as d2, lag(d) over o as d1, lag(d, 2) over o as d0 from bd window o as (partition by video order by frame_idx))
select video, frame_idx - 1 as cut_frame from w where d0 <= 0.80 and d1 >= 0.80 and d2 <= 0.80"""))
def _(s, d):
    got = drain(X.stream_cuts(replay(A.frames(s, d)), 4, 0.80, 0.80), "update", ["video", "block_ts"])
    return got.select("video", F.explode("cuts").alias("cut_frame"))


@query("x02_stream_speech_rate", sql(LINES, then=f"""
, p as (select unit, seg_idx * 5000 as st, 37 * length(text) as dur, length(replace({PRE}, ' ', '')) as n from lines),
ch as (select unit, st + (unnest(range(n)) * dur) // n as ts from p where n > 0),
near as (select unit, ts, unnest(range(greatest((ts - 750 + 499) // 500, 0), (ts + 750) // 500 + 1)) * 500 as t from ch)
select unit, t, round(count(*) * 1000.0 / 1500, 6) as rate from near where ts >= t - 750 and ts <= t + 750 group by 1, 2"""))
def _(s, d):
    ln = replay(timed_lines(s, d).select("unit", "start_ms", "end_ms", "text"), order="start_ms")
    got = drain(X.stream_speech_rate(ln, delay="1 hour"), "update", ["unit", "block_ts"]).select("unit", F.inline("rates"))
    return got.select("unit", "t", F.round("rate", 6).alias("rate")).where("rate > 0")


@query("x03_stream_interactions", sql(SPEECH, rules_cte("known", GAP), then="""
select cast(unit as bigint) as unit, least(speaker, inter) as src, greatest(speaker, inter) as dst, round(sum(end_ms - start_ms) / 1000.0, 6) as weight
from tn_inter where inter is not null group by 1, 2, 3"""))
def _(s, d):
    k = A.known(s, d).select(F.col("unit").cast("long").alias("unit"), F.col("seg_idx").cast("long").alias("seg_idx"), "speaker", "start_ms", "end_ms")
    end = s.range(1).select(F.lit(-1).cast("long").alias("unit"), F.lit(0).cast("long").alias("seg_idx"), F.lit("end").alias("speaker"), F.lit(FAR_MS).cast("long").alias("start_ms"), F.lit(FAR_MS).cast("long").alias("end_ms"))
    src = replay(k.unionByName(end), order="start_ms").withColumn("ts", F.timestamp_millis(F.col("start_ms") + X.EPOCH_MS))
    got = drain(X.stream_interactions(src, GAP), "append")
    return got.groupBy("unit", F.least("speaker", "other").alias("src"), F.greatest("speaker", "other").alias("dst")).agg(F.round(F.sum("ms") / 1000.0, 6).alias("weight"))


@query("x04_stream_past_snapshots", sql(SPEECH, SE, GRID, then="""
select series, scene, src, dst, round(ip - (b - bp), 5) as weight from g2 where p is not null and bo > 0"""))
def _(s, d):
    e = scene_edges(s, d).select(F.col("series").cast("int").alias("series"), "scene", "src", "dst", "weight")
    end = s.range(1).select(F.lit(-1).alias("series"), F.lit(FAR_MS // 3_600_000).cast("long").alias("scene"), F.lit("a").alias("src"), F.lit("b").alias("dst"), F.lit(0.0).alias("weight"))
    hour = F.col("scene") + F.greatest(F.col("series"), F.lit(0)) * 168
    src = replay(e.unionByName(end).withColumn("o", F.col("scene") + F.greatest(F.col("series"), F.lit(0)) * 168), order="o").drop("o").withColumn("ts", F.timestamp_millis(hour * 3_600_000 + X.EPOCH_MS))
    return drain(X.stream_past_snapshots(src), "append").where("series >= 0").withColumn("weight", F.round("weight", 5))
