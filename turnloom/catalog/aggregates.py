"""Queries for statistics."""

from pyspark.sql import functions as F

from turnloom.catalog.ctes import FACES, MUSIC, SHOTS, SPEECH, sql
from turnloom.catalog.registry import query
from turnloom.operators import aggregates as a
from turnloom.plans.intervals import contains, overlaps
from turnloom.sources import adapters as A

PER = """
per as (select unit, count(*) as n, count(distinct speaker) as k, sum(end_ms - start_ms) as ms from known group by 1)"""


@query("a01_corpus_stats", sql(SPEECH, then="""
, u as (select distinct unit from speech),
per as (select u.unit, count(seg_idx) as n, count(distinct speaker) as k, coalesce(sum(end_ms - start_ms), 0) as ms
  from u left join known using (unit) group by 1)
select count(*) as units, cast(sum(n) as bigint) as segments, cast(sum(k) as bigint) as speaker_occurrences, round(sum(ms) / 1000.0, 6) as speech_s,
  count(*) filter (where n > 0) as spoken_units, round(avg(k), 6) as mean_speakers, round(stddev_pop(k), 6) as dev_speakers from per"""))
def _(s, d):
    sp = A.speech(s, d)
    r = a.corpus_stats(A.known(s, d), sp.select("unit").distinct())
    return r.select("units", "segments", "speaker_occurrences", *[F.round(c, 6).alias(c) for c in ("speech_s", "mean_speakers", "dev_speakers")], "spoken_units")


@query("a02_speaker_ranking", sql(SPEECH, then="""
, t as (select season, speaker, sum(end_ms - start_ms) / 1000.0 as seconds from known group by 1, 2)
select season, speaker, round(seconds, 6) as seconds, cast(rank() over (partition by season order by seconds desc) as int) as rank from t"""))
def _(s, d):
    return a.speaker_ranking(A.speech(s, d), "season").withColumn("seconds", F.round("seconds", 6))


@query("a03_speakers_per_unit_hist", sql(SPEECH, PER, then="""
select k, round(sum(n) / (select sum(n) from per), 6) as share from per group by 1"""))
def _(s, d):
    return a.speakers_per_unit_hist(A.known(s, d)).withColumn("share", F.round("share", 6))


@query("a04_representative_episodes", sql(SPEECH, then="""
, per as (select episode, unit, count(*) as n, count(distinct speaker) as k from known group by 1, 2),
h as (select episode, k, sum(n) as n from per group by 1, 2),
g as (select k, sum(n) / (select sum(n) from h) as goal from h group by 1),
sz as (select episode, sum(n) as t from h group by 1),
grid as (select sz.episode, t, g.k, goal, coalesce(h.n, 0) as n from sz cross join g left join h on h.episode = sz.episode and h.k = g.k),
pr as (select x.episode as e1, y.episode as e2, round(sum(abs((x.n + y.n) / (x.t + y.t) - x.goal)), 9) as d
  from grid x join grid y on x.k = y.k and x.episode < y.episode group by 1, 2),
best as (select * from pr order by d, e1 desc, e2 desc limit 1)
select 1 as step, e1 as episode, round(d, 6) as distance from best union all select 2, e2, round(d, 6) from best"""))
def _(s, d):
    return a.representative_episodes(A.known(s, d), 2).withColumn("distance", F.round("distance", 6))


@query("a05_total_duration", sql(SPEECH, then="""
select round(sum(b - a) / 1000.0, 6) as seconds from (select unit, min(start_ms) as a, max(end_ms) as b from known group by 1)"""))
def _(s, d):
    return a.total_duration(A.known(s, d)).select(F.round("seconds", 6).alias("seconds"))


# Frames of a shot: the speech segments that start in it stand for labelled frames.
@query("a07_label_counts", sql(SPEECH, SHOTS, then="""
select shot_id, speaker as label, count(*) as frames from shots s join known k
on k.episode = s.episode and k.start_ms >= s.start_ms and k.start_ms < s.end_ms group by 1, 2"""))
def _(s, d):
    fr = A.known(s, d).select("episode", F.col("start_ms").alias("at"), F.col("speaker").alias("label"))
    sh = A.shots(s, d).select("episode", "shot_id", "start_ms", "end_ms")
    return a.label_counts(contains(fr, sh, ["episode"], F.col("at"), "start_ms", "end_ms"))


@query("a08_cluster_counts", sql(SHOTS, then="""
select scene_idx, count(distinct cam_manual) as clusters from shots group by 1"""))
def _(s, d):
    return a.cluster_counts(A.shots(s, d), "scene_idx", "cam_manual")


# Story units of fixed length stand in for detected ones here: six shots each.
LSU6 = """
lsu_shots as (select *, episode * 1000000 + (shot_idx - 1) // 6 as lsu_id from shots),
lsu_speech as (select lsu_id, k.* from known k join lsu_shots s
  on k.episode = s.episode and (k.start_ms + k.end_ms) // 2 >= s.start_ms and (k.start_ms + k.end_ms) // 2 < s.end_ms)"""


def lsu_shots(s, d):
    return A.shots(s, d).withColumn("lsu_id", F.col("episode").cast("long") * 1000000 + F.expr("(shot_idx - 1) div 6"))


def lsu_speech(s, d):
    sh = lsu_shots(s, d).select("episode", "lsu_id", F.col("start_ms").alias("s0"), F.col("end_ms").alias("s1"))
    return contains(A.known(s, d), sh, ["episode"], F.expr("(start_ms + end_ms) div 2"), "s0", "s1")


@query("a09_unit_bounds", sql(SPEECH, SHOTS, LSU6, then="""
, a as (select lsu_id, min(start_ms) as a, max(end_ms) as b from lsu_shots group by 1),
t as (select lsu_id, min(start_ms) as sa, arg_max(end_ms, start_ms) as sb from lsu_speech group by 1)
select lsu_id, start_ms, end_ms, round((end_ms - start_ms) / 1000.0, 6) as seconds from (
select lsu_id, least(a, coalesce(sa, a)) as start_ms, case when b >= coalesce(sb, b) then b - 40 else sb end as end_ms from a left join t using (lsu_id))"""))
def _(s, d):
    r = a.unit_bounds(lsu_shots(s, d), lsu_speech(s, d))
    return r.withColumn("seconds", F.round("seconds", 6))


FACE_SHOT = """
fs as (select s.lsu_id, s.shot_idx, s.shot_id, f.frame_ms, f.h from lsu_shots s join faces f
  on f.episode = s.episode and f.frame_ms >= s.start_ms and f.frame_ms < s.end_ms),
tall as (select lsu_id, shot_idx, shot_id, frame_ms, max(h) as h from fs group by 1, 2, 3, 4),
rk as (select *, row_number() over (partition by shot_id order by h) as r, count(*) over (partition by shot_id) as c from tall),
sizes as (select shot_id, h / 260.0 as size from rk where r = c // 2 + 1)"""


def shot_sizes(s, d):
    sh = lsu_shots(s, d).select("episode", "shot_id", "start_ms", "end_ms")
    fs = contains(A.faces(s, d), sh, ["episode"], F.col("frame_ms"), "start_ms", "end_ms")
    return a.shot_size(fs, 260)


@query("a10_shot_size", sql(SPEECH, SHOTS, LSU6, FACES, FACE_SHOT, then="select shot_id, round(size, 6) as size from sizes"))
def _(s, d):
    return shot_sizes(s, d).withColumn("size", F.round("size", 6))


@query("a10_unit_shot_size", sql(SPEECH, SHOTS, LSU6, FACES, FACE_SHOT, then="""
, m as (select lsu_id, shot_idx, coalesce(size, 0.0) as size from lsu_shots left join sizes using (shot_id))
select lsu_id, round(avg(size), 6) as shot_size, round(arg_max(size, shot_idx) - arg_min(size, shot_idx), 6) as size_change from m group by 1"""))
def _(s, d):
    m = lsu_shots(s, d).select("lsu_id", "shot_idx", "shot_id").join(shot_sizes(s, d), "shot_id", "left").na.fill(0.0, ["size"])
    diff = a.unit_shot_size(m, diff=True).select("lsu_id", F.round("shot_size", 6).alias("size_change"))
    return a.unit_shot_size(m).withColumn("shot_size", F.round("shot_size", 6)).join(diff, "lsu_id")


@query("a11_unit_music_rate", sql(SPEECH, SHOTS, LSU6, MUSIC, then="""
, r as (select lsu_id, pos_ms, music_id, rate from lsu_shots s join music m on m.episode = s.episode and pos_ms >= start_ms and pos_ms < end_ms),
g as (select lsu_id, avg(rate) as v, arg_max(rate, pos_ms) - arg_min(rate, pos_ms) as c from r group by 1)
select lsu_id, round(v, 6) as music_rate, round(c, 6) as rate_change from (select distinct lsu_id from lsu_shots) left join g using (lsu_id)"""))
def _(s, d):
    sh = lsu_shots(s, d)
    r = contains(A.music(s, d), sh.select("episode", "lsu_id", "start_ms", "end_ms"), ["episode"], F.col("pos_ms"), "start_ms", "end_ms")
    change = a.unit_music_rate(r, diff=True).select("lsu_id", F.round("music_rate", 6).alias("rate_change"))
    out = a.unit_music_rate(r).withColumn("music_rate", F.round("music_rate", 6)).join(change, "lsu_id")
    return sh.select("lsu_id").distinct().join(out, "lsu_id", "left")


@query("a12_compression_rate", sql(SHOTS, then="""
select round(sum(end_ms - start_ms) / sum(end_ms - start_ms) filter (where source = 'Both'), 6) as rate from shots"""))
def _(s, d):
    sh = A.shots(s, d)
    return a.compression_rate(sh, sh.where("source = 'Both'")).select(F.round("rate", 6).alias("rate"))


@query("a13_avg_duration", sql(SPEECH, SHOTS, LSU6, then="""
select round(avg(b - a) / 1000.0, 6) as seconds from (select lsu_id, min(start_ms) as a, max(end_ms) as b from lsu_shots group by 1)"""))
def _(s, d):
    u = lsu_shots(s, d).groupBy("lsu_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return a.avg_duration(u).select(F.round("seconds", 6).alias("seconds"))
