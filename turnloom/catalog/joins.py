"""Queries for joins, edits and evaluation metrics."""

from pyspark.sql import functions as F

from turnloom.catalog.aggregates import LSU6, lsu_shots, lsu_speech
from turnloom.catalog.ctes import SHOTS, SPEECH, sql
from turnloom.catalog.filters import EDGES, episode_edges
from turnloom.catalog.registry import query
from turnloom.operators import edits as E
from turnloom.operators import joins as J
from turnloom.operators import metrics as Q
from turnloom.plans.ordered import row_index, time_block
from turnloom.sources import adapters as A


def _sh(s, d):
    return A.shots(s, d).select("episode", "shot_idx", "start_ms", "end_ms")


@query("j01_majority_join", sql(SPEECH, SHOTS, then="""
select k.episode, shot_idx, seg_idx from known k join shots s on k.episode = s.episode
 and (k.start_ms + k.end_ms) // 2 >= s.start_ms and (k.start_ms + k.end_ms) // 2 < s.end_ms"""))
def _(s, d):
    return J.majority_join(_sh(s, d), A.known(s, d)).select("episode", "shot_idx", "seg_idx")


OV = "from known k join shots s on k.episode = s.episode and k.end_ms > s.start_ms and k.start_ms < s.end_ms"


@query("j02_overlap_join", sql(SPEECH, SHOTS, then="select k.episode, shot_idx, seg_idx " + OV))
def _(s, d):
    return J.overlap_join(_sh(s, d), A.known(s, d)).select("episode", "shot_idx", "seg_idx")


@query("j03_overlap_duration", sql(SPEECH, SHOTS, then="""
select shot_idx, seg_idx, k.episode, round((least(k.end_ms, s.end_ms) - greatest(k.start_ms, s.start_ms)) / 1000.0, 6) as shared_s """ + OV))
def _(s, d):
    return J.overlap_duration(_sh(s, d), A.known(s, d)).select("episode", "shot_idx", "seg_idx", F.round("shared_s", 6).alias("shared_s"))


@query("j04_locate", sql(SPEECH, SHOTS, then="""
select k.seg_idx, s.shot_idx, k.episode from speech k join shots s on k.episode = s.episode and k.end_ms >= s.start_ms and k.end_ms < s.end_ms"""))
def _(s, d):
    p = A.speech(s, d).select("episode", "seg_idx", F.col("end_ms").alias("at"))
    return J.locate(p, _sh(s, d), "at").select("episode", "seg_idx", "shot_idx")


@query("j04_locate_closed", sql(SPEECH, SHOTS, then="""
select k.seg_idx, s.shot_idx, k.episode from speech k join shots s on k.episode = s.episode and s.end_ms >= k.start_ms and s.end_ms <= k.end_ms"""))
def _(s, d):
    p = _sh(s, d).select("episode", "shot_idx", F.col("end_ms").alias("at"))
    return J.locate(p, A.speech(s, d).select("episode", "seg_idx", "start_ms", "end_ms"), "at", closed=True).select("episode", "seg_idx", "shot_idx")


@query("j05_locate_exact", sql(SPEECH, SHOTS, then="""
, p as (select episode, seg_idx, start_ms as at, cast(round(start_ms / 40.0) * 40 as bigint) as pos_ms from speech),
n as (select p.*, shot_idx, s.start_ms, cast(floor((end_ms - s.start_ms) / 40.0) as bigint) as n,
  unnest(range(-2, 3)) + cast(floor((pos_ms - s.start_ms) / 40.0) as bigint) as k
  from p join shots s on p.episode = s.episode and pos_ms >= s.start_ms - 40 and pos_ms <= end_ms + 40)
select distinct episode, seg_idx, shot_idx, pos_ms from n where k >= 0 and k < n and cast(round((start_ms + 40 * k) / 40.0) * 40 as bigint) = pos_ms"""))
def _(s, d):
    p = A.speech(s, d).select("episode", "seg_idx", F.col("start_ms").alias("at"))
    return J.locate_exact(p, _sh(s, d), "at").select("episode", "seg_idx", "shot_idx", "pos_ms")


@query("j06_asof_child", sql(SPEECH, SHOTS, then="""
, m as (select episode, start_ms as t, 0 as kind, shot_idx, null as seg_idx from shots union all select episode, start_ms, 1, null, seg_idx from known),
f as (select *, last_value(shot_idx ignore nulls) over (partition by episode order by t, kind rows unbounded preceding) as hit from m)
select episode, seg_idx, hit as shot_idx from f where kind = 1"""))
def _(s, d):
    p = A.known(s, d).select("episode", "seg_idx", F.col("start_ms").alias("at"))
    return J.asof_child(p, _sh(s, d), "at", ["shot_idx"]).select("episode", "seg_idx", "shot_idx")


@query("j07_same_camera_pairs", sql(SHOTS, then="""
select * from (select episode, cam_manual, shot_id as item1, lead(shot_id) over (partition by episode, cam_manual order by shot_idx) as item2 from shots) where item2 is not null"""))
def _(s, d):
    return J.same_camera_pairs(A.shots(s, d))


@query("j07_same_camera_pairs_scene", sql(SHOTS, then="""
select * from (select episode, scene_idx, cam_manual, shot_id as item1, lead(shot_id) over (partition by episode, scene_idx, cam_manual order by shot_idx) as item2 from shots) where item2 is not null"""))
def _(s, d):
    return J.same_camera_pairs(A.shots(s, d), scene_bound=True)


@query("j08_same_speaker_pairs", sql(SPEECH, then="""
select * from (select unit, speaker, seg_idx as item1, lead(seg_idx) over (partition by unit, speaker order by start_ms, seg_idx) as item2 from known) where item2 is not null"""))
def _(s, d):
    return J.same_speaker_pairs(A.known(s, d))


@query("j09_unit_to_scene", sql(SPEECH, SHOTS, LSU6, then="""
, sc as (select k.seg_idx, s.scene_idx from known k join shots s on k.episode = s.episode and k.start_ms >= s.start_ms and k.start_ms < s.end_ms)
select lsu_id, scene_idx from (select lsu_id, arg_min(seg_idx, start_ms) as seg_idx from lsu_speech group by 1) join sc using (seg_idx)"""))
def _(s, d):
    sc = J.locate(A.known(s, d).select("episode", "seg_idx", F.col("start_ms").alias("at")), A.shots(s, d).select("episode", "scene_idx", "start_ms", "end_ms"), "at")
    return J.unit_to_scene(lsu_speech(s, d), sc)


# Story units as shot ranges: six shots each, overlapping the next by one.
LSU7 = """
lsus as (select episode, lsu_id, min(shot_idx) as first_shot, max(shot_idx) + 1 as last_shot from lsu_shots group by 1, 2)"""


def _lsus(s, d):
    return lsu_shots(s, d).groupBy("episode", "lsu_id").agg(F.min("shot_idx").alias("first_shot"), (F.max("shot_idx") + 1).alias("last_shot"))


CONT = """
ks as (select k.*, row_number() over (partition by k.episode order by k.start_ms, seg_idx) as idx from known k),
cont as (select l.lsu_id, k.* from lsus l join shots s on s.episode = l.episode and s.shot_idx between first_shot and last_shot
  join ks k on k.episode = s.episode and (k.start_ms + k.end_ms) // 2 >= s.start_ms and (k.start_ms + k.end_ms) // 2 < s.end_ms)"""


def _contents(s, d):
    k = row_index(A.known(s, d), ["episode"], ["start_ms", "seg_idx"], time_block("start_ms"))
    return J.lsu_contents(_lsus(s, d), A.shots(s, d), k)


@query("j10_lsu_contents", sql(SPEECH, SHOTS, LSU6, LSU7, CONT, then="select lsu_id, seg_idx from cont"))
def _(s, d):
    return _contents(s, d).select("lsu_id", "seg_idx")


@query("j11_lsu_speech_bounds", sql(SPEECH, SHOTS, LSU6, LSU7, CONT, then="""
select lsus.lsu_id, coalesce(min(idx), -1) as first_seg, coalesce(max(idx), -1) as last_seg from lsus left join cont on cont.lsu_id = lsus.lsu_id group by 1"""))
def _(s, d):
    return J.lsu_speech_bounds(_lsus(s, d), _contents(s, d))


@query("j12_scene_segments", sql(SPEECH, SHOTS, then="""
, hit as (select k.episode, s.scene_idx, k.seg_idx from known k join shots s on k.episode = s.episode
  and (k.start_ms + k.end_ms) // 2 >= s.start_ms and (k.start_ms + k.end_ms) // 2 < s.end_ms),
sp as (select episode, scene_idx from hit union select episode, max(scene_idx) from shots group by 1),
ord as (select *, row_number() over (order by episode, scene_idx) as scene_ord from sp)
select scene_ord, o.episode, o.scene_idx, seg_idx from ord o left join hit h on h.episode = o.episode and h.scene_idx = o.scene_idx"""))
def _(s, d):
    return J.scene_segments(A.shots(s, d), A.speech(s, d)).select("scene_ord", "episode", "scene_idx", "seg_idx")


@query("j13_symmetrise", sql(SPEECH, EDGES, then="""
select scene, src, dst, round(weight, 6) as weight from edges union all select scene, dst, src, round(weight, 6) from edges"""))
def _(s, d):
    return J.symmetrise(episode_edges(s, d)).withColumn("weight", F.round("weight", 6))


@query("e01_merge_detected", sql(SHOTS, then="select distinct episode, start_ms, source from shots"))
def _(s, d):
    sh = A.shots(s, d)
    return E.merge_detected(sh.where("source <> 'Automatic'"), sh.where("source <> 'Manual'"))


SCENES = """
scenes as (select episode, scene_idx, min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) as n_shots,
   arg_min(source, shot_idx) as source, min(shot_idx) - 1 as pos from shots group by 1, 2)"""


def _scenes(s, d):
    return A.shots(s, d).groupBy("episode", "scene_idx").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n_shots"),
        F.min_by("source", "shot_idx").alias("source"), (F.min("shot_idx") - 1).alias("pos"),
    )


@query("e02_split_at", sql(SPEECH, SHOTS, SCENES, then="""
, st as (select episode, start_ms from scenes union select episode, start_ms from shots where source = 'Automatic'),
en as (select episode, max(end_ms) as e from scenes group by 1)
select episode, start_ms, coalesce(lead(start_ms) over (partition by episode order by start_ms), e) as end_ms from st join en using (episode)"""))
def _(s, d):
    sh = A.shots(s, d)
    # Cuts are offered at detected shots and at all speech starts; only the former hit a child.
    cuts = sh.where("source = 'Automatic'").select("episode", "start_ms").unionByName(A.speech(s, d).select("episode", (F.col("start_ms") * 2 + 1).alias("start_ms")))
    return E.split_at(_scenes(s, d), sh, cuts)


@query("e03_remove_boundary", sql(SHOTS, then="""
, f as (select *, shot_idx = 1 as is_first, max(end_ms) over (partition by episode) as e from shots),
k as (select * from f where is_first or source <> 'Automatic')
select episode, start_ms, coalesce(lead(start_ms) over (partition by episode order by start_ms), e) as end_ms from k"""))
def _(s, d):
    sh = A.shots(s, d)
    return E.remove_boundary(sh, sh.where("source = 'Automatic'"))


@query("e04_expand_frames", sql(SHOTS, then="""
, r as (select episode, shot_idx, start_ms, (end_ms - start_ms) // 40 as n from shots)
select episode, shot_idx, n as frames, cast(n as int) as last_frame, start_ms as first_pos, start_ms + (n - 1) * 40 as last_pos, n * start_ms + 40 * (n * (n - 1) // 2) as sum_pos
from r where n > 0"""))
def _(s, d):
    """All frames at 25 per second, compared by number, bounds and sum per shot."""
    return E.expand_frames(_sh(s, d)).groupBy("episode", "shot_idx").agg(
        F.count(F.lit(1)).alias("frames"), F.max("frame_id").alias("last_frame"), F.min("pos_ms").alias("first_pos"),
        F.max("pos_ms").alias("last_pos"), F.sum("pos_ms").alias("sum_pos"))


@query("e05_split_speech", sql(SPEECH, then="""
select seg_idx, 1 as part, 'S' as speaker, start_ms, (start_ms + end_ms) // 2 as end_ms from known
union all select seg_idx, 2, speaker, (start_ms + end_ms) // 2, end_ms from known"""))
def _(s, d):
    return E.split_speech(A.known(s, d)).select("seg_idx", "part", "speaker", "start_ms", "end_ms")


PRF = """round(p, 6) as "precision", round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f_score,
 round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy from (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as p,
 case when tp + fn > 0 then tp / (tp + fn) else 0 end as r from c)"""


def _scored(df, *keys):
    return df.select(*keys, *[F.col(c).cast("long").alias(c) for c in Q.COUNTS], *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f_score", "accuracy")])


@query("q01_evaluate_shots", sql(SHOTS, then="""
, c0 as (select episode, count(*) filter (where source = 'Both') as tp, count(*) filter (where source = 'Automatic') as fp,
   count(*) filter (where source = 'Manual') as fn, cast(floor(max(end_ms) / 40.0) as bigint) as nf from shots group by 1),
c as (select episode, tp, fp, fn, nf - tp - fp - fn as tn from c0)
select episode, tp, fp, fn, tn, """ + PRF))
def _(s, d):
    return _scored(Q.evaluate_shots(A.shots(s, d)), "episode")


@query("q02_evaluate_recurring", sql(SHOTS, then="""
, g as (select *, scene_idx // 3 as part from shots),
p as (select a.episode, a.part, a.shot_id, max(case when a.cam_manual = b.cam_manual then 1 else 0 end) as m, max(case when a.cam_auto = b.cam_auto then 1 else 0 end) as u,
  max(case when a.cam_manual = b.cam_manual and a.cam_auto = b.cam_auto then 1 else 0 end) as b2
  from g a left join g b on a.episode = b.episode and a.part = b.part and a.shot_id <> b.shot_id group by 1, 2, 3),
k as (select episode, case when m = 0 and u = 0 then 'tn' when u = 0 then 'fn' when m = 0 then 'fp' when b2 = 1 then 'tp' else 'fp' end as kind, part from p),
c as (select episode, part, count(*) filter (where kind = 'tp') as tp, count(*) filter (where kind = 'fp') as fp, count(*) filter (where kind = 'fn') as fn,
  count(*) filter (where kind = 'tn') as tn from k group by 1, 2)
select episode, part, tp, fp, fn, tn, """ + PRF))
def _(s, d):
    sh = A.shots(s, d).withColumn("part", F.expr("scene_idx div 3"))
    return _scored(Q.evaluate_recurring(sh, ["episode", "part"]), "episode", "part")


@query("q03_evaluate_scenes", sql(SHOTS, SCENES, then="""
, f as (select *, scene_idx > min(scene_idx) over (partition by episode) as late from scenes),
c0 as (select episode, count(*) filter (where late and source = 'Both') as tp, count(*) filter (where late and source = 'Automatic') as fp,
   count(*) filter (where late and source = 'Manual') as fn, sum(n_shots) as n from f group by 1),
c as (select episode, tp, fp, fn, cast(n - 1 - tp - fp - fn as bigint) as tn from c0)
select episode, tp, fp, fn, tn, """ + PRF))
def _(s, d):
    return _scored(Q.evaluate_scenes(_scenes(s, d)), "episode")


@query("q04_coverage_overflow", sql(SHOTS, SCENES, then="""
, n as (select episode, sum(n_shots) - 1 as ls from scenes group by 1),
ref as (select episode, pos from scenes where source <> 'Automatic' or pos = 0),
hyp as (select episode, pos from scenes where source <> 'Manual' or pos = 0),
r as (select episode, pos, ls, coalesce(lag(pos) over w, 0) as pinf, coalesce(lead(pos) over w - 1, ls) as sup, coalesce(lead(pos, 2) over w - 1, ls) as nsup
  from ref join n using (episode) window w as (partition by episode order by pos)),
m as (select episode, pos from ref union select episode, pos from hyp),
pc as (select episode, pos, coalesce(lead(pos) over (partition by episode order by pos), ls + 1) - pos as len from m join n using (episode)),
w as (select r.episode, r.pos, max(len) as widest from r join pc on pc.episode = r.episode and pc.pos between r.pos and r.sup group by 1, 2),
h as (select r.episode, r.pos, max(hyp.pos) filter (where hyp.pos <= r.pos) as hb, min(hyp.pos) filter (where hyp.pos > r.sup) as ha
  from r join hyp on hyp.episode = r.episode group by 1, 2),
x as (select *, case when (pos - pinf) + (nsup - sup) > 0 then
   ((pos - greatest(hb, pinf)) + (coalesce(least(ha - 1, nsup), ls) - sup)) / ((pos - pinf) + (nsup - sup)) end as o
  from r join w using (episode, pos) join h using (episode, pos)),
g as (select episode, sum(widest) / max(ls) as c, sum(o * (sup - pos + 1)) / max(ls) as o from x group by 1)
select episode, round(c, 6) as coverage, round(o, 6) as overflow, round(case when 1 - o + c > 0 then 2 * (1 - o) * c / (1 - o + c) else 0 end, 6) as f_score from g"""))
def _(s, d):
    sc = _scenes(s, d)
    ref = sc.where("source <> 'Automatic' or pos = 0")
    hyp = sc.where("source <> 'Manual' or pos = 0")
    sizes = sc.groupBy("episode").agg(F.sum("n_shots").alias("n"))
    r = Q.coverage_overflow(ref, hyp, sizes)
    return r.select("episode", *[F.round(c, 6).alias(c) for c in ("coverage", "overflow", "f_score")])


@query("q05_precision_recall", sql(SPEECH, then="""
, c as (select unit, count(*) filter (where speaker = 'spk01') as tp, count(*) filter (where speaker = 'spk02') as fp,
  count(*) filter (where speaker = 'spk03') as fn, count(*) filter (where speaker = 'S') as tn from speech group by 1)
select unit, tp, fp, fn, tn, round(p, 6) as "precision", round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f_score,
 round(case when tp + fp + fn + tn > 0 then (tp + tn) / (tp + fp + fn + tn) else 0 end, 6) as accuracy
from (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0 end as r from c)"""))
def _(s, d):
    n = lambda x: F.count_if(F.col("speaker") == x)
    c = A.speech(s, d).groupBy("unit").agg(n("spk01").alias("tp"), n("spk02").alias("fp"), n("spk03").alias("fn"), n("S").alias("tn"))
    return _scored(Q.with_scores(c), "unit")
