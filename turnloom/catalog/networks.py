"""Queries for networks through time."""

from pyspark.sql import functions as F

from turnloom.catalog.ctes import SPEECH, sql
from turnloom.catalog.interactions import GAP, rules_cte
from turnloom.catalog.registry import query
from turnloom.operators import filters as f
from turnloom.operators import interactions as I
from turnloom.operators import networks as N
from turnloom.plans.ordered import neighbours, time_block
from turnloom.sources import adapters as A

# series = season, scene = hour of the season, weight = minutes of speech before a change of speaker.
SE = """
nx as (select *, lead(speaker) over (partition by unit order by start_ms, seg_idx) as other from known),
se as (select season as series, unit - season * 168 as scene, least(speaker, other) as src, greatest(speaker, other) as dst, sum(end_ms - start_ms) / 60000.0 as weight
    from nx where other is not null and other <> speaker group by 1, 2, 3, 4),
sc as (select season as series, unnest(range(min(unit) - season * 168, max(unit) - season * 168 + 1)) as scene from known group by season),
en as (select series, scene, unnest([src, dst]) as speaker, unnest([dst, src]) as other, weight from se)"""


def scene_edges(s, d):
    k = neighbours(A.known(s, d), ["unit"], ["start_ms", "seg_idx"], time_block("start_ms"), nxt={"other": F.col("speaker")})
    k = k.where("other is not null and other <> speaker")
    return k.groupBy(
        F.col("season").alias("series"), (F.col("unit") - F.col("season") * 168).cast("long").alias("scene"),
        F.least("speaker", "other").alias("src"), F.greatest("speaker", "other").alias("dst"),
    ).agg((F.sum(F.col("end_ms") - F.col("start_ms")) / 60000.0).alias("weight"))


def scene_list(s, d):
    u = A.known(s, d).groupBy(F.col("season").alias("series")).agg(F.min("unit").alias("a"), F.max("unit").alias("b"))
    first = (F.col("a") - F.col("series") * 168).cast("long")
    return u.select("series", F.explode(F.sequence(first, (F.col("b") - F.col("series") * 168).cast("long"))).alias("scene"))


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


# Dense grid of pairs and scenes with activity, prefix sums and own scenes around each scene.
GRID = """
act as (select series, scene, speaker, sum(weight) as w from en group by 1, 2, 3),
pr as (select distinct series, src, dst from se),
gr as (select pr.series, pr.src, pr.dst, sc.scene, x.w as oa, y.w as ob, se.weight as own, coalesce(x.w, y.w, 0) as o, coalesce(x.w, 0) + coalesce(y.w, 0) as bo
  from pr join sc using (series) left join act x on x.series = pr.series and x.scene = sc.scene and x.speaker = pr.src
  left join act y on y.series = pr.series and y.scene = sc.scene and y.speaker = pr.dst
  left join se on se.series = pr.series and se.scene = sc.scene and se.src = pr.src and se.dst = pr.dst),
g1 as (select *, sum(o) over w as s, sum(bo) over w as b, max(case when own is not null then scene end) over w as p,
  min(case when own is not null then scene end) over (partition by series, src, dst order by scene rows between 1 following and unbounded following) as q,
  min(case when bo > 0 then scene end) over (partition by series, src, dst) as lo, max(case when bo > 0 then scene end) over (partition by series, src, dst) as hi_all,
  max(case when bo > 0 then scene end) over (partition by series, src, dst order by scene rows between unbounded preceding and 1 preceding) as act_before
  from gr window w as (partition by series, src, dst order by scene)),
g2 as (select g.*, a.own as ip, a.s as sp, a.b as bp, z.own as iq, z.s - z.o as sq0, z.b - z.bo as bq0, z.act_before as m
  from g1 g left join g1 a on a.series = g.series and a.src = g.src and a.dst = g.dst and a.scene = g.p
  left join g1 z on z.series = g.series and z.src = g.src and z.dst = g.dst and z.scene = g.q),
g3 as (select g.*, coalesce(t.s - t.o, 0) as smin from g2 g left join g1 t on t.series = g.series and t.src = g.src and t.dst = g.dst
  and t.scene = case when g.p is not null and g.m = g.p then g.p + 1 else least(g.scene, coalesce(g.m, g.scene)) end)"""


@query("n01_narrative_snapshots", sql(SPEECH, SE, GRID, then="""
, v as (select series, scene, src, dst, case
   when own is not null then own
   when p is not null and q is not null then greatest(ip - (s - sp), case when m = p then iq else iq - (sq0 - smin) end)
   when p is null and q is not null and scene >= lo then iq - bq0 + smin
   when p is not null and q is null and scene <= hi_all then ip - (s - sp) end as raw from g3)
select series, scene, src, dst, round(1 / (1 + exp(-0.01 * raw)), 6) as weight from v where raw is not null"""))
def _(s, d):
    return _r(N.narrative_snapshots(scene_edges(s, d)), "weight")


@query("n02_past_future_snapshots", sql(SPEECH, SE, GRID, then="""
, v as (select series, scene, src, dst, ip - (b - bp) as past, iq - (bq0 - b) as future, scene >= lo as seen, scene < hi_all as more from g2)
select series, scene, src, dst, round(1 / (1 + exp(-0.01 * greatest(past, future))), 6) as weight from v
where (past is not null and future is not null) or (past is not null and more) or (future is not null and seen)"""))
def _(s, d):
    return _r(N.past_future_snapshots(scene_edges(s, d)), "weight")


@query("n03_cumulative_networks", sql(SPEECH, SE, then="""
, n as (select series, max(scene) + 1 as n from sc group by 1),
c as (select series, scene // 25 as blk, src, dst, sum(weight) as weight from se group by 1, 2, 3, 4)
select c.series, sc.scene, src, dst, round(weight, 6) as weight from c join n using (series) join sc on sc.series = c.series and sc.scene // 25 = blk where (blk + 1) * 25 <= n"""))
def _(s, d):
    n = scene_list(s, d).groupBy("series").agg((F.max("scene") + 1).alias("n"))
    return _r(N.cumulative_networks(scene_edges(s, d), n, 25), "weight")


@query("n04_relation_series", sql(SPEECH, SE, then="""
select sc.series, sc.scene, round(coalesce(sum(weight), 0), 6) as weight from sc left join se on se.series = sc.series and se.scene = sc.scene
 and src = 'spk02' and dst = 'spk07' group by 1, 2"""))
def _(s, d):
    return _r(N.relation_series(scene_edges(s, d), scene_list(s, d), "spk07", "spk02"), "weight")


@query("n05_strength_series", sql(SPEECH, SE, then="""
select sc.series, sc.scene, round(coalesce(sum(weight), 0), 6) as strength from sc left join en on en.series = sc.series and en.scene = sc.scene
 and speaker = 'spk04' group by 1, 2"""))
def _(s, d):
    return _r(N.strength_series(scene_edges(s, d), scene_list(s, d), "spk04"), "strength")


@query("n06_neighbours", sql(SPEECH, SE, then="""
select series, scene, speaker, other, round(weight, 6) as weight, round(strength, 6) as strength, cast(rank as int) as rank from
 (select *, row_number() over (partition by series, scene, speaker order by weight desc, other desc) as rank,
   sum(weight) over (partition by series, scene, speaker) as strength from en) where rank <= 2"""))
def _(s, d):
    e = scene_edges(s, d)
    return _r(N.neighbour_lists(e, e, 2), "weight", "strength")


@query("n07_node_strengths", sql(SPEECH, rules_cte("known", GAP), then="""
, g as (select unit, least(speaker, inter) as src, greatest(speaker, inter) as dst, sum(end_ms - start_ms) / 1000.0 as w from tn_inter where inter is not null group by 1, 2, 3)
select unit, speaker, round(sum(w), 6) as strength from (select unit, unnest([src, dst]) as speaker, w from g where src <> dst) group by 1, 2"""))
def _(s, d):
    g = I.interaction_graph(I.sequential(f.known_speakers(f.denoise(A.speech(s, d))), 0, GAP), by=["unit"])
    return _r(N.node_strengths(g, ["unit"]), "strength")


@query("n08_normalise_views", sql(SPEECH, SE, then="""
, st as (select series, scene, speaker, sum(weight) as w from en group by 1, 2, 3)
select 'vertex' as kind, series, scene, speaker as a, null as b, round(w / (select max(w) from st), 6) as weight, round(pow(w / (select max(w) from st), 1 / 60.0), 6) as colour from st
union all select 'edge', series, scene, src, dst, round(weight / (select max(weight) from se), 6), round(pow(weight / (select max(weight) from se), 1 / 60.0), 6) from se"""))
def _(s, d):
    v, e = N.normalise_views(scene_edges(s, d))
    v = v.select(F.lit("vertex").alias("kind"), "series", "scene", F.col("speaker").alias("a"), F.lit(None).cast("string").alias("b"), F.col("strength").alias("weight"), "colour")
    e = e.select(F.lit("edge").alias("kind"), "series", "scene", F.col("src").alias("a"), F.col("dst").alias("b"), "weight", "colour")
    return _r(v.unionByName(e), "weight", "colour")


@query("n09_interacting_speakers", sql(SPEECH, SE, then="select distinct series, scene, speaker from en"))
def _(s, d):
    return N.interacting_speakers(scene_edges(s, d))


@query("n10_ego_vectors", sql(SPEECH, SE, then="select series, scene, speaker, other, round(weight, 6) as weight from en"))
def _(s, d):
    return _r(N.ego_vectors(scene_edges(s, d)), "weight")


@query("n11_social_state_distance", sql(SPEECH, SE, then="""
, p as (select *, row_number() over (partition by series, speaker order by scene) as pos from (select distinct series, speaker, scene from en)),
nr as (select series, speaker, scene, sqrt(sum(weight * weight)) as norm from en group by 1, 2, 3),
x as (select a.series, a.speaker, a.scene as scene1, b.scene as scene2 from p a join p b on a.series = b.series and a.speaker = b.speaker and b.pos > a.pos),
pd as (select x.series, x.speaker, scene1, scene2, sum(u.weight * v.weight) as pr from x join en u on u.series = x.series and u.speaker = x.speaker and u.scene = scene1
   join en v on v.series = x.series and v.speaker = x.speaker and v.scene = scene2 and v.other = u.other group by 1, 2, 3, 4)
select x.series, x.speaker, x.scene1, x.scene2, round(sqrt(greatest(2 - 2 * coalesce(case when a.norm > 0 and b.norm > 0 then pr / (a.norm * b.norm) end, 0), 0)), 5) as distance
from x left join pd using (series, speaker, scene1, scene2) join nr a on a.series = x.series and a.speaker = x.speaker and a.scene = x.scene1
join nr b on b.series = x.series and b.speaker = x.speaker and b.scene = x.scene2"""))
def _(s, d):
    e = scene_edges(s, d)
    return N.social_state_distance(e, e).withColumn("distance", F.round("distance", 5))


@query("n12_neighbourhood_similarity", sql(SPEECH, SE, then="""
, nr as (select series, scene, speaker, sqrt(sum(weight * weight)) as norm from en group by 1, 2, 3)
select e.series, e.scene, e.speaker, e.other, round(case when a.norm > 0 and b.norm > 0 then weight * weight / (a.norm * b.norm) else 0 end, 6) as cosine from en e
join nr a on a.series = e.series and a.scene = e.scene and a.speaker = e.speaker join nr b on b.series = e.series and b.scene = e.scene and b.speaker = e.other"""))
def _(s, d):
    return _r(N.neighbourhood_similarity(scene_edges(s, d)), "cosine")


@query("n13_edge_ends", sql(SPEECH, SE, then="""
select distinct series, src, dst from se where (series, scene) in (select (series, min(scene)) from se group by series)"""))
def _(s, d):
    return N.edge_ends(scene_edges(s, d))


@query("n14_adjacency", sql(SPEECH, SE, then="""
select series, scene, speaker, round(coalesce(sum(weight) filter (where other = 'spk01'), 0), 6) as spk01, round(coalesce(sum(weight) filter (where other = 'spk02'), 0), 6) as spk02,
 round(coalesce(sum(weight) filter (where other = 'spk03'), 0), 6) as spk03 from en
where speaker in ('spk01', 'spk02', 'spk03') and other in ('spk01', 'spk02', 'spk03') group by 1, 2, 3"""))
def _(s, d):
    return _r(N.adjacency(scene_edges(s, d), ["spk01", "spk02", "spk03"]), "spk01", "spk02", "spk03")


@query("n15_build_graph", sql(SPEECH, rules_cte("known", GAP), then="""
select season as series, episode as scene, least(speaker, inter) as src, greatest(speaker, inter) as dst, 1.0::double as weight from tn_inter where inter is not null group by 1, 2, 3, 4"""))
def _(s, d):
    e = I.utterance_network(I.sequential(A.known(s, d), 0, GAP), by=["season", "episode"])
    return N.build_graph(e.withColumnsRenamed({"season": "series", "episode": "scene"}), weighted=False)[1]


def _sweep_sql(n: int, step: int, src: str, dst: str) -> str:
    return f"""
{dst}b as (select p.series, p.scene, p.speaker, round(coalesce((o.pos + coalesce(wp, 0)) / (1 + coalesce(w, 0)), p.pos), 9) as bary
  from {src} p left join {src} o on o.series = p.series and o.speaker = p.speaker and o.scene + {step} = p.scene
  left join (select en.series, en.scene, en.speaker, sum(weight * x.pos) as wp, sum(weight) as w from en join {src} x on x.series = en.series and x.scene + {step} = en.scene and x.speaker = en.other
     group by 1, 2, 3) k on k.series = p.series and k.scene = p.scene and k.speaker = p.speaker),
{dst} as (select series, scene, speaker, row_number() over (partition by series, scene order by bary, speaker) as pos from {dst}b)"""


@query("n16_storyline_order", sql(SPEECH, SE, """
p0 as (select sc.series, sc.scene, k.speaker, k.pos from sc join (select series, speaker, row_number() over (partition by series order by speaker) as pos
  from (select distinct series, speaker from en)) k using (series))""", _sweep_sql(1, 1, "p0", "p1"), _sweep_sql(2, 1, "p1", "p2"), _sweep_sql(3, -1, "p2", "p3"), then="select * from p3"))
def _(s, d):
    e = scene_edges(s, d)
    who = N.interacting_speakers(e).select("series", "speaker").distinct()
    return N.storyline_order(e, scene_list(s, d), who, (1, 1, -1))
