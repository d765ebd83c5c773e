"""Queries for communities."""

from pyspark.sql import functions as F

from turnloom.catalog.ctes import SPEECH, sql
from turnloom.catalog.networks import SE, scene_edges
from turnloom.catalog.registry import query
from turnloom.operators import communities as C
from turnloom.operators import networks as N
from turnloom.session import cut

ROUNDS = 12  # labels have settled before, or alternate


def _round_sql(k: int) -> str:
    return f"""
v{k} as (select series, scene, speaker, com, round(sum(w), 9) as v from (
   select en.series, en.scene, en.speaker, l.com, en.weight as w from en join l{k - 1} l on l.series = en.series and l.scene = en.scene and l.speaker = en.other
   union all select h.series, h.scene, h.speaker, l.com, h.w from hv h join l{k - 1} l using (series, scene, speaker)) group by 1, 2, 3, 4),
l{k} as (select series, scene, speaker, com from (select *, row_number() over (partition by series, scene, speaker order by v desc, com) as r from v{k}) where r = 1)"""


# Networks of half a day, so that views have several communities.
DAY = """
se12 as (select series, scene // 6 as scene, src, dst, sum(weight) as weight from se group by 1, 2, 3, 4),
en12 as (select series, scene, unnest([src, dst]) as speaker, unnest([dst, src]) as other, weight from se12)"""
COM = SE + "," + DAY + """,
hv as (select series, scene, speaker, max(weight) as w from en12 group by 1, 2, 3),
l0 as (select series, scene, speaker, speaker as com from hv),""" + ",".join(_round_sql(k).replace("from en join", "from en12 en join") for k in range(1, ROUNDS + 1)) + f""",
com as (select series, scene, speaker, least(a.com, b.com) as com from l{ROUNDS} a join l{ROUNDS - 1} b using (series, scene, speaker))"""
SCORES = """
ew as (select e.*, a.com as c1, b.com as c2 from se12 e join com a on a.series = e.series and a.scene = e.scene and a.speaker = src
   join com b on b.series = e.series and b.scene = e.scene and b.speaker = dst),
tw as (select series, scene, c1 as com, weight as win, 0 as wout from ew where c1 = c2 union all select series, scene, unnest([c1, c2]), 0, weight from ew where c1 <> c2),
cs as (select series, scene, com, sum(win) as weight, sum(win) / (sum(win) + sum(wout)) as modularity, sum(win) - sum(wout) as balance from tw group by 1, 2, 3),
ms as (select en12.series, en12.scene, en12.speaker, a.com, sum(case when a.com = b.com then weight else 0 end) / sum(weight) as strength
  from en12 join com a on a.series = en12.series and a.scene = en12.scene and a.speaker = en12.speaker
  join com b on b.series = en12.series and b.scene = en12.scene and b.speaker = other group by 1, 2, 3, 4),
st as (select series, scene, speaker, sum(weight) as strength from en12 group by 1, 2, 3),
cv as (select com.series, com.scene, com, speaker as key, strength as w from com join st using (series, scene, speaker))"""


def views(s, d):
    e = scene_edges(s, d).groupBy("series", F.expr("scene div 6").alias("scene"), "src", "dst").agg(F.sum("weight").alias("weight"))
    return cut(e)


def _both(s, d):
    v = views(s, d)
    return v, C.communities(v)


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("c01_communities", sql(SPEECH, COM, then="select * from com"))
def _(s, d):
    return _both(s, d)[1]


@query("c01_multilevel")
def _(s, d):
    return C.modular_communities(views(s, d))


@query("c01_modularity", sql(SPEECH, COM, then="""
, x as (select en12.series, en12.scene, a.com, sum(weight) as w, sum(case when a.com = b.com then weight else 0 end) as i from en12
  join com a on a.series = en12.series and a.scene = en12.scene and a.speaker = en12.speaker
  join com b on b.series = en12.series and b.scene = en12.scene and b.speaker = other group by 1, 2, 3)
select series, scene, round(sum(i) / sum(w) - sum(w * w) / (sum(w) * sum(w)), 6) as modularity from x group by 1, 2"""))
def _(s, d):
    return _r(C.modularity(*_both(s, d)), "modularity")


@query("c02_static_community", sql(SPEECH, COM, then="""
, f as (select series, scene, min(com) as com from com where series = 1 and scene = (select min(scene) from com where series = 1) group by 1, 2)
select series, scene, speaker, com from com join f using (series, scene, com)"""))
def _(s, d):
    m = _both(s, d)[1].where("series = 1")
    first = m.agg(F.min(F.struct("scene", "com")).alias("f")).select("f.scene", "f.com")  # one row
    return m.join(first, ["scene", "com"], "left_semi").select("series", "scene", "speaker", "com")


@query("c03_community_modularity", sql(SPEECH, COM, SCORES, then="select series, scene, com, round(modularity, 6) as modularity from cs"))
def _(s, d):
    return _r(C.community_scores(*_both(s, d)).select("series", "scene", "com", "modularity"), "modularity")


@query("c04_community_balance", sql(SPEECH, COM, SCORES, then="select series, scene, com, round(balance, 6) as balance from cs"))
def _(s, d):
    return _r(C.community_scores(*_both(s, d)).select("series", "scene", "com", "balance"), "balance")


@query("c05_community_weight", sql(SPEECH, COM, SCORES, then="select series, scene, com, round(weight, 6) as weight from cs"))
def _(s, d):
    return _r(C.community_scores(*_both(s, d)).select("series", "scene", "com", "weight"), "weight")


@query("c06_member_strength", sql(SPEECH, COM, SCORES, then="select series, scene, speaker, com, round(strength, 6) as strength from ms"))
def _(s, d):
    return _r(C.member_strength(*_both(s, d)), "strength")


@query("c07_community_vectors", sql(SPEECH, COM, SCORES, then="""
select 'strength' as kind, series, scene, com, key, round(w, 6) as w from cv
union all select 'edge', series, scene, c1, concat(src, '|', dst), round(weight, 6) from ew where c1 = c2"""))
def _(s, d):
    v, m = _both(s, d)
    a = C.community_vectors(v, m).withColumn("kind", F.lit("strength"))
    return _r(a.unionByName(C.community_vectors(v, m, "edge").withColumn("kind", F.lit("edge"))), "w")


@query("c08_community_similarity", sql(SPEECH, COM, SCORES, then="""
, nr as (select series, scene, com, sqrt(sum(w * w)) as n from cv group by 1, 2, 3)
select a.series, a.scene, a.com as com1, b.com as com2, round(sum(a.w * b.w) / (min(x.n) * min(y.n)), 6) as cosine from cv a join cv b on a.series = b.series and b.scene = a.scene + 1 and a.key = b.key
join nr x on x.series = a.series and x.scene = a.scene and x.com = a.com join nr y on y.series = b.series and y.scene = b.scene and y.com = b.com group by 1, 2, 3, 4"""))
def _(s, d):
    return _r(C.community_similarity(C.community_vectors(*_both(s, d))), "cosine")


def _matching(v, m):
    return C.match_partitions(C.community_similarity(C.community_vectors(v, m)))


@query("c09_match_partitions")
def _(s, d):
    return _r(_matching(*_both(s, d)), "cosine")


@query("c10_dynamic_communities")
def _(s, d):
    return C.dynamic_communities(_matching(*_both(s, d)))


@query("c11_relabel_communities")
def _(s, d):
    v, m = _both(s, d)
    return C.relabel_communities(m, C.dynamic_communities(_matching(v, m)))


@query("c12_track_speaker", sql(SPEECH, COM, SCORES, then="""
select series, scene, speaker, com, round(strength, 6) as strength, round(weight, 6) as weight, round(modularity, 6) as modularity, round(balance, 6) as balance
from ms join cs using (series, scene, com) where speaker = 'spk05'"""))
def _(s, d):
    return _r(C.track_speaker(*_both(s, d), "spk05"), "strength", "weight", "modularity", "balance")


@query("c13_key_moments")
def _(s, d):
    return _r(C.key_moments(*_both(s, d), 3), "value")


@query("c14_longest_communities")
def _(s, d):
    v, m = _both(s, d)
    return _r(C.longest_communities(C.dynamic_communities(_matching(v, m)), C.community_scores(v, m), 3), "balance")


@query("c15_rank_members", sql(SPEECH, COM, SCORES, then="""
, big as (select series, scene, com, count(*) as size from com group by 1, 2, 3 having count(*) >= 3),
r as (select com.series, com.scene, com.com, com.speaker, strength, size, row_number() over (partition by com.series, com.scene, com.com order by strength desc, com.speaker desc) as rank
  from com join big on big.series = com.series and big.scene = com.scene and big.com = com.com join st on st.series = com.series and st.scene = com.scene and st.speaker = com.speaker)
select series, scene, com, speaker, round(strength, 6) as strength, size, cast(rank as int) as rank from r where strength >= 8"""))
def _(s, d):
    v, m = _both(s, d)
    return _r(C.rank_members(m, N.node_strengths(v), 3, 8), "strength")
