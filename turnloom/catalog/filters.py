"""Queries for filters and projections."""

from pyspark.sql import functions as F

from turnloom.catalog.ctes import LINES, ORDERS, SHOTS, SPEECH, sql
from turnloom.catalog.registry import query
from turnloom.functions import columns as C
from turnloom.operators import filters as f
from turnloom.sources import adapters as A

# A small weighted graph per episode: seconds a speaker talks right before another.
EDGES = """
nx as (select *, lead(speaker) over (partition by unit order by start_ms, seg_idx) as other from known),
edges as (select episode as scene, least(speaker, other) as src, greatest(speaker, other) as dst, sum(end_ms - start_ms) / 1000.0 as weight
    from nx where other is not null and other <> speaker group by 1, 2, 3),
strengths as (select scene, speaker, sum(weight) as strength from
    (select scene, src as speaker, weight from edges union all select scene, dst, weight from edges) group by 1, 2)"""


def episode_edges(spark, sf_dir):
    """Scene (= episode), src, dst, weight: seconds of speech before a change of speaker."""
    from turnloom.plans.ordered import neighbours, time_block

    k = neighbours(A.known(spark, sf_dir), ["unit"], ["start_ms", "seg_idx"], time_block("start_ms"), nxt={"other": F.col("speaker")})
    k = k.where("other is not null and other <> speaker")
    return k.groupBy(
        F.col("episode").alias("scene"), C.pair_low("speaker", "other").alias("src"), C.pair_high("speaker", "other").alias("dst")
    ).agg((F.sum(F.col("end_ms") - F.col("start_ms")) / 1000.0).alias("weight"))


def strengths(edges):
    ends = edges.select("scene", F.explode(F.array("src", "dst")).alias("speaker"), "weight")
    return ends.groupBy("scene", "speaker").agg(F.sum("weight").alias("strength"))


SEG = "select unit, seg_idx, speaker, start_ms, end_ms from "


def _seg(df):
    return df.select("unit", "seg_idx", "speaker", "start_ms", "end_ms")


@query("f01_denoise", sql(SPEECH, then=SEG + "speech where speaker <> ''"))
def _(s, d):
    return _seg(f.denoise(A.speech(s, d)))


@query("f02_known_speakers", sql(SPEECH, then=SEG + "speech where speaker <> 'S'"))
def _(s, d):
    return _seg(f.known_speakers(A.speech(s, d)))


@query("f03_units_with", sql(SPEECH, then=SEG + "known where unit in (select unit from known where speaker = 'spk03')"))
def _(s, d):
    return _seg(f.units_with(A.known(s, d), "spk03"))


@query("f04_until_season", sql(SPEECH, then=SEG + "known where season <= 2"))
def _(s, d):
    return _seg(f.until_season(A.known(s, d), 2))


@query("f05_select_vertices", sql(SPEECH, EDGES, then="""
, big as (select scene, speaker from strengths where strength >= 1000)
select scene, src, dst, round(weight, 6) as weight from edges e
where exists (select 1 from big b where b.scene = e.scene and b.speaker = src)
  and exists (select 1 from big b where b.scene = e.scene and b.speaker = dst)"""))
def _(s, d):
    e = episode_edges(s, d)
    _, kept = f.select_vertices(strengths(e), e, 1000)
    return kept.select("scene", "src", "dst", F.round("weight", 6).alias("weight"))


@query("f06_select_edges", sql(SPEECH, EDGES, then="""
select distinct scene, unnest([src, dst]) as speaker from edges where weight >= 200"""))
def _(s, d):
    return f.select_edges(episode_edges(s, d), 200)[1]


@query("f07_positive_edges", sql(SPEECH, EDGES, then="""
select scene, src, dst, round(weight - 100, 6) as weight from edges where weight - 100 > 0"""))
def _(s, d):
    e = episode_edges(s, d).withColumn("weight", F.col("weight") - 100)
    return f.positive_edges(e).withColumn("weight", F.round("weight", 6))


@query("f08_filter_speakers", sql(SPEECH, EDGES, then="""
select speaker, round(sum(strength) / 21.0, 6) as strength from strengths where scene between 5 and 25
group by 1 having sum(strength) / 21.0 >= 900"""))
def _(s, d):
    return f.filter_speakers(episode_edges(s, d), 5, 25, 900).withColumn("strength", F.round("strength", 6))


@query("f09_select_episodes", sql(SPEECH, then="""
, big as (select season, episode from speech group by 1, 2 having count(*) filter (where speaker = '') >= 65)
select unit, seg_idx, speaker, start_ms, end_ms from known join big using (season, episode)"""))
def _(s, d):
    sp = A.speech(s, d)
    listed = sp.groupBy("season", "episode").agg(F.count_if(F.col("speaker") == "").alias("n")).where("n >= 65")
    return _seg(f.select_episodes(A.known(s, d), listed))


@query("f10_remove_auto_shots", sql(SHOTS, then="select episode, shot_idx, 'Manual' as source from shots where source <> 'Automatic'"))
def _(s, d):
    return f.remove_auto_shots(A.shots(s, d)).select("episode", "shot_idx", "source")


@query("f13_format_position", sql(SPEECH, then="""
, p as (select seg_idx, start_ms % 7300000 as ms from speech)
select seg_idx, case when ms // 1000 > 3600
   then printf('%02d:%02d:%02d.%03d', ms // 3600000 % 60, ms // 60000 % 60, ms // 1000 % 60, ms % 1000)
   else printf('%02d:%02d.%03d', ms // 60000 % 60, ms // 1000 % 60, ms % 1000) end as position from p"""))
def _(s, d):
    return A.speech(s, d).select("seg_idx", C.format_position(F.col("start_ms") % 7300000).alias("position"))


@query("f14_clean_label", sql(LINES, then=r"""
select unit, seg_idx, trim(regexp_replace(text, '\s+', ' ', 'g')) as label from lines"""))
def _(s, d):
    return A.lines(s, d).select("unit", "seg_idx", C.clean_label("text").alias("label"))


@query("f15_abbreviate_label", sql(ORDERS, then="""
select unit, speaker, case when regexp_matches(speaker, '^(.).+ (.+)$')
  then regexp_replace(speaker, '^(.).+ (.+)$', '\\1. \\2') else speaker end as label from order_lines""".replace("\\\\", "\\")))
def _(s, d):
    return A.order_lines(s, d).select("unit", "speaker", C.abbreviate_label("speaker").alias("label"))


@query("f16_canonical_pair", sql(SPEECH, then="""
select seg_idx, least(a, b) as src, greatest(a, b) as dst from
 (select seg_idx, speaker as a, concat('spk', lpad(cast(seg_idx % 12 as varchar), 2, '0')) as b from known)"""))
def _(s, d):
    other = F.concat(F.lit("spk"), F.lpad((F.col("seg_idx") % 12).cast("string"), 2, "0"))
    return A.known(s, d).select("seg_idx", C.canonical_pair(F.col("speaker"), other).alias("p")).select("seg_idx", "p.src", "p.dst")


@query("f17_scene_code", sql(SPEECH, then="""
select distinct unit, printf('S%02dE%02d_%03d', season, episode, unit) as code from speech"""))
def _(s, d):
    return A.speech(s, d).select("unit", C.scene_code("season", "episode", "unit").alias("code")).distinct()


@query("f18_add_interlocutor", sql(SPEECH, then="""
select seg_idx, array_to_string(list_sort(list_distinct([speaker, 'spk05', case when seg_idx % 2 = 0 then 'spk09' else 'spk01' end])), ',') as inter
from known"""))
def _(s, d):
    arr = C.add_interlocutor(F.array("speaker"), F.lit("spk05"))
    arr = C.add_interlocutor(arr, F.when(F.col("seg_idx") % 2 == 0, "spk09").otherwise("spk01"))
    return A.known(s, d).select("seg_idx", F.array_join(arr, ",").alias("inter"))
