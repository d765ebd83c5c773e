"""Queries for sources and sinks: what is written is read back."""

import uuid

from pyspark.sql import functions as F

from turnloom.catalog.ctes import FACES, LINES, MUSIC, SHOTS, SPEECH, VECTORS, sql
from turnloom.catalog.networks import SE, scene_edges
from turnloom.catalog.registry import query
from turnloom.operators import networks as N
from turnloom.operators.joins import locate
from turnloom.operators.sequences import merge_summary
from turnloom.session import cut, shared_dir
from turnloom.sources import adapters as A
from turnloom.sources import files as S
from turnloom.sources import project as P


def _path(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _tables(s, d):
    """The speech and shot tables as one project."""
    key = lambda df: df.withColumns({"series": F.lit("events"), "season": F.floor(F.col("episode") / 7).cast("int")})
    sp = A.speech(s, d).withColumn("series", F.lit("events"))
    sh = cut(key(A.shots(s, d)))
    scene = sh.groupBy(*P.EP, "scene_idx").agg(F.min("start_ms").alias("scene_ms"), F.min_by("source", "shot_idx").alias("source"))
    shots = sh.join(scene.drop("source"), [*P.EP, "scene_idx"]).select(*P.EP, "scene_ms", "start_ms", "end_ms", F.lit("Cut").alias("transition"), "cam_manual", "cam_auto", "source")
    at = sh.select("episode", F.col("start_ms").alias("shot_ms"), "start_ms", "end_ms")
    f = key(locate(A.faces(s, d), at, "frame_ms")).select(*P.EP, "shot_ms", "frame_ms", "face_idx", "x", "y", "w", "h", F.lit(-1).alias("face_id"), F.lit('a "b"').alias("name"),
        F.when(F.col("face_idx") % 2 == 0, F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.struct((F.col("x") + k).alias("x"), F.col("y").alias("y")))).alias("landmarks"))
    m = key(locate(A.music(s, d), at, "pos_ms")).select(*P.EP, "shot_ms", "pos_ms", "rate")
    empty = F.array().cast("array<string>")
    speech = sp.select(*P.EP, "start_ms", "end_ms", F.concat(F.lit("line "), F.col("seg_idx").cast("string")).alias("text"), F.col("speaker").alias("spk_ref"), F.lit("").alias("spk_hyp"),
        F.array("speaker").alias("inter_ref"), empty.alias("inter_cooc"), empty.alias("inter_seq"))
    eps = sp.select(*P.EP).distinct().select(*P.EP, F.concat(F.lit("day "), F.col("episode").cast("string")).alias("name"), F.concat(F.lit("day"), F.col("episode").cast("string"), F.lit(".avi")).alias("fname"),
        F.lit(480).alias("width"), F.lit(260).alias("height"), F.lit(25.0).alias("fps"))
    scenes = scene.select(*P.EP, F.col("scene_ms").alias("start_ms"), "source")
    return {"episodes": eps, "scenes": scenes, "shots": shots, "faces": f, "music": m, "speech": speech}


def _round_trip(s, d):
    path = _path(s, "project")
    P.write_project(_tables(s, d), path)
    return P.read_project(s, path, one_per_line=True)


KEYED = "'events' as series, cast(floor(episode / 7.0) as int) as season, episode"


@query("s01_read_project_shots", sql(SHOTS, then=f"""
select {KEYED}, min(start_ms) over (partition by episode, scene_idx) as scene_ms, start_ms, end_ms, 'Cut' as transition, cam_manual, cam_auto, source from shots"""))
def _(s, d):
    return _round_trip(s, d)["shots"]


@query("s01_read_project_speech", sql(SPEECH, then="""
select 'events' as series, season, episode, start_ms, end_ms, concat('line ', seg_idx) as text, speaker as spk_ref, speaker as inter_ref, '' as inter_seq from speech"""))
def _(s, d):
    sp = _round_trip(s, d)["speech"]
    return sp.select(*P.EP, "start_ms", "end_ms", "text", "spk_ref", F.array_join("inter_ref", ",").alias("inter_ref"), F.array_join("inter_seq", ",").alias("inter_seq"))


@query("s02_write_project_faces", sql(SHOTS, FACES, then=f"""
select {KEYED.replace('episode', 'f.episode')}, frame_ms, x, y, w, h, 'a "b"' as name, case when face_idx % 2 = 0 then x + 4 end as last_x
from faces f join shots s on s.episode = f.episode and frame_ms >= s.start_ms and frame_ms < s.end_ms"""))
def _(s, d):
    f = _round_trip(s, d)["faces"]
    return f.select(*P.EP, "frame_ms", "x", "y", "w", "h", "name", F.get("landmarks", F.lit(4))["x"].alias("last_x"))


@query("s02_write_project_music", sql(SHOTS, MUSIC, then=f"""
select {KEYED.replace('episode', 'm.episode')}, pos_ms, round(rate, 6) as rate from music m join shots s on s.episode = m.episode and pos_ms >= s.start_ms and pos_ms < s.end_ms"""))
def _(s, d):
    return _round_trip(s, d)["music"].withColumn("rate", F.round("rate", 6))


@query("s03_merge_projects", sql(SPEECH, then="""
select 'Events' as series, season, episode, count(*) as n from speech where episode < 20 group by 2, 3
union all select 'Events', season, episode, count(*) * 10 from speech where episode >= 20 group by 2, 3"""))
def _(s, d):
    n = A.speech(s, d).groupBy("season", "episode").agg(F.count(F.lit(1)).alias("n"))
    a = n.where("episode < 20").select(F.lit("Events").alias("series"), "season", "episode", "n")
    b = n.where("episode >= 15").select(F.lit("EVENTS").alias("series"), "season", "episode", (F.col("n") * 10).alias("n"))
    return P.merge_projects(a, b.unionByName(b.withColumn("series", F.lit("other"))))


SUBS = """
sb as (select unit, seg_idx, seg_idx * 3.1::double as s, seg_idx * 3.1::double + 2.5::double as e,
  case seg_idx % 3 when 0 then concat('- ', text, '<br />- ', source, ' x') when 1 then concat(' (', text, ') ') else text end as text from lines)"""


@query("s04_import_subtitles", sql(LINES, SUBS, then=r"""
, t as (select unit, seg_idx, cast(round(greatest(trunc((s + -0.38::double) * 1000), 0) / 10.0) * 10 as bigint) as t0,
  cast(round(trunc((e + -0.5::double) * 1000) / 10.0) * 10 as bigint) as t1, text, regexp_matches(text, '[_-].+<br />[_-].+') as several from sb),
p as (select *, case when several then list_transform(string_split(text, '<br />'), lambda z: regexp_replace(regexp_replace(z, '\s*-\s*', '', 'g'), '\s*_\s*', '', 'g')) else [text] end as parts from t),
w as (select *, list_transform(parts, lambda z: length(z) - length(replace(z, ' ', '')) + 1) as words from p),
q as (select *, list_transform(words, lambda k: cast(trunc((t1 - t0) * (k / list_sum(words))) as bigint)) as spans from w),
u as (select unit, seg_idx, t0, t1, spans, unnest(range(len(parts))) as part, unnest(parts) as text from q)
select unit, seg_idx, cast(part as int) as part, cast(t0 + coalesce(list_sum(spans[1:part]), 0) as bigint) as start_ms,
 cast(case when len(spans) = 1 then t1 else t0 + list_sum(spans[1:part + 1]) end as bigint) as end_ms, text,
 case when regexp_full_match(text, '\s*\(.*\)\s*') then '' else 'S' end as speaker from u"""))
def _(s, d):
    ln = A.lines(s, d)
    text = F.when(F.col("seg_idx") % 3 == 0, F.concat(F.lit("- "), "text", F.lit("<br />- "), "source", F.lit(" x")))
    text = text.when(F.col("seg_idx") % 3 == 1, F.concat(F.lit(" ("), "text", F.lit(") "))).otherwise(F.col("text"))
    subs = ln.select("unit", "seg_idx", (F.col("seg_idx") * F.lit(3.1)).alias("start"), (F.col("seg_idx") * F.lit(3.1) + F.lit(2.5)).alias("end"), text.alias("text"))
    return S.import_subtitles(subs, ["unit", "seg_idx"])


@query("s05_import_faces", sql(SHOTS, FACES, then="""
select f.episode, shot_idx, frame_ms, x, y, w, h from faces f join shots s on s.episode = f.episode and frame_ms >= s.start_ms and frame_ms < s.end_ms"""))
def _(s, d):
    path = _path(s, "faces")
    A.faces(s, d).select("episode", "frame_ms", "x", "y", "w", "h").write.csv(path, sep="\t")
    return S.import_faces(s, path, A.shots(s, d).select("episode", "shot_idx", "start_ms", "end_ms")).select("episode", "shot_idx", "frame_ms", "x", "y", "w", "h")


@query("s06_import_music", sql(SHOTS, MUSIC, then="""
, v as (select episode, row_number() over (partition by episode order by pos_ms, music_id) - 1 as i, rate from music),
p as (select *, episode * 86400000::bigint + 23 + i * 900000 as pos_ms from v)
select p.episode, shot_idx, pos_ms - p.episode * 86400000::bigint as pos_ms, round(rate, 6) as rate from p join shots s on s.episode = p.episode and pos_ms >= s.start_ms and pos_ms < s.end_ms"""))
def _(s, d):
    from turnloom.plans.ordered import row_index, time_block

    v = row_index(A.music(s, d), ["episode"], ["pos_ms", "music_id"], time_block("pos_ms"), "i").select("episode", (F.col("i") - 1).alias("i"), "rate")
    day = F.col("episode") * F.lit(86_400_000).cast("long")
    sh = A.shots(s, d).select("episode", "shot_idx", (F.col("start_ms") - day).alias("start_ms"), (F.col("end_ms") - day).alias("end_ms"))
    return S.import_music(v, sh, 44100.0, 2048, 39_690_000).select("episode", "shot_idx", "pos_ms", F.round("rate", 6).alias("rate"))


@query("s07_attach_vectors", sql(SPEECH, VECTORS, then="""
, k as (select *, row_number() over (order by season, episode, start_ms, seg_idx) - 1 as row_id from known),
w as (select season, episode from k left join vectors v on v.row_id = k.row_id group by 1, 2 having count(*) = count(v.row_id))
select seg_idx, row_id, speaker, label from k join vectors using (row_id) join w using (season, episode)"""))
def _(s, d):
    return S.attach_vectors(A.speech(s, d), A.vectors(s, d).select("row_id", "label")).select("seg_idx", "row_id", "speaker", "label")


@query("s07_vector_counts", sql(SPEECH, VECTORS, then="select (select count(*) from known) as segments, (select count(*) from vectors) as rows, (select count(*) from known) = (select count(*) from vectors) as agree"))
def _(s, d):
    return S.vector_counts(A.speech(s, d), A.vectors(s, d))


@query("s08_sample_shot_positions", sql(SHOTS, then="""
, p as (select episode, shot_idx, start_ms, unnest([0, 1, 2, 3, 4]) as j, end_ms - 40 - start_ms as dur from shots),
q as (select episode, shot_idx, start_ms, j, case when j = 0 then start_ms else cast(floor((start_ms + j * (dur / 4.0::double)) / 40 + 0.5) * 40 as bigint) end as pos_ms from p)
select distinct episode, shot_idx, pos_ms from q where j = 0 or pos_ms > start_ms"""))
def _(s, d):
    path = _path(s, "positions")
    S.sample_shot_positions(A.shots(s, d).select("episode", "shot_idx", "start_ms", "end_ms")).write.csv(path)
    return s.read.schema("episode int, shot_idx bigint, pos_ms bigint").csv(path)


def _with_ref(s, d):
    e = scene_edges(s, d)
    return e.select(S.scene_code("series", (F.col("scene") / 24).cast("int"), "scene").alias("scene_ref"), "src", "dst", "weight")


@query("s09_export_graphml", sql(SPEECH, SE, then="""
, r as (select printf('S%02dE%02d_%03d', series, scene // 24, scene) as scene_ref, * from se where weight > 0)
select scene_ref, count(*) as edges, (select count(distinct v) from (select unnest([src, dst]) as v from r q where q.scene_ref = r.scene_ref)) as nodes from r group by 1"""))
def _(s, d):
    path = _path(s, "graphml")
    S.export_graphml(_with_ref(s, d), path)
    return s.read.text(path).groupBy("scene_ref").agg(F.count_if(F.col("value").contains("<node")).alias("nodes"), F.count_if(F.col("value").contains("<edge")).alias("edges"))


@query("s10_export_pajek", sql(SPEECH, SE, then="""
, e as (select src, dst, round(sum(weight) * 60, 3) as weight from se group by 1, 2),
v as (select label, row_number() over (order by label) as id from (select src as label from e union select dst from e))
select printf('*Vertices %d', count(*)) as value from v union all select printf('%d "%s"', id, label) from v
union all select printf('*Edges %d', count(distinct src)) from e
union all select printf('%d %d %.4f', a.id, b.id, weight) from e join v a on a.label = src join v b on b.label = dst"""))
def _(s, d):
    path = _path(s, "pajek")
    S.export_pajek(scene_edges(s, d).groupBy("src", "dst").agg(F.round(F.sum("weight") * 60, 3).alias("weight")), path)
    return s.read.text(path)


@query("s11_export_summary", sql(SHOTS, then="""
, x as (select episode, start_ms, end_ms from shots where source = 'Both'),
f as (select *, max(end_ms) over (partition by episode order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as b from x),
g as (select *, sum(case when b is null or start_ms > b then 1 else 0 end) over (partition by episode order by start_ms, end_ms) as k from f)
select concat('day', episode, '.avi') as fname, round(min(start_ms) / 1000.0, 3) as start_s, round((max(end_ms) - min(start_ms)) / 1000.0, 3) as duration_s from g group by episode, k"""))
def _(s, d):
    path = _path(s, "summary")
    sh = A.shots(s, d)
    eps = sh.select("episode").distinct().withColumn("fname", F.concat(F.lit("day"), F.col("episode").cast("string"), F.lit(".avi")))
    S.export_summary(merge_summary(sh.where("source = 'Both'").select("episode", "start_ms", "end_ms")), eps, path)
    r = s.read.schema("fname string, start_s double, duration_s double").csv(path, sep="\t")
    return r.select("fname", F.round("start_s", 3).alias("start_s"), F.round("duration_s", 3).alias("duration_s"))


@query("s12_read_stoplist", sql(then=r"""
select distinct term from (select unnest(string_split(trim(regexp_replace(regexp_replace(lower(regexp_replace(replace(replace(replace(replace(regexp_replace(
 replace(replace(replace(l, 'can''t', 'can not'), 'won''t', 'will not'), 'n''t', ' not'), '''', ' ', 'g'), '<i>', ' '), '</i>', ' '), '<br />', ' '), '-', ' '),
 '[,.?!"“_*]', '', 'g')), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')), ' ')) as term from (select unnest(string_split(text, chr(10))) as l from benchmark)) where term <> ''""").replace("with \n", ""))
def _(s, d):
    path = _path(s, "stop")
    A.table(s, d, "benchmark").select("text").write.text(path)
    return S.read_stoplist(s, path)


@query("s13_export_series", sql(SPEECH, SE, then="""
, st as (select series, scene, speaker, sum(weight) as w from en group by 1, 2, 3)
select series, scene, round(coalesce(sum(w) filter (where speaker = 'spk01'), 0), 6) as spk01, round(coalesce(sum(w) filter (where speaker = 'spk02'), 0), 6) as spk02,
 round(coalesce(sum(w) filter (where speaker = 'spk03'), 0), 6) as spk03 from st group by 1, 2"""))
def _(s, d):
    path, who = _path(s, "series"), ["spk01", "spk02", "spk03"]
    S.export_series(N.node_strengths(scene_edges(s, d)), "speaker", "strength", who, path)
    r = s.read.schema("series int, scene bigint, spk01 double, spk02 double, spk03 double").csv(path, sep="\t", header=True)
    return r.select("series", "scene", *[F.round(c, 6).alias(c) for c in who])
