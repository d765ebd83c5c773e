"""Queries for ordered segments, shots, frames and text."""

from pyspark.sql import functions as F

from turnloom.catalog.ctes import FRAMES, LINES, SHOTS, SPEECH, sql
from turnloom.catalog.filters import EDGES, episode_edges
from turnloom.catalog.registry import query
from turnloom.functions.text import preprocess, tokens
from turnloom.operators import sequences as S
from turnloom.operators import text as T
from turnloom.plans.ordered import row_index
from turnloom.plans.products import class_pairs, membership
from turnloom.session import cut
from turnloom.sources import adapters as A

H = 3_600_000


@query("w02_merge_close", sql(SPEECH, then="""
, f as (select *, case when lag(speaker) over w is distinct from speaker or start_ms - lag(end_ms) over w > 400000 then 1 else 0 end as n
   from speech window w as (partition by episode order by start_ms, seg_idx)),
g as (select *, sum(n) over (partition by episode order by start_ms, seg_idx) as island from f)
select episode, min(speaker) as speaker, min(start_ms) as start_ms, arg_max(end_ms, start_ms * 100000 + seg_idx) as end_ms, count(*) as segments
from g group by episode, island"""))
def _(s, d):
    return S.merge_close(A.speech(s, d), gap=400_000)


PRE = r"""lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(
 text, 'can''t', 'can not'), 'won''t', 'will not'), 'n''t', ' not'), '''', ' ', 'g'), '<i>|</i>|<br />', ' ', 'g'), '-', ' ', 'g'),
 '[,.?!"“_*]', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'))"""


def timed_lines(s, d):
    ln = A.lines(s, d).withColumn("start_ms", F.col("seg_idx").cast("long") * 5000)
    return ln.withColumn("end_ms", F.col("start_ms") + 37 * F.length("text"))


@query("w03_speech_rate", sql(LINES, then=f"""
, p as (select unit, seg_idx * 5000 as st, 37 * length(text) as dur, length(replace({PRE}, ' ', '')) as n from lines),
ch as (select unit, st + (unnest(range(n)) * dur) // n as ts from p where n > 0),
top as (select unit, max(ts) as last_ts from ch group by 1),
g as (select unit, unnest(range((last_ts + 750) // 500 + 2)) * 500 as t from top),
near as (select unit, ts, unnest(range(greatest((ts - 750 + 499) // 500, 0), (ts + 750) // 500 + 1)) * 500 as t from ch),
c as (select unit, t, count(*) as c from near where ts >= t - 750 and ts <= t + 750 group by 1, 2),
r as (select unit, g.t, coalesce(c, 0) * 1000.0 / 1500 as rate from g left join c using (unit, t))
select unit, t, round(rate, 6) as rate, round(rate / max(rate) over (partition by unit), 6) as share from r"""))
def _(s, d):
    r = S.speech_rate(timed_lines(s, d), ["unit"])
    return r.select("unit", "t", F.round("rate", 6).alias("rate"), F.round("share", 6).alias("share"))


def block_sql(ids: str, src: str, out: str) -> str:
    """Mean block distance of ``src(ids, a, b)``: four blocks of 16 bins, correlation."""
    return f"""
{out}_u as (select {ids}, unnest(range(64)) as p, unnest(a) as x, unnest(b) as y from {src}),
{out}_g as (select {ids}, p // 16 as blk, (sum(x * y) - sum(x) * sum(y) / 16) / sqrt((sum(x * x) - sum(x) * sum(x) / 16) * (sum(y * y) - sum(y) * sum(y) / 16)) as c
   from {out}_u group by {ids}, p // 16),
{out} as (select {ids}, 1 - avg(abs(c)) as d from {out}_g group by {ids})"""


@query("w04_detect_cuts", sql(FRAMES, then="""
, pr as (select video, frame_idx, hist as a, lag(hist) over (partition by video order by frame_idx) as b from frames),
pq as (select * from pr where b is not null),""" + block_sql("video, frame_idx", "pq", "bd") + """,
w as (select video, frame_idx, d as d2, lag(d) over o as d1, lag(d, 2) over o as d0 from bd window o as (partition by video order by frame_idx)),
st as (select video, frame_idx - 1 as start_frame from w where d0 <= 0.80 and d1 >= 0.80 and d2 <= 0.80 union all select distinct video, 0 from frames),
en as (select video, max(frame_idx) + 1 as e from frames group by 1)
select video, start_frame, coalesce(lead(start_frame) over (partition by video order by start_frame), e) as end_frame from st join en using (video)"""))
def _(s, d):
    return S.detect_cuts(A.frames(s, d), 4, 0.80, 0.80)


SHOT_HIST = """
sh as (select video, frame_idx // 2 as shot_idx, max(hist) filter (where frame_idx % 2 = 0) as first_hist, max(hist) filter (where frame_idx % 2 = 1) as last_hist
   from frames group by 1, 2)"""


def shot_hists(s, d):
    pick = lambda k: F.max(F.when(F.col("frame_idx") % 2 == k, F.col("hist")))
    return A.frames(s, d).groupBy("video", F.expr("frame_idx div 2").cast("int").alias("shot_idx")).agg(pick(0).alias("first_hist"), pick(1).alias("last_hist"))


@query("w05_label_recurring", sql("""
recursive_dummy as (select 1),""" + FRAMES, SHOT_HIST, then="""
, pr as (select i.video, i.shot_idx as i, j.shot_idx as j, i.first_hist as a, j.last_hist as b from sh i join sh j on i.video = j.video
  and i.shot_idx - j.shot_idx between 1 and 5),""" + block_sql("video, i, j", "pr", "bd") + """,
best as (select video, i, arg_min(j, d * 1000 - j * 1e-9) as p from bd where d <= 0.72 group by 1, 2),
lk as (select sh.video, shot_idx as i, coalesce(p, shot_idx) as p from sh left join best on best.video = sh.video and best.i = sh.shot_idx),
up as (select video, i, p, 0 as depth from lk union all select up.video, up.i, lk.p, depth + 1 from up join lk on lk.video = up.video and lk.i = up.p where lk.p <> up.p)
select video, i as shot_idx, arg_max(p, depth) as camera from up group by 1, 2""").replace("with recursive_dummy as (select 1),", "with recursive"))
def _(s, d):
    return S.label_recurring(shot_hists(s, d), 0.72, 5, 4)


@query("w06_extract_lsus", sql(SHOTS, then="""
, cm as (select episode, cam_manual, min(shot_idx) as a, max(shot_idx) as b from shots group by 1, 2),
ins as (select s.episode, s.shot_idx from shots s where exists (select 1 from cm where cm.episode = s.episode and a < s.shot_idx and b > s.shot_idx)),
g as (select *, shot_idx - row_number() over (partition by episode order by shot_idx) as k from ins),
u as (select episode, min(shot_idx) - 1 as first_shot, max(shot_idx) + 1 as last_shot from g group by episode, k)
select u.*, a.start_ms, b.end_ms from u join shots a on a.episode = u.episode and a.shot_idx = first_shot join shots b on b.episode = u.episode and b.shot_idx = last_shot"""))
def _(s, d):
    return S.extract_lsus(A.shots(s, d))


# Windows of at most two hours from every shot; units of half an hour at least.
WIN = f"""
win as (select a.episode, a.shot_idx as f, a.start_ms, max(b.shot_idx) as l from shots a join shots b on a.episode = b.episode and b.shot_idx >= a.shot_idx
   and b.end_ms - a.start_ms <= {2 * H} group by 1, 2, 3 having max(b.shot_idx) > a.shot_idx)"""


@query("w06_extract_lsus_bounded", sql(SHOTS, WIN, then=f"""
, wc as (select w.episode, w.f, cam_manual, min(shot_idx) as a, max(shot_idx) as b from win w join shots s on s.episode = w.episode and shot_idx between w.f and w.l group by 1, 2, 3),
op as (select w.episode, w.f, s.shot_idx, s.start_ms, s.end_ms from win w join shots s on s.episode = w.episode and s.shot_idx between w.f and w.l
   where not exists (select 1 from wc where wc.episode = w.episode and wc.f = w.f and wc.a < s.shot_idx and wc.b > s.shot_idx)),
nx as (select *, lead(shot_idx) over o as n, lead(end_ms) over o as e from op window o as (partition by episode, f order by shot_idx))
select distinct episode, shot_idx as first_shot, n as last_shot, start_ms, e as end_ms from nx where n - shot_idx >= 2 and e - start_ms >= {H // 2}"""))
def _(s, d):
    return S.extract_bounded_lsus(A.shots(s, d), H // 2, 2 * H)


@query("w06_extract_lsus_nested", sql(SHOTS, WIN, then=f"""
, pr as (select w.episode, w.f, e.shot_idx as l, w.start_ms, e.end_ms from win w join shots e on e.episode = w.episode and e.shot_idx between w.f + 2 and w.l),
pc as (select p.episode, p.f, p.l, cam_manual, min(shot_idx) as a, max(shot_idx) as b from pr p join shots s on s.episode = p.episode and shot_idx between p.f and p.l group by 1, 2, 3, 4),
hole as (select distinct p.episode, p.f, p.l from pr p join shots m on m.episode = p.episode and m.shot_idx > p.f and m.shot_idx < p.l
  where not exists (select 1 from pc where pc.episode = p.episode and pc.f = p.f and pc.l = p.l and pc.a < m.shot_idx and pc.b > m.shot_idx))
select episode, f as first_shot, l as last_shot, start_ms, end_ms from pr where end_ms - start_ms >= {H // 2}
 and not exists (select 1 from hole h where h.episode = pr.episode and h.f = pr.f and h.l = pr.l)"""))
def _(s, d):
    return S.extract_bounded_lsus(A.shots(s, d), H // 2, 2 * H, nested=True)


@query("w07_merge_summary", sql(SHOTS, then="""
, x as (select episode, start_ms, end_ms from shots where source <> 'Manual'),
f as (select *, max(end_ms) over (partition by episode order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as b from x),
g as (select *, sum(case when b is null or start_ms > b then 1 else 0 end) over (partition by episode order by start_ms, end_ms) as k from f)
select episode, min(start_ms) as start_ms, max(end_ms) as end_ms from g group by episode, k"""))
def _(s, d):
    return S.merge_summary(A.shots(s, d).where("source <> 'Manual'").select("episode", "start_ms", "end_ms"))


@query("w08_fill_scene_refs", sql(SPEECH, then="""
, u as (select unit as scene, max(season) filter (where speaker = 'spk01') as season, max(episode) filter (where speaker = 'spk01') as episode from speech group by 1)
select scene, last_value(season ignore nulls) over (order by scene) as season, last_value(episode ignore nulls) over (order by scene) as episode from u"""))
def _(s, d):
    here = F.col("speaker") == "spk01"
    u = A.speech(s, d).groupBy(F.col("unit").alias("scene")).agg(F.max(F.when(here, F.col("season"))).alias("season"), F.max(F.when(here, F.col("episode"))).alias("episode"))
    return S.fill_scene_refs(u)


@query("w09_occurrences", sql(SPEECH, EDGES, then="""
select src as a, dst as b, scene, round(sum(weight), 6) as weight from edges group by 1, 2, 3
union all select a, null, scene, round(sum(weight), 6) from (select unnest([src, dst]) as a, scene, weight from edges) group by 1, 3"""))
def _(s, d):
    return S.occurrences(episode_edges(s, d)).withColumn("weight", F.round("weight", 6))


# ---- text -----------------------------------------------------------------

TOK = f"""
pt as (select unit, source, seg_idx, {PRE} as txt from lines),
tk as (select unit, source, seg_idx, unnest(string_split(txt, ' ')) as term from pt where txt <> ''),
st as (select distinct {PRE} as term from (select unnest(string_split(text, ' ')) as text from benchmark) where length({PRE}) between 1 and 3),
tc as (select unit, source, seg_idx, term, count(*) as n from tk where term not in (select term from st) group by 1, 2, 3, 4),
ut as (select unit, source, term, cast(sum(n) as bigint) as n from tc group by 1, 2, 3),
nn as (select count(distinct unit) as total from lines),
idf as (select term, count(distinct unit) as df, ln((select total from nn) / count(distinct unit)) as idf from ut group by 1),
wv as (select unit, source, term, n * idf as w from ut join idf using (term) where idf > 0)"""


def stop_words(s, d):
    """Words of up to three letters of the benchmark texts."""
    w = A.table(s, d, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).select(preprocess("w").alias("term"))
    return w.where(F.length("term").between(1, 3)).distinct()


def _lines(s, d):
    """Lines laid out by document: words are then counted where they lie, per line and per document, and texts are all that is shuffled."""
    return A.lines(s, d).repartition("unit")


def _counts(s, d):
    return T.term_counts(_lines(s, d), stop_words(s, d), ["unit", "source", "seg_idx"])


def _unit_counts(s, d):
    """Words per document at once, used several times."""
    return cut(T.term_counts(_lines(s, d), stop_words(s, d), ["unit"]))


def _units(s, d):
    u = A.table(s, d, "documents").select(F.col("doc_id").alias("unit"), "source")
    return row_index(u, ["source"], ["unit"], F.floor(F.col("unit") / 4096), "pos")


@query("t01_preprocess", sql(LINES, then=f"select unit, seg_idx, {PRE} as txt from lines"))
def _(s, d):
    return A.lines(s, d).select("unit", "seg_idx", preprocess("text").alias("txt"))


@query("t02_tokens", sql(LINES, then=f"""
select unit, seg_idx, unnest(range(len(t))) as pos, unnest(t) as token
from (select unit, seg_idx, string_split({PRE}, ' ') as t from lines where {PRE} <> '')"""))
def _(s, d):
    return A.lines(s, d).select("unit", "seg_idx", F.posexplode(tokens(preprocess("text"))).alias("pos", "token"))


@query("t03_term_counts", sql(LINES, TOK, then="select unit, seg_idx, term, n from tc"))
def _(s, d):
    return _counts(s, d).select("unit", "seg_idx", "term", "n")


@query("t04_unit_terms", sql(LINES, TOK, then="select unit, term, n from ut"))
def _(s, d):
    return T.unit_terms(_counts(s, d))


@query("t05_idf", sql(LINES, TOK, then="select term, df, round(idf, 6) as idf from idf"))
def _(s, d):
    return T.idf(_unit_counts(s, d), A.table(s, d, "documents").select(F.col("doc_id").alias("unit"))).withColumn("idf", F.round("idf", 6))


@query("t06_tfidf_cosine", sql(LINES, TOK, then="""
, nm as (select unit, sqrt(sum(w * w)) as norm from wv group by 1),
pr as (select distinct doc_id as unit1, doc_id + 1 as unit2 from labels),
pd as (select unit1, unit2, sum(a.w * b.w) as p from pr join wv a on a.unit = unit1 join wv b on b.unit = unit2 and b.term = a.term group by 1, 2)
select unit1, unit2, round(coalesce(p / (x.norm * y.norm), 0), 6) as cosine from pr left join pd using (unit1, unit2)
left join nm x on x.unit = unit1 left join nm y on y.unit = unit2"""))
def _(s, d):
    ut = _unit_counts(s, d)
    pairs = A.table(s, d, "labels").select(F.col("doc_id").alias("unit1"), (F.col("doc_id") + 1).alias("unit2"))
    v = T.weighted(ut, T.idf(ut, A.table(s, d, "documents").select(F.col("doc_id").alias("unit"))))
    return T.tfidf_cosine(pairs, v).withColumn("cosine", F.round("cosine", 6))


ALL = """
us as (select *, row_number() over (partition by source order by unit) as pos from (select distinct unit, source from lines)),
nm as (select unit, sqrt(sum(w * w)) as norm from wv group by 1),
id as (select unit, string_agg(term || ':' || n::varchar, ' ' order by term) as words from ut join idf using (term) where idf > 0 group by 1),
cl as (select us.unit, us.source, pos, min(pos) over (partition by us.source, words) as rep, count(*) over (partition by us.source, words) as size
  from us join id using (unit)),
pr as (select a.source, a.pos as i, b.pos as j, a.unit as u1, b.unit as u2, a.size as n_i, b.size as n_j from cl a join cl b
  on a.source = b.source and b.pos > a.pos where a.pos = a.rep and b.pos = b.rep),
pd as (select u1, u2, sum(a.w * b.w) as p from pr join wv a on a.unit = u1 join wv b on b.unit = u2 and b.term = a.term group by 1, 2),
sm as (select source, i, j, n_i, n_j, p / (x.norm * y.norm) as cosine from pr join pd using (u1, u2)
  join nm x on x.unit = u1 join nm y on y.unit = u2"""
US = ALL + " where round(p / (x.norm * y.norm), 9) >= 0.3)"


def _lexical(s, d):
    ut, u = _unit_counts(s, d), _units(s, d)
    return ut.join(u, "unit"), T.idf(ut, u), u


@query("t07_lexical_similarity", sql(LINES, TOK, ALL + ")", then="""
select source, i, j, n_i, n_j, round(cosine, 6) as cosine from sm
union all select source, rep as i, pos as j, size as n_i, size as n_j, 1.0 as cosine from cl where size > 1"""))
def _(s, d):
    """All pairs of classes of equal documents with a common word, and each class of several with all its members."""
    terms, weights, _ = _lexical(s, d)
    pairs, members = T.lexical_similarity(terms, weights)
    both = class_pairs(pairs, members, ["source"], "pos").unionByName(membership(members, ["source"], "pos"))
    return both.withColumn("cosine", F.round("cosine", 6))


@query("t07_lexical_links", sql(LINES, TOK, US, then="""
, ends as (select source, i as rep, n_j as n from sm union all select source, j, n_i from sm),
ns as (select source, rep, sum(n) as n from ends group by 1, 2)
select us.source, us.pos, coalesce(cl.rep, us.pos) as class, cast(coalesce(cl.size - 1 + coalesce(n, 0), 0) as bigint) as near,
  cast(count(*) over (partition by us.source) - 1 - coalesce(cl.size - 1 + coalesce(n, 0), 0) as bigint) as far
from us left join cl using (unit) left join ns on ns.source = cl.source and ns.rep = cl.rep"""))
def _(s, d):
    terms, weights, units = _lexical(s, d)
    return T.lexical_links(terms, weights, units, 0.3)
