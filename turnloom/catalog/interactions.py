"""Queries for turns, interlocutors and conversation networks."""

from pyspark.sql import functions as F

from turnloom.catalog.ctes import ORDERS, SPEECH, TURNS, sql
from turnloom.catalog.registry import query
from turnloom.functions.columns import overlap_sizes
from turnloom.operators import interactions as I
from turnloom.plans.ordered import neighbours, time_block
from turnloom.sources import adapters as A

GAP = 300_000  # mean distance of events is about 260 s


def turns_cte(src: str, discard: int = 0, out: str = "tn") -> str:
    """Turn table of ``src`` and segments with their turn number."""
    return f"""
{out}0 as (select *, row_number() over (partition by unit order by start_ms desc, seg_idx desc) as rback from {src}),
{out}1 as (select *, case when lag(speaker) over w is distinct from speaker then 1 else 0 end as isnew
   from {out}0 where rback > {discard} window w as (partition by unit order by start_ms, seg_idx)),
{out}_seg as (select *, sum(isnew) over (partition by unit order by start_ms, seg_idx) as turn from {out}1),
{out} as (select unit, turn, min(speaker) as spk, min(start_ms) as t0, arg_max(end_ms, start_ms * 1000000 + seg_idx) as t1, count(*) as n from {out}_seg group by 1, 2)"""


def rules_cte(src: str, gap: int, discard: int = 0, rules: str = "4", out: str = "tn") -> str:
    """Interlocutor of every kept segment; ``rules`` = size of the cumulative rule set."""
    return turns_cte(src, discard, out) + f""",
{out}w as (select *, lag(spk) over w as p1, lag(spk, 2) over w as p2, lead(spk) over w as n1, lead(spk, 2) over w as n2,
   t0 - lag(t1) over w as gp, lead(t0) over w - t1 as gn, (lead(t0) over w + lag(t1) over w) // 2 as lim
   from {out} window w as (partition by unit order by turn)),
{out}_inter as (select s.*, k as rule_set, case
   when p1 is null and n1 is null then null
   when p1 is null then case when gn <= {gap} and k >= 2 then n1 end
   when n1 is null then case when gp <= {gap} and k >= 2 then p1 end
   when p1 = n1 then case when (gp <= {gap} or gn <= {gap}) and k >= 1 then p1 end
   when coalesce(p2 = spk, false) and not coalesce(n2 = spk, false) and gp <= {gap} then case when k >= 3 then p1 end
   when not coalesce(p2 = spk, false) and coalesce(n2 = spk, false) and gn <= {gap} then case when k >= 3 then n1 end
   when k >= 4 then case when (start_ms + end_ms) // 2 <= lim then case when gp <= {gap} then p1 end else case when gn <= {gap} then n1 end end
   end as inter from {out}_seg s join {out}w using (unit, turn) cross join (select unnest([{rules}]) as k))"""


# Reference interlocutor of a segment: the next speaker of the unit, none at its end or for a repeat.
REF = """
kr as (select *, case when nx <> speaker then nx end as ref from
  (select *, lead(speaker) over (partition by unit order by start_ms, seg_idx) as nx from known))"""


def with_ref(df):
    k = neighbours(df, ["unit"], ["start_ms", "seg_idx"], time_block("start_ms"), nxt={"nx": F.col("speaker")})
    ref = F.when(F.col("nx") != F.col("speaker"), F.array("nx")).otherwise(F.array().cast("array<string>"))
    return k.withColumn("inter_ref", ref).drop("nx")


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("w01_speaker_turns", sql(SPEECH, turns_cte("known"), then="""
select unit, turn, spk as speaker, t0 as start_ms, t1 as end_ms, n as segments from tn"""))
def _(s, d):
    return I.speaker_turns(A.known(s, d))


@query("w01_speaker_turns_dialogs", sql(TURNS, turns_cte("turns"), then="""
select unit, turn, spk as speaker, t0 as start_ms, t1 as end_ms, n as segments from tn"""))
def _(s, d):
    return I.speaker_turns(A.turns(s, d))


@query("i01_cooccurrence", sql(SPEECH, then="""
, r as (select *, row_number() over (partition by unit order by start_ms desc, seg_idx desc) as rback from known),
c as (select unit, list_sort(list(distinct speaker)) as cast_ from r where rback > 2 group by 1)
select r.unit, seg_idx, coalesce(array_to_string(case when list_contains(cast_, speaker) then list_filter(cast_, lambda x: x <> speaker) else [] end, ','), '') as inter
from r left join c on r.unit = c.unit"""))
def _(s, d):
    return I.cooccurrence(A.known(s, d), 2).select("unit", "seg_idx", F.array_join("inter", ",").alias("inter"))


@query("i02_sequential", sql(SPEECH, rules_cte("known", GAP), then="select unit, seg_idx, coalesce(inter, '') as inter from tn_inter"))
def _(s, d):
    return I.sequential(A.known(s, d), 0, GAP).select("unit", "seg_idx", F.array_join("inter", ",").alias("inter"))


@query("i02_sequential_dialogs", sql(TURNS, rules_cte("turns", 1000, 1), then="""
select unit, seg_idx, coalesce(inter, '') as inter from tn_inter union all select unit, seg_idx, '' from tn0 where rback <= 1"""))
def _(s, d):
    return I.sequential(A.turns(s, d), 1, 1000).select("unit", "seg_idx", F.array_join("inter", ",").alias("inter"))


@query("i03_speaker_network", sql(SPEECH, rules_cte("known", GAP), then="""
select speaker as src, inter as dst, cast(count(distinct unit) as double) as weight from tn_inter where inter is not null group by 1, 2"""))
def _(s, d):
    return I.speaker_network(I.sequential(A.known(s, d), 0, GAP))


@query("i04_utterance_network", sql(SPEECH, rules_cte("known", GAP), then="""
select speaker as src, inter as dst, round(sum(end_ms - start_ms) / 1000.0, 6) as weight from tn_inter where inter is not null group by 1, 2"""))
def _(s, d):
    return _r(I.utterance_network(I.sequential(A.known(s, d), 0, GAP)), "weight")


@query("i05_cooccurrence_graph", sql(ORDERS, then="""
select a.speaker as src, b.speaker as dst, cast(2 * count(*) as double) as weight
from order_lines a join order_lines b on a.unit = b.unit and a.speaker < b.speaker group by 1, 2"""))
def _(s, d):
    return I.cooccurrence_graph(A.order_lines(s, d))


@query("i06_interaction_graph", sql(SPEECH, rules_cte("known", GAP), then="""
select unit, least(speaker, inter) as src, greatest(speaker, inter) as dst, round(sum(end_ms - start_ms) / 1000.0, 6) as weight
from tn_inter where inter is not null group by 1, 2, 3"""))
def _(s, d):
    return _r(I.interaction_graph(I.sequential(A.known(s, d), 0, GAP), by=["unit"]), "weight")


EVAL = """
seg as (select t.rule_set, t.unit, t.seg_idx, t.speaker, t.end_ms - t.start_ms as ms, t.inter as hyp, kr.ref from tn_inter t join kr on t.seg_idx = kr.seg_idx),
sp as (select rule_set, unit, speaker, list_distinct(list(hyp) filter (where hyp is not null)) as hyp, list_distinct(list(ref) filter (where ref is not null)) as ref from seg group by 1, 2, 3),
rows_ as (
  select 'speaker' as kind, rule_set, coalesce(hyp, []) as hyp, coalesce(ref, []) as ref from sp
  union all select 'utterance', rule_set, case when hyp is null then [] else [hyp] end, case when ref is null then [] else [ref] end from seg),
ev_ as (select kind, rule_set, hyp, case when len(ref) = 0 then ['NULL'] else ref end as ref from rows_ where len(hyp) > 0),
sc as (select kind, rule_set, count(*) as evaluated, avg(len(list_intersect(hyp, ref)) / len(hyp)) as p, avg(len(list_intersect(hyp, ref)) / len(ref)) as r,
   avg(len(list_intersect(hyp, ref)) / len(list_distinct(list_concat(hyp, ref)))) as a from ev_ group by 1, 2),
nt as (select 'speaker' as kind, 'h' as side, rule_set, speaker as src, hyp as dst, count(distinct unit) as w from seg where hyp is not null group by 3, 4, 5
  union all select 'speaker', 'r', rule_set, speaker, ref, count(distinct unit) from seg where ref is not null group by 3, 4, 5
  union all select 'utterance', 'h', rule_set, speaker, hyp, sum(ms) / 1000.0 from seg where hyp is not null group by 3, 4, 5
  union all select 'utterance', 'r', rule_set, speaker, ref, sum(ms) / 1000.0 from seg where ref is not null group by 3, 4, 5),
al as (select kind, rule_set, src, dst, coalesce(sum(w) filter (where side = 'h'), 0) as a, coalesce(sum(w) filter (where side = 'r'), 0) as b from nt group by 1, 2, 3, 4),
sm as (select kind, rule_set, sum(a * b) / sqrt(sum(a * a)) / sqrt(sum(b * b)) as cosine, avg(case when a * b <> 0 then 1.0 else 0.0 end) as jaccard from al group by 1, 2),
ct as (select rule_set, count(*) as n_seg, count(distinct unit * 100 + cast(right(speaker, 2) as int)) as n_spk from seg group by 1)"""
EVAL_OUT = """
round(p, 6) as "precision", round(r, 6) as recall, round(a, 6) as accuracy,
 round(case when p + r > 0 then 2 * p * r / (p + r) end, 6) as f_score,
 round(case when kind = 'speaker' then n_spk / n_seg else evaluated / n_seg end, 6) as coverage, round(cosine, 6) as cosine,
 round(sqrt(greatest(2 - 2 * cosine, 0)), 6) as l2, round(jaccard, 6) as jaccard
from sc join sm using (kind, rule_set) join ct using (rule_set)"""
SCORES = ("precision", "recall", "accuracy", "f_score", "coverage", "cosine", "l2", "jaccard")


@query("i07_evaluate_interactions", sql(SPEECH, REF, rules_cte("known", GAP), EVAL, then="select kind," + EVAL_OUT))
def _(s, d):
    return _r(I.evaluate_interactions(I.sequential(with_ref(A.known(s, d)), 0, GAP)), *SCORES)


@query("i08_set_overlap", sql(SPEECH, REF, rules_cte("known", GAP), then="""
select t.seg_idx, case when inter = ref then 1 else 0 end as n_both,
 case when inter is null and ref is null then 0 when inter is null or ref is null or inter = ref then 1 else 2 end as n_either
from tn_inter t join kr using (seg_idx)"""))
def _(s, d):
    both, either = overlap_sizes(F.col("inter"), F.col("inter_ref"))
    return I.sequential(with_ref(A.known(s, d)), 0, GAP).select("seg_idx", both.alias("n_both"), either.alias("n_either"))


@query("i09_network_similarity", sql(SPEECH, rules_cte("known", GAP), then="""
, n as (select episode, least(speaker, inter) as src, greatest(speaker, inter) as dst, sum(end_ms - start_ms) / 1000.0 as a, count(*) * 1.0 as b
   from tn_inter where inter is not null group by 1, 2, 3),
g as (select episode, sum(a * b) / sqrt(sum(a * a)) / sqrt(sum(b * b)) as c, avg(case when a * b <> 0 then 1.0 else 0.0 end) as j from n group by 1)
select episode, round(c, 6) as cosine, round(sqrt(greatest(2 - 2 * c, 0)), 6) as l2, round(j, 6) as jaccard from g"""))
def _(s, d):
    seg = I.sequential(A.known(s, d), 0, GAP)
    dur = I.utterance_network(seg, by=["episode"])
    cnt = I.utterance_network(seg, by=["episode"], counts=True)
    return _r(I.network_similarity(dur, cnt, directed=False, by=["episode"]), "cosine", "l2", "jaccard")


@query("i10_interaction_errors", sql(SPEECH, REF, rules_cte("known", GAP), then="""
, net as (select speaker, ref from kr where ref is not null group by 1, 2 having sum(end_ms - start_ms) > 0)
select t.seg_idx, t.speaker, t.inter as dst, net.ref is null as misleading from tn_inter t join kr using (seg_idx)
left join net on net.speaker = t.speaker and net.ref = t.inter where t.inter is not null and t.inter is distinct from kr.ref"""))
def _(s, d):
    k = with_ref(A.known(s, d))
    return I.interaction_errors(I.sequential(k, 0, GAP), I.utterance_network(k, "inter_ref")).select("seg_idx", "speaker", "dst", "misleading")


@query("i11_networks_by", sql(SPEECH, rules_cte("known", GAP), then="""
select season, episode, speaker as src, inter as dst, round(sum(end_ms - start_ms) / 1000.0, 6) as weight from tn_inter where inter is not null group by 1, 2, 3, 4"""))
def _(s, d):
    return _r(I.networks_by(I.sequential(A.known(s, d), 0, GAP), ["season", "episode"]), "weight")


@query("i12_rule_ablation", sql(SPEECH, REF, rules_cte("known", GAP, 0, "1, 2, 3, 4"), EVAL, then="select kind, rule_set," + EVAL_OUT))
def _(s, d):
    k = I.rule_ablation(with_ref(A.known(s, d)), 0, GAP)
    return _r(I.evaluate_interactions(k, by=["rule_set"]), *SCORES)
