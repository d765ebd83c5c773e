"""The adapters of ``turnloom.sources.adapters`` as DuckDB CTEs."""

MS = "(epoch_us(ts) // 1000 - 1704067200000)"

SPEECH = f"""
ev as (select event_id, {MS} as start_ms, value, event_type, user_id from events),
ev1 as (select event_id as seg_idx, start_ms, value,
    case event_type when 'error' then '' when 'signup' then 'S'
      else concat('spk', lpad(cast(user_id % 12 as varchar), 2, '0')) end as speaker,
    cast(floor(start_ms / 86400000.0) as int) as episode, cast(floor(start_ms / 3600000.0) as int) as unit from ev),
speech as (select cast(floor(episode / 7.0) as int) as season, episode, unit, seg_idx, speaker, start_ms,
    least(start_ms + cast(round(1000 * value) as bigint),
          coalesce(lead(start_ms) over (partition by episode order by start_ms, seg_idx), (episode + 1) * cast(86400000 as bigint))) as end_ms
    from ev1),
known as (select * from speech where speaker not in ('', 'S'))"""

TURNS = """
turns as (select conv_id as unit, turn as seg_idx, role as speaker,
    cast(sum(60 * length(text)) over (partition by conv_id order by turn) - 60 * length(text) as bigint) as start_ms,
    cast(sum(60 * length(text)) over (partition by conv_id order by turn) as bigint) as end_ms from conversations)"""

ORDERS = """
order_lines as (select l_orderkey as unit, cast(year(o_orderdate) * 12 + month(o_orderdate) - 23941 as int) as month_idx, n_name as speaker, count(*) as n
    from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
    group by 1, 2, 3)"""

VECTORS = """
vectors as (select vec_id as row_id, cast(embedding as double[]) as x, cast(label as varchar) as label,
    cast(vec_id // 20 as int) as unit, cast(vec_id % 20 as int) as pos from embeddings)"""

FRAMES = """
frames as (select cast(vec_id // 100 as int) as video, cast(vec_id % 100 as int) as frame_idx,
    list_transform(cast(embedding as double[]), lambda v: abs(v)) as hist from embeddings)"""

LINES = r"""
ln0 as (select doc_id as unit, source, string_split(text, chr(10)) as parts from documents),
lines as (select unit, source, unnest(range(len(parts))) as seg_idx, unnest(parts) as text from ln0)"""

SHOTS = f"""
sv as (select event_id as shot_id, {MS} as start_ms, user_id, cast(floor({MS} / 86400000.0) as int) as episode from events where event_type = 'view'),
shots as (select episode, cast(floor(start_ms / 3600000.0) as int) as scene_idx,
    row_number() over (partition by episode order by start_ms, shot_id) as shot_idx, shot_id, start_ms,
    coalesce(lead(start_ms) over (partition by episode order by start_ms, shot_id), (episode + 1) * cast(86400000 as bigint)) as end_ms,
    cast(user_id % 8 as int) as cam_manual,
    cast(case when shot_id % 5 = 0 then (user_id + 1) % 8 else user_id % 8 end as int) as cam_auto,
    case shot_id % 3 when 0 then 'Both' when 1 then 'Manual' else 'Automatic' end as source from sv)"""

FACES = f"""
faces as (select cast(floor({MS} / 86400000.0) as int) as episode, cast(floor({MS} / 240000.0) as bigint) * 240000 as frame_ms,
    event_id as face_idx, cast(floor(value) as int) as x, cast(floor(value * 2) as int) as y,
    cast(10 + cast(floor(value) as bigint) % 50 as int) as w, cast(20 + cast(floor(value * 10) as bigint) % 200 as int) as h
    from events where event_type = 'click')"""

MUSIC = f"""
music as (select cast(floor({MS} / 86400000.0) as int) as episode, {MS} as pos_ms, event_id as music_id, value / 491 as rate
    from events where event_type = 'purchase')"""


def sql(*ctes: str, then: str) -> str:
    """``with`` the given CTEs, then the query."""
    return "with " + ",\n".join(c.strip() for c in ctes) + "\n" + then.strip()
