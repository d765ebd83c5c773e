"""DuckDB SQL of the operators that SQL can express."""

MINHASH_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select distinct doc_id, sh from (
    select doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
      else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) end) as sh from w)),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
sym as (select a, b from e union select b, a from e),
reach(a, b) as (select a, b from sym union select r.a, t.b from reach r join sym t on r.b = t.a),
low as (select a as doc_id, least(a, min(b)) as c from reach group by a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(low.c, w.doc_id) as component_id, coalesce(low.c, w.doc_id) = w.doc_id as kept
from w left join n using (doc_id) left join low using (doc_id)
"""

MIXING_SQL = r"""
with recursive d as (
  select doc_id, source, cast(ceil(coalesce(length(text), 0) / 4.0) as bigint) as n,
    md5(coalesce(doc_id::varchar, '')) as key from documents),
b as (select source, substr(key, 1, 3) as block, sum(n)::bigint as n from d group by all),
t as (select source, sum(n)::bigint as tokens from b group by source having sum(n) > 0),
a as (select sum(tokens)::bigint as total, count(*) as k, list(tokens::double order by source) as ts from t),
p as (select total, k, list_transform(ts, lambda x: x / total::double) as ps from a),
e(i, lo, hi) as (
  select 0, 0.0::double, 1.0::double union all
  select i + 1,
    case when h >= 0.95 * ln(k) then mid else lo end, case when h >= 0.95 * ln(k) then hi else mid end
  from (select i, lo, hi, mid, k, ln(z) - mid * s / z as h from (
      select i, lo, hi, mid, k, list_sum(list_transform(ps, lambda x: pow(x, mid))) as z,
        list_sum(list_transform(ps, lambda x: pow(x, mid) * ln(x))) as s
      from (select i, lo, hi, (lo + hi) / 2 as mid from e where i < 25), p))),
r(i, lo, hi) as (
  select 0, 0.0::double, 1.0::double union all
  select i + 1, case when m > 4.0 then mid else lo end, case when m > 4.0 then hi else mid end
  from (select i, lo, hi, mid, list_max(list_transform(ps, lambda x: pow(x, mid) / x))
               / list_sum(list_transform(ps, lambda x: pow(x, mid))) as m
        from (select i, lo, hi, (lo + hi) / 2 as mid from r where i < 25), p)),
x as (select case when k < 2 then 1.0 else greatest(
        case when ln(list_sum(ps)) - list_sum(list_transform(ps, lambda v: v * ln(v))) / list_sum(ps) >= 0.95 * ln(k) then 1.0
          else (select lo from e where i = 25) end,
        case when list_max(list_transform(ps, lambda v: 1 / v)) / k > 4.0 then (select hi from r where i = 25) else 0 end) end as x from p),
wt as (select source, tokens, total, round(pow(tokens / total::double, x) / (select sum(pow(tokens / total::double, x)) from t, a, x), 9) as weight
       from t, a, x),
pl as (select source, tokens, weight, cast(floor(weight * total) as bigint) as due from wt),
pb as (select b.source, b.block, b.n, coalesce(weight, 0) as weight, coalesce(due // tokens, 1) as passes,
    coalesce(due % tokens - coalesce(sum(b.n) over (partition by b.source order by md5(coalesce(b.source, '') || ':' || b.block), b.block
      rows between unbounded preceding and 1 preceding), 0), 0) as room
  from b left join pl on b.source is not distinct from pl.source),
q as (select d.*, pb.weight, pb.passes, pb.room, pb.n as block_n,
    sum(d.n) over (partition by d.source, pb.block order by d.key, d.doc_id rows between unbounded preceding and current row) as upto
  from d join pb on d.source is not distinct from pb.source and substr(d.key, 1, 3) = pb.block)
select doc_id, source, n as n_tokens, weight,
  cast(passes + case when room <= 0 then 0 when room >= block_n then 1 when upto <= room then 1 else 0 end as bigint) as copies
from q
"""

WARC_SQL = r"""
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as x, strlen(coalesce(html, '')) as n from pages),
bits as (select *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
    4 * (strpos('0123456789abcdef', substr(x, i, 1)) - 1) + 1, 4)), '') as b from p),
d as (select page_id, n, h, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(
    list_sum(list_transform(range(1, 6), lambda k: cast(substr(b, cast(5 * i + k as bigint), 1) as int) * (1 << (5 - k)))) as int), 1)), '') as digest from bits),
f as (select *, min(page_id) over (partition by h) as first_id from d)
select page_id, n as payload_bytes, digest as payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from f
"""

EXACT_SQL = r"""
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""

REPAIR_SQL = r"""
with recursive k as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
c as (
  select *, xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length(name) + 1), lambda i: ascii(substr(name, i::int, 1))::bigint)),
    lambda crc, ch: list_reduce(list_concat([xor(crc, ch)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, z: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end))) % 20 as code from k),
d as (
  select conv_id, turn, case when code = 4 then 'user' else role end as role,
    case when code = 1 then '' when code = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case when code = 3 then [1, 2] else [1] end) as copy
  from c where code <> 0),
o as (
  select *, row_number() over (partition by conv_id order by turn nulls first, sha256(length(role)::varchar || ':' || role || text), copy) as pos,
    count(*) over (partition by conv_id) as n,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as seen from d),
r as (
  select *, substr(role, 1, 1) as ini, lead(substr(role, 1, 1)) over (partition by conv_id order by pos) as nxt,
    case when seen = '' then 'blank' when again then 'duplicate' when right(seen, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from o),
-- least costs f0 (nothing yet), f1 (after s), f2 (after u), f3 (after a) before each row, from the last to the first
f as (
  select distinct conv_id, n + 1 as pos, 0 as f0, 6 as f1, 3 as f2, 0 as f3 from r
  union all
  select conv_id, pos, least(b0, 3 + least(b2, 3 + b3)) as f0, least(b1, 3 + least(b2, 3 + b3)) as f1, least(b2, 3 + b3) as f2, least(b3, 3 + b2) as f3
  from (
    select r.conv_id, r.pos,
      least(4 + f0, h + 3 + f2, case ini when 's' then h + f1 when 'u' then h + f2 else 1000000 end) as b0,
      least(4 + f1, h + 3 + f2, case ini when 'u' then h + f2 else 1000000 end) as b1,
      least(4 + f2, h + 3 + f3, case ini when 'a' then h + f3 else 1000000 end) as b2,
      least(4 + f3, h + 3 + f2, case ini when 'u' then h + f2 else 1000000 end) as b3
    from f join (select *, case when fault in ('blank', 'duplicate') then 1000000 when fault = 'truncated' then 3 else 0 end as h from r) r
      on r.conv_id is not distinct from f.conv_id and r.pos = f.pos - 1)),
cost as (select conv_id, pos, [f0, f1, f2, f3] as f from f),
-- forwards along the ASCII-least letter of a cheapest way; place counts from 0
g as (
  select conv_id, 1::bigint as pos, 0 as place, '' as audit, []::varchar[] as done from r where pos = 1
  union all
  select conv_id, case when letter = 'I' then pos else pos + 1 end,
    case when letter = 'D' then place when letter = 'K' and place = 0 and ini = 's' then 1 when place = 2 then 3 else 2 end, audit || letter,
    case letter when 'D' then done when 'K' then list_append(done, role || ':' || text)
      else list_append(done, case when place = 2 then 'assistant' else 'user' end || ':' || case letter when 'R' then text else '' end) end
  from (
    select g.*, r.role, r.text, r.ini,
      case when r.pos is null then 'I' when 4 + b.f[place + 1] = a.f[place + 1] then 'D'
        when 3 + a.f[case when place = 2 then 4 else 3 end] = a.f[place + 1] then 'I'
        when r.fault not in ('blank', 'duplicate') and case when r.fault = 'truncated' then 3 else 0 end +
          case when place = 0 and ini = 's' then b.f[2] when place <> 2 and ini = 'u' then b.f[3] when place = 2 and ini = 'a' then b.f[4] else 1000000 end
          = a.f[place + 1] then 'K' else 'R' end as letter
    from g join cost a on a.conv_id is not distinct from g.conv_id and a.pos = g.pos
      left join cost b on b.conv_id is not distinct from g.conv_id and b.pos = g.pos + 1
      left join r on r.conv_id is not distinct from g.conv_id and r.pos = g.pos
    where r.pos is not null or place in (1, 2))),
e as (select conv_id, max_by(audit, length(audit)) as audit, max_by(done, length(audit)) as done from g group by conv_id),
s as (
  select conv_id, case when count(turn) > 0 then max(turn) - min(turn) + 1 - count(distinct turn) else 0 end as gaps,
    count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (nxt is not null and ini || nxt not in ('su', 'ua', 'au')) as illegal from r group by conv_id)
select i.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(a.f[1], 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(array_to_string(done, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) i left join s on s.conv_id is not distinct from i.conv_id
  left join e on e.conv_id is not distinct from i.conv_id left join cost a on a.conv_id is not distinct from i.conv_id and a.pos = 1
"""
