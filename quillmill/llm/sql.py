"""DuckDB SQL for the operators that SQL can express, over the whole tables."""

_USABLE = "embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0"

ORACLES = {
    "op3_multi_index": f"""
with recursive m as (select vec_id, label, embedding::double[] as e, pow(2.0, floor(log2(list_max(list_transform(embedding::double[], lambda x: abs(x)))))) as s from embeddings where {_USABLE} and label is not null),
v as (select vec_id, label, list_transform(e, lambda x: x / s) as e from m),
link as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98
),
reach(a, b) as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a),
low as (select a, min(b) as b from reach group by a),
n as (select a, count(*) as n from link group by a)
select vec_id, coalesce(n.n, 0)::bigint as n_links, least(vec_id, coalesce(low.b, vec_id)) as component_id,
  vec_id = least(vec_id, coalesce(low.b, vec_id)) as kept
from embeddings left join low on vec_id = low.a left join n on vec_id = n.a
""",
    "op5_substring": r"""
with w as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as ws from documents),
win as (
  select doc_id, p, array_to_string(ws[p:p + 19], ' ') as s
  from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as p from w where len(ws) >= 20)
),
firsts as (select s, min({'d': doc_id, 'p': p}) as f from win group by s having count(*) > 1),
dup as (select doc_id, p from win join firsts using (s) where {'d': doc_id, 'p': p} <> f),
gone as (select distinct doc_id, p + o as q from dup, range(20) t(o)),
word as (select doc_id, unnest(ws) as x, unnest(range(1, len(ws) + 1)) as q from w),
kept as (
  select doc_id, string_agg(x, ' ' order by q) as t, count(*) as n
  from word anti join gone on word.doc_id = gone.doc_id and word.q = gone.q group by doc_id
)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept on w.doc_id = kept.doc_id
""",
    "op9_bit_codes": f"""
with v as (select vec_id, embedding::double[] as e from embeddings where {_USABLE} and vec_id is not null),
pair as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.e, c.e) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from pair qualify rank <= 20
""",
    "op11_fill_in_middle": r"""
with u as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as us,
    sha256('42:' || doc_id) as d
  from documents
),
h as (
  select *, len(us)::bigint as n, ('0x' || d[1:8])::bigint as h1, ('0x' || d[9:16])::bigint as h2, ('0x' || d[17:24])::bigint as h3, ('0x' || d[25:32])::bigint as h4
  from u
),
f as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as lo, greatest(h1 % (n + 1), h2 % (n + 1)) as hi,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain'
      when h4 % 100 < 80 then 'spm' else 'psm' end as form
  from h
),
p as (
  select *, array_to_string(us[1:lo], '') as a, array_to_string(us[lo + 1:hi], '') as m, array_to_string(us[hi + 1:], '') as z from f
)
select doc_id, n, form, case when form <> 'plain' then length(a) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || a || '<S>' || z || '<M>' || m else '<S>' || z || '<P>' || a || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from p
""",
}
