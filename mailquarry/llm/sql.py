"""SQL that states the same as the queries, where SQL can."""

from __future__ import annotations


def _words(text: str, table: str, least: int) -> str:
    return f"""w as (select record_id, unnest(list_distinct(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'))) as x from {table}),
  n as (select record_id, count(*) as n from w group by 1 having count(*) >= {least}), v as (select w.record_id, x, n from w join n using (record_id))"""


P1 = f"""with {_words("coalesce(subject, '') || ' ' || coalesce(body, '')", 'emails', 20)},
  p as (select a.record_id as record_a, b.record_id as record_b, a.n as na, b.n as nb, count(*) as c from v a join v b on a.x = b.x and a.record_id < b.record_id and a.n >= 0.7 * b.n and b.n >= 0.7 * a.n group by all)
select record_a, record_b from p where c >= 0.7 * (na + nb - c) - 1e-9"""

P1_CLASSES = f"""with {_words("coalesce(subject, '') || ' ' || coalesce(body, '')", 'emails', 20)},
  k as (select record_id, md5(string_agg(x, ' ' order by x)) as h from v group by record_id), c as (select record_id, min(record_id) over (partition by h) as class_id from k),
  r as (select * from v where record_id in (select class_id from c)),
  p as (select a.record_id as p, b.record_id as q, a.n as na, b.n as nb, count(*) as c from r a join r b on a.x = b.x and a.record_id <> b.record_id and a.n >= 0.7 * b.n and b.n >= 0.7 * a.n group by all),
  l as (select p, count(*) as n_links from p where c >= 0.7 * (na + nb - c) - 1e-9 group by p)
select c.record_id, class_id, coalesce(n_links, 0) as n_links from c left join l on c.class_id = l.p"""

P8_DECODED = "select doc_id, coalesce(text, '') as text from documents where doc_id is not null"

_HELD = """s as (select record_id, assigned_at, run_no, case when lower(trim(split_name)) in ('train', 'training') then 'train' when lower(trim(split_name)) in ('validation', 'val', 'valid', 'dev') then 'validation' when lower(trim(split_name)) in ('test', 'testing') then 'test' end as split from email_splits),
  h as (select record_id, split from (select *, row_number() over (partition by record_id order by assigned_at desc nulls last, run_no desc nulls last, split desc) as k from s where split is not null and record_id is not null) where k = 1),
  e as (select record_id, body, source, split from emails join h using (record_id))"""

_OVERLAP = f"""{_HELD}, {_words("coalesce(body, '')", 'e', 15)},
  p as (select a.record_id as t, b.record_id as o, a.n as na, b.n as nb, count(*) as c from (select v.*, split from v join h using (record_id)) a join (select v.*, split from v join h using (record_id)) b
    on a.x = b.x and a.split = 'train' and b.split <> 'train' and a.n >= 0.8 * b.n and b.n >= 0.8 * a.n group by all),
  q as (select t, o from p where c >= 0.8 * (na + nb - c) - 1e-9)"""

P3 = f"with {_OVERLAP} select least(t, o) as record_a, greatest(t, o) as record_b from q"
_CANON = "trim(regexp_replace(lower(coalesce({0}.body, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
P3_REPORT = f"""with {_OVERLAP} select o.split, o.source, count(*) as pairs, count_if({_CANON.format('t')} = {_CANON.format('o')}) as exact_pairs, count(distinct o.record_id) as eval_records
  from q join e o on q.o = o.record_id join e t on q.t = t.record_id group by o.split, o.source"""

_DOMAIN = "case when regexp_matches(lower(trim({0})), '^[\\w.-]+$') and len(list_filter(string_split(lower(trim({0})), '.'), lambda x: x <> '')) >= 2 then array_to_string(list_slice(list_filter(string_split(lower(trim({0})), '.'), lambda x: x <> ''), -2, -1), '.') end"

P6 = f"""with recursive d as (select {_DOMAIN.format('domain_name')} as a, {_DOMAIN.format('same_as')} as b from domain_aliases),
  g as (select a, b from d where a is not null and b is not null and a <> b union select b, a from d where a is not null and b is not null and a <> b),
  r(a, b) as (select a, b from g union select r.a, g.b from r join g on r.b = g.a),
  m as (select distinct {_DOMAIN.format('sender_domain')} as x from emails)
select distinct r.a as domain_a, r.b as domain_b from r where r.a < r.b and r.a in (select x from m) and r.b in (select x from m)"""

SQL = {"p1_found": P1, "p1_classes": P1_CLASSES, "p8_decoded": P8_DECODED, "p3_found": P3, "p3_report": P3_REPORT, "p6_found": P6}
