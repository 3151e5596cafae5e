"""SQL counterparts of the registered queries, where SQL can express them."""

ORACLE = {
    "op12_hard_negatives": """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, a.label as a_label, c.vec_id, c.label, list_inner_product(a.v, c.v)::bigint as score
  from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from (
    select *, row_number() over (partition by anchor_id order by score desc, vec_id) as r
    from s where label = a_label) where r <= 5),
n as (
  select p.anchor_id, p.positive_id, s.vec_id as negative_id, p.positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as rank
  from p join s on s.anchor_id = p.anchor_id and s.label <> s.a_label
    and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 5
""",
    "op3_top_k": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q, v c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
""",
    "op10_url_filter": """
with p as (
  select page_id,
    case when url like '%://%' then
      translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when url like '%://%' then
      regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
  from pages),
rules(verdict, h, t) as (values
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
hits as (
  select p.*, h || t as rule, verdict,
    row_number() over (partition by page_id, host, path order by length(h) desc, length(t) desc) as n
  from p join rules on (host = h or host like '%.' || h) and starts_with(path, t))
select p.page_id, p.host, p.path, hits.rule, coalesce(hits.verdict, 'allow') as verdict
from p left join (select distinct page_id, host, path, rule, verdict from hits where n = 1) hits
  on p.page_id is not distinct from hits.page_id and p.host = hits.host and p.path = hits.path
""",
    "op9_decontamination": r"""
with words as (
  select 'd' as kind, doc_id as id, string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+') as w from documents
  union all
  select 'b', item_id, string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+') from benchmark),
clean as (select kind, id, list_filter(w, lambda x: x <> '') as w from words),
grams as (
  select kind, id, len(w) as n, s, array_to_string(w[s + 1:s + 5], ' ') as gram
  from clean, unnest(generate_series(0, greatest(len(w) - 5, 0))) as t(s) where len(w) > 0),
item as (select distinct id as item_id, gram from grams where kind = 'b'),
sizes as (select item_id, count(*) as size from item group by 1),
stride as (select max(n) as m from grams where kind = 'b'),
hits as (
  select g.id as doc_id, g.n, g.s, i.item_id, i.gram from grams g join item i using (gram) where g.kind = 'd'),
placed as (
  select distinct doc_id, item_id, gram, p
  from hits, stride, unnest([s // m, s // m - 1]) as t(p)
  where p >= 0 and p < greatest(1, (n + m - 1) // m - 1) and s + 5 <= (p + 2) * m),
shares as (
  select doc_id, item_id, p, count(*) / any_value(size) as overlap
  from placed join sizes using (item_id) group by all)
select doc_id, item_id, count(*) as passages, max(overlap) as overlap
from shares where overlap >= 0.8 - 1e-12 group by 1, 2
""",
    "op6_line_dedup": r"""
with texts as (select doc_id, string_split(text, chr(10)) as lines from documents where text is not null),
line as (
  select doc_id, s as line,
    list_filter(string_split_regex(lines[s + 1], '[ \t\x0B\f\r]+'), lambda x: x <> '') as w
  from texts, unnest(generate_series(0, len(lines) - 1)) as t(s)),
content as (
  select array_to_string(w, ' ') as c, any_value(w) as w, min(row(doc_id, line)) as first
  from line where len(w) > 0 group by 1),
variant as (
  select c, first, len(w) as n, i, array_to_string(w[1:i - 1] || w[i + 1:], ' ') as v
  from content, unnest(generate_series(1, len(w))) as t(i) where len(w) >= 8),
near as (
  select a.c, min(b.first) as first from variant a join variant b on a.n = b.n and a.i = b.i and a.v = b.v group by 1
  union all
  select a.c, min(b.first) from variant a join content b on a.v = b.c where len(b.w) >= 8 group by 1
  union all
  select b.c, min(a.first) from variant a join content b on a.v = b.c where len(b.w) >= 8 group by 1
  union all
  select c, first from content),
least_place as (select c, min(first) as first from near group by 1),
gone as (
  select doc_id, line from line join least_place on c = array_to_string(w, ' ')
  where len(w) > 0 and row(doc_id, line) > first),
removed as (select doc_id, list(line) as lines from gone group by 1)
select d.doc_id, coalesce(len(t.lines), 0)::bigint as n_lines, coalesce(len(r.lines), 0)::bigint as n_removed,
  sha256(case when r.lines is null then coalesce(d.text, '') else coalesce(array_to_string(
    list_filter(t.lines, lambda x, i: not list_contains(r.lines, i - 1)), chr(10)), '') end) as kept_sha256
from documents d left join texts t using (doc_id) left join removed r using (doc_id)
""",
    "op8_substring_dedup": r"""
with w as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '') as w
  from documents),
windows as (
  select doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) as h
  from w, unnest(generate_series(1, len(w) - 49)) as t(s) where len(w) >= 50),
owner as (select h, min(doc_id) as low from windows group by 1),
hit as (select doc_id, s from windows join owner using (h) where doc_id > low),
gone as (
  select doc_id, list_sort(list_distinct(flatten(list(generate_series(s, s + 49))))) as gone from hit group by 1)
select w.doc_id, len(w.w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
  sha256(coalesce(array_to_string(case when gone is null then w.w else list_select(w.w,
    list_filter(generate_series(1, len(w.w)), lambda i: not list_contains(gone, i))) end, ' '), '')) as kept_sha256
from w left join gone using (doc_id)
""",
}
