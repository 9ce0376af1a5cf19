"""DuckDB forms of corpus queries, by brute force over whole texts."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

RULES = r"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
words as (select r, unnest(range(1, len(ws) + 1)) as p, unnest(ws) as w from docs),
windows as (select r, n, p, array_to_string(ws[p:p + n - 1], ' ') as win
            from (select r, ws, n, unnest(range(1, len(ws) - n + 2)) as p from docs, (values (5), (8), (10)) t(n) where len(ws) >= n)),
repeated as (select r, n, unnest(range(p, p + n)) as p from (select *, count(*) over (partition by r, n, win) as c from windows) where c > 1),
covered as (select distinct r, n, p from repeated),
inside as (select r, n, count(*) as n_words, sum(length(w)) as chars from covered join words using (r, p) group by r, n),
lines as (select r, line, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) as chars from (select r, unnest(string_split(text, chr(10))) as line from docs) where chars > 0),
line_counts as (select r, sum(c) - count(*) as n_dup, sum(case when c > 1 then c * chars else 0 end) as dup_chars from (select r, line, chars, count(*) as c from lines group by all) group by r),
measured as (
  select d.r, doc_id, len(ws) as n_words, coalesce((select sum(length(w)) from words where words.r = d.r), 0) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup, 0) as n_dup_lines, coalesce(dup_chars, 0) as dup_chars, coalesce(i8.n_words, 0) as n_repeat_words,
    greatest(coalesce(i5.chars, 0), coalesce(i8.chars, 0), coalesce(i10.chars, 0)) as most
  from docs d left join line_counts l on l.r = d.r left join inside i5 on i5.r = d.r and i5.n = 5 left join inside i8 on i8.r = d.r and i8.n = 8 left join inside i10 on i10.r = d.r and i10.n = 10),
judged as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from measured)
select doc_id, n_words, word_chars::bigint as word_chars, n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words, base_failed,
  not base_failed and dup_chars <= 0.2 * word_chars and n_symbols <= 0.1 * n_words and most <= 0.2 * word_chars as kept
from judged
"""

DECONTAMINATE = rf"""
with items as (select item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark where item_id is not null),
tests as (select distinct item_id, ws[p:p + n - 1] as terms
          from (select item_id, ws, least(10, len(ws)) as n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as p from items where len(ws) > 0)),
docs as (select row_number() over () as r, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
windows as (select r, n, p, ws[p:p + n - 1] as terms
            from (select r, ws, n, unnest(range(1, len(ws) - n + 2)) as p from docs, (select distinct len(terms) as n from tests) where len(ws) >= n)),
found as (select r, n, p, item_id from windows join tests using (terms)),
hits as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + n)) as q from found) group by r),
named as (select r, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as listed from (select distinct r, item_id::varchar as item from found) group by r),
uses as (select term, count(*) as uses from (select unnest(ws) as term from items) group by term),
placed as (select terms, unnest(terms) as term, generate_subscripts(terms, 1) as k from (select distinct terms from tests)),
anchors as (select terms, term from (select *, row_number() over (partition by terms order by uses, k) as nth from placed join uses using (term)) where nth = 1),
places as (select r, unnest(ws) as term, generate_subscripts(ws, 1) as p from docs),
close as (select distinct r, terms from places join anchors using (term) join docs using (r) where list_has_all(ws[greatest(1, p - 15):p + 15], terms)),
near as (select r, count(distinct item_id) as n_near from close join tests using (terms) group by r)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(listed, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated,
  coalesce(n_near, 0) as n_near_items
from docs left join hits using (r) left join named using (r) left join near using (r)
"""

JACCARD = rf"""
with recursive docs as (select doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') as ws from documents),
shingles as (select distinct doc_id, array_to_string(ws[p:p + 4], ' ') as win
             from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as p from docs where len(ws) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select x.doc_id as a, y.doc_id as b, count(*) as n from shingles x join shingles y on x.win = y.win and x.doc_id <> y.doc_id group by all),
links as (select a, b from common c join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c.n >= 80 * (x.n + y.n - c.n)),
reach as (select doc_id as a, doc_id as b from docs union select r.a, l.b from reach r join links l on l.a = r.b),
roots as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, coalesce(n, 0) as n_shingles, component_id from docs left join sizes using (doc_id) join roots using (doc_id)
"""
