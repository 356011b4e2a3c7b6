"""DuckDB SQL of the queries that SQL can express, over whole tables.

Words are runs other than \\x20 and \\x09-\\x0D (written as a class of the regular expression engine); null texts have none."""

_SPACED = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRING = rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) as w from documents),
win as (select doc_id, unnest(range(1, greatest(len(w) - 18, 1))) as s, w from d),
keyed as (select doc_id, s, array_to_string(w[s:s + 19], ' ') as k from win),
later as (select doc_id, s from (select doc_id, s, row_number() over (partition by k order by doc_id, s) as nth from keyed) where nth > 1),
gone as (select distinct doc_id, unnest(range(s, s + 20)) as i from later),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
kept as (select words.doc_id, string_agg(word, ' ' order by words.i) as t, count(*) as n from words anti join gone on words.doc_id = gone.doc_id and words.i = gone.i group by words.doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept on d.doc_id = kept.doc_id
"""

URLS = rf"""
with r as (select page_id, case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
q as (select *, case
  when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
  when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
  when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
  when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
  when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule from p)
select page_id, host, path, rule, case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block'
  when list_has_any(regexp_split_to_array(host, '[.-]'), ['adult', 'bets', 'casino', 'pills', 'porn']) then 'block' else 'allow' end as verdict
from q
"""

_ALPHA = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
CONTAMINATION = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_ALPHA}) as w from documents),
b as (select item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_ALPHA}) as w from benchmark),
cut as (select item_id, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as s, w from b where len(w) > 0),
item as (select distinct item_id, array_to_string(w[s:s + 12], ' ') as k, least(len(w), 13) as n from cut),
sizes as (select distinct n from item),
places as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, sizes where len(w) >= n),
hit as (select doc_id, s, p.n, item_id from (select doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') as k from places) p join item using (k, n)),
hit_words as (select doc_id, count(distinct i) as n_hit from (select doc_id, unnest(range(s, s + n)) as i from hit) group by doc_id),
hit_items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from hit) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit_words using (doc_id) left join hit_items using (doc_id)
"""

JACCARD = rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_SPACED}) as w from documents),
cut as (select doc_id, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as s, w from d where len(w) > 0),
g as (select distinct doc_id, hash(array_to_string(w[s:s + 3], ' ')) as k from cut),
n as (select doc_id, count(*) as n from g group by doc_id),
both_in as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from both_in join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)),
edge as (select a, b from link union all select b, a from link),
reach(doc_id, other) as (select a, b from edge union select reach.doc_id, edge.b from reach join edge on reach.other = edge.a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(min(other), d.doc_id)) as component_id
from d left join n on n.doc_id = d.doc_id left join reach on reach.doc_id = d.doc_id group by d.doc_id, n.n
"""

_ENDS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LINES = rf"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as i from d),
k as (select *, {_LOWER.format(f"trim(line, {_ENDS})")} as key from l),
often as (select key, max(doc_id) as last from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
judged as (select k.*, coalesce(last != doc_id, false) as gone from k left join often using (key))
select doc_id, count(*)::bigint as n_lines, (count(*) filter (gone))::bigint as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from judged group by doc_id
"""

#: crc32 of a string's UTF-8 bytes, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::bigint)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, _k: xor(x >> 1, 3988292384 * (x & 1)))))"""

VARIANTS = rf"""
with recursive t as (select doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[A-Za-zÀ-ÿ]+')) as w from documents),
r as (select w, doc_id::varchar || ':' || w as k, count(*) as n from t where length(w) >= 7 group by all),
h as (select w, n, {_CRC.format("k")} as h from r),
v as (select case when h % 31 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, sum(n)::bigint as n from h group by 1),
words as (select word, n from v where length(word) >= 7 and n >= 2),
cut as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
shorter as (select distinct c.word as a, c.n as a_n, w.word as b, w.n as b_n from cut c join words w on c.rest = w.word),
pair as (select a, a_n, b, b_n from shorter union all select b, b_n, a, a_n from shorter
  union all select x.word, x.n, y.word, y.n from cut x join cut y on x.i = y.i and x.rest = y.rest and x.word != y.word),
best as (select a as word, b as form, b_n as form_n, count(*) over (partition by a) as n_near from pair qualify row_number() over (partition by a order by b_n desc, b) = 1),
forms as (select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when form_n >= 10 * w.n then form end as form, case when form_n >= 10 * w.n then form_n end as form_n from words w left join best using (word)),
way(word, root) as (select word, word from forms union all select way.word, f.form from way join forms f on way.root = f.word where f.form is not null)
select f.word, f.form, way.root, f.n, f.n_near, f.form_n
from forms f join way on f.word = way.word join forms last on last.word = way.root where last.form is null
"""

RUNS = rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) as w, {_CRC.format("doc_id::varchar")} as h from documents),
e as (select doc_id, w, len(w) as n, h % 10 = 0 and len(w) > 0 as hit, case when len(w) > 0 then (h // 10) % len(w) end as a, h // 10 as g from d),
f as (select *, 1 + (n - a) // (3 + g % 8) as p from e),
t as (select doc_id, n, case when hit then list_transform(range(n), lambda i: case when i < a then w[i + 1] else w[a + (i - a) % p + 1] end) else w end as w from f),
x as (select doc_id, n, unnest(w) as word, unnest(range(n)) as i from t),
same as (select a.doc_id, a.i, a.i - b.i as q from x a join x b on a.doc_id = b.doc_id and a.word = b.word and a.i > b.i and 2 * (a.i - b.i) <= a.n),
stretch as (select doc_id, q, min(i) - q as start, count(*) + q as length from (select *, i - row_number() over (partition by doc_id, q order by i) as part from same) group by doc_id, q, part having count(*) >= greatest(q, 12 - q)),
run as (select doc_id, start, length, min(q) as period from stretch group by all),
lists as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as runs from run group by doc_id),
best as (select * from run qualify row_number() over (partition by doc_id order by length desc, start, period) = 1),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from run),
kept as (select x.doc_id, string_agg(word, ' ' order by x.i) as words from x anti join gone on x.doc_id = gone.doc_id and x.i = gone.i group by x.doc_id)
select t.doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.start::bigint as start, best.length::bigint as length, best.period::bigint as period, (1000 * best.length // best.period)::bigint as exponent_milli,
  sha256(coalesce(runs, '')) as runs_sha256, sha256(coalesce(words, '')) as collapsed_sha256, t.n::bigint as n_words
from t left join lists using (doc_id) left join best using (doc_id) left join kept using (doc_id)
"""
