"""DuckDB SQL for the queries that SQL can express on whole tables."""

_LOW = "translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = f"regexp_extract_all({_LOW.format(c='text')}, '[^\\x20\\x09-\\x0D]+')"
_ALNUM = f"regexp_extract_all({_LOW.format(c='text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP3 = """
with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
p as (select doc_id, unnest(range(1, octet_length(b) - 98)) as k, unnest(list_transform(range(1, octet_length(b) - 98), lambda k: md5_number(b[k:k + 99]))) as m from d where octet_length(b) >= 100),
f as (select doc_id, k, row_number() over (partition by m order by doc_id, k) > 1 as late from p),
s as (select doc_id, k, k - lag(k, 1, -1000) over (partition by doc_id order by k) > 100 as opens from f where late),
g as (select doc_id, k, sum(opens::int) over (partition by doc_id order by k) as run from s),
r as (select doc_id, run, min(k) as first, max(k) + 99 as last from g group by doc_id, run),
x as (select doc_id, first, last, lag(last, 1, 0) over (partition by doc_id order by first) as since from r),
t as (select x.doc_id, sum(x.last - x.first + 1) as gone, count(*) as n, string_agg(hex(d.b[since + 1:x.first - 1]), '' order by x.first) as kept, max(x.last) as final from x join d on d.doc_id = x.doc_id group by x.doc_id)
select d.doc_id, octet_length(b) as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(n, 0) as n_spans, sha256(unhex(coalesce(kept, '') || hex(b[coalesce(final, 0) + 1:]))) as kept_sha256
from d left join t on t.doc_id = d.doc_id
"""

OP5 = f"""
with recursive w as (select doc_id, {_SPACED} as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
n as (select doc_id, count(*) as n from s group by doc_id),
l as (select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2) p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)),
e as (select a, b from l union select b, a from l),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on e.a = r.b),
m as (select a, min(b) as component_id from r group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, component_id = d.doc_id as kept
from documents d join m on m.a = d.doc_id left join n on n.doc_id = d.doc_id
"""

OP8 = f"""
with d as (select doc_id, {_ALNUM} as w from documents),
i as (select item_id, {_ALNUM} as w from benchmark),
v as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[k:k + 9], ' ') as win from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as k from i where len(w) > 0)),
z as (select distinct n from v),
p as (select doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') as win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, z where len(w) >= n)),
h as (select p.doc_id, p.n, p.k, v.item_id from p join v on v.win = p.win and v.n = p.n),
c as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(k, k + n)) as pos from h) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from h) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c on c.doc_id = d.doc_id left join t on t.doc_id = d.doc_id
"""

# the fixed columns of queries whose other columns SQL can't express

_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length({c}::varchar) + 1), lambda i: unicode(substr({c}::varchar, i, 1))::bigint)),
  lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def _held_out(modulus: int, remainder: int) -> str:
    return f"coalesce({_CRC.format(c='doc_id')} % {modulus} = {remainder}, false)"


QUALITY_SPLIT = f"select doc_id, {_held_out(3, 1)} as held_out from documents"

MIX_TARGETS = """
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
s as (select source, sum(size) as n, list_extract([5.0::double, 2.0::double, 1.0::double], (row_number() over (order by source nulls last) - 1) % 3 + 1) as w from d group by source),
t as (select *, (sum(n) over () - coalesce(sum(3.0 * n) over (order by 3.0 * n / w, source nulls last rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (order by 3.0 * n / w, source nulls last rows between current row and unbounded following) as level from s),
l as (select min_by(level, 3.0 * n / w) as level from t where level * w <= 3.0 * n)
select doc_id, size, n::bigint as source_size, round(least(3.0 * n, coalesce(l.level * w, 3.0 * n))::double, 4) as target from d join t on t.source is not distinct from d.source, l
"""

_ASSIGN = """([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SPAN = "select doc_id, {k} as k, '{kind}' as kind, unnest(regexp_extract_all(t, '{p}')) as m, unnest(regexp_extract_all(t, '{p}', {g})) as v, unnest(string_split_regex(t, '{p}')[:len(regexp_extract_all(t, '{p}'))]) as before, generate_subscripts(regexp_extract_all(t, '{p}'), 1) as j from d"

SECRET_BASE = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
m as ({_SPAN.format(k=0, kind="assign", p=_ASSIGN, g=2)} union all {_SPAN.format(k=1, kind="access", p="AKIA[A-Z0-9]+", g=0)} union all {_SPAN.format(k=2, kind="hex", p="[0-9a-f]+", g=0)}),
p as (select *, sum(length(before) + length(m)) over (partition by doc_id, k order by j) as stop from m),
b as (select doc_id, k, kind, stop - length(m) as start, stop from p where length(v) >= case k when 0 then 6 when 1 then 20 else 24 end),
a as (select doc_id, count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access, count(*) filter (where k = 2) as n_hex, string_agg(kind || ':' || start::bigint || ':' || stop::bigint, ',' order by start, k) as spans from b group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(spans, '')) as base_sha256 from d left join a on a.doc_id = d.doc_id
"""

EDITED_TEXTS = """
with d as (select doc_id, coalesce(text, '') as t from documents),
n as (select *, length(t) as n, coalesce(lead(t) over (order by doc_id), first_value(t) over (order by doc_id)) as following from d)
select doc_id, n as n_chars, sha256(substr(t, 1, n - n // 2) || substr(following, 1, n // 2)) as edited_sha256 from n
"""

LM_BASE = f"""
with d as (select doc_id, {_held_out(7, 2)} as held_out, {_SPACED} as w from documents),
t as (select doc_id, held_out, unnest(list_append(w, null)) as w from d),
c as (select w, count(*) as c from t where not held_out group by w),
k as (select sum(c) as n, count(*) as v from c)
select doc_id, held_out, count(*) as n_tokens, count(*) filter (where c > 0) as n_known, max(n)::bigint as train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 4) as base_score
from t left join c on c.w is not distinct from t.w, k group by doc_id, held_out
"""
