"""DuckDB SQL for the rows of those queries that SQL can express on whole tables."""

from __future__ import annotations

TOP_K = """with fine as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    scored as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
    from fine q join fine c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
    ranked as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from scored)
    select query_id, rank, vec_id, score from ranked where rank <= 20"""

NEAR_DUPLICATES = """with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words from documents),
    s as (select doc_id, case when len(words) = 0 then [] when len(words) = 1 then [words[1]] else list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) end as shingles from w),
    e as (select doc_id, unnest(shingles) as shingle from s),
    shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from e a join e b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2),
    links as (select a, b from shared join s x on x.doc_id = a join s y on y.doc_id = b where 100 * n >= 80 * (len(x.shingles) + len(y.shingles) - n)),
    reach as (select doc_id as a, doc_id as b from s union select r.a, l.b from reach r join links l on l.a = r.b),
    top as (select a as doc_id, min(b) as component_id from reach group by a)
    select doc_id, cast(len(shingles) as bigint) as n_shingles, component_id, doc_id = component_id as kept from s join top using (doc_id)"""

WARC = """with p as (select page_id, coalesce(html, '') as html from pages), d as (select *, sha1(html) as hex, min(page_id) over (partition by html) as first from p)
    select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((cast('0x' || substr(hex, i // 4 * 5 + 1, 5) as bigint) >> (15 - 5 * (i % 4))) & 31) + 1, 1)), 'string_agg', '') as payload_digest,
    case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from d"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The CRC-32 of each distinct feature is reduced from its bytes with a table that SQL makes.
RESAMPLE = f"""with recursive bits(i, k, v) as (select range, 0, range from range(256) union all
    select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
    crc as (select list(v order by i) as t from bits where k = 8),
    docs as (select row_number() over () as n, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
    goal as (select regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
    own as (select n, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from docs),
    wanted as (select unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from goal),
    every as (select f, hex(encode(f)) as h from (select f from own union select f from wanted)),
    bucket as (select f, xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(0, len(h) // 2), lambda i: cast((strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1 as bigint))),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 10000 as b from every, crc),
    raw as (select b, count(*) as s from own join bucket using (f) group by b), aim as (select b, count(*) as t from wanted join bucket using (f) group by b),
    totals as (select (select count(*) from own) as all_s, (select count(*) from wanted) as all_t),
    gain as (select raw.b, cast(floor(1000 * ln((coalesce(t, 0) + 1) * cast(all_s + 10000 as double) / ((s + 1) * cast(all_t + 10000 as double)))) as bigint) as g from raw left join aim using (b), totals),
    weighed as (select n, count(*) as n_features, cast(floor(sum(g) / count(*)) as bigint) as weight from own join bucket using (f) join gain using (b) group by n),
    scored as (select doc_id, len(w) as words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
        coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast(cast('0x' || substr(sha256('7:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as ubigint) as double) + 0.5) / 4294967296.0))) as bigint) as score from docs left join weighed using (n)),
    able as (select *, row_number() over (partition by words >= 20 order by score desc, doc_id nulls last) as place, count(*) over (partition by words >= 20) as of from scored)
    select doc_id, cast(n_features as bigint) as n_features, weight, score, case when words >= 20 and place <= 25 * of // 100 then place end as rank from able"""


def _uniform(text: str) -> str:
    return f"(cast(cast('0x' || substr(sha256('12:' || {text}), 1, 12) as ubigint) as double) + 0.5) / 281474976710656.0"


#: Sources are capped in the order of their caps by weight; classes go from the largest down by a recursion.
MIXING = f"""with recursive docs as (select doc_id, '=' || source as named, cast(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) as bigint) as size from documents),
    d as (select doc_id, coalesce(named, '') as key, size, case when size > 0 then (length(bin(size)) - 1) * 64 + case when size >= 64 then (size >> (length(bin(size)) - 7)) - 64 else size end else -1 end as class from docs),
    s0 as (select key, cast(sum(size) as bigint) as source_size from d group by key),
    s1 as (select *, [3, 1, 2][cast((row_number() over (order by key = '', key) - 1) % 3 + 1 as bigint)] as weight, 2 * source_size as most from s0),
    s2 as (select *, cast(coalesce(sum(most) over (order by most / weight, key rows between unbounded preceding and 1 preceding), 0) as bigint) as held, cast(sum(weight) over (order by most / weight, key rows between current row and unbounded following) as double) as remaining,
        cast(sum(source_size) over () as bigint) as total, row_number() over (order by most / weight, key) as nth from s1),
    level as (select arg_min((1.5 * total - held) / remaining, nth) as each from s2 where (1.5 * total - held) / remaining * weight <= most),
    goals as (select key, source_size, cast(case when each * weight > most then most else each * weight end as double) as target from s2, level),
    g as (select *, case when source_size > 0 then target / source_size else 0.0 end as ratio from goals),
    classes as (select key, class, count(*) as n, cast(sum(size) as bigint) as words, row_number() over (partition by key order by class desc) as nth from d where class >= 0 group by key, class),
    c as (select key, class, nth, n, words / n as mean, (ratio - floor(ratio)) * words as want, {_uniform("key || ':' || class")} as v from classes join g using (key)),
    walk(key, nth, class, draw, carried) as (select key, cast(0 as bigint), cast(-1 as bigint), cast(0 as bigint), cast(0 as double) from s0 union all
        select c.key, c.nth, cast(c.class as bigint), cast(least(greatest(floor((carried + want) / mean + v), 0), n) as bigint), carried + want - cast(least(greatest(floor((carried + want) / mean + v), 0), n) as bigint) * mean from walk join c on c.key = walk.key and c.nth = walk.nth + 1),
    placed as (select d.*, row_number() over (partition by key, class order by {_uniform("coalesce(cast(doc_id as varchar), '')")}, size) as place from d)
    select doc_id, size, source_size, target, cast(floor(ratio) + case when place <= draw and p.class >= 0 then 1 else 0 end as bigint) * size as taken
    from placed p join g using (key) left join walk w on w.key = p.key and w.class = p.class and w.nth > 0"""

SEARCH = f"""with w as (select doc_id, row_number() over () as row, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as t from documents where doc_id is not null),
    total as (select cast(count(*) filter (len(t) > 0) as bigint) as n, cast(sum(len(t)) as bigint) as l from w),
    asked as (select distinct item_id, unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from benchmark where item_id is not null),
    posted as (select row, doc_id, len(t) as own, unnest(t) as term from w),
    tf as (select row, doc_id, own, term, cast(count(*) as bigint) as tf from posted where term in (select term from asked) group by all),
    df as (select term, cast(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) as bigint) as weight from tf, total group by term, n),
    scored as (select item_id, row, doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * own * n) // l)))) as bigint) as score
        from asked join df using (term) join tf using (term), total group by item_id, row, doc_id),
    ranked as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from scored where score > 0)
    select * from ranked where rank <= 10"""
