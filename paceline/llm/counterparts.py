"""SQL counterparts of the operators that SQL can express, for DuckDB."""

import re

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CHAT = """
with turns as (
  select distinct conv_id, turn, role, text,
    md5(coalesce(length(role) || ':' || role, '-') || ';' || coalesce(length(text) || ':' || text, '-')) as h
  from conversations where conv_id is not null
), convs as (
  select conv_id, list(h order by turn nulls first, h) as hs, count(*) as n_turns,
    string_agg('<|' || coalesce(replace(role, '<|', '< |'), 'unknown') || '|>' || chr(10)
      || coalesce(replace(text, '<|', '< |'), '') || chr(10) || '<|end|>' || chr(10), ''
      order by turn nulls first, h) as chat
  from turns group by conv_id
), prefixes as (
  select conv_id, i, md5(array_to_string(hs[1:i], ',')) as p, i = n_turns as whole
  from convs, unnest(range(1, n_turns + 1)) as t(i)
), wholes as (
  select p, min(conv_id) as conv_id, count(*) as copies from prefixes where whole group by p
)
select w.conv_id, c.n_turns, w.copies, c.chat
from wholes w join convs c on c.conv_id = w.conv_id
where w.p not in (select p from prefixes where not whole)
"""

BENCHMARK = f"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark
), windows as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + 9], ' ') as win
  from b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as t(i) where len(w) > 0
), places as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as win
  from d, (select distinct n from windows) s, unnest(range(1, len(w) - n + 2)) as t(i)
  where len(w) >= n
), hits as (
  select p.doc_id, p.n, p.i, x.item_id from places p join windows x on x.win = p.win and x.n = p.n
), words as (
  select doc_id, count(distinct i + k) as n_hit from hits, unnest(range(0, n)) as t(k) group by doc_id
), found as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id
)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join found using (doc_id)
"""

SIMILAR = """
with recursive d as (
  select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') as w from documents
), s as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as x
  from d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as t(i) where len(w) > 0
), n as (
  select doc_id, count(*) as n from s group by doc_id
), common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c
  from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by all
), links as (
  select a, b from common join n na on na.doc_id = a join n nb on nb.doc_id = b
  where c / (na.n + nb.n - c) >= 0.8
), reached as (
  select doc_id as a, doc_id as b from documents
  union
  select r.a, l.b from reached r join links l on l.a = r.b
)
select d.doc_id, r.class_id, coalesce(l.n_links, 0) as n_links
from documents d
join (select a, min(b) as class_id from reached group by a) r on r.a = d.doc_id
left join (select a, count(*) as n_links from links group by a) l on l.a = d.doc_id
"""

REPEATED = """
with d as (
  select doc_id, hex(encode(coalesce(text, ''))) as h from documents
), parts as (  -- 400 strings each, as finding a place in a long text takes long
  select doc_id, 400 * c as place, substr(h, 800 * c + 1, 898) as p
  from d, unnest(range(0, (len(h) // 2 - 49 + 399) // 400)) as t(c) where len(h) >= 100
), strings as (
  select doc_id, place + i as i, substr(p, 2 * i + 1, 100) as s
  from parts, unnest(range(0, len(p) // 2 - 49)) as t(i)
), firsts as (
  select s, min(doc_id) as first from strings group by s
), gone as (
  select doc_id, i from strings join firsts using (s) where first < doc_id
), marked as (
  select doc_id, i, i - coalesce(lag(i) over (partition by doc_id order by i), -51) > 50 as fresh from gone
), runs as (
  select doc_id, i, sum(fresh::int) over (partition by doc_id order by i) as run from marked
), spans as (
  select doc_id, min(i) as a, max(i) + 50 as b from runs group by doc_id, run
), pieces as (
  select doc_id, a, h[2 * coalesce(lag(b) over (partition by doc_id order by a), 0) + 1:2 * a] as piece, b,
    row_number() over (partition by doc_id order by a desc) as back, h
  from spans join d using (doc_id)
), kept as (
  select doc_id, string_agg(piece || case when back = 1 then h[2 * b + 1:] else '' end, '' order by a) as k,
    sum(b - a) as n_removed, count(*) as n_spans
  from pieces group by doc_id
)
select d.doc_id, len(d.h) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
  coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(k, d.h))) as kept_sha256
from d left join kept using (doc_id)
"""


def licenses_sql(templates, anchors: str, terms: str) -> str:
    """The license scan over documents, with the same templates."""
    values = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(templates))
    return f"""
with files as (
  select doc_id, source || '/' || cast(doc_id // 50 as varchar) || '/' || cast(doc_id as varchar) as path, text
  from documents
), found as (
  select path, len(text) as size, trim(line, ' ') as line
  from files, unnest(string_split(text, chr(10))) as t(line) where regexp_matches(line, '{anchors}')
), lines as (
  select line, count(*) as n from found group by line
), tf as (
  select line, term, count(*) as tf, any_value(n) as n
  from (select line, n, unnest(regexp_extract_all(lower(line), '{terms}')) as term from lines) group by all
), total as (
  select coalesce(sum(n), 0) as total from lines
), idf as (
  select term, 1 + ln((1.0 + (select total from total)) / (1 + sum(n))) as idf from (select line, term, n from tf) group by term
), patterns as (
  select template, license, p.term, tf * coalesce(idf, 1.0 + ln(1.0 + (select total from total))) as tw
  from (select template, license, term, count(*) as tf from (
    select template, license, unnest(regexp_extract_all(lower(text), '{terms}')) as term
    from (values {values}) v(template, license, text)) group by all) p left join idf on idf.term = p.term
), tnorm as (
  select template, sqrt(sum(tw * tw)) as tn from patterns group by template
), weighed as (
  select line, tf.term, tf * idf as w from tf join idf on idf.term = tf.term
), norm as (
  select line, sqrt(sum(w * w)) as norm from weighed group by line
), scores as (
  select line, license, round(dot / (norm * tn), 6) as score from (
    select line, template, license, sum(w * tw) as dot from weighed join patterns using (term) group by all)
  join tnorm using (template) join norm using (line)
), best as (
  select line, license, score from scores where score >= 0.6
  qualify row_number() over (partition by line order by score desc, license) = 1
), own as (
  select path, arg_min(license, (-score, license)) as license, max(score) as score,
    sum(len(line)) >= 0.5 * max(size) as is_file from found join best using (line) group by path
), dirs as (
  select regexp_extract(path, '^(.*)/[^/]*$', 1) as license_dir, arg_min(license, (-score, license)) as license,
    max(score) as score from own where is_file group by 1
), up as (
  select path, license_dir, license, score from (
    select path, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir from files) f
  join dirs on f.dir = license_dir or starts_with(f.dir, license_dir || '/')
  qualify row_number() over (partition by path order by len(license_dir) desc) = 1
)
select f.doc_id, f.path, coalesce(own.license, up.license) as license,
  case when own.license is not null then case when is_file then 'file' else 'header' end
    when up.license is not null then 'inherited' else 'none' end as how,
  coalesce(own.score, up.score) as score,
  case when own.license is null then up.license_dir end as license_dir
from files f left join own on own.path = f.path left join up on up.path = f.path
"""


def secrets_sql(patterns, rule, mark: str, spare: str) -> str:
    """The secret scan over documents, with the same patterns and rule."""
    kinds = [(p.kind, p.regex, p.group, p.least) for p in patterns]
    kinds.append((rule.kind, rule.candidate, 0, 0))

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    pieces = " UNION ALL ".join(
        f"select doc_id, {i} as k, {quoted(kind)} as kind, {least} as least, "
        f"string_split(regexp_replace(t, {quoted('(' + regex + ')')}, '{mark}\\1{mark}', 'g'), '{mark}') as parts, "
        f"{quoted(regex)} as regex, {group} as grp from d where regexp_matches(t, {quoted(regex)})"
        for i, (kind, regex, group, least) in enumerate(kinds)
    )
    secret = " ".join(
        f"when k = {i} then regexp_extract(v, {quoted(regex)}, {group})"
        for i, (_, regex, group, _) in enumerate(kinds)
    )
    allowed = " or ".join(  # its patterns never go back, so they know no possessive form
        f"regexp_full_match(v, {quoted(re.sub(r'([+*}])[+]', r'\1', x))})"
        for x in rule.allowed
        if "\\1" not in x
    )
    hexes, mixed, letters = (c.bits for c in rule.classes)
    last = len(patterns)
    return f"""
with d as (
  select doc_id, replace(coalesce(text, ''), '{mark}', '{spare}') as t from documents
), pieces as ({pieces}
), placed as (
  select doc_id, k, kind, least, v, ord,
    coalesce(sum(length(v)) over (partition by doc_id, k order by ord rows between unbounded preceding and 1 preceding), 0) as a
  from (select doc_id, k, kind, least, unnest(parts) as v, generate_subscripts(parts, 1) as ord from pieces)
), found as (
  select doc_id, k, kind, a, a + length(v) as b, v from placed
  where ord % 2 = 0 and (k = {last} or length(case {secret} end) >= least)
), limits as (
  select doc_id, a, v, case when regexp_full_match(v, '[0-9a-fA-F]+') then {hexes}
    when regexp_matches(v, '[A-Za-z]') and regexp_matches(v, '[0-9]') then {mixed}
    when not regexp_matches(v, '[0-9]') then {letters} end as bits
  from found where k = {last} and not ({allowed})
    and v <> repeat(v[1], length(v))
), windows as (
  select doc_id, a, i from limits, unnest(range(0, length(v) - {rule.window - 1})) as t(i)
  where list_aggregate(string_split(substr(v, i + 1, {rule.window}), ''), 'entropy') >= bits
), base as (
  select doc_id, k, kind, a, b from found where k < {last}
), high as (
  select doc_id, {last} as k, '{rule.kind}' as kind, a + min(i) as a, a + max(i) + {rule.window} as b
  from windows group by doc_id, windows.a
), fresh as (
  select * from high h where not exists (
    select 1 from base x where x.doc_id = h.doc_id and x.a <= h.a and x.b >= h.b)
), listed as (
  select *, kind || ':' || cast(a as varchar) || ':' || cast(b as varchar) as s
  from (select * from base union all select * from fresh)
), told as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
    count(*) filter (kind = 'hex') as n_hex, string_agg(s, ',' order by a, k) filter (k < {last}) as base,
    string_agg(s, ',' order by a, k) as spans
  from listed group by doc_id
)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access,
  coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join told using (doc_id)
"""


#: The table of the CRC-32 checksum, and the checksum of a text.
CRC = """steps as (
  select i::bigint as i, i::bigint as v, 0 as k from range(256) r(i)
  union all
  select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from steps where k < 8
), crc as (select list(v order by i) as t from steps where k = 8)"""


def crc_sql(text: str) -> str:
    return (
        f"xor(list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), "
        "lambda h: ('0x' || h)::bigint), "
        "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
    )


def shards_sql(count: int, copies: int, digits: int) -> str:
    """Rendezvous hashing with equal weights, so that the greatest hash wins."""

    def bids(n: int) -> str:
        return (
            f"list_transform(range({n}), lambda s: {{'h': substring(md5(k || ':' || s), 1, 13), 's': -s}})"
        )

    return f"""
with recursive {CRC}, docs as (
  select doc_id, octet_length(encode(coalesce(text, ''))) + 1 as size,
    {crc_sql("coalesce(text, '')")} as text_crc32, coalesce(cast(doc_id as varchar), 'null') as k
  from documents, crc
), copied as (
  select *, (row_number() over (partition by doc_id, size, text_crc32) - 1) // {copies} as piece from docs
), placed as (
  select *, -list_max({bids(count)}).s as shard, -list_max({bids(count + 1)}).s as grown_shard,
    substring(md5(k || '#' || size || ':' || text_crc32
      || case when piece > 0 then '#' || piece else '' end), 1, {digits}) as bucket
  from copied
)
select doc_id, size, text_crc32, 'key' as law, shard::int as shard, row_number() over (
    partition by shard order by bucket, doc_id nulls first, size, text_crc32, piece) - 1 as slot,
  grown_shard::int as grown_shard
from placed
"""


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _step(p: str, cost: str, letter: str, line: str = "''") -> str:
    return f"{{'c': {p}.c + {cost}, 'a': {p}.a || '{letter}', 't': {p}.t || {line}}}"


def _inserted(p: str, role: str) -> str:
    return _step(p, "3", "I", f"chr(10) || '{role}:'")


#: After each turn the cheapest edits for each state (0: nothing yet, 1: after system, 2: after user, 3: after
#: assistant), as cost, audit and text; ties go to the least audit.
REPAIR = f"""
with recursive {CRC}, raw as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {crc_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as f
  from conversations, crc
), damaged as (
  select conv_id, turn, case when f = 4 then 'user' else role end as role,
    case when f = 1 then '' when f = 2 then translate(text, '.!?', '') else text end as text, c
  from raw, unnest(range(case when f = 3 then 2 else 1 end)) as t(c) where f <> 0
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), c) as i,
    row_number() over (partition by conv_id, role, text order by turn nulls first, c) as seen,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body, left(role, 1) as initial
  from damaged
), told as (
  select *, case when body = '' then 'blank' when seen > 1 then 'duplicate'
      when right(body, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    i > 1 and lag(initial, 1) over (partition by conv_id order by i) || initial not in ('su', 'ua', 'au') as bad
  from placed
), turns as (
  select conv_id, i, role, text, initial, fault in ('blank', 'duplicate') as gone,
    case when fault = 'truncated' then 3 else 0 end as m from told
), walk as (
  select conv_id, 0::bigint as i, {{'c': 0::bigint, 'a': '', 't': ''}} as p0,
    {{'c': 1000000000::bigint, 'a': '', 't': ''}} as p1, {{'c': 1000000000::bigint, 'a': '', 't': ''}} as p2,
    {{'c': 1000000000::bigint, 'a': '', 't': ''}} as p3
  from (select distinct conv_id from turns)
  union all
  select conv_id, i, {_step("p0", "4", "D")}, case
      when gone or initial <> 's' then {_step("p1", "4", "D")}
      else {_least(_step("p1", "4", "D"), _step("p0", "m", "K", "chr(10) || role || ':' || text"))} end,
    case when gone then {_step("q2", "4", "D")} else {_least(
        _step("q2", "4", "D"),
        *(_step(p, "3 + m", "R", "chr(10) || 'user:' || text") for p in ("p0", "p1", "q3")),
        *(f"case when initial = 'u' then {_step(p, 'm', 'K', 'chr(10) || role || chr(58) || text')} "
          f"else {_step('q2', '4', 'D')} end" for p in ("p0", "p1", "q3")),
    )} end,
    case when gone then {_step("q3", "4", "D")} else {_least(
        _step("q3", "4", "D"),
        _step("q2", "3 + m", "R", "chr(10) || 'assistant:' || text"),
        f"case when initial = 'a' then {_step('q2', 'm', 'K', 'chr(10) || role || chr(58) || text')} "
        f"else {_step('q3', '4', 'D')} end",
    )} end
  from (
    select *, {_least("p3", _inserted("q2", "assistant"))} as q3 from (
      select w.conv_id, t.i, role, text, initial, gone, m, p0, p1, p3,
        {_least("p2", *(_inserted(p, "user") for p in ("p0", "p1", "p3")))} as q2
      from walk w join turns t on t.conv_id is not distinct from w.conv_id and t.i = w.i + 1
    )
  )
), ends as (
  select conv_id, {_least("p0", "p3", _inserted("q2", "assistant"))} as best from (
    select *, {_least("p2", *(_inserted(p, "user") for p in ("p0", "p1", "p3")))} as q2
    from walk w where i = (select max(i) from turns t where t.conv_id is not distinct from w.conv_id)
  )
), counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (bad) as illegal
  from told group by conv_id
)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(best.c, 0) as cost,
  coalesce(best.a, '') as audit, sha256(coalesce(substring(best.t, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) o
  left join counted c on c.conv_id is not distinct from o.conv_id
  left join ends e on e.conv_id is not distinct from o.conv_id
"""

NEGATIVES = """
with v as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as vector
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(
    embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), pairs as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
    list_inner_product(a.vector, b.vector)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id and len(a.vector) = len(b.vector) where a.vec_id % 100 = 0
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from pairs where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, positive_id,
  row_number() over (partition by p.anchor_id, positive_id order by n.score desc, n.vec_id)::int as rank,
  n.vec_id as negative_id, positive_score, n.score as negative_score
from positives p join pairs n on n.anchor_id = p.anchor_id and not n.same
  and 80 * positive_score <= 100 * n.score and 100 * n.score <= 100 * positive_score
qualify rank <= 5
"""
