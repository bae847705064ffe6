"""DuckDB SQL for those queries of this folder that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

OP4 = rf"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(doc_id, 9223372036854775807) as doc_key,
         coalesce(source, chr(1) || 'null') as host, coalesce(text, '') as text
  from documents
), w as (
  select *, regexp_extract_all(text, '{WORD}') as words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines
  from d
), spots as (
  select rid, unnest(range(1, len(words) - 1)) as i, words from w where len(words) > 2
), windows as (
  select rid, i, count(*) over (partition by rid, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) as n from spots
), hit as (
  select rid, count(distinct i + k) as n_repeat_words from windows, (select unnest([0, 1, 2]) as k) where n > 1 group by rid
), lines as (
  select rid, host, doc_key, text, unnest(lines) as raw from w
), keyed as (
  select rid, host, doc_key, text, len(regexp_extract_all(raw, '{WORD}')) as n,
         translate(array_to_string(regexp_extract_all(raw, '{WORD}'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as line
  from lines
), hosts as (
  select host, count(distinct text) as contents from d group by host
), frequent as (
  select host, line, first from (
    select host, line, count(distinct text) as n, min(doc_key) as first from keyed group by host, line
  ) join hosts using (host) where n > 20 and n > 0.002 * contents
), lost as (
  select rid, sum(k.n) as removed_words, count(distinct line) as n_removed_lines
  from keyed k join frequent using (host, line) where doc_key > first group by rid
), counts as (
  select doc_id, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
         coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(removed_words, 0) as removed_words, coalesce(n_removed_lines, 0) as n_removed_lines
  from w left join hit using (rid) left join lost using (rid)
)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
       cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
       (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not (removed_words > 0.5 * n_words) as kept,
       cast(removed_words as bigint) as removed_words, cast(n_removed_lines as bigint) as n_removed_lines
from counts
"""

OP3 = rf"""
with recursive d as (
  select row_number() over () as rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w
  from documents
), shingles as (
  select distinct rid, s from (
    select rid, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
           else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from d)
), sizes as (
  select rid, count(*) as n from shingles group by rid
), shared as (
  select a.rid as u, b.rid as v, count(*) as n from shingles a join shingles b on a.s = b.s and a.rid != b.rid group by 1, 2
), links as (
  select u, v from shared join sizes x on x.rid = u join sizes y on y.rid = v where 100 * shared.n >= 85 * (x.n + y.n - shared.n)
), reach as (
  select rid, rid as other from d
  union
  select r.rid, l.v from reach r join links l on l.u = r.other
), named as (
  select r.rid, min(e.doc_id) as component_id from reach r join d e on e.rid = r.other group by r.rid
)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id is not distinct from component_id as kept
from d left join sizes using (rid) join named using (rid)
"""

OP6 = """
with d as (
  select row_number() over () as rid, doc_id, coalesce(doc_id, 9223372036854775807) as id, hex(encode(coalesce(text, ''))) as h from documents
), starts as (
  select rid, id, i, substring(h, 2 * i + 1, 100) as s from d, unnest(range(0, length(h) // 2 - 49)) as t(i) where length(h) >= 100
), firsts as (
  select rid, id, i, min(id) over (partition by s) as first from starts
), later as (
  select rid, i, i - coalesce(lag(i) over (partition by rid order by i), -100) as gap from firsts where first < id
), spans as (
  select rid, min(i) as lo, max(i) + 50 as hi from (select rid, i, sum(case when gap > 50 then 1 else 0 end) over (partition by rid order by i) as k from later) group by rid, k
), kept as (
  select rid, lo as cut, coalesce(lag(hi) over (partition by rid order by lo), 0) as begin, hi from spans
), pieces as (
  select rid, string_agg(substring(h, 2 * begin + 1, 2 * (cut - begin)), '' order by cut) as body, sum(hi - cut) as removed, count(*) as n, max(hi) as last
  from kept join d using (rid) group by rid
)
select doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, cast(coalesce(n, 0) as bigint) as n_spans,
       sha256(unhex(coalesce(body || substring(h, 2 * last + 1), h))) as kept_sha256
from d left join pieces using (rid)
"""

OP8 = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), o as (
  select *, lag(role) over (partition by conv_id order by turn, role, text) as before from t
), sized as (
  select *, length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) + 7 as chars,
         case when before is not distinct from role then 0 else 5 + length(role) + length(regexp_replace(role, '[^\\<#\n]', '', 'g')) end as head
  from o
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(chars + head) as bigint) as formatted_chars
from sized group by conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_near_duplicates": OP3, "op4_quality_rules": OP4, "op6_repeated_substrings": OP6, "op8_chat": OP8}
