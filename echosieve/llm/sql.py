"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from echosieve.llm.licenses import LEAST_SHARE, NOTICES, PHRASES, SHORT

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_DEDUP = r"""
with pages as (
  select doc_id, source, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as lines
  from documents
), bare as (
  select doc_id, source, text, unnest(list_distinct(list_transform(
    lines, lambda l: trim(l, chr(32) || chr(9) || chr(13))))) as line
  from pages
), counts as (
  select source, line, count(*) as pages, count(distinct text) as texts
  from bare where line <> '' group by source, line
), totals as (select source, count(*) as total from pages group by source
), dropped as (
  select c.source, list(line) as gone
  from counts c join totals t on c.source = t.source
  where texts >= 2 and pages > 0.05::double * total  -- and the lower Wilson bound is above 0.05
    and (pages - 0.05::double * total) * (pages - 0.05::double * total)
      > 1.96::double * 1.96::double * 0.05::double * 0.95::double * total
  group by c.source
), kept as (
  select p.doc_id, p.source, len(lines) as n_lines, list_filter(lines, lambda l:
    not coalesce(list_contains(gone, trim(l, chr(32) || chr(9) || chr(13))), false)) as left_over
  from pages p left join dropped d on p.source = d.source
)
select doc_id, source, array_to_string(left_over, chr(10)) as text,
       length(array_to_string(left_over, chr(10))) as n_chars,
       cast(n_lines as int) as n_lines, cast(n_lines - len(left_over) as int) as n_dropped
from kept
"""

DECONTAMINATE = rf"""
with d as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as w
  from documents
), b as (
  select item_id, regexp_extract_all(
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as w
  from benchmark
), spots as (
  select item_id, w, least(len(w), 13) as size, unnest(range(0, len(w) - least(len(w), 13) + 1)) as s
  from b where len(w) > 0
), windows as (
  select distinct item_id, size, list_slice(w, s + 1, s + size) as win from spots
), sizes as (select distinct size from windows
), doc_spots as (
  select doc_id, w, size, unnest(range(0, len(w) - size + 1)) as s
  from d, sizes where len(w) >= size
), hits as (
  select doc_id, item_id, s, windows.size as size
  from doc_spots join windows
    on windows.size = doc_spots.size and win = list_slice(w, s + 1, s + doc_spots.size)
), places as (
  select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(range(s, s + size)) as p from hits) group by doc_id
), ids as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as joined
  from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit,
       coalesce(n_items, 0) as n_items, sha256(coalesce(joined, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join places on d.doc_id = places.doc_id left join ids on d.doc_id = ids.doc_id
"""

TOOL_CALLS = r"""
with t as (
  select conv_id, turn, role, text, coalesce(text, '') as said,
    lag(role) over w as role_before, lag(turn) over w = turn - 1 as follows,
    lead(role) over w as role_after, lead(turn) over w = turn + 1 as followed
  from conversations window w as (partition by conv_id order by turn)
), k as (
  select *, case role when 'user' then 'call' when 'assistant' then 'result' else 'message' end as kind,
    coalesce(follows and (role <> 'assistant' or role_before = 'user'), false) as has_parent
  from t
), i as (
  select *, sum(case when has_parent then 0 else 1 end)
    over (partition by conv_id order by turn rows unbounded preceding) as island from k
), m as (
  select *, row_number() over (partition by conv_id, island order by turn) - 1 as depth,
    conv_id || ':' || turn as id,
    len(list_filter(regexp_split_to_array(said, '\s+'), lambda x: x <> '')) as words
  from i
)
select conv_id, id, turn as ready_turn, cast(depth as int) as level,
  case kind when 'result' then case when has_parent then 'linked' else 'orphan' end
    when 'call' then case when followed and role_after = 'assistant' then 'answered'
                     else 'unanswered' end end as link,
  case when kind = 'call' then 'valid' end as arguments,
  case kind
    when 'call' then '{"arguments":{"prompt":' || to_json(said) || ',"words":' || words ||
      '},"call_id":"' || id || '","kind":"call","name":"reply","role":"user","turn":' || turn || '}'
    when 'result' then '{"call_id":"' || conv_id || ':' || (turn - 1) || '","content":' ||
      to_json(text) || ',"kind":"result","role":"assistant","turn":' || turn || '}'
    else '{"content":' || to_json(text) || ',"kind":"message","role":"' || role || '","turn":' ||
      turn || '}' end as json
from m
"""

URL_FILTER = rf"""
with rules(host, path, verdict) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
         ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), parsed as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages
), fits as (
  select p.page_id, p.host, p.path, r.host || r.path as rule, r.verdict
  from parsed p left join rules r
    on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from fits
qualify row_number() over (partition by page_id order by length(rule) desc nulls last) = 1
"""

_TEMPLATES = ",\n         ".join(
    f"({n}, '{text}', '{label}', {base}, "
    f"cast({1 if len(text.split()) <= SHORT else LEAST_SHARE} as double))"
    for n, (text, label, base) in enumerate(
        [(*t, "true") for t in PHRASES] + [(*t, "false") for t in NOTICES]
    )
)

LICENSES = rf"""
with listed(template, notice, label, base, least_share) as (
  values {_TEMPLATES}
), t as (
  select *, string_split(notice, ' ') as w, least(len(string_split(notice, ' ')), 4) as size from listed
), g as (select *, unnest(range(0, len(w) - size + 1)) as spot from t
), grams as (select *, list_slice(w, spot + 1, spot + size) as gram from g
), d as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as words
  from documents
), sizes as (select distinct size from t
), spots as (
  select doc_id, words, size, unnest(range(0, len(words) - size + 1)) as pos
  from d, sizes where len(words) >= size
), hits as (
  select doc_id, template, pos - spot as diagonal, spot, g.size as size, len(g.w) as n, label, base, least_share
  from spots s join grams g on s.size = g.size and list_slice(words, pos + 1, pos + s.size) = gram
), diagonals as (
  select doc_id, template, label, base, least_share, n, size, diagonal, list(distinct spot) as places
  from hits group by all
), whole as (
  select doc_id, count(*) as n_base, min(diagonal) as first_word, max(diagonal) as last_word,
         list(distinct label) as own
  from diagonals where base and len(places) = n - size + 1 group by doc_id
), parted as (
  select *, case when diagonal - lag(diagonal) over w > 6 then 1 else 0 end as parts
  from diagonals window w as (partition by doc_id, template order by diagonal)
), runs as (
  select *, sum(parts) over (partition by doc_id, template order by diagonal) as run from parted
), cells as (select *, unnest(places) as spot from runs
), covered as (select *, unnest(range(spot, spot + size)) as place from cells
), shares as (
  select doc_id, template, label, base, least_share, run, count(distinct place) / n as share
  from covered group by doc_id, template, label, base, least_share, run, n
), scored as (
  select doc_id, max(share) as score,
    coalesce(list(distinct label) filter (not base and share >= least_share), []) as more
  from shares group by doc_id
)
select d.doc_id, cast(len(words) as bigint) as n_words, coalesce(n_base, 0) as n_base,
  first_word, last_word,
  coalesce(array_to_string(list_sort(own), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ','), '') as labels,
  cast(coalesce(score, 0) as double) as score
from d left join whole on d.doc_id = whole.doc_id left join scored on d.doc_id = scored.doc_id
"""


def llm_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": LINE_DEDUP,
        "op3_decontaminate": DECONTAMINATE,
        "op7_tool_calls": TOOL_CALLS,
        "op9_url_filter": URL_FILTER,
        "op11_license_scan": LICENSES,
    }
