"""The same results in DuckDB's SQL, for the operators that SQL can express over whole tables."""

from __future__ import annotations

from sievespark.llm.line_dedup import LEAST, LONG, PART
from sievespark.llm.mixing import REPEATS, SHARE, WEIGHTS
from sievespark.llm.resample import BUCKETS, LEAST as DRAWN_LEAST, PERCENT, SEED

_WORD = r"[^\x20\x09-\x0D]+"

LINE_DEDUP = f"""
with whole as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as n from documents where text is not null
), cut as (
  select doc_id, n, whole, unnest(parts) as part, unnest(range(0, len(parts))) as q
  from (select doc_id, n, w <= {LONG} as whole, case when w <= {LONG} then [line] else regexp_extract_all(line, '{PART}', 1) end as parts from (select *, len(regexp_extract_all(line, '{_WORD}')) as w from whole))
), lines as (
  select *, row_number() over (partition by doc_id order by n, q) - 1 as pos from cut
), runs as (
  select doc_id, pos, whole and lead(whole) over d and lead(whole, 2) over d as plain, trim(part) || chr(10) || trim(lead(part) over d) || chr(10) || trim(lead(part, 2) over d) as w from lines window d as (partition by doc_id order by pos)
), windows as (
  select doc_id, pos, w from runs where w is not null and (plain or len(regexp_extract_all(w, '{_WORD}')) >= {LEAST})
), ranked as (
  select doc_id, pos, row_number() over (partition by w order by doc_id, pos) as r from windows
), gone as (
  select distinct doc_id, unnest([pos, pos + 1, pos + 2]) as pos from ranked where r > 1
), kept as (
  select doc_id, string_agg(line, chr(10) order by n) as text from (
    select x.doc_id, x.n, string_agg(x.part, '' order by x.q) as line from lines x left join gone g on x.doc_id = g.doc_id and x.pos = g.pos where g.doc_id is null group by x.doc_id, x.n
  ) group by doc_id
)
select d.doc_id, case when d.text is null then null when n.lines is null then d.text else coalesce(k.text, '') end as text, coalesce(n.lines, 0) as lines_removed
from documents d left join kept k on d.doc_id = k.doc_id left join (select doc_id, count(*) as lines from gone group by doc_id) n on d.doc_id = n.doc_id
"""

MIXING = f"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) as bigint) as size, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as h from documents
), sources as (
  select source, sum(size) as source_size, [{', '.join(map(str, WEIGHTS))}][(row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1]::double as weight from sized group by source
), line as (
  select *, {REPEATS} * source_size as most, row_number() over (order by {REPEATS} * source_size / weight, source nulls last) as p from sources
), filled as (
  select *, ({SHARE} * sum(source_size) over () - coalesce(sum(most) over (order by p rows between unbounded preceding and 1 preceding), 0)) / (sum(weight) over () - coalesce(sum(weight) over (order by p rows between unbounded preceding and 1 preceding), 0)) as level from line
), leveled as (
  select *, (select f.level from filled f where f.level * f.weight <= f.most order by f.p limit 1) as final from filled
), targets as (
  select source, source_size, case when final is null then most else least(most, final * weight) end as target from leveled
), goal as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as copies from targets
), running as (
  select s.*, g.source_size, g.target, g.copies, g.target - g.copies * g.source_size as remainder,
    sum(size) over (partition by s.source order by h range between unbounded preceding and current row) as upto, sum(size) over (partition by s.source, h) as own
  from sized s join goal g on s.source is not distinct from g.source
)
select doc_id, size, cast(source_size as bigint) as source_size, target,
  cast(size * (copies + case when size > 0 and (upto <= remainder or (upto - own <= remainder and upto > remainder and upto - remainder < remainder - (upto - own))) and remainder > 0 then 1 else 0 end) as bigint) as taken
from running
"""

TOOL_CALLS = f"""
with calls as (
  select conv_id, turn, text, role, case when role = 'user' then 'reply' else 'configure' end as name, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) as words,
    case when role = 'user' and turn >= 2 then cast(turn - 2 as varchar) end as after from conversations where role in ('user', 'system') and turn is not null
), results as (
  select conv_id, turn - 1 as called, turn, text from conversations where role = 'assistant' and turn is not null
), chained as (
  select c.*, case when role = 'user' and turn >= 2 and exists (select 1 from calls p where p.conv_id = c.conv_id and p.turn = c.turn - 2) then 1 else 0 end as has_parent from calls c
), depths as (
  select *, turn // 2 - max(case when has_parent = 0 then turn // 2 else -1 end) over (partition by conv_id, turn % 2 order by turn rows between unbounded preceding and current row) as depth from chained
), both_sides as (
  select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.turn, r.called) as id, c.turn as call_turn, r.turn as result_turn, c.depth, c.name, c.text, c.words, c.after, r.text as result from depths c full join results r on c.conv_id = r.conv_id and c.turn = r.called
), checked as (
  select *, case when call_turn is null then null when name = 'reply' then concat_ws('; ', case when text = '' then 'prompt: minLength' end, case when len(text) > 1500 then 'prompt: maxLength' end, case when words < 2 then 'words: minimum' end, case when text is null then 'prompt: required' end)
    else concat_ws('; ', case when text = '' then 'system: minLength' end, case when call_turn > 0 then 'turn: maximum' end, case when text is null then 'system: required' end) end as errors from both_sides
)
select conv_id, cast(id as varchar) as call_id, case when call_turn is null then 'orphan' when result_turn is null then 'unanswered' else 'linked' end as status, call_turn, result_turn,
  cast(depth as bigint) as depth, call_turn as latest, case when call_turn is not null then false end as cyclic, errors = '' as valid, errors,
  '{{"after":' || coalesce('"' || after || '"', 'null') || ',"arguments":' || case when call_turn is null then 'null' when name = 'reply' then '{{' || case when text is null then '' else '"prompt":' || to_json(text) || ',' end || '"turn":' || call_turn || ',"words":' || words || '}}'
    else '{{' || case when text is null then '' else '"system":' || to_json(text) || ',' end || '"turn":' || call_turn || '}}' end || ',"id":"' || id || '","name":' || coalesce('"' || name || '"', 'null') || ',"result":' || coalesce(cast(to_json(result) as varchar), 'null') || '}}' as json
from checked
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PARTS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

RESAMPLING = f"""
with recursive steps as (
  select i::bigint as i, 0 as bit, i::bigint as c from range(256) t(i)
  union all select i, bit + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end from steps where bit < 8
), codes as (
  select list(c order by i) as code from steps where bit = 8
), words as (
  select 0 as target, doc_id, unnest(regexp_extract_all({_LOWER}, '{_PARTS}')) as word from documents union all
  select 1, item_id, unnest(regexp_extract_all({_LOWER}, '{_PARTS}')) from benchmark
), hexed as (
  select word, hex(encode(word)) as h from (select distinct word from words)
), buckets as (
  select word, cast(xor(list_reduce(
    list_concat([4294967295::bigint], list_transform(range(0, len(h) // 2), lambda i: ((instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1)::bigint)),
    lambda c, b: xor(c >> 8, code[(xor(c, b) & 255) + 1])), 4294967295::bigint) % {BUCKETS} as bigint) as bucket from hexed, codes
), counts as (
  select bucket, count(*) filter (where target = 0) as s, count(*) filter (where target = 1) as t from words join buckets using (word) group by bucket
), totals as (
  select sum(s) as s, sum(t) as t from counts
), gains as (
  select bucket, cast(floor(1000 * ln((c.t + 1)::double * (a.s + {BUCKETS})::double / ((c.s + 1)::double * (a.t + {BUCKETS})::double))) as bigint) as gain from counts c, totals a
), weights as (
  select doc_id, count(*) as n_features, cast(floor(sum(gain)::double / count(*)) as bigint) as weight from words join buckets using (word) join gains using (bucket) where target = 0 group by doc_id
), noise as (
  select doc_id, cast('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 8) as bigint) as h from documents
), scored as (
  select n.doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) as bigint) as score from noise n left join weights w on n.doc_id = w.doc_id
), placed as (
  select *, row_number() over (partition by n_features >= {DRAWN_LEAST} order by score desc, doc_id) as place, count(*) over (partition by n_features >= {DRAWN_LEAST}) as able from scored
)
select doc_id, n_features, weight, score, case when n_features >= {DRAWN_LEAST} and place <= able * {PERCENT} // 100 then place end as rank from placed
"""

ORACLE_SQL = {"op1_tool_calls": TOOL_CALLS, "op3_line_dedup": LINE_DEDUP, "op10_mixing": MIXING, "op12_resampling": RESAMPLING}
