"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from . import chat, quality

_WORDS = "len(list_filter(string_split_regex(coalesce({t}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))"
_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP8 = f"""
with lines as (
  select rid, doc_id, unnest(range(1, len(ls) + 1)) as pos, unnest(ls) as line
  from (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)
), keyed as (
  select *, {_LOWER.format(t=f"trim(line, {_WS})")} as key from lines
), frequent as (
  select key from keyed where length(key) >= 1 group by key having count(distinct rid) >= 10
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (f.key is not null)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (f.key is null), '')) as kept_sha256
from keyed k left join frequent f on k.key = f.key
group by rid, doc_id
"""

OP2 = f"""
with sized as (
  select doc_id, source, {_WORDS.format(t="text")}::bigint as size,
    ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, '')), 1, 3))::int as bin
  from documents
), sources as (
  select source, sum(size)::bigint as source_size from sized group by source
), ranked as (
  select *, list_extract([5.0::double, 2.0, 1.0], (row_number() over (order by source nulls last) - 1) % 3 + 1) as weight,
    source_size * 2.0::double as cap, sum(source_size) over () * 1.5::double as total
  from sources
), levels as (
  select *, (total - coalesce(sum(cap) over (w rows between unbounded preceding and 1 preceding), 0)) /
    sum(weight) over (w rows between current row and unbounded following) as level,
    row_number() over w as k
  from ranked window w as (order by cap / weight, source nulls last)
), chosen as (
  select arg_min(level, k) filter (level * weight <= cap) as level from levels
), targets as (
  select source, source_size, least(cap, coalesce(c.level * weight, cap)) as target from levels l, chosen c
), rests as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole,
    target - (case when source_size > 0 then floor(target / source_size) else 0 end) * source_size as rest
  from targets
), upto as (
  select source, bin, sum(sum(size)) over (partition by source order by bin) as upto from sized group by source, bin
), cuts as (
  select r.source, arg_min(bin + 1, (abs(upto - rest), bin)) as cut, min(abs(upto - rest)) as miss
  from upto u join rests r on r.source is not distinct from u.source group by r.source
)
select doc_id, size, source_size, target,
  (size * (whole + case when miss < rest and bin < cut then 1 else 0 end))::bigint as taken
from sized s join rests r on s.source is not distinct from r.source
join cuts c on s.source is not distinct from c.source
"""

_GRID = ", ".join(f"('{r}', {i}, {c!r}::double)" for r, cuts in quality.GRID.items() for i, c in enumerate(cuts))

OP1 = f"""
with docs as (
  select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as ws,
    string_split(coalesce(text, ''), chr(10)) as ls
  from documents
), wins as (
  select rid, unnest(range(1, len(ws) - 6)) as i, unnest(list_transform(range(1, len(ws) - 6), lambda i: ws[i:i+7])) as win
  from docs where len(ws) >= 8
), twice as (
  select rid, i from (select rid, i, count(*) over (partition by rid, win) as n from wins) where n > 1
), covered as (
  select rid, count(distinct p) as n from (select rid, unnest(range(i, i + 8)) as p from twice) group by rid
), base as (
  select d.rid, doc_id, lang, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::bigint as word_chars,
    (length(t) - length(translate(t, '{quality.SYMBOLS}', '')))::bigint as n_symbols,
    (len(list_filter(ls, lambda x: length(trim(x, {_WS})) > 0)) -
      len(list_distinct(list_filter(ls, lambda x: length(trim(x, {_WS})) > 0))))::bigint as n_dup_lines,
    coalesce(c.n, 0)::bigint as n_repeat_words, len(ls) as n_lines
  from docs d left join covered c on d.rid = c.rid
), judged as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
    case when word_chars > 0 then n_symbols / word_chars else 0 end as symbol_ratio,
    case when n_lines > 0 then n_dup_lines / n_lines else 0 end as dup_line_ratio,
    case when n_words > 0 then n_repeat_words / n_words else 0 end as repeat_ratio,
    case when n_words > 0 then word_chars / n_words else 0 end as mean_word_chars
  from base
), long as (
  unpivot (select rid, symbol_ratio, dup_line_ratio, repeat_ratio, mean_word_chars from judged)
  on symbol_ratio, dup_line_ratio, repeat_ratio, mean_word_chars into name rule value v
), held as (
  select j.rid, lang, quality = 1 as good
  from judged j join (select doc_id, min(quality) as quality from labels where doc_id is not null group by doc_id) t using (doc_id)
  where not base_failed and quality is not null
), totals as (
  select lang, count(*) filter (good) as n_good, count(*) filter (not good) as n_bad from held group by lang
), grid(rule, step, cut) as (values {_GRID}
), counts as (
  select h.lang, g.rule, g.step, g.cut, count(*) filter (good and v > cut) as good, count(*) filter (not good and v > cut) as bad
  from held h join long l on h.rid = l.rid join grid g on g.rule = l.rule group by all
), tests as (
  select c.*, n_good, n_bad, bad / nullif(n_bad, 0) - {quality.WEIGHT} * (good / nullif(n_good, 0)) as gain,
    n_good > 0 and list_sum(list_transform(range(0, good + 1), lambda i: exp(lgamma(n_good + 1.0) - lgamma(i + 1.0)
      - lgamma(n_good - i + 1.0) + i * ln({quality.RISK / len(quality.GRID)}) + (n_good - i) * ln(1 - {quality.RISK / len(quality.GRID)}))))
      <= {quality.DELTA} / ((select count(*) from totals) * {len(quality.GRID)}) as ok
  from counts c join totals t on c.lang is not distinct from t.lang
), stops as (
  select lang, rule, coalesce(min(step) filter (not ok), 1000000) as stop from tests group by lang, rule
), best as (
  select t.lang, t.rule, arg_max(cut, (gain, -step)) as cut
  from tests t join stops s on t.lang is not distinct from s.lang and t.rule = s.rule
  where step < stop and gain > 0 group by t.lang, t.rule
), rejected as (
  select distinct j.rid from judged j join long l on j.rid = l.rid
  join best b on b.rule = l.rule and b.lang is not distinct from j.lang where v > cut
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and r.rid is null as kept
from judged j left join rejected r on j.rid = r.rid
"""

OP10 = f"""
with recursive docs as (
  select doc_id, list_filter(string_split_regex(coalesce({_LOWER.format(t="text")}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as ws
  from documents
), sets as (
  select doc_id, list_sort(list_distinct(case when len(ws) >= 5
    then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end)) as s
  from docs
), classes as (
  select md5(array_to_string(s, chr(10))) as k, min(doc_id) as rep, any_value(s) as s, any_value(len(s)) as n
  from sets where len(s) > 0 group by 1
), posts as (
  select rep, n, unnest(s) as t from classes
), prefix as (
  select rep, n, t from (
    select p.rep, p.n, p.t, row_number() over (partition by p.rep order by f.c, p.t) as k
    from posts p join (select t, count(*) as c from posts group by t) f using (t)
  ) where k <= n - ceil(0.75 * n) + 1
), links as (
  select a.rep as a, b.rep as b from (
    select distinct x.rep as x, y.rep as y from prefix x join prefix y on x.t = y.t and x.rep < y.rep
      and 100 * least(x.n, y.n) >= 75 * greatest(x.n, y.n)
  ) c join classes a on a.rep = c.x join classes b on b.rep = c.y
  where 100 * len(list_intersect(a.s, b.s)) >= 75 * (a.n + b.n - len(list_intersect(a.s, b.s)))
), reach(node, r) as (
  select rep, rep from classes
  union
  select l.b, reach.r from reach join (select a, b from links union select b, a from links) l on l.a = reach.node
), roots as (
  select node, min(r) as root from reach group by node
)
select doc_id, len(sets.s)::bigint as n_shingles, coalesce(r.root, doc_id) as component_id, doc_id = coalesce(r.root, doc_id) as kept
from sets left join classes c on len(sets.s) > 0 and md5(array_to_string(sets.s, chr(10))) = c.k left join roots r on r.node = c.rep
"""

_SPLIT = f"list_filter(string_split_regex({_LOWER.format(t="coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_SPANS = "unnest(list_transform(range(1, len(ws) - width + 2), lambda i: array_to_string(ws[i:i+width-1], ' '))) as s"

OP7 = f"""
with asked as (
  select item_id, {_SPLIT} as ws, least(5, len({_SPLIT})) as width from benchmark where item_id is not null
), items as (
  select item_id, s, count(*) over (partition by item_id) as n
  from (select distinct item_id, {_SPANS} from asked where width > 0)
), docs as (
  select distinct doc_id, key, {_SPANS}
  from (select doc_id, case when doc_id is null then text end as key, {_SPLIT} as ws from documents) d,
    (select distinct width from asked where width > 0) w
  where len(ws) >= width
)
select doc_id, item_id, n::bigint as n_shingles, count(*)::bigint as n_found, count(*) / n as containment
from docs join items using (s) group by doc_id, key, item_id, n having 100 * count(*) >= 75 * n
"""

_ESC = "(length({t}) + length({t}) - length(translate({t}, '\\<#{more}', '')))"
_SEGMENT = chat.SEGMENT * chat.BUDGET
_AHEAD = " + ".join(
    f"(coalesce(lead(opens, {k}) over w and lead(before, {k}) over w - before <= {chat.HISTORY_TOKENS} and not retained, false))::int"
    for k in range(1, chat.HISTORY_TURNS + 1)
)

OP3 = f"""
with recursive turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), placed as (
  select *, (length(text) + 3) // 4 + 4 as tok, row_number() over w as pos,
    first_value(case when role = 'system' then (length(text) + 3) // 4 + 4 else 0 end) over w as system_tok,
    sum((length(text) + 3) // 4 + 4) over w - ((length(text) + 3) // 4 + 4) as before
  from turns window w as (partition by conv_id order by turn nulls first, role, text rows unbounded preceding)
), told as (
  select *, pos = 1 and role = 'system' as retained, before // {_SEGMENT} as segment,
    before - lag(before) over w as back1, before - lag(before, 2) over w as back2
  from placed window w as (partition by conv_id order by pos)
), rooms as (
  select *, {chat.BUDGET} - case when pos = 1 then 0 else system_tok + case
    when pos > 2 + (system_tok > 0)::int and back2 <= {chat.HISTORY_TOKENS} then back2
    when pos > 1 + (system_tok > 0)::int and back1 <= {chat.HISTORY_TOKENS} then back1 else 0 end end as room
  from told
), walk(conv_id, pos, segment, opens, rest) as (
  select conv_id, pos, segment, true, room - tok from rooms where pos = 1
  union all
  select r.conv_id, r.pos, r.segment, r.segment <> w.segment or (r.tok > w.rest and not (r.pos = 2 and r.system_tok > 0)),
    case when r.segment <> w.segment or (r.tok > w.rest and not (r.pos = 2 and r.system_tok > 0)) then r.room else w.rest end - r.tok
  from walk w join rooms r on r.conv_id is not distinct from w.conv_id and r.pos = w.pos + 1
), opened as (
  select r.*, w.opens from rooms r join walk w on r.conv_id is not distinct from w.conv_id and r.pos = w.pos
), windows as (
  select *, {_AHEAD} as ahead, sum(opens::int) over (partition by conv_id) - 1 as last
  from opened window w as (partition by conv_id order by pos)
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '')) as loss_sha256,
  sum((1 + ahead + case when retained then last else 0 end) *
    (6 + {_ESC.format(t="role", more=":")} + {_ESC.format(t="text", more="")} + 8))::bigint as formatted_chars
from windows group by conv_id
"""


def _clusters(k: int, rounds: int, dim: int) -> str:
    """k-means rounds on whole numbers: cells (row, dimension, value) joined with the centroids' cells."""

    def assigned(n: int) -> str:
        return f"""near{n} as (
  select rid, arg_min(c, distance * {k} + c) as c, min(distance) as distance
  from (select a.rid, b.c, sum((a.v - b.v) * (a.v - b.v))::bigint as distance from cells a join c{n} b using (d) group by a.rid, b.c)
  group by rid
)"""

    steps = [assigned(0)]
    for n in range(1, rounds + 1):
        steps += [
            f"""sums{n} as (
  select c, d, sum(v)::hugeint as s, count(*)::hugeint as n from near{n - 1} join cells using (rid) group by c, d
), c{n} as (
  select c, d, coalesce((s - ((s % n) + n) % n) // n, v)::bigint as v from c{n - 1} left join sums{n} using (c, d)
)""",
            assigned(n),
        ]
    return f"""
with kept as (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda e: floor(64 * e::double)::bigint) as x
  from embeddings
  where len(embedding) = {dim} and len(list_filter(embedding, lambda e: coalesce(isfinite(e), false))) = {dim}
), cells as (
  select rid, unnest(range(1, {dim} + 1)) as d, unnest(x) as v from kept
), c0 as (
  select c, d, v from cells join (
    select rid, row_number() over (order by sha256('1:' || vec_id::varchar) nulls last, x) - 1 as c from kept qualify c < {k}
  ) using (rid)
), {", ".join(steps)}, told as (
  select c, sha256(string_agg(v::varchar, ',' order by d)) as centroid_sha256 from c{rounds} group by c
)
select vec_id, c::int as cluster, distance, (sum(distance) over (partition by c))::bigint as cluster_inertia,
  (sum(distance) over ())::bigint as inertia, centroid_sha256
from near{rounds} join kept using (rid) join told using (c)
"""


ORACLES: dict[str, str] = {
    "op3_chat_windows": OP3,
    "op7_decontamination": OP7,
    "op10_near_dedup": OP10,
    "op1_quality_rules": OP1,
    "op2_mixing": OP2,
    "op8_line_dedup": OP8,
    "op13_centroids": _clusters(16, 3, 64),
}


def _on(sql: str, table: str) -> str:
    """The query over another table of documents."""
    return sql.replace("from documents", f"from {table}")


_LINES = _on(OP8, "s1").replace("sha256(", "(").replace("as kept_sha256", "as kept_text")
PIPELINE = f"""
with s1 as materialized (
  select d.* from documents d join ({OP1}) q on d.doc_id = q.doc_id where q.kept
), s2 as materialized (
  select d.doc_id, case when n_dropped > 0 then kept_text else text end as text, lang, source,
    case when n_dropped > 0 then length(kept_text) else n_chars end as n_chars
  from s1 d join ({_LINES}) q on d.doc_id = q.doc_id
), s3 as materialized (
  select d.* from s2 d join ({_on(OP10, "s2")}) q on d.doc_id = q.doc_id where q.kept
), s4 as materialized (
  select * from s3 where doc_id not in (select doc_id from ({_on(OP7, "s3")}) where doc_id is not null)
)
select d.*, unnest(range(1, 1 + (q.whole + q.extra)::bigint)) as copy
from s4 d join ({_on(OP2, "s4").replace("select doc_id, size, source_size, target,", "select doc_id, whole, case when miss < rest and bin < cut then 1 else 0 end as extra,")}) q
  on d.doc_id = q.doc_id
"""
