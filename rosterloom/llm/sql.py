"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from .fingerprints import BOUNDS, ENOUGH, HIGH, LOW, TIER
from .jaccard import SHINGLE, THRESHOLD
from .lexical import TERM_RX, TOP
from .linededup import MIN_WORDS
from .mixing import SCHEDULES, WEIGHTS
from .periodic import MIN_WORDS as LEAST_RUN

SQL: dict[str, str] = {}

_TERMS = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '[\x00-/:-@\[-`{{-\x7F]+'), lambda x: x <> ''))"

_LIKE = f"""(select coalesce(max(same::double / used) filter (used >= {ENOUGH}), sum(same)::double / greatest(1, sum(used))) from (
    select count(*) filter (x = y and x <> '-') as same, count(*) filter (x is distinct from '-' and x is not null or y is distinct from '-' and y is not null) as used from (
      select unnest(string_split({{0}}, '.')) as x, unnest(string_split({{1}}, '.')) as y, unnest(range(greatest(len(string_split({{0}}, '.')), len(string_split({{1}}, '.'))))) as r)
    group by r // {TIER}))"""

_WORD = r"[^\x20\x09-\x0D]+"

# least windows of enough words, from their first line on and up to their last; each but its first occurrence goes
SQL["op1_line_dedup"] = rf"""
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as k from documents where text is not null),
w as (
  select *, len(regexp_extract_all(line, '{_WORD}')) as n, count(*) filter (n > 0) over (partition by doc_id order by k) as before from l),
f as (
  select doc_id, line, n, before as pos, sum(n) over (partition by doc_id order by k) as upto from w where n > 0),
held as (
  select a.doc_id, a.pos as s, b.pos as e from f a join f b on a.doc_id = b.doc_id and b.pos between a.pos and a.pos + {MIN_WORDS - 1} where b.upto - a.upto + a.n >= {MIN_WORDS}),
windows as (
  select doc_id, s, min(e) as e from held group by doc_id, s union select doc_id, max(s), e from held group by doc_id, e),
content as (
  select x.doc_id, s, e, string_agg(line, chr(10) order by pos) as c from windows x join f on f.doc_id = x.doc_id and f.pos between s and e group by all),
later as (
  select doc_id, s, e from (select *, row_number() over (partition by c order by doc_id, s) as rn from content) where rn > 1),
gone as (
  select distinct f.doc_id, f.pos from later x join f on f.doc_id = x.doc_id and f.pos between s and e),
marked as (
  select w.*, a.pos is not null and (n > 0 or b.pos is not null) as drop from w left join gone a on a.doc_id = w.doc_id and a.pos = w.before left join gone b on b.doc_id = w.doc_id and b.pos = w.before + 1)
select doc_id, coalesce(string_agg(line, chr(10) order by k) filter (not drop), '') as text, count(*) filter (drop)::int as lines_removed, coalesce(sum(n) filter (drop), 0)::int as words_removed from marked group by 1
union all select doc_id, null, 0, 0 from documents where text is null
"""

SQL["op6_jaccard"] = rf"""
with recursive texts as (
  select row_number() over () as id, text, min(doc_id) as first, regexp_extract_all(text, '{_WORD}') as w from documents where regexp_matches(text, '{_WORD}') group by text),
shingles as (
  select distinct id, unnest(case when len(w) < {SHINGLE} then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) end) as x from texts),
sizes as (
  select id, count(*) as n from shingles group by 1),
half as (
  select a.id as u, b.id as v from shingles a join shingles b on a.x = b.x and a.id < b.id join sizes m on m.id = a.id join sizes n on n.id = b.id
  where least(m.n, n.n) >= {THRESHOLD} * greatest(m.n, n.n) group by a.id, b.id, m.n, n.n having count(*) >= {THRESHOLD} * (m.n + n.n - count(*)) - 1e-6),
edges as (
  select u, v from half union all select v, u from half),
cc(node, comp) using key (node) as (
  select id, first from texts union
  (select e.v, min(c.comp) from cc c join edges e on c.node = e.u join recurring.cc r on r.node = e.v where c.comp < r.comp group by e.v))
select d.doc_id, coalesce(cc.comp, d.doc_id) as class_id, (select count(*) from edges where u = t.id) as n_links
from documents d left join texts t on t.text = d.text left join cc on cc.node = t.id
"""

SQL["op3_sharding"] = "select doc_id, lang, source, n_chars, md5(text) as text_md5, true as compacted from documents"

SQL["op7_fingerprints"] = f"""
with base as (
  select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n from documents),
nexts as (
  select *, coalesce(lead(doc_id) over (order by doc_id), min(doc_id) over ()) as next_id,
    coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id)) as next_text from base),
texts as (
  select *, left(text, (n - n // 4)::int) || left(next_text, (n // 4)::int) as edited from nexts),
held as (
  select term, count(*) as df from (select unnest({_TERMS.format("text")}) as term from base) group by term),
lexicon as (
  select term, [{", ".join(f"substring(md5(term || ':{r}'), 1, 3) < '{b}'" for r, b in enumerate(BOUNDS))}] as members from held
  where df >= greatest(2, {LOW} * (select count(*) from base)) and df <= {HIGH} * (select count(*) from base)),
both_texts as (
  select doc_id, false as is_edited, text as t from texts union all select doc_id, true, edited from texts),
found as (
  select doc_id, is_edited, r, substring(md5(string_agg(term, ' ' order by term)), 1, 6) as part from (
    select doc_id, is_edited, term, unnest(range({len(BOUNDS)})) as r, members from (
      select b.doc_id, b.is_edited, l.term, l.members from (select doc_id, is_edited, unnest({_TERMS.format("t")}) as term from both_texts) b join lexicon l using (term)))
  where members[r + 1] group by all),
prints as (
  select b.doc_id, b.is_edited, b.t, case when count(f.part) = 0 then 'whole:' || md5(any_value(b.t))
    else string_agg(coalesce(f.part, '-'), '.' order by g.r) end as fingerprint
  from both_texts b cross join range({len(BOUNDS)}) g(r) left join found f on f.doc_id = b.doc_id and f.is_edited = b.is_edited and f.r = g.r
  group by b.doc_id, b.is_edited, b.t),
joined as (
  select x.doc_id, x.n as n_chars, sha256(x.edited) as edited_sha256, a.fingerprint, e.fingerprint as edited_fingerprint, o.fingerprint as next_fingerprint
  from texts x join prints a on a.doc_id = x.doc_id and not a.is_edited join prints e on e.doc_id = x.doc_id and e.is_edited
  join prints o on o.doc_id = x.next_id and not o.is_edited)
select doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  {_LIKE.format("fingerprint", "edited_fingerprint")} as near_edited,
  {_LIKE.format("fingerprint", "next_fingerprint")} as near_next from joined
"""


def _when_trained(q: str) -> str:
    """The inverse of the integrated schedules, at the part ``q`` of a source's demand."""
    out = []
    for k, knots in enumerate(SCHEDULES):
        spans = list(zip(knots, knots[1:], strict=False))
        areas = [(t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in spans]
        total, done, cases = sum(areas), 0.0, ""
        for ((t0, a), (t1, b)), area in zip(spans, areas, strict=True):
            need, slope = f"({q} * {total!r}::double - {done!r}::double)", (b - a) / (t1 - t0)
            at = f"{t0!r}::double + {need} / {a!r}::double" if slope == 0 else f"{t0!r}::double + (sqrt(greatest(0::double, {a * a!r}::double + {2 * slope!r}::double * {need})) - {a!r}::double) / {slope!r}::double"
            done += area
            cases += f" when {q} * {total!r}::double <= {done!r}::double then {at}"
        out.append(f"when place % {len(SCHEDULES)} = {k} then (case{cases} else 1::double end)")
    return f"least(1::double, greatest(0::double, case {' '.join(out)} end))"


SQL["op8_mixing"] = rf"""
with base as (
  select doc_id, source, md5(coalesce(doc_id::varchar, '')) as k, text,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place from base group by source),
weighed as (
  select *, [{", ".join(f"{w!r}::double" for w in WEIGHTS)}][place % {len(WEIGHTS)} + 1] as w, source_size * 2.0::double as cap from sources),
summed as (
  select *, sum(source_size) over () * 1.5::double as demand, sum(w) over () as w_all,
    coalesce(sum(cap) over lower_caps, 0) as cap_before, coalesce(sum(w) over lower_caps, 0) as w_before
  from weighed window lower_caps as (order by cap / w, place rows between unbounded preceding and 1 preceding)),
levels as (
  select *, case when (demand - cap_before) / (w_all - w_before) <= cap / w then (demand - cap_before) / (w_all - w_before) end as level from summed),
targets as (
  select source, source_size, place, least(cap, max(level) over () * w) as target from levels),
placed as (
  select b.doc_id, b.size, t.source_size, t.place, t.target, floor(t.target + 0.5)::bigint as goal,
    (coalesce(sum(b.size) over (partition by b.source order by b.k, b.size, b.text rows between unbounded preceding and 1 preceding), 0))::bigint as start
  from base b join targets t on b.source is not distinct from t.source),
epochs as (
  select *, greatest(0, least(size, goal - start)) as e0, greatest(0, least(size, goal - source_size - start)) as e1,
    start / greatest(goal, 1)::double as q0, (start + source_size) / greatest(goal, 1)::double as q1 from placed)
select doc_id, size, source_size, target, (e0 + e1)::bigint as taken,
  case when e0 > 0 then {_when_trained("q0")} end as position,
  case when e1 > 0 then {_when_trained("q1")} end as position_2
from epochs
"""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op12_lexical_search"] = rf"""
with terms as (
  select k, doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '{TERM_RX}')) as term from (select row_number() over () as k, doc_id, text from documents)),
tfs as (
  select k, any_value(doc_id) as doc_id, term, count(*) as tf from terms group by k, term),
sizes as (
  select k, count(*) as n from terms group by k),
whole as (
  select count(*) as docs, sum(n)::bigint as terms from sizes),
ms as (
  select k, 75 + (25 * n * docs) // terms as m from sizes, whole),
weights as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w from (select term, count(*) as df from tfs group by term), whole),
asked as (
  select item_id, item_text, term, count(*) as times from (
    select item_id, text as item_text, unnest(regexp_extract_all({_LOWER.format("text")}, '{TERM_RX}')) as term from (select distinct item_id, text from benchmark)) group by all),
scored as (
  select a.item_id, a.item_text, t.k, any_value(t.doc_id) as doc_id, sum(a.times * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 12 * ms.m)))::bigint as score
  from asked a join tfs t using (term) join ms using (k) join weights w using (term) group by a.item_id, a.item_text, t.k),
numbered as (
  select item_id, row_number() over (partition by item_id, item_text order by score desc, doc_id nulls last)::int as rank, doc_id, score from scored where score > 0)
select item_id, rank, doc_id, score from numbered where rank <= {TOP}
"""

# the CRC-32 of the decimal id, bit by bit
_CRC = "xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::ubigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), list_value(0, 0, 0, 0, 0, 0, 0, 0)::ubigint[]), lambda x, z: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)), 4294967295::ubigint)"

# equal words of a document by distance; consecutive ones at one distance are a stretch with that period
SQL["op13_periodic_runs"] = rf"""
with base as (
  select row_number() over () as k, doc_id, coalesce(regexp_extract_all(text, '{_WORD}'), []) as w, {_CRC} as h from documents),
sized as (
  select *, len(w)::bigint as n, (h // 10)::bigint as g from base),
cut as (
  select *, case when h % 10 = 0 and n > 0 then g % n else n end as a from sized),
looped as (
  select *, 1 + (n - a) // (3 + g % 8) as p from cut),
words as (
  select k, n, i, w[1 + case when i < a then i else a + (i - a) % p end] as word from (select *, unnest(range(n)) as i from looped)),
pairs as (
  select x.k, y.i - x.i as d, x.i from words x join words y on x.k = y.k and x.word = y.word and y.i > x.i and 2 * (y.i - x.i) <= x.n),
stretches as (
  select k, d, min(i) as s, count(*) + d as length from (select k, d, i, i - row_number() over (partition by k, d order by i) as z from pairs)
  group by k, d, z having count(*) >= d and count(*) + d >= {LEAST_RUN}),
runs as (
  select k, s, length, min(d) as period from stretches group by k, s, length),
gone as (
  select distinct w.k, w.i from runs r join words w on w.k = r.k and w.i >= r.s + r.period and w.i < r.s + r.length),
collapsed as (
  select w.k, string_agg(w.word, ' ' order by w.i) as t from words w anti join gone g on g.k = w.k and g.i = w.i group by w.k),
best as (
  select *, row_number() over (partition by k order by length desc, s, period) as rn from runs),
told as (
  select k, count(*) as n_runs, string_agg(concat_ws(',', s, length, period) || chr(10), '' order by s, period) as t from runs group by k)
select b.doc_id, coalesce(t.n_runs, 0)::bigint as n_runs, r.s::bigint as start, r.length::bigint as length, r.period::bigint as period, (1000 * r.length // r.period)::bigint as exponent_milli,
  sha256(coalesce(t.t, '')) as runs_sha256, sha256(coalesce(c.t, '')) as collapsed_sha256
from base b left join best r on r.k = b.k and r.rn = 1 left join told t on t.k = b.k left join collapsed c on c.k = b.k
"""
