"""DuckDB SQL for the training-data queries that SQL can express on small tables."""

from __future__ import annotations

from .secrets import ALLOWED, CLASSES, LEAST, PLACEHOLDERS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP8_SQL = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) >= 5 then [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as o from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * o >= 75 * (a.n + b.n - o)),
e as (select x, y from l union select y, x from l),
r(x, y) as (select doc_id, doc_id from w union select r.x, e.y from r join e on r.y = e.x)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r.y) as component_id from w left join n on w.doc_id = n.doc_id join r on r.x = w.doc_id group by 1, 2"""


def _found(name: str, regex: str, group: int = 0) -> str:
    """Spans of a pattern's matches: the text between them is split off by the same pattern, and lengths add up."""
    return (
        f"{name} as (select doc_id, j, m[j] as m, v[j] as v, "
        f"coalesce(list_sum([length(x) for x in b[1:j]]), 0)::bigint + coalesce(list_sum([length(x) for x in m[1:j - 1]]), 0)::bigint as s from "
        f"(select doc_id, m, v, b, unnest(range(1, len(m) + 1)) as j from (select doc_id, regexp_extract_all(t, '{regex}') as m, regexp_extract_all(t, '{regex}', {group}) as v, string_split_regex(t, '{regex}') as b from d)))"
    )


_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def op3_sql() -> str:
    kind = " ".join(f"when regexp_matches(m, '{c.pattern}') then {i}" for i, c in enumerate(CLASSES))
    names = " ".join(f"when {i} then '{c.name}'" for i, c in enumerate(CLASSES))
    window = " ".join(f"when {i} then {c.window}" for i, c in enumerate(CLASSES))
    bits = " ".join(f"when {i} then {c.bits}::double" for i, c in enumerate(CLASSES))
    allowed = " and ".join(f"not regexp_matches(m, '{p}')" for p in ALLOWED)
    made_up = f"[A-Za-z0-9]*(?i:{PLACEHOLDERS})[A-Za-z0-9]*"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
{_found('a', _ASSIGN, 2)},
{_found('k', 'AKIA[A-Z0-9]+')},
{_found('h', '[0-9a-f]+')},
pieces as (select doc_id, j, g[j] as t, coalesce(list_sum([length(x) for x in g[1:j - 1]]), 0)::bigint + coalesce(list_sum([length(x) for x in f[1:j - 1]]), 0)::bigint as pos
  from (select doc_id, g, f, unnest(range(1, len(g) + 1)) as j from (select doc_id, string_split_regex(t, '{made_up}') as g, regexp_extract_all(t, '{made_up}') as f from d))),
c as (select doc_id, piece, j, m[j] as m, pos + coalesce(list_sum([length(x) for x in b[1:j]]), 0)::bigint + coalesce(list_sum([length(x) for x in m[1:j - 1]]), 0)::bigint as s from
  (select doc_id, piece, pos, m, b, unnest(range(1, len(m) + 1)) as j from (select doc_id, j as piece, pos, regexp_extract_all(t, '[A-Za-z0-9+/_=-]+') as m, string_split_regex(t, '[A-Za-z0-9+/_=-]+') as b from pieces))),
q as (select doc_id, piece, j, m, s, case {kind} end as c from c where length(m) >= {LEAST} and {allowed}),
z as (select doc_id, piece, j, m, s, c, case c {window} end as w, unnest(range(1, length(m) - case c {window} end + 2)) as i from q),
y as (select doc_id, piece, j, s, c, w, i, unnest(string_split(substr(m, i, w), '')) as ch from z),
x as (select doc_id, piece, j, s, c, w, i, ch, count(*) as n from y group by all),
u as (select doc_id, piece, j, s, c, w, i, -sum(n / w::double * log2(n / w::double)) as bits from x group by all),
v as (select doc_id, s + min(i) - 1 as s, s + max(i) - 1 + w as e, c from u where bits >= case c {bits} end - 1e-9 group by doc_id, piece, j, s, c, w),
f as (select doc_id, s, 0 as o, s + length(m) as e, 'assign' as kind from a where length(v) >= 6
  union all select doc_id, s, 1, s + length(m), 'access' from k where length(m) >= 20
  union all select doc_id, s, 2, s + length(m), 'hex' from h where length(m) >= 24
  union all select doc_id, s, 3 + c, e, case c {names} end from v),
g as (select doc_id, count(*) filter (o = 0) as n_assign, count(*) filter (o = 1) as n_access, count(*) filter (o = 2) as n_hex,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, o, e) filter (o < 3), '') as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, o, e) as spans from f group by 1)
select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (doc_id)"""
