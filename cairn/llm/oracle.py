"""SQL of the queries that SQL can express."""

from __future__ import annotations

from .host_reputation import SECOND_LEVEL, SHARED

_HOST = "translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"

OP2 = """
with records as (select page_id, coalesce(html, '') as payload from pages),
digests as (select page_id, strlen(payload) as payload_bytes, sha1(payload) as hex, max(page_id) over (partition by payload) as response_id from records),
spelled as (select *, list_transform(range(0, 8), lambda g: ('0x' || substr(hex, 1 + 5 * cast(g as int), 5))::bigint) as parts from digests)
select page_id, payload_bytes,
  list_reduce(list_prepend('', list_transform(parts, lambda v: concat(
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + (v >> 15) as int), 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + ((v >> 10) & 31) as int), 1),
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + ((v >> 5) & 31) as int), 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + (v & 31) as int), 1)))), lambda a, b: a || b) as payload_digest,
  case when page_id is not distinct from response_id then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from response_id then response_id end as refers_to
from spelled"""


def op3(rules: list[tuple[str, str, str]], z: float = 1.64, limit: float = 0.5) -> str:
    fits = lambda r: f"(host = '{r[0]}' or host like '%.{r[0]}') and starts_with(path, '{r[1]}')"
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    name = "case " + " ".join(f"when {fits(r)} then '{r[0]}{r[1]}'" for r in longest) + " end"
    said = "case " + " ".join(f"when {fits(r)} then '{r[2]}'" for r in longest) + " end"
    m = lambda t: f"(select 1 / least(greatest(coalesce((sum(n * (k * 1.0 / n - mu) ** 2) - sum(mu * (1 - mu))) / nullif(sum((n - 1) * mu * (1 - mu)), 0), 0), 0.0001), 0.999) - 1 from {t} where n > 0)"
    shared = " ".join(f"when name = '{e}' or name like '%.{e}' then '{e}'" for e in sorted(SHARED, key=lambda e: (-e.count("."), e)))
    second = "|".join(SECOND_LEVEL)
    return f"""
with named as (select page_id, {_HOST} as host, {_PATH} as path from pages),
outcomes as (select doc_id::varchar as doc, max(greatest(1 - quality, toxic)) as bad from labels group by 1 having max(greatest(1 - quality, toxic)) is not null),
numbered as (select host, ltrim(regexp_extract(path, '^/[^/]+/([0-9]+)(/|$)', 1), '0') as cut, regexp_extract(path, '^/[^/]+/([0-9]+)(/|$)', 1) as raw from named),
counted as (select host, count(*) as n, sum(bad) as k from numbered join outcomes on raw <> '' and doc = case when cut = '' then '0' else cut end group by 1),
seen as (select host, coalesce(n, 0) as n, coalesce(k, 0) as k, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '[.]$', '') as name from (select distinct host from named) left join counted using (host)),
suffixed as (select *, case when regexp_matches(name, '^[0-9]+([.][0-9]+){{3}}$|^[[]') then 'ip' {shared} when regexp_matches(name, '(^|[.])({second})[.][a-z]{{2}}$') then array_to_string(string_split(name, '.')[-2:], '.') else string_split(name, '.')[-1] end as suffix from seen),
hosts as (select host, n, k, suffix, case when suffix = 'ip' then name else array_to_string(list_slice(string_split(name, '.'), -1 - len(string_split(suffix, '.')), -1), '.') end as domain from suffixed),
domains as (select domain, suffix, sum(n) as n, sum(k) as k from hosts group by 1, 2), suffixes as (select suffix, sum(n) as n, sum(k) as k from domains group by 1),
s as (select *, (select (sum(k) + 0.5) / (sum(n) + 1) from suffixes) as mu from suffixes),
d as (select domains.*, (s.mu * {m('s')} + s.k) / (s.n + {m('s')}) as mu from domains join s using (suffix)),
h as (select hosts.*, (d.mu * {m('d')} + d.k) / (d.n + {m('d')}) as mu from hosts join d using (domain)),
beta as (select host, mu * {m('h')} + k as a, (1 - mu) * {m('h')} + n - k as b from h),
judged as (select host, case when a / (a + b) - {z} * sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) > {limit} then 'block' else 'allow' end as judged from beta)
select page_id, named.host, path, {name.replace('host', 'named.host')} as rule, coalesce({said.replace('host', 'named.host')}, judged) as verdict from named join judged on named.host = judged.host"""

_FINITE = "embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)) || [true])"

OP11 = f"""
with one as (select vec_id, unnest(min({{'label': (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint,
    'q': list_transform(embedding, lambda x: greatest(-4194304, least(4194304, floor(x::double * 256)))::bigint)}})) from embeddings where vec_id is not null and label is not null and {_FINITE} group by vec_id),
scored as (select a.vec_id as anchor_id, a.label as own, b.vec_id, b.label, list_dot_product(a.q::double[], b.q::double[])::bigint as score from one a join one b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
positives as (select anchor_id, vec_id as positive_id, score as positive_score from scored where label = own qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank, vec_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id) where label <> own and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score qualify rank <= 3"""


def op12(rounds: int = 4, entries: int = 256, parts: int = 4) -> str:
    place = f"(pos // (select (max(len(q)) + {parts - 1}) // {parts} from kept))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""near{r} as materialized (select id, part, min({{'d': d, 'entry': entry}}) as best from (
    select p.id, p.part, c.entry, sum((p.v - c.v) * (p.v - c.v))::bigint as d from flat p join book{r} c on p.part = c.part and p.pos = c.pos group by 1, 2, 3) group by 1, 2)""")
        if r < rounds:
            steps.append(f"""book{r + 1} as materialized (select c.part, c.entry, c.pos, coalesce(m.v, c.v) as v from book{r} c left join (
    select p.part, n.best.entry as entry, p.pos, floor(sum(p.v)::double / count(*))::bigint as v from flat p join near{r} n on p.id = n.id and p.part = n.part group by 1, 2, 3) m on c.part = m.part and c.entry = m.entry and c.pos = m.pos)""")
    return f"""
with kept as materialized (select row_number() over (order by vec_id, list_transform(embedding, lambda x: floor(x::double * 1024)::bigint), label) as id, vec_id, label, list_transform(embedding, lambda x: floor(x::double * 1024)::bigint) as q
    from embeddings where {_FINITE}),
flat as materialized (select id, {place} as part, pos, v from (select id, unnest(q) as v, generate_subscripts(q, 1) - 1 as pos from kept)),
book0 as materialized (select part, id - 1 as entry, pos, v from flat where id <= {entries}),
{', '.join(steps)},
digest as (select sha256(string_agg(v::varchar, ',' order by part, entry, pos)) as codebooks_sha256 from book{rounds}),
coded as (select id, string_agg(printf('%02x', best.entry::int), '' order by part) as code, sum(best.d)::bigint as error from near{rounds} group by 1),
labels as (select label, sum(error)::bigint as label_error from coded join kept using (id) group by 1)
select vec_id, code, error, label_error, codebooks_sha256 from coded join kept using (id) join labels on kept.label is not distinct from labels.label cross join digest"""
