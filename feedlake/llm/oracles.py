"""DuckDB SQL for the queries that SQL can express.

The others (tokenizers, similarity components, packing, models, neighbour
search, spans) are tested against brute force or on held-out rows.
"""

from __future__ import annotations

URL_FILTERS = """
with parts as (
  select page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages
),
rules(verdict, rule, host_part, path_part) as (
  values ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
         ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
         ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')
),
fits as (
  select p.page_id, p.host, p.path, arg_max(r.rule, length(r.rule)) as rule, arg_max(r.verdict, length(r.rule)) as verdict
  from parts p left join rules r
    on (p.host = r.host_part or suffix(p.host, '.' || r.host_part)) and starts_with(p.path, r.path_part)
  group by all
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict, false as inherited from fits
"""

CHAT_FORMATTING = """
with turns as (
  select *, row_number() over (partition by conv_id order by turn, role, text) - 1 as pos
  from (select distinct conv_id, turn, role, text from conversations where conv_id is not null)
),
prefixes as (
  select conv_id, pos, role, text,
         md5(string_agg(md5(role) || md5(text), '') over (partition by conv_id order by pos)) as prefix,
         max(pos) over (partition by conv_id) as last_pos
  from turns
),
kept as (
  select min(conv_id) as conv_id, last_pos + 1 as n_turns
  from prefixes where pos = last_pos and (pos, prefix) not in (select (pos, prefix) from prefixes where pos < last_pos)
  group by last_pos, prefix
)
select p.conv_id, cast(floor(p.pos / 256) as integer) as part, cast(k.n_turns as bigint) as n_turns,
       string_agg('<|' || p.role || '|>' || chr(10) || p.text || chr(10), '' order by p.pos) as text
from prefixes p join kept k using (conv_id)
group by all
"""

SOURCE_MIXING = r"""
with docs as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         md5(':' || coalesce(cast(doc_id as varchar), 'null') || ':' || md5(coalesce(text, ''))) as number
  from documents
),
sized as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as no
  from docs group by source
),
weighed as (select *, source_size * 3 as cap, [1, 2, 3][no % 3 + 1] as w from sized),
filled as (
  select *, sum(cap) over up as caps, sum(w) over up as ws, sum(source_size) over () as total, sum(w) over () as share,
         lead(cap / w) over up as next_ratio
  from weighed window up as (order by cap / w, no rows unbounded preceding)
),
-- the fewest sources at their limit that leave all others below theirs
levels as (
  select 0 as k, total::bigint::double / share::bigint::double as level, min(cap / w) as next_ratio from filled group by total, share
  union all
  select row_number() over (order by cap / w, no), (total - caps)::bigint::double / (share - ws)::bigint::double, next_ratio
  from filled where share > ws
),
level as (select level from levels where next_ratio > level order by k limit 1),
goals as (
  select source, no, source_size, coalesce(least(cap::double, w * (select level from level)), cap::double) as target from weighed
),
drawn as (
  select d.*, no, source_size, target, case when source_size > 0 then least(target / source_size, 3.0::double) else 0 end as expected,
         (('0x' || substr(number, 1, 13))::bigint + 0.5::double) / 4503599627370496::double as u
  from docs d join goals g on d.source is not distinct from g.source
),
odds as (
  select *, floor(expected) as certain, expected - floor(expected) as p from drawn
),
ranked as (
  select *, (u / (1 - u)) * case when p > 0 then (1 - p) / p else 'inf'::double end as q from odds
),
runs as (
  select *, target - sum(certain * size) over (partition by no) as open,
         coalesce(sum(size) over (partition by no order by q, number rows between unbounded preceding and 1 preceding), 0) as before,
         row_number() over (partition by no order by q, number) as place
  from ranked
),
first as (select *, (size > 0 and certain < 3 and before + size <= open)::int as extra from runs),
gaps as (select *, open - sum(extra * size) over (partition by no) as gap from first),
last as (
  select no, arg_min(place, (abs(size - gap), q, number)) as place
  from gaps where extra = 0 and size > 0 and certain < 3 and abs(size - gap) < gap group by no
)
select doc_id, size::bigint as size, source_size, target,
       (size * (certain + extra + (l.place is not null)::int))::bigint as taken
from gaps g left join last l on g.no = l.no and g.place = l.place
"""


def _integers(scale: int, dims: int) -> str:
    """Usable vectors as (id, pos, v): a row per component."""
    return f"""kept as (
  select vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v
  from embeddings where len(embedding) = {dims} and len(list_filter(embedding, lambda x: isfinite(x))) = {dims}
)"""


def centroid_clustering(k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64) -> str:
    """Lloyd's rounds written out one after the other."""
    steps = [
        f"with {_integers(scale, dims)}",
        f"""c0 as (
  select row_number() over (order by sha256('1:' || vec_id)) - 1 as c, v
  from kept qualify c < {k}
)""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} as (
  select vec_id, v, arg_min(c, (d, c)) as c, min(d) as d
  from (
    select k.vec_id, k.v, c.c, list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
    from kept k cross join c{r} c
  ) group by vec_id, v
)""")
        if r < rounds:
            steps.append(f"""m{r} as (
  select c, list(f order by pos) as v from (
    select c, pos, (sum(x)::bigint - (((sum(x)::bigint % count(*)) + count(*)) % count(*))) // count(*) as f
    from (select c, unnest(v) as x, generate_subscripts(v, 1) as pos from a{r}) group by c, pos
  ) group by c
),
c{r + 1} as (select c.c, coalesce(m.v, c.v) as v from c{r} c left join m{r} m using (c))""")
    return ",\n".join(steps) + f"""
select vec_id, c::int as cluster, d as distance, (sum(d) over (partition by c))::bigint as cluster_inertia,
       (sum(d) over ())::bigint as inertia, sha256(array_to_string(e.v, ',')) as centroid_sha256
from a{rounds} a join c{rounds} e using (c)
"""


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, dims: int = 64) -> str:
    """Codebook rounds written out one after the other."""
    width = dims // parts
    steps = [
        f"with {_integers(scale, dims)}",
        f"""parts as (
  select vec_id, label, p, v[p * {width} + 1:(p + 1) * {width}] as v from kept, unnest(range({parts})) t(p)
)""",
        f"""c0 as (
  select p, dense_rank() over (order by vec_id) - 1 as e, v from parts qualify e < {entries}
)""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} as materialized (
  select vec_id, any_value(label) as label, p, any_value(v) as v, arg_min(e, (d, e)) as e, min(d) as d
  from (
    select k.vec_id, k.label, k.p, k.v, c.e,
           list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
    from parts k join c{r} c using (p)
  ) group by vec_id, p
)""")
        if r < rounds:
            steps.append(f"""m{r} as (
  select p, e, list(f order by pos) as v from (
    select p, e, pos, (sum(x)::bigint - (((sum(x)::bigint % count(*)) + count(*)) % count(*))) // count(*) as f
    from (select p, e, unnest(v) as x, generate_subscripts(v, 1) as pos from a{r}) group by p, e, pos
  ) group by p, e
),
c{r + 1} as materialized (select c.p, c.e, coalesce(m.v, c.v) as v from c{r} c left join m{r} m using (p, e))""")
    return ",\n".join(steps) + f""",
coded as (
  select vec_id, any_value(label) as label, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error
  from a{rounds} group by vec_id
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
       (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) from c{rounds}) as codebooks_sha256
from coded
"""


ORACLES: dict[str, str] = {
    "op1_url_filters": URL_FILTERS,
    "op4_chat_formatting": CHAT_FORMATTING,
    "op11_centroid_clustering": centroid_clustering(),
    "op12_source_mixing": SOURCE_MIXING,
    "op13_vector_codes": vector_codes(),
}
