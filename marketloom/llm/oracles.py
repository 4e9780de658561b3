"""SQL for comparison, for the operators that SQL can express."""

from __future__ import annotations

_KEPT = """
k as (
  select row_number() over (order by vec_id) - 1 as n, vec_id, label, [floor(1024 * x::double) for x in embedding] as v
  from embeddings
  where len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0
),
s as materialized (
  select n, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] as v from k, range(4) t(p)
),
c0 as materialized (select p, n as e, v from s where n < 256)
"""

_ROUND = """
a{i} as materialized (
  select s.n, s.p, any_value(s.v) as v,
    min((list_inner_product(s.v, s.v) - 2 * list_inner_product(s.v, c.v) + list_inner_product(c.v, c.v))::hugeint * 256 + c.e) as best
  from s join c{i} c on s.p = c.p group by s.n, s.p
)
"""

_MEANS = """
m{i} as (
  select p, best % 256 as e, j, sum(v[j])::hugeint as t, count(*) as r from a{i}, lateral (select unnest(range(1, len(v) + 1)) as j) group by all
),
c{j} as materialized (
  select c.p, c.e, coalesce(w.v, c.v) as v
  from c{i} c left join (select p, e, list(((t - ((t % r) + r) % r) / r)::double order by j) as v from m{i} group by p, e) w on c.p = w.p and c.e = w.e
)
"""


def product_codes() -> str:
    """op11: four rounds of nearest entries and floored means, each a join of all parts with their codebook."""
    steps = [_KEPT]
    for i in range(4):
        steps += [_ROUND.format(i=i), _MEANS.format(i=i, j=i + 1)]
    steps.append(_ROUND.format(i=4))
    return f"""
with {','.join(steps)},
o as (
  select n, string_agg(printf('%02x', (best % 256)::int), '' order by p) as code, sum(best // 256)::bigint as error from a4 group by n
)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
  (select sha256(string_agg(x::bigint::varchar, ',' order by p, e, j)) from (select p, e, unnest(v) as x, unnest(range(len(v))) as j from c4)) as codebooks_sha256
from o join k using (n)
"""


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: op12: windows of items joined with the documents' word runs of the same length.
DECONTAMINATION = f"""
with i as (select item_id, {_WORDS.format("text")} as w from benchmark where text is not null),
b as (
  select distinct item_id, len(g) as n, g from (
    select item_id, w[j : j + 9] as g from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as j from i where len(w) > 0)
  )
),
d as materialized (select row_number() over () as r, doc_id, coalesce({_WORDS.format("text")}, []) as w from documents),
g as (select r, n, j, w[j : j + n - 1] as g from (select r, w, n, unnest(range(1, len(w) - n + 2)) as j from d, (select distinct n from b))),
m as materialized (select r, j, b.n, item_id from g join b on g.n = b.n and g.g = b.g),
h as (select r, count(distinct k) as n_hit from (select r, unnest(range(j, j + n)) as k from m) group by r),
t as (select r, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as items from (select distinct r, item_id from m) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (r) left join t using (r)
"""
