"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _shingles(table: str, key: str) -> str:
    words = _WORDS.format(_LOWER.format("coalesce(text, '')"))
    return (
        f"select {key}, unnest(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) "
        f"when len(w) > 0 then [array_to_string(w, ' ')] else []::varchar[] end)) as g from (select {key}, {words} as w from {table})"
    )


OP2 = f"""
with d as ({_shingles("documents", "doc_id")}), q as ({_shingles("benchmark", "item_id")}),
n as (select item_id, count(*) as n_item from q group by item_id),
hits as (select d.doc_id, q.item_id, count(*) as n_shared from d join q using (g) group by d.doc_id, q.item_id)
select doc_id, hits.item_id, n_shared, n_item, n_shared / n_item as containment from hits join n using (item_id) where n_shared >= 0.75 * n_item
"""

_SPACE = r"[\x20\x09-\x0D]"
_UNIT_LOWER = _LOWER.format("word")
OP3 = rf"""
with d as (select doc_id, text, row_number() over (order by doc_id, text) as r from documents),
p as (select r, doc_id, unnest(w) as part, generate_subscripts(w, 1) as i
  from (select r, doc_id, regexp_extract_all(text, '{_SPACE}*(?:[\x{{3000}}-\x{{D7FF}}]|[^\x20\x09-\x0D\x{{3000}}-\x{{D7FF}}]+)') as w from d where text is not null)),
w as (select *, regexp_replace(part, '^{_SPACE}+', '') as word, i = 1 or contains(regexp_extract(part, '^{_SPACE}*'), chr(10)) as opens, sum(length(part)) over (partition by r order by i) as stop from p),
x as (select *, {_UNIT_LOWER} as low, coalesce(lead(opens) over (partition by r order by i), true) as closes from w),
y as (select r, doc_id, stop - length(word) as start, string_agg(low, ' ') over n as unit, count(*) over n as words, last_value(stop) over n as stop,
  opens or last_value(closes) over n or (strlen(low) + unicode(right(low, 1))) % 4 = 0 as picked from x window n as (partition by r order by i rows between current row and 31 following)),
u as (select *, row_number() over (partition by unit order by doc_id, start, r) > 1 as later from y where picked and words = 32),
h as (select *, coalesce(max(stop) over (partition by r order by start rows between unbounded preceding and 1 preceding), -1) < start as fresh from u where later),
g as (select r, start, stop, sum(fresh::int) over (partition by r order by start) as island from h),
holes as (select r, min(start) as a, max(stop) as b from g group by r, island),
k as (select r, coalesce(lag(b) over (partition by r order by a), 0) as s, a as e from holes union all select r, max(b), any_value(length(text)) from holes join d using (r) group by r),
c as (select r, coalesce(string_agg(substr(text, (s + 1)::bigint, (e - s)::bigint), '' order by s) filter (where e > s), '') as cut, coalesce(string_agg(s::bigint || '-' || e::bigint, ';' order by s) filter (where e > s), '') as spans from k join d using (r) group by r),
n as (select r, count(*) as n from holes group by r)
select doc_id, case when n.n is null then text else cut end as text, coalesce(n.n, 0) as n_removed, spans as kept_spans from d left join n using (r) left join c using (r)
"""

OP7 = f"""
with recursive g as ({_shingles("documents", "doc_id")}), n as (select doc_id, count(*) as c from g group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 75 * (x.c + y.c - i)),
e2 as (select a, b from e union select b, a from e),
r(s, t) as (select doc_id, doc_id from documents union select r.s, e2.b from r join e2 on e2.a = r.t)
select d.doc_id, coalesce(n.c, 0) as n_shingles, m.component_id from documents d left join n using (doc_id)
join (select s, min(t) as component_id from r group by s) m on m.s = d.doc_id
"""

ORACLES = {"op2_decontamination": OP2, "op3_substring_dedup": OP3, "op7_ngram_join": OP7}
