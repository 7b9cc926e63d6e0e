"""SQL that gives the rows of these queries, where SQL can on whole tables."""

from __future__ import annotations

from ..plans.oracle import LABEL_SEPARATORS, packed_values

_SAYS_NOTHING = """('', 'n a', 'null', 'none', 'nil', 'unknown', 'not known', 'not provided', 'not available', 'not specified', 'no tiene', 'sin dato',
'sin datos', 'no data', 'no value', 'desconocido', 'no aplica', 'not applicable', 'undefined', 'unbekannt', 'keine angabe', 'inconnu', 'tbd')"""
_FIELDS = ["first_name", "last_name", "organization_name", "address_1_formatted", "photo", "email_1_value"]
_WORDS = r"array_to_string(regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{Nd}}]+'), ' ')"
_MELT = " union all ".join(f"select row_id, source_file, updated_at, '{f}' as field_name, {f} as value, {_WORDS.format(f)} as w from contact_rows" for f in _FIELDS)
_P5 = f"""with m as (select distinct group_id, row_id from group_members where group_id is not null),
v as ({_MELT}),
c as (select m.group_id, v.field_name, v.row_id, v.value, row_number() over (partition by m.group_id, v.field_name
  order by coalesce(f.trust, 0) desc, v.updated_at desc nulls last, v.row_id) as rn
  from m join v using (row_id) left join contact_files f on f.source_file = v.source_file where v.w not in {_SAYS_NOTHING})"""
_CELLS = ", ".join(f"max(case when field_name = '{f}' then value end) as {f}" for f in _FIELDS)

_P9 = r"""with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') as w from documents),
b as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') as w from benchmark),
dg as (select distinct doc_id, array_to_string(w[i : i + 11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from d)),
bg as (select distinct item_id, array_to_string(w[i : i + 11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as i from b))"""

_NAME_WORDS = " || ' ' || ".join(f"coalesce({c}, '')" for c in ("first_name", "middle_name", "last_name", "name_prefix", "name_suffix", "nickname"))
_LINES = ", ".join(f"{_WORDS.format(c)} as {c}_" for c in ("organization_name", "address_1_formatted", "photo", "website_1_value", "notes"))
_P4 = rf"""with {packed_values('labels', LABEL_SEPARATORS, False)},
tags as (select row_id, list_sort(list_distinct(list_filter(list_transform(vs, lambda v: {_WORDS.format('v')}), lambda v: v <> ''))) as tags from unquoted),
numbers as (select row_id, list_sort(list_distinct(list(key_type || ':' || regexp_replace(canonical_key, '[^0-9]', '', 'g')))) as numbers
  from phones where key_type is not null group by row_id),
keyed as (select c.row_id, list_sort(regexp_extract_all(lower({_NAME_WORDS}), '[\p{{L}}\p{{Nd}}]+')) as names, {_LINES},
  list_sort(list_distinct(list_filter([{_WORDS.format('email_1_value')}, {_WORDS.format('email_2_value')}], lambda v: v <> ''))) as mails,
  coalesce(tags, []) as tags, coalesce(numbers, []) as numbers
  from contact_rows c left join tags using (row_id) left join numbers using (row_id))
select min(row_id) as row_id, count(*) as copies from keyed group by all_keys"""
_P4 = _P4.replace("group by all_keys", "group by names, organization_name_, address_1_formatted_, photo_, website_1_value_, notes_, mails, tags, numbers")

_SQL = {
    "p4_found": _P4 + " having count(*) >= 2",
    "p4_records": _P4,
    "p3_found": """with recursive l as (select distinct row_a as a, row_b as b from match_pairs where lower(verdict) = 'match' and row_a is not null and row_b is not null and row_a <> row_b),
e as (select a, b from l union select b, a from l),
reach(row_id, g) as (select a, a from e union select e.b, reach.g from reach join e on e.a = reach.row_id where reach.g < e.b)
select row_id, min(g) as group_id from reach group by row_id""",
    "p5_found": f"{_P5} select group_id, field_name, row_id from c where rn = 1",
    "p5_records": f"{_P5} select group_id, {_CELLS} from c where rn = 1 group by group_id",
    "p9_found": f"{_P9} select distinct item_id, doc_id from bg join dg using (g)",
    "p9_items": f"{_P9} select item_id, count(distinct doc_id) as documents from bg join dg using (g) group by item_id",
}

_SQL["p3_distributed"] = _SQL["p3_found"]
_SQL["p3_group_sizes"] = f"select contacts, count(*) as groups from (select group_id, count(*) as contacts from ({_SQL['p3_found']}) group by 1) group by 1"


def all_sql() -> dict[str, str]:
    return dict(_SQL)
