"""SQL over the same tables, written apart from the queries, for comparison by an independent engine."""

from __future__ import annotations

_TRIM = r"regexp_replace({0}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def _trim(c: str) -> str:
    return _TRIM.format(f"coalesce({c}, '')")


_NAMES = ["first_name", "middle_name", "last_name", "name_prefix", "name_suffix", "nickname"]
_SCALARS = ["first_name", "middle_name", "last_name", "name_prefix", "name_suffix", "nickname", "organization_name", "address_1_formatted", "photo"]
_SPAM = " or ".join(f"upper(coalesce({n}, '')) like '%SPAM%'" for n in _NAMES)

_CELLS = f"""
cells as (select row_id, 1 as slot, phone_1_value as v, phone_1_label as label, ({_SPAM}) as spam from contact_rows
  union all select row_id, 2, phone_2_value, phone_2_label, ({_SPAM}) from contact_rows),"""

# The phones of the CTE ``cells`` (row_id, slot, v, label, spam).
_PARSED = rf"""
parts as (select row_id, slot, label, spam, unnest(string_split_regex({_trim('v')}, '\s*:::\s*')) as t,
  generate_subscripts(string_split_regex({_trim('v')}, '\s*:::\s*'), 1) as nth from cells),
tokens as (select row_id, slot, coalesce(label, '') as label, spam, nth, {_trim('t')} as raw from parts where {_trim('t')} <> ''),
cleaned as (select *, {_trim("translate(raw, chr(160) || chr(8208) || chr(8209) || chr(8210) || chr(8211) || chr(8212), ' -----')")} as shown from tokens),
digits as (select *, regexp_replace(shown, '[^0-9]', '', 'g') as d from cleaned),
routed as (select *, not starts_with(shown, '+') and starts_with(d, '00') and length(d) >= 10 as zeros from digits),
intl as (select *, case when starts_with(shown, '+') then d when zeros then substr(d, 3) end as e from routed),
ruled as (select *, case
  when d = '' then 'NONE'
  when e is not null and starts_with(e, '52') and
    length(case when length(e) = 13 and substr(e, 3, 1) = '1' then substr(e, 4) else substr(e, 3) end) >= 10 then 'E164_MX'
  when e is not null and starts_with(e, '52') then 'MXSHORT'
  when e is not null and starts_with(e, '1') and length(e) = 11 then 'E164_US'
  when e is not null and length(e) >= 8 then 'E164_OTHER_COUNTRY'
  when e is not null then 'PLUSSHORT'
  when starts_with(d, '01') and length(d) >= 12 then 'MX_TOLLFREE_01'
  when length(d) = 10 then 'BARE_10'
  when length(d) = 11 and starts_with(d, '1') then 'BARE_11_LEADING1'
  when length(d) = 12 and starts_with(d, '52') then 'BARE_12_COUNTRY52'
  when length(d) = 13 and starts_with(d, '521') then 'BARE_13_COUNTRY521'
  when length(d) between 5 and 9 then 'SHORT_CODE_LEN' || length(d)
  when length(d) <= 4 then 'VERY_SHORT_CODE_LEN' || length(d)
  else 'LENGTH' end as rule from intl),
phones_ as (select row_id, slot, nth, label, spam, raw, shown as cleaned_display,
  row_number() over (partition by row_id order by slot, nth) as phone_ord,
  case when rule in ('NONE','MXSHORT','PLUSSHORT','LENGTH') then null when rule like '%SHORT_CODE%' then shown
    when rule = 'E164_OTHER_COUNTRY' then '+' || e when rule like 'E164%' then right(e, 10) else right(d, 10) end as canonical_key,
  case when rule in ('NONE','MXSHORT','PLUSSHORT','LENGTH') then null when rule like '%SHORT_CODE%' then 'RAW_SHORT'
    when rule = 'E164_OTHER_COUNTRY' then 'E164_FULL' else 'TEN_DIGIT' end as key_type,
  case when rule in ('NONE','MXSHORT','PLUSSHORT','LENGTH') then null when rule like '%SHORT_CODE%' or rule = 'BARE_10' then 'UNKNOWN'
    when rule = 'E164_OTHER_COUNTRY' then 'OTHER' when rule in ('E164_US','BARE_11_LEADING1') then 'US' else 'MX' end as country,
  case when zeros then 'INTL_00_PREFIX(' else '' end ||
    case when rule in ('NONE','MXSHORT','PLUSSHORT','LENGTH') then 'ANOMALY' else rule end || case when zeros then ')' else '' end as category,
  case when rule in ('NONE','MXSHORT','PLUSSHORT','LENGTH') or rule like '%SHORT_CODE%' then 'LOW' when rule like 'E164%' then 'HIGH' else 'MEDIUM' end as confidence,
  case rule when 'NONE' then 'No digits found in token' when 'MXSHORT' then 'MX (+52) number too short: ' || e
    when 'PLUSSHORT' then 'Plus-prefixed number too short: ' || e when 'LENGTH' then 'Unrecognized digit length: ' || length(d) end as warning
  from ruled)"""

_TOKENS = _CELLS + _PARSED

_USABLE = f"""{_TOKENS},
usable as (select *, row_number() over (partition by row_id order by slot, nth) as ord, key_type || '::' || canonical_key as key
  from phones_ where key_type is not null)"""

_SHOWN = "case when key_type = 'TEN_DIGIT' and country = 'MX' then '+52' || canonical_key when key_type = 'TEN_DIGIT' and country = 'US' then '+1' || canonical_key else canonical_key end"

_INDEX = f"""{_USABLE},
index_ as (select key, count(*) as n_occ, count(distinct row_id) as n_rows, min(row_id) as first_row from usable where not spam group by key)"""

# Replays all keys in order over one list of labels, its place the dense number of the row.
_CLUSTERS = f"""{_INDEX},
dense as (select row_id, row_number() over (order by row_id) - 1 as rid from (select distinct u.row_id from usable u join index_ i using (key) where not u.spam and i.n_rows >= 2)),
k as (select key, list(rid order by u.row_id, ord) as occ, n_occ as cnt, n_rows from usable u join index_ using (key) join dense using (row_id) where not spam and n_rows >= 2 group by key, n_occ, n_rows),
o as (select *, row_number() over (order by cnt, key) as step, len(occ) > 0 as ok from k),
it(step, s, key, total) as (
  select 0::bigint, (select list(rid order by rid) from dense), ''::varchar, 0::bigint
  union all
  select step + 1, case when total_ between 1 and 10 then list_transform(s, lambda y: case when list_contains(roots, y) then list_min(roots) else y end) else s end, key_, total_
  from (select it.step, it.s, roots, o.key as key_,
      case when len(roots) < 2 then 0 else len(list_filter(it.s, lambda y: list_contains(roots, y))) end as total_
    from it join o on o.step = it.step + 1, lateral (select list_distinct(list_transform(o.occ, lambda x: it.s[x + 1])) as roots) r)),
last_ as (select s from it where step = (select max(step) from it)),
labels_ as (select unnest(range(len(s))) as rid, unnest(s) as root from last_),
final_ as (select d.row_id, m.row_id as cluster_id from labels_ l join dense d on d.rid = l.rid join dense m on m.rid = l.root),
live as (select * from contact_rows where not ({_SPAM})),
members as (select row_id, coalesce(f.cluster_id, row_id) as cluster_id from live left join final_ f using (row_id))"""

_FILLED = " + ".join(f"({_trim(c)} <> '')::bigint" for c in ("first_name", "last_name", "organization_name", "email_1_value", "address_1_formatted", "photo"))
_BASE = f"""{_CLUSTERS},
scored as (select l.*, cluster_id, {_FILLED} as score from live l join members using (row_id)),
base as (select cluster_id, row_id as base_row, score from (select *, row_number() over (partition by cluster_id order by score desc, row_id) as rn from scored) where rn = 1)"""


def _backfill(c: str) -> str:
    own = f"max(case when s.row_id = b.base_row then coalesce({c}, '') end)"
    other = f"arg_min({c}, s.row_id) filter (where {_trim(c)} <> '')"
    return f"strip_accents(case when {_trim(own)} <> '' then {own} else coalesce({other}, {own}) end) as {c}"


def _slots(cols: list[str], key: str) -> str:
    rows = " union all ".join(f"select row_id, {i}::bigint as ord, {_trim(c)} as value from live" for i, c in enumerate(cols, 1))
    return f"""with recursive {_CLUSTERS},
e as (select * from ({rows}) where value <> ''),
r as (select m.cluster_id, e.*, row_number() over (partition by m.cluster_id, {key} order by e.row_id, ord) as rn from e join members m using (row_id))
select cluster_id, row_id, ord, 'Other' as label, value from r where rn = 1"""


def _line(cols: list[str]) -> str:
    cell = "case when regexp_matches(coalesce({0}, ''), '[,\"\\r\\n]') then '\"' || replace({0}, '\"', '\"\"') || '\"' else coalesce({0}, '') end"
    return " || ',' || ".join(cell.format(c) for c in cols)


_ORDER = ["name_prefix", "first_name", "middle_name", "last_name", "name_suffix", "nickname"]
_COLUMNS = [
    "first_name", "middle_name", "last_name", "name_prefix", "name_suffix", "nickname", "organization_name", "address_1_formatted", "photo",
    "phone_1_label", "phone_1_value", "phone_2_label", "phone_2_value", "email_1_value", "email_2_value", "website_1_value", "notes", "labels",
]

_BLANKS = r"[\s\x{A0}\x{85}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_HIDE, _SHOW = ":;|,/" + chr(10) + chr(13), "\ue001\ue002\ue003\ue004\ue005\ue006\ue007"


def packed_values(field: str, separators: str, bullets: bool) -> str:
    """Values of a cell: separators inside quotes are hidden, the rest is split, then each value is cleaned."""
    hide = f"translate(x, ':;|,/' || chr(10) || chr(13), '{_SHOW}')"
    show = f"translate(v, '{_SHOW}', ':;|,/' || chr(10) || chr(13))"
    clean = f"regexp_replace(x, '^{_BLANKS}+|{_BLANKS}+$', '', 'g')"
    bare = f"regexp_replace({clean}, '^(?:[•‣◦▪●·]{_BLANKS}*|[*–-]{_BLANKS}+)+', '')" if bullets else clean
    return rf"""
hidden as (select row_id, array_to_string(list_transform(regexp_extract_all({field}, '"(?:[^"]|"")*"|[^"]+|"'),
  lambda x: case when length(x) > 1 and starts_with(x, '"') then {hide} else x end), '') as c from contact_rows where {field} is not null),
pieces as (select row_id, list_filter(list_transform(string_split_regex(c, '{separators}'), lambda x: {bare}), lambda x: x not in ('', '""')) as vs from hidden),
unquoted as (select row_id, list_transform(vs, lambda v: {show.replace('translate(v,', "translate(case when length(v) > 1 and starts_with(v, chr(34)) and ends_with(v, chr(34)) then replace(v[2:-2], chr(34) || chr(34), chr(34)) else v end,")}) as vs from pieces)"""


LABEL_SEPARATORS, NOTE_SEPARATORS = rf":::|[;|,\r\n]|{_BLANKS}+/{_BLANKS}+", rf":::|[;|\r\n]|{_BLANKS}+//{_BLANKS}+"


def _packed(least: int) -> str:
    def one(field: str, separators: str, bullets: bool) -> str:
        return f"""select * from (with {packed_values(field, separators, bullets)}
select row_id, '{field}' as field_name, unnest(range(1, len(vs) + 1))::integer as item_pos, unnest(vs) as item_value from unquoted where len(vs) >= {least})"""

    return one("labels", LABEL_SEPARATORS, False) + " union all " + one("notes", NOTE_SEPARATORS, True)


_NORM = r"lower(regexp_replace({0}, '[\s_\-\x{{A0}}\x{{FEFF}}]+', '', 'g'))"
_CELL = r"""(?:[^",]*|"(?:[^"]|"")*")"""
_UNQUOTE = "list_transform(regexp_extract_all(',' || {0}, ',(\"(?:[^\"]|\"\")*\"|[^,]*)', 1), lambda x: case when starts_with(x, '\"') then replace(x[2:-2], '\"\"', '\"') else x end)"


def _trimmed(c: str) -> str:
    return f"regexp_replace({c}, '^{_BLANKS}+|{_BLANKS}+$', '', 'g')"


_TYPE = r"""case when regexp_full_match({0}, '[0-9]+([.,][0-9]+)?') then 'number'
  when regexp_full_match({0}, '[0-9]{{4}}[-./][0-9]{{1,2}}[-./][0-9]{{1,2}}|[0-9]{{1,2}}[-./][0-9]{{1,2}}[-./]([0-9]{{4}}|[0-9]{{2}})') then 'date'
  when lower({0}) in ('true', 'false', 'yes', 'no') then 'flag' else 'text' end"""

def _raw_cells(fields: str, types_of: str) -> str:
    """Header cells, sound records, cells of some fields (the first of a repeated one) and their types."""
    return f"""
heads as (select file_id, {_UNQUOTE.format("regexp_replace(line, '^' || chr(65279), '')")} as names from raw_lines where source_row_number = 1),
named as (select h.file_id, h.nth, {_NORM.format('h.name')} as hk, coalesce(a.field_name, h.name) as field_name
  from (select file_id, unnest(names) as name, generate_subscripts(names, 1) as nth from heads) h
  left join field_aliases a on {_NORM.format('a.header_name')} = {_NORM.format('h.name')}),
shape as (select r.file_id, r.source_row_number, coalesce(line, '') as line, len(h.names) as width,
  regexp_full_match(coalesce(line, ''), '{_CELL}(?:,{_CELL})*') as quoted
  from raw_lines r left join heads h using (file_id) where source_row_number > 1),
parsed as (select *, {_UNQUOTE.format('line')} as cells from shape where quoted),
good as (select * from parsed where len(cells) = width),
first_ as (select file_id, field_name, min(nth) as nth from named group by 1, 2),
flat as (select g.file_id, g.source_row_number, n.field_name, g.cells[n.nth] as cell, {_trimmed('g.cells[n.nth]')} as v
  from good g join first_ n using (file_id) where {fields}),
typed as (select *, {_TYPE.format('v')} as raw_type from flat where v <> ''),
type_counts as (select file_id, field_name, raw_type, count(*) as cells from typed
  where {types_of} group by 1, 2, 3),
main as (select file_id, field_name, raw_type from (select *, row_number() over (partition by file_id, field_name order by cells desc, raw_type) as rn from type_counts) where rn = 1)"""


_TYPED = "field_name in ('Birthday', 'Starred', 'Times Contacted', 'Postal Code')"
_RAW = _raw_cells("n.field_name in ('Birthday', 'Starred', 'Times Contacted', 'Postal Code', 'E-mail 1 - Value', 'Phone 1 - Value')", _TYPED)
_RAW_ALL = _raw_cells("true", "true")

_DAY = r"""(case when regexp_full_match(v, '[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}') then try_cast(regexp_replace(v, '[./]', '-', 'g') as date)
  when regexp_full_match(v, '[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{4}') then try_cast(regexp_replace(v, '^([0-9]+)[-./]([0-9]+)[-./]([0-9]+)$', '\3-\2-\1') as date)
  when regexp_full_match(v, '[0-9]{8}') then try_cast(v[1:4] || '-' || v[5:6] || '-' || v[7:8] as date) end)"""

_REJECTED = rf"""
cells as (select g.file_id * 10000000 + g.source_row_number as row_id, 1 as slot, g.cells[n.nth] as v, '' as label, false as spam
  from good g join first_ n using (file_id) where n.field_name = 'Phone 1 - Value'),
{_PARSED},
bad as (select t.file_id, t.source_row_number, case t.field_name when 'E-mail 1 - Value' then 2 when 'Birthday' then 3 when 'Starred' then 4 else 5 end as nth, t.field_name
  from typed t left join main m using (file_id, field_name) where
  (t.field_name in ('Starred', 'Times Contacted') and t.raw_type <> m.raw_type)
  or (t.field_name = 'E-mail 1 - Value' and not regexp_full_match(v, '[^\s@]+@[^\s@]+'))
  or (t.field_name = 'Birthday' and m.raw_type <> 'text' and {_DAY} is null)
  union select row_id // 10000000, (row_id % 10000000)::integer, 1, 'Phone 1 - Value' from phones_ where key_type is null)"""

# The fields that the mapping table knows.
_FIELDS = [
    "Address 1 - Formatted", "Birthday", "E-mail 1 - Value", "First Name", "Labels", "Last Name", "Nickname", "Notes", "Organization Name",
    "Phone 1 - Label", "Phone 1 - Value", "Photo", "Postal Code", "Starred", "Times Contacted", "Website 1 - Value",
]


def _typed_table() -> str:
    """One column per field with its cast, and the fields whose cell does not cast."""
    casts = {
        "Birthday": _DAY, "Times Contacted": "case when regexp_full_match(v, '[0-9]+([.,][0-9]+)?') then try_cast(replace(v, ',', '.') as decimal(18, 3)) end",
        "Starred": "case when lower(v) in ('true', 'yes', '1') then true when lower(v) in ('false', 'no', '0') then false end",
    }
    cols, failed = [], []
    for f in _FIELDS:
        own = f"max(case when field_name = '{f}' and v <> '' then v end)"
        name = "_".join("".join(x if x.isalnum() else " " for x in f.lower()).split())
        cols.append((own, name, casts.get(f, "v").replace("v,", f"{name}_,").replace("(v)", f"({name}_)").replace("v[", f"{name}_[") if f in casts else f"{name}_"))
        if f in casts:
            failed.append(f"case when {name}_ is not null and {name} is null then '{f}' end")
    inner = ", ".join(f"{own} as {name}_" for own, name, _ in cols)
    outer = ", ".join(f"{cast} as {name}" for _, name, cast in cols)
    return f"""with {_RAW_ALL},
wide as (select g.file_id, g.source_row_number, {inner} from good g left join flat f using (file_id, source_row_number) group by 1, 2),
cast_ as (select *, {outer} from wide)
select file_id, source_row_number, {', '.join(name for _, name, _ in cols)}, array_to_string(list_filter([{', '.join(failed)}], lambda x: x is not null), '|') as failed_casts from cast_"""


# The raw files as texts, cut into records and cells by the exports' dialect: a quote anywhere opens or closes quoting.
_EXPORTS = r"""
files as (select source_file, regexp_replace(string_agg(coalesce(line, '') || chr(13) || chr(10), '' order by source_row_number), '^' || chr(65279), '') as t
  from raw_lines where source_file is not null group by 1),
cut_ as (select source_file, list_filter(regexp_extract_all(t, '(?:[^"\n]|"[^"]*(?:"|$))*(?:\n|$)'), lambda x: x <> '') as rs from files),
lines_ as (select source_file, unnest(rs) as r, generate_subscripts(rs, 1) as record_ord from cut_),
bodies as (select source_file, record_ord::integer as record_ord, regexp_extract(r, '^((?:[^"\n]|"[^"]*(?:"|$))*)', 1) as body from lines_),
raw_cells as (select source_file, record_ord, regexp_extract_all(',' || body, ',((?:[^",]|"[^"]*(?:"|$))*)', 1) as cs from bodies),
records_ as (select source_file, record_ord, list_transform(cs, lambda c: array_to_string(list_transform(regexp_extract_all(c, '"(?:[^"]|"")*(?:"|$)|[^"]+'),
  lambda p: case when not starts_with(p, '"') then replace(p, chr(13), '')
    when (length(p) - length(replace(p, '"', ''))) % 2 = 0 then replace(p[2:-2], '""', '"') else replace(p[2:], '""', '"') end), '')) as cells from raw_cells),
heads_ as (select source_file, unnest(cells) as name, generate_subscripts(cells, 1) as "at" from records_ where record_ord = 1),
union_ as (select row_number() over (order by f) - 1 as pos, name from (select name, min(row(source_file, "at")) as f from heads_ group by 1))"""

_ESCAPED = """case when regexp_matches({0}, '[,"\\r\\n]') then '"' || replace({0}, '"', '""') || '"' else {0} end"""
_SINGLE = ["first_name", "organization_name", "address_1_formatted", "photo"]


def _slot_cells(name: str, width: str) -> str:
    return f"flatten(list_transform(range(1, {width} + 1), lambda i: [coalesce({name}l[i], ''), coalesce({name}v[i], '')]))"


def _slot_heads(family: str, width: str) -> str:
    return f"flatten(list_transform(range(1, {width} + 1), lambda i: ['{family} ' || i || ' - Label', '{family} ' || i || ' - Value']))"


def _lists(rows: str, name: str, most: int | None) -> str:
    """Labels and values of a cluster's slots in order, the first ``most`` of them."""
    keep = f"where k <= {most}" if most else ""
    return f"""{name}_ as (select cluster_id, list(label order by k) as {name}l, list(value order by k) as {name}v
  from (select *, row_number() over (partition by cluster_id order by row_id, ord) as k from ({rows})) {keep} group by 1)"""


def _merged() -> str:
    """Every contact as a CSV record under the final header: names collapsed and numbered, slots 1 to the widest."""
    def slots(cols: list[str], key: str) -> str:
        rows = " union all ".join(f"select row_id, {i}::bigint as ord, {_trim(c)} as value from live" for i, c in enumerate(cols, 1))
        return f"""select cluster_id, row_id, ord, 'Other' as label, value from (select m.cluster_id, e.*, row_number() over (partition by m.cluster_id, {key} order by e.row_id, ord) as rn
  from ({rows}) e join members m using (row_id) where value <> '') where rn = 1"""

    phones = f"""select cluster_id, row_id, ord, case when {_trim('label')} = '' then 'Mobile' else {_trim('label')} end as label, {_SHOWN} as value
  from (select m.cluster_id, u.*, row_number() over (partition by m.cluster_id, u.key order by u.row_id, u.ord) as rn from usable u join members m using (row_id)) where rn = 1"""
    parts = ", ".join(_trim(c) for c in _ORDER)
    cells = f"""['' || first_name, '', '', '', '', '', organization_name, address_1_formatted, photo] || {_slot_cells('p', 'w.p')} || {_slot_cells('e', 'w.e')} || {_slot_cells('s', 'w.s')} || ['', '']"""
    names = "['First Name', 'Middle Name', 'Last Name', 'Name Prefix', 'Name Suffix', 'Nickname', 'Organization Name', 'Address 1 - Formatted', 'Photo']"
    heads = f"{names} || {_slot_heads('Phone', 'w.p')} || {_slot_heads('E-mail', 'w.e')} || {_slot_heads('Website', 'w.s')} || ['Notes', 'Labels']"
    return rf"""with recursive {_BASE},
filled as (select s.cluster_id, {', '.join(_backfill(c) for c in _SCALARS)} from scored s join base b using (cluster_id) group by s.cluster_id),
full_ as (select cluster_id, row_id, strip_accents({_trim("(" + _trim('first_name') + " || ' ' || " + _trim('last_name') + ")")}) as name from scored),
other_ as (select n.cluster_id, n.name, min(n.row_id) as nth from full_ n join base b using (cluster_id) join full_ bn on bn.row_id = b.base_row where n.name <> '' and n.name <> bn.name group by 1, 2),
variants as (select cluster_id, list({_trim('name')} order by nth) as vs from other_ group by 1),
pieces_ as (select f.cluster_id, [{parts}] || coalesce(vs, []) as ps from filled f left join variants using (cluster_id)),
piece as (select cluster_id, unnest(ps) as p, generate_subscripts(ps, 1) as part from pieces_),
words_ as (select cluster_id, part, unnest(regexp_extract_all(p, '[\p{{L}}\p{{Nd}}'']+')) as w, generate_subscripts(regexp_extract_all(p, '[\p{{L}}\p{{Nd}}'']+'), 1) as nth from piece),
once as (select *, row_number() over (partition by cluster_id, lower(w) order by part, nth) as rn from words_),
joined_ as (select cluster_id, string_agg(p, ' - ' order by part) as name from (select cluster_id, part, string_agg(w, ' ' order by nth) as p from once where rn = 1 group by 1, 2) group by 1),
keyed as (select f.cluster_id, coalesce(name, '') as name, lower({_trim("string_split(coalesce(name, ''), ' - ')[1]")}) as k from filled f left join joined_ using (cluster_id)),
numbered as (select cluster_id, case when name <> '' and row_number() over (partition by k order by cluster_id) > 1 then name || ' ' || row_number() over (partition by k order by cluster_id) else name end as full_name from keyed),
{_lists(phones, 'p', 20)},
{_lists(slots(['email_1_value', 'email_2_value'], 'lower(value)'), 'e', None)},
{_lists(slots(['website_1_value'], 'value'), 's', None)},
w as (select greatest(1, (select coalesce(max(len(pl)), 0) from p_)) as p, greatest(1, (select coalesce(max(len(el)), 0) from e_)) as e, greatest(1, (select coalesce(max(len(sl)), 0) from s_)) as s),
out_ as (select f.cluster_id, n.full_name as first_name, organization_name, address_1_formatted, photo, pl, pv, el, ev, sl, sv from filled f join numbered n using (cluster_id)
  left join p_ using (cluster_id) left join e_ using (cluster_id) left join s_ using (cluster_id))
select cluster_id, array_to_string({heads}, ',') as header, array_to_string(list_transform({cells}, lambda c: {_ESCAPED.format('c')}), ',') as line from out_, w"""


_SQL = {
    "p2_found": _packed(2),
    "p2_values": _packed(1),
    "p6_types": f"with {_RAW_ALL} select file_id, field_name, raw_type, cells from type_counts",
    "p6_table": _typed_table(),
    "p7_cells": f"""with {_RAW}, {_REJECTED}
select file_id, source_row_number, 'invalid_value' as reason, string_agg(field_name, '|' order by nth) as fields from bad group by 1, 2""",
    "p7_loaded": f"""with {_RAW_ALL}, {_REJECTED}
select file_id, source_row_number, f.field_name, cell from flat f anti join bad using (file_id, source_row_number)""",
    "merged_contacts": _merged(),
    "csv_tokenize": f"with {_EXPORTS} select source_file, record_ord, len(cells)::integer as cells, array_to_string(cells, chr(31)) as text from records_",
    "header_union_of_exports": f"with {_EXPORTS} select pos::integer as pos, name from union_",
    "aligned_raw_exports": f"""with {_EXPORTS},
last_ as (select source_file, name, max("at") as "at" from heads_ group by 1, 2),
places as (select f.source_file, list(l."at" order by u.pos) as ps from (select distinct source_file from heads_) f cross join union_ u left join last_ l on l.source_file = f.source_file and l.name = u.name group by 1)
select source_file, record_ord as source_row, array_to_string(list_transform(list_transform(ps, lambda p: coalesce(r.cells[p], '')), lambda c: {_ESCAPED.format('c')}), ',') as line
from records_ r join places using (source_file) where record_ord > 1""",
    "p6_found": f"""with {_RAW},
pairs as (select file_id, lag(file_id) over (partition by account order by exported_at, file_id) as prev from contact_files where stage = 'raw' and account is not null),
known as (select n.file_id, n.field_name, min(hk) as hk, min(m.raw_type) as raw_type from named n left join main m on m.file_id = n.file_id and m.field_name = n.field_name group by 1, 2),
both_ as (select p.file_id, coalesce(c.field_name, o.field_name) as field_name, c.hk as hk, o.hk as ohk, c.raw_type as rt, o.raw_type as ort
  from (select pairs.file_id, prev, f.field_name as fn from pairs join (select distinct field_name from known) f on true where prev is not null) p
  left join known c on c.file_id = p.file_id and c.field_name = p.fn left join known o on o.file_id = p.prev and o.field_name = p.fn
  where c.hk is not null or o.hk is not null)
select file_id, field_name, 'added' as change_kind from both_ where ohk is null
union all select file_id, field_name, 'removed' from both_ where hk is null
union all select file_id, field_name, 'renamed' from both_ where hk <> ohk
union all select file_id, field_name, 'retyped' from both_ where rt <> ort""",
    "p7_found": f"""with {_RAW}, {_REJECTED}
select file_id, source_row_number, 'broken_quoting' as reason from shape where not quoted
union all select file_id, source_row_number, 'column_count' from parsed where width is null or len(cells) <> width
union all select distinct file_id, source_row_number, 'invalid_value' from bad""",
    "phone_parse": f"with {_TOKENS} select row_id, phone_ord, raw, cleaned_display, canonical_key, key_type, country, category, confidence, warning from phones_",
    "phone_anomalies": f"with {_TOKENS} select row_id, raw, warning as reason from phones_ where key_type is null",
    "phone_category_counts": f"with {_TOKENS} select category, count(*) as tokens, count(distinct row_id) as contacts from phones_ group by category",
    "phone_render": f"with {_USABLE} select row_id, ord as phone_ord, {_SHOWN} as shown from usable",
    "phone_explode": f"with {_USABLE} select row_id, ord as phone_ord, key_type, canonical_key, label as source_label from usable where not spam",
    "phone_tokens_split": f"with {_TOKENS} select row_id, slot, row_number() over (partition by row_id, slot order by nth) - 1 as nth, raw as token from tokens",
    "accent_strip": f"select row_id, {', '.join(f'strip_accents({x}) as {x}' for x in _COLUMNS)} from contact_rows",
    "name_token_dedupe": rf"""with parts as (select row_id, unnest([{', '.join(_trim(c) for c in _ORDER)}]) as p, generate_subscripts([1,2,3,4,5,6], 1) as part from contact_rows),
words as (select row_id, part, unnest(regexp_extract_all(strip_accents(p), '[\p{{L}}\p{{Nd}}'']+')) as w, generate_subscripts(regexp_extract_all(strip_accents(p), '[\p{{L}}\p{{Nd}}'']+'), 1) as nth from parts),
first_ as (select *, row_number() over (partition by row_id, lower(w) order by part, nth) as rn from words),
kept as (select row_id, part, string_agg(w, ' ' order by nth) as p from first_ where rn = 1 group by row_id, part)
select c.row_id, coalesce(string_agg(k.p, ' - ' order by part), '') as name from contact_rows c left join kept k using (row_id) group by c.row_id""",
    "spam_filter": f"select row_id, source_file, source_row_number::bigint as source_row from contact_rows where not ({_SPAM})",
    "phone_key_index": f"with {_INDEX} select key, n_occ, n_rows, first_row from index_",
    "clusters_capped": f"with recursive {_CLUSTERS} select row_id, cluster_id from members",
    "merge_conflicts": f"with recursive {_CLUSTERS} select it.key, o.cnt as occurrences, it.total from it join o using (step) where it.total > 10",
    "merge_conflict_rows": f"""with recursive {_CLUSTERS} select u.key, u.row_id, u.ord as phone_ord, c.source_file, c.source_row_number::bigint as source_row
from it join o using (step) join usable u on u.key = it.key join contact_rows c on c.row_id = u.row_id where it.total > 10 and not u.spam""",
    "base_row": f"with recursive {_BASE} select cluster_id, base_row, score from base",
    "scalar_backfill": f"with recursive {_BASE} select s.cluster_id, {', '.join(_backfill(c) for c in _SCALARS)} from scored s join base b using (cluster_id) group by s.cluster_id",
    "name_variants": f"""with recursive {_BASE},
named as (select cluster_id, row_id, strip_accents({_trim("(" + _trim('first_name') + " || ' ' || " + _trim('last_name') + ")")}) as name from scored),
other as (select n.cluster_id, n.name, min(n.row_id) as nth from named n join base b using (cluster_id) join named bn on bn.row_id = b.base_row where n.name <> '' and n.name <> bn.name group by 1, 2)
select b.cluster_id, coalesce(string_agg(o.name, ' | ' order by nth), '') as variants from base b left join other o using (cluster_id) group by 1""",
    "phone_union": f"""with recursive {_CLUSTERS},
r as (select m.cluster_id, u.*, row_number() over (partition by m.cluster_id, u.key order by u.row_id, u.ord) as rn from usable u join members m using (row_id))
select cluster_id, row_id, ord, case when {_trim('label')} = '' then 'Mobile' else {_trim('label')} end as label, {_SHOWN} as value from r where rn = 1""",
    "email_union": _slots(["email_1_value", "email_2_value"], "lower(value)"),
    "website_union": _slots(["website_1_value"], "value"),
    "duplicate_name_suffix": f"""with n as (select row_id, {_trim('first_name')} as name, {_trim("strip_accents(" + _trim('first_name') + ")")} as base from contact_rows),
k as (select *, lower(case when {_trim("string_split(base, ' - ')[1]")} = '' then base else {_trim("string_split(base, ' - ')[1]")} end) as key from n),
c as (select *, case when base = '' then 0 else row_number() over (partition by key order by row_id) end as n from k)
select row_id, case when n > 1 then base || ' ' || n else name end as name from c""",
    "slot_stats": f"""with recursive {_CLUSTERS}, sizes as (select cluster_id, count(*) as n from members group by 1),
p as (select least(20, count(distinct key)) as n from usable join members using (row_id) group by cluster_id),
e as (select count(distinct lower(v)) as n from (select row_id, {_trim('email_1_value')} as v from live union all select row_id, {_trim('email_2_value')} from live) join members using (row_id) where v <> '' group by cluster_id),
s as (select count(distinct v) as n from (select row_id, {_trim('website_1_value')} as v from live) join members using (row_id) where v <> '' group by cluster_id)
select (select count(*) from contact_rows) as source_rows, count(*) as contacts, count_if(n > 1)::bigint as merged_clusters,
  (select coalesce(max(n), 0) from p) as most_phones, (select coalesce(max(n), 0) from e) as most_emails, (select coalesce(max(n), 0) from s) as most_websites from sizes""",
    "csv_lines": f"select row_id, {_line(_COLUMNS)} as line from contact_rows",
    "aligned_exports": f"select source_file, source_row_number as source_row, {_line(_COLUMNS)} as line from contact_rows",
    "components_uncapped": f"""with recursive {_INDEX},
edges as (select distinct first_row as a, row_id as b from usable join index_ using (key) where not spam and n_rows >= 2),
both_ as (select a, b from edges union select b, a from edges),
reach(row_id, c) as (select a, a from both_ union select b, c from reach join both_ on a = reach.row_id where c < b)
select row_id, min(c) as component from reach group by row_id""",
    "p1_found": """select key_type, canonical_key, count(distinct phone_id) as phones, count(distinct row_id) as contacts from phones
where key_type is not null group by 1, 2 having count(distinct row_id) >= 2""",
    "p1_all_keys": "select key_type, canonical_key, count(distinct phone_id) as phones, count(distinct row_id) as contacts from phones group by 1, 2",
}


def all_sql() -> dict[str, str]:
    return dict(_SQL)
