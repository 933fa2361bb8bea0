"""SQL of the longer twins, and the fragments that several twins share."""

from __future__ import annotations

from collections.abc import Iterable

from lexmill.functions import gloss as G
from lexmill.functions import script as S
from lexmill.functions import text as T
from lexmill.operators import export, search

WORDS = "words as (select * from (select *, row_number() over (partition by word order by added_at nulls first, row_id) as rn from word_list where word is not null) where rn = 1)"
# DuckDB's trim leaves tabs and line breaks.
STRIP = r"regexp_replace({0}, '^[\s\x0b\x{{85}}\p{{Z}}]+|[\s\x0b\x{{85}}\p{{Z}}]+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x)


def quoted(x: str | int | None) -> str:
    return "null" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def sql_list(items: Iterable[str]) -> str:
    return ", ".join(map(quoted, items))


def sql_values(rows: Iterable[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


# --- the gloss language


def _keys(table: G.Annotations) -> list[str]:
    return sorted(table, key=len, reverse=True)


def _alternatives(table: G.Annotations) -> str:
    return "|".join(k.replace(".", "[.]").replace("(", "[(]").replace(")", "[)]") for k in _keys(table))


KEYS, ALTERNATIVES = _keys(G.ANNOTATIONS), _alternatives(G.ANNOTATIONS)
FULL = strip(r"regexp_replace(regexp_replace(item, '[()]', '', 'g'), '[\s\p{Z}]+', ' ', 'g')")
LEADING = strip(r"regexp_replace(item, '^(?:\([^_)]+\)[\s\p{Z}]*)+', '')")
TRAILING = strip(r"regexp_replace(item, '(?:[\s\p{Z}]*\([^_)]+\))+$', '')")


def _entries(table: G.Annotations) -> str:
    return sql_values((k, i, *e) for k, v in table.items() for i, e in enumerate(v))


def annotated(name: str, source: str, table: G.Annotations) -> str:
    """CTEs that end in ``name`` (row_id, cls, no, prefix, item, qualifier): the groups of a table of (row_id, text, cls)."""
    keys = sql_list(table)
    return rf"""
{name}_text as (select row_id, cls, string_split({strip('text')}, '; ') as v from {source} where {strip('text')} <> ''),
{name}_group as (select row_id, cls, generate_subscripts(v, 1) as no, {strip('unnest(v)')} as s from {name}_text),
{name}_key as (
  select *, regexp_extract(lower(s), '^({_alternatives(table)}):', 1) as k,
    regexp_extract(lower(s), '^([a-z][a-z./]*)\s*\(([^)]+)\)\s*:', 1) as b1, trim(regexp_extract(lower(s), '^([a-z][a-z./ ]+?)\s*\(([^)]+)\)\s*:', 1)) as b2,
    trim(regexp_extract(lower(s), '^([a-z][a-z./ ]*?)\s*\(([^)]+)\)\s*:', 2)) as q
  from {name}_group),
{name} as (
  select row_id, cls, no, case when k <> '' then k when b1 in ({keys}) then b1 when b2 in ({keys}) then b2 end as prefix,
    case when k <> '' then {strip("s[length(k) + 2:]")} when b1 in ({keys}) or b2 in ({keys}) then {strip("s[instr(s, ':') + 1:]")} else s end as item,
    case when k <> '' then nullif(regexp_extract(k, '\(([^)]+)\)', 1), '') when b1 in ({keys}) or b2 in ({keys}) then q end as qualifier
  from {name}_key)"""


def parsed(source: str) -> str:
    """CTEs that end in ``parsed`` (row_id, place, gloss, pos, verb_type, qualifier, affix_type), from a table of (row_id, text, cls)."""
    classes = sql_values((k, i + 1, p) for k, v in G.WORD_CLASSES.items() for i, p in enumerate(v))
    parts = f"list_transform(string_split(replace(cls, ';', '.'), '.'), lambda x: {strip('x')})"
    last_verb = f"list_filter(list_reverse({parts}), lambda x: x in ({sql_list(G.VERB_CLASSES)}))[1]"
    own_type = f"case {last_verb} " + " ".join(f"when '{k}' then '{v}'" for k, v in G.VERB_CLASSES.items()) + " end"
    return rf"""
ent(prefix, eno, epos, everb, eaffix) as (values {_entries(G.ANNOTATIONS)}),
cpos(cls, cno, pos) as (values {classes}),
clen as (select cls, count(*) as n from cpos group by cls),
{annotated('ann', source, G.ANNOTATIONS)},
form as (select *, {FULL} as f, {LEADING} as a, {TRAILING} as b from ann),
vari as (select *, case when a <> item and a <> '' and f <> '' and a <> f then [a, f] when b <> item and b <> '' and f <> '' and b <> f then [b, f] else [item] end as v from form),
sized as (select vari.*, case when prefix is null then 1 else len(v) * e.n end as n from vari left join (select prefix, count(*) as n from ent group by prefix) e using (prefix)),
placed as (select *, coalesce(sum(n) over (partition by row_id order by no rows between unbounded preceding and 1 preceding), 0)::int as place0, {own_type} as own from sized),
spread as (select *, unnest(v) as g, generate_subscripts(v, 1) - 1 as vno from placed where prefix is not null),
parsed as (
  select row_id, (place0 + eno * len(v) + vno)::int as place, g as gloss, epos as pos,
    case when everb = 'INTRANSITIVE' and own in ('FEELING', 'STATE') then own when everb = 'TRANSITIVE' and contains(cls, '.ru') then 'ECHO_TRANSITIVE' else everb end as verb_type,
    qualifier, eaffix as affix_type
  from spread join ent using (prefix)
  union all
  select row_id, place0, item, case when clen.n is null then 'PHRASE' else cpos.pos end, null, null, null
  from placed left join clen using (cls) left join cpos on cpos.cls = placed.cls and cpos.cno = least(place0 + 1, clen.n) where prefix is null),
aligned as (
  select *, row_number() over (partition by row_id order by place) - 1 as i
  from (select *, row_number() over (partition by row_id, pos, verb_type, affix_type order by place) as nth from parsed) where nth = 1)"""


def translated(name: str, source: str) -> str:
    """CTEs after ``parsed`` that end in ``name``, with its columns: the glosses of another language."""
    return f"""
{name}_ent(prefix, eno, epos, everb, eaffix) as (values {_entries(G.TRANSLATION_ANNOTATIONS)}),
{annotated(name + '_ann', source, G.TRANSLATION_ANNOTATIONS)},
{name}_all as (
  select a.row_id, no, eno, item as gloss, epos as pos, everb as verb_type, a.qualifier, eaffix as affix_type from {name}_ann a join {name}_ent using (prefix)
  union all
  select a.row_id, no, 0, item, case when l.row_id is not null then l.pos when clen.n is null then 'PHRASE' else cpos.pos end, l.verb_type, l.qualifier, l.affix_type
  from {name}_ann a left join aligned l on l.row_id = a.row_id and l.i = a.no - 1 left join clen on clen.cls = a.cls left join cpos on cpos.cls = a.cls and cpos.cno = least(a.no, clen.n)
  where a.prefix is null and item <> ''),
{name} as (select row_id, (row_number() over (partition by row_id order by no, eno) - 1)::int as place, gloss, pos, verb_type, qualifier, affix_type from {name}_all)"""


def translation_groups(core: dict[str, str], extension: dict[str, str]) -> str:
    """Translations of the first row of each word by meaning group; ``core`` columns in the gloss language, ``extension`` columns as cells."""
    names = lambda table: "case " + "{0} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items())
    key = lambda t: f"{names(search.POS_NAMES).format(t + '.pos')} else 'phrase' end as p, {names(search.VERB_NAMES).format(t + '.verb_type')} end as v"
    sources = ", ".join(f"src_{c} as (select row_id, {c} as text, wordclass as cls from words)" for c in ("translationeng", *core))
    glosses = ", ".join(translated(f"tr_{c}", f"src_{c}") for c in core)
    in_core = " union all ".join(rf"select x.row_id, x.g, x.p, x.v, '{lang}' as lang, trim(regexp_replace(y.gloss, '\s*<[mfn]>', '', 'g')) as text_ from (select *, {key('t')} from tr_{c} t) y join grp x on x.row_id = y.row_id and x.p = y.p and x.v is not distinct from y.v" for c, lang in core.items())
    cells = " union all ".join(f"select word, '{lang}' as lang, string_split(trim({c}), '; ') as v from ext where {c} is not null and trim({c}) not in ('', 'False')" for c, lang in extension.items())
    return rf"""
with {WORDS}, {sources}, {parsed('src_translationeng')}, {glosses},
lead as (select t.row_id, t.place, t.gloss, {key('t')} from parsed t),
grp as (select *, row_number() over (partition by row_id order by first_) - 1 as g from (select row_id, p, v, min(place) as first_ from lead group by all)),
ext as (select *, globasa as word from (select *, row_number() over (partition by globasa order by ext_id) as k from menalari_extension where globasa is not null) where k = 1),
cell as (select word, lang, generate_subscripts(v, 1) - 1 as g, unnest(v) as items from ({cells})),
item as (select words.row_id, lang, g, unnest(list_filter(string_split(items, ', '), lambda x: trim(regexp_replace(x, '\s*<[mfn]>', '', 'g')) <> '')) as x from cell join words using (word)),
found as (
  select l.row_id, x.g, x.p, x.v, 'English' as lang, l.gloss as text_ from lead l join grp x on x.row_id = l.row_id and x.p = l.p and x.v is not distinct from l.v
  union all {in_core}
  union all select grp.row_id, grp.g, p, v, lang, trim(regexp_replace(x, '\s*<[mfn]>', '', 'g')) || coalesce(' <' || nullif(regexp_extract(x, '<([mfn])>', 1), '') || '>', '') from item join grp on grp.row_id = item.row_id and grp.g = item.g)
select word, g as group_no, p as pos, v as verb_type, lang, array_to_string(list_sort(list(distinct text_)), '|') as texts from found join words using (row_id) group by all"""


# --- scripts

LAST_VOWEL = "^(.*)([aeiouAEIOU])([^aeiouAEIOU]*)$"
LAST_VOWEL_BUT_ONE = "^(.*)([aeiouAEIOU])([^aeiouAEIOU]*[aeiouAEIOU][^aeiouAEIOU]*)$"


def shown_stress(word: str, change: str) -> str:
    """Stress as the written scripts show it; ``change`` makes the stressed vowel of ``@``."""

    def put(pattern: str) -> str:
        before, vowel, after = (f"regexp_extract({word}, '{pattern}', {i})" for i in (1, 2, 3))
        return f"{before} || {change.replace('@', vowel)} || {after}"

    vowels = f"len(regexp_replace({word}, '[^aeiouAEIOU]', '', 'g'))"
    return f"case when lower({word}) in ({sql_list(S.UNSTRESSED)}) or {vowels} < 2 then {word} when regexp_matches(lower({word}), '[aeiou]$') then {put(LAST_VOWEL_BUT_ONE)} else {put(LAST_VOWEL)} end"


def _cyrillic() -> str:
    out = "regexp_replace(" + shown_stress("r", "@ || chr(769)") + r", 'Y([aeiou])', '\1', 'g')"
    for latin, letter in (("y[aA]", "я"), ("y[uU]", "ю"), ("YA", "Я"), ("YU", "Ю"), ("y[eE]", "йе"), ("y[iI]", "йи"), ("y[oO]", "йо"), ("YE", "Йе"), ("YI", "Йи"), ("YO", "Йо")):
        out = f"regexp_replace({out}, '{latin}', '{letter}', 'g')"
    return f"translate({out}, '{S.LATIN + S.LATIN.upper()}', '{S.CYRILLIC + S.CYRILLIC.upper()}')"


def _featural() -> str:
    out = shown_stress("lower(r)", "upper(@)")
    for _ in range(2):  # neighbouring pairs of vowels overlap
        out = rf"regexp_replace({out}, '([aeiouAEIOU])([aeiouAEIOU])', '\1{S.BREAK}\2', 'g')"
    out = rf"regexp_replace({out}, 'n([gk])', '{S.ENGMA}\1', 'g')"
    return f"translate(reverse(replace(reverse({out}), 'rr', '{S.TRILL}')), '{S.LATIN}AEIOU', '{S.FEATURAL + S.FEATURAL_STRESSED}')"


def _converted(how: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(example, '[a-zA-Z]+|[^a-zA-Z]+'), lambda r: case when regexp_matches(r, '^[a-zA-Z]') then {how} else r end), '')"


ACUTE = f"translate(@, '{S.PLAIN_VOWELS}', '{S.ACUTE_VOWELS}')"
SCRIPTS = f"select row_id, {_converted(shown_stress('r', ACUTE))} as latin, {_converted(_cyrillic())} as cyrillic, {_converted(_featural())} as featural from word_list where example is not null"


# --- the dictionary export


def _mark(tag: str) -> str:
    return f"""'<s n = "' || {tag} || '"/>'"""


def _blanks(text: str) -> str:
    return rf"array_to_string(list_filter(regexp_split_to_array({text}, '\s+'), lambda z: z <> ''), '<b/>')"


def _language(column: str, lang: str, gendered: bool) -> str:
    text = strip(rf"regexp_replace({column}, '\(_.*?_\)', '', 'g')")
    item = strip(f"unnest(string_split(string_split({text}, '; ')[no + 1], ', '))")
    without, bare = strip(r"regexp_replace(g, '\(.*?\)', '', 'g')"), strip("regexp_replace(g, '[()]', '', 'g')")
    marks = "regexp_extract_all(item, '<([mfn])>', 1)"
    foreign = f"unnest(case when noun and len({marks}) > 0 then list_transform({marks}, lambda m: case m when 'n' then 'nt' else m end) else [null] end)" if gendered else "null"
    right = _blanks("regexp_replace(item, '<.*?>', '', 'g')" if gendered else "item")
    return rf"""
select '{lang}' as lang, word, '<e><p><l>' || case when noun then {_blanks('word')} else word end || {_mark('tag')} || case when noun then {_mark(quoted(export.NO_GENDER))} else '' end
  || '</l>   <r>' || {right} || {_mark('tag')} || coalesce({_mark('f')}, '') || '</r></p></e>' as line
from (select *, {foreign} as f from (
  select word, noun, tag, unnest(case when noun and regexp_matches(g, '\(.*?\)') then [{without}, {bare}] else [g] end) as item
  from (select word, noun, tag, {item} as g from base where {column} is not null)) where item <> '' and not starts_with(item, '_'))"""


def _dictionary() -> str:
    tags = sql_values((k, i, t) for k, v in export.CLASS_TAGS.items() for i, t in enumerate(v))
    noun = f"""'<e lm="' || word || '">       <i>' || {_blanks('word')} || '</i><par n="__n"/></e>'"""
    other = f"'<e><p><l>' || word || '</l>       <r>' || word || {_mark('tag')} || '</r></p></e>'"
    languages = [_language("translationeng", "eng", False), _language("translationspa", "spa", True), _language("translationepo", "epo", False)]
    return f"""
with {WORDS}, tags(cls, no, tag) as (values {tags}),
base as (
  select w.*, t.no, t.tag, t.tag in ('n', 'np') as noun
  from words w join tags t on t.cls = case when w.wordclass in (select cls from tags) then w.wordclass else string_split(w.wordclass, '.')[1] end
  where not starts_with(word, '-') and not coalesce(wordclass in ({sql_list(export.FUNCTION_CLASSES)}), false))
select 'mono' as lang, word, case when noun then {noun} else {other} end as line from base
union all """ + " union all ".join(languages)


DICTIONARY = _dictionary()


# --- dictionary records and nested objects


def as_list(x: str) -> str:
    """A JSON list, or its one bare member, as a list."""
    return f"case json_type({x}) when 'ARRAY' then json_extract({x}, '$[*]') when 'OBJECT' then [{x}] when 'VARCHAR' then [{x}] else [] end"


def _texts(x: str) -> str:
    return f"list_transform({as_list(x)}, lambda x: x->>'$')"


SENSES = f"""
rec as (select rec_id, raw_line::json as j from raw_wiktextract where json_valid(raw_line)),
english as (select rec_id, j->>'word' as word, j->>'pos' as pos, j from rec where json_type(j) = 'OBJECT' and j->>'lang' = 'English' and json_type(j, '$.word') = 'VARCHAR'),
listed as (select rec_id, word, pos, {as_list("json_extract(j, '$.senses')")} as m from english),
sense as (select rec_id, word, pos, m[i] as o, i from (select *, unnest(range(1, len(m) + 1)) as i from listed)),
senses as (
  select word, pos, (row_number() over (partition by word, pos order by rec_id, i) - 1)::int as sense_no, {_texts("json_extract(o, '$.glosses')")} as g, {_texts("json_extract(o, '$.raw_glosses')")} as rg, json_extract(o, '$.examples') as e
  from sense where json_type(o) = 'OBJECT')"""


def _content(x: str) -> str:
    word = "case when ends_with(x, '''s') then regexp_replace(x, '[''s]+$', '') else x end"
    return f"list_distinct(list_filter(list_transform(regexp_extract_all(lower({x}), '[a-zA-Z'']+'), lambda x: {word}), lambda x: x <> '' and x not in ({sql_list(T.STOP_WORDS)})))"


def _inside(glosses: str) -> str:
    return f"len(list_filter({glosses}, lambda y: contains(lower(y), k) or (after <> '' and contains(lower(y), after)))) > 0"


SENSE_DEFINITIONS = f"""
with {SENSES},
tr as (select word, pos, unnest(case json_type(j, '$.translations') when 'ARRAY' then json_extract(j, '$.translations[*]') when 'OBJECT' then [json_extract(j, '$.translations')] else [] end) as t from english),
meant as (select distinct word, pos, t->>'sense' as sense from tr where t->>'word' is not null and t->>'sense' is not null and t->>'code' is not null),
key as (select *, {strip("lower(sense)")} as k, {_content("sense")} as w from meant),
keyed as (select *, case when contains(k, ':') then {strip("k[instr(k, ':') + 1:]")} else '' end as after from key where k <> ''),
pair as (select keyed.*, sense_no, g, rg, e, case when len(w) > 0 then list_max(list_transform(g, lambda y: len(list_intersect(w, {_content("y")})) / len(w))) end as share from keyed join senses using (word, pos)),
tiered as (select *, case when {_inside("g")} then 1 when {_inside("rg")} then 2 when share >= 0.5 then 3 end as tier from pair),
best as (select *, row_number() over (partition by word, pos, sense order by tier, case when tier = 3 then -share else 0 end, sense_no) as nth from tiered where tier is not null)
select word, pos, sense, sense_no, coalesce(g[-1], '') as definition,
  array_to_string(list_transform(({as_list("e")})[1:3], lambda x: coalesce(x->>'text', '')), '|') as examples
from best where nth = 1"""


def _canonical(x: str, children: dict[str, str]) -> str:
    """Text of an object that is the same whatever the order of its members, nulls left out; ``children`` makes that of members that hold objects."""
    cases = " ".join(f"when k = '{name}' then {text}" for name, text in children.items())
    member = f"json_extract({x}, '$.\"' || k || '\"')"
    value = f"case {cases} else {member}::varchar end" if cases else f"{member}::varchar"
    return f"array_to_string(list_filter(list_transform(list_sort(json_keys({x})), lambda k: case when json_type({member}) = 'NULL' then null else k || '=' || ({value}) end), lambda z: z is not null), ';')"


def _objects(x: str) -> str:
    """Canonical text of a list of objects; an empty list counts as none."""
    return f"nullif('[' || array_to_string(list_transform({as_list(x)}, lambda o: case when json_type(o) = 'OBJECT' then {_canonical('o', {})} else o::varchar end), ',') || ']', '[]')"


_BRIDGE = f"""
with rec as (select rec_id, raw_line::json as j from raw_wiktextract where json_valid(raw_line) and json_type(case when json_valid(raw_line) then raw_line end) = 'OBJECT'),
sense as (select unnest({as_list("json_extract(j, '$.senses')")}) as o from rec),
s as (select o from sense where json_type(o) = 'OBJECT'),
e as (select * from (select unnest({as_list("json_extract(o, '$.examples')")}) as o from s) where json_type(o) = 'OBJECT'),
t as (select * from (select unnest({as_list("json_extract(o, '$.translations')")}) as o from s union all select unnest({as_list("json_extract(j, '$.translations')")}) from rec) where json_type(o) = 'OBJECT')"""
_SENSE_TEXT = _canonical("o", {m: _objects(f"json_extract(o, '$.{m}')") for m in ("examples", "translations")})
NODES = f"""{_BRIDGE},
n as (select 'sense' as child, {_SENSE_TEXT} as c from s union all select 'example', {_canonical("o", {})} from e union all select 'translation', {_canonical("o", {})} from t)
select child, count(distinct c) as objects, count(*) as occurrences from n group by child"""


def _one_of_each(table: str, text: str, columns: dict[str, str]) -> str:
    return f"{_BRIDGE}, n as (select {text} as c, {', '.join(f'{x} as {name}' for name, x in columns.items())} from {table}) select {', '.join(f'any_value({name}) as {name}' for name in columns)}, count(*) as n_occurrences from n group by c"


def _joined(member: str) -> str:
    x = f"json_extract(o, '$.{member}')"
    return f"case when json_type({x}) in ('ARRAY', 'OBJECT', 'VARCHAR') then array_to_string({_texts(x)}, '|') end"


SENSE_NODES = _one_of_each("s", _SENSE_TEXT, {m: _joined(m) for m in ("glosses", "raw_glosses", "tags")})
EXAMPLE_NODES = _one_of_each("e", _canonical("o", {}), {m: f"o->>'{m}'" for m in ("text", "english", "type")})
TRANSLATION_NODES = _one_of_each("t", _canonical("o", {}), {**{m: f"o->>'{m}'" for m in ("word", "code", "sense", "romanization")}, "tags": _joined("tags")})
