"""Queries over the word list, the extension table, the dumps and the dictionary records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import gloss as G
from lexmill.functions import script as S
from lexmill.functions import text as T
from lexmill.operators import export, rows, search, sense
from lexmill.plans import twins
from lexmill.plans.twins import ALTERNATIVES, FULL, KEYS, LAST_VOWEL, LAST_VOWEL_BUT_ONE, LEADING, TRAILING, WORDS, sql_list, strip
from lexmill.session import table
from lexmill.sources import readers

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def words(spark: SparkSession, sf: str) -> DataFrame:
    """The first row of each word."""
    own = table(spark, sf, "word_list").where("word is not null")
    return rows.keep_first(own, ["word"], ["added_at", "row_id"])


# --- text functions ------------------------------------------------------------------------


@query(f"""
with g as (select row_id, unnest(string_split({strip('translationeng')}, '; ')) as g, generate_subscripts(string_split({strip('translationeng')}, '; '), 1) - 1 as group_no from word_list where translationeng is not null),
i as (select row_id, group_no, list_filter(list_transform(string_split(g, ','), lambda x: {strip('x')}), lambda x: x <> '') as v from g)
select row_id, group_no::int as group_no, (unnest(range(1, len(v) + 1)) - 1)::int as item_no, unnest(v) as item from i
""")
def t_groups_items(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "word_list").select("row_id", F.posexplode(T.split_groups("translationeng")).alias("group_no", "g"))
    return g.select("row_id", "group_no", F.posexplode(T.split_items("g")).alias("item_no", "item"))


@query(rf"""
select row_id, regexp_replace(translationeng, '\(_.*?_\)', '', 'g') as bare,
  {strip(r"regexp_replace(translationeng, '\(_[^_]*_\)', '', 'g')")} as text_, array_to_string(regexp_extract_all(translationeng, '\(_([^_]*)_\)', 1), ', ') as note
from word_list where translationeng is not null
""")
def t_italic(spark: SparkSession, sf: str) -> DataFrame:
    a = T.italic_annotation("translationeng")
    return table(spark, sf, "word_list").where("translationeng is not null").select("row_id", T.strip_italic("translationeng").alias("bare"), a["text"].alias("text_"), a["note"].alias("note"))


@query(rf"""
with p as (select row_id, unnest(regexp_split_to_array(translationeng, '[,;]')) as p, generate_subscripts(regexp_split_to_array(translationeng, '[,;]'), 1) as i from word_list where translationeng is not null),
n as (select row_id, i, {strip(r"regexp_replace(p, '\(_[^_]*_\)', '', 'g')")} as item, array_to_string(regexp_extract_all(p, '\(_([^_]*)_\)', 1), ', ') as note from p)
select row_id, item, arg_max(note, i) as note from n where item <> '' and note <> '' group by row_id, item
""")
def t_annotation_map(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "word_list").select("row_id", F.explode(T.annotation_map("translationeng")).alias("item", "note"))


_ITEMS = f"items as (select row_id, unnest(list_filter(list_transform(string_split(translationeng, ','), lambda x: {strip('x')}), lambda x: x <> '')) as item from word_list where translationeng is not null)"


@query(rf"""
with {_ITEMS}, e as (select row_id, item, {FULL} as f, {LEADING} as a, {TRAILING} as b from items)
select row_id, item, case when a <> item and a <> '' and f <> '' and a <> f then a || '|' || f when b <> item and b <> '' and f <> '' and b <> f then b || '|' || f else item end as variants from e
""")
def t_expand_context(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "word_list").select("row_id", F.explode(T.split_items("translationeng")).alias("item"))
    return items.select("row_id", "item", F.array_join(T.expand_context("item"), "|").alias("variants"))


@query(rf"""
with {_ITEMS} select row_id, item, case when regexp_replace(item, '\(.*?\)', '', 'g') <> item then {strip(r"regexp_replace(item, '\(.*?\)', '', 'g')")} || '|' || {strip("regexp_replace(item, '[()]', '', 'g')")} else item end as variants from items
""")
def t_expand_parentheses(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "word_list").select("row_id", F.explode(T.split_items("translationeng")).alias("item"))
    return items.select("row_id", "item", F.array_join(T.expand_parentheses("item"), "|").alias("variants"))


@query()
def t_items_outside_parentheses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "word_list").select("row_id", F.posexplode(T.split_items_outside_parentheses("translationeng")).alias("pos_no", "item"))


@query(rf"""
with s as (select row_id, {strip("unnest(string_split(" + strip('translationeng') + ", '; '))")} as s from word_list where translationeng is not null),
k as (select *, regexp_extract(lower(s), '^({ALTERNATIVES}):', 1) as key, regexp_extract(lower(s), '^([a-z][a-z./]*)\s*\(([^)]+)\)\s*:', 1) as b1, regexp_extract(lower(s), '^([a-z][a-z./ ]+?)\s*\(([^)]+)\)\s*:', 1) as b2,
  regexp_extract(lower(s), '^([a-z][a-z./ ]*?)\s*\(([^)]+)\)\s*:', 2) as q from s)
select row_id, case when key <> '' then key when b1 in ({sql_list(KEYS)}) then b1 when trim(b2) in ({sql_list(KEYS)}) then trim(b2) end as prefix,
  case when key <> '' then {strip("s[length(key) + 2:]")} when b1 in ({sql_list(KEYS)}) or trim(b2) in ({sql_list(KEYS)}) then {strip("s[instr(s, ':') + 1:]")} else s end as gloss,
  case when key <> '' then nullif(regexp_extract(key, '\(([^)]+)\)', 1), '') when b1 in ({sql_list(KEYS)}) or trim(b2) in ({sql_list(KEYS)}) then trim(q) end as qualifier from k
""")
def t_annotation_prefix(spark: SparkSession, sf: str) -> DataFrame:
    seg = table(spark, sf, "word_list").select("row_id", F.explode(T.split_groups("translationeng")).alias("s"))
    return seg.select("row_id", G.annotation("s").alias("a")).select("row_id", "a.prefix", "a.gloss", "a.qualifier")


@query(f"with src as (select row_id, translationeng as text, wordclass as cls from word_list), {twins.parsed('src')} select row_id, place, gloss, pos, verb_type, qualifier, affix_type from parsed")
def t_parsed_glosses(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "word_list").select("row_id", F.posexplode(G.parse_annotated("translationeng", "wordclass")).alias("place", "g"))
    return g.select("row_id", "place", "g.*")


@query(f"with src as (select row_id, translationeng as text, wordclass as cls from word_list), other as (select row_id, translationepo as text, wordclass as cls from word_list), {twins.parsed('src')}, {twins.translated('tr', 'other')} select * from tr")
def t_parsed_translations(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "word_list").withColumn("e", G.parse_annotated("translationeng", "wordclass"))
    return w.select("row_id", F.posexplode(G.parse_translation("translationepo", F.col("e"), "wordclass")).alias("place", "g")).select("row_id", "place", "g.*")


@query()
def t_parsed_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries in either notation."""
    g = table(spark, sf, "word_list").select("row_id", F.posexplode(G.parse_entry("translationeng", "wordclass")).alias("place", "g"))
    return g.select("row_id", "place", "g.*")


_CLASSES = ", ".join(f"('{k}', '{v[0]}')" for k, v in G.WORD_CLASSES.items())
_VERBS = " ".join(f"when '{k}' then '{v}'" for k, v in G.VERB_CLASSES.items())


@query(f"""
with c(cls, pos) as (values {_CLASSES}),
w as (select distinct wordclass as cls from word_list where wordclass is not null),
v as (select cls, list_filter(list_reverse(list_transform(string_split(replace(cls, ';', '.'), '.'), lambda x: {strip('x')})), lambda x: x in ({sql_list(G.VERB_CLASSES)}))[1] as last from w)
select w.cls as wordclass, case when w.cls = 'b' then 'NOUN' when w.cls = 't' or starts_with(w.cls, 'tabl: t') then 'ADJECTIVE' when starts_with(w.cls, 'b.') or starts_with(w.cls, 'f.') then 'VERB' else coalesce(c.pos, 'PHRASE') end as pos,
  case when w.cls <> 'b' and w.cls <> 't' and not starts_with(w.cls, 'tabl: t') and (starts_with(w.cls, 'b.') or starts_with(w.cls, 'f.')) then coalesce(case v.last {_VERBS} end, 'TRANSITIVE') end as verb_type
from w join v using (cls) left join c using (cls)
""")
def t_default_pos(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "word_list").where("wordclass is not null").select("wordclass").distinct().select("wordclass", G.default_pos("wordclass").alias("d")).select("wordclass", "d.pos", "d.verb_type")


CELLS = {"deu": "German", "fra": "French", "rus": "Russian", "zho": "Chinese"}
_CELLS = "cells as (" + " union all ".join(f"select ext_id, '{c}' as lang, {c} as cell from menalari_extension" for c in CELLS) + ")"


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """(ext_id, lang, cell) of every language of the extension table."""
    lang = F.explode(F.array(*[F.struct(F.lit(c).alias("lang"), F.col(c).alias("cell")) for c in CELLS])).alias("c")
    return table(spark, sf, "menalari_extension").select("ext_id", lang).select("ext_id", "c.*")


@query(rf"""
with {_CELLS}, g as (select ext_id, lang, list_transform(string_split(trim(cell), '; '), lambda g: list_filter(string_split(g, ', '), lambda x: trim(regexp_replace(x, '\s*<[mfn]>', '', 'g')) <> '')) as v from cells where cell is not null and trim(cell) not in ('', 'False')),
h as (select ext_id, lang, unnest(v) as i, generate_subscripts(v, 1) - 1 as group_no from g),
t as (select ext_id, lang, group_no, unnest(i) as x, generate_subscripts(i, 1) - 1 as item_no from h)
select ext_id, lang, group_no::int as group_no, item_no::int as item_no, trim(regexp_replace(x, '\s*<[mfn]>', '', 'g')) as text_, nullif(regexp_extract(x, '<([mfn])>', 1), '') as gender from t
""")
def t_cells(spark: SparkSession, sf: str) -> DataFrame:
    g = cells(spark, sf).select("ext_id", "lang", F.posexplode(T.parse_cell("cell")).alias("group_no", "g"))
    return g.select("ext_id", "lang", "group_no", F.posexplode("g").alias("item_no", "i")).select("ext_id", "lang", "group_no", "item_no", F.col("i.text").alias("text_"), "i.gender")


@query(f"with {_CELLS} select ext_id, lang, coalesce(trim(cell), '') as cell from cells")
def t_cell_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf).select("ext_id", "lang", T.fold_cell(T.parse_cell("cell")).alias("cell"))


@query(rf"select row_id, regexp_replace({strip("string_split(translationeng, ';')[1]")}, '^[a-z./ ]+:\s*', '') as gloss from word_list where translationeng is not null")
def t_short_gloss(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "word_list").where("translationeng is not null").select("row_id", T.short_gloss("translationeng").alias("gloss"))


@query(f"""
select row_id, array_to_string(list_filter(list_transform(string_split(synonyms, ','), lambda x: {strip('x')}), lambda x: x <> ''), '|') as synonyms, array_to_string(string_split(replace(tags, ' ', '_'), ',_'), '|') as tags from word_list
""")
def t_csv_cells(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "word_list").select("row_id", F.array_join(T.split_items("synonyms"), "|").alias("synonyms"), F.array_join(T.normal_tags("tags"), "|").alias("tags"))


_FUNCTION = sql_list(S.UNSTRESSED)
_STRESS = "case when len(regexp_replace({w}, '[^aeiouAEIOU]', '', 'g')) = 0 then {w} when regexp_matches(lower({w}), '[aeiou]$') and len(regexp_replace({w}, '[^aeiouAEIOU]', '', 'g')) > 1 then regexp_extract({w}, '{p2}', 1) || translate(regexp_extract({w}, '{p2}', 2), 'aeiouAEIOU', 'áéíóúÁÉÍÓÚ') || regexp_extract({w}, '{p2}', 3) else regexp_extract({w}, '{p1}', 1) || translate(regexp_extract({w}, '{p1}', 2), 'aeiouAEIOU', 'áéíóúÁÉÍÓÚ') || regexp_extract({w}, '{p1}', 3) end"


@query(rf"""
select distinct word, len(regexp_replace(array_to_string(list_filter(regexp_split_to_array(lower(word), '\s+'), lambda w: regexp_matches(w, '^\p{{L}}')), ' '), '[^aeiou]', '', 'g'))::int as syllables,
  case when word in ({_FUNCTION}) then word else {_STRESS.format(w='word', p1=LAST_VOWEL, p2=LAST_VOWEL_BUT_ONE)} end as stressed,
  case when lower(word) in ({_FUNCTION}) or len(regexp_replace(word, '[^aeiouAEIOU]', '', 'g')) < 2 then word else {_STRESS.format(w='word', p1=LAST_VOWEL, p2=LAST_VOWEL_BUT_ONE)} end as shown
from word_list where word is not null
""")
def t_stress(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "word_list").where("word is not null").select("word", T.syllables("word").alias("syllables"), S.stress_word("word").alias("stressed"), S.latin_stressed("word").alias("shown")).distinct()


@query(twins.SCRIPTS)
def t_scripts(spark: SparkSession, sf: str) -> DataFrame:
    """Example sentences in every script."""
    return table(spark, sf, "word_list").where("example is not null").select("row_id", S.convert_sentence("example", "Latin (stressed)").alias("latin"), S.convert_sentence("example", "Cyrillic").alias("cyrillic"), S.convert_sentence("example", "Musa").alias("featural"))


@query("""
select coalesce(case when starts_with(c7, 'sc=') then substr(c7, 4) end, case when starts_with(c8, 'sc=') then substr(c8, 4) end, case when starts_with(c9, 'sc=') then substr(c9, 4) end, case when starts_with(c10, 'sc=') then substr(c10, 4) end) as script,
 count(*) as n, count(distinct coalesce(case when starts_with(c7, 'tr=') then substr(c7, 4) end, case when starts_with(c8, 'tr=') then substr(c8, 4) end, case when starts_with(c9, 'tr=') then substr(c9, 4) end, case when starts_with(c10, 'tr=') then substr(c10, 4) end)) as romanizations from dump_tc group by 1
""")
def t_extras(spark: SparkSession, sf: str) -> DataFrame:
    extras = ["c7", "c8", "c9", "c10"]
    return table(spark, sf, "dump_tc").groupBy(T.key_value(extras, "sc").alias("script")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(T.key_value(extras, "tr")).alias("romanizations"))


@query(rf"""
with w as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.\n]'), lambda s: {strip('s')}), lambda s: s <> '') as v from documents where text is not null)
select doc_id, len(v)::int as n, md5(array_to_string(list_transform(v, lambda s: s || '.'), chr(10))) as digest from w
""")
def t_sentences(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", T.sentences("text").alias("v"))
    return d.select("doc_id", F.size("v").alias("n"), F.md5(F.array_join("v", "\n")).alias("digest"))


@query(r"""
with x as (select doc_id, regexp_replace(text, '\b(the|some) (\p{L}+)', '\1 **\2**', 'g') as m from documents where text is not null)
select doc_id, md5(regexp_replace(m, '\*\*.*?\*\*', '[...]', 'g')) as cloze from x
""")
def t_cloze(spark: SparkSession, sf: str) -> DataFrame:
    marked = F.regexp_replace("text", r"\b(the|some) (\p{L}+)", "$1 **$2**")
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.md5(T.cloze(marked)).alias("cloze"))


_STOP = sql_list(T.STOP_WORDS)


@query(f"""
with s as (select distinct c4 from dump_tc where c4 is not null),
w as (select c4, list_transform(regexp_extract_all(lower(c4), '[a-zA-Z'']+'), lambda x: case when ends_with(x, '''s') then regexp_replace(x, '[''s]+$', '') else x end) as w from s)
select c4, array_to_string(list_sort(list_distinct(list_filter(w, lambda x: x <> '' and x not in ({_STOP})))), ' ') as content from w
""")
def t_content_words(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "dump_tc").where("c4 is not null").select("c4").distinct()
    return s.select("c4", F.array_join(F.array_sort(T.content_words("c4")), " ").alias("content"))


@query(r"""
select pfx, count(*) as n, count(distinct c1) as words from (select *, case when length(c1) < 2 or contains(c1[1:2], '/') or contains(c1[1:2], '\') then 'single_char' else upper(c1[1:2]) end as pfx from dump_tc) group by pfx
""")
def t_prefix_partitions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "dump_tc").groupBy(T.prefix_key("c1").alias("pfx")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c1").alias("words"))


# --- sources, filters and joins over the lexical tables ---------------------------------------


def dump(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "dump_tc").select("row_id", F.col("c1").alias("word"), F.col("c2").alias("pos"), F.col("c4").alias("sense"), F.col("c5").alias("lang"), F.col("c6").alias("translation"), "c7")


@query(f"""
with asked as (select word as w from word_list union select {strip("unnest(string_split(translationeng, ','))")} from word_list union select c1 from dump_tc)
select row_id, c1 as word, c5 as lang, c6 as translation from dump_tc where c1 in (select w from asked where w is not null)
""")
def s_prefix_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """All words of the list, the items of their glosses and all headwords, across the partitions."""
    w = table(spark, sf, "word_list")
    d = readers.with_prefix(dump(spark, sf))
    asked = w.select("word").unionByName(w.select(F.explode(T.split_items("translationeng")).alias("word"))).unionByName(d.select("word"))
    return readers.prefix_lookup(d, asked.distinct()).select("row_id", "word", "lang", "translation")


@query("""
with r as (select raw_line::json as j from raw_wiktextract where json_valid(raw_line)),
e as (select j->>'word' as word, j->>'pos' as pos, unnest(case json_type(j, '$.translations') when 'ARRAY' then json_extract(j, '$.translations[*]') when 'OBJECT' then [json_extract(j, '$.translations')] else [] end) as t from r where json_type(j) = 'OBJECT' and j->>'lang' = 'English' and json_type(j, '$.word') = 'VARCHAR')
select distinct word, pos, t->>'sense' as sense, t->>'code' as lang, t->>'word' as tr_word from e where t->>'word' is not null and t->>'sense' is not null and t->>'code' is not null
""")
def s_translations(spark: SparkSession, sf: str) -> DataFrame:
    """Translations of all records, a bare object included."""
    t = readers.translations(readers.parse_dictionary(table(spark, sf, "raw_wiktextract")))
    return t.select("word", "pos", "sense", "lang", "tr_word").distinct()


@query("select distinct j->>'word' as word, j->>'pos' as pos from (select raw_line::json as j from raw_wiktextract where json_valid(raw_line)) where json_type(j) = 'OBJECT' and j->>'lang' = 'Spanish' and j->>'word' is not null")
def s_foreign_pos(spark: SparkSession, sf: str) -> DataFrame:
    return readers.foreign_pos(readers.parse_dictionary(table(spark, sf, "raw_wiktextract")))


@query(f"""
with {twins.SENSES} select word, pos, sense_no, array_to_string(g, '|') as glosses, case json_type(e) when 'ARRAY' then json_array_length(e)::int when 'OBJECT' then 1 end as n_examples from senses
""")
def s_senses(spark: SparkSession, sf: str) -> DataFrame:
    s = readers.senses(readers.parse_dictionary(table(spark, sf, "raw_wiktextract")), ["rec_id"])
    return s.select("word", "pos", "sense_no", F.array_join("glosses", "|").alias("glosses"), F.when(F.col("examples").isNotNull(), F.size("examples")).alias("n_examples"))


@query("select id as code, min(ref_name) as name from iso_639_3 group by id")
def s_language_names(spark: SparkSession, sf: str) -> DataFrame:
    return readers.language_names(table(spark, sf, "iso_639_3"), "id", "ref_name")


@query("select lang, label, id from (select id, part1, part2b, part2t from iso_639_3) unpivot (label for lang in (part1, part2b, part2t)) where label <> ''")
def s_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    return readers.unpivot_labels(table(spark, sf, "iso_639_3").select("id", "part1", "part2b", "part2t"), "id").select("lang", "label", "id")


_MARKS = "marks as (select c1 as glb, coalesce(c6, '') as eng, coalesce(c2, '') as pos, coalesce(c4, '') as sense, case when c7 = 'm' then 's' else '' end as app, coalesce(case when c7 = 'f' then 'e' end, case when c7 = 'm' then 'v' end, case when c7 = 'n' then 'l' end, case when c7 = 'c' then 'a' end) as tier, row_id from dump_tc)"


def marking_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Markings in the older layout, made of the dump's codes."""
    t = table(spark, sf, "dump_tc")
    flag = lambda code, letter: F.when(F.col("c7") == code, letter)
    return t.select(F.col("c1").alias("Glb"), F.col("c6").alias("Eng"), F.col("c2").alias("Prt of Sp"), F.col("c4").alias("Sense"), F.coalesce(flag("m", "s"), F.lit("")).alias("App?"), flag("c", "a").alias("Script?"), flag("n", "l").alias("LLM?"), flag("m", "v").alias("Vetted?"), flag("f", "e").alias("Expert?"), "row_id")


@query(f"with {_MARKS} select glb, eng, pos, sense, arg_max(app, row_id) as app, arg_max(tier, row_id) as tier from marks where tier is not null group by all")
def s_markings(spark: SparkSession, sf: str) -> DataFrame:
    return readers.markings(marking_rows(spark, sf), "row_id").select("glb", "eng", "pos", "sense", "app", "tier")


@query("with m as (select distinct c1, c6 from dump_tc where c7 in ('m', 'f')) select count(*) as n, count(*) filter (where c1 = 'set') as n_set from m where c6 is not null")
def f_accepted(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "dump_tc").withColumns({"app": F.lit("s"), "tier": F.when(F.col("c7") == "m", "v").when(F.col("c7") == "f", "e")})
    return sense.accepted(d).where("c6 is not null").select("c1", "c6").distinct().agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c1") == "set").alias("n_set"))


@query("select row_id, word from word_list where word >= (select min(word) from word_list where starts_with(word, 'mi'))")
def f_resume(spark: SparkSession, sf: str) -> DataFrame:
    """The word list from the first word with a prefix on, in word order."""
    return rows.resume_from(table(spark, sf, "word_list"), "word", "mi", "word").select("row_id", "word")


@query(f"with {WORDS} select word, wordclass from words where not starts_with(word, '-') and not coalesce(wordclass in ({sql_list(export.FUNCTION_CLASSES)}), false)")
def f_content_words(spark: SparkSession, sf: str) -> DataFrame:
    return export.content_words(words(spark, sf)).select("word", "wordclass")


_ALL_CLASSES = ", ".join(f"('{k}', {i}, '{p}')" for k, v in G.WORD_CLASSES.items() for i, p in enumerate(v))
_DICT = ", ".join(f"('{k}', '{v}')" for k, v in G.DICTIONARY_POS.items())


@query(f"""
with {WORDS}, c(wordclass, place, pos) as (values {_ALL_CLASSES}), d(pos, name) as (values {_DICT})
select word, place::int as place, c.pos, d.name as dictionary_pos, string_split(wordclass, '.')[1] as class_key from words join c using (wordclass) join d using (pos)
""")
def f_class_pos(spark: SparkSession, sf: str) -> DataFrame:
    w = words(spark, sf).select("word", G.class_key("wordclass").alias("class_key"), F.posexplode(G.class_pos("wordclass")).alias("place", "pos"))
    return w.withColumn("dictionary_pos", G.dictionary_pos("pos")).where("dictionary_pos is not null")


_DIALECT = "select row_id, c1, case c5 when 'qig' then 'de' when 'qeu' then 'ar' else c5 end as lang, case when c7 = 'm' and c5 = 'qig' then 'Alemannic-German' when c7 = 'f' and c5 = 'qeu' then 'Gulf-Arabic' when c7 = 'n' then 'Valencian' when c7 is not null then c7 end as tag from dump_tc"


@query(f"""
with d as ({_DIALECT}) select lang, count(*) as n from (
  select lang from d where coalesce(tag, '') not in ({sql_list(sense.VARIETY_TAGS)})
  union all select 'de-ale' from d where lang = 'de' and tag = 'Alemannic-German' union all select 'ar-glf' from d where lang = 'ar' and tag = 'Gulf-Arabic') group by lang
""")
def f_dialects(spark: SparkSession, sf: str) -> DataFrame:
    """Standard and dialect translations; two languages and the gender codes stand in for languages and tags."""
    d = table(spark, sf, "dump_tc")
    tag = F.when((F.col("c7") == "m") & (F.col("c5") == "qig"), "Alemannic-German").when((F.col("c7") == "f") & (F.col("c5") == "qeu"), "Gulf-Arabic").when(F.col("c7") == "n", "Valencian").otherwise(F.col("c7"))
    lang = F.when(F.col("c5") == "qig", "de").when(F.col("c5") == "qeu", "ar").otherwise(F.col("c5"))
    return sense.with_dialects(d.select(lang.alias("lang"), F.array_compact(F.array(tag)).alias("tags"))).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {WORDS}, e as (select globasa as word, first(eng_with_senses order by ext_id) as e from menalari_extension where globasa is not null group by 1) select row_id, e.e as senses from words left join e using (word)")
def j_attach(spark: SparkSession, sf: str) -> DataFrame:
    """Words with their extension entry."""
    ext = table(spark, sf, "menalari_extension").where("globasa is not null").select(F.col("globasa").alias("word"), "ext_id", F.col("eng_with_senses").alias("senses"))
    return search.attach(words(spark, sf).select("word", "row_id"), {"ext": ext}, order="ext_id").select("row_id", "ext.senses")


@query("""
with l as (select distinct c1 as w, c2 as pos from dump_tc),
t as (select *, unnest(case pos when 'Noun' then ['Noun', 'Proper noun'] when 'Proper noun' then ['Proper noun', 'Noun'] else [pos] end) as p from l),
r as (select c1 as w, c2 as p, count(*) as n from dump_tc where c7 = 'm' group by all)
select w, pos, p, n from t join r using (w, p)
""")
def j_fallback(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _fallback_sides(spark, sf)
    return sense.fallback_join(left, right, ["w"], _TRIES(), "p").select("w", "pos", "p", "n")


def _TRIES():
    other = F.when(F.col("pos") == "Noun", F.array(F.lit("Proper noun"))).when(F.col("pos") == "Proper noun", F.array(F.lit("Noun"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array("pos"), other)


def _fallback_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "dump_tc").withColumnRenamed("c1", "w")
    left = d.select("w", F.col("c2").alias("pos")).distinct()
    return left, d.where("c7 = 'm'").groupBy("w", F.col("c2").alias("p")).agg(F.count(F.lit(1)).alias("n"))


@query("""
with l as (select distinct c1 as w, c2 as pos from dump_tc), r as (select distinct c1 as w, c2 as p from dump_tc where c7 = 'm')
select w, pos from l where not exists (select 1 from r where r.w = l.w and (r.p = l.pos or (l.pos = 'Noun' and r.p = 'Proper noun') or (l.pos = 'Proper noun' and r.p = 'Noun')))
""")
def j_misses(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _fallback_sides(spark, sf)
    return sense.misses(left, right, ["w"], _TRIES(), "p")


@query("""
with m as (select c1 as w, c2 as k, min(row_id) as v from dump_tc where c2 in ('Noun', 'Verb', 'Adverb') group by all)
select w, coalesce(max(v) filter (where k = 'Verb'), max(v) filter (where k = 'Noun'), max(v) filter (where k = 'Adverb')) as v from m group by w
""")
def j_variant_priority(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "dump_tc").where("c2 in ('Noun', 'Verb', 'Adverb')").groupBy(F.col("c1").alias("w"), F.col("c2").alias("k")).agg(F.min("row_id").alias("v"))
    maps = m.groupBy("w").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    return maps.select("w", sense.variant_priority([F.lit("Verb"), F.lit("Noun"), F.lit("Adverb")], F.col("m")).alias("v"))


@query(f"""
with {WORDS}, z as (select word, string_split(translationeng, '; ') as a, string_split(translationspa, '; ') as b, string_split(translationepo, '; ') as c from words where translationeng is not null and translationspa is not null and translationepo is not null),
n as (select *, least(len(a), len(b), len(c)) as m from z)
select word, (unnest(range(1, m + 1)) - 1)::int as group_no, unnest(a[1:m]) as eng, unnest(b[1:m]) as spa, unnest(c[1:m]) as epo from n
""")
def j_zip_groups(spark: SparkSession, sf: str) -> DataFrame:
    w = words(spark, sf).where("translationeng is not null and translationspa is not null and translationepo is not null")
    return rows.zip_groups(w, ["word"], {"eng": F.split("translationeng", "; "), "spa": F.split("translationspa", "; "), "epo": F.split("translationepo", "; ")})


@query(f"""
with {WORDS}, e as (select word, min(example) as v from word_list where example <> '' group by word), x as (select globasa as word, min(eng_with_senses) as v from menalari_extension where eng_with_senses is not null group by 1), d as (select c1 as word, min(c4) as v from dump_tc where c4 is not null group by 1)
select words.row_id, coalesce(e.v, x.v, d.v) as chosen, case when e.v is not null then 'example' when x.v is not null then 'extension' when d.v is not null then 'dump' end as origin from words left join e using (word) left join x using (word) left join d using (word)
""")
def j_prioritised(spark: SparkSession, sf: str) -> DataFrame:
    """An illustration of each word from the first source that has one."""
    base = words(spark, sf).select("word", "row_id")
    sources = [
        ("example", table(spark, sf, "word_list").where("example <> ''").select("word", "example"), "example"),
        ("extension", table(spark, sf, "menalari_extension").select(F.col("globasa").alias("word"), "eng_with_senses"), "eng_with_senses"),
        ("dump", table(spark, sf, "dump_tc").select(F.col("c1").alias("word"), "c4"), "c4"),
    ]
    return rows.prioritised(base, "word", sources, "chosen", "origin").select("row_id", "chosen", "origin")


@query("select id, coalesce(case id when 'de-ale' then 'Alemannic' end, two, ref_name, id) as name from (select id, case part1 when 'en' then 'English (2)' end as two, ref_name from iso_639_3)")
def f_display_names(spark: SparkSession, sf: str) -> DataFrame:
    two = F.when(F.col("part1") == "en", "English (2)")
    return table(spark, sf, "iso_639_3").select("id", sense.display_name(F.col("id"), two, F.col("ref_name")).alias("name"))


# --- aggregation and sets --------------------------------------------------------------------


@query("select c1, c5, array_to_string(list_sort(list(distinct c6)), ', ') as cell from dump_tc where c6 is not null group by all")
def g_fold_items(spark: SparkSession, sf: str) -> DataFrame:
    return sense.fold_items(table(spark, sf, "dump_tc").where("c6 is not null"), ["c1", "c5"], "c6", "cell")


@query("""
with i as (select c1, c5, c2, array_to_string(list_sort(list(distinct c6)), ', ') as g from dump_tc where c6 is not null and c7 = 'm' group by all),
h as (select c1, array_to_string(list_sort(list(distinct c2)), '; ') as pos_list, array_to_string(list_sort(list(distinct coalesce(c4, ''))), '; ') as senses from dump_tc where c6 is not null and c7 = 'm' group by c1)
select c1, c5, string_agg(g, '; ' order by c2) as cell, pos_list, senses from i join h using (c1) group by c1, c5, pos_list, senses
""")
def g_vetted_fold(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "dump_tc").where("c6 is not null and c7 = 'm'").withColumn("c4", F.coalesce("c4", F.lit("")))
    return sense.vetted_fold(d, "c1", "c2", "c4", "c5", "c6").select("c1", "c5", "cell", "pos_list", "senses")


@query("""
with h as (select distinct c1 from dump_tc), i as (select distinct id from iso_639_3 where id is not null), m as (select c1, c5, min(c6) as v from dump_tc group by all)
select h.c1, md5(string_agg(coalesce(m.v, ''), '|' order by i.id)) as cells from h cross join i left join m on m.c1 = h.c1 and m.c5 = i.id group by h.c1
""")
def g_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """One column for each id of the language table, as a digest of its cells; headwords without a cell stay."""
    wide = pivot_languages(spark, sf)
    return wide.select("c1", F.md5(F.array_join(F.array(*[F.col(c) for c in wide.columns if c != "c1"]), "|", "")).alias("cells"))


def pivot_languages(spark: SparkSession, sf: str) -> DataFrame:
    ids = sorted(r["id"] for r in table(spark, sf, "iso_639_3").where("id is not null").select("id").distinct().collect())
    return rows.pivot_fixed(table(spark, sf, "dump_tc"), ["c1"], "c5", ids, F.min("c6"))


@query("""
with a as (select c1, list(distinct c6) filter (where c7 = 'm' and c6 is not null) as m, list(distinct c6) filter (where c7 = 'f' and c6 is not null) as f, list(distinct c6) filter (where c7 = 'n' and c6 is not null) as n, list(distinct c6) filter (where c7 = 'c' and c6 is not null) as c from dump_tc group by c1),
b as (select c1, coalesce(m, []) as m, coalesce(f, []) as f, coalesce(n, []) as n, coalesce(c, []) as c from a),
v as (select *, len(m) > 0 and len(f) > 0 as sf, len(n) > 0 and len(c) > 0 as ef, list_sort(list_intersect(m, f)) as si, list_sort(list_filter(m, lambda x: not list_contains(f, x))) as su, list_sort(list_intersect(n, c)) as ei, list_sort(list_filter(n, lambda x: not list_contains(c, x))) as eu from b)
select c1, case when ((len(si) > 0 and sf) or not sf) and ((len(ei) > 0 and ef) or not ef) and (sf or ef) then 's' else '' end as app,
 case when sf then array_to_string(si, ', ') || case when len(su) > 0 then ' /' || array_to_string(su, ', ') || '/' else '' end else '' end as spa,
 case when ef then array_to_string(ei, ', ') || case when len(eu) > 0 then ' /' || array_to_string(eu, ', ') || '/' else '' end else '' end as epo from v
""")
def g_crossvalidate(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-validation of one evidence set by another, for two kinds of evidence."""
    d = table(spark, sf, "dump_tc")
    sets = d.groupBy("c1").agg(*[F.collect_set(F.when(F.col("c7") == k, F.col("c6"))).alias(k) for k in "mfnc"])
    return sets.select("c1", sense.crossvalidate(F.col("m"), F.col("f"), F.col("n"), F.col("c")).alias("v")).select("c1", "v.app", "v.spa", "v.epo")


# --- search ---------------------------------------------------------------------------------


def index(spark: SparkSession, sf: str) -> DataFrame:
    return search.term_index(words(spark, sf), {"translationeng": "English", "translationspa": "Spanish", "translationepo": "Esperanto"})


_INDEX = rf"""
cells as (select word, 'English' as lang, translationeng as t from words union all select word, 'Spanish', translationspa from words union all select word, 'Esperanto', translationepo from words),
grp as (select word, lang, regexp_replace(unnest(string_split(t, ';')), '^[a-z./ ]+:\s*', '') as g from cells where t is not null),
idx as (select distinct lang, term, word from (select word, lang, lower({strip("regexp_replace(regexp_replace(unnest(string_split(g, ',')), '_[^_]+_', '', 'g'), '[()]+', '', 'g')")}) as term from grp) where length(term) > 1)
"""


@query(f"with {WORDS}, {_INDEX} select lang, term, word from idx")
def q_index(spark: SparkSession, sf: str) -> DataFrame:
    return index(spark, sf)


@query(f"with {WORDS}, {_INDEX} select lang, count(distinct term) as terms from idx group by lang")
def q_index_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return search.index_size(index(spark, sf))


@query(f"""
with {WORDS}, {_INDEX}, own as (select word, row_id::double as o from words where word <> ''),
t as (select word, 0 as tier, case when word = 'th' then 0.0 else 1.0 end as o, '' as t from own where word in ('th')
 union all select word, 1, o, '' from own where starts_with(lower(word), 'th')
 union all select word, case when term = 'th' then 2 else 3 end, 0.0, case when term = 'th' then '' else term end from idx where lang = 'English' and starts_with(term, 'th')
 union all select word, case when term = 'th' then 4 else 5 end, 0.0, case when term = 'th' then '' else term end from idx where lang = 'Spanish' and starts_with(term, 'th')),
r as (select *, row_number() over (partition by lower(word) order by tier, o, t, word) as k from t), best as (select *, row_number() over (order by tier, o, t, word) as n from r where k = 1)
select n - 1 as place, word, tier from best where n <= 15
""")
def q_suggest(spark: SparkSession, sf: str) -> DataFrame:
    return search.suggest(words(spark, sf), index(spark, sf), "th", ["English", "Spanish"], order="row_id")


_TAGS = f"tags_ as (select word, unnest(list_filter(list_transform(string_split(tags, ','), lambda x: {strip('x')}), lambda x: x <> '')) as tag from words where tags is not null)"


@query(f"with {WORDS}, {_TAGS} select tag, count(*) as n from tags_ group by tag")
def q_tags(spark: SparkSession, sf: str) -> DataFrame:
    return search.tag_counts(search.tag_rows(words(spark, sf), "tags"))


@query(f"with {WORDS}, {_TAGS} select word from tags_ where tag = 'food'")
def q_tag_words(spark: SparkSession, sf: str) -> DataFrame:
    return search.tag_words(search.tag_rows(words(spark, sf), "tags"), "food")


_DERIVED = rf"derived as (select distinct lower(regexp_replace({strip('p')}, '^-+', '')) as part, word from (select word, unnest(string_split({strip('lexiliasel')}, '+')) as p from words where regexp_matches({strip('lexiliasel')}, '^-?\p{{L}}+(\s*\+\s*-?\p{{L}}+)+$')))"


@query(f"with {WORDS}, {_DERIVED} select part, word from derived where lower(word) <> part")
def q_derived_index(spark: SparkSession, sf: str) -> DataFrame:
    return search.derived_index(words(spark, sf), "lexiliasel")


@query(f"with {WORDS}, {_DERIVED} select word from derived where lower(word) <> part and part = (select min(part) from derived)")
def q_derived_words(spark: SparkSession, sf: str) -> DataFrame:
    idx = search.derived_index(words(spark, sf), "lexiliasel")
    return search.derived_words(idx, idx.agg(F.min("part").alias("p")).scalar())


@query("select * from (select row_id, word, category from word_list where word = lower('Fall') or word in (select min(word) from word_list)) where word = (select min(word) from word_list) or word = 'fall'")
def q_point_get(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "word_list").select("row_id", "word", "category")
    least = w.agg(F.min("word")).first()[0]
    return search.point_get(w, least).unionByName(search.point_get(w, "Fall"))


@query("select row_id, word in (select globasa from menalari_extension where globasa is not null) as has_entry from word_list where word is not null")
def q_membership(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "word_list").where("word is not null").select("row_id", "word")
    return search.flagged(w, table(spark, sf, "menalari_extension").select(F.col("globasa").alias("word")), "has_entry").select("row_id", "has_entry")


_SENTENCES = rf"sent as (select doc_id, generate_subscripts(v, 1) - 1 as no, unnest(v) || '.' as s from (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.\n]'), lambda s: {strip('s')}), lambda s: s <> '') as v from documents where text is not null))"
_GLOSSES = f"glosses as (select distinct word, {strip("unnest(string_split(translationeng, ','))")} as g from words where translationeng is not null)"


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences of the documents: doc_id, no, s."""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(T.sentences("text")).alias("no", "s"))


def gloss_items(spark: SparkSession, sf: str) -> DataFrame:
    """(gloss, word): the items of the English glosses, as a dictionary into the language."""
    w = words(spark, sf)
    return w.select(F.explode(T.split_items("translationeng")).alias("gloss"), "word").distinct()


@query(rf"""
with {WORDS}, {_GLOSSES}, {_SENTENCES}, t as (select doc_id, no, regexp_extract_all(lower(s), '\p{{L}}+') as t from sent),
p as (select distinct doc_id, no, array_to_string(t[i:i + n - 1], ' ') as phrase from (select doc_id, no, t, n, unnest(range(1, len(t) - n + 2)) as i from (select doc_id, no, t, unnest(range(1, 6)) as n from t) where n <= len(t))),
d as (select lower(g) as phrase, min({strip("string_split(word, ';')[1]")}) as gloss from glosses where g <> '' group by 1)
select doc_id, no::int as no, phrase, regexp_replace(gloss, '^[a-z./ ]+:\s*', '') as gloss from p join d using (phrase)
""")
def q_glossary(spark: SparkSession, sf: str) -> DataFrame:
    """Glosses that stand in the sentences of the documents, with a word of the list."""
    g = gloss_items(spark, sf).select(F.col("gloss").alias("word"), F.col("word").alias("meaning"))
    return search.glossary(sentences(spark, sf), ["doc_id", "no"], "s", g, "meaning")


@query(rf"""
with {WORDS}, {_GLOSSES}, {_SENTENCES}, f as (select doc_id * 100000 + no as ord, s as seg, unnest(list_distinct(regexp_extract_all(lower(s), '\p{{L}}+'))) as token from sent), w as (select distinct g as word, lower(g) as token from glosses where g <> '')
select word, ord, seg from (select word, ord, seg, row_number() over (partition by word order by ord, seg) as n from f join w using (token)) where n <= 20
""")
def q_examples(spark: SparkSession, sf: str) -> DataFrame:
    """The first sentences of the documents for each one-word gloss."""
    s = sentences(spark, sf).withColumn("ord", F.col("doc_id") * 100000 + F.col("no"))
    return search.top_examples(search.sentence_index(s, "s", "ord"), gloss_items(spark, sf).select(F.col("gloss").alias("word")))


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return words(spark, sf).withColumnsRenamed({"translationeng": "eng", "translationspa": "spa", "translationepo": "epo"})


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    ext = rows.keep_first(table(spark, sf, "menalari_extension").where("globasa is not null").select(F.col("globasa").alias("word"), "ext_id", *CELLS), ["word"], ["ext_id"])
    return search.translation_groups(_entries(spark, sf).join(ext, "word", "left"), {"spa": "Spanish", "epo": "Esperanto"}, CELLS)


@query(twins.translation_groups({"translationspa": "Spanish", "translationepo": "Esperanto"}, CELLS))
def q_translation_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _groups(spark, sf).withColumn("texts", F.array_join("texts", "|"))


@query()
def q_lookup(spark: SparkSession, sf: str) -> DataFrame:
    w = words(spark, sf)
    least = w.where("translationeng is not null").agg(F.min("word")).first()[0]
    glosses = gloss_items(spark, sf).where(F.col("word") == least).select(F.col("gloss").alias("word"))
    found = search.top_examples(search.sentence_index(sentences(spark, sf).withColumn("ord", F.col("doc_id") * 100000 + F.col("no")), "s", "ord"), glosses)
    examples = found.select(F.lit(least).alias("word"), "ord", "seg")
    ext = table(spark, sf, "menalari_extension").where("globasa is not null").select(F.col("globasa").alias("word"), "ext_id", *CELLS)
    return search.lookup(w, least, {"extension": ext}, search.derived_index(w, "lexiliasel"), _groups(spark, sf), examples)


# --- composites -----------------------------------------------------------------------------


# The codes that stand for Spanish and Esperanto in the tables, and the dictionary's names of the dump's parts of speech.
SPANISH, ESPERANTO = ("qig", "qct", "qbb"), ("qcp",)
DUMP_POS = {"Noun": "noun", "Proper noun": "name", "Verb": "verb", "Adjective": "adj", "Adverb": "adv", "Numeral": "num", "Preposition": "prep", "Phrase": "phrase"}


def gloss_markings(spark: SparkSession, sf: str, words: DataFrame) -> DataFrame:
    """The dump's markings of English headwords, for each word that has the headword as a gloss."""
    pos = F.coalesce(F.try_element_at(G.string_map(DUMP_POS), F.col("Prt of Sp")), F.col("Prt of Sp"))
    marks = readers.markings(marking_rows(spark, sf).withColumns({"Eng": F.col("Glb"), "Prt of Sp": pos}), "row_id").drop("glb")
    return sense.lookups(words).select(F.col("word").alias("glb"), F.col("eng_word").alias("eng")).distinct().join(marks, "eng")


def alignment(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    records = readers.parse_dictionary(table(spark, sf, "raw_wiktextract"))
    t = readers.translations(records)
    w = _entries(spark, sf).select("word", "wordclass", "eng", "spa", "epo", "tags", "antonyms")
    return w, t, sense.align_senses(w, t, readers.senses(records, ["rec_id"]), gloss_markings(spark, sf, w), spa_codes=SPANISH, epo_codes=ESPERANTO)


@query()
def q_sense_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment(spark, sf)[2]


@query(twins.SENSE_DEFINITIONS)
def q_sense_definitions(spark: SparkSession, sf: str) -> DataFrame:
    """Which sense each translation's sense text means."""
    records = readers.parse_dictionary(table(spark, sf, "raw_wiktextract"))
    m = sense.match_definitions(readers.translations(records), readers.senses(records, ["rec_id"]))
    return m.select("word", "pos", "sense", "sense_no", "definition", F.array_join("examples", "|").alias("examples"))


@query()
def q_extension_table(spark: SparkSession, sf: str) -> DataFrame:
    w, t, s = alignment(spark, sf)
    return sense.extension_table(w, s, t, ["qig", "qeu", "qew"])


@query("""
select c1 as word, c2 as pos, c4 as sense, c5 as lang, array_to_string(list_sort(list(distinct c6) filter (where c6 is not null)), ', ') as translations from dump_tc where c1 = 'draw' and c2 = 'Verb' group by all
""")
def q_word_report(spark: SparkSession, sf: str) -> DataFrame:
    asked = spark.createDataFrame([("draw", "Verb")], "word string, pos string")
    return sense.word_report(dump(spark, sf), asked).withColumn("translations", F.when(F.col("translations") != "", F.col("translations")))


@query(twins.DICTIONARY)
def e_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return export.dictionary_lines(_entries(spark, sf), ["eng", "spa", "epo"], gendered=["spa"])


@query()
def e_cards(spark: SparkSession, sf: str) -> DataFrame:
    w = _entries(spark, sf)
    ranking = w.where("example is not null").select(F.col("row_id").alias("rank"), "word", "example", F.lit("word list").alias("source"), F.lit(None).cast("string").alias("english"))
    return export.card_rows(ranking, w)


_TWO = sql_list(k for k, v in G.WORD_CLASSES.items() if len(v) == 2)
_ONE = sql_list(k for k, v in G.WORD_CLASSES.items() if len(v) == 1)


@query(f"""
with {WORDS}, p as (select word, string_split(wordclass, '; ') as k, string_split({strip("replace(replace(translationeng, '(_', '('), '_)', ')')")}, '; ')[1] as g from words where translationeng is not null and wordclass is not null)
select word, {strip('g')} as page from p where not contains(g, ', ') and list_sum(list_transform(k, lambda c: case when starts_with(c, 'b.') or c in ({_TWO}) then 2 when c in ({_ONE}) then 1 else 0 end)) = 2
""")
def e_pages(spark: SparkSession, sf: str) -> DataFrame:
    return export.page_candidates(_entries(spark, sf), "general")
